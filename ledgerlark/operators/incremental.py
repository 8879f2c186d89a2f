"""Chunks indexed step by step: what changed is written to new paths, and a manifest row written last makes it live.

A collection is a set of partitions (company, fiscal_year), each at the path that the newest manifest row names, and a table of its documents with
the content and the cache key they were chunked under.  A change rewrites the partitions that it touches, beside the old ones; nobody who
reads by the manifest sees half of it, and a crash at any step leaves the state before.  Repeating a change that is in adds nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import latest, record

_PART = "company string, fiscal_year string, path string"
MANIFEST = f"collection string, version long, built_at timestamp, embedding_model string, dimension int, point_count long, companies array<string>, document_count long, documents string, parts array<struct<{', '.join(x.replace(' ', ': ') for x in _PART.split(', ')) }>>"
DOCUMENT = "document_id string, sha256 string, cache_key string, company string, fiscal_year string"
_KEYS = [x.split()[0] for x in DOCUMENT.split(", ")]


def manifest(spark: SparkSession, path: str, collection: str) -> Row | None:
    return latest(spark, f"{path}/manifest", MANIFEST, collection)


def documents(spark: SparkSession, path: str, collection: str) -> DataFrame:
    """The live documents: document_id, sha256, cache_key, company, fiscal_year."""
    now = manifest(spark, path, collection)
    return spark.read.schema(DOCUMENT).parquet(now.documents) if now else spark.createDataFrame([], DOCUMENT)


def read(spark: SparkSession, path: str, collection: str, schema: str) -> DataFrame:
    """The live chunks; only the paths that the manifest names are read."""
    now = manifest(spark, path, collection)
    paths = [p.path for p in now.parts] if now else []
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def outdated(state: DataFrame, live: DataFrame) -> DataFrame:
    """Of the documents as they should be those to chunk again: new ones, other content, another cache key or place."""
    there = F.struct(*[F.col(c) for c in _KEYS[1:]])
    known = live.select("document_id", there.alias("there"))
    return state.join(known, "document_id", "left").where(~there.eqNullSafe(F.col("there"))).drop("there")


def commit(chunks: DataFrame, state: DataFrame, path: str, collection: str, model: str, dimension: int) -> Row:
    """Make state (document_id, sha256, cache_key, company, fiscal_year: all documents) live; chunks: those of its outdated() documents at
    least, with document_id, company and fiscal_year.  Documents that state does not have go.  Returns the manifest row."""
    spark = chunks.sparkSession
    now, live = manifest(spark, path, collection), documents(spark, path, collection)
    state = state.select(*_KEYS)
    new, gone = outdated(state, live), outdated(live, state)
    touched = {tuple(r) for r in new.union(gone).select("company", "fiscal_year").distinct().collect()}  # at most the partitions there are
    if now and not touched:
        return now
    version = uuid.uuid4().hex
    columns = chunks.columns
    own = chunks.join(new.select("document_id"), "document_id", "left_semi").select(*columns)
    old = [p for p in now.parts if (p.company, p.fiscal_year) in touched] if now else []
    if old:
        kept = spark.read.schema(chunks.schema).parquet(*[p.path for p in old]).join(gone.select("document_id"), "document_id", "left_anti")
        own = own.unionByName(kept.select(*columns))
    cells = own.select("company", "fiscal_year").distinct().collect()
    number = {tuple(r): i for i, r in enumerate(sorted(cells, key=repr))}
    at = spark.createDataFrame([(*cell, i) for cell, i in number.items()], "c string, y string, part int")
    placed = own.join(F.broadcast(at), F.col("company").eqNullSafe(F.col("c")) & F.col("fiscal_year").eqNullSafe(F.col("y"))).drop("c", "y")
    placed.write.partitionBy("part").parquet(f"{path}/parts/{version}")
    state.write.parquet(f"{path}/documents/{version}")
    parts = [tuple(p) for p in (now.parts if now else []) if (p.company, p.fiscal_year) not in touched] + [(*cell, f"{path}/parts/{version}/part={i}") for cell, i in number.items()]
    made = [p[2] for p in parts]
    points = spark.read.schema(chunks.schema).parquet(*made).count() if made else 0
    held = state.agg(F.count("*").alias("n"), F.array_sort(F.collect_set("company")).alias("companies")).first()
    row = spark.createDataFrame([(collection, (now.version if now else 0) + 1, model, dimension, points, held.companies, held.n, f"{path}/documents/{version}", parts)], MANIFEST.replace("built_at timestamp, ", ""))
    record(row.withColumn("built_at", F.current_timestamp()), f"{path}/manifest")
    return manifest(spark, path, collection)  # type: ignore[return-value]


# --- the cache of chunks: JSON lines, a folder for each document, a line about it first -----------------

HEADER = "document_id string, sha256 string, cache_key string, pages int, tables int, scale_context_coverage double"


def write_cache(lines: DataFrame, headers: DataFrame, path: str) -> None:
    """lines (document_id, value: a chunk as JSON) behind a line with their document's header (HEADER), in a file for each document.
    Documents that are written again replace their own file alone."""
    names = [x.split()[0] for x in HEADER.split(", ")]
    first = headers.select("document_id", F.lit(-1).cast("long").alias("at"), F.to_json(F.struct(*[F.round(n, 4).alias(n) if n == "scale_context_coverage" else F.col(n) for n in names])).alias("value"))
    rest = lines.select("document_id", F.monotonically_increasing_id().alias("at"), "value")
    both = first.union(rest).repartition("document_id").sortWithinPartitions("document_id", "at")
    both.select("document_id", "value").write.partitionBy("document_id").mode("overwrite").option("partitionOverwriteMode", "dynamic").text(path)


def cached(spark: SparkSession, path: str, state: DataFrame, fields: str) -> tuple[DataFrame, DataFrame]:
    """(chunks with the given fields of the documents whose header has the content and key that state asks for, the documents to chunk again)."""
    lines = spark.read.schema("value string, document_id string").text(path)
    about = F.from_json("value", HEADER)
    is_header = F.get_json_object("value", "$.cache_key").isNotNull()
    good = lines.where(is_header).select(about.alias("h")).select("h.document_id", "h.sha256", "h.cache_key").join(state.select("document_id", "sha256", "cache_key"), ["document_id", "sha256", "cache_key"], "left_semi")
    chunks = lines.where(~is_header).join(good.select("document_id"), "document_id", "left_semi").select(F.from_json("value", fields).alias("c")).select("c.*")
    return chunks, state.join(good.select("document_id"), "document_id", "left_anti")
