"""The index of chunks as tables: filters, presence, replacement, manifests and checks before use."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matches(pages: tuple[int, int] | None = None, **fields: object) -> Column:
    """The condition that a chunk has all given values: a value, any of a list or tuple, a range of pages; None constrains nothing.
    Plain comparisons, so that they reach the scan."""
    own = [F.col(k).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(k) == F.lit(v) for k, v in fields.items() if v is not None]
    if pages is not None:
        own.append(F.col("page").between(*pages))
    return reduce(lambda a, b: a & b, own, F.lit(True))


def scroll(chunks: DataFrame, condition: Column | None = None) -> DataFrame:
    """All chunks that meet a condition."""
    return chunks if condition is None else chunks.where(condition)


def count(chunks: DataFrame, condition: Column | None = None) -> int:
    return scroll(chunks, condition).count()


def present(chunks: DataFrame, field: str, candidates: DataFrame) -> DataFrame:
    """Of the candidate values (one column) those that some chunk has."""
    name = candidates.columns[0]
    return candidates.distinct().join(chunks.select(F.col(field).alias(name)), name, "left_semi")


def without_documents(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    return chunks.join(documents.select("document_id").distinct(), "document_id", "left_anti")


def write(chunks: DataFrame, path: str, recreate: bool = False) -> None:
    """Chunks as a table partitioned by company and fiscal year, which filters on them prune; written anew, or the partitions
    that chunks has."""
    w = chunks.write.partitionBy("company", "fiscal_year").option("partitionOverwriteMode", "static" if recreate else "dynamic")
    w.mode("overwrite").parquet(path)


def stale_caches(cached: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents (document_id, sha256, cache_key) whose chunks are not cached under the same key and content."""
    return documents.join(cached.select("document_id", "sha256", "cache_key"), ["document_id", "sha256", "cache_key"], "left_anti")


def manifest(chunks: DataFrame, collection: str, model: str, dimension: int) -> DataFrame:
    """One row on a collection: model, dimension, points, companies, documents."""
    return chunks.agg(F.lit(collection).alias("collection"), F.lit(model).alias("embedding_model"), F.lit(dimension).alias("dimension"), F.count("*").alias("point_count"), F.array_sort(F.collect_set("company")).alias("companies"), F.array_sort(F.collect_set("document_id")).alias("document_ids"))


def preflight(manifests: DataFrame, chunks: DataFrame, collection: str, model: str, required: DataFrame) -> DataFrame:
    """The collection's manifest, or an error: none recorded, another model, no chunks, or required companies (company) missing."""
    m = manifests.where(F.col("collection") == collection)
    row = m.first()
    if row is None:
        raise ValueError(f"no manifest for collection {collection!r}")
    if row.embedding_model != model:
        raise ValueError(f"collection {collection!r} was indexed with {row.embedding_model}, not {model}")
    if not chunks.take(1):
        raise ValueError(f"collection {collection!r} is empty")
    missing = [r.company for r in required.select("company").distinct().join(chunks, "company", "left_anti").orderBy("company").limit(10).collect()]
    if missing:
        raise ValueError(f"collection {collection!r} does not hold {', '.join(missing)}")
    return m
