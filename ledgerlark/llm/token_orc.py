"""Token ids as ORC files in document order (op 1).

Integer columns of ORC are run-length encoded; the files carry row indexes and Bloom filters on the
document ids, so a reader takes stripes in parallel and a lookup by id skips what cannot hold it.

Null text: the empty text.  Null ids: first.  Rows with equal ids: by their text's hash.  Texts are encoded whole, whatever
their length, one row each; a slice of rows ends behind a long one.  Extra columns are ignored.  An empty table gives an empty, readable folder.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens
from .common import map_texts, shared_path, table, texts

SCHEMA = "doc_id long, part int, start_in_part long, ids array<int>"


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int, stripe_bytes: int = 64 << 20) -> None:
    """Encode every text, append end_id and write ids in ascending doc_id order, a file for each range of ids."""
    ordered = texts(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    at = {"part": -1, "start": 0}

    def encode(ids: list, text: list[str]) -> dict:
        part = TaskContext.get().partitionId()  # type: ignore[union-attr]
        if at.get("task") != (key := TaskContext.get().taskAttemptId()):  # type: ignore[union-attr]
            at.update(task=key, start=0)
        got = [tokens.word_bpe(vocabulary, t) for t in text]
        lengths = np.array([len(x) // 4 + 1 for x in got], np.int64)
        ends = lengths.cumsum()
        start, at["start"] = at["start"] + ends - lengths, at["start"] + int(ends[-1])
        flat = np.frombuffer(b"".join(x + end for x in got), "<i4")
        values = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(flat))
        return {"doc_id": ids, "part": [part] * len(ids), "start_in_part": start, "ids": values}

    end = np.array([end_id], "<u4").tobytes()
    (
        map_texts(ordered, encode, SCHEMA)
        .write.option("orc.bloom.filter.columns", "doc_id").option("orc.create.index", "true").option("orc.compress", "ZSTD")
        .option("orc.stripe.size", str(stripe_bytes)).orc(path)
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, part, start_in_part and ids as written."""
    return spark.read.schema(SCHEMA).orc(path)


def lookup(spark: SparkSession, path: str, doc_id: int) -> DataFrame:
    """The ids of one document; the predicate reaches the files' indexes and Bloom filters."""
    return read(spark, path).where(F.col("doc_id") == doc_id)


def starts(spark: SparkSession, path: str) -> DataFrame:
    """Per document: doc_id, start among all ids, n_tokens, ids_crc32, all from the files.

    The number of ids before a file takes one row per file; everything else is row by row.
    """
    written = read(spark, path)
    sizes = written.groupBy("part").agg(F.sum(F.size("ids")).cast("long").alias("n")).orderBy("part").collect()
    before = np.r_[0, np.cumsum([r.n for r in sizes], dtype=np.int64)]
    known = spark.createDataFrame([(r.part, int(b)) for r, b in zip(sizes, before[:-1], strict=True)], "part int, before long")

    def digest(batches):
        for b in batches:
            ids = b.column("ids")
            flat, edge = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4"), np.r_[0, np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))]
            crc = [zlib.crc32(flat[s:e].tobytes()) for s, e in zip(edge[:-1], edge[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part"), b.column("start_in_part"), pa.array(np.diff(edge).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "part", "start_in_part", "n_tokens", "ids_crc32"])

    out = T.StructType.fromDDL("doc_id long, part int, start_in_part long, n_tokens long, ids_crc32 long")
    return written.mapInArrow(digest, out).join(F.broadcast(known), "part").select("doc_id", (F.col("before") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32")


def op1_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "token-orc")
    write(table(spark, sf_dir, "documents"), path, tokens.vocabulary("word_bpe_49k.json"), end_id=2)
    return starts(spark, path)
