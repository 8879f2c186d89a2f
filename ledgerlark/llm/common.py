"""What the operators of this subpackage share: tables, shared folder, text batches, hashes, components.

Nulls: a null text counts as the empty text.  A row with a null id keeps its row in the results of
row-wise operators; operators that link rows leave it unlinked.
"""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as the operators take it.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: A-Z to a-z and nothing else.
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of whole texts that fit a small Python worker: 1,000 rows and 8 MB at most."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """The id and the whole text of each document; null text: empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir, or one of our own where that is unset (tests)."""
    small_batches(spark)
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = "file://" + tempfile.mkdtemp(prefix="ledgerlark-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d.rstrip("/")


def shared_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def fresh(df: DataFrame, name: str) -> str:
    """A column name like the given one that df does not have, whatever the case."""
    known = {c.lower() for c in df.columns}
    while name.lower() in known:
        name += "_"
    return name


def saved(df: DataFrame, what: str, rows: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives lost executors.  rows: large ones, so many of which are held at once."""
    path = shared_path(df.sparkSession, what)
    (df.write.option("parquet.block.row.count.limit", rows) if rows else df.write).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that saved() wrote, once what was made of them is written."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.written)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def released() -> None:
    """Hand what this Python worker has freed back to the system: workers outlive their tasks, and what they keep counts against the executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def lean(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """work, for mapInArrow, whose worker keeps no freed memory behind it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        released()

    return run


def chunks(columns: list[list], text_at: int, most_chars: int = 1 << 20) -> Iterator[list[list]]:
    """Slices of the columns holding about most_chars characters of text each; one row at least."""
    n, start, size = len(columns[0]), 0, 0
    for i in range(n):
        size += len(columns[text_at][i])
        if size >= most_chars:
            yield [c[start : i + 1] for c in columns]
            start, size = i + 1, 0
    if start < n:
        yield [c[start:] for c in columns]


def map_texts(df: DataFrame, work: Callable[..., dict[str, object]], schema: str, columns: list[str] | None = None, text: str = "text") -> DataFrame:
    """Run work(*columns as lists) over bounded slices of rows; it returns a dict of equally long output columns."""
    names = columns or df.columns
    df = df.select(*names)
    fields = SparkSession.getActiveSession().createDataFrame([], schema).schema  # type: ignore[union-attr]
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(fields)
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in chunks([c.to_pylist() for c in b.columns], at):
                got = work(*part)
                yield pa.RecordBatch.from_arrays([pa.array(got[f.name], type=f.type) if not isinstance(got[f.name], pa.Array) else got[f.name] for f in out], schema=out)

    return df.mapInArrow(lean(run), fields)


# --- hashes -----------------------------------------------------------------------------------

_U = np.uint64
_P = _U(0x9E3779B97F4A7C15 | 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit integers."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return x


def powers(n: int, base: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64."""
    out = np.full(n + 1, _U(base))
    out[0] = 1
    return np.multiply.accumulate(out, dtype=_U)


_BYTE = {seed: mix(np.arange(256, dtype=_U) + _U(1 + 1000 * seed)) for seed in (1, 2)}
_BASE = {1: 0x5851F42D4C957F2D, 2: 0x2545F4914F6CDD1D}
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, in bytes, of the words of a UTF-8 text."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_SPACE[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def spans_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of each span of bytes, by prefix sums of a polynomial: no loop over the words."""
    if not len(starts):
        return np.zeros(0, _U)
    up = powers(len(data), _BASE[seed])
    down = powers(len(data), pow(_BASE[seed], -1, 1 << 64))
    prefix = np.zeros(len(data) + 1, _U)
    np.cumsum(_BYTE[seed][data] * up[:-1], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * down[starts] + mix((ends - starts).astype(_U)))


def rolling(words: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of every k consecutive word hashes."""
    if len(words) < k:
        return np.zeros(0, _U)
    base = _U(_BASE[3 - seed])
    h = np.zeros(len(words) - k + 1, _U)
    for i in range(k):
        h = h * base + words[i : i + len(h)]
    return mix(h)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def encoded(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)


# --- numbers in little space --------------------------------------------------------------------


def planes(x: np.ndarray) -> bytes:
    """The bytes of equal place together: those that hardly change compress to nothing."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def unplanes(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def grouped(batches: Iterator[pa.RecordBatch], by: int = 1) -> Iterator[tuple[tuple, list[tuple]]]:
    """The rows of each key, the first columns, by which they come sorted."""
    key, rows = None, []
    for b in batches:
        for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if r[:by] != key:
                if rows:
                    yield key, rows
                key, rows = r[:by], []
            rows.append(r)
    if rows:
        yield key, rows


# --- filters of fixed size ------------------------------------------------------------------------

#: Bits of the filter that spares other documents a shuffle; a larger input only makes it leak.
FILTER_BITS = 1 << 26


def member_filter(ids: DataFrame, bit: Column | None = None) -> np.ndarray:
    """A Bloom filter of FILTER_BITS bits on the column doc_id (or of given bits), put together from Spark's bitmaps."""
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)) if bit is None else bit
    parts = ids.select((bit + 1).alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect()
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in parts:
        out[(r["at"] - 1) * 4096 : r["at"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def touched(docs: DataFrame, wanted: DataFrame, other: bool = False) -> DataFrame:
    """docs (with doc_id) that pass the filter of the ids in wanted, or the others."""
    bits = member_filter(wanted)
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column(b.num_columns - 1).fill_null(0).to_numpy()
            hit = (shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
            yield pa.RecordBatch.from_arrays(b.columns[:-1], names=b.schema.names[:-1]).filter(pa.array(hit != other))

    return docs.withColumn(fresh(docs, "__bit"), F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))).mapInArrow(lean(run), docs.schema)


# --- connected components -----------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (a long, b long); component: the smallest node reachable.

    Alternating large and small stars; each round is grouping and joins, with the lineage cut by a
    written table.  A hub costs one row per link and its minimum is pre-aggregated.
    """
    e = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    last = None
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = saved(both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        before, e = e, saved(small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(low.select("a", F.col("m").alias("b"))).distinct(), "small")
        discard(before, large)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
