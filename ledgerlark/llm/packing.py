"""Best-fit packing of documents into sequences of fixed length, in bulk-synchronous rounds (op 8).

Pieces are range-sorted by length, which gives each its place among those of equal length.  Lengths are taken in
classes, the longest first, and a class in rounds.  In a round the open sequences are range-sorted by their gaps, which
gives each its place among equal gaps; tasks report how many gaps of each size they hold.  A sweep from the
longest pieces down gives each length the smallest gaps that hold it, each gap once in a round and with as many
pieces of one length as fit; places settle which piece gets which gap, row by row and without a join.  Gaps shrink
and the next round follows, until no piece of the class fits anywhere; what is left of it opens new sequences.

Lengths and gaps are whole numbers up to the capacity, so what the driver sees of a round is at most one counter for
each of them, whatever the number of documents.

Null text: the empty text, a piece of the end id alone.  Equal rows: packed each by itself.  A null doc_id is packed
like others.  Texts of any length are cut into pieces; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens
from .common import discard, lean, map_texts, saved, shared_path, table, texts

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(docs: DataFrame, vocabulary: str, capacity: int, end_id: int) -> DataFrame:
    """The pieces of every document: its ids and end_id, cut from the end into pieces of the capacity."""
    end = tokens.packed([end_id])

    def work(ids: list, text: list[str]) -> dict:
        rows: list[tuple] = []
        for i, t in zip(ids, text, strict=True):
            data = tokens.byte_bpe(vocabulary, t) + end
            n, start = len(data) // 4, 0
            for k in range(-(-n // capacity)):
                length = (n % capacity or capacity) if k == 0 else capacity
                rows.append((i, k, start, length, zlib.crc32(data[4 * start : 4 * (start + length)])))
                start += length
        return dict(zip(("doc_id", "piece", "start", "length", "ids_crc32"), map(list, zip(*rows, strict=True)), strict=True))

    return map_texts(texts(docs), work, PIECES)


def numbered(rows: DataFrame, value: str, by: tuple[str, ...], path: str) -> tuple[dict[int, int], dict[tuple[int, int], int]]:
    """Write rows, range-sorted by value, to path with a number (at) that rises within a part; the number of rows of each value, and
    by part and value what to add to `at` for a row's place among all rows of its value.

    A value spans neighbouring parts, so there are no more counters than parts and values."""
    rows.repartitionByRange(value, *by).sortWithinPartitions(value, *by).withColumn("at", F.monotonically_increasing_id()).write.parquet(path)
    schema = T.StructType([*rows.schema.fields, T.StructField("at", T.LongType())])
    counts = rows.sparkSession.read.schema(schema).parquet(path).groupBy(value, F.shiftright("at", _PART).cast("int").alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    total: dict[int, int] = defaultdict(int)
    before: dict[tuple[int, int], int] = {}
    for r in counts.orderBy("part").collect():
        before[r.part, r[value]] = total[r[value]] - r["first"]
        total[r[value]] += r.n
    return dict(total), before


#: Bits of a row's number that count within its part.
_PART = 33


def placed_at(before: dict[tuple[int, int], int], value: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The place of each row among all rows of equal value."""
    out, part = at.copy(), at >> _PART
    for p in np.unique(part):
        own = np.flatnonzero(part == p)
        known, k = np.unique(value[own], return_inverse=True)
        out[own] += np.array([before[int(p), int(v)] for v in known], np.int64)[k]
    return out


# Lengths over capacity / DEPTHS[k] and up to capacity / DEPTHS[k - 1] are a class.
DEPTHS = (1, 2, 3, 4, 5, 6, 8, 12, 24, 96)


def classes(lengths: list[int], capacity: int) -> list[list[int]]:
    """The lengths in classes, descending."""
    out: dict[int, list[int]] = defaultdict(list)
    for n in sorted(lengths, reverse=True):
        out[sum(n * d <= capacity for d in DEPTHS)].append(n)
    return list(out.values())


def sweep(gaps: dict[int, int], left: dict[int, int], lengths: list[int], placed: dict[int, int]) -> dict[int, list[tuple[int, int, int, int, int]]]:
    """gap: (first gap, length, first piece, pieces for each gap, pieces) for the lengths, longest first.

    gaps: number of gaps of each size; left, placed: pieces of each length still to place, and placed; both are updated."""
    free, used, plan = sorted(g for g in gaps if gaps[g]), defaultdict(int), defaultdict(list)
    for length in lengths:
        at = bisect.bisect_left(free, length)
        while left[length] and at < len(free):
            gap = free[at]
            each = gap // length
            n = min(gaps[gap] - used[gap], -(-left[length] // each))
            pieces = min(left[length], n * each)
            plan[gap].append((used[gap], length, placed[length], each, pieces))
            used[gap] += n
            left[length] -= pieces
            placed[length] += pieces
            if used[gap] == gaps[gap]:
                free.pop(at)
    return dict(plan)


def given(plan: dict[int, np.ndarray], gap: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each gap, by its size and place: the length of its new pieces, the first one's place and their number."""
    length, first, n = np.zeros(len(gap), np.int64), np.zeros(len(gap), np.int64), np.zeros(len(gap), np.int64)
    for g in np.unique(gap):
        own = plan.get(int(g))
        if own is not None:
            rows = np.flatnonzero(gap == g)
            k = np.searchsorted(own[:, 0], at[rows], "right") - 1
            start, size, piece, each, pieces = own[k].T
            done = (at[rows] - start) * each
            length[rows], first[rows], n[rows] = size, piece + done, np.clip(pieces - done, 0, each)
    return length, first, n


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Each piece with its sequence_id and its offset there."""
    spark = pieces.sparkSession
    pieces = saved(pieces, "pieces")  # the range sort reads them twice
    sorted_ = shared_path(spark, "sorted")
    total, ahead = numbered(pieces, "length", ("doc_id", "piece", "ids_crc32"), sorted_)
    discard(pieces)
    path, plans, left, placed, used = shared_path(spark, "rounds"), {}, dict(total), defaultdict(int), 0
    state = "sequence long, gap long, at long"

    def shrunk(least: int):
        """The gaps left after their last round, without those that hold no piece to come."""
        known = spark.sparkContext.broadcast({r: plans[r] for r in last})

        def run(batches):
            for b in batches:
                sequence, gap, at, number = (c.to_numpy() for c in b.columns)
                after = gap.copy()
                for r in np.unique(number):
                    own = number == r
                    plan, before = known.value[int(r)]
                    length, _, n = given(plan, gap[own], placed_at(before, gap[own], at[own]))
                    after[own] -= length * n
                open_ = after >= least
                yield pa.RecordBatch.from_arrays([pa.array(sequence[open_]), pa.array(after[open_])], names=["sequence", "gap"])

        return run

    def written(r: int) -> DataFrame:
        return spark.read.schema(state).parquet(f"{path}/round={r}").withColumn("round", F.lit(r))

    def planned(sizes: dict[int, int], lengths: list[int], before: dict[tuple[int, int], int]) -> bool:
        plan = sweep(sizes, left, lengths, placed)
        plans[len(plans)] = {g: np.array(own, np.int64) for g, own in plan.items()}, before
        return bool(plan)

    last: list[int] = []  # the rounds that hold the open sequences
    for lengths in classes(list(total), capacity):
        while any(left[n] for n in lengths):
            here: list[int] = []
            if last:
                gaps = reduce(DataFrame.union, [written(r) for r in last]).mapInArrow(lean(shrunk(min(n for n in left if left[n]))), T.StructType.fromDDL("sequence long, gap long"))
                sizes, before = numbered(gaps, "gap", ("sequence",), f"{path}/round={len(plans)}")
                here, last = [len(plans)], [len(plans)]
                if planned(sizes, lengths, before):
                    continue
            r, opened = len(plans), sum(-(-left[n] // (capacity // n)) for n in lengths)
            planned({capacity: opened}, lengths, {(p, capacity): 0 for p in range((opened >> _PART) + 1)})
            spark.range(opened).select((F.col("id") + used).alias("sequence"), F.lit(capacity).cast("long").alias("gap"), F.col("id").alias("at")).write.parquet(f"{path}/round={r}")
            used += opened
            last = [*here, r]
    known = spark.sparkContext.broadcast((plans, ahead))

    def spread(batches):
        for b in batches:
            sequence, gap, at, number = (c.to_numpy() for c in b.columns)
            for r in np.unique(number):
                own = np.flatnonzero(number == r)
                plan, before = known.value[0][int(r)]
                length, first, n = given(plan, gap[own], placed_at(before, gap[own], at[own]))
                row = np.repeat(np.arange(len(own)), n)
                k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                out = (length[row], first[row] + k, sequence[own][row], capacity - gap[own][row] + k * length[row])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["length", "at", "sequence_id", "offset"])

    def located(batches):
        for b in batches:
            *own, at = b.columns
            yield pa.RecordBatch.from_arrays([*own, pa.array(placed_at(known.value[1], b.column("length").to_numpy(), at.to_numpy()))], names=b.schema.names)

    out = T.StructType.fromDDL("length long, at long, sequence_id long, offset long")
    found = spark.read.schema(f"{state}, round int").parquet(path).mapInArrow(lean(spread), out) if plans else spark.createDataFrame([], out)
    rows = spark.read.schema(f"{PIECES}, at long").parquet(sorted_).mapInArrow(lean(located), T.StructType.fromDDL(f"{PIECES}, at long"))
    return rows.join(found, ["length", "at"]).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(cut(table(spark, sf_dir, "documents"), tokens.vocabulary("byte_bpe_50k.json"), 1024, end_id=2), 1024)
