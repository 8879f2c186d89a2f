"""Whitening of embeddings by Chebyshev-filtered subspace iteration (op 11).

Entries become whole numbers, so counts, sums and deviations are exact.  The covariance is never formed: a pass multiplies a block of
directions by it, centred row by row, each task adding up its rows' part.  A filter of so many passes damps the spectrum below the
block's smallest Ritz value by the Chebyshev recurrence, QR makes the block orthonormal, and Rayleigh-Ritz gives the pairs.
Rounds go on until every wanted pair's residual is at rounding level, or no longer falls (CERTIFIED says how small it must be then).

The driver holds blocks of dimensions x directions and adds the sums of about the square root of the number of tasks.  Only the distinct
vectors are shuffled, once; a vector that a third of all rows share is one row of each task before that.

A row whose vector is null or holds null or non-finite entries is left out; zero vectors take part.  A null vec_id keeps its row, as do rows that repeat
one.  Vectors of different lengths are tables of their own; empty vectors have no component and no row.  Entries beyond a long's
range after scaling stand at its ends.  Components whose eigenvalue is zero within rounding cannot be whitened and have no row: fewer distinct vectors
than 17 have fewer components, a single one has none.  A deviation too large for a long is null.  An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, saved, table

#: Scale and offset of whole entries.
SCALE, OFFSET = 64, 1_000_000
#: Directions beside the wanted ones, passes of a filter, rounds at most.
GUARD, DEGREE, ROUNDS = 16, 12, 40
#: Residual over the largest eigenvalue at which a pair counts as exact, and at which it may stop falling.
EXACT, CERTIFIED = 2e-15, 1e-9
_LONG = (1 << 63) - 1

_VALID = "embedding is not null and size(embedding) > 0 and forall(embedding, x -> coalesce(not isnan(x) and abs(x) < double('infinity'), false))"


def whole(vectors: DataFrame) -> DataFrame:
    """vec_id, dim, x: the entries times SCALE, rounded down, without the offset, which centring takes out again."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(_VALID)
    scaled = F.transform("embedding", lambda c: F.when(c * SCALE >= float(_LONG), _LONG - OFFSET).when(c * SCALE <= -float(_LONG), -_LONG).otherwise(F.floor(F.least(F.greatest(c * SCALE, F.lit(-9.2e18)), F.lit(9.2e18)))).cast("long"))
    return v.select("vec_id", F.size("embedding").alias("dim"), scaled.alias("x"))


def rows_of(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - sums, exactly: as longs if they hold it, as Python's numbers otherwise."""
    most = max(int(np.abs(x.astype(float)).max(initial=0)) + 1, 1)
    if n * most * 2 < 1 << 62:
        return n * x - sums.astype(np.int64)
    return n * x.astype(object) - sums


def deviations(c: np.ndarray) -> list[int | None]:
    """The sum of squares of each row, exactly; null beyond a long."""
    if c.dtype != object:
        most = int(np.abs(c).max(initial=0))
        if most * most * c.shape[1] <= _LONG:
            return (c * c).sum(1).tolist()
        c = c.astype(object)
    return [d if d <= _LONG else None for d in (c * c).sum(1).tolist()]


def added(df: DataFrame, part: Callable[[np.ndarray], tuple[np.ndarray, ...]]) -> list[np.ndarray]:
    """part(rows of x) summed over all rows: in each task, then over the tasks of a group, then over about as many groups as a group has tasks."""

    def summed(rows: Iterator[list[np.ndarray]]) -> Iterator[list[np.ndarray]]:
        total: list[np.ndarray] = []
        for r in rows:
            total = [a + b for a, b in zip(total, r, strict=True)] if total else r
        if total:
            yield total

    schema = T.StructType.fromDDL("task int, sums array<binary>")
    batch = lambda task, total: pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([[x.tobytes() for x in total]], pa.list_(pa.binary()))], names=["task", "sums"])
    read = lambda b: [np.frombuffer(x.as_buffer()) for x in b]

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for total in summed(list(part(rows_of(b.column(0)))) for b in batches if b.num_rows):
            yield batch(TaskContext.get().partitionId(), total)  # type: ignore[union-attr]

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for total in summed(read(s) for b in batches for s in b.column(1)):
            yield batch(0, total)

    groups_of = max(1, int(df.rdd.getNumPartitions() ** 0.5))
    found = df.select("x").mapInArrow(tasks, schema)
    if groups_of > 4:
        found = found.repartition(groups_of, "task").mapInArrow(groups, schema)
    got = [[np.frombuffer(s) for s in r.sums] for r in found.collect()]
    return [sum(c) for c in zip(*got, strict=True)]


class Passes:
    """Products of a table's covariance with blocks of directions."""

    def __init__(self, fit: DataFrame, n: int, sums: np.ndarray):
        self.fit, self.n, self.sums, self.count = fit, n, sums, 0

    def each(self, work: Callable[[np.ndarray], tuple[np.ndarray, ...]]) -> list[np.ndarray]:
        n, sums = self.n, self.sums
        return [s / n for s in added(self.fit, lambda x: tuple(np.ascontiguousarray(y, float) for y in work((centred(x, n, sums) / n).astype(float))))]

    def variances(self) -> np.ndarray:
        return self.each(lambda z: ((z * z).sum(0),))[0]

    def times(self, q: np.ndarray) -> np.ndarray:
        self.count += 1
        return self.each(lambda z: (z.T @ (z @ q),))[0].reshape(q.shape)


def eigenpairs(passes: Passes, dim: int, wanted: int, trace: float, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(values falling, vectors as columns) of the wanted largest pairs; pairs of value zero are left out."""
    size = min(dim, wanted + GUARD)
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, size)))[0]
    last = np.inf
    for _ in range(ROUNDS):
        vq = passes.times(q)
        small = q.T @ vq
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, vq = q @ turn, vq @ turn
        top = max(values[0], 0.0)
        residual = np.linalg.norm(vq[:, :wanted] - q[:, :wanted] * values[:wanted], axis=0).max() / top if top else 0.0
        if residual <= EXACT or size == dim or (residual <= CERTIFIED and residual > last / 4):
            break
        last = residual
        # the unwanted spectrum lies between zero and the block's smallest value
        middle = half = max(values[-1], 1e-9 * top) / 2
        first = half / (middle - top)  # scaled so that the largest direction keeps its length
        scale, before, now = first, q, (vq - middle * q) * (first / half)
        for _step in range(DEGREE - 1):
            scale_next = 1 / (2 / first - scale)
            before, now = now, (passes.times(now) - middle * now) * (2 * scale_next / half) - before * (scale * scale_next)
            scale = scale_next
        q = np.linalg.qr(now)[0]
    else:
        raise ArithmeticError(f"no {wanted} pairs certified in {ROUNDS} rounds; residual {last:.1e}")
    use = np.flatnonzero(values[:wanted] > 1e-13 * max(trace, 1e-300))
    return values[use], q[:, use]


def whitened(vectors: DataFrame, components: int) -> DataFrame:
    """Per row and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    v = whole(vectors)
    fit = saved(v.select("dim", "x").distinct(), "whitening")
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    out = v.sparkSession.createDataFrame([], schema)
    sizes = fit.groupBy("dim").count().collect()  # a row for each length of vector
    for dim, n in sorted((r["dim"], r["count"]) for r in sizes):
        own = fit.where(F.col("dim") == dim) if len(sizes) > 1 else fit
        found = own.select(F.posexplode("x").alias("at", "x")).groupBy("at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("s")).collect()
        sums = np.array([int(r.s) for r in sorted(found)], object)
        passes = Passes(own, n, sums)
        trace = float(passes.variances().sum())
        values, axes = eigenpairs(passes, dim, min(components, dim), trace)
        if len(values):
            turn = axes / np.sqrt(values)
            mean, second = passes.each(lambda z, turn=turn: ((z @ turn).sum(0), (z @ turn).T @ (z @ turn)))
            error = float(np.abs(second.reshape(len(values), -1) - np.outer(mean, mean) - np.eye(len(values))).max())
            out = out.union(_applied(v.where(F.col("dim") == dim), n, sums, turn, values / trace, error, schema))
    discard(fit)  # all that the result needs of it is in the driver's numbers by now
    return out


def _applied(v: DataFrame, n: int, sums: np.ndarray, turn: np.ndarray, explained: np.ndarray, error: float, schema: str) -> DataFrame:
    k = len(explained)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            c, m = centred(rows_of(b.column(1)), n, sums), b.num_rows
            w = (c / n).astype(float) @ turn
            at = np.repeat(np.arange(m), k)
            dev = pa.array(deviations(c), pa.int64())
            cols = (b.column(0).take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), dev.take(pa.array(at)), pa.array(w.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)))
            yield pa.RecordBatch.from_arrays(list(cols), names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return v.select("vec_id", "x").mapInArrow(run, T.StructType.fromDDL(schema))


def op11_chebyshev_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"), 16)
