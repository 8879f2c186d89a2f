"""Vectors: nearest neighbours by hash-prefix forests (op 3), near duplicates by PCA-ordered tiles (op 4).

Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null vec_id, take
no part.  Other columns are ignored; an empty table gives no rows; rows that repeat a vec_id are vectors of their own.  Vectors of different lengths are not comparable.  Equal vectors are vectors of their own: op 3
ranks them by id, op 4 compares one of them and counts all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, saved, table

_VALID = "vec_id is not null and embedding is not null and size(embedding) > 0 and forall(embedding, x -> coalesce(not isnan(x) and abs(x) < double('infinity'), false)) and exists(embedding, x -> x <> 0)"


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (array<double>) of the vectors that take part."""
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(_VALID)


def matrix(column: pa.Array) -> np.ndarray:
    """A list column whose lists are equally long."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, each the same wherever it stands; scaled against overflow."""
    a, b = a / np.abs(a).max(1, keepdims=True), b / np.abs(b).max(1, keepdims=True)
    return (a * b).sum(1) / np.sqrt((a * a).sum(1) * (b * b).sum(1))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _grouped(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[pa.Table]:
    """The rows of each group, given sorted by the first columns."""
    held: list[pa.RecordBatch] = []
    key = None
    for b in batches:
        keys = list(zip(*(b.column(k).to_pylist() for k in range(by)), strict=True))
        start = 0
        for i, k in enumerate(keys):
            if k != key:
                if i > start:
                    held.append(b.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, start, key = [], i, k
        if len(keys) > start:
            held.append(b.slice(start))
    if held:
        yield pa.Table.from_batches(held)


# --- op 3 ---------------------------------------------------------------------------------------

#: Rows of a block, which has a forest of its own; queries that meet a block in one task.
BLOCK, QUERIES = 8192, 4096
#: Trees, bits of a hash string, and the share of a block's rows gathered as candidates.
TREES, BITS, SHARE = 128, 24, 0.45


class Forest:
    """For each tree the rows' hash strings in sorted order; a string's bits are signs of random projections."""

    def __init__(self, rows: np.ndarray, seed: int = 1):
        self.planes = np.random.default_rng(seed).normal(size=(rows.shape[1], TREES * BITS))
        code = self.codes(rows)
        self.order = np.argsort(code, axis=1, kind="stable")
        self.sorted = np.take_along_axis(code, self.order, 1)

    def codes(self, rows: np.ndarray) -> np.ndarray:
        bits = (rows @ self.planes > 0).reshape(len(rows), TREES, BITS)
        return (bits @ (1 << np.arange(BITS - 1, -1, -1))).T

    def candidates(self, queries: np.ndarray, least: int) -> Iterator[np.ndarray]:
        """For each query the rows of its longest prefix matches: all trees ascend together, a bit at a
        time, until they hold so many different rows; the last bit only in as many trees as that takes."""
        code = self.codes(queries)
        edge = np.empty((2, BITS + 1, TREES, len(queries)), np.int64)
        for k in range(BITS + 1):
            low = code >> k << k
            for t in range(TREES):
                edge[0, k, t] = np.searchsorted(self.sorted[t], low[t])
                edge[1, k, t] = np.searchsorted(self.sorted[t], low[t] + (1 << k))
        total = (edge[1] - edge[0]).sum(1)
        rows = self.order.shape[1]
        for q in range(len(queries)):
            k = max(0, int(np.searchsorted(total[:, q], least)) - 1)  # no lower level holds enough
            hit = np.zeros(rows, bool)
            while True:
                for t in range(TREES):
                    hit[self.order[t, edge[0, k, t, q] : edge[1, k, t, q]]] = True
                    if t % 8 == 7 and hit.sum() >= least:
                        break
                if k >= BITS or hit.sum() >= least:
                    break
                k += 1
            yield np.flatnonzero(hit)


def nearest(vectors: DataFrame, every: int, most: int, share: float = SHARE) -> DataFrame:
    """query_id, rank, vec_id, score: for each vector whose id is divisible by every, the nearest others found."""
    v = saved(valid(vectors).withColumn("dim", F.size("embedding")), "vectors")
    sizes = v.groupBy("dim").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.greatest(F.lit(1), F.ceil(F.count_if(F.col("vec_id") % every == 0) / QUERIES)).cast("int").alias("chunks"))
    v = v.join(F.broadcast(sizes), "dim")  # a row for each length of vector
    to = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.col(n)).cast("int")
    rows = v.select("dim", to("blocks", 1).alias("block"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(False).alias("ask"), "vec_id", "embedding")
    asks = v.where(F.col("vec_id") % every == 0).select("dim", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), to("chunks", 2).alias("chunk"), F.lit(True).alias("ask"), "vec_id", "embedding")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _grouped(batches, 3):
            t = t.combine_chunks()
            ids, ask = t.column("vec_id").to_numpy(), t.column("ask").to_numpy().astype(bool)
            x = matrix(t.column("embedding").chunk(0))
            queries, own, rows, row_ids = x[ask], ids[ask], x[~ask], ids[~ask]
            if not len(queries) or not len(rows):
                continue
            u, uq, out = unit(rows), unit(queries), []
            forest = Forest(u)
            for q, hit in enumerate(forest.candidates(uq, min(len(rows), max(4 * most, int(np.ceil(share * len(rows))))))):
                hit = hit[row_ids[hit] != own[q]]
                if not len(hit):
                    continue
                s = u[hit] @ uq[q]
                if len(hit) > most:
                    hit = hit[s >= np.partition(s, len(s) - most)[len(s) - most] - 1e-9]
                s = cosines(rows[hit], queries[q][None, :])
                best = np.lexsort((row_ids[hit], -s))[:most]
                out.append((np.full(len(best), own[q]), row_ids[hit[best]], s[best]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["query_id", "vec_id", "score"])

    by = ("dim", "block", "chunk")
    found = rows.union(asks).repartition(*by).sortWithinPartitions(*by).mapInArrow(search, T.StructType.fromDDL("query_id long, vec_id long, score double"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("query_id", "rank", "vec_id", "score")


def op3_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), 50, 5)


# --- op 4 ---------------------------------------------------------------------------------------

TILE = 8192
_EPS = 1e-9


def principal(v: DataFrame) -> np.ndarray:
    """The principal axes of the unit vectors in embedding, strongest first, as columns."""

    def moment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for b in batches:
            u = unit(matrix(b.column(0)))
            total = total + u.T @ u
        if not np.isscalar(total):
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(np.frombuffer(m.as_buffer()) for b in batches for m in b.column(0))
        yield pa.RecordBatch.from_arrays([pa.array([np.asarray(total).tobytes()], pa.binary())], names=["m"])

    m = T.StructType.fromDDL("m binary")
    total = np.frombuffer(v.select("embedding").mapInArrow(moment, m).repartition(1).mapInArrow(summed, m).first().m)
    d = int(round(len(total) ** 0.5))
    return np.ascontiguousarray(np.linalg.eigh(total.reshape(d, d))[1][:, ::-1])


def tile_hits(a: np.ndarray, b: np.ndarray, at_least: float, raw_a: np.ndarray, raw_b: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, hits of a few rows of a against b): dimensions are added a few at a time, and pairs
    whose sum with the product of their suffix norms cannot reach at_least are left."""
    d = a.shape[1]
    steps = [k for k in (8, 16, 32) if k < d] + [d]
    left_a = {k: np.sqrt(np.maximum((a[:, k:] ** 2).sum(1), 0)) for k in steps}
    left_b = {k: np.sqrt(np.maximum((b[:, k:] ** 2).sum(1), 0)) for k in steps}
    for s in range(0, len(a), 512):
        rows = a[s : s + 512]
        sums, start = np.zeros((len(rows), len(b))), 0
        hits = None
        for k in steps:
            sums += rows[:, start:k] @ b[:, start:k].T
            start = k
            alive = sums + left_a[k][s : s + 512, None] * left_b[k][None, :] >= at_least - _EPS
            if k == d:
                hits = alive
                near = np.nonzero(alive & (sums < at_least + _EPS))
                hits[near] = cosines(raw_a[s + near[0]], raw_b[near[1]]) >= at_least if len(near[0]) else False
                break
            i, j = np.nonzero(alive)
            if len(i) < 0.02 * alive.size:
                hits = np.zeros(alive.shape, bool)
                for c in range(0, len(i), 20_000):
                    p, q = i[c : c + 20_000], j[c : c + 20_000]
                    hits[p, q] = cosines(raw_a[s + p], raw_b[q]) >= at_least
                break
        yield s, hits  # type: ignore[misc]


def near_copies(vectors: DataFrame, at_least: float) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept; linked: cosine at_least or more, whatever the labels."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    classes = saved(v.where(_VALID).groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m")).withColumn("dim", F.size("embedding")), "vectors")
    near = v.sparkSession.createDataFrame([], "rep long, low long, degree long")
    for dim, n in classes.groupBy("dim").count().collect():  # a row for each length of vector
        near = near.union(_tiles(classes.where(F.col("dim") == dim), n, at_least))
    found = saved(near, "near")
    edges = components(found.select(F.col("rep").alias("a"), F.col("low").alias("b")))
    degree = found.groupBy("rep").agg(F.sum("degree").alias("degree"))
    named = classes.select("embedding", "rep", "m").join(degree, "rep", "left").join(edges, classes["rep"] == edges["node"], "left").select(
        "embedding", (F.col("m") - 1 + F.coalesce("degree", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")
    )
    named = saved(named, "named")
    ok = v.withColumn("key", F.when(F.expr(_VALID), F.col("embedding")))
    return ok.join(named, ok["key"] == named["embedding"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(False)).alias("kept"),
    )


def _tiles(classes: DataFrame, n: int, at_least: float) -> DataFrame:
    """rep, low (a class linked in this pair of tiles), degree (links there) of the classes that have links."""
    axes = principal(classes)
    reach = float(np.sqrt(max(0.0, 2 - 2 * at_least))) + 1e-6

    def led(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u = unit(matrix(b.column("embedding"))) if b.num_rows else np.zeros((0, len(axes)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(u @ axes[:, 0])], names=[*b.schema.names, "lead"])

    rows = saved(classes.select("rep", "m", "embedding").mapInArrow(led, T.StructType.fromDDL("rep long, m long, embedding array<double>, lead double")), "led")
    k = -(-n // TILE)
    inner = rows.approxQuantile("lead", [i / k for i in range(1, k)], 0.2 / k) if k > 1 else []
    low, high = np.r_[-np.inf, inner], np.r_[inner, np.inf]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each pair of tiles, of which one is its own, that can hold links along the first axis."""
        for b in batches:
            tile = np.searchsorted(np.array(inner), b.column("lead").to_numpy(), "right") if len(inner) else np.zeros(b.num_rows, int)
            for i in np.unique(tile):
                own = b.filter(pa.array(tile == i)).select(["rep", "m", "embedding"])
                for j in range(k):
                    gap = low[max(i, j)] - high[min(i, j)] if i != j else 0.0
                    if gap <= reach:
                        yield pa.RecordBatch.from_arrays([*[pa.array(np.full(own.num_rows, x, np.int32)) for x in (min(i, j), max(i, j), i)], *own.columns], names=["i", "j", "tile", "rep", "m", "embedding"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _grouped(batches, 2):
            t = t.combine_chunks()
            i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
            tile, raw = t.column("tile").to_numpy(), matrix(t.column("embedding").chunk(0))
            rep, m = t.column("rep").to_numpy(), t.column("m").to_numpy()
            x = unit(raw) @ axes
            at_a, at_b = np.flatnonzero(tile == i), np.flatnonzero(tile == j)
            degree, root = np.zeros(len(rep), np.int64), np.arange(len(rep))
            for s, hits in tile_hits(x[at_a], x[at_b], at_least, raw[at_a], raw[at_b]):
                if i == j:
                    hits[np.arange(len(hits)), s + np.arange(len(hits))] = False
                rows_ = np.flatnonzero(hits.any(1))
                for r in rows_:
                    own, other = at_a[s + r], at_b[hits[r]]
                    degree[own] += m[other].sum()
                    if i != j:
                        degree[other] += m[own]
                    met = np.unique(np.r_[root[other], root[own]])
                    if len(met) > 1:
                        root[np.isin(root, met)] = met[0]
            use = np.flatnonzero(degree)
            yield pa.RecordBatch.from_arrays([pa.array(rep[use]), pa.array(rep[root[use]]), pa.array(degree[use])], names=["rep", "low", "degree"])

    pairs = rows.mapInArrow(spread, T.StructType.fromDDL("i int, j int, tile int, rep long, m long, embedding array<double>"))
    return pairs.repartition("i", "j").sortWithinPartitions("i", "j").mapInArrow(compared, T.StructType.fromDDL("rep long, low long, degree long"))


def op4_pca_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "embeddings"), 0.95)


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
c AS (SELECT a, min(b) AS low FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(vec_id, coalesce(c.low, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(c.low, vec_id)) AS kept
FROM embeddings LEFT JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""
