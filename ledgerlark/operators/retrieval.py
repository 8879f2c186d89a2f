"""Ranked retrieval: BM25, dense cosine, reciprocal rank fusion, reranking, planned merges, retrieval metrics.

A stated set of queries goes to every task, which meets the corpus in blocks; rank windows are per query and see the
best of each task alone.  Corpus statistics are grouped with map-side combining.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..sources.shared import small_batches

K1, B, FLOOR = 1.5, 0.75, 0.25
#: The constant of reciprocal rank fusion, the places by which scores rank, and the candidates fused for each result asked for.
RRF_K, PLACES, POOL = 60, 9, 5


#: Rows that a task scores at once, and queries that meet them at once.
BLOCK, QUERIES_AT_ONCE = 64, 512


def query_terms(queries: DataFrame, id_col: str, text_col: str, most: int | None) -> DataFrame:
    """(query_id, term, n): the first tokens of each query, all if most is None, repeated terms counted."""
    words = tokens(F.col(text_col))
    return queries.select(F.col(id_col).alias("query_id"), F.explode(words if most is None else F.slice(words, 1, most)).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("n"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


class _Best:
    """The k best (score, doc) of each query that a task has seen, ties by the smaller doc."""

    def __init__(self, queries: int, k: int):
        self.k, self.floor = k, np.full(queries, -np.inf)
        self.rows: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def add(self, first: int, scores: np.ndarray, docs: np.ndarray) -> None:
        """scores: a row for each of docs, a column for each query from first on; -inf: no hit."""
        most = scores.max(0)
        for c in np.flatnonzero((most > -np.inf) & (most >= self.floor[first : first + scores.shape[1]])):
            q = first + int(c)
            at = np.flatnonzero((scores[:, c] > -np.inf) & (scores[:, c] >= self.floor[q]))
            old = self.rows.get(q, (np.zeros(0), np.zeros(0, np.int64)))
            s, d = np.r_[old[0], scores[at, c]], np.r_[old[1], docs[at]]
            order = np.lexsort((d, -s))[: self.k]
            self.rows[q] = s[order], d[order]
            if len(order) == self.k:
                self.floor[q] = s[order[-1]]

    def batches(self, ids: list) -> Iterator[pa.RecordBatch]:
        for q, (s, d) in self.rows.items():
            yield pa.RecordBatch.from_arrays([pa.array([ids[q]] * len(s), pa.int64()), pa.array(d, pa.int64()), pa.array(s, pa.float64())], names=["query_id", "doc", "score"])


_SCORED = "query_id long, doc long, score double"
#: What goes to every task at once: rows of terms, numbers of vectors, letters of passages.  More queries go in several passes.
TERMS, NUMBERS, LETTERS = 1 << 19, 1 << 22, 1 << 25


def _passes(queries: DataFrame, size: Column, most: int) -> list[DataFrame]:
    """The queries (with query_id) in parts of about `most` in size, told apart by a hash."""
    n = -(-(queries.agg(F.sum(size)).first()[0] or 0) // most)
    return [queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i) for i in range(n)] if n > 1 else [queries]


class _Filters:
    """The distinct filters of a set of queries: of each field the values that a row may have, or none if it may have any."""

    def __init__(self, filters: DataFrame | None, wanted: set):
        rows = [] if filters is None else [r for r in filters.collect() if r.query_id in wanted]
        self.fields = [] if filters is None else [c for c in filters.columns if c != "query_id"]
        keys = {r.query_id: tuple(None if r[c] is None else tuple(sorted(x for x in set(r[c]) if x is not None)) for c in self.fields) for r in rows}
        self.distinct = sorted(set(keys.values()) | ({(None,) * len(self.fields)} if set(keys) < wanted else set()), key=repr)
        number = {f: i for i, f in enumerate(self.distinct)}
        self.of = {q: number[keys.get(q, (None,) * len(self.fields))] for q in wanted}
        self.values = [sorted({x for f in self.distinct for x in f[i] or ()}) for i in range(len(self.fields))]
        # a row for each value and one, the last, for all others: which filters take it
        self.takes = [np.array([[f[i] is None or v in f[i] for f in self.distinct] for v in [*own, None]]) for i, own in enumerate(self.values)]

    def allowed(self, b: pa.RecordBatch) -> np.ndarray | None:
        """For each row of a batch, which filters take it; None: all do."""
        out = None
        for name, own, takes in zip(self.fields, self.values, self.takes, strict=True):
            column = b.column(name)
            at = pc.fill_null(pc.index_in(column, value_set=pa.array(own, column.type)), -1).to_numpy(zero_copy_only=False)
            out = takes[at] if out is None else out & takes[at]
        return out

    def counts(self, stats: DataFrame) -> DataFrame:
        """(filter, term, docs, words) from statistics(): an equality join for each set of fields that filters fix."""
        kinds = dict(stats.dtypes)
        parts = []
        for fixed in sorted({tuple(x is not None for x in f) for f in self.distinct}):
            names = [c for c, use in zip(self.fields, fixed, strict=True) if use]
            own = [(i, *[list(x) for x in f if x is not None]) for i, f in enumerate(self.distinct) if tuple(x is not None for x in f) == fixed]
            of = stats.groupBy(*names, "term").agg(F.sum("docs").alias("docs"), F.sum("words").alias("words"))
            if not names:  # one filter alone fixes nothing
                parts.append(of.select(F.lit(own[0][0]).alias("filter"), "term", "docs", "words"))
                continue
            small = stats.sparkSession.createDataFrame(own, ", ".join(["filter int", *[f"`{c}` array<{kinds[c]}>" for c in names]]))
            for c in names:
                small = small.withColumn(c, F.explode(c))
            parts.append(of.join(small, names).groupBy("filter", "term").agg(F.sum("docs").alias("docs"), F.sum("words").alias("words")))
        return reduce(DataFrame.union, parts)


def statistics(corpus: DataFrame, text_col: str, fields: tuple[str, ...] = ()) -> DataFrame:
    """fields, term, docs, words: for each combination of the fields' values the documents that hold a term, and at term null
    all its documents and their words.  One pass; everything that BM25 needs of any filter on these fields adds up from it."""
    t = corpus.select(*fields, tokens(F.col(text_col)).alias("t"))
    every = F.array_union(F.array(F.lit(None).cast("string")), "t")  # also makes terms distinct
    return t.select(*fields, F.size("t").alias("size"), F.explode(every).alias("term")).groupBy(*fields, "term").agg(F.count("*").alias("docs"), F.sum(F.when(F.col("term").isNull(), F.col("size"))).alias("words"))


def bm25_top(corpus: DataFrame, id_col: str, text_col: str, terms: DataFrame, k: int, filters: DataFrame | None = None) -> DataFrame:
    """The k best of each query by Okapi BM25, scores above zero, with rank, for many and long queries.

    idf = ln((N - df + .5) / (df + .5)); a negative one becomes FLOOR times the mean idf of the vocabulary.  filters (query_id, and for fields of
    the corpus an array of the values allowed, null: any): a query sees only the rows that its filter takes, and N, df, mean length and
    vocabulary are those of these rows; statistics of all filters come from one pass over the corpus, and all queries are scored in another.

    The queries' terms go to every task, TERMS rows at once, which scores its documents in blocks and hands on its k best of each query, so no
    row for each query and document is made.  Scores rank by PLACES places, so that copies of a text tie whatever the order of
    summing.  Rows without an id are in the statistics and never hits.
    """
    small_batches(corpus.sparkSession)
    fields = [] if filters is None else [c for c in filters.columns if c != "query_id"]
    lists = corpus.select(F.col(id_col).cast("long").alias("doc"), tokens(F.col(text_col)).alias("t"), *fields)
    stats = statistics(corpus, text_col, tuple(fields)).persist()
    found = [_bm25_pass(lists, stats, part.collect(), k, filters) for part in _passes(terms, F.lit(1), TERMS)]
    stats.unpersist()
    return top(reduce(DataFrame.union, found), k)


def _bm25_pass(lists: DataFrame, stats: DataFrame, terms: list, k: int, filters: DataFrame | None) -> DataFrame:
    spark = lists.sparkSession
    if not terms:
        return spark.createDataFrame([], _SCORED)
    own = _Filters(filters, {r.query_id for r in terms})
    asked = spark.createDataFrame(sorted({(own.of[r.query_id], r.term) for r in terms}), "filter int, term string").withColumn("asked", F.lit(True))
    by = own.counts(stats)
    whole = by.where("term is null").select("filter", F.col("docs").alias("all"), (F.col("words") / F.col("docs")).alias("mean_words"))  # a row for each filter
    raw = by.where("term is not null").join(F.broadcast(whole), "filter").join(asked, ["filter", "term"], "left").withColumn("raw", F.log((F.col("all") - F.col("docs") + 0.5) / (F.col("docs") + 0.5)))
    idf, mean = {}, {}
    for r in raw.groupBy("filter").agg(F.avg("raw").alias("raw"), F.max("mean_words").alias("mean_words"), F.collect_list(F.when(F.col("asked"), F.struct("term", "raw"))).alias("terms")).collect():
        mean[r["filter"]] = r.mean_words
        idf.update({(r["filter"], t.term): FLOOR * r.raw if t.raw < 0 else t.raw for t in r.terms})
    rows = sorted((r.term, r.query_id, r.n * idf[own.of[r.query_id], r.term]) for r in terms if (own.of[r.query_id], r.term) in idf)
    if not rows:
        return spark.createDataFrame([], _SCORED)
    ids, vocabulary = sorted({r[1] for r in rows}), sorted({r[0] for r in rows})
    number = {q: i for i, q in enumerate(ids)}
    start = np.searchsorted([r[0] for r in rows], vocabulary + ["\U0010ffff"])
    filter_of = np.array([own.of[q] for q in ids])
    shared = spark.sparkContext.broadcast((vocabulary, start, np.array([number[r[1]] for r in rows]), np.array([r[2] for r in rows]), np.array([mean[f] for f in filter_of.tolist()]), own))
    n = len(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, start, query, weight, mean_words, own = shared.value
        words, best = pa.array(words, pa.string()), _Best(n, k)
        for whole in batches:
            for s in range(0, whole.num_rows, BLOCK):
                b = whole.slice(s, BLOCK)
                size = pc.list_value_length(b.column("t")).to_numpy(zero_copy_only=False).astype(np.int64)
                at = pc.fill_null(pc.index_in(b.column("t").flatten().cast(pa.string()), value_set=words), -1).to_numpy(zero_copy_only=False)
                key = (np.repeat(np.arange(len(size)), size) * len(words) + at)[at >= 0]
                key, tf = np.unique(key, return_counts=True)
                row, term = key // len(words), key % len(words)
                many = start[term + 1] - start[term]
                each = np.repeat(np.arange(len(key)), many)
                use = np.arange(len(each)) - np.repeat(np.cumsum(many) - many, many) + start[term][each]
                part = tf[each] * (K1 + 1) / (tf[each] + K1 * (1 - B + B * size[row][each] / mean_words[query[use]]))
                scores = np.bincount(row[each] * n + query[use], part * weight[use], len(size) * n).reshape(-1, n)
                scores = np.where(scores > 0, np.round(scores, PLACES), -np.inf)
                takes = own.allowed(b)
                best.add(0, scores if takes is None else np.where(takes[:, filter_of], scores, -np.inf), b.column("doc").to_numpy(zero_copy_only=False))
        yield from best.batches(ids)

    return lists.where("doc is not null").mapInArrow(run, _SCORED)


def dense_top(vectors: DataFrame, id_col: str, vector_col: str, queries: DataFrame, k: int, filters: DataFrame | None = None, own_ids: bool = True) -> DataFrame:
    """The k best of each query by cosine, with rank, for many queries (query_id, vector); filters as in bm25_top().
    own_ids: queries are named by ids of the vectors, and a vector is not its own neighbour.

    The queries go to every task, NUMBERS of their components at once, which meets its vectors in blocks and hands on its k best of each.
    Scores rank by PLACES places.  Vectors of another length, without direction or with nulls have no score.
    """
    known = queries.where("query_id is not null and vector is not null and not exists(vector, x -> x is null)")
    found = [_dense_pass(vectors, id_col, vector_col, part.select("query_id", "vector").collect(), k, filters, own_ids) for part in _passes(known, F.size("vector"), NUMBERS)]
    return top(reduce(DataFrame.union, found), k)


def _dense_pass(vectors: DataFrame, id_col: str, vector_col: str, rows: list, k: int, filters: DataFrame | None, own_ids: bool) -> DataFrame:
    spark = vectors.sparkSession
    asked = sorted(((r.query_id, v) for r in rows if len(v := np.array(r.vector, float)) and np.isfinite(v).all() and v.any()), key=lambda x: x[0])
    if not asked:
        return spark.createDataFrame([], _SCORED)
    if len({len(v) for _, v in asked}) > 1:
        raise ValueError("query vectors of different lengths")
    ids, dim = [i for i, _ in asked], len(asked[0][1])
    own = _Filters(filters, set(ids))
    filter_of = np.array([own.of[q] for q in ids])
    shared = spark.sparkContext.broadcast((np.array([v / np.sqrt(v @ v) for _, v in asked]), own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, all_ids, (asked_vectors, own) = _Best(len(ids), k), np.array(ids), shared.value
        for whole in batches:
            for s in range(0, whole.num_rows, 8 * BLOCK):
                b = whole.slice(s, 8 * BLOCK)
                v = b.column("v").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
                ok = np.isfinite(v).all(1) & v.any(1)
                v, docs, takes = v[ok], b.column("doc").to_numpy(zero_copy_only=False)[ok], own.allowed(b)
                if not len(v):
                    continue
                v = v / np.sqrt((v * v).sum(1))[:, None]
                for first in range(0, len(ids), QUERIES_AT_ONCE):
                    q = slice(first, first + QUERIES_AT_ONCE)
                    no = (docs[:, None] == all_ids[q]) & own_ids
                    if takes is not None:
                        no |= ~takes[ok][:, filter_of[q]]
                    best.add(first, np.where(no, -np.inf, np.round(v @ asked_vectors[q].T, PLACES)), docs)
        yield from best.batches(ids)

    v = vectors.select(F.col(id_col).cast("long").alias("doc"), F.col(vector_col).alias("v"), *own.fields).where(f"doc is not null and size(v) = {dim} and not exists(v, x -> x is null)")
    return v.mapInArrow(run, _SCORED)


def top(scored: DataFrame, k: int, name: str = "rank") -> DataFrame:
    """The k best of each query, ties by the smaller document."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc")
    return scored.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def fuse(semantic: DataFrame, keyword: DataFrame, k: int, semantic_weight: float = 1.0, keyword_weight: float = 1.0) -> DataFrame:
    """Reciprocal rank fusion of two ranked legs; either rank may be null.  Ties: first seen, semantic first."""
    s = semantic.select("query_id", "doc", F.col("rank").alias("semantic_rank"))
    w = keyword.select("query_id", "doc", F.col("rank").alias("keyword_rank"))
    both = s.join(w, ["query_id", "doc"], "full_outer")
    score = F.coalesce(semantic_weight / (RRF_K + F.col("semantic_rank")), F.lit(0.0)) + F.coalesce(keyword_weight / (RRF_K + F.col("keyword_rank")), F.lit(0.0))
    found = F.when(F.col("keyword_rank").isNull(), "semantic").when(F.col("semantic_rank").isNull(), "keyword").otherwise("both")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.coalesce("semantic_rank", F.lit(10**9) + F.col("keyword_rank")), "doc")
    return both.select("query_id", "doc", "semantic_rank", "keyword_rank", score.alias("score"), found.alias("found_by")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def pool_size(k: int, reranked: bool = False) -> int:
    """Candidates of each leg for k results; a hundred at least where they are reranked."""
    return max(k * POOL, k, 100 if reranked else 0)


def hybrid(corpus: DataFrame, id_col: str, text_col: str, terms: DataFrame, vectors: DataFrame, vec_col: str, vector_col: str, queries: DataFrame, k: int, condition: Column | None = None, semantic_weight: float = 1.0, keyword_weight: float = 1.0) -> DataFrame:
    """Both legs over the same candidates, fused.  condition, on corpus, decides what is a candidate, and statistics are those of the candidates."""
    c = corpus if condition is None else corpus.where(condition)
    v = vectors if condition is None else vectors.join(c.select(F.col(id_col).alias(vec_col)), vec_col, "left_semi")
    n = pool_size(k)
    return fuse(dense_top(v, vec_col, vector_col, queries, n), bm25_top(c, id_col, text_col, terms, n), k, semantic_weight, keyword_weight)


def arms(semantic: DataFrame, keyword: DataFrame, k: int) -> DataFrame:
    """The three ways of one pass (arm): each leg's k best, and both fused."""
    own = lambda leg, name: leg.where(F.col("rank") <= k).select(F.lit(name).alias("arm"), "query_id", "doc", "rank")
    return own(semantic, "semantic").unionByName(own(keyword, "keyword")).unionByName(own(fuse(semantic, keyword, k), "hybrid"))


def reranked(fused: DataFrame, scores: DataFrame, k: int) -> DataFrame:
    """fused (query_id, doc, rank) in the order of another model's scores (query_id, doc, score), ties by the fused rank, which is kept."""
    w = Window.partitionBy("query_id").orderBy(F.desc(F.coalesce("rerank_score", F.lit(0.0))), "fused_rank")
    r = fused.withColumnRenamed("rank", "fused_rank").drop("score").join(scores.withColumnRenamed("score", "rerank_score"), ["query_id", "doc"], "left")
    return r.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def swept(semantic: DataFrame, keyword: DataFrame, weights: list[float], k: int) -> DataFrame:
    """Both legs fused at each weight of the semantic one; the legs are joined once."""
    s = semantic.select("query_id", "doc", F.col("rank").alias("semantic_rank"))
    both = s.join(keyword.select("query_id", "doc", F.col("rank").alias("keyword_rank")), ["query_id", "doc"], "full_outer").withColumn("weight", F.explode(F.array(*[F.lit(w) for w in weights])))
    score = F.coalesce(F.col("weight") / (RRF_K + F.col("semantic_rank")), F.lit(0.0)) + F.coalesce(1.0 / (RRF_K + F.col("keyword_rank")), F.lit(0.0))
    order = Window.partitionBy("weight", "query_id").orderBy(F.desc("score"), F.coalesce("semantic_rank", F.lit(10**9) + F.col("keyword_rank")), "doc")
    return both.withColumn("score", score).where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def holders(corpus: DataFrame, id_col: str, text_col: str, passages: DataFrame) -> DataFrame:
    """(query_id, doc): the documents that hold a passage (query_id, passage) of a stated set word for word.

    Every text is read once against LETTERS of the passages by an automaton that each task builds from them."""
    small_batches(corpus.sparkSession)
    parts = _passes(passages.where("length(passage) > 0"), F.length("passage"), LETTERS)
    return reduce(DataFrame.union, [_holders_pass(corpus, id_col, text_col, p.select("query_id", "passage").collect()) for p in parts])


def _holders_pass(corpus: DataFrame, id_col: str, text_col: str, passages: list) -> DataFrame:
    import ahocorasick

    stated: dict[str, list] = {}
    for r in passages:
        stated.setdefault(r.passage, []).append(r.query_id)
    if not stated:
        return corpus.sparkSession.createDataFrame([], "query_id long, doc long")
    shared = corpus.sparkSession.sparkContext.broadcast(stated)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = ahocorasick.Automaton()
        for p, ids in shared.value.items():
            a.add_word(p, ids)
        a.make_automaton()
        for b in batches:
            hits = [(q, d) for d, t in zip(*(c.to_pylist() for c in b.columns), strict=True) for q in sorted({q for _, ids in a.iter(t) for q in ids})]
            yield pa.RecordBatch.from_arrays([pa.array([h[k] for h in hits], pa.int64()) for k in (0, 1)], names=["query_id", "doc"])

    return corpus.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "query_id long, doc long")


def both_legs(corpus: DataFrame, id_col: str, text_col: str, vectors: DataFrame, vec_col: str, vector_col: str, asked: DataFrame, k: int, fields: list[str]) -> DataFrame:
    """asked (query_id, search_text, vector, fields): both legs over what each query's own filter takes, fused.  A null vector: the keyword leg alone."""
    filters = asked.select("query_id", *fields) if fields else None
    v = vectors.select(vec_col, vector_col).join(corpus.select(F.col(id_col).alias(vec_col), *fields), vec_col)
    n = pool_size(k)
    semantic = dense_top(v, vec_col, vector_col, asked.select("query_id", "vector"), n, filters, own_ids=False)
    keyword = bm25_top(corpus, id_col, text_col, query_terms(asked, "query_id", "search_text", None), n, filters)
    return fuse(semantic, keyword, k)


#: Sub-questions of a question, at most, so that both make one number.
_SUBS = 1 << 16


def planned(corpus: DataFrame, id_col: str, text_col: str, vectors: DataFrame, vec_col: str, vector_col: str, asked: DataFrame, k: int, fields: list[str], kept: tuple[str, ...] = (), rounds: int = 1) -> DataFrame:
    """Retrieval for many questions at once, each taken apart: (question, sub, doc, rank, found_by, round, position).

    asked: question (long), sub (from 0), search_text, vector, and an array of the values allowed (null: any) for each of fields; metric and
    metric_vector where further rounds are asked for.  Each sub-question gets k results under its own filter; position is the place among the k
    of its question, taken in turn, each document once (null: not among them).  What finds nothing is asked for again in a further round by
    its metric alone, with the filters on `kept` fields only; what that finds stands behind, in order of sub-question and rank."""
    number = (F.col("question") * _SUBS + F.col("sub")).alias("query_id")
    named = lambda found: found.select(F.floor(F.col("query_id") / _SUBS).cast("long").alias("question"), F.pmod("query_id", F.lit(_SUBS)).cast("int").alias("sub"), "doc", "rank", "found_by")
    own = named(both_legs(corpus, id_col, text_col, vectors, vec_col, vector_col, asked.select(number, "search_text", "vector", *fields), k, fields)).persist()
    places = round_robin(own.select("question", "sub", "doc", "rank"), k).select("question", "sub", "doc", "position")
    out = own.join(places, ["question", "sub", "doc"], "left").select("question", "sub", "doc", "rank", "found_by", F.lit(1).alias("round"), "position")
    if rounds < 2:
        return out
    missed = asked.join(own, ["question", "sub"], "left_anti").select(number, F.col("metric").alias("search_text"), F.col("metric_vector").alias("vector"), *kept).persist()
    more = named(both_legs(corpus, id_col, text_col, vectors, vec_col, vector_col, missed, k, list(kept)))
    seen = places.groupBy("question").agg(F.max("position").alias("last"))
    first = Window.partitionBy("question", "doc").orderBy("sub", "rank")
    once = more.join(places, ["question", "doc"], "left_anti").withColumn("i", F.row_number().over(first)).where("i = 1").drop("i")
    once = once.join(seen, "question", "left").withColumn("position", F.coalesce("last", F.lit(0)) + F.row_number().over(Window.partitionBy("question").orderBy("sub", "rank")))
    return out.unionByName(once.select("question", "sub", "doc", "rank", "found_by", F.lit(2).alias("round"), "position"))


def round_robin(ranked: DataFrame, k: int) -> DataFrame:
    """ranked: question, sub (position), doc, rank.  Each document once, by rank, then sub-question; k of each question."""
    first = Window.partitionBy("question", "doc").orderBy("rank", "sub")
    order = Window.partitionBy("question").orderBy("rank", "sub")
    once = ranked.withColumn("i", F.row_number().over(first)).where("i = 1").drop("i")
    return once.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k)


def hits(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """ranked (query_id, doc, rank) with gold groups (query_id, group_id, doc): the first rank of each group."""
    return gold.join(ranked, ["query_id", "doc"], "left").groupBy("query_id", "group_id").agg(F.min("rank").alias("first_rank"))


def retrieval_scores(ranked: DataFrame, gold: DataFrame, ks: list[int]) -> DataFrame:
    """Per query and k: recall of groups, precision over what was returned, reciprocal rank, all found."""
    grid = ranked.sparkSession.createDataFrame([(k,) for k in ks], "k int")
    groups = hits(ranked, gold).crossJoin(F.broadcast(grid)).groupBy("query_id", "k").agg(
        F.avg((F.coalesce(F.col("first_rank") <= F.col("k"), F.lit(False))).cast("double")).alias("recall"),
        F.coalesce(1 / F.min(F.when(F.col("first_rank") <= F.col("k"), F.col("first_rank"))), F.lit(0.0)).alias("rr"),
        F.bool_and(F.coalesce(F.col("first_rank") <= F.col("k"), F.lit(False))).alias("all_found"),
    )
    good = gold.select("query_id", "doc").distinct().withColumn("good", F.lit(1))
    returned = ranked.join(good, ["query_id", "doc"], "left").crossJoin(F.broadcast(grid)).where("rank <= k").groupBy("query_id", "k").agg((F.sum(F.coalesce("good", F.lit(0))) / F.count("*")).alias("precision"))
    return groups.join(returned, ["query_id", "k"], "left").fillna(0.0, ["precision"])


def recall_at(first_ranks: DataFrame, k: int) -> DataFrame:
    """The share of groups whose first rank is k or better; groups never found count as missed."""
    return first_ranks.agg(F.avg(F.coalesce(F.col("first_rank") <= k, F.lit(False)).cast("double")).alias("recall"))


# The upper ends of the bands of ranks.
BANDS = (10, 20, 70, 300)


def band(rank: Column) -> Column:
    """The band of a rank, by its upper end; beyond all, and for ranks not found, a million."""
    out = F.lit(10**6)
    for n in reversed(BANDS):
        out = F.when(rank <= n, n).otherwise(out)
    return out


def rank_bands(first_ranks: DataFrame) -> DataFrame:
    """How many groups fall in each band of first ranks, and the share up to it."""
    n = first_ranks.groupBy(band(F.col("first_rank")).alias("upto")).agg(F.count("*").alias("n"))
    w = Window.orderBy("upto")  # five rows
    return n.withColumn("share", F.sum("n").over(w) / F.sum("n").over(Window.partitionBy()))
