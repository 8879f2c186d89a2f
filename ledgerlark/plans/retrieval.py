"""Retrieval queries: every benchmark item with its whole text, and the vector of every item's id, against all documents and vectors.

Convention of ours: vec_id of a vector is the doc_id of its document.  Scores rank by nine places, in the SQL too, so that copies tie.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import incremental, inverted
from ..operators import index as I
from ..operators import retrieval as R
from ..sources.shared import scratch
from .base import query, rounded, table

_TOKENS = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9][a-z0-9.,''-]*')"


def _bm25(where: str = "") -> str:
    return f"""
q AS (SELECT item_id AS query_id, term, count(*) AS n FROM (SELECT item_id, unnest({_TOKENS}) AS term FROM benchmark) GROUP BY ALL),
d AS (SELECT doc_id AS doc, {_TOKENS} AS t FROM documents {where}),
tf AS (SELECT doc, len(t) AS len, term, count(*) AS tf FROM (SELECT doc, t, unnest(t) AS term FROM d) GROUP BY ALL),
st AS (SELECT count(*) AS docs, avg(len(t)) AS avgdl FROM d),
df AS (SELECT term, count(*) AS df, ln((any_value(docs) - count(*) + 0.5) / (count(*) + 0.5)) AS raw, any_value(avgdl) AS avgdl FROM tf, st GROUP BY term),
idf AS (SELECT term, avgdl, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM df) ELSE raw END AS idf FROM df),
bm AS (SELECT query_id, doc, round(sum(n * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avgdl))), 9) AS score FROM tf JOIN q USING (term) JOIN idf USING (term) GROUP BY ALL HAVING sum(n * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avgdl))) > 0)"""


def _dense(where: str = "") -> str:
    return f"""
dn AS (SELECT q.vec_id AS query_id, e.vec_id AS doc, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS score FROM embeddings e, embeddings q WHERE q.vec_id IN (SELECT item_id FROM benchmark) AND e.vec_id <> q.vec_id {where})"""


def _ranked(source: str, k: int, name: str = "rank") -> str:
    return f"SELECT query_id, doc, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS {name} FROM {source} QUALIFY {name} <= {k}"


def _keyword(spark: SparkSession, sf_dir: str, k: int, where: str = "true") -> DataFrame:
    terms = R.query_terms(table(spark, sf_dir, "benchmark"), "item_id", "text", None)
    return R.bm25_top(table(spark, sf_dir, "documents").where(where), "doc_id", "text", terms, k)


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "embeddings").join(table(spark, sf_dir, "benchmark"), F.col("vec_id") == F.col("item_id"), "left_semi")
    return asked.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def _nearest(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return R.dense_top(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", _asked(spark, sf_dir), k)


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"))
    return R.holders(table(spark, sf_dir, "documents"), "doc_id", "text", b).withColumn("group_id", F.col("doc"))


@query(f"WITH {_bm25()} SELECT query_id, doc, round(score, 6) AS score, rank FROM ({_ranked('bm', 10)})")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each benchmark passage."""
    return _keyword(spark, sf_dir, 10).select("query_id", "doc", rounded("score", "score"), "rank")


@query(f"WITH {_dense()} SELECT query_id, doc, round(score, 6) AS score, rank FROM ({_ranked('dn', 10)})")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of each benchmark item's vector."""
    return _nearest(spark, sf_dir, 10).select("query_id", "doc", rounded("score", "score"), "rank")


def _legs(k: int, where: str = "", vectors: str = "") -> str:
    return f"""{_bm25(where)}, {_dense(vectors)}, s AS ({_ranked('dn', k, 'semantic_rank')}), k AS ({_ranked('bm', k, 'keyword_rank')}),
b AS (SELECT query_id, doc, semantic_rank, keyword_rank FROM s FULL JOIN k USING (query_id, doc))"""


_ORDER = "score DESC, coalesce(semantic_rank, 1000000000 + keyword_rank), doc"
_FUSED = f"""f AS (SELECT *, coalesce(1.0::DOUBLE / (60 + semantic_rank), 0) + coalesce(1.0::DOUBLE / (60 + keyword_rank), 0) AS score FROM b),
h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {_ORDER}) AS rank FROM f QUALIFY rank <= 10)"""
_FOUND = "CASE WHEN keyword_rank IS NULL THEN 'semantic' WHEN semantic_rank IS NULL THEN 'keyword' ELSE 'both' END AS found_by"


@query(f"WITH {_legs(50)}, {_FUSED} SELECT query_id, doc, semantic_rank, keyword_rank, round(score, 8) AS score, {_FOUND}, rank FROM h")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reciprocal rank fusion of both legs, fifty candidates each."""
    f = R.fuse(_nearest(spark, sf_dir, 50), _keyword(spark, sf_dir, 50), 10)
    return f.select("query_id", "doc", "semantic_rank", "keyword_rank", rounded("score", "score", 8), "found_by", "rank")


@query(f"""WITH {_legs(50, "WHERE lang = 'en' AND source IN (SELECT min(source) FROM documents UNION SELECT max(source) FROM documents)", "AND e.vec_id IN (SELECT doc_id FROM documents WHERE lang = 'en' AND source IN (SELECT min(source) FROM documents UNION SELECT max(source) FROM documents))")}, {_FUSED}
SELECT query_id, doc, semantic_rank, keyword_rank, round(score, 8) AS score, {_FOUND}, rank FROM h""")
def hybrid_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both legs over the English documents of two sources alone: statistics and candidates are those of the filter."""
    d, e = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    ends = d.agg(F.min("source").alias("a"), F.max("source").alias("z")).first()
    terms = R.query_terms(table(spark, sf_dir, "benchmark"), "item_id", "text", None)
    f = R.hybrid(d, "doc_id", "text", terms, e, "vec_id", "embedding", _asked(spark, sf_dir), 10, I.matches(lang="en", source=[ends.a, ends.z], page=None))
    return f.select("query_id", "doc", "semantic_rank", "keyword_rank", rounded("score", "score", 8), "found_by", "rank")


@query(f"""WITH {_legs(50)}, {_FUSED} SELECT 'semantic' AS arm, query_id, doc, semantic_rank AS rank FROM s WHERE semantic_rank <= 10 UNION ALL SELECT 'keyword', query_id, doc, keyword_rank FROM k WHERE keyword_rank <= 10 UNION ALL SELECT 'hybrid', query_id, doc, rank FROM h""")
def retrieval_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each leg alone and both fused, from one pass."""
    return R.arms(_nearest(spark, sf_dir, 50), _keyword(spark, sf_dir, 50), 10)


@query(f"""WITH {_legs(50)}, {_FUSED} SELECT query_id, doc, rank AS fused_rank, round(n_chars / 10000.0::DOUBLE, 6) AS rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(n_chars, 0) DESC, rank) AS rank FROM h LEFT JOIN documents ON doc_id = doc""")
def rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fused ten in the order of another score, here the length of the document."""
    f = R.fuse(_nearest(spark, sf_dir, 50), _keyword(spark, sf_dir, 50), 10)
    scores = f.select("query_id", "doc").join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), (F.col("n_chars") / 10000).alias("score")), "doc")
    return R.reranked(f, scores, 10).select("query_id", "doc", "fused_rank", rounded("rerank_score", "rerank_score"), "rank")


_GOLD = "g AS (SELECT b.item_id AS query_id, d.doc_id AS doc FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
_WEIGHTS = (0.0, 0.25, 0.5, 0.75, 1.0, 1.5, 2.0)


@query(f"""WITH {_legs(50)}, {_GOLD}, w AS (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0, 1.5, 2.0]::DOUBLE[]) AS weight),
f AS (SELECT weight, b.*, coalesce(weight / (60 + semantic_rank), 0) + coalesce(1.0::DOUBLE / (60 + keyword_rank), 0) AS score FROM b, w),
r AS (SELECT *, row_number() OVER (PARTITION BY weight, query_id ORDER BY {_ORDER}) AS rank FROM f WHERE score > 0 QUALIFY rank <= 10),
h AS (SELECT w.weight, g.query_id, g.doc, min(r.rank) AS first FROM g CROSS JOIN w LEFT JOIN r ON r.weight = w.weight AND r.query_id = g.query_id AND r.doc = g.doc GROUP BY ALL),
q1 AS (SELECT weight, query_id, avg(coalesce(first <= 5, false)::INT) AS r5, avg((first IS NOT NULL)::INT) AS r10, coalesce(1.0::DOUBLE / min(first), 0) AS rr FROM h GROUP BY ALL)
SELECT weight, count(*) AS questions, round(avg(r5), 6) AS recall_at_5, round(avg(r10), 6) AS recall_at_10, round(avg(rr), 6) AS mrr FROM q1 GROUP BY weight""")
def weight_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall at 5 and 10 and mean reciprocal rank at seven weights of the semantic leg."""
    w = R.swept(_nearest(spark, sf_dir, 50), _keyword(spark, sf_dir, 50), list(_WEIGHTS), 10)
    g = _gold(spark, sf_dir).withColumn("weight", F.explode(F.array(*[F.lit(x) for x in _WEIGHTS])))
    first = g.join(w, ["weight", "query_id", "doc"], "left").groupBy("weight", "query_id", "group_id").agg(F.min("rank").alias("first"))
    found = lambda k: F.avg(F.coalesce(F.col("first") <= k, F.lit(False)).cast("double"))
    q = first.groupBy("weight", "query_id").agg(found(5).alias("r5"), found(10).alias("r10"), F.coalesce(1 / F.min("first"), F.lit(0.0)).alias("rr"))
    return q.groupBy("weight").agg(F.count("*").alias("questions"), rounded(F.avg("r5"), "recall_at_5"), rounded(F.avg("r10"), "recall_at_10"), rounded(F.avg("rr"), "mrr"))


_TEN = f"r AS ({_ranked('bm', 10)})"


@query(f"""WITH {_bm25()}, {_GOLD}, {_TEN},
h AS (SELECT g.query_id, g.doc AS group_id, min(r.rank) AS first_rank FROM g LEFT JOIN r ON r.query_id = g.query_id AND r.doc = g.doc GROUP BY ALL), k AS (SELECT unnest([1, 3, 5, 10]) AS k),
a AS (SELECT query_id, k, avg((coalesce(first_rank <= k, false))::DOUBLE) AS recall, coalesce(1.0::DOUBLE / min(first_rank) FILTER (first_rank <= k), 0) AS rr, bool_and(coalesce(first_rank <= k, false)) AS all_found FROM h, k GROUP BY ALL),
p AS (SELECT r.query_id, k, sum((g.doc IS NOT NULL)::INT)::DOUBLE / count(*) AS precision FROM r LEFT JOIN g ON g.query_id = r.query_id AND g.doc = r.doc, k WHERE rank <= k GROUP BY ALL)
SELECT a.query_id, a.k, round(recall, 6) AS recall, round(rr, 6) AS rr, all_found, round(coalesce(precision, 0), 6) AS precision FROM a LEFT JOIN p ON p.query_id = a.query_id AND p.k = a.k""")
def retrieval_metrics_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall, precision, reciprocal rank at k; gold: the documents that hold the benchmark passage."""
    s = R.retrieval_scores(_keyword(spark, sf_dir, 10), _gold(spark, sf_dir), [1, 3, 5, 10])
    return s.select("query_id", "k", rounded("recall", "recall"), rounded("rr", "rr"), "all_found", rounded("precision", "precision"))


@query(f"""WITH {_bm25()}, r AS (SELECT query_id // 3 AS question, query_id AS sub, doc, rank FROM ({_ranked('bm', 10)})),
o AS (SELECT *, row_number() OVER (PARTITION BY question, doc ORDER BY rank, sub) AS i FROM r QUALIFY i = 1)
SELECT question, sub, doc, row_number() OVER (PARTITION BY question ORDER BY rank, sub) AS position FROM o QUALIFY position <= 10""")
def planned_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of three items as sub-questions of one question, merged in turn, each document once."""
    r = _keyword(spark, sf_dir, 10).select(F.floor(F.col("query_id") / 3).alias("question"), F.col("query_id").alias("sub"), "doc", "rank")
    return R.round_robin(r, 10).select("question", "sub", "doc", "position")


@query(f"""WITH {_bm25()}, {_GOLD}, r AS ({_ranked('bm', 300)}),
h AS (SELECT g.query_id, g.doc, min(r.rank) AS first_rank FROM g LEFT JOIN r ON r.query_id = g.query_id AND r.doc = g.doc GROUP BY ALL),
n AS (SELECT CASE WHEN first_rank <= 10 THEN 10 WHEN first_rank <= 20 THEN 20 WHEN first_rank <= 70 THEN 70 WHEN first_rank <= 300 THEN 300 ELSE 1000000 END AS upto, count(*) AS n FROM h GROUP BY 1)
SELECT upto, n, round(sum(n) OVER (ORDER BY upto)::DOUBLE / sum(n) OVER (), 6) AS share FROM n""")
def rank_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In which band of ranks the gold documents first stand; ranks over 300 are one band."""
    return R.rank_bands(R.hits(_keyword(spark, sf_dir, 300), _gold(spark, sf_dir))).select("upto", "n", rounded("share", "share"))


_LANG, _SOURCE = "CASE WHEN question % 2 = 0 THEN lang END", "CASE WHEN question % 5 = 4 THEN 'nowhere' WHEN question % 3 = 0 THEN source END"


@query(f"""WITH asked AS (SELECT item_id AS query_id, item_id // 3 AS question, item_id % 3 AS sub, text FROM benchmark), fq AS (SELECT question, {_LANG} AS l, {_SOURCE} AS s FROM (SELECT DISTINCT question FROM asked) LEFT JOIN documents ON doc_id = question),
f AS (SELECT DISTINCT l, s FROM fq UNION SELECT NULL, NULL), d AS (SELECT l, s, doc_id AS doc, {_TOKENS} AS t FROM documents JOIN f ON (l IS NULL OR lang = l) AND (s IS NULL OR source = s)),
tf AS (SELECT l, s, doc, len(t) AS len, term, count(*) AS tf FROM (SELECT l, s, doc, t, unnest(t) AS term FROM d) GROUP BY ALL), st AS (SELECT l, s, count(*) AS docs, avg(len(t)) AS avgdl FROM d GROUP BY l, s),
df AS (SELECT tf.l, tf.s, term, ln((any_value(docs) - count(*) + 0.5) / (count(*) + 0.5)) AS raw, any_value(avgdl) AS avgdl FROM tf JOIN st ON tf.l IS NOT DISTINCT FROM st.l AND tf.s IS NOT DISTINCT FROM st.s GROUP BY ALL),
low AS (SELECT l, s, 0.25 * avg(raw) AS low FROM df GROUP BY l, s), idf AS (SELECT df.l, df.s, term, avgdl, CASE WHEN raw < 0 THEN low ELSE raw END AS idf FROM df JOIN low ON df.l IS NOT DISTINCT FROM low.l AND df.s IS NOT DISTINCT FROM low.s),
q0 AS (SELECT query_id, l, s, 1 AS round, text FROM asked JOIN fq USING (question) UNION ALL SELECT query_id, NULL, NULL, 2, text FROM asked),
q AS (SELECT query_id, round, l, s, term, count(*) AS n FROM (SELECT query_id, round, l, s, unnest({_TOKENS}) AS term FROM q0) GROUP BY ALL),
bm AS (SELECT query_id, round, doc, round(sum(n * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avgdl))), 9) AS score FROM q JOIN idf ON q.term = idf.term AND q.l IS NOT DISTINCT FROM idf.l AND q.s IS NOT DISTINCT FROM idf.s
  JOIN tf ON tf.term = q.term AND tf.l IS NOT DISTINCT FROM q.l AND tf.s IS NOT DISTINCT FROM q.s GROUP BY ALL HAVING sum(n * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avgdl))) > 0),
dn AS (SELECT query_id, round, e.vec_id AS doc, round(list_cosine_similarity(e.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) AS score FROM q0 JOIN embeddings v ON v.vec_id = query_id JOIN documents ON (l IS NULL OR lang = l) AND (s IS NULL OR source = s) JOIN embeddings e ON e.vec_id = doc_id),
sr AS (SELECT query_id, round, doc, row_number() OVER (PARTITION BY query_id, round ORDER BY score DESC, doc) AS semantic_rank FROM dn QUALIFY semantic_rank <= 50), kr AS (SELECT query_id, round, doc, row_number() OVER (PARTITION BY query_id, round ORDER BY score DESC, doc) AS keyword_rank FROM bm QUALIFY keyword_rank <= 50),
b AS (SELECT query_id, round, doc, semantic_rank, keyword_rank, coalesce(1.0::DOUBLE / (60 + semantic_rank), 0) + coalesce(1.0::DOUBLE / (60 + keyword_rank), 0) AS score FROM sr FULL JOIN kr USING (query_id, round, doc)),
h AS (SELECT query_id // 3 AS question, query_id % 3 AS sub, round, doc, {_FOUND}, row_number() OVER (PARTITION BY query_id, round ORDER BY {_ORDER}) AS rank FROM b QUALIFY rank <= 10),
one AS (SELECT *, row_number() OVER (PARTITION BY question, doc ORDER BY rank, sub) AS i FROM h WHERE round = 1),
p AS (SELECT question, sub, doc, row_number() OVER (PARTITION BY question ORDER BY rank, sub) AS position FROM one WHERE i = 1 QUALIFY position <= 10),
two AS (SELECT *, row_number() OVER (PARTITION BY question, doc ORDER BY sub, rank) AS i FROM h WHERE round = 2 AND (question, sub) NOT IN (SELECT (question, sub) FROM h WHERE round = 1) AND (question, doc) NOT IN (SELECT (question, doc) FROM p))
SELECT question, sub, doc, rank, found_by, round, position FROM one LEFT JOIN p USING (question, sub, doc)
UNION ALL SELECT question, sub, doc, rank, found_by, round, coalesce((SELECT max(position) FROM p WHERE p.question = two.question), 0) + row_number() OVER (PARTITION BY question ORDER BY sub, rank) FROM two WHERE i = 1""")
def planned_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three items as sub-questions of one question, each question with its own filter on language and source, in one scan; those whose
    filter takes no document are asked again without it."""
    d, e = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    asked = table(spark, sf_dir, "benchmark").select(F.floor(F.col("item_id") / 3).alias("question"), (F.col("item_id") % 3).alias("sub"), F.col("text").alias("search_text"), F.col("text").alias("metric"), F.col("item_id"))
    asked = asked.join(d.select(F.col("doc_id").alias("question"), "lang", "source"), "question", "left").join(e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"), F.col("embedding").alias("metric_vector")), "item_id", "left")
    only = lambda c: F.when(F.expr(c).isNotNull(), F.array(F.expr(c)))
    asked = asked.withColumns({"lang": only(_LANG), "source": only(_SOURCE)})
    return R.planned(d, "doc_id", "text", e, "vec_id", "embedding", asked, 10, ["lang", "source"], rounds=2)


@query(f"WITH {_bm25()} SELECT query_id, doc, round(score, 6) AS score, rank FROM ({_ranked('bm', 10)})")
def stored_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bm25_topk by a stored index, built from two thirds of the documents to which the others are appended."""
    path, d = scratch(spark, "inverted"), table(spark, sf_dir, "documents")
    for third in (F.col("doc_id") % 3 > 0, F.col("doc_id") % 3 == 0):
        inverted.append(d.where(third), "doc_id", "text", path)
    found = inverted.search(spark, path, R.query_terms(table(spark, sf_dir, "benchmark"), "item_id", "text", None), 10)
    return found.select("query_id", "doc", rounded("score", "score"), "rank")


@query("""SELECT lang AS company, source AS fiscal_year, count(*) AS chunks, sum(length(coalesce(text, '')))::BIGINT AS letters, 2 AS version FROM documents WHERE doc_id % 11 <> 5 GROUP BY ALL""")
def incremental_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks, indexed by language and source: first all, a seventh of them with another text; then as they are, an eleventh gone."""
    path, d = scratch(spark, "incremental"), table(spark, sf_dir, "documents")
    whole = d.select(F.col("doc_id").cast("string").alias("document_id"), F.coalesce("text", F.lit("")).alias("text"), F.col("lang").alias("company"), F.col("source").alias("fiscal_year"))
    before = whole.withColumn("text", F.when(F.col("document_id") % 7 == 0, F.concat("text", F.lit(" draft"))).otherwise(F.col("text")))
    for chunks in (before, whole.where("document_id % 11 <> 5")):
        state = chunks.select("document_id", F.sha2("text", 256).alias("sha256"), F.lit("1").alias("cache_key"), "company", "fiscal_year")
        now = incremental.commit(chunks, state, path, "documents", "none", 0)
    live = incremental.read(spark, path, "documents", "document_id string, text string, company string, fiscal_year string")
    return live.groupBy("company", "fiscal_year").agg(F.count("*").alias("chunks"), F.sum(F.length("text")).alias("letters"), F.lit(now.version).cast("int").alias("version"))
