"""Metric queries over labels joined to documents, and over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import metrics as M
from ..operators import report as RP
from .base import query, rounded, table

#: score: a fixed function of the length; label 1: low quality; agreed: not toxic.
_S = "s AS (SELECT d.doc_id AS id, (d.n_chars % 97) / 97.0::DOUBLE AS score, 1 - l.quality AS label, l.toxic = 0 AS agreed, d.source, d.lang FROM documents d JOIN labels l USING (doc_id))"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return d.join(l, "doc_id").select(F.col("doc_id").alias("id"), ((F.col("n_chars") % 97) / F.lit(97.0)).alias("score"), (1 - F.col("quality")).alias("label"), (F.col("toxic") == 0).alias("agreed"), "source", "lang")


@query(f"""WITH {_S}, g AS (SELECT score, sum(label) AS p, sum(1 - label) AS n FROM s GROUP BY score),
w AS (SELECT *, coalesce(sum(n) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g)
SELECT round(sum(p * (below + n / 2.0::DOUBLE)) / nullif(sum(p) * sum(n), 0)::DOUBLE, 6) AS auroc FROM w""")
def auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.auroc(_scored(spark, sf_dir)).select(rounded("auroc", "auroc"))


@query(f"""WITH {_S}, g AS (SELECT score, sum(label) AS p, sum(1 - label) AS n FROM s GROUP BY score),
w AS (SELECT p, sum(p) OVER (ORDER BY score DESC) AS tp, sum(p + n) OVER (ORDER BY score DESC) AS a FROM g)
SELECT round(sum(p * tp::DOUBLE / a) / nullif(sum(p), 0)::DOUBLE, 6) AS average_precision FROM w""")
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.average_precision(_scored(spark, sf_dir)).select(rounded("average_precision", "average_precision"))


@query(f"""WITH {_S}, a AS (SELECT sum(label) OVER (ORDER BY score, id)::DOUBLE / row_number() OVER (ORDER BY score, id) AS r, sum(label) OVER (ORDER BY label, id)::DOUBLE / row_number() OVER (ORDER BY label, id) AS o FROM s)
SELECT round(avg(r), 6) AS aurc, round(avg(o), 6) AS optimal, round(avg(r) - avg(o), 6) AS excess FROM a""")
def risk_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = M.risk_coverage(_scored(spark, sf_dir))
    return r.select(rounded("aurc", "aurc"), rounded("optimal", "optimal"), rounded("excess", "excess"))


@query(f"""WITH {_S}, c AS (SELECT DISTINCT score FROM s UNION SELECT 0.0::DOUBLE UNION SELECT 1.0::DOUBLE + 1e-9::DOUBLE),
k AS (SELECT c.score AS threshold, count(*) FILTER (s.score >= c.score AND label = 1) AS tp, count(*) FILTER (s.score >= c.score AND label = 0) AS fp, count(*) FILTER (s.score < c.score AND label = 1) AS fn FROM c, s GROUP BY c.score),
f AS (SELECT *, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS precision, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall, coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM k)
SELECT round(threshold, 6) AS threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f ORDER BY f.f1 DESC, f.recall DESC, f.threshold LIMIT 1""")
def threshold_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = M.select_threshold(_scored(spark, sf_dir))
    return t.select(rounded("score", "threshold"), rounded("precision", "precision"), rounded("recall", "recall"), rounded("f1", "f1"))


@query(f"WITH {_S} SELECT source, count(*) FILTER (agreed AND label = 0) AS agree_right, count(*) FILTER (agreed AND label = 1) AS agree_wrong, count(*) FILTER (NOT agreed AND label = 0) AS disagree_right, count(*) FILTER (NOT agreed AND label = 1) AS disagree_wrong FROM s GROUP BY source")
def contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, r = F.col("agreed"), F.col("label") == 0
    return _scored(spark, sf_dir).groupBy("source").agg(F.count_if(a & r).alias("agree_right"), F.count_if(a & ~r).alias("agree_wrong"), F.count_if(~a & r).alias("disagree_right"), F.count_if(~a & ~r).alias("disagree_wrong"))


@query(f"""WITH {_S}, k AS (SELECT lang, count(*) FILTER (score >= 0.5 AND label = 1) AS tp, count(*) FILTER (score >= 0.5 AND label = 0) AS fp, count(*) FILTER (score < 0.5 AND label = 0) AS tn, count(*) FILTER (score < 0.5 AND label = 1) AS fn FROM s GROUP BY lang)
SELECT *, round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1,
round(coalesce(fp::DOUBLE / nullif(fp + tn, 0), 0), 6) AS fpr, round(coalesce(fn::DOUBLE / nullif(fn + tp, 0), 0), 6) AS fnr FROM k""")
def confusion_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = M.rates(_scored(spark, sf_dir).groupBy("lang").agg(*M.at_threshold(None, F.lit(0.5))))  # type: ignore[arg-type]
    return r.select("lang", "tp", "fp", "tn", "fn", *[rounded(c, c) for c in ("precision", "recall", "f1", "fpr", "fnr")])


@query(f"""WITH {_S}, t AS (SELECT source AS name, round(1.0::DOUBLE / (1 + count(*)), 8) AS p FROM s GROUP BY source), r AS (SELECT *, row_number() OVER (ORDER BY p, name) AS rank, 0.05::DOUBLE / (count(*) OVER () - row_number() OVER (ORDER BY p, name) + 1) AS cut FROM t)
SELECT name, p, rank, round(cut, 8) AS cut, min((p <= cut)::INT) OVER (ORDER BY p, name) = 1 AS rejected FROM r""")
def holm(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _scored(spark, sf_dir).groupBy(F.col("source").alias("name")).agg(F.round(1.0 / (1 + F.count("*")), 8).alias("p"))
    return M.holm(t).select("name", "p", "rank", rounded("cut", "cut", 8), "rejected")


@query(f"""WITH {_S} SELECT grouping_id(source, lang, agreed) AS dimension, source, lang, agreed, count(*) AS n FROM s GROUP BY GROUPING SETS ((source), (lang), (agreed))""")
def stratify_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scored(spark, sf_dir)
    g = s.groupingSets([["source"], ["lang"], ["agreed"]], "source", "lang", "agreed").agg(F.grouping_id("source", "lang", "agreed").alias("dimension"), F.count("*").alias("n"))
    return g.select("dimension", "source", "lang", "agreed", "n")


@query(f"""WITH {_S} SELECT source, lang, count(*) AS n, sum(label)::BIGINT AS errors, CASE WHEN count(*) > 0 THEN round(1 - avg(label), 6) END AS accuracy, count(*) < 15 AS thin FROM s GROUP BY source, lang""")
def case_study_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum("label").cast("long").alias("errors"), rounded(1 - F.avg("label"), "accuracy"), (F.count("*") < 15).alias("thin"))


@query(f"""WITH {_S} SELECT source, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'fr') AS fr, count(*) FILTER (lang = 'es') AS es FROM s WHERE label = 1 GROUP BY source""")
def crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).where("label = 1").groupBy("source").agg(*[F.count_if(F.col("lang") == x).alias(x) for x in ("en", "de", "fr", "es")])


@query("""SELECT event_type, count(*) AS questions, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(avg(k), 6) AS tokens_per_question, sum(k)::BIGINT AS tokens, round(avg((k % 2 = 0)::INT), 6) AS cost_coverage
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY event_type""")
def efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    c = table(spark, sf_dir, "events").select("event_type", F.col("value").alias("latency"), k.alias("tokens"), F.when(k % 2 == 0, k / 1000).alias("cost"))
    e = M.efficiency(c, "event_type")
    return e.select("event_type", "questions", rounded("p50", "p50"), rounded("p95", "p95"), rounded("tokens_per_question", "tokens_per_question"), "tokens", rounded("cost_coverage", "cost_coverage"))


@query()
def bootstrap_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A percentile interval of the share of errors, from 10,000 resamples."""
    return M.bootstrap_mean(_scored(spark, sf_dir).select("id", F.col("label").cast("double").alias("value")))


@query()
def paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUROC of two scores on the same documents, their difference with interval and p, from 10,000 resamples of documents."""
    d = _scored(spark, sf_dir)
    return M.paired_auroc(d.select("id", F.col("score").alias("score_a"), F.col("label").alias("label_a"), F.col("agreed").cast("double").alias("score_b"), F.col("label").alias("label_b")))


@query(f"""WITH {_S}, k AS (SELECT source, count(*) AS questions, count(*) FILTER (label = 0) AS correct, count(*) FILTER (NOT agreed) AS disagreements, count(*) FILTER (agreed AND label = 1) AS both_agree_wrong FROM s GROUP BY source)
SELECT *, round(correct::DOUBLE / questions, 6) AS accuracy, round(disagreements::DOUBLE / questions, 6) AS disagreement_rate, questions < 15 AS thin FROM k""")
def case_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cell for each source, the hardest first."""
    c = RP.case_study(_scored(spark, sf_dir).withColumn("correct", F.col("label") == 0), "source")
    return c.select("source", "questions", "correct", "disagreements", "both_agree_wrong", rounded("accuracy", "accuracy"), rounded("disagreement_rate", "disagreement_rate"), "thin")


@query(f"""WITH {_S}, a AS (SELECT source AS company, upper(source[1:2]) AS sector, lang AS question_type, label = 0 AS correct, agreed, CASE WHEN agreed THEN 'AGREE' WHEN score > 0.5 THEN 'DISAGREE' ELSE 'UNCERTAIN' END AS verdict, id % 13 = 0 AS abstained, score * 10 AS latency, id % 97 AS tokens,
CASE WHEN id % 3 > 0 THEN ['retrieval', 'reasoning'][id % 3] END AS provenance, CASE WHEN score > 0.4 THEN 'magnitude' ELSE 'sign' END AS kind, NOT agreed AND score > 0.2 AS triggered, id % 2 = 0 AS resolved FROM s),
h AS (SELECT count(*) AS n, count(DISTINCT company) AS companies, count(*) FILTER (correct) AS correct, count(*) FILTER (NOT agreed) AS apart, count(*) FILTER (verdict = 'DISAGREE') AS disagreed, count(*) FILTER (abstained) AS abstained, count(*) FILTER (agreed AND NOT correct) AS wrong, avg(tokens) AS tokens, count(*) FILTER (triggered) AS asked, count(*) FILTER (triggered AND resolved) AS settled, quantile_cont(latency, 0.5) AS p50, quantile_cont(latency, 0.95) AS p95 FROM a),
k AS (SELECT company AS name, min(sector) AS sector, 3 AS section, count(*) AS n, avg(correct::INT) AS acc, avg((NOT agreed)::INT) AS apart, count(*) FILTER (agreed AND NOT correct) AS wrong FROM a GROUP BY company UNION ALL SELECT question_type, NULL, 4, count(*), avg(correct::INT), avg((NOT agreed)::INT), count(*) FILTER (agreed AND NOT correct) FROM a GROUP BY question_type),
e AS (SELECT 5 AS section, coalesce(provenance, 'unknown') AS name, count(*) AS n FROM a WHERE NOT correct GROUP BY ALL UNION ALL SELECT 6, kind, count(*) FROM a WHERE NOT correct GROUP BY ALL),
f AS (SELECT 0 AS section, 0 AS part, unnest([0, 1, 2, 3]) AS rank, unnest(['# Documents as answers', '', 'Labelled documents by source.', '']) AS line UNION ALL SELECT section, 2, 0, '' FROM (SELECT unnest([1, 2, 3, 4, 5, 6, 7]) AS section)
UNION ALL SELECT 2, 0, unnest([0, 1, 2, 3]), unnest(['## Headline', '', '| | |', '|---|---|']) UNION ALL SELECT 3, 0, unnest([0, 1, 2, 3]), unnest(['## By company', '', '| Company | Sector | n | Accuracy | No agreement | Both wrong | |', '|---|---|---:|---:|---:|---:|---|'])
UNION ALL SELECT 4, 0, unnest([0, 1, 2, 3]), unnest(['## By type of question, the hardest first', '', '| Type | n | Accuracy | No agreement | Both wrong | |', '|---|---:|---:|---:|---:|---|']) UNION ALL SELECT 5, 0, unnest([0, 1, 2, 3]), unnest(['## Errors by provenance', '', '| Provenance | n |', '|---|---:|'])
UNION ALL SELECT 6, 0, unnest([0, 1, 2, 3]), unnest(['## Errors by kind', '', '| Kind | n |', '|---|---:|']) UNION ALL SELECT 7, 0, unnest([0, 1]), unnest(['## Arbitration', '']))
SELECT section, part, rank::DOUBLE AS rank, '' AS name, line FROM f UNION ALL SELECT 1, 1, 0, '', '**' || n || '** graded questions from ' || companies || ' companies.' FROM h
UNION ALL SELECT 2, 1, unnest([0, 1, 2, 3, 4, 5, 6]), '', unnest([format('| Numerical accuracy | {{:.1f}}% |', round(correct / n * 100, 1)), format('| No agreement: other figures, or none from a channel | {{:.1f}}% |', round(apart / n * 100, 1)), format('| Other figures (verdict DISAGREE) | {{}} of {{}} ({{:.1f}}%) |', disagreed, n, round(disagreed / n * 100, 1)), format('| Abstention rate | {{:.1f}}% |', round(abstained / n * 100, 1)),
 format('| **Agreed and both wrong** | {{}} of {{}} |', wrong, n), format('| Latency p50 / p95 | {{:.2f}}s / {{:.2f}}s |', round(p50, 2), round(p95, 2)), format('| Tokens per question | {{:.0f}} |', round(tokens, 0))]) FROM h
UNION ALL SELECT section, 1, round(acc, 6), name, '| ' || name || CASE WHEN section = 3 THEN ' | ' || sector ELSE '' END || format(' | {{}} | {{:.1f}}% | {{:.1f}}% | {{}} | {{}} |', n, round(acc * 100, 1), round(apart * 100, 1), wrong, CASE WHEN n < 15 THEN '**thin cell**' ELSE '' END) FROM k
UNION ALL SELECT section, 1, -n, name, '| ' || name || ' | ' || n || ' |' FROM e UNION ALL SELECT 7, 1, 0, '', format('The arbiter was asked for {{:.1f}}% of the questions; it settled {{}} and left {{}} open.', round(asked / n * 100, 1), settled, asked - settled) FROM h""")
def case_study_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The case study of all labelled documents as the lines of its file, in their order's columns."""
    i, s = F.col("id"), F.col("score")
    a = _scored(spark, sf_dir).select(
        F.col("source").alias("company"), F.upper(F.substring("source", 1, 2)).alias("sector"), F.col("lang").alias("question_type"), (F.col("label") == 0).alias("correct"), "agreed", F.when(F.col("agreed"), "AGREE").when(s > 0.5, "DISAGREE").otherwise("UNCERTAIN").alias("verdict"), (i % 13 == 0).alias("abstained"), (s * 10).alias("latency"), (i % 97).alias("tokens"),
        F.when(i % 3 == 1, "retrieval").when(i % 3 == 2, "reasoning").alias("provenance"), F.when(s > 0.4, "magnitude").otherwise("sign").alias("kind"), (~F.col("agreed") & (s > 0.2)).alias("triggered"), (i % 2 == 0).alias("resolved"),
    )
    lines = RP.case_lines(RP.case_tables(a), "Documents as answers", "Labelled documents by source.")
    return lines.select("section", "part", rounded("rank", "rank"), "name", "line")


@query(f"""WITH {_S}, r AS (SELECT score > 0.3 AS triggered, score > 0.6 AS resolved, CASE WHEN id % 7 <> 0 THEN label = 0 END AS correct, agreed AS available FROM s),
k AS (SELECT count(*) AS records, count(*) FILTER (triggered) AS triggered, count(*) FILTER (triggered AND resolved) AS resolved, count(*) FILTER (triggered AND NOT resolved) AS declined, count(*) FILTER (triggered AND resolved AND correct IS NOT NULL) AS graded,
count(*) FILTER (triggered AND resolved AND correct) AS correct, count(*) FILTER (triggered AND resolved AND correct IS NOT NULL AND available) AS winnable, count(*) FILTER (triggered AND resolved AND correct AND available) AS won FROM r)
SELECT *, round(triggered::DOUBLE / records, 4) AS trigger_rate, CASE WHEN graded >= 10 THEN round(correct::DOUBLE / graded, 4) END AS rate FROM k""")
def arbitration_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scored(spark, sf_dir)
    return RP.arbitration(s.select((F.col("score") > 0.3).alias("triggered"), (F.col("score") > 0.6).alias("resolved"), F.when(F.col("id") % 7 != 0, F.col("label") == 0).alias("correct"), F.col("agreed").alias("right_available")))


@query("""WITH k AS (SELECT event_type, avg(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS t, quantile_cont(value, 0.5) AS p50, sum(CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) % 2 = 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) / 1000.0::DOUBLE END) AS cost FROM events GROUP BY event_type)
SELECT l.event_type AS "left", r.event_type AS "right", round(l.t / r.t, 6) AS tokens_per_question_ratio, round(l.p50 / r.p50, 6) AS p50_ratio, round(l.cost / r.cost, 6) AS cost_ratio FROM k l, k r WHERE l.event_type = (SELECT min(event_type) FROM k) AND r.event_type = (SELECT max(event_type) FROM k)""")
def cost_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two event types as arms: ratios of tokens, latency and cost."""
    e, k = table(spark, sf_dir, "events"), F.get_json_object("props", "$.k").cast("long")
    ends = e.agg(F.min("event_type").alias("a"), F.max("event_type").alias("z")).first()
    c = e.select("event_type", F.col("value").alias("latency"), k.alias("tokens"), F.when(k % 2 == 0, k / 1000).alias("cost"))
    r = M.cost_matched(M.efficiency(c, "event_type"), "event_type", ends.a, ends.z)
    return r.select("left", "right", *[rounded(x, x) for x in ("tokens_per_question_ratio", "p50_ratio", "cost_ratio")])


# Predictions of every line against its price: right, off, of opposite sign, without a unit kind, of another kind or currency, missing.
_J = """j AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_extendedprice::DECIMAL(18,2) AS gold, (l_orderkey + l_linenumber) % 8 AS k, l_discount > 0.05 AS abstained, l_tax > 0.04 AS ambiguous FROM lineitem),
p AS (SELECT *, CASE k WHEN 0 THEN gold WHEN 1 THEN gold * 1.004 WHEN 2 THEN gold * 1.02 WHEN 3 THEN -gold WHEN 7 THEN NULL ELSE gold END AS prediction FROM j),
m AS (SELECT *, CASE WHEN prediction IS NULL THEN 'missing_prediction' WHEN k = 4 THEN 'unit_kind' WHEN k = 5 THEN 'currency' WHEN k = 3 THEN 'sign' WHEN k = 2 THEN 'magnitude' ELSE 'none' END AS mismatch FROM p)"""


def _judged(spark: SparkSession, sf_dir: str, tau: float = 0.005, assume: bool = True) -> DataFrame:
    k = (F.col("l_orderkey") + F.col("l_linenumber")) % 8
    gold = F.col("l_extendedprice").cast("decimal(18,2)").cast(V.MONEY)
    amount = F.when(k == 1, (gold * F.lit("1.004").cast("decimal(4,3)")).cast(V.MONEY)).when(k == 2, (gold * F.lit("1.02").cast("decimal(4,3)")).cast(V.MONEY)).when(k == 3, (-gold).cast(V.MONEY)).when(k != 7, gold)
    kind = F.when(k == 4, "percent").when(k == 6, "unknown").otherwise("currency")
    j = V.judge(amount, F.lit("unit"), kind, F.when(k == 5, "USD").otherwise("INR"), gold, F.lit("currency"), F.lit("INR"), tau, assume)
    exact = V.judge(amount, F.lit("unit"), kind, F.when(k == 5, "USD").otherwise("INR"), gold, F.lit("currency"), F.lit("INR"), 0.0, assume)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", k.alias("k"), amount.alias("prediction"), j.alias("j"), exact["correct"].alias("exact"), (F.col("l_discount") > 0.05).alias("abstained"), (F.col("l_tax") > 0.04).alias("ambiguous"))


@query(f"WITH {_J} SELECT l_orderkey, l_linenumber, mismatch = 'none' AS correct, mismatch, k = 6 AS unit_assumed FROM m")
def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line's prediction judged against its price."""
    return _judged(spark, sf_dir).select("l_orderkey", "l_linenumber", "j.correct", "j.mismatch", "j.unit_assumed")


@query(f"""WITH {_J}, g AS (SELECT * FROM m WHERE NOT ambiguous) SELECT count(*) AS n, round(avg((k IN (0, 6))::INT), 6) AS exact_match, round(avg((mismatch = 'none')::INT), 6) AS accuracy, round(avg(abstained::INT), 6) AS abstention_rate, round(avg((prediction IS NULL AND NOT abstained)::INT), 6) AS parse_failure_rate,
round(avg((k = 6)::INT), 6) AS unit_assumption_rate, round(count(*) FILTER (k <> 2 AND mismatch = 'none')::DOUBLE / count(*) FILTER (k < 6), 6) AS execution_accuracy, (SELECT string_agg(mismatch || '=' || c::VARCHAR, ',' ORDER BY mismatch) FROM (SELECT mismatch, count(*) AS c FROM g GROUP BY mismatch)) AS mismatches FROM g""".replace("count(*) FILTER (k <> 2 AND mismatch = 'none')", "count(*) FILTER (k < 6 AND mismatch = 'none')"))
def qa_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates over all lines that are not ambiguous, and how often each mismatch is."""
    j = _judged(spark, sf_dir).select("j.*", "exact", "abstained", "prediction", "ambiguous", F.when(F.col("k") < 6, F.lit(True)).alias("program_executed"))
    r = M.qa_report(j)
    counts = F.array_join(F.transform(F.array_sort(F.map_entries("mismatches")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return r.select("n", *[rounded(c, c) for c in ("exact_match", "accuracy", "abstention_rate", "parse_failure_rate", "unit_assumption_rate", "execution_accuracy")], counts.alias("mismatches"))


@query(f"""WITH {_J}, t AS (SELECT unnest([0.001, 0.005, 0.01, 0.05]::DOUBLE[]) AS tau) SELECT l_returnflag, tau, count(*) AS n, round(avg((k IN (0, 6) OR (k = 1 AND tau >= 0.005) OR (k = 2 AND tau >= 0.05))::INT), 6) AS accuracy FROM m, t GROUP BY ALL""")
def tau_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy at four tolerances."""
    j = _judged(spark, sf_dir, float("inf")).select("l_returnflag", "j.correct", "j.rel_err")
    return M.tolerance_sensitivity(j, [0.001, 0.005, 0.01, 0.05], "l_returnflag").select("l_returnflag", "tau", "n", rounded("accuracy", "accuracy"))


_ST = f"""{_S}, a AS (SELECT id, score, label, source AS arm, CASE lang WHEN 'en' THEN 'retrieval_caused' WHEN 'de' THEN 'reasoning_caused' WHEN 'fr' THEN 'unknown' END AS stratum FROM s),
x AS (SELECT arm, stratum, score, label FROM a WHERE stratum IS NOT NULL UNION ALL SELECT arm, 'pooled', score, label FROM a), d AS (SELECT arm, stratum, score, sum(label)::BIGINT AS p, sum(1 - label)::BIGINT AS n FROM x GROUP BY ALL)"""


@query(f"""WITH {_ST}, r AS (SELECT *, sum(n) OVER (PARTITION BY arm, stratum ORDER BY score) AS upto, sum(p) OVER (PARTITION BY arm, stratum ORDER BY score DESC) AS tp, sum(p + n) OVER (PARTITION BY arm, stratum ORDER BY score DESC) AS all_ FROM d),
m AS (SELECT arm, stratum, sum(p + n)::BIGINT AS n, sum(p)::BIGINT AS errors, CASE WHEN sum(p) * sum(n) > 0 THEN sum(p * (upto - n / 2)) / (sum(p) * sum(n)) END AS auroc, CASE WHEN sum(p) > 0 THEN sum(p * tp / all_) / sum(p) END AS ap FROM r GROUP BY ALL),
c AS (SELECT arm, stratum, score, p, n FROM d UNION ALL SELECT DISTINCT arm, stratum, unnest([0.0, 1.000000001]::DOUBLE[]), 0, 0 FROM d), c1 AS (SELECT arm, stratum, score, sum(p) AS p, sum(n) AS n FROM c GROUP BY ALL),
k AS (SELECT *, sum(p) OVER (PARTITION BY arm, stratum ORDER BY score DESC) AS tp, sum(n) OVER (PARTITION BY arm, stratum ORDER BY score DESC) AS fp, sum(p) OVER (PARTITION BY arm, stratum) AS ps FROM c1),
f AS (SELECT *, coalesce(2 * tp / nullif(tp + fp + ps, 0), 0) AS f1, coalesce(tp / nullif(ps, 0), 0) AS recall FROM k), b AS (SELECT arm, stratum, score AS threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, round(f1, 6) AS f1 FROM f QUALIFY row_number() OVER (PARTITION BY arm, stratum ORDER BY f1 DESC, recall DESC, score) = 1),
g AS (SELECT DISTINCT a.arm, t.stratum FROM a, (SELECT unnest(['retrieval_caused', 'reasoning_caused', 'unknown', 'pooled']) AS stratum) t)
SELECT g.arm, g.stratum, coalesce(m.n, 0) AS n, coalesce(m.errors, 0) AS errors, round(auroc, 6) AS auroc, round(ap, 6) AS average_precision, round(threshold, 6) AS threshold, tp, fp, f1, coalesce(m.errors, 0) < 10 AS too_few, CASE WHEN m.arm IS NOT NULL THEN coalesce(auroc IS NULL OR true, false) END AS bounded
FROM g LEFT JOIN m USING (arm, stratum) LEFT JOIN b USING (arm, stratum)""")
def detection_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detection of every arm and stratum from one set of passes: sources as arms, languages as strata.  bounded: the point lies in its interval, from 2,000 resamples."""
    s = _scored(spark, sf_dir).withColumn("stratum", F.when(F.col("lang") == "en", "retrieval_caused").when(F.col("lang") == "de", "reasoning_caused").when(F.col("lang") == "fr", "unknown"))
    cases = s.select(F.col("source").alias("arm"), F.col("id").alias("qid"), (F.col("label") == 0).alias("correct"), F.col("score").alias("risk_score"), "stratum")
    r = RP.report(cases, 2000)
    inside = F.when(F.col("undefined").isNotNull() & (F.col("n") > 0), F.col("auroc").isNull() | F.coalesce((F.col("low") <= F.col("auroc") + 1e-9) & (F.col("auroc") <= F.col("high") + 1e-9), F.lit(False)))
    return r.select("arm", "stratum", "n", "errors", rounded("auroc", "auroc"), rounded("average_precision", "average_precision"), rounded("threshold", "threshold"), "tp", "fp", rounded("f1", "f1"), "too_few", inside.alias("bounded"))
