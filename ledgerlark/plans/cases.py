"""Queries on graded cases: every order is a question, answered rightly or wrongly in ways that its key fixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import questions as Q
from ..operators import taxonomy as T
from ..operators import verify as C
from ..sources import records
from .base import query, rounded, table

_C = """o AS (SELECT o_orderkey AS k, round(o_totalprice, 2) AS g FROM orders),
c AS (SELECT k, g, k % 3 = 0 AS correct, CASE k % 7 WHEN 1 THEN -g WHEN 2 THEN g * 1000 WHEN 3 THEN NULL WHEN 4 THEN g ELSE g * 1.5 END AS a, CASE WHEN k % 7 = 4 THEN 'percent' ELSE 'currency' END AS uk, k % 7 = 5 AS hinted, CASE k % 5 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS retrieved,
 CASE k % 4 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS parsed, k % 11 = 0 AS ambiguous, CASE WHEN k % 6 = 0 THEN NULL ELSE k % 6 = 1 END AS faulty, k % 9 / 9.0::DOUBLE AS risk, k % 2 = 0 AS agreed FROM o),
p AS (SELECT *, CASE WHEN ambiguous THEN 'definitional_ambiguity' WHEN parsed = false THEN 'question_understanding' WHEN coalesce(retrieved, false) = false THEN 'retrieval' WHEN faulty THEN 'extraction' WHEN parsed IS NULL OR faulty IS NULL THEN 'undetermined' ELSE 'reasoning' END AS pr,
 CASE k % 7 WHEN 3 THEN 'unsupported_claim' WHEN 1 THEN 'sign_error' WHEN 2 THEN 'wrong_scale' WHEN 4 THEN 'wrong_unit' WHEN 5 THEN 'wrong_scale' ELSE 'unclassified' END AS ki FROM c),
e AS (SELECT *, CASE WHEN NOT correct THEN pr END AS provenance, CASE WHEN NOT correct THEN ki END AS kind, CASE WHEN NOT correct THEN CASE WHEN pr = 'undetermined' OR ki = 'unclassified' THEN 'needs_human' WHEN k % 7 = 5 THEN 'suggested' ELSE 'mechanical' END END AS confidence, NOT correct AND pr <> 'definitional_ambiguity' AS hallucination,
 CASE WHEN retrieved IS NULL THEN 'unknown' WHEN retrieved THEN 'reasoning_caused' ELSE 'retrieval_caused' END AS stratum FROM p)"""


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, g = F.col("o_orderkey"), F.round("o_totalprice", 2)
    flag = lambda m: F.when(k % m == 0, F.lit(None).cast("boolean"))
    c = table(spark, sf_dir, "orders").select(
        k.alias("k"), (k % 3 == 0).alias("correct"), F.when(k % 7 == 1, -g).when(k % 7 == 2, g * 1000).when(k % 7 == 3, None).when(k % 7 == 4, g).otherwise(g * 1.5).alias("answer"), g.alias("gold"), F.when(k % 7 == 4, "percent").otherwise("currency").alias("unit_kind"), F.lit("currency").alias("gold_kind"),
        F.lit("INR").alias("currency"), F.lit("INR").alias("gold_currency"), F.when(k % 7 == 5, F.array(F.lit("scale_mismatch"))).otherwise(F.array().cast("array<string>")).alias("disagreements"),
        flag(5).otherwise(k % 5 != 1).alias("retrieved"), flag(4).otherwise(k % 4 != 1).alias("parsed"), (k % 11 == 0).alias("ambiguous"), flag(6).otherwise(k % 6 == 1).alias("faulty"), (k % 9 / 9).alias("risk_score"), (k % 2 == 0).alias("agreed"),
    )
    return T.classified(c)


@query(f"WITH {_C} SELECT k, provenance, kind, confidence, hallucination, stratum FROM e")
def classified_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each error comes from and of what kind it is, and how sure that is."""
    return _cases(spark, sf_dir).select("k", "provenance", "kind", "confidence", "hallucination", "stratum")


@query(f"WITH {_C}, w AS (SELECT provenance, kind FROM e WHERE NOT correct) SELECT 'provenance' AS level, provenance, NULL AS kind, count(*) AS n FROM w GROUP BY provenance UNION ALL SELECT 'kind', NULL, kind, count(*) FROM w GROUP BY kind UNION ALL SELECT 'both', provenance, kind, count(*) FROM w GROUP BY provenance, kind")
def error_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors by provenance, by kind, and by both."""
    return T.error_table(_cases(spark, sf_dir))


@query(f"WITH {_C} SELECT stratum, count(*) AS questions, count(*) FILTER (NOT correct) AS errors FROM e GROUP BY stratum")
def strata_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.strata(_cases(spark, sf_dir))


@query(f"WITH {_C} SELECT count(*) AS ambiguous_questions, count(*) FILTER (correct) AS answered_correctly, count(*) FILTER (correct AND risk >= 0.5) AS flagged, round(count(*) FILTER (correct AND risk >= 0.5)::DOUBLE / nullif(count(*) FILTER (correct), 0), 6) AS false_positive_rate FROM e WHERE ambiguous")
def ambiguity_false_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.ambiguity_false_positives(_cases(spark, sf_dir), 0.5).select("ambiguous_questions", "answered_correctly", "flagged", rounded("false_positive_rate", "false_positive_rate"))


@query(f"WITH {_C} SELECT k, provenance, kind FROM e WHERE NOT correct ORDER BY k LIMIT 10")
def first_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten errors of the analysis."""
    return T.examples(_cases(spark, sf_dir), "k").select("k", "provenance", "kind")


# Each conversation is a question; its turns are what was retrieved; the words of its last turn are its gold, and words no turn has.
_G = r"""w AS (SELECT conv_id, turn, text, regexp_split_to_array(trim(regexp_replace(coalesce(text, ''), '[\s\x{A0}]+', ' ', 'g')), ' ') AS w FROM conversations), l AS (SELECT conv_id, max(turn) AS turn FROM conversations GROUP BY conv_id),
g AS (SELECT w.conv_id, 'last' AS group_id, turn AS page, array_to_string(w[1:3], ' ') AS anchor FROM w JOIN l USING (conv_id, turn) UNION ALL SELECT conv_id, 'none', turn, 'no such words' FROM l),
h AS (SELECT g.conv_id, group_id, min(t.turn + 1) AS first FROM g JOIN conversations t ON t.conv_id = g.conv_id AND t.turn = page AND contains(lower(trim(regexp_replace(coalesce(t.text, ''), '[\s\x{A0}]+', ' ', 'g'))), lower(anchor)) GROUP BY ALL)"""


@query(rf"""WITH {_G}, k AS (SELECT unnest([1, 3, 5, 10]) AS k), f AS (SELECT g.conv_id, g.group_id, k, coalesce(first <= k, false) AS found, first FROM g LEFT JOIN h USING (conv_id, group_id), k),
n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id), a AS (SELECT conv_id, k, avg(found::INT) AS recall, coalesce(1.0::DOUBLE / min(first) FILTER (found), 0) AS rr, bool_and(found) AS all_found, count(*) FILTER (found) AS hits FROM f GROUP BY ALL)
SELECT k, count(*) AS questions, round(avg(recall), 6) AS recall_at_k, round(avg(hits::DOUBLE / least(n, k)), 6) AS precision_at_k, round(avg(rr), 6) AS mrr, round(avg(all_found::INT), 6) AS evidence_retrieval_accuracy FROM a JOIN n USING (conv_id) GROUP BY k""")
def evidence_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold groups matched by page and anchors: recall, precision, reciprocal rank, all evidence found, averaged over questions."""
    c = table(spark, sf_dir, "conversations")
    last = c.groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("text", "turn").alias("text"))
    words = F.array_join(F.slice(F.split(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)\s+", " ")), " "), 1, 3), " ")
    spans = last.select(F.col("conv_id").alias("question"), F.col("turn").alias("page"), F.inline(F.array(F.struct(F.lit("last").alias("group_id"), F.array(words).alias("anchors")), F.struct(F.lit("none").alias("group_id"), F.array(F.lit("no such words")).alias("anchors")))))
    items = c.select(F.col("conv_id").alias("question"), (F.col("turn") + 1).alias("rank"), F.col("turn").alias("page"), F.coalesce("text", F.lit("")).alias("text"))
    m = T.macro(T.group_scores(items, spans, [1, 3, 5, 10]), "k")
    return m.select("k", "questions", *[rounded(x, x) for x in ("recall_at_k", "precision_at_k", "mrr", "evidence_retrieval_accuracy")])


@query("""WITH c AS (SELECT role, coalesce(text, '') AS t FROM conversations), o AS (SELECT role, CASE WHEN length(t) >= 200 THEN 'answered' WHEN length(t) % 4 = 0 THEN 'unavailable' WHEN contains(t, ',') THEN 'abstained' ELSE 'parse_failure' END AS outcome,
CASE WHEN length(t) >= 200 THEN 'answered' WHEN length(t) % 4 = 0 THEN 'unavailable' WHEN contains(t, '.') THEN 'abstained' ELSE 'parse_failure' END AS program FROM c), u AS (SELECT role AS channel, outcome FROM o UNION ALL SELECT role || ' program', program FROM o)
SELECT channel, outcome, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY channel), 6) AS share FROM u GROUP BY channel, outcome""")
def channel_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each channel's calls, and the shares: turns as calls, by what their texts hold."""
    t = F.coalesce("text", F.lit(""))
    ok, error = F.length(t) >= 200, F.when(F.length(t) % 4 == 0, "QuotaExhaustedError")
    reason = F.when(t.contains(","), "channel declined to answer").otherwise("no JSON object in the reply")
    c = table(spark, sf_dir, "conversations")
    calls = c.select(F.col("role").alias("channel"), Q.outcome(ok, reason, error).alias("outcome")).union(c.select(F.concat("role", F.lit(" program")), Q.program_outcome(ok, reason, error, t.contains("."))))
    return Q.outcome_shares(calls).select("channel", "outcome", "n", rounded("share", "share"))


@query("""WITH c AS (SELECT conv_id, turn, role, length(coalesce(text, '')) AS n FROM conversations), k AS (SELECT *, CASE WHEN n = 0 THEN 'empty' WHEN role = 'user' THEN 'figure' WHEN n < 300 THEN 'declined' ELSE 'words' END AS k FROM c)
SELECT conv_id, turn, k = 'figure' AS available, CASE WHEN k = 'figure' THEN n::DOUBLE END AS amount, CASE WHEN k = 'figure' THEN CASE WHEN n % 3 = 0 THEN 'percent' ELSE 'currency' END END AS unit_kind,
CASE k WHEN 'declined' THEN 'channel declined to answer; reported the evidence as insufficient' WHEN 'empty' THEN 'empty reply' WHEN 'words' THEN 'answer could not be parsed as a financial value' END AS failure_reason,
CASE WHEN k IN ('empty', 'words') THEN 'unresolved' WHEN k = 'declined' THEN 'supports_neither' WHEN (n % 2 = 0) <> (turn % 4 > 1) THEN 'supports_a' ELSE 'supports_b' END AS resolution FROM k""")
def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels' and the arbiter's replies read, made of each turn's length: figures with their units, refusals, words, nothing; the arbiter's candidates
    turned back where they were swapped."""
    n = F.length(F.coalesce("text", F.lit("")))
    of = lambda answer, unit, sufficient, said: F.to_json(F.struct(answer.alias("answer"), unit.alias("unit"), F.lit(sufficient).alias("sufficient"), said.alias("resolution")))
    figure = of(n.cast("string"), F.when(n % 3 == 0, "percent").otherwise("INR crore"), True, F.when(n % 2 == 0, "Candidate_1 ").otherwise("candidate_2"))
    reply = F.when(n == 0, "").when(F.col("role") == "user", figure).when(n < 300, of(F.lit(None).cast("string"), F.lit(None).cast("string"), False, F.lit("neither"))).otherwise(of(F.lit("many"), F.lit(""), True, F.lit("candidate_1")))
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", C.natural_reply(reply).alias("n"), C.arbiter_reply(reply, F.col("turn") % 4 > 1).alias("a"))
    return c.select("conv_id", "turn", "n.available", F.col("n.value.amount").cast("double").alias("amount"), F.col("n.value.unit_kind").alias("unit_kind"), "n.failure_reason", "a.resolution")


@query(r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents) SELECT doc_id, nullif(regexp_extract(text, '\b([A-Z][A-Za-z&.\- ]{2,60}?)\s+(?:Limited|Ltd\.?)\b', 1), '') IS NOT NULL AS company, regexp_matches(text, '(?i)year ended March 31,\s*\d{4}') OR regexp_matches(text, '(?i)FY\s?\d{4}-\d{2,4}') OR regexp_matches(text, '\d{4}-\d{2}\b') AS fiscal_year FROM d""")
def guesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents name a company or a fiscal year in one of the forms of filings."""
    t = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", X.guessed_company(t).isNotNull().alias("company"), X.guessed_fiscal_year(t).isNotNull().alias("fiscal_year"))


@query(rf"""WITH {_G}, m AS (SELECT g.* FROM g LEFT JOIN h USING (conv_id, group_id) WHERE coalesce(h.first > 2, true)),
c AS (SELECT m.conv_id, m.group_id, list_sort(list(DISTINCT t.conv_id::VARCHAR || ':' || t.turn::VARCHAR)) AS holders FROM m JOIN conversations t ON t.turn = m.page AND contains(lower(trim(regexp_replace(coalesce(t.text, ''), '[\s\x{{A0}}]+', ' ', 'g'))), lower(m.anchor)) GROUP BY ALL)
SELECT m.conv_id, m.group_id, CASE WHEN holders IS NULL THEN 'absent_from_index' ELSE 'ranked_too_low' END AS verdict, coalesce(array_to_string(holders[1:5], ','), '') AS holders FROM m LEFT JOIN c USING (conv_id, group_id)""")
def diagnosed_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold that the first two turns of a conversation miss: whether any turn of the whole table holds it, and which."""
    c = table(spark, sf_dir, "conversations")
    last = c.groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("text", "turn").alias("text"))
    words = F.array_join(F.slice(F.split(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)\s+", " ")), " "), 1, 3), " ")
    spans = last.select(F.col("conv_id").alias("question"), F.col("turn").alias("page"), F.inline(F.array(F.struct(F.lit("last").alias("group_id"), F.array(words).alias("anchors")), F.struct(F.lit("none").alias("group_id"), F.array(F.lit("no such words")).alias("anchors")))))
    items = c.select(F.col("conv_id").alias("question"), (F.col("turn") + 1).alias("rank"), F.col("turn").alias("page"), F.coalesce("text", F.lit("")).alias("text"))
    corpus = c.select(F.col("turn").alias("page"), "text", F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("chunk_id"))
    d = T.diagnosed(items, spans, corpus, 2)
    return d.select(F.col("question").alias("conv_id"), "group_id", "verdict", F.array_join("holders", ",").alias("holders"))


@query("""WITH l AS (SELECT l_orderkey, sum(CASE WHEN l_quantity > 10 THEN l_quantity::BIGINT ELSE 0 END) AS sampled, count(*) FILTER (l_quantity > 10) AS samples FROM lineitem GROUP BY l_orderkey),
o AS (SELECT o_orderstatus AS arm, o_totalprice AS latency, CASE WHEN o_orderpriority < '3' THEN o_orderkey % 90 + 10 ELSE 0 END AS nat, coalesce(sampled, 0) AS sampled, coalesce(samples, 0) AS samples, o_orderkey % 400 AS used, month(o_orderdate) = 1 AS triggered FROM orders LEFT JOIN l ON l_orderkey = o_orderkey)
SELECT arm, count(*) AS questions, sum(samples + (nat > 0)::INT)::BIGINT AS calls, sum(nat + sampled)::BIGINT AS tokens, round(sum(nat + sampled)::DOUBLE / count(*), 6) AS tokens_per_question, sum(greatest(0, used - nat - sampled))::BIGINT AS unattributed_tokens, round(avg(triggered::INT), 6) AS trigger_rate, round(quantile_cont(latency, 0.5), 4) AS p50, round(quantile_cont(latency, 0.95), 4) AS p95,
sum(nat)::BIGINT AS natural_tokens, sum(sampled)::BIGINT AS sample_tokens FROM o GROUP BY arm""")
def run_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a run's records with a sample for each line: tokens by channel, of no call, and how often the arbiter was asked."""
    usage = "struct<prompt_tokens:bigint,completion_tokens:bigint,reasoning_tokens:bigint,reported_total_tokens:bigint,total_tokens:bigint,latency_seconds:double,cost_usd:double,cached:boolean>"
    call = lambda total: F.from_json(F.to_json(F.struct(F.lit(True).alias("available"), F.struct(total.alias("total_tokens")).alias("usage"))), f"available boolean, usage {usage}")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(call(F.when(F.col("l_quantity") > 10, F.col("l_quantity").cast("long")))).alias("samples"))
    o = table(spark, sf_dir, "orders")
    o = o.join(lines, o["o_orderkey"] == lines["l_orderkey"], "left")
    natural = F.when(F.col("o_orderpriority") < "3", call(F.col("o_orderkey") % 90 + 10))
    runs = o.select(F.col("o_orderstatus").alias("arm"), F.col("o_orderkey").cast("string").alias("question_id"), natural.alias("natural"), "samples", (F.col("o_orderkey") % 400).alias("tokens_used"), F.col("o_totalprice").alias("latency_seconds"), F.struct((F.month("o_orderdate") == 1).alias("triggered")).alias("verification"))
    r = records.run_efficiency(runs)
    at = lambda c: F.coalesce(F.try_element_at("tokens_by_channel", F.lit(c)), F.lit(0))
    return r.select("arm", "questions", "calls", "tokens", rounded("tokens_per_question", "tokens_per_question"), "unattributed_tokens", rounded("trigger_rate", "trigger_rate"), rounded("p50", "p50", 4), rounded("p95", "p95", 4), at("natural").alias("natural_tokens"), at("natural_sample").alias("sample_tokens"))
