"""Value and verification queries: figures parsed from text, calculations, channels, risk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import staged as G
from ..operators import verify as C
from .base import query, rounded, table


def _figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    price = F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2)
    k = F.col("o_orderkey") % 6
    text = (
        F.when(k == 0, F.concat(F.lit("Rs. "), price, F.lit(" crore"))).when(k == 1, F.concat(F.lit("("), price, F.lit(") lakh"))).when(k == 2, F.concat(F.lit("$"), price, F.lit(" mn")))
        .when(k == 3, F.concat((F.col("o_orderkey") % 100).cast("string"), F.lit(".5 %"))).when(k == 4, F.concat(F.lit("−"), price, F.lit("*"))).otherwise(F.concat(F.lit("€ "), price, F.lit(" thousand")))
    )
    return V.parsed(o.select("o_orderkey", text.alias("text")), "v", F.col("text"))


_FIG = """f AS (SELECT o_orderkey, o_orderkey % 6 AS k, CASE WHEN o_orderkey % 6 = 3 THEN (o_orderkey % 100 + 0.5)::DECIMAL(38,6) ELSE round(o_totalprice, 2)::DECIMAL(18,2)::DECIMAL(38,6) END AS a FROM orders),
v AS (SELECT o_orderkey, k, CASE WHEN k IN (1, 4) THEN -a ELSE a END AS amount, ['crore', 'lakh', 'million', 'unit', 'unit', 'thousand'][k + 1] AS scale, ['currency', 'unknown', 'currency', 'percent', 'unknown', 'currency'][k + 1] AS unit_kind, ['INR', NULL, 'USD', NULL, NULL, 'EUR'][k + 1] AS currency FROM f)"""


@query(f"WITH {_FIG} SELECT o_orderkey, amount::DOUBLE AS amount, scale, unit_kind, currency, k = 4 AS footnote FROM v")
def parse_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order's price written in one of six styles and read back."""
    return _figures(spark, sf_dir).select("o_orderkey", F.col("v.amount").cast("double").alias("amount"), "v.scale", "v.unit_kind", "v.currency", F.array_contains("v.warnings", "footnote_marker_stripped").alias("footnote"))


@query(f"""WITH {_FIG} SELECT unit_kind, scale, count(*) AS n, sum(CASE WHEN unit_kind = 'percent' THEN (amount / 100)::DECIMAL(38,6) ELSE (amount * CASE scale WHEN 'crore' THEN 10000000 WHEN 'lakh' THEN 100000 WHEN 'million' THEN 1000000 WHEN 'thousand' THEN 1000 ELSE 1 END)::DECIMAL(38,6) END)::DOUBLE AS total FROM v GROUP BY ALL""")
def canonical_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = V.canonical(F.col("v.amount"), F.col("v.scale"), F.col("v.unit_kind"))
    return _figures(spark, sf_dir).groupBy("v.unit_kind", "v.scale").agg(F.count("*").alias("n"), F.sum(c).cast("double").alias("total"))


_OPS = ("sum", "difference", "product", "ratio", "percentage_change", "average", "cagr", "margin")


@query("""WITH p AS (SELECT l_orderkey, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS a, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS b, count(*) AS n FROM lineitem GROUP BY l_orderkey), o AS (SELECT unnest(['sum', 'difference', 'product', 'ratio', 'percentage_change', 'average', 'cagr', 'margin']) AS operation),
r AS (SELECT l_orderkey, operation, l_orderkey % 5 = 0 AND operation IN ('sum', 'difference', 'average') AS mixed, CASE operation WHEN 'sum' THEN a + b WHEN 'difference' THEN a - b WHEN 'product' THEN a * b WHEN 'ratio' THEN a / b WHEN 'percentage_change' THEN (b - a) / a WHEN 'average' THEN (a + b) / 2 WHEN 'margin' THEN a / b ELSE round(pow(b / a, 1.0::DOUBLE / 3) - 1, 4) END AS value FROM p, o)
SELECT l_orderkey, operation, NOT mixed AS ok, CASE WHEN mixed THEN NULL WHEN operation IN ('percentage_change', 'cagr', 'margin') THEN value * 100 WHEN operation IN ('sum', 'difference', 'average') THEN round(value, 4) ELSE value END AS value, CASE WHEN mixed THEN 'unknown' WHEN operation = 'ratio' THEN 'ratio' WHEN operation = 'product' THEN 'unknown' WHEN operation IN ('sum', 'difference', 'average') THEN 'currency' ELSE 'percent' END AS unit_kind, CASE WHEN mixed THEN 'different currencies' END AS error FROM r""")
def calc_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight operations on each order's price and quantity; every fifth order's operands have different currencies."""
    p = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(*[F.sum(F.col(c).cast("decimal(18,2)")).cast(V.MONEY).alias(n) for c, n in (("l_extendedprice", "a"), ("l_quantity", "b"))])
    operand = lambda c, currency: F.struct(F.col(c).alias("value"), F.lit("currency").alias("unit_kind"), currency.alias("currency"))
    o = F.array(operand("a", F.lit("INR")), operand("b", F.when(F.col("l_orderkey") % 5 == 0, F.lit("USD")).otherwise(F.lit(None).cast("string"))))
    p = p.withColumn("f", V.operand_facts(o)).withColumn("operation", F.explode(F.array(*[F.lit(x) for x in _OPS]))).withColumn("r", V.operated(F.col("operation"), F.col("f"), F.lit(3)))
    v = V.presented(F.col("r"))
    return p.select("l_orderkey", "operation", "r.ok", F.when(F.col("operation") == "cagr", F.round("r.value", 4) * 100).when(F.col("operation").isin("sum", "difference", "average"), F.round(v, 4)).otherwise(v).alias("value"), "r.unit_kind", "r.error")


def _channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.round("o_totalprice", 2).cast("decimal(18,2)").cast(V.MONEY).alias("p"))
    k = F.col("o_orderkey")
    rows = F.array(
        F.struct(F.lit(0).alias("channel"), (k % 11 != 0).alias("available"), F.lit(True).alias("applicable"), F.col("p").alias("amount"), F.lit("unit").alias("scale"), F.lit("currency").alias("unit_kind"), F.lit("INR").alias("currency")),
        F.struct(F.lit(1).alias("channel"), (k % 13 != 0).alias("available"), F.lit(True).alias("applicable"), F.when(k % 5 == 0, (F.col("p") * 1000).cast(V.MONEY)).when(k % 5 == 1, (-F.col("p")).cast(V.MONEY)).when(k % 5 == 2, (F.col("p") * 2).cast(V.MONEY)).otherwise(F.col("p")).alias("amount"), F.lit("unit").alias("scale"), F.when(k % 17 == 0, "percent").otherwise("currency").alias("unit_kind"), F.when(k % 19 == 0, "USD").otherwise("INR").alias("currency")),
        F.struct(F.lit(2).alias("channel"), (k % 3 != 0).alias("available"), (k % 3 != 0).alias("applicable"), F.when(k % 7 == 0, (F.col("p") * 4).cast(V.MONEY)).otherwise(F.col("p")).alias("amount"), F.lit("unit").alias("scale"), F.lit("currency").alias("unit_kind"), F.lit(None).cast("string").alias("currency")),
    )
    return o.select("o_orderkey", F.inline(rows))


_CH = """o AS (SELECT o_orderkey AS k, round(o_totalprice, 2) AS p FROM orders),
c AS (SELECT k, 0 AS ch, k % 11 <> 0 AS u, true AS ap, p AS v, 'currency' AS uk, 'INR' AS cu FROM o UNION ALL
SELECT k, 1, k % 13 <> 0, true, CASE WHEN k % 17 = 0 THEN 0.01 ELSE 1 END * CASE k % 5 WHEN 0 THEN p * 1000 WHEN 1 THEN -p WHEN 2 THEN p * 2 ELSE p END, CASE WHEN k % 17 = 0 THEN 'percent' ELSE 'currency' END, CASE WHEN k % 19 = 0 THEN 'USD' ELSE 'INR' END FROM o UNION ALL
SELECT k, 2, k % 3 <> 0, k % 3 <> 0, CASE WHEN k % 7 = 0 THEN p * 4 ELSE p END, 'currency', NULL FROM o),
r AS (SELECT a.k, a.ch AS l, b.ch AS r, a.u AND b.u AS b2, a.uk <> b.uk AS unit, a.cu <> b.cu AS cur, a.v AS x, b.v AS y, CASE WHEN greatest(abs(a.v), abs(b.v)) = 0 THEN 0 ELSE abs(a.v - b.v) / greatest(abs(a.v), abs(b.v)) END AS rel FROM c a JOIN c b ON a.k = b.k AND a.ch < b.ch),
t AS (SELECT *, EXISTS (SELECT 1 FROM (SELECT unnest([-12, -9, -7, -6, -5, -3, -2, -1, 1, 2, 3, 5, 6, 7, 9, 12]) AS n) WHERE abs(abs(x) / abs(y) - pow(10.0::DOUBLE, n)) / greatest(abs(x) / abs(y), pow(10.0::DOUBLE, n)) <= 0.005) AS pow10 FROM r),
d AS (SELECT *, CASE WHEN NOT b2 THEN 'channel_unavailable' WHEN unit THEN 'unit_kind_mismatch' WHEN cur THEN 'currency_mismatch' WHEN (x > 0) <> (y > 0) AND x <> 0 AND y <> 0 THEN 'sign_mismatch' WHEN rel <= 0.005 THEN 'none' WHEN pow10 THEN 'scale_mismatch' ELSE 'magnitude_mismatch' END AS dis FROM t),
e AS (SELECT *, CASE dis WHEN 'channel_unavailable' THEN 0.5 WHEN 'none' THEN 1.0 WHEN 'magnitude_mismatch' THEN least(1.0, 0.005 / rel) ELSE 0.0 END::DOUBLE AS s FROM d)"""


@query(f"WITH {_CH} SELECT l AS left_channel, r AS right_channel, dis AS disagreement, count(*) AS n, round(sum(s), 4) AS total_score FROM e GROUP BY ALL")
def pair_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.pairs(_channels(spark, sf_dir), "o_orderkey").groupBy("left_channel", "right_channel", "disagreement").agg(F.count("*").alias("n"), rounded(F.sum("score"), "total_score", 4))


_REPORT = f"""{_CH}, n AS (SELECT k, count(*) FILTER (u) AS usable, count(*) FILTER (ap) AS applicable FROM c GROUP BY k),
g AS (SELECT k, min(s) FILTER (dis <> 'channel_unavailable') AS low, list_distinct(list(dis) FILTER (dis <> 'none')) AS kinds, count(*) FILTER (dis NOT IN ('none', 'channel_unavailable')) AS against, bool_or(l = 0 AND r = 1 AND dis = 'none') AS two, count(*) FILTER (r = 2 AND dis NOT IN ('none', 'channel_unavailable')) AS third FROM e GROUP BY k),
m AS (SELECT *, usable < 2 AS few, usable >= 2 AND two AND third > 0 AS conflict, CASE greatest(0, applicable - usable) WHEN 0 THEN 1.0 WHEN 1 THEN 0.9 WHEN 2 THEN 0.55 ELSE 0.5 END::DOUBLE AS coverage FROM n JOIN g USING (k)),
b AS (SELECT *, CASE WHEN few THEN 0.5 ELSE low END::DOUBLE AS base, CASE WHEN few THEN 'UNCERTAIN' WHEN conflict OR against > 0 THEN 'DISAGREE' ELSE 'AGREE' END AS verdict FROM m),
x AS (SELECT *, CASE WHEN few THEN 0.5 * coverage ELSE base * coverage * CASE WHEN conflict THEN 0.35 ELSE 1 END END::DOUBLE AS score,
 list_filter([CASE WHEN conflict THEN 0.9 END, CASE WHEN list_has_any(coalesce(kinds, []), ['scale_mismatch', 'sign_mismatch', 'currency_mismatch', 'unit_kind_mismatch']) THEN 0.85 END, 1 - base, 0.45 * (1 - coverage)]::DOUBLE[], lambda v: v > 0) AS signals FROM b),
y AS (SELECT *, CASE WHEN len(signals) = 0 THEN 0.0 ELSE 1 - (1 - list_reverse_sort(signals)[1]) * coalesce(list_product(list_transform(list_reverse_sort(signals)[2:], lambda v: 1 - 0.5 * v)), 1) END AS risk FROM x)"""


@query(f"WITH {_REPORT} SELECT k AS o_orderkey, verdict, round(score, 6) AS score, round(coverage, 2) AS coverage, usable, applicable FROM y")
def consistency_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.consistency(_channels(spark, sf_dir), "o_orderkey").select("o_orderkey", "verdict", rounded("score", "score"), rounded("coverage", "coverage", 2), "usable", "applicable")


@query(f"WITH {_REPORT} SELECT k AS o_orderkey, round(risk, 6) AS risk_score, CASE WHEN risk >= 0.6 THEN 'HIGH' WHEN risk >= 0.25 THEN 'MEDIUM' ELSE 'LOW' END AS risk_band FROM y")
def risk_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = C.risk(C.consistency(_channels(spark, sf_dir), "o_orderkey"), F.lit(3))
    return r.select("o_orderkey", rounded("risk_score", "risk_score"), "risk_band")


@query(f"""WITH {_REPORT} SELECT CASE WHEN applicable > usable THEN 'PARTIAL' ELSE 'VERIFIED' END AS evidence, CASE WHEN applicable < 3 THEN 'NOT_APPLICABLE' WHEN conflict THEN 'FAILED' ELSE 'VERIFIED' END AS arithmetic,
CASE verdict WHEN 'AGREE' THEN 'VERIFIED' WHEN 'UNCERTAIN' THEN 'PARTIAL' ELSE 'FAILED' END AS agreement, CASE WHEN list_has_any(coalesce(kinds, []), ['scale_mismatch', 'currency_mismatch', 'unit_kind_mismatch']) THEN 'FAILED' ELSE 'VERIFIED' END AS unit, count(*) AS n FROM y GROUP BY ALL""")
def facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = C.risk(C.consistency(_channels(spark, sf_dir), "o_orderkey"), F.lit(3))
    return r.groupBy(*[F.col("facets")[x].alias(x) for x in ("evidence", "arithmetic", "agreement", "unit")]).agg(F.count("*").alias("n"))


# Channels say their figures and reasons; orders other than every fourth have a reply, every eighth an earlier one too; the lines returned are the evidence.
def _said(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, ch = F.col("o_orderkey"), F.col("channel")
    reason = F.when(ch == 2, "not a calculation").when(k % 2 == 0, "declined: insufficient evidence")
    return _channels(spark, sf_dir).withColumns({"said": F.col("amount").cast("decimal(18,2)").cast("string"), "reason": reason, "sufficient": (ch != 0) | (k % 2 != 0), "executed": (ch == 1) & (k % 4 < 2)})


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_orderkey % 4 <> 3").select("o_orderkey", F.round("o_totalprice", 2).cast("decimal(18,2)").alias("p"))
    k = F.col("o_orderkey")
    says = lambda label, figure: F.concat(F.lit('{"resolution": "' + label + '", "answer": '), F.lit("null") if figure is None else F.concat(F.lit('"'), figure.cast("decimal(18,2)").cast("string"), F.lit('"')), F.lit("}"))
    final = F.when(k % 6 == 0, says("candidate_1", F.col("p"))).when(k % 6 == 1, says("candidate_2", F.col("p") * 2)).when(k % 6 == 2, says("neither", F.col("p") * 3)).when(k % 6 == 3, says("neither", None)).when(k % 6 == 4, says("unresolved", None)).otherwise("")
    tries = F.array_compact(F.array(F.struct(F.lit(2).alias("attempt"), final.alias("payload")), F.when(k % 8 == 0, F.struct(F.lit(1).alias("attempt"), says("neither", F.lit(7)).alias("payload")))))
    return o.select("o_orderkey", F.inline(tries), (k % 5 == 0).alias("swapped"))


_STAGED = f"""{_REPORT},
ev AS (SELECT l_orderkey AS k, list(('E' || l_linenumber || ': ' || l_linestatus) ORDER BY l_linenumber, l_linestatus) AS cites FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
rp AS (SELECT o_orderkey AS k, o_orderkey % 5 = 0 AS swapped, o_orderkey % 6 AS m, CASE o_orderkey % 6 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 END * round(o_totalprice, 2)::DECIMAL(18,2)::DECIMAL(38,6) AS value FROM orders WHERE o_orderkey % 4 <> 3),
sd AS (SELECT *, CASE WHEN m = 0 THEN CASE WHEN swapped THEN 'supports_b' ELSE 'supports_a' END WHEN m = 1 THEN CASE WHEN swapped THEN 'supports_a' ELSE 'supports_b' END WHEN m = 2 THEN 'own_answer' WHEN m = 3 THEN 'supports_neither' ELSE 'unresolved' END AS resolution FROM rp),
ch AS (SELECT k, max(v) FILTER (ch = 0 AND u) AS a, max(v) FILTER (ch = 1 AND u) AS b, max(v) FILTER (ch = 2 AND u) AS c FROM c GROUP BY k),
st AS (SELECT y.k, verdict, y.usable, y.applicable, coverage, conflict, kinds, base, few, coalesce(len(cites), 0) AS blocks, cites, sd.k IS NOT NULL AS ran, coalesce(resolution IN ('supports_a', 'supports_b', 'own_answer'), false) AS resolved, resolution, CASE WHEN m < 3 THEN value END AS said, a, b, c FROM y LEFT JOIN ev USING (k) LEFT JOIN sd ON y.k = sd.k AND verdict = 'DISAGREE' JOIN ch ON y.k = ch.k),
sg AS (SELECT *, list_reverse_sort(list_filter([CASE WHEN blocks = 0 THEN 1.0 END, CASE WHEN conflict THEN 0.9 END, CASE WHEN list_has_any(coalesce(kinds, []), ['scale_mismatch', 'sign_mismatch', 'currency_mismatch', 'unit_kind_mismatch']) THEN 0.85 END, 1 - base, 0.45 * (1 - coverage), CASE WHEN ran AND NOT resolved THEN 0.55 END]::DOUBLE[], lambda v: v > 0)) AS signals FROM st),
rk AS (SELECT *, CASE WHEN len(signals) = 0 THEN 0.0 ELSE 1 - (1 - signals[1]) * coalesce(list_product(list_transform(signals[2:], lambda v: 1 - 0.5 * v)), 1) END AS risk, coalesce(said, a, b, c) AS answer, CASE WHEN said IS NOT NULL THEN 'verification_agent' WHEN a IS NOT NULL THEN 'natural' WHEN b IS NOT NULL THEN 'program' WHEN c IS NOT NULL THEN 'deterministic' END AS source FROM sg)"""


@query(f"""WITH {_STAGED} SELECT k AS o_orderkey, verdict, ran AS arbiter_ran, resolution, resolved AS arbiter_resolved, blocks, round(answer::DOUBLE, 4) AS answer, source, answer IS NULL AND (k % 2 = 0 OR k % 4 < 2 OR (ran AND NOT resolved)) AS abstained, round(risk, 6) AS risk_score, answer IS NOT NULL AND risk >= 0.8 AS withheld FROM rk""")
def staged_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order answered in stages: channels compared, replies on disagreements alone, risk with evidence and arbiter, one answer."""
    a = _answered(spark, sf_dir)
    return a.select("o_orderkey", "verdict", "arbiter_ran", "resolution", "arbiter_resolved", "blocks", rounded(F.col("answer").cast("double"), "answer", 4), "source", "abstained", rounded("risk_score", "risk_score"), "withheld")


def _answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("pos"), F.col("l_linestatus").alias("citation"))
    return G.answered(_said(spark, sf_dir), _replies(spark, sf_dir), e, "o_orderkey", 0.8)


@query(f"""WITH {_STAGED}, f AS (SELECT o.*, k % 11 = 0 AS n0, k % 13 = 0 AS n1, k % 3 = 0 AS n2, CASE k % 5 WHEN 0 THEN p * 1000 WHEN 1 THEN -p WHEN 2 THEN p * 2 ELSE p END AS p1, CASE WHEN k % 7 = 0 THEN p * 4 ELSE p END AS p2 FROM o),
h AS (SELECT rk.*, coalesce(list_sort(list_intersect(coalesce(kinds, []), ['scale_mismatch', 'sign_mismatch', 'currency_mismatch', 'unit_kind_mismatch'])), []) AS hard, n0, n1, n2, p, p1, p2 FROM rk JOIN f USING (k))
SELECT k AS o_orderkey, coalesce(array_to_string(cites, '|'), '') AS citations,
'natural: ' || CASE WHEN n0 THEN 'produced no figure (' || CASE WHEN k % 2 = 0 THEN 'declined: insufficient evidence' ELSE 'unknown reason' END || ')' ELSE p::DECIMAL(18,2)::VARCHAR END || '|program: ' || CASE WHEN n1 THEN 'produced no figure (' || CASE WHEN k % 2 = 0 THEN 'declined: insufficient evidence' ELSE 'unknown reason' END || ')' ELSE p1::DECIMAL(18,2)::VARCHAR END
 || '|deterministic: ' || CASE WHEN n2 THEN 'does not apply to this question (not a calculation)' ELSE p2::DECIMAL(18,2)::VARCHAR END || CASE WHEN ran THEN '|arbiter: ' || resolution || coalesce(' -> ' || said::VARCHAR, '') ELSE '' END AS statements,
array_to_string(list_filter([CASE WHEN blocks = 0 THEN 'no passage was found' END, CASE WHEN conflict THEN 'the calculation contradicts channels that agree' END, CASE WHEN len(hard) > 0 THEN 'channels differ in kind: ' || array_to_string(hard, ', ') END, CASE WHEN coverage < 1 THEN 'a channel that could have confirmed the answer did not' END, CASE WHEN ran AND NOT resolved THEN 'the arbiter left the disagreement open' END], lambda x: x IS NOT NULL), '|') AS notes,
CASE WHEN blocks = 0 THEN 'retrieve_evidence' ELSE coalesce(nullif(array_to_string(list_filter([CASE WHEN verdict = 'UNCERTAIN' THEN 'second_channel' END, CASE WHEN applicable > usable THEN 'missing_channels' END, CASE WHEN verdict = 'DISAGREE' THEN 'check_cited_pages' END, CASE WHEN ran AND NOT resolved THEN 'arbiter_declined' END], lambda x: x IS NOT NULL), '|'), ''), 'nothing_flagged') END AS remedies,
CASE WHEN source = 'deterministic' THEN 1 ELSE 0 END + CASE WHEN blocks = 0 THEN 1 ELSE 0 END + 1 AS caveats FROM h""")
def explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is said about every order's answer: citations, each channel's statement, the notes on its risk, what would change it."""
    a = _answered(spark, sf_dir)
    joined = lambda c: F.array_join(c, "|")
    return a.select("o_orderkey", joined("citations").alias("citations"), joined("statements").alias("statements"), joined(F.slice("reasons", 5, F.size("reasons"))).alias("notes"), joined("remedies").alias("remedies"), F.size("caveats").alias("caveats"))


@query("""WITH f AS (SELECT l_orderkey AS question, l_returnflag AS metric, l_linenumber AS pos, l_quantity::DECIMAL(18,2) AS v FROM lineitem)
SELECT question, metric, CASE WHEN count(DISTINCT v) = 1 THEN min_by(v, pos) END::DOUBLE AS value, count(DISTINCT v) = 1 AS bound FROM f GROUP BY question, metric""")
def operand_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("question"), F.col("l_returnflag").alias("metric"), F.col("l_linenumber").alias("pos"), F.col("l_quantity").cast("decimal(18,2)").cast(V.MONEY).alias("amount"), F.lit("unit").alias("scale"), F.lit("count").alias("unit_kind"))
    return C.bind(f).select("question", "metric", F.col("value").cast("double").alias("value"), "bound")
