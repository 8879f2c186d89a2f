"""Question, audit, answer and sample queries over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import questions as Q
from .base import query, rounded, table
from .tables import lexicon

_TOK = "regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9][a-z0-9.,''-]*')"
_LEX = "lx AS (SELECT p_name AS alias, max(p_brand) AS canonical FROM part GROUP BY p_name)"
_TERMS = f"""{_LEX}, a AS (SELECT array_to_string({_TOK.format('alias')}, ' ') AS alias, canonical FROM lx), t AS (SELECT p_partkey, ' ' || array_to_string({_TOK.format("'What was ' || p_name || ' then'")}, ' ') || ' ' AS flat FROM part),
m AS (SELECT p_partkey, max_by(canonical, (length(alias), alias)) AS canonical FROM t JOIN a ON contains(flat, ' ' || alias || ' ') GROUP BY p_partkey)"""


def _lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names of all parts, an alias once."""
    return table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("alias")).agg(F.max("p_brand").alias("canonical"))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey") % 4
    text = F.concat(
        F.when(k == 0, "What was the total of ").when(k == 1, "What is the average ").when(k == 2, "What percentage change was there in ").otherwise("What was "), F.col("p_name"),
        F.when(k == 3, " for the year ended March 31, 2024?").when(k == 2, " from 2022-23 to 2023-24?").otherwise(" in 2021-22?"),
    )
    return p.select("p_partkey", text.alias("question"))


@query(f"""WITH {_TERMS} SELECT p_partkey, ['sum', 'average', 'percentage_change', 'lookup'][p_partkey % 4 + 1] AS operation, ['2021-22', '2021-22', NULL, '2023-24'][p_partkey % 4 + 1] AS fiscal_year, canonical AS metric,
['currency', 'currency', 'percent', 'currency'][p_partkey % 4 + 1] AS expected_unit, CASE WHEN p_partkey % 4 = 2 THEN 1 ELSE 0 END AS several_years, 1 AS sub_questions FROM part JOIN m USING (p_partkey)""")
def question_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions made of part names, read back to operation, year, metric by the names of all parts, and unit."""
    s = Q.specs(_asked(spark, sf_dir), "p_partkey", "question", _lexicon(spark, sf_dir))
    return s.select("p_partkey", "operation", "fiscal_year", "metric", "expected_unit", F.array_contains("ambiguities", "several_years").cast("int").alias("several_years"), F.size("sub_questions").alias("sub_questions"))


@query(f"WITH {_TERMS} SELECT * FROM m")
def lexicon_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest name of any part in each part's question."""
    t = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("What was "), "p_name", F.lit(" then")).alias("q"))
    return Q.longest_term(t, "p_partkey", "q", _lexicon(spark, sf_dir))



@query("""WITH o AS (SELECT o_orderkey, year(o_orderdate) + 10 AS y, month(o_orderdate) % 4 AS k FROM orders)
SELECT o_orderkey, CASE k WHEN 0 THEN 'ratio' WHEN 1 THEN 'ratio' WHEN 2 THEN 'percentage_change' ELSE 'lookup' END AS operation, CASE k WHEN 0 THEN y::VARCHAR || '-' || lpad(((y + 1) % 100)::VARCHAR, 2, '0') WHEN 1 THEN (y - 1)::VARCHAR || '-' || lpad((y % 100)::VARCHAR, 2, '0') END AS fiscal_year,
CASE k WHEN 0 THEN 'percent' WHEN 1 THEN 'ratio' WHEN 2 THEN 'percent' ELSE 'currency' END AS expected_unit, CASE k WHEN 0 THEN 'return on equity' WHEN 1 THEN 'current ratio' END AS derived_metric,
CASE k WHEN 0 THEN 'profit for the year|total equity' WHEN 1 THEN 'total current assets|total current liabilities' WHEN 2 THEN 'order ' || o_orderkey::VARCHAR || ' grow between' ELSE 'price order ' || o_orderkey::VARCHAR END AS searches FROM o""")
def sub_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions about each order and its year taken apart: components of derived metrics with the statement that reports them, or content words alone."""
    y, k, n = F.year("o_orderdate") + 10, F.month("o_orderdate") % 4, F.col("o_orderkey").cast("string")
    q = (
        F.when(k == 0, F.concat(F.lit("What was the return on equity for "), X.fiscal_label(y), F.lit("?"))).when(k == 1, F.concat(F.lit("What was the current ratio at March 31, "), y, F.lit("?")))
        .when(k == 2, F.concat(F.lit("By how much did order "), n, F.lit(" grow between March 31, "), y, F.lit(" and March 31, "), y + 1, F.lit("?"))).otherwise(F.concat(F.lit("What was the price of order "), n, F.lit("?")))
    )
    s = Q.specs(table(spark, sf_dir, "orders").select("o_orderkey", q.alias("q")), "o_orderkey", "q", lexicon(spark))
    return s.select("o_orderkey", "operation", "fiscal_year", "expected_unit", "derived_metric", F.array_join(F.transform("sub_questions", lambda x: x["search_text"]), "|").alias("searches"))


@query("""WITH p AS (SELECT o_orderkey, list_filter([CASE WHEN o_totalprice > 300000 THEN 'large' END, CASE WHEN o_orderstatus = 'P' THEN 'pending' END, CASE WHEN o_orderpriority LIKE '1%' THEN 'urgent' END], lambda x: x IS NOT NULL) AS problems FROM orders)
SELECT o_orderkey, array_to_string(problems, ',') AS problems FROM p WHERE len(problems) > 0""")
def record_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = Q.audit(table(spark, sf_dir, "orders"), "o_orderkey", {"large": F.col("o_totalprice") > 300000, "pending": F.col("o_orderstatus") == "P", "urgent": F.col("o_orderpriority").startswith("1")})
    return a.select("o_orderkey", F.array_join("problems", ",").alias("problems"))


_CASES = "c AS (SELECT l_orderkey, l_returnflag, l_linestatus, l_quantity > 10 AS correct, l_discount > 0.03 AS agreed FROM lineitem)"


@query(f"WITH {_CASES} SELECT l_returnflag, l_linestatus, count(*) FILTER (agreed AND NOT correct) AS count, count(*) FILTER (agreed) AS of_agreed, round(count(*) FILTER (agreed AND NOT correct)::DOUBLE / nullif(count(*) FILTER (agreed), 0), 6) AS share FROM c GROUP BY ALL")
def blind_spot(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "lineitem").withColumn("correct", F.col("l_quantity") > 10).withColumn("agreed", F.col("l_discount") > 0.03)
    return Q.blind_spot(c, "l_returnflag", "l_linestatus").select("l_returnflag", "l_linestatus", "count", "of_agreed", rounded("share", "share"))


@query("""WITH a AS (SELECT l_orderkey AS k, bool_or(l_quantity > 40) AS l FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), b AS (SELECT l_orderkey AS k, bool_or(l_quantity > 40) AS r FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT count(*) FILTER (l AND r) AS both, count(*) FILTER (l AND NOT r) AS only_left, count(*) FILTER (NOT l AND r) AS only_right, count(*) FILTER (NOT l AND NOT r) AS neither FROM a JOIN b USING (k)""".replace(" AS both", ' AS "both"'))
def paired_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.bool_or(F.col("l_quantity") > 40).alias("ok"))
    return Q.paired(c, "l_orderkey", "l_returnflag", "A", "R", "ok")


@query("""WITH b AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS b FROM orders QUALIFY b <= 500), a AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice * (1 + o_orderkey % 3) DESC, o_orderkey) AS a FROM orders QUALIFY a <= 500)
SELECT count(*) FILTER (coalesce(a <= 100, false) AND NOT coalesce(b <= 100, false)) AS entered, count(*) FILTER (coalesce(b <= 100, false) AND NOT coalesce(a <= 100, false)) AS "left", count(*) FILTER (a <= 100 AND b <= 100) AS stayed FROM b FULL JOIN a USING (o_orderkey)""")
def rank_movement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a second ordering moves into and out of the top hundred."""
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders")
    top = lambda c: o.select("o_orderkey", c.alias("s")).orderBy(F.desc("s"), "o_orderkey").limit(500).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("s"), "o_orderkey")))
    return Q.movement(top(F.col("o_totalprice")), top(F.col("o_totalprice") * (1 + F.col("o_orderkey") % 3)), "o_orderkey", 100)


@query("""WITH f AS (SELECT l_orderkey AS document_id, l_returnflag AS metric, year(l_shipdate) AS year, l_linenumber AS page, l_quantity AS amount FROM lineitem)
SELECT 'FI' || substr(sha256(document_id::VARCHAR || '|' || metric || '|' || year::VARCHAR), 1, 8) AS qid, max(amount)::DOUBLE AS answer, array_to_string(list_sort(list_distinct(list(page))), ',') AS pages FROM f GROUP BY document_id, metric, year HAVING count(DISTINCT amount) = 1""")
def question_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_returnflag").alias("metric"), F.year("l_shipdate").alias("year"), F.col("l_linenumber").alias("page"), F.col("l_quantity").alias("amount"))
    return Q.candidates(f).select("qid", F.col("answer").cast("double").alias("answer"), F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"))


@query()
def self_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's lines as samples of one answer: the share of the largest cluster of near values, and the risk that follows."""
    s = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("pos"), "l_quantity")
    return Q.modal_fraction(s, "l_orderkey", "l_quantity", 0.1)


@query("""SELECT conv_id, CASE WHEN bool_or(role = 'assistant' AND length(text) > 0) THEN 'answered' ELSE 'abstained' END AS outcome, count(*) FILTER (role = 'user') AS asked, sum(length(text) // 4)::BIGINT AS tokens FROM conversations GROUP BY conv_id""")
def channel_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max(F.when((F.col("role") == "assistant") & (F.length("text") > 0), F.col("text"))).alias("value"), F.count_if(F.col("role") == "user").alias("asked"), F.sum(F.floor(F.length("text") / 4)).cast("long").alias("tokens"))
    return c.select("conv_id", Q.outcome(F.col("value").isNotNull(), F.lit("channel declined to answer"), F.lit(None).cast("string")).alias("outcome"), "asked", "tokens")
