"""Queries on arms, budgets and run records: nations are arms, orders are questions, events are calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import api
from ..operators import campaign as C
from .base import query, rounded, table

_A = """a AS (SELECT n_name AS name, n_nationkey AS k, k % 2 = 0 AS nat, k % 3 <> 0 AS prog, k % 5 = 0 AS det, k % 4 <> 1 AS cons, k % 7 < 3 AS arb, k % 6 AS samples, k % 8 = 0 AS same, CASE WHEN k % 9 = 4 THEN 'magic' ELSE 'hybrid' END AS retrieval FROM (SELECT *, n_nationkey AS k FROM nation))"""


def _arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("name"), (k % 2 == 0).alias("use_natural"), (k % 3 != 0).alias("use_program"), (k % 5 == 0).alias("use_deterministic"), (k % 4 != 1).alias("use_consistency"), (k % 7 < 3).alias("use_verification_agent"), (k % 6).alias("self_consistency_samples"),
        (k % 8 == 0).alias("same_model_both_channels"), F.when(k % 9 == 4, "magic").otherwise("hybrid").alias("retrieval"),
    )


@query(f"""WITH {_A}, p AS (SELECT name, list_filter([CASE WHEN NOT (nat OR prog) THEN 'no_reasoning_channel' END, CASE WHEN retrieval = 'magic' THEN 'unknown_retrieval' END, CASE WHEN cons AND nat::INT + prog::INT + det::INT < 2 THEN 'nothing_to_compare' END, CASE WHEN arb AND NOT cons THEN 'arbiter_without_consistency' END, CASE WHEN samples = 1 THEN 'one_sample' END], lambda x: x IS NOT NULL) AS p FROM a)
SELECT name, array_to_string(p, ',') AS problems FROM p WHERE len(p) > 0""")
def arm_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.arm_problems(_arms(spark, sf_dir)).select("name", F.array_join("problems", ",").alias("problems"))


@query(f"WITH {_A} SELECT name FROM a WHERE cons OR samples > 1")
def detector_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.detectors(_arms(spark, sf_dir)).select("name")


_CALLS = f"""{_A}, c AS (SELECT name, 'natural_channel' AS role, greatest(1, samples) AS n FROM a WHERE nat UNION ALL SELECT name, CASE WHEN same THEN 'natural_channel' ELSE 'program_channel' END, 1 FROM a WHERE prog UNION ALL SELECT name, 'verification_agent', 1 FROM a WHERE arb), q AS (SELECT count(*) AS q FROM orders)"""


@query(f"WITH {_CALLS} SELECT name, role, (sum(n) * any_value(q))::BIGINT AS requests, coalesce(sum(n) FILTER (role = 'verification_agent') * any_value(q), 0)::BIGINT AS arbiter_upper_bound FROM c, q GROUP BY GROUPING SETS ((name, role), (name), ())")
def request_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that all orders as questions take, of each arm and role, of each arm, and in all."""
    return C.budget(_arms(spark, sf_dir), table(spark, sf_dir, "orders").count())


@query(f"WITH {_CALLS} SELECT CASE role WHEN 'natural_channel' THEN 'red' ELSE 'blue' END AS provider, (sum(n) * any_value(q))::BIGINT AS requests, (sum(n) * any_value(q) * 3780)::BIGINT AS tokens FROM c, q WHERE role <> 'verification_agent' GROUP BY 1")
def provider_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = spark.createDataFrame([("natural_channel", "red", "m1"), ("program_channel", "blue", "m2")], "role string, provider string, model string")
    return C.by_provider(_arms(spark, sf_dir), b, table(spark, sf_dir, "orders").count(), 2000)


@query("""SELECT r_name AS arm, o_orderkey AS question_id FROM region, orders WHERE NOT (o_orderkey % 3 = r_regionkey)""")
def campaign_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of arm and question that have no record yet."""
    from ..sources.records import remaining

    g = C.grid(table(spark, sf_dir, "region").select(F.col("r_name").alias("name")), table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("question_id")))
    done = g.join(table(spark, sf_dir, "region"), F.col("arm") == F.col("r_name")).where("question_id % 3 = r_regionkey").select("arm", F.col("question_id").cast("string").alias("question_id"))
    done = C.completed(done).select("arm", F.col("question_id").cast("long").alias("question_id"))
    return remaining(g, done).select("arm", "question_id")


@query("""SELECT event_id, date_trunc('day', ts) + INTERVAL 1 DAY AS next_reset, CASE WHEN event_id % 4 <> 0 THEN greatest(0, 100 - CASE WHEN event_id % 2 = 0 THEN 0 ELSE event_id % 150 END)::BIGINT END AS left_today, greatest(0, date_diff('day', date_trunc('day', ts) + INTERVAL 1 DAY, TIMESTAMP '2030-01-01 00:00:00'))::INT AS whole_days FROM events""")
def allowances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each call's provider still allows that day, when it resets, and the whole days before a deadline."""
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    now = F.col("ts").cast("timestamp")
    day = F.when(k % 2 == 1, F.to_date(now)).otherwise(F.date_sub(F.to_date(now), 1))
    left = C.tokens_available(F.when(k % 4 != 0, 100), day, k % 150, now)
    return e.select("event_id", C.next_reset(F.col("ts")).alias("next_reset"), left.cast("long").alias("left_today"), C.whole_days_before(F.lit("2030-01-01 00:00:00").cast("timestamp"), now).alias("whole_days"))


@query("""WITH u AS (SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS p, event_id % 50 AS c, event_id % 20 AS r, event_id % 200 AS t FROM events)
SELECT event_type, sum(greatest(t, p + c + r))::BIGINT AS tokens, sum(greatest(c + r, t - p, 0))::BIGINT AS billable, round(sum((p * 0.5 + c * 1.5) / 1000000.0::DOUBLE), 9) AS cost, bool_and(p % 2 = 0) AS cached FROM u GROUP BY event_type""")
def usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens by what is reported or adds up, output that is paid for, cost at a paid rate."""
    k = F.col("event_id")
    e = table(spark, sf_dir, "events").select("event_type", F.get_json_object("props", "$.k").cast("long").alias("p"), (k % 50).alias("c"), (k % 20).alias("r"), (k % 200).alias("t"))
    u = [F.col(x) for x in ("p", "c", "r", "t")]
    return e.groupBy("event_type").agg(F.sum(C.usage_total(*u)).alias("tokens"), F.sum(C.billable_output(*u)).alias("billable"), rounded(F.sum(C.equivalent_cost(F.col("p"), F.col("c"), F.lit(0.5), F.lit(1.5))), "cost", 9), F.bool_and(F.col("p") % 2 == 0).alias("cached"))


@query("""WITH n AS (SELECT length(coalesce(text, '')) // 4 AS n FROM documents), s AS (SELECT n, row_number() OVER (ORDER BY n) AS i, count(*) OVER () AS c FROM n) SELECT quantile_cont(n, 0.5) AS median, max(n) FILTER (i = floor(c * 0.9::DOUBLE)) AS p90, max(n) AS max FROM s""")
def prompt_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.prompt_cost(table(spark, sf_dir, "documents").select(F.floor(F.length(F.coalesce("text", F.lit(""))) / 4).alias("n")), "n")


# --- reads over projected tables: answers are orders, questions customers, experiments nations, evidence and results lines and suppliers ---


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("id"), (k % 25).alias("experiment_id"), F.col("o_custkey").alias("question_id"), F.concat(F.lit("arm"), (k % 3).cast("string")).alias("arm"), F.when(k % 2 == 0, True).alias("correct"))


def _experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.when(F.col("n_nationkey") == 7, api.LIVE).otherwise(F.col("n_name")).alias("run_id"))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("Q"), F.col("c_custkey").cast("string")).alias("qid"), F.col("c_name").alias("text"))


_R = """e AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey = 7 THEN 'live' ELSE n_name END AS run_id FROM nation), a AS (SELECT o_orderkey AS id, o_orderkey % 25 AS experiment_id, o_custkey AS question_id, 'arm' || (o_orderkey % 3)::VARCHAR AS arm, CASE WHEN o_orderkey % 2 = 0 THEN true END AS correct FROM orders),
r AS (SELECT s_suppkey AS id, s_nationkey AS experiment_id, 'arm' || (s_suppkey % 3)::VARCHAR AS arm, 'auroc' AS metric, s_suppkey::VARCHAR AS stratum, s_acctbal AS value FROM supplier)"""


@query(f"WITH {_R} SELECT a.id, run_id, c_name AS question, arm FROM a JOIN e ON e.id = experiment_id JOIN customer ON c_custkey = question_id WHERE arm = 'arm1' ORDER BY a.id DESC LIMIT 200")
def answers_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest answers of one arm, with their run and question."""
    return api.list_answers(_answers(spark, sf_dir), _experiments(spark, sf_dir), _asked(spark, sf_dir), arm="arm1").select("id", "run_id", "question", "arm")


@query(f"WITH {_R}, n AS (SELECT e.id, run_id, (SELECT count(*) FROM a WHERE experiment_id = e.id) AS answers, (SELECT count(*) FROM r WHERE experiment_id = e.id) AS results FROM e) SELECT * FROM n WHERE run_id <> 'live' AND (answers > 0 OR results > 0)")
def experiments_with_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.with_data(api.list_experiments(_experiments(spark, sf_dir), _answers(spark, sf_dir), _results(spark, sf_dir)))


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("id"), F.col("s_nationkey").cast("long").alias("experiment_id"), F.concat(F.lit("arm"), (k % 3).cast("string")).alias("arm"), F.lit("auroc").alias("metric"), k.cast("string").alias("stratum"), F.col("s_acctbal").alias("value"))


@query(f"WITH {_R} SELECT run_id, arm, metric, stratum, value FROM r JOIN e ON e.id = experiment_id WHERE arm = 'arm2'")
def results_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.evaluation_results(_results(spark, sf_dir), _experiments(spark, sf_dir), arm="arm2", metric="auroc").select("run_id", "arm", "metric", "stratum", "value")


@query(f"WITH {_R} SELECT DISTINCT arm FROM a")
def recorded_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.recorded_arms(_answers(spark, sf_dir))


@query(f"WITH {_R} SELECT 'answers' AS relation, count(*) AS n FROM a WHERE experiment_id <> 7 UNION ALL SELECT 'graded', count(correct) FROM a WHERE experiment_id <> 7 UNION ALL SELECT 'questions', count(*) FROM customer")
def api_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the tables, the live run's answers left out."""
    return api.corpus_stats(_answers(spark, sf_dir), _experiments(spark, sf_dir), questions=table(spark, sf_dir, "customer"))


@query("""WITH n AS (SELECT l_orderkey, l_linenumber, l_quantity, l_linenumber % 2 = 0 AS fresh FROM lineitem) SELECT l_orderkey AS experiment_id, l_linenumber AS question_id, CASE WHEN fresh THEN l_quantity * 2 ELSE l_quantity END AS risk_score, CASE WHEN fresh AND l_linenumber % 4 = 0 THEN true END AS correct FROM n""")
def run_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second answer recorded again, half of them graded; the others stay as they were."""
    l = table(spark, sf_dir, "lineitem")
    old = l.select(F.col("l_orderkey").alias("experiment_id"), F.col("l_linenumber").alias("question_id"), F.lit("A").alias("arm"), F.col("l_quantity").alias("risk_score"), F.lit(None).cast("boolean").alias("correct"))
    new = l.where("l_linenumber % 2 = 0").select(F.col("l_orderkey").alias("experiment_id"), F.col("l_linenumber").alias("question_id"), F.lit("A").alias("arm"), (F.col("l_quantity") * 2).alias("risk_score"), F.when(F.col("l_linenumber") % 4 == 0, True).alias("correct"))
    return api.upsert(old, new, ["experiment_id", "question_id", "arm"]).select("experiment_id", "question_id", "risk_score", "correct")
