"""Read queries over the projected tables; orders, customers and nations stand in for answers,
questions and experiments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from functools import reduce

from ..operators import ingest as G
from ..operators import projection as P
from ..sources.shared import scratch
from .base import query, rounded, table


@query("""SELECT o_custkey, o_orderkey, c_name, n_name FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS i FROM orders) o JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE i = 1""")
def latest_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = P.latest(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"]).select("o_custkey", "o_orderkey", "c_name", "n_name")


@query("SELECT s_suppkey, s_name, n_name FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey AND n_regionkey < 3 ORDER BY s_suppkey LIMIT 50")
def documents_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation").where("n_regionkey < 3")
    return s.join(n, s["s_nationkey"] == n["n_nationkey"], "left").select("s_suppkey", "s_name", "n_name").orderBy("s_suppkey").limit(50)


@query("""SELECT n_nationkey, n_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers FROM nation""")
def experiments_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return P.counts_of(n, "n_nationkey", customers=table(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "n_nationkey"), suppliers=table(spark, sf_dir, "supplier").withColumnRenamed("s_nationkey", "n_nationkey"))


@query("""SELECT o_orderkey, o_custkey, o_orderpriority, c_mktsegment FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING' AND o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 100""")
def results_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'"), table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).orderBy(F.desc("o_orderdate"), "o_orderkey").limit(100).select("o_orderkey", "o_custkey", "o_orderpriority", "c_mktsegment")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def prune_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return P.stale(table(spark, sf_dir, "lineitem"), live, ["l_orderkey"]).select("l_orderkey", "l_linenumber")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice FROM orders""")
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third order replaced by a new version."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return P.upsert(o, o.where("o_orderkey % 3 = 0").withColumn("o_totalprice", F.col("o_totalprice") * 2), ["o_orderkey"])


@query("""SELECT 'region' AS relation, count(*) AS n FROM region UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'finished', count(*) FROM orders WHERE o_orderstatus = 'F'""")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "orders").agg(F.lit("finished").alias("relation"), F.count_if(F.col("o_orderstatus") == "F").alias("n"))
    for name in ("region", "orders", "lineitem"):
        out = out.union(table(spark, sf_dir, name).agg(F.lit(name), F.count("*")))
    return out


@query("""WITH a AS (SELECT l_returnflag, round(avg(l_quantity), 4) AS mean_quantity, round(avg(l_discount), 6) AS mean_discount, max(l_tax) AS top_tax FROM lineitem GROUP BY l_returnflag)
SELECT l_returnflag, metric, value FROM a UNPIVOT (value FOR metric IN (mean_quantity, mean_discount, top_tax))""")
def metric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(rounded(F.avg("l_quantity"), "mean_quantity", 4), rounded(F.avg("l_discount"), "mean_discount"), F.max("l_tax").alias("top_tax"))
    return P.melt(a, ["l_returnflag"], ["mean_quantity", "mean_discount", "top_tax"])


@query("""SELECT o_orderkey, o_orderdate, arg_min(l_linenumber, (abs(epoch_us(l_shipdate) - epoch_us(o_orderdate)), l_shipdate, l_linenumber)) AS line FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderdate""")
def nearest_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line shipped nearest to its order's date."""
    o, l = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), table(spark, sf_dir, "lineitem")
    j = o.join(l, o["o_orderkey"] == l["l_orderkey"])
    far = F.abs(F.unix_micros(F.col("l_shipdate").cast("timestamp")) - F.unix_micros(F.col("o_orderdate").cast("timestamp")))
    return j.groupBy("o_orderkey", "o_orderdate").agg(F.min_by("l_linenumber", F.struct(far, F.col("l_shipdate"), F.col("l_linenumber"))).alias("line"))


@query("""WITH n AS (SELECT * FROM nation WHERE n_regionkey <> 2), c AS (SELECT * FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM n)), s AS (SELECT * FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM n)),
o AS (SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c)), l AS (SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o) AND l_suppkey IN (SELECT s_suppkey FROM s))
SELECT 'region' AS relation, count(*) AS n, sum(r_regionkey)::BIGINT AS keys FROM region WHERE r_regionkey <> 2 UNION ALL SELECT 'nation', count(*), sum(n_nationkey) FROM n UNION ALL SELECT 'customer', count(*), sum(c_custkey) FROM c
UNION ALL SELECT 'supplier', count(*), sum(s_suppkey) FROM s UNION ALL SELECT 'orders', count(*), sum(o_orderkey) FROM o UNION ALL SELECT 'lineitem', count(*), sum(l_orderkey) FROM l""")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region goes with all that refers to it: nations, their customers and suppliers, orders, and lines by either way."""
    relations = [("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey")]
    keys = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "orders": "o_orderkey", "lineitem": "l_orderkey"}
    tables = {t: table(spark, sf_dir, t) for t in keys}
    left = G.cascade(tables, "region", tables["region"].where("r_regionkey = 2").select("r_regionkey"), relations)
    return reduce(DataFrame.union, [left[t].agg(F.lit(t).alias("relation"), F.count("*").alias("n"), F.sum(k).cast("long").alias("keys")) for t, k in keys.items()])


@query("""WITH r AS (SELECT o_orderkey % 3 AS arm, c_custkey AS q, max_by({'price': o_totalprice, 'status': o_orderstatus}, o_orderkey) AS v FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_custkey % 10 > 0 GROUP BY ALL)
SELECT 'companies' AS relation, count(DISTINCT source) AS n, 1 AS version FROM documents UNION ALL SELECT 'documents', count(*), 1 FROM documents UNION ALL SELECT 'questions', count(*), 1 FROM customer WHERE c_custkey % 10 > 0
UNION ALL SELECT 'evidence', count(*), 1 FROM customer WHERE c_custkey % 10 > 0 UNION ALL SELECT 'experiments', 1, 1 UNION ALL SELECT 'answers', count(*), 2 FROM r UNION ALL SELECT 'verification_runs', count(*), 1 FROM r
UNION ALL SELECT 'reasoning_runs', count(*) FILTER (v.status <> 'P'), 1 FROM r UNION ALL SELECT 'program_runs', count(*) FILTER (v.status = 'F'), 2 FROM r""")
def full_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, customers as questions and orders as a run's answers, ingested; again without change; and with half the programs first missing and other verdicts."""
    d, path = table(spark, sf_dir, "documents"), scratch(spark, "ingest")
    registry = d.select(F.col("doc_id").cast("string").alias("document_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"), F.lit("f").alias("filename"), F.col("source").alias("company"), F.col("lang").alias("fiscal_year"), F.lit(1).alias("page_count"))
    c = table(spark, sf_dir, "customer").where("c_custkey % 10 > 0")
    span = F.array(F.struct(F.lit("g").alias("group_id"), F.array(F.struct(F.lit(1).alias("page"), F.array(F.col("c_name")).alias("anchors"))).alias("any_of")))
    dataset = c.select(F.concat(F.lit("Q"), "c_custkey").alias("qid"), F.col("c_name").alias("question"), F.lit(None).cast("string").alias("document_id"), F.lit("test").alias("split"), F.lit("1").alias("answer"), F.lit("INR").alias("unit"), F.lit("validated").alias("status"), span.alias("evidence"))
    channel = lambda on: F.when(on, F.struct(F.lit(True).alias("available"), F.lit(None).cast("string").alias("failure_reason"), F.col("o_totalprice").cast("string").alias("value"), F.col("o_totalprice").cast("double").alias("canonical")))
    none = {k: F.lit(None).cast("string" if k in ("verdict", "error") else "double") for k in ("verdict", "consistency_score", "risk_score", "latency_seconds", "error")}

    def records(programs) -> DataFrame:
        o = table(spark, sf_dir, "orders").select(F.concat(F.lit("Q"), "o_custkey").alias("question_id"), (F.col("o_orderkey") % 3).cast("string").alias("arm"), F.col("o_orderkey").alias("written"), F.col("o_totalprice").cast("string").alias("answer"), F.lit(False).alias("abstained"), programs.isNotNull().alias("agreed"), channel(F.col("o_orderstatus") != "P").alias("natural"), channel((F.col("o_orderstatus") == "F") & programs).alias("program"))
        return o.withColumns({**none, "verification": F.lit(None).cast("struct<triggered:boolean,available:boolean,resolution:string,resolved:boolean,value:string>")})

    graded = spark.createDataFrame([], "arm string, qid string, correct boolean, stratum string, label struct<provenance:string,kind:string,confidence:string,counts_as_hallucination:boolean>")
    half = F.when(F.col("o_orderkey") % 2 == 0, F.lit(True))
    for programs in (half, F.lit(True), F.lit(True)):
        counts = G.ingest(spark, path, registry=registry, dataset=dataset, runs={"run": (records(programs), graded, {})})
    if any(changed for _, changed in counts.values()):
        raise AssertionError("the same sources changed something")
    m = spark.read.schema(G.MANIFEST).json(f"{path}/manifest").groupBy(F.col("collection").alias("relation")).agg(F.max_by("n", "version").alias("n"), F.max("version").cast("int").alias("version"))
    return m.where("relation <> 'hallucination_events'")
