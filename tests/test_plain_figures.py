"""Figures that need no reading of words: as parse() has them, and worked out once."""

from pyspark.sql import functions as F

from ledgerlark.functions import values as V
from ledgerlark.operators import binding, documents
from ledgerlark.plans import tables

FIGURES = ["1", "-12", "(1,234.50)", "( 7 )", "12,34,567", "1,23", "(5", "5)", "(-3.2)", "007", "1,234,567.891", "2024", None]


def test_plain_is_parse_on_figures(spark):
    d = spark.createDataFrame([(f, s, c, k) for f in FIGURES for s, c in ((None, None), ("crore", "INR")) for k in (None, "ratio")], "f string, s string, c string, k string")
    context = [F.col(x) for x in "sck"]
    for r in d.select("f", V.plain(F.col("f"), *context).alias("a"), V.parse(F.col("f"), *context).alias("b")).collect():
        assert r.a == r.b, r.f


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_facts_read_their_rows_once_for_each_use(spark):
    """Rows for labels and rows for facts: before, filters of explode() worked them out again, and figures were looked through for words."""
    plan = _plan(documents.facts(tables._chunks(spark, "/root/testdata/sf0.001"), tables.lexicon(spark)))
    assert plan.count(r"^\|(.+)\|") == 2
    assert r"\btrillions?\b" not in plan


def test_binding_reads_its_rows_once(spark):
    c = tables._chunks(spark, "/root/testdata/sf0.001")
    blocks = c.select(F.col("document_id").alias("question"), F.lit(1).alias("block"), "text", F.col("context_scale").alias("scale"), F.col("context_currency").alias("currency"), F.lit("p.1").alias("citation"))
    plan = _plan(binding.bound_rows(c.select(F.col("document_id").alias("question"), F.lit("goodwill").alias("metric"), F.lit(0).alias("pos")), blocks, tables.lexicon(spark)))
    assert plan.count(r"^\|(.+)\|") == 1 and r"\btrillions?\b" not in plan
