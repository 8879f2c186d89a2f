"""What a row of a staged answer costs: its reply is parsed once, its signals and texts are code that is generated, in methods that the JVM compiles."""

from __future__ import annotations

from ledgerlark.operators import verify as C
from ledgerlark.plans import QUERIES
from pyspark.sql import functions as F


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_reply_is_parsed_once(spark):
    plan = _plan(QUERIES["explanations"](spark, "/root/testdata/sf0.001"))
    assert plan.count("from_json(") == 1


def test_signals_are_no_interpreted_fold(spark):
    assert "aggregate(" not in _plan(QUERIES["risk_score"](spark, "/root/testdata/sf0.001"))


def test_methods_of_rows_are_compiled(spark):
    QUERIES["consistency_report"](spark, "/root/testdata/sf0.001")
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000


def test_combined_is_combine(spark):
    rows = [(0.0, 0.0, 0.0), (1.0, 0.5, 0.9), (0.85, 0.045, 0.5), (0.0, None, 0.3), (0.2, 0.2, 0.2), (None, None, None)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    for r in df.select(C.combine(F.array("a", "b", "c")).alias("x"), C.combined(F.col("a"), F.col("b"), F.col("c")).alias("y")).collect():
        assert abs(r.x - r.y) < 1e-12
