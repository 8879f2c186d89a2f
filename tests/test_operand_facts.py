"""Operand facts are worked out before operations are told apart, once for each row of operands."""

from pyspark.sql import functions as F

from ledgerlark.functions import values as V
from ledgerlark.plans import QUERIES


def test_facts_serve_every_operation(spark):
    o = F.array(*[F.struct(F.lit(v).cast(V.MONEY).alias("value"), F.lit(k).alias("unit_kind"), F.lit(c).alias("currency")) for v, k, c in ((8, "currency", "INR"), (2, "unknown", None))])
    ops = ["sum", "difference", "product", "average", "ratio", "margin", "percentage_change", "cagr", "other"]
    df = spark.range(1).select(V.operand_facts(o).alias("f")).select("f", F.explode(F.array(*[F.lit(x) for x in ops])).alias("op"))
    assert all(r.a == r.b for r in df.select(V.operated(F.col("op"), F.col("f"), F.lit(3)).alias("a"), V.calculate(F.col("op"), o, F.lit(3)).alias("b")).collect())


def test_lambdas_come_before_the_operations(spark):
    plan = QUERIES["calc_ops"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan.split("Generate explode")[0]
