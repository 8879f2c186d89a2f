"""Operands read from rows of evidence, and the figures worked out from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tables as B
from ..functions import values as V
from .documents import _rows

# The operations that the deterministic channel can check.
CHECKED = ["sum", "difference", "ratio", "margin", "average", "percentage_change", "percentage_of", "cagr"]


def labels(metrics: DataFrame, lexicon: DataFrame) -> DataFrame:
    """metrics (question, metric, pos) with the names a row may have: all of the metric's in the lexicon (alias, canonical), else its own."""
    own = lexicon.select(F.lower("canonical").alias("canonical"), F.lower("alias").alias("alias"))
    own = own.union(own.select("canonical", "canonical")).distinct()
    names = own.groupBy("canonical").agg(F.collect_set("alias").alias("names"))
    key = own.groupBy("alias").agg(F.min("canonical").alias("canonical"))
    m = metrics.withColumn("alias", F.lower(F.trim("metric"))).join(F.broadcast(key), "alias", "left").join(F.broadcast(names), "canonical", "left")  # a lexicon is small; few aliases would be few tasks
    return m.select("question", "metric", "pos", F.coalesce("names", F.array("alias")).alias("names"))


def bound_rows(metrics: DataFrame, blocks: DataFrame, lexicon: DataFrame, column: int = 0) -> DataFrame:
    """Each row of a question's evidence that a metric denotes, with the figure in the column asked for.

    blocks: question, block (position), text, scale, currency, citation.  A name and a row meet on the row's opening letters,
    an equality, before the whole rule is tested: equal, or at most four letters longer."""
    rows = blocks.select("question", "block", "scale", "currency", "citation", F.posexplode_outer(_rows(F.col("text"))).alias("line", "cells")).withColumn("label", F.get("cells", F.lit(0))).where("label <> ''")
    short = F.regexp_replace(F.regexp_replace(F.lower(F.trim("label")), r"\s+", " "), r"^[ :*#]+|[ :*#]+$", "")
    rows = rows.withColumn("own", short).withColumn("figure", F.get(B.row_figures(F.col("cells")), F.lit(column))).withColumn("name", F.explode_outer(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(B.ROW_SLACK)), lambda k: F.substring(F.col("own"), F.lit(1), F.length("own") - k)))))
    names = labels(metrics, lexicon).select("question", "metric", "pos", F.explode("names").alias("name"))
    hit = rows.where("name <> ''").drop("cells", "own").join(names, ["question", "name"]).groupBy("question", "metric", "pos", "block", "line").agg(*[F.first(c).alias(c) for c in ("figure", "label", "scale", "currency", "citation")])
    hit = hit.where("figure is not null").withColumn("v", V.plain(F.col("figure"), F.col("scale"), F.col("currency")))
    return hit.select("question", "metric", "pos", "block", "line", "label", "citation", "v", V.canonical(F.col("v.amount"), F.col("v.scale"), F.col("v.unit_kind")).alias("canonical"))


def bind_operands(metrics: DataFrame, blocks: DataFrame, lexicon: DataFrame, column: int = 0) -> DataFrame:
    """One row for each metric asked for: bound to its first row if all its rows agree on one value, else unbound, and why."""
    hit = bound_rows(metrics, blocks, lexicon, column)
    g = hit.groupBy("question", "pos").agg(F.count_distinct("canonical").alias("values"), F.count("*").alias("rows"), F.min_by(F.struct("canonical", F.col("v.unit_kind").alias("unit_kind"), F.col("v.currency").alias("currency"), F.col("label").alias("row_label"), "citation"), F.struct("block", "line")).alias("b"))
    one = F.col("values") == 1
    return metrics.join(g, ["question", "pos"], "left").select(
        "question", "metric", "pos", F.coalesce(one, F.lit(False)).alias("bound"), F.when(one, F.col("b.canonical")).alias("value"), F.when(one, F.col("b.unit_kind")).alias("unit_kind"), F.when(one, F.col("b.currency")).alias("currency"),
        F.when(one, F.col("b.row_label")).alias("row_label"), F.when(one, F.col("b.citation")).alias("citation"), F.when(F.col("rows").isNull(), "no_row").when(~one, "rows_disagree").alias("note"),
    )


def deterministic(specs: DataFrame, operands: DataFrame) -> DataFrame:
    """specs (question, operation, years), operands as of bind_operands(): the figure that arithmetic alone gives.

    applicable is false for look-ups, other operations and questions without operands; available only where every operand is
    bound and the operation defined."""
    g = operands.groupBy("question").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("value"), "unit_kind", "currency"))).alias("o"), F.bool_and("bound").alias("complete"))
    s = specs.join(g, "question", "left").withColumn("o", F.transform("o", lambda x: F.struct(x["value"].cast(V.MONEY).alias("value"), x["unit_kind"].alias("unit_kind"), x["currency"].alias("currency"))))
    applicable = F.col("operation").isin(CHECKED) & F.coalesce(F.size("o") > 0, F.lit(False))
    s = s.withColumn("r", F.when(applicable & F.col("complete"), V.calculate(F.col("operation"), F.col("o"), F.col("years"))))
    reason = F.when(F.col("operation") == "lookup", "no arithmetic to verify").when(~F.col("operation").isin(CHECKED), "operation outside the vocabulary").when(~applicable, "no operands").when(~F.col("complete"), "operands not bound").when(~F.col("r.ok"), F.col("r.error"))
    return s.select("question", "operation", applicable.alias("applicable"), F.coalesce(F.col("r.ok"), F.lit(False)).alias("available"), V.presented(F.col("r")).alias("value"), F.col("r.unit_kind").alias("unit_kind"), F.col("r.currency").alias("currency"), reason.alias("failure_reason"))


def binding_coverage(rows: DataFrame, by: str) -> DataFrame:
    """rows (by, bound, agreement): how many are bound, can be compared, and agree; shares are null where nothing is there."""
    g = rows.groupBy(by).agg(F.count("*").alias("n"), F.count_if("bound").alias("bound"), F.count_if(F.col("bound") & F.col("agreement").isNotNull()).alias("comparable"), F.count_if(F.col("bound") & F.col("agreement")).alias("agreed"))
    return g.withColumn("coverage", F.try_divide("bound", "n")).withColumn("agreement", F.try_divide("agreed", "comparable"))
