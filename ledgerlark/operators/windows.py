"""Ordered operators: forward fill, runs, repeated lines, splits, sliding rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .selection import cut_by_hash, numbered


def forward_fill(rows: DataFrame, by: list[str], order: list[str], column: str, source: str | None = None) -> DataFrame:
    """The last value not null so far, and the place it came from."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn(f"{column}_filled", F.last(column, ignorenulls=True).over(w))
    return out if source is None else out.withColumn(f"{column}_source", F.last(F.when(F.col(column).isNotNull(), F.col(source)), ignorenulls=True).over(w))


def runs(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Stretches of equal neighbours: the value with the first and last place and the length."""
    w = Window.partitionBy(*by).orderBy(*order)
    new = (~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    marked = rows.withColumn("__new", new).withColumn("run", F.sum("__new").over(w))
    return marked.groupBy(*by, "run", value).agg(F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count("*").alias("n"))


def repeated_lines(pages: DataFrame, document: str, page: str, text: str) -> DataFrame:
    """Lines of 4 to 119 letters on at least max(3, half) of a document's pages, not digits alone; four pages at least."""
    n = pages.groupBy(document).agg(F.count_distinct(page).alias("pages"))
    lines = pages.select(document, page, F.explode(F.array_distinct(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda x: F.trim(x)))).alias("line")).where("length(line) between 4 and 119 and not line rlike '^[0-9]+$'")
    seen = lines.groupBy(document, "line").agg(F.count_distinct(page).alias("on_pages"))
    return seen.join(n, document).where("pages >= 4 and on_pages >= greatest(3, floor(pages / 2))").select(document, "line", "on_pages", "pages")


def hash_sample(rows: DataFrame, key: str, seed: str, fraction: float) -> DataFrame:
    """A fixed share of the rows, one at least, the first by the hash of their keys: which rows does not depend on how they came out."""
    share = lambda n: F.greatest(F.lit(1), F.bround(n * fraction, 0))
    return cut_by_hash(rows, [], key, seed, [share], "__cut").where("__cut = 0").drop("__cut")


def split_30_30_40(rows: DataFrame, key: str, strata: list[str], seed: str) -> DataFrame:
    """Development, validation and test by hash order within each stratum; shares rounded half to even."""
    third = lambda k: lambda n: k * F.bround(n * 0.3, 0)
    cut = cut_by_hash(rows, strata, key, seed, [third(1), third(2)], "__cut")
    return cut.withColumn("split", F.element_at(F.array(F.lit("development"), F.lit("validation"), F.lit("test")), F.col("__cut") + 1)).drop("__cut")


def balanced(rows: DataFrame, group: str, key: str) -> DataFrame:
    """Round-robin over groups, the smallest group first."""
    sized = rows.join(rows.groupBy(group).agg(F.count("*").alias("__n")), group)
    return numbered(sized, [group], [key], "turn").orderBy("turn", "__n", group).drop("__n")


def sliding_rate(events: DataFrame, by: list[str], at: str, seconds: int, weight: Column) -> DataFrame:
    """How many events, and how much weight, in the seconds up to each event, itself included."""
    w = Window.partitionBy(*by).orderBy(F.unix_micros(F.col(at).cast("timestamp"))).rangeBetween(-(seconds * 1_000_000 - 1), 0)
    return events.withColumn("requests", F.count("*").over(w)).withColumn("weight", F.sum(weight).over(w))


def nearest_by(left: DataFrame, right: DataFrame, key: str, at_left: str, at_right: str, keep: str) -> DataFrame:
    """For each left row the right row of its key whose place is nearest, ties to the smaller place."""
    j = left.join(right, key)
    return j.groupBy(*left.columns).agg(F.min_by(keep, F.struct(F.abs(F.col(at_left) - F.col(at_right)), F.col(at_right))).alias(keep))
