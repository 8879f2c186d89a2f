"""Exact positions, cuts and percentiles without a window over a whole group.

Positions come from range-sorted parts: a row's place in its part and the rows of its group in the parts before.  A cut by hash finds the k-th
smallest of each group from two histograms of digits and the few rows of the one bucket that holds it, and then compares.  Percentiles
count equal values first, so a value that most rows share is one row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BEFORE = (Window.unboundedPreceding, -1)


def running(rows: DataFrame, by: list[str], order: list[str], amount: Column, name: str) -> DataFrame:
    """rows with the sum of amount over the rows of their group up to them, in the given order, which must tell rows of a group apart."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # kept, so that both uses see the same parts: the bounds of two range sorts are two samples
    r = rows.withColumn("__a", amount).repartitionByRange(n, *by, *order).withColumn("__part", F.spark_partition_id()).persist()
    sums = r.groupBy(*by, "__part").agg(F.sum("__a").alias("__s"))
    before = sums.select(*by, "__part", F.coalesce(F.sum("__s").over(Window.partitionBy(*by).orderBy("__part").rowsBetween(*_BEFORE)), F.lit(0)).alias("__0"))  # a row for each part of a group
    own = r.withColumn("__i", F.sum("__a").over(Window.partitionBy("__part", *by).orderBy(*order)))
    same = [own[c].eqNullSafe(before[c]) for c in by]
    on = own["__part"] == before["__part"]
    for c in same:
        on = on & c
    return own.join(before, on).select(*[own[c] for c in rows.columns], (own["__i"] + before["__0"]).alias(name))


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """rows with their place in their group, from 1."""
    return running(rows, by, order, F.lit(1).cast("long"), name)


def cut_by_hash(rows: DataFrame, by: list[str], key: str, seed: str, ranks: list[Callable[[Column], Column]], name: str) -> DataFrame:
    """rows with the number of cuts that lie before them when each group stands in the order of md5(seed + key), then key; ranks: how many rows of a
    group of n stand before each cut, rising.  Keys are unique.  Null groups are one group."""
    group = ["__g"]
    g = F.to_json(F.struct(*by), {"ignoreNullFields": "false"}) if by else F.lit("")
    hashed = F.md5(F.concat(F.lit(seed), F.col(key).cast("string")))
    t = rows.withColumns({"__g": g, "__h": hashed}).withColumns({"__d1": F.substring("__h", 1, 3), "__d2": F.substring("__h", 4, 3)})
    n = t.groupBy(*group, "__d1").agg(F.count("*").alias("n"))  # 4,096 rows for a group
    want = n.groupBy(*group).agg(F.sum("n").alias("n")).select(*group, F.posexplode(F.array(*[r(F.col("n")).cast("long") for r in ranks])).alias("cut", "rank"))
    w = Window.partitionBy(*group).orderBy("__d1").rowsBetween(*_BEFORE)
    first = n.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).join(want, group).where((F.col("before") < F.col("rank")) & (F.col("rank") <= F.col("before") + F.col("n"))).select(*group, "cut", "__d1", (F.col("rank") - F.col("before")).alias("left"))
    n = t.join(first, [*group, "__d1"]).groupBy(*group, "cut", "left", "__d1", "__d2").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*group, "cut").orderBy("__d2").rowsBetween(*_BEFORE)
    second = n.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).where((F.col("before") < F.col("left")) & (F.col("left") <= F.col("before") + F.col("n"))).select(*group, "cut", "__d1", "__d2", (F.col("left") - F.col("before")).alias("left"))
    at = F.struct("__h", key)
    edge = t.join(second, [*group, "__d1", "__d2"])  # of each cut one bucket of 16 million
    last = edge.withColumn("i", F.row_number().over(Window.partitionBy(*group, "cut").orderBy("__h", key))).where("i = left").groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct("cut", at.alias("at")))).alias("__cuts"))
    beyond = sum((F.coalesce(at > F.try_element_at("__cuts", F.lit(i)), F.lit(True)).cast("int") for i in range(len(ranks))), F.lit(0))
    return t.join(last, group, "left").select(*rows.columns, beyond.alias(name))


def percentiles(rows: DataFrame, by: list[str], column: str, linear: dict[str, float] | None = None, nearest: dict[str, float] | None = None) -> DataFrame:
    """A row for each group with values: linear interpolation between the two nearest places (name: share), and the value at place floor(n * share), from 1
    (null at place 0).  Nulls do not count."""
    v = rows.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("__m"))
    up = running(v, by, [column], F.col("__m"), "__upto")
    total = v.groupBy(*by).agg(F.sum("__m").alias("__n"))
    if by:
        same = None
        for c in by:
            same = up[c].eqNullSafe(total[c]) if same is None else same & up[c].eqNullSafe(total[c])
        up = up.join(total, same).select(*[up[c] for c in up.columns], total["__n"])
    else:
        up = up.crossJoin(F.broadcast(total))  # one row
    holds = lambda i: F.max(F.when((i >= F.col("__upto") - F.col("__m")) & (i < F.col("__upto")), F.col(column)))
    at = lambda p: (F.col("__n") - 1) * F.lit(float(p))
    picks = []
    for name, p in (linear or {}).items():
        picks += [holds(F.floor(at(p))).alias(f"{name}__low"), holds(F.ceil(at(p))).alias(f"{name}__high")]
    picks += [holds(F.floor(F.col("__n") * F.lit(float(p))) - 1).alias(name) for name, p in (nearest or {}).items()]
    out = up.groupBy(*by, "__n").agg(*picks)
    between = lambda name, p: (F.col(f"{name}__low") + (F.col(f"{name}__high") - F.col(f"{name}__low")) * (at(p) - F.floor(at(p)))).alias(name)
    return out.select(*by, *[between(name, p) for name, p in (linear or {}).items()], *(nearest or {}))
