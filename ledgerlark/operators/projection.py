"""Relational projection: upserts, pruning, and the read queries over the projected tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New rows replace old ones of the same key."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def insert_missing(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New rows only for keys that are not there yet."""
    return old.unionByName(new.dropDuplicates(key).join(old.select(*key), key, "left_anti"))


def prune(children: DataFrame, live: DataFrame, key: list[str]) -> DataFrame:
    """Children whose parent is still there."""
    return children.join(live.select(*key).distinct(), key, "left_semi")


def stale(children: DataFrame, live: DataFrame, key: list[str]) -> DataFrame:
    """Children whose parent is gone."""
    return children.join(live.select(*key).distinct(), key, "left_anti")


def latest(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """One row of each key, the first in the order."""
    return rows.withColumn("__i", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__i = 1").drop("__i")


def melt(rows: DataFrame, ids: list[str], values: list[str], name: str = "metric", value: str = "value") -> DataFrame:
    """A row for each id and measure."""
    return rows.unpivot(ids, values, name, value)


def counts_of(parents: DataFrame, key: str, **children: DataFrame) -> DataFrame:
    """Parents with the number of their children in each table, each counted by itself first."""
    for name, c in children.items():
        parents = parents.join(c.groupBy(key).agg(F.count("*").alias(name)), key, "left")
    return parents.fillna(0, list(children))
