"""Pareto fronts within groups: running minima for two axes, anti-joins for more."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def front_2d(rows: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    """Rows that no other of their group beats or equals on both axes (less is better); of equal rows one stays, which doesn't matter as they are equal.

    Sorted by x, a row is on the front when its y is below all before it: one sort, no self-join.
    """
    before = Window.partitionBy(*group).orderBy(x, y).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_best", F.min(y).over(before)).where(F.col("_best").isNull() | (F.col(y) < F.col("_best"))).drop("_best")


def dominates(a: str, b: str, axes: list[str]) -> Column:
    """Whether alias a is no worse than b on all axes and better on one."""
    no_worse = reduce(Column.__and__, [F.col(f"{a}.{x}") <= F.col(f"{b}.{x}") for x in axes])
    better = reduce(Column.__or__, [F.col(f"{a}.{x}") < F.col(f"{b}.{x}") for x in axes])
    return no_worse & better


def eps_dominates(a: str, b: str, eps: dict[str, tuple[float, float]]) -> Column:
    """Whether a is within a slack of const + rate * a's value of b on all axes and better on one."""
    near = reduce(Column.__and__, [F.col(f"{a}.{x}") <= F.col(f"{b}.{x}") + c + r * F.col(f"{a}.{x}") for x, (c, r) in eps.items()])
    return near & reduce(Column.__or__, [F.col(f"{a}.{x}") < F.col(f"{b}.{x}") for x in eps])


def front(rows: DataFrame, group: list[str], axes: list[str]) -> DataFrame:
    """Rows of each group that no other dominates.

    Before the self-join a cheap test drops most: the row of least sum in each group is on the
    front, and what it dominates is not.
    """
    total = reduce(Column.__add__, [F.col(x) for x in axes])
    champion = rows.groupBy(*group).agg(F.min_by(F.struct(*axes), F.struct(total, *axes)).alias("_c"))
    beaten = reduce(Column.__and__, [F.col(f"_c.{x}") <= F.col(x) for x in axes]) & reduce(Column.__or__, [F.col(f"_c.{x}") < F.col(x) for x in axes])
    left = rows.join(champion, group).where(~beaten).drop("_c")
    same = reduce(Column.__and__, [F.col(f"a.{g}") == F.col(f"b.{g}") for g in group])
    return left.alias("b").join(left.select(*group, *axes).alias("a"), same & dominates("a", "b", axes), "left_anti")


def dominators(rows: DataFrame, group: list[str], axes: list[str], key: str) -> DataFrame:
    """Every row with dominated_by, the least key of those that dominate it (null on the front), and lost, the axes on which that one is better."""
    same = reduce(Column.__and__, [F.col(f"a.{g}") == F.col(f"b.{g}") for g in group])
    found = rows.alias("b").join(rows.alias("a"), same & dominates("a", "b", axes)).select(F.col(f"b.{key}").alias(key), F.struct(F.col(f"a.{key}").alias("by"), *[F.col(f"a.{x}").alias(x) for x in axes]).alias("d"))
    least = found.groupBy(key).agg(F.min("d").alias("d"))
    lost = F.array_join(F.filter(F.array(*[F.when(F.col(f"d.{x}") < F.col(x), F.lit(x)) for x in axes]), lambda v: v.isNotNull()), ",")
    return rows.join(least, key, "left").select(*rows.columns, F.col("d.by").alias("dominated_by"), F.coalesce(lost, F.lit("")).alias("lost"))


def bucket_front(rows: DataFrame, cell: list[str], arrival: str, bucket: str) -> DataFrame:
    """Labels of a cell by arrival (less) and reliability bucket (more): the earliest of each bucket that no higher bucket matches."""
    best = rows.groupBy(*cell, bucket).agg(F.min(arrival).alias(arrival))
    above = Window.partitionBy(*cell).orderBy(F.desc(bucket)).rowsBetween(Window.unboundedPreceding, -1)
    return best.withColumn("_above", F.min(arrival).over(above)).where(F.col("_above").isNull() | (F.col(arrival) < F.col("_above"))).drop("_above")


def plan_front(plans: DataFrame, group: str) -> DataFrame:
    """Plans (transfers, end, start, bucket, burden, id): none is left that one of no greater burden matches on all four axes and beats on one; exact ties keep the smallest id."""
    same = F.col(f"a.{group}") == F.col(f"b.{group}")
    match = (F.col("a.burden") <= F.col("b.burden")) & (F.col("a.transfers") <= F.col("b.transfers")) & (F.col("a.end") <= F.col("b.end")) & (F.col("a.start") >= F.col("b.start")) & (F.col("a.bucket") >= F.col("b.bucket"))
    better = (F.col("a.burden") < F.col("b.burden")) | (F.col("a.transfers") < F.col("b.transfers")) | (F.col("a.end") < F.col("b.end")) | (F.col("a.start") > F.col("b.start")) | (F.col("a.bucket") > F.col("b.bucket")) | (F.col("a.id") < F.col("b.id"))
    return plans.alias("b").join(plans.alias("a"), same & match & better, "left_anti")


def slower_than_direct(plans: DataFrame, group: str) -> DataFrame:
    """Transit plans that a direct plan of no greater burden isn't quicker than, and all direct plans. A plan has direct (boolean), burden and seconds."""
    direct = plans.where("direct").groupBy(group).agg(*[F.min(F.when(F.col("burden") <= b, F.col("seconds"))).alias(f"d{b}") for b in range(3)])
    limit = F.element_at(F.array("d0", "d1", "d2"), (F.col("burden") + 1).cast("int"))
    return plans.join(direct, group, "left").where(F.col("direct") | limit.isNull() | (F.col("seconds") <= limit)).drop("d0", "d1", "d2")


def display_dedup(options: DataFrame, group: str, axes: dict[str, int]) -> DataFrame:
    """Options (index and axes) of which no other is as good on all axes rounded to their steps; of equal ones the first index stays."""
    rounded = options.select("*", *[F.floor(F.col(x) / step + 0.5).alias(f"_{x}") for x, step in axes.items()])
    keys = [f"_{x}" for x in axes]
    weak = reduce(Column.__and__, [F.col(f"a.{k}") <= F.col(f"b.{k}") for k in keys])
    strict = reduce(Column.__or__, [F.col(f"a.{k}") < F.col(f"b.{k}") for k in keys]) | (F.col("a.index") < F.col("b.index"))
    return rounded.alias("b").join(rounded.alias("a"), (F.col(f"a.{group}") == F.col(f"b.{group}")) & weak & strict, "left_anti").drop(*keys)
