"""Stations and platforms: matching, absorption of stops without a station, operators of routes, checks of ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine
from ..functions.text import agency_matches
from ..lineage import cut


def within(a: DataFrame, b: DataFrame, cell: float, most_m: float) -> DataFrame:
    """All columns of a and b (which have lat, lon with the prefixes a_ and b_) for pairs within most_m, and metres; cells must be as wide as that."""
    key = lambda c: F.floor(F.col(c) / cell)
    around = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r in (-1, 0, 1) for c in (-1, 0, 1)])
    left = a.withColumn("_o", F.explode(around)).withColumn("_y", key("a_lat") + F.col("_o.r")).withColumn("_x", key("a_lon") + F.col("_o.c")).drop("_o")
    right = b.withColumn("_y", key("b_lat")).withColumn("_x", key("b_lon"))
    metres = haversine(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"))
    return left.join(right, ["_y", "_x"]).drop("_y", "_x").withColumn("metres", metres).where(F.col("metres") <= most_m)


def platforms(stops: DataFrame, found: DataFrame, cell: float = 0.01, most_m: float = 400.0) -> DataFrame:
    """stop, platform, same_code, metres: of the platforms within reach one of the stop's code, else the nearest; stops without a code match none."""
    pairs = within(stops.where("a_code is not null"), found, cell, most_m)
    best = F.min(F.struct((F.col("b_code") != F.col("a_code")).alias("other"), "metres", "platform"))
    return pairs.groupBy("stop").agg(best.alias("x")).select("stop", "x.platform", (~F.col("x.other")).alias("same_code"), "x.metres")


def spread(matches: DataFrame) -> DataFrame:
    """n, mean, p90 and most: the percentile is exact and by rank, summed from counts of values."""
    return matches.agg(F.count("metres").alias("n"), F.avg("metres").alias("mean"), F.expr("percentile_disc(0.9) within group (order by metres)").alias("p90"), F.max("metres").alias("most"))


def orphan_parents(native: DataFrame, orphans: DataFrame, cell: float, radius_m: float) -> DataFrame:
    """stop, parent for stops without a station.

    A native station of the same name within the radius takes a stop, the nearest first, then
    the smallest. A stop whose name is native elsewhere stays alone. The others of a name that
    lie within the radius of each other, by steps, share the smallest of them as parent.
    """
    pairs = within(orphans.select("stop", F.col("key").alias("a_key"), F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon")), native.select("station", F.col("key").alias("b_key"), F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon")), cell, radius_m)
    taken = pairs.where("a_key = b_key").groupBy("stop").agg(F.min(F.struct("metres", "station")).alias("x")).select("stop", F.col("x.station").alias("parent"))
    free = orphans.join(native.select("key").distinct(), "key", "left_anti")
    own = lambda p: free.select(F.col("stop").alias(f"{p}_stop"), F.col("key").alias(f"{p}_key"), F.col("lat").alias(f"{p}_lat"), F.col("lon").alias(f"{p}_lon"))
    links = cut(within(own("a"), own("b"), cell, radius_m).where("a_key = b_key and a_stop <> b_stop").select("a_stop", "b_stop"))
    roots = cut(links.groupBy("a_stop").agg(F.min("b_stop").alias("m")).select(F.col("a_stop").alias("stop"), F.least("a_stop", "m").alias("parent")))
    while True:  # each stop takes the smallest parent among its neighbours, then that one's parent
        near = links.join(roots, links["b_stop"] == roots["stop"]).groupBy(F.col("a_stop").alias("stop")).agg(F.min("parent").alias("m"))
        step = roots.join(near, "stop").select("stop", F.least("parent", "m").alias("parent"))
        jump = step.join(roots.select(F.col("stop").alias("parent"), F.col("parent").alias("next")), "parent", "left").select("stop", F.least("parent", F.coalesce("next", "parent")).alias("parent"))
        new = cut(jump)
        if new.join(roots, ["stop", "parent"], "left_anti").isEmpty():
            return taken.unionByName(new)
        roots = new


def operator_of(routes: DataFrame, operators: list[str], slots: int = 4) -> DataFrame:
    """route, operator, slot: the first operator whose name or token the agency bears; others share numbered slots, in the order of names, the last for all that follow."""
    first = reduce(lambda acc, op: acc.when(agency_matches(F.col("agency"), F.lit(op)), op), operators[1:], F.when(agency_matches(F.col("agency"), F.lit(operators[0])), operators[0]))
    known = routes.withColumn("operator", first)
    unknown = known.where("operator is null").select("agency").distinct().withColumn("slot", F.least(F.dense_rank().over(Window.orderBy("agency")), F.lit(slots)))  # a row per agency
    return known.join(F.broadcast(unknown), "agency", "left").select("route", "operator", "slot")


def violations(checks: dict[str, tuple[DataFrame, str, DataFrame, str]]) -> DataFrame:
    """rule, n: for each rule (rows, column, table, key) how many rows name what the table lacks."""

    def one(name: str, rows: DataFrame, column: str, table: DataFrame, key: str) -> DataFrame:
        lacking = rows.select(F.col(column).alias("_k")).join(table.select(F.col(key).alias("_k")), "_k", "left_anti")
        return lacking.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("rule"), "n")

    return reduce(DataFrame.unionByName, [one(name, *x) for name, x in checks.items()])

