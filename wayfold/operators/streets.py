"""Street graphs: shortest times by relaxation, snapping by grid cells, runs of a path."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine
from ..lineage import cut


def shortest(seeds: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """request, node, seconds: least seconds within the budget from any seed (request, node, seconds), relaxed until nothing improves.

    edges has a, b, w, and sink where a node can be reached but not left. Each round joins
    only what the last one improved; a round's labels are pre-aggregated by minimum.
    """
    best = cut(seeds.groupBy("request", "node").agg(F.min("seconds").alias("seconds")).where(F.col("seconds") <= most))
    fresh = best
    while True:
        reached = fresh.join(edges, fresh["node"] == edges["a"]).where("not sink").select("request", F.col("b").alias("node"), (F.col("seconds") + F.col("w")).alias("seconds")).where(F.col("seconds") <= most)
        reached = reached.groupBy("request", "node").agg(F.min("seconds").alias("seconds"))
        known = best.withColumnRenamed("seconds", "known")
        fresh = cut(reached.join(known, ["request", "node"], "left").where("known is null or seconds < known").select("request", "node", "seconds"))
        if fresh.isEmpty():
            return best
        best = cut(best.unionByName(fresh).groupBy("request", "node").agg(F.min("seconds").alias("seconds")))


def nearest(points: DataFrame, nodes: DataFrame, cell: float, most_m: float) -> DataFrame:
    """point, node, metres: the nearest node within most_m; ties take the smallest node.

    Points look at the nine cells around theirs, so cells must be at least most_m wide.
    """
    key = lambda c: F.floor(F.col(c) / cell)
    around = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r in (-1, 0, 1) for c in (-1, 0, 1)])
    asked = points.select("point", F.col("lat").alias("plat"), F.col("lon").alias("plon"), key("lat").alias("y"), key("lon").alias("x"), F.explode(around).alias("o")).select("point", "plat", "plon", (F.col("y") + F.col("o.r")).alias("y"), (F.col("x") + F.col("o.c")).alias("x"))
    found = asked.join(nodes.select("node", "lat", "lon", key("lat").alias("y"), key("lon").alias("x")), ["y", "x"])
    metres = haversine(F.col("plat"), F.col("plon"), F.col("lat"), F.col("lon"))
    return found.select("point", "node", metres.alias("metres")).where(F.col("metres") <= most_m).groupBy("point").agg(F.min(F.struct("metres", "node")).alias("n")).select("point", "n.node", "n.metres")


def ride_push_runs(steps: DataFrame) -> DataFrame:
    """path, run, push, seconds, metres: a path's edges in runs of riding and pushing."""
    order = Window.partitionBy("path").orderBy("seq")
    new = steps.withColumn("_new", F.when(F.col("push") == F.lag("push").over(order), 0).otherwise(1))
    run = new.withColumn("run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy("path", "run").agg(F.first("push").alias("push"), F.sum("seconds").alias("seconds"), F.sum("metres").alias("metres"))


def climbs(steps: DataFrame, buffer: float) -> DataFrame:
    """path, ascent: climbing charged beyond a buffer that the path carries, never below zero."""
    deltas = F.transform(F.array_sort(F.collect_list(F.struct("seq", "delta"))), lambda s: s["delta"].cast("double"))

    def step(acc, d):
        held = acc["held"] + d
        return F.struct(F.least(F.greatest(held, F.lit(0.0)), F.lit(buffer)).alias("held"), (acc["cost"] + F.greatest(held - buffer, F.lit(0.0))).alias("cost"))

    total = F.aggregate(deltas, F.struct(F.lit(0.0).alias("held"), F.lit(0.0).alias("cost")), step, lambda acc: acc["cost"])
    return steps.groupBy("path").agg(total.alias("ascent"))


def shared_share(paths: DataFrame, by: str = "metres") -> DataFrame:
    """p, q, share: for pairs of paths of one group with common edges, the common length over the shorter length.

    Over a shorter length of zero the share is what floating point makes of it: infinite, or not
    a number where the common length is zero too. A path that several groups have is one path.
    """
    length = paths.groupBy("path").agg(F.sum(by).alias("length"))
    a = paths.select("grp", "edge", F.col("path").alias("p"), F.col(by).alias("m"))
    both = a.join(paths.select("grp", "edge", F.col("path").alias("q")), ["grp", "edge"]).where("p < q").groupBy("p", "q").agg(F.sum("m").alias("common"))
    named = both.join(length.select(F.col("path").alias("p"), F.col("length").alias("lp")), "p").join(length.select(F.col("path").alias("q"), F.col("length").alias("lq")), "q")
    common, shorter = F.col("common").cast("double"), F.least("lp", "lq").cast("double")
    over_zero = F.when(common > 0, float("inf")).when(common < 0, float("-inf")).when(common == 0, float("nan"))
    return named.select("p", "q", F.when(shorter == 0, over_zero).otherwise(common / shorter).alias("share"))
