"""Putting plans together: endpoints, access by state, cutoffs, grouping, order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codes import burden


def endpoints(asked: DataFrame, stops: DataFrame, snapped: DataFrame) -> DataFrame:
    """request, stop, seconds: the platforms of a known station at no cost; else the stop that the coordinate snaps to.

    asked has request and station (null or unknown: none), stops stop and parent, snapped
    request, stop and seconds.
    """
    platforms = asked.join(stops.select("stop", F.col("parent").alias("station")), "station").select("request", "stop", F.lit(0).alias("seconds"))
    others = snapped.join(platforms.select("request").distinct(), "request", "left_anti")
    return platforms.unionByName(others.select("request", "stop", "seconds"))


def station_centroids(stops: DataFrame) -> DataFrame:
    """parent, lat, lon, platforms: a station as an endpoint."""
    return stops.groupBy("parent").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.array_sort(F.collect_list("stop")).alias("platforms"))  # the platforms of one station


def access_by_state(access: DataFrame, egress: DataFrame) -> DataFrame:
    """request, state, stop, seconds: the least access of each state; stops that a vehicle would reach only to leave on foot at the destination are no places to park it."""
    least = access.groupBy("request", "state", "stop").agg(F.min("seconds").alias("seconds"))
    ends = egress.select("request", "stop").distinct().withColumn("state", F.explode(F.array(F.lit("bike"), F.lit("car"))))
    return least.join(ends, ["request", "state", "stop"], "left_anti")


def merged_access(access: DataFrame) -> DataFrame:
    return access.groupBy("request", "stop").agg(F.min("seconds").alias("seconds"))


def arrival_cutoffs(arrivals: DataFrame, slack: int) -> DataFrame:
    """request, burden, cutoff: the best arrival of modes of no greater burden, and slack; arrivals has request, mode, arr and egress."""
    own = arrivals.groupBy("request", burden(F.col("mode")).alias("burden")).agg(F.min(F.col("arr") + F.col("egress")).alias("own"))
    all_of = arrivals.select("request").distinct().withColumn("burden", F.explode(F.array(*map(F.lit, range(3)))))
    upto = Window.partitionBy("request").orderBy("burden").rowsBetween(Window.unboundedPreceding, 0)
    return all_of.join(own, ["request", "burden"], "left").select("request", "burden", (F.min("own").over(upto) + slack).alias("cutoff"))


def riding_front(rows: DataFrame) -> DataFrame:
    """Labels on board (cell, state, trip_rank, bucket): those of a state that no earlier trip of the same bucket or a higher one makes useless."""
    best = rows.groupBy("cell", "state", "bucket").agg(F.min("trip_rank").alias("trip_rank"))
    above = Window.partitionBy("cell", "state").orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    return best.withColumn("_above", F.min("trip_rank").over(above)).where("_above is null or trip_rank < _above").drop("_above")


def group_access(plans: DataFrame) -> DataFrame:
    """Plans (request, core, id, mode, start, end, street) of one transit core as one: the lightest mode's, then the earliest and latest leaving, with the others as alternatives.

    A plan that arrives before that one stays on its own, as does one without transit (core is
    null). alternatives has of each other mode the plan that leaves last, in the order of burden
    and start. Cores are pre-aggregated: of a mode only its best plan counts as an alternative.
    """
    b = burden(F.col("mode"))
    rides = plans.where("core is not null")
    key = F.struct(b.alias("b"), "end", (-F.col("start")).alias("s"), "street", "id")
    first = rides.groupBy("request", "core").agg(F.min(key).alias("x"), F.min_by("mode", key).alias("own")).select("request", "core", F.col("x.id").alias("first"), F.col("x.end").alias("first_end"), "own")
    joined = rides.join(first, ["request", "core"])
    others = joined.where((F.col("id") != F.col("first")) & (F.col("end") >= F.col("first_end")) & (F.col("mode") != F.col("own")))
    last = others.groupBy("request", "core", "mode").agg(F.max(F.struct("start", (-F.col("end")).alias("e"), (-F.col("id")).alias("i"))).alias("x"))
    listed = F.array_sort(F.collect_list(F.struct(b.alias("b"), F.col("x.start").alias("start"), "mode")))  # a row for each mode
    shown = last.groupBy("request", "core").agg(F.array_join(F.transform(listed, lambda a: F.concat_ws(":", a["mode"], a["start"])), ",").alias("alternatives"))
    grouped = joined.where((F.col("id") == F.col("first")) | (F.col("end") < F.col("first_end"))).join(shown, ["request", "core"], "left")
    alternatives = F.when(F.col("id") == F.col("first"), F.coalesce("alternatives", F.lit(""))).otherwise("")
    return grouped.select("request", "id", alternatives.alias("alternatives")).unionByName(plans.where("core is null").select("request", "id", F.lit("").alias("alternatives")))


def plan_order(plans: DataFrame) -> DataFrame:
    """request, id, place: by end, latest start, surest, lightest mode, least walking, then id."""
    order = Window.partitionBy("request").orderBy("end", F.desc("start"), F.desc("bucket"), "burden", "walking", "id")
    return plans.select("request", "id", F.row_number().over(order).alias("place"))


def direct_within(direct: DataFrame, best: DataFrame, slack: int) -> DataFrame:
    """Direct plans (request, mode, seconds) that arrive no later than the best plan and slack; all of a request that has no other."""
    return direct.join(best.select("request", F.col("seconds").alias("_best")), "request", "left").where(F.col("_best").isNull() | (F.col("seconds") <= F.col("_best") + slack)).drop("_best")


def path_moments(steps: DataFrame, cv: float = 0.05) -> DataFrame:
    """path, mean, var: sums along a path, and what goes wrong everywhere at once."""
    total = steps.groupBy("path").agg(F.sum("mean").alias("mean"), F.sum("var").alias("var"))
    return total.select("path", "mean", (F.col("var") + F.pow(cv * F.col("mean"), 2)).alias("var"))


def running_metres(stops: DataFrame, metres: Column) -> DataFrame:
    """trip, pos, metres: the distance run from the first stop; stops has trip, pos and the columns that metres takes from one stop to the next."""
    upto = Window.partitionBy("trip").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return stops.select("trip", "pos", F.coalesce(F.sum(metres).over(upto), F.lit(0.0)).alias("metres"))


def changes(events: DataFrame, count: int | None = None, journey: int | None = None) -> DataFrame:
    """Logged changes, the newest first, of all journeys or one; a list that is asked for with a count is cut."""
    found = events if journey is None else events.where(F.col("journey") == journey)
    ordered = found.orderBy(F.desc("ts"), F.desc("event"))
    return ordered if count is None else ordered.limit(count)
