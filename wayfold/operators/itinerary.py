"""What is derived from finished plans and running trips: bounds, risks, budgets, places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.reliability import on_time_vs, risk_class

#: Seconds of vehicle access by the straight time, least and most; the least access radius; the reliability that later trips must keep; risk of a connection and how late the next may be.
VEHICLE_SHARE, VEHICLE_LEAST, VEHICLE_MOST, NEAR_LEAST, KEEP = 0.06, 1200, 2700, 600, 0.80
EXTREME_RISK, EXTREME_WAIT = 0.10, 7200


def vehicle_budget(crow_seconds: Column) -> Column:
    return F.least(F.greatest(F.floor(crow_seconds * VEHICLE_SHARE), F.lit(VEHICLE_LEAST)), F.lit(VEHICLE_MOST)).cast("int")


def near_radius(nearest_stop_seconds: Column) -> Column:
    return F.greatest(F.coalesce(nearest_stop_seconds, F.lit(0)), F.lit(NEAR_LEAST))


def admissible_radius(walk_only: Column, best_arrival: Column, start: Column) -> Column:
    """No access longer than walking all the way, nor than what the best arrival so far leaves."""
    return F.least(walk_only, best_arrival - start)


def chain_bounds(legs: DataFrame) -> DataFrame:
    """plan, seq, latest: of each ride (plan, seq, walk, start, end) the latest arrival that keeps the next ride, walks between taken off; null for the last."""
    order = Window.partitionBy("plan").orderBy("seq")
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    walked = legs.withColumn("walked", F.sum(F.when(F.col("walk"), F.col("end") - F.col("start")).otherwise(0)).over(run))
    return walked.where("not walk").select("plan", "seq", (F.lead("start").over(order) - (F.lead("walked").over(order) - F.col("walked"))).alias("latest"))


def reliable_margin(feeder: Column, boarded: Column, keep: float = KEEP) -> Column:
    """The least margin at which a connection between two distributions keeps that reliability: it can only be a difference of two delays."""
    margins = F.flatten(F.transform(feeder, lambda f: F.transform(boarded, lambda b: f["delay"] - b["delay"])))
    return F.array_min(F.filter(F.array_distinct(margins), lambda m: F.round(on_time_vs(feeder, boarded, m), 6) >= keep))


def transfer_risks(margins: DataFrame, bins: DataFrame) -> DataFrame:
    """plan, seq, p, risk: the chance that each connection (mode, next_mode, margin) holds; null without a model of the feeder."""
    of = lambda c: F.broadcast(bins.select(F.col("mode").alias(c), F.col("bins").alias(f"_{c}")))  # noqa: E731  a row per mode
    p = on_time_vs(F.col("_mode"), F.col("_next_mode"), F.col("margin"))
    rows = margins.where("next_mode is not null").join(of("mode"), "mode", "left").join(of("next_mode"), "next_mode", "left")
    return rows.select("plan", "seq", F.round(p, 6).alias("p"), risk_class(F.round(p, 6)).alias("risk"))


def drop_extreme(plans: DataFrame, group: str) -> DataFrame:
    """Plans (reliability, wait) without those that are too risky with too long a wait after, unless a group has no others."""
    risky = (F.col("reliability") < EXTREME_RISK) & (F.col("wait") > EXTREME_WAIT)
    safe = F.max(F.when(risky, 0).otherwise(1)).over(Window.partitionBy(group))
    return plans.withColumn("_safe", safe).withColumn("_risky", risky).where("not _risky or _safe = 0").drop("_safe", "_risky")


def active_legs(legs: DataFrame, now: int) -> DataFrame:
    """The leg of each plan that is under way, the later one where two are."""
    return legs.where((F.col("start") <= now) & (F.col("end") > now)).groupBy("plan").agg(F.max("seq").alias("seq"))


def vehicle_places(stop_times: DataFrame, stops: DataFrame, now: int) -> DataFrame:
    """trip, pos, lat, lon: where running trips are, in a straight line from the last stop left to the next one; at a stop while they stand there."""
    order = Window.partitionBy("trip").orderBy("pos")
    at = stop_times.select("trip", "pos", "stop", "arr", "dep", F.lead("stop").over(order).alias("next"), F.lead("arr").over(order).alias("next_arr")).where((F.col("arr") <= now) & (F.col("next_arr") > now))
    a = stops.select("stop", F.col("lat").alias("lat1"), F.col("lon").alias("lon1"))
    b = stops.select(F.col("stop").alias("next"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    share = F.greatest(F.lit(0.0), (F.lit(now) - F.col("dep")) / (F.col("next_arr") - F.col("dep")))
    return at.join(a, "stop").join(b, "next").select("trip", "pos", (F.col("lat1") + (F.col("lat2") - F.col("lat1")) * share).alias("lat"), (F.col("lon1") + (F.col("lon2") - F.col("lon1")) * share).alias("lon"))


def highlight(options: DataFrame, group: str, index: str, weights: dict[str, float], window: int) -> DataFrame:
    """group, balanced, within: as bike.balanced and bike.within over a group's options in the order of index, by aggregates whatever a group's size.

    Axes are whole numbers. The picks are rows at first; a count of the rows before each gives its place.
    """
    first, *_ = weights
    fits = F.col(first) <= window
    spans = [f(F.when(fits, F.col(a)) if of == "fit" else F.col(a)).alias(f"_{of}_{at}_{a}") for of in ("all", "fit") for a in weights for at, f in (("low", F.min), ("high", F.max))]
    ranged = options.join(options.groupBy(group).agg(*spans), group)

    def score(of: str) -> Column:
        total = F.lit(0.0)
        for axis, w in weights.items():
            low, high = F.col(f"_{of}_low_{axis}"), F.col(f"_{of}_high_{axis}")
            total = total + F.when(high > low, w * (F.col(axis) - low) / (high - low)).otherwise(0.0)
        return total

    row = F.struct(index, *weights)
    least = lambda key, when=None: F.min(F.struct(key.alias("key"), row.alias("row")) if when is None else F.when(when, F.struct(key.alias("key"), row.alias("row"))))["row"]
    picked = ranged.groupBy(group).agg(least(score("all")).alias("_balanced"), F.coalesce(least(score("fit"), fits), least(F.col(first))).alias("_within"))
    before = lambda pick: F.count(F.when(row < F.col(pick), 1)).cast("int")
    return options.join(picked, group).groupBy(group).agg(before("_balanced").alias("balanced"), before("_within").alias("within"))
