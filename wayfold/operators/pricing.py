"""Prices over boardings in their order, as one fold of a small state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fares import Bracketed, TimeRules, bracketed_cents, scale, time_bucket

#: Operators: a flat ticket with a validity (cents, seconds), a ticket for each ride (cents), and rail by distance.
FLAT = {"click": (250, 3600), "view": (300, 5400)}
SINGLE = {"purchase": 280}
RAIL = "signup"
#: A day pass (cents) that stands in for two or more operators' tickets in its zone when it is cheaper.
PASS_CENTS = 840


def ordered(boardings: DataFrame) -> DataFrame:
    """user_id, rides: the boardings of each traveller in order, one array."""
    ride = F.struct("seq", "operator", F.col("board_time").cast("int").alias("board_time"), F.col("km").cast("int").alias("km"), "board_stop")
    return boardings.groupBy("user_id").agg(F.array_sort(F.collect_list(ride)).alias("rides"))


def price(rides: Column, weekday: int, tariff: Bracketed = Bracketed(), rules: TimeRules = TimeRules()) -> Column:
    """(cents, unknown) of rides in order.

    A flat ticket holds from its activation until its validity ends, the end excluded. A rail
    run begins with the first rail ride after another operator: its base is charged once, and
    the part for distance is that of the run so far. Unknown operators are counted.
    """
    kind = "struct<cents:int,unknown:int,t1:int,t2:int,rail:boolean,km:int,part:int>"
    zero = F.struct(F.lit(0).alias("cents"), F.lit(0).alias("unknown"), F.lit(None).cast("int").alias("t1"), F.lit(None).cast("int").alias("t2"), F.lit(False).alias("rail"), F.lit(0).alias("km"), F.lit(0).alias("part")).cast(kind)

    def step(s: Column, r: Column) -> Column:
        is_rail = r["operator"] == RAIL
        fresh, cost = [], F.lit(0)
        for slot, (name, (cents, valid)) in zip(("t1", "t2"), FLAT.items(), strict=True):
            held = F.coalesce((r["board_time"] >= s[slot]) & (r["board_time"] - s[slot] < valid), F.lit(False))
            buys = (r["operator"] == name) & ~held
            fresh.append(F.when(buys, r["board_time"]).otherwise(s[slot]))
            cost = cost + F.when(buys, cents).otherwise(0)
        for name, cents in SINGLE.items():
            cost = cost + F.when(r["operator"] == name, cents).otherwise(0)
        share = scale(time_bucket(F.lit(weekday), r["board_time"], rules), rules, card=False)
        base = F.floor(tariff.floor * share + 0.5).cast("int")
        run_km = F.when(s["rail"], s["km"]).otherwise(0) + r["km"]
        part = F.floor(F.greatest((bracketed_cents(run_km, tariff) - tariff.floor) * share, F.lit(0.0)) + 0.5).cast("int")
        rail_cost = F.when(s["rail"], 0).otherwise(base) + part - F.when(s["rail"], s["part"]).otherwise(0)
        unknown = ~r["operator"].isin(RAIL, *FLAT, *SINGLE)
        return F.struct(
            (s["cents"] + cost + F.when(is_rail, rail_cost).otherwise(0)).cast("int").alias("cents"),
            (s["unknown"] + unknown.cast("int")).alias("unknown"),
            fresh[0].cast("int").alias("t1"),
            fresh[1].cast("int").alias("t2"),
            is_rail.alias("rail"),
            F.when(is_rail, run_km).otherwise(0).cast("int").alias("km"),
            F.when(is_rail, part).otherwise(0).cast("int").alias("part"),
        ).cast(kind)

    return F.aggregate(rides, zero, step, lambda s: F.struct(s["cents"].alias("cents"), s["unknown"].alias("unknown")))


def zone_pass(items: DataFrame) -> DataFrame:
    """trip, cents, saved: paid items (trip, operator, cents, in_zone) with a pass in place of those in the zone where they are of two or more operators and cost more."""
    total = items.groupBy("trip").agg(F.sum("cents").alias("all"), F.sum(F.when(F.col("in_zone"), F.col("cents")).otherwise(0)).alias("zone"), F.count_distinct(F.when(F.col("in_zone") & (F.col("cents") > 0), F.col("operator"))).alias("operators"))
    saved = F.when((F.col("operators") >= 2) & (F.col("zone") > PASS_CENTS), F.col("zone") - PASS_CENTS).otherwise(0)
    return total.select("trip", (F.col("all") - saved).alias("cents"), saved.alias("saved"))
