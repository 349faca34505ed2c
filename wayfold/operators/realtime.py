"""The live overlay: keyed by trip and position; without updates it is the schedule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values in seconds: what a match may deviate, how long a snapshot and a delay seen last stay good, and how old a vehicle's place may be.
EARLIEST, LATEST = -90, 3600
SNAPSHOT_TTL, STICKY_TTL, VEHICLE_AGE = 600, 86400, 120


def latest(updates: DataFrame, keys: list[str]) -> DataFrame:
    """The last update of each key by ts, then event_id."""
    rest = [c for c in updates.columns if c not in keys]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("ts", "event_id")).alias("u")).select(*keys, "u.*")


def cdf(samples: DataFrame) -> DataFrame:
    """mode, delay_s, cum: cumulative shares; the window runs over distinct delays, not samples."""
    counts = samples.groupBy("mode", "delay_s").agg(F.count(F.lit(1)).alias("c"))
    order = Window.partitionBy("mode").orderBy("delay_s").rowsBetween(Window.unboundedPreceding, 0)
    return counts.select("mode", "delay_s", (F.sum("c").over(order).cast("double") / F.sum("c").over(Window.partitionBy("mode"))).alias("cum"))


def bins(found: DataFrame) -> DataFrame:
    """mode, bins: a distribution as one array per mode, small whatever the number of samples."""
    return found.groupBy("mode").agg(F.array_sort(F.collect_list(F.struct(F.col("delay_s").alias("delay"), "cum"))).alias("bins"))


def forward_fill(stop_times: DataFrame, live: DataFrame) -> DataFrame:
    """trip, pos, delay_s, skipped: an explicit delay holds for later stops until the next; a skipped stop makes it unknown again.

    Only trips with updates are looked at.
    """
    touched = live.select("trip").distinct()
    at = stop_times.select("trip", "pos").join(touched, "trip").join(live.select("trip", "pos", "kind", F.when(F.col("kind") == "delay", F.col("delay_s")).alias("given")), ["trip", "pos"], "left")
    run = Window.partitionBy("trip").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    part = at.withColumn("skipped", F.coalesce(F.col("kind") == "skipped", F.lit(False))).withColumn("part", F.sum(F.col("skipped").cast("int")).over(run))
    fill = Window.partitionBy("trip", "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return part.select("trip", "pos", F.when(~F.col("skipped"), F.last("given", ignorenulls=True).over(fill)).alias("delay_s"), "skipped")


def apply_delay(seconds: Column, delay: Column) -> Column:
    return F.greatest(F.lit(0), seconds + F.coalesce(delay, F.lit(0)))


def cancelled(live: DataFrame) -> DataFrame:
    return live.where("kind = 'cancelled'").select("trip").distinct()


def overlay(stop_times: DataFrame, live: DataFrame) -> DataFrame:
    """stop_times as they run now: cancelled trips and skipped stops are gone, times carry the delays. Without updates nothing changes."""
    delays = forward_fill(stop_times, live)
    running = stop_times.join(cancelled(live), "trip", "left_anti").join(delays, ["trip", "pos"], "left").where("not coalesce(skipped, false)")
    return running.withColumns({"arr": apply_delay(F.col("arr"), F.col("delay_s")), "dep": apply_delay(F.col("dep"), F.col("delay_s"))}).select(*stop_times.columns)


def match_schedule(passages: DataFrame, arrivals: DataFrame, days: tuple[int, ...] = (0, 86400)) -> DataFrame:
    """passage, trip, pos, delay_s: the scheduled arrival that each predicted passage (passage, stop, line, time) is, by least absolute delay within the limits.

    Services of the day before run on past midnight; on equal delays today's, then the
    smallest trip wins. The hour of an arrival, and those within the limits, make it an equi-join.
    """
    offset = F.explode(F.array(*[F.lit(d) for d in days]))
    wanted = passages.withColumn("day", offset).withColumn("at", F.col("time") + F.col("day"))
    hours = F.explode(F.sequence(F.expr(f"cast((at - {LATEST}) div 3600 as int)"), F.expr(f"cast((at - ({EARLIEST})) div 3600 as int)")))
    candidates = wanted.withColumn("hour", hours).join(arrivals.select("stop", "line", "trip", "pos", "arr", F.expr("cast(arr div 3600 as int)").alias("hour")), ["stop", "line", "hour"])
    delay = F.col("at") - F.col("arr")
    good = candidates.withColumn("delay_s", delay).where(F.col("delay_s").between(EARLIEST, LATEST))
    best = good.groupBy("passage").agg(F.min(F.struct(F.abs("delay_s").alias("far"), "day", "trip", "pos", "delay_s")).alias("m"))
    return best.select("passage", "m.trip", "m.pos", "m.delay_s")


def resolve_stop(updates: DataFrame, stop_times: DataFrame, stops: DataFrame) -> DataFrame:
    """updates (trip, stop_id) with the scheduled position: the stop itself on the trip, else its first stop of the same parent."""
    exact = updates.join(stop_times.select("trip", F.col("stop").alias("stop_id"), F.col("pos").alias("exact_pos")), ["trip", "stop_id"], "left")
    of = stop_times.join(stops.select("stop", "parent"), "stop").groupBy("trip", "parent").agg(F.min("pos").alias("parent_pos"))
    named = exact.join(stops.select(F.col("stop").alias("stop_id"), "parent"), "stop_id", "left")
    return named.join(of, ["trip", "parent"], "left").withColumn("pos", F.coalesce("exact_pos", "parent_pos")).drop("exact_pos", "parent_pos", "parent")


def sticky(updates: DataFrame, now: int, ttl: int = STICKY_TTL) -> DataFrame:
    """trip, pos, delay_s, ts: the delay seen last of each stop of a trip, unless that is too long ago."""
    last = latest(updates.where("kind = 'delay'").select("trip", "pos", "ts", "event_id", "delay_s"), ["trip", "pos"])
    return last.where(F.lit(now) - F.col("ts") <= ttl).select("trip", "pos", "delay_s", "ts")


def status(cancelled_trip: Column, live_delay: Column, sticky_delay: Column) -> Column:
    """Cancelled beats live beats seen last."""
    return F.when(cancelled_trip, "cancelled").when(live_delay.isNotNull(), "live").when(sticky_delay.isNotNull(), "sticky").otherwise("no_data")


def gate(snapshots: DataFrame, now: int, day: int, ttl: int = SNAPSHOT_TTL) -> DataFrame:
    """Snapshots (generated_at) that count for a query: of its day, and not older than the limit, the limit itself included."""
    return snapshots.where((F.lit(now) - F.col("generated_at") <= ttl) & (F.floor(F.col("generated_at") / 86400) - 10957 == day))


#: Parts that the legs of one class are dealt out to.
LEG_PARTS = 64


def alerts_for_legs(alerts: DataFrame, legs: DataFrame) -> DataFrame:
    """leg, alert: alerts (alert, kind, entity, from, to) that name a leg's trip, line or either stop while it runs.

    A period includes its begin and not its end; a null bound is open. Legs of the same line and
    stops are one class, for which alerts are found and made distinct once; their legs take them
    by an equi-join whose rows are the answer, so pairs are never shuffled. What names a trip is
    found by the trip and added unless the leg's class has it.
    """
    active = (F.col("from").isNull() | (F.col("from") <= F.col("now"))) & (F.col("to").isNull() | (F.col("now") < F.col("to")))
    shared = F.array(*[F.struct("now", F.lit(kind == "stop").alias("stop"), F.col(c).cast("long").alias("entity")) for kind, c in (("route", "line"), ("stop", "board"), ("stop", "alight"))])
    named = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.filter(shared, lambda e: e["entity"].isNotNull())))))
    legs = legs.select("leg", "trip", "line", "board", "alight", "now")
    classes = legs.groupBy("leg").agg(named.alias("class")).withColumn("part", F.pmod(F.xxhash64("leg"), F.lit(LEG_PARTS)))
    held = classes.groupBy("class").agg(F.collect_set("part").alias("parts"))
    entities = held.select("class", "parts", F.explode("class").alias("e")).select("class", "parts", "e.now", F.when(F.col("e.stop"), "stop").otherwise("route").alias("kind"), "e.entity")
    of_class = entities.join(alerts, ["kind", "entity"]).where(active).select("class", "parts", "alert").distinct()
    by_class = classes.join(of_class.select("class", F.explode("parts").alias("part"), "alert").hint("merge"), ["class", "part"]).select("leg", "alert")

    of_trip = alerts.where("kind = 'trip'").withColumnRenamed("entity", "trip")
    pairs = legs.join(of_trip, "trip").where(active).select("leg", "alert").distinct()
    again = of_class.select(F.col("class").alias("its_class"), F.col("alert").alias("its_alert"))
    by_trip = pairs.join(classes.select(F.col("leg").alias("its_leg"), "class"), F.col("leg").eqNullSafe(F.col("its_leg"))).join(again, (F.col("class") == F.col("its_class")) & F.col("alert").eqNullSafe(F.col("its_alert")), "left_anti")
    return by_class.unionByName(by_trip.select("leg", "alert"))


def live_refresh(legs: DataFrame, stop_times: DataFrame, live: DataFrame, last_seen: DataFrame) -> DataFrame:
    """leg, status, dep, arr: stored legs (leg, trip, board_pos, alight_pos) as they stand now."""
    filled = forward_fill(stop_times, live)
    off = cancelled(live).withColumn("off", F.lit(True))
    at = lambda p: filled.select("trip", F.col("pos").alias(f"{p}_pos"), F.col("delay_s").alias(f"{p}_live"))
    seen = lambda p: last_seen.select("trip", F.col("pos").alias(f"{p}_pos"), F.col("delay_s").alias(f"{p}_seen"))
    when = lambda p, c: stop_times.select("trip", F.col("pos").alias(f"{p}_pos"), F.col(c).alias(f"{p}_at"))
    out = legs.join(off, "trip", "left")
    for p, c in (("board", "dep"), ("alight", "arr")):
        out = out.join(when(p, c), ["trip", f"{p}_pos"]).join(at(p), ["trip", f"{p}_pos"], "left").join(seen(p), ["trip", f"{p}_pos"], "left")
    return out.select(
        "leg",
        status(F.coalesce("off", F.lit(False)), F.col("board_live"), F.col("board_seen")).alias("status"),
        apply_delay(F.col("board_at"), F.coalesce("board_live", "board_seen")).alias("dep"),
        apply_delay(F.col("alight_at"), F.coalesce("alight_live", "alight_seen")).alias("arr"),
    )


def transfer_margins(legs: DataFrame) -> DataFrame:
    """plan, seq, next_mode, margin: of each ride, the next ride's mode and its departure less this arrival and the walks between.

    legs has plan, seq, walk (boolean), mode, start, end.
    """
    order = Window.partitionBy("plan").orderBy("seq")
    walked = legs.withColumn("walked", F.sum(F.when(F.col("walk"), F.col("end") - F.col("start")).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ridden = walked.where("not walk")
    nxt = lambda c: F.lead(c).over(order)
    return ridden.select("plan", "seq", nxt("mode").alias("next_mode"), (nxt("start") - F.col("end") - (nxt("walked") - F.col("walked"))).alias("margin"))


def merge_walks(legs: DataFrame) -> DataFrame:
    """plan, seq, walk, start, end, n: adjacent walks become one, from the first start to the last end."""
    order = Window.partitionBy("plan").orderBy("seq")
    new = F.when(F.col("walk") & F.lag("walk", 1, False).over(order), 0).otherwise(1)
    island = legs.withColumn("_new", new).withColumn("island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy("plan", "island").agg(F.min("seq").alias("seq"), F.first("walk").alias("walk"), F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n")).drop("island")


def timeline(legs: DataFrame) -> DataFrame:
    """plan, start, end: walks are chained to the end of what comes before; the first start and the last end."""
    steps = F.array_sort(F.collect_list(F.struct("seq", "walk", "start", "end")))
    fold = F.aggregate(
        steps,
        F.expr("cast(null as bigint)"),
        lambda at, x: F.when(x["walk"] & at.isNotNull(), at + (x["end"] - x["start"])).otherwise(x["end"].cast("long")),
    )
    return legs.groupBy("plan").agg(F.min_by("start", "seq").cast("long").alias("start"), fold.alias("end"))


def poll_statistics(polls: DataFrame) -> DataFrame:
    """feed, succeeded, failed, throttled: how many polls of each feed ended in which way."""
    return polls.groupBy("feed").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("succeeded", "failed", "throttled")])
