"""Lookups in a timetable: services, patterns, hops, stations, transfers, departures and alternatives.

Stop times have the columns trip, line, svc, pos, stop, arr, dep; times are seconds after the
service day's midnight and may exceed 24 hours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stop_grid_transfers(stops: DataFrame, most_steps: int, step_seconds: int) -> DataFrame:
    """f, t, w: pairs of stops at most so many steps apart on the grid (gr, gc).

    Stops meet by equal cells: one side is repeated for each offset within reach, so the join
    is an equi-join whose output is the result itself.
    """
    reach = [(r, c) for r in range(-most_steps, most_steps + 1) for c in range(-most_steps, most_steps + 1) if 0 < abs(r) + abs(c) <= most_steps]
    offsets = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c"), F.lit((abs(r) + abs(c)) * step_seconds).alias("w")) for r, c in reach])
    out = stops.select(F.col("stop").alias("f"), "gr", "gc", F.explode(offsets).alias("o")).select("f", (F.col("gr") + F.col("o.r")).alias("gr"), (F.col("gc") + F.col("o.c")).alias("gc"), F.col("o.w").alias("w"))
    return out.join(stops.select(F.col("stop").alias("t"), "gr", "gc"), ["gr", "gc"]).select("f", "t", "w")


def weekday_bit(day: Column) -> Column:
    """The bit of a day counted from 2000-01-01, a Saturday; Monday is 1."""
    return F.pow(F.lit(2), (day + 5) % 7).cast("int")


def service_active(day: Column) -> Column:
    """Whether a service (days, start, end, added, removed) runs on a day: removed beats added beats the calendar."""
    regular = day.between(F.col("start"), F.col("end")) & (F.col("days").bitwiseAND(weekday_bit(day)) != 0)
    return ~F.array_contains("removed", day) & (F.array_contains("added", day) | regular)


def patterns(stop_times: DataFrame) -> DataFrame:
    """stops (array), n_trips, first_trip, line: trips of equal stop sequence; the line is that of the smallest trip."""
    of_trip = stop_times.groupBy("trip", "line").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "stop"))), lambda x: x["stop"]).alias("stops"))
    return of_trip.groupBy("stops").agg(F.count(F.lit(1)).alias("n_trips"), F.min("trip").alias("first_trip"), F.min_by("line", "trip").alias("line"))


def stop_patterns(found: DataFrame) -> DataFrame:
    """stop, first_trip, pos: the inverse of patterns, each pattern named by its first trip."""
    return found.select("first_trip", F.posexplode("stops").alias("pos", "stop")).select("stop", "first_trip", "pos")


def hops(stop_times: DataFrame) -> DataFrame:
    """trip, line, svc, pos, f, t, dep, arr: rides to the next stop."""
    later = Window.partitionBy("trip").orderBy("pos")
    return stop_times.select("trip", "line", "svc", "pos", F.col("stop").alias("f"), "dep", F.lead("stop").over(later).alias("t"), F.lead("arr").over(later).alias("arr")).where("t is not null")


def hop_timetable(found: DataFrame) -> DataFrame:
    """Per hop (f, t, line): its number of trips, first and last departure, and each departure's rank."""
    order = Window.partitionBy("f", "t", "line").orderBy("dep", "trip")
    return found.select("f", "t", "line", "trip", "dep", "arr", F.row_number().over(order).alias("rank"))


def rides(stop_times: DataFrame, columns: tuple[str, ...] = ()) -> DataFrame:
    """All ways to board a trip and leave it later: trip, line, svc, board, dep, board_pos, alight, arr, alight_pos."""
    board = stop_times.select("trip", "line", "svc", F.col("stop").alias("board"), "dep", F.col("pos").alias("board_pos"), *columns)
    alight = stop_times.select("trip", F.col("stop").alias("alight"), "arr", F.col("pos").alias("alight_pos"))
    return board.join(alight, "trip").where("alight_pos > board_pos")


def leg_times(stop_times: DataFrame, legs: DataFrame) -> DataFrame:
    """legs (trip, board, alight) with departure and arrival of the trip's earliest such ride; legs that it doesn't make are left out."""
    found = rides(stop_times).join(legs, ["trip", "board", "alight"])
    return found.groupBy("trip", "board", "alight").agg(F.min(F.struct("dep", "arr")).alias("x")).select("trip", "board", "alight", "x.dep", "x.arr")


def stations(stops: DataFrame, stop_times: DataFrame, mode: Column) -> DataFrame:
    """parent, n_stops, lat, lon, modes, lines: platforms of a station with their centroid and ordered lines."""
    places = stops.groupBy("parent").agg(F.count(F.lit(1)).alias("n_stops"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    served = stop_times.select("stop", "line", mode.alias("mode")).distinct().join(stops.select("stop", "parent"), "stop")
    lines = served.groupBy("parent").agg(F.array_sort(F.collect_set("mode")).alias("modes"), F.array_sort(F.collect_set("line")).alias("lines"))
    return places.join(lines, "parent", "left")


def departures(found: DataFrame, asked: DataFrame, count: int, after: bool = True) -> DataFrame:
    """For each request (request, stop, time) the next departures at its stop from that time on, or the previous ones, nearest first.

    An as-of join without a range: requests and departures of a stop are sorted together and a
    running maximum of the departures' ranks gives each request its place; the wanted ranks
    then join by equality. What is made is the answer's size, however many departures there are.
    """
    order = Window.partitionBy("stop").orderBy("dep", "trip")
    ranked = found.select("stop", "trip", "line", "dep", F.row_number().over(order).alias("n"))
    marks = ranked.select("stop", F.col("dep").alias("time"), F.lit(None).cast("long").alias("request"), "n").unionByName(asked.select("stop", "time", F.col("request").cast("long"), F.lit(None).cast("int").alias("n")))
    before = F.coalesce(F.max("n").over(Window.partitionBy("stop").orderBy("time", F.col("request").isNull()).rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    placed = marks.withColumn("before", before).where("request is not null")
    wanted = F.sequence(F.lit(1), F.lit(count))
    n = F.col("before") + F.col("rank") if after else F.col("before") + 1 - F.col("rank")
    return placed.select("stop", "time", "request", "before", F.explode(wanted).alias("rank")).select("stop", "time", "request", "rank", n.alias("n")).where("n > 0").join(ranked, ["stop", "n"]).drop("n")


def first_departure(found: DataFrame, asked: DataFrame) -> DataFrame:
    """request, trip, dep: the first departure at or after the asked time."""
    return departures(found, asked, 1).select("request", "trip", "dep")


def headways(found: DataFrame, tolerance: float = 0.2) -> DataFrame:
    """stop, line, n, minutes: where at least three departures have gaps that all lie within tolerance of their upper median, the period in whole minutes; else null."""
    order = Window.partitionBy("stop", "line").orderBy("dep", "trip")
    gaps = found.withColumn("gap", F.col("dep") - F.lag("dep").over(order)).groupBy("stop", "line").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("gap")).alias("gaps"))
    median = F.element_at("gaps", F.expr("cast(size(gaps) div 2 + 1 as int)"))
    even = F.forall("gaps", lambda g: F.abs(g - median) <= median * tolerance)
    return gaps.select("stop", "line", "n", F.when((F.col("n") >= 3) & even & (median > 0), F.floor(median / 60 + 0.5).cast("int")).alias("minutes"))


def cross_route(ways: DataFrame, board: int, alight: int, around: int, exclude_line: int, count: int, after: bool = True) -> DataFrame:
    """Trips of other lines between two stops around a time, each trip once, nearest first."""
    rank = Window.orderBy(F.col("dep") if after else F.desc("dep"), "trip")
    bound = F.col("dep") >= around if after else F.col("dep") < around
    once = ways.where((F.col("board") == board) & (F.col("alight") == alight) & (F.col("line") != exclude_line) & bound).groupBy("trip", "line").agg(F.min(F.struct("dep", "arr")).alias("x")).select("trip", "line", "x.dep", "x.arr")
    return once.orderBy(F.col("dep") if after else F.desc("dep"), "trip").limit(count).withColumn("rank", F.row_number().over(rank))


def backups(ways: DataFrame, legs: DataFrame, before: int, after: int) -> DataFrame:
    """For each leg (leg, trip, board, alight, dep) other trips between its stops: the last so many before, the first so many after.

    As in departures, legs find their place among the ranked trips of their pair of stops, and
    only the ranks around it join; one more to either side makes up for the leg's own trip.
    """
    pair = ["board", "alight"]
    once = ways.groupBy(*pair, F.col("trip").alias("other")).agg(F.min(F.struct("dep", "arr")).alias("x")).select(*pair, "other", F.col("x.dep").alias("other_dep"), F.col("x.arr").alias("other_arr"))
    ranked = once.withColumn("n", F.row_number().over(Window.partitionBy(*pair).orderBy("other_dep", "other")))
    marks = ranked.select(*pair, F.col("other_dep").alias("dep"), F.lit(None).cast("long").alias("leg"), "n").unionByName(legs.select(*pair, "dep", F.col("leg").cast("long"), F.lit(None).cast("int").alias("n")))
    run = Window.partitionBy(*pair).orderBy("dep", F.col("leg").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    placed = marks.withColumn("at", F.coalesce(F.max("n").over(run), F.lit(0))).where("leg is not null")
    near = placed.select(*pair, "leg", "dep", F.explode(F.sequence(F.col("at") - before, F.col("at") + after + 1)).alias("n"))
    found = near.join(ranked, [*pair, "n"]).where("other <> leg").withColumn("early", F.col("other_dep") < F.col("dep"))
    side = Window.partitionBy("leg", "early")
    rank = F.when(F.col("early"), F.row_number().over(side.orderBy(F.desc("other_dep"), F.desc("other")))).otherwise(F.row_number().over(side.orderBy("other_dep", "other")))
    return found.withColumn("rank", rank).where(F.col("rank") <= F.when(F.col("early"), before).otherwise(after)).select("leg", "other", "other_dep", "other_arr", "early", "rank")


def latest_departure(ways: DataFrame, asked: DataFrame) -> DataFrame:
    """For each request (request, board, alight, by): the latest departure that arrives by then; ties take the smallest trip."""
    got = asked.join(ways, ["board", "alight"]).where("arr <= by")
    return got.groupBy("request").agg(F.max(F.struct("dep", (-F.col("trip")).alias("t"), "arr")).alias("x")).select("request", (-F.col("x.t")).alias("trip"), "x.dep", "x.arr")


def following_trips(stop_times: DataFrame) -> DataFrame:
    """Per stop time: the next trip of its line and position by departure, and when that trip arrives at its end."""
    order = Window.partitionBy("line", "pos").orderBy("dep", "trip")
    ends = stop_times.groupBy("trip").agg(F.max("arr").alias("end"))
    return stop_times.join(ends, "trip").select("trip", "line", "pos", "dep", F.lead("trip").over(order).alias("next_trip"), F.lead("dep").over(order).alias("next_dep"), F.lead("end").over(order).alias("next_end"))


def first_mode(stop_times: DataFrame, stops: DataFrame, mode: Column) -> DataFrame:
    """stop, mode: the mode of the smallest line that serves a stop; bus where none does."""
    found = stop_times.groupBy("stop").agg(F.min_by(mode, "line").alias("mode"))
    return stops.select("stop").join(found, "stop", "left").select("stop", F.coalesce("mode", F.lit("bus")).alias("mode"))
