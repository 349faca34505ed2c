"""One function for each field that clients may ask for; each returns a DataFrame, many requests at once where that makes sense."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import address, isochrone, realtime, schedule, search
from . import network as net

#: What a request may ask for at most, in seconds but for the window in minutes; and grid steps in metres.
MOST_WINDOW_MIN, MOST_WALK, MOST_SLACK, MOST_ISOCHRONE, GRID_STEP = 1440, 3600, 7200, 14400, (10, 1000)


def reject_over(name: str, value: float, most: float) -> None:
    if value > most:
        raise ValueError(f"{name} {value} is over {most}")


def ping(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.lit("pong").alias("ping"))


def address_attribution(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.lit("Addresses: public address register").alias("attribution"))


def realtime_generated_at(updates: DataFrame) -> DataFrame:
    return updates.agg(F.max("ts").alias("generated_at"))


def plan(spark: SparkSession, sf_dir: str, requests: DataFrame, live: DataFrame | None = None, rounds: int = 3, walk_seconds: int = MOST_WALK) -> DataFrame:
    """request, arr, path for requests (request, origin, destination, start); with live updates over the overlay."""
    reject_over("walk_seconds", walk_seconds, MOST_WALK)
    times = net.active_stop_times(spark, sf_dir)
    if live is not None:
        times = realtime.overlay(times, realtime.latest(live, ["trip", "pos"]))
    seeds = requests.select("request", F.col("origin").alias("stop"), F.col("start").alias("arr"))
    found = search.journeys(seeds, times, net.transfers(spark, sf_dir).where(F.col("w") <= walk_seconds), rounds)
    return found.join(requests.select("request", F.col("destination").alias("stop")), ["request", "stop"]).select("request", "arr", "path")


def plan_onboard(spark: SparkSession, sf_dir: str, riders: DataFrame, rounds: int = 2) -> DataFrame:
    """request, stop, arr for riders (request, trip, pos)."""
    seeds = search.onboard_seeds(net.stop_times(spark, sf_dir), riders)
    return search.earliest_arrival(seeds, net.active_stop_times(spark, sf_dir), net.transfers(spark, sf_dir), rounds)


def explain_plan(spark: SparkSession, sf_dir: str, requests: DataFrame, rounds: int = 2) -> DataFrame:
    """request, stop, boardings, arr, kept: every candidate by number of boardings, and whether fewer boardings beat it."""
    from pyspark.sql import Window

    seeds = requests.select("request", F.col("origin").alias("stop"), F.col("start").alias("arr"))
    found = search.rounds_profile(seeds, net.active_stop_times(spark, sf_dir), net.transfers(spark, sf_dir), rounds)
    before = Window.partitionBy("request", "stop").orderBy("boardings").rowsBetween(Window.unboundedPreceding, -1)
    best = F.min("arr").over(before)
    return found.withColumn("kept", best.isNull() | (F.col("arr") < best))


def leg_alternatives(spark: SparkSession, sf_dir: str, legs: DataFrame, before: int = 0, after: int = 0) -> DataFrame:
    return schedule.backups(schedule.rides(net.active_stop_times(spark, sf_dir)), legs, before, after)


def station_backups(spark: SparkSession, sf_dir: str, legs: DataFrame, before: int = 0, after: int = 3) -> DataFrame:
    return leg_alternatives(spark, sf_dir, legs, before, after)


def live_refresh(spark: SparkSession, sf_dir: str, legs: DataFrame, now: int) -> DataFrame:
    updates = net.updates(spark, sf_dir)
    return realtime.live_refresh(legs, net.stop_times(spark, sf_dir), realtime.latest(updates, ["trip", "pos"]), realtime.sticky(updates, now))


def travel_time_map(spark: SparkSession, sf_dir: str, origin: int, start: int, most: int, window_end: int | None = None, aggregation: str = "best", step_seconds: int = 180) -> DataFrame:
    """gr, gc, seconds from a stop; over a window the best or the average of sampled departures."""
    reject_over("most", most, MOST_ISOCHRONE)
    samples = isochrone.window_departures(start, window_end) if window_end else [start]
    seeds = spark.createDataFrame([(s, origin, s) for s in samples], "request long, stop long, arr int")
    arrivals = search.earliest_arrival(seeds, net.active_stop_times(spark, sf_dir), net.transfers(spark, sf_dir), rounds=2)
    field = isochrone.field(arrivals.select("request", "stop", (F.col("arr") - F.col("request")).cast("int").alias("seconds")), net.stops(spark, sf_dir), most, step_seconds)
    return isochrone.best(field) if aggregation == "best" else isochrone.average(field, len(samples), most)


def gtfs_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    modes = schedule.first_mode(net.stop_times(spark, sf_dir), net.stops(spark, sf_dir), net.route_type())
    return net.stops(spark, sf_dir).join(modes, "stop")


def gtfs_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.stations(net.stops(spark, sf_dir), net.stop_times(spark, sf_dir), net.route_type())


def gtfs_agencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .schedule_queries import agencies_with_routes

    return agencies_with_routes(spark, sf_dir)


def search_addresses(queries: DataFrame, records: DataFrame, limit: int = 10, focus: tuple[float, float] | None = None) -> DataFrame:
    return address.rank(queries, records, limit, focus)
