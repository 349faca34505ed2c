"""Timetable feeds: a folder of CSV files as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Days from 1970 to 2000.
EPOCH_2000 = 10957


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.csv(f"{folder}/{name}.txt", header=True, escape='"')


def seconds(clock: Column) -> Column:
    """HH:MM:SS after the service day's midnight; hours may pass 24; what isn't a time is null."""
    part = lambda i: F.regexp_extract(clock, r"^\s*(\d+):(\d\d):(\d\d)\s*$", i).cast("int")
    return F.when(clock.rlike(r"^\s*\d+:\d\d:\d\d\s*$"), part(1) * 3600 + part(2) * 60 + part(3))


def day_number(date: Column) -> Column:
    """Days since 2000-01-01, 0 for earlier dates."""
    return F.greatest(F.datediff(F.to_date(date, "yyyyMMdd"), F.lit("2000-01-01")), F.lit(0))


def stops(spark: SparkSession, folder: str) -> DataFrame:
    """Stops with a name and coordinates; others are dropped."""
    s = table(spark, folder, "stops")
    optional = [F.col(c) if c in s.columns else F.lit(None).cast("string").alias(c) for c in ("platform_code", "parent_station", "wheelchair_boarding")]
    return s.select("stop_id", F.col("stop_name").alias("name"), F.col("stop_lat").cast("double").alias("lat"), F.col("stop_lon").cast("double").alias("lon"), *optional).where("name is not null and lat is not null and lon is not null")


def stop_times(spark: SparkSession, folder: str) -> DataFrame:
    """trip_id, pos (dense from 0), stop_id, arr, dep, board_ok, alight_ok, with line and svc of the trip."""
    from pyspark.sql import Window

    t, trips = table(spark, folder, "stop_times"), table(spark, folder, "trips")
    allowed = lambda c: F.coalesce(F.col(c).cast("int"), F.lit(0)) != 1 if c in t.columns else F.lit(True)
    order = Window.partitionBy("trip_id").orderBy(F.col("stop_sequence").cast("int"))
    rows = t.select("trip_id", (F.row_number().over(order) - 1).alias("pos"), "stop_id", seconds(F.col("arrival_time")).alias("a"), seconds(F.col("departure_time")).alias("b"), allowed("pickup_type").alias("board_ok"), allowed("drop_off_type").alias("alight_ok"))
    return rows.join(trips.select("trip_id", F.col("route_id").alias("line"), F.col("service_id").alias("svc")), "trip_id").select("trip_id", "line", "svc", "pos", "stop_id", F.coalesce("a", "b").alias("arr"), F.coalesce("b", "a").alias("dep"), "board_ok", "alight_ok")


def services(spark: SparkSession, folder: str, has_calendar: bool = True, has_dates: bool = True) -> DataFrame:
    """svc, days, start, end, added, removed. A service with exception dates alone has an unlimited range and no weekdays."""
    days = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
    none = F.expr("cast(array() as array<int>)")
    regular = extra = None
    if has_calendar:
        mask = sum((F.col(d).cast("int") * (1 << i) for i, d in enumerate(days)), F.lit(0))
        regular = table(spark, folder, "calendar").select(F.col("service_id").alias("svc"), mask.alias("days"), day_number(F.col("start_date")).alias("start"), day_number(F.col("end_date")).alias("end"))
    if has_dates:
        d = table(spark, folder, "calendar_dates").select(F.col("service_id").alias("svc"), day_number(F.col("date")).alias("day"), F.col("exception_type").alias("x"))
        of = lambda k: F.array_sort(F.collect_set(F.when(F.col("x") == k, F.col("day"))))
        extra = d.groupBy("svc").agg(of("1").alias("added"), of("2").alias("removed"))
    if regular is None:
        return extra.select("svc", F.lit(0).alias("days"), F.lit(0).alias("start"), F.lit(2**31 - 1).alias("end"), "added", "removed")
    if extra is None:
        return regular.select("*", none.alias("added"), none.alias("removed"))
    both = regular.join(extra, "svc", "full_outer")
    return both.select("svc", F.coalesce("days", F.lit(0)).alias("days"), F.coalesce("start", F.lit(0)).alias("start"), F.coalesce("end", F.lit(2**31 - 1)).alias("end"), F.coalesce("added", none).alias("added"), F.coalesce("removed", none).alias("removed"))


def bikes_allowed(spark: SparkSession, folder: str) -> DataFrame:
    """trip_id, bikes: true, false, or null where the feed doesn't say."""
    t = table(spark, folder, "trips")
    said = F.col("bikes_allowed") if "bikes_allowed" in t.columns else F.lit(None).cast("string")
    return t.select("trip_id", F.when(said == "1", True).when(said == "2", False).alias("bikes"))


def content_hash(files: DataFrame) -> str:
    """A digest of a folder's files (path, content of the format binaryFile) that doesn't depend on their order."""
    one = files.select(F.concat_ws(":", F.regexp_extract("path", "[^/]*$", 0), F.sha2("content", 256)).alias("x"))
    return one.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("x")), ","), 256)).first()[0]  # a row per file of a feed
