"""A transit network projected from the tables at hand: stops, trips, stop times, transfers, delays and live updates.

Every projection is a narrow map of one table, so it prunes columns and pushes filters down to
the scan; nothing is shuffled but where a distribution is built.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.schedule import service_active, stop_grid_transfers

POSITIONS = 6
DWELL = 20
LINES = 40
#: Seconds of walking for a step of the grid, and steps that a transfer may take.
STEP_SECONDS, MOST_STEPS = 360, 2
#: The service day of queries that name none, counted from 2000-01-01.
QUERY_DAY = 8768


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_stops(spark: SparkSession, sf_dir: str) -> int:
    return _table(spark, sf_dir, "supplier").count()


def n_trips(spark: SparkSession, sf_dir: str) -> int:
    return _table(spark, sf_dir, "orders").count()


def stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    row, column = (key % 10).cast("int"), F.expr("s_suppkey div 10").cast("int")
    return _table(spark, sf_dir, "supplier").select(
        key.alias("stop"), row.alias("gr"), column.alias("gc"), (50 + row * 0.004).alias("lat"), (4 + column * 0.006).alias("lon"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("long").alias("parent")
    )


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return _table(spark, sf_dir, "orders").select(
        key.alias("trip"),
        (F.col("o_custkey") % LINES).cast("int").alias("line"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("svc"),
        (18000 + key * 97 % 57600).cast("int").alias("dep0"),
        (240 + 60 * (key % 3)).cast("int").alias("run"),
    )


def stop_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trip, line, svc, pos, stop, arr, dep."""
    n = n_stops(spark, sf_dir)
    step = F.element_at(F.array(*map(F.lit, (1, 3, 7, 9))), F.col("line") % 4 + 1)
    at = trips(spark, sf_dir).withColumn("pos", F.explode(F.array(*map(F.lit, range(POSITIONS)))))
    arr = F.col("dep0") + F.col("pos") * F.col("run")
    return at.select("trip", "line", "svc", "pos", ((17 * F.col("line") + F.col("pos") * step) % n).cast("long").alias("stop"), arr.alias("arr"), (arr + DWELL).alias("dep"))


def active_stop_times(spark: SparkSession, sf_dir: str, day: int = QUERY_DAY) -> DataFrame:
    """Stop times of the trips whose service runs on the day."""
    running = services(spark).where(service_active(F.lit(day))).select("svc")
    return stop_times(spark, sf_dir).join(F.broadcast(running), "svc", "left_semi")  # a row per service


def trip_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trips(spark, sf_dir).select("trip", route_type().alias("mode"))


def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """f, t, w: walks between stops of the grid, a table whose size the number of stops bounds."""
    return stop_grid_transfers(stops(spark, sf_dir), MOST_STEPS, STEP_SECONDS)


def route_type(line: str = "line"):
    return F.element_at(F.array(*map(F.lit, ("bus", "tram", "subway", "rail"))), F.col(line) % 4 + 1)


def services(spark: SparkSession) -> DataFrame:
    """svc, days (bit per weekday from Monday), start, end, added, removed."""
    return spark.range(1, 6).select(
        F.col("id").cast("int").alias("svc"),
        F.element_at(F.array(*map(F.lit, (127, 31, 96, 21, 0))), F.col("id").cast("int")).alias("days"),
        F.lit(8760).alias("start"),
        F.lit(8780).alias("end"),
        F.array((F.col("id") + 8766).cast("int"), F.lit(8790)).alias("added"),
        F.array((F.col("id") + 8768).cast("int")).alias("removed"),
    )


def delay_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode = F.expr("case event_type when 'click' then 'bus' when 'view' then 'tram' when 'purchase' then 'subway' when 'signup' then 'rail' end")
    return _table(spark, sf_dir, "events").where("event_type <> 'error'").select(mode.alias("mode"), (F.floor(F.col("value") / 30) * 60 - 60).cast("int").alias("delay_s"))


def updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ts, event_id, trip, pos, delay_s, kind."""
    n = n_trips(spark, sf_dir)
    return _table(spark, sf_dir, "events").select(
        F.unix_timestamp(F.col("ts").cast("timestamp")).alias("ts"),
        "event_id",
        ((F.col("event_id") * 7 + F.col("user_id")) % n).alias("trip"),
        (F.col("user_id") % POSITIONS).cast("int").alias("pos"),
        (F.floor("value") * 10 - 200).cast("int").alias("delay_s"),
        F.expr("case event_type when 'error' then 'cancelled' when 'signup' then 'skipped' else 'delay' end").alias("kind"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = n_stops(spark, sf_dir)
    return _table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("request"), (F.col("c_custkey") % n).alias("origin"), ((F.col("c_custkey") * 7 + 3) % n).alias("destination"), (21600 + F.floor(F.abs("c_acctbal")) % 43200).cast("int").alias("start")
    )


def boardings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, seq, operator, board_stop, alight_stop, board_time, km: rides in the order of time."""
    n = n_stops(spark, sf_dir)
    ts = F.unix_timestamp(F.col("ts").cast("timestamp"))
    order = Window.partitionBy("user_id").orderBy(F.asc_nulls_last("ts"), F.asc_nulls_last("event_id"))  # nulls where SQL has them
    return _table(spark, sf_dir, "events").select(
        "user_id", F.row_number().over(order).alias("seq"), F.col("event_type").alias("operator"), (F.col("event_id") % n).alias("board_stop"), ((F.col("event_id") * 3 + 1) % n).alias("alight_stop"), (ts % 86400).cast("int").alias("board_time"), F.floor("value").cast("int").alias("km")
    )


ACTIVE_SQL = """not list_contains(removed, {day}) and (list_contains(added, {day}) or ({day} between "start" and "end" and (days & cast(pow(2, ({day} + 5) % 7) as int)) <> 0))"""

#: The same tables in DuckDB's SQL.
SQL = f"""
with recursive n as (select count(*) as n from supplier), nt as (select count(*) as nt from orders),
stops as materialized (select s_suppkey as stop, cast(s_suppkey % 10 as int) as gr, cast(s_suppkey // 10 as int) as gc, 50 + (s_suppkey % 10) * cast(0.004 as double) as lat, 4 + (s_suppkey // 10) * cast(0.006 as double) as lon, s_name as name, cast(s_nationkey as bigint) as parent from supplier),
trips as materialized (select o_orderkey as trip, cast(o_custkey % {LINES} as int) as line, cast(substr(o_orderpriority, 1, 1) as int) as svc, cast(18000 + o_orderkey * 97 % 57600 as int) as dep0, cast(240 + 60 * (o_orderkey % 3) as int) as run from orders),
stop_times as materialized (select trip, line, svc, pos, cast((17 * line + pos * list_value(1, 3, 7, 9)[line % 4 + 1]) % n as bigint) as stop, dep0 + pos * run as arr, dep0 + pos * run + {DWELL} as dep
  from trips, n, (select cast(unnest(range({POSITIONS})) as int) as pos)),
transfers as materialized (select a.stop as f, b.stop as t, (abs(a.gr - b.gr) + abs(a.gc - b.gc)) * {STEP_SECONDS} as w from stops a join stops b on a.stop <> b.stop and abs(a.gr - b.gr) + abs(a.gc - b.gc) <= {MOST_STEPS}),
services as (select cast(i as int) as svc, list_value(127, 31, 96, 21, 0)[i] as days, 8760 as "start", 8780 as "end", [i + 8766, 8790] as added, [i + 8768] as removed from (select unnest(range(1, 6)) as i)),
active as materialized (select * from stop_times where svc in (select svc from services where {ACTIVE_SQL.format(day=QUERY_DAY)})),
delay_samples as (select case event_type when 'click' then 'bus' when 'view' then 'tram' when 'purchase' then 'subway' when 'signup' then 'rail' end as mode, cast(floor(value / 30) * 60 - 60 as int) as delay_s from events where event_type <> 'error'),
cdf as materialized (select mode, delay_s, cast(sum(c) over (partition by mode order by delay_s) as double) / sum(c) over (partition by mode) as cum from (select mode, delay_s, count(*) as c from delay_samples group by mode, delay_s)),
updates as materialized (select cast(floor(epoch(ts)) as bigint) as ts, event_id, (event_id * 7 + user_id) % nt as trip, cast(user_id % {POSITIONS} as int) as pos, cast(floor(value) * 10 - 200 as int) as delay_s, case event_type when 'error' then 'cancelled' when 'signup' then 'skipped' else 'delay' end as kind from events, nt),
requests as materialized (select c_custkey as request, c_custkey % n as origin, (c_custkey * 7 + 3) % n as destination, cast(21600 + cast(floor(abs(c_acctbal)) as bigint) % 43200 as int) as "start" from customer, n),
boardings as materialized (select user_id, row_number() over (partition by user_id order by ts, event_id) as seq, event_type as operator, event_id % n as board_stop, (event_id * 3 + 1) % n as alight_stop, cast(cast(floor(epoch(ts)) as bigint) % 86400 as int) as board_time, cast(floor(value) as int) as km from events, n)
"""


def sql(text: str) -> str:
    """A statement over these tables; extra common tables come first, each after a comma."""
    return SQL + text
