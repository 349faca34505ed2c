"""Queries that put plans together, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codes
from ..functions import reliability as rel
from ..functions.geo import RAIL_RADIUS, haversine
from ..operators import assembly
from . import network as net
from .network import sql
from .places_queries import _hav
from .realtime_queries import _MASS, _PROB, _bins, _margins
from .schedule_queries import _PLAN, _plans

MODES = ("walk", "bike", "car")
DATES, TIMES = ("2024-02-29", "2023-02-29", "24-1-1", "1999-12-31"), ("08:30", "23:59:59", "24:00", "7:05", "noon")


def _mode(key: str):
    return F.element_at(F.array(*map(F.lit, MODES)), (F.col(key) % 3 + 1).cast("int"))


def alert_labels(spark, d):
    code = (F.col("event_id") % 16).cast("int")
    return net.updates(spark, d).where("kind = 'cancelled'").select("event_id", codes.cause(code).alias("cause"), codes.effect(code).alias("effect"), codes.route_type((F.col("event_id") % 12).cast("int")).alias("type"))


def node_flags(spark, d):
    pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (F.floor(F.col("p_partkey") / by) % len(values) + 1).cast("int"))
    return spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("node"), codes.node_flags(pick((None, "traffic_signals", "elevator"), 1), pick((None, "traffic_signals", "unmarked", "uncontrolled", "zebra"), 3)).alias("flags"))


def service_days(spark, d):
    return net.updates(spark, d).select("event_id", codes.service_day(F.col("ts")).alias("day"))


def query_times(spark, d):
    pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (F.floor(F.col("request") / by) % len(values) + 1).cast("int"))
    return net.requests(spark, d).select("request", codes.query_day(pick(DATES, 1)).alias("day"), codes.query_seconds(pick(TIMES, 4)).alias("seconds"))


def shifted_plans(spark, d):
    shift = F.when(F.col("id") % 2 == 0, 86400).otherwise(-86400)
    return _plans(spark, d).select("id", codes.shifted(F.col("start"), shift).cast("long").alias("start"), codes.shifted(F.col("end"), shift).cast("long").alias("end"))


def capped_prices(spark, d):
    known, rail = (F.col("km") * 30 + 500).cast("long"), (F.col("km") * 20).cast("long")
    cap, fixed = F.when(F.col("seq") % 2 == 0, 900), F.when(F.col("board_stop") % 5 == 0, 1190).otherwise(0)
    return net.boardings(spark, d).select("user_id", "seq", codes.output_cents(known, rail, cap).alias("cents"), codes.airport_cents(known, rail, fixed).alias("airport"))


def airport_stops(spark, d):
    return net.stops(spark, d).select("stop", F.upper("name").contains("0000005").alias("airport"))


def endpoint_stops(spark, d):
    asked = net.requests(spark, d).select("request", F.when(F.col("request") % 3 == 0, F.col("request") % 40).alias("station"))
    snapped = net.requests(spark, d).select("request", F.col("origin").alias("stop"), (F.col("request") % 300).cast("int").alias("seconds"))
    return assembly.endpoints(asked, net.stops(spark, d), snapped)


def station_endpoints(spark, d):
    return assembly.station_centroids(net.stops(spark, d)).select("parent", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), F.array_join("platforms", ",").alias("platforms"))


def _access(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select((F.col("user_id")).alias("request"), _mode("event_id").alias("state"), (F.col("event_id") % 17).alias("stop"), (F.floor("value") * 7 + 60).cast("int").alias("seconds"))


def access_by_state(spark, d):
    egress = net.boardings(spark, d).where("seq = 1").select(F.col("user_id").alias("request"), (F.col("board_stop") % 17).alias("stop"))
    return assembly.access_by_state(_access(spark, d), egress)


def merged_access(spark, d):
    return assembly.merged_access(_access(spark, d))


def arrival_cutoffs(spark, d):
    return assembly.arrival_cutoffs(_access(spark, d).where("request % 4 > 0 or state <> 'walk'").select("request", F.col("state").alias("mode"), F.col("seconds").alias("arr"), (F.col("stop") * 10).alias("egress")), 900)


def riding_front(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_suppkey").alias("cell"), (F.col("l_partkey") % 2).alias("state"), (F.col("l_orderkey") % 97).alias("trip_rank"), F.floor(F.col("l_discount") * 50 + 0.5).cast("int").alias("bucket"))
    return assembly.riding_front(rows)


def access_grouping(spark, d):
    plans = _plans(spark, d).select("request", "id", F.when(F.col("transfers") > 0, F.col("transfers") * 10 + F.col("bucket")).alias("core"), _mode("burden").alias("mode"), "start", "end", (F.col("id") % 50).alias("street"))
    return assembly.group_access(plans)


def plan_result_order(spark, d):
    return assembly.plan_order(_plans(spark, d).withColumn("walking", F.col("id") % 7))


def direct_plans(spark, d):
    p = _plans(spark, d)
    direct = p.where("transfers = 0").select("request", "id", (F.col("end") - F.col("start")).alias("seconds"))
    best = p.where("transfers > 0").groupBy("request").agg(F.min(F.col("end") - F.col("start")).alias("seconds"))
    return assembly.direct_within(direct, best, 300).select("request", "id")


def path_moments(spark, d):
    steps = net.boardings(spark, d).select(F.expr("user_id * 100 + (seq - 1) div 10").alias("path"), (F.col("km") * 2.0).alias("mean"), F.when(F.col("board_stop") % 3 == 0, 144.0).otherwise(9.0).alias("var"))
    return assembly.path_moments(steps).select("path", "mean", F.round("var", 6).alias("var"))


def rail_metres(spark, d):
    from pyspark.sql import Window

    before = Window.partitionBy("trip").orderBy("pos")
    s = net.stop_times(spark, d).where("line % 4 = 3").join(net.stops(spark, d).select("stop", "lat", "lon"), "stop").select("trip", "pos", "lat", "lon", F.lag("lat").over(before).alias("lat0"), F.lag("lon").over(before).alias("lon0"))
    return assembly.running_metres(s, haversine(F.col("lat0"), F.col("lon0"), F.col("lat"), F.col("lon"), RAIL_RADIUS)).select("trip", "pos", F.round("metres", 2).alias("metres"))


def catch_reliability(spark, d):
    return _margins(spark, d).select("mode", "margin", F.round(rel.at_least(F.col("bins"), -F.col("margin")), 9).alias("p"))


def transfer_reliability_live(spark, d):
    """By feeder, boarded mode and margin; null without a feeder's model, certain punctuality of the boarded one without its own."""
    bins = _bins(spark, d).where("mode <> 'tram'")
    feeder = F.element_at(F.array(*map(F.lit, ("bus", "rail", "subway", "tram"))), (F.col("id") + 1).cast("int"))
    pairs = spark.range(4).select(feeder.alias("feeder"), F.explode(F.sequence(F.lit(-120), F.lit(300), F.lit(60))).alias("margin"))
    return pairs.join(F.broadcast(bins.select(F.col("mode").alias("feeder"), "bins")), "feeder", "left").select("feeder", "margin", F.round(F.when(F.col("bins").isNotNull(), rel.on_time(F.col("bins"), F.col("margin"))), 9).alias("p"))


def newest_changes(spark, d):
    events = net.updates(spark, d).select("ts", F.col("event_id").alias("event"), (F.col("trip") % 50).alias("journey"), "kind")
    return assembly.changes(events, journey=7)


QUERIES = {f.__name__: f for f in (
    alert_labels, node_flags, service_days, query_times, shifted_plans, capped_prices, airport_stops, endpoint_stops, station_endpoints, access_by_state, merged_access, arrival_cutoffs, riding_front, access_grouping, plan_result_order, direct_plans, path_moments, rail_metres,
    catch_reliability, transfer_reliability_live, newest_changes,
)}


def _list(values) -> str:
    return "list_value(" + ", ".join("null" if v is None else f"'{v}'" for v in values) + ")"


_ACCESS = f""", acc as (select user_id as request, {_list(MODES)}[event_id % 3 + 1] as state, event_id % 17 as stop, cast(floor(value) * 7 + 60 as int) as seconds from events)"""
_TYPES = _list([codes.ROUTE_TYPES.get(k, "Other") for k in range(12)])
_GROUP = _PLAN + f""", g as (select request, id, case when transfers > 0 then transfers * 10 + bucket end as core, burden % 3 as b, {_list(MODES)}[burden % 3 + 1] as mode, "start", "end", id % 50 as street from plans),
  f as (select request, core, id as first, "end" as first_end, mode as own from (select *, row_number() over (partition by request, core order by b, "end", "start" desc, street, id) as k from g where core is not null) where k = 1),
  j as (select g.*, f.first, f.first_end, f.own from g join f using (request, core)),
  o as (select request, core, mode, b, "start" from (select *, row_number() over (partition by request, core, mode order by "start" desc) as k from j where id <> first and "end" >= first_end and mode <> own) where k = 1),
  s as (select request, core, string_agg(mode || ':' || "start", ',' order by b, "start") as alternatives from o group by request, core)"""

ORACLES = {
    "alert_labels": sql(f" select event_id, coalesce({_list(codes.CAUSES)}[nullif(event_id % 16, 0)], 'UNKNOWN_CAUSE') as cause, coalesce({_list(codes.EFFECTS)}[nullif(event_id % 16, 0)], 'UNKNOWN_EFFECT') as effect, {_TYPES}[event_id % 12 + 1] as type from updates where kind = 'cancelled'"),
    "node_flags": f"with t as (select p_partkey as node, {_list((None, 'traffic_signals', 'elevator'))}[p_partkey % 3 + 1] as h, {_list((None, 'traffic_signals', 'unmarked', 'uncontrolled', 'zebra'))}[p_partkey // 3 % 5 + 1] as c from part) select node, cast(case when h = 'traffic_signals' or c = 'traffic_signals' then 1 else 0 end + case when c in ('unmarked', 'uncontrolled') then 2 else 0 end + case when h = 'elevator' then 4 else 0 end as int) as flags from t",
    "service_days": sql(" select event_id, cast(floor((ts + 3600) / 86400.0) as int) - 10957 as day from updates"),  # the events lie in winter, an hour before UTC
    "query_times": sql(f" select request, date_diff('day', date '2000-01-01', try_cast({_list([x if len(x) == 10 else None for x in DATES])}[request % 4 + 1] as date)) as day, list_value(30600, 86399, null, 25500, null)[request // 4 % 5 + 1] as seconds from requests"),
    "shifted_plans": sql(_PLAN + """ select id, greatest("start" - case when id % 2 = 0 then 86400 else -86400 end, 0) as "start", greatest("end" - case when id % 2 = 0 then 86400 else -86400 end, 0) as "end" from plans"""),
    "capped_prices": sql(" select user_id, seq, km * 30 + 500 - km * 20 + case when seq % 2 = 0 then least(km * 20, 900) else km * 20 end as cents, case when board_stop % 5 = 0 then greatest(km * 10 + 500, 0) + 1190 else km * 30 + 500 end as airport from boardings"),
    "airport_stops": sql(" select stop, contains(upper(name), '0000005') as airport from stops"),
    "endpoint_stops": sql(""", p as (select r.request, s.stop, 0 as seconds from requests r join stops s on s.parent = r.request % 40 where r.request % 3 = 0)
      select * from p union all select request, origin, cast(request % 300 as int) from requests where request not in (select request from p)"""),
    "station_endpoints": sql(" select parent, round(avg(lat), 6) as lat, round(avg(lon), 6) as lon, string_agg(stop, ',' order by stop) as platforms from stops group by parent"),
    "access_by_state": sql(_ACCESS + ", eg as (select distinct user_id as request, board_stop % 17 as stop from boardings where seq = 1) select request, state, stop, min(seconds) as seconds from acc a where state = 'walk' or not exists (select 1 from eg where eg.request = a.request and eg.stop = a.stop) group by request, state, stop"),
    "merged_access": sql(_ACCESS + " select request, stop, min(seconds) as seconds from acc group by request, stop"),
    "arrival_cutoffs": sql(_ACCESS + """, x as (select request, case state when 'walk' then 0 when 'bike' then 1 else 2 end as b, seconds + stop * 10 as t from acc where request % 4 > 0 or state <> 'walk')
      select r.request, b.burden, (select min(t) from x where x.request = r.request and x.b <= b.burden) + 900 as cutoff from (select distinct request from x) r, (select cast(unnest(range(3)) as int) as burden) b"""),
    "riding_front": "with p as (select distinct l_suppkey as cell, l_partkey % 2 as state, l_orderkey % 97 as trip_rank, cast(floor(l_discount * 50 + 0.5) as int) as bucket from lineitem) select * from p b where not exists (select 1 from p a where a.cell = b.cell and a.state = b.state and a.trip_rank <= b.trip_rank and a.bucket >= b.bucket and (a.trip_rank < b.trip_rank or a.bucket > b.bucket))",
    "access_grouping": sql(_GROUP + """ select request, id, case when id = first then coalesce(alternatives, '') else '' end as alternatives from j left join s using (request, core) where id = first or "end" < first_end union all select request, id, '' from g where core is null"""),
    "plan_result_order": sql(_PLAN + """ select request, id, row_number() over (partition by request order by "end", "start" desc, bucket desc, burden, id % 7, id) as place from plans"""),
    "direct_plans": sql(_PLAN + """ select request, id from plans p where transfers = 0 and "end" - "start" <= coalesce((select min(q."end" - q."start") from plans q where q.request = p.request and q.transfers > 0) + 300, 1e9)"""),
    "path_moments": sql(", s as (select user_id * 100 + (seq - 1) // 10 as path, sum(km * 2.0::double) as mean, sum(case when board_stop % 3 = 0 then 144.0::double else 9.0::double end) as v from boardings group by path) select path, mean, round(v + pow(0.05::double * mean, 2), 6) as var from s"),
    "rail_metres": sql(f""", s as (select trip, pos, lat, lon, lag(lat) over w as lat0, lag(lon) over w as lon0 from stop_times join stops using (stop) where line % 4 = 3 window w as (partition by trip order by pos))
      select trip, pos, round(coalesce(sum({_hav('lat0', 'lon0', 'lat', 'lon', RAIL_RADIUS)}) over (partition by trip order by pos), 0), 2) as metres from s"""),
    "catch_reliability": sql(_MASS + " select m.mode, g.margin, round(coalesce((select sum(x.p) from mass x where x.mode = m.mode and x.delay_s >= -g.margin), 0), 9) as p from modes m, margins g"),
    "transfer_reliability_live": sql(", m as (select unnest(['bus', 'rail', 'subway', 'tram']) as feeder), g as (select cast(unnest(range(-2, 6)) * 60 as int) as margin) select feeder, margin, case when feeder <> 'tram' then round(" + _PROB.format(m="m.feeder", x="g.margin") + ", 9) end as p from m, g"),
    "newest_changes": sql(" select ts, event_id as event, trip % 50 as journey, kind from updates where trip % 50 = 7"),
}
