"""Queries on stations and platforms, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stations
from . import network as net
from .network import sql
from .places_queries import _hav

RADIUS, CELL = 700.0, 0.02
OPERATORS = ["RED", "CITY", "NORTH"]
AGENCIES = ("City/Red", "Blue Line", "north", "Green", "Yellow", "Violet", "Grey", "redder")


def _platforms(spark, d):
    c = F.col("c_custkey")
    found = spark.read.parquet(f"{d}/customer.parquet").select(c.alias("platform"), (50 + c % 91 * 0.0004).alias("b_lat"), (4 + c % 83 * 0.0007).alias("b_lon"), F.concat(F.lit("P"), (c % 4).cast("string")).alias("b_code"))
    stops = net.stops(spark, d).select("stop", F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"), F.when(F.col("stop") % 9 != 0, F.concat(F.lit("P"), (F.col("stop") % 4).cast("string"))).alias("a_code"))
    return stations.platforms(stops, found)


def platform_match(spark, d):
    return _platforms(spark, d).select("stop", "platform", "same_code", F.round("metres", 4).alias("metres"))


def platform_report(spark, d):
    return stations.spread(_platforms(spark, d)).select("n", F.round("mean", 4).alias("mean"), F.round("p90", 4).alias("p90"), F.round("most", 4).alias("most"))


def orphan_absorption(spark, d):
    s = net.stops(spark, d).withColumn("key", F.concat(F.lit("s"), (F.col("stop") % 3 + F.when(F.col("gc") > 4, 10).otherwise(0)).cast("string")))
    native = s.where("stop % 4 = 0 and gc <= 4").withColumn("station", F.col("stop") + 1000)
    return stations.orphan_parents(native, s.where("stop % 4 <> 0"), CELL, RADIUS)


def fare_operators(spark, d):
    routes = net.trips(spark, d).select(F.col("line").alias("route")).distinct().withColumn("agency", F.element_at(F.array(*map(F.lit, AGENCIES)), F.col("route") % len(AGENCIES) + 1))
    return stations.operator_of(routes, OPERATORS)


def index_invariants(spark, d):
    times, items = net.stop_times(spark, d), spark.read.parquet(f"{d}/lineitem.parquet")
    return stations.violations({
        "stop of stop time": (times, "stop", net.stops(spark, d), "stop"),
        "trip of stop time": (times, "trip", net.trips(spark, d), "trip"),
        "service of trip": (net.trips(spark, d), "svc", net.services(spark), "svc"),
        "supplier of item as stop": (items, "l_suppkey", net.stops(spark, d).where("stop % 2 = 0"), "stop"),
    })


QUERIES = {f.__name__: f for f in (platform_match, platform_report, orphan_absorption, fare_operators, index_invariants)}

_MATCH = f""", p as (select c_custkey as platform, 50 + c_custkey % 91 * cast(0.0004 as double) as y, 4 + c_custkey % 83 * cast(0.0007 as double) as x, 'P' || c_custkey % 4 as code from customer),
  m as (select s.stop, p.platform, p.code = 'P' || s.stop % 4 as same_code, {_hav('s.lat', 's.lon', 'p.y', 'p.x')} as metres from stops s, p where s.stop % 9 <> 0),
  b as (select stop, platform, same_code, metres from (select *, row_number() over (partition by stop order by not same_code, metres, platform) as k from m where metres <= 400) where k = 1)"""
_NAMES = "list_value(" + ", ".join(f"'{a}'" for a in AGENCIES) + ")"

ORACLES = {
    "platform_match": sql(_MATCH + " select stop, platform, same_code, round(metres, 4) as metres from b"),
    "platform_report": sql(_MATCH + " select count(*) as n, round(avg(metres), 4) as mean, round(quantile_disc(metres, 0.9), 4) as p90, round(max(metres), 4) as most from b"),
    "orphan_absorption": sql(f""", s as (select *, 's' || (stop % 3 + case when gc > 4 then 10 else 0 end) as key from stops), native as (select *, stop + 1000 as station from s where stop % 4 = 0 and gc <= 4), orphans as (select * from s where stop % 4 <> 0),
      taken as (select stop, station as parent from (select o.stop, v.station, row_number() over (partition by o.stop order by {_hav('o.lat', 'o.lon', 'v.lat', 'v.lon')}, v.station) as k from orphans o join native v on o.key = v.key and {_hav('o.lat', 'o.lon', 'v.lat', 'v.lon')} <= {RADIUS}) where k = 1),
      free as (select * from orphans where key not in (select key from native)), links as (select a.stop as u, b.stop as v from free a join free b on a.key = b.key and a.stop <> b.stop and {_hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= {RADIUS}),
      reach as (select u, v from links union select r.u, l.v from reach r join links l on r.v = l.u)
      select * from taken union all select u as stop, min(least(u, v)) as parent from reach group by u"""),
    "fare_operators": sql(f""", r as (select distinct line as route, {_NAMES}[line % {len(AGENCIES)} + 1] as agency from trips), t as (select route, agency, upper(agency) as u, string_split_regex(upper(agency), '[/ ]') as parts from r),
      o as (select *, case when u = 'RED' or list_contains(parts, 'RED') then 'RED' when u = 'CITY' or list_contains(parts, 'CITY') then 'CITY' when u = 'NORTH' or list_contains(parts, 'NORTH') then 'NORTH' end as operator from t),
      k as (select agency, least(dense_rank() over (order by agency), 4) as slot from (select distinct agency from o where operator is null)) select o.route, o.operator, cast(k.slot as int) as slot from o left join k on k.agency = o.agency and o.operator is null"""),
    "index_invariants": sql(""" select 'stop of stop time' as rule, count(*) as n from stop_times where stop not in (select stop from stops) union all select 'trip of stop time', count(*) from stop_times where trip not in (select trip from trips)
      union all select 'service of trip', count(*) from trips where svc not in (select svc from services) union all select 'supplier of item as stop', count(*) from lineitem where l_suppkey not in (select stop from stops where stop % 2 = 0)"""),
}
