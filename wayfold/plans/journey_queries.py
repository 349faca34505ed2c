"""Queries whose labels carry paths or probabilities, and greedy selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import greedy, realtime, search
from . import api
from . import network as net
from .network import sql
from .schedule_queries import _ONE, START, _search, _vectors


def _seed(spark):
    return spark.createDataFrame([(0, 0, START)], "request long, stop long, arr int")


def journeys_2r(spark, d):
    return search.journeys(_seed(spark), net.active_stop_times(spark, d), net.transfers(spark, d), 2).select("stop", "arr", "path")


def reliable_arrivals_2r(spark, d):
    bins = realtime.bins(realtime.cdf(net.delay_samples(spark, d)))
    return search.reliable_arrivals(_seed(spark), net.active_stop_times(spark, d), bins, net.trip_modes(spark, d), 2).select("stop", "bucket", "arr", "rel")


def explain_candidates(spark, d):
    asked = spark.createDataFrame([(0, 0, START)], "request long, origin long, start int")
    return api.explain_plan(spark, d, asked).select("stop", "boardings", "arr", "kept")


def representatives_k(spark, d):
    return greedy.representatives(_vectors(spark, d), "grp", "vec_id", ["a0", "a1", "a2"])


def overtaking_split(spark, d):
    return greedy.overtaking_split(net.stop_times(spark, d), "line")


def diverse_paths(spark, d):
    base = net.boardings(spark, d).select(F.expr("user_id * 100 + (seq - 1) div 10").alias("path"), F.col("board_stop").alias("edge"), F.col("km").alias("metres"), (F.col("user_id") % 20).alias("grp"))
    edges = base.groupBy("grp", "path", "edge").agg(F.max("metres").alias("metres"))
    options = edges.groupBy("grp", "path").agg(F.sum("metres").alias("rank"))
    return greedy.diverse(options, edges, "grp", 0.3)


def smooth_profiles(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("height"))
    points = rows.select(F.col("l_orderkey").alias("way"), F.col("l_linenumber").alias("seq"), (F.col("l_linenumber") * 10.0).alias("along"), "height")
    return greedy.smooth_profile(points).select("way", "seq", F.round("height", 6).alias("height"))


def earliest_arrival_fixpoint(spark, d):
    """All requests, with as many boardings as still improve anything."""
    seeds = net.requests(spark, d).select("request", F.col("origin").alias("stop"), F.col("start").alias("arr"))
    return search.earliest_arrival(seeds, net.active_stop_times(spark, d), net.transfers(spark, d), rounds=None)


#: Rides that no later departure arrives as early as, and of those that arrive first the latest.
_CONN = """, ways as (select a.stop as board, a.dep, a.trip, a.line, b.stop as alight, b.arr from active a join active b on a.trip = b.trip and b.pos > a.pos),
conn as (select distinct on (board, alight, dep) * from ways w where not exists (select 1 from ways x where x.board = w.board and x.alight = w.alight and x.dep >= w.dep and x.arr <= w.arr and (x.dep > w.dep or x.arr < w.arr)) order by board, alight, dep, trip)"""
_PATH = """
{n}_t as (select * from (select l.request, l.path, c.*, row_number() over (partition by l.request, l.stop, c.alight order by c.arr, c.dep desc) as k from {p} l join conn c on c.board = l.stop and c.dep >= l.arr) where k = 1),
{n}_r as (select request, stop, arr, path from (select *, row_number() over (partition by request, stop order by arr, path) as k from (select request, alight as stop, arr, case when path = '' then '' else path || '|' end || 'R ' || trip || ' ' || board || ' ' || dep || ' ' || alight || ' ' || arr as path from {n}_t)) where k = 1),
{n}_w as (select request, stop, arr, path from (select *, row_number() over (partition by request, stop order by arr, path) as k from (select * from {n}_r union all select l.request, t.t, l.arr + t.w, case when l.path = '' then '' else l.path || '|' end || 'W ' || t.f || ' ' || t.t || ' ' || t.w from {n}_r l join transfers t on t.f = l.stop)) where k = 1),
{n} as (select request, stop, arr, path from (select *, row_number() over (partition by request, stop order by arr, path) as k from (select * from {p} union all select * from {n}_w)) where k = 1)"""
_REL = """
{n}_b as (select l.request, c.alight as stop, c.arr, list_value('bus', 'tram', 'subway', 'rail')[c.line % 4 + 1] as mode, round(l.rel * case when l.feeder is null then 1.0::double else coalesce((select max(f.cum) from cdf f where f.mode = l.feeder and f.delay_s <= c.dep - l.arr), 0) end, 6) as rel from {p} l join conn c on c.board = l.stop and c.dep >= l.arr),
{n}_k as (select request, stop, bucket, arr, rel, feeder from (select *, row_number() over (partition by request, stop, bucket order by arr, -rel, feeder) as k from (select request, stop, arr, rel, mode as feeder, case when rel >= 0.99 then 4 else cast(rel >= 0.5 as int) + cast(rel >= 0.8 as int) + cast(rel >= 0.95 as int) end as bucket from {n}_b)) where k = 1),
{n} as (select * from {n}_k b where not exists (select 1 from {n}_k a where a.request = b.request and a.stop = b.stop and a.arr <= b.arr and a.bucket > b.bucket))"""

QUERIES = {f.__name__: f for f in (journeys_2r, reliable_arrivals_2r, explain_candidates, representatives_k, overtaking_split, diverse_paths, smooth_profiles, earliest_arrival_fixpoint)}

ORACLES = {
    "journeys_2r": sql(_CONN + f", p0 as (select 0 as request, 0 as stop, {START} as arr, '' as path union all select 0, t, {START} + w, 'W ' || f || ' ' || t || ' ' || w from transfers where f = 0)," + _PATH.format(n="p1", p="p0") + "," + _PATH.format(n="p2", p="p1") + " select stop, arr, path from p2"),
    "reliable_arrivals_2r": sql(_CONN + f", q0 as (select 0 as request, 0 as stop, 4 as bucket, {START} as arr, 1.0::double as rel, cast(null as varchar) as feeder)," + _REL.format(n="q1", p="q0") + "," + _REL.format(n="q2", p="q1") + """, e as (select request, stop, bucket, arr, max(rel) as rel from (select * from q1 union all select * from q2) group by request, stop, bucket, arr)
      select stop, bucket, arr, rel from e b where not exists (select 1 from e a where a.stop = b.stop and a.arr <= b.arr and a.bucket >= b.bucket and (a.arr < b.arr or a.bucket > b.bucket))"""),
    "explain_candidates": sql(_search(_ONE, 2) + """, p as (select stop, 0 as boardings, arr from r0 union all select stop, 1, arr from r1_w union all select stop, 2, arr from r2_w)
      select stop, boardings, arr, coalesce(arr < min(arr) over (partition by stop order by boardings rows between unbounded preceding and 1 preceding), true) as kept from p"""),
    "earliest_arrival_fixpoint": sql(_search('select request, origin as stop, "start" as arr from requests', 12) + " select request, stop, arr from r12"),
}
