"""Queries on edges, walks, platforms and polls, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import edges
from ..functions.street import SPEEDS
from ..operators.realtime import poll_statistics
from . import network as net
from .network import sql

REFS, LOCAL_REFS, LEVELS = ("1;2", "3", None, " 4 ; 5;;4"), ("2", None, "6; 3"), ("0", "-1;0", "x", None, "1.5")


def _pick(values, key, by: int = 1):
    return F.element_at(F.array(*map(F.lit, values)), (F.floor(F.col(key) / by) % len(values) + 1).cast("int"))


def _parts(spark, d):
    return spark.read.parquet(f"{d}/part.parquet")


def platform_tags(spark, d):
    refs = edges.platform_refs(_pick(REFS, "p_partkey"), _pick(LOCAL_REFS, "p_partkey", 4))
    return _parts(spark, d).select(F.col("p_partkey").alias("node"), F.array_join(refs, "|").alias("refs"), edges.platform_level(_pick(LEVELS, "p_partkey", 12)).alias("level"))


def car_steps(spark, d):
    key = F.col("p_partkey")
    step = edges.car_step(F.col("p_size") * 10, key % 3 > 0, key % 4 > 0, key % 5 == 0)
    return _parts(spark, d).select(key.alias("edge"), step["seconds"].alias("seconds"), step["walking"].alias("walking"))


def bike_edge_costs(spark, d):
    key = F.col("p_partkey")
    factor, cosine = F.when(key % 11 > 0, F.col("p_size") / 8.0), F.when(key % 7 > 0, (key % 13 - 6) / 5.0)
    return _parts(spark, d).select(key.alias("edge"), F.round(edges.bike_edge_cost(F.col("p_size") * 10, factor, cosine, key % 4 == 0, 60.0), 6).alias("cost"))


def simple_walks(spark, d):
    at = net.boardings(spark, d).select(F.expr("user_id * 100 + (seq - 1) div 10").alias("walk"), "seq", (F.col("board_stop") % 5).alias("node"))
    nodes = F.transform(F.array_sort(F.collect_list(F.struct("seq", "node"))), lambda x: x["node"])  # ten nodes of a walk
    return at.groupBy("walk").agg(F.array_join(edges.simple_walk(nodes), ",").alias("nodes"))


def poll_results(spark, d):
    status = F.when(F.col("event_id") % 20 == 0, "throttled").when(F.col("event_id") % 20 < 3, "failed").otherwise("succeeded")
    return poll_statistics(net.updates(spark, d).select(F.col("kind").alias("feed"), status.alias("status")))


QUERIES = {q.__name__: q for q in (platform_tags, car_steps, bike_edge_costs, simple_walks, poll_results)}


def _list(values) -> str:
    return "[" + ", ".join("null" if v is None else f"'{v}'" for v in values) + "]"


def _seconds(mode: str) -> str:
    return f"cast(p_size * 10 * 1000 // {int(SPEEDS[mode] * 1000)} as bigint)"


ORACLES = {
    "platform_tags": f"""
with t as (select p_partkey as node, {_list(REFS)}[p_partkey % 4 + 1] as r, {_list(LOCAL_REFS)}[p_partkey // 4 % 3 + 1] as l, {_list(LEVELS)}[p_partkey // 12 % 5 + 1] as v from part),
s as (select node, string_split(coalesce(r, '') || ';' || coalesce(l, ''), ';') as xs from t),
p as (select node, trim(unnest(xs)) as x, unnest(range(len(xs))) as pos from s),
f as (select node, x, min(pos) as pos from p where x <> '' group by node, x),
j as (select node, string_agg(x, '|' order by pos) as refs from f group by node)
select t.node, coalesce(j.refs, '') as refs, cast(try_cast(trim(string_split(v, ';')[1]) as float) as double) as level from t left join j using (node)""",
    "car_steps": f"select p_partkey as edge, case when p_partkey % 3 > 0 and p_partkey % 5 > 0 then {_seconds('car')} when p_partkey % 4 > 0 then {_seconds('foot')} end as seconds, case when p_partkey % 3 > 0 and p_partkey % 5 > 0 then false when p_partkey % 4 > 0 then true end as walking from part",
    "bike_edge_costs": "select p_partkey as edge, round(p_size * 10 * case when p_partkey % 11 > 0 then p_size / 8.0::double end + case when p_partkey % 4 = 0 or p_partkey % 7 = 0 then 0.0::double else 30.0::double * (1 - greatest(least((p_partkey % 13 - 6) / 5.0::double, 1.0), -1.0)) end, 6) as cost from part",
    "simple_walks": sql("""
, w as (select user_id * 100 + (seq - 1) // 10 as walk, list([cast(board_stop % 5 as varchar)] order by seq) as steps from boardings group by walk)
select walk, array_to_string(list_reduce(steps, lambda kept, n: case when list_contains(kept, n[1]) then kept[1:list_position(kept, n[1])] else list_concat(kept, n) end), ',') as nodes from w"""),
    "poll_results": sql(" select kind as feed, count(*) filter (event_id % 20 > 2) as succeeded, count(*) filter (event_id % 20 in (1, 2)) as failed, count(*) filter (event_id % 20 = 0) as throttled from updates group by kind"),
}
