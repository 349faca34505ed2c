"""Queries on delays, reliability and the live overlay, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import reliability as rel
from ..operators import realtime as rt
from . import network as net
from .network import route_type, sql

#: Seconds since 1970 of the moment that live queries stand at.
NOW = 1706400000


def _bins(spark, d):
    return rt.bins(rt.cdf(net.delay_samples(spark, d)))


def delay_cdf(spark, d):
    return rt.cdf(net.delay_samples(spark, d)).select("mode", "delay_s", F.round("cum", 9).alias("cum"))


def delay_mass(spark, d):
    return _bins(spark, d).select("mode", F.explode(rel.mass(F.col("bins"))).alias("m")).select("mode", F.col("m.delay").alias("delay_s"), F.round("m.p", 9).alias("p"))


def _margins(spark, d):
    return _bins(spark, d).withColumn("margin", F.explode(F.sequence(F.lit(-120), F.lit(600), F.lit(45))))


def on_time_probability(spark, d):
    p = rel.on_time(F.col("bins"), F.col("margin"))
    return _margins(spark, d).select("mode", "margin", F.round(p, 9).alias("p"), F.round(rel.at_least(F.col("bins"), F.col("margin")), 9).alias("at_least"), rel.bucket(F.round(p, 6)).alias("bucket"), rel.risk_class(F.round(p, 6)).alias("risk"))


def two_vehicle_reliability(spark, d):
    b = _bins(spark, d).select(F.col("mode").alias("boarded"), F.col("bins").alias("board_bins"))
    pairs = _margins(spark, d).withColumn("boarded", F.explode(F.array(*map(F.lit, ("bus", "rail", "subway", "tram"))))).join(F.broadcast(b), "boarded")  # a row per mode
    return pairs.select("mode", "boarded", "margin", F.round(rel.on_time_vs(F.col("bins"), F.col("board_bins"), F.col("margin")), 6).alias("p"))


def arrival_distribution(spark, d):
    """Two scenarios of each trip, this one and the next of its line, spread by the line's delays."""
    times = net.active_stop_times(spark, d)
    from ..operators.schedule import following_trips

    ride = following_trips(times).where("pos = 4").join(times.where("pos = 5").select("trip", F.col("arr").alias("hit")), "trip").withColumn("mode", route_type())
    p = F.lit(0.75)
    bag = rel.scenarios(F.col("hit"), p, F.col("next_end"))
    spread = ride.join(F.broadcast(_bins(spark, d)), "mode").select("trip", "hit", F.explode(bag).alias("s"), "bins").select("trip", "s", F.explode(rel.mass(F.col("bins"))).alias("m"))  # a row per mode
    whole = spread.groupBy("trip", (F.col("s.time") + F.col("m.delay")).alias("time")).agg(F.sum(F.col("s.p") * F.col("m.p")).alias("p"))
    return whole.groupBy("trip").agg(F.round(F.sum(F.col("p") * F.col("time")) / F.sum("p"), 3).alias("expected"), F.min("time").alias("earliest"), F.max("time").alias("latest"), F.count(F.lit(1)).alias("n"))


def _live(spark, d):
    return rt.latest(net.updates(spark, d), ["trip", "pos"])


def delay_forward_fill(spark, d):
    return rt.forward_fill(net.stop_times(spark, d), _live(spark, d))


def live_overlay(spark, d):
    return rt.overlay(net.stop_times(spark, d), _live(spark, d)).select("trip", "pos", "stop", "arr", "dep")


def vehicle_latest(spark, d):
    u = net.updates(spark, d)
    found = rt.latest(u.select("trip", "ts", "event_id", "pos"), ["trip"])
    return found.select("trip", "pos", "ts", ((F.lit(NOW) - F.col("ts")) > rt.VEHICLE_AGE).alias("stale"))


def sticky_delay_state(spark, d):
    return rt.sticky(net.updates(spark, d), NOW, 10 * rt.STICKY_TTL)


def asof_schedule_match(spark, d):
    n = net.n_stops(spark, d)
    u = net.updates(spark, d).where("kind = 'delay'")
    passages = u.select(F.col("event_id").alias("passage"), (F.col("event_id") % n).alias("stop"), (F.col("trip") % 40).cast("int").alias("line"), (F.col("ts") % 86400).cast("int").alias("time"))
    return rt.match_schedule(passages, net.active_stop_times(spark, d))


def stop_resolution(spark, d):
    n = net.n_stops(spark, d)
    u = net.updates(spark, d).select("event_id", "trip", (F.col("event_id") % n).alias("stop_id"))
    return rt.resolve_stop(u, net.stop_times(spark, d), net.stops(spark, d)).select("event_id", "trip", "stop_id", "pos")


def platform_change(spark, d):
    n = net.n_stops(spark, d)
    swaps = _live(spark, d).where("kind = 'delay' and delay_s > 300").select("trip", "pos", ((F.col("event_id") * 3) % n).alias("actual"))
    code = lambda c: F.concat(F.lit("P"), (F.col(c) % 4).cast("string"))
    return net.stop_times(spark, d).join(swaps, ["trip", "pos"]).where(code("stop") != code("actual")).select("trip", "pos", code("stop").alias("scheduled"), code("actual").alias("platform"))


def _alerts(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ("trip", "route", "stop"))), (F.col("event_id") % 3 + 1).cast("int"))
    return net.updates(spark, d).where("kind = 'cancelled'").select(
        F.col("event_id").alias("alert"), kind.alias("kind"), F.when(kind == "route", F.col("trip") % 40).when(kind == "stop", F.col("trip") % 100).otherwise(F.col("trip")).alias("entity"),
        F.when(F.col("event_id") % 5 != 0, F.col("ts")).alias("from"), F.when(F.col("event_id") % 7 != 0, F.col("ts") + 86400).alias("to"),
    )


def _legs(spark, d):
    from ..operators.schedule import rides

    return rides(net.stop_times(spark, d)).where("board_pos = 1 and alight_pos = 4").select(F.col("trip").alias("leg"), "trip", "line", "board", "alight", "board_pos", "alight_pos", F.lit(NOW).alias("now"))


def alerts_for_leg(spark, d):
    return rt.alerts_for_legs(_alerts(spark, d), _legs(spark, d))


def live_refresh(spark, d):
    return rt.live_refresh(_legs(spark, d), net.stop_times(spark, d), _live(spark, d), rt.sticky(net.updates(spark, d), NOW, 20 * rt.STICKY_TTL))


def realtime_gate(spark, d):
    snaps = net.updates(spark, d).select(F.col("ts").alias("generated_at"), "event_id")
    return rt.gate(snaps, NOW - 40000, 8792, 86400).select("event_id", "generated_at")


def _plan_legs(spark, d):
    return net.boardings(spark, d).select(F.expr("user_id * 100 + (seq - 1) div 6").alias("plan"), ((F.col("seq") - 1) % 6).cast("int").alias("seq"), F.col("operator").isin("click", "view").alias("walk"), F.col("operator").alias("mode"), F.col("board_time").alias("start"), (F.col("board_time") + F.col("km") * 10).alias("end"))


def transfer_margins(spark, d):
    return rt.transfer_margins(_plan_legs(spark, d))


def consecutive_walk_merge(spark, d):
    return rt.merge_walks(_plan_legs(spark, d))


def plan_timeline(spark, d):
    return rt.timeline(_plan_legs(spark, d))


_LIVE = ", live as materialized (select trip, pos, ts, event_id, delay_s, kind from (select *, row_number() over (partition by trip, pos order by ts desc, event_id desc) as k from updates) where k = 1)"
_FILL = """, sk as (select t.trip, t.pos, case when l.kind = 'delay' then l.delay_s end as given, coalesce(l.kind = 'skipped', false) as skipped from stop_times t left join live l using (trip, pos) where t.trip in (select trip from live)),
  pt as (select *, sum(cast(skipped as int)) over (partition by trip order by pos) as part from sk),
  fill as materialized (select trip, pos, case when not skipped then last_value(given ignore nulls) over (partition by trip, part order by pos rows unbounded preceding) end as delay_s, skipped from pt)"""
_PROB = "coalesce((select max(c.cum) from cdf c where c.mode = {m} and c.delay_s <= {x}), 0)"
_MASS = ", mass as (select mode, delay_s, cum, cum - coalesce(lag(cum) over (partition by mode order by delay_s), 0) as p from cdf), modes as (select distinct mode from cdf), margins as (select cast(unnest(range(-120, 601, 45)) as int) as margin)"
_LEGS = f", legs as materialized (select a.trip as leg, a.trip, a.line, a.stop as board, b.stop as alight from stop_times a join stop_times b on a.trip = b.trip and a.pos = 1 and b.pos = 4)"
_STICKY = ", seen as materialized (select trip, pos, delay_s, ts from (select *, row_number() over (partition by trip, pos order by ts desc, event_id desc) as k from updates where kind = 'delay') where k = 1 and {now} - ts <= {ttl})"
_PLEGS = """, legs as (select user_id * 100 + (seq - 1) // 6 as plan, cast((seq - 1) % 6 as int) as seq, operator in ('click', 'view') as walk, operator as mode, board_time as "start", board_time + km * 10 as "end" from boardings)"""

QUERIES = {f.__name__: f for f in (
    delay_cdf, delay_mass, on_time_probability, two_vehicle_reliability, arrival_distribution, delay_forward_fill, live_overlay, vehicle_latest, sticky_delay_state, asof_schedule_match, stop_resolution, platform_change,
    alerts_for_leg, live_refresh, realtime_gate, transfer_margins, consecutive_walk_merge, plan_timeline,
)}

ORACLES = {
    "delay_cdf": sql(" select mode, delay_s, round(cum, 9) as cum from cdf where mode is not null"),
    "delay_mass": sql(_MASS + " select mode, delay_s, round(p, 9) as p from mass"),
    "on_time_probability": sql(_MASS + ", q as (select mode, margin, " + _PROB.format(m="m.mode", x="g.margin") + """ as p, coalesce((select sum(x.p) from mass x where x.mode = m.mode and x.delay_s >= g.margin), 0) as t from modes m, margins g)
      select mode, margin, round(p, 9) as p, round(t, 9) as at_least, case when round(p, 6) >= 0.99 then 4 else cast(round(p, 6) >= 0.5 as int) + cast(round(p, 6) >= 0.8 as int) + cast(round(p, 6) >= 0.95 as int) end as bucket, case when round(p, 6) >= 0.8 then 'high' when round(p, 6) >= 0.5 then 'mid' else 'low' end as risk from q"""),
    "two_vehicle_reliability": sql(_MASS + " select mode, boarded, margin, round(sum(w * p), 6) as p from (select m.mode, b.mode as boarded, g.margin, b.p as w, " + _PROB.format(m="m.mode", x="g.margin + b.delay_s") + " as p from modes m, margins g, mass b) group by mode, boarded, margin"),
    "arrival_distribution": sql(_MASS + """, ends as (select trip, max(arr) as e from active group by trip), fol as (select a.trip, a.line, a.pos, lead(e.e) over (partition by a.line, a.pos order by a.dep, a.trip) as miss from active a join ends e using (trip)),
      ride as (select f.trip, list_value('bus', 'tram', 'subway', 'rail')[f.line % 4 + 1] as mode, h.arr as hit, f.miss from fol f join active h on h.trip = f.trip and h.pos = 5 where f.pos = 4),
      bag as (select trip, mode, hit as t, 0.75::double as p from ride union all select trip, mode, miss, 0.25::double from ride where miss is not null),
      whole as (select b.trip, b.t + m.delay_s as t, sum(b.p * m.p) as p from bag b join mass m using (mode) group by b.trip, b.t + m.delay_s)
      select trip, round(sum(p * t) / sum(p), 3) as expected, min(t) as earliest, max(t) as latest, count(*) as n from whole group by trip"""),
    "delay_forward_fill": sql(_LIVE + _FILL + " select trip, pos, delay_s, skipped from fill"),
    "live_overlay": sql(_LIVE + _FILL + " select t.trip, t.pos, t.stop, greatest(0, t.arr + coalesce(f.delay_s, 0)) as arr, greatest(0, t.dep + coalesce(f.delay_s, 0)) as dep from stop_times t left join fill f using (trip, pos) anti join (select trip from live where kind = 'cancelled') c on c.trip = t.trip where not coalesce(f.skipped, false)"),
    "vehicle_latest": sql(f" select trip, pos, ts, {NOW} - ts > 120 as stale from (select *, row_number() over (partition by trip order by ts desc, event_id desc) as k from updates) where k = 1"),
    "sticky_delay_state": sql(_STICKY.format(now=NOW, ttl=864000) + " select trip, pos, delay_s, ts from seen"),
    "asof_schedule_match": sql(""", p as (select event_id as passage, event_id % n as stop, cast(trip % 40 as int) as line, cast(ts % 86400 as int) as t from updates, n where kind = 'delay')
      select passage, trip, pos, delay_s from (select p.passage, a.trip, a.pos, p.t + o.o - a.arr as delay_s, row_number() over (partition by p.passage order by abs(p.t + o.o - a.arr), o.o, a.trip, a.pos) as k from p, (select unnest([0, 86400]) as o) o, active a where a.stop = p.stop and a.line = p.line and p.t + o.o - a.arr between -90 and 3600) where k = 1"""),
    "stop_resolution": sql(""", u as (select event_id, trip, event_id % n as stop_id from updates, n)
      select u.event_id, u.trip, u.stop_id, coalesce(t.pos, (select min(x.pos) from stop_times x join stops s on s.stop = x.stop where x.trip = u.trip and s.parent = (select parent from stops where stop = u.stop_id))) as pos from u left join stop_times t on t.trip = u.trip and t.stop = u.stop_id"""),
    "platform_change": sql(_LIVE + ", sw as (select trip, pos, event_id * 3 % n as actual from live, n where kind = 'delay' and delay_s > 300) select t.trip, t.pos, 'P' || t.stop % 4 as scheduled, 'P' || s.actual % 4 as platform from stop_times t join sw s using (trip, pos) where t.stop % 4 <> s.actual % 4"),
    "alerts_for_leg": sql(_LEGS + f""", al as (select event_id as alert, list_value('trip', 'route', 'stop')[event_id % 3 + 1] as kind, case event_id % 3 when 1 then trip % 40 when 2 then trip % 100 else trip end as entity, case when event_id % 5 <> 0 then ts end as f, case when event_id % 7 <> 0 then ts + 86400 end as t from updates where kind = 'cancelled'),
      named as (select leg, 'trip' as kind, trip as entity from legs union all select leg, 'route', line from legs union all select leg, 'stop', board from legs union all select leg, 'stop', alight from legs)
      select distinct l.leg, a.alert from named l join al a using (kind, entity) where (a.f is null or a.f <= {NOW}) and (a.t is null or {NOW} < a.t)"""),
    "live_refresh": sql(_LIVE + _FILL + _STICKY.format(now=NOW, ttl=20 * 86400) + _LEGS + """ select l.leg, case when off.trip is not null then 'cancelled' when fb.delay_s is not null then 'live' when sb.delay_s is not null then 'sticky' else 'no_data' end as status,
      greatest(0, b.dep + coalesce(fb.delay_s, sb.delay_s, 0)) as dep, greatest(0, a.arr + coalesce(fa.delay_s, sa.delay_s, 0)) as arr from legs l join stop_times b on b.trip = l.trip and b.pos = 1 join stop_times a on a.trip = l.trip and a.pos = 4
      left join fill fb on fb.trip = l.trip and fb.pos = 1 left join fill fa on fa.trip = l.trip and fa.pos = 4 left join seen sb on sb.trip = l.trip and sb.pos = 1 left join seen sa on sa.trip = l.trip and sa.pos = 4 left join (select distinct trip from live where kind = 'cancelled') off on off.trip = l.trip"""),
    "realtime_gate": sql(f" select event_id, ts as generated_at from updates where {NOW - 40000} - ts <= 86400 and ts // 86400 - 10957 = 8792"),
    "transfer_margins": sql(_PLEGS + """, w as (select *, sum(case when walk then "end" - "start" else 0 end) over (partition by plan order by seq) as walked from legs)
      select plan, seq, lead(mode) over o as next_mode, lead("start") over o - "end" - (lead(walked) over o - walked) as margin from w where not walk window o as (partition by plan order by seq)"""),
    "consecutive_walk_merge": sql(_PLEGS + """, a as (select *, case when walk and coalesce(lag(walk) over (partition by plan order by seq), false) then 0 else 1 end as nw from legs), b as (select *, sum(nw) over (partition by plan order by seq) as island from a)
      select plan, min(seq) as seq, bool_and(walk) as walk, min("start") as "start", max("end") as "end", count(*) as n from b group by plan, island"""),
    "plan_timeline": sql(_PLEGS + """, lastride as (select plan, max(seq) as s from legs where not walk group by plan)
      select l.plan, cast(arg_min(l."start", l.seq) as bigint) as "start", cast(case when max(r.s) is null then arg_min(l."start", l.seq) + sum(l."end" - l."start") else max(case when l.seq = r.s then l."end" end) + sum(case when l.seq > r.s then l."end" - l."start" else 0 end) end as bigint) as "end" from legs l left join lastride r using (plan) group by l.plan"""),
}
