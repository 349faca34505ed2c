"""Queries on finished plans and running trips, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geo import haversine
from ..operators import itinerary, realtime
from . import network as net
from .network import sql
from .places_queries import _hav
from .realtime_queries import _MASS, _PLEGS, _PROB, _bins, _plan_legs

NOW = 43200


def access_radii(spark, d):
    s = lambda c, y, x: net.stops(spark, d).select(F.col("stop").alias(c), F.col("lat").alias(y), F.col("lon").alias(x))
    r = net.requests(spark, d).join(s("origin", "y1", "x1"), "origin").join(s("destination", "y2", "x2"), "destination")
    crow = F.floor(haversine(F.col("y1"), F.col("x1"), F.col("y2"), F.col("x2")) / 1.2)
    return r.select("request", itinerary.vehicle_budget(crow * 20).alias("vehicle"), itinerary.near_radius(F.col("request") % 1500).cast("int").alias("near"), itinerary.admissible_radius(crow, F.col("start") + 900, F.col("start")).cast("int").alias("admissible"))


def chain_bounds(spark, d):
    return itinerary.chain_bounds(_plan_legs(spark, d))


def reliable_margin(spark, d):
    b = _bins(spark, d)
    feeders = b.select(F.col("mode").alias("feeder"), F.col("bins").alias("f"), F.explode(F.array(*map(F.lit, ("bus", "rail", "subway", "tram")))).alias("mode"))
    return feeders.join(F.broadcast(b), "mode").select("feeder", F.col("mode").alias("boarded"), itinerary.reliable_margin(F.col("f"), F.col("bins")).alias("margin"))  # a row per mode


def transfer_risks(spark, d):
    named = F.expr("case mode when 'purchase' then 'subway' when 'signup' then 'rail' when 'error' then 'tram' else mode end")
    legs = _plan_legs(spark, d).withColumn("mode", named)
    margins = realtime.transfer_margins(legs).join(legs.select("plan", "seq", "mode"), ["plan", "seq"])
    return itinerary.transfer_risks(margins, _bins(spark, d))


def extreme_risk_filter(spark, d):
    e = net.updates(spark, d).select("event_id", (F.col("trip") % 500).alias("grp"), ((F.col("event_id") % 20) / 40).alias("reliability"), (F.col("event_id") % 97 * 100).alias("wait"))
    return itinerary.drop_extreme(e, "grp").select("event_id", "grp")


def active_legs(spark, d):
    return itinerary.active_legs(_plan_legs(spark, d), NOW)


def vehicle_places(spark, d):
    found = itinerary.vehicle_places(net.active_stop_times(spark, d), net.stops(spark, d), NOW)
    return found.select("trip", "pos", F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"))


QUERIES = {f.__name__: f for f in (access_radii, chain_bounds, reliable_margin, transfer_risks, extreme_risk_filter, active_legs, vehicle_places)}

_PAIR = _PROB.format(m="{f}", x="{g} + b.delay_s")
ORACLES = {
    "access_radii": sql(f", c as (select r.request, r.\"start\", floor({_hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} / 1.2::double) as crow from requests r join stops a on a.stop = r.origin join stops b on b.stop = r.destination) select request, cast(least(greatest(floor(crow * 20 * 0.06::double), 1200), 2700) as int) as vehicle, cast(greatest(request % 1500, 600) as int) as near, cast(least(crow, 900) as int) as admissible from c"),
    "chain_bounds": sql(_PLEGS + """, w as (select *, sum(case when walk then "end" - "start" else 0 end) over (partition by plan order by seq) as walked from legs) select plan, seq, lead("start") over o - (lead(walked) over o - walked) as latest from w where not walk window o as (partition by plan order by seq)"""),
    "reliable_margin": sql(_MASS + ", c as (select distinct f.mode as feeder, b.mode as boarded, f.delay_s - b.delay_s as margin from mass f, mass b), p as (select c.feeder, c.boarded, c.margin, sum(b.p * " + _PAIR.format(f="c.feeder", g="c.margin") + ") as p from c join mass b on b.mode = c.boarded group by c.feeder, c.boarded, c.margin) select feeder, boarded, min(margin) filter (round(p, 6) >= 0.8) as margin from p group by feeder, boarded"),
    "transfer_risks": sql(_MASS + _PLEGS.replace("operator as mode", "case operator when 'purchase' then 'subway' when 'signup' then 'rail' when 'error' then 'tram' end as mode") + """, w as (select *, sum(case when walk then "end" - "start" else 0 end) over (partition by plan order by seq) as walked from legs),
      g as (select plan, seq, mode, lead(mode) over o as nm, lead("start") over o - "end" - (lead(walked) over o - walked) as margin from w where not walk window o as (partition by plan order by seq)),
      dist as (select distinct mode, nm, margin from g where nm is not null), pr as (select d.mode, d.nm, d.margin, round(sum(b.p * """ + _PAIR.format(f="d.mode", g="d.margin") + """), 6) as p from dist d join mass b on b.mode = d.nm group by d.mode, d.nm, d.margin)
      select g.plan, g.seq, pr.p, case when pr.p >= 0.8 then 'high' when pr.p >= 0.5 then 'mid' else 'low' end as risk from g join pr using (mode, nm, margin)"""),
    "extreme_risk_filter": sql(", e as (select event_id, trip % 500 as grp, event_id % 20 / 40.0::double < 0.1 and event_id % 97 * 100 > 7200 as risky from updates) select event_id, grp from (select *, bool_and(risky) over (partition by grp) as none_safe from e) where not risky or none_safe"),
    "active_legs": sql(_PLEGS + f""" select plan, max(seq) as seq from legs where "start" <= {NOW} and "end" > {NOW} group by plan"""),
    "vehicle_places": sql(f", x as (select trip, pos, stop, arr, dep, lead(stop) over w as nx, lead(arr) over w as na from active window w as (partition by trip order by pos)), y as (select *, greatest(0.0, ({NOW} - dep)::double / (na - dep)) as k from x where arr <= {NOW} and na > {NOW}) select y.trip, y.pos, round(a.lat + (b.lat - a.lat) * k, 7) as lat, round(a.lon + (b.lon - a.lon) * k, 7) as lon from y join stops a on a.stop = y.stop join stops b on b.stop = y.nx"),
}
