"""Queries on the timetable, searches and fronts, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pareto, schedule, search
from . import network as net
from .network import ACTIVE_SQL, QUERY_DAY, route_type, sql

START = 28800


def _seed(spark):
    return spark.createDataFrame([(0, 0, START)], "request long, stop long, arr int")


def earliest_arrival_2r(spark, d):
    found = search.earliest_arrival(_seed(spark), net.active_stop_times(spark, d), net.transfers(spark, d), rounds=2)
    return found.select("stop", "arr")


def earliest_arrival_batch(spark, d):
    """All requests at once, two boardings."""
    seeds = net.requests(spark, d).select("request", F.col("origin").alias("stop"), F.col("start").alias("arr"))
    found = search.earliest_arrival(seeds, net.active_stop_times(spark, d), net.transfers(spark, d), rounds=2)
    asked = net.requests(spark, d).select("request", F.col("destination").alias("stop"))
    return found.join(asked, ["request", "stop"]).select("request", "stop", "arr")


def service_active_by_day(spark, d):
    days = net.services(spark).withColumn("day", F.explode(F.sequence(F.lit(8758), F.lit(8792))))
    return days.select("svc", "day", schedule.service_active(F.col("day")).alias("active"))


def pattern_build(spark, d):
    return schedule.patterns(net.stop_times(spark, d)).select(F.array_join("stops", ",").alias("stops"), "n_trips", "first_trip", "line")


def stop_pattern_index(spark, d):
    return schedule.stop_patterns(schedule.patterns(net.stop_times(spark, d)))


def hop_timetable(spark, d):
    return schedule.hop_timetable(schedule.hops(net.stop_times(spark, d)))


def station_index(spark, d):
    found = schedule.stations(net.stops(spark, d), net.stop_times(spark, d), route_type())
    return found.select("parent", "n_stops", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), F.coalesce(F.array_join("modes", ","), F.lit("")).alias("modes"), F.coalesce(F.array_join("lines", ","), F.lit("")).alias("lines"))


def transfer_table(spark, d):
    return net.transfers(spark, d)


def reverse_transfers(spark, d):
    return net.transfers(spark, d).select(F.col("t").alias("f"), F.col("f").alias("t"), "w")


def _asked(spark, d):
    return net.requests(spark, d).select("request", F.col("origin").alias("stop"), F.col("start").alias("time"))


def next_departures(spark, d):
    return schedule.departures(net.active_stop_times(spark, d), _asked(spark, d), 3).select("request", "rank", "trip", "dep")


def previous_departures(spark, d):
    return schedule.departures(net.active_stop_times(spark, d), _asked(spark, d), 3, after=False).select("request", "rank", "trip", "dep")


def next_departure_from_time(spark, d):
    return schedule.first_departure(net.active_stop_times(spark, d), _asked(spark, d))


def departure_board_headway(spark, d):
    return schedule.headways(net.active_stop_times(spark, d).where("dep >= 28800 and dep < 36000"))


def _ways(spark, d):
    return schedule.rides(net.active_stop_times(spark, d))


def cross_route_departures(spark, d):
    return schedule.cross_route(_ways(spark, d), 6, 9, START, 0, 5)


def cross_route_departures_before(spark, d):
    return schedule.cross_route(_ways(spark, d), 6, 9, 50000, 0, 5, after=False)


def station_backups(spark, d):
    ways = _ways(spark, d)
    legs = ways.where("board_pos = 1 and alight_pos = 4").select(F.col("trip").alias("leg"), "board", "alight", "dep")
    return schedule.backups(ways, legs, 2, 3)


def leg_times(spark, d):
    legs = net.requests(spark, d).select((F.col("request") * 11 % net.n_trips(spark, d)).alias("trip"), F.col("origin").alias("board"), F.col("destination").alias("alight")).distinct()
    return schedule.leg_times(net.stop_times(spark, d), legs)


def latest_departure_before_arrival(spark, d):
    asked = net.requests(spark, d).select("request", F.col("origin").alias("board"), F.col("destination").alias("alight"), (F.col("start") + 14400).alias("by"))
    return schedule.latest_departure(_ways(spark, d), asked)


def following_trips(spark, d):
    return schedule.following_trips(net.active_stop_times(spark, d))


def first_mode_per_stop(spark, d):
    return schedule.first_mode(net.stop_times(spark, d), net.stops(spark, d), route_type())


def agencies_with_routes(spark, d):
    """Agencies are the line's tens; routes are listed in the order of mode and number."""
    lines = net.trips(spark, d).select("line", route_type().alias("mode"), F.expr("line div 10").alias("agency")).distinct()
    rank = F.expr("case mode when 'rail' then 0 when 'subway' then 1 when 'tram' then 2 else 3 end")
    listed = F.array_sort(F.collect_list(F.struct(rank.alias("r"), "line", "mode")))
    return lines.groupBy("agency").agg(F.array_join(F.transform(listed, lambda x: F.concat_ws(":", x["mode"], x["line"])), ",").alias("routes"))


def segment_timetables(spark, d):
    return schedule.hops(net.stop_times(spark, d)).groupBy("f", "t").agg(F.count(F.lit(1)).alias("n"), F.min("dep").alias("first_dep"), F.max("arr").alias("last_arr"), F.min(F.col("arr") - F.col("dep")).alias("least"))


def rounds_profile(spark, d):
    found = search.rounds_profile(_seed(spark), net.active_stop_times(spark, d), net.transfers(spark, d), 2)
    return pareto.front_2d(found, ["stop"], "boardings", "arr").select("stop", "boardings", "arr")


def range_profile(spark, d):
    times = net.active_stop_times(spark, d)
    departures = search.interesting_departures(times, 0, START, 7200)
    seeds = departures.select(F.col("dep").cast("long").alias("request"), F.lit(0).cast("long").alias("stop"), F.col("dep").alias("arr"))
    found = search.earliest_arrival(seeds, times, net.transfers(spark, d), rounds=1)
    return search.range_front(found.select(F.col("request").cast("int").alias("departure"), "stop", "arr"))


def overnight_union(spark, d):
    """A query at 03:00 also takes yesterday's services, a day later; trips of even lines are shifted by half a day so that some run past midnight."""
    shift = F.when(F.col("line") % 2 == 0, 43200).otherwise(0)
    late = net.stop_times(spark, d).withColumns({"arr": F.col("arr") + shift, "dep": F.col("dep") + shift})
    running = lambda day: late.join(F.broadcast(net.services(spark).where(schedule.service_active(F.lit(day))).select("svc")), "svc", "left_semi")  # noqa: E731  a row per service
    today = running(net.QUERY_DAY)
    yesterday = running(net.QUERY_DAY - 1).withColumns({"trip": F.col("trip") + 10_000_000, "arr": F.col("arr") - 86400, "dep": F.col("dep") - 86400}).where("arr >= 0")
    seeds = spark.createDataFrame([(0, 0, 10800)], "request long, stop long, arr int")
    return search.earliest_arrival(seeds, today.unionByName(yesterday), net.transfers(spark, d), rounds=1).select("stop", "arr")


def onboard_arrival(spark, d):
    riders = net.requests(spark, d).select("request", (F.col("request") * 13 % net.n_trips(spark, d)).alias("trip"), F.lit(1).alias("pos"))
    times = net.active_stop_times(spark, d)
    seeds = search.onboard_seeds(net.stop_times(spark, d), riders)
    return search.earliest_arrival(seeds, times, net.transfers(spark, d), rounds=1)


def latest_departure_backward(spark, d):
    target = spark.createDataFrame([(0, 5, 61200)], "request long, stop long, dep int")
    return search.latest_departure_backward(target, net.active_stop_times(spark, d), net.transfers(spark, d), 2).select("stop", "dep")


def pareto_2axis(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select("l_suppkey", F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    return pareto.front_2d(rows, ["l_suppkey"], "x", "y")


def _vectors(spark, d):
    axes = [F.floor(F.abs(F.col("embedding")[i]) * 1000).cast("int").alias(f"a{i}") for i in range(4)]
    return spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", (F.col("vec_id") % 10).alias("grp"), *axes)


def pareto_front_4axis(spark, d):
    return pareto.front(_vectors(spark, d), ["grp"], ["a0", "a1", "a2", "a3"])


def pareto_with_dominator(spark, d):
    return pareto.dominators(_vectors(spark, d), ["grp"], ["a0", "a1", "a2"], "vec_id").select("vec_id", "dominated_by", "lost")


def label_bucket_front(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select("l_suppkey", F.floor(F.col("l_extendedprice") / 100).alias("arr"), F.floor(F.col("l_discount") * 50 + 0.5).cast("int").alias("bucket"))
    return pareto.bucket_front(rows, ["l_suppkey"], "arr", "bucket")


def _plans(spark, d):
    return spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s")).select(
        F.expr("l_orderkey div 8").alias("request"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("id"), (F.col("p") % 4).alias("transfers"), (30000 + F.col("p") % 997).alias("end"), (28000 + F.col("s") % 53).alias("start"), (F.col("p") % 3).alias("bucket"), (F.col("s") % 3).alias("burden")
    )


def pareto_plan_front(spark, d):
    return pareto.plan_front(_plans(spark, d), "request")


def prune_slower_than_direct(spark, d):
    plans = _plans(spark, d).withColumns({"direct": F.col("transfers") == 0, "seconds": F.col("end") - F.col("start")})
    return pareto.slower_than_direct(plans, "request").select("id", "direct", "burden", "seconds")


def display_dedup(spark, d):
    return pareto.display_dedup(_vectors(spark, d).withColumnRenamed("vec_id", "index"), "grp", {"a0": 60, "a1": 30}).select("index", "grp")


def eps_pareto(spark, d):
    """The canonical form: rows that none with a smaller id dominates within the slack, nor any strictly."""
    rows = _vectors(spark, d)
    keep = rows.alias("b").join(rows.alias("a"), (F.col("a.grp") == F.col("b.grp")) & (F.col("a.vec_id") < F.col("b.vec_id")) & pareto.eps_dominates("a", "b", {"a0": (2.0, 0.01), "a1": (3.0, 0.02)}), "left_anti")
    return keep.select("vec_id", "grp")


_ROUND = """
{n}_b as (select l.request, s.trip, min(s.pos) as pos from {p} l join {st} s on s.stop = l.stop and s.dep >= l.arr group by l.request, s.trip),
{n}_r as (select b.request, s.stop, min(s.arr) as arr from {n}_b b join {st} s on s.trip = b.trip and s.pos > b.pos group by b.request, s.stop),
{n}_w as (select request, stop, min(arr) as arr from (select * from {n}_r union all select r.request, t.t, r.arr + t.w from {n}_r r join transfers t on t.f = r.stop) group by request, stop),
{n} as (select request, stop, min(arr) as arr from (select * from {k} union all select * from {n}_w) group by request, stop),
{n}_f as (select w.* from {n}_w w left join {k} k using (request, stop) where k.arr is null or w.arr < k.arr)"""


def _search(seed: str, rounds: int, times: str = "active") -> str:
    """Tables r0, r1, ... of the best arrivals; r1_w, ... of what each round reaches from what the one before improved."""
    out = f", seed as ({seed}), r0 as (select request, stop, min(arr) as arr from (select * from seed union all select s.request, t.t, s.arr + t.w from seed s join transfers t on t.f = s.stop) group by request, stop)"
    for k in range(1, rounds + 1):
        out += "," + _ROUND.format(n=f"r{k}", p=f"r{k - 1}_f" if k > 1 else "r0", k=f"r{k - 1}", st=times)
    return out


_ONE = f"select 0 as request, 0 as stop, {START} as arr"
_RIDES = ", ways as (select a.trip, a.line, a.svc, a.stop as board, a.dep, a.pos as board_pos, b.stop as alight, b.arr, b.pos as alight_pos from {st} a join {st} b on a.trip = b.trip and b.pos > a.pos)"
_WAYS = _RIDES.format(st="active")
_VEC = ", v as (select vec_id, vec_id % 10 as grp, " + ", ".join(f"cast(floor(abs(cast(embedding[{i + 1}] as float)) * 1000) as int) as a{i}" for i in range(4)) + " from embeddings)"


def _dom(axes: range) -> str:
    return "a.grp = b.grp and " + " and ".join(f"a.a{i} <= b.a{i}" for i in axes) + " and (" + " or ".join(f"a.a{i} < b.a{i}" for i in axes) + ")"


_PLAN = """, plans as (select l_orderkey // 8 as request, l_orderkey * 100 + l_linenumber as id, p % 4 as transfers, 30000 + p % 997 as "end", 28000 + s % 53 as "start", p % 3 as bucket, s % 3 as burden
  from (select l_orderkey, l_linenumber, min(l_partkey) as p, min(l_suppkey) as s from lineitem group by l_orderkey, l_linenumber))"""
_RANK = "select request, rank, trip, dep from (select q.request, s.trip, s.dep, row_number() over (partition by q.request order by s.dep {o}, s.trip {o}) as rank from requests q join active s on s.stop = q.origin and s.dep {c} q.\"start\") where rank <= {k}"
_CROSS = "select trip, line, dep, arr, row_number() over (order by dep {o}, trip) as rank from (select trip, line, dep, arr from (select *, row_number() over (partition by trip order by dep, arr) as k from ways where board = 6 and alight = 9 and line <> 0 and dep {c}) where k = 1) order by dep {o}, trip limit 5"

QUERIES = {f.__name__: f for f in (
    earliest_arrival_2r, earliest_arrival_batch, service_active_by_day, pattern_build, stop_pattern_index, hop_timetable, station_index, transfer_table, reverse_transfers, next_departures, previous_departures, next_departure_from_time,
    departure_board_headway, cross_route_departures, cross_route_departures_before, station_backups, leg_times, latest_departure_before_arrival, following_trips, first_mode_per_stop, agencies_with_routes, segment_timetables, rounds_profile,
    range_profile, overnight_union, onboard_arrival, latest_departure_backward, pareto_2axis, pareto_front_4axis, pareto_with_dominator, label_bucket_front, pareto_plan_front, prune_slower_than_direct, display_dedup, eps_pareto,
)}

_PATTERNS = ", pat as (select stops, count(*) as n_trips, min(trip) as first_trip, arg_min(line, trip) as line from (select trip, line, list(stop order by pos) as stops from stop_times group by trip, line) group by stops)"
_HOPS = ", hops as (select * from (select trip, line, svc, pos, stop as f, dep, lead(stop) over w as t, lead(arr) over w as arr from stop_times window w as (partition by trip order by pos)) where t is not null)"

ORACLES = {
    "earliest_arrival_2r": sql(_search(_ONE, 2) + " select stop, arr from r2"),
    "earliest_arrival_batch": sql(_search('select request, origin as stop, "start" as arr from requests', 2) + " select r.request, r.stop, r.arr from r2 r join requests q on q.request = r.request and q.destination = r.stop"),
    "service_active_by_day": sql(""" select svc, day, not list_contains(removed, day) and (list_contains(added, day) or (day between "start" and "end" and (days & cast(pow(2, (day + 5) % 7) as int)) <> 0)) as active from services, (select cast(unnest(range(8758, 8793)) as int) as day)"""),
    "pattern_build": sql(_PATTERNS + " select array_to_string(stops, ',') as stops, n_trips, first_trip, line from pat"),
    "stop_pattern_index": sql(_PATTERNS + " select unnest(stops) as stop, first_trip, cast(unnest(range(len(stops))) as int) as pos from pat"),
    "hop_timetable": sql(_HOPS + " select f, t, line, trip, dep, arr, row_number() over (partition by f, t, line order by dep, trip) as rank from hops"),
    "station_index": sql(""" select parent, n_stops, round(lat, 6) as lat, round(lon, 6) as lon, coalesce(modes, '') as modes, coalesce(lines, '') as lines from (select parent, count(*) as n_stops, avg(lat) as lat, avg(lon) as lon from stops group by parent)
      left join (select parent, string_agg(distinct mode, ',' order by mode) as modes from (select s.parent, list_value('bus', 'tram', 'subway', 'rail')[t.line % 4 + 1] as mode from stop_times t join stops s using (stop)) group by parent) using (parent)
      left join (select parent, array_to_string(list_sort(list(distinct t.line)), ',') as lines from stop_times t join stops s using (stop) group by parent) using (parent)"""),
    "transfer_table": sql(" select f, t, w from transfers"),
    "reverse_transfers": sql(" select t as f, f as t, w from transfers"),
    "next_departures": sql(" " + _RANK.format(o="asc", c=">=", k=3)),
    "previous_departures": sql(" " + _RANK.format(o="desc", c="<", k=3)),
    "next_departure_from_time": sql(" select request, trip, dep from (" + _RANK.format(o="asc", c=">=", k=1) + ")"),
    "departure_board_headway": sql(""", g as (select stop, line, dep, dep - lag(dep) over (partition by stop, line order by dep, trip) as gap from active where dep >= 28800 and dep < 36000),
      h as (select stop, line, count(*) as n, list_sort(list(gap) filter (gap is not null)) as gaps from g group by stop, line)
      select stop, line, n, case when n >= 3 and gaps[len(gaps) // 2 + 1] > 0 and len(list_filter(gaps, lambda x: abs(x - gaps[len(gaps) // 2 + 1]) > gaps[len(gaps) // 2 + 1] * cast(0.2 as double))) = 0 then cast(floor(gaps[len(gaps) // 2 + 1] / 60 + 0.5) as int) end as minutes from h"""),
    "cross_route_departures": sql(_WAYS + " " + _CROSS.format(o="", c=f">= {START}")),
    "cross_route_departures_before": sql(_WAYS + " " + _CROSS.format(o="desc", c="< 50000")),
    "station_backups": sql(_WAYS + """, legs as (select trip as leg, board, alight, dep from ways where board_pos = 1 and alight_pos = 4),
      f as (select leg, other, other_dep, other_arr, other_dep < dep as early from (select l.leg, l.dep, w.trip as other, w.dep as other_dep, w.arr as other_arr, row_number() over (partition by l.leg, w.trip order by w.dep, w.arr) as k from legs l join ways w on w.board = l.board and w.alight = l.alight and w.trip <> l.leg) where k = 1),
      r as (select *, case when early then row_number() over (partition by leg, early order by other_dep desc, other desc) else row_number() over (partition by leg, early order by other_dep, other) end as rank from f)
      select leg, other, other_dep, other_arr, early, rank from r where rank <= case when early then 2 else 3 end"""),
    "leg_times": sql(_RIDES.format(st="stop_times") + ", legs as (select distinct request * 11 % nt as trip, origin as board, destination as alight from requests, nt) select trip, board, alight, dep, arr from (select w.trip, w.board, w.alight, w.dep, w.arr, row_number() over (partition by w.trip, w.board, w.alight order by w.dep, w.arr) as k from ways w join legs l using (trip, board, alight)) where k = 1"),
    "latest_departure_before_arrival": sql(_WAYS + """ select request, trip, dep, arr from (select q.request, w.trip, w.dep, w.arr, row_number() over (partition by q.request order by w.dep desc, w.trip, w.arr desc) as k from requests q join ways w on w.board = q.origin and w.alight = q.destination and w.arr <= q."start" + 14400) where k = 1"""),
    "following_trips": sql(""" select a.trip, a.line, a.pos, a.dep, lead(a.trip) over w as next_trip, lead(a.dep) over w as next_dep, lead(e."end") over w as next_end from active a join (select trip, max(arr) as "end" from active group by trip) e using (trip) window w as (partition by a.line, a.pos order by a.dep, a.trip)"""),
    "first_mode_per_stop": sql(" select s.stop, coalesce(m.mode, 'bus') as mode from stops s left join (select stop, list_value('bus', 'tram', 'subway', 'rail')[min(line) % 4 + 1] as mode from stop_times group by stop) m using (stop)"),
    "agencies_with_routes": sql(""" select agency, string_agg(mode || ':' || line, ',' order by r, line) as routes from (select line, mode, line // 10 as agency, case mode when 'rail' then 0 when 'subway' then 1 when 'tram' then 2 else 3 end as r from (select distinct line, list_value('bus', 'tram', 'subway', 'rail')[line % 4 + 1] as mode from trips)) group by agency"""),
    "segment_timetables": sql(_HOPS + " select f, t, count(*) as n, min(dep) as first_dep, max(arr) as last_arr, min(arr - dep) as least from hops group by f, t"),
    "rounds_profile": sql(_search(_ONE, 2) + """, p as (select stop, 0 as boardings, arr from r0 union all select stop, 1, arr from r1_w union all select stop, 2, arr from r2_w)
      select distinct stop, boardings, arr from p b where not exists (select 1 from p a where a.stop = b.stop and a.boardings <= b.boardings and a.arr <= b.arr and (a.boardings < b.boardings or a.arr < b.arr))"""),
    "range_profile": sql(_search(f"select dep as request, 0 as stop, dep as arr from (select distinct dep from active where stop = 0 and dep between {START} and {START + 7200})", 1) + """
      select request as departure, stop, arr from r1 b where not exists (select 1 from r1 a where a.stop = b.stop and a.request > b.request and a.arr <= b.arr)"""),
    "overnight_union": sql(f""", late as (select trip, line, svc, pos, stop, arr + case when line % 2 = 0 then 43200 else 0 end as arr, dep + case when line % 2 = 0 then 43200 else 0 end as dep from stop_times),
      both_days as (select * from late where svc in (select svc from services where {ACTIVE_SQL.format(day=QUERY_DAY)}) union all select trip + 10000000, line, svc, pos, stop, arr - 86400, dep - 86400 from late where arr >= 86400 and svc in (select svc from services where {ACTIVE_SQL.format(day=QUERY_DAY - 1)}))"""
      + _search("select 0 as request, 0 as stop, 10800 as arr", 1, "both_days") + " select stop, arr from r1"),
    "onboard_arrival": sql(", riders as (select request, request * 13 % nt as trip from requests, nt)" + _search("select r.request, s.stop, min(s.arr) as arr from riders r join stop_times s on s.trip = r.trip and s.pos > 1 group by r.request, s.stop", 1) + " select request, stop, arr from r1"),
    "latest_departure_backward": sql("""
      , b0 as (select stop, max(dep) as dep from (select 5 as stop, 61200 as dep union all select f, 61200 - w from transfers where t = 5) group by stop)""" + "".join(f"""
      , l{k} as (select s.trip, max(s.pos) as pos from b{k - 1} b join active s on s.stop = b.stop and s.arr <= b.dep group by s.trip), d{k} as (select s.stop, max(s.dep) as dep from l{k} l join active s on s.trip = l.trip and s.pos < l.pos group by s.stop)
      , b{k} as (select stop, max(dep) as dep from (select * from b{k - 1} union all select * from d{k} union all select t.f, d.dep - t.w from d{k} d join transfers t on t.t = d.stop) group by stop)""" for k in (1, 2)) + " select stop, dep from b2"),
    "pareto_2axis": "with p as (select distinct l_suppkey, l_quantity as x, l_extendedprice as y from lineitem) select * from p b where not exists (select 1 from p a where a.l_suppkey = b.l_suppkey and a.x <= b.x and a.y <= b.y and (a.x < b.x or a.y < b.y))",
    "pareto_front_4axis": sql(_VEC + f" select * from v b where not exists (select 1 from v a where {_dom(range(4))})"),
    "pareto_with_dominator": sql(_VEC + f""", f as (select b.vec_id, min(a.vec_id) as by from v a join v b on {_dom(range(3))} group by b.vec_id)
      select b.vec_id, f.by as dominated_by, coalesce(concat_ws(',', case when a.a0 < b.a0 then 'a0' end, case when a.a1 < b.a1 then 'a1' end, case when a.a2 < b.a2 then 'a2' end), '') as lost from v b left join f using (vec_id) left join v a on a.vec_id = f.by"""),
    "label_bucket_front": "with p as (select distinct l_suppkey, cast(floor(l_extendedprice / 100) as bigint) as arr, cast(floor(l_discount * 50 + 0.5) as int) as bucket from lineitem) select * from p b where not exists (select 1 from p a where a.l_suppkey = b.l_suppkey and a.arr <= b.arr and a.bucket >= b.bucket and (a.arr < b.arr or a.bucket > b.bucket))",
    "pareto_plan_front": sql(_PLAN + """ select * from plans b where not exists (select 1 from plans a where a.request = b.request and a.burden <= b.burden and a.transfers <= b.transfers and a."end" <= b."end" and a."start" >= b."start" and a.bucket >= b.bucket
      and (a.burden < b.burden or a.transfers < b.transfers or a."end" < b."end" or a."start" > b."start" or a.bucket > b.bucket or a.id < b.id))"""),
    "prune_slower_than_direct": sql(_PLAN + """ select id, transfers = 0 as direct, burden, "end" - "start" as seconds from plans p where transfers = 0 or not exists (select 1 from plans d where d.request = p.request and d.transfers = 0 and d.burden <= p.burden) or "end" - "start" <= (select min(d."end" - d."start") from plans d where d.request = p.request and d.transfers = 0 and d.burden <= p.burden)"""),
    "display_dedup": sql(_VEC + """, r as (select vec_id as "index", grp, floor(a0 / 60 + 0.5) as x, floor(a1 / 30 + 0.5) as y from v) select "index", grp from r b where not exists (select 1 from r a where a.grp = b.grp and a.x <= b.x and a.y <= b.y and (a.x < b.x or a.y < b.y or a."index" < b."index"))"""),
    "eps_pareto": sql(_VEC + " select vec_id, grp from v b where not exists (select 1 from v a where a.grp = b.grp and a.vec_id < b.vec_id and a.a0 <= b.a0 + 2.0 + cast(0.01 as double) * a.a0 and a.a1 <= b.a1 + 3.0 + cast(0.02 as double) * a.a1 and (a.a0 < b.a0 or a.a1 < b.a1))"),
}
