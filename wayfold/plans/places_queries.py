"""Queries on geography, isochrones, streets, fares, names and addresses, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bike, fares, geo, street, text
from ..operators import address, isochrone, itinerary, pricing, search, streets
from . import network as net
from .network import sql
from .schedule_queries import _VEC

START, MOST, STEP, SAMPLES = 28800, 7200, 180, (28800, 30600)
NODES = 24  # the street lattice has so many nodes a side


def _pairs(spark, d):
    s = net.stops(spark, d)
    a = s.select(F.col("stop").alias("f"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"))
    b = s.select(F.col("stop").alias("t"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    return net.transfers(spark, d).join(a, "f").join(b, "t")


def geo_distance(spark, d):
    p = _pairs(spark, d)
    args = [F.col(c) for c in ("lat1", "lon1", "lat2", "lon2")]
    m = geo.haversine(*args)
    return p.select("f", "t", F.round(m, 4).alias("metres"), F.round(geo.haversine(*args, radius=geo.RAIL_RADIUS), 4).alias("rail"), geo.damped(F.round(m, 4)).cast("long").alias("damped"), F.round(geo.squared_degrees(m) * 1e6, 6).alias("sq"), F.round(geo.metres_of(geo.squared_degrees(m), F.col("lat1")), 4).alias("back"))


def geo_project_segment(spark, d):
    p = _pairs(spark, d).withColumn("x", geo.project(F.col("lat1") + 0.001, F.col("lon1") - 0.0005, F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")))
    return p.select("f", "t", F.round("x.metres", 4).alias("metres"), F.round("x.t", 6).alias("at"))


def geo_lambert(spark, d):
    x = geo.lambert_2008(F.col("lat"), F.col("lon"))
    q = geo.quantise(F.col("lat"), F.col("lon"))
    return net.stops(spark, d).select("stop", F.round(x["east"], 3).alias("east"), F.round(x["north"], 3).alias("north"), q["lat"].alias("qlat"), q["lon"].alias("qlon"))


def _zones(spark):
    """Two overlapping zones; the first that holds a point counts."""
    p = lambda *xy: F.array(*[F.struct(F.lit(a).alias("lat"), F.lit(b).alias("lon")) for a, b in xy])
    one, two = p((50.0021, 4.001), (50.0201, 4.001), (50.0261, 4.0211), (50.0101, 4.0301)), p((50.0, 4.01), (50.0361, 4.01), (50.0361, 4.0501))
    return spark.range(2).select((F.col("id") + 1).cast("int").alias("zone"), F.when(F.col("id") == 0, one).otherwise(two).alias("ring"))


def point_in_zone(spark, d):
    zones = F.broadcast(_zones(spark))  # a row per zone
    held = net.stops(spark, d).join(zones, geo.inside(F.col("lat"), F.col("lon"), F.col("ring"))).groupBy("stop").agg(F.min("zone").alias("zone"))
    return net.stops(spark, d).select("stop").join(held, "stop", "left")


def polygon_centroid(spark, d):
    c = geo.centroid(F.col("ring"))
    return _zones(spark).select("zone", F.round(c["lat"], 6).alias("lat"), F.round(c["lon"], 6).alias("lon"))


def advance_along_shape(spark, d):
    line = F.array(*[F.struct(F.lit(a).alias("lat"), F.lit(b).alias("lon")) for a, b in ((50.0, 4.0), (50.01, 4.0), (50.01, 4.02))])
    asked = spark.range(0, 3200, 100).select(F.col("id").alias("metres"), geo.advance(line, F.col("id").cast("double")).alias("p"))
    return asked.select("metres", F.round("p.lat", 6).alias("lat"), F.round("p.lon", 6).alias("lon"))


def street_times(spark, d):
    s = F.col("seconds")
    b = geo.bracket(s.cast("double"), F.pow(geo.sigma(s) * s, 2))
    return spark.range(0, 3600, 30).select(F.col("id").alias("seconds")).select("seconds", F.round(geo.sigma(s), 9).alias("sigma"), geo.access_seconds(s).cast("long").alias("access"), geo.egress_seconds(s).cast("long").alias("egress"), F.round(b["p95"], 6).alias("p95"))


def _field(spark, d):
    seeds = spark.createDataFrame([(s, 0, s) for s in SAMPLES], "request long, stop long, arr int")
    arrivals = search.earliest_arrival(seeds, net.active_stop_times(spark, d), net.transfers(spark, d), rounds=1)
    return isochrone.field(arrivals.select("request", "stop", (F.col("arr") - F.col("request")).cast("int").alias("seconds")), net.stops(spark, d), MOST, STEP)


def isochrone_best(spark, d):
    return isochrone.best(_field(spark, d))


def isochrone_average(spark, d):
    return isochrone.average(_field(spark, d), len(SAMPLES), MOST)


def isochrone_grid(spark, d):
    return isochrone.grid(isochrone.best(_field(spark, d)))


def isochrone_exposed(spark, d):
    return isochrone.exposed(isochrone.best(_field(spark, d)).where("seconds <= 4000"))


def isochrone_contour(spark, d):
    return isochrone.contour(isochrone.best(_field(spark, d)), 3000)


def isochrone_sample(spark, d):
    points = spark.range(0, 300).select(F.col("id").alias("point"), (F.col("id") % 20 * 0.75 - 2).alias("y"), (F.col("id") % 17 * 0.8 - 2).alias("x"))
    return isochrone.sample(isochrone.best(_field(spark, d)), points).select("point", F.round("seconds", 6).alias("seconds"))


def _ways(spark, d):
    k = F.col("p_partkey")
    pick = lambda values, by: F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(k / by) % len(values) + 1).cast("int"))
    return spark.read.parquet(f"{d}/part.parquet").select(
        k.alias("way"),
        pick(_HIGHWAYS, 1).alias("highway"), pick(_SURFACES, 3).alias("surface"), pick(_ACCESS, 7).alias("access"), pick(_BICYCLE, 2).alias("bicycle"), pick(_FOOT, 11).alias("foot"), pick(_ONEWAY, 5).alias("oneway"), pick(_ONEWAY_B, 13).alias("oneway_bicycle"),
        pick((None, "roundabout"), 17).alias("junction"), pick((None, None, "opposite_lane"), 19).alias("cycleway"), pick((None, "yes"), 23).alias("motorroad"), (50 + k * 7 % 190).cast("int").alias("length"), (k % 9 - 4).cast("int").alias("elevation"), (k % 8).cast("int").alias("flags"), F.floor(k / 4).cast("int").alias("quarter"),
    )


_HIGHWAYS = ("motorway", "primary", "secondary_link", "tertiary", "residential", "service", "cycleway", "footway", "path", "track", "steps", "proposed", None)
_SURFACES = ("asphalt", "gravel", "sett", None, "mud")
_ACCESS, _BICYCLE, _FOOT, _ONEWAY, _ONEWAY_B = (None, "yes", "private", "forestry"), (None, "yes", "no", "dismount"), (None, "no", "designated"), (None, "yes", "-1"), (None, None, "no", "yes")


def street_classes(spark, d):
    c = F.col
    none = F.lit(None).cast("string")
    by_bike = street.bike_access(c("highway"), c("access"), none, c("bicycle"), none, c("motorroad"))
    wrong = lambda fwd: street.wrong_way(F.lit(fwd), c("oneway"), c("oneway_bicycle"), c("junction"), c("cycleway"))
    return _ways(spark, d).select(
        "way", street.admitted(c("highway"), c("access")).alias("admitted"), street.highway_class(c("highway")).alias("class"), street.surface_class(c("surface")).alias("ground"), street.surface_percent(c("surface")).alias("speed"), by_bike.alias("bike"),
        street.foot_access(by_bike, c("bicycle"), c("foot"), c("access"), c("motorroad")).alias("foot"), wrong(True).alias("wrong_forward"), wrong(False).alias("wrong_back"),
    )


def street_edge_cost(spark, d):
    c = F.col
    ground = street.surface_class(c("surface"))
    walk = street.walk_cost(c("length"), c("elevation"), ground, c("flags"), street.highway_class(c("highway")), F.coalesce(c("highway") != "motorway", F.lit(True)))
    drive = street.drive_cost(c("length"), c("flags"), street.highway_class(c("highway")), F.coalesce(c("highway").isin("primary", "secondary_link", "tertiary", "residential", "motorway"), F.lit(False)))
    kind = street.connector(c("highway"), F.when(c("flags") == 4, "yes"), F.lit(None).cast("string"), F.when(c("flags") == 2, "yes"))
    return _ways(spark, d).select(
        "way", walk["time"].alias("walk_time"), walk["ascent"].alias("ascent"), F.round(walk["surface"], 6).alias("surface"), walk["variance"].alias("walk_variance"), drive["time"].alias("drive_time"), drive["variance"].alias("drive_variance"), street.seconds(c("length"), "bike").alias("bike_seconds"), kind.alias("connector"), F.round(street.connector_seconds(kind, c("length")), 6).alias("connector_seconds"),
    )


def street_bike_factor(spark, d):
    c = F.col
    args = (street.highway_class(c("highway")), street.surface_class(c("surface")), (c("way") % 6).cast("int"), c("quarter") % 2 == 0, c("quarter") % 5 == 0, c("quarter") % 3 != 0, c("quarter") % 4 != 0, c("quarter") % 7 == 0)
    free = street.bike_factor(*args, base=0.05, unsafe=0.0, respect_oneway=False)
    return _ways(spark, d).select("way", F.round(street.bike_factor(*args), 6).alias("factor"), F.round(free, 6).alias("free"))


def bike_speeds(spark, d):
    c = F.col
    cruise = bike.cruise_speed(c("length"), c("elevation"))
    turn = c("flags") * 0.4
    corner = bike.corner_speed(cruise, turn, c("length") * 0.5, c("quarter") % 2 == 0)
    return _ways(spark, d).select("way", F.round(cruise, 6).alias("cruise"), F.round(corner, 6).alias("corner"), F.round(bike.speed_change_seconds(F.lit(5.0), corner), 6).alias("change"), bike.edge_seconds(c("length"), c("elevation"), c("quarter") % 3 == 0, F.coalesce(c("highway") == "steps", F.lit(False))).alias("seconds"))


def path_elevation_cost(spark, d):
    steps = F.array_sort(F.collect_list(F.struct("seq", F.col("delta").cast("double").alias("delta"), F.col("metres").cast("double").alias("metres"))))
    return _steps(spark, d).groupBy("path").agg(steps.alias("steps")).select("path", F.round(bike.elevation_cost(F.col("steps")), 4).alias("cost"))


def option_highlight(spark, d):
    """Options of each group of vectors in the order of ids, their first axes as time, ascent and surface."""
    from .schedule_queries import _vectors

    options = _vectors(spark, d).select("grp", "vec_id", F.col("a0").alias("time"), F.col("a1").alias("ascent"), F.col("a2").alias("surface"))
    return itinerary.highlight(options, "grp", "vec_id", {"time": 1.0, "ascent": 0.5, "surface": 0.7}, 60)


def _lattice(spark, d):
    """Edges of a lattice of streets, both ways; every 37th node is a sink."""
    k = F.col("p_partkey")
    e = spark.read.parquet(f"{d}/part.parquet").where(k < 2 * NODES * NODES).select((k % (NODES * NODES)).alias("a"), F.floor(k / (NODES * NODES)).alias("dir"), ((40 + F.col("p_size") * 7) * 1000 / 1200).cast("int").alias("w"))
    e = e.where(((F.col("dir") == 0) & (F.col("a") % NODES < NODES - 1)) | ((F.col("dir") == 1) & (F.col("a") < NODES * (NODES - 1)))).select("a", (F.col("a") + F.when(F.col("dir") == 0, 1).otherwise(NODES)).alias("b"), "w")
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    return both.withColumn("sink", F.col("a") % 37 == 5)


def street_distance_bounded(spark, d):
    seeds = spark.createDataFrame([(0, 0, 0), (1, 100, 30)], "request long, node long, seconds int")
    return streets.shortest(seeds, _lattice(spark, d), 900)


def nearest_stop(spark, d):
    points = net.requests(spark, d).select(F.col("request").alias("point"), (50 + F.col("request") % 97 * 0.0004).alias("lat"), (4 + F.col("request") % 89 * 0.0007).alias("lon"))
    nodes = net.stops(spark, d).select(F.col("stop").alias("node"), "lat", "lon")
    return streets.nearest(points, nodes, 0.01, 400.0).select("point", "node", F.round("metres", 4).alias("metres"))


def _steps(spark, d):
    return net.boardings(spark, d).select(F.expr("user_id * 100 + (seq - 1) div 10").alias("path"), "seq", (F.col("board_stop") % 3 == 0).alias("push"), F.col("km").alias("metres"), (F.col("km") * 2).alias("seconds"), (F.col("board_stop") % 11 - 5).alias("delta"), F.col("board_stop").alias("edge"), (F.col("user_id") % 20).alias("grp"))


def ride_push_runs(spark, d):
    return streets.ride_push_runs(_steps(spark, d))


def path_climbs(spark, d):
    return streets.climbs(_steps(spark, d), 5.0)


def shared_path_share(spark, d):
    once = _steps(spark, d).groupBy("grp", "path", "edge").agg(F.max("metres").alias("metres"))
    size = F.abs("share")
    whole = F.floor(size * 1e6).cast("double")
    rounded = F.signum("share") * (whole + F.when(size * 1e6 - whole >= 0.5, 1.0).otherwise(0.0)) / 1e6  # as SQL rounds the doubles, not their digits, halves away from zero
    return streets.shared_share(once).select("p", "q", F.when(size < float("inf"), rounded).otherwise(F.col("share")).alias("share"))


def fare_tariffs(spark, d):
    t = fares.Bracketed()
    km = F.col("km")
    base = spark.range(0, 160).select((F.col("id") * 0.9).alias("km"), "id")
    return base.select(
        "id", fares.bracket_km(km, t).alias("bracket"), fares.bracketed_cents(km, t).alias("second"), fares.bracketed_cents(km, t, True).alias("first"), fares.linear_cents(km, 120.0, 11.5, 3, 150, 200).alias("linear"), fares.band_cents(km, 21.0, (20, 60), (1.0, 0.8, 0.6), 3, 150, 200).alias("band"), fares.tier(F.col("id") * 13, F.lit(50)).alias("tier"),
    )


def fare_time_window(spark, d):
    b = fares.time_bucket(F.col("weekday"), F.col("board_time"), fares.TimeRules())
    r = fares.TimeRules()
    base = net.boardings(spark, d).select("user_id", "seq", "board_time", (F.col("user_id") % 7).cast("int").alias("weekday"))
    return base.select("user_id", "seq", b.alias("bucket"), fares.scale(b, r, False).alias("scale"), fares.scale(b, r, True).alias("card_scale"), fares.cap(b, r, True).alias("cap"))


def fare_fold(spark, d):
    p = pricing.price(F.col("rides"), 2)
    return pricing.ordered(net.boardings(spark, d)).select("user_id", p.alias("p")).select("user_id", "p.cents", "p.unknown")


def zone_pass_cap(spark, d):
    items = net.boardings(spark, d).select(F.expr("user_id * 100 + (seq - 1) div 5").alias("trip"), "operator", (F.col("km") * 7).alias("cents"), (F.col("board_stop") % 3 != 0).alias("in_zone"))
    return pricing.zone_pass(items)


def text_normalise(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.md5(text.normalise(F.coalesce("text", F.lit("")))).alias("digest"))


def station_names(spark, d):
    q = F.element_at(F.array(*map(F.lit, ("supplier", "000000001", "Supplier#00", "9", "pplier"))), (F.col("stop") % 5 + 1).cast("int"))
    return net.stops(spark, d).select("stop", text.name_key(F.col("name")).alias("key"), text.name_score(F.col("name"), q).alias("score"))


def display_labels(spark, d):
    names = ("GARE DU MIDI", "SINT-PIETERS OP DE KAAI", "PLACE LEOPOLD II", "Already Fine", "L'EGLISE D'EN HAUT", "ÉTANG NOIR")
    name = F.element_at(F.array(*map(F.lit, names)), (F.col("trip") % len(names) + 1).cast("int"))
    rgb = [(F.col("trip") * m % 256).cast("int") for m in (7, 11, 13)]
    return net.trips(spark, d).select("trip", text.harmonise(name).alias("name"), text.clock(F.col("dep0") + 40000).alias("clock"), text.colour(*rgb).alias("colour"), text.mode_rank(net.route_type()).alias("rank"), text.duration(F.col("dep0")).alias("duration"), text.parent_prefix(F.concat_ws("_", F.lit("s"), "line", "svc")).alias("parent"))


def box_references(spark, d):
    forms = ("high street 12 bus 4", "high street 12 b7", "high street 12/3", "high street 12 / 9", "busy lane 5", "bte 3 lane", "Rue Haute 7 Boîte: 12b", "old road 3 b. a12")
    asked = spark.createDataFrame(list(enumerate(forms)), "id int, query string")
    x = text.box_reference(F.col("query"))
    return asked.select("id", x["rest"].alias("rest"), x["box"].alias("box"))


def _records(spark, d):
    parts, nations = spark.read.parquet(f"{d}/part.parquet"), spark.read.parquet(f"{d}/nation.parquet")
    n = parts.count()
    c = spark.read.parquet(f"{d}/customer.parquet").withColumn("p_partkey", F.col("c_custkey") % n)
    named = c.join(parts.select("p_partkey", "p_name"), "p_partkey").join(F.broadcast(nations.select(F.col("n_nationkey").alias("c_nationkey"), "n_name")), "c_nationkey")  # a row per nation
    return named.select(F.col("c_custkey").alias("record"), F.col("p_name").alias("street"), F.col("n_name").alias("municipality"), (F.col("c_custkey") % 60 + 1).cast("string").alias("house"), (50 + F.col("c_custkey") % 31 * 0.004).alias("lat"), (4 + F.col("c_custkey") % 29 * 0.006).alias("lon"))


def _queries(spark):
    return spark.createDataFrame([(1, "small ring 12"), (2, "redd widgt"), (3, "nation blue"), (4, "larg bolt nation"), (5, "Réd Wid 7"), (6, "zzz")], "query int, text string")


def address_tokens(spark, d):
    return address.token_index(_records(spark, d))


def address_matches(spark, d):
    found = address.token_matches(address.query_tokens(_queries(spark)), address.token_index(_records(spark, d)))
    return found.select("query", "i", "kind", "name", F.round("weight", 6).alias("weight"), "fuzzy")


def address_rank(spark, d):
    return address.rank(_queries(spark), _records(spark, d), 10, (50.05, 4.06)).select("query", "record", F.round("score", 6).alias("score"), "rank")


def address_buildings(spark, d):
    return address.buildings(_records(spark, d)).select("street", "municipality", "house", "record", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "n", "one_place")


def street_collapse(spark, d):
    records = _records(spark, d)
    ranked = address.hits(_queries(spark), records)
    return address.collapse(ranked, records).select("query", "street", F.round("score", 6).alias("score"), "record", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


QUERIES = {f.__name__: f for f in (
    geo_distance, geo_project_segment, geo_lambert, point_in_zone, polygon_centroid, advance_along_shape, street_times, isochrone_best, isochrone_average, isochrone_grid, isochrone_exposed, isochrone_contour, isochrone_sample, street_classes, street_edge_cost,
    street_bike_factor, bike_speeds, path_elevation_cost, option_highlight, street_distance_bounded, nearest_stop, ride_push_runs, path_climbs, shared_path_share, fare_tariffs, fare_time_window, fare_fold, zone_pass_cap, text_normalise, station_names, display_labels, box_references, address_tokens, address_matches,
    address_rank, address_buildings, street_collapse,
)}

# ---- the same in DuckDB's SQL ----

_HAV = "2 * {r} * asin(sqrt(pow(sin(radians({a} - {c}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({b} - {d}) / 2), 2)))"


def _hav(a: str, b: str, c: str, d: str, r: float = geo.STREET_RADIUS) -> str:
    return _HAV.format(a=a, b=b, c=c, d=d, r=f"{r}::double")


_PAIRS = ", pairs as (select t.f, t.t, a.lat as lat1, a.lon as lon1, b.lat as lat2, b.lon as lon2 from transfers t join stops a on a.stop = t.f join stops b on b.stop = t.t)"
_ZONES = """, zones as (select 1 as zone, [{'lat': 50.0021::double, 'lon': 4.001::double}, {'lat': 50.0201, 'lon': 4.001}, {'lat': 50.0261, 'lon': 4.0211}, {'lat': 50.0101, 'lon': 4.0301}] as ring union all select 2, [{'lat': 50.0::double, 'lon': 4.01::double}, {'lat': 50.0361, 'lon': 4.01}, {'lat': 50.0361, 'lon': 4.0501}]),
  sides as (select zone, ring[i].lat as alat, ring[i].lon as alon, ring[i % len(ring) + 1].lat as blat, ring[i % len(ring) + 1].lon as blon from (select zone, ring, unnest(range(1, len(ring) + 1)) as i from zones))"""


def _one_round(seeds: str) -> str:
    from .schedule_queries import _search

    return _search(seeds, 1)


_FIELD = _one_round(" union all ".join(f"select {s} as request, 0 as stop, {s} as arr" for s in SAMPLES)) + f""", dia as (select r, c, (abs(r) + abs(c)) * {STEP} as w from (select unnest(range({-(MOST // STEP)}, {MOST // STEP + 1})) as r), (select unnest(range({-(MOST // STEP)}, {MOST // STEP + 1})) as c) where abs(r) + abs(c) <= {MOST // STEP}),
  field as (select request, gr, gc, cast(min(seconds) as int) as seconds from (select r1.request, s.gr + d.r as gr, s.gc + d.c as gc, r1.arr - r1.request + d.w as seconds from r1 join stops s using (stop), dia d where r1.arr - r1.request <= {MOST}) where seconds <= {MOST} group by request, gr, gc),
  best as (select gr, gc, min(seconds) as seconds from field group by gr, gc)"""


def _pick(values: tuple, by: int) -> str:
    listed = ", ".join("null" if v is None else f"'{v}'" for v in values)
    return f"list_value({listed})[p_partkey // {by} % {len(values)} + 1]"


_WAYS = f""", ways as (select p_partkey as way, {_pick(_HIGHWAYS, 1)} as highway, {_pick(_SURFACES, 3)} as surface, {_pick(_ACCESS, 7)} as access, {_pick(_BICYCLE, 2)} as bicycle, {_pick(_FOOT, 11)} as foot, {_pick(_ONEWAY, 5)} as oneway, {_pick(_ONEWAY_B, 13)} as ob,
  {_pick((None, "roundabout"), 17)} as junction, {_pick((None, None, "opposite_lane"), 19)} as cycleway, {_pick((None, "yes"), 23)} as motorroad, cast(50 + p_partkey * 7 % 190 as int) as length, cast(p_partkey % 9 - 4 as int) as elevation, cast(p_partkey % 8 as int) as flags, p_partkey // 4 as quarter from part),
  cls as (select *, case when highway = 'proposed' or highway is null then 'other' else highway end as class, case when surface is null then 'unknown' when surface in ('asphalt', 'sett') then 'paved' else 'unpaved' end as ground,
    case access when 'private' then false when 'yes' then true when 'forestry' then true else coalesce(motorroad <> 'yes', true) end as general from ways)"""
_STEPS = ", steps as (select user_id * 100 + (seq - 1) // 10 as path, seq, board_stop % 3 = 0 as push, km as metres, km * 2 as seconds, board_stop % 11 - 5 as delta, board_stop as edge, user_id % 20 as grp from boardings)"
_LATTICE = f""", e as (select p_partkey % {NODES * NODES} as a, p_partkey // {NODES * NODES} as dir, (40 + p_size * 7) * 1000 // 1200 as w from part where p_partkey < {2 * NODES * NODES}),
  e1 as (select a, a + case dir when 0 then 1 else {NODES} end as b, w from e where (dir = 0 and a % {NODES} < {NODES - 1}) or (dir = 1 and a < {NODES * (NODES - 1)})), edges as (select a, b, w from e1 union all select b, a, w from e1),
  walk as (select 0 as request, 0 as node, 0 as seconds union select 1, 100, 30 union select w.request, e.b, cast(w.seconds + e.w as int) from walk w join edges e on e.a = w.node where w.node % 37 <> 5 and w.seconds + e.w <= 900)"""
_TARIFF = "case when k >= 116 then 118 when k <= 30 then k when k <= 60 then 3 * ((k - 31) // 3) + 32 when k <= 115 then 5 * ((k - 61) // 5) + 63 else k end"
_BUCKET = "case when weekday >= 5 then 'weekend' when (t >= 21600 and t < 32400) or (t >= 54000 and t < 64800) then 'peak' else 'offpeak' end"
_FOLD = """, r as (select user_id, seq, operator as op, board_time as t, km, lag(operator) over w as prev from boardings window w as (partition by user_id order by seq)),
  runs as (select *, sum(case when op = 'signup' and coalesce(prev, '') <> 'signup' then 1 else 0 end) over (partition by user_id order by seq) as run from r),
  rail as (select *, sum(km) over (partition by user_id, run order by seq) as run_km from runs where op = 'signup'),
  priced as (select *, greatest(cast(floor(run_km + 0.5) as int), 3) as k from rail),
  part as (select *, cast(floor(greatest((floor((greatest(15.0::double * ({tariff}) + 90.0, 260.0) + 5) / 10) * 10 - 260) * 1.0::double, 0.0) + 0.5) as int) as p from priced),
  runcost as (select user_id, sum(260 + p) as cents from (select *, row_number() over (partition by user_id, run order by seq desc) as last from part) where last = 1 group by user_id),
  flat as (select user_id, seq, op, t, row_number() over (partition by user_id, op order by seq) as n, case op when 'click' then 250 else 300 end as price, case op when 'click' then 3600 else 5400 end as valid from r where op in ('click', 'view')),
  held as (select user_id, op, n, t as act, price as paid from flat where n = 1 union all select f.user_id, f.op, f.n, case when f.t >= h.act and f.t - h.act < f.valid then h.act else f.t end, case when f.t >= h.act and f.t - h.act < f.valid then 0 else f.price end from held h join flat f on f.user_id = h.user_id and f.op = h.op and f.n = h.n + 1)
  select u.user_id, cast(coalesce(rc.cents, 0) + coalesce(fl.cents, 0) + u.singles * 280 as int) as cents, cast(u.unknown as int) as unknown from (select user_id, count(*) filter (op = 'purchase') as singles, count(*) filter (op = 'error') as unknown from r group by user_id) u
  left join runcost rc using (user_id) left join (select user_id, sum(paid) as cents from held group by user_id) fl using (user_id)""".replace("{tariff}", _TARIFF)
_NORM = "trim(regexp_replace(translate(lower({x}), 'àáâäãåçèéêëìíîïñòóôöõùúûüýÿß', 'aaaaaaceeeeiiiinooooouuuuyys'), '[^a-z0-9]+', ' ', 'g'))"
_RECORDS = """, pn as (select count(*) as pn from part), records as (select c.c_custkey as record, p.p_name as street, n.n_name as municipality, cast(c.c_custkey % 60 + 1 as varchar) as house, 50 + (c.c_custkey % 31) * cast(0.004 as double) as lat, 4 + (c.c_custkey % 29) * cast(0.006 as double) as lon from customer c, pn join part p on p.p_partkey = c.c_custkey % pn join nation n on n.n_nationkey = c.c_nationkey),
  idx as (select distinct kind, name, unnest(string_split({n}, ' ')) as token from (select distinct 'street' as kind, street as name from records union all select distinct 'municipality', municipality from records))""".format(n=_NORM.format(x="name"))
_ADDRESS = _RECORDS + """, q as (select * from (values (1, 'small ring 12'), (2, 'redd widgt'), (3, 'nation blue'), (4, 'larg bolt nation'), (5, 'Réd Wid 7'), (6, 'zzz')) v(query, text)),
  qs as (select query, string_split({n}, ' ') as ts from q), qt as (select query, cast(unnest(range(len(ts))) as int) as i, unnest(ts) as token from qs), words as (select * from qt where token not similar to '[0-9].*'),
  m as (select query, i, kind, name, max(w) as weight from (select w.query, w.i, x.kind, x.name, case when x.kind = 'municipality' then cast(0.9 as double) else 1.0 end * case when x.token = w.token then 1.0::double when starts_with(x.token, w.token) then 0.6::double
    when length(w.token) >= 3 and levenshtein(x.token, w.token) <= case when length(w.token) >= 8 then 2 else 1 end then 0.4::double end as w from words w join idx x on substr(x.token, 1, 1) = substr(w.token, 1, 1)) where w is not null group by query, i, kind, name),
  mf as (select *, weight <= 0.4 as fuzzy from m)""".format(n=_NORM.format(x="text"))
_RANKED = _ADDRESS + """, places as (select distinct street, municipality from records), wn as (select query, count(*) filter (token not similar to '[0-9].*') as words, list(token) filter (token similar to '[0-9].*') as numbers from qt group by query),
  f as (select m.query, m.i, p.street, p.municipality, m.weight, m.fuzzy from mf m join places p on (m.kind = 'street' and p.street = m.name) or (m.kind = 'municipality' and p.municipality = m.name)),
  sure as (select query, count(distinct street) as sure from (select f.query, f.street, f.municipality from f join wn using (query) where not f.fuzzy group by f.query, f.street, f.municipality, wn.words having count(distinct f.i) = wn.words) group by query),
  fb as (select query, street, municipality, avg(weight) as base, count(*) as n from (select f.query, f.street, f.municipality, f.i, max(f.weight) as weight from f left join sure using (query) where not f.fuzzy or coalesce(sure, 0) < 5 group by f.query, f.street, f.municipality, f.i) group by query, street, municipality),
  hits as (select fb.query, r.record, r.street, r.lat, r.lon, fb.base * case when list_contains(coalesce(wn.numbers, []), r.house) then cast(1.5 as double) else 1.0 end as score from fb join wn using (query) join records r using (street, municipality) where fb.n = wn.words and len(list_filter(coalesce(wn.numbers, []), lambda x: not starts_with(r.house, x))) = 0)"""
_LAMBERT = {k: f"{v!r}::double" for k, v in geo.LAMBERT_2008.items()}

ORACLES = {
    "geo_distance": sql(_PAIRS + f", m as (select *, {_hav('lat1', 'lon1', 'lat2', 'lon2')} as m from pairs) select f, t, round(m, 4) as metres, round({_hav('lat1', 'lon1', 'lat2', 'lon2', geo.RAIL_RADIUS)}, 4) as rail, cast(floor(round(m, 4) * cast(0.99 as double)) as bigint) as damped, round(pow(m / 111320.0::double, 2) * 1e6, 6) as sq, round(m / 111320.0::double * 111320.0::double * greatest(cos(radians(lat1)), 0.5), 4) as back from m"),
    "geo_project_segment": sql(_PAIRS + """, p as (select f, t, lat1 + cast(0.001 as double) as y, lon1 - cast(0.0005 as double) as x, * exclude (f, t) from pairs), s as (select f, t, (lon1 - x) * 111320.0::double * cos(radians(y)) as ax, (lat1 - y) * 111320.0::double as ay, (lon2 - x) * 111320.0::double * cos(radians(y)) as bx, (lat2 - y) * 111320.0::double as b_y from p),
      u as (select *, bx - ax as dx, b_y - ay as dy from s), v as (select *, case when dx * dx + dy * dy = 0 then 0.0 else least(greatest(-(ax * dx + ay * dy) / (dx * dx + dy * dy), 0.0), 1.0) end as k from u) select f, t, round(sqrt(pow(ax + k * dx, 2) + pow(ay + k * dy, 2)), 4) as metres, round(k, 6) as at from v"""),
    "geo_lambert": sql(""", c as (select {a} as a, sqrt(2 / {inv_f} - 1 / ({inv_f} * {inv_f})) as e, radians({lat0}) as p0, radians({lat1}) as p1, radians({lat2}) as p2),
      s as (select *, cos(p1) / sqrt(1 - e * e * sin(p1) * sin(p1)) as m1, cos(p2) / sqrt(1 - e * e * sin(p2) * sin(p2)) as m2, tan(pi() / 4 - p0 / 2) / pow((1 - e * sin(p0)) / (1 + e * sin(p0)), e / 2) as t0, tan(pi() / 4 - p1 / 2) / pow((1 - e * sin(p1)) / (1 + e * sin(p1)), e / 2) as t1, tan(pi() / 4 - p2 / 2) / pow((1 - e * sin(p2)) / (1 + e * sin(p2)), e / 2) as t2 from c),
      g as (select *, ln(m1 / m2) / ln(t1 / t2) as k from s), h as (select stop, lat, lon, k, a * m1 / (k * pow(t1, k)) as big, t0, k * radians(lon - {lon0}) as th, tan(pi() / 4 - radians(lat) / 2) / pow((1 - e * sin(radians(lat))) / (1 + e * sin(radians(lat))), e / 2) as tt from stops, g)
      select stop, round({east} + big * pow(tt, k) * sin(th), 3) as east, round({north} + big * pow(t0, k) - big * pow(tt, k) * cos(th), 3) as north, cast(floor(lat * 1e6 + 0.5) as bigint) as qlat, cast(floor(lon * 1e6 + 0.5) as bigint) as qlon from h""".format(**_LAMBERT)),
    "point_in_zone": sql(_ZONES + " select s.stop, (select min(zone) from (select d.zone from sides d where (d.alat > s.lat) <> (d.blat > s.lat) and s.lon < (d.blon - d.alon) * (s.lat - d.alat) / (d.blat - d.alat) + d.alon group by d.zone having count(*) % 2 = 1)) as zone from stops s"),
    "polygon_centroid": sql(_ZONES + " select zone, round(sum((alat + blat) * w) / (3 * sum(w)), 6) as lat, round(sum((alon + blon) * w) / (3 * sum(w)), 6) as lon from (select *, alon * blat - blon * alat as w from sides) group by zone"),
    "advance_along_shape": f"with l as (select {_hav('50.0::double', '4.0::double', '50.01::double', '4.0::double')} as a, {_hav('50.01::double', '4.0::double', '50.01::double', '4.02::double')} as b), m as (select cast(unnest(range(0, 3200, 100)) as bigint) as metres) select metres, round(50 + least(metres / a, 1.0) * 0.01::double, 6) as lat, round(4 + least(greatest(metres - a, 0.0) / b, 1.0) * 0.02::double, 6) as lon from m, l",
    "street_times": "with s as (select cast(unnest(range(0, 3600, 30)) as bigint) as seconds), g as (select seconds, case when seconds = 0 then 0.0 else least(greatest(3.8::double / sqrt(seconds), 0.12), 0.5) end as sigma from s) select seconds, round(sigma, 9) as sigma, cast(floor(seconds * exp(sigma * 1.0364333894937898::double) + 0.5) as bigint) as access, cast(floor(seconds * exp(sigma * sigma / 2) + 0.5) as bigint) as egress, round(seconds + 1.645::double * sigma * seconds, 6) as p95 from g",
    "isochrone_best": sql(_FIELD + " select * from best"),
    "isochrone_average": sql(_FIELD + f" select gr, gc, cast((sum(seconds) + ({len(SAMPLES)} - count(*)) * {MOST}) // {len(SAMPLES)} as int) as seconds from field group by gr, gc"),
    "isochrone_grid": sql(_FIELD + " select gr, gc, seconds, dense_rank() over (order by gr) as i, dense_rank() over (order by gc) as j from best"),
    "isochrone_exposed": sql(_FIELD + ", k as (select * from best where seconds <= 4000) select k.gr, k.gc, s.side from k, (values ('n', -1, 0), ('s', 1, 0), ('w', 0, -1), ('e', 0, 1)) s(side, r, c) where not exists (select 1 from k x where x.gr = k.gr + s.r and x.gc = k.gc + s.c)"),
    "isochrone_contour": sql(_FIELD + ", k as (select gr - r as gr, gc - c as gc, v from (select * from best where seconds <= 3000), (values (0, 0, 8), (0, 1, 4), (1, 1, 2), (1, 0, 1)) s(r, c, v)) select gr, gc, cast(sum(v) as int) as code from k group by gr, gc having sum(v) between 1 and 14"),
    "isochrone_sample": sql(_FIELD + """, p as (select cast(i as bigint) as point, i % 20 * cast(0.75 as double) - 2 as y, i % 17 * cast(0.8 as double) - 2 as x from (select unnest(range(300)) as i)),
      c as (select point, y, x, cast(floor(y) as int) + r as gr, cast(floor(x) as int) + k as gc from p, (select unnest([0, 1]) as r), (select unnest([0, 1]) as k)), j as (select c.*, b.seconds from c left join best b using (gr, gc))
      select point, round(case when count(seconds) = 4 then sum(seconds * (1 - abs(y - gr)) * (1 - abs(x - gc))) else cast(arg_min(seconds, (power(y - gr, 2) + power(x - gc, 2), seconds)) filter (seconds is not null) as double) end, 6) as seconds from j group by point"""),
    "street_classes": sql(_WAYS + """, b as (select *, case when bicycle is not null then bicycle not in ('no', 'dismount') when highway = 'footway' then false else general end as bike from cls)
      select way, coalesce(highway <> 'proposed', false) and coalesce(access not in ('private', 'forestry'), true) as admitted, class, ground, case surface when 'asphalt' then 100 when 'gravel' then 60 when 'sett' then 65 when 'mud' then 20 else 90 end as speed, bike,
      case when bike or coalesce(bicycle = 'dismount', false) then true when foot is not null then foot <> 'no' else general end as foot,
      case when cycleway is not null or coalesce(ob = 'no', false) then false else coalesce(oneway = '-1', false) end as wrong_forward,
      case when cycleway is not null or coalesce(ob = 'no', false) then false when coalesce(ob = 'yes', false) then true when oneway is null then junction is not null else oneway = 'yes' end as wrong_back from b"""),
    "street_edge_cost": sql(_WAYS + """, s as (select *, case when flags % 2 = 1 then case when class = 'primary' then 25.0 when class = 'secondary_link' then 18.0 else 12.0 end else 0.0 end as sig, case when flags % 2 = 1 then case when class = 'primary' then 15.0 when class = 'secondary_link' then 10.0 else 7.0 end else 0.0 end as del,
        case when highway = 'steps' then 'steps' when flags = 4 then 'elevator' when flags = 2 then 'ramp' end as con from cls), v as (select *, cast(sig * sig + (flags // 2 % 2) * 9.0 + (flags // 4) * 400.0 as double) as var from s)
      select way, case when coalesce(highway <> 'motorway', true) then cast(length * 1000 // 1200 + del as double) end as walk_time, case when coalesce(highway <> 'motorway', true) then cast(greatest(elevation, 0) as double) end as ascent,
      case when coalesce(highway <> 'motorway', true) then round(length * case ground when 'paved' then 1.0::double when 'unknown' then 1.3::double else 2.5::double end, 6) end as surface, case when coalesce(highway <> 'motorway', true) then var end as walk_variance,
      case when highway in ('primary', 'secondary_link', 'tertiary', 'residential', 'motorway') then cast(length * 1000 // 11000 as double) end as drive_time, case when highway in ('primary', 'secondary_link', 'tertiary', 'residential', 'motorway') then var end as drive_variance,
      cast(length * 1000 // 4200 as bigint) as bike_seconds, con as connector, round(case con when 'elevator' then 45.0::double when 'steps' then length / 0.5::double when 'ramp' then length / 0.9::double end, 6) as connector_seconds from v"""),
    "street_bike_factor": sql(_WAYS + """, x as (select way, class, ground, way % 6 + 1 as g, quarter % 2 = 0 as signed, quarter % 5 = 0 as route, quarter % 3 <> 0 as bike, quarter % 4 <> 0 as foot, quarter % 7 = 0 as against from cls),
      y as (select *, case when against then case class when 'primary' then 50.0 when 'secondary_link' then 30.0 when 'tertiary' then 20.0 else 4.0 end else 0.0 end as pen, case when class in ('path', 'track', 'footway') then case when (ground = 'paved' or signed or class = 'footway') and ground <> 'unpaved' then list_value(1.0, 1.0, 1.1, 1.5, 2.0, 3.0)[g] else list_value(5.0, 1.3, 2.0, 3.0, 5.0, 5.0)[g] end
        when class = 'primary' then case when signed then 1.2 else 3.0 end when class = 'secondary_link' then case when signed then 1.1 else 1.6 end when class = 'tertiary' then case when signed then 1.0 else 1.4 end when class = 'residential' then case when ground = 'unpaved' then 1.5 else 1.1 end when class = 'service' then case when ground = 'unpaved' then 1.6 else 1.3 end when class = 'cycleway' then 1.0 else 2.0 end as part from x),
      z as (select *, class in ('motorway', 'other') or (not bike and not foot) as closed, case when bike then 0.0 else 4.0 end as acc, case when class in ('primary', 'secondary_link', 'tertiary') and not signed then 2.0 else 0.0 end as unsafe from y)
      select way, round(cast(case when closed then null when class = 'steps' then 40.0 when against then null when route then 1.0 else 0.5 + part + unsafe + acc end as double), 6) as factor, round(cast(case when closed then null when class = 'steps' then 40.0 when route then 1.0 + pen else 0.05 + part + greatest(pen, acc) end as double), 6) as free from z"""),
    "bike_speeds": sql(_WAYS + """, w as (select way, class, length, quarter, flags * 0.4::double as turn, atan(elevation / length) as slope from cls), f as (select *, 90.0::double * 9.81::double * (0.006::double * cos(slope) + sin(slope)) as lin, 0.5 * 1.225::double * 0.55::double as cube from w),
      h as (select way, 0 as i, 0.01::double as lo, 10.0::double as hi, lin, cube from f union all select way, i + 1, case when lin * (lo + hi) / 2 + cube * pow((lo + hi) / 2, 3) < 100 then (lo + hi) / 2 else lo end, case when lin * (lo + hi) / 2 + cube * pow((lo + hi) / 2, 3) < 100 then hi else (lo + hi) / 2 end, lin, cube from h where i < 40),
      s as (select f.*, greatest(case when f.lin * 10 + f.cube * 1000 <= 100 then 10.0 else (h.lo + h.hi) / 2 end, 0.5) as v from f join h on h.way = f.way and h.i = 40),
      k as (select *, case when turn <= 1e-6 then v else least(sqrt(case when quarter % 2 = 0 then 8.0 else 3.5 end * greatest(length * 0.5, 10.0) / turn), v) end as c from s)
      select way, round(v, 6) as cruise, round(c, 6) as corner, round(case when c < 5 then (5 - c) / 2.5 else c - 5 end, 6) as change, cast(floor(length / case when quarter % 3 = 0 then case when class = 'steps' then 0.25::double else 0.9::double end else v end + 0.5) as int) as seconds from k"""),
    "path_elevation_cost": sql(_STEPS + """, s as (select path, cast(delta as double) as d, cast(metres as double) as m, row_number() over (partition by path order by seq) as n from steps),
      w as (select path, 0 as n, 0.0::double as dn, 0.0::double as up, 0.0::double as cost from (select distinct path from s) union all select path, n, case when m > 0 then greatest(hd - cd, 0.0) else dn end, case when m > 0 then greatest(hu - cu, 0.0) else up end, cost + case when m > 0 then cd * 100 else 0.0 end from
        (select *, case when hd > 5 then greatest(hd - 10, 0.0) else 0.0 end as cd, case when hu > 5 then greatest(hu - 10, 0.0) else 0.0 end as cu from (select w.path, s.n, w.dn, w.up, w.cost, s.m, w.dn - s.d - s.m * 0.5::double / 100 as hd, w.up + s.d - s.m * 1.5::double / 100 as hu from w join s on s.path = w.path and s.n = w.n + 1)))
      select path, round(arg_max(cost, n), 4) as cost from w group by path"""),
    "option_highlight": sql(_VEC + """, o as (select grp, vec_id, a0, a1, a2, row_number() over (partition by grp order by vec_id) - 1 as i from v),
      scored as (select *, case when a0 <= 60 then 1 else 0 end as fits, coalesce((a0 - min(a0) over g) / nullif(max(a0) over g - min(a0) over g, 0)::double, 0) + 0.5::double * coalesce((a1 - min(a1) over g) / nullif(max(a1) over g - min(a1) over g, 0)::double, 0) + 0.7::double * coalesce((a2 - min(a2) over g) / nullif(max(a2) over g - min(a2) over g, 0)::double, 0) as s,
        coalesce((a0 - min(a0) over f) / nullif(max(a0) over f - min(a0) over f, 0)::double, 0) + 0.5::double * coalesce((a1 - min(a1) over f) / nullif(max(a1) over f - min(a1) over f, 0)::double, 0) + 0.7::double * coalesce((a2 - min(a2) over f) / nullif(max(a2) over f - min(a2) over f, 0)::double, 0) as t from o window g as (partition by grp), f as (partition by grp, a0 <= 60))
      select grp, cast(arg_min(i, (s, i)) as int) as balanced, cast(case when max(fits) = 1 then arg_min(i, (t, i)) filter (fits = 1) else arg_min(i, (a0, i)) end as int) as within from scored group by grp"""),
    "street_distance_bounded": sql(_LATTICE + " select request, node, min(seconds) as seconds from walk group by request, node"),
    "nearest_stop": sql(f", p as (select request as point, 50 + request % 97 * cast(0.0004 as double) as y, 4 + request % 89 * cast(0.0007 as double) as x from requests), m as (select p.point, s.stop as node, {_hav('p.y', 'p.x', 's.lat', 's.lon')} as m from p, stops s) select point, node, round(m, 4) as metres from (select *, row_number() over (partition by point order by m, node) as k from m where m <= 400) where k = 1"),
    "ride_push_runs": sql(_STEPS + ", a as (select *, case when push = lag(push) over (partition by path order by seq) then 0 else 1 end as nw from steps), b as (select *, sum(nw) over (partition by path order by seq) as run from a) select path, run, bool_or(push) as push, sum(seconds) as seconds, sum(metres) as metres from b group by path, run"),
    "path_climbs": sql(_STEPS + """, s as (select path, delta, row_number() over (partition by path order by seq) as n from steps), w as (select path, n, least(greatest(delta, 0.0), 5.0) as held, greatest(delta - 5.0, 0.0) as cost from s where n = 1 union all select w.path, s.n, least(greatest(w.held + s.delta, 0.0), 5.0), w.cost + greatest(w.held + s.delta - 5.0, 0.0) from w join s on s.path = w.path and s.n = w.n + 1)
      select path, cast(arg_max(cost, n) as double) as ascent from w group by path"""),
    "shared_path_share": sql(_STEPS + ", o as (select grp, path, edge, max(metres) as m from steps group by grp, path, edge), l as (select path, sum(m) as len from o group by path), c as (select a.path as p, b.path as q, sum(a.m) as c from o a join o b on a.grp = b.grp and a.edge = b.edge and a.path < b.path group by a.path, b.path) select p, q, round(c / least(x.len, y.len), 6) as share from c join l x on x.path = p join l y on y.path = q"),
    "fare_tariffs": f"""with i as (select cast(unnest(range(160)) as bigint) as id), k as (select id, cast(floor(id * 0.9::double + 0.5) as int) as r from i), t as (select *, greatest(r, 3) as k from k), b as (select *, {_TARIFF} as bracket, case when r + 2 >= 150 then 150 else greatest(r, 3) end as tk from t), c as (select *, greatest(15.0::double * bracket + 90.0, 260.0) as raw from b),
      d as (select *, raw * case when bracket <= 10 then 1.3::double when bracket <= 30 then 1.4::double else 1.5::double end as fc from c), e as (select *, case when fc < 1000 then 10 when fc <= 2000 then 20 else 50 end as grid from d)
      select id, cast(bracket as int) as bracket, cast(floor((raw + 5) / 10) * 10 as int) as second, cast(floor((fc + grid / 2) / grid) * grid as int) as "first", greatest(cast(floor(120.0::double + 11.5::double * tk + 0.5) as int), 200) as linear, greatest(cast(floor(21.0::double * case when tk <= 20 then 1.0::double when tk <= 60 then 0.8::double else 0.6::double end * tk + 0.5) as int), 200) as band, cast(floor(id * 13 / 50) * 50 as bigint) as tier from e""",
    "fare_time_window": sql(f", b as (select user_id, seq, board_time as t, user_id % 7 as weekday from boardings), c as (select *, {_BUCKET} as bucket from b) select user_id, seq, bucket, case when bucket = 'weekend' then 1 - 0.3::double else 1.0 end as scale, case when bucket = 'peak' then 1.0 else 1 - 0.4::double end as card_scale, case when bucket = 'peak' then 1500 end as cap from c"),
    "fare_fold": sql(_FOLD),
    "zone_pass_cap": sql(", i as (select user_id * 100 + (seq - 1) // 5 as trip, operator, km * 7 as cents, board_stop % 3 <> 0 as z from boardings), t as (select trip, sum(cents) as a, coalesce(sum(cents) filter (z), 0) as zone, count(distinct operator) filter (z and cents > 0) as ops from i group by trip) select trip, cast(a - case when ops >= 2 and zone > 840 then zone - 840 else 0 end as bigint) as cents, cast(case when ops >= 2 and zone > 840 then zone - 840 else 0 end as bigint) as saved from t"),
    "text_normalise": f"select doc_id, md5({_NORM.format(x="coalesce(text, '')")}) as digest from documents",
    "station_names": sql(f", a as (select stop, name, {_NORM.format(x='name')} as n, {_NORM.format(x='q')} as q from (select *, list_value('supplier', '000000001', 'Supplier#00', '9', 'pplier')[stop % 5 + 1] as q from stops)) select stop, lower(name) as key, case when n = q then 4 when starts_with(n, q) then 3 when contains(' ' || n, ' ' || q) then 2 when contains(n, q) then 1 else 0 end as score from a"),
    "display_labels": sql(""" select trip, list_value('Gare du MIDI', 'Sint-Pieters op de Kaai', 'Place Leopold II', 'Already Fine', 'L''Eglise D''En Haut', 'Étang Noir')[trip % 6 + 1] as name, printf('%02d:%02d:%02d', (dep0 + 40000) // 3600, (dep0 + 40000) % 3600 // 60, (dep0 + 40000) % 60) as clock,
      printf('#%02x%02x%02x', trip * 7 % 256, trip * 11 % 256, trip * 13 % 256) as colour, list_value(3, 2, 1, 0)[line % 4 + 1] as rank, printf('%d h %02d', cast(floor(dep0 / 60 + 0.5) as int) // 60, cast(floor(dep0 / 60 + 0.5) as int) % 60) as duration, 's_' || line as parent from trips"""),
    "box_references": "select * from (values (0, 'high street 12', '4'), (1, 'high street 12', '7'), (2, 'high street 12/3', null), (3, 'high street 12', '9'), (4, 'busy lane 5', null), (5, 'bte 3 lane', null), (6, 'Rue Haute 7 Boîte: 12b', null), (7, 'old road 3', 'a12')) t(id, rest, box)",
    "address_tokens": sql(_RECORDS + " select * from idx"),
    "address_matches": sql(_ADDRESS + " select query, i, kind, name, round(weight, 6) as weight, fuzzy from mf"),
    "address_rank": sql(_RANKED + f", s as (select query, record, round(score * greatest(exp(-greatest({_hav('50.05::double', '4.06::double', 'lat', 'lon')} / 1000 - 2.0, 0.0) / (3.0::double / ln(2.0::double))), 0.1), 9) as score from hits) select query, record, round(score, 6) as score, rank from (select *, row_number() over (partition by query order by score desc, record) as rank from s) where rank <= 10"),
    "address_buildings": sql(_RECORDS + f", m as (select street, municipality, house, min(record) as record, avg(lat) as mlat, avg(lon) as mlon, count(*) as n from records group by street, municipality, house) select m.street, m.municipality, m.house, m.record, round(m.mlat, 6) as lat, round(m.mlon, 6) as lon, m.n, bool_and({_hav('r.lat', 'r.lon', 'm.mlat', 'm.mlon')} <= 5.0) as one_place from m join records r using (street, municipality, house) group by m.street, m.municipality, m.house, m.record, m.mlat, m.mlon, m.n"),
    "street_collapse": sql(_RANKED + ", s as (select query, street, record, round(score, 9) as score from hits), t as (select * from (select *, row_number() over (partition by query, street order by score desc, record) as k from s) where k = 1) select t.query, t.street, round(t.score, 6) as score, t.record, round(m.lat, 6) as lat, round(m.lon, 6) as lon from t join (select street, median(lat) as lat, median(lon) as lon from records group by street) m using (street)"),
}
