import struct
import zlib

import pytest
from pyspark.sql import functions as F

from wayfold.sources import gtfs, gtfs_rt, osm, raster, register, snapshot
from wayfold.streaming import live


def varint(n):
    n &= (1 << 64) - 1
    out = b""
    while True:
        out += bytes([n & 127 | (128 if n > 127 else 0)])
        n >>= 7
        if not n:
            return out


def field(number, value):
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    value = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(value)) + value


def test_live_feed(spark, tmp_path):
    trip = lambda t, rel=None: field(1, t) + field(5, "r1") + (field(4, rel) if rel else b"")
    stops = field(2, field(1, 3) + field(4, "s3") + field(3, field(1, -30))) + field(2, field(4, "s4") + field(5, 1)) + field(2, field(4, "s5") + field(5, 2)) + field(2, field(1, 6) + field(2, field(1, 90)) + field(3, field(1, 5)))
    alert = field(1, field(1, 100)) + field(5, field(2, "r1")) + field(5, field(5, "s3")) + field(6, 2) + field(10, field(1, field(1, "bonjour") + field(2, "fr")) + field(1, field(1, "hello") + field(2, "en")))
    feed = b"".join(field(2, field(1, name) + body) for name, body in (("a", field(3, field(1, trip("t1")) + stops + field(4, 77))), ("b", field(3, field(1, trip("t2", 3)))), ("c", field(4, field(1, trip("t1")) + field(2, field(1, 50.5) + field(2, 4.25)) + field(5, 99))), ("d", field(5, alert))))
    (tmp_path / "one.pb").write_bytes(field(1, field(1, "2.0")) + feed)
    (tmp_path / "bad.pb").write_bytes(b"\x0f\xff\xff")
    got = gtfs_rt.read(spark.read.format("binaryFile").load(str(tmp_path))).collect()
    by = lambda k: [r for r in got if r.kind == k]
    assert [(r.stop_id, r.stop_sequence, r.delay_s) for r in by("delay")] == [("s3", 3, -30), (None, 6, 90)]
    assert [r.stop_id for r in by("skipped")] == ["s4"] and [r.trip_id for r in by("cancelled")] == ["t2"]
    assert [(r.lat, r.lon, r.ts) for r in by("vehicle")] == [(50.5, 4.25, 99)]
    assert {(r.route_id, r.stop_id, r.header, r.period_start, r.period_end) for r in by("alert")} == {("r1", None, "hello", 100, None), (None, "s3", "hello", 100, None)}


def test_json_passages(spark):
    raw = '{"results":[{"pointid":"8","lineid":"1","passingtimes":"[{\\"expectedArrivalTime\\":\\"2024-01-01T10:00:00+00:00\\",\\"lineId\\":\\"1\\"}]"}]}'
    got = gtfs_rt.passages(spark.createDataFrame([(raw,)], "value string")).collect()
    assert len(got) == 1 and got[0].pointid == "8" and got[0].expected.hour == 10
    raw = '{"results":[{"lineid":"1","vehiclepositions":"[{\\"directionId\\":\\"9\\",\\"pointId\\":\\"8\\",\\"distanceFromPoint\\":12}]"}]}'
    assert [tuple(r) for r in gtfs_rt.positions(spark.createDataFrame([(raw,)], "value string")).collect()] == [("1", "9", "8", 12.0)]


def test_street_extract(spark, tmp_path):
    zig = lambda v: v << 1 ^ v >> 63
    deltas = lambda xs: b"".join(varint(zig(b - a)) for a, b in zip([0, *xs], xs, strict=False))
    packed = lambda xs: b"".join(map(varint, xs))
    strings = b"".join(field(1, s) for s in ("", "highway", "residential", "type", "route", "bicycle"))
    dense = field(2, field(1, deltas([10, 11, 12])) + field(8, deltas([500000000, 500010000, 500020000])) + field(9, deltas([40000000, 40000000, 40010000])) + field(10, packed([1, 2, 0, 0, 0])))
    way = field(3, field(1, 7) + field(2, packed([1])) + field(3, packed([2])) + field(8, deltas([10, 11, 12])))
    relation = field(4, field(1, 8) + field(2, packed([3, 4])) + field(3, packed([4, 5])) + field(8, packed([0])) + field(9, deltas([7])) + field(10, packed([1])))
    block = field(1, strings) + field(2, dense) + field(2, way) + field(2, relation)
    blob = field(2, len(block)) + field(3, zlib.compress(block))
    header = field(1, "OSMData") + field(3, len(blob))
    (tmp_path / "x.osm.pbf").write_bytes(struct.pack(">I", len(header)) + header + blob)
    found = osm.read(spark.read.format("binaryFile").load(str(tmp_path))).cache()
    assert [(r.id, round(r.lat, 6), r.tags) for r in found.where("kind = 'node'").orderBy("id").collect()][0] == (10, 50.0, {"highway": "residential"})
    assert [(r.a, r.b, round(r.lat2, 6), r.tags["highway"]) for r in osm.segments(found).orderBy("seq").collect()] == [(10, 11, 50.001, "residential"), (11, 12, 50.002, "residential")]
    assert [r.way for r in osm.cycle_route_ways(found).collect()] == [7]


def test_timetable_feed(spark, tmp_path):
    files = {
        "stops": "stop_id,stop_name,stop_lat,stop_lon\na,A,50.0,4.0\nb,B,50.1,4.0\nc,,50.2,4.0\nd,D,,4.0\n",
        "trips": "trip_id,route_id,service_id,bikes_allowed\nt,r,s,1\nu,r,x,\n",
        "stop_times": "trip_id,stop_id,stop_sequence,arrival_time,departure_time\nt,b,20,25:00:00,25:01:00\nt,a,10,24:00:00,24:00:30\nu,a,1,08:00:00,\n",
        "calendar": "service_id,monday,tuesday,wednesday,thursday,friday,saturday,sunday,start_date,end_date\ns,1,1,0,0,0,0,1,20240101,20240131\n",
        "calendar_dates": "service_id,date,exception_type\ns,20240102,2\nx,20240105,1\n",
    }
    for name, body in files.items():
        (tmp_path / f"{name}.txt").write_text(body)
    d = str(tmp_path)
    assert [r.stop_id for r in gtfs.stops(spark, d).orderBy("stop_id").collect()] == ["a", "b"]
    got = gtfs.stop_times(spark, d).where("trip_id = 't'").orderBy("pos").collect()
    assert [(r.pos, r.stop_id, r.arr, r.dep) for r in got] == [(0, "a", 86400, 86430), (1, "b", 90000, 90060)]
    s = {r.svc: r for r in gtfs.services(spark, d).collect()}
    assert (s["s"].days, s["s"].start, s["s"].removed) == (67, 8766, [8767]) and (s["x"].days, s["x"].added) == (0, [8770])
    assert {r.trip_id: r.bikes for r in gtfs.bikes_allowed(spark, d).collect()} == {"t": True, "u": None}
    read = lambda: gtfs.content_hash(spark.read.format("binaryFile").load(d))
    before = read()
    (tmp_path / "stops.txt").write_text(files["stops"] + "e,E,50,4\n")
    assert read() != before


def test_postcodes(spark, tmp_path):
    codes = ("<code><namespace>n</namespace><objectIdentifier>1000</objectIdentifier></code>", "<code><objectIdentifier>4000</objectIdentifier></code>", "<code><namespace>n</namespace></code>", "")
    (tmp_path / "p.xml").write_text("<all>" + "".join(f"<postalInfo>{c}<name>x</name></postalInfo>" for c in (*codes, codes[0])) + "</all>")
    rows = register.read(spark, str(tmp_path), "code struct<namespace:string,objectIdentifier:string>, name string", "postalInfo")
    assert sorted(map(tuple, register.postcodes(rows).collect())) == [("", "4000"), ("n", "1000")]


def test_register(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<all>" + "".join(f"<address><street_id>{s}</street_id><town_id>t</town_id><house>1</house><pos>{p}</pos></address>" for s, p in (("s", "10 20"), ("s", "0 0"), ("s", "x"), ("z", "10 20"), ("s", "1000 20"))) + "</all>")
    rows = register.read(spark, str(tmp_path), "street_id string, town_id string, house string, pos string")
    names = register.names(spark.createDataFrame([("s", "Rue", "fr"), ("s", "Straat", "nl")], "id string, name string, lang string"))
    assert names.first().display == "Rue" and names.first().aliases == ["Rue", "Straat"]
    towns = spark.createDataFrame([("t", "Town")], "id string, display string")
    kept, dropped = register.addresses(rows, names, towns, (1, 1, 100, 100))
    assert kept.count() == 1 and {r.reason: r["count"] for r in dropped.collect()} == {"origin": 1, "no_position": 1, "no_street": 1, "outside": 1}


def test_snapshot(spark, tmp_path):
    folder = str(tmp_path / "snap")
    snapshot.save(spark, folder, {"t": spark.range(3)}, "one")
    assert snapshot.load(spark, folder, "one")["t"].count() == 3
    snapshot.save(spark, folder, {"t": spark.range(5)}, "two")
    assert snapshot.load(spark, folder, "two")["t"].count() == 5
    with pytest.raises(snapshot.Stale):
        snapshot.load(spark, folder, "one")


def test_raster(spark):
    points = spark.createDataFrame([(1, 50.797815, 4.359215833333333), (2, 0.0, 0.0)], "point int, lat double, lon double")
    cells = spark.createDataFrame([(0, 0, 0, None), (1, 0, 0, 7.0)], "layer int, row long, col long, height double")
    got = {r.point: r.height for r in raster.elevations(points, cells, 649300.0, 665300.0, 100.0).collect()}
    assert got == {1: 7.0, 2: None}
    heights = spark.createDataFrame([(1, 0, 1.0), (1, 1, 3.6), (2, 0, 1.0), (2, 1, None)], "way int, seq int, height double")
    assert {(r.way, r.delta) for r in raster.segment_climbs(heights).collect()} == {(1, 3), (2, 0)}


def test_streams(spark, tmp_path):
    rows = [(100, 1, 5, 0, 30, "delay"), (200, 2, 5, 0, 60, "delay"), (150, 3, 5, 1, 10, "delay"), (160, 4, 5, 2, 0, "skipped")]
    schema = "ts long, event_id long, trip long, pos int, delay_s int, kind string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    sticky = live.sticky_delays(source).writeStream.format("memory").queryName("sticky").outputMode("update").option("checkpointLocation", str(tmp_path / "c1")).start()
    sticky.processAllAvailable()
    sticky.stop()
    assert {(r.trip, r.pos, r.delay_s, r.ts) for r in spark.table("sticky").collect()} == {(5, 0, 60, 200), (5, 1, 10, 150)}
    times = spark.createDataFrame([(5, 0, 1, p, p, 100, 100) for p in range(4)], "trip long, line int, svc int, pos int, stop long, arr int, dep int")
    live.publish(source, times, str(tmp_path / "out"), str(tmp_path / "c2")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("pos").collect()
    assert [(r.delay_s, r.skipped) for r in got] == [(60, False), (10, False), (None, True), (None, False)]
    more = [(300, 5, 5, 1, 99, "delay")]
    spark.createDataFrame(more, schema).write.mode("append").parquet(str(tmp_path / "in"))
    live.publish(source, times, str(tmp_path / "out"), str(tmp_path / "c2")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).where("batch = 1").orderBy("pos").collect()
    assert [(r.delay_s, r.skipped) for r in got] == [(60, False), (99, False), (None, True), (None, False)]  # what the first batch told stays
    windows = live.windowed_delays(source).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c3")).start()
    windows.awaitTermination(120)
    assert spark.table("windows").agg(F.sum("n")).first()[0] == 5
