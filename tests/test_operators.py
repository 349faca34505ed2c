import itertools
import random

from pyspark.sql import functions as F

from wayfold.functions import fares, geo, street, text
from wayfold.operators import greedy, isochrone, pareto, realtime, schedule, search, streets

ST = "trip long, line int, svc int, pos int, stop long, arr int, dep int"


def network(spark, seed=0):
    """Random trips over ten stops, and walks."""
    rng = random.Random(seed)
    rows = []
    for trip in range(40):
        at, stops = rng.randint(28000, 33000), rng.sample(range(10), 5)
        for pos, stop in enumerate(stops):
            rows.append((trip, trip % 5, 1, pos, stop, at, at + 20))
            at += rng.randint(100, 900)
    walks = [(a, b, rng.randint(60, 400)) for a, b in itertools.permutations(range(10), 2) if rng.random() < 0.1]
    return rows, walks, spark.createDataFrame(rows, ST), spark.createDataFrame(walks, "f long, t long, w int")


def brute_arrivals(rows, walks, origin, start, rounds):
    by_trip = {}
    for r in rows:
        by_trip.setdefault(r[0], []).append(r)

    def walk(labels):
        out = dict(labels)
        for a, b, w in walks:
            if a in labels:
                out[b] = min(out.get(b, 10**9), labels[a] + w)
        return out

    best = walk({origin: start})
    for _ in range(rounds):
        got = {}
        for stops in by_trip.values():
            for r in stops:
                if r[4] in best and best[r[4]] <= r[6]:
                    for x in stops:
                        if x[3] > r[3]:
                            got[x[4]] = min(got.get(x[4], 10**9), x[5])
        got = walk(got)
        best = {s: min(best.get(s, 10**9), got.get(s, 10**9)) for s in {*best, *got}}
    return best


def test_search_equals_brute_force(spark):
    rows, walks, times, transfers = network(spark)
    seed = spark.createDataFrame([(0, 0, 28000), (1, 3, 29000)], "request long, stop long, arr int")
    for rounds in (None, 2):
        got = search.earliest_arrival(seed, times, transfers, rounds).collect()
        for request, origin, start in ((0, 0, 28000), (1, 3, 29000)):
            assert {r.stop: r.arr for r in got if r.request == request} == brute_arrivals(rows, walks, origin, start, rounds or 10)
    paths = search.journeys(seed, times, transfers, 2).collect()
    assert {(r.request, r.stop): r.arr for r in paths} == {(r.request, r.stop): r.arr for r in got}
    for r in paths:  # each path leads from the origin to the stop and is in time
        at = 0 if r.request == 0 else 3
        for leg in filter(None, r.path.split("|")):
            kind, *x = leg.split(" ")
            a, b = (x[1], x[3]) if kind == "R" else (x[0], x[1])
            assert int(a) == at
            at = int(b)
        assert at == r.stop


def test_who_waits_five_hours_is_boarded(spark):
    """The only departure is five hours off; another trip leaves sooner and comes later, so nobody takes it."""
    rows = [(1, 0, 1, 0, 0, 46000, 46000), (1, 0, 1, 1, 1, 47000, 47020), (2, 0, 1, 0, 0, 30000, 30000), (2, 0, 1, 1, 1, 48000, 48000), (3, 0, 1, 0, 1, 47020, 47020), (3, 0, 1, 1, 2, 90000, 90000)]
    times, none = spark.createDataFrame(rows, ST), spark.createDataFrame([], "f long, t long, w int")
    seed = spark.createDataFrame([(0, 0, 28000)], "request long, stop long, arr int")
    assert {r.stop: r.arr for r in search.earliest_arrival(seed, times, none, 2).collect()} == {0: 28000, 1: 47000, 2: 90000}
    assert {r.stop: r.path for r in search.journeys(seed, times, none, 2).collect()}[2] == "R 1 0 46000 1 47000|R 3 1 47020 2 90000"
    target = spark.createDataFrame([(0, 2, 95000)], "request long, stop long, dep int")
    assert {r.stop: r.dep for r in search.latest_departure_backward(target, times, none, 2).collect()} == {2: 95000, 1: 47020, 0: 46000}


def test_trips_of_other_days_are_not_boarded(spark):
    from wayfold.plans import network as net

    svc = {r.svc for r in net.active_stop_times(spark, "/root/testdata/sf0.001").select("svc").distinct().collect()}
    assert svc == {1, 2, 4}  # a Wednesday: every day, weekdays, and Monday, Wednesday and Friday
    svc = {r.svc for r in net.active_stop_times(spark, "/root/testdata/sf0.001", net.QUERY_DAY + 1).select("svc").distinct().collect()}
    assert svc == {2, 3}  # service 1 is removed, 3 added


def test_an_empty_overlay_is_the_schedule(spark):
    _, _, times, _ = network(spark)
    none = spark.createDataFrame([], "trip long, pos int, ts long, event_id long, delay_s int, kind string")
    assert sorted(realtime.overlay(times, none).collect()) == sorted(times.collect())


def test_adding_a_trip_never_makes_arrivals_later(spark):
    _, _, times, transfers = network(spark)
    seed = spark.createDataFrame([(0, 0, 28000)], "request long, stop long, arr int")
    more = times.unionByName(spark.createDataFrame([(99, 1, 1, 0, 0, 28100, 28120), (99, 1, 1, 1, 7, 28200, 28220)], ST))
    before = {r.stop: r.arr for r in search.earliest_arrival(seed, times, transfers, 2).collect()}
    after = {r.stop: r.arr for r in search.earliest_arrival(seed, more, transfers, 2).collect()}
    assert all(after[s] <= a for s, a in before.items()) and after[7] <= 28200


def test_forward_fill_stops_at_a_skip(spark):
    times = spark.createDataFrame([(1, 0, 1, p, p, 100 * p, 100 * p) for p in range(5)], ST)
    live = spark.createDataFrame([(1, 1, 60, "delay"), (1, 3, None, "skipped")], "trip long, pos int, delay_s int, kind string")
    got = realtime.forward_fill(times, live).orderBy("pos").collect()
    assert [(r.delay_s, r.skipped) for r in got] == [(None, False), (60, False), (60, False), (None, True), (None, False)]


def test_fronts(spark):
    rng = random.Random(1)
    rows = [(i, i % 3, rng.randint(0, 9), rng.randint(0, 9), rng.randint(0, 9)) for i in range(90)]
    df = spark.createDataFrame(rows, "id int, g int, a int, b int, c int")

    def beaten(r, axes):
        return any(x[1] == r[1] and all(x[k] <= r[k] for k in axes) and any(x[k] < r[k] for k in axes) for x in rows)

    assert {r.id for r in pareto.front(df, ["g"], ["a", "b", "c"]).collect()} == {r[0] for r in rows if not beaten(r, (2, 3, 4))}
    assert {(r.g, r.a, r.b) for r in pareto.front_2d(df, ["g"], "a", "b").collect()} == {(r[1], r[2], r[3]) for r in rows if not beaten(r, (2, 3))}
    told = {r.id: r.dominated_by for r in pareto.dominators(df, ["g"], ["a", "b", "c"], "id").collect()}
    assert {i for i, by in told.items() if by is None} == {r[0] for r in rows if not beaten(r, (2, 3, 4))}


def test_departures_are_an_as_of_join(spark):
    rows, _, times, _ = network(spark, 4)
    rng = random.Random(5)
    asked = [(i, rng.randint(0, 10), rng.randint(27000, 36000)) for i in range(30)]
    df = spark.createDataFrame(asked, "request long, stop long, time int")
    for after in (True, False):
        got = {}
        for r in schedule.departures(times, df, 3, after).collect():
            got.setdefault(r.request, []).append((r["rank"], r.trip, r.dep))
        for i, stop, time in asked:
            own = sorted(((r[6], r[0]) for r in rows if r[4] == stop and (r[6] >= time) == after), reverse=not after)[:3]
            assert [(t, d) for _, t, d in sorted(got.get(i, []))] == [(t, d) for d, t in own]


def test_shortest_equals_dijkstra(spark):
    rng = random.Random(2)
    edges = [(a, b, rng.randint(1, 50), a == 7) for a, b in itertools.permutations(range(15), 2) if rng.random() < 0.15]
    got = streets.shortest(spark.createDataFrame([(0, 0, 0)], "request long, node long, seconds int"), spark.createDataFrame(edges, "a long, b long, w int, sink boolean"), 120).collect()
    best = {0: 0}
    for _ in range(20):
        for a, b, w, sink in edges:
            if a in best and not sink and best[a] + w <= 120:
                best[b] = min(best.get(b, 10**9), best[a] + w)
    assert {r.node: r.seconds for r in got} == best


def test_window_departures_end_with_the_end():
    assert isochrone.window_departures(0, 1500) == [0, 600, 1200, 1500]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_functions(spark):
    lit = F.lit
    assert one(spark, text.box_reference(lit("Kerkstraat 5 bus 12"))["box"]) == "12"
    assert one(spark, text.box_reference(lit("bus 12 Kerkstraat"))["box"]) is None
    assert one(spark, text.harmonise(lit("GARE DE LOUVAIN XIV"))) == "Gare de Louvain XIV"
    assert one(spark, text.clock(lit(90061))) == "25:01:01"
    assert one(spark, text.same_box(lit("007"), lit("7"))) is True
    assert one(spark, text.normalise(lit("  Été--à la MER! "))) == "ete a la mer"
    assert abs(one(spark, geo.inverse_normal(lit(0.975))) - 1.959964) < 1e-5 and abs(one(spark, geo.inverse_normal(lit(0.001))) + 3.090232) < 1e-5
    assert [one(spark, fares.bracket_km(lit(k), fares.Bracketed())) for k in (1.0, 30.4, 39.7, 62.0, 200.0)] == [3, 30, 41, 63, 118]
    assert one(spark, street.surface_percent(lit("mud"))) == 20 and one(spark, street.surface_percent(lit(None).cast("string"))) == 90
    assert one(spark, geo.advance(F.array(F.struct(lit(50.0).alias("lat"), lit(4.0).alias("lon")), F.struct(lit(50.1).alias("lat"), lit(4.0).alias("lon"))), lit(1e9)))["lat"] == 50.1


def test_profile_keeps_peaks(spark):
    heights = [0.0, 1.0, 0.5, 30.0, 0.2, 0.1]
    df = spark.createDataFrame([(1, i, i * 10.0, h) for i, h in enumerate(heights)], "way long, seq int, along double, height double")
    got = [r.height for r in greedy.smooth_profile(df).orderBy("seq").collect()]
    assert got[0] == 0.0 and got[3] == 30.0 and got[5] == 0.1 and got[1] != 1.0


def test_shares_of_paths_without_length(spark):
    rows = [(0, 1, 10, 0), (0, 2, 10, 5), (0, 3, 10, 0), (0, 3, 11, 4), (0, 4, 12, 0), (0, 5, 12, 0), (0, 6, 13, 3), (0, 7, 13, 0), (1, 2, 10, 3), (1, 3, 10, 2)]
    got = {(r.p, r.q): r.share for r in streets.shared_share(spark.createDataFrame(rows, "grp long, path long, edge long, metres int")).collect()}
    nan = {k for k, v in got.items() if v != v}
    assert nan == {(1, 2), (1, 3), (4, 5)}  # nothing of nothing
    assert {k: v for k, v in got.items() if k not in nan} == {(2, 3): 8 / 6, (6, 7): float("inf")}


def test_alerts_of_legs_by_brute_force(spark):
    rng = random.Random(4)
    some = lambda n: None if rng.random() < 0.1 else rng.randrange(n)
    legs = [(some(40), some(6), some(4), some(5), some(5), rng.choice([10, 20, None])) for _ in range(60)]
    legs += legs[:5] + [(50 + k, 1, 2, 3, 3, 10) for k in range(5)]
    alerts = [(some(30), rng.choice(["trip", "route", "stop"]), some(6), some(25), some(40)) for _ in range(80)]
    alerts += alerts[:5]
    want = {
        (leg, alert)
        for leg, trip, line, board, alight, now in legs
        for alert, kind, entity, begin, end in alerts
        if entity is not None and (kind, entity) in {("trip", trip), ("route", line), ("stop", board), ("stop", alight)}
        and (begin is None or now is not None and begin <= now) and (end is None or now is not None and now < end)
    }
    found = realtime.alerts_for_legs(
        spark.createDataFrame(alerts, "alert long, kind string, entity long, from long, to long"), spark.createDataFrame(legs, "leg long, trip long, line int, board long, alight long, now int")
    )
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


def test_pairs_of_legs_and_alerts_are_not_shuffled(spark, tmp_path):
    legs = spark.range(4000).select(F.col("id").alias("leg"), F.col("id").alias("trip"), (F.col("id") % 2).alias("line"), F.lit(1).alias("board"), F.lit(2).alias("alight"), F.lit(5).alias("now"))
    alerts = spark.range(300).select(F.col("id").alias("alert"), F.lit("route").alias("kind"), (F.col("id") % 2).alias("entity"), F.lit(None).cast("long").alias("from"), F.lit(None).cast("long").alias("to"))
    found = realtime.alerts_for_legs(alerts, legs)
    done = found._jdf.queryExecution()
    assert done.executedPlan().executeCollect() is not None

    def written(node):
        """Rows that each shuffle of a plan wrote."""
        name = node.nodeName()
        below = [node.children().apply(i) for i in range(node.children().length())]
        if name == "AdaptiveSparkPlan":
            below.append(node.executedPlan())
        if name.endswith("QueryStage"):
            below.append(node.plan())
        own = [node.metrics().apply("shuffleRecordsWritten").value()] if name == "Exchange" else []
        return own + [n for x in below for n in written(x)]

    rows = written(done.executedPlan())
    assert len(rows) > 2 and max(rows) < 4000 * 300 / 10
