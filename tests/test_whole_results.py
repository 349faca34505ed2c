"""Queries over all rows where small results could hide a subset, against brute force."""

import os

import pytest
from oracle import DATA

from wayfold import plans

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_an_odd_line_is_ridden(spark, tmp_path):
    spark.createDataFrame([(k, f"s{k}", 0) for k in range(15)], "s_suppkey long, s_name string, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(1, 1, "1-URGENT")], "o_orderkey long, o_custkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.stop: r.arr for r in plans.QUERIES["overnight_union"](spark, str(tmp_path)).collect()}
    assert got[2] == 10800 + 720  # on foot
    assert (got[5], got[8]) == (18397, 18697)  # by line 1, from stop 2 at 18117
    assert got[14] == 18397 + 720  # on foot from stop 5, before the trip gets there


def _fixpoint(stop_times, walks, seeds):
    """request, stop: arr by rounds over plain lists until nothing improves; and how many rounds did."""
    trips = {}
    for trip, pos, stop, arr, dep in sorted(stop_times):
        trips.setdefault(trip, []).append((stop, arr, dep))
    out, most = {}, 0
    for request, origin, start in seeds:

        def walked(labels):
            got = dict(labels)
            for f, t, w in walks:
                if f in labels:
                    got[t] = min(got.get(t, 10**9), labels[f] + w)
            return got

        best, rounds = walked({origin: start}), 0
        while True:
            got = {}
            for stops in trips.values():
                on = False
                for stop, arr, dep in stops:
                    if on:
                        got[stop] = min(got.get(stop, 10**9), arr)
                    on = on or stop in best and best[stop] <= dep
            better = {s: a for s, a in walked(got).items() if a < best.get(s, 10**9)}
            if not better:
                break
            best, rounds = best | better, rounds + 1
        most = max(most, rounds)
        out |= {(request, s): a for s, a in best.items()}
    return out, most


def test_fixpoint_of_all_requests(spark):
    from wayfold.plans import network as net

    times = [tuple(r) for r in net.active_stop_times(spark, DATA).select("trip", "pos", "stop", "arr", "dep").collect()]
    walks = [tuple(r) for r in net.transfers(spark, DATA).select("f", "t", "w").collect()]
    seeds = [tuple(r) for r in net.requests(spark, DATA).select("request", "origin", "start").collect()]
    got = {(r.request, r.stop): r.arr for r in plans.QUERIES["earliest_arrival_fixpoint"](spark, DATA).collect()}
    assert got == _fixpoint(times, walks, seeds)[0]


def test_fixpoint_takes_as_many_boardings_as_it_needs(spark):
    """A chain of trips of one hop each."""
    from wayfold.operators import search

    hops = [(k, 0, k, 1000 * k, 1000 * k + 20) for k in range(25)] + [(k, 1, k + 1, 1000 * k + 500, 1000 * k + 520) for k in range(25)]
    want, rounds = _fixpoint(hops, [], [(0, 0, 0)])
    assert rounds == 25
    times = spark.createDataFrame([(t, 0, 1, pos, stop, arr, dep) for t, pos, stop, arr, dep in hops], "trip long, line int, svc int, pos int, stop long, arr int, dep int")
    seeds = spark.createDataFrame([(0, 0, 0)], "request long, stop long, arr int")
    none = spark.createDataFrame([], "f long, t long, w int")
    assert {(r.request, r.stop): r.arr for r in search.earliest_arrival(seeds, times, none, rounds=None).collect()} == want


def test_highlights_by_aggregates_equal_those_of_arrays(spark):
    from pyspark.sql import functions as F

    from wayfold.functions import bike
    from wayfold.operators import itinerary

    w = {"time": 1.0, "ascent": 0.5, "surface": 0.7}
    rows = [(k % 7, k, (k * 37) % 11 + (200 if k % 7 == 3 else 0), (k * 53) % 5, (k * 29) % 3) for k in range(300)] + [(9, 1, 5, 5, 5), (9, 1, 5, 5, 5)]
    options = spark.createDataFrame(rows, "grp long, vec_id long, time int, ascent int, surface int")
    arrays = options.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("vec_id", *w))).alias("o"))
    for window in (4, 60):
        want = arrays.select("grp", bike.balanced(F.col("o"), w), bike.within(F.col("o"), F.lit(window), w)).collect()
        assert sorted(map(tuple, itinerary.highlight(options, "grp", "vec_id", w, window).collect())) == sorted(map(tuple, want))


def test_streets_below_the_first_million_hits_stay(spark, monkeypatch):
    from pyspark.sql import functions as F

    from wayfold.plans import places_queries

    n = 1_000_000
    street = F.when(F.col("id") < n, "main").otherwise("mainly").alias("street")
    records = spark.range(n + 1).select(F.col("id").alias("record"), street, F.lit("town").alias("municipality"), F.lit("1").alias("house"), F.lit(50.0).alias("lat"), F.lit(4.0).alias("lon"))
    monkeypatch.setattr(places_queries, "_records", lambda spark, d: records)
    monkeypatch.setattr(places_queries, "_queries", lambda spark: spark.createDataFrame([(1, "main")], "query long, text string"))
    got = {(r.street, r.record) for r in plans.QUERIES["street_collapse"](spark, DATA).collect()}
    assert got == {("main", 0), ("mainly", n)}
