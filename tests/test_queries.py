import os

import pytest
from oracle import DATA, compare, connection

from wayfold import plans

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_equals_its_sql(spark, con, name):
    compare(spark, con, plans.QUERIES[name], plans.ORACLES[name])


def test_shares_of_odd_events_equal_their_sql(spark, tmp_path, monkeypatch):
    """Lengths below zero and times that are null."""
    import duckdb
    import oracle

    lengths = [(1, 1, -3), (2, 1, 3), (51, 21, 5), (103, 2, -1), (104, 2, 129), (153, 22, 128)]  # over zero, and a half of the sixth place
    events = [(e, e, user, value) for e, user, value in lengths]
    events += [(e, None if e == 205 else e, 3, e - 190) for e in range(205, 217)] + [(e, e, 23, e - 240) for e in range(255, 267)]
    rows = ", ".join(f"({e}, {'null' if t is None else f'make_timestamp({t * 1000000})'}, {user}, 'view', {value}::double, '{{}}')" for e, t, user, value in events)
    duckdb.sql(f"copy (select * from (values {rows}) t(event_id, ts, user_id, event_type, value, props)) to '{tmp_path}/events.parquet'")
    duckdb.sql(f"copy (select i as s_suppkey, 's' as s_name, 0 as s_nationkey, 0.0 as s_acctbal from range(50) r(i)) to '{tmp_path}/supplier.parquet'")
    for name in ("orders", "customer"):
        os.symlink(f"{DATA}/{name}.parquet", f"{tmp_path}/{name}.parquet")
    monkeypatch.setattr(oracle, "DATA", str(tmp_path))
    compare(spark, connection(), plans.QUERIES["shared_path_share"], plans.ORACLES["shared_path_share"])
    got = {(r.p, r.q): r.share for r in plans.QUERIES["shared_path_share"](spark, str(tmp_path)).collect()}
    assert got[100, 2100] == float("-inf") and got[200, 2200] == -0.007813 and (301, 2300) in got


def test_chains_never_overtake(spark):
    from pyspark.sql import functions as F

    from wayfold.plans import network as net

    chains = plans.QUERIES["overtaking_split"](spark, DATA)
    times = net.stop_times(spark, DATA).join(chains, ["line", "trip"]).groupBy("line", "chain", "trip").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "dep"))), lambda x: x["dep"]).alias("deps")).collect()
    by = {}
    for r in times:
        by.setdefault((r.line, r.chain), []).append(r.deps)
    for trips in by.values():
        trips.sort()
        assert all(a <= b for x, y in zip(trips, trips[1:], strict=False) for a, b in zip(x, y, strict=True))


def test_representatives_begin_with_the_best_of_each_axis(spark):
    from wayfold.plans.schedule_queries import _vectors

    rows = {}
    for r in _vectors(spark, DATA).collect():
        rows.setdefault(r.grp, []).append(r)
    for r in plans.QUERIES["representatives_k"](spark, DATA).where("rank = 0").collect():
        own = {x.vec_id: x.a0 for x in rows[r.grp]}
        assert own[r.vec_id] == min(own.values())


def test_entry():
    import sys
    from pathlib import Path

    sys.path.insert(0, str(Path(__file__).parents[1]))
    import __spark_entry__ as entry

    assert set(plans.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
