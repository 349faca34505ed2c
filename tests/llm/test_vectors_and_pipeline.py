import sys
from pathlib import Path

import numpy as np
import pytest
from llm_fixtures import DOCS, components, documents
from pyspark.sql import functions as F

from wayfold.llm import common, eps_grid, golay
from wayfold.llm import components as component_search
from wayfold.llm.components import components as distributed

sys.path.insert(0, str(Path(__file__).parents[2]))


def vectors(seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, 8))
    x = [(centres[i % 5] + rng.normal(size=8) * rng.choice([0.02, 0.3, 1.5])).astype(np.float32).tolist() for i in range(150)]
    x += [x[0], x[0], (np.array(x[3]) * 2).tolist(), None, [], [0.0] * 8, [float("nan")] * 8, [1.0] * 7 + [float("inf")], [None] * 8, [1.0, 2.0]]
    return [(i * 2 + 1, v, 0) for i, v in enumerate(x)]


@pytest.mark.parametrize("piece,block", [(256, 2048), (4, 16)])
def test_vectors(spark, monkeypatch, piece, block):
    monkeypatch.setattr(eps_grid, "PIECE", piece)
    monkeypatch.setattr(eps_grid, "BLOCK", block)
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("x", F.lit(1)).repartition(3)
    fine = [v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v) for _, v, _ in rows]

    def close(i, j):
        a, b = rows[i][1], rows[j][1]
        if not (fine[i] and fine[j] and len(a) == len(b)):
            return False
        a, b = np.array(np.float32(a), float), np.array(np.float32(b), float)
        return a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.95

    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if close(i, j)]
    roots = components(len(rows), pairs)
    links = [0] * len(rows)
    for i, j in pairs:
        links[i] += 1
        links[j] += 1
    want = {r[0]: (n, rows[k][0], r[0] == rows[k][0]) for r, n, k in zip(rows, links, roots, strict=True)}
    assert pairs and {r.vec_id: tuple(r)[1:] for r in eps_grid.near_duplicates(df).collect()} == want
    if block == 2048:
        assert eps_grid.near_duplicates(df.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n) if i != 150] + [(7, 7), (3, 4)], "u long, v long").repartition(5)
    got = {r.node: r.root for r in distributed(edges).collect()}
    assert got == {i: 0 if i <= 150 else 151 for i in range(n + 1) if i not in (0, 151)}
    assert distributed(edges.limit(0)).count() == 0


def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = np.random.default_rng(0)
    rows = documents(3)
    ids = [r[0] for r in rows]
    spark.createDataFrame(rows, DOCS).repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in ids if rng.random() < 0.5], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in pipeline.STAGES] == ["quality_filter", "exact_dedup", "simhash_dedup", "pii_redaction", "best_fit_packing"]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in pipeline.STAGES[:-1]:
        after = stage(spark, before, str(tmp_path))
        assert after.columns == columns, name
        assert {r.doc_id for r in after.select("doc_id").collect()} <= {r.doc_id for r in before.select("doc_id").collect()}
        path = f"{tmp_path}/{name}"
        after.write.parquet(path)
        before = spark.read.parquet(path)
    assert "@f.gh" not in " ".join(r.text or "" for r in before.collect())
    steps = pipeline.STAGES[-1][1](spark, before, str(tmp_path))
    assert {r.doc_id for r in steps.collect()} == {r.doc_id for r in before.collect()}
    whole = pipeline.run(spark, str(tmp_path))
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, whole.select(key).collect())) == sorted(map(tuple, steps.select(key).collect()))


def test_near_copies_of_the_pipeline_send_no_keys_through_the_driver(spark, tmp_path, monkeypatch):
    pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame(documents(3), DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    plans, found = [], golay.components

    def seen(links):
        plans.append(links._jdf.queryExecution().executedPlan().toString())
        return found(links)

    monkeypatch.setattr(golay, "components", seen)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = dict(pipeline.STAGES)["simhash_dedup"](spark, docs, str(tmp_path))
    assert 0 < kept.count() <= docs.count()
    assert len(plans) == 1 and "Join" in plans[0] and "Broadcast" not in plans[0]


def test_near_dedup_broadcasts_nothing_that_grows_with_the_documents(spark, tmp_path, monkeypatch):
    """Every job of the pipeline's third stage, the rounds of the search for components included, whatever Spark takes for small."""
    pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame(documents(3), DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    plans, store = [], golay.stored

    def seen(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return store(df, label)

    monkeypatch.setattr(golay, "stored", seen)
    monkeypatch.setattr(component_search, "stored", seen)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = dict(pipeline.STAGES)["simhash_dedup"](spark, docs, str(tmp_path))
    plans.append(kept._jdf.queryExecution().executedPlan().toString())
    assert not [p for p in plans if "Broadcast" in p]
    assert len([p for p in plans if "Union" in p and "SortMergeJoin" in p]) >= 2  # rounds were seen
    assert 0 < kept.count() <= docs.count()
    named = golay.near_duplicates(docs)
    assert "Broadcast" not in named._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("most", [100_000, 0])
def test_near_dedup_sorts_texts_only_where_rows_are_repeated(spark, monkeypatch, most):
    """A sort holds texts in a task's memory. Rows that stay are hashed if a task gets few of them; either way the rows are the same."""
    monkeypatch.setattr(common, "HASHED_ROWS", most)
    once = list({(r[0], r[1]): r for r in documents(3)}.values())
    known = [r for r in once if r[0] is not None]
    for rows, repeated in ((once, False), (once + known[:1] * 20, True)):
        kept = golay.near_dedup(spark.createDataFrame(rows, DOCS).repartition(3))
        plan = kept._jdf.queryExecution().executedPlan().toString()
        texts = [line for line in plan.splitlines() if "SortAggregate" in line and "text#" in line]
        assert bool(texts) == repeated
        assert ("ShuffledHashJoin" in plan) == (not repeated and most > 0)
        got = sorted(map(repr, kept.collect()))
        if repeated:
            assert got == before and len(got) < len(once)
        before = got


def test_stages_read_few_texts_at_once(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    key = "spark.sql.parquet.columnarReaderBatchSize"
    spark.createDataFrame(documents(3), DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in pipeline.STAGES:
        spark.conf.set(key, "4096")
        stage(spark, docs, str(tmp_path))
        assert int(spark.conf.get(key)) == common.READ_ROWS
    spark.conf.set(key, "7")  # less is left as it is
    pipeline.STAGES[1][1](spark, docs, str(tmp_path))
    assert spark.conf.get(key) == "7"
    spark.conf.unset(key)
