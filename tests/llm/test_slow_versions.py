"""The learned operators against slow versions, and stages on rows that repeat, empty tables and clashing names."""

import math
import re
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from llm_fixtures import DOCS, documents, personal, written
from pyspark.sql import functions as F

from wayfold.llm import boosting, exact, golay, pii, quality

sys.path.insert(0, str(Path(__file__).parents[2]))


def slow_statistics(text):
    """The numbers of quality.statistics, one by one."""
    data = text.encode()
    if not data:
        return [0.0] * 26
    kind = lambda b: 0 if chr(b) in "abcdefghijklmnopqrstuvwxyz" else 1 if chr(b) in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else 2 if chr(b) in "0123456789" else 3 if b in (10, 13) else 4 if b in (9, 11, 12, 32) else 5 if chr(b) in ".,;:?'\"-()" else 7 if b > 127 else 6
    kinds, of, words, lines = Counter(map(kind, data)), Counter(data), data.split(), data.split(b"\n")
    n, size = max(1, len(words)), len(data)
    lengths = [len(w) for w in words] or [0]
    mean = sum(lengths) / len(lengths)
    out = [kinds[k] / size for k in range(8)]
    out += [max([c for b, c in of.items() if kind(b) == 6] or [0]) / size, of[33] / n, of[124] / n, math.log(1 + size), math.log(1 + len(words)), mean]
    out += [math.sqrt(sum((x - mean) ** 2 for x in lengths) / len(lengths)), math.log(1 + max(lengths)), len(set(words)) / n]
    follow = list(zip(words, words[1:], strict=False))
    out += [sum(a == b for a, b in follow) / n, len(set(follow)) / max(1, len(words) - 1), len(set(lines)) / len(lines), math.log(1 + size / len(lines))]
    out += [sum(w[:1].isupper() for w in words) / n, sum(w.isupper() for w in words) / n, kinds[5] / n]
    return [*out, -sum(c / size * math.log(c / size) for c in of.values()), math.log(1 + len(set(words)))]


def slow_margin(trees, row):
    total = trees.base
    for feature, threshold, leaf in zip(trees.feature, trees.threshold, trees.leaf, strict=True):
        node = 0
        while node < len(feature):
            node = 2 * node + 1 + int(row[feature[node]] > threshold[node])
        total += leaf[node - len(feature)]
    return total


def slow_fit(x, y, trees, depth, rate, bins):
    """Trees as lists, every split tried on every row."""
    share = min(max(sum(y) / len(y), 1e-3), 1 - 1e-3)
    margin, out = [math.log(share / (1 - share))] * len(y), []
    edges = [sorted(set(np.quantile([r[j] for r in x], np.linspace(0, 1, bins + 1)[1:-1]).tolist())) for j in range(len(x[0]))]
    for _ in range(trees):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        g, h = [a - b for a, b in zip(p, y, strict=True)], [a * (1 - a) for a in p]
        splits, node = {}, [0] * len(y)
        for _ in range(depth):
            for k in set(node):
                own = [i for i in range(len(y)) if node[i] == k]
                best = (1e-6, None)
                for j, cuts in enumerate(edges):
                    for cut in cuts:
                        left = [i for i in own if x[i][j] <= cut]
                        gl, hl = sum(g[i] for i in left), sum(h[i] for i in left)
                        gt, ht = sum(g[i] for i in own), sum(h[i] for i in own)
                        if hl < 1 or ht - hl < 1:
                            continue
                        gain = gl * gl / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt * gt / (ht + 1)
                        if gain > best[0] + 1e-9:
                            best = (gain, (j, cut))
                splits[k] = best[1]
            node = [2 * k + 1 + (splits[k] is not None and x[i][splits[k][0]] > splits[k][1]) for i, k in enumerate(node)]
        for k in set(node):
            own = [i for i in range(len(y)) if node[i] == k]
            step = -rate * sum(g[i] for i in own) / (sum(h[i] for i in own) + 1)
            for i in own:
                margin[i] += step
        out.append(list(margin))
    return out


def test_statistics_equal_slow_ones():
    texts = [t or "" for _, t, *_ in documents(5)] + ["Ab ab\nAb|! 12 é", "\n\n", "X" * 30]
    assert np.allclose(quality.statistics(texts), [slow_statistics(t) for t in texts], atol=1e-12)


def test_trees_equal_slow_ones():
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(60, 3)), 1)
    y = ((x[:, 0] + x[:, 1] * rng.random(60)) > 0.2).astype(float)
    trees = boosting.fit(x, y, trees=4, depth=2, rate=0.3, bins=8)
    assert np.allclose(trees.margin(x), [slow_margin(trees, r) for r in x])
    assert np.allclose(trees.margin(x), slow_fit(x.tolist(), y.tolist(), 4, 2, 0.3, 8)[-1])


def slow_features(g, found, before, after):
    before, after = before.lower(), after.lower()
    groups = [p for p in re.split("[^0-9]+", found) if p]
    sizes = [len(p) for p in groups] or [0]
    word = lambda words: bool(re.search(f"(?<![a-z])(?:{words})(?![a-z])", before))
    has = lambda p, t: bool(re.search(p, t))
    return [
        g, sum(map(len, groups)), len(found), len(groups), max(sizes), min(sizes), sizes[0], sizes[-1], "(" in found, "." in found, "-" in found, " " in found, has(r"^\(?0", found), has("^(?:19|20)[0-9]{2}(?:[^0-9]|$)", found), has("[A-Z]", found), has("^[A-Z]{2}[0-9]{2}", found),
        has(r"^[^0-9]*[0-9]{3}[^0-9]+[0-9]{2}[^0-9]+[0-9]{4}$", found), has(r"  |--|\.\.", found), word(pii.PHONE_WORDS), word(pii.ID_WORDS), word(pii.BANK_WORDS), word(pii.OTHER_WORDS), has("[$€£#/] ?\\Z", before), has(r"[:=] ?\Z", before), has(r"(?:my|me|us|our|his|her|their|your|am|is|on|at) \Z", before), has("[0-9]", before),
        has(rf"^ ?(?:{pii.UNITS})(?![a-z])", after), has("^[%/:]", after), has("[0-9]", after),
    ]


def slow_spans(spark, text):
    trees, limits = pii.model(spark)
    base = personal(text)
    rest = list(text)
    for a, _, _, b in base:
        rest[a:b] = "\0" * (b - a)
    rest, out = "".join(rest), list(base)
    for g, (kind, pattern) in enumerate(pii.GENERATORS):
        found = list(re.finditer(pattern, rest))
        for i, m in enumerate(found):
            a, b = found[i - 1].end() if i else 0, found[i + 1].start() if i + 1 < len(found) else len(rest)
            row = slow_features(g, m[0], rest[a : m.start()][-pii.CONTEXT :], rest[m.end() : b][: pii.CONTEXT])
            if slow_margin(trees, np.array(row, float)) >= limits[g]:
                out.append((m.start(), 4 + g, kind, m.end()))
    return out


def test_accepted_spans_equal_slow_ones(spark):
    texts = [t or "" for _, t, *_ in documents(7)] + [t for t, _, _ in pii._sentences(pii.TEST, 300)] + ["a.b@c.de 020 7946 0958 1.2.3.4, call 555-123-4567 iban DE44 5001 0517 5407 3249 31 ok", "call 0123456789\n" * 200]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: r.spans for r in pii.findings(df).collect()}
    want = {i: written(slow_spans(spark, t)) for i, t in enumerate(texts)}
    assert got == want
    assert any(re.search("number|run|code|iban", w) for w in want.values())


def test_precision_and_recall_on_words_never_seen(spark):
    precision, recall, proposed = pii.measured(spark)
    assert precision > 0.97 and recall > 0.75 and proposed > 0.9


def test_one_row_of_each_group_stays(spark):
    long = "one two three four five six seven eight nine ten"
    rows = [(2, long), (5, long), (5, "entirely other words stand here and none is shared with them"), (7, "x y z"), (7, "x y z"), (None, long), (None, long), (9, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("_id", "_sha", "fp", "root", "least", "stay", "_gone", "fingerprint")})
    for stage in (golay.near_dedup, exact.exact_dedup):
        kept = stage(docs)
        assert kept.columns == docs.columns
        assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter({(2, long): 1, rows[2]: 1, (7, "x y z"): 1, (8, ""): 1, (None, long): 2})
        assert stage(docs.limit(0)).count() == 0


def test_redaction_leaves_other_columns(spark):
    docs = spark.createDataFrame([(1, "mail a@b.cd now", 3, "z"), (2, None, 4, "y")], "doc_id int, text string, spans int, __base string")
    assert [tuple(r) for r in pii.redact(docs).orderBy("doc_id").collect()] == [(1, "mail [EMAIL] now", 3, "z"), (2, None, 4, "y")]


def test_stages_on_empty_tables_and_clashing_names(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    names = ("spans", "score", "__score", "fingerprint", "_text", "_id", "__text", "_norm", "part", "nth", "length", "a", "_keep")
    docs = spark.createDataFrame(documents(9, 40), DOCS).withColumns({c: F.lit(k) for k, c in enumerate(names)})
    for rows in (docs, docs.limit(0)):
        n = rows.count()
        for name, stage in pipeline.STAGES:
            after = stage(spark, rows, str(tmp_path))
            if name != "best_fit_packing":
                assert after.columns == docs.columns, name
                assert all(tuple(r)[5:] == tuple(range(len(names))) for r in after.collect())
            assert (after.count() > 0) == (n > 0)
    pipeline.STAGES[3][1](spark, docs.drop("n_chars"), str(tmp_path)).count()
