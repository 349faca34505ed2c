import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from llm_fixtures import DOCS, documents, find, personal, secrets, sha, written
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wayfold.llm import bpe, exact, golay, packing, phrases, pii, quality, secret_scan, suffixes
from wayfold.llm.lexicon import Lexicon, compile_lexicon

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def rows():
    return documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    clash = {c: F.lit(7) for c in ("spans", "_text", "_id", "_gone", "score", "__text", "fingerprint", "keep_id", "blob", "a", "b", "u", "starts", "length")}
    return spark.createDataFrame(rows, DOCS).repartition(3).withColumns(clash).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def ids(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


def test_bpe_equals_the_library(docs, none, rows):
    got = Counter(tuple(r) for r in bpe.round_trip_digests(docs).collect())
    want = Counter()
    for i, t, *_ in rows:
        x = ids(t)
        want[i, len(x), sha(",".join(map(str, x))), sha(TOKENIZER.decode(x, skip_special_tokens=False))] += 1
    assert got == want
    assert bpe.round_trip_digests(none).count() == 0
    back = bpe.decode(bpe.encode(docs)).collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter((i, t or "") for i, t, *_ in rows)


def test_units_merged_together_equal_the_library(tmp_path):
    texts = ["a  b", " a\n b", "", "x  y ", "a\t b \t", "don't  \n\n b 's", " " * 50, "\x85 \x1c a", "été 中文 café", "<|endoftext|> a b", "A" * 5000 + " " + "b" * 3000, "1 22 333 a1 b'll"]
    path = tmp_path / "lexicon"
    path.write_bytes(compile_lexicon([(b" b", ids(" b"))]))
    want = [np.array(ids(t), "<u4").tobytes() for t in texts]
    for lexicon in (None, Lexicon(str(path))):
        own = bpe.Coder(bpe.default_tokenizer(), lexicon)
        assert own.encode_batch(texts) == want == list(map(own.encode, texts))
        assert [own.decimal(x) for x in want] == [",".join(map(str, ids(t))) for t in texts]
        assert own.encode_batch([]) == []


def test_lexicon_is_exact_and_minimal(tmp_path):
    words = [b"tap", b"taps", b"top", b"tops", b"", b"stop", b"stops"]
    path = tmp_path / "lexicon"
    path.write_bytes(compile_lexicon((w, [i, i + 1]) for i, w in enumerate(words)))
    own = Lexicon(str(path))
    assert [np.frombuffer(own.get(w), "<i4").tolist() for w in words] == [[i, i + 1] for i in range(len(words))]
    assert own.get(b"to") is None and own.get(b"topsy") is None
    assert own.get_many([*words, b"x", b"tapsy"]) == [*map(own.get, words), None, None]
    assert own.states() < sum(map(len, words)) + 1  # suffixes are shared
    path.write_bytes(compile_lexicon([]))
    assert Lexicon(str(path)).get(b"a") is None and Lexicon(str(path)).get_many([b"a"]) == [None]


def test_secrets(docs, none, rows):
    got = Counter(tuple(r) for r in secret_scan.findings(docs).collect())
    want = Counter()
    for i, t, *_ in rows:
        base = secrets(t or "")
        n = Counter(k for _, _, k, _ in base)
        forge = find("forge", 4, "gh[pousr]_[A-Za-z0-9]+", t or "", lambda m: len(m[0]) >= 40)
        want[i, n["assign"], n["access"], n["hex"], sha(written(base)), written(base + forge)] += 1
    assert got == want
    assert secret_scan.findings(none).count() == 0


def test_ledger_scans_only_what_is_new(spark, docs):
    first = secret_scan.update_ledger(docs.limit(20), rule_version=secret_scan.BASE)
    more = spark.createDataFrame([(1, "password=abcdefgh"), (2, "password=abcdefgh"), (3, None)], "doc_id long, text string")
    both = secret_scan.update_ledger(more.unionByName(docs.limit(20).select("doc_id", "text")), first, secret_scan.BASE)
    assert both.count() == both.select("blob", "rule_version").distinct().count()
    again = secret_scan.update_ledger(more, both, secret_scan.BASE)
    assert again.count() == both.count()
    assert secret_scan.update_ledger(more, both, secret_scan.EXTENDED).count() == both.count() + 2


def test_personal_data(docs, none, rows):
    got = Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in pii.findings(docs).collect())
    want = Counter()
    for i, t, *_ in rows:
        base = personal(t or "")
        n = Counter(k for _, _, k, _ in base)
        want[i, n["email"], n["ip"], n["card"], n["phone"], sha(written(base))] += 1
    assert got == want
    assert pii.findings(none).count() == 0


def test_redaction_takes_effect(spark):
    texts = ["mail a@b.cd now", "call me: tel 020 7946 0958 bye", "order 12345678 is fine", None, "", "plain words", "info (at) mail (dot) org"]
    got = [r.text for r in pii.redact(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).orderBy("doc_id").collect()]
    assert got[0] == "mail [EMAIL] now" and "7946" not in got[1] and got[2:6] == texts[2:6] and got[6] == "[MAIL]"


def brute_phrases(rows):
    seen, out = {}, {}
    for i, t in sorted({(i, t or "") for i, t, *_ in rows}):
        words = t.encode().split()
        gone = [False] * len(words)
        for s in range(len(words) - 19):
            key = tuple(words[s : s + 20])
            if key in seen:
                gone[s : s + 20] = [True] * 20
            seen.setdefault(key, i)
        out[i] = (len(words), sum(gone), sha(b" ".join(w for w, g in zip(words, gone, strict=True) if not g)))
    return out


def test_phrases(docs, none, rows):
    want = brute_phrases(rows)
    got = phrases.digests(docs).collect()
    assert len(got) == len(rows) and {r.doc_id: tuple(r)[1:] for r in got} == want
    assert any(w[1] for w in want.values())
    assert phrases.digests(none).count() == 0


def brute_bytes(rows):
    data = [(i, (t or "").encode()) for i, t, *_ in rows]
    count = Counter(b[k : k + 200] for _, b in data for k in range(len(b) - 199))
    out = {}
    for i, b in data:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 199):
            if count[b[k : k + 200]] > 1:
                gone[k : k + 200] = True
        spans = int(np.diff(np.concatenate([[0], gone.astype(int)])).clip(0).sum())
        out[i] = (len(b), int(gone.sum()), spans, sha(np.frombuffer(b, np.uint8)[~gone].tobytes()))
    return out


@pytest.mark.parametrize("most", [suffixes.SHARD_ROWS, 3])
def test_suffixes(docs, none, rows, most, monkeypatch):
    monkeypatch.setattr(suffixes, "SHARD_ROWS", most)
    want = brute_bytes(rows)
    got = suffixes.digests(docs).collect()
    assert len(got) == len(rows) and {r.doc_id: tuple(r)[1:] for r in got} == want
    assert any(w[1] for w in want.values())
    if most > 3:
        assert suffixes.digests(none).count() == 0


def test_suffix_array():
    rng = np.random.default_rng(0)
    for _ in range(400):
        s = rng.integers(1, rng.integers(2, 30), rng.integers(0, 70))
        assert suffixes.suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def brute_fingerprint(t):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    words = re.findall(rb"[^\x20\x09-\x0D]+", words.encode())
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[k : k + 3]), 42) for k in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(docs, none, rows):
    unique = sorted({(i, t or "") for i, t, *_ in rows})
    prints = [brute_fingerprint(t) for _, t in unique]
    pairs = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    from llm_fixtures import components

    roots = components(len(prints), pairs)
    want = {i: (f"{p:016x}", unique[r][0]) for (i, _), p, r in zip(unique, prints, roots, strict=True)}
    got = golay.near_duplicates(docs).collect()
    assert len(got) == len(rows) and {r.doc_id: tuple(r)[1:] for r in got} == want
    assert golay.near_duplicates(none).count() == 0


def test_golay_keys_meet_within_three_bits():
    code, rng = golay.Golay(), np.random.default_rng(3)
    a = rng.integers(0, 1 << 63, 2000, dtype=np.int64)
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.choice(64, rng.integers(0, 4), replace=False):
            b[i] ^= np.uint64(1 << int(bit)).view(np.int64)
    left, right = [set() for _ in a], [set() for _ in a]
    for side, found in ((left, golay.keys(a, code)[0]), (right, golay.keys(b, code)[1])):
        for rows, keys in found:
            for r, k in zip(rows.tolist(), keys.tolist(), strict=True):
                side[r].add(k)
    assert all(x & y for x, y in zip(left, right, strict=True))


def test_golay_keys_are_not_broadcast(spark, tmp_path):
    """Few bytes of fingerprints make many keys, which must not pass through the driver."""
    prints = np.random.default_rng(5).integers(0, 1 << 63, 200, dtype=np.int64).tolist()
    spark.createDataFrame([(p,) for p in [*prints, prints[0] ^ 7]], "fp long").write.parquet(f"{tmp_path}/prints")
    found = golay.links(spark.read.parquet(f"{tmp_path}/prints"))
    assert {frozenset(r) for r in found.collect()} >= {frozenset((prints[0], prints[0] ^ 7))}
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_exact(docs, none, rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t, *_ in rows]
    size, least = Counter(norm), {}
    for (i, *_), t in zip(rows, norm, strict=True):
        least[t] = min(i, least.get(t, i))
    want = Counter((i, least[t], size[t], i == least[t], sha(t)) for (i, *_), t in zip(rows, norm, strict=True))
    assert Counter(tuple(r) for r in exact.exact_duplicates(docs).collect()) == want
    weak = exact.exact_duplicates(docs, hash128=lambda c: F.unhex(F.hex(F.length(c) % 2)))
    assert Counter(tuple(r) for r in weak.collect()) == want  # collisions are told apart
    kept = exact.exact_dedup(docs)
    assert kept.columns == docs.columns and kept.count() == sum(w[3] for w in want)  # one row of each group, rows that repeat it too
    assert exact.exact_duplicates(none).count() == 0


def test_packing(docs, none, rows):
    got = [r.asDict() for r in packing.best_fit_packing(docs, capacity=300).collect()]
    want = Counter()
    for i, t, *_ in rows:
        x = [*ids(t), 0]
        first = len(x) % 300 or 300
        for k, start in enumerate([0, *range(first, len(x), 300)]):
            piece = x[start : first if k == 0 else start + 300]
            want[i, k, start, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 300
    room = []
    for length in sorted((r["length"] for r in got), reverse=True):  # best-fit decreasing, a bin at a time
        fits = [(left, i) for i, left in enumerate(room) if left >= length]
        if fits:
            room[min(fits)[1]] -= length
        else:
            room.append(300 - length)
    assert len(bins) == len(room)
    assert packing.best_fit_packing(none).count() == 0


def test_quality(spark, none):
    rng = np.random.default_rng(1)
    good = lambda: " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(2, 8))) for _ in range(60)) + "."
    bad = lambda: " ".join(["BUY!!", "$$$", "NOW!!"][rng.integers(3)] for _ in range(60))
    rows = [(i, good() if i % 2 else bad(), None, None, None) for i in range(400)] + [(400, None, None, None, None), (401, "", None, None, None), (401, "", None, None, None)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit(9))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(400)] + [(401, None, None)], "doc_id long, quality int, toxic int")
    got = quality.quality_scores(docs, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    assert np.mean([r.predicted == r.doc_id % 2 for r in got if r.held_out and r.doc_id < 400]) > 0.95
    assert quality.quality_scores(none, labels).count() == 0
    unlabelled = quality.quality_scores(docs, labels.limit(0)).collect()
    assert {r.score for r in unlabelled} == {0.5}


def test_automata_locate_the_phrases(docs, rows, monkeypatch):
    """Without what the automata find nothing is removed, and they find every place of a phrase."""
    rng = np.random.default_rng(5)
    words = [" ".join(rng.choice(list("abcdef"), 400)) for _ in range(3)]
    part = phrases._Part(words, phrases._Words(0))
    keys = np.unique(phrases._keys(part, np.arange(0, 300, 7)))
    got = phrases.located(phrases.automaton(keys), part)
    every = phrases._keys(part, np.arange(len(part.hashes) - 5))
    assert got.tolist() == np.nonzero(np.isin(every, keys))[0].tolist() and len(got) > len(keys)
    monkeypatch.setattr(phrases, "automaton", lambda keys: None)
    assert sum(r.n_removed for r in phrases.digests(docs).collect()) == 0
