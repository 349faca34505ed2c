"""Substring dedup by bytes: suffixes sorted by the difference-cover algorithm, adjacent ones compared.

A string of 200 bytes can only recur where the anchor that it chooses recurs, so each recurring
anchor's neighbourhood, the bytes of all windows that chose it, goes to the shard that the
anchor names: equal windows meet in one shard. A shard sorts the suffixes of its neighbourhoods
(sort sampled triples, recurse on their names, merge the remaining suffixes) and marks those
that share 200 bytes with the next one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .anchors import anchors, by_shard, chosen_windows, confirmed, counted, dealt, delivered, run_hashes
from .common import bounded, small_batches, stored, text_of

WINDOW = 200
RUN = 32
#: Bytes that a shard sorts at once, and neighbourhoods of one anchor that it takes at most: under 4.6 MB, which take some 100 times that to sort. Where an anchor has more, its windows are counted over the corpus.
SHARD_BYTES = 400_000
SHARD_ROWS = 8000
#: Bytes of text in a shard of documents, which a worker looks at together.
DOC_BYTES = 2_000_000


def suffix_array(s: np.ndarray) -> np.ndarray:
    """The order of the suffixes of s, whose numbers are 1 or more, by the difference cover {1, 2} of 3."""
    n = len(s)
    if n < 2:
        return np.arange(n)
    s = np.concatenate([np.unique(s, return_inverse=True)[1] + 1, np.zeros(4, np.int64)])
    if n < 8:
        return np.array(sorted(range(n), key=lambda i: s[i:n].tolist()), np.int64)
    size = int(s.max()) + 1
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    if size < 1 << 20:
        names = np.unique(((s[sample] << 40) | (s[sample + 1] << 20)) | s[sample + 2], return_inverse=True)[1]
    else:
        pairs = np.unique(s[sample] * size + s[sample + 1], return_inverse=True)[1]
        names = np.unique(pairs * size + s[sample + 2], return_inverse=True)[1]
    if int(names.max()) + 1 < len(names):
        order = suffix_array(names + 1)
    else:
        order = np.argsort(names)
    rank = np.zeros(n + 4, np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    sampled = sample[order]
    sampled = sampled[sampled < n]
    zero = np.arange(0, n, 3)
    width = len(sample) + 2
    zero_key = s[zero] * width + rank[zero + 1]
    by_key = np.argsort(zero_key, kind="stable")
    zero, zero_key = zero[by_key], zero_key[by_key]
    of_one, of_two = sampled % 3 == 1, sampled % 3 == 2
    ones, twos = sampled[of_one], sampled[of_two]
    one_key = s[ones] * width + rank[ones + 1]
    two_key = (s[twos] * size + s[twos + 1]) * width + rank[twos + 2]
    zero_two_key = (s[zero] * size + s[zero + 1]) * width + rank[zero + 2]
    place = np.empty(n, np.int64)
    place[zero] = np.arange(len(zero)) + np.searchsorted(one_key, zero_key) + np.searchsorted(two_key, zero_two_key)
    at = np.arange(len(sampled))
    before = np.empty(len(sampled), np.int64)
    before[of_one] = np.searchsorted(zero_key, one_key)
    before[of_two] = np.searchsorted(zero_two_key, two_key)
    place[sampled] = at + before
    out = np.empty(n, np.int64)
    out[place] = np.arange(n)
    return out


def repeated_starts(parts: list[bytes]) -> list[np.ndarray]:
    """For each part, the starts of its windows that stand anywhere else in the parts."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    ends = np.cumsum(sizes)
    text = np.zeros(int(ends[-1]) + WINDOW, np.uint8)
    text[: ends[-1]] = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8)
    numbers = text[: ends[-1]].astype(np.int64) + 1
    numbers[ends - 1] = 257 + np.arange(len(parts))
    order = suffix_array(numbers)
    room = np.repeat(ends - 1, sizes) - np.arange(int(ends[-1]))
    order = order[room[order] >= WINDOW]
    eights = np.lib.stride_tricks.as_strided(text.view(), (len(text) - 7, 8), (1, 1))
    pair = np.arange(len(order) - 1)
    for step in range(0, WINDOW, 8):
        a, b = order[pair] + step, order[pair + 1] + step
        pair = pair[(eights[a] == eights[b]).all(axis=1)]
    mark = np.zeros(int(ends[-1]), bool)
    mark[order[pair]] = True
    mark[order[pair + 1]] = True
    starts = ends - sizes
    return [np.nonzero(mark[a:b])[0] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def _runs(starts: np.ndarray) -> list[tuple[int, int]]:
    """Consecutive starts as (first, last)."""
    if not len(starts):
        return []
    cut = np.nonzero(np.diff(starts) != 1)[0]
    return list(zip(starts[np.concatenate([[0], cut + 1])].tolist(), starts[np.concatenate([cut, [len(starts) - 1]])].tolist(), strict=True))


class _Batch:
    """The bytes of some documents, end to end, with their anchors and each window's anchor."""

    def __init__(self, texts: list[str]):
        data = [t.encode() for t in texts]
        self.sizes = np.fromiter(map(len, data), np.int64, len(data))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.joined = b"".join(data)
        n = len(self.joined)
        self.hashes = run_hashes(np.frombuffer(self.joined, np.uint8), RUN)
        if n < WINDOW:
            self.whole, self.anchors = np.zeros(0, bool), np.zeros(0, np.int64)
            return
        last = np.repeat(self.starts + self.sizes, self.sizes)[: n - WINDOW + 1]
        self.whole = np.arange(n - WINDOW + 1) + WINDOW <= last
        self.anchors = np.nonzero(anchors(self.hashes, WINDOW - RUN + 1, self.whole))[0]

    def neighbourhoods(self, recurring: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """anchor, first window, last window: for each anchor whose hash recurs the run of windows that chose it."""
        at = self.anchors
        if not len(at):
            return at, at, at
        hashes = self.hashes[at]
        doc = np.searchsorted(self.starts, at, "right") - 1
        first, last = chosen_windows(at, hashes, WINDOW - RUN, self.starts[doc], self.starts[doc] + self.sizes[doc] - WINDOW)
        keep = np.isin(hashes.view(np.int64), recurring) & (first <= last)
        return at[keep], first[keep], last[keep]


def anchor_counts(docs: DataFrame) -> DataFrame:
    """shard, key, n: hashes of the anchors of all windows in each shard's documents (shard, _id, _text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 1, DOC_BYTES):
            own = _Batch(batch.column(1).to_pylist())
            shard = batch.column(0).to_numpy()[np.searchsorted(own.starts, own.anchors, "right") - 1]
            yield counted(shard, own.hashes[own.anchors].view(np.int64))

    return docs.select("shard", "_text").mapInArrow(run, "shard int, key long, n int")


def neighbourhoods(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """id, hash (the anchor's), start (of the first window), bytes (of all windows that chose it), a and b (their name of 128 bits); docs are dealt() and keys confirmed()."""
    names = ["id", "hash", "start", "bytes", "a", "b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for recurring, batch in by_shard(batches, lambda found: found, DOC_BYTES):
            own = _Batch(batch.column(1).to_pylist())
            at, first, last = own.neighbourhoods(recurring)
            if not len(at):
                continue
            doc = np.searchsorted(own.starts, at, "right") - 1
            # an empty document has the same start as the next one; the last of them holds the bytes
            found = [own.joined[a : b + WINDOW] for a, b in zip(first.tolist(), last.tolist(), strict=True)]
            wide = np.array([divmod(xxhash.xxh3_128_intdigest(x), 1 << 64) for x in found], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc)), pa.array(own.hashes[at].view(np.int64)), pa.array((first - own.starts[doc]).astype(np.int32)), pa.array(found, pa.binary()), pa.array(wide[:, 0]), pa.array(wide[:, 1])], names
            )

    kinds = (T.LongType(), T.IntegerType(), T.BinaryType(), T.LongType(), T.LongType())
    schema = T.StructType([T.StructField("id", docs.schema["_id"].dataType), *(T.StructField(n, t) for n, t in zip(names[1:], kinds, strict=True))])
    return delivered(docs, keys).mapInArrow(run, schema)


def _sorted_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (hash, a, b, bytes) in the order of hash: the runs of repeated windows of each, a few anchors at a time."""
    names = ["a", "b", "first", "last"]
    held: list[tuple[int, int, int, bytes]] = []

    def settle(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        out = [(a, b, x, y) for (_, a, b, _), starts in zip(rows, repeated_starts([r[3] for r in rows]), strict=True) for x, y in _runs(starts)]
        columns = np.array(out, np.int64).reshape(-1, 4)
        return pa.RecordBatch.from_arrays([pa.array(columns[:, 0]), pa.array(columns[:, 1]), *(pa.array(columns[:, j].astype(np.int32)) for j in (2, 3))], names)

    size = 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if size > SHARD_BYTES and row[0] != held[-1][0]:
                yield settle(held)
                held, size = [], 0
            held.append(row)
            size += len(row[3])
    if held:
        yield settle(held)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of each row (a, b, bytes), with its name of 128 bits."""
    for batch in batches:
        for k in range(0, batch.num_rows, 200):
            rows = list(zip(*(c.to_pylist() for c in batch.slice(k, 200).columns), strict=True))
            found = [(a, b, i, *divmod(xxhash.xxh3_128_intdigest(x[i : i + WINDOW]), 1 << 64)) for a, b, x in rows for i in range(len(x) - WINDOW + 1)]
            names = np.array([f[3:] for f in found], np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int32()), pa.array(names[:, 0]), pa.array(names[:, 1])], ["a", "b", "first", "wa", "wb"]
            )


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, runs (array of structs first, last): starts of the windows that stand anywhere else too.

    Equal neighbourhoods are one row before anything is compared; all windows of one that
    occurs twice are repeated, which needs no sort. The others of an anchor go to its shard. An
    anchor with more than SHARD_ROWS of them would make a task of unbounded size: its windows
    are named and counted over the corpus, pre-aggregated where they are made.
    """
    small_batches(docs.sparkSession)
    shards = dealt(docs, id_col, text_col, DOC_BYTES)
    found = stored(neighbourhoods(shards, confirmed(anchor_counts(shards))).withColumnRenamed("id", id_col), "neighbourhoods")
    kinds = stored(found.groupBy("hash", "a", "b", "bytes").agg(F.count(F.lit(1)).alias("n")), "kinds")
    per_anchor = kinds.groupBy("hash").agg(F.count(F.lit(1)).alias("kinds"))
    whole = kinds.where("n > 1").select("a", "b", F.lit(0).alias("first"), (F.length("bytes") - WINDOW).alias("last"))
    mixed_kinds = kinds.join(per_anchor.where("kinds > 1"), "hash")
    few = mixed_kinds.where(f"kinds <= {SHARD_ROWS}").select("hash", "a", "b", "bytes").repartition("hash").sortWithinPartitions("hash", "a", "b")
    sorted_runs = few.mapInArrow(_sorted_shards, "a long, b long, first int, last int")
    windows = mixed_kinds.where(f"kinds > {SHARD_ROWS}").select("a", "b", "bytes").mapInArrow(_windows, "a long, b long, first int, wa long, wb long")
    windows = stored(windows, "windows")
    common = windows.groupBy("wa", "wb").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("wa", "wb")
    counted = windows.join(common, ["wa", "wb"]).select("a", "b", "first", F.col("first").alias("last"))
    runs = stored(whole.unionByName(sorted_runs).unionByName(counted), "runs")
    of_doc = found.select(id_col, "start", "a", "b").join(runs, ["a", "b"])
    return of_doc.groupBy(id_col).agg(F.collect_set(F.struct((F.col("start") + F.col("first")).alias("first"), (F.col("start") + F.col("last")).alias("last"))).alias("runs"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept (the bytes that stay).

    Texts are bytes of UTF-8; what stays need not be UTF-8. Null texts count as empty; texts
    under 200 bytes lose nothing. Matches never cross documents, and overlapping ones count. A
    document is named by its id: rows that repeat an id must repeat its text, and each then is
    the other's copy. Rows without an id are compared, but lose nothing themselves. Empty tables
    give no rows.
    """
    runs = repeated_runs(docs, id_col, text_col).withColumnRenamed(id_col, "_of")
    rows = docs.select(F.col(id_col), text_of(text_col).alias("_text"))
    joined = rows.join(runs, rows[id_col] == runs["_of"], "left").select(id_col, "_text", F.transform("runs", lambda r: r["first"]).alias("a"), F.transform("runs", lambda r: r["last"]).alias("b"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, spans, kept = [], [], [], []
            for text, first, last in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                data = text.encode()
                stay = np.frombuffer(data, np.uint8)
                n = 0
                if first:
                    mark = np.zeros(len(data) + 1, np.int64)
                    np.add.at(mark, np.array(first), 1)
                    np.add.at(mark, np.array(last) + WINDOW, -1)
                    gone = np.cumsum(mark)[:-1] > 0
                    n = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    stay = stay[~gone]
                sizes.append(len(data))
                removed.append(len(data) - len(stay))
                spans.append(n)
                kept.append(stay.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (sizes, removed, spans)), pa.array(kept, pa.binary())], [id_col, "n_bytes", "n_removed", "n_spans", "kept"])

    schema = T.StructType([docs.schema[id_col], *(T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept", T.BinaryType())])
    return joined.mapInArrow(cut, schema)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept_sha256."""
    return remove_repeats(docs, id_col, text_col).select(id_col, "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
