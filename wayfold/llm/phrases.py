"""Substring dedup by words: automata of recurring phrases locate them in all documents, windows of words are removed after their first place.

Each window of 20 words has a phrase of six words that a rule on the words alone singles out.
Phrases that are singled out twice or more over the corpus are confirmed, and a shard of
documents gets the confirmed ones that it may hold: they are compiled into an Aho-Corasick
automaton, and the shard's documents are streamed through it. What it locates is all that is
looked at further on: windows are named by the words around the located phrases, and those
names, of 128 bits, are compared over the whole corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .anchors import anchors, by_shard, chosen_windows, confirmed, counted, dealt, delivered, mixed
from .common import bounded, small_batches, stored, text_of

WINDOW = 20
PHRASE = 6
#: Bytes in a shard, and words that a worker remembers at most.
SHARD_BYTES = 2_000_000
MEMO_WORDS = 500_000
class _Words(dict):
    def __init__(self, seed: int):
        self._seed = seed

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word, self._seed)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > MEMO_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


class _Part:
    """The words of some documents, end to end."""

    def __init__(self, texts: list[str], memo: _Words):
        split = [t.encode().split() for t in texts]
        self.sizes = np.fromiter(map(len, split), np.int64, len(split))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.doc = np.repeat(np.arange(len(texts)), self.sizes)
        self.hashes = memo.of([w for words in split for w in words])
        self.sums = _Sums(self.hashes)

    def phrases(self, at: np.ndarray) -> np.ndarray:
        """Hashes of the phrases that begin at these places; never 0, which anchors() takes for none."""
        return np.maximum(self.sums.of(at, at + PHRASE), np.uint64(1))

    def singled_out(self) -> np.ndarray:
        """Places of the phrases that have the least hash in some window of one document."""
        n = len(self.hashes)
        if n < WINDOW:
            return np.zeros(0, np.int64)
        whole = self.doc[: n - WINDOW + 1] == self.doc[WINDOW - 1 :]
        return np.nonzero(anchors(self.phrases(np.arange(n - PHRASE + 1)), WINDOW - PHRASE + 1, whole))[0]


class _Sums:
    """Hashes of any run of words, by sums of a shard's words times powers."""

    _MULTIPLIER = 0xA0761D6478BD642F
    _up = _down = np.ones(1, np.uint64)

    @classmethod
    def _powers(cls, n: int) -> None:
        if len(cls._up) < n:
            size = max(n, 2 * len(cls._up))
            one = np.ones(size, np.uint64)
            up, down = one.copy(), one.copy()
            up[1:], down[1:] = np.uint64(cls._MULTIPLIER), np.uint64(pow(cls._MULTIPLIER, -1, 1 << 64))
            cls._up, cls._down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)

    def __init__(self, hashes: np.ndarray):
        self._powers(len(hashes) + 1)
        self._sum = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * self._up[: len(hashes)], dtype=np.uint64)])

    def of(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self._sum[end] - self._sum[first]) * self._down[first] + (end - first).astype(np.uint64))


#: A word is spelled by LETTERS letters of LETTER_BITS bits from its hash: a phrase is a number of 60 bits, and a node of an automaton has few children.
LETTERS, LETTER_BITS = 2, 5
_LEAST = (1 << LETTER_BITS) - 1


def _letters(hashes: np.ndarray) -> np.ndarray:
    return np.stack([(hashes >> np.uint64(64 - LETTER_BITS * (k + 1)) & np.uint64(_LEAST)).astype(np.uint8) for k in range(LETTERS)], axis=1)


def _keys(part: _Part, at: np.ndarray) -> np.ndarray:
    """The phrases at these places, spelled as numbers."""
    code = (part.hashes >> np.uint64(64 - LETTERS * LETTER_BITS)).astype(np.int64)
    key = np.zeros(len(at), np.int64)
    for k in range(PHRASE):
        key = key << (LETTERS * LETTER_BITS) | code[at + k]
    return key


def _text(letters: np.ndarray) -> str:
    return (letters.ravel() + np.uint8(ord("@"))).tobytes().decode("ascii")


def automaton(keys: np.ndarray) -> ahocorasick.Automaton | None:
    """The automaton of the phrases that these numbers spell; None for none."""
    if not len(keys):
        return None
    width = LETTERS * PHRASE
    text = _text(np.stack([(keys >> (LETTER_BITS * (width - 1 - k)) & _LEAST).astype(np.uint8) for k in range(width)], axis=1))
    out = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for k in range(0, len(text), width):
        out.add_word(text[k : k + width])
    out.make_automaton()
    return out


def located(found: ahocorasick.Automaton | None, part: _Part) -> np.ndarray:
    """The places, in order, at which the automaton finds its phrases in the part's words."""
    if found is None or not len(part.hashes):
        return np.zeros(0, np.int64)
    ends = np.fromiter((end for end, _ in found.iter(_text(_letters(part.hashes)))), np.int64) + 1
    return ends[ends % LETTERS == 0] // LETTERS - PHRASE  # the others begin inside a word


def phrase_counts(docs: DataFrame) -> DataFrame:
    """shard, key, n: the phrases that windows single out in each shard's documents (shard, _id, _text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Words(0)
        for batch in bounded(batches, 1, SHARD_BYTES):
            part = _Part(batch.column(1).to_pylist(), memo)
            at = part.singled_out()
            yield counted(batch.column(0).to_numpy()[part.doc[at]], _keys(part, at))

    return docs.select("shard", "_text").mapInArrow(run, "shard int, key long, n int")


def _expanded(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each row, count numbers in all."""
    return np.repeat(first - np.cumsum(count) + count, count) + np.arange(int(count.sum()))


def occurrences(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The places of located phrases: id, hash (of the phrase), kind (a hash of all words of the n windows that chose it), start (of the first window), n, again and windows.

    docs are dealt() and keys confirmed(). A window chooses the phrase of least hash that was
    located in it. A window that recurs has the phrase that it singles out located wherever it
    stands, and no other one in it has a smaller hash, so it chooses that one everywhere. again
    has the windows, counted from the first, that the same document has earlier. windows has
    the hash of each window, once for each kind and part of a shard: where the id is smallest.
    """
    names = ["id", "hash", "kind", "start", "n", "again", "windows"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Words(0)
        for found, batch in by_shard(batches, automaton, SHARD_BYTES):
            part = _Part(batch.column(1).to_pylist(), memo)
            at = located(found, part)
            if not len(at):
                continue
            doc, hashes, sums = part.doc[at], part.phrases(at), part.sums
            first, last = chosen_windows(at, hashes, WINDOW - PHRASE, part.starts[doc], part.starts[doc] + part.sizes[doc] - WINDOW)
            some = np.nonzero(first <= last)[0]
            if not len(some):
                continue
            first, n, doc, hashes = first[some], (last - first)[some] + 1, doc[some], hashes[some]
            kind = sums.of(first, first + n - 1 + WINDOW)

            again: list = [None] * len(some)
            key = mixed(hashes ^ mixed(doc.astype(np.uint64) + np.uint64(1)))
            _, which, times = np.unique(key, return_inverse=True, return_counts=True)
            rows = np.nonzero(times[which] > 1)[0]
            if len(rows):
                places = _expanded(first[rows], n[rows])
                row = np.repeat(rows, n[rows])
                own = sums.of(places, places + WINDOW)
                order = np.lexsort((places, own, key[row]))
                same = (own[order[1:]] == own[order[:-1]]) & (key[row[order[1:]]] == key[row[order[:-1]]])
                for i in order[1:][same].tolist():
                    r = int(row[i])
                    again[r] = [*(again[r] or []), int(places[i] - first[r])]

            rank = np.empty(batch.num_rows, np.int64)
            rank[pc.sort_indices(batch.column(0), null_placement="at_end").to_numpy()] = np.arange(batch.num_rows)
            order = np.lexsort((rank[doc], kind, hashes))
            lead = np.ones(len(order), bool)
            lead[1:] = (kind[order[1:]] != kind[order[:-1]]) | (hashes[order[1:]] != hashes[order[:-1]])
            given = np.zeros(len(order), bool)
            given[order[lead]] = True
            places = _expanded(first[given], n[given])
            offsets = np.concatenate([[0], np.cumsum(np.where(given, n, 0))]).astype(np.int32)
            windows = pa.ListArray.from_arrays(pa.array(offsets), pa.array(sums.of(places, places + WINDOW).view(np.int64)), mask=pa.array(~given))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc)), pa.array(hashes.view(np.int64)), pa.array(kind.view(np.int64)), pa.array((first - part.starts[doc]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(again, pa.list_(pa.int32())), windows], names
            )

    kinds = (T.LongType(), T.LongType(), T.IntegerType(), T.IntegerType(), T.ArrayType(T.IntegerType()), T.ArrayType(T.LongType()))
    schema = T.StructType([T.StructField("id", docs.schema["_id"].dataType), *(T.StructField(n, t) for n, t in zip(names[1:], kinds, strict=True))])
    return delivered(docs, keys).mapInArrow(run, schema)


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, runs (array of first, last): windows of each document whose words also start earlier, in a document of smaller id or before in the same.

    Places of one kind have the same windows: all of them are repeated but where the id is the
    kind's smallest. There a window is repeated if another kind of its phrase has it in a
    document of smaller id, which only the windows of kinds have to tell, not those of places.
    All sums are pre-aggregated however common a phrase is, and joins may be split where hot.
    """
    small_batches(docs.sparkSession)
    shards = dealt(docs, id_col, text_col, SHARD_BYTES)
    found = stored(occurrences(shards, confirmed(phrase_counts(shards))).withColumnRenamed("id", id_col), "occurrences")
    kinds = stored(found.groupBy("hash", "kind").agg(F.min(id_col).alias("first_id")), "kinds")
    several = kinds.groupBy("hash").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("hash")
    wanted = kinds.join(several, "hash")
    given = found.where("windows is not null").select(F.col(id_col).alias("_of"), "hash", "kind", "windows")
    windows = given.join(wanted, ["hash", "kind"]).where(F.col("_of").eqNullSafe(F.col("first_id"))).select("hash", "kind", "first_id", F.posexplode("windows").alias("offset", "window"))
    windows = stored(windows, "windows")
    first = windows.groupBy("hash", "window").agg(F.min("first_id").alias("window_id"))
    earlier = windows.join(first, ["hash", "window"]).where(~F.col("first_id").eqNullSafe(F.col("window_id"))).select("hash", "kind", "offset")
    of_kind = stored(kinds.join(earlier.groupBy("hash", "kind").agg(F.collect_set("offset").alias("offsets")), ["hash", "kind"], "left"), "kinds")  # read again, so that the join below may be split
    placed = found.select(id_col, "hash", "kind", "start", "n", "again").join(of_kind, ["hash", "kind"])
    one = lambda offsets: F.transform(offsets, lambda o: F.struct(o.alias("first"), o.alias("last")))
    none = F.expr("cast(array() as array<struct<first:int,last:int>>)")
    whole = F.array(F.struct(F.lit(0).alias("first"), (F.col("n") - 1).alias("last")))
    runs = F.when(~F.col(id_col).eqNullSafe(F.col("first_id")), whole).otherwise(F.concat(F.coalesce(one(F.col("offsets")), none), F.coalesce(one(F.col("again")), none)))
    moved = placed.select(id_col, "start", F.explode(runs).alias("r")).select(id_col, F.struct((F.col("start") + F.col("r.first")).alias("first"), (F.col("start") + F.col("r.last")).alias("last")).alias("r"))
    return stored(moved.groupBy(id_col).agg(F.collect_set("r").alias("runs")), "runs")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, n_removed, text (the words that stay, joined by one space).

    Words are cut at ASCII white space and otherwise left as they are. Null texts count as
    empty; texts of fewer than 20 words lose nothing. A document is named by its id: rows that
    repeat an id must repeat its text, and lose nothing to each other. A null id counts as
    larger than all others. Empty tables give no rows.
    """
    runs = repeated_windows(docs, id_col, text_col).withColumnRenamed(id_col, "_of")
    rows = docs.select(F.col(id_col), text_of(text_col).alias("_text"))
    joined = rows.join(runs, rows[id_col] == runs["_of"], "left").select(id_col, "_text", F.col("runs.first").alias("first"), F.col("runs.last").alias("last"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, kept = [], [], []
            for text, first, last in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                words = text.encode().split()
                sizes.append(len(words))
                if first:
                    mark = np.zeros(len(words) + 1, np.int64)
                    np.add.at(mark, np.array(first), 1)
                    np.add.at(mark, np.array(last) + WINDOW, -1)
                    words = list(compress(words, (np.cumsum(mark)[:-1] == 0).tolist()))
                removed.append(sizes[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], [id_col, "n_words", "n_removed", "text"])

    schema = T.StructType([docs.schema[id_col], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("text", T.StringType())])
    return joined.mapInArrow(run, schema)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, n_removed, kept_sha256."""
    return remove_repeats(docs, id_col, text_col).select(id_col, "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
