"""SimHash near-dedup: fingerprints, keys from Golay codewords near their segments, join and verify."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import HIDDEN, STAY, small_batches, stored, survivors, text_of
from .components import components

SHINGLE_WORDS = 3
SEED = 42
#: Fingerprints link at this many differing bits or fewer; the keys are made for exactly this many.
MOST_BITS = 3
#: Widths of the segments from the lowest bit.
WIDTHS = (23, 23, 18)
#: Fixed value: the generator polynomial of the binary Golay code of length 23.
GENERATOR = 0b101011100011


class Golay:
    """The perfect code of length 23: every word is within 3 bits of exactly one of its 4096 codewords."""

    def __init__(self) -> None:
        low = np.arange(1 << 12, dtype=np.int64)
        self._low, self._high = self._remainder(low), self._remainder(low[: 1 << 11] << 12)
        self._error = np.zeros(1 << 11, np.int64)
        for weight in range(1, 4):
            for bits in combinations(range(23), weight):
                word = sum(1 << b for b in bits)
                self._error[self._low[word & 0xFFF] ^ self._high[word >> 12]] = word

    @staticmethod
    def _remainder(words: np.ndarray) -> np.ndarray:
        out = words.copy()
        for bit in range(22, 10, -1):
            out ^= np.where(out >> bit & 1, GENERATOR << (bit - 11), 0)
        return out

    def index(self, words: np.ndarray) -> np.ndarray:
        """The number of the nearest codeword: its upper 12 bits, which name it."""
        return (words ^ self._error[self._low[words & 0xFFF] ^ self._high[words >> 12]]) >> 11

    def near(self, words: np.ndarray, width: int) -> np.ndarray:
        """Per word the numbers for it and for each word a bit away; repeats are -1. Two words a bit apart or equal share one's index() with the other's near()."""
        flips = np.array([0, *(1 << b for b in range(width))], np.int64)
        found = np.sort(self.index(words[:, None] ^ flips), axis=1)
        found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
        return found


def fingerprint(text: str) -> int:
    """The 64-bit fingerprint of a text's word shingles; 0 for a text without words."""
    words = text.encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - SHINGLE_WORDS + 1)
    hashes = [xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[len(words) - n :].tolist(), strict=True)]
    bits = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        block = np.array(hashes[at : at + (1 << 16)], ">u8").view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(bits * 2 > n).view(">u8")[0])


_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprints(docs: DataFrame, names: list[str], text: Column) -> DataFrame:
    """The columns named and fingerprint (the 64 bits as a signed long) per row of docs."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t) for t in batch.column(len(names)).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(found)], [*names, "fingerprint"])

    schema = T.StructType([*(docs.schema[n] for n in names), T.StructField("fingerprint", T.LongType())])
    return docs.select(*names, text.alias(HIDDEN)).mapInArrow(run, schema)


def keys(found: np.ndarray, code: Golay) -> tuple[list, list]:
    """Keys of fingerprints, as (rows, keys) for either side of the join.

    Of at most three differing bits over three segments, either a segment has none and
    another has at most one, or each segment has exactly one. The first gives a family of keys
    for each ordered pair: a segment as it is and a codeword near the other. The second gives a
    family of three codewords. In every place where fingerprints may differ by a bit, one side
    takes the nearest codeword and the other all near ones.
    """
    whole, shift = found.view(np.uint64), 0
    parts, own, near = [], [], []
    for width in WIDTHS:
        part = (whole >> np.uint64(shift) & np.uint64((1 << width) - 1)).astype(np.int64)
        parts.append(part)
        own.append(code.index(part))
        near.append(code.near(part, width))
        shift += width
    rows = np.arange(len(found))
    left: list[tuple[np.ndarray, np.ndarray]] = []
    right: list[tuple[np.ndarray, np.ndarray]] = []
    family = 0
    for same in range(3):
        for other in range(3):
            if same != other:
                head = np.int64(family) << 60 | parts[same] << 12
                left.append((rows, head | own[other]))
                r, k = np.nonzero(near[other] >= 0)
                right.append((r, head[r] | near[other][r, k]))
                family += 1
    head = np.int64(family) << 60
    r, k = np.nonzero(near[0] >= 0)
    left.append((r, head | near[0][r, k] << 24 | own[1][r] << 12 | own[2][r]))
    pairs = (near[1] >= 0)[:, :, None] & (near[2] >= 0)[:, None, :]
    r, j, k = np.nonzero(pairs)
    right.append((r, head | own[0][r] << 24 | near[1][r, j] << 12 | near[2][r, k]))
    return left, right


def _keyed(distinct: DataFrame, side: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Golay()
        for batch in batches:
            found = batch.column(0).to_numpy()
            for at in range(0, len(found), 20_000):
                block = found[at : at + 20_000]
                for rows, key in keys(block, code)[side]:
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(block[rows])], ["key", "fp"])

    return distinct.select("fp").mapInArrow(run, "key long, fp long")


def links(distinct: DataFrame) -> DataFrame:
    """u, v: the pairs of different fingerprints (column fp) that differ in MOST_BITS bits or fewer; a pair may come more than once.

    A fingerprint makes some 70 keys, of which Spark's estimate knows nothing: without the hint it
    broadcasts a side of millions of keys through the driver, as the fingerprints alone are few bytes.
    """
    left, right = _keyed(distinct, 0).withColumnRenamed("fp", "u"), _keyed(distinct, 1).withColumnRenamed("fp", "v")
    return left.join(right.hint("merge"), "key").where((F.col("u") != F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= MOST_BITS)).select("u", "v")


def rooted(rows: DataFrame) -> DataFrame:
    """fp, root: each fingerprint of rows and the smallest one that links lead to; equal fingerprints are one class before any comparison.

    There are as many as fingerprints, so here and where they are joined to rows, sides are sorted:
    a table of them that counts as small by its bytes has several times those in the driver.
    """
    classes = stored(rows.select(F.col("fingerprint").alias("fp")).distinct(), "classes")
    return classes.join(components(links(classes)).hint("merge"), F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, fingerprint (16 hexadecimal digits), component_id (the smallest id reachable by links, itself included).

    Rows of equal fingerprints are one class before any comparison, so copies never meet in
    pairs. Null and empty texts have the fingerprint zero, which is linked like any other. A
    row with a null id takes part and has a component all the same. Empty tables give no rows.
    """
    rows = stored(fingerprints(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), ["_id"], text_of("_text")), "fingerprints")
    roots = stored(rooted(rows), "roots")
    least = rows.groupBy("fingerprint").agg(F.min("_id").alias("least")).join(roots.hint("merge"), F.col("fingerprint") == F.col("fp"))
    smallest = least.groupBy("root").agg(F.min("least").alias("component_id"))
    named = roots.join(smallest.hint("merge"), "root").select(F.col("fp").alias("fingerprint"), "component_id")
    return rows.join(named.hint("merge"), "fingerprint").select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each group of linked documents, with all its columns: the one of smallest id.

    Of rows that share that id the one whose text has the smallest SHA-256 stays, and of rows
    that share both any one. Null and empty texts are alike, so one of them stays. Rows without
    an id stay all. Columns pass unchanged, whatever they are called. An empty table gives no rows.
    """
    sha = F.sha2(text_of(text_col), 256)
    known = docs.where(F.col(id_col).isNotNull())
    rows = stored(fingerprints(known.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).withColumn("_sha", F.unhex(F.sha2(text_of("_text"), 256))), ["_id", "_sha"], text_of("_text")), "fingerprints")
    first = rows.groupBy("fingerprint").agg(F.min(F.struct("_id", "_sha")).alias("least")).join(rooted(rows).hint("merge"), F.col("fingerprint") == F.col("fp"))
    stay = first.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least._id").alias(STAY[0]), F.col("least._sha").alias(STAY[1]))
    return survivors(docs, stay, id_col, sha, rows.select(F.col("_id").alias(STAY[0]), F.col("_sha").alias(STAY[1])))
