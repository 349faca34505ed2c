"""Best-fit decreasing packing into sequences of a fixed number of tokens.

Lengths are whole numbers up to the capacity, so what the packing depends on is only how many
pieces have each length: a table whose size the capacity bounds. Best-fit decreasing runs on
that table, whole groups of equal pieces and equal bins at a time, and gives ranges: the pieces
of one length with these ranks go to the bins with these numbers, at this offset. Pieces then
find their places by length and rank, where they are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe
from .common import small_batches, stored, text_of

CAPACITY = 2048
#: The id that ends each document.
END = 0


class Capacities:
    """A segment tree over remaining capacities: the tightest one that has open bins and holds a length, in logarithmic time."""

    def __init__(self, capacity: int):
        self._leaves = 1 << capacity.bit_length()
        self._open = np.zeros(2 * self._leaves, bool)

    def set(self, remaining: int, is_open: bool) -> None:
        node = self._leaves + remaining
        self._open[node] = is_open
        while node > 1:
            node //= 2
            self._open[node] = self._open[2 * node] or self._open[2 * node + 1]

    def tightest(self, length: int) -> int:
        """The least open remaining capacity of length or more; -1 if there is none."""
        node = self._leaves + length
        if self._open[node]:
            return length
        while node > 1:
            if node % 2 == 0 and self._open[node + 1]:
                node += 1
                break
            node //= 2
        else:
            return -1
        while node < self._leaves:
            node = 2 * node if self._open[2 * node] else 2 * node + 1
        return node - self._leaves


def best_fit_decreasing(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Ranges (length, first rank, number of pieces, first bin, offset) of best-fit decreasing.

    counts has how many pieces there are of each length from 1 to capacity. Ranks count the
    pieces of one length from 0; bins count from 0. Bins with the same room left are
    interchangeable, so that a run of them takes a run of equal pieces at once.
    """
    tree, room, out, bins = Capacities(capacity), {}, [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        if not 0 < length <= capacity:
            raise ValueError(f"no bin holds a piece of length {length}")
        while left:
            free = tree.tightest(length)
            if free < 0:
                per = capacity // length  # a new bin takes the next pieces too, as the tightest one that holds them
                full, rest = divmod(left, per)
                for slot in range(per):
                    n = full + (slot < rest)
                    if n:
                        out.append((length, rank, n, bins, slot * length))
                        rank += n
                for held, first, n in ((per, bins, full), (rest, bins + full, 1 if rest else 0)):
                    if n and capacity - held * length:
                        room.setdefault(capacity - held * length, []).append((first, n))
                        tree.set(capacity - held * length, True)
                bins += full + (rest > 0)
                left = 0
                continue
            first, n = room[free].pop()
            take = min(n, left)
            if n > take:
                room[free].append((first + take, n - take))
            if not room[free]:
                tree.set(free, False)
            out.append((length, rank, take, first, capacity - free))
            rank, left = rank + take, left - take
            if free - length:
                room.setdefault(free - length, []).append((first, take))
                tree.set(free - length, True)
    return out


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents: id, piece, start, length, ids_crc32, and part and nth, the place among the part's pieces of that length.

    A document's ids end with END. One that is longer than capacity is cut into pieces of
    capacity tokens, of which the first may be shorter. Null texts count as empty and make a
    piece of one token.
    """
    tokenizer = tokenizer or bpe.default_tokenizer()
    small_batches(docs.sparkSession)
    end = np.array([END], "<u4").tobytes()
    names = [id_col, "piece", "start", "length", "ids_crc32", "nth"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = bpe.coder(tokenizer)
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows: list[tuple] = []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = own.encode(text) + end
                total = len(ids) // 4
                first = total % capacity or capacity
                for k, start in enumerate([0, *range(first, total, capacity)]):
                    length = first if k == 0 else capacity
                    rows.append((i, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), seen[length]))
                    seen[length] += 1
            at = np.array(rows, np.int64).reshape(-1, 6)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at[:, 0])), pa.array(at[:, 1].astype(np.int32)), *(pa.array(at[:, j]) for j in range(2, 6))], names)

    schema = T.StructType([docs.schema[id_col], T.StructField("piece", T.IntegerType()), *(T.StructField(n, T.LongType()) for n in names[2:])])
    return docs.select(F.col(id_col), text_of(text_col).alias("_text")).mapInArrow(cut, schema).withColumn("part", F.spark_partition_id())


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """cut with sequence_id and offset instead of part and nth.

    cut must be a stored table, as its parts must not change. A piece's rank among those of
    its length is the number of them in earlier parts plus its place in its own. No task
    gathers the pieces of a length: only counts by part and length meet.
    """
    sizes = cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = sizes.select("part", "length", before.alias("base"))
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = np.array(best_fit_decreasing(counts, capacity), np.int64).reshape(-1, 5)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    shipped = cut.sparkSession.sparkContext.broadcast(plan)  # its size depends on the capacity, not on the number of pieces
    others = [c for c in cut.columns if c not in ("part", "nth")]
    ranked = cut.join(bases, ["part", "length"]).select(*others, (F.col("base") + F.col("nth")).alias("_rank"))
    at_length = others.index("length")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = shipped.value
        edges = {length: slice(*np.searchsorted(ranges[:, 0], [length, length + 1])) for length in np.unique(ranges[:, 0]).tolist()}
        for batch in batches:
            length, rank = batch.column(at_length).to_numpy(), batch.column(len(others)).to_numpy()
            row = np.zeros(len(length), np.int64)
            for value in np.unique(length).tolist():
                own, mask = edges[value], length == value
                row[mask] = own.start + np.searchsorted(ranges[own, 1], rank[mask], "right") - 1
            sequence = ranges[row, 3] + rank - ranges[row, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(ranges[row, 4])], [*others, "sequence_id", "offset"])

    schema = T.StructType([*(cut.schema[c] for c in others), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(place, schema)


def best_fit_packing(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, sequence_id, offset. Empty tables give no rows; repeated rows are packed one by one."""
    return pack(stored(pieces(docs, tokenizer, capacity, id_col, text_col), "pieces"), capacity)
