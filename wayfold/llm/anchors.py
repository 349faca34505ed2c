"""Anchors: positions that equal windows choose alike, found from hashes of short runs."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, stored, text_of

T = TypeVar("T")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of unsigned 64-bit numbers; one to one."""
    h = (h ^ h >> np.uint64(32)) * _MIX
    return h ^ h >> np.uint64(29)


def _sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick over values[i : i + width] for each i where that many are left; runs are doubled, not walked."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = pick(out[:-step], out[step:])
        have += step
    return out


def run_hashes(symbols: np.ndarray, length: int) -> np.ndarray:
    """A hash of symbols[i : i + length] for each i where that many are left; never 0, which anchors() takes for none."""
    if len(symbols) < length:
        return np.zeros(0, np.uint64)
    have, out = 1, symbols.astype(np.uint64)
    multiplier = np.uint64(0xD6E8FEB86659FD93)
    parts: list[tuple[int, np.ndarray]] = [(1, out)]
    while 2 * have <= length:
        with np.errstate(over="ignore"):
            factor = np.uint64(pow(int(multiplier), have, 1 << 64))
            out = out[: len(out) - have] * factor + out[have:]
        have *= 2
        parts.append((have, out))
    total, at = None, 0
    for size, hashes in reversed(parts):
        if length - at >= size:
            n = len(symbols) - length + 1
            piece = hashes[at : at + n]
            factor = np.uint64(pow(int(multiplier), size, 1 << 64))
            total = piece.copy() if total is None else total * factor + piece
            at += size
    return np.maximum(mixed(total), np.uint64(1))


def anchors(hashes: np.ndarray, width: int, valid: np.ndarray) -> np.ndarray:
    """Whether each position has the least hash of some window of `width` positions.

    valid tells of each window, by its first position, whether it counts. Equal windows have
    their least hash at equal places, so they have their anchors there.
    """
    if len(hashes) < width:
        return np.zeros(len(hashes), bool)
    least = np.where(valid[: len(hashes) - width + 1], _sliding(hashes, width, np.minimum), np.uint64(0))
    padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    return (_sliding(padded, width, np.maximum) == hashes) & (hashes != 0)


def counted(shard: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
    """shard, key, n: how often each pair stands in the arrays."""
    order = np.lexsort((key, shard))
    shard, key = shard[order], key[order]
    first = np.ones(len(order), bool)
    first[1:] = (shard[1:] != shard[:-1]) | (key[1:] != key[:-1])
    at = np.nonzero(first)[0]
    n = np.diff(np.append(at, len(order)))
    return pa.RecordBatch.from_arrays([pa.array(shard[at].astype(np.int32)), pa.array(key[at].astype(np.int64)), pa.array(n.astype(np.int32))], ["shard", "key", "n"])


def dealt(docs: DataFrame, id_col: str, text_col: str, shard_bytes: int) -> DataFrame:
    """shard, _id, _text: documents dealt out by a hash of id and text to shards of about so many bytes, or one document."""
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    shard = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(max(1, math.ceil(total / shard_bytes)))).cast("int")
    return docs.select(shard.alias("shard"), F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))


def confirmed(counts: DataFrame) -> DataFrame:
    """shard, key: of the keys that shards have (shard, key, n), those that the corpus has twice or more, for each shard that has them.

    Counts are pre-aggregated and their sums are stored, so that the join back may be split
    where a key is in every shard.
    """
    counts = stored(counts, "keys")
    recurring = stored(counts.groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key"), "recurring")
    return counts.select("shard", "key").join(recurring, "key").select("shard", "key")


def delivered(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """shard, key, _id, _text: each shard's confirmed keys (the rest is null), and after them its documents (key is null)."""
    own = keys.select("shard", "key", F.lit(None).cast(docs.schema["_id"].dataType).alias("_id"), F.lit(None).cast("string").alias("_text"))
    both = own.unionByName(docs.select("shard", F.lit(None).cast("long").alias("key"), "_id", "_text"))
    return both.repartition("shard").sortWithinPartitions("shard", F.col("key").isNull())


def by_shard(batches: Iterator[pa.RecordBatch], compiled: Callable[[np.ndarray], T], limit: int) -> Iterator[tuple[T, pa.RecordBatch]]:
    """What `compiled` makes of each shard's keys, with slices of its documents (_id, _text) of at most `limit` bytes of text or one document."""
    shard, keys, made = None, [], None
    for batch in batches:
        of, is_key = batch.column(0).to_numpy(), batch.column(1).is_valid().to_numpy(zero_copy_only=False)
        cuts = np.nonzero((of[1:] != of[:-1]) | (is_key[1:] != is_key[:-1]))[0] + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(of)], strict=True):
            if a == b:
                continue
            if of[a] != shard:
                shard, keys, made = of[a], [], None
            if is_key[a]:
                keys.append(batch.column(1).slice(a, b - a).to_numpy(zero_copy_only=False).astype(np.int64))
                continue
            if made is None:
                made = compiled(np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64))
                keys = []
            rows = batch.slice(a, b - a)
            for part in bounded([pa.RecordBatch.from_arrays([rows.column(2), rows.column(3)], ["_id", "_text"])], 1, limit):
                yield made, part


def chosen_windows(at: np.ndarray, hashes: np.ndarray, reach: int, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """first, last: for each anchor the run of windows, between begin and end, that choose it; first > last where none does.

    at and hashes are those of all anchors in order. A window looks at the positions from its
    first to reach further on, and chooses the leftmost of least hash: an anchor itself from
    where no anchor before it has a hash as small up to where none after it has a smaller one.
    """
    first, last = np.maximum(at - reach, begin), np.minimum(at, end)
    for step in range(1, len(at)):
        near = np.nonzero(at[step:] - at[:-step] <= reach)[0]
        if not len(near):
            break
        i, j = near, near + step
        left = hashes[i] <= hashes[j]  # the one before wins ties
        np.maximum.at(first, j[left], at[i[left]] + 1)
        np.minimum.at(last, i[~left], at[j[~left]] - reach - 1)
    return first, last
