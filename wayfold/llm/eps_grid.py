"""Embedding near-dedup: a join in epsilon grid order.

Unit vectors whose cosine is at least the threshold are at most epsilon apart, and so are
their images on any axes. Vectors are sorted by their grid cells of that width on the leading
principal axes. Intervals of the sorted sequence are joined from the whole down: a pair whose
boxes are more than epsilon apart is skipped with all that it holds, any other one is split, on
the machines down to blocks and inside a pair of blocks down to pieces. Of a pair of pieces the
images on a few more axes are compared first, and what they leave in full.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, stored
from .components import components, forest

THRESHOLD = 0.95
#: Principal axes that make the grid, and that are compared before all; vectors in a block, blocks in a part of the sequence, vectors in a piece that is multiplied out.
AXES, TRIAL_AXES = 4, 16
BLOCK = 2048
PART_BLOCKS = 4
PIECE = 256
#: Intervals that one of the next level holds, and blocks that one is sent to another's task for at once.
FAN = 16


def epsilon(threshold: float) -> float:
    """How far apart unit vectors of that cosine are, with room for rounding."""
    return math.sqrt(2 - 2 * threshold) + 1e-9


def valid(column: str) -> Column:
    """Whether a vector has components, all of them finite numbers, and not only zeros."""
    x = F.col(column)
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(x.isNotNull() & (F.size(x) > 0) & fine & F.exists(x, lambda v: v != 0), F.lit(False))


def _unit(out: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision."""
    out = out.astype(np.float64)
    if len(out):
        out /= np.abs(out).max(axis=1, keepdims=True)
        out /= np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as they are, shorter ones filled with zeros, and how long each was."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width), np.float32 if flat.dtype == np.float32 else np.float64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out, sizes


def principal_axes(classes: DataFrame, width: int, axes: int = AXES) -> np.ndarray:
    """The leading principal axes of all unit vectors: width rows, a column per axis. What comes to the driver is a matrix of that width."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width + 1, width + 1))
        for batch in batches:
            unit = _unit(_matrix(batch.column(0), width)[0])
            one = np.concatenate([unit, np.ones((len(unit), 1))], axis=1)
            total += one.T @ one
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["k", "v"])

    rows = classes.select("x").mapInArrow(sums, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).toArrow()
    total = np.zeros((width + 1) ** 2)
    if rows.num_rows:
        total[rows.column("k").to_numpy()] = rows.column("v").to_numpy()
    total = total.reshape(width + 1, width + 1)
    n = max(total[-1, -1], 1)
    mean = total[-1, :-1] / n
    _, vectors = np.linalg.eigh(total[:-1, :-1] / n - np.outer(mean, mean))
    return vectors[:, ::-1][:, :axes]


def blocks(classes: DataFrame, width: int, axes: np.ndarray, eps: float) -> DataFrame:
    """Blocks of the sequence in grid order: block (its number), low and high (its box on the axes), and its vectors, as they are, with their ids, sizes of class and lengths."""
    n_axes = axes.shape[1]
    kind = classes.schema["x"].dataType.simpleString()

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _unit(_matrix(batch.column(2), width)[0]) @ axes
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(np.floor(at / eps).astype(np.int32)), pa.list_(pa.int32())), pa.array(list(at), pa.list_(pa.float64()))], ["id", "n", "x", "cell", "at"])

    placed = classes.select("id", "n", "x").mapInArrow(cells, f"id long, n long, x {kind}, cell array<int>, at array<double>")
    parts = max(1, math.ceil(classes.count() / (PART_BLOCKS * BLOCK)))
    ordered = placed.repartitionByRange(parts, "cell", "at").sortWithinPartitions("cell", "at", "id").coalesce(parts)  # neighbouring ranges stay together: blocks are full however many ranges there are

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def emit(rows: pa.Table) -> pa.RecordBatch:
            at = np.array(rows.column("at").combine_chunks().flatten()).reshape(-1, n_axes)
            raw, sizes = _matrix(rows.column("x").combine_chunks(), width)
            column = lambda name: pa.array([rows.column(name).to_numpy().astype(np.int64).tobytes()], pa.binary())
            return pa.RecordBatch.from_arrays(
                [pa.array([at.min(0)], pa.list_(pa.float64())), pa.array([at.max(0)], pa.list_(pa.float64())), column("id"), column("n"), pa.array([sizes.astype(np.int32).tobytes()], pa.binary()), pa.array([raw.tobytes()], pa.binary())],
                ["low", "high", "ids", "ns", "sizes", "vectors"],
            )

        for batch in batches:
            held.append(batch)
            while sum(b.num_rows for b in held) >= BLOCK:
                rows = pa.Table.from_batches(held)
                yield emit(rows.slice(0, BLOCK))
                held = rows.slice(BLOCK).to_batches()
        if sum(b.num_rows for b in held):
            yield emit(pa.Table.from_batches(held))

    schema = "low array<double>, high array<double>, ids binary, ns binary, sizes binary, vectors binary"
    made = stored(ordered.mapInArrow(cut, schema).withColumn("_id", F.monotonically_increasing_id()), "blocks")
    counts = sorted(map(tuple, made.groupBy(F.shiftright("_id", 33).alias("part")).agg(F.count(F.lit(1))).collect()))  # a row for each part of the sequence
    before = [(part, sum(n for _, n in counts[:i])) for i, (part, _) in enumerate(counts)]
    offsets = F.broadcast(made.sparkSession.createDataFrame(before, "_part long, _before long"))
    return made.join(offsets, F.shiftright("_id", 33) == F.col("_part")).withColumn("block", F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id", "_part", "_before")


def near_pairs(made: DataFrame, eps: float) -> DataFrame:
    """a, b: pairs of blocks, a <= b, whose boxes are within eps.

    Levels of intervals are made from the blocks up, each interval with the box of FAN of the
    level below, until FAN or fewer are left. Pairs come from there down: those whose boxes are
    near are split into pairs of what they hold, by joins with the level below.
    """
    box = stored(made.select("block", "low", "high"), "boxes")
    n_axes = len(box.select("low").first()[0]) if not box.isEmpty() else 1
    levels = [box]
    while levels[-1].count() > FAN:
        ends = [F.array(*[f(F.col(c)[k]) for k in range(n_axes)]).alias(c) for f, c in ((F.min, "low"), (F.max, "high"))]
        levels.append(stored(levels[-1].groupBy(F.floor(F.col("block") / FAN).alias("block")).agg(*ends), "boxes"))
    gap = lambda x: F.greatest(x["lb"] - x["ha"], x["la"] - x["hb"], F.lit(0.0))
    apart = F.aggregate(F.arrays_zip("la", "ha", "lb", "hb"), F.lit(0.0), lambda acc, x: acc + gap(x) * gap(x))
    side = lambda level, of: level.select(F.col("block").alias(of), F.col("low").alias(f"l{of}"), F.col("high").alias(f"h{of}"), F.floor(F.col("block") / FAN).alias(f"_{of}"))
    pairs = box.sparkSession.createDataFrame([(0, 0)], "a long, b long")  # the whole with itself
    for level in reversed(levels):
        wider = pairs.select(F.col("a").alias("_a"), F.col("b").alias("_b"))
        near = wider.join(side(level, "a"), "_a").join(side(level, "b"), "_b").where((F.col("a") <= F.col("b")) & (apart <= eps * eps))
        pairs = stored(near.select("a", "b"), "pairs")
    return pairs


class _Side:
    """A block's vectors, of length one, and their images on the axes."""

    def __init__(self, axes: np.ndarray, n_axes: int, kind: type, ids: bytes, ns: bytes, sizes: bytes, vectors: bytes):
        self.ids, self.ns, self.sizes = np.frombuffer(ids, np.int64), np.frombuffer(ns, np.int64), np.frombuffer(sizes, np.int32)
        self.units = _unit(np.frombuffer(vectors, kind).reshape(-1, len(axes)))
        image = self.units @ axes
        self.ats, self.trial = image[:, :n_axes], image.astype(np.float32)
        self.squares = (self.trial * self.trial).sum(axis=1)


def join_intervals(a: _Side, b: _Side, same: bool, threshold: float, eps: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of linked vectors in a and b. If both are one block, each pair comes once."""
    stack = [(0, len(a.ids), 0, len(b.ids))]
    most = np.float32(eps * eps + 1e-4)  # room for the rounding of single precision
    while stack:
        i, j, k, l = stack.pop()
        if i >= j or k >= l or (same and i >= l):
            continue
        x, y = a.ats[i:j], b.ats[k:l]
        apart = np.maximum(np.maximum(y.min(0) - x.max(0), x.min(0) - y.max(0)), 0)
        if (apart * apart).sum() > eps * eps:
            continue
        if max(j - i, l - k) > PIECE:
            p, q = (i + j) // 2, (k + l) // 2
            stack += [(i, p, k, q), (i, p, q, l), (p, j, k, q), (p, j, q, l)]
            continue
        u, v = np.nonzero(a.squares[i:j, None] + b.squares[None, k:l] - 2 * (a.trial[i:j] @ b.trial[k:l].T) <= most)
        u, v = u + i, v + k
        keep = a.sizes[u] == b.sizes[v]
        if same:
            keep &= u < v
        u, v = u[keep], v[keep]
        close = np.concatenate([np.einsum("ij,ij->i", a.units[u[s : s + 4096]], b.units[v[s : s + 4096]]) for s in range(0, len(u), 4096)] or [np.zeros(0)]) >= threshold
        if close.any():
            yield u[close], v[close]


def linked(made: DataFrame, axes: np.ndarray, n_axes: int, kind: type, threshold: float, eps: float) -> DataFrame:
    """u, v, n: for each pair of blocks, (u, null, n) with how many vectors of the other class sizes u links with, and a spanning forest of the links (u, v, null).

    A block goes once to each task that compares it with up to FAN others of the sequence.
    """
    made = stored(made, "numbered")
    pairs = near_pairs(made, eps)
    parts = ["ids", "ns", "sizes", "vectors"]
    group = F.floor(F.col("b") / FAN).alias("g")
    own = pairs.select("a", group).distinct().join(made.select(F.col("block").alias("a"), *parts), "a").select("a", "g", F.lit(None).cast("long").alias("b"), *parts)
    others = pairs.select("a", "b", group).join(made.select(F.col("block").alias("b"), *parts), "b").select("a", "g", "b", *parts)
    rows = own.unionByName(others).repartition("a", "g").sortWithinPartitions("a", "g", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = None
        for batch in batches:
            for one, _, other, *data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                b = _Side(axes, n_axes, kind, *data)
                if other is None:
                    a = b
                    continue
                of_a, of_b = np.zeros(len(a.ids), np.int64), np.zeros(len(b.ids), np.int64)
                tree_u, tree_v = np.zeros(0, np.int64), np.zeros(0, np.int64)
                for u, v in join_intervals(a, b, one == other, threshold, eps):
                    np.add.at(of_a, u, b.ns[v])
                    np.add.at(of_b, v, a.ns[u])
                    more = forest(a.ids[u], b.ids[v])
                    tree_u, tree_v = np.concatenate([tree_u, more[0]]), np.concatenate([tree_v, more[1]])
                if len(tree_u):
                    tree_u, tree_v = forest(tree_u, tree_v)
                found_a, found_b = np.nonzero(of_a)[0], np.nonzero(of_b)[0]
                us = np.concatenate([a.ids[found_a], b.ids[found_b], tree_u])
                ns = np.concatenate([of_a[found_a], of_b[found_b]])
                yield pa.RecordBatch.from_arrays([pa.array(us), pa.array([None] * len(ns) + tree_v.tolist(), pa.int64()), pa.array(ns.tolist() + [None] * len(tree_v), pa.int64())], ["u", "v", "n"])

    return rows.mapInArrow(run, "u long, v long, n long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: id, n_links, component_id, kept.

    Rows link when the cosine of their vectors in double precision reaches the threshold. Equal
    vectors are one class before any comparison: they link with each other, and a class that
    links with another does so for all its rows, so copies are never expanded into pairs.
    Vectors that are null or empty, have only zeros, or hold null or non-finite components
    link with nothing; vectors of different lengths don't link. Rows with a null id count as
    links of others and have the component of their class, null where no vector with an id can
    be reached. Empty tables give no rows.
    """
    small_batches(vectors.sparkSession)
    eps = epsilon(threshold)
    rows = vectors.select(F.col(id_col), F.col(vector_col).alias("x"))
    grouped = rows.where(valid("x")).groupBy("x").agg(F.min(id_col).cast("long").alias("id"), F.count(F.lit(1)).alias("n"))
    classes = stored(grouped.select(F.coalesce("id", F.xxhash64("x")).alias("id"), F.col("id").isNull().alias("nameless"), "n", "x"), "classes")  # a class without any id is named by its vector
    width = classes.agg(F.max(F.size("x"))).first()[0] or 1
    axes = principal_axes(classes, width, min(TRIAL_AXES, width))
    n_axes = min(AXES, width)
    kind = np.float32 if isinstance(classes.schema["x"].dataType.elementType, T.FloatType) else np.float64
    made = blocks(classes, width, axes[:, :n_axes], eps)
    found = stored(linked(made, axes, n_axes, kind, threshold, eps), "linked")
    counts = found.where("n is not null").groupBy("u").agg(F.sum("n").alias("others"))
    roots = components(found.where("v is not null").select("u", "v"))
    rooted = classes.join(counts, F.col("id") == F.col("u"), "left").join(roots, F.col("id") == F.col("node"), "left").select("x", "id", "nameless", F.coalesce("root", "id").alias("root"), (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    smallest = rooted.where("not nameless").groupBy("root").agg(F.min("id").alias("component_id"))
    known = rooted.join(smallest, "root", "left").select("x", "n_links", "component_id")
    good = rows.where(valid("x")).join(known, "x", "left")
    alone = rows.where(~valid("x")).select("x", id_col, F.lit(0).cast("long").alias("n_links"), F.col(id_col).cast("long").alias("component_id"))
    both = good.select("x", id_col, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id").unionByName(alone)
    return both.select(id_col, "n_links", "component_id", F.col(id_col).cast("long").eqNullSafe(F.col("component_id")).alias("kept"))
