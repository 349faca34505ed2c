"""Connected components of links by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the links u-v, each node that isn't the least of its component with the least one."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], least)
        np.minimum.at(new, root[b], least)
        new = new[new]
        if (new == root).all():
            break
        root = new
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of a batch's links."""
    for batch in batches:
        u, v = forest(batch.column(0).to_numpy(), batch.column(1).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def components(links: DataFrame) -> DataFrame:
    """node, root (the least node reachable) for every node of links (u, v: long) that isn't a root.

    A round joins each node's larger neighbours to its least one, then its smaller ones, until
    nothing changes; the number of rounds grows with the logarithm of the number of nodes. What
    a node's neighbours have in common is pre-aggregated. The joins back sort both sides, as there
    may be as many least neighbours as nodes, too many for the driver to broadcast.
    Links from a node to itself and repeated links change nothing.
    """
    edges = links.where("u != v").select("u", "v").mapInArrow(_local, "u long, v long").distinct()
    edges, before = stored(edges, "links"), None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.hint("merge"), "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, edges = edges, stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        discard(old)
        before = tuple(state)
