"""Selections that depend on what was selected before, one bounded group at a time in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def representatives(rows: DataFrame, group: str, key: str, axes: list[str], k: int = 6) -> DataFrame:
    """group, key, rank: the least of each axis, then whichever lies farthest from all taken, up to k.

    Axes are scaled to their range in the group; ties take the smaller key.
    """

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        x = pdf[axes].to_numpy(float)
        width = x.max(0) - x.min(0)
        x = (x - x.min(0)) / np.where(width > 0, width, 1)
        taken: list[int] = []
        for j in range(len(axes)):
            i = int(np.argmin(x[:, j]))
            if i not in taken and len(taken) < k:
                taken.append(i)
        while len(taken) < min(k, len(x)):
            far = np.min(np.abs(x[:, None, :] - x[taken][None, :, :]).sum(2), axis=1)
            far[taken] = -1
            i = int(np.argmax(far))
            if far[i] <= 0:
                break
            taken.append(i)
        return pd.DataFrame({group: pdf[group].iloc[0], key: pdf[key].to_numpy()[taken], "rank": np.arange(len(taken), dtype=np.int32)})

    schema = T.StructType([rows.schema[group], rows.schema[key], T.StructField("rank", T.IntegerType())])
    return rows.select(group, key, *axes).groupBy(group).applyInPandas(pick, schema)


def diverse(options: DataFrame, edges: DataFrame, group: str, most: float = 0.6) -> DataFrame:
    """group, path: in the order of rank, paths whose common length with each one kept is at most a share of the shorter."""

    def pick(own: pd.DataFrame, used: pd.DataFrame) -> pd.DataFrame:
        by_path = {p: dict(zip(g["edge"], g["metres"], strict=True)) for p, g in used.groupby("path")}
        kept: list = []
        for p in own.sort_values(["rank", "path"])["path"]:
            mine = by_path.get(p, {})
            if all(sum(m for e, m in mine.items() if e in by_path.get(q, {})) <= most * min(sum(mine.values()), sum(by_path.get(q, {}).values())) for q in kept):
                kept.append(p)
        return pd.DataFrame({group: own[group].iloc[0] if len(own) else pd.Series(dtype="int64"), "path": kept})

    schema = T.StructType([options.schema[group], options.schema["path"]])
    return options.select(group, "path", "rank").groupBy(group).cogroup(edges.select(group, "path", "edge", "metres").groupBy(group)).applyInPandas(pick, schema)


def overtaking_split(stop_times: DataFrame, pattern: str) -> DataFrame:
    """pattern, trip, chain: trips in the order of first departure, each in the first chain whose last trip departs no later at every stop."""

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        times = pdf.pivot(index="trip", columns="pos", values="dep").sort_index()
        order = times.sort_values(list(times.columns), kind="stable").index
        order = sorted(order, key=lambda t: (times.loc[t].iloc[0], t))
        last: list[np.ndarray] = []
        out = []
        for trip in order:
            own = times.loc[trip].to_numpy()
            for i, before in enumerate(last):
                if (before <= own).all():
                    last[i] = own
                    break
            else:
                i = len(last)
                last.append(own)
            out.append((pdf[pattern].iloc[0], trip, i))
        return pd.DataFrame(out, columns=[pattern, "trip", "chain"])

    schema = T.StructType([stop_times.schema[pattern], stop_times.schema["trip"], T.StructField("chain", T.IntegerType())])
    return stop_times.select(pattern, "trip", "pos", "dep").groupBy(pattern).applyInPandas(split, schema)


def smooth_profile(points: DataFrame, epsilon: float = 4.0) -> DataFrame:
    """way, seq, height: heights simplified by Ramer-Douglas-Peucker in (along, height), then interpolated back at every point.

    Ways are short and many: each is a row of arrays, and a batch of them is one call.
    """
    line = F.array_sort(F.collect_list(F.struct("seq", F.col("along").cast("double").alias("along"), F.col("height").cast("double").alias("height"))))
    ways = points.groupBy("way").agg(line.alias("line")).select("way", F.col("line.seq").alias("seq"), F.col("line.along").alias("along"), F.col("line.height").alias("height"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_simplified(np.array(x), np.array(y), epsilon).tolist() for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.float64()))], ["way", "seq", "height"])

    schema = T.StructType([points.schema["way"], T.StructField("seq", T.ArrayType(points.schema["seq"].dataType)), T.StructField("height", T.ArrayType(T.DoubleType()))])
    return ways.mapInArrow(run, schema).select("way", F.explode(F.arrays_zip("seq", "height")).alias("p")).select("way", "p.seq", "p.height")


def _simplified(x: np.ndarray, y: np.ndarray, epsilon: float) -> np.ndarray:
    keep, stack = {0, len(x) - 1}, [(0, len(x) - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        dx, dy = x[b] - x[a], y[b] - y[a]
        norm = np.hypot(dx, dy)
        px, py = x[a + 1 : b] - x[a], y[a + 1 : b] - y[a]
        far = np.abs(dy * px - dx * py) / norm if norm else np.hypot(px, py)
        i = int(np.argmax(far))
        if far[i] > epsilon:
            keep.add(a + 1 + i)
            stack += [(a, a + 1 + i), (a + 1 + i, b)]
    at = sorted(keep)
    return np.interp(x, x[at], y[at])
