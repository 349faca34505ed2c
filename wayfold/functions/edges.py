"""Single edges, walks and platforms of a street graph as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .street import seconds


def car_step(length: Column, car: Column, foot: Column, walking: Column) -> Column:
    """(seconds, walking) of an edge for one who drives and then walks; null where neither is allowed. Once left behind, the car stays there."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    step = lambda mode, on_foot: F.struct(seconds(length, mode).alias("seconds"), F.lit(on_foot).alias("walking"))
    return F.when(yes(car) & ~yes(walking), step("car", False)).when(yes(foot), step("foot", True))


def bike_edge_cost(length: Column, factor: Column, cosine: Column, on_route: Column, turn: float) -> Column:
    """Metres times their factor, and up to turn for a change of direction.

    A null factor is an impassable edge. cosine is that of the directions of the edge before and
    of this one, null at the begin; on a cycle route turns cost nothing.
    """
    bend = turn * (1 - F.greatest(F.least(cosine, F.lit(1.0)), F.lit(-1.0))) / 2
    return length * factor + F.when(F.coalesce(on_route, F.lit(False)) | cosine.isNull(), 0.0).otherwise(bend)


def simple_walk(nodes: Column) -> Column:
    """An array of nodes without its loops: where a node comes again, all since its first visit goes."""
    first = F.slice(nodes, 1, 0)
    return F.aggregate(nodes, first, lambda kept, n: F.when(F.array_contains(kept, n), F.slice(kept, F.lit(1), F.array_position(kept, n).cast("int"))).otherwise(F.array_append(kept, n)))


def platform_refs(ref: Column, local_ref: Column) -> Column:
    """The labels of a platform: both tags, cut at semicolons, each label once and in order."""
    labels = lambda tag: F.transform(F.split(F.coalesce(tag, F.lit("")), ";"), lambda x: F.trim(x))
    return F.array_distinct(F.filter(F.concat(labels(ref), labels(local_ref)), lambda x: x != ""))


def platform_level(level: Column) -> Column:
    """The first of the levels named; null where it is no number."""
    return F.trim(F.split(level, ";")[0]).try_cast("float").cast("double")
