"""Delay distributions as arrays of (delay, cum): signed delays in seconds, ascending, and cumulative probabilities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The default edges of reliability buckets, and from where a connection is certain.
EDGES, CERTAIN = (0.50, 0.80, 0.95), 0.99


def on_time(bins: Column, margin: Column) -> Column:
    """P(delay <= margin): the last cumulative value at or below the margin, 0 before the first."""
    return F.aggregate(bins, F.lit(0.0), lambda acc, b: F.when(b["delay"] <= margin, b["cum"]).otherwise(acc))


def mass(bins: Column) -> Column:
    """(delay, p) of each bin: first differences of the distribution."""
    return F.transform(bins, lambda b, i: F.struct(b["delay"].alias("delay"), (b["cum"] - F.when(i > 0, F.get(bins, i - 1)["cum"]).otherwise(0.0)).alias("p")))


def at_least(bins: Column, seconds: Column) -> Column:
    """P(delay >= seconds)."""
    return F.aggregate(mass(bins), F.lit(0.0), lambda acc, b: acc + F.when(b["delay"] >= seconds, b["p"]).otherwise(0.0))


def on_time_vs(feeder: Column, boarded: Column, margin: Column) -> Column:
    """P(feeder's delay <= margin + boarded vehicle's delay), over the boarded vehicle's bins."""
    return F.aggregate(mass(boarded), F.lit(0.0), lambda acc, b: acc + b["p"] * on_time(feeder, margin + b["delay"]))


def bucket(p: Column, edges: tuple[float, ...] = EDGES) -> Column:
    """The number of edges at or below p; one more from CERTAIN on."""
    return F.when(p >= CERTAIN, F.lit(len(edges) + 1)).otherwise(sum((F.when(p >= e, 1).otherwise(0) for e in edges), F.lit(0)))


def expected(bag: Column) -> Column:
    """Mean of (time, p), times without probability left out; null where nothing has any."""
    total = F.aggregate(bag, F.lit(0.0), lambda acc, b: acc + b["p"])
    return F.when(total > 0, F.aggregate(bag, F.lit(0.0), lambda acc, b: acc + b["p"] * b["time"]) / total)


def scenarios(hit: Column, p_hit: Column, miss: Column) -> Column:
    """Two-point distribution in the order of time; without a miss only the hit."""
    two = F.array_sort(F.array(F.struct(hit.alias("time"), p_hit.alias("p")), F.struct(miss.alias("time"), (1 - p_hit).alias("p"))))
    return F.when(miss.isNull() | (p_hit >= 1), F.array(F.struct(hit.alias("time"), p_hit.alias("p")))).otherwise(two)


def risk_class(p: Column) -> Column:
    return F.when(p.isNull(), None).when(p >= 0.8, "high").when(p >= 0.5, "mid").otherwise("low")
