"""Reachability on a lattice around stops: fields, windows, contours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def window_departures(start: int, end: int, step: int = 600) -> list[int]:
    """Sampled departures; the end is always one."""
    return sorted({*range(start, end + 1, step), end})


def field(arrivals: DataFrame, stops: DataFrame, most: int, step_seconds: int) -> DataFrame:
    """request, gr, gc, seconds: the least travel time to lattice cells within the budget.

    arrivals has request, stop, seconds. What is left of the budget says how many steps a stop
    reaches. Steps along rows and along columns add up, so rows are spread first and columns
    after, each with a pre-aggregated minimum.
    """
    field = arrivals.where(F.col("seconds") <= most).join(stops.select("stop", "gr", "gc"), "stop").select("request", "gr", "gc", "seconds")
    for axis in ("gr", "gc"):
        steps = ((F.lit(most) - F.col("seconds")) / step_seconds).cast("int")
        spread = field.withColumn("_by", F.explode(F.sequence(-steps, steps)))
        field = spread.select("request", *[(F.col(c) + F.col("_by")).alias(c) if c == axis else F.col(c) for c in ("gr", "gc")], (F.col("seconds") + F.abs("_by") * step_seconds).cast("int").alias("seconds")).groupBy("request", "gr", "gc").agg(F.min("seconds").alias("seconds"))
    return field


def best(fields: DataFrame) -> DataFrame:
    return fields.groupBy("gr", "gc").agg(F.min("seconds").alias("seconds"))


def average(fields: DataFrame, samples: int, most: int) -> DataFrame:
    """Whole mean over the samples; those that don't reach a cell count as the budget."""
    return fields.groupBy("gr", "gc").agg(F.expr(f"cast((sum(seconds) + ({samples} - count(*)) * {most}) div {samples} as int)").alias("seconds"))


def grid(cells: DataFrame) -> DataFrame:
    """Cells with dense indices of their rows and columns; the least value where a cell repeats."""
    one = cells.groupBy("gr", "gc").agg(F.min("seconds").alias("seconds"))
    rows = one.select("gr").distinct().withColumn("i", F.dense_rank().over(Window.orderBy("gr")))
    columns = one.select("gc").distinct().withColumn("j", F.dense_rank().over(Window.orderBy("gc")))  # axes are short
    return one.join(rows, "gr").join(columns, "gc")


def exposed(cells: DataFrame) -> DataFrame:
    """gr, gc, side: borders between cells that are reached and those that aren't."""
    sides = F.array(*[F.struct(F.lit(n).alias("side"), F.lit(r).alias("r"), F.lit(c).alias("c")) for n, r, c in (("n", -1, 0), ("s", 1, 0), ("w", 0, -1), ("e", 0, 1))])
    out = cells.select("gr", "gc", F.explode(sides).alias("s")).select("gr", "gc", "s.side", (F.col("gr") + F.col("s.r")).alias("r"), (F.col("gc") + F.col("s.c")).alias("c"))
    return out.join(cells.select(F.col("gr").alias("r"), F.col("gc").alias("c")), ["r", "c"], "left_anti").select("gr", "gc", "side")


def contour(cells: DataFrame, threshold: int) -> DataFrame:
    """gr, gc, code: squares of four cells that the threshold crosses; bits from the upper left clockwise tell which are within it."""
    corner = lambda name, r, c: cells.select((F.col("gr") - r).alias("gr"), (F.col("gc") - c).alias("gc"), F.col("seconds").alias(name))
    joined = corner("a", 0, 0)
    for name, r, c in (("b", 0, 1), ("c", 1, 1), ("d", 1, 0)):
        joined = joined.join(corner(name, r, c), ["gr", "gc"], "full_outer")
    bit = lambda x, n: F.when(F.col(x) <= threshold, n).otherwise(0)
    return joined.select("gr", "gc", (bit("a", 8) + bit("b", 4) + bit("c", 2) + bit("d", 1)).alias("code")).where("code between 1 and 14")


def sample(cells: DataFrame, points: DataFrame) -> DataFrame:
    """point, seconds: bilinear between four corners at fractional (y, x); where one is missing the nearest that isn't."""
    base = points.select("point", "y", "x", F.floor("y").cast("int").alias("r"), F.floor("x").cast("int").alias("c"))
    corners = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r in (0, 1) for c in (0, 1)])
    four = base.select("point", "y", "x", "r", "c", F.explode(corners).alias("o")).select("point", "y", "x", (F.col("r") + F.col("o.r")).alias("gr"), (F.col("c") + F.col("o.c")).alias("gc"))
    near = four.join(cells, ["gr", "gc"], "left")
    dy, dx = F.abs(F.col("y") - F.col("gr")), F.abs(F.col("x") - F.col("gc"))
    found = near.groupBy("point").agg(F.count("seconds").alias("n"), F.sum(F.col("seconds") * (1 - dy) * (1 - dx)).alias("mix"), F.min(F.when(F.col("seconds").isNotNull(), F.struct((dy * dy + dx * dx).alias("d"), "seconds"))).alias("near"))
    return found.select("point", F.when(F.col("n") == 4, F.col("mix")).otherwise(F.col("near.seconds").cast("double")).alias("seconds"))
