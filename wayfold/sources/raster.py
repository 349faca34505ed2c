"""Elevation tiles as a table (layer, row, col, height): points meet cells by equality."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import lambert_2008


def elevations(points: DataFrame, cells: DataFrame, west: float, north: float, size: float) -> DataFrame:
    """points (point, lat, lon) with the height of their cell in the first layer that has one, null outside."""
    p = lambert_2008(F.col("lat"), F.col("lon"))
    at = points.withColumn("_p", p).withColumn("row", F.floor((north - F.col("_p.north")) / size)).withColumn("col", F.floor((F.col("_p.east") - west) / size)).drop("_p")
    first = cells.where("height is not null").groupBy("row", "col").agg(F.min_by("height", "layer").alias("height"))
    return at.join(first, ["row", "col"], "left").drop("row", "col")


def segment_climbs(found: DataFrame) -> DataFrame:
    """way, seq, delta: rounded climbs between consecutive points of a way, within 16 bits; all zero where a height is missing."""
    order = Window.partitionBy("way").orderBy("seq")
    whole = F.every(F.col("height").isNotNull()).over(Window.partitionBy("way"))
    step = F.lead("height").over(order) - F.col("height")
    made = found.select("way", "seq", F.when(whole, F.least(F.greatest(F.round(step), F.lit(-32768.0)), F.lit(32767.0))).otherwise(0.0).cast("int").alias("delta"), F.lead("seq").over(order).alias("_next"))
    return made.where("_next is not null").drop("_next")


def linear_profile(found: DataFrame) -> DataFrame:
    """way, seq, height: heights on a straight line between a way's ends, by the distance along it; for bridges and tunnels."""
    ends = found.groupBy("way").agg(F.min_by(F.struct("along", "height"), "seq").alias("a"), F.max_by(F.struct("along", "height"), "seq").alias("b"))
    share = (F.col("along") - F.col("a.along")) / (F.col("b.along") - F.col("a.along"))
    return found.drop("height").join(ends, "way").select("way", "seq", F.when(F.col("b.along") == F.col("a.along"), F.col("a.height")).otherwise(F.col("a.height") + (F.col("b.height") - F.col("a.height")) * share).alias("height"))
