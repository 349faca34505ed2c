"""Address registers in XML, through Spark's own reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str, schema: str, row_tag: str = "address") -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def names(rows: DataFrame, key: str = "id", name: str = "name", language: str = "lang", first: str = "fr") -> DataFrame:
    """key, display, aliases: names in several languages as one row; the first language shows if there is one."""
    best = F.min(F.struct((F.col(language) != first).alias("other"), F.col(name).alias("name")))
    return rows.groupBy(key).agg(best["name"].alias("display"), F.array_sort(F.collect_set(name)).alias("aliases"))


def addresses(rows: DataFrame, streets: DataFrame, towns: DataFrame, box: tuple[float, float, float, float]) -> tuple[DataFrame, DataFrame]:
    """Rows (street_id, town_id, house, pos as "x y") with names and coordinates, and how many were dropped for which reason."""
    place = F.split(F.trim("pos"), r"\s+")
    x, y = F.expr("try_cast(get(_p, 0) as double)"), F.expr("try_cast(get(_p, 1) as double)")
    named = rows.withColumn("_p", place).withColumn("x", x).withColumn("y", y).drop("_p").join(streets.select(F.col("id").alias("street_id"), F.col("display").alias("street")), "street_id", "left").join(towns.select(F.col("id").alias("town_id"), F.col("display").alias("municipality")), "town_id", "left")
    reason = F.when(F.col("street").isNull(), "no_street").when(F.col("x").isNull() | F.col("y").isNull(), "no_position").when((F.col("x") == 0) & (F.col("y") == 0), "origin").when(~(F.col("x").between(box[0], box[2]) & F.col("y").between(box[1], box[3])), "outside")
    judged = named.withColumn("reason", reason)
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null").groupBy("reason").count()


def postcodes(rows: DataFrame) -> DataFrame:
    """namespace, postcode: the codes of a postal register (code: objectIdentifier, namespace), each once; records without one are left out."""
    code = rows.select(F.coalesce("code.namespace", F.lit("")).alias("namespace"), F.col("code.objectIdentifier").alias("postcode"))
    return code.where("postcode is not null").distinct()
