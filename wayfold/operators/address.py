"""Address search: tokens, matches, scores.

Records have record, street, municipality (names), house, lat, lon. Streets and towns are
matched by tokens; matching joins by first character, so that vocabularies are never crossed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.geo import haversine

#: Weights of prefix and fuzzy matches, of a town against a street, the boost of an equal house number, and the decay with distance in kilometres.
PREFIX, FUZZY, TOWN, HOUSE = 0.6, 0.4, 0.9, 1.5
OFFSET_KM, HALF_KM, FLOOR = 2.0, 5.0, 0.1
#: Fuzzy matches only where fewer streets match without.
FEW_STREETS = 5


def token_index(records: DataFrame) -> DataFrame:
    """kind, name, token: distinct tokens of streets and municipalities."""
    part = lambda c: records.select(F.lit(c).alias("kind"), F.col(c).alias("name")).distinct()
    return part("street").unionByName(part("municipality")).select("kind", "name", F.explode(text.tokens(F.col("name"))).alias("token")).distinct()


def query_tokens(queries: DataFrame) -> DataFrame:
    """query, i, token, number: the tokens of each query; those that begin with a digit are numbers."""
    return queries.select("query", F.posexplode(text.tokens(F.col("text"))).alias("i", "token")).withColumn("number", F.col("token").rlike("^[0-9]"))


def max_edits(token):
    return F.when(F.length(token) >= 8, 2).when(F.length(token) >= 3, 1).otherwise(0)


def token_matches(asked: DataFrame, index: DataFrame) -> DataFrame:
    """query, i, kind, name, weight, fuzzy: names with a token that equals, begins with or is close to the asked one; the best weight of each."""
    first = lambda c: F.substring(c, 1, 1)
    both = asked.where("not number").select("query", "i", "token", first("token").alias("f")).join(index.select("kind", "name", F.col("token").alias("known"), first("token").alias("f")), "f")
    weight = F.when(F.col("known") == F.col("token"), 1.0).when(F.col("known").startswith(F.col("token")), PREFIX).when((max_edits(F.col("token")) > 0) & (F.levenshtein("known", "token") <= max_edits(F.col("token"))), FUZZY)
    scored = both.withColumn("weight", weight * F.when(F.col("kind") == "municipality", TOWN).otherwise(1.0)).where("weight is not null")
    best = scored.groupBy("query", "i", "kind", "name").agg(F.max("weight").alias("weight"))
    return best.withColumn("fuzzy", F.col("weight") <= FUZZY)


def hits(queries: DataFrame, records: DataFrame, focus: tuple[float, float] | None = None) -> DataFrame:
    """query, record, score, street, municipality: all records of which street or town matches every word and house number every number.

    A record's score is the mean weight of the words, more for an equal house number, less with
    distance from the focus.
    """
    asked = query_tokens(queries)
    words = asked.groupBy("query").agg(F.sum(F.when(F.col("number"), 0).otherwise(1)).alias("words"), F.collect_set(F.when(F.col("number"), F.col("token"))).alias("numbers"))
    found = token_matches(asked, token_index(records))
    places = records.select("street", "municipality").distinct()
    # a factor of each word for each pair of street and town that has one
    of_street = found.where("kind = 'street'").select("query", "i", F.col("name").alias("street"), "weight", "fuzzy").join(places, "street")
    of_town = found.where("kind = 'municipality'").select("query", "i", F.col("name").alias("municipality"), "weight", "fuzzy").join(places, "municipality").select(*of_street.columns)
    factors = of_street.unionByName(of_town)
    sure = factors.where("not fuzzy").groupBy("query", "street", "municipality").agg(F.count_distinct("i").alias("n")).join(words, "query").where("n = words").groupBy("query").agg(F.count_distinct("street").alias("sure"))
    used = factors.join(sure, "query", "left").where((~F.col("fuzzy")) | (F.coalesce("sure", F.lit(0)) < FEW_STREETS))
    best = used.groupBy("query", "street", "municipality", "i").agg(F.max("weight").alias("weight")).groupBy("query", "street", "municipality").agg(F.avg("weight").alias("base"), F.count(F.lit(1)).alias("n"))
    full = best.join(words, "query").where("n = words")
    house = text.normalise(F.col("house"))
    every = full.join(records, ["street", "municipality"]).where(F.forall("numbers", lambda n: house.startswith(n)))
    score = F.col("base") * F.when(F.array_contains("numbers", house), HOUSE).otherwise(1.0)
    if focus is not None:
        km = haversine(F.lit(focus[0]), F.lit(focus[1]), F.col("lat"), F.col("lon")) / 1000
        score = score * decay(km)
    return every.withColumn("score", F.round(score, 9)).select("query", "record", "score", "street", "municipality")


def rank(queries: DataFrame, records: DataFrame, limit: int, focus: tuple[float, float] | None = None) -> DataFrame:
    """query, record, score, rank, street, municipality: the hits of each query up to the limit, best first, then by record."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), "record")
    return hits(queries, records, focus).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("query", "record", "score", "rank", "street", "municipality")


def decay(km):
    scale = (HALF_KM - OFFSET_KM) / 0.6931471805599453
    return F.greatest(F.exp(-F.greatest(km - OFFSET_KM, F.lit(0.0)) / scale), F.lit(FLOOR))


def buildings(records: DataFrame, epsilon_m: float = 5.0) -> DataFrame:
    """street, municipality, house, record, lat, lon, n, one_place: records of one house, the mean place, and whether all lie within epsilon of it."""
    key = ["street", "municipality", "house"]
    mean = records.groupBy(*key).agg(F.min("record").alias("record"), F.avg("lat").alias("mlat"), F.avg("lon").alias("mlon"), F.count(F.lit(1)).alias("n"))
    far = records.join(mean.select(*key, "mlat", "mlon"), key).groupBy(*key).agg(F.every(haversine(F.col("lat"), F.col("lon"), F.col("mlat"), F.col("mlon")) <= epsilon_m).alias("one_place"))
    return mean.join(far, key).select(*key, "record", F.col("mlat").alias("lat"), F.col("mlon").alias("lon"), "n", "one_place")


def collapse(ranked: DataFrame, records: DataFrame) -> DataFrame:
    """query, street, score, record, lat, lon: the best score of each street, its smallest record with it, and the median place."""
    top = ranked.groupBy("query", "street").agg(F.max(F.struct("score", (-F.col("record")).alias("r"))).alias("x")).select("query", "street", "x.score", (-F.col("x.r")).alias("record"))
    middle = records.groupBy("street").agg(F.median("lat").alias("lat"), F.median("lon").alias("lon"))
    return top.join(middle, "street")
