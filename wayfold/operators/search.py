"""Round-based search: each round rides and walks all requests at once.

Rides are looked up in a table of connections: of all ways to board a trip at one stop and
leave it at another, those that no later departure arrives as early as. Between two stops
these form a staircase, so whoever stands at a stop takes exactly one row for each stop that
can be reached from there, however long the wait is, and a round is an equi-join by stop and
hour. Labels are (request, stop, arr); a request may stand for a departure of a range query.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut

HOUR = 3600
#: Boardings at most; bounds of backward searches later than this hour of the service day count as this hour.
MOST_ROUNDS, LAST_HOUR = 20, 72
#: Tables of labels that are put together before they are stored as one.
PARTS = 3


def _hour(seconds: Column) -> Column:
    return F.floor(seconds / HOUR).cast("int")


def connections(stop_times: DataFrame) -> DataFrame:
    """board, alight, dep, arr, trip, since, until: the rides worth taking between each pair of stops.

    A row is the ride for whoever is at board after since (null: the first of the day) and by
    dep; backward, for whoever must be at alight by arr or later, but before until. Equal
    departures and arrivals take the smallest trip. Rides are pre-aggregated by departure, so
    that the window of a pair has a row for each second of the day at most.
    """
    a = stop_times.select("trip", F.col("stop").alias("board"), "dep", F.col("pos").alias("from"))
    b = stop_times.select("trip", F.col("stop").alias("alight"), "arr", F.col("pos").alias("to"))
    ways = a.join(b, "trip").where(F.col("to") > F.col("from"))
    first = ways.groupBy("board", "alight", "dep").agg(F.min(F.struct("arr", "trip")).alias("x")).select("board", "alight", "dep", "x.arr", "x.trip")
    pair = Window.partitionBy("board", "alight").orderBy(F.desc("dep"))
    kept = first.withColumn("_later", F.min("arr").over(pair.rowsBetween(Window.unboundedPreceding, -1))).where("_later is null or arr < _later").drop("_later")
    return kept.select("board", "alight", "dep", "arr", "trip", F.lead("dep").over(pair).alias("since"), F.lag("arr").over(pair).alias("until"))


def forward(found: DataFrame) -> DataFrame:
    """connections with a row for each hour in which someone may take them; stored, and dealt out by stop and hour, so that only labels move in a round."""
    first = F.coalesce(F.col("since") + 1, F.lit(0))
    hours = F.explode(F.sequence(_hour(F.greatest(first, F.lit(0))), _hour(F.col("dep"))))
    return cut(found.where("dep >= 0").select("board", hours.alias("hour"), "since", "dep", "alight", "arr", "trip").repartition("board", "hour"))


def backward(found: DataFrame) -> DataFrame:
    """As forward, for the hours of the bounds that a connection is the last one for."""
    last = F.least(F.coalesce(_hour(F.col("until") - 1), F.lit(LAST_HOUR)), F.lit(LAST_HOUR))
    first = F.least(_hour(F.col("arr")), F.lit(LAST_HOUR))
    return cut(found.select("alight", F.explode(F.sequence(first, F.greatest(first, last))).alias("hour"), "until", "arr", "board", "dep", "trip").repartition("alight", "hour"))


def taken(labels: DataFrame, table: DataFrame, at: str = "arr") -> DataFrame:
    """labels (stop and the time `at`) with the connection that each takes to every stop within a ride; their own arr is called was."""
    wanted = labels.withColumnsRenamed({"arr": "was", "stop": "board"}).withColumn("_at", F.col("was" if at == "arr" else at))
    return wanted.withColumn("hour", _hour(F.col("_at"))).join(table, ["board", "hour"]).where((F.col("since").isNull() | (F.col("since") < F.col("_at"))) & (F.col("_at") <= F.col("dep"))).drop("_at", "hour", "since")


def ride(labels: DataFrame, table: DataFrame) -> DataFrame:
    """request, stop, arr: what one ride reaches, the earliest arrival at each stop."""
    return taken(labels.select("request", "stop", "arr"), table).groupBy("request", F.col("alight").alias("stop")).agg(F.min("arr").alias("arr"))


def walk(labels: DataFrame, transfers: DataFrame) -> DataFrame:
    """Labels and what one walk reaches from them, the earliest arrival at each stop; labels are read once."""
    walks = transfers.groupBy(F.col("f").alias("stop")).agg(F.collect_list(F.struct("t", "w")).alias("_walks"))  # a stop's neighbours on foot
    none = F.expr("cast(array() as array<struct<t:long,w:int>>)")
    steps = F.concat(F.array(F.struct(F.col("stop").alias("t"), F.lit(0).alias("w"))), F.coalesce(F.col("_walks").cast("array<struct<t:long,w:int>>"), none))
    gone = labels.select("request", "stop", "arr").join(walks, "stop", "left").select("request", "arr", F.explode(steps).alias("s"))
    return gone.groupBy("request", F.col("s.t").alias("stop")).agg(F.min(F.col("arr") + F.col("s.w")).cast("int").alias("arr"))


def _least(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).groupBy("request", "stop").agg(F.min("arr").alias("arr"))


def _improved(reached: DataFrame, parts: list[DataFrame]) -> DataFrame:
    known = _least(parts).withColumnRenamed("arr", "known")
    return reached.join(known, ["request", "stop"], "left").where("known is null or arr < known").select("request", "stop", "arr")


def earliest_arrival(seeds: DataFrame, stop_times: DataFrame, transfers: DataFrame, rounds: int | None = MOST_ROUNDS, table: DataFrame | None = None) -> DataFrame:
    """request, stop, arr: the earliest arrival by at most so many boardings, by any number where rounds is None, with a walk after each ride and at the start.

    Only labels that the last round improved are looked at again; each round ends in the shared
    folder, so plans stay as small as one round. table, if given, is forward(connections(...))
    of the stop times, made once for many searches.
    """
    table = forward(connections(stop_times)) if table is None else table
    parts = [cut(walk(seeds, transfers))]
    fresh = parts[0]
    for k in count(1) if rounds is None else range(1, rounds + 1):
        reached = walk(ride(fresh, table), transfers)
        if k == rounds:
            return _least([*parts, reached])
        fresh = cut(_improved(reached, parts))
        if fresh.isEmpty():
            break
        parts = [*parts, fresh]
        if len(parts) > PARTS:
            parts = [cut(_least(parts))]
    return _least(parts)


def rounds_profile(seeds: DataFrame, stop_times: DataFrame, transfers: DataFrame, rounds: int) -> DataFrame:
    """request, stop, boardings, arr: the start and what each round reaches from the labels that the one before improved."""
    table = forward(connections(stop_times))
    parts = [cut(walk(seeds, transfers))]
    out, fresh = [parts[0].select("request", "stop", F.lit(0).alias("boardings"), "arr")], parts[0]
    for k in range(1, rounds + 1):
        reached = cut(walk(ride(fresh, table), transfers))
        out.append(reached.select("request", "stop", F.lit(k).alias("boardings"), "arr"))
        if k < rounds:
            fresh = cut(_improved(reached, parts))
            parts.append(fresh)
    return reduce(DataFrame.unionByName, out)


def latest_departure_backward(targets: DataFrame, stop_times: DataFrame, transfers: DataFrame, rounds: int) -> DataFrame:
    """request, stop, dep: the latest departure that reaches the target (request, stop, dep as the bound) by at most so many rides.

    The mirror of the search: walks go back along the reversed table, rides from the last
    connection that arrives in time.
    """
    table = backward(connections(stop_times))
    back = transfers.select(F.col("t").alias("f"), F.col("f").alias("t"), (-F.col("w")).alias("w"))

    def walk_back(labels: DataFrame) -> DataFrame:
        turned = walk(labels.select("request", "stop", (-F.col("dep")).alias("arr")), back.withColumn("w", -F.col("w")))
        return turned.select("request", "stop", (-F.col("arr")).alias("dep"))

    best = cut(walk_back(targets))
    fresh = best
    for k in range(rounds):
        wanted = fresh.select("request", F.col("stop").alias("alight"), F.col("dep").alias("by"), F.least(_hour(F.col("dep")), F.lit(LAST_HOUR)).alias("hour"))
        ridden = wanted.join(table, ["alight", "hour"]).where("arr <= by and (until is null or by < until)").groupBy("request", F.col("board").alias("stop")).agg(F.max("dep").alias("dep"))
        both = best.unionByName(walk_back(ridden)).groupBy("request", "stop").agg(F.max("dep").alias("dep"))
        if k + 1 == rounds:
            return both
        later = cut(both)
        fresh = later.join(best.withColumnRenamed("dep", "known"), ["request", "stop"], "left").where("known is null or dep > known").select("request", "stop", "dep")
        best = later
    return best


def onboard_seeds(stop_times: DataFrame, riders: DataFrame) -> DataFrame:
    """request, stop, arr: every later stop of the trip that each rider (request, trip, pos) is on."""
    later = stop_times.select("trip", "stop", "arr", F.col("pos").alias("at"))
    return riders.join(later, "trip").where("at > pos").groupBy("request", "stop").agg(F.min("arr").alias("arr"))


def interesting_departures(stop_times: DataFrame, stop: int, first: int, window: int, most: int | None = None) -> DataFrame:
    """dep: the distinct departures at a stop within a window; with most, only so many of the earliest, as a report may ask for."""
    found = stop_times.where((F.col("stop") == stop) & F.col("dep").between(first, first + window)).select("dep").distinct()
    return found if most is None else found.orderBy("dep").limit(most)


def range_front(profile: DataFrame) -> DataFrame:
    """Of (departure, stop, arr): the departures that no later one matches or beats at the stop."""
    later = Window.partitionBy("stop").orderBy(F.desc("departure"), "arr").rowsBetween(Window.unboundedPreceding, -1)
    return profile.withColumn("beat", F.min("arr").over(later)).where("beat is null or arr < beat").drop("beat")


def journeys(seeds: DataFrame, stop_times: DataFrame, transfers: DataFrame, rounds: int, table: DataFrame | None = None) -> DataFrame:
    """request, stop, arr, path: as earliest_arrival, each label with its legs; of equal arrivals the path that sorts first.

    A path is text, a leg "R trip board dep alight arr" or "W from to seconds", legs joined by
    "|"; labels stay narrow enough to be shuffled, and no parent has to be looked up. Between two
    stops the latest of the rides that arrive first is taken. A round starts from the labels
    that the one before brought forward.
    """
    table = forward(connections(stop_times)) if table is None else table

    def settle(labels: DataFrame) -> DataFrame:
        return labels.groupBy("request", "stop").agg(F.min(F.struct("arr", "path")).alias("x")).select("request", "stop", "x.arr", "x.path")

    def extended(leg: Column) -> Column:
        return F.concat_ws("|", F.when(F.col("path") != "", F.col("path")), leg)

    def on_foot(labels: DataFrame) -> DataFrame:
        went = labels.join(transfers, labels["stop"] == transfers["f"]).select("request", F.col("t").alias("stop"), (F.col("arr") + F.col("w")).cast("int").alias("arr"), extended(F.concat_ws(" ", F.lit("W"), "f", "t", "w")).alias("path"))
        return settle(labels.select("request", "stop", "arr", "path").unionByName(went))

    best = cut(on_foot(seeds.select("request", "stop", F.col("arr").cast("int").alias("arr"), F.lit("").alias("path"))))
    fresh = best
    for k in range(rounds):
        leg = F.concat_ws(" ", F.lit("R"), "trip", "board", "dep", "alight", "arr")
        ridden = taken(fresh, table).select("request", F.col("alight").alias("stop"), "arr", extended(leg).alias("path"))
        reached = on_foot(cut(settle(ridden)))
        both = settle(best.unionByName(reached))
        if k + 1 == rounds:
            return both
        later = cut(both)
        known = best.select("request", "stop", F.col("arr").alias("known"), F.col("path").alias("_path"))
        fresh = later.join(known, ["request", "stop"], "left").where("known is null or arr < known or path < _path").select("request", "stop", "arr", "path")
        best = later
    return best


def reliable_arrivals(seeds: DataFrame, stop_times: DataFrame, bins: DataFrame, mode: DataFrame, rounds: int) -> DataFrame:
    """request, stop, bucket, arr, rel: the front of arrival and reliability bucket after so many rides without walks.

    A transfer holds with the feeder's probability to be late by no more than the margin; the
    first boarding is certain. A label takes the first connection, and the first at which a
    higher bucket is reached, as the margin for each bucket is known beforehand. Of each bucket
    the earliest arrival stays, the surer on ties, unless a higher bucket arrives as early.
    mode has trip and mode.
    """
    from ..functions.reliability import EDGES, bucket, on_time
    from .pareto import bucket_front

    table = forward(connections(stop_times))
    bin_table = F.broadcast(bins.select(F.col("mode").alias("feeder"), "bins"))  # a row per mode
    labels = seeds.select("request", "stop", "arr", F.lit(1.0).alias("rel"), F.lit(None).cast("string").alias("feeder"))
    everything = []

    def chance(margin: Column) -> Column:
        return F.round(F.col("rel") * F.when(F.col("bins").isNull(), 1.0).otherwise(on_time(F.col("bins"), margin)), 6)

    def reaches(b: int):
        return lambda m: bucket(chance(m)) >= b

    for _ in range(rounds):
        known = labels.join(bin_table, "feeder", "left")
        steps = F.array_distinct(F.concat(F.array(F.lit(0)), F.transform(F.coalesce("bins", F.expr("cast(array() as array<struct<delay:int,cum:double>>)")), lambda b: F.greatest(b["delay"].cast("int"), F.lit(0)))))
        least = [F.array_min(F.filter("_steps", reaches(b))) for b in range(len(EDGES) + 2)]
        waits = F.array_distinct(F.filter(F.array(*least), lambda m: m.isNotNull()))
        waiting = known.withColumn("_steps", steps).withColumn("wait", F.explode(waits)).withColumn("at", F.col("arr") + F.col("wait")).drop("_steps", "wait")
        boarded = taken(waiting, table, "at").join(mode.select("trip", F.col("mode").alias("next")), "trip")
        ridden = boarded.select("request", F.col("alight").alias("stop"), "arr", chance(F.col("dep") - F.col("was")).alias("rel"), F.col("next").alias("feeder")).withColumn("bucket", bucket(F.col("rel")))
        best = ridden.groupBy("request", "stop", "bucket").agg(F.min(F.struct("arr", (-F.col("rel")).alias("r"), "feeder")).alias("x")).select("request", "stop", "bucket", "x.arr", (-F.col("x.r")).alias("rel"), "x.feeder")
        best = cut(best)
        best = best.join(bucket_front(best, ["request", "stop"], "arr", "bucket"), ["request", "stop", "bucket", "arr"])
        everything.append(best)
        labels = best.select("request", "stop", "arr", "rel", "feeder")
    both = reduce(DataFrame.unionByName, everything)
    front = bucket_front(both, ["request", "stop"], "arr", "bucket")
    return both.groupBy("request", "stop", "bucket", "arr").agg(F.max("rel").alias("rel")).join(front, ["request", "stop", "bucket", "arr"])
