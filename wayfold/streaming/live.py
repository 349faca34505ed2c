"""The live overlay as streams: updates in, a small table of the state out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.realtime import STICKY_TTL, forward_fill, latest

STATE = "delay_s int, ts long"
OUT = "trip long, pos int, delay_s int, ts long, gone boolean"


def _keep(ttl: int) -> Callable:
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            delay, ts = state.get
            state.remove()
            yield pd.DataFrame([(*key, delay, ts, True)], columns=["trip", "pos", "delay_s", "ts", "gone"])
            return
        best = state.get if state.exists else None
        for batch in batches:
            row = batch.sort_values(["ts", "event_id"]).iloc[-1]
            if best is None or row["ts"] >= best[1]:
                best = (int(row["delay_s"]), int(row["ts"]))
        if best is None:
            return
        state.update(best)
        state.setTimeoutDuration(ttl * 1000)
        yield pd.DataFrame([(*key, *best, False)], columns=["trip", "pos", "delay_s", "ts", "gone"])

    return step


def sticky_delays(updates: DataFrame, ttl: int = STICKY_TTL) -> DataFrame:
    """The delay seen last of each stop of a trip; rows with gone tell that nothing came for ttl seconds of processing time."""
    return updates.where("kind = 'delay'").groupBy("trip", "pos").applyInPandasWithState(_keep(ttl), OUT, STATE, "update", GroupStateTimeout.ProcessingTimeTimeout)


def windowed_delays(updates: DataFrame, width: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    """Mean delay and number of updates per kind and window of event time; later ones than the watermark are left out."""
    at = updates.withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", late)
    return at.groupBy(F.window("at", width), "kind").agg(F.avg("delay_s").alias("delay_s"), F.count(F.lit(1)).alias("n"))


def publish(updates: DataFrame, stop_times: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each batch leaves the whole overlay (trip, pos, delay_s, skipped) in a folder of its own; readers take the last.

    The last update of each stop of a trip goes on from batch to batch beside the overlay, so
    delays that an earlier batch told stay. A batch that is done again reads what the one
    before it left, never its own.
    """
    spark = updates.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        known = batch
        if number:
            known = batch.unionByName(spark.read.schema(batch.schema).parquet(f"{path}/_known/{number - 1}"))
        latest(known, ["trip", "pos"]).select(*batch.columns).write.mode("overwrite").parquet(f"{path}/_known/{number}")
        live = spark.read.schema(batch.schema).parquet(f"{path}/_known/{number}")
        forward_fill(stop_times, live).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return updates.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
