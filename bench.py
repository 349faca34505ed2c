"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one line of JSON."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import functions as F

from wayfold import plans
from wayfold.operators import search
from wayfold.plans import network
from wayfold.session import session

#: Requests that one batch answers.
BATCH = 200

HEADLINE = (
    "earliest_arrival_2r",
    "journeys_2r",
    "next_departures",
    "latest_departure_before_arrival",
    "station_backups",
    "pareto_plan_front",
    "delay_forward_fill",
    "live_refresh",
    "asof_schedule_match",
    "isochrone_best",
    "fare_fold",
    "address_rank",
)


def batch(spark, sf_dir):
    """Earliest arrivals at all stops for BATCH requests, two boardings, in one plan."""
    seeds = network.requests(spark, sf_dir).where(F.col("request") < BATCH).select("request", F.col("origin").alias("stop"), F.col("start").alias("arr"))
    return search.earliest_arrival(seeds, network.active_stop_times(spark, sf_dir), network.transfers(spark, sf_dir), rounds=2)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", **{"spark.sql.shuffle.partitions": str(2 * int(cpus)), "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    queries = {name: plans.QUERIES[name] for name in HEADLINE} | {"batch_of_requests": batch}
    for name, query in queries.items():
        best = float("inf")
        for _ in range(2):  # the first run also compiles
            began = time.perf_counter()
            query(spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - began)
        took[name] = round(best, 3)
    print(json.dumps({"metric": "headline queries, better of two runs", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1], "requests_per_sec": round(BATCH / took["batch_of_requests"], 1)}))
    spark.stop()


if __name__ == "__main__":
    main()
