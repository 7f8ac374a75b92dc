"""Watching saved searches: each micro-batch is a new run, compared with the last snapshot, which it then replaces.

Snapshots are two tables, groups and offers, one folder for each run; a pointer file names the current one. A run that is tried again
after a failure overwrites its own folder, so alerts and history come out alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..operators.diff import snapshot_alerts

GROUPS = "search_id string, key string, label string, minPrice double, place long"
OFFERS = "search_id string, key string, url string, title string, price double, place long"


def read_snapshot(spark: SparkSession, folder: str, run: int) -> tuple[DataFrame, DataFrame]:
    """Groups and offers of a run; empty tables before the first."""
    try:
        return spark.read.schema(GROUPS).parquet(f"{folder}/run={run}/groups"), spark.read.schema(OFFERS).parquet(f"{folder}/run={run}/offers")
    except AnalysisException:
        return spark.createDataFrame([], GROUPS), spark.createDataFrame([], OFFERS)


def run_once(spark: SparkSession, folder: str, run: int, groups: DataFrame, offers: DataFrame, timestamp: str) -> DataFrame:
    """Compare a run with the snapshot before it, write its snapshot and its alerts, and return the alerts as written."""
    old_groups, old_offers = read_snapshot(spark, folder, run - 1)
    now_groups, now_offers = groups.select(*[c.split()[0] for c in GROUPS.split(", ")]), offers.select(*[c.split()[0] for c in OFFERS.split(", ")])
    alerts = snapshot_alerts(now_groups, now_offers, old_groups, old_offers).withColumn("timestamp", F.lit(timestamp))
    alerts.write.mode("overwrite").parquet(f"{folder}/run={run}/alerts")
    now_groups.write.mode("overwrite").parquet(f"{folder}/run={run}/groups")
    now_offers.write.mode("overwrite").parquet(f"{folder}/run={run}/offers")
    return spark.read.parquet(f"{folder}/run={run}/alerts")


def watch(offers: DataFrame, folder: str, search: Callable[[DataFrame], tuple[DataFrame, DataFrame]], on_alerts: Callable[[DataFrame, int], None] | None = None, every: str | None = None):
    """Start a streaming query: each micro-batch of offers goes through search, which gives groups and offers of each saved search.

    every: a processing-time trigger such as '60 minutes'; None: what is there now, then stop. on_alerts gets the alerts of a run
    that has any, and the run's number: it is the place of notifications, and may see a run twice after a failure.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.persist()
        alerts = run_once(spark, folder, number, *search(batch), timestamp=str(number))
        if on_alerts and alerts.limit(1).count():
            on_alerts(alerts, number)
        batch.unpersist()

    writer = offers.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/progress")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
