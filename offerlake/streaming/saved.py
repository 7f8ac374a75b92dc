"""Runs of saved searches: search, difference, snapshot, history and messages as one body that may be tried again at any point.

A run is a number. Each of its sinks is a folder of its own, written once and then marked; a run counts only when all of it is
marked. A run that is tried again keeps the sinks that are marked, groups and offers first of all, so that what follows from them
is the same although the shops may answer differently the second time; what isn't marked is written anew. Readers see whole runs.

    folder/<sink>/run=<n>        groups, offers, alerts, history, runs, messages-<provider>
    folder/marks/run=<n>/sink=<sink>
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..operators.diff import snapshot_alerts
from ..operators.grouping import group_members, ordered_groups
from ..plans.search import SearchRun
from ..sources.history import _SPECS, HISTORY, history_record
from ..sources.notify import Sender, notify

GROUPS = f"search_id string, key string, label string, minPrice double, maxPrice double, currency string, offerCount bigint, sources array<string>, sellers array<string>, sellerCount int, specs {_SPECS}, bestUrl string, place bigint"
OFFERS = "search_id string, key string, url string, title string, price double, place bigint"
ALERTS = "search_id string, type string, message string, groupKey string, url string, previousPrice double, currentPrice double, groupPlace bigint, kindPlace int, offerPlace bigint"
RUNS = "search_id string, timestamp string"
MESSAGES = "search_id string, provider string, ok boolean, error string"
SINKS = {"groups": GROUPS, "offers": OFFERS, "alerts": ALERTS, "history": HISTORY, "runs": RUNS}
#: The mark of a whole run.
WHOLE = "whole"


def _names(schema: str) -> list[str]:
    return SparkSession.active().createDataFrame([], schema).columns


def _marks(spark: SparkSession, folder: str) -> DataFrame:
    """(run, sink) of every mark."""
    try:
        return spark.read.schema("marked boolean, run bigint, sink string").json(f"{folder}/marks").select("run", "sink")
    except AnalysisException:
        return spark.createDataFrame([], "run bigint, sink string")


def whole_runs(spark: SparkSession, folder: str) -> DataFrame:
    """(run): the runs that count."""
    return _marks(spark, folder).where(F.col("sink") == WHOLE).select("run")


def read_sink(spark: SparkSession, folder: str, sink: str, schema: str | None = None) -> DataFrame:
    """The rows of a sink with run, of whole runs only."""
    schema = f"{schema or SINKS[sink]}, run bigint"
    try:
        rows = spark.read.schema(schema).parquet(f"{folder}/{sink}")
    except AnalysisException:
        return spark.createDataFrame([], schema)
    return rows.join(whole_runs(spark, folder), "run", "left_semi")


def last_snapshots(spark: SparkSession, folder: str, before: int) -> tuple[DataFrame, DataFrame]:
    """Groups and offers of each search's last whole run before the run `before`."""
    last = read_sink(spark, folder, "runs").where(F.col("run") < before).groupBy("search_id").agg(F.max("run").alias("run"))
    old = [read_sink(spark, folder, sink).join(last, ["search_id", "run"], "left_semi").drop("run") for sink in ("groups", "offers")]
    return old[0], old[1]


def read_history(spark: SparkSession, folder: str) -> DataFrame:
    """The price history of all whole runs, with run."""
    return read_sink(spark, folder, "history")


def snapshot_of(search_id: str, found: SearchRun) -> tuple[DataFrame, DataFrame]:
    """The groups and offers of a search's result, as run_saved takes them, groups in their order."""
    numbered = ordered_groups(found.groups).select("*", F.monotonically_increasing_id().alias("place")).withColumn("search_id", F.lit(search_id))
    members = group_members(found.offers).withColumn("search_id", F.lit(search_id))
    return numbered, members


def run_saved(spark: SparkSession, folder: str, run: int, searches: DataFrame, search: Callable[[DataFrame], tuple[DataFrame, DataFrame]], timestamp: str, senders: dict[str, Sender] | None = None, enabled: bool = False, force: bool = False, on_sink: Callable[[str], None] | None = None) -> DataFrame:
    """Run saved searches (id, name, query) and commit their result under the number run; the alerts of the run as committed.

    search gives groups and offers, with search_id, of the searches that it gets. Alerts are against each search's last whole run. A run that is
    whole already isn't run again. Messages go out after everything else is marked, provider by provider: a provider that has been asked
    isn't asked again when another one's failure, or a later one, has the run tried again. on_sink is called after each mark.
    """
    done = {r["sink"] for r in _marks(spark, folder).where(F.col("run") == run).collect()}  # a handful of sinks

    def mark(sink: str) -> None:
        spark.range(1).select(F.lit(True).alias("marked")).write.mode("overwrite").json(f"{folder}/marks/run={run}/sink={sink}")
        if on_sink:
            on_sink(sink)

    def once(sink: str, make: Callable[[], DataFrame], schema: str) -> DataFrame:
        path = f"{folder}/{sink}/run={run}"
        if not {sink, WHOLE} & done:
            make().select(*_names(schema)).write.mode("overwrite").parquet(path)
            mark(sink)
        return spark.read.schema(schema).parquet(path)

    found: list[tuple[DataFrame, DataFrame]] = []

    def result(part: int) -> DataFrame:
        if not found:
            found.append(search(searches))
        return found[0][part]

    groups = once("groups", lambda: result(0), GROUPS)
    offers = once("offers", lambda: result(1), OFFERS)
    alerts = once("alerts", lambda: snapshot_alerts(groups, offers, *last_snapshots(spark, folder, run)), ALERTS)
    once("history", lambda: history_record(searches, groups.withColumn("bestOfferUrl", F.col("bestUrl")), alerts, F.lit(timestamp)), HISTORY)
    once("runs", lambda: searches.select(F.col("id").alias("search_id"), F.lit(timestamp).alias("timestamp")), RUNS)
    for provider, sender in (senders or {}).items():
        once(f"messages-{provider}", lambda p=provider, s=sender: notify(alerts, groups, searches, {p: s}, enabled, force), MESSAGES)
    if WHOLE not in done:
        mark(WHOLE)
    return alerts


def watch_saved(offers: DataFrame, folder: str, read_searches: Callable[[SparkSession], DataFrame], search: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]], senders: dict[str, Sender] | None = None, enabled: bool = False, every: str | None = None):
    """Start a streaming query in which each micro-batch of offers is a run of the saved searches, read anew each time.

    search gets the searches and the batch. The batch's number is the run's, so that a batch that Spark tries again is the same run.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        run_saved(spark, folder, number, read_searches(spark), lambda s: search(s, batch), str(number), senders, enabled)

    writer = offers.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/progress")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
