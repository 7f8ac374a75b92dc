"""The log of search jobs: what state each job is in, which is next, and which are kept.

Jobs are run by whoever submits Spark work; what is here are the questions a queue of them answers, over its log. A log row is job, queue,
state, at, seq: a job of a queue reached a state; seq orders rows of one time. Rows with a null job or queue belong to no job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: States in the order in which a job goes through them; one of the last two is its end.
QUEUED, RUNNING, COMPLETED, FAILED = "queued", "running", "completed", "failed"
#: Fixed value: jobs of a queue that are kept.
KEPT_JOBS = 50


def job_states(log: DataFrame) -> DataFrame:
    """One row for each job: queue, job, state, created_at, started_at, finished_at, updated_at, created_seq.

    What a job ended as first counts, and nothing it reaches later; a job without a queued row was created with its first row. Repeated
    rows change nothing; other states are left out.
    """
    at = lambda *states: F.min(F.when(F.col("state").isin(*states), F.struct("at", "seq", "state")))
    known = log.where(F.col("state").isin(QUEUED, RUNNING, COMPLETED, FAILED) & F.col("job").isNotNull() & F.col("queue").isNotNull())
    # Partial aggregation leaves one row for each job and task before the shuffle.
    once = known.groupBy("queue", "job").agg(at(QUEUED).alias("queued"), at(RUNNING).alias("running"), at(COMPLETED, FAILED).alias("end"), F.min(F.struct("at", "seq")).alias("first"))
    state = F.coalesce("end.state", F.when(F.col("running").isNotNull(), RUNNING), F.lit(QUEUED))
    created = F.coalesce(F.col("queued.at"), F.col("first.at")), F.coalesce(F.col("queued.seq"), F.col("first.seq"))
    updated = F.coalesce("end.at", "running.at", "queued.at")
    return once.select("queue", "job", state.alias("state"), created[0].alias("created_at"), F.col("running.at").alias("started_at"), F.col("end.at").alias("finished_at"), updated.alias("updated_at"), created[1].alias("created_seq"))


def next_jobs(jobs: DataFrame) -> DataFrame:
    """For each queue in which nothing runs: the job that was queued first."""
    waiting = F.min(F.when(F.col("state") == QUEUED, F.struct("created_at", "created_seq", "job")))
    found = jobs.groupBy("queue").agg(waiting.alias("next"), F.max((F.col("state") == RUNNING).cast("int")).alias("busy"))
    return found.where((F.col("busy") == 0) & F.col("next").isNotNull()).select("queue", F.col("next.job").alias("job"))


def kept_jobs(jobs: DataFrame, most: int = KEPT_JOBS) -> DataFrame:
    """Jobs without the oldest finished ones of each queue that holds more than `most`; those that wait or run always stay.

    The rank is first held against the constant, so that Spark keeps `most` rows of a queue in each task before it shuffles.
    """
    over = F.col("state").isin(COMPLETED, FAILED)
    open_jobs = jobs.where(~over)
    latest = Window.partitionBy("queue").orderBy(F.desc("created_at"), F.desc("created_seq"), F.desc("job"))
    finished = jobs.where(over).withColumn("_place", F.row_number().over(latest)).where(F.col("_place") <= most)
    waiting = open_jobs.groupBy("queue").agg(F.count(F.lit(1)).alias("_open"))
    room = F.lit(most) - F.coalesce("_open", F.lit(0))
    return open_jobs.unionByName(finished.join(waiting, "queue", "left").where(F.col("_place") <= room).drop("_place", "_open"))
