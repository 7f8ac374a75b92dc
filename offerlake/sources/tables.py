"""Tables that cut lineage: written once into the shared folder, then read by all who need their rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of numbers that are broadcast: 8 bytes each.
BROADCAST_IDS = 4_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, one of our own, which only a local master can share."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table that was written once: what reads it doesn't compute it again, also after an executor is lost."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df dealt to all cores: rows of a small file or a short shuffle lie in one partition, which costly expressions over them would keep to one core."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def few_of(ids: DataFrame) -> DataFrame:
    """ids, a written table of numbers, marked for broadcast if they are BROADCAST_IDS at most; more are joined by shuffle."""
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids
