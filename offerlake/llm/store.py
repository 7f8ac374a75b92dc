"""Tables that cut lineage: written once into the shared folder, then read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids that are broadcast to filter a larger table: 8 bytes each.
BROADCAST_IDS = 4_000_000


#: Bounds of one Arrow batch. Rows hold whole texts, so that Spark's default of 10 000 rows would make batches of tens of MB.
BATCH_ROWS, BATCH_BYTES = 1_000, 4 << 20
_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}


def text_batches(spark: SparkSession) -> None:
    """Have Arrow batches of this session hold at most BATCH_ROWS rows and about BATCH_BYTES, unless the session has tighter bounds.

    The bounds stay for the session, since what operators return is run later.
    """
    for name, most in _BATCHES.items():
        now = spark.conf.get(name, None)
        digits = (now or "").removesuffix("b")
        if not digits.isdigit() or not 0 < int(digits) <= most:
            spark.conf.set(name, str(most))


def unused(df: DataFrame, name: str) -> str:
    """name, with as many underscores as it takes not to be a column of df."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, a folder of our own, on one machine only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet under the shared folder and return a DataFrame that reads it."""
    text_batches(df.sparkSession)
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables made by durable that nothing will read again."""
    for df in tables:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def keep_ids(df: DataFrame, ids: DataFrame, column: str = "doc_id", how: str = "left_semi") -> DataFrame:
    """The rows of df whose id is in ids, a table of distinct ids in one column of that name; with how = left_anti the others.

    Up to BROADCAST_IDS ids are broadcast, so that df isn't shuffled; more are joined by shuffle.
    """
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids, column, how)
