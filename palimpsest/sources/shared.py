"""Folders that all machines share, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; a temporary one where a session on one machine names none."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return named or tempfile.mkdtemp(prefix="spark-")


def new_folder(spark: SparkSession) -> str:
    """A new folder beside the checkpoints."""
    return f"{shared_folder(spark)}/files-{uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Checkpoints a table that is read more than once, so that it is made once and survives lost executors."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """The table from files in a new shared folder, which stay. Its size is then known, where a checkpoint's would be
    guessed from what it was made of: after some self joins such a guess has more digits than Spark can hold."""
    at = new_folder(df.sparkSession)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


#: Rows of one Arrow batch: rows of texts are wide, and a worker holds its batch several times over.
BATCH_ROWS = 512


def small_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches small unless the session asks for still smaller ones. Spark reads this when a query runs, so the
    setting stays for the session."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
