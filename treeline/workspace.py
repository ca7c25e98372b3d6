"""The folder that all executors share, for what a job writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder is set only where there is none (tests, one machine)."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not path and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = path or tempfile.mkdtemp(prefix="treeline-")
        sc.setCheckpointDir(path)
    return path or sc._jsc.sc().getCheckpointDir().get()


def new_folder(spark: SparkSession, stem: str) -> str:
    return f"{shared_folder(spark)}/{stem}-{uuid.uuid4().hex}"


#: Bytes of a batch that is sent to a Python worker, unless the session sets its own: Spark's 64 MB are held several times
#: over by each worker.
BATCH = "8m"


def small_batches(spark: SparkSession) -> None:
    name, usual = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20
    if spark.conf.get(name).rstrip("bB") == str(usual):
        spark.conf.set(name, BATCH)


def stored(df: DataFrame, stem: str = "rows") -> DataFrame:
    """df computed once and written to the shared folder as compressed columns, for what is read more than once."""
    path = new_folder(df.sparkSession, stem)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
