"""Small helpers that several operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary one is set only where none is (tests, one machine)."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not path and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = path or tempfile.mkdtemp(prefix="treeline-")
        sc.setCheckpointDir(path)
    return path or sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder, so that a lost executor costs only a read."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df does not have, in any case."""
    have = {c.lower() for c in df.columns}
    name = f"__{stem}"
    while name.lower() in have:
        name = f"_{name}"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a batch that is sent to a Python worker, unless the session sets its own: Spark's 64 MB are held several times
#: over, on both sides, by each worker.
BATCH = "8m"


def small_batches(spark: SparkSession) -> None:
    name, usual = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20
    if spark.conf.get(name).rstrip("bB") == str(usual):
        spark.conf.set(name, BATCH)


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the given columns under fixed names, so that further columns of df cannot clash. Ids keep their type, texts become string."""
    small_batches(df.sparkSession)
    return df.select(*[F.col(f"`{c}`").cast("string").alias(k) if k == "text" else F.col(f"`{c}`").alias(k) for k, c in columns.items()])


def text_bytes_total(df: DataFrame, text: str) -> int:
    return df.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]


def pieces(total: int, each: int, least: int = 8) -> int:
    """A power of two of at least `least` pieces of at most `each`."""
    n = least
    while n * each < total:
        n *= 2
    return n


def local_run_id() -> str:
    return uuid.uuid4().hex
