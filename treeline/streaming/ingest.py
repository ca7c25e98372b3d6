"""Incremental loading of a stream of documents: each micro-batch is parsed once and synchronised into the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.operators.shred import Filters, kept_tables, shred_once
from treeline.operators.sync import checksums
from treeline.schema.model import SchemaModel
from treeline.workspace import new_folder

#: Folder of what was loaded; no table can have this name, as no XML name begins with a digit.
STATE = "0state"


def document_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """(document_id, xml) of Parquet files as they arrive."""
    reader = spark.readStream.schema("document_id string, xml string")
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def ingest(stream: DataFrame, model: SchemaModel, path: str, checkpoint: str, filters: Filters | None = None, *, available_now: bool = True):
    """Appends each batch's rows to the tables below path, with the number of the batch; returns the query.

    A batch replaces its own folder, so that a batch that is repeated after a failure leaves its rows once.
    A document that comes again is newer: current() leaves the rows of its last batch alone.
    """
    names = kept_tables(model, filters)

    def load(batch: DataFrame, number: int) -> None:
        checksums(batch).write.mode("overwrite").parquet(f"{path}/{STATE}/batch={number}")
        wanted = {t: [f.name for f in model.tables[t].fields] for t in names}
        tables = shred_once(batch, model, wanted, new_folder(batch.sparkSession, "batch"), filters=filters)
        for t, rows in tables.items():
            rows.write.mode("overwrite").parquet(f"{path}/{t}/batch={number}")

    writer = stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def current(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Rows of a table as the last batch of each document left them."""
    rows, state = (spark.read.parquet(f"{path}/{t}") for t in (table, STATE))
    last = state.groupBy(F.col("document_id").alias("__d")).agg(F.max("batch").alias("__b"))
    return rows.join(last, (F.col("document_id") == F.col("__d")) & (F.col("batch") == F.col("__b")), "left_semi").drop("batch")
