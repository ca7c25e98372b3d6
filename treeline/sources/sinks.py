"""Writers of tables and results."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.functions.text import escape_tsv


def _text(c: Column, kind: str) -> Column:
    return F.hex(c) if kind == "binary" else c.cast("string")


def write_delimited(df: DataFrame, path: str, *, tab: bool = True, header: bool = False) -> None:
    """Rows as text: tab-separated with escapes and \\N for null, or comma-separated with quotes."""
    cells = [_text(F.col(f"`{f.name}`"), f.dataType.simpleString()).alias(f.name) for f in df.schema]
    if not tab:
        df.select(*cells).write.mode("overwrite").option("nullValue", "\\N").option("escape", '"').option("quote", '"').option("header", str(header).lower()).csv(path)
        return
    lines = df.select(*[escape_tsv(c).alias(f.name) for c, f in zip(cells, df.schema)])
    if header:
        # Escapes leave nothing to quote.
        plain = {"sep": "\t", "quote": "", "escapeQuotes": "false", "emptyValue": "", "header": "true"}
        lines.write.mode("overwrite").options(**plain).csv(path)
        return
    lines.select(F.concat_ws("\t", *[F.col(f"`{c}`") for c in lines.columns]).alias("value")).write.mode("overwrite").text(path)


def write_tables(tables: dict[str, DataFrame], path: str, *, append: bool = False) -> None:
    """One Parquet folder for each table."""
    for name, df in tables.items():
        df.write.mode("append" if append else "overwrite").parquet(f"{path}/{name}")


def read_tables(spark, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def write_documents(df: DataFrame, path: str, column: str = "xml", id_col: str = "document_id") -> None:
    """Documents as files of their own, as they are but for a newline at the end, in a folder for each id, below one for each
    shard if there is a column shard."""
    shards = ["shard"] if "shard" in df.columns else []
    out = df.select(*shards, F.col(id_col).alias("document_id"), F.col(column).cast("string").alias("value"))
    out.write.mode("overwrite").partitionBy(*shards, "document_id").text(path)


def write_docset(df: DataFrame, path: str, head: str = "") -> None:
    """Search documents (xml) as xmlpipe2 files, each a whole docset that begins with the given schema."""

    def run(batches):
        first = True
        for batch in batches:
            rows = batch.column(0).to_pylist()
            if first:
                rows.insert(0, f'<?xml version="1.0" encoding="utf-8"?>\n<sphinx:docset xmlns:sphinx="sphinx">{head}')
            first = False
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], names=["value"])
        if not first:
            yield pa.RecordBatch.from_arrays([pa.array(["</sphinx:docset>"], pa.string())], names=["value"])

    df.select(F.col("xml").cast("string")).where("xml is not null").mapInArrow(run, "value string").write.mode("overwrite").text(path)
