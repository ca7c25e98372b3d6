"""A corpus from raw documents to token ids: each stage works on all that the one before it kept.

Stages, in order: language ID (rejected documents go), exact dedup, n-gram Jaccard join (one document of each group of
near copies stays), benchmark decontamination, BPE encoding. All but the last return the columns they got. Nulls, empty
and long texts, repeated rows and further columns are handled as the operators' docstrings say. A document of null text
is rejected by language ID, so that later stages see none unless they are called alone: they keep it, and it has null
tokens. Near copies are dropped by id and text, and rows without id stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.llm import bpe, decontaminate, exact_dedup, language_id, ngram_join
from treeline.llm._spark import fresh, local_run_id, shared_folder, table


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_known(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = ngram_join.near_duplicates(docs)
    key, text = fresh(docs, "gone"), fresh(docs, "gone_text")
    return docs.join(gone.toDF(key, text), (docs["doc_id"] == F.col(key)) & (F.xxhash64(docs["text"].cast("string")) == F.col(text)), "left_anti")


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs)


STAGES = [
    ("language ID", keep_known_language),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_benchmark_passages),
    ("BPE encoding and decoding", to_tokens),
]

#: Nearest centroids and byte pairs are beyond SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{local_run_id()}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
