"""Incremental loading: which documents are new, changed, gone or the same, and the tables after that."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NEW, UPDATED, DELETED, SAME = "new", "updated", "deleted", "same"


def checksums(docs: DataFrame, algorithm: str = "md5") -> DataFrame:
    """(document_id, digest) of documents (document_id, xml)."""
    c = F.encode("xml", "UTF-8")
    digest = {"md5": F.md5(c), "sha1": F.sha1(c), "sha256": F.sha2(c, 256)}[algorithm]
    return docs.select("document_id", digest.alias("digest"))


def classify(state: DataFrame, now: DataFrame, *, rescue: bool = False) -> DataFrame:
    """(document_id, status) by the state of the last run (document_id, digest [, modified]) and the documents of now.

    With `modified` on both sides an equal time spares the comparison of digests, unless rescue is set.
    """
    timed = "modified" in state.columns and "modified" in now.columns and not rescue
    old = state.select(F.col("document_id").alias("o"), F.col("digest").alias("od"), *([F.col("modified").alias("om")] if timed else []))
    new = now.select(F.col("document_id").alias("n"), F.col("digest").alias("nd"), *([F.col("modified").alias("nm")] if timed else []))
    same = F.col("od").eqNullSafe(F.col("nd"))
    if timed:
        same = same | (F.col("om") == F.col("nm"))
    status = F.when(F.col("o").isNull(), NEW).when(F.col("n").isNull(), DELETED).when(same, SAME).otherwise(UPDATED)
    return old.join(new, F.col("o") == F.col("n"), "full_outer").select(F.coalesce("o", "n").alias("document_id"), status.alias("status"))


def delete_documents(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Tables without the rows of the given documents (in the first column of ids)."""
    gone = ids.select(F.col(ids.columns[0]).alias("__gone")).distinct()
    return {k: t.join(gone, F.col("document_id") == F.col("__gone"), "left_anti") for k, t in tables.items()}


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new, and those of old whose key new does not have. Only for keys that are unique."""
    return old.join(new.select(F.col(key).alias("__new")).distinct(), F.col(key) == F.col("__new"), "left_anti").unionByName(new)


def synchronize(tables: dict[str, DataFrame], state: DataFrame, docs: DataFrame, shred, *, weak: bool = False, rescue: bool = False) -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables and state after a run. shred: documents -> {table: rows}. weak: only new documents are added."""
    now = checksums(docs)
    status = classify(state, now, rescue=rescue)
    wanted = status.where(F.col("status") == NEW) if weak else status.where(F.col("status").isin(NEW, UPDATED))
    fresh = shred(docs.join(wanted.select("document_id"), "document_id", "left_semi"))
    kept = tables if weak else delete_documents(tables, status.where(F.col("status").isin(UPDATED, DELETED)).select("document_id"))
    out = {k: kept[k].unionByName(fresh[k]) if k in kept else fresh[k] for k in fresh}
    added = now.join(wanted.select("document_id"), "document_id", "left_semi")
    left = state.select("document_id", "digest")
    if not weak:
        left = left.join(status.where(F.col("status").isin(UPDATED, DELETED)).select("document_id"), "document_id", "left_anti")
    return out, left.unionByName(added)


def report(state: DataFrame, docs: DataFrame) -> DataFrame:
    """(status, documents): what a run would do."""
    return classify(state, checksums(docs)).groupBy("status").agg(F.count("*").alias("documents"))
