"""Documents as rows of (document_id, xml): from files, archives, tables and streams."""

from __future__ import annotations

import gzip
import io
import os
import re
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def document_id(path: Column, extension: str = ".xml", prefix: str = "", case: str = "") -> Column:
    """File name without its extension (also of an archive) and a leading prefix; case: lower, upper or as it is."""
    name = F.element_at(F.split(path, "/"), -1)
    name = F.regexp_replace(name, r"\.(gz|zip)$", "")
    name = F.regexp_replace(name, re.escape(extension) + "$", "")
    if prefix:
        name = F.regexp_replace(name, "^" + re.escape(prefix), "")
    return F.lower(name) if case == "lower" else F.upper(name) if case == "upper" else name


@F.arrow_udf(T.StringType())
def _unpacked(path: pa.Array, content: pa.Array) -> pa.Array:
    out = []
    for p, c in zip(path.to_pylist(), content.to_pylist()):
        if p.endswith(".gz"):
            c = gzip.decompress(c)
        elif p.endswith(".zip"):
            with zipfile.ZipFile(io.BytesIO(c)) as z:
                names = z.namelist()
                c = z.read(names[0]) if names else b""
        m = re.match(rb"<\?xml[^>]*encoding=[\"']([A-Za-z0-9._-]+)", c[:200])
        text = c.decode(m.group(1).decode() if m else "utf-8-sig", "replace")
        # The declaration goes with the encoding: a string has none.
        out.append(re.sub(r"^\s*<\?xml[^>]*\?>", "", text))
    return pa.array(out, pa.string())


def read_documents(spark: SparkSession, *paths: str, pattern: str | None = None, extension: str = ".xml", prefix: str = "", case: str = "", recursive: bool = True) -> DataFrame:
    """(document_id, path, xml, md5, modified) of files, plain or packed. pattern: a regular expression for whole paths."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    files = reader.load(list(paths)).where(F.element_at(F.split("path", "/"), -1).rlike(re.escape(extension) + r"(\.gz|\.zip)?$"))
    if pattern:
        files = files.where(F.col("path").rlike(pattern))
    return files.select(document_id(F.col("path"), extension, prefix, case).alias("document_id"), "path", _unpacked("path", "content").alias("xml"), F.md5("content").alias("md5"), F.col("modificationTime").alias("modified"))


def list_files(*paths: str, pattern: str | None = None) -> list[str]:
    """Files of paths and of folders below them whose whole path fits the pattern; a path may itself be a pattern."""
    out = []
    for p in paths:
        if os.path.isfile(p):
            out.append(p)
        elif os.path.isdir(p):
            out += [os.path.join(d, f) for d, _, fs in os.walk(p) for f in fs]
        else:
            base = os.path.dirname(p)
            if os.path.isdir(base):
                out += [os.path.join(base, f) for f in os.listdir(base) if re.fullmatch(os.path.basename(p), f)]
    return sorted(f for f in dict.fromkeys(out) if pattern is None or re.search(pattern, f))


def read_delimited(spark: SparkSession, path: str, schema: str, *, tab: bool = True) -> DataFrame:
    """Rows of a delimited file that write_delimited made."""
    from treeline.functions.text import unescape_tsv

    fields = T._parse_datatype_string(schema).fields
    raw = T.StructType([T.StructField(f.name, T.StringType()) for f in fields])
    if tab:
        parts = F.split("value", "\t", -1)
        return spark.read.text(path).select(*[_typed(unescape_tsv(F.get(parts, F.lit(k))), f.dataType).alias(f.name) for k, f in enumerate(fields)])
    rows = spark.read.schema(raw).option("nullValue", "\\N").option("escape", '"').option("multiLine", "true").csv(path)
    return rows.select(*[_typed(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in fields])


def _typed(c: Column, kind) -> Column:
    return F.unhex(c) if kind.simpleString() == "binary" else c.cast(kind)


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(word, freq) of lines `word freq`, separated by white space or commas."""
    parts = F.split(F.trim("value"), r"[\s,]+")
    return spark.read.text(path).where("trim(value) != ''").select(F.get(parts, F.lit(0)).alias("word"), F.coalesce(F.get(parts, F.lit(1)).try_cast("bigint"), F.lit(1)).alias("freq"))


def read_search_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(id, ...): documents of an xmlpipe2 stream, one row each. schema: its field and attributes, as the stream's head has them."""
    fields = T._parse_datatype_string(schema).fields
    raw = T.StructType([T.StructField("_id", T.StringType()), *[T.StructField(f.name, T.StringType()) for f in fields]])
    rows = spark.read.schema(raw).format("xml").option("rowTag", "sphinx:document").option("ignoreSurroundingSpaces", "false").load(path)
    return rows.select(F.col("_id").alias("id"), *[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields])
