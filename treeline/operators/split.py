"""Splitting of large documents into units, and sharding."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treeline.operators.shred import _plain, local
from treeline.workspace import kept, stored

#: Characters that the parser is fed at a time, and units in a batch that leaves Python.
PIECE, UNITS = 1 << 16, 1000


def _tag(el: ET.Element) -> str:
    """Opening tag of an element."""
    return _plain(ET.Element(el.tag, el.attrib)).removesuffix(" />") + ">"


def _units(text: str, unit: list[str], key: list[str]):
    """(key, xml) of the elements at path unit, each within copies of its ancestors and what stands before the first unit.

    The text is pulled through the parser in pieces, and what was made a unit or is in none is let go.
    """
    if len(unit) == 1:
        yield None, text
        return
    parser = ET.XMLPullParser(("start", "end"))
    stack: list[ET.Element] = []
    fits = 0  # how many elements of the stack are the beginning of the path
    head: list[str] = []
    seen = False

    def events():
        nonlocal fits, seen
        for event, el in parser.read_events():
            if event == "start":
                if fits == len(stack) < len(unit) and local(el.tag) == unit[fits]:
                    fits += 1
                    if fits == len(unit) - 1:
                        head.clear()
                        seen = False
                stack.append(el)
                continue
            stack.pop()
            depth = len(stack)
            if depth == len(unit) - 1 and fits >= depth:
                if fits == len(unit):
                    seen = True
                    k = el
                    for name in key:
                        k = k.get(name[1:]) if name.startswith("@") else next((x for x in k if local(x.tag) == name), None)
                        if k is None:
                            break
                    value = k if isinstance(k, str) or k is None else "".join(k.itertext())
                    tags = [_tag(e) for e in stack]
                    ends = [re.match(r"<([^\s>/]+)", t).group(1) for t in tags]
                    yield value, "".join(tags) + "".join(head) + _plain(el) + "".join(f"</{e}>" for e in reversed(ends))
                elif not seen:
                    head.append(_plain(el))
            if depth < len(unit) and stack:
                stack[-1].remove(el)
            fits = min(fits, depth)

    for at in range(0, len(text), PIECE):
        parser.feed(text[at : at + PIECE])
        yield from events()
    parser.close()
    yield from events()


def split_documents(docs: DataFrame, unit: str, key: str, malformed: str = "raise") -> DataFrame:
    """(document_id, source_id, xml): one document for each element at the path unit. key: path of its id, below or including unit.

    A document that is not well-formed is an error, or is left out with what was found in it if malformed is "drop".
    """
    u = [x for x in unit.split("/") if x]
    k = [x for x in key.split("/") if x]
    k = k[len(u) :] if k[: len(u)] == u else k

    def run(batches):
        for batch in batches:
            for d, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out = []
                try:
                    out += [(v, d, y) for v, y in _units(x, u, k)] if x else []
                except ET.ParseError as e:
                    if malformed != "drop":
                        raise ValueError(f"document {d} is not well-formed: {e}") from e
                    continue
                for at in range(0, len(out), UNITS):
                    a, b, c = zip(*out[at : at + UNITS])
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(c, pa.string())], names=["document_id", "source_id", "xml"])

    return docs.select(F.col("document_id").cast("string"), F.col("xml").cast("string")).mapInArrow(run, "document_id string, source_id string, xml string")


def shard(df: DataFrame, shards: int, key: str = "document_id") -> DataFrame:
    """With a column shard from 0 to shards - 1, decided by the key alone, so that a document stays in its shard."""
    return df.withColumn("shard", F.pmod(F.xxhash64(key), F.lit(shards)).cast("int"))


def ranked(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """df with a column for the rank of each row by the keys, from 1.

    Rows are sorted by ranges of the keys and kept so; a row's rank is its place in its range and how many rows are in the
    ranges before, of which there are as many as partitions.
    """
    # Rows are computed once for the choice of ranges and the sort.
    ranged = kept(stored(df).repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__p", F.spark_partition_id()))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("__p").agg(F.count("*").alias("__n")).select(F.col("__p").alias("__q"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    own = ranged.withColumn("__r", F.row_number().over(Window.partitionBy("__p").orderBy(*keys)))
    placed = own.join(F.broadcast(starts), F.col("__p") == F.col("__q"))
    return placed.withColumn(name, F.col("__start") + F.col("__r")).select(*df.columns, name)


def shard_round_robin(df: DataFrame, shards: int, key: str = "document_id") -> DataFrame:
    """With a column shard by the rank of the key, in turn."""
    return ranked(df, [key], "__rank").withColumn("shard", F.pmod(F.col("__rank") - 1, F.lit(shards)).cast("int")).drop("__rank")


def write_shards(df: DataFrame, path: str) -> None:
    """One folder for each shard."""
    df.write.mode("overwrite").partitionBy("shard").parquet(path)
