"""Exact duplicates by composable polynomial fingerprints, confirmed by comparing texts piece by piece.

A text's UTF-8 bytes are the coefficients of a polynomial, evaluated at fixed points modulo 2**31 - 1. Pieces of a
text are hashed on their own and joined by H(ab) = H(a) * x**len(b) + H(b), so a huge text is hashed by many tasks and
gives the same fingerprint as in one. Fingerprints are computed once and kept with ids; only rows whose fingerprint and
length occur twice are compared, in streams of bounded length whose first rows are compared again until one is left.

Null texts equal nothing and are all kept. Empty texts equal each other. Of equal rows the one with the least id stays
(null ids last), ties by all other columns' hash; rows that repeat an id and a text are duplicates like any others.
Ids are of any type that sorts and keep it. Further columns pass through, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeline.llm._spark import cut, small_batches, table
from treeline.llm._text import text_bytes

P = (1 << 31) - 1
#: Points at which the polynomial is evaluated: three residues of 31 bits.
POINTS = (1_103_515_245, 1_640_531_527, 2_083_697_101)
#: Bytes of one coefficient block: 255 * 2**31 * 1024 is well within a double's 53 bits.
STEP = 1024
#: Texts of more bytes than this are hashed in pieces of this size, by any tasks, and their hashes combined.
HUGE = 8 << 20
#: Copies in one comparing stream; larger groups are compared in several streams, then their winners.
STREAM = 1000
#: Bytes compared at a time.
COMPARE = 1 << 16

_tables: dict = {}


def _powers(points: tuple[int, ...]) -> np.ndarray:
    """STEP x points: x**(STEP-1) ... x**0 as exact doubles."""
    if points not in _tables:
        out = np.ones((STEP, len(points)))
        for k, x in enumerate(points):
            v = 1
            for i in range(STEP - 1, -1, -1):
                out[i, k] = v
                v = v * x % P
        _tables[points] = out
    return _tables[points]


def combine(left: tuple, right: tuple, points: tuple[int, ...] = POINTS) -> tuple:
    """The fingerprint (length, residues) of a text from those of its two parts; associative."""
    return left[0] + right[0], tuple((a * pow(x, right[0], P) + b) % P for a, b, x in zip(left[1], right[1], points))


def fingerprints(column: pa.Array, points: tuple[int, ...] = POINTS) -> np.ndarray:
    """rows x points residues. The first block of each text is padded on the left, which adds nothing to the value."""
    data, offsets, _ = text_bytes(column)
    size = np.diff(offsets)
    out = np.zeros((len(size), len(points)), np.uint64)
    table_, step = _powers(points), [np.uint64(pow(x, STEP, P)) for x in points]
    count = -(-size // STEP)
    lo = 0
    while lo < len(size):
        hi = lo + 1
        while hi < len(size) and hi - lo < 4096 and offsets[hi + 1] - offsets[lo] <= 1 << 20:
            hi += 1
        n = count[lo:hi]
        first = np.concatenate([[0], np.cumsum(n)])
        flat = np.zeros((int(first[-1]), STEP), np.uint8)
        view = flat.reshape(-1)
        for k in range(lo, hi):
            if size[k]:
                e = int(first[k - lo + 1]) * STEP
                view[e - size[k] : e] = data[offsets[k] : offsets[k + 1]]
        part = (flat.astype(np.float64) @ table_).astype(np.uint64) % np.uint64(P)
        acc = np.zeros((hi - lo, len(points)), np.uint64)
        # Horner over the blocks of all texts at once; rows leave as their blocks end.
        left = np.flatnonzero(n > 0)
        k = 0
        while len(left):
            for j in range(len(points)):
                acc[left, j] = (acc[left, j] * step[j] + part[first[left] + k, j]) % np.uint64(P)
            k += 1
            left = left[n[left] > k]
        out[lo:hi] = acc
        lo = hi
    return out


def fingerprint(text: Column, points: tuple[int, ...] = POINTS) -> Column:
    """Array of the residues; null for a null text."""

    @F.arrow_udf("array<bigint>")
    def of(column: pa.Array) -> pa.Array:
        column = column.cast(pa.large_string())
        got = fingerprints(column, points).astype(np.int64)
        valid = column.is_valid().to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(valid * len(points))]).astype(np.int32)
        offsets = pa.array(np.where(np.append(valid, True), ends, 0), pa.int32(), mask=np.append(~valid, False))
        return pa.ListArray.from_arrays(offsets, pa.array(got[valid].reshape(-1)))

    return of(text)


def huge_fingerprints(df: DataFrame, id_col: str, text_col: str, piece: int = HUGE, points: tuple[int, ...] = POINTS) -> DataFrame:
    """(id, n_bytes, fp) of texts, each cut into pieces of `piece` bytes that tasks hash apart and an aggregation joins.

    Gives what fingerprint() gives. Rows need distinct ids; null texts are left out.
    """
    raw = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("b")).where("b is not null")
    cuts = raw.select("id", F.octet_length("b").alias("n"), F.explode(F.expr(f"transform(sequence(0, greatest(octet_length(b) - 1, 0) div {piece}), i -> struct(i as i, substring(b, i * {piece} + 1, {piece}) as b))")).alias("c"))

    @F.arrow_udf("array<bigint>")
    def of(column: pa.Array) -> pa.Array:
        binary = column.cast(pa.large_binary())
        as_text = pa.Array.from_buffers(pa.large_string(), len(binary), binary.buffers(), binary.null_count, binary.offset)
        got = fingerprints(as_text, points).astype(np.int64)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(binary) + 1) * len(points), pa.int32()), pa.array(got.reshape(-1)))

    hashed = cuts.repartition("id", "c.i").select("id", "n", F.col("c.i").alias("i"), F.octet_length("c.b").alias("m"), of("c.b").alias("h"))
    joined = hashed.groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("i", "m", "h"))).alias("all"))

    @F.arrow_udf("array<bigint>")
    def join(column: pa.Array) -> pa.Array:
        out = []
        for parts in column.to_pylist():
            acc = (0, (0,) * len(points))
            for p in parts:
                acc = combine(acc, (p["m"], tuple(p["h"])), points)
            out.append(list(acc[1]))
        return pa.array(out, pa.list_(pa.int64()))

    return joined.select("id", "n", join("all").alias("fp")).withColumnRenamed("n", "n_bytes")


def _equal(a: memoryview, b: memoryview) -> bool:
    return len(a) == len(b) and all(a[i : i + COMPARE] == b[i : i + COMPARE] for i in range(0, len(a), COMPARE))


def _stream(key: int, text: int, id_: int):
    """Rows come by key and rank; keeps of each key a text of each kind, the first being nearly always the only one."""

    def run(batches):
        now, kinds = None, []
        for batch in batches:
            first, has = [], np.zeros(batch.num_rows, bool)
            keys, texts, ids = batch.column(key).to_pylist(), batch.column(text).cast(pa.large_binary()), batch.column(id_)
            for r, k in enumerate(keys):
                if k != now:
                    now, kinds = k, []
                mine = memoryview(texts[r].as_buffer()).cast("B")
                same = next((i for seen, i in kinds if _equal(seen, mine)), None)
                if same is None:
                    kinds.append((memoryview(bytes(mine)), ids[r]))
                has[r] = same is not None
                first.append(None if same is None else same.as_py())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(has), pa.array(first, ids.type)], names=[*batch.schema.names, "__dup", "__first"])

    return run


def _compared(rows: DataFrame, stream: int) -> DataFrame:
    """rows (of groups of __c rows with __fp and __n) with __dup and __first, compared in streams of about `stream` rows."""
    salt = F.pmod(F.xxhash64("__id", "__tie", "__level"), F.ceil(F.col("__c") / stream))
    packed = rows.withColumn("__key", F.concat_ws("|", F.array_join(F.col("__fp").cast("array<string>"), ","), F.col("__n").cast("string"), salt.cast("string")))
    ordered = packed.repartition("__key").sortWithinPartitions("__key", F.col("__id").asc_nulls_last(), "__tie")
    names = ordered.columns
    schema = T.StructType([*ordered.schema, T.StructField("__dup", T.BooleanType()), T.StructField("__first", ordered.schema["__id"].dataType)])
    return ordered.mapInArrow(_stream(names.index("__key"), names.index("__text"), names.index("__id")), schema).drop("__key")


def known_prints(base: DataFrame, points: tuple[int, ...] = POINTS, huge: int = HUGE) -> DataFrame:
    """(__id, __th, __n, __fp, __w) of rows (__id, __th, __n, __text), __w being how many rows it stands for.

    Texts of more than `huge` bytes are hashed in pieces.
    """
    rows = base.where("__text is not null")
    plain = rows.where(F.col("__n") <= huge).select("__id", "__th", "__n", fingerprint(F.col("__text"), points).alias("__fp"), F.lit(1).cast("bigint").alias("__w"))
    # Equal rows are hashed once: a key tells their texts apart by 64 bits and their length.
    long = rows.where(F.col("__n") > huge).select(F.struct("__id", "__th", "__n").alias("k"), "__text")
    count = long.groupBy("k").agg(F.count("*").alias("copies"), F.first("__text").alias("text"))
    parts = huge_fingerprints(count.select(F.struct("k", "copies").alias("k"), "text"), "k", "text", huge, points)
    return plain.unionAll(parts.select("id.k.__id", "id.k.__th", "id.k.__n", "fp", "id.copies"))


def _marked(df: DataFrame, id_col: str, text_col: str, whole: bool, points: tuple[int, ...], stream: int, huge: int) -> tuple[DataFrame, list[DataFrame]]:
    """Rows that share no fingerprint, and the compared rows of each level; with all columns in __row if whole."""
    small_batches(df.sparkSession)
    others = [F.col(f"`{c}`") for c in df.columns]
    base = df.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").cast("string").alias("__text"), *([F.struct(*others).alias("__row")] if whole else []))
    base = base.select("*", F.when(F.col("__text").isNotNull(), F.xxhash64("__text")).alias("__th"), F.octet_length("__text").alias("__n"))
    known = cut(known_prints(base, points, huge))
    count = known.groupBy("__fp", "__n").agg(F.sum("__w").alias("__c")).where("__c > 1")
    keys = cut(known.join(count, ["__fp", "__n"]).select(F.col("__id").alias("__kid"), F.col("__th").alias("__kth"), "__fp", "__c").distinct())
    same = base["__id"].eqNullSafe(F.col("__kid")) & (base["__th"] == F.col("__kth"))
    alone = base.join(keys, same, "left_anti")
    shared = base.join(keys, same).drop("__kid", "__kth", "__th").withColumn("__tie", F.xxhash64("__row") if whole else F.lit(0).cast("bigint"))
    # A group of more than `stream` rows is compared in several streams, then the first rows of these, and so on.
    most = keys.agg(F.max("__c")).first()[0] or 0
    levels = [_compared(shared.withColumn("__level", F.lit(0)), stream)]
    while most > stream:
        most = -(-most // stream)
        heads = levels[-1].where(~F.col("__dup") & (F.col("__c") > stream)).drop("__dup", "__first")
        levels.append(_compared(heads.withColumn("__c", F.ceil(F.col("__c") / stream)).withColumn("__level", F.col("__level") + 1), stream))
    return alone, levels


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, points: tuple[int, ...] = POINTS, stream: int = STREAM, huge: int = HUGE) -> DataFrame:
    """(doc_id, duplicate_of): every row but the first of each set of equal texts, with the first one's id."""
    _, levels = _marked(df, id_col, text_col, False, points, stream, huge)
    found, up = None, None
    for level in reversed(levels):
        dups = level.where("__dup").select("__id", "__first", "__fp", "__n")
        if up is not None:
            # The head of a stream may itself be a copy of the head of another.
            head = up.select(F.col("__id").alias("__head"), F.col("__first").alias("__root"), F.col("__fp").alias("__f"), F.col("__n").alias("__m"), F.lit(True).alias("__far")).distinct()
            met = dups.join(head, F.col("__first").eqNullSafe(F.col("__head")) & (F.col("__fp") == F.col("__f")) & (F.col("__n") == F.col("__m")), "left")
            dups = met.select("__id", F.when(F.col("__far"), F.col("__root")).otherwise(F.col("__first")).alias("__first"), "__fp", "__n")
        up = dups if up is None else up.unionAll(dups)
        found = up
    return found.select(F.col("__id").alias("doc_id"), F.col("__first").alias("duplicate_of"))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, points: tuple[int, ...] = POINTS, stream: int = STREAM, huge: int = HUGE) -> DataFrame:
    """The rows of df that stay, with the columns of df."""
    alone, levels = _marked(df, id_col, text_col, True, points, stream, huge)
    kept = alone.select("__row")
    for level in levels:
        kept = kept.unionAll(level.where(~F.col("__dup") & (F.col("__c") <= stream)).select("__row"))
    return kept.select("__row.*")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


SQL = """
SELECT doc_id, duplicate_of FROM (
  SELECT doc_id,
         first_value(doc_id) OVER (PARTITION BY text ORDER BY doc_id NULLS LAST) AS duplicate_of,
         row_number() OVER (PARTITION BY text ORDER BY doc_id NULLS LAST) AS rn
  FROM documents WHERE text IS NOT NULL)
WHERE rn > 1
"""
