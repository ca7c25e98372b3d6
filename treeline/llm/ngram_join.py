"""Self-join of texts on the Jaccard similarity of their word n-gram sets, exact, by prefixes of token combinations.

Tokens are the n-grams, in one order for all texts: by frequency class, then by hash. If two sets have enough tokens in
common for the threshold t, then the first |x| - ceil(t|x|) + k tokens of each have k in common, for any k. The extension
k is 2 for small sets and grows with the set, and the smaller of two sets' k holds for both. So either two frequent tokens
are common to both prefixes, or all but one of the k are rare: rare tokens are indexed singly and counted, frequent ones
are indexed only in combinations of two. What passes is verified on whole sets.

Prefixes are indexed for the smallest set that a set may be linked to. With the sizes of both sets known, they must have
o = t(|x| + |y|) / (1 + t) tokens in common, and the first |x| - o + k and |y| - o + k have k of them: what two sets share
is counted only there.

Frequency classes come from counts over all documents. They only order the tokens and tell rare from frequent; they
never decide about a pair, so that hash collisions among them cost time alone.

A word is a run of letters and digits of ASCII and of characters beyond it, in lower case. A text of fewer words than n
is one n-gram; a null text or one without words joins nothing, and rows with a null id are left out. A document is an id
with a set of n-grams: repeated rows are one document, an id that repeats with another set is another one. Equal sets are
indexed once, and copies are never expanded into pairs: the result has one row for each document that has a link, with
the class it belongs to (documents connected by links; its least id) and the number of its links, which are all other
documents at or above the threshold. Ids may be of any type that sorts. Sets are of 53-bit hashes of n-grams, and a set
is known by 64 bits of fingerprint.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.llm._spark import cut, pick, pieces, table
from treeline.llm._text import GRAM_BITS, give_back, gram_sets, mix, pack, texts_of, unpack

N = 2
THRESHOLD = 0.7
#: Tokens in a combination, and the least extension of a prefix.
K = 2
#: One token more in a prefix, and in what must be common, for so many tokens of a set.
EXTEND = 20
#: The table of frequency classes has 2**CLASS_BITS bytes at any size of the input.
CLASS_BITS = 24
#: Text bytes whose tokens one task counts or joins.
PART = 1 << 26
#: A token is frequent if it occurs in more documents than LEAST and than one in SHARE of them, MOST at most.
LEAST, SHARE, MOST = 64, 64, 16384
FLUSH = 1 << 22
#: Pairs that a task gathers before it adds up equal ones, and entries that it pairs at a time.
PAIRS = 1 << 18
#: Pairs, and bytes of sets, that are verified at a time.
TOGETHER, HELD = 1 << 16, 1 << 24
#: What a common combination counts.
COMBINED = 1 << 40
_U = np.uint64


def _tokens(batches, n: int):
    """For runs of rows of batches of texts: number of rows, row and hash of each distinct token."""
    for batch in batches:
        for lo, hi, data, offsets in texts_of(batch.column(0)):
            row, g = gram_sets(data, offsets, n)
            yield hi - lo, row, g


def _set_prints(row: np.ndarray, g: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint (a sum of scrambled hashes, order-free) and size of each row's set."""
    size = np.bincount(row, minlength=rows)
    ends = np.concatenate([[0], np.cumsum(size)])
    total = np.zeros(len(g) + 1, _U)
    np.cumsum(mix(g + _U(0x51ED270B)), out=total[1:])
    return mix(total[ends[1:]] - total[ends[:-1]] + size.astype(_U)).view(np.int64), size


def _class_counter(n: int, parts: int):
    """Map side: token codes of 32 bits, sorted, cut by range into parts."""
    shift = 32 - int(math.log2(parts))

    def flush(held):
        codes = np.sort(np.concatenate(held))
        at = np.searchsorted(codes, (np.arange(1, parts, dtype=np.uint64) << _U(shift)).astype(np.uint32))
        blobs = [pack(x) for x in np.split(codes, at)]
        return pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array(blobs, pa.binary())], names=["p", "blob"])

    def run(batches):
        held, count = [], 0
        for _, _, g in _tokens(batches, n):
            held.append((g >> _U(GRAM_BITS - 32)).astype(np.uint32))
            count += len(g)
            if count >= FLUSH:
                yield flush(held)
                held, count = [], 0
        if count:
            yield flush(held)

    return run


def frequency_classes(texts: DataFrame, n: int, total_bytes: int) -> bytes:
    """Table of 2**CLASS_BITS classes: 0 for tokens of few documents, else the binary logarithm of their number."""
    parts = pieces(total_bytes, PART)
    bucket = CLASS_BITS - int(math.log2(parts))
    floor = max(8, total_bytes // (6 << CLASS_BITS))

    def count(batch: pa.Table) -> pa.Table:
        codes = np.sort(np.concatenate([unpack(x) for x in batch.column("blob").to_pylist() if x] or [np.zeros(0, np.uint32)]))
        out = np.zeros(1 << bucket, np.uint8)
        if len(codes):
            first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
            df = np.diff(first, append=len(codes))
            often = df >= floor
            slot = (codes[first[often]] >> np.uint32(32 - CLASS_BITS)) & np.uint32((1 << bucket) - 1)
            np.maximum.at(out, slot, np.log2(df[often]).astype(np.uint8))
        return pa.table({"p": pa.array([batch.column("p")[0].as_py()], pa.int32()), "classes": pa.array([pa.compress(out.tobytes(), codec="zstd", asbytes=True)], pa.binary())})

    rows = texts.mapInArrow(_class_counter(n, parts), "p int, blob binary").groupBy("p").applyInArrow(count, "p int, classes binary").collect()
    out = np.zeros((parts, 1 << bucket), np.uint8)
    for r in rows:
        out[r["p"]] = np.frombuffer(pa.decompress(bytes(r["classes"]), decompressed_size=1 << bucket, codec="zstd", asbytes=True), np.uint8)
    return out.tobytes()


def _index(n: int, t: float, parts: int, classes, frequent: int):
    """Map side of the index: for each part, entries of (token, number of the set, place of the token in the set) and the
    sets' fingerprints and sizes."""
    pbits = int(math.log2(parts))
    # Within a part 32 bits of a token, or all that are left, tell it from others; a rare mistake makes a candidate that
    # fails. The last of them tells combinations from single ones.
    spare = max(0, GRAM_BITS - pbits - 32)
    mark = _U(1 << spare)

    def flush(entries, owners, ranks, prints, sizes):
        token, owner, rank, fp, size = (np.concatenate(x) for x in (entries, owners, ranks, prints, sizes))
        order = np.argsort(token)
        token, owner, rank = token[order], owner[order], rank[order]
        at = np.searchsorted(token, np.arange(1, parts, dtype=np.uint64) << _U(GRAM_BITS - pbits))
        out = {k: [] for k in ("p", "token", "owner", "rank", "fp", "size")}
        for p, (tk, ow, rk) in enumerate(zip(np.split(token, at), np.split(owner, at), np.split(rank, at))):
            if len(tk):
                used, ow = np.unique(ow, return_inverse=True)
                code = (tk >> _U(spare)).astype(np.uint32)
                out["p"].append(p)
                out["token"].append(pack(code))
                out["owner"].append(ow.astype(np.uint16 if len(used) <= 1 << 16 else np.uint32).tobytes())
                out["rank"].append(rk.tobytes())
                out["fp"].append(fp[used].tobytes())
                out["size"].append(size[used].astype(np.int32).tobytes())
        return pa.RecordBatch.from_arrays([pa.array(out["p"], pa.int32()), *[pa.array(out[k], pa.binary()) for k in ("token", "owner", "rank", "fp", "size")]], names=list(out))

    def run(batches):
        table_ = np.frombuffer(classes.value, np.uint8)
        entries, owners, ranks, prints, sizes, count, sets = [], [], [], [], [], 0, 0
        for rows, row, g in _tokens(batches, n):
            fp, size = _set_prints(row, g, rows)
            cls = table_[(g >> _U(GRAM_BITS - CLASS_BITS)).astype(np.int64)]
            order = np.argsort((row.astype(_U) << _U(8 + 40)) | (cls.astype(_U) << _U(40)) | (g >> _U(GRAM_BITS - 40)), kind="stable")
            row, g, cls = row[order], g[order], cls[order]
            ends = np.concatenate([[0], np.cumsum(size)])
            need = np.ceil(t * size - 1e-9).astype(np.int64)
            rank = np.arange(len(g)) - ends[row]
            inside = rank < (size - need + K + size // EXTEND)[row]
            # A place that is said to be nearer the front than it is makes a candidate that fails.
            rank = np.minimum(rank, 0xFFFF).astype(np.uint16)
            often = (cls >= frequent) & (size > (K - 1) / t)[row]
            single = inside & ~often
            entries.append(g[single] & ~mark)
            owners.append(row[single] + sets)
            ranks.append(rank[single])
            both = np.flatnonzero(inside & often)
            # Pairs of frequent tokens of one prefix: with the 1st, 2nd, ... next one as long as any row has it.
            left, d = np.arange(len(both)), 1
            last = np.searchsorted(row[both], row[both], "right")
            while len(left := left[left + d < last[left]]):
                a, b = both[left], both[left + d]
                entries.append((mix(g[a] * _U(0xC2B2AE3D27D4EB4F) + g[b]) >> _U(64 - GRAM_BITS)) | mark)
                owners.append(row[a] + sets)
                ranks.append(rank[b])
                count += len(a)
                d += 1
            prints.append(fp)
            sizes.append(size)
            sets += rows
            count += int(single.sum())
            if count >= FLUSH // 2:
                yield flush(entries, owners, ranks, prints, sizes)
                entries, owners, ranks, prints, sizes, count, sets = [], [], [], [], [], 0, 0
        if sets:
            yield flush(entries, owners, ranks, prints, sizes)
        give_back()

    return run


def _candidates(t: float):
    """Reduce side: pairs of different sets whose sizes allow t, with how many entries of this part they share and need.

    A pair may come more than once: when more than PAIRS different ones are gathered, they are handed on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, owners, ranks, prints, sizes, base = [], [], [], [], [], 0
        for batch in batches:
            for r in range(len(batch)):
                blob, own, rank, fp, size = (batch.column(c)[r].as_buffer() for c in ("token", "owner", "rank", "fp", "size"))
                fp = np.frombuffer(fp, np.int64).copy()
                own = np.frombuffer(own, np.uint16 if len(fp) <= 1 << 16 else np.uint32)
                tokens.append(unpack(memoryview(blob)))
                owners.append(own.astype(np.uint32) + np.uint32(base))
                ranks.append(np.frombuffer(rank, np.uint16).copy())
                prints.append(fp)
                sizes.append(np.frombuffer(size, np.int32).copy())
                base += len(fp)
        fp, size = np.concatenate(prints), np.concatenate(sizes)
        del prints, sizes
        # Equal sets become one: the number of a set is its place among the distinct fingerprints.
        sets, first, same = np.unique(fp, return_index=True, return_inverse=True)
        size, same = size[first].astype(np.int64), same.astype(np.uint32)
        del fp, first
        key = np.concatenate(tokens).astype(_U)
        tokens.clear()
        key <<= _U(32)
        key |= same[np.concatenate(owners)]
        del owners, same
        order = np.argsort(key)
        key, rank = key[order], np.concatenate(ranks)[order]
        del order, ranks
        if len(key):
            once = np.concatenate([[True], key[1:] != key[:-1]])
            key, rank = key[once], rank[once]
        token, owner = (key >> _U(32)).astype(np.uint32), key.astype(np.uint32)
        del key
        # How many tokens of its set are from an entry's on.
        rest = size[owner].astype(np.int32) - rank
        del rank
        starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
        last = np.repeat(np.append(starts[1:], len(token)), np.diff(starts, append=len(token))) if len(token) else starts
        held, weights, count = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0

        def merged():
            pair, weight = np.concatenate(held), np.concatenate(weights)
            held.clear()
            weights.clear()
            order = np.argsort(pair)
            pair, weight = pair[order], weight[order]
            at = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, np.int64)
            return pair[at], np.add.reduceat(weight, at) if len(at) else weight

        def handed(found, shared):
            for lo in range(0, len(found), PAIRS // 8):
                pair = found[lo : lo + PAIRS // 8]
                a, b = pair // len(sets), pair % len(sets)
                # One less than the theorem needs, for two tokens of a set that look alike in 32 bits.
                need = np.maximum(1, K - 2 + np.minimum(size[a], size[b]) // EXTEND)
                a, b = sets[a], sets[b]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(shared[lo : lo + len(pair)]), pa.array(need)], names=["a", "b", "shared", "need"])

        for lo in range(0, len(token), PAIRS):
            left, d = np.arange(lo, min(lo + PAIRS, len(token))), 1
            while len(left := left[left + d < last[left]]):
                a, b = owner[left].astype(np.int64), owner[left + d].astype(np.int64)
                less, more = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
                common = np.ceil(t / (1 + t) * (less + more) - 1e-9) - K - less // EXTEND
                ok = (less >= t * more - 1e-9) & (np.minimum(rest[left], rest[left + d]) > common)
                held.append(np.minimum(a, b)[ok] * len(sets) + np.maximum(a, b)[ok])
                weights.append(np.where(token[left][ok] & np.uint32(1), COMBINED, 1))
                count += len(held[-1])
                # As much is gathered as was found before, so that adding up stays in proportion.
                if count > max(PAIRS, len(held[0])):
                    pair, weight = merged()
                    if len(pair) > PAIRS:
                        yield from handed(pair, weight)
                        pair, weight = pair[:0], weight[:0]
                    held, weights, count = [pair], [weight], 0
                d += 1
        yield from handed(*merged())
        del token, owner, rest, last
        give_back()

    return run


def _sets(n: int):
    """(fp, m, grams): whole sets with their least scrambled hash, which near copies mostly have in common."""

    def run(batches):
        for rows, row, g in _tokens(batches, n):
            fp, size = _set_prints(row, g, rows)
            ends = np.concatenate([[0], np.cumsum(size)])
            some = np.flatnonzero(size)
            if len(some):
                m = np.minimum.reduceat(mix(g), ends[some]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(fp[some]), pa.array(m), pa.array([g[ends[r] : ends[r + 1]].tobytes() for r in some], pa.binary())], names=["fp", "m", "grams"])

    return run


def _verify(t: float):
    def run(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        own = {f: np.frombuffer(g.as_buffer(), _U) for f, g in zip(sets.column("fp").to_pylist(), sets.column("grams"))}
        a, b, j = [], [], []
        for x, y in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist()):
            p, q = own[x], own[y]
            both = np.concatenate([p, q])
            both.sort()
            o = int(np.count_nonzero(both[1:] == both[:-1]))
            if o and o >= t * (len(both) - o) - 1e-12:
                a.append(x)
                b.append(y)
                j.append(o / (len(both) - o))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "jaccard": pa.array(j, pa.float64())})

    return run


def _prepared(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, th, text): th is the hash of the text as it is, text is in lower case."""
    return pick(df, id=id_col, text=text_col).where("id is not null and text is not null").select("id", F.xxhash64("text").alias("th"), F.lower("text").alias("text"))


def _prints(text, n: int):
    """struct(fp, size) of a text's set.

    Said to be nondeterministic, as a condition on it is otherwise moved before it and works out the sets a second time, in
    a second Python worker for each task.
    """

    @F.arrow_udf("struct<fp:bigint,size:int>")
    def of(column: pa.Array) -> pa.Array:
        fp, size = np.zeros(len(column), np.int64), np.zeros(len(column), np.int32)
        for lo, hi, data, offsets in texts_of(column):
            row, g = gram_sets(data, offsets, n)
            fp[lo:hi], size[lo:hi] = _set_prints(row, g, hi - lo)
        return pa.StructArray.from_arrays([pa.array(fp), pa.array(size)], ["fp", "size"])

    return of.asNondeterministic()(text)


def _known(docs: DataFrame, n: int) -> DataFrame:
    """(id, th, fp) of all texts with words."""
    return docs.select("id", "th", _prints(F.col("text"), n).alias("s")).where("s.size > 0").select("id", "th", "s.fp")


def _placed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, at) of all pairs: pairs with the same least hash of a set lie in one bucket, as long as they and their sets
    are no more than a task may hold."""
    about = sets.select("fp", "m", F.octet_length("grams").cast("long").alias("bytes"))
    both = pairs.join(about.toDF("a", "ma", "bytes_a"), "a").join(about.toDF("b", "mb", "bytes_b"), "b")
    keyed = cut(both.select("a", "b", F.least("ma", "mb").alias("key"), "bytes_a", "bytes_b"))
    own = keyed.select("key", F.explode(F.array(F.struct(F.col("a").alias("fp"), F.col("bytes_a").alias("bytes")), F.struct(F.col("b").alias("fp"), F.col("bytes_b").alias("bytes")))).alias("s")).select("key", "s.*").distinct()
    held = own.groupBy("key").agg(F.sum("bytes").alias("bytes")).join(keyed.groupBy("key").agg(F.count("*").alias("pairs")), "key")
    # A key of very many pairs or bytes is cut into squares, each with a part of the sets for either side.
    squares = F.greatest(F.ceil(F.sqrt(F.col("pairs") / TOGETHER)), F.when(F.col("bytes") > HELD, F.ceil(2 * F.col("bytes") / HELD)).otherwise(1))
    cells = cut(held.withColumn("s", squares))
    sums = cells.agg(F.coalesce(F.sum(F.when(F.col("s") > 1, 2 * F.col("s")).otherwise(1) * F.col("bytes")), F.lit(0)), F.coalesce(F.sum("pairs"), F.lit(0))).first()
    buckets = max(pieces(int(sums[0]), HELD, 16), pieces(int(sums[1]), TOGETHER, 16))
    return keyed.join(cells.select("key", "s"), "key").select("a", "b", F.pmod(F.xxhash64("key", F.pmod("a", "s"), F.pmod("b", "s")), F.lit(buckets)).cast("int").alias("at"))


def set_pairs(df: DataFrame, id_col: str, text_col: str, n: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(id, th, fp) of all texts with words, and (a, b, jaccard) of the pairs of different sets."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    spark = df.sparkSession
    docs = _prepared(df, id_col, text_col)
    texts = docs.select("text")
    sized = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    total, documents = int(sized[0]), int(sized[1])
    parts = pieces(total, PART // 2)

    known = cut(_known(docs, n))
    classes = spark.sparkContext.broadcast(frequency_classes(texts, n, total))
    frequent = int(math.log2(max(LEAST, min(documents // SHARE, MOST)))) + 1
    index = texts.mapInArrow(_index(n, threshold, parts, classes, frequent), "p int, token binary, owner binary, rank binary, fp binary, size binary")
    found = index.groupBy("p").applyInArrow(_candidates(threshold), "a bigint, b bigint, shared bigint, need bigint")
    pairs = cut(found.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.first("need").alias("need")).where("shared >= need").select("a", "b"))

    # One document of each set that is in a pair gives the set; the sets go where their pairs are verified.
    used = pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    one = known.join(used, "fp", "left_semi").groupBy("fp").agg(F.min(F.struct("id", "th")).alias("d")).select("d.id", "d.th")
    sets = docs.join(one, ["id", "th"], "left_semi").select("text").mapInArrow(_sets(n), "fp bigint, m bigint, grams binary")
    # Repeated rows of a document give its set more than once.
    sets = cut(sets.dropDuplicates(["fp"]))
    placed = cut(_placed(pairs, sets))
    where = placed.select("at", F.explode(F.array("a", "b")).alias("fp")).distinct()
    sent = where.join(sets, "fp").select(F.col("at").alias("to"), "fp", "grams")
    verified = placed.groupBy("at").cogroup(sent.groupBy("to")).applyInArrow(_verify(threshold), "a bigint, b bigint, jaccard double")
    return known, verified


def ngram_jaccard_links(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, n_links) of every document that another one is linked to; class_id is the least id of its class."""
    known, pairs = set_pairs(df, id_col, text_col, n, threshold)
    pairs = cut(pairs.select("a", "b"))
    documents = known.select("id", "fp").distinct()
    sets = documents.groupBy("fp").agg(F.count("*").alias("copies"), F.min("id").alias("least"))
    ways = pairs.unionAll(pairs.select("b", "a"))
    others = ways.join(sets.select(F.col("fp").alias("b"), "copies"), "b").groupBy("a").agg(F.sum("copies").alias("others"))
    linked = cut(sets.join(others, F.col("fp") == F.col("a"), "left").withColumn("others", F.coalesce("others", F.lit(0))).where("copies > 1 or others > 0").select("fp", "copies", "least", "others"))
    root = components(pairs).select(F.col("id").alias("x"), "root")
    classed = linked.join(root, F.col("fp") == F.col("x"), "left").withColumn("root", F.coalesce("root", "fp"))
    least = classed.groupBy("root").agg(F.min("least").alias("class_id"))
    about = classed.join(least, "root").select("fp", "class_id", (F.col("copies") - 1 + F.col("others")).alias("n_links"))
    return documents.join(about, "fp").select(F.col("id").alias("doc_id"), "class_id", "n_links")


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of all ids in edges (a, b) but the roots: root is the least id of the connected component, by large and small stars."""
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct()
    before = None
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # Large star: neighbours above a go to the least of a's neighbourhood. Small star: the rest of it as well.
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a != b").distinct()
        up = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(up, "b").select(F.col("m").alias("p"), F.explode(F.array("a", "b")).alias("q")).where("p != q").select(F.col("p").alias("a"), F.col("q").alias("b")).distinct()
        edges = cut(small)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return edges.select(F.col("b").alias("id"), F.col("a").alias("root"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """(id, th) of the documents that go, th being xxhash64 of the text: one document of each class stays, that of the least id.

    Classes are of sets, so that an id that repeats with other texts does not join their classes.
    """
    known, pairs = set_pairs(df, id_col, text_col, n, threshold)
    # Most sets are of one document and in no pair.
    root = cut(components(cut(pairs.select("a", "b")))).select(F.col("id").alias("x"), "root")
    shared = known.groupBy("fp").agg(F.count("*").alias("c")).where("c > 1").select("fp")
    held = root.select(F.explode(F.array("x", "root")).alias("fp")).unionAll(shared).distinct()
    classed = cut(known.join(held, "fp", "left_semi").join(root, F.col("fp") == F.col("x"), "left").select("id", "th", F.coalesce("root", "fp").alias("root")).distinct())
    stays = classed.groupBy("root").agg(F.min(F.struct("id", "th")).alias("one")).select(F.col("one.id").alias("id"), F.col("one.th").alias("th"))
    return classed.select("id", "th").distinct().join(stays, ["id", "th"], "left_anti")


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_links(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9\x{80}-\x{10FFFF}]+'), lambda x: x <> '') AS ws
  FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
g AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 1 THEN [ws[1]]
    ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS gs
  FROM w WHERE len(ws) > 0),
e AS (SELECT doc_id, len(gs) AS n, unnest(gs) AS t FROM g),
p AS (
  SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, a.n AS na, b.n AS nb, count(*) AS o
  FROM e a JOIN e b ON a.t = b.t AND a.doc_id < b.doc_id AND a.n >= 0.7 * b.n - 1e-9 AND b.n >= 0.7 * a.n - 1e-9
  GROUP BY ALL),
pairs AS MATERIALIZED (SELECT doc_a, doc_b FROM p WHERE o >= 0.7 * (na + nb - o) - 1e-12),
ways AS MATERIALIZED (SELECT doc_a AS x, doc_b AS y FROM pairs UNION ALL SELECT doc_b, doc_a FROM pairs),
reach AS (SELECT x, y FROM ways UNION SELECT r.x, w.y FROM reach r JOIN ways w ON r.y = w.x),
class AS (SELECT x, least(x, min(y)) AS class_id FROM reach GROUP BY x)
SELECT ways.x AS doc_id, any_value(class.class_id) AS class_id, count(*) AS n_links
FROM ways JOIN class ON ways.x = class.x GROUP BY ways.x
"""
