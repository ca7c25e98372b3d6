"""Passages of a benchmark in documents, to within an edit distance.

The CGK random walk copies a string to a longer one, staying at a character or moving on by shared random bits, so that
strings of small edit distance become strings of small Hamming distance. Windows of documents as long as an item are
embedded so, and repeated bit-sampling hashes them into buckets: each repetition reads a few places of the embedding, and
a window meets the items that are in its bucket in any repetition. What meets is verified by the exact edit distance.
The number of sampled places is the largest at which copies with the most edits allowed are still found with the target
recall, measured over all items when the index of items is built; repetitions are added where one place is too many,
and if that does not help either, every window is verified.

An item within k edits of a window keeps one of k + 1 equal pieces whole, so windows start only where a document has
such a piece: this drops no window within the distance. Items of more than SEGMENT bytes are indexed by segments: one of
them has no more than its share of the edits, and the whole item is verified around it. Items of fewer than 8 bytes
allow no edit and are searched for as they are.

Texts are compared as UTF-8 bytes with letters of ASCII and Latin-1 in lower case and each white space character as a
space. k is `share` of the item's bytes, rounded down. Null and empty texts hold nothing; null and empty items and items
with a null id are in nothing, and items of fewer than `min_item` bytes are left out if that is given. Repeated items are
reported each by its id, repeated rows of a document once, with the least distance. Null ids of documents are reported as
null. Ids keep their types, and other columns are not read.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from treeline.llm._spark import cut, pick, table
from treeline.llm._text import texts_of

SHARE = 0.06
#: Bytes of the parts of items that windows are compared with.
SEGMENT = 512
REPEATS, MOST_REPEATS = 32, 128
PLACES = 12
RECALL = 0.97
#: Bytes of items in one index, and indexes that a worker holds at a time; more items are searched for in further passes.
INDEX, AT_ONCE = 1 << 20, 8
_U = np.uint64

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32


def fold(data: np.ndarray) -> np.ndarray:
    out = _FOLD[data]
    lead = np.flatnonzero(data[:-1] == 0xC3) + 1 if len(data) else np.zeros(0, np.int64)
    upper = lead[(data[lead] >= 0x80) & (data[lead] <= 0x9E) & (data[lead] != 0x97)]
    out[upper] += 0x20
    return out


def edit_distance_within(item: bytes, region: bytes) -> int:
    """The least edit distance of item to any part of region, by bit-parallel columns."""
    m = len(item)
    if item in region:
        return 0
    peq: dict[int, int] = {}
    for i, c in enumerate(item):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best = m
    for c in region:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
        if score < best:
            best = score
    return best


class Index:
    """Items with their pieces, and buckets of their sampled embeddings."""

    def __init__(self, items: list[tuple[object, bytes]], share: float = SHARE, recall: float = RECALL, repeats: int = REPEATS, seed: int = 1, places: int = PLACES):
        """places: the most sampled places that are tried."""
        self.ids = [i for i, _ in items]
        self.texts = [t for _, t in items]
        self.size = np.array([len(t) for t in self.texts], np.int64)
        self.most = np.floor(self.size * share + 1e-9).astype(np.int64)
        self.short = [n for n, t in enumerate(self.texts) if len(t) < 8]
        self.item, self.offset, units = [], [], []
        for n, t in enumerate(self.texts):
            if len(t) >= 8:
                at = np.linspace(0, len(t), -(-len(t) // SEGMENT) + 1).astype(int).tolist()
                for lo, hi in zip(at, at[1:]):
                    self.item.append(n)
                    self.offset.append(lo)
                    units.append(t[lo:hi])
        self.item, self.offset, self.units = np.array(self.item, np.int64), np.array(self.offset, np.int64), units
        self.length = np.array([len(t) for t in units], np.int64)
        self.edits = np.floor(self.length * share + 1e-9).astype(np.int64)
        rows = []
        for u, (t, k) in enumerate(zip(units, self.edits.tolist())):
            step = len(t) // (k + 1)
            for p in range(k + 1):
                rows.append((int.from_bytes(t[p * step : p * step + 8], "little"), u, p * step, int.from_bytes(t[p * step + step - 8 : p * step + step], "little"), step - 8))
        rows.sort()
        self.piece, first = np.unique(np.array([r[0] for r in rows], _U), return_index=True)
        self.first = np.append(first, len(rows))
        self.of, self.within, self.last, self.further = np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64), np.array([r[3] for r in rows], _U), np.array([r[4] for r in rows], np.int64)
        self.bloom = np.zeros(1 << 18, bool)
        self.bloom[self._slot(self.piece)] = True
        self.recall, self.places = 1.0, places
        if units:
            self._choose(recall, repeats, places, np.random.default_rng(seed))

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return ((key * _U(0x9E3779B97F4A7C15)) >> _U(46)).astype(np.int64)

    def _buckets(self, places: int, repeats: int) -> None:
        """Random walks, sampled places (as shares of a walk) and the units in each bucket of each repetition."""
        rng = np.random.default_rng(places + 1000 * repeats)
        self.places, self.repeats = places, repeats
        self.walk = rng.integers(0, 2, (repeats, 2 * SEGMENT, 256), dtype=np.uint8)
        self.at = np.sort(rng.random((repeats, places)), 1)
        flat = np.frombuffer(b"".join(self.units), np.uint8)
        ends = np.cumsum(self.length)
        self.tables = []
        for r in range(repeats):
            key = self._bucket(flat, ends - self.length, ends, self.length, r)
            order = np.argsort(key, kind="stable")
            keys, first = np.unique(key[order], return_index=True)
            self.tables.append((keys, np.append(first, len(key)), order))

    def _bucket(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, length: np.ndarray, r: int) -> np.ndarray:
        """Buckets in repetition r of the strings data[start:end], as windows of the given lengths; zeros follow their end."""
        places = (self.at[r] * 2 * length[:, None]).astype(np.int64)
        steps = int(places.max(initial=-1)) + 1
        out = np.zeros((steps, len(start)), np.uint8)
        at, last = start.copy(), len(data) - 1
        for j in range(steps):
            c = data[np.minimum(at, last)]
            c[at >= end] = 0
            out[j] = c
            at += self.walk[r, j, c]
        key = length.astype(_U)
        for p in range(self.places):
            key = (key ^ out[places[:, p], np.arange(len(start))].astype(_U)) * _U(0x9E3779B97F4A7C15)
            key ^= key >> _U(29)
        return key

    def _choose(self, recall: float, repeats: int, most: int, rng) -> None:
        """The most sampled places at which copies with the most edits are found with the wanted recall."""
        texts, want = [], []
        for n in np.tile(np.arange(len(self.units)), -(-200 // len(self.units))).tolist():
            t = bytearray(self.units[n])
            for _ in range(self.edits[n]):
                kind, at, c = rng.integers(0, 3), int(rng.integers(0, len(t))), int(rng.integers(97, 123))
                if kind == 0:
                    t[at] = c
                elif kind == 1:
                    t.insert(at, c)
                else:
                    del t[at]
            texts.append(bytes(rng.integers(97, 123, 30, dtype=np.uint8)) + bytes(t) + bytes(rng.integers(97, 123, 30, dtype=np.uint8)))
            want.append(n)
        data = np.frombuffer(b"".join(texts), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        found = self.windows(data, offsets)
        for places, times in [(p, repeats) for p in range(most, 0, -1)] + [(1, t) for t in (2 * repeats, 4 * repeats) if t <= MOST_REPEATS] + [(0, 1)]:
            self._buckets(places, times)
            row, unit, _ = self._meeting(data, offsets, *found)
            hit = set(zip(row.tolist(), unit.tolist()))
            self.recall = sum((r, n) in hit for r, n in enumerate(want)) / len(want)
            if self.recall >= recall:
                return

    def windows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, unit, start) of all windows that begin so that one piece of the unit is in its place. data is folded."""
        z = np.zeros(0, np.int64)
        if not len(self.units):
            return z, z, z
        padded = np.zeros(len(data) + 16, np.uint8)
        padded[: len(data)] = data
        eight = np.ndarray((len(data) + 9,), "<u8", padded, 0, (1,))
        starts, units, places = [z], [z], [z]
        for lo in range(0, len(data), 1 << 20):
            key = eight[lo : min(lo + (1 << 20), len(data))]
            maybe = np.flatnonzero(self.bloom[self._slot(key)])
            at = np.searchsorted(self.piece, key[maybe])
            real = self.piece[np.minimum(at, len(self.piece) - 1)] == key[maybe]
            at, pos = at[real], maybe[real] + lo
            count = self.first[at + 1] - self.first[at]
            which = np.repeat(self.first[at], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            pos = np.repeat(pos, count)
            # The last bytes of the piece as well.
            same = eight[np.minimum(pos + self.further[which], len(data) + 8)] == self.last[which]
            starts.append(pos[same] - self.within[which[same]])
            units.append(self.of[which[same]])
            places.append(pos[same])
        start, unit = np.concatenate(starts), np.concatenate(units)
        # A window may begin before its text: the piece that it was found by tells which text it is of.
        row = np.searchsorted(offsets, np.concatenate(places), "right") - 1
        start = np.maximum(start, offsets[row])
        fits = offsets[row + 1] - offsets[row] >= (self.length - self.edits)[unit]
        row, unit, start = row[fits], unit[fits], start[fits]
        keep = np.unique(np.stack([unit, start], 1), axis=0, return_index=True)[1] if len(row) else z
        return row[keep], unit[keep], start[keep]

    def _meeting(self, data, offsets, row, unit, start):
        """(row, unit, start) of windows and the units that are in their bucket in some repetition."""
        z = np.zeros(0, np.int64)
        out = [(z, z, z)]
        end = np.minimum(start + self.length[unit], offsets[row + 1])
        for lo in range(0, len(row), 1 << 14):
            left = np.arange(lo, min(lo + (1 << 14), len(row)))
            for r, (keys, first, order) in enumerate(self.tables):
                key = self._bucket(data, start[left], end[left], self.length[unit[left]], r)
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                hit = keys[at] == key
                w, at = left[hit], at[hit]
                count = first[at + 1] - first[at]
                which = order[np.repeat(first[at], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
                w = np.repeat(w, count)
                out.append((row[w], which, start[w]))
                # A window that met the unit whose piece it has is done.
                left = np.setdiff1d(left, w[which == unit[w]], assume_unique=False)
                if not len(left):
                    break
        return tuple(np.concatenate(x) for x in zip(*out))

    def search(self, data: np.ndarray, offsets: np.ndarray) -> dict[tuple[int, int], int]:
        """{(row, item): least edit distance} within the distance allowed. data is raw, offsets count from its start."""
        if not self.texts or not len(data):
            return {}
        data = fold(data)
        out: dict[tuple[int, int], int] = {}
        if self.short:
            raw = data.tobytes()
            for r, (a, z) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                out |= {(r, n): 0 for n in self.short if raw.find(self.texts[n], a, z) >= 0}
        row, unit, start = self._meeting(data, offsets, *self.windows(data, offsets))
        item = self.item[unit]
        met = sorted(set(zip(row.tolist(), item.tolist(), (start - self.offset[unit]).tolist())))
        for (r, i), at in groupby(met, lambda x: x[:2]):
            k, size = int(self.most[i]), int(self.size[i])
            # Regions that overlap are compared as one.
            regions: list[list[int]] = []
            for _, _, s in at:
                a, z = max(int(offsets[r]), s - 2 * k), min(int(offsets[r + 1]), s + size + 2 * k)
                if regions and a <= regions[-1][1]:
                    regions[-1][1] = max(z, regions[-1][1])
                else:
                    regions.append([a, z])
            d = min((edit_distance_within(self.texts[i], data[a:z].tobytes()) for a, z in regions if z > a), default=size)
            if d <= k:
                out[r, i] = d
        return out


def build_indexes(bench: DataFrame, id_col: str = "item_id", text_col: str = "text", share: float = SHARE, size: int = INDEX, min_item: int = 1) -> list[list]:
    """Broadcast indexes of about `size` bytes of items at most each, in groups for one pass over the documents.

    So what a worker holds does not grow with the benchmark; its items are read once.
    """
    spark = bench.sparkSession
    items = pick(bench, id=id_col, text=text_col).where("text is not null and id is not null").distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    slices = max(1, -(-int(total) // size))
    out, places = [], PLACES
    placed = items.withColumn("s", F.pmod(F.xxhash64("id", "text"), F.lit(slices))).orderBy("s", "id", "text")
    for _, rows in groupby(placed.toLocalIterator(), lambda r: r["s"]):
        folded = [(r["id"], fold(np.frombuffer(r["text"].encode(), np.uint8)).tobytes()) for r in rows]
        folded = [(i, t) for i, t in folded if len(t) >= max(1, min_item)]
        if folded:
            # Items of one benchmark are alike: the next index tries few more places than did for this one.
            index = Index(folded, share, places=places)
            places = min(PLACES, index.places + 2)
            out.append(spark.sparkContext.broadcast(index))
    return [out[k : k + AT_ONCE] for k in range(0, len(out), AT_ONCE)]


def leaks(text: Column, indexes: list, kind: T.DataType) -> Column:
    """Array of (item_id, distance) of the items of some indexes in a text; empty for null. kind: type of the items' ids."""
    arrow = pa.list_(pa.struct([("item_id", to_arrow_type(kind)), ("distance", pa.int32())]))

    @F.arrow_udf(T.ArrayType(T.StructType([T.StructField("item_id", kind), T.StructField("distance", T.IntegerType())])))
    def of(column: pa.Array) -> pa.Array:
        found: list[list] = [[] for _ in range(len(column))]
        for lo, _, data, offsets in texts_of(column):
            for b in indexes:
                for (r, i), d in sorted(b.value.search(data, offsets).items()):
                    found[lo + r].append({"item_id": b.value.ids[i], "distance": d})
        return pa.array(found, arrow)

    return of(text)


def contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, item_col: str = "item_id", item_text_col: str = "text", share: float = SHARE, min_item: int = 1) -> DataFrame:
    """(doc_id, item_id, distance) of all items found in documents."""
    kind, texts = bench.schema[item_col].dataType, pick(docs, id=id_col, text=text_col)
    found = None
    for indexes in build_indexes(bench, item_col, item_text_col, share, min_item=min_item) or [[]]:
        part = texts.select("id", F.explode(leaks(F.col("text"), indexes, kind)).alias("l"))
        found = part if found is None else found.unionAll(part)
    return found.groupBy(F.col("id").alias("doc_id"), F.col("l.item_id").alias("item_id")).agg(F.min("l.distance").alias("distance"))


def decontaminate(docs: DataFrame, bench: DataFrame, text_col: str = "text", *, item_col: str = "item_id", item_text_col: str = "text", share: float = SHARE, min_item: int = 1) -> DataFrame:
    """The rows of docs that hold no item, with all their columns."""
    kind = bench.schema[item_col].dataType
    for n, indexes in enumerate(build_indexes(bench, item_col, item_text_col, share, min_item=min_item)):
        docs = (cut(docs) if n else docs).where(F.size(leaks(F.col(f"`{text_col}`").cast("string"), indexes, kind)) == 0)
    return docs


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = None
