"""Byte-pair encoding by forced boundaries, and decoding.

A pair of bytes that stands inside no token of the vocabulary is a certain cut, as are the borders of the pieces of the
pre-tokenizing pattern. The fragments between cuts are encoded independently, each distinct one once, and the results
are concatenated; ids are those of the vocabulary's own encoder. Fragments are found again by a hash and then compared
byte by byte. Decoding looks up the bytes of the ids.

A null text has null tokens, an empty one none. Texts of any length are encoded whole, long ones in parts between certain
cuts. Every row gives one row, repeated or with a null id; ids keep their type and further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.llm._spark import pick, table
from treeline.llm._text import BLOCK, blocks, give_back, span_hashes, text_bytes
from treeline.llm._vocabulary import Vocabulary, borders, rank_file

#: Fragments and bytes of fragments that a worker remembers; then it starts afresh.
REMEMBER, REMEMBER_BYTES = 1 << 18, 1 << 26

_encoders: dict = {}


class Encoder:
    def __init__(self, ranks: bytes):
        self.vocabulary = Vocabulary(ranks)
        self.forget()

    def forget(self) -> None:
        self.known: dict[int, int] = {}
        self.twins: dict[bytes, int] = {}
        self.count = 0
        self.ids, self.used = np.zeros(1 << 16, np.int32), 0
        self.raw, self.filled = np.zeros(1 << 18, np.uint8), 0
        #: Of each fragment: where its ids and its bytes begin, and how many there are.
        self.at, self.size, self.raw_at, self.raw_size = (np.zeros(1 << 16, np.int64) for _ in range(4))

    def _learn(self, fragment: bytes) -> int:
        got = self.vocabulary.piece(fragment)
        k = self.count
        self.count += 1
        if k == len(self.at):
            self.at, self.size, self.raw_at, self.raw_size = (np.resize(x, 2 * k) for x in (self.at, self.size, self.raw_at, self.raw_size))
        while self.used + len(got) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        while self.filled + len(fragment) > len(self.raw):
            self.raw = np.resize(self.raw, 2 * len(self.raw))
        self.ids[self.used : self.used + len(got)] = got
        self.raw[self.filled : self.filled + len(fragment)] = np.frombuffer(fragment, np.uint8)
        self.at[k], self.size[k], self.raw_at[k], self.raw_size[k] = self.used, len(got), self.filled, len(fragment)
        self.used += len(got)
        self.filled += len(fragment)
        return k

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text's begin (one more than texts)."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        if self.count > REMEMBER or self.filled > REMEMBER_BYTES:
            self.forget()
        begin = np.flatnonzero(self.vocabulary.cuts(data, offsets))
        end = np.append(begin[1:], len(data))
        h, first, which = np.unique(span_hashes(data, begin, end), return_index=True, return_inverse=True)
        get = self.known.get
        hashes = h.tolist()
        k = np.array([get(x, -1) for x in hashes])
        for i in np.flatnonzero(k < 0).tolist():
            f = first[i]
            k[i] = self.known[hashes[i]] = self._learn(data[begin[f] : end[f]].tobytes())
        k = k[which]
        # Other bytes may have the same hash: what was learnt is compared with what is here.
        length = end - begin
        there = self.raw[np.minimum(np.repeat(self.raw_at[k] - begin, length) + np.arange(len(data)), len(self.raw) - 1)]
        other = np.logical_or.reduceat(there != data, begin) | (self.raw_size[k] != length)
        for i in np.flatnonzero(other).tolist():
            fragment = data[begin[i] : end[i]].tobytes()
            if fragment not in self.twins:
                self.twins[fragment] = self._learn(fragment)
            k[i] = self.twins[fragment]
        size = self.size[k]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(self.at[k] - total[:-1], size) + np.arange(total[-1])]
        return ids, total[np.searchsorted(begin, offsets)]

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids, and where those of each row begin."""
        v = self.vocabulary
        size = v.length[ids]
        total = np.concatenate([[0], np.cumsum(size)])
        data = v.flat[np.repeat(v.start[ids] - total[:-1], size) + np.arange(total[-1])]
        return data, total[ends]


def encoder(ranks) -> Encoder:
    """The worker's encoder of a broadcast rank file."""
    key = hash(ranks.value)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(ranks.value)
    return _encoders[key]


def encoded(text: Column, ranks) -> Column:
    """array<int> of a text."""

    @F.arrow_udf("array<int>")
    def of(column: pa.Array) -> pa.Array:
        e = encoder(ranks)
        data, offsets, valid = text_bytes(column)
        offsets, own = borders(data, offsets, BLOCK)
        parts, ends = [], [np.zeros(1, np.int64)]
        for lo, hi in blocks(offsets):
            ids, at = e.encode(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            parts.append(ids)
            ends.append(at[1:] + ends[-1][-1])
        ids, ends = np.concatenate([np.zeros(0, np.int32), *parts]), np.concatenate(ends)[own].astype(np.int32)
        where = pa.array(ends, mask=np.append(~valid, False)) if not valid.all() else pa.array(ends)
        give_back()
        return pa.ListArray.from_arrays(where, pa.array(ids))

    return of(text)


def decoded(tokens: Column, ranks) -> Column:
    """Text of an array of ids; bytes that are no text of themselves become the replacement character."""

    @F.arrow_udf("string")
    def of(column: pa.Array) -> pa.Array:
        e = encoder(ranks)
        column = column.cast(pa.list_(pa.int32()))
        offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4) if len(column) else np.zeros(1, np.int32)
        ids = column.values.to_numpy(zero_copy_only=False)
        valid = column.is_valid().to_numpy(zero_copy_only=False)
        parts = []
        for lo, hi in blocks(offsets.astype(np.int64), size=1 << 19, rows=1 << 30):
            own = ids[offsets[lo] : offsets[hi]]
            data, at = e.decode(own, offsets[lo : hi + 1] - offsets[lo])
            made = pa.Array.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
            try:
                made = made.cast(pa.large_string())
            except pa.ArrowInvalid:
                made = pa.array([x.as_py().decode("utf-8", "replace") for x in made], pa.large_string())
            parts.append(made)
        out = pa.concat_arrays(parts).cast(pa.string()) if parts else pa.array([], pa.string())
        return out if valid.all() else pa.compute.if_else(pa.array(valid), out, pa.scalar(None, pa.string()))

    return of(tokens)


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, verify: bool = True) -> DataFrame:
    """(doc_id, tokens, n_tokens, round_trip) of every row; round_trip: decoding gives the text, null without verify."""
    ranks = df.sparkSession.sparkContext.broadcast(rank_file(path))
    out = pick(df, id=id_col, text=text_col).withColumn("tokens", encoded(F.col("text"), ranks))
    same = decoded(F.col("tokens"), ranks) == F.col("text") if verify else F.lit(None).cast("boolean")
    return out.select(F.col("id").alias("doc_id"), "tokens", F.when(F.col("tokens").isNotNull(), F.size("tokens")).alias("n_tokens"), same.alias("round_trip"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))


SQL = None
