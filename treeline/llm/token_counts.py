"""Numbers of tokens by a finite-state transducer compiled from a byte-pair vocabulary.

Within a fragment between certain cuts, the last token of the encoding of each prefix is the one token that ends there
and that encoding leaves in place after the last token before it. So a state holds, for each place from which a token
may still grow, how far back it is, the last token there and how many tokens fewer it has: finitely many states. Each
transition is annotated with the change of the number of tokens. States are compiled as texts need them.

Texts run through the transducer in chunks of equal size, all at once. A chunk's state map sends each state that may come
before it to the state after it and a count. Beyond its first cut a chunk does not depend on what was before, so its map
is of its head only, and the state after it is known. Maps of chunks without a cut start from what the chunk before them
makes of the first state, and are closed under what their neighbours send them, all in parallel. Runs of such chunks are
then composed by doubling: the maps of 1, 2, 4 ... chunks, by which every chunk's state before it is found in a number of
rounds that is the logarithm of the longest run. Texts need no alignment with chunks, and a huge text is many chunks.

The count is that of the vocabulary's own encoder. A null text has a null count, an empty one 0. Every row gives one row,
repeated or with a null id; ids keep their type and further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.llm._spark import pick, table
from treeline.llm._text import BLOCK, blocks, text_bytes
from treeline.llm._vocabulary import Vocabulary, borders, rank_file

CHUNK = 512
#: Compiled states that a worker keeps; then it starts afresh. Counts do not depend on it.
STATES = 200_000
START, UNKNOWN = 0, 1
#: A transition is its target and, in the low bits, the change of count.
_SHIFT, _ZERO = 9, 256
_LOW = (1 << _SHIFT) - 1

_machines: dict = {}


class Transducer:
    def __init__(self, ranks: bytes):
        self.vocabulary = Vocabulary(ranks)
        #: Trie of the tokens: (node, byte) -> node, and the token that ends at a node.
        self.trie: dict[tuple[int, int], int] = {}
        self.ends: list[int] = [-1]
        self.grows: list[bool] = [False]
        for t, r in self.vocabulary.ranks.items():
            node = 0
            for b in t:
                self.grows[node] = True
                nxt = self.trie.get((node, b))
                if nxt is None:
                    nxt = self.trie[node, b] = len(self.ends)
                    self.ends.append(-1)
                    self.grows.append(False)
                node = nxt
            self.ends[node] = r
        self.bytes_of = {r: t for t, r in self.vocabulary.ranks.items()}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.forget()

    def forget(self) -> None:
        #: A state: tuples (node of the trie, last token before, tokens fewer than now) of the places still open.
        self.number = {((0, -1, 0),): START, (): UNKNOWN}
        self.states = [((0, -1, 0),), ()]
        self.column = np.full(256, -1, np.int64)
        self.columns = 0
        self.table = np.full((1024, 128), -1, np.int32)
        self.table[UNKNOWN] = UNKNOWN << _SHIFT | _ZERO

    def _stays(self, left: int, right: int) -> bool:
        """Whether encoding leaves the two tokens side by side as they are."""
        got = self.pairs.get((left, right))
        if got is None:
            a, b = self.bytes_of.get(left, b""), self.bytes_of[right]
            want = [right] if left < 0 else [left, right]
            got = self.pairs[left, right] = self.vocabulary.piece(a + b) == want
        return got

    def _compile(self, state: int, byte: int) -> int:
        """Target and change of count of one transition."""
        opened, token, fewer = [], None, 0
        for node, last, less in self.states[state]:
            nxt = self.trie.get((node, byte))
            if nxt is None:
                continue
            opened.append((nxt, last, less))
            t = self.ends[nxt]
            if token is None and t >= 0 and self._stays(last, t):
                token, fewer = t, less
        # The encoding of the prefix is that of an earlier place and one token.
        delta = 1 - fewer
        if not -_ZERO <= delta < _ZERO:
            raise OverflowError("a token ends what is more than 256 tokens without it")
        target = tuple([(n, last, less + delta) for n, last, less in opened if self.grows[n]] + [(0, token, 0)])
        k = self.number.get(target)
        if k is None:
            k = self.number[target] = len(self.states)
            self.states.append(target)
            if k >= len(self.table):
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
        if self.column[byte] >= self.table.shape[1]:
            self.table = np.concatenate([self.table, np.full_like(self.table, -1)], 1)
        self.table[state, self.column[byte]] = value = k << _SHIFT | (delta + _ZERO)
        return value

    def _step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        column = self.column[byte]
        if column.min(initial=0) < 0:
            for b in np.unique(byte[column < 0]).tolist():
                self.column[b] = self.columns
                self.columns += 1
                if self.columns > self.table.shape[1]:
                    wide = np.full_like(self.table, -1)
                    wide[UNKNOWN] = UNKNOWN << _SHIFT | _ZERO
                    self.table = np.concatenate([self.table, wide], 1)
            column = self.column[byte]
        value = self.table[state, column]
        new = np.flatnonzero(value < 0)
        if len(new):
            for key in np.unique(state[new].astype(np.int64) << 8 | byte[new]).tolist():
                self._compile(key >> 8, key & 255)
            value[new] = self.table[state[new], column[new]]
        return value

    def _heads(self, b: np.ndarray, head: np.ndarray, lane: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """State after the heads of lanes, and change of count, from given states before them."""
        state, total = state.copy(), np.zeros(len(lane), np.int64)
        left = np.arange(len(lane))
        for t in range(CHUNK):
            left = left[head[lane[left]] > t]
            if not len(left):
                break
            value = self._step(state[left], b[t, lane[left]])
            total[left] += (value & _LOW) - _ZERO
            state[left] = value >> _SHIFT
        return state, total

    def _scan(self, b: np.ndarray, head: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Change of count over each lane's head. after: states after the lanes that have a cut."""
        lanes = len(head)
        out = np.zeros(lanes, np.int64)
        need = np.flatnonzero(head > 0)
        if not len(need):
            return out
        whole = head == CHUNK
        # What may be before each head: what is known of the lane before, or what that one makes of the first state.
        before = after.copy()
        closed = np.flatnonzero(whole[need - 1])
        if len(closed):
            lane = np.unique(need[closed] - 1)
            before[lane] = self._heads(b, head, lane, np.full(len(lane), START, np.int32))[0]
        key = need.astype(np.int64) << 32 | before[need - 1]
        known, to, change = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        while len(key):
            lane, state = key >> 32, (key & 0xFFFFFFFF).astype(np.int32)
            end, total = self._heads(b, head, lane, state)
            goes = whole[lane] & (lane + 1 < lanes)
            nxt = np.where(goes, (lane + 1) << 32 | end, -1)
            known, to, change = np.concatenate([known, key]), np.concatenate([to, nxt]), np.concatenate([change, total])
            order = np.argsort(known)
            known, to, change = known[order], to[order], change[order]
            key = np.unique(nxt[goes])
            key = key[known[np.minimum(np.searchsorted(known, key), len(known) - 1)] != key]
        # A head after a lane with a cut begins a run; the states before the others of the run follow by doubled maps.
        first = ~whole[need - 1]
        at = np.zeros(len(need), np.int64)
        run = np.maximum.accumulate(np.where(first, np.arange(len(need)), 0))
        at[:] = np.searchsorted(known, (need[run].astype(np.int64) << 32) | after[need[run] - 1])
        far = np.arange(len(need)) - run
        jump = np.where(to >= 0, np.searchsorted(known, to), np.arange(len(known)))
        bit = 1
        while bit <= far.max():
            move = far & bit > 0
            at[move] = jump[at[move]]
            jump = jump[jump]
            bit <<= 1
        out[need] = change[at]
        return out

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each text."""
        n = len(data)
        if not n:
            return np.zeros(len(offsets) - 1, np.int64)
        if len(self.states) > STATES:
            self.forget()
        lanes = -(-n // CHUNK)
        size = lanes * CHUNK
        b, cut = np.zeros(size, np.uint8), np.zeros(size, bool)
        b[:n], cut[:n] = data, self.vocabulary.cuts(data, offsets)
        # What pads the last chunk begins with a cut, so that it is not part of a fragment.
        cut[n:] = True
        b, cut = np.ascontiguousarray(b.reshape(lanes, CHUNK).T), np.ascontiguousarray(cut.reshape(lanes, CHUNK).T)
        change = np.zeros((CHUNK, lanes), np.int16)
        state = np.full(lanes, UNKNOWN, np.int32)
        for t in range(CHUNK):
            state[cut[t]] = START
            value = self._step(state, b[t])
            change[t] = (value & _LOW) - _ZERO
            state = value >> _SHIFT
        head = np.where(cut.any(0), cut.argmax(0), CHUNK)
        total = np.concatenate([[0], np.cumsum(change.T.reshape(-1)[:n], dtype=np.int64)])
        out = total[offsets[1:]] - total[offsets[:-1]]
        # A head belongs to one text, that of its first byte.
        heads = self._scan(b, head, state)
        at = np.flatnonzero(heads)
        if len(at):
            np.add.at(out, np.searchsorted(offsets, at * CHUNK, "right") - 1, heads[at])
        return out


def machine(ranks) -> Transducer:
    """The worker's transducer of a broadcast rank file."""
    key = hash(ranks.value)
    if key not in _machines:
        _machines.clear()
        _machines[key] = Transducer(ranks.value)
    return _machines[key]


def counted(text: Column, ranks) -> Column:
    @F.arrow_udf("bigint")
    def of(column: pa.Array) -> pa.Array:
        m = machine(ranks)
        data, offsets, valid = text_bytes(column)
        offsets, own = borders(data, offsets, BLOCK)
        total = np.zeros(len(offsets), np.int64)
        for lo, hi in blocks(offsets):
            total[lo + 1 : hi + 1] = m.count(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        return pa.array(np.diff(np.cumsum(total)[own]), mask=~valid)

    return of(text)


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row."""
    ranks = df.sparkSession.sparkContext.broadcast(rank_file(path))
    return pick(df, id=id_col, text=text_col).select(F.col("id").alias("doc_id"), F.octet_length("text").cast("bigint").alias("n_bytes"), counted(F.col("text"), ranks).alias("n_tokens"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


SQL = None
