import base64
import random

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from treeline.llm import bpe, token_counts
from treeline.llm._vocabulary import PATTERN, Vocabulary, rank_file

TEXTS = [
    None, "", " ", "   \n\n  x", "Hello world", "it's we'll they'd I'M 'tis ' s", "été Über naïve 日本語 テスト 🙂🙂", "a" * 5000, "ab" * 3000, "1234567 89.0", "x y　 z  ", "tab\t\tand\r\nlines\n", "<|endoftext|>",
    "!!!???...---", "'''''s't", "word " * 2000, "é", "\x00\x01\x7f", " 'll", "\n's", "á combining", " line",
]


@pytest.fixture(scope="module")
def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in rank_file().splitlines() if x)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def some(seed, n=150):
    r = random.Random(seed)
    alphabet = "abc etaoin  \n\t'.,!0123éßñ日🙂 -_=/"
    return ["".join(r.choice(alphabet) for _ in range(r.choice([1, 5, 40, 300]))) for _ in range(n)]


def test_ids_counts_and_round_trip_are_the_encoders(spark, encoding):
    texts = TEXTS + some(1)
    df = spark.createDataFrame([(i, t, 1, "n") for i, t in enumerate(texts)] + [(None, "again", 2, "m"), (0, None, 3, "o")], "doc_id bigint, text string, tokens int, ids string")
    rows = bpe.encode(df).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        if r["doc_id"] is not None:
            t = texts[r["doc_id"]]
            assert r["tokens"] == (None if t is None else encoding.encode_ordinary(t)), t
            assert r["n_tokens"] == (None if t is None else len(r["tokens"]))
            assert r["round_trip"] is (None if t is None else True)
    for r in token_counts.token_counts(df).collect():
        if r["doc_id"] is not None:
            t = texts[r["doc_id"]]
            assert r["n_tokens"] == (None if t is None else len(encoding.encode_ordinary(t))), t
            assert r["n_bytes"] == (None if t is None else len(t.encode()))


def test_transducer_over_other_chunks(encoding):
    import numpy as np

    t = token_counts.Transducer(rank_file())
    texts = [x for x in TEXTS if x is not None] + some(2)
    raw = [x.encode() for x in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    want = [len(encoding.encode_ordinary(x)) for x in texts]
    for chunk in (7, 64, 512):
        old, token_counts.CHUNK = token_counts.CHUNK, chunk
        try:
            assert t.count(np.frombuffer(b"".join(raw), np.uint8), offsets).tolist() == want
        finally:
            token_counts.CHUNK = old


def test_certain_cuts_are_in_no_token():
    v = Vocabulary(rank_file())
    seen = {(t[i], t[i + 1]) for t in v.ranks for i in range(len(t) - 1)}
    assert v.never.sum() == (1 << 16) - len(seen) > 0
    assert not any(v.never[a << 8 | b] for a, b in seen)


def test_decoding_of_broken_and_null_ids(spark):
    ranks = spark.sparkContext.broadcast(rank_file())
    df = spark.createDataFrame([([220],), (None,), ([],), ([0, 128],)], "ids array<int>")
    got = [r[0] for r in df.select(bpe.decoded(F.col("ids"), ranks)).collect()]
    assert got[1] is None and got[2] == "" and got[0] is not None and got[3] is not None


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert bpe.encode(df).count() == 0 and token_counts.token_counts(df).count() == 0


def _thue_morse(n):
    out = [0]
    while len(out) < n:
        out += [1 - x for x in out]
    return out


def test_words_of_one_hash_modulo_a_power_of_two(spark):
    bits = _thue_morse(4096)
    pairs = [("".join("ab"[x] for x in bits[:n]), "".join("ba"[x] for x in bits[:n])) for n in (1024, 2048, 4096)]
    texts = [f"{a} {b}" for a, b in pairs] + [f"{b} {a}" for a, b in pairs]
    enc = Vocabulary(rank_file()).encoding
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r[0]: r[1] for r in bpe.encode(df).select("doc_id", "tokens").collect()} == {k: enc.encode_ordinary(t) for k, t in enumerate(texts)}


def test_fragments_are_compared_when_all_hashes_collide(monkeypatch):
    monkeypatch.setattr(bpe, "span_hashes", lambda data, start, end: (end - start).astype(np.uint64))
    e = bpe.Encoder(rank_file())
    text = "the cat and the dog saw one red fox; été"
    data = np.frombuffer(text.encode(), np.uint8)
    assert e.encode(data, np.array([0, len(data)]))[0].tolist() == e.vocabulary.encoding.encode_ordinary(text)


def test_very_long_texts_and_runs_without_a_cut(spark):
    r = random.Random(4)
    prose = " ".join("".join(r.choice("etaoinshr") for _ in range(r.randint(1, 9))) for _ in range(450_000))
    texts = [prose, "a" * 50_000, "ab" * 40_000 + "!" + "é" * 9000, "".join(r.choice("etaoinsh") for _ in range(60_000)), "\n" * 5000 + " " * 5000, ""]
    assert len(prose) > 2 * bpe.BLOCK
    enc = Vocabulary(rank_file()).encoding
    want = {k: enc.encode_ordinary(t) for k, t in enumerate(texts)}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in bpe.encode(df).collect()}
    assert {k: x["tokens"] for k, x in got.items()} == want and all(x["round_trip"] for x in got.values())
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(df).collect()} == {k: len(x) for k, x in want.items()}


def test_ids_of_any_type(spark):
    df = spark.createDataFrame([("a", "one two"), (None, "three")], "doc_id string, text string")
    assert {r["doc_id"] for r in bpe.encode(df).collect()} == {"a", None} == {r["doc_id"] for r in token_counts.token_counts(df).collect()}
