"""Quality of texts learnt from trusted good texts and unlabelled ones (positive-unlabelled learning).

The classifier minimises the non-negative unbiased risk: prior * R+(g) + max(0, Ru-(g) - prior * Rp-(g)), with sigmoid
losses, trusted positives for R+ and Rp-, and unlabelled text for Ru-. When the second part is negative its gradient is
followed upwards, as the non-negative estimator has it. The prior of good text among the unlabelled is estimated from
the data: the share below which the scores of a first classifier on unlabelled text cannot be explained by those on
positives (the least ratio of the two distribution functions over high scores).

Features are read off the bytes of the whole text: frequencies of pairs of byte classes, shares of repeated words and
lines, lengths of words and of the text. The fit reads at most SAMPLE positives and as many unlabelled texts, chosen by
hash over the whole table; negative labels are not used. Unlabelled texts are drawn as distinct texts, each with a chance
in proportion to its copies, and stand in the fit for as many documents as they are of, so that a group of copies has the
weight in the prior that it has in the table. With no positives every text is kept with score 0.5.

A null text has a null score and is not kept; an empty one is scored like any other. Every row gives one row, repeated or
with a null id; further columns are not read. A document counts as trusted if any of its labels says so.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.llm._spark import pick, table
from treeline.llm._text import blocks, span_hashes, text_bytes, words

#: Positives, and unlabelled texts, that the fit reads at most; a bound on the training of the classifier only.
SAMPLE = 4000
#: Scores from here on are kept.
KEEP = 0.5
CLASSES = 16
HIDDEN = 16

_CLASS = np.full(256, 15, np.uint8)
_CLASS[97:123] = 0
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[128:256] = 0
for _k, _cs in enumerate([" ", "\n", ".", ",", "!?", "#", "$%", "&*", "|", "'\"", "-_=+", "<>/\\", ":;"], 3):
    for _c in _cs:
        _CLASS[ord(_c)] = _k
N_FEATURES = CLASSES * CLASSES + 8


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    rows = len(offsets) - 1
    out = np.zeros((rows, N_FEATURES))
    size = np.diff(offsets)
    if not len(data):
        return out
    c = _CLASS[data].astype(np.int64)
    following = np.append(c[1:], 0)
    following[offsets[1:][size > 0] - 1] = 0
    pair = c * CLASSES + following
    row = np.repeat(np.arange(rows), size)
    out[:, : CLASSES * CLASSES] = np.bincount(row * (CLASSES * CLASSES) + pair, minlength=rows * CLASSES * CLASSES).reshape(rows, -1)
    out[:, : CLASSES * CLASSES] = np.sqrt(out[:, : CLASSES * CLASSES] / np.maximum(size, 1)[:, None])
    w, s, e = words(data, offsets)
    if len(w):
        h = span_hashes(data, s, e)
        n = np.maximum(np.bincount(w, minlength=rows), 1)
        same = (h[1:] == h[:-1]) & (w[1:] == w[:-1])
        key = np.sort((w.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
        first = np.concatenate([[True], key[1:] != key[:-1]])
        kinds = np.bincount((key[first] >> np.uint64(40)).astype(np.int64), minlength=rows)
        length = (e - s).astype(float)
        mean = np.bincount(w, length, rows) / n
        out[:, -8] = np.bincount(w[1:][same], minlength=rows) / n
        out[:, -7] = kinds / n
        out[:, -6] = np.log1p(n) / 10
        out[:, -5] = mean / 10
        out[:, -4] = np.sqrt(np.maximum(np.bincount(w, length**2, rows) / n - mean**2, 0)) / 10
        # Variety against what a text of this length has: words per kind grow with length in any language.
        out[:, -3] = np.log1p(kinds) / np.log1p(n)
    breaks = np.flatnonzero(data == 10)
    out[:, -2] = np.log1p(np.bincount(row[breaks], minlength=rows)) / 5
    out[:, -1] = np.log1p(size) / 12
    return out


def column_features(column: pa.Array) -> np.ndarray:
    data, offsets, _ = text_bytes(column)
    out = np.zeros((len(column), N_FEATURES))
    for lo, hi in blocks(offsets):
        out[lo:hi] = features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among the unlabelled, from scores of a classifier of one against the other."""
    least = 1.0
    for q in np.linspace(0.02, 0.8, 40):
        cut = np.quantile(positive, q)
        share = (positive >= cut).mean()
        if share > 0.1:
            # Two standard errors on top, as the least of many ratios is too low.
            ratio = (unlabelled >= cut).mean()
            least = min(least, (ratio + 2 * np.sqrt(ratio * (1 - ratio) / len(unlabelled))) / share)
    return float(np.clip(least, 0.05, 0.98))


def risk(g: np.ndarray, pos: np.ndarray, prior: float) -> tuple[float, float]:
    """The non-negative risk of scores g, positives where pos, and its second part before it is kept from being negative.

    Sigmoid loss: l(g) = s(-g) for a positive, s(g) for a negative.
    """
    s = _sigmoid(g)
    negative = s[~pos].mean() - prior * s[pos].mean()
    return prior * (1 - s[pos]).mean() + max(0.0, negative), negative


def slopes(g: np.ndarray, pos: np.ndarray, prior: float) -> np.ndarray:
    """Derivative of the risk by each score; where the second part is negative, that of its negative alone."""
    s = _sigmoid(g)
    slope = s * (1 - s)
    p, u = int(pos.sum()), int((~pos).sum())
    down = np.where(pos, -prior * slope / p, slope / u)
    if s[~pos].mean() - prior * s[pos].mean() < 0:
        return -down
    return down - np.where(pos, prior * slope / p, 0)


class Model:
    """A network of one hidden layer; fit by Adam on mini-batches."""

    def __init__(self, positive: np.ndarray, unlabelled: np.ndarray, seed: int = 3, epochs: int = 60):
        self.trained = len(positive) > 0 and len(unlabelled) > 0
        self.prior = 1.0
        if not self.trained:
            return
        both = np.concatenate([positive, unlabelled])
        self.mean, self.scale = both.mean(0), both.std(0) + 1e-3
        p, u = self._scaled(positive), self._scaled(unlabelled)
        self._run(p, u, 0.5, seed, epochs // 2, plain=True)
        self.prior = estimate_prior(self._score(p), self._score(u))
        self._run(p, u, self.prior, seed, epochs, plain=False)

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def _score(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.w1 + self.b1) @ self.w2 + self.b2

    def _run(self, p, u, prior, seed, epochs, plain):
        rng = np.random.default_rng(seed)
        d = p.shape[1]
        w = [rng.normal(0, 1 / np.sqrt(d), (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        m, v, t = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w], 0
        steps = max(1, min(len(p), len(u)) // 128)
        for _ in range(epochs):
            ps, us = np.array_split(rng.permutation(len(p)), steps), np.array_split(rng.permutation(len(u)), steps)
            for a, b in zip(ps, us):
                x = np.concatenate([p[a], u[b]])
                hid = np.tanh(x @ w[0] + w[1])
                g = hid @ w[2] + w[3]
                pos = np.arange(len(x)) < len(a)
                if plain:
                    s = _sigmoid(g)
                    grad = np.where(pos, -s * (1 - s) / len(a), s * (1 - s) / len(b))
                else:
                    grad = slopes(g, pos, prior)
                back = np.outer(grad, w[2]) * (1 - hid**2)
                gs = [x.T @ back + 1e-4 * w[0], back.sum(0), hid.T @ grad + 1e-4 * w[2], np.array([grad.sum()])]
                t += 1
                for k in range(4):
                    m[k] = 0.9 * m[k] + 0.1 * gs[k]
                    v[k] = 0.999 * v[k] + 0.001 * gs[k] ** 2
                    w[k] = w[k] - 3e-3 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        self.w1, self.b1, self.w2, self.b2 = w[0], w[1], w[2], float(w[3][0])

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self._score(self._scaled(x))) if self.trained else np.full(len(x), 0.5)


def _repeats(weights: list[float], total: int) -> np.ndarray:
    """Indices of `total` evenly spaced draws, each index in proportion to its weight."""
    w = np.cumsum(np.asarray(weights, float))
    return np.searchsorted(w, (np.arange(total) + 0.5) * (w[-1] / total), "right") if len(w) else np.zeros(0, np.int64)


def _some(df: DataFrame, n: int, sample: int) -> tuple[list[str], np.ndarray]:
    """Distinct texts of df (of n rows), about `sample` at most, and for which of them each of min(n, sample) documents stands."""
    rate = min(1.0, sample / max(n, 1))
    hashed = df.select("text", F.xxhash64("text").alias("h"))
    # A text is drawn with the chance min(1, rate * copies); drawn ones then weigh 1 / rate or, if more, their copies.
    drawn = hashed.groupBy("h").agg(F.count("*").alias("copies")).where(F.pmod("h", F.lit(1_000_003)) < F.col("copies") * (rate * 1_000_003))
    few = df.sparkSession.createDataFrame([tuple(r) for r in drawn.collect()], "h bigint, copies bigint")
    hashed = hashed.join(F.broadcast(few), "h")
    rows = hashed.groupBy("h", "text").agg(F.first("copies").alias("copies")).orderBy("h", "text").collect()
    return [r["text"] for r in rows], _repeats([max(r["copies"], 1 / rate) for r in rows], min(n, sample))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, label_id_col: str = "doc_id", quality_col: str = "quality", sample: int = SAMPLE) -> Model:
    texts = pick(docs, id=id_col, text=text_col).where("text is not null")
    trusted = pick(labels, id=label_id_col, q=quality_col).where("id is not null and try_cast(q as int) = 1").select("id").distinct()
    marked = trusted.count()
    n = texts.count()
    # Which trusted documents are read is decided on their ids, so that only those few meet the texts.
    few = trusted.select("id", F.xxhash64("id").alias("h")).where(F.pmod("h", F.lit(1_000_003)) < max(1, min(1_000_003, int(1.2 * sample / max(marked, 1) * 1_000_003) + 1))).orderBy("h", "id").limit(sample)
    ids = [r["id"] for r in few.collect()]
    known = docs.sparkSession.createDataFrame([(i,) for i in ids], "id bigint")
    positive = [r["text"] for r in texts.join(F.broadcast(known), "id").select("text").orderBy(F.xxhash64("text"), "text").limit(sample).collect()] if ids else []
    unlabelled, stands_for = _some(texts, n, sample)
    return Model(column_features(pa.array(positive, pa.string())), column_features(pa.array(unlabelled, pa.string()))[stands_for])


def scored(text: Column, model) -> Column:
    @F.arrow_udf("double")
    def of(column: pa.Array) -> pa.Array:
        valid = column.is_valid().to_numpy(zero_copy_only=False)
        return pa.array(model.value.score(column_features(column)), mask=~valid)

    return of(text)


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None, keep: float = KEEP) -> DataFrame:
    """(doc_id, quality_score, keep) of every row."""
    b = docs.sparkSession.sparkContext.broadcast(model or fit(docs, labels, id_col, text_col))
    out = pick(docs, id=id_col, text=text_col).select(F.col("id").alias("doc_id"), scored(F.col("text"), b).alias("quality_score"))
    return out.select("*", F.coalesce(F.col("quality_score") >= keep, F.lit(False)).alias("keep"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL = None
