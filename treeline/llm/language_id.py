"""Language of texts by the nearest of several centroids per language, with rejection by distance.

Texts become vectors of hashed byte n-grams, weighted by (1 + ln tf) * idf and normalised. The labelled sample of each
language is clustered by spherical k-means, and a text has the language of the centroid of the largest cosine. A text
whose cosine is below the threshold of its length is rejected: short texts are farther from any centroid, so thresholds
are set for classes of length, from the distances of labelled texts to their own language. Classes of short texts take
theirs from pieces of labelled texts of that length, as few labelled texts are so short.

The fit reads at most SAMPLE labelled texts, chosen by hash over the whole table; idf is part of that fit. Languages share
SAMPLE evenly, each with LEAST_SHARE texts at least (or all it has), so that also those of a small share are learnt at any
size of the table; more than SAMPLE / LEAST_SHARE languages make the sample larger. Equal texts of one label are read
once, however many copies the table has. Labels that are null and languages
with fewer than LEAST_LABELLED labelled texts in the table are not learnt. Without any labelled text all is rejected.
A null text has null language and score and is rejected; a text without letters is rejected with score 0. Ties go to the
language that sorts first. Every row gives one row, repeated or with a null id; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeline.llm._spark import pick, table
from treeline.llm._text import blocks, text_bytes

#: Labelled texts that the fit reads at most; a bound on the training of the classifier only.
SAMPLE = 2000
#: Labelled texts in the whole table from which on a language is learnt, and those of one language that the fit reads at least.
LEAST_LABELLED = 5
LEAST_SHARE = 20
CENTROIDS = 4
BITS = 13
#: Classes of fewer n-grams have thresholds from pieces of labelled texts, PIECES of each text, and LEAST_COSINE at least.
LEAST_GRAMS = 32
PIECES = 2
LEAST_COSINE = 0.03
#: Share of labelled texts beyond the threshold of their class of length, and the part of their distance allowed on top.
QUANTILE, SLACK = 0.002, 0.6
#: The same for pieces, some of which are from junk within a text.
PIECES_QUANTILE = 0.01
_U = np.uint32

_LETTER = np.zeros(256, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def _fold(data: np.ndarray) -> np.ndarray:
    """Letters in lower case (ASCII and Latin-1); anything else is 0."""
    out = _LETTER[data]
    if len(data) > 1:
        lead = np.flatnonzero(data[:-1] == 0xC3) + 1
        out[lead[(data[lead] >= 0x80) & (data[lead] <= 0x9E)]] += 0x20
    return out


def grams(data: np.ndarray) -> np.ndarray:
    """Hashed 3-gram around each byte, or -1 where that is no letter. data has a byte more at both ends."""
    b = _fold(data).astype(_U)
    code = (b[:-2] << _U(16)) | (b[1:-1] << _U(8)) | b[2:]
    h = ((code * _U(0x9E3779B1)) >> _U(32 - BITS)).astype(np.int32)
    h[b[1:-1] == 0] = -1
    return h


def counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """rows x 2**BITS numbers of n-grams."""
    rows = len(offsets) - 1
    out = np.zeros((rows, 1 << BITS), np.float32)
    if not len(data):
        return out
    # A zero between texts, so that n-grams end with them.
    apart = np.zeros(len(data) + rows + 1, np.uint8)
    apart[np.arange(len(data)) + np.repeat(np.arange(rows), np.diff(offsets)) + 1] = data
    h = grams(apart)
    for r in range(rows):
        own = h[offsets[r] + r : offsets[r + 1] + r]
        own = own[own >= 0]
        if len(own):
            out[r] = np.bincount(own, minlength=1 << BITS)
    return out


def _weighted(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Normalised TF-IDF in place of counts."""
    at = tf > 0
    tf[at] = np.log(tf[at]) + 1
    tf *= idf
    norm = np.sqrt(np.einsum("ij,ij->i", tf, tf))
    return tf / np.maximum(norm, 1e-12)[:, None].astype(np.float32)


def _length_class(n: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(n, 1)).astype(np.int64), 15)


def _pieces(text: str, k: int, rng) -> list[str]:
    """Runs of words of a text whose letter bytes are of length class k."""
    words = text.split()
    sizes = [int(np.count_nonzero(_LETTER[np.frombuffer(w.encode(), np.uint8)])) for w in words[:2000]]
    out = []
    for at in rng.integers(0, len(sizes), PIECES).tolist() if sizes else ():
        n, end = 0, at
        while end < len(sizes) and n < 1 << k:
            n += sizes[end]
            end += 1
        if 1 << k <= n < 2 << k:
            out.append(" ".join(words[at:end]))
    return out


class Model:
    def __init__(self, texts: list[str], labels: list[str], centroids: int = CENTROIDS, seed: int = 7):
        """All languages of labels are learnt; fit() leaves out those with too few texts in its table."""
        self.names = sorted(set(labels))
        self.idf = np.ones(1 << BITS, np.float32)
        self.centres = np.zeros((0, 1 << BITS), np.float32)
        self.of = np.zeros(0, np.int64)
        self.least = np.ones(16)
        if not self.names:
            return
        known = [(t, x) for t, x in zip(texts, labels) if x in self.names]
        raw = [t.encode() for t, _ in known]
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in raw])])
        tf = counts(np.frombuffer(b"".join(raw), np.uint8), offsets)
        n = tf.sum(1)
        self.idf = (np.log((1 + len(raw)) / (1 + (tf > 0).sum(0))) + 1).astype(np.float32)
        x = _weighted(tf, self.idf)
        y = np.array([self.names.index(v) for _, v in known])
        rng = np.random.default_rng(seed)
        parts, of = [], []
        for k in range(len(self.names)):
            own = x[(y == k) & (n >= 20)] if ((y == k) & (n >= 20)).sum() >= LEAST_LABELLED else x[y == k]
            c = own[rng.choice(len(own), min(centroids, len(own)), replace=False)]
            for _ in range(12):
                near = (own @ c.T).argmax(1)
                c = np.stack([own[near == j].sum(0) if (near == j).any() else c[j] for j in range(len(c))])
                c /= np.maximum(np.linalg.norm(c, axis=1), 1e-12)[:, None]
            parts.append(c.astype(np.float32))
            of += [k] * len(c)
        self.centres, self.of = np.concatenate(parts), np.array(of)
        cos = x @ self.centres.T
        own = np.where(self.of[None, :] == y[:, None], cos, -1).max(1)
        kind = _length_class(n)
        last = LEAST_COSINE
        for k in range(16):
            # Neighbouring classes make up for few texts in one.
            near, q = own[(np.abs(kind - k) <= 1) & (n > 0)], QUANTILE
            if 1 << k < LEAST_GRAMS or len(near) < 20:
                cut = [(p, v) for t, v in known for p in _pieces(t, k, rng)]
                near, q = self._own([p for p, _ in cut], np.array([self.names.index(v) for _, v in cut], np.int64)), PIECES_QUANTILE
            last = max(LEAST_COSINE, float(np.quantile(near, q)) * SLACK) if len(near) >= 20 else last
            self.least[k] = last

    def _cosines(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        tf = counts(data, offsets)
        n = tf.sum(1)
        return n, _weighted(tf, self.idf) @ self.centres.T

    def _own(self, texts: list[str], y: np.ndarray) -> np.ndarray:
        """Cosine of texts to the nearest centroid of their language."""
        data, offsets, _ = text_bytes(pa.array(texts, pa.large_string()))
        out = np.zeros(len(texts))
        for lo, hi in blocks(offsets, rows=256):
            _, cos = self._cosines(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            out[lo:hi] = np.where(self.of[None, :] == y[lo:hi, None], cos, -1).max(1)
        return out

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of the language (-1 if none), cosine, and whether it is accepted."""
        data, offsets, _ = text_bytes(column)
        best, score, n = np.full(len(column), -1), np.zeros(len(column)), np.zeros(len(column))
        for lo, hi in blocks(offsets, rows=256):
            n[lo:hi], cos = self._cosines(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            if len(self.centres):
                at = cos.argmax(1)
                best[lo:hi], score[lo:hi] = self.of[at], cos[np.arange(hi - lo), at]
        best[n == 0] = -1
        score[n == 0] = 0
        return best, score, (best >= 0) & (score >= self.least[_length_class(n)])


def shares(counts: dict[str, int], sample: int) -> dict[str, int]:
    """How many texts of each language are read: `sample` dealt evenly, what rare languages leave over going to the others."""
    out, left = {}, sample
    for k, x in enumerate(sorted(counts, key=lambda x: (counts[x], x))):
        out[x] = min(counts[x], max(LEAST_SHARE, left // (len(counts) - k)))
        left = max(0, left - out[x])
    return out


def fit(df: DataFrame, text_col: str = "text", label_col: str = "lang", sample: int = SAMPLE) -> Model:
    """A model of about `sample` labelled texts at most; which ones depends on their content alone."""
    labelled = pick(df, text=text_col, label=label_col).where("text is not null and label is not null").select("text", F.col("label").cast("string").alias("label"))
    hashed = labelled.select("*", F.xxhash64("text", "label").alias("h"))
    # Copies count as labelled texts, but the sample is of distinct ones, whose number may be a little off.
    kinds = {r["label"]: max(1, r["kinds"]) for r in hashed.groupBy("label").agg(F.count("*").alias("n"), F.approx_count_distinct("h", 0.02).alias("kinds")).where(F.col("n") >= LEAST_LABELLED).collect()}
    if not kinds:
        return Model([], [])
    take = shares(kinds, sample)
    # A threshold on a hash takes a little more than the share without a sort of the table; the rest is cut off in order.
    most = [(x, take[x], min(1_000_003, int((1.2 * take[x] + 4 * take[x] ** 0.5 + 8) / n * 1_000_003) + 1)) for x, n in kinds.items()]
    bounds = df.sparkSession.createDataFrame(most, "label string, take int, bound int")
    part = hashed.join(F.broadcast(bounds), "label").where(F.pmod("h", F.lit(1_000_003)) < F.col("bound")).select("h", "text", "label", "take").distinct()
    place = F.row_number().over(Window.partitionBy("label").orderBy("h", "text"))
    rows = part.withColumn("place", place).where("place <= take").orderBy("h", "text", "label").select("text", "label").collect()
    return Model([r["text"] for r in rows], [r["label"] for r in rows])


def predicted(text: Column, model) -> Column:
    """struct(lang, score, accepted) of a text, by a broadcast model."""

    @F.arrow_udf("struct<lang:string,score:double,accepted:boolean>")
    def of(column: pa.Array) -> pa.Array:
        m = model.value
        best, score, accepted = m.predict(column)
        valid = column.is_valid().to_numpy(zero_copy_only=False)
        names = pa.array([*m.names, None], pa.string())
        lang = names.take(pa.array(np.where(valid & (best >= 0), best, len(m.names)).astype(np.int64)))
        return pa.StructArray.from_arrays([lang, pa.array(score, mask=~valid), pa.array(accepted & valid)], ["lang", "score", "accepted"])

    return of(text)


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", model: Model | None = None) -> DataFrame:
    """(doc_id, lang, score, accepted) of every row; the model is fitted on df's own labels unless given."""
    b = df.sparkSession.sparkContext.broadcast(model or fit(df, text_col, label_col))
    return pick(df, id=id_col, text=text_col).select(F.col("id").alias("doc_id"), predicted(F.col("text"), b).alias("p")).select("doc_id", "p.*")


def keep_known(df: DataFrame, text_col: str = "text", label_col: str = "lang", model: Model | None = None) -> DataFrame:
    """The rows of df whose language is accepted, with all their columns."""
    b = df.sparkSession.sparkContext.broadcast(model or fit(df, text_col, label_col))
    return df.where(predicted(F.col(f"`{text_col}`").cast("string"), b)["accepted"])


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


SQL = None
