import numpy as np
import pyarrow as pa

from tests.conftest import SF
from treeline.llm import language_id, quality, secrets


def documents(spark, sf=SF):
    return spark.read.parquet(f"{sf}/documents.parquet")


def test_language_of_held_out_documents(spark):
    docs = documents(spark, SF.replace("0.001", "0.01"))
    train, held = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    got = language_id.identify(held, model=language_id.fit(train)).collect()
    truth = {r["doc_id"]: r for r in held.collect()}
    long = [r for r in got if r["lang"] is not None and truth[r["doc_id"]]["n_chars"] > 200]
    assert np.mean([r["lang"] == truth[r["doc_id"]]["lang"] for r in long]) > 0.97
    assert np.mean([r["accepted"] for r in got]) > 0.95


def test_language_rejects_what_is_far_from_all(spark):
    docs = documents(spark)
    model = language_id.fit(docs)
    rng = np.random.default_rng(1)
    noise = ["".join(chr(c) for c in rng.integers(0x4E00, 0x9000, 400)), "qzx jvk wqx zzv " * 60, "", "123 456 !!!", None]
    df = spark.createDataFrame([(i, t, None, 1) for i, t in enumerate(noise)] + [(9, "the", "en", 1)], "doc_id bigint, text string, lang string, score int")
    got = {r["doc_id"]: r for r in language_id.identify(df, model=model).collect()}
    assert [got[i]["accepted"] for i in range(5)] == [False] * 5
    assert got[2]["score"] == 0 and got[4]["lang"] is None and got[4]["score"] is None
    kept = language_id.keep_known(df, model=model)
    assert kept.columns == df.columns


def test_language_without_labels_or_rows(spark):
    df = spark.createDataFrame([(1, "some text", None), (2, None, None)], "doc_id bigint, text string, lang string")
    assert [r["accepted"] for r in language_id.identify(df).collect()] == [False, False]
    assert language_id.identify(df.limit(0)).count() == 0


def test_quality_of_held_out_labels(spark):
    sf = SF.replace("0.001", "0.01")
    docs, labels = documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(docs, labels.where("doc_id % 2 = 0"))
    held = {r["doc_id"]: r["quality"] for r in labels.where("doc_id % 2 = 1").collect()}
    got = {r["doc_id"]: r for r in quality.quality(docs, labels, model=model).collect()}
    good = [got[i]["keep"] for i, q in held.items() if q == 1]
    bad = [got[i]["keep"] for i, q in held.items() if q == 0]
    assert np.mean(good) > 0.9
    assert np.mean(bad) < 0.35


def test_quality_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "a text", 0), (3, "a text", 0), (None, "x", 0)], "doc_id bigint, text string, keep int")
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    rows = quality.quality(docs, none).collect()
    assert len(rows) == 5 and {r["quality_score"] for r in rows} == {None, 0.5}
    assert [r["keep"] for r in rows if r["doc_id"] == 1] == [False]
    labels = spark.createDataFrame([(3, 1), (3, 0), (None, 1), (2, None)], "doc_id bigint, quality int")
    assert quality.quality(docs, labels).count() == 5
    assert quality.quality(docs.limit(0), labels).count() == 0


def test_non_negative_risk_recovers_classes():
    rng = np.random.default_rng(2)
    d = quality.N_FEATURES
    p, n = rng.normal(0.6, 1, (2000, d)), rng.normal(-0.6, 1, (2000, d))
    model = quality.Model(p[:800], np.concatenate([p[800:1400], n[:600]]))
    assert 0.3 < model.prior < 0.7
    assert (model.score(p[1400:]) > 0.5).mean() > 0.9 and (model.score(n[600:]) < 0.5).mean() > 0.9


def test_secrets_of_held_out_findings():
    forest = secrets.Forest(secrets.labelled_findings())
    held = secrets.labelled_findings(1000, seed=99)
    got = forest.predict(np.array([forest.features(*f[:4]) for f in held])) >= secrets.KEEP
    want = np.array([f[4] for f in held])
    assert (got == want).mean() > 0.93


def test_secrets_in_texts(spark):
    key = "ghp_" + "aB3dE6gH9jK2mN5pQ8sT1vW4yZ7bC0dF2hJ4"
    texts = [f"é token = \"{key}\" and more", "plain prose without anything", None, "", f"api_key={key}\napi_key={key}", "commit 3f786850e387550fdab836ed7e6dc881de23001b was merged", "word " * 20000 + f"secret = {key}"]
    df = spark.createDataFrame([(i, t, None if i % 2 else "src/config.py", 1) for i, t in enumerate(texts)] + [(None, texts[0], "", 1)], "doc_id bigint, text string, source string, start int")
    rows = secrets.scan(df).collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert sorted(by, key=str) == sorted([0, 4, 6, None], key=str)
    assert len(by[4]) == 2 and by[0][0]["start"] == texts[0].index(key) and by[0][0]["length"] == len(key)
    assert by[6][0]["start"] == texts[6].index(key)
    assert secrets.scan(df.limit(0)).count() == 0


def test_candidates_as_by_expression():
    import re

    texts = ["abc-def123456 X" * 30, "aaaaaaaaaaaaaaaa", "pathIsLongEnough=", "é12345678901234==x", "short1"]
    column = pa.array(texts, pa.large_string())
    data, offsets, _ = secrets.text_bytes(column)
    row, start, end = secrets.candidates(data, offsets)
    got = [(r, data[s:e].tobytes().decode()) for r, s, e in zip(row, start, end)]
    want = []
    for r, t in enumerate(texts):
        for m in re.finditer(r"[A-Za-z0-9\-_+/]{12,}", t):
            if re.search(r"[0-9]|[a-z][A-Z]", m.group()):
                want.append((r, m.group() + re.match("={0,2}", t[m.end() :]).group()))
    assert got == want


def test_language_as_by_dense_cosines(spark):
    """Every document against every centroid, n-gram by n-gram."""
    docs = documents(spark)
    model = language_id.fit(docs)
    twice = docs.unionAll(docs.limit(20))
    got = sorted(((r["doc_id"], r["lang"], r["score"], r["accepted"]) for r in language_id.identify(twice, model=model).collect()), key=str)
    assert len(got) == twice.count()
    lower = {c: c + 32 for c in range(65, 91)} | {c: c for c in (*range(97, 123), *range(128, 256))}
    want = []
    for r in twice.collect():
        if r["text"] is None:
            want.append((r["doc_id"], None, None, False))
            continue
        b = [lower.get(c, 0) for c in r["text"].encode()]
        b = [0] + [c + 32 if k and b[k - 1] == 0xC3 and 0x80 <= c <= 0x9E else c for k, c in enumerate(b)] + [0]
        tf = {}
        for k in range(1, len(b) - 1):
            if b[k]:
                h = (((b[k - 1] << 16 | b[k] << 8 | b[k + 1]) * 0x9E3779B1) & 0xFFFFFFFF) >> (32 - language_id.BITS)
                tf[h] = tf.get(h, 0) + 1
        x = np.zeros(1 << language_id.BITS)
        for h, c in tf.items():
            x[h] = (np.log(c) + 1) * model.idf[h]
        x /= max(np.linalg.norm(x), 1e-12)
        cos = model.centres @ x
        n = sum(tf.values())
        least = model.least[min(15, int(np.log2(max(n, 1))))]
        want.append((r["doc_id"], model.names[model.of[cos.argmax()]] if n else None, float(cos.max()) if n else 0.0, bool(n and cos.max() >= least)))
    want.sort(key=str)
    far = [(a, b) for a, b in zip(sorted(got, key=lambda x: (x[0], x[2] or 0)), sorted(want, key=lambda x: (x[0], x[2] or 0))) if a[:2] + a[3:] != b[:2] + b[3:] or abs((a[2] or 0) - (b[2] or 0)) > 1e-4]
    assert not far


def test_language_ties_go_to_the_first_name(spark):
    rows = [(k, "one and the same words for both of them here", lang) for k, lang in enumerate(["b", "a"] * 10)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert {r["lang"] for r in language_id.identify(df).collect()} == {"a"}


def test_quality_as_by_plain_loops(spark):
    """Features counted byte by byte and a forward pass written out, for all documents."""
    import math
    import re

    docs, labels = documents(spark), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(docs, labels)
    got = {r["doc_id"]: r["quality_score"] for r in quality.quality(docs, labels, model=model).collect()}
    c = quality.CLASSES
    for r in docs.collect():
        if r["text"] is None:
            assert got[r["doc_id"]] is None
            continue
        raw = r["text"].encode()
        x = np.zeros(quality.N_FEATURES)
        kinds = [int(quality._CLASS[b]) for b in raw]
        for k, a in enumerate(kinds):
            x[a * c + (kinds[k + 1] if k + 1 < len(kinds) else 0)] += 1
        x[: c * c] = np.sqrt(x[: c * c] / max(len(raw), 1))
        words = re.findall(rb"[0-9A-Za-z\x80-\xff]+", raw)
        if words:
            n, own, sizes = len(words), len(set(words)), [len(w) for w in words]
            mean = sum(sizes) / n
            x[-8:-2] = [sum(a == b for a, b in zip(words, words[1:])) / n, own / n, math.log1p(n) / 10, mean / 10, math.sqrt(max(sum(s * s for s in sizes) / n - mean**2, 0)) / 10, math.log1p(own) / math.log1p(n)]
        if raw:
            x[-2:] = math.log1p(raw.count(b"\n")) / 5, math.log1p(len(raw)) / 12
        z = [min(6, max(-6, (v - m) / s)) for v, m, s in zip(x, model.mean, model.scale)]
        hidden = [math.tanh(sum(v * w for v, w in zip(z, model.w1[:, h])) + model.b1[h]) for h in range(quality.HIDDEN)]
        g = sum(h * w for h, w in zip(hidden, model.w2)) + model.b2
        assert abs(got[r["doc_id"]] - 1 / (1 + math.exp(-max(-30, min(30, g))))) < 1e-6


def test_slopes_are_those_of_the_risk():
    """Numerical derivatives of the formula: prior * R+ + max(0, Ru- - prior * Rp-), and the way back up below zero."""
    rng = np.random.default_rng(1)
    for shift, prior in ((0.0, 0.4), (3.0, 0.9)):
        g = np.concatenate([rng.normal(shift, 1, 30), rng.normal(-shift, 1, 50)])
        pos = np.arange(80) < 30
        whole, negative = quality.risk(g, pos, prior)
        slopes = quality.slopes(g, pos, prior)
        for k in range(80):
            h = np.zeros(80)
            h[k] = 1e-6
            up, down = quality.risk(g + h, pos, prior), quality.risk(g - h, pos, prior)
            want = (up[0] - down[0]) / 2e-6 if negative >= 0 else -(up[1] - down[1]) / 2e-6
            assert abs(want - slopes[k]) < 1e-6
    assert negative < 0
