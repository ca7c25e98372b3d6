import random

import numpy as np

from treeline.llm import decontaminate as D


def folded(t):
    return D.fold(np.frombuffer(t.encode(), np.uint8)).tobytes()


def least_distance(item, text):
    """Sellers' algorithm, row by row."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def brute(docs, items):
    out = {}
    for i, t in docs:
        for k, x in items:
            if t is not None and x is not None and k is not None and x:
                item = folded(x)
                d = least_distance(item, folded(t)) if t else len(item)
                if d <= int(D.SHARE * len(item) + 1e-9):
                    out[i, k] = min(d, out.get((i, k), d))
    return out


def case(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgéÉ") for _ in range(r.randint(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(k, text(r.randint(8, 25))) for k in range(8)] + [(50, None), (51, "short"), (52, ""), (0, "again " + text(9))]
    docs = []
    for i in range(60):
        t = text(r.randint(0, 40))
        if i % 3:
            x = list(r.choice(items[:8])[1])
            for _ in range(r.randint(0, max(1, int(len(x) * 0.09)))):
                at, kind = r.randrange(len(x)), r.randint(0, 2)
                if kind == 0:
                    x[at] = r.choice("xyz")
                elif kind == 1:
                    x.insert(at, r.choice("xyz"))
                else:
                    del x[at]
            t = t + " " + "".join(x).upper() + " " + text(r.randint(0, 20))
        docs.append((i, t))
    return docs + [(100, None), (101, ""), (None, items[0][1]), (102, items[1][1] + " "), (102, items[1][1])], items


def test_recall_and_exactness_against_brute_force(spark):
    found = wanted = 0
    for seed in (1, 2):
        docs, items = case(seed)
        got = {(r[0], r[1]): r[2] for r in D.contamination(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
        want = brute(docs, items)
        assert set(got) <= set(want)
        found, wanted = found + len(set(got) & set(want)), wanted + len(want)
        assert all(got[k] >= want[k] for k in got)
        # Whole copies are always found.
        assert all(k in got for k, d in want.items() if d == 0)
    assert found >= 0.95 * wanted


def test_clean_documents_stay_with_all_columns(spark):
    docs, items = case(3)
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    kept = D.decontaminate(df, bench)
    bad = {i for i, _ in brute(docs, items)}
    assert kept.columns == df.columns
    left = [r[0] for r in kept.collect()]
    assert {i for i, _ in docs if i not in bad} <= set(left)
    assert len([i for i in left if i in bad]) <= 1


def test_empty_tables_and_several_indexes(spark, monkeypatch):
    docs, items = case(4)
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    none = spark.createDataFrame([], "item_id bigint, text string")
    df, bench = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert D.contamination(empty, bench).count() == 0
    assert D.decontaminate(df, none).count() == len(docs)
    whole = {tuple(r)[:2] for r in D.contamination(df, bench).collect()}
    many = D.build_indexes(bench, size=300)
    assert len(many) == 1 and len(many[0]) > 1
    from pyspark.sql import functions as F

    kind = bench.schema["item_id"].dataType
    apart = {(r[0], x["item_id"]) for r in df.select("doc_id", D.leaks(F.col("text"), many[0], kind)).collect() for x in r[1]}
    assert len(whole & apart) >= 0.9 * len(whole | apart)
    monkeypatch.setattr(D, "INDEX", 300)
    monkeypatch.setattr(D, "AT_ONCE", 1)
    monkeypatch.setattr(D.build_indexes, "__defaults__", ("item_id", "text", D.SHARE, 300, 1))
    passes = {tuple(r)[:2] for r in D.contamination(df, bench).collect()}
    assert passes == apart
    assert {r[0] for r in df.collect()} - {i for i, _ in passes} == {r[0] for r in D.decontaminate(df, bench).collect()}


def test_long_short_and_repeated_items():
    r = random.Random(8)
    long = "".join(r.choice("abcdefgh ") for _ in range(20_000))
    x = list(long)
    for _ in range(1000):
        x[r.randrange(len(x))] = r.choice("xyz")
    index = D.Index([("l", long.encode()), ("m", long.encode()), ("s", b"tiny"), ("e", b"exactly so!")])
    assert index.recall >= D.RECALL
    texts = ["before " + "".join(x) + " after", "a tiny one", "exactly so!", "exactly sO!", long[:9000] + "?" * 11000, ""]
    raw = [t.encode() for t in texts]
    got = index.search(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in raw])]))
    assert set(got) == {(0, 0), (0, 1), (1, 2), (2, 3), (3, 3)} and got[0, 0] == got[0, 1] <= 1000


def test_ids_of_any_type(spark):
    df = spark.createDataFrame([("x", "what is the capital of the small country"), ("y", "else")], "doc_id string, text string")
    bench = spark.createDataFrame([("q1", "What is the capital of the small country")], "item_id string, text string")
    assert [tuple(r) for r in D.contamination(df, bench).collect()] == [("x", "q1", 0)]


def test_edit_distance():
    r = random.Random(5)
    for _ in range(200):
        a, b = ("".join(r.choice("ab") for _ in range(r.randint(1, 12))).encode() for _ in range(2))
        assert D.edit_distance_within(a, b) == least_distance(a, b)
