import random
import re

import pytest

from treeline.llm import ngram_join as J


def grams(text, n):
    w = [x for x in re.split("[^a-z0-9\x80-\U0010ffff]+", text.lower()) if x]
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute(rows, n, t):
    """Pairs of documents, which are ids with a set."""
    sets = {(i, frozenset(grams(x, n))) for i, x in rows if i is not None and x is not None}
    sets = sorted((x for x in sets if x[1]), key=lambda x: (x[0], sorted(x[1])))
    return {(x, y) for k, x in enumerate(sets) for y in sets[k + 1 :] if len(x[1] & y[1]) >= t * len(x[1] | y[1]) - 1e-12}


def classes(pairs, whole=False):
    """Class and links of each document in pairs; whole: also one member that stands for the class."""
    root, links = {}, {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for x, y in pairs:
        links[x], links[y] = links.get(x, 0) + 1, links.get(y, 0) + 1
        root[top(x)] = top(y)
    least = {}
    for x in links:
        least[top(x)] = min(least.get(top(x), x[0]), x[0])
    return {x: (least[top(x)], links[x], top(x))[: 2 + whole] for x in links}


def rows_of(pairs):
    return sorted((x[0], *c) for x, c in classes(pairs).items())


def corpus(seed, size=160):
    r = random.Random(seed)
    words = ["w%d" % k for k in range(60)] + ["été", "ÜBER"]
    rows = []
    for i in range(size):
        if rows and r.random() < 0.5:
            w = r.choice(rows)[1].split(" ")
            for _ in range(r.randint(0, max(1, len(w) // 8))):
                w[r.randrange(len(w))] = r.choice(words)
        else:
            w = [r.choice(words) for _ in range(r.choice([1, 2, 3, 8, 30, 200]))]
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("n,t", [(2, 0.7), (1, 0.5), (3, 0.85)])
def test_all_links_as_by_brute_force(spark, n, t):
    rows = corpus(n) + [(900, None), (None, "w1 w2 w3"), (901, ""), (902, "..."), (903, "w1"), (904, "W1!"), (5, "w1 w2"), (5, "w1 w2")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(map(tuple, J.ngram_jaccard_links(df, n=n, threshold=t).collect())) == rows_of(brute(rows, n, t))


def test_frequent_tokens_are_joined_by_combinations(spark, monkeypatch):
    monkeypatch.setattr(J, "LEAST", 1)
    monkeypatch.setattr(J, "SHARE", 1 << 30)
    rows = corpus(7)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(map(tuple, J.ngram_jaccard_links(df).collect())) == rows_of(brute(rows, 2, 0.7))


def test_more_parts_than_bits_to_spare():
    # As from 100 TB of text: 2**22 parts leave 31 bits of a token.
    import pyarrow as pa

    class Classes:
        value = bytes(1 << J.CLASS_BITS)

    batch = pa.RecordBatch.from_arrays([pa.array(["a b c d e f", "a b c d e f", "x y"])], names=["text"])
    for parts in (1 << 8, 1 << 22):
        got = [r for b in J._index(2, 0.7, parts, Classes, 1)([batch]) for r in b.to_pylist()]
        owners = {}
        for r in got:
            for tk, ow in zip(J.unpack(r["token"]).tolist(), J.np.frombuffer(r["owner"], J.np.uint16).tolist()):
                owners.setdefault((r["p"], tk), set()).add(J.np.frombuffer(r["fp"], J.np.int64)[ow])
        assert len(owners) >= 4 and all(len(x) == 1 for x in owners.values())


def test_groups_leave_one_document(spark):
    rows = corpus(3, 120) + [(3, "another text of the same id that copies none"), (3, "w1 w2 w3 w4 w5 w6 w7 w8"), (500, "w1 w2 w3 w4 w5 w6 w7 w8"), (501, "another text of the same id that copies none")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, id string, fp int")
    pairs = brute(rows, 2, 0.7)
    gone = {(r[0], r[1]) for r in J.near_duplicates(df).collect()}
    hashes = {(r[0], r[1]): (r[0], r[2]) for r in df.selectExpr("doc_id", "text", "xxhash64(text)").collect()}
    sets = {d: (d[0], frozenset(grams(d[1], 2))) for d in hashes}
    group, about = {}, classes(pairs, True)
    for d, h in hashes.items():
        if sets[d] in about:
            group.setdefault(about[sets[d]][::2], []).append(h)
    # All of a class but one, which has its least id.
    for (least, _), members in group.items():
        stays = [h for h in members if h not in gone]
        assert len(stays) == 1 and stays[0][0] == least
    assert gone <= {h for g in group.values() for h in g}


def test_ids_of_any_type(spark):
    df = spark.createDataFrame([("a-1", "one two three four"), ("b-2", "one two three four"), ("c", "else")], "doc_id string, text string")
    assert sorted(map(tuple, J.ngram_jaccard_links(df).collect())) == [("a-1", "a-1", 1), ("b-2", "a-1", 1)]
    assert J.near_duplicates(df).count() == 1


def test_empty_tables_and_bad_thresholds(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert J.ngram_jaccard_links(df).count() == 0
    assert J.near_duplicates(df).count() == 0
    with pytest.raises(ValueError):
        J.ngram_jaccard_links(df, threshold=0)


def test_pairs_are_handed_on_before_they_fill_a_task(monkeypatch):
    # Held until the end, the pairs of a part took ever more memory of a worker as tables grew.
    import pyarrow as pa

    class Classes:
        value = bytes(1 << J.CLASS_BITS)

    batch = pa.RecordBatch.from_arrays([pa.array([x for _, x in corpus(5, 300)])], names=["text"])
    entries = [b for b in J._index(2, 0.7, 1, Classes, 1)([batch])]

    def summed():
        got, most = {}, 0
        for b in J._candidates(0.7)(iter(entries)):
            most = max(most, len(b))
            for r in b.to_pylist():
                shared, need = got.get((r["a"], r["b"]), (0, r["need"]))
                assert need == r["need"]
                got[r["a"], r["b"]] = shared + r["shared"], need
        return got, most

    whole, _ = summed()
    monkeypatch.setattr(J, "PAIRS", 256)
    assert summed() == (whole, 32) and len(whole) > 1000


def test_a_bucket_of_pairs_has_few_bytes_of_sets(spark, monkeypatch):
    monkeypatch.setattr(J, "HELD", 16_000)
    ids = list(range(200))
    # All sets have one least hash, so that all pairs have one key.
    sets = spark.createDataFrame([(i, 7, bytes(1000)) for i in ids], "fp bigint, m bigint, grams binary")
    pairs = [(a, b) for a in ids for b in ids if a < b]
    got = J._placed(spark.createDataFrame(pairs, "a bigint, b bigint"), sets).collect()
    assert sorted((r["a"], r["b"]) for r in got) == pairs
    held = {}
    for r in got:
        held.setdefault(r["at"], set()).update((r["a"], r["b"]))
    assert 1000 * max(map(len, held.values())) <= 6 * J.HELD < 1000 * len(ids)


def test_small_buckets_drop_the_same_copies(spark, monkeypatch):
    # The pipeline's third stage, with keys cut into squares.
    df = spark.createDataFrame(corpus(11, 100), "doc_id bigint, text string")
    usual = sorted(map(tuple, J.near_duplicates(df).collect()))
    monkeypatch.setattr(J, "HELD", 500)
    monkeypatch.setattr(J, "TOGETHER", 4)
    assert usual and sorted(map(tuple, J.near_duplicates(df).collect())) == usual


def test_a_set_is_worked_out_once(spark):
    # A condition on the fingerprints' size ran the whole of it again, in a second worker of each task.
    docs = J._prepared(spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string"), "doc_id", "text")
    assert J._known(docs, 2)._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_pairs_are_counted_where_both_sizes_allow():
    # Sets that meet only where no pair of their sizes needs to were candidates: billions of rows at some GB.
    import pyarrow as pa

    class Classes:
        value = bytes(1 << J.CLASS_BITS)

    r = random.Random(1)
    rows = corpus(5, 300) + [(1000 + i, " ".join(f"v{r.randrange(40)}" for _ in range(120))) for i in range(100)]
    rows = [(i, x) for i, x in rows if grams(x, 2)]
    rows = [(i, x.lower()) for i, x in rows]
    batch = pa.RecordBatch.from_arrays([pa.array([x for _, x in rows])], names=["text"])
    g = [J.gram_sets(J.np.frombuffer(x.encode(), J.np.uint8), J.np.array([0, len(x.encode())]), 2)[1] for _, x in rows]
    fp = [int(J._set_prints(J.np.zeros(len(x), J.np.int64), x, 1)[0][0]) for x in g]
    size = dict(zip(fp, map(len, g)))
    for frequent in (1, 0):
        got = {}
        for part in J._candidates(0.7)(J._index(2, 0.7, 1, Classes, frequent)([batch])):
            for c in part.to_pylist():
                got[c["a"], c["b"]] = got.get((c["a"], c["b"]), 0) + c["shared"], c["need"]
        own = {f: set(x.tolist()) for f, x in zip(fp, g)}
        linked = {(a, b) for a in own for b in own if a < b and len(own[a] & own[b]) >= 0.7 * len(own[a] | own[b]) - 1e-12}
        assert linked and linked <= {p for p, (shared, need) in got.items() if shared >= need}
        if frequent:
            # What they share lies in the prefixes of this pair, in order of hash.
            for (a, b), (shared, _) in got.items():
                x, y = sorted(own[a]), sorted(own[b])
                o, k = J.math.ceil(0.7 / 1.7 * (size[a] + size[b]) - 1e-9), J.K + min(size[a], size[b]) // J.EXTEND
                assert shared <= len(set(x[: len(x) - o + k]) & set(y[: len(y) - o + k]))
