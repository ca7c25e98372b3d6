import pytest
from pyspark.sql import functions as F

from treeline.llm import exact_dedup as X

LONG = "lorem ipsum " * 4000
ROWS = [(5, "a b c"), (3, "a b c"), (9, "a b d"), (1, ""), (2, ""), (4, None), (6, None), (None, "a b c"), (7, LONG), (8, LONG), (8, LONG), (10, LONG[:-1] + "!")]


def brute(rows):
    out, groups = [], {}
    for i, t in rows:
        if t is not None:
            groups.setdefault(t, []).append(i)
    for ids in groups.values():
        ids.sort(key=lambda i: (i is None, i or 0))
        out += [(i, ids[0]) for i in ids[1:]]
    return sorted(out, key=str)


@pytest.mark.parametrize("stream,huge", [(1000, X.HUGE), (2, 1000)])
def test_pairs_as_by_brute_force(spark, stream, huge):
    rows = ROWS + [(k, "many copies") for k in range(100, 120)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(map(tuple, X.exact_duplicates(df, stream=stream, huge=huge).collect()), key=str) == brute(rows)
    assert X.exact_dedup(df, stream=stream, huge=huge).count() == len(rows) - len(brute(rows))


def test_ids_of_any_type(spark):
    df = spark.createDataFrame([("b", "x"), ("a", "x"), ("c", "y")], "doc_id string, text string")
    assert [tuple(r) for r in X.exact_duplicates(df).collect()] == [("b", "a")]


def test_fingerprints_that_collide_are_told_apart(spark):
    # At the point 0 only the last byte of a text counts.
    df = spark.createDataFrame([(1, "xa"), (2, "ya"), (3, "xa"), (4, "za"), (5, "ya")], "doc_id bigint, text string")
    assert sorted(map(tuple, X.exact_duplicates(df, points=(0,)).collect())) == [(3, 1), (5, 2)]


def test_rows_that_stay_keep_columns_of_any_name(spark):
    df = spark.createDataFrame([(*r, k, "x") for k, r in enumerate(ROWS)], "doc_id bigint, text string, __id int, __row string")
    kept = X.exact_dedup(df)
    assert kept.columns == df.columns
    dropped = brute(ROWS)
    assert kept.count() == len(ROWS) - len(dropped)
    assert sorted(r[0] for r in kept.where("text = 'a b c'").collect()) == [3]
    assert X.exact_dedup(df.limit(0)).count() == 0 and X.exact_duplicates(df.limit(0)).count() == 0


def test_pieces_compose_to_the_whole_fingerprint(spark):
    texts = ["", "a", "é" * 3000, LONG]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    whole = {r[0]: list(r[1]) for r in df.select("id", X.fingerprint(F.col("text"))).collect()}
    parts = {r["id"]: list(r["fp"]) for r in X.huge_fingerprints(df, "id", "text", piece=1000).collect()}
    assert whole == parts
