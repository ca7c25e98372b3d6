import corpus_pipeline
from tests.conftest import SF
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_ngram_join import brute as pairs
from tests.llm.test_ngram_join import classes
from treeline.llm import language_id
from treeline.llm._vocabulary import Vocabulary, rank_file


def test_run_is_the_stages_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    known = {r["doc_id"] for r in language_id.identify(docs).where("accepted").collect()}
    rows = sorted(r for r in rows if r[0] in known)
    seen, unique = set(), []
    for i, t in rows:
        if t not in seen:
            seen.add(t)
            unique.append((i, t))
    about = classes(pairs(unique, 2, 0.7))
    least = {x[0]: c[0] for x, c in about.items()}
    left = [(i, t) for i, t in unique if least.get(i, i) == i]
    # Only documents that hold a long piece of an item can be within its distance; the rest is spared the slow comparison.
    near = [(i, t) for i, t in left if any(x[k : k + 12].lower() in t.lower() for _, x in bench for k in range(0, len(x) - 12, 12))]
    bad = {i for i, _ in leaks([(i, t) for i, t in near if len(t) < 8000], bench)}
    skipped = {i for i, t in near if len(t) >= 8000}
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    want = {i for i, _ in left} - bad
    assert want - skipped == set(got) - skipped
    v, texts = Vocabulary(rank_file()), dict(rows)
    assert all(r["tokens"] == v.encoding.encode_ordinary(texts[i]) and r["round_trip"] for i, r in got.items())


def test_stages_keep_columns_and_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, "the cat sat on the mat and looked at the dog", None, None, None), (7_000_001, None, None, None, None), (7_000_002, "", "en", "x", 0)], docs.schema)
    frame = docs.unionByName(odd)
    from pyspark.sql import functions as F

    frame = frame.select("*", F.lit(1).alias("gone"), F.lit("z").alias("__gone"), F.lit(2).alias("id"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, SF)
        assert out.columns == frame.columns, name
        assert 0 < out.count() <= frame.count()
        assert stage(spark, frame.limit(0), SF).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, frame, SF).count() == frame.count()
