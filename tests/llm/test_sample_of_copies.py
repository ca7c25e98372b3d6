import numpy as np
from pyspark.sql import functions as F

from treeline.llm import language_id, quality


def chosen(spark, label: str, below: int) -> str:
    """A text whose hash with its label is below the threshold of samples."""
    texts = spark.range(100_000).select(F.concat(F.lit("a copied text of number "), F.col("id").cast("string")).alias("t"))
    h = F.xxhash64("t", F.lit(label)) if label else F.xxhash64("t")
    return texts.where(F.pmod(h, F.lit(1_000_003)) < below).orderBy(h).first()["t"]


def test_language_sample_is_of_distinct_texts(spark):
    copied = chosen(spark, "en", 2000)
    copies = spark.range(6000).select(F.lit(copied).alias("text"), F.lit("en").alias("lang"))
    english = spark.range(3000).select(F.concat(F.lit("plain words of the text "), F.col("id").cast("string")), F.lit("en"))
    seen = []
    real = language_id.Model

    def model(texts, labels):
        seen.append((texts, labels))
        return real(texts, labels)

    language_id.Model = model
    try:
        got = language_id.fit(copies.union(english))
    finally:
        language_id.Model = real
    texts, _ = seen[0]
    assert got.names == ["en"] and len(texts) == len(set(texts)) > 1500
    # A language of copies alone is learnt still.
    assert language_id.fit(copies).names == ["en"]


def test_quality_sample_weighs_copies_as_the_table_does(spark):
    copied = chosen(spark, "", 4000)
    copies = spark.range(3000).select(F.lit(copied).alias("text"))
    other = spark.range(57_000).select(F.concat(F.lit("other words "), F.col("id").cast("string")))
    texts, stands_for = quality._some(copies.union(other), 60_000, 4000)
    assert len(texts) == len(set(texts)) and len(stands_for) == 4000
    share = np.mean([texts[k] == copied for k in stands_for])
    assert 0.04 < share < 0.06
    # A table below the sample is read whole, each copy once.
    small, each = quality._some(spark.createDataFrame([("a",), ("b",), ("a",)], "text string"), 3, 4000)
    assert sorted(small[k] for k in each) == ["a", "a", "b"]
