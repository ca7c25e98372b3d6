from pyspark.sql import functions as F

from treeline.llm import language_id


def test_rare_languages_are_learnt_at_any_size(spark):
    # 12 of 40,000 labelled texts: the sample in proportion holds less than one of them.
    common = spark.range(40_000).select("id", F.concat(F.lit("the common words of text number "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    rare = spark.range(12).select((F.col("id") + 50_000).alias("id"), F.concat(F.lit("ktoré zriedkavé slovo číslo "), F.col("id").cast("string")).alias("text"), F.lit("sk").alias("lang"))
    few = spark.range(4).select(F.col("id") + 60_000, F.lit("vier wenige"), F.lit("de"))
    model = language_id.fit(common.union(rare).union(few))
    assert model.names == ["en", "sk"]
    got = language_id.identify(rare, "id", model=model).collect()
    assert [r["lang"] for r in got] == ["sk"] * 12 and all(r["accepted"] for r in got)


def test_shares_of_languages():
    assert language_id.shares({"a": 10**7, "b": 10**6, "c": 5}, 2000) == {"c": 5, "b": 997, "a": 998}
    assert set(language_id.shares({str(k): 100 for k in range(300)}, 2000).values()) == {language_id.LEAST_SHARE}
