"""Removal of boilerplate lines, which are lines that many distinct sites have.

A line of fewer rows than the threshold has fewer sites, so that a count of rows by the line's hash leaves out nearly all
lines before anything is sketched. The sites of the others are gathered in a HyperLogLog sketch for each hash; sketches
merge by aggregation. A line whose estimate is far from the threshold is decided by it. Lines near it get an exact count
of distinct sites. Lines at or above the threshold are removed from all texts.

A line is the text between newlines; lines of white space only are never boilerplate and always stay. A null site counts
as no site. A null text stays null, an empty one stays empty, and a text may become empty. Lines are known by 128 bits of
hash. Rows are not merged or dropped: repeated rows, null ids and equal ids with other texts all come out as they went
in, and columns that are not named stay out of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.llm._spark import cut, pick, table

#: Distinct sites from which a line is boilerplate.
MIN_SITES = 8
#: Registers of a sketch, as a power of two: a standard error of about 1.6 %.
LG_REGISTERS = 12
#: Lines within this share of the threshold are counted exactly: six standard errors.
MARGIN = 0.1
#: Places of lines that are kept together.
PLACES = 1024


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _hash(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(7), line).alias("b"))


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, margin: float = MARGIN) -> DataFrame:
    """(h): hashes of the boilerplate lines of docs (site, text)."""
    lines = docs.where("text is not null and site is not null").select("site", F.explode(F.array_distinct(_lines(F.col("text")))).alias("line"))
    seen = lines.where(F.trim(F.translate("line", "\t\r\f\v", "    ")) != "").select(_hash(F.col("line")).alias("h"), "site")
    often = seen.groupBy("h").agg(F.count("*").alias("rows")).where(F.col("rows") >= min_sites).select("h")
    some = cut(seen.join(often, "h", "left_semi"))
    low, high = min_sites * (1 - margin) - 1, min_sites * (1 + margin) + 1
    spread = some.groupBy("h").agg(F.hll_sketch_agg("site", F.lit(LG_REGISTERS)).alias("sketch"))
    about = cut(spread.select("h", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= low))
    near = about.where(F.col("sites").between(low, high)).select("h")
    exact = some.join(near, "h", "left_semi").groupBy("h").agg(F.countDistinct("site").alias("sites")).where(F.col("sites") >= min_sites)
    return about.where(F.col("sites") > high).select("h").unionAll(exact.select("h"))


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", *, min_sites: int = MIN_SITES, margin: float = MARGIN) -> DataFrame:
    """(doc_id, text, n_lines, n_removed) of every row."""
    docs = pick(df, id=id_col, text=text_col, site=site_col).select("id", "text", F.col("site").cast("string").alias("site"))
    bad = boilerplate(docs, min_sites, margin)
    texts = docs.select("id", "text", F.xxhash64("text").alias("th"))
    # Only hashes and places of lines meet the boilerplate; texts move once, to meet the places to remove.
    places = texts.where("text is not null").select("id", "th", F.posexplode(F.transform(_lines(F.col("text")), _hash)).alias("at", "h"))
    gone = places.join(bad, "h").groupBy("id", "th").agg(F.collect_set("at").alias("gone"))
    # Places are kept by thousands, so that a text of very many lines looks through few of them for each.
    by = F.transform(F.sequence(F.lit(0), F.floor(F.array_max("gone") / PLACES).cast("int")), lambda b: F.filter("gone", lambda p: F.floor(p / PLACES) == b))
    gone = gone.select(F.col("id").alias("gid"), F.col("th").alias("gth"), F.size("gone").alias("n_gone"), by.alias("gone"))
    met = texts.join(gone, F.col("id").eqNullSafe(F.col("gid")) & (F.col("th") == F.col("gth")), "left")
    all_lines = _lines(F.col("text"))
    kept = F.array_join(F.filter(all_lines, lambda x, i: ~F.coalesce(F.array_contains(F.get("gone", F.floor(i / PLACES).cast("int")), i), F.lit(False))), "\n")
    return met.select(
        F.col("id").alias("doc_id"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("text"),
        F.when(F.col("text").isNotNull(), F.size(all_lines)).cast("bigint").alias("n_lines"),
        F.coalesce(F.col("n_gone"), F.lit(0)).cast("bigint").alias("n_removed"),
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents"))


SQL = r"""
WITH l AS (SELECT DISTINCT source, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL AND source IS NOT NULL),
b AS (SELECT line FROM l WHERE regexp_replace(line, '[ \t\r\f\v]', '', 'g') <> '' GROUP BY line HAVING count(DISTINCT source) >= 8),
d AS (SELECT doc_id, text, row_number() OVER () AS r, string_split(text, chr(10)) AS ls FROM documents),
x AS (SELECT r, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM d),
k AS (SELECT x.r, string_agg(x.line, chr(10) ORDER BY x.i) FILTER (b.line IS NULL) AS text, count(*) AS n, count(b.line) AS gone
      FROM x LEFT JOIN b ON x.line = b.line GROUP BY x.r)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text,
       CASE WHEN d.text IS NOT NULL THEN coalesce(k.n, 1) END AS n_lines, coalesce(k.gone, 0) AS n_removed
FROM d LEFT JOIN k ON d.r = k.r
"""
