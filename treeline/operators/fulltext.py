"""Full-text tables: postings, attributes, dictionaries, suggesters and the xmlpipe2 form of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeline.functions.text import tokens, trigrams, xml_escape
from treeline.schema import model as M

FIELD_LIMIT = 2 * 1024 * 1024


def chosen_fields(model: M.SchemaModel, names: tuple[str, ...] = (), *, everything: bool = False, types: tuple[str, ...] = ()) -> list[tuple[str, M.Field]]:
    """(table, field) that are indexed: named as table.column, all, or of given types; xs:ID always."""
    out = []
    for t in model.tables.values():
        for f in t.content:
            if everything or f"{t.name}.{f.name}" in names or t.name in names or f.xs_type in types or f.xs_type == "ID":
                out.append((t.name, f))
    return out


def field_values(engine, fields: list[tuple[str, M.Field]]) -> DataFrame:
    """(document_id, field, value) of the chosen columns."""
    out = None
    names = list(dict.fromkeys(t for t, _ in fields))
    wanted = {n: ["document_id", *[f.name for t, f in fields if t == n]] for n in names}
    rows = engine.tables(wanted)[0] if len(names) > 1 else {n: engine.table(n, cs) for n, cs in wanted.items()}
    for table in names:
        own = [f for t, f in fields if t == table]
        cells = F.array(*[F.struct(F.lit(f"{table}.{f.name}").alias("field"), F.col(f"`{f.name}`").cast("string").alias("value")) for f in own])
        part = rows[table].select("document_id", F.explode(cells).alias("x")).select("document_id", "x.*").where("value is not null")
        out = part if out is None else out.unionByName(part)
    return out


def postings(values: DataFrame, least: int = 1) -> DataFrame:
    """(term, field, document_id, tf, positions) of (document_id, field, value); words of fewer signs are left out."""
    words = values.select("document_id", "field", F.posexplode(tokens(F.col("value"), least)).alias("position", "term"))
    return words.groupBy("term", "field", "document_id").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("position")).alias("positions"))


def term_frequencies(values: DataFrame, least: int = 1) -> DataFrame:
    """(term, freq, df) over all documents."""
    words = values.select("document_id", F.explode(tokens(F.col("value"), least)).alias("term"))
    per = words.groupBy("term", "document_id").agg(F.count("*").alias("n"))
    return per.groupBy("term").agg(F.sum("n").alias("freq"), F.count("*").alias("df"))


def merge_dictionaries(*parts: DataFrame, least: int = 1) -> DataFrame:
    """(word, freq): frequencies of several dictionaries added up, rare words left out."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("word").agg(F.sum("freq").alias("freq")).where(F.col("freq") >= least)


def trigram_dictionary(words: DataFrame, least: int = 1) -> DataFrame:
    """(word, freq, trigrams) for correction of spelling."""
    return words.where(F.col("freq") >= least).select("word", "freq", F.array_join(trigrams(F.col("word")), " ").alias("trigrams"))


def suggest_prefix(terms: DataFrame, prefix: str, k: int = 10) -> DataFrame:
    """The k most frequent terms that begin with prefix."""
    return terms.where(F.startswith("term", F.lit(prefix.lower()))).orderBy(F.desc("df"), "term").limit(k)


def suggest_infix(terms: DataFrame, part: str, k: int = 10) -> DataFrame:
    """The k most frequent terms that contain part."""
    return terms.where(F.contains("term", F.lit(part.lower()))).orderBy(F.desc("df"), "term").limit(k)


def next_words(values: DataFrame, k: int = 5) -> DataFrame:
    """(first, second, n, rank): for each word its k most frequent followers."""
    words = tokens(F.col("value"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.struct(F.element_at("w", i).alias("first"), F.element_at("w", i + 1).alias("second")))
    two = values.select(words.alias("w")).where(F.size("w") > 1).select(F.explode(pairs).alias("p")).select("p.*").groupBy("first", "second").agg(F.count("*").alias("n"))
    w = Window.partitionBy("first").orderBy(F.desc("n"), "second")
    return two.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(post: DataFrame, words: list[str]) -> DataFrame:
    """(document_id, score) of documents with all words; the score is the sum of their frequencies."""
    words = [w.lower() for w in words]
    hit = post.where(F.col("term").isin(*words)).groupBy("document_id").agg(F.countDistinct("term").alias("n"), F.sum("tf").alias("score"))
    return hit.where(F.col("n") == len(set(words))).select("document_id", "score")


def update_postings(post: DataFrame, gone: DataFrame, fresh: DataFrame) -> DataFrame:
    """Postings after documents were deleted or read anew."""
    return post.join(gone.select("document_id").distinct(), "document_id", "left_anti").unionByName(fresh)


class PostingsStore:
    """An index kept in a folder: postings by batches, and for each document the batch that has it now.

    update() appends a batch, so that a search reads postings whose batch is their document's last one; compact() leaves
    only those. A batch replaces its own folder, so that a repeated update leaves its rows once.
    """

    POSTING = "term string, field string, document_id string, tf bigint, positions array<int>, batch int"
    STATE = "document_id string, gone boolean, batch int"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _read(self, name: str, schema: str) -> DataFrame:
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException:
            return self.spark.createDataFrame([], schema)

    def _last(self) -> DataFrame:
        state = self._read("documents", self.STATE)
        return state.groupBy("document_id").agg(F.max(F.struct("batch", "gone")).alias("x")).select("document_id", "x.batch", "x.gone").where("not gone")

    def documents(self) -> DataFrame:
        """(document_id) of the documents in the index."""
        return self._last().select("document_id")

    def read(self) -> DataFrame:
        """(term, field, document_id, tf, positions) as of now."""
        last = self._last().select(F.col("document_id").alias("__d"), F.col("batch").alias("__b"))
        post = self._read("postings", self.POSTING)
        return post.join(last, (F.col("document_id") == F.col("__d")) & (F.col("batch") == F.col("__b")), "left_semi").drop("batch")

    def update(self, values: DataFrame, gone: DataFrame | None = None, least: int = 1, batch: int | None = None) -> None:
        """Documents of values (document_id, field, value) are new or read anew; those of gone (document_id) leave."""
        if batch is None:
            batch = (self._read("documents", self.STATE).agg(F.max("batch")).first()[0] or 0) + 1
        here = values.select("document_id", F.lit(False).alias("gone"))
        state = here if gone is None else here.unionAll(gone.select(F.col(gone.columns[0]).cast("string"), F.lit(True)))
        postings(values, least).write.mode("overwrite").parquet(f"{self.path}/postings/batch={batch}")
        state.groupBy("document_id").agg(F.min("gone").alias("gone")).write.mode("overwrite").parquet(f"{self.path}/documents/batch={batch}")

    def compact(self) -> None:
        """One batch of what is there now, written beside and then put in the place of the others."""
        folder = f"{self.path}/compact"
        self.read().write.mode("overwrite").parquet(f"{folder}/postings/batch=1")
        self.documents().withColumn("gone", F.lit(False)).write.mode("overwrite").parquet(f"{folder}/documents/batch=1")
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        for name in ("postings", "documents"):
            fs = hadoop(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
            fs.delete(hadoop(f"{self.path}/{name}"), True)
            fs.rename(hadoop(f"{folder}/{name}"), hadoop(f"{self.path}/{name}"))
            fs.delete(hadoop(f"{folder}/{name}"), True)
        self.spark.catalog.refreshByPath(self.path)


def search_conf(name: str, path: str, attributes: list[tuple[str, M.Field]]) -> str:
    """Configuration of a search engine's source and index over an xmlpipe2 file."""
    kind = {"bigint": "xmlpipe_attr_bigint", "int": "xmlpipe_attr_uint", "float": "xmlpipe_attr_float", "timestamp": "xmlpipe_attr_timestamp", "bool": "xmlpipe_attr_bool", "string": "xmlpipe_attr_string"}
    lines = [f"source {name}", "{", "    type = xmlpipe2", f"    xmlpipe_command = cat {path}", "    xmlpipe_field = content"]
    lines += [f"    {kind[attribute_kind(f)]} = {t}__{f.name}" for t, f in attributes]
    return "\n".join([*lines, "}", "", f"index {name}", "{", f"    source = {name}", f"    path = {path}.index", "    min_prefix_len = 1", "}", ""])


def capped_content(values: DataFrame, limit: int = FIELD_LIMIT) -> DataFrame:
    """(document_id, content): all values of a document, each text once, cut at `limit` characters, which is what a search
    engine takes as one field; pass another limit for one that takes more."""
    per = values.groupBy("document_id").agg(F.array_sort(F.collect_set("value")).alias("all"))
    return per.select("document_id", F.substring(F.array_join("all", "\n"), 1, limit).alias("content"))


def multi_values(values: DataFrame, separator: str = ",") -> DataFrame:
    """(document_id, field, joined, first): several values of an attribute as one, and the first of them."""
    return values.groupBy("document_id", "field").agg(F.array_join(F.array_sort(F.collect_list("value")), separator).alias("joined"), F.min("value").alias("first"))


def search_documents(values: DataFrame, attributes: DataFrame | None = None) -> DataFrame:
    """(document_id, xml): documents of an xmlpipe2 stream with their content and attributes."""
    docs = capped_content(values)
    parts = [F.lit('<sphinx:document id="'), xml_escape(F.col("document_id")), F.lit('"><content>'), xml_escape(F.col("content")), F.lit("</content>")]
    if attributes is not None:
        a = multi_values(attributes).groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("field", "joined"))).alias("attrs"))
        docs = docs.join(a, "document_id", "left")
        tag = lambda x: F.replace(x["field"], F.lit("."), F.lit("__"))
        parts.append(F.coalesce(F.array_join(F.transform("attrs", lambda x: F.concat(F.lit("<"), tag(x), F.lit(">"), xml_escape(x["joined"]), F.lit("</"), tag(x), F.lit(">"))), ""), F.lit("")))
    return docs.select("document_id", F.concat(*parts, F.lit("</sphinx:document>")).alias("xml"))


def attribute_kind(f: M.Field) -> str:
    """Type of a search engine's attribute."""
    if f.xs_type in ("long", "unsignedLong"):
        return "bigint"
    if f.xs_type.lower().endswith(("int", "short", "byte", "integer")):
        return "int"
    return {"float": "float", "double": "float", "decimal": "float", "date": "timestamp", "dateTime": "timestamp", "boolean": "bool"}.get(f.xs_type, "string")


def search_schema(attributes: list[tuple[str, M.Field]]) -> str:
    """Schema head of an xmlpipe2 stream."""
    return '<sphinx:schema><sphinx:field name="content"/>' + "".join(f'<sphinx:attr name="{t}__{f.name}" type="{attribute_kind(f)}"/>' for t, f in attributes) + "</sphinx:schema>"


def merge_sources(*parts: DataFrame) -> DataFrame:
    """One data source of several shards; a document that several have is taken from the first."""
    out = None
    for k, p in enumerate(parts):
        p = p.withColumn("__shard", F.lit(k))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    w = Window.partitionBy("document_id").orderBy("__shard")
    return out.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__shard")
