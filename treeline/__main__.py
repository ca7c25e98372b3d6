"""Command line: python -m treeline COMMAND --help.

Schemas: ddl, jsonschema, check-schema. Loading: shred, delimited. Queries: xpath (tables, XML or JSON), paths. Documents:
json, validate, split, checksums. Full text: terms, dictionary.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.engine import Engine
from treeline.operators import fulltext, publish, split, sync, validate
from treeline.operators.shred import Filters, shred_all
from treeline.schema import ddl, jsonschema
from treeline.schema.xsd import compile_schema, diagnose
from treeline.sources import documents, sinks


def _pairs(items: list[str], sign: str) -> dict[str, str]:
    return dict(x.split(sign, 1) for x in items or [])


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="treeline", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *, xml: bool = True, xsd: bool = True, out: bool = True) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        if xsd:
            c.add_argument("--xsd", required=True)
            c.add_argument("--root")
            c.add_argument("--hash-algorithm", default="sha1", choices=("sha1", "md5", "sha256"))
            c.add_argument("--hash-size", default="long", choices=("long", "int", "native", "debug"))
            c.add_argument("--integer", default="int", choices=("int", "bigint", "decimal"))
            c.add_argument("--decimal", default="big", choices=("big", "double", "float"))
        if xml:
            c.add_argument("--xml", nargs="+", required=True, help="files or folders, plain, .gz or .zip; or one .parquet of (document_id, xml)")
            c.add_argument("--pattern", help="a regular expression for whole paths")
            c.add_argument("--extension", default=".xml")
            c.add_argument("--prefix", default="")
            c.add_argument("--case", default="", choices=("", "lower", "upper"))
        if out:
            c.add_argument("--out", required=True)
        return c

    for name in ("shred", "delimited"):
        c = add(name)
        c.add_argument("--keep", nargs="*", default=[], help="tables that are written, with all below them")
        c.add_argument("--drop", nargs="*", help="table.column:pattern")
        c.add_argument("--fill", nargs="*", help="table.column:text")
        c.add_argument("--fill-default", action="store_true")
        c.add_argument("--check-types", action="store_true")
        c.add_argument("--comma", action="store_true")
    c = add("ddl", xml=False, out=False)
    c.add_argument("--database", default="")
    c.add_argument("--drop", action="store_true")
    c = add("jsonschema", xml=False, out=False)
    c.add_argument("--dialect", default="object", choices=("object", "column", "relational"))
    c.add_argument("--draft", default="latest", choices=tuple(jsonschema.DRAFTS))
    sub.add_parser("check-schema").add_argument("--xsd", required=True)
    c = add("xpath")
    c.add_argument("--query", required=True)
    c.add_argument("--var", nargs="*", help="name=value")
    c.add_argument("--as", dest="form", default="table", choices=("table", "xml", "json"))
    add("paths", xml=False, out=False).add_argument("--query", required=True)
    add("json").add_argument("--dialect", default="object", choices=("object", "column", "relational"))
    add("validate")
    c = add("split", xsd=False)
    c.add_argument("--unit", required=True)
    c.add_argument("--key", required=True)
    c.add_argument("--shards", type=int, default=0)
    c = add("checksums", xsd=False)
    c.add_argument("--state", help="Parquet of an earlier run: what has changed since is written")
    c.add_argument("--algorithm", default="md5", choices=("md5", "sha1", "sha256"))
    for name in ("terms", "dictionary"):
        c = add(name)
        c.add_argument("--field", nargs="*", default=[], help="table.column or table; all if none")
        c.add_argument("--least", type=int, default=1)
    return p


def read(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    if len(a.xml) == 1 and a.xml[0].endswith(".parquet"):
        return spark.read.parquet(a.xml[0]).select("document_id", "xml")
    return documents.read_documents(spark, *a.xml, pattern=a.pattern, extension=a.extension, prefix=a.prefix, case=a.case)


def run(a: argparse.Namespace, spark: SparkSession | None = None) -> None:
    if a.command == "check-schema":
        found = diagnose(a.xsd)
        print("\n".join(found) or "valid")
        if found:
            sys.exit(1)
        return
    model = compile_schema(a.xsd, a.root, hash_algorithm=a.hash_algorithm, hash_size=a.hash_size, integer=a.integer, decimal=a.decimal) if hasattr(a, "xsd") else None
    if a.command == "ddl":
        print(ddl.ddl(model, a.database, drop=a.drop))
        return
    if a.command == "jsonschema":
        print(jsonschema.json_schema_text(model, dialect=a.dialect, draft=a.draft))
        return
    if a.command == "paths":
        print("\n".join(Engine(model, None).paths(a.query)))
        return
    spark = spark or SparkSession.builder.appName("treeline").getOrCreate()
    docs = read(spark, a)
    if a.command in ("shred", "delimited"):
        filters = Filters(_pairs(a.drop, ":"), _pairs(a.fill, ":"), a.fill_default, a.check_types, tuple(a.keep))
        tables = shred_all(docs, model, f"{a.out}/0parsed", filters)
        for name, df in tables.items():
            if a.command == "shred":
                sinks.write_tables({name: df}, a.out)
            else:
                sinks.write_delimited(df, f"{a.out}/{name}", tab=not a.comma)
        return
    if a.command == "split":
        out = split.split_documents(docs, a.unit, a.key)
        out = split.shard(out, a.shards) if a.shards else out
        (out.write.partitionBy("shard") if a.shards else out.write).mode("overwrite").parquet(a.out)
        return
    if a.command == "checksums":
        now = sync.checksums(docs, a.algorithm)
        out = sync.classify(spark.read.parquet(a.state), now) if a.state else now
    elif a.command == "validate":
        out = validate.invalid_documents(docs, model)
    else:
        engine = Engine.of_documents(docs, model)
        if a.command == "json":
            out = publish.relational_json(engine) if a.dialect == "relational" else publish.to_json(engine, dialect=a.dialect)
        elif a.command == "xpath":
            out = engine.xpath(a.query, {k: float(v) if v.replace(".", "", 1).lstrip("-").isdigit() else v for k, v in _pairs(a.var, "=").items()})
            if a.form != "table":
                out = published(engine, out, a.form)
        else:
            values = fulltext.field_values(engine, fulltext.chosen_fields(engine.model, tuple(a.field), everything=not a.field))
            out = fulltext.term_frequencies(values, a.least)
            if a.command == "dictionary":
                out = fulltext.trigram_dictionary(out.select(F.col("term").alias("word"), "freq"))
    out.write.mode("overwrite").parquet(a.out)


def published(engine: Engine, rows: DataFrame, form: str) -> DataFrame:
    """A query's rows as XML or JSON: subtrees if it ended at a table, else one element for each value."""
    table = next((t for t in engine.model.tables.values() if {f.name for f in t.fields} == set(rows.columns)), None)
    if table is not None:
        keys = rows.select(table.primary)
        return publish.to_xml(engine, table.name, keys) if form == "xml" else publish.to_json(engine, table.name, subset=keys)
    column = rows.columns[-1]
    return publish.scalars_to_xml(rows, column, column) if form == "xml" else rows.select(F.to_json(F.struct(column)).alias("json"))


if __name__ == "__main__":
    run(arguments().parse_args())
