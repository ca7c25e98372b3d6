"""The engine: a model and documents (or their tables), asked by XPath."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.operators.shred import Filters, raw_tables, shred, shred_all, shred_once
from treeline.plans.planner import Documents, Planner, Tables
from treeline.schema.model import SchemaModel
from treeline.workspace import new_folder
from treeline.xpath.binder import Binder
from treeline.xpath.parser import Path, Union, XPathError, parse


class Engine:
    def __init__(self, model: SchemaModel, source: Documents | Tables):
        self.model, self.source = model, source

    @classmethod
    def of_documents(cls, docs: DataFrame, model: SchemaModel, filters: Filters | None = None) -> Engine:
        """docs: (document_id, xml)."""
        return cls(model, Documents(docs, model, filters))

    @classmethod
    def of_tables(cls, spark: SparkSession, tables: dict[str, DataFrame], model: SchemaModel) -> Engine:
        return cls(model, Tables(spark, tables))

    def xpath(self, expression: str, variables: dict | None = None, *, keys: bool = False, bag: bool = False, strict: bool = False) -> DataFrame:
        """Result of an XPath 1.0 expression. keys: with document_id and the table's key."""
        return Planner(self.model, self.source, variables, bag=bag, strict=strict).run(expression, keys)

    def exists(self, expression: str, variables: dict | None = None) -> DataFrame:
        """(found): whether a path has any node; the search ends with the first."""
        return Planner(self.model, self.source, variables).run(expression, bare=True).limit(1).agg((F.count("*") > 0).alias("found"))

    def paths(self, expression: str) -> list[str]:
        """Absolute paths that an expression is bound to."""
        ast = parse(expression)
        parts = ast.parts if isinstance(ast, Union) else [ast]
        if not all(isinstance(p, Path) for p in parts):
            raise XPathError("not a location path")
        return list(dict.fromkeys(b.path for p in parts for b in Binder(self.model).bind(p)))

    def table(self, name: str, columns: list[str] | None = None) -> DataFrame:
        """Rows of one table."""
        if isinstance(self.source, Documents):
            return shred(self.source.docs, self.model, name, columns, filters=self.source.filters)
        df = self.source.tables[name]
        return df.select(*columns) if columns else df

    def tables(self, wanted: dict[str, list[str]], *, text: bool = False, order: bool = False) -> tuple[dict[str, DataFrame], bool]:
        """Rows of several tables with the given columns, from one parse of documents; and whether their values are text.

        text: values as they are written, if there are documents and nothing changes them. order: with places in document
        order, if there are documents.
        """
        if isinstance(self.source, Tables):
            return {t: self.source.tables[t].select(*cs) for t, cs in wanted.items()}, False
        docs, filters, store = self.source.docs, self.source.filters, new_folder(self.source.spark, "nodes")
        if text and (filters is None or filters == Filters(malformed=filters.malformed)):
            return raw_tables(docs, self.model, wanted, store, order, filters.malformed if filters else "raise"), True
        return shred_once(docs, self.model, wanted, store, filters=filters, order=order), False

    def load(self, store: str | None = None) -> dict[str, DataFrame]:
        """All tables, from one parse if they are stored."""
        if isinstance(self.source, Tables):
            return self.source.tables
        return shred_all(self.source.docs, self.model, store, self.source.filters)
