"""Bound paths to DataFrames.

Tables are joined only where a condition asks for it: a path without conditions reads the one table at its end. What a
predicate says of nodes below is a semi-join, its negation an anti-join; in other positions it is a flag by a left join.
Each expression is planned twice: first over empty tables, to see which columns it uses, then over the real ones, so that
shredding makes those columns and no others. Documents whose tables are read more than once are parsed once: the rows of
all those tables are written to the shared folder by one pass and joined from there.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeline.functions import xpath as X
from treeline.operators.shred import shred, shred_once
from treeline.schema import model as M
from treeline.schema.types import is_number, parsed
from treeline.workspace import new_folder
from treeline.xpath.binder import Beside, Binder, Bound, Has, Level
from treeline.xpath.parser import Binary, Call, Literal, Negate, Path, Union, Variable, XPathError, parse

FLIP = {"=": "=", "!=": "!=", "<": ">", ">": "<", "<=": ">=", ">=": "<="}


class Tables:
    """Tables that were shredded before."""

    ordered = False

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame]):
        self.spark, self.tables = spark, tables
        self.ordered = all("_begin" in t.columns for t in tables.values())

    def rows(self, table: str, columns: list[str]) -> DataFrame:
        return self.tables[table].select(*columns)


class Documents:
    """Documents that are shredded as far as a query needs them."""

    ordered = True

    def __init__(self, docs: DataFrame, model: M.SchemaModel, filters=None):
        self.spark, self.docs, self.model, self.filters = docs.sparkSession, docs, model, filters

    def own(self, table: str, columns: list[str]) -> list[str]:
        return [c for c in columns if c not in ("_begin", "_end")] or [self.model.tables[table].primary]

    def rows(self, table: str, columns: list[str]) -> DataFrame:
        order = any(c in ("_begin", "_end") for c in columns)
        return shred(self.docs, self.model, table, self.own(table, columns), filters=self.filters, order=order).select(*columns)

    def once(self, used: dict[str, list[str]]) -> Tables:
        """The given columns of several tables from one parse, kept in the shared folder."""
        order = any(c in ("_begin", "_end") for cs in used.values() for c in cs)
        wanted = {t: self.own(t, cs) for t, cs in used.items()}
        out = Tables(self.spark, shred_once(self.docs, self.model, wanted, new_folder(self.spark, "nodes"), filters=self.filters, order=order))
        out.ordered = True
        return out


@dataclass
class Context:
    df: DataFrame
    levels: tuple[Level, ...]
    field: M.Field | None = None
    step: object = None
    first: bool = False


@dataclass
class Nodes:
    bounds: list[Bound]
    absolute: bool = False


class Planner:
    def __init__(self, model: M.SchemaModel, source, variables: dict | None = None, *, bag: bool = False, strict: bool = False):
        """bag: a node comes once for each match of its predicates, as by joins. strict: count(), sum() and id() in predicates are errors."""
        self.model, self.source, self.variables, self.bag, self.strict = model, source, variables or {}, bag, strict
        self.binder = Binder(model)
        self.used: dict[str, list[str]] = {}
        self.dry = self.bare = False
        self.names = self.reads = 0

    # Tables --------------------------------------------------------------------------------------------------------

    def rows(self, table: str) -> DataFrame:
        schema = self.model.struct(table)
        if self.dry:
            self.used.setdefault(table, [])
            self.reads += 1
            empty = self.source.spark.createDataFrame([], schema)
            return empty.withColumns({"_begin": F.lit(0), "_end": F.lit(0)})
        columns = self.used.get(table) or [self.model.tables[table].primary]
        return self.source.rows(table, columns)

    def col(self, table: str, name: str) -> Column:
        u = self.used.setdefault(table, [])
        if name not in u:
            u.append(name)
        return F.col(f"`{name}`")

    def new(self, stem: str) -> str:
        self.names += 1
        return f"__{stem}{self.names}"

    def primary(self, table: str) -> Column:
        return self.col(table, self.model.tables[table].primary)

    def foreign(self, level: Level) -> Column:
        """Key of the parent; a node at any depth may have parents of several tables."""
        if level.deep:
            ups = [self.col(level.table, e.column) for e in self.model.parents(level.table)]
            return F.coalesce(*ups)
        e = next(e for e in self.model.edges if e.parent == level.edge.parent and e.child == level.table)
        return self.col(level.table, e.column)

    def document(self, table: str) -> Column:
        return self.col(table, "document_id")

    def order(self, table: str) -> Column:
        """Document order within a document or parent."""
        if self.source.ordered:
            return self.col(table, "_begin")
        return self.col(table, "serial_id") if self.model.tables[table].field("serial_id") else self.primary(table)

    # Node-sets -----------------------------------------------------------------------------------------------------

    def frame(self, levels: tuple[Level, ...]) -> DataFrame:
        """Rows of the last table that the chain leads to."""
        last = levels[-1]
        df = self.rows(last.table)
        above = levels[:-1]
        if last.deep:
            # All rows lie below the document element.
            if above and (len(above) > 1 or above[0].deep or above[0].conditions or above[0].table == last.table):
                df = self.inside(df, last.table, above)
        elif above:
            if any(x.conditions for x in above) or any(len(self.model.parents(x.table)) > 1 for x in above):
                k = self.new("k")
                up = self.frame(above).select(self.primary(above[-1].table).alias(k))
                df = df.join(up, self.foreign(last) == F.col(k), "inner" if self.bag else "left_semi")
                df = df.drop(k) if self.bag else df
            elif len(self.model.parents(last.table)) > 1:
                df = df.where(self.foreign(last).isNotNull())
        return self.restricted(df, levels)

    def places(self, table: str) -> tuple[Column, Column]:
        if not self.source.ordered:
            raise XPathError("a search at any depth of a recursive schema needs tables with document order")
        return self.col(table, "_begin"), self.col(table, "_end")

    def inside(self, df: DataFrame, table: str, above: tuple[Level, ...]) -> DataFrame:
        """Rows of df that lie somewhere below rows that the chain above leads to.

        Spans of nodes hold each other or are apart. So a row is below one of them if the furthest end of those that begin
        before it is not before its own end: one running maximum over each document, and no pairs.
        """
        begin, end = self.places(table)
        top = above[-1].table
        doc, pos, reach = self.new("d"), self.new("b"), self.new("e")
        spans = self.frame(above).select(self.document(top).alias(doc), self.places(top)[0].alias(pos), self.places(top)[1].alias(reach))
        mine = df.withColumns({doc: self.document(table), pos: begin})
        w = Window.partitionBy(doc).orderBy(pos).rangeBetween(Window.unboundedPreceding, -1)
        far = mine.unionByName(spans, allowMissingColumns=True).withColumn(reach + "m", F.max(reach).over(w))
        return far.where(F.col(reach).isNull() & (F.col(reach + "m") >= end)).drop(doc, pos, reach, reach + "m")

    def deeper(self, df: DataFrame, table: str, up: DataFrame, top: str, key: str) -> DataFrame:
        """Rows of df with the key in up of each row that they lie below."""
        begin, end = self.places(table)
        doc, b, e = self.new("d"), self.new("b"), self.new("e")
        spans = up.select(self.document(top).alias(doc), self.places(top)[0].alias(b), self.places(top)[1].alias(e), key)
        return df.join(spans, (self.document(table) == F.col(doc)) & (F.col(b) < begin) & (end <= F.col(e))).drop(doc, b, e)

    def restricted(self, df: DataFrame, levels: tuple[Level, ...]) -> DataFrame:
        for k, c in enumerate(levels[-1].conditions):
            df = self.condition(Context(df, levels, first=k == 0), c)
        return df

    def condition(self, ctx: Context, c) -> DataFrame:
        table = ctx.levels[-1].table
        if isinstance(c, Has):
            if not c.rest:
                return ctx.df.where(self.col(table, c.field.name).isNotNull())
            k = self.new("k")
            below = self.below(ctx.levels, c.rest, k).select(k)
            return ctx.df.join(below, self.primary(table) == F.col(k), "left_semi")
        if isinstance(c, Beside):
            if not self.source.ordered:
                raise XPathError("this axis needs tables with document order")
            k, v = self.new("k"), self.new("v")
            other = c.chain[-1]
            rows = self.restricted(self.rows(other.table), (*ctx.levels[:-1], other)) if c.siblings else self.frame(c.chain)
            key = self.foreign(other) if c.siblings else self.document(other.table)
            mine = self.foreign(ctx.levels[-1]) if c.siblings else self.document(table)
            if c.before:
                edge = rows.groupBy(key.alias(k)).agg(F.min(self.col(other.table, "_end")).alias(v))
                ok = F.col(v) < self.col(table, "_begin")
            else:
                edge = rows.groupBy(key.alias(k)).agg(F.max(self.col(other.table, "_begin")).alias(v))
                ok = F.col(v) > self.col(table, "_end")
            return ctx.df.join(edge, mine == F.col(k)).where(ok).drop(k, v)
        ast, ctx.step = c
        return self.predicate(ctx, ast)

    def below(self, levels: tuple[Level, ...], rest: tuple[Level, ...], key: str) -> DataFrame:
        """Rows of the last table of rest, with the key of their ancestor at the end of levels."""
        bare = tuple(replace(x, conditions=()) for x in levels)
        if not rest:
            return self.rows(levels[-1].table).withColumn(key, self.primary(levels[-1].table))
        df = self.restricted(self.rows(rest[0].table), (*bare, rest[0]))
        if not levels:
            df = df.withColumn(key, self.document(rest[0].table))
        elif rest[0].deep:
            top = levels[-1].table
            df = self.deeper(df, rest[0].table, self.rows(top).withColumn(key, self.primary(top)), top, key)
        else:
            df = df.withColumn(key, self.foreign(rest[0]))
        for k in range(1, len(rest)):
            if rest[k].deep:
                df = self.deeper(self.restricted(self.rows(rest[k].table), (*bare, *rest[: k + 1])), rest[k].table, df, rest[k - 1].table, key)
                continue
            p = self.new("p")
            up = df.select(self.primary(rest[k - 1].table).alias(p), key)
            df = self.restricted(self.rows(rest[k].table), (*bare, *rest[: k + 1])).join(up, self.foreign(rest[k]) == F.col(p)).drop(p)
        return df

    def is_local(self, ctx: Context, b: Bound) -> bool:
        return b.field is not None and self.common(ctx, b) == len(ctx.levels) == len(b.levels)

    @staticmethod
    def common(ctx: Context, b: Bound) -> int:
        """How many levels of b are the nodes that the context's row lies in."""
        k = 0
        while k < min(len(ctx.levels), len(b.levels)) and (ctx.levels[k].table, ctx.levels[k].name, ctx.levels[k].deep) == (b.levels[k].table, b.levels[k].name, b.levels[k].deep):
            if any(isinstance(c, Beside) and c not in ctx.levels[k].conditions for c in b.levels[k].conditions):
                break
            k += 1
        return k

    def aside(self, ctx: Context, b: Bound) -> tuple[int, Beside] | None:
        """The level of b that lies beside the context's own node, if one does."""
        for k, x in enumerate(b.levels):
            for c in x.conditions:
                if isinstance(c, Beside) and not (k < len(ctx.levels) and c in ctx.levels[k].conditions):
                    return k, c
        return None

    def one_beside(self, ctx: Context, n: Nodes) -> tuple[int, Beside] | None:
        """aside() of a single bound whose column has no conditions of its own."""
        return self.aside(ctx, n.bounds[0]) if len(n.bounds) == 1 and not n.absolute and not n.bounds[0].conditions and not self.bag else None

    def column(self, b: Bound) -> Column:
        """Value of a bound column: typed, or text of what lies in open content."""
        t = self.model.tables[b.table]
        if b.field is None:
            own = t.of_role(M.CONTENT)
            return self.col(b.table, own[0].name) if own else F.lit("")
        c = self.col(b.table, b.field.name)
        if b.inner:
            if b.field.role == M.ANY_ATTRIBUTE:
                return F.try_element_at(c, F.lit(b.inner)) if b.inner != "*" else F.array_join(F.map_values(c), " ")
            return F.when(c.isNotNull(), F.array_join(F.xpath(F.concat(F.lit("<x>"), c, F.lit("</x>")), F.lit(f"/x/{b.inner}/text()" if "@" not in b.inner and not b.inner.endswith("()") else f"/x/{b.inner}")), " "))
        return c

    def values(self, ctx: Context, nodes: Nodes) -> DataFrame:
        """(__key, __value, __order) of all nodes, by the key of the context's row. Values are text if there are several kinds."""
        out = []
        table = ctx.levels[-1].table
        for b in nodes.bounds:
            k = self.new("k")
            if nodes.absolute:
                rows = self.frame(b.levels).withColumn(k, self.document(b.table)) if b.levels else self.rows(self.model.root).withColumn(k, self.document(self.model.root))
                mine = self.document(table)
            elif (beside := self.aside(ctx, b)) is not None:
                out.append(self.beside_values(ctx, b, *beside))
                continue
            elif self.common(ctx, b) == len(ctx.levels):
                rows, mine = self.below(ctx.levels, b.levels[len(ctx.levels) :], k), None
            else:
                n = self.common(ctx, b)
                rows = self.below(b.levels[:n], b.levels[n:], k)
                mine = self.ancestor(ctx, n)
            # The place itself stays out of comparisons with null.
            b_ctx = Context(rows, b.levels, b.field)
            for c in b.conditions:
                b_ctx.df = self.condition(replace(b_ctx, first=False), c) if not isinstance(c, tuple) else self.field_condition(b_ctx, b, c)
            rows = b_ctx.df.select(F.col(k), self.column(b).alias("__value"), self.order(b.table).alias("__order"))
            if b.field is not None:
                rows = rows.where(F.col("__value").isNotNull())
            if mine is not None:
                own = ctx.df.select(self.primary(table).alias("__key"), mine.alias("__mine"))
                rows = own.join(rows, F.col("__mine") == F.col(k)).select("__key", "__value", "__order")
            else:
                rows = rows.withColumnRenamed(k, "__key")
            out.append(rows)
        if len({r.schema["__value"].dataType.simpleString() for r in out}) > 1:
            out = [r.withColumn("__value", F.col("__value").cast("string")) for r in out]
        all_ = out[0]
        for r in out[1:]:
            all_ = all_.unionByName(r)
        return all_

    def beside_rows(self, ctx: Context, b: Bound, at: int, c: Beside) -> tuple[DataFrame, tuple[str, str, str]]:
        """(k, x, y, __value, __order) of the nodes that b leads to: what they have in common with the context's row, and the
        span of the node beside it that they are at or below; and the names of the first three."""
        if not self.source.ordered:
            raise XPathError("this axis needs tables with document order")
        level = replace(b.levels[at], conditions=tuple(x for x in b.levels[at].conditions if x is not c))
        k, x, y = self.new("k"), self.new("x"), self.new("y")
        first = self.restricted(self.rows(level.table), (*b.levels[:at], level)) if c.siblings else self.frame((*b.levels[:at], level))
        key = self.foreign(level) if c.siblings else self.document(level.table)
        first = first.withColumns({k: key, x: self.col(level.table, "_begin"), y: self.col(level.table, "_end")})
        rows, here = first, level
        for nxt in b.levels[at + 1 :]:
            p = self.new("p")
            up = rows.select(self.primary(here.table).alias(p), k, x, y)
            rows = self.restricted(self.rows(nxt.table), (*b.levels[:at], level, nxt)).join(up, self.foreign(nxt) == F.col(p)).drop(p)
            here = nxt
        rows = rows.select(k, x, y, self.column(b).alias("__value"), self.order(b.table).alias("__order"))
        return (rows if b.field is None else rows.where(F.col("__value").isNotNull())), (k, x, y)

    def beside_own(self, ctx: Context, c: Beside) -> DataFrame:
        """(__key, __mine, __b, __e) of the context's rows: what beside_rows() shares with them, and their span."""
        table, own = ctx.levels[-1].table, ctx.levels[-1]
        return ctx.df.select(self.primary(table).alias("__key"), (self.foreign(own) if c.siblings else self.document(table)).alias("__mine"), self.col(table, "_begin").alias("__b"), self.col(table, "_end").alias("__e"))

    def beside_values(self, ctx: Context, b: Bound, at: int, c: Beside) -> DataFrame:
        """values() of nodes before or after the context's row."""
        rows, (k, x, y) = self.beside_rows(ctx, b, at, c)
        where = (F.col(x) > F.col("__e")) if c.before else (F.col(y) < F.col("__b"))
        return self.beside_own(ctx, c).join(rows, (F.col("__mine") == F.col(k)) & where).select("__key", "__value", "__order")

    def beside_keys(self, ctx: Context, b: Bound, at: int, c: Beside, ok: Column | None) -> DataFrame:
        """Keys of the context's rows that have a node before or after them whose __value is ok: the last one that begins, or
        the first that ends, tells it for all rows of a parent or document, so that no pairs are made."""
        rows, (k, x, y) = self.beside_rows(ctx, b, at, c)
        rows = rows if ok is None else rows.where(ok)
        edge = rows.groupBy(k).agg((F.max(x) if c.before else F.min(y)).alias("__edge"))
        where = (F.col("__edge") > F.col("__e")) if c.before else (F.col("__edge") < F.col("__b"))
        return self.beside_own(ctx, c).join(edge, (F.col("__mine") == F.col(k)) & where).select("__key")

    def field_condition(self, ctx: Context, b: Bound, c: tuple) -> DataFrame:
        inner = Context(ctx.df, b.levels, b.field, c[1])
        ok = self.boolean(inner, c[0]) if not self.is_position(c[0]) else self.constant_position(c[0])
        return inner.df.where(ok)

    def constant_position(self, ast) -> Column:
        """A column holds one node: its position and the last one are 1."""
        ok = isinstance(ast, Literal) and ast.value == 1.0 or isinstance(ast, Call) and ast.name == "last"
        return F.lit(bool(ok))

    def ancestor(self, ctx: Context, n: int) -> Column:
        """Key of the n-th table of the context's chain; joins tables between it and the context."""
        k = len(ctx.levels)
        if n == 0:
            return self.document(ctx.levels[-1].table)
        if n == k:
            return self.primary(ctx.levels[-1].table)
        at = self.foreign(ctx.levels[-1])
        for i in range(k - 2, n - 1, -1):
            p, q = self.new("p"), self.new("q")
            up = self.rows(ctx.levels[i].table).select(self.primary(ctx.levels[i].table).alias(p), self.foreign(ctx.levels[i]).alias(q))
            ctx.df = ctx.df.join(up, at == F.col(p), "left").drop(p)
            at = F.col(q)
        return at

    # Predicates ----------------------------------------------------------------------------------------------------

    def is_position(self, ast) -> bool:
        if isinstance(ast, Binary):
            return ast.op in ("+", "-", "*", "div", "mod") or (ast.op not in ("and", "or") and (self.is_position_call(ast.left) or self.is_position_call(ast.right)))
        if isinstance(ast, Variable):
            return isinstance(self.variables.get(ast.name), (int, float)) and not isinstance(self.variables.get(ast.name), bool)
        return isinstance(ast, Literal) and isinstance(ast.value, float) or isinstance(ast, Negate) or isinstance(ast, Call) and ast.name in ("last", "position", "number", "floor", "ceiling", "round", "count", "sum", "string-length")

    def is_position_call(self, ast) -> bool:
        if isinstance(ast, Binary):
            return self.is_position_call(ast.left) or self.is_position_call(ast.right)
        return isinstance(ast, Call) and ast.name in ("last", "position")

    def mentions_position(self, ast) -> bool:
        if isinstance(ast, Binary):
            return self.mentions_position(ast.left) or self.mentions_position(ast.right)
        if isinstance(ast, Call):
            return ast.name in ("last", "position") or any(self.mentions_position(a) for a in ast.args)
        return isinstance(ast, Negate) and self.mentions_position(ast.of)

    def predicate(self, ctx: Context, ast) -> DataFrame:
        if isinstance(ast, Binary) and ast.op == "and" and not self.mentions_position(ast):
            ctx.df = self.predicate(ctx, ast.left)
            return self.predicate(ctx, ast.right)
        number = self.is_position(ast) and not (isinstance(ast, Binary) and ast.op in FLIP)
        if number:
            ast = Binary("=", Call("position", []), ast)
        if self.mentions_position(ast):
            level = ctx.levels[-1]
            table = level.table
            simple = isinstance(ast, Binary) and ast.op == "=" and isinstance(ast.left, Call) and ast.left.name == "position" and isinstance(ast.right, Literal)
            if simple and ctx.first and ctx.step.axis == "child" and level.edge is not None:
                if self.model.tables[table].field("serial_id"):
                    return ctx.df.where(self.col(table, "serial_id") == F.lit(int(ast.right.value)) if ast.right.value == int(ast.right.value) else F.lit(False))
                if not level.edge.repeated:
                    return ctx.df.where(F.lit(ast.right.value == 1.0))
            back = ctx.step.axis in ("ancestor", "ancestor-or-self", "preceding", "preceding-sibling")
            by = self.foreign(level) if level.edge is not None and ctx.step.axis in ("child", "following-sibling", "preceding-sibling") else self.document(table)
            order = self.order(table)
            pos, last = self.new("pos"), self.new("last")
            w = Window.partitionBy(by)
            df = ctx.df.withColumn(pos, F.row_number().over(w.orderBy(order.desc() if back else order)).cast("double"))
            if "last" in repr(ast):
                df = df.withColumn(last, F.count("*").over(w).cast("double"))
            inner = Context(df, ctx.levels, ctx.field, ctx.step)
            ok = self.boolean(inner, ast, (pos, last))
            return inner.df.where(ok).drop(pos, last)
        negated = False
        probe = ast
        while isinstance(probe, Call) and probe.name == "not" and len(probe.args) == 1:
            probe, negated = probe.args[0], not negated
        keys = self.matching_keys(ctx, probe)
        if keys is not None:
            return ctx.df.join(keys, self.primary(ctx.levels[-1].table) == F.col("__key"), "left_anti" if negated else "inner" if self.bag else "left_semi").drop("__key")
        ok = self.boolean(ctx, ast)
        return ctx.df.where(ok)

    def matching_keys(self, ctx: Context, ast) -> DataFrame | None:
        """Keys of the context's rows for which nodes elsewhere satisfy ast, if ast is a question about such nodes alone."""
        if isinstance(ast, (Path, Union)):
            n = self.nodes(ctx, ast)
            if n is not None and n.bounds and not any(self.is_local(ctx, b) for b in n.bounds):
                if (beside := self.one_beside(ctx, n)) is not None:
                    return self.beside_keys(ctx, n.bounds[0], *beside, None)
                return self.values(ctx, n).select("__key")
            return None
        if isinstance(ast, Binary) and ast.op in FLIP:
            for a, b, op in ((ast.left, ast.right, ast.op), (ast.right, ast.left, FLIP[ast.op])):
                if isinstance(a, (Path, Union)) and isinstance(b, (Literal, Variable)):
                    n = self.nodes(ctx, a)
                    if n.bounds and not any(self.is_local(ctx, x) for x in n.bounds):
                        kind, c = self.value(ctx, b)
                        if (beside := self.one_beside(ctx, n)) is not None:
                            return self.beside_keys(ctx, n.bounds[0], *beside, self.compared(op, self.raw(n, F.col("__value")), (kind, c, self.constant(b))))
                        v = self.values(ctx, n)
                        return v.where(self.compared(op, self.raw(n, F.col("__value")), (kind, c, self.constant(b)))).select("__key")
        return None

    def nodes(self, ctx: Context | None, ast) -> Nodes | None:
        if isinstance(ast, Union):
            parts = [self.nodes(ctx, p) for p in ast.parts]
            if any(p is None for p in parts):
                raise XPathError("a union is of node-sets")
            return Nodes([b for p in parts for b in p.bounds], parts[0].absolute)
        if isinstance(ast, Path):
            if ast.start is not None:
                base = self.nodes(ctx, ast.start)
                if base is None:
                    raise XPathError("a path begins at a node-set")
                out = [x for b in base.bounds for x in self.binder.bind(replace(ast, start=None), b)]
                return Nodes(out, base.absolute)
            here = Bound(ctx.levels, ctx.field) if ctx is not None else None
            return Nodes(self.binder.bind(ast, here), ast.absolute and ctx is not None)
        return None

    # Values --------------------------------------------------------------------------------------------------------

    def raw(self, n: Nodes, c: Column) -> tuple:
        """Kind of a node-set's value: that of its columns if they agree."""
        own = [next(iter(self.model.tables[b.table].of_role(M.CONTENT)), None) if b.field is None and b.levels else b.field for b in n.bounds]
        kinds = {f.xs_type if f is not None and not b.inner and not f.is_list else "string" for b, f in zip(n.bounds, own)}
        return ("typed", c, kinds.pop() if len(kinds) == 1 else "string")

    @staticmethod
    def constant(ast):
        return ast.value if isinstance(ast, Literal) else None

    def boolean(self, ctx: Context, ast, position=None) -> Column:
        return F.coalesce(self.to_boolean(ctx, self.value(ctx, ast, position)), F.lit(False))

    def to_boolean(self, ctx: Context, v) -> Column:
        if isinstance(v, Nodes):
            return self.flag(ctx, v)
        kind, c = v[:2]
        if kind == "bool":
            return c
        if kind == "num":
            return X.boolean_of_number(c)
        return F.length(c) > 0

    def to_number(self, ctx: Context, v) -> Column:
        if isinstance(v, Nodes):
            v = self.single(ctx, v)
            if is_number(v[2]):
                return F.coalesce(v[1].cast("double"), F.lit(float("nan")))
            if v[2] == "boolean":
                return F.coalesce(v[1].cast("double"), F.lit(float("nan")))
            return F.coalesce(X.number_of_string(v[1].cast("string")), F.lit(float("nan")))
        kind, c = v[:2]
        return c if kind == "num" else X.number_of_boolean(c) if kind == "bool" else X.number_of_string(c)

    def to_string(self, ctx: Context, v) -> Column:
        if isinstance(v, Nodes):
            _, c, xs = self.single(ctx, v)
            return F.coalesce(c.cast("string"), F.lit(""))
        kind, c = v[:2]
        return c if kind == "str" else X.string_of_boolean(c) if kind == "bool" else X.string_of_number(c)

    def single(self, ctx: Context, n: Nodes) -> tuple:
        """First node in document order."""
        if not n.bounds:
            return ("typed", F.lit(None).cast("string"), "string")
        if len(n.bounds) == 1 and self.is_local(ctx, n.bounds[0]) and not n.bounds[0].conditions:
            return self.raw(n, self.column(n.bounds[0]))
        if all(b.field is None and len(b.levels) == len(ctx.levels) and self.common(ctx, b) == len(ctx.levels) for b in n.bounds):
            return self.raw(n, self.column(n.bounds[0]))
        v = self.new("v")
        first = self.values(ctx, n).groupBy("__key").agg(F.min_by("__value", "__order").alias(v)).withColumnRenamed("__key", v + "k")
        ctx.df = ctx.df.join(first, self.primary(ctx.levels[-1].table) == F.col(v + "k"), "left").drop(v + "k")
        return self.raw(n, F.col(v))

    def flag(self, ctx: Context, n: Nodes, keys: DataFrame | None = None) -> Column:
        """Whether there is any node (or any of keys)."""
        if keys is None:
            if not n.bounds:
                return F.lit(False)
            local = [b for b in n.bounds if self.is_local(ctx, b) and not b.conditions]
            own = [b for b in n.bounds if b.field is None and len(b.levels) <= len(ctx.levels) and self.common(ctx, b) == len(b.levels) and not n.absolute]
            rest = [b for b in n.bounds if b not in local and b not in own]
            out = F.lit(bool(own))
            for b in local:
                out = out | self.column(b).isNotNull()
            if rest:
                out = out | self.flag(ctx, n, self.values(ctx, Nodes(rest, n.absolute)).select("__key"))
            return out
        f = self.new("f")
        ctx.df = ctx.df.join(keys.select(F.col("__key").alias(f)).distinct(), self.primary(ctx.levels[-1].table) == F.col(f), "left")
        return F.col(f).isNotNull()

    def compared(self, op: str, a: tuple, b: tuple) -> Column:
        """Comparison of two values; a is of a node-set ('typed') or not, and b may carry its constant."""
        if b[0] == "typed" and a[0] != "typed":
            return self.compared(FLIP[op], b, a)
        do = {"=": lambda x, y: x == y, "!=": lambda x, y: x != y, "<": lambda x, y: x < y, ">": lambda x, y: x > y, "<=": lambda x, y: x <= y, ">=": lambda x, y: x >= y}[op]
        if a[0] == "typed":
            xs = a[2]
            if b[0] == "typed":
                if is_number(xs) and is_number(b[2]):
                    return do(a[1], b[1])
                if xs == b[2]:
                    return do(a[1], b[1])
                return do(a[1].cast("string"), b[1].cast("string")) if op in ("=", "!=") else do(X.number_of_string(a[1].cast("string")), X.number_of_string(b[1].cast("string")))
            kind, c = b[:2]
            known = b[2] if len(b) > 2 else None
            if kind == "bool":
                return do(a[1].isNotNull(), c)
            if is_number(xs):
                if kind == "str" and known is not None:
                    try:
                        c = F.lit(float(known))
                    except ValueError:
                        raise XPathError(f"{known!r} is no {xs}") from None
                elif kind == "str":
                    c = X.number_of_string(c)
                # A whole constant against a whole number stays one, so that the scan can use it.
                if known is not None and float(known) == int(float(known)) and abs(float(known)) < 1 << 53:
                    c = F.lit(int(float(known)))
                return do(a[1], c)
            if kind == "num":
                return do(X.number_of_string(a[1].cast("string")), c)
            if xs == "boolean":
                if known is not None and known not in ("true", "false", "1", "0"):
                    raise XPathError(f"{known!r} is no boolean")
                return do(a[1], parsed(c, "boolean"))
            if xs in ("date", "dateTime", "dateTimeStamp", "gYear", "gYearMonth"):
                return do(a[1], parsed(c, xs))
            return do(a[1].cast("string"), c) if op in ("=", "!=") else do(X.number_of_string(a[1].cast("string")), X.number_of_string(c))
        if a[0] == "bool" or b[0] == "bool":
            x, y = self.to_boolean(None, a), self.to_boolean(None, b)
            return do(x, y) if op in ("=", "!=") else do(X.number_of_boolean(x), X.number_of_boolean(y))
        if op not in ("=", "!=") or a[0] == "num" or b[0] == "num":
            return do(self.to_number(None, a), self.to_number(None, b))
        return do(a[1], b[1])

    def comparison(self, ctx: Context, ast: Binary, position) -> tuple:
        a, b = self.value(ctx, ast.left, position), self.value(ctx, ast.right, position)
        op = ast.op
        if isinstance(b, Nodes) and not isinstance(a, Nodes):
            a, b, op = b, a, FLIP[op]
            left, right = ast.right, ast.left
        else:
            left, right = ast.left, ast.right
        if not isinstance(a, Nodes):
            return ("bool", self.compared(op, a, b))
        if not a.bounds or isinstance(b, Nodes) and not b.bounds:
            return ("bool", F.lit(False))
        if not isinstance(b, Nodes):
            if b[0] == "bool":
                return ("bool", self.compared(op, ("bool", self.flag(ctx, a)), b))
            if len(a.bounds) == 1 and (self.is_local(ctx, a.bounds[0]) and not a.bounds[0].conditions or a.bounds[0].field is None and len(a.bounds[0].levels) == len(ctx.levels)):
                return ("bool", self.compared(op, self.raw(a, self.column(a.bounds[0])), (*b[:2], self.constant(right))))
            v = self.values(ctx, a)
            if self.constant(right) is None and not isinstance(right, Variable):
                own = ctx.df.select(self.primary(ctx.levels[-1].table).alias("__own"), b[1].alias("__other"))
                v = v.join(own, F.col("__own") == F.col("__key"))
                b = (b[0], F.col("__other"))
            keys = v.where(self.compared(op, self.raw(a, F.col("__value")), (*b[:2], self.constant(right)))).select("__key")
            return ("bool", self.flag(ctx, a, keys))
        local = lambda n: len(n.bounds) == 1 and self.is_local(ctx, n.bounds[0]) and not n.bounds[0].conditions
        if local(a) and local(b):
            return ("bool", self.compared(op, self.raw(a, self.column(a.bounds[0])), self.raw(b, self.column(b.bounds[0]))))
        x = self.values(ctx, a).select("__key", F.col("__value").alias("__x"))
        y = self.values(ctx, b).select(F.col("__key").alias("__key2"), F.col("__value").alias("__y"))
        both = x.join(y, F.col("__key") == F.col("__key2")).where(self.compared(op, self.raw(a, F.col("__x")), self.raw(b, F.col("__y"))))
        return ("bool", self.flag(ctx, a, both.select("__key")))

    def value(self, ctx: Context, ast, position=None):
        if isinstance(ast, Literal):
            return ("num", F.lit(ast.value)) if isinstance(ast.value, float) else ("str", F.lit(ast.value))
        if isinstance(ast, Variable):
            if ast.name not in self.variables:
                raise XPathError(f"variable ${ast.name} has no value")
            v = self.variables[ast.name]
            return ("bool", F.lit(v)) if isinstance(v, bool) else ("num", F.lit(float(v))) if isinstance(v, (int, float)) else ("str", F.lit(str(v)))
        if isinstance(ast, (Path, Union)):
            if ctx is None:
                raise XPathError("a path needs a context here")
            return self.nodes(ctx, ast)
        if isinstance(ast, Negate):
            return ("num", -self.to_number(ctx, self.value(ctx, ast.of, position)))
        if isinstance(ast, Binary):
            if ast.op in ("and", "or"):
                a, b = self.boolean(ctx, ast.left, position), self.boolean(ctx, ast.right, position)
                return ("bool", a & b if ast.op == "and" else a | b)
            if ast.op in FLIP:
                return self.comparison(ctx, ast, position)
            a, b = self.to_number(ctx, self.value(ctx, ast.left, position)), self.to_number(ctx, self.value(ctx, ast.right, position))
            return ("num", {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "div": lambda: X.divide(a, b), "mod": lambda: X.modulo(a, b)}[ast.op]())
        return self.call(ctx, ast, position)

    def call(self, ctx: Context, ast: Call, position):
        name, args = ast.name, ast.args
        arity = {
            "last": (0, 0), "position": (0, 0), "count": (1, 1), "id": (1, 1), "local-name": (0, 1), "namespace-uri": (0, 1), "name": (0, 1), "string": (0, 1), "concat": (2, 99), "starts-with": (2, 2), "contains": (2, 2), "substring-before": (2, 2),
            "substring-after": (2, 2), "substring": (2, 3), "string-length": (0, 1), "normalize-space": (0, 1), "translate": (3, 3), "boolean": (1, 1), "not": (1, 1), "true": (0, 0), "false": (0, 0), "lang": (1, 1), "number": (0, 1), "sum": (1, 1), "floor": (1, 1), "ceiling": (1, 1), "round": (1, 1),
        }.get(name)
        if arity is None:
            raise XPathError(f"unknown function {name}()")
        if not arity[0] <= len(args) <= arity[1]:
            raise XPathError(f"{name}() takes {arity[0]} to {arity[1]} arguments")
        if self.strict and name in ("count", "sum", "id"):
            raise XPathError(f"{name}() cannot be in a predicate; use it around a whole path")
        here = Path(False, [])
        val = lambda k: self.value(ctx, args[k] if k < len(args) else here, position)
        text = lambda k: self.to_string(ctx, val(k))
        num = lambda k: self.to_number(ctx, val(k))
        if name in ("last", "position"):
            if position is None:
                raise XPathError(f"{name}() has no context here")
            return ("num", F.col(position[name == "last"]))
        if name in ("count", "sum"):
            n = self.nodes(ctx, args[0])
            if n is None:
                raise XPathError(f"{name}() takes a node-set")
            if not n.bounds:
                return ("num", F.lit(0.0))
            v = self.new("v")
            values = self.values(ctx, n)
            what = F.count("*").cast("double") if name == "count" else F.sum(F.col("__value").try_cast("double"))
            agg = values.groupBy(F.col("__key").alias(v + "k")).agg(what.alias(v))
            ctx.df = ctx.df.join(agg, self.primary(ctx.levels[-1].table) == F.col(v + "k"), "left").drop(v + "k")
            return ("num", F.coalesce(F.col(v), F.lit(0.0)))
        if name == "id":
            raise XPathError("id() is not supported; compare the attribute")
        if name in ("local-name", "namespace-uri", "name"):
            n = val(0)
            if not isinstance(n, Nodes):
                raise XPathError(f"{name}() takes a node-set")
            return ("str", F.lit(self.named(name, n)))
        if name == "string":
            return ("str", text(0))
        if name == "concat":
            return ("str", F.concat_ws("", *[text(k) for k in range(len(args))]))
        if name == "starts-with":
            return ("bool", X.starts_with(text(0), text(1)))
        if name == "contains":
            return ("bool", X.contains(text(0), text(1)))
        if name == "substring-before":
            return ("str", X.substring_before(text(0), text(1)))
        if name == "substring-after":
            return ("str", X.substring_after(text(0), text(1)))
        if name == "substring":
            return ("str", X.substring(text(0), num(1), num(2) if len(args) > 2 else None))
        if name == "string-length":
            return ("num", F.length(text(0)).cast("double"))
        if name == "normalize-space":
            return ("str", X.normalize_space(text(0)))
        if name == "translate":
            return ("str", F.translate(text(0), *[self.literal_text(a) for a in args[1:]]))
        if name == "boolean":
            return ("bool", self.to_boolean(ctx, val(0)))
        if name == "not":
            return ("bool", ~self.boolean(ctx, args[0], position))
        if name in ("true", "false"):
            return ("bool", F.lit(name == "true"))
        if name == "lang":
            t = self.model.tables[ctx.levels[-1].table]
            f = t.field("lang")
            if f is None:
                raise XPathError(f"{t.name} has no xml:lang")
            c = F.lower(self.col(t.name, "lang"))
            want = F.lower(text(0))
            return ("bool", (c == want) | F.startswith(c, F.concat(want, F.lit("-"))))
        if name == "number":
            return ("num", num(0))
        return ("num", {"floor": X.floor, "ceiling": X.ceiling, "round": X.half_up}[name](num(0)))

    def literal_text(self, ast) -> str:
        if isinstance(ast, Variable) and ast.name in self.variables:
            return str(self.variables[ast.name])
        if not isinstance(ast, Literal):
            raise XPathError("translate() takes constants")
        return str(ast.value)

    def named(self, name: str, n: Nodes) -> str:
        if not n.bounds:
            return ""
        b = n.bounds[0]
        local = b.field.xml_name if b.field is not None else b.levels[-1].name if b.levels else ""
        uri = self.model.tables[b.table].namespace if b.levels and (b.field is None or b.field.role != M.ATTRIBUTE) else ""
        if name == "local-name":
            return local
        if name == "namespace-uri":
            return uri
        prefix = next((p for p, u in self.model.prefixes.items() if u == uri and p), "")
        return f"{prefix}:{local}" if prefix and uri else local

    # Whole expressions ---------------------------------------------------------------------------------------------

    def selected(self, b: Bound, keys: bool) -> DataFrame:
        if not b.levels:
            b = Bound((Level(self.model.root, None, self.model.tables[self.model.root].xml_name),))
        t = self.model.tables[b.table]
        df = self.frame(b.levels)
        ctx = Context(df, b.levels, b.field)
        for c in b.conditions:
            ctx.df = self.field_condition(ctx, b, c) if isinstance(c, tuple) else self.condition(ctx, c)
        front = [self.document(t.name), self.primary(t.name)] if keys else []
        if b.field is None:
            names = ["document_id", t.primary] if self.bare else [f.name for f in t.fields]
            return ctx.df.select(*[self.col(t.name, n) for n in names])
        c = self.column(b)
        name = b.field.name if not b.inner else b.inner.rpartition("/")[2].lstrip("@") or b.field.name
        return ctx.df.select(*front, (c.cast("string") if b.text else c).alias(name)).where(F.col(f"`{name}`").isNotNull())

    @staticmethod
    def overlapping(bounds: list[Bound]) -> list[list[Bound]]:
        """Bounds that may lead to the same nodes go together: those of one column where a node is met at any depth."""
        groups: dict[tuple, list[Bound]] = {}
        for k, b in enumerate(bounds):
            deep = any(x.deep for y in bounds for x in y.levels if y.levels and b.levels and y.table == b.table)
            own = (b.table, b.field.name if b.field else None, b.text, b.inner) if deep else k
            groups.setdefault(own, []).append(b)
        return list(groups.values())

    def once(self, group: list[Bound], keys: bool) -> DataFrame:
        """Nodes of several bounds, each once."""
        if len(group) == 1:
            return self.selected(group[0], keys)
        table = self.model.tables[group[0].table]
        out = None
        for b in group:
            part = self.selected(b, True)
            out = part if out is None else out.unionAll(part)
        out = out.dropDuplicates(["document_id", table.primary])
        return out if keys or group[0].field is None else out.drop("document_id", table.primary)

    def plan(self, ast, keys: bool = False) -> DataFrame:
        if isinstance(ast, (Path, Union)):
            bounds = self.nodes(None, ast).bounds
            unique: dict[tuple, Bound] = {}
            for b in bounds:
                unique.setdefault((tuple(x.plain() for x in b.levels), b.field.name if b.field else None, b.text, b.inner, tuple(map(id, b.conditions))), b)
            bounds = list(unique.values())
            if len(bounds) == 1:
                return self.selected(bounds[0], keys)
            groups = self.overlapping(bounds)
            if len(groups) == 1:
                return self.once(groups[0], keys)
            # Several paths: values side by side under the name of the path that gave them.
            parts, fits = [], []
            for group in groups:
                b = group[0]
                try:
                    parts.append(self.once(group, keys))
                    fits.append(b)
                except XPathError as e:
                    # A constant that is none of this column's type: among several columns it just does not match.
                    if " is no " not in str(e):
                        raise
            if not parts:
                raise XPathError("no column's type fits the constants")
            bounds = fits
            if all(b.field is not None for b in bounds):
                parts = [p.select(F.lit(b.path).alias("path"), *p.columns[:-1], F.col(f"`{p.columns[-1]}`").cast("string").alias("value")) for b, p in zip(bounds, parts)]
            else:
                parts = [p.select(F.lit(b.path).alias("path"), *[f"`{c}`" for c in p.columns]) for b, p in zip(bounds, parts)]
            out = parts[0]
            for p in parts[1:]:
                out = out.unionByName(p, allowMissingColumns=True)
            return out
        if isinstance(ast, Call) and ast.name in ("count", "sum") and len(ast.args) == 1 and isinstance(ast.args[0], (Path, Union)):
            parts = []
            for group in self.overlapping(self.nodes(None, ast.args[0]).bounds):
                one = None
                for b in group:
                    df = self.frame(b.levels)
                    what = self.column(b) if b.field is not None else self.primary(b.table)
                    part = df.select(self.document(b.table).alias("document_id"), (what.cast("string") if ast.name == "count" else what).alias("v"), *([self.primary(b.table).alias("k")] if len(group) > 1 else []))
                    one = part if one is None else one.unionAll(part)
                parts.append(one.dropDuplicates(["document_id", "k"]).drop("k") if len(group) > 1 else one)
            all_ = parts[0]
            for p in parts[1:]:
                all_ = all_.unionAll(p)
            out = all_.groupBy("document_id").agg((F.count("v") if ast.name == "count" else F.sum("v")).alias(ast.name))
            return out if keys else out.select(ast.name)
        if isinstance(ast, Call) and ast.name in ("local-name", "namespace-uri", "name") and ast.args:
            n = self.nodes(None, ast.args[0])
            return self.source.spark.range(1).select(F.lit(self.named(ast.name, n)).alias(ast.name))
        if not self.has_path(ast):
            kind, c = self.value(None, ast)[:2]
            return self.source.spark.range(1).select(c.alias("value"))
        # A value for each document.
        root = self.model.root
        ctx = Context(self.rows(root), (Level(root, None, self.model.tables[root].xml_name),))
        v = self.value(ctx, ast)
        c = self.to_string(ctx, v) if isinstance(v, Nodes) else v[1]
        return ctx.df.select(self.document(root), c.alias("value"))

    def has_path(self, ast) -> bool:
        if isinstance(ast, (Path, Union)):
            return True
        if isinstance(ast, Binary):
            return self.has_path(ast.left) or self.has_path(ast.right)
        if isinstance(ast, Negate):
            return self.has_path(ast.of)
        return isinstance(ast, Call) and (any(self.has_path(a) for a in ast.args) or not ast.args and ast.name not in ("true", "false"))

    def run(self, expression: str, keys: bool = False, bare: bool = False) -> DataFrame:
        """bare: of nodes that are rows of tables only their keys, as for a question whether there are any."""
        ast = parse(expression)
        self.used, self.dry, self.reads, self.bare = {}, True, 0, bare
        try:
            self.plan(ast, keys)
        finally:
            self.dry = False
        self.names = 0
        given = self.source
        if isinstance(given, Documents) and self.reads > 1:
            self.source = given.once(self.used)
        try:
            return self.plan(ast, keys)
        finally:
            self.source = given
