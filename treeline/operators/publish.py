"""Publishing: rows of shredded tables back to XML and JSON.

The rows of all tables are brought together by document, once, each already rendered but for its children, and are nested
there from the deepest up. So recursive schemas are published to any depth, tables that only hold others cost nothing of
their own, and no level needs a join. Children come in the order of the schema; those of a repeated group, and siblings,
in document order as far as the rows have it. A document is one value, so that documents must fit in a task; corpora need
not. From documents, XML has values as they were written; from typed tables as XML Schema writes them, times of a zone
as the same moment in UTC.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from treeline.functions.text import xml_escape
from treeline.schema import model as M


_JSON_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\],:]|[^\s{}\[\],:"]+')
#: Beginnings of Spark types whose texts have nothing to escape.
PLAIN = ("smallint", "int", "bigint", "decimal", "float", "double", "boolean", "timestamp", "date")
_XML_TOKEN = re.compile(r"<!\[CDATA\[.*?\]\]>|<!--.*?-->|<[^>]+>|[^<]+", re.S)


@dataclass
class XmlStyle:
    declaration: bool = False
    namespace: bool = True
    schema_location: str = ""
    nil: bool = True
    keep_empty: bool = False
    indent: int = 0
    linefeed: str = "\n"
    fragments: bool = True  # subtrees below the document element are allowed


@dataclass
class JsonStyle:
    attribute_prefix: str = "@"
    content_name: str = "$"
    arrays_always: bool = False
    document_id: bool = False
    nulls: bool = False
    indent: int = 0
    key_space: str = " "  # after the colon, if indented
    linefeed: str = "\n"


def lexical(c: Column, f: M.Field) -> Column:
    """Text of a typed value as XML Schema writes it."""
    if f.xs_type == "dateTime" and not f.is_list:
        return F.replace(c.cast("string"), F.lit(" "), F.lit("T"))
    if f.xs_type == "dateTimeStamp" and not f.is_list:
        return F.concat(F.replace(F.to_utc_timestamp(c, F.current_timezone()).cast("string"), F.lit(" "), F.lit("T")), F.lit("Z"))
    if f.xs_type == "decimal" and "fractionDigits" not in f.facets and not f.is_list:
        return F.regexp_replace(c.cast("string"), r"(?:\.0+|(\.\d*[1-9])0+)$", "$1")
    if f.xs_type == "hexBinary":
        return F.hex(c)
    if f.xs_type == "base64Binary":
        return F.base64(c)
    if f.xs_type == "gYear":
        return F.date_format(c, "yyyy")
    if f.xs_type == "gYearMonth":
        return F.date_format(c, "yyyy-MM")
    return c.cast("string")


def json_value(c: Column, kind: T.DataType) -> Column:
    """JSON of a value as to_json writes it, or null; what has one plain form is written without it."""
    whole = F.to_json(F.struct(c.alias("v")), {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss"})
    slow = F.when(c.isNotNull(), F.substr(whole, F.lit(6), F.length(whole) - 6))
    if isinstance(kind, (T.ShortType, T.IntegerType, T.LongType, T.BooleanType)) or isinstance(kind, T.DecimalType) and kind.scale <= 6:
        return c.cast("string")
    if isinstance(kind, T.StringType):
        return F.when(c.rlike(r'["\\\x00-\x1f]'), slow).otherwise(F.concat(F.lit('"'), c, F.lit('"')))
    if isinstance(kind, T.TimestampNTZType):
        # Without parts of seconds and with a year of four digits.
        text = F.substring_index(c.cast("string"), ".", 1)
        return F.when((F.length(text) == 19) & ~F.startswith(text, F.lit("-")), F.concat(F.lit('"'), F.replace(text, F.lit(" "), F.lit("T")), F.lit('"'))).otherwise(slow)
    return slow


def laid_out(text: str, indent: int, key_space: str, linefeed: str) -> str:
    """JSON text with line breaks and indentation; values stay as they are written."""
    out, depth = [], 0
    for m in _JSON_TOKEN.finditer(text):
        x = m.group()
        if x in "{[":
            close = text[m.end() : m.end() + 1] in ("}", "]")
            depth += 0 if close else 1
            out.append(x if close else x + linefeed + " " * (indent * depth))
        elif x in "}]":
            empty = out[-1][-1:] in "{["
            depth -= 0 if empty else 1
            out.append(x if empty else linefeed + " " * (indent * depth) + x)
        else:
            out.append("," + linefeed + " " * (indent * depth) if x == "," else ":" + key_space if x == ":" else x)
    return "".join(out)


def indented(xml: str, indent: int, linefeed: str) -> str:
    """XML text with each element on its own line, but for what lies in elements with text."""
    tokens = _XML_TOKEN.findall(xml)
    inline, stack = set(), []
    for k, x in enumerate(tokens):
        if x.startswith("</"):
            stack.pop()
        elif x.startswith("<") and x[1:2] not in "!?":
            if not x.endswith("/>"):
                stack.append(k)
        elif not x.startswith("<") and x.strip() and stack:
            inline.add(stack[-1])
    out, stack, quiet = [], [], 0
    for k, x in enumerate(tokens):
        closes = x.startswith("</")
        if closes:
            top, children = stack.pop()
            line = children and not quiet
            quiet -= top in inline
        else:
            line = k > 0 and not quiet and x.startswith("<")
            if stack:
                stack[-1][1] = True
        if line and (out or closes):
            out.append(linefeed + " " * (indent * len(stack)))
        out.append(x)
        if x.startswith("<") and not closes and not x.endswith("/>") and x[1:2] not in "!?":
            stack.append([k, False])
            quiet += k in inline
    return "".join(out)


def _needed(model: M.SchemaModel, table: str) -> list[str]:
    t = model.tables[table]
    return list(dict.fromkeys([f.name for f in t.content] + ["document_id", t.primary] + [e.column for e in model.parents(table)] + (["serial_id"] if t.field("serial_id") else [])))


def _order(model: M.SchemaModel, table: str) -> Column:
    return F.col("serial_id") if model.tables[table].field("serial_id") else F.col(model.tables[table].primary)


def _together(engine, table: str, rendered, text: bool) -> tuple[DataFrame, list[str]]:
    """(document_id, nodes): all rows at and below a table, as structs (t, id, up, o, own) of the table's number, the keys of
    the row and its parent, its place among siblings and what `rendered` makes of it; and the tables by number."""
    model = engine.model
    names = model.reachable(table)
    rows, is_text = engine.tables({n: _needed(model, n) for n in names}, text=text, order=True)
    out = None
    for k, n in enumerate(names):
        df = rows[n]
        ups = [F.col(e.column) for e in model.parents(n)]
        order = F.col("_begin") if "_begin" in df.columns else F.col("serial_id") if model.tables[n].field("serial_id") else F.lit(0)
        # Nothing refers to a row that has none below it, but for those that are published.
        own = F.col(model.tables[n].primary) if k == 0 or model.children(n) else F.lit(None).cast(model.options.key_type)
        node = F.struct(F.lit(k).alias("t"), own.alias("id"), (F.coalesce(*ups) if ups else F.lit(None).cast(model.options.key_type)).alias("up"), order.cast("int").alias("o"), rendered(model.tables[n], is_text).alias("own"))
        part = df.select("document_id", node.alias("node"))
        out = part if out is None else out.unionAll(part)
    return out.groupBy("document_id").agg(F.collect_list("node").alias("nodes")), names


def _list(a: pa.Array) -> list:
    """to_pylist() without a scalar of Arrow for each whole number, text or list of texts."""
    if pa.types.is_list(a.type) and pa.types.is_string(a.type.value_type) and not a.null_count:
        ends = a.offsets.to_numpy()
        cells = _list(a.values.slice(ends[0], ends[-1] - ends[0])) if len(a) else []
        ends = (ends - ends[0]).tolist() if len(a) else []
        return [cells[x:y] for x, y in zip(ends, ends[1:])]
    if a.null_count == len(a):
        return [None] * len(a)
    if pa.types.is_string(a.type) or pa.types.is_integer(a.type) and not a.null_count:
        return a.to_numpy(zero_copy_only=False).tolist()
    if pa.types.is_integer(a.type):
        out = a.fill_null(0).to_numpy().tolist()
        for k in np.flatnonzero(a.is_null().to_numpy(zero_copy_only=False)).tolist():
            out[k] = None
        return out
    return a.to_pylist()


def _nested(model: M.SchemaModel, names: list[str], made, top, read=_list) -> object:
    """Arrow UDF from nodes to (key, value) of the first table's rows. made: row's table, own part and children's (edge, value)
    lists to the row's value; top: that value to text; read: array of own parts to their list."""
    edges = {(e.parent, e.child): (e.place, k, e) for k, e in enumerate(model.edges)}
    place = {(a, b): edges.get((names[a], names[b])) for a in range(len(names)) for b in range(len(names))}
    key = T._parse_datatype_string(model.options.key_type)
    arrow = pa.list_(pa.struct([("key", to_arrow_type(key)), ("value", pa.string())]))

    @F.arrow_udf(T.ArrayType(T.StructType([T.StructField("key", key), T.StructField("value", T.StringType())])))
    def of(column: pa.Array) -> pa.Array:
        out = []
        ends = column.offsets.to_numpy()
        v = column.values.slice(ends[0], ends[-1] - ends[0])
        cells = [*(_list(v.field(k)) for k in range(4)), read(v.field(4))]
        ends = (ends - ends[0]).tolist()
        for x, y in zip(ends, ends[1:]):
            t, id_, up, o, own = (c[x:y] for c in cells)
            at = {x: k for k, x in enumerate(id_) if x is not None}
            below: dict[int, list[int]] = {}
            roots = []
            for k, x in enumerate(up):
                if x in at:
                    below.setdefault(at[x], []).append(k)
                else:
                    roots.append(k)
            # Parents before children; values are made from the end.
            order = list(roots)
            for k in order:
                order += below.get(k, ())
            value: dict[int, object] = {}
            found = []
            for k in reversed(order):
                if k not in below:
                    value[k] = made(t[k], own[k], ())
                    if t[k] == 0:
                        found.append({"key": id_[k], "value": top(value[k])})
                    continue
                kids, up_t = below[k], t[k]
                kinds = {t[c] for c in kids}
                # Siblings of one table only have their order to go by.
                kids.sort(key=o.__getitem__ if len(kinds) == 1 else lambda c: (place[up_t, t[c]][0], o[c], place[up_t, t[c]][1], t[c]))
                edge = {c: place[up_t, c][2] for c in kinds}
                value[k] = made(up_t, own[k], [(edge[t[c]], t[c], value.pop(c) if t[c] else value[c]) for c in kids])
                if t[k] == 0:
                    found.append({"key": id_[k], "value": top(value[k])})
            out.append(found[::-1])
        return pa.array(out, arrow)

    return of


def _published(engine, table: str, subset: DataFrame | None, nodes: DataFrame, nest) -> DataFrame:
    out = nodes.select("document_id", F.explode(nest(F.col("nodes"))).alias("x")).select("document_id", "x.key", "x.value")
    if subset is not None:
        out = out.join(subset.select(F.col(subset.columns[0]).alias("__want")).distinct(), F.col("key") == F.col("__want"), "left_semi")
    return out


def to_xml(engine, table: str | None = None, subset: DataFrame | None = None, style: XmlStyle | None = None) -> DataFrame:
    """(document_id, key, xml) of the subtrees at a table's rows. subset: keys of the rows wanted, in its first column."""
    model, style = engine.model, style or XmlStyle()
    table = table or model.root
    if not style.fragments and table != model.root:
        raise ValueError(f"{table} is not the document element, and fragments are not allowed")

    def rendered(t: M.Table, is_text: bool) -> Column:
        """Attributes, and the elements and text of the row itself: by their place in the content, or at once if no rows can lie
        between them."""
        attributes, body = [F.lit("")], []
        written = (lambda c, f: xml_escape(c)) if is_text else (lambda c, f: lexical(c, f) if f.type(model.options).startswith(PLAIN) else xml_escape(lexical(c, f)))
        for f in t.fields:
            c = F.col(f"`{f.name}`")
            if f.role == M.ATTRIBUTE:
                attributes.append(F.when(c.isNotNull(), F.concat(F.lit(f' {f.xml_name}="'), written(c, f), F.lit('"'))).otherwise(""))
            elif f.role == M.ANY_ATTRIBUTE:
                pairs = F.array_sort(F.map_entries(c))
                attributes.append(F.coalesce(F.array_join(F.transform(pairs, lambda p: F.concat(F.lit(" "), p["key"], F.lit('="'), xml_escape(p["value"]), F.lit('"'))), ""), F.lit("")))
            elif f.role == M.CONTENT:
                body.append((-1, written(c, f)))
            elif f.role == M.ELEMENT:
                inline = [F.when(F.col(f"`{g.name}`").isNotNull(), F.concat(F.lit(f' {g.xml_name.partition("/@")[2]}="'), written(F.col(f"`{g.name}`"), g), F.lit('"'))).otherwise("") for g in t.of_role(M.INLINE) if g.xml_name.partition("/@")[0] == f.xml_name]
                empty = F.lit(f'<{f.xml_name} xsi:nil="true"/>' if f.nillable and style.nil else f"<{f.xml_name}/>" if style.keep_empty else None)
                body.append((f.place, F.when(c.isNotNull(), F.concat(F.lit(f"<{f.xml_name}"), *inline, F.lit(">"), written(c, f), F.lit(f"</{f.xml_name}>"))).otherwise(empty)))
            elif f.role == M.ANY:
                body.append((f.place, c))
        body.sort(key=lambda x: x[0])
        if not model.children(t.name):
            text = F.concat(F.lit(""), *[F.coalesce(x.cast("string"), F.lit("")) for _, x in body])
            return F.struct(F.concat(*attributes).alias("attributes"), text.alias("text"), F.lit(None).cast("array<struct<place:int,text:string>>").alias("parts"))
        parts = F.array(*[F.struct(F.lit(k).alias("place"), x.cast("string").alias("text")) for k, x in body]) if body else F.array().cast("array<struct<place:int,text:string>>")
        return F.struct(F.concat(*attributes).alias("attributes"), F.lit(None).cast("string").alias("text"), F.filter(parts, lambda x: x["text"].isNotNull()).alias("parts"))

    nodes, names = _together(engine, table, rendered, True)
    tags = [model.tables[n].xml_name for n in names]
    head = f' xmlns="{model.namespace}"' if style.namespace and model.namespace else ""
    if style.schema_location or style.nil and any(f.nillable for x in model.tables.values() for f in x.fields):
        head += ' xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance"'
        if style.schema_location:
            head += f' xsi:schemaLocation="{model.namespace} {style.schema_location}"'
    begin = '<?xml version="1.0" encoding="UTF-8"?>\n' if style.declaration else ""

    def read(own: pa.Array) -> list[tuple]:
        return list(zip(_list(own.field(0)), _list(own.field(1)), _list(own.field(2))))

    def made(t: int, own: tuple, kids) -> tuple[str, str]:
        """What precedes and what follows the place of namespace declarations."""
        attributes, inside, parts = own
        if inside is None:
            if parts:
                parts = [(p["place"], p["text"]) for p in parts]
                inside = "".join([x for _, x in sorted(parts + [(e.place, "".join(v)) for e, _, v in kids], key=lambda x: x[0])])
            else:
                # Children come by their places already.
                inside = "".join([x for _, _, v in kids for x in v])
        return f"<{tags[t]}", attributes + (f">{inside}</{tags[t]}>" if inside else "/>")

    def top(v: tuple[str, str]) -> str:
        text = f"{v[0]}{head}{v[1]}"
        return begin + (indented(text, style.indent, style.linefeed) if style.indent else text)

    return _published(engine, table, subset, nodes, _nested(model, names, made, top, read)).withColumnRenamed("value", "xml")


def to_json(engine, table: str | None = None, dialect: str = "object", subset: DataFrame | None = None, style: JsonStyle | None = None) -> DataFrame:
    """(document_id, key, json) of the subtrees at a table's rows.

    object: a table's siblings are an array of objects. column: one object whose fields are arrays over the siblings.
    """
    if dialect not in ("object", "column"):
        raise ValueError("dialect is object, column, or the tables' own JSON by relational_json")
    model, style = engine.model, style or JsonStyle()
    table = table or model.root

    def label(f: M.Field) -> str:
        return style.attribute_prefix + f.xml_name if f.role == M.ATTRIBUTE else style.content_name if f.role == M.CONTENT else f.xml_name if f.role == M.ELEMENT else f.xml_name.replace("/", "") if f.role == M.INLINE else f.name

    names = model.reachable(table)
    labels = [[label(f) for f in model.tables[n].content] for n in names]
    below = [[(e, names.index(e.child)) for e in sorted(model.children(n), key=lambda e: e.place)] for n in names]
    quoted = {k: json.dumps(k, ensure_ascii=False) for k in [*(x for own in labels for x in own), *(model.tables[n].xml_name for n in names)]}
    #: Tables whose rows are whole objects when they are rendered.
    whole = [dialect == "object" and not below[k] and len(set(labels[k])) == len(labels[k]) for k in range(len(names))]

    def rendered(t: M.Table, is_text: bool) -> Column:
        """JSON of each value of the row itself, or of the whole row."""
        kinds = model.struct(t.name)
        cells = [json_value(F.col(f"`{f.name}`"), kinds[f.name].dataType) for f in t.content]
        k = names.index(t.name)
        if whole[k]:
            pairs = [F.concat(F.lit(f"{quoted[x]}:"), F.coalesce(c, F.lit("null")) if style.nulls else c) for x, c in zip(labels[k], cells)]
            return F.array(F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit("}")))
        return F.array(*cells) if cells else F.array().cast("array<string>")

    nodes, names = _together(engine, table, rendered, False)

    def members(t: int) -> list[str]:
        return labels[t] + [model.tables[names[c]].xml_name for _, c in below[t]]

    def written(pairs) -> str:
        return "{" + ",".join([f"{quoted[k]}:{'null' if v is None else v}" for k, v in pairs if v is not None or style.nulls]) + "}"

    def text(row: dict | str) -> str:
        return row if isinstance(row, str) else written(row.items())

    def made(t: int, own: list, kids) -> dict | str:
        if whole[t]:
            return own[0]
        out = dict(zip(labels[t], own))
        for e, c in below[t]:
            values = [v for _, k, v in kids if k == c]
            if not values:
                v = None
            elif dialect == "column":
                v = "{" + ",".join(f"{quoted[m]}:[{','.join('null' if x.get(m) is None else x[m] for x in values)}]" for m in dict.fromkeys(members(c))) + "}"
            elif e.repeated or style.arrays_always or len(values) > 1:
                v = f"[{','.join(map(text, values))}]"
            else:
                v = text(values[0])
            out[model.tables[names[c]].xml_name] = v
        return out

    name = json.dumps(model.tables[table].xml_name, ensure_ascii=False)

    def top(v: dict | str) -> str:
        return f"{name}:{text(v)}"

    nest = _nested(model, names, made, top)
    front = F.concat(F.lit('{"document_id":'), F.regexp_replace(F.to_json(F.struct(F.col("document_id").alias("v"))), r'^\{"v":(.*)\}$', "$1"), F.lit(",")) if style.document_id else F.lit("{")
    out = F.concat(front, F.col("value"), F.lit("}"))
    if style.indent:

        @F.arrow_udf("string")
        def wide(column: pa.Array) -> pa.Array:
            return pa.array([laid_out(x, style.indent, style.key_space, style.linefeed) for x in column.to_pylist()], pa.string())

        out = wide(out)
    return _published(engine, table, subset, nodes, nest).select("document_id", "key", out.alias("json"))


def relational_json(engine, tables: list[str] | None = None) -> DataFrame:
    """(document_id, json): for each document one object with an array of rows for each table."""
    model = engine.model
    parts = None
    tables = tables or model.reachable(model.root)
    found, _ = engine.tables({n: [f.name for f in model.tables[n].fields] for n in tables})
    for name in tables:
        rows = found[name]
        cells = [c for c in rows.columns if c != "document_id"]
        per = rows.select("document_id", F.struct(_order(model, name).alias("o"), F.to_json(F.struct(*[f"`{c}`" for c in cells])).alias("j")).alias("x"))
        per = per.groupBy("document_id").agg(F.concat(F.lit(f'"{model.tables[name].xml_name}":['), F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["j"]), ","), F.lit("]")).alias("j"))
        per = per.select("document_id", F.lit(name).alias("t"), "j")
        parts = per if parts is None else parts.unionByName(per)
    return parts.groupBy("document_id").agg(F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", "j"))), lambda x: x["j"]), ","), F.lit("}")).alias("json"))


def scalars_to_xml(df: DataFrame, column: str, tag: str) -> DataFrame:
    """(xml) of single values, each in an element."""
    return df.where(F.col(column).isNotNull()).select(F.concat(F.lit(f"<{tag}>"), xml_escape(F.col(column).cast("string")), F.lit(f"</{tag}>")).alias("xml"))
