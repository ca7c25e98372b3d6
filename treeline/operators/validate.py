"""Validation of values, keys, documents and tables against the model."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeline.operators.shred import checked, local, raw_rows, raw_tables
from treeline.schema import model as M
from treeline.schema.types import parsed
from treeline.workspace import new_folder


@F.arrow_udf(T.BooleanType())
def well_formed(xml: pa.Array) -> pa.Array:
    """Whether a text is an XML document; null for null."""
    out = []
    for x in xml.to_pylist():
        try:
            out.append(None if x is None else ET.fromstring(x) is not None)
        except ET.ParseError:
            out.append(False)
    return pa.array(out, pa.bool_())


def member_types(c: Column, f: M.Field) -> Column:
    """Whether all items of a list, or the value of a union, are of one of the member types."""
    kinds = f.members or [f.xs_type]

    def fits(x: Column) -> Column:
        ok = F.lit(False)
        for k in kinds:
            ok = ok | parsed(x, k).isNotNull()
        return ok

    return F.forall(F.split(F.trim(c), r"\s+"), fits) if f.is_list else fits(c)


def invalid_values(docs: DataFrame, model: M.SchemaModel, table: str) -> DataFrame:
    """(document_id, column, value, reason) of values that are not of their type or beyond their facets."""
    fields = _checked_fields(model, table)
    return _invalid(raw_rows(docs, model, table, ["document_id", *[f.name for f in fields]]), model, fields)


def document_errors(docs: DataFrame, model: M.SchemaModel) -> DataFrame:
    """(document_id, error): all that invalid_documents() finds, and `table.column: reason` for each invalid value of any table.

    Values are read by one parse; what is not well-formed has no values.
    """
    names = [t for t in model.reachable(model.root) if _checked_fields(model, t)]
    wanted = {t: ["document_id", *[f.name for f in _checked_fields(model, t)]] for t in names}
    out = invalid_documents(docs, model)
    for t, raw in raw_tables(docs, model, wanted, new_folder(docs.sparkSession, "values"), malformed="drop").items():
        bad = _invalid(raw, model, _checked_fields(model, t))
        out = out.unionAll(bad.select("document_id", F.concat(F.lit(f"{t}."), "column", F.lit(": "), "reason")))
    return out


def _checked_fields(model: M.SchemaModel, table: str) -> list[M.Field]:
    return [f for f in model.tables[table].content if f.role not in (M.ANY, M.ANY_ATTRIBUTE)]


def _invalid(raw: DataFrame, model: M.SchemaModel, fields: list[M.Field]) -> DataFrame:
    checks = []
    for f in fields:
        c = F.col(f"`{f.name}`")
        if f.is_list or len(f.members) > 1:
            ok, typed = member_types(c, f), c
        else:
            typed = parsed(c, f.xs_type, f.facets, integer=model.options.integer, decimal=model.options.decimal)
            ok = typed.isNotNull()
        reason = F.when(c.isNull(), F.lit("required") if f.required else None).when(~ok, "type")
        if f.enums or f.facets or f.fixed is not None:
            reason = F.coalesce(reason, F.when(c.isNotNull() & ok & checked(typed, f).isNull(), "facet"))
        checks.append(F.struct(F.lit(f.name).alias("column"), c.cast("string").alias("value"), reason.alias("reason")))
    return raw.select("document_id", F.explode(F.array(*checks)).alias("x")).select("document_id", "x.*").where("reason is not null")


def duplicate_keys(rows: DataFrame, columns: list[str], per_document: bool = True) -> DataFrame:
    """Key values that occur more than once, with their number: violations of xs:key and xs:unique."""
    by = (["document_id"] if per_document else []) + columns
    return rows.where(F.expr(" and ".join(f"`{c}` is not null" for c in columns))).groupBy(*by).agg(F.count("*").alias("n")).where("n > 1")


def orphans(rows: DataFrame, columns: list[str], referred: DataFrame, to: list[str]) -> DataFrame:
    """Rows whose reference has no key: violations of xs:keyref. A null reference refers to nothing."""
    keys = referred.select(*[F.col(t).alias(f"__r{k}") for k, t in enumerate(to)]).distinct()
    on = None
    for k, c in enumerate(columns):
        one = F.col(c) == F.col(f"__r{k}")
        on = one if on is None else on & one
    return rows.where(F.expr(" and ".join(f"`{c}` is not null" for c in columns))).join(keys, on, "left_anti")


_patterns: dict[int, tuple] = {}


def _pattern(t: M.Table):
    """The compiled content model of a table, or None where it has none."""
    if t.model is None:
        return None
    got = _patterns.get(id(t))
    if got is None or got[0] is not t:
        if len(_patterns) > 10_000:
            _patterns.clear()
        got = _patterns[id(t)] = (t, re.compile(content_pattern(t.model)))
    return got[1]


def content_pattern(part: list) -> str:
    """A content model as a regular expression over the names of children, each followed by a space."""
    kind, least, most, inner = part
    if kind == "el":
        one = "|".join(re.escape(n) + " " for n in inner) if inner else "(?!)"
    elif kind == "any":
        one = "[^ ]+ "
    elif kind == "choice":
        one = "|".join(content_pattern(p) for p in inner)
    elif kind == "all":
        # In any order: each at its number, by looking ahead for each, and nothing else.
        names = [n for p in inner for n in (p[3] if p[0] == "el" else ())]
        own = "|".join(re.escape(n) + " " for n in names) or "(?!)"
        ahead = "".join(f"(?=(?:(?!{'|'.join(re.escape(n) + ' ' for n in p[3])})[^ ]+ )*(?:(?:{'|'.join(re.escape(n) + ' ' for n in p[3])})(?:(?!{'|'.join(re.escape(n) + ' ' for n in p[3])})[^ ]+ )*){_times(p[1], p[2])}$)" for p in inner if p[0] == "el" and p[3])
        one = f"{ahead}(?:{own})*"
    else:
        one = "".join(content_pattern(p) for p in inner)
    return f"(?:{one}){_times(least, most)}" if (least, most) != (1, 1) or "|" in one else one


def _wild(part: list) -> list[str]:
    """Namespaces that the wildcards of a content model allow."""
    if part[0] == "any":
        return [part[3]]
    return [x for p in part[3] if isinstance(p, list) for x in _wild(p)] if part[0] != "el" else []


def _allowed(uri: str, wild: list[str], target: str) -> bool:
    """Whether a namespace is one that a wildcard allows; no namespace is the empty one."""
    for w in wild:
        if w == "##any" or w == "##other" and uri not in ("", target):
            return True
        if any(x == uri or x == "##local" and not uri or x == "##targetNamespace" and uri == target for x in w.split()):
            return True
    return False


def _times(least: int, most: int | None) -> str:
    return f"{{{least},{'' if most is None else most}}}"


def structural_errors(model: M.SchemaModel, text: str) -> list[str]:
    """What a document has that the model does not allow: unknown, missing or too many nodes, or children in another order."""
    try:
        root = ET.fromstring(text)
    except ET.ParseError as e:
        return [f"not well-formed: {e}"]
    out: list[str] = []
    top = model.tables[model.root]
    if local(root.tag) != top.xml_name:
        return [f"document element {local(root.tag)}"]

    def visit(table: str, el: ET.Element, path: str) -> None:
        t = model.tables[table]
        roles = {f.role for f in t.content}
        attributes = {f.xml_name: f for f in t.of_role(M.ATTRIBUTE)}
        elements = {f.xml_name: f for f in t.of_role(M.ELEMENT)}
        edges = {e.xml_name: e for e in model.children(table)}
        have = {local(k) for k in el.attrib if not k.startswith("{http://www.w3.org/2001/XMLSchema-instance}")}
        if M.ANY_ATTRIBUTE not in roles:
            out.extend(f"{path}/@{a}: unknown" for a in sorted(have - set(attributes)))
        out.extend(f"{path}/@{a}: missing" for a, f in attributes.items() if f.required and a not in have)
        count: dict[str, int] = {}
        wild = _wild(t.model) if t.model is not None and M.ANY in roles else []
        for c in el:
            n = local(c.tag)
            count[n] = count.get(n, 0) + 1
            if n in edges:
                visit(edges[n].child, c, f"{path}/{n}")
            elif n not in elements and M.ANY not in roles:
                out.append(f"{path}/{n}: unknown")
            elif n not in elements and wild and not _allowed(c.tag[1:].partition("}")[0] if c.tag.startswith("{") else "", wild, model.namespace):
                out.append(f"{path}/{n}: namespace")
        for n, f in elements.items():
            if f.required and not count.get(n):
                out.append(f"{path}/{n}: missing")
            if count.get(n, 0) > 1:
                out.append(f"{path}/{n}: too many")
        for n, e in edges.items():
            if count.get(n, 0) < e.least and not t.collided:
                out.append(f"{path}/{n}: missing")
            if e.most is not None and count.get(n, 0) > e.most:
                out.append(f"{path}/{n}: too many")
        pattern = _pattern(t)
        if pattern is not None and not any(x.startswith(f"{path}/") and x.count("/") == path.count("/") + 1 for x in out) and not pattern.fullmatch("".join(f"{local(c.tag)} " for c in el)):
            out.append(f"{path}: order of children")
        if M.CONTENT not in roles and ((el.text or "").strip() or any((c.tail or "").strip() for c in el)):
            out.append(f"{path}: text")

    visit(model.root, root, f"/{top.xml_name}")
    return out


def invalid_documents(docs: DataFrame, model: M.SchemaModel) -> DataFrame:
    """(document_id, error) of documents that are not well-formed or not of the model's structure."""

    @F.arrow_udf("array<string>")
    def errors(xml: pa.Array) -> pa.Array:
        return pa.array([None if x is None else structural_errors(model, x) for x in xml.to_pylist()], pa.list_(pa.string()))

    return docs.select("document_id", F.explode(errors(F.col("xml"))).alias("error"))


def valid_documents(docs: DataFrame, model: M.SchemaModel) -> DataFrame:
    """The rows of docs (document_id, xml, ...) that have no structural error; null documents have none."""

    @F.arrow_udf("boolean")
    def right(xml: pa.Array) -> pa.Array:
        return pa.array([x is None or not structural_errors(model, x) for x in xml.to_pylist()], pa.bool_())

    return docs.where(right(F.col("xml")))


def schema_differences(df: DataFrame, model: M.SchemaModel, table: str, strict: bool = False) -> list[str]:
    """Columns of the model that a table lacks; strict: other types or another order as well."""
    have, want = {f.name: f for f in df.schema}, model.struct(table)
    out = [f"{f.name}: missing" for f in want if f.name not in have]
    if strict:
        out += [f"{f.name}: {have[f.name].dataType.simpleString()} for {f.dataType.simpleString()}" for f in want if f.name in have and have[f.name].dataType != f.dataType]
        if not out and [f.name for f in df.schema] != [f.name for f in want]:
            out.append("order")
    return out
