"""Shredding: XML documents to the rows of the model's tables.

Documents are parsed next to the data, in Arrow batches, and only what a query needs of them becomes rows: the walk goes
down only where a wanted table lies, and only wanted columns leave Python. The nodes of one table in many documents are
taken together, column by column; documents with names of namespaces are walked node by node. Values leave as text and get
their types in the JVM. An empty value is null; a row that lacks a required value is left out with all below it. Children beyond their
greatest number are kept: validation reports them. A null or empty document has no rows, and one that is not well-formed
is an error unless `malformed` is "drop".
"""

from __future__ import annotations

import hashlib
import xml.etree.ElementTree as ET
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.functions.keys import node_key
from treeline.schema import model as M
from treeline.schema.types import parsed
from treeline.workspace import small_batches

#: Characters of XML whose trees a worker holds at a time, but for a document that is longer (few fit the CPU's caches and
#: leave Python's collector little to look at), and bytes of rows that leave it together.
CHUNK, BATCH = 1 << 16, 1 << 20
_XSI = "{http://www.w3.org/2001/XMLSchema-instance}"


@dataclass
class Filters:
    """What loading changes: columns are `table.column`."""

    drop_values: dict[str, str] = field(default_factory=dict)  # nulled where the pattern is found
    fill: dict[str, str] = field(default_factory=dict)  # a constant
    fill_default: bool = False
    check_types: bool = False  # else a value beyond its facets stays
    keep_tables: tuple[str, ...] = ()  # these and all below them; all if empty
    malformed: str = "raise"  # or drop


def local(tag) -> str:
    return tag.rpartition("}")[2] if isinstance(tag, str) else ""


def parse(text: str | None, document: str | None = None, malformed: str = "raise"):
    """Document element; None for no text and, if they are dropped, for what is not well-formed."""
    if not text:
        return None
    try:
        return ET.fromstring(text)
    except ET.ParseError as e:
        if malformed == "drop":
            return None
        raise ValueError(f"document {document} is not well-formed: {e}") from e


def is_plain(text: str) -> bool:
    """Whether no name in a document can be one of a namespace."""
    return "xmlns" not in text and "xml:" not in text and "<!DOCTYPE" not in text


def trees(batches, malformed: str):
    """Lists of (document_id, document element, is_plain) from batches (document_id, xml)."""
    for batch in batches:
        found, size = [], 0
        for d, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            root = parse(x, d, malformed)
            if root is None:
                continue
            found.append((d, root, is_plain(x)))
            size += len(x)
            if size > CHUNK:
                yield found
                found, size = [], 0
        if found:
            yield found


def gathered(parts):
    """Batches of at least BATCH bytes; the first are smaller, for what ends with the first rows, and so is the last."""
    held, size, least = [], 0, 1
    for part in parts:
        held.append(part)
        size += part.nbytes
        if size >= least:
            yield pa.concat_batches(held)
            held, size, least = [], 0, min(2 * size, BATCH)
    if held:
        yield pa.concat_batches(held)


def _last(el: ET.Element) -> ET.Element:
    while len(el):
        el = el[-1]
    return el


def _plain(el: ET.Element) -> str:
    tail, el.tail = el.tail, None
    try:
        return ET.tostring(el, encoding="unicode")
    finally:
        el.tail = tail


class Walker:
    """Rows of some tables: of many documents at a time as columns(), of one document as rows()."""

    def __init__(self, model: M.SchemaModel, wanted: dict[str, list[str]], order: bool = False):
        self.model, self.wanted, self.order = model, wanted, order
        below = {t: set(model.reachable(t)) for t in model.tables}
        self.way = {t: {e.xml_name: e for e in model.children(t) if below[e.child] & set(wanted)} for t in model.tables}
        self.edges = {t: {e.child: e for e in model.children(t)} for t in model.tables}
        self.required = {n: [f for f in t.fields if f.required and f.role in (M.ATTRIBUTE, M.ELEMENT) and f.default is None and f.fixed is None] for n, t in model.tables.items()}
        self.fields = {n: [model.tables[n].field(c) for c in cs] for n, cs in wanted.items()}
        self.keyed = model.options.hash_algorithm, model.options.hash_size
        self.declared = {n: ({f.xml_name for f in t.fields if f.role == M.ELEMENT} | {e.xml_name for e in model.children(n)}, {f.xml_name for f in t.fields if f.role == M.ATTRIBUTE}) for n, t in model.tables.items()}
        #: Tables whose nodes' keys some row holds.
        self.hashed = {f.table for fs in self.fields.values() for f in fs if f.role == M.FOREIGN} | {n for n, fs in self.fields.items() if any(f.role == M.PRIMARY for f in fs)}
        #: Tables for which children are looked up by their name.
        self.looks = {n for n in model.tables if self.way[n] or any(f.role == M.ELEMENT for f in self.required[n]) or any(f.role in (M.ELEMENT, M.NESTED, M.INLINE) for f in self.fields.get(n, ()))}
        #: Tables at or below which the paths of nodes are used.
        pathed = self.hashed | {n for n, fs in self.fields.items() if any(f.role in (M.NESTED, M.XPATH) for f in fs)}
        self.pathed = {t for t in model.tables if below[t] & pathed}
        self.names: dict = {}

    def name(self, tag) -> str:
        got = self.names.get(tag)
        if got is None:
            got = self.names[tag] = local(tag)
        return got

    def rows(self, document: str, root: ET.Element) -> dict[str, list[list]]:
        out: dict[str, list[list]] = {t: [] for t in self.wanted}
        top = self.model.tables[self.model.root]
        self.clock, self.out, self.document = 0, out, document
        if self.name(root.tag) == top.xml_name:
            self.visit(top.name, root, f"{document}/{top.xml_name}", None, None, 1)
        return out

    def columns(self, found: list[tuple]) -> dict[str, tuple[list[list], list[int]]]:
        """For each wanted table the values of each column and the number of rows in each document of trees()."""
        parts: dict[str, list[tuple[list[int], list]]] = {t: [] for t in self.wanted}
        self.level([(k, d, root) for k, (d, root, plain) in enumerate(found) if plain], parts)
        for k, (d, root, plain) in enumerate(found):
            if not plain:
                for t, rows in self.rows(d, root).items():
                    if rows:
                        parts[t].append(([k] * len(rows), list(zip(*rows))))
        out = {}
        for t, own in parts.items():
            at = [k for ks, _ in own for k in ks]
            width = len(self.wanted[t]) + 2 * self.order
            cells = own[0][1] if len(own) == 1 else [[v for _, cs in own for v in cs[c]] for c in range(width)]
            if len(own) > 1:
                order = sorted(range(len(at)), key=at.__getitem__)
                cells = [[c[i] for i in order] for c in cells]
            count = Counter(at)
            out[t] = cells, [count[k] for k in range(len(found))]
        return out

    def keys(self, paths: list[str]) -> list:
        algorithm, size = self.keyed
        if size != "long":
            return [node_key(p, algorithm, size) for p in paths]
        new = getattr(hashlib, algorithm)
        # The least number has no positive counterpart here either.
        return np.abs(np.frombuffer(b"".join([new(p.encode()).digest()[-8:] for p in paths]), ">i8").astype("i8")).tolist()

    def level(self, found: list[tuple], parts: dict[str, list]) -> None:
        """Adds (places of documents, columns) of each table's nodes that lie at the same path but for positions, from
        documents (place, document_id, element) without namespaces."""
        top = self.model.tables[self.model.root]
        found = [x for x in found if x[2].tag == top.xml_name]
        if not found:
            return
        names = {k: d for k, d, _ in found}
        clock = {el: n for _, _, root in found for n, el in enumerate(root.iter(), 1)} if self.order else {}
        paths = [f"{d}/{top.xml_name}" for _, d, _ in found] if top.name in self.pathed else None
        todo = [(top.name, [x[2] for x in found], [x[0] for x in found], paths, None, None, [1] * len(found))]
        while todo:
            table, els, at, paths, parent, up, serial = todo.pop()
            for f in self.required[table]:
                there = self.texts(f, table, els)
                if None in there:
                    keep = [i for i, v in enumerate(there) if v is not None]
                    els, at, serial = ([x[i] for i in keep] for x in (els, at, serial))
                    paths, up = (x and [x[i] for i in keep] for x in (paths, up))
            if not els:
                continue
            keys = self.keys(paths) if table in self.hashed else None
            if table in self.wanted:
                cells = []
                for f in self.fields[table]:
                    role = f.role
                    if role == M.DOCUMENT:
                        cells.append([names[k] for k in at])
                    elif role == M.PRIMARY:
                        cells.append(keys)
                    elif role == M.FOREIGN:
                        cells.append(up if parent == f.table else [None] * len(els))
                    elif role == M.NESTED:
                        name = self.edges[table][f.table].xml_name
                        have = [i for i, el in enumerate(els) if el.find(name) is not None]
                        nested = dict(zip(have, self.keys([f"{paths[i]}/{name}" for i in have])))
                        cells.append([nested.get(i) for i in range(len(els))])
                    elif role == M.SERIAL:
                        cells.append(serial)
                    elif role == M.XPATH:
                        cells.append(self.keys([p[len(names[k]) :] for p, k in zip(paths, at)]))
                    else:
                        cells.append(self.texts(f, table, els))
                if self.order:
                    cells += [[clock[el] for el in els], [clock[_last(el)] for el in els]]
                parts[table].append((at, cells))
            for name, e in self.way[table].items():
                below, idx, ks = [], [], []
                for i, el in enumerate(els):
                    got = el.findall(name)
                    if got:
                        below += got
                        idx += [i] * len(got)
                        ks += range(1, len(got) + 1)
                if below:
                    own = [f"{paths[i]}/{name}[{k}]" if e.repeated or k > 1 else f"{paths[i]}/{name}" for i, k in zip(idx, ks)] if e.child in self.pathed else None
                    todo.append((e.child, below, [at[i] for i in idx], own, table, keys and [keys[i] for i in idx], ks))

    def texts(self, f: M.Field, table: str, els: list) -> list:
        """value() of the same column of several elements without namespaces."""
        role, name = f.role, f.xml_name
        if role == M.ATTRIBUTE:
            return [el.get(name) or None for el in els]
        if role == M.ELEMENT:
            return [None if c is None else (c.text if not len(c) else "".join(c.itertext())) or None for c in [el.find(name) for el in els]]
        if role == M.CONTENT:
            return [el.text if el.text and el.text.strip() else None for el in els]
        if role == M.INLINE:
            name, _, attribute = name.partition("/@")
            return [None if c is None else c.get(attribute) or None for c in [el.find(name) for el in els]]
        return [self.value(f, table, el, el.attrib, {}) for el in els]

    def value(self, f: M.Field, table: str, el: ET.Element, attributes: dict, kids: dict) -> object:
        role = f.role
        if role == M.ATTRIBUTE:
            return attributes.get(f.xml_name) or None
        if role == M.ELEMENT:
            found = kids.get(f.xml_name)
            if not found:
                return None
            c = found[0]
            return (c.text if not len(c) else "".join(c.itertext())) or None
        if role == M.INLINE:
            name, _, attribute = f.xml_name.partition("/@")
            found = kids.get(name)
            return next((v or None for k, v in found[0].attrib.items() if self.name(k) == attribute), None) if found else None
        if role == M.CONTENT:
            return el.text if el.text and el.text.strip() else None
        if role == M.ANY:
            known = self.declared[table][0]
            return "".join(_plain(c) for c in el if self.name(c.tag) not in known) or None
        if role == M.ANY_ATTRIBUTE:
            known = self.declared[table][1]
            return [(k, v) for k, v in attributes.items() if k not in known] or None
        return None

    def visit(self, table, el, path, parent, parent_key, serial):
        self.clock += 1
        begin = self.clock
        attributes = {self.name(k): v for k, v in el.attrib.items() if not k.startswith(_XSI)} if el.attrib else {}
        kids: dict[str, list] = {}
        if table in self.looks:
            for c in el:
                kids.setdefault(self.name(c.tag), []).append(c)
        for f in self.required[table]:
            if self.value(f, table, el, attributes, kids) is None:
                return
        key = node_key(path, *self.keyed) if table in self.hashed else None
        row = None
        if table in self.wanted:
            row = []
            for f in self.fields[table]:
                role = f.role
                if role == M.DOCUMENT:
                    row.append(self.document)
                elif role == M.PRIMARY:
                    row.append(key)
                elif role == M.FOREIGN:
                    row.append(parent_key if parent == f.table else None)
                elif role == M.NESTED:
                    e = self.edges[table][f.table]
                    row.append(node_key(f"{path}/{e.xml_name}", *self.keyed) if kids.get(e.xml_name) else None)
                elif role == M.SERIAL:
                    row.append(serial)
                elif role == M.XPATH:
                    row.append(node_key(path[len(self.document) :], *self.keyed))
                else:
                    row.append(self.value(f, table, el, attributes, kids))
            self.out[table].append(row)
        way = self.way[table]
        if way and self.order:
            # Places are counted over all wanted tables' nodes in document order.
            seen: dict[str, int] = {}
            for c in el:
                name = self.name(c.tag)
                e = way.get(name)
                if e is not None:
                    k = seen[name] = seen.get(name, 0) + 1
                    self.visit(e.child, c, f"{path}/{name}[{k}]" if e.repeated or k > 1 else f"{path}/{name}", table, key, k)
        elif way:
            for name, e in way.items():
                for k, c in enumerate(kids.get(name, ()), 1):
                    self.visit(e.child, c, f"{path}/{name}[{k}]" if e.repeated or k > 1 else f"{path}/{name}", table, key, k)
        if row is not None and self.order:
            row += [begin, self.clock]


def _arrow(f: M.Field, options: M.Options) -> pa.DataType:
    if f.role == M.SERIAL:
        return pa.int32()
    if f.role in M.KEYS and f.role != M.DOCUMENT:
        return {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}[options.key_type]
    return pa.map_(pa.string(), pa.string()) if f.role == M.ANY_ATTRIBUTE else pa.string()


def _raw(f: M.Field, options: M.Options) -> str:
    return "int" if f.role == M.SERIAL else "map<string,string>" if f.role == M.ANY_ATTRIBUTE else options.key_type if f.role in M.KEYS and f.role != M.DOCUMENT else "string"


def _names(columns: list[str], order: bool) -> list[str]:
    return columns + ["_begin", "_end"] * order


def _kinds(model: M.SchemaModel, table: str, columns: list[str], order: bool) -> list[pa.DataType]:
    return [_arrow(model.tables[table].field(c), model.options) for c in columns] + [pa.int32()] * (2 * order)


def _plain_docs(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col("document_id").cast("string").alias("document_id"), F.col("xml").cast("string").alias("xml"))


def raw_rows(docs: DataFrame, model: M.SchemaModel, table: str, columns: list[str], order: bool = False, malformed: str = "raise") -> DataFrame:
    """Rows of one table with untyped values."""
    walker = Walker(model, {table: columns}, order)
    kinds, names = _kinds(model, table, columns, order), _names(columns, order)

    def made(batches):
        for found in trees(batches, malformed):
            cells, counts = walker.columns(found)[table]
            if any(counts):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds)], names=names)

    schema = ", ".join([f"`{c}` {_raw(model.tables[table].field(c), model.options)}" for c in columns] + ["_begin int", "_end int"] * order)
    return _plain_docs(docs).mapInArrow(lambda batches: gathered(made(batches)), schema)


def raw_tables(docs: DataFrame, model: M.SchemaModel, wanted: dict[str, list[str]], store: str, order: bool = False, malformed: str = "raise") -> dict[str, DataFrame]:
    """Untyped rows of several tables from one parse: a row for each document is written to store, with a column of rows for
    each table, and every table reads its own column."""
    walker = Walker(model, wanted, order)
    kinds = {t: _kinds(model, t, cs, order) for t, cs in wanted.items()}
    names = {t: _names(cs, order) for t, cs in wanted.items()}

    def made(batches):
        for found in trees(batches, malformed):
            columns = []
            for t, (cells, counts) in walker.columns(found).items():
                ends = pa.array(np.cumsum([0, *counts]), pa.int32())
                columns.append(pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cells or [()] * len(kinds[t]), kinds[t])], names[t])))
            yield pa.RecordBatch.from_arrays(columns, names=list(wanted))

    def struct(t: str) -> str:
        return ", ".join([f"`{c}`: {_raw(model.tables[t].field(c), model.options)}" for c in wanted[t]] + ["_begin: int", "_end: int"] * order)

    schema = ", ".join(f"`{t}` array<struct<{struct(t)}>>" for t in wanted)
    _plain_docs(docs).mapInArrow(lambda batches: gathered(made(batches)), schema).write.mode("overwrite").option("compression", "zstd").parquet(store)
    stored = docs.sparkSession.read.schema(schema).parquet(store)
    return {t: stored.select(F.explode(f"`{t}`").alias("r")).select("r.*") for t in wanted}


def checked(c: Column, f: M.Field) -> Column:
    """Null where a value is beyond its facets, pattern or enumeration."""
    ok = [F.lit(True)]
    x = f.facets
    text = c.cast("string")
    if f.enums:
        ok.append(text.isin(*f.enums))
    if "pattern" in x:
        ok.append(text.rlike(f"^(?:{x['pattern']})$"))
    if "length" in x:
        ok.append(F.length(text) == int(x["length"]))
    if "minLength" in x:
        ok.append(F.length(text) >= int(x["minLength"]))
    if "maxLength" in x:
        ok.append(F.length(text) <= int(x["maxLength"]))
    for name, op in (("minInclusive", ">="), ("maxInclusive", "<="), ("minExclusive", ">"), ("maxExclusive", "<")):
        if name in x:
            bound = parsed(F.lit(x[name]), f.xs_type)
            ok.append({">=": c >= bound, "<=": c <= bound, ">": c > bound, "<": c < bound}[op])
    if f.fixed is not None:
        ok.append(text == f.fixed)
    all_ = ok[0]
    for o in ok[1:]:
        all_ = all_ & o
    return F.when(all_, c)


def value_column(c: Column, f: M.Field, table: str, options: M.Options, filters: Filters | None = None) -> Column:
    filters = filters or Filters()
    name = f"{table}.{f.name}"
    if f.role in M.KEYS or f.role == M.ANY_ATTRIBUTE:
        return c
    if name in filters.fill:
        c = F.lit(filters.fill[name])
    elif filters.fill_default and f.default is not None:
        c = F.coalesce(c, F.lit(f.default))
    if name in filters.drop_values:
        c = F.when(c.rlike(filters.drop_values[name]), None).otherwise(c)
    if f.facets.get("whiteSpace") == "collapse":
        from treeline.functions.text import collapse_space

        c = collapse_space(c)
    if not f.is_list and f.role != M.ANY:
        c = parsed(c, f.xs_type, f.facets, integer=options.integer, decimal=options.decimal)
    return checked(c, f) if filters.check_types and not f.is_list else c


def typed(raw: DataFrame, model: M.SchemaModel, table: str, columns: list[str], filters: Filters | None = None) -> DataFrame:
    """Rows with values of their types; places in document order stay if there are any."""
    t = model.tables[table]
    return raw.select(*[value_column(F.col(f"`{c}`"), t.field(c), table, model.options, filters).alias(c) for c in columns], *[c for c in ("_begin", "_end") if c in raw.columns])


def shred(docs: DataFrame, model: M.SchemaModel, table: str, columns: list[str] | None = None, *, filters: Filters | None = None, order: bool = False) -> DataFrame:
    """Typed rows of one table from documents (document_id, xml)."""
    columns = list(dict.fromkeys(columns or [f.name for f in model.tables[table].fields]))
    return typed(raw_rows(docs, model, table, columns, order, filters.malformed if filters else "raise"), model, table, columns, filters)


def shred_once(docs: DataFrame, model: M.SchemaModel, wanted: dict[str, list[str]], store: str, *, filters: Filters | None = None, order: bool = False) -> dict[str, DataFrame]:
    """Typed rows of several tables, with the given columns, from one parse kept in store."""
    raw = raw_tables(docs, model, wanted, store, order, filters.malformed if filters else "raise")
    return {t: typed(df, model, t, wanted[t], filters) for t, df in raw.items()}


def kept_tables(model: M.SchemaModel, filters: Filters | None) -> list[str]:
    """Tables that loading writes: all that are reached, or those chosen and all below them."""
    if filters and filters.keep_tables:
        return list(dict.fromkeys(t for k in filters.keep_tables for t in model.reachable(k.partition(".")[0])))
    return model.reachable(model.root)


def shred_all(docs: DataFrame, model: M.SchemaModel, store: str | None = None, filters: Filters | None = None) -> dict[str, DataFrame]:
    """All tables from one parse. With a store the parsed documents are written there once, a column for each table, and
    each table reads its own column; without, every table parses for itself as it is used."""
    tables = kept_tables(model, filters)
    if store is None:
        return {t: shred(docs, model, t, filters=filters) for t in tables}
    return shred_once(docs, model, {t: [f.name for f in model.tables[t].fields] for t in tables}, store, filters=filters)
