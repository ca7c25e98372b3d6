"""The relational model that a schema compiles to."""

from __future__ import annotations

import dataclasses
import json
import re
from dataclasses import dataclass, field

from pyspark.sql import types as T

from treeline.schema.types import spark_type

ELEMENT, ATTRIBUTE, CONTENT, ANY, ANY_ATTRIBUTE = "element", "attribute", "simple_content", "any", "any_attribute"
PRIMARY, FOREIGN, NESTED, DOCUMENT, SERIAL, XPATH = "primary_key", "foreign_key", "nested_key", "document_key", "serial_key", "xpath_key"
#: An attribute of a child element that is a column here with it: xml_name is element/@attribute.
INLINE = "inline_attribute"
KEYS = frozenset((PRIMARY, FOREIGN, NESTED, DOCUMENT, SERIAL, XPATH))


@dataclass
class Options:
    """How a schema is compiled and documents are shredded."""

    document_key: bool = True
    serial_key: bool = True
    xpath_key: bool = False
    relational_keys: bool = True
    hash_algorithm: str = "sha1"
    hash_size: str = "long"
    case_sensitive: bool = True
    integer: str = "int"
    decimal: str = "big"
    inline_simple: bool = False  # single children of simple content are columns, not tables

    @property
    def key_type(self) -> str:
        return {"long": "bigint", "int": "int", "native": "binary", "debug": "string"}[self.hash_size]


@dataclass
class Field:
    name: str
    role: str
    xs_type: str = "string"
    xml_name: str = ""
    facets: dict = field(default_factory=dict)
    enums: list[str] = field(default_factory=list)
    required: bool = False
    nillable: bool = False
    default: str | None = None
    fixed: str | None = None
    is_list: bool = False
    members: list[str] = field(default_factory=list)
    table: str = ""
    doc: str = ""
    #: Where an element stands among the others of its content model; all of a repeated group stand at one place.
    place: int = 0

    def type(self, options: Options) -> str:
        if self.role == SERIAL:
            return "int"
        if self.role == DOCUMENT:
            return "string"
        if self.role in KEYS:
            return options.key_type
        if self.role == ANY_ATTRIBUTE:
            return "map<string,string>"
        return "string" if self.role == ANY or self.is_list else spark_type(self.xs_type, self.facets, integer=options.integer, decimal=options.decimal)


@dataclass
class Edge:
    """A child table below a parent table, by the name of the child's element."""

    parent: str
    child: str
    xml_name: str
    least: int = 1
    most: int | None = 1
    column: str = ""
    place: int = 0

    @property
    def repeated(self) -> bool:
        return self.most is None or self.most > 1


@dataclass
class Table:
    name: str
    xml_name: str
    kind: str = "child"
    namespace: str = ""
    type_name: str = ""
    fields: list[Field] = field(default_factory=list)
    doc: str = ""
    collided: bool = False
    mixed: bool = False
    #: Content model: [kind, least, most, parts] of seq, choice, all; [el, least, most, names]; [any, least, most, namespaces].
    model: list | None = None

    def field(self, name: str) -> Field | None:
        return next((f for f in self.fields if f.name == name), None)

    def of_role(self, *roles: str) -> list[Field]:
        return [f for f in self.fields if f.role in roles]

    @property
    def content(self) -> list[Field]:
        return [f for f in self.fields if f.role not in KEYS]

    @property
    def primary(self) -> str:
        return f"{self.name}_id"


@dataclass
class Identity:
    """xs:key, xs:unique or xs:keyref."""

    kind: str
    name: str
    table: str
    columns: list[str]
    refer: str = ""


@dataclass
class SchemaModel:
    root: str
    tables: dict[str, Table]
    edges: list[Edge]
    identities: list[Identity] = field(default_factory=list)
    options: Options = field(default_factory=Options)
    namespace: str = ""
    prefixes: dict[str, str] = field(default_factory=dict)
    enumerations: dict[str, list[str]] = field(default_factory=dict)
    doc: str = ""
    roots: list[str] = field(default_factory=list)

    def children(self, table: str) -> list[Edge]:
        return [e for e in self.edges if e.parent == table]

    def parents(self, table: str) -> list[Edge]:
        return [e for e in self.edges if e.child == table]

    def reachable(self, start: str) -> list[str]:
        out, todo = [], [start]
        while todo:
            t = todo.pop(0)
            if t not in out:
                out.append(t)
                todo += [e.child for e in self.children(t)]
        return out

    def refs(self, table: str) -> int:
        """Number of edges to a table and of key references to it."""
        own = {i.name for i in self.identities if i.table == table}
        return len(self.parents(table)) + sum(i.kind == "keyref" and i.refer in own for i in self.identities)

    def ordered(self, descending: bool = True) -> list[Table]:
        """Tables by their references, parents before children among equals."""
        place = {t: k for k, t in enumerate(self.reachable(self.root) + [t for t in self.tables])}
        return sorted(self.tables.values(), key=lambda t: ((-1 if descending else 1) * self.refs(t.name), place.get(t.name, 0)))

    def flags(self, name: str) -> dict[str, bool]:
        """The classification of a table that the planner and the exporters go by."""
        t, down = self.tables[name], self.children(name)
        roles = {f.role for f in t.content}
        elements = bool(roles & {CONTENT, ELEMENT, ANY})
        holder = any(e.repeated for e in down)
        bridge = len(down) == 1 and not elements
        return {
            "content_holder": bool(t.content), "has_attrs": bool(roles & {ATTRIBUTE, ANY_ATTRIBUTE}), "has_elems": elements, "list_holder": holder, "bridge": bridge,
            "simple_bridge": bridge and not t.content and not holder and not self.parents(name) and name != self.root,
            "virtual": t.kind.startswith("admin"), "relational": bridge or t.kind.startswith("admin") or not t.content,
        }

    def recursive(self) -> set[str]:
        """Tables that lie below themselves."""
        return {t for t in self.tables if any(t in self.reachable(e.child) for e in self.children(t))}

    def paths(self) -> dict[str, list[str]]:
        """Absolute paths of each table; recursion is followed once."""
        out: dict[str, list[str]] = {}

        def walk(table: str, path: str, seen: tuple[str, ...]):
            out.setdefault(table, []).append(path)
            for e in self.children(table):
                if seen.count(e.child) < 2:
                    walk(e.child, f"{path}/{e.xml_name}", (*seen, e.child))

        walk(self.root, f"/{self.tables[self.root].xml_name}", (self.root,))
        return out

    def struct(self, table: str) -> T.StructType:
        """Spark schema of a table, with roles and facets as column metadata."""
        out = []
        for f in self.tables[table].fields:
            meta = {k: v for k, v in {"role": f.role, "xs_type": f.xs_type, "facets": json.dumps(f.facets), "enum": f.enums, "comment": f.doc}.items() if v not in ("", "{}", [])}
            out.append(T.StructField(f.name, T._parse_datatype_string(f.type(self.options)), not f.required, meta))
        return T.StructType(out)

    def to_json(self) -> str:
        return json.dumps(dataclasses.asdict(self), indent=1)

    @classmethod
    def from_json(cls, text: str) -> SchemaModel:
        d = json.loads(text)
        d["tables"] = {k: Table(**{**t, "fields": [Field(**f) for f in t["fields"]]}) for k, t in d["tables"].items()}
        d["edges"] = [Edge(**e) for e in d["edges"]]
        d["identities"] = [Identity(**i) for i in d["identities"]]
        d["options"] = Options(**d["options"])
        return cls(**d)


def column_name(xml_name: str, taken: set[str], case_sensitive: bool = True) -> str:
    """A column for an XML name: signs that no identifier has become '_'; Spark sees no case, so clashes get a number."""
    base = re.sub(r"\W", "_", xml_name)
    base = base if case_sensitive else base.lower()
    name, k = base, 2
    while name.lower() in taken:
        name, k = f"{base}_{k}", k + 1
    taken.add(name.lower())
    return name
