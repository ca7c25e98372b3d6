"""Compiler from XML Schema documents to the relational model, on the driver.

First the declarations of the whole closure of includes and imports are collected; then the root element is expanded.
Groups, attribute groups, references, extensions and restrictions are resolved on the way, so that their order does not
matter. An element of complex type, or one of simple type that may repeat, becomes a table; other elements and all
attributes become columns. An element name with one type under several parents is one table with a foreign key for each.
An element name with several types becomes one table with the columns of all, none of them required.
"""

from __future__ import annotations

import dataclasses
import os
import re
import xml.etree.ElementTree as ET

from treeline.schema import model as M
from treeline.schema.types import BUILTIN, LISTS, common_type

XS = "{http://www.w3.org/2001/XMLSchema}"
FACETS = ("length", "minLength", "maxLength", "pattern", "minInclusive", "maxInclusive", "minExclusive", "maxExclusive", "totalDigits", "fractionDigits", "whiteSpace", "explicitTimezone")

class SchemaError(ValueError):
    pass


def _local(name: str | None) -> str:
    return (name or "").rpartition("}")[2].rpartition(":")[2]


def _doc(node: ET.Element) -> str:
    out = []
    for a in node.findall(f"{XS}annotation"):
        for d in a:
            if d.tag in (f"{XS}documentation", f"{XS}appinfo"):
                out.append(re.sub(r"\s+", " ", "".join(d.itertext())).strip() or d.get("source", ""))
    return "; ".join(x for x in out if x)


class Compiler:
    def __init__(self, options: M.Options | None = None):
        self.options = options or M.Options()
        self.kinds: dict[str, dict[str, ET.Element]] = {k: {} for k in ("element", "complexType", "simpleType", "group", "attributeGroup", "attribute")}
        self.order: list[str] = []
        self.prefixes: dict[str, str] = {}
        self.namespaces: dict[str, str] = {}
        self.namespace = ""
        self.seen: set[str] = set()
        self.doc = ""
        self.referred: set[str] = set()
        self.substitutes: dict[str, list[str]] = {}
        self.messages: list[str] = []
        self.turn, self.group_place = 0, None
        #: Documents loaded: their top, prefixes and namespace; and declarations by kind, name and namespace.
        self.documents: list[tuple[ET.Element, dict[str, str], str]] = []
        self.owners: dict[tuple[str, str], dict[str, ET.Element]] = {}

    # Sources -------------------------------------------------------------------------------------------------------

    def load(self, source: str, including: str = "") -> None:
        """source: a path, or the text of a schema document. including: namespace of the one that includes it."""
        text = source.lstrip().startswith("<")
        key = source if text else os.path.realpath(source)
        if key in self.seen:
            return
        self.seen.add(key)
        if not text:
            with open(source, encoding="utf-8") as f:
                body = f.read()
        else:
            body = source
        try:
            prefixes: dict[str, str] = {}
            parser = ET.XMLPullParser(["start-ns", "end"])
            parser.feed(body)
            parser.close()
            for event, x in parser.read_events():
                if event == "start-ns":
                    self.prefixes.setdefault(x[0], x[1])
                    prefixes.setdefault(x[0], x[1])
            top = ET.fromstring(body)
        except ET.ParseError as e:
            raise SchemaError(f"not well-formed: {e}") from e
        if top.tag != f"{XS}schema":
            raise SchemaError(f"the document element is {_local(top.tag)}, not xs:schema")
        target = top.get("targetNamespace", "") or including
        self.documents.append((top, prefixes, target))
        if len(self.seen) == 1:
            self.namespace, self.doc = target, _doc(top)
        base = os.path.dirname(source) if not text else "."
        for node in top:
            kind = _local(node.tag)
            if kind in ("include", "import", "redefine", "override") and node.get("schemaLocation"):
                where = os.path.join(base, node.get("schemaLocation"))
                if kind in ("redefine", "override"):
                    # What they hold comes before what they load, and so instead of it.
                    for own in node:
                        if _local(own.tag) in self.kinds and own.get("name"):
                            self.replaced(own, kind, where)
                if os.path.exists(where):
                    self.load(where, "" if kind == "import" else target)
                else:
                    self.messages.append(f"{kind} not found: {node.get('schemaLocation')}")
            if kind in self.kinds and node.get("name"):
                self.owners.setdefault((kind, node.get("name")), {}).setdefault(target, node)
                if self.kinds[kind].setdefault(node.get("name"), node) is node and kind == "element":
                    self.order.append(node.get("name"))
                self.namespaces[node.get("name")] = target
                if kind == "element" and node.get("substitutionGroup"):
                    self.substitutes.setdefault(_local(node.get("substitutionGroup")), []).append(node.get("name"))
            for x in node.iter():
                if x.tag == f"{XS}element" and x.get("ref"):
                    self.referred.add(_local(x.get("ref")))

    def separate(self) -> None:
        """Declarations of one name in several namespaces get names of their own, and what refers to them those names.

        The first that is loaded keeps its name. Elements keep theirs in documents, where one name is one table.
        """
        renamed: dict[tuple[str, str, str], str] = {}
        for (kind, name), by in self.owners.items():
            for k, (target, node) in enumerate(list(by.items())[1:]):
                renamed[kind, name, target] = alias = f"{name}..{k + 2}"
                self.kinds[kind][alias] = node
                self.namespaces.setdefault(alias, target)
        if not renamed:
            return
        for top, prefixes, target in self.documents:
            for node in top.iter():
                for key in ("type", "base", "itemType", "memberTypes", "ref", "substitutionGroup"):
                    if node.get(key):
                        kinds = ("element",) if key == "substitutionGroup" else (_local(node.tag),) if key == "ref" else ("complexType", "simpleType")
                        out = []
                        for x in node.get(key).split():
                            prefix, _, name = x.rpartition(":")
                            uri = prefixes.get(prefix, "" if prefix else target)
                            out.append(next((renamed[k, name, uri] for k in kinds if (k, name, uri) in renamed), x))
                        node.set(key, " ".join(out))

    def replaced(self, own: ET.Element, kind: str, where: str) -> None:
        """A declaration of xs:redefine or xs:override; a redefined type that is built on itself is built on what it was."""
        name = own.get("name")
        if kind == "redefine" and os.path.exists(where):
            before = next((x for x in ET.parse(where).getroot() if x.tag == own.tag and x.get("name") == name), None)
            if before is not None:
                old = f"{name}..redefined"
                while old in self.kinds[_local(own.tag)]:
                    old += "."
                for x in own.iter():
                    for key in ("base", "ref"):
                        if _local(x.get(key)) == name and x is not own:
                            x.set(key, old)
                before.set("name", old)
                self.kinds[_local(own.tag)][old] = before
        self.kinds[_local(own.tag)].setdefault(name, own)

    # Simple types --------------------------------------------------------------------------------------------------

    def simple(self, name: str | None, node: ET.Element | None, depth: int = 0) -> dict:
        """Built-in type, facets and enumeration of a simple type, named or inline."""
        if depth > 40:
            raise SchemaError(f"simple type {name} is defined by itself")
        if node is None:
            name = _local(name) or "string"
            if name in self.kinds["simpleType"]:
                return self.simple(None, self.kinds["simpleType"][name], depth + 1)
            if name in self.kinds["complexType"]:
                return self.content_type(self.kinds["complexType"][name], depth + 1)
            if name not in BUILTIN:
                raise SchemaError(f"unknown type {name}")
            return {"xs_type": name, "facets": {}, "enums": [], "is_list": name in LISTS, "members": []}
        for child in node:
            kind = _local(child.tag)
            if kind == "restriction":
                base = self.simple(child.get("base"), child.find(f"{XS}simpleType") if child.get("base") is None else None, depth + 1)
                return self.restricted(base, child)
            if kind == "list":
                item = self.simple(child.get("itemType"), child.find(f"{XS}simpleType") if child.get("itemType") is None else None, depth + 1)
                return {**item, "xs_type": item["xs_type"], "is_list": True, "members": [item["xs_type"]]}
            if kind == "union":
                parts = [self.simple(x, None, depth + 1) for x in (child.get("memberTypes") or "").split()] + [self.simple(None, x, depth + 1) for x in child.findall(f"{XS}simpleType")]
                enums = [e for p in parts for e in p["enums"]] if parts and all(p["enums"] for p in parts) else []
                return {"xs_type": common_type([p["xs_type"] for p in parts]), "facets": widest([p["facets"] for p in parts]), "enums": list(dict.fromkeys(enums)), "is_list": any(p["is_list"] for p in parts), "members": [p["xs_type"] for p in parts]}
        return {"xs_type": "string", "facets": {}, "enums": [], "is_list": False, "members": []}

    @staticmethod
    def restricted(base: dict, node: ET.Element) -> dict:
        out = {**base, "facets": dict(base["facets"])}
        enums = [x.get("value", "") for x in node.findall(f"{XS}enumeration")]
        if enums:
            out["enums"] = list(dict.fromkeys(enums))
        patterns = [x.get("value", "") for x in node.findall(f"{XS}pattern")]
        for name in FACETS:
            x = node.find(f"{XS}{name}")
            if x is not None and name != "pattern":
                out["facets"][name] = x.get("value", "")
        if patterns:
            out["facets"]["pattern"] = patterns[0] if len(patterns) == 1 else "|".join(f"(?:{p})" for p in patterns)
        return out

    def content_type(self, node: ET.Element, depth: int = 0) -> dict:
        """Simple content of a complex type."""
        inner = node.find(f"{XS}simpleContent")
        if inner is not None:
            for how in inner:
                kind = _local(how.tag)
                if kind == "extension":
                    return self.simple(how.get("base"), None, depth + 1)
                if kind == "restriction":
                    base = self.simple(how.get("base"), how.find(f"{XS}simpleType"), depth + 1) if how.get("base") is None else self.simple(how.get("base"), None, depth + 1)
                    return self.restricted(base, how)
        return {"xs_type": "string", "facets": {}, "enums": [], "is_list": False, "members": []}

    # Complex types -------------------------------------------------------------------------------------------------

    def complex_of(self, node: ET.Element) -> tuple[ET.Element | None, str]:
        """Complex type node of an element declaration and its name."""
        inline = node.find(f"{XS}complexType")
        if inline is not None:
            return inline, ""
        name = _local(node.get("type"))
        if name in self.kinds["complexType"]:
            return self.kinds["complexType"][name], name
        if not node.get("type") and node.find(f"{XS}simpleType") is None and node.get("substitutionGroup"):
            head = self.kinds["element"].get(_local(node.get("substitutionGroup")))
            if head is not None:
                return self.complex_of(head)
        return None, ""

    def compile(self, source: str, root: str | None = None) -> M.SchemaModel:
        self.load(source)
        self.separate()
        whole = [n for n in self.order if self.kinds["element"][n].get("abstract") != "true"]
        free = [n for n in whole if n not in self.referred]
        # Members of substitution groups stand where their head is referred to.
        candidates = [n for n in free if not self.kinds["element"][n].get("substitutionGroup")] or free or whole
        if root is None:
            if not candidates:
                raise SchemaError("no element declaration can be the document element")
            root = candidates[0]
        if root not in self.kinds["element"]:
            raise SchemaError(f"no global element {root}")
        self.tables: dict[str, M.Table] = {}
        self.types: dict[str, object] = {}
        self.edges: list[M.Edge] = []
        self.identities: list[M.Identity] = []
        self.pending: list[tuple[str, ET.Element]] = []
        self.taken: set[str] = set()
        self.by_xml: dict[str, str] = {}
        top = self.table(self.kinds["element"][root], None, 1, 1)
        out = M.SchemaModel(top, self.tables, self.edges, [], self.options, self.namespace, dict(self.prefixes), {}, self.doc, candidates)
        for t in list(self.tables.values()):
            self.keys(t, out)
        for table, node in self.pending:
            self.identity(table, node, out)
        out.enumerations = {f"enum_{t.name}_{f.name}": f.enums for t in self.tables.values() for f in t.fields if f.enums}
        return out

    def place(self) -> int:
        """The next place in a content model, or that of the repeated group around it."""
        self.turn += 1
        return self.turn if self.group_place is None else self.group_place

    def table(self, node: ET.Element, parent: str | None, least: int, most: int | None) -> str:
        """Table of an element declaration below parent; made, shared or merged."""
        name, place = node.get("name"), self.place()
        around, self.group_place = self.group_place, None
        cx, type_name = self.complex_of(node)
        identity = id(cx) if cx is not None else ("simple", node.get("type"), id(node) if node.get("type") is None else 0)
        have = self.by_xml.get(name)
        if have is None:
            column = M.column_name(name, self.taken, self.options.case_sensitive)
            t = M.Table(column, name, "root" if parent is None else "child", self.namespaces.get(name, self.namespace), type_name, doc=_doc(node))
            self.tables[column], self.by_xml[name], self.types[column] = t, column, {identity}
            self.fill(t, node, cx)
        else:
            t = self.tables[have]
            if identity not in self.types[have]:
                # The same name with another type: the union of both, and nothing is required.
                self.types[have].add(identity)
                t.collided = True
                self.fill(t, node, cx)
                for f in t.fields:
                    f.required = False
        self.group_place = around
        if parent is not None:
            old = next((e for e in self.edges if e.parent == parent and e.child == t.name and e.xml_name == name), None)
            if old is None:
                self.edges.append(M.Edge(parent, t.name, name, least, most, place=place))
            else:
                old.least, old.most = min(old.least, least), None
        for kind in ("key", "unique", "keyref"):
            for x in node.findall(f"{XS}{kind}"):
                self.pending.append((t.name, x))
        return t.name

    def fill(self, t: M.Table, node: ET.Element, cx: ET.Element | None) -> None:
        if cx is None:
            self.add(t, M.CONTENT, "content", "", self.simple(node.get("type"), node.find(f"{XS}simpleType")), required=False, node=node)
            return
        t.mixed = t.mixed or cx.get("mixed") == "true"
        parts = self.complex(t, cx, set())
        # A table of several types has no one content model.
        t.model = None if t.collided else ["seq", 1, 1, parts]
        if t.mixed:
            self.add(t, M.CONTENT, "content", "", self.simple("string", None), False, cx)

    def add(self, t: M.Table, role: str, name: str, xml_name: str, kind: dict, required: bool, node: ET.Element) -> None:
        for f in t.fields:
            if f.role == role and f.xml_name == xml_name:
                # Met again, as in a restriction or a merged table: the later declaration narrows a restriction.
                if t.collided:
                    f.xs_type = common_type([f.xs_type, kind["xs_type"]])
                    f.enums = list(dict.fromkeys(f.enums + kind["enums"])) if f.enums and kind["enums"] else []
                    f.facets = widest([f.facets, kind["facets"]])
                else:
                    f.xs_type, f.facets, f.enums, f.required = kind["xs_type"], kind["facets"], kind["enums"], required
                return
        taken = {f.name.lower() for f in t.fields}
        t.fields.append(
            M.Field(M.column_name(name, taken, self.options.case_sensitive), role, kind["xs_type"], xml_name, kind["facets"], kind["enums"], required and not t.collided, node.get("nillable") == "true", node.get("default"), node.get("fixed"), kind["is_list"], kind["members"], doc=_doc(node), place=self.place())
        )

    def complex(self, t: M.Table, cx: ET.Element, seen: set[int]) -> list:
        """Fills t from a complex type; returns the parts of its content model."""
        if id(cx) in seen:
            return []
        seen, parts = seen | {id(cx)}, []
        for child in cx:
            kind = _local(child.tag)
            if kind == "simpleContent":
                self.add(t, M.CONTENT, "content", "", self.content_type(cx), False, child)
                for how in child:
                    parts += self.inherited(t, how, seen)
                    parts += self.particles(t, how, 1, 1, seen)
            elif kind == "complexContent":
                t.mixed = t.mixed or child.get("mixed") == "true"
                for how in child:
                    # A restriction repeats what it keeps; only attributes are inherited without being repeated.
                    parts += self.inherited(t, how, seen, _local(how.tag) == "extension")
                    parts += self.particles(t, how, 1, 1, seen)
        return parts + self.particles(t, cx, 1, 1, seen)

    def inherited(self, t: M.Table, how: ET.Element, seen: set[int], elements: bool = True) -> list:
        base = self.kinds["complexType"].get(_local(how.get("base")))
        if base is None:
            return []
        if elements:
            return self.complex(t, base, seen)
        else:
            before = M.Table(t.name, t.xml_name)
            edges = list(self.edges)
            probe = Compiler.__new__(Compiler)
            probe.__dict__.update(self.__dict__)
            probe.table = lambda *a, **k: t.name
            probe.complex(before, base, seen)
            self.edges[:] = edges
            t.fields += [f for f in before.fields if f.role == M.ATTRIBUTE and not any(g.role == M.ATTRIBUTE and g.xml_name == f.xml_name for g in t.fields)]
        return []

    @staticmethod
    def occurs(node: ET.Element, least: int, most: int | None, choice: bool) -> tuple[int, int | None]:
        a = int(node.get("minOccurs", 1))
        b = node.get("maxOccurs", "1")
        own = None if b == "unbounded" else int(b)
        return (0 if choice else least * a), (None if most is None or own is None else most * own)

    def grouped(self, t: M.Table, at: ET.Element, node: ET.Element, least: int, most: int | None, seen: set[int], choice: bool) -> list:
        """Particles of a group; those of a repeated one may come in any order."""
        around = self.group_place
        if around is None and at.get("maxOccurs", "1") not in ("0", "1"):
            self.group_place = self.place()
        parts = self.particles(t, node, least, most, seen, choice)
        self.group_place = around
        return parts

    @staticmethod
    def own_occurs(node: ET.Element) -> tuple[int, int | None]:
        most = node.get("maxOccurs", "1")
        return int(node.get("minOccurs", 1)), None if most == "unbounded" else int(most)

    def particles(self, t: M.Table, node: ET.Element, least: int, most: int | None, seen: set[int], choice: bool = False) -> list:
        """Adds what a node declares to t; returns the parts of the content model."""
        parts = []
        for x in node:
            kind = _local(x.tag)
            if kind in ("sequence", "choice", "all"):
                a, b = self.occurs(x, least, most, choice)
                inner = self.grouped(t, x, x, a, b, seen, choice or kind == "choice")
                parts.append([{"sequence": "seq"}.get(kind, kind), *self.own_occurs(x), inner])
            elif kind == "group":
                a, b = self.occurs(x, least, most, choice)
                group = self.kinds["group"].get(_local(x.get("ref")))
                if group is None:
                    raise SchemaError(f"unknown group {x.get('ref')}")
                if id(group) not in seen:
                    inner = self.grouped(t, x, group, a, b, seen | {id(group)}, choice)
                    parts.append(["seq", *self.own_occurs(x), inner])
            elif kind == "element":
                a, b = self.occurs(x, least, most, choice)
                parts.append(["el", *self.own_occurs(x), self.element(t, x, a, b)])
            elif kind == "any":
                self.add(t, M.ANY, "any_element", "*", self.simple("string", None), False, x)
                parts.append(["any", *self.own_occurs(x), x.get("namespace", "##any")])
            elif kind == "attribute":
                self.attribute(t, x)
            elif kind == "attributeGroup":
                group = self.kinds["attributeGroup"].get(_local(x.get("ref")))
                if group is None:
                    raise SchemaError(f"unknown attribute group {x.get('ref')}")
                if id(group) not in seen:
                    parts += self.particles(t, group, 1, 1, seen | {id(group)})
            elif kind == "anyAttribute":
                self.add(t, M.ANY_ATTRIBUTE, "any_attribute", "*", self.simple("string", None), False, x)
        return parts

    def blocked(self, head: ET.Element, other: ET.Element) -> bool:
        """Whether a member of a substitution group may not stand for its head: by block of the head or its type, or by final."""
        cx, _ = self.complex_of(head)
        block = f"{head.get('block') or ''} {cx.get('block') or '' if cx is not None else ''} {head.get('final') or ''}"
        mine, _ = self.complex_of(other)
        how = ""
        if mine is not None and mine is not cx:
            how = "extension" if mine.find(f".//{XS}extension") is not None else "restriction"
        return "#all" in block or "substitution" in block or bool(how) and how in block

    def element(self, t: M.Table, x: ET.Element, least: int, most: int | None) -> list[str]:
        """Adds an element to t; returns the names that may stand at its place."""
        if most == 0:
            return []
        if x.get("ref"):
            name = _local(x.get("ref"))
            target = self.kinds["element"].get(name)
            if target is None:
                raise SchemaError(f"unknown element {name}")
            options, todo = [], [name]
            while todo:
                n = todo.pop(0)
                if n not in options:
                    options.append(n)
                    todo += [m for m in self.substitutes.get(n, []) if not self.blocked(self.kinds["element"][n], self.kinds["element"][m])]
            options = [n for n in options if self.kinds["element"][n].get("abstract") != "true"]
            around = self.group_place
            if around is None and len(options) > 1:
                self.group_place = self.place()
            for n in options:
                self.element(t, self.kinds["element"][n], least if len(options) == 1 else 0, most)
            self.group_place = around
            return options
        cx, _ = self.complex_of(x)
        inline = self.options.inline_simple and cx is not None and cx.find(f"{XS}simpleContent") is not None and most == 1
        if not inline and (cx is not None or most is None or most > 1):
            self.table(x, t.name, least, most)
            return [x.get("name")]
        name = x.get("name")
        kind = self.content_type(cx) if inline else self.simple(x.get("type"), x.find(f"{XS}simpleType"))
        self.add(t, M.ELEMENT, name, name, kind, least > 0 and x.get("nillable") != "true", x)
        if inline:
            # Its attributes are columns beside it.
            own = M.Table(name, name)
            self.complex(own, cx, set())
            for f in own.of_role(M.ATTRIBUTE):
                t.fields.append(dataclasses.replace(f, name=M.column_name(f"{name}_{f.name}", {g.name.lower() for g in t.fields}, self.options.case_sensitive), role=M.INLINE, xml_name=f"{name}/@{f.xml_name}", required=False))
        return [name]

    def attribute(self, t: M.Table, x: ET.Element) -> None:
        use = x.get("use", "optional")
        target = x
        if x.get("ref"):
            target = self.kinds["attribute"].get(_local(x.get("ref")))
            if target is None:
                if _local(x.get("ref")) in ("lang", "space", "base", "id") and x.get("ref").startswith("xml:"):
                    target = ET.Element("attribute", {"name": _local(x.get("ref")), "type": "xs:string"})
                else:
                    raise SchemaError(f"unknown attribute {x.get('ref')}")
        name = target.get("name")
        if use == "prohibited":
            t.fields = [f for f in t.fields if not (f.role == M.ATTRIBUTE and f.xml_name == name)]
            return
        kind = self.simple(target.get("type"), target.find(f"{XS}simpleType"))
        node = target if target is x else ET.Element("attribute", {**target.attrib, **{k: v for k, v in x.attrib.items() if k in ("default", "fixed")}})
        self.add(t, M.ATTRIBUTE, name, name, kind, use == "required", node)

    # Keys ----------------------------------------------------------------------------------------------------------

    def keys(self, t: M.Table, model: M.SchemaModel) -> None:
        o, taken = self.options, {f.name.lower() for f in t.fields}
        own: list[M.Field] = []

        def key(name: str, role: str, table: str = "") -> M.Field:
            f = M.Field(M.column_name(name, taken), role, "string", table=table)
            own.append(f)
            return f

        if o.document_key:
            key("document_id", M.DOCUMENT).required = True
        if o.relational_keys:
            key(f"{t.name}_id", M.PRIMARY, t.name).required = True
            for e in model.parents(t.name):
                if not any(f.role == M.FOREIGN and f.table == e.parent for f in own):
                    e.column = key(f"{e.parent}_id" if e.parent != t.name else f"parent_{e.parent}_id", M.FOREIGN, e.parent).name
                else:
                    e.column = next(f.name for f in own if f.role == M.FOREIGN and f.table == e.parent)
            for e in model.children(t.name):
                if not e.repeated and e.child != t.name and not any(f.table == e.child for f in own):
                    key(f"{e.child}_id", M.NESTED, e.child)
        if o.serial_key and any(e.repeated for e in model.parents(t.name)):
            key("serial_id", M.SERIAL)
        if o.xpath_key:
            key("xpath_id", M.XPATH)
        t.fields[:0] = own

    def identity(self, table: str, node: ET.Element, model: M.SchemaModel) -> None:
        selector, fields = node.find(f"{XS}selector"), node.findall(f"{XS}field")
        if selector is None or not fields:
            return
        for branch in selector.get("xpath", "").split("|"):
            here, ok = [table], True
            for step in (s for s in branch.strip().replace(".//", "").split("/") if s and s != "."):
                name = _local(step)
                deep = branch.strip().startswith(".//")
                here = [e.child for h in here for e in (model.edges if deep else model.children(h)) if name in ("*", e.xml_name)]
                ok = ok and bool(here)
            for h in dict.fromkeys(here if ok else []):
                columns = []
                for f in fields:
                    path = f.get("xpath", "").strip().removeprefix("./")
                    role = M.ATTRIBUTE if path.startswith("@") else M.CONTENT if path in ("", ".") else M.ELEMENT
                    name = "" if role == M.CONTENT else _local(path.lstrip("@"))
                    columns += [c.name for c in model.tables[h].fields if c.role == role and c.xml_name == name]
                if len(columns) == len(fields):
                    model.identities.append(M.Identity(_local(node.tag), node.get("name", ""), h, columns, _local(node.get("refer"))))


def widest(parts: list[dict]) -> dict:
    """Facets that allow what any of the parts allows; a facet that one part lacks does not hold."""
    parts = list(parts)
    out: dict = {}
    for name in set.intersection(*[set(p) for p in parts]) if parts else ():
        values = [p[name] for p in parts]
        if len(set(values)) == 1:
            out[name] = values[0]
        elif name == "pattern":
            out[name] = "|".join(f"(?:{v})" for v in values)
        elif name in ("minLength", "minInclusive", "minExclusive", "maxLength", "maxInclusive", "maxExclusive", "totalDigits", "fractionDigits"):
            try:
                out[name] = (min if name.startswith("min") else max)(values, key=float)
            except ValueError:
                pass
    return out


def compile_schema(source: str, root: str | None = None, **options) -> M.SchemaModel:
    """Model of a schema document, given by path or text."""
    return Compiler(M.Options(**options)).compile(source, root)


def diagnose(source: str) -> list[str]:
    """What is wrong with a schema document; empty if it compiles."""
    c = Compiler()
    try:
        m = c.compile(source)
        for t in m.tables.values():
            for f in t.fields:
                if "pattern" in f.facets:
                    try:
                        re.compile(f.facets["pattern"].replace("\\i", "[A-Za-z_:]").replace("\\c", "[-.0-9A-Za-z_:]"))
                    except re.error as e:
                        c.messages.append(f"{t.name}.{f.name}: pattern {f.facets['pattern']}: {e}")
    except SchemaError as e:
        return [*c.messages, str(e)]
    return c.messages
