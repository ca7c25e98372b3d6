"""The model as a JSON Schema, in the dialects of the JSON that publishing makes."""

from __future__ import annotations

import json

from treeline.schema import model as M
from treeline.schema.types import int_range, json_type

DRAFTS = {
    "draft-04": "http://json-schema.org/draft-04/schema#",
    "draft-06": "http://json-schema.org/draft-06/schema#",
    "draft-07": "http://json-schema.org/draft-07/schema#",
    "2019-09": "https://json-schema.org/draft/2019-09/schema",
    "latest": "https://json-schema.org/draft/2020-12/schema",
}
#: Formats and the first draft that has them.
FORMATS = {"dateTime": ("date-time", 4), "dateTimeStamp": ("date-time", 4), "anyURI": ("uri", 4), "date": ("date", 7), "time": ("time", 7), "duration": ("duration", 8)}
_NUMBER = {"draft-04": 4, "draft-06": 6, "draft-07": 7, "2019-09": 8, "latest": 9}


def _num(text: str):
    v = float(text)
    return int(v) if v == int(v) and abs(v) < 1 << 63 else v


def value_schema(f: M.Field, draft: str = "latest") -> dict:
    """Schema of one value."""
    n = _NUMBER[draft]
    if f.is_list:
        return {"type": "string"}
    kind = json_type(f.xs_type)
    out: dict = {"type": kind}
    if f.doc:
        out["description"] = f.doc
    if f.xs_type in FORMATS and n >= FORMATS[f.xs_type][1]:
        out["format"] = FORMATS[f.xs_type][0]
    if f.enums:
        out["enum"] = [_num(e) if kind in ("integer", "number") else e for e in f.enums]
    if f.fixed is not None:
        out |= {"enum": [f.fixed]} if n < 6 else {"const": f.fixed}
    if f.default is not None:
        out["default"] = f.default
    x = f.facets
    if kind in ("integer", "number"):
        low, high = int_range(f.xs_type) or (None, None)
        if low is not None:
            out["minimum"] = low
        if high is not None:
            out["maximum"] = high
        for facet, name in (("minInclusive", "minimum"), ("maxInclusive", "maximum")):
            if facet in x:
                out[name] = _num(x[facet])
        for facet, name, strict in (("minExclusive", "minimum", "exclusiveMinimum"), ("maxExclusive", "maximum", "exclusiveMaximum")):
            if facet in x:
                out |= {name: _num(x[facet]), strict: True} if n < 6 else {strict: _num(x[facet])}
        if "fractionDigits" in x and int(x["fractionDigits"]) > 0:
            out["multipleOf"] = _num(f"1e-{int(x['fractionDigits'])}")
    else:
        for facet, names in (("length", ("minLength", "maxLength")), ("minLength", ("minLength",)), ("maxLength", ("maxLength",))):
            if facet in x:
                out |= {k: int(x[facet]) for k in names}
        if "pattern" in x:
            out["pattern"] = f"^(?:{x['pattern']})$"
    return out


def _key(f: M.Field, prefix: str, content: str) -> str:
    return prefix + f.xml_name if f.role == M.ATTRIBUTE else content if f.role == M.CONTENT else f.xml_name if f.role == M.ELEMENT else f.name


def json_schema(model: M.SchemaModel, dialect: str = "object", draft: str = "latest", attribute_prefix: str = "@", content_name: str = "$") -> dict:
    """object: tables are objects, repeated ones arrays of them. column: fields are arrays over siblings. relational: one array of rows for each table."""
    if dialect not in ("object", "column", "relational"):
        raise ValueError("dialect is object, column or relational")
    where = "definitions" if _NUMBER[draft] < 8 else "$defs"
    defs: dict[str, dict] = {}

    def own(t: M.Table, many: bool) -> dict:
        props, required = {}, []
        for f in t.content:
            v = value_schema(f, draft) if f.role not in (M.ANY, M.ANY_ATTRIBUTE) else {"type": "object" if f.role == M.ANY_ATTRIBUTE else "string"}
            props[_key(f, attribute_prefix, content_name)] = {"type": "array", "items": v} if many else v
            if f.required:
                required.append(_key(f, attribute_prefix, content_name))
        return {"type": "object", "properties": props} | ({"required": required} if required else {})

    for t in model.tables.values():
        if dialect == "relational":
            rows = {f.name: value_schema(f, draft) if f.role not in M.KEYS and f.role not in (M.ANY, M.ANY_ATTRIBUTE) else {} for f in t.fields}
            defs[t.name] = {"type": "array", "items": {"type": "object", "properties": rows}}
            continue
        d = own(t, dialect == "column" and t.name != model.root)
        for e in model.children(t.name):
            ref = {"$ref": f"#/{where}/{e.child}"}
            d["properties"][e.xml_name] = ref if dialect == "column" or not e.repeated else {"type": "array", "items": ref} | ({"minItems": e.least} if e.least else {}) | ({"maxItems": e.most} if e.most is not None else {})
            if e.least > 0:
                d.setdefault("required", []).append(e.xml_name)
        if t.doc:
            d["description"] = t.doc
        defs[t.name] = d
    out: dict = {"$schema": DRAFTS[draft]}
    if model.doc:
        out["title"] = model.doc
    if dialect == "relational":
        out |= {"type": "object", "properties": {t.xml_name: {"$ref": f"#/{where}/{t.name}"} for t in model.ordered()}}
    else:
        root = model.tables[model.root]
        out |= {"type": "object", "properties": {root.xml_name: {"$ref": f"#/{where}/{root.name}"}}, "required": [root.xml_name]}
    return out | {where: defs}


def json_schema_text(model: M.SchemaModel, indent: int = 1, **options) -> str:
    return json.dumps(json_schema(model, **options), indent=indent)
