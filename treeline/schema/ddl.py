"""The model as Spark SQL: databases, tables, views over shared types, and comments with keys and constraints."""

from __future__ import annotations

from treeline.schema import model as M


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def constraint(f: M.Field) -> str:
    """What a column may hold, as an SQL condition; empty if anything of its type."""
    c, out, x = quoted(f.name), [], f.facets
    if f.enums:
        out.append(f"{c} IN ({', '.join(map(literal, f.enums))})")
    if "pattern" in x:
        out.append(f"{c} RLIKE {literal('^(?:' + x['pattern'] + ')$')}")
    for name, sign in (("length", "="), ("minLength", ">="), ("maxLength", "<=")):
        if name in x:
            out.append(f"length({c}) {sign} {int(x[name])}")
    for name, sign in (("minInclusive", ">="), ("maxInclusive", "<="), ("minExclusive", ">"), ("maxExclusive", "<")):
        if name in x:
            out.append(f"{c} {sign} {x[name] if _numeric(x[name]) else literal(x[name])}")
    if f.fixed is not None:
        out.append(f"{c} = {literal(f.fixed)}")
    return " AND ".join(out)


def _numeric(text: str) -> bool:
    try:
        float(text)
    except ValueError:
        return False
    return True


def create_table(model: M.SchemaModel, table: str, database: str = "", using: str = "parquet") -> str:
    t = model.tables[table]
    lines = []
    for f in t.fields:
        notes = "; ".join(x for x in (f.doc, f.role if f.role in M.KEYS else "", constraint(f)) if x)
        default = f" DEFAULT {literal(f.default)}" if f.default is not None and f.type(model.options) == "string" else ""
        lines.append(f"  {quoted(f.name)} {f.type(model.options).upper()}" + " NOT NULL" * f.required + default + (f" COMMENT {literal(notes)}" if notes else ""))
    name = f"{quoted(database)}.{quoted(table)}" if database else quoted(table)
    kind = ", ".join(k for k, v in model.flags(table).items() if v)
    comment = "; ".join(x for x in (t.doc, kind) if x)
    return f"CREATE TABLE {name} (\n" + ",\n".join(lines) + f"\n) USING {using}" + (f" COMMENT {literal(comment)}" if comment else "")


def shared_view(model: M.SchemaModel, table: str) -> str | None:
    """A view of a table that several parents share: its rows below each of them, and whose they are."""
    up = model.parents(table)
    if len(up) < 2:
        return None
    parts = [f"SELECT {literal(e.parent)} AS `parent`, * FROM {quoted(table)} WHERE {quoted(e.column)} IS NOT NULL" for e in up]
    return f"CREATE VIEW {quoted(table + '_of')} AS\n" + "\nUNION ALL\n".join(parts)


def statistics(model: M.SchemaModel) -> dict[str, int]:
    """Numbers of tables of each kind, of columns and of keys."""
    out = {"tables": len(model.tables), "columns": sum(len(t.fields) for t in model.tables.values())}
    for kind in ("content_holder", "list_holder", "bridge", "virtual", "relational"):
        out[kind] = sum(model.flags(t)[kind] for t in model.tables)
    for role in (M.PRIMARY, M.FOREIGN, M.NESTED):
        out[role] = sum(len(t.of_role(role)) for t in model.tables.values())
    out["unique"] = sum(i.kind != "keyref" for i in model.identities)
    out["keyref"] = sum(i.kind == "keyref" for i in model.identities)
    return out


def database_of(model: M.SchemaModel, table: str, database: str = "", by_namespace: bool = False) -> str:
    """Database of a table: the given one, or one for each namespace, named by its prefix."""
    uri = model.tables[table].namespace
    if not by_namespace or not uri:
        return database
    return next((p for p, u in model.prefixes.items() if u == uri and p), database)


def ddl(model: M.SchemaModel, database: str = "", using: str = "parquet", drop: bool = False, by_namespace: bool = False) -> str:
    """All statements. Tables come by the references to them, most first, as they can be filled."""
    out = [f"-- {k}: {v}" for k, v in statistics(model).items()]
    tables = [t.name for t in model.ordered()]
    where = {t: database_of(model, t, database, by_namespace) for t in tables}
    out += [f"CREATE DATABASE IF NOT EXISTS {quoted(d)};" for d in dict.fromkeys(where.values()) if d]
    if drop:
        out += [f"DROP TABLE IF EXISTS {quoted(where[t]) + '.' if where[t] else ''}{quoted(t)};" for t in reversed(tables)]
    out += [create_table(model, t, where[t], using) + ";" for t in tables]
    out += [v + ";" for t in tables if (v := shared_view(model, t))]
    for i in model.identities:
        columns = ", ".join(map(quoted, i.columns))
        out.append(f"-- {i.kind} {i.name}: {quoted(i.table)} ({columns})" + (f" refers to {i.refer}" if i.refer else ""))
    return "\n".join(out)
