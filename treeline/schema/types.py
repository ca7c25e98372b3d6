"""XML Schema built-in types: their Spark types, ranges, JSON types and the least common type of several."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_INT = {
    "byte": (-128, 127), "short": (-32768, 32767), "int": (-(1 << 31), (1 << 31) - 1), "long": (-(1 << 63), (1 << 63) - 1),
    "unsignedByte": (0, 255), "unsignedShort": (0, 65535), "unsignedInt": (0, (1 << 32) - 1), "unsignedLong": (0, (1 << 64) - 1),
    "integer": (None, None), "nonNegativeInteger": (0, None), "positiveInteger": (1, None), "nonPositiveInteger": (None, 0), "negativeInteger": (None, -1),
}
_SPARK = {
    "boolean": "boolean", "hexBinary": "binary", "base64Binary": "binary", "float": "float", "double": "double",
    "byte": "smallint", "short": "smallint", "int": "int", "long": "bigint",
    "unsignedByte": "int", "unsignedShort": "int", "unsignedInt": "bigint", "unsignedLong": "decimal(20,0)",
    "dateTime": "timestamp_ntz", "dateTimeStamp": "timestamp", "date": "date", "gYear": "date", "gYearMonth": "date",
}
TEXTS = (
    "string normalizedString token language Name NCName NMTOKEN NMTOKENS ID IDREF IDREFS ENTITY ENTITIES QName anyURI NOTATION anyType anySimpleType anyAtomicType "
    "duration yearMonthDuration dayTimeDuration time gMonth gMonthDay gDay"
).split()
LISTS = frozenset(("NMTOKENS", "IDREFS", "ENTITIES"))
BUILTIN = frozenset([*_INT, *_SPARK, "decimal", *TEXTS])
#: Chains along which numbers widen; the least common type is the first one that holds both.
_WIDER = [
    ["byte", "short", "int", "long", "integer", "decimal", "double"],
    ["unsignedByte", "unsignedShort", "unsignedInt", "unsignedLong", "nonNegativeInteger", "integer", "decimal", "double"],
    ["positiveInteger", "nonNegativeInteger", "integer", "decimal", "double"],
    ["negativeInteger", "nonPositiveInteger", "integer", "decimal", "double"],
    ["float", "double"],
    ["date", "dateTime"], ["dateTimeStamp", "dateTime"], ["gYear", "date"], ["gYearMonth", "date"],
    ["yearMonthDuration", "duration"], ["dayTimeDuration", "duration"],
    ["ID", "NCName", "Name", "token", "normalizedString", "string"], ["IDREF", "NCName"], ["ENTITY", "NCName"], ["NMTOKEN", "token"], ["language", "token"],
]


def spark_type(xs: str, facets: dict | None = None, *, integer: str = "int", decimal: str = "big") -> str:
    """Spark type of an XML Schema type. integer: int, bigint or decimal for unbounded integers; decimal: big, double or float."""
    facets = facets or {}
    if xs == "decimal":
        if decimal != "big":
            return decimal
        digits, scale = facets.get("totalDigits"), facets.get("fractionDigits")
        if digits is None and scale is None:
            return "decimal(38,18)"
        scale = int(scale if scale is not None else min(18, int(digits)))
        return f"decimal({min(38, int(digits) if digits is not None else 20 + scale)},{min(scale, 38)})"
    if xs in ("integer", "nonNegativeInteger", "positiveInteger", "nonPositiveInteger", "negativeInteger"):
        return {"int": "int", "bigint": "bigint", "decimal": "decimal(38,0)"}[integer]
    return _SPARK.get(xs, "string")


def int_range(xs: str) -> tuple[int | None, int | None] | None:
    return _INT.get(xs)


def is_number(xs: str) -> bool:
    return xs in _INT or xs in ("decimal", "float", "double")


def json_type(xs: str) -> str:
    return "boolean" if xs == "boolean" else "integer" if xs in _INT else "number" if is_number(xs) else "string"


def _supers(xs: str) -> list[str]:
    out, todo = [xs], [xs]
    while todo:
        x = todo.pop(0)
        for chain in _WIDER:
            if x in chain:
                for y in chain[chain.index(x) + 1 :]:
                    if y not in out:
                        out.append(y)
                        todo.append(y)
    return out


def common_type(kinds: list[str]) -> str:
    """Least type that holds the values of all kinds; string if there is none but text."""
    kinds = list(dict.fromkeys(kinds))
    if not kinds:
        return "string"
    shared = [x for x in _supers(kinds[0]) if all(x in _supers(k) for k in kinds[1:])]
    return shared[0] if shared else "string"


_ZONE = r"(Z|[+-]\d{2}:\d{2})$"


def parsed(text: Column, xs: str, facets: dict | None = None, **options: str) -> Column:
    """Value of a text, or null where it is not of the type. Text of white space only is null except for strings."""
    kind = spark_type(xs, facets, **options)
    if kind == "string":
        return text
    t = F.trim(text)
    if xs == "boolean":
        return F.when(t.isin("true", "1"), True).when(t.isin("false", "0"), False)
    if xs == "hexBinary":
        return F.when(t.rlike(r"^([0-9A-Fa-f]{2})*$"), F.unhex(t))
    if xs == "base64Binary":
        return F.try_to_binary(t, F.lit("base64"))
    if xs in ("float", "double"):
        return F.regexp_replace(F.regexp_replace(t, "^INF$", "Infinity"), "^-INF$", "-Infinity").try_cast(kind)
    if xs in _INT:
        low, high = _INT[xs]
        v = F.when(t.rlike(r"^[+-]?\d+$"), t).try_cast(kind)
        if _INT.get({"smallint": "short", "int": "int", "bigint": "long"}.get(kind)) == (low, high):
            # The Spark type has the same range, and a cast beyond it is null.
            return v
        wide = F.when(t.rlike(r"^[+-]?\d+$"), t).try_cast("decimal(38,0)")
        return F.when((wide >= low if low is not None else F.lit(True)) & (wide <= high if high is not None else F.lit(True)), v) if (low, high) != (None, None) else v
    if xs == "decimal":
        return F.when(t.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)$"), t).try_cast(kind)
    if xs == "date":
        return F.when(t.rlike(r"^-?\d{4,}-\d{2}-\d{2}" + f"({_ZONE[:-1]})?$"), F.regexp_replace(t, _ZONE, "")).try_cast("date")
    if xs == "gYear":
        return F.when(t.rlike(r"^\d{4}" + f"({_ZONE[:-1]})?$"), F.concat(F.substring(t, 1, 4), F.lit("-01-01"))).try_cast("date")
    if xs == "gYearMonth":
        return F.when(t.rlike(r"^\d{4}-\d{2}" + f"({_ZONE[:-1]})?$"), F.concat(F.substring(t, 1, 7), F.lit("-01"))).try_cast("date")
    if xs == "dateTime":
        return F.when(t.rlike(r"^-?\d{4,}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}"), F.when(F.length(t) == 19, t.try_cast("timestamp_ntz")).when(t.rlike(_ZONE), F.to_utc_timestamp(t.try_cast("timestamp"), F.current_timezone()).cast("timestamp_ntz")).otherwise(t.try_cast("timestamp_ntz")))
    return t.try_cast(kind)
