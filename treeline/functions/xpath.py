"""The XPath 1.0 core functions as Spark expressions. Empty node-sets are nulls."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F



def string_of_number(c: Column) -> Column:
    whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
    return F.when(F.isnan(c), "NaN").when(c == math.inf, "Infinity").when(c == -math.inf, "-Infinity").when(whole, c.cast("bigint").cast("string")).otherwise(c.cast("string"))


def number_of_string(c: Column) -> Column:
    t = F.trim(F.regexp_replace(c, r"[ \t\r\n]+", " "))
    return F.coalesce(F.when(t.rlike(r"^-?(\d+(\.\d*)?|\.\d+)$"), t).try_cast("double"), F.lit(float("nan")))


def number_of_boolean(c: Column) -> Column:
    return F.when(c, 1.0).otherwise(0.0)


def string_of_boolean(c: Column) -> Column:
    return F.when(c, "true").otherwise("false")


def boolean_of_number(c: Column) -> Column:
    return (c != 0.0) & ~F.isnan(c)


def starts_with(a: Column, b: Column) -> Column:
    return F.startswith(a, b)


def contains(a: Column, b: Column) -> Column:
    return F.contains(a, b)


def substring_before(a: Column, b: Column) -> Column:
    at = F.position(b, a)
    return F.when(at > 0, F.substring(a, F.lit(1), at - 1)).otherwise("")


def substring_after(a: Column, b: Column) -> Column:
    at = F.position(b, a)
    return F.when(at > 0, F.substring(a, at + F.length(b), F.length(a))).otherwise("")


def half_up(c: Column) -> Column:
    """XPath's round: halves go up."""
    return F.when(F.isnan(c) | (F.abs(c) == math.inf), c).otherwise(F.floor(c + 0.5).cast("double"))


def substring(a: Column, start: Column, length: Column | None = None) -> Column:
    """Signs at positions from round(start), fewer than round(start) + round(length); positions count from 1."""
    s = half_up(start)
    end = s + half_up(length) if length is not None else F.lit(math.inf)
    first = F.greatest(s, F.lit(1.0))
    last = F.least(end, F.length(a) + F.lit(1.0))
    ok = ~F.isnan(s) & ~F.isnan(end) & (last > first)
    return F.when(ok, F.substring(a, F.when(ok, first).cast("int"), F.when(ok, last - first).cast("int"))).otherwise("")


def normalize_space(a: Column) -> Column:
    return F.trim(F.regexp_replace(a, r"[ \t\r\n]+", " "))


def translate(a: Column, from_: str, to: str) -> Column:
    return F.translate(a, from_, to)


def floor(c: Column) -> Column:
    return F.when(F.isnan(c) | (F.abs(c) == math.inf), c).otherwise(F.floor(c).cast("double"))


def ceiling(c: Column) -> Column:
    return F.when(F.isnan(c) | (F.abs(c) == math.inf), c).otherwise(F.ceil(c).cast("double"))


def divide(a: Column, b: Column) -> Column:
    """Division of floating numbers: by zero it is infinite or no number."""
    return F.when(b != 0.0, F.try_divide(a, b)).when((a == 0.0) | F.isnan(a) | F.isnan(b), F.lit(float("nan"))).when(a > 0, F.lit(math.inf)).otherwise(F.lit(-math.inf))


def modulo(a: Column, b: Column) -> Column:
    """Remainder with the sign of the dividend."""
    return F.when(b == 0.0, F.lit(float("nan"))).otherwise(F.try_mod(a, b))
