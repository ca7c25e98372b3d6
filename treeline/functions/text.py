"""Text functions of the loaders and writers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

XML_ENTITIES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"))


def xml_escape(c: Column) -> Column:
    for a, b in XML_ENTITIES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def collapse_space(c: Column) -> Column:
    """XML white space runs become one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"[ \t\r\n]+", " "))


def replace_space(c: Column) -> Column:
    return F.translate(c, "\t\r\n", "   ")


def escape_tsv(c: Column) -> Column:
    """Backslash, newline, carriage return and tab as two signs; null is \\N."""
    for a, b in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.coalesce(c, F.lit("\\N"))


def unescape_tsv(c: Column) -> Column:
    """Two backslashes are one, read from the left; what is between such pairs has the other escapes."""

    def plain(x: Column) -> Column:
        for a, b in (("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t")):
            x = F.replace(x, F.lit(a), F.lit(b))
        return x

    return F.when(c != "\\N", F.array_join(F.transform(F.split(c, r"\\\\", -1), plain), "\\"))


def trigrams(word: Column) -> Column:
    """All runs of three signs of the word between two underscores on both sides."""
    padded = F.concat(F.lit("__"), word, F.lit("__"))
    return F.transform(F.sequence(F.lit(1), F.length(word) + 2), lambda i: F.substring(padded, i, F.lit(3)))


def tokens(c: Column, least: int = 1) -> Column:
    """Lower-case words of letters and digits with at least so many signs."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= least)


def first_word(text: str) -> str:
    """The first run of letters and digits of a Python string."""
    m = re.search(r"[^\W_]+", text)
    return m.group() if m else ""
