"""Small expression helpers shared by the other function modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# White space as web text uses it, Unicode spaces included. Java's \s is ASCII
# only, so the class is spelled out.
_WIDE_SPACE = r"\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
SPACE = r"\t\n\x0B\f\r " + _WIDE_SPACE
# The same class, written so that other ASCII characters are refused after two comparisons.
WS = rf"[\t-\r [\x{{A0}}-\x{{FEFF}}&&[{_WIDE_SPACE}]]]"
# And as plain characters: trimming them is many times faster than a pattern.
SPACE_MARKS = ("\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
               "\u2028\u2029\u202f\u205f\u3000\ufeff")

ASTRAL = r"[\x{10000}-\x{10FFFF}]"


def trim_text(text: Column) -> Column:
    """Strip leading and trailing white space of any kind."""
    return F.btrim(text, F.lit(SPACE_MARKS))


def squeeze(text: Column) -> Column:
    """Turn every run of white space into one space and strip the ends.

    Single plain spaces, by far the most common run, are left where they are, and
    the wide class, slow to match, is only tried on texts that may need it.
    """
    def run(t: Column) -> Column:
        maybe_wide = (F.octet_length(t) > F.length(t)) & (t.contains("\u00a0") | t.rlike(r"[\x{1680}-\x{FEFF}]"))
        narrow = F.when(maybe_wide, F.regexp_replace(t, rf"[\x{{A0}}-\x{{FEFF}}&&[{_WIDE_SPACE}]]", " ")).otherwise(t)
        return F.trim(F.regexp_replace(narrow, r"[\t-\r][\t-\r ]*| [\t-\r ]+", " "))

    return let(text, run)


def present(text: Column) -> Column:
    """The text, or null when it is empty."""
    return F.when(text != "", text)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it many times in `body`."""
    return F.element_at(F.transform(F.array(value), body), 1)


def compute_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add (or replace) costly columns so that later filters read their values.

    A filter on a plain projected column is pushed below the projection and
    evaluates the expression a second time; it cannot pass a generator.
    """
    packed = F.struct(*[value.alias(name) for name, value in columns.items()])
    kept = [c for c in df.columns if c not in columns]
    wide = df.select(*kept, F.explode(F.array(packed)).alias("_computed"))
    return wide.select(*kept, "_computed.*")


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units, the unit the stored column limits count in."""
    extra = F.when(text.rlike(ASTRAL), F.regexp_count(text, F.lit(ASTRAL))).otherwise(0)
    return F.length(text) + extra


def truncate(text: Column, n: int) -> Column:
    """The first `n` UTF-16 units of the text, never splitting a character."""
    head = F.substring(text, 1, n)
    wide = F.substring(F.encode(head, "UTF-16BE"), 1, 2 * n)
    last = F.hex(F.substring(wide, 2 * n - 1, 1))
    whole = F.when(last.between("D8", "DB"), F.substring(wide, 1, 2 * (n - 1))).otherwise(wide)
    return F.when(head.rlike(ASTRAL), F.decode(whole, "UTF-16BE")).otherwise(head)
