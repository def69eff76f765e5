"""Text and key normalisation as column expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that count as white space, as a regex class body.
SPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: What ends a line.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def trimmed(c: Column) -> Column:
    """c without white space of any kind at either end."""
    return F.regexp_replace(c, f"^[{SPACE}]+|[{SPACE}]+$", "")


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def folded(c: Column) -> Column:
    """Lower-cased, then only a-z and 0-9 kept; null stays null."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def label_key(c: Column) -> Column:
    """A name trimmed and lower-cased; blank counts as none (null)."""
    return blank_to_null(F.lower(trimmed(c)))


def commit_key(c: Column) -> Column:
    """A commit id of 12 or 40 hex digits, trimmed and lower-cased; anything else and all zeros count as none."""
    key = F.lower(trimmed(c))
    return F.when(key.rlike("^([0-9a-f]{12}|[0-9a-f]{40})$") & ~key.rlike("^0+$"), key)


def number_key(c: Column, decimal_zero: bool = False) -> Column:
    """A whole number above zero as its digits without leading zeros, of any length; otherwise none. decimal_zero: a trailing .0 is allowed."""
    key = trimmed(c)
    if decimal_zero:
        key = F.regexp_replace(key, r"\.0$", "")
    return blank_to_null(F.when(key.rlike("^[0-9]+$"), F.regexp_replace(key, "^0+", "")))


def cwe_class(c: Column) -> Column:
    """CWE- and the first run of digits, without leading zeros, of the first entry with digits; none without one."""
    entry = F.get(F.filter(c, lambda x: x.rlike("[0-9]")), F.lit(0))
    return F.coalesce(F.concat(F.lit("CWE-"), F.regexp_extract(entry, "0*([0-9]+)", 1)), F.lit("none"))


def lines(c: Column) -> Column:
    return F.split(c, LINE_END)
