"""String expressions. Everything returns a ``Column`` built from JVM-side functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# White space as Python's str.strip() knows it, level words, block-id pattern, cut lengths.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
LEVEL_WORDS = ("INFO", "WARN", "WARNING", "ERROR", "FATAL", "DEBUG", "TRACE", "CRITICAL")
BLOCK_ID = r"(blk_-?\d+)"
PROMPT_CUT = 200

_WORD = r"[\p{L}\p{N}_]"


def compute_once(df: DataFrame, name: str, expensive: Column) -> DataFrame:
    """Add a column that is evaluated once per row.

    Catalyst copies an expression into every filter pushed below its projection; a filter on the
    output of a generator stays above it. Use it for patterns whose result is filtered on.
    """
    return df.select("*", F.explode_outer(F.array(expensive)).alias(name))


def strip_ws(c: Column) -> Column:
    """Remove white space of any kind from both ends (Spark's ``trim`` only knows the blank)."""
    return F.btrim(c, F.lit(WHITESPACE))


def extract_or_null(c: Column, pattern: str, group: int = 1) -> Column:
    """First match of a capture group, NULL where the pattern does not occur."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def block_id(c: Column) -> Column:
    return extract_or_null(c, "(?U)" + BLOCK_ID)


def detect_level(c: Column) -> Column:
    """First level word standing alone (Unicode word boundaries), upper-cased, else NULL."""
    words = "|".join(LEVEL_WORDS)
    return F.upper(extract_or_null(c, rf"(?i)(?<!{_WORD})({words})(?!{_WORD})"))


def ellipsis(c: Column, limit: int = PROMPT_CUT) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("..."))).otherwise(c)


def plain_cut(c: Column, limit: int) -> Column:
    return F.substring(c, 1, limit)


def display_name(c: Column) -> Column:
    """Readable metric name; replacements run in this order, then every run of letters is capitalised."""
    for old, new in (("_", " "), ("pct", "%"), ("ms", "(ms)"), ("mbps", "(Mbps)"), ("rpm", "(RPM)")):
        c = F.replace(c, F.lit(old), F.lit(new))
    runs = F.regexp_extract_all(c, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.initcap(r)), "")


def words(c: Column) -> Column:
    """Lower-cased terms of three or more ASCII word characters that do not start with a digit.

    A term must be a whole run of (Unicode) word characters, so ``cafés`` gives nothing.
    """
    pattern = rf"(?<!{_WORD})[a-z_][a-z0-9_]{{2,}}+(?!{_WORD})"
    return F.regexp_extract_all(F.lower(c), F.lit(pattern), F.lit(0))


def literal_count(c: Column, needle: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    gone = F.length(c) - F.length(F.replace(c, F.lit(needle), F.lit("")))
    return F.try_divide(gone, F.lit(len(needle))).cast("long")
