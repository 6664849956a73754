"""Full-text search with line positions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import with_lines

#: Kinds that a search may be limited to, their source extensions and aliases: fixed values of the format.
EXTENSION_OF_KIND = {
    "application": ".sra", "datawindow": ".srd", "window": ".srw", "menu": ".srm", "function": ".srf", "structure": ".srs",
    "userobject": ".sru", "query": ".srq", "pipeline": ".srp", "project": ".srj", "proxy": ".srx",
}
KIND_OF_ALIAS = {"DW": "datawindow", "WIN": "window", "UO": "userobject", "FUN": "function", "MENU": "menu", "STR": "structure", "APP": "application"}


def search_text(sources: DataFrame, query: str, case_sensitive: bool = False, text_col: str = "text") -> DataFrame:
    """The first hit of every line: ``line_no``, ``line``, ``match_start`` (1-based, in characters) and ``match_length``.

    One scan, no shuffle; texts without a hit are dropped before they are cut into lines.
    """
    fold = (lambda c: c) if case_sensitive else F.lower
    needle = query if case_sensitive else query.lower()
    hit = with_lines(sources.where(fold(F.col(text_col)).contains(needle)), text_col).where(fold(F.col("line")).contains(needle))
    return hit.withColumn("match_start", F.locate(needle, fold(F.col("line")))).withColumn("match_length", F.lit(len(needle)))


def search_regex(sources: DataFrame, pattern: str, case_sensitive: bool = True, text_col: str = "text") -> DataFrame:
    """Like :func:`search_text` for a regular expression, with the matched string; an invalid one raises when Spark compiles it."""
    p = pattern if case_sensitive else f"(?i){pattern}"
    hit = with_lines(sources.where(F.col(text_col).isNotNull()), text_col).where(F.col("line").rlike(p))
    matched = F.regexp_extract("line", p, 0)
    return hit.withColumn("match_start", F.regexp_instr("line", F.lit(p))).withColumn("matched", matched).withColumn("match_length", F.char_length("matched"))


def of_kind(sources: DataFrame, kind: str, kind_col: str) -> DataFrame:
    """Sources of one kind; an unknown kind gives no rows."""
    return sources.where(F.col(kind_col) == kind)


def kind_glob(alias: str) -> str:
    """File pattern of a kind or of its alias."""
    kind = KIND_OF_ALIAS.get(alias.upper(), alias.lower())
    return f"*{EXTENSION_OF_KIND.get(kind, '')}" if kind in EXTENSION_OF_KIND else "*"


def in_sql(line: Column) -> Column:
    """Whether a line speaks of a table."""
    return F.upper(line).rlike(r"(^|[^A-Z0-9_])(FROM|JOIN|INTO|UPDATE|TABLE)([^A-Z0-9_]|$)")


def defines_routine(line: Column, name: str) -> Column:
    """Whether a line declares the routine."""
    return line.rlike(rf"(?i)(subroutine|function)\s+(\w+\s+)?{re.escape(name)}\s*\(")


def glob_pattern(glob: str) -> str:
    """A regular expression for ``*``, ``?`` and ``[...]``, both in Java's and RE2's syntax."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        close = glob.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += "(.|\\n)*"
        elif c == "?":
            out += "(.|\\n)"
        elif close > 0:
            inner = glob[i + 1 : close]
            out += "[" + ("^" + inner[1:] if inner[0] == "!" else inner).replace("\\", "\\\\") + "]"
            i = close
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def glob_filter(df: DataFrame, column: str, glob: str) -> DataFrame:
    return df.where(F.col(column).rlike(glob_pattern(glob)))


def capped(hits: DataFrame, keys: list[str], most: int = 20) -> tuple[DataFrame, DataFrame]:
    """The first ``most`` hits by ``keys``, and one row saying how many more there are."""
    more = hits.agg(F.greatest(F.count("*") - most, F.lit(0)).alias("more"))
    return hits.orderBy(*keys).limit(most), more


def by_file(hits: DataFrame, keys: list[str]) -> DataFrame:
    """Hits counted for each file, with the first and last line."""
    return hits.groupBy(*keys).agg(F.count("*").alias("hits"), F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"))


def contains_any(df: DataFrame, needle: str, *cols: str) -> DataFrame:
    """Rows where any column contains the needle, in any case; the panels' live filter."""
    hit = F.lit(False)
    for c in cols:
        hit = hit | F.lower(F.col(c)).contains(needle.lower())
    return df.where(hit)
