"""Objects and their parts: trees, windows, functions, decompiled attributes, linked libraries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sql_text import every, first, from_list
from ..tables import stored


def tree(entries: DataFrame, library: str = "library", kind: str = "type_name", name: str = "name") -> DataFrame:
    """A line per library, kind and object with its ``depth``, in the order that a tree shows them."""
    label = F.when(F.grouping(kind) == 1, F.col(library)).when(F.grouping(name) == 1, F.col(kind)).otherwise(F.col(name))
    depth = 2 - F.grouping(kind).cast("int") - F.grouping(name).cast("int")
    rows = entries.rollup(library, kind, name).agg(F.count("*").alias("n"), label.alias("label"), depth.alias("depth"), F.grouping(library).alias("_g"))
    return rows.where("_g = 0").drop("_g").orderBy(library, F.asc_nulls_first(kind), F.asc_nulls_first(name))


def window_parts(text: Column) -> Column:
    """A window's ancestor, its controls with their types, and its events."""
    control = r"(?im)^[ \t]*type\s+(\w+)\s+from\s+(\w+)\s+within\s+\w+"
    controls = F.transform(every(text, f"({control})".replace("(\\w+)", "\\w+"), 1), lambda x: F.struct(F.regexp_extract(x, control, 1).alias("name"), F.regexp_extract(x, control, 2).alias("kind")))
    return F.struct(first(text, r"(?i)global\s+type\s+\w+\s+from\s+(\w+)").alias("ancestor"), controls.alias("controls"), F.array_distinct(every(text, r"(?im)^[ \t]*event\s+(\w+)")).alias("events"))


#: Words that look like calls but are not: fixed forms of the language.
NO_CALLS = ("if", "for", "while", "until", "case", "and", "or", "not", "return", "catch", "function", "subroutine", "event")


def function_parts(text: Column) -> Column:
    """A function's name, return type, parameters and the calls in it."""
    head = r"(?i)(?:function)\s+(\w+)\s+(\w+)\s*\(([^)]*)\)"
    calls = F.filter(F.array_distinct(F.transform(every(text, r"(\w+)\s*\("), lambda x: F.lower(x))), lambda x: ~x.isin(*NO_CALLS))
    parameters = F.filter(F.transform(F.split(F.coalesce(first(text, head, 3), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.struct(first(text, head, 2).alias("name"), first(text, head, 1).alias("return_type"), parameters.alias("parameters"), calls.alias("calls"))


def decompiled_report(text: Column) -> Column:
    """SQL (the first SELECT with a FROM, 2000 characters at most) and tables of a report object given as attributes."""
    sql = F.left(first(text, r'(?is)(select\s[^"]*?\sfrom\s[^"]*)'), F.lit(2000))
    return F.struct(sql.alias("sql"), from_list(F.coalesce(sql, F.lit(""))).alias("tables"))


def library_references(sources: DataFrame, library: str = "library", text_col: str = "text") -> DataFrame:
    """``(library, object)``: what sources of a library call, after ``of`` or ``from``."""
    return sources.select(library, F.explode(every(F.col(text_col), r"(?i)\b(?:of|from)\s+(\w+)")).alias("object"))


def linked_files(sources: DataFrame, files: DataFrame, key: str, text_col: str = "text", name: str = "name") -> DataFrame:
    """Libraries that a project object names, with the file of each; ``path`` is null where there is none."""
    names = sources.select(key, F.explode(F.array_distinct(F.transform(every(F.col(text_col), r"(?i)([\w$-]+\.pb[ld])"), lambda x: F.lower(x)))).alias("linked"))
    return names.join(files.select(F.lower(name).alias("linked"), "path"), "linked", "left").select(key, "linked", "path")


def project_libraries(start: DataFrame, links: DataFrame, files: DataFrame, key: str = "project") -> DataFrame:
    """Every library that a project's objects name, and those that objects of these name: ``key, library, version, error``.

    ``start(key, library)`` are the libraries a project begins with,
    ``links(library, linked)`` what objects of a library name, and
    ``files(library, version)`` the libraries at hand. Rounds end when no
    library is new; their tables are checkpointed. A library that is not at
    hand and a project of several versions carry an error.
    """
    low = lambda c: F.lower(F.col(c))
    known = stored(start.select(key, low("library").alias("library")).distinct())
    steps = links.select(low("library").alias("library"), low("linked").alias("linked")).distinct()
    front = known
    while not front.isEmpty():
        reached = front.join(steps, "library").select(key, F.col("linked").alias("library")).distinct()
        front = stored(reached.join(known, [key, "library"], "left_anti"))
        known = known.unionByName(front)
    held = stored(known).join(files.select(low("library").alias("library"), "version", F.lit(True).alias("_held")), "library", "left")
    versions = held.where("version is not null").groupBy(key).agg(F.count_distinct("version").alias("_versions"))
    error = F.when(F.col("_held").isNull(), "not found").when(F.col("_versions") > 1, "several versions")
    return held.join(versions, key, "left").select(key, "library", "version", error.alias("error"))


def review(files: DataFrame, findings: DataFrame, file_col: str = "path") -> DataFrame:
    """Objects, lines, report objects and files with findings, in one row; each side is aggregated before they meet."""
    k = F.lit(1).alias("k")
    a = files.agg(F.count_distinct("library").alias("libraries"), F.count("*").alias("objects"), F.sum("lines").alias("lines"), F.count_if(F.col("kind") == "datawindow").alias("reports"))
    b = findings.agg(F.count_distinct(file_col).alias("files_with_findings"), F.count("*").alias("findings"))
    return a.select("*", k).join(b.select("*", k), "k").drop("k")
