"""Reports as rows: every line of a Markdown, HTML or JSON report with its place, made by the tasks that hold what it shows."""

from __future__ import annotations

import html
import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import aggregates, graph, rules
from ..tables import stored


@dataclass
class Section:
    """A table of a report, and what its rows are ordered by."""

    rows: DataFrame
    order: list


def numbered(rows: DataFrame, order: list, name: str = "place") -> DataFrame:
    """``rows`` with their number from 1 in the given order.

    The rows are dealt out in ranges and numbered within each; only the
    ranges' sizes meet. So a report may list as many rows as there are.
    """
    columns = rows.columns
    ranged = stored(rows.repartitionByRange(*order).select("*", F.spark_partition_id().alias("_part")))
    sizes = ranged.groupBy(F.col("_part").alias("_of")).agg(F.count("*").alias("_n"))
    before = sizes.select("_of", F.coalesce(F.sum("_n").over(Window.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = ranged.withColumn("_k", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    return within.join(F.broadcast(before), F.col("_part") == F.col("_of")).select(*columns, (F.col("_before") + F.col("_k")).alias(name))


def _text(c: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), r"\r?\n", " ")


def _markdown_row(columns: list[str]) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.replace(_text(c), F.lit("|"), F.lit("\\|")) for c in columns]), F.lit(" |"))


def _html_row(columns: list[str]) -> Column:
    def cell(c: str) -> Column:
        v = _text(c)
        for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
            v = F.replace(v, F.lit(plain), F.lit(safe))
        return F.concat(F.lit("<td>"), v, F.lit("</td>"))

    return F.concat(F.lit("<tr>"), *map(cell, columns), F.lit("</tr>"))


def _json_row(columns: list[str]) -> Column:
    comma = F.when(F.col("place") > 1, ",").otherwise("")
    return F.concat(comma, F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]), {"ignoreNullFields": "false"}))


def _around(form: str, title: str, name: str, columns: list[str], first: bool) -> tuple[list[str], list[str]]:
    """Lines in front of a section's rows, and behind them."""
    if form == "markdown":
        return ([f"# {title}", ""] if first else []) + [f"## {name}", "", "| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)], [""]
    if form == "html":
        head = [f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>"] if first else []
        return head + [f"<h2>{html.escape(name)}</h2><table><tr>{''.join(f'<th>{html.escape(c)}</th>' for c in columns)}</tr>"], ["</table>"]
    key = json.dumps(name, ensure_ascii=False)
    return ([f'{{"title":{json.dumps(title, ensure_ascii=False)}'] if first else []) + [f",{key}:["], ["]"]


def rendered(title: str, sections: dict[str, Section], form: str = "markdown") -> DataFrame:
    """``(section, part, place, line)``: the whole report as ``markdown``, ``html`` or ``json``.

    Sorted by the first three, the lines are the report; :func:`write_report`
    writes them so. ``part`` is 0 in front of a section's rows, 1 for its
    rows, 2 behind them. Values are escaped as the form asks; line breaks in
    them become blanks, nulls are empty (null in JSON). No section is cut, and
    nothing comes to the driver.
    """
    row = {"markdown": _markdown_row, "html": _html_row, "json": _json_row}[form]
    parts, fixed = [], []
    for i, (name, s) in enumerate(sections.items()):
        before, behind = _around(form, title, name, s.rows.columns, i == 0)
        if form == "json" and i + 1 == len(sections):
            behind = [*behind, "}"]
        fixed += [(i, part, k + 1, line) for part, lines in ((0, before), (2, behind)) for k, line in enumerate(lines)]
        listed = numbered(s.rows, s.order)
        parts.append(listed.select(F.lit(i).alias("section"), F.lit(1).alias("part"), F.col("place").cast("long").alias("place"), row(s.rows.columns).alias("line")))
    spark = parts[0].sparkSession
    return reduce(lambda a, b: a.unionByName(b), parts, spark.createDataFrame(fixed, "section int, part int, place long, line string"))


def write_report(lines: DataFrame, folder: str) -> None:
    """Text files whose names are in the order of the report's lines."""
    lines.orderBy("section", "part", "place").select("line").write.mode("overwrite").text(folder)


# -- the reports of a project: which tables each one shows -------------------------------------


def review_sections(objects: DataFrame, findings: DataFrame, reports: DataFrame, dependencies: DataFrame, advice: DataFrame, most: int = 30) -> dict[str, Section]:
    """Review: ``objects(library, kind, lines)``, findings of line rules, report objects with ``name, style, tables, columns, sql``, library dependencies, suggestions. The first findings and the most used tables are ``most``."""
    kinds = objects.groupBy("kind").agg(F.count("*").alias("objects"), F.sum("lines").alias("lines"))
    libraries = objects.groupBy("library").agg(F.count("*").alias("objects"), F.count_distinct("kind").alias("kinds"))
    used = aggregates.usage_counts(reports.select("name", F.explode("tables").alias("table")), "table", "name").orderBy(F.desc("n"), "table").limit(most)
    listed = reports.select("name", "style", F.concat_ws(", ", "tables").alias("tables"), F.size("columns").alias("columns"), F.col("sql").isNotNull().alias("has_sql"))
    place = ["name", "line_no", "rule"]
    return {
        "Objects": Section(kinds, ["kind"]),
        "Libraries": Section(libraries, ["library"]),
        "Findings by rule": Section(rules.by_rule(findings, "name"), [F.desc("n"), "rule", "severity"]),
        "First findings": Section(findings.orderBy(*place).limit(most), place),
        "Tables": Section(used, [F.desc("n"), "table"]),
        "Report objects": Section(listed, ["name"]),
        "Dependencies": Section(dependencies, ["src_library", "dst_library"]),
        "Suggestions": Section(advice, ["suggestion"]),
    }


def refactoring_sections(findings: DataFrame) -> dict[str, Section]:
    """Refactoring: findings by severity and by rule, and each of them; the rules run once."""
    findings = stored(findings)
    each = findings.select("name", "line_no", "rule", "severity")
    return {"By severity": Section(rules.by_severity(findings), ["severity"]), "By rule": Section(rules.by_rule(findings, "name"), [F.desc("n"), "rule", "severity"]), "Findings": Section(each, ["name", "line_no", "rule"])}


def snapshot_sections(snapshot_id: str, label: str, changes: DataFrame) -> dict[str, Section]:
    """Manifest of a snapshot: changes by status, and every changed path."""
    head = changes.sparkSession.createDataFrame([(snapshot_id, label)], "id string, label string")
    return {"Snapshot": Section(head, ["id"]), "Changes": Section(changes.groupBy("status").agg(F.count("*").alias("files")), ["status"]), "Files": Section(changes.select("path", "status"), ["status", "path"])}


def analysis_sections(objects: DataFrame, findings: DataFrame, routines: DataFrame, inheritance: DataFrame, edges: DataFrame) -> dict[str, Section]:
    """Analysis: totals, kinds, findings by object, complex routines of each ``object``, inheritance, what each object depends on. The rules run once."""
    findings = stored(findings)
    return {
        "Summary": Section(rules.quality_summary(objects, findings), ["objects"]),
        "Objects": Section(objects.groupBy("kind").agg(F.count("*").alias("objects")), [F.desc("objects"), "kind"]),
        "Findings": Section(rules.by_object(findings, ["name"]), ["name"]),
        "Complex routines": Section(aggregates.complex_routines(routines, ["object"]), [F.desc("cc"), "object", "name"]),
        "Inheritance": Section(inheritance, ["child", "parent"]),
        "Dependencies": Section(edges.select("src", "dst").distinct(), ["src", "dst"]),
    }


def report_object_sections(reports: DataFrame, users: DataFrame) -> dict[str, Section]:
    """Report objects: their SQL, the tables and columns they read, and the scripts that use them."""
    schema = graph.table_schema(reports).withColumn("reports", F.concat_ws(", ", "reports"))
    listed = reports.select("name", "style", F.concat_ws(", ", "tables").alias("tables"))
    return {"Report objects": Section(listed, ["name"]), "Tables": Section(schema, ["table", "column"]), "Used by": Section(users.select("name", F.concat_ws(", ", "used_by").alias("used_by")), ["name"])}


def sql_listing(reports: DataFrame) -> DataFrame:
    """Only the SQL of report objects, a text each with its name in front."""
    return reports.where("sql is not null").select(F.concat(F.lit("-- "), "name", F.lit("\n"), "sql", F.lit(";\n")).alias("value"))


def export_sources(sources: DataFrame, folder: str, by: list[str]) -> None:
    """Texts written as Parquet below a folder for each value of ``by``, such as library and kind."""
    sources.write.mode("overwrite").partitionBy(*by).parquet(folder)


def export_manifest(sources: DataFrame, folder: str, keys: list[str]) -> None:
    """A JSON line for every exported object."""
    sources.select(*keys).write.mode("overwrite").json(folder)
