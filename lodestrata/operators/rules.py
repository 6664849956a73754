"""Quality rules: a rule is a predicate, a severity and a message; any number of rules cost one scan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sql_text, text

# Names and marks that the line rules look for: fixed values.
DEPRECATED_NAMES = ("RegistryGet", "RegistrySet", "GetEnvironment", "SetEnvironment", "PrintScreen", "PrintBitmap", "Send", "Post", "SetPointer", "SetMicroHelp", "TriggerEvent", "dw_1.Describe")
CONNECTION_MARKS = ("SQLCA.DBMS", "SQLCA.Database", "SQLCA.ServerName", "SQLCA.LogId", "SQLCA.DBPass", "SQLCA.LogPass", "SQLCA.AutoCommit", "Connect;", "UID=", "PWD=", "DSN=", "DRIVER=", "PROVIDER=", "DATASOURCE=")
#: The shorter lists of the review.
REVIEW_DEPRECATED = ("RegistryGet", "RegistrySet", "GetEnvironment", "SetEnvironment", "PrintScreen", "SetPointer", "SetMicroHelp", "TriggerEvent")
REVIEW_CONNECTION = ("SQLCA.DBMS", "SQLCA.Database", "SQLCA.ServerName", "SQLCA.LogId", "SQLCA.DBPass", "SQLCA.LogPass", "UID=", "PWD=", "DSN=", "DRIVER=")
# Calls inside routines that are out of date: fixed names.
DEPRECATED_CALLS = (
    (r"(?i)\bSetPointer\b", "SetPointer: assign the pointer as a property of the object"),
    (r"(?i)\bYield\(\)", "Yield(): let a timer event drive the work"),
    (r"(?i)\bDoEvents\b", "DoEvents: let a timer event drive the work"),
    (r"(?i)\bRGB\b(?!\s*\()", "RGB: name the colour by a constant"),
    (r"(?i)\bSetRedraw\b", "SetRedraw: switch redrawing by the property"),
)

# A line of a CATCH that does nothing: blank, or a comment; and a CATCH of nothing else.
_BODY = r"(?:[ \t]*(?://[^\n]*)?\r?\n)"
EMPTY_CATCH = rf"(?im)^[ \t]*catch\b[^\n]*\n{_BODY}*[ \t]*end[ \t]+try\b"


@dataclass(frozen=True)
class Rule:
    """``predicate`` and ``message`` take the column that the rule judges."""

    name: str
    severity: str
    predicate: Callable[[Column], Column]
    message: Callable[[Column], Column] = field(default=lambda c: F.lit(""))


def holds_any(line: Column, marks: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for m in marks:
        found = found | line.contains(m)
    return found


def first_mark(line: Column, marks: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.when(line.contains(m), F.lit(m)) for m in marks])


def _sql_line(line: Column) -> Column:
    u = F.upper(line)
    return (u.contains("SELECT ") & u.contains(" FROM ")) | (u.contains("INSERT ") & u.contains(" INTO ")) | (u.contains("UPDATE ") & u.contains(" SET ")) | (u.contains("DELETE ") & u.contains(" FROM "))


def review_rules() -> list[Rule]:
    """The line rules with the review's shorter lists."""
    return line_rules(REVIEW_DEPRECATED, REVIEW_CONNECTION)


def line_rules(deprecated: tuple[str, ...] = DEPRECATED_NAMES, connection: tuple[str, ...] = CONNECTION_MARKS) -> list[Rule]:
    """The rules on single lines."""
    return [
        Rule("LONG_LINE", "info", lambda x: F.octet_length(x) > 200, lambda x: F.concat(F.octet_length(x).cast("string"), F.lit(" bytes"))),
        Rule("GOTO_USAGE", "warning", lambda x: F.upper(x).contains("GOTO ") | F.upper(x).contains(" GOTO")),
        Rule("TODO_FIXME", "info", lambda x: F.upper(x).rlike("TODO|FIXME|HACK")),
        Rule("HARDCODED_CONN", "warning", lambda x: holds_any(x, connection), lambda x: first_mark(x, connection)),
        Rule("DEPRECATED_API", "warning", lambda x: holds_any(x, deprecated), lambda x: first_mark(x, deprecated)),
        Rule("GLOBAL_VAR", "info", lambda x: F.upper(x).contains("GLOBAL ") & ~F.upper(x).contains("GLOBAL FUNCTION") & ~F.upper(x).contains("GLOBAL SUBROUTINE")),
        Rule("HARDCODED_SQL", "warning", _sql_line),
    ]


def panel_rules() -> list[Rule]:
    """The rules of the refactoring panel."""
    return [
        Rule("LONG_LINE", "style", lambda x: F.octet_length(x) > 200),
        Rule("DEEP_INDENT", "complexity", lambda x: (text.indent_width(x) >= 20) & (text.stripped(x) != "")),
        Rule("TODO_COMMENT", "dead_code", lambda x: text.stripped(x).startswith("//") & F.upper(x).rlike("TODO|FIXME|HACK")),
        Rule("DEPRECATED_API", "naming", lambda x: F.lower(x).contains("setmicrohelp(")),
        Rule("HARDCODED_CONN", "style", lambda x: F.lower(x).contains("dbms=") & F.lower(x).contains("database=")),
    ]


def apply_rules(rows: DataFrame, column: str, rules: list[Rule], keep: list[str]) -> DataFrame:
    """A row per finding: ``keep``, ``rule``, ``severity``, ``message``."""
    c = F.col(column)
    marks = F.array(*[F.when(r.predicate(c), F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), r.message(c).alias("message"))) for r in rules])
    # Nulls go after the explosion: a filter on the array would be pushed down and judge every rule twice.
    return rows.select(*keep, F.explode(marks).alias("_finding")).where(F.col("_finding").isNotNull()).select(*keep, "_finding.*")


def lint_lines(sources: DataFrame, keys: list[str], rules: list[Rule] | None = None, text_col: str = "text") -> DataFrame:
    """Findings of the line rules: ``keys``, ``line_no``, ``rule``, ``severity``, ``message``."""
    return apply_rules(text.with_lines(sources.select(*keys, text_col), text_col), "line", rules or line_rules(), [*keys, "line_no"])


def empty_catches(sources: DataFrame, keys: list[str], text_col: str = "text", least: int = 10) -> DataFrame:
    """EMPTY_CATCH: fewer than ``least`` bytes, trimmed, between a CATCH and its END TRY; the line of the CATCH.

    Every CATCH is marked with its line number before the text is cut at the
    marks, so a text is read a fixed number of times however many it has.
    """
    plain = F.translate(F.upper(F.col(text_col)), "\x01\x02", "  ")
    marked = F.transform(F.split(plain, "\n"), lambda x, i: F.regexp_replace(x, F.lit(r"\bCATCH\b"), F.concat(F.lit("\x01"), (i + 1).cast("string"), F.lit("\x02"))))
    found = sources.select(*keys, F.explode(F.split(F.array_join(marked, "\n"), "\x01")).alias("_part")).where(F.col("_part").contains("\x02"))
    inside = text.stripped(F.regexp_extract("_part", r"(?s)\x02(.*?)\bEND TRY\b", 1))
    hit = found.where(F.col("_part").rlike(r"\bEND TRY\b") & (F.octet_length(inside) < least))
    return hit.select(*keys, F.substring_index("_part", "\x02", 1).cast("int").alias("line_no"), F.lit("EMPTY_CATCH").alias("rule"), F.lit("warning").alias("severity"), F.lit("").alias("message"))


def routine_rules(longest: int = 200, deepest: int = 4, most_complex: int = 20) -> list[Rule]:
    """The rules on a routine as :func:`lint_routines` puts it: a struct with the routine's columns and its measures."""
    words = lambda c: c.cast("string")
    rules = [
        Rule("routine_too_long", "warning", lambda r: r["code_lines"] > longest, lambda r: F.concat(words(r["code_lines"]), F.lit(" lines"))),
        Rule("empty_catch", "error", lambda r: r["script"].rlike(EMPTY_CATCH)),
        Rule("deep_nesting", "warning", lambda r: r["nesting"] > deepest, lambda r: F.concat(F.lit("depth "), words(r["nesting"]))),
        Rule("magic_numbers", "info", lambda r: F.size(r["numbers"]) > 0, lambda r: F.array_join(F.slice(r["numbers"], 1, 5), ", ")),
        Rule("hardcoded_sql", "warning", lambda r: sql_text.hardcoded_sql(r["script"])),
        Rule("no_error_handling", "info", lambda r: r["return_type"].isNotNull() & ~r["is_event"] & ~F.lower(r["script"]).contains("try")),
        Rule("high_complexity", "warning", lambda r: r["cc"] > most_complex, lambda r: F.concat(words(r["cc"]), F.lit(" "), text.rating(r["cc"]))),
    ]
    return rules + [Rule("deprecated_function", "warning", lambda r, p=p: r["script"].rlike(p), lambda r, a=a: F.lit(a)) for p, a in DEPRECATED_CALLS]


def lint_routines(routines: DataFrame, keys: list[str], rules: list[Rule] | None = None) -> DataFrame:
    """Findings of the routine rules on ``name, script, return_type, is_event``; complexity, nesting, code lines and numbers are measured once for all rules."""
    script = F.col("script")
    measures = [text.code_lines(script).alias("code_lines"), text.max_nesting(script).alias("nesting"), text.complexity(script).alias("cc"), text.magic_numbers(script).alias("numbers")]
    packed = routines.select(*keys, "name", F.struct("name", "script", "return_type", "is_event", *measures).alias("_r"))
    return apply_rules(packed, "_r", rules or routine_rules(), [*keys, "name"])


def lint_objects(sources: DataFrame, keys: list[str], text_col: str = "text", kind_col: str = "kind") -> DataFrame:
    """select_star: a report object that selects all columns."""
    star = (F.col(kind_col) == "datawindow") & F.col(text_col).rlike(r"(?i)\bSELECT\s+\*")
    return sources.where(star).select(*keys, F.lit("select_star").alias("rule"), F.lit("warning").alias("severity"), F.lit("").alias("message"))


def lint_variables(variables: DataFrame, keys: list[str]) -> DataFrame:
    """global_variable, on ``name, data_type, access``."""
    message = F.concat("name", F.lit(" ("), "data_type", F.lit(")"))
    return variables.where(F.col("access") == "global").select(*keys, F.lit("global_variable").alias("rule"), F.lit("info").alias("severity"), message.alias("message"))


def chosen_rules(config: dict) -> list[Rule]:
    """The routine rules under a project's settings: its thresholds, and its lists of enabled and disabled rules."""
    limits, lists = config["thresholds"], config["rules"]
    rules = routine_rules(limits["routine_lines"], limits["nesting"], limits["complexity"])
    return [r for r in rules if (lists["enabled"] is None or r.name in lists["enabled"]) and r.name not in lists["disabled"]]


class Registry:
    """Rules by name, for a user's own ones; ``enabled`` and ``disabled`` lists choose among them."""

    def __init__(self, rules: list[Rule] = ()):  # type: ignore[assignment]
        self.rules = {r.name: r for r in rules}

    def register(self, rule: Rule) -> None:
        self.rules[rule.name] = rule

    def chosen(self, enabled: list[str] | None = None, disabled: list[str] = ()) -> list[Rule]:  # type: ignore[assignment]
        return [r for n, r in self.rules.items() if (enabled is None or n in enabled) and n not in disabled]


# -- counts and suggestions -----------------------------------------------------


def by_severity(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count("*").alias("n"))


def by_rule(findings: DataFrame, file_col: str, most: int | None = None) -> DataFrame:
    """Findings and files of each rule, most frequent first."""
    counted = findings.groupBy("rule", "severity").agg(F.count("*").alias("n"), F.count_distinct(file_col).alias("files"))
    return counted.orderBy(F.desc("n"), "rule").limit(most) if most else counted


def by_object(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Findings of each object by severity, and their sum."""
    each = [F.count_if(F.col("severity") == s).alias(s) for s in ("error", "warning", "info")]
    return findings.groupBy(*keys).agg(*each, F.count("*").alias("findings"))


def quality_summary(objects: DataFrame, findings: DataFrame) -> DataFrame:
    """Objects, findings and findings of each severity in one row; each side is aggregated before they meet."""
    k = F.lit(1).alias("k")
    a = objects.agg(F.count("*").alias("objects"))
    b = findings.agg(F.count("*").alias("findings"), *[F.count_if(F.col("severity") == s).alias(s) for s in ("error", "warning", "info")])
    return a.select("*", k).join(b.select("*", k), "k").drop("k")


#: A rule is worth a suggestion beyond so many findings, a library beyond so many objects: fixed values.
SUGGESTED_BEYOND = {"GOTO_USAGE": 5, "GLOBAL_VAR": 10, "EMPTY_CATCH": 0, "HARDCODED_SQL": 0, "HARDCODED_CONN": 0}
LARGE_LIBRARY = 100


def beyond(counted: DataFrame, column: str, limit: int) -> DataFrame:
    """Rows whose count is above a limit."""
    return counted.where(F.col(column) > limit)


def suggestions(findings: DataFrame, library_sizes: DataFrame | None = None, reports: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """``(suggestion, n)`` where counts pass their thresholds, ``clean`` if none does.

    ``library_sizes(library, objects)`` adds libraries to split,
    ``reports(tables)`` the reports in which no table was found, and
    ``files(ext)`` a project of nothing but compiled files.
    """
    limit = F.create_map(*[F.lit(x) for pair in SUGGESTED_BEYOND.items() for x in pair])
    counted = findings.where(F.col("rule").isin(*SUGGESTED_BEYOND)).groupBy("rule").agg(F.count("*").alias("n")).where(F.col("n") > limit[F.col("rule")])
    out = counted.select(F.col("rule").alias("suggestion"), "n")
    if library_sizes is not None:
        out = out.unionByName(beyond(library_sizes, "objects", LARGE_LIBRARY).select(F.concat(F.lit("split "), "library").alias("suggestion"), F.col("objects").alias("n")))
    if reports is not None:
        out = out.unionByName(reports.agg(F.count_if(F.coalesce(F.size("tables"), F.lit(0)) <= 0).alias("n")).where("n > 0").select(F.lit("reports without tables").alias("suggestion"), "n"))
    if files is not None:
        kinds = files.agg(F.count_if(F.col("ext") == "pbl").alias("source"), F.count_if(F.col("ext").isin("pbd", "exe")).alias("n"))
        out = out.unionByName(kinds.where("source = 0 and n > 0").select(F.lit("only compiled files").alias("suggestion"), "n"))
    none = out.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("clean").alias("suggestion"), "n")
    return out.unionByName(none)


# -- fixes ------------------------------------------------------------------------

#: The line that goes into a catch that handles nothing: a fixed value.
LOG_LINE = "// TODO: log error - SQLCA.SQLErrText"


def _seen_catch(log: str) -> str:
    """A CATCH that holds nothing or comments alone, and not the line."""
    return rf"(?im)^([ \t]*)(catch\b[^\n]*\n(?:(?![ \t]*\Q{log}\E){_BODY})*)([ \t]*end[ \t]+try\b)"


def fix_empty_catches(sources: DataFrame, text_col: str = "text", log: str = LOG_LINE) -> DataFrame:
    """``fixed_text``, ``fixes`` and, where something was fixed, ``backup`` with the old text.

    A line, indented as the CATCH is, goes in front of the END TRY of every
    CATCH that holds nothing or comments alone; by default it is a comment, so
    the program runs as before. A CATCH that has the line already is left as
    it is.
    """
    t, quoted, seen = F.col(text_col), "".join("\\" + c if c in "\\$" else c for c in log), _seen_catch(log)
    fixed = F.regexp_replace(t, seen, f"$1$2$1{quoted}\n$3")
    return sources.withColumn("fixed_text", fixed).withColumn("fixes", F.regexp_count(t, F.lit(seen))).withColumn("backup", F.when(fixed != t, t))


def _details(rule: str, severity: str, details: Column) -> Column:
    """Fixes as an array of ``rule, severity, detail`` from an array of details."""
    return F.transform(details, lambda x: F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), x.alias("detail")))


def _only_if(held: Column, detail: Column) -> Column:
    return F.when(held, F.array(detail))


# What the rules on whole texts propose, as arrays of details, so that one scan serves them all.


def _stars(t: Column, kind: Column) -> Column:
    return _details("fix_select_star", "manual", _only_if((kind == "datawindow") & t.rlike(r"(?i)\bSELECT\s+\*"), F.lit("list the columns")))


def _numbers(t: Column, most: int = 10) -> Column:
    found = F.regexp_extract_all(t, F.lit(r"(?<![\w.])[0-9]{3,6}(?![\w.])"), 0)
    return _details("fix_magic_numbers", "likely", F.slice(F.array_distinct(found), 1, most))


def _old_calls(t: Column) -> Column:
    return _details("fix_deprecated", "manual", F.array_compact(F.array(*[F.when(t.rlike(p), F.lit(a)) for p, a in DEPRECATED_CALLS])))


def _empty_catches(t: Column) -> Column:
    n = F.filter(F.array(F.regexp_count(t, F.lit(_seen_catch(LOG_LINE)))), lambda x: x > 0)
    return _details("fix_empty_catch", "safe", F.transform(n, lambda x: F.concat(x.cast("string"), F.lit(" blocks"))))


def _proposed(sources: DataFrame, keys: list[str], parts: list[Column]) -> DataFrame:
    """A row for each element of the parts' arrays; each part is computed once for a source."""
    each = sources.select(*keys, F.explode(F.array(*parts)).alias("_part"))
    return each.select(*keys, F.explode("_part").alias("_fix")).select(*keys, "_fix.*")


def select_stars(sources: DataFrame, keys: list[str], text_col: str = "text", kind_col: str = "kind") -> DataFrame:
    """fix_select_star: report objects that select all columns."""
    return _proposed(sources, keys, [_stars(F.col(text_col), F.col(kind_col))])


def unexplained_numbers(sources: DataFrame, keys: list[str], text_col: str = "text", most: int = 10) -> DataFrame:
    """fix_magic_numbers: distinct numbers of three to six digits, the first ``most`` of a file."""
    return _proposed(sources, keys, [_numbers(F.col(text_col), most)])


def old_calls(sources: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """fix_deprecated: calls that are out of date, each kind once a file."""
    return _proposed(sources, keys, [_old_calls(F.col(text_col))])


def long_routines(routines: DataFrame, keys: list[str], longest: int = 200) -> DataFrame:
    """fix_long_routine: routines with more than ``longest`` code lines."""
    n = text.code_lines(F.col("script"))
    return routines.where(n > longest).select(*keys, F.lit("fix_long_routine").alias("rule"), F.lit("manual").alias("severity"), F.concat("name", F.lit(": "), n.cast("string"), F.lit(" lines")).alias("detail"))


def proposed_fixes(sources: DataFrame, keys: list[str], text_col: str = "text", kind_col: str = "kind") -> DataFrame:
    """Fixes of whole texts that a person has to make: ``keys, rule, severity, detail``."""
    t = F.col(text_col)
    return _proposed(sources, keys, [_stars(t, F.col(kind_col)), _numbers(t), _old_calls(t)])


FIXES = ("fix_empty_catch", "fix_select_star", "fix_magic_numbers", "fix_deprecated", "fix_long_routine")


def run_fixes(sources: DataFrame, routines: DataFrame, keys: list[str], only: list[str] | None = None, config: dict | None = None, text_col: str = "text", kind_col: str = "kind") -> tuple[DataFrame, DataFrame]:
    """All fix rules, or those in ``only`` that the settings allow: ``(details, texts)``.

    ``details`` lists ``keys, rule, severity, detail, applied``; only
    fix_empty_catch changes anything. ``texts`` holds the sources that it
    changed: ``keys, fixed_text, fixes, backup``.
    """
    lists = (config or {}).get("rules", {"enabled": None, "disabled": []})
    longest = (config or {}).get("thresholds", {}).get("routine_lines", 200)
    names = [n for n in FIXES if (only is None or n in only) and (lists["enabled"] is None or n in lists["enabled"]) and n not in lists["disabled"]]
    fixed = fix_empty_catches(sources, text_col)
    changed = fixed.where("fixes > 0") if "fix_empty_catch" in names else fixed.limit(0)
    t, kind = F.col(text_col), F.col(kind_col)
    parts = {
        "fix_empty_catch": lambda: _empty_catches(t),
        "fix_select_star": lambda: _stars(t, kind),
        "fix_magic_numbers": lambda: _numbers(t),
        "fix_deprecated": lambda: _old_calls(t),
    }
    details = _proposed(sources, keys, [parts[n]() for n in names if n in parts] or [F.lit(None).cast("array<struct<rule:string,severity:string,detail:string>>")])
    if "fix_long_routine" in names:
        details = details.unionByName(long_routines(routines, keys, longest))
    return details.withColumn("applied", F.col("rule") == "fix_empty_catch"), changed.select(*keys, "fixed_text", "fixes", "backup")


def fix_counts(details: DataFrame) -> DataFrame:
    """Fixes by severity: safe, likely and manual ones, and all."""
    return details.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in ("safe", "likely", "manual")], F.count("*").alias("fixes"))
