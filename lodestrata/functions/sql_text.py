"""Column functions that mine SQL and report-object source text. No SQL is parsed or run."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import decode_string

#: SQL words that are no table names, and the longest SQL text: fixed values.
NO_TABLES = ("select", "where", "group", "order", "having", "union", "inner", "outer", "left", "right", "cross")
MOST_SQL = 4000
#: Styles by number and by name: fixed values of the format.
STYLES = {"0": "freeform", "1": "tabular", "2": "label", "3": "n-up", "4": "crosstab", "5": "graph", "6": "ole", "7": "richtext", "8": "grid", "9": "composite"}

_NAME = r'((?:\[[^\]\n]+\]|"[^"\n]+"|[\w$#]+)(?:\.(?:\[[^\]\n]+\]|"[^"\n]+"|[\w$#]+))*)'


def first(text: Column, pattern: str, group: int = 1) -> Column:
    """First match of a group, null where there is none."""
    found = F.regexp_extract(text, pattern, group)
    return F.when(found != "", found)


def every(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), group)


def plain_table(name: Column) -> Column:
    """``[a].[b]`` as ``a.b``, ``"t"`` as ``t``."""
    return F.regexp_replace(name, r'[\[\]"]', "")


def tables(text: Column) -> Column:
    """Sorted distinct tables named after from, into, update, join or table."""
    names = F.transform(every(text, rf"(?i)(?:from|into|update|join|table)\s+{_NAME}"), plain_table)
    return F.array_sort(F.array_distinct(F.filter(names, lambda x: (F.char_length(x) > 1) & ~F.lower(x).isin(*NO_TABLES))))


def from_list(sql: Column) -> Column:
    """Lower-case tables of the FROM clause, joins taken apart and their conditions left out; an alias behind a space counts as a table too."""
    clause = F.regexp_extract(F.lower(sql), r"(?s)\bfrom\b(.*?)(?:\b(?:where|order|group|having|union)\b|[;()]|\z)", 1)
    plain = F.regexp_replace(clause, r"(?s)\bon\b.*?(?=,|\b(?:left|right|inner|full|cross|join)\b|\z)", " ")
    words = F.split(F.regexp_replace(plain, r"[`\"\[\]]", ""), r"[\s,]+")
    return F.array_distinct(F.filter(words, lambda x: (x != "") & ~x.isin("left", "right", "inner", "outer", "full", "cross", "join")))


def named_tables(text: Column) -> Column:
    """Distinct tables that ``table name=`` attributes name, in order."""
    names = F.transform(every(text, r"(?i)\btable\s+name\s*=\s*([^\s()]+)"), plain_table)
    return F.array_distinct(F.filter(names, lambda x: x != ""))


def retrieve_sql(text: Column) -> Column:
    """SQL of the ``retrieve="..."`` attribute, its escapes undone; else the longest statement in the text."""
    quoted = first(text, r'(?is)retrieve\s*=\s*"((?:~.|[^"~])*)"')
    return F.coalesce(decode_string(quoted), bare_sql(text))


def bare_sql(text: Column) -> Column:
    """The longest statement outside quotes: up to a blank line, ``;`` at a line's end or the next section."""
    end = r"(?=;\r?\n|\n\s*\n|\n(?:table|column|group|text|compute)\s*\(|\z)"
    attribute_text = r"(?is)\bsql\s*=\s*'([^']*)'"
    found = every(F.regexp_replace(text, attribute_text, " "), rf"(?is)(?<![\w\"'])((?:select|insert\s+into|update|delete\s+from|execute|declare|with)\s.*?){end}")
    long_enough = F.filter(F.transform(found, lambda x: F.trim(F.left(x, F.lit(MOST_SQL)))), lambda x: F.char_length(x) > 10)
    longest = F.aggregate(long_enough, F.lit(""), lambda best, x: F.when(F.char_length(x) > F.char_length(best), x).otherwise(best))
    quoted = first(text, attribute_text)
    return F.coalesce(F.when(longest != "", longest), quoted)


_WHERE_END = r"(?=\s+group\s+by\s|\s+order\s+by\s|\s+having\s|\s+union\s|\bwhere\s|\z)"


def where_clause(sql: Column) -> Column:
    """From the first WHERE to the next clause or the next WHERE."""
    return F.trim(first(sql, rf"(?is)\bwhere\s+(.*?){_WHERE_END}"))


def order_by_clause(sql: Column) -> Column:
    return F.trim(first(sql, r"(?is)\border\s+by\s+(.*?)(?=\s+union\s|\z)"))


def group_by_clause(sql: Column) -> Column:
    return F.trim(first(sql, r"(?is)\bgroup\s+by\s+(.*?)(?=\s+having\s|\s+order\s+by\s|\s+union\s|\z)"))


def has_union(sql: Column) -> Column:
    return F.lower(sql).rlike(r"(^|[^a-z0-9_])union([^a-z0-9_]|$)")


def union_parts(sql: Column) -> Column:
    """The selects that a union joins; one element where there is none."""
    return F.transform(F.split(sql, r"(?i)\bunion(?:\s+all)?\b"), lambda x: F.trim(x))


#: Longest text of a subquery that is shown.
MOST_SNIPPET = 200


def subqueries(sql: Column, most: int = MOST_SNIPPET) -> Column:
    """Kind and text of every subquery in order: ``exists``, ``not_in``, ``in`` or ``scalar``, nested ones too.

    The text goes from its word to the parenthesis that closes it, or to
    ``most`` characters of the query if it is longer or never closed. A
    subquery's start is found without taking in what follows, so no other one
    is lost; its end is where the depth of parentheses is back at nothing.
    """
    start = rf"(?is)(?=((?:\bnot\s+in|(?<!\bnot\s{{1,9}})\bin|\bexists|=)\s*\(\s*select\b.{{0,{most}}}))"
    low = lambda x: F.lower(x)
    kind = lambda x: F.when(low(x).startswith("exists"), "exists").when(low(x).startswith("not"), "not_in").when(low(x).startswith("in"), "in").otherwise("scalar")
    return F.transform(every(sql, start), lambda x: F.struct(kind(x).alias("kind"), F.left(x, _closing(x)).alias("snippet")))


def _closing(text: Column) -> Column:
    """Where the first parenthesis of a text is closed, its length if it never is; what is in single quotes opens and closes nothing."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(0).alias("at"), F.lit(0).alias("end"))

    def step(acc: Column, c: Column) -> Column:
        quoted = F.when(c == "'", ~acc["quoted"]).otherwise(acc["quoted"])
        depth = acc["depth"] + F.when(quoted, 0).when(c == "(", 1).when(c == ")", -1).otherwise(0)
        at = acc["at"] + 1
        return F.struct(depth.alias("depth"), quoted.alias("quoted"), at.alias("at"), F.when((acc["end"] == 0) & (c == ")") & (depth == 0), at).otherwise(acc["end"]).alias("end"))

    found = F.aggregate(F.split(text, ""), start, step)
    return F.when(found["end"] > 0, found["end"]).otherwise(F.char_length(text))


def attribute(attributes: Column, name: str) -> Column:
    """The value of ``name=value`` or ``name="value"``."""
    return first(attributes, rf'(?i)\b{name}\s*=\s*"?((?<=")[^"]*|[\w.()]+)')


def columns(text: Column) -> Column:
    """``(name, type, dbname)`` of every column, the first of a name; the database name defaults to the name."""
    inside = every(text, r'(?i)\bcolumn\s*=?\s*\(?((?:\s*[a-z_.]+\s*=\s*(?:"[^"]*"|[\w.]+(?:\([^)]*\))?))+)')
    each = F.transform(inside, lambda x: F.struct(attribute(x, "name").alias("name"), F.coalesce(attribute(x, "type"), F.lit("")).alias("type"), F.coalesce(attribute(x, "dbname"), attribute(x, "name")).alias("dbname")))
    named = F.filter(each, lambda x: x["name"].isNotNull())
    return F.filter(named, lambda x, i: ~F.exists(F.slice(named, F.lit(1), i), lambda y: y["name"] == x["name"]))


def arguments(text: Column) -> Column:
    """Retrieval arguments as ``(name, data_type)``: quoted names, or plain ones where there are none."""
    inside = F.coalesce(first(text, r"(?is)arguments\s*=\s*\((.*?\)|[^)]*)\)"), F.lit(""))
    pair = lambda p: F.transform(every(inside, p, 0), lambda x: F.struct(F.regexp_extract(x, r"(\w+)", 1).alias("name"), F.regexp_extract(x, r'\w+"?\s*,?\s+(\w+)', 1).alias("data_type")))
    quoted = pair(r'"\w+"\s*,?\s+\w+')
    return F.when(F.size(quoted) > 0, quoted).otherwise(pair(r"\w+\s+\w+"))


def computed_columns(text: Column) -> Column:
    """``(name, expression)`` of computed fields, whatever the order of their attributes."""
    inside = every(text, r'(?is)\bcompute\s*\(((?:[^()"]|"[^"]*"|\([^()]*\))*)\)')
    each = F.transform(inside, lambda x: F.struct(attribute(x, "name").alias("name"), attribute(x, "expression").alias("expression")))
    return F.filter(each, lambda x: x["name"].isNotNull())


def style(text: Column) -> Column:
    """Presentation style by name, else by its processing number, else nothing."""
    by_name = F.lower(first(text, r"(?i)\bstyle\s*\(?\s*type\s*=\s*(\w+)"))
    number = first(text, r"(?i)\bprocessing\s*=?\s*(\d+)")
    labels = F.create_map(*[F.lit(x) for pair in STYLES.items() for x in pair])
    return F.coalesce(by_name, labels[number], number)


def has_join(sql: Column) -> Column:
    return F.lower(sql).contains(" join ")


def select_count(sql: Column) -> Column:
    return F.regexp_count(F.lower(sql), F.lit("select "))


def report_object(text: Column) -> Column:
    """All that is known of a report object, as one struct."""
    sql = retrieve_sql(text)
    return F.struct(
        sql.alias("sql"), tables(F.coalesce(sql, F.lit(""))).alias("tables"), columns(text).alias("columns"), style(text).alias("style"), where_clause(sql).alias("where_clause"), order_by_clause(sql).alias("order_by_clause"),
        group_by_clause(sql).alias("group_by_clause"), arguments(text).alias("arguments"), computed_columns(text).alias("computed"), F.coalesce(has_union(sql), F.lit(False)).alias("has_union"), subqueries(F.coalesce(sql, F.lit(""))).alias("subqueries"),
    )


# Inline SQL: a statement with a FROM, over any number of lines up to its semicolon; an executed string; a look at the SQL state.
HARDCODED_SQL = (r"(?i)\b(?:select|insert|update|delete)\s[^;]*?\bfrom\b", r"(?i)\bexec(?:ute)?\s+(?:immediate\s+)?[\"']", r"(?i)\bsqlca\s*\.\s*(?:sqlcode|dbcode)\b")


def hardcoded_sql(script: Column) -> Column:
    """Whether a routine holds inline SQL."""
    found = F.lit(False)
    for p in HARDCODED_SQL:
        found = found | script.rlike(p)
    return found
