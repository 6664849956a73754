import pytest
from pyspark.sql import functions as F

from lodestrata.functions import sql_text, text
from lodestrata.operators import routines, rules, search


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("v")).first()[0]


@pytest.mark.parametrize("value, lines", [("", []), ("a", ["a"]), ("a\n", ["a"]), ("a\r\nb\n", ["a", "b"]), ("\n", [""]), ("a\n\n", ["a", ""]), (None, None)])
def test_lines(spark, value, lines):
    assert one(spark, value, text.lines) == lines


def test_search_finds_first_hit_of_each_line(spark):
    df = spark.createDataFrame([(1, "foo foo\nbar\nFOO"), (2, None), (3, "")], "id int, text string")
    assert [tuple(r) for r in search.search_text(df, "foo").select("id", "line_no", "match_start", "match_length").orderBy("line_no").collect()] == [(1, 1, 1, 3), (1, 3, 1, 3)]
    assert search.search_text(df, "foo", case_sensitive=True).count() == 1


def test_invalid_regex_is_an_error(spark):
    df = spark.createDataFrame([(1, "a")], "id int, text string")
    with pytest.raises(Exception):
        search.search_regex(df, "(").collect()


@pytest.mark.parametrize("glob, names", [("d_*", ["d_a", "d_bc"]), ("d_?", ["d_a"]), ("[!d]_*", ["w_a"]), ("*", ["d_a", "d_bc", "w_a"])])
def test_glob(spark, glob, names):
    df = spark.createDataFrame([("d_a",), ("d_bc",), ("w_a",)], "n string")
    assert sorted(r[0] for r in search.glob_filter(df, "n", glob).collect()) == names


@pytest.mark.parametrize(
    "sql, expected",
    [("SELECT a FROM t WHERE x > 0 GROUP BY y", ("x > 0", None, "y")), ("select a from t\norder by dept, salary DESC", (None, "dept, salary DESC", None)), ("SELECT a FROM t GROUP BY dept HAVING COUNT(*) > 5", (None, None, "dept")), ("SELECT 1", (None, None, None))],
)
def test_clauses(spark, sql, expected):
    got = one(spark, sql, lambda c: F.struct(sql_text.where_clause(c).alias("a"), sql_text.order_by_clause(c).alias("b"), sql_text.group_by_clause(c).alias("c")))
    assert tuple(got) == expected


@pytest.mark.parametrize("sql, tables", [("SELECT * FROM orders JOIN customers ON 1=1", ["customers", "orders"]), ("select 1 from [dbo].[employees] e", ["dbo.employees"]), ('select 1 from "my_table"', ["my_table"]), ("update stock set a=1", ["stock"]), ("no sql", [])])
def test_tables(spark, sql, tables):
    assert one(spark, sql, sql_text.tables) == tables


def test_report_object(spark):
    source = '$PBExportHeader$d_emp.srd\ndatawindow(processing=8)\ntable(column=(type=char(40) name=first dbname="emp.first" )\n retrieve="SELECT ~"a~" FROM emp WHERE x IN (SELECT id FROM c) UNION SELECT 2" arguments=(("dept", number),("start", date)))\ncompute(band=detail name="total" expression="price * qty")\ncompute(expression="a + b" name="sum_ab")'
    r = one(spark, source, sql_text.report_object)
    assert r["sql"].startswith('SELECT "a" FROM emp') and r["has_union"] and r["style"] == "grid"
    assert [tuple(c) for c in r["columns"]] == [("first", "char(40)", "emp.first")]
    assert [tuple(c) for c in r["arguments"]] == [("dept", "number"), ("start", "date")]
    assert [tuple(c) for c in r["computed"]] == [("total", "price * qty"), ("sum_ab", "a + b")]
    assert [s["kind"] for s in r["subqueries"]] == ["in"]


def test_plain_arguments(spark):
    assert [tuple(x) for x in one(spark, "arguments=(dept_id integer, start_date date)", sql_text.arguments)] == [("dept_id", "integer"), ("start_date", "date")]


def test_bare_sql(spark):
    assert one(spark, "SELECT id, name FROM users\ncolumn(name=id)", sql_text.retrieve_sql) == "SELECT id, name FROM users"
    assert one(spark, "sql='SELECT name, salary FROM emp'", sql_text.retrieve_sql) == "SELECT name, salary FROM emp"
    assert one(spark, "release 12.5;\ntable(name=d_emp)", sql_text.retrieve_sql) is None


@pytest.mark.parametrize("sql, kinds", [("a NOT IN (SELECT 1)", ["not_in"]), ("EXISTS (SELECT 1)", ["exists"]), ("x = (select 1)", ["scalar"]), ("x", [])])
def test_subquery_kinds(spark, sql, kinds):
    assert [s["kind"] for s in one(spark, sql, sql_text.subqueries)] == kinds


def test_complexity_and_nesting(spark):
    script = "choose case a\ncase 1\ncase 2\ncase 3\nend choose\n// if x then"
    assert one(spark, script, text.complexity) == 3
    deep = "\n".join(["if a then"] * 5 + ["end if"] * 7 + ["if b then"])
    assert one(spark, deep, text.max_nesting) == 5
    assert [one(spark, str(n), lambda c: text.rating(c.cast("int"))) for n in (5, 6, 20, 50, 51)] == ["A", "B", "C", "D", "F"]
    assert one(spark, "x = a and b // or\n// if\nnothing", text.quick_complexity) == 2


def test_measures_do_not_depend_on_the_indent(spark):
    lines = ["if a then", "// if b then", "choose case x", "case 1", "for i = 1 to 9", "next", "end choose", "else", "", "end if"]
    for indent in ("", "\t", "   ", "\t \xa0"):
        script = "\n".join(indent + x + "\t" for x in lines)
        got = spark.range(1).select(text.code_lines(F.lit(script)), text.complexity(F.lit(script)), text.max_nesting(F.lit(script)), text.quick_complexity(F.lit(script))).first()
        assert tuple(got) == (8, 6, 3, 8), indent


def test_declarations():
    read = lambda s, **k: (lambda d: d and (d["access"], d["name"], d["return_type"], d["is_event"], d["arguments"]))(routines.declared(s, **k))
    assert read("forward public function long[] of_x (long a, string b);") == ("public", "of_x", "long[]", False, ["long a", "string b"])
    assert read("Private Subroutine of_y") == ("private", "of_y", None, False, [])
    assert read("global function f_z(integer i)") == ("global", "f_z", None, False, ["integer i"])
    assert read("event w_x.ue_a ( long l )") == ("public", "w_x.ue_a", None, True, ["long l"])
    assert [read(s) for s in ("function long of_x()", "public long il_x", "forward prototypes", "public function", "", "one two")] == [None] * 6
    assert read("function long of_x()", editor=True) == ("public", "of_x", "long", False, []) and read("forward function of_x()", editor=True)[1] == "of_x"
    assert read("on w_x.open", editor=True)[1] == "w_x.open" and read("on open", editor=True) is None and read("event ue_a()", editor=True) is None


def test_variables_by_tab(spark):
    df = spark.createDataFrame([("f", "\tpublic\tlong il_x = 3\t\nprivate long il_a, il_b\n  shared string ss_y;\r\npublic function long of_a ()")], "f string, text string")
    assert [tuple(r) for r in routines.variables(df, ["f"]).orderBy("name").collect()] == [("f", "public", "long", "il_x", "3"), ("f", "shared", "string", "ss_y", "")]


def test_subqueries_beside_and_inside_each_other(spark):
    sql = "select * from t where x in (select a from b where c not in (select d from e)) and exists (select 1 from f) and y = (select ')' from g) and z in (select 1" + " " * 300
    got = [tuple(s) for s in one(spark, sql, sql_text.subqueries)]
    assert [k for k, _ in got] == ["in", "not_in", "exists", "scalar", "in"]
    assert [s for _, s in got[:4]] == ["in (select a from b where c not in (select d from e))", "not in (select d from e)", "exists (select 1 from f)", "= (select ')' from g)"]
    assert len(got[4][1]) == len("in (select") + 200


def test_magic_numbers(spark):
    assert one(spark, "a = 1024 + 8080\nb = 8080 // 777\nc = x12 + 3.5", text.magic_numbers) == ["8080"]


@pytest.mark.parametrize("seconds, stamp", [(100000000, "1973-03-03 09:46:40"), (0, "1970-01-01 00:00:00"), (3000000001000, "2065-01-24 05:20:01")])
def test_epoch(spark, seconds, stamp):
    assert spark.range(1).select(text.epoch_text(F.lit(seconds).cast("long"))).first()[0] == stamp


def test_names(spark):
    row = spark.range(1).select(text.base_name(F.lit("w_a.b.srw")), text.extension(F.lit("W_A.SRW")), text.base_name(F.lit(".hidden")), text.class_name(F.lit("w_order_list.srw")), text.kebab_name(F.lit("w_order_list.srw"))).first()
    assert tuple(row) == ("w_a.b", ".srw", ".hidden", "WOrderList", "w-order-list")


SOURCE = """global type w_main from window
forward prototypes
public function int of_ghost (int a)
end prototypes
global long gl_x = 3
public subroutine of_load (string a, long b);
try
catch (exception e)
end try
SELECT a FROM b
end subroutine
event clicked ( )
Yield()
end event
"""


def test_routines_and_their_rules(spark):
    df = spark.createDataFrame([("w_main", SOURCE), ("empty", ""), ("none", None)], "obj string, text string")
    found = routines.routines(df, ["obj"])
    assert [(r["name"], r["is_event"], r["arguments"], r["line_start"], r["line_end"]) for r in found.orderBy("line_start").collect()] == [("of_load", False, ["string a", "long b"], 6, 11), ("clicked", True, [], 12, 14)]
    rows = {(r["name"], r["rule"]) for r in rules.lint_routines(found, ["obj"]).collect()}
    assert ("of_load", "empty_catch") in rows and ("of_load", "hardcoded_sql") in rows and ("clicked", "deprecated_function") in rows
    variables = routines.variables(df, ["obj"]).collect()
    assert [(v["access"], v["data_type"], v["name"], v["initial_value"]) for v in variables] == [("global", "long", "gl_x", "3")]
    assert rules.lint_variables(routines.variables(df, ["obj"]), ["obj"]).count() == 1


def test_line_rules(spark):
    df = spark.createDataFrame([("a", "x" * 201 + "\n// TODO later\ngoto done\nSELECT a FROM b\nglobal long x\nok")], "f string, text string")
    found = rules.lint_lines(df, ["f"])
    assert {(r["line_no"], r["rule"]) for r in found.collect()} == {(1, "LONG_LINE"), (2, "TODO_FIXME"), (3, "GOTO_USAGE"), (4, "HARDCODED_SQL"), (5, "GLOBAL_VAR")}
    assert {r["suggestion"] for r in rules.suggestions(found).collect()} == {"HARDCODED_SQL"}
    own = rules.Registry(rules.line_rules())
    own.register(rules.Rule("MINE", "info", lambda c: c == "ok"))
    assert {r["rule"] for r in rules.lint_lines(df, ["f"], own.chosen(["MINE"])).collect()} == {"MINE"}


def test_empty_catch_of_a_file_and_its_fix(spark):
    source = "a\ntry\n x()\ncatch (e)\nend try\n"
    df = spark.createDataFrame([("f", source)], "f string, text string")
    assert [r["line_no"] for r in rules.empty_catches(df, ["f"]).collect()] == [4]
    row = rules.fix_empty_catches(df).first()
    assert row["fixes"] == 1 and row["backup"] == source and row["fixed_text"] == source.replace("end try", f"{rules.LOG_LINE}\nend try")
    assert rules.fix_empty_catches(df.select("f", F.lit(row["fixed_text"]).alias("text"))).first()["fixes"] == 0
    held = "\tTRY\n\tcatch (e)\n\n\t\t// nobody cares\n\tEND TRY\ncatch (f)\n x()\nend try"
    row = rules.fix_empty_catches(df.select("f", F.lit(held).alias("text")), log='say("$1 \\")').first()
    assert row["fixes"] == 1 and row["fixed_text"] == held.replace("\tEND TRY", '\tsay("$1 \\")\n\tEND TRY')


def test_tokens(spark):
    df = spark.createDataFrame([(1, 'if a = "x~"y" then // end')], "id int, text string")
    assert [(r["kind"], r["token"]) for r in routines.tokens(df, ["id"]).orderBy("position").collect()] == [("keyword", "if"), ("name", "a"), ("operator", "="), ("string", '"x~"y"'), ("keyword", "then"), ("line_comment", "// end")]


def test_second_where_and_statements_over_lines(spark):
    assert one(spark, "SELECT a FROM t WHERE x = 1 WHERE y = 2", sql_text.where_clause) == "x = 1"
    assert one(spark, "SELECT a\n INTO :b\n FROM t;", sql_text.hardcoded_sql) and not one(spark, "select a;\nx from y", sql_text.hardcoded_sql)


@pytest.mark.parametrize("sql, tables", [("select 1 from A a, b left join [c].[d] x on x.i = a.i where 1=1", ["a", "b", "c.d", "x"]), ('select 1 from "T"', ["t"]), ("select 1", [])])
def test_from_list(spark, sql, tables):
    assert one(spark, sql, sql_text.from_list) == tables


def test_catches_on_their_lines(spark):
    source = "try\nx()\ncatch (e)\nend try\ncatch of\n a long way to go\nend try\nCATCH (f)\nEnd Try"
    df = spark.createDataFrame([("f", source), ("g", None), ("h", "")], "f string, text string")
    assert sorted(r["line_no"] for r in rules.empty_catches(df, ["f"]).collect()) == [3, 8]


def test_fixes_and_advice(spark):
    long = "global long a\npublic function long of_a ()\n" + "x = 1\n" * 201 + "try\ncatch (e)\nend try\nend function\n"
    df = spark.createDataFrame([("f", long, "window"), ("d", "SELECT * FROM t", "datawindow")], "f string, text string, kind string")
    found = routines.routines(df, ["f"])
    details, texts = rules.run_fixes(df, found, ["f"])
    assert {(r["f"], r["rule"], r["applied"]) for r in details.collect()} == {("f", "fix_empty_catch", True), ("f", "fix_long_routine", False), ("d", "fix_select_star", False)}
    assert texts.count() == 1 and tuple(rules.fix_counts(details).first()) == (1, 0, 2, 3)
    assert rules.run_fixes(df, found, ["f"], config={"rules": {"enabled": None, "disabled": ["fix_empty_catch"]}, "thresholds": {"routine_lines": 500}})[0].count() == 1
    none = df.limit(0).select(F.lit("").alias("rule"), "f")
    assert [r["suggestion"] for r in rules.suggestions(none).collect()] == ["clean"]
