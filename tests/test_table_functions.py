"""Parsers do not read what cannot matter, and table functions do not make a table of every row."""

from lodestrata.functions import tables
from lodestrata.operators import routines


def test_lines_that_declare_nothing_are_not_parsed(monkeypatch):
    seen = []
    declared = routines.declared
    monkeypatch.setattr(routines, "declared", lambda line, editor=False: seen.append(line) or declared(line, editor))
    text = "x = 1\n" * 50 + "forward prototypes\npublic function long of_p ()\nend prototypes\n" + "\x85 Public  function long of_a (long b)\nif a then\nend if\n end\tFunction\nevent ue_x()\ny = 2"
    found = [(r["name"], r["script"], r["line_start"], r["line_end"]) for r in routines.routines_of(text)]
    assert found == [("of_a", "if a then\nend if", 55, 58), ("ue_x", "y = 2", 59, 60)]
    assert len(seen) < 10


def test_table_functions_run_in_batches_of_rows(spark):
    tables.register(spark)
    rows = spark.createDataFrame([(1, "event ue_x()\nend event\n"), (2, None)], "id int, text string")
    for call, n in (("parse_routines(text)", 1), ("tokenize(text)", 5)):
        df = spark.sql(f"SELECT id FROM {{rows}}, LATERAL {call}", rows=rows)
        assert "BatchEvalPythonUDTF" in df._jdf.queryExecution().executedPlan().toString() and df.count() == n


def test_a_lone_quote_is_a_string_as_in_the_operator(spark):
    text = '$PBExportHeader$a.sra\nend if -1.5 "a~"b" x! "~'
    rows = spark.createDataFrame([(text,)], "text string")
    want = [(r["position"], r["kind"], r["token"]) for r in routines.tokens(rows, []).orderBy("position").collect()]
    assert list(tables.tokens_of(text)) == want
