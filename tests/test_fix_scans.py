"""Rules of fixes share a scan, and a workflow reads its libraries once."""

from pyspark.sql import functions as F

from lodestrata.operators import aggregates, routines, rules
from lodestrata.sources import libraries


def _sources(spark):
    texts = ["try\ncatch (e)\nend try\nx = 100 + 7.250 + 250 + 100 + 99 + a300 + 1234567", "SELECT * FROM t\nYield()\nSetPointer(a) 4000", "", None]
    return spark.range(4).select(F.col("id").alias("event_id"), F.lit("datawindow").alias("kind"), F.get(F.array(*map(F.lit, texts)), F.col("id").cast("int")).alias("text"))


def test_fixes_of_whole_texts_are_one_scan(spark):
    rows = _sources(spark)
    details, _ = rules.run_fixes(rows, routines.routines(rows, ["event_id"]), ["event_id"])
    assert details._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 2  # the texts, and the routines
    got = sorted((r["event_id"], r["rule"], r["severity"], r["detail"], r["applied"]) for r in details.collect())
    assert got == [
        (0, "fix_empty_catch", "safe", "1 blocks", True),
        (0, "fix_magic_numbers", "likely", "100", False),
        (0, "fix_magic_numbers", "likely", "250", False),
        (1, "fix_deprecated", "manual", rules.DEPRECATED_CALLS[0][1], False),
        (1, "fix_deprecated", "manual", rules.DEPRECATED_CALLS[1][1], False),
        (1, "fix_magic_numbers", "likely", "4000", False),
        (1, "fix_select_star", "manual", "list the columns", False),
    ]
    only, _ = rules.run_fixes(rows, routines.routines(rows, ["event_id"]), ["event_id"], only=["fix_long_routine"])
    assert only.count() == 0


def test_a_workflow_reads_its_libraries_once(spark):
    rows = spark.createDataFrame([("l", "w_a.srw", b"x"), ("m", "w_b.srw", b"y"), ("m", "w_c.srw", b"y")], "library string, name string, data binary")
    found = libraries.read_entries(libraries.pack(rows).select(F.col("library").alias("path"), "content"))
    none = spark.createDataFrame([], "severity string")
    out = aggregates.workflow(found, none, none)
    assert sorted(map(tuple, out.collect())) == [(1, "export", 3), (2, "analyse", 0), (3, "fix", 0), (4, "pack", 2)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 3
