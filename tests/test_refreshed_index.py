"""An index is refreshed with either side computed once."""

from pyspark.sql import functions as F

from lodestrata.operators import versions
from lodestrata.plans import object_queries

SCHEMA = "path string, size long, checksum string, note string"


def test_rows_of_equal_files_are_kept_and_others_built(spark):
    kept = [("same", 1, "x", "1st"), ("same", 1, "x", "2nd"), ("null", None, "x", "null")]
    old = spark.createDataFrame([*kept, ("other", 1, "x", "1st"), ("other", 1, "x", "2nd"), ("gone", 1, "x", "1st"), (None, 1, "x", "1st")], SCHEMA)
    files = spark.createDataFrame([("same", 1, "x"), ("null", None, "x"), ("other", 2, "x"), ("new", 1, None), (None, 1, "x")], "path string, size long, checksum string")
    made = versions.refreshed_index(old, files, lambda f: f.withColumn("note", F.lit("built")))
    assert sorted(map(tuple, made.collect()), key=str) == sorted([*kept, ("other", 2, "x", "built"), ("new", 1, None, "built")], key=str)


def test_sides_are_shuffled_once_and_not_broadcast(spark):
    made = object_queries.refreshed_index(spark, "/root/testdata/sf0.001")
    made.collect()
    plan = made._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0]
    assert plan.count("ReusedExchange") >= 2 and "BroadcastExchange" not in plan
