"""Queries on keys as they are in larger tables, against their SQL."""

import duckdb

import __spark_entry__
from lodestrata.functions import text
from pyspark.sql import functions as F


def test_epoch_stamps_equal_their_sql_for_late_keys(spark, tmp_path):
    keys = [0, 1, 34722, 34723, 600000, 900000, 9000000]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    db = duckdb.connect()
    db.execute(f"SET TimeZone='UTC'; CREATE VIEW orders AS SELECT * FROM read_parquet('{tmp_path}/orders.parquet/*.parquet')")
    want = sorted(db.execute(__spark_entry__.oracle_sql()["epoch_stamps"]).fetchall())
    assert sorted(map(tuple, __spark_entry__.queries()["epoch_stamps"](spark, str(tmp_path)).collect())) == want
    milli = spark.range(1).select(text.epoch_text(F.lit(3_000_000_001_000)).alias("t")).first()[0]
    assert milli == "2065-01-24 05:20:01"


def test_ancestors_make_each_path_of_a_tree_once_and_keep_one_table(spark, monkeypatch):
    from lodestrata.operators import graph

    made = []
    kept = graph.written
    monkeypatch.setattr(graph, "written", lambda df, name: made.append(kept(df, name)) or made[-1])
    pairs = spark.createDataFrame([(f"c{n}", f"c{n - 1}") for n in range(1, 21)] + [("x", "y"), ("y", "z"), ("z", "x"), ("z", "c3"), (None, "c1")], "child string, parent string")
    up = {(r[0], r[1]): r[2] for r in graph.ancestors(pairs).collect()}
    want = {(f"c{n}", f"c{m}"): n - m for n in range(1, 21) for m in range(n)}
    for k, a in enumerate(("z", "y", "x")):
        want |= {(a, f"c{m}"): k + 4 - m for m in range(4)} | {(a, b): d for d, b in enumerate({"z": "xy", "y": "zx", "x": "yz"}[a], 1)}
    assert up == want
    folder = lambda df: df._jdf.inputFiles()[0].rpartition("/")[0].removeprefix("file://").removeprefix("file:")
    import os

    assert len(made) == 6 and [os.path.exists(folder(df)) for df in made[-1:]] == [True]


def test_pack_knows_sizes_without_the_data(spark):
    from lodestrata.sources import libraries

    rows = spark.createDataFrame([("l", "w_a.srw", b"a" * 3000), ("m", "w_b.srw", b"b")], "library string, name string, data binary")
    made = libraries.pack(rows, largest=6000)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2  # blocks are framed once and joined once
    assert {r["library"]: r["error"] for r in made.collect()} == {"l": "too large", "m": None}


def test_ranges_of_listed_files_are_those_of_the_data_source(spark, tmp_path):
    from lodestrata.sources import executable_source

    for n, size in (("a.exe", 0), ("b.exe", 699), ("c.exe", 700), ("d.exe", 2500)):
        (tmp_path / n).write_bytes((b"MZ" + b"x" * 600 + b"HDR*" * 500)[:size])
    files = spark.createDataFrame([(f"file://{p}", p.stat().st_size) for p in tmp_path.iterdir()], "path string, size long")
    executable_source.register(spark)
    listed = spark.read.format("executable").option("rangeBytes", 700).load(f"file://{tmp_path}")
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(executable_source.marks_of(files, 700)) == rows(listed)
