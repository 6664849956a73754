"""Stamps of keys as late as those of 60 and 360 copies of the orders, against their SQL."""

import duckdb

import __spark_entry__
from lodestrata.functions import text
from pyspark.sql import functions as F


def test_epoch_stamps_round_as_their_sql(spark, tmp_path):
    spark.range(6_672_000, 6_682_000).union(spark.range(53_990_000, 54_000_000)).withColumnRenamed("id", "o_orderkey").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    db = duckdb.connect()
    db.execute(f"SET TimeZone='UTC'; CREATE VIEW orders AS SELECT * FROM read_parquet('{tmp_path}/orders.parquet/*.parquet')")
    want = sorted(db.execute(__spark_entry__.oracle_sql()["epoch_stamps"]).fetchall())
    assert sorted(map(tuple, __spark_entry__.queries()["epoch_stamps"](spark, str(tmp_path)).collect())) == want
    # the operator itself stays exact for whole numbers
    assert spark.range(1).select(text.epoch_text(F.lit(6_672_079 * 86399), None) != text.epoch_text(F.lit(float(6_672_079 * 86399)), None)).first()[0]
