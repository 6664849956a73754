"""Libraries are packed and written with one shuffle of their data."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lodestrata.plans import object_queries
from lodestrata.sources import libraries, sinks

ROWS = [("a", f"w_{i:03}.srw", bytes([i]) * (700 * i % 2300)) for i in range(90)] + [("a", "Same.srw", b"1" * 900), ("a", "same.SRW", b"2"), (None, "w_n.srw", b"x"), ("a", None, b"x"), ("bad", "n" * 2000 + ".srw", b"x")]
SCHEMA = "library string, name string, data binary"


def test_pack_and_write_shuffle_the_data_once(spark):
    plan = libraries.pack(spark.createDataFrame(ROWS, SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Join" not in plan and "Aggregate" not in plan


@pytest.mark.parametrize("spooled", [100, 1 << 25])
def test_stretches_are_those_of_a_library_in_memory(monkeypatch, spark, tmp_path, spooled):
    monkeypatch.setattr(libraries, "SPOOLED", spooled)
    rows = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    whole = libraries.build(sorted((n, d) for lib, n, d in ROWS if lib == "a" and n))
    made = {r["library"]: (r["content"], r["error"]) for r in libraries.pack(rows).collect()}
    assert made["a"] == (whole, None) and made[None][0] == libraries.build([("w_n.srw", b"x")]) and made["bad"] == (None, "names too long for a node")
    done = {r["path"]: (r["bytes"], r["error"]) for r in sinks.write_libraries(rows.where("library is not null"), f"file://{tmp_path}/out").collect()}
    assert done == {"a.pbl": (len(whole), None), "bad.pbl": (None, "names too long for a node")}
    assert (tmp_path / "out/a.pbl").read_bytes() == whole


def test_entries_are_listed_without_their_data(spark):
    packed = libraries.pack(spark.createDataFrame(ROWS[:50], SCHEMA)).select(F.col("library").alias("path"), "content")
    full, bare = libraries.read_entries(packed), libraries.read_entries(packed, data=False)
    assert sorted(map(str, bare.drop("data").collect())) == sorted(map(str, full.drop("data").collect())) and bare.where("data is not null").count() == 0
    assert [r["name"] for r in libraries.read_entries(packed, chosen=lambda e: e["name"] == "w_007.srw").collect()] == ["w_007.srw"]


def test_objects_of_a_small_file_are_made_by_many_tasks(spark, tmp_path):
    spark.range(1000).withColumnRenamed("id", "event_id").coalesce(1).write.parquet(f"file://{tmp_path}/events.parquet")
    assert object_queries.objects(spark, f"file://{tmp_path}").rdd.getNumPartitions() >= 16


def test_libraries_are_made_in_one_pass(spark):
    plan = libraries.pack(spark.createDataFrame(ROWS, SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_the_code_that_makes_objects_is_small_enough_to_be_compiled(spark, capsys):
    made = object_queries.objects(spark, "/root/testdata/sf0.001")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else nothing is generated before the job runs
    try:
        made.select("*").explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sizes = [int(size) for size in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8000
    same = F.expr(object_queries._TEXT).eqNullSafe(F.col("text"))
    assert made.where(~same).count() == 0 and made.count() == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()


def test_wide_texts_are_told_without_lambdas(spark):
    r = random.Random(3)
    texts = [bytes(r.choices(b"\0ab\n", [w, 1, 1, 1], k=r.randrange(72))) for w in (1, 3, 9) for _ in range(300)] + [bytes(r.choice([b"a\0", b"ab"])[i % 2] for i in range(n)) for n in range(72)]

    def said(data):
        odd = data[1:64:2]
        wide = len(data) >= 4 and odd.count(0) > 0.6 * len(odd)
        return data[: len(data) // 2 * 2].decode("utf-16-le").partition("\0")[0] if wide else data.decode().replace("\0", "")

    made = spark.createDataFrame([(t,) for t in texts], "data binary").select("data", libraries.source_text(F.col("data")).alias("text"))
    assert all(row["text"] == said(bytes(row["data"])) for row in made.collect())
    assert "lambda" not in made._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("size", [0, 1, 501, 502, 503, 1004, 5000])
def test_blocks_of_an_entry_are_chained_and_read_back(size):
    data = bytes(i % 251 for i in range(size))
    parts = [data[i : i + 502] for i in range(0, size, 502)] or [b""]
    plain = b"".join(b"DAT*" + (1000 + 512 * (k + 1) if k + 1 < len(parts) else 0).to_bytes(4, "little") + len(p).to_bytes(2, "little") + p.ljust(502, b"\0") for k, p in enumerate(parts))
    assert libraries._blocks(data, 1000) == plain
    assert libraries.payload(libraries.Region(b"\0" * 1000 + plain), 1000, size) == data
