import pytest
from pyspark.sql import functions as F

from lodestrata.functions import tables
from lodestrata.operators import routines
from lodestrata.streaming import index

SOURCE = "$PBExportHeader$w_a.srw\nforward prototypes\npublic function long of_x ()\nend prototypes\n\tpublic function long of_a (long a, ref string b)\n\tif a = -1.5e3 then return ~\"x~~\"y\"\n\tend function\non w_a.open\n/* open\n */ choose case é_1\nend on\n'a~'b' <> += ? end  if"


def test_table_functions_equal_the_frames(spark):
    tables.register(spark)
    texts = [SOURCE, "", None, "\"never closed", "/* never closed", "x" * 5000 + " end\tif ~"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    key = lambda d: sorted(map(str, d.collect()))
    assert key(spark.sql("SELECT id, r.* FROM {df}, LATERAL parse_routines(text) r", df=df)) == key(routines.routines(df, ["id"]))
    assert key(spark.sql("SELECT id, r.* FROM {df}, LATERAL parse_routines(text, true) r", df=df)) == key(routines.routines(df, ["id"], editor=True))
    assert key(spark.sql("SELECT id, t.position, t.token, t.kind FROM {df}, LATERAL tokenize(text) t", df=df)) == key(routines.tokens(df, ["id"]).select("id", "position", "token", "kind"))


@pytest.fixture
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    index.prepare(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_added_changed_removed(spark, rocks, tmp_path):
    at = lambda h: F.to_timestamp(F.lit(f"2024-01-01 {h:02}:00:00"))
    scans = {
        1: [("a", 1, "x"), ("b", 1, "x"), ("c", 1, "x"), (None, 1, "x")],
        2: [("a", 1, "x"), ("b", 2, "x"), ("d", None, None), ("d", None, None)],
        3: [("a", 1, "y"), ("b", 2, "x"), ("d", None, None)],
        5: [("b", 2, "x"), ("c", 9, "x")],
        8: [("b", 2, "x")],
    }
    schema = "path string, scanned timestamp, modified timestamp, size long, checksum string"
    for h, files in scans.items():
        rows = spark.createDataFrame(files, "path string, size long, checksum string")
        rows.select("path", at(h).alias("scanned"), at(0).alias("modified"), "size", "checksum").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/scans")
        found = index.file_changes(spark.readStream.schema(schema).parquet(f"file://{tmp_path}/scans"), 90 * 60 * 1000)
        found.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    got = sorted((r["path"], r["h"], r["status"]) for r in spark.read.parquet(f"file://{tmp_path}/out").select("path", F.hour("scanned").alias("h"), "status").collect())
    assert got == [("a", 1, "added"), ("a", 3, "changed"), ("a", 3, "removed"), ("b", 1, "added"), ("b", 2, "changed"), ("c", 1, "added"), ("c", 1, "removed"), ("c", 5, "added"), ("c", 5, "removed"), ("d", 2, "added"), ("d", 3, "removed")]


def test_folder_where_none_is_set(tmp_path):
    import os
    import subprocess
    import sys

    program = """
from lodestrata.session import build_session
from lodestrata.tables import checkpoint_folder, stored
spark = build_session("unset", **{"spark.master": "local[1]", "spark.ui.enabled": "false"})
assert spark.conf.get("spark.checkpoint.dir", None) is None
assert stored(spark.range(3)).count() == 3 and checkpoint_folder(spark) == checkpoint_folder(spark)
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", program], check=True, timeout=300, env={**os.environ, "SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": root})


def test_files_share_calls():
    import pandas as pd

    class State:
        hasTimedOut, exists, get = False, False, None

        def getCurrentWatermarkMs(self):
            return 0

        def update(self, value):
            self.exists, self.get = True, value

        def setTimeoutTimestamp(self, at):
            self.at = at

        def remove(self):
            self.exists = False

    state, of = State(), lambda paths, scanned: iter([pd.DataFrame({"path": paths, "scanned_ms": scanned, "modified_ms": 0, "size": 1, "checksum": "x"})])
    run = index._seen(15)
    assert [sorted(frame["path"]) for frame in run((0,), of(["a", "b"], 10), state)] == [["a", "b"]]
    assert list(run((0,), of(["a"], 20), state)) == [] and state.at == 25
    state.hasTimedOut, state.getCurrentWatermarkMs = True, lambda: 30
    assert [frame[["path", "status"]].values.tolist() for frame in run((0,), iter([]), state)] == [[["b", "removed"]]]
    assert state.get[0] == ["a"] and state.at == 35
