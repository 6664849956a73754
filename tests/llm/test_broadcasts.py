"""Tables whose size Spark takes too low are not sent to every task."""

from pyspark.sql import functions as F

from lodestrata.llm import near_dedup, shared


def test_near_links_broadcast_no_exploded_table(spark, monkeypatch):
    plans = {}

    def recorded(df, name, *by):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return shared.saved(df, name, *by)

    monkeypatch.setattr(near_dedup, "saved", recorded)
    nodes = shared.saved(spark.range(100).select(F.xxhash64("id").alias("fp")), "nodes")
    near_dedup.near_links(nodes).count()
    assert "SortMergeJoin" in plans["links"] and "BroadcastHashJoin" not in plans["links"]


def test_rare_shingles_are_merged(spark):
    sets = spark.createDataFrame([(b"a", b"".join(i.to_bytes(8, "little") for i in (1, 2, 3))), (b"b", b"".join(i.to_bytes(8, "little") for i in (1, 2, 4)))], "node binary, hashes binary")
    open_nodes = spark.createDataFrame([(b"a", 3, b"a"), (b"b", 3, b"b")], "node binary, size long, label binary")
    keys = near_dedup._prefix_keys(open_nodes, sets, 0.5)
    assert "BroadcastHashJoin" not in keys._jdf.queryExecution().executedPlan().toString()
    # of three shingles the first two, one of which no other set has
    assert sorted((bytes(r.node), r.key) for r in keys.collect()) == [(b"a", 1), (b"b", 1)]
