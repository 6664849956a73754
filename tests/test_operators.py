from pyspark.sql import functions as F

from lodestrata.operators import aggregates, graph, versions


def test_diff_names_every_change(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "path string, size int")
    new = spark.createDataFrame([("b", 2), ("c", 4), ("d", None)], "path string, size int")
    assert {tuple(r) for r in versions.diff(old, new, ["path"], ["size"], unchanged=True).collect()} == {("a", "removed"), ("b", "unchanged"), ("c", "modified"), ("d", "added")}
    assert versions.diff(old, new.limit(0), ["path"], ["size"]).count() == 3


def test_totals_delta(spark):
    old = spark.createDataFrame([(5,), (5,)], "n long")
    assert versions.totals_delta(old, spark.createDataFrame([(20,)], "n long"), ["n"]).first()[0] == 10
    assert versions.totals_delta(old, old.limit(0), ["n"]).first()[0] == -10


def test_snapshot_history(spark, tmp_path):
    files = spark.createDataFrame([("a", 1, b"x"), ("b", 2, None)], "path string, size long, content binary")
    for day in ("2024-01", "2024-02"):
        versions.append_snapshot(versions.snapshot(files, day), f"file://{tmp_path}/history")
    history = spark.read.parquet(f"file://{tmp_path}/history")
    assert history.count() == 4 and versions.latest_before(history.withColumn("snapshot_id", F.col("snapshot_id").cast("string")), "2024-02").first()[0] == "2024-01"


def test_edges_and_closure(spark):
    rows = spark.createDataFrame([("a", "type a from b\ncreate n_x\nopen(w_y)\nx.dataobject = 'd_z'\nselect 1 from t where"), ("b", "type b from UserObject")], "name string, text string")
    found = {(r["dst"], r["kind"]) for r in graph.edges(rows, "name").where("src = 'a'").collect()}
    assert found == {("b", "inherits"), ("n_x", "creates"), ("w_y", "opens"), ("d_z", "report"), ("b", "table"), ("t", "table")}
    assert [tuple(r) for r in graph.inheritance(rows).collect()] == [("a", "b")]
    chain = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "child string, parent string")
    assert ("a", "c", 2) in {tuple(r) for r in graph.ancestors(chain).collect()}


def test_library_of(spark):
    names = {"d_x.srd": "dw_shop", "w_login.srw": "framework", "w_login_a.srw": "framework", "w_sys_a.srw": "sys", "w_shop_a.srw": "shop", "w_report1.win": "shop", "u_a.sru": "common", "a.apl": "app", "x\\y.gif": None, "f_a.fun": "common_fun", "zz.src": "common", "k.xyz": "shop"}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r[0]: r[1] for r in df.select("n", graph.library_of(F.col("n"), "Shop")).collect()} == names
    assert spark.range(1).select(graph.library_of(F.lit("d_x.srd"), "shop", [("d_", "mine")])).first()[0] == "mine"


def test_project_type(spark):
    kinds = lambda *e: graph.project_type(spark.createDataFrame([(x,) for x in e], "ext string")).first()[0]
    assert [kinds("pbl"), kinds("exe"), kinds("pbl", "pbd"), kinds("txt")] == ["PBL", "BINARY", "MIXED", "UNKNOWN"]
    assert kinds("dll", "txt") == "UNKNOWN"
    files = spark.createDataFrame([("dll", "a.dll", True), ("exe", "setup.exe", False), ("pbd", "shop.pbd", None)], "ext string, name string, embedded boolean")
    assert graph.project_type(files.where("ext = 'dll'")).first()[0] == "BINARY" and graph.project_name(files, "/w/x").first()[0] == "shop"
    assert graph.project_name(files.withColumn("embedded", F.lit(True)), "/w/x").first()[0] == "setup"


def test_aggregates(spark):
    df = spark.createDataFrame([("a", 3), ("b", 3), ("c", 1), ("d", None)], "name string, size long")
    assert tuple(aggregates.size_stats(df, "size", "name").first()) == (7, 1, "a", "c")
    buckets = aggregates.bucketed(spark.createDataFrame([(10,), (600,)], "n int"), aggregates.size_bucket(F.col("n")), aggregates.SIZE_BUCKETS)
    assert [r["n"] for r in buckets.orderBy("place").collect()] == [1, 0, 0, 1, 0]
    row = spark.range(1).select(aggregates.review_score(F.lit(0), F.lit(200_000), F.lit(50), F.lit(60)), aggregates.score_label(F.lit(60))).first()
    assert tuple(row) == (60, "fair")
    assert tuple(spark.range(1).select(*aggregates.effort(F.lit(3), F.lit(2), F.lit(1))).first()) == (2, 8)


def test_ancestors_of_a_long_chain(spark):
    chain = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(200)] + [("a", "a"), ("b", None)], "child string, parent string")
    found = {(r["child"], r["ancestor"]): r["distance"] for r in graph.ancestors(chain).collect()}
    assert len(found) == 200 * 201 // 2 and found["n0", "n200"] == 200
    assert graph.ancestors(chain.limit(0)).count() == 0


def test_dependent_rows(spark):
    rows = spark.createDataFrame([("a", "x"), ("b", "x"), ("a", "x"), (None, "x")], "src string, dst string")
    assert graph.dependents(rows).first()["dependents"] == ["a", "b"] and graph.dependent_counts(rows).first()["n"] == 2


def test_history_on_disk(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, "x")], "path string, size long, content string")
    for day in ("d1", "d2"):
        versions.append_snapshot(versions.snapshot(rows, day), f"file://{tmp_path}/h")
    assert versions.delete_snapshot(spark, f"file://{tmp_path}/h", "d1") and not versions.delete_snapshot(spark, f"file://{tmp_path}/h", "d9")
    assert [r["snapshot_id"] for r in versions.listed_snapshots(spark.read.parquet(f"file://{tmp_path}/h")).collect()] == ["d2"]
