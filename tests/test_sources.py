import json
import random
import struct

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestrata.plans import reports
from lodestrata.sources import executable_source, executables, files, libraries, library_source, sinks
from lodestrata.streaming import changes


@pytest.mark.parametrize("unicode", [True, False])
def test_library_round_trip(spark, unicode):
    items = [(f"w_{i}.srw", bytes([65 + i % 26]) * n) for i, n in enumerate([501, 502, 503, 1004, 1005] + [20] * 90)]
    raw = libraries.build(items, unicode, stamp=100_000_000)
    df = spark.createDataFrame([("a.pbl", raw), ("bad.pbl", b"junk"), ("cut.pbl", raw[:2000])], "path string, content binary")
    rows = libraries.read_entries(df)
    good = rows.where("path = 'a.pbl'").orderBy("ordinal").collect()
    assert [(r["name"], bytes(r["data"])) for r in good] == items and all(r["is_source"] and r["type_name"] == "window" for r in good)
    assert str(good[0]["modified"]) == "1973-03-03 09:46:40"
    assert rows.where("path = 'bad.pbl'").first()["error"]


def test_names_and_pack(spark):
    raw = libraries.build([("d_Über.srd", b"1"), ("D_ÜBER.SRD", b"2"), ("x.bin", b"3"), ("gf_a", b"4")])
    assert [(e["name"], e["type_name"], e["data"]) for e in libraries.entries(raw)] == [("D_ÜBER.SRD", "datawindow", b"2"), ("x.bin", "binary", b"3"), ("gf_a", "function", b"4")]
    packed = libraries.pack(spark.createDataFrame([("l", "a.srw", b"x"), ("l", "b.srw", b"y")], "library string, name string, data binary"))
    assert libraries.read_entries(packed.select(F.col("library").alias("path"), "content")).count() == 2


def test_sibling_cycle_ends():
    raw = bytearray(libraries.build([("a.srw", b"x")]))
    node = raw.index(b"NOD*")
    struct.pack_into("<I", raw, node + 12, node)
    assert len(list(libraries.entries(bytes(raw)))) == 1


def test_source_text(spark):
    said = {"long of_x".encode("utf-16-le"): "long of_x", "\ufeffbom".encode(): "bom", "名称".encode("gbk"): "名称", b"\xff\xfea\x00b\x00": "ab", b"\xfe\xff\x00a\x00\x00\x00b": "a", b"": "", b"x": "x", b"a\x00b": "ab", b"caf\xe9": "café", b"abcd": "abcd", None: None, "é".encode(): "é", b"a\x00b\x00c": "ab", b"\xff\xfe": ""}
    df = spark.createDataFrame([(k,) for k in said], "data binary")
    assert {None if r[0] is None else bytes(r[0]): r[1] for r in df.select("data", libraries.source_text(F.col("data"))).collect()} == said
    back = spark.range(1).select(libraries.encoded(F.lit("名é"), "gbk"), libraries.encoded(F.lit("a"))).first()
    assert bytes(back[0]) == "名é".encode("gbk", "replace") and bytes(back[1]) == b"a\0"


def executable(library: bytes) -> bytes:
    pe = bytearray(512)
    pe[:2] = b"MZ"
    struct.pack_into("<I", pe, 60, 64)
    pe[64:68] = b"PE\0\0"
    struct.pack_into("<HHI8xHH", pe, 68, 0x14C, 1, 1000, 224, 0)
    struct.pack_into("<H", pe, 88, 0x10B)
    struct.pack_into("<II", pe, 88 + 224 + 16, 0, 512)
    return bytes(pe) + library


def test_executable_with_library(spark):
    lib = libraries.build([("w_a.srw", b"hello")])
    df = spark.createDataFrame([("a.exe", executable(lib)), ("b.exe", b"MZ")], "path string, content binary")
    rows = {r["path"]: r for r in executables.read_images(df).collect()}
    assert rows["a.exe"]["machine"] == "x86" and rows["a.exe"]["is_pb_exe"] and rows["a.exe"]["embedded"][0]["place"] == "appended" and rows["b.exe"]["error"]
    assert [r["name"] for r in libraries.read_entries(executables.embedded_libraries(df)).collect()] == ["w_a.srw"]


@pytest.mark.parametrize("size", [64, 513, 1 << 20])
def test_ranges_find_what_the_whole_file_has(spark, tmp_path, size):
    """Marks lie at every distance from a seam; a mark that is no library ends the one before it."""
    lib, r = libraries.build([("w_a.srw", b"hello")]), random.Random(size)
    files_of = {"plain.exe": executable(b""), "one.exe": executable(lib), "named.exe": executable(b"made with PowerBuilder"), "bad.exe": b"MZ", "none.exe": b""}
    for k in range(12):
        junk = bytes(r.randrange(97, 123) for _ in range(r.randrange(0, 1500)))
        files_of[f"f{k}.exe"] = executable(junk + lib + b"HDR*" * (k % 3) + junk[:k] + lib + junk)
    signed = bytearray(executable(lib + b"HDR*" + lib))
    struct.pack_into("<H", signed, 84, 240)  # room for the directories
    signed[88 + 240 : 88 + 280] = signed[88 + 224 : 88 + 264]
    struct.pack_into("<II", signed, 88 + 96 + 8 * executables.CERTIFICATES, 512 + len(lib) + 4, 9)
    files_of["signed.exe"] = bytes(signed)
    for name, raw in files_of.items():
        (tmp_path / name).write_bytes(raw)
    executable_source.register(spark)
    marks = spark.read.format("executable").option("rangeBytes", size).load(f"file://{tmp_path}").cache()
    base = F.element_at(F.split("path", "/"), -1)
    got = sorted(map(tuple, executable_source.libraries_inside(marks).select(base, "offset", "size", "place").collect()))
    expected, kinds = [], {}
    for name, raw in files_of.items():
        try:
            found = executables.image(raw)
            kinds[name] = (found["is_pb_exe"], len(found["embedded"]), None)
            expected += [(name, x["offset"], x["size"], x["place"]) for x in found["embedded"]]
        except ValueError as e:
            kinds[name] = (None, 0, str(e))
    assert got == sorted(expected) and len(got) > 24
    seen = {x["f"]: (x["is_pb_exe"], x["libraries"], x["error"]) for x in executable_source.images(marks).withColumn("f", base).collect()}
    assert seen == {k: v for k, v in kinds.items() if k != "none.exe"} | {"none.exe": (None, 0, "no executable")}
    assert kinds["signed.exe"][1] == 1 and kinds["named.exe"][0]


@pytest.fixture
def tree(tmp_path):
    for name, content in {"lib/w_main.srw": b"hello world\nfoo bar", "lib/d_x.SRD": "﻿SELECT".encode("utf-16-le"), "a.pbl": b"HDR*....", ".git/w_z.srw": b"hello", "node_modules/w_y.srw": b"hello", "run.exe": b"MZ..", "note.txt": b"hello"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(content)
    return tmp_path


def test_scan(spark, tree):
    rows = files.read_sources(spark, f"file://{tree}")
    assert {(r["relative"], r["library"], r["ext"], r["text"]) for r in rows.collect()} == {("lib/w_main.srw", "lib", ".srw", "hello world\nfoo bar"), ("lib/d_x.SRD", "lib", ".srd", "SELECT")}
    every = files.with_names(files.scan(spark, f"file://{tree}"), f"file://{tree}")
    p = files.projects(every).first()
    assert p["libraries"] == ["a.pbl"] and p["binaries"] == ["run.exe"] and p["is_valid"]
    kinds = {r[0]: r[1] for r in every.select("name", files.file_kind(F.col("content"), F.col("name"))).collect()}
    assert kinds["a.pbl"] == "pbl" and kinds["run.exe"] == "exe"


def test_stream(spark, tree):
    stream = changes.hits(changes.watch(spark, f"file://{tree}"), "hello")
    q = stream.writeStream.format("memory").queryName("hits").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["name"] for r in spark.table("hits").collect()} == {"w_main.srw", "w_y.srw"}  # Spark lists no hidden folders


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("a|b", 1), ("<c>", None)], "name string, n int")
    sections = {"S": reports.Section(df, ["name"]), "none": reports.Section(df.limit(0), ["name"])}
    said = lambda form: [r["line"] for r in reports.rendered("T & co", sections, form).orderBy("section", "part", "place").collect()]
    assert said("markdown") == ["# T & co", "", "## S", "", "| name | n |", "|---|---|", "| <c> |  |", "| a\\|b | 1 |", "", "## none", "", "| name | n |", "|---|---|", ""]
    assert "<tr><td>&lt;c&gt;</td><td></td></tr>" in said("html") and "T &amp; co" in said("html")[0]
    assert json.loads("".join(said("json"))) == {"title": "T & co", "S": [{"name": "<c>", "n": None}, {"name": "a|b", "n": 1}], "none": []}
    many = spark.range(5000).select(F.col("id").alias("n"))
    lines = reports.rendered("M", {"S": reports.Section(many, ["n"])})
    assert lines.where("part = 1").select("place", "line").orderBy("place").collect() == [(i + 1, f"| {i} |") for i in range(5000)]
    reports.write_report(lines, f"file://{tmp_path}/report")
    written = "".join(p.read_text() for p in sorted((tmp_path / "report").glob("part-*"))).splitlines()
    assert len(written) == 5000 + 7 and written[6:8] == ["| 0 |", "| 1 |"] and written[-2] == "| 4999 |"
    reports.export_sources(df, f"file://{tmp_path}/out", ["name"])
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 2


def test_config(tmp_path):
    from lodestrata.plans import config

    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / config.NAME).write_text('{"thresholds": {"nesting": 7}, "own": 1}')
    found = config.load(str(tmp_path / "a" / "b"))
    assert found["thresholds"] == {"routine_lines": 200, "nesting": 7, "complexity": 20} and found["own"] == 1
    assert config.load(str(tmp_path)) == config.DEFAULTS


def test_strict_reader_and_comments():
    raw = bytearray(libraries.build([("w_a.srw", b"1"), ("w_b.srw", b"2")], version="0600"))
    second = raw.index("0600".encode("utf-16-le"), raw.index(b"ENT*", raw.index(b"ENT*") + 4))
    raw[second : second + 8] = "1250".encode("utf-16-le")
    assert [e["name"] for e in libraries.entries(bytes(raw), strict=True)] == ["w_a.srw"] and len(list(libraries.entries(bytes(raw)))) == 2
    assert libraries.type_of("x", "A Data Window? no: datawindow object") == (1, False) and libraries.type_of("w_a.srw", "user object") == (6, True)


def test_left_siblings_are_read_too():
    raw = bytearray(libraries.build([(f"w_{i:02}.srw", b"x") for i in range(60)]))
    first = raw.index(b"NOD*")
    struct.pack_into("<II", raw, first + 4, struct.unpack_from("<I", raw, first + 12)[0], 0)
    struct.pack_into("<I", raw, first + 12, 0)
    assert len(list(libraries.entries(bytes(raw)))) == 40 and len(list(libraries.entries(bytes(raw), strict=True))) == 60


def test_libraries_too_large_are_errors(spark):
    rows = spark.createDataFrame([("a", "w.srw", b"x" * 5000), ("b", "w.srw", b"x"), ("c", "n" * 2000 + ".srw", b"x"), ("d", None, b"x"), ("e", "w.srw", None)], "library string, name string, data binary")
    got = {r["library"]: r["error"] for r in libraries.pack(rows, largest=9000).collect()}
    assert got == {"a": "too large", "b": None, "c": "names too long for a node", "e": None}


@pytest.mark.parametrize("unicode", [True, False])
def test_blocks_are_those_of_a_library_in_memory(spark, unicode):
    r = random.Random(5)
    items = {lib: [(f"{r.choice('wdfu')}_{r.choice(['x', 'X', 'é'])}{i}.sr{r.choice('wdf')}", bytes([65 + i % 26]) * r.choice([0, 1, 501, 502, 503, 1004, 5000])) for i in range(n)] for lib, n in (("a", 95), ("b", 1), ("c", 40), ("d", 41))}
    items["b"] += [("Same.srw", b"1"), ("same.SRW", b"2")]
    rows = spark.createDataFrame([(lib, n, d) for lib, each in items.items() for n, d in each], "library string, name string, data binary").repartition(3)
    expected = {lib: libraries.build(sorted(each), unicode) for lib, each in items.items()}
    assert {x["library"]: bytes(x["content"]) for x in libraries.pack(rows, unicode=unicode).collect()} == expected
    blocks, errors = libraries.library_blocks(rows, unicode=unicode)
    assert errors.count() == 0 and blocks.agg(F.max(F.octet_length("bytes"))).first()[0] < 6000
    text = libraries.pack(rows)._jdf.queryExecution().toString()
    assert "FlatMapGroupsInPandas" not in text


def test_libraries_beyond_one_value_are_written(spark, tmp_path):
    rows = spark.createDataFrame([("big", f"w_{i:02}.srw", bytes([i]) * 3000) for i in range(50)] + [("bad", "n" * 2000 + ".srw", b"x")], "library string, name string, data binary")
    assert {r["library"]: r["error"] for r in libraries.pack(rows, largest=9000).collect()} == {"big": "too large", "bad": "names too long for a node"}
    done = {r["path"]: (r["bytes"], r["error"]) for r in sinks.write_libraries(rows, f"file://{tmp_path}/out").collect()}
    raw = (tmp_path / "out/big.pbl").read_bytes()
    assert done == {"big.pbl": (len(raw), None), "bad.pbl": (None, "names too long for a node")} and not (tmp_path / "out/bad.pbl").exists()
    assert raw == libraries.build([(f"w_{i:02}.srw", bytes([i]) * 3000) for i in range(50)])


@pytest.fixture
def shelf(tmp_path):
    for k in range(3):
        (tmp_path / f"lib{k}.pbl").write_bytes(libraries.build([(f"w_{k}_{i}.srw", bytes([65 + i % 26]) * (1 + 997 * i % 4001)) for i in range(90)] + [(f"d_{k}.srd", b"report")], stamp=100_000_000))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/bad.PBD").write_bytes(b"junk")
    (tmp_path / "sub/cut.pbl").write_bytes(libraries.build([(f"w_{i}.srw", b"x") for i in range(60)])[:6000])
    (tmp_path / "notes.txt").write_bytes(b"HDR*")
    return tmp_path


@pytest.mark.parametrize("split", [1 << 30, 20_000])
def test_library_source_equals_the_reader(spark, shelf, split):
    library_source.register(spark)
    read = spark.read.format("library").option("splitBytes", split).load(f"file://{shelf}")
    raw = files.scan(spark, f"file://{shelf}").where("lower(path) like '%.pb_'").select(F.regexp_replace("path", "^file:/+", "file:///").alias("path"), "content")
    key = lambda df: sorted(map(str, df.collect()))
    assert key(read) == key(libraries.read_entries(raw)) and read.count() == 3 * 91 + 2
    assert key(read.where("type_name = 'datawindow'")) == key(libraries.read_entries(raw).where("type_name = 'datawindow'"))
    assert read.where("name in ('d_1.srd', 'w_2_5.srw')").count() == 2 and read.where("path like '%lib1.pbl' and size > 100").count() > 10
    assert (read.rdd.getNumPartitions() > 5) == (split == 20_000)


def test_a_filter_reads_fewer_bytes(shelf):
    from pyspark.sql.datasource import EqualTo, GreaterThan

    def read(*filters):
        reader = library_source.LibraryReader({"path": f"file://{shelf}"})
        left, n, rows = list(reader.pushFilters(list(filters))), 0, 0
        for part in [p for bundle in reader.partitions() for p in bundle.parts]:
            with open(part.path.removeprefix("file://"), "rb") as f:
                region = library_source.FileRegion(pa.PythonFile(f), part.size)
                rows += sum(b.num_rows for b in reader.batches(part, region))
                n += region.read_bytes
        return n, rows, left

    everything, one, library = read(), read(EqualTo(("name",), "d_1.srd")), read(EqualTo(("path",), f"file://{shelf}/lib2.pbl"), GreaterThan(("size",), 5))
    assert everything[1] == 275 and one[1] == 1 and one[0] < everything[0] / 5 and one[2] == []
    assert library[1] == 91 and library[0] < everything[0] / 2 and len(library[2]) == 1


def test_a_failed_export_leaves_nothing(spark, tmp_path):
    folder = tmp_path / "out"

    @F.udf("binary")
    def broken(i):
        if i == 7:
            raise ValueError("no")
        return b"data"

    rows = spark.range(40).repartition(4).select(F.concat(F.lit("d/f"), "id").alias("path"), broken("id").alias("content"))
    with pytest.raises(Exception):
        sinks.write_files(rows, f"file://{folder}")
    assert [p for p in folder.rglob("*") if p.is_file()] == []
    good = sinks.write_files(rows.where("id <> 7"), f"file://{folder}")
    assert good.count() == good.count() == 39 and sum(p.is_file() for p in (folder / "d").iterdir()) == 39
    listed = [p for p in (folder / sinks.MANIFEST).rglob("*.json")]
    assert sum(len(p.read_text().splitlines()) for p in listed) == 39 and not list((folder / sinks.STAGING).glob("*"))
    sinks.discard_files(f"file://{folder}")
    assert good.count() == 39 and not (folder / "d").exists()


def test_two_attempts_of_a_task(tmp_path):
    writer = sinks.FileWriter(f"file://{tmp_path}", "job")
    rows = lambda *x: iter([pa.record_batch([pa.array([p for p, _ in x], pa.string()), pa.array([c for _, c in x], pa.binary())], ["path", "content"])])
    first, second, other = writer.write(rows(("a", b"1"), ("b/c", b"2"))), writer.write(rows(("a", b"1"), ("b/c", b"2"))), writer.write(rows(("big", b"x"), ("big", b"y"), ("big", None), ("../z", b"0"), ("..name", b"3")))
    writer.commit([second, other, None])
    assert first.attempt != second.attempt and (other.files, other.errors) == (2, 1)
    assert {str(p.relative_to(tmp_path)): p.read_bytes() for p in tmp_path.rglob("*") if p.is_file() and sinks.MANIFEST not in str(p)} == {"a": b"1", "b/c": b"2", "big": b"xy", "..name": b"3"}


def test_outcomes_are_observed_during_the_export(spark, tmp_path):
    raw = libraries.build([("w_a.srw", b"long enough to be written"), ("w_b.srw", b"short"), ("x.bin", b"compiled")])
    df = spark.createDataFrame([("a/one.pbl", raw), ("bad.pbl", b"junk")], "path string, content binary")
    done, counts = sinks.export_entries(libraries.read_entries(df), f"file://{tmp_path}/out")
    assert counts == {"sources": 2, "compiled": 1, "failed": 1, "skipped": 1}
    assert [r["path"] for r in done.collect()] == ["one/window/w_a.srw"] and (tmp_path / "out/one/window/w_a.srw").exists()


def test_files_are_written(spark, tmp_path):
    rows = spark.createDataFrame([("l", "w_a.srw", "window", "long enough\0 text"), ("l", "w_b.srw", "window", "short"), ("m", "ws.srx", "web_service", "also long enough")], "library string, name string, type_name string, text string")
    done = sinks.write_files(sinks.export_paths(rows, by_type=True, library="library"), f"file://{tmp_path}/out").collect()
    assert {(r["path"], r["bytes"], r["error"]) for r in done} == {("l/window/w_a.srw", 16, None), ("m/webservice/ws.srx", 16, None)}
    assert (tmp_path / "out/l/window/w_a.srw").read_text() == "long enough text"
    bad = spark.createDataFrame([("../x", b"1"), (None, b"1"), ("/abs", b"1")], "path string, content binary")
    assert all(r["error"] for r in sinks.write_files(bad, f"file://{tmp_path}/out").collect()) and not (tmp_path / "x").exists()
    tree = sinks.tree_paths(rows.select("name", "text"), "shop")
    assert {r["path"] for r in tree.collect()} == {"framework.pbl/w_a.srw", "common.pbl/ws.srx"}


def test_four_reports(spark):
    objects = spark.createDataFrame([("l", "w_a", "window", 3)], "library string, name string, kind string, lines int")
    findings = spark.createDataFrame([("w_a", 1, "GOTO_USAGE", "warning", "")], "name string, line_no int, rule string, severity string, message string")
    listed = spark.createDataFrame([("d_a", "grid", ["t"], [("t.a", "long")], "select a from t")], "name string, style string, tables array<string>, columns array<struct<dbname:string,type:string>>, sql string")
    pairs = spark.createDataFrame([("l", "m", 2)], "src_library string, dst_library string, n long")
    advice = spark.createDataFrame([("clean", 0)], "suggestion string, n long")
    said = lambda lines: "\n".join(r["line"] for r in lines.collect())
    found = said(reports.rendered("R", reports.review_sections(objects, findings, listed, pairs, advice)))
    assert all(x in found for x in ("| window | 1 | 3 |", "| t | 1 |", "| d_a | grid | t | 1 | true |", "| l | m | 2 |", "| clean | 0 |"))
    users = spark.createDataFrame([("d_a", ["w_a"])], "name string, used_by array<string>")
    assert "<td>w_a</td>" in said(reports.rendered("D", reports.report_object_sections(listed, users), "html"))
    assert '"rule":"GOTO_USAGE"' in said(reports.rendered("F", reports.refactoring_sections(findings), "json"))


def test_files_are_moved_by_tasks(tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "b/c").write_bytes(b"older")
    writer = sinks.FileWriter(f"file://{tmp_path}", "job", later=True)
    message = writer.write(iter([pa.record_batch([pa.array(["a", "b/c"]), pa.array([b"1", b"2"], pa.binary())], ["path", "content"])]))
    writer.commit([message, None])
    assert not (tmp_path / "a").exists() and (tmp_path / "b/c").read_bytes() == b"older"
    for _ in range(2):  # a task that moves files may run twice
        sinks.place_attempt(f"file://{tmp_path}", message.attempt)
    writer.finish([message.attempt])
    assert (tmp_path / "a").read_bytes() == b"1" and (tmp_path / "b/c").read_bytes() == b"2" and not list((tmp_path / sinks.STAGING).glob("*"))


def test_small_files_share_batches():
    import pyarrow as pa

    from lodestrata.sources import executables, libraries

    class Files:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            return run

    small = pa.record_batch([pa.array([str(i) for i in range(50)] + ["bad"]), pa.array([libraries.build([("w_a.srw", b"hello")])] * 50 + [b"none"])], ["path", "content"])
    read = list(libraries.read_entries(Files())(iter([small])))
    assert [b.num_rows for b in read] == [51] and read[0].column("error").null_count == 50
    large = pa.record_batch([pa.array(["a", "b"]), pa.array([libraries.build([("w_a.srw", b"x" * (1 << 21))])] * 2)], ["path", "content"])
    assert [b.num_rows for b in libraries.read_entries(Files())(iter([large]))] == [1, 1]
    assert [b.num_rows for b in executables.read_resources(Files())(iter([small]))] == [51]


def test_a_report_runs_the_rules_once(spark):
    findings = spark.range(20).selectExpr("concat('w_', id) AS name", "CAST(id AS INT) AS line_no", "'GOTO_USAGE' AS rule", "'warning' AS severity", "id AS event_id")
    for section in reports.refactoring_sections(findings).values():
        assert "Range" not in section.rows._jdf.queryExecution().analyzed().toString()
