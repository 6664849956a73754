"""Files in archives: the same tree as loose files, with an inode for many of them."""

import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lodestrata.plans import object_extra, object_queries
from lodestrata.sources import executable_source, sinks

BIG = bytes(range(256)) * 6000  # beyond what is compressed
ROWS = [(f"a/{i % 3}/f{i}", bytes([i]) * i, None) for i in range(50)] + [("big", BIG[:900_000], None), ("big", BIG[900_000:], None), ("none", None, None), ("../out", b"x", None), ("n\0l", b"x", None), ("bad", b"x", "broken")]


def _files(folder):
    return {str(p.relative_to(folder)): p for p in folder.rglob("*") if p.is_file() and sinks.MANIFEST not in str(p)}


def test_archives_hold_the_tree_of_loose_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "ARCHIVE_FILES", 20)
    rows = spark.createDataFrame(ROWS, "path string, content binary, error string").coalesce(1)
    loose = sinks.write_files(rows.where("path <> 'n\\0l'"), f"file://{tmp_path}/loose", error="error")
    done = sinks.write_files(rows, f"file://{tmp_path}/packed", error="error", archived=True)
    want = {name: p.read_bytes() for name, p in _files(tmp_path / "loose").items()}
    held = {n: z.read(n) for p in _files(tmp_path / "packed").values() for z in [zipfile.ZipFile(p)] for n in z.namelist()}
    assert held == want and len(want) == 52 and len(_files(tmp_path / "packed")) == 3
    assert dict(map(tuple, sinks.archived_files(done, f"file://{tmp_path}/packed").collect())) == {k: bytearray(v) for k, v in want.items()}
    told = lambda df: sorted(map(str, df.where("path <> 'n\\0l'").select("path", "bytes", "error").collect()))
    assert told(done) == told(loose) and done.where("path = 'n\\0l' and error is not null").count() == 1
    assert [r["packed"] for r in done.where("path = 'big'").collect()] == [None]
    sinks.discard_files(f"file://{tmp_path}/packed")
    assert not _files(tmp_path / "packed") and done.count() == 55


def test_a_job_that_fails_leaves_no_archive(spark, tmp_path):
    rows = spark.range(100).select(F.concat(F.lit("f"), "id").alias("path"), F.when(F.col("id") == 77, F.raise_error(F.lit("no"))).otherwise(F.lit(b"x")).cast("binary").alias("content"))
    with pytest.raises(Exception, match="no"):
        sinks.write_files(rows, f"file://{tmp_path}/out", archived=True)
    assert not _files(tmp_path)


def test_exports_of_one_file_per_event_make_few_files(spark, monkeypatch):
    """How many files each query has on disk when all of them are there."""
    seen = []
    dropped = sinks.discard_files

    def count(folder, listed=None):
        seen.append(sum(1 for p in Path(folder.removeprefix("file://").removeprefix("file:")).rglob("*") if p.is_file() and sinks.MANIFEST not in str(p)))
        dropped(folder, listed)

    for module in (object_queries, object_extra):
        monkeypatch.setattr(module.sinks, "discard_files", count)
    rows = [__spark_entry__.queries()[q](spark, "/root/testdata/sf0.001").count() for q in ("exported_sources", "exported_tree", "exported_resources", "export_outcomes", "ranged_libraries")]
    assert rows == [1000, 1000, 2000, 5, 1000] and max(seen) <= 32 and len(seen) == 5


def test_ranges_of_files_in_archives_are_those_of_loose_files(spark, tmp_path):
    made = [(f"{n}.exe", (b"MZ" + b"x" * 600 + b"HDR*" * 500)[:size]) for n, size in (("a", 0), ("b", 699), ("c", 700), ("d", 2500))] + [("e.exe", (b"MZ" + BIG + b"HDR*" + b"y" * 508 + b"FRE*"))]
    rows = spark.createDataFrame(made, "path string, content binary")
    loose, packed = sinks.write_files(rows, f"file://{tmp_path}/loose"), sinks.write_files(rows, f"file://{tmp_path}/packed", archived=True)
    where = lambda c: F.concat(F.lit(f"file://{tmp_path}/packed/"), c)
    want = executable_source.marks_of(loose.select(F.concat(F.lit(f"file://{tmp_path}/loose/"), "path").alias("path"), F.col("bytes").alias("size")), 700)
    found = executable_source.marks_of(packed.select(where("path").alias("path"), F.col("bytes").alias("size"), where("archive").alias("archive"), "at", "packed"), 700)
    plain = lambda df: sorted(str(r).replace("/packed/", "/loose/") for r in df.collect())
    assert plain(found) == plain(want) and len(plain(want)) > 2000
