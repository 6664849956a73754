"""Snapshots and differences between versions: files, routines, lines."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def diff(old: DataFrame, new: DataFrame, keys: list[str], compare: list[str], unchanged: bool = False) -> DataFrame:
    """``keys`` and ``status``: added (only in the new version), removed, modified and, if asked for, unchanged.

    One full outer join on the keys; both sides bring the keys and the
    compared columns alone.
    """
    a = old.select(*keys, F.struct(*compare).alias("_old"))
    b = new.select(*keys, F.struct(*compare).alias("_new"))
    status = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") == F.col("_new"), "unchanged").otherwise("modified")
    both = a.join(b, keys, "full_outer").withColumn("status", status)
    return (both if unchanged else both.where("status <> 'unchanged'")).select(*keys, "status")


def diff_by_base_name(old: DataFrame, new: DataFrame, path: str, compare: list[str]) -> DataFrame:
    """Like :func:`diff` on the file name alone; of one name in two folders the last path counts."""
    name = F.element_at(F.split(F.col(path), "/"), -1)
    once = lambda df: df.groupBy(name.alias("name")).agg(F.max_by(F.struct(*compare), path).alias("v")).select("name", "v.*")
    return diff(once(old), once(new), ["name"], compare, unchanged=True)


def totals_delta(old: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """New less old sums."""
    a = old.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"_{c}") for c in columns])
    b = new.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns])
    k = F.lit(1).alias("k")
    return a.select("*", k).join(b.select("*", k), "k").select(*[(F.col(c) - F.col(f"_{c}")).alias(c) for c in columns])


def changed_files(old: DataFrame, new: DataFrame, path: str = "path", by: tuple[str, ...] = ("modified", "size", "checksum")) -> DataFrame:
    """Files of an index to read again: changed, new and removed ones."""
    return diff(old, new, [path], list(by))


def line_diff(old: DataFrame, new: DataFrame, keys: list[str], line: str = "line") -> DataFrame:
    """Line against line by number: ``old_line`` and ``new_line`` where they differ."""
    a = old.select(*keys, "line_no", F.col(line).alias("old_line"))
    b = new.select(*keys, "line_no", F.col(line).alias("new_line"))
    return a.join(b, [*keys, "line_no"], "full_outer").where(~F.col("old_line").eqNullSafe(F.col("new_line")))


def line_set_counts(old_lines: Column, new_lines: Column) -> tuple[Column, Column]:
    """Distinct lines only in the new and only in the old version."""
    return F.size(F.array_except(new_lines, old_lines)), F.size(F.array_except(old_lines, new_lines))


def routine_diff(old: DataFrame, new: DataFrame, keys: list[str], old_variables: DataFrame | None = None, new_variables: DataFrame | None = None) -> DataFrame:
    """Routines added, removed or with another script; with variables given, those added or removed too: ``keys, name, part, status``.

    Of routines with one name the first by line is compared.
    """
    once = lambda df: df.groupBy(*keys, "name").agg(F.min_by("script", "line_start").alias("script"))
    out = diff(once(old), once(new), [*keys, "name"], ["script"]).withColumn("part", F.lit("routine"))
    if old_variables is not None and new_variables is not None:
        names = lambda df: df.select(*keys, "name").distinct().withColumn("_", F.lit(1))
        out = out.unionByName(diff(names(old_variables), names(new_variables), [*keys, "name"], ["_"]).withColumn("part", F.lit("variable")))
    return out.select(*keys, "name", "part", "status")


def name_sets(old: Column, new: Column) -> Column:
    """Names added, removed and in both."""
    return F.struct(F.array_sort(F.array_except(new, old)).alias("added"), F.array_sort(F.array_except(old, new)).alias("removed"), F.array_sort(F.array_intersect(old, new)).alias("common"))


def without_repeats(a: Column) -> Column:
    """Neighbouring equal elements made one."""
    return F.filter(a, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(a, i - 1)))


def snapshot(files: DataFrame, snapshot_id: str, path: str = "path", size: str = "size", content: str = "content") -> DataFrame:
    """``snapshot_id, path, size, hash`` of every file."""
    return files.select(F.lit(snapshot_id).alias("snapshot_id"), path, size, F.sha2(F.col(content).cast("binary"), 256).alias("hash"))


def append_snapshot(rows: DataFrame, folder: str) -> None:
    """Add a snapshot to a history, partitioned by its id."""
    rows.write.mode("append").partitionBy("snapshot_id").parquet(folder)


def snapshot_rows(snapshots: DataFrame, snapshot_id) -> DataFrame:
    """The files of one snapshot; none for an unknown id. A history partitioned by id is read in that partition alone."""
    return snapshots.where(F.col("snapshot_id") == F.lit(snapshot_id))


def listed_snapshots(snapshots: DataFrame) -> DataFrame:
    """Id, files and bytes of every snapshot of a history."""
    return snapshots.groupBy("snapshot_id").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def without_snapshot(snapshots: DataFrame, snapshot_id) -> DataFrame:
    """A history without one snapshot."""
    return snapshots.where(~F.col("snapshot_id").eqNullSafe(F.lit(snapshot_id)))


def delete_snapshot(spark: SparkSession, folder: str, snapshot_id: str) -> bool:
    """Take a snapshot out of a history on disk: its partition alone goes. Whether there was one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/snapshot_id={snapshot_id}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


LATEST_SCHEMA = "id string, label string, timestamp string, source string, files array<struct<path:string,size:long,hash:string>>"


def latest_json(texts: DataFrame, column: str = "value") -> DataFrame:
    """``id, label, timestamp, source, files`` of snapshots written as JSON, a whole document each; null fields where one is broken."""
    return texts.select(F.from_json(column, LATEST_SCHEMA).alias("s")).select("s.*")


def as_latest_json(rows: DataFrame, label: str = "", source: str = "") -> DataFrame:
    """One JSON document for each snapshot, as :func:`latest_json` reads it; as long as a snapshot has files."""
    files = F.array_sort(F.collect_list(F.struct("path", "size", "hash"))).alias("files")
    packed = rows.groupBy(F.col("snapshot_id").cast("string").alias("id")).agg(files)
    return packed.select(F.to_json(F.struct("id", F.lit(label).alias("label"), F.lit(source).alias("source"), "files")).alias("value"))


def refreshed_index(old: DataFrame, files: DataFrame, build, path: str = "path", by: tuple[str, ...] = ("size", "checksum")) -> DataFrame:
    """An index over ``files`` that keeps the rows of unchanged files and builds the others anew.

    ``build`` turns files into index rows and sees changed and new ones
    alone; rows of files that are gone are dropped. A row is kept if a file
    has its path and compared values, a file is built if no row has its.

    Both joins are on the same keys and merge, so either side is computed and
    shuffled once where the keys are all of it; and Spark takes rows with
    short texts to be smaller than they are, and might broadcast them.
    """
    keys = [path, *by]
    seen = lambda df: df.select(*[F.col(c).alias(f"_{c}") for c in keys]).hint("merge")
    equal = (F.col(path) == F.col(f"_{path}")) & reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by])
    same = old.join(seen(files), equal, "left_semi")
    fresh = build(files.where(F.col(path).isNotNull()).join(seen(old), equal, "left_anti"))
    return same.unionByName(fresh.select(*same.columns))


def latest_before(snapshots: DataFrame, current, column: str = "snapshot_id") -> DataFrame:
    """The latest snapshot before ``current``, null if there is none."""
    return snapshots.where(F.col(column) < F.lit(current)).agg(F.max(column).alias("latest"))


def newest_first(snapshots: DataFrame, created: str = "created_at", tie: str = "snapshot_id") -> DataFrame:
    return snapshots.orderBy(F.desc(created), F.desc(tie))
