"""Inventories, sizes, histograms, scores and top lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text


def library_totals(entries: DataFrame, library: str = "library", is_source: str = "is_source") -> DataFrame:
    """Entries, source entries and compiled ones of each library."""
    return entries.groupBy(library).agg(F.count("*").alias("entries"), F.count_if(is_source).alias("source")).withColumn("compiled", F.col("entries") - F.col("source"))


def type_counts(entries: DataFrame, library: str, kind: str) -> DataFrame:
    """Objects of each kind in each library, and over all libraries where the library is null."""
    return entries.rollup(kind, library).agg(F.count("*").alias("n"), F.grouping(library).alias("all_libraries"), F.grouping(kind).alias("_g")).where("_g = 0").drop("_g")


def type_pivot(entries: DataFrame, library: str, kind: str, kinds: list[str]) -> DataFrame:
    """A row per library, a column per kind, and the row's total. Naming the kinds saves a pass over the data."""
    out = entries.groupBy(library).agg(*[F.count_if(F.col(kind) == k).alias(k) for k in kinds], F.count("*").alias("total"))
    return out


def project_summary(files: DataFrame, ext: str = "ext", objects: str = "objects", unicode: str = "is_unicode") -> DataFrame:
    """Numbers of libraries, compiled libraries, executables and objects, in Unicode and not."""
    return files.agg(F.count_if(F.col(ext) == "pbl").alias("libraries"), F.count_if(F.col(ext) == "pbd").alias("compiled_libraries"), F.count_if(F.col(ext) == "exe").alias("executables"), F.sum(objects).alias("objects"), F.count_if(unicode).alias("unicode_libraries"), F.count_if(~F.col(unicode)).alias("ansi_libraries"))


def size_stats(files: DataFrame, size: str, name: str) -> DataFrame:
    """Total, whole average, largest and smallest; the first by name wins ties. Files without a size count in the average."""
    known = F.col(size).isNotNull()
    return files.agg(F.sum(size).alias("total"), F.expr(f"sum({size}) div count(*)").alias("average"), F.min_by(name, F.when(known, F.struct(-F.col(size), F.col(name)))).alias("largest"), F.min_by(name, F.when(known, F.struct(size, name))).alias("smallest"))


def bucketed(df: DataFrame, label: Column, labels: list[str]) -> DataFrame:
    """Rows in each bucket, empty buckets too, in the order of ``labels``."""
    counts = df.groupBy(label.alias("bucket")).agg(F.count("*").alias("n"))
    every = df.sparkSession.createDataFrame(list(enumerate(labels)), "place int, bucket string")
    return every.join(counts, "bucket", "left").select("place", "bucket", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


SIZE_BUCKETS = ["<50", "<200", "<500", "<1000", "1000+"]


def size_bucket(lines: Column) -> Column:
    return F.when(lines < 50, "<50").when(lines < 200, "<200").when(lines < 500, "<500").when(lines < 1000, "<1000").otherwise("1000+")


RATINGS = ["A", "B", "C", "D", "F"]


def usage(df: DataFrame, item: str, user: str, most: int | None = None) -> DataFrame:
    """How many users an item has and which, most used first; a list is as long as an item has distinct users.

    Pairs are made distinct before they are counted, and with ``most`` only
    the users of the items that stay are listed. :func:`usage_counts` lists none.
    """
    pairs = df.select(item, user).where(F.col(user).isNotNull()).distinct()
    if most:
        chosen = usage_counts(df, item, user).orderBy(F.desc("n"), item).limit(most)
        listed = pairs.join(F.broadcast(chosen.select(item)), item).groupBy(item).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(user)).alias("users"))
        return listed.orderBy(F.desc("n"), item)
    return pairs.groupBy(item).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(user)).alias("users"))


def usage_counts(df: DataFrame, item: str, user: str) -> DataFrame:
    """How many distinct users an item has."""
    return df.select(item, user).where(F.col(user).isNotNull()).distinct().groupBy(item).agg(F.count("*").alias("n"))


def top(df: DataFrame, by: str, tie: str, n: int = 10, descending: bool = True) -> DataFrame:
    """The first rows by a column, ties by another."""
    return df.orderBy(F.desc(by) if descending else F.asc(by), F.asc(tie)).limit(n)


def dashboard(files: DataFrame, routines: DataFrame, variables: DataFrame, findings: DataFrame) -> DataFrame:
    """Files, lines, bytes, routines, variables and findings in one row; each side is aggregated before they meet."""
    a = files.agg(F.count("*").alias("files"), F.sum("lines").alias("lines"), F.sum("bytes").alias("bytes"))
    one = F.lit(1).alias("k")
    for name, side in (("routines", routines), ("variables", variables), ("findings", findings)):
        a = a.select("*", one).join(side.agg(F.count("*").alias(name)).select("*", one), "k").drop("k")
    return a


def complex_routines(routines: DataFrame, keys: list[str], beyond: int = 10, most: int = 30) -> DataFrame:
    """Routines with a complexity above ``beyond``, the most complex first: ``keys, name, cc, rating, code_lines``."""
    cc = text.complexity(F.col("script"))
    rows = routines.select(*keys, "name", cc.alias("cc"), text.rating(cc).alias("rating"), text.code_lines(F.col("script")).alias("code_lines"))
    return rows.where(F.col("cc") > beyond).orderBy(F.desc("cc"), *keys, "name").limit(most)


def above(df: DataFrame, keys: list[str], least: int, *more: Column) -> DataFrame:
    """Groups of more than ``least`` rows, with ``n`` and further aggregates."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *more).where(F.col("n") > least)


def concatenated(results: list[DataFrame]) -> DataFrame:
    """The rows of several results of one shape."""
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out


def workflow(entry_rows: DataFrame, findings: DataFrame, fixes: DataFrame) -> DataFrame:
    """What export, analysis, fixing and packing of a project come to, a row each: ``step, name, n``."""
    packed = entry_rows.where("is_source").agg(F.count("*").alias("e"), F.count_distinct("path").alias("p"))
    row = lambda i, name, n: F.struct(F.lit(i).alias("step"), F.lit(name).alias("name"), n.alias("n"))
    both = packed.select(F.explode(F.array(row(1, "export", F.col("e")), row(4, "pack", F.col("p")))).alias("r")).select("r.*")
    counts = [(2, "analyse", findings), (3, "fix", fixes.where("severity = 'safe'"))]
    return concatenated([both] + [df.agg(F.count("*").alias("n")).select(F.lit(i).alias("step"), F.lit(name).alias("name"), "n") for i, name, df in counts])


def hotspots(per_object: DataFrame, library: str = "library") -> DataFrame:
    """Objects, findings and lines of each library."""
    return per_object.groupBy(library).agg(F.count("*").alias("objects"), F.sum("findings").alias("findings"), F.sum("lines").alias("lines"))


def review_score(libraries: Column, lines: Column, files_with_findings: Column, reports: Column) -> Column:
    """100 less deductions, at least 0."""
    d = F.when(libraries == 0, 5).otherwise(0) + F.when(lines > 100_000, 10).when(lines > 50_000, 5).otherwise(0) + F.least(files_with_findings * 3, F.lit(20)) + F.when(reports > 50, 5).otherwise(0)
    return F.greatest(F.lit(100) - d, F.lit(0))


def score_label(score: Column) -> Column:
    return F.when(score >= 90, "excellent").when(score >= 70, "good").when(score >= 50, "fair").otherwise("poor")


def effort(windows: Column, reports: Column, functions: Column) -> tuple[Column, Column]:
    """Lowest and highest days of a migration, truncated."""
    return (windows * 0.5 + reports * 0.3 + functions * 0.2).cast("long"), (windows * 2.0 + reports * 1.0 + functions * 0.5).cast("long")


def effort_days(lines: Column, reports: Column) -> Column:
    return F.floor(lines / 1000) + reports * 2


def difficulty(days: Column) -> Column:
    return F.when(days < 30, "low").when(days < 90, "medium").otherwise("high")


def outcomes(df: DataFrame, error: str = "error", keys: list[str] = ()) -> DataFrame:  # type: ignore[assignment]
    """Succeeded, failed and all attempts, of each key if any is named."""
    return df.groupBy(*keys).agg(F.count_if(F.col(error).isNull()).alias("succeeded"), F.count_if(F.col(error).isNotNull()).alias("failed"), F.count("*").alias("attempts"))


def init_summary(entries: DataFrame, library: str, kind: str, size: str) -> DataFrame:
    """Objects and megabytes of each library and kind, the kind's name cut to ten characters."""
    return entries.groupBy(library, F.left(kind, F.lit(10)).alias("kind")).agg(F.count("*").alias("objects"), F.round(F.sum(size) / 1048576, 2).alias("mb"))


def cache_stats(entries: DataFrame, hits: str = "hits", keys: list[str] = ()) -> DataFrame:  # type: ignore[assignment]
    """Entries, hits and hits an entry, at most 1, of each key if any is named."""
    return entries.groupBy(*keys).agg(F.count("*").alias("entries"), F.sum(hits).alias("hits")).withColumn("rate", F.least(F.coalesce(F.try_divide("hits", "entries"), F.lit(0.0)), F.lit(1.0)))
