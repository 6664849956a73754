"""Exact deduplication by progressive refinement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import discard, flagged, saved, text_of, without

#: Characters that the second level hashes.
PREFIX_CHARS = 64


def digest(text: Column) -> Column:
    """Lowercase hex SHA-256 of the UTF-8 text."""
    return F.sha2(text.cast("binary"), 256)


def copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """Groups of two or more equal texts: ``digest, keep_id, group_size``.

    Level one counts lengths, level two counts (length, hash of the first
    characters) within lengths that repeat, level three hashes the full text
    of what is left: rows whose (length, prefix) may be among those that
    repeat, by a filter of bounded size; what passes by chance has a digest
    of its own and is no group. Every level counts with map-side
    aggregation, so a group that holds a third of all rows is a handful of
    partial rows a task. The text is never shuffled.

    Null texts are empty texts. ``keep_id`` is the largest id of the group
    (null if all are null); ``group_size`` counts rows, repeated rows too. An
    empty table gives no groups; further columns are not read.
    """
    keyed = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("t")).select("id", "t", F.octet_length("t").alias("len"), F.xxhash64(F.substring("t", 1, prefix_chars)).alias("prefix"))
    # As many rows as there are lengths, so Spark may broadcast them; else both sides move and skewed lengths are split.
    lengths = saved(keyed.groupBy("len").agg(F.count("*").alias("n")).where("n > 1").select("len"), "lengths")
    alive = saved(keyed.select("len", "prefix").join(lengths, "len", "left_semi").groupBy("len", "prefix").agg(F.count("*").alias("n")).where("n > 1").select(F.xxhash64("len", "prefix").alias("h")), "prefixes")
    full = flagged(keyed, F.xxhash64("len", "prefix"), alive, "alive").where("alive").select("id", digest(F.col("t")).alias("digest"))
    groups = saved(full.groupBy("digest").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1"), "groups")
    discard(lengths, alive)
    return groups


def membership(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: id, ``keep_id, group_size, kept, digest``.

    Null texts are empty ones; a group whose ids are all null keeps one of
    its rows. Of rows that repeat both id and text, one is kept. An empty
    table gives no rows; columns besides the two are not read.
    """
    groups = copy_groups(docs, id_col, text_col)
    rows = docs.select(F.col(id_col), digest(text_of(text_col)).alias("digest")).groupBy(id_col, "digest").agg(F.count("*").alias("repeats"))
    return (
        rows.join(groups, "digest", "left")
        .select(id_col, "digest", F.coalesce("keep_id", id_col).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), F.explode(F.sequence(F.lit(1).cast("long"), "repeats")).alias("repeat"))
        .select(id_col, "keep_id", "group_size", (F.col(id_col).eqNullSafe(F.col("keep_id")) & (F.col("repeat") == 1)).alias("kept"), "digest")
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts: the one with the largest id.

    Rows go out as they came in, with all their columns. Only ids and hashes
    are grouped; rows that stay are not moved, those that go are. Null texts
    are empty ones; of rows that repeat both id and text one stays.
    """
    ids = docs.select(F.col(id_col).alias("id"), digest(text_of(text_col)).alias("digest"), F.xxhash64(text_of(text_col)).alias("tie"))
    groups = copy_groups(docs, id_col, text_col)
    rows = ids.join(groups, "digest").groupBy("id", "digest", "tie", "keep_id").agg(F.count("*").alias("n"))
    kept = F.col("id").eqNullSafe(F.col("keep_id"))
    gone = saved(rows.where(~kept).select("id", "tie").distinct(), "losers")
    again = saved(rows.where(kept & (F.col("n") > 1)).select(F.xxhash64("id", "tie").alias("h")), "repeats")
    keys = {"id": F.col(id_col), "tie": F.xxhash64(text_of(text_col))}
    left = without(docs, gone, keys)
    if again.isEmpty():
        return left
    # Rows that repeat both id and text: one of them stays. A row that passes the filter by chance has no equal and stays too.
    marked = flagged(left, F.xxhash64(*keys.values()), again, "__again").withColumn("__tie", keys["tie"])
    few = marked.where("__again").dropDuplicates([id_col, "__tie"])
    return marked.where(~F.col("__again")).unionByName(few).drop("__again", "__tie")
