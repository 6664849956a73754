"""Source folders as streams: new files are searched and linted as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rules, search
from ..sources.files import decoded, file_name


def watch(spark: SparkSession, root: str, pattern: str = "*.sr?") -> DataFrame:
    """``path, name, modified, text`` of files as they arrive below ``root``."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    return files.select("path", file_name(F.col("path")).alias("name"), F.col("modificationTime").alias("modified"), decoded(F.col("content")).alias("text"))


def hits(stream: DataFrame, query: str) -> DataFrame:
    """Search hits of a stream of sources; stateless, so nothing has to be kept between batches."""
    return search.search_text(stream, query)


def findings_per_hour(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Findings of the line rules for each hour of change; an hour is closed once the watermark passes it."""
    found = rules.lint_lines(stream.withWatermark("modified", late), ["path", "modified"])
    return found.groupBy(F.window("modified", "1 hour").alias("hour"), "rule").agg(F.count("*").alias("n"))
