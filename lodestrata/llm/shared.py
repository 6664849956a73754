"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text handled at once inside a Python worker; longer texts are taken alone.
CHUNK_CHARS = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder serves, but only in local mode:
    on a cluster a machine-local folder would lose data.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    # A running session does not take the setting any more; its context keeps the folder.
    spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='lodestrata-')}")
    return spark.sparkContext.getCheckpointDir()


def saved(df: DataFrame, name: str, *by: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder, in a folder for each value of ``by``, and read back.

    This cuts the lineage: a lost executor costs only the task it ran, never
    the stages before the table.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestrata/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` for a join that sorts and merges, so that neither side is sent to every task.

    Spark takes a table after an explode to be no larger than before it, and a
    Parquet table as large as its compressed files, so it would send tables of
    many times the broadcast limit through the driver.
    """
    return df.hint("merge")


#: Bits of a presence filter: 16 for each key, within these bounds (at most a million words of 64).
PRESENCE_BITS = (1 << 10, 1 << 26)


def flagged(rows: DataFrame, mark: Column, keys: DataFrame, name: str) -> DataFrame:
    """``rows`` with a boolean column ``name``: whether ``keys``, a saved table of one long column, has ``mark``.

    False means that no key is equal; true that one is, or, by chance, that
    none is (about 1 in 70). The filter's bits, two for each key, lie in a
    table of at most a million words that goes to every task: beyond that
    bound more rows pass by chance, and never does a key fail. So whoever
    uses it looks exactly at what passes and leaves the rest where it is, at
    every size of the table.
    """
    key = F.col(keys.columns[0])
    bits = 1 << max(PRESENCE_BITS[0].bit_length() - 1, min(PRESENCE_BITS[1].bit_length() - 1, (16 * keys.count()).bit_length()))
    places = lambda h: (h.bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(bits - 1)))
    spots = keys.select(F.explode(F.array(*places(key))).alias("at"))
    words = saved(spots.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("bits")), "presence")
    held = F.lit(True)
    for i, place in enumerate(places(mark)):
        at, word, found = f"__{name}_at{i}", f"__{name}_word{i}", f"__{name}_bits{i}"
        rows = rows.withColumn(at, place).join(F.broadcast(words.select(F.col("word").alias(word), F.col("bits").alias(found))), F.shiftright(F.col(at), 6) == F.col(word), "left")
        held = held & F.coalesce(F.expr(f"shiftright({found}, CAST({at} & 63 AS INT)) & 1") == 1, F.lit(False))
    return rows.withColumn(name, held).drop(*[f"__{name}_{x}{i}" for i in (0, 1) for x in ("at", "word", "bits")])


def without(docs: DataFrame, gone: DataFrame, by: dict[str, Column]) -> DataFrame:
    """Rows of ``docs`` that no row of ``gone`` equals in all of ``by``, null equal to null.

    ``by`` names the columns of ``gone``, a saved table, and gives the
    expression over ``docs`` for each. Rows that the presence filter of
    ``gone`` has not seen stay where they are; only the others, those that go
    and a few more, are shuffled to be compared exactly.
    """
    rows = flagged(docs, F.xxhash64(*by.values()), gone.select(F.xxhash64(*by).alias("h")), "__doubt")
    listed = gone.select(*[F.col(n).alias(f"__gone_{n}") for n in by]).hint("merge")
    doubtful = rows.where("__doubt").drop("__doubt")
    same = F.lit(True)
    for n, c in by.items():
        same = same & c.eqNullSafe(F.col(f"__gone_{n}"))
    return rows.where(~F.col("__doubt")).drop("__doubt").unionByName(doubtful.join(listed, same, "left_anti"))


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that :func:`saved` wrote and nothing needs any more."""
    spark = tables[0].sparkSession
    for folder in {"/lodestrata/".join([top, rest.partition("/")[0]]) for df in tables for name in df.inputFiles() for top, _, rest in [name.partition("/lodestrata/")]}:
        if not folder.endswith("/lodestrata/"):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_of(col: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def fold(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def id_key(doc_id: str = "doc_id") -> Column:
    """A stable 64-bit hash of the id as text."""
    return F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")))


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``CHUNK_CHARS`` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.binary_length(batch.column(column)).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if i > start and total + (n or 0) > CHUNK_CHARS:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n or 0
        yield batch.slice(start)
