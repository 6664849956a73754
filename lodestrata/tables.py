"""Tables between the rounds of an iteration."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``; a temporary one in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    # A running session does not take the setting any more; its context keeps the folder.
    spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='lodestrata-')}")
    return spark.sparkContext.getCheckpointDir()


def spread(df: DataFrame, key: str) -> DataFrame:
    """Short rows dealt over four tasks a core, for work that makes each of them many times longer.

    A file of a few megabytes is read by as few tasks as it has parts, however much is made of its rows.
    """
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, key)


def stored(df: DataFrame) -> DataFrame:
    """``df`` computed and written to the shared folder, its lineage cut: a lost executor costs only the tasks it ran."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(checkpoint_folder(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read back; :func:`removed` deletes it."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/lodestrata/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(df: DataFrame) -> None:
    """Delete the files of a table that :func:`written` wrote and nothing reads any more."""
    spark = df.sparkSession
    for folder in {name.rpartition("/")[0] for name in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def released(spark: SparkSession) -> None:
    """Have the shuffle files of finished work deleted: they stay until the driver's garbage, Python's and the JVM's, is collected."""
    gc.collect()
    spark._jvm.System.gc()
