"""An index of files that is kept from scan to scan: what was added, changed or removed, as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CHANGE_SCHEMA = "path string, status string, scanned timestamp, size long, checksum string"
_STATE = "paths array<string>, modified array<long>, sizes array<long>, checksums array<string>, scanned array<long>"
#: Groups that files are dealt into; one holds the state of its files.
BUCKETS = 1024
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _seen(grace_ms: int):
    """The files of a bucket: what each was when it was last seen; the timeout is that of the file that runs out first."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        kept = {path: tuple(rest) for path, *rest in zip(*state.get)} if state.exists else {}
        columns = ("scanned_ms", "path", "modified_ms", "size", "checksum")
        found = [] if state.hasTimedOut else sorted(row for frame in frames for row in zip(*(frame[c].tolist() for c in columns)))
        out, seen = [], set()
        for scanned, path, modified, size, checksum in found:
            seen.add(path)
            last = kept.get(path)
            if last is not None and scanned < last[3]:
                continue  # an older scan has nothing new to say
            if last is None:
                out.append((path, "added", scanned, size, checksum))
            elif (modified, size, checksum) != last[:3]:
                out.append((path, "changed", scanned, size, checksum))
            kept[path] = (modified, size, checksum, scanned)
        for path in [p for p, last in kept.items() if last[3] + grace_ms < now and p not in seen]:
            _, size, checksum, scanned = kept.pop(path)
            out.append((path, "removed", scanned, size, checksum))
        if kept:
            state.update((list(kept), *map(list, zip(*kept.values()))))
            state.setTimeoutTimestamp(max(min(last[3] for last in kept.values()) + grace_ms, now + 1))
        elif state.exists:
            state.remove()
        if out:
            yield _changes(out)

    return run


def _changes(rows: list[tuple]) -> pd.DataFrame:
    path, status, scanned, size, checksum = map(list, zip(*rows))
    return pd.DataFrame({"path": path, "status": status, "scanned": pd.to_datetime(pd.Series(scanned, dtype="int64"), unit="ms"), "size": pd.Series(size, dtype="int64"), "checksum": checksum})


def prepare(spark: SparkSession) -> None:
    """State as the index keeps it lies in RocksDB, on the executors' disks; a batch adds its changes alone to the stream's checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def file_changes(scans: DataFrame, grace_ms: int, buckets: int = BUCKETS) -> DataFrame:
    """``path, status, scanned, size, checksum``: ``added``, ``changed`` and ``removed`` files of a stream of scans.

    ``scans`` has a row ``path, scanned, modified, size, checksum`` for every
    file that a scan saw. A file is changed if its time, size or checksum is
    another, and removed when it was not seen for ``grace_ms`` of scanning
    time: choose it longer than a scan takes and shorter than two scans are
    apart. ``scanned`` of a removal is when the file was last seen. The state
    holds the files that are there; what is gone is forgotten.

    Files are dealt into ``buckets`` by a hash of their path, so that a call
    handles many of them; a scan sees all files, so each bucket changes
    anyway. Take more buckets for more than some ten million files, and keep
    their number while a stream's checkpoint is in use.

    Rows of one file and scan may repeat; rows without a path are left out,
    nulls are compared as 0 and an empty checksum. Rows that come later than
    newer scans say nothing.
    """
    ms = lambda c: F.coalesce(F.unix_millis(c), F.lit(0).cast("long"))
    late = scans.where("path is not null and scanned is not null").withWatermark("scanned", "0 seconds")
    rows = late.select(F.pmod(F.xxhash64("path"), F.lit(buckets)).alias("bucket"), "path", "scanned", ms(F.col("scanned")).alias("scanned_ms"), ms(F.col("modified")).alias("modified_ms"), F.coalesce("size", F.lit(0).cast("long")).alias("size"), F.coalesce("checksum", F.lit("")).alias("checksum"))
    return rows.groupBy("bucket").applyInPandasWithState(_seen(grace_ms), CHANGE_SCHEMA, _STATE, "Append", GroupStateTimeout.EventTimeTimeout)
