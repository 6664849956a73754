"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed left to right into phrases, each the shortest string that is
not yet in the text's own dictionary. Texts that share passages share
phrases, much as one compresses the other; the likeness of two texts is the
overlap of their phrase sets, estimated from minimum hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import discard, pieces, saved, text_of

#: Bins of a fingerprint, each keeping the least hash that falls into it, and bits kept of each.
BINS = 64
HASH_BITS = 16
#: Ranges of ids that neighbours are looked up in; their bounds (8 bytes each) go to every task.
MOST_RANGES = 20_000
RANGE_BYTES = 4 << 20
#: Ranges that a task takes on average; neighbouring ones, so that tasks are about equal.
TASK_RANGES = 4

_MASK = 0xFFFFFFFFFFFFFFFF
_STEP = 0x9E3779B97F4A7C15
_EDGES = np.arange(BINS, dtype=np.uint64) * np.uint64((1 << 64) // BINS)
#: Stands for an empty bin.
_NONE = np.uint64((1 << 64) - 1)
_EMPTY = np.zeros(BINS, np.uint16)


class Parse:
    """A parse under way; can be taken back to an earlier point."""

    def __init__(self) -> None:
        self.phrases: dict[int, int] = {}
        self.hashes, self.node = [0], 0

    def feed(self, text: str) -> None:
        phrases, hashes, node = self.phrases, self.hashes, self.node
        get = phrases.get
        for c in map(ord, text):
            key = node << 21 | c
            node = get(key, -1)
            if node < 0:
                phrases[key] = len(hashes)
                hashes.append((hashes[key >> 21] * _STEP + c + 1) & _MASK)
                node = 0
        self.node = node

    def mark(self) -> tuple[int, int]:
        return len(self.hashes), self.node

    def back(self, mark: tuple[int, int]) -> None:
        size, self.node = mark
        for _ in range(len(self.hashes) - size):
            self.phrases.popitem()
        del self.hashes[size:]

    def least(self, first: int = 1) -> np.ndarray:
        """The least hash in each bin, of the phrases from number ``first`` on."""
        h = np.array(self.hashes[first:], np.uint64)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        h = np.sort(h ^ (h >> np.uint64(32)))
        at = np.searchsorted(h, _EDGES)
        out = np.append(h, _NONE)[at]
        out[np.r_[at[1:], len(h)] == at] = _NONE
        return out


def kept(signature: np.ndarray) -> np.ndarray:
    """What a fingerprint keeps of each bin's least hash: its low bits, never zero; zero for an empty bin."""
    return np.where(signature == _NONE, 0, signature % np.uint64((1 << HASH_BITS) - 1) + np.uint64(1)).astype(np.uint16)


def written(fingerprint: np.ndarray) -> str:
    """A fingerprint as hex digits."""
    return fingerprint.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal bins among those that either fingerprint fills; 1 if neither fills any."""
    filled = (a != 0) | (b != 0)
    return float(((a == b) & filled).sum() / filled.sum()) if filled.any() else 1.0


def fingerprint(text: str | None) -> np.ndarray:
    """Fingerprint of a whole text; null counts as empty."""
    p = Parse()
    p.feed(text or "")
    return kept(p.least())


def with_edit(text: str, following: str) -> tuple[np.ndarray, str, np.ndarray]:
    """The text's fingerprint, its edited text and that one's fingerprint.

    The last third of the code points makes way for as many first ones of the
    following text, or all it has. Both parses share the first two thirds.
    """
    cut = len(text) // 3
    head = text[: len(text) - cut]
    p = Parse()
    p.feed(head)
    mark = p.mark()
    common = p.least()
    p.feed(text[len(head) :])
    own = np.minimum(common, p.least(mark[0]))
    p.back(mark)
    p.feed(following[:cut])
    return kept(own), head + following[:cut], kept(np.minimum(common, p.least(mark[0])))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint`` of every whole text; null texts are empty, repeated rows give repeated rows, other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield pa.record_batch([batch.column("doc_id"), pa.array([written(fingerprint(t)) for t in batch.column("text").to_pylist()], pa.string())], ["doc_id", "fingerprint"])

    id_type = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {id_type}, fingerprint string")


def estimated_likeness(a: Column, b: Column) -> Column:
    """:func:`likeness` of two written fingerprints."""
    digits, empty = HASH_BITS // 4, "0" * (HASH_BITS // 4)
    places = F.sequence(F.lit(1), F.lit(BINS * digits), F.lit(digits))
    bins = F.filter(F.transform(places, lambda i: F.struct(F.substring(a, i, digits).alias("a"), F.substring(b, i, digits).alias("b"))), lambda x: (x["a"] != empty) | (x["b"] != empty))
    return F.when(F.size(bins) == 0, 1.0).otherwise(F.size(F.filter(bins, lambda x: x["a"] == x["b"])) / F.size(bins))


def _cuts(keys: DataFrame, ranges: int, integral: bool) -> list:
    """Ids that part the known ids into about equal ranges, at most ``ranges`` of them."""
    known = keys.where("id is not null")
    if ranges <= 1:
        return []
    if integral:
        return sorted(set(known.agg(F.percentile_approx("id", [i / ranges for i in range(1, ranges)], 100 * ranges)).first()[0] or []))
    least = known.select("id").repartitionByRange(ranges, "id").groupBy(F.spark_partition_id().alias("part")).agg(F.min("id").alias("id"))
    return sorted({r["id"] for r in least.collect()})


def chained(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Every document against its edited text and the next document in descending id order.

    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next``; the last two are :func:`likeness` of the written
    fingerprints, which :func:`estimated_likeness` finds again. Ids are cut
    into ranges at quantiles; the last document of a range is copied to the
    range above, and the largest to the lowest range, so every range streams
    its documents in order and has each one's neighbour at hand. The text is
    shuffled once.

    Whole numbers go by value, ids of any other type by their text. Null
    texts are empty; null ids come last in descending order, by a hash of the
    text, over as many ranges as they need; rows with one id go by that hash
    too. A single document is its own next one. An empty table gives no rows;
    other columns are not read.
    """
    id_type = dict(docs.dtypes)[id_col]
    integral = id_type in ("tinyint", "smallint", "int", "bigint")
    rows = docs.select(F.col(id_col).cast("long" if integral else "string").alias("id"), F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    tie = F.xxhash64("text").alias("tie")
    keys = saved(rows.select("id", tie, F.octet_length("text").alias("n")), "keys")
    sizes = keys.agg(F.sum("n").alias("all"), F.sum(F.when(F.col("id").isNull(), F.col("n"))).alias("unnamed")).first()
    cuts = _cuts(keys, int(min(MOST_RANGES, (sizes["all"] or 0) // range_bytes + 1)), integral)
    first = int(min(MOST_RANGES, (sizes["unnamed"] or 0) // range_bytes + 1))  # ranges of rows without an id; theirs are the lowest

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        bounds = np.array(cuts, np.int64 if integral else object)
        held = ids.isna().to_numpy()
        values = np.where(held, 0, ids.fillna(0).to_numpy()).astype(np.int64) if integral else ids.fillna("").to_numpy()
        return pd.Series(np.where(held, 0, first + np.searchsorted(bounds, values, "left")).astype(np.int32))

    spread = F.least(F.floor((F.col("tie") / float(1 << 64) + 0.5) * first), F.lit(first - 1)).cast("int")
    ranged = lambda df: df.withColumn("range", F.when(F.col("id").isNull(), spread).otherwise(range_of("id")))
    # The largest document of each range goes to the next range that has any, as the neighbour of the smallest there.
    tops = saved(ranged(keys).groupBy("range").agg(F.max(F.struct(F.col("id").isNotNull().alias("known"), "id", "tie")).alias("top")), "tops")
    discard(keys)
    order = sorted(r[0] for r in tops.select("range").collect())  # at most twice MOST_RANGES numbers
    schema = f"doc_id {id_type}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    if not order:
        return docs.sparkSession.createDataFrame([], schema)
    onward = docs.sparkSession.createDataFrame(list(zip(order, order[1:] + order[:1])), "range int, to int")
    carried = F.broadcast(tops.join(F.broadcast(onward), "range").select(F.col("top.id").alias("_id"), F.col("top.tie").alias("_tie"), "to"))
    dealt = ranged(rows.withColumn("tie", tie))
    moves = dealt.join(carried, dealt["id"].eqNullSafe(carried["_id"]) & (dealt["tie"] == carried["_tie"]), "left")
    # Of rows with one id and one text any may be carried; a range uses the first of them.
    both = moves.withColumn("at", F.explode(F.when(F.col("to").isNull(), F.array(F.struct("range", F.lit(True).alias("own")))).otherwise(F.array(F.struct("range", F.lit(True).alias("own")), F.struct(F.col("to").alias("range"), F.lit(False).alias("own"))))))
    streams = both.select("at.range", "at.own", "id", "tie", "doc_id", "text").repartitionByRange(len(order) // TASK_RANGES + 1, "range").sortWithinPartitions("range", "own", F.asc_nulls_first("id"), "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, before, before_sig = None, "", _EMPTY
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        for batch in pieces(batches):
            out = []
            for r, own, i, text in zip(*(batch.column(c).to_pylist() for c in ("range", "own", "doc_id", "text"))):
                if not own:
                    if now != r:
                        now, before, before_sig = r, text, fingerprint(text)
                    continue
                now = r
                sig, edited, edited_sig = with_edit(text, before)
                out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), written(sig), written(edited_sig), likeness(sig, edited_sig), likeness(sig, before_sig)))
                before, before_sig = text, sig
            if out:
                columns = list(zip(*out))
                yield pa.record_batch([pa.array(columns[0], batch.schema.field("doc_id").type), pa.array(columns[1], pa.int64()), *(pa.array(c, pa.string()) for c in columns[2:5]), *(pa.array(c, pa.float64()) for c in columns[5:])], names)

    return streams.mapInArrow(run, schema)
