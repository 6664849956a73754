"""Removal of long strings that occur more than once, by suffix arrays.

Every window of ``LENGTH`` bytes has one anchor: the substring of ``GRAM``
bytes in it whose hash is least. Equal windows have equal anchors at equal
places, so windows need to be compared only under one anchor, and anchors that
occur once need no comparison at all. Windows side by side with one anchor
form a context; equal contexts are counted by hash.

Where contexts of an anchor differ, their windows are dealt into bins by how
far before the anchor they start. The windows of a bin share a core, so bins
meet by the hash of the core, and only the bytes on either side of it are left
to compare: a suffix array over ``left edge, core symbol, right edge`` of all
bins with one core puts equal windows side by side.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, flagged, pieces, saved, text_of
from .suffix_array import suffix_array

#: Bytes of a string that may occur once only.
LENGTH = 200
GRAM = 32
#: Windows of a bin.
BIN = 32
#: Bins with one core that one suffix array takes; beyond it, windows are counted by hash over all tasks.
ARRAY_BINS = 400
#: Contexts that have a window before its rows are dealt over ``SALTS`` tasks.
HOT_WINDOW = 500
SALTS = 32
#: Symbols that go into one suffix array, if one core's bins leave room for more.
ARRAY_SYMBOLS = 1 << 16
#: Bits of the filter of anchors: 32 for each, within these bounds (1 MB to 128 MB).
FILTER_BITS = (1 << 23, 1 << 30)
#: Bytes hashed at once; longer texts go in pieces that overlap by a window.
STRETCH = 1 << 22

_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xD6E8FEB86659FD93)


def _gram_hashes(b: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of all substrings of ``gram`` bytes, a power of two, by doubling."""
    h, power, n = b.astype(np.uint64) + np.uint64(1), int(_P), 1
    while n < gram:
        h = h[:-n] * np.uint64(power) + h[n:]
        power, n = power * power & 0xFFFFFFFFFFFFFFFF, 2 * n
    h ^= h >> np.uint64(32)
    h *= _Q
    h ^= h >> np.uint64(29)
    return h


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, from running minima of blocks."""
    n = len(x)
    pad = -n % width
    blocks = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def contexts(raw: bytes, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(anchor, first window, number of windows, anchor's place)`` of every context of the texts that ``ends`` cuts ``raw`` into."""
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(raw) < length:
        return none
    b = np.frombuffer(raw, np.uint8)
    keys = _gram_hashes(b, gram)
    width = length - gram + 1
    # The hash's leading bits, then the place, so that of equal hashes the leftmost is least.
    packed = (keys & ~np.uint64((1 << 24) - 1)) | np.arange(len(keys), dtype=np.uint64)
    at = (_sliding_least(packed, width) & np.uint64((1 << 24) - 1)).astype(np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    sizes = ends - starts
    place = np.arange(len(at))
    whole = np.repeat(ends, sizes)[: len(at)] - place >= length
    edge = np.ones(len(at), bool)
    edge[1:] = (at[1:] != at[:-1]) | (whole[1:] != whole[:-1])
    first = np.flatnonzero(edge)
    count = np.diff(np.append(first, len(at)))
    keep = whole[first]
    # Windows of two texts have different anchors or a gap of unfinished windows between them.
    return keys[at[first[keep]]], first[keep], count[keep], at[first[keep]]


def _stretches(batch: pa.RecordBatch, length: int) -> Iterator[tuple[bytes, np.ndarray, list[int], list[int]]]:
    """``(bytes, ends, rows, offsets)``: texts laid end to end, very long ones in overlapping pieces."""
    parts, ends, rows, offsets, total = [], [], [], [], 0
    for row, text in enumerate(batch.column("text").to_pylist()):
        raw = (text or "").encode()
        for at in range(0, max(1, len(raw) - length + 1), STRETCH):
            piece = raw[at : at + STRETCH + length - 1]
            if len(piece) < length:
                continue
            if total + len(piece) > STRETCH and parts:
                yield b"".join(parts), np.cumsum(ends), rows, offsets
                parts, ends, rows, offsets, total = [], [], [], [], 0
            parts.append(piece), ends.append(len(piece)), rows.append(row), offsets.append(at)
            total += len(piece)
    if parts:
        yield b"".join(parts), np.cumsum(ends), rows, offsets


def _count_anchors(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            for raw, ends, _, _ in _stretches(batch, length):
                anchors, n = np.unique(contexts(raw, ends, length, gram)[0], return_counts=True)
                yield pa.record_batch([pa.array(anchors.view(np.int64)), pa.array(n)], ["anchor", "n"])

    return run


def _slots(anchors: np.ndarray, bits: int) -> np.ndarray:
    return (anchors * _P >> np.uint64(64 - (bits.bit_length() - 1))).astype(np.int64)


def anchor_filter(anchors: DataFrame) -> tuple[np.ndarray, int]:
    """A bit array that has the bit of every anchor set, and its number of bits.

    Its size follows the number of anchors up to a fixed bound. What passes by
    chance is compared exactly later on, so the bound costs shuffled bytes and
    never a row.
    """
    n = anchors.count()
    bits = 1 << max(FILTER_BITS[0].bit_length() - 1, min(FILTER_BITS[1].bit_length() - 1, (32 * n).bit_length()))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _slots(batch.column("anchor").to_numpy().view(np.uint64), bits)
            yield pa.record_batch([pa.array(at >> 6), pa.array((np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64))], ["word", "bit"])

    rows = anchors.mapInArrow(words, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(bits >> 6, np.int64)
    table[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return table, bits


def _hits(table: np.ndarray, bits: int, anchors: np.ndarray) -> np.ndarray:
    at = _slots(anchors, bits)
    return np.flatnonzero((table[at >> 6] >> (at & 63)) & 1)


def _mark(context: bytes) -> bytes:
    return hashlib.blake2b(context, digest_size=16).digest()


def _occurrences(shared, bits: int, length: int, gram: int):
    """Where each context is: a row for every context of a text, with all its places there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            ids, ties = batch.column("doc_id"), batch.column("tie")
            for raw, ends, rows, offsets in _stretches(batch, length):
                anchor, first, count, _ = contexts(raw, ends, length, gram)
                hit = _hits(shared.value, bits, anchor)
                if not len(hit):
                    continue
                of = np.searchsorted(ends, first[hit], "right")
                shift = np.array(offsets)[of] - np.concatenate([[0], ends[:-1]])[of]
                found: dict[tuple[int, bytes], tuple[int, int, list[int]]] = {}
                for k, a, n, row, move in zip(anchor[hit].view(np.int64).tolist(), first[hit].tolist(), count[hit].tolist(), np.array(rows)[of].tolist(), shift.tolist()):
                    found.setdefault((row, _mark(raw[a : a + n + length - 1])), (k, n, []))[2].append(a + move)
                row = pa.array([r for r, _ in found], pa.int64())
                yield pa.record_batch(
                    [ids.take(row), ties.take(row), pa.array([v[0] for v in found.values()], pa.int64()), pa.array([m for _, m in found], pa.binary()), pa.array([v[1] for v in found.values()], pa.int32()), pa.array([v[2] for v in found.values()], pa.list_(pa.int64()))],
                    ["doc_id", "tie", "anchor", "mark", "windows", "places"],
                )

    return run


def _bins(shared, bits: int, length: int, gram: int, width: int):
    """The bins of contexts, each context once a batch: window ``t`` of a bin is window ``top - t`` of the context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            for raw, ends, _, _ in _stretches(batch, length):
                anchor, first, count, place = contexts(raw, ends, length, gram)
                hit = _hits(shared.value, bits, anchor)
                seen, out = set(), []
                for a, n, p in zip(first[hit].tolist(), count[hit].tolist(), place[hit].tolist()):
                    mark = _mark(raw[a : a + n + length - 1])
                    if mark in seen:
                        continue
                    seen.add(mark)
                    far, near = p - a, p - (a + n - 1)
                    for j in range(near // width, far // width + 1):
                        t0, t1 = max(near - j * width, 0), min(far - j * width, width - 1)
                        core, end = p - j * width, p - j * width - width + 1 + length
                        key = hashlib.blake2b(raw[core:end], digest_size=8, salt=j.to_bytes(2, "big")).digest()
                        out.append((int.from_bytes(key, "big", signed=True), mark, far - j * width, t0, raw[core - t1 : core], raw[end : end + width - 1 - t0]))
                if out:
                    columns = list(zip(*out))
                    yield pa.record_batch([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int32()), pa.array(columns[4], pa.binary()), pa.array(columns[5], pa.binary())], ["core", "mark", "top", "t0", "left", "right"])

    return run


def repeated_windows(bins: list[tuple[int, int, bytes, bytes]], width: int) -> list[list[int]]:
    """Of bins ``(core, t0, left edge, right edge)``, the windows that another bin has too.

    A window of a bin is the last ``t`` bytes of its left edge, the core and
    the first ``width - 1 - t`` bytes of its right edge: ``width`` symbols.
    """
    symbols, begins, cores = [], [], {}
    for core, _, left, right in bins:
        begins.append(len(symbols))
        symbols += [b + 1 for b in left]
        symbols.append(257 + cores.setdefault(core, len(cores)))
        symbols += [b + 1 for b in right]
        symbols.append(0)  # no window reaches the end of its bin
    text = np.array(symbols, np.int32)
    own = np.zeros(len(text), bool)
    for at, (_, t0, left, _) in zip(begins, bins):
        own[at : at + len(left) - t0 + 1] = True
    order = np.array(suffix_array(symbols), np.int64)
    order = order[own[order]]
    view = np.lib.stride_tricks.sliding_window_view(np.append(text, np.zeros(width, np.int32)), width)
    twice = np.zeros(len(text), bool)
    for i in range(0, len(order) - 1, 8192):
        some = order[i : i + 8193]
        rows = view[some]
        same = (rows[1:] == rows[:-1]).all(axis=1)
        twice[some[1:][same]] = True
        twice[some[:-1][same]] = True
    return [[len(left) - int(x) for x in np.flatnonzero(twice[at : at + len(left) - t0 + 1])] for at, (_, t0, left, _) in zip(begins, bins)]


def _runs(starts: list[int]) -> list[tuple[int, int]]:
    """Ranges that sorted numbers make up."""
    x = np.array(sorted(starts))
    cut = np.flatnonzero(np.diff(x) != 1) + 1
    return [(int(r[0]), int(r[-1]) + 1) for r in np.split(x, cut)] if len(x) else []


def _arrays(width: int):
    def solve(held: list) -> pa.RecordBatch:
        found = [(mark, a, b) for (mark, top, *_), ts in zip(held, repeated_windows([h[2:] for h in held], width)) for a, b in _runs([top - t for t in ts])]
        return pa.record_batch([pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.int64())], ["mark", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            for core, mark, top, t0, left, right in zip(*(batch.column(c).to_pylist() for c in ("core", "mark", "top", "t0", "left", "right"))):
                if core != last and size >= ARRAY_SYMBOLS:
                    yield solve(held)
                    held, size = [], 0
                held.append((mark, top, core, t0, left, right))
                size += len(left) + len(right) + 2
                last = core
        if held:
            yield solve(held)

    return run


def _all_windows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            windows, marks, starts = [], [], []
            for core, mark, top, t0, left, right in zip(*(batch.column(c).to_pylist() for c in ("core", "mark", "top", "t0", "left", "right"))):
                for t in range(t0, len(left) + 1):
                    windows.append(hashlib.blake2b(core.to_bytes(8, "big", signed=True) + bytes([t]) + left[len(left) - t :] + right[: width - 1 - t], digest_size=16).digest())
                    marks.append(mark)
                    starts.append(top - t)
            yield pa.record_batch([pa.array(windows, pa.binary()), pa.array(marks, pa.binary()), pa.array(starts, pa.int64())], ["window", "mark", "a"])

    return run


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``doc_id, tie, start, end``: stretches of bytes of a text that repeated windows cover; ``tie`` hashes the text.

    They may overlap. See :func:`remove_repeats` for the cases.
    """
    id_type, width = dict(docs.dtypes)[id_col], min(BIN, length // 2)
    broadcast = docs.sparkSession.sparkContext.broadcast
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).where(F.octet_length("text") >= length)
    counts = rows.select("text").mapInArrow(_count_anchors(length, gram), "anchor long, n long")
    repeated = saved(counts.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor"), "anchors")
    table, bits = anchor_filter(repeated)
    keyed = rows.withColumn("tie", F.xxhash64("text"))
    found = saved(keyed.mapInArrow(_occurrences(broadcast(table), bits, length, gram), f"doc_id {id_type}, tie long, anchor long, mark binary, windows int, places array<long>"), "occurrences")
    sized = saved(found.groupBy("anchor", "mark").agg(F.sum(F.size("places")).alias("n"), F.first("windows").cast("long").alias("windows")), "sized")
    copies = sized.where("n > 1").select("mark", F.lit(0).cast("long").alias("a"), F.col("windows").alias("b"))
    # Windows of contexts that occur once are still open, where their anchor has other contexts.
    open_ = saved(sized.groupBy("anchor").agg(F.count("*").alias("contexts"), F.count_if(F.col("n") == 1).alias("single")).where("contexts > 1 and single > 0").select("anchor"), "open")
    table, bits = anchor_filter(open_)
    bins = rows.select("text").mapInArrow(_bins(broadcast(table), bits, length, gram, width), "core long, mark binary, top int, t0 int, left binary, right binary")
    bins = saved(bins.dropDuplicates(["mark", "core", "top"]), "bins")
    crowds = saved(bins.groupBy("core").agg(F.count("*").alias("bins")).where("bins > 1"), "crowds")
    # Bins of crowded cores do not meet by core, so no task gets all of them; what passes the filter by chance is counted exactly there too.
    full = saved(crowds.where(F.col("bins") > ARRAY_BINS).select("core"), "crowded")
    marked = flagged(bins, F.col("core"), full, "crowded")
    few = marked.where(~F.col("crowded")).join(crowds.where(F.col("bins") <= ARRAY_BINS).select("core"), "core").drop("crowded")
    arrays = few.repartition("core").sortWithinPartitions("core", "mark").mapInArrow(_arrays(width), "mark binary, a long, b long")
    windows = saved(marked.where("crowded").drop("crowded").mapInArrow(_all_windows(width), "window binary, mark binary, a long"), "windows")
    twice = saved(windows.groupBy("window").agg(F.count("*").alias("times")).where("times > 1"), "twice")
    # Windows that very many contexts have meet their row over several tasks; what passes the filter by chance does so too.
    hot = saved(twice.where(F.col("times") > HOT_WINDOW).select(F.xxhash64("window").alias("h")), "hot")
    spread = flagged(windows, F.xxhash64("window"), hot, "hot").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("mark"), F.lit(SALTS)).cast("int")).otherwise(0))
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    salted = flagged(twice, F.xxhash64("window"), hot, "hot").select("window", F.explode(salts).alias("salt"))
    crowded = spread.join(salted, ["window", "salt"]).select("mark", "a", (F.col("a") + 1).alias("b"))
    ranges = saved(copies.unionByName(arrays).unionByName(crowded).groupBy("mark").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("ranges")), "ranges")
    discard(repeated, sized, open_, crowds, full, marked, hot, spread, salted)
    placed = found.select("doc_id", "tie", "places", "mark").join(ranges, "mark")
    each = placed.select("doc_id", "tie", F.explode("places").alias("place"), "ranges").select("doc_id", "tie", "place", F.explode("ranges").alias("r"))
    return each.select("doc_id", "tie", (F.col("place") + F.col("r.a")).alias("start"), (F.col("place") + F.col("r.b") + (length - 1)).alias("end"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching stretches made one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """A row per document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed``.

    Texts are their UTF-8 bytes. Every byte goes that is covered by a string of
    ``length`` bytes which also starts anywhere else, in the same document or
    another; strings are judged on the input. ``removed`` lists the maximal
    removed stretches.

    Null texts are empty; texts shorter than ``length`` stay whole. Repeated
    rows are copies of each other. Equal texts under a null id lose the same
    bytes. An empty table gives no rows.
    """
    id_type = dict(docs.dtypes)[id_col]
    found = repeated_spans(docs, id_col, text_col, length, gram)
    spans = found.groupBy("doc_id", "tie").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    spans = saved(spans.select(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie"), "spans"), "spans")
    discard(found)
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).withColumn("tie", F.xxhash64("text"))
    # Documents that lose nothing stay where they are; the others meet their spans.
    touched = saved(spans.select(F.xxhash64("_id", "_tie").alias("h")), "marked")
    marked = flagged(rows, F.xxhash64("doc_id", "tie"), touched, "hit")
    discard(touched)
    hit = marked.where("hit")
    met = hit.join(spans.hint("merge"), hit["doc_id"].eqNullSafe(spans["_id"]) & (hit["tie"] == spans["_tie"]), "left").select("doc_id", "text", "spans")
    joined = marked.where(~F.col("hit")).select("doc_id", "text", F.lit(None).cast(dict(spans.dtypes)["spans"]).alias("spans")).unionByName(met)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            out = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                raw, gone = text.encode(), merged([(s["start"], s["end"]) for s in spans or []])
                digest, at = hashlib.sha256(), 0
                for a, b in gone:
                    digest.update(raw[at:a])
                    at = b
                digest.update(raw[at:])
                out.append((len(raw), sum(b - a for a, b in gone), len(gone), digest.hexdigest(), [{"start": a, "end": b} for a, b in gone]))
            columns = list(zip(*out))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.record_batch([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string()), pa.array(columns[4], kind)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])

    return joined.mapInArrow(run, f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:long,end:long>>")
