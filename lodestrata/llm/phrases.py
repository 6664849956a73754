"""Phrase collocations by pivot partitioning, as MG-FSM mines sequences.

Words are ordered by frequency. A phrase belongs to its rarest word, the
pivot, and to the first of them if that word repeats. Around each word the
text is rewritten to the two words on either side that are not rarer, a
fragment, and fragments are routed to their pivot. There each fragment yields
the phrases that hold the pivot, so each occurrence of a phrase is counted at
one place only. Words too rare for any phrase end a fragment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import discard, pieces, saved

MIN_COUNT = 10
TOP = 2000
#: A phrase goes if a longer one that holds it has this share of its occurrences, in hundredths.
SHARE = 50
#: Bits of a word's number. The most frequent words, up to so many, have numbers; the others go as text.
ID_BITS = 20
HEAD_WORDS = (1 << ID_BITS) - 1
#: Longer words have no number, which bounds what is broadcast.
HEAD_BYTES = 64
#: Bits of the filter of words beyond the numbered ones that may be in a phrase.
TAIL_BITS = 1 << 26
#: A pivot with more than one in so many of all occurrences is dealt over several tasks.
SHARES = 512
#: Bytes of a text that are split at once, and bytes of texts whose fragments are counted together.
BLOCK = 1 << 20
GATHER = 1 << 23
#: Words that a task remembers.
REMEMBERED = 400_000
#: Occurrences whose phrases one task counts.
TASK_WORDS = 1 << 20
_TABLE = bytes.maketrans(bytes(range(65, 91)) + b"\t.,;:!?\n\x0b\x0c\r", bytes(range(97, 123)) + b" " + b"\n" * 10)
#: The end of a piece; no UTF-8 text holds this byte.
_END = b"\xff"


def words_of(text: bytes) -> list[bytes]:
    """Words of a text, and a mark at the end of each piece."""
    return text.translate(_TABLE).replace(b"\n", b" \xff ").split(b" ")


def blocks(text: bytes) -> Iterator[bytes]:
    """The text in parts of about ``BLOCK`` bytes that end at white space or a mark between words."""
    start = 0
    while len(text) - start > BLOCK:
        at = max(text.rfind(c, start, start + BLOCK) for c in (b" ", b"\n", b".", b","))
        if at <= start:  # a very long word
            ends = [i for c in (b" ", b"\n", b".", b",") if (i := text.find(c, start + BLOCK)) >= 0]
            at = min(ends, default=len(text) - 1)
        yield text[start : at + 1]
        start = at + 1
    yield text[start:]


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list[bytes]]]:
    """Texts by language, as many as make up ``GATHER`` bytes, or one."""
    held, size = {}, 0
    for batch in pieces(batches):
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            if held and size + len(raw) > GATHER:
                yield held
                held, size = {}, 0
            held.setdefault(lang, []).append(raw)
            size += len(raw)
    if held:
        yield held


def word_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``lang, word, f``: occurrences of every word in the texts of each language; a null language is ``und``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _gathered(batches):
            for lang, texts in held.items():
                counts: dict[bytes, int] = {}
                for text in texts:
                    for block in blocks(text):
                        for w in words_of(block):
                            counts[w] = counts.get(w, 0) + 1
                counts.pop(b"", None)
                counts.pop(_END, None)
                yield pa.record_batch([pa.array([lang] * len(counts), pa.string()), pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(counts.values(), pa.int64())], ["lang", "word", "f"])

    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def _mark(lang: str, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


class Numbers:
    """The numbered words, the most frequent first, and a filter of the others that are frequent enough."""

    def __init__(self, head: pa.Table, tail: np.ndarray | None, shares: int, total: int):
        langs, words = head.column("lang").to_pylist(), [w.encode() for w in head.column("word").to_pylist()]
        self.lang = pa.array(langs, pa.string())
        self.word = pa.array(words, pa.binary())
        self.f = np.array([0, *head.column("f").to_pylist()], np.int64)
        marks = np.concatenate([_mark(lang, [w]) for lang, w in zip(langs, words)]) if words else np.zeros(0, np.uint64)
        order = np.argsort(marks)
        self.marks, self.at = marks[order], (order + 1).astype(np.int32)
        self.tail = tail
        self.known: dict[str, dict[bytes, int]] = {}  # what a worker has found, for its later tasks too
        self.salts = np.maximum(1, -(-self.f * shares // max(1, total)))

    def find(self, lang: str, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Number of each word, 0 for none, and whether it is one of the others that may be frequent enough."""
        mark = _mark(lang, words)
        ids = np.zeros(len(words), np.int32)
        if len(self.marks):
            lo, hi = np.searchsorted(self.marks, mark), np.searchsorted(self.marks, mark, "right")
            for i in np.flatnonzero(hi > lo).tolist():
                for k in self.at[lo[i] : hi[i]].tolist():  # more than one only where two hashes are equal
                    if self.word[k - 1].as_py() == words[i] and self.lang[k - 1].as_py() == lang:
                        ids[i] = k
        if self.tail is None:
            return ids, np.zeros(len(words), bool)
        at = (mark & np.uint64(TAIL_BITS - 1)).astype(np.int64)
        seen = (self.tail[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
        return ids, (ids == 0) & (seen == 1) & np.fromiter((w != _END for w in words), bool, len(words))


def _tail_filter(tail: DataFrame) -> np.ndarray:
    """Bits of the words in ``tail``: at most a million numbers come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [int(_mark(lang, [w.encode()])[0]) & (TAIL_BITS - 1) for lang, w in zip(batch.column("lang").to_pylist(), batch.column("word").to_pylist())]
            yield pa.record_batch([pa.array([x >> 6 for x in at], pa.int32()), pa.array([(1 << (x & 63)) - (1 << 64 if x & 63 == 63 else 0) for x in at], pa.int64())], ["cell", "bits"])

    cells = tail.select("lang", "word").mapInArrow(run, "cell int, bits long").groupBy("cell").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(TAIL_BITS >> 6, np.uint64)
    out[cells.column("cell").to_numpy()] = cells.column("bits").to_numpy().view(np.uint64)
    return out


def _sequences(held: dict[str, list[bytes]], numbers: Numbers) -> Iterator[tuple[str, np.ndarray, list[bytes]]]:
    """Per language: every word's number in order, 0 at the ends of texts and pieces and for words too rare, -1 - k for word k of the list that follows."""
    for lang, texts in held.items():
        ids = numbers.known.get(lang)
        if ids is None or len(ids) > REMEMBERED:
            if sum(map(len, numbers.known.values())) > REMEMBERED:
                numbers.known.clear()
            ids = numbers.known[lang] = {_END: 0}
        others: dict[bytes, int] = {}
        parts: list[np.ndarray] = []
        for text in texts:
            for block in blocks(text):
                found = [w for w in words_of(block) if w]
                new = [w for w in dict.fromkeys(found) if w not in ids]
                if new:
                    at, tail = numbers.find(lang, new)
                    ids.update(zip(new, np.where(tail, -1, at).tolist()))
                got = np.fromiter(map(ids.__getitem__, found), np.int64, len(found))
                for i in np.flatnonzero(got < 0).tolist():
                    got[i] = -1 - others.setdefault(found[i], len(others))
                parts.append(got)
            parts.append(np.zeros(1, np.int64))
        yield lang, np.concatenate(parts), list(others)


def _around(order: np.ndarray) -> list[np.ndarray]:
    """For each place the places of its fragment, two before and two behind, -1 where it ends: words of a higher order, 0, or as high an order before it end it."""
    n = len(order)
    padded = np.concatenate([[0, 0], order, [0, 0]])
    at = np.arange(n)
    side = lambda d: padded[2 + d : 2 + d + n]
    b1 = (side(-1) > 0) & (side(-1) < order)
    b2 = b1 & (side(-2) > 0) & (side(-2) < order)
    a1 = (side(1) > 0) & (side(1) <= order)
    a2 = a1 & (side(2) > 0) & (side(2) <= order)
    return [np.where(ok, at + d, -1) for ok, d in ((b2, -2), (b1, -1), (a1, 1), (a2, 2))]


def _fragments(rows: DataFrame, numbers: Broadcast) -> DataFrame:
    """``pivot, salt, salts, before, behind, n``: fragments of numbered words, equal ones of a batch counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = numbers.value
        for texts in _gathered(batches):
            keys = []
            for _, order, _ in _sequences(texts, held):
                order = np.maximum(order, 0)
                word = np.append(order, 0)  # place -1 reads 0
                b2, b1, a1, a2 = (word[p] for p in _around(order))
                on = (order > 0) & ((b1 > 0) | (a1 > 0))
                keys.append((order[on] << (2 * ID_BITS) | b2[on] << ID_BITS | b1[on], a1[on] << ID_BITS | a2[on]))
            left, right = (np.concatenate([k[i] for k in keys]) for i in (0, 1))
            counted = pa.table({"l": left, "r": right}).group_by(["l", "r"], use_threads=False).aggregate([([], "count_all")]).combine_chunks()
            left, right = counted["l"].to_numpy(), counted["r"].to_numpy()
            pivot = left >> (2 * ID_BITS)
            salts = held.salts[pivot]
            mixed = (left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ right.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
            salt = (mixed >> np.uint64(32)).astype(np.int64) % salts
            mask = (1 << (2 * ID_BITS)) - 1
            columns = [pa.array(pivot.astype(np.int32)), pa.array(salt.astype(np.int32)), pa.array(salts.astype(np.int32)), pa.array(left & mask), pa.array(right), counted["count_all"].combine_chunks().cast(pa.int64())]
            yield pa.record_batch(columns, ["pivot", "salt", "salts", "before", "behind", "n"])

    return rows.mapInArrow(run, "pivot int, salt int, salts int, before long, behind long, n long")


def _mined(fragments: DataFrame, min_count: int, tasks: int) -> DataFrame:
    """``gram, a``: phrases of numbered words, their numbers side by side; the third is 0 in a phrase of two."""
    part = lambda c, i: F.shiftright(c, i * ID_BITS).bitwiseAND(F.lit(HEAD_WORDS).cast("long"))
    p = F.col("pivot").cast("long")
    b2, b1, a1, a2 = part("before", 1), part("before", 0), part("behind", 1), part("behind", 0)
    gram = lambda x, y, z=F.lit(0).cast("long"): F.shiftleft(x, 2 * ID_BITS).bitwiseOR(F.shiftleft(y, ID_BITS)).bitwiseOR(z)
    own = [F.when(b1 > 0, gram(b1, p)), F.when(a1 > 0, gram(p, a1)), F.when(b2 > 0, gram(b2, b1, p)), F.when((b1 > 0) & (a1 > 0), gram(b1, p, a1)), F.when(a2 > 0, gram(p, a1, a2))]
    routed = fragments.repartition(tasks, "pivot", "salt")
    local = routed.select("pivot", "salt", "salts", "n", F.explode(F.array(*own)).alias("gram")).where("gram is not null").groupBy("pivot", "salt", "salts", "gram").agg(F.sum("n").alias("a"))
    # What one task has counted alone is either frequent enough or gone; only phrases of dealt pivots meet again.
    return local.where((F.col("salts") > 1) | (F.col("a") >= min_count)).groupBy("gram").agg(F.sum("a").alias("a")).where(F.col("a") >= min_count)


def _named(grams: DataFrame, numbers: Broadcast) -> DataFrame:
    """``lang, x, y, z, fx, fy, fz, a``: the words of numbered phrases with their occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = numbers.value
        for batch in batches:
            gram = batch.column("gram").to_numpy()
            ids = [(gram >> (k * ID_BITS)) & HEAD_WORDS for k in (2, 1, 0)]
            at = [pa.array(i - 1, mask=i == 0) for i in ids]
            words = [held.word.take(i).cast(pa.string()) for i in at]
            yield pa.record_batch([held.lang.take(at[0]), *words, *[pa.array(held.f[i]) for i in ids], batch.column("a")], ["lang", "x", "y", "z", "fx", "fy", "fz", "a"])

    return grams.mapInArrow(run, "lang string, x string, y string, z string, fx long, fy long, fz long, a long")


def _tail_phrases(rows: DataFrame, words: DataFrame, numbers: Broadcast, min_count: int, tasks: int) -> DataFrame:
    """The same for phrases that hold a word without a number, as :func:`_named` gives them.

    Such a word is rarer than all numbered ones, so the pivot is one of them;
    among themselves they are ordered by hash. Fragments and phrases go as
    text, and occurrences of the words are joined at the end.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = numbers.value
        for texts in _gathered(batches):
            for lang, ids, others in _sequences(texts, held):
                marks = _mark(lang, others)
                rank = np.empty(len(others), np.int64)
                rank[np.lexsort((np.arange(len(others)), marks))] = np.arange(len(others))
                order = ids.copy()
                low = ids < 0
                # ranks within a batch follow the hash, so all tasks choose one pivot; equal hashes would only change the task
                order[low] = (1 << ID_BITS) + rank[-1 - ids[low]]
                around = [np.where(p >= 0, p, len(ids)) for p in _around(order)]
                on = low & ((around[1] < len(ids)) | (around[2] < len(ids)))
                vocab = pa.concat_arrays([held.word, pa.array(others, pa.binary())])
                place = np.append(np.where(low, len(held.word) - 1 - ids, ids - 1), -1)
                columns = []
                for p in (around[0], around[1], np.arange(len(ids)), around[2], around[3]):
                    got = place[p[on]]
                    columns.append(vocab.take(pa.array(got, mask=got < 0)).cast(pa.string()))
                yield pa.record_batch([pa.array([lang] * int(on.sum()), pa.string()), *columns], ["lang", "b2", "b1", "p", "a1", "a2"])

    routed = rows.mapInArrow(run, "lang string, b2 string, b1 string, p string, a1 string, a2 string").groupBy("lang", "b2", "b1", "p", "a1", "a2").agg(F.count("*").alias("n"))
    phrase = lambda x, y, z=None: F.struct(F.col(x).alias("x"), F.col(y).alias("y"), (F.col(z) if z else F.lit(None).cast("string")).alias("z"))
    has = lambda c: F.col(c).isNotNull()
    own = [F.when(has("b1"), phrase("b1", "p")), F.when(has("a1"), phrase("p", "a1")), F.when(has("b2"), phrase("b2", "b1", "p")), F.when(has("b1") & has("a1"), phrase("b1", "p", "a1")), F.when(has("a2"), phrase("p", "a1", "a2"))]
    grams = routed.repartition(tasks, "lang", "p", F.pmod(F.xxhash64("b2", "b1", "a1", "a2"), F.lit(16))).select("lang", "n", F.explode(F.array(*own)).alias("g")).where("g is not null").groupBy("lang", "g.x", "g.y", "g.z").agg(F.sum("n").alias("a")).where(F.col("a") >= min_count)
    for c in "xyz":
        grams = grams.join(words.select("lang", F.col("word").alias(c), F.col("f").alias(f"f{c}")), ["lang", c], "left")
    return grams.select("lang", "x", "y", "z", "fx", "fy", F.coalesce("fz", F.lit(0).cast("long")).alias("fz"), "a")


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (l r)), exact in 38 digits."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (wide(a) * wide(a)).cast("decimal(31,0)"), (wide(left) * wide(right)).cast("decimal(38,0)"))


def mine_phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", min_count: int = MIN_COUNT, share: int = SHARE, top: int | None = TOP, head_words: int = HEAD_WORDS) -> DataFrame:
    """Phrases of two or three words that belong together: ``lang, rank, phrase, a, l, r, n, score``.

    A-Z count as a-z; pieces end at ``.,;:!?`` and line breaks, words at
    spaces and tabs. In each language ``n`` words occur, and phrases with
    ``a`` of at least ``min_count`` occurrences inside pieces are candidates.
    Cut in two, of which ``l`` and ``r`` occur, a candidate scores
    ``floor(1000000 a a / (l r))``; the cut that scores least counts, the
    first of equal ones. Candidates inside a longer one with ``share``
    hundredths of their occurrences go. ``top`` keeps the first of each
    language by score, occurrences and phrase; None keeps all.

    Null texts are empty, a null language is ``und``; repeated rows count each
    time; an empty table gives no rows; other columns are not read, whatever
    their names. Very long texts are split in blocks. Up to ``head_words``
    words have numbers, which bounds what is broadcast; the others are counted
    by the same method as text.
    """
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    counts = saved(word_counts(docs, lang_col, text_col), "words")
    totals = saved(counts.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
    total = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    frequent = counts.where(F.col("f") >= min_count)
    short = frequent.where(F.octet_length("word") <= HEAD_BYTES)
    head = short.orderBy(F.desc("f"), "lang", "word").limit(head_words).toArrow()
    done = [counts, totals]
    tail = None
    if frequent.count() > head.num_rows:
        tail = _tail_filter(frequent)
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // TASK_WORDS + 1)
    numbers = docs.sparkSession.sparkContext.broadcast(Numbers(head, tail, SHARES, total))
    found = _named(_mined(_fragments(rows, numbers), min_count, tasks), numbers)
    if tail is not None:
        found = found.unionByName(_tail_phrases(rows, counts, numbers, min_count, tasks))
    found = saved(found, "phrases")
    done.append(found)

    pairs = found.where("z is null").select("lang", "x", "y", "fx", "fy", "a")
    known = pairs.select("lang", "x", "y", "a")
    triples = found.where("z is not null")
    first = known.select("lang", "x", "y", F.col("a").alias("axy"))
    last = known.select("lang", F.col("x").alias("y"), F.col("y").alias("z"), F.col("a").alias("ayz"))
    triples = triples.join(first, ["lang", "x", "y"]).join(last, ["lang", "y", "z"])
    within = triples.select("lang", "a", F.explode(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("z").alias("y")))).alias("g")).groupBy("lang", "g.x", "g.y").agg(F.max("a").alias("longer"))
    pairs = pairs.join(within, ["lang", "x", "y"], "left").where(F.coalesce(100 * F.col("longer").cast("decimal(20,0)") < share * F.col("a").cast("decimal(20,0)"), F.lit(True)))
    cut = lambda c, left, right: F.struct(_score(F.col("a"), F.col(left), F.col(right)).alias("score"), F.lit(c).alias("k"), F.col(left).alias("l"), F.col(right).alias("r"))
    two = pairs.select("lang", F.concat_ws(" ", "x", "y").alias("phrase"), "a", cut(1, "fx", "fy").alias("cut"))
    three = triples.select("lang", F.concat_ws(" ", "x", "y", "z").alias("phrase"), "a", F.least(cut(1, "fx", "ayz"), cut(2, "axy", "fz")).alias("cut"))
    scored = two.unionByName(three).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    by = lambda *c: Window.partitionBy("lang", *c).orderBy(F.desc("score"), F.desc("a"), "phrase")
    if top is not None:  # the first of every share of a language, so that its last ranking is of few rows
        scored = scored.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("rank", F.row_number().over(by("share"))).where(F.col("rank") <= top).drop("share", "rank")
    ranked = scored.withColumn("rank", F.row_number().over(by()).cast("long"))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    out = saved(ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")
    discard(*done)
    return out
