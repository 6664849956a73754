"""Near-duplicate groups by SimHash with deletion-variant signatures.

Two fingerprints that differ in at most ``k`` bits, cut into ``k // 2 + 1``
segments, agree in some segment but for at most one bit. So each segment is
indexed once for every bit of it, with that bit blanked: segments that differ
in one bit share the variant that blanks it, equal segments share them all.
Variants meet by equality and the full distance is then verified. A variant
that too many fingerprints share is not compared pair by pair: the bits that
it leaves open are cut and indexed in the same way, again and again, until few
enough share a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import discard, flagged, pieces, saved, spread, without

BITS = 64
SHINGLE_WORDS = 4
MAX_DISTANCE = 4
SEED = 42
#: Members of a variant that are compared inside one block.
BLOCK = 1024
#: Open bits from which a variant is not refined further; few fingerprints can share it then.
LEAST_OPEN = 9
#: Runs up to this length are compared by shifting whole columns.
SHORT_RUN = 8


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """SimHash of word shingles; 0 for a text without words."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # ASCII white space and A-Z alone
    if not found:
        return 0
    line = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found])
    starts = (ends - [len(w) + 1 for w in found]).tolist()
    ends = (ends - 1).tolist()
    k = min(words, len(found))
    last = ends[k - 1 :]
    counts = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(last), 16384):
        some = np.array([digest(line[s:e], SEED) for s, e in zip(starts[at : at + 16384], last[at : at + 16384])], "<u8")
        counts += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(last)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id, fp``: the fingerprint as a signed 64-bit number; null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            fps = np.array([fingerprint(t, words) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.record_batch([batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    id_type = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {id_type}, fp long")


def segments(distance: int) -> list[tuple[int, int]]:
    """``(first bit, bits)`` of the segments that ``distance`` asks for."""
    n = distance // 2 + 1
    cuts = [round(i * BITS / n) for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def variant_keys(fp: Column, distance: int) -> Column:
    """All one-wildcard variants: the blanked bit's number above the rest of its segment."""
    keys = []
    for first, n in segments(distance):
        value = F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << n) - 1))
        width = max(n for _, n in segments(distance))
        for bit in range(n):
            keys.append(value.bitwiseAND(F.lit(((1 << n) - 1) ^ (1 << bit))) + F.lit((first + bit) << width))
    return F.array(*keys)


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def spanning_links(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that connect what pairs within ``distance`` connect, one a member at most."""
    left, links = fps, []
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            node = front.pop()
            near = _popcount(left ^ node) <= distance
            if near.any():
                links += [(int(node), int(x)) for x in left[near]]
                front += list(left[near])
                left = left[~near]
    return links


def _compare(distance: int):
    def linked(cell: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links inside the runs of equal cells."""
        starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        sizes = np.diff(np.r_[starts, len(cell)])
        small = np.repeat(sizes <= SHORT_RUN, sizes)
        a, b = [], []
        for step in range(1, SHORT_RUN):
            i = np.flatnonzero(small[:-step] & (cell[step:] == cell[:-step])) if len(cell) > step else np.empty(0, int)
            i = i[_popcount(fps[i] ^ fps[i + step]) <= distance] if len(i) else i
            a.append(fps[i]), b.append(fps[i + step] if len(i) else fps[i])
        for at in np.flatnonzero(sizes > SHORT_RUN):
            links = spanning_links(fps[starts[at] : starts[at] + sizes[at]], distance)
            if links:
                more = np.array(links, np.uint64)
                a.append(more[:, 0]), b.append(more[:, 1])
        return np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_c, held_f = np.empty(0, np.int64), np.empty(0, np.uint64)
        for batch in batches:
            c = np.concatenate([held_c, batch.column(0).to_numpy(zero_copy_only=False)])
            f = np.concatenate([held_f, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            if not len(c):
                continue
            cut = int(np.searchsorted(c, c[-1], "left"))  # the last run may go on in the next batch
            held_c, held_f = c[cut:], f[cut:]
            if cut:
                a, b = linked(c[:cut], f[:cut])
                yield pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])
        if len(held_c):
            a, b = linked(held_c, held_f)
            yield pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def _first_variants(fps: DataFrame, distance: int) -> DataFrame:
    """``fp, key`` for every one-wildcard variant of a whole fingerprint."""
    return fps.select("fp", F.explode(variant_keys(F.col("fp"), distance)).alias("key"))


def _opened(members: DataFrame, distance: int) -> DataFrame:
    """Members of first variants with the bits that these leave open, packed, as ``rest`` and ``width``."""
    cuts = segments(distance)
    blanked = F.shiftrightunsigned("key", max(n for _, n in cuts))
    rest, width = F.lit(None).cast("long"), F.lit(None).cast("int")
    for first, n in cuts:
        here = (blanked >= first) & (blanked < first + n)
        low, high = F.col("fp").bitwiseAND(F.lit((1 << first) - 1)), F.shiftleft(F.shiftrightunsigned("fp", first + n), first) if first + n < BITS else F.lit(0).cast("long")
        rest, width = F.when(here, low.bitwiseOR(high)).otherwise(rest), F.when(here, BITS - n).otherwise(width)
    return members.withColumn("rest", rest).withColumn("width", width)


def _refined(members: DataFrame, distance: int) -> DataFrame:
    """Members of a key under all one-wildcard variants of their open bits, with what these leave open."""
    k = distance // 2 + 1
    at = members.withColumn("bit", F.explode(F.expr("sequence(0, width - 1)"))).withColumn("part", F.expr(f"CAST(bit * {k} DIV width AS INT)"))
    at = at.withColumn("first", F.expr(f"CAST((part * width + {k - 1}) DIV {k} AS INT)")).withColumn("after", F.expr(f"CAST(((part + 1) * width + {k - 1}) DIV {k} AS INT)"))
    value = F.expr("shiftrightunsigned(rest, first) & (shiftleft(1L, after - first) - 1) & ~shiftleft(1L, bit - first)")
    left = F.expr("(rest & (shiftleft(1L, first) - 1)) | shiftleft(shiftrightunsigned(rest, after), first)")
    return at.select(F.xxhash64("key", "bit", value).alias("key"), "fp", left.alias("rest"), F.expr("width - after + first").alias("width"), "label", "tester")


def _cells(members: DataFrame, shared: DataFrame, block: int) -> DataFrame:
    """``cell, fp``: keys of up to ``block`` members whole, larger ones in cells of about so many, each with the key's least member."""
    sized = spread(members).join(shared.where("n > 2").select("key", "a", F.ceil(F.col("n") / block).alias("cells")), "key")
    own = sized.select(F.xxhash64("key", F.pmod(F.xxhash64("fp"), "cells")).alias("cell"), "fp")
    leading = shared.where(F.col("n") > block).select("key", "a", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / block) - 1)).alias("of"))
    return own.unionByName(leading.select(F.xxhash64("key", "of").alias("cell"), F.col("a").alias("fp")))


def _linked(cells: DataFrame, distance: int) -> DataFrame:
    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(_compare(distance), "a long, b long")


def near_links(fps: DataFrame, distance: int = MAX_DISTANCE, block: int = BLOCK) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints ``fp`` within ``distance`` bits.

    They connect exactly what all such pairs connect, without listing all
    pairs: a variant with two members is read off its minimum and maximum, and
    one with up to ``block`` members is compared in one cell and gives one
    link a member at most.

    A more crowded variant is compared in cells of about ``block`` members
    that share its least member, which connects dense groups. Where its
    members are still in several parts then, they go on to the variants of
    the bits that are open, and of those only to such as hold a member
    outside the largest part and another part. Rows grow with the members,
    not with their pairs. When few bits are open, the members outside the
    largest part meet all others in pairs of cells.
    """
    level = _first_variants(fps, distance)
    shared = saved(level.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"), "variants")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    links = saved(shared.where((F.col("n") == 2) & near).select("a", "b").unionByName(_linked(_cells(level, shared, block), distance)), "links")
    crowded = shared.where(F.col("n") > block).select("key")
    if crowded.isEmpty():
        discard(shared)
        return links
    members = saved(_opened(spread(level).join(crowded, "key"), distance), "members")
    discard(shared)
    while True:
        roots = saved(connected_components(links), "parts")
        named = members.join(spread(roots), members["fp"] == roots["node"], "left").select("key", "fp", "rest", "width", F.coalesce("root", "fp").alias("label"))
        counted = named.groupBy("key", "label").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("all"), (F.sum("n") - F.max("n")).alias("others"))
        open_ = saved(spread(named).join(counted.where("others > 0"), "key").withColumn("tester", F.col("label") != F.col("main")), "open")
        discard(members, roots)
        if open_.isEmpty():
            discard(open_)
            return links
        last = open_.where(F.col("width") <= LEAST_OPEN)
        deeper = _refined(open_.where(F.col("width") > LEAST_OPEN), distance)
        kept = deeper.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"), F.max("tester").alias("tested"), F.min("label").alias("low"), F.max("label").alias("high"))
        kept = saved(kept.where("n > 1 and tested and low <> high").select("key", "n", "a", "b"), "variants")
        found = kept.where((F.col("n") == 2) & near).select("a", "b").unionByName(_linked(_cells(deeper.select("key", "fp"), kept, block), distance)).unionByName(_linked(_pairs_of_cells(last, block), distance))
        before, links = links, saved(links.unionByName(found).distinct(), "links")
        discard(before)
        crowded = kept.where(F.col("n") > block).select("key")
        if crowded.isEmpty():
            discard(open_, kept)
            return links
        members = saved(spread(deeper).join(crowded, "key").select("key", "fp", "rest", "width"), "members")
        discard(open_, kept)


def _pairs_of_cells(members: DataFrame, block: int) -> DataFrame:
    """``cell, fp``: members outside a key's largest part meet all its members, cell by cell."""
    sized = members.withColumn("i_cells", F.ceil(F.col("all") / block)).withColumn("j_cells", F.ceil(F.col("others") / block))
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    met = sized.withColumn("i", F.pmod(F.xxhash64("fp"), "i_cells")).withColumn("j", upto("j_cells"))
    testing = sized.where("tester").withColumn("i", upto("i_cells")).withColumn("j", F.pmod(F.xxhash64("fp", F.lit(1)), "j_cells"))
    return met.unionByName(testing).select(F.xxhash64("key", "i", "j").alias("cell"), "fp").distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, distance: int = MAX_DISTANCE) -> DataFrame:
    """A row per document: ``doc_id, fingerprint, component_id``.

    ``component_id`` is the smallest id that links of at most ``distance``
    bits reach, the document's own included. Documents with equal
    fingerprints are one node, so a group of copies of any size is one row in
    the search. Texts without words have fingerprint zero and are linked like
    any other; null ids belong to a group but never name it (all ids null:
    null); repeated rows give repeated rows; an empty table gives none.
    """
    rows = saved(fingerprints(docs, id_col, text_col, words), "fingerprints")
    nodes = saved(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")
    links = near_links(nodes.select("fp"), distance)
    roots = connected_components(links)
    named = nodes.join(spread(roots), nodes["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    labels = saved(spread(named).join(least, "root").select("fp", "component_id"), "labels")
    discard(nodes, links, roots)
    return spread(rows).join(labels, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: A pair of documents is a near copy from this share of common shingles of so many words.
SIMILARITY = 0.8
SIMILAR_WORDS = 5
#: Candidates: documents that agree in all minimum hashes of one of so many bands. At a similarity of 0.8
#: a pair is missed by a chance of (1 - 0.8 ** 5) ** 16, two in a thousand, whatever kind of edit parts it.
BANDS = 16
BAND_ROWS = 5
#: Members of a bucket that are compared inside one cell.
CELL = 256
#: Bytes of their shingles that one cell holds, about.
CELL_BYTES = 16 << 20
_MIN_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, (BANDS * BAND_ROWS, 2), np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, words: int = SIMILAR_WORDS) -> np.ndarray:
    """Distinct hashes of a text's shingles, in order; fewer words are one shingle, none too."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(found[i : i + words]), SEED) for i in range(max(1, len(found) - words + 1))], np.uint64))


def set_digest(hashes: np.ndarray) -> bytes:
    """Names a set of shingles."""
    return xxhash.xxh3_128_digest(hashes.tobytes())


def bands(hashes: np.ndarray) -> list[int]:
    """A key for each band of minimum hashes of a set of shingles."""
    least = np.full(len(_MIN_FACTORS), np.iinfo(np.uint64).max)
    salt, factor = _MIN_FACTORS[:, :1], _MIN_FACTORS[:, 1:]
    for at in range(0, len(hashes), 1024):
        x = (hashes[None, at : at + 1024] ^ salt) * factor
        x ^= x >> np.uint64(32)
        least = np.minimum(least, (x * factor).min(axis=1))
    return [xxhash.xxh64_intdigest(least[r * BAND_ROWS : (r + 1) * BAND_ROWS].tobytes(), r) - (1 << 63) for r in range(BANDS)]


def cell_links(sets: list[np.ndarray], labels: list, tester: list[bool], similarity: float) -> list[tuple[int, int]]:
    """Links that connect what pairs of a tester and any other set within ``similarity`` connect beyond equal labels."""
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    starts = np.cumsum(sizes) - sizes
    _, group = np.unique(np.array(labels, object), return_inverse=True)
    mark, links = np.zeros(int(ids.max()) + 1, bool), []
    for x in np.flatnonzero(tester).tolist():
        other = group != group[x]
        if not other.any():
            continue
        own = ids[starts[x] : starts[x] + sizes[x]]
        mark[own] = True
        common = np.add.reduceat(mark[ids], starts, dtype=np.int64)
        mark[own] = False
        near = np.flatnonzero(other & (common >= similarity * (sizes[x] + sizes - common)))
        for g, first in zip(*np.unique(group[near], return_index=True)):
            links.append((x, int(near[first])))
            group[group == g] = group[x]
    return links


def _verify(similarity: float):
    def links(rows: list[tuple]) -> list[tuple]:
        if len(rows) < 2:
            return []
        nodes, labels, tester, sets = zip(*[r[1:] for r in rows])
        found = cell_links([np.frombuffer(x, np.uint64) for x in sets], labels, tester, similarity)
        return [(nodes[i], nodes[j]) for i, j in found if nodes[i] != nodes[j]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            found = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][0] != row[0]:
                    found += links(held)
                    held = []
                held.append(row)
            yield pa.record_batch([pa.array([a for a, _ in found], pa.binary()), pa.array([b for _, b in found], pa.binary())], ["a", "b"])
        found = links(held)
        yield pa.record_batch([pa.array([a for a, _ in found], pa.binary()), pa.array([b for _, b in found], pa.binary())], ["a", "b"])

    return run


def _prefix_keys(open_nodes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``key, node, size, label``: for each node of ``open_nodes(node, size, label)`` the shingles by which it meets all sets that overlap enough.

    With every set in one order of shingles, rarest first, two sets of which
    one has ``s`` shingles overlap by ``similarity`` only if they share one of
    its first ``s - ceil(similarity * s) + 1``. What a crowd has in common is
    frequent in it and comes last, so sets that share no more than a template
    do not meet. Shingles of one set alone come first and lead nowhere.
    """

    def one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # a set at a time, so a batch is no longer than its longest set
                hashes = np.frombuffer(batch.column("hashes")[k].as_py(), np.int64)
                yield pa.record_batch([pa.array([batch.column("node")[k].as_py()] * len(hashes), pa.binary()), pa.array(hashes)], ["node", "token"])

    once = open_nodes.select("node").join(sets.hint("merge"), "node").groupBy("node").agg(F.any_value("hashes").alias("hashes"))
    tokens = once.mapInArrow(one_by_one, "node binary, token long")
    counts = tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    met = spread(tokens).join(counts, "token").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("t"))
    sized = spread(met).join(open_nodes, "node")
    first = F.col("size") - F.ceil(F.col("size") * similarity - 1e-9) + 1
    alone = F.col("size") - F.size("t")
    return sized.select("node", "size", "label", F.explode(F.slice("t", F.lit(1), F.greatest(F.lit(0).cast("long"), first - alone).cast("int"))).alias("p")).select(F.col("p.token").alias("key"), "node", "size", "label")


def _buckets(keys: DataFrame) -> DataFrame:
    """``key, least, cells`` of the keys with several nodes, from ``key, node, size``; keys with the same nodes count once."""
    buckets = keys.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"), F.min("node").alias("least"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    cells = F.greatest(F.ceil(F.col("n") / CELL), F.ceil(F.col("shingles") * 8 / CELL_BYTES))
    return buckets.where("n > 1").groupBy("n", "least", "x", "y").agg(F.min("key").alias("key"), F.max(cells).alias("cells")).select("key", "least", "cells")


def _mixed(keys: DataFrame) -> DataFrame:
    """``key, main, cells, tests`` of the keys whose nodes are in several parts, from ``key, node, size, label``; keys with the same nodes count once.

    ``main`` is the key's largest part; the nodes outside it need as many
    cells as ``tests``, all its nodes as many as ``cells``.
    """
    parts = keys.groupBy("key", "label").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"), F.min("node").alias("least"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    whole = parts.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("n"), (F.sum("n") - F.max("n")).alias("others"), F.sum("shingles").alias("shingles"), F.min("least").alias("least"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y")).where("others > 0")
    held = F.greatest(F.col("n") / CELL, F.col("shingles") * 8 / CELL_BYTES)
    return whole.groupBy("n", "least", "x", "y").agg(F.min_by(F.struct("key", "main", F.ceil(held).alias("cells"), F.ceil(held * F.col("others") / F.col("n")).alias("tests")), "key").alias("b")).select("b.*")


def similar_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SIMILAR_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """Links ``(a, b)`` between documents whose shingle sets overlap by ``similarity`` or more.

    Buckets are the sets that agree in a band of minimum hashes. The links
    connect what all pairs of a bucket that overlap enough connect: equal
    sets are one node, and a bucket is compared in cells of at most about
    ``CELL`` members and ``CELL_BYTES`` of shingles, each with the bucket's
    least member, which connects dense groups. Members of a bucket of several
    cells that are not connected then meet by their rarest shingles, see
    :func:`_prefix_keys`: of the sets that share one, those outside the
    largest part meet all others, cell by cell. So many documents that agree
    in a template and in nothing else give rows in proportion to their
    number; only where more than a cell's sets share a rare shingle and are
    still unconnected do cells meet in pairs. No pair of a bucket is left out.

    Null ids are left out; null texts are empty ones, and all texts without
    words are one set; fewer words than a shingle has are one shingle. Rows
    that repeat an id with another text count under that id. Very long texts
    are hashed alone and weigh as many members of a cell as they have
    shingles for. An empty table gives no links; other columns are not read.
    """
    base = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = dict(docs.dtypes)[id_col]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sets = [shingles(t, words) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(map(set_digest, sets), pa.binary()), pa.array(map(len, sets), pa.int64()), pa.array(map(bands, sets), pa.list_(pa.int64()))], ["doc_id", "node", "size", "bands"])

    def read_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sets = [shingles(t, words) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([pa.array(map(set_digest, sets), pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())], ["node", "hashes"])

    rows = saved(base.mapInArrow(sign, f"doc_id {id_type}, node binary, size long, bands array<long>"), "signatures")
    nodes = saved(rows.groupBy("node").agg(F.min("doc_id").alias("first"), F.any_value("size").alias("size"), F.any_value("bands").alias("bands")), "shingle_sets")
    equal = spread(rows).join(nodes.select("node", "first"), "node").where("doc_id <> first").select(F.col("first").alias("a"), F.col("doc_id").alias("b"))

    keys = nodes.select("node", "size", F.explode("bands").alias("key"))
    buckets = saved(_buckets(keys), "buckets")
    members = saved(spread(keys).join(buckets.select("key", "cells"), "key"), "members")
    # One document of each set is read again; what passes the filter by chance brings sets that meet no bucket.
    wanted = saved(spread(members.select("node").distinct()).join(nodes.select("node", "first"), "node").select(F.xxhash64("first").alias("h")), "wanted")
    sets = saved(flagged(base, F.xxhash64("doc_id"), wanted, "wanted").where("wanted").select("doc_id", "text").mapInArrow(read_sets, "node binary, hashes binary"), "hashes")
    done = [rows, nodes, wanted, sets]
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))

    def verified(cells: DataFrame) -> DataFrame:
        held = cells.join(sets.hint("merge"), "node").select("cell", "node", "label", "tester", "hashes")
        return saved(held.repartition("cell").sortWithinPartitions("cell").mapInArrow(_verify(similarity), "a binary, b binary"), "similar")

    def within_cells(buckets: DataFrame, members: DataFrame) -> DataFrame:
        own = members.select(F.xxhash64("key", F.pmod(F.xxhash64("node"), "cells")).alias("cell"), "node")
        leading = buckets.where("cells > 1").select("key", "least", upto("cells").alias("of"))
        cells = own.unionByName(leading.select(F.xxhash64("key", "of").alias("cell"), F.col("least").alias("node")))
        return verified(cells.select("cell", "node", F.col("node").alias("label"), F.lit(True).alias("tester")))

    links = within_cells(buckets, members)
    done += [buckets, members, links]
    crowded = members.where("cells > 1")
    if not crowded.isEmpty():
        roots = saved(connected_components(links), "similar_roots").withColumnRenamed("root", "label")
        labelled = saved(crowded.join(spread(roots), "node", "left").select("key", "node", "size", F.coalesce("label", "node").alias("label")), "parts")
        # members of buckets that are connected by now need no more
        split = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
        loose = saved(labelled.join(spread(split), "key", "left_semi").groupBy("node").agg(F.any_value("size").alias("size"), F.any_value("label").alias("label")), "loose")
        rare = saved(_prefix_keys(loose, sets, similarity), "rare")
        mixed = saved(_mixed(rare), "mixed")
        met = spread(rare).join(mixed, "key").withColumn("tester", F.col("label") != F.col("main"))
        every = met.withColumn("i", F.pmod(F.xxhash64("node"), "cells")).withColumn("j", upto("tests")).withColumn("tester", F.lit(False))
        testing = met.where("tester").withColumn("i", upto("cells")).withColumn("j", F.pmod(F.xxhash64("node", F.lit(1)), "tests"))
        pairs = every.unionByName(testing).groupBy(F.xxhash64("key", "i", "j").alias("cell"), "node", "label").agg(F.max("tester").alias("tester"))
        more = verified(pairs)
        links = links.unionByName(more)
        done += [roots, labelled, loose, rare, mixed, more]
    named = lambda c, first: nodes.select(F.col("node").alias(c), F.col("first").alias(first))
    ends = spread(links.distinct()).join(named("a", "p"), "a").join(spread(named("b", "q")), "b").where("p <> q")
    found = saved(equal.unionByName(ends.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))).distinct(), "similar_links")
    discard(*done)
    return found


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, distance: int = MAX_DISTANCE) -> DataFrame:
    """``docs`` with one document of each group of near copies: the one with the smallest id.

    Documents are in one group if their fingerprints link them as in
    :func:`near_groups`, or their shingles as in :func:`similar_links`.
    Documents with a null id stay, and of repeated rows all do if their id
    does; documents without words are copies of each other. Rows keep all
    their columns, whatever their names, and an empty table stays empty.
    """
    groups = near_groups(docs, id_col, text_col, words, distance)
    links = groups.where("doc_id <> component_id").select(F.col("component_id").alias("a"), F.col("doc_id").alias("b"))
    similar = similar_links(docs, id_col, text_col)
    roots = connected_components(links.unionByName(similar))
    gone = saved(roots.where("node <> root").select(F.col("node").alias("id")).distinct(), "near_losers")
    discard(groups, similar, roots)
    return without(docs, gone, {"id": F.col(id_col)})
