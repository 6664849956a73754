"""The tree of conversation prefixes, from first owned depths.

A node is a distinct sequence of leading turns; its owner is the least
conversation that starts with it. A conversation that owns a prefix owns all
longer ones of its own, so one number tells what it owns: the first owned
depth, found by binary search. Each conversation's owned nodes are a chain,
chains hang on each other's nodes, and what a subtree sums up is aggregated
from chain to chain.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import discard, saved

#: A rebuilt conversation starts with less than so many turns of the first conversation of its hundred.
HEADS = 6
HUNDRED = 100
#: Turns of one conversation that a window sums; longer conversations are dealt over several.
RUN = 4096
#: Ids that are joined before they are hashed.
ID_CHUNK = 1 << 16


def running(rows: DataFrame, key: str, at: str, sums: dict[str, Column], run: int = RUN, backwards: bool = False) -> DataFrame:
    """``rows`` with, for each name of ``sums``, its sum over the key's rows up to this ``at`` (from it on, if ``backwards``).

    Rows are summed within runs of ``run`` numbers and the runs' totals among
    each other, so a key with any number of rows is dealt over many tasks.
    """
    rows = rows.select("*", F.floor(F.col(at) / run).alias("__run"), *[c.alias(f"__{n}") for n, c in sums.items()])
    order = F.desc if backwards else F.asc
    near = Window.partitionBy(key, "__run").orderBy(order(at)).rowsBetween(Window.unboundedPreceding, 0)
    far = Window.partitionBy(key).orderBy(order("__run")).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(key, "__run").agg(*[F.sum(f"__{n}").alias(f"__{n}") for n in sums])
    # runs that begin at nothing need no total; only keys of several runs have others
    totals = totals.select(F.col(key).alias("__key"), F.col("__run").alias("__of"), *[F.sum(f"__{n}").over(far).alias(f"__{n}_far") for n in sums]).where(" or ".join(f"`__{n}_far` is not null" for n in sums))
    summed = rows.select("*", *[F.sum(f"__{n}").over(near).alias(f"__{n}_near") for n in sums])
    joined = summed.join(totals, (F.col(key) == F.col("__key")) & (F.col("__run") == F.col("__of")), "left")
    out = [(F.col(f"__{n}_near") + F.coalesce(F.col(f"__{n}_far"), F.lit(0))).alias(n) for n in sums]
    return joined.select(*[c for c in rows.columns if not c.startswith("__")], *out)


def numbered(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv, i, role, text``: turns numbered from 1 in their order, nulls first; turns of one number go by role and text.

    Ranges of turns are numbered apart and each conversation's ranges added
    up, so a conversation of any length is dealt over many tasks.
    """
    t = turns.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("conv is not null")
    # the ends of equal turns do not matter; the text takes part by its hash in the ranges, by itself in the order
    ranged = t.repartitionByRange("conv", F.asc_nulls_first("turn"), "role", F.left("text", F.lit(64))).select("*", F.spark_partition_id().alias("part"))
    ranged = saved(ranged, "ranges")
    within = ranged.select("*", F.row_number().over(Window.partitionBy("conv", "part").orderBy(F.asc_nulls_first("turn"), "role", "text")).alias("k"))
    sizes = ranged.groupBy("conv", "part").agg(F.count("*").alias("n"))
    before = sizes.select(F.col("conv").alias("c"), F.col("part").alias("p"), F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("before")).where("before is not null")
    out = saved(within.join(before, (F.col("conv") == F.col("c")) & (F.col("part") == F.col("p")), "left").select("conv", (F.col("k") + F.coalesce("before", F.lit(0))).alias("i"), "role", "text"), "turns")
    discard(ranged)
    return out


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations of the query, from ``conv, i, role, text``: ``(conv, n)`` and ``(conv, depth, role, text)``.

    Conversation c starts with the first h turns of conversation c - c % 100,
    h being the CRC-32 of its decimal id modulo 6, and goes on with its own
    turns after the first h.
    """
    head = lambda c: F.crc32(c.cast("string").cast("binary")) % HEADS
    convs = turns.groupBy("conv").agg(F.max("i").alias("own")).select("conv", "own", head(F.col("conv")).alias("h"), (F.col("conv") - F.col("conv") % HUNDRED).alias("base"))
    sizes = convs.select(F.col("conv").alias("base"), F.col("own").alias("base_n"))
    convs = saved(convs.join(sizes, "base", "left").select("conv", "base", "h", "own", F.least("h", F.coalesce("base_n", F.lit(0).cast("long"))).alias("lead")), "conversations")
    shared = turns.where(f"i < {HEADS} and conv % {HUNDRED} = 0").select(F.col("conv").alias("base"), "i", "role", "text")
    lead = convs.where("lead > 0").select("conv", "base", "lead").join(shared, "base").where("i <= lead").select("conv", F.col("i").alias("depth"), "role", "text")
    own = turns.join(convs.select("conv", "h", "lead"), "conv").where("i > h").select("conv", (F.col("i") - F.col("h") + F.col("lead")).alias("depth"), "role", "text")
    n = F.col("lead") + F.greatest(F.col("own") - F.col("h"), F.lit(0).cast("long"))
    return convs.select("conv", n.alias("n")), lead.unionByName(own)


def prefix_digests(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """``conv, depth, n, chars, digest``: a row for every prefix of every conversation, the empty one too.

    A prefix's digest is the sum of 128-bit hashes of its turns, each taken
    with its depth; sums are kept in four parts of 32 bits, which cannot
    overflow. ``chars`` are the code points of the prefix's last text.
    """
    turn = F.sha2(F.concat(F.col("depth").cast("string"), F.lit(":"), F.char_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256)
    parts = {f"d{k}": F.conv(F.substring("h", 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)}
    hashed = turns.select("conv", "depth", F.char_length("text").cast("long").alias("chars"), turn.alias("h"))
    zero = F.lit(0).cast("long")
    summed = running(hashed, "conv", "depth", parts).select("conv", "depth", "chars", *parts)
    rows = convs.select("conv", zero.alias("depth"), zero.alias("chars"), *[zero.alias(d) for d in parts]).unionByName(summed)
    return rows.join(convs, "conv").select("conv", "depth", "n", "chars", F.concat(*[F.lpad(F.hex(d), 16, "0") for d in parts]).alias("digest"))


def probe_level(depth: Column, n: Column, levels: int) -> Column:
    """In which round binary search over the depths 0..n+1 would look at ``depth``, counted from 0."""
    start = F.struct(F.lit(0).cast("long").alias("lo"), (n + 1).alias("hi"), F.lit(-1).alias("level"))

    def step(acc: Column, k: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"]) / 2)
        here = (acc["level"] < 0) & (acc["lo"] < acc["hi"])
        return F.struct(
            F.when(here & (depth > mid), mid + 1).otherwise(acc["lo"]).cast("long").alias("lo"),
            F.when(here & (depth < mid), mid).otherwise(acc["hi"]).cast("long").alias("hi"),
            F.when(here & (depth == mid), k).otherwise(acc["level"]).alias("level"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(levels - 1)), start, step)["level"]


def first_owned(convs: DataFrame, prefixes: DataFrame, shared: DataFrame) -> DataFrame:
    """``conv, n, first``: the least depth whose prefix the conversation owns, n + 1 if none.

    ``shared`` has, for each digest of several conversations, its least one;
    a prefix of one conversation alone is its own. A round looks at the
    middle depth of every conversation at once. Which depths a round can look
    at follows from a conversation's length alone, so each prefix is read in
    one round only.
    """
    longest = convs.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    levels = (longest + 1).bit_length()
    probes = saved(prefixes.select("conv", "depth", "digest", probe_level(F.col("depth"), F.col("n"), levels).alias("level")).where("level >= 0"), "probes", "level")
    state = convs.select("conv", "n", F.lit(0).cast("long").alias("lo"), (F.col("n") + 1).alias("hi"))
    before = None
    for level in range(levels):
        middle = state.withColumn("depth", F.when(F.col("lo") < F.col("hi"), F.floor((F.col("lo") + F.col("hi")) / 2)))
        asked = middle.join(probes.where(F.col("level") == level).select("conv", "depth", "digest"), ["conv", "depth"], "left")
        told = asked.join(shared.select("digest", "owner"), "digest", "left")
        owned = F.coalesce(F.col("owner") == F.col("conv"), F.lit(True))
        going = F.col("depth").isNotNull()
        state = saved(told.select("conv", "n", F.when(going & ~owned, F.col("depth") + 1).otherwise(F.col("lo")).alias("lo"), F.when(going & owned, F.col("depth")).otherwise(F.col("hi")).alias("hi")), "search")
        if before is not None:
            discard(before)
        before = state
    discard(probes)
    return state.select("conv", "n", F.col("hi").alias("first"))


def subtree_sums(chains: DataFrame, values: list[str]) -> DataFrame:
    """``chain`` and each value summed over the chain and all chains below it, from ``chain, up, <values>``.

    Sums reach twice as far up in each round: a chain's sum over the chains
    less than 2^k below it and the sums of those 2^k below it give its sum
    over twice that distance. Rounds are as many as the depth has bits.
    """
    state = saved(chains.select("chain", "up", *values), "sums")
    while not (lower := state.where("up is not null")).isEmpty():
        given = lower.groupBy("up").agg(*[F.sum(v).alias(f"more_{v}") for v in values]).withColumnRenamed("up", "chain")
        further = state.where("up is not null").select(F.col("chain").alias("up"), F.col("up").alias("further"))
        added = state.join(given, "chain", "left").join(further, "up", "left")
        after = saved(added.select("chain", F.col("further").alias("up"), *[(F.col(v) + F.coalesce(f"more_{v}", F.lit(0))).alias(v) for v in values]), "sums")
        discard(state)
        state = after
    return state.select("chain", *values)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, first, ids = None, None, []

    def row() -> pa.RecordBatch:
        return pa.record_batch([pa.array([held], pa.string()), pa.array([first], pa.int64()), pa.array([",".join(map(str, ids))], pa.string())], ["digest", "first", "ids"])

    for batch in batches:
        for digest, conv in zip(batch.column("digest").to_pylist(), batch.column("conv").to_pylist()):
            if ids and (digest != held or len(ids) >= ID_CHUNK):
                yield row()
                ids = []
            if not ids:
                held, first = digest, conv
            ids.append(conv)
    if ids:
        yield row()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, sha = None, None
    for batch in batches:
        out = []
        for digest, ids in zip(batch.column("digest").to_pylist(), batch.column("ids").to_pylist()):
            if digest != held:
                if sha:
                    out.append((held, sha.hexdigest()))
                held, sha = digest, hashlib.sha256(ids.encode())
            else:
                sha.update(f",{ids}".encode())
        yield pa.record_batch([pa.array([d for d, _ in out], pa.string()), pa.array([s for _, s in out], pa.string())], ["digest", "ends_sha256"])
    if sha:
        yield pa.record_batch([pa.array([held], pa.string()), pa.array([sha.hexdigest()], pa.string())], ["digest", "ends_sha256"])


def id_digests(ends: DataFrame) -> DataFrame:
    """``digest, ends_sha256``: SHA-256 of the ascending ids, joined by commas, of the conversations ``conv`` with each digest.

    Ids are sorted in ranges, so those of one digest lie in as many tasks as
    they need; each joins them to texts of bounded length, and the few texts
    of a digest go through its hash one by one.
    """
    ranged = ends.repartitionByRange("digest", "conv").sortWithinPartitions("digest", "conv")
    chunks = ranged.select("digest", "conv").mapInArrow(_chunks, "digest string, first long, ids string")
    return chunks.repartition("digest").sortWithinPartitions("digest", "first").select("digest", "ids").mapInArrow(_hashed, "digest string, ends_sha256 string")


def prefix_trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """A row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    ``convs`` has a row ``(conv, n)`` for every conversation, those without
    turns too, and ``turns`` rows ``(conv, depth, role, text)`` with depths
    1..n. ``conv_id`` is the node's owner; the root has depth 0 and no parent.
    ``n_leaves`` counts the childless nodes of the subtree, ``saved_tokens``
    sums (n_convs - 1) x code points of the last text over it, and
    ``ends_sha256`` is of the ids of the conversations that end there.

    Equal conversations share all nodes, however many they are; empty turns
    are turns; no conversations, no nodes.
    """
    prefixes = saved(prefix_digests(convs, turns), "prefixes")
    shared = saved(prefixes.groupBy("digest").agg(F.min("conv").alias("owner"), F.count("*").alias("n_convs")).where("n_convs > 1"), "shared")
    owned = saved(first_owned(convs, prefixes, shared), "owned")

    # owned nodes; the node above a chain's first is another chain's
    nodes = prefixes.join(owned.select("conv", "first"), "conv").where("depth >= first").join(shared.select("digest", "n_convs"), "digest", "left").select("conv", "depth", "n", "first", "digest", "chars", F.coalesce("n_convs", F.lit(1).cast("long")).alias("n_convs"))
    nodes = saved(nodes, "nodes")
    above = prefixes.join(owned.where("first > 0 and first <= n").select("conv", "first"), "conv").where("depth = first - 1").join(shared.select("digest", "owner"), "digest")
    chains = saved(above.select(F.col("conv").alias("chain"), F.col("owner").alias("up"), F.col("depth").alias("up_depth")), "chains")
    digests = saved(id_digests(saved(prefixes.where("depth = n").select("digest", "conv"), "ends")), "end_digests")
    discard(prefixes, shared)

    hanging = chains.groupBy(F.col("up").alias("conv"), F.col("up_depth").alias("depth")).agg(F.count("*").alias("n_chains"))
    saves = (F.col("n_convs") - 1) * F.col("chars")
    placed = saved(nodes.join(hanging, ["conv", "depth"], "left").select("conv", "depth", "n", "first", "digest", "n_convs", saves.alias("saves"), F.coalesce("n_chains", F.lit(0).cast("long")).alias("n_chains")), "placed")
    leaf = F.when((F.col("depth") == F.col("n")) & (F.col("n_chains") == 0), 1).otherwise(0).cast("long")
    own = placed.groupBy(F.col("conv").alias("chain")).agg(F.sum(leaf).alias("leaves"), F.sum("saves").alias("saved"))
    sums = saved(subtree_sums(own.join(chains.select("chain", "up"), "chain", "left"), ["leaves", "saved"]), "totals")
    attached = chains.join(sums, "chain").groupBy(F.col("up").alias("conv"), F.col("up_depth").alias("depth")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
    below = placed.join(attached, ["conv", "depth"], "left")
    more = {"n_leaves": leaf + F.coalesce("more_leaves", F.lit(0)), "saved_tokens": F.col("saves") + F.coalesce("more_saved", F.lit(0))}
    summed = running(below, "conv", "depth", more, backwards=True).select("conv", "depth", "n", "first", "digest", "n_convs", "n_chains", "n_leaves", "saved_tokens")

    parents = summed.join(chains.select(F.col("chain").alias("conv"), "up"), "conv", "left").join(digests, "digest", "left")
    out = parents.select(
        F.col("conv").alias("conv_id"), "depth", F.when(F.col("depth") > F.col("first"), F.col("conv")).otherwise(F.col("up")).alias("parent_conv_id"), "n_convs",
        (F.col("n_chains") + (F.col("depth") < F.col("n")).cast("long")).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
    result = saved(out, "trie")
    discard(owned, nodes, chains, placed, sums, digests)
    return result


def conversation_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """:func:`prefix_trie` of the conversations as :func:`rebuilt` makes them.

    A null role or text is an empty one, a null turn comes before all others,
    turns of one number go by role and text, and rows without a conversation
    belong to none. Other columns are not read, whatever their names. An empty
    table gives no rows. Texts are hashed once and never grouped, so very long
    ones cost what reading them costs; a conversation of any length and a
    prefix that any number of conversations share are dealt over many tasks.
    """
    turns = numbered(conversations, conv_col, turn_col, role_col, text_col)
    convs, again = rebuilt(turns)
    found = prefix_trie(convs, again)
    discard(turns, convs)
    return found
