"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, id_key, saved, text_of

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: The mix's words against all words.
SHARE = 1.5
#: Most copies of a document, and so most words of a source against its size.
MAX_COPIES = 2
#: Sources that a mix may have; their table (a few dozen bytes each) goes to the driver and to every task.
MAX_SOURCES = 100_000
#: Single copies that go to every task; their number follows the sources, of which each has a few dozen at most.
MOST_CHANGES = 500_000
#: Documents of each source, size class and direction that may even out what rounding left.
SPARES = 4


def word_count(text_col: str = "text"):
    """Number of runs of anything but ASCII white space; 0 for null."""
    return F.regexp_count(text_of(text_col), F.lit(r"[^\x20\x09-\x0D]++")).cast("long")


def water_fill(sizes: list[int], weights=WEIGHTS, share: float = SHARE, cap: float = MAX_COPIES) -> list[float]:
    """Targets by weight, each at most ``cap`` times its size, the excess reshared by weight until none is above."""
    budget = share * sum(sizes)
    targets, open_ = [0.0] * len(sizes), list(range(len(sizes)))
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    while open_:
        total = sum(weight[i] for i in open_)
        over = [i for i in open_ if budget * weight[i] / total > cap * sizes[i]]
        if not over:
            for i in open_:
                targets[i] = budget * weight[i] / total
            break
        for i in over:
            targets[i] = float(cap * sizes[i])
            budget -= targets[i]
        open_ = [i for i in open_ if i not in set(over)]
    return targets


def balance(table: DataFrame, targets: dict, rounds: int = 60, tolerance: float = 1e-12) -> dict:
    """Multipliers of the dual: ``{source: lambda}``, the rate of a document being ``exp(lambda)``.

    The mix is the one of least relative entropy to the corpus, each document
    weighing as many words as it has, whose words meet every source's target.
    Its dual is convex; a Newton step of it needs the tilted word totals of
    the sources, and Spark sums those in every iteration over ``table(source,
    size, docs)``. The Hessian is diagonal, as a word has one source.

    A source without words or with target 0 gets minus infinity. Rates that
    have not settled after ``rounds`` are an error.
    """
    spark = table.sparkSession
    lam = {s: (0.0 if t > 0 else -math.inf) for s, t in targets.items()}
    for _ in range(rounds):
        now = spark.createDataFrame([(s, x) for s, x in lam.items() if x > -math.inf] or [], "source string, lambda double")
        sums = table.join(F.broadcast(now), table["source"].eqNullSafe(now["source"]) & (table["size"] > 0)).groupBy(table["source"]).agg(F.sum(F.col("size") * F.col("docs") * F.exp("lambda")).alias("words"))
        words = {r[0]: r[1] for r in sums.collect()}  # at most MAX_SOURCES rows
        worst = 0.0
        for s in list(lam):
            if lam[s] == -math.inf:
                continue
            if not words.get(s):
                lam[s] = -math.inf
                continue
            gap = targets[s] / words[s] - 1
            lam[s] += gap if gap <= 1 else math.log1p(gap)  # a damped step where the full one would overshoot
            worst = max(worst, abs(gap))
        if worst <= tolerance:
            return lam
    raise RuntimeError(f"the rates have not settled after {rounds} rounds: a source is off by {worst:.3g} of its target")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, cap: int = MAX_COPIES) -> DataFrame:
    """A row per document: ``doc_id, size, source_size, target, copies, taken``.

    Sources are taken by code point, null last, and weigh ``weights`` in turn;
    they share ``share`` times all words, none above ``cap`` times its own.
    Entropy balancing gives each document a rate; its whole part is copied and
    its fraction rounded by a hash of the id, so reruns agree. What rounding
    leaves over in a source is then evened out, from the largest size class
    down, by a bounded number of single documents; no document goes beyond
    ``cap`` copies.

    Sizes are whole-text word counts. Null texts have size 0, target words
    come from other documents, and their copies are rounded like any other's.
    Rows that repeat an id get equal copies. A corpus without words takes
    nothing; an empty table gives no rows.
    """
    sized, plan, changes = _solved(docs, id_col, text_col, source_col, weights, share, cap)
    mixed = _with_copies(sized, "doc_id", "source", plan, changes, cap)
    return mixed.select("doc_id", "size", F.col("__mix_source_size").alias("source_size"), F.col("__mix_target").alias("target"), F.col("__mix_copies").alias("copies"), (F.col("__mix_copies") * F.col("size")).alias("taken"))


def _solved(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights, share: float, cap: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sizes of the documents, the rate of each source, and the single copies that even out what rounding leaves."""
    spark = docs.sparkSession
    sized = saved(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text_col).alias("size")), "sizes")
    table = saved(sized.groupBy("source", "size").agg(F.count("*").alias("docs")), "size_table")
    totals = table.groupBy("source").agg(F.sum(F.col("size") * F.col("docs")).alias("words")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    totals = sorted((r for r in totals), key=lambda r: (r[0] is None, r[0] or ""))
    targets = water_fill([r[1] for r in totals], weights, share, cap)
    lam = balance(table, {r[0]: t for r, t in zip(totals, targets)})
    discard(table)
    rates = [(r[0], r[1], t, min(float(cap), round(math.exp(lam[r[0]]), 9)) if lam[r[0]] > -math.inf else 0.0) for r, t in zip(totals, targets)]
    plan = F.broadcast(spark.createDataFrame(rates, "__mix_s string, __mix_source_size long, __mix_target double, __mix_rate double"))
    none = spark.createDataFrame([], f"doc_id {dict(sized.dtypes)['doc_id']}, change long")
    rounded = _with_copies(sized, "doc_id", "source", plan, none, cap).select("doc_id", "source", "size", F.col("__mix_target").alias("target"), F.col("__mix_copies").alias("copies"))
    changes = saved(_even_out(rounded, cap), "changes")
    # At most a few for each source, however many documents there are: sent to every task below a checked count.
    return sized, plan, F.broadcast(changes) if changes.limit(MOST_CHANGES + 1).count() <= MOST_CHANGES else changes.hint("merge")


def _with_copies(rows: DataFrame, id_col: str, source_col: str, plan: DataFrame, changes: DataFrame, cap: int) -> DataFrame:
    """``rows`` with ``__mix_source_size``, ``__mix_target`` and ``__mix_copies``; no row moves unless the changes are many."""
    chance = F.pmod(id_key(id_col), F.lit(1 << 40)) / float(1 << 40)
    rate = F.col("__mix_rate")
    rounded = F.least(F.lit(cap).cast("long"), F.floor(rate).cast("long") + (chance < rate - F.floor(rate)).cast("long"))
    few = changes.select(F.col("doc_id").alias("__mix_id"), F.col("change").alias("__mix_change"))
    rated = rows.join(plan, rows[source_col].eqNullSafe(plan["__mix_s"]))
    whole = rated.join(few, rated[id_col] == few["__mix_id"], "left")
    return whole.withColumn("__mix_copies", rounded + F.coalesce("__mix_change", F.lit(0).cast("long"))).drop("__mix_s", "__mix_rate", "__mix_id", "__mix_change")


def _even_out(rounded: DataFrame, cap: int) -> DataFrame:
    """``(doc_id, change)``: single copies more or less that bring each source to its target.

    Of each source, binary size class and direction at most ``SPARES``
    documents are offered, found by map-side maxima; so a source, whatever
    its size, is a bounded list, which one expression walks from the largest
    document to the smallest.
    """
    left = rounded.groupBy("source").agg((F.max("target") - F.sum(F.col("copies") * F.col("size"))).alias("gap"))
    once = rounded.where("doc_id is not null and size > 0")
    more = once.where(F.col("copies") < cap).withColumn("change", F.lit(1))
    less = once.where("copies > 0").withColumn("change", F.lit(-1))
    offers = more.unionByName(less).groupBy("source", "change", F.floor(F.log2("size")).alias("class"), F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(SPARES)).alias("place"))
    offers = offers.agg(F.max(F.struct("size", "doc_id")).alias("top")).select("source", "change", "top.*")
    # Repeated ids move together, so they are left alone here.
    unique = once.groupBy("doc_id").agg(F.count("*").alias("n")).where("n = 1").select("doc_id")
    offers = offers.join(unique, "doc_id", "left_semi")
    lists = offers.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("size", "doc_id", "change")), asc=False).alias("offers"))
    chosen = lists.join(left, lists["source"].eqNullSafe(left["source"])).select(
        F.aggregate(
            "offers",
            F.struct(F.col("gap").alias("gap"), F.expr("cast(array() as array<struct<doc_id:{t},change:int>>)".format(t=dict(rounded.dtypes)["doc_id"])).alias("picks")),
            lambda acc, x: F.when(
                # a copy more or less is taken where it brings the source nearer to its target
                (F.abs(acc["gap"] - x["size"] * x["change"]) < F.abs(acc["gap"])) & ~F.exists(acc["picks"], lambda p: p["doc_id"] == x["doc_id"]),
                F.struct((acc["gap"] - x["size"] * x["change"]).alias("gap"), F.concat(acc["picks"], F.array(F.struct(x["doc_id"].alias("doc_id"), x["change"].alias("change")))).alias("picks")),
            ).otherwise(acc),
        )["picks"].alias("picks")
    )
    return chosen.select(F.explode("picks").alias("p")).select(F.col("p.doc_id").alias("doc_id"), F.col("p.change").cast("long").alias("change"))


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, cap: int = MAX_COPIES) -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it; rows taken 0 times are left out.

    Rows keep all their columns, whatever their names; texts stay where they
    are. Null ids and texts, repeated rows and empty tables as in :func:`mix`.
    """
    _, plan, changes = _solved(docs, id_col, text_col, source_col, weights, share, cap)
    mixed = _with_copies(docs, id_col, source_col, plan, changes, cap).where("__mix_copies > 0")
    return mixed.withColumn("__mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__mix_copies")))).select(*[mixed[c] for c in docs.columns])
