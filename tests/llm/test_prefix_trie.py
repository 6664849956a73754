import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from lodestrata.llm import prefix_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string"


def expected(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(x)] for c, x in own.items()}
    seqs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        seqs[c] = tuple(own.get(base, [])[:h] + turns[h:])
    return nodes(seqs)


def nodes(seqs):
    members = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    kids, out = {}, []
    for k in members:
        if k:
            kids.setdefault(k[:-1], []).append(k)

    def below(k):  # leaves, saved
        saved = (len(members[k]) - 1) * len(k[-1][1]) if k else 0
        each = [below(x) for x in kids.get(k, [])]
        return sum(x for x, _ in each) or 1, saved + sum(y for _, y in each)

    for k, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(seqs[c]) == len(k))))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids.get(k, [])), *below(k), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations():
    r, rows = random.Random(4), []
    said = ["hi", "", None, "how", "🙂 ok", "hi"]
    for c in [*range(0, 40), *range(100, 130), *range(-5, 0), 257, 300, 9_999_999_999]:
        for k in range(r.choice([1, 2, 3, 6, 9])):
            rows.append((c, k if r.random() < 0.9 else None, r.choice(["user", "assistant", None]), r.choice(said)))
    for c in range(200, 256):  # equal but for their heads, and long
        rows += [(c, k, "user", f"t{k % 3}") for k in range(40)]
    return rows + [(7, 1, "user", "hi"), (7, 1, "user", "hi"), (None, 0, "user", "nobody")]


def test_query(spark, tmp_path):
    rows = conversations()
    spark.createDataFrame(rows, SCHEMA).withColumn("depth", F.lit("x")).withColumn("conv", F.lit(1)).repartition(5).write.parquet(f"file://{tmp_path}/conversations.parquet")
    got = queries.op11_prefix_trie(spark, f"file://{tmp_path}")
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert {t for c, t in got.dtypes if c != "ends_sha256"} == {"bigint"}
    assert sorted(map(tuple, got.collect()), key=repr) == expected(rows)


def test_empty(spark):
    assert prefix_trie.conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert prefix_trie.conversation_trie(spark.createDataFrame([(None, 0, "user", "x")], SCHEMA)).count() == 0


def test_chains_that_hang_on_chains(spark):
    """Each conversation leaves the one before it one turn later, so chains are as deep as the tree."""
    n = 40
    seqs = {c: tuple([("u", f"t{d}") for d in range(c)] + [("a", f"end {c}"), ("a", "")]) for c in range(n, 0, -1)}
    seqs |= {c + 500: s for c, s in seqs.items()} | {1000: (), 1001: ()}
    convs = spark.createDataFrame([(c, len(s)) for c, s in seqs.items()], "conv long, n long")
    turns = spark.createDataFrame([(c, d + 1, r, t) for c, s in seqs.items() for d, (r, t) in enumerate(s)], "conv long, depth long, role string, text string")
    assert sorted(map(tuple, prefix_trie.prefix_trie(convs, turns).collect()), key=repr) == nodes(seqs)


@pytest.mark.parametrize("backwards", [False, True])
def test_running_sums_over_runs(spark, backwards):
    rows = [(k, i, (7 * i + k) % 5) for k in range(4) for i in range(1, 30 if k else 3)]
    df = spark.createDataFrame(rows, "k long, i long, v long")
    got = {(r["k"], r["i"]): r["s"] for r in prefix_trie.running(df, "k", "i", {"s": F.col("v")}, run=4, backwards=backwards).collect()}
    for k, i, _ in rows:
        assert got[k, i] == sum(v for q, j, v in rows if q == k and (j >= i if backwards else j <= i))


def test_numbers_across_ranges(spark):
    turns = [(1, (i * 37) % 400, "user", f"{i}") for i in range(400)] + [(2, None, None, None), (2, 0, "a", "b")]
    got = sorted(map(tuple, prefix_trie.numbered(spark.createDataFrame(turns, SCHEMA)).collect()))
    mine = sorted((t, x) for c, t, _, x in turns if c == 1)
    assert got == [(1, i + 1, "user", x) for i, (_, x) in enumerate(mine)] + [(2, 1, "", ""), (2, 2, "a", "b")]


def test_many_ids_of_one_node(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "ID_CHUNK", 3)
    ends = spark.createDataFrame([("a", c) for c in range(-5, 60)] + [("b", 7)], "digest string, conv long").repartition(3)
    got = {r["digest"]: r["ends_sha256"] for r in prefix_trie.id_digests(ends).collect()}
    assert got == {"a": hashlib.sha256(",".join(map(str, range(-5, 60))).encode()).hexdigest(), "b": hashlib.sha256(b"7").hexdigest()}
