import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestrata.llm import components, exact_dedup, near_dedup, suffix_dedup
from lodestrata.llm.suffix_array import suffix_array

SCHEMA = "doc_id long, text string, lang string, source string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(WORDS) for _ in range(n))


def corpus() -> list[tuple]:
    base = [prose(i, 60 + 10 * i) for i in range(12)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, base[0]) for i in range(40)]  # a hot group of copies
    rows += [(200 + i, base[5] + f" extra{i}") for i in range(30)]  # and one of near copies
    rows += [(300, ""), (301, None), (302, "\n \t"), (303, "x"), (304, "x"), (305, "é" * 500), (None, base[1]), (306, "\u0000a"), (307, "ab" * 3000)]
    rows += [(308, base[2]), (308, base[2])]  # a repeated row
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s") for i, t in corpus()], SCHEMA).repartition(5)


def reference_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = np.array([xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))], np.uint64)
    return sum(1 << b for b in range(64) if 2 * int(((hashes >> np.uint64(b)) & np.uint64(1)).sum()) > len(hashes))


def groups(ids, linked):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if linked(i, j):
                parent[find(i)] = find(j)
    least = {}
    for i, k in enumerate(ids):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return [least.get(find(i)) for i in range(len(ids))]


@pytest.mark.parametrize("distance", [4, 6])
@pytest.mark.parametrize("block", [4, 1024])
def test_near_groups(spark, docs, distance, block, monkeypatch):
    monkeypatch.setattr(near_dedup.near_links, "__defaults__", (distance, block))
    rows = corpus()
    fps = [reference_fingerprint(t) for _, t in rows]
    expected = groups([i for i, _ in rows], lambda a, b: bin(fps[a] ^ fps[b]).count("1") <= distance)
    got = near_dedup.near_groups(docs, distance=distance).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1], x[2] or 0)
    assert sorted(map(tuple, got), key=key) == sorted([(i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, expected)], key=key)


def connected_by(spark, fps, **settings):
    """Whether links connect the fingerprints exactly as all pairs within four bits do."""
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = near_dedup.near_links(spark.createDataFrame([(s,) for s in signed], "fp long"), **settings)
    assert all(bin((r["a"] ^ r["b"]) & ((1 << 64) - 1)).count("1") <= 4 for r in links.collect())
    roots = {r["node"]: r["root"] for r in components.connected_components(links).collect()}
    got = [roots.get(s, s) for s in signed]
    expected = groups(list(range(len(fps))), lambda a, b: bin(fps[a] ^ fps[b]).count("1") <= 4)
    return len(set(zip(got, expected))) == len(set(got)) == len(set(expected))


def test_links_of_random_fingerprints(spark):
    r = random.Random(1)
    fps = []
    for _ in range(60):
        x = r.getrandbits(64)
        fps += [x] + [x ^ sum(1 << b for b in r.sample(range(64), k)) for k in (1, 2, 3, 4, 5, 6)]
    assert connected_by(spark, sorted(set(fps)))


def test_links_of_crowded_fingerprints(spark):
    """Many fingerprints with one leading segment: parts that are dense, parts that are far apart, and pairs across."""
    r, fps = random.Random(7), []
    for _ in range(40):
        x = r.getrandbits(42)
        fps += [x] + [x ^ sum(1 << b for b in r.sample(range(64), k)) for k in (1, 3, 4, 6)]
    fps += [(1 << 42) - 1 ^ 1 << a ^ 1 << b for a in range(12) for b in range(a)]
    assert connected_by(spark, sorted(set(fps)), block=16)


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)] + [(5, 5)]
    found = {x["node"]: x["root"] for x in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    adjacent = {}
    for a, b in edges:
        if a != b:
            adjacent.setdefault(a, set()).add(b)
            adjacent.setdefault(b, set()).add(a)
    for node in adjacent:
        seen, todo = {node}, [node]
        while todo:
            for x in adjacent[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        assert found[node] == min(seen)
    assert len(found) == len(adjacent)
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_near_copy_stays(spark, docs):
    left = near_dedup.drop_near_copies(docs)
    ids = [r["doc_id"] for r in left.collect()]
    assert 0 in ids and not set(range(100, 140)) & set(ids) and left.columns == docs.columns and None in ids


def test_similar_texts_are_found(spark):
    r = random.Random(9)
    rows, near = [], []
    for i in range(150):
        words = prose(1000 + i, 200).split()
        rows.append((i, " ".join(words)))
        if i % 3 == 0:  # two words changed: ten of two hundred shingles differ
            for _ in range(2):
                words[r.randrange(200)] = "changed"
            rows.append((1000 + i, " ".join(words)))
            near.append((i, 1000 + i))
        if i % 3 == 1:  # a third changed: far below the limit
            for k in range(0, 200, 3):
                words[k] = "other"
            rows.append((2000 + i, " ".join(words)))
    docs = spark.createDataFrame([(*x, "en", "s") for x in rows], SCHEMA)
    found = {(x["a"], x["b"]) for x in near_dedup.similar_links(docs).collect()}
    assert found <= set(near) and len(found) >= 0.9 * len(near)
    left = {x["doc_id"] for x in near_dedup.drop_near_copies(docs).collect()}
    assert len(left & {b for _, b in near}) <= 0.1 * len(near) and {i for i, _ in rows if i < 1000 or i >= 2000} <= left


def bucketed(spark, monkeypatch, texts, cell):
    """Links of texts that all come into one bucket."""
    monkeypatch.setattr(near_dedup, "bands", lambda hashes: [1])
    monkeypatch.setattr(near_dedup, "CELL", cell)
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], SCHEMA)
    return {(x["a"], x["b"]) for x in near_dedup.similar_links(docs).collect()}


def jaccard(a, b):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


@pytest.mark.parametrize("cell", [256, 4])
def test_every_pair_of_a_bucket(spark, monkeypatch, cell):
    texts = []
    for k in range(8):  # the first of three is like neither other one, these two are like each other
        shared, a, b = prose(100 + k, 170), prose(200 + k, 35), prose(300 + k, 35)
        texts += [f"{shared} {a}", f"{shared} {b}", f"{shared} {b} and so on"]
    chain = prose(400, 200).split()  # each like the next alone
    texts += [" ".join(chain[12 * i : 12 * i + 150]) for i in range(5)]
    links = bucketed(spark, monkeypatch, texts, cell)
    assert all(jaccard(texts[a], texts[b]) >= 0.8 for a, b in links)
    expected = groups(list(range(len(texts))), lambda i, j: jaccard(texts[i], texts[j]) >= 0.8)
    assert jaccard(texts[0], texts[1]) < 0.8 and expected[1] == expected[2] != expected[0] and expected[-1] == expected[-5]
    assert groups(list(range(len(texts))), lambda i, j: (j, i) in links) == expected


def test_a_template_gives_rows_in_proportion(spark, monkeypatch):
    """Documents that share half their words and no more: no links, and rows that grow as the documents do."""
    monkeypatch.setattr(near_dedup, "CELL", 16)
    template, rows = prose(77, 80), []
    seen = near_dedup.saved

    def counted(df, name, *by):
        out = seen(df, name, *by)
        rows[-1] += out.count()
        return out

    monkeypatch.setattr(near_dedup, "saved", counted)
    for n in (150, 600):
        texts = [f"{template} {prose(50_000 + i, 80)}" for i in range(n)]
        rows.append(0)
        monkeypatch.setattr(near_dedup, "bands", lambda hashes: [1])
        docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], SCHEMA)
        assert near_dedup.similar_links(docs).count() == 0
    assert rows[1] <= 5 * rows[0]


@pytest.mark.parametrize("kind", ["appended", "cut", "scattered"])
def test_recall_at_the_limit(spark, kind):
    r, rows, near = random.Random(11), [], []
    for i in range(300):
        words = prose(3000 + i, 250).split()
        rows.append((i, " ".join(words)))
        n = r.randrange(38, 60)
        if kind == "appended":
            words += prose(9000 + i, n).split()
        elif kind == "cut":
            words = words[: 250 - min(n, 49)]
        else:
            for at in r.sample(range(250), r.randrange(4, 6)):
                words[at] = "changed"
        rows.append((1000 + i, " ".join(words)))
        if 0.8 <= jaccard(rows[-1][1], rows[-2][1]) < 0.9:
            near.append((i, 1000 + i))
    docs = spark.createDataFrame([(*x, "en", "s") for x in rows], SCHEMA)
    found = {(x["a"], x["b"]) for x in near_dedup.similar_links(docs).collect()}
    print(kind, len(found & set(near)), "of", len(near))
    assert len(near) > 200 and len(found & set(near)) >= 0.98 * len(near)


def test_exact_membership(spark, docs):
    rows = corpus()
    got = {}
    for r in exact_dedup.membership(docs).collect():
        got.setdefault((r["doc_id"], r["digest"]), []).append((r["keep_id"], r["group_size"], r["kept"]))
    same = {}
    for i, t in rows:
        same.setdefault(t or "", []).append(i)
    for t, ids in same.items():
        keep, digest = max((i for i in ids if i is not None), default=None), hashlib.sha256(t.encode()).hexdigest()
        for i in set(ids):
            each = got.pop((i, digest))
            assert len(each) == ids.count(i) and {x[:2] for x in each} == {(keep, len(ids))} and sum(x[2] for x in each) == (i == keep)
    assert not got


def test_one_copy_stays(spark, docs):
    left = exact_dedup.drop_copies(docs).collect()
    assert sorted(r["text"] or "" for r in left) == sorted({t or "" for _, t in corpus()})
    assert left[0].asDict().keys() == {"doc_id", "text", "lang", "source"}


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert near_dedup.near_groups(none).count() == exact_dedup.membership(none).count() == suffix_dedup.remove_repeats(none).count() == 0


def test_suffix_array():
    r = random.Random(3)
    for _ in range(3000):
        k = r.choice([1, 2, 3, 5])
        t = [r.randrange(k) for _ in range(r.randint(0, 30))]
        assert suffix_array(t) == sorted(range(len(t)), key=lambda i: t[i:])


@pytest.mark.parametrize("length, gram, crowd", [(40, 16, 400), (40, 16, 2), (200, 32, 400)])
def test_repeats_against_every_window(spark, docs, length, gram, crowd, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "ARRAY_BINS", crowd)
    monkeypatch.setattr(suffix_dedup, "HOT_WINDOW", 5)
    monkeypatch.setattr(suffix_dedup, "STRETCH", 2000)
    rows = [(i, (t or "").encode()) for i, t in corpus()]
    times = {}
    for _, b in rows:
        for i in range(len(b) - length + 1):
            times[b[i : i + length]] = times.get(b[i : i + length], 0) + 1
    expected = []
    for i, b in rows:
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - length + 1):
            if times[b[k : k + length]] > 1:
                gone[k : k + length] = True
        edges = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[: len(b)]])
        expected.append((i, len(b), int(gone.sum()), edges, hashlib.sha256(kept).hexdigest()))
    got = suffix_dedup.remove_repeats(docs, length=length, gram=gram).drop("removed").collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[4])
    assert sorted(map(tuple, got), key=key) == sorted(expected, key=key)


def test_clashing_columns(spark, docs):
    odd = docs.withColumn("fp", F.lit(1)).withColumn("digest", F.lit("x")).withColumn("_id", F.lit(2)).withColumn("tie", F.lit(3))
    assert near_dedup.near_groups(odd).count() == exact_dedup.membership(odd).count() == suffix_dedup.remove_repeats(odd).count() == len(corpus())


def test_clashing_columns_pass_through(spark, docs):
    from lodestrata.llm import mixing

    odd = docs.withColumn("_id", F.lit(2)).withColumn("_copies", F.lit("x")).withColumn("_d", F.lit(3)).withColumn("node", F.lit(4)).withColumn("size", F.lit(5))
    for kept in (exact_dedup.drop_copies(odd), near_dedup.drop_near_copies(odd), mixing.apply_mix(odd)):
        row = kept.first()
        assert kept.columns == odd.columns and (row["_id"], row["_copies"], row["_d"], row["node"], row["size"]) == (2, "x", 3, 4, 5)


def test_repeats_leave_only_what_the_result_reads(spark, docs, tmp_path, monkeypatch):
    from lodestrata.llm import shared

    monkeypatch.setattr(suffix_dedup, "ARRAY_BINS", 2)
    monkeypatch.setattr(suffix_dedup, "HOT_WINDOW", 5)
    monkeypatch.setattr(shared, "shared_dir", lambda _: f"file://{tmp_path}")
    got = suffix_dedup.remove_repeats(docs, length=40, gram=16)
    assert {p.name.partition("-")[0] for p in (tmp_path / "lodestrata").iterdir()} == {"spans", "presence"}
    assert got.count() == len(corpus())
