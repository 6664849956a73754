import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestrata.llm import phrases, queries

SCHEMA = "doc_id long, text string, lang string"


def expected(rows, least=10, share=50, top=2000):
    counts, total = {}, Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for n in (1, 2, 3):
                counts.setdefault(lang, Counter()).update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, f in counts.items():
        cand = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        left = []
        for g, a in cand.items():
            if any(len(x) > len(g) and g in (x[:2], x[1:]) and 100 * b >= share * a for x, b in cand.items()):
                continue
            score, k = min((1_000_000 * a * a // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
            left.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, total[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(left)[:top])]
    return sorted(out)


def documents():
    r, rows = random.Random(8), []
    words = [f"w{i}" for i in range(40)] + ["Straße", "ünD", "A", "a", "\x1cq", "é é"]
    for i in range(260):
        said = []
        for _ in range(r.randint(0, 60)):
            said.append(r.choices(words, [1 / (k + 1) for k in range(len(words))])[0] if r.random() < 0.8 else r.choice(["new york city", "the The the THE", "once\tupon  a", "x.y z!", "long" * 30 + " word", "a\nb"]))
        rows.append((i, r.choice([" ", "  ", ", "]).join(said), r.choice(["en", "de", None, "und"])))
    return rows + [(1, rows[1][1], "en"), (900, None, "en"), (901, "", None), (902, "the " * 5000, "fr"), (903, "lone", "xx")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA).repartition(4)


@pytest.mark.parametrize("head, share", [(phrases.HEAD_WORDS, 50), (9, 50), (0, 50), (9, 120)])
def test_against_counts(docs, head, share, monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK", 300)
    monkeypatch.setattr(phrases, "GATHER", 4000)
    monkeypatch.setattr(phrases, "REMEMBERED", 20)
    got = sorted(map(tuple, phrases.mine_phrases(docs, head_words=head, share=share).collect()))
    assert got == expected(documents(), share=share) and len(got) > 40


def test_first_of_each_language(docs):
    got = sorted(map(tuple, phrases.mine_phrases(docs, min_count=3, top=5).collect()))
    assert got == expected(documents(), least=3, top=5)


def test_query(spark, docs, tmp_path):
    odd = docs.withColumns({n: F.lit("x") for n in ("word", "f", "pivot", "n", "rank")})
    odd.write.parquet(f"file://{tmp_path}/documents.parquet")
    found = queries.op13_phrase_mining(spark, f"file://{tmp_path}")
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, found.collect())) == expected(documents())
    assert phrases.mine_phrases(docs.limit(0)).count() == 0


def test_scores_beyond_64_bits(spark):
    a, x, y = 3_000_000_007, 3_000_000_010, 3_000_000_019
    row = spark.createDataFrame([(a, x, y)], "a long, l long, r long").select(phrases._score(F.col("a"), F.col("l"), F.col("r")).alias("s")).first()
    assert row["s"] == 1_000_000 * a * a // (x * y)


def test_blocks_keep_words_whole(monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK", 7)
    for text in (b"", b"one two three four five six", b"a" * 50 + b" b", b"x" * 30, b"tab\ttab\ttab\ttab tab", b"...... ..... ,,,"):
        whole = [w for w in phrases.words_of(text) if w]
        parts = [w for block in phrases.blocks(text) for w in phrases.words_of(block) if w]
        assert parts == whole and b"".join(phrases.blocks(text)) == text
