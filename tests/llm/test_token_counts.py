import os
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

public = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from lodestrata.llm import queries, token_counts  # noqa: E402

PATH = public.path("word_bpe_49k.json")
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no public model")


@pytest.fixture(scope="module")
def model():
    return token_counts.MergeModel.load(PATH)


def library(texts):
    return [len(e.ids) for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]


def test_every_assigned_character(model):
    texts = [f"a{chr(i)}B{chr(i)}" for i in range(0x110000) if not 0xD800 <= i < 0xE000 and unicodedata.category(chr(i)) not in ("Cn", "Co")]
    counter = token_counts.Counter(model)
    assert [n for k in range(0, len(texts), 20_000) for n in counter.count(texts[k : k + 20_000])] == library(texts)


def test_mixed_texts(model):
    r = random.Random(1)
    parts = ["a", "b", "th", "ing", "'s", "'RE", " ", "\n", "9", "!", "é", "é", "Σ", "ΑΣ", "İ", "ß", "中", "🙂", "<|endoftext|>", "<|startoftext|>", "<|", "\x1c", "　", "́", "'", "_"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 60))) for _ in range(8000)]
    assert token_counts.Counter(model).count(texts) == library(texts)


@pytest.mark.parametrize("rounds", [64, 1])
def test_long_words_and_runs(model, rounds, monkeypatch):
    monkeypatch.setattr(token_counts, "ROUNDS", rounds)
    r = random.Random(2)
    texts = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)) for n in (3, 100, 1000, 30_000)] + ["a" * n for n in (1, 2, 3, 64, 65, 129, 50_001)] + ["!" * 5000 + "?!" * 999, "ab" * 7777, "é" * 999]
    assert token_counts.Counter(model).count(texts) == library(texts)


def test_a_worker_forgets(model, monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 3)
    monkeypatch.setattr(token_counts, "BATCH_SYMBOLS", 16)
    counter, texts = token_counts.Counter(model), ["one two three four", "five six seven", "one"]
    assert [counter.count([t])[0] for t in texts * 2] == library(texts) * 2


def test_query(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, "Say <|endoftext|> twice <|endoftext|>"), (3, "x y"), (None, " \n "), (4, "word " * 2048), (5, "word " * 2049), (6, "Straße " * 200_000)]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit("x")).write.parquet(f"file://{tmp_path}/documents.parquet")
    found = queries.op12_token_counts(spark, f"file://{tmp_path}")
    assert found.dtypes == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_tokens", "bigint"), ("over_limit", "boolean")]
    expected = [(i, len((t or "").encode()), n, n > 2048) for (i, t), n in zip(rows, library([t or "" for _, t in rows]))]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(expected, key=repr)
    assert [e[3] for e in expected[5:]] == [False, True, True]
    assert token_counts.count_tokens(spark.createDataFrame([], "doc_id long, text string"), token_counts.MergeModel.load(PATH)).count() == 0


def test_other_models_are_refused(tmp_path):
    import json

    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    spec["model"]["merges"] = spec["model"]["merges"][::-1]
    at = tmp_path / "m.json"
    at.write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        token_counts.MergeModel.load(str(at))
