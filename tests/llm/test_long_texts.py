"""Texts of more than a megabyte beside short ones: judged whole, and alone in a Python worker."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lodestrata.llm import chat, lz_fingerprint, pii, quality
from lodestrata.llm.shared import CHUNK_CHARS

WORDS = "river stone cloud maple ember frost delta ocean pepper silver".split()


def prose(seed: int, chars: int) -> str:
    r = random.Random(seed)
    out = []
    size = 0
    while size < chars:
        word = r.choice(WORDS) + str(r.randrange(1000))
        out.append(word)
        size += len(word) + 1
    return " ".join(out)


@pytest.fixture(scope="module")
def texts():
    long = prose(1, CHUNK_CHARS + 5000)
    return {1: long + " write to ann@example.org", 2: "from 10.0.0.1 é", 3: prose(2, CHUNK_CHARS + 1) + " +49 30 1234567", 4: None, 5: ""}


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(1)


def test_personal_data_at_the_end(docs, texts):
    got = {r["doc_id"]: r for r in pii.find_pii(docs).collect()}
    assert set(got) == set(texts) and (got[1]["n_email"], got[2]["n_ip"], got[3]["n_phone"]) == (1, 1, 1)
    for i, t in texts.items():
        assert got[i]["spans"] == pii.written(pii.spans(t))


def test_fingerprints_cover_the_whole_text(docs, texts):
    got = {r["doc_id"]: r for r in lz_fingerprint.chained(docs).collect()}
    order = sorted(texts, reverse=True)
    for i, following in zip(order, order[1:] + order[:1]):
        t, n = texts[i] or "", len(texts[i] or "") // 3
        edited = t[: len(t) - n] + (texts[following] or "")[:n]
        row = got[i]
        assert row["n_chars"] == len(t) and row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert row["fingerprint"] == lz_fingerprint.written(lz_fingerprint.fingerprint(t))
        assert row["edited_fingerprint"] == lz_fingerprint.written(lz_fingerprint.fingerprint(edited))


def test_quality_of_whole_texts(spark, docs, texts):
    labelled = [(i, prose(i, 300) if i % 2 else "@@ ## " * 40) for i in range(100, 200)]
    rows = spark.createDataFrame(labelled, "doc_id long, text string")
    labels = rows.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    model = quality.train(rows, labels)
    got = {r["doc_id"]: r["score"] for r in quality.score_quality(docs, model).collect()}
    alone = {i: quality.score_quality(docs.where(F.col("doc_id") == i), model).first()["score"] for i in texts}
    assert got == alone and all(0 <= x <= 1 for x in got.values()) and got[1] > 0.5


def test_a_long_turn_reads_back(spark, texts):
    turns = [(7, 0, "user", "hi"), (7, 1, "assistant", texts[1]), (7, 2, "user", None), (7, 3, "assistant", "</s>" + texts[3])]
    got = chat.read_back(chat.windows(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))).first()
    assert [tuple(t) for t in got["turns"]] == [(r, t or "") for _, _, r, t in turns]
    assert got["loss_text"] == texts[1] + "</s>" + texts[3]
