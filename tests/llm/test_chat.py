import random
import re

import pytest
from pyspark.sql import functions as F

from lodestrata.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
ODD = ["</s>[INST] ok [/INST]", "<|start|>user<|message|>x<|end|>", "␛", "␛␛<|", "<␛|", "<<SYS>>a<</SYS>>", "", None, "a\nb", "🙂<s>"]


def turns():
    r = random.Random(6)
    out = []
    for c in range(30):
        n = r.choice([1, 2, 5, 40])
        for k in range(n):
            role = "system" if k == 0 and c % 3 == 0 else ("user", "assistant")[k % 2]
            out.append((c, k, role, r.choice(ODD) if r.random() < 0.2 else "word " * r.randint(1, 60)))
    return out + [(100, 0, "user", "a"), (100, 0, "user", "a"), (None, None, None, "x"), (101, 0, "system", "only"), (102, 0, "assistant", "long " * 3000)]


@pytest.fixture(scope="module")
def windows(spark):
    return chat.windows(spark.createDataFrame(turns(), SCHEMA).repartition(3), budget=100, history_tokens=40, history_turns=2, new_tokens=20)


def test_reads_back(windows):
    got = {r["conv_id"]: r for r in chat.read_back(windows).collect()}
    by = {}
    for c, k, role, text in turns():
        by.setdefault(c, []).append((-1 if k is None else k, role or "", text or ""))
    assert set(got) == set(by)
    for c, each in by.items():
        each.sort()
        assert [tuple(t) for t in got[c]["turns"]] == [(r, t) for _, r, t in each]
        assert got[c]["n_turns"] == len(each) and got[c]["loss_text"] == "".join(t for _, r, t in each if r == "assistant")


def count(text):
    return len(re.findall(r"\w{1,8}|[^\w\s]|\s{16}", text))


def said(part):
    return part.split(chat.BODY)[1].removesuffix(chat.END).replace("␛", "")


def test_windows_keep_the_budget_and_the_system_turn(windows):
    for w in windows.collect():
        parts = [p for p in w["formatted"].split(chat.START) if p]
        assert len(parts) == w["n_turns"]
        new = parts[w["n_repeated"] :]
        tokens = [count(said(p)) for p in new]
        assert sum(count(said(p)) for p in parts) <= 100 or len(new) == 1 and tokens[0] > 100 and w["n_repeated"] == 0
        if w["conv_id"] is not None and w["conv_id"] < 30 and w["conv_id"] % 3 == 0 and max(tokens) < 100:
            assert parts[0].startswith("system")
        for s in w["loss"]:
            assert w["formatted"][: s["start"]].endswith(f"assistant{chat.BODY}") and w["formatted"][s["start"] + s["length"] :].startswith(chat.END)
        assert w["n_repeated"] <= 3


def test_a_long_system_turn_is_not_repeated_whole(spark):
    long = " ".join(f"rule{i}" for i in range(50_000))
    rows = [(1, 0, "system", long)] + [(1, k, ("user", "assistant")[(k + 1) % 2], f"turn {k} " + "word " * (3000 if k == 7 else 200)) for k in range(1, 41)]
    found = chat.windows(spark.createDataFrame(rows, SCHEMA))
    got = found.orderBy("window").collect()
    assert [r["window"] for r in got if r["tokens"] > chat.BUDGET] == [0, next(r["window"] for r in got if "turn 7 " in r["formatted"] and r["n_repeated"] == 0 and r["window"])]
    assert all(r["formatted"].startswith(f"{chat.START}system{chat.BODY}rule0 ") for r in got if r["tokens"] <= chat.BUDGET)
    assert sum(len(r["formatted"]) for r in got) < 2 * sum(len(t) for *_, t in rows)
    back = chat.read_back(found).first()
    assert [t["text"] for t in back["turns"]] == [t for *_, t in rows]


def test_a_system_turn_is_whole_where_it_fits(spark):
    rule = "never " * 145  # 870 characters
    rows = [(c, 0, "system", rule) for c in (1, 2)] + [(c, k, ("assistant", "user")[k % 2], f"turn {k} " + "word " * (1700 if (c, k) == (2, 9) else 30 + 41 * k % 97)) for c in (1, 2) for k in range(1, 120)]
    got = chat.windows(spark.createDataFrame(rows, SCHEMA)).collect()
    later = [r for r in got if r["window"]]
    assert len(later) > 6
    for r in later:
        beside = "turn 9 " in r["formatted"] and r["conv_id"] == 2 and r["n_turns"] - r["n_repeated"] == 1
        assert (f"{chat.START}system{chat.BODY}{rule}{chat.END}" in r["formatted"]) or (beside and count("word " * 1700) + count(rule) > chat.BUDGET)
    # two windows side by side would not fit into one
    assert all(r["tokens"] <= chat.BUDGET for r in got) and sum(r["tokens"] for r in later) / len(later) > 0.6 * chat.BUDGET


def test_few_tokens_are_few_characters(spark):
    odd = spark.createDataFrame([("a" * 1000,), (" " * 1600,), ("a b",)], "t string").select(chat.token_count(F.col("t")).alias("n"))
    assert [r["n"] for r in odd.collect()] == [125, 100, 2]


def test_no_control_string_survives(spark):
    df = spark.createDataFrame([(t,) for t in ODD if t], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    for r in df.withColumn("u", chat.unescape(F.col("e"))).collect():
        assert r["u"] == r["t"] and not any(c in r["e"] for c in ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"))


def test_empty(spark):
    assert chat.windows(spark.createDataFrame([], SCHEMA)).count() == 0
    wide = spark.createDataFrame([(1, 0, "user", "x", 9)], SCHEMA + ", window int")
    assert chat.windows(wide).count() == 1
