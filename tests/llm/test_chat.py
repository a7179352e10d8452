"""Chat formatting: exact round trips, conversations cut between tasks, awkward rows."""

import random

import pandas as pd
import pyarrow as pa
import pytest
from against_sql import assert_same, sql_rows

from speechtable.llm import chat

BITS = ["<", "|", ">", "s>", "/s>", "\\", "[", "INST]", "/INST]", "a", "é", "😀", "</s>", "[INST]", "<|", "\n", "|>\n", "\x00", ""]
SCHEMA = "conv_id long, turn long, role string, text string, part string, whole int, loss string"


def told(rows):
    """conv_id -> [(role, text)] in order."""
    out = {}
    for i, _, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0)):
        out.setdefault(i, []).append((role or "", text or ""))
    return out


def pieces(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r.part):
        out.setdefault(r.conv_id, []).append(r)
    return out


def test_round_trip_of_random_turns(monkeypatch):
    monkeypatch.setattr(chat, "SCATTER", 7)
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice(BITS) for _ in range(rng.randint(0, n)))
    for _ in range(1500):
        rows = [(word(3) if rng.random() < 0.5 else rng.choice(["user", "assistant", None]), None if rng.random() < 0.1 else word(8)) for _ in range(rng.randint(1, 5))]
        ids = sorted(rng.randint(0, 2) for _ in rows)
        got = chat._assembled(pa.array(ids), pa.array([r for r, _ in rows], pa.string()), pa.array([t for _, t in rows], pa.string()), ("assistant",))
        want = told((i, k, *r) for k, (i, r) in enumerate(zip(ids, rows)))
        assert got["conv_id"].to_pylist() == list(want)
        for own, n, text, loss in zip(want.values(), *(got[k].to_pylist() for k in ("n_turns", "formatted", "loss"))):
            assert list(chat.read_back(text)) == own and n == len(own)
            assert chat.masked(text, loss) == "".join(t for r, t in own if r == "assistant")
            assert not any(c in text[x["start"] : x["end"]] for x in loss for c in ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]"))


@pytest.mark.parametrize("size", [chat.SLICE, 40])
def test_conversations_cut_between_tasks(spark, sf_dir, monkeypatch, size):
    monkeypatch.setattr(chat, "SLICE", size)
    rng = random.Random(2)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), k, rng.choice(["user", "assistant"]), rng.choice(BITS) * rng.randint(0, 4)) for k in range(300)]
    got = pieces(chat.format_chats(spark.createDataFrame([(*r, "mine", 1, "mine") for r in rows], SCHEMA)))
    want = told(rows)
    assert {i: [x for r in own for x in chat.read_back(r.formatted)] for i, own in got.items()} == want
    assert {i: "".join(chat.masked(r.formatted, r.loss) for r in own) for i, own in got.items()} == {i: "".join(t for r, t in own if r == "assistant") for i, own in want.items()}
    assert len(got[1]) > 1 and not any(r.whole for r in got[1])
    assert all(len(own) == 1 for own in got.values() if own[0].whole)


def test_whole_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    got = pieces(chat.format_chats(rows))
    want = told(tuple(r) for r in rows.select("conv_id", "turn", "role", "text").collect())
    assert {i: [x for r in own for x in chat.read_back(r.formatted)] for i, own in got.items()} == want
    assert sum(own[0].whole for own in got.values()) > len(got) / 2


def test_awkward_rows(spark, tmp_path):
    very_long = "</s>[INST] é \\" * 60_000
    rows = [(1, 0, "user", None), (1, 2, None, "x"), (1, 9, "assistant", ""), (2, None, "assistant", "first"), (2, 0, "user", "second"), (None, 0, "assistant", very_long), (3, 0, "", ""), (-7, 5, "tool", "more")]
    for name, own in (("all", rows), ("none", rows[:0])):
        spark.createDataFrame([(*r, "mine", 1, "mine") for r in own], SCHEMA).write.parquet(f"{tmp_path}/{name}/conversations.parquet")
        got = chat.query(spark, f"{tmp_path}/{name}")
        assert_same(got.toPandas(), sql_rows(f"{tmp_path}/{name}", chat.SQL.replace("ORDER BY turn", "ORDER BY turn NULLS FIRST")))
    assert pd.Series(got.columns).tolist() == ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    assert got.first().n_turns == 2


def test_rows_that_share_a_turn(spark):
    rows = [(1, 0, "user", "same")] * 3 + [(1, 0, "assistant", "other")]
    made = [pieces(chat.format_chats(spark.createDataFrame(rows * 2, "conv_id long, turn long, role string, text string").repartition(n))) for n in (1, 3)]
    told = [[x for r in own[1] for x in chat.read_back(r.formatted)] for own in made]
    assert told[0] == told[1] and sorted(told[0]) == sorted([r[2:] for r in rows] * 2)
