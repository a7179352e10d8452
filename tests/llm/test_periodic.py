"""Periodic runs against brute force over all periods."""

import random
import zlib
from collections import Counter

import brute
import numpy as np
import pandas as pd
import pytest

from speechtable.llm import periodic


def runs(words):
    """(start, length, period) of each run, a period at a time."""
    number = {}
    t = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    found = {}
    for q in range(1, len(t) // 4 + 1):
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (t[:-q] == t[q:]).astype(np.int8), [0])))).reshape(-1, 2).tolist()
        for a, b in edges:
            if b - a + q >= max(6, 4 * q):
                found.setdefault((a, b + q), q)
    return sorted(((a, b - a, q) for (a, b), q in found.items()), key=lambda r: (r[0], r[2]))


def row(doc_id, text):
    words = (text or "").split()
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and words:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = runs(words)
    gone = {i for start, length, q in found for i in range(start + q, start + length)}
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
    milli = 1000 * best[1] // best[2] if found else None
    lines = "".join(f"{a},{b},{c}\n" for a, b, c in found)
    return (doc_id, len(found), *best, milli, brute.sha(lines), brute.sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def rows_of(df):
    return Counter(tuple(None if pd.isna(v) else v if isinstance(v, str) else int(v) for v in r) for r in df.itertuples(index=False))


def test_random_words():
    rng = random.Random(5)
    for _ in range(600):
        docs = []
        for _ in range(rng.randint(1, 4)):
            words = []
            for _ in range(rng.randint(0, 6)):
                words += [rng.choice("abcdefg"[: rng.choice([1, 2, 3, 5])]).encode() for _ in range(rng.randint(1, 5))] * rng.randint(1, 7)
            docs.append(words)
        assert periodic.found(docs) == [runs(w) for w in docs]


@pytest.mark.parametrize("words", [["a"] * 3000, ["a", "b"] * 1500, ["a"] * 7 + ["b"] * 6 + ["a"] * 7, [str(i % 499) for i in range(4000)], ["x", *["a", "a", "b"] * 400, "x"] * 4])
def test_shapes(words):
    raw = [w.encode() for w in words]
    assert periodic.found([raw]) == [runs(raw)]


def test_small_batches_of_pairs(monkeypatch):
    monkeypatch.setattr(periodic, "PAIRS", 5)
    words = [w.encode() for w in ["a", "b", "a", "b"] * 9 + ["c"] * 9]
    assert periodic.found([words]) == [runs(words)]


def test_query_on_whole_table(spark, sf_dir):
    docs = pd.read_parquet(f"{sf_dir}/documents.parquet")
    got = periodic.query(spark, sf_dir).toPandas()
    assert rows_of(got) == Counter(row(i, t) for i, t in zip(docs.doc_id.tolist(), docs.text.tolist()))
    assert (got.n_runs > 0).sum() > 10


def test_awkward_rows(spark, tmp_path):
    rng = random.Random(1)
    very_long = " ".join(rng.choice("ab") for _ in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "ja " * 9), (4, "ja " * 9), (None, "no " * 6), (None, None), (5, very_long), (6, "é ß\n" * 4), (7, "5 times is not enough 5 times")]
    df = spark.createDataFrame([(*r, "mine", 1) for r in rows], "doc_id long, text string, runs string, n_words int")
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    assert rows_of(periodic.query(spark, str(tmp_path)).toPandas()) == Counter(row(*r) for r in rows)
    assert periodic.query(spark, str(tmp_path)).columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    df.filter("false").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert periodic.query(spark, f"{tmp_path}/none").count() == 0


def test_collapse_keeps_other_texts_as_they_are(spark):
    df = spark.createDataFrame([(1, "two  spaces\n", 12, "x"), (2, "b a a a a a a c", 15, None), (3, None, None, "y")], "doc_id long, text string, n_chars int, runs string")
    got = periodic.collapse(df)
    assert got.schema == df.schema
    assert {tuple(r) for r in got.collect()} == {(1, "two  spaces\n", 12, "x"), (2, "b a c", 5, None), (3, None, None, "y")}
