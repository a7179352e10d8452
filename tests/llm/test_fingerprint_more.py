"""Document fingerprints: terms by slices, the query's search against brute force, hot blocks, rows without an id."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from speechtable.llm import fingerprint


def plain(text):
    """The docstring's rule, a term at a time."""
    from collections import Counter

    names = [int(fingerprint.word_names(w)[0]) for w in (text or "").encode().lower().split()]
    pair = lambda a, b: int(fingerprint.mixed(np.array([a], np.uint64) * fingerprint._A + np.uint64(b))[0])
    counts = Counter(names) + Counter(pair(a, b) for a, b in zip(names, names[1:]))
    votes = np.zeros(128)
    for t, n in counts.items():
        h = b"".join(fingerprint.mixed(np.array([t], np.uint64) * fingerprint._C + np.uint64(k)).tobytes() for k in (0, 1))
        votes += np.sqrt(n) * (2.0 * np.unpackbits(np.frombuffer(h, np.uint8), bitorder="little") - 1)
    return np.packbits(votes > 1e-9, bitorder="little").tobytes() if names else bytes(16)


def test_fingerprint_follows_its_rule(sf_dir):
    texts = [None, "", "a", "A b a B", "é ß x x x", *pd.read_parquet(f"{sf_dir}/documents.parquet").text.head(40)]
    for t in texts:
        got, want = fingerprint.fingerprint(t), plain(t)
        # sums that are zero but for rounding may fall on either side
        assert np.bitwise_count(np.frombuffer(got, np.uint8) ^ np.frombuffer(want, np.uint8)).sum() <= 1, t


@pytest.mark.parametrize("size", [1, 2, 5, 64])
def test_slices_do_not_change_fingerprints(monkeypatch, size):
    texts = ["a", "a b", "x y z x y z w " * 9, "é " * 30]
    want = [fingerprint.fingerprint(t) for t in texts]
    monkeypatch.setattr(fingerprint, "SLICE", size)
    assert [fingerprint.fingerprint(t) for t in texts] == want


def test_long_text():
    t = " ".join(f"word{i % 4099}" for i in range(2_000_000 // 8))
    assert fingerprint.fingerprint(t) == fingerprint.fingerprint(t.upper()) != bytes(16)


def test_query_counts_neighbours(spark, sf_dir):
    got = fingerprint.query(spark, sf_dir).toPandas()
    docs = pd.read_parquet(f"{sf_dir}/documents.parquet").sort_values("doc_id")
    assert sorted(got.doc_id) == sorted(docs.doc_id)
    fps = np.array([list(fingerprint.fingerprint(t)) for t in docs.text], np.uint8)
    own = got.set_index("doc_id").n_within
    for i, d in enumerate(docs.doc_id):
        if d % 20:
            assert np.isnan(own[d])
        else:
            assert own[d] == (np.bitwise_count(fps ^ fps[i]).sum(1) <= fingerprint.WITHIN).sum()


def test_hot_blocks_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "HOT_BLOCK", 7)
    rng = np.random.default_rng(4)
    base = rng.integers(0, 256, 16, np.uint8)
    rows = np.stack([base] * 300)
    for r in rows:
        for k in rng.choice(128, rng.integers(0, 4), replace=False):
            r[k // 8] ^= 1 << (k % 8)
    fps = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(rows)], "id long, fp binary")
    queries = fps.filter("id % 20 = 0").withColumnRenamed("id", "query")
    got = {(r["query"], r["id"]) for r in fingerprint.search(fps, queries, 3).collect()}
    assert got == {(q, int(i)) for q in range(0, 300, 20) for i in np.flatnonzero(np.bitwise_count(rows ^ rows[q]).sum(1) <= 3)}
    counts = {bytes(r.fp): r.n_within for r in fingerprint.count_within(fps, queries, 3).collect()}
    assert all(counts[rows[q].tobytes()] == (np.bitwise_count(rows ^ rows[q]).sum(1) <= 3).sum() for q in range(0, 300, 20))


def test_rows_without_an_id_follow_each_other_by_text(spark):
    rng = random.Random(2)
    texts = [f"text {rng.random()}" for _ in range(200)]
    df = spark.createDataFrame([(None, t) for t in texts] + [(5, "five a b c"), (9, "nine")], "doc_id long, text string")
    got = fingerprint.edited(df.repartition(6)).collect()
    assert len(got) == 202
    hashed = df.filter("doc_id is null").select("text", F.xxhash64("text").alias("h")).orderBy("h").collect()
    order = ["nine", "five a b c", *(r.text for r in hashed)]
    want = set()
    for i, t in enumerate(order):
        nxt = order[(i + 1) % len(order)]
        want.add(t[: len(t) - len(t) // 3] + nxt[: len(t) // 3])
    import hashlib

    assert {r.edited_sha256 for r in got} == {hashlib.sha256(t.encode()).hexdigest() for t in want}
