"""Substring dedup where hashes of words collide, and where the map of repeated anchors is full."""

import random

import brute
import numpy as np

from speechtable.llm import recompress

DOCS = "doc_id long, text string"


def colliding():
    """Two words of 2,048 letters whose polynomials modulo 2^64 agree for any odd multiplier."""
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    return a, b


def removed(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), DOCS).repartition(3)
    return {r.doc_id: (r.n_words, r.n_removed, brute.sha(r.kept or "")) for r in recompress.removals(df).collect()}


def test_words_that_share_a_name_are_not_repeats(spark):
    a, b = colliding()
    names = recompress.word_names(f"{a} {b}".encode())
    assert a != b and names[0] == names[1]  # the names alone don't tell
    rest = [f"w{i}" for i in range(25)]
    texts = [" ".join([*rest[:11], a, *rest[11:]]), " ".join([*rest[:11], b, *rest[11:]]), " ".join([*rest[:11], a, *rest[11:]])]
    texts += [" ".join([b, *["x"] * 30, a, *["x"] * 30])]
    got = removed(spark, texts)
    assert got == brute.substring_dedup(enumerate(texts)) and got[1][1] == 0 and got[2][1] == 26


def test_white_space_is_no_part_of_a_window(spark):
    words = [f"w{i}" for i in range(30)]
    texts = [" ".join(words), "\n\n".join(words) + "\t ", " \x0b\x0c".join(words), "w0w1 " + " ".join(words[2:]), " ".join(w + " " for w in words)]
    assert removed(spark, texts) == brute.substring_dedup(enumerate(texts))


def test_digests_are_of_the_words(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["a", "bb", "ccc", "é"]) for _ in range(rng.randint(0, 60))) for _ in range(20)] + [None, ""]
    w = recompress.Words(texts)
    at = np.flatnonzero(w.starts)
    h, g = w.digests(at)
    seen = {}
    for i, (x, y) in zip(at.tolist(), zip(h.tolist(), g.tolist())):
        own = (texts[w.doc[i]] or "").split()
        k = i - int(w.begins[w.doc[i]])
        assert seen.setdefault((x, y), own[k : k + 20]) == own[k : k + 20]
    assert len(at) == sum(max(0, len((t or "").split()) - 19) for t in texts)


def test_a_full_map_lets_all_windows_pass(spark, monkeypatch):
    monkeypatch.setattr(recompress, "MAP_BITS_LEAST", 64)
    monkeypatch.setattr(recompress, "MAP_BITS_MOST", 64)
    texts = [" ".join(f"w{i}" for i in range(k, k + 70)) for k in range(0, 2000, 35)]
    found = recompress.anchors(spark.createDataFrame(list(enumerate(texts)), DOCS))
    assert recompress.shared_map(found) is None
    assert removed(spark, texts) == brute.substring_dedup(enumerate(texts))
