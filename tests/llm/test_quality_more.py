"""Quality classifier: slices of long texts, the sample's bounds, tables without labels."""

import numpy as np
import pytest

from speechtable.llm import quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("size", [1, 5, 40])
def test_slices_give_the_same_features(monkeypatch, size):
    texts = [None, "", "  ", "a", "ab cd", "one two\tthree é ß " * 20, "w" * 300]
    want = [np.sort(np.concatenate([*quality.features(t), np.zeros(0, np.int32)])).tolist() for t in texts]
    monkeypatch.setattr(quality, "SLICE", size)
    assert [np.sort(np.concatenate([*quality.features(t), np.zeros(0, np.int32)])).tolist() for t in texts] == want


def test_long_texts_are_scored_and_passed_over_in_training(spark):
    good, bad = "clear plain prose of some worth ", "xx99 buy!! $$$ click "
    ids = [i for i in range(40) if not _held_out(i)]
    docs = [(i, (good if k % 2 else bad) * 20, None, "s", 0) for k, i in enumerate(ids)]
    docs += [(1000 + k, (good if k % 2 else bad) * 100_000, None, "s", 0) for k in range(8)]  # labelled, but beyond the bound
    frame = spark.createDataFrame(docs, DOCS)
    labels = spark.createDataFrame([(d[0], int(d[1].startswith("clear")), 0) for d in docs] + [(5000 + i, 1, 0) for i in range(500)], "doc_id long, quality int, toxic int")
    model = quality.fit(frame, labels, rows=60, most_bytes=1_000_000)
    assert model[2] == len(ids)  # labels without a document take no place
    got = {r.doc_id: r.score for r in quality.scores(frame, model, ["doc_id"]).collect()}
    assert all((got[d[0]] > 0.5) == d[1].startswith("clear") for d in docs)


def _held_out(i):
    import zlib

    return zlib.crc32(str(i).encode()) % 4 == 2


def test_keep_keeps_all_without_labels(spark):
    frame = spark.createDataFrame([(1, "x", None, "s", 1), (2, None, None, "s", 0)], DOCS)
    labels = spark.createDataFrame([(1, None, 0)], "doc_id long, quality int, toxic int")
    assert quality.keep(frame, labels).count() == 2
