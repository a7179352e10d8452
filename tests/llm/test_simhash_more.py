"""SimHash on long texts, in dense buckets, and joins on hot keys."""

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from speechtable.llm import common, components, simhash


@pytest.mark.parametrize("size", [1, 7, 64, 10**6])
def test_slices_do_not_change_fingerprints(monkeypatch, size):
    monkeypatch.setattr(simhash, "SLICE", size)
    for t in [None, "", " ", "a", "a b c", "a b c d", "A b\tC  d e\n", " x" * 9, "\x0b lead é word ß İ trail \x0c", "long " * 50 + "w" * 200 + " end"]:
        assert simhash.fingerprint(t) == brute.simhash(t), t


def test_very_long_text():
    t = " ".join(f"word{i % 977}" for i in range(400_000))
    assert len(t) > 2_500_000 and simhash.fingerprint(t) == brute.simhash(t)


@pytest.mark.parametrize("how", [{"block": 25}, {"block": 25, "pair_from": 0}])
def test_dense_buckets_are_cut_into_blocks(spark, how):
    rng = np.random.default_rng(8)
    base = int(rng.integers(0, 2**62))
    near = {base ^ sum(1 << int(k) for k in rng.choice(62, 3, replace=False)) for _ in range(400)}  # over ten blocks around one
    far = {int(x) for x in rng.integers(0, 2**62, 200)}
    fps = sorted(near | far)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    found = simhash.links(df, **how)
    assert all(f.a != f.b for f in found.collect())
    roots = {r.v: r.root for r in components.connected(found).collect()}
    assert {f: roots.get(f, f) for f in fps} == brute.components([(f, f) for f in fps])


def test_join_on_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT", 8)
    rows = spark.range(1000).select(F.when(F.col("id") < 400, 7).when(F.col("id") < 410, F.lit(None)).otherwise(F.col("id") % 90).alias("k"), "id")
    own = spark.createDataFrame([(k, f"v{k}") for k in range(80)], "k long, v string")
    counts = rows.groupBy("k").agg(F.count("*").alias("n"))
    made = common.with_key(rows.select(F.col("k").cast("long").alias("k"), "id"), own, "k", counts)
    want = rows.join(own, "k", "left").select("k", "id", "v")
    assert sorted(map(tuple, made.select("k", "id", "v").collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    none = rows.filter("false")
    assert common.with_key(none, own, "k", counts.filter("false")).count() == 0
