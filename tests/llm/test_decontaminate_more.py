"""Decontamination with larger benchmarks, and its plan."""

import random

import brute
import pytest

from speechtable.llm import decontaminate

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("set_limit", [500_000, 100])
def test_large_benchmark_and_long_text(spark, set_limit):
    rng = random.Random(3)
    text = lambda n: " ".join(f"w{rng.randint(0, 5000)}" for _ in range(n))
    items = [(f"i{k % 350}", text(rng.choice([4, 9, 60, 90]))) for k in range(400)] + [("i,7", "w1 w2 w3")]
    docs = [text(30) for _ in range(40)]
    docs += [text(5) + " " + " ".join(t.split()[k % 40 : k % 40 + 14]) + " " + text(5) for k, (_, t) in enumerate(items)]
    docs.append(" ".join([text(200_000), items[3][1], text(1000), items[9][1]]))
    assert len(docs[-1]) > 1_000_000
    df = spark.createDataFrame([(i % 430, t, None, "s", 0) for i, t in enumerate(docs)], DOCS).repartition(8)
    want = sorted((i % 430, *brute.decontaminate([(i, t)], items)[i]) for i, t in enumerate(docs))
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = decontaminate.report(df, bench, set_limit=set_limit).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, brute.sha(",".join(r["items"])), r.contaminated) for r in got) == want
    assert decontaminate.remove(df, bench, set_limit=set_limit).count() == sum(not w[-1] for w in want)


def test_no_row_holds_a_set_and_no_text_is_shuffled(spark, sf_dir):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    for made in (decontaminate.query(spark, sf_dir), decontaminate.remove(docs, bench), decontaminate.remove(docs, bench, "spans")):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "AS _dc_s" not in plan and "AS _dc_held" not in plan
        outside = plan.split("Subquery")[0]
        assert "Exchange" not in outside and "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("set_limit", [500_000, 1])
def test_a_passage_that_many_items_and_documents_share(spark, set_limit):
    """The hits of one document don't bring along the items of each."""
    shared = " ".join(f"legal{i}" for i in range(30))
    items = [(k, shared if k % 3 else f"{shared} own{k}") for k in range(1200)] + [(5000, "another " * 12)]
    docs = [f"w{k} {shared} v{k}" for k in range(300)] + [f"w{k}" for k in range(20)] + [shared * 1 + (" " + shared) * 400]
    df = spark.createDataFrame([(i, t, None, "s", 0) for i, t in enumerate(docs)], DOCS).repartition(6)
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert decontaminate.item_sets(decontaminate.benchmark_windows(bench)).count() < 450
    got = {r.doc_id: r for r in decontaminate.report(df, bench, set_limit=set_limit).collect()}
    every = sorted(str(k) for k in range(1200))
    for i, t in enumerate(docs):
        hit = "legal0" in t
        words = len(t.split())
        assert (got[i].n_words, got[i].n_items, got[i]["items"]) == (words, 1200 if hit else 0, every if hit else [])
        assert got[i].n_hit == (0 if not hit else words - 2 if i < 300 else words)


@pytest.mark.parametrize("most", [0, 16_000_000])
def test_hot_keys_keep_all_rows(spark, monkeypatch, most):
    from speechtable.llm import common
    from speechtable.llm.common import with_key

    monkeypatch.setattr(common, "HOT_BYTES", most)

    rows = spark.createDataFrame([(1 if k % 2 else k, k) for k in range(9000)] + [(None, -1)] * 2000, "key long, n_row long").repartition(5)
    own = spark.createDataFrame([(k, f"v{k}") for k in range(1, 6000)], "key long, value string")
    from pyspark.sql import functions as F

    met = with_key(rows, own, "key", rows.groupBy("key").agg(F.count("*").alias("n")))
    got = sorted(((r.key, r.n_row, r.value) for r in met.collect()), key=repr)
    want = [(k, i, f"v{k}" if k is not None and 1 <= k < 6000 else None) for k, i in [(1 if k % 2 else k, k) for k in range(9000)] + [(None, -1)] * 2000]
    assert got == sorted(want, key=repr)
