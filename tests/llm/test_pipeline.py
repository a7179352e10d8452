"""The pipeline's stages on a small table, each against brute force on what came in."""

import brute
import pandas as pd

import corpus_pipeline
from speechtable.llm import simhash


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = pd.read_parquet(f"{sf_dir}/benchmark.parquet")
    labels = pd.read_parquet(f"{sf_dir}/labels.parquet")
    kept = [docs.toPandas()]
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, spark.createDataFrame(kept[-1], docs.schema), sf_dir)
        if name != "source_mixing":
            assert made.columns == docs.columns
        kept.append(made.toPandas())
    raw, good, unlike, clean, safe, mixed = kept
    # quality: what is labelled good stays
    marks = labels.set_index("doc_id").quality
    wanted = {d for d in raw.doc_id if marks.get(d) == 1}
    assert len(wanted - set(good.doc_id)) <= 0.05 * len(wanted)
    # one document of each group
    groups = brute.components([(d, brute.simhash(t)) for d, t in zip(good.doc_id, good.text)])
    assert set(unlike.doc_id) == set(groups.values())
    # no window of the benchmark
    found = brute.decontaminate(zip(unlike.doc_id, unlike.text), zip(items.item_id, items.text))
    assert set(clean.doc_id) == {d for d, w in found.items() if not w[4]}
    # no secret is left, and no document without one is changed
    was = dict(zip(clean.doc_id, clean.text))
    assert set(safe.doc_id) == set(was)
    for d, t, n in zip(safe.doc_id, safe.text, safe.n_chars):
        assert not brute.secret(t) and n == len(t)
        assert brute.secret(was[d]) or t == was[d] or "[SECRET]" in t
    # the mix
    assert (mixed.taken == mixed["copies"] * mixed["size"]).all() and mixed["copies"].between(1, 3).all()
    ran = corpus_pipeline.run(spark, sf_dir).toPandas()
    assert sorted(zip(ran.doc_id, ran.taken)) == sorted(zip(mixed.doc_id, mixed.taken))
    assert simhash.WITHIN == 4
