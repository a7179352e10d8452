"""Every query against its SQL, or for what SQL can't say, against its rules."""

import pytest
from against_sql import assert_same, sql_rows

from speechtable import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, sf_dir, name):
    assert_same(QUERIES[name](spark, sf_dir).toPandas(), sql_rows(sf_dir, SQL[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_without_sql(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_stream_and_batch_speakers_agree(spark, sf_dir):
    batch = {tuple(r) for r in QUERIES["f5_cluster_speakers"](spark, sf_dir).select("session_id", "seq", "speaker_no").collect()}
    stream = {tuple(r) for r in QUERIES["k4_stream_speakers"](spark, sf_dir).select("session_id", "seq", "speaker_no").collect()}
    assert batch == stream


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["session_id", "content"] and df.first()["content"].startswith("WEBVTT\n")
    assert set(entry.oracle_sql()) <= set(entry.queries())
