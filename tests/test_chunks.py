"""Sessions in chunks: the rows are those of the window forms, whatever the size of a chunk."""

import random

import pytest
from pyspark.sql import functions as F

from speechtable.operators import acoustics as A
from speechtable.operators import chunks as CH
from speechtable.operators import segments as G

COLUMNS = "session_id long, frame_idx long, voiced boolean, pitch_hz double, level_dbfs double"


@pytest.fixture(scope="module")
def frames(spark):
    rng = random.Random(4)
    rows = []
    for session, n, often in ((1, 400, 0.5), (2, 300, 0.03), (3, 1, 1.0), (None, 50, 0.5)):
        on = False
        for i in range(n):
            on = rng.random() < often if rng.random() < 0.3 else on
            rows.append((session, i, on, rng.choice([None, float("nan"), 100.0, 180.0, 240.0]) if on else None, rng.uniform(-70, -10)))
    return spark.createDataFrame(rows, COLUMNS).repartition(3).cache()


def rows(df, *columns):
    shown = df.select("session_id", "frame_idx", *(F.round(c, 9).alias(c) if dict(df.dtypes)[c] == "double" else c for c in columns))
    return sorted(repr(tuple(r)) for r in shown.collect())  # NaN is like NaN


@pytest.mark.parametrize("size", [1, 7, CH.SIZE])
def test_segments(frames, size):
    own, whole = CH.vad_state(frames, 3, size), G.vad_state(frames, 3)
    columns = ("voiced", "last_voiced", "is_speaking", "segment_started", "segment_ended", "segment_no")
    assert rows(own, *columns) == rows(whole, *columns)
    assert rows(CH.speech_duration(own, size), "speech_duration_s") == rows(G.speech_duration(whole), "speech_duration_s")
    assert rows(CH.interim_checkpoints(own, 0.128, size), "segment_no", "collected") == rows(G.interim_checkpoints(whole, 0.128), "segment_no", "collected")


@pytest.mark.parametrize("size", [5, 64])
def test_live_features(frames, size):
    columns = ("pitch_direction", "pitch_change", "relative_level_db", "emphasis_candidate")
    assert rows(CH.live_features(frames, size), *columns) == rows(A.live_features(frames), *columns)


@pytest.mark.parametrize("size", [3, 50])
@pytest.mark.parametrize("stat", ["avg", "median"])
def test_baselines_by_speaker(frames, size, stat):
    own = frames.withColumn("speaker_id", F.expr("frame_idx * 7 % 3")).withColumn("level_dbfs", F.when(F.col("voiced"), F.col("level_dbfs")))
    how = {"value": "level_dbfs", "out": "b", "keys": ["session_id", "speaker_id"], "n": 4, "stat": stat, "order": "frame_idx"}
    assert rows(CH.rolling_baseline(own, size=size, **how), "b") == rows(A.rolling_baseline(own, **how), "b")


def test_no_frames(frames):
    assert CH.vad_state(frames.filter("false"), 3, 8).count() == 0


def test_a_long_session_is_many_tasks(spark):
    """Nothing but summaries of chunks is ordered by session."""
    frames = spark.range(200_000).select(F.lit(1).alias("session_id"), F.col("id").alias("frame_idx"), (F.col("id") % 50 < 20).alias("voiced"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        made = CH.vad_state(frames, 13, 1000)
        held = made.groupBy(F.spark_partition_id()).count().collect()
        assert len(held) >= int(spark.conf.get("spark.sql.shuffle.partitions")) and sum(r["count"] for r in held) == 200_000
        assert made.agg(F.max("segment_no")).first()[0] == 4000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
