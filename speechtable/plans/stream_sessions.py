"""Streams whose state is kept by name: speakers and their baselines, sessions that end by the watermark, frames to captions in
one query, and state read as a table. Rows come in three steps with restarts, as in `streams`."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import diarizers as D
from ..sources.derive import FRAMES_SQL, read, turn_embeddings
from ..streaming import sessions as SS
from .registry import Registry
from .streams import _EPOCH_US, _clocked, _run, drained

registry = Registry()
#: turns of a session, so that a speaker has more than a baseline holds
TURNS = 250
#: a session ends when nothing came for so long
IDLE_MS = 320

_HEARD_SQL = f"""t AS (SELECT vec_id // {TURNS} AS session_id, vec_id AS seq, label AS channel, -30 + (vec_id * 17) % 20 + 0.25 AS rms_db, (40 + (vec_id * 29) % 140)::DOUBLE AS mean_pitch_hz FROM embeddings),
n0 AS (SELECT *, min(seq) OVER (PARTITION BY session_id, channel) AS first_seq FROM t), n AS (SELECT *, dense_rank() OVER (PARTITION BY session_id ORDER BY first_seq) AS speaker_no FROM n0)"""


def heard(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = F.col("seq")
    return turn_embeddings(read(spark, sf_dir, "embeddings"), TURNS).withColumns({
        "channel": F.col("label").cast("double"), "ts": F.timestamp_millis(seq * 500), "start_time": seq * 0.5, "end_time": seq * 0.5 + 6.0,
        "rms_db": (-30 + (seq * 17) % 20 + 0.25).cast("double"), "mean_pitch_hz": (40 + (seq * 29) % 140).cast("double"),
    })


@registry.add("l2_diarizer_plug", f"WITH {_HEARD_SQL} SELECT session_id, seq, speaker_no FROM n")
def l2(spark, sf_dir):
    """A user's diarizer, in batch: one speaker a channel."""
    return D.diarize(heard(spark, sf_dir), D.Channel, ("channel",)).select("session_id", "seq", "speaker_no")


@registry.add("l2b_diarizer_at_most")
def l2b(spark, sf_dir):
    """The greedy one with at most three speakers a session."""
    return D.diarize(heard(spark, sf_dir), partial(D.Greedy, most=3))


@registry.add("k4b_stream_baselines", f"""WITH {_HEARD_SQL}, q AS (SELECT *, coalesce(count(*) FILTER (mean_pitch_hz > 50) OVER (PARTITION BY session_id, channel ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n)
SELECT session_id, seq, speaker_no, round(coalesce(avg(rms_db) OVER (PARTITION BY session_id, channel ORDER BY seq ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), -24.0), 6) AS rms_baseline,
  quantile_cont(CASE WHEN mean_pitch_hz > 50 THEN mean_pitch_hz END, 0.5) OVER (PARTITION BY session_id, channel ORDER BY before RANGE BETWEEN 20 PRECEDING AND 1 PRECEDING) AS pitch_baseline FROM q""")
def k4b(spark, sf_dir):
    """Each speaker's level and pitch over the last 20 turns, out of the stream's map state."""
    out = drained(heard(spark, sf_dir), f"seq % {TURNS}", lambda s: SS.stream_diarized(s, D.Channel, ("channel",)))
    return out.select("session_id", "seq", "speaker_no", F.round("rms_baseline", 6).alias("rms_baseline"), "pitch_baseline")


@registry.add("a11b_state_snapshot", f"""WITH {_HEARD_SQL} SELECT session_id, speaker_no, count(*) AS count, least(20, count(*)) AS levels, least(20, count(*) FILTER (mean_pitch_hz > 50)) AS pitches FROM n GROUP BY ALL""")
def a11b(spark, sf_dir):
    """The speakers that a query holds when it stops, read from its state."""
    def start(stream: DataFrame, top: str):
        made = SS.stream_diarized(stream, D.Channel, ("channel",))
        return made.writeStream.format("parquet").option("path", f"{top}/out").option("checkpointLocation", f"{top}/state").trigger(availableNow=True).start()

    top = _run(heard(spark, sf_dir), f"seq % {TURNS}", start)
    return SS.speaker_snapshot(spark, f"{top}/state")


@registry.add("k9b_stream_idle_end", f"""WITH {FRAMES_SQL}, s AS (SELECT session_id, count(*) AS frames, count(*) FILTER (voiced) AS voiced_frames, max(frame_idx) AS last_frame FROM f GROUP BY session_id)
SELECT * FROM s WHERE last_frame * 32 + {IDLE_MS} <= (SELECT max(frame_idx) * 32 FROM f)""")
def k9b(spark, sf_dir):
    """All sessions begin at once; those that end before the longest one has gone on for ten frames more are closed."""
    out = drained(_clocked(spark, sf_dir), "frame_idx", lambda s: SS.stream_idle_end(s, IDLE_MS), None)
    return out.select("session_id", "frames", "voiced_frames", "last_frame")


def with_vectors(frames: DataFrame) -> DataFrame:
    """frames with a vector each, made of what they say."""
    n = F.col("event_id")
    return frames.withColumn("vector", F.array(F.col("value") / 500, (n * 37 % 101) / 101 - 0.5, (n * 53 % 97) / 97 - 0.5, F.when(F.col("event_type") == "click", 1.0).otherwise(-0.2)))


#: silent frames that close a segment: two, as these sessions are short
SILENCE = 2


@registry.add("k12_stream_captions")
def k12(spark, sf_dir):
    """From frames to captions in one streaming query."""
    rows = with_vectors(_clocked(spark, sf_dir))
    out = drained(rows, "frame_idx", lambda s: SS.stream_captions(s, partial(D.Greedy, threshold=0.9), SILENCE), None)
    return out.withColumn("closed_frame", F.expr(f"(unix_micros(ts) - {_EPOCH_US}L) div 32000")).drop("ts")
