"""Queries on one very long session: all of `events` as the frames of one recording, worked on chunk by chunk, with the
numbers of frames and rows that are in force by default (13 silent frames, 38 a checkpoint, baselines of 20)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunks as CH
from ..operators import segments as G
from ..operators import utterances as U
from ..sources.derive import FRAMES_SQL, read
from ..streaming import processors as P
from .registry import Registry
from .signals import LIVE_SQL, vad_sql
from .streams import drained

registry = Registry()
#: frames in a chunk; small, so that small tables have many
SIZE = 256

#: stretches of 40 frames of which some are voiced, and of 20 without speech
LONG_SQL = """
f AS (SELECT 1::BIGINT AS session_id, event_id AS frame_idx, event_type AS speaker_id, value, coalesce(event_type IN ('click', 'view', 'purchase'), false) AND event_id // 20 % 3 <> 1 AS voiced,
  CASE WHEN event_type IN ('click', 'view') AND event_id // 20 % 3 <> 1 THEN (80 + (event_id * 37) % 300)::DOUBLE END AS pitch_hz, -60 + value / 10 AS level_dbfs FROM events)"""
_VAD = vad_sql(LONG_SQL, G.MIN_SILENCE)


def recording(spark: SparkSession, sf_dir: str) -> DataFrame:
    heard = F.expr("event_id div 20 % 3 <> 1")
    return read(spark, sf_dir, "events").select(
        F.lit(1).cast("long").alias("session_id"), F.col("event_id").alias("frame_idx"), F.col("event_type").alias("speaker_id"), "value",
        (F.coalesce(F.col("event_type").isin("click", "view", "purchase"), F.lit(False)) & heard).alias("voiced"),
        F.when(F.col("event_type").isin("click", "view") & heard, (80 + (F.col("event_id") * 37) % 300).cast("double")).alias("pitch_hz"),
        (-60 + F.col("value") / 10).alias("level_dbfs"),
    )


def vad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CH.vad_state(recording(spark, sf_dir).select("session_id", "frame_idx", "voiced"), size=SIZE)


@registry.add("c2b_chunked_vad_state", f"WITH {_VAD} SELECT session_id, frame_idx, is_speaking, segment_started, segment_ended, segment_no FROM v")
def c2b(spark, sf_dir):
    return vad(spark, sf_dir).select("session_id", "frame_idx", "is_speaking", "segment_started", "segment_ended", "segment_no")


@registry.add("c3b_chunked_segments", f"WITH {_VAD} SELECT * FROM g")
def c3b(spark, sf_dir):
    return G.speech_segments(vad(spark, sf_dir))


@registry.add("c6b_chunked_speech_duration", f"WITH {_VAD} SELECT session_id, frame_idx, round(CASE WHEN is_speaking THEN sum(voiced::INT) OVER (PARTITION BY session_id, segment_no ORDER BY frame_idx) * 512 / 16000.0 ELSE 0 END, 6)::DOUBLE AS speech_duration_s FROM v")
def c6b(spark, sf_dir):
    return CH.speech_duration(vad(spark, sf_dir), SIZE).select("session_id", "frame_idx", F.round("speech_duration_s", 6).alias("speech_duration_s"))


@registry.add("c8b_chunked_interim_checkpoints", f"WITH {_VAD}, x AS (SELECT session_id, segment_no, frame_idx, row_number() OVER (PARTITION BY session_id, segment_no ORDER BY frame_idx) AS collected FROM v WHERE is_speaking) SELECT * FROM x WHERE collected % 38 = 0")
def c8b(spark, sf_dir):
    return CH.interim_checkpoints(vad(spark, sf_dir), size=SIZE)


@registry.add("h5b_chunked_live_features", f"WITH {LIVE_SQL.replace(FRAMES_SQL, LONG_SQL)} SELECT session_id, frame_idx, direction AS pitch_direction, round(change, 6) AS pitch_change, round(rel, 6) AS relative_level_db FROM p")
def h5b(spark, sf_dir):
    own = CH.live_features(recording(spark, sf_dir), SIZE)
    return own.select("session_id", "frame_idx", "pitch_direction", F.round("pitch_change", 6).alias("pitch_change"), F.round("relative_level_db", 6).alias("relative_level_db"))


@registry.add("g8b_chunked_level_baseline", f"""WITH {LONG_SQL}, v AS (SELECT *, CASE WHEN voiced THEN level_dbfs END AS r FROM f),
c AS (SELECT *, coalesce(count(r) OVER (PARTITION BY speaker_id ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM v)
SELECT session_id, frame_idx, round(coalesce(avg(r) OVER (PARTITION BY speaker_id ORDER BY n RANGE BETWEEN 20 PRECEDING AND 1 PRECEDING), -24.0), 6) AS level_baseline FROM c""")
def g8b(spark, sf_dir):
    rows = recording(spark, sf_dir).withColumn("r", F.when(F.col("voiced"), F.col("level_dbfs")))
    own = CH.rolling_baseline(rows, "r", "b", ["session_id", "speaker_id"], order="frame_idx", size=SIZE, default=-24.0)
    return own.select("session_id", "frame_idx", F.round("b", 6).alias("level_baseline"))


@registry.add("k2b_stream_long_vad", f"WITH {_VAD} SELECT session_id, frame_idx, is_speaking, segment_started, segment_ended, segment_no FROM v")
def k2b(spark, sf_dir):
    """The same recording as a stream, in three steps with restarts."""
    own = recording(spark, sf_dir).select("session_id", "frame_idx", "voiced")
    return drained(own, "frame_idx", lambda s: P.stream_vad(s)).drop("interim_due")


@registry.add("k6b_stream_long_interim", f"WITH {_VAD}, x AS (SELECT session_id, frame_idx, row_number() OVER (PARTITION BY session_id, segment_no ORDER BY frame_idx) AS n FROM v WHERE is_speaking) SELECT session_id, frame_idx FROM x WHERE n % 38 = 0")
def k6b(spark, sf_dir):
    own = recording(spark, sf_dir).select("session_id", "frame_idx", "voiced")
    return drained(own, "frame_idx", lambda s: P.stream_vad(s)).filter("interim_due").select("session_id", "frame_idx")


@registry.add("i3b_recent_utterances", "SELECT role AS session_id, conv_id * 1000 + turn AS seq FROM conversations QUALIFY row_number() OVER (PARTITION BY role ORDER BY conv_id * 1000 + turn DESC) <= 50")
def i3b(spark, sf_dir):
    """All turns of a role as one session: its last 50."""
    own = read(spark, sf_dir, "conversations").select(F.col("role").alias("session_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"))
    return U.recent_utterances(own)
