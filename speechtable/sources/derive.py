"""Utterances, frames and turn embeddings derived from general tables, so that operators can be run on any warehouse.

All derived times are whole milliseconds, so every engine makes the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utterances(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) -> one utterance a turn."""
    s, q = F.col("session_id"), F.col("seq")
    order = Window.partitionBy("session_id").orderBy("seq")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = conversations.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), F.col("role").alias("speaker_id"), F.coalesce("text", F.lit("")).alias("text"))
    df = df.withColumn("n_words", F.size(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9']+)"), 1)).cast("long"))
    df = df.withColumns({"dur_ms": 400 + F.col("n_words") * (200 + 120 * ((s * 7 + q * 3) % 5)), "gap_ms": 410 * ((s * 5 + q * 11) % 6) - 615})
    df = df.withColumn("start_ms", F.sum("dur_ms").over(so_far) - F.col("dur_ms") + F.sum("gap_ms").over(so_far) + 615)
    return df.select(
        "session_id", "seq", "speaker_id", "text", "n_words", "dur_ms", "start_ms",
        (F.col("start_ms") + F.col("dur_ms")).alias("end_ms"),
        (F.col("start_ms") / 1000.0).alias("start_time"),
        ((F.col("start_ms") + F.col("dur_ms")) / 1000.0).alias("end_time"),
        (-30 + (s * 13 + q * 17) % 20 + 0.25).cast("double").alias("rms_db"),
        (110 + (s * 31 + q * 29) % 140).cast("double").alias("mean_pitch_hz"),
        F.concat_ws("-", s.cast("string"), q.cast("string")).alias("id"),
    )


UTTERANCES_SQL = """
u0 AS (SELECT conv_id AS session_id, turn AS seq, role AS speaker_id, coalesce(text, '') AS text,
  len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9'']+'))::BIGINT AS n_words FROM conversations),
u1 AS (SELECT *, 400 + n_words * (200 + 120 * ((session_id * 7 + seq * 3) % 5)) AS dur_ms, 410 * ((session_id * 5 + seq * 11) % 6) - 615 AS gap_ms FROM u0),
u2 AS (SELECT *, (sum(dur_ms) OVER (PARTITION BY session_id ORDER BY seq) - dur_ms + sum(gap_ms) OVER (PARTITION BY session_id ORDER BY seq) + 615)::BIGINT AS start_ms FROM u1),
u AS (SELECT session_id, seq, speaker_id, text, n_words, dur_ms, start_ms, start_ms + dur_ms AS end_ms, start_ms / 1000.0 AS start_time, (start_ms + dur_ms) / 1000.0 AS end_time,
  (-30 + (session_id * 13 + seq * 17) % 20 + 0.25)::DOUBLE AS rms_db, (110 + (session_id * 31 + seq * 29) % 140)::DOUBLE AS mean_pitch_hz,
  session_id || '-' || seq AS id FROM u2)"""


def frames(events: DataFrame) -> DataFrame:
    """events (user_id, ts, event_id, event_type, value) -> one frame an event, numbered within its session."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    df = events.withColumn("frame_idx", (F.row_number().over(order) - 1).cast("long"))
    return df.select(
        F.col("user_id").alias("session_id"), "frame_idx", "event_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").isin("click", "view", "purchase").alias("voiced"),
        F.when(F.col("event_type").isin("click", "view"), (80 + (F.col("event_id") * 37) % 300).cast("double")).alias("pitch_hz"),
        (-60 + F.col("value") / 10).alias("level_dbfs"),
    )


FRAMES_SQL = """
f AS (SELECT user_id AS session_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::BIGINT AS frame_idx, event_id, event_type, value,
  coalesce(event_type IN ('click', 'view', 'purchase'), false) AS voiced,
  CASE WHEN event_type IN ('click', 'view') THEN (80 + (event_id * 37) % 300)::DOUBLE END AS pitch_hz, -60 + value / 10 AS level_dbfs FROM events)"""


def turn_embeddings(embeddings: DataFrame, turns: int = 50) -> DataFrame:
    """embeddings (vec_id, embedding, label) -> session_id, seq, embedding, label; so many turns a session, so a larger table
    has more sessions, not longer ones."""
    return embeddings.select(F.expr(f"vec_id div {turns}").alias("session_id"), F.col("vec_id").alias("seq"), "embedding", "label")


TURNS_SQL = "t AS (SELECT vec_id // 50 AS session_id, vec_id AS seq, embedding, label FROM embeddings)"
