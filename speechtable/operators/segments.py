"""Speech segmentation: sessions of frames with hysteresis.

A segment starts at the first voiced frame and is closed by the frame with which `min_silence` silent ones in a row are
reached; all voiced frames in between reset the count. It covers its first voiced frame up to the last voiced one and the
silent frames after it but for the closing one. An open tail is never given out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

THRESHOLD, MIN_SILENCE, FRAME, RATE = 0.45, 13, 512, 16000


def _order() -> Window:
    return Window.partitionBy("session_id").orderBy("frame_idx")


def voiced(prob: Column, threshold: float = THRESHOLD) -> Column:
    return prob >= threshold


def vad_state(frames: DataFrame, min_silence: int = MIN_SILENCE) -> DataFrame:
    """frames (session_id, frame_idx, voiced) with is_speaking, segment_started, segment_ended, segment_no."""
    so_far = _order().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(F.col("voiced"), F.col("frame_idx")), True).over(so_far)
    before = F.last(F.when(F.col("voiced"), F.col("frame_idx")), True).over(_order().rowsBetween(Window.unboundedPreceding, -1))
    df = frames.withColumns({"last_voiced": last, "_before": before})
    run = F.col("frame_idx") - F.col("last_voiced")
    df = df.withColumns({
        "is_speaking": F.coalesce(run < min_silence, F.lit(False)),
        "segment_ended": F.coalesce(run == min_silence, F.lit(False)),
        "segment_started": F.coalesce(F.col("voiced") & (F.col("_before").isNull() | (F.col("frame_idx") - F.col("_before") > min_silence)), F.lit(False)),
    })
    return df.withColumn("segment_no", F.sum(F.col("segment_started").cast("long")).over(so_far)).drop("_before")


def speech_segments(vad: DataFrame, min_silence: int = MIN_SILENCE) -> DataFrame:
    """vad_state -> a row a closed segment: first and last frame, the frame that closed it, voiced frames."""
    own = vad.filter("segment_no > 0").groupBy("session_id", "segment_no").agg(
        F.min(F.when(F.col("voiced"), F.col("frame_idx"))).alias("first_frame"), F.max(F.when(F.col("voiced"), F.col("frame_idx"))).alias("last_voiced"),
        F.max("frame_idx").alias("last_seen"), F.sum(F.col("voiced").cast("long")).alias("voiced_frames"),
    )
    closed = own.filter(F.col("last_seen") >= F.col("last_voiced") + min_silence)
    return closed.select("session_id", "segment_no", "first_frame", (F.col("last_voiced") + min_silence - 1).alias("last_frame"), (F.col("last_voiced") + min_silence).alias("end_frame"), "voiced_frames")


def min_segment_filter(segments: DataFrame, samples: int = 4800) -> DataFrame:
    return segments.filter((F.col("last_frame") - F.col("first_frame") + 1) * FRAME > samples)


def segment_bounds(segments: DataFrame, pre_roll_s: float = 0.15) -> DataFrame:
    """Times from frame ends; the start is moved forward by the pre-roll, not below zero."""
    at = lambda c: (F.col(c) + 1) * FRAME / float(RATE)
    return segments.withColumns({"start_time": F.greatest(F.lit(0.0), at("first_frame") - pre_roll_s), "end_time": at("end_frame")})


def speech_duration(vad: DataFrame) -> DataFrame:
    """Voiced seconds so far in the segment; held in the hangover, zero outside."""
    so_far = Window.partitionBy("session_id", "segment_no").orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seconds = F.sum(F.col("voiced").cast("long")).over(so_far) * FRAME / float(RATE)
    return vad.withColumn("speech_duration_s", F.when(F.col("is_speaking"), seconds).otherwise(0.0))


def pause_duration(vad: DataFrame) -> DataFrame:
    """Seconds since the last voiced frame, null before the first."""
    return vad.withColumn("pause_duration_s", (F.col("frame_idx") - F.col("last_voiced")) * FRAME / float(RATE))


def interim_checkpoints(vad: DataFrame, every_s: float = 1.2) -> DataFrame:
    """The frames of a segment at which a partial transcript is due: every k-th frame collected, hangover included."""
    k = -(-int(every_s * RATE) // FRAME)
    collected = F.row_number().over(Window.partitionBy("session_id", "segment_no").orderBy("frame_idx"))
    own = vad.filter("is_speaking").withColumn("collected", collected)
    return own.filter(F.col("collected") % k == 0).select("session_id", "segment_no", "frame_idx", F.col("collected").cast("long").alias("collected"))
