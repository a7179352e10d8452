"""Quality, latency and robustness reports: plain aggregations, summed before the shuffle."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.kernels import edit_distance

UNHEARD = "[Speech detected]"


def recognized(text: Column) -> Column:
    return F.coalesce((F.trim(text) != "") & (text != UNHEARD), F.lit(False))


def session_summary(log: DataFrame) -> DataFrame:
    """log (session_id, type, is_final, text, speaker_id, direction) -> counts of each session."""
    utt = F.col("type") == "utterance"
    final = utt & F.col("is_final")
    return log.groupBy("session_id").agg(
        F.count_if(final).alias("final_captions"), F.count_if(utt & ~F.col("is_final")).alias("interim_captions"),
        F.count_if(final & recognized(F.col("text"))).alias("recognized_captions"), F.count_if(F.col("type") == "vad_state").alias("vad_rows"),
        F.count_if(F.col("type") == "prosody_state").alias("live_rows"), F.count_distinct(F.when(final, F.col("speaker_id"))).alias("speakers"),
        F.count_if(final & F.col("direction").isNull()).alias("directionless"),
    )


def latency_stats(metrics: DataFrame, value: str = "pipeline_processing_ms", by: list[str] | None = None) -> DataFrame:
    return metrics.groupBy(*(by or [])).agg(F.count(value).alias("n"), F.round(F.percentile(value, F.lit(0.5)), 2).alias("median_ms"), F.round(F.max(value), 2).alias("max_ms"))


def latency_sketches(metrics: DataFrame, value: str = "pipeline_processing_ms", by: list[str] | None = None, k: int = 800) -> DataFrame:
    """by, n, max_ms, sketch: a KLL sketch of each group's values (about 10 kB, rank error below 1 % for k = 800), to be kept and
    merged into coarser groups. Sketches are built before the shuffle, so a group of all values is no task's burden."""
    return metrics.groupBy(*(by or [])).agg(F.count(value).alias("n"), F.max(value).alias("max_ms"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("sketch"))


def merged_latency(sketches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """latency_sketches' rows -> by, n, median_ms, p95_ms, max_ms of coarser groups."""
    own = sketches.groupBy(*(by or [])).agg(F.sum("n").alias("n"), F.max("max_ms").alias("max_ms"), F.kll_merge_agg_double("sketch").alias("sketch"))
    at = lambda q: F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(q)))
    return own.select(*(by or []), "n", at(0.5).alias("median_ms"), at(0.95).alias("p95_ms"), "max_ms")


def pipeline_metrics(stages: DataFrame) -> DataFrame:
    """stages (session_id, segment_id, stage, ms, speaker_id) -> time of each stage and in all for each segment."""
    ms = lambda s: F.coalesce(F.sum(F.when(F.col("stage") == s, F.col("ms"))), F.lit(0.0))
    return stages.groupBy("session_id", "segment_id").agg(*(ms(s).alias(f"{s}_latency_ms") for s in ("vad", "asr", "diarization", "prosody")), F.sum("ms").alias("pipeline_processing_ms"), F.count_distinct("speaker_id").alias("active_speakers_count"))


def exclude_simulated(metrics: DataFrame) -> DataFrame:
    return metrics.filter(~F.coalesce(F.col("simulated"), F.lit(False)))


def turn_transitions(u: DataFrame) -> DataFrame:
    prev = F.lag("speaker_id").over(Window.partitionBy("session_id").orderBy("seq"))
    return u.withColumn("_t", (prev != F.col("speaker_id"))).groupBy("session_id").agg(F.count_if("_t").alias("transitions"))


def question_intonation(u: DataFrame) -> DataFrame:
    asks = F.col("text").contains("?")
    return u.groupBy("session_id").agg(F.count_if(asks).alias("questions"), F.count_if(asks & F.col("rising_intonation")).alias("rising_questions")).withColumn("rising_share", F.when(F.col("questions") > 0, F.col("rising_questions") / F.col("questions")))


def speaker_turn_counts(u: DataFrame) -> DataFrame:
    return u.groupBy("session_id", "speaker_id").agg(F.count("*").alias("turns"))


def realtime_factor(timed: DataFrame) -> DataFrame:
    """timed (session_id, processing_ms, audio_ms) -> seconds of work for a second of audio."""
    return timed.groupBy("session_id").agg((F.sum("processing_ms") / F.sum("audio_ms")).alias("realtime_factor"))


def domain_checks(u: DataFrame, min_speakers: int = 2, min_transitions: int = 3) -> DataFrame:
    rates = F.bool_and(F.col("speech_rate").isin("slow", "normal", "fast")).alias("rates_ok")
    volumes = F.bool_and(F.col("relative_volume").isin("quiet", "normal", "loud")).alias("volumes_ok")
    own = u.groupBy("session_id").agg(rates, volumes, F.count_distinct("speaker_id").alias("speakers")).join(turn_transitions(u), "session_id")
    return own.withColumn("passed", F.col("rates_ok") & F.col("volumes_ok") & (F.col("speakers") >= min_speakers) & (F.col("transitions") >= min_transitions))


def token_edit_rate(reference: Column, candidate: Column) -> Column:
    """Edits between two token arrays for each token of the first, 3 places; null where it is empty or either is null."""

    @F.pandas_udf("long")
    def edits(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else edit_distance(list(x), list(y)) for x, y in zip(a, b)], dtype="Int64")

    return F.when(F.size(reference) > 0, F.round(edits(reference, candidate) / F.size(reference), 3))


def condition_report(runs: DataFrame) -> DataFrame:
    """runs (clip_id, condition, captions, recognized, text) -> each condition against the same clip's clean run."""
    clean = runs.filter("condition = 'clean'").select("clip_id", F.col("text").alias("_clean"))
    joined = runs.join(clean, "clip_id")
    return joined.select("clip_id", "condition", "captions", "recognized", token_edit_rate(C.tokenize(F.col("_clean")), C.tokenize(F.col("text"))).alias("token_edit_rate"))


def privacy_audit(archive: DataFrame, settings: DataFrame) -> DataFrame:
    """Rows in the archive of sessions in privacy mode, by session: there should be none."""
    private = settings.filter("privacy_mode").select("session_id")
    return archive.join(private, "session_id", "left_semi").groupBy("session_id").agg(F.count("*").alias("rows"))


def event_log_checks(log: DataFrame) -> DataFrame:
    """log (session_id, type, is_final, speaker_id, overlap, cue, simulated, speaker_names, renamed_to) -> checklist."""
    utt = F.col("type") == "utterance"
    no = lambda c: F.coalesce(c, F.lit(False))
    return log.groupBy("session_id").agg(
        (F.count_distinct(F.when(utt & F.col("is_final"), F.col("speaker_id"))) >= 3).alias("three_speakers"),
        F.bool_or(no(utt & F.col("overlap"))).alias("overlap_seen"), F.bool_or(no(utt & F.col("cue"))).alias("cue_seen"),
        F.bool_and(F.when(F.col("type") == "debug_metrics", no(F.col("simulated"))).otherwise(True)).alias("metrics_flagged"),
        F.bool_or(no((F.col("type") == "speaker_list") & F.array_contains("speaker_names", F.col("renamed_to")))).alias("rename_seen"),
    )


def speaker_word_share(u: DataFrame) -> DataFrame:
    """Talk time and words by speaker, with totals by session and of all."""
    return u.rollup("session_id", "speaker_id").agg(F.sum("dur_ms").alias("talk_ms"), F.sum("n_words").alias("words"), F.count("*").alias("turns"))
