"""Speakers: embeddings, greedy clustering, and the speaker dimension."""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C

THRESHOLD, THRESHOLD_FALLBACK = 0.25, 0.85


def embed(clips: DataFrame, fn, sample_rate: int = 16000, dims: int = 192) -> DataFrame:
    """clips (..., samples) with embedding added: fn(float32 samples, rate) of at least 350 ms, made a unit vector. A clip
    on which fn fails gets the acoustic embedding."""
    from ..functions.kernels import mfcc_embedding

    @F.pandas_udf("array<double>")
    def run(samples: pd.Series) -> pd.Series:
        out = []
        for s in samples:
            x = np.asarray(s if s is not None else [], np.float32)
            short = int(0.35 * sample_rate) - len(x)
            x = np.pad(x, (0, short)) if short > 0 else x
            try:
                v = np.asarray(fn(x, sample_rate), float)
            except Exception:  # a model that fails on a clip must not end the job
                v = mfcc_embedding(x, sample_rate)
            out.append((v / (np.linalg.norm(v) + 1e-8)).tolist())
        return pd.Series(out)

    return clips.withColumn("embedding", run("samples"))


def speaker_centroids(turns: DataFrame) -> DataFrame:
    """turns (session_id, speaker_id, embedding) -> unit mean of each speaker; means are summed before the shuffle."""
    each = turns.select("session_id", "speaker_id", F.posexplode("embedding").alias("i", "x"))
    mean = each.groupBy("session_id", "speaker_id", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    vector = mean.groupBy("session_id", "speaker_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("mean"))
    return vector.select("session_id", "speaker_id", C.l2_normalize(F.col("mean")).alias("centroid"))


def nearest_speaker(turns: DataFrame, centroids: DataFrame) -> DataFrame:
    """turns with the most similar registered speaker of their session: speaker_id and similarity. Of equal ones the first
    registered (reg_idx) wins. Only speakers of the turn's own session are compared."""
    c = centroids.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("reg_idx", "speaker_id", "centroid"))).alias("known"))
    scored = turns.join(c, "session_id", "left").withColumn("_s", F.transform("known", lambda k: F.struct(C.dot(F.col("embedding"), k["centroid"]).alias("similarity"), (-k["reg_idx"]).alias("first"), k["speaker_id"].alias("speaker_id"))))
    best = F.array_max("_s")
    return scored.withColumn("speaker_id", best["speaker_id"]).withColumn("similarity", best["similarity"]).drop("known", "_s")


def cluster_speakers(turns: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """turns (session_id, seq, embedding) -> session_id, seq, speaker_no, similarity, confidence: greedy, in order of seq. The
    result depends on the order, so a session is worked on in one place; what is kept meanwhile is its speakers, not its turns."""
    from .diarizers import Greedy, diarize

    return diarize(turns, partial(Greedy, threshold))


def assign_labels(turns: DataFrame) -> DataFrame:
    """turns (session_id, seq, speaker_id) with number by first appearance, label and colour."""
    first = F.min("seq").over(Window.partitionBy("session_id", "speaker_id"))
    numbered = turns.withColumn("_first", first).withColumn("speaker_no", F.dense_rank().over(Window.partitionBy("session_id").orderBy("_first")).cast("long")).drop("_first")
    return numbered.withColumns({"label": C.speaker_label(F.col("speaker_no")), "color_index": (F.col("speaker_no") - 1) % 8})


def speaker_dimension(turns: DataFrame) -> DataFrame:
    """turns (session_id, seq, speaker_id, end_time) -> a row a speaker: label, colour, statistics, active flag."""
    stats = turns.groupBy("session_id", "speaker_id").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("total_utterances"), F.max_by("end_time", "seq").alias("last_heard_time"))
    session = Window.partitionBy("session_id")
    no = F.row_number().over(session.orderBy("first_seq")).cast("long")
    out = stats.withColumn("speaker_no", no).withColumn("is_active", F.col("last_seq") == F.max("last_seq").over(session))
    return out.select("session_id", "speaker_id", "speaker_no", C.speaker_label(F.col("speaker_no")).alias("label"), ((F.col("speaker_no") - 1) % 8).alias("color_index"), "total_utterances", "last_heard_time", "is_active")


def active_speaker(turns: DataFrame) -> DataFrame:
    return turns.groupBy("session_id").agg(F.max_by("speaker_id", "seq").alias("speaker_id"))


def rename_speakers(speakers: DataFrame, renames: DataFrame) -> DataFrame:
    """Latest rename of a speaker wins; white space around goes, a blank name clears, a null one and unknown speakers change
    nothing."""
    last = renames.filter("new_name is not null").groupBy("session_id", "speaker_id").agg(F.max_by(F.struct(F.trim("new_name").alias("name")), "seq").alias("r"))
    joined = speakers.join(last, ["session_id", "speaker_id"], "left")
    name = F.nullif(F.col("r.name"), F.lit(""))
    return joined.withColumn("custom_name", name).withColumn("display_name", C.display_name(F.col("label"), F.col("custom_name"))).drop("r")


def unknown_renames(speakers: DataFrame, renames: DataFrame) -> DataFrame:
    return renames.join(speakers.select("session_id", "speaker_id"), ["session_id", "speaker_id"], "left_anti")


def relabel_history(utterances: DataFrame, speakers: DataFrame) -> DataFrame:
    """Utterances with the current display name of their speaker."""
    now = speakers.select("session_id", "speaker_id", F.col("display_name").alias("_now"))
    return utterances.join(now, ["session_id", "speaker_id"], "left").withColumn("label", F.coalesce("_now", "label")).drop("_now")


def turn_similarity(pairs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """pairs (left, right: unit vectors) with similarity and split."""
    return pairs.withColumn("similarity", C.dot(F.col("left"), F.col("right"))).withColumn("split", F.col("similarity") < threshold)
