"""Transcription tables and the partition of segments into turns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C

#: segments that are Python objects at once
ROWS = 64
WORD = "struct<word:string,start:double,end:double,probability:double>"


def transcribe(segments: DataFrame, fn: Callable | None, least_s: float = 0.25, sample_rate: int = 16000) -> DataFrame:
    """segments (..., samples) with text, words and mean_logprob by a user's fn(samples, rate) -> (text, words, logprob).

    Short segments get an empty text without asking fn, a failing fn leaves an empty text and the row, and without a fn
    the text says so.
    """
    schema = f"text string, words array<{WORD}>, mean_logprob double"

    @F.pandas_udf(schema)
    def run(samples: pd.Series) -> pd.DataFrame:
        rows = []
        for s in samples:
            x = np.asarray(s if s is not None else [], np.float32)
            if len(x) < least_s * sample_rate:
                rows.append(("", [], None))
            elif fn is None:
                rows.append(("[ASR engine unavailable]", [], None))
            else:
                try:
                    text, words, logprob = fn(x, sample_rate)
                    rows.append((text.strip(), [dict(w) for w in words], logprob))
                except Exception:  # a model that fails on a segment must not end the job
                    rows.append(("", [], None))
        return pd.DataFrame(rows, columns=["text", "words", "mean_logprob"])

    return segments.withColumn("_x", run("samples")).select(*segments.columns, "_x.*")


def explode_words(asr: DataFrame) -> DataFrame:
    """asr (session_id, segment_id, words) -> a row a word; segments without words keep one row of nulls."""
    each = asr.select("session_id", "segment_id", F.posexplode_outer("words").alias("word_idx", "w"))
    return each.select("session_id", "segment_id", "word_idx", F.trim("w.word").alias("word"), "w.start", "w.end", "w.probability")


def turn_candidates(words: DataFrame, gap_s: float = 0.2, side_s: float = 0.35) -> DataFrame:
    """words (session_id, segment_id, word_idx, word, start, end, segment_s) -> possible boundaries after a word: at the end
    of a sentence or before a pause, with at least side_s of audio on both sides."""
    nxt = F.lead("start").over(Window.partitionBy("session_id", "segment_id").orderBy("word_idx"))
    own = words.withColumn("_next", nxt).filter(F.col("_next").isNotNull() & (F.col("word").rlike(r"[?.!]$") | (F.col("_next") - F.col("end") >= gap_s)))
    split = own.withColumn("split_t", (F.col("end") + F.col("_next")) / 2)
    return split.filter((F.col("split_t") >= side_s) & (F.col("segment_s") - F.col("split_t") >= side_s)).select("session_id", "segment_id", "word_idx", "split_t")


def rebase_words(words, split_t):
    """Word times after a split: less split_t, not below zero."""
    moved = lambda x: F.greatest(F.lit(0.0), x - split_t)
    return F.transform(words, lambda w: F.struct(w["word"].alias("word"), moved(w["start"]).alias("start"), moved(w["end"]).alias("end"), w["probability"].alias("probability")))


TURN = f"session_id long, segment_id long, turn_idx int, start_time double, end_time double, text string, words array<{WORD}>"


def partition_turns(segments: DataFrame, embed_fn: Callable | None, threshold: float = 0.25, sample_rate: int = 16000, gap_s: float = 0.2, side_s: float = 0.35) -> DataFrame:
    """segments (session_id, segment_id, start_time, end_time, text, samples, words) -> TURN.

    The first boundary at which the embeddings of both sides are less alike than threshold splits the segment, and the
    right side is looked at again. Segments of fewer than four words or less than a second, and all without embed_fn, are
    one turn. A segment is one row, so this needs no grouping.
    """

    def pieces(x: np.ndarray, words: list[dict], start: float, end: float) -> list[tuple]:
        out = []
        while True:
            cut = None
            if embed_fn is not None and len(words) >= 4 and len(x) >= sample_rate:
                for i in range(len(words) - 1):
                    if not (words[i]["word"].strip().endswith(("?", ".", "!")) or words[i + 1]["start"] - words[i]["end"] >= gap_s):
                        continue
                    t = (words[i]["end"] + words[i + 1]["start"]) / 2
                    at = int(t * sample_rate)
                    if t < side_s or len(x) / sample_rate - t < side_s:
                        continue
                    if float(np.dot(embed_fn(x[:at], sample_rate), embed_fn(x[at:], sample_rate))) < threshold:
                        cut = (i, t, at)
                        break
            if cut is None:
                out.append((start, end, words))
                return out
            i, t, at = cut
            out.append((start, start + t, words[: i + 1]))
            words = [w | {"start": max(0.0, w["start"] - t), "end": max(0.0, w["end"] - t)} for w in words[i + 1 :]]
            x, start = x[at:], start + t

    names = ["session_id", "segment_id", "turn_idx", "start_time", "end_time", "text", "words"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.string(), pa.list_(pa.struct([("word", pa.string()), ("start", pa.float64()), ("end", pa.float64()), ("probability", pa.float64())]))]

    def turned(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        ids = (batch.column(c).to_pylist() for c in ("session_id", "segment_id", "start_time", "end_time", "text", "words"))
        for session, segment, start, end, text, words, samples in zip(*ids, batch.column("samples")):
            x = np.asarray(samples.values, np.float32) if samples.is_valid else np.zeros(0, np.float32)
            turns = pieces(x, words or [], start, end)
            for k, (a, b, own) in enumerate(turns):
                said = " ".join(w["word"].strip() for w in own).strip() if len(turns) > 1 or own else text
                out.append((session, segment, k, a, b, said, own))
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):  # as Python objects, words are many times their bytes
                yield turned(batch.slice(at, ROWS))

    return segments.select("session_id", "segment_id", "start_time", "end_time", "text", "samples", "words").mapInArrow(run, TURN)


def turn_text(words):
    return F.trim(F.array_join(F.transform(words, lambda w: w["word"]), " "))


def segment_text(parts: DataFrame) -> DataFrame:
    """parts (session_id, segment_id, part_idx, text, logprob) -> text and confidence of each segment."""
    own = parts.groupBy("session_id", "segment_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("part_idx", "text"))), lambda x: x["text"]).alias("parts"), F.avg("logprob").alias("logprob"))
    return own.select("session_id", "segment_id", C.assemble_text(F.col("parts")).alias("text"), C.asr_confidence(F.col("logprob")).alias("confidence"))
