"""Transcripts as text, WebVTT and JSON, and the sinks behind the privacy gate."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..session import remove
from .utterances import with_settings

_ORDER = ("start_time", "created_at", "id")


def _joined(u: DataFrame, line: Column, between: str) -> DataFrame:
    """A session's lines in order as one string. A transcript is one value, so its lines come together by nature."""
    lines = u.select("session_id", F.struct(*_ORDER, line.alias("line")).alias("x")).groupBy("session_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return lines.select("session_id", F.array_join(F.transform("x", lambda x: x["line"]), between).alias("content"))


def export_txt(u: DataFrame) -> DataFrame:
    return _joined(u, C.transcript_line(F.col("start_time"), F.col("label"), F.col("text")), "\n")


def export_vtt(u: DataFrame) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("session_id").orderBy(*_ORDER))
    times = F.concat(C.format_vtt_time(F.col("start_time")), F.lit(" --> "), C.format_vtt_time(F.col("end_time")))
    cue = F.concat(F.col("_n").cast("string"), F.lit("\n"), times, F.lit("\n<v "), F.col("label"), F.lit(">"), F.col("text"), F.lit("\n"))
    return _joined(u.withColumn("_n", n), cue, "\n").withColumn("content", F.concat(F.lit("WEBVTT\n\n"), "content"))


def export_json(u: DataFrame) -> DataFrame:
    """An array of the full rows, nulls kept."""
    rows = u.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct(*_ORDER, F.struct(*u.columns).alias("row")))).alias("x"))
    return rows.select("session_id", F.to_json(F.transform("x", lambda x: x["row"]), {"ignoreNullFields": "false"}).alias("content"))


FORMATS = {"txt": export_txt, "vtt": export_vtt, "json": export_json}


def exported(u: DataFrame, formats: tuple[str, ...] = ("txt", "vtt", "json")) -> DataFrame:
    """format, session_id, content: a row for each session and format; an unknown format means plain text."""
    each = [FORMATS.get(f, export_txt)(u).select(F.lit(f).alias("format"), "session_id", "content") for f in formats]
    return reduce(DataFrame.unionByName, each)


def write_exports(u: DataFrame, path: str, formats: tuple[str, ...] = ("txt", "vtt", "json"), as_table: bool = False) -> None:
    """A folder for each format and session, with its file in it. as_table: Parquet by format instead, for so many sessions
    that a file for each would be too many."""
    if as_table:
        exported(u, formats).write.mode("append").partitionBy("format").parquet(path)
        return
    for f in formats:
        exported(u, (f,)).select("content", "format", "session_id").write.mode("append").partitionBy("format", "session_id").text(path)


def savable(u: DataFrame, settings: DataFrame) -> DataFrame:
    """Final utterances of sessions that may be saved: privacy off and saving on. Sessions without settings may not."""
    return with_settings(u, settings).filter(F.col("is_final") & ~F.col("privacy_mode") & F.col("save_transcript")).select(*u.columns)


def upserted(archive: DataFrame, new: DataFrame) -> DataFrame:
    """Both, of rows with one id the later version."""
    both = archive.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)), allowMissingColumns=True)
    newest = Window.partitionBy("session_id", "id").orderBy(F.col("_v").desc(), F.col("created_at").desc())
    return both.withColumn("_rn", F.row_number().over(newest)).filter("_rn = 1").drop("_rn", "_v")


BUCKETS = 256


def save_utterances(u: DataFrame, settings: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Write what may be saved to a Parquet archive, partitioned by `bucket` (a hash of the session, so that any number of
    sessions makes so many folders); only the buckets of u's sessions are rewritten.

    Each call stages its rows in a folder of its own beside the archive and deletes it at the end. Calls that save the same
    buckets at the same time must follow one another.
    """
    spark = u.sparkSession
    staged = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
    new = savable(u, settings).withColumn("bucket", F.pmod(F.xxhash64(F.col("session_id").cast("string")), F.lit(buckets)).cast("int"))
    try:
        new.write.parquet(f"{staged}/new")
        new = spark.read.schema(new.schema).parquet(f"{staged}/new")
        touched = [r[0] for r in new.select("bucket").distinct().collect()]  # at most `buckets`
        try:
            old = spark.read.option("mergeSchema", "true").parquet(path).filter(F.col("bucket").isin(touched))
        except Exception as e:  # no archive yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            old = None
        merged = new
        if old is not None:
            upserted(old, new).write.parquet(f"{staged}/merged")  # what is rewritten can't be read meanwhile
            merged = spark.read.parquet(f"{staged}/merged")
        merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    finally:
        remove(spark, staged)


def read_transcript(live: DataFrame, archive: DataFrame, session_id=None) -> DataFrame:
    """Sessions in memory as they are, the others from the archive. Ordered by start, creation and id."""
    if session_id is not None:
        live, archive = live.filter(F.col("session_id") == session_id), archive.filter(F.col("session_id") == session_id)
    rest = archive.join(live.select("session_id").distinct(), "session_id", "left_anti")
    both = live.unionByName(rest, allowMissingColumns=True)
    return both.orderBy("session_id", *_ORDER)


def clear_session(rows: DataFrame, cleared: DataFrame) -> DataFrame:
    return rows.join(cleared.select("session_id").distinct(), "session_id", "left_anti")


def evolve_schema(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Missing columns as nulls."""
    return rows.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in rows.columns})


def event_fanout(vad: DataFrame, live: DataFrame, speakers: DataFrame, utterances: DataFrame, metrics: DataFrame) -> DataFrame:
    """One stream of typed events, each (session_id, at, place, type, data); place orders events of one instant."""
    kinds = (("vad_state", vad), ("prosody_state", live), ("speaker_list", speakers), ("utterance", utterances), ("debug_metrics", metrics))
    each = [df.select("session_id", "at", F.lit(i).alias("place"), F.lit(k).alias("type"), F.to_json(F.struct(*(c for c in df.columns if c not in ("session_id", "at")))).alias("data")) for i, (k, df) in enumerate(kinds)]
    out = each[0]
    for e in each[1:]:
        out = out.unionByName(e)
    return out
