"""Streaming forms run over the given tables in several steps: the rows must be those of the batch operators.

Each step adds files and runs the query until they are read, so state lives over restarts as well as over micro-batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import acoustics as A
from ..operators import frames as FR
from ..session import scratch
from ..sources.derive import FRAMES_SQL, frames, read, turn_embeddings, utterances
from ..streaming import processors as P
from .registry import Registry
from .signals import LIVE_SQL, SILENCE, VAD_SQL

registry = Registry()
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STEPS, FILES = 3, 64


def _steps(source: DataFrame, order: str, folder: str) -> Iterator[int]:
    """Append the rows in the order of an expression, a third at a time, each session's rows of a step to one file. The source
    is computed once."""
    source.write.parquet(f"{folder}-all")
    source = source.sparkSession.read.schema(source.schema).parquet(f"{folder}-all")
    at = F.expr(order).cast("double")
    cuts = source.agg(F.percentile_approx(at, [k / STEPS for k in range(1, STEPS)], 1000)).first()[0] or []
    step = sum((F.when(at > c, 1).otherwise(0) for c in cuts), F.lit(0))
    for k in range(STEPS):
        source.filter(step == k).repartition("session_id").write.mode("append").parquet(folder)
        yield k


def _run(source: DataFrame, order: str, start: Callable[[DataFrame, str], object], files: int | None = FILES) -> str:
    """start(stream, folder) -> a started query; run for each step. The folder, in which the query may write."""
    spark = source.sparkSession
    top = scratch(spark, "stream")
    was = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _STORE)
    try:
        for _ in _steps(source, order, f"{top}/in"):
            reader = spark.readStream.schema(source.schema)
            reader = reader.option("maxFilesPerTrigger", files) if files else reader
            start(reader.parquet(f"{top}/in"), top).awaitTermination()
    finally:
        if was is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, was)
    return top


def drained(source: DataFrame, order: str, transform: Callable[[DataFrame], DataFrame], files: int | None = FILES) -> DataFrame:
    """Stream the rows and give back what came out. files: of a trigger; None where event time must not run ahead."""
    schema = []

    def start(stream: DataFrame, top: str):
        made = transform(stream)
        schema[:] = [made.schema]
        return made.writeStream.format("parquet").option("path", f"{top}/out").option("checkpointLocation", f"{top}/state").trigger(availableNow=True).start()

    top = _run(source, order, start, files)
    return source.sparkSession.read.schema(schema[0]).parquet(f"{top}/out")


def _frames(spark, sf_dir):
    return frames(read(spark, sf_dir, "events"))


@registry.add("k1_event_time", f"WITH {FRAMES_SQL}, x AS (SELECT user_id AS session_id, epoch_us(min(ts)::TIMESTAMP) AS t0 FROM events GROUP BY user_id) SELECT session_id, frame_idx, t0 + (frame_idx + 1) * 32000 AS event_us FROM f JOIN x USING (session_id)")
def k1(spark, sf_dir):
    rows = _frames(spark, sf_dir)
    epochs = rows.groupBy("session_id").agg(F.min("ts").alias("epoch"))
    return FR.event_time(rows, epochs).select("session_id", "frame_idx", F.unix_micros("event_ts").alias("event_us"))


@registry.add("k2_stream_vad", f"WITH {VAD_SQL} SELECT session_id, frame_idx, is_speaking, segment_started, segment_ended, segment_no FROM v")
def k2(spark, sf_dir):
    return drained(_frames(spark, sf_dir), "frame_idx", lambda s: P.stream_vad(s, SILENCE)).drop("interim_due")


@registry.add("k6_stream_interim", f"WITH {VAD_SQL}, x AS (SELECT session_id, frame_idx, row_number() OVER (PARTITION BY session_id, segment_no ORDER BY frame_idx) AS n FROM v WHERE is_speaking) SELECT session_id, frame_idx FROM x WHERE n % 4 = 0")
def k6(spark, sf_dir):
    return drained(_frames(spark, sf_dir), "frame_idx", lambda s: P.stream_vad(s, SILENCE, 4)).filter("interim_due").select("session_id", "frame_idx")


_PROSODY = "SELECT session_id, frame_idx, direction AS pitch_direction, round(rel, 6) AS relative_level_db, coalesce(voiced AND rel >= 6 AND abs(change) >= 1.5, false) AS emphasis_candidate FROM p"
#: the same over windows of six frames in place of frames
_WINDOWS_SQL = LIVE_SQL.replace(FRAMES_SQL, FRAMES_SQL.replace("f AS (", "f0 AS (", 1) + """,
f AS (SELECT session_id, frame_idx // 6 AS frame_idx, max_by(voiced, frame_idx) AS voiced, CASE WHEN max_by(voiced, frame_idx) THEN quantile_cont(pitch_hz, 0.5) END AS pitch_hz,
  10 * log10(greatest(avg(pow(10.0, level_dbfs / 10)), 1e-12)) AS level_dbfs FROM f0 GROUP BY ALL HAVING count(*) = 6)""")


@registry.add("k3_stream_live_prosody", f"WITH {LIVE_SQL} {_PROSODY}")
def k3(spark, sf_dir):
    out = drained(_frames(spark, sf_dir), "frame_idx", P.stream_live_prosody)
    return out.select("session_id", "frame_idx", "pitch_direction", F.round("relative_level_db", 6).alias("relative_level_db"), "emphasis_candidate")


@registry.add("k3b_stream_live_windows", f"WITH {_WINDOWS_SQL} {_PROSODY}")
def k3b(spark, sf_dir):
    """Readings of 192 ms: windows of six frames that begin in one step and end in another are whole."""
    out = drained(_frames(spark, sf_dir), "frame_idx", lambda s: P.stream_live_prosody(s, width=6))
    return out.select("session_id", F.floor(F.col("frame_idx") / 6).alias("frame_idx"), "pitch_direction", F.round("relative_level_db", 6).alias("relative_level_db"), "emphasis_candidate")


@registry.add("h7b_live_window_features", f"WITH {_WINDOWS_SQL} {_PROSODY}")
def h7b(spark, sf_dir):
    windows = A.live_windows(_frames(spark, sf_dir)).withColumnsRenamed({"window_idx": "frame_idx", "speech_active": "voiced"})
    return A.live_features(windows).select("session_id", "frame_idx", "pitch_direction", F.round("relative_level_db", 6).alias("relative_level_db"), "emphasis_candidate")


def _turns(spark, sf_dir):
    return turn_embeddings(read(spark, sf_dir, "embeddings")).withColumns({"start_time": F.col("seq") * 0.5, "end_time": F.col("seq") * 0.5 + 6.0})


@registry.add("k4_stream_speakers")
def k4(spark, sf_dir):
    return drained(_turns(spark, sf_dir), "seq % 50", P.stream_speakers).drop("overlapping")


@registry.add("k5_stream_overlap")
def k5(spark, sf_dir):
    return drained(_turns(spark, sf_dir), "seq % 50", P.stream_speakers).select("session_id", "seq", F.array_join(F.transform("overlapping", lambda x: x.cast("string")), "|").alias("overlapping"))


@registry.add("k7_stream_upsert", "SELECT conv_id AS session_id, role AS id, min(turn) AS position, max_by(coalesce(text, ''), turn) AS text, max(turn) AS seq FROM conversations GROUP BY ALL")
def k7(spark, sf_dir):
    captions = utterances(read(spark, sf_dir, "conversations")).select("session_id", F.col("speaker_id").alias("id"), "seq", "text")
    top = _run(captions, "seq", lambda stream, top: P.stream_upsert(stream, f"{top}/out", f"{top}/state"))
    return P.current(spark.read.parquet(f"{top}/out")).select("session_id", "id", "position", "text", "seq")


@registry.add("k8_stream_dedup", f"WITH {FRAMES_SQL} SELECT session_id, frame_idx, event_id FROM f")
def k8(spark, sf_dir):
    rows = _frames(spark, sf_dir)
    twice = rows.unionByName(rows.filter("frame_idx % 3 = 0"))
    return drained(twice, "ts", P.deduplicated, None).select("session_id", "frame_idx", "event_id")


#: sessions that begin anew at every 20th frame
_PIECES_SQL = VAD_SQL.replace(FRAMES_SQL, FRAMES_SQL.replace("f AS (", "f0 AS (", 1) + ", f AS (SELECT * REPLACE (session_id * 1000000 + frame_idx // 20 AS session_id) FROM f0 WHERE frame_idx % 20 <> 19)")


@registry.add("k9_stream_session_end", f"WITH {_PIECES_SQL} SELECT session_id // 1000000 AS session_id, frame_idx, is_speaking, segment_started, segment_ended, segment_no FROM v")
def k9(spark, sf_dir):
    """Each 20th frame ends its session, and the one after begins it anew without any state."""
    rows = _frames(spark, sf_dir).withColumn("control", F.expr("CASE frame_idx % 20 WHEN 19 THEN 'end' WHEN 0 THEN 'start' END"))
    return drained(rows, "frame_idx", lambda s: P.stream_vad(s, SILENCE)).drop("interim_due")


#: one clock for all sessions; a multiple of 192 ms
_EPOCH_US = 8_854_167_000 * 192_000


def _clocked(spark, sf_dir):
    return _frames(spark, sf_dir).withColumn("ts", F.timestamp_micros(F.col("frame_idx") * 32_000 + _EPOCH_US))


@registry.add("k10_stream_live_levels", f"WITH {FRAMES_SQL}, w AS (SELECT session_id, frame_idx // 6 AS window_idx, count(*) AS frames, round(10 * log10(avg(pow(10.0, level_dbfs / 10))), 5) AS level_dbfs FROM f GROUP BY ALL) SELECT * FROM w WHERE (window_idx + 1) * 192 <= (SELECT max(frame_idx) * 32 FROM f)")
def k10(spark, sf_dir):
    """Tumbling windows; those that the watermark hasn't passed at the end aren't given out."""
    out = drained(_clocked(spark, sf_dir), "frame_idx", lambda s: P.stream_live_levels(s, late="0 seconds"), None)
    index = F.expr(f"(unix_micros(window.start) - {_EPOCH_US}L) div 192000")
    return out.select("session_id", index.alias("window_idx"), "frames", F.round("level_dbfs", 5).alias("level_dbfs"))


@registry.add("k10_stream_segments", f"""WITH {FRAMES_SQL}, v0 AS (SELECT *, frame_idx - lag(frame_idx) OVER (PARTITION BY session_id ORDER BY frame_idx) AS gap FROM f WHERE voiced),
v AS (SELECT *, sum(CASE WHEN gap * 32 <= 64 THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY frame_idx) AS no FROM v0), g AS (SELECT session_id, min(frame_idx) AS first_frame, max(frame_idx) AS last_voiced, count(*) AS voiced_frames FROM v GROUP BY session_id, no)
SELECT session_id, first_frame, voiced_frames FROM g WHERE last_voiced * 32 + 72 <= (SELECT max(frame_idx) * 32 FROM v)""")
def k10s(spark, sf_dir):
    """Session windows with a gap of two frames and a quarter."""
    out = drained(_clocked(spark, sf_dir), "frame_idx", lambda s: P.stream_segments(s, gap="72 milliseconds", late="0 seconds"), None)
    return out.select("session_id", F.expr(f"(unix_micros(first_ts) - {_EPOCH_US}L) div 32000").alias("first_frame"), "voiced_frames")
