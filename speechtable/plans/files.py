"""Queries on files that are first written from the tables: WAV recordings, a log of packets, scripts; and on models that a
user plugs in."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import frames as FR
from ..operators import speakers as S
from ..operators import words as W
from ..session import scratch
from ..sources import packets, readers, wav
from ..sources.derive import FRAMES_SQL, UTTERANCES_SQL, frames, read, utterances
from .registry import Registry
from .signals import _SAMPLE_SQL, SAMPLES_SQL, N, samples, tone

registry = Registry()


# -- recordings: a file a session, 64 samples an event, at 1 kHz ----------------------------------------------------
RATE, START, END = 1000, 1.0, 3.0
#: events of a task that writes recordings: 15 MB of samples, which Arrow may hand to Python at once
WRITTEN = 30_000


def recordings(spark: SparkSession, sf_dir: str) -> str:
    """Write them and give the folder. Sessions are dealt out by the number of events, and get their samples last."""
    events = read(spark, sf_dir, "events")
    tasks = max(4 * spark.sparkContext.defaultParallelism, -(-events.count() // WRITTEN))
    rows = frames(events.repartition(tasks, "user_id")).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("frame_idx", "event_id"))).alias("f"))
    folder = scratch(spark, "recordings")
    wav.register(spark)
    rows.select(F.col("session_id").cast("string").alias("name"), F.lit(RATE).alias("rate"), F.flatten(F.transform("f", lambda y: tone(y["event_id"]))).alias("samples")).write.format("wav").mode("append").save(folder)
    return folder


@registry.add("a2_read_wav_clips", f"""WITH {FRAMES_SQL}, s AS (SELECT session_id, frame_idx * {N} + i AS pos, {_SAMPLE_SQL} AS x FROM f, range({N}) AS t(i))
SELECT session_id, count(*) AS n, round(sum(round(x * 32768) / 32768), 3) AS total FROM s WHERE pos >= {int(START * RATE)} AND pos < {int(END * RATE)} GROUP BY session_id""")
def a2(spark, sf_dir):
    """Two seconds of each file, read in pieces of 1,000 bytes."""
    clips = readers.read_wav_clips(spark, recordings(spark, sf_dir), START, END, RATE, block=1000)
    name = F.regexp_extract("path", r"(\d+)\.wav$", 1).cast("long")
    return clips.select(name.alias("session_id"), F.size("samples").cast("long").alias("n"), F.round(F.aggregate("samples", F.lit(0.0), lambda a, v: a + v.cast("double")), 3).alias("total"))


# -- packets --------------------------------------------------------------------------------------------------------
def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event a message: bytes or JSON, numbered by event; some of odd length."""
    raw = F.encode(F.repeat(F.lit("x"), F.when(F.col("event_id") % 4 == 1, 3).otherwise(2 + F.col("event_id") % 3 * 2).cast("int")), "UTF-8")
    even = F.col("event_id") % 2 == 0
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("packet_seq"), F.when(even, raw).alias("payload"), F.when(~even, F.to_json(F.struct(F.base64(raw).alias("pcm16_base64")))).alias("json"))


@registry.add("a1b_stream_packets", "SELECT user_id AS session_id, event_id AS packet_seq, repeat('x', (2 + event_id % 3 * 2)::INT) AS payload FROM events WHERE event_id % 4 <> 1")
def a1b(spark, sf_dir):
    """The log grows while no query runs, twice; each time the query goes on where it stopped."""
    packets.register(spark)
    rows, top = messages(spark, sf_dir), scratch(spark, "packets")
    last = rows.agg(F.max("packet_seq")).first()[0]
    cuts = [-1, *(last * k // 3 for k in (1, 2)), last] if last is not None else []
    for a, b in zip(cuts, cuts[1:]):
        rows.filter((F.col("packet_seq") > a) & (F.col("packet_seq") <= b)).repartitionByRange(4, "packet_seq").write.format("packet_log").mode("append").save(f"{top}/log")
        heard = readers.read_pcm_packets(spark.readStream.format("packet_log").load(f"{top}/log"))
        heard.writeStream.format("parquet").option("path", f"{top}/out").option("checkpointLocation", f"{top}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("session_id long, packet_seq long, payload binary").parquet(f"{top}/out").withColumn("payload", F.decode("payload", "UTF-8")) if cuts else readers.read_pcm_packets(rows).withColumn("payload", F.decode("payload", "UTF-8"))


# -- scripts --------------------------------------------------------------------------------------------------------
@registry.add("a3_read_conversation_json", "SELECT role AS speaker_id, coalesce(text, '') AS text, CASE WHEN turn % 3 = 0 THEN 1500 ELSE 100 * turn END AS delay_ms, coalesce(turn % 2 = 1, false) AS overlap, CASE WHEN turn % 2 = 1 THEN 1 ELSE 0 END AS others FROM conversations")
def a3(spark, sf_dir):
    """A script a conversation, as a JSON array in a file of its own; what a row doesn't say has its default."""
    turn = F.col("turn")
    row = F.struct(
        F.when(turn % 3 != 0, turn * 100).alias("delay_ms"), F.col("role").alias("speaker_id"), F.coalesce("text", F.lit("")).alias("text"),
        F.when(turn % 2 == 1, F.lit(True)).alias("overlap"), F.when(turn % 2 == 1, F.array(F.lit("Speaker Z"))).alias("overlapping_speakers"),
    )
    scripts = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("turn", row.alias("r")))), lambda x: x["r"])).alias("value"))
    folder = scratch(spark, "scripts")
    scripts.select("value").write.option("maxRecordsPerFile", 1).text(folder)
    return readers.read_conversation_json(spark, folder).select("speaker_id", "text", "delay_ms", "overlap", F.size("overlapping_speakers").alias("others"))


# -- models that a user plugs in ------------------------------------------------------------------------------------
_EXACT_SQL = f"{SAMPLES_SQL}, e AS (SELECT event_id, [round(v * 1000) / 1024 FOR v IN x] AS x FROM s)"


def exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples that are floats without rounding."""
    return samples(spark, sf_dir).select("event_id", F.transform("x", lambda v: F.round(v * 1000) / 1024).cast("array<float>").alias("samples"))


def _moments(x: np.ndarray, rate: int) -> np.ndarray:
    """Stands for a voice model."""
    x = x.astype(float)
    return np.array([x.sum(), (x * x).sum(), 1.0])


@registry.add("f1_embed", f"WITH {_EXACT_SQL}, m AS (SELECT event_id, list_sum(x) AS a, list_sum([v::DOUBLE * v FOR v IN x]) AS b FROM e) SELECT event_id, round(a / sqrt(a * a + b * b + 1), 5) AS first, round(b / sqrt(a * a + b * b + 1), 5) AS second FROM m")
def f1(spark, sf_dir):
    made = S.embed(exact(spark, sf_dir), _moments)
    return made.select("event_id", F.round(F.get("embedding", F.lit(0)), 5).alias("first"), F.round(F.get("embedding", F.lit(1)), 5).alias("second"))


def _likely(x: np.ndarray) -> float:
    """Stands for a speech model; it fails on some frames."""
    total = float(x.astype(float).sum())
    if total > 8:
        raise ValueError("too loud")
    return 1 / (1 + np.exp(-total))


@registry.add("l5_vad_model", f"""WITH {_EXACT_SQL}, m AS (SELECT event_id, list_sum(x) AS a, list_sum([v::DOUBLE * v FOR v IN x]) / 512 AS ms FROM e)
SELECT event_id, round(CASE WHEN a > 8 THEN 1 / (1 + exp(-(20 * log10(sqrt(ms + 1e-12) + 1e-12) + 38.0) / 5.0)) ELSE 1 / (1 + exp(-a)) END, 4) AS speech_prob FROM m""")
def l5(spark, sf_dir):
    made = FR.speech_prob(exact(spark, sf_dir), _likely)
    return made.select("event_id", F.round("speech_prob", 4).alias("speech_prob"))


def _counted(x: np.ndarray, rate: int) -> tuple[str, list[dict], float]:
    """Stands for an engine: what it hears are the length and the level."""
    words = [{"word": w, "start": 0.1 * i, "end": 0.1 * i + 0.1, "probability": 0.5} for i, w in enumerate(("heard", str(len(x)), str(round(float(x[0]) * 100))))]
    return " ".join(w["word"] for w in words), words, -0.5


@registry.add("d1b_transcribe_engine", """WITH g AS (SELECT user_id || '-' || event_type AS clip_id, 3900 + count(*) * 37 % 300 AS n, user_id % 97 AS level FROM events GROUP BY user_id, event_type)
SELECT clip_id, CASE WHEN n < 4000 THEN '' ELSE 'heard ' || n || ' ' || level END AS text, CASE WHEN n < 4000 THEN 0 ELSE 3 END AS words FROM g""")
def d1b(spark, sf_dir):
    n = read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg((3900 + F.count("*") * 37 % 300).cast("int").alias("n"))
    clips = n.select(F.concat_ws("-", "user_id", "event_type").alias("clip_id"), F.array_repeat((F.col("user_id") % 97 / 100).cast("float"), F.col("n")).alias("samples"))
    return W.transcribe(clips, _counted).select("clip_id", "text", F.size("words").alias("words"))


def _side(x: np.ndarray, rate: int) -> np.ndarray:
    """Stands for a voice model: one axis for a voice that begins above zero, the other for one below."""
    return np.array([1.0, 0.0]) if x[0] > 0 else np.array([0.0, 1.0])


@registry.add("e3b_partition_words_of_turns", f"""WITH {UTTERANCES_SQL}, k AS (SELECT session_id, seq, regexp_extract_all(lower(text), '[a-z0-9'']+') AS k FROM u),
w AS (SELECT session_id, seq, len(k) AS n, i, k[i + 1] AS word, ascii(k[i + 1]) % 2 AS voice FROM k, LATERAL (SELECT unnest(range(len(k))) AS i)),
c AS (SELECT *, coalesce(voice <> lag(voice) OVER (PARTITION BY session_id, seq ORDER BY i), false) AS change FROM w),
p AS (SELECT *, coalesce(max(CASE WHEN change THEN i END) OVER (PARTITION BY session_id, seq ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c),
t AS (SELECT *, sum((change AND n - before >= 4)::INT) OVER (PARTITION BY session_id, seq ORDER BY i) AS turn_idx FROM p)
SELECT session_id, seq AS segment_id, turn_idx::INT AS turn_idx, string_agg(word, ' ' ORDER BY i) AS text FROM t GROUP BY ALL UNION ALL SELECT session_id, seq, 0, '(nothing)' FROM k WHERE len(k) = 0""")
def e3b(spark, sf_dir):
    """The words of each turn, half a second each, in one of two voices by their first letter: a new turn wherever the voice
    changes, as long as four words are left."""
    own = utterances(read(spark, sf_dir, "conversations")).withColumn("k", C.tokenize(F.col("text")))
    voice = lambda i: F.when(F.ascii(F.get("k", i)) % 2 == 1, 0.5).otherwise(-0.5)
    n = F.size("k")
    x = F.when(n > 0, F.transform(F.sequence(F.lit(0), n * 8 - 1), lambda j: voice(F.least(F.floor((j + 2) / 8).cast("int"), n - 1)).cast("float"))).otherwise(F.array().cast("array<float>"))
    words = F.transform("k", lambda w, i: F.struct(w.alias("word"), (i * 0.5).alias("start"), (i * 0.5 + 0.25).alias("end"), F.lit(1.0).alias("probability")))
    segments = own.select("session_id", F.col("seq").alias("segment_id"), F.lit(0.0).alias("start_time"), (n * 0.5).alias("end_time"), F.lit("(nothing)").alias("text"), x.alias("samples"), words.cast(f"array<{W.WORD}>").alias("words"))
    return W.partition_turns(segments, _side, sample_rate=16).select("session_id", "segment_id", F.col("turn_idx").cast("int").alias("turn_idx"), "text")
