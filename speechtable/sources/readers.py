"""Sources: packets, clips, scripts and control messages, batch or streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import wav

CONTROL = "type string, session_id string, speaker_id string, new_name string, format string, pcm16_base64 string, settings map<string,string>"
TYPES = ("start_session", "audio_frame", "rename_speaker", "update_settings", "clear_history", "export_transcript", "start_demo", "stop_demo")
SCRIPT = """delay_ms long, speaker_id string, speaker_label string, speaker_color_index int, text string, overlap boolean,
 overlapping_speakers array<string>, prosody struct<rising_intonation:boolean,falling_intonation:boolean,emphasis:boolean,
 long_pause_before:boolean,speech_rate:string,relative_volume:string,mean_pitch_hz:double,rms_db:double,words_per_minute:double>,
 direction struct<angle_degrees:double,label:string,simulated:boolean,confidence:double>, confidence struct<transcription:double,speaker:double>"""


def read_pcm_packets(messages: DataFrame) -> DataFrame:
    """messages (session_id, packet_seq, payload: bytes, json: text) -> packets with whole samples. A JSON message carries
    them as base64; empty and odd ones are left out."""
    payload = F.coalesce("payload", F.try_to_binary(F.get_json_object("json", "$.pcm16_base64"), F.lit("base64")))
    packets = messages.select("session_id", "packet_seq", payload.alias("payload"))
    return packets.filter((F.octet_length("payload") > 0) & (F.octet_length("payload") % 2 == 0))


def route_control_messages(messages: DataFrame) -> dict[str, DataFrame]:
    """messages (seq, value) -> a DataFrame for each known type, and "error" for what isn't JSON; unknown types go."""
    parsed = messages.withColumn("m", F.from_json("value", CONTROL, {"mode": "PERMISSIVE"}))
    bad = F.col("m").isNull() | F.try_parse_json("value").isNull()
    known = parsed.filter(~bad).select("seq", "m.*")
    out = {t: known.filter(F.col("type") == t) for t in TYPES}
    out["error"] = parsed.filter(bad).select("seq", F.lit("error").alias("type"), F.lit("Invalid JSON").alias("message"))
    return out


def control_counts(messages: DataFrame) -> DataFrame:
    routed = route_control_messages(messages)
    each = [df.select(F.lit(k).alias("type")) for k, df in routed.items()]
    out = each[0]
    for e in each[1:]:
        out = out.unionByName(e)
    return out.groupBy("type").agg(F.count("*").alias("n"))


def read_wav_clips(spark: SparkSession, path: str, start_s: float = 20.0, end_s: float = 40.0, sample_rate: int = 16000, block: int = wav.BLOCK) -> DataFrame:
    """WAV files -> path, samples: mean of the channels, cropped. Other rates are an error. Of each file only the bytes of the
    crop are read; a file that ends before it gives no row."""
    wav.register(spark)
    pieces = spark.read.format("wav").option("start_s", start_s).option("end_s", end_s).option("rate", sample_rate).option("block", block).load(path)
    whole = pieces.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start_s", "samples"))).alias("p"))
    return whole.select("path", F.flatten(F.transform("p", lambda x: x["samples"])).alias("samples"))


def read_conversation_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of scripted rows; what a row doesn't say is null, but for the delay (1500 ms)."""
    rows = spark.read.option("multiLine", True).schema(SCRIPT).json(path)
    return rows.withColumn("delay_ms", F.coalesce("delay_ms", F.lit(1500))).withColumn("overlap", F.coalesce("overlap", F.lit(False))).withColumn("overlapping_speakers", F.coalesce("overlapping_speakers", F.array().cast("array<string>")))


def encode_pcm16(clips: DataFrame, symmetric: bool = False, make: tuple[Callable, str] | None = None) -> DataFrame:
    """samples -> payload.

    make: a function from Arrow batches of `clips` to batches with samples, and the schema of their other columns, where
    samples are yet to be made or decoded. It runs in the task that encodes, and what comes out are these columns and the
    payload: samples are twice its size, and cross to Spark and back neither way."""
    from ..functions.kernels import encode_pcm16 as encode

    if make:
        source, others = make
        names = StructType.fromDDL(others).names

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in source(batches):
                made = pa.array([encode(x.values.to_numpy(zero_copy_only=False), symmetric) for x in batch.column("samples")], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), made], names=[*names, "payload"])

        return clips.mapInArrow(whole, f"{others}, payload binary")

    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([encode(x, symmetric) for x in s])

    return clips.withColumn("payload", run("samples"))
