"""Audio to frames, and jobs on whole clips."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import kernels as K

FRAME = 512


def frame_pcm(packets: DataFrame, frame: int = FRAME) -> DataFrame:
    """packets (session_id, packet_seq, payload) -> session_id, frame_idx, samples: 16-bit little-endian samples in frames;
    each packet's last frame is filled up with zeros.

    Frames are numbered by a running sum over the packets' lengths, which are shuffled without the audio; the numbers meet
    the packets again by (session_id, packet_seq), of which two alike are an error. Spark broadcasts them below its size limit, and else
    the audio is shuffled this once.
    """
    n = F.ceil(F.octet_length("payload") / 2 / frame).cast("long")
    before = F.sum("_n").over(Window.partitionBy("session_id").orderBy("packet_seq").rowsBetween(Window.unboundedPreceding, -1))
    twice = F.lag("packet_seq").over(Window.partitionBy("session_id").orderBy("packet_seq")) == F.col("packet_seq")
    at = F.when(twice, F.raise_error(F.lit("a packet was given twice")).cast("long")).otherwise(F.coalesce(before, F.lit(0)))
    first = packets.select("session_id", "packet_seq", n.alias("_n")).select("session_id", "packet_seq", at.alias("_first"))
    numbered = packets.join(first, ["session_id", "packet_seq"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for s, first, payload in zip(pdf.session_id, pdf["_first"], pdf.payload):
                x = np.frombuffer(payload, "<i2").astype(np.float32) / np.float32(32768)
                x = np.pad(x, (0, -len(x) % frame)).reshape(-1, frame)
                out += [(s, first + i, row) for i, row in enumerate(x)]
            yield pd.DataFrame(out, columns=["session_id", "frame_idx", "samples"])

    kind = packets.schema["session_id"].dataType.simpleString()
    return numbered.select("session_id", "_first", "payload").mapInPandas(run, f"session_id {kind}, frame_idx long, samples array<float>")


def speech_prob(frames: DataFrame, fn=None, frame: int = FRAME) -> DataFrame:
    """frames (..., samples) with speech_prob by a user's fn(float32 samples of one frame) -> probability. Frames are cut or
    filled up to `frame` samples first; without fn, and where it fails, the frame's energy decides."""

    def by_energy(x: np.ndarray) -> float:
        db = 20 * np.log10(np.sqrt((x.astype(float) ** 2).mean() + 1e-12) + 1e-12)
        return float(1 / (1 + np.exp(-(db + 38.0) / 5.0)))

    @F.pandas_udf("double")
    def run(samples: pd.Series) -> pd.Series:
        out = []
        for s in samples:
            x = np.asarray(s if s is not None else [], np.float32)[:frame]
            x = np.pad(x, (0, frame - len(x)))
            try:
                out.append(float(fn(x)) if fn else by_energy(x))
            except Exception:  # a model that fails on a frame must not end the job
                out.append(by_energy(x))
        return pd.Series(out)

    return frames.withColumn("speech_prob", run("samples"))


def event_time(frames: DataFrame, epochs: DataFrame, sample_rate: int = 16000, frame: int = FRAME) -> DataFrame:
    """frames (session_id, frame_idx) and epochs (session_id, epoch: when its audio began) with event_ts: when the frame's
    last sample was heard. A session without an epoch has none."""
    heard = ((F.col("frame_idx") + 1) * frame * 1_000_000 / sample_rate).cast("long")
    return frames.join(epochs.select("session_id", "epoch"), "session_id", "left").withColumn("event_ts", F.timestamp_micros(F.unix_micros("epoch") + heard)).drop("epoch")


#: clips that are worked on at once in Python, however many an Arrow batch holds
CLIPS = 64


def condition_audio(clips: DataFrame, sample_rate: int = 16000, give: tuple[str, ...] = ("samples",)) -> DataFrame:
    """samples through a 75 Hz high-pass and a limiter, or what is asked for of samples and mean_square (of these samples, null
    without any) in their place. Results leave Python a few clips at a time."""
    types = {"samples": pa.list_(pa.float64()), "mean_square": pa.float64()}
    others = [c for c in clips.columns if c != "samples"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CLIPS):
                own = batch.slice(at, CLIPS)
                made = [K.condition(np.asarray(x, float), sample_rate) for x in own.column("samples").to_pandas()]
                columns = {"samples": lambda: made, "mean_square": lambda: [K.mean_square(y) if len(y) else None for y in made]}
                yield pa.RecordBatch.from_arrays([*(own.column(c) for c in others), *(pa.array(columns[c](), types[c]) for c in give)], names=[*others, *give])

    names = {"samples": "array<double>", "mean_square": "double"}
    fields = [f"`{c}` {clips.schema[c].dataType.simpleString()}" for c in others]
    return clips.select(*others, "samples").mapInArrow(run, ", ".join([*fields, *(f"{c} {names[c]}" for c in give)]))


def retain_last(frames: DataFrame, seconds: float = 30.0, sample_rate: int = 16000, frame: int = FRAME) -> DataFrame:
    """The frames of the last seconds of each session."""
    keep = int(seconds * sample_rate / frame)
    last = F.max("frame_idx").over(Window.partitionBy("session_id"))
    return frames.withColumn("_last", last).filter(F.col("frame_idx") > F.col("_last") - keep).drop("_last")


def active_mask(blocks: DataFrame) -> DataFrame:
    """blocks (clip_id, block_idx, rms) with active: at least 0.008 and 12 % of the clip's 85th percentile."""
    p85 = F.percentile("rms", F.lit(0.85)).over(Window.partitionBy("clip_id"))
    return blocks.withColumn("active", F.col("rms") >= F.greatest(F.lit(0.008), 0.12 * p85))


def add_noise(clips: DataFrame, conditions: list[tuple[str, float]], sample_rate: int = 16000, give: tuple[str, ...] = ("samples",)) -> DataFrame:
    """clips (clip_id, samples) -> a row for each clip and condition (kind of noise, SNR in dB): clip_id, kind, snr_db, and
    what is asked for of samples and mean_square (of these samples). Seeded by clip and condition, so a task that runs again
    makes the same noise. A clip goes to Python once for all conditions, and results leave it a few clips at a time."""
    known = set(K.NOISES)
    for kind, _ in conditions:
        if kind not in known:
            raise ValueError(f"unknown noise {kind}")
    kind = clips.schema["clip_id"].dataType.simpleString()
    types = {"samples": pa.list_(pa.float64()), "mean_square": pa.float64()}
    seeds = F.array(*(F.xxhash64("clip_id", F.lit(k), F.lit(float(s))) for k, s in conditions))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CLIPS):
                own = batch.slice(at, CLIPS)
                of, made = [], []
                for row, (x, seeds) in enumerate(zip(own.column("samples").to_pandas(), own.column("seeds").to_pandas())):
                    x = np.asarray(x, float)
                    on = K.active(x, sample_rate)
                    for (k, snr), seed in zip(conditions, seeds):
                        y = K.mix(x, k, snr, sample_rate, seed, on)
                        of.append((row, k, float(snr)))
                        made.append({"samples": y, "mean_square": K.mean_square(y) if len(y) else None})
                rows, kinds, snrs = zip(*of)
                out = [own.column("clip_id").take(pa.array(rows)), pa.array(kinds), pa.array(snrs), *(pa.array([m[c] for m in made], types[c]) for c in give)]
                yield pa.RecordBatch.from_arrays(out, names=["clip_id", "kind", "snr_db", *give])

    columns = {"samples": "array<double>", "mean_square": "double"}
    return clips.select("clip_id", "samples", seeds.alias("seeds")).mapInArrow(run, ", ".join([f"clip_id {kind}, kind string, snr_db double", *(f"{c} {columns[c]}" for c in give)]))


#: what clip_features gives: the columns of each, and what makes them of a clip
FEATURES = {
    "f0": ("f0 array<double>", lambda x, rate: (K.f0_contour(x, rate).tolist(),)),
    "energy_ratio": ("energy_ratio double", lambda x, rate: (K.energy_ratio(x, rate),)),
    "overlap": ("mean_entropy double, n_voiced int, n_dual int", lambda x, rate: K.overlap_evidence(x, rate)),
}


def clip_features(clips: DataFrame, sample_rate: int = 16000, give: tuple[str, ...] = tuple(FEATURES)) -> DataFrame:
    """clips (..., samples) with what is asked for of f0 (contour), energy_ratio, and overlap: the three numbers that tell
    overlapping voices. What isn't asked for isn't computed."""
    schema = ", ".join(FEATURES[g][0] for g in give)
    names = [c.split()[0] for c in schema.split(", ")]

    @F.pandas_udf(schema)
    def run(s: pd.Series) -> pd.DataFrame:
        rows = []
        for x in s:
            x = np.asarray(x if x is not None else [], float)
            rows.append([v for g in give for v in FEATURES[g][1](x, sample_rate)])
        return pd.DataFrame(rows, columns=names)

    return clips.withColumn("_x", run("samples")).select(*clips.columns, "_x.*")


def acoustic_overlap(features: DataFrame) -> DataFrame:
    """features (seconds, mean_entropy, n_voiced, n_dual) with acoustic_overlap."""
    rule = (F.col("seconds") >= 0.4) & (F.col("mean_entropy") > 6.9) & (F.col("n_voiced") > 3) & (F.col("n_dual") / F.col("n_voiced") > 0.4)
    return features.withColumn("acoustic_overlap", F.coalesce(rule, F.lit(False)))
