"""Acoustic features: baselines over the last qualifying rows, utterance features, and the live stream's rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C


def _last_n(keys: list[str], order: list[str], n: int, qualifies: Column) -> tuple[Column, Window]:
    """Rows that qualify before the current one, counted; and the window of the last n of them.

    Ordered by that count, the last n qualifying rows are a range of it, however many rows lie between.
    """
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(qualifies.cast("long")).over(before), F.lit(0)), Window.partitionBy(*keys).orderBy("_before").rangeBetween(-n, -1)


def rolling_baseline(df: DataFrame, value: str, out: str, keys: list[str], n: int = 20, stat: str = "avg", default: float | None = None, qualifies: Column | None = None, order: str = "seq") -> DataFrame:
    """df with the average or median of the last n usable values before each row (default where there is none)."""
    ok = (F.col(value).isNotNull() & ~F.isnan(value)) if qualifies is None else F.coalesce(qualifies, F.lit(False))
    count, window = _last_n(keys, [order], n, ok)
    own = df.withColumn("_before", count).withColumn("_value", F.when(ok, F.col(value).cast("double")))
    made = F.avg("_value").over(window) if stat == "avg" else F.percentile("_value", F.lit(0.5)).over(window)
    return own.withColumn(out, made if default is None else F.coalesce(made, F.lit(default))).drop("_before", "_value")


def rms_baseline(u: DataFrame) -> DataFrame:
    return rolling_baseline(u, "rms_db", "rms_baseline", ["session_id", "speaker_id"], default=-24.0)


def pitch_baseline(u: DataFrame) -> DataFrame:
    return rolling_baseline(u, "mean_pitch_hz", "pitch_baseline", ["session_id", "speaker_id"], stat="median", qualifies=F.col("mean_pitch_hz") > 50)


def utterance_features(u: DataFrame) -> DataFrame:
    """u (n_words, seconds, rms_db, mean_pitch_hz, start_time, end_time, ...) with rate, volume, baselines and pause."""
    from .utterances import long_pause_before

    out = long_pause_before(pitch_baseline(rms_baseline(u)))
    return out.withColumns({
        "speech_rate": C.speech_rate(F.col("n_words"), F.col("seconds")),
        "words_per_minute": C.words_per_minute(F.col("n_words"), F.col("seconds")),
        "relative_volume": C.relative_volume(F.col("rms_db"), F.col("rms_baseline")),
    })


def contour_features(df: DataFrame) -> DataFrame:
    """df (f0: array of Hz) with mean, min, max, range, excursion and the two intonation flags."""
    f0 = F.col("f0")
    n = F.size("f0")
    return df.withColumns({
        "mean_pitch_hz": F.when(n > 0, F.aggregate(f0, F.lit(0.0), lambda a, x: a + x) / n),
        "min_pitch_hz": F.array_min(f0),
        "max_pitch_hz": F.array_max(f0),
        "pitch_range_semitones": C.pitch_range_semitones(F.array_min(f0), F.array_max(f0)),
        "pitch_semitone_excursion": C.contour_excursion(f0),
    }).withColumns({
        "rising_intonation": F.coalesce(F.col("pitch_semitone_excursion") >= 1.2, F.lit(False)),
        "falling_intonation": F.coalesce(F.col("pitch_semitone_excursion") <= -1.2, F.lit(False)),
    })


def emphasis(df: DataFrame) -> DataFrame:
    """df (seconds, energy_ratio, f0) with emphasis: a burst of energy that the pitch doesn't contradict."""
    f0 = F.col("f0")
    mean = F.aggregate(f0, F.lit(0.0), lambda a, x: a + x) / F.size("f0")
    return df.withColumn("emphasis", F.coalesce((F.col("seconds") >= 0.3) & (F.col("energy_ratio") > 2.5) & ((F.size("f0") < 3) | (F.array_max(f0) / mean > 1.25)), F.lit(False)))


# -- live rows ----------------------------------------------------------------------------------------------------
def live_windows(frames: DataFrame, n: int = 6) -> DataFrame:
    """Every n frames a row; the rest at the end gives none. Level and state of the window, pitch as median."""
    window = frames.groupBy("session_id", F.floor(F.col("frame_idx") / n).alias("window_idx"))
    made = window.agg(
        F.count("*").alias("frames"), F.max("frame_idx").alias("last_frame"), F.max_by("voiced", "frame_idx").alias("speech_active"),
        F.avg(F.pow(F.lit(10.0), F.col("level_dbfs") / 10)).alias("power"), F.percentile("pitch_hz", F.lit(0.5)).alias("pitch"),
    )
    full = made.filter(F.col("frames") == n)
    return full.select("session_id", "window_idx", "last_frame", "speech_active", (10 * F.log10(F.greatest("power", F.lit(1e-12)))).alias("level_dbfs"), F.when(F.col("speech_active"), F.col("pitch")).alias("pitch_hz"))


def pitch_direction(live: DataFrame, n: int = 12, order: str = "frame_idx") -> DataFrame:
    """Change against the median of the last n known pitches, in semitones, and its direction."""
    own = rolling_baseline(live, "pitch_hz", "pitch_history", ["session_id"], n, "median", order=order)
    own = own.withColumn("pitch_change", F.when(F.col("pitch_hz").isNotNull() & (F.col("pitch_history") > 0), C.semitones(F.col("pitch_hz"), F.col("pitch_history"))))
    return own.withColumn("pitch_direction", C.direction(F.col("pitch_change"), F.col("pitch_hz")))


def relative_level(live: DataFrame, n: int = 30, least: int = 4, order: str = "frame_idx") -> DataFrame:
    """Level against the median of the last n active levels above -55 dBFS, of which there must be `least`."""
    ok = F.coalesce(F.col("voiced") & (F.col("level_dbfs") > -55), F.lit(False))
    count, window = _last_n(["session_id"], [order], n, ok)
    own = live.withColumn("_before", count).withColumn("_value", F.when(ok, F.col("level_dbfs")))
    made = F.when(F.col("voiced") & (F.count("_value").over(window) >= least), F.col("level_dbfs") - F.percentile("_value", F.lit(0.5)).over(window))
    return own.withColumn("relative_level_db", made).drop("_before", "_value")


def emphasis_candidate(live: DataFrame) -> DataFrame:
    return live.withColumn("emphasis_candidate", F.coalesce(F.col("voiced") & (F.col("relative_level_db") >= 6) & (F.abs("pitch_change") >= 1.5), F.lit(False)))


def live_features(live: DataFrame, n_pitch: int = 12, n_level: int = 30, order: str = "frame_idx") -> DataFrame:
    return emphasis_candidate(relative_level(pitch_direction(live, n_pitch, order), n_level, order=order))


def live_wpm(live: DataFrame, rates: DataFrame) -> DataFrame:
    """As-of join: each live row (session_id, at, voiced) gets the last rate change (session_id, at, wpm) at or before it,
    also one to null; hidden while inactive. One sort of the union, no join."""
    both = live.select("session_id", "at", F.lit(1).alias("is_row"), F.col("voiced"), F.lit(None).cast("struct<wpm:double>").alias("r"))
    both = both.unionByName(rates.select("session_id", "at", F.lit(0).alias("is_row"), F.lit(None).cast("boolean").alias("voiced"), F.struct(F.col("wpm").cast("double").alias("wpm")).alias("r")))
    order = Window.partitionBy("session_id").orderBy("at", "is_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = both.withColumn("r", F.last("r", True).over(order)).filter("is_row = 1")
    return known.select("session_id", "at", "voiced", F.when(F.col("voiced"), F.col("r.wpm")).alias("speech_rate_wpm"))


def live_validate(live: DataFrame) -> DataFrame:
    """Rows with `valid`; durations below zero are set to zero first."""
    clamped = live.withColumns({c: F.greatest(F.col(c), F.lit(0.0)) for c in ("speech_duration_s", "pause_duration_s") if c in live.columns})
    ok = F.coalesce(F.col("timestamp_s") >= 0, F.lit(False)) & F.coalesce(F.col("pitch_hz") > 0, F.lit(True)) & F.coalesce(F.col("speech_rate_wpm") >= 0, F.lit(True))
    return clamped.withColumn("valid", ok)


def live_tail(live: DataFrame, rows: int = 150, seconds: float = 20.0) -> DataFrame:
    """The last rows of each session, and of these those of the last seconds."""
    session = Window.partitionBy("session_id")
    own = live.withColumn("_rn", F.row_number().over(session.orderBy(F.col("timestamp_s").desc()))).filter(F.col("_rn") <= rows)
    return own.withColumn("_newest", F.max("timestamp_s").over(session)).filter(F.col("timestamp_s") >= F.col("_newest") - seconds).drop("_rn", "_newest")


def series_runs(live: DataFrame, value: str, gap_s: float = 0.7) -> DataFrame:
    """Runs of a drawn series: a null or a gap breaks it, and the row at a break is not drawn itself."""
    order = Window.partitionBy("session_id").orderBy("timestamp_s")
    prev = F.lag("timestamp_s").over(order)
    cut = F.col(value).isNull() | prev.isNull() | (F.col("timestamp_s") - prev > gap_s)
    own = live.withColumn("_cut", cut).withColumn("run_id", F.sum(F.col("_cut").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return own.filter(~F.col("_cut")).drop("_cut")


def series_clamp(live: DataFrame) -> DataFrame:
    """Values held in the drawn range, null while inactive."""
    hold = lambda c, lo, hi: F.when(F.col("voiced") & F.col(c).isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), F.col(c))))
    return live.withColumns({"pitch_drawn": hold("pitch_hz", 70.0, 400.0), "level_drawn": hold("level_dbfs", -50.0, -6.0), "wpm_drawn": hold("speech_rate_wpm", 0.0, 300.0)})


def live_latest(live: DataFrame) -> DataFrame:
    """The newest reading of each session, with status and signed relative level."""
    last = live.groupBy("session_id").agg(F.max_by(F.struct("timestamp_s", "voiced", "pitch_hz", "level_dbfs", "relative_level_db"), "timestamp_s").alias("x")).select("session_id", "x.*")
    signed = F.when(F.col("relative_level_db").isNotNull(), F.concat(F.when(F.col("relative_level_db") >= 0, "+").otherwise(""), F.format_string("%.1f dB", F.col("relative_level_db"))))
    return last.withColumns({"status": F.when(F.col("voiced"), "speaking").otherwise("silent"), "relative_shown": signed})
