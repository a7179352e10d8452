"""Utterance tables: pauses, overlap, captions, settings, presentation.

Session id is the partition key throughout: a chain of these operators shuffles once, as Spark reuses the partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C

SETTINGS = {
    "show_captions": True, "show_speaker_identities": True, "show_overlap_indicators": True, "show_prosody_cues": True,
    "show_speaker_direction": False, "save_transcript": False, "privacy_mode": True, "reduced_motion": False, "compact_mode": False,
    "simulated_direction": True,
}


def by_session(order: str = "seq") -> Window:
    return Window.partitionBy("session_id").orderBy(order)


def long_pause_before(u: DataFrame, seconds: float = 1.2) -> DataFrame:
    gap = F.greatest(F.lit(0.0), F.col("start_time") - F.lag("end_time", 1, 0.0).over(by_session()))
    return u.withColumn("pause_s", gap).withColumn("long_pause_before", F.col("pause_s") >= seconds)


def temporal_overlap(u: DataFrame, lookback: int = 5, slack_s: float = 0.2) -> DataFrame:
    """Labels of other speakers among the last `lookback` utterances that end more than slack_s after this one starts."""
    before = F.collect_list(F.struct("end_time", "speaker_id", "label")).over(by_session().rowsBetween(-lookback, -1))
    over = F.filter(before, lambda p: (F.col("start_time") < p["end_time"] - slack_s) & (p["speaker_id"] != F.col("speaker_id")))
    return u.withColumn("overlapping_speakers", F.array_sort(F.array_distinct(F.transform(over, lambda p: p["label"])))).withColumn("overlap", F.size("overlapping_speakers") > 0)


def _cover(first: Column, last: Column) -> Column:
    """The bins [first, last] as the fewest nodes of a binary tree over all bins: structs of level and node, at most two a level.

    At level k what is left to cover is from ceil(first / 2^k) to floor((last + 1) / 2^k); an odd begin or end is a node.
    """
    levels = F.sequence(F.lit(0), F.ceil(F.log2((last - first + 2).cast("double"))).cast("int"))

    def nodes(k: Column) -> Column:
        width = F.pow(F.lit(2.0), k).cast("long")
        begin, end = F.ceil(first / width).cast("long"), F.floor((last + 1) / width).cast("long")
        left = (begin < end) & (begin % 2 != 0)
        after = begin + left.cast("long")
        node = lambda n: F.struct(k.alias("level"), n.alias("node"))
        return F.array(F.when(left, node(begin)), F.when((after < end) & (end % 2 != 0), node(end - 1)))

    return F.filter(F.flatten(F.transform(levels, nodes)), lambda x: x.isNotNull())


def interval_overlap_join(u: DataFrame, slack_ms: int = 200, bin_ms: int = 10_000) -> DataFrame:
    """All pairs of a session's utterances by different speakers that overlap by more than slack_ms: a, b (a starts first).

    An utterance covers its time bins with the nodes of a binary tree, about twice the logarithm of their number, however
    wrong its end; the later one of a pair looks from the bin in which it starts up to the levels that its session uses. Each
    pair meets once, and a long session spreads over many keys.
    """
    first, last = F.floor(F.col("start_ms") / bin_ms), F.floor(F.greatest(F.col("end_ms"), F.col("start_ms")) / bin_ms)
    a = u.select("session_id", F.explode(_cover(first, last)).alias("n"), F.col("id").alias("a"), F.col("seq").alias("a_seq"), F.col("speaker_id").alias("a_speaker"), F.col("start_ms").alias("a_start"), F.col("end_ms").alias("a_end"))
    a = a.select("session_id", "n.level", "n.node", "a", "a_seq", "a_speaker", "a_start", "a_end")
    b = u.select("session_id", first.alias("bin"), F.col("id").alias("b"), F.col("seq").alias("b_seq"), F.col("speaker_id").alias("b_speaker"), F.col("start_ms").alias("b_start"), F.col("end_ms").alias("b_end"))
    used = a.groupBy("session_id").agg(F.collect_set("level").alias("levels"))  # some 60 numbers at most
    b = b.join(used, "session_id").withColumn("level", F.explode("levels")).withColumn("node", F.floor(F.col("bin") / F.pow(F.lit(2.0), "level").cast("long"))).drop("levels", "bin")
    before = (F.col("a_start") < F.col("b_start")) | ((F.col("a_start") == F.col("b_start")) & (F.col("a_seq") < F.col("b_seq")))
    return a.join(b, ["session_id", "level", "node"]).filter(before & (F.col("a_speaker") != F.col("b_speaker")) & (F.col("b_start") < F.col("a_end") - slack_ms) & (F.col("a_start") < F.col("b_end") - slack_ms)).select("session_id", "a", "b", (F.least("a_end", "b_end") - F.col("b_start")).alias("shared_ms"))


def overlap_flag(u: DataFrame) -> DataFrame:
    """Temporal or acoustic: the flags' or, the label lists' union (sorted)."""
    return u.withColumn("overlap", F.col("temporal_overlap") | F.col("acoustic_overlap")).withColumn("overlapping_speakers", F.array_sort(F.array_union(F.coalesce("temporal_labels", F.array().cast("array<string>")), F.coalesce("acoustic_labels", F.array().cast("array<string>")))))


def recent_utterances(u: DataFrame, most: int = 50) -> DataFrame:
    newest = Window.partitionBy("session_id").orderBy(F.col("seq").desc())
    return u.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= most).drop("_rn")


def upsert_captions(log: DataFrame) -> DataFrame:
    """log (session_id, id, seq, ...) -> the latest row of each id, at the place of the id's first: position."""
    others = [c for c in log.columns if c not in ("session_id", "id")]
    latest = log.groupBy("session_id", "id").agg(F.min("seq").alias("position"), F.max_by(F.struct(*others), "seq").alias("x"))
    return latest.select("session_id", "id", "position", "x.*")


def effective_settings(messages: DataFrame) -> DataFrame:
    """messages (session_id, seq, settings columns; null: not said) -> the settings in force in each session.

    The last message counts as a whole, over the defaults; privacy forces saving off.
    """
    named = [k for k in SETTINGS if k in messages.columns]
    last = messages.groupBy("session_id").agg(F.max_by(F.struct(*named), "seq").alias("x"))
    out = last.select("session_id", *(F.coalesce(F.col(f"x.{k}") if k in named else F.lit(None).cast("boolean"), F.lit(v)).alias(k) for k, v in SETTINGS.items()))
    return out.withColumn("save_transcript", F.col("save_transcript") & ~F.col("privacy_mode"))


def with_settings(u: DataFrame, settings: DataFrame) -> DataFrame:
    """A session without settings has the defaults. Settings have a row a session: Spark broadcasts them if they are few."""
    joined = u.join(settings, "session_id", "left")
    return joined.withColumns({k: F.coalesce(k, F.lit(v)) for k, v in SETTINGS.items() if k in settings.columns})


def caption_view(u: DataFrame, settings: DataFrame) -> DataFrame:
    """What a reader sees: text, label, overlap and cues, each null where the settings hide it."""
    s = with_settings(u, settings)
    cue = F.col("show_prosody_cues") & F.col("is_final") & (F.size("tags") > 0)
    return s.select(
        "session_id", "id", "seq",
        F.when(F.col("show_captions"), F.col("text")).alias("text"),
        F.when(F.col("show_speaker_identities"), F.col("label")).alias("label"),
        F.when(F.col("show_overlap_indicators"), F.col("overlap")).alias("overlap"),
        F.when(cue, F.col("tags")).alias("tags"),
    )


def prosody_tags(rising: Column, falling: Column, emphasis: Column, pause: Column, rate: Column, volume: Column) -> Column:
    """Tags in their order, without those that don't hold."""
    tags = F.array(
        F.when(rising, "rising"), F.when(falling, "falling"), F.when(emphasis, "emphasis"), F.when(pause, "pause"),
        F.when(rate.isin("fast", "slow"), rate), F.when(volume.isin("loud", "quiet"), volume),
    )
    return F.filter(tags, lambda x: x.isNotNull())


def caption_stats(pitch: Column, low: Column, high: Column, span: Column, wpm: Column, level: Column, excursion: Column) -> Column:
    """Ordered display strings of what was measured."""
    whole = lambda x: F.floor(x + 0.5).cast("string")
    stats = F.array(
        F.when(pitch.isNotNull(), F.concat(whole(pitch), F.lit(" Hz"))),
        F.when(low.isNotNull() & high.isNotNull(), F.concat(whole(low), F.lit("–"), whole(high), F.lit(" Hz range"))),
        F.when(span.isNotNull(), F.concat(F.format_string("%.1f", span), F.lit(" ST range"))),
        F.when(wpm.isNotNull(), F.concat(whole(wpm), F.lit(" WPM"))),
        F.when(level.isNotNull(), F.concat(F.format_string("%.1f", level), F.lit(" dBFS"))),
        F.when(excursion.isNotNull(), F.concat(F.when(excursion >= 0, "+").otherwise(""), F.format_string("%.1f", excursion), F.lit(" ST"))),
    )
    return F.filter(stats, lambda x: x.isNotNull())


def overlap_banner(u: DataFrame, seconds: float = 3.5) -> DataFrame:
    """For overlapping utterances: who, and from when to when the banner shows."""
    own = u.filter("overlap")
    return own.select("session_id", "id", F.array_distinct(F.concat(F.array("label"), "overlapping_speakers")).alias("speakers"), F.col("end_time").alias("shown_from"), (F.col("end_time") + seconds).alias("shown_to"))


def attach_direction(u: DataFrame, positions: DataFrame, settings: DataFrame) -> DataFrame:
    """Look up each speaker's position (speaker_id, angle_degrees, direction, simulated, direction_confidence); unknown
    speakers are in front. Null where the session doesn't show directions."""
    s = with_settings(u, settings).join(positions, "speaker_id", "left")
    found = F.struct(F.coalesce("angle_degrees", F.lit(0.0)).alias("angle_degrees"), F.coalesce("direction", F.lit("front")).alias("label"), F.coalesce("simulated", F.lit(True)).alias("simulated"), F.col("direction_confidence").alias("confidence"))
    return s.select(*(c for c in u.columns if c != "direction"), F.when(F.col("show_speaker_direction"), found).alias("direction"))


def script_timeline(script: DataFrame) -> DataFrame:
    """script (session_id, seq, text, delay_ms) -> an interim and a final row each, on the script's own clock.

    The clock moves on by the delay (1500 ms if not given) before a row, and by half a second between the interim and the
    final row of a text of more than three words, which alone have an interim.
    """
    words = F.split("text", " ")
    delay = F.coalesce("delay_ms", F.lit(1500)) / 1000.0
    long = F.size(words) > 3
    so_far = by_session().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    clock = script.withColumns({"_long": long, "_words": words, "_step": delay + F.when(long, 0.5).otherwise(0.0)})
    clock = clock.withColumn("_final", F.sum("_step").over(so_far)).withColumn("_interim", F.col("_final") - F.when(F.col("_long"), 0.5).otherwise(0.0))
    half = F.concat(F.array_join(F.slice("_words", F.lit(1), F.floor(F.size("_words") / 2).cast("int")), " "), F.lit("..."))
    row = lambda final, text, at, length: F.struct(F.lit(final).alias("is_final"), text.alias("text"), F.round(at, 2).alias("start_time"), F.round(at + length, 2).alias("end_time"))
    rows = F.when(F.col("_long"), F.array(row(False, half, F.col("_interim"), 0.8), row(True, F.col("text"), F.col("_final"), 1.6))).otherwise(F.array(row(True, F.col("text"), F.col("_final"), 1.6)))
    return clock.select("session_id", "seq", F.explode(rows).alias("x")).select("session_id", "seq", "x.*")


def utterance_id(*parts: str) -> Column:
    """The same id on every run: session, segment and turn."""
    return F.sha2(F.concat_ws("|", *(F.col(p).cast("string") for p in parts)).cast("binary"), 256)


def assemble_utterances(turns: DataFrame) -> DataFrame:
    """The fact row with its defaults."""
    have = set(turns.columns)
    default = lambda c, v: F.coalesce(F.col(c), v).alias(c) if c in have else v.alias(c)
    return turns.select(
        utterance_id("session_id", "segment_id", "turn_idx").alias("id"), "session_id", "start_time", "end_time", "speaker_id", "speaker_label", "speaker_color_index",
        C.display_text(F.col("text"), F.col("segment_text")).alias("text"), default("is_final", F.lit(True)), default("overlap", F.lit(False)), default("overlapping_speakers", F.array().cast("array<string>")), default("created_at", F.col("end_time")),
    )


def start_epoch(rows: DataFrame, starts: DataFrame) -> DataFrame:
    """Number a session's restarts: rows (session_id, seq) belong to the epoch of the last start at or before them."""
    both = rows.select("session_id", "seq", F.lit(0).alias("is_start")).unionByName(starts.select("session_id", "seq", F.lit(1).alias("is_start")))
    numbered = both.withColumn("epoch", F.sum("is_start").over(Window.partitionBy("session_id").orderBy("seq", F.col("is_start").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.filter("is_start = 0").drop("is_start")
