"""Queries on utterances derived from `conversations`."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import acoustics as A
from ..operators import exports as X
from ..operators import reports as R
from ..operators import speakers as S
from ..operators import utterances as U
from ..operators import words as W
from ..session import scratch
from ..sources.derive import UTTERANCES_SQL, read, utterances
from .registry import Registry

registry = Registry()

LABEL_SQL = "CASE WHEN speaker_no <= 8 THEN 'Speaker ' || chr((64 + speaker_no)::INT) ELSE 'Speaker ' || speaker_no END"
LABELED_SQL = f"""{UTTERANCES_SQL},
l0 AS (SELECT *, min(seq) OVER (PARTITION BY session_id, speaker_id) AS first_seq FROM u),
l1 AS (SELECT *, dense_rank() OVER (PARTITION BY session_id ORDER BY first_seq) AS speaker_no FROM l0),
l AS (SELECT * EXCLUDE (first_seq), {LABEL_SQL} AS label, (speaker_no - 1) % 8 AS color_index, end_time AS created_at FROM l1)"""
#: settings of a session: what its number says
SETTINGS_SQL = """
g AS (SELECT DISTINCT conv_id AS session_id, conv_id % 3 <> 0 AS privacy_mode, conv_id % 2 = 0 AND conv_id % 3 = 0 AS save_transcript, conv_id % 5 <> 0 AS show_captions,
  conv_id % 7 <> 0 AS show_speaker_identities, conv_id % 4 <> 0 AS show_overlap_indicators, conv_id % 6 <> 0 AS show_prosody_cues, conv_id % 2 = 1 AS show_speaker_direction FROM conversations)"""


def u(spark: SparkSession, sf_dir: str) -> DataFrame:
    return utterances(read(spark, sf_dir, "conversations"))


def labeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.assign_labels(u(spark, sf_dir)).withColumn("created_at", F.col("end_time"))


def settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("session_id")
    own = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id")).distinct()
    return own.withColumns({
        "privacy_mode": c % 3 != 0, "save_transcript": (c % 2 == 0) & (c % 3 == 0), "show_captions": c % 5 != 0, "show_speaker_identities": c % 7 != 0,
        "show_overlap_indicators": c % 4 != 0, "show_prosody_cues": c % 6 != 0, "show_speaker_direction": c % 2 == 1,
    })


# -- sources and sinks --------------------------------------------------------------------------------------------
ORDERED = "ORDER BY start_time, created_at, id"
MMSS = "lpad((floor(start_time)::BIGINT // 60)::VARCHAR, greatest(2, len((floor(start_time)::BIGINT // 60)::VARCHAR))::INT, '0') || ':' || lpad((floor(start_time)::BIGINT % 60)::VARCHAR, 2, '0')"
START_AT_0 = "CASE WHEN start_time < 0 THEN 0 ELSE start_time END AS start_time"


def _vtt(c: str) -> str:
    p = lambda x, n: f"lpad(({x})::BIGINT::VARCHAR, {n}, '0')"
    w = f"floor({c})::BIGINT"
    return f"{p(f'{w} // 3600', 2)} || ':' || {p(f'{w} % 3600 // 60', 2)} || ':' || {p(f'{w} % 60', 2)} || '.' || {p(f'floor(({c} - floor({c})) * 1000)', 3)}"


def _from_zero(df: DataFrame) -> DataFrame:
    return df.withColumn("start_time", F.greatest(F.lit(0.0), F.col("start_time")))


@registry.add("a5_read_transcript", f"WITH {LABELED_SQL}, s AS (SELECT session_id, max(seq) % 2 = 0 AS is_live FROM l GROUP BY session_id) SELECT session_id, id, speaker_id, text, CASE WHEN is_live THEN 'live' ELSE 'archive' END AS origin FROM l JOIN s USING (session_id)")
def a5(spark, sf_dir):
    """All sessions are in the archive; those with an odd number of turns are in memory as well, and are read from there."""
    rows = labeled(spark, sf_dir)
    is_live = F.max("seq").over(Window.partitionBy("session_id")) % 2 == 0
    live = rows.withColumn("_live", is_live).filter("_live").drop("_live").withColumn("origin", F.lit("live"))
    return X.read_transcript(live, rows.withColumn("origin", F.lit("archive"))).select("session_id", "id", "speaker_id", "text", "origin")


@registry.add("a6_save_utterances", f"WITH {LABELED_SQL}, {SETTINGS_SQL} SELECT session_id, id, text || CASE WHEN NOT privacy_mode AND save_transcript THEN '!' ELSE '' END AS text FROM l JOIN g USING (session_id)")
def a6(spark, sf_dir):
    """The archive holds all utterances; those that may be saved come in a newer version."""
    rows = labeled(spark, sf_dir)
    newer = rows.withColumns({"is_final": F.lit(True), "text": F.concat("text", F.lit("!")), "created_at": F.col("created_at") + 1})
    return X.upserted(rows, X.savable(newer, settings(spark, sf_dir)).drop("is_final")).select("session_id", "id", "text")


@registry.add("a6b_archive_sink", f"WITH {LABELED_SQL}, {SETTINGS_SQL} SELECT session_id, id, text || CASE WHEN seq > 0 THEN '!' ELSE '' END AS text FROM l JOIN g USING (session_id) WHERE NOT privacy_mode AND save_transcript")
def a6b(spark, sf_dir):
    """Saved twice: the second time all but the first utterance of a session come in a newer version."""
    path = scratch(spark, "archive")
    rows = labeled(spark, sf_dir).withColumn("is_final", F.lit(True))
    X.save_utterances(rows, settings(spark, sf_dir), path)
    X.save_utterances(rows.filter("seq > 0").withColumns({"text": F.concat("text", F.lit("!")), "created_at": F.col("created_at") + 1}), settings(spark, sf_dir), path)
    schema = rows.schema.add("bucket", "integer")  # also where nothing may be saved
    return spark.read.schema(schema).parquet(path).select("session_id", "id", "text")


@registry.add("a7_clear_session", f"WITH {UTTERANCES_SQL} SELECT session_id, id, text FROM u WHERE session_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')")
def a7(spark, sf_dir):
    rows = u(spark, sf_dir)
    return X.clear_session(rows, rows.filter("speaker_id = 'system'")).select("session_id", "id", "text")


@registry.add("a8_export_txt", f"WITH {LABELED_SQL}, z AS (SELECT * REPLACE (CASE WHEN start_time < 0 THEN 0 ELSE start_time END AS start_time) FROM l) SELECT session_id, string_agg('[' || {MMSS} || '] ' || label || ': ' || text, chr(10) {ORDERED}) AS content FROM z GROUP BY session_id")
def a8(spark, sf_dir):
    return X.export_txt(_from_zero(labeled(spark, sf_dir)))


@registry.add("a9_export_vtt", f"""WITH {LABELED_SQL}, z0 AS (SELECT * REPLACE (CASE WHEN start_time < 0 THEN 0::DOUBLE ELSE start_time::DOUBLE END AS start_time, end_time::DOUBLE AS end_time) FROM l),
z AS (SELECT *, row_number() OVER (PARTITION BY session_id {ORDERED}) AS n FROM z0)
SELECT session_id, 'WEBVTT' || chr(10) || chr(10) || string_agg(n || chr(10) || {_vtt('start_time')} || ' --> ' || {_vtt('end_time')} || chr(10) || '<v ' || label || '>' || text || chr(10), chr(10) {ORDERED}) AS content FROM z GROUP BY session_id""")
def a9(spark, sf_dir):
    return X.export_vtt(_from_zero(labeled(spark, sf_dir)))


@registry.add("a10_export_json", f"WITH {LABELED_SQL} SELECT session_id, '[' || string_agg('{{\"id\":\"' || id || '\",\"session_id\":' || session_id || ',\"speaker_id\":\"' || speaker_id || '\",\"custom_name\":null,\"start_time\":' || start_ms || ',\"created_at\":' || end_ms || ',\"n_words\":' || n_words || '}}', ',' ORDER BY start_ms, end_ms, id) || ']' AS content FROM l GROUP BY session_id")
def a10(spark, sf_dir):
    rows = labeled(spark, sf_dir).select("id", "session_id", "speaker_id", F.lit(None).cast("string").alias("custom_name"), F.col("start_ms").alias("start_time"), F.col("end_ms").alias("created_at"), "n_words")
    return X.export_json(rows)


@registry.add("a15_write_exports", f"SELECT 'txt' AS format, * FROM ({registry.sql['a8_export_txt']}) UNION ALL SELECT 'vtt', * FROM ({registry.sql['a9_export_vtt']})")
def a15(spark, sf_dir):
    """Written as a table and read again."""
    path = scratch(spark, "exports")
    X.write_exports(_from_zero(labeled(spark, sf_dir)), path, ("txt", "vtt"), as_table=True)
    return spark.read.parquet(path).select("format", "session_id", "content")


@registry.add("a11_list_speakers", f"WITH {LABELED_SQL} SELECT session_id, speaker_id, speaker_no, label, color_index, count(*) AS total_utterances, max_by(end_ms, seq) AS last_heard_ms FROM l GROUP BY ALL")
def a11(spark, sf_dir):
    d = S.speaker_dimension(u(spark, sf_dir).withColumn("end_time", F.col("end_ms")))
    return d.select("session_id", "speaker_id", "speaker_no", "label", "color_index", "total_utterances", F.col("last_heard_time").alias("last_heard_ms"))


@registry.add("a13_evolve_schema", f"WITH {UTTERANCES_SQL} SELECT session_id, id, NULL::VARCHAR AS direction_json FROM u")
def a13(spark, sf_dir):
    return X.evolve_schema(u(spark, sf_dir), {"direction_json": "string"}).select("session_id", "id", "direction_json")


# -- words --------------------------------------------------------------------------------------------------------
@registry.add("d2_assemble_text", f"WITH {UTTERANCES_SQL} SELECT session_id, speaker_id, coalesce(string_agg(trim(text, ' '), ' ' ORDER BY seq) FILTER (trim(text, ' ') <> ''), '') AS text, least(1, greatest(0, exp(avg(-n_words / 100.0)))) AS confidence FROM u GROUP BY ALL")
def d2(spark, sf_dir):
    parts = u(spark, sf_dir).select("session_id", F.col("speaker_id").alias("segment_id"), F.col("seq").alias("part_idx"), "text", (-F.col("n_words") / 100.0).alias("logprob"))
    return W.segment_text(parts).withColumnRenamed("segment_id", "speaker_id")


@registry.add("d4_explode_words", f"WITH {UTTERANCES_SQL} SELECT session_id, segment_id, word_idx, w AS word FROM (SELECT session_id, seq AS segment_id, unnest(regexp_extract_all(lower(text), '[a-z0-9'']+')) AS w, unnest(range(n_words)) AS word_idx FROM u WHERE n_words > 0 UNION ALL SELECT session_id, seq, NULL, NULL FROM u WHERE n_words = 0)")
def d4(spark, sf_dir):
    none = lambda t: F.lit(None).cast(t)
    asr = u(spark, sf_dir).select("session_id", F.col("seq").alias("segment_id"), F.transform(C.tokenize(F.col("text")), lambda w: F.struct(w.alias("word"), none("double").alias("start"), none("double").alias("end"), none("double").alias("probability"))).alias("words"))
    return W.explode_words(asr).select("session_id", "segment_id", F.col("word_idx").cast("long").alias("word_idx"), "word")


@registry.add("d5_display_text", f"WITH {UTTERANCES_SQL} SELECT session_id, id, coalesce(nullif(CASE WHEN seq % 3 = 0 THEN '' ELSE text END, ''), nullif(CASE WHEN seq % 2 = 0 THEN '' ELSE speaker_id END, ''), '[Speech detected]') AS text FROM u")
def d5(spark, sf_dir):
    turn, segment = F.when(F.col("seq") % 3 == 0, "").otherwise(F.col("text")), F.when(F.col("seq") % 2 == 0, "").otherwise(F.col("speaker_id"))
    return u(spark, sf_dir).select("session_id", "id", C.display_text(turn, segment).alias("text"))


@registry.add("d6_partial_wpm", f"WITH {UTTERANCES_SQL} SELECT session_id, id, CASE WHEN dur_ms / 1000.0 > 0.4 THEN n_words * 60.0 / (dur_ms / 1000.0) END AS wpm FROM u")
def d6(spark, sf_dir):
    return u(spark, sf_dir).select("session_id", "id", C.partial_wpm(F.col("n_words"), F.lit(""), F.col("dur_ms") / 1000.0).alias("wpm"))


_WORDS_SQL = f"""{UTTERANCES_SQL},
w0 AS (SELECT session_id, seq AS segment_id, unnest(string_split_regex(trim(text, ' '), ' +')) AS word, unnest(range(len(string_split_regex(trim(text, ' '), ' +')))) AS word_idx, dur_ms, len(string_split_regex(trim(text, ' '), ' +')) AS n FROM u WHERE trim(text, ' ') <> ''),
w AS (SELECT *, word_idx * 300 + 100 * (word_idx % 4) AS start_ms, word_idx * 300 + 100 * (word_idx % 4) + 200 AS end_ms, n * 300 + 400 AS segment_ms FROM w0)"""


def _timed_words(spark, sf_dir):
    own = u(spark, sf_dir).withColumn("ws", F.split(F.trim("text"), " +")).filter(F.trim("text") != "")
    each = own.select("session_id", F.col("seq").alias("segment_id"), F.size("ws").alias("n"), F.posexplode("ws").alias("word_idx", "word"))
    start = F.col("word_idx") * 300 + 100 * (F.col("word_idx") % 4)
    return each.select("session_id", "segment_id", "word_idx", "word", start.alias("start"), (start + 200).alias("end"), (F.col("n") * 300 + 400).alias("segment_s"))


@registry.add("e1_turn_candidates", f"""WITH {_WORDS_SQL}, x AS (SELECT *, lead(start_ms) OVER (PARTITION BY session_id, segment_id ORDER BY word_idx) AS nxt FROM w)
SELECT session_id, segment_id, word_idx, (end_ms + nxt) / 2.0 AS split_ms FROM x WHERE nxt IS NOT NULL AND (regexp_matches(word, '[?.!]$') OR nxt - end_ms >= 200) AND (end_ms + nxt) / 2.0 >= 350 AND segment_ms - (end_ms + nxt) / 2.0 >= 350""")
def e1(spark, sf_dir):
    found = W.turn_candidates(_timed_words(spark, sf_dir), gap_s=200, side_s=350)
    return found.select("session_id", "segment_id", F.col("word_idx").cast("long").alias("word_idx"), F.col("split_t").alias("split_ms"))


@registry.add("e4_rebase_words", f"WITH {_WORDS_SQL} SELECT session_id, segment_id, string_agg(word || '@' || greatest(0, start_ms - 1000)::VARCHAR, ' ' ORDER BY word_idx) AS words FROM w GROUP BY ALL")
def e4(spark, sf_dir):
    word = F.struct("word", F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), F.lit(None).cast("double").alias("probability"))
    own = _timed_words(spark, sf_dir).groupBy("session_id", "segment_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("word_idx", word.alias("w")))), lambda x: x["w"]).alias("words"))
    moved = W.rebase_words(F.col("words"), F.lit(1000.0))
    return own.select("session_id", "segment_id", F.array_join(F.transform(moved, lambda w: F.concat(w["word"], F.lit("@"), w["start"].cast("long").cast("string"))), " ").alias("words"))


@registry.add("e5_turn_text", f"WITH {_WORDS_SQL} SELECT session_id, segment_id, trim(string_agg(word, ' ' ORDER BY word_idx), ' ') AS text FROM w GROUP BY ALL")
def e5(spark, sf_dir):
    own = _timed_words(spark, sf_dir).groupBy("session_id", "segment_id").agg(F.array_sort(F.collect_list(F.struct("word_idx", "word"))).alias("words"))
    return own.select("session_id", "segment_id", W.turn_text(F.col("words")).alias("text"))


# -- speakers -----------------------------------------------------------------------------------------------------
@registry.add("f8_assign_labels", f"WITH {LABELED_SQL} SELECT session_id, id, speaker_no, label, color_index FROM l")
def f8(spark, sf_dir):
    return labeled(spark, sf_dir).select("session_id", "id", "speaker_no", "label", "color_index")


_RENAMES_SQL = """n AS (SELECT conv_id AS session_id, role AS speaker_id, turn AS seq, CASE WHEN turn % 4 = 3 THEN '  ' WHEN (conv_id + turn) % 3 <> 1 THEN ' Guest ' || turn || ' ' END AS new_name FROM conversations),
r AS (SELECT session_id, speaker_id, trim(max_by(new_name, seq) FILTER (new_name IS NOT NULL), ' ') AS name FROM n GROUP BY ALL)"""


def _renames(spark, sf_dir):
    """One a turn; null says nothing of the name."""
    name = F.when(F.col("turn") % 4 == 3, "  ").when((F.col("conv_id") + F.col("turn")) % 3 != 1, F.concat(F.lit(" Guest "), F.col("turn").cast("string"), F.lit(" ")))
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("role").alias("speaker_id"), F.col("turn").alias("seq"), name.alias("new_name"))


_DISPLAY = "CASE WHEN coalesce(name, '') <> '' THEN name || ' (' || label || ')' ELSE label END"


@registry.add("f10_rename_speakers", f"WITH {LABELED_SQL}, {_RENAMES_SQL} SELECT DISTINCT l.session_id, l.speaker_id, color_index, nullif(name, '') AS custom_name, {_DISPLAY} AS display_name FROM l LEFT JOIN r ON l.session_id = r.session_id AND l.speaker_id = r.speaker_id")
def f10(spark, sf_dir):
    return S.rename_speakers(S.speaker_dimension(u(spark, sf_dir)), _renames(spark, sf_dir)).select("session_id", "speaker_id", "color_index", "custom_name", "display_name")


@registry.add("f10_unknown_renames", f"WITH {UTTERANCES_SQL}, {_RENAMES_SQL} SELECT session_id, CASE WHEN seq % 3 = 0 THEN speaker_id || '?' ELSE speaker_id END AS speaker_id, seq, new_name FROM n WHERE seq % 3 = 0")
def f10u(spark, sf_dir):
    """Renames of which each third names a speaker that nobody has heard of."""
    wrong = _renames(spark, sf_dir).withColumn("speaker_id", F.when(F.col("seq") % 3 == 0, F.concat("speaker_id", F.lit("?"))).otherwise(F.col("speaker_id")))
    return S.unknown_renames(u(spark, sf_dir), wrong).select("session_id", "speaker_id", "seq", "new_name")


@registry.add("f15_reset_speakers", f"WITH {UTTERANCES_SQL}, e AS (SELECT *, seq // 3 AS part FROM u), x AS (SELECT *, min(seq) OVER (PARTITION BY session_id, part, speaker_id) AS first_seq FROM e) SELECT session_id, seq, dense_rank() OVER (PARTITION BY session_id, part ORDER BY first_seq) AS speaker_no FROM x")
def f15(spark, sf_dir):
    """A new session at every third turn: its speakers are numbered from 1 again."""
    parts = u(spark, sf_dir).withColumn("_session", F.col("session_id")).withColumn("session_id", F.struct("_session", F.floor(F.col("seq") / 3).alias("part")))
    return S.assign_labels(parts).select(F.col("_session").alias("session_id"), "seq", "speaker_no")


@registry.add("f9_display_name", f"WITH {LABELED_SQL} SELECT session_id, id, CASE WHEN seq % 3 = 0 THEN 'Dr. ' || speaker_id || ' (' || label || ')' ELSE label END AS display_name FROM l")
def f9(spark, sf_dir):
    return labeled(spark, sf_dir).select("session_id", "id", C.display_name(F.col("label"), F.when(F.col("seq") % 3 == 0, F.concat(F.lit("Dr. "), "speaker_id"))).alias("display_name"))


@registry.add("f11_speaker_stats", f"WITH {UTTERANCES_SQL} SELECT session_id, speaker_id, count(*) AS total_utterances, max_by(end_ms, seq) AS last_heard_ms FROM u GROUP BY ALL")
def f11(spark, sf_dir):
    return S.speaker_dimension(u(spark, sf_dir).withColumn("end_time", F.col("end_ms"))).select("session_id", "speaker_id", "total_utterances", F.col("last_heard_time").alias("last_heard_ms"))


@registry.add("f12_active_speaker", f"WITH {UTTERANCES_SQL} SELECT session_id, max_by(speaker_id, seq) AS speaker_id FROM u GROUP BY session_id")
def f12(spark, sf_dir):
    return S.active_speaker(u(spark, sf_dir))


@registry.add("f13_relabel_history", f"WITH {LABELED_SQL}, {_RENAMES_SQL} SELECT l.session_id, id, {_DISPLAY} AS label FROM l LEFT JOIN r ON l.session_id = r.session_id AND l.speaker_id = r.speaker_id")
def f13(spark, sf_dir):
    rows = labeled(spark, sf_dir)
    return S.relabel_history(rows, S.rename_speakers(S.speaker_dimension(rows), _renames(spark, sf_dir))).select("session_id", "id", "label")


# -- features -----------------------------------------------------------------------------------------------------
_RATE = "CASE WHEN n_words > 0 AND dur_ms > 400 AND n_words / (dur_ms / 1000.0) >= 3.6 THEN 'fast' WHEN n_words >= 2 AND dur_ms > 400 AND n_words / (dur_ms / 1000.0) <= 1.6 THEN 'slow' ELSE 'normal' END"
_VOLUME = "CASE WHEN rms_db - base > 4.5 THEN 'loud' WHEN rms_db - base < -5 THEN 'quiet' ELSE 'normal' END"
_BASE = "coalesce(avg(rms_db) OVER (PARTITION BY session_id, speaker_id ORDER BY seq ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), -24.0) AS base"


@registry.add("g7_speech_rate", f"WITH {UTTERANCES_SQL} SELECT session_id, id, {_RATE} AS speech_rate, CASE WHEN n_words > 0 AND dur_ms > 400 THEN n_words * 60.0 / (dur_ms / 1000.0) END AS words_per_minute FROM u")
def g7(spark, sf_dir):
    s = F.col("dur_ms") / 1000.0
    return u(spark, sf_dir).select("session_id", "id", C.speech_rate(F.col("n_words"), s).alias("speech_rate"), C.words_per_minute(F.col("n_words"), s).alias("words_per_minute"))


@registry.add("g8_rms_baseline", f"WITH {UTTERANCES_SQL}, v AS (SELECT *, CASE WHEN seq % 3 <> 2 THEN rms_db END AS r FROM u), c AS (SELECT *, coalesce(count(r) OVER (PARTITION BY session_id, speaker_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM v) SELECT session_id, id, round(coalesce(avg(r) OVER (PARTITION BY session_id, speaker_id ORDER BY n RANGE BETWEEN 2 PRECEDING AND 1 PRECEDING), -24.0), 6) AS rms_baseline FROM c")
def g8(spark, sf_dir):
    rows = u(spark, sf_dir).withColumn("r", F.when(F.col("seq") % 3 != 2, F.col("rms_db")))
    return A.rolling_baseline(rows, "r", "b", ["session_id", "speaker_id"], 2, default=-24.0).select("session_id", "id", F.round("b", 6).alias("rms_baseline"))


@registry.add("g9_relative_volume", f"WITH {UTTERANCES_SQL}, b AS (SELECT *, {_BASE} FROM u) SELECT session_id, id, {_VOLUME} AS relative_volume, CASE WHEN rms_db > -18 THEN 'loud' WHEN rms_db < -32 THEN 'quiet' ELSE 'normal' END AS absolute_volume FROM b")
def g9(spark, sf_dir):
    rows = A.rms_baseline(u(spark, sf_dir))
    return rows.select("session_id", "id", C.relative_volume(F.col("rms_db"), F.col("rms_baseline")).alias("relative_volume"), C.relative_volume(F.col("rms_db")).alias("absolute_volume"))


@registry.add("g10_pitch_baseline", f"WITH {UTTERANCES_SQL}, c AS (SELECT *, coalesce(count(*) FILTER (mean_pitch_hz > 120) OVER (PARTITION BY session_id, speaker_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM u) SELECT session_id, id, quantile_cont(CASE WHEN mean_pitch_hz > 120 THEN mean_pitch_hz END, 0.5) OVER (PARTITION BY session_id, speaker_id ORDER BY n RANGE BETWEEN 20 PRECEDING AND 1 PRECEDING) AS pitch_baseline FROM c")
def g10(spark, sf_dir):
    return A.rolling_baseline(u(spark, sf_dir), "mean_pitch_hz", "pitch_baseline", ["session_id", "speaker_id"], stat="median", qualifies=F.col("mean_pitch_hz") > 120).select("session_id", "id", "pitch_baseline")


@registry.add("g11_long_pause_before", f"WITH {UTTERANCES_SQL} SELECT session_id, id, greatest(0, start_ms - lag(end_ms, 1, 0) OVER (PARTITION BY session_id ORDER BY seq)) >= 1200 AS long_pause_before FROM u")
def g11(spark, sf_dir):
    return U.long_pause_before(u(spark, sf_dir)).select("session_id", "id", "long_pause_before")


@registry.add("g12_prosody_defaults", f"WITH {UTTERANCES_SQL}, b AS (SELECT *, {_BASE} FROM u) SELECT session_id, id, CASE WHEN n_words = 0 THEN 'normal' ELSE {_RATE} END AS speech_rate, CASE WHEN n_words = 0 THEN 'normal' ELSE {_VOLUME} END AS relative_volume, CASE WHEN n_words > 0 THEN rms_db END AS rms_db FROM b")
def g12(spark, sf_dir):
    rows = A.utterance_features(u(spark, sf_dir).withColumn("seconds", F.col("dur_ms") / 1000.0))
    heard = F.col("n_words") > 0
    return rows.select("session_id", "id", F.when(heard, F.col("speech_rate")).otherwise("normal").alias("speech_rate"), F.when(heard, F.col("relative_volume")).otherwise("normal").alias("relative_volume"), F.when(heard, F.col("rms_db")).alias("rms_db"))


# -- fusion and presentation --------------------------------------------------------------------------------------
_OVERLAP_SQL = f"""{LABELED_SQL},
p AS (SELECT *, list({{'e': end_ms, 's': speaker_id, 'l': label}}) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS prev FROM l),
o AS (SELECT * EXCLUDE (prev), coalesce(list_sort(list_distinct(list_transform(list_filter(prev, lambda x: start_ms < x.e - 200 AND x.s <> speaker_id), lambda x: x.l))), []) AS others FROM p)"""


def overlapped(spark, sf_dir):
    ms = labeled(spark, sf_dir).withColumns({"_s": F.col("start_time"), "_e": F.col("end_time"), "start_time": F.col("start_ms"), "end_time": F.col("end_ms")})
    return U.temporal_overlap(ms, slack_s=200).withColumns({"start_time": F.col("_s"), "end_time": F.col("_e")}).drop("_s", "_e")


@registry.add("i1_temporal_overlap", f"WITH {_OVERLAP_SQL} SELECT session_id, id, len(others) > 0 AS overlap, array_to_string(others, '|') AS overlapping_speakers FROM o")
def i1(spark, sf_dir):
    return overlapped(spark, sf_dir).select("session_id", "id", "overlap", F.array_join("overlapping_speakers", "|").alias("overlapping_speakers"))


@registry.add("i1b_interval_overlap_join", f"""WITH {UTTERANCES_SQL} SELECT a.session_id, a.id AS a, b.id AS b, least(a.end_ms, b.end_ms) - b.start_ms AS shared_ms FROM u a JOIN u b ON a.session_id = b.session_id AND a.speaker_id <> b.speaker_id
AND (a.start_ms < b.start_ms OR (a.start_ms = b.start_ms AND a.seq < b.seq)) AND b.start_ms < a.end_ms - 200 AND a.start_ms < b.end_ms - 200""")
def i1b(spark, sf_dir):
    return U.interval_overlap_join(u(spark, sf_dir))


@registry.add("i2_overlap_flag", f"WITH {_OVERLAP_SQL} SELECT session_id, id, len(others) > 0 OR seq % 5 = 0 AS overlap, array_to_string(list_sort(list_distinct(list_concat(others, CASE WHEN seq % 5 = 0 THEN ['Speaker Z'] ELSE [] END))), '|') AS overlapping_speakers FROM o")
def i2(spark, sf_dir):
    also = F.col("seq") % 5 == 0
    rows = overlapped(spark, sf_dir).withColumns({"temporal_overlap": F.col("overlap"), "temporal_labels": F.col("overlapping_speakers"), "acoustic_overlap": also, "acoustic_labels": F.when(also, F.array(F.lit("Speaker Z"))).otherwise(F.array())})
    return U.overlap_flag(rows).select("session_id", "id", "overlap", F.array_join("overlapping_speakers", "|").alias("overlapping_speakers"))


@registry.add("i3_recent_utterances", f"WITH {UTTERANCES_SQL} SELECT session_id, id FROM u QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) <= 3")
def i3(spark, sf_dir):
    return U.recent_utterances(u(spark, sf_dir), 3).select("session_id", "id")


@registry.add("i4_upsert_captions", f"WITH {UTTERANCES_SQL} SELECT session_id, speaker_id AS id, min(seq) AS position, max_by(text, seq) AS text, max(seq) AS seq FROM u GROUP BY ALL")
def i4(spark, sf_dir):
    return U.upsert_captions(u(spark, sf_dir).select("session_id", F.col("speaker_id").alias("id"), "seq", "text"))


_TAGS_SQL = f"list_filter([CASE WHEN mean_pitch_hz > 220 THEN 'rising' END, CASE WHEN mean_pitch_hz < 130 THEN 'falling' END, CASE WHEN rms_db > -13 THEN 'emphasis' END, CASE WHEN pause THEN 'pause' END, CASE WHEN {_RATE} <> 'normal' THEN {_RATE} END, CASE WHEN {_VOLUME} <> 'normal' THEN {_VOLUME} END], lambda x: x IS NOT NULL)"
_FEATURES_SQL = f"{_OVERLAP_SQL}, b AS (SELECT *, {_BASE}, greatest(0, start_ms - lag(end_ms, 1, 0) OVER (PARTITION BY session_id ORDER BY seq)) >= 1200 AS pause FROM o), t AS (SELECT *, {_TAGS_SQL} AS tags FROM b)"


def tagged(spark, sf_dir):
    rows = A.utterance_features(overlapped(spark, sf_dir).withColumn("seconds", F.col("dur_ms") / 1000.0))
    return rows.withColumn("tags", U.prosody_tags(F.col("mean_pitch_hz") > 220, F.col("mean_pitch_hz") < 130, F.col("rms_db") > -13, F.col("long_pause_before"), F.col("speech_rate"), F.col("relative_volume")))


@registry.add("i5_caption_view", f"WITH {_FEATURES_SQL}, {SETTINGS_SQL} SELECT session_id, id, seq, CASE WHEN show_captions THEN text END AS text, CASE WHEN show_speaker_identities THEN label END AS label, CASE WHEN show_overlap_indicators THEN len(others) > 0 END AS overlap, CASE WHEN show_prosody_cues AND seq % 4 <> 3 AND len(tags) > 0 THEN array_to_string(tags, ' ') END AS tags FROM t JOIN g USING (session_id)")
def i5(spark, sf_dir):
    view = U.caption_view(tagged(spark, sf_dir).withColumn("is_final", F.col("seq") % 4 != 3), settings(spark, sf_dir))
    return view.withColumn("tags", F.array_join("tags", " "))


@registry.add("i6_prosody_tags", f"WITH {_FEATURES_SQL} SELECT session_id, id, array_to_string(tags, ' ') AS tags FROM t")
def i6(spark, sf_dir):
    return tagged(spark, sf_dir).select("session_id", "id", F.array_join("tags", " ").alias("tags"))


@registry.add("i7_format_mmss", f"WITH {UTTERANCES_SQL}, z AS (SELECT session_id, id, CASE WHEN start_ms * 7.0 / 1000 < 0 THEN 0 ELSE start_ms * 7.0 / 1000 END AS start_time FROM u) SELECT session_id, id, {MMSS} AS shown FROM z")
def i7(spark, sf_dir):
    return u(spark, sf_dir).select("session_id", "id", C.format_mmss(F.col("start_ms") * 7.0 / 1000).alias("shown"))


@registry.add("i8_overlap_banner", f"WITH {_OVERLAP_SQL} SELECT session_id, id, array_to_string(list_concat([label], list_filter(others, lambda x: x <> label)), '|') AS speakers, end_ms AS shown_from, end_ms + 3500 AS shown_to FROM o WHERE len(others) > 0")
def i8(spark, sf_dir):
    rows = U.overlap_banner(overlapped(spark, sf_dir).withColumn("end_time", F.col("end_ms")), 3500)
    return rows.withColumn("speakers", F.array_join("speakers", "|"))


@registry.add("i9_attach_direction", f"WITH {UTTERANCES_SQL}, {SETTINGS_SQL} SELECT session_id, id, CASE WHEN show_speaker_direction THEN CASE speaker_id WHEN 'user' THEN 45.0 ELSE 0.0 END END AS angle_degrees, CASE WHEN show_speaker_direction THEN CASE speaker_id WHEN 'user' THEN 'right' ELSE 'front' END END AS label FROM u JOIN g USING (session_id)")
def i9(spark, sf_dir):
    rows = u(spark, sf_dir)
    positions = rows.filter("speaker_id = 'user'").select("speaker_id").distinct().select("speaker_id", F.lit(45.0).alias("angle_degrees"), F.lit("right").alias("direction"), F.lit(False).alias("simulated"), F.lit(0.9).alias("direction_confidence"))
    return U.attach_direction(rows, positions, settings(spark, sf_dir)).select("session_id", "id", "direction.angle_degrees", "direction.label")


@registry.add("i11_script_timeline", """WITH s AS (SELECT conv_id AS session_id, turn AS seq, coalesce(text, '') AS text, string_split(coalesce(text, ''), ' ') AS w, CASE WHEN turn % 3 = 0 THEN 1500 ELSE 250 * turn END / 1000.0 AS delay FROM conversations),
c AS (SELECT *, sum(delay + CASE WHEN len(w) > 3 THEN 0.5 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY seq) AS f FROM s)
SELECT session_id, seq, true AS is_final, text, round(f, 2)::DOUBLE AS start_time, round(f + 1.6, 2)::DOUBLE AS end_time FROM c
UNION ALL SELECT session_id, seq, false, array_to_string(w[1:len(w) // 2], ' ') || '...', round(f - 0.5, 2)::DOUBLE, round(f - 0.5 + 0.8, 2)::DOUBLE FROM c WHERE len(w) > 3""")
def i11(spark, sf_dir):
    script = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), F.coalesce("text", F.lit("")).alias("text"), F.when(F.col("turn") % 3 != 0, 250 * F.col("turn")).alias("delay_ms"))
    return U.script_timeline(script)


@registry.add("i12_utterance_assemble", f"WITH {LABELED_SQL} SELECT sha256(session_id || '|' || seq || '|0') AS id, session_id, speaker_id, label AS speaker_label, color_index AS speaker_color_index, coalesce(nullif(text, ''), '[Speech detected]') AS text, true AS is_final, false AS overlap FROM l")
def i12(spark, sf_dir):
    turns = labeled(spark, sf_dir).drop("created_at").withColumns({"segment_id": F.col("seq"), "turn_idx": F.lit(0), "speaker_label": F.col("label"), "speaker_color_index": F.col("color_index"), "segment_text": F.lit("")})
    return U.assemble_utterances(turns).select("id", "session_id", "speaker_id", "speaker_label", "speaker_color_index", "text", "is_final", "overlap")


@registry.add("i13_session_reset", f"WITH {UTTERANCES_SQL} SELECT session_id, seq, sum(CASE WHEN speaker_id = 'system' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY seq)::BIGINT AS epoch FROM u")
def i13(spark, sf_dir):
    rows = u(spark, sf_dir)
    return U.start_epoch(rows, rows.filter("speaker_id = 'system'"))


@registry.add("i15_effective_settings", "WITH m AS (SELECT conv_id AS session_id, turn AS seq, CASE WHEN turn % 2 = 0 THEN conv_id % 2 = 0 END AS privacy_mode, turn % 3 = 0 AS save_transcript, CASE WHEN turn > 2 THEN false END AS show_captions FROM conversations), x AS (SELECT session_id, arg_max(m, seq) AS r FROM m GROUP BY session_id) SELECT session_id, coalesce(r.privacy_mode, true) AS privacy_mode, coalesce(r.save_transcript, false) AND NOT coalesce(r.privacy_mode, true) AS save_transcript, coalesce(r.show_captions, true) AS show_captions FROM x")
def i15(spark, sf_dir):
    m = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), F.when(F.col("turn") % 2 == 0, F.col("conv_id") % 2 == 0).alias("privacy_mode"), (F.col("turn") % 3 == 0).alias("save_transcript"), F.when(F.col("turn") > 2, F.lit(False)).alias("show_captions"))
    return U.effective_settings(m).select("session_id", "privacy_mode", "save_transcript", "show_captions")


@registry.add("i16_caption_stats", f"WITH {UTTERANCES_SQL} SELECT session_id, id, array_to_string(list_filter([CASE WHEN seq % 3 > 0 THEN floor(mean_pitch_hz + 0.5)::BIGINT || ' Hz' END, floor(mean_pitch_hz - 10 + 0.5)::BIGINT || '–' || floor(mean_pitch_hz + 15 + 0.5)::BIGINT || ' Hz range', CASE WHEN n_words > 0 AND dur_ms > 400 THEN floor(n_words * 60.0 / (dur_ms / 1000.0) + 0.5)::BIGINT || ' WPM' END, printf('%.1f', rms_db + 0.07) || ' dBFS', CASE WHEN seq % 2 = 0 THEN '+' || printf('%.1f', seq::DOUBLE + 0.3) || ' ST' ELSE printf('%.1f', -seq::DOUBLE - 0.3) || ' ST' END], lambda x: x IS NOT NULL), '; ') AS stats FROM u")
def i16(spark, sf_dir):
    p, q = F.col("mean_pitch_hz"), F.col("seq").cast("double")
    stats = U.caption_stats(F.when(F.col("seq") % 3 > 0, p), p - 10, p + 15, F.lit(None).cast("double"), C.words_per_minute(F.col("n_words"), F.col("dur_ms") / 1000.0), F.col("rms_db") + 0.07, F.when(F.col("seq") % 2 == 0, q + 0.3).otherwise(-q - 0.3))
    return u(spark, sf_dir).select("session_id", "id", F.array_join(stats, "; ").alias("stats"))


# -- reports ------------------------------------------------------------------------------------------------------
_LOG_SQL = f"{UTTERANCES_SQL}, e AS (SELECT session_id, CASE seq % 4 WHEN 3 THEN 'vad_state' WHEN 2 THEN 'prosody_state' ELSE 'utterance' END AS type, seq % 5 <> 1 AS is_final, CASE WHEN n_words % 3 = 0 THEN '[Speech detected]' ELSE text END AS text, speaker_id, CASE WHEN seq = 0 THEN 'front' END AS direction FROM u)"


def _log(spark, sf_dir):
    kind = F.when(F.col("seq") % 4 == 3, "vad_state").when(F.col("seq") % 4 == 2, "prosody_state").otherwise("utterance")
    return u(spark, sf_dir).select("session_id", kind.alias("type"), (F.col("seq") % 5 != 1).alias("is_final"), F.when(F.col("n_words") % 3 == 0, "[Speech detected]").otherwise(F.col("text")).alias("text"), "speaker_id", F.when(F.col("seq") == 0, "front").alias("direction"))


@registry.add("j1_session_summary", f"""WITH {_LOG_SQL} SELECT session_id, count(*) FILTER (type = 'utterance' AND is_final) AS final_captions, count(*) FILTER (type = 'utterance' AND NOT is_final) AS interim_captions,
count(*) FILTER (type = 'utterance' AND is_final AND trim(text, ' ') <> '' AND text <> '[Speech detected]') AS recognized_captions, count(*) FILTER (type = 'vad_state') AS vad_rows, count(*) FILTER (type = 'prosody_state') AS live_rows,
count(DISTINCT CASE WHEN type = 'utterance' AND is_final THEN speaker_id END) AS speakers, count(*) FILTER (type = 'utterance' AND is_final AND direction IS NULL) AS directionless FROM e GROUP BY session_id""")
def j1(spark, sf_dir):
    return R.session_summary(_log(spark, sf_dir))


_TRANSITIONS = "x AS (SELECT session_id, speaker_id <> lag(speaker_id) OVER (PARTITION BY session_id ORDER BY seq) AS t FROM u), n AS (SELECT session_id, count(*) FILTER (t) AS transitions FROM x GROUP BY session_id)"


@registry.add("j5_turn_transitions", f"WITH {UTTERANCES_SQL}, {_TRANSITIONS} SELECT * FROM n")
def j5(spark, sf_dir):
    return R.turn_transitions(u(spark, sf_dir))


@registry.add("j6_question_intonation", f"WITH {UTTERANCES_SQL}, q AS (SELECT session_id, CASE WHEN seq % 2 = 0 THEN text || '?' ELSE text END AS text, mean_pitch_hz > 180 AS r FROM u) SELECT session_id, count(*) FILTER (text LIKE '%?%') AS questions, count(*) FILTER (text LIKE '%?%' AND r) AS rising_questions, CASE WHEN count(*) FILTER (text LIKE '%?%') > 0 THEN count(*) FILTER (text LIKE '%?%' AND r) / count(*) FILTER (text LIKE '%?%') END AS rising_share FROM q GROUP BY session_id")
def j6(spark, sf_dir):
    return R.question_intonation(u(spark, sf_dir).withColumns({"text": F.when(F.col("seq") % 2 == 0, F.concat("text", F.lit("?"))).otherwise(F.col("text")), "rising_intonation": F.col("mean_pitch_hz") > 180}))


@registry.add("j7_domain_checks", f"WITH {UTTERANCES_SQL}, {_TRANSITIONS} SELECT session_id, true AS rates_ok, true AS volumes_ok, count(DISTINCT speaker_id) AS speakers, transitions, count(DISTINCT speaker_id) >= 2 AND transitions >= 3 AS passed FROM u JOIN n USING (session_id) GROUP BY session_id, transitions")
def j7(spark, sf_dir):
    return R.domain_checks(A.utterance_features(u(spark, sf_dir).withColumn("seconds", F.col("dur_ms") / 1000.0)))


@registry.add("j8_speaker_turn_counts", f"WITH {UTTERANCES_SQL} SELECT session_id, speaker_id, count(*) AS turns FROM u GROUP BY ALL")
def j8(spark, sf_dir):
    return R.speaker_turn_counts(u(spark, sf_dir))


@registry.add("j9_realtime_factor", f"WITH {UTTERANCES_SQL} SELECT session_id, sum(100 + 7 * n_words) / sum(dur_ms) AS realtime_factor FROM u GROUP BY session_id")
def j9(spark, sf_dir):
    return R.realtime_factor(u(spark, sf_dir).select("session_id", (100 + 7 * F.col("n_words")).alias("processing_ms"), F.col("dur_ms").alias("audio_ms")))


@registry.add("j10_tokenize", f"WITH {UTTERANCES_SQL} SELECT session_id, id, array_to_string(regexp_extract_all(lower(text), '[a-z0-9'']+'), ' ') AS tokens FROM u")
def j10(spark, sf_dir):
    return u(spark, sf_dir).select("session_id", "id", F.array_join(C.tokenize(F.col("text")), " ").alias("tokens"))


#: the second text has no fifth word, and "#", which no word is, for each seventh: so many edits are the fewest, at any length
_EDIT_SQL = f"""{UTTERANCES_SQL}, k0 AS (SELECT session_id, id, regexp_extract_all(lower(text), '[a-z0-9'']+') AS k FROM u),
k1 AS (SELECT *, len(k) - len([x FOR x, i IN k IF i % 5 = 0]) AS c, len([x FOR x, i IN k IF i % 5 = 0 OR i % 7 = 0]) AS edits FROM k0)"""


def _edited_words(spark, sf_dir):
    other = F.transform(F.filter(F.transform("k", lambda x, i: F.struct(x.alias("x"), (i + 1).alias("i"))), lambda y: y["i"] % 5 != 0), lambda y: F.when(y["i"] % 7 == 0, "#").otherwise(y["x"]))
    return u(spark, sf_dir).withColumn("k", C.tokenize(F.col("text"))).withColumn("c", other)


@registry.add("j11_token_edit_rate", f"WITH {_EDIT_SQL} SELECT session_id, id, CASE WHEN len(k) > 0 THEN round(edits / len(k), 3) END AS token_edit_rate FROM k1")
def j11(spark, sf_dir):
    return _edited_words(spark, sf_dir).select("session_id", "id", R.token_edit_rate(F.col("k"), F.col("c")).alias("token_edit_rate"))


@registry.add("j12_condition_report", f"""WITH {_EDIT_SQL} SELECT id AS clip_id, 'clean' AS condition, 1 AS captions, len(k) AS recognized, CASE WHEN len(k) > 0 THEN 0.0 END AS token_edit_rate FROM k1
UNION ALL SELECT id, 'pink 10 dB', 1, c, CASE WHEN len(k) > 0 THEN round(len([x FOR x, i IN k IF i % 5 = 0]) / len(k), 3) END FROM k1""")
def j12(spark, sf_dir):
    return _condition_report(_dropped(spark, sf_dir), pink_10_dB="c")


def _dropped(spark, sf_dir):
    """All tokens of an utterance, and those without each fifth."""
    return u(spark, sf_dir).withColumn("k", C.tokenize(F.col("text"))).withColumn("c", F.filter("k", lambda x, i: (i + 1) % 5 != 0))


def _heard_again(spark, sf_dir):
    """The tokens of each turn, and as what was heard in its place those of the turn after it in its session: unlike texts
    of unlike lengths, so the fewest edits are any number of any kind."""
    own = u(spark, sf_dir).withColumn("k", C.tokenize(F.col("text")))
    return own.withColumn("c", F.coalesce(F.lead("k").over(Window.partitionBy("session_id").orderBy("seq")), F.array().cast("array<string>")))


@registry.add("j11b_whole_edit_rate")
def j11b(spark, sf_dir):
    return _heard_again(spark, sf_dir).select("session_id", "id", R.token_edit_rate(F.col("k"), F.col("c")).alias("token_edit_rate"))


def _condition_report(rows, **conditions):
    conditions = {"clean": "k"} | {k.replace("_", " "): v for k, v in conditions.items()}
    run = lambda name, words: rows.select(F.col("id").alias("clip_id"), F.lit(name).alias("condition"), F.lit(1).alias("captions"), F.size(words).cast("long").alias("recognized"), F.array_join(words, " ").alias("text"))
    return R.condition_report(reduce(DataFrame.unionByName, (run(name, c) for name, c in conditions.items())))


@registry.add("j12b_whole_condition_report")
def j12b(spark, sf_dir):
    """The turn after in place of a turn's own words, and both one after the other."""
    return _condition_report(_heard_again(spark, sf_dir).withColumn("both", F.concat("k", "c")), crosstalk="c", echo="both")


@registry.add("j13_privacy_audit", f"WITH {UTTERANCES_SQL}, {SETTINGS_SQL} SELECT session_id, count(*) AS rows FROM u JOIN g USING (session_id) WHERE privacy_mode GROUP BY session_id")
def j13(spark, sf_dir):
    return R.privacy_audit(u(spark, sf_dir), settings(spark, sf_dir))


@registry.add("j14_speaker_word_share", f"WITH {UTTERANCES_SQL} SELECT session_id, speaker_id, sum(dur_ms)::BIGINT AS talk_ms, sum(n_words)::BIGINT AS words, count(*) AS turns FROM u GROUP BY ROLLUP (session_id, speaker_id)")
def j14(spark, sf_dir):
    return R.speaker_word_share(u(spark, sf_dir))


@registry.add("j15_event_log_checks", f"""WITH {_OVERLAP_SQL}, e AS (SELECT *, CASE seq % 4 WHEN 3 THEN 'debug_metrics' WHEN 2 THEN 'speaker_list' ELSE 'utterance' END AS type FROM o)
SELECT session_id, count(DISTINCT CASE WHEN type = 'utterance' AND seq % 5 <> 1 THEN speaker_id END) >= 3 AS three_speakers, bool_or(type = 'utterance' AND len(others) > 0) AS overlap_seen, bool_or(type = 'utterance' AND rms_db > -15) AS cue_seen,
bool_and(CASE WHEN type = 'debug_metrics' THEN n_words % 2 = 0 ELSE true END) AS metrics_flagged, bool_or(type = 'speaker_list' AND label = 'Speaker B') AS rename_seen FROM e GROUP BY session_id""")
def j15(spark, sf_dir):
    kind = F.when(F.col("seq") % 4 == 3, "debug_metrics").when(F.col("seq") % 4 == 2, "speaker_list").otherwise("utterance")
    log = overlapped(spark, sf_dir).withColumns({"type": kind, "is_final": F.col("seq") % 5 != 1, "cue": F.col("rms_db") > -15, "simulated": F.col("n_words") % 2 == 0, "speaker_names": F.array("label"), "renamed_to": F.lit("Speaker B")})
    return R.event_log_checks(log)
