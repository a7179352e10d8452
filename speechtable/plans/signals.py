"""Queries on frames derived from `events`, turn embeddings from `embeddings`, and samples made from both."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import kernels as K
from ..operators import acoustics as A
from ..operators import exports as X
from ..operators import frames as FR
from ..operators import reports as R
from ..operators import segments as G
from ..operators import speakers as S
from ..sources import readers
from ..sources.derive import FRAMES_SQL, TURNS_SQL, frames, read, turn_embeddings
from .registry import Registry

registry = Registry()
SILENCE = 2


def f(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(read(spark, sf_dir, "events"))


# -- samples: each event is a short tone; its number sets the pitch and its type how loud it is ---------------------
N = 64
_SAMPLE_SQL = "round(0.001 * (((event_id * 31 + i * 17) % 1001) - 500), 3)"
SAMPLES_SQL = f"{FRAMES_SQL}, s AS (SELECT session_id, frame_idx, event_id, [{_SAMPLE_SQL} FOR i IN range({N})] AS x FROM f)"


def tone(event_id: Column) -> Column:
    """Samples of an event."""
    return F.transform(F.sequence(F.lit(0), F.lit(N - 1)), lambda i: F.round(0.001 * (((event_id * 31 + i * 17) % 1001) - 500), 3))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f(spark, sf_dir).select("session_id", "frame_idx", "event_id", tone(F.col("event_id")).alias("x"))


@registry.add("b2_normalize_frame", f"WITH {SAMPLES_SQL} SELECT event_id, len(list_concat(x, [0.0 FOR i IN range(512)])[1:512]) AS n, round(list_sum(x), 6) AS total FROM s")
def b2(spark, sf_dir):
    rows = samples(spark, sf_dir).withColumn("y", C.normalize_frame(F.col("x").cast("array<float>")))
    return rows.select("event_id", F.size("y").cast("long").alias("n"), F.round(F.aggregate("y", F.lit(0.0), lambda a, v: a + F.round(v.cast("double"), 3)), 6).alias("total"))


_MS = "list_sum([v::DOUBLE * v FOR v IN x]) / len(x)"


@registry.add("b3_frame_energy_db", f"WITH {SAMPLES_SQL} SELECT event_id, round(20 * log10(sqrt({_MS} + 1e-12) + 1e-12), 6) AS energy_db FROM s")
def b3(spark, sf_dir):
    return samples(spark, sf_dir).select("event_id", F.round(C.frame_energy_db(F.col("x")), 6).alias("energy_db"))


@registry.add("b4_energy_speech_prob", f"WITH {FRAMES_SQL} SELECT event_id, round(1 / (1 + exp(-(level_dbfs + 38.0) / 5.0)), 9) AS speech_prob FROM f")
def b4(spark, sf_dir):
    return f(spark, sf_dir).select("event_id", F.round(C.energy_speech_prob(F.col("level_dbfs")), 9).alias("speech_prob"))


@registry.add("b5_segment_rms_db", f"WITH {SAMPLES_SQL} SELECT event_id, CASE WHEN event_id % 5 = 0 THEN -100.0 ELSE round(20 * log10(sqrt({_MS} + 1e-12) + 1e-12), 6) END AS rms_db FROM s")
def b5(spark, sf_dir):
    x = F.when(F.col("event_id") % 5 == 0, F.array().cast("array<double>")).otherwise(F.col("x"))
    return samples(spark, sf_dir).select("event_id", F.round(C.segment_rms_db(x), 6).alias("rms_db"))


@registry.add("b7_retain_last", f"WITH {FRAMES_SQL} SELECT session_id, frame_idx FROM f QUALIFY frame_idx > max(frame_idx) OVER (PARTITION BY session_id) - 31")
def b7(spark, sf_dir):
    return FR.retain_last(f(spark, sf_dir), 1.0).select("session_id", "frame_idx")


@registry.add("b7_slice_samples", f"WITH {SAMPLES_SQL}, z AS (SELECT *, least(greatest(event_id % 80 - 8, 0), len(x)) AS a FROM s) SELECT event_id, len(x[a + 1:least(a + 10, len(x))]) AS n, round(coalesce(list_sum(x[a + 1:least(a + 10, len(x))]), 0), 6) AS total FROM z")
def b7s(spark, sf_dir):
    start = F.col("event_id") % 80 - 8
    rows = samples(spark, sf_dir).withColumn("y", C.slice_samples(F.col("x"), start, F.greatest(start, F.lit(0)) + 10))
    return rows.select("event_id", F.size("y").cast("long").alias("n"), F.round(F.aggregate("y", F.lit(0.0), lambda a, v: a + v), 6).alias("total"))


@registry.add("b8_input_level", f"WITH {SAMPLES_SQL} SELECT event_id, round(least(1.0, sqrt({_MS}) * 4), 6) AS input_level FROM s")
def b8(spark, sf_dir):
    return samples(spark, sf_dir).select("event_id", F.round(C.input_level(F.col("x")), 6).alias("input_level"))


@registry.add("b9_active_mask", f"WITH {FRAMES_SQL}, b AS (SELECT session_id, frame_idx, value / 1000.0 AS rms FROM f) SELECT session_id AS clip_id, frame_idx AS block_idx, rms >= greatest(0.008, 0.12 * quantile_cont(rms, 0.85) OVER (PARTITION BY session_id)) AS active FROM b")
def b9(spark, sf_dir):
    blocks = f(spark, sf_dir).select(F.col("session_id").alias("clip_id"), F.col("frame_idx").alias("block_idx"), (F.col("value") / 1000.0).alias("rms"))
    return FR.active_mask(blocks).select("clip_id", "block_idx", "active")


@registry.add("b11_mix_at_snr", f"""WITH {SAMPLES_SQL}, g AS (SELECT *, 2.0 * sqrt({_MS}) / pow(10.0, (event_id % 20) / 20.0) AS gain FROM s),
m AS (SELECT event_id, [x[i] + gain * x[len(x) + 1 - i] FOR i IN range(1, len(x) + 1)] AS y FROM g), p AS (SELECT *, list_max([abs(v) FOR v IN y]) AS peak FROM m)
SELECT event_id, round(list_sum([greatest(-1.0, least(1.0, v * CASE WHEN peak > 0.98 THEN 0.98 / peak ELSE 1.0 END)) * i FOR v, i IN y]), 4) AS moment, peak > 0.98 AS limited FROM p""")
def b11(spark, sf_dir):
    rows = samples(spark, sf_dir).withColumn("y", C.mix_at_snr(F.col("x"), F.reverse("x"), 2.0 * F.sqrt(C.mean_square(F.col("x"))), (F.col("event_id") % 20).cast("double")))
    gain = 2.0 * F.sqrt(C.mean_square(F.col("x"))) / F.pow(F.lit(10.0), (F.col("event_id") % 20) / 20.0)
    raw = C.let(gain, lambda g: F.array_max(F.transform(F.zip_with("x", F.reverse("x"), lambda s, n: s + n * g), F.abs)))
    return rows.select("event_id", F.round(F.aggregate(F.transform("y", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v), 4).alias("moment"), (raw > 0.98).alias("limited"))


# -- segmentation -------------------------------------------------------------------------------------------------
def vad_sql(frames_sql: str = FRAMES_SQL, silence: int = SILENCE) -> str:
    return f"""{frames_sql},
v0 AS (SELECT *, max(CASE WHEN voiced THEN frame_idx END) OVER (PARTITION BY session_id ORDER BY frame_idx) AS last_voiced, max(CASE WHEN voiced THEN frame_idx END) OVER (PARTITION BY session_id ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM f),
v1 AS (SELECT *, coalesce(frame_idx - last_voiced < {silence}, false) AS is_speaking, coalesce(frame_idx - last_voiced = {silence}, false) AS segment_ended, voiced AND (prev IS NULL OR frame_idx - prev > {silence}) AS segment_started FROM v0),
v AS (SELECT *, sum(segment_started::INT) OVER (PARTITION BY session_id ORDER BY frame_idx)::BIGINT AS segment_no FROM v1),
g0 AS (SELECT session_id, segment_no, min(frame_idx) FILTER (voiced) AS first_frame, max(frame_idx) FILTER (voiced) AS lv, max(frame_idx) AS seen, count(*) FILTER (voiced) AS voiced_frames FROM v WHERE segment_no > 0 GROUP BY ALL),
g AS (SELECT session_id, segment_no, first_frame, lv + {silence} - 1 AS last_frame, lv + {silence} AS end_frame, voiced_frames FROM g0 WHERE seen >= lv + {silence})"""


VAD_SQL = vad_sql()


def vad(spark, sf_dir):
    return G.vad_state(f(spark, sf_dir), SILENCE)


@registry.add("c1_voiced", f"WITH {FRAMES_SQL} SELECT event_id, 1 / (1 + exp(-(level_dbfs + 38.0) / 5.0)) >= 0.45 AS voiced FROM f")
def c1(spark, sf_dir):
    return f(spark, sf_dir).select("event_id", G.voiced(C.energy_speech_prob(F.col("level_dbfs"))).alias("voiced"))


@registry.add("c2_vad_state", f"WITH {VAD_SQL} SELECT session_id, frame_idx, is_speaking, segment_started, segment_ended FROM v")
def c2(spark, sf_dir):
    return vad(spark, sf_dir).select("session_id", "frame_idx", "is_speaking", "segment_started", "segment_ended")


@registry.add("c3_speech_segments", f"WITH {VAD_SQL} SELECT * FROM g")
def c3(spark, sf_dir):
    return G.speech_segments(vad(spark, sf_dir), SILENCE)


@registry.add("c4_min_segment_filter", f"WITH {VAD_SQL} SELECT session_id, segment_no FROM g WHERE (last_frame - first_frame + 1) * 512 > 2000")
def c4(spark, sf_dir):
    return G.min_segment_filter(G.speech_segments(vad(spark, sf_dir), SILENCE), 2000).select("session_id", "segment_no")


@registry.add("c5_segment_bounds", f"WITH {VAD_SQL} SELECT session_id, segment_no, round(greatest(0.0, (first_frame + 1) * 512 / 16000.0 - 0.15), 6)::DOUBLE AS start_time, round((end_frame + 1) * 512 / 16000.0, 6)::DOUBLE AS end_time FROM g")
def c5(spark, sf_dir):
    own = G.segment_bounds(G.speech_segments(vad(spark, sf_dir), SILENCE))
    return own.select("session_id", "segment_no", F.round("start_time", 6).alias("start_time"), F.round("end_time", 6).alias("end_time"))


@registry.add("c6_speech_duration", f"WITH {VAD_SQL} SELECT session_id, frame_idx, round(CASE WHEN is_speaking THEN sum(voiced::INT) OVER (PARTITION BY session_id, segment_no ORDER BY frame_idx) * 512 / 16000.0 ELSE 0 END, 6)::DOUBLE AS speech_duration_s FROM v")
def c6(spark, sf_dir):
    return G.speech_duration(vad(spark, sf_dir)).select("session_id", "frame_idx", F.round("speech_duration_s", 6).alias("speech_duration_s"))


@registry.add("c7_pause_duration", f"WITH {VAD_SQL} SELECT session_id, frame_idx, round((frame_idx - last_voiced) * 512 / 16000.0, 6)::DOUBLE AS pause_duration_s FROM v")
def c7(spark, sf_dir):
    return G.pause_duration(vad(spark, sf_dir)).select("session_id", "frame_idx", F.round("pause_duration_s", 6).alias("pause_duration_s"))


@registry.add("c8_interim_checkpoints", f"WITH {VAD_SQL}, x AS (SELECT session_id, segment_no, frame_idx, row_number() OVER (PARTITION BY session_id, segment_no ORDER BY frame_idx) AS collected FROM v WHERE is_speaking) SELECT * FROM x WHERE collected % 4 = 0")
def c8(spark, sf_dir):
    return G.interim_checkpoints(vad(spark, sf_dir), 0.128)


# -- live rows ----------------------------------------------------------------------------------------------------
LIVE_SQL = f"""{FRAMES_SQL},
p0 AS (SELECT *, coalesce(count(pitch_hz) OVER (PARTITION BY session_id ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n,
 coalesce(count(*) FILTER (voiced AND level_dbfs > -55) OVER (PARTITION BY session_id ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS m FROM f),
p1 AS (SELECT *, quantile_cont(pitch_hz, 0.5) OVER (PARTITION BY session_id ORDER BY n RANGE BETWEEN 12 PRECEDING AND 1 PRECEDING) AS hist,
 CASE WHEN voiced AND level_dbfs > -55 THEN level_dbfs END AS lv FROM p0),
p2 AS (SELECT *, CASE WHEN hist > 0 THEN 12 * log2(pitch_hz / hist) END AS change, quantile_cont(lv, 0.5) OVER (PARTITION BY session_id ORDER BY m RANGE BETWEEN 30 PRECEDING AND 1 PRECEDING) AS lm, count(lv) OVER (PARTITION BY session_id ORDER BY m RANGE BETWEEN 30 PRECEDING AND 1 PRECEDING) AS lc FROM p1),
p AS (SELECT *, CASE WHEN voiced AND lc >= 4 THEN level_dbfs - lm END AS rel, CASE WHEN pitch_hz IS NULL THEN 'unavailable' WHEN change >= 1.2 THEN 'rising' WHEN change <= -1.2 THEN 'falling' ELSE 'steady' END AS direction FROM p2)"""


@registry.add("h1_live_windows", f"WITH {FRAMES_SQL} SELECT session_id, frame_idx // 6 AS window_idx, max(frame_idx) AS last_frame, max_by(voiced, frame_idx) AS speech_active FROM f GROUP BY ALL HAVING count(*) = 6")
def h1(spark, sf_dir):
    return A.live_windows(f(spark, sf_dir)).select("session_id", "window_idx", "last_frame", "speech_active")


@registry.add("h2_live_level", f"WITH {FRAMES_SQL} SELECT session_id, frame_idx // 6 AS window_idx, round(10 * log10(greatest(avg(pow(10.0, level_dbfs / 10)), 1e-12)), 5) AS level_dbfs FROM f GROUP BY ALL HAVING count(*) = 6")
def h2(spark, sf_dir):
    return A.live_windows(f(spark, sf_dir)).select("session_id", "window_idx", F.round("level_dbfs", 5).alias("level_dbfs"))


@registry.add("h2_live_level_dbfs", f"WITH {SAMPLES_SQL} SELECT event_id, round(20 * log10(greatest(sqrt({_MS} + 1e-12), 1e-6)), 6) AS level_dbfs FROM s")
def h2s(spark, sf_dir):
    return samples(spark, sf_dir).select("event_id", F.round(C.live_level_dbfs(F.col("x")), 6).alias("level_dbfs"))


@registry.add("h3_live_speech_active", f"WITH {FRAMES_SQL} SELECT session_id, frame_idx // 6 AS window_idx, max_by(voiced, frame_idx) AS speech_active FROM f GROUP BY ALL HAVING count(*) = 6")
def h3(spark, sf_dir):
    return A.live_windows(f(spark, sf_dir)).select("session_id", "window_idx", "speech_active")


@registry.add("h4_live_pitch", f"WITH {FRAMES_SQL} SELECT session_id, frame_idx // 6 AS window_idx, CASE WHEN max_by(voiced, frame_idx) THEN quantile_cont(pitch_hz, 0.5) END AS pitch_hz FROM f GROUP BY ALL HAVING count(*) = 6")
def h4(spark, sf_dir):
    return A.live_windows(f(spark, sf_dir)).select("session_id", "window_idx", "pitch_hz")


@registry.add("h5_pitch_direction", f"WITH {LIVE_SQL} SELECT session_id, frame_idx, direction AS pitch_direction, round(change, 6) AS pitch_change FROM p")
def h5(spark, sf_dir):
    return A.pitch_direction(f(spark, sf_dir)).select("session_id", "frame_idx", "pitch_direction", F.round("pitch_change", 6).alias("pitch_change"))


@registry.add("h6_relative_level", f"WITH {LIVE_SQL} SELECT session_id, frame_idx, round(rel, 6) AS relative_level_db FROM p")
def h6(spark, sf_dir):
    return A.relative_level(f(spark, sf_dir)).select("session_id", "frame_idx", F.round("relative_level_db", 6).alias("relative_level_db"))


@registry.add("h7_emphasis_candidate", f"WITH {LIVE_SQL} SELECT session_id, frame_idx, coalesce(voiced AND rel >= 6 AND abs(change) >= 1.5, false) AS emphasis_candidate FROM p")
def h7(spark, sf_dir):
    return A.live_features(f(spark, sf_dir)).select("session_id", "frame_idx", "emphasis_candidate")


@registry.add("h8_live_wpm", f"""WITH {FRAMES_SQL}, r AS (SELECT session_id, frame_idx, CASE WHEN event_type = 'signup' THEN value END AS wpm FROM f WHERE event_type IN ('signup', 'error'))
SELECT f.session_id, f.frame_idx AS "at", f.voiced, CASE WHEN f.voiced THEN r.wpm END AS speech_rate_wpm FROM f ASOF LEFT JOIN r ON f.session_id = r.session_id AND f.frame_idx >= r.frame_idx""")
def h8(spark, sf_dir):
    rows = f(spark, sf_dir)
    live = rows.select("session_id", F.col("frame_idx").alias("at"), "voiced")
    rates = rows.filter("event_type in ('signup', 'error')").select("session_id", F.col("frame_idx").alias("at"), F.when(F.col("event_type") == "signup", F.col("value")).alias("wpm"))
    return A.live_wpm(live, rates)


_LIVE = f"{FRAMES_SQL}, t AS (SELECT *, frame_idx * 0.125 + frame_idx // 13 AS timestamp_s FROM f)"


def timed(spark, sf_dir):
    return f(spark, sf_dir).withColumn("timestamp_s", F.col("frame_idx") * 0.125 + F.floor(F.col("frame_idx") / 13))


@registry.add("h9_live_validate", f"WITH {FRAMES_SQL} SELECT session_id, frame_idx, value - 20 >= 0 AND coalesce(pitch_hz - 90 > 0, true) AS valid, greatest(level_dbfs + 55, 0) AS pause_duration_s FROM f")
def h9(spark, sf_dir):
    rows = f(spark, sf_dir).withColumns({"timestamp_s": F.col("value") - 20, "pitch_hz": F.col("pitch_hz") - 90, "speech_rate_wpm": F.lit(None).cast("double"), "pause_duration_s": F.col("level_dbfs") + 55})
    return A.live_validate(rows).select("session_id", "frame_idx", "valid", "pause_duration_s")


@registry.add("h10_live_tail", f"WITH {FRAMES_SQL}, t AS (SELECT session_id, frame_idx, frame_idx * 0.25 AS s FROM f), l AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY s DESC) <= 30) SELECT session_id, frame_idx FROM l QUALIFY s >= max(s) OVER (PARTITION BY session_id) - 6")
def h10(spark, sf_dir):
    return A.live_tail(f(spark, sf_dir).withColumn("timestamp_s", F.col("frame_idx") * 0.25), 30, 6.0).select("session_id", "frame_idx")


@registry.add("h11_series_runs", f"WITH {_LIVE}, c AS (SELECT *, pitch_hz IS NULL OR lag(timestamp_s) OVER w IS NULL OR timestamp_s - lag(timestamp_s) OVER w > 0.7 AS cut FROM t WINDOW w AS (PARTITION BY session_id ORDER BY timestamp_s)), r AS (SELECT *, sum(cut::INT) OVER (PARTITION BY session_id ORDER BY timestamp_s)::BIGINT AS run_id FROM c) SELECT session_id, frame_idx, run_id FROM r WHERE NOT cut")
def h11(spark, sf_dir):
    return A.series_runs(timed(spark, sf_dir), "pitch_hz").select("session_id", "frame_idx", "run_id")


@registry.add("h12_series_clamp", f"WITH {FRAMES_SQL} SELECT session_id, frame_idx, CASE WHEN voiced THEN least(400.0, greatest(70.0, pitch_hz + 60)) END AS pitch_drawn, CASE WHEN voiced THEN least(-6.0, greatest(-50.0, level_dbfs)) END AS level_drawn, CASE WHEN voiced THEN least(300.0, greatest(0.0, value * 5)) END AS wpm_drawn FROM (SELECT * REPLACE (pitch_hz AS pitch_hz) FROM f WHERE pitch_hz IS NOT NULL) UNION ALL SELECT session_id, frame_idx, NULL, CASE WHEN voiced THEN least(-6.0, greatest(-50.0, level_dbfs)) END, CASE WHEN voiced THEN least(300.0, greatest(0.0, value * 5)) END FROM f WHERE pitch_hz IS NULL")
def h12(spark, sf_dir):
    rows = f(spark, sf_dir).withColumns({"pitch_hz": F.col("pitch_hz") + 60, "speech_rate_wpm": F.col("value") * 5})
    return A.series_clamp(rows).select("session_id", "frame_idx", "pitch_drawn", "level_drawn", "wpm_drawn")


@registry.add("h13_live_latest", f"WITH {LIVE_SQL} SELECT session_id, max(frame_idx) AS frame_idx, CASE WHEN max_by(voiced, frame_idx) THEN 'speaking' ELSE 'silent' END AS status FROM p GROUP BY session_id")
def h13(spark, sf_dir):
    rows = A.live_features(f(spark, sf_dir)).withColumn("timestamp_s", F.col("frame_idx"))
    return A.live_latest(rows).select("session_id", F.col("timestamp_s").alias("frame_idx"), "status")


# -- speakers by embedding ----------------------------------------------------------------------------------------
CENTROID_SQL = f"""{TURNS_SQL},
x AS (SELECT session_id, label, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS i FROM t),
m AS (SELECT session_id, label, i, avg(v) AS v FROM x GROUP BY ALL),
c AS (SELECT session_id, label, list(v ORDER BY i) AS mean, sqrt(sum(v * v)) AS norm FROM m GROUP BY ALL)"""


def turns(spark, sf_dir):
    return turn_embeddings(read(spark, sf_dir, "embeddings"))


def centroids(spark, sf_dir):
    own = S.speaker_centroids(turns(spark, sf_dir).withColumnRenamed("label", "speaker_id"))
    return own.withColumn("reg_idx", F.col("speaker_id"))


@registry.add("f6_speaker_centroids", f"WITH {CENTROID_SQL} SELECT session_id, label AS speaker_id, round(mean[1] / (norm + 1e-8), 6) AS first, round(list_sum([v / (norm + 1e-8) FOR v IN mean]), 5) AS total FROM c")
def f6(spark, sf_dir):
    return centroids(spark, sf_dir).select("session_id", "speaker_id", F.round(F.get("centroid", F.lit(0)), 6).alias("first"), F.round(F.aggregate("centroid", F.lit(0.0), lambda a, v: a + v), 5).alias("total"))


@registry.add("f4_nearest_speaker", f"WITH {CENTROID_SQL}, s AS (SELECT t.session_id, t.seq, c.label, list_dot_product(t.embedding::DOUBLE[], c.mean) / (norm + 1e-8) AS sim FROM t JOIN c USING (session_id)) SELECT session_id, seq, arg_max(label, round(sim, 9)) AS speaker_id, round(max(sim), 4) AS similarity FROM s GROUP BY ALL")
def f4(spark, sf_dir):
    return S.nearest_speaker(turns(spark, sf_dir).drop("label"), centroids(spark, sf_dir)).select("session_id", "seq", "speaker_id", F.round("similarity", 4).alias("similarity"))


_PAIRS = "q AS (SELECT session_id, seq, embedding AS b, lag(embedding) OVER (PARTITION BY session_id ORDER BY seq) AS a FROM t)"


@registry.add("f3_cosine_similarity", f"WITH {TURNS_SQL}, {_PAIRS} SELECT session_id, seq, round(list_dot_product(a::DOUBLE[], b::DOUBLE[]), 4) AS similarity FROM q WHERE a IS NOT NULL")
def f3(spark, sf_dir):
    return _pairs(spark, sf_dir).select("session_id", "seq", F.round(C.dot(F.col("left"), F.col("right")), 4).alias("similarity"))


def _pairs(spark, sf_dir):
    from pyspark.sql import Window

    before = F.lag("embedding").over(Window.partitionBy("session_id").orderBy("seq"))
    return turns(spark, sf_dir).withColumn("left", before).filter("left is not null").withColumnRenamed("embedding", "right")


@registry.add("e2_turn_similarity", f"WITH {TURNS_SQL}, {_PAIRS} SELECT session_id, seq, round(list_dot_product(a::DOUBLE[], b::DOUBLE[]), 4) AS similarity, list_dot_product(a::DOUBLE[], b::DOUBLE[]) < 0.25 AS split FROM q WHERE a IS NOT NULL")
def e2(spark, sf_dir):
    return S.turn_similarity(_pairs(spark, sf_dir)).select("session_id", "seq", F.round("similarity", 4).alias("similarity"), "split")


@registry.add("f7_match_confidence", f"WITH {TURNS_SQL}, {_PAIRS} SELECT session_id, seq, round(CASE WHEN seq % 5 = 0 THEN CASE WHEN seq % 10 = 0 THEN 1.0 ELSE 0.85 END ELSE least(1.0, greatest(0.0, (list_dot_product(a::DOUBLE[], b::DOUBLE[]) + 0.2) / 0.8)) END, 4) AS confidence FROM q WHERE a IS NOT NULL")
def f7(spark, sf_dir):
    return _pairs(spark, sf_dir).select("session_id", "seq", F.round(C.match_confidence(C.dot(F.col("left"), F.col("right")), F.col("seq") % 5 == 0, F.col("seq") % 10 == 0), 4).alias("confidence"))


@registry.add("f5_cluster_speakers")
def f5(spark, sf_dir):
    return S.cluster_speakers(turns(spark, sf_dir))


# -- sources, metrics, events -------------------------------------------------------------------------------------
_CONTROL = """CASE event_type WHEN 'click' THEN 'rename_speaker' WHEN 'view' THEN 'update_settings' WHEN 'purchase' THEN 'export_transcript' WHEN 'error' THEN 'error' END"""


@registry.add("a4_route_control_messages", f"SELECT event_id AS seq, {_CONTROL} AS type, CASE WHEN event_type <> 'error' THEN user_id::VARCHAR END AS session_id, CASE WHEN event_type = 'click' THEN 'n' || event_id END AS new_name FROM events WHERE event_type <> 'signup'")
def a4(spark, sf_dir):
    """A message an event: three known types, one unknown, one that isn't JSON."""
    is_ = lambda x: F.col("event_type") == x
    kind = F.when(is_("click"), "rename_speaker").when(is_("view"), "update_settings").when(is_("purchase"), "export_transcript").otherwise("unheard_of")
    value = F.when(is_("error"), "{not json").otherwise(F.to_json(F.struct(kind.alias("type"), F.col("user_id").cast("string").alias("session_id"), F.when(is_("click"), F.concat(F.lit("n"), F.col("event_id").cast("string"))).alias("new_name"))))
    routed = readers.route_control_messages(read(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), value.alias("value")))
    kinds = ("rename_speaker", "update_settings", "export_transcript", "error")
    each = [routed[k].select("seq", "type", *(F.col(c) if c in routed[k].columns else F.lit(None).cast("string").alias(c) for c in ("session_id", "new_name"))) for k in kinds]
    return reduce(DataFrame.unionByName, each)


@registry.add("a1_read_pcm_packets", "SELECT user_id AS session_id, event_id AS packet_seq, repeat('x', (2 + event_id % 3 * 2)::INT) AS payload FROM events WHERE event_id % 4 <> 1")
def a1(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    raw = F.encode(F.repeat(F.lit("x"), F.when(F.col("event_id") % 4 == 1, 3).otherwise(2 + F.col("event_id") % 3 * 2).cast("int")), "UTF-8")
    messages = e.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("packet_seq"), F.when(F.col("event_id") % 2 == 0, raw).alias("payload"), F.when(F.col("event_id") % 2 == 1, F.to_json(F.struct(F.base64(raw).alias("pcm16_base64")))).alias("json"))
    return readers.read_pcm_packets(messages).select("session_id", "packet_seq", F.decode("payload", "UTF-8").alias("payload"))


#: packets of n samples, all 0.5 but for the first of a packet, which tells its number
_PACKETS_SQL = f"""{FRAMES_SQL}, k AS (SELECT session_id, frame_idx AS seq, CASE WHEN event_id % 3 = 0 THEN 550 ELSE 500 + event_id % 13 END AS n, event_id % 256 AS mark FROM f),
k1 AS (SELECT *, ceil(n / 512.0)::BIGINT AS own, coalesce(sum(ceil(n / 512.0)) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first FROM k),
fr AS (SELECT session_id, first + j AS frame_idx, CASE WHEN j = 0 THEN mark ELSE 64 END / 128.0 - CASE WHEN j = 0 AND mark >= 128 THEN 2 ELSE 0 END AS head, least(512, n - j * 512) AS filled FROM k1, LATERAL (SELECT unnest(range(own)) AS j))"""


@registry.add("b1_frame_pcm", f"WITH {_PACKETS_SQL} SELECT session_id, frame_idx, 512 AS n, round(head, 6)::DOUBLE AS first_sample, round(head + 0.5 * (filled - 1), 6)::DOUBLE AS total FROM fr")
def b1(spark, sf_dir):
    n = F.when(F.col("event_id") % 3 == 0, 550).otherwise(500 + F.col("event_id") % 13).cast("int")
    raw = F.unhex(F.concat(F.lit("00"), F.lpad(F.hex(F.col("event_id") % 256), 2, "0"), F.repeat(F.lit("0040"), n - 1)))  # little-endian: low byte first
    packets = f(spark, sf_dir).select("session_id", F.col("frame_idx").alias("packet_seq"), raw.alias("payload"))
    x = F.transform("samples", lambda v: v.cast("double"))
    return FR.frame_pcm(packets).select("session_id", "frame_idx", F.size("samples").alias("n"), F.round(F.get(x, F.lit(0)), 6).alias("first_sample"), F.round(F.aggregate(x, F.lit(0.0), lambda a, v: a + v), 6).alias("total"))


#: events that a task of a fan-out sorts
EVENTS = 250_000


@registry.add("a12_event_fanout", f"""WITH {VAD_SQL} SELECT session_id, frame_idx AS "at", 0 AS place, 'vad_state' AS type, '{{"is_speaking":' || is_speaking || ',"segment_started":' || segment_started || ',"segment_ended":' || segment_ended || '}}' AS data FROM v
UNION ALL SELECT session_id, max(frame_idx), 1, 'prosody_state', '{{"window_idx":' || frame_idx // 6 || ',"speech_active":' || max_by(voiced, frame_idx) || '}}' FROM f GROUP BY session_id, frame_idx // 6 HAVING count(*) = 6
UNION ALL SELECT session_id, end_frame, place, type, '{{"segment_no":' || segment_no || '}}' FROM g, (SELECT unnest([2, 3, 4]) AS place, unnest(['speaker_list', 'utterance', 'debug_metrics']) AS type)""")
def a12(spark, sf_dir):
    """Sessions are dealt out to so many tasks that each sorts about as many events, whatever the table's size."""
    e = read(spark, sf_dir, "events")
    dealt = frames(e.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-e.count() // EVENTS)), "user_id"))
    rows = G.vad_state(dealt, SILENCE)
    own = G.speech_segments(rows, SILENCE).select("session_id", F.col("end_frame").alias("at"), "segment_no")
    live = A.live_windows(dealt).select("session_id", F.col("last_frame").alias("at"), "window_idx", "speech_active")
    return X.event_fanout(rows.select("session_id", F.col("frame_idx").alias("at"), "is_speaking", "segment_started", "segment_ended"), live, own, own, own)


_METRICS = "m AS (SELECT user_id AS session_id, event_id, event_type AS stage, floor(value) AS ms, event_id % 4 = 0 AS simulated FROM events)"


def metrics(spark, sf_dir):
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), "event_id", F.floor("value").cast("double").alias("pipeline_processing_ms"), (F.col("event_id") % 4 == 0).alias("simulated"))


@registry.add("j2_latency_stats", f"WITH {_METRICS} SELECT session_id, count(*) AS n, round(quantile_cont(ms, 0.5), 2) AS median_ms, round(max(ms), 2) AS max_ms FROM m GROUP BY session_id")
def j2(spark, sf_dir):
    return R.latency_stats(metrics(spark, sf_dir), by=["session_id"])


@registry.add("j2b_merged_latency", f"WITH {_METRICS} SELECT count(*) AS n, round(max(ms), 2) AS max_ms, true AS median_within, true AS p95_within FROM m")
def j2b(spark, sf_dir):
    """A sketch a session, merged into one for all; whether the ranks of its quantiles are within 1 % of what they should be."""
    rows = metrics(spark, sf_dir)
    own = R.merged_latency(R.latency_sketches(rows, by=["session_id"]))
    ms = F.col("pipeline_processing_ms")
    apart = lambda c, q: F.greatest(F.count_if(ms < F.col(c)) / F.count("*") - q, q - F.count_if(ms <= F.col(c)) / F.count("*")) < 0.01
    ranks = rows.join(F.broadcast(own)).groupBy("n", "max_ms").agg(apart("median_ms", 0.5).alias("median_within"), apart("p95_ms", 0.95).alias("p95_within"))  # one row is joined
    return ranks.select("n", F.round("max_ms", 2).alias("max_ms"), "median_within", "p95_within")


_STAGE = "CASE event_id % 4 WHEN 0 THEN 'vad' WHEN 1 THEN 'asr' WHEN 2 THEN 'diarization' ELSE 'prosody' END"


@registry.add("j3_pipeline_metrics", f"WITH x AS (SELECT user_id AS session_id, event_id // 40 AS segment_id, {_STAGE} AS stage, floor(value)::BIGINT AS ms, event_type FROM events) SELECT session_id, segment_id, coalesce(sum(ms) FILTER (stage = 'vad'), 0)::DOUBLE AS vad_latency_ms, coalesce(sum(ms) FILTER (stage = 'asr'), 0)::DOUBLE AS asr_latency_ms, coalesce(sum(ms) FILTER (stage = 'diarization'), 0)::DOUBLE AS diarization_latency_ms, coalesce(sum(ms) FILTER (stage = 'prosody'), 0)::DOUBLE AS prosody_latency_ms, sum(ms)::DOUBLE AS pipeline_processing_ms, count(DISTINCT event_type) AS active_speakers_count FROM x GROUP BY ALL")
def j3(spark, sf_dir):
    e = F.col("event_id") % 4
    stage = F.when(e == 0, "vad").when(e == 1, "asr").when(e == 2, "diarization").otherwise("prosody")
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.floor(F.col("event_id") / 40).alias("segment_id"), stage.alias("stage"), F.floor("value").cast("double").alias("ms"), F.col("event_type").alias("speaker_id"))
    return R.pipeline_metrics(rows)


@registry.add("j4_exclude_simulated", f"WITH {_METRICS} SELECT session_id, event_id FROM m WHERE NOT simulated")
def j4(spark, sf_dir):
    return R.exclude_simulated(metrics(spark, sf_dir)).select("session_id", "event_id")


@registry.add("g2_median_filter", f"""WITH {SAMPLES_SQL}, y AS (SELECT event_id, len(x) AS n, list_concat([0.0, 0.0], list_concat(x, [0.0, 0.0])) AS p FROM s)
SELECT event_id, round(list_sum([list_sort(p[i:i + 4])[3] * i FOR i IN range(1, n + 1)]), 6) AS moment FROM y""")
def g2(spark, sf_dir):
    rows = samples(spark, sf_dir).withColumn("y", C.median_filter5(F.col("x")))
    return rows.select("event_id", F.round(F.aggregate(F.transform("y", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v), 6).alias("moment"))


@registry.add("g2b_whole_median_filter", f"""WITH {FRAMES_SQL}, s AS (SELECT session_id, coalesce(list(pitch_hz ORDER BY frame_idx) FILTER (pitch_hz IS NOT NULL), []) AS x FROM f GROUP BY session_id), y AS (SELECT session_id, x, len(x) AS n, list_concat([0.0, 0.0], list_concat(x, [0.0, 0.0])) AS p FROM s)
SELECT session_id, n, round(CASE WHEN n = 0 THEN 0 WHEN n < 5 THEN list_sum([x[i] * i FOR i IN range(1, n + 1)]) ELSE list_sum([list_sort(p[i:i + 4])[3] * i FOR i IN range(1, n + 1)]) END, 6)::DOUBLE AS moment FROM y""")
def g2b(spark, sf_dir):
    """The pitch contour of a whole session; short ones stay as they are."""
    known = F.array_sort(F.collect_list(F.when(F.col("pitch_hz").isNotNull(), F.struct("frame_idx", "pitch_hz"))))
    rows = f(spark, sf_dir).groupBy("session_id").agg(known.alias("k")).withColumn("x", F.transform("k", lambda p: p["pitch_hz"])).withColumn("y", C.median_filter5(F.col("x")))
    return rows.select("session_id", F.size("x").cast("long").alias("n"), F.round(F.aggregate(F.transform("y", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v), 6).alias("moment"))


_CONTOUR = f"{FRAMES_SQL}, k AS (SELECT session_id, frame_idx // 8 AS clip, list(pitch_hz ORDER BY frame_idx) FILTER (pitch_hz IS NOT NULL) AS v FROM f GROUP BY ALL), h AS (SELECT *, greatest(2, floor(len(v) * 0.6)::INT) AS cut FROM k WHERE v IS NOT NULL)"


def contours(spark, sf_dir):
    own = f(spark, sf_dir).groupBy("session_id", F.floor(F.col("frame_idx") / 8).alias("clip")).agg(F.array_sort(F.collect_list(F.when(F.col("pitch_hz").isNotNull(), F.struct("frame_idx", "pitch_hz")))).alias("x"))
    return A.contour_features(own.withColumn("f0", F.transform("x", lambda p: p["pitch_hz"])).filter(F.size("f0") > 0))


@registry.add("g3_pitch_stats", f"WITH {_CONTOUR} SELECT session_id, clip, round(list_avg(v), 6) AS mean_pitch_hz, list_min(v) AS min_pitch_hz, list_max(v) AS max_pitch_hz FROM h")
def g3(spark, sf_dir):
    return contours(spark, sf_dir).select("session_id", "clip", F.round("mean_pitch_hz", 6).alias("mean_pitch_hz"), "min_pitch_hz", "max_pitch_hz")


@registry.add("g4_pitch_range_semitones", f"WITH {_CONTOUR} SELECT session_id, clip, round(12 * log2(list_max(v) / list_min(v)), 6) AS pitch_range_semitones FROM h")
def g4(spark, sf_dir):
    return contours(spark, sf_dir).select("session_id", "clip", F.round("pitch_range_semitones", 6).alias("pitch_range_semitones"))


@registry.add("g5_pitch_contour", f"WITH {_CONTOUR}, d AS (SELECT session_id, clip, CASE WHEN len(v) >= 4 THEN 12 * log2(list_median(v[cut + 1:]) / list_median(v[:cut])) END AS x FROM h) SELECT session_id, clip, coalesce(x >= 1.2, false) AS rising_intonation, coalesce(x <= -1.2, false) AS falling_intonation FROM d")
def g5(spark, sf_dir):
    return contours(spark, sf_dir).select("session_id", "clip", "rising_intonation", "falling_intonation")


# -- signal kernels: no SQL gives these ----------------------------------------------------------------------------
#: samples of a clip, and clips of a task: 60 MB of samples, which Arrow hands to Python at once
CLIP, TASK = 9600, 1500


#: kinds of clips that don't depend on the number of events, and how loud their noise is
_NOISE = {"view": 0.2, "purchase": 0.08, "signup": 0.0, "error": 0.0}


@lru_cache(maxsize=256)
def _clean(kind: str | None, user: float, n: int) -> np.ndarray:
    """Samples of a clip without its noise. Of the known kinds there are 130, whatever the number of clips."""
    i = np.arange(CLIP)
    sine = lambda amp, hz: amp * np.sin(2 * 3.141592653589793 * hz * i / 16000.0)
    if kind == "view":
        x = sine(0.25, 130 + user * 9)
    elif kind == "purchase":
        x = np.where(i % (84 + user) == 0, 0.6, 0.0)
    elif kind == "signup":
        x = np.where(i % (110 + user) == 0, 0.6, 0.0)
    elif kind == "error":
        x = np.where(i < 7200, sine(0.02, 110), sine(0.5, 200 + user))
    else:
        x = sine(0.25, 110 + user * 12 + (n - 4) * 20 * i / 16000.0)
    x.flags.writeable = False
    return x


def _clip(kind: str | None, user: float, n: int, seed: int) -> np.ndarray:
    """Samples of one clip. Each number is computed as Spark's expressions would."""
    x = _clean(kind, user, 0 if kind in _NOISE else n % 9)
    if _NOISE.get(kind):
        x = x + _NOISE[kind] * ((K.xxhash64_ints(np.arange(CLIP), seed) % 2001 - 1000) / 1000.0)
    return x.astype(np.float32)


def _clips_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):  # rows become 38 KB each
            own = batch.slice(at, 256)
            made = [_clip(k, np.nan if u is None else u, n, s) for k, u, n, s in zip(*(own.column(c).to_pylist() for c in ("event_type", "user", "n", "seed")))]
            samples = pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1) * CLIP, pa.int32()), pa.array(np.concatenate(made)))
            yield pa.RecordBatch.from_arrays([own.column("clip_id"), samples], names=["clip_id", "samples"])


def clip_rows(spark, sf_dir):
    """What each clip is made of, one a distinct (user, event type). Rows are dealt out before they get samples: a thousand of
    them are few bytes till then, and would be one task. They are counted first, so that a task gets no more of a larger table."""
    e = read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    e = e.select(F.concat_ws("-", "user_id", "event_type").alias("clip_id"), "event_type", (F.col("user_id") % 10).alias("user"), "n", F.xxhash64("user_id").alias("seed"))
    tasks = max(4 * spark.sparkContext.defaultParallelism, -(-e.count() // TASK))
    return e.repartition(tasks, "clip_id")


def clips(spark, sf_dir):
    """Clips of 0.6 s: gliding tones, tones in noise, pulses of a high and of a low voice, and quiet tones that end in a loud
    high one."""
    return clip_rows(spark, sf_dir).mapInArrow(_clips_of, "clip_id string, samples array<float>")


@registry.add("g1_f0_contour")
def g1(spark, sf_dir):
    made = A.contour_features(FR.clip_features(clips(spark, sf_dir), give=("f0",)).drop("samples"))
    return made.select("clip_id", F.size("f0").alias("n"), "mean_pitch_hz", "pitch_semitone_excursion")


@registry.add("g6_emphasis")
def g6(spark, sf_dir):
    made = FR.clip_features(clips(spark, sf_dir), give=("f0", "energy_ratio")).drop("samples").withColumn("seconds", F.lit(0.6))
    return A.emphasis(made).select("clip_id", "energy_ratio", "emphasis")


@registry.add("f14_acoustic_overlap")
def f14(spark, sf_dir):
    made = FR.clip_features(clips(spark, sf_dir), give=("overlap",)).drop("samples").withColumn("seconds", F.lit(0.6))
    return FR.acoustic_overlap(made).select("clip_id", "mean_entropy", "n_voiced", "n_dual", "acoustic_overlap")


@registry.add("f2_mfcc_embedding")
def f2(spark, sf_dir):
    from ..functions.kernels import mfcc_embedding

    return S.embed(clips(spark, sf_dir), mfcc_embedding).select("clip_id", "embedding")


@registry.add("b6_condition_audio")
def b6(spark, sf_dir):
    made = FR.condition_audio(clips(spark, sf_dir), give=("mean_square",))
    return made.select("clip_id", C.rms_db(F.col("mean_square")).alias("rms_db"))


@registry.add("b10_make_noise")
def b10(spark, sf_dir):
    made = FR.add_noise(clips(spark, sf_dir), [("white", 10.0), ("pink", 10.0), ("fan", 10.0), ("babble", 5.0)], give=("mean_square",))
    return made.select("clip_id", "kind", "snr_db", C.rms_db(F.col("mean_square")).alias("rms_db"))


@registry.add("a14_encode_pcm16")
def a14(spark, sf_dir):
    """Samples are made and encoded in one task's Python; only payloads leave it."""
    return readers.encode_pcm16(clip_rows(spark, sf_dir), make=(_clips_of, "clip_id string")).select("clip_id", F.octet_length("payload").alias("bytes"), F.sha2("payload", 256).alias("sha256"))


@registry.add("d1_transcribe", "SELECT user_id || '-' || event_type AS clip_id, CASE WHEN count(*) % 2 = 0 THEN '' ELSE '[ASR engine unavailable]' END AS text FROM events GROUP BY user_id, event_type")
def d1(spark, sf_dir):
    """Without an engine: short clips are empty, the others say so."""
    from ..operators.words import transcribe

    n = read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    silent = n.select(F.concat_ws("-", "user_id", "event_type").alias("clip_id"), F.array_repeat(F.lit(0.0), F.when(F.col("n") % 2 == 0, 3999).otherwise(4000)).alias("samples"))
    return transcribe(silent, None).select("clip_id", "text")


def _higher_voice(x, rate):
    """Stands for a model: one axis for voices above 200 Hz, the other for those below."""
    import numpy as np

    return np.array([1.0, 0.0]) if np.abs(np.fft.rfft(x)).argmax() * rate / len(x) > 200 else np.array([0.0, 1.0])


@registry.add("e3_partition_turns", "SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY event_type) AS segment_id, unnest([0, 1]) AS turn_idx, unnest(['one two.', 'three four']) AS text FROM (SELECT DISTINCT user_id, event_type FROM events WHERE event_type IN ('click', 'view')) UNION ALL SELECT user_id, 100, 0, 'one two. three four' FROM events WHERE event_type IN ('purchase') GROUP BY user_id")
def e3(spark, sf_dir):
    """Clips of two tones are two turns, clips of one tone are one."""
    from pyspark.sql import Window

    from ..operators.words import WORD, partition_turns

    e = read(spark, sf_dir, "events").filter("event_type in ('click', 'view', 'purchase')").select("user_id", "event_type").distinct()
    two = F.col("event_type") != "purchase"
    hz = lambda i: F.when(two & (i >= 16000), 320.0).otherwise(120.0)
    x = F.transform(F.sequence(F.lit(0), F.lit(31999)), lambda i: (0.25 * F.sin(2 * 3.141592653589793 * hz(i) * i / 16000.0)).cast("float"))
    words = F.expr(f"cast(array(named_struct('word', 'one', 'start', 0.0, 'end', 0.4, 'probability', 1.0), named_struct('word', 'two.', 'start', 0.5, 'end', 0.9, 'probability', 1.0), named_struct('word', 'three', 'start', 1.1, 'end', 1.4, 'probability', 1.0), named_struct('word', 'four', 'start', 1.5, 'end', 1.9, 'probability', 1.0)) as array<{WORD}>)")
    no = F.when(two, F.row_number().over(Window.partitionBy("user_id", two).orderBy("event_type"))).otherwise(100)
    segments = e.select(F.col("user_id").alias("session_id"), no.cast("long").alias("segment_id"), F.lit(0.0).alias("start_time"), F.lit(2.0).alias("end_time"), F.lit("").alias("text"), x.alias("samples"), words.alias("words"))
    return partition_turns(segments, _higher_voice).select("session_id", "segment_id", F.col("turn_idx").cast("int").alias("turn_idx"), "text")
