"""Known answers of the operators, on rows and signals made here."""

import json
import random
import time
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from speechtable.functions import columns as C
from speechtable.functions import kernels as K
from speechtable.operators import acoustics as A
from speechtable.operators import exports as X
from speechtable.operators import frames as FR
from speechtable.operators import reports as R
from speechtable.operators import segments as G
from speechtable.operators import speakers as S
from speechtable.operators import utterances as U
from speechtable.operators import words as W
from speechtable.sources import readers

RATE = 16000


def tone(f, seconds, amp=0.25, glide=0.0):
    t = np.arange(int(seconds * RATE)) / RATE
    return amp * np.sin(2 * np.pi * (f + glide * t) * t)


@pytest.mark.parametrize("f,glide,rising,falling", [(140, 85, True, False), (280, -85, False, True), (180, 0, False, False)])
def test_contour_of_chirps(spark, f, glide, rising, falling):
    clips = spark.createDataFrame([(1, tone(f, 0.8, glide=glide).tolist())], "clip_id long, samples array<double>")
    r = A.contour_features(FR.clip_features(clips)).first()
    assert (r.rising_intonation, r.falling_intonation) == (rising, falling)
    assert r.max_pitch_hz >= r.min_pitch_hz and 70 <= r.min_pitch_hz


def test_silence_has_no_pitch():
    assert len(K.f0_contour(np.zeros(8000))) == 0


def test_loudness_against_baseline(spark):
    level = spark.createDataFrame([(tone(150, 0.5, 0.5).tolist(),)], "x array<double>").select(C.segment_rms_db(F.col("x")).alias("db")).first().db
    assert level == pytest.approx(-9.03, abs=0.05)
    assert spark.range(1).select(C.relative_volume(F.lit(level), F.lit(-25.0)).alias("v")).first().v == "loud"


def test_rate_and_pause(spark):
    r = spark.range(1).select(C.speech_rate(F.lit(5), F.lit(1.0)).alias("r"), C.words_per_minute(F.lit(5), F.lit(1.0)).alias("w")).first()
    assert (r.r, r.w) == ("fast", 300.0)
    u = spark.createDataFrame([(1, 0, 0.0, 1.0), (1, 1, 2.8, 3.5), (1, 2, 3.6, 4.0)], "session_id long, seq long, start_time double, end_time double")
    assert [x.long_pause_before for x in U.long_pause_before(u).orderBy("seq").collect()] == [False, True, False]


def test_baselines(spark):
    u = spark.createDataFrame([(1, 0, "a", -18.0, 140.0), (1, 1, "a", -20.0, 145.0), (1, 2, "a", None, 40.0), (1, 3, "a", -30.0, 150.0)], "session_id long, seq long, speaker_id string, rms_db double, mean_pitch_hz double")
    r = A.pitch_baseline(A.rms_baseline(u)).orderBy("seq").collect()
    assert [x.rms_baseline for x in r] == [-24.0, -18.0, -19.0, -19.0]
    assert [x.pitch_baseline for x in r] == [None, 140.0, 142.5, 142.5]


def test_speaker_labels_and_rename(spark):
    t = spark.createDataFrame([(1, i, f"s{i}", float(i)) for i in range(10)], "session_id long, seq long, speaker_id string, end_time double")
    d = S.speaker_dimension(t)
    r = {x.speaker_id: x for x in d.collect()}
    assert (r["s0"].label, r["s1"].label, r["s8"].label, r["s9"].color_index) == ("Speaker A", "Speaker B", "Speaker 9", 1)
    renames = spark.createDataFrame([(1, "s0", 0, "Old"), (1, "s0", 1, " Dr. Rao "), (1, "s1", 0, " "), (1, "nobody", 0, "x")], "session_id long, speaker_id string, seq long, new_name string")
    n = {x.speaker_id: x for x in S.rename_speakers(d, renames).collect()}
    assert n["s0"].display_name == "Dr. Rao (Speaker A)" and n["s0"].color_index == 0 and n["s1"].display_name == "Speaker B"
    assert [x.speaker_id for x in S.unknown_renames(d, renames).collect()] == ["nobody"]


def test_same_voice_is_one_speaker(spark):
    voice = lambda f, g: (tone(f, 0.8, 0.2) + tone(g, 0.8, 0.1)).tolist()
    clips = spark.createDataFrame([(1, 0, voice(140, 280)), (1, 1, voice(140, 280)), (2, 0, voice(140, 280))], "session_id long, seq long, samples array<double>")
    made = S.cluster_speakers(S.embed(clips, K.mfcc_embedding), S.THRESHOLD_FALLBACK).collect()
    assert {x.speaker_no for x in made} == {1} and len(made) == 3


def test_embedding_falls_back(spark):
    def fails(x, rate):
        raise RuntimeError

    clips = spark.createDataFrame([(1, tone(200, 0.1).tolist())], "clip_id long, samples array<double>")
    v = S.embed(clips, fails).first().embedding
    assert len(v) == 192 and np.linalg.norm(v) == pytest.approx(1, abs=1e-6)


def frames(spark, pattern):
    return spark.createDataFrame([(1, i, c == "x") for i, c in enumerate(pattern)], "session_id long, frame_idx long, voiced boolean")


@pytest.mark.parametrize("gap,segments", [(12, 1), (13, 2), (40, 2)])
def test_hysteresis(spark, gap, segments):
    v = G.vad_state(frames(spark, "x" * 5 + "." * gap + "x" * 5 + "." * 13))
    s = G.speech_segments(v).orderBy("segment_no").collect()
    assert len(s) == segments and s[0].first_frame == 0 and s[-1].last_frame == 5 + gap + 5 + 12 - 1


def test_open_tail_is_not_given_out(spark):
    assert G.speech_segments(G.vad_state(frames(spark, "xxxx" + "." * 12))).count() == 0


def test_interim_checkpoints(spark):
    v = G.vad_state(frames(spark, "x" * 100))
    assert [x.collected for x in G.interim_checkpoints(v).orderBy("frame_idx").collect()] == [38, 76]


@pytest.mark.parametrize("n,rows", [(18, 3), (12, 2), (1907, 317), (657, 109)])
def test_live_rows(spark, n, rows):
    df = spark.range(n).select(F.lit(1).alias("session_id"), F.col("id").alias("frame_idx"), F.lit(True).alias("voiced"), F.lit(180.0).alias("pitch_hz"), F.lit(-20.0).alias("level_dbfs"))
    made = A.live_windows(df).collect()
    assert len(made) == rows and all(x.pitch_hz == 180 and x.level_dbfs == pytest.approx(-20) for x in made)


def test_live_history(spark):
    rows = [(1, i, True, 160.0, -18.9) for i in range(5)] + [(1, 5, True, 190.0, -10.9), (1, 6, False, None, -120.0)]
    r = A.live_features(spark.createDataFrame(rows, "session_id long, frame_idx long, voiced boolean, pitch_hz double, level_dbfs double")).orderBy("frame_idx").collect()
    assert (r[0].pitch_direction, r[5].pitch_direction, r[6].pitch_direction) == ("steady", "rising", "unavailable")
    assert r[5].relative_level_db > 6 and r[5].emphasis_candidate and r[6].relative_level_db is None


def test_live_validation(spark):
    df = spark.createDataFrame([(-1.0, 100.0, None, -2.0), (1.0, None, 10.0, 0.5)], "timestamp_s double, pitch_hz double, speech_rate_wpm double, pause_duration_s double")
    assert [(x.valid, x.pause_duration_s) for x in A.live_validate(df).collect()] == [(False, 0.0), (True, 0.5)]


def test_exports(spark, tmp_path):
    u = spark.createDataFrame([("u1", "s", 12.5, 15.0, "Speaker A", "Clinical observation", 1.0)], "id string, session_id string, start_time double, end_time double, label string, text string, created_at double")
    assert X.export_txt(u).first().content == "[00:12] Speaker A: Clinical observation"
    assert X.export_vtt(u).first().content == "WEBVTT\n\n1\n00:00:12.500 --> 00:00:15.000\n<v Speaker A>Clinical observation\n"
    assert json.loads(X.export_json(u.withColumn("nothing", F.lit(None).cast("string"))).first().content)[0]["nothing"] is None
    X.write_exports(u, str(tmp_path / "out"))
    assert len(list((tmp_path / "out").rglob("*.txt"))) == 3


@pytest.mark.parametrize("privacy,save,written", [(True, False, 0), (True, True, 0), (False, False, 0), (False, True, 1)])
def test_privacy_gate(spark, privacy, save, written):
    u = spark.createDataFrame([("u1", 1, True), ("u2", 1, False)], "id string, session_id long, is_final boolean")
    s = spark.createDataFrame([(1, privacy, save)], "session_id long, privacy_mode boolean, save_transcript boolean")
    assert X.savable(u, s).count() == written
    assert X.savable(u, s.filter("false")).count() == 0


def test_archive_is_upserted(spark, tmp_path):
    s = spark.createDataFrame([(1, False, True), (2, False, True)], "session_id long, privacy_mode boolean, save_transcript boolean")
    schema = "id string, session_id long, is_final boolean, text string, start_time double, created_at double"
    path = str(tmp_path / "archive")
    X.save_utterances(spark.createDataFrame([("a", 1, True, "one", 0.0, 1.0), ("b", 2, True, "two", 0.0, 1.0)], schema), s, path)
    X.save_utterances(spark.createDataFrame([("a", 1, True, "new", 0.0, 2.0), ("c", 1, True, "more", 1.0, 2.0)], schema), s, path)
    assert {(x.id, x.text) for x in spark.read.parquet(path).collect()} == {("a", "new"), ("b", "two"), ("c", "more")}


def test_format_mmss(spark):
    df = spark.createDataFrame([(0.0,), (65.0,), (125.7,), (float("nan"),), (-3.0,), (7384.0,)], "s double")
    assert [x[0] for x in df.select(C.format_mmss(F.col("s"))).collect()] == ["00:00", "01:05", "02:05", "00:00", "00:00", "123:04"]


def test_pcm(spark, tmp_path):
    assert np.frombuffer(K.encode_pcm16([-1, 0, 1]), "<i2").tolist() == [-32768, 0, 32767]
    p = spark.createDataFrame([(1, 0, bytearray(K.encode_pcm16(np.full(700, 0.5)))), (1, 1, bytearray(K.encode_pcm16(np.zeros(512))))], "session_id long, packet_seq long, payload binary")
    r = FR.frame_pcm(p).orderBy("frame_idx").collect()
    assert [x.frame_idx for x in r] == [0, 1, 2] and r[1].samples[187] == pytest.approx(0.5, abs=1e-4) and r[1].samples[188] == 0
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(2), w.setsampwidth(2), w.setframerate(RATE)
        w.writeframes(K.encode_pcm16(np.repeat(tone(200, 1.0), 2)))
    clip = readers.read_wav_clips(spark, str(tmp_path), 0.25, 0.75).first()
    assert len(clip.samples) == 8000


def test_conversation_json(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"speaker_id": "a", "text": "one two three four"}, {"delay_ms": 200, "text": "five", "overlap": True}]))
    r = readers.read_conversation_json(spark, str(tmp_path / "c.json")).collect()
    assert [(x.delay_ms, x.overlap, x.overlapping_speakers) for x in r] == [(1500, False, []), (200, True, [])]


def test_highpass_matches_the_difference_equation():
    x = np.random.default_rng(1).standard_normal(3000)
    y = x
    for b, a in K._butterworth_highpass(75.0, RATE):
        out = np.zeros_like(y)
        for n in range(len(y)):
            back = lambda v, k: v[n - k] if n >= k else 0.0  # noqa: B023, E731
            out[n] = sum(b[k] * back(y, k) for k in range(3)) - sum(a[k] * back(out, k) for k in (1, 2))
        y = out
    assert np.allclose(K.highpass(x, 75.0, RATE), y, atol=1e-9)
    assert np.abs(K.condition(np.full(16000, 0.5))[-4000:]).max() < 1e-3


@pytest.mark.parametrize("kind", K.NOISES)
def test_noise_has_the_wanted_ratio(kind):
    speech = tone(200, 1.0, 0.2)
    n = K.noise(kind, len(speech), RATE, 7, speech)
    assert np.sqrt((n[K.active(speech)] ** 2).mean()) == pytest.approx(1)
    assert np.array_equal(K.mix(speech, kind, 10.0, RATE, 7), K.mix(speech, kind, 10.0, RATE, 7))


def test_unknown_noise(spark):
    with pytest.raises(ValueError):
        FR.add_noise(spark.createDataFrame([(1, [0.1])], "clip_id long, samples array<double>"), [("rain", 5.0)])


def test_overlap_evidence(spark):
    one = spark.createDataFrame([(0.6, 7.5, 10, 6), (0.6, 7.5, 10, 4), (0.3, 7.5, 10, 9), (0.6, 6.0, 10, 9)], "seconds double, mean_entropy double, n_voiced int, n_dual int")
    assert [x.acoustic_overlap for x in FR.acoustic_overlap(one).collect()] == [True, False, False, False]
    entropy, voiced, dual = K.overlap_evidence(np.zeros(8000))
    assert entropy == pytest.approx(7.98, abs=0.01) and (voiced, dual) == (0, 0)  # silence has a flat spectrum
    assert K.overlap_evidence(np.zeros(100)) == (0.0, 0, 0)


def test_transcribe_and_turns(spark):
    def asr(x, rate):
        if x.max() > 0.9:
            raise RuntimeError
        return " hello ", [{"word": "hello", "start": 0.0, "end": 0.5, "probability": 0.9}], -0.1

    segs = spark.createDataFrame([(1, tone(200, 0.1).tolist()), (2, tone(200, 0.5).tolist()), (3, tone(200, 0.5, 1.0).tolist())], "segment_id long, samples array<double>")
    assert [x.text for x in W.transcribe(segs, asr).orderBy("segment_id").collect()] == ["", "hello", ""]
    assert [x.text for x in W.transcribe(segs, None).orderBy("segment_id").collect()] == ["", "[ASR engine unavailable]", "[ASR engine unavailable]"]

    def voice(x, rate):
        high = np.abs(np.fft.rfft(x)).argmax() * rate / len(x) > 200
        return np.array([1.0, 0.0]) if high else np.array([0.0, 1.0])

    samples = np.concatenate((tone(120, 1.0), tone(300, 1.0))).tolist()
    words = [("one", 0.0, 0.4), ("two.", 0.5, 0.9), ("three", 1.1, 1.4), ("four", 1.5, 1.9)]
    seg = spark.createDataFrame([(1, 1, 0.0, 2.0, "x", samples, [(w, a, b, 1.0) for w, a, b in words])], f"session_id long, segment_id long, start_time double, end_time double, text string, samples array<double>, words array<{W.WORD}>")
    t = W.partition_turns(seg, voice).orderBy("turn_idx").collect()
    assert [x.text for x in t] == ["one two.", "three four"] and t[1].start_time == pytest.approx(1.0) and t[1].words[0].start == pytest.approx(0.1)
    assert W.partition_turns(seg, None).count() == 1


def test_speakers_in_stream_keep_late_labels(spark):
    u = spark.createDataFrame([(1, 0, "x", "i1", False), (1, 1, "y", "i2", False), (1, 2, "x!", "i1", True)], "session_id long, seq long, text string, id string, is_final boolean")
    r = {x.id: x for x in U.upsert_captions(u).collect()}
    assert (r["i1"].position, r["i1"].text, r["i1"].is_final) == (0, "x!", True)


def test_stream_upsert(spark, tmp_path):
    from speechtable.streaming.processors import stream_upsert

    schema = "session_id long, id string, seq long, text string, is_final boolean"
    for k, rows in enumerate(([(1, "a", 0, "in", False)], [(1, "a", 1, "final", True), (1, "b", 2, "other", True)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream_upsert(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
        made = {x.id: x.text for x in spark.read.parquet(str(tmp_path / "out" / f"epoch={k}")).collect()}
    assert made == {"a": "final", "b": "other"}


def test_ranges_of_token_edits(spark):
    df = spark.createDataFrame([("a b c d e", "a x c"), ("", "a"), ("a", "a")], "r string, c string")
    assert [x[0] for x in df.select(R.token_edit_rate(C.tokenize(F.col("r")), C.tokenize(F.col("c")))).collect()] == [0.6, None, 0.0]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_distance_of_random_lists(monkeypatch):
    rng = random.Random(1)
    monkeypatch.setattr(K, "LONG", 5)
    for most in (3, 40):
        monkeypatch.setattr(K, "FEW", most)
        for _ in range(600):
            a = [rng.choice("abcd"[: rng.randint(1, 4)]) for _ in range(rng.randint(0, 20))]
            b = [rng.choice("abcd") for _ in range(rng.randint(0, 20))] if rng.random() < 0.5 else [x for x in a if rng.random() < 0.8] + ["e"]
            assert K.edit_distance(a, b) == edits(a, b)


def test_edit_distance_of_very_long_lists():
    rng = random.Random(2)
    a = [f"w{i}" for i in range(100_000)]  # as many distinct tokens
    b = list(a)
    for k in range(50):
        b[1000 * k + 7] = "#"
        del b[1000 * k + 500]
    began = time.time()
    assert K.edit_distance(a, b) == 100 and time.time() - began < 30
    c, d = ([str(rng.randrange(50)) for _ in range(n)] for n in (700, 900))
    assert K.edit_distance(c, d) == edits(c, d)
    assert K.edit_distance([f"a{i}" for i in range(36_000)], [f"b{i}" for i in range(60)]) == 36_000


def test_edit_rate_and_condition_report_of_whole_texts(spark, tmp_path, sf_dir):
    rng = random.Random(3)
    words = [f"w{i * i % 71}" for i in range(300)]
    texts = [(1, 0, " ".join(words)), (1, 1, " ".join(words[:7])), (1, 2, None), (2, 0, "b a"), *((3, k, " ".join(rng.choice(words[:9]) for _ in range(rng.randint(0, 60)))) for k in range(20))]
    spark.createDataFrame([(i, k, "user", t) for i, k, t in texts], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    from speechtable import catalog

    own = {(i, k): (t or "").split() for i, k, t in texts}
    rate = lambda a, b: (2000 * edits(a, b) + len(a)) // (2 * len(a)) / 1000 if a else None  # halves go up
    heard = {k: own.get((k[0], k[1] + 1), []) for k in own}
    rates = {r.id: r.token_edit_rate for r in catalog.queries()["j11b_whole_edit_rate"](spark, str(tmp_path)).collect()}
    assert rates == {f"{i}-{k}": rate(own[i, k], heard[i, k]) for i, k in own}
    report = {(r.clip_id, r.condition): (r.recognized, r.token_edit_rate) for r in catalog.queries()["j12b_whole_condition_report"](spark, str(tmp_path)).collect()}
    made = {"clean": own, "crosstalk": heard, "echo": {k: own[k] + heard[k] for k in own}}
    assert report == {(f"{i}-{k}", name): (len(w[i, k]), rate(own[i, k], w[i, k])) for name, w in made.items() for i, k in own}


@pytest.mark.parametrize("bin_ms", [1, 50, 10_000])
def test_overlaps_of_long_and_wrong_intervals(spark, bin_ms):
    rng = random.Random(8)
    rows = []
    for k in range(150):
        start = rng.randint(-3000, 9000)
        end = start + rng.choice([0, 40, 300, 2500, 40_000, -500])
        rows.append((rng.randint(1, 2), k, rng.choice("ab"), f"{k}", start, end))
    rows.append((1, 900, "c", "900", 10, 36_000_000_000))  # 10,000 hours
    df = spark.createDataFrame(rows, "session_id long, seq long, speaker_id string, id string, start_ms long, end_ms long")
    got = sorted(tuple(r) for r in U.interval_overlap_join(df, 200, bin_ms).collect())
    want = []
    for a in rows:
        for b in rows:
            if a[0] == b[0] and a[2] != b[2] and (a[4], a[1]) < (b[4], b[1]) and b[4] < a[5] - 200 and a[4] < b[5] - 200:
                want.append((a[0], a[3], b[3], min(a[5], b[5]) - b[4]))
    assert got == sorted(want) and got
    nodes = df.select(F.size(U._cover(F.floor(F.col("start_ms") / bin_ms), F.floor(F.greatest("end_ms", "start_ms") / bin_ms))).alias("n")).agg(F.max("n")).first()[0]
    assert nodes <= 72


def test_sketches_of_sessions_merge(spark):
    rng = random.Random(3)
    rows = [(k % 40, rng.lognormvariate(3, 1)) for k in range(40_000)] + [(99, None)]
    df = spark.createDataFrame(rows, "session_id long, pipeline_processing_ms double").repartition(5)
    sketches = R.latency_sketches(df, by=["session_id"])
    assert sketches.count() == 41
    r = R.merged_latency(sketches).first()
    values = sorted(v for _, v in rows if v is not None)
    assert r.n == 40_000 and r.max_ms == values[-1]
    for q, got in ((0.5, r.median_ms), (0.95, r.p95_ms)):
        assert abs(sum(v <= got for v in values) / len(values) - q) < 0.01
    by = {x.session_id: x for x in R.merged_latency(sketches, ["session_id"]).collect()}
    assert by[99].n == 0 and by[99].median_ms is None and by[0].n == 1000


def test_a_packet_given_twice_is_an_error(spark):
    p = spark.createDataFrame([(1, 0, bytearray(4)), (1, 0, bytearray(4)), (2, 0, bytearray(4))], "session_id long, packet_seq long, payload binary")
    with pytest.raises(Exception, match="given twice"):
        FR.frame_pcm(p).collect()


def test_archive_has_so_many_folders(spark, tmp_path):
    s = spark.createDataFrame([(k, False, True) for k in range(50)], "session_id long, privacy_mode boolean, save_transcript boolean")
    rows = spark.createDataFrame([(f"{k}-{v}", k, True, f"t{v}", 0.0, 1.0) for k in range(50) for v in range(3)], "id string, session_id long, is_final boolean, text string, start_time double, created_at double")
    path = tmp_path / "archive"
    X.save_utterances(rows, s, str(path), 4)
    before = {str(p) for p in path.rglob("*.parquet")}
    X.save_utterances(rows.filter("session_id = 7").withColumn("text", F.lit("new")).withColumn("created_at", F.lit(2.0)), s, str(path), 4)
    after = {str(p) for p in path.rglob("*.parquet")}
    assert len([p for p in path.iterdir() if p.is_dir()]) <= 4 and len(before - after) == 1
    got = {(r.session_id, r.id): r.text for r in spark.read.parquet(str(path)).collect()}
    assert got == {(k, f"{k}-{v}"): "new" if k == 7 else f"t{v}" for k in range(50) for v in range(3)}
    assert not [p for p in tmp_path.iterdir() if "staged" in p.name]


def test_intermediate_tables_are_cleaned_up(spark):
    from speechtable.session import clean, scratch, shared_dir

    path = scratch(spark, "x")
    spark.range(3).write.parquet(path)
    assert path.startswith(shared_dir(spark)) and spark.read.parquet(path).count() == 3
    clean(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def test_turns_leave_python_in_small_pieces(spark):
    words = F.array_repeat(F.expr(f"cast(named_struct('word', 'a', 'start', 0.0, 'end', 0.1, 'probability', 1.0) as {W.WORD})"), 3)
    rows = spark.range(300).coalesce(1).select(F.col("id").alias("session_id"), F.col("id").alias("segment_id"), F.lit(0.0).alias("start_time"), F.lit(1.0).alias("end_time"), F.lit("t").alias("text"), F.when(F.col("id") != 7, F.array(F.lit(0.5))).alias("samples"), F.when(F.col("id") % 2 == 0, words).alias("words"))
    got = {r.session_id: r for r in W.partition_turns(rows, None).collect()}
    assert len(got) == 300 > W.ROWS
    assert all(r.text == ("a a a" if i % 2 == 0 else "t") and len(r.words) == (3 if i % 2 == 0 else 0) for i, r in got.items())
