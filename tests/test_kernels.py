"""Signal kernels against loops over samples, on random clips and on every row of their queries."""

import hashlib
import math
import struct
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from speechtable import catalog
from speechtable.functions import columns as C
from speechtable.functions import kernels as K
from speechtable.operators import frames as FR
from speechtable.plans import signals

RATE = 16000


def slow_correlation(x, lags):
    return [sum(x[i] * x[i + k] for i in range(len(x) - k)) for k in lags]


def slow_pitch(x, rate=RATE):
    size, hop = rate * 3 // 100, rate // 100
    window = [0.54 - 0.46 * math.cos(2 * math.pi * i / (size - 1)) for i in range(size)]
    out = []
    start = 0
    while start + size <= len(x):
        part = np.asarray(x[start : start + size], float)
        start += hop
        y = (part - part.mean()) * window
        if math.sqrt(float((y * y).mean()) + 1e-12) < 0.004:
            continue
        signs = [int(v > 0) - int(v < 0) for v in y]
        if sum(abs(b - a) for a, b in zip(signs, signs[1:])) / (size - 1) / 2 > 0.24:
            continue
        lags = range(rate // 380, rate // 80)
        r = [float(y[: size - k] @ y[k:]) for k in lags]
        best = max(range(len(r)), key=lambda i: (r[i], -i))
        if best in (0, len(r) - 1) or r[best] <= max(r[best - 1], r[best + 1]) or r[best] < 0.42 * float(y @ y):
            continue
        bend = r[best - 1] - 2 * r[best] + r[best + 1]
        move = 0.5 * (r[best - 1] - r[best + 1]) / bend if abs(bend) > 1e-12 else 0.0
        hz = rate / (lags[best] + max(-0.5, min(0.5, move)))
        if 70 <= hz <= 400:
            out.append(hz)
    if len(out) < 5:
        return out
    wide = [0.0, 0.0, *out, 0.0, 0.0]
    return [sorted(wide[i : i + 5])[2] for i in range(len(out))]


def slow_ratio(x, rate=RATE):
    size, hop = rate // 20, rate // 40
    energy = [float(np.dot(x[i : i + size], x[i : i + size])) for i in range(0, len(x) - size, hop)]
    return max(energy) / (sum(energy) / len(energy) + 1e-12) if energy else 0.0


def slow_overlap(x, rate=RATE):
    x = np.asarray(x, float)
    edge = 0.25 * 512 / 2
    taper = [0.5 * (1 - math.cos(math.pi * min(i, 512 - i) / edge)) if min(i, 512 - i) < edge else 1.0 for i in range(512)]
    entropies = []
    for i in range(0, len(x) - 511, 256):
        own = x[i : i + 512]
        s = np.abs(np.fft.rfft((own - own.mean()) * taper)) ** 2 / (rate * sum(w * w for w in taper))
        s = [v * (1 if k in (0, 256) else 2) + 1e-10 for k, v in enumerate(s)]
        total = sum(s) + 1e-10
        entropies.append(-sum(v / total * math.log2(v / total + 1e-10) for v in s))
    voiced = dual = 0
    for i in range(0, len(x) - 480, 480):
        own = x[i : i + 480]
        if max(abs(own)) < 0.02:
            continue
        whole = float(own @ own)
        r = [float(own[: 480 - k] @ own[k:]) for k in range(40, 200)]
        peaks = sum(r[k] > r[k - 1] and r[k] > r[k + 1] and r[k] > 0.35 * whole for k in range(1, len(r) - 1))
        voiced += peaks >= 1
        dual += peaks >= 2
    return (sum(entropies) / len(entropies) if entropies else 0.0), voiced, dual


def clips_of_all_kinds():
    rng = np.random.default_rng(5)
    t = np.arange(9600) / RATE
    out = [np.zeros(9600), np.zeros(100), rng.standard_normal(9600) * 0.1, np.sin(2 * np.pi * 403 * t) * 0.3, np.sin(2 * np.pi * 60 * t) * 0.3]
    for _ in range(25):
        a, b = rng.uniform(70, 420, 2)
        x = rng.uniform(0.001, 0.5) * np.sin(2 * np.pi * (a + rng.uniform(-60, 60) * t) * t) + rng.choice([0, 0.2]) * np.sin(2 * np.pi * b * t) + rng.choice([0, 0.02, 0.15]) * rng.standard_normal(9600)
        x[: rng.integers(0, 5000)] *= rng.choice([0.0, 0.01, 1.0])
        out.append(x[: rng.integers(300, 9601)])
    return out


def test_kernels_follow_the_rules():
    for x in clips_of_all_kinds():
        want = slow_pitch(x)
        got = K.f0_contour(x)
        assert len(got) == len(want) and np.allclose(got, want, rtol=1e-6)
        assert K.energy_ratio(x) == pytest.approx(slow_ratio(x), rel=1e-9)
        entropy, voiced, dual = slow_overlap(x)
        assert K.overlap_evidence(x) == (pytest.approx(entropy, abs=1e-6), voiced, dual)


def test_queries_on_clips_row_by_row(spark, sf_dir):
    made = {n: {r.clip_id: r for r in catalog.queries()[n](spark, sf_dir).collect()} for n in ("g1_f0_contour", "g6_emphasis", "f14_acoustic_overlap", "b6_condition_audio", "a14_encode_pcm16")}
    clips = {r.clip_id: np.array(r.samples) for r in signals.clips(spark, sf_dir).collect()}
    assert all(set(rows) == set(clips) for rows in made.values())
    for c, x in clips.items():
        f0 = slow_pitch(x)
        assert made["g1_f0_contour"][c].n == len(f0)
        if f0:
            assert made["g1_f0_contour"][c].mean_pitch_hz == pytest.approx(sum(f0) / len(f0), rel=1e-6)
        ratio = slow_ratio(x)
        assert made["g6_emphasis"][c].energy_ratio == pytest.approx(ratio, rel=1e-6)
        assert made["g6_emphasis"][c].emphasis == (ratio > 2.5 and (len(f0) < 3 or max(f0) / (sum(f0) / len(f0)) > 1.25))
        entropy, voiced, dual = slow_overlap(x)
        r = made["f14_acoustic_overlap"][c]
        assert (r.n_voiced, r.n_dual) == (voiced, dual) and r.mean_entropy == pytest.approx(entropy, abs=1e-6)
        assert r.acoustic_overlap == (entropy > 6.9 and voiced > 3 and dual / voiced > 0.4)
        pcm = b"".join(struct.pack("<h", int(max(-1.0, min(1.0, float(v))) * (32768 if v < 0 else 32767))) for v in x)
        assert (made["a14_encode_pcm16"][c].bytes, made["a14_encode_pcm16"][c].sha256) == (len(pcm), hashlib.sha256(pcm).hexdigest())
        y = K.condition(x)
        assert made["b6_condition_audio"][c].rms_db == pytest.approx(20 * math.log10(math.sqrt(float((y * y).mean()) + 1e-12) + 1e-12), abs=1e-6)
    for n, flag in (("g6_emphasis", "emphasis"), ("f14_acoustic_overlap", "acoustic_overlap")):
        assert {r[flag] for r in made[n].values()} == {True, False}, n


@pytest.mark.parametrize("kernel", [K.f0_contour, K.overlap_evidence])
def test_a_long_clip_is_worked_on_in_blocks(kernel):
    x = 0.3 * np.sin(2 * np.pi * 150 * np.arange(60 * RATE) / RATE)
    kernel(x[:RATE])
    tracemalloc.start()
    kernel(x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10_000_000


def test_clips_of_a_larger_table_are_more_tasks(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(signals, "TASK", 1)
    clips = signals.clips(spark, sf_dir)
    n = clips.count()
    own = clips.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert n > 4 * spark.sparkContext.defaultParallelism and len(own) > 4 * spark.sparkContext.defaultParallelism
    assert sum(r["count"] for r in own) == n


def test_sessions_of_a_larger_table_are_more_tasks(spark, sf_dir, monkeypatch):
    want = sorted(map(tuple, catalog.queries()["a12_event_fanout"](spark, sf_dir).collect()))
    monkeypatch.setattr(signals, "EVENTS", 50)
    made = catalog.queries()["a12_event_fanout"](spark, sf_dir)
    first = made.filter("type = 'vad_state'").select(F.spark_partition_id().alias("task")).distinct().count()
    assert first > int(spark.conf.get("spark.sql.shuffle.partitions")) and sorted(map(tuple, made.collect())) == want


def test_features_that_are_asked_for(spark):
    clips = spark.createDataFrame([("a", [0.1 * (-1) ** (i // 40) for i in range(9600)])], "clip_id string, samples array<float>")
    whole = FR.clip_features(clips).drop("samples")
    assert whole.columns == ["clip_id", "f0", "energy_ratio", "mean_entropy", "n_voiced", "n_dual"]
    for give, columns in ((("f0",), ["f0"]), (("energy_ratio", "overlap"), ["energy_ratio", "mean_entropy", "n_voiced", "n_dual"])):
        own = FR.clip_features(clips, give=give).drop("samples")
        assert own.columns == ["clip_id", *columns] and own.first() == whole.select("clip_id", *columns).first()
    rows = FR.condition_audio(spark.createDataFrame([(i, [0.01 * i] * 400) for i in range(150)] + [(150, [])], "clip_id long, samples array<float>"), give=("samples", "mean_square")).collect()
    assert sorted(r.clip_id for r in rows) == list(range(151))
    for r in rows:
        assert r.mean_square == (K.mean_square(r.samples) if r.samples else None)
        assert np.array_equal(r.samples, K.condition(np.array([0.01 * r.clip_id] * 400 if r.samples else [], np.float32).astype(float)))


def slow_cepstrum(x, rate=RATE):
    """Bands from one whole bin to another, each coefficient a sum."""
    power = K._power(np.pad(np.asarray(x, float), (0, max(0, 512 - len(x)))), rate) + 1e-10
    mel = lambda f: 2595 * math.log10(1 + f / 700)
    step = (mel(rate / 2) - mel(100)) / 27
    bins = [math.floor(513 * 700 * (10 ** ((mel(100) + i * step) / 2595) - 1) / rate) for i in range(28)]
    rows = []
    for frame in power:
        logs = []
        for a, b, c in zip(bins, bins[1:], bins[2:]):
            total = sum(frame[k] * (k - a) / (b - a) for k in range(a, b)) + sum(frame[k] * (c - k) / (c - b) for k in range(b, c))
            logs.append(math.log(total + 1e-6))
        rows.append([math.sqrt(2 / 26) * sum(v * math.cos(math.pi * q * (2 * i + 1) / 52) for i, v in enumerate(logs)) for q in range(1, 21)])
    table = np.array(rows)
    table = table - table.mean(0)
    v = np.concatenate((table.mean(0), table.std(0), np.zeros(152)))
    return v / (np.linalg.norm(v) + 1e-8)


def test_embeddings_of_clips(spark, sf_dir):
    for x in clips_of_all_kinds()[:12]:
        assert np.allclose(K.mfcc_embedding(x), slow_cepstrum(x), atol=1e-6)
    clips = {r.clip_id: np.array(r.samples) for r in signals.clips(spark, sf_dir).collect()}
    made = {r.clip_id: r.embedding for r in catalog.queries()["f2_mfcc_embedding"](spark, sf_dir).collect()}
    assert set(made) == set(clips)
    for c in sorted(clips)[:25]:
        assert np.allclose(made[c], slow_cepstrum(clips[c]), atol=1e-6)


@pytest.mark.parametrize("kind", K.NOISES)
def test_noise_of_each_kind(kind):
    rate, n = 2000, 20_000
    speech = np.sin(np.arange(n) / 5) * (np.arange(n) % 4000 < 2500)
    normal = np.random.default_rng(11).standard_normal(n)
    if kind == "white":
        x = list(normal)
    elif kind == "fan":
        turn = 2 * math.pi / rate
        x = [0.6 * normal[i] + 0.8 * math.sin(60 * turn * i) + 0.35 * math.sin(120 * turn * i + 0.2) + 0.18 * math.sin(240 * turn * i + 0.7) for i in range(n)]
    elif kind == "babble":
        x = [speech[(i - int(7.3 * rate)) % n] + 0.015 * normal[i] for i in range(n)]
    else:
        spectrum = np.fft.rfft(normal)
        x = np.fft.irfft([s / (math.sqrt(k * rate / n) if k else 1.0) for k, s in enumerate(spectrum)], n)
    on = K.active(speech, rate)
    loud = math.sqrt(sum(v * v for v, a in zip(x, on) if a) / on.sum())
    assert np.allclose(K.noise(kind, n, rate, 11, speech), np.array(x) / loud, atol=1e-6)


def test_query_mixes_each_noise_at_its_level(spark, sf_dir):
    made = {(r.clip_id, r.kind): r for r in catalog.queries()["b10_make_noise"](spark, sf_dir).collect()}
    clips = {r.clip_id: np.array(r.samples) for r in signals.clips(spark, sf_dir).collect()}
    assert len(made) == 4 * len(clips)
    from pyspark.sql import functions as F

    each = [(c, k, s) for c in sorted(clips)[:10] for k, s in (("white", 10.0), ("pink", 10.0), ("fan", 10.0), ("babble", 5.0))]
    seeds = spark.createDataFrame(each, "clip_id string, kind string, snr_db double").withColumn("seed", F.xxhash64("clip_id", "kind", "snr_db")).collect()
    for r in seeds:
        y = K.mix(clips[r.clip_id], r.kind, r.snr_db, RATE, r.seed)
        assert made[r.clip_id, r.kind].rms_db == pytest.approx(20 * math.log10(math.sqrt(float((y * y).mean()) + 1e-12) + 1e-12), abs=1e-6)


def test_sums_and_hashes_as_spark_has_them(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal(9600)
    df = spark.createDataFrame([(7, x.tolist())], "u long, x array<double>")
    got = df.select(C.mean_square(F.col("x")).alias("ms"), F.transform(F.sequence(F.lit(0), F.lit(999)), lambda i: F.xxhash64("u", i)).alias("h"), F.xxhash64("u").alias("seed")).first()
    assert K.mean_square(x) == got.ms  # to the last bit
    assert K.xxhash64_ints(np.arange(1000), got.seed).tolist() == got.h


def test_few_clips_are_many_tasks(spark, sf_dir):
    made = signals.clips(spark, sf_dir)
    used = made.select(F.spark_partition_id().alias("p")).distinct().count()
    assert used > spark.sparkContext.defaultParallelism  # one task made all of them


def test_noise_leaves_python_in_small_pieces(spark):
    clips = spark.range(300).select(F.col("id").alias("clip_id"), F.array_repeat(F.lit(0.25), 400).alias("samples")).coalesce(1)
    rows = signals.FR.add_noise(clips, [("white", 10.0), ("babble", 5.0)], RATE, ("samples", "mean_square")).collect()
    assert len(rows) == 600 and len({(r.clip_id, r.kind, r.snr_db) for r in rows}) == 600
    assert all(K.mean_square(np.array(r.samples)) == r.mean_square for r in rows[::50])


def test_clips_are_made_and_encoded_without_a_way_through_spark(spark, sf_dir):
    from speechtable.sources import readers

    plan = catalog.queries()["a14_encode_pcm16"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan
    rows = signals.clip_rows(spark, sf_dir)
    for symmetric in (False, True):
        whole = readers.encode_pcm16(rows, symmetric, make=(signals._clips_of, "clip_id string"))
        assert whole.columns == ["clip_id", "payload"]
        apart = readers.encode_pcm16(signals.clips(spark, sf_dir), symmetric).select("clip_id", "payload")
        assert {(r.clip_id, bytes(r.payload)) for r in whole.collect()} == {(r.clip_id, bytes(r.payload)) for r in apart.collect()}


def test_what_clips_have_in_common_is_computed_once():
    signals._clean.cache_clear()
    i, hash_ = np.arange(signals.CLIP), lambda seed: (K.xxhash64_ints(np.arange(signals.CLIP), seed) % 2001 - 1000) / 1000.0
    for n in range(1, 200):
        user, seed = n % 10, n * 7919
        assert (signals._clip("view", user, n, seed) == (0.25 * np.sin(2 * 3.141592653589793 * (130 + user * 9) * i / 16000.0) + 0.2 * hash_(seed)).astype(np.float32)).all()
        assert (signals._clip("purchase", user, n, seed) == (np.where(i % (84 + user) == 0, 0.6, 0.0) + 0.08 * hash_(seed)).astype(np.float32)).all()
        assert (signals._clip(None, user, n, seed) == (0.25 * np.sin(2 * 3.141592653589793 * (110 + user * 12 + (n % 9 - 4) * 20 * i / 16000.0) * i / 16000.0)).astype(np.float32)).all()
    assert signals._clean.cache_info().misses <= 10 + 10 + 90
