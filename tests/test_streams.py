"""Streaming forms: state that expires, state over many triggers, and speakers and overlap against loops."""

import time
from functools import partial

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from speechtable import catalog
from speechtable.functions import columns as C
from speechtable.operators import acoustics as A
from speechtable.operators import diarizers as D
from speechtable.operators import segments as G
from speechtable.operators import speakers as S
from speechtable.operators import utterances as U
from speechtable.operators.speakers import THRESHOLD
from speechtable.plans import stream_sessions, streams
from speechtable.session import shared_dir
from speechtable.streaming import processors as P
from speechtable.streaming import sessions as SS


def frames(spark, pattern, first=0):
    return spark.createDataFrame([(1, first + i, c == "x") for i, c in enumerate(pattern)], "session_id long, frame_idx long, voiced boolean")


def run(spark, tmp_path, batches, wait=0.0, **how):
    spark.conf.set(streams._PROVIDER, streams._STORE)
    try:
        for k, b in enumerate(batches):
            if k:
                time.sleep(wait)
            b.write.mode("append").parquet(str(tmp_path / "in"))
            made = P.stream_vad(spark.readStream.schema(b.schema).parquet(str(tmp_path / "in")), 3, **how)
            made.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(once=True).start().awaitTermination(60)
    finally:
        spark.conf.unset(streams._PROVIDER)
    return [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("frame_idx").select("segment_no", "segment_started").collect()]


@pytest.mark.parametrize("how,wait,want", [({}, 0.0, (1, False)), ({"ttl_ms": 600_000}, 0.0, (1, False)), ({"ttl_ms": 1000}, 3.0, (1, True))])
def test_state_lives_over_restarts_until_it_expires(spark, tmp_path, how, wait, want):
    got = run(spark, tmp_path, [frames(spark, "xx"), frames(spark, "xx", 2)], wait, **how)
    assert got[0] == (1, True) and got[2] == want


def test_speakers_and_overlap_row_by_row(spark, sf_dir):
    turns = streams._turns(spark, sf_dir).orderBy("session_id", "seq").collect()
    speakers = {(r.session_id, r.seq): r for r in catalog.queries()["k4_stream_speakers"](spark, sf_dir).collect()}
    batch = {(r.session_id, r.seq): r for r in catalog.queries()["f5_cluster_speakers"](spark, sf_dir).collect()}
    overlap = {(r.session_id, r.seq): r.overlapping for r in catalog.queries()["k5_stream_overlap"](spark, sf_dir).collect()}
    assert len(turns) == len(speakers) == len(batch) == len(overlap)
    session = None
    for t in turns:
        if t.session_id != session:
            session, means, counts, ring = t.session_id, [], [], []
        e = np.array(t.embedding, float)
        sims = [float(e @ m) for m in means]
        best = max(range(len(sims)), key=sims.__getitem__) if sims else None
        if best is not None and sims[best] >= THRESHOLD:
            mean = (means[best] * counts[best] + e) / (counts[best] + 1)
            means[best], counts[best], no = mean / (np.linalg.norm(mean) + 1e-8), counts[best] + 1, best + 1
        else:
            means.append(e), counts.append(1)
            no = len(means)
        key = (t.session_id, t.seq)
        assert speakers[key].speaker_no == batch[key].speaker_no == no
        assert speakers[key].similarity == pytest.approx(sims[best] if sims else -1.0, abs=1e-9)
        assert overlap[key] == "|".join(map(str, sorted({s for end, s in ring if t.start_time < end - 0.2 and s != no})))
        ring = [*ring, (t.end_time, no)][-5:]


def test_local_folders_are_for_local_masters():
    class Session:
        class conf:
            get = staticmethod(lambda name, default=None: default)

        class sparkContext:
            master = "local[4]"

    assert shared_dir(Session).startswith("file:")
    Session.sparkContext.master = "spark://host:7077"
    with pytest.raises(ValueError):
        shared_dir(Session)
    Session.conf.get = staticmethod(lambda name, default=None: "/shared/")
    assert shared_dir(Session) == "/shared"


def test_a_captions_query_does_what_the_batch_operators_do(spark, sf_dir):
    """Frames to segments, speakers, baselines, pauses and overlap, each by its batch operator."""
    frames = stream_sessions.with_vectors(streams._clocked(spark, sf_dir))
    vad = G.vad_state(frames, stream_sessions.SILENCE)
    closed = G.speech_segments(vad, stream_sessions.SILENCE).withColumn("seq", F.col("segment_no"))
    own = vad.filter("voiced").join(closed.select("session_id", "segment_no", "seq", "end_frame", "first_frame"), ["session_id", "segment_no"])
    total = [F.sum(F.get("vector", F.lit(i))).alias(f"x{i}") for i in range(4)]
    turns = own.groupBy("session_id", "seq", "end_frame").agg(
        F.min("frame_idx").alias("a"), F.max("frame_idx").alias("b"), (10 * F.log10(F.avg(F.pow(F.lit(10.0), F.col("level_dbfs") / 10)))).alias("rms_db"), F.avg("pitch_hz").alias("mean_pitch_hz"), *total
    )
    norm = F.sqrt(sum(F.col(f"x{i}") * F.col(f"x{i}") for i in range(4))) + 1e-8
    at = lambda c: (F.col(c) + 1) * G.FRAME / float(G.RATE)
    turns = turns.withColumns({"embedding": F.array(*(F.col(f"x{i}") / norm for i in range(4))), "start_time": at("a"), "end_time": at("b")})
    said = turns.join(D.diarize(turns, partial(D.Greedy, threshold=0.9)), ["session_id", "seq"]).withColumn("speaker_id", F.col("speaker_no"))
    said = U.temporal_overlap(U.long_pause_before(A.rms_baseline(S.assign_labels(said).withColumn("label", C.speaker_label(F.col("speaker_id"))))))
    want = said.select("session_id", "seq", F.col("end_frame").alias("closed_frame"), "label", F.round("start_time", 6), F.round("end_time", 6), F.round("pause_s", 6), "long_pause_before", C.relative_volume(F.col("rms_db"), F.col("rms_baseline")), "overlapping_speakers")
    got = catalog.queries()["k12_stream_captions"](spark, sf_dir)
    got = got.select("session_id", "seq", "closed_frame", "label", F.round("start_time", 6), F.round("end_time", 6), F.round("pause_s", 6), "long_pause_before", "relative_volume", "overlapping")
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(map(tuple, want.collect())) and len({r[3] for r in rows}) > 2 and len(rows) > 50


@pytest.mark.parametrize("most", [None, 3])
def test_diarizers_row_by_row(spark, sf_dir, most):
    turns = stream_sessions.heard(spark, sf_dir)
    got = {(r.session_id, r.seq): r for r in D.diarize(turns, partial(D.Greedy, most=most)).collect()}
    streamed = {(r.session_id, r.seq): r for r in streams.drained(turns, "seq % 250", lambda s: SS.stream_diarized(s, partial(D.Greedy, most=most))).collect()}
    session = None
    for t in turns.orderBy("session_id", "seq").collect():
        if t.session_id != session:
            session, means, counts = t.session_id, [], []
        e = np.array(t.embedding, float)
        sims = [float(e @ m) for m in means]
        best = max(range(len(sims)), key=sims.__getitem__) if sims else None
        if best is not None and (sims[best] >= THRESHOLD or len(means) == most):
            mean = (means[best] * counts[best] + e) / (counts[best] + 1)
            means[best], counts[best], no = mean / (np.linalg.norm(mean) + 1e-8), counts[best] + 1, best + 1
        else:
            means.append(e), counts.append(1)
            no = len(means)
        key = (t.session_id, t.seq)
        assert got[key].speaker_no == streamed[key].speaker_no == no
        assert got[key].similarity == pytest.approx(sims[best] if sims else -1.0, abs=1e-9)
    if most:
        assert max(r.speaker_no for r in got.values()) == most


def test_ended_sessions_leave_no_state(spark, sf_dir, tmp_path):
    rows = streams._clocked(spark, sf_dir)
    made = {}

    def start(stream, top):
        made["top"] = top
        return SS.stream_idle_end(stream, stream_sessions.IDLE_MS).writeStream.format("parquet").option("path", f"{top}/out").option("checkpointLocation", f"{top}/state").trigger(availableNow=True).start()

    top = streams._run(rows, "frame_idx", start, None)
    ended = {r.session_id for r in spark.read.parquet(f"{top}/out").collect()}
    held = {r[0] for r in spark.read.format("statestore").option("stateVarName", "held").load(f"{top}/state").select("key.session_id").collect()}
    assert ended and held and not ended & held and ended | held == {r[0] for r in rows.select("session_id").distinct().collect()}


class Kept:
    """Stands for a state that holds one value."""

    value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def test_segments_of_many_short_sessions_need_no_tables():
    """A thousand sessions of 20 frames take less than a millisecond each; those of a table each took several."""
    names = ("session_id", "frame_idx", "ts", "voiced", "level_dbfs", "pitch_hz", "vector")
    frames = [Row(*names)(7, i, None, i % 5 < 2, None if i == 5 else -20.0, 100.0 if i % 2 else None, [1.0, 0.0]) for i in range(20)]
    took = []
    for _ in range(1000):
        made = SS.Segments(2)
        made._held = Kept()
        began = time.perf_counter()
        out = list(made.handleInputRows((7,), iter(frames[::-1]), None))
        took.append(time.perf_counter() - began)
    assert [(r.seq, r.rms_db, r.mean_pitch_hz) for r in out] == [(1, -20.0, 100.0), (2, None, 100.0), (3, -20.0, 100.0), (4, -20.0, 100.0)]
    assert sorted(took)[500] < 0.001


def test_vad_in_blocks_agrees_with_a_walk_over_frames(monkeypatch):
    from speechtable.streaming import processors as P

    class Held:
        value = None

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

    rng = np.random.default_rng(4)
    voiced = rng.random(3000) < 0.2
    last, collected, segment, due = -1, 0, 0, []
    for i, v in enumerate(voiced.tolist()):
        started = v and (last < 0 or i - last > 3)
        segment, collected = (segment + 1, 0) if started else (segment, collected)
        last = i if v else last
        speaking = last >= 0 and i - last < 3
        collected += speaking
        due.append((i, speaking, started, last >= 0 and i - last == 3, segment, speaking and collected % 4 == 0))
    monkeypatch.setattr(P, "BLOCK", 70)
    vad, got, sizes = P.Vad(3, 4), [], []
    vad._held = Held()
    for a, b in ((0, 900), (900, 901), (901, 3000)):
        own = pd.DataFrame({"frame_idx": np.arange(a, b), "voiced": voiced[a:b], "control": [None] * (b - a)}).sample(frac=1, random_state=1)
        for t in vad.handleInputRows((7,), iter([own[: len(own) // 2], own[len(own) // 2 :]]), None):
            sizes.append(len(t))
            got += list(t.drop(columns="session_id").itertuples(index=False, name=None))
    assert got == due and max(sizes) <= 2 * 70  # a trigger's rows left in one table


class HeldByName:
    """A map of a state, or one value of it under the name None."""

    def __init__(self):
        self.rows = {}

    def getValue(self, key):
        return self.rows.get(key)

    def updateValue(self, key, value):
        self.rows[key] = value

    def removeKey(self, key):
        del self.rows[key]

    def exists(self):
        return None in self.rows

    def get(self):
        return self.rows[None]

    def update(self, value):
        self.rows[None] = value

    def clear(self):
        self.rows.pop(None, None)


@pytest.mark.parametrize("make", [lambda: P.Vad(2, 4), lambda: P.Live(width=3)])
def test_a_group_of_sessions_is_one_call_and_one_table(make):
    rng = np.random.default_rng(8)
    n = 60 * 40
    rows = pd.DataFrame({"session_group": 3, "session_id": np.repeat(np.arange(60) + 2**60, 40), "frame_idx": np.tile(np.arange(40), 60), "voiced": rng.random(n) < 0.4, "pitch_hz": rng.uniform(80, 300, n), "level_dbfs": rng.uniform(-60, 0, n)})
    rows["control"] = np.select([rows.frame_idx % 20 == 19, rows.frame_idx % 20 == 0], ["end", "start"], None)
    group = make()
    group.grouped, group._held = True, HeldByName()
    alone = {s: make() for s in rows.session_id.unique().tolist()}
    for a in alone.values():
        a._held = HeldByName()
    for first, last in ((0, 7), (7, 30), (30, 40)):
        own = rows[(rows.frame_idx >= first) & (rows.frame_idx < last)].sample(frac=1, random_state=1)
        tables = list(group.handleInputRows((3,), iter([own[: len(own) // 2], own[len(own) // 2 :]]), None))
        single = [t for s, a in alone.items() for t in a.handleInputRows((s,), iter([own[own.session_id == s].drop(columns=["session_group", "session_id"])]), None)]
        assert len(tables) == 1
        pd.testing.assert_frame_equal(tables[0], pd.concat(single, ignore_index=True), check_dtype=False)
        assert group._held.rows == {(s,): a._held.rows[None] for s, a in alone.items() if a._held.rows}
    assert group._held.rows == {}  # all ended


def test_groups_keep_large_ids_and_rows_without_a_session(spark, tmp_path):
    ids = [None, 0, 2**60 + 1, 2**60 + 2, *range(100, 140)]
    at = lambda first: spark.createDataFrame([(s, first + i, (first + i) % 3 > 0) for s in ids for i in range(5)], "session_id long, frame_idx long, voiced boolean")
    for groups, folder in ((7, "a"), (1, "b")):
        (tmp_path / folder).mkdir()
        run(spark, tmp_path / folder, [at(0), at(5)], groups=groups)
        got = spark.read.parquet(str(tmp_path / folder / "out")).groupBy("session_id").agg(F.count("*").alias("n"), F.max("segment_no").alias("last"), F.count_if("segment_started").alias("starts")).collect()
        assert {tuple(r) for r in got} == {(s, 10, 1, 1) for s in ids} and len(got) == len(ids)
