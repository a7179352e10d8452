"""Stateful processors: one session's state is what the next rows need, never the session's history.

Rows of a micro-batch come in no order, so each processor sorts what it gets of a group of sessions by session, and frame or
sequence number; the source's maxFilesPerTrigger bounds how much that is. A trigger must not overtake a session's own order: sources partition by
session, and late rows are cut off by the watermark in front.

Rows may say `control`: "start" makes the session anew, and the row is its first; "end" deletes the session's state, and the
row itself gives nothing. With `ttl_ms`, state that no row has touched for so long is deleted as well. Such a query looks for
expired state as long as it runs, so it needs a trigger by time or by batch; with availableNow it would never end.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.segments import MIN_SILENCE
from ..operators.speakers import THRESHOLD


#: rows that are worked on and given out at once
BLOCK = 100_000
#: groups that sessions fall into by a hash. A call of Python takes several ms, however little a session has to say
GROUPS = 1024


def _sorted_columns(rows: Iterator[pd.DataFrame], *order: str) -> dict[str, np.ndarray]:
    """All rows of a key in a trigger, column by column, sorted by the first column and then the others."""
    parts = [{c: p[c].to_numpy() for c in p.columns} for p in rows]
    whole = {c: np.concatenate([p.pop(c) for p in parts]) if len(parts) > 1 else parts[0].pop(c) for c in list(parts[0])}
    at = np.lexsort([whole[c] for c in reversed(order)])
    return {c: whole.pop(c)[at] for c in list(whole)}


def _median(values: list[float]) -> float:
    own, n = sorted(values), len(values)
    return (own[(n - 1) // 2] + own[n // 2]) / 2


class _State(StatefulProcessor):
    """A processor whose state of a session is one row of numbers and lists. A key is a session, or with `grouped` a group of
    sessions: then each has its row in a map, which is read and written once a trigger, and expires or is deleted by itself.
    """

    schema = ""
    start: tuple = ()
    order = "frame_idx"
    columns: tuple[str, ...] = ()
    ttl_ms: int | None = None
    grouped = False

    def init(self, handle: StatefulProcessorHandle) -> None:
        ttl = (self.ttl_ms,) if self.ttl_ms else ()
        self._held = handle.getMapState("held", "session_id long", self.schema, *ttl) if self.grouped else handle.getValueState("held", self.schema, *ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        held, made = 0, []
        for session, own in self.sessions(key[0], rows):
            state = self.read(session)
            known, ended, begin, n = state is not None, False, 0, len(own[self.order])
            state = self.start if state is None else state
            says = own.pop("control")
            marks = np.flatnonzero((says == "start") | (says == "end")).tolist()
            for at in sorted({*marks, *range(BLOCK, n, BLOCK), n}):
                if at > begin:
                    state, out = self.step(session, list(state), {c: v[begin:at] for c, v in own.items()})
                    made.append((session, out))
                    held += at - begin
                    ended, begin = False, at
                if at < n and says[at] in ("start", "end"):
                    ended = says[at] == "end"
                    state, begin = self.start, at + int(ended)
                if held >= BLOCK:
                    yield self.table(made)
                    held, made = 0, []
            if not ended:
                self.write(session, tuple(state))
            elif known:
                self.forget(session)
        if made:
            yield self.table(made)

    def sessions(self, key, rows: Iterator[pd.DataFrame]) -> Iterator[tuple[int | None, dict[str, np.ndarray]]]:
        """Each session of a key with its rows, sorted, column by column. The group below zero is of rows without a session."""
        if not self.grouped:
            yield key, _sorted_columns(rows, self.order)
            return
        own = _sorted_columns(rows, "session_id", self.order)
        own.pop("session_group")
        ids = own.pop("session_id")
        cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
        for a, b in zip(cuts, cuts[1:]):
            yield None if key < 0 else int(ids[a]), {c: v[a:b] for c, v in own.items()}

    def read(self, session) -> tuple | None:
        if self.grouped:
            return self._held.getValue((session,))
        return tuple(self._held.get()) if self._held.exists() else None

    def write(self, session, state: tuple) -> None:
        if self.grouped:
            self._held.updateValue((session,), state)
        else:
            self._held.update(state)

    def forget(self, session) -> None:
        if self.grouped:
            self._held.removeKey((session,))
        else:
            self._held.clear()

    def table(self, made: list[tuple]) -> pd.DataFrame:
        """What several steps gave of their sessions, as one table."""
        if self.columns:
            return pd.DataFrame([(s, *r) for s, m in made for r in m], columns=["session_id", *self.columns])
        whole = made[0][1] if len(made) == 1 else {c: np.concatenate([m[c] for _, m in made]) for c in made[0][1]}
        of = np.repeat(np.array([s for s, _ in made]), [len(m[self.order]) for _, m in made])
        return pd.DataFrame({"session_id": of, **whole})

    def step(self, session, state: list, own: dict[str, np.ndarray]):
        """The state and what it was given of a session, sorted, column by column -> the state, and columns, or tuples where `columns` names theirs."""
        raise NotImplementedError

    def close(self) -> None:
        pass


class Vad(_State):
    """Hysteresis over frames: last voiced frame, frames collected in the segment, its number."""

    schema = "last_voiced long, collected long, segment_no long"
    start = (-1, 0, 0)

    def __init__(self, min_silence: int = MIN_SILENCE, every: int = 38) -> None:
        self.min_silence, self.every = min_silence, every

    def step(self, session, state, own):
        last, collected, segment = state
        i, voiced = own["frame_idx"], own["voiced"] == True  # noqa: E712 (null is not)
        row = np.arange(len(i))
        latest = np.maximum.accumulate(np.where(voiced, row, -1))  # row of the last voiced frame
        upto = np.where(latest >= 0, i[latest], last)
        before = np.concatenate(([last], upto[:-1]))
        started = voiced & ((before < 0) | (i - before > self.min_silence))
        speaking = (upto >= 0) & (i - upto < self.min_silence)
        begun = np.maximum.accumulate(np.where(started, row, -1))
        counted = np.cumsum(speaking)
        counted = np.where(begun >= 0, counted - counted[begun] + speaking[begun], counted + collected)
        segments = segment + np.cumsum(started)
        out = {"frame_idx": i, "is_speaking": speaking, "segment_started": started, "segment_ended": (upto >= 0) & (i - upto == self.min_silence), "segment_no": segments, "interim_due": speaking & (counted % self.every == 0)}
        return (int(upto[-1]), int(counted[-1]), int(segments[-1])), out


VAD = "session_id long, frame_idx long, is_speaking boolean, segment_started boolean, segment_ended boolean, segment_no long, interim_due boolean"


class Live(_State):
    """Pitch direction and relative level from the last known pitches and active levels, for each frame or for each `width`
    frames in turn: mean power and median pitch of the window, speech as in its last frame."""

    schema = "pitches array<double>, levels array<double>, seen int, power double, known array<double>"
    start = ([], [], 0, 0.0, [])
    columns = ("frame_idx", "pitch_direction", "pitch_change", "relative_level_db", "emphasis_candidate")

    def __init__(self, n_pitch: int = 12, n_level: int = 30, least: int = 4, width: int = 1) -> None:
        self.n_pitch, self.n_level, self.least, self.width = n_pitch, n_level, least, width

    def step(self, session, state, own):
        pitches, levels, seen, power, known = list(state[0]), list(state[1]), state[2], state[3], list(state[4])
        out = []
        for i, voiced, pitch, level in zip(*(own[c].tolist() for c in ("frame_idx", "voiced", "pitch_hz", "level_dbfs"))):
            pitch = None if pitch is None or pitch != pitch else float(pitch)
            if self.width > 1:
                seen, power = seen + 1, power + 10 ** (level / 10)
                known = known if pitch is None else [*known, pitch]
                if seen < self.width:
                    continue
                level = 10 * float(np.log10(max(power / seen, 1e-12)))
                pitch = _median(known) if voiced and known else None
                seen, power, known = 0, 0.0, []
            before = _median(pitches) if pitches else None
            change = 12 * float(np.log2(pitch / before)) if pitch is not None and before else None
            direction = "unavailable" if pitch is None else "steady" if change is None or abs(change) < 1.2 else "rising" if change > 0 else "falling"
            relative = float(level - _median(levels)) if voiced and len(levels) >= self.least else None
            out.append((i, direction, change, relative, bool(voiced and relative is not None and change is not None and relative >= 6 and abs(change) >= 1.5)))
            if pitch is not None:
                pitches = [*pitches, pitch][-self.n_pitch :]
            if voiced and level > -55:
                levels = [*levels, float(level)][-self.n_level :]
        return (pitches, levels, int(seen), float(power), known), out


LIVE = "session_id long, frame_idx long, pitch_direction string, pitch_change double, relative_level_db double, emphasis_candidate boolean"


class Speakers(_State):
    """Greedy clustering, and overlap with the last five utterances: centroids (flat), counts, and the ring."""

    order = "seq"
    schema = "centroids array<double>, counts array<long>, ends array<double>, speakers array<long>"
    start = ([], [], [], [])
    columns = ("seq", "speaker_no", "similarity", "confidence", "overlapping")

    def __init__(self, threshold: float = THRESHOLD, lookback: int = 5, slack_s: float = 0.2) -> None:
        self.threshold, self.lookback, self.slack_s = threshold, lookback, slack_s

    def step(self, session, state, own):
        from speechtable.operators.diarizers import Greedy

        diarizer = Greedy(self.threshold)
        counts = [int(x) for x in state[1]]
        if counts:
            diarizer.load({i: (c, n) for i, (c, n) in enumerate(zip(np.asarray(state[0], float).reshape(len(counts), -1), counts), 1)})
        ends, speakers = list(state[2]), [int(x) for x in state[3]]
        out = []
        for r in pd.DataFrame(own).itertuples(index=False):
            no, similarity, confidence = diarizer.diarize_segment(r)
            over = sorted({s for e, s in zip(ends, speakers) if r.start_time < e - self.slack_s and s != no})
            out.append((r.seq, no, similarity, confidence, over))
            ends, speakers = [*ends, float(r.end_time)][-self.lookback :], [*speakers, no][-self.lookback :]
        known = [diarizer.speakers[i] for i in sorted(diarizer.speakers)]
        flat = np.concatenate([c for c, _ in known]).tolist() if known else []
        return (flat, [n for _, n in known], ends, speakers), out


SPEAKERS = "session_id long, seq long, speaker_no int, similarity double, confidence double, overlapping array<int>"


def deduplicated(frames: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Late and repeated frames go."""
    return frames.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["session_id", "frame_idx"])


# the planning of a stateful query unpickles its processor in a Python process that has no shipped files
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _run(df: DataFrame, columns: str, processor: _State, schema: str, ttl_ms: int | None, groups: int | None) -> DataFrame:
    """groups: how many groups sessions fall into; it stays the same as long as a checkpoint lives. None: each is a key."""
    control = F.col("control").cast("string") if "control" in df.columns else F.lit(None).cast("string")
    own = df.select(*columns.split(), control.alias("control"))
    processor.ttl_ms, processor.grouped = ttl_ms, groups is not None
    if groups is not None:
        session = F.col("session_id")
        group = F.when(session.isNull(), -1).otherwise(F.pmod(F.xxhash64(session), F.lit(groups))).cast("int")
        # a null among them would make the ids of a batch floats in pandas
        own = own.withColumns({"session_group": group, "session_id": F.coalesce(session, F.lit(0)).cast("long")})
    mode = "ProcessingTime" if ttl_ms else "None"
    return own.groupBy("session_id" if groups is None else "session_group").transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode=mode)


def stream_vad(frames: DataFrame, min_silence: int = MIN_SILENCE, every: int = 38, ttl_ms: int | None = None, groups: int | None = GROUPS) -> DataFrame:
    return _run(frames, "session_id frame_idx voiced", Vad(min_silence, every), VAD, ttl_ms, groups)


def stream_live_prosody(frames: DataFrame, ttl_ms: int | None = None, groups: int | None = GROUPS, **how) -> DataFrame:
    return _run(frames, "session_id frame_idx voiced pitch_hz level_dbfs", Live(**how), LIVE, ttl_ms, groups)


def stream_speakers(turns: DataFrame, ttl_ms: int | None = None, groups: int | None = GROUPS, **how) -> DataFrame:
    return _run(turns, "session_id seq start_time end_time embedding", Speakers(**how), SPEAKERS, ttl_ms, groups)


def stream_live_levels(frames: DataFrame, width: str = "192 milliseconds", late: str = "10 minutes") -> DataFrame:
    """Mean power of tumbling event-time windows."""
    own = frames.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return own.groupBy("session_id", F.window("ts", width)).agg(F.count("*").alias("frames"), (10 * F.log10(F.avg(F.pow(F.lit(10.0), F.col("level_dbfs") / 10)))).alias("level_dbfs"))


def stream_segments(frames: DataFrame, gap: str = "432 milliseconds", late: str = "10 minutes") -> DataFrame:
    """Segments as session windows over voiced frames."""
    own = frames.filter("voiced").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return own.groupBy("session_id", F.session_window("ts", gap)).agg(F.count("*").alias("voiced_frames")).select("session_id", F.col("session_window.start").alias("first_ts"), F.col("session_window.end").alias("closed_ts"), "voiced_frames")


def stream_upsert(captions: DataFrame, path: str, checkpoint: str):
    """Interim and final captions to a table of which `current` reads the later of each id. Starts the query and gives it back.

    An epoch writes the ids that it changes and nothing else; one that runs again writes the same folder again.
    """
    from ..operators.utterances import upsert_captions

    def write(batch: DataFrame, epoch: int) -> None:
        upsert_captions(batch).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return captions.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(changes: DataFrame) -> DataFrame:
    """What stream_upsert wrote (or a part of it) -> the latest row of each id, at the place of the id's first."""
    others = [c for c in changes.columns if c not in ("session_id", "id", "position", "epoch")]
    latest = changes.groupBy("session_id", "id").agg(F.min("position").alias("position"), F.max_by(F.struct(*others), "seq").alias("x"))
    return latest.select("session_id", "id", "position", "x.*")
