"""Stateful processors whose state is kept by name: speakers in a map, sessions that end by the watermark, and one query from
frames to captions.

A trigger's rows of a session come in no order and are sorted here; the sources hand on each session in its own order.

Rows come and go as Row objects: most sessions have a few rows in a trigger, and a pandas table for each of them, in and out of
every operator, takes longer than the work on it.
"""

from __future__ import annotations

import sys
from collections import namedtuple
from collections.abc import Callable, Iterator
from operator import attrgetter

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import NumericType

from ..operators.segments import FRAME, MIN_SILENCE, RATE

#: utterances of a speaker that a baseline is made of, the level without any, and the least pitch that counts
HISTORY, LEVEL, LEAST_PITCH = 20, -24.0, 50.0
_SPEAKER = "centroid array<double>, count long, levels array<double>, pitches array<double>"


def _sorted(rows: Iterator[Row], order: str) -> list[Row]:
    return sorted(rows, key=attrgetter(order))


def _known(x: float | None) -> bool:
    return x is not None and x == x


class Diarized(StatefulProcessor):
    """A diarizer for each session; of each speaker the diarizer's value, and levels and pitches lately heard.

    State: a map from the speaker's number to these. A trigger reads the map once and writes the speakers that spoke.
    """

    columns = ["session_id", "seq", "ts", "speaker_no", "similarity", "confidence", "rms_baseline", "pitch_baseline", "start_time", "end_time", "rms_db", "mean_pitch_hz"]

    def __init__(self, make: Callable[[], object], numbers: frozenset[str] = frozenset()) -> None:
        self.make, self.numbers = make, numbers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._speakers = handle.getMapState("speakers", "speaker_no int", _SPEAKER)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        turns = _sorted(rows, "seq")
        names = turns[0].__fields__
        shape = namedtuple("Turn", names)
        held = {k[0]: v for k, v in self._speakers.iterator()} if self._speakers.exists() else {}
        diarizer = self.make()
        diarizer.load({k: (list(v[0]), int(v[1])) for k, v in held.items()})
        levels = {k: list(v[2]) for k, v in held.items()}
        pitches = {k: list(v[3]) for k, v in held.items()}
        out, made = Row(*self.columns), []
        for turn in turns:
            no, similarity, confidence = diarizer.diarize_segment(shape(*(self._plain(c, v) for c, v in zip(names, turn))))
            level, pitch = levels.setdefault(no, []), pitches.setdefault(no, [])
            made.append(out(
                key[0], turn.seq, turn.ts, no, similarity, confidence, float(np.mean(level)) if level else LEVEL, float(np.median(pitch)) if pitch else None,
                turn.start_time, turn.end_time, turn.rms_db, turn.mean_pitch_hz,
            ))
            if _known(turn.rms_db):
                levels[no] = [*level, float(turn.rms_db)][-HISTORY:]
            if _known(turn.mean_pitch_hz) and turn.mean_pitch_hz > LEAST_PITCH:
                pitches[no] = [*pitch, float(turn.mean_pitch_hz)][-HISTORY:]
        for no in diarizer.changed:
            centroid, count = diarizer.speakers[no]
            self._speakers.updateValue((no,), (centroid, count, levels.get(no, []), pitches.get(no, [])))
        yield from made

    def _plain(self, name: str, value):
        """As a diarizer gets it in batch: lists as arrays, and numbers that aren't known as NaN."""
        return np.asarray(value) if isinstance(value, list) else np.nan if value is None and name in self.numbers else value

    def close(self) -> None:
        pass


DIARIZED = "session_id long, seq long, ts timestamp, speaker_no int, similarity double, confidence double, rms_baseline double, pitch_baseline double, start_time double, end_time double, rms_db double, mean_pitch_hz double"


class IdleEnd(StatefulProcessor):
    """What a session has had so far, given out when the watermark has passed its last frame by `idle_ms`; then its state goes."""

    columns = ["session_id", "frames", "voiced_frames", "last_frame", "ended_ms"]

    def __init__(self, idle_ms: int) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._held = handle.getValueState("held", "frames long, voiced_frames long, last_frame long, last_ms long, timer_ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        frames, voiced, last, last_ms, timer = tuple(self._held.get()) if self._held.exists() else (0, 0, -1, -1, -1)
        for f in rows:
            frames += 1
            voiced += bool(f.voiced)
            last = max(last, f.frame_idx)
            last_ms = max(last_ms, f.ts_ms)
        due = last_ms + self.idle_ms
        if due != timer:
            if timer >= 0:
                self._handle.deleteTimer(timer)
            self._handle.registerTimer(due)
        self._held.update((frames, voiced, last, last_ms, due))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        frames, voiced, last, _, due = tuple(self._held.get())
        self._held.clear()
        yield Row(*self.columns)(key[0], frames, voiced, last, due)

    def close(self) -> None:
        pass


class Segments(StatefulProcessor):
    """Frames to closed segments, with the sums of what its frames say: seconds, level, pitch, and a unit vector of its frames'."""

    columns = ["session_id", "seq", "ts", "start_time", "end_time", "rms_db", "mean_pitch_hz", "embedding"]

    def __init__(self, min_silence: int = MIN_SILENCE) -> None:
        self.min_silence = min_silence

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._held = handle.getValueState("held", "last_voiced long, first long, segments long, voiced long, power double, pitch double, pitched long, vector array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last, first, segments, voiced, power, pitch, pitched, vector = tuple(self._held.get()) if self._held.exists() else (-1, -1, 0, 0, 0.0, 0.0, 0, None)
        vector = np.asarray(vector if vector is not None else [], float)
        out, made = Row(*self.columns), []
        for f in _sorted(rows, "frame_idx"):
            if f.voiced:
                if first < 0:
                    first, voiced, power, pitch, pitched, vector = f.frame_idx, 0, 0.0, 0.0, 0, np.zeros(len(f.vector))
                last = f.frame_idx
                voiced += 1
                power += np.nan if f.level_dbfs is None else 10 ** (f.level_dbfs / 10)
                vector = vector + np.asarray(f.vector, float)
                if _known(f.pitch_hz):
                    pitch, pitched = pitch + f.pitch_hz, pitched + 1
            elif first >= 0 and f.frame_idx - last >= self.min_silence:
                segments += 1
                at = lambda i: (i + 1) * FRAME / RATE
                level = 10 * float(np.log10(power / voiced))
                made.append(out(key[0], segments, f.ts, at(first), at(last), level if _known(level) else None, pitch / pitched if pitched else None, (vector / (np.linalg.norm(vector) + 1e-8)).tolist()))
                first = -1
        self._held.update((int(last), int(first), int(segments), int(voiced), float(power), float(pitch), int(pitched), vector.tolist()))
        yield from made

    def close(self) -> None:
        pass


SEGMENTS = "session_id long, seq long, ts timestamp, start_time double, end_time double, rms_db double, mean_pitch_hz double, embedding array<double>"


class Captions(StatefulProcessor):
    """Speaker turns to caption rows: label, pause before, level against the speaker's own, and whom it overlaps with."""

    columns = ["session_id", "seq", "ts", "start_time", "end_time", "label", "pause_s", "long_pause_before", "relative_volume", "overlapping"]

    def __init__(self, lookback: int = 5, slack_s: float = 0.2, long_pause_s: float = 1.2) -> None:
        self.lookback, self.slack_s, self.long_pause_s = lookback, slack_s, long_pause_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._recent = handle.getListState("recent", "end_time double, speaker_no int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        recent = [(float(e), int(s)) for e, s in self._recent.get()] if self._recent.exists() else []
        label = lambda n: f"Speaker {chr(64 + n)}" if n <= 8 else f"Speaker {n}"
        out, made = Row(*self.columns), []
        for t in _sorted(rows, "seq"):
            pause = max(0.0, t.start_time - (recent[-1][0] if recent else 0.0))
            over = sorted({label(s) for e, s in recent if t.start_time < e - self.slack_s and s != t.speaker_no})
            above = t.rms_db - t.rms_baseline if _known(t.rms_db) else 0.0
            volume = "loud" if above > 4.5 else "quiet" if above < -5 else "normal"
            made.append(out(key[0], t.seq, t.ts, t.start_time, t.end_time, label(t.speaker_no), pause, pause >= self.long_pause_s, volume, over))
            recent = [*recent, (float(t.end_time), int(t.speaker_no))][-self.lookback :]
        self._recent.put(recent)
        yield from made

    def close(self) -> None:
        pass


CAPTIONS = "session_id long, seq long, ts timestamp, start_time double, end_time double, label string, pause_s double, long_pause_before boolean, relative_volume string, overlapping array<string>"

# the planning of a stateful query unpickles its processor in a Python process that has no shipped files
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _stateful(df: DataFrame, processor: StatefulProcessor, schema: str, mode: str = "EventTime", handed_on: bool = True) -> DataFrame:
    """handed_on: ts of what comes out is event time to the next stateful operator."""
    more = {"eventTimeColumnName": "ts"} if handed_on else {}
    return df.groupBy("session_id").transformWithState(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode=mode, **more)


def stream_diarized(turns: DataFrame, make: Callable[[], object], needs: tuple[str, ...] = ("embedding",)) -> DataFrame:
    """turns (session_id, seq, ts, start_time, end_time, rms_db, mean_pitch_hz, what the diarizer needs) -> DIARIZED: speakers by
    a diarizer of the user's, and each one's baselines before the turn, kept over all triggers."""
    columns = dict.fromkeys(["session_id", "seq", "ts", "start_time", "end_time", "rms_db", "mean_pitch_hz", *needs])
    own = turns.select(*columns)
    numbers = frozenset(f.name for f in own.schema if isinstance(f.dataType, NumericType))
    return _stateful(own, Diarized(make, numbers), DIARIZED, "None", False)


def stream_idle_end(frames: DataFrame, idle_ms: int, late: str = "0 seconds") -> DataFrame:
    """frames (session_id, frame_idx, voiced, ts) -> a row for each session that ends: silent for idle_ms of event time."""
    own = frames.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).withColumn("ts_ms", F.unix_millis("ts"))
    return _stateful(own.select("session_id", "frame_idx", "voiced", "ts", "ts_ms"), IdleEnd(idle_ms), "session_id long, frames long, voiced_frames long, last_frame long, ended_ms long", handed_on=False)


def stream_captions(frames: DataFrame, make: Callable[[], object], min_silence: int = MIN_SILENCE, late: str = "0 seconds") -> DataFrame:
    """frames (session_id, frame_idx, ts, voiced, level_dbfs, pitch_hz, vector) -> CAPTIONS in one query: three stateful operators
    in a row, each handing on event time."""
    own = frames.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    segments = _stateful(own.select("session_id", "frame_idx", "ts", "voiced", "level_dbfs", "pitch_hz", "vector"), Segments(min_silence), SEGMENTS)
    speakers = _stateful(segments, Diarized(make, frozenset(("rms_db", "mean_pitch_hz"))), DIARIZED)
    return _stateful(speakers, Captions(), CAPTIONS, handed_on=False)


def speaker_snapshot(spark, checkpoint: str, operator: int = 0) -> DataFrame:
    """The speakers that a running or stopped query of stream_diarized holds, read from its state as a table: session_id,
    speaker_no, count, and how many levels and pitches are held."""
    state = spark.read.format("statestore").option("operatorId", operator).option("stateVarName", "speakers").load(checkpoint)
    value = F.col("user_map_value")
    return state.select(F.col("key.session_id").alias("session_id"), F.col("user_map_key.speaker_no").alias("speaker_no"), value["count"].alias("count"), F.size(value["levels"]).alias("levels"), F.size(value["pitches"]).alias("pitches"))
