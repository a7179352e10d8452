"""Diarizers: who speaks in a segment. A user's own one is a class with `diarize_segment` and `reset`, run per session in
batch (`diarize`) and in streams (`streaming.sessions.stream_diarized`), where its speakers are saved between triggers.

A diarizer keeps a value for each speaker it knows, `speakers[number] = (centroid, count)`, numbers from 1 in order of first
appearance; whatever it needs of the past must be in there. What it changes it names in `changed`, and only that is saved.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .speakers import THRESHOLD


class Diarizer:
    """Base of all: diarize_segment(turn) -> (number, similarity, confidence); turn has the columns of the input row."""

    def __init__(self) -> None:
        self.reset()

    def reset(self) -> None:
        """A new session: nobody is known."""
        self.speakers: dict[int, tuple[list[float], int]] = {}
        self.changed: set[int] = set()

    def load(self, speakers: dict[int, tuple[list[float], int]]) -> None:
        self.reset()
        self.speakers = dict(speakers)

    def put(self, number: int, centroid: list[float], count: int) -> None:
        self.speakers[number] = (centroid, count)
        self.changed.add(number)

    def diarize_segment(self, turn: Any) -> tuple[int, float, float]:
        raise NotImplementedError


class Greedy(Diarizer):
    """The most similar known speaker if it is similar enough, else a new one. With `most`, no more than so many: then the most
    similar one speaks, however unlike."""

    def __init__(self, threshold: float = THRESHOLD, most: int | None = None) -> None:
        self.threshold, self.most = threshold, most
        super().__init__()

    def reset(self) -> None:
        super().reset()
        self._means = np.zeros((0, 0))  # room for more rows than are in use

    def load(self, speakers) -> None:
        super().load(speakers)
        if speakers:
            self._means = np.array([speakers[n][0] for n in sorted(speakers)], float)

    def diarize_segment(self, turn: Any) -> tuple[int, float, float]:
        e = np.asarray(turn.embedding, float)
        known = len(self.speakers)
        best, at = -1.0, -1
        if known:
            similar = self._means[:known] @ e  # one product a turn
            at = int(similar.argmax())
            best = float(similar[at])
        if known and (best >= self.threshold or known == self.most):
            n = self.speakers[at + 1][1]
            mean = (self._means[at] * n + e) / (n + 1)
            self._means[at] = mean / (np.linalg.norm(mean) + 1e-8)
            self.put(at + 1, self._means[at].tolist(), n + 1)
            return at + 1, best, float(min(1.0, max(0.0, (best + 0.2) / 0.8)))
        if known == len(self._means):
            grown = np.zeros((max(4, 2 * known), len(e)))
            grown[:known] = self._means[:known] if known else 0
            self._means = grown
        self._means[known] = e
        self.put(known + 1, e.tolist(), 1)
        return known + 1, best, 1.0 if not known else 0.85


class Channel(Diarizer):
    """One speaker a channel: whoever has a microphone of their own is known by it."""

    def diarize_segment(self, turn: Any) -> tuple[int, float, float]:
        channel = float(turn.channel)
        for number, (held, count) in self.speakers.items():
            if held[0] == channel:
                self.put(number, held, count + 1)
                return number, 1.0, 1.0
        number = len(self.speakers) + 1
        self.put(number, [channel], 1)
        return number, 1.0, 1.0


DIARIZED = "session_id long, seq long, speaker_no int, similarity double, confidence double"


def diarize(turns: DataFrame, make: Callable[[], Diarizer], needs: tuple[str, ...] = ("embedding",)) -> DataFrame:
    """turns (session_id, seq, and what the diarizer needs) -> DIARIZED, each session in order of seq by a diarizer of its own.
    Rows without a session or without what is needed are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, diarizer = None, make()
        for pdf in batches:
            out = []
            for turn in pdf.itertuples(index=False):
                if turn.session_id != session:
                    session = turn.session_id
                    diarizer.reset()
                out.append((turn.session_id, turn.seq, *diarizer.diarize_segment(turn)))
            yield pd.DataFrame(out, columns=["session_id", "seq", "speaker_no", "similarity", "confidence"])

    there = " and ".join(f"{c} is not null" for c in ("session_id", *needs))
    own = turns.filter(there).select(F.col("session_id").cast("long").alias("session_id"), F.col("seq").cast("long").alias("seq"), *needs)
    return own.repartition("session_id").sortWithinPartitions("session_id", "seq").mapInPandas(run, DIARIZED)
