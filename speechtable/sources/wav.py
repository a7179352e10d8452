"""WAV files as a table, read by ranges of bytes, and written from one.

    wav.register(spark)
    spark.read.format("wav").option("start_s", 20).option("end_s", 40).load(folder)

Rows are (path, rate, start_s, samples): 16-bit samples as floats, the mean of the channels, in pieces of at most `block` bytes
of a file. Partitions are planned from the folder's listing alone: a long file is cut into pieces, and pieces and short files
are packed into partitions of about `packed` bytes, a file counting as OPEN bytes more, so that millions of short clips aren't
millions of tasks. A task opens each of its files once, reads the header and then only the bytes of its pieces that lie in the
crop, a piece at a time. Filters on path (equal, in) leave out whole files before anything is read; `rate` asks each file for
its rate, which is an error otherwise (option `strict` false: other files are left out). Files lie in any store that
Arrow's file systems know, by the path's scheme.

Writing takes (name, rate, samples) rows, a file each, mono; a task that runs again writes the same files again. Samples stay
in Arrow's arrays till a file's are written, as Python's numbers would take four times their room, or more.
"""

from __future__ import annotations

import struct
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, WriterCommitMessage

from .. import session

SCHEMA = "path string, rate int, start_s double, samples array<float>"
#: bytes of a piece and of a partition, and what opening a file counts as
BLOCK, PACKED, OPEN = 8_000_000, 64_000_000, 1_000_000


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class Piece(NamedTuple):
    """Bytes [begin, end) of a file's audio."""

    path: str
    begin: int
    end: int


@dataclass
class Pieces(InputPartition):
    """Those of one task, file by file: ranges of a file's bytes, which are read `block` bytes at a time. The plan of many
    files holds a range for each, however small a piece is."""

    block: int
    ranges: list[Piece] = field(default_factory=list)

    @property
    def pieces(self) -> list[Piece]:
        return [Piece(path, a, a + self.block) for path, begin, end in self.ranges for a in range(begin, end, self.block)]


@dataclass
class Header:
    rate: int
    channels: int
    data: int
    size: int


def header(f) -> Header:
    """Where the audio of an open file lies. Chunks other than format and data are passed over."""
    riff = f.read(12)
    if riff[:4] != b"RIFF" or riff[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    rate = channels = 0
    at = 12
    while True:
        head = f.read(8)
        if len(head) < 8:
            raise ValueError("a WAV file without audio")
        name, size = struct.unpack("<4sI", head)
        at += 8
        if name == b"data":
            if not rate:
                raise ValueError("audio before its format")
            return Header(rate, channels, at, size)
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", f.read(16))
            if bits != 16 or kind not in (1, 0xFFFE):
                raise ValueError("16-bit samples are needed")
        at += size + size % 2
        f.seek(at)


def piece(f, h: Header, begin: int, end: int, start_s: float, end_s: float | None) -> tuple[int, np.ndarray]:
    """Number of the first frame, and the samples of bytes [begin, end) of the audio within the crop. Reads no more than these."""
    width = 2 * h.channels
    first = max(-(-begin // width), int(start_s * h.rate))
    last = min(-(-end // width), h.size // width)
    last = last if end_s is None else min(last, int(end_s * h.rate))
    if last <= first:
        return first, np.zeros(0, np.float32)
    f.seek(h.data + first * width)
    raw = np.frombuffer(f.read((last - first) * width), "<i2")
    return first, (raw.reshape(-1, h.channels).mean(1) / 32768).astype(np.float32)


class WavReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.folder = options["path"]
        self.start, self.end = float(options.get("start_s", 0)), float(options["end_s"]) if "end_s" in options else None
        self.block, self.rate = int(options.get("block", BLOCK)), int(options["rate"]) if "rate" in options else None
        self.packed = int(options.get("packed", PACKED))
        self.strict = options.get("strict", "true").lower() == "true"
        self.paths: set[str] | None = None

    def pushFilters(self, filters) -> Iterator:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("path",):
                own = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.paths = own if self.paths is None else self.paths & own
            else:
                yield f

    def partitions(self) -> list[Pieces]:
        from pyarrow import fs

        store, root = _store(self.folder)
        info = store.get_file_info(root)
        files = [info] if info.is_file else store.get_file_info(fs.FileSelector(root, recursive=True))
        files = sorted((f.path, f.size) for f in files if f.is_file and f.path.endswith(".wav") and (self.paths is None or f.path in self.paths))
        out: list[Pieces] = []
        room = 0
        for path, size in files:
            for a in range(0, size, self.block):  # a header's bytes too many
                opened = bool(out) and out[-1].ranges[-1].path == path
                needed = min(self.block, size - a)
                if not out or needed + (0 if opened else OPEN) > room:
                    out.append(Pieces(self.block))
                    room, opened = self.packed, False
                room -= needed + (0 if opened else OPEN)
                begin = out[-1].ranges.pop().begin if opened else a
                out[-1].ranges.append(Piece(path, begin, a + self.block))
        return out

    def read(self, part: Pieces) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.folder)
        for path, own in groupby(part.pieces, lambda p: p.path):
            with store.open_input_file(path) as f:
                try:
                    h = header(f)
                except ValueError as e:
                    raise ValueError(f"{path}: {e}") from e
                if self.rate and h.rate != self.rate:
                    if self.strict:
                        raise ValueError(f"{path}: {h.rate} Hz in place of {self.rate}")
                    continue
                for _, begin, end in own:
                    first, x = piece(f, h, begin, end, self.start, self.end)
                    if len(x):
                        samples = pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x))
                        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([h.rate], pa.int32()), pa.array([first / h.rate]), samples], names=["path", "rate", "start_s", "samples"])


class WavWriter(DataSourceArrowWriter):
    def __init__(self, options) -> None:
        self.folder = options["path"]

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, root = _store(self.folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for name, rate, samples in zip(*(batch.column(c) for c in ("name", "rate", "samples"))):
                rate = rate.as_py()
                x = samples.values.to_numpy(zero_copy_only=False).astype(float) if samples.is_valid else np.zeros(0)
                raw = (np.clip(x, -1, 1) * 32768).round().clip(-32768, 32767).astype("<i2").tobytes()
                head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(raw), b"WAVE", b"fmt ", 16, 1, 1, rate, 2 * rate, 2, 16, b"data", len(raw))
                with store.open_output_stream(f"{root}/{name.as_py()}.wav") as f:
                    f.write(head + raw)
        return WriterCommitMessage()


class WavFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WavReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return WavWriter(self.options)


def register(spark) -> None:
    """Make the format known to the session, with the filters that it takes."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    session.register(spark, WavFiles)


# planning runs in a Python process that has no shipped files
cloudpickle.register_pickle_by_value(sys.modules[__name__])
