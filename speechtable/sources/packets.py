"""A log of packets as a stream: messages (session_id, packet_seq, payload or json) in segment files, with packet numbers as
offsets.

    packets.register(spark)
    spark.readStream.format("packet_log").option("packets_per_trigger", 100_000).load(folder)

A segment file is named by the first and last packet in it, so the newest offset and the segments of a trigger are known from
the folder's listing alone; a trigger takes the packets from one number up to another, a task a segment, which it reads as far
as it needs. A query that starts again goes on after the last packet that its checkpoint has. Packets of a number that is
already past are never read: who writes the log numbers packets upwards.

Writing takes such messages; each task writes one segment, so rows should come in ranges of packet_seq. Segments get their
names once all tasks are done, lower packets first, so a stream that reads meanwhile passes over none; what tasks that failed
or ran twice have written has no name and is never read.
"""

from __future__ import annotations

import struct
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

from .. import session
from .wav import _store

SCHEMA = "session_id long, packet_seq long, payload binary, json string"
RECORD = "<qqBI"  # session, packet, kind (0: payload, 1: JSON), bytes that follow
ROWS = 10_000


@dataclass
class Segment(InputPartition):
    """Packets [start, end) of a segment file."""

    path: str
    start: int
    end: int


def segments(folder: str) -> list[tuple[int, int, str]]:
    """(first packet, last packet, path), in order."""
    from pyarrow import fs

    store, root = _store(folder)
    found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
    named = [(f.base_name.removesuffix(".packets").split("-"), f.path) for f in found if f.is_file and f.base_name.endswith(".packets")]
    return sorted((int(n[0]), int(n[1]), p) for n, p in named)


def _records(folder: str, part: Segment) -> Iterator[pa.RecordBatch]:
    store, _ = _store(folder)
    rows: list[tuple] = []

    def batch() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["session_id", "packet_seq", "payload", "json"])

    with store.open_input_stream(part.path) as f:
        while head := f.read(struct.calcsize(RECORD)):
            session, packet, kind, n = struct.unpack(RECORD, head)
            if packet >= part.end:
                break
            body = f.read(n)
            if packet < part.start:
                continue
            rows.append((session, packet, None if kind else body, body.decode() if kind else None))
            if len(rows) == ROWS:
                yield batch()
                rows = []
    if rows:
        yield batch()


def _parts(folder: str, start: int, end: int) -> list[Segment]:
    return [Segment(p, start, end) for first, last, p in segments(folder) if last >= start and first < end]


class PacketReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.folder = options["path"]

    def partitions(self) -> list[Segment]:
        return _parts(self.folder, 0, 1 << 62)

    def read(self, part: Segment) -> Iterator[pa.RecordBatch]:
        return _records(self.folder, part)


class PacketStream(DataSourceStreamReader):
    def __init__(self, options) -> None:
        self.folder, self.most = options["path"], int(options.get("packets_per_trigger", 0))
        self.done: int | None = None  # known after the first trigger

    def initialOffset(self) -> dict:
        return {"packet": 0}

    def latestOffset(self) -> dict:
        known = segments(self.folder)
        newest = known[-1][1] + 1 if known else 0
        if self.most and self.done is not None:
            newest = min(newest, self.done + self.most)
        return {"packet": max(newest, self.done or 0)}

    def partitions(self, start: dict, end: dict) -> list[Segment]:
        self.done = end["packet"]
        return _parts(self.folder, start["packet"], end["packet"])

    def read(self, part: Segment) -> Iterator[pa.RecordBatch]:
        return _records(self.folder, part)

    def commit(self, end: dict) -> None:
        self.done = end["packet"]


class PacketWriter(DataSourceWriter):
    def __init__(self, options) -> None:
        self.folder = options["path"]

    def write(self, rows) -> WriterCommitMessage:
        message = WriterCommitMessage()  # of Spark's own class, as the process that commits has no shipped files
        own = sorted(((r["packet_seq"], r["session_id"], r["payload"], r["json"]) for r in rows), key=lambda r: r[0])
        if not own:
            return message
        store, root = _store(self.folder)
        store.create_dir(root, recursive=True)
        path = f"{root}/{uuid.uuid4().hex}.part"
        with store.open_output_stream(path) as f:
            for packet, session_id, payload, text in own:
                body = bytes(payload) if payload is not None else (text or "").encode()
                f.write(struct.pack(RECORD, session_id, packet, int(payload is None), len(body)) + body)
        message.segment = own[0][0], own[-1][0], path
        return message

    def commit(self, messages) -> None:
        store, root = _store(self.folder)
        for first, last, path in sorted(m.segment for m in messages if hasattr(m, "segment")):
            store.move(path, f"{root}/{first:020d}-{last:020d}.packets")

    def abort(self, messages) -> None:
        store, _ = _store(self.folder)
        for m in messages:
            if hasattr(m, "segment"):  # none of a task that failed
                store.delete_file(m.segment[2])


class PacketLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "packet_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PacketReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return PacketStream(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return PacketWriter(self.options)


def register(spark) -> None:
    """Make the format known to the session."""
    session.register(spark, PacketLog)


# planning runs in a Python process that has no shipped files
cloudpickle.register_pickle_by_value(sys.modules[__name__])
