"""WAV files by ranges of bytes, and a packet log as a stream that starts again."""

import io
import os
import struct
import tracemalloc
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In

from speechtable.sources import packets, wav


class Counted(io.BytesIO):
    got = 0

    def read(self, n=-1):
        out = super().read(n)
        self.got += len(out)
        return out


def made(samples, rate=16000, channels=1, extra=b""):
    raw = np.asarray(samples, "<i2").tobytes()
    return struct.pack("<4sI4s4sIHHIIHH", b"RIFF", 0, b"WAVE", b"fmt ", 16, 1, channels, rate, rate * 2 * channels, 2 * channels, 16) + extra + struct.pack("<4sI", b"data", len(raw)) + raw


@pytest.mark.parametrize("channels", [1, 2])
@pytest.mark.parametrize("block", [999, 64_000, 10**9])
def test_a_crop_reads_its_own_bytes(channels, block):
    x = np.arange(60 * 1000 * channels) % 3001 - 1500
    raw = made(x, 1000, channels, struct.pack("<4sI", b"LIST", 5) + b"five!\0")
    got, read = [], 0
    for a in range(0, len(raw), block):
        f = Counted(raw)
        first, own = wav.piece(f, wav.header(f), a, a + block, 20, 40)
        assert f.got < 100 + len(own) * 2 * channels
        read += len(own)
        got.append(own)
    want = x.reshape(-1, channels).mean(1)[20_000:40_000] / 32768
    assert read == 20_000 and np.allclose(np.concatenate(got), want)


def test_files_of_a_folder(spark, tmp_path):
    wav.register(spark)
    (tmp_path / "sub").mkdir()
    for name, x, rate in (("a", range(5000), 1000), ("sub/b", range(100), 1000), ("c", [], 1000), ("d", range(10), 8000)):
        (tmp_path / f"{name}.wav").write_bytes(made(list(x), rate))
    (tmp_path / "other.txt").write_text("no audio")
    all_ = spark.read.format("wav").option("block", 1000).load(str(tmp_path))
    assert {r.path.rsplit("/", 1)[1]: r.n for r in all_.groupBy("path").agg(F.sum(F.size("samples")).alias("n")).collect()} == {"a.wav": 5000, "b.wav": 100, "d.wav": 10}
    one = all_.filter(F.col("path") == str(tmp_path / "a.wav")).orderBy("start_s")
    assert [v for r in one.collect() for v in r.samples] == pytest.approx([i / 32768 for i in range(5000)])
    assert spark.read.format("wav").option("rate", 8000).option("strict", "false").load(str(tmp_path)).count() == 1
    with pytest.raises(Exception, match="1000 Hz in place of 8000"):
        spark.read.format("wav").option("rate", 8000).load(str(tmp_path)).count()
    (tmp_path / "bad.wav").write_bytes(b"RIFF....WAVE")
    with pytest.raises(Exception, match="without audio"):
        spark.read.format("wav").load(str(tmp_path)).count()


def test_a_path_filter_leaves_files_out_of_the_plan(tmp_path):
    for k in range(5):
        (tmp_path / f"{k}.wav").write_bytes(made(range(1000)))
    reader = wav.WavReader({"path": str(tmp_path), "block": "500"})
    left = list(reader.pushFilters([In(("path",), (str(tmp_path / "1.wav"), str(tmp_path / "3.wav"))), EqualTo(("path",), str(tmp_path / "3.wav")), GreaterThan(("start_s",), 0.0)]))
    assert [type(f) for f in left] == [GreaterThan]
    pieces = [x for p in reader.partitions() for x in p.pieces]
    assert {x.path for x in pieces} == {str(tmp_path / "3.wav")} and len(pieces) == 5


def test_short_files_share_a_task_and_long_ones_are_cut(tmp_path):
    for k in range(7):
        (tmp_path / f"{k}.wav").write_bytes(made(range(500)))
    (tmp_path / "long.wav").write_bytes(made(range(30_000)))
    for packed, most in ((3 * (wav.OPEN + 1044), 3), (1, 1)):
        parts = wav.WavReader({"path": str(tmp_path), "block": "20000", "packed": str(packed)}).partitions()
        assert max(len({x.path for x in p.pieces}) for p in parts) == most
        pieces = [x for p in parts for x in p.pieces]
        assert [x.begin for x in pieces if x.path.endswith("long.wav")] == [0, 20_000, 40_000, 60_000]
        assert len(pieces) == len(set(pieces)) == 11
    reader = wav.WavReader({"path": str(tmp_path), "block": "20000", "end_s": "0.03"})
    assert len(reader.partitions()) == 1
    got = [(b.column(0)[0].as_py(), len(b.column(3)[0])) for p in reader.partitions() for b in reader.read(p)]
    assert got == [*((str(tmp_path / f"{k}.wav"), 480) for k in range(7)), (str(tmp_path / "long.wav"), 480)]


def test_written_files_come_back(spark, tmp_path):
    wav.register(spark)
    rows = [("x", 500, [0.5, -0.25, 2.0, -2.0]), ("y", 500, [])]
    spark.createDataFrame(rows, "name string, rate int, samples array<float>").write.format("wav").mode("append").save(f"{tmp_path}/out")
    got = spark.read.format("wav").load(f"{tmp_path}/out").collect()
    assert [(r.rate, r.start_s, r.samples) for r in got] == [(500, 0.0, [0.5, -0.25, 32767 / 32768, -1.0])]


def test_a_task_that_writes_holds_few_samples_beside_arrows_own(tmp_path):
    n, batch = 4000, pa.RecordBatch.from_pydict({"name": [str(k) for k in range(200)], "rate": pa.array([1000] * 200, pa.int32()), "samples": pa.array(np.full((200, 4000), 0.5).tolist(), pa.list_(pa.float64()))})
    tracemalloc.start()
    wav.WavWriter({"path": str(tmp_path)}).write(iter([batch, batch.slice(3, 2)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 * n * 8  # a few files' samples; as Python's numbers a batch's are 200 * n * 32
    assert len(list(tmp_path.iterdir())) == 200 and (tmp_path / "3.wav").read_bytes()[44:] == np.full(n, 16384, "<i2").tobytes()


def test_a_plan_holds_one_range_of_a_file_however_small_its_pieces(tmp_path):
    for k in range(20):
        (tmp_path / f"{k:02}.wav").write_bytes(made(range(5000)))
    (part,) = wav.WavReader({"path": str(tmp_path), "block": "100"}).partitions()
    assert len(part.ranges) == 20 and len(part.pieces) == 20 * 101
    assert part.pieces[:2] == [wav.Piece(str(tmp_path / "00.wav"), 0, 100), wav.Piece(str(tmp_path / "00.wav"), 100, 200)]


def test_a_stream_of_packets_starts_again(spark, tmp_path):
    packets.register(spark)
    schema = packets.SCHEMA
    log, out, state = (str(tmp_path / k) for k in ("log", "out", "state"))
    rows = [(k % 3, k, bytes([k % 256] * (k % 5)) if k % 2 else None, None if k % 2 else f'{{"n":{k}}}') for k in range(0, 900, 3)]
    seen = 0
    for a, b in ((0, 120), (120, 121), (121, 121), (121, 300)):
        if b > a:
            spark.createDataFrame(rows[a:b], schema).repartitionByRange(3, "packet_seq").write.format("packet_log").mode("append").save(log)
        stream = spark.readStream.format("packet_log").load(log)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        seen = b
        got = sorted((r.packet_seq, r.session_id, None if r.payload is None else bytes(r.payload), r.json) for r in spark.read.schema(schema).parquet(out).collect())
        assert got == sorted((q, s, p, j) for s, q, p, j in rows[:seen])
    assert spark.read.format("packet_log").load(log).count() == 300


def test_segments_appear_in_order_once_all_are_written(tmp_path, monkeypatch):
    writer = packets.PacketWriter({"path": str(tmp_path)})
    rows = [{"session_id": 1, "packet_seq": k, "payload": b"x", "json": None} for k in range(30)]
    first, again, second, none = (writer.write(iter(x)) for x in (rows[:10], rows[:10], rows[10:], []))
    assert not hasattr(none, "segment") and packets.segments(str(tmp_path)) == []
    writer.abort([again, None])
    seen, own = [], packets._store

    class Watched:
        def move(self, a: str, b: str) -> None:
            os.rename(a, b)
            seen.append(sorted(x.name for x in tmp_path.glob("*.packets")))

    monkeypatch.setattr(packets, "_store", lambda path: (Watched(), str(tmp_path)))
    writer.commit([second, none, first])
    monkeypatch.setattr(packets, "_store", own)
    low, high = f"{0:020d}-{9:020d}.packets", f"{10:020d}-{29:020d}.packets"
    assert seen == [[low], [low, high]] and len(list(tmp_path.iterdir())) == 2
    assert [x[:2] for x in packets.segments(str(tmp_path))] == [(0, 9), (10, 29)]


def test_formats_are_found_from_any_thread(spark, tmp_path):
    def write(k: int) -> int:
        wav.register(spark)
        spark.createDataFrame([(f"f{k}", 500, [0.5] * k)], "name string, rate int, samples array<float>").write.format("wav").mode("append").save(f"{tmp_path}/{k}")
        return spark.read.format("wav").load(f"{tmp_path}/{k}").select(F.sum(F.size("samples"))).first()[0]

    with ThreadPoolExecutor(3) as threads:
        assert list(threads.map(write, (1, 2, 3))) == [1, 2, 3]


def test_triggers_take_so_many_packets(tmp_path):
    reader = packets.PacketStream({"path": str(tmp_path / "none"), "packets_per_trigger": "10"})
    assert reader.latestOffset() == {"packet": 0}
    for first, last in ((0, 24), (25, 49)):
        (tmp_path / f"{first:020d}-{last:020d}.packets").write_bytes(b"".join(struct.pack(packets.RECORD, 1, k, 0, 2) + b"ab" for k in range(first, last + 1)))
    reader = packets.PacketStream({"path": str(tmp_path), "packets_per_trigger": "10"})
    reader.partitions({"packet": 0}, {"packet": 20})  # what a checkpoint had planned
    assert reader.latestOffset() == {"packet": 30}
    parts = reader.partitions({"packet": 20}, {"packet": 30})
    assert len(parts) == 2
    assert [n for p in parts for b in reader.read(p) for n in b.column(1).to_pylist()] == list(range(20, 30))
