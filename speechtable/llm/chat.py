"""Chat formatting: conversations as training text with a loss mask, assembled column by column as bytes.

A turn becomes `<|role|>`, a line break, its text, `</s>` and a line break. Control strings (those of this template and of a
common other one: `<|`, `|>`, `<s>`, `</s>`, `[INST]`, `[/INST]`) can't occur inside a text or a role: a backslash is put after
the first character of each, also where backslashes stand there already, so taking one away gives back what was there. The
mask is a list of spans (code points) that cover the assistant's texts and nothing else.

1. Rows are dealt out by ranges of (conv_id, turn) and sorted there, so a conversation that holds most rows lies in many
   tasks, none of which holds more than its share.
2. Columnar byte assembly. Of about SLICE bytes of rows at a time: lengths of headers, texts (with the backslashes to come)
   and ends; their running sum gives each row's place in one buffer; headers and ends are scattered by role, the bytes of
   all texts by computed index, a window of bytes at a time. The buffer with the places where conversations begin is the Arrow
   column that goes out; no row is a Python string.
3. A conversation that lies in one task is one row (`whole`). Of one that is cut by the end of a range or a slice, each piece
   is a row, and pieces joined by `part` are its text.

`read_back` takes turns and masked texts from the output again.

Cases: null text or role is empty; a null conv_id is a conversation of its own; turns may have gaps, null turns come first,
rows that share a turn follow by a hash of role and text (equal rows in no order that shows); very long texts are formatted
whole, in windows of bytes; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: fixed by the template
BEGIN, MIDDLE, END = b"<|", b"|>\n", b"</s>\n"
CONTROL = re.compile(rb"[<\[|](?=((?<=<)\\*(?:\||/?s>)|(?<=\[)\\*/?INST\]|(?<=\|)\\*>))")
ESCAPED = re.compile(r"(?:(?<=<)\\(?=\\*(?:\||/?s>))|(?<=\[)\\(?=\\*/?INST\])|(?<=\|)\\(?=\\*>))")
LOSS = ("assistant",)
#: bytes of rows assembled, and bytes scattered, at once
SLICE, SCATTER = 16_000_000, 1_000_000
PIECES = "part long, whole boolean, n_turns long, formatted string, loss array<struct<start:int,end:int>>"


def _bytes(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings and where each begins and ends."""
    strings = strings.fill_null("")
    offsets = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
    data = strings.buffers()[2]
    held = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return held, offsets - offsets[0]


def _breaks(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bytes after which a backslash goes, in order. What two rows form together isn't a control string."""
    found = np.array([(m.start(), m.end(1)) for m in CONTROL.finditer(memoryview(data))], np.int64).reshape(-1, 2)
    row = np.searchsorted(offsets, found[:, 0], "right") - 1
    return found[found[:, 1] <= offsets[row + 1], 0]


def escaped(text: bytes) -> bytes:
    return CONTROL.sub(rb"\g<0>\\", text)


def unescaped(text: str) -> str:
    return ESCAPED.sub("", text)


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The buffer of all turns, where each begins (and the last ends), and where its text begins and ends."""
    data, offsets = _bytes(texts)
    breaks = _breaks(data, offsets)
    kinds = roles.fill_null("").dictionary_encode()
    kind = kinds.indices.to_numpy(zero_copy_only=False)
    headers = [np.frombuffer(BEGIN + escaped(r.encode()) + MIDDLE, np.uint8) for r in kinds.dictionary.to_pylist()]
    before = np.searchsorted(breaks, offsets)  # backslashes before each text
    grown = offsets + before
    head = np.array([len(h) for h in headers], np.int64)[kind] if len(kind) else np.zeros(0, np.int64)
    size = head + np.diff(grown) + len(END)
    begins = np.concatenate(([0], np.cumsum(size)))
    text_begins = begins[:-1] + head
    text_ends = begins[1:] - len(END)
    out = np.empty(int(begins[-1]), np.uint8)
    for k, h in enumerate(headers):
        out[begins[:-1][kind == k][:, None] + np.arange(len(h))] = h
    out[text_ends[:, None] + np.arange(len(END))] = np.frombuffer(END, np.uint8)
    moved = text_begins - grown[:-1]  # from a text's place among the grown texts to its place in the buffer
    for a in range(0, len(data), SCATTER):
        at = np.arange(a, min(a + SCATTER, len(data)))
        row = np.searchsorted(offsets, at, "right") - 1
        out[at + np.searchsorted(breaks, at) + moved[row]] = data[at]
    row = np.searchsorted(offsets, breaks, "right") - 1
    out[breaks + np.arange(len(breaks)) + 1 + moved[row]] = ord("\\")
    return out, begins, text_begins, text_ends


def _assembled(ids: pa.Array, roles: pa.Array, texts: pa.Array, loss: tuple[str, ...]) -> dict[str, pa.Array]:
    """Rows in order -> a row for each stretch of one conversation: conv_id, n_turns, formatted, loss."""
    out, begins, text_begins, text_ends = assemble(roles, texts)
    key = ids.to_pylist()
    first = np.array([i for i in range(len(key)) if not i or key[i] != key[i - 1]], np.int64)
    cuts = np.append(first, len(key))
    edges = np.stack((begins[:-1], text_begins, text_ends), 1).reshape(-1)  # parts of a turn, none of which is empty but the text
    filled = np.append(edges[1:], begins[-1]) > edges
    points = np.zeros(len(edges), np.int64)
    points[filled] = np.add.reduceat((out & 0xC0) != 0x80, edges[filled], dtype=np.int64)
    upto = np.concatenate(([0], np.cumsum(points)))
    masked = np.flatnonzero(np.isin(np.array([r or "" for r in roles.to_pylist()], object), loss))
    zero = np.repeat(upto[::3][first], np.diff(cuts))  # code points before the stretch
    spans = pa.StructArray.from_arrays([pa.array((upto[3 * masked + k] - zero[masked]).astype(np.int32)) for k in (1, 2)], names=["start", "end"])
    return {
        "conv_id": ids.take(pa.array(first)), "n_turns": pa.array(np.diff(cuts)),
        "formatted": pa.StringArray.from_buffers(len(first), pa.py_buffer(begins[cuts].astype(np.int32)), pa.py_buffer(out)),
        "loss": pa.ListArray.from_arrays(pa.array(np.searchsorted(masked, cuts).astype(np.int32)), spans),
    }


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about SLICE bytes of text at most, and of one row at least."""
    for b in batches:
        at = 0
        while at < b.num_rows:
            ends = np.frombuffer(b.column(2).buffers()[1], np.int32)[b.column(2).offset + at : b.column(2).offset + b.num_rows + 1].astype(np.int64)
            n = max(1, int(np.searchsorted(ends - ends[0], SLICE, "right")) - 1)
            yield b.slice(at, n)
            at += n


def format_chats(conversations: DataFrame, loss: tuple[str, ...] = LOSS) -> DataFrame:
    """conversations (conv_id, turn, role, text) -> conv_id, part, whole, n_turns, formatted, loss (spans of formatted)."""
    kind = conversations.schema["conv_id"].dataType.simpleString()
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = conversations.select("conv_id", "role", "text", "turn", F.xxhash64("role", "text").alias("h"), F.monotonically_increasing_id().alias("tie"))
    keys = ["conv_id", "turn", "h"]
    rows = rows.repartitionByRange(parts, *keys, "tie").sortWithinPartitions(*keys, "text").select("conv_id", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 33
        held, before = None, []  # a slice whose end isn't known yet; the conversation before it

        def given(after: list) -> pa.RecordBatch:
            nonlocal part
            ids = held["conv_id"].to_pylist()
            around = [*(before or ids[:1]), *ids, *(after or ids[-1:])]  # the first and last of a task may go on elsewhere
            whole = [around[i] != x != around[i + 2] for i, x in enumerate(ids)]
            columns = {"conv_id": held["conv_id"], "part": pa.array(range(part, part + len(ids)), pa.int64()), "whole": pa.array(whole, pa.bool_())} | held
            part += len(ids)
            return pa.RecordBatch.from_pydict(columns)

        for b in _slices(batches):
            if held:
                yield given(b.column(0).slice(0, 1).to_pylist())
                before = held["conv_id"].slice(len(held["conv_id"]) - 1).to_pylist()
            held = _assembled(*b.columns, loss)
        if held:
            yield given([])

    return rows.mapInArrow(run, f"conv_id {kind}, {PIECES}")


def read_back(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn."""
    begin, middle, end = BEGIN.decode(), MIDDLE.decode(), END.decode()
    at = 0
    while at < len(formatted):
        a = formatted.index(middle, at + len(begin))
        b = formatted.index(end, a + len(middle))
        yield unescaped(formatted[at + len(begin) : a]), unescaped(formatted[a + len(middle) : b])
        at = b + len(end)


def masked(formatted: str, loss: list[dict]) -> str:
    """All text under the mask."""
    return "".join(unescaped(formatted[x["start"] : x["end"]]) for x in loss)


class _Digest:
    """What is read back from the pieces of one conversation."""

    def __init__(self) -> None:
        self.turns, self.loss, self.n_turns, self.loss_chars, self.chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0

    def add(self, formatted: str, loss: list[dict]) -> _Digest:
        for role, text in read_back(formatted):
            self.turns.update(f"{role}\n{text}\n".encode())
            self.n_turns += 1
        text = masked(formatted, loss)
        self.loss.update(text.encode())
        self.loss_chars += len(text)
        self.chars += len(formatted)
        return self

    def row(self) -> tuple:
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


RESULT = [("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]


def read_digests(pieces: DataFrame) -> DataFrame:
    """format_chats' rows -> conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read from the output alone.

    Whole conversations are read where they lie. Pieces of others meet by conversation and are read one after another, so a
    task holds a piece at a time, however long the conversation; they are at most two conversations a task before.
    """
    kind = pieces.schema["conv_id"].dataType.simpleString()
    columns = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            is_whole, formatted, loss = (b.column(k) for k in (2, 4, 5))
            rows = [_Digest().add(f, x).row() if w else (None,) * 5 for w, f, x in zip(is_whole.to_pylist(), formatted.to_pylist(), loss.to_pylist())]
            made = [pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(RESULT)]
            rest = [pa.array([None if w else v for w, v in zip(is_whole.to_pylist(), c.to_pylist())], c.type) for c in (formatted, loss)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *made, *rest], names=["conv_id", "part", *(n for n, _ in RESULT), "formatted", "loss"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_id, digest, kinds = None, None, None

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["conv_id", *(n for n, _ in RESULT)])

        for b in batches:
            kinds = kinds or [b.column(0).type, *(t for _, t in RESULT)]
            done = []
            for r in b.select([c for c in b.schema.names if c != "part"]).to_pylist():
                if digest and r["conv_id"] != open_id:
                    done.append((open_id, *digest.row()))
                    digest = None
                if r["formatted"] is None:
                    done.append(tuple(r.values())[:6])
                    continue
                open_id, digest = r["conv_id"], (digest or _Digest()).add(r["formatted"], r["loss"])
            if done:
                yield batch(done)
        if digest:
            yield batch([(open_id, *digest.row())])

    read = pieces.select("conv_id", "part", "whole", "n_turns", "formatted", "loss").mapInArrow(whole, columns.replace("conv_id " + kind, f"conv_id {kind}, part long") + ", formatted string, loss array<struct<start:int,end:int>>")
    return read.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(finish, columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast(rows.schema["conv_id"].dataType).alias("conv_id"), F.col("id").alias("turn"), F.expr("if(id = 0, 'user', 'assistant')").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return read_digests(format_chats(rows.unionByName(extra)))


SQL = r"""WITH c AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -7, i, CASE WHEN i = 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) AS t(i)),
r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM c),
e AS (SELECT *, length(text) + length(regexp_extract_all(text, '<\\*(\||/?s>)')) + length(regexp_extract_all(text, '\[\\*/?INST\]')) + length(regexp_extract_all(text, '\|\\*>')) AS chars FROM r)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(role) + chars + 10)::BIGINT AS formatted_chars FROM e GROUP BY conv_id"""
