"""Substring dedup by recompression: words that lie in a long repeat are removed.

A window is `WINDOW` consecutive words of a document. A word is removed if a window over it has the same words as one that
starts earlier (in a document with a smaller id, or earlier in its own). Windows are judged on the input.

1. Recompression. Each document's words are named by hash; then runs of one word get a name, and in further rounds
   neighbours whose names fall on different sides of a coin are paired and get a name. A name is a fixed function of what
   it stands for, so all tasks agree on it without exchanging anything. A symbol also knows which words decided that it
   exists (its own and some at its sides), and if these lie inside a window the symbol arises wherever the window occurs:
   these are the window's interior symbols. The leftmost of the highest level is the window's anchor; a window without one
   (inside a long run, for example) is its own.
2. Shared symbols. Anchors are counted over the corpus. Only windows whose anchor occurs twice can repeat. These anchors
   are put in a bit map of bounded size (`MAP_BITS_MOST`) that every task can hold; where it fills up, more windows go on
   to the next step, and beyond a fill of half all do. It never loses a window.
3. Verification. Names and symbols only tell which windows may repeat: they can be made to collide. The remaining windows meet by a cryptographic digest
   of the words themselves (BLAKE2, 128 bits) and are alike only if all of it agrees; the words of two windows, which lie in
   different tasks, are never brought together. A task first settles repeats among its own rows and sends on one of each
   kind, so what meets at a digest is bounded by the number of batches, not by how often a passage occurs. Later ones are
   marked.
4. Marks and texts meet by document, and marked words go.

The corpus is read four times (sizes, anchors, windows, texts) and its text shuffled once. Rows are packed by bucket, so a
shuffled window costs 36 bytes before compression and a task holds a bucket at a time; the number of buckets follows the
number of windows.

Cases: null or empty text has no words and keeps nothing; fewer than WINDOW words: all are kept; very long texts are worked
on whole, and a task's memory follows the longest; rows that repeat a doc_id and text are one document (neither is
earlier), rows that share only the id are compared by position and keep apart; a null doc_id is the last of all: it takes
the place of the largest long, and such a row and one that has that id and the same text are one document; an empty table
gives no rows; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hex_digest, table, written

WINDOW, ROUNDS = 20, 7
MAP_BITS_LEAST, MAP_BITS_MOST = 1 << 20, 1 << 28
#: windows in a bucket, documents in a bucket, bytes of text worked on at once
BUCKET_WINDOWS, BUCKET_BYTES, SLICE = 1_000_000, 32_000_000, 500_000
LAST = np.iinfo(np.int64).max
_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))
_IS_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _D
    h = (h ^ (h >> np.uint64(29))) * _B
    return h ^ (h >> np.uint64(32))


def word_names(raw: bytes) -> np.ndarray:
    """The hash of each word of raw, worked on in slices."""
    b = np.frombuffer(raw, np.uint8)
    space = _IS_SPACE[b]
    starts = np.flatnonzero(~space & np.concatenate(([True], space[:-1]))) if len(b) else np.zeros(0, np.int64)
    out = []
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + SLICE)))
        first, last = starts[at], starts[to] if to < len(starts) else len(b)
        own = starts[at:to] - first
        begun = np.zeros(last - first, np.int64)
        begun[own] = own
        offset = np.arange(last - first) - np.maximum.accumulate(begun)
        powers = np.multiply.accumulate(np.full(int(offset.max()) + 1, _C, np.uint64))
        code = (b[first:last].astype(np.uint64) + np.uint64(1)) * powers[offset]
        code[space[first:last]] = 0
        out.append(mixed(np.add.reduceat(code, own)))
        at = to
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


class Words:
    """The words of some documents as one row of names with a separator, alike to nothing, around each document."""

    def __init__(self, texts: list[str | None]) -> None:
        plain = [b" ".join((t or "").encode().split()) for t in texts]
        names = [word_names(t) for t in plain]
        sizes = np.array([len(x) for x in names], np.int64)
        self.begins = np.cumsum(sizes + 1) - sizes  # of each document
        n = int(sizes.sum()) + len(texts) + 1
        self.doc = np.repeat(np.arange(len(texts) + 1), np.concatenate((sizes + 1, [1])))  # a separator goes with the document after it
        self.is_word = np.ones(n, bool)
        seps = np.concatenate((self.begins - 1, [n - 1]))
        self.is_word[seps] = False
        self.name = np.empty(n, np.uint64)
        self.name[seps] = mixed(np.arange(len(seps), dtype=np.uint64) + _A)
        self.name[self.is_word] = np.concatenate(names) if names else np.zeros(0, np.uint64)
        ends = np.repeat(self.begins + sizes, sizes + 1) if len(texts) else np.zeros(0, np.int64)
        self.starts = np.zeros(n, bool)  # where a window starts
        at = np.arange(n - 1)
        self.starts[:-1] = self.is_word[:-1] & (at + WINDOW <= ends)
        # words with one space after each: a space starts no word, so each word ends one before the next or the separator starts
        self.raw = b" ".join([*plain, b""])
        b = np.frombuffer(self.raw, np.uint8) == 32
        self.at = np.empty(n, np.int64)
        self.at[seps] = np.cumsum([0, *(len(t) + 1 for t in plain)])
        self.at[self.is_word] = np.flatnonzero(~b & np.concatenate(([True], b[:-1])))

    def hashes(self, at: np.ndarray) -> np.ndarray:
        """A hash of the names in the window that starts at each place."""
        h = np.zeros(len(at), np.uint64)
        for k in range(WINDOW):
            h = h * _A + self.name[at + k]
        return mixed(h)

    def digests(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both halves of a digest of the words in the window that starts at each place."""
        raw = self.raw
        out = b"".join([blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(self.at[at].tolist(), (self.at[at + WINDOW] - 1).tolist())])
        h, g = np.frombuffer(out, np.uint64).reshape(-1, 2).T.copy()
        return h, g

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places where windows start, each window's anchor, and where the anchor's words begin."""
        at = np.flatnonzero(self.starts)
        best = np.zeros(len(at), np.uint64)
        where = np.full(len(at), -1)
        for names, lo, hi in self._levels():
            first = np.minimum(np.cumsum(np.bincount(lo + 2, minlength=len(self.name) + 2))[at + 1], len(lo) - 1)  # lo doesn't fall
            ok = (lo[first] >= at) & (hi[first] <= at + WINDOW)
            pick = first[ok]
            a, b = lo[pick], hi[pick]
            w = self.name
            best[ok] = names[pick] + w[a] * _A + w[np.minimum(a + 1, b - 1)] * _B + w[b - 1] * _C + w[np.maximum(b - 2, a)] * _D + (b - a).astype(np.uint64)
            where[ok] = a
        best = mixed(best)
        rest = np.flatnonzero(where < 0)
        best[rest] = self.hashes(at[rest])
        where[rest] = at[rest]
        return at, best, where

    def _levels(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Names of the symbols of each level in order, and the words [lo, hi) that decide on each."""
        n = len(self.name)
        # runs: whether one ends depends on the words around it
        begin = np.flatnonzero(np.concatenate(([True], self.name[1:] != self.name[:-1])))
        end = np.concatenate((begin[1:], [n]))
        names = np.where(end - begin > 1, mixed(self.name[begin] + (end - begin).astype(np.uint64) * _A), self.name[begin])
        lo, hi, free = begin - 1, end + 1, self.is_word[begin]
        yield names, lo, hi
        for r in range(1, ROUNDS + 1):
            side = (mixed(names + np.uint64(r) * _C) & np.uint64(1)).astype(bool)
            left, right = free & ~side, free & side
            pair = np.concatenate((left[:-1] & right[1:], [False]))
            second = np.concatenate(([False], pair[:-1]))
            alone = ~pair & ~second
            new_lo, new_hi, new = lo.copy(), hi.copy(), names.copy()
            j = np.flatnonzero(pair)
            new[j] = mixed(names[j] * _A + names[j + 1] * _B + np.uint64(r))
            new_hi[j] = hi[j + 1]
            j = np.flatnonzero(alone & left)
            new_hi[j] = np.maximum(hi[j], hi[j + 1])  # free symbols have a neighbour on either side
            j = np.flatnonzero(alone & right)
            new_lo[j] = np.minimum(lo[j], lo[j - 1])
            names, lo, hi, free = new[~second], new_lo[~second], new_hi[~second], free[~second]
            yield names, lo, hi


def _parts(texts: list[str | None]) -> Iterator[tuple[int, list[str | None]]]:
    """Documents in groups of about 2 * SLICE characters, with the number of the first."""
    own, size, first = [], 0, 0
    for i, t in enumerate(texts):
        own.append(t)
        size += len(t or "")
        if size >= 2 * SLICE:
            yield first, own
            own, size, first = [], 0, i + 1
    if own:
        yield first, own


def anchors(docs: DataFrame) -> DataFrame:
    """docs -> anchor, n: anchors by batch, with the number of their windows' anchoring symbols in it (2: two or more)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, texts in _parts(b.column(0).to_pylist()):
                w = Words(texts)
                _, key, where = w.anchors()
                if not len(key):
                    continue
                # neighbouring windows that share the symbol count it once
                new = np.concatenate(([True], (key[1:] != key[:-1]) | (where[1:] != where[:-1])))
                own, n = np.unique(key[new], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(np.minimum(n, 2).astype(np.int8))], names=["anchor", "n"])

    return docs.select("text").mapInArrow(run, "anchor long, n byte")


def shared_map(found: DataFrame) -> np.ndarray | None:
    """A bit map of the anchors that occur twice: bit (anchor >>> 64-bits). None if it would be more than half full."""
    shared = written(found.groupBy("anchor").agg(F.sum("n").alias("n")).filter("n > 1").select("anchor"), "recompress-anchors")
    n = shared.count()
    bits = MAP_BITS_LEAST
    while bits < min(32 * n, MAP_BITS_MOST):
        bits *= 2
    if n > bits // 2:
        return None
    place = F.shiftrightunsigned("anchor", 65 - bits.bit_length())
    filled = shared.groupBy(F.shiftright(place, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(anchor, {65 - bits.bit_length()}) & 63 as int))")).alias("bits"))
    rows = filled.toArrow()  # at most MAP_BITS_MOST / 64 rows
    out = np.zeros(bits // 64, np.uint64)
    out[rows["at"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return out


def _in_map(held: np.ndarray, key: np.ndarray) -> np.ndarray:
    place = key >> np.uint64(64 - (len(held) * 64).bit_length() + 1)
    return (held[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


def _later(h: np.ndarray, g: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by content, document and position; and which of these, in that order, repeat the first of their content."""
    order = np.lexsort((pos, doc, g, h))
    h, g, doc, pos = h[order], g[order], doc[order], pos[order]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (g[1:] != g[:-1]))) if len(h) else np.zeros(0, bool)
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    return order, (doc != doc[first]) | (pos != pos[first])


def _packed(bucket: np.ndarray, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """A row for each bucket with the lists of its values: bucket, then a list a column."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)])).astype(np.int32)
    if len(bucket):
        yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]].astype(np.int32)), *(pa.ListArray.from_arrays(cuts, pa.array(c[order])) for c in columns)], names=["bucket", *"abcde"[: len(columns)]])


WINDOWS = "bucket int, a array<long>, b array<long>, c array<long>, d array<long>, e array<int>"
MARKS = "bucket int, a array<long>, b array<long>, c array<int>"


def _doc_bucket(doc: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    return (mixed(doc.astype(np.uint64) * _A + text.view(np.uint64)) % np.uint64(n)).astype(np.int32)


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[str | None]]:
    """doc_id (null: LAST), the text's own number, text."""
    return batch.column(0).fill_null(LAST).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_pylist()


def windows(docs: DataFrame, held: np.ndarray | None, buckets: int, doc_buckets: int) -> DataFrame:
    """docs (doc_id, text_id, text) -> WINDOWS: windows that may repeat (digest in two halves, doc, text_id, position), the
    first of each content in a batch; and, in buckets below zero, marks of the others (doc, text_id, position)."""
    sent = docs.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        for b in batches:
            doc_id, text_id, texts = _columns(b)
            found = []
            for first, own in _parts(texts):
                w = Words(own)
                at, key, _ = w.anchors()
                if held is not None:
                    at = at[_in_map(held, key)]
                doc = w.doc[at]
                found.append((*w.digests(at), first + doc, (at - w.begins[doc]).astype(np.int32)))
                del w
            h, g, doc, pos = (np.concatenate(c) for c in zip(*found))
            ids, tids = doc_id[doc], text_id[doc]
            order, later = _later(h, g, ids, pos)
            keep, mark = order[~later], order[later]
            no = np.zeros(len(mark), np.int64)
            yield from _packed((h[keep] % np.uint64(buckets)).astype(np.int32), [h[keep].view(np.int64), g[keep].view(np.int64), ids[keep], tids[keep], pos[keep]])
            yield from _packed(-1 - _doc_bucket(ids[mark], tids[mark], doc_buckets), [no, no, ids[mark], tids[mark], pos[mark]])

    return docs.select("doc_id", "text_id", "text").mapInArrow(run, WINDOWS)


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Buckets whose rows follow one another, with the values of each list column."""
    held: list[pa.RecordBatch] = []
    now = None
    for b in batches:
        keys = b.column(0).to_numpy()
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]))
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if i == j:
                continue
            if held and keys[i] != now:
                yield now, _values(held)
                held = []
            now = int(keys[i])
            held.append(b.slice(i, j - i))
    if held:
        yield now, _values(held)


def _values(rows: list[pa.RecordBatch]) -> list[np.ndarray]:
    return [np.concatenate([r.column(k).flatten().to_numpy(zero_copy_only=False) for r in rows]) for k in range(1, rows[0].num_columns)]


def marks(found: DataFrame, doc_buckets: int) -> DataFrame:
    """WINDOWS -> MARKS: windows that repeat an earlier one (doc, text_id, position) by bucket of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, (h, g, ids, tids, pos) in _by_bucket(batches):
            if bucket < 0:
                at, to = slice(None), np.full(len(ids), -1 - bucket, np.int32)
            else:
                order, later = _later(h, g, ids, pos)
                at = order[later]
                to = _doc_bucket(ids[at], tids[at], doc_buckets)
            for r in _packed(to, [ids[at], tids[at], pos[at]]):
                yield r

    return found.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, MARKS)


def removals(docs: DataFrame) -> DataFrame:
    """docs -> doc_id, n_words, n_removed, kept (the words that stay, joined by one space)."""
    docs = docs.select("doc_id", F.xxhash64("text").alias("text_id"), "text")
    sizes = docs.agg(F.count("*"), F.sum(F.char_length("text"))).first()
    chars = sizes[1] or 0
    buckets, doc_buckets = 1 + chars // 6 // BUCKET_WINDOWS, 1 + chars // BUCKET_BYTES
    buckets, doc_buckets = (max(int(x), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))) for x in (buckets, doc_buckets))
    held = shared_map(anchors(docs))
    marked = marks(windows(docs, held, buckets, doc_buckets), doc_buckets)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, tids, _ = _columns(b)
            yield pa.RecordBatch.from_arrays([pa.array(_doc_bucket(ids, tids, doc_buckets)), *b.columns], names=["bucket", "doc_id", "text_id", "text"])

    numbered = docs.mapInArrow(number, "bucket int, doc_id long, text_id long, text string")
    none = lambda kind: F.lit(None).cast(kind)
    texts = numbered.select("bucket", F.lit(True).alias("is_text"), "doc_id", "text_id", "text", none("array<long>").alias("a"), none("array<long>").alias("b"), none("array<int>").alias("c"))
    rows = marked.select("bucket", F.lit(False).alias("is_text"), none("long").alias("doc_id"), none("long").alias("text_id"), none("string").alias("text"), "a", "b", "c")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, got, ready = None, [], None
        for b in batches:
            bucket, is_text = b.column(0).to_pylist(), b.column(1).to_pylist()
            out: list[list] = [[], [], [], []]
            lists = [b.column(k) for k in (5, 6, 7)]
            ids, tids, texts = b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4)
            for i in range(b.num_rows):
                if bucket[i] != now:
                    now, got, ready = bucket[i], [], None
                if not is_text[i]:
                    got.append([c[i].values.to_numpy(zero_copy_only=False) for c in lists])
                    continue
                if ready is None:
                    ready = _index(got)
                    got = []
                words = (texts[i].as_py() or "").encode().split()
                starts = _positions(ready, LAST if ids[i] is None else ids[i], tids[i])
                gone = np.zeros(len(words) + 1, np.int64)
                np.add.at(gone, starts, 1)
                np.add.at(gone, np.minimum(starts + WINDOW, len(words)), -1)
                gone = np.cumsum(gone)[:-1] > 0
                out[0].append(ids[i])
                out[1].append(len(words))
                out[2].append(int(gone.sum()))
                out[3].append((b" ".join(w for w, g in zip(words, gone.tolist()) if not g) if len(starts) else b" ".join(words)).decode())
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    met = texts.unionByName(rows).repartition("bucket").sortWithinPartitions("bucket", "is_text")
    return met.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string")


def _index(got: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not got:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
    ids, tids, pos = (np.concatenate(c) for c in zip(*got))
    order = np.lexsort((tids, ids))
    return ids[order], tids[order], pos[order]


def _positions(ready: tuple, doc_id: int, text_id: int) -> np.ndarray:
    ids, tids, pos = ready
    i, j = np.searchsorted(ids, doc_id), np.searchsorted(ids, doc_id, "right")
    own = tids[i:j]
    return pos[i + np.searchsorted(own, text_id) : i + np.searchsorted(own, text_id, "right")]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = removals(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", hex_digest(F.col("kept")).alias("kept_sha256"))
