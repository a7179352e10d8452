"""Periodic runs of words: stretches that repeat one phrase four times or more, found exactly, and texts without the repeats.

A run is a stretch of consecutive words with smallest period q (words q apart are the same) and at least max(6, 4 q) words,
that no neighbouring word extends keeping period q. Collapsing a text keeps the first q words of each run and drops the rest.

1. Every word of a run occurs four times in its document and every pair of neighbours in it three times. Stretches of six or
   more words that meet this are what is searched; others can't hold any part of a run.
2. Enhanced suffix array. The stretches of many documents are sorted together (prefix doubling; a separator that is like
   nothing else follows each), with inverse (ISA) and longest common prefixes (LCP).
3. Branching tandem test. At each LCP interval of depth d, split between neighbouring children, the suffixes i of the smaller
   side ask whether ISA[i + d] or ISA[i - d] is on the other side: then the d words at i stand twice and the word after them
   differs from the one d before. Two further look-ups in the interval tell whether they stand four times. The halves that are
   walked add up to n log n; no tree is built.
4. Every run ends with such a square. Rotating it to the left as long as words agree gives the run's start; squares that
   repeat a shorter period of a run with the same end are left out.

Each document is worked on where its row lies; nothing is shuffled. Memory and time follow the longest document (n log n).

Cases: null or empty text has no words and no runs; repeated rows and ids, a null id included, are documents of their own;
very long texts are searched whole; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import cycle, islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hex_digest, table

LEAST_WORDS, LEAST_PERIODS = 6, 4
#: bytes of text, and pairs of suffix and interval, worked on at once
SLICE, PAIRS = 2_000_000, 1_000_000
RUNS = "array<struct<start:int,length:int,period:int>>"


def stretches(words: list[bytes]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Numbers of the words that occur four times (0: others), and the stretches [begin, end) that may hold runs."""
    often = [w for w, n in Counter(words).items() if n >= LEAST_PERIODS]
    number = {w: k for k, w in enumerate(often, 1)}
    ids = np.fromiter(map(number.get, words, repeat(0)), np.int64, len(words))
    pair = np.where((ids[:-1] > 0) & (ids[1:] > 0), ids[:-1] * (len(often) + 1) + ids[1:], 0)
    at = np.flatnonzero(pair)
    _, which, n = np.unique(pair[at], return_inverse=True, return_counts=True)
    good = np.zeros(len(pair) + 2, np.int8)
    good[at[n[which] >= LEAST_PERIODS - 1] + 1] = 1
    edges = np.flatnonzero(np.diff(good)).reshape(-1, 2)  # first pair, pair after the last
    edges = edges[edges[:, 1] - edges[:, 0] >= LEAST_WORDS - 1]
    return ids, [(int(a), int(b) + 1) for a, b in edges]


def suffix_array(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and each one's place. The last number of s must be in it once."""
    n = len(s)
    order = np.argsort(s, kind="stable")
    rank = np.empty(n, np.int64)
    places, key = np.arange(n), s[order]
    new = np.concatenate(([True], key[1:] != key[:-1]))
    k = 1
    while True:
        head = places[np.maximum.accumulate(np.where(new, np.arange(len(places)), 0))]
        rank[order[places]] = head
        tied = ~(new & np.concatenate((new[1:], [True])))
        places = places[tied]
        if not len(places):
            return order, rank
        own = order[places]
        first, second = rank[own], rank[own + k]  # tied suffixes have k words and another after them
        by = np.lexsort((second, first))
        order[places] = own[by]
        first, second = first[by], second[by]
        new = np.concatenate(([True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])))
        k *= 2


def common_prefixes(s: np.ndarray, order: np.ndarray, rank: np.ndarray) -> list[int]:
    """Length of what each suffix shares with the one before it in order; -1 for the first."""
    t, sa, isa = s.tolist(), order.tolist(), rank.tolist()
    out = [-1] * len(t)
    h = 0
    for i, r in enumerate(isa):
        if r:
            j = sa[r - 1]
            while t[i + h] == t[j + h]:  # ends at a separator at the latest
                h += 1
            out[r] = h
            if h:
                h -= 1
        else:
            h = 0
    return out


def splits(lcp: list[int]) -> np.ndarray:
    """Rows (depth, begin of the interval, begin, split, end): at a split of an interval of some depth, the suffixes of [begin,
    split) and [split, end) branch; every two children of an interval are told apart by one split."""
    n = len(lcp)
    left, whole, right = [0] * n, [0] * n, [n] * n
    stack = [0]
    for k in range(1, n):
        v = lcp[k]
        while lcp[stack[-1]] > v:
            right[stack.pop()] = k
        top = stack[-1]
        left[k] = top
        whole[k] = whole[top] if lcp[top] == v else top
        stack.append(k)
    out = np.array([lcp, whole, left, range(n), right], np.int64).T
    return out[(out[:, 0] > 0) & (out[:, 4] - out[:, 1] >= LEAST_PERIODS)]


def squares(order: np.ndarray, rank: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """End and period of branching squares that stand four times in a row."""
    depth, whole, lo, mid, hi = at.T
    near = mid - lo <= hi - mid
    begin, size = np.where(near, lo, mid), np.where(near, mid - lo, hi - mid)
    other, until = np.where(near, mid, lo), np.where(near, hi, mid)
    upto = np.cumsum(size)
    a = 0
    while a < len(at):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PAIRS, "right")))
        j = np.repeat(np.arange(a, b), size[a:b])
        i = order[begin[j] + np.arange(len(j)) - np.repeat(upto[a:b] - size[a:b] - (upto[a - 1] if a else 0), size[a:b])]
        for first in (i, i - depth[j]):
            asked = first + depth[j] if first is i else first
            ok = asked >= 0
            ok &= (rank[asked * ok] >= other[j]) & (rank[asked * ok] < until[j])
            x, own = first[ok], j[ok]
            for back in (1, 2):
                y = x - back * depth[own]
                ok = y >= 0
                ok &= (rank[y * ok] >= whole[own]) & (rank[y * ok] < hi[own])
                x, own = x[ok], own[ok]
            yield x + 2 * depth[own], depth[own]
        a = b


def runs_of(s: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of s, whose stretches each end with a number of their own."""
    order, rank = suffix_array(s)
    ends: dict[int, list[int]] = {}
    for e, d in squares(order, rank, splits(common_prefixes(s, order, rank))):
        for x, y in zip(e.tolist(), d.tolist()):
            ends.setdefault(x, []).append(y)
    out = []
    for e, periods in ends.items():
        own: list[tuple[int, int]] = []
        for d in sorted(set(periods)):
            if any(d % q == 0 and e - start >= 2 * d for start, q in own):
                continue
            start, step = e - LEAST_PERIODS * d, 64
            while start:  # rotate to the left
                step = min(step, start)
                differ = np.flatnonzero(s[start - step : start] != s[start - step + d : start + d])
                if len(differ):
                    start -= step - 1 - int(differ[-1])
                    break
                start -= step
                step *= 2
            own.append((start, d))
        out += [(start, e - start, q) for start, q in own if e - start >= max(LEAST_WORDS, LEAST_PERIODS * q)]
    return out


def found(documents: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each document by start and period."""
    parts, origin, base = [], [], 0  # origin: document, its word that the part begins with, place in s
    at = 0
    for k, words in enumerate(documents):
        if len(words) < LEAST_WORDS:
            continue
        ids, own = stretches(words)
        for a, b in own:
            parts += [ids[a:b] + base, [-1 - len(origin)]]  # separators are below zero
            origin.append((k, a, at))
            at += b - a + 1
        base += int(ids.max()) + 1
    out: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    if parts:
        begins = np.array([x[2] for x in origin])
        for start, length, period in runs_of(np.concatenate(parts)):
            k, a, begin = origin[int(np.searchsorted(begins, start, "right")) - 1]
            out[k].append((a + start - begin, length, period))
    return [sorted(x, key=lambda r: (r[0], r[2])) for x in out]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """Words that stay, joined by one space."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join(words[i] for i in np.flatnonzero(keep).tolist())


def _slices(texts: pa.Array) -> Iterator[tuple[int, list[list[bytes]]]]:
    """The words of documents, about SLICE bytes of text at a time, with the number of the first."""
    own, size, first = [], 0, 0
    for i, t in enumerate(texts):
        text = (t.as_py() or "").encode()
        own.append(text.split())
        size += len(text)
        if size >= SLICE:
            yield first, own
            own, size, first = [], 0, i + 1
    if own:
        yield first, own


def detect(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_words, runs (start, length, period by start and period), collapsed (the words that stay)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, documents in _slices(b.column(1)):
                each = found(documents)
                cuts = np.cumsum([0, *map(len, each)]).astype(np.int32)
                flat = np.array([r for x in each for r in x], np.int32).reshape(-1, 3)
                structs = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], names=["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(first, len(documents)), pa.array([len(w) for w in documents], pa.int64()), pa.ListArray.from_arrays(cuts, structs),
                     pa.array([collapsed(w, r).decode() for w, r in zip(documents, each)], pa.string())],
                    names=["doc_id", "n_words", "runs", "collapsed"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, runs {RUNS}, collapsed string")


def collapse(docs: DataFrame) -> DataFrame:
    """docs with the text of those that hold a run collapsed; others keep theirs as it is, and n_chars, where there is one,
    follows the text."""
    columns, schema = docs.columns, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, documents in _slices(b.column(columns.index("text"))):
                rows = b.slice(first, len(documents))
                text = rows.column(columns.index("text")).to_pylist()
                each = found(documents)
                made = [collapsed(w, r).decode() if r else t for t, w, r in zip(text, documents, each)]
                new = {"text": pa.array(made, pa.string())}
                if "n_chars" in columns:
                    was = rows.column(columns.index("n_chars"))
                    new["n_chars"] = pa.array([len(m) if r else n for m, r, n in zip(made, each, was.to_pylist())], was.type)
                yield pa.RecordBatch.from_arrays([new.get(c, rows.column(i)) for i, c in enumerate(columns)], names=columns)

    return docs.mapInArrow(run, schema)


def planted(doc_id: int | None, text: str | None) -> str | None:
    """The text with the periodic tail that the query's contract puts into a tenth of the documents."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    words = (text or "").encode().split() if h % 10 == 0 else []
    if not words:
        return text
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return b" ".join(words[:a] + list(islice(cycle(words[a : a + p]), n - a))).decode()


def with_planted(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text), with planted() texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [planted(i, t) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    docs = docs.select("doc_id", "text")
    return docs.mapInArrow(run, docs.schema)


def strongest(runs: Column) -> Column:
    """The run with the greatest length by period; of equals the one that starts first, then with the least period."""
    more = lambda a, x: x["length"].cast("long") * a["period"] > a["length"].cast("long") * x["period"]
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda a, x: F.when(more(a, x), x).otherwise(a))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = detect(with_planted(table(spark, sf_dir, "documents"))).withColumn("best", strongest(F.col("runs")))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[k].cast("string") for k in ("start", "length", "period"))), F.lit("\n")))
    best = {k: F.col(f"best.{k}").cast("long") for k in ("start", "length", "period")}
    return made.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *(c.alias(k) for k, c in best.items()), F.expr("1000L * best.length div best.period").alias("exponent_milli"),
        hex_digest(F.array_join(line, "")).alias("runs_sha256"), hex_digest(F.col("collapsed")).alias("collapsed_sha256"),
    )
