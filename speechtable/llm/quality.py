"""Quality classifier: supervised subword embeddings.

A text is a bag of hashed features: its words, and the character n-grams (3, 4 and 5 bytes) of its words with their ends
marked. Each feature has a learned vector; a document is the mean of its features' vectors, a linear layer makes scores of
the mean, and softmax makes chances of the scores. Vectors and layer are trained together by stochastic gradient descent
in numpy, on a sample of labelled documents that is bounded in rows (`SAMPLE`) and bytes (`SAMPLE_BYTES`; a text that no
longer fits is passed over) and chosen by a hash of the id, so it is the same on every run. As everything after the look-up is linear, scoring needs one number a
feature: the difference of its two scores. The model has a fixed size (2**BUCKET_BITS numbers) and is broadcast.

Whole texts are used in training and scoring. A byte that is white space ends a word; offsets and lengths play no part.

Cases: null or empty text has no features and gets the score of the bias alone, which training sees as the base rate;
null labels and labels without a document are left out, several labels of a document count as their majority (a tie as
1); a null doc_id is not held out and has no label; repeated rows are scored alike; without any usable label every score
is 0.5, and `keep` keeps all; an empty table gives no rows; other columns aren't read (`keep` keeps them). Texts are worked
on `SLICE` bytes at a time, cut at white space, so a very long one takes memory for itself and little more.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

BUCKET_BITS, DIM, EPOCHS, RATE, SEED = 17, 12, 6, 0.5, 11
#: bounds of the training sample
SAMPLE, SAMPLE_BYTES = 4000, 48_000_000
SLICE = 1_000_000
NGRAMS = (3, 4, 5)
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
KEEP_FROM = 0.7
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h + np.uint64(salt)) * _MULTIPLIER
    return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)


def features(text: str | None) -> Iterator[np.ndarray]:
    """Bucket numbers, one for each occurrence of a feature, a slice of the text at a time. No feature crosses a space."""
    raw = (text or "").encode()
    at = 0
    while at < len(raw):
        to = len(raw)
        if at + SLICE < to and (space := _SPACE.search(raw, at + SLICE)):
            to = space.start()
        yield _features(raw[at:to])
        at = to


def _features(raw: bytes) -> np.ndarray:
    raw = b" " + b" ".join(raw.split()) + b" "
    b = np.frombuffer(raw, np.uint8)
    if len(b) <= 2:
        return np.zeros(0, np.int32)
    space = b == 32
    gaps = np.flatnonzero(space)
    wide = b.astype(np.uint64)
    # words: a sum of byte times a power of an odd number, from word start to end
    out = []
    code = wide + np.uint64(1)
    step = np.uint64(0x100000001B3)
    offset = np.arange(len(b)) - np.maximum.accumulate(np.where(space, np.arange(len(b)), 0))
    powers = _powers(step, int(offset.max()) + 1)
    out.append(_mixed(np.add.reduceat(np.where(space, 0, code * powers[offset]), gaps[:-1]), 1))
    h = code.copy()
    crossed = np.concatenate(([0], np.cumsum(space)))
    for n in range(2, max(NGRAMS) + 1):
        if len(b) < n:
            break
        h = h[: len(b) - n + 1] * step + code[n - 1 :]
        if n in NGRAMS:  # those without white space inside; at the ends it marks the word's ends
            inside = crossed[n - 1 : len(b)][: len(h)] - crossed[1 : len(h) + 1] == 0
            out.append(_mixed(h[inside], n))
    return np.concatenate(out)


def _powers(step: np.uint64, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.full(n, step, np.uint64))


def train(texts: list[str | None], labels: list[int]) -> tuple[np.ndarray, float]:
    """The weight of each bucket and the bias: their sum, features' weights averaged, is log(p(1)/p(0))."""
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (1 << BUCKET_BITS, DIM)).astype(np.float32)
    layer, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    bags = []
    for t in texts:
        at, n = np.zeros(0, np.int64), np.zeros(0)
        for own in features(t):
            found, more = np.unique(own, return_counts=True)
            at, place = np.unique(np.concatenate((at, found)), return_inverse=True)
            n = np.bincount(place, np.concatenate((n, more)), len(at))
        bags.append((at, (n / max(1, n.sum())).astype(np.float32)))
    total, seen = EPOCHS * len(bags), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(bags)):
            at, share = bags[i]
            rate = np.float32(RATE * (1 - seen / total))
            seen += 1
            own = vectors[at]
            mean = share @ own
            scores = mean @ layer + bias
            p = np.exp(scores - scores.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = layer @ p
            layer -= rate * np.outer(mean, p)
            bias -= rate * np.float32(0.1) * p
            # a feature that makes up much of a document moves as much as in a mean of many
            vectors[at] = own - (rate * len(at) ** 0.5 * share)[:, None] * back
    return (vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> tuple[np.ndarray, float, int]:
    """Weights, bias, and how many documents they were learned from."""
    usable = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    own = docs.filter(F.octet_length(F.coalesce("text", F.lit(""))) <= most_bytes)
    one = usable.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("quality")).join(own.select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = own.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most `rows` rows are broadcast
    sample = found.groupBy("doc_id").agg(F.min(F.struct("text", "quality")).alias("x")).select("doc_id", "x.*").orderBy(F.xxhash64("doc_id"), "doc_id")
    texts, marks, left = [], [], most_bytes
    for r in sample.toLocalIterator():
        size = len((r["text"] or "").encode())
        if size <= left:
            left -= size
            texts.append(r["text"])
            marks.append(r["quality"])
    return *train(texts, marks), len(texts)


def scores(docs: DataFrame, model: tuple[np.ndarray, float, int], columns: list[str]) -> DataFrame:
    """The given columns of docs, with score added."""
    weights, bias = docs.sparkSession.sparkContext.broadcast(model[0]), model[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for b in batches:
            z = np.full(b.num_rows, bias)
            for i, t in enumerate(b.column(b.num_columns - 1).to_pylist()):
                total, n = 0.0, 0
                for at in features(t):
                    total += float(w[at].sum(dtype=np.float64))
                    n += len(at)
                z[i] += total / max(1, n)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(1 / (1 + np.exp(-np.clip(z, -60, 60))))], names=[*columns, "score"])

    own = docs.select(*columns, F.col("text").alias("_quality_text"))
    schema = own.drop("_quality_text").schema.add("score", "double")
    return own.mapInArrow(run, schema)


def keep(docs: DataFrame, labels: DataFrame, from_: float = KEEP_FROM, **bounds) -> DataFrame:
    """docs without the documents that score below from_; columns stay as they are, but for one named score, which goes."""
    model = fit(docs, labels, **bounds)
    kept = docs.drop("score")
    if not model[2]:
        return kept
    return scores(kept, model, kept.columns).filter(F.col("score") >= from_).select(*kept.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scores(docs, fit(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= KEEP_FROM).cast("int").alias("predicted"))
