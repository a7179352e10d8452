"""Document fingerprints: SimHash over weighted terms, and a search by permuted block tables.

Terms are a text's words (A-Z lower-cased) and pairs of neighbouring words. A term weighs the square root of its count; its
128-bit hash votes with this weight for each bit that it has and against each that it hasn't, and a fingerprint keeps the
signs. Two texts' fingerprints differ in each bit with the chance angle / pi, so `likeness` gives the cosine of that angle,
0 where it is negative.

`search` finds all fingerprints within a Hamming radius r of given ones: the bits are cut into r+2 blocks, of which at
least two are equal if at most r bits differ. There is a table for each pair of blocks, with the pair moved to the front
as the key; equal keys meet in a join and are verified on all bits. A pair of fingerprints is reported once, by the first
table in which the two meet. A key with over `HOT_BLOCK` fingerprints is dealt out over several groups, each of which gets
all queries of the key.

Cases: null text counts as empty; an empty text has no terms and the fingerprint of zeros; equal texts have equal
fingerprints; repeated rows stand for themselves, and rows with one id follow each other by text; null ids come last; an
empty table gives no rows; other columns aren't read. Whole texts are read, a slice at a time; a text's distinct terms are
held at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, with_key, written
from .recompress import mixed, word_names

BITS = 128
#: words whose terms are counted at once, fingerprints of a key that one group holds, and the query's radius
SLICE, HOT_BLOCK, WITHIN = 1_000_000, 20_000, 3
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x94D049BB133111EB))
_SIGNS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64) * 2 - 1


def _terms(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct terms and their counts."""
    terms, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for i in range(0, len(names), SLICE):
        own, after = names[i : i + SLICE], names[i + 1 : i + SLICE + 1]
        found, more = np.unique(np.concatenate((own, mixed(own[: len(after)] * _A + after))), return_counts=True)
        terms, at = np.unique(np.concatenate((terms, found)), return_inverse=True)
        n = np.bincount(at, np.concatenate((n, more)), len(terms)).astype(np.int64)
    return terms, n


def fingerprint(text: str | None) -> bytes:
    """16 bytes."""
    names = word_names((text or "").encode().lower())
    if not len(names):
        return bytes(BITS // 8)
    terms, n = _terms(names)
    weights = np.sqrt(n)
    out = []
    for salt in range(BITS // 64):
        own = mixed(terms * _C + np.uint64(salt)).view(np.uint8).reshape(-1, 8)
        for k in range(8):
            out.append(np.packbits(np.bincount(own[:, k], weights, minlength=256) @ _SIGNS > 0, bitorder="little")[0])
    return bytes(out)


def likeness(a: bytes, b: bytes) -> float:
    if a == b:
        return 1.0
    apart = int(np.bitwise_count(np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)).sum())
    return max(0.0, float(np.cos(np.pi * apart / BITS)))


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs -> doc_id, fp (binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t) for t in b.column(1).to_pylist()], pa.binary())], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp binary")


def _masks(radius: int) -> list[tuple[int, int]]:
    """The bits of each of the radius+2 blocks in the two halves of a fingerprint."""
    n = radius + 2
    cuts = [round(i * BITS / n) for i in range(n + 1)]
    halves = []
    for a, b in zip(cuts, cuts[1:]):
        bits = (1 << b) - (1 << a)
        halves.append(tuple(x - (1 << 64) if x >> 63 else x for x in (bits >> 64, bits & (1 << 64) - 1)))
    return halves


def _halves(fp: Column) -> list[Column]:
    """A fingerprint's two halves as longs."""
    part = lambda i: F.conv(F.substring(F.hex(fp), 8 * i + 1, F.lit(8)), 16, 10).cast("long")
    return [F.shiftleft(part(i), 32).bitwiseOR(part(i + 1)) for i in (0, 2)]


def _near(fps: DataFrame, queries: DataFrame, radius: int) -> DataFrame:
    """Distinct fp and distinct q -> q, fp, apart: all within radius bits."""
    if not 0 <= radius <= BITS - 2:
        raise ValueError(f"radius must be 0 to {BITS - 2}")
    masks = _masks(radius)
    pairs = [(a[0] | b[0], a[1] | b[1]) for a, b in combinations(masks, 2)]

    def keyed(df: DataFrame) -> DataFrame:
        high, low = _halves(F.col("fp"))
        halves = df.select("fp", high.alias("high"), low.alias("low"))
        keys = F.array(*(F.xxhash64(F.lit(i), F.col("high").bitwiseAND(F.lit(a)), F.col("low").bitwiseAND(F.lit(b))) for i, (a, b) in enumerate(pairs)))
        return halves.select("high", "low", F.posexplode(keys).alias("at", "key"))

    ours, theirs = keyed(fps), keyed(queries.withColumnRenamed("q", "fp")).select("key", F.col("high").alias("q_high"), F.col("low").alias("q_low"))
    hot = written(ours.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > HOT_BLOCK).select("key", F.ceil(F.col("n") / HOT_BLOCK).cast("int").alias("parts")), "fingerprint-hot")
    if hot.isEmpty():
        met = ours.join(theirs, "key")
    else:
        dealt = lambda df: df.join(hot, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        ours = dealt(ours).withColumn("part", F.pmod(F.xxhash64("high", "low"), F.col("parts")).cast("int")).drop("parts")
        theirs = dealt(theirs).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        met = ours.join(theirs, ["key", "part"])
    apart = met.withColumns({"x": F.col("high").bitwiseXOR(F.col("q_high")), "y": F.col("low").bitwiseXOR(F.col("q_low"))})
    equal = lambda a, b: (F.col("x").bitwiseAND(F.lit(a)) == 0) & (F.col("y").bitwiseAND(F.lit(b)) == 0)
    first = F.coalesce(*(F.when(equal(a, b), i) for i, (a, b) in enumerate(pairs)))
    near = apart.filter(F.bit_count("x") + F.bit_count("y") <= radius).filter(first == F.col("at"))
    whole = lambda high, low: F.unhex(F.concat(F.lpad(F.hex(high), 16, "0"), F.lpad(F.hex(low), 16, "0")))
    return near.select(whole("q_high", "q_low").alias("q"), whole("high", "low").alias("fp"), (F.bit_count("x") + F.bit_count("y")).cast("int").alias("apart"))


def search(fps: DataFrame, queries: DataFrame, radius: int) -> DataFrame:
    """fps (id, fp), queries (query, fp) -> query, id, apart: all within radius bits, the query itself included.

    Equal fingerprints are folded first and unfolded last, so a group of copies meets a query once.
    """
    near = _near(fps.select("fp").distinct(), queries.select(F.col("fp").alias("q")).distinct(), radius)
    return near.join(queries.withColumnRenamed("fp", "q"), "q").join(fps, "fp").select("query", "id", "apart")


def count_within(fps: DataFrame, queries: DataFrame, radius: int) -> DataFrame:
    """fps (fp), queries (fp) -> fp (each of queries once), n_within: rows of fps within radius bits."""
    classes = written(fps.groupBy("fp").agg(F.count("*").alias("n")), "fingerprint-classes")
    near = _near(classes.select("fp"), queries.select(F.col("fp").alias("q")).distinct(), radius)
    return near.join(classes, "fp").groupBy(F.col("q").alias("fp")).agg(F.sum("n").alias("n_within"))


def successors(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """docs (doc_id, text) dealt out so that each partition's rows stand in descending order of doc_id with the row that
    follows after them: bucket, doc_id, text, guest.

    Buckets are ranges of ids, cut at approximate percentiles, and for rows without an id ranges of the text's hash. The row that follows a bucket's last is the first of the
    next bucket that has rows (after the last bucket, of the first one), and comes along as a guest. Only the buckets'
    first ids pass through the driver.
    """
    buckets = buckets or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # several a partition even out
    cuts = docs.agg(F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)], 100 * buckets).alias("x")).first()["x"] if buckets > 1 else []
    cuts = np.array(sorted(set(cuts or [])), np.int64)

    @F.pandas_udf("int")
    def bucket_of(ids: pd.Series, h: pd.Series) -> pd.Series:
        known = ids.notna()
        at = len(cuts) + 1 + 32 + (h.to_numpy(np.int64) >> 58)  # by the first 6 bits
        at[known] = len(cuts) - np.searchsorted(cuts, ids[known].to_numpy(np.int64), "right")
        return pd.Series(at)

    text_hash = F.xxhash64(F.coalesce("text", F.lit("")))
    placed = docs.select(bucket_of(F.col("doc_id"), text_hash).alias("bucket"), "doc_id", F.coalesce("text", F.lit("")).alias("text"), text_hash.alias("h"))
    # the first row of a bucket: the largest id, of rows with one id the first by hash of the text
    heads = placed.groupBy("bucket").agg(F.max_by(F.struct("doc_id", "h"), F.struct("doc_id", F.bitwise_not("h"))).alias("x")).orderBy("bucket").collect()
    rows = [(r["x"]["doc_id"], r["x"]["h"], heads[i - 1]["bucket"]) for i, r in enumerate(heads)]
    guests = F.broadcast(docs.sparkSession.createDataFrame(rows, "head long, head_h long, goes int"))  # a row a bucket
    both = placed.join(guests, F.col("doc_id").eqNullSafe(F.col("head")) & (F.col("h") == F.col("head_h")), "left")
    # a row is copied where it lies, so the text is shuffled once
    own, also = (F.struct(F.col(c).alias("bucket"), F.lit(g).alias("guest")) for c, g in (("bucket", False), ("goes", True)))
    dealt = both.select(F.explode(F.when(F.col("goes").isNotNull(), F.array(own, also)).otherwise(F.array(own))).alias("x"), "doc_id", "text", "h").select("x.*", "doc_id", "text", "h")
    return dealt.repartition("bucket").sortWithinPartitions("bucket", "guest", F.col("doc_id").desc_nulls_last(), "h")


def edited(docs: DataFrame) -> DataFrame:
    """docs -> doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edit replaces the last third of the text with the beginning of the next document's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # the row that waits for the one after it

        def row(now, text, own):
            doc_id, mine, fp = now
            n = len(mine)
            changed = mine[: n - n // 3] + text[: n // 3]
            e = fingerprint(changed)
            return doc_id, n, hashlib.sha256(changed.encode()).hexdigest(), fp.hex(), e.hex(), likeness(fp, e), likeness(fp, own)

        for b in batches:
            out = []
            for g, i, t in zip(*(c.to_pylist() for c in b.columns)):
                if g and before is None:
                    continue  # a second row like the bucket's first
                fp = fingerprint(t)
                if before is not None:
                    out.append(row(before, t, fp))
                before = None if g else (i, t, fp)
            yield pa.RecordBatch.from_pylist([dict(zip(NAMES, r)) for r in out], pa.schema(SCHEMA))

    return successors(docs).select("guest", "doc_id", "text").mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


SCHEMA = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
NAMES = [n for n, _ in SCHEMA]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edited() of all documents; n_within is the number of documents within WITHIN bits of a document's fingerprint, for
    ids divisible by 20 (else null)."""
    rows = written(edited(table(spark, sf_dir, "documents")).withColumn("fp", F.unhex("fingerprint")), "fingerprint-rows")
    asked = F.coalesce(F.col("doc_id") % 20 == 0, F.lit(False))
    found = count_within(rows, rows.filter(asked), WITHIN)
    counts = rows.filter(asked).groupBy("fp").agg(F.count("*").alias("n"))
    met = with_key(rows.filter(asked), found, "fp", counts)
    return met.unionByName(rows.filter(~asked).withColumn("n_within", F.lit(None).cast("long"))).drop("fp")
