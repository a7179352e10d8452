"""SimHash near-duplicates by anchor-point covering.

A document's fingerprint has 64 bits: bit k is set if more than half of its shingles' XXH64 values (seed 42) have it set.
Two fingerprints are linked if they differ in at most 4 bits; groups are the connected components.

Links are found with a covering code as anchors. The 64 bits are cut into three segments of 21, 21 and 22 bits, each
padded to 23; the code is the perfect binary Golay code of length 23, whose covering radius is 3: each of the 2**23 words
lies within 3 of exactly one of its 4096 code words.

* `single`: if two fingerprints differ in at most 4 bits, one of the three segments differs in at most 1. Each fingerprint
  is at home at one anchor a segment and is copied to every anchor within 3+1 bits (5.3 on average), so one's home and the
  other's copy meet.
* `pair`: two of the three segments together differ in at most 2 bits. Homes and copies are at pairs of anchors (2**24 of
  them for each pair of segments), within 3+a and 3+b bits for a+b <= 2: 61 copies instead of 5.3, and buckets of a
  4096th of the size. Used from `pair_from` fingerprints on, so the work for each stays bounded at any size.

Both find every link. Only distinct fingerprints are compared, so exact copies cost nothing. Within an anchor a home is
compared with the copies in blocks, and only what joins two parts of the bucket leaves the task: fewer links than
fingerprints, whatever the group's size. A bucket of n fingerprints, n over `block`, is cut into k = n/block parts of homes
and as many of copies, and each of the k x k meetings is a group of its own of about two blocks. Rows join classes and
components by `with_key`, which leaves rows of large groups where they are.

Cases: null text has no words; no words: fingerprint zero, linked like any other; fewer words than a shingle: the whole
sequence is one; repeated rows have equal fingerprints and one group; a null doc_id gets its group's smallest id, which is
null only if all are; an empty table gives no rows; other columns aren't read (`dedup` keeps them). Whole texts are read,
`SLICE` bytes at a time, so a very long one takes memory for itself and little more.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, with_key, written
from .components import connected

SEED, SHINGLE, BITS, WITHIN = 42, 4, 64, 4
#: bytes of a text worked on at once
SLICE = 1_000_000
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
SEGMENTS = ((0, 21), (21, 21), (42, 22))
#: fixed value: generator polynomial of the binary Golay code [23, 12, 7]
GOLAY, GOLAY_BITS, RADIUS = 0b110001110101, 23, 3


def _shingle_hashes(raw: bytes) -> Iterator[np.ndarray]:
    """XXH64 of every shingle, a slice of the text at a time."""
    from xxhash import xxh64_intdigest

    carried: list[bytes] = []
    at, made = 0, False
    while at < len(raw):
        to = len(raw)
        if at + SLICE < to and (space := _SPACE.search(raw, at + SLICE)):
            to = space.start()
        words = carried + raw[at:to].split()  # splits at \x20 and \x09-\x0D
        at = to
        carried = words[1 - SHINGLE :]
        if len(words) < SHINGLE:
            continue
        joined = b" ".join(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = np.cumsum(sizes)
        starts = (ends - sizes)[: len(words) - SHINGLE + 1].tolist()
        ends = (ends[SHINGLE - 1 :] - 1).tolist()
        made = True
        yield np.fromiter((xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts, ends)), np.uint64, len(starts))
    if carried and not made:
        yield np.array([xxh64_intdigest(b" ".join(carried), SEED)], np.uint64)


def fingerprint(text: str | None) -> int:
    ones, n = np.zeros(BITS, np.int64), 0
    for hashes in _shingle_hashes((text or "").encode().lower()):  # bytes: lower() changes A-Z alone
        own = hashes.view(np.uint8).reshape(-1, 8)
        for k in range(8):  # counts of each bit of byte k, from the counts of its values
            ones[8 * k : 8 * k + 8] += np.bincount(own[:, k], minlength=256) @ _BYTE_BITS
        n += len(hashes)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprints(docs: DataFrame, *others: str) -> DataFrame:
    """docs -> doc_id, fp (the 64 bits as a signed long), others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter(map(fingerprint, b.column(1).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64)), *b.columns[2:]], names=["doc_id", "fp", *others])

    kinds = [(c, docs.schema[c].dataType.simpleString()) for c in ("doc_id", *others)]
    return docs.select("doc_id", "text", *others).mapInArrow(run, ", ".join(f"{c} {kind}" for c, kind in [kinds[0], ("fp", "long"), *kinds[1:]]))


class Cover:
    """The Golay code's anchors around words of 23 bits."""

    def __init__(self) -> None:
        self.of = {0: 0}
        weights = {w: [sum(1 << i for i in at) for at in combinations(range(GOLAY_BITS), w)] for w in range(RADIUS + 3)}
        shells = [[[] for _ in range(2048)] for _ in range(3)]  # patterns to anchors at distance <= 3, = 4, = 5 by syndrome
        for w, patterns in weights.items():
            for e in patterns:
                shells[max(0, w - RADIUS)][self.syndrome(e)].append(e)
        self.shells = []
        for rows in shells:
            wide = max(map(len, rows))
            self.shells.append(np.array([r + [-1] * (wide - len(r)) for r in rows], np.int64))
        powers = [self.syndrome(1 << i) for i in range(GOLAY_BITS)]
        self.low = self._table(powers[:12])
        self.high = self._table(powers[12:])

    @staticmethod
    def syndrome(word: int) -> int:
        for i in range(GOLAY_BITS - 1, 10, -1):
            if word >> i & 1:
                word ^= GOLAY << (i - 11)
        return word

    @staticmethod
    def _table(powers: list[int]) -> np.ndarray:
        out = np.zeros(1 << len(powers), np.int64)
        for i, p in enumerate(powers):
            out[1 << i : 2 << i] = out[: 1 << i] ^ p
        return out

    def anchors(self, words: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each shell (within 3, at 4, at 5) the positions in words and their anchors."""
        s = self.low[words & 4095] ^ self.high[words >> 12]
        out = []
        for shell in self.shells:
            e = shell[s]
            at, _ = np.nonzero(e >= 0)
            out.append((at, words[at] ^ e[e >= 0]))
        return out


def _placed(fps: np.ndarray, pair: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """bucket, position in fps, home (1 for the one that a fingerprint is at home in, in each segment or pair)."""
    cover = _COVER[0] if _COVER else _COVER.append(Cover()) or _COVER[0]
    u = fps.view(np.uint64)
    shells = [cover.anchors(((u >> np.uint64(s)) & np.uint64((1 << n) - 1)).astype(np.int64)) for s, n in SEGMENTS]
    buckets, ats, homes = [], [], []
    if not pair:
        for k, own in enumerate(shells):
            for shell in (0, 1):
                at, anchor = own[shell]
                buckets.append(k << 46 | anchor)
                ats.append(at)
                homes.append(np.full(len(at), shell == 0, np.int8))
    else:
        for k, (a, b) in enumerate(((0, 1), (0, 2), (1, 2))):
            for i in range(3):
                for j in range(3 - i):
                    # every anchor of shell i with every one of shell j of the same fingerprint
                    at, x = shells[a][i]
                    bt, y = shells[b][j]
                    order = np.argsort(bt, kind="stable")
                    bt, y = bt[order], y[order]
                    first, n = np.searchsorted(bt, at), np.searchsorted(bt, at, "right") - np.searchsorted(bt, at)
                    left = np.repeat(np.arange(len(at)), n)
                    right = np.repeat(first - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(len(left)) if len(left) else left
                    buckets.append((k + 3) << 46 | x[left] << 23 | y[right])
                    ats.append(at[left])
                    homes.append(np.full(len(left), i + j == 0, np.int8))
    return np.concatenate(buckets), np.concatenate(ats), np.concatenate(homes)


_COVER: list[Cover] = []


def _joins(homes: np.ndarray, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between a home and a copy that suffice to join whatever such links join: fewer than there are copies."""
    own = np.arange(len(copies))
    place = {int(x): i for i, x in enumerate(copies)}
    left, right = [], []
    for h in homes:
        near = np.flatnonzero(np.bitwise_count(copies ^ h) <= WITHIN)
        mine = own[place[int(h)]]
        other = near[own[near] != mine]
        while len(other):
            left.append(h)
            right.append(copies[other[0]])
            own[own == own[other[0]]] = mine
            other = other[own[other] != mine]
    return np.array(left, np.uint64), np.array(right, np.uint64)


def links(fps: DataFrame, pair_from: int = 8_000_000, block: int = 16384) -> DataFrame:
    """Distinct fp -> a, b: links at WITHIN bits or fewer, enough of them to connect all that are linked."""
    pair = fps.count() >= pair_from

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(0).to_numpy(zero_copy_only=False)
            for i in range(0, len(own), 4096):
                part = own[i : i + 4096]
                bucket, at, home = _placed(part, pair)
                yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(part[at]), pa.array(home)], names=["bucket", "fp", "home"])

    placed = fps.select("fp").mapInArrow(place, "bucket long, fp long, home byte")
    # homes in rows and copies in columns of a square of parts; a home is a copy in its own column already
    large = placed.groupBy("bucket").agg(F.count("*").alias("n")).filter(F.col("n") > block).withColumn("parts", F.ceil(F.col("n") / block).cast("int")).drop("n")
    large = written(large, "simhash-large")
    if not large.isEmpty():
        salted = placed.join(large, "bucket", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        mine, every = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"), F.sequence(F.lit(0), F.col("parts") - 1)
        row = F.when(F.col("home") == 1, F.transform(every, lambda j: F.struct((mine * F.col("parts") + j).alias("part"), F.lit(1).cast("byte").alias("home")))).otherwise(F.array())
        others = F.filter(every, lambda i: (F.col("home") == 0) | (i != mine))
        column = F.transform(others, lambda i: F.struct((i * F.col("parts") + mine).alias("part"), F.lit(0).cast("byte").alias("home")))
        placed = salted.select("bucket", "fp", F.explode(F.concat(row, column)).alias("x")).select("bucket", "x.part", "fp", "x.home")
    else:
        placed = placed.select("bucket", F.lit(0).alias("part"), "fp", "home")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(keys, fp, home):
            cuts = np.flatnonzero(np.diff(keys)) + 1
            a, b = [], []
            for f, h in zip(np.split(fp, cuts), np.split(home, cuts)):
                if len(f) > 1 and h.any():
                    x, y = _joins(f[h == 1], f)
                    a.append(x)
                    b.append(y)
            if a:
                a, b = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
                return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
            return None

        held: list[tuple[np.ndarray, ...]] = []  # of the bucket that may go on in the next batch
        for x in batches:
            bucket, part, fp, home = (x.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            keys, fp = bucket * np.int64(1_000_003) + part, fp.view(np.uint64)
            if not len(keys):
                continue
            last = np.flatnonzero(np.diff(keys))
            if held and keys[0] == held[-1][0][-1] and not len(last):
                held.append((keys, fp, home))
                continue
            cut = int(last[-1]) + 1 if len(last) else 0
            own = [*held, (keys[:cut], fp[:cut], home[:cut])]
            held = [(keys[cut:], fp[cut:], home[cut:])]
            made = out(*(np.concatenate(c) for c in zip(*own)))
            if made:
                yield made
        if held:
            made = out(*(np.concatenate(c) for c in zip(*held)))
            if made:
                yield made

    met = placed.repartition("bucket", "part").sortWithinPartitions("bucket", "part")
    return met.select("bucket", "part", "fp", "home").mapInArrow(compare, "a long, b long").distinct()


def groups(docs: DataFrame, **how) -> DataFrame:
    """docs -> doc_id, fp, component_id (smallest doc_id reachable over links)."""
    own = written(fingerprints(docs), "simhash-fp")
    classes = written(own.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "simhash-classes")
    rooted = written(_rooted(classes, **how).select("fp", "root", "least"), "simhash-roots")
    roots = written(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "simhash-components")
    of = with_key(rooted.select("fp", "root"), roots.drop("n"), "root", roots.select("root", "n")).select("fp", "component_id")
    return with_key(own, of, "fp", classes.select("fp", "n"))


def _rooted(classes: DataFrame, **how) -> DataFrame:
    """classes (distinct fp, ...) with root: the same fp for all that are connected."""
    linked = connected(links(classes, **how))  # v, root; fingerprints without a link aren't in it
    return classes.join(linked.withColumnRenamed("v", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def dedup(docs: DataFrame, **how) -> DataFrame:
    """docs with one row of each group: the one with the smallest doc_id (null last), of these the one with the smallest
    hash of its text and other columns. Rows are told apart by this hash, so rows that share an id, or have none, are rows
    of their own, and it is the same row on every run."""
    others = [c for c in docs.columns if c != "text"]
    hashed = F.sha2(F.concat_ws(" ", F.sha2(F.col("text").cast("binary"), 256), F.to_json(F.struct(*others))), 256)  # doc_id is one of them
    keyed = docs.withColumn("_simhash_key", hashed)
    own = written(fingerprints(keyed, "_simhash_key"), "simhash-fp")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col("_simhash_key").alias("key"))
    classes = written(own.groupBy("fp").agg(F.min(first).alias("least")), "simhash-classes")
    kept = _rooted(classes, **how).groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.key").alias("_simhash_key"))
    # rows of one key are equal in all columns
    return keyed.join(kept, "_simhash_key", "left_semi").dropDuplicates(["_simhash_key"]).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
