"""Benchmark decontamination: a hash set of normalised test n-grams, scanned over every training window.

Words are runs of letters, digits and non-ASCII characters after A-Z are lower-cased. A window is `n` consecutive words
of a benchmark item, or the whole of an item that has fewer. A document is scanned in one pass, row by row:

1. Any window of n words holds a whole block of (n+1)//2 words that starts at a multiple of (n+1)//2, wherever the window
   itself starts. So a document can hold a window only if one of its few aligned blocks is in the hash set of the
   benchmark's blocks. This looks at each word once and has no false negatives.
2. Documents that pass have all their windows looked up, as whole strings, in the set of the benchmark's windows. That is
   the verification: no hit rests on a hash alone.

Windows that the same items hold share one number for these items, and only that travels with a hit: the items of a document are
looked up once for each number in it, however often a passage that many items share occurs.

The sets are values of scalar subqueries (an array of hash buckets), which Spark gives to every task; their size is checked
first. Up to `set_limit` windows nothing is shuffled at all. For a larger benchmark the blocks become a bit map of at most
`MAP_BITS` bits, documents are tested on it where they lie, windows of those that pass on a map of whole windows, and what
is left is joined with the benchmark's, and only these documents with what was found; the others' text never moves. A window that a large share of the
documents holds is dealt out over all partitions.

Cases: null or empty text has no words; an item without words has no window; a null item_id counts as the item "";
repeated rows and repeated ids are documents of their own; an empty benchmark hits nothing; other columns are kept as
they are, save those whose names begin with `_dc_`. Whole texts are read, in time that grows with their length; a long text
that passes the first test holds its windows at once, about n times its size.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, hex_digest, let, once, table, with_key, written

#: fixed values: what separates words in lower-cased text, and in text as it is
SEPARATOR = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
SEPARATOR_ANY_CASE = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
N = 10
#: windows of a benchmark that are held as a set, and the bits of the map of a larger one
SET_LIMIT, MAP_BITS = 500_000, 1 << 28
FOUND = "array<struct<start:int,size:int,set_no:long>>"


def words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), f"[{SEPARATOR}]+"), lambda w: w != "")


def _grams(words: Column, n: int, make, step: int = 1) -> Column:
    """make(slice of n words, position of its first) at every step-th position; null if there are fewer words."""
    last = F.floor((F.size(words) - n) / step).cast("int")
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(0), last), lambda i: make(F.slice(words, i * step + 1, F.lit(n)), i * step)))


def _hashes(words: Column, n: int, step: int = 1) -> Column:
    return _grams(words, n, lambda s, i: F.xxhash64(s), step)


def _windows(words: Column, size: int) -> Column:
    found = _grams(words, size, lambda s, i: F.struct(i.cast("int").alias("start"), F.lit(size).alias("size"), F.array_join(s, " ").alias("gram")))
    return F.coalesce(found, F.array().cast("array<struct<start:int,size:int,gram:string>>"))


def _block(size: int) -> int:
    """Blocks of so many words, at multiples of it: one lies inside any window of `size` words."""
    return (size + 1) // 2


def benchmark_windows(benchmark: DataFrame, n: int = N) -> DataFrame:
    """One row per distinct window: gram, size, items (the ids, as strings, of the items that hold it)."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    grams = F.coalesce(_grams(F.col("w"), n, lambda s, i: F.array_join(s, " ")), F.array(F.array_join("w", " ")))
    return items.select("item", F.least(F.size("w"), F.lit(n)).alias("size"), F.explode(grams).alias("gram")).groupBy("gram", "size").agg(F.collect_set("item").alias("items"))


def item_sets(windows: DataFrame) -> DataFrame:
    """Distinct lists of items of benchmark_windows, numbered: items, set_no. Numbers are fixed once this is written."""
    return windows.select(F.array_sort("items").alias("items")).distinct().withColumn("set_no", F.monotonically_increasing_id())


def _array_of(rows: DataFrame, at: str, value: str, n: int, empty: Column) -> Column:
    """rows (at: 0 .. n-1, a row each; value) as one array of n values, a scalar subquery."""
    all_ = rows.sparkSession.range(n).join(rows, F.col("id") == F.col(at), "left").select("id", F.coalesce(value, empty).alias("v"))
    return all_.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "v"))), lambda x: x["v"]).alias("v")).scalar()


def _blocks_of(grams: DataFrame, b: int) -> DataFrame:
    """Hashes h of all blocks of b words of windows whose block size that is."""
    own = grams.filter(F.floor((F.col("size") + 1) / 2) == b)
    return own.select(F.explode(_hashes(F.split("gram", " "), b)).alias("h")).distinct()


def _block_set(blocks: DataFrame, n: int):
    """The set as a column, and its test of a hash."""
    m = max(1, n // 2)
    rows = blocks.groupBy(F.pmod("h", F.lit(m)).alias("at")).agg(F.collect_list("h").alias("hs"))
    held = _array_of(rows, "at", "hs", m, F.array().cast("array<long>"))
    return held, lambda s, h: F.array_contains(F.get(s, F.pmod(h, F.lit(m)).cast("int")), h)


def _block_map(blocks: DataFrame, n: int):
    """A bit map, in place of the set: a hash that isn't in it may look as if it were."""
    bits = 1 << 20
    while bits < min(16 * n, MAP_BITS):
        bits *= 2
    place = lambda h: F.shiftrightunsigned(h, 65 - bits.bit_length())
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), (place(h) % 64).cast("int"))
    rows = blocks.groupBy(F.shiftright(place(F.col("h")), 6).alias("at")).agg(F.bit_or(bit(F.col("h"))).alias("bits"))
    held = _array_of(rows, "at", "bits", bits // 64, F.lit(0).cast("long"))
    return held, lambda s, h: F.get(s, F.shiftright(place(h), 6).cast("int")).bitwiseAND(bit(h)) != 0


def _maybe(grams: DataFrame, sizes: list[int], made) -> tuple[dict[str, Column], Column]:
    """The sets by the names of their columns, and whether one of a document's aligned blocks is one of the benchmark's.
    made: _block_set or _block_map."""
    sets, out = {}, F.lit(False)
    for b in sorted({_block(s) for s in sizes}):
        blocks = written(_blocks_of(grams, b), "benchmark-blocks")
        sets[f"_dc_s{b}"], test = made(blocks, blocks.count())
        out = out | F.coalesce(let(F.col(f"_dc_s{b}"), partial(_any_block, b, test)), F.lit(False))
    return sets, out


def _any_block(b: int, test, held: Column) -> Column:
    return F.exists(_hashes(F.col("_dc_w"), b, b), lambda h: test(held, h))


def _looked_up(docs: DataFrame, sets: dict[str, Column], name: str, value: Column) -> DataFrame:
    """docs with value, which uses each of sets once, so that the optimizer puts the sets into it and no row holds one."""
    return docs.select("*", *(v.alias(k) for k, v in sets.items())).select(*docs.columns, value.alias(name))


def _found_by_set(docs: DataFrame, grams: DataFrame, sizes: list[int], n: int) -> DataFrame:
    m = max(1, n // 2)
    own = grams.groupBy(F.pmod(F.xxhash64("gram"), F.lit(m)).alias("at")).agg(F.collect_list(F.struct("gram", "set_no")).alias("own"))
    sets, maybe = _maybe(grams, sizes, _block_set)
    sets["_dc_set"] = _array_of(own, "at", "own", m, F.array().cast("array<struct<gram:string,set_no:long>>"))
    windows = F.concat(*(_windows(F.col("_dc_w"), s) for s in sizes))
    hit = lambda s, x: F.transform(F.filter(F.get(s, F.pmod(F.xxhash64(x["gram"]), F.lit(m)).cast("int")), lambda e: e["gram"] == x["gram"]), lambda e: F.struct(x["start"].alias("start"), x["size"].alias("size"), e["set_no"].alias("set_no")))
    found = let(F.col("_dc_set"), lambda s: F.flatten(F.transform(windows, lambda x: hit(s, x))))
    return _looked_up(docs, sets, "_dc_found", F.coalesce(F.when(maybe, found), F.array().cast(FOUND)))


def _found_by_join(docs: DataFrame, grams: DataFrame, sizes: list[int]) -> DataFrame:
    """Equal rows (same id and words) have equal hits, so one stands for all of them."""
    sets, maybe = _maybe(grams, sizes, _block_map)
    tested = once(_looked_up(docs, sets, "_dc_maybe", maybe), "_dc_maybe")
    some = tested.filter("_dc_maybe").withColumn("_dc_key", F.sha2(F.concat_ws(" ", F.col("doc_id").cast("string"), F.array_join("_dc_w", " ")), 256))
    held, test = _block_map(grams.select(F.xxhash64("gram").alias("h")), grams.count())
    windows = F.concat(*(_windows(F.col("_dc_w"), s) for s in sizes))
    likely = let(F.col("_dc_held"), lambda s: F.filter(windows, lambda x: test(s, F.xxhash64(x["gram"]))))
    rows = _looked_up(some.select("_dc_key", "_dc_w").dropDuplicates(["_dc_key"]), {"_dc_held": held}, "_dc_x", likely)
    rows = written(rows.select("_dc_key", F.explode("_dc_x").alias("x")).select("_dc_key", "x.*"), "benchmark-likely")
    hits = with_key(rows, grams.select("gram", "set_no"), "gram", rows.groupBy("gram").agg(F.count("*").alias("n"))).filter("set_no is not null")
    hits = written(hits.groupBy("_dc_key").agg(F.collect_list(F.struct("start", "size", "set_no")).alias("_dc_found")), "benchmark-hits")
    met = with_key(some, hits, "_dc_key", some.groupBy("_dc_key").agg(F.count("*").alias("n"))).withColumn("_dc_found", F.coalesce("_dc_found", F.array().cast(FOUND))).drop("_dc_key")
    return tested.filter("NOT _dc_maybe").withColumn("_dc_found", F.array().cast(FOUND)).unionByName(met).drop("_dc_maybe")


def scan(docs: DataFrame, benchmark: DataFrame, n: int = N, set_limit: int = SET_LIMIT) -> DataFrame:
    """docs with `_dc_w` (its words), `_dc_found` (windows of the benchmark: start, size, number of the items that hold it) and
    `_dc_hit` added.

    start counts words from 0; _dc_hit is the number of words inside found windows.
    """
    return _scan(docs, benchmark, n, set_limit)[0]


def _scan(docs: DataFrame, benchmark: DataFrame, n: int, set_limit: int) -> tuple[DataFrame, DataFrame, bool]:
    """scan(), the items by number, and whether the benchmark is small enough to be held as a set."""
    windows = written(benchmark_windows(benchmark, n), "benchmark-windows")
    sets = written(item_sets(windows), "benchmark-items")
    grams = written(windows.withColumn("items", F.array_sort("items")).join(sets, "items").select("gram", "size", "set_no"), "benchmark-numbered")
    total, sizes = grams.agg(F.count("*"), F.array_sort(F.collect_set("size"))).first()
    docs = once(docs.withColumn("_dc_w", words(F.col("text"))), "_dc_w")
    if not total:
        docs = docs.withColumn("_dc_found", F.array().cast(FOUND))
    elif total <= set_limit:
        docs = _found_by_set(docs, grams, sizes, total)
    else:
        docs = _found_by_join(docs, grams, sizes)
    covered = F.aggregate(
        F.array_sort(F.transform("_dc_found", lambda x: F.struct(x["start"].alias("start"), x["size"].alias("size")))),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda a, x: F.struct((a.n + F.greatest(F.lit(0), x["start"] + x["size"] - F.greatest(a.to, x["start"]))).alias("n"), F.greatest(a.to, x["start"] + x["size"]).alias("to")),
        lambda a: a.n,
    )
    return docs.withColumn("_dc_hit", F.when(F.size("_dc_found") > 0, covered).otherwise(0).cast("long")), sets, total <= set_limit


def _drop(df: DataFrame) -> DataFrame:
    return df.drop(*(c for c in df.columns if c.startswith("_dc_")))


def report(docs: DataFrame, benchmark: DataFrame, n: int = N, **limits) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items (sorted strings), contaminated."""
    found, sets, small = _scan(docs.select("doc_id", "text"), benchmark, n, **{"set_limit": SET_LIMIT} | limits)
    found = once(found.withColumn("_dc_n", F.size("_dc_w").cast("long")).withColumn("_dc_lists", F.array_distinct("_dc_found.set_no")), "_dc_lists", "_dc_hit", "_dc_n")
    found = found.select("doc_id", "_dc_n", "_dc_hit", "_dc_lists")
    if small:
        m = max(1, sets.count() // 2)
        buckets = sets.groupBy(F.pmod(F.xxhash64("set_no"), F.lit(m)).alias("at")).agg(F.collect_list(F.struct("set_no", "items")).alias("own"))
        held = _array_of(buckets, "at", "own", m, F.array().cast("array<struct<set_no:long,items:array<string>>>"))
        of = lambda s, k: F.flatten(F.transform(F.filter(F.get(s, F.pmod(F.xxhash64(k), F.lit(m)).cast("int")), lambda e: e["set_no"] == k), lambda e: e["items"]))
        listed = let(F.col("_dc_held"), lambda s: F.flatten(F.transform("_dc_lists", lambda k: of(s, k))))
        found = _looked_up(found, {"_dc_held": held}, "_dc_items", F.when(F.size("_dc_lists") > 0, listed).otherwise(F.array().cast("array<string>")))
    else:
        found = _items_by_join(found, sets)
    items = F.array_sort(F.array_distinct("_dc_items"))
    return found.select("doc_id", F.col("_dc_n").alias("n_words"), F.col("_dc_hit").alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"), (F.col("_dc_hit") > 0).alias("contaminated"))


def _items_by_join(found: DataFrame, sets: DataFrame) -> DataFrame:
    """`_dc_lists` (numbers) -> `_dc_items`, for more numbers than are held as a set. Documents with the same numbers share one
    look-up."""
    some = found.filter(F.size("_dc_lists") > 0).withColumn("_dc_key", F.sha2(F.array_join(F.transform(F.array_sort("_dc_lists"), lambda k: k.cast("string")), ","), 256))
    each = some.select("_dc_key", "_dc_lists").dropDuplicates(["_dc_key"]).select("_dc_key", F.explode("_dc_lists").alias("set_no"))
    met = with_key(each, sets, "set_no", each.groupBy("set_no").agg(F.count("*").alias("n")))
    lists = met.groupBy("_dc_key").agg(F.flatten(F.collect_list("items")).alias("_dc_items"))
    out = with_key(some, lists, "_dc_key", some.groupBy("_dc_key").agg(F.count("*").alias("n"))).drop("_dc_key")
    return found.filter(F.size("_dc_lists") == 0).withColumn("_dc_items", F.array().cast("array<string>")).unionByName(out)


def remove(docs: DataFrame, benchmark: DataFrame, what: str = "documents", n: int = N, **limits) -> DataFrame:
    """docs without contaminated documents, or with what="spans" without the words (and the separators before each) that
    lie in a window; clean documents stay as they are, and n_chars, where there is one, follows the text."""
    found = once(scan(docs, benchmark, n, **limits), "_dc_found", "_dc_hit")
    if what == "documents":
        return _drop(found.filter(F.col("_dc_hit") == 0))
    if what != "spans":
        raise ValueError(f"what: documents or spans, not {what}")
    piece = F.regexp_extract_all("text", F.lit(f"([{SEPARATOR_ANY_CASE}]*[^{SEPARATOR_ANY_CASE}]+)"))
    tail = F.regexp_extract("text", f"[{SEPARATOR_ANY_CASE}]*$", 0)
    out = lambda p, i: ~F.exists("_dc_found", lambda x: (i >= x.start) & (i < x.start + x.size))
    found = found.withColumn("text", F.when(F.col("_dc_hit") > 0, F.concat(F.array_join(F.filter(piece, out), ""), tail)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(F.col("_dc_hit") > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return _drop(found)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", hex_digest(F.array_join("items", ",")).alias("items_sha256"), "contaminated")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(len(w), {N}) AS size, array_to_string(w[i:i + least(len(w), {N}) - 1], ' ') AS gram
      FROM b, LATERAL (SELECT unnest(range(1, len(w) - least(len(w), {N}) + 2)) AS i) WHERE len(w) > 0),
s AS (SELECT DISTINCT size FROM g),
h AS (SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS gram
      FROM d, s, LATERAL (SELECT unnest(range(1, len(w) - size + 2)) AS i) WHERE len(w) >= size),
f AS (SELECT h.doc_id, h.i, h.size, g.item_id FROM h JOIN g ON h.gram = g.gram AND h.size = g.size),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM f) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM f) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""
