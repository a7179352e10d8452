"""Mixing sources to target weights by hash-threshold histograms.

A document's size is its number of words (runs of anything but ASCII white space). Sources, in code point order with null
last, weigh `weights` in turn and share `share` of all words; no target exceeds `most` times its source, and what is cut
off goes to the others by weight until none is above. A source whose target is k whole copies and a rest gets k copies of
each document and one more of the documents whose hash lies below a threshold.

The threshold is found without sorting documents: words are summed by source and the first `BITS` bits of the hash, the
bucket where the running sum passes the rest is refined by the next bits, and so on until it holds one hash. Each step
sends at most 2**BITS sums a source and task, whatever the size of the source; a hot source is summed where its rows lie.
Documents with that last hash are taken if this brings the source nearer to its target.

Sources are ranked in one task, as their weights follow their order: the number of sources, not of documents, is its bound.

Cases: null text has size 0 and takes nothing; the words of very long texts are counted where they lie; a null doc_id hashes as ""; repeated ids are taken or left together; an
empty table gives no rows; columns whose names begin with `_mix_` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

WEIGHTS = (1.0, 2.0, 3.0)
MOST = 3
BITS, LEVELS = 12, 5


def size(text: Column) -> Column:
    """Words, without making them: the length of the text once each is a single character and the rest is gone."""
    return F.char_length(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "x"), r"[\x20\x09-\x0D]+", "")).cast("long")


def place(doc_id: Column) -> Column:
    """A document's place in 0 .. 2**60: the first 15 hex digits of the MD5 of its id."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.0, most: int = MOST) -> DataFrame:
    """sizes (source, source_size; a row a source) with target added.

    A source is held at its limit if the rate (words a unit of weight) is above most*size/weight; in the order of that
    ratio those held come first, so the rate is that of the first source that fits when all before it are held.
    """
    ranked = sizes.withColumn("_mix_w", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1) % len(weights) + 1))
    by_limit = Window.orderBy(most * F.col("source_size") / F.col("_mix_w"), F.col("source").isNull(), "source")
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy()
    held = ranked.withColumns({
        "_mix_held": most * F.coalesce(F.sum("source_size").over(before), F.lit(0)),
        "_mix_left": F.sum("_mix_w").over(all_) - F.coalesce(F.sum("_mix_w").over(before), F.lit(0.0)),
        "_mix_all": F.sum("source_size").over(all_),
    })
    rate = (share * F.col("_mix_all") - F.col("_mix_held")) / F.col("_mix_left")
    held = held.withColumn("_mix_rate", F.when(rate * F.col("_mix_w") <= most * F.col("source_size"), rate)).withColumn("_mix_rate", F.max("_mix_rate").over(all_))
    fits = F.col("_mix_rate") * F.col("_mix_w") <= most * F.col("source_size")
    return held.select("source", "source_size", F.when(fits, F.col("_mix_rate") * F.col("_mix_w")).otherwise(most * F.col("source_size")).cast("double").alias("target"))


def thresholds(docs: DataFrame, weights=WEIGHTS, share: float = 1.0, most: int = MOST) -> DataFrame:
    """docs (doc_id, source, size) -> a row a source: source, source_size, target, copies, below, also.

    Each document of the source is taken `copies` times, and once more if its place is less than `below`, or equal to it
    where `also` holds.
    """
    docs = written(docs.select("source", F.col("size"), place(F.col("doc_id")).alias("h")), "mixing")
    sources = targets(docs.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = written(sources.withColumn("copies", copies).withColumns({"need": F.col("target") - F.col("copies") * F.col("source_size"), "at": F.lit(0).cast("long"), "before": F.lit(0).cast("long"), "held": F.lit(0).cast("long")}), "mixing")
    for level in range(1, LEVELS + 1):
        left = BITS * (LEVELS - level)
        own = docs.join(state.filter("need > 0").select(F.col("source").alias("s"), "at", "before", "need"), F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("h", left + BITS) == F.col("at")))
        sums = own.groupBy("source", "before", "need", F.shiftright("h", left).alias("bucket")).agg(F.sum("size").alias("n"), (F.min("h") == F.max("h")).alias("one"))
        running = sums.withColumn("to", F.col("before") + F.sum("n").over(Window.partitionBy("source").orderBy("bucket")))
        last = running.filter("to >= need").groupBy("source").agg(F.min_by(F.struct("bucket", (F.col("to") - F.col("n")).alias("b"), "n", "one"), "bucket").alias("x"))
        last = last.select(F.col("source").alias("s"), F.col("x.bucket").alias("bucket"), F.col("x.b").alias("b"), F.col("x.n").alias("n"), F.col("x.one").alias("one"))
        # a source without such a bucket needs all it has or nothing: its place lies at one end
        state = written(
            state.join(last, F.col("source").eqNullSafe(F.col("s")), "left").select(
                "source", "source_size", "target", "copies", "need",
                F.coalesce("bucket", F.when(F.col("need") > 0, F.lit(1 << (BITS * level))).otherwise(0)).cast("long").alias("at"),
                F.coalesce("b", "before").alias("before"), F.coalesce("n", F.lit(0).cast("long")).alias("held"),
            ), "mixing")
    return state.select("source", "source_size", "target", "copies", F.col("at").alias("below"), (2 * F.col("before") + F.col("held") < 2 * F.col("need")).alias("also"))


def take(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """docs (with source, size, doc_id) with source_size, target and taken (words, repeats counted) added.

    The plan has a row a source, and Spark broadcasts it only below its own size limit.
    """
    h = place(F.col("doc_id"))
    plan = plan.withColumnRenamed("source", "_mix_source")
    once = (h < F.col("below")) | ((h == F.col("below")) & F.col("also"))
    return docs.drop("source_size", "target", "taken").join(plan, F.col("source").eqNullSafe(F.col("_mix_source")), "left").withColumn("taken", F.col("size") * (F.col("copies") + once.cast("long"))).drop("_mix_source", "copies", "below", "also")


def mix(docs: DataFrame, **how) -> DataFrame:
    """Every document with size, source_size, target and taken; one that isn't taken has 0."""
    sized = docs.drop("size").withColumn("size", size(F.col("text")))
    return take(sized, thresholds(sized.select("doc_id", "source", "size"), **how))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = written(table(spark, sf_dir, "documents").select("doc_id", "source", size(F.col("text")).alias("size")), "mixing-sizes")
    return take(sized, thresholds(sized)).select("doc_id", "size", "source_size", "target", "taken")


SQL = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::DOUBLE AS w FROM s),
r AS (SELECT *, 3 * coalesce(sum(n) OVER (ORDER BY 3 * n / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
             sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY 3 * n / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
             sum(n) OVER () AS total FROM w),
q AS (SELECT source, n, w, max(CASE WHEN (total::DOUBLE - held::DOUBLE) / rest * w <= 3 * n THEN (total::DOUBLE - held::DOUBLE) / rest END) OVER () AS rate FROM r),
t AS (SELECT source, n AS source_size, CASE WHEN rate * w <= 3 * n THEN rate * w ELSE (3 * n)::DOUBLE END AS target FROM q),
c AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS copies FROM t),
x AS (SELECT d.doc_id, d.size, c.source_size, c.target, c.copies, c.target - c.copies * c.source_size AS need,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY h) AS upto, sum(d.size) OVER (PARTITION BY d.source, h) AS own
      FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source)
SELECT doc_id, size, source_size, target,
       (size * (copies + CASE WHEN need > 0 AND (upto < need OR (upto - own < need AND 2 * (upto - own) + own < 2 * need)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM x
"""
