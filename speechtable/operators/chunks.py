"""Sessions cut into chunks, so that the order of one very long session is worked on by many tasks.

What an operator over an ordered session needs from before a chunk is small: the last n rows of a kind (the last voiced frame,
the last 30 levels), or a sum. Both are associative. Each chunk is summed up by itself; the summaries, one row a chunk, are
scanned in order of chunks; and each chunk then runs with what stands before it, as a session of its own. The frames are
shuffled by (session, chunk) and nothing is ordered by session alone but the summaries: a session of 10^8 frames has 1,526.

`in_chunks` runs any operator of this library that is partitioned by `session_id` and looks back at most at the last n rows of
some kinds; `running_total` is the sum over all rows before. The operators of `segments` and `acoustics` that order a session
have their chunked forms here, with the same rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import acoustics as A
from . import segments as G

SIZE = 65_536


def _chunk(order: str, size: int) -> Column:
    return F.expr(f"{order} div {int(size)}")


def _met(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join by keys in which null is like null."""
    own = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    met = left.join(own, reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys)), how)
    return met.drop(*(f"_right_{k}" for k in keys))


def _carried(df: DataFrame, keys: list[str], order: str, size: int, qualifies: Column, n: int) -> DataFrame:
    """keys, _chunk, _halo: for each chunk with rows, the last n qualifying rows before it (array of structs, in order)."""
    row = F.struct(*df.columns)
    own = Window.partitionBy(*keys, "_chunk").orderBy(F.col("_at").desc())
    # the limit is applied before the shuffle as well, so n rows a chunk and task travel
    tails = df.withColumn("_chunk", _chunk(order, size)).filter(qualifies).select(*keys, "_chunk", F.col(order).alias("_at"), row.alias("_row")).withColumn("_rn", F.row_number().over(own)).filter(F.col("_rn") <= n)
    each = tails.groupBy(*keys, "_chunk").agg(F.array_sort(F.collect_list(F.struct("_at", "_row"))).alias("_tail"))
    # a chunk with a tail has one row in it at least: the last n tails hold the last n rows
    along = Window.partitionBy(*keys).orderBy("_chunk")
    upto = F.flatten(F.collect_list("_tail").over(along.rowsBetween(-(n - 1), 0)))
    each = each.select(*keys, "_chunk", F.slice(upto, F.greatest(F.size(upto) - n, F.lit(0)) + 1, F.lit(n)).alias("_known"))
    chunks = df.select(*keys, _chunk(order, size).alias("_chunk")).distinct()
    chunks = _met(chunks, each, [*keys, "_chunk"], "left")
    before = F.last("_known", True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    return chunks.select(*keys, "_chunk", F.transform(before, lambda x: x["_row"]).alias("_halo")).filter(F.size("_halo") > 0)


def in_chunks(df: DataFrame, operator: Callable[[DataFrame], DataFrame], looks_back: list[tuple[Column, int]], keys: list[str] | None = None, order: str = "frame_idx", size: int = SIZE, keep: bool = False) -> DataFrame:
    """operator(df), run on each chunk of `size` in `order` with the rows it looks back at: for each (qualifies, n), the last n
    qualifying rows before the chunk. Keys (session_id first) are those by which the operator partitions; they and `order`
    must be in what it gives out, and each row it gives must belong to one of the rows it got. keep: session_id stays a struct
    of session and chunk, so that what follows needs no other shuffle.

    A null key is a key like any other; rows without a place in order are a chunk of their own, the first.
    """
    keys = keys or ["session_id"]
    halos = None
    for qualifies, n in looks_back:
        own = _carried(df, keys, order, size, qualifies, n)
        halos = own if halos is None else halos.unionByName(own)
    first = df.select(*keys, _chunk(order, size).alias("_chunk"), F.lit(False).alias("_is_halo"), F.struct(*df.columns).alias("_row"))
    # a row that two kinds look back at comes once
    before = halos.groupBy(*keys, "_chunk").agg(F.array_distinct(F.flatten(F.collect_list("_halo"))).alias("_halo"))
    rows = first.unionByName(before.select(*keys, "_chunk", F.lit(True).alias("_is_halo"), F.explode("_halo").alias("_row")))
    session = F.struct(F.col("session_id").alias("session"), F.col("_chunk").alias("chunk"))
    others = [F.col(f"_row.{c}").alias(c) for c in df.columns if c != "session_id"]
    made = operator(rows.select(session.alias("session_id"), *others, "_is_halo"))
    if keep:
        return made.filter(~F.col("_is_halo")).drop("_is_halo")
    out = [F.col("session_id.session").alias("session_id") if c == "session_id" else F.col(c) for c in made.columns if c != "_is_halo"]
    return made.filter(~F.col("_is_halo")).select(*out)


def running_total(df: DataFrame, value: Column, out: str, keys: list[str] | None = None, order: str = "frame_idx", size: int = SIZE) -> DataFrame:
    """df with the sum of value over all rows up to the current one; nulls add nothing."""
    keys = keys or ["session_id"]
    own = df.withColumn("_chunk", _chunk(order, size)).withColumn("_v", F.coalesce(value.cast("long"), F.lit(0)))
    sums = own.groupBy(*keys, "_chunk").agg(F.sum("_v").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.sum("_v").over(Window.partitionBy(*keys, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    met = _met(own.withColumn("_in", within), sums.select(*keys, "_chunk", before.alias("_base")), [*keys, "_chunk"])
    return met.withColumn(out, F.col("_in") + F.col("_base")).select(*df.columns, out)


def _since_start(vad: DataFrame, counted: Column, out: str, size: int) -> DataFrame:
    """vad_state with the number of counted frames from the start of the segment to the frame, the start included."""
    own = running_total(vad, counted, "_total", size=size)
    own = own.withColumn("_at_start", F.when(F.col("segment_started"), F.col("_total") - counted.cast("long")))
    so_far = Window.partitionBy("session_id").orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = lambda d: d.withColumn("_from", F.last("_at_start", True).over(so_far))
    return in_chunks(own, last, [(F.col("segment_started"), 1)], size=size).withColumn(out, F.col("_total") - F.col("_from")).drop("_total", "_at_start", "_from")


def vad_state(frames: DataFrame, min_silence: int = G.MIN_SILENCE, size: int = SIZE) -> DataFrame:
    """The rows of segments.vad_state. Segments are counted in each chunk, and a chunk's count goes on from those before it."""
    own = in_chunks(frames, lambda d: G.vad_state(d, min_silence), [(F.col("voiced"), 1)], size=size, keep=True).drop("segment_no")
    started = F.col("segment_started").cast("long")
    sums = own.groupBy("session_id").agg(F.sum(started).alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy("session_id.session").orderBy("session_id.chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.sum(started).over(Window.partitionBy("session_id").orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    met = _met(own.withColumn("_in", within), sums.select("session_id", before.alias("_base")), ["session_id"])
    rest = [c for c in own.columns if c != "session_id"]
    return met.select(F.col("session_id.session").alias("session_id"), *rest, (F.col("_in") + F.col("_base")).alias("segment_no"))


def speech_duration(vad: DataFrame, size: int = SIZE) -> DataFrame:
    """The rows of segments.speech_duration."""
    own = _since_start(vad, F.col("voiced"), "_voiced", size)
    return own.withColumn("speech_duration_s", F.when(F.col("is_speaking"), F.col("_voiced") * G.FRAME / float(G.RATE)).otherwise(0.0)).drop("_voiced")


def interim_checkpoints(vad: DataFrame, every_s: float = 1.2, size: int = SIZE) -> DataFrame:
    """The rows of segments.interim_checkpoints."""
    k = -(-int(every_s * G.RATE) // G.FRAME)
    own = _since_start(vad, F.col("is_speaking"), "collected", size)
    return own.filter(F.col("is_speaking") & (F.col("collected") % k == 0)).select("session_id", "segment_no", "frame_idx", "collected")


def live_features(live: DataFrame, size: int = SIZE, order: str = "frame_idx", **how) -> DataFrame:
    """The rows of acoustics.live_features: pitch direction against the last 12 pitches, level against the last 30."""
    kinds = [(F.col("pitch_hz").isNotNull() & ~F.isnan("pitch_hz"), 12), (F.col("voiced") & (F.col("level_dbfs") > -55), 30)]
    return in_chunks(live, lambda d: A.live_features(d, **how), kinds, order=order, size=size)


def rolling_baseline(df: DataFrame, value: str, out: str, keys: list[str], n: int = 20, qualifies: Column | None = None, order: str = "seq", size: int = SIZE, **how) -> DataFrame:
    """The rows of acoustics.rolling_baseline."""
    ok = (F.col(value).isNotNull() & ~F.isnan(value)) if qualifies is None else qualifies
    return in_chunks(df, lambda d: A.rolling_baseline(d, value, out, keys, n, qualifies=qualifies, order=order, **how), [(ok, n)], keys, order, size)
