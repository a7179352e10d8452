"""Connected components of a table of links, in rounds of large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import with_key, written


def connected(links: DataFrame) -> DataFrame:
    """links (a, b; longs) -> v, root: each linked vertex and the smallest vertex of its component.

    A large star joins each vertex's larger neighbours to its smallest, a small star its smaller ones; rounds end when
    neither changes a link (about log n rounds). Minima are summed before the shuffle, so a hub's neighbours are never
    gathered, and a hub's links aren't moved to meet its minimum.
    """
    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    state = _state(edges)
    while state[0]:
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")), "links-least")
        large = with_key(both, least.drop("n"), "u", least.select("u", "n")).filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.toDF("a", "b"))
        edges = written(small.filter("a <> b").distinct(), "links")
        before, state = state, _state(edges)
        if state == before:
            break
    roots = edges.toDF("v", "root")
    return roots.union(roots.select(F.col("root").alias("v"), "root")).distinct()


def _state(edges: DataFrame) -> tuple:
    """Number and checksum of the links, to tell a round that changed none."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.hash("a", "b").cast("long"))).first())
