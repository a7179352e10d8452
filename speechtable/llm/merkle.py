"""Merkle manifest of a dataset: a digest for each row, each source and the whole, and each row's proof that it belongs.

H is sha256 in lowercase hex of its inputs joined; digests go in as hex text. A leaf is H of the row's fields, each `-` if null,
else the number of its UTF-8 bytes, `:` and the value. In a source leaves ascend by doc_id; every three neighbours become
their H (the last run may be shorter, even one) until one node, the subroot, is left. The subroots, ordered by source,
are leaves of one more tree of the same kind, whose top is the root.

1. Places. Leaves are dealt out by ranges of (source, doc_id, leaf) and sorted there, so a source that holds most rows lies
   in many partitions. A table of one row for each source and partition (`_runs`) turns places in a partition into places
   in the source: nothing is numbered in one task.
2. Slot pivot. At each level conditional aggregates put each parent's children into FANOUT columns; their concatenation
   hashes to the parent. Neighbours lie in one partition, so most of the pivot happens before its shuffle, and the levels
   above the first hold half as many rows as there are leaves, all together.
3. Proofs. From the top down, each pivoted row hands its children the list of siblings: the concatenation without the own
   slot's column, kept as what stands left and right of it. A level is joined with the one below on (group, parent),
   of which no key has more than one row. Leaves travel inside their parent's row, so the longest lists are never joined.

Each level is written once to the shared folder. Inside, digests are 32 bytes.

Cases: a null doc_id is the least, equal doc_ids ascend by leaf, and repeated rows are leaves of their own (equal ones take
neighbouring places, in no order that shows); a null source is a source of its own and the first; a null or empty text is a
field like any other, very long texts are hashed where they lie; an empty table gives no rows and no root; a lone leaf is its
subroot, a lone subroot the root; other columns aren't read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

FANOUT = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_POSITION = (1 << 33) - 1
PATH = "array<struct<left:binary,right:binary>>"


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _hash(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def leaf(*values: Column) -> Column:
    """The digest (32 bytes) of a row's fields."""
    field = lambda s: F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))
    return _hash(F.concat(*(field(v.cast("string")) for v in values)))


def _places(nodes: DataFrame, group: str, order: list[str]) -> DataFrame:
    """nodes with grp (a number for each group, ascending as they do), idx (the node's place in it) and n (its nodes)."""
    keys = [group, *order, "_tie"]
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = nodes.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("_tie")
    # partition and position: what the function gives out holds both
    placed = written(dealt.withColumn("_at", F.monotonically_increasing_id()), "merkle-places").withColumn("_part", F.shiftrightunsigned("_at", 33))
    each = Window.partitionBy(group)
    before = each.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = placed.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    runs = runs.select(
        F.col(group).alias("_group"), F.col("_part").alias("_in"), F.min("_first").over(each).alias("grp"), F.sum("_n").over(each).alias("n"),
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first").bitwiseAND(_POSITION)).alias("_offset"),
    )
    met = placed.join(runs, placed[group].eqNullSafe(runs["_group"]) & (placed["_part"] == runs["_in"]))
    return met.withColumn("idx", F.col("_at").bitwiseAND(_POSITION) + F.col("_offset")).drop("_at", "_part", "_in", "_group", "_offset")


def _pivots(nodes: DataFrame, payload: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """nodes (grp, idx, n, digest, payload) -> for each level the parents (grp, idx, n children in the group, c0, c1, c2; at
    the first level a child is a struct of its digest and payload), and the tops (grp, digest, height)."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    levels: list[DataFrame] = []
    tops = [nodes.filter("n = 1").select("grp", "digest", F.lit(0).alias("height"))]
    child, own = F.struct("digest", *payload), lambda c: F.col(c)["digest"]
    while most > 1:
        slot = lambda k: F.max(F.when(F.col("idx") % FANOUT == k, child)).alias(f"c{k}")  # noqa: E731, B023
        pivot = nodes.filter("n > 1").groupBy("grp", F.expr(f"idx div {FANOUT}").alias("idx")).agg(F.max("n").alias("n"), *map(slot, range(FANOUT)))
        levels.append(written(pivot, f"merkle-level{len(levels)}"))
        digest = _hash(F.concat(*(F.coalesce(_hex(own(f"c{k}")), F.lit("")) for k in range(FANOUT))))
        nodes = levels[-1].select("grp", "idx", F.expr(f"(n + {FANOUT - 1}) div {FANOUT}").alias("n"), digest.alias("digest"))
        tops.append(nodes.filter("n = 1").select("grp", "digest", F.lit(len(levels)).alias("height")))
        child, own = F.col("digest"), F.col
        most = -(-most // FANOUT)
    return levels, reduce(DataFrame.unionByName, tops)


def _children(met: DataFrame, own, carried: list[str]) -> DataFrame:
    """Pivoted rows with the path of their parent -> a row for each child, with its own siblings before that path."""
    nothing = F.lit(b"")
    digests = [F.coalesce(own(f"c{k}"), nothing) for k in range(FANOUT)]
    side = lambda cs: F.concat(*cs) if cs else nothing
    each = F.array(*(
        F.struct((F.col("idx") * FANOUT + k).alias("idx"), F.col(f"c{k}").alias("child"), side(digests[:k]).alias("left"), side(digests[k + 1 :]).alias("right"))
        for k in range(FANOUT)
    ))
    rows = met.select("grp", *carried, "path", F.explode(each).alias("_c")).filter("_c.child is not null")
    path = F.concat(F.array(F.struct("_c.left", "_c.right")), "path")
    return rows.select("grp", *carried, F.col("_c.idx").alias("idx"), F.col("_c.child").alias("child"), path.alias("path"))


def _paths(nodes: DataFrame, payload: list[str], levels: list[DataFrame], tops: DataFrame, carried: list[str]) -> DataFrame:
    """tops (grp, height, carried, path) -> grp, digest, payload, carried, path of every node of the lowest level."""
    known = None
    for h in range(len(levels), 0, -1):
        begun = tops.filter(F.col("height") == h).select("grp", F.lit(0).cast("long").alias("idx"), *carried, "path")
        known = begun if known is None else known.select("grp", "idx", *carried, "path").unionByName(begun)
        own = (lambda c: F.col(c)["digest"]) if h == 1 else F.col
        known = _children(levels[h - 1].drop("n").join(known, ["grp", "idx"]), own, carried)
    columns = ["grp", "digest", *payload, *carried, "path"]
    alone = nodes.filter("n = 1").join(tops.filter("height = 0").select("grp", *carried, "path"), "grp").select(*columns)
    return alone if known is None else known.select("grp", "child.*", *carried, "path").select(*columns).unionByName(alone)


def manifest(rows: DataFrame, group: str, order: str) -> DataFrame:
    """rows (group, order, digest and others) -> digest, subroot, root, path and the other columns.

    path: for each level up to the root, the sibling digests left and right of the own one.
    """
    payload = [c for c in rows.columns if c not in ("digest", group)]
    nodes = _places(rows, group, [order, "digest"]).select("grp", "idx", "n", "digest", *payload)
    levels, tops = _pivots(nodes, payload)
    tops = written(tops.withColumnsRenamed({"grp": "sub", "height": "tall"}), "merkle-subroots")
    above = _places(tops.withColumn("all", F.lit(0)), "all", ["sub"])
    upper, top = _pivots(above, ["sub", "tall"])
    top = top.select("grp", "height", F.col("digest").alias("root"), F.array().cast(PATH).alias("path"))
    subs = _paths(above, ["sub", "tall"], upper, top, ["root"])
    subs = written(subs.select(F.col("sub").alias("grp"), F.col("tall").alias("height"), F.col("digest").alias("subroot"), "root", "path"), "merkle-tops")
    return _paths(nodes, payload, levels, subs, ["subroot", "root"]).drop("grp")


def proof(path: Column) -> Column:
    """H of all siblings, as hex."""
    return F.sha2(F.array_join(F.transform(path, lambda x: _hex(F.concat(x["left"], x["right"]))), "").cast("binary"), 256)


def folded(digest: Column, path: Column) -> Column:
    """The root (32 bytes) that a leaf and its siblings give."""
    return F.aggregate(path, digest, lambda a, x: _hash(_hex(F.concat(x["left"], a, x["right"]))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    rows = docs.select("doc_id", "source", leaf(*map(F.col, FIELDS)).alias("digest"), leaf(*map(F.col, FIELDS[:-1]), tampered).alias("tampered"))
    made = manifest(written(rows, "merkle-leaves"), "source", "doc_id").withColumn("folded", folded(F.col("tampered"), F.col("path")))
    return made.select(
        "doc_id", _hex("digest").alias("leaf"), _hex("subroot").alias("subroot"), _hex("root").alias("root"), proof(F.col("path")).alias("proof_sha256"),
        _hex("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"),
    )


_LEAF = " || ".join("coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')".format(c) for c in FIELDS)
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, x: list_reduce(list_prepend(xor(a, x), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295)"
_UP = "SELECT lvl + 1, g, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), (any_value(n) + 2) // 3 FROM {0} WHERE n > 1 GROUP BY lvl, g, idx // 3"
SQL = f"""WITH RECURSIVE
d AS MATERIALIZED (SELECT *, CASE WHEN doc_id IS NOT NULL AND {_CRC} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS other FROM documents),
l AS MATERIALIZED (SELECT doc_id, source, sha256({_LEAF}) AS h, sha256({_LEAF.replace("text::", "other::")}) AS t FROM d),
k AS MATERIALIZED (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n FROM l),
u(lvl, g, idx, h, n) AS (SELECT 0::BIGINT, g, idx, h, n FROM k UNION ALL {_UP.format("u")}),
s AS MATERIALIZED (SELECT lvl AS height, g, h FROM u WHERE n = 1),
v(lvl, g, idx, h, n) AS (SELECT 0::BIGINT, 0::BIGINT, g, h, count(*) OVER () FROM s UNION ALL {_UP.format("v")}),
r AS (SELECT h AS root, lvl AS height FROM v WHERE n = 1),
a AS MATERIALIZED (SELECT lvl, g, idx, coalesce(string_agg(h, '') OVER (PARTITION BY lvl, g, idx // 3 ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lo,
  coalesce(string_agg(h, '') OVER (PARTITION BY lvl, g, idx // 3 ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS hi FROM (SELECT * FROM u WHERE n > 1)),
b AS MATERIALIZED (SELECT lvl, idx, coalesce(string_agg(h, '') OVER (PARTITION BY lvl, idx // 3 ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lo,
  coalesce(string_agg(h, '') OVER (PARTITION BY lvl, idx // 3 ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS hi FROM (SELECT * FROM v WHERE n > 1)),
steps(g, idx, lvl) AS (SELECT g, idx, 0::BIGINT FROM k UNION ALL SELECT steps.g, steps.idx, steps.lvl + 1 FROM steps JOIN s USING (g) WHERE steps.lvl < s.height),
p AS MATERIALIZED (SELECT x.g, x.idx, x.lvl, a.lo, a.hi FROM steps x JOIN a ON a.g = x.g AND a.lvl = x.lvl AND a.idx = x.idx // (3 ** x.lvl)::BIGINT),
q AS MATERIALIZED (SELECT x.g, b.lvl, b.lo, b.hi FROM s x JOIN b ON b.idx = x.g // (3 ** b.lvl)::BIGINT),
pp AS (SELECT g, idx, list({{'lo': lo, 'hi': hi}} ORDER BY lvl) AS path FROM p GROUP BY g, idx),
qq AS (SELECT g, list({{'lo': lo, 'hi': hi}} ORDER BY lvl) AS path FROM q GROUP BY g),
w AS (SELECT k.doc_id, k.h, k.t, s.h AS subroot, (SELECT root FROM r) AS root, list_concat(coalesce(pp.path, []), coalesce(qq.path, [])) AS path FROM k JOIN s USING (g) LEFT JOIN pp ON pp.g = k.g AND pp.idx = k.idx LEFT JOIN qq ON qq.g = k.g),
z AS (SELECT *, CASE WHEN len(path) = 0 THEN t ELSE list_reduce(list_prepend({{'lo': t, 'hi': ''}}, path), lambda y, x: {{'lo': sha256(x.lo || y.lo || x.hi), 'hi': ''}}).lo END AS folded FROM w)
SELECT doc_id, h AS leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda x: x.lo || x.hi), '')) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM z"""
