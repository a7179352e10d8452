"""Merkle manifests against plain Python: ties, nulls, lone leaves, extra columns, a hot source."""

import hashlib
import zlib

import pytest
from against_sql import assert_same, sql_rows

from speechtable.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, subroot string, path string, idx long, grp long"
ROWS = [(i, f"line {i}\n" * (i % 4), "en", f"s{i % 2}", i) for i in range(40)]
ROWS += [(100 + i, "é😀\n" if i else None, None, None, None) for i in range(5)] + [(7, "alone", "de", "Z", 5), (8, "", "", "", 0)]
ROWS += [(3, "twice", "en", "s1", 5), (3, "twice", "en", "s1", 5), (3, "another", "en", "s1", 7), (None, "no id\n", "en", "s1", 6), (None, None, None, "only", None)]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r):
    i, text, lang, source, n = r
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))


def tree(nodes):
    """Top, and each node's siblings as (left, right) by level."""
    paths, own = [[] for _ in nodes], [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        for a in range(0, len(nodes), 3):
            run = nodes[a : a + 3]
            for k, members in enumerate(own[a : a + 3]):
                for m in members:
                    paths[m].append(("".join(run[:k]), "".join(run[k + 1 :])))
        own = [sum(own[a : a + 3], []) for a in range(0, len(own), 3)]
        nodes = [h(*nodes[a : a + 3]) for a in range(0, len(nodes), 3)]
    return nodes[0], paths


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    tops, inner = [], {}
    for s in order:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        top, paths = tree([leaf(r) for r in groups[s]])
        tops.append(top)
        inner[s] = paths
    root, outer = tree(tops)
    out = []
    for s, top, more in zip(order, tops, outer):
        for r, path in zip(groups[s], inner[s]):
            path = path + more
            text = r[1]
            if text and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            at = leaf((r[0], text, *r[2:]))
            for lo, hi in path:
                at = h(lo, at, hi)
            out.append((r[0], leaf(r), top, root, h(*(lo + hi for lo, hi in path)), at, at == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("rows", [ROWS, ROWS[:1], ROWS[-2:], [(i, str(i), "en", "hot", 1) for i in range(100)]], ids=["all", "one", "two", "hot"])
def test_against_plain_python(spark, tmp_path, rows):
    spark.createDataFrame([(*r, "mine", "mine", 1, 1) for r in rows], SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = merkle.query(spark, str(tmp_path))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)
    assert_same(got.toPandas(), sql_rows(str(tmp_path), merkle.SQL))


def test_tampering_shows(spark, sf_dir):
    got = {r.doc_id: r.verified for r in merkle.query(spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
        changed = zlib.crc32(str(r.doc_id).encode()) % 2 == 0 and "\n" in (r.text or "")
        assert got[r.doc_id] != changed


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert merkle.query(spark, str(tmp_path)).count() == 0
