"""Secret scans: recall a length and encoding, and the share of false discoveries."""

import random
import re
import string
import time

import pytest
from pyspark.sql import functions as F

from speechtable.llm import secrets

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PARTS = ["get", "user", "account", "value", "from", "table", "parse", "Config", "Index", "http", "MAX", "SIZE", "usr", "local", "share", "test", "2024", "v2", "item", "response", "Handler", "buffer", "north", "quick", "7", "31", "0x", "deadline", "cafe", "ABC"]
MIXED = string.ascii_letters + string.digits
ALPHABETS = {"alnum": MIXED, "base64": MIXED + "+/", "hex": "0123456789abcdef", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "decimal": "0123456789"}


def found(spark, tokens):
    df = spark.createDataFrame([(i, f"see {t} here", None, "s", 0) for i, t in enumerate(tokens)], DOCS)
    return {r.doc_id for r in secrets.scan(df).filter(F.exists("_sec_all", lambda x: x["kind"] == "random")).select("doc_id").collect()}


def test_recall_and_false_discoveries(spark):
    missed, made, false, all_found = {}, 0, 0, 0
    for seed in range(3):
        rng = random.Random(seed)
        ordinary = [rng.choice(["_", "/", "-", ""]).join(rng.choice(PARTS) for _ in range(rng.randint(6, 11))) for _ in range(8000)]
        ordinary = [t for t in ordinary if len(t) >= 20]
        keys = [(f"{name}{n}", "".join(rng.choice(a) for _ in range(n))) for name, a in ALPHABETS.items() for n in (20, 24, 32, 40, 64) for _ in range(8)]
        got = found(spark, [*(k for _, k in keys), *ordinary])
        for i, (kind, _) in enumerate(keys):
            missed[kind] = missed.get(kind, 0) + (i not in got)
        made += len(keys)
        all_found += len(got)
        false += sum(i >= len(keys) for i in got)
    assert sum(missed.values()) <= 0.1 * made, missed
    assert false <= secrets.Q * all_found, (false, all_found)


def test_nothing_is_found_among_ordinary_tokens_alone(spark):
    rng = random.Random(77)
    ordinary = [rng.choice(["_", "/", "-", ""]).join(rng.choice(PARTS) for _ in range(rng.randint(6, 11))) for _ in range(4000)]
    ordinary += ["".join(rng.choice("ab") for _ in range(40)) for _ in range(50)] + ["abcdefghijklmnopqrstuvwxyz" * 2, "0123456789" * 4, "A" * 30]
    assert len(found(spark, ordinary)) <= 4


def test_long_texts(spark):
    rng = random.Random(5)
    key = "".join(rng.choice(MIXED) for _ in range(40))
    long = "lorem ipsum dolor " * 60_000 + f" password: {key} " + "sit amet " * 10_000
    df = spark.createDataFrame([(1, long, None, "s", 0), (2, "x" * 300_000, None, "s", 0)], DOCS)
    got = {r.doc_id: r.spans for r in secrets.scan(df).select("doc_id", secrets.shown(F.col("_sec_all")).alias("spans")).collect()}
    at = long.index("password")
    assert f"assign:{at}:{at + 10 + len(key)}" in got[1] and got[2] == ""


def test_time_grows_with_the_number_of_matches(spark):
    def seconds(n):
        df = spark.createDataFrame([(1, "token=abcd1234 and " * n, None, "s", 0)], DOCS).cache()
        df.count()
        best = []
        for _ in range(2):
            began = time.time()
            spans = df.select(secrets.base_spans(F.col("text"), "assign").alias("x")).first()["x"]
            best.append(time.time() - began)
        assert [(x["start"], x["end"]) for x in spans[:: max(1, n // 7)]] == [(19 * k, 19 * k + 14) for k in range(0, n, max(1, n // 7))] and len(spans) == n
        began = time.time()
        text = secrets.redact(df).first()["text"]
        assert text == "[SECRET] and " * n
        return min(best), time.time() - began

    seconds(100)  # starts the session's threads
    (a, b), (c, d) = seconds(25_000), seconds(100_000)
    assert c < 6 * max(a, 0.2) and d < 6 * max(b, 1.0), (a, b, c, d)


@pytest.mark.parametrize("sizes", [[], [5], [0, 0, 3], list(range(300)), [1] * 1000])
def test_sums_before_each_length(spark, monkeypatch, sizes):
    for block in (2, 7, 128):
        monkeypatch.setattr(secrets, "BLOCK", block)
        got = spark.createDataFrame([(sizes,)], "v array<int>").select(secrets._before(F.col("v")).alias("x")).first()["x"]
        assert got == [sum(sizes[:i]) for i in range(len(sizes))]


def test_the_way_of_writing_is_that_of_all_documents(spark):
    texts = ["zq zq plain words", None, "", "see get_user_account_value_from_table here", "a b"]
    df = spark.createDataFrame([(i, t, None, "s", 0) for i, t in enumerate(texts)], DOCS)
    pairs = {}
    for t in texts:
        for run in re.findall(r"[A-Za-z0-9+/_-]{2,}", t or ""):
            for p in zip(run, run[1:]):
                pairs[p] = pairs.get(p, 0) + 1
    assert secrets.written_way(df) == pytest.approx(secrets.surprise(pairs))  # texts without a long token were left out
