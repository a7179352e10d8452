"""URL filters: what the trees learn for urls that no rule decides, the parts against SQL, and the bound of the sample."""

import random

import duckdb
import numpy as np
from against_sql import assert_same
from pyspark.sql import functions as F

from speechtable.llm import urls


def made(n, seed):
    """Labelled urls: those of link farms are long, with digits, hyphens and many parameters; hosts differ each time."""
    rng = random.Random(seed)
    word = lambda a, b: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(a, b)))
    out = []
    for i in range(n):
        bad = rng.random() < 0.35
        if bad:
            host = "-".join(word(3, 8) for _ in range(rng.randint(2, 4))) + str(rng.randint(1, 9999)) + "." + rng.choice(["com", "net", "biz"])
            url = f"http://{host}/{word(2, 5)}/{rng.randint(10**6, 10**9)}?" + "&".join(f"{word(1, 3)}={rng.randint(1, 10**5)}" for _ in range(rng.randint(2, 6)))
        else:
            host = rng.choice(["www.", "", "m."]) + word(4, 10) + "." + rng.choice(["com", "net", "org"])
            url = f"https://{host}/" + "/".join(word(3, 9) for _ in range(rng.randint(1, 3))) + rng.choice(["", "?page=2", "#top", ".html", f"/{rng.randint(1, 99)}"])
        out.append((i, url, int(bad)))
    return out


def frame(spark, rows):
    return urls.split(spark.createDataFrame(rows, "page_id long, url string, blocked int"))


def test_trees_decide_urls_of_unseen_hosts(spark):
    model = urls.fit(frame(spark, made(3000, 1)))
    rows = made(1500, 2)
    judged = urls.judge(spark.createDataFrame(rows, "page_id long, url string, blocked int"), rules=(), model=model).toPandas()
    said, true = (judged.verdict == "block").to_numpy(), judged.blocked.to_numpy() == 1
    assert judged.rule.isna().all()
    recall, precision = (said & true).sum() / true.sum(), (said & true).sum() / said.sum()
    assert recall >= 0.95 and precision >= 0.95, (recall, precision)


def test_rules_spread_to_urls_that_they_do_not_decide(spark, sf_dir):
    got = urls.query(spark, sf_dir.replace("0.001", "0.1")).toPandas()
    model = got[got.rule.isna()]
    assert set(model.verdict) == {"allow", "block"}
    assert ((model.block_score >= 0.5) == (model.verdict == "block")).all()


def test_verdicts_of_the_rules_on_hosts_left_out(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir.replace('0.001', '0.1')}/pages.parquet").select("page_id", "url")
    full = urls.with_rules(urls.split(pages)).select("url", "host", "path", (F.col("rule_verdict") == "block").cast("int").alias("blocked")).filter("blocked is not null")
    said = []
    for k in range(5):
        mine = F.pmod(F.xxhash64(F.lit("left out"), F.col("host")), F.lit(5)) == k
        said.append(urls.fit(full.filter(~mine)).score(full.filter(mine)).select("blocked", (F.col("block_score") >= 0.5).alias("said")).toPandas())
    rate = {b: sum(x.said[x.blocked == b].sum() for x in said) / sum((x.blocked == b).sum() for x in said) for b in (0, 1)}
    assert rate[1] >= 0.7 and rate[0] <= 0.02, rate


def test_sample_is_bounded_and_weighted(spark, monkeypatch):
    rows = made(4000, 3)
    rows += [(i, "http://hot-1.biz/a/1?b=2&c=3", 1) for i in range(4000, 6000)]  # a third of all rows is one url
    seen = []
    monkeypatch.setattr(urls, "_boost", lambda x, y, w: seen.append((x, w)) or (0.0, []))
    urls.fit(frame(spark, rows), sample=600)
    urls.fit(frame(spark, rows[::-1]).repartition(7), sample=600)
    x, w = seen[0]
    assert 250 < len(x) < 600 and np.array_equal(x, seen[1][0]) and np.array_equal(w, seen[1][1])
    assert set(w) <= {1.0, 2000.0}
    urls.fit(frame(spark, rows))
    assert seen[2][1].sum() == 6000


def test_parts_and_rules_against_sql(spark, sf_dir):
    fits = lambda r, v: f"WHEN (host = '{r.partition('/')[0]}' OR host LIKE '%.{r.partition('/')[0]}') AND starts_with(path, '/{r.partition('/')[2]}') THEN '{v}'"
    ordered = sorted(urls.RULES, key=lambda r: -len(r[0]))
    sql = f"""WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM '{sf_dir}/pages.parquet')
        SELECT *, CASE {' '.join(fits(r, r) for r, _ in ordered)} END AS rule, CASE {' '.join(fits(r, v) for r, v in ordered)} END AS by_rule FROM p"""
    got = urls.query(spark, sf_dir).withColumn("by_rule", F.when(F.col("rule").isNotNull(), F.col("verdict"))).select("page_id", "host", "path", "rule", "by_rule")
    assert_same(got.toPandas(), duckdb.sql(sql).df())


def test_many_rules_with_repeated_and_clashing_rows(spark):
    many = [*urls.RULES, *((f"h{i}.net/", "block") for i in range(300))]
    rows = [(1, "http://a.h7.net/x", "mine"), (1, "http://a.h7.net/x", "mine"), (2, None, "mine"), (2, "", "mine"), (3, "http://h7.net", "mine")]
    df = spark.createDataFrame(rows, "page_id long, url string, rule string")
    got = urls.with_rules(urls.split(df), many)
    assert sorted((r.page_id, r.rule or "", r.rule_verdict or "") for r in got.collect()) == [(1, "h7.net/", "block"), (1, "h7.net/", "block"), (2, "", ""), (2, "", ""), (3, "", "")]


def test_long_urls(spark):
    long = "http://a.org/" + "x/" * 200_000 + "?" + "a=1&" * 100_000
    df = spark.createDataFrame([(1, long), (2, None)], "page_id long, url string")
    got = {r.page_id: r for r in urls.judge(df).collect()}
    assert got[1].rule == "org/" and len(got[1].path) == 400_001 and got[2].path == ""
