"""URL filters: a list of rules, and gradient-boosted trees on lexical features for the urls that no rule fits.

A rule is a host, a path and a verdict, written host/path; it fits its host and all subdomains if the url's path starts
with the rule's, and the longest rule wins. A short list becomes one expression, a long one a join on the url's host
suffixes.

The trees learn from labelled urls; `query` takes as labels the verdicts of the rules, so that the model spreads what the
rules say to urls that they don't decide. Features are column expressions: length, depth, digit ratio, entropy of the
characters, number of parameters, host shape, and suffix statistics. These are the smoothed share of blocked labels among
urls whose host has the same ending, and among urls whose path begins with the same part, counted over all labelled urls in
`BUCKETS` hash buckets (so their size is fixed). Each is of the host or of the path alone: of both together it would only
say the rules again. In training, labels of a url's own fold (by hash of the url) don't count in its statistics, or the
trees would see the label itself.
Boosting runs in numpy on a sample of about `SAMPLE` labelled rows at most: those whose url has a hash below a threshold
that follows from the number of labels, each distinct url once with its number of rows as its weight. So what comes to the
driver doesn't grow with the table. The trees become nested conditions: scoring stays in the JVM and shuffles nothing.

Cases: a null url or one without `://` has empty host and path, fits no rule and is judged by the model like any other;
repeated rows and ids stand for themselves; without labels of both kinds the model allows all or blocks all, as they do;
without labels it allows all; an empty table gives no rows; other columns aren't read (`judge` keeps them, but for host,
path, rule, verdict and block_score, which it replaces). Whole urls are read, however long: each character is visited a
fixed number of times (entropy once for each distinct character).
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table

#: (rule, verdict); the path is what follows the first slash
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
INLINE_RULES = 256
SAMPLE, BUCKETS, FOLDS = 20_000, 1024, 5
TREES, DEPTH, RATE, BINS, SMOOTH = 30, 3, 0.3, 32, 5.0
_F = "_url_f_"  # before the features' names, so that no column of the user's is replaced
FEATURES = ("length", "depth", "digits", "entropy", "parameters", "labels", "hyphens", "path_length", "host_digits", "suffix", "section")


def host(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 2), F.lit(""))


def _fits(host: Column, path: Column, rule: str) -> Column:
    own, _, rest = rule.partition("/")
    return ((host == own) | host.endswith("." + own)) & path.startswith("/" + rest)


def with_rules(urls: DataFrame, rules=RULES) -> DataFrame:
    """urls (host, path) with rule and rule_verdict (null where none fits) added."""
    if len(rules) <= INLINE_RULES:
        ordered = sorted(rules, key=lambda r: -len(r[0]))
        pick = lambda k: F.coalesce(*(F.when(_fits(F.col("host"), F.col("path"), r[0]), F.lit(r[k])) for r in ordered)) if ordered else F.lit(None).cast("string")
        return urls.withColumns({"rule": pick(0), "rule_verdict": pick(1)})
    # every ending of the host, so that a url meets only rules on hosts above it; rows meet their rule by host and path
    listed = urls.sparkSession.createDataFrame([(r.partition("/")[0], "/" + r.partition("/")[2], r, v) for r, v in rules], "rule_host string, rule_path string, rule string, rule_verdict string")
    labels = F.split("host", r"\.")
    endings = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    own = urls.select("host", "path").distinct()
    met = own.select("host", "path", F.explode(endings).alias("rule_host")).join(listed, "rule_host").filter(F.col("path").startswith(F.col("rule_path")))
    best = met.groupBy("host", "path").agg(F.max_by(F.struct("rule", "rule_verdict"), F.struct(F.length("rule"), F.col("rule"))).alias("_url_best"))
    kept = [c for c in urls.columns if c not in ("rule", "rule_verdict")]
    return urls.select(*kept).join(best, ["host", "path"], "left").select(*kept, F.col("_url_best.rule").alias("rule"), F.col("_url_best.rule_verdict").alias("rule_verdict"))


def _suffix(host: Column) -> Column:
    """Hash bucket of the host's last label."""
    return F.pmod(F.xxhash64(F.element_at(F.split(host, r"\."), -1)), F.lit(BUCKETS)).cast("int")


def _section(path: Column) -> Column:
    """Hash bucket of the first part of the path."""
    return F.pmod(F.xxhash64(F.split(path, "/")[1]), F.lit(BUCKETS)).cast("int")


def lexical(urls: DataFrame) -> DataFrame:
    """urls (url, host, path) with the features that don't depend on labels, and the two hash buckets."""
    url = F.coalesce(F.col("url"), F.lit(""))
    n = F.greatest(F.char_length(url), F.lit(1)).cast("double")
    count = lambda text, what: F.char_length(F.regexp_replace(text, f"[^{what}]", "")).cast("double")
    chars = F.split(url, "")
    shares = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
    query_ = F.regexp_extract(url, r"\?([^#]*)", 1)
    return urls.withColumns({
        _F + "length": n,
        _F + "depth": F.size(F.filter(F.split("path", "/"), lambda p: p != "")).cast("double"),
        _F + "digits": count(url, "0-9") / n,
        _F + "entropy": F.aggregate(shares, F.lit(0.0), lambda a, p: a - p * F.log2(F.greatest(p, F.lit(1e-9)))),
        _F + "parameters": F.when(query_ == "", 0.0).otherwise(count(query_, "&") + 1.0),
        _F + "labels": F.size(F.split("host", r"\.")).cast("double"),
        _F + "hyphens": count(F.col("host"), "-"),
        _F + "path_length": F.char_length("path").cast("double"),
        _F + "host_digits": count(F.col("host"), "0-9"),
        "_url_suffix": _suffix(F.col("host")),
        "_url_section": F.coalesce(_section(F.col("path")), F.lit(0)),
    })


def _boost(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, list[dict]]:
    """Base score and trees for logistic loss; a tree is a leaf {"value"} or a split {"on", "below", "yes", "no"}."""
    p = float(np.clip(np.average(y, weights=w), 1e-3, 1 - 1e-3))
    base = float(np.log(p / (1 - p)))
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, k], "right") for k, c in enumerate(cuts)], 1)  # bin <= j: x < cuts[j]
    z = np.full(len(y), base)

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int) -> dict:
        gs, hs = g[rows].sum(), h[rows].sum()
        best = (1e-6, None, None)
        if depth and len(rows) > 20:
            for k, c in enumerate(cuts):
                n = len(c) + 1
                left_g = np.cumsum(np.bincount(binned[rows, k], g[rows], n))[:-1]
                left_h = np.cumsum(np.bincount(binned[rows, k], h[rows], n))[:-1]
                gain = left_g**2 / (left_h + 1) + (gs - left_g) ** 2 / (hs - left_h + 1) - gs**2 / (hs + 1)
                gain[(left_h < 0.5) | (hs - left_h < 0.5)] = 0
                if len(gain) and gain.max() > best[0]:
                    best = (gain.max(), k, int(gain.argmax()))
        if best[1] is None:
            value = float(-RATE * gs / (hs + 1))
            z[rows] += value
            return {"value": value}
        _, k, j = best
        yes = binned[rows, k] <= j
        return {"on": k, "below": float(cuts[k][j]), "yes": grow(rows[yes], g, h, depth - 1), "no": grow(rows[~yes], g, h, depth - 1)}

    trees = []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        trees.append(grow(np.arange(len(y)), w * (p - y), w * p * (1 - p), DEPTH))
    return base, trees


def _tree(node: dict, names: tuple[str, ...]) -> Column:
    if "value" in node:
        return F.lit(node["value"])
    return F.when(F.col(_F + names[node["on"]]) < node["below"], _tree(node["yes"], names)).otherwise(_tree(node["no"], names))


def _fold() -> Column:
    return F.pmod(F.xxhash64(F.lit("fold"), F.col("url")), F.lit(FOLDS)).cast("int")


class Model:
    """base and trees, and for each kind of hash bucket the labels' count and sum by (fold, bucket)."""

    def __init__(self, base: float, trees: list[dict], statistics: dict[str, np.ndarray], share: float) -> None:
        self.base, self.trees, self.statistics, self.share = base, trees, statistics, share

    def rate(self, of: str, without_fold: bool = False) -> Column:
        """Smoothed share of blocked labels in the row's bucket, in training without the labels of the row's fold."""
        at = F.col(f"_url_{of}") + 1
        listed = lambda v: F.expr(f"array({', '.join(f'{x:.1f}D' for x in v)})")
        count, total = (F.element_at(listed(v.sum(0)), at) for v in self.statistics[of])
        if without_fold:
            own, own_total = (F.element_at(listed(v.ravel()), _fold() * BUCKETS + at) for v in self.statistics[of])
            count, total = count - own, total - own_total
        return (total + SMOOTH * self.share) / (count + SMOOTH)

    def score(self, urls: DataFrame) -> DataFrame:
        """urls (url, host, path) with block_score (0 to 1) added."""
        kept = urls.columns
        full = lexical(urls).withColumns({_F + k: self.rate(k) for k in self.statistics})
        total = reduce(lambda a, t: a + _tree(t, FEATURES), self.trees, F.lit(self.base))
        return full.select(*kept, (1 / (1 + F.exp(-total))).alias("block_score"))


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """labelled (url, host, path, blocked 0 or 1; null: no label)."""
    full = lexical(labelled.filter("blocked is not null"))
    statistics = {}
    for of in ("suffix", "section"):
        held = statistics[of] = np.zeros((2, FOLDS, BUCKETS))
        for fold, bucket, n, blocked in full.groupBy(_fold(), f"_url_{of}").agg(F.count("*"), F.sum("blocked")).collect():  # at most FOLDS * BUCKETS rows
            held[:, fold, bucket] = n, blocked
    n, blocked = statistics["suffix"].sum((1, 2))
    share = float(blocked / n) if n else 0.0
    model = Model(-20.0 if share == 0 else 20.0 if share == 1 else 0.0, [], statistics, share)
    if 0 < share < 1:
        # a hash below the threshold: about `sample` rows of all n, the same on every run
        place = F.shiftrightunsigned(F.xxhash64(F.lit("sample"), F.col("url")), 1)
        some = full.filter(place < min(2**63 - 1, int(2**63 * min(1.0, sample / n))))
        x = some.withColumns({_F + k: model.rate(k, True) for k in statistics}).groupBy("url", *(_F + c for c in FEATURES), "blocked").count().toPandas()
        x = x.sort_values(["url", "blocked"])
        model.base, model.trees = _boost(*(x[c].to_numpy(np.float64) for c in ([_F + c for c in FEATURES], "blocked", "count")))
    return model


def split(urls: DataFrame) -> DataFrame:
    return urls.withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})


def judge(urls: DataFrame, rules=RULES, model: Model | None = None) -> DataFrame:
    """urls (url) with host, path, rule, verdict and block_score added. Without a model, one is fitted to the verdicts of
    the rules."""
    ruled = with_rules(split(urls), rules)
    model = model or fit(ruled.select("url", "host", "path", (F.col("rule_verdict") == "block").cast("int").alias("blocked")))
    verdict = F.coalesce("rule_verdict", F.when(F.col("block_score") >= 0.5, "block").otherwise("allow"))
    return model.score(ruled).withColumn("verdict", verdict).drop("rule_verdict")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "block_score")
