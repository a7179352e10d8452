"""Secret scans: three fixed kinds of span, and a battery of randomness tests over every other long token.

Base kinds are leftmost, non-overlapping matches: `assign` (a key word, a separator and a value), `access` (access key
ids) and `hex` (long lower-case hexadecimal runs). The method adds `random`: each run of 20 or more token characters is
tested in the encoding that it looks like (decimal, hex, base32, letters and digits, base64):

* Likelihood ratio of a uniform alphabet against the corpus's own way of writing: how classes of characters (upper, lower,
  digit, symbol) follow one another, and which letter follows which, whatever their case. Both are
  counted over all runs of token characters of all documents. For a token that is written that way the
  chance of a ratio of R or more is at most 1/R, its p-value; a single random token of 20 characters has a tiny one.
* A battery against the opposite claim, that the token is random: chi-squared of its character counts, Wald-Wolfowitz runs
  above and below the middle of the alphabet, and the serial correlation of neighbouring characters. The three are combined
  into one p-value, three times the least of theirs (Bonferroni); below `BATTERY` the token is uneven, ordered or repetitive,
  and its p-value of "not random" becomes 1.

So a token has one p-value, the larger of both, which stays valid whether or not the tests depend on one another. False
discoveries are controlled over the whole corpus with Benjamini-Hochberg at rate `q`, apart for each encoding and class of
length: tokens that the battery turns down count among the tested and never among the found. P-values are counted in bins
(a table of at most 5 x 4 x 65 counts, whatever the corpus), so no p-value is ever sorted or collected. Everything else is
a column expression on the row that holds the text: nothing is shuffled but these counts and those of at most 66 x 66 pairs
of characters.

Cases: null or empty text has no spans; repeated rows and ids are documents of their own; an empty table gives no rows;
other columns are kept, save those whose names begin with `_sec_`. Offsets are code points, ends exclusive. Whole texts
are read, in time that grows with their length and number of matches; a long token takes time by its length times its
distinct characters.
"""

from __future__ import annotations

from collections import Counter
from math import log10
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hex_digest, let, table

#: fixed values: the base patterns; for each the group whose length counts and the least length
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = {"assign": (ASSIGN, 1, 8), "access": (r"AKIA[A-Z0-9]+", 0, 16), "hex": (r"[0-9a-f]+", 0, 32)}
#: cheap tests that a text must pass before the pattern is run
MAYBE = {"assign": r"(?i)passw|secret|token|api_?key", "access": r"AKIA", "hex": r"[0-9a-f]{32}"}
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
#: encoding: the pattern that infers it, and its alphabet
ENCODINGS = {
    "decimal": (r"^[0-9]+$", "0123456789"),
    "hex": (r"^([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef"),
    "base32": (r"^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    "alnum": (r"^[A-Za-z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    "base64": (r"", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"),
}
TOKEN_CHARS = ENCODINGS["base64"][1]
LENGTHS = (32, 48, 80)
BINS, PER_DECADE = 64, 4
#: the battery's p-value below which a token isn't random, and for a third of it the normal deviate, one-sided and two-sided
BATTERY = 0.001
Z_ONE_SIDED, Z_TWO_SIDED = (NormalDist().inv_cdf(1 - BATTERY / 3 / sides) for sides in (1, 2))
Q = 0.05
#: code points of a piece of text, and spans worked on at once, where found spans are cut out
PIECE, SPANS_AT_ONCE = 4096, 256
#: lengths summed at once
BLOCK = 128
SPANS = "array<struct<kind:string,start:int,end:int>>"


def _before(values: Column, levels: int = 2) -> Column:
    """For each of some ints, the sum of those that stand before it.

    An array that grows value by value is copied each time, so it is only grown within blocks; sums of blocks are treated alike.
    """
    grown = lambda x, at: F.aggregate(
        x, F.struct(at.alias("at"), F.array().cast("array<int>").alias("out")), lambda a, v: F.struct((a["at"] + v).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"]
    )
    if not levels:
        return grown(values, F.lit(0))
    cut = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda b: F.slice(v, b * BLOCK + 1, F.lit(BLOCK)))
    total = lambda x: F.aggregate(x, F.lit(0), lambda a, v: a + v)
    joined = lambda blocks: F.flatten(F.transform(F.arrays_zip(blocks.alias("x"), _before(F.transform(blocks, total), levels - 1).alias("at")), lambda y: grown(y["x"], y["at"])))
    return let(values, lambda v: F.when(F.size(v) > 0, let(cut(v), joined)).otherwise(F.array().cast("array<int>")))


def _matches(text: Column, pattern: str, make) -> Column:
    """make(match, start) for each match of pattern, in order.

    Between n matches lie n+1 pieces of text; a match starts after the pieces and matches before it.
    """

    def placed(found: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        pairs = lambda v: F.transform(F.arrays_zip(found.alias("m"), v.alias("v"), _before(F.transform(v, lambda y: y["g"] + y["m"])).alias("s")), lambda x: make(x["m"], x["s"] + x["v"]["g"]))
        return let(F.arrays_zip(F.transform(gaps, F.char_length).alias("g"), F.transform(found, F.char_length).alias("m")), pairs)

    return let(F.regexp_extract_all(text, F.lit(f"({pattern})"), 1), placed)


def _span(kind: str, start: Column, n: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), start.cast("int").alias("start"), (start + n).cast("int").alias("end"))


def base_spans(text: Column, kind: str) -> Column:
    pattern, group, least = BASE[kind]
    value = (lambda m: F.regexp_extract(m, pattern, group)) if group else (lambda m: m)
    made = _matches(text, pattern if kind != "hex" else r"[0-9a-f]{32,}", lambda m, s: F.struct(_span(kind, s, F.char_length(m)).alias("x"), F.char_length(value(m)).alias("n")))
    kept = F.filter(made, lambda y: y["n"] >= least)["x"]
    return F.when(text.rlike(MAYBE[kind]), kept).otherwise(F.array().cast(SPANS))


def _pairs(a: Column) -> Column:
    return F.arrays_zip(F.slice(a, F.lit(1), F.size(a) - 1).alias("x"), F.slice(a, F.lit(2), F.size(a) - 1).alias("y"))


def _kind(c: str) -> str:
    return "digit" if c.isdigit() else "upper" if c.isupper() else "lower" if c.islower() else "symbol"


def surprise(pairs: dict[tuple[str, str], int]) -> list[float]:
    """Counts of pairs of neighbours -> -log10 of the chance of y after x, at place 66 x + y (by TOKEN_CHARS)."""
    kinds, after_kind, own, after, single = Counter(), Counter(), Counter(), Counter(), Counter()
    group = lambda c: "letter" if c.isalpha() else _kind(c)
    size = Counter(map(group, {c.lower() for c in TOKEN_CHARS}))
    for (x, y), n in pairs.items():
        kinds[_kind(x), _kind(y)] += n
        after_kind[_kind(x)] += n
        own[x.lower(), y.lower()] += n
        after[x.lower(), group(y)] += n
        single[y.lower()] += n
        single[group(y)] += n

    def chance(x: str, y: str) -> float:
        alone = (single[y.lower()] + 1) / (single[group(y)] + size[group(y)])
        return (kinds[_kind(x), _kind(y)] + 1) / (after_kind[_kind(x)] + 4) * (own[x.lower(), y.lower()] + 5 * alone) / (after[x.lower(), group(y)] + 5)

    return [-log10(chance(x, y)) for x in TOKEN_CHARS for y in TOKEN_CHARS]


def written_way(docs: DataFrame) -> list[float]:
    """surprise() of all documents. Runs are cut into pairs where they lie; only counts are shuffled."""
    runs = docs.select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z0-9+/_-]{2,})"), 1)).alias("run"))
    counts = runs.select(F.explode(let(F.split("run", ""), _pairs)).alias("p")).groupBy("p.x", "p.y").count()
    return surprise({(r["x"], r["y"]): r["count"] for r in counts.collect()})  # at most 66 x 66


def tests(token: Column, way: Column) -> Column:
    """struct(encoding, size, bin): bin numbers the p-value of "not random" (PER_DECADE a power of ten; 0: it is 1, also where
    the battery turns the token down). way: array that surprise() gives."""
    n = F.char_length(token).cast("double")
    kind = lambda k: F.struct(F.lit(k).alias("encoding"), F.lit(float(len(ENCODINGS[k][1]))).alias("size"), F.lit(ENCODINGS[k][1]).alias("alphabet"))
    encoding = kind("base64")
    for name in reversed([k for k in ENCODINGS if k != "base64"]):
        encoding = F.when(token.rlike(ENCODINGS[name][0]), kind(name)).otherwise(encoding)
    size_class = F.lit(len(LENGTHS))
    for k, most in reversed([*enumerate(LENGTHS)]):
        size_class = F.when(n < most, k).otherwise(size_class)

    def ratio(e: Column, places: Column) -> Column:
        """Likelihood ratio's p-value, as its bin. The first character tells nothing."""
        total = F.aggregate(_pairs(places), F.lit(0.0), lambda a, p: a + F.get(way, p["x"] * len(TOKEN_CHARS) + p["y"]))
        return F.greatest(F.lit(0), F.least(F.lit(BINS), F.floor((total - (n - 1) * F.log10(e["size"])) * PER_DECADE))).cast("int")

    def chi_z(e: Column, chars: Column) -> Column:
        squares = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a + F.pow(F.size(F.filter(chars, lambda x: x == c)).cast("double"), F.lit(2.0)))
        return (e["size"] / n * squares - n - (e["size"] - 1)) / F.sqrt(2 * (e["size"] - 1) * (n - 1) / n)

    def runs_z(high: Column) -> Column:
        """Runs above and below the middle of the alphabet."""
        ups = F.size(F.filter(high, lambda x: x)).cast("double")
        runs = 1 + F.size(F.filter(_pairs(high), lambda p: p["x"] != p["y"]))
        due = 2 * ups * (n - ups) / n + 1
        return (runs - due) / F.sqrt(F.greatest((due - 1) * (due - 2) / (n - 1), F.lit(1e-9)))

    def serial_z(at: Column, avg: Column) -> Column:
        """Correlation of neighbours."""
        var = F.aggregate(at, F.lit(0.0), lambda a, x: a + (x - avg) * (x - avg))
        cov = F.aggregate(_pairs(at), F.lit(0.0), lambda a, p: a + (p["x"] - avg) * (p["y"] - avg))
        return cov / F.greatest(var, F.lit(1e-9)) * F.sqrt(n)

    def of(e: Column) -> Column:
        chars = F.split(F.when(e["encoding"] == "hex", F.lower(token)).otherwise(token), "")
        places = F.transform(F.split(token, ""), lambda x: F.instr(F.lit(TOKEN_CHARS), x) - 1)
        return let(chars, lambda c: let(F.transform(c, lambda x: F.instr(e["alphabet"], x).cast("double")), lambda at: F.struct(
            e["encoding"].alias("encoding"), size_class.alias("size"),
            F.when((chi_z(e, c) < Z_ONE_SIDED) & (F.abs(let(F.transform(at, lambda x: x * 2 > e["size"]), runs_z)) < Z_TWO_SIDED)
                   & (F.abs(let(F.aggregate(at, F.lit(0.0), lambda a, x: a + x) / n, lambda avg: serial_z(at, avg))) < Z_TWO_SIDED), ratio(e, places)).otherwise(0).alias("bin"),
        )))

    return let(encoding, of)


def candidates(text: Column, way: list[float]) -> Column:
    """array of struct(x: span, t: tests) for each long token."""
    known = F.split(F.lit(",".join(f"{x:.4f}" for x in way)), ",").cast("array<double>")  # the optimizer makes a constant of it
    made = _matches(text, CANDIDATE, lambda m, s: F.struct(_span("random", s, F.char_length(m)).alias("x"), tests(m, known).alias("t")))
    return F.when(text.rlike(CANDIDATE), made)


def discoveries(docs: DataFrame, way: list[float], q: float = Q) -> list[tuple[str, int, int]]:
    """(encoding, size class, least bin that counts as a discovery); classes without one are left out.

    With N tokens of a class in bin b or above, of m in all, those are expected to hold m * 10^(-b/4) false ones.
    """
    each = docs.select(F.explode(candidates(F.coalesce(F.col("text"), F.lit("")), way).getField("t")).alias("t")).groupBy("t.encoding", "t.size", "t.bin").count()
    counts: dict[tuple[str, int], dict[int, int]] = {}
    for r in each.collect():  # bounded by encodings x lengths x bins
        counts.setdefault((r["encoding"], r["size"]), {})[r["bin"]] = r["count"]
    found = []
    for (encoding, size), bins in sorted(counts.items()):
        m = sum(bins.values())
        for b in range(1, BINS + 1):  # bin 0 is a p-value of 1
            above = sum(n for k, n in bins.items() if k >= b)
            if above and m * 10 ** (-b / PER_DECADE) / above <= q:
                found.append((encoding, size, b))
                break
    return found


def scan(docs: DataFrame, q: float = Q) -> DataFrame:
    """docs with `_sec_base` and `_sec_all` (arrays of kind, start, end by start, then kind) added; its rows stay in place."""
    way = written_way(docs)
    least = discoveries(docs, way, q)
    text = F.coalesce(F.col("text"), F.lit(""))
    by_text = {}
    for encoding, size, b in least:
        by_text.setdefault((encoding, size), b)

    def is_found(t: Column) -> Column:
        out = F.lit(False)
        for (encoding, size), b in by_text.items():
            out = out | ((t["encoding"] == encoding) & (t["size"] == size) & (t["bin"] >= b))
        return out

    rank = {k: i for i, k in enumerate([*BASE, "random"])}
    spans = F.concat(*(base_spans(text, k) for k in BASE))
    order = lambda x: F.struct(x["start"].alias("start"), F.element_at(F.create_map(*(F.lit(y) for kv in rank.items() for y in kv)), x["kind"]).alias("rank"), x["kind"].alias("kind"), x["end"].alias("end"))
    ordered = lambda a: F.transform(F.array_sort(F.transform(a, order)), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    more = F.transform(F.filter(F.coalesce(candidates(text, way), F.array()), lambda y: is_found(y["t"])), lambda y: y["x"]) if by_text else F.array().cast(SPANS)
    return docs.withColumn("_sec_found", spans).withColumn("_sec_base", ordered(F.col("_sec_found"))).withColumn("_sec_all", ordered(F.concat("_sec_found", more))).drop("_sec_found")


def _between(pieces: Column, start: Column, end: Column) -> Column:
    """The text from start to end, from pieces of PIECE code points."""
    own = lambda k: F.substring(F.get(pieces, k), F.greatest(start - k * PIECE, F.lit(0)) + 1, F.least(end - k * PIECE, F.lit(PIECE)) - F.greatest(start - k * PIECE, F.lit(0)))
    places = F.sequence(F.floor(start / PIECE).cast("int"), F.floor((end - 1) / PIECE).cast("int"))
    return F.when(end > start, F.array_join(F.transform(places, own), "")).otherwise(F.lit(""))


def _cut(pieces: Column, spans: Column, mark: str) -> Column:
    """The text with mark for each run of overlapping spans. Spans are worked on SPANS_AT_ONCE at a time, so that no string
    grows with the whole text."""
    n = F.floor((F.size(spans) - 1) / SPANS_AT_ONCE).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), n), lambda b: F.slice(spans, b * SPANS_AT_ONCE + 1, F.lit(SPANS_AT_ONCE)))
    last = F.transform(blocks, lambda x: F.array_max(F.transform(x, lambda y: y["end"])))
    step = lambda a, x: F.struct(
        F.when(x["start"] >= a["to"], F.concat(a["out"], _between(pieces, a["to"], x["start"]), F.lit(mark))).otherwise(a["out"]).alias("out"),
        F.greatest(a["to"], x["end"]).alias("to"),
    )

    def joined(v: Column) -> Column:
        before = lambda i: F.when(i > 0, F.array_max(F.slice(v["last"], F.lit(1), i))).otherwise(F.lit(0))
        block = lambda x, i: F.aggregate(x, F.struct(F.lit("").alias("out"), before(i).alias("to")), step, lambda a: a["out"])
        length = (F.size(pieces) - 1) * PIECE + F.char_length(F.element_at(pieces, -1))
        return F.concat(F.array_join(F.transform(v["blocks"], block), ""), _between(pieces, F.array_max(v["last"]), length))

    return let(F.struct(blocks.alias("blocks"), last.alias("last")), joined)


def redact(docs: DataFrame, mark: str = "[SECRET]", q: float = Q) -> DataFrame:
    """docs with every found span of the text replaced by mark (overlapping spans by one); other documents stay as they
    are, and n_chars, where there is one, follows the text."""
    cut = let(F.struct(F.regexp_extract_all("text", F.lit(f"(?s)(.{{1,{PIECE}}})")).alias("pieces"), F.col("_sec_all").alias("spans")), lambda v: _cut(v["pieces"], v["spans"], mark))
    found = scan(docs, q)
    some = F.size("_sec_all") > 0
    found = found.withColumn("_sec_text", F.when(some, cut).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(some, F.char_length("_sec_text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return found.withColumn("text", F.col("_sec_text")).select(*docs.columns)


def shown(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("_sec_base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *(count(k) for k in BASE), hex_digest(shown(F.col("_sec_base"))).alias("base_sha256"), shown(F.col("_sec_all")).alias("spans"))
