"""Personal data by anchor expansion.

An Aho-Corasick automaton passes over each text once, with A-Z as a-z, and finds anchors: at-signs, schemes (`://`), plus
signs and cues of identifiers such as "iban" or "User ID". From each anchor a small parser expands to both sides and
validates what it finds. Digits are too common to be anchors of their own: ip and card are scans with a pattern that
tries each run of digits once, and the same validation.

* `email`: local part to the left of an at-sign, labels with at least one dot to its right;
* `ip`: four runs of digits with single dots between them, each at most 255;
* `card`: digits with single spaces or hyphens between them, 14 to 19 of them, with a right Luhn sum;
* `phone`: a plus sign, digits and separators up to the last digit, 10 to 15 digits;
* `handle`: an at-sign at a word's start that isn't part of an email, and a name of 3 or more characters;
* `login`: user (and password) between a scheme and the at-sign of a URL's host;
* `profile`: a person's own page, by the URL's address: a scheme, the host up to its first slash, one of `~`, `@`, `u/`,
  `user/`, `users/`, `profile/`, `profiles/`, `people/`, and a name;
* `account`: after a cue that isn't part of a longer word and at most 3 separators, letters and digits with at least 4
  digits, in one or more groups that each hold a digit.

The first four are the base kinds: leftmost, non-overlapping matches, apart for each kind; what fails validation is passed
over and not tried again. The others come on top and never replace a base span.

Cases: null or empty text has no spans; repeated rows and ids are documents of their own; an empty table gives no rows;
other columns aren't read (`mask` keeps them). Offsets are code points, ends exclusive. Whole texts are read, in time
that grows with their length and no faster, also where they are one run of digits, cues or at-signs.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "handle", "login", "account", "profile")
#: fixed values: the base kinds' patterns around their anchors
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# each run of digits is tried from its first digit alone: from a later one the rest of the pattern meets the same text
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: fixed value: cues of identifiers
CUES = ("account", "acct", "iban", "passport", "customer id", "user id", "userid", "member id", "ssn", "tax id")
HANDLE = re.compile(r"[A-Za-z0-9_]{3,}+(?!@)")
LOGIN = re.compile(r"[^\s/?#@:]++(?::[^\s/?#@]*+)?@(?=[A-Za-z0-9])")
PROFILE = re.compile(r"[^\s/?#]++/(?:~|@|u/|users?/|profiles?/|people/)[A-Za-z0-9_.-]*[A-Za-z0-9_]")
ACCOUNT = re.compile(r"(?:\s{1,3}(?:number|no|nr))?[\s.:#=-]{1,3}([A-Za-z0-9]++)", re.I)
GROUP = re.compile(r"[ -]([A-Za-z0-9]++)")

_AUTOMATON: list = []


def _automaton():
    if not _AUTOMATON:
        import ahocorasick

        a = ahocorasick.Automaton()
        for cue in CUES:
            a.add_word(cue, len(cue))
        for sign in ("@", "://", "+"):
            a.add_word(sign, sign)
        a.make_automaton()
        _AUTOMATON.append(a)
    return _AUTOMATON[0]


def _part(digits: str) -> bool:
    """At most 255, whatever the number of leading zeros."""
    digits = digits.lstrip("0")
    return len(digits) < 3 or len(digits) == 3 and digits <= "255"


def _luhn(digits: str) -> bool:
    own = [int(d) for d in reversed(digits)]
    return (sum(own[::2]) + sum(2 * d - 9 * (d > 4) for d in own[1::2])) % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str, ats: list[int], pluses: list[int]) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the base kinds; ats and pluses: where these signs stand."""
    out = []
    to = 0
    for at in ats:
        if at < to:
            continue
        start = at
        while start > to and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            to = m.end()
            out.append((start, 0, to))
    for m in IP.finditer(text):
        if all(map(_part, m[0].split("."))):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and _luhn(d):
            out.append((m.start(), 2, m.end()))
    for at in pluses:  # no plus sign lies inside another's match
        if (m := PHONE.match(text, at)) and 10 <= len(_digits(m[0])) <= 15:
            out.append((at, 3, m.end()))
    return out


def more_spans(text: str, hits: list[tuple[int, str | int]], emails: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """hits: an anchor's last character and what it is (a cue: its length), in order; emails in order."""
    out = []
    passed, account_to = 0, 0
    for at, what in hits:
        if what == "@":
            while passed < len(emails) and emails[passed][1] <= at:
                passed += 1
            inside = passed < len(emails) and emails[passed][0] <= at
            if not inside and (at == 0 or not (text[at - 1].isalnum() or text[at - 1] in "._%+-@/:")) and (m := HANDLE.match(text, at + 1)):
                out.append((at, 4, m.end()))
        elif what == "://":
            if m := LOGIN.match(text, at + 1):
                out.append((at + 1, 5, m.end() - 1))
            if m := PROFILE.match(text, at + 1):
                out.append((at + 1, 7, m.end()))
        elif what != "+" and at >= account_to and (at + 1 == len(text) or not text[at + 1].isalnum()) and (at < what or not text[at - what].isalnum()) and (m := ACCOUNT.match(text, at + 1)):
            # the longest run of groups that hold digits: it stops before the first group of letters alone
            start = end = m.start(1)
            while m and any("0" <= c <= "9" for c in m[1]):
                end = m.end()
                m = GROUP.match(text, end)
            account_to = end
            if len(_digits(text[start:end])) >= 4:
                out.append((start, 6, end))
    return sorted(set(out))


def spans(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans, by start and kind."""
    text = text or ""
    hits = [*_automaton().iter(text.encode().lower().decode())]
    base = sorted(base_spans(text, [at for at, what in hits if what == "@"], [at for at, what in hits if what == "+"]))
    more = more_spans(text, hits, [(a, b) for a, k, b in base if k == 0]) if hits else []
    return base, sorted({*base, *more})


def _shown(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def report(docs: DataFrame) -> DataFrame:
    """docs -> doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: list[list[int]] = [[] for _ in BASE]
            digests, shown = [], []
            for t in b.column(1).to_pylist():
                base, all_ = spans(t)
                for k in range(len(BASE)):
                    counts[k].append(sum(x[1] == k for x in base))
                digests.append(hashlib.sha256(_shown(base).encode()).hexdigest())
                shown.append(_shown(all_))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(shown, pa.string())], names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {', '.join(f'n_{k} long' for k in BASE)}, base_sha256 string, spans string")


def mask(docs: DataFrame) -> DataFrame:
    """docs with every span of the text replaced by its kind in brackets (of overlapping ones by the first's)."""
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column(columns.index("text")).to_pylist():
                pieces, at = [], 0
                for a, k, e in spans(t)[1]:
                    if a >= at:
                        pieces += [t[at:a], f"[{KINDS[k].upper()}]"]
                    at = max(at, e)
                out.append(t if t is None else "".join(pieces) + t[at:])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == "text" else b.column(i) for i, c in enumerate(columns)], names=columns)

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))
