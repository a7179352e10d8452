"""Plain Python versions of the operators' contracts."""

import hashlib
import re

import numpy as np
from xxhash import xxh64_intdigest

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def simhash(text) -> int:
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOWER)) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def components(fps: list[tuple[int, int]], within: int = 4) -> dict[int, int]:
    """(doc_id, fingerprint) -> doc_id: smallest reachable."""
    root = list(range(len(fps)))

    def top(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    x = np.array([f for _, f in fps], np.uint64)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(x[i + 1 :] ^ x[i]) <= within) + i + 1:
            root[top(int(j))] = top(i)
    least = {}
    for i, (d, _) in enumerate(fps):
        least[top(i)] = min(d, least.get(top(i), d))
    return {d: least[top(i)] for i, (d, _) in enumerate(fps)}


def substring_dedup(docs) -> dict:
    seen, out = {}, {}
    for i, t in sorted(docs):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x]
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            k = tuple(w[s : s + 20])
            if k in seen:
                gone[s : s + 20] = [True] * 20
            else:
                seen[k] = (i, s)
        out[i] = (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g)))
    return out


def _luhn(d: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def personal(text) -> list:
    t = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(digits(m[0])) <= 19 and _luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(digits(m[0])) <= 15]
    return sorted(out)


def secret(text) -> list:
    t = text or ""
    kw = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out = [(m.start(), 0, m.end()) for m in re.finditer(kw, t) if len(m[1]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(out)


def shown(spans, kinds) -> str:
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans)


def decontaminate(docs, items, n: int = 10) -> dict:
    grams = {}
    for i, t in items:
        w = WORD.findall((t or "").translate(LOWER))
        size = min(n, len(w))
        for s in range(len(w) - size + 1) if w else ():
            grams.setdefault(tuple(w[s : s + size]), set()).add("" if i is None else str(i))
    sizes = {len(g) for g in grams}
    out = {}
    for d, t in docs:
        w = WORD.findall((t or "").translate(LOWER))
        hit, found = set(), set()
        for size in sizes:
            for s in range(len(w) - size + 1):
                own = grams.get(tuple(w[s : s + size]))
                if own:
                    hit |= set(range(s, s + size))
                    found |= own
        out[d] = (len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit))
    return out
