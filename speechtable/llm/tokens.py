"""Edit-aware token counts.

A text's pre-tokens (what the tokenizer's pattern splits it into) are kept in a segment tree: a leaf stands for about
`LEAF` consecutive pre-tokens, and every node holds the characters and tokens below it. An edit replaces a stretch of
characters. The tree is descended to the leaf in which the stretch begins, less `CONTEXT` pre-tokens in front of it (the
pattern looks one character ahead, so the pre-token before an edit may change). From there the new text is split until a
pre-token ends where a leaf behind the edit began; from that point on the old split is right again, as the pattern has no
memory. Only these pre-tokens are encoded again, and only the sums above their leaves are updated.

A tokenizer is given by the path of a file of byte-level BPE ranks and a pattern; Python workers load it once. Counts of
pre-tokens are remembered, up to `REMEMBERED` of them.

`build` makes the trees of a table as rows to be kept, `update` applies a table of edits to kept trees and texts: edits
and trees meet by document, and documents without an edit aren't looked at. `edited_counts` does both in one pass over
documents that carry their edits, and shuffles nothing.

Cases: null or empty text has no tokens; a very long text's tree is built whole, in memory by the number of its leaves; edits apply in order, each to the text that the one before left; offsets beyond
the end mean the end, and an end before its start means the start; null edits, or null text in one, change or insert
nothing; repeated rows stand for themselves (in `update` a doc_id must be unique); an empty table gives no rows; other
columns aren't read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

LEAF, CONTEXT, REMEMBERED = 32, 2, 400_000
#: where the installed vocabularies lie; a parameter everywhere
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: fixed value: the public pattern of byte-level BPE
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_LOADED: dict[tuple[str, str], Counter] = {}


class Counter:
    """Splits texts and counts the tokens of pre-tokens."""

    def __init__(self, vocabulary: str, pattern: str) -> None:
        import regex
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._encode = tiktoken.Encoding("speechtable", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.split = regex.compile(pattern)
        self._known: dict[str, int] = {}

    @classmethod
    def of(cls, vocabulary: str, pattern: str) -> Counter:
        key = (vocabulary, pattern)
        if key not in _LOADED:
            _LOADED[key] = cls(*key)
        return _LOADED[key]

    def count(self, pieces: list[str]) -> list[int]:
        known = self._known
        if len(known) > REMEMBERED:
            known.clear()
        out = []
        for p in pieces:
            n = known.get(p)
            if n is None:
                n = len(self._encode(p))
                if len(p) < 64:
                    known[p] = n
            out.append(n)
        return out


class Tree:
    """Sums over leaves, as heaps: node i has the children 2i and 2i+1, and leaf k is node width+k."""

    def __init__(self, leaves: list[tuple[int, int, int]]) -> None:
        """leaves: (characters, tokens, pre-tokens) each."""
        self.n = len(leaves)
        self.width = 1
        while self.width < max(1, self.n):
            self.width *= 2
        self.sums = np.zeros((2 * self.width, 3), np.int64)
        if leaves:
            self.sums[self.width : self.width + self.n] = leaves
        level = self.width
        while level > 1:
            self.sums[level // 2 : level] = self.sums[level : 2 * level : 2] + self.sums[level + 1 : 2 * level : 2]
            level //= 2

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    @property
    def pieces(self) -> int:
        return int(self.sums[1, 2])

    def leaf_at(self, at: int) -> tuple[int, int]:
        """The leaf that holds character `at` (the last one beyond the end), and the character that it begins with."""
        i, begin = 1, 0
        while i < self.width:
            i *= 2
            left = int(self.sums[i, 0])
            if at - begin >= left and self.sums[i + 1, 2] > 0:
                begin += left
                i += 1
        return i - self.width, begin

    def replace(self, first: int, last: int, leaves: list[tuple[int, int, int]]) -> None:
        """Put other leaves in place of first .. last-1; the sums above are updated, or all if their number changes."""
        if len(leaves) != last - first:
            own = self.sums[self.width : self.width + self.n].tolist()
            self.__init__([*own[:first], *leaves, *own[last:]])
            return
        self.sums[self.width + first : self.width + last] = leaves
        a, b = (self.width + first) // 2, (self.width + last - 1) // 2
        while a:
            self.sums[a : b + 1] = self.sums[2 * a : 2 * b + 2 : 2] + self.sums[2 * a + 1 : 2 * b + 2 : 2]
            a, b = a // 2, b // 2

    def leaves(self) -> list[tuple[int, int, int]]:
        return [tuple(x) for x in self.sums[self.width : self.width + self.n].tolist()]


def _leaves(pieces: list[str], counts: list[int], number: int | None = None) -> list[tuple[int, int, int]]:
    """Pre-tokens in leaves: `number` of them if that keeps each within a quarter and twice LEAF, else LEAF in each."""
    if number is None or not LEAF // 4 * number <= len(pieces) <= 2 * LEAF * number:
        number = -(-len(pieces) // LEAF)
    cuts = [round(i * len(pieces) / number) for i in range(number + 1)] if number else [0]
    return [(sum(map(len, pieces[a:b])), sum(counts[a:b]), b - a) for a, b in zip(cuts, cuts[1:])]


def build_tree(text: str, counter: Counter) -> Tree:
    pieces = counter.split.findall(text)
    return Tree(_leaves(pieces, counter.count(pieces)))


def apply_edit(tree: Tree, text: str, start: int, end: int, new: str, counter: Counter) -> tuple[str, int]:
    """Change the tree to that of the edited text; the text, and how many pre-tokens were encoded."""
    start = min(max(0, start), len(text))
    end = min(max(start, end), len(text))
    edited = text[:start] + new + text[end:]
    shift = len(edited) - len(text)
    if not tree.n:
        tree.__init__(_leaves(pieces := counter.split.findall(edited), counter.count(pieces)))
        return edited, len(pieces)
    # the leaf of the edit's first character, or the one before if fewer than CONTEXT pre-tokens lie between
    leaf, begin = tree.leaf_at(start)
    if leaf and len([*counter.split.finditer(text, begin, start)]) < CONTEXT:
        leaf, begin = tree.leaf_at(begin - 1)
    last, stop = leaf, begin  # leaves leaf .. last-1 end with character stop of the old text
    while last < tree.n and stop <= end:
        stop += int(tree.sums[tree.width + last, 0])
        last += 1
    pieces = []
    at = begin
    for m in counter.split.finditer(edited, begin):
        while stop + shift < at and last < tree.n:  # passed without a cut there
            stop += int(tree.sums[tree.width + last, 0])
            last += 1
        if at == stop + shift and stop > end:
            break
        pieces.append(m[0])
        at = m.end()
    else:
        last = tree.n
    tree.replace(leaf, last, _leaves(pieces, counter.count(pieces), last - leaf))
    return edited, len(pieces)


def _edited(tree: Tree, text: str, edits: list[dict] | None, counter: Counter) -> tuple[str, int]:
    again = 0
    for e in edits or []:
        if e is not None and e["start"] is not None:
            text, n = apply_edit(tree, text, e["start"], e["start"] if e["end"] is None else e["end"], e["text"] or "", counter)
            again += n
    return text, again


EDITS = "array<struct<start:long,end:long,text:string>>"
TREE = "array<struct<chars:long,tokens:long,pieces:long>>"


def build(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_tokens, leaves: a tree as its leaves, about a 30th of the text's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter.of(vocabulary, pattern)
        for b in batches:
            trees = [build_tree(t or "", counter) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t.tokens for t in trees], pa.int64()), _rows(trees)], names=["doc_id", "n_tokens", "leaves"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, leaves {TREE}")


def _rows(trees: list[Tree]) -> pa.Array:
    return pa.array([[{"chars": c, "tokens": t, "pieces": p} for c, t, p in tree.leaves()] for tree in trees], pa.list_(pa.struct([("chars", pa.int64()), ("tokens", pa.int64()), ("pieces", pa.int64())])))


def update(docs: DataFrame, trees: DataFrame, edits: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """docs (doc_id, text), their trees (doc_id, leaves) and edits (doc_id, seq, start, end, text) -> the documents that
    have edits: doc_id, text, n_tokens, leaves, n_encoded (pre-tokens encoded again)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter.of(vocabulary, pattern)
        for b in batches:
            texts, again, done = [], [], []
            for t, leaves, e in zip(*(b.column(k).to_pylist() for k in (1, 2, 3))):
                tree = Tree([(x["chars"], x["tokens"], x["pieces"]) for x in leaves])
                text, n = _edited(tree, t or "", e, counter)
                texts.append(text)
                again.append(n)
                done.append(tree)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array([t.tokens for t in done], pa.int64()), _rows(done), pa.array(again, pa.int64())], names=["doc_id", "text", "n_tokens", "leaves", "n_encoded"])

    own = edits.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "text").alias("e")))), lambda x: x["e"]).alias("edits"))
    met = docs.select("doc_id", "text").join(own, "doc_id").join(trees.select("doc_id", "leaves"), "doc_id").select("doc_id", "text", "leaves", "edits")
    return met.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string, n_tokens long, leaves {TREE}, n_encoded long")


def edited_counts(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """docs (doc_id, text, edits) -> doc_id, n_pieces and n_tokens of the text, n_tokens_edited, n_encoded (pre-tokens
    that the edits made encode again)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter.of(vocabulary, pattern)
        for b in batches:
            out: list[list[int]] = [[], [], [], []]
            for t, e in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                tree = build_tree(t or "", counter)
                out[0].append(tree.pieces)
                out[1].append(tree.tokens)
                _, n = _edited(tree, t or "", e, counter)
                out[2].append(tree.tokens)
                out[3].append(n)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in out)], names=["doc_id", "n_pieces", "n_tokens", "n_tokens_edited", "n_encoded"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", "edits").mapInArrow(run, f"doc_id {kind}, n_pieces long, n_tokens long, n_tokens_edited long, n_encoded long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with three edits: 12 characters of the middle give way to the first 20 of the text, the first 5 go,
    and the language is written at the end."""
    docs = table(spark, sf_dir, "documents")
    n = F.coalesce(F.char_length("text"), F.lit(0)).cast("long")
    edit = lambda start, end, text: F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"), text.alias("text"))
    edits = F.array(
        edit(F.floor(n / 2), F.floor(n / 2) + 12, F.substring("text", 1, 20)),
        edit(F.lit(0), F.lit(5), F.lit("")),
        edit(n + 100, n + 100, F.concat(F.lit(" "), F.coalesce("lang", F.lit("?")))),
    )
    return edited_counts(docs.select("doc_id", "text", edits.alias("edits")))
