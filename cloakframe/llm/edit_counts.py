"""Token counts that follow edits.

plant() cuts each text at white space into leaves of about `leaf` characters and keeps a
segment tree per document: the leaves, and the characters and tokens of each subtree. The
trees are a table like any other. update_counts() takes that table and edits: an edit
finds its leaves from the top, changes only their text, with neighbours until the fragment
again begins and ends at white space, and renews the sums of characters on the way up.
When all edits of a batch of documents are made, the leaves that they changed are encoded
in one call, and the sums of tokens are renewed above these leaves alone. Nothing else of
a text is encoded again. The result is the new table of trees, with counts before and
after. Leaves that an edit empties stay with zero sums; one that grows past eight times
its size is cut anew.

A tree is three columns: leaves array<string>; chars and tokens array<int>, sums in heap
order. Element 0 isn't used, the root is element 1, and node i has the children 2 i and
2 i + 1; leaf i is element size + i, where size is half of the array's length.

This holds for tokenizers that drop white space, as the ids of a text are then those of
its white-space-delimited parts; others are refused.

Null text is empty; null edits, null starts, lengths and texts are none, 0, 0 and empty.
Positions beyond the end mean the end; negative ones mean 0. Edits of a document are
applied in array order, each to what the ones before left. Repeated rows have a tree each.
Very long texts have a tree of their own; rows never meet. Empty tables give no rows.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch_of, prepare
from .tokens import encoder_of, groups_of

_SPACE = re.compile(r"[ \t\n\v\f\r]+")
_ENDS = " \t\n\v\f\r"


def cut(text: str, leaf: int) -> list[str]:
    """Fragments of at least `leaf` characters (the last may be shorter), each ending with white space but the last."""
    out, a = [], 0
    while a < len(text):
        m = _SPACE.search(text, min(len(text), a + leaf - 1))
        b = m.end() if m else len(text)
        out.append(text[a:b])
        a = b
    return out


class CountTree:
    """Leaves of text with subtree sums of characters and tokens. Edited leaves are dirty: their tokens hold only after settle()."""

    def __init__(self, leaves: list[str], chars: list[int], tokens: list[int], leaf: int):
        self.leaves, self.chars, self.tokens, self.leaf = leaves, chars, tokens, leaf
        self.size = len(chars) // 2
        self.touched, self.dirty = 0, set()

    @classmethod
    def planted(cls, leaves: list[str], tokens: list[int], leaf: int) -> CountTree:
        leaves = leaves or [""]
        size = 1 << max(0, len(leaves) - 1).bit_length()
        sums = []
        for values in ([len(x) for x in leaves], list(tokens)):
            s = [0] * size + values + [0] * (size - len(values))
            for i in range(size - 1, 0, -1):
                s[i] = s[2 * i] + s[2 * i + 1]
            sums.append(s)
        return cls(leaves, *sums, leaf)

    def _set(self, i: int, text: str) -> None:
        """Put text into leaf i; it is dirty from here on."""
        more, at, chars = len(text) - len(self.leaves[i]), self.size + i, self.chars
        self.leaves[i] = text
        self.dirty.add(i)
        while more and at:
            chars[at] += more
            at //= 2

    def find(self, pos: int) -> tuple[int, int]:
        """The leaf with the character at pos, and pos inside it; the end belongs to the last leaf with text."""
        pos = min(pos, max(0, self.chars[1] - 1))
        at = 1
        while at < self.size:
            at *= 2
            if pos >= self.chars[at]:
                pos -= self.chars[at]
                at += 1
        return min(at - self.size, len(self.leaves) - 1), pos

    def _next(self, i: int, step: int) -> int | None:
        i += step
        while 0 <= i < len(self.leaves):
            if self.leaves[i]:
                return i
            i += step
        return None

    def replace(self, start: int, length: int, new: str) -> None:
        """Put new in the place of length characters from start on."""
        total = self.chars[1]
        start = min(max(0, start), total)
        end = min(total, start + max(0, length))
        a, in_a = self.find(start)
        if start == total:
            in_a = len(self.leaves[a])
        b, in_b = self.find(end - 1) if end > start else (a, in_a - 1)
        text = self.leaves[a][:in_a] + new + self.leaves[b][in_b + 1 :]
        first, last = a, b
        while text and text[0] not in _ENDS and (p := self._next(first, -1)) is not None and self.leaves[p][-1] not in _ENDS:
            text, first = self.leaves[p] + text, p
        while (not text or text[-1] not in _ENDS) and (p := self._next(last, 1)) is not None:
            text, last = text + self.leaves[p], p
        self.touched += last - first + 1
        if len(text) > 8 * self.leaf and len(pieces := cut(text, self.leaf)) > 1:
            self._recut(first, last, pieces)
            return
        self._set(first, text)
        for i in range(first + 1, last + 1):
            if self.leaves[i]:
                self._set(i, "")

    def _recut(self, first: int, last: int, pieces: list[str]) -> None:
        """Pieces take the place of the leaves from first to last, in a tree planted anew; counts of other leaves stay."""
        own, more = [self.tokens[self.size + i] for i in range(len(self.leaves))], len(pieces) - (last - first + 1)
        grown = self.planted(
            self.leaves[:first] + pieces + self.leaves[last + 1 :],
            own[:first] + [0] * len(pieces) + own[last + 1 :],
            self.leaf,
        )
        self.leaves, self.chars, self.tokens, self.size = grown.leaves, grown.chars, grown.tokens, grown.size
        self.dirty = {i for i in self.dirty if i < first} | set(range(first, first + len(pieces))) | {
            i + more
            for i in self.dirty
            if i > last
        }

    def pending(self) -> list[str]:
        """The texts of the dirty leaves, in order."""
        return [self.leaves[i] for i in sorted(self.dirty)]

    def settle(self, counts: list[int]) -> None:
        """Take the tokens of the dirty leaves, in their order, and renew the sums above them."""
        for i, n in zip(sorted(self.dirty), counts, strict=True):
            at = self.size + i
            more, tokens = n - self.tokens[at], self.tokens
            while more and at:
                tokens[at] += more
                at //= 2
        self.dirty.clear()

    def text(self) -> str:
        return "".join(self.leaves)

    def total(self) -> int:
        return self.tokens[1]


_TREE = [("leaves", pa.list_(pa.string())), ("chars", pa.list_(pa.int32())), ("tokens", pa.list_(pa.int32()))]
TREES = "doc_id long, leaves array<string>, chars array<int>, tokens array<int>"
_PLANTED = pa.schema([("doc_id", pa.int64()), *_TREE])


def _encoder(tokenizer: str):
    encoder = encoder_of(tokenizer)
    if not encoder.by_word:
        raise ValueError("the tokenizer keeps white space, so its counts can't be summed over parts of a text")
    return encoder


def plant(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = 512) -> DataFrame:
    """One row per document: doc_id and its tree (TREES). Each text is encoded here, once."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        encoder = _encoder(tokenizer)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in groups_of(texts):
                parts = [cut(t or "", leaf) for t in texts[a:b]]
                counts, at, trees = encoder.counts([x for p in parts for x in p]).tolist(), 0, []
                for p in parts:
                    trees.append(CountTree.planted(p, counts[at : at + len(p)] or [0], leaf))
                    at += len(p)
                yield batch_of(_PLANTED, [batch.column(0).slice(a, b - a), *([getattr(t, n) for t in trees] for n, _ in _TREE)])

    return rows.mapInArrow(run, TREES)


OUT = "doc_id long, n_tokens_before long, n_tokens long, n_chars long, n_leaves long, n_leaves_touched long, n_chars_reencoded long, leaves array<string>, chars array<int>, tokens array<int>"
_COUNTS = ("doc_id", "n_tokens_before", "n_tokens", "n_chars", "n_leaves", "n_leaves_touched", "n_chars_reencoded")
_UPDATED = pa.schema([(n, pa.int64()) for n in _COUNTS] + _TREE)


def update_counts(trees: DataFrame, tokenizer: str, edits_col: str = "edits", leaf: int = 512) -> DataFrame:
    """One row per tree: counts before and after its edits, what was encoded for them, and the new tree (OUT).

    trees: TREES, as plant() or this function gave them, and edits_col:
    array<struct<start:long, length:long, new:string>>, in characters. The edited text is
    the leaves one after another.
    """
    prepare(trees.sparkSession)
    edit = lambda e: F.struct(
        e["start"].cast("long").alias("start"),
        e["length"].cast("long").alias("length"),
        e["new"].cast("string").alias("new"),
    )
    rows = trees.select("doc_id", "leaves", "chars", "tokens", F.transform(F.coalesce(F.col(edits_col), F.array()), edit).alias("edits"))

    def run(batches):
        encoder = _encoder(tokenizer)
        for batch in batches:
            ids, *sums, edits = (batch.column(k).to_pylist() for k in range(5))
            made = [CountTree(*own, leaf) for own in zip(*sums, strict=True)]
            cols = [[] for _ in _COUNTS]
            before = [t.total() for t in made]
            for t, own in zip(made, edits, strict=True):
                for e in own:
                    if e is not None:
                        t.replace(e["start"] or 0, e["length"] or 0, e["new"] or "")
            pending = [t.pending() for t in made]
            counts, at = encoder.counts([x for p in pending for x in p]).tolist(), 0
            for d, n, t, p in zip(ids, before, made, pending, strict=True):
                t.settle(counts[at : at + len(p)])
                at += len(p)
                for c, v in zip(cols, (d, n, t.total(), t.chars[1], sum(map(bool, t.leaves)), t.touched, sum(map(len, p))), strict=True):
                    c.append(v)
            yield batch_of(_UPDATED, [*cols, *([getattr(t, n) for t in made] for n, _ in _TREE)])

    return rows.mapInArrow(run, OUT)


def n_chars(chars: str = "chars") -> Column:
    """The characters of a tree's text, from its root."""
    return F.element_at(chars, 2).cast("long")


def edited_text(leaves: str = "leaves") -> Column:
    return F.array_join(leaves, "")
