"""Quality rules from repetition inside a document.

The words of a document are sorted into a suffix array by doubling: after round r a
position's rank names its next 2^r words, and only positions that still tie are sorted on.
Longest common prefixes of neighbours come from the rounds' ranks, from the longest round
down. Neighbours that share `min_words` words or more bound the intervals of maximal
repeats; their spans are united.

A document is rejected if united spans cover more than `max_covered` of its words, or its
longest repeat has more than `max_longest_words` words and `max_longest` of the document.

Null texts have no words. Texts without words have 0 everywhere and fail the length rule.
Nothing crosses rows, so ties, repeated rows and hot keys change nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch_of, extended, ids_and_texts, prepare, slices, text_buffers, word_hashes, word_spans

SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Rules:
    min_words: int = 8
    max_covered: float = 0.3
    max_longest_words: int = 50
    max_longest: float = 0.2


def repeats(words: np.ndarray, per_text: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text: words inside substrings of min_words words or more that occur twice or more in it, and the longest such substring's words.

    words: a number for each word of all texts, one after another.
    """
    n = len(words)
    covered, longest = np.zeros(len(per_text), np.int64), np.zeros(len(per_text), np.int64)
    if not n:
        return covered, longest
    doc = np.repeat(np.arange(len(per_text), dtype=np.int32), per_text)
    end = np.repeat(np.cumsum(per_text), per_text)
    rank, sa = np.zeros(n, np.int64), np.zeros(n, np.int64)

    def place(at: np.ndarray, first: np.ndarray, second: np.ndarray, base: np.ndarray | None) -> np.ndarray:
        """Sort positions by (first, second), put them into the suffix order from each first's base on, and name each run of equals by its place; the positions that are still tied."""
        order = np.lexsort((second, first))
        at, first, second = at[order], first[order], second[order]
        new = np.ones(len(at), bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        group = np.ones(len(at), bool)
        group[1:] = first[1:] != first[:-1]
        index = np.arange(len(at))
        put = index if base is None else first + index - np.maximum.accumulate(np.where(group, index, 0))
        sa[put] = at
        rank[at] = np.maximum.accumulate(np.where(new, put, 0)) if base is None else put[np.maximum.accumulate(np.where(new, index, 0))]
        tied = ~new
        tied[:-1] |= ~new[1:]
        return at[tied]

    at = place(np.arange(n), doc, words, None)
    levels, length = [rank.copy()], 1
    while len(at):
        far = at + length
        at = place(at, rank[at], np.where(far < end[at], rank[np.minimum(far, n - 1)] + 1, 0), rank)
        levels.append(rank.copy())
        length *= 2
    low = min(min_words.bit_length() - 1, len(levels) - 1)
    near = np.flatnonzero(levels[low][sa[1:]] == levels[low][sa[:-1]])
    a, b = sa[near], sa[near + 1]
    lcp = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + lcp, b + lcp
        eq = (x < end[a]) & (y < end[b])
        eq[eq] = levels[k][x[eq]] == levels[k][y[eq]]
        lcp += np.where(eq, 1 << k, 0)
    good = lcp >= min_words
    a, b, lcp = a[good], b[good], lcp[good]
    if not len(a):
        return covered, longest
    delta = np.zeros(n + 1, np.int64)
    for p in (a, b):
        np.add.at(delta, p, 1)
        np.add.at(delta, p + lcp, -1)
    inside = np.cumsum(delta[:-1]) > 0
    covered += np.bincount(doc[inside], minlength=len(per_text))
    np.maximum.at(longest, doc[a], lcp)
    return covered, longest


NAMES = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "longest_repeat")
_ARROW = pa.schema([(n, pa.int64()) for n in NAMES])
_WHITE = " \t\n\v\f\r"


def line_repeats(text: str) -> int:
    """Lines with a word that equal an earlier one."""
    lines = [x for x in text.split("\n") if x.strip(_WHITE)]
    return len(lines) - len(set(lines))


def measures(column: pa.Array, rules: Rules) -> list[pa.Array]:
    """The columns of NAMES but the id, for a column of texts."""
    data, offsets = text_buffers(column)
    texts = column.to_pylist()
    out: list[list] = [[] for _ in NAMES[1:]]
    for i, j in slices(offsets):
        own, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        starts, ends, per = word_spans(own, at)
        covered, longest = repeats(word_hashes(own, starts, ends), per, rules.min_words)
        heads = np.concatenate([[0], np.cumsum((own & 0xC0) != 0x80)])[at]
        blanks = np.concatenate([[0], np.cumsum(np.isin(own, np.frombuffer(_WHITE.encode(), np.uint8)))])[at]
        symbols = np.concatenate([[0], np.cumsum(np.isin(own, np.frombuffer(SYMBOLS, np.uint8)))])[at]
        lines = np.array([line_repeats(t) if t else 0 for t in texts[i:j]])
        for c, v in zip(out, (per, np.diff(heads) - np.diff(blanks), np.diff(symbols), lines, covered, longest), strict=True):
            c.append(v)
    return [pa.array(np.concatenate(c) if c else [], pa.int64()) for c in out]


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """One row per document, with NAMES: counts, words in repeats and the longest repeat."""
    prepare(docs.sparkSession)

    def run(batches):
        for batch in batches:
            yield batch_of(_ARROW, [batch.column(0), *measures(batch.column(1), rules)])

    return ids_and_texts(docs, id_col, text_col).mapInArrow(run, ", ".join(f"{n} long" for n in NAMES))


def verdicts(rules: Rules = Rules(), prefix: str = "") -> tuple[Column, Column]:
    """Columns over the measures: whether the base rules fail, and whether the document stays."""
    n, repeat, longest = (F.col(prefix + x) for x in ("n_words", "n_repeat_words", "longest_repeat"))
    failed = (n < 20) | (F.lit(100) * repeat > F.lit(30) * n)
    bad = (repeat > F.lit(rules.max_covered) * n) | (longest > rules.max_longest_words) & (longest > F.lit(rules.max_longest) * n)
    return failed, ~failed & ~bad


def annotate(docs: DataFrame, text_col: str = "text", rules: Rules = Rules(), prefix: str = "__q_") -> DataFrame:
    """docs with the measures as further columns, whose names have the prefix."""
    return extended(docs, text_col, ", ".join(f"{prefix}{n} long" for n in NAMES[1:]), lambda: lambda column: measures(column, rules))
