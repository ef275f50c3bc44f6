"""Benchmark decontamination with one Aho-Corasick automaton.

Texts are normalised to words (lower-case A-Z, digits and everything beyond ASCII), which
single spaces join. The automaton holds each window of `window` words of an item, or all
words of a shorter one, with a space at both ends, so matches begin and end with words.
One scan of a text finds all occurrences. Word numbers lead back to offsets in the
original text.

The benchmark is a fixed set of tests: it is taken in blocks of at most `block_chars`
characters, checked by a count, and each block's automaton scans the texts once. One block
is the usual case; its automaton is built once per task. With several, a task gathers
`run_chars` of text before it builds one after the other, so that it holds one at a time.

Null texts and texts without words have no hits; items without words match nothing. Items
that share an id count once; those without an id hit words like others, and count as one
item together. Repeated rows are scanned each. Very long texts are one row of work. Empty
tables give no rows, an empty benchmark no hits.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_prefix, ids_and_texts, prepare

_TABLE = bytes((c + 32 if 65 <= c <= 90 else c) if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
WINDOW = 10


def normalised(text: str | None) -> list[bytes]:
    return text.encode("utf-8").translate(_TABLE).split() if text else []


def windows(words: list[bytes], size: int) -> list[bytes]:
    if not words:
        return []
    return [b" " + b" ".join(words[i : i + size]) + b" " for i in range(max(1, len(words) - size + 1))]


def automaton(items: list[tuple[int | None, str | None]], size: int = WINDOW):
    """The automaton; a window's value is its number of words and the ids of the items it comes from."""
    import ahocorasick

    found: dict[bytes, set] = {}
    n_words: dict[bytes, int] = {}
    for item, text in items:
        words = normalised(text)
        for w in windows(words, size):
            found.setdefault(w, set()).add(item)
            n_words[w] = min(size, len(words))
    if not found:
        return None
    out = ahocorasick.Automaton()
    for w, own in found.items():
        out.add_word(w.decode("utf-8"), (n_words[w], frozenset(own)))
    out.make_automaton()
    return out


def scan(words: list[bytes], machine) -> tuple[list[tuple[int, int]], set]:
    """Merged runs (first, past the last) of hit words, and the ids of items that occur."""
    if machine is None or not words:
        return [], set()
    text = (b" " + b" ".join(words) + b" ").decode("utf-8")
    hits = list(machine.iter(text))
    if not hits:
        return [], set()
    spaces = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 32)
    runs, items = [], set()
    last = np.searchsorted(spaces, [e for e, _ in hits])  # the space after the match closes word number last - 1
    spans = sorted((int(e) - n, int(e)) for e, (_, (n, _)) in zip(last, hits, strict=True))
    for _, (_, own) in hits:
        items |= own
    for a, b in spans:
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    return [(a, b) for a, b in runs], items


OUT = "doc_id long, n_words long, runs array<struct<first:long,past:long,start:long,end:long>>, items array<long>"
_RUN = pa.struct([("first", pa.int64()), ("past", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])


def _blocks(items: list[tuple[int | None, str | None]], most: int) -> list[list[tuple[int | None, str | None]]]:
    out, size = [[]], 0
    for x in items:
        if out[-1] and size + len(x[1] or "") > most:
            out.append([])
            size = 0
        out[-1].append(x)
        size += len(x[1] or "")
    return out


def _runs(batches, most: int):
    """Batches with one column of texts at the end, put together to runs of at least `most` characters."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.columns[-1].nbytes
        if size >= most:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


class Scanner:
    """Finds a benchmark's windows in texts. blocks: a broadcast of the benchmark's blocks."""

    def __init__(self, blocks, window: int, run_chars: int):
        self.blocks, self.window, self.most = blocks, window, run_chars

    def batches(self, batches, n_own: int, names: list[str]):
        """Each row's first n_own columns, then n_words, runs and items of its last column, in batches of rows."""
        blocks = self.blocks.value
        alone = automaton(blocks[0], self.window) if len(blocks) == 1 else None
        for t in _runs(batches, 0 if len(blocks) == 1 else self.most):
            own = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in t.columns[:n_own]]
            made = self._scanned(t.columns[-1].to_pylist(), blocks, alone)
            yield pa.RecordBatch.from_arrays([c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in own] + made, names=names)

    def _scanned(self, texts: list[str | None], blocks: list, alone) -> list[pa.Array]:
        n_words, found = [], [([], set()) for _ in texts]
        for k, b in enumerate(blocks):
            machine = alone or automaton(b, self.window)
            for text, (runs, items) in zip(texts, found, strict=True):
                words = normalised(text)
                if not k:
                    n_words.append(len(words))
                new, own = scan(words, machine)
                runs.extend(new)
                items.update(own)
        out_runs, out_items = [], []
        for text, (runs, items) in zip(texts, found, strict=True):
            merged = []
            for a, b in sorted(runs):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            spans = [m.span() for m in _WORD.finditer(text)] if merged else []
            out_runs.append([{"first": a, "past": b, "start": spans[a][0], "end": spans[b - 1][1]} for a, b in merged])
            out_items.append(sorted(items, key=lambda i: (i is None, i or 0)))
        return [pa.array(n_words, pa.int64()), pa.array(out_runs, pa.list_(_RUN)), pa.array(out_items, pa.list_(pa.int64()))]


def _scanner(
    docs: DataFrame,
    benchmark: DataFrame,
    item_col: str,
    item_text_col: str,
    window: int,
    block_chars: int,
    most_chars: int,
    run_chars: int,
) -> Scanner:
    spark = docs.sparkSession
    prepare(spark)
    wanted = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text_col).cast("string").alias("t"))
    size = wanted.agg(F.sum(F.length("t"))).first()[0] or 0
    if size > most_chars:
        raise ValueError(f"the benchmark has {size} characters; at most {most_chars} can be scanned for")
    return Scanner(
        spark.sparkContext.broadcast(_blocks([(r[0], r[1]) for r in wanted.orderBy("i", "t").collect()], block_chars)),
        window,
        run_chars,
    )


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_chars: int = 4_000_000,
    most_chars: int = 200_000_000,
    run_chars: int = 64 << 20,
) -> DataFrame:
    """Per document: n_words, runs of hit words with their offsets (characters) in the original text, and the items' ids, null last.

    A benchmark of more than most_chars characters is refused, as it goes to every worker.
    """
    scanner = _scanner(docs, benchmark, item_col, item_text_col, window, block_chars, most_chars, run_chars)
    names = ["doc_id", "n_words", "runs", "items"]
    return ids_and_texts(docs, id_col, text_col).mapInArrow(lambda batches: scanner.batches(batches, 1, names), OUT)


def annotate(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    prefix: str = "__b_",
    block_chars: int = 4_000_000,
    most_chars: int = 200_000_000,
    run_chars: int = 64 << 20,
) -> DataFrame:
    """docs with n_words, runs and items as further columns, whose names have the prefix and must be new."""
    scanner = _scanner(docs, benchmark, item_col, item_text_col, window, block_chars, most_chars, run_chars)
    fields = T.StructType.fromDDL(OUT).fields[1:]
    schema = T.StructType(list(docs.schema) + [T.StructField(prefix + f.name, f.dataType) for f in fields])
    n_own, names = len(docs.columns), schema.names
    rows = docs.select("*", F.col(f"`{text_col}`").cast("string").alias(free_prefix(docs) + "text"))
    return rows.mapInArrow(lambda batches: scanner.batches(batches, n_own, names), schema)
