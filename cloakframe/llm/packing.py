"""Vector bin packing of documents into training sequences.

Each piece is a vector of tokens, segments (one) and loss-bearing tokens. A sequence is
a bin with a limit in each dimension. The dot-product heuristic fills one bin at a time:
of the pieces that fit, it takes the one whose vector, weighted by what is left of the
bin, has the largest product. Where nothing fits but tokens are left, the piece whose
vector, cut to the bin, has the largest product is cut. So all bins but a block's last are
full in some dimension.

A text may begin with a prompt, whose tokens bear no loss; they are its leading ones. A
task packs what it reads: there is no shuffle, and a task holds `block` documents or 4
million tokens and one document at most. A bin that the segments, the loss or the block's
end leave with over 1 / 128 of padding is cut by powers of two, which need none.

Null and empty texts are the end id alone; null prompts are empty. Empty tables give no
rows. Repeated rows are packed as often as they come, ties go by the order read. Very long
texts fill many sequences.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch_of, prepare
from .tokens import END_ID, encoder_of, groups_of


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 256
    loss_tokens: int = 2048


def fill(tokens: np.ndarray, loss: np.ndarray, limits: Limits) -> list[list[tuple[int, int, int]]]:
    """Bins of (item, start, length). loss[i] of item i's tokens bear loss: its last ones. A cut leaves them with the later part.

    An empty bin takes the piece, cut to the bin, with the largest product; then the best of
    those that fit whole, and if none does, the best cut.
    """
    cap = np.array([limits.tokens, limits.segments, limits.loss_tokens], float)
    left, left_loss, at = tokens.astype(np.int64).copy(), loss.astype(np.int64).copy(), np.zeros(len(tokens), np.int64)
    order = np.argsort(-left, kind="stable")
    alive = np.ones(len(order), bool)
    bins: list[list[tuple[int, int, int]]] = []
    n_alive = len(order)
    while n_alive:
        room, own = [limits.tokens, limits.segments, limits.loss_tokens], []
        while n_alive and room[0] > 0 and room[1] > 0:
            if n_alive < len(order) // 2:
                order, alive = order[alive], np.ones(n_alive, bool)
            t, q = left[order], left_loss[order]
            free = t - q
            n = np.minimum(np.minimum(t, room[0]), free + room[2])
            score = n * (room[0] / cap[0] ** 2) + room[1] / cap[1] ** 2 + np.maximum(0, n - free) * (room[2] / cap[2] ** 2)
            good = alive & (n > 0)
            if own and (whole := good & (n == t)).any():
                good = whole
            k = int(np.argmax(np.where(good, score, -1.0)))
            if not good[k]:
                break
            i, take = order[k], int(n[k])
            used = max(0, take - int(free[k]))
            own.append((int(i), int(at[i]), take))
            room = [room[0] - take, room[1] - 1, room[2] - used]
            at[i] += take
            left[i] -= take
            left_loss[i] -= used
            if not left[i]:
                alive[k] = False
                n_alive -= 1
        if not own:  # no piece can enter an empty bin
            raise ValueError("limits leave no room for one token")
        bins.append(own)
    return bins


def _pow2_cut(pieces: list[tuple[int, int, int]], most: int) -> list[list[tuple[int, int, int]]]:
    """The pieces of a bin that isn't full, dealt to bins whose lengths are powers of two."""
    out, todo, total = [], list(pieces), sum(p[2] for p in pieces)
    while total:
        want = min(most, 1 << (total.bit_length() - 1))
        total -= want
        own = []
        while want:
            i, s, n = todo.pop(0)
            take = min(n, want)
            own.append((i, s, take))
            if take < n:
                todo.insert(0, (i, s + take, n - take))
            want -= take
        out.append(own)
    return out


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long, padding long, ids binary"
_ARROW = pa.schema(
    [
        (n, pa.int64())
        for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens", "padding")
    ] + [("ids", pa.binary())]
)


def pack(
    docs: DataFrame,
    tokenizer: str,
    limits: Limits = Limits(),
    id_col: str = "doc_id",
    text_col: str = "text",
    prompt: Column | None = None,
    block: int = 4096,
    with_ids: bool = True,
    table_words: int = 1_000_000,
) -> DataFrame:
    """One row per piece, in SCHEMA; ids are little-endian unsigned 32-bit, or null without with_ids.

    prompt: the text that a row's text begins with and that bears no loss; without it all
    tokens bear loss. sequence_id is unique, and the same each time for the same files and
    splits. table_words: how many different words a worker remembers. padding is given on a
    sequence's last piece, else 0.
    """
    prepare(docs.sparkSession)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).cast("string").alias("text"),
        *([] if prompt is None else [prompt.cast("string").alias("prompt")]),
    )

    def run(batches):
        encoder = encoder_of(tokenizer, table_words)
        sequence = (TaskContext.get().partitionId()) << 36
        held: list[tuple[int, np.ndarray, int]] = []

        def out(bins):
            nonlocal sequence
            cols = [[] for _ in range(10)]
            for own in bins:
                offset, length = 0, sum(p[2] for p in own)
                for j, (i, s, n) in enumerate(own):
                    doc, ids, skip = held[i]
                    raw = ids[s : s + n].astype("<u4").tobytes()
                    pad = limits.tokens - length if j == len(own) - 1 and length & (length - 1) else 0
                    for c, v in zip(
                        cols,
                        (
                            doc,
                            s,
                            n,
                            zlib.crc32(raw),
                            len(ids),
                            sequence,
                            offset,
                            n - max(0, min(n, skip - s)),
                            pad,
                            raw if with_ids else None,
                        ),
                        strict=True,
                    ):
                        c.append(v)
                    offset += n
                sequence += 1
            return batch_of(_ARROW, cols)

        def filled():
            bins = fill(np.array([len(ids) for _, ids, _ in held]), np.array([len(ids) - skip for _, ids, skip in held]), limits)
            for own in bins:
                if limits.tokens - sum(p[2] for p in own) > limits.tokens // 128:
                    yield from _pow2_cut(own, limits.tokens)
                else:
                    yield own

        size = 0
        for batch in batches:
            docs_, texts, *prompts = batch.column(0).to_pylist(), batch.column(1), *(c.to_pylist() for c in batch.columns[2:])
            for a, b in groups_of(texts):
                ids, lens, skips = encoder.encode_with_heads(texts.slice(a, b - a), prompts[0][a:b] if prompts else None)
                ends = np.cumsum(lens)
                for k in range(a, b):
                    own = np.append(ids[ends[k - a] - lens[k - a] : ends[k - a]], np.uint32(END_ID))
                    held.append((docs_[k], own, int(skips[k - a])))
                    size += len(own)
                if len(held) >= block or size >= 4 << 20:
                    yield out(filled())
                    held.clear()
                    size = 0
        if held:
            yield out(filled())

    return rows.mapInArrow(run, SCHEMA)
