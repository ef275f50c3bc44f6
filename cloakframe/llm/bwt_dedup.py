"""Removal of repeated passages by a column-wise collection Burrows-Wheeler transform.

A byte goes if a string of `min_bytes` (L) bytes that covers it also starts earlier: in a
document with a smaller id, or earlier in its own. Ids that are equal go by file order;
documents without an id come first. Null and empty texts have no bytes. Matches never
cross rows. Empty tables give no rows; very long texts are blocks of their own.

A transform of all texts at once would need as many rounds as the longest text has bytes.
So the texts are first cut where equal passages are cut alike:

1. Each L-byte window has an anchor: of its 32-byte pieces, the leftmost with the least
   hash. Neighbouring windows with one anchor form a string of less than 2 L bytes. Equal
   windows have equal anchors at equal places, so both of a repeated pair lie in strings
   with the same anchor piece. Blocks of text ask hash buckets which anchor pieces occur
   elsewhere; strings around other anchors can't repeat and end here.
2. Blocks ask other buckets for the first place of each remaining string. Equal strings
   are dropped but for the first, whose windows come earlier: all windows of the others
   are repeats. A block asks once for a string, so the most frequent passage costs a
   bucket one row per block.
3. What is left are different strings with a common anchor. An anchor with more than `crowd`
   of them is no single task's work: its strings are cut in two by the place of the anchor
   in the window. Windows of a part have more bytes in common, and these make a new, longer
   anchor; equal parts are dropped but for the first, as above. This goes on until no
   anchor is crowded, at the latest when parts are single windows and all with one anchor
   are equal.
4. By buckets of anchors, windows that can't be shared are cut off, equal parts kept once,
   and the collection transform of the rest is built column by column. Each round inserts,
   for every string, the symbol before the suffix placed last, at the rank that the
   transform so far gives, and updates the common prefix with the neighbour before and that
   of the neighbour behind: one more than the least since the symbol stood there last. Both
   are sequences that a round reads once for the ranks and once to merge the new entries
   in, in windows of `window` entries; over `most` bytes they lie in files. Where common
   prefixes reach L, entries form an interval, and all but its earliest start are repeats.
5. Each block unites its windows and gives the rest.

Files are the scratch of one task, in Spark's own local folders; no other task reads them,
and a task that is run again writes them anew.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BYTE64, batch_of, drop, drop_path, ids_and_texts, mix64, new_path, powers, prepare, stored, table_bytes, text_buffers

PIECE = 32
BLOCK_BYTES = 4 << 20
_T32 = (_BYTE64 >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_T64 = mix64(_BYTE64 ^ np.uint64(0xA5A5A5A5A5A5A5A5))
NO_ID = np.int64(-(1 << 63))


def _sliding(x: np.ndarray, width: int, f) -> np.ndarray:
    """f over each run of `width` values, by doubling."""
    n, out = 1, x
    while 2 * n <= width:
        out = f(out[:-n], out[n:])
        n *= 2
    rest = width - n
    return f(out[: len(out) - rest], out[rest:]) if rest else out


def anchored(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all windows: text number, anchor place, first and last window start (places in data)."""
    none = tuple(np.zeros(0, np.int64) for _ in range(4))
    reach = size - PIECE
    if len(data) < size:
        return none
    with np.errstate(over="ignore"):
        h, n, c = _T32[data], 1, np.uint32(0x9E3779B1)
        while n < PIECE:
            h = h[:-n] * c + h[n:]
            c = c * c + np.uint32(2)
            n *= 2
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        h = h ^ (h >> np.uint32(12))
    least = _sliding(h, reach + 1, np.minimum)
    valid = np.ones(len(least), bool)
    for e in offsets[1:]:
        valid[max(0, e - size + 1) : e] = False
    ends = np.where(valid, least, np.uint32(0))
    most = _sliding(np.concatenate([np.zeros(reach, np.uint32), ends, np.zeros(len(h) - len(ends), np.uint32)]), reach + 1, np.maximum)
    some = _sliding(np.concatenate([np.zeros(reach, bool), valid, np.zeros(len(h) - len(ends), bool)]), reach + 1, np.logical_or)
    at = np.flatnonzero((most == h) & some)
    doc = np.searchsorted(offsets, at, "right") - 1
    value = h[at]
    while True:
        same = np.concatenate([[False], doc[1:] == doc[:-1]]) if len(at) else np.zeros(0, bool)
        before = np.concatenate([[0], at[:-1]]) if len(at) else at
        lower = np.concatenate([[False], value[1:] < value[:-1]]) if len(at) else same
        lo = np.where(same & ~lower, np.maximum(before + 1, at - reach), np.maximum(at - reach, offsets[doc]))
        hi = np.minimum(at, offsets[doc + 1] - size)
        hi[:-1] = np.where(same[1:], np.minimum(hi[:-1], lo[1:] - 1), hi[:-1])
        good = lo <= hi
        if good.all():
            return doc, at, lo, hi
        doc, at, value = doc[good], at[good], value[good]


def piece_hashes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64-bit hashes of the anchor pieces."""
    if not len(at):
        return np.zeros(0, np.uint64)
    raw = np.lib.stride_tricks.as_strided(
        np.ascontiguousarray(data).view(np.uint8)[: len(data) - 7].view(np.uint8),
        (len(data) - 7, 8),
        (1, 1),
    )
    out = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(0, PIECE, 8):
            word = raw[at + k].view(np.uint64).ravel()
            out = mix64(out * np.uint64(0xD6E8FEB86659FD93) + word + np.uint64(k + 1))
    return out


def span_hashes(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of data[a:b] for each pair."""
    out = []
    with np.errstate(over="ignore"):
        up, down = powers(len(data) + 1)
        for table in (_BYTE64, _T64):
            total = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(table[data] * up[: len(data)], out=total[1:])
            out.append(mix64((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64)))
    return out[0], out[1]


class _Run:
    """Numbers that are written in order and read in windows: in memory up to `most` bytes, beyond that in a file."""

    def __init__(self, dtype, most: int, window: int):
        self.dtype, self.most, self.window = np.dtype(dtype), most, window
        self.parts, self.size, self.file = [], 0, None

    def append(self, x: np.ndarray) -> None:
        x = x.astype(self.dtype, copy=False)
        self.size += len(x)
        self.parts.append(x)
        if self.file or self.size * self.dtype.itemsize > self.most:
            if not self.file:
                local = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
                self.file = tempfile.TemporaryFile(dir=local if os.path.isdir(local) else None)
            for part in self.parts:
                part.tofile(self.file)
            self.parts = []

    def windows(self):
        if not self.file:
            x = self.parts[0] if len(self.parts) == 1 else np.concatenate(self.parts) if self.parts else np.zeros(0, self.dtype)
            self.parts = [x]
            for a in range(0, len(x), self.window):
                yield x[a : a + self.window]
            return
        self.file.flush()
        self.file.seek(0)
        for a in range(0, self.size, self.window):
            yield np.fromfile(self.file, self.dtype, min(self.window, self.size - a))


def _least(x: np.ndarray, a: np.ndarray, z: np.ndarray) -> np.ndarray:
    """The least of x[a : z + 1] for each pair, by minima over runs of powers of two."""
    out = np.empty(len(a), x.dtype)
    if not len(a):
        return out
    level = np.frexp((z - a + 1).astype(float))[1] - 1
    runs = x
    for k in range(int(level.max()) + 1):
        own = np.flatnonzero(level == k)
        out[own] = np.minimum(runs[a[own]], runs[z[own] - (1 << k) + 1])
        runs = np.minimum(runs[: -(1 << k)], runs[1 << k :])
    return out


class Collection:
    """The transform of a collection of strings, built a symbol per string and round.

    Entries are the suffixes so far, in order; equal ones go by string number. Per entry: the
    symbol before it (0 at a string's start), the prefix in common with the entry before (up
    to `cap`), the string's number and the suffix's length.
    """

    def __init__(self, strings: list[bytes], cap: int, most: int = 64 << 20, window: int = 1 << 20):
        self.m, self.cap, self.most, self.window = len(strings), cap, most, window
        self.lens = np.fromiter(map(len, strings), np.int64, self.m)
        self.flat = np.frombuffer(b"".join(strings), np.uint8)
        self.ends = np.cumsum(self.lens)
        used = np.flatnonzero(np.bincount(self.flat, minlength=256))
        self.code = np.zeros(256, np.int64)
        self.code[used] = np.arange(1, len(used) + 1)
        self.kinds = (np.uint8 if len(used) < 256 else np.uint16, np.uint8 if cap < 255 else np.uint16, np.int32, np.int32)
        self.counts = np.zeros(len(used) + 1, np.int64)
        everyone = np.arange(self.m)
        self.runs = self._empty()
        symbols = self._symbols(everyone, 0)
        self._add(symbols, np.zeros(self.m), everyone, np.zeros(self.m))
        place, live = everyone, everyone  # entries placed last, in order, and whose they are
        for length in range(1, int(self.lens.max(initial=0)) + 1):
            on = symbols > 0
            place, live, symbols = self._insert(place[on], live[on], length)

    def _empty(self) -> list[_Run]:
        return [_Run(k, self.most, self.window) for k in self.kinds]

    def _add(self, *columns: np.ndarray) -> None:
        for run, x in zip(self.runs, columns, strict=True):
            run.append(x)
        self.counts += np.bincount(columns[0], minlength=len(self.counts))

    def _symbols(self, who: np.ndarray, length: int) -> np.ndarray:
        """The symbols before the suffixes of this length."""
        out = np.zeros(len(who), np.int64)
        more = self.lens[who] > length
        out[more] = self.code[self.flat[self.ends[who[more]] - length - 1]]
        return out

    def _ranked(self, place: np.ndarray):
        """Where the suffixes that begin one symbol before each place go, and their common prefixes with the entries before; the same of old entries behind them."""
        n = len(self.counts)
        base = self.m + np.cumsum(np.concatenate([[0, 0], self.counts[1:]]))[:n]
        to, lcp = np.empty(len(place), np.int64), np.empty(len(place), np.int64)
        behind, behind_lcp = [], []
        seen, least, was_new = np.zeros(n, np.int64), np.full(n, self.cap, np.int64), np.zeros(n, bool)
        s = i = 0
        for b, c in zip(self.runs[0].windows(), self.runs[1].windows(), strict=True):
            k = int(np.searchsorted(place, s + len(b)))
            own = place[i:k] - s
            is_new = np.zeros(len(b), bool)
            is_new[own] = True
            order = np.argsort(b, kind="stable")
            sym, new = b[order], is_new[order]
            heads = np.flatnonzero(np.concatenate([[True], sym[1:] != sym[:-1]]))
            after_new = np.concatenate([[False], new[:-1]])
            after_new[heads] = was_new[sym[heads]]
            t = np.flatnonzero((new | after_new) & (sym > 0))
            head = np.searchsorted(heads, t, "right") - 1
            at, x = order[t], sym[t].astype(np.int64)
            p = base[x] + seen[x] + t - heads[head]
            up_to = np.minimum.accumulate(c)
            first = heads[head] == t
            low = np.empty(len(t), np.int64)
            low[~first] = _least(c, order[t[~first] - 1] + 1, at[~first])
            low[first] = np.minimum(least[x[first]], up_to[at[first]])
            low = np.where(first & (seen[x] == 0), 0, np.minimum(low + 1, self.cap))
            fresh = new[t]
            which = i + np.searchsorted(own, at[fresh])
            to[which], lcp[which] = p[fresh], low[fresh]
            behind.append(p[~fresh])
            behind_lcp.append(low[~fresh])
            tails = np.concatenate([heads[1:], [len(b)]]) - 1
            x, last = sym[heads].astype(np.int64), order[tails]
            from_on = np.concatenate([np.minimum.accumulate(c[::-1])[::-1], [self.cap]])
            least = np.minimum(least, up_to[-1])
            least[x], was_new[x] = from_on[last + 1], new[tails]
            seen[x] += tails - heads + 1
            s, i = s + len(b), k
        return to, lcp, np.concatenate(behind), np.concatenate(behind_lcp)

    def _insert(self, place: np.ndarray, live: np.ndarray, length: int):
        """One round: the suffixes of this length of the strings that have one."""
        to, lcp, behind, behind_lcp = self._ranked(place)
        by = np.argsort(to)
        to, live = to[by], live[by]
        symbols = self._symbols(live, length)
        fresh = (symbols, lcp[by], live, np.full(len(to), length))
        at = to - np.arange(len(to))  # before which old entry
        by = np.argsort(behind)
        behind, behind_lcp = behind[by], behind_lcp[by]
        behind = behind - np.searchsorted(to, behind)
        old, self.runs = self.runs, self._empty()
        self.counts += np.bincount(symbols, minlength=len(self.counts))
        s = i = h = 0
        for columns in zip(*(r.windows() for r in old), strict=True):
            e = s + len(columns[0])
            k = len(at) if e == old[0].size else int(np.searchsorted(at, e))
            g = int(np.searchsorted(behind, e))
            columns = list(columns)
            columns[1] = columns[1].copy()
            columns[1][behind[h:g] - s] = behind_lcp[h:g]
            for run, x, y in zip(self.runs, columns, fresh, strict=True):
                run.append(np.insert(x, at[i:k] - s, y[i:k]) if k > i else x)
            s, i, h = e, k, g
        return to, live, symbols

    def entries(self):
        """(string numbers, starts, common prefixes) of all entries, in windows."""
        for _, lcp, who, length in zip(*(r.windows() for r in self.runs), strict=True):
            yield who, self.lens[who] - length, lcp


def later_windows(
    strings: list[bytes],
    order_of: np.ndarray,
    size: int,
    most: int = 64 << 20,
    window: int = 1 << 20,
) -> tuple[np.ndarray, np.ndarray]:
    """(string number, start) of all windows of `size` bytes that also occur in the strings at an earlier place.

    order_of: (n, 2) keys of the strings: a window's place is its string's first key, then
    the second plus its start.
    """
    none = np.zeros(0, np.int64)
    sids, starts, groups, group, last = [none], [none], [none], 0, None
    for who, start, lcp in Collection(strings, size, most, window).entries():
        joined = lcp >= size  # in one interval with the entry before
        number = group + np.cumsum(~joined)
        keep = joined.copy()
        keep[:-1] |= joined[1:]
        if joined[0] and last and not last[3]:
            for x, v in zip((sids, starts, groups), last, strict=False):
                x.append(np.array([v], np.int64))
        for x, v in zip((sids, starts, groups), (who, start, number), strict=True):
            x.append(v[keep].astype(np.int64))
        group, last = int(number[-1]), (who[-1], start[-1], number[-1], keep[-1])
    sid, start, interval = (np.concatenate(x) for x in (sids, starts, groups))
    k = np.lexsort((order_of[sid, 1] + start, order_of[sid, 0], interval))
    again = np.concatenate([[False], interval[k][1:] == interval[k][:-1]])[: len(k)]
    return sid[k][again], start[k][again]


def narrowed(strings: list[bytes], anchor: np.ndarray, piece: np.ndarray, size: int, grid: int = 9) -> tuple[np.ndarray, np.ndarray]:
    """The part (start, end) of each string that holds its windows that others with its anchor can share; empty if there is none.

    A window that starts o bytes before the anchor holds the size - grid + 1 bytes that start
    o // grid * grid before it. Only where these also occur around an equal anchor can the
    window be repeated.
    """
    lens = np.fromiter(map(len, strings), np.int64, len(strings))
    base = np.cumsum(lens) - lens
    flat = np.frombuffer(b"".join(strings), np.uint8)
    low, high = np.full(len(strings), 1 << 40), np.full(len(strings), -1)
    for o in range(0, size - PIECE + 1, grid):
        a = anchor - o
        b = a + size - grid + 1
        own = np.flatnonzero((a >= 0) & (b <= lens))
        if not len(own):
            continue
        x, _ = span_hashes(flat, base[own] + a[own], base[own] + b[own])
        with np.errstate(over="ignore"):
            _, at, counts = np.unique(mix64(x + piece[own].view(np.uint64)), return_inverse=True, return_counts=True)
        own = own[counts[at] > 1]
        low[own], high[own] = np.minimum(low[own], o), np.maximum(high[own], o)
    start = np.maximum(0, anchor - high - grid + 1)
    end = np.where(high >= 0, np.minimum(lens, anchor - low + size), 0)
    return np.where(end - start >= size, start, 0), np.where(end - start >= size, end, 0)


def repeated_windows(
    strings: list[bytes],
    anchor: np.ndarray,
    piece: np.ndarray,
    order_of: np.ndarray,
    size: int,
) -> tuple[np.ndarray, np.ndarray]:
    """later_windows() of strings that stand in the order of their places: parts that can't repeat are cut off first, and equal parts are sorted once."""
    a, b = narrowed(strings, anchor, piece, size)
    first: dict[bytes, int] = {}
    sids, starts = [], []
    for i in np.flatnonzero(b > a):
        if first.setdefault(strings[i][a[i] : b[i]], i) != i:
            starts.append(np.arange(a[i], b[i] - size + 1))
            sids.append(np.full(len(starts[-1]), i))
    own = np.fromiter(first.values(), np.int64, len(first))
    if len(own):
        keys = order_of[own].copy()
        keys[:, 1] += a[own]
        sid, start = later_windows(list(first), keys, size)
        sids.append(own[sid])
        starts.append(start + a[own][sid])
    none = [np.zeros(0, np.int64)]
    return np.concatenate(sids or none), np.concatenate(starts or none)


# ---- blocks ----

_BLOCKS = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("data", pa.binary())])
_ASK = pa.schema([("kind", pa.int32()), ("bucket", pa.int64()), ("block", pa.int64()), ("payload", pa.binary())])
_PLACE = np.dtype([("a", "<u8"), ("b", "<u8"), ("id", "<i8"), ("at", "<i8")])
_PAIR = np.dtype([("h", "<u8"), ("a", "<u8")])


def _blocks(docs: DataFrame, path: str, name: str, buckets: int) -> DataFrame:
    """The texts in blocks, as a table bucketed by block: joins with answers don't move it."""
    def run(batches):
        held, size, number = [], 0, 0

        def out():
            ids = [d for b in held for d in b[0]]
            ends = np.cumsum(np.concatenate([np.diff(b[1]) for b in held]))
            return batch_of(
                _BLOCKS,
                [[TaskContext.get().partitionId() << 32 | number], [ids], [ends.tolist()], [b"".join(b[2].tobytes() for b in held)]],
            )

        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            ids, a = batch.column(0).to_pylist(), 0
            while a < len(ids):
                b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + BLOCK_BYTES - size, "right")) - 1)
                held.append((ids[a:b], offsets[a : b + 1], data[offsets[a] : offsets[b]].copy()))
                size += int(offsets[b] - offsets[a])
                a = b
                if size >= BLOCK_BYTES * 3 // 4:
                    yield out()
                    held, size, number = [], 0, number + 1
        if held:
            yield out()

    spark = docs.sparkSession
    made = docs.mapInArrow(run, "block long, ids array<long>, ends array<long>, data binary")
    made.write.format("parquet").bucketBy(buckets, "block").option("path", path).option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


class _Block:
    """A block with its anchors, worked out in slices."""

    def __init__(self, block: int, ids: list, ends: list, data: bytes, size: int):
        self.block, self.size = block, size
        self.ids = np.array([NO_ID if d is None else d for d in ids], np.int64)
        self.offsets = np.concatenate([[0], np.array(ends, np.int64)])
        self.data = np.frombuffer(data, np.uint8)

    def anchors(self) -> None:
        parts, a, n = [], 0, len(self.ids)
        while a < n:
            b = max(a + 1, int(np.searchsorted(self.offsets, self.offsets[a] + (1 << 19), "right")) - 1)
            base = self.offsets[a]
            own = self.data[base : self.offsets[b]]
            doc, at, lo, hi = anchored(own, self.offsets[a : b + 1] - base, self.size)
            parts.append((doc + a, at + base, lo + base, hi + base))
            a = b
        self.doc, self.at, self.lo, self.hi = (
            np.concatenate(x) if parts else np.zeros(0, np.int64)
            for x in (zip(*parts, strict=True) if parts else ((),) * 4)
        )
        self.h = piece_hashes(self.data, self.at)
        self.pieces, self.piece, counts = np.unique(self.h, return_inverse=True, return_counts=True)
        self.often = counts > 1

    def candidates(self, answers: dict, buckets: int) -> None:
        """Keep the strings whose anchor piece occurs elsewhere, and hash them."""
        often = self.often | _flags(answers, 1, self.pieces, buckets)
        keep = often[self.piece]
        self.doc, self.at, self.lo, self.hi, self.h = (x[keep] for x in (self.doc, self.at, self.lo, self.hi, self.h))
        self.a, self.b = np.zeros(len(self.lo), np.uint64), np.zeros(len(self.lo), np.uint64)
        step = 1 << 19
        i = 0
        while i < len(self.lo):
            j = max(i + 1, int(np.searchsorted(self.lo, self.lo[i] + step)))
            base, past = self.lo[i], int(self.hi[i:j].max()) + self.size
            self.a[i:j], self.b[i:j] = span_hashes(self.data[base:past], self.lo[i:j] - base, self.hi[i:j] + self.size - base)
            i = j
        # The first place of each string in this block; documents go by id, then by order.
        k = np.lexsort((self.lo, self.ids[self.doc], self.b, self.a))
        a, b = self.a[k], self.b[k]
        new = np.ones(len(k), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        self.first = k[new]
        # Pairs of an anchor piece and a string around it, two per piece at most.
        first = np.lexsort((self.a, self.h))
        h, a = self.h[first], self.a[first]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        last = np.ones(len(h), bool)
        last[:-1] = h[1:] != h[:-1]
        pairs = np.zeros(int(new.sum()), np.dtype([("h", "<u8"), ("x", "<u8"), ("y", "<u8")]))
        pairs["h"], pairs["x"], pairs["y"] = h[new], a[new], a[last]
        self.pairs = pairs


def _flags(answers: dict, kind: int, keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bits that buckets gave for keys, in the keys' order."""
    out, of = np.zeros(len(keys), bool), keys % np.uint64(buckets)
    for b in np.unique(of):
        own = np.flatnonzero(of == b)
        out[own] = np.unpackbits(np.frombuffer(answers[kind, int(b)], np.uint8), count=len(own)).astype(bool)
    return out


def _split(kind: int, block: int, keys: np.ndarray, rows: np.ndarray, buckets: int) -> list:
    of = keys % np.uint64(buckets)
    order = np.argsort(of, kind="stable")
    edges = np.flatnonzero(np.diff(of[order], prepend=np.uint64(buckets)))
    return [(kind, int(of[part[0]]), block, rows[part].tobytes()) for part in np.split(order, edges[1:]) if len(part)]


def _ask(rows: list) -> pa.RecordBatch:
    return batch_of(_ASK, [list(c) for c in zip(*rows, strict=True)] if rows else [[], [], [], []])


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    """A bucket's answers: a bit for each key that each block asked for."""
    kind = int(pdf["kind"].iloc[0])
    raw = pdf["payload"].tolist()
    if kind == 1:  # does the piece occur in another block?
        parts = [np.frombuffer(x, "<u8") for x in raw]
        keys = np.concatenate(parts)
        _, at, counts = np.unique(keys, return_inverse=True, return_counts=True)
        bits = counts[at] > 1
    elif kind == 2:  # is this the first place of the string?
        parts = [np.frombuffer(x, _PLACE) for x in raw]
        x = np.concatenate(parts)
        block = np.repeat(pdf["block"].to_numpy(), [len(p) for p in parts])
        k = np.lexsort((x["at"], block, x["id"], x["b"], x["a"]))
        a, b = x["a"][k], x["b"][k]
        bits = np.zeros(len(x), bool)
        bits[k] = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    else:  # has the piece different strings around it?
        parts = [np.frombuffer(x, np.dtype([("h", "<u8"), ("x", "<u8"), ("y", "<u8")])) for x in raw]
        x = np.concatenate(parts)
        _, at = np.unique(x["h"], return_inverse=True)
        low, high = np.full(at.max() + 1, np.uint64(0xFFFFFFFFFFFFFFFF)), np.zeros(at.max() + 1, np.uint64)
        np.minimum.at(low, at, x["x"])
        np.maximum.at(high, at, x["y"])
        bits = (low != high)[at]
    out, i = [], 0
    for p in parts:
        out.append(np.packbits(bits[i : i + len(p)]).tobytes())
        i += len(p)
    return pd.DataFrame({"block": pdf["block"], "kind": pdf["kind"], "bucket": pdf["bucket"], "bits": out})


def _answers(asked: DataFrame, name: str) -> DataFrame:
    """Per block, the answers of all buckets."""
    told = asked.groupBy("kind", "bucket").applyInPandas(_answer, "block long, kind int, bucket long, bits binary")
    return stored(told.groupBy("block").agg(F.collect_list(F.struct("kind", "bucket", "bits")).alias("answers")), name)


_FOUND = pa.schema(
    [
        ("block", pa.int64()),
        ("kind", pa.int32()),
        ("h", pa.int64()),
        ("id", pa.int64()),
        ("at", pa.int64()),
        ("anchor", pa.int64()),
        ("payload", pa.binary()),
    ]
)
_RUN = np.dtype([("lo", "<i4"), ("hi", "<i4")])
OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
_OUT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_bytes", pa.int64()),
        ("n_removed", pa.int64()),
        ("n_spans", pa.int64()),
        ("kept_sha256", pa.string()),
        ("kept", pa.binary()),
    ]
)


BUCKET_BYTES = 32 << 20


def _bucket_number(docs: DataFrame) -> int:
    """The session's number for shuffles, and more where the table's files would give each over BUCKET_BYTES."""
    size = table_bytes(docs)
    return max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES) if size < 1 << 55 else 1)


def halved(payload: bytes, anchor: int, least: int, most: int, size: int) -> list[tuple[int, int, int, int, int, int]]:
    """The two parts of a string whose windows start from `least` to before `most` bytes before the anchor, by halves of this range.

    (first byte, past the last one, least, most, and the place of the bytes that all windows of the half have in common) of each part that has a window.
    """
    out, mid = [], (least + most) // 2
    for x, y in ((least, mid), (mid, most)):
        a, b = max(0, anchor - y + 1), min(len(payload), anchor - x + size)
        if y > x and b - a >= size:
            out.append((a, b, x, y, anchor - x, anchor - y + 1 + size))
    return out


_STRINGS = pa.schema(
    [
        ("h", pa.int64()),
        ("a", pa.int64()),
        ("b", pa.int64()),
        ("id", pa.int64()),
        ("block", pa.int64()),
        ("at", pa.int64()),
        ("anchor", pa.int64()),
        ("least", pa.int64()),
        ("most", pa.int64()),
        ("payload", pa.binary()),
    ]
)
_STRINGS_DDL = "h long, a long, b long, id long, block long, at long, anchor long, least long, most long, payload binary"
_REPEATS = pa.schema([("block", pa.int64()), ("payload", pa.binary())])


def _halves(size: int):
    """Arrow batches of strings with a crowded anchor, as their halves with longer anchors (h) and fingerprints (a, b)."""
    def run(batches):
        for batch in batches:
            cols = [[] for _ in _STRINGS]
            for r in batch.to_pylist():
                flat = np.frombuffer(r["payload"], np.uint8)
                for a, b, x, y, p, q in halved(r["payload"], r["anchor"], r["least"], r["most"], size):
                    lo, hi = np.array([p, a]), np.array([q, b])
                    f, g = span_hashes(flat, lo, hi)
                    with np.errstate(over="ignore"):
                        key = mix64(f[:1] + g[:1] * np.uint64(2 * (x * 256 + y) + 1)).view(np.int64)[0]
                    for c, v in zip(
                        cols,
                        (
                            int(key),
                            int(f.view(np.int64)[1]),
                            int(g.view(np.int64)[1]),
                            r["id"],
                            r["block"],
                            r["at"] + a,
                            r["anchor"] - a,
                            x,
                            y,
                            r["payload"][a:b],
                        ),
                        strict=True,
                    ):
                        c.append(v)
            yield batch_of(_STRINGS, cols)

    return run


def _as_runs(size: int):
    """Arrow batches of (block, at, length) of strings that came earlier, as runs of their windows."""
    def run(batches):
        for batch in batches:
            block, at, length = (batch.column(k).to_numpy() for k in range(3))
            made = np.zeros(len(at), _RUN)
            made["lo"], made["hi"] = at, at + length - size
            yield batch_of(_REPEATS, [block, [x.tobytes() for x in made[:, None]]])

    return run


def spread(strings: DataFrame, crowd: int, size: int, scratch: list) -> tuple[DataFrame, list[DataFrame]]:
    """Strings (_STRINGS_DDL) of which no anchor has more than `crowd`, and the repeats (block, payload) that were found on the way there.

    Strings of one anchor differ; those of a crowded one are halved, and of equal halves the
    first one stays. scratch: takes the tables that were stored.
    """
    def keep(df: DataFrame, name: str) -> DataFrame:
        scratch.append(stored(df, name))
        return scratch[-1]

    done, repeats = None, []
    place = F.struct("id", "block", "at")
    while True:
        crowds = keep(
            strings.groupBy("h").agg(F.count("*").alias("c")).where((F.col("c") > crowd)).select(F.col("h").alias("crowded")),
            "crowds",
        )
        if crowds.isEmpty():
            return strings if done is None else done.unionByName(strings), repeats
        few = strings.join(crowds, F.col("h") == F.col("crowded"), "left_anti")
        single = F.col("most") - F.col("least") <= 1
        many = strings.join(crowds, F.col("h") == F.col("crowded"), "left_semi").where(~single)
        done = few if done is None else done.unionByName(few)
        halves = keep(many.select(*_STRINGS.names).mapInArrow(_halves(size), _STRINGS_DDL), "halves")
        firsts = keep(
            halves.groupBy("h", "a", "b").agg(F.min(place).alias("p"), F.count("*").alias("c")).where("c > 1").select(
                F.col("h").alias("fh"),
                F.col("a").alias("fa"),
                F.col("b").alias("fb"),
                "p",
            ),
            "firsts",
        )
        told = halves.join(firsts, (F.col("h") == F.col("fh")) & (F.col("a") == F.col("fa")) & (F.col("b") == F.col("fb")), "left").withColumn(
            "again",
            F.coalesce(place != F.col("p"), F.lit(False)),
        )
        told = keep(told.select(*_STRINGS.names, "again"), "halves")
        repeats.append(
            told.where("again").select("block", "at", F.length("payload").cast("long").alias("n")).mapInArrow(
                _as_runs(size),
                "block long, payload binary",
            )
        )
        strings = told.where("not again").drop("again")


def deduplicate(
    docs: DataFrame,
    min_bytes: int = 100,
    id_col: str = "doc_id",
    text_col: str = "text",
    crowd: int = 4096,
    buckets: int | None = None,
    with_text: bool = False,
) -> DataFrame:
    """Per document: n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and, with_text, the bytes kept, as a stored table."""
    spark = docs.sparkSession
    prepare(spark)
    size = min_bytes
    if size < PIECE + 1:
        raise ValueError(f"min_bytes must be over {PIECE}")
    n = buckets or _bucket_number(docs)
    path, name = new_path(spark, "blocks"), f"cloakframe_blocks_{uuid.uuid4().hex}"
    blocks = _blocks(ids_and_texts(docs, id_col, text_col), path, name, n)

    def rows_of(batches, with_answers):
        for batch in batches:
            for r in batch.to_pylist():
                answers = {(x["kind"], x["bucket"]): x["bits"] for k in with_answers for x in r[k] or ()}
                yield _Block(r["block"], r["ids"], r["ends"], r["data"], size), answers

    def ask_pieces(batches):
        for x, _ in rows_of(batches, ()):
            x.anchors()
            yield _ask(_split(1, x.block, x.pieces, x.pieces, n))

    def ask_strings(batches):
        for x, answers in rows_of(batches, ("answers",)):
            x.anchors()
            x.candidates(answers, n)
            places = np.zeros(len(x.first), _PLACE)
            places["a"], places["b"], places["id"], places["at"] = x.a[x.first], x.b[x.first], x.ids[x.doc[x.first]], x.lo[x.first]
            yield _ask(_split(2, x.block, places["a"], places, n) + _split(3, x.block, x.pairs["h"], x.pairs, n))

    def find(batches):
        """Runs of windows of strings that came earlier; first strings that share a piece with others."""
        for x, answers in rows_of(batches, ("answers", "more")):
            x.anchors()
            x.candidates(answers, n)
            is_first = np.zeros(len(x.lo), bool)
            is_first[x.first] = _flags(answers, 2, x.a[x.first], n)
            shared = _flags(answers, 3, x.pairs["h"], n)[np.searchsorted(x.pairs["h"], x.h)] if len(x.h) else is_first
            runs = np.zeros(int((~is_first).sum()), _RUN)
            runs["lo"], runs["hi"] = x.lo[~is_first], x.hi[~is_first]
            k = np.flatnonzero(is_first & shared)
            raw = x.data.tobytes()
            yield batch_of(
                _FOUND,
                [
                    [x.block] * (len(k) + 1),
                    [0] + [1] * len(k),
                    [0, *x.h[k].view(np.int64).tolist()],
                    [0, *x.ids[x.doc[k]].tolist()],
                    [0, *x.lo[k].tolist()],
                    [0, *(x.at[k] - x.lo[k]).tolist()],
                    [runs.tobytes(), *(raw[a : b + size] for a, b in zip(x.lo[k], x.hi[k], strict=True))],
                ],
            )

    ask = "kind int, bucket long, block long, payload binary"
    first = _answers(blocks.mapInArrow(ask_pieces, ask), "answers")
    once = blocks.join(
        first.hint("shuffle_hash").select(F.col("block").alias("k1"), "answers"),
        F.col("block") == F.col("k1"),
        "left",
    ).drop("k1")
    second = _answers(once.mapInArrow(ask_strings, ask), "answers")
    twice = once.join(
        second.hint("shuffle_hash").select(F.col("block").alias("k2"), F.col("answers").alias("more")),
        F.col("block") == F.col("k2"),
        "left",
    ).drop("k2")
    found = stored(twice.mapInArrow(find, "block long, kind int, h long, id long, at long, anchor long, payload binary"), "found")
    strings = found.where("kind = 1").select(
        "h",
        F.lit(0).cast("long").alias("a"),
        F.lit(0).cast("long").alias("b"),
        "id",
        "block",
        "at",
        "anchor",
        F.lit(0).cast("long").alias("least"),
        F.lit(size - PIECE + 1).cast("long").alias("most"),
        "payload",
    )
    scratch = [first, second, found]
    strings, repeats = spread(strings, crowd, size, scratch)
    few = strings.withColumn("bucket", F.pmod(F.xxhash64("h"), F.lit(n).cast("long")))

    def sort(pdf: pd.DataFrame) -> pd.DataFrame:
        """The later windows of a bucket's strings, by block."""
        pdf = pdf.sort_values(["id", "block", "at"], kind="stable").reset_index(drop=True)
        # A window's place: its document's rank by id and file order, then the place in the block.
        new = (pdf["id"] != pdf["id"].shift()) | (pdf["block"] != pdf["block"].shift())
        keys = np.stack([np.cumsum(new.to_numpy()), pdf["at"].to_numpy()], 1)
        sid, start = repeated_windows(pdf["payload"].tolist(), pdf["anchor"].to_numpy(), pdf["h"].to_numpy(), keys, size)
        at, block = pdf["at"].to_numpy()[sid] + start, pdf["block"].to_numpy()[sid]
        out = []
        for b in np.unique(block):
            runs = np.zeros(int((block == b).sum()), _RUN)
            runs["lo"] = runs["hi"] = at[block == b]
            out.append((b, runs.tobytes()))
        return pd.DataFrame(out, columns=["block", "payload"])

    sorted_out = few.groupBy("bucket").applyInPandas(sort, "block long, payload binary")
    gone = found.where("kind = 0").select("block", "payload").union(sorted_out)
    for x in repeats:
        gone = gone.union(x)
    gone = gone.groupBy("block").agg(F.collect_list("payload").alias("runs")).hint("shuffle_hash").select(
        F.col("block").alias("k3"),
        "runs",
    )

    def finish(batches):
        for batch in batches:
            for r in batch.to_pylist():
                x = _Block(r["block"], r["ids"], r["ends"], r["data"], size)
                runs = np.frombuffer(b"".join(r["runs"] or ()), _RUN).astype([("lo", "<i8"), ("hi", "<i8")])
                delta = np.zeros(len(x.data) + 1, np.int32)
                np.add.at(delta, runs["lo"], 1)
                np.add.at(delta, runs["hi"] + size, -1)
                out = np.cumsum(delta[:-1]) > 0
                head = out.copy()
                head[1:] &= ~out[:-1]
                inner = x.offsets[:-1][x.offsets[:-1] < len(out)]
                head[inner] = out[inner]  # a run that begins with a document is that document's own
                removed, spans = (np.diff(np.concatenate([[0], np.cumsum(v)])[x.offsets]) for v in (out, head))
                kept = [x.data[a:b][~out[a:b]].tobytes() for a, b in zip(x.offsets[:-1], x.offsets[1:], strict=True)]
                yield batch_of(
                    _OUT,
                    [
                        r["ids"],
                        np.diff(x.offsets),
                        removed,
                        spans,
                        [hashlib.sha256(k).hexdigest() for k in kept],
                        kept if with_text else [None] * len(kept),
                    ],
                )

    out = stored(blocks.join(gone, F.col("block") == F.col("k3"), "left").drop("k3").mapInArrow(finish, OUT), "deduplicated")
    drop(*scratch)
    spark.sql(f"DROP TABLE {name}")
    drop_path(spark, path)
    return out
