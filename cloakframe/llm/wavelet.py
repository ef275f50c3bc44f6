"""Token ids in wavelet matrices, one per shard.

A shard's ids, highest bit first, become one bit-plane each; each plane is stably parted
by its bits for the next. A plane keeps running counts of ones per 512 bits, so rank is
a lookup and a popcount.

File image: magic; a directory (counts, doc ids, ends of the documents, then per plane the
number of zeros, the running counts and the sizes of its frames); the frames, which hold
64 KB of a plane's bits each. The directory and each frame are compressed with zstandard
on their own. A reader takes the directory and then only the frames that it asks for:
access, counting and occurrence lookup read one or two frames per plane and place, not the
shard. Images are the `payload` of a Parquet table, one row per shard, in the shared
folder, so any store that Spark reaches can hold them.

Null texts are empty, and empty texts the end id alone. Rows without an id come first;
rows with equal ids stand next to each other, in no fixed order. Repeated rows are kept.
Very long texts lie whole in a shard of their own. Empty tables give no shards and no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch_of, ids_and_texts, prepare, table_bytes
from .tokens import END_ID, encoder_of, groups_of

MAGIC = b"WVMX2\0\0\0"
BLOCK = 512
FRAME = 1 << 16
SHARD_TOKENS = 1 << 20
PARTITION_BYTES = 128 << 20


def _ones(packed: np.ndarray) -> np.ndarray:
    return np.bitwise_count(packed)


def build(ids: np.ndarray, doc_ids: list, ends: np.ndarray) -> bytes:
    """The file image of a shard: ids of documents one after another, ends[k] after document k."""
    import zstandard

    n, planes = len(ids), max(1, int(ids.max()).bit_length()) if len(ids) else 1
    ids = ids.astype(np.uint16 if planes <= 16 else np.uint32)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    pack = zstandard.ZstdCompressor(level=1).compress
    parts = [
        np.array([n, len(doc_ids), planes], "<i8").tobytes(),
        known.tobytes(),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
        np.asarray(ends, "<i8").tobytes(),
    ]
    frames = []
    for level in range(planes - 1, -1, -1):
        one = (ids & ids.dtype.type(1 << level)) != 0
        packed = np.packbits(one, bitorder="little")
        packed = np.concatenate([packed, np.zeros(-len(packed) % (BLOCK // 8), np.uint8)])
        per = _ones(packed).reshape(-1, BLOCK // 8).sum(1, dtype=np.uint32)
        ranks = np.concatenate([[0], np.cumsum(per)]).astype("<u4")
        own = [pack(packed[a : a + FRAME].tobytes()) for a in range(0, len(packed), FRAME)]
        parts += [np.array([n - int(ranks[-1])], "<i8").tobytes(), ranks.tobytes(), np.array([len(f) for f in own], "<i8").tobytes()]
        frames += own
        ids = np.concatenate([np.compress(~one, ids), np.compress(one, ids)])
    directory = pack(b"".join(parts))
    return MAGIC + len(directory).to_bytes(8, "little") + directory + b"".join(frames)


class Shard:
    """Reads a file image; frames are decompressed when they are first asked for."""

    def __init__(self, image: bytes):
        import zstandard

        if image[:8] != MAGIC:
            raise ValueError("not a wavelet shard")
        self._unpack = zstandard.ZstdDecompressor().decompress
        at = 16 + int.from_bytes(image[8:16], "little")
        raw = self._unpack(image[16:at])
        self.image, self.n_frames_read = memoryview(image), 0
        self.n, n_docs, self.planes = (int(x) for x in np.frombuffer(raw, "<i8", 3))
        p = 24
        known = np.frombuffer(raw, np.uint8, n_docs, p)
        p += n_docs
        self.doc_ids = [int(d) if k else None for d, k in zip(np.frombuffer(raw, "<i8", n_docs, p), known, strict=True)]
        p += 8 * n_docs
        self.ends = np.frombuffer(raw, "<i8", n_docs, p)
        p += 8 * n_docs
        blocks = -(-self.n // BLOCK)
        n_frames = -(-blocks * (BLOCK // 8) // FRAME)
        self.zeros, self.ranks, self.places, self.frames = [], [], [], {}
        for _ in range(self.planes):
            self.zeros.append(int(np.frombuffer(raw, "<i8", 1, p)[0]))
            self.ranks.append(np.frombuffer(raw, "<u4", blocks + 1, p + 8))
            p += 8 + 4 * (blocks + 1)
            sizes = np.frombuffer(raw, "<i8", n_frames, p)
            p += 8 * n_frames
            self.places.append(at + np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64))
            at = int(self.places[-1][-1])

    def _frame(self, plane: int, k: int) -> np.ndarray:
        if (plane, k) not in self.frames:
            a, b = self.places[plane][k : k + 2]
            self.frames[plane, k] = np.frombuffer(self._unpack(self.image[a:b]), np.uint8)
            self.n_frames_read += 1
        return self.frames[plane, k]

    def _blocks(self, plane: int, blocks: np.ndarray) -> np.ndarray:
        """The bytes of these blocks, one row each."""
        size = BLOCK // 8
        out = np.empty((len(blocks), size), np.uint8)
        of = blocks * size // FRAME
        for k in np.unique(of):
            own = of == k
            out[own] = self._frame(plane, int(k)).reshape(-1, size)[blocks[own] - int(k) * (FRAME // size)]
        return out

    def _bits(self, plane: int) -> np.ndarray:
        """All bytes of a plane; they aren't kept."""
        return np.concatenate(
            [
                np.frombuffer(self._unpack(self.image[a:b]), np.uint8)
                for a, b in zip(self.places[plane], self.places[plane][1:], strict=False)
            ]
        )

    def _ranked(self, plane: int, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        block = at // BLOCK
        out = self.ranks[plane][block].astype(np.int64)
        inside = np.flatnonzero(at % BLOCK)
        if len(inside):
            own = self._blocks(plane, block[inside])
            rest, start = (at[inside] % BLOCK)[:, None], np.arange(BLOCK // 8)[None] * 8
            mask = ((1 << np.clip(rest - start, 0, 8)) - 1).astype(np.uint8)
            out[inside] += _ones(own & mask).sum(1, dtype=np.int64)
        return out

    def _selected(self, plane: int, bit: int, k: np.ndarray) -> np.ndarray:
        """The places of the k-th (from 0) bits of this value."""
        ranks = self.ranks[plane].astype(np.int64)
        counts = ranks if bit else np.arange(len(ranks)) * BLOCK - ranks
        block = np.searchsorted(counts, k, "right") - 1
        own = np.unpackbits(self._blocks(plane, block), axis=1, bitorder="little") == bit
        return block * BLOCK + np.argmax(np.cumsum(own, 1, dtype=np.int32) == (k - counts[block] + 1)[:, None], 1)

    def access(self, at) -> np.ndarray:
        """The ids at these places."""
        at = np.asarray(at, np.int64)
        if len(at) and not (at.min() >= 0 and at.max() < self.n):
            raise IndexError("no such place")
        out = np.zeros(len(at), np.int64)
        for p in range(self.planes):
            before, past = self._ranked(p, at), self._ranked(p, at + 1)
            one = past > before
            at = np.where(one, self.zeros[p] + before, at - before)
            out = out << 1 | one
        return out

    def _mapped(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """Where each place's run of the symbol stands below the last plane."""
        for p in range(self.planes):
            one = self._ranked(p, at)
            at = self.zeros[p] + one if symbol >> (self.planes - 1 - p) & 1 else at - one
        return at

    def counts(self, symbol: int, at) -> np.ndarray:
        """How often the id occurs before each place."""
        at = np.concatenate([[0], np.asarray(at, np.int64)])
        if symbol < 0 or symbol >> self.planes:
            return np.zeros(len(at) - 1, np.int64)
        low = self._mapped(symbol, at)
        return low[1:] - low[0]

    def count(self, symbol: int, a: int = 0, b: int | None = None) -> int:
        """How often the id occurs in the places from a to b."""
        x, y = self.counts(symbol, [a, self.n if b is None else b])
        return int(y - x)

    def rank(self, symbol: int, i: int) -> int:
        return int(self.counts(symbol, [i])[0])

    def select(self, symbol: int, k) -> np.ndarray:
        """The places of the k-th (from 0) occurrences of the id."""
        k = np.asarray(k, np.int64)
        if symbol < 0 or symbol >> self.planes or len(k) and not (k.min() >= 0 and k.max() < self.count(symbol)):
            raise IndexError("no such occurrence")
        at = self._mapped(symbol, np.zeros(1, np.int64))[0] + k
        for p in range(self.planes - 1, -1, -1):
            bit = symbol >> (self.planes - 1 - p) & 1
            at = self._selected(p, bit, at - self.zeros[p] if bit else at)
        return at

    def occurrences(self, symbol: int, step: int = 4096):
        """The places of the id, in order, as arrays of at most `step`."""
        n = self.count(symbol)
        for a in range(0, n, step):
            yield self.select(symbol, np.arange(a, min(n, a + step)))

    def decode(self) -> np.ndarray:
        """All ids, in order."""
        kind = np.uint16 if self.planes <= 16 else np.uint32
        below = np.zeros(self.n, kind)
        if not self.n:
            return below.astype(np.uint32)
        for p in range(self.planes - 1, -1, -1):  # undo the partings, lowest plane first
            one = np.unpackbits(self._bits(p), count=self.n, bitorder="little").view(bool)
            out = np.empty(self.n, kind)
            out[np.flatnonzero(one)] = below[self.zeros[p] :] | kind(1 << (self.planes - 1 - p))
            out[np.flatnonzero(~one)] = below[: self.zeros[p]]
            below = out
        return below.astype(np.uint32)


TOKENS = pa.schema([("doc_id", pa.int64()), ("width", pa.int32()), ("ids", pa.binary())])
SHARDS = pa.schema(
    [
        ("part", pa.int64()),
        ("shard", pa.int64()),
        ("first_doc", pa.int64()),
        ("n_docs", pa.int64()),
        ("n_tokens", pa.int64()),
        ("payload", pa.binary()),
    ]
)
READ = pa.schema(
    [
        ("part", pa.int64()),
        ("shard", pa.int64()),
        ("doc_id", pa.int64()),
        ("local_start", pa.int64()),
        ("n_tokens", pa.int64()),
        ("ids_crc32", pa.int64()),
        ("n_end_ids", pa.int64()),
    ]
)


def tokenized(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", table_words: int = 2_000_000) -> DataFrame:
    """doc_id, width and the ids with the end id, as little-endian unsigned numbers of `width` bytes: 2 for vocabularies of
    up to 65,536 ids, else 4. table_words: how many different words a worker remembers."""
    prepare(docs.sparkSession)

    def run(batches):
        encoder = encoder_of(tokenizer, table_words)
        width = 2 if encoder.tokenizer.get_vocab_size() <= 1 << 16 else 4
        end = np.array([END_ID], f"<u{width}").tobytes()
        for batch in batches:
            ids_, texts = batch.columns
            for a, b in groups_of(texts):
                ids, lens = encoder.encode(texts.slice(a, b - a))
                ends = np.cumsum(lens)
                small = ids.astype(f"<u{width}")
                yield batch_of(
                    TOKENS,
                    [ids_.slice(a, b - a), [width] * (b - a), [small[e - n : e].tobytes() + end for e, n in zip(ends, lens, strict=True)]],
                )

    return ids_and_texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, width int, ids binary")


def write_shards(tokens: DataFrame, path: str, partitions: int | None = None, shard_tokens: int = SHARD_TOKENS) -> None:
    """Shards of about shard_tokens ids, in ascending doc_id order over all of them, written to path.

    tokens: what tokenized() returns, stored, as the range bounds are sampled from it. A
    document lies in one shard whole, however long. partitions: without it, the session's
    number for shuffles, and more where the files would give each over PARTITION_BYTES.
    """
    if partitions is None:
        usual = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        partitions = max(1, usual, -(-table_bytes(tokens) // PARTITION_BYTES))

    def run(batches):
        part, shard = TaskContext.get().partitionId(), 0
        docs, ids, ends, n = [], [], [], 0

        def out():
            image = build(np.concatenate(ids), docs, np.array(ends))
            return batch_of(SHARDS, [[part], [shard], [docs[0]], [len(docs)], [n], [image]])

        for batch in batches:
            for d, width, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = np.frombuffer(raw, f"<u{width}")
                if n and n + len(own) > shard_tokens:
                    yield out()
                    docs, ids, ends, n, shard = [], [], [], 0, shard + 1
                docs.append(d)
                ids.append(own)
                n += len(own)
                ends.append(n)
        if docs:
            yield out()

    dealt = tokens.repartitionByRange(partitions, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    dealt.mapInArrow(
        run,
        "part long, shard long, first_doc long, n_docs long, n_tokens long, payload binary",
    ).write.option("compression", "uncompressed").parquet(path)


def read_shards(spark, path: str) -> DataFrame:
    """Per document of the shards in path: doc_id, start (ids of all documents before), n_tokens, ids_crc32, and n_end_ids,
    how many of its ids are the end id, by rank.

    Starts are sums over the table's counts, first of partitions, then inside each; images
    don't move between tasks.
    """
    prepare(spark)
    shards = spark.read.parquet(path)

    def run(batches):
        for batch in batches:
            for part, shard, image in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                x = Shard(image)
                ids = x.decode().astype("<u4")
                starts = np.concatenate([[0], x.ends[:-1]]).astype(np.int64)
                last = np.diff(x.counts(END_ID, np.concatenate([[0], x.ends])))
                yield batch_of(
                    READ,
                    [
                        [part] * len(starts),
                        [shard] * len(starts),
                        x.doc_ids,
                        starts,
                        x.ends - starts,
                        [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, x.ends, strict=True)],
                        last,
                    ],
                )

    read = shards.select("part", "shard", "payload").mapInArrow(
        run,
        "part long, shard long, doc_id long, local_start long, n_tokens long, ids_crc32 long, n_end_ids long",
    )
    counts = shards.select("part", "shard", "n_tokens")
    parts = counts.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = parts.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before_part"))
    inside = counts.select(
        "part",
        "shard",
        (F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_tokens")).alias("before_shard"),
    )
    bases = inside.join(before, "part").select(
        F.col("part").alias("b_part"),
        F.col("shard").alias("b_shard"),
        (F.col("before_part") + F.col("before_shard")).alias("base"),
    )
    on = (F.col("part") == F.col("b_part")) & (F.col("shard") == F.col("b_shard"))
    return read.join(bases, on).select(
        "doc_id",
        (F.col("base") + F.col("local_start")).alias("start"),
        "n_tokens",
        "ids_crc32",
        "n_end_ids",
    )


def count_ids(spark, path: str, ids: list[int]) -> DataFrame:
    """id, n: how often each of the ids occurs in all shards, by rank at the shards' ends; no shard is decoded."""
    prepare(spark)
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64())])

    def run(batches):
        for batch in batches:
            for image in batch.column(0).to_pylist():
                x = Shard(image)
                yield batch_of(schema, [ids, [x.count(i) for i in ids]])

    wanted = spark.createDataFrame([(i,) for i in ids], "wanted long").distinct()
    found = spark.read.parquet(path).select("payload").mapInArrow(run, "id long, n long").groupBy("id").agg(
        F.max("n").alias("most"),
        F.sum("n").alias("n"),
    )
    return wanted.join(found, F.col("wanted") == F.col("id"), "left").select(
        F.col("wanted").alias("id"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n"),
    )


def find_ids(spark, path: str, ids: list[int]) -> DataFrame:
    """id, doc_id, at (from the document's start): all occurrences of the ids, by select; no shard is decoded."""
    prepare(spark)
    schema = pa.schema([("id", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64())])

    def run(batches):
        for batch in batches:
            for image in batch.column(0).to_pylist():
                x = Shard(image)
                starts = np.concatenate([[0], x.ends[:-1]]).astype(np.int64)
                for i in dict.fromkeys(ids):
                    for at in x.occurrences(i):
                        doc = np.searchsorted(x.ends, at, "right")
                        yield batch_of(schema, [[i] * len(at), [x.doc_ids[d] for d in doc], at - starts[doc]])

    return spark.read.parquet(path).select("payload").mapInArrow(run, "id long, doc_id long, at long")
