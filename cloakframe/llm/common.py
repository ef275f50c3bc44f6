"""What the operators of this subpackage share: shared folders, Arrow batches and word hashing.

Arrow batches are cut by bytes, so a run of very long texts never meets in one batch.
Intermediate tables go to the folder in ``spark.checkpoint.dir``, which all executors
see; a lost executor costs the tasks it ran, not the job.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH_BYTES = 4 << 20
M64 = np.uint64(0xFFFFFFFFFFFFFFFF)


def prepare(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's spark.checkpoint.dir, or, where it names none and all runs in one process, a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", "")
    if not base:
        base = spark.conf.get("cloakframe.shared.dir", "")
        if not base:
            if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="cloakframe-")
            spark.conf.set("cloakframe.shared.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/cloakframe/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """df, written to the shared folder and read again: this cuts its lineage."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def table_bytes(df: DataFrame) -> int:
    """The size of a table's files, as Spark's plan knows it."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing will read again."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop(*tables: DataFrame) -> None:
    """Delete the files of tables that stored() returned and that no later plan reads."""
    for t in tables:
        drop_path(t.sparkSession, t.stored_at)


def ids_and_texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns, under names that clash with nothing."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def free_prefix(df: DataFrame, wish: str = "__") -> str:
    """A prefix that none of df's columns has, in any case of letters."""
    while any(c.lower().startswith(wish.lower()) for c in df.columns):
        wish += "_"
    return wish


def extended(docs: DataFrame, text_col: str, fields: str, begin) -> DataFrame:
    """docs, each row with more columns made from its text, in one pass and without a join.

    begin() is called once per task and returns the function from an Arrow column of texts
    to the Arrow columns of `fields` (DDL), whose names must be new.
    """
    prepare(docs.sparkSession)
    schema = T.StructType(list(docs.schema) + list(T.StructType.fromDDL(fields)))
    names = schema.names

    def run(batches):
        make = begin()
        for batch in batches:
            *own, text = batch.columns
            yield pa.RecordBatch.from_arrays([*own, *make(text)], names=names)

    return docs.select("*", F.col(f"`{text_col}`").cast("string").alias(free_prefix(docs) + "text")).mapInArrow(run, schema)


def batch_of(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t.type) if not isinstance(c, pa.Array) else c for c, t in zip(columns, schema, strict=True)],
        schema=schema,
    )


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts of a string column, one after another, and the n + 1 offsets; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64, n + 1, column.offset * 8)
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Runs of texts of about `most` bytes; a longer text is a run of its own."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, b
        a = b


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (the finaliser of SplitMix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_WS = np.zeros(256, bool)
_WS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE64 = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x2545F4914F6CDD1D
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base modulo 2^64, and their inverses."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 19)
        inverse = pow(_BASE, -1, 1 << 64)
        made = []
        for b in (_BASE, inverse):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            made.append(np.multiply.accumulate(x))
        _powers[:] = made
    return _powers[0][:n], _powers[1][:n]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the words, which are runs without ASCII white space, and the number of words of each text."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets) - 1, np.int64)
    inside = ~_WS[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets[:-1]] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | cut[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each word."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        up, down = powers(len(data))
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE64[data] * up, out=total[1:])
        return mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
