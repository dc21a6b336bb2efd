"""What the text operators share: tables, scratch files, words as arrays."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# A-Z become a-z; nothing else changes (ASCII only, as the contracts ask).
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# Words are what lies between these bytes: space, tab, LF, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all executors share.

    That is ``spark.checkpoint.dir``; where the session has none (as in tests),
    a folder in the warehouse, which is shared as well.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    base = base or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch"
    return f"{base.rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: later steps start from
    files, so a lost executor costs no more than the step at hand."""
    spark = df.sparkSession
    path = scratch(spark, name)
    # Shuffle files of this job serve nothing afterwards; drop them with it.
    old = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, old)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a frame made by ``written`` that nothing needs any more."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def most_frequent(counts: DataFrame, n: str, limit: int) -> DataFrame:
    """Up to ``limit`` rows of ``counts`` with the largest ``n``, ties all or none.

    The driver sees a histogram of at most 1024 bars, not a list from each task.
    """
    bar = F.floor(F.log2(n) * 16)
    bars = sorted(counts.groupBy(bar.alias("bar")).count().collect(), key=lambda r: -r["bar"])
    total, least = 0, None
    for r in bars:
        total += r["count"]
        if total > limit:
            break
        least = r["bar"]
    return counts.filter(bar >= least) if least is not None else counts.limit(0)


def lower(text: Column | str) -> Column:
    return F.translate(text, UPPER, LOWER)


def crc_mod(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id written as decimal text, modulo ``n``; null for null."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id) % n


def _tables() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    value = rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    value[65:91] = value[97:123]
    blank = np.zeros(256, dtype=bool)
    blank[[32, 9, 10, 11, 12, 13]] = True
    return value, blank


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordHasher:
    """64-bit hashes of all words of many texts at once, upper case folded.

    Texts come as the two buffers of an Arrow string column. ``H(word) =
    mix(sum of value[byte] * p^position)`` from prefix sums modulo 2^64.
    """

    P, P_INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2**64)

    def __init__(self):
        self.value, self.blank = _tables()
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            with np.errstate(over="ignore"):
                for name, p in (("up", self.P), ("down", self.P_INVERSE)):
                    steps = np.full(n, p, dtype=np.uint64)
                    steps[0] = 1
                    setattr(self, name, np.cumprod(steps, dtype=np.uint64))

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """``data``: bytes of the texts, one after another; ``offsets``: where each
        begins, and the end. Returns the hash of each word, its first byte, the
        byte after its last, and how many words stand before each text."""
        n = len(data)
        text = ~self.blank[data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        start = text.copy()
        start[1:] &= ~text[:-1] | edge[1:n]
        end = text.copy()
        end[:-1] &= ~text[1:] | edge[1:n]
        first, last = np.flatnonzero(start), np.flatnonzero(end) + 1
        self._grow(n + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(self.value[data] * self.up[:n], out=total[1:])
            hashes = mix((total[last] - total[first]) * self.down[first] + (last - first).astype(np.uint64))
        return hashes, first, last, np.searchsorted(first, offsets)


def give_back() -> None:
    """Return what Arrow and the C library hold without use to the system: workers
    live on from stage to stage, and an executor is charged for all of them."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def text_buffers(column: pa.Array, part_bytes: int = 1 << 23) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """An Arrow string column as numpy arrays, in runs of about ``part_bytes``
    (one text at least): first row, row after the last, bytes, offsets. Nulls
    count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, where, what = column.buffers()
    offsets = np.frombuffer(where, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(what, dtype=np.uint8) if what is not None and what.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + part_bytes, "right")) - 1)
        own = offsets[at : to + 1]
        yield at, to, data[own[0] : own[-1]], own - own[0]
        at = to
    del column, where, what, offsets, data, own
    give_back()


def binary_column(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Consecutive pieces of ``data`` (any width) as an Arrow binary column."""
    ends = np.concatenate([[0], np.cumsum(lengths)]) * data.itemsize
    return pa.Array.from_buffers(
        pa.large_binary(), len(lengths), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
    ).cast(pa.binary())


def numbers(column: pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """A binary column back as one array of numbers, and how many each row has."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    _, where, what = column.buffers()
    offsets = np.frombuffer(where, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    size = np.dtype(dtype).itemsize
    if what is None or not len(column):
        return np.zeros(0, dtype), np.zeros(len(column), np.int64)
    data = np.frombuffer(what, dtype=np.uint8)[offsets[0] : offsets[-1]]
    return np.frombuffer(data.tobytes(), dtype=dtype), np.diff(offsets) // size


def guarded(df: DataFrame, wanted: tuple[str, ...]) -> DataFrame:
    """``df`` with all columns but the wanted ones renamed by position, so that no
    name (also none that differs in case only) can clash with what an operator
    adds. ``restored`` gives the old names back."""
    names, left = [], list(wanted)
    for k, c in enumerate(df.columns):
        if c in left:
            left.remove(c)
            names.append(c)
        else:
            names.append(f"__extra{k}")
    return df.toDF(*names)


def restored(df: DataFrame, like: DataFrame, wanted: tuple[str, ...]) -> DataFrame:
    """The columns of ``like`` from a frame made of ``guarded(like, wanted)``."""
    return df.select(*guarded(like, wanted).columns).toDF(*like.columns)


def only(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns and nothing else."""
    return guarded(df, columns).select(*columns)
