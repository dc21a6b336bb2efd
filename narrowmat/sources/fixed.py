"""Files of fixed-length binary records.

Spark's own file index lists the files, so wildcards, folders and every Hadoop scheme
work. Files are cut into ranges of whole records, any number of which may lie in one
file, and tasks read their ranges by position in Arrow batches. Files that only Hadoop
can open come whole out of Spark's binary file reader and are cut in Arrow as well.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage,
)

from narrowmat.functions import cells
from narrowmat.functions.kernels import binary_bytes

SCHEMA = "offset bigint, value binary"

# Extensions of compressed files, which cannot be cut at records.
COMPRESSED = (
    ".gz", ".bz2", ".zst", ".lz4", ".lzo", ".lzo_deflate", ".snappy", ".deflate", ".xz",
)

# Schemes that pyarrow can open, by the names it has for them. Those of Hadoop's own
# file system need its native library, which is tried before it is relied on.
ARROW_SCHEMES = {
    "": "", "file": "", "s3": "s3", "s3a": "s3", "gs": "gs", "abfs": "abfs", "abfss": "abfss",
    "hdfs": "hdfs", "viewfs": "viewfs",
}
READ_BYTES = 1 << 24

# Files that come whole out of Spark's reader are in memory in one piece.
WHOLE_BYTES = 1 << 29


def _scheme(path: str) -> str:
    head, colon, _ = path.partition(":")
    return head if colon and "/" not in head else ""


def _store(path: str):
    """The pyarrow file system of a path, and the path there."""
    import pyarrow.fs as fs

    scheme = _scheme(path)
    if scheme not in ARROW_SCHEMES:
        raise ValueError(f"{path}: pyarrow cannot open {scheme}:")
    if not ARROW_SCHEMES[scheme]:
        return fs.LocalFileSystem(), os.path.abspath("/" + path[len("file:") :].lstrip("/") if scheme else path)
    return fs.FileSystem.from_uri(ARROW_SCHEMES[scheme] + path[len(scheme) :])


def open_input(path: str):
    """A file that can be read by position (``read_at``)."""
    store, place = _store(path)
    return store.open_input_file(place)


def refuse_compressed(path: str) -> None:
    if path.lower().endswith(COMPRESSED):
        raise ValueError(f"{path}: compressed files have no fixed-length records")


def list_files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Path and size of every file at ``path`` (a file, a folder with all below it, or
    a pattern), by name. Names that start with ``_`` or ``.`` are left out, as Spark
    does. Runs a job that lists and opens nothing."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    # The index does not look at the content unless a column of it is asked for.
    return sorted((r.path, r.length) for r in found.select("path", "length").collect())


@dataclass
class RecordRanges(InputPartition):
    ranges: list[tuple[str, int, int]]


def plan_ranges(files: list[tuple[str, int]], length: int, split: int) -> list[list[tuple[str, int, int]]]:
    """Ranges of whole records, grouped so that each group has about ``split`` bytes:
    large files are cut, small ones share a group."""
    step = max(1, split // length) * length
    groups, room = [], 0
    for path, size in files:
        for start in range(0, size, step):
            end = min(size, start + step)
            if end - start > room:
                groups.append([])
                room = step
            groups[-1].append((path, start, end))
            room -= end - start
    return groups


def _cut(data, length: int, at: int) -> pa.RecordBatch:
    """Consecutive records, the first at byte ``at`` of its file, without a copy."""
    count = len(data) // length
    edges = np.arange(count + 1, dtype=np.int32) * np.int32(length)
    values = pa.Array.from_buffers(pa.binary(), count, [None, pa.py_buffer(edges), pa.py_buffer(data)])
    starts = np.arange(count, dtype=np.int64) * length + at
    return pa.RecordBatch.from_arrays([pa.array(starts), values], names=["offset", "value"])


def _step(length: int) -> int:
    return max(1, READ_BYTES // length) * length


class FixedLengthReader(DataSourceReader):
    def __init__(self, options):
        # Option names arrive in lower case.
        self.length = int(options["recordlength"])
        self.groups = json.loads(options["ranges"])
        self.opened = cloudpickle.loads(bytes.fromhex(options["opener"]))

    def partitions(self):
        return [RecordRanges(group) for group in self.groups] or [RecordRanges([])]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        step = _step(self.length)
        for path, start, end in partition.ranges:
            with self.opened(path) as source:
                for at in range(start, end, step):
                    size = min(step, end - at)
                    data = source.read_at(size, at)
                    if len(data) != size:
                        raise ValueError(f"{path}: partial record at the end")
                    yield _cut(data, self.length, at)


def _remove(path: str) -> None:
    import pyarrow.fs as fs

    store, place = _store(path)
    if store.get_file_info(place).type == fs.FileType.Directory:
        store.delete_dir(place)


@dataclass
class PartFile(WriterCommitMessage):
    name: str


class FixedLengthWriter(DataSourceArrowWriter):
    """Every task writes one file of its own into a hidden folder; those of the tasks
    that Spark commits are moved in place, others are removed with the folder."""

    def __init__(self, options, overwrite):
        self.length = int(options["recordlength"])
        self.path = options["path"].rstrip("/")
        self.overwrite = overwrite
        self.hidden = f"{self.path}/_temporary-{options['job']}"

    def write(self, batches) -> PartFile:
        store, hidden = _store(self.hidden)
        store.create_dir(hidden, recursive=True)
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}-{uuid.uuid4().hex}.bin"
        with store.open_output_stream(f"{hidden}/{name}") as out:
            for batch in batches:
                values = batch.column("value")
                edges, body = binary_bytes(values)
                if values.null_count or np.any(np.diff(edges) != self.length):
                    raise ValueError(f"every record must have {self.length} bytes")
                out.write(pa.py_buffer(np.ascontiguousarray(body)))
        return PartFile(name)

    def commit(self, messages) -> None:
        import pyarrow.fs as fs

        store, hidden = _store(self.hidden)
        _, path = _store(self.path)
        if self.overwrite:
            old = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
            for info in old:
                if info.type == fs.FileType.File:
                    store.delete_file(info.path)
        for message in messages:
            if message is not None:
                store.move(f"{hidden}/{message.name}", f"{path}/{message.name}")
        store.delete_dir(hidden)

    def abort(self, messages) -> None:
        _remove(self.hidden)


class FixedLengthSource(DataSource):
    @classmethod
    def name(cls):
        return "fixedlength"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return FixedLengthReader(self.options)

    def writer(self, schema, overwrite):
        return FixedLengthWriter(self.options, overwrite)


def _default_split(spark: SparkSession, files) -> int:
    """The session's, but finer where there is too little for every core."""
    units = {"b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}
    size = spark.conf.get("spark.sql.files.maxPartitionBytes", "128m").lower()
    digits = size.rstrip("bkmgt")
    split = int(digits) * units[size[len(digits) : len(digits) + 1] or "b"]
    share = sum(size for _, size in files) // spark.sparkContext.defaultParallelism
    return min(split, max(share, 1 << 20))


def _read_ranges(spark, path, files, length, split_bytes, opener):
    spark.dataSource.register(FixedLengthSource)
    groups = plan_ranges(files, length, split_bytes or _default_split(spark, files))
    options = {
        "recordlength": str(length), "ranges": json.dumps(groups), "opener": cloudpickle.dumps(opener).hex(),
    }
    return spark.read.format("fixedlength").options(**options).load(path)


def _sliced(length, batches):
    step = _step(length)
    for batch in batches:
        column = batch.column("content")
        edges, body = binary_bytes(column)
        for k in range(batch.num_rows):
            whole = body[edges[k] : edges[k + 1]]
            if len(whole) % length:
                raise ValueError("partial record at the end")
            for at in range(0, len(whole), step):
                yield _cut(np.ascontiguousarray(whole[at : at + step]), length, at)


def _read_whole(spark, path, files, length):
    for name, size in files:
        if size > WHOLE_BYTES:
            raise ValueError(
                f"{name}: {size} bytes are too many for a file that only Hadoop can open; "
                "give an opener that can read by position"
            )
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.select("content").mapInArrow(partial(_sliced, length), SCHEMA)


def _can_open(path: str) -> bool:
    try:
        open_input(path).close()
    except (OSError, ValueError, ImportError):
        return False
    return True


def read_fixed(
    spark: SparkSession,
    path: str,
    record_length: int,
    key_start: int | None = None,
    key_end: int | None = None,
    split_bytes: int | None = None,
    engine: str | None = None,
    opener: Callable | None = None,
) -> DataFrame:
    """Records of ``record_length`` bytes as ``offset, record, key?, value``.

    ``path`` is a file, a folder or a pattern on any file system that Hadoop knows;
    listing it is a job, reading is lazy. ``offset`` is where the record starts in its
    file and ``record`` its number there. With ``key_start`` and ``key_end``, ``key``
    holds those bytes of the record (both included, counted from 0).

    ``engine="arrow"`` reads ranges of about ``split_bytes``, through pyarrow or what
    ``opener`` makes of a path (a file with ``read_at(size, position)``);
    ``"hadoop"`` reads files whole, of up to 512 MiB each, through Spark. Left out,
    it is ``"arrow"`` wherever pyarrow can open the first file.
    """
    if record_length is None or record_length <= 0:
        raise ValueError("record_length must be 1 or more")
    if (key_start is None) != (key_end is None):
        raise ValueError("give key_start and key_end together")
    if key_start is not None and not 0 <= key_start <= key_end < record_length:
        raise ValueError("need 0 <= key_start <= key_end < record_length")
    if split_bytes is not None and split_bytes < 1:
        raise ValueError("split_bytes must be 1 or more")
    if engine not in (None, "arrow", "hadoop"):
        raise ValueError("engine must be 'arrow' or 'hadoop'")
    refuse_compressed(path)
    files = list_files(spark, path)
    for name, size in files:
        refuse_compressed(name)
        if size % record_length:
            raise ValueError(f"{name}: {size} bytes are no whole number of {record_length}-byte records")
    if engine is None:
        ranged = opener is not None or not files or _can_open(files[0][0])
        engine = "arrow" if ranged else "hadoop"
    if engine == "arrow":
        records = _read_ranges(spark, path, files, record_length, split_bytes, opener or open_input)
    else:
        records = _read_whole(spark, path, files, record_length)
    columns = [
        F.col("offset"),
        cells.record_number(F.col("offset"), record_length).alias("record"),
    ]
    if key_start is not None:
        columns.append(cells.byte_range(F.col("value"), key_start, key_end).alias("key"))
    return records.select(*columns, "value")


def write_fixed(df: DataFrame, path: str, record_length: int, overwrite: bool = False) -> None:
    """Write the ``value`` column, binary and ``record_length`` bytes in every row, as
    files of fixed-length records: one for each task, in a file system that pyarrow can
    open. Values of another length raise, and leave nothing behind. Runs a job."""
    if record_length is None or record_length <= 0:
        raise ValueError("record_length must be 1 or more")
    spark = df.sparkSession
    spark.dataSource.register(FixedLengthSource)
    schema = f"value {df.schema['value'].dataType.simpleString()}"
    if schema != "value binary":
        raise ValueError("value must be a binary column")
    rows = df.select(F.lit(0).cast("bigint").alias("offset"), "value")
    options = {"recordlength": str(record_length), "job": uuid.uuid4().hex}
    mode = "overwrite" if overwrite else "append"
    try:
        rows.write.format("fixedlength").options(**options).mode(mode).save(path)
    except Exception:
        # Tasks that were still at work when Spark gave up may have left files since.
        _remove(f"{path.rstrip('/')}/_temporary-{options['job']}")
        raise
