"""Matrix views over DataFrames, and the Parquet sink.

A *matrix* is a DataFrame with ``row: array<double>`` and, optionally, ``key``.
A *factor* is a DataFrame ``i: int, row: array<double>`` with one row per matrix
row of a small result.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from narrowmat.functions import cells
from narrowmat.functions.kernels import binary_bytes

# What is put before the extension of a matrix name to name the
# result of an operation on it.
RESULT_SUFFIX = {
    "tsqr": "-qrr",
    "cholesky_qr": "-chol-qrr",
    "svd_left": "-svd-U",
    "gram": "-normal",
}


def _column(item: str | Column) -> Column:
    return F.col(item) if isinstance(item, str) else item


def marked(row: Column, width: int | None) -> Column:
    """``row``, with its width as column metadata, which saves a job later on."""
    return row.alias("row", metadata={"ncols": width}) if width else row.alias("row")


def _check_mode(on_bad_rows: str) -> None:
    if on_bad_rows not in ("raise", "drop"):
        raise ValueError("on_bad_rows must be 'raise' or 'drop'")


def known_width(m: DataFrame) -> int | None:
    """Number of columns if the schema is marked with it."""
    return m.schema["row"].metadata.get("ncols")


def width(m: DataFrame) -> int:
    """Number of columns, from the schema if it is marked, else from one row."""
    known = known_width(m)
    if known:
        return known
    first = m.select(F.size("row").alias("n")).first()
    if first is None:
        raise ValueError("the matrix has no rows")
    if first.n < 0:
        raise ValueError("matrix row is null")
    return first.n


def usual_width(m: DataFrame) -> int:
    """The most frequent width of all rows (of equally frequent ones the largest):
    what decides which rows are bad may not depend on the order of files."""
    known = known_width(m)
    if known:
        return known
    sizes = m.filter(F.col("row").isNotNull()).groupBy(F.size("row").alias("n")).count()
    top = sizes.orderBy(F.desc("count"), F.desc("n")).first()
    if top is None:
        raise ValueError("the matrix has no rows")
    return top.n


def validate_matrix(
    m: DataFrame, n: int | None = None, on_bad_rows: str = "raise"
) -> DataFrame:
    """Hold every row to ``n`` non-null cells: raise, or drop the others."""
    _check_mode(on_bad_rows)
    n = n or (usual_width(m) if on_bad_rows == "drop" else width(m))
    others = [c for c in m.columns if c != "row"]
    row = F.col("row")
    if on_bad_rows == "drop":
        return m.filter(cells.is_full(row, n)).select(*others, marked(row, n))
    problem = F.concat(
        F.lit(f"matrix row must have {n} non-null entries, found "),
        F.coalesce(F.to_json(F.struct(row)), F.lit("null")),
    )
    kind = "array<double>"
    held = F.when(cells.is_full(row, n), row).otherwise(cells.fail(problem, kind))
    return m.select(*others, marked(held, n))


def _unpack(batches):
    for batch in batches:
        packed = batch.column(batch.num_columns - 1)
        if packed.null_count:
            raise ValueError("packed row is null")
        edges, body = binary_bytes(packed)
        if np.any(np.diff(edges) % 8):
            raise ValueError("packed row is not a whole number of doubles")
        values = np.frombuffer(body.tobytes(), dtype="<f8")
        rows = pa.ListArray.from_arrays(
            pa.array(edges // 8), pa.array(values)
        )
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], rows], names=batch.schema.names
        )


def _pack(batches):
    for batch in batches:
        rows = batch.column(batch.num_columns - 1)
        if rows.null_count or rows.flatten().null_count:
            raise ValueError("null in a matrix row")
        edges = rows.offsets.to_numpy()
        edges = (edges - edges[:1]) * 8
        data = rows.flatten().to_numpy(zero_copy_only=False).astype("<f8")
        packed = pa.Array.from_buffers(
            pa.binary(),
            len(rows),
            [None, pa.py_buffer(edges.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())],
        )
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], packed], names=batch.schema.names
        )


def _with_last(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*df.schema.fields[:-1], T.StructField(name, kind)])


def unpack_rows(df: DataFrame, value: str = "row") -> DataFrame:
    """Rows of packed little-endian doubles (binary) as a matrix."""
    others = [c for c in df.columns if c != value]
    source = df.select(*others, F.col(value).alias("row"))
    kind = T.ArrayType(T.DoubleType())
    return source.mapInArrow(_unpack, _with_last(source, "row", kind))


def pack_rows(m: DataFrame) -> DataFrame:
    """A matrix with ``row`` packed as little-endian doubles (binary ``value``)."""
    others = [c for c in m.columns if c != "row"]
    source = m.select(*others, F.col("row").alias("value"))
    return source.mapInArrow(_pack, _with_last(source, "value", T.BinaryType()))


def as_matrix(
    df: DataFrame,
    cols: Sequence[str | Column] | None = None,
    row: str | None = None,
    key: str | Column | None = None,
    packed: bool = False,
    n: int | None = None,
    on_bad_rows: str = "raise",
) -> DataFrame:
    """View a DataFrame as a matrix.

    Give ``cols`` for a table with one column per matrix column, or ``row`` for
    one column holding the whole row: an array of numbers, a text of blank
    separated numbers, or packed doubles. Rows of the wrong width and null cells
    raise when they are read, or are left out with ``on_bad_rows="drop"``.
    """
    _check_mode(on_bad_rows)
    keep = key if key is not None else ("key" if "key" in df.columns else None)
    keys = [] if keep is None else [_column(keep).alias("key")]
    drop = on_bad_rows == "drop"
    if cols is not None:
        if row is not None:
            raise ValueError("give either cols or row")
        entries = [_column(c).cast("double") for c in cols]
        if n is not None and n != len(entries):
            raise ValueError(f"{len(entries)} columns given, n is {n}")
        if drop:
            full = entries[0].isNotNull()
            for entry in entries[1:]:
                full = full & entry.isNotNull()
            df = df.filter(full)
        else:
            entries = [cells.cell(e, str(c)) for e, c in zip(entries, cols)]
        return df.select(*keys, marked(F.array(*entries), len(entries)))
    row = row or ("row" if "row" in df.columns else df.columns[-1])
    kind = df.schema[row].dataType
    value = F.col(row)
    if packed or isinstance(kind, T.BinaryType):
        m = unpack_rows(df.select(*keys, value.alias("row")))
    elif isinstance(kind, T.StringType):
        lines = df.filter(cells.has_numbers(value))
        m = lines.select(*keys, cells.numbers(value, strict=not drop).alias("row"))
    elif isinstance(kind, T.ArrayType):
        m = df.select(*keys, value.cast("array<double>").alias("row"))
    else:
        raise TypeError(f"column {row} of type {kind.simpleString()} holds no row")
    return validate_matrix(m, n, on_bad_rows)


def as_labelled(
    df: DataFrame,
    rhs: str | Column | None = None,
    cols: Sequence[str | Column] | None = None,
    text: str | None = None,
    row: str | None = None,
    key: str | Column | None = None,
) -> DataFrame:
    """Rows with a right hand side: ``key`` (if any), ``rhs``, ``row``.

    Either from ``rhs`` with ``cols`` (or an array column ``row``), or from a
    ``text`` column whose first number is the right hand side.
    """
    keep = key if key is not None else ("key" if "key" in df.columns else None)
    keys = [] if keep is None else [_column(keep).alias("key")]
    if text is not None:
        all_numbers = cells.numbers(F.col(text))
        lines = df.filter(cells.has_numbers(F.col(text))).select(
            *keys, all_numbers.alias("all")
        )
        held = F.when(F.size("all") >= 2, F.col("all")).otherwise(
            cells.fail("a labelled row needs two numbers or more", "array<double>")
        )
        return lines.withColumn("all", held).select(
            *[F.col("key") for _ in keys],
            F.element_at("all", 1).alias("rhs"),
            F.slice("all", F.lit(2), F.size("all") - 1).alias("row"),
        )
    if rhs is None or (cols is None) == (row is None):
        raise ValueError("give text, or rhs with cols or row")
    label = cells.cell(_column(rhs), str(rhs)).alias("rhs")
    if row is not None:
        return df.select(*keys, label, F.col(row).cast("array<double>").alias("row"))
    entries = [cells.cell(_column(c), str(c)) for c in cols]
    return df.select(*keys, label, marked(F.array(*entries), len(entries)))


def replicate(df: DataFrame, times: int) -> DataFrame:
    """Every row ``times`` times, without a join or a shuffle."""
    if times < 1:
        raise ValueError("times must be 1 or more")
    copies = F.explode(F.array_repeat(F.lit(True), times)).alias("_copy")
    return df.select("*", copies).drop("_copy")


def with_random_keys(m: DataFrame, seed: int = 0) -> DataFrame:
    """``m`` with a random ``key`` between 0 and 4,000,000,000."""
    others = [c for c in m.columns if c != "key"]
    return m.select(F.floor(F.rand(seed) * 4_000_000_001).alias("key"), *others)


def with_first_keys(factor: DataFrame, first_key) -> DataFrame:
    """Factor rows keyed by (first input key, row number). ``first_key``: a value, or
    the matrix itself, whose smallest ``key`` is then found by a job."""
    if isinstance(first_key, DataFrame):
        first_key = first_key.agg(F.min("key")).first()[0]
    return factor.select(
        F.struct(F.lit(first_key).alias("first"), F.col("i")).alias("key"), "row"
    )


def default_output(mat: str, operation: str) -> str:
    """Where the result of ``operation`` on the matrix at ``mat`` goes."""
    name, extension = os.path.splitext(mat)
    return name + RESULT_SUFFIX[operation] + extension


def save(
    df: DataFrame,
    path: str | None = None,
    mat: str | None = None,
    operation: str = "tsqr",
    overwrite: bool = True,
) -> str:
    """Write zstd Parquet to ``path`` (by default named after ``mat``)."""
    if path is None:
        if mat is None:
            raise ValueError("give path or mat")
        path = default_output(mat, operation)
    mode = "overwrite" if overwrite else "errorifexists"
    df.write.mode(mode).option("compression", "zstd").parquet(path)
    return path
