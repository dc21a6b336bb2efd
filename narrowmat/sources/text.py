"""Text matrices: one row per line, blank-separated numbers."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from narrowmat.functions import cells
from narrowmat.functions.kernels import chunks, row_block
from narrowmat.sources.tables import validate_matrix

# Fixed value: 17 significant digits, enough to read the same double back.
NUMBER_FORMAT = "%18.16e"


def split_bytes_for(n: int) -> int:
    """A split size for ``n`` columns: 256 MiB, or 64 times what it is reduced
    to if that is more, so that little is shuffled."""
    return max(256 << 20, 64 * 8 * n * n)


def split_session(spark: SparkSession, split_bytes: int | None) -> SparkSession:
    """A session like ``spark`` whose file scans (of any format) make tasks of about
    ``split_bytes``. A scan keeps the session it was made in, so tables of different
    split sizes can be used together and ``spark`` itself does not change."""
    if split_bytes is None:
        return spark
    own = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if name.startswith("spark.sql.") and own.conf.isModifiable(name):
            own.conf.set(name, value)
    own.conf.set("spark.sql.files.maxPartitionBytes", str(int(split_bytes)))
    return own


def read_text_matrix(
    spark: SparkSession,
    path: str,
    n: int | None = None,
    split_bytes: int | None = None,
    on_bad_rows: str = "raise",
) -> DataFrame:
    """A text matrix as a matrix; blank lines are left out.

    A word that is no number and a row of another width raise, or cost their
    row with ``on_bad_rows="drop"``. ``split_bytes`` holds for this table alone.
    """
    lines = split_session(spark, split_bytes).read.text(path).filter(cells.has_numbers(F.col("value")))
    strict = on_bad_rows != "drop"
    m = lines.select(cells.numbers(F.col("value"), strict).alias("row"))
    return validate_matrix(m, n, on_bad_rows)


def _format_rows(batches):
    for batch in batches:
        block = row_block(batch.column("row"))
        line = " ".join([NUMBER_FORMAT] * block.shape[1])
        lines = []
        for start, end in chunks(*block.shape, bytes_per_chunk=1 << 22):
            text = "\n".join([line] * (end - start))
            lines += (text % tuple(block[start:end].ravel().tolist())).split("\n")
        yield pa.RecordBatch.from_pydict({"value": pa.array(lines, pa.string())})


def format_rows(m: DataFrame) -> DataFrame:
    """Every row as one line of text (column ``value``)."""
    return m.select("row").mapInArrow(_format_rows, "value string")


def _write_lines(lines: DataFrame, path: str, overwrite: bool, compression: str | None) -> None:
    writer = lines.write.mode("overwrite" if overwrite else "errorifexists")
    if compression:
        writer = writer.option("compression", compression)
    writer.text(path)


def write_text_matrix(
    df: DataFrame, path: str, overwrite: bool = False, ordered: bool = False,
    compression: str | None = None,
) -> None:
    """Write a matrix; a factor with ``ordered=True`` as one file in the order of
    ``i``. ``compression``: a codec of Spark's text files, such as ``gzip``."""
    if ordered:
        df = df.repartition(1).sortWithinPartitions("i")
    _write_lines(format_rows(df), path, overwrite, compression)


def write_labelled(
    df: DataFrame, path: str, overwrite: bool = False, compression: str | None = None
) -> None:
    """Write labelled rows: the right hand side first, then the row."""
    joined = df.select(F.concat(F.array("rhs"), "row").alias("row"))
    _write_lines(format_rows(joined), path, overwrite, compression)


def write_factors(
    result, base: str, overwrite: bool = False, compression: str | None = None
) -> list[str]:
    """Write the factors of an SVD, PCA or least-squares result.

    An SVD or PCA gives ``base-V.tmat`` (one component per line),
    ``base-S.tmat`` and ``base.tmat`` (R); least squares gives ``base-R.tmat``,
    ``base-y.tmat`` and ``base-sol.tmat``.
    """
    paths = []
    for suffix, factor in result.bundle().items():
        paths.append(f"{base}{suffix}.tmat")
        write_text_matrix(factor, paths[-1], overwrite, ordered=True, compression=compression)
    return paths
