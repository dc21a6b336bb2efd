"""R factors and Gram matrices."""

from __future__ import annotations

from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from narrowmat.functions import cells
from narrowmat.functions.kernels import (
    GramSum, QRBlocks, pivoted_columns, positive_diagonal, rounding_level, row_block, row_column,
)
from narrowmat.operators.tiles import tiled_gram
from narrowmat.plans.reduce import Features, block_reduce, matrix_rows
from narrowmat.sources.tables import known_width, marked

# Up to this width all products of two columns are plain SQL sums: one
# generated aggregate without Python. Wider, numpy blocks are faster.
SQL_GRAM_COLUMNS = 8

# From this width on no task holds a whole Gram matrix (64 MiB).
TILED_GRAM_COLUMNS = 2897


class Counted(NamedTuple):
    """A factor with the counters of the job that made it."""

    factor: DataFrame
    stats: DataFrame


def factor_frame(spark: SparkSession, r: np.ndarray) -> DataFrame:
    """A small driver-side matrix as a factor."""
    r = np.atleast_2d(r)
    table = pa.table(
        {"i": pa.array(np.arange(len(r), dtype=np.int32)), "row": row_column(r)}
    )
    return spark.createDataFrame(table, "i int, row array<double>")


def check_driver_bytes(spark: SparkSession, size: int, what: str) -> None:
    """Raise if ``what`` is larger than the results the driver accepts."""
    given = spark.sparkContext.getConf().get("spark.driver.maxResultSize", "1g")
    limit = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(given)
    if 0 < limit < size:
        raise ValueError(
            f"{what} takes {size} bytes, more than spark.driver.maxResultSize ({given})"
        )


def parts_of(out: DataFrame | Counted) -> tuple[DataFrame, DataFrame | None]:
    """The factor and, if counted, its counters."""
    return out if isinstance(out, Counted) else (out, None)


def collect_factor(factor: DataFrame) -> np.ndarray:
    """A factor as a numpy array. It has at most as many rows as columns, and must
    keep within what the driver takes (``spark.driver.maxResultSize``): known widths
    are checked before anything runs, others by Spark itself."""
    n = known_width(factor)
    if n:
        check_driver_bytes(factor.sparkSession, 8 * n * n, f"a factor of {n} columns")
    table = factor.select("i", "row").toArrow().sort_by("i").combine_chunks()
    if not table.num_rows:
        raise ValueError("the matrix has no rows")
    return row_block(table.column("row").chunk(0))


def _check_blocks(blocksize, block_rows):
    if blocksize is not None and blocksize < 2:
        raise ValueError("blocksize must be 2 or more")
    if block_rows is not None and block_rows < 1:
        raise ValueError("block_rows must be 1 or more")


def tsqr(
    m: DataFrame,
    blocksize: int | None = None,
    block_rows: int | None = None,
    schedule=None,
    stats: bool = False,
    features: Features | None = None,
) -> DataFrame | Counted:
    """R of the QR factorisation of ``m``, with a diagonal of zeros or more.

    Every task keeps the R of its rows and hands on at most ``columns`` rows;
    ``schedule`` says how those are combined. ``blocksize`` (rows held before a
    compression, in multiples of the columns; the classic choice is 3) and
    ``block_rows`` (the same as a row count) trade memory for speed and do not
    change R; by default a block fits the cache. ``stats=True`` runs the job
    and returns ``(factor, stats)`` with tasks, rows, compressions and kernel
    milliseconds of each stage.
    """
    if stats:
        return reduced_tsqr(m, blocksize, block_rows, schedule, features).frames(m.sparkSession)
    _check_blocks(blocksize, block_rows)
    make = partial(QRBlocks, blocksize, block_rows)
    return _with_width_of(m, features, block_reduce(m, make, schedule, features))


def _with_width_of(m, features, factor):
    n = None if features else known_width(m)
    return factor.select("i", marked(F.col("row"), n))


class Reduced(NamedTuple):
    """A factor on the driver with the counters of the job that made it:
    ``(stage, tasks, rows, compressions, milliseconds)``."""

    r: np.ndarray
    counts: list[tuple]

    @property
    def rows(self) -> int:
        """Rows that went through any stage, matrix rows and partial ones."""
        return sum(rows for _, _, rows, _, _ in self.counts)

    def frames(self, spark: SparkSession) -> Counted:
        return Counted(factor_frame(spark, self.r), self.stats(spark))

    def stats(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            self.counts, "stage int, tasks long, rows long, compressions long, millis double"
        )


def _reduced(out: DataFrame) -> Reduced:
    table = out.toArrow()
    counters = table.filter(pc.less(table["i"], 0)).to_pylist()
    counts = [
        (-1 - c["i"], *(int(x) for x in c["row"][:3]), c["row"][3] * 1000.0)
        for c in sorted(counters, key=lambda c: -c["i"])
    ]
    factor = table.filter(pc.greater_equal(table["i"], 0)).sort_by("i").combine_chunks()
    if not factor.num_rows:
        raise ValueError("the matrix has no rows")
    return Reduced(row_block(factor.column("row").chunk(0)), counts)


def reduced_tsqr(
    m: DataFrame, blocksize=None, block_rows=None, schedule=None, features: Features | None = None
) -> Reduced:
    """R on the driver with the counters of its reduction. Runs a job; see ``tsqr``."""
    _check_blocks(blocksize, block_rows)
    n = None if features else known_width(m)
    if n:
        check_driver_bytes(m.sparkSession, 8 * n * n, f"a factor of {n} columns")
    make = partial(QRBlocks, blocksize, block_rows)
    return _reduced(block_reduce(m, make, schedule, features, counters=True))


def _sql_gram(m: DataFrame, n: int) -> DataFrame:
    at = cells.row_cells(F.col("row"), n)
    m = m.select(*[c.alias(f"c{i}") for i, c in enumerate(at)])
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    sums = m.agg(
        *[F.sum(F.col(f"c{i}") * F.col(f"c{j}")).alias(f"g{i}_{j}") for i, j in pairs]
    ).filter(F.col("g0_0").isNotNull())
    rows = [
        F.struct(
            F.lit(i).alias("i"),
            F.array(*[F.col(f"g{min(i, j)}_{max(i, j)}") for j in range(n)]).alias("row"),
        )
        for i in range(n)
    ]
    return sums.select(F.inline(F.array(*rows)))


def gram(
    m: DataFrame, schedule=None, features: Features | None = None, stats: bool = False
) -> DataFrame | Counted:
    """``AᵀA`` as a full symmetric factor; with ``stats=True`` as ``(factor, stats)``.

    Narrow matrices are summed by SQL aggregates; wider ones, those whose width
    the schema does not tell, and any with a ``schedule``, ``features`` or
    ``stats``, in numpy blocks combined over the schedule; very wide ones in tiles.
    """
    if stats:
        return _reduced(block_reduce(m, GramSum, schedule, features, counters=True)).frames(m.sparkSession)
    if schedule is None and features is None:
        n = known_width(m)
        if n and n <= SQL_GRAM_COLUMNS:
            return _sql_gram(m, n)
        if n and n >= TILED_GRAM_COLUMNS:
            return _with_width_of(m, None, tiled_gram(m, n))
    return _with_width_of(m, features, block_reduce(m, GramSum, schedule, features))


def cholesky_of(g: np.ndarray) -> np.ndarray:
    """Upper triangular R with ``RᵀR = g``.

    A pivot that rounding alone could have made raises: it has no correct digit.
    """
    n = len(g)
    try:
        r = np.linalg.cholesky(g).T
    except np.linalg.LinAlgError:
        raise ValueError("the Gram matrix is not positive definite") from None
    floor = 10 * n * np.finfo(float).eps * np.diagonal(g)
    weak = np.flatnonzero(np.diagonal(r) ** 2 <= floor)
    if len(weak):
        raise ValueError(
            f"the Gram matrix is not positive definite: column {weak[0]} depends "
            "on the columns before it"
        )
    return np.triu(r)


# Passes after the first that a shifted factorisation may take. Each gains seven
# digits or so, hence even a condition of 1e16 needs no more than four.
SHIFTED_PASSES = 6


class _Turned:
    """Features times small matrices, one after the other, inside the first stage."""

    def __init__(self, features: Features, matrices: list[np.ndarray]):
        self.features, self.matrices = features, matrices

    def __call__(self, batch):
        block = self.features(batch)
        for matrix in self.matrices:
            block = block @ matrix
        return block


def _shifted(g: np.ndarray, level: float) -> np.ndarray:
    """R of a Gram matrix that rounding may have made indefinite, with the least shift
    of its diagonal that makes up for it."""
    shift = 11 * (len(g) + 1) * level * np.trace(g)
    while True:
        try:
            return np.linalg.cholesky(g + shift * np.eye(len(g))).T
        except np.linalg.LinAlgError:
            if not np.isfinite(shift) or not shift:
                raise ValueError("the Gram matrix is not positive definite") from None
            shift *= 100


def cholesky_qr(
    m: DataFrame, schedule=None, features: Features | None = None, shifted: bool = True
) -> DataFrame:
    """R by the Cholesky factorisation of the Gram matrix. Runs a job, and more where
    one is not enough.

    The Gram matrix squares the condition number, so a pivot of a column that others
    nearly make up loses twice its digits, and beyond 1e8 all. Then the rows are
    multiplied by the inverse of the R found, inside the next pass, and their Gram
    matrix is factored in turn until the rows are orthogonal; where a pivot is
    lost, the diagonal is shifted first. R is the product of all factors, and as good
    as that of ``tsqr``. With ``shifted=False`` the first factor is the result, and a
    lost pivot raises. Columns that depend on others always raise.
    """
    spark = m.sparkSession
    g = collect_factor(gram(m, schedule, features))
    step = None
    try:
        step = cholesky_of(g)
        if not shifted or (np.diagonal(step) ** 2 > np.sqrt(np.finfo(float).eps) * np.diagonal(g)).all():
            return factor_frame(spark, step)
    except ValueError:
        if not shifted or not np.isfinite(g).all() or not np.diagonal(g).all():
            raise
    n, plain = len(g), features or matrix_rows
    source = m if features else m.select("row")
    inverses, r, rows = [], np.eye(n), 1
    for _ in range(SHIFTED_PASSES + 1):
        near = bool(inverses) and np.abs(g - np.eye(n)).max() < 0.5
        if near:
            step = cholesky_of(g)
        elif step is None or inverses:
            step = _shifted(g, rounding_level(n, rows))
        r = np.triu(step @ r)
        if near:
            break
        inverses.append(np.linalg.solve(step, np.eye(n)))
        made = _reduced(block_reduce(source, GramSum, schedule, _Turned(plain, inverses), counters=True))
        g, rows = made.r, made.rows
    else:
        raise ValueError("the columns depend on each other: shifted factors do not converge")
    taken, others, _ = pivoted_columns(r, rounding_level(n, rows))
    if others:
        raise ValueError(
            f"the Gram matrix is not positive definite: column {min(others)} depends on the columns before it"
        )
    return factor_frame(spark, positive_diagonal(r))
