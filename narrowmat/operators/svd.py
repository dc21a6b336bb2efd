"""Singular values and vectors by way of R."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from narrowmat.functions.kernels import chunks, rank_tolerance, row_block, row_column
from narrowmat.operators.blocked import blocked_product
from narrowmat.operators.direct import DirectQR
from narrowmat.operators.factor import (
    check_driver_bytes, collect_factor, factor_frame, parts_of, reduced_tsqr, tsqr,
)
from narrowmat.sources.tables import known_width


@dataclass
class SVD:
    """``S (k, s)``, ``V (k, j, v)``, ``R`` and the numerical rank.

    ``s`` and ``v`` are the same numbers on the driver; column k of ``v`` is the
    k-th right singular vector, signed so that its first entry is not negative.
    ``stats`` are the counters of the job, if they were asked for.
    """

    S: DataFrame
    V: DataFrame
    R: DataFrame
    rank: int
    s: np.ndarray
    v: np.ndarray
    stats: DataFrame | None = None

    def bundle(self) -> dict[str, DataFrame]:
        spark = self.R.sparkSession
        return {
            "-V": factor_frame(spark, self.v.T),
            "-S": factor_frame(spark, self.s.reshape(-1, 1)),
            "": self.R,
        }


def right_factor(r: np.ndarray, rows: float, rcond: float | None = None):
    """``s``, signed ``v`` and the rank of an R that ``rows`` rows were reduced to."""
    _, s, vt = np.linalg.svd(r, full_matrices=False)
    v = vt.T * np.where(vt[:, 0] < 0, -1.0, 1.0)
    tolerance = rank_tolerance(s, r.shape[1], rows) if rcond is None else rcond * s[0]
    return s, v, int((s > tolerance).sum())


def svd(m: DataFrame, rcond: float | None = None, stats: bool = False, **options) -> SVD:
    """Singular values and right singular vectors. Runs a job.

    A matrix shares both with its R. Values up to ``rcond`` times the largest
    count as zero in ``rank``; by default that is the rounding level of R, which the
    rows that went through the reduction determine, not how they were split.
    """
    spark = m.sparkSession
    found = reduced_tsqr(m, **options)
    r = found.r
    s, v, rank = right_factor(r, found.rows, rcond)
    kinds = "k int, s double"
    values = pa.table({"k": pa.array(range(len(s)), pa.int32()), "s": s})
    n, count = v.shape
    vectors = pa.table(
        {
            "k": pa.array(np.repeat(np.arange(count), n).astype(np.int32)),
            "j": pa.array(np.tile(np.arange(n), count).astype(np.int32)),
            "v": v.T.ravel(),
        }
    )
    return SVD(
        S=spark.createDataFrame(values, kinds),
        V=spark.createDataFrame(vectors, "k int, j int, v double"),
        R=factor_frame(spark, r),
        rank=rank,
        s=s,
        v=v,
        stats=found.stats(spark) if stats else None,
    )


def _multiply(shared):
    def run(batches):
        for batch in batches:
            block = row_block(batch.column("row"))
            if not len(block):
                continue
            for matrix in shared.value:
                if block.shape[1] != matrix.shape[0]:
                    raise ValueError(
                        f"rows of width {block.shape[1]} times a matrix of "
                        f"{matrix.shape[0]} rows"
                    )
                block = block @ matrix
            # A much wider product is cut so that no Arrow batch grows too big.
            for start, end in chunks(*block.shape):
                columns = [
                    row_column(block[start:end])
                    if name == "row"
                    else batch.column(name).slice(start, end - start)
                    for name in batch.schema.names
                ]
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return run


def project(m: DataFrame, matrix) -> DataFrame:
    """Every row times a small matrix (or several, one after the other).

    Keys stay with their rows and nothing is shuffled. The matrices are
    broadcast; together they may not exceed ``spark.driver.maxResultSize``. A matrix
    given as a factor (a frame of ``i, row``) may be of any size: it is never
    collected, see ``blocked_product``.
    """
    if isinstance(matrix, DataFrame):
        return blocked_product(m, matrix)
    several = isinstance(matrix, (list, tuple)) and np.ndim(matrix[0]) == 2
    matrices = matrix if several else [matrix]
    matrices = [np.ascontiguousarray(x, dtype=float) for x in matrices]
    for x in matrices:
        if x.ndim != 2:
            raise ValueError("project needs two-dimensional matrices")
    check_driver_bytes(m.sparkSession, sum(x.nbytes for x in matrices), "what project broadcasts")
    known = known_width(m)
    if known and known != matrices[0].shape[0]:
        raise ValueError(
            f"rows of width {known} times a matrix of {matrices[0].shape[0]} rows"
        )
    shared = m.sparkSession.sparkContext.broadcast(matrices)
    row = T.StructField(
        "row", T.ArrayType(T.DoubleType()), metadata={"ncols": matrices[-1].shape[1]}
    )
    names = [c for c in ("key", "row") if c in m.columns]
    source = m.select(*names)
    schema = T.StructType([row if f.name == "row" else f for f in source.schema])
    return source.mapInArrow(_multiply(shared), schema)


def left_map(found: SVD) -> np.ndarray:
    """``V S⁺``: takes a row of the matrix to its row of U."""
    inverse = np.zeros(len(found.s))
    inverse[: found.rank] = 1.0 / found.s[: found.rank]
    return found.v * inverse


# Projecting loses about as many digits of orthogonality as the condition number has.
DIRECT_CONDITION = 1e5


def svd_left(
    m: DataFrame,
    refine: bool = False,
    found: SVD | None = None,
    rcond: float | None = None,
    method: str | None = None,
    **options,
) -> DataFrame:
    """Left singular vectors, one row per row of ``m`` with the same ``key``.

    ``method="project"`` multiplies the rows by ``V S⁺``: a job for R (unless
    ``found`` brings an SVD along), then lazy. U loses as many digits of
    orthogonality as the condition number has; ``refine=True`` factors U once more
    and corrects it, for one more pass. ``method="direct"`` keeps the orthogonal
    factors of the blocks and multiplies these (``DirectQR``, which writes them to
    ``spark.checkpoint.dir``): orthogonal to rounding at any condition, from one
    factorisation. By default the condition decides, once R is known.
    Components beyond the rank are zero.
    """
    if method not in (None, "project", "direct"):
        raise ValueError("method must be 'project' or 'direct'")
    if method == "direct":
        return _direct_left(m, rcond)
    found = found or svd(m, rcond, **options)
    if method is None and not refine and found.rank and "features" not in options:
        if found.s[0] > DIRECT_CONDITION * found.s[found.rank - 1]:
            return _direct_left(m, rcond, found.rank)
    first = left_map(found)
    if not refine or not found.rank:
        return project(m, first)
    rank, n = found.rank, first.shape[1]
    first = first[:, :rank]
    again = collect_factor(parts_of(tsqr(project(m, first), **options))[0])
    if again.shape[0] < rank:
        raise ValueError("cannot refine: fewer rows than the rank")
    # A V S⁺ = Q R2, so A restricted to its row space is Q (R2 S) Vᵀ; the small
    # SVD of R2 S turns Q and V into the corrected singular vectors.
    turn, _, back = np.linalg.svd(again * found.s[:rank])
    fixed = found.v[:, :rank] @ back.T
    turn = turn * np.where(fixed[0] < 0, -1.0, 1.0)
    second = np.zeros((rank, n))
    second[:, :rank] = np.linalg.solve(again, turn)
    return project(m, [first, second])


def _direct_left(m: DataFrame, rcond: float | None, rank: int | None = None) -> DataFrame:
    tree = DirectQR(m)
    # A = Q R and R = (turn) S Vᵀ, hence U = Q (turn), signed as V is.
    turn, s, vt = np.linalg.svd(tree.r, full_matrices=False)
    turn = turn * np.where(vt[:, 0] < 0, -1.0, 1.0)
    if rank is None:
        tolerance = rank_tolerance(s, tree.r.shape[1], tree.total) if rcond is None else rcond * s[0]
        rank = int((s > tolerance).sum())
    turn[:, rank:] = 0.0
    return tree.times(turn)


def variance_share(S: DataFrame, power: int = 1) -> DataFrame:
    """Running share of the singular values (of their ``power``) in the total.

    The window is over one value per component, not over rows of the matrix.
    """
    term = F.pow("s", F.lit(power)) if power != 1 else F.col("s")
    so_far = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.orderBy("k").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    share = F.sum(term).over(so_far) / F.sum(term).over(whole)
    return S.select("k", "s", share.alias("share"))


def top_components(V: DataFrame, k: int) -> DataFrame:
    """The first ``k`` components of V."""
    return V.filter(F.col("k") < k)
