"""Least squares by one reduction of the rows with their right hand side."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from narrowmat.functions.kernels import rank_tolerance
from narrowmat.operators.factor import factor_frame, reduced_tsqr


@dataclass
class LeastSquares:
    """Coefficients ``x (j, x)``, ``R``, ``y (j, y)`` with ``R x = y``, and the
    norm of the residual; ``stats`` if counters were asked for."""

    x: DataFrame
    R: DataFrame
    y: DataFrame
    residual: float
    solution: np.ndarray
    target: np.ndarray
    stats: DataFrame | None = None

    def bundle(self) -> dict[str, DataFrame]:
        spark = self.R.sparkSession
        return {
            "-R": self.R,
            "-y": factor_frame(spark, self.target.reshape(-1, 1)),
            "-sol": factor_frame(spark, self.solution.reshape(-1, 1)),
        }


def solve_augmented(r: np.ndarray, rows: float = 1):
    """Coefficients, right hand side and residual from the R of ``[A | b]`` that
    ``rows`` rows were reduced to."""
    n = r.shape[1] - 1
    if n < 1:
        raise ValueError("no column beside the right hand side")
    if r.shape[0] < n:
        raise ValueError(f"R is not square: {r.shape[0]} rows, {n} columns")
    square, y = r[:n, :n], r[:n, n]
    # Columns of any scale are fine; dependent ones are not.
    norms = np.linalg.norm(square, axis=0)
    s = np.linalg.svd(square / np.where(norms > 0, norms, 1.0), compute_uv=False)
    if (s <= rank_tolerance(s, n, max(rows, (100 * n) ** 2))).any():
        raise ValueError("R is singular: the columns depend on each other")
    residual = float(abs(r[n, n])) if r.shape[0] > n else 0.0
    return np.linalg.solve(square, y), square, y, residual


def least_squares(labelled: DataFrame, features=None, stats: bool = False, **options) -> LeastSquares:
    """Minimise ``|A x - b|`` over labelled rows (``rhs``, ``row``). Runs a job.

    The last column of the R of ``[A | b]`` is what the orthogonal factor makes
    of b, and its last entry the norm of the residual, so one pass gives all.
    """
    spark = labelled.sparkSession
    if features is None:
        label = F.coalesce(
            "rhs", F.raise_error(F.lit("null right hand side")).cast("double")
        )
        labelled = labelled.select(F.concat("row", F.array(label)).alias("row"))
    found = reduced_tsqr(labelled, features=features, **options)
    x, r, y, residual = solve_augmented(found.r, found.rows)
    places = pa.array(range(len(x)), pa.int32())
    return LeastSquares(
        x=spark.createDataFrame(pa.table({"j": places, "x": x}), "j int, x double"),
        R=factor_frame(spark, r),
        y=spark.createDataFrame(pa.table({"j": places, "y": y}), "j int, y double"),
        residual=residual,
        solution=x,
        target=y,
        stats=found.stats(spark) if stats else None,
    )
