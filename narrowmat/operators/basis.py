"""Which columns of a matrix depend on others, by a pivoted factorisation of R."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from narrowmat.functions.kernels import pivoted_columns, rounding_level
from narrowmat.operators.factor import reduced_tsqr


@dataclass
class ColumnBasis:
    """``columns (j, place, independent, share)``: ``place`` is the column's place in
    the basis (null for the others), ``share`` how much of its length the columns
    before it in the basis leave unexplained. ``relations (j, k, coefficient)``:
    dependent column ``j`` is the sum of ``coefficient`` times basis column ``k``.
    """

    columns: DataFrame
    relations: DataFrame
    rank: int
    basis: list[int]
    coefficients: dict[int, np.ndarray]


def column_basis(m: DataFrame, rcond: float | None = None, **options) -> ColumnBasis:
    """The columns that no columns before them add up to, and how the others come
    from them. Runs a job.

    A matrix shares the relations between its columns with its R. A column counts as
    dependent if what the basis leaves of it is within ``rcond`` (by default the
    rounding level of R) of the lengths that cancel. Columns of zeros depend on none,
    with no relation. ``options`` are those of ``tsqr``.
    """
    spark = m.sparkSession
    found = reduced_tsqr(m, **options)
    r = found.r
    level = rounding_level(r.shape[1], found.rows) if rcond is None else rcond
    taken, others, share = pivoted_columns(r, level)
    place = {j: p for p, j in enumerate(taken)}
    n = r.shape[1]
    columns = pa.table(
        {
            "j": pa.array(range(n), pa.int32()),
            "place": pa.array([place.get(j) for j in range(n)], pa.int32()),
            "independent": pa.array([j in place for j in range(n)]),
            "share": pa.array(share),
        }
    )
    lines = [(j, taken[p], float(c)) for j, sums in others.items() for p, c in enumerate(sums) if c]
    relations = pa.table(
        {
            "j": pa.array([x[0] for x in lines], pa.int32()),
            "k": pa.array([x[1] for x in lines], pa.int32()),
            "coefficient": pa.array([x[2] for x in lines], pa.float64()),
        }
    )
    return ColumnBasis(
        columns=spark.createDataFrame(columns, "j int, place int, independent boolean, share double"),
        relations=spark.createDataFrame(relations, "j int, k int, coefficient double"),
        rank=len(taken),
        basis=taken,
        coefficients=others,
    )
