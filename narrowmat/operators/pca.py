"""Principal components of row-centred matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from narrowmat.functions import cells
from narrowmat.functions.kernels import centred_block
from narrowmat.operators.svd import SVD, svd
from narrowmat.plans.reduce import matrix_rows


def center_rows(m: DataFrame) -> DataFrame:
    """Subtract from every entry the mean of its own row."""
    others = [c for c in m.columns if c != "row"]
    marks = m.schema["row"].metadata
    return m.select(
        *others, cells.centred(F.col("row")).alias("row", metadata=marks)
    )


def _centred_rows(batch):
    return centred_block(matrix_rows(batch))


def pca(m: DataFrame, center: str | None = "row", **options) -> SVD:
    """SVD of the matrix with centred rows. Runs a job.

    Rows are centred by their own mean (``center="row"``) inside the first
    stage, or not at all (``None``). Centred rows always lack one rank.
    """
    if center not in ("row", None):
        raise ValueError("center must be 'row' or None")
    source = m.select("row")
    features = _centred_rows if center == "row" else matrix_rows
    return svd(source, features=features, **options)
