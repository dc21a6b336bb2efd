"""Images stored as fixed-length records: all red bytes, then green, then blue."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from narrowmat.functions.kernels import binary_bytes, centred_block, row_column
from narrowmat.operators.regress import LeastSquares, least_squares
from narrowmat.operators.svd import SVD, svd

# Weights of red, green and blue in a gray pixel.
GRAY_WEIGHTS = (0.299, 0.587, 0.114)

# Fixed value: images are 32 x 32 pixels unless said otherwise.
SIDE = 32


def image_planes(values: pa.Array, side: int) -> np.ndarray:
    """Binary records as records x 3 x pixels, without a copy."""
    size = 3 * side * side
    if values.null_count:
        raise ValueError("image record is null")
    edges, body = binary_bytes(values)
    if np.any(np.diff(edges) != size):
        raise ValueError(f"image records must have {size} bytes")
    return body.reshape(len(values), 3, side * side)


def gray_block(planes: np.ndarray) -> np.ndarray:
    red, green, blue = GRAY_WEIGHTS
    mixed = red * planes[:, 0] + green * planes[:, 1] + blue * planes[:, 2]
    return mixed / 255.0


def _sums(side, batches):
    for batch in batches:
        if batch.num_rows:
            planes = image_planes(batch.column("value"), side)
            sums = planes.sum(axis=2, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("record"), *(pa.array(sums[:, c]) for c in range(3))],
                names=["record", "r", "g", "b"],
            )


def rgb_sums(records: DataFrame, side: int = SIDE) -> DataFrame:
    """Sums of the red, green and blue bytes of every record."""
    source = records.select("record", "value")
    plane = [T.StructField(c, T.LongType()) for c in "rgb"]
    schema = T.StructType([source.schema["record"], *plane])
    return source.mapInArrow(partial(_sums, side), schema)


def _grays(side, batches):
    for batch in batches:
        if batch.num_rows:
            block = gray_block(image_planes(batch.column("value"), side))
            yield pa.RecordBatch.from_arrays(
                [batch.column("record"), row_column(block)], names=["key", "row"]
            )


def to_gray(records: DataFrame, side: int = SIDE) -> DataFrame:
    """Gray pixels from 0 to 1 as a matrix keyed by record."""
    source = records.select("record", "value")
    row = T.StructField(
        "row", T.ArrayType(T.DoubleType()), metadata={"ncols": side * side}
    )
    key = T.StructField("key", source.schema["record"].dataType)
    return source.mapInArrow(partial(_grays, side), T.StructType([key, row]))


def _gray_and_red(side, batch):
    planes = image_planes(batch.column("value"), side)
    red = planes[:, 0].sum(axis=1, dtype=np.int64)
    return np.column_stack([gray_block(planes), red])


def image_regression(records: DataFrame, side: int = SIDE, **options) -> LeastSquares:
    """Regress the red sum of every image on its gray pixels. Runs a job.

    Pixels are unpacked inside the first stage, so only the raw bytes and one
    small factor per task leave it.
    """
    return least_squares(
        records.select("value"), features=partial(_gray_and_red, side), **options
    )


def _centred_gray(side, batch):
    return centred_block(gray_block(image_planes(batch.column("value"), side)))


def image_pca(records: DataFrame, side: int = SIDE, **options) -> SVD:
    """Principal components of the row-centred gray pixels. Runs a job."""
    return svd(records.select("value"), features=partial(_centred_gray, side), **options)
