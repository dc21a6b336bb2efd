import numpy as np

import narrowmat as nm

# The 20 x 4 sample matrix, row by row.
TINY = np.array(
    [
        [6, 3, -1, 5], [8, -9, -2, -5], [-7, 7, 5, 0], [8, 8, 6, 4], [3, 3, -6, 7],
        [-8, 5, 0, 9], [-4, 5, -1, 1], [1, -2, 3, -7], [9, 3, 4, -7], [9, -6, 5, -5],
        [-7, 4, -4, 6], [9, -9, 3, -5], [9, -4, 3, 6], [0, -9, -6, -5], [6, -8, -7, 8],
        [-7, 6, 0, -3], [-1, 4, 9, -6], [8, -3, -3, -5], [6, 9, 2, 2], [9, -9, -5, -1],
    ],
    dtype=float,
)


def matrix(spark, a, parts=3):
    """A numpy matrix as a keyed matrix in ``parts`` partitions."""
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(a)]
    df = spark.createDataFrame(rows, "key long, row array<double>")
    return df.repartition(parts) if parts else df


def rows_of(df, column="row"):
    """The rows of a keyed matrix in the order of their keys."""
    return np.array([r[column] for r in sorted(df.collect(), key=lambda r: r.key)])


def r_of(a):
    """R with a diagonal of zeros or more, by numpy."""
    r = np.linalg.qr(a, mode="r")
    sign = np.where(np.diagonal(r) < 0, -1.0, 1.0)
    r[: len(sign)] *= sign[:, None]
    return r


def factor(df):
    return nm.collect_factor(df)
