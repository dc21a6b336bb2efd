import numpy as np
import pytest
from pyspark.errors import PySparkException

import narrowmat as nm
from helpers import TINY, factor


def labelled(spark, a, b, parts=3):
    rows = [(i, float(y), [float(x) for x in row]) for i, (y, row) in enumerate(zip(b, a))]
    return spark.createDataFrame(rows, "key long, rhs double, row array<double>").repartition(parts)


def test_golden_fit(spark):
    fit = nm.least_squares(labelled(spark, TINY[:, 1:], TINY[:, 0]))
    assert np.allclose(fit.solution, [-0.710154401968, 0.549536066714, 0.169064000387])
    assert np.isclose(fit.residual, 25.64155298174)
    assert np.allclose(factor(fit.R) @ fit.solution, fit.target)
    assert [r.x for r in fit.x.orderBy("j").collect()] == list(fit.solution)
    assert [r.y for r in fit.y.orderBy("j").collect()] == list(fit.target)


@pytest.mark.parametrize("options", [{}, {"blocksize": 2, "schedule": "4,1"}, {"schedule": "s3,1"}])
def test_agrees_with_numpy(spark, options):
    rng = np.random.default_rng(7)
    a, b = rng.standard_normal((500, 6)), rng.standard_normal(500)
    fit = nm.least_squares(labelled(spark, a, b, 6), **options)
    x, residual, *_ = np.linalg.lstsq(a, b, rcond=None)
    assert np.allclose(fit.solution, x)
    assert np.isclose(fit.residual, np.sqrt(residual[0]))


def test_exact_system_has_no_residual(spark):
    a = np.array([[2.0, 1.0], [1.0, 3.0]])
    fit = nm.least_squares(labelled(spark, a, a @ [4.0, -1.0], 2))
    assert np.allclose(fit.solution, [4.0, -1.0])
    assert fit.residual < 1e-12


def test_badly_scaled_columns_are_fine(spark):
    rng = np.random.default_rng(8)
    a = rng.standard_normal((100, 2)) * [1e-12, 1e9]
    fit = nm.least_squares(labelled(spark, a, a @ [1e12, 1e-9]))
    assert np.allclose(fit.solution * [1e-12, 1e9], [1.0, 1.0])


def test_singular_and_short_systems_raise(spark):
    with pytest.raises(ValueError, match="not square"):
        nm.least_squares(labelled(spark, [[1.0, 2.0, 3.0]], [1.0]))
    a = np.random.default_rng(9).standard_normal((50, 2))
    with pytest.raises(ValueError, match="singular"):
        nm.least_squares(labelled(spark, np.column_stack([a, a[:, 0] * 3]), a[:, 1]))


def test_null_label_raises(spark):
    df = spark.createDataFrame([(1.0, [1.0]), (None, [2.0])], "rhs double, row array<double>")
    with pytest.raises(PySparkException):
        nm.least_squares(df)


def test_text_rows(spark):
    lines = spark.createDataFrame([("3 1 0",), ("  ",), ("\t5 0  1 ",)], "value string")
    rows = nm.as_labelled(lines, text="value").collect()
    assert sorted((r.rhs, r.row) for r in rows) == [(3.0, [1.0, 0.0]), (5.0, [0.0, 1.0])]
    short = spark.createDataFrame([("3",)], "value string")
    with pytest.raises(PySparkException, match="two numbers"):
        nm.as_labelled(short, text="value").collect()
