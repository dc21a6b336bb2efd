import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

import narrowmat as nm
from helpers import r_of, TINY, factor, matrix, rows_of


@pytest.mark.parametrize(
    "nrows, ncols, maprows, maxlocal, stages",
    [(4000, 10, 1000, 20, 2), (5000, 50, 500, 100, 1), (64, 1, None, None, 1), (1000, 7, 30, 11, 3)],
)
def test_known_factor(spark, nrows, ncols, maprows, maxlocal, stages):
    m = nm.gen_matrix(spark, nrows, ncols, maprows, seed=4)
    expected = np.triu(np.ones((ncols, ncols)))
    assert np.allclose(factor(nm.tsqr(m)), expected, atol=1e-13)
    mixed = nm.mix_rows(m, maxlocal, stages)
    assert np.allclose(factor(nm.tsqr(mixed)), expected, atol=1e-13)
    assert mixed.count() == m.count() >= nrows
    assert mixed.select("key").distinct().count() == m.count()
    assert nm.check_triu_ones(nm.tsqr(mixed), tol=1e-12).verdict.first().verdict == "CORRECT"


def test_default_tolerance(spark):
    m = nm.gen_matrix(spark, 4000, 10, 1000)
    assert tuple(nm.check_triu_ones(nm.tsqr(m)).verdict.first()) == ("CORRECT", 0)


def test_sizes_are_adjusted(spark):
    assert nm.gen_matrix(spark, 10, 3, maprows=7).count() == 12
    assert nm.gen_matrix(spark, 1, 5).count() == 10
    for bad in ((0, 3), (5, 0), (None, 3), (5, 3, 2)):
        with pytest.raises(ValueError):
            nm.gen_matrix(spark, *bad)


def test_the_seed_decides_not_the_partitions(spark):
    one = rows_of(nm.gen_matrix(spark, 120, 4, seed=1, parts=1))
    many = rows_of(nm.gen_matrix(spark, 120, 4, seed=1, parts=9))
    other = rows_of(nm.gen_matrix(spark, 120, 4, seed=2))
    assert np.array_equal(one, many) and not np.allclose(one, other)


def test_mixing_repeats_itself(spark):
    m = nm.gen_matrix(spark, 300, 3, seed=1)
    first = rows_of(nm.mix_rows(m, 10, 2, parts=4, seed=5))
    again = rows_of(nm.mix_rows(m.repartition(7), 10, 2, parts=4, seed=5))
    assert np.array_equal(first, again)
    assert not np.allclose(first, rows_of(m))


def test_mixing_with_one_hot_key_and_copies(spark):
    rng = np.random.default_rng(6)
    a = rng.standard_normal((3000, 3))
    a[1000:2500] = a[0]
    rows = [(0 if i < 2000 else i, [float(x) for x in r]) for i, r in enumerate(a)]
    m = spark.createDataFrame(rows, "key long, row array<double>").repartition(8)
    mixed = nm.mix_rows(m, 20, 2, seed=1)
    assert mixed.count() == 3000
    assert np.allclose(factor(nm.gram(mixed, schedule=1)), a.T @ a, rtol=1e-12)
    assert mixed.filter("key = 0").count() == 2000


def test_turning_is_orthogonal_and_reaches_every_row():
    from narrowmat.operators.generate import turned_groups

    for size in (1, 2, 5, 63, 64, 65, 200):
        q = turned_groups(np.random.default_rng(size), np.broadcast_to(np.eye(size), (3, size, size)))
        assert np.allclose(q @ q.transpose(0, 2, 1), np.eye(size), atol=1e-12)
        assert (abs(q) > 1e-9).mean() > 0.99
    # Every orthogonal matrix has the same chance: any entry has a mean square of 1/size.
    for width in (2, 6):
        some = np.broadcast_to(np.eye(6)[:, :width], (4000, 6, width))
        q = turned_groups(np.random.default_rng(0), some)
        assert np.allclose((q**2).mean(axis=0), 1 / 6, atol=0.02) and abs(q.mean(axis=0)).max() < 0.04


@pytest.mark.parametrize("maxlocal", [1, 64, 65, 150])
def test_mixing_in_groups_of_any_size_keeps_r(spark, maxlocal):
    a = np.random.default_rng(7).standard_normal((700, 5))
    mixed = nm.mix_rows(matrix(spark, a, 3), maxlocal, 2, seed=4)
    assert np.allclose(factor(nm.tsqr(mixed)), r_of(a), atol=1e-11)


def test_mixing_needs_keys(spark):
    with pytest.raises(ValueError, match="key"):
        nm.mix_rows(matrix(spark, TINY).select("row"))
    for options in ({"stages": 0}, {"maxlocal": 0}):
        with pytest.raises(ValueError):
            nm.mix_rows(matrix(spark, TINY), **options)


def frame(spark, a):
    return nm.factor_frame(spark, np.array(a, dtype=float))


def test_check_accepts_signs_and_finds_errors(spark):
    r = np.triu(np.ones((5, 5)))
    r[2] *= -1
    assert nm.check_triu_ones(frame(spark, r)).verdict.first().verdict == "CORRECT"
    r[0, 4] = 1.5
    r[3, 3] = np.nan
    check = nm.check_triu_ones(frame(spark, r))
    verdict = check.verdict.first()
    assert verdict.verdict == "INCORRECT" and verdict.nerrs >= 2
    assert (0, 4) in {(e.i, e.j) for e in check.errors.collect()}
    assert check.diffs.count() == 15
    many = nm.check_triu_ones(frame(spark, np.zeros((5, 5))))
    assert many.verdict.first().nerrs == 15 and many.errors.count() == 10


def test_check_refuses_other_shapes(spark):
    with pytest.raises(PySparkException, match="square"):
        nm.check_triu_ones(frame(spark, np.ones((2, 3)))).verdict.collect()
    with pytest.raises(PySparkException, match="empty"):
        nm.check_triu_ones(frame(spark, np.ones((2, 2))).filter("i > 5")).verdict.collect()


def test_signs(spark):
    r = np.array([[-1.0, 2.0, 3.0], [0.0, 0.0, 4.0]])
    found = factor(nm.normalize_signs(frame(spark, r)))
    assert np.array_equal(found, [[1.0, -2.0, -3.0], [0.0, 0.0, 4.0]])
    v = spark.createDataFrame(
        [(0, 0, -0.5), (0, 1, 0.25), (1, 0, 0.0), (1, 1, -1.0)], "k int, j int, v double"
    )
    found = {(x.k, x.j): x.v for x in nm.normalize_signs(v).collect()}
    assert found == {(0, 0): 0.5, (0, 1): -0.25, (1, 0): 0.0, (1, 1): -1.0}


def test_comparisons(spark):
    a = frame(spark, [[1, 2], [3, 4]])
    b = frame(spark, [[1, 2.5], [2, 4]])
    gap = {x["index"]: x.absdiff for x in nm.compare_factors(a, b).collect()}
    assert gap == {0: 0.5, 1: 1.0}
    with pytest.raises(PySparkException, match="shape"):
        nm.compare_factors(a, frame(spark, [[1, 2]])).collect()
    x = spark.createDataFrame([(0, 3.0), (1, 4.0)], "j int, x double")
    y = x.withColumn("x", F.col("x") * 0)
    assert nm.relative_difference(x, y).first().reldiff == 1.0
