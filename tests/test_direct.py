"""Numerical rank, dependent columns and the orthogonal factor."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

import narrowmat as nm
from helpers import factor, matrix, r_of, rows_of
from narrowmat.catalog import queries as q
from narrowmat.operators import direct
from narrowmat.functions.kernels import pivoted_columns


def conditioned(rows, n, condition, seed=0):
    rng = np.random.default_rng(seed)
    left = np.linalg.qr(rng.standard_normal((rows, n)))[0]
    right = np.linalg.qr(rng.standard_normal((n, n)))[0]
    return left * np.logspace(0, -np.log10(condition), n) @ right


@pytest.mark.parametrize("parts", [1, 3, 8, 16, 64])
@pytest.mark.parametrize("size", ["0.001", "0.01", "0.1"])
def test_the_rank_does_not_depend_on_the_layout(spark, parts, size):
    rows = spark.read.parquet(f"/root/testdata/sf{size}/lineitem.parquet").repartition(parts)
    two = nm.as_matrix(rows, cols=["l_quantity", F.col("l_extendedprice") / 1000])
    assert nm.pca(two).rank == 1
    three = nm.as_matrix(rows, cols=["l_quantity", "l_tax", F.col("l_quantity") * 3])
    assert nm.svd(three, blocksize=2 + parts % 3).rank == 2
    assert nm.column_basis(three).basis == [0, 1]


def test_the_rank_keeps_small_directions(spark):
    a = conditioned(5000, 4, 1e10)
    assert nm.svd(matrix(spark, a, 8)).rank == 4
    assert nm.svd(matrix(spark, a, 8), rcond=1e-9).rank == 3


def test_columns_of_any_scale(spark):
    rng = np.random.default_rng(5)
    a = rng.standard_normal((3000, 6)) * [1e12, 1e-12, 1, 1, 1, 1e-3]
    a[:, 2] = a[:, 0] * 1e-12 + a[:, 1] * 1e12
    a[:, 4] = 0
    found = nm.column_basis(matrix(spark, a, 7))
    assert found.basis == [0, 1, 3, 5] and found.rank == 4
    assert np.allclose(found.coefficients[2], [1e-12, 1e12], rtol=1e-9)
    shown = {r.j: r for r in found.columns.collect()}
    assert [shown[j].place for j in range(6)] == [0, 1, None, 2, None, 3]
    assert shown[4].share == 0 and not shown[4].independent
    assert nm.column_basis(matrix(spark, a, 7), rcond=0.5).rank <= 4


def test_pivoted_columns_by_random_dependences():
    for seed in range(60):
        rng = np.random.default_rng(seed)
        n = int(rng.integers(1, 9))
        rank = int(rng.integers(1, n + 1))
        a = rng.standard_normal((int(rng.integers(1, 30)), rank)) @ rng.standard_normal((rank, n))
        taken, others, _ = pivoted_columns(r_of(a), 1e-11)
        assert len(taken) == np.linalg.matrix_rank(a)
        assert all(np.allclose(a[:, taken[: len(c)]] @ c, a[:, j], atol=1e-8) for j, c in others.items())


@pytest.mark.parametrize("block, stack, broadcast", [(1 << 22, 1 << 26, 1 << 26), (2000, 900, 0)])
@pytest.mark.parametrize("condition", [10.0, 1e14])
def test_q_is_orthogonal_at_any_condition(spark, monkeypatch, block, stack, broadcast, condition):
    # Small blocks and stacks make a tree of several levels.
    monkeypatch.setattr(direct, "BLOCK_BYTES", block)
    monkeypatch.setattr(direct, "STACK_BYTES", stack)
    monkeypatch.setattr(direct, "BROADCAST_BYTES", broadcast)
    a = conditioned(1200, 5, condition)
    tree = direct.DirectQR(matrix(spark, a, 6))
    assert len(tree.levels) == 1 if block > 2000 else len(tree.levels) > 2
    u = rows_of(tree.times(np.eye(5)))
    assert abs(u.T @ u - np.eye(5)).max() < 1e-13
    assert np.allclose(u @ tree.r, a, atol=1e-14) and (np.diagonal(tree.r) >= 0).all()
    if condition < 100:
        assert np.allclose(tree.r, r_of(a), atol=1e-13)
    with pytest.raises(ValueError):
        tree.times(np.eye(4))


@pytest.mark.parametrize("method", [None, "direct"])
def test_left_vectors_of_dependent_and_nearly_dependent_columns(spark, method):
    a = conditioned(900, 5, 1e11, seed=3)
    u = rows_of(nm.svd_left(matrix(spark, a, 5), method=method))
    assert abs(u.T @ u - np.eye(5)).max() < 1e-12
    found = nm.svd(matrix(spark, a, 5))
    assert np.allclose(u * found.s @ found.v.T, a, atol=1e-13)
    a[:, 3] = a[:, 0] - 2 * a[:, 1]
    u = rows_of(nm.svd_left(matrix(spark, a, 5), method=method, rcond=1e-12))
    left = np.diag((np.linalg.svd(a, compute_uv=False) > 1e-12).astype(float))
    assert np.allclose(u.T @ u, left, atol=1e-12)


def test_direct_keeps_keys_of_any_type_and_does_without(spark):
    a = np.arange(12.0).reshape(4, 3) ** 2
    text = matrix(spark, a).select(F.struct(F.col("key").cast("string").alias("k")).alias("key"), "row")
    qs, r = nm.direct_qr(text)
    assert qs.schema["key"].dataType == text.schema["key"].dataType
    rows = np.array([x.row for x in sorted(qs.collect(), key=lambda x: x.key.k)])
    assert np.allclose(rows @ factor(r), a)
    plain, _ = nm.direct_qr(matrix(spark, a).select("row"))
    assert plain.columns == ["row"] and plain.count() == 4


def test_direct_with_few_rows_none_and_ragged_ones(spark):
    a = np.random.default_rng(4).standard_normal((3, 5))
    qs, r = nm.direct_qr(matrix(spark, a, 4))
    assert np.allclose(rows_of(qs) @ factor(r), a) and rows_of(qs).shape == (3, 3)
    with pytest.raises(ValueError, match="no rows"):
        nm.direct_qr(matrix(spark, a).limit(0))
    ragged = spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], "key long, row array<double>").coalesce(1)
    with pytest.raises(PySparkException, match="entries"):
        nm.direct_qr(ragged)


def test_no_row_is_shuffled_while_the_pieces_are_small(spark, sf):
    found, _ = nm.direct_qr(q.lineitem(spark, sf, key="l_orderkey"))
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text
    assert "Exchange hashpartitioning(block" not in text


@pytest.mark.parametrize("condition", [1e3, 1e8, 1e10, 1e12])
def test_cholesky_qr_at_high_conditions(spark, condition):
    a = conditioned(4000, 6, condition, seed=1)
    m = matrix(spark, a, 6)
    r, found = factor(nm.tsqr(m)), factor(nm.cholesky_qr(m))
    assert abs(found - r).max() < 1e-10 and (np.diagonal(found) > 0).all()
    # Its rows are as orthogonal as those of the orthogonal factor itself.
    scale = np.linalg.norm(r, axis=0)
    assert np.allclose(found / scale, r / scale, atol=1e-10)
    if condition > 1e8:
        with pytest.raises(ValueError, match="positive definite"):
            nm.cholesky_qr(m, shifted=False)
    centred = factor(nm.cholesky_qr(m, features=lambda batch: np.array(batch["row"].to_pylist())))
    assert abs(centred - r).max() < 1e-10


def test_cholesky_qr_of_dependent_columns_raises(spark, sf):
    rng = np.random.default_rng(3)
    a = rng.standard_normal((3000, 5))
    a[:, 3] = a[:, 1] - 0.5 * a[:, 0]
    with pytest.raises(ValueError, match="column 3"):
        nm.cholesky_qr(matrix(spark, a, 5))
    a[:, 3] = 0
    with pytest.raises(ValueError, match="positive definite"):
        nm.cholesky_qr(matrix(spark, a, 5))
    rows = spark.read.parquet(f"{sf}/lineitem.parquet")
    cols = ["l_quantity", "l_tax", F.col("l_quantity") * 3 + F.col("l_tax")]
    with pytest.raises(ValueError, match="column 2"):
        nm.cholesky_qr(nm.as_matrix(rows, cols=cols))
