import numpy as np
import pytest
from pyspark.errors import PySparkException

import narrowmat as nm
from helpers import TINY, factor, matrix, rows_of

GOLDEN_S = [36.948055555129, 25.836324418896, 23.288362214913, 11.488155490053]
GOLDEN_V = [
    [0.710659966591, -0.638354477568, -0.065864118758, -0.288319077958],
    [0.14676424746, 0.372889169108, 0.676107303638, -0.61829833996],
    [0.656161757261, 0.449839811881, 0.146993941269, 0.587782845263],
    [0.207061381869, 0.501100161822, -0.718980954586, -0.434845488539],
]


def test_golden_values_and_vectors(spark):
    found = nm.svd(matrix(spark, TINY))
    assert np.allclose(found.s, GOLDEN_S, atol=1e-11)
    assert np.allclose(found.v.T, GOLDEN_V, atol=1e-11)
    assert found.rank == 4
    s = {r.k: r.s for r in found.S.collect()}
    v = {(r.k, r.j): r.v for r in found.V.collect()}
    assert all(s[k] == found.s[k] for k in range(4))
    assert all(v[k, j] == found.v[j, k] for k in range(4) for j in range(4))


@pytest.mark.parametrize("refine", [False, True])
def test_left_vectors_keep_keys_and_rebuild_the_matrix(spark, refine):
    rng = np.random.default_rng(1)
    a = rng.standard_normal((300, 6))
    m = matrix(spark, a, 5)
    found = nm.svd(m)
    u = rows_of(nm.svd_left(m, refine=refine, found=found))
    assert np.allclose(u.T @ u, np.eye(6), atol=1e-12)
    assert np.allclose(u @ np.diag(found.s) @ found.v.T, a, atol=1e-12)


def test_refining_restores_orthogonality(spark):
    rng = np.random.default_rng(2)
    q = np.linalg.qr(rng.standard_normal((400, 5)))[0]
    a = q @ np.diag([1.0, 1e-3, 1e-6, 1e-9, 1e-11]) @ np.linalg.qr(rng.standard_normal((5, 5)))[0]
    m = matrix(spark, a, 4)
    gap = lambda u: abs(u.T @ u - np.eye(5)).max()
    plain = gap(rows_of(nm.svd_left(m, method="project")))
    refined = gap(rows_of(nm.svd_left(m, refine=True)))
    assert plain > 1e-9
    assert refined < 1e-13


@pytest.mark.parametrize("refine", [False, True])
def test_left_vectors_beyond_the_rank_are_zero(spark, refine):
    rng = np.random.default_rng(3)
    a = rng.standard_normal((200, 3)) @ rng.standard_normal((3, 5))
    m = matrix(spark, a, 4)
    found = nm.svd(m, rcond=1e-12)
    assert found.rank == 3
    u = rows_of(nm.svd_left(m, refine=refine, found=found))
    assert np.allclose(u[:, :3].T @ u[:, :3], np.eye(3), atol=1e-12)
    assert np.array_equal(u[:, 3:], np.zeros((200, 2)))


def test_fewer_rows_than_columns(spark):
    a = np.random.default_rng(4).standard_normal((3, 5))
    found = nm.svd(matrix(spark, a, 2))
    assert np.allclose(found.s, np.linalg.svd(a, compute_uv=False))
    assert found.v.shape == (5, 3)
    u = rows_of(nm.svd_left(matrix(spark, a, 2), found=found))
    assert np.allclose(u @ np.diag(found.s) @ found.v.T, a)


def test_project_chains_and_checks_widths(spark):
    a, b = np.arange(8.0).reshape(4, 2), np.arange(6.0).reshape(2, 3)
    m = matrix(spark, TINY)
    assert np.allclose(rows_of(nm.project(m, [a, b])), TINY @ a @ b)
    assert np.allclose(rows_of(nm.project(m, a.tolist())), TINY @ a)
    with pytest.raises(PySparkException, match="width 4"):
        nm.project(m, b).collect()
    with pytest.raises(ValueError, match="width 4"):
        nm.project(nm.validate_matrix(m, 4), b)


def test_variance_share_and_top_components(spark):
    found = nm.svd(matrix(spark, TINY))
    share = [r.share for r in nm.variance_share(found.S).orderBy("k").collect()]
    assert np.allclose(share, np.cumsum(found.s) / found.s.sum())
    squared = [r.share for r in nm.variance_share(found.S, power=2).orderBy("k").collect()]
    assert np.allclose(squared, np.cumsum(found.s**2) / (found.s**2).sum())
    assert {r.k for r in nm.top_components(found.V, 2).collect()} == {0, 1}


def test_golden_row_centred_pca(spark):
    m = matrix(spark, TINY)
    found = nm.pca(m)
    assert np.allclose(found.s[:3], [36.725894022055, 25.620152955343, 12.372003508956])
    assert found.rank == 3
    centred = TINY - TINY.mean(axis=1, keepdims=True)
    assert np.allclose(rows_of(nm.center_rows(m)), centred, atol=1e-14)
    assert np.allclose(factor(found.R).T @ factor(found.R), centred.T @ centred)
    assert np.allclose(nm.pca(m, center=None).s, GOLDEN_S)
    with pytest.raises(ValueError):
        nm.pca(m, center="column")
