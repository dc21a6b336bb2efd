"""Matrices of so many columns that what a task hands on matters."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

import narrowmat as nm
from helpers import factor, matrix, r_of, rows_of
from narrowmat.operators import factor as factor_module, tiles
from narrowmat.plans import reduce


@pytest.mark.parametrize("n, tile", [(5, 2), (6, 2), (7, 3), (4, 9)])
def test_tiled_gram(spark, monkeypatch, n, tile):
    monkeypatch.setattr(tiles, "STRIP_BYTES", 8 * n * tile * (1 + n % 2))
    a = np.random.default_rng(n).standard_normal((200, n))
    m = nm.validate_matrix(matrix(spark, a, 5), n)
    found = tiles.tiled_gram(m, n, tile)
    assert np.allclose(factor(found), a.T @ a, atol=1e-12)
    assert tiles.tiled_gram(m.limit(0), n, tile).count() == 0


def test_gram_of_many_columns(spark):
    # 5000 columns: a Gram matrix of 200 MB, of which no task holds more than 64 MiB.
    n = 5000
    rows = spark.range(0, 300, 1, 2).select(
        F.transform(F.sequence(F.lit(1), F.lit(n)), lambda j: F.sin(j * 0.37 + F.col("id") * j)).alias("row", metadata={"ncols": n})
    )
    g = nm.gram(rows)
    a = np.array([r.row for r in rows.collect()])
    got = g.select("i", F.slice("row", 1, 3).alias("head"), F.aggregate("row", F.lit(0.0), lambda t, x: t + x).alias("sum")).collect()
    want = a.T @ a
    assert len(got) == n and g.schema["row"].metadata["ncols"] == n
    for r in got:
        assert np.allclose(r.head, want[r.i, :3], atol=1e-9) and abs(r.sum - want[r.i].sum()) < 1e-8


def test_wide_gram_goes_by_tiles(spark, monkeypatch):
    monkeypatch.setattr(factor_module, "TILED_GRAM_COLUMNS", 10)
    a = np.random.default_rng(1).standard_normal((50, 12))
    m = nm.validate_matrix(matrix(spark, a), 12)
    assert np.allclose(factor(nm.gram(m)), a.T @ a)
    assert np.allclose(factor(nm.cholesky_qr(m)), r_of(a))
    with pytest.raises(PySparkException, match="entries"):
        wrong = matrix(spark, a[:, :11]).select(F.col("row").alias("row", metadata={"ncols": 12}))
        nm.gram(wrong).collect()


def test_splits_are_merged_for_wide_matrices_only(spark, tmp_path):
    n = 1200
    rows = spark.range(0, 2400, 1, 40).select(F.array_repeat(F.col("id").cast("double"), n).alias("row"))
    rows.write.parquet(str(tmp_path / "m"))
    read = lambda k: spark.read.parquet(str(tmp_path / "m")).repartition(40).select(F.col("row").alias("row", metadata={"ncols": k}))
    assert reduce.merged_splits(read(4), 4).rdd.getNumPartitions() == 40
    assert reduce.merged_splits(read(n), n).rdd.getNumPartitions() == 8
    stats = nm.tsqr(read(n).select(F.transform("row", lambda x: x + F.rand(1)).alias("row", metadata={"ncols": n})), stats=True).stats
    assert stats.filter("stage = 0").first().tasks == 8


@pytest.mark.parametrize("n, p, tile", [(5, 7, 2), (6, 4, 3), (3, 3, 8), (1, 1, 1)])
def test_blocked_product(spark, monkeypatch, n, p, tile):
    from narrowmat.operators import blocked

    monkeypatch.setattr(blocked, "PACK_ROWS", 7)
    rng = np.random.default_rng(n)
    a, b = rng.standard_normal((60, n)), rng.standard_normal((n, p))
    found = blocked.blocked_product(matrix(spark, a, 4), nm.factor_frame(spark, b).repartition(3), tile)
    assert np.allclose(rows_of(found), a @ b, atol=1e-13)
    text = matrix(spark, a[:5]).select(F.lit("same").alias("key"), "row")
    same = nm.blocked_product(text, nm.factor_frame(spark, b), tile).collect()
    assert len(same) == 5 and {r.key for r in same} == {"same"}
    assert np.allclose(sorted(r.row for r in same), sorted((a[:5] @ b).tolist()))
    assert nm.blocked_product(matrix(spark, a).limit(0), nm.factor_frame(spark, b), tile).count() == 0
    with pytest.raises(ValueError, match="width"):
        nm.blocked_product(matrix(spark, a), nm.factor_frame(spark, np.ones((n + 1, 2))), tile)


def test_project_by_a_factor_collects_nothing(spark, monkeypatch):
    from narrowmat.operators import svd

    def refuse(*_):
        raise AssertionError("asked the driver to take a matrix")

    monkeypatch.setattr(svd, "check_driver_bytes", refuse)
    rng = np.random.default_rng(2)
    a, b = rng.standard_normal((40, 6)), rng.standard_normal((6, 3))
    found = nm.project(matrix(spark, a).select("row"), nm.factor_frame(spark, b))
    assert found.columns == ["row"]
    assert np.allclose(sorted(r.row for r in found.collect()), sorted((a @ b).tolist()))
