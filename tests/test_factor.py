import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

import narrowmat as nm
from helpers import TINY, factor, matrix, r_of

GOLDEN_R = [
    [30.708305065568, -13.318872504578, 1.139756815795, -4.656720704535],
    [0, 24.791281435351, 9.244390061621, 6.049615911867],
    [0, 0, 17.442540147280, -12.361587144385],
    [0, 0, 0, 19.232999320715],
]

GOLDEN_GRAM = [
    [943, -409, 35, -143], [-409, 792, 214, 212], [35, 214, 391, -165], [-143, 212, -165, 581],
]


def test_golden_r(spark):
    assert np.allclose(factor(nm.tsqr(matrix(spark, TINY))), GOLDEN_R, atol=1e-11)


def test_golden_gram_both_ways(spark):
    m = nm.validate_matrix(matrix(spark, TINY), 4)
    assert np.array_equal(factor(nm.gram(m)), GOLDEN_GRAM)
    assert np.array_equal(factor(nm.gram(m, schedule=(4, 1))), GOLDEN_GRAM)


def test_golden_cholesky(spark):
    assert np.allclose(factor(nm.cholesky_qr(matrix(spark, TINY))), GOLDEN_R, atol=1e-11)


@pytest.mark.parametrize("seed", range(8))
def test_r_does_not_depend_on_layout(spark, seed):
    rng = np.random.default_rng(seed)
    m, n = int(rng.integers(1, 400)), int(rng.integers(1, 12))
    a = rng.standard_normal((m, n))
    parts = int(rng.integers(1, 9))
    schedules = [None, 1, "3,1", ("s4", 2, 1), (5, "s3", 1), ("auto", 2, 1), "s2,s5,auto,1", "auto,auto2,1"]
    schedule = schedules[seed % len(schedules)]
    options = [{"blocksize": 2}, {"blocksize": 3}, {"block_rows": 7}, {}][seed % 4]
    found = factor(nm.tsqr(matrix(spark, a, parts), schedule=schedule, **options))
    assert found.shape == (min(m, n), n)
    assert np.allclose(found, r_of(a), atol=1e-12 * max(m, n))
    assert np.array_equal(found, np.triu(found))


def test_one_row_and_one_column(spark):
    assert np.allclose(factor(nm.tsqr(matrix(spark, [[-3.0]], 1))), [[3.0]])
    assert np.allclose(factor(nm.tsqr(matrix(spark, [[3.0], [-4.0]], 4))), [[5.0]])
    assert np.allclose(factor(nm.tsqr(matrix(spark, [[-3.0, 1.0]], 1))), [[3.0, -1.0]])


def test_rank_deficient(spark):
    rng = np.random.default_rng(5)
    a = rng.standard_normal((200, 3))
    a = np.column_stack([a, a[:, 0], np.zeros(200)])
    r = factor(nm.tsqr(matrix(spark, a, 5), blocksize=2))
    assert np.allclose(r.T @ r, a.T @ a, atol=1e-11)
    assert (np.diagonal(r) >= 0).all()


def test_no_rows(spark):
    empty = matrix(spark, TINY).filter("key < 0")
    assert nm.tsqr(empty).count() == 0
    assert nm.gram(empty, schedule=1).count() == 0
    with pytest.raises(ValueError, match="no rows"):
        nm.cholesky_qr(nm.validate_matrix(empty, 4))


def test_stats_count_every_row(spark):
    found, stats = nm.tsqr(matrix(spark, TINY, 5), blocksize=2, schedule=(3, 1), stats=True)
    assert np.allclose(factor(found), GOLDEN_R, atol=1e-11)
    rows = {r.stage: r for r in stats.collect()}
    assert set(rows) == {0, 1, 2}
    assert rows[0].rows == 20
    assert rows[2].tasks == 1
    assert all(r.compressions >= r.tasks for r in rows.values())
    assert sum(1 for _ in found.collect()) == 4


def test_small_blocks_compress_more(spark):
    m = matrix(spark, np.random.default_rng(0).standard_normal((900, 3)), 2)
    few = nm.tsqr(m, block_rows=450, stats=True, schedule=1).stats
    many = nm.tsqr(m, blocksize=2, stats=True, schedule=1).stats
    count = lambda stats: stats.filter("stage = 0").first().compressions
    assert count(many) > 10 * count(few)


@pytest.mark.parametrize("schedule", ["2", "1,2", "", "x,1", (0, 1), ("s0", 1), "s,1", "auto", "2,"])
def test_bad_schedules(spark, schedule):
    with pytest.raises(ValueError):
        nm.tsqr(matrix(spark, TINY), schedule=schedule)


def test_bad_block_sizes(spark):
    for options in ({"blocksize": 1}, {"block_rows": 0}):
        with pytest.raises(ValueError):
            nm.tsqr(matrix(spark, TINY), **options)


def test_ragged_and_null_rows_raise(spark):
    for rows in ([[1.0, 2.0], [1.0]], [[1.0, 2.0], [1.0, None]], [[1.0, 2.0], None]):
        df = spark.createDataFrame([(r,) for r in rows], "row array<double>")
        with pytest.raises(PySparkException):
            nm.tsqr(df).collect()
        with pytest.raises(PySparkException):
            nm.gram(df, schedule=1).collect()
        with pytest.raises(PySparkException):
            nm.gram(nm.as_matrix(df, n=2)).collect()
        with pytest.raises(PySparkException):
            nm.gram(df).collect()


def test_partitions_of_different_width_raise(spark):
    one = spark.createDataFrame([([1.0, 2.0],)], "row array<double>")
    two = spark.createDataFrame([([1.0],)], "row array<double>")
    with pytest.raises(PySparkException, match="2 and 1|1 and 2"):
        nm.tsqr(one.unionAll(two)).collect()


def test_cholesky_refuses_dependent_columns(spark):
    rng = np.random.default_rng(1)
    a = rng.standard_normal((100, 4))
    a[:, 3] = a[:, 0] + a[:, 1]
    with pytest.raises(ValueError, match="positive definite"):
        nm.cholesky_qr(matrix(spark, a))
    with pytest.raises(ValueError, match="positive definite"):
        nm.cholesky_qr(matrix(spark, np.zeros((5, 2))))


def test_wide_gram_uses_blocks(spark):
    a = np.random.default_rng(2).standard_normal((300, 40))
    found = factor(nm.gram(matrix(spark, a, 6)))
    assert np.allclose(found, a.T @ a, atol=1e-11)
    assert np.array_equal(found, found.T)


def test_mllib_agrees(spark):
    from pyspark.mllib.linalg.distributed import RowMatrix

    a = np.random.default_rng(3).standard_normal((120, 5))
    rows = spark.sparkContext.parallelize([list(map(float, r)) for r in a], 4)
    theirs = RowMatrix(rows).tallSkinnyQR().R.toArray()
    theirs = theirs * np.where(np.diagonal(theirs) < 0, -1.0, 1.0)[:, None]
    assert np.allclose(factor(nm.tsqr(matrix(spark, a))), theirs, atol=1e-11)


def test_user_kernel_and_features(spark):
    class Largest(nm.Kernel):
        def start(self):
            self.top = np.full(self.width, -np.inf)

        def absorb(self, block):
            self.check(block)
            self.top = np.maximum(self.top, block.max(axis=0))

        def combine(self, index, block):
            self.absorb(block)

        def result(self):
            return np.zeros(1, dtype=int), self.top.reshape(1, -1)

    m = matrix(spark, TINY, 4)
    assert np.array_equal(factor(nm.block_reduce(m, Largest, "2,1"))[0], TINY.max(axis=0))

    def halves(batch):
        return np.array(batch.column("row").to_pylist()) / 2

    assert np.allclose(factor(nm.tsqr(m, features=halves)), r_of(TINY / 2))


def test_all_rows_in_one_partition_of_many(spark):
    a = np.random.default_rng(4).standard_normal((500, 3))
    m = matrix(spark, a, None).repartition(6, F.lit(1))
    assert np.allclose(factor(nm.tsqr(m, blocksize=2, schedule=(4, 1))), r_of(a), atol=1e-12)


def test_two_passes_over_a_source_agree(spark):
    a = np.random.default_rng(6).standard_normal((5000, 4))
    m = matrix(spark, a, 7)
    assert np.allclose(factor(nm.tsqr(m)), factor(nm.tsqr(m.repartition(2))), atol=1e-11)


def test_default_schedule_grows_with_the_session(spark):
    from narrowmat.plans.schedule import AdaptiveMerge, Merge, parse_schedule

    assert parse_schedule(None, 8).stages == (AdaptiveMerge(), Merge(1))
    assert parse_schedule(None, 10000).stages == (AdaptiveMerge(), AdaptiveMerge(100), Merge(1))
    a = np.random.default_rng(7).standard_normal((3000, 3))
    spark.conf.set("spark.sql.shuffle.partitions", "100")
    try:
        found, stats = nm.tsqr(matrix(spark, a, 30), stats=True)
        assert np.allclose(factor(found), r_of(a), atol=1e-11)
        assert [r.stage for r in stats.orderBy("stage").collect()] == [0, 1, 2, 3]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_adaptive_stage_has_few_tasks_for_little_data(spark):
    m = matrix(spark, np.random.default_rng(8).standard_normal((500, 3)), 40)
    tasks = {r.stage: r.tasks for r in nm.tsqr(m, stats=True).stats.collect()}
    assert tasks[0] == 40 and tasks[1] <= 8


def test_factors_of_factors_run_no_job_early(spark):
    from narrowmat.sources.tables import known_width

    m = nm.validate_matrix(matrix(spark, TINY), 4)
    assert known_width(nm.tsqr(m)) == 4
    assert known_width(nm.tsqr(m, features=lambda batch: None)) is None
    seen = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("lazy", "lazy")
    nm.gram(nm.tsqr(matrix(spark, TINY)).select("row"))
    nm.col_sums(nm.center_rows(m))
    assert not list(seen.getJobIdsForGroup("lazy"))
