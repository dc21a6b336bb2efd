import glob
import gzip
import os

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

import narrowmat as nm
from helpers import TINY, factor, matrix, rows_of


def write(path, text):
    path.write_text(text)
    return str(path)


def read_lines(path):
    return [
        line
        for part in sorted(glob.glob(os.path.join(path, "part-*")))
        for line in open(part).read().splitlines()
    ]


# Text


def test_text_with_blank_lines_and_tabs(spark, tmp_path):
    path = write(tmp_path / "a.tmat", "  1 2.5\t-3e2 \n\n   \n4   5 6\n")
    rows = [r.row for r in nm.read_text_matrix(spark, path).collect()]
    assert rows == [[1.0, 2.5, -300.0], [4.0, 5.0, 6.0]]


def test_text_with_bad_cells(spark, tmp_path):
    path = write(tmp_path / "b.tmat", "1 2\nx 3\n4\n5 6\n")
    with pytest.raises(PySparkException):
        nm.read_text_matrix(spark, path, n=2).collect()
    kept = nm.read_text_matrix(spark, path, n=2, on_bad_rows="drop").collect()
    assert [r.row for r in kept] == [[1.0, 2.0], [5.0, 6.0]]


def test_text_with_no_rows(spark, tmp_path):
    path = write(tmp_path / "c.tmat", "\n\n")
    with pytest.raises(ValueError, match="no rows"):
        nm.read_text_matrix(spark, path)
    assert nm.read_text_matrix(spark, path, n=3).count() == 0


def test_split_bytes_cuts_text(spark, tmp_path):
    path = write(tmp_path / "d.tmat", "1 2\n" * 5000)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        many = nm.read_text_matrix(spark, path, n=2, split_bytes=2000)
        assert many.rdd.getNumPartitions() >= 8
        assert many.count() == 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_written_text_reads_back_bit_for_bit(spark, tmp_path):
    a = np.random.default_rng(0).standard_normal((200, 3)) * 10.0 ** np.arange(-200, 100, 100)
    path = str(tmp_path / "out.tmat")
    nm.write_text_matrix(matrix(spark, a, 4), path)
    assert all(line == "%18.16e %18.16e %18.16e" % tuple(map(float, line.split())) for line in read_lines(path))
    back = np.array([r.row for r in nm.read_text_matrix(spark, path).collect()])
    assert np.array_equal(np.sort(back, axis=0), np.sort(a, axis=0))
    with pytest.raises(PySparkException):
        nm.write_text_matrix(matrix(spark, a), path)
    nm.write_text_matrix(matrix(spark, a), path, overwrite=True)


def test_factors_are_written_in_order(spark, tmp_path):
    path = str(tmp_path / "r.tmat")
    r = nm.tsqr(matrix(spark, TINY))
    nm.write_text_matrix(r, path, ordered=True)
    assert np.array_equal(np.array([l.split() for l in read_lines(path)], float), factor(r))


def test_two_split_sizes_at_once_and_compressed_text(spark, tmp_path):
    path = str(tmp_path / "split.tmat")
    m = matrix(spark, np.arange(20000.0).reshape(-1, 2), 1)
    nm.write_text_matrix(m, path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    many = nm.read_text_matrix(spark, path, n=2, split_bytes=20000)
    one = nm.read_text_matrix(spark, path, n=2, split_bytes=1 << 30)
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before
    assert many.rdd.getNumPartitions() >= 8 > one.rdd.getNumPartitions()
    assert many.unionAll(one).count() == 20000
    packed = str(tmp_path / "packed.tmat")
    nm.write_text_matrix(m, packed, compression="gzip")
    assert list((tmp_path / "packed.tmat").glob("*.gz"))
    assert nm.read_text_matrix(spark, packed).count() == 10000


def test_labelled_rows_round_trip(spark, tmp_path):
    path = str(tmp_path / "lab")
    df = spark.createDataFrame([(1.5, [0.1, 2.0]), (-2.0, [3.0, 4.0])], "rhs double, row array<double>")
    nm.write_labelled(df, path)
    back = nm.as_labelled(spark.read.text(path), text="value").collect()
    assert sorted((r.rhs, r.row) for r in back) == [(-2.0, [3.0, 4.0]), (1.5, [0.1, 2.0])]


def test_factor_bundles(spark, tmp_path):
    base = str(tmp_path / "pca-R")
    found = nm.pca(matrix(spark, TINY))
    paths = nm.write_factors(found, base)
    assert paths == [f"{base}-V.tmat", f"{base}-S.tmat", f"{base}.tmat"]
    v, s, r = (np.array([l.split() for l in read_lines(p)], float) for p in paths)
    assert np.array_equal(v, found.v.T)
    assert np.array_equal(s[:, 0], found.s)
    assert np.array_equal(r, factor(found.R))
    rows = spark.createDataFrame(
        [(float(t[0]), [float(x) for x in t[1:]]) for t in TINY], "rhs double, row array<double>"
    )
    fit = nm.least_squares(rows)
    base = str(tmp_path / "reg")
    paths = nm.write_factors(fit, base)
    assert paths == [f"{base}-R.tmat", f"{base}-y.tmat", f"{base}-sol.tmat"]
    r, y, x = (np.array([l.split() for l in read_lines(p)], float) for p in paths)
    assert np.array_equal(x[:, 0], fit.solution)
    assert np.allclose(r @ x, y)


def test_save_and_default_names(spark, tmp_path):
    assert nm.default_output("d/a.mseq", "tsqr") == "d/a-qrr.mseq"
    assert nm.default_output("d/a.mseq", "cholesky_qr") == "d/a-chol-qrr.mseq"
    assert nm.default_output("a", "svd_left") == "a-svd-U"
    assert nm.default_output("a.m", "gram") == "a-normal.m"
    r = nm.tsqr(matrix(spark, TINY))
    path = nm.save(r, mat=str(tmp_path / "t.parquet"))
    nm.save(r, path)
    assert np.array_equal(factor(spark.read.parquet(path)), factor(r))
    assert any(".zstd." in f for f in os.listdir(path))
    with pytest.raises(PySparkException):
        nm.save(r, path, overwrite=False)
    with pytest.raises(ValueError):
        nm.save(r)


# Matrix views


def test_columns_of_every_numeric_type(spark):
    df = spark.sql(
        "select true b, 1Y t, 2S s, 3 i, 4L l, cast(5.5 as float) f, 6.5D d, 7.25BD c"
    )
    row = nm.as_matrix(df, cols=df.columns).first().row
    assert row == [1.0, 1.0, 2.0, 3.0, 4.0, 5.5, 6.5, 7.25]


def test_null_columns_raise_or_drop(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, None, 3.0)], "id long, a double, b double")
    with pytest.raises(PySparkException, match="null cell"):
        nm.as_matrix(df, cols=["a", "b"]).collect()
    kept = nm.as_matrix(df, cols=["a", "b"], key="id", on_bad_rows="drop").collect()
    assert [(r.key, r.row) for r in kept] == [(1, [1.0, 2.0])]


def test_array_rows_raise_or_drop(spark):
    rows = [([1.0, 2.0],), ([1.0],), ([1.0, None],), (None,), ([3.0, 4.0],)]
    df = spark.createDataFrame(rows, "v array<float>")
    with pytest.raises(PySparkException, match="non-null entries"):
        nm.as_matrix(df, row="v").collect()
    kept = nm.as_matrix(df, row="v", on_bad_rows="drop").collect()
    assert [r.row for r in kept] == [[1.0, 2.0], [3.0, 4.0]]


def test_rows_with_nan_and_null(spark):
    nan = float("nan")
    rows = [(1, [nan, 1.0]), (2, [nan, None]), (3, [None, nan]), (4, [None, None]), (5, [])]
    df = spark.createDataFrame(rows, "key long, v array<double>")
    kept = nm.as_matrix(df, row="v", n=2, on_bad_rows="drop").collect()
    assert [r.key for r in kept] == [1]


def test_text_rows_in_any_job(spark):
    lines = spark.createDataFrame(
        [(" ".join(str(x) for x in row),) for row in TINY] + [("",)], "value string"
    )
    assert np.allclose(factor(nm.gram(nm.as_matrix(lines))), TINY.T @ TINY)


def test_bad_views(spark):
    df = spark.createDataFrame([(1, [1.0])], "id long, row array<double>")
    with pytest.raises(ValueError):
        nm.as_matrix(df, cols=["id"], row="row")
    with pytest.raises(ValueError):
        nm.as_matrix(df, cols=["id"], n=2)
    with pytest.raises(TypeError):
        nm.as_matrix(df, row="id")
    with pytest.raises(ValueError):
        nm.as_matrix(df, on_bad_rows="skip")


def test_width_is_known_without_a_job(spark):
    from narrowmat.sources.tables import width

    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    m = nm.as_matrix(df, cols=["a", "b"]).filter("row[0] < 0")
    assert width(m) == 2


def test_packed_rows(spark):
    m = matrix(spark, TINY, 4)
    packed = nm.pack_rows(m)
    some = packed.filter("key = 3").first()
    assert bytes(some.value) == TINY[3].astype("<f8").tobytes()
    back = nm.as_matrix(packed, row="value", packed=True)
    assert np.array_equal(rows_of(back), TINY)
    ragged = spark.createDataFrame([(1, b"\0" * 16), (2, b""), (3, b"\0" * 8)], "key long, v binary")
    kept = nm.as_matrix(ragged, row="v", n=2, on_bad_rows="drop").collect()
    assert [r.key for r in kept] == [1]
    broken = spark.createDataFrame([(1, b"\0" * 9)], "key long, v binary")
    with pytest.raises(PySparkException, match="whole number of doubles"):
        nm.as_matrix(broken, row="v", n=1).collect()


def test_replicate(spark):
    m = matrix(spark, TINY)
    three = nm.replicate(m, 3)
    assert three.columns == m.columns
    assert np.allclose(factor(nm.gram(three)), 3 * TINY.T @ TINY)
    assert "Exchange" not in nm.replicate(spark.range(3), 2)._jdf.queryExecution().toString()
    with pytest.raises(ValueError):
        nm.replicate(m, 0)


def test_keys(spark):
    keys = [r.key for r in nm.with_random_keys(matrix(spark, TINY), seed=1).collect()]
    assert len(keys) == 20 and all(0 <= k <= 4_000_000_000 for k in keys)
    assert len(set(keys)) > 15
    first = nm.with_first_keys(nm.tsqr(matrix(spark, TINY)), first_key=9).collect()
    assert sorted((r.key.first, r.key.i) for r in first) == [(9, 0), (9, 1), (9, 2), (9, 3)]


# Fixed-length records


def records_file(path, rng, count, length):
    data = rng.integers(0, 256, count * length, dtype=np.uint8).tobytes()
    path.write_bytes(data)
    return data


@pytest.mark.parametrize("case", range(20))
def test_random_record_files(spark, tmp_path, case):
    rng = np.random.default_rng(case)
    count = int(rng.integers(1, 400))
    length = 1 if case == 11 else int(rng.integers(1, 3000))
    # The last case has splits smaller than a record.
    split = max(1, length // 2) if case == 19 else int(rng.integers(1, 4 * length + 1000))
    split = max(split, count * length // 50)
    data = records_file(tmp_path / "r.bin", rng, count, length)
    path = str(tmp_path / "r.bin")
    df = nm.read_fixed(spark, path, length, split_bytes=split)
    rows = sorted(df.collect())
    assert [r.offset for r in rows] == [i * length for i in range(count)]
    assert [r.record for r in rows] == list(range(count))
    assert b"".join(bytes(r.value) for r in rows) == data
    assert nm.duplicate_keys(df, "offset").count() == 0


@pytest.mark.parametrize("case", range(3))
@pytest.mark.parametrize("engine", ["arrow", "hadoop"])
def test_record_keys(spark, tmp_path, case, engine):
    rng = np.random.default_rng(100 + case)
    count, length = int(rng.integers(1, 99)), int(rng.integers(2, 2000))
    start = int(rng.integers(0, length))
    end = int(rng.integers(start, length))
    data = records_file(tmp_path / "k.bin", rng, count, length)
    rows = nm.read_fixed(spark, str(tmp_path / "k.bin"), length, start, end, engine=engine)
    for r in rows.collect():
        at = r.record * length
        assert bytes(r.value) == data[at : at + length]
        assert bytes(r.key) == data[at + start : at + end + 1]


def test_engines_agree_on_a_folder(spark, tmp_path):
    rng = np.random.default_rng(5)
    records_file(tmp_path / "a.bin", rng, 50, 12)
    records_file(tmp_path / "b.bin", rng, 7, 12)
    (tmp_path / "_SUCCESS").write_bytes(b"x")
    pick = lambda engine: sorted(
        (r.offset, bytes(r.value))
        for r in nm.read_fixed(spark, str(tmp_path), 12, split_bytes=120, engine=engine).collect()
    )
    assert len(pick("arrow")) == 57
    assert pick("arrow") == pick("hadoop")
    uri = nm.read_fixed(spark, f"file://{tmp_path}", 12)
    assert uri.count() == 57
    assert nm.read_fixed(spark, f"{tmp_path}/*.bin", 12).count() == 57


@pytest.mark.parametrize("engine", ["arrow", "hadoop"])
def test_truncated_files_raise(spark, tmp_path, engine):
    (tmp_path / "t.bin").write_bytes(b"x" * 25)
    with pytest.raises(Exception, match="(?i)whole number|partial"):
        nm.read_fixed(spark, str(tmp_path / "t.bin"), 10, engine=engine).collect()


def test_refused_readers(spark, tmp_path):
    path = str(tmp_path / "z.bin.gz")
    with gzip.open(path, "wb") as packed:
        packed.write(b"0" * 20)
    with pytest.raises(ValueError, match="compressed"):
        nm.read_fixed(spark, path, 10)
    with pytest.raises(ValueError, match="compressed"):
        nm.read_fixed(spark, str(tmp_path), 10)
    with pytest.raises(ValueError, match="compressed"):
        nm.read_fixed(spark, str(tmp_path), 10, engine="hadoop")
    for bad in ((0,), (-1,), (None,), (10, 3), (10, None, 3), (10, 4, 3), (10, 0, 10), (10, -1, 3)):
        with pytest.raises(ValueError):
            nm.read_fixed(spark, "x", *bad)
    with pytest.raises(ValueError):
        nm.read_fixed(spark, "x", 10, split_bytes=0)
    with pytest.raises(ValueError):
        nm.read_fixed(spark, "x", 10, engine="other")


@pytest.mark.parametrize("engine", ["arrow", "hadoop"])
@pytest.mark.parametrize("pattern", ["", "/*.bin", "/{a,b}*", "/[ab].bin", "/../*/?.bin"])
def test_patterns_and_plans(spark, tmp_path, engine, pattern):
    rng = np.random.default_rng(8)
    folder = tmp_path / "in"
    folder.mkdir()
    one, two = records_file(folder / "a.bin", rng, 31, 10), records_file(folder / "b.bin", rng, 5, 10)
    df = nm.read_fixed(spark, str(folder) + pattern, 10, engine=engine, split_bytes=70)
    found = sorted((r.record, bytes(r.value)) for r in df.collect())
    assert found == sorted((k, data[k * 10 : k * 10 + 10]) for data in (one, two) for k in range(len(data) // 10))
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" not in text and "BatchEvalPython" not in text


def test_ranges_cut_large_files_and_join_small_ones():
    from narrowmat.sources.fixed import plan_ranges

    rng = np.random.default_rng(2)
    for length, split in ((1, 7), (10, 5), (10, 100), (7, 1000)):
        files = [(f"f{k}", int(n) * length) for k, n in enumerate(rng.integers(0, 60, 30))]
        groups = plan_ranges(files, length, split)
        ranges = [x for group in groups for x in group]
        for path, size in files:
            own = sorted((a, b) for p, a, b in ranges if p == path)
            assert [0, *(b for _, b in own)] == [*(a for a, _ in own), size]
        sizes = [sum(b - a for _, a, b in group) for group in groups]
        assert all(0 < s <= max(split, length) and s % length == 0 for s in sizes)
        assert all(x + y > max(split, length) // length * length // 2 for x, y in zip(sizes, sizes[1:]))


def test_an_opener_of_ones_own(spark, tmp_path):
    class Opened:
        def __init__(self, path):
            self.file = open(path.removeprefix("file:"), "rb")

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.file.close()

        def read_at(self, size, at):
            self.file.seek(at)
            return self.file.read(size)

    data = records_file(tmp_path / "a.bin", np.random.default_rng(1), 40, 9)
    rows = nm.read_fixed(spark, str(tmp_path), 9, split_bytes=50, opener=Opened).orderBy("offset").collect()
    assert b"".join(bytes(r.value) for r in rows) == data


def test_large_files_that_only_hadoop_opens_are_refused(spark, tmp_path, monkeypatch):
    from narrowmat.sources import fixed

    records_file(tmp_path / "a.bin", np.random.default_rng(1), 40, 9)
    monkeypatch.setattr(fixed, "WHOLE_BYTES", 100)
    with pytest.raises(ValueError, match="opener"):
        nm.read_fixed(spark, str(tmp_path), 9, engine="hadoop")
    assert nm.read_fixed(spark, str(tmp_path), 9).count() == 40


def test_writing_records_of_any_bytes(spark, tmp_path):
    rng = np.random.default_rng(9)
    values = [rng.bytes(6) for _ in range(400)] + [b"\n" * 6, b"\r\n\x00\x0a\x0d\xff"]
    df = spark.createDataFrame([(v,) for v in values], "value binary").repartition(5)
    path = str(tmp_path / "out")
    nm.write_fixed(df, path, 6)
    read = lambda: sorted(bytes(r.value) for r in nm.read_fixed(spark, path, 6).collect())
    assert read() == sorted(values)
    nm.write_fixed(df.limit(3), path, 6)
    assert len(read()) == 405
    nm.write_fixed(df, path, 6, overwrite=True)
    assert read() == sorted(values)
    for bad in ([(b"12345",)], [(None,)]):
        with pytest.raises(PySparkException, match="6 bytes"):
            nm.write_fixed(spark.createDataFrame(bad, "value binary"), path, 6)
    assert read() == sorted(values) and not any("temporary" in f.name for f in (tmp_path / "out").iterdir())
    nm.write_fixed(df.limit(0), str(tmp_path / "none"), 6)
    with pytest.raises(ValueError, match="binary"):
        nm.write_fixed(spark.createDataFrame([("x",)], "value string"), path, 6)


def test_empty_record_file(spark, tmp_path):
    (tmp_path / "e.bin").write_bytes(b"")
    assert nm.read_fixed(spark, str(tmp_path / "e.bin"), 10).count() == 0


def test_record_numbers_of_byte_keys(spark):
    from narrowmat.functions import cells

    rows = [(n.to_bytes(8, "big"),) for n in (0, 3072, 3073, 9 * 10**15)]
    df = spark.createDataFrame(rows, "k binary").select(cells.offset_value(F.col("k")).alias("at"))
    found = df.select(
        "at",
        cells.record_number(F.col("at"), 3072).alias("n"),
        cells.is_record_start(F.col("at"), 3072).alias("ok"),
    ).collect()
    assert [tuple(r) for r in found] == [
        (0, 0, True), (3072, 1, True), (3073, 1, False),
        (9 * 10**15, 9 * 10**15 // 3072, 9 * 10**15 % 3072 == 0),
    ]
