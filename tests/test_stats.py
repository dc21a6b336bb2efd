import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

import narrowmat as nm
from narrowmat.catalog.queries import QUERIES
from helpers import TINY, matrix


def words(spark, *texts, sep=" "):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    return {r.word: r["count"] for r in nm.word_count(df, "t", sep).collect()}


def test_column_sums_both_ways(spark):
    m = nm.validate_matrix(matrix(spark, TINY), 4)
    for schedule in (None, (2, 1)):
        sums = nm.col_sums(m, schedule).collect()
        assert {r.j: r.value for r in sums} == {0: 57.0, 1: -2.0, 2: 5.0, 3: -1.0}
    wide = np.random.default_rng(0).standard_normal((100, 50))
    found = nm.col_sums(matrix(spark, wide)).orderBy("j").collect()
    assert np.allclose([r.value for r in found], wide.sum(axis=0))


def test_word_count_pieces(spark):
    assert words(spark, "a b a", "b", "") == {"a": 2, "b": 2}
    # Inner empty pieces count; one closing blank ends the last piece.
    assert words(spark, "a  b ") == {"a": 1, "": 1, "b": 1}
    assert words(spark, " ") == {"": 1}
    assert words(spark, " a") == {"": 1, "a": 1}
    assert words(spark, "a\nb c\t") == {"a\nb": 1, "c\t": 1}
    assert words(spark, "a.b..c", sep=".") == {"a": 1, "b": 1, "": 1, "c": 1}


def test_word_count_with_one_hot_word(spark):
    df = spark.range(0, 30000, 1, 8).select(
        F.concat(F.lit("hot "), F.lit("hot "), (F.col("id") % 977).cast("string")).alias("t")
    )
    found = {r.word: r["count"] for r in nm.word_count(df, "t").collect()}
    assert found["hot"] == 60000
    assert sum(found.values()) == 90000 and len(found) == 978


def test_duplicate_keys(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (2, 1)], "a long, b long")
    assert [tuple(r) for r in nm.duplicate_keys(df, ["a", "b"]).collect()] == [(1, 1, 2)]
    assert [tuple(r) for r in nm.duplicate_keys(df, "a").collect()] == [(1, 3)]


def test_matrix_shape(spark):
    shape = nm.matrix_shape(matrix(spark, TINY)).first()
    assert tuple(shape) == (20, 4, 4, False, False)
    square = nm.matrix_shape(matrix(spark, TINY[:4])).first()
    assert square.square
    ragged = spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "row array<double>")
    assert tuple(nm.matrix_shape(ragged).first()) == (2, 1, 2, True, False)
    assert {tuple(r) for r in nm.row_widths(ragged).collect()} == {(1, 1), (2, 1)}
    empty = nm.matrix_shape(matrix(spark, TINY).filter("key < 0")).first()
    assert tuple(empty) == (0, None, None, False, False)


def test_peek(spark):
    df = spark.createDataFrame([(5, bytes(range(20)))] * 3, "record long, value binary")
    seen = nm.peek(df).collect()
    assert len(seen) == 2
    assert (seen[0].key, seen[0].length, bytes(seen[0].head)) == (5, 20, bytes(range(10)))


def test_profile(spark):
    docs = [
        '{"a": [1, 2.5, {"b": null}], "c": "xyz"}', '{"c": "longer", "d": true}', "[1, [2]]",
        "nope", None, '"text"',
    ]
    df = spark.createDataFrame([(d,) for d in docs], "j string")
    found = {(r.path, r.type): (r["count"], r.min_len, r.max_len) for r in nm.profile_values(df, "j").collect()}
    assert found == {
        ("$", "object"): (2, 2, 2), ("$", "array"): (1, 2, 2), ("$", "string"): (1, 4, 4),
        ("$", "invalid"): (1, None, None), ("$", "null"): (1, None, None),
        ("$.a", "array"): (1, 3, 3), ("$.a[]", "integer"): (1, None, None),
        ("$.a[]", "double"): (1, None, None), ("$.a[]", "object"): (1, 1, 1),
        ("$.a[].b", "null"): (1, None, None), ("$.c", "string"): (2, 3, 6),
        ("$.d", "boolean"): (1, None, None), ("$[]", "integer"): (1, None, None),
        ("$[]", "array"): (1, 1, 1), ("$[][]", "integer"): (1, None, None),
    }
    flat = nm.profile_values(df, "j", max_depth=0).collect()
    assert {r.path for r in flat} == {"$"}
    assert [r["count"] for r in flat if r.type == "unopened"] == [3]
    variants = df.filter("j like '{%'").select(F.parse_json("j").alias("v"))
    assert nm.profile_values(variants, "v", 1).filter("path = '$.c'").first()["count"] == 2


def test_profile_is_whole(spark):
    deep = '{"a":' * 300 + "[]" + "}" * 300
    docs = [(deep,), ('{"a.b": 1, "a": {"b": 2}, "it\'s": 12345678901234567890}',), ("",), ("2.0 ",)]
    df = spark.createDataFrame(docs, "j string")
    found = {(r.path, r.type): r["count"] for r in nm.profile_values(df, "j").collect()}
    assert found["$" + ".a" * 300, "array"] == 1 and found["$['a.b']", "integer"] == 1
    assert found["$.a.b", "integer"] == 1 and found["$['it\\'s']", "double"] == 1 and found["$", "double"] == 1
    some = nm.profile_values(df, "j", max_depth=7).collect()
    assert [(r.path, r["count"]) for r in some if r.type == "unopened"] == [("$" + ".a" * 7, 1)]
    made = spark.sql("SELECT to_variant_object(named_struct('d', DATE'2024-01-02', 'b', X'00', 't', TIMESTAMP'2024-01-02 03:04:05')) AS v")
    assert {(r.path, r.type) for r in nm.profile_values(made, "v").collect()} >= {("$.d", "date"), ("$.b", "binary"), ("$.t", "timestamp")}
    assert nm.profile_values(df.limit(0), "j").count() == 0


def test_wide_sums_counters_and_peek_of_each_task(spark):
    wide = spark.range(3).select(F.array_repeat(F.lit(1.0), 9000).alias("row"))
    assert nm.col_sums(wide).agg(F.sum("value")).first()[0] == 27000
    rows = [(float(k), [1.0, float(k * k)]) for k in range(40)]
    df = spark.createDataFrame(rows, "rhs double, row array<double>").repartition(4)
    for made in (nm.gram(df, stats=True), nm.svd(df, stats=True), nm.pca(df, stats=True), nm.least_squares(df, stats=True)):
        assert made.stats.filter("stage = 0").first()["rows"] == 40
    records = spark.range(0, 20, 1, 4).select(F.col("id").alias("record"), F.lit(b"xyz").alias("value"))
    assert sorted(r.key for r in nm.peek(records, 2, per_task=True).collect()) == [0, 1, 5, 6, 10, 11, 15, 16]


def test_images(spark):
    rng = np.random.default_rng(3)
    side = 4
    pixels = rng.integers(0, 256, (60, 3, side * side), dtype=np.uint8)
    df = spark.createDataFrame(
        [(i, p.tobytes()) for i, p in enumerate(pixels)], "record long, value binary"
    ).repartition(4)
    sums = {r.record: (r.r, r.g, r.b) for r in nm.rgb_sums(df, side).collect()}
    assert sums == {i: tuple(p.sum(axis=1).tolist()) for i, p in enumerate(pixels.astype(int))}
    gray = (0.299 * pixels[:, 0] + 0.587 * pixels[:, 1] + 0.114 * pixels[:, 2]) / 255.0
    found = {r.key: r.row for r in nm.to_gray(df, side).collect()}
    assert np.allclose([found[i] for i in range(60)], gray)
    fit = nm.image_regression(df, side)
    x, residual, *_ = np.linalg.lstsq(gray, pixels[:, 0].astype(int).sum(axis=1), rcond=None)
    assert np.allclose(fit.solution, x) and np.isclose(fit.residual, residual[0] ** 0.5)
    centred = gray - gray.mean(axis=1, keepdims=True)
    components = nm.image_pca(df, side, blocksize=2, schedule="2,1")
    assert np.allclose(components.s, np.linalg.svd(centred, compute_uv=False))
    assert components.rank == side * side - 1
    with pytest.raises(PySparkException, match="must have 3072 bytes"):
        nm.rgb_sums(df).collect()
    with pytest.raises(PySparkException):
        nm.rgb_sums(df.select("record", F.lit(None).cast("binary").alias("value")), side).collect()


def test_rows_of_another_width_raise_on_both_paths(spark):
    two = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    both = nm.as_matrix(two, cols=["a", "b"]).unionAll(
        nm.as_matrix(two, cols=["a", "b", F.lit(3.0)])
    )
    for make in (nm.gram, nm.col_sums):
        for schedule in (None, 1):
            with pytest.raises(Exception, match="entries|width|columns|cells|ragged|rows"):
                make(both, schedule=schedule).collect()


def test_dropping_goes_by_the_usual_width(spark):
    rows = spark.createDataFrame([([1.0],), ([1.0, 2.0],), ([3.0, 4.0],), ([5.0, 6.0],)], "v array<double>")
    assert nm.as_matrix(rows.coalesce(1), row="v", on_bad_rows="drop").count() == 3


def test_image_regression_sees_whole_rows(spark, sf):
    """Against numpy on all 64 entries, through files of fixed-length records."""
    rows = [r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("embedding").collect()]
    level = np.floor(np.abs(np.array(rows, dtype=np.float64) * 1000)) % 256
    planes = level[:, np.arange(75) % 64].reshape(-1, 3, 25)
    gray = np.tensordot([0.299, 0.587, 0.114], planes, (0, 1)) / 255.0
    x, residual, *_ = np.linalg.lstsq(gray, planes[:, 0].sum(axis=1), rcond=None)
    found = sorted(QUERIES["image_regression_rows"](spark, sf).collect())
    assert [r.j for r in found] == list(range(25))
    assert np.allclose([r.x for r in found], x, atol=1e-4)
    assert np.allclose([r.residual for r in found], residual[0] ** 0.5, atol=1e-4)
