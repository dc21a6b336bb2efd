"""One query per operation: ``(spark, folder) -> DataFrame``.

Results are in long form (``i, j, value``), rounded, and without negative
zeros, so that they can be compared with SQL.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

import narrowmat as nm
from narrowmat.functions import cells
from narrowmat.operators.svd import SVD
from narrowmat.plans.reduce import matrix_rows

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base.rstrip('/')}/narrowmat-{name}-{uuid.uuid4().hex}"


def rounded(value: Column | str, digits: int) -> Column:
    return F.round(value, digits) + F.lit(0.0)


def long_form(factor: DataFrame, digits: int) -> DataFrame:
    entries = factor.select("i", F.posexplode("row").alias("j", "value"))
    return entries.select("i", "j", rounded("value", digits).alias("value"))


def long_rows(m: DataFrame, digits: int, key: str) -> DataFrame:
    entries = m.select(F.col("key").alias(key), F.posexplode("row").alias("j", "value"))
    return entries.select(key, "j", rounded("value", digits).alias("value"))


def lineitem(spark, folder, key: str | None = None) -> DataFrame:
    """Intercept, quantity, price in thousands, discount in percent."""
    return nm.as_matrix(
        table(spark, folder, "lineitem"),
        cols=[
            F.lit(1.0),
            "l_quantity",
            F.col("l_extendedprice") / 1000,
            F.col("l_discount") * 100,
        ],
        key=key,
    )


def other_columns(spark, folder) -> DataFrame:
    return nm.as_matrix(
        table(spark, folder, "lineitem"),
        cols=["l_quantity", F.col("l_tax") * 100, F.col("l_extendedprice") / 500, F.lit(2.0)],
    )


def two_columns(spark, folder) -> DataFrame:
    return nm.as_matrix(
        table(spark, folder, "lineitem"),
        cols=["l_quantity", F.col("l_extendedprice") / 1000],
    )


def embeddings(spark, folder) -> DataFrame:
    return nm.as_matrix(
        table(spark, folder, "embeddings"), row="embedding", key="vec_id", n=64
    )


def events(spark, folder) -> DataFrame:
    return nm.as_matrix(
        table(spark, folder, "events"), cols=["value", "user_id"], key="event_id"
    )


def ragged(spark, folder) -> DataFrame:
    """Rows of two cells, of one cell, and with a null cell."""
    number = F.col("l_linenumber")
    return table(spark, folder, "lineitem").select(
        F.when(number <= 3, F.array("l_quantity", "l_tax"))
        .when(number <= 5, F.array("l_quantity"))
        .otherwise(F.array(F.col("l_quantity"), F.lit(None)))
        .alias("row")
    )


def part_text(spark, folder) -> DataFrame:
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("key"),
        F.concat(
            F.lit(" "), F.col("p_partkey"), F.lit("   "), F.col("p_size"),
            F.lit("\t"), F.col("p_retailprice"), F.lit(" "),
        ).alias("line"),
    )


def image_records(spark, folder, side: int, spread: bool) -> DataFrame:
    """Embeddings turned into images. A byte comes from the entry at its place
    (over and over, for images larger than 64 bytes)."""
    count = 3 * side * side
    level = lambda p: F.floor(
        F.abs(F.element_at("embedding", (p % 64 + 1).cast("int")).cast("double") * 1000)
    )
    shade = lambda p: (level(p) + p * 13 + F.col("vec_id") * 7) if spread else level(p)
    pixels = F.transform(
        F.sequence(F.lit(0), F.lit(count - 1)),
        lambda p: F.lpad(F.hex((shade(p) % 256).cast("long")), 2, "0"),
    )
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("record"), F.unhex(F.array_join(pixels, "")).alias("value")
    )


def vsquared(found: SVD) -> DataFrame:
    """``V S² Vᵀ``, which has no signs left to choose."""
    scaled = nm.factor_frame(found.R.sparkSession, (found.v * found.s).T)
    return nm.gram(scaled.select("row"))


# R factors and Gram matrices


@query
def tsqr_lineitem(spark, folder):
    return long_form(nm.tsqr(lineitem(spark, folder)), 4)


@query
def tsqr_scheduled(spark, folder):
    m = lineitem(spark, folder)
    return long_form(nm.tsqr(m, blocksize=3, schedule=("s8", 8, 1)), 4)


@query
def tsqr_block_rows(spark, folder):
    m = lineitem(spark, folder)
    return long_form(nm.tsqr(m, block_rows=1000, schedule="4,2,1"), 4)


@query
def tsqr_embeddings(spark, folder):
    r = nm.tsqr(embeddings(spark, folder))
    return long_form(nm.gram(r.select("row")), 6)


@query
def tsqr_rows(spark, folder):
    stats = nm.tsqr(lineitem(spark, folder), stats=True).stats
    return stats.filter("stage = 0").select("stage", "rows")


@query
def tsqr_random_keys(spark, folder):
    keyed = nm.with_random_keys(nm.tsqr(lineitem(spark, folder)), seed=7)
    return keyed.select(
        "i", F.posexplode("row").alias("j", "value"), F.col("key").between(0, 4_000_000_000).alias("fits")
    ).select("i", "j", rounded("value", 4).alias("value"), "fits")


@query
def tsqr_first_keys(spark, folder):
    m = lineitem(spark, folder, key="l_orderkey")
    keyed = nm.with_first_keys(nm.tsqr(m.select("row")), first_key=m)
    return keyed.select(
        F.col("key.first").alias("first"), F.col("key.i").alias("i"),
        F.posexplode("row").alias("j", "value"),
    ).select("first", "i", "j", rounded("value", 4).alias("value"))


@query
def gram_lineitem(spark, folder):
    return long_form(nm.gram(lineitem(spark, folder)), 3)


@query
def gram_scheduled(spark, folder):
    return long_form(nm.gram(lineitem(spark, folder), schedule=(4, 1)), 3)


@query
def gram_union(spark, folder):
    """Rows of two tables in one matrix."""
    orders = nm.as_matrix(
        table(spark, folder, "orders"), cols=[F.col("o_custkey") / 1000, F.col("o_totalprice") / 1000]
    )
    return long_form(nm.gram(two_columns(spark, folder).unionAll(orders)), 3)


@query
def gram_embeddings(spark, folder):
    return long_form(nm.gram(embeddings(spark, folder)), 6)


@query
def cholesky_qr(spark, folder):
    return long_form(nm.cholesky_qr(lineitem(spark, folder)), 4)


@query
def user_kernel(spark, folder):
    class ColumnMax(nm.Kernel):
        def start(self):
            self.top = np.full(self.width, -np.inf)

        def absorb(self, block):
            self.check(block)
            self.top = np.maximum(self.top, block.max(axis=0))

        def combine(self, index, block):
            self.absorb(block)

        def result(self):
            return np.zeros(1, dtype=int), self.top.reshape(1, -1)

    return long_form(nm.block_reduce(lineitem(spark, folder), ColumnMax), 6)


@query
def user_features(spark, folder):
    def squares(batch):
        rows = matrix_rows(batch)
        return np.column_stack([rows[:, 1], rows[:, 1] ** 2 / 100])

    r = nm.tsqr(lineitem(spark, folder), features=squares)
    return long_form(r, 4)


# Singular values and vectors


@query
def svd_values(spark, folder):
    S = nm.svd(two_columns(spark, folder)).S
    return S.select("k", rounded("s", 5).alias("s"))


@query
def svd_right_vectors(spark, folder):
    V = nm.svd(two_columns(spark, folder)).V
    return V.select("k", "j", rounded("v", 8).alias("v"))


@query
def top_components(spark, folder):
    V = nm.top_components(nm.svd(two_columns(spark, folder)).V, 1)
    return V.select("k", "j", rounded("v", 8).alias("v"))


@query
def variance_share(spark, folder):
    share = nm.variance_share(nm.svd(two_columns(spark, folder)).S)
    return share.select("k", rounded("s", 5).alias("s"), rounded("share", 9).alias("share"))


@query
def variance_share_squared(spark, folder):
    share = nm.variance_share(nm.svd(two_columns(spark, folder)).S, power=2)
    return share.select("k", rounded("s", 5).alias("s"), rounded("share", 9).alias("share"))


@query
def numerical_rank(spark, folder):
    m = nm.as_matrix(
        table(spark, folder, "lineitem"),
        cols=["l_quantity", "l_tax", F.col("l_quantity") * 2, F.lit(0.0)],
    )
    return spark.createDataFrame([(nm.svd(m).rank,)], "rank int")


@query
def dependent_columns(spark, folder):
    """Every column as a sum of those that do not depend on others."""
    cols = ["l_quantity", "l_tax", 3 * F.col("l_quantity") - 2 * F.col("l_tax"), F.lit(0.0)]
    cols += [F.col("l_extendedprice") / 1000, F.col("l_extendedprice") / 500 + F.col("l_quantity")]
    found = nm.column_basis(nm.as_matrix(table(spark, folder, "lineitem"), cols=cols))
    own = found.columns.filter("independent").select("j", F.col("j").alias("k"), F.lit(1.0).alias("coefficient"))
    # Basis columns that take no part have coefficients down to rounding.
    sums = own.unionAll(found.relations).select("j", "k", rounded("coefficient", 8).alias("coefficient"))
    return sums.filter("coefficient <> 0")


def _own_products(m: DataFrame) -> DataFrame:
    return long_form(nm.gram(m), 11)


@query
def svd_left_gram(spark, folder):
    """U'U where one column is a multiple of another."""
    cols = ["l_quantity", "l_tax", F.col("l_quantity") * 3]
    return _own_products(nm.svd_left(nm.as_matrix(table(spark, folder, "lineitem"), cols=cols)))


@query
def direct_qr_gram(spark, folder):
    """Q'Q where two columns differ in their last two digits only."""
    cols = ["l_quantity", F.col("l_quantity") + F.col("l_tax") * 1e-12, "l_discount"]
    q, _ = nm.direct_qr(nm.as_matrix(table(spark, folder, "lineitem"), cols=cols, key="l_orderkey"))
    return _own_products(q)


def _leverage(u: DataFrame) -> DataFrame:
    norm = F.aggregate("row", F.lit(0.0), lambda total, x: total + x * x)
    return u.select(F.col("key").alias("event_id"), rounded(norm, 10).alias("leverage"))


@query
def svd_left_leverage(spark, folder):
    return _leverage(nm.svd_left(events(spark, folder)))


@query
def svd_left_refined(spark, folder):
    return _leverage(nm.svd_left(events(spark, folder), refine=True))


@query
def svd_reconstruct(spark, folder):
    m = embeddings(spark, folder)
    found = nm.svd(m)
    u = nm.svd_left(m, found=found)
    return long_rows(nm.project(u, (found.v * found.s).T), 5, "vec_id")


@query
def project(spark, folder):
    matrix = [[1.0, 0.5, -1.0], [0.25, 2.0, 0.0]]
    return long_rows(nm.project(events(spark, folder), matrix), 6, "event_id")


@query
def project_blocked(spark, folder):
    """The same with the matrix as a table, in tiles."""
    matrix = nm.factor_frame(spark, np.array([[1.0, 0.5, -1.0], [0.25, 2.0, 0.0]]))
    return long_rows(nm.blocked_product(events(spark, folder), matrix, tile=2), 6, "event_id")


# Least squares


@query
def least_squares(spark, folder):
    labelled = nm.as_labelled(
        table(spark, folder, "lineitem"),
        rhs="l_extendedprice",
        cols=[F.lit(1.0), "l_quantity"],
    )
    fit = nm.least_squares(labelled)
    found = fit.x.select(F.concat(F.lit("x"), "j").alias("term"), F.col("x").alias("value"))
    left = spark.createDataFrame([("residual", fit.residual)], "term string, value double")
    return found.unionAll(left).select("term", rounded("value", 4).alias("value"))


@query
def least_squares_wide(spark, folder):
    labelled = nm.as_labelled(
        table(spark, folder, "lineitem"),
        rhs=F.col("l_extendedprice") / 1000,
        cols=[F.lit(1.0), "l_quantity", F.col("l_discount") * 100, F.col("l_partkey") / 100],
    )
    x = nm.least_squares(labelled, blocksize=4, schedule=(4, 1)).x
    return x.select("j", rounded("x", 8).alias("x"))


@query
def least_squares_rows(spark, folder):
    labelled = nm.as_labelled(
        table(spark, folder, "lineitem"), rhs="l_extendedprice", cols=[F.lit(1.0), "l_quantity"]
    )
    stats = nm.least_squares(labelled, stats=True).stats
    return stats.filter("stage = 0").select(
        "stage", "rows", (F.col("compressions") > 0).alias("compressed")
    )


# Row centring and principal components


@query
def center_rows(spark, folder):
    return long_rows(nm.center_rows(embeddings(spark, folder)), 7, "vec_id")


@query
def pca_gram(spark, folder):
    return long_form(vsquared(nm.pca(embeddings(spark, folder))), 6)


@query
def pca_rank(spark, folder):
    # Rows of two entries lie on one line once they are centred.
    found = nm.pca(two_columns(spark, folder))
    return spark.createDataFrame([(found.rank, float(found.s[0]))], "rank int, s double").select(
        "rank", rounded("s", 5).alias("s")
    )


# Sums, counts, shapes


@query
def col_sums(spark, folder):
    sums = nm.col_sums(lineitem(spark, folder))
    return sums.select("j", rounded("value", 3).alias("value"))


@query
def col_sums_embeddings(spark, folder):
    sums = nm.col_sums(embeddings(spark, folder))
    return sums.select("j", rounded("value", 6).alias("value"))


@query
def word_count(spark, folder):
    return nm.word_count(table(spark, folder, "documents"), "text")


@query
def word_count_conversations(spark, folder):
    return nm.word_count(table(spark, folder, "conversations"), "text")


@query
def duplicate_keys(spark, folder):
    rows = table(spark, folder, "lineitem")
    return nm.duplicate_keys(rows, ["l_orderkey", "l_linenumber"])


@query
def matrix_shape(spark, folder):
    return nm.matrix_shape(lineitem(spark, folder))


@query
def matrix_shape_ragged(spark, folder):
    return nm.matrix_shape(ragged(spark, folder))


@query
def row_widths(spark, folder):
    return nm.row_widths(ragged(spark, folder))


@query
def replicate(spark, folder):
    return long_form(nm.gram(nm.replicate(lineitem(spark, folder), 3)), 3)


@query
def profile_values(spark, folder):
    return nm.profile_values(table(spark, folder, "events"), "props")


@query
def profile_nested(spark, folder):
    rows = table(spark, folder, "part").select(
        F.format_string(
            '{"id": %d, "name": "%s", "dims": [%d, "x"], "info": {"brand": "%s", "none": null}}',
            "p_partkey", "p_name", "p_size", "p_brand",
        ).alias("json")
    )
    return nm.profile_values(rows, "json")


@query
def profile_deep(spark, folder):
    """Values nine levels down, names with dots, and rows without a value."""
    inner = F.concat(F.lit('{"a.b": "'), "p_brand", F.lit('", "ab": '), F.col("p_size").cast("string"), F.lit("}"))
    deep = F.concat(F.lit('{"l":' * 8), inner, F.lit("}" * 8))
    rows = table(spark, folder, "part").select(F.when(F.col("p_size") > 5, deep).alias("json"))
    return nm.profile_values(rows, "json")


# Rows in other forms


@query
def text_rows(spark, folder):
    lines = part_text(spark, folder)
    return long_rows(nm.as_matrix(lines, row="line", key="key"), 6, "p_partkey")


@query
def labelled_rows(spark, folder):
    labelled = nm.as_labelled(part_text(spark, folder), text="line")
    return labelled.select(
        F.col("key").alias("p_partkey"), "rhs",
        F.col("row")[0].alias("x0"), F.col("row")[1].alias("x1"),
    )


@query
def packed_rows(spark, folder):
    packed = nm.pack_rows(embeddings(spark, folder))
    m = nm.as_matrix(packed, row="value", key="key", packed=True, n=64)
    return long_rows(m, 9, "vec_id")


@query
def drop_bad_rows(spark, folder):
    m = nm.as_matrix(ragged(spark, folder), row="row", n=2, on_bad_rows="drop")
    return long_form(nm.gram(m), 4)


# Files


@query
def text_lines(spark, folder):
    m = nm.as_matrix(
        table(spark, folder, "orders"), cols=["o_totalprice", F.col("o_totalprice") / 7]
    )
    return nm.format_rows(m).select(F.col("value").alias("line"))


@query
def text_roundtrip(spark, folder):
    path = scratch(spark, "text")
    columns = ["o_orderkey", "o_custkey", "o_totalprice", F.col("o_totalprice") / 7]
    nm.write_text_matrix(nm.as_matrix(table(spark, folder, "orders"), cols=columns), path)
    row = F.col("row")
    return nm.read_text_matrix(spark, path, n=4).select(
        row[0].alias("o_orderkey"), row[1].alias("o_custkey"),
        row[2].alias("o_totalprice"), row[3].alias("seventh"),
    )


@query
def labelled_roundtrip(spark, folder):
    path = scratch(spark, "labelled")
    labelled = nm.as_labelled(
        table(spark, folder, "part"), rhs="p_retailprice", cols=["p_partkey", "p_size"]
    )
    nm.write_labelled(labelled, path)
    back = nm.as_labelled(spark.read.text(path), text="value")
    row = F.col("row")
    return back.select("rhs", row[0].alias("p_partkey"), row[1].alias("p_size"))


@query
def factor_files(spark, folder):
    base = scratch(spark, "pca")
    nm.write_factors(nm.pca(embeddings(spark, folder)), base)
    r = nm.read_text_matrix(spark, f"{base}.tmat", n=64)
    # One component per line, and one value per line: V S² Vᵀ has no signs left.
    s = [row[0] for row, in nm.read_text_matrix(spark, f"{base}-S.tmat", n=1).collect()]
    v = np.array([row for row, in nm.read_text_matrix(spark, f"{base}-V.tmat", n=64).collect()])
    scaled = nm.factor_frame(spark, v * np.array(s)[:, None]).select("row")
    from_r = long_form(nm.gram(r), 6).withColumn("source", F.lit("R"))
    return from_r.unionAll(long_form(nm.gram(scaled), 6).withColumn("source", F.lit("V, S")))


@query
def regression_files(spark, folder):
    base = scratch(spark, "regression")
    labelled = nm.as_labelled(
        table(spark, folder, "lineitem"), rhs=F.col("l_extendedprice") / 1000,
        cols=[F.lit(1.0), "l_quantity"],
    )
    nm.write_factors(nm.least_squares(labelled), base)
    lines = []
    for name, n in (("R", 2), ("y", 1), ("sol", 1)):
        rows = nm.read_text_matrix(spark, f"{base}-{name}.tmat", n=n).collect()
        lines += [(name, i, j, x) for i, (row,) in enumerate(rows) for j, x in enumerate(row)]
    found = spark.createDataFrame(lines, "name string, i int, j int, value double")
    return found.select("name", "i", "j", rounded("value", 6).alias("value"))


@query
def saved_factor(spark, folder):
    mat = scratch(spark, "save") + ".mat"
    path = nm.save(nm.tsqr(lineitem(spark, folder)), mat=mat)
    return long_form(spark.read.parquet(path), 4)


def _fixed_file(spark, folder) -> tuple[str, int]:
    """Embeddings as binary files of fixed-length records: eight bytes of the number,
    then the packed row."""
    path, length = scratch(spark, "fixed"), 8 + 8 * 64
    packed = nm.pack_rows(embeddings(spark, folder))
    number = F.unhex(F.lpad(F.hex("key"), 16, "0"))
    nm.write_fixed(packed.select(F.concat(number, "value").alias("value")), path, length)
    return path, length


def _records(spark, path, length, **options) -> DataFrame:
    """The ``key`` and ``value`` that were written."""
    records = nm.read_fixed(spark, path, length, key_start=0, key_end=7, **options)
    body = cells.byte_range(F.col("value"), 8, length - 1)
    return records.select(cells.offset_value(F.col("key")).alias("key"), body.alias("value"))


def _fixed_rows(path, length, spark, **options) -> DataFrame:
    packed = _records(spark, path, length, **options)
    return long_rows(nm.as_matrix(packed, row="value", key="key", n=64), 9, "vec_id")


@query
def fixed_records(spark, folder):
    return _fixed_rows(*_fixed_file(spark, folder), spark=spark)


@query
def fixed_records_hadoop(spark, folder):
    path, length = _fixed_file(spark, folder)
    return _fixed_rows(path, length, spark=spark, engine="hadoop")


@query
def fixed_records_pattern(spark, folder):
    """Files found by a pattern, in ranges of fifty records."""
    path, length = _fixed_file(spark, folder)
    return _fixed_rows(f"{path}/part-*.bin", length, spark=spark, split_bytes=50 * length)


@query
def record_numbers(spark, folder):
    path, length = _fixed_file(spark, folder)
    records = nm.read_fixed(spark, path, length, key_start=0, key_end=7)
    offset = F.col("offset")
    stored = F.unhex(F.lpad(F.hex(offset), 16, "0"))
    return records.agg(
        F.count("*").alias("nrows"),
        F.count_if(cells.is_record_start(offset, length)).alias("aligned"),
        F.count_if(F.col("record") * length == offset).alias("numbered"),
        F.count_if(cells.offset_value(stored) == offset).alias("decoded"),
        F.count_distinct("key").alias("keys"),
    )


@query
def peek(spark, folder):
    records = image_records(spark, folder, 4, spread=True).orderBy("record")
    return nm.peek(records, 2).select("key", "length", F.hex("head").alias("head"))


# Images


def stored_images(spark, folder, side: int) -> DataFrame:
    """Images of at least 64 bytes, written to files of fixed-length records and
    read back."""
    path, length = scratch(spark, "images"), 8 + 3 * side * side
    images = image_records(spark, folder, side, spread=False)
    number = F.unhex(F.lpad(F.hex("record"), 16, "0"))
    nm.write_fixed(images.select(F.concat(number, "value").alias("value")), path, length)
    return _records(spark, path, length).select(F.col("key").alias("record"), "value")


@query
def rgb_sums(spark, folder):
    return nm.rgb_sums(image_records(spark, folder, 32, spread=True))


@query
def gray(spark, folder):
    return long_rows(nm.to_gray(image_records(spark, folder, 8, spread=True), 8), 9, "record")


@query
def image_regression_rows(spark, folder):
    """Images of 5 x 5, so that every entry of a row counts."""
    fit = nm.image_regression(stored_images(spark, folder, 5), side=5)
    return fit.x.select("j", rounded("x", 5).alias("x"), rounded(F.lit(fit.residual), 5).alias("residual"))


@query
def image_pca(spark, folder):
    found = nm.image_pca(stored_images(spark, folder, 5), side=5)
    return long_form(vsquared(found), 6)


# Generated matrices and checks; sizes follow the tables


@query
def gen_matrix_r(spark, folder):
    rows = lineitem(spark, folder)
    made = nm.mix_rows(nm.gen_matrix(spark, rows.count(), 4), maxlocal=20)
    return long_form(nm.tsqr(made.select("row").unionAll(rows)), 4)


@query
def check_matrix(spark, folder):
    """Lineitem turned into a matrix with the R of ones, and as it is."""
    m = lineitem(spark, folder)
    r = nm.tsqr(m)
    turn = np.linalg.solve(nm.collect_factor(r), np.triu(np.ones((4, 4))))
    good = nm.check_triu_ones(nm.tsqr(nm.project(m, turn)), tol=1e-9)
    own = nm.check_triu_ones(r, tol=0.5)
    name = lambda x, of: x.verdict.withColumn("matrix", F.lit(of))
    return name(good, "turned").unionAll(name(own, "own"))


@query
def mix_rows(spark, folder):
    mixed = nm.mix_rows(events(spark, folder), maxlocal=50, stages=2, seed=3)
    return long_form(nm.tsqr(mixed), 4)


@query
def normalize_signs(spark, folder):
    r = nm.tsqr(lineitem(spark, folder))
    flip = F.when(F.col("i") % 2 == 1, F.transform("row", lambda x: -x)).otherwise(F.col("row"))
    return long_form(nm.normalize_signs(r.select("i", flip.alias("row"))), 4)


@query
def compare_factors(spark, folder):
    both = nm.compare_factors(
        nm.tsqr(lineitem(spark, folder)), nm.cholesky_qr(other_columns(spark, folder))
    )
    return both.select("index", rounded("absdiff", 3).alias("absdiff"))


@query
def compare_vectors(spark, folder):
    other = nm.as_matrix(
        table(spark, folder, "lineitem"), cols=["l_quantity", F.col("l_tax") * 100]
    )
    gap = nm.compare_factors(nm.svd(two_columns(spark, folder)).V, nm.svd(other, blocksize=2).V)
    return gap.select("index", rounded("absdiff", 8).alias("absdiff"))


@query
def relative_difference(spark, folder):
    rows = table(spark, folder, "lineitem")
    cols = [F.lit(1.0), "l_quantity"]
    z = nm.least_squares(nm.as_labelled(rows, rhs="l_extendedprice", cols=cols)).x
    y = nm.least_squares(
        nm.as_labelled(rows, rhs=F.col("l_extendedprice") * (1 - F.col("l_discount")), cols=cols)
    ).x
    return nm.relative_difference(z, y).select(rounded("reldiff", 9).alias("reldiff"))
