import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

import narrowmat as nm
from helpers import TINY, factor, matrix, r_of
from narrowmat.functions import cells
from narrowmat.functions.kernels import (
    GramSum, QRBlocks, binary_bytes, centred_block, positive_diagonal,
    row_block, row_column,
)

sizes = st.integers(1, 60)


@settings(max_examples=60, deadline=None)
@given(sizes, st.integers(1, 6), st.integers(2, 5), st.integers(0, 10**6))
def test_r_of_any_cut_into_batches(m, n, blocksize, seed):
    rng = np.random.default_rng(seed)
    a = rng.standard_normal((m, n))
    cuts = np.sort(rng.integers(0, m + 1, 4))
    kernel = QRBlocks(blocksize)
    for block in np.split(a, cuts):
        if len(block):
            kernel.absorb(block)
    index, r = kernel.result()
    assert list(index) == list(range(min(m, n)))
    assert np.allclose(r, r_of(a), atol=1e-12)
    assert kernel.rows == m


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 6), st.integers(1, 5), st.integers(0, 10**6))
def test_gram_parts_add_up_in_any_order(n, parts, seed):
    rng = np.random.default_rng(seed)
    index = np.tile(np.arange(n), parts)
    rows = rng.standard_normal((n * parts, n))
    order = rng.permutation(len(rows))
    kernel = GramSum()
    for piece in np.array_split(order, 3):
        if len(piece):
            kernel.combine(index[piece], rows[piece])
    assert np.allclose(kernel.result()[1], rows.reshape(parts, n, n).sum(axis=0))


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 20), st.integers(1, 7), st.integers(0, 5))
def test_blocks_pass_through_arrow(m, n, skip):
    a = np.random.default_rng(m).standard_normal((m, n))
    column = row_column(a)
    assert column.to_pylist() == a.tolist()
    part = column.slice(min(skip, m))
    assert np.array_equal(row_block(part).reshape(-1, n), a[min(skip, m) :])


def test_bytes_of_slices_and_nothing():
    column = pa.array([b"ab", b"", b"cde", b"f"])
    edges, body = binary_bytes(column.slice(1, 2))
    assert list(edges) == [0, 0, 3] and bytes(body) == b"cde"
    edges, body = binary_bytes(column.slice(0, 0))
    assert list(edges) == [0] and len(body) == 0
    edges, body = binary_bytes(pa.array([b"xy"], pa.large_binary()))
    assert list(edges) == [0, 2] and bytes(body) == b"xy"


def test_small_helpers():
    assert np.array_equal(positive_diagonal(np.array([[-1.0, 0.0], [0.0, 0.0]])), [[1, 0], [0, 0]])
    assert np.allclose(centred_block(TINY).sum(axis=1), 0)


def pieces(text):
    """Pieces as a reader that stops at every blank sees them."""
    found = text.split(" ")
    return found if found[-1] else found[:-1]


def test_pieces_of_random_texts(spark):
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list("ab \n"), rng.integers(0, 9))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    found = df.select("i", cells.tokens(F.col("t")).alias("w")).collect()
    assert all(r.w == pieces(texts[r.i]) for r in found)


def test_numbers_of_random_lines(spark):
    rng = np.random.default_rng(1)
    lines = []
    for _ in range(300):
        words = [repr(float(x)) for x in rng.standard_normal(3) * 10.0 ** rng.integers(-300, 300, 3)]
        blank = lambda: "".join(rng.choice(list(" \t"), rng.integers(1, 4)))
        lines.append(blank() + blank().join(words) + blank())
    df = spark.createDataFrame(list(enumerate(lines)), "key long, t string")
    for r in nm.as_matrix(df, row="t").collect():
        assert r.row == [float(x) for x in lines[r.key].split()]


def test_factor_of_a_saved_factor(spark, tmp_path):
    m = matrix(spark, TINY)
    path = nm.save(nm.tsqr(m), str(tmp_path / "r"))
    again = nm.svd(spark.read.parquet(path))
    assert np.allclose(again.s, nm.svd(m).s) and np.allclose(again.v, nm.svd(m).v)
    assert np.allclose(factor(nm.tsqr(spark.read.parquet(path))), r_of(TINY))


def test_regression_from_saved_factors(spark):
    rows = [(float(t[0]), [float(x) for x in t[1:]]) for t in TINY]
    fit = nm.least_squares(spark.createDataFrame(rows, "rhs double, row array<double>"))
    small = fit.R.join(fit.y, fit.R.i == fit.y.j).select(F.col("y").alias("rhs"), "row")
    assert np.allclose(nm.least_squares(small).solution, fit.solution)
