"""Matrices whose R is known, at any size."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from narrowmat.functions.kernels import row_block, row_column

PART_BYTES = 1 << 27
BATCH_BYTES = 1 << 24


# Rows that are turned together at once; larger groups take two rounds.
TURNED_ROWS = 64


def turn(rng: np.random.Generator, groups: np.ndarray) -> np.ndarray:
    """``groups`` (groups x rows x width), each multiplied by a random orthogonal
    matrix, as a product of reflections applied to the rows themselves: the first
    draws its direction among all rows, each later one among one row less, and signs
    are random, which gives every orthogonal matrix the same chance. The work for a
    row grows with the rows of its group, not with their square."""
    count, size, width = groups.shape
    if size <= 2 * width:  # wide rows: one factorisation costs less than many reflections
        q = np.linalg.qr(rng.standard_normal((count, size, size)))[0]
        return q * rng.choice([-1.0, 1.0], (count, 1, size)) @ groups
    out = groups.copy()
    for k in range(size - 1):
        normal = rng.standard_normal((count, 1, size - k))
        # The reflection that takes a random direction to the first axis.
        length = np.linalg.norm(normal, axis=2)
        normal[:, :, 0] += np.where(normal[:, :, 0] < 0, -length, length)
        normal *= np.sqrt(2) / np.linalg.norm(normal, axis=2, keepdims=True)
        out[:, k:] -= normal.transpose(0, 2, 1) @ (normal @ out[:, k:])
    return out * rng.choice([-1.0, 1.0], (count, size, 1))


def turned_groups(rng: np.random.Generator, groups: np.ndarray) -> np.ndarray:
    """Every group turned as a whole: up to ``TURNED_ROWS`` rows by any orthogonal
    matrix, more of them by two rounds of turned parts with a shuffle between, so that
    every row still gets something of all."""
    count, size, width = groups.shape
    if size <= TURNED_ROWS:
        return turn(rng, groups)
    parts = -(-size // TURNED_ROWS)
    edges = np.linspace(0, size, parts + 1).astype(int)
    for _ in range(2):
        groups = groups[:, rng.permutation(size)]
        groups = np.concatenate([turn(rng, groups[:, a:b]) for a, b in zip(edges, edges[1:])], axis=1)
    return groups


def _generate(n, maprows, scale, seed, batches):
    upper = np.triu(np.ones((n, n))) * scale
    step = max(1, BATCH_BYTES // (8 * n * n))
    drawn, keys, held = [], [], 0

    def rows():
        made = (np.linalg.qr(np.concatenate(drawn))[0] @ upper).reshape(-1, n)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(keys)), row_column(made)], names=["key", "row"]
        )

    for batch in batches:
        for number in batch.column("id").to_pylist():
            # Seeded by block number, so a task that runs again repeats itself.
            rng = np.random.default_rng((seed, number))
            key = number * maprows
            for done in range(0, maprows // n, step):
                count = min(step, maprows // n - done)
                drawn.append(rng.standard_normal((count, n, n)))
                keys.append(np.arange(key, key + count * n, dtype=np.int64))
                key += count * n
                held += count
                if held >= step:
                    yield rows()
                    drawn, keys, held = [], [], 0
    if held:
        yield rows()


def gen_matrix(
    spark: SparkSession,
    nrows: int,
    ncols: int,
    maprows: int | None = None,
    seed: int = 0,
    parts: int | None = None,
) -> DataFrame:
    """A random matrix with R = the upper triangle of ones.

    It is made of blocks ``Q R`` with random orthogonal Q, scaled so that the
    whole has that R. ``maprows`` (2 x columns by default) is cut to a multiple
    of the columns, ``nrows`` raised to a multiple of ``maprows``. Keys are the
    row numbers. The same seed gives the same matrix in any partitioning.
    """
    if not nrows or not ncols or nrows < 1 or ncols < 1:
        raise ValueError("nrows and ncols must be 1 or more")
    maprows = 2 * ncols if maprows is None else maprows
    maprows -= maprows % ncols
    if maprows < ncols:
        raise ValueError("maprows must be ncols or more")
    groups = -(-nrows // maprows)
    nrows = groups * maprows
    if parts is None:
        by_size = -(-nrows * ncols * 8 // PART_BYTES)
        parts = max(by_size, spark.sparkContext.defaultParallelism)
    scale = 1.0 / np.sqrt(nrows / ncols)
    schema = T.StructType(
        [
            T.StructField("key", T.LongType()),
            T.StructField(
                "row", T.ArrayType(T.DoubleType()), metadata={"ncols": ncols}
            ),
        ]
    )
    ids = spark.range(0, groups, 1, min(parts, groups))
    return ids.mapInArrow(partial(_generate, ncols, maprows, scale, seed), schema)


def _mix(maxlocal, seed, stage, batches):
    part = TaskContext.get().partitionId()
    rng = np.random.default_rng((seed, stage, part))
    keys, rows, held = [], [], 0

    def turned(size, whole):
        """Held rows in groups of ``size``, as many as are ``whole``; keeps the rest."""
        nonlocal keys, rows, held
        key, block = pa.concat_arrays(keys), np.concatenate(rows)
        width = block.shape[1]
        step = max(1, BATCH_BYTES // (8 * size * width))
        for first in range(0, whole, step):
            count = min(step, whole - first)
            start, end = first * size, (first + count) * size
            groups = block[start:end].reshape(count, size, width)
            made = turned_groups(rng, groups).reshape(-1, width)
            yield pa.RecordBatch.from_arrays(
                [key.slice(start, end - start), row_column(made)], names=["key", "row"]
            )
        done = whole * size
        keys, rows, held = [key.slice(done)], [block[done:]], held - done

    size = maxlocal
    for batch in batches:
        block = row_block(batch.column("row"))
        if not len(block):
            continue
        size = size or block.shape[1]
        keys.append(batch.column("key"))
        rows.append(block)
        held += len(block)
        if held >= size and held * 8 * block.shape[1] >= BATCH_BYTES:
            yield from turned(size, held // size)
    if held:
        yield from turned(size, held // size)
    if held:
        yield from turned(held, 1)


def mix_rows(
    m: DataFrame,
    maxlocal: int | None = None,
    stages: int = 1,
    parts: int | None = None,
    seed: int = 0,
) -> DataFrame:
    """Shuffle rows and multiply groups of ``maxlocal`` of them (as many as
    columns by default) by random orthogonal matrices, ``stages`` times.

    R stays what it was. Rows are placed and ordered by what they hold, so a
    task that runs again forms the same groups: mixed rows of two different runs
    would not have the R of the whole.
    """
    if "key" not in m.columns:
        raise ValueError("mix_rows needs a key column")
    if stages < 1:
        raise ValueError("stages must be 1 or more")
    if maxlocal is not None and maxlocal < 1:
        raise ValueError("maxlocal must be 1 or more")
    m = m.select("key", "row")
    for stage in range(stages):
        place = F.xxhash64("key", "row", F.lit(seed), F.lit(stage)).alias("_place")
        # A rebalancing exchange: adaptive execution splits a partition that
        # many copies of one row have made too large.
        spread = m.select("*", place).hint(
            "rebalance", *([parts] if parts else []), F.col("_place")
        )
        ordered = spread.sortWithinPartitions("_place", "key", "row").drop("_place")
        m = ordered.mapInArrow(partial(_mix, maxlocal, seed, stage), m.schema)
    return m
