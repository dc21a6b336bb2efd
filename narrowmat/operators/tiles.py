"""Gram matrices too large for one task, in tiles."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from narrowmat.functions.kernels import row_block, row_column
from narrowmat.plans.reduce import merged_splits

TILE_COLUMNS = 512

# What a task holds of the Gram matrix: a strip of this many bytes, times all columns.
STRIP_BYTES = 1 << 26

# Partial tiles of the same place are added up by this many tasks, then by one.
FIRST_SUMS = 64

TILES = "ti int, tj int, src int, cells binary"


def _strip(n, first, last, tile, batches):
    """Tiles of the rows ``first`` to ``last`` of the Gram matrix, on and right of the
    diagonal, summed over the rows of one task."""
    total, seen = np.zeros((last - first, n - first)), False
    for batch in batches:
        block = row_block(batch.column("row"))
        if not len(block):
            continue
        if block.shape[1] != n:
            raise ValueError(f"matrix rows have {n} and {block.shape[1]} entries")
        seen = True
        total += block[:, first:last].T @ block[:, first:]
    src = TaskContext.get().partitionId()
    for i in range(first, last if seen else first, tile):
        for j in range(i, n, tile):
            cells = total[i - first : i - first + tile, j - first : j - first + tile]
            yield _tile_batch(i // tile, j // tile, src, cells)


def _tile_batch(ti, tj, src, cells):
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array([x], k) for x, k in zip((ti, tj, src, np.ascontiguousarray(cells).tobytes()), kinds)],
        names=["ti", "tj", "src", "cells"],
    )


def _added(batches):
    held: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for ti, tj, cells in zip(*(batch.column(c) for c in ("ti", "tj", "cells"))):
            place, cells = (ti.as_py(), tj.as_py()), np.frombuffer(cells.as_py(), dtype=float)
            held[place] = held[place] + cells if place in held else cells
    src = TaskContext.get().partitionId()
    for (ti, tj), cells in held.items():
        yield _tile_batch(ti, tj, src, cells)


def _pieces(n, tile, batches):
    """Each tile, and its mirror image, as pieces of rows."""
    for batch in batches:
        for ti, tj, cells in zip(*(batch.column(c) for c in ("ti", "tj", "cells"))):
            i, j = ti.as_py() * tile, tj.as_py() * tile
            block = np.frombuffer(cells.as_py(), dtype=float).reshape(min(tile, n - i), -1)
            for row, first, piece in ((i, j, block),) if i == j else ((i, j, block), (j, i, block.T)):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row, row + len(piece), dtype=np.int32)),
                        pa.array(np.full(len(piece), first, dtype=np.int32)),
                        row_column(piece),
                    ],
                    names=["i", "first", "piece"],
                )


def tiled_gram(m: DataFrame, n: int, tile: int = TILE_COLUMNS) -> DataFrame:
    """``AᵀA`` of a matrix of ``n`` columns as a factor, no task holding more than a
    strip of it. The matrix is read once for each strip; partial tiles are keyed by
    tile row and tile column and summed wherever Spark puts them."""
    m = merged_splits(m.select("row"), n)
    high = max(1, STRIP_BYTES // (8 * n * tile)) * tile
    strips = [
        m.mapInArrow(partial(_strip, n, first, min(n, first + high), tile), TILES) for first in range(0, n, high)
    ]
    tiles = strips[0]
    for strip in strips[1:]:
        tiles = tiles.unionAll(strip)
    tiles = tiles.repartition("ti", "tj", F.col("src") % FIRST_SUMS).mapInArrow(_added, TILES)
    tiles = tiles.repartition("ti", "tj").mapInArrow(_added, TILES)
    pieces = tiles.mapInArrow(partial(_pieces, n, tile), "i int, first int, piece array<double>")
    ordered = F.array_sort(F.collect_list(F.struct("first", "piece")))
    rows = pieces.groupBy("i").agg(F.flatten(F.transform(ordered, lambda p: p["piece"])).alias("row"))
    return rows
