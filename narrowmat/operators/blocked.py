"""Rows times a matrix that is too large to send to every task."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from narrowmat.functions.kernels import chunks, row_block, row_column
from narrowmat.sources.scratch import shared_path, stored
from narrowmat.sources.tables import known_width

TILE = 512

# Rows that are packed together: up to this many, and up to these bytes.
PACK_ROWS = 1024
PACK_BYTES = 1 << 26


def _packs(tile, batches):
    """Packs of rows cut into column blocks; the first block of a pack has the keys."""
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        rows, keys = row_block(batch.column("row")), batch.column("key")
        step = max(1, min(PACK_ROWS, PACK_BYTES // (8 * max(1, rows.shape[1]))))
        for at in range(0, len(rows), step):
            some = rows[at : at + step]
            number += 1
            for cb, first in enumerate(range(0, rows.shape[1], tile)):
                own = len(some) if not cb else 0
                cells = np.ascontiguousarray(some[:, first : first + tile])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number], pa.int64()),
                        pa.array([cb], pa.int32()),
                        pa.array([len(some)], pa.int32()),
                        pa.array([rows.shape[1]], pa.int32()),
                        pa.ListArray.from_arrays(pa.array([0, own], pa.int32()), keys.slice(at, own)),
                        pa.array([cells.tobytes()], pa.binary()),
                    ],
                    names=["pack", "cb", "count", "width", "keys", "cells"],
                )


def _tile(table: pa.Table) -> pa.Table:
    table = table.sort_by("i").combine_chunks()
    block = row_block(table.column("piece").chunk(0))
    return pa.table(
        {
            "cb": table["cb"].slice(0, 1), "pb": table["pb"].slice(0, 1),
            "height": pa.array([len(block)], pa.int32()), "tile": pa.array([np.ascontiguousarray(block).tobytes()], pa.binary()),
        }
    )


def _products(batches):
    for batch in batches:
        columns = [batch.column(c) for c in ("count", "cells", "height", "tile")]
        made = []
        for count, cells, height, tile in zip(*columns):
            left = np.frombuffer(cells.as_py(), dtype=float).reshape(count.as_py(), -1)
            right = np.frombuffer(tile.as_py(), dtype=float).reshape(height.as_py(), -1)
            if left.shape[1] != len(right):
                raise ValueError("the matrix to multiply lacks rows")
            made.append((left @ right).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column(c) for c in ("pack", "pb", "count", "keys")] + [pa.array(made, pa.binary())],
            names=["pack", "pb", "count", "keys", "cells"],
        )


def _rows(batches):
    """Adds up the products of a pack, which come in order, and lays them side by side."""
    pack, keys, sums = None, None, {}

    def finished():
        block = np.concatenate([sums[pb].reshape(len(keys), -1) for pb in sorted(sums)], axis=1)
        for start, end in chunks(*block.shape):
            yield pa.RecordBatch.from_arrays([keys.slice(start, end - start), row_column(block[start:end])], names=["key", "row"])

    for batch in batches:
        numbers, blocks, cells, lists = (batch.column(c) for c in ("pack", "pb", "cells", "keys"))
        for k in range(batch.num_rows):
            if numbers[k].as_py() != pack:
                if pack is not None:
                    yield from finished()
                pack, keys, sums = numbers[k].as_py(), None, {}
            pb, own = blocks[k].as_py(), np.frombuffer(cells[k].as_py(), dtype=float)
            sums[pb] = sums[pb] + own if pb in sums else own
            if len(lists[k].values):
                keys = lists[k].values
    if pack is not None:
        yield from finished()


def blocked_product(m: DataFrame, factor: DataFrame, tile: int = TILE) -> DataFrame:
    """Every row of ``m`` times a matrix given as a factor (``i, row``), which stays
    distributed. Rows are packed (written to ``spark.checkpoint.dir``, so that a pack
    means the same to every task) and cut into column blocks, the factor into tiles;
    blocks meet tiles in a join by column block, and their products are added up by
    pack. A task holds one pack of the result at a time. Runs a job for the packs.
    """
    spark = m.sparkSession
    keyed = "key" in m.columns
    m = m.select("key" if keyed else F.lit(None).cast("int").alias("key"), "row")
    key = m.schema["key"]
    kinds = [("pack", T.LongType()), ("cb", T.IntegerType()), ("count", T.IntegerType()), ("width", T.IntegerType()), ("keys", T.ArrayType(key.dataType)), ("cells", T.BinaryType())]
    schema = T.StructType([T.StructField(*k) for k in kinds])
    packs = stored(m.mapInArrow(partial(_packs, tile), schema), shared_path(spark, "packs"))
    height = factor.agg(F.count("*").alias("n"), F.max("i").alias("last")).first()
    odd = packs.filter(F.col("width") != height.n).select("width").first()
    if odd or height.n != (height.last if height.last is not None else -1) + 1:
        raise ValueError(f"rows of width {odd.width if odd else '?'} times a matrix of {height.n} rows")
    starts = F.sequence(F.lit(1), F.size("row"), F.lit(tile))
    pieces = factor.select("i", F.posexplode(F.transform(starts, lambda at: F.slice("row", at, tile))).alias("pb", "piece"))
    pieces = pieces.select(F.floor(F.col("i") / tile).cast("int").alias("cb"), "pb", "i", "piece")
    tiles = pieces.groupBy("cb", "pb").applyInArrow(_tile, "cb int, pb int, height int, tile binary")
    partials = T.StructType([schema["pack"], T.StructField("pb", T.IntegerType()), schema["count"], schema["keys"], schema["cells"]])
    products = packs.join(tiles, "cb").select("pack", "pb", "count", "keys", "cells", "height", "tile").mapInArrow(_products, partials)
    marks = {"ncols": known_width(factor)} if known_width(factor) else None
    row = T.StructField("row", T.ArrayType(T.DoubleType()), metadata=marks)
    out = products.repartition("pack").sortWithinPartitions("pack").mapInArrow(_rows, T.StructType([key, row]))
    return out if keyed else out.select("row")
