"""Direct TSQR: the orthogonal factor itself, whatever the condition of the matrix.

Every task factors blocks of its rows and writes both factors: Q rows packed by
block, and R. The R of many blocks are stacked and factored, level by level, until
one is left; each level keeps the piece of its Q that belongs to each R below. These
pieces, at most columns x columns each, are then multiplied from the top down, joined
by block number, and a last join takes the result to the packed rows. No product
with an inverse occurs, so Q is orthogonal to rounding at any condition number.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from narrowmat.functions.kernels import positive_diagonal, row_block, row_column
from narrowmat.operators.factor import factor_frame
from narrowmat.sources.scratch import shared_path, stored

# Rows of one block: this many bytes, but four times the columns at least, so that
# the R of all blocks are a fourth of the rows at most. A level stacks R of as many
# blocks as these bytes hold.
BLOCK_BYTES = 1 << 22
STACK_BYTES = 1 << 26

# Up to this size the multiplied pieces are broadcast to the packed rows; beyond it
# both sides are shuffled by block.
BROADCAST_BYTES = 1 << 26


def _factored(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    q, r = np.linalg.qr(block)
    sign = np.where(np.diagonal(r) < 0, -1.0, 1.0)
    return q * sign, positive_diagonal(np.triu(r))


def _blocks(batches):
    """Packed Q rows (``kind`` 0) and R (``kind`` 1) of every block of a task."""
    number = TaskContext.get().partitionId() << 32
    held, keys, count, limit = [], [], 0, 0

    def factored(take):
        nonlocal held, keys, count, number
        rows = held[0] if len(held) == 1 else np.concatenate(held)
        key = pa.concat_arrays(keys)
        q, r = _factored(rows[:take])
        number += 1
        held, keys, count = [rows[take:]], [key.slice(take)], count - take
        columns = [
            pa.array([number, number], pa.int64()),
            pa.array([0, 1], pa.int32()),
            pa.ListArray.from_arrays(pa.array([0, take, take], pa.int32()), key.slice(0, take)),
            pa.array([take, len(r)], pa.int32()),
            pa.array([q.tobytes(), r.tobytes()], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["block", "kind", "keys", "count", "cells"])

    for batch in batches:
        rows = row_block(batch.column("row"))
        if not len(rows):
            continue
        if held and rows.shape[1] != held[0].shape[1]:
            raise ValueError(f"matrix rows have {held[0].shape[1]} and {rows.shape[1]} entries")
        limit = max(4 * rows.shape[1], BLOCK_BYTES // (8 * max(rows.shape[1], 1)))
        held.append(rows)
        keys.append(batch.column("key"))
        count += len(rows)
        while count >= 2 * limit:  # so that the last block is never much smaller
            yield factored(limit)
    if count:
        yield factored(count)


def _stacked(table: pa.Table) -> pa.Table:
    """R of one group of blocks, factored: a piece of Q for each block, and the R."""
    table = table.sort_by("block")
    counts = table["count"].to_numpy()
    cells = [np.frombuffer(c.as_py(), dtype=float) for c in table["cells"]]
    n = len(cells[0]) // int(counts[0])
    q, r = _factored(np.concatenate([c.reshape(-1, n) for c in cells]))
    pieces = [p.tobytes() for p in np.split(q, np.cumsum(counts)[:-1])]
    group = table["group"][0].as_py()
    return pa.table(
        {
            "block": pa.array([*table["block"].to_pylist(), group], pa.int64()),
            "kind": pa.array([0] * len(pieces) + [1], pa.int32()),
            "group": pa.array([group] * (len(pieces) + 1), pa.int64()),
            "count": pa.array([*counts.tolist(), len(r)], pa.int32()),
            "cells": pa.array([*pieces, r.tobytes()], pa.binary()),
        }
    )


LEVEL = "block long, kind int, group long, count int, cells binary"


def _times(cells: bytes, count: int, above: bytes, width: int) -> np.ndarray:
    left = np.frombuffer(cells, dtype=float).reshape(count, -1)
    return left @ np.frombuffer(above, dtype=float).reshape(left.shape[1], width)


def _down(width, batches):
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("cells", "count", "above")))
        made = [_times(cells, count, above, width).tobytes() for cells, count, above in rows]
        yield pa.RecordBatch.from_arrays(
            [batch.column("block"), pa.array(made, pa.binary())], names=["block", "above"]
        )


def _rows(width, batches):
    for batch in batches:
        keys, count, cells, above = (batch.column(c) for c in ("keys", "count", "cells", "above"))
        for k in range(batch.num_rows):
            made = _times(cells[k].as_py(), count[k].as_py(), above[k].as_py(), width)
            yield pa.RecordBatch.from_arrays([keys[k].values, row_column(made)], names=["key", "row"])


class DirectQR:
    """The stored tree of one factorisation. ``R`` is its factor (as ``r`` on the
    driver); ``times(x)`` gives, lazily, the rows of ``Q x`` with the keys of the
    matrix. All lies in one folder of ``spark.checkpoint.dir``, at ``path``."""

    def __init__(self, m: DataFrame):
        spark = self.spark = m.sparkSession
        self.path = shared_path(spark, "direct")
        keyed = "key" in m.columns
        m = m.select("key" if keyed else F.lit(None).cast("int").alias("key"), "row")
        self.keyed, self.key = keyed, m.schema["key"]
        schema = T.StructType(
            [
                T.StructField("block", T.LongType()),
                T.StructField("kind", T.IntegerType()),
                T.StructField("keys", T.ArrayType(self.key.dataType)),
                T.StructField("count", T.IntegerType()),
                T.StructField("cells", T.BinaryType()),
            ]
        )
        # Files by kind, so that what needs the R of the blocks does not read rows. Their
        # row groups stay small although each row is a whole block.
        m.mapInArrow(_blocks, schema).write.partitionBy("kind").options(
            **{"parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 8}
        ).parquet(f"{self.path}/blocks")
        read = lambda kind: spark.read.schema(T.StructType([f for f in schema if f.name != "kind"])).parquet(f"{self.path}/blocks/kind={kind}")
        try:
            self.rows, factors = read(0), read(1).select("block", "count", "cells")
            size = factors.agg(F.count("*"), F.max(F.length("cells")), F.max("count"), F.sum("count")).first()
            self.total = size[3] + self.rows.agg(F.sum("count")).first()[0]
        except Exception as error:
            if "PATH_NOT_FOUND" in str(error):
                raise ValueError("the matrix has no rows") from None
            raise
        blocks, largest, count, self.piece_rows = size
        self.n = largest // (8 * count)
        fan = max(2, STACK_BYTES // max(1, largest))
        self.levels = []
        while True:
            groups = -(-blocks // fan)
            # Groups of about ``fan`` blocks, placed by number; the last is group 0.
            group = F.pmod(F.xxhash64("block", F.lit(len(self.levels))), F.lit(groups))
            grouped = factors.withColumn("group", group).groupBy("group").applyInArrow(_stacked, LEVEL)
            level = stored(grouped, f"{self.path}/level{len(self.levels)}")
            self.levels.append(level.filter("kind = 0").select("block", "group", "count", "cells"))
            factors = level.filter("kind = 1").select("block", "count", "cells")
            if groups == 1:
                break
            blocks = groups
        last = factors.first()
        self.r = np.frombuffer(last["cells"], dtype=float).reshape(last["count"], -1).copy()

    @property
    def R(self) -> DataFrame:
        return factor_frame(self.spark, self.r)

    def times(self, x: np.ndarray) -> DataFrame:
        """Rows of ``Q x`` as a matrix, for a small ``x`` with as many rows as R."""
        x = np.ascontiguousarray(x, dtype=float)
        if x.ndim != 2 or len(x) != len(self.r):
            raise ValueError(f"Q has {len(self.r)} columns, the matrix to multiply {len(x)} rows")
        width = x.shape[1]
        above = self.spark.createDataFrame([(0, bytearray(x.tobytes()))], "group long, above binary")
        for level in reversed(self.levels):
            above = level.join(above.withColumnRenamed("block", "group"), "group").mapInArrow(
                partial(_down, width), "block long, above binary"
            )
        # The pieces are the small side of a hash join: packed rows are never sorted.
        small = 8 * width * self.piece_rows <= BROADCAST_BYTES
        packed = self.rows.join(F.broadcast(above) if small else above.hint("shuffle_hash"), "block")
        row = T.StructField("row", T.ArrayType(T.DoubleType()), metadata={"ncols": width})
        out = packed.select("keys", "count", "cells", "above").mapInArrow(partial(_rows, width), T.StructType([self.key, row]))
        return out if self.keyed else out.select("row")


def direct_qr(m: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``Q`` (one row for every row of ``m``, with its ``key``) and ``R``, both from one
    pass over the matrix. Runs jobs that write Q, packed, to ``spark.checkpoint.dir``.

    Q is orthogonal to rounding for any matrix, also where columns depend on each
    other. With fewer rows than columns Q has as many columns as rows.
    """
    found = DirectQR(m)
    return found.times(np.eye(len(found.r))), found.R
