"""Numpy helpers for the inside of a task: Arrow batches to blocks and back,
and the block kernels that :func:`narrowmat.plans.reduce.block_reduce` drives.
"""

from __future__ import annotations

import time

import numpy as np
import pyarrow as pa

# QR runs best on blocks that stay in cache; a block never has fewer rows.
MIN_BLOCK_ROWS = 4000


def binary_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A binary column as where its values begin (and the last ends), from 0,
    and all their bytes, without a copy."""
    if column.type != pa.binary():
        column = column.cast(pa.binary())
    if not len(column):
        return np.zeros(1, dtype=np.int32), np.empty(0, dtype=np.uint8)
    _, offsets, data = column.buffers()
    edges = np.frombuffer(offsets, dtype=np.int32)
    edges = edges[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(data, dtype=np.uint8) if data else np.empty(0, dtype=np.uint8)
    return edges - edges[0], body[edges[0] : edges[-1]]


def row_block(column: pa.Array) -> np.ndarray:
    """An ``array<double>`` column as a rows x width block, without a copy."""
    if len(column) == 0:
        return np.empty((0, 0))
    if column.null_count:
        raise ValueError("matrix row is null")
    sizes = np.diff(column.offsets.to_numpy())
    width = int(sizes[0])
    if np.any(sizes != width):
        odd = int(sizes[np.argmax(sizes != width)])
        raise ValueError(f"matrix rows have {width} and {odd} entries")
    cells = column.flatten()
    if cells.null_count:
        raise ValueError("null cell in a matrix row")
    return cells.to_numpy(zero_copy_only=False).reshape(len(sizes), width)


def row_column(block: np.ndarray) -> pa.Array:
    """A rows x width block as an ``array<double>`` column."""
    rows, width = block.shape
    offsets = np.arange(0, rows * width + 1, width, dtype=np.int32) if width else (
        np.zeros(rows + 1, dtype=np.int32)
    )
    return pa.ListArray.from_arrays(
        pa.array(offsets), pa.array(np.ascontiguousarray(block).ravel())
    )


def chunks(rows: int, width: int, bytes_per_chunk: int = 1 << 26):
    """Row ranges that keep one Arrow batch near 64 MiB."""
    step = max(1, bytes_per_chunk // (8 * max(width, 1)))
    for start in range(0, rows, step):
        yield start, min(rows, start + step)


def positive_diagonal(r: np.ndarray) -> np.ndarray:
    """Rows scaled by -1 where the diagonal is negative."""
    flip = np.diagonal(r) < 0
    r[: len(flip)][flip] *= -1.0
    return r + 0.0


class Kernel:
    """What one task does to its rows.

    ``absorb`` takes raw matrix rows, ``combine`` takes rows (with their row
    numbers) that other tasks returned, ``result`` gives the row numbers and
    rows to hand on. The same object serves as the partial and the final side.
    """

    def __init__(self):
        self.width = None
        self.rows = 0
        self.compressions = 0
        self.seconds = 0.0

    def check(self, block: np.ndarray) -> None:
        if self.width is None:
            self.width = block.shape[1]
            self.start()
        elif block.shape[1] != self.width:
            raise ValueError(
                f"matrix rows have {self.width} and {block.shape[1]} entries"
            )

    def start(self) -> None:
        """Called once the width is known."""

    def absorb(self, block: np.ndarray) -> None:
        raise NotImplementedError

    def combine(self, index: np.ndarray, block: np.ndarray) -> None:
        raise NotImplementedError

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        raise NotImplementedError


class QRBlocks(Kernel):
    """Keeps the R factor of the rows seen so far."""

    def __init__(self, blocksize: int | None = None, block_rows: int | None = None):
        super().__init__()
        self.blocksize = blocksize
        self.block_rows = block_rows

    def start(self):
        if self.block_rows is not None:
            limit = max(self.block_rows, self.width)
        elif self.blocksize is not None:
            limit = self.blocksize * self.width
        else:
            limit = max(2 * self.width, MIN_BLOCK_ROWS)
        self.held = np.empty((limit + 1, self.width))
        self.count = 0

    def absorb(self, block):
        self.check(block)
        self.rows += len(block)
        # Several blocks at hand are compressed side by side in one call, which
        # matters for small ones.
        size = len(self.held)
        while len(block) >= 2 * size:
            began = time.perf_counter()
            whole = len(block) // size * size
            groups = block[:whole].reshape(-1, size, self.width)
            rs = np.linalg.qr(groups, mode="r")
            self.compressions += len(rs)
            block = np.concatenate([rs.reshape(-1, self.width), block[whole:]])
            self.seconds += time.perf_counter() - began
        done = 0
        while done < len(block):
            take = min(len(self.held) - self.count, len(block) - done)
            self.held[self.count : self.count + take] = block[done : done + take]
            self.count += take
            done += take
            if self.count == len(self.held):
                self.compress()

    def combine(self, index, block):
        self.absorb(block)

    def compress(self):
        began = time.perf_counter()
        r = np.linalg.qr(self.held[: self.count], mode="r")
        self.count = len(r)
        self.held[: self.count] = r
        self.compressions += 1
        self.seconds += time.perf_counter() - began

    def result(self):
        self.compress()
        r = positive_diagonal(np.triu(self.held[: self.count]))
        return np.arange(len(r)), r


class GramSum(Kernel):
    """Adds up the products of rows with themselves."""

    def start(self):
        self.total = np.zeros((self.width, self.width))

    def absorb(self, block):
        self.check(block)
        self.rows += len(block)
        began = time.perf_counter()
        self.total += block.T @ block
        self.seconds += time.perf_counter() - began

    def combine(self, index, block):
        self.check(block)
        self.rows += len(block)
        order = np.argsort(index, kind="stable")
        present, starts = np.unique(index[order], return_index=True)
        self.total[present] += np.add.reduceat(block[order], starts, axis=0)

    def result(self):
        return np.arange(self.width), self.total


class ColumnSum(Kernel):
    """Adds up rows."""

    def start(self):
        self.total = np.zeros(self.width)

    def absorb(self, block):
        self.check(block)
        self.rows += len(block)
        self.total += block.sum(axis=0)

    def combine(self, index, block):
        self.absorb(block)

    def result(self):
        return np.zeros(1, dtype=np.int64), self.total.reshape(1, -1)


def centred_block(block: np.ndarray) -> np.ndarray:
    """Every entry less the mean of its own row."""
    return block - block.mean(axis=1, keepdims=True)


def rounding_level(columns: int, rows: float) -> float:
    """Relative size of what rounding leaves where a factor should be zero.

    ``rows`` are all rows that went through any stage of the reduction. Every one of
    them turns each column once, and the roundings of independent turns add up like
    a random walk, so the level grows with the root of both. It does not depend on how
    the rows were split, but for the few partial rows of later stages.
    """
    return np.finfo(float).eps * max(columns, np.sqrt(float(columns) * max(rows, 1)))


def rank_tolerance(s: np.ndarray, columns: int, rows: float) -> float:
    """Singular values up to this size count as zero."""
    return rounding_level(columns, rows) * (s.max() if len(s) else 0.0)


def pivoted_columns(r: np.ndarray, level: float):
    """Columns of R in order, each either taken into an orthonormal basis or, when
    rounding could have made all that is left of it, put last.

    Returns the columns taken, for the others their coefficients, and the share of
    every column that was left. What a column may leave is measured by the lengths
    that cancel in it, so columns of any scale can be told apart.
    """
    count, n = r.shape
    lengths = np.linalg.norm(r, axis=0)
    q = np.empty((count, min(count, n)))
    t = np.zeros((min(count, n), min(count, n)))
    taken, others, share = [], {}, np.zeros(n)
    for j in range(n):
        p = len(taken)
        first = q[:, :p].T @ r[:, j]
        rest = r[:, j] - q[:, :p] @ first
        again = q[:, :p].T @ rest  # once more, so that q stays orthogonal
        rest = rest - q[:, :p] @ again
        left = np.linalg.norm(rest)
        share[j] = left / lengths[j] if lengths[j] else 0.0
        sums = np.linalg.solve(t[:p, :p], first + again) if p else np.empty(0)
        cancelled = lengths[j] + np.abs(sums) @ lengths[taken] if p else lengths[j]
        if p < q.shape[1] and left > level * cancelled:
            q[:, p] = rest / left
            t[:p, p], t[p, p] = first + again, left
            taken.append(j)
        else:
            others[j] = sums
    return taken, others, share
