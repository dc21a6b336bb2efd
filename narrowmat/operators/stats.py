"""Sums, counts and shapes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from narrowmat.functions import cells
from narrowmat.functions.kernels import ColumnSum
from narrowmat.plans.reduce import block_reduce
from narrowmat.sources.tables import known_width

# Up to this width column sums are plain SQL sums; wider, numpy blocks.
SQL_SUM_COLUMNS = 32


def col_sums(m: DataFrame, schedule=None) -> DataFrame:
    """Sum of every column as ``j, value``.

    Compiled SQL sums of narrow matrices whose width the schema tells; otherwise, and
    with a ``schedule``, numpy blocks combined over the schedule.
    """
    n = known_width(m)
    if n and n <= SQL_SUM_COLUMNS and schedule is None:
        at = cells.row_cells(F.col("row"), n)
        total = m.agg(*[F.sum(c).alias(f"s{j}") for j, c in enumerate(at)])
        sums = total.filter(F.col("s0").isNotNull()).select(
            F.array(*[f"s{j}" for j in range(n)]).alias("row")
        )
    else:
        sums = block_reduce(m, ColumnSum, schedule).select("row")
    return sums.select(F.posexplode("row").alias("j", "value"))


def word_count(df: DataFrame, col: str, sep: str = " ") -> DataFrame:
    """How often every piece of text between separators occurs."""
    words = df.select(F.explode(cells.tokens(F.col(col), sep)).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("count"))


def duplicate_keys(df: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """Keys that more than one row has, with their ``count``."""
    names = [keys] if isinstance(keys, str) else list(keys)
    counted = df.groupBy(*names).agg(F.count("*").alias("count"))
    return counted.filter(F.col("count") > 1)


def matrix_shape(m: DataFrame) -> DataFrame:
    """``nrows, ncols_min, ncols_max, ragged, square`` in one row."""
    size = F.size("row")
    return m.agg(
        F.count("*").alias("nrows"),
        F.min(size).alias("ncols_min"),
        F.max(size).alias("ncols_max"),
    ).select(
        "*",
        F.coalesce(F.col("ncols_min") != F.col("ncols_max"), F.lit(False)).alias("ragged"),
        F.coalesce(
            (F.col("nrows") == F.col("ncols_max"))
            & (F.col("ncols_min") == F.col("ncols_max")),
            F.lit(False),
        ).alias("square"),
    )


def row_widths(m: DataFrame) -> DataFrame:
    """How many rows there are of each ``width``: one line unless rows are ragged."""
    return m.groupBy(F.size("row").alias("width")).agg(F.count("*").alias("nrows"))


def _first(k):
    def run(batches):
        left = k
        for batch in batches:
            yield batch.slice(0, left)
            left -= batch.num_rows
            if left <= 0:
                return

    return run


def peek(df: DataFrame, k: int = 2, per_task: bool = False) -> DataFrame:
    """The first ``k`` records (with ``per_task``, of each task): ``key`` (or
    ``record``), length, first ten bytes."""
    key = "key" if "key" in df.columns else "record"
    if per_task:
        df = df.select(key, "value")
        df = df.mapInArrow(_first(k), df.schema)
    else:
        df = df.limit(k)
    return df.select(
        F.col(key).alias("key"),
        F.length("value").alias("length"),
        F.substring("value", 1, 10).alias("head"),
    )
