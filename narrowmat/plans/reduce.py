"""``block_reduce``: one kernel over all rows, combined over a schedule of stages.

Stage 0 is ``mapInArrow`` over the partitions as they are, so raw rows never
cross the network; what does is one small result per task. Every later stage is
an exchange of those results followed by the same kernel. All results of one
task travel to the same place (they are placed by the number of the task they
came from): should a lost executor's task run again and round differently, no
reducer can see rows of both runs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from narrowmat.functions.kernels import Kernel, chunks, row_block, row_column
from narrowmat.plans.schedule import AdaptiveMerge, Merge, Spread, parse_schedule
from narrowmat.sources.tables import known_width
from narrowmat.sources.text import split_bytes_for

PARTIAL = "src int, i int, row array<double>"

Features = Callable[[pa.RecordBatch], np.ndarray]


def matrix_rows(batch: pa.RecordBatch) -> np.ndarray:
    """The default features: the ``row`` column as it is."""
    return row_block(batch.column("row"))


def _result_batches(index, block) -> Iterator[pa.RecordBatch]:
    src = TaskContext.get().partitionId()
    for start, end in chunks(*block.shape):
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(end - start, src, dtype=np.int32)),
                pa.array(index[start:end].astype(np.int32)),
                row_column(block[start:end]),
            ],
            names=["src", "i", "row"],
        )


def _counter_batches(seen: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    # Counters travel beside the results as rows numbered -1 - stage.
    if seen:
        stages = sorted(seen)
        yield from _result_batches(
            np.array([-1 - s for s in stages]), np.array([seen[s] for s in stages])
        )


def _partial(make: Callable[[], Kernel], features: Features, counters: bool):
    def run(batches):
        kernel = make()
        for batch in batches:
            if batch.num_rows:
                kernel.absorb(features(batch))
        if kernel.width is not None:
            yield from _result_batches(*kernel.result())
        if counters:
            yield from _counter_batches(
                {0: np.array([1.0, kernel.rows, kernel.compressions, kernel.seconds])}
            )

    return run


def _merge(make: Callable[[], Kernel], stage: int, counters: bool):
    def run(batches):
        kernel = make()
        seen: dict[int, np.ndarray] = {}
        for batch in batches:
            index = batch.column("i").to_numpy()
            if counters and (index < 0).any():
                side = batch.filter(pa.array(index < 0))
                for i, row in zip(
                    side.column("i").to_pylist(), row_block(side.column("row"))
                ):
                    seen[-1 - i] = seen.get(-1 - i, 0.0) + row
                batch = batch.filter(pa.array(index >= 0))
                index = batch.column("i").to_numpy()
            if batch.num_rows:
                kernel.combine(index, row_block(batch.column("row")))
        if kernel.width is not None:
            yield from _result_batches(*kernel.result())
            seen[stage] = np.array(
                [1.0, kernel.rows, kernel.compressions, kernel.seconds]
            )
        if counters:
            yield from _counter_batches(seen)

    return run


def merged_splits(m: DataFrame, n: int | None) -> DataFrame:
    """``m`` in fewer and larger partitions, if it has so many columns that what tasks
    hand on would be a fair share of what they read. Splits are merged without a shuffle,
    down to one for each core at least; narrow matrices stay as they are."""
    spark = m.sparkSession
    if not n or split_bytes_for(n) <= split_bytes_for(1):
        return m
    size = int(str(m._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = max(-(-size // split_bytes_for(n)), spark.sparkContext.defaultParallelism)
    return m.coalesce(parts) if parts < 1 << 31 else m


def _exchange(partial: DataFrame, stage: Spread | Merge | AdaptiveMerge) -> DataFrame:
    src = F.col("src")
    if isinstance(stage, AdaptiveMerge):
        return partial.repartition(src % stage.groups if stage.groups else src)
    parts = stage.parts if isinstance(stage, Spread) else stage.tasks
    if parts == 1:
        # Not coalesce(1), which would run the stage before in one task.
        return partial.repartition(1)
    return partial.repartitionById(parts, src % parts)


def block_reduce(
    m: DataFrame,
    kernel: Callable[[], Kernel],
    schedule=None,
    features: Features | None = None,
    counters: bool = False,
) -> DataFrame:
    """Reduce all rows of ``m`` to the result of one kernel, as ``i, row``.

    ``kernel`` makes a fresh :class:`Kernel` for every task. ``features`` turns
    an Arrow batch of ``m`` into a numpy block inside the first stage, so that
    derived features never leave the worker. With ``counters`` the result also
    has, for every stage ``s``, a row ``i = -1 - s`` holding tasks, rows,
    compressions and kernel seconds.
    """
    partitions = int(m.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    plan = parse_schedule(schedule, partitions)
    if features is None:
        m, features = m.select("row"), matrix_rows
        m = m if plan.spread else merged_splits(m, known_width(m))
    for spread in plan.spread:
        m = m.repartition(spread.parts)
    out = m.mapInArrow(_partial(kernel, features, counters), PARTIAL)
    for number, stage in enumerate(plan.stages, start=1):
        out = _exchange(out, stage)
        if not isinstance(stage, Spread):
            out = out.mapInArrow(_merge(kernel, number, counters), PARTIAL)
    return out.select("i", "row")
