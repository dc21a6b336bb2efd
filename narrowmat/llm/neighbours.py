"""Nearest neighbours by cosine over a permutation index.

A vector is represented by the order of its nearest pivots. It is posted in the
inverted files of its first ``POSTS`` pivots; a query reads those of its first
``PROBES``. In each file candidates are ranked by the footrule distance between
the orders, the best are compared exactly, and a query's best of all its files
are its neighbours. Long files and many queries at one pivot are cut into blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from narrowmat.llm.common import only, written

PIVOTS = 256
POSTS = 4
PROBES = 64
FOOT = 48
SHARE = 0.3
LEAST = 64
NEAREST = 5
BLOCK = 4096
QUERY_BLOCK = 1024


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _order(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Pivots of each row from nearest to farthest; ties by number."""
    return np.argsort(-(_unit(x) @ pivots.T), axis=1, kind="stable")


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, v`` of the vectors that take part: not null, nothing null or not
    finite in it, not zero, and of the most frequent length."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = only(vectors, "vec_id", "embedding").select("vec_id", v.alias("v"))
    fine = F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    rows = rows.filter(fine).filter((norm > 0) & (norm < float("inf")))
    top = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.filter(F.size("v") == (top.d if top else 0))


def nearest(vectors: DataFrame, every: int = 50, k: int = NEAREST) -> DataFrame:
    """``query_id, rank, vec_id, score``: for every vector whose vec_id is divisible
    by ``every``, its ``k`` nearest others, ties to the smaller vec_id.

    Vectors that are null, zero, or hold nulls or numbers that are not finite
    take no part, nor do those without vec_id or of an odd length. Rows that
    repeat a vec_id with another vector are candidates of their own for other
    queries; exact repetitions count once. Pivots are up to ``PIVOTS`` vectors
    chosen by a hash of their content, one for eight vectors at most: below 520
    vectors every query reads every file, from there on ``PROBES`` of them. Of a
    file with more than ``LEAST`` vectors, those close by footrule are compared.
    """
    spark = vectors.sparkSession
    rows = usable(vectors).filter(F.col("vec_id").isNotNull())
    rows = written(rows, "vectors")
    total = rows.count()
    n_pivots = max(1, min(PIVOTS, total // 8))
    sample = rows.select("v", F.xxhash64("v").alias("h")).orderBy("h").limit(16 * n_pivots).collect()
    chosen = list({r.h: r.v for r in sample}.values())[:n_pivots]
    pivots = spark.sparkContext.broadcast(_unit(np.array(chosen, dtype=np.float64)) if chosen else np.zeros((1, 1)))

    def post(first: int):
        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    near = _order(_matrix(batch.column("v")), pivots.value)[:, :first]
                    flat = pa.array(near.reshape(-1).astype(np.int32))
                    take = pa.array(np.repeat(np.arange(batch.num_rows), near.shape[1]))
                    yield pa.RecordBatch.from_arrays([flat, batch.column("vec_id").take(take), batch.column("v").take(take)], names=["pivot", "vec_id", "v"])

        return run

    shape = "pivot int, vec_id long, v array<double>"
    posts = rows.mapInArrow(post(POSTS), shape)
    asked = rows.filter(F.col("vec_id") % every == 0).mapInArrow(post(PROBES), shape)
    # Blocks per file: the driver sees two counts for each pivot.
    long = {r.pivot: -(-r["count"] // BLOCK) for r in posts.groupBy("pivot").count().collect()}
    many = {r.pivot: -(-r["count"] // QUERY_BLOCK) for r in asked.groupBy("pivot").count().collect()}
    cut = spark.createDataFrame([(p, long[p], many.get(p, 0)) for p in long], "pivot int, blocks int, q_blocks int")
    cut = F.broadcast(cut.filter("q_blocks > 0"))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("vec_id", "v"), F.col(n)).cast("int")
    left = posts.join(cut, "pivot").select("pivot", own("blocks").alias("block"), spread("q_blocks").alias("q_block"), "vec_id", "v")
    right = asked.join(cut, "pivot").select("pivot", spread("blocks").alias("block"), own("q_blocks").alias("q_block"), "vec_id", "v")

    def probe(held: pa.Table, wanted: pa.Table) -> pa.Table:
        out = [[], [], []]
        if held.num_rows and wanted.num_rows:
            ids, order = held.column("vec_id").to_numpy(), np.argsort(held.column("vec_id").to_numpy(), kind="stable")
            x, ids = _matrix(held.column("v"))[order], ids[order]
            q, q_ids = _matrix(wanted.column("v")), wanted.column("vec_id").to_numpy()
            near = _order(x, pivots.value)
            n_p = near.shape[1]
            place = np.empty((n_p, len(x)), dtype=np.int16)
            place[near.T, np.arange(len(x))] = np.arange(n_p, dtype=np.int16)[:, None]
            norm = np.sqrt((x * x).sum(axis=1))
            foot = min(FOOT, n_p)
            first = _order(q, pivots.value)[:, :foot]
            at = np.arange(foot, dtype=np.int16)[:, None]
            most = max(LEAST, int(SHARE * len(x)))
            for j in range(len(q)):
                if most < len(x):
                    far = np.abs(place[first[j]] - at).sum(axis=0, dtype=np.int32)
                    good = np.flatnonzero(far <= np.partition(far, most - 1)[most - 1])
                else:
                    good = np.arange(len(x))
                good = good[ids[good] != q_ids[j]]
                score = (x[good] * q[j]).sum(axis=1) / (norm[good] * np.sqrt((q[j] * q[j]).sum()))
                best = np.lexsort((ids[good], -score))
                best = best[np.sort(np.unique(ids[good][best], return_index=True)[1])[:k]]
                out[0].append(np.full(len(best), q_ids[j]))
                out[1].append(ids[good][best])
                out[2].append(score[best])
        none = [np.zeros(0)]
        kinds = (np.int64, np.int64, np.float64)
        return pa.table({n: pa.array(np.concatenate(part or none).astype(t)) for n, part, t in zip(("query_id", "vec_id", "score"), out, kinds)})

    keys = ["pivot", "block", "q_block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(probe, "query_id long, vec_id long, score double")
    # One vector may come from several files; its score is the same in all.
    single = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return single.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
