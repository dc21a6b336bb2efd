"""Mixing sources to target weights by entropy balancing.

Every document gets a rate, the expected number of its copies. Among all rates
between 0 and ``most`` that give each source its target of words, the one of
largest entropy relative to "one copy each" is ``min(most, exp(lambda * size))``
with one multiplier per source: the dual of that convex problem. Newton's method
finds all multipliers at once; each iteration is one aggregation over the
histogram of sizes. Rates are then rounded into whole copies from the largest size
to the smallest, each size making up for the error before it, and the copies of
one size are dealt evenly among its documents.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from narrowmat.llm.common import WORD, guarded, restored, written

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3
SALTS = 256
NEEDED = ("doc_id", "source", "text")
FRESH = ("size", "source_size", "target", "copies", "taken")
STEPS = 60


def n_words(text="text"):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: dict, weights=WEIGHTS, most: float = MOST) -> dict:
    """Words per source: ``weights`` repeat over the sources by code point (null
    last) and share all words; a target stops at ``most`` times its source, and
    the rest is shared anew by weight among the others."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s])
    names += [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    found, free, left = {}, list(names), float(sum(sizes.values()))
    while free:
        total = sum(weight[s] for s in free)
        share = {s: left * weight[s] / total for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return found | share
        for s in over:
            found[s] = float(most * sizes[s])
            left -= found[s]
        free = [s for s in free if s not in over]
    return found


def _multipliers(cells: DataFrame, target: dict, most: float) -> dict:
    """Newton iterations on the dual, all sources at once, kept within brackets.

    ``cells``: source, size, n. Size is measured in means of its source.
    """
    log_most = math.log(most)
    stats = {
        r.source: r
        for r in cells.filter("size > 0").groupBy("source")
        .agg(F.sum(F.col("n") * F.col("size")).alias("words"), F.sum("n").alias("docs"), F.min("size").alias("least"))
        .collect()
    }
    found, low, high, mean = {}, {}, {}, {}
    for s, r in stats.items():
        mean[s] = r.words / r.docs
        least = r.least / mean[s]
        low[s] = min(0.0, math.log(max(target[s], 1e-300) / r.words)) / least
        high[s] = log_most / least
        if target[s] >= most * r.words:
            found[s] = high[s]  # everything at the cap
        elif target[s] <= 0:
            found[s] = low[s]
    now = {s: 0.0 for s in stats if s not in found}
    spark = cells.sparkSession
    for _ in range(STEPS):
        if not now:
            break
        given = spark.createDataFrame(
            [(s, now[s], mean[s]) for s in now], "s string, lam double, mean double"
        )
        x = F.col("size") / F.col("mean")
        raw = F.exp(F.least(F.col("lam") * x, F.lit(log_most)))
        inside = F.when(F.col("lam") * x < log_most, F.col("n") * F.col("size") * x * raw).otherwise(0.0)
        moments = (
            cells.join(F.broadcast(given), F.col("source").eqNullSafe(F.col("s")))
            .groupBy("source").agg(F.sum(F.col("n") * F.col("size") * raw).alias("value"), F.sum(inside).alias("slope"))
        )
        for r in moments.collect():
            s, gap = r.source, r.value - target[r.source]
            if abs(gap) <= 1e-9 * max(1.0, target[s]):
                found[s] = now.pop(s)
                continue
            low[s], high[s] = (now[s], high[s]) if gap < 0 else (low[s], now[s])
            step = now[s] - gap / r.slope if r.slope > 0 else math.inf
            now[s] = step if low[s] < step < high[s] else (low[s] + high[s]) / 2
    found.update(now)
    return {s: (found[s], mean[s]) for s in found}


def _round_cells(most: int):
    """Copies of all documents of one size, from large sizes to small: as many as
    bring the words taken so far nearest to what the rates ask for."""

    def run(cells):
        cells = cells.sort_values("size", ascending=False)
        wanted, taken, copies = 0.0, 0, []
        for size, n, rate in zip(cells["size"].tolist(), cells["n"].tolist(), cells["rate"].tolist()):
            wanted += rate * n * size
            k = min(max(round((wanted - taken) / size), 0), most * n)
            taken += k * size
            copies.append(k)
        return cells.assign(k=copies)[["source", "size", "n", "k"]]

    return run


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST, salts: int = SALTS) -> DataFrame:
    """``docs`` with ``size, source_size, target, copies, taken`` for every row.

    Size: words of the text, 0 for null or empty (such rows get no copies). A
    null source is a source of its own, the last. Rows of one size are dealt copies
    in the order of doc_id, then of their texts. Rows with equal ids, texts
    and sources may get different numbers of copies, but always the same
    numbers together: reruns agree. An empty table gives an empty result.
    The driver sees one row per source and nothing else; columns of ``docs``
    with these names are replaced. Sources are configuration-sized.
    """
    plain = guarded(docs, NEEDED)
    names = {g: c for g, c in zip(plain.columns, docs.columns) if c.lower() not in FRESH}
    docs = plain.select(*names)
    print_of = F.xxhash64("text")
    salt = F.pmod(F.xxhash64("doc_id", "text"), F.lit(salts)).cast("int")
    docs = docs.withColumn("size", n_words())
    small = docs.select("source", "size", salt.alias("__salt"))
    spread = written(small.groupBy("source", "size", "__salt").agg(F.count("*").alias("n")), "sizes")
    cells = written(spread.groupBy("source", "size").agg(F.sum("n").alias("n")), "cells")
    sizes = {r.source: int(r.words) for r in cells.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("words")).collect()}
    goal = targets(sizes, weights, most)
    dual = _multipliers(cells, goal, most)
    spark = docs.sparkSession
    given = spark.createDataFrame(
        [(s, sizes[s], goal.get(s, 0.0), *dual.get(s, (0.0, 1.0))) for s in sizes],
        "s string, source_size long, target double, lam double, mean double",
    )
    rate = F.least(F.lit(float(most)), F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(50.0))))
    rate = F.when(F.col("target") >= most * F.col("source_size"), F.lit(float(most))).otherwise(rate)
    rated = cells.join(F.broadcast(given), F.col("source").eqNullSafe(F.col("s"))).drop("s").filter("size > 0")
    rated = rated.select("source", "size", "n", rate.alias("rate"))
    whole = rated.groupBy("source").applyInPandas(_round_cells(most), "source string, size long, n long, k long")
    within = Window.partitionBy("source", "size").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = spread.withColumn("rank0", F.coalesce(F.sum("n").over(within), F.lit(0))).drop("n")
    same = F.col("o.source").eqNullSafe(F.col("r.source")) & (F.col("o.size") == F.col("r.size"))
    offsets = offsets.alias("o").join(whole.alias("r"), same).select(
        F.col("o.source").alias("c_source"), F.col("o.size").alias("c_size"), F.col("o.__salt").alias("c_salt"), "rank0", "n", "k"
    )
    place = F.row_number().over(Window.partitionBy("source", "size", "__salt").orderBy("doc_id", "__print", "text"))
    ranked = docs.withColumn("__salt", salt).withColumn("__print", print_of).withColumn("__place", place)
    joined = ranked.join(
        offsets,
        F.col("source").eqNullSafe(F.col("c_source")) & (F.col("size") == F.col("c_size")) & (F.col("__salt") == F.col("c_salt")),
        "left",
    )
    rank = F.col("rank0") + F.col("__place")
    share = lambda r: F.floor(r * F.col("k") / F.col("n") + 1e-9)
    whole = F.least(F.lit(most), share(rank) - share(rank - 1))
    joined = joined.withColumn("copies", F.coalesce(whole, F.lit(0)).cast("int"))
    joined = joined.join(
        F.broadcast(given.select(F.col("s").alias("g_source"), F.col("source_size"), F.col("target"))),
        F.col("source").eqNullSafe(F.col("g_source")), "left",
    )
    joined = joined.withColumn("taken", F.col("copies") * F.col("size"))
    found = joined.select(*names, *FRESH)
    return found.toDF(*names.values(), *FRESH)


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row as often as ``mix`` says, columns of ``docs``."""
    rows = mix(guarded(docs, NEEDED), **options).filter("copies > 0")
    again = rows.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), F.col("copies"))))
    return restored(again, docs, NEEDED)
