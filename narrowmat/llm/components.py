"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from narrowmat.llm.common import discard, written


def components(edges: DataFrame) -> DataFrame:
    """``a, b`` (bigint) to ``node, root``: for every node that has an edge, the
    smallest node it can reach. Alternating large-star and small-star steps
    keep at most as many edges as there were; each step is a minimum by key
    and a join (hot keys are split by adaptive execution), written down."""
    now = written(edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        big = both.filter("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        big = written(big.filter("u != v").distinct(), "large")
        least = big.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        met = big.join(least, F.col("u") == F.col("k"))
        small = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select(F.col("k").alias("u"), F.col("m").alias("v")))
        new = written(small.filter("u != v").distinct(), "small")
        mark = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(big)
        discard(now)
        now = new
        if mark == before:
            break
        before = mark
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
