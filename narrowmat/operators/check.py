"""Checks of factors: against the known R, and against each other."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from narrowmat.functions import cells

# Fixed value: how far an entry may be from 1.
TOLERANCE = 10 * float(np.finfo(float).eps)

# Fixed value: how many wrong entries a verdict lists.
LISTED = 10


class Verdict(NamedTuple):
    """``diffs (i, j, diff)`` of the upper triangle, the verdict in one row
    ``verdict, nerrs``, and the first wrong entries."""

    diffs: DataFrame
    verdict: DataFrame
    errors: DataFrame


def normalize_signs(factor: DataFrame) -> DataFrame:
    """Signs that a factorisation leaves open, fixed.

    A factor (``i, row``) gets a diagonal of zeros or more; vectors
    (``k, j, v``) get first entries of zeros or more.
    """
    if "row" in factor.columns:
        # Rows below the width have no diagonal and stay as they are.
        diagonal = F.coalesce(F.try_element_at("row", F.col("i") + 1), F.lit(1.0))
        sign = F.array(cells.unit_sign(diagonal))
        turned = F.transform(
            sign, lambda s: F.transform("row", lambda x: x * s + F.lit(0.0))
        )[0]
        return factor.select("i", turned.alias("row"))
    first = F.first("v").over(Window.partitionBy("k").orderBy("j"))
    return factor.select(
        "k", "j", (F.col("v") * cells.unit_sign(first) + F.lit(0.0)).alias("v")
    )


def check_triu_ones(factor: DataFrame, tol: float = TOLERANCE) -> Verdict:
    """Is R, up to the signs of its rows, the upper triangle of ones?"""
    whole = Window.partitionBy(F.lit(0))
    held = factor.select(
        "i",
        "row",
        F.count("*").over(whole).alias("n"),
    )
    good = (F.size("row") == F.col("n")) & (F.col("i") < F.col("n"))
    row = F.when(good, F.col("row")).otherwise(
        cells.fail("a factor must be square", "array<double>")
    )
    signed = normalize_signs(held.select("i", row.alias("row")))
    entries = signed.select("i", F.posexplode("row").alias("j", "value"))
    diffs = entries.filter(F.col("j") >= F.col("i")).select(
        "i", "j", F.abs(F.col("value") - 1.0).alias("diff")
    )
    # NaN is greater than any number here, so it counts as wrong.
    wrong = F.col("diff") > tol
    counted = diffs.agg(
        F.count("*").alias("entries"), F.count_if(wrong).alias("nerrs")
    )
    nerrs = F.when(F.col("entries") > 0, F.col("nerrs")).otherwise(
        cells.fail("the factor is empty", "bigint")
    )
    verdict = counted.select(
        F.when(nerrs == 0, "CORRECT").otherwise("INCORRECT").alias("verdict"),
        "nerrs",
    )
    return Verdict(diffs, verdict, diffs.filter(wrong).orderBy("i", "j").limit(LISTED))


def _entries(df: DataFrame) -> tuple[DataFrame, str]:
    if "row" in df.columns:
        return df.select("i", F.posexplode("row").alias("j", "value")), "i"
    if "v" in df.columns:
        return df.select(F.col("k").alias("i"), "j", F.col("v").alias("value")), "k"
    name = next(c for c in ("x", "y", "s", "value") if c in df.columns)
    place = next(c for c in ("j", "k") if c in df.columns)
    return df.select(F.col(place).alias("i"), F.lit(0).alias("j"), F.col(name).alias("value")), place


def _paired(a: DataFrame, b: DataFrame) -> DataFrame:
    left, _ = _entries(a)
    right, _ = _entries(b)
    both = left.withColumnRenamed("value", "a").join(
        right.withColumnRenamed("value", "b"), ["i", "j"], "full"
    )
    missing = cells.fail("the factors differ in shape", "double")
    return both.select("i", F.coalesce("a", missing).alias("a"), F.coalesce("b", missing).alias("b"))


def compare_factors(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sum of absolute differences as ``index, absdiff``: by row of two R
    factors, by component of two sets of vectors. Different shapes raise."""
    gap = F.abs(F.col("a") - F.col("b"))
    return _paired(a, b).groupBy(F.col("i").alias("index")).agg(F.sum(gap).alias("absdiff"))


def relative_difference(z: DataFrame, y: DataFrame) -> DataFrame:
    """``|z - y| / |z|`` of two vectors, in one row ``reldiff``."""
    gap = F.col("a") - F.col("b")
    return _paired(z, y).agg(
        (F.sqrt(F.sum(gap * gap)) / F.sqrt(F.sum(F.col("a") * F.col("a")))).alias("reldiff")
    )
