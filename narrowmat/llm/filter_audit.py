"""Audit of five filters in every order: contingency tensors per part, contracted.

Documents are counted by part and by which of the five filters they fail. A part's
counts, shaped 2x2x2x2x2, hold all that any order of the filters can do: every
figure of a step is a contraction that takes "pass", "fail" or "all" on each axis.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from narrowmat.llm.common import only, written

FILTERS = "ABCDE"
PASS, FAIL, ALL = (1, 0), (0, 1), (1, 1)

# Parts contracted at a time: 600 rows come of each.
PARTS_AT_ONCE = 64

AUDIT = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, "
    "unique_fails long, good_lost long, toxic_lost long, shapley long"
)


def text_flags(docs: DataFrame) -> DataFrame:
    """``doc_id, part, digest, a, b, c, d`` of every row: the conditions that look at
    one text alone, and the SHA-256 that tells equal texts."""
    text = F.coalesce("text", F.lit(""))
    rows = only(docs, "doc_id", "source", "text").select(
        "doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("text")
    )
    words = F.array_remove(F.split(F.translate("text", "\t\n\x0b\x0c\r", " " * 5), " "), "")
    return rows.select("doc_id", "part", "text", words.alias("words")).select(
        "doc_id",
        "part",
        F.unhex(F.sha2("text", 256)).alias("digest"),
        (F.size("words") < 50).alias("a"),
        (100 * F.size(F.array_distinct("words")).cast("long") < 65 * F.size("words").cast("long")).alias("b"),
        (100 * F.length(F.regexp_replace("text", "[^A-Z]+", "")).cast("long") > 5 * F.length("text").cast("long")).alias("c"),
        F.col("text").rlike(r"[#$%&*|]").alias("d"),
    )


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, a, b, c, d, e, good, toxic`` of every row of ``docs``.

    Whether a text has a smaller id elsewhere needs no group of equal texts in one
    place: the smallest id of each text is found by a combined aggregate and joined
    on text and id, which no two rows but repeated ones share.
    """
    flags = written(text_flags(docs), "flags")
    named, unnamed = flags.filter("doc_id is not null"), flags.filter("doc_id is null")
    first = named.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    known = only(labels, "doc_id", "quality", "toxic").filter("doc_id is not null")
    known = known.groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
    )
    joined = named.join(first, ["digest", "doc_id"], "left").join(known, "doc_id", "left")
    never = F.lit(False)
    shown = ["part", "a", "b", "c", "d"]
    return joined.select(
        *shown,
        F.col("first").isNull().alias("e"),
        F.coalesce("good", never).alias("good"),
        F.coalesce("toxic", never).alias("toxic"),
    ).union(unnamed.select(*shown, never.alias("e"), never.alias("good"), never.alias("toxic")))


def selectors() -> tuple[list[tuple[str, int]], dict[str, np.ndarray]]:
    """The 600 steps, and for each contraction what it takes on the five axes: an
    array of steps x axes x (passed, failed)."""
    steps, kept, removed, fails, alone = [], [], [], [], []
    for order in permutations(range(len(FILTERS))):
        name = "".join(FILTERS[f] for f in order)
        for step, own in enumerate(order, start=1):
            earlier = order[: step - 1]
            steps.append((name, step))
            kept.append([PASS if f in earlier or f == own else ALL for f in range(5)])
            removed.append([FAIL if f == own else PASS if f in earlier else ALL for f in range(5)])
            fails.append([FAIL if f == own else ALL for f in range(5)])
            alone.append([FAIL if f == own else PASS for f in range(5)])
    axes = {"kept": kept, "removed": removed, "fails": fails, "alone": alone}
    return steps, {k: np.array(v, dtype=np.int64) for k, v in axes.items()}


def contract(tensors: np.ndarray, taken: np.ndarray) -> np.ndarray:
    """``tensors`` (parts x 2x2x2x2x2) by ``taken`` (steps x 5 x 2): parts x steps."""
    axes = [taken[:, f] for f in range(5)]
    return np.einsum("pabcde,sa,sb,sc,sd,se->ps", tensors, *axes, optimize=True)


def _audit(batches):
    steps, taken = selectors()
    order = pa.array([name for name, _ in steps])
    step = pa.array([number for _, number in steps], pa.int32())
    own = np.array([FILTERS.index(name[number - 1]) for name, number in steps])
    names = [column.split()[0] for column in AUDIT.split(", ")]
    for batch in batches:
        for at in range(0, batch.num_rows, PARTS_AT_ONCE):
            some = batch.slice(at, PARTS_AT_ONCE)
            parts = some.num_rows
            cells = np.zeros((3, parts, 32), dtype=np.int64)
            lists = some.column("cells")
            where = np.repeat(np.arange(parts), np.diff(lists.offsets.to_numpy()))
            found = lists.flatten()
            mask = found.field("mask").to_numpy()
            for k, column in enumerate(("n", "good", "toxic")):
                cells[k, where, mask] = found.field(column).to_numpy()
            total, good, toxic = cells.reshape(3, parts, 2, 2, 2, 2, 2)
            removed = contract(total, taken["removed"])
            shapley = np.stack([removed[:, own == f].sum(axis=1) for f in range(5)], axis=1)[:, own]
            figures = [
                contract(total, taken["kept"]),
                removed,
                contract(total, taken["fails"]) - removed,
                contract(total, taken["alone"]),
                contract(good, taken["removed"]),
                contract(toxic, taken["removed"]),
                shapley,
            ]
            rows = pa.array(np.repeat(np.arange(parts), len(steps)))
            cycle = pa.array(np.tile(np.arange(len(steps)), parts))
            yield pa.RecordBatch.from_arrays(
                [some.column("part").take(rows), order.take(cycle), step.take(cycle)]
                + [pa.array(np.ascontiguousarray(x).ravel()) for x in figures],
                names=names,
            )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What each of five filters does at each step of each of their 120 orders, per
    part (``source``) of ``docs`` (``doc_id, source, text``).

    A document fails A with under 50 words, B if fewer than 65 % of its words are
    distinct, C if over 5 % of its code points are A-Z, D if it holds one of
    ``#$%&*|``, E if a row with a smaller ``doc_id`` has the same text. ``kept``
    and ``removed`` count documents at the step, ``redundant`` those that fail its
    filter but went before, ``unique_fails`` those that fail no other filter,
    ``good_lost`` and ``toxic_lost`` the removed with that label (``labels``:
    ``doc_id, quality, toxic``), ``shapley`` the filter's ``removed`` over all orders.

    Null texts count as empty, null sources as the empty part. Rows without
    ``doc_id`` pass E, equal a text of theirs to no other, and have no label. Rows
    that repeat a ``doc_id`` count each; of repeated labels any 1 counts. Texts of any
    length are judged whole. Without documents there is no part and no row.
    """
    marks = [F.col(f.lower()).cast("int") * (16 >> k) for k, f in enumerate(FILTERS)]
    mask = marks[0] + marks[1] + marks[2] + marks[3] + marks[4]
    counts = failures(docs, labels).groupBy("part", mask.alias("mask")).agg(
        F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic")
    )
    cells = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    return cells.mapInArrow(_audit, AUDIT)


ORACLE = r"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents
), split AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM texts
), first AS (
  SELECT text, min(doc_id) AS first FROM texts GROUP BY text
), failed AS (
  SELECT s.part,
    len(words) < 50 AS a,
    100 * len(list_distinct(words)) < 65 * len(words) AS b,
    100 * len(regexp_replace(s.text, '[^A-Z]', '', 'g')) > 5 * len(s.text) AS c,
    regexp_matches(s.text, '[#$%&*|]') AS d,
    coalesce(s.doc_id > f.first, false) AS e,
    coalesce(l.quality = 1, false) AS good, coalesce(l.toxic = 1, false) AS toxic
  FROM split s JOIN first f ON s.text = f.text LEFT JOIN labels l ON s.doc_id = l.doc_id
), masks AS (
  SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask,
    count(*) AS n, sum(good::INT) AS good, sum(toxic::INT) AS toxic
  FROM failed GROUP BY ALL
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l, unnest([1, 2, 4, 8, 16]) AS bit
), orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
), steps AS (
  SELECT filter_order, step::INT AS step, bits[step] AS own,
    coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before
  FROM orders, range(1, 6) r(step)
), figures AS (
  SELECT part, filter_order, step, own,
    coalesce(sum(n) FILTER (mask & (before | own) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (mask & before = 0 AND mask & own <> 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (mask & before <> 0 AND mask & own <> 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (mask = own), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (mask & before = 0 AND mask & own <> 0), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & own <> 0), 0)::BIGINT AS toxic_lost
  FROM masks, steps GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM figures
"""
