"""Exact duplicates by deterministic block naming.

Every text is cut into blocks of a fixed number of bytes. Distinct blocks are
sorted and numbered: equal blocks get equal names, different blocks different
ones. Then adjacent names are paired, the distinct pairs sorted and numbered,
and so on, until every document is down to one name. A name is unique within its
level, so documents are equal exactly if level and name are: no fingerprint
decides anything, and no two texts can collide.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from narrowmat.llm.common import discard, guarded, only, restored, written

BLOCK_BYTES = 1024


def _named(distinct: DataFrame, columns: list[str], label: str, keep: list[str] | None = None) -> DataFrame:
    """Number the rows of ``distinct``. They lie hashed over the partitions by the
    grouping that made them; sorted there, a row's name is its partition and
    its place. Written down, so that nobody ever sees another numbering."""
    names = distinct.sortWithinPartitions(*columns).withColumn("name", F.monotonically_increasing_id())
    return written(names.select(*(keep or columns), "name"), label)


def identities(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per distinct (doc_id, text): ``doc_id, sha``, number of such rows
    ``n``, and the identity ``level, name`` of the text.

    Rows that agree in both are interchangeable and travel as one. ``sha`` only
    tells apart rows that share a doc_id; it plays no part in the identity.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = only(docs, "doc_id", "text").select("doc_id", F.sha2(text, 256).alias("sha"), text.cast("binary").alias("b"))
    rows = rows.withColumn("nb", F.greatest(F.lit(1), F.ceil(F.length("b") / block_bytes)).cast("int"))
    cut = F.transform(
        F.sequence(F.lit(0), F.col("nb") - 1),
        lambda i: F.substring(F.col("b"), i * block_bytes + 1, F.lit(block_bytes)),
    )
    blocks = rows.select("doc_id", "sha", "nb", F.posexplode(cut).alias("pos", "block"))
    # Distinct blocks travel once, to be named. Occurrences then find their name by
    # a hash of the block wherever only one block has that hash (all but never
    # otherwise), and by the block itself where several do.
    hashed = blocks.withColumn("h", F.xxhash64("block"))
    names = _named(hashed.select("h", "block").distinct(), ["h", "block"], "blocks", ["h"])
    shared = names.groupBy("h").agg(F.count("*").alias("many")).filter("many > 1").select("h")
    parts = hashed.drop("block").join(names, "h")
    if not shared.isEmpty():
        odd = hashed.join(shared, "h", "left_semi")
        exact = _named(odd.select("h", "block").distinct(), ["h", "block"], "odd").withColumn("name", -2 - F.col("name"))
        parts = hashed.drop("block").join(names.join(shared, "h", "left_anti"), "h").unionByName(
            odd.join(exact, ["h", "block"]).drop("block")
        )
    parts = parts.select("doc_id", "sha", "nb", "pos", "name", F.lit(1).alias("n"))
    even, done, level = F.col("pos") % 2 == 0, None, 0
    while True:
        # Rows that repeat a (doc_id, text) fall together here; n counts them.
        pairs = written(
            parts.groupBy("doc_id", "sha", "nb", F.floor(F.col("pos") / 2).alias("half")).agg(
                F.max(F.when(even, F.col("name"))).alias("a"),
                F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("b"),  # -1: nothing beside it
                F.sum(F.when(even, F.col("n"))).alias("n"),
            ),
            f"pairs{level}",
        )
        discard(names)
        whole = pairs.filter("nb = 1").select("doc_id", "sha", "n", F.lit(level).alias("level"), F.col("a").alias("name"))
        done = whole if done is None else done.unionAll(whole)
        longest = pairs.agg(F.max("nb")).first()[0]
        if longest is None or longest <= 1:
            return done
        more = pairs.filter("nb > 1").select(
            "doc_id", "sha", F.ceil(F.col("nb") / 2).cast("int").alias("nb"), F.col("half").alias("pos"), "a", "b", "n"
        )
        names = _named(more.select("a", "b").distinct(), ["a", "b"], f"names{level}")
        parts = more.join(names, ["a", "b"]).select("doc_id", "sha", "nb", "pos", "name", "n")
        level += 1


def exact_duplicates(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For every row of ``docs`` (``doc_id, text``, anything else is left alone):
    ``doc_id, keep_id, group_size, kept, text_sha256``.

    Of equal texts the row with the largest doc_id stays. A null text equals an
    empty one. Null doc_ids count as smaller than all others: such a row stays
    only if its group has no other. Of rows that agree in doc_id and text, one
    stays. An empty table gives an empty result.
    """
    found = written(identities(docs, block_bytes), "identities")
    groups = found.groupBy("level", "name").agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size"))
    rows = found.join(groups, ["level", "name"]).select(
        "doc_id", "keep_id", "group_size", "sha",
        F.posexplode(F.array_repeat(F.lit(0), F.col("n").cast("int"))).alias("copy", "zero"),
    )
    return rows.select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 0)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def keep_one(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    kept = exact_duplicates(docs, block_bytes).groupBy("doc_id", "text_sha256").agg(
        F.max("kept").alias("kept"), F.count("*").alias("n")
    )
    kept = kept.filter("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"), F.col("n").alias("__n"))
    rows = guarded(docs, ("doc_id", "text"))
    keyed = rows.withColumn("__own", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    hit = keyed.join(kept, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__sha")))
    alone = hit.filter("__n = 1")
    again = hit.filter("__n > 1").dropDuplicates(["__id", "__sha"])
    return restored(alone.unionAll(again), docs, ("doc_id", "text"))
