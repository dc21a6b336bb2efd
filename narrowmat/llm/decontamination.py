"""Benchmark decontamination: n-grams of test items, looked up in documents.

Everything is DataFrame functions. The items' windows become a table of hashed bits
that goes to every task as a constant, and a table to verify with. One scan of the
documents tests each window of words against the bits; the few that remain carry
their words and are joined with the windows themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from narrowmat.llm.common import LOWER, UPPER, guarded, only, restored, written

WINDOW = 10

# Every ASCII character but letters and digits parts words.
PARTING = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
# One word with what stands before it.
PIECE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

# Bits per window of the items (one in 64 other windows passes), the least and the
# most bits. More windows than the most allows only pass more on to be verified.
BITS_PER_WINDOW = 64
LEAST_BITS, MOST_BITS = 1 << 14, 1 << 23

# Windows up to this number are broadcast to be verified (they have some 100 bytes
# each); more are joined by a shuffle.
BROADCAST_WINDOWS = 1 << 18


def words_of(text: str) -> Column:
    """Words of a text with A-Z lower-cased, in order."""
    blank = F.translate(F.coalesce(text, F.lit("")), UPPER + PARTING, LOWER + " " * len(PARTING))
    return F.array_remove(F.split(blank, " "), "")


def window_hash(words: str | Column, start: Column, size: Column | int) -> Column:
    return F.xxhash64(F.slice(words, start, size))


def item_windows(benchmark: DataFrame) -> DataFrame:
    """``size, hash, words, items``: the distinct windows, and the items they are from."""
    items = only(benchmark, "item_id", "text").select(F.col("item_id").cast("string").alias("item"), words_of("text").alias("all"))
    items = items.filter(F.size("all") > 0).withColumn("size", F.least(F.lit(WINDOW), F.size("all")))
    found = items.select("item", "size", "all", F.explode(F.sequence(F.lit(1), F.size("all") - F.col("size") + 1)).alias("at"))
    found = found.select(
        "item", "size", window_hash("all", F.col("at"), F.col("size")).alias("hash"),
        F.array_join(F.slice("all", F.col("at"), F.col("size")), " ").alias("words"),
    )
    return found.groupBy("size", "hash", "words").agg(F.collect_set("item").alias("items"))


def bit_table(windows: DataFrame, cells: int) -> str:
    """64 x ``cells`` bits, those of the windows' hashes set, as text of numbers."""
    place = F.pmod("hash", F.lit(64 * cells))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))
    cell = F.shiftright(place, 6)
    own = windows.groupBy(cell.alias("cell")).agg(F.bit_or(one).alias("bits"))
    table = windows.sparkSession.range(cells).join(own, F.col("id") == F.col("cell"), "left")
    ordered = F.array_sort(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0)).alias("bits"))))
    return table.agg(F.array_join(F.transform(ordered, lambda x: x["bits"].cast("string")), ",").alias("t")).first()["t"]


def candidates(words: Column, n: Column, size: int, table: Column, cells: int) -> Column:
    """``pos, size, words`` of every window of ``size`` words whose bit is set."""

    def set_at(i):
        place = F.pmod(window_hash(words, i, size), F.lit(64 * cells))
        return F.bit_get(F.get(table, F.shiftright(place, 6).cast("int")), (place % 64).cast("int")) == 1

    def shown(i):
        return F.struct(i.alias("pos"), F.lit(size).alias("size"), F.array_join(F.slice(words, i, size), " ").alias("words"))

    starts = F.when(n >= size, F.sequence(F.lit(1), n - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(F.filter(starts, set_at), shown)


def covered(spans: str) -> Column:
    """How many words lie in any of the spans (``pos, stop``), sorted by ``pos``."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("stop"))

    def step(done, span):
        stop = F.greatest(done["stop"], span["stop"])
        return F.struct((done["n"] + stop - F.greatest(done["stop"], F.least(span["pos"], stop))).alias("n"), stop.alias("stop"))

    return F.aggregate(spans, start, step, lambda done: done["n"])


class Scan:
    """One scan of ``docs`` against ``benchmark``; ``keep`` names columns to carry.

    ``rows`` has one row per document, with an id that the written table makes
    lasting; ``hits`` has, of documents with candidates, verified spans and items.
    """

    def __init__(self, docs: DataFrame, benchmark: DataFrame, keep: list[str]):
        windows = written(item_windows(benchmark), "windows")
        sizes = {r["size"]: r["n"] for r in windows.groupBy("size").agg(F.count("*").alias("n")).collect()}
        total = sum(sizes.values())
        cells = max(LEAST_BITS, min(MOST_BITS, 1 << (BITS_PER_WINDOW * total).bit_length())) // 64
        split = docs.select(*keep, words_of("text").alias("__words"))
        n = F.size("__words")
        if total:
            table = F.split(F.lit(bit_table(windows, cells)), ",").cast("array<bigint>")
            parts = [candidates(F.col("__words"), n, size, table, cells) for size in sorted(sizes)]
            found = parts[0] if len(parts) == 1 else F.concat(*parts)
        else:
            found = F.array().cast("array<struct<pos int, size int, words string>>")
        scanned = split.select(*keep, n.cast("long").alias("__n"), found.alias("__found"), F.monotonically_increasing_id().alias("__row"))
        self.rows = written(scanned, "scanned")
        if total <= BROADCAST_WINDOWS:
            windows = F.broadcast(windows)
        suspects = self.rows.filter(F.size("__found") > 0).select("__row", F.inline("__found"))
        spans = suspects.join(windows, ["size", "words"]).select(
            "__row", F.struct(F.col("pos"), (F.col("pos") + F.col("size")).alias("stop")).alias("span"), "items"
        )
        self.hits = spans.groupBy("__row").agg(
            F.array_sort(F.collect_set("span")).alias("__spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("__items"),
        )

    def joined(self) -> DataFrame:
        """All rows, with ``__spans`` and ``__items``, null where nothing was found.
        Only rows with candidates take part in the join."""
        clean = self.rows.filter(F.size("__found") == 0).drop("__found")
        other = self.rows.filter(F.size("__found") > 0).drop("__found").join(self.hits, "__row", "left")
        return other.unionByName(clean, allowMissingColumns=True)


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """For every row of ``docs`` (``doc_id, text``) what of it stands in test items
    (``item_id, text``): ``n_words, n_hit, n_items, items_sha256, contaminated``.

    Words are runs of letters and digits, A-Z lower-cased, and of anything beyond
    ASCII. Every ten consecutive words of an item are a window, as is a whole item
    of fewer words. ``n_hit`` counts the words in any occurrence of any window,
    ``n_items`` the items with windows in the text; ``items_sha256`` is that of their
    ids, sorted as text and joined by commas. Items without words have no window; items
    without id hit words but are not counted, and items that share an id are one.
    A null text has no words. Repeated rows are judged each; texts of any length are
    scanned whole. Without items nothing is contaminated; without documents there is
    no row.
    """
    found = Scan(only(docs, "doc_id", "text"), benchmark, ["doc_id"]).joined()
    items = F.coalesce("__items", F.array().cast("array<string>"))
    hit = F.coalesce(covered("__spans"), F.lit(0)).cast("long")
    return found.select(
        "doc_id",
        F.col("__n").alias("n_words"),
        hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, remove: str = "documents") -> DataFrame:
    """``docs`` without contaminated documents, or (``remove="spans"``) with the hit
    words, and what parts each from the word before it, taken out of the texts.

    Rows that are not hit stay as they are, all columns and nulls included; a text
    that is nothing but hit words becomes what follows its last word.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove must be 'documents' or 'spans'")
    plain = guarded(docs, ("doc_id", "text"))
    found = Scan(plain, benchmark, plain.columns).joined()
    if remove == "documents":
        return restored(found.filter("__spans is null").select(*plain.columns), docs, ("doc_id", "text"))
    hit = F.flatten(F.transform("__spans", lambda s: F.sequence(s["pos"], s["stop"] - 1)))
    other = found.filter("__spans is not null").withColumn("__pieces", F.regexp_extract_all("text", F.lit(PIECE), F.lit(0)))
    left = F.array_except(F.sequence(F.lit(1), F.size("__pieces")), hit)
    words = F.transform(left, lambda i: F.get("__pieces", i - 1))
    tail = F.regexp_extract("text", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*$", 0)
    cut = other.withColumn("text", F.concat(F.array_join(words, ""), tail)).select(*plain.columns)
    same = found.filter("__spans is null").select(*plain.columns)
    return restored(same.union(cut), docs, ("doc_id", "text"))


ORACLE = r"""
WITH items AS (
  SELECT item_id::VARCHAR AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT id, k, list_slice(w, i, i + k - 1) AS win
  FROM (SELECT id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i
        FROM items WHERE len(w) > 0)
), docs AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(translate(text,
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents
), sizes AS (SELECT DISTINCT k FROM windows),
places AS (
  SELECT rid, k, i, list_slice(w, i, i + k - 1) AS win
  FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, sizes)
), hits AS (
  SELECT rid, i, p.k AS k, id FROM places p JOIN windows w ON p.k = w.k AND p.win = w.win
), words AS (
  SELECT rid, count(DISTINCT pos) AS n_hit
  FROM (SELECT rid, unnest(range(i, i + k)) AS pos FROM hits) GROUP BY rid
), found AS (
  SELECT rid, count(DISTINCT id) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT rid, id FROM hits) GROUP BY rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (rid) LEFT JOIN found USING (rid)
"""
