"""Language identification by language-bitmask n-gram filters.

A Bloom filter whose cells hold bits per language answers for an n-gram with the set
of all languages that contain it, and with the set of those it is typical of. A text's
n-grams are looked up and counted per language in both sets; counts are corrected for
the filter's false positives, and the largest share decides.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from narrowmat.llm.common import crc_mod, guarded, mix, only, restored, written

GRAM = 3
# Cells of the filter: a power of two, ROOM for each n-gram of the language with most.
ROOM, LEAST_CELLS, MOST_CELLS = 16, 1 << 12, 1 << 24
HASHES = 3
RATIO = 3.0  # typical of a language: at least 1/RATIO as frequent as in any other
UNKNOWN = "und"
LEAST_SCORE = 0.1
PART_CHARS = 1 << 18
CHUNK_CHARS = 1 << 19
RUN_BYTES = 1 << 22
WORD_BITS = 62  # bits per mask, two for each language; a longer list takes several masks


def letters() -> np.ndarray:
    table = np.zeros(0x110000, dtype=bool)
    table[[c for c in range(0x110000) if chr(c).isalpha()]] = True
    return table


def _runs(column: pa.Array):
    """A text column in runs of limited size: first row, and texts as strings."""
    size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, taken = 0, 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(size, taken + RUN_BYTES, "right")))
        yield at, column.slice(at, to - at).to_pylist()
        at, taken = to, int(size[to - 1])


def _pieces(texts):
    """Lower-cased texts, long ones in overlapping pieces: piece, text number."""
    for k, text in enumerate(texts):
        low = (text or "").lower()
        for at in range(0, max(len(low), 1), PART_CHARS):
            yield low[max(0, at - GRAM + 1) : at + PART_CHARS], k


def _chunks(texts):
    held, owner, size = [], [], 0
    for piece, k in _pieces(texts):
        held.append(piece)
        owner.append(k)
        size += len(piece)
        if size >= CHUNK_CHARS:
            yield held, owner
            held, owner, size = [], [], 0
    if held:
        yield held, owner


def _grams(is_letter: np.ndarray, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all n-grams with a letter in the middle, and where those of each piece
    begin. What is no letter counts as a blank, and so do the ends of a text."""
    points = np.frombuffer((" " + "  ".join(pieces) + " ").encode("utf-32-le"), dtype=np.uint32)
    good = is_letter[points]
    codes = np.where(good, points, np.uint32(32))
    middle = np.flatnonzero(good[1:-1]) + 1
    packed = codes[middle - 1].astype(np.uint64) << np.uint64(21)
    packed |= codes[middle]
    packed <<= np.uint64(21)
    packed |= codes[middle + 1]
    ends = np.cumsum([len(p) + 2 for p in pieces])
    return packed, np.searchsorted(middle, np.concatenate([[0], ends]))


def _cells(codes: np.ndarray, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        first = mix(codes)
        step = mix(codes + np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        return np.stack([(first + np.uint64(k) * step) & np.uint64(size - 1) for k in range(HASHES)]).astype(np.int64)


@dataclass
class Model:
    """``masks``: (words, cells) bits, those of language k at 2k (contains) and 2k + 1
    (typical); ``chance``: false positives per bit."""

    languages: list[str]
    masks: np.ndarray
    chance: np.ndarray


def train(docs: DataFrame) -> Model:
    """Learn from all rows with text and language.

    A language contains every n-gram that occurs in its rows; nothing is left out. Counting and setting bits
    run in Spark. The filter has room for ``ROOM`` times the n-grams of the language with
    most of them; beyond ``MOST_CELLS`` (128 MiB for every 31 languages) it fills up
    instead and the correction for false positives takes over. The driver gets the
    cells that are not empty.
    """
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(letters())

    def count(batches):
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            names = sorted(set(langs))
            for first, texts in _runs(batch.column("text")):
                for held, owner in _chunks(texts):
                    codes, bounds = _grams(table.value, held)
                    which = np.repeat([names.index(langs[first + k]) for k in owner], np.diff(bounds))
                    for j, name in enumerate(names):
                        own = codes[which == j] if len(names) > 1 else codes
                        if len(own):
                            labels, distinct = pd.factorize(own)
                            n = np.bincount(labels)
                            yield pa.RecordBatch.from_arrays([pa.array([name] * len(distinct)), pa.array(distinct.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    rows = only(docs, "text", "lang").filter("text is not null and lang is not null")
    counts = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = written(counts, "grams")
    totals = {r.lang: r for r in counts.groupBy("lang").agg(F.sum("n").alias("n"), F.count("*").alias("grams")).collect()}
    languages = sorted(totals, key=lambda s: (-totals[s].n, s))
    words = max(1, -(-2 * len(languages) // WORD_BITS))
    wanted = ROOM * max((r.grams for r in totals.values()), default=1)
    size = min(MOST_CELLS, max(LEAST_CELLS, 1 << (wanted - 1).bit_length()))
    masks = np.zeros((words, size), dtype=np.uint64)
    if languages:
        given = spark.createDataFrame([(s, 2 * k, float(totals[s].n)) for k, s in enumerate(languages)], "lang string, bit int, total double")
        rated = counts.join(F.broadcast(given), "lang").withColumn("rate", F.col("n") / F.col("total"))
        found = rated.groupBy("gram").agg(F.max("rate").alias("top"), F.collect_list(F.struct("rate", "bit")).alias("all"))
        typical = F.transform(F.filter("all", lambda x: x.rate * RATIO >= F.col("top")), lambda x: x.bit + 1)
        marked = found.select("gram", F.explode(F.concat(F.transform("all", lambda x: x.bit), typical)).alias("bit"))

        def place(batches):
            for batch in batches:
                codes = batch.column("gram").to_numpy(zero_copy_only=False).view(np.uint64)
                bit = batch.column("bit").to_numpy(zero_copy_only=False)
                cells = _cells(codes, size)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cells.reshape(-1).astype(np.int32)), pa.array(np.tile(bit // WORD_BITS, HASHES).astype(np.int32)), pa.array(np.tile(1 << (bit % WORD_BITS).astype(np.int64), HASHES))],
                    names=["cell", "word", "mask"],
                )

        bits = marked.mapInArrow(place, "cell int, word int, mask long")
        found = bits.groupBy("cell", "word").agg(F.bit_or("mask").alias("mask")).toArrow()
        word, cell, mask = (found.column(c).to_numpy() for c in ("word", "cell", "mask"))
        masks[word, cell] = mask.view(np.uint64)
    fill = np.array([((masks[k // WORD_BITS] >> np.uint64(k % WORD_BITS)) & np.uint64(1)).mean() for k in range(2 * len(languages))])
    return Model(languages, masks, fill**HASHES)


def _shared(model: Model) -> tuple:
    """The model as plain values, which executors can read without this package."""
    return model.languages, model.masks, model.chance


def _predictor(is_letter: np.ndarray, languages: list[str], masks: np.ndarray, chance: np.ndarray):
    """A text column to languages and scores."""
    n_bits = 2 * len(languages)

    def count(texts: list, hits: np.ndarray, total: np.ndarray) -> None:
        for held, owner in _chunks(texts):
            codes, bounds = _grams(is_letter, held)
            if not len(codes):
                continue
            some = np.flatnonzero(np.diff(bounds))
            starts, who = bounds[some], np.array(owner)[some]
            np.add.at(total, who, np.diff(bounds)[some])
            labels, distinct = pd.factorize(codes)
            cells = _cells(distinct, masks.shape[1])
            for word in range(len(masks)):
                mask = masks[word][cells[0]]
                for k in range(1, HASHES):
                    mask = mask & masks[word][cells[k]]
                for j in range(word * WORD_BITS, min(n_bits, (word + 1) * WORD_BITS)):
                    bit = ((mask >> np.uint64(j % WORD_BITS)) & np.uint64(1)).astype(np.uint32)
                    np.add.at(hits[:, j], who, np.add.reduceat(bit[labels], starts))

    def run(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        rows = len(column)
        hits, total = np.zeros((rows, n_bits)), np.zeros(rows)
        for first, texts in _runs(column):
            count(texts, hits[first : first + len(texts)], total[first : first + len(texts)])
        names, score = np.full(rows, UNKNOWN, dtype=object), np.zeros(rows)
        if n_bits and rows:
            some = total > 0
            share = hits / np.maximum(total, 1)[:, None]
            share = np.clip((share - chance) / np.maximum(1 - chance, 1e-9), 0, 1)
            share = (share[:, ::2] + share[:, 1::2]) / 2
            best = share.argmax(axis=1)
            names[some] = np.array(languages, dtype=object)[best[some]]
            score[some] = share[np.arange(rows), best][some]
        return names, score

    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row of ``docs`` (``doc_id, text``).

    ``score``: corrected share of the text's n-grams that the language contains, and
    of those that are typical of it, halved.
    Null texts and texts without a letter get ``und`` and 0; so does everything
    if nothing was learned. Ties go to the language with more training text.
    """
    context = docs.sparkSession.sparkContext
    table, shared = context.broadcast(letters()), context.broadcast(_shared(model))

    def run(batches):
        decide = _predictor(table.value, *shared.value)
        for batch in batches:
            names, score = decide(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    return only(docs, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def identify(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """Learn from the rows whose crc32(doc_id) mod ``folds`` is not ``held`` (rows
    without doc_id are not learned from), then predict all of them: ``doc_id,
    held_out, lang_pred, score``. Rows without text or ``lang`` are not learned from
    either; without text or a letter they are ``und``. Rows that repeat count and are
    predicted each, texts of any length are read whole, and an empty table gives an
    empty result."""
    fold = crc_mod("doc_id", folds)
    model = train(only(docs, "doc_id", "text", "lang").filter(fold != held))
    found = predict(docs, model)
    return found.select("doc_id", F.coalesce(crc_mod("doc_id", folds) == held, F.lit(False)).alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, folds: int = 4, held: int = 2, least: float = LEAST_SCORE) -> DataFrame:
    """The rows whose language was recognised, with all their columns. Rejected: what
    is ``und``, and what scores less than ``least`` in its best language.
    Decided where the row lies, so no text crosses the network."""
    model = train(only(docs, "doc_id", "text", "lang").filter(crc_mod("doc_id", folds) != held))
    context = docs.sparkSession.sparkContext
    table, shared = context.broadcast(letters()), context.broadcast(_shared(model))
    rows = guarded(docs, ("doc_id", "text"))

    def run(batches):
        decide = _predictor(table.value, *shared.value)
        for batch in batches:
            names, score = decide(batch.column("text"))
            yield batch.filter(pa.array((names != UNKNOWN) & (score >= least), pa.bool_()))

    return restored(rows.mapInArrow(run, rows.schema), docs, ("doc_id", "text"))
