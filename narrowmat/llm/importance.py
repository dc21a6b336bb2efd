"""Importance resampling towards a target: hashed word n-grams by Arrow kernels.

Texts are lower-cased, split and encoded as indices of distinct words by Arrow;
neighbouring indices make pairs, and only distinct words and pairs are hashed. The
checksum of a pair comes from those of its words: a checksum is linear, so the one of
the first word is moved on by the length of the second through small tables.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from narrowmat.llm.common import guarded, only, restored, text_buffers, written

BUCKETS = 10_000
SHARE = 25  # per cent of the documents with enough words
LEAST_WORDS = 20

# What parts words once A-Z are lower-cased, and the checksum's polynomial.
PARTING = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
POLYNOMIAL = 0xEDB88320

# Text handled at a time, in bytes (one text at least).
RUN_BYTES = 1 << 21

COUNTS = "bucket int, n long"


@cache
def _byte_table() -> np.ndarray:
    """What one more zero byte makes of the lowest byte of a checksum."""
    found = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        found = np.where(found & 1, (found >> 1) ^ np.uint32(POLYNOMIAL), found >> 1)
    return found


@cache
def shift_tables(length: int) -> np.ndarray:
    """Four tables (by byte of the checksum) that move it on by ``length`` zero bytes."""
    if length == 0:
        return np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    half = shift_tables(length // 2)
    found = shifted(shifted(shift_tables(0), half), half)
    if length % 2:
        found = (found >> np.uint32(8)) ^ _byte_table()[found & np.uint32(255)]
    return found


def shifted(crc: np.ndarray, tables: np.ndarray) -> np.ndarray:
    bytes_of = [(crc >> np.uint32(8 * k)) & np.uint32(255) for k in range(4)]
    return tables[0][bytes_of[0]] ^ tables[1][bytes_of[1]] ^ tables[2][bytes_of[2]] ^ tables[3][bytes_of[3]]


def joined_crc(first: np.ndarray, second: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """crc32 of two texts in a row from crc32 of each and the length of the second."""
    out = np.empty(len(first), dtype=np.uint32)
    order = np.argsort(lengths, kind="stable")
    values, starts = np.unique(lengths[order], return_index=True)
    for length, some in zip(values.tolist(), np.split(order, starts[1:])):
        out[some] = shifted(first[some], shift_tables(length)) ^ second[some]
    return out


def feature_runs(column: pa.Array, buckets: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """A text column by runs: first row, row after the last, words of each row,
    bucket of every feature, and where each row's features begin."""
    for at, to, data, offsets in text_buffers(column, RUN_BYTES):
        texts = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(data))
        pieces = pc.split_pattern_regex(pc.ascii_lower(texts), PARTING)
        edges = pieces.offsets.to_numpy()
        words = pc.list_flatten(pieces)
        real = pc.greater(pc.binary_length(words), 0)
        before = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
        edges = before[edges]
        coded = pc.dictionary_encode(words.filter(real))
        index = coded.indices.to_numpy().astype(np.int64)
        known = coded.dictionary.cast(pa.large_binary()).to_pylist()
        crc = np.fromiter(map(zlib.crc32, known), dtype=np.uint32, count=len(known))
        open_crc = np.fromiter((zlib.crc32(b" ", c) for c in crc.tolist()), dtype=np.uint32, count=len(known))
        size = np.fromiter(map(len, known), dtype=np.int64, count=len(known))

        follows = np.ones(max(len(index), 1), dtype=bool)
        follows[edges[1:-1][edges[1:-1] < len(index)]] = False
        second = np.flatnonzero(follows[1:]) + 1  # words with one before them in their text
        pairs = pc.dictionary_encode(pa.array(index[second - 1] * max(len(known), 1) + index[second]))
        a, b = np.divmod(pairs.dictionary.to_numpy(), max(len(known), 1))
        pair_bucket = joined_crc(open_crc[a], crc[b], size[b]).astype(np.int64) % buckets

        # A row's features: its words, each followed by the pair that it ends.
        n_words = np.diff(edges)
        place = np.arange(len(index)) + np.concatenate([[0], np.cumsum(follows[1:])])[: len(index)]
        bucket = np.empty(len(index) + len(second), dtype=np.int64)
        bucket[place] = (crc.astype(np.int64) % buckets)[index]
        bucket[place[second] - 1] = pair_bucket[pairs.indices.to_numpy()]
        n_features = n_words + np.maximum(n_words - 1, 0)
        yield at, to, n_words, bucket, np.concatenate([[0], np.cumsum(n_features)])


def bucket_counts(df: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """``bucket, n``: how many features of all texts fall into each bucket. A task
    hands on one count for each bucket."""

    def run(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for *_, found, _ in feature_runs(batch.column(text), buckets):
                total += np.bincount(found, minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["bucket", "n"])

    return only(df, text).mapInArrow(run, COUNTS).groupBy("bucket").agg(F.sum("n").alias("n"))


def _dense(counts: DataFrame, buckets: int) -> np.ndarray:
    table = counts.toArrow()
    out = np.zeros(buckets, dtype=np.int64)
    out[table["bucket"].to_numpy()] = table["n"].to_numpy()
    return out


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousand times the log of how much likelier each bucket is in the target
    than in the raw texts, one count added to each bucket of both; rounded down."""
    s, t = raw.astype(float), target.astype(float)
    n = len(s)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def weights(docs: DataFrame, gains: np.ndarray) -> DataFrame:
    """``doc_id, n_words, n_features, weight``: the mean gain of each text's features,
    rounded down; 0 for a text without features."""
    shared = docs.sparkSession.sparkContext.broadcast(gains)

    def run(batches):
        gain = shared.value
        for batch in batches:
            rows = batch.num_rows
            n_words, n_features, total = (np.zeros(rows, dtype=np.int64) for _ in range(3))
            for at, to, words, found, edges in feature_runs(batch.column("text"), len(gain)):
                n_words[at:to] = words
                n_features[at:to] = np.diff(edges)
                some = np.flatnonzero(np.diff(edges))
                if len(some):
                    total[at + some] = np.add.reduceat(gain[found], edges[some])
            weight = np.floor_divide(total, np.maximum(n_features, 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *map(pa.array, (n_words, n_features, weight))],
                names=["doc_id", "n_words", "n_features", "weight"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return only(docs, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def noise(doc_id, seed: int):
    """A thousand times a standard Gumbel number fixed by the id, rounded down."""
    id_text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), id_text), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(scored: DataFrame, share: int, least_words: int) -> DataFrame:
    """``scored`` (with ``n_words``, ``score``, ``doc_id``) and ``rank``, from 1, of the
    ``share`` per cent with the highest scores among rows with ``least_words`` or more.

    Scores are whole numbers within some 100,000 of each other, so the rows are
    counted by score and only these counts are summed in one task; rows are sorted
    among those of the same score.
    """
    able = F.col("n_words") >= least_words
    counts = scored.filter(able).groupBy("score").agg(F.count("*").alias("__n"))
    whole = Window.partitionBy(F.lit(0)).orderBy(F.desc("score"))
    sums = counts.select(
        "score",
        (F.sum("__n").over(whole.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")).alias("__above"),
        F.call_function("div", F.sum("__n").over(Window.partitionBy(F.lit(0))) * share, F.lit(100)).alias("__draw"),
    ).filter("__above < __draw")
    # At most as many rows as there are scores: some 100,000 of 24 bytes.
    joined = scored.withColumn("__score", F.when(able, F.col("score"))).join(
        F.broadcast(sums.withColumnRenamed("score", "__score")), "__score", "left"
    )
    drawn = joined.filter("__above is not null")
    within = F.row_number().over(Window.partitionBy("__score").orderBy(F.asc_nulls_last("doc_id")))
    drawn = drawn.withColumn("rank", F.col("__above") + within)
    drawn = drawn.withColumn("rank", F.when(F.col("rank") <= F.col("__draw"), F.col("rank")))
    rest = joined.filter("__above is null").withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).select(*scored.columns, "rank")


def resample(docs: DataFrame, target: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS, seed: int = 7, buckets: int = BUCKETS) -> DataFrame:
    """Draw documents (``doc_id, text``) so that their words and pairs of words
    resemble those of ``target`` (``text``): ``doc_id, n_words, n_features, weight,
    score, rank``. Runs two jobs that count features.

    Words are runs of letters and digits, A-Z lower-cased, and of anything beyond
    ASCII; features are words and pairs of consecutive words, with repeats.
    ``score`` is the weight plus noise fixed by ``doc_id`` and ``seed``, which makes
    the highest scores a draw without replacement. Ranked are the highest
    ``share`` per cent of the documents with ``least_words`` or more, ties by
    smaller ``doc_id``; ``rank`` of the others is null.

    A null text has no features, and weight 0. A null ``doc_id`` counts as empty in
    the noise and comes last among ties; rows that repeat a ``doc_id`` share its
    noise and are ranked each. An empty target draws as its added counts say; without
    documents there is no row.
    """
    gains = bucket_gains(_dense(bucket_counts(docs, buckets=buckets), buckets), _dense(bucket_counts(target, buckets=buckets), buckets))
    weighed = weights(docs, gains)
    scored = written(weighed.withColumn("score", F.col("weight") + noise("doc_id", seed)), "scored")
    return ranked(scored, share, least_words)


def resampled(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The documents that ``resample`` draws, all columns, without order.

    ``doc_id`` must tell documents apart; of rows that share one, all come as soon
    as one is drawn. Rows without ``doc_id`` are never drawn.
    """
    plain = guarded(docs, ("doc_id", "text"))
    drawn = resample(docs, target, **options).filter("rank is not null").select("doc_id").distinct()
    return restored(plain.join(drawn, "doc_id", "left_semi"), docs, ("doc_id", "text"))
