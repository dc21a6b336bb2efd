"""MinHash near-duplicates by a signature-coordinate inverted join.

1. Every text becomes the set of its 5-word shingles (64-bit hashes) and a
   signature of ``COORDINATES`` minima. Texts with equal sets form a class; only
   classes go on, so exact copies never meet each other.
2. Each class is posted under its coordinate-value pairs. A pair of classes
   counts as candidate if it agrees in at least ``matches`` coordinates. With all
   pairs in one global order, rarest first, two such classes share one of their
   first ``COORDINATES - matches + 1``: only that prefix is posted, and pairs
   that occur once are dropped beforehand.
3. Short lists are compared pair by pair in place; of long lists only pairs
   with the list's first member come out. Matches are counted on whole
   signatures, skipping a pair as soon as the coordinates left cannot reach the
   threshold.
4. Candidates are confirmed on full sets, and components are found.
5. Long lists that still hold several components are compared exactly, in
   blocks of full sets: members outside the largest component of the list visit
   every block. So no link between different texts is lost to a long list.

At a similarity of ``percent`` a coordinate agrees with that probability; the
matches asked for are the most that keep the chance to miss a link within
``MISS``: 16 of 32 at 85 percent (5e-7), 14 at 80 (1e-6).
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from narrowmat.llm.common import WordHasher, binary_column, discard, guarded, mix, numbers, only, restored, text_buffers, written
from narrowmat.llm.components import components

SHINGLE = 5
COORDINATES = 32
PERCENT = 85
MISS = 2e-6
SHORT = 32
BLOCK = 1000
RUN_BYTES = 1 << 20  # of text at a time; several arrays have 8 bytes for each of them

SIGNED = "doc_id long, own string, n_shingles long, set_a long, set_b long, sig binary"
_SEEDS = np.random.default_rng(5).integers(1, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def matches(percent: int) -> int:
    """The most agreements of ``COORDINATES`` that a pair of ``percent`` similarity
    reaches but for a chance of ``MISS``."""
    p, missed, k = percent / 100, 0.0, 0
    while True:
        missed += math.comb(COORDINATES, k) * p**k * (1 - p) ** (COORDINATES - k)
        if missed > MISS:
            return max(k, 1)
        k += 1


def _shingles(hasher: WordHasher, data, offsets, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, ascending within it, and where each text's begin."""
    words, _, _, at = hasher.words(data, offsets)
    n_docs, n_words = len(offsets) - 1, np.diff(at)
    with np.errstate(over="ignore"):
        factor = np.uint64(0xD6E8FEB86659FD93)
        n = max(len(words) - width + 1, 0)
        rolled = np.zeros(n, dtype=np.uint64)
        for k in range(width):
            rolled = rolled * factor + words[k : k + n]
        rolled = mix(rolled)
        doc = np.repeat(np.arange(n_docs), n_words)
        inside = doc[:n] == doc[width - 1 :] if n else np.zeros(0, bool)
        keys, owner = rolled[inside], doc[:n][inside]
        few = np.flatnonzero((n_words > 0) & (n_words < width))
        short = np.zeros(len(few), dtype=np.uint64)
        for j, d in enumerate(few):
            for w in words[at[d] : at[d + 1]]:
                short[j] = short[j] * factor + w
            short[j] = mix(short[j : j + 1] + np.uint64(n_words[d]))[0]
    keys, owner = np.concatenate([keys, short]), np.concatenate([owner, few])
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    keys, owner = keys[new], owner[new]
    return keys, np.searchsorted(owner, np.arange(n_docs + 1))


def _signatures(keys: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(texts, COORDINATES) minima of 32 bits; every text has shingles."""
    out = np.empty((len(starts), COORDINATES), dtype=np.uint32)
    with np.errstate(over="ignore"):
        for k, seed in enumerate(_SEEDS):
            hashed = (((keys ^ (seed >> np.uint64(7))) * seed) >> np.uint64(32)).astype(np.uint32)
            out[:, k] = np.minimum.reduceat(hashed, starts)
    return out


def _prints(keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set: equal sets have equal sums."""
    full = np.flatnonzero(np.diff(at))
    out = np.zeros((2, len(at) - 1), np.uint64)
    if len(full):
        starts = at[full]
        with np.errstate(over="ignore"):
            out[0, full] = np.add.reduceat(mix(keys + np.uint64(1)), starts)
            out[1, full] = np.add.reduceat(mix(keys ^ np.uint64(0x5BD1E995F1234567)), starts)
    return out[0].view(np.int64), out[1].view(np.int64)


def _sign(batches):
    hasher = WordHasher()
    for batch in batches:
        ids, own = batch.column("doc_id"), batch.column("own")
        for lo, hi, data, offsets in text_buffers(batch.column("text"), RUN_BYTES):
            keys, at = _shingles(hasher, data, offsets)
            size = np.diff(at)
            a, b = _prints(keys, at)
            sig = np.zeros((hi - lo, COORDINATES), np.uint32)
            if size.any():
                sig[size > 0] = _signatures(keys, at[:-1][size > 0])
            packed = binary_column(sig.reshape(-1), np.full(hi - lo, COORDINATES))
            yield pa.RecordBatch.from_arrays(
                [ids.slice(lo, hi - lo), own.slice(lo, hi - lo), pa.array(size.astype(np.int64)), pa.array(a), pa.array(b), packed],
                names=["doc_id", "own", "n_shingles", "set_a", "set_b", "sig"],
            )


def _sets(batches):
    """Full sets of the texts whose set is the one asked for."""
    hasher = WordHasher()
    for batch in batches:
        cls, want_a, want_b = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cls", "set_a", "set_b"))
        for lo, hi, data, offsets in text_buffers(batch.column("text"), RUN_BYTES):
            keys, at = _shingles(hasher, data, offsets)
            a, b = _prints(keys, at)
            good = np.flatnonzero((a == want_a[lo:hi]) & (b == want_b[lo:hi]) & (np.diff(at) > 0))
            pieces = [keys[at[d] : at[d + 1]].tobytes() for d in good]
            yield pa.RecordBatch.from_arrays([pa.array(cls[lo:hi][good]), pa.array(pieces, pa.binary())], names=["cls", "keys"])


def _nameless_sets(batches):
    hasher = WordHasher()
    for batch in batches:
        for lo, hi, data, offsets in text_buffers(batch.column("text"), RUN_BYTES):
            keys, at = _shingles(hasher, data, offsets)
            a, b = _prints(keys, at)
            full = np.flatnonzero(np.diff(at))
            pieces = [keys[at[d] : at[d + 1]].tobytes() for d in full]
            yield pa.RecordBatch.from_arrays([pa.array(a[full]), pa.array(b[full]), pa.array(pieces, pa.binary())], names=["set_a", "set_b", "keys"])


def _matches(one: np.ndarray, others: np.ndarray, least: int) -> np.ndarray:
    """Which rows of ``others`` agree with ``one`` in ``least`` coordinates or
    more. Counted piece by piece; rows that cannot reach it are skipped."""
    left = np.arange(len(others))
    count = np.zeros(len(others), dtype=np.int16)
    for lo in range(0, COORDINATES, 8):
        count[left] += (others[left, lo : lo + 8] == one[lo : lo + 8]).sum(axis=1, dtype=np.int16)
        rest = COORDINATES - lo - 8
        left = left[count[left] + rest >= least]
    return left


def _pairs_of(cls, n, sig, percent, least):
    found_a, found_b = [], []
    for k in range(len(cls) - 1):
        hit = k + 1 + _matches(sig[k], sig[k + 1 :], least)
        hit = hit[np.minimum(n[hit], n[k]) * 100 >= percent * np.maximum(n[hit], n[k])]
        found_a.append(np.full(len(hit), cls[k]))
        found_b.append(cls[hit])
    return found_a, found_b


def _short_lists(percent, batches):
    """Candidates of short posting lists, sorted by list: ``list, cls, n, sig``."""
    held, least = None, matches(percent)

    def emit(parts, bounds):
        a, b = [], []
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            x, y = _pairs_of(parts[1][lo:hi], parts[2][lo:hi], parts[3][lo:hi], percent, least)
            a, b = a + x, b + y
        none = [np.zeros(0, np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a or none), pa.int64()), pa.array(np.concatenate(b or none), pa.int64())], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        sig = numbers(batch.column("sig"), np.uint32)[0].reshape(-1, COORDINATES)
        now = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("list", "cls", "n")] + [sig]
        if held is not None:
            now = [np.concatenate([x, y]) for x, y in zip(held, now)]
        edge = np.flatnonzero(now[0][1:] != now[0][:-1]) + 1
        bounds = np.concatenate([[0], edge])
        yield emit(now, bounds)
        held = [x[bounds[-1] :] for x in now]
    if held is not None:
        yield emit(held, [0, len(held[0])])


def _with_pivot(percent, batches):
    """Of a long list's members beside its pivot, those similar enough to it."""
    least = matches(percent)
    for batch in batches:
        x = numbers(batch.column("sig"), np.uint32)[0].reshape(-1, COORDINATES)
        y = numbers(batch.column("pivot_sig"), np.uint32)[0].reshape(-1, COORDINATES)
        keep = pa.array((x == y).sum(axis=1) >= least)
        yield pa.RecordBatch.from_arrays([batch.column("pivot").filter(keep), batch.column("cls").filter(keep)], names=["a", "b"])


def _confirm(percent, batches):
    """Pairs whose full sets are similar enough."""
    for batch in batches:
        a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
        x, nx = numbers(batch.column("keys_a"), np.uint64)
        y, ny = numbers(batch.column("keys_b"), np.uint64)
        px, py = np.concatenate([[0], np.cumsum(nx)]), np.concatenate([[0], np.cumsum(ny)])
        keep = []
        for k in range(len(a)):
            s, t = x[px[k] : px[k + 1]], y[py[k] : py[k + 1]]
            if min(len(s), len(t)) * 100 < percent * max(len(s), len(t)):
                continue
            both = np.concatenate([s, t])
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            if common * 100 >= percent * (len(both) - common):
                keep.append(k)
        yield pa.RecordBatch.from_arrays([pa.array([a[k] for k in keep], pa.int64()), pa.array([b[k] for k in keep], pa.int64())], names=["a", "b"])


class _Block:
    """Members of one block of a long list, and the links of visitors to them."""

    def __init__(self, cls, root, keys, sizes, percent):
        self.cls, self.root, self.size = np.array(cls), np.array(root), np.array(sizes)
        self.percent = percent
        owner = np.repeat(np.arange(len(cls)), sizes)
        order = np.argsort(keys, kind="stable")
        self.keys, self.owner = keys[order], owner[order]

    def links(self, cls, root, keys):
        """One member of each other component that the visitor is linked with."""
        lo, hi = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        n = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        common = np.bincount(self.owner[at], minlength=len(self.cls))
        linked = common * 100 >= self.percent * (self.size + len(keys) - common)
        hit = np.flatnonzero(linked & (self.root != root) & (self.cls != cls))
        return self.cls[hit[np.unique(self.root[hit], return_index=True)[1]]]


def _rooted(frame: DataFrame, comps: DataFrame) -> DataFrame:
    return frame.join(comps, F.col("cls") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cls")).drop("node")


def _block_stream(percent, batches):
    """Blocks one after another from rows sorted by list, block, visit."""
    at, block, held = None, None, None
    for batch in batches:
        lists, blocks = batch.column("list").to_pylist(), batch.column("block").to_pylist()
        visits, cls, root = (batch.column(c).to_pylist() for c in ("visit", "cls", "root"))
        keys, sizes = numbers(batch.column("keys"), np.uint64)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        out_a, out_b = [], []
        for k in range(len(lists)):
            if (lists[k], blocks[k]) != at:
                at, block, held = (lists[k], blocks[k]), None, [[], [], [], []]
            own = keys[ends[k] : ends[k + 1]]
            if not visits[k]:
                for part, x in zip(held, (cls[k], root[k], own, len(own))):
                    part.append(x)
            elif held[0]:
                block = block or _Block(held[0], held[1], np.concatenate(held[2]), held[3], percent)
                hit = block.links(cls[k], root[k], own)
                out_a += [cls[k]] * len(hit)
                out_b += hit.tolist()
        yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])


def near_duplicates(docs: DataFrame, short: int = SHORT, block: int = BLOCK, percent: int = PERCENT) -> DataFrame:
    """For every row of ``docs`` (``doc_id, text``): ``doc_id, n_shingles,
    component_id, kept``. Texts are linked from a similarity of ``percent`` on.

    Null and empty texts, and texts of blanks, have no shingle and are linked
    with nothing: they are kept. A row without doc_id takes part by its text;
    in a component without any doc_id, component_id is null and rows are kept.
    Rows that repeat a doc_id each follow their own text. An empty table gives
    an empty result; other columns are not looked at.
    """
    return _decided(docs, short, block, percent, F.lit(None)).select("doc_id", "n_shingles", "component_id", "kept")


def _decided(docs: DataFrame, short: int, block: int, percent: int, own) -> DataFrame:
    """``near_duplicates`` with ``own``, which tells texts apart, and ``root``, the
    component (null where there is no shingle)."""
    texts = only(docs, "doc_id", "text")
    rows = written(texts.withColumn("own", own.cast("string")).mapInArrow(_sign, SIGNED), "signed")
    full = rows.filter("n_shingles > 0")
    classes = full.groupBy("set_a", "set_b").agg(
        F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig")
    )
    classes = written(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    pieces = F.transform(
        F.sequence(F.lit(0), F.lit(COORDINATES - 1)),
        lambda k: F.xxhash64(k, F.substring(F.col("sig"), k * 4 + 1, F.lit(4))),
    )
    # A set this small is not similar enough to itself and one shingle more.
    posted = classes.filter(f"n * {100 - percent} >= {percent}").select("cls", F.explode(pieces).alias("list"))
    often = posted.groupBy("list").agg(F.count("*").alias("size")).filter("size > 1")
    seen = posted.join(often, "list").groupBy("cls").agg(
        F.sort_array(F.collect_list(F.struct("size", "list"))).alias("all"), F.count("*").alias("shared")
    )
    # Coordinates that occur once are first in the order: they use up the prefix
    # but need no posting.
    first = F.col("shared") - (matches(percent) - 1)
    prefix = seen.filter(first > 0).select("cls", F.explode(F.slice("all", F.lit(1), first.cast("int"))).alias("p"))
    postings = written(
        prefix.join(classes, "cls").select(F.col("p.list").alias("list"), F.col("p.size").alias("size"), "cls", "n", "sig"), "postings"
    )
    brief = postings.filter(F.col("size") <= short).select("list", "cls", "n", "sig")
    brief = brief.repartition("list").sortWithinPartitions("list", "cls").mapInArrow(partial(_short_lists, percent), "a long, b long")
    long = postings.filter(F.col("size") > short)
    pivots = long.groupBy("list").agg(F.min(F.struct("cls", "n", "sig")).alias("p")).select(
        "list", F.col("p.cls").alias("pivot"), F.col("p.n").alias("pivot_n"), F.col("p.sig").alias("pivot_sig")
    )
    beside = long.join(pivots, "list").filter("cls != pivot").filter(
        F.least("n", "pivot_n") * 100 >= F.greatest("n", "pivot_n") * percent
    )
    starred = beside.select("cls", "sig", "pivot", "pivot_sig").mapInArrow(partial(_with_pivot, percent), "a long, b long")
    pairs = brief.unionAll(starred).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = written(pairs.distinct(), "pairs")

    def sets(wanted: DataFrame) -> DataFrame:
        """``cls, keys`` of the wanted classes, each from the text of one row."""
        chosen = classes.join(wanted, "cls", "left_semi").select("cls", "set_a", "set_b", "id")
        made = texts.join(chosen, F.col("doc_id") == F.col("id")).select("cls", "set_a", "set_b", "text")
        made = made.mapInArrow(_sets, "cls long, keys binary")
        bare = chosen.filter(F.col("id").isNull())
        if not bare.isEmpty():
            nameless = texts.filter(F.col("doc_id").isNull()).mapInArrow(_nameless_sets, "set_a long, set_b long, keys binary")
            made = made.unionAll(bare.join(nameless, ["set_a", "set_b"]).select("cls", "keys"))
        return made.dropDuplicates(["cls"])

    wanted = pairs.select(F.col("a").alias("cls")).unionAll(pairs.select(F.col("b").alias("cls"))).distinct()
    known = written(sets(wanted), "sets")
    joined = pairs.join(known.select(F.col("cls").alias("a"), F.col("keys").alias("keys_a")), "a").join(
        known.select(F.col("cls").alias("b"), F.col("keys").alias("keys_b")), "b"
    )
    edges = written(joined.select("a", "b", "keys_a", "keys_b").mapInArrow(partial(_confirm, percent), "a long, b long"), "links")
    comps = written(components(edges), "components")
    discard(known)

    marked = _rooted(long.select("list", "size", "cls"), comps)
    counts = marked.groupBy("list", "root").agg(F.count("*").alias("members"))
    tops = counts.groupBy("list").agg(F.max_by("root", F.struct("members", "root")).alias("major"), F.count("*").alias("roots"))
    open_lists = written(marked.join(tops.filter("roots > 1"), "list"), "open")
    if not open_lists.isEmpty():
        n_blocks = F.ceil(F.col("size") / block).cast("int")
        home = F.pmod(F.xxhash64("cls"), n_blocks).cast("int")
        here = open_lists.select("list", home.alias("block"), "cls", "root", F.lit(False).alias("visit"))
        visits = open_lists.filter("root != major").select(
            "list", F.explode(F.sequence(F.lit(0), n_blocks - 1)).alias("block"), "cls", "root", F.lit(True).alias("visit")
        )
        known = written(sets(open_lists.select("cls").distinct()), "sets2")
        meet = here.unionAll(visits).join(known, "cls").select("list", "block", "visit", "cls", "root", "keys")
        meet = meet.repartition("list", "block").sortWithinPartitions("list", "block", "visit")
        more = written(meet.mapInArrow(partial(_block_stream, percent), "a long, b long").distinct(), "links2")
        comps = written(components(edges.unionAll(more)), "components2")
        discard(known)

    whole = _rooted(classes.select("set_a", "set_b", "cls", "id"), comps)
    least = whole.groupBy("root").agg(F.min("id").alias("component_id"))
    whole = whole.join(least, "root").select("set_a", "set_b", "component_id", "root")
    linked = full.join(whole, ["set_a", "set_b"]).select("doc_id", "n_shingles", "component_id", "own", "root")
    lone = rows.filter("n_shingles = 0").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "own", F.lit(None).cast("long").alias("root")
    )
    return linked.unionAll(lone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay: one row of each component, with all columns,
    and all without a shingle. It is the one with the smallest doc_id, of several
    such the one with the smallest SHA-256; rows without doc_id come last."""
    sha = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    found = _decided(docs, SHORT, BLOCK, percent, sha).filter("root is not null")
    keys = written(found.groupBy("root", "doc_id", "own").agg(F.count("*").alias("n")), "keys")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("own"))
    first = keys.groupBy(F.col("root").alias("__root")).agg(F.min(order).alias("__first"))
    marks = keys.join(first, F.col("root") == F.col("__root")).select(
        F.col("doc_id").alias("__id"), F.col("own").alias("__sha"), (order.eqNullSafe(F.col("__first"))).alias("__stays"), "n"
    )
    # Rows that stay and are the only ones of their kind need no mark.
    marks = written(marks.filter("not __stays or n > 1").drop("n"), "marks")
    rows = guarded(docs, ("doc_id", "text")).withColumn("__own", sha)
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__sha"))
    stay = rows.join(marks, same, "left_anti")
    again = marks.filter("__stays")
    if not again.isEmpty():
        more = rows.join(again, same).dropDuplicates(["doc_id", "__own"])
        stay = stay.unionAll(more.select(*stay.columns))
    return restored(stay, docs, ("doc_id", "text"))
