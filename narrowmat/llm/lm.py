"""Language-model scores: smoothed word counts, and online logistic mixing.

The model predicts a text bit by bit. Each byte (upper case folded) is a path in a
binary code; at each node three predictors give the chance of a one, from counts
of the training texts under a hashed context: the last two bytes, the last
four, and the word so far. Their log odds are mixed with weights gated by the
depth in the code, and the weights follow the prediction error after each byte,
from the first byte of a text to its last. As weights are gated by depth, the
bits of one depth of one text are a stream that no other stream sees: some
thousand texts of similar length are scored side by side, all their streams a bit
at a time; the few longest, once alone, stream by stream.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, functions as F

from narrowmat.llm.common import WordHasher, binary_column, crc_mod, most_frequent, numbers, only, text_buffers, written

FREQUENT = 1 << 18
SMOOTH = 0.1
CONTEXTS = (1 << 13, 1 << 14, 1 << 14)
SYMBOLS = 256
END = 65  # "A" cannot occur once upper case is folded
SCORED = 1 << 16
LANES = 1024  # texts side by side
TOP = 4  # depths whose log odds are kept together for a context
RUN_BYTES = 1 << 20  # of text at a time for words
CONTEXT_RUN = 1 << 18  # symbols at a time for contexts
SIDE_BY_SIDE = 1 << 24  # bytes of text whose texts are sorted by length together
FEW = 8
GATES = 32
RATE = 0.02
START = 0.45
SLICE = 1 << 16
_BASE = [0, CONTEXTS[0] * SYMBOLS, (CONTEXTS[0] + CONTEXTS[1]) * SYMBOLS]
CELLS = sum(CONTEXTS) * SYMBOLS

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, each closed by END, and where each begins (and the end)."""
    starts = offsets + np.arange(len(offsets))
    out = np.full(starts[-1], END, dtype=np.uint8)
    body = np.ones(len(out), dtype=bool)
    body[starts[1:] - 1] = False
    out[body] = _LOWER[data]
    return out, starts


def _contexts(sym: np.ndarray, starts: np.ndarray, hasher: WordHasher) -> list[np.ndarray]:
    """For every symbol its context under each predictor; texts do not see one another."""
    found, at = [np.empty(len(sym), dtype=np.int32) for _ in CONTEXTS], 0
    while at < len(starts) - 1:
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + CONTEXT_RUN, "right")) - 1)
        own = slice(starts[at], starts[to])
        for all_of_them, part in zip(found, _contexts_of_run(sym[own], starts[at : to + 1] - starts[at], hasher)):
            all_of_them[own] = part
        at = to
    return found


def _contexts_of_run(sym, starts, hasher):
    n = len(sym)
    past, found = np.zeros(n, dtype=np.uint32), []
    with np.errstate(over="ignore"):
        for k in range(1, 5):
            shifted = np.full(n, END, dtype=np.uint32)
            shifted[k:] = sym[: max(n - k, 0)]
            for j in range(k):  # what lies before a text
                at = starts[:-1] + j
                shifted[at[at < starts[1:]]] = END
            past |= shifted << np.uint32(8 * (k - 1))
            if k in (2, 4):
                spread = (past ^ (past >> np.uint32(15))) * np.uint32(0x9E3779B1)
                found.append((spread >> np.uint32(33 - CONTEXTS[len(found)].bit_length())).astype(np.int32))
        # The word so far: a running hash from the last blank or the text's start.
        new = np.zeros(n, dtype=bool)
        new[1:] = hasher.blank[sym[:-1]]
        new[starts[:-1]] = True
        begins = np.flatnonzero(new)
        first = np.repeat(begins, np.diff(begins, append=n))
        hasher._grow(n + 1)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(hasher.value[sym] * hasher.up[:n], out=total[1:])
        word = (total[:-1] - total[first]) * hasher.down[first]
        word = (word ^ (word >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    found.append((word >> np.uint64(65 - CONTEXTS[2].bit_length())).astype(np.int32))
    return found


class Code:
    """A Huffman code over the symbols: for each its nodes and bits."""

    def __init__(self, counts: np.ndarray):
        heap = [(int(c) + 1, k, (k,)) for k, c in enumerate(counts)]
        heapq.heapify(heap)
        nodes = []
        while len(heap) > 1:
            zero, one = heapq.heappop(heap), heapq.heappop(heap)
            nodes.append((zero[2], one[2]))
            heapq.heappush(heap, (zero[0] + one[0], SYMBOLS + len(nodes), zero[2] + one[2]))
        path = [[] for _ in range(SYMBOLS)]
        self.zero, self.one = np.zeros((SYMBOLS, SYMBOLS)), np.zeros((SYMBOLS, SYMBOLS))
        for number, (zero, one) in reversed(list(enumerate(nodes))):
            for bit, side in ((0, zero), (1, one)):
                for s in side:
                    path[s].append((number, bit))
                (self.one if bit else self.zero)[list(side), number] = 1
        self.length = np.array([len(p) for p in path])
        self.first = np.cumsum(self.length) - self.length
        self.node = np.array([x for p in path for x, _ in p], dtype=np.intp)
        self.bit = np.array([b for p in path for _, b in p], dtype=np.int8)
        self.left = np.array([len(p) - k for p in path for k in range(len(p))], dtype=np.intp)  # bits from here on
        # Symbols that share their first nodes share what a context says of them.
        tops = [tuple(x for x, _ in p[:TOP]) for p in path]
        shared = {nodes: k for k, nodes in enumerate(sorted(set(tops)))}
        self.top = np.array([shared[nodes] for nodes in tops], dtype=np.intp)
        self.top_node = np.array([nodes + (0,) * (TOP - len(nodes)) for nodes in shared], dtype=np.intp)
        self.top_bit = np.array([[b for _, b in p[:TOP]] + [0] * (TOP - len(p)) for p in path], dtype=np.int8)


def odds(counts: np.ndarray, code: Code) -> np.ndarray:
    """Counts of symbols by context to log odds of a one at each node, in sixteenths."""
    table = counts.reshape(-1, SYMBOLS).astype(np.float64)
    one, zero = table @ code.one, table @ code.zero
    return np.clip(np.rint(16 * np.log((one + 0.4) / (zero + 0.4))), -127, 127).astype(np.int8).reshape(-1)


def log_probability(sym, starts, tables: np.ndarray, code: Code, hasher: WordHasher) -> np.ndarray:
    """Natural logarithm of the probability of each text."""
    contexts = [x.astype(np.uint16) for x in _contexts(sym, starts, hasher)]
    return mixed(sym, starts, contexts, tables, code)


def mixed(sym, starts, contexts, tables: np.ndarray, code: Code) -> np.ndarray:
    """The same from the contexts of every symbol, for ``LANES`` texts of similar
    length at a time."""
    sizes = np.diff(starts)
    order = np.argsort(-sizes, kind="stable")
    top = tables.reshape(-1, SYMBOLS).take(code.top_node, axis=1).view(np.uint32).reshape(-1)
    out = np.empty(len(order))
    for k in range(0, len(order), LANES):
        own = order[k : k + LANES]
        out[own] = _together(sym, starts[own], sizes[own], contexts, tables, top, code)
    return out


def _together(sym, begin, sizes, contexts, tables, top, code):
    """``mixed`` for texts given longest first; symbols are picked from them in
    pieces of about ``SCORED``."""
    steps, n = int(sizes[0]), len(sizes)
    active = np.searchsorted(-sizes, -np.arange(steps), "left")  # texts longer than t
    base = np.concatenate([[0], np.cumsum(active)])
    weights = np.full((3, min(int(code.length.max()), GATES), n), START / math.sqrt(RATE), dtype=np.float32)
    cost = np.zeros(n)
    few = int(np.searchsorted(-active, -FEW, "left"))  # from here on, FEW texts or less
    t = 0
    while t < steps:
        to = max(t + 1, int(np.searchsorted(base, base[t] + SCORED, "right")) - 1)
        to = min(to, few if t < few else steps)
        m = int(active[t])
        own = np.minimum(sizes[:m], to) - t
        at = np.repeat(begin[:m] + t + own - np.cumsum(own), own)
        at += np.arange(len(at))
        lengths, bits = _bits(sym[at], [x[at] for x in contexts], own, tables, top, code)
        run = _side_by_side if t < few else _one_by_one
        held = weights[:, :, :m].reshape(3, -1)
        logs = run(lengths, bits, held)
        weights[:, :, :m] = held.reshape(3, -1, m)
        cost[:m] += logs.reshape(-1, m).sum(axis=0)
        t = to
    return cost


def _bits(s, rows, own, tables, top, code):
    """Bits of the symbols, ``own`` of each text, stream by stream: all of the first
    depth, text after text, then all of the next. Returns how many each stream has
    and, four bytes a bit, its log odds under each predictor and its value."""
    n_bits, deepest = code.length.take(s), int(code.length.max())
    kinds = np.repeat(np.arange(len(own)) * (deepest + 1), own)
    kinds += n_bits
    kinds = np.bincount(kinds, minlength=len(own) * (deepest + 1)).reshape(len(own), -1)
    deeper = kinds[:, :0:-1].cumsum(axis=1)[:, ::-1].T  # symbols with a bit of that depth
    lengths = deeper[:GATES].copy()
    lengths[-1] += deeper[GATES:].sum(axis=0)
    per_gate = lengths.sum(axis=1).tolist()
    bits, done = np.empty((sum(per_gate), 4), dtype=np.int8), 0
    cells = code.top.take(s)
    found = [top.take(cells + (x.astype(np.intp) + k // SYMBOLS) * len(code.top_node)) for x, k in zip(rows, _BASE)]
    found = [x.view(np.int8).reshape(-1, TOP) for x in found] + [code.top_bit.view(np.uint32).reshape(-1).take(s).view(np.int8).reshape(-1, TOP)]
    for gate in range(min(TOP, len(lengths))):
        part = bits[done : done + per_gate[gate]]
        here = slice(None) if len(part) == len(s) else np.flatnonzero(n_bits > gate)
        for k in range(4):
            part[:, k] = found[k][here, gate]
        done += len(part)
    deep = np.flatnonzero(n_bits > TOP)
    path = code.first.take(s[deep]) + TOP
    cells = [x[deep].astype(np.intp) * SYMBOLS + k for x, k in zip(rows, _BASE)]
    for gate in range(TOP, len(lengths)):
        left = code.left.take(path)
        if gate == GATES - 1:  # all bits from here on
            cells = [np.repeat(x, left) for x in cells]
            path = np.repeat(path + left - np.cumsum(left), left) + np.arange(per_gate[gate])
        part, node = bits[done : done + len(path)], code.node.take(path)
        for k in range(3):
            part[:, k] = tables.take(cells[k] + node)
        part[:, 3] = code.bit.take(path)
        done += len(part)
        on = np.flatnonzero(left > 1) if gate < GATES - 1 else []
        path, cells = path[on] + 1, [x[on] for x in cells]
    return lengths.reshape(-1), bits.view(np.uint32).reshape(-1)


def _inputs(bits):
    """Under each predictor the log odds of a zero, times the root of RATE; values."""
    parts, scale = bits.view(np.int8).reshape(-1, 4), np.float32(-math.sqrt(RATE) / 16)
    inputs = np.empty((3, len(bits)), dtype=np.float32)
    for k in range(3):
        np.multiply(parts[:, k], scale, out=inputs[k], dtype=np.float32)
    return inputs, parts[:, 3].astype(np.float32)


def _logs(ones, bit):
    """Logarithm of the chance given to each bit from that of a one, in place."""
    np.clip(ones, 1e-4, 1 - 1e-4, out=ones)
    ones -= 1
    ones += bit
    np.abs(ones, out=ones)
    return np.log(ones, out=ones)


def _side_by_side(lengths, bits, weights):
    """Logarithm of the probability of each stream. Streams go longest first and
    bits by their place in the stream, so every step, one bit of each stream, works
    on consecutive weights and bits. Weights follow after each step; they and the
    inputs are scaled so that RATE needs no step of its own."""
    steps = int(lengths.max())
    order = np.argsort((steps - lengths).astype(np.uint16 if steps < 1 << 16 else np.int64), kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    cuts = np.concatenate([[0], np.cumsum(len(lengths) - np.cumsum(np.bincount(lengths))[:-1])])
    place = np.repeat(lengths - np.cumsum(lengths), lengths)
    place += np.arange(len(bits))
    place = cuts.take(place)
    place += np.repeat(rank, lengths)
    laid = np.empty_like(bits)
    laid[place] = bits
    del place
    inputs, bit = _inputs(laid)
    order = order[: cuts[1]]
    held = weights[:, order]
    ones, gap, room = np.empty(len(bits), dtype=np.float32), np.empty(len(order), dtype=np.float32), np.empty_like(held)
    add, exp, multiply, reciprocal, subtract, one = np.add, np.exp, np.multiply, np.reciprocal, np.subtract, np.float32(1)
    cuts = cuts.tolist()
    for a, b in zip(cuts[:-1], cuts[1:]):
        own, x, p, g, step = held[:, : b - a], inputs[:, a:b], ones[a:b], gap[: b - a], room[:, : b - a]
        multiply(own, x, step)
        add(step[0], step[1], p)
        add(p, step[2], p)
        exp(p, p)
        add(p, one, p)
        reciprocal(p, p)
        subtract(p, bit[a:b], g)
        multiply(x, g, step)
        add(own, step, own)
    weights[:, order] = held
    _logs(ones, bit)
    sums, out = np.zeros(len(order)), np.zeros(len(lengths))
    for a, b in zip(cuts[:-1], cuts[1:]):
        sums[: b - a] += ones[a:b]
    out[order] = sums
    return out


def _one_by_one(lengths, bits, weights):
    """The same for so few texts that a step of arrays costs more than its bits."""
    inputs, bit = _inputs(bits)
    ones, exp, ends = [], math.exp, np.cumsum(lengths)
    for k in np.flatnonzero(lengths):
        a, b, c = weights[:, k].tolist()
        own = slice(ends[k] - lengths[k], ends[k])
        for one, x, y, z in zip(bit[own].tolist(), *inputs[:, own].tolist()):
            p = 1 / (1 + exp(a * x + b * y + c * z))
            ones.append(p)
            gap = p - one
            a += gap * x
            b += gap * y
            c += gap * z
        weights[:, k] = a, b, c
    logs = _logs(np.array(ones, dtype=np.float32), bit)
    out = np.zeros(len(lengths))
    out[lengths > 0] = np.add.reduceat(logs, (ends - lengths)[lengths > 0], dtype=np.float64)
    return out


def _gather(batches):
    """Counts of words (kind 0) and, in slices, of symbols by context (kind 1)."""
    hasher = WordHasher()
    cells, any_rows = np.zeros(CELLS, dtype=np.uint32), False
    n_docs = 0
    for batch in batches:
        for lo, hi, data, offsets in text_buffers(batch.column("text"), 2 * RUN_BYTES):
            words = hasher.words(data, offsets)[0]
            found, n = np.unique(words, return_counts=True)
            yield _rows(np.zeros(len(found), np.int32), found.view(np.int64), n, None)
            sym, starts = _symbols(data, offsets)
            for k, context in enumerate(_contexts(sym, starts, hasher)):
                np.add.at(cells, context * np.intp(SYMBOLS) + sym + _BASE[k], np.uint32(1))
            any_rows, n_docs = True, n_docs + hi - lo
    if any_rows:
        yield _rows(np.array([2], np.int32), np.array([0]), np.array([n_docs]), None)
        for k in range(0, CELLS, SLICE):
            part = cells[k : k + SLICE]
            if part.any():
                used = np.flatnonzero(part)
                packed = np.concatenate([used.astype(np.uint32), part[used]]).tobytes()
                yield _rows(np.array([1], np.int32), np.array([k // SLICE]), np.array([len(used)]), [packed])


def _rows(kind, key, n, data):
    data = pa.nulls(len(kind), pa.binary()) if data is None else pa.array(data, pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(key, pa.int64()), pa.array(n, pa.int64()), data], names=["kind", "key", "n", "data"])


def _add_slices(batches):
    held = {}
    for batch in batches:
        for key, data in zip(batch.column("key").to_pylist(), batch.column("data").to_pylist()):
            pair = np.frombuffer(data, dtype=np.uint32).reshape(2, -1)
            total = held.setdefault(key, np.zeros(SLICE, dtype=np.int64))
            total[pair[0]] += pair[1]
    for key, total in held.items():
        yield _rows(np.array([1], np.int32), np.array([key]), np.array([0]), [total.astype(np.float32).tobytes()])


def score(docs: DataFrame, folds: int = 10, held: int = 0, frequent: int = FREQUENT) -> DataFrame:
    """For every row of ``docs`` (``doc_id, text``): ``doc_id, held_out, n_tokens,
    n_known, train_tokens, base_score, score, bits_per_byte``.

    Learns from the rows whose crc32(doc_id) mod ``folds`` is not ``held``; rows
    without doc_id are scored only. A null text counts as empty: its end is its
    only token. The ``frequent`` most frequent words (a fixed number) are
    broadcast with their counts; all others are joined, so every count is used
    exactly. Words are told apart by 64-bit hashes. An empty table gives an empty
    result; with nothing to learn from, every word is unknown and every bit even.
    """
    spark = docs.sparkSession
    texts = only(docs, "doc_id", "text")
    train = texts.filter(crc_mod("doc_id", folds) != held).select("text")
    gathered = written(train.mapInArrow(_gather, "kind int, key long, n long, data binary"), "gathered")
    counts = written(gathered.filter("kind = 0").groupBy("key").agg(F.sum("n").alias("c")), "counts")
    n_train = gathered.filter("kind = 2").agg(F.sum("n")).first()[0] or 0
    sums = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n_all, vocabulary = (sums.n or 0) + n_train, sums.v + (n_train > 0)
    slices = gathered.filter("kind = 1").select("key", "data").repartition("key").mapInArrow(_add_slices, "kind int, key long, n long, data binary")
    cells = np.zeros(CELLS, dtype=np.float32)
    for r in slices.select("key", "data").collect():
        cells[r.key * SLICE : (r.key + 1) * SLICE] = np.frombuffer(r.data, dtype=np.float32)
    code = Code(cells[: _BASE[1]].reshape(-1, SYMBOLS).sum(axis=0))
    tables = np.concatenate([odds(cells[a : a + c * SYMBOLS], code) for a, c in zip(_BASE, CONTEXTS)])
    del cells
    known = most_frequent(counts, "c", frequent).select("key", "c").toPandas().sort_values("key")
    top = spark.sparkContext.broadcast((known["key"].to_numpy(np.int64), known["c"].to_numpy(np.int64), tables, cloudpickle.dumps(code)))
    under = math.log10(n_all + SMOOTH * (vocabulary + 1)) if n_all + vocabulary else math.log10(SMOOTH)
    end_base = math.log10(n_train + SMOOTH) - under

    def run(batches):
        hasher = WordHasher()
        keys, c, tables, code = top.value
        code = cloudpickle.loads(code)  # with its class: executors need no copy of this package
        row = TaskContext.get().partitionId() << 33

        def together(parts):
            """Mix the texts of all parts side by side; one batch for each part."""
            shift = np.cumsum([0] + [p[1][-1] for p in parts])
            sym = np.concatenate([p[0] for p in parts])
            starts = np.concatenate([p[1][:-1] + k for p, k in zip(parts, shift)] + [shift[-1:]])
            contexts = [np.concatenate(x) for x in zip(*(p[2] for p in parts))]
            logs = mixed(sym, starts, contexts, tables, code) / math.log(10)
            bits = -logs * math.log2(10) / np.diff(starts)
            at = 0
            for *_, columns in parts:
                to = at + len(columns[0])
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(logs[at:to]), pa.array(bits[at:to])],
                    names=["row", "doc_id", "n_tokens", "known", "base", "rare", "score", "bits_per_byte"],
                )
                at = to

        for batch in batches:
            parts, size = [], 0
            for lo, hi, data, offsets in text_buffers(batch.column("text"), RUN_BYTES):
                words, _, _, at = hasher.words(data, offsets)
                sizes = np.diff(at)
                owner = np.repeat(np.arange(hi - lo), sizes)
                mine = words.view(np.int64)
                place = np.minimum(np.searchsorted(keys, mine), max(len(keys) - 1, 0))
                hit = keys[place] == mine if len(keys) else np.zeros(len(mine), bool)
                each = np.zeros(len(mine))
                if len(keys):
                    each[hit] = np.log10(c[place[hit]] + SMOOTH) - under
                base = np.bincount(owner, each, minlength=hi - lo) + end_base
                seen = np.bincount(owner[hit], minlength=hi - lo) + (n_train > 0)
                rest = np.flatnonzero(~hit)
                rare = binary_column(mine[rest], np.bincount(owner[rest], minlength=hi - lo))
                sym, starts = _symbols(data, offsets)
                contexts = [x.astype(np.uint16) for x in _contexts(sym, starts, hasher)]
                ids = batch.column("doc_id").slice(lo, hi - lo)
                columns = [pa.array(row + np.arange(hi - lo)), ids, pa.array(sizes + 1), pa.array(seen.astype(np.int64)), pa.array(base), rare]
                parts.append((sym, starts, contexts, columns))
                row, size = row + hi - lo, size + len(data)
                if size >= SIDE_BY_SIDE:
                    yield from together(parts)
                    parts, size = [], 0
            if parts:
                yield from together(parts)

    kind = dict(docs.dtypes)["doc_id"]
    scored = written(texts.mapInArrow(run, f"row long, doc_id {kind}, n_tokens long, known long, base double, rare binary, score double, bits_per_byte double"), "scored")

    def spread(batches):
        for batch in batches:
            words, n = numbers(batch.column("rare"), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("row").to_numpy(), n)), pa.array(words)], names=["row", "key"])

    rare = scored.filter(F.length("rare") > 0).select("row", "rare").mapInArrow(spread, "row long, key long")
    rare = rare.groupBy("row", "key").agg(F.count("*").alias("m"))
    c = F.coalesce("c", F.lit(0))
    value = F.col("m") * (F.log10(c + F.lit(SMOOTH)) - F.lit(under))
    added = rare.join(counts, "key", "left").groupBy("row").agg(
        F.sum(value).alias("more"), F.sum(F.when(c > 0, F.col("m")).otherwise(0)).alias("more_known")
    )
    zero = lambda name: F.coalesce(name, F.lit(0))
    return scored.join(added, "row", "left").select(
        "doc_id", F.coalesce(crc_mod("doc_id", folds) == held, F.lit(False)).alias("held_out"), "n_tokens",
        (F.col("known") + zero("more_known")).cast("long").alias("n_known"), F.lit(int(n_all)).cast("long").alias("train_tokens"),
        (F.col("base") + zero("more")).alias("base_score"), "score", "bits_per_byte",
    )
