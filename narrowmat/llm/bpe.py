"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

The most frequent words of the corpus are compiled into an automaton that shares
prefixes and suffixes; the numbers on its arcs add up to a word's place in a
table of ids. It is written to one file that executors map into memory. Words
that are not in it are merged exactly, by the ranks of the tokenizer.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, functions as F

from narrowmat.llm.common import most_frequent, only, scratch, written
from narrowmat.llm.pretokens import Cutter, byte_letters, classes, kept, lowered, parts, special_split

LEXICON_WORDS = 1 << 16
CACHE_WORDS = 1 << 17
END = "</w>"
SHORT_WORD = 48  # symbols; longer words go by a heap
BATCH_CHARS = 1 << 21


class Merger:
    """Exact merges of one word. Vocabulary, ranks and special tokens come from
    the tokenizer's file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab = spec["model"]["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.ranks = {p: k for k, p in enumerate(pairs)}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.letters = byte_letters()
        self.token = {v: k for k, v in self.vocab.items()} | {v: k for k, v in self.specials.items()}

    def pattern(self) -> re.Pattern:
        return re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) or "(?!)")

    def ids(self, word: str) -> list[int]:
        symbols = [self.letters[b] for b in word.encode()]
        symbols[-1] += END
        merged = self._short(symbols) if len(symbols) <= SHORT_WORD else self._long(symbols)
        return [self.vocab[s] for s in merged]

    def _short(self, symbols: list[str]) -> list[str]:
        """The pair of lowest rank, leftmost first, by looking through all ranks."""
        never, rank = len(self.ranks), self.ranks.get
        found = [rank(pair, never) for pair in zip(symbols, symbols[1:])]
        while found and (best := min(found)) < never:
            at = found.index(best)
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            del found[at]
            if at:
                found[at - 1] = rank((symbols[at - 1], symbols[at]), never)
            if at < len(found):
                found[at] = rank((symbols[at], symbols[at + 1]), never)
        return symbols

    def _long(self, symbols: list[str]) -> list[str]:
        """The same by a heap of pairs over linked symbols: a word of n symbols takes
        n log n steps. Pairs that a merge has changed since are passed over."""
        rank, n = self.ranks.get, len(symbols)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, k, symbols[k], symbols[k + 1]) for k in range(n - 1) if (r := rank((symbols[k], symbols[k + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, left, right = heapq.heappop(heap)
            other = after[k]
            if symbols[k] != left or other < 0 or symbols[other] != right:
                continue
            symbols[k], symbols[other] = left + right, ""
            after[k] = after[other]
            if after[k] >= 0:
                before[after[k]] = k
            for one in (before[k], k):
                two = after[one] if one >= 0 else -1
                if two >= 0 and (r := rank((symbols[one], symbols[two]))) is not None:
                    heapq.heappush(heap, (r, one, symbols[one], symbols[two]))
        return [s for s in symbols if s]


def compile_lexicon(entries: dict[bytes, list[int]]) -> np.ndarray:
    """Words and ids as one array: a header, arcs sorted by state and byte with
    target and number, then where each word's ids begin, then the ids.

    Words enter in order; states that can change no more are looked up among the
    finished ones, so equal suffixes are stored once.
    """
    words = sorted(entries)
    final, arcs, known, size = [False], [{}], {}, {}

    def finish(state: int) -> int:
        key = (final[state], tuple(arcs[state].items()))
        if key not in known:
            known[key] = state
            size[state] = final[state] + sum(size[t] for t in arcs[state].values())
        return known[key]

    path, last = [0], b""
    for word in words:
        same = 0
        while same < min(len(word), len(last)) and word[same] == last[same]:
            same += 1
        for depth in range(len(last), same, -1):
            arcs[path[depth - 1]][last[depth - 1]] = finish(path.pop())
        for byte in word[same:]:
            final.append(False)
            arcs.append({})
            arcs[path[-1]][byte] = len(final) - 1
            path.append(len(final) - 1)
        final[path[-1]] = True
        last = word
    for depth in range(len(last), 0, -1):
        arcs[path[depth - 1]][last[depth - 1]] = finish(path.pop())
    finish(0)

    number, rows, queue = {0: 0}, [], [0]
    for state in queue:
        passed = int(final[state])
        for byte, target in sorted(arcs[state].items()):
            if target not in number:
                number[target] = len(number)
                queue.append(target)
            rows.append((number[state] << 8 | byte, number[target] << 1 | final[target], passed))
            passed += size[target]
    rows.sort()
    ids = [entries[w] for w in words]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in ids])]) if ids else np.zeros(1)
    flat = np.array([i for x in ids for i in x], dtype=np.int64)
    table = np.array(rows, dtype=np.int64).reshape(-1, 3)
    header = np.array([len(rows), len(words)], dtype=np.int64)
    return np.concatenate([header, table[:, 0], table[:, 1], table[:, 2], starts.astype(np.int64), flat])


class Lexicon:
    """Looks up many words at once, byte by byte for all of them together."""

    def __init__(self, data: np.ndarray):
        n, w = int(data[0]), int(data[1])
        cuts = np.cumsum([2, n, n, n, w + 1])
        self.keys, self.targets, self.adds, self.starts = (data[a:b] for a, b in zip(cuts[:-1], cuts[1:]))
        self.flat = data[cuts[-1] :]

    def find(self, words: list[bytes]) -> list[list[int] | None]:
        if not len(self.keys) or not words:
            return [None] * len(words)
        lengths = np.array([len(w) for w in words])
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        first = np.cumsum(lengths) - lengths
        state, total = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        ends = np.zeros(len(words), dtype=bool)
        going = np.flatnonzero(lengths > 0)
        for depth in range(int(lengths.max(initial=0))):
            going = going[lengths[going] > depth]
            key = state[going] << 8 | data[first[going] + depth]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            good = self.keys[at] == key
            ends[going] = False
            going, at = going[good], at[good]
            state[going] = self.targets[at] >> 1
            ends[going] = (self.targets[at] & 1).astype(bool)
            total[going] += self.adds[at]
        return [self.flat[self.starts[i] : self.starts[i + 1]].tolist() if ok else None for ok, i in zip(ends.tolist(), total.tolist())]


def _batches_of_texts(batch: pa.RecordBatch):
    """Rows of a batch in groups of limited size: first row and texts, null as empty."""
    held, size, first = [], 0, 0
    for k, text in enumerate(batch.column("text").to_pylist()):
        held.append(text or "")
        size += len(held[-1])
        if size >= BATCH_CHARS:
            yield first, held
            held, size, first = [], 0, k + 1
    if held:
        yield first, held


def _words(cutter: Cutter, specials: re.Pattern, texts: list[str]):
    """Words of the texts as numbers, the distinct words, how many words precede
    each text, and how many of the distinct ones, at the end, are special tokens."""
    pieces, flags, owner = [], [], []
    for k, text in enumerate(texts):
        split = special_split(text, specials) if "<|" in text else [(text, False)]
        for piece, special in split:
            for part in [piece] if special else parts(lowered(piece)):
                pieces.append("" if special else part)
                flags.append(piece if special else None)
                owner.append(k)
    words, distinct, before = cutter.encoded(pieces)
    found = sorted({flag for flag in flags if flag})
    if found:
        # A special token is one word where its empty piece stands.
        at = [k for k, flag in enumerate(flags) if flag]
        words = np.insert(words, before[at], [len(distinct) + found.index(flags[k]) for k in at])
        before = before + np.searchsorted(at, np.arange(len(before)))
        distinct = pa.concat_arrays([distinct, pa.array(found, distinct.type)])
    at = np.searchsorted(np.array(owner), np.arange(len(texts) + 1))
    return words, distinct, before[at], len(found)


def _joined(of_word: list[str], number: np.ndarray, before: np.ndarray) -> pa.Array:
    """What each text's words stand for, with blanks between."""
    pieces = pa.array(of_word, pa.large_string()).take(pa.array(number))
    lists = pa.ListArray.from_arrays(pa.array(before, pa.int32()), pieces)
    return pc.binary_join(lists, pa.scalar(" ", pieces.type))


def frequent_words(docs: DataFrame, kinds, specials: str, limit: int = LEXICON_WORDS) -> list[str]:
    """Up to ``limit`` most frequent words of the corpus, counted over all of it."""

    def count(batches):
        cutter, pattern = Cutter(kinds.value, False), re.compile(specials)
        for batch in batches:
            for _, texts in _batches_of_texts(batch):
                words, distinct, _, special = _words(cutter, pattern, texts)
                n = np.bincount(words, minlength=len(distinct))[: len(distinct) - special]
                seen = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([distinct.take(pa.array(seen)).cast(pa.string()), pa.array(n[seen].astype(np.int64))], names=["word", "n"])

    counted = only(docs, "text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [r.word for r in most_frequent(written(counted, "words"), "n", limit).select("word").collect()]


def ship(spark: SparkSession, data: bytes, name: str) -> str:
    """A file in the shared folder that Spark hands to every executor; its name."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch(spark, name))
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    out.write(data)
    out.close()
    spark.sparkContext.addFile(path.toString())
    return path.getName()


def encode(docs: DataFrame, path: str, words: int = LEXICON_WORDS, texts: bool = False) -> DataFrame:
    """For every row of ``docs`` (``doc_id, text``): ``doc_id, n_tokens,
    ids_sha256, decoded_sha256`` (and ``ids, decoded`` if ``texts``).

    ``path``: a tokenizers file of lower-cased words with word ends. A null text
    counts as empty: no ids, decoded to the empty string. Rows are independent:
    repeated rows repeat. An empty table gives an empty result. At most
    ``words`` words go into the lexicon; it changes the speed, not the result.
    """
    spark = docs.sparkSession
    merger = Merger(path)
    kinds = spark.sparkContext.broadcast(classes())
    specials = merger.pattern().pattern
    common = frequent_words(docs, kinds, specials, words)
    table = compile_lexicon({w.encode(): merger.ids(w) for w in common})
    file = ship(spark, table.tobytes(), "lexicon")

    def run(batches):
        cutter, pattern = Cutter(kinds.value, False), re.compile(specials)
        merger, lexicon, cache = kept(
            ("bpe", file), lambda: (Merger(path), Lexicon(np.memmap(SparkFiles.get(file), dtype=np.int64, mode="r")), {})
        )

        def learn(fresh):
            for w, ids in zip(fresh, lexicon.find([w.encode() for w in fresh])):
                ids = merger.ids(w) if ids is None else ids
                cache[w] = (len(ids), " ".join(map(str, ids)), " ".join([merger.token[i] for i in ids]))

        for batch in batches:
            ids_column = batch.column("doc_id")
            for first, held in _batches_of_texts(batch):
                found, distinct, before, special = _words(cutter, pattern, held)
                used = np.zeros(len(distinct), dtype=bool)
                used[found] = True
                place = np.cumsum(used) - 1  # among the distinct words in use
                known = distinct.filter(pa.array(used)).to_pylist()
                plain = known[: len(known) - int(used[len(distinct) - special :].sum())]
                if len(cache) > CACHE_WORDS:
                    cache.clear()
                learn([w for w in plain if w not in cache])
                got = [cache[w] for w in plain] + [(1, str(merger.specials[w]), w) for w in known[len(plain) :]]
                number = place[found]
                size = np.array([x[0] for x in got], dtype=np.int64)
                total = np.concatenate([[0], np.cumsum(size[number])])
                columns = [ids_column.slice(first, len(held)), pa.array(np.diff(total[before]))]
                lines = [_joined([x[k] for x in got], number, before) for k in (1, 2)]
                columns += [pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in line], pa.string()) for line in lines]
                columns += [line.cast(pa.string()) for line in lines * texts]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * texts
    kind = dict(docs.dtypes)["doc_id"]
    return only(docs, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids string, decoded string" * texts)
