"""Token ids in files: static range asymmetric numeral systems (rANS).

One frequency table over the whole corpus serves all blocks and is written with
them, so that an archive can be read from its files alone. A block holds up to
``BLOCK`` ids, dealt over interleaved lanes that are coded side by side. Its
payload opens with a header, carries the coder's states every ``CHECKPOINT`` rows
of lanes, so that decoding can start in the middle, and is guarded by a CRC.
Blocks are independent: any of them can be decoded anywhere.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

from narrowmat.llm.common import binary_column, discard, only, scratch, written
from narrowmat.llm.pretokens import Cutter, byte_letters, classes, kept, parts, special_split

SCALE = 20
BLOCK = 1 << 17
LANES = 512
CHECKPOINT = 128
LOW = np.uint64(1 << 31)
CACHE_WORDS = 1 << 19
BATCH_CHARS = 1 << 21
END_ID = 0
MAGIC = b"RNS1"
HEAD, HEAD_BYTES = "<4sIIIII", 24  # magic, ids, lanes, checkpoints, words, crc of the rest


class Table:
    """Frequencies that sum to 2^SCALE; every id that occurs gets 1 at least."""

    def __init__(self, counts: np.ndarray):
        counts = counts.astype(np.float64)
        used = np.flatnonzero(counts)
        freq = np.zeros(len(counts), dtype=np.int64)
        room = 1 << SCALE
        if len(used):
            freq[used] = np.maximum(1, np.floor(counts[used] / counts.sum() * (room - len(used)))).astype(np.int64)
            freq[used[counts[used].argmax()]] += room - freq.sum()
        self._place(freq)

    @classmethod
    def of(cls, freq: np.ndarray) -> Table:
        """A table from scaled frequencies, as files keep them."""
        table = cls.__new__(cls)
        table._place(freq)
        return table

    def _place(self, freq: np.ndarray) -> None:
        self.freq = freq.astype(np.uint64)
        self.first = (np.cumsum(freq) - freq).astype(np.uint64)
        self.filler = int(freq.argmax())
        self._symbol = None

    @property
    def symbol(self) -> np.ndarray:
        if self._symbol is None:
            self._symbol = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self._symbol


def encode_block(ids: np.ndarray, table: Table) -> bytes:
    n = len(ids)
    lanes = min(LANES, max(1, n // 64))
    steps = -(-n // lanes)
    padded = np.full(steps * lanes, table.filler, dtype=np.int64)
    padded[:n] = ids
    grid = padded.reshape(steps, lanes)
    freq, first = table.freq[grid], table.first[grid]
    limit = freq << np.uint64(63 - SCALE)
    state = np.full(lanes, LOW, dtype=np.uint64)
    words, marks, written_words = [], [], 0
    for t in range(steps - 1, -1, -1):
        over = state >= limit[t]
        out = state[over].astype(np.uint32)
        words.append(out)
        written_words += len(out)
        state[over] >>= np.uint64(32)
        whole, rest = np.divmod(state, freq[t])
        state = (whole << np.uint64(SCALE)) + rest + first[t]
        if t % CHECKPOINT == 0:
            marks.append((written_words, state.copy()))
    total = written_words
    body = b"".join(struct.pack("<I", total - w) + s.tobytes() for w, s in reversed(marks))
    body += np.concatenate(words[::-1]).tobytes() if words else b""
    return struct.pack(HEAD, MAGIC, n, lanes, len(marks), total, zlib.crc32(body)) + body


def decode_block(data: bytes, table: Table, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Ids ``start`` to ``stop`` of a block, from the checkpoint before ``start``."""
    magic, n, lanes, n_marks, total, crc = struct.unpack_from(HEAD, data)
    if magic != MAGIC or zlib.crc32(data[HEAD_BYTES :]) != crc:
        raise ValueError("a damaged block of token ids")
    stop = n if stop is None else min(stop, n)
    if start >= stop:
        return np.zeros(0, np.uint32)
    entry = 4 + 8 * lanes
    words = np.frombuffer(data, dtype=np.uint32, offset=HEAD_BYTES + n_marks * entry)
    mark = start // lanes // CHECKPOINT
    at = HEAD_BYTES + mark * entry
    pos = struct.unpack_from("<I", data, at)[0]
    state = np.frombuffer(data, dtype=np.uint64, count=lanes, offset=at + 4).copy()
    t0, t1 = mark * CHECKPOINT, -(-stop // lanes)
    out = np.empty((t1 - t0, lanes), dtype=np.uint32)
    low = np.uint64((1 << SCALE) - 1)
    for t in range(t1 - t0):
        slot = state & low
        found = table.symbol[slot]
        out[t] = found
        state = table.freq[found] * (state >> np.uint64(SCALE)) + slot - table.first[found]
        under = np.flatnonzero(state < LOW)
        if len(under):
            state[under] = (state[under] << np.uint64(32)) | words[pos : pos + len(under)]
            pos += len(under)
    return out.reshape(-1)[start - t0 * lanes : stop - t0 * lanes]


# CRCs of pieces, joined without the bytes: polynomials modulo the CRC's own.


def _times(a: int, b: int) -> int:
    """Product of two reflected polynomials modulo the CRC-32 polynomial."""
    out = 0
    for k in range(31, -1, -1):
        if a >> k & 1:
            out ^= b
        b = (b >> 1) ^ (0xEDB88320 if b & 1 else 0)
    return out


def joined_crc(first: int, second: int, second_bytes: int) -> int:
    """CRC-32 of two runs of bytes one after the other."""
    power, square, n = 1 << 31, 1 << 30, 8 * second_bytes
    while n:
        if n & 1:
            power = _times(power, square)
        square = _times(square, square)
        n >>= 1
    return _times(power, first) ^ second


class Tokenizer:
    """The library's byte-level BPE, asked once per distinct piece of text; pieces are
    told apart and looked up in Arrow."""

    def __init__(self, path: str, kinds: np.ndarray):
        from tokenizers import Tokenizer as Library

        self.library = Library.from_file(path)
        self.model = self.library.model
        specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.special_names = sorted(specials, key=len, reverse=True)
        self.specials = re.compile("|".join(map(re.escape, self.special_names)) or "(?!)")
        self.cutter = Cutter(kinds, True)
        self.letters = byte_letters()
        self._reset()

    def _reset(self):
        # Ids of place k: flat[first[k] : first[k] + sizes[k]]. Place 0 is the end of
        # a text; special tokens follow, then the known pieces.
        self.first, self.sizes, self.flat = array("q", [0]), array("q", [1]), array("I", [END_ID])
        for name in self.special_names:
            self._add([self.library.token_to_id(name)])
        self.known = pa.array([], pa.large_string())

    def _add(self, ids: list[int]) -> None:
        self.first.append(len(self.flat))
        self.sizes.append(len(ids))
        self.flat.extend(ids)

    def _places(self, pieces: pa.Array) -> np.ndarray:
        """Places of distinct pieces, new ones learned."""
        at = pc.index_in(pieces, value_set=self.known)
        fresh = pieces.filter(at.is_null())
        letters, tokenize = self.letters, self.model.tokenize
        for piece in fresh.to_pylist():
            # Printable ASCII stands for itself, but for the blank.
            plain = piece.isascii() and piece.isprintable()
            spelled = piece.replace(" ", letters[32]) if plain else "".join([letters[b] for b in piece.encode()])
            self._add([t.id for t in tokenize(spelled)])
        out = at.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        out[at.is_null().to_numpy(zero_copy_only=False)] = len(self.known) + np.arange(len(fresh))
        self.known = pa.concat_arrays([self.known, fresh])
        return out + 1 + len(self.special_names)

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each closed by END_ID, and how many each text has."""
        pieces, flags, owner = [], {}, []
        for k, text in enumerate(texts):
            split = special_split(text, self.specials) if "<|" in text else [(text, False)]
            for piece, special in split:
                if special:
                    flags[len(pieces)] = piece
                for part in [""] if special else parts(piece):
                    pieces.append(part)
                    owner.append(k)
        if len(self.known) > CACHE_WORDS:
            self._reset()
        number, distinct, before = self.cutter.encoded(pieces)
        used = np.zeros(len(distinct), dtype=bool)
        used[number] = True
        places = np.zeros(len(distinct), dtype=np.int64)
        places[used] = self._places(distinct.filter(pa.array(used)))
        if flags:
            # A special token is one word where its empty piece stands.
            where = np.array(list(flags))
            number = np.insert(number, before[where], len(places) + np.arange(len(where)))
            places = np.append(places, [1 + self.special_names.index(x) for x in flags.values()])
            before = before + np.searchsorted(where, np.arange(len(before)))
        before = before[np.searchsorted(np.array(owner), np.arange(len(texts) + 1))]
        # The end of a text is one more word, of one id.
        first, n = np.zeros(len(places) + 1, np.int64), np.ones(len(places) + 1, np.int64)
        first[:-1], n[:-1] = np.array(self.first, dtype=np.int64)[places], np.array(self.sizes, dtype=np.int64)[places]
        number = np.insert(number, before[1:], len(places))
        before = before + np.arange(len(before))
        per_text = np.diff(np.append(0, np.cumsum(n[number]))[before])
        ends = np.cumsum(n)
        run = np.arange(ends[-1]) + np.repeat(first - (ends - n), n)
        spelled = binary_column(np.frombuffer(self.flat, dtype=np.uint32)[run], n).cast(pa.large_binary())
        return np.frombuffer(spelled.take(pa.array(number)).buffers()[2], dtype=np.uint32), per_text


def _texts(batch: pa.RecordBatch):
    held, size, first = [], 0, 0
    for k, text in enumerate(batch.column("text").to_pylist()):
        held.append(text or "")
        size += len(held[-1])
        if size >= BATCH_CHARS:
            yield first, held
            held, size, first = [], 0, k + 1
    if held:
        yield first, held


def tokens(docs: DataFrame, path: str) -> DataFrame:
    """Ids of every row, in ascending order of doc_id (nulls first, ties by text):
    ``doc_id, part, start, n, ids``. ``part`` numbers the ranges of doc_id,
    ``start`` counts the ids before the row within its range."""
    spark = docs.sparkSession
    kinds = spark.sparkContext.broadcast(classes())

    def run(batches):
        part, start, tokenizer = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            tokenizer = tokenizer or kept(("rans", path), lambda: Tokenizer(path, kinds.value))
            for first, held in _texts(batch):
                ids, n = tokenizer.ids(held)
                starts = start + np.cumsum(n) - n
                start += len(ids)
                # Small ids take two bytes; the first byte tells the width.
                wide = bool(ids.max(initial=0) > 0xFFFF)
                data = ids if wide else ids.astype(np.uint16)
                cuts = np.cumsum(n)[:-1]
                column = pa.array([(b"\x04" if wide else b"\x02") + x.tobytes() for x in np.split(data, cuts)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, len(held)), pa.array([part] * len(held), pa.int32()), pa.array(starts), pa.array(n), column],
                    names=["doc_id", "part", "start", "n", "ids"],
                )

    keyed = only(docs, "doc_id", "text").withColumn("h", F.xxhash64("text"))
    ranged = keyed.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    kind = dict(docs.dtypes)["doc_id"]
    return ranged.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, part int, start long, n long, ids binary")


def _unpacked(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype=np.uint16 if x[0] == 2 else np.uint32, offset=1) for x in column.to_pylist()]


def frequencies(rows: DataFrame, merge: int = 16) -> np.ndarray:
    """How often each id occurs, over all rows: one vector per task, added up by
    ``merge`` tasks and then by the driver."""

    def add(batches):
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            if "ids" in batch.schema.names:
                found = _unpacked(batch.column("ids"))
                vectors = [np.bincount(np.concatenate(found))] if found else []
            else:
                vectors = [np.frombuffer(x, dtype=np.int64) for x in batch.column("counts").to_pylist()]
            for v in vectors:
                if len(v) > len(total):
                    v, total = total, v.copy()
                total[: len(v)] += v
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])

    found = rows.select("ids").mapInArrow(add, "counts binary").repartition(merge).mapInArrow(add, "counts binary").collect()
    vectors = [np.frombuffer(r.counts, dtype=np.int64) for r in found]
    total = np.zeros(max((len(v) for v in vectors), default=0) or 1, dtype=np.int64)
    for v in vectors:
        total[: len(v)] += v
    return total


BLOCKS = "part int, start long, doc_ids array<long>, doc_starts array<long>, ns array<long>, whole array<boolean>, payload binary"


def encode(rows: DataFrame, table: Table) -> DataFrame:
    """Blocks of ids in order, with an index of their rows: ids, where each begins
    in its part, and how many of its ids are here. A row's ids stay together unless
    they fill blocks of their own; then it is not ``whole`` in any of them."""
    shared = rows.sparkSession.sparkContext.broadcast(cloudpickle.dumps(table))

    def run(batches):
        table = cloudpickle.loads(shared.value)  # with its class: executors need no copy of this package
        held, size = [], 0

        def block():
            part, first = held[0][0], held[0][2] + held[0][5]
            ids = np.concatenate([x[4] for x in held])
            columns = [[part], [first], [[x[1] for x in held]], [[x[2] for x in held]], [[len(x[4]) for x in held]], [[len(x[4]) == x[3] for x in held]], [encode_block(ids, table)]]
            kinds = [pa.int32(), pa.int64(), *[pa.list_(pa.int64())] * 3, pa.list_(pa.bool_()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in BLOCKS.split(", ")])

        for batch in batches:
            part, doc, start, n = (batch.column(c).to_pylist() for c in ("part", "doc_id", "start", "n"))
            for k, ids in enumerate(_unpacked(batch.column("ids"))):
                for at in range(0, len(ids), BLOCK):
                    piece = ids[at : at + BLOCK]
                    if held and (size + len(piece) > BLOCK or held[0][0] != part[k]):
                        yield block()
                        held, size = [], 0
                    held.append((part[k], doc[k], start[k], n[k], piece, at))
                    size += len(piece)
        if held:
            yield block()

    return rows.mapInArrow(run, BLOCKS)


def write_archive(docs: DataFrame, path: str, folder: str) -> None:
    """Tokenize ``docs`` and write ``folder/table`` (id, freq) and ``folder/blocks``."""
    spark = docs.sparkSession
    rows = written(tokens(docs, path), "tokens")
    table = Table(frequencies(rows))
    used = np.flatnonzero(table.freq)
    ids = pa.table({"id": pa.array(used.astype(np.int32)), "freq": pa.array(table.freq[used].astype(np.int64))})
    spark.createDataFrame(ids).coalesce(1).write.parquet(f"{folder}/table")
    encode(rows, table).write.parquet(f"{folder}/blocks")
    discard(rows)


def read_table(spark: SparkSession, folder: str) -> Table:
    """The frequency table of an archive: one entry for each id of the vocabulary."""
    found = spark.read.schema("id int, freq long").parquet(f"{folder}/table").toArrow()
    ids, freq = found.column("id").to_numpy(), found.column("freq").to_numpy()
    return Table.of(np.bincount(ids, freq, minlength=1).astype(np.int64))


def read_pieces(spark: SparkSession, folder: str, ids: bool = False) -> DataFrame:
    """What the blocks of an archive hold, decoded: ``doc_id, part, doc_start, first,
    n, whole, crc`` for each piece of a row, and with ``ids`` the ids themselves.
    ``first`` and ``doc_start`` count from the beginning of the part."""
    shared = spark.sparkContext.broadcast(cloudpickle.dumps(read_table(spark, folder)))
    names = ["doc_id", "part", "doc_start", "first", "n", "whole", "crc"] + ["ids"] * ids

    def run(batches):
        table = cloudpickle.loads(shared.value)  # with its class: executors need no copy of this package
        for batch in batches:
            for row in batch.to_pylist():
                found = decode_block(row["payload"], table)
                ends = np.cumsum(row["ns"])
                if ends[-1] != len(found):
                    raise ValueError("a block and its index differ in length")
                rows = np.split(found, ends[:-1])
                columns = [row["doc_ids"], [row["part"]] * len(rows), row["doc_starts"], row["start"] + ends - row["ns"], [len(x) for x in rows], row["whole"], [zlib.crc32(x.tobytes()) for x in rows]]
                kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 3, pa.bool_(), pa.int64()]
                made = [pa.array(c, k) for c, k in zip(columns, kinds)]
                if ids:
                    made.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(found.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(made, names=names)

    schema = "doc_id long, part int, doc_start long, first long, n long, whole boolean, crc long" + ", ids array<int>" * ids
    return spark.read.schema(BLOCKS).parquet(f"{folder}/blocks").mapInArrow(run, schema)


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every row, from the files alone:
    positions of parts are sums of what was decoded from the parts before."""

    def join(group):
        group = group.sort_values("first")
        crc = 0
        for c, n in zip(group["crc"], group["n"]):
            crc = joined_crc(crc, int(c), 4 * int(n))
        return group.head(1).assign(n_tokens=group["n"].sum(), ids_crc32=crc)[["doc_id", "part", "doc_start", "n_tokens", "ids_crc32"]]

    found = written(read_pieces(spark, folder), "crcs")
    schema = "doc_id long, part int, doc_start long, n_tokens long, ids_crc32 long"
    whole = found.filter("whole").select("doc_id", "part", "doc_start", F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
    split = found.filter("not whole").groupBy("part", "doc_start").applyInPandas(join, schema)
    sums = found.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()
    offsets = np.cumsum([0] + [r.n for r in sums]).tolist()
    given = spark.createDataFrame([(r.part, at) for r, at in zip(sums, offsets)], "part int, before long")
    rows = whole.unionAll(split).join(F.broadcast(given), "part")
    return rows.select("doc_id", (F.col("doc_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def write_and_read(docs: DataFrame, path: str) -> DataFrame:
    """Tokenize, write the files, read them back: ``doc_id, start, n_tokens,
    ids_crc32`` for every row of ``docs`` (``doc_id`` long, ``text``).

    A null text counts as empty: it has the closing id alone. Rows are ordered by
    doc_id, nulls first; rows that share a doc_id follow one another by text.
    An empty table gives an archive without blocks and an empty result. A row
    longer than a block is split over blocks, and its CRC joined from theirs.
    """
    folder = scratch(docs.sparkSession, "rans")
    write_archive(docs, path, folder)
    return read_archive(docs.sparkSession, folder)
