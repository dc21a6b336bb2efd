"""WARC archives: written, read back, and indexed by an external merge.

Archives are written by Spark's own text writer (records end in two line ends,
which is its line separator here), so a lost task leaves nothing behind. Reading
an archive gives a run: its captures sorted by URL key and time. Runs are cut at
common boundaries and merged range by range with a loser tree, which yields the
captures of all archives in one global order.
"""

from __future__ import annotations

import gzip
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from narrowmat.llm.common import CLEANUP, only, scratch, written

LEAST_BYTES = 1000
RECORDS_PER_FILE = 5000
EPOCH = 1_704_067_200  # 2024-01-01: captures of tables without a time are page_id seconds after it
END = "\r\n\r\n"

_ID = "urn:x-page:"


def url_key(url: Column | str) -> Column:
    """Host names from the top level down, then path and query: neighbours in a
    site are neighbours in order. Scheme, user, port and ``www.`` do not count."""
    url = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    bare = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, r"^([^/?#]*)", 1)), r"^[^@]*@|:[0-9]*$", "")
    host = F.regexp_replace(host, r"^www\.", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.regexp_extract(bare, r"^[^/?#]*(.*)$", 1))


def _clean(value: Column) -> Column:
    return F.regexp_replace(F.coalesce(value, F.lit("")), r"[\r\n]+", " ")


def write(pages: DataFrame, least: int = LEAST_BYTES) -> str:
    """One record for each row of ``pages`` (``page_id, url, html``); the folder.

    Of rows with equal payloads of ``least`` bytes or more, those with the
    largest page_id are responses and the others revisit it. The groups are
    joined to the pages by digest; adaptive execution splits hot ones.
    """
    spark = pages.sparkSession
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = only(pages, "page_id", "url", "html").select("page_id", "url", html.alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("bytes", F.octet_length("html"))
    light = rows.filter(F.col("bytes") >= least).groupBy("digest").agg(
        F.max("page_id").alias("target"), F.count("*").alias("n")
    )
    groups = written(light.filter("n > 1").select(F.col("digest").alias("group"), "target"), "payloads")
    met = rows.join(groups, (F.col("digest") == F.col("group")) & (F.col("bytes") >= least), "left")
    again = F.col("target").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("target"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes"), F.lit(END)
    )
    block = F.when(again, http).otherwise(F.concat(http, F.col("html")))
    name = lambda c: F.concat(F.lit(f"<{_ID}"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    when = F.date_format(
        F.timestamp_seconds(F.lit(EPOCH) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(1_000_000_000))), "yyyy-MM-dd'T'HH:mm:ss'Z'"
    )
    header = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(again, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: "), name(F.col("page_id")),
        F.lit("\r\nWARC-Target-URI: "), _clean(F.col("url")), F.lit("\r\nWARC-Date: "), when,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(again, F.concat(
            F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "),
            name(F.col("target")),
        )).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "), F.octet_length(block), F.lit(END),
    )
    path = scratch(spark, "warc")
    old = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        met.select(F.concat(header, block).alias("value")).write.option("lineSep", END).option("compression", "gzip").option(
            "maxRecordsPerFile", RECORDS_PER_FILE
        ).text(path)
    finally:
        spark.conf.set(CLEANUP, old)
    return path


_FIELD = re.compile(rb"([A-Za-z-]+): ([^\r\n]*)")


def records(data: bytes):
    """Headers (lower-case names) and block of every record of an archive."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/1.", at):
            raise ValueError("no WARC record where one should begin")
        head = {k.decode().lower(): v.decode() for k, v in _FIELD.findall(data[at:stop])}
        begin = stop + 4
        end = begin + int(head["content-length"])
        yield at, head, data[begin:end]
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError("a WARC record that does not end where it should")
        at = end + 4


def _page(uri: str) -> int | None:
    number = uri[len(_ID) + 1 : -1]
    return int(number) if number else None


RUN = "run string, seq long, url string, ts string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, offset long"
_TYPES = [pa.string(), pa.int64(), *[pa.string()] * 2, *[pa.int64()] * 2, *[pa.string()] * 2, *[pa.int64()] * 2]
_NAMES = [c.split()[0] for c in RUN.split(", ")]


def _read(batches):
    import hashlib

    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
            data = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
            found = []
            for offset, head, block in records(data):
                http, _, payload = block.partition(b"\r\n\r\n")
                length = int(re.search(rb"Content-Length: ([0-9]+)", http)[1])
                digest = head["warc-payload-digest"].removeprefix("sha1:")
                if head["warc-type"] == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
                    raise ValueError("a payload that is not what its record says")
                refers = head.get("warc-refers-to")
                found.append((head.get("warc-target-uri", ""), head["warc-date"], _page(head["warc-record-id"]), length, digest, head["warc-type"], _page(refers) if refers else None, offset))
            yield path, found


def _runs(batches):
    for path, found in _read(batches):
        # The run's order: host from the top level down, time, page.
        found.sort(key=lambda r: (_key(r[0]), r[1], -1 if r[2] is None else r[2]))
        rows = [(path, k, *r) for k, r in enumerate(found)]
        columns = list(zip(*rows)) if rows else [[] for _ in _NAMES]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], names=_NAMES)


_BARE = re.compile(r"^[A-Za-z][A-Za-z0-9+.\-]*://")


def _key(url: str) -> str:
    bare = _BARE.sub("", url)
    host = re.match(r"[^/?#]*", bare)[0]
    rest = bare[len(host) :]
    host = re.sub(r"^www\.", "", re.sub(r"^[^@]*@|:[0-9]*$", "", host.lower()))
    return ",".join(reversed(host.split("."))) + ")" + rest


class LoserTree:
    """Merges sorted runs: each inner node keeps the loser of its match, so one
    new head plays only the matches on its way to the root."""

    def __init__(self, runs: list[list], key):
        self.runs, self.key = runs, key
        self.at = [0] * len(runs)
        self.heads = [key(r[0]) if r else None for r in runs]
        self.tree = [-1] * max(len(runs), 1)
        for k in range(len(runs)):
            self._play(k)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and x is not None
        return (x, a) < (y, b)

    def _play(self, winner: int) -> None:
        node = (winner + len(self.runs)) // 2
        while node > 0:
            if self.tree[node] == -1:
                self.tree[node] = winner
                return
            if self._less(self.tree[node], winner):
                self.tree[node], winner = winner, self.tree[node]
            node //= 2
        self.tree[0] = winner

    def __iter__(self):
        while self.runs and self.heads[k := self.tree[0]] is not None:
            run, at = self.runs[k], self.at[k]
            yield run[at]
            at += 1
            self.at[k] = at
            self.heads[k] = self.key(run[at]) if at < len(run) else None
            self._play(k)


def _merge(batches):
    """One range of the index: slices of runs in, captures in order out. Slices
    hold index entries only, and a range is one of many."""
    names, slices = None, {}
    for batch in batches:
        names = batch.schema.names
        for row in zip(*[batch.column(c).to_pylist() for c in names]):
            slices.setdefault(row[0], []).append(row)
    if not slices:
        return
    place = {c: k for k, c in enumerate(names)}
    key, ts, page = place["urlkey"], place["ts"], place["page_id"]
    runs = [sorted(v, key=lambda r: r[place["seq"]]) for _, v in sorted(slices.items())]
    order = lambda r: (r[key].encode(), r[ts], -1 if r[page] is None else r[page])
    out = []
    for row in LoserTree(runs, order):
        out.append(row)
        if len(out) == 10_000:
            yield _table(out, names)
            out = []
    if out:
        yield _table(out, names)


def _table(rows, names):
    kinds = dict(zip(_NAMES, _TYPES)) | {"urlkey": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[n]) for c, n in zip(zip(*rows), names)], names=names)


def read_runs(spark, path: str) -> DataFrame:
    """The archives of a folder, each as a run sorted by URL key, time and page."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_runs, RUN).withColumn("urlkey", url_key("url"))


def merged(runs: DataFrame) -> DataFrame:
    """All captures in one order. Boundaries lie on (key, time, page), so even the
    captures of one URL spread over many ranges. A capture without page_id comes
    before the others of its time; repeated rows stay repeated."""
    ranged = runs.repartitionByRange("urlkey", "ts", F.coalesce("page_id", F.lit(-1)))
    order = ["run", *[c for c in runs.columns if c != "run"]]
    return ranged.select(*order).mapInArrow(_merge, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in (runs.schema[c] for c in order)))


def captures(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """Write ``pages`` as archives, read them back, merge the index: ``page_id,
    payload_bytes, payload_digest, record_type, refers_to, urlkey, ts, run, offset``.

    A null html is an empty payload, a null url an empty key, a null page_id a
    page that revisits others but is never referred to while others have ids.
    Rows that repeat the largest page_id of their payload are all responses.
    An empty table gives an empty result.
    """
    runs = written(read_runs(pages.sparkSession, write(pages, least)), "runs")
    return merged(runs).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "ts", "run", "offset"
    )
