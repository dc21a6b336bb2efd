"""License scans: identifier tags and notice phrases by Aho-Corasick, license
expressions by a shunting-yard parser."""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from narrowmat.llm.common import only

# Phrases that make the base, and phrases the scan adds. Words stand consecutively.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
NOTICES = {
    "apache license": "apache", "apache license version 2 0": "apache-2.0", "mit license": "mit",
    "mozilla public license": "mpl", "bsd license": "bsd", "3 clause bsd license": "bsd-3-clause",
    "2 clause bsd license": "bsd-2-clause", "isc license": "isc", "boost software license": "bsl",
    "eclipse public license": "epl", "gnu lesser general public license": "lgpl",
    "gnu general public license": "gnu-gpl", "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0", "gnu affero general public license": "agpl",
    "cc by sa": "cc-by-sa", "cc by nc": "cc-by-nc", "cc by nd": "cc-by-nd", "cc by nc 4 0": "cc-by-nc-4.0",
    "cc by 4 0": "cc-by-4.0", "cc0 1 0": "cc0-1.0", "public domain": "public-domain", "unlicense": "unlicense",
}
TAG = "spdx license identifier"

# Licences whose texts may be used freely.
PERMISSIVE = frozenset("apache apache-2.0 mit bsd bsd-2-clause bsd-3-clause isc bsl bsl-1.0 cc0-1.0 cc-by-4.0 public-domain unlicense 0bsd zlib".split())

_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
_LINE = re.compile(r"spdx[^0-9a-z\n]*license[^0-9a-z\n]*identifier[^0-9a-z(\n]*([^\n]*)")
_PART = re.compile(r"[()]|[0-9a-z.+\-]+(?::[0-9a-z.+\-]+)?")
_ORDER = {"or": 1, "and": 2, "with": 3}


class BadExpression(ValueError):
    pass


def postfix(text: str) -> list[str]:
    """A license expression in postfix order. It ends before the first mark that
    cannot belong to it, and where two names stand side by side."""
    out, stack, want = [], [], True
    at = 0
    while hit := _PART.match(text, at):
        part = hit[0]
        if part == "(":
            if not want:
                break
            stack.append(part)
        elif part == ")":
            if want or "(" not in stack:
                break
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        elif part in _ORDER:
            if want:
                raise BadExpression(text)
            while stack and stack[-1] != "(" and _ORDER[stack[-1]] >= _ORDER[part]:
                out.append(stack.pop())
            stack.append(part)
            want = True
        else:
            if not want:
                break
            name = part.rstrip(".-")
            if not name:
                break
            out.append(name)
            want = False
        at = hit.end()
        while at < len(text) and text[at] in " \t":
            at += 1
    if want or "(" in stack:
        raise BadExpression(text)
    return out + stack[::-1]


def evaluate(parts: list[str], allowed=PERMISSIVE) -> tuple[set[str], bool]:
    """The identifiers of an expression, and whether it permits free use: one side
    of ``or``, both of ``and``; an exception after ``with`` takes nothing away."""
    stack: list[tuple[set[str], bool]] = []
    for part in parts:
        if part not in _ORDER:
            stack.append(({part}, part.removesuffix("+") in allowed))
            continue
        right, left = stack.pop(), stack.pop()
        if part == "with":
            stack.append((left[0], left[1]))
        else:
            stack.append((left[0] | right[0], left[1] or right[1] if part == "or" else left[1] and right[1]))
    return stack.pop()


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase in BASE.keys() | NOTICES.keys() | {TAG}:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


def scan_text(machine: ahocorasick.Automaton, text: str) -> tuple:
    words = text.encode().translate(_FOLD).split()
    line = f" {b' '.join(words).decode()} "
    starts, base, labels, tagged = [], set(), set(), False
    seen, at = 0, 0
    for end, phrase in machine.iter(line):
        if phrase == TAG:
            tagged = True
        if phrase in NOTICES:
            labels.add(NOTICES[phrase])
        if phrase in BASE:
            base.add(BASE[phrase])
            begin = end - len(phrase) - 1
            seen, at = (seen + line.count(" ", at, begin), begin) if begin >= at else (line.count(" ", 0, begin), begin)
            starts.append(seen)
    permissive, parsed = None, False
    if tagged:
        for hit in _LINE.finditer(text.translate(_ASCII_LOWER)):
            try:
                names, free = evaluate(postfix(hit[1].strip()))
            except BadExpression:
                continue
            labels |= names
            permissive, parsed = free if permissive is None else permissive and free, True
    labels |= base
    if not parsed and labels:
        permissive = bool(labels & PERMISSIVE) and not labels & {"reserved", "gpl", "cc-by-nc"}
    return (
        len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
        ",".join(sorted(labels)), 1.0 if parsed else 1.0 - 0.5 ** len(labels), permissive,
    )


SCANNED = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, permissive boolean"


def scan(docs: DataFrame) -> DataFrame:
    """For every row of ``docs`` (``doc_id, text``) what its text says of licences.

    Words are runs of ASCII letters, digits and anything beyond ASCII. ``n_base``
    counts all places of base phrases, ``first_word`` and ``last_word`` are their
    smallest and largest start. ``score``: 1 if a tag's expression could be
    read, else 1 - 2^-labels. ``permissive``: what the expressions (or, without
    any, the phrases) allow; null without a label. A null text counts as empty.
    Rows are independent; an empty table gives an empty result.
    """

    def run(batches):
        machine = automaton()
        for batch in batches:
            rows = [scan_text(machine, text or "") for text in batch.column("text").to_pylist()]
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.bool_()]
            columns = [pa.array(x, k) for x, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", *[c.split()[0] for c in SCANNED.split(", ")]])

    kind = dict(docs.dtypes)["doc_id"]
    return only(docs, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, {SCANNED}")
