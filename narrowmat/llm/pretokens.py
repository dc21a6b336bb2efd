"""Cuts texts into the pieces that byte-pair tokenizers merge within.

The tokenizers' patterns are matched with array operations on code points: a
text is cut where the class of the characters changes, and a few rules move cuts
around blanks and apostrophes. Classes are asked from the tokenizers library
itself, once, on the driver.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa

SPACE, LETTER, NUMBER, OTHER, EDGE = range(5)
PART_CHARS = 1 << 20


def classes() -> np.ndarray:
    """Class of every code point, as the library's expressions see it."""
    from tokenizers import Regex, pre_tokenizers

    points = [*range(0xD800), *range(0xE000, 0x110000)]
    every = "".join(map(chr, points))
    found = np.full(0x110000, OTHER, dtype=np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for run, _ in pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(every):
            found[ord(run[0]) : ord(run[-1]) + 1] = kind
    return found


def lowered(text: str) -> str:
    """NFC and lower case, character by character as the library does."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


_SAFE = re.compile("[a-z](?= [a-z])")


def parts(text: str) -> list[str]:
    """A long text in parts; cut between words, where every pattern cuts anyway."""
    if len(text) <= 2 * PART_CHARS:
        return [text]
    out, at = [], 0
    while len(text) - at > 2 * PART_CHARS:
        hit = _SAFE.search(text, at + PART_CHARS)
        if not hit:
            break
        out.append(text[at : hit.end()])
        at = hit.end()
    return [*out, text[at:]]


class Cutter:
    """``blank_first``: a single blank belongs to the piece after it and white
    space is kept; else white space is dropped and digits stand alone."""

    def __init__(self, kinds: np.ndarray, blank_first: bool):
        self.kinds, self.blank_first = kinds, blank_first

    def cut(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """All pieces of all texts in order, and how many precede each text."""
        big, _, first, last, keep, ends = self._edges(texts)
        first, last = first[keep], last[keep]
        before = np.searchsorted(first, np.concatenate([[0], ends + 1]))
        return [big[a:b] for a, b in zip(first.tolist(), last.tolist())], before

    def encoded(self, texts: list[str]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """The same as numbers of distinct pieces: the number of each piece, the distinct
        pieces (some of them perhaps unused), and how many pieces precede each text. The
        pieces are views of the texts' bytes until Arrow has told them apart."""
        big, points, first, last, keep, ends = self._edges(texts)
        data = big.encode()
        if len(data) == len(points):
            place = first
        else:
            width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
            place = (np.cumsum(width) - width)[first]
        offsets = np.append(place, len(data)).astype(np.int64)
        pieces = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(data))
        coded = pieces.dictionary_encode()
        before = np.searchsorted(first[keep], np.concatenate([[0], ends + 1]))
        return coded.indices.to_numpy()[keep], coded.dictionary, before

    def _edges(self, texts: list[str]):
        """The texts as one, its code points, where pieces begin and end, which of
        them count, and where each text ends."""
        big = "\n".join(texts) + "\n"
        points = np.frombuffer(big.encode("utf-32-le"), dtype=np.uint32)
        kind = self.kinds[points]
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        kind[ends] = EDGE
        n = len(points)
        start = np.ones(n, dtype=bool)
        np.not_equal(kind[1:], kind[:-1], out=start[1:])
        start[ends] = True
        quote = np.flatnonzero(start & (points == 39))
        if self.blank_first:
            solid = (kind >= LETTER) & (kind <= OTHER)
            first = np.flatnonzero(start[1:] & solid[1:] & (kind[:-1] == SPACE)) + 1
            blank = points[first - 1] == 32
            start[first[blank]] = False
            start[first - 1] = True
            quote = quote[start[quote]]
        else:
            start |= kind == NUMBER
        quote = quote[kind[np.minimum(quote + 1, n - 1)] == LETTER]
        if len(quote):
            one, two = points[np.minimum(quote + 1, n - 1)], points[np.minimum(quote + 2, n - 1)]
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
            after = np.where(short, quote + 2, quote + 3)[short | long]
            start[quote[short | long] + 1] = False
            after = after[after < n]
            start[after[kind[after] == LETTER]] = True
        first = np.flatnonzero(start)
        last = np.append(first[1:], n)
        keep = kind[first] != EDGE
        if not self.blank_first:
            keep &= kind[first] != SPACE
        return big, points, first, last, keep, ends


def special_split(text: str, specials: re.Pattern) -> list[tuple[str, bool]]:
    """The text in pieces, each with whether it is a special token."""
    out, at = [], 0
    for hit in specials.finditer(text):
        if hit.start() > at:
            out.append((text[at : hit.start()], False))
        out.append((hit[0], True))
        at = hit.end()
    if at < len(text) or not out:
        out.append((text[at:], False))
    return out


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies:
    printable Latin-1 stands for itself, the rest follows from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def kept(key: tuple, make):
    """One object per Python worker: what a task has learned serves the tasks after
    it. It lives on ``sys``, since task code itself is shipped anew each time."""
    import sys

    held = sys.__dict__.setdefault("_narrowmat_kept", {})
    if key not in held:
        held.clear()  # one at a time, so that memory stays bounded
        held[key] = make()
    return held[key]
