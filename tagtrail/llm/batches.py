"""Array helpers for the text operators: batches of texts as flat code point arrays.

A task sees one Arrow batch at a time. ``slices`` cuts it into runs of a
bounded number of characters, so that memory depends on the longest single text
and not on the number of rows.
"""

from __future__ import annotations

import ctypes
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Characters of one run of texts.
RUN_CHARS = 1 << 20
#: Code points of one step inside a long text.
STEP = 1 << 20

LETTER, DIGIT, SPACE, UPPER, MARK = 1, 2, 4, 8, 16
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A function of batches that gives freed memory back to the system when its task ends: the worker lives on for other tasks."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
            if trim:
                trim(0)

    return wrapped


def slices(texts: list[str | None], limit: int = RUN_CHARS) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive runs of at most ``limit`` characters, or of one longer text."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        size = len(text) if text else 0
        if held and held + size > limit:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(texts):
        yield start, len(texts)


def packed(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row, and where each text starts (one more entry for the end)."""
    parts = [(t or "").encode("utf-32-le", "surrogatepass") for t in texts]
    starts = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) // 4 for p in parts], out=starts[1:])
    return np.frombuffer(b"".join(parts), "<u4"), starts


def _flag(c: int) -> int:
    s = chr(c)
    kind = unicodedata.category(s)
    return (
        LETTER * kind.startswith("L")
        | DIGIT * kind.startswith("N")
        | SPACE * s.isspace()
        | UPPER * s.isupper()
        | MARK * kind.startswith(("P", "S"))
    )


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    plane = range(65536)
    flags = np.fromiter((_flag(c) for c in plane), np.uint8, 65536)
    small = np.fromiter((ord(x) if len(x := chr(c).lower()) == 1 else c for c in plane), np.uint32, 65536)
    return flags, small


def flags(codes: np.ndarray) -> np.ndarray:
    """LETTER, DIGIT, SPACE, UPPER and MARK bits of every code point."""
    table, _ = _tables()
    out = table[np.minimum(codes, 65535)]
    far = codes > 65535
    if far.any():
        for c in np.unique(codes[far]).tolist():
            out[codes == c] = _flag(c)
    return out


def lowered(codes: np.ndarray) -> np.ndarray:
    """Lower case where that is one code point of the first plane; other code points stay."""
    _, table = _tables()
    return np.where(codes < 65536, table[np.minimum(codes, 65535)], codes).astype(np.uint32)


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of ``x`` and the salt."""
    x = x + np.uint64((salt * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    up, down = np.full(n, _BASE, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Rolling:
    """Hashes of any stretch of a code point array, each in constant time."""

    def __init__(self, codes: np.ndarray):
        n = 1 << max(10, int(len(codes)).bit_length())
        up, self._down = _powers(n)
        self._sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)], out=self._sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self._sums[end] - self._sums[start]) * self._down[start]


def _runs(inside: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the runs of True that do not cross the start of a text."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[starts] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    first = inside & (~before | edge[:n])
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    last = inside & (~after | edge[1:])
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def space_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every word ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z, in order."""
    return _hashed_words(texts, _space_cut)


def plain_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every run of letters and digits, in lower case, in order."""
    return _hashed_words(texts, _plain_cut)


def _space_cut(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lower = np.where((codes >= 65) & (codes <= 90), codes + 32, codes)
    return lower, ~((codes == 32) | ((codes >= 9) & (codes <= 13)))


def _plain_cut(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return lowered(codes), (flags(codes) & (LETTER | DIGIT)) > 0


def _hashed_words(texts: list[str | None], cut) -> tuple[np.ndarray, np.ndarray]:
    docs, hashes = [], []
    for lo, hi in slices(texts):
        codes, starts = packed(texts[lo:hi])
        if hi == lo + 1 and len(codes) > STEP:
            for part in _steps(codes, cut):
                docs.append(np.full(len(part), lo, np.int64))
                hashes.append(part)
            continue
        small, inside = cut(codes)
        first, end = _runs(inside, starts)
        docs.append(np.searchsorted(starts, first, "right") - 1 + lo)
        hashes.append(mixed(Rolling(small).of(first, end)))
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(docs), np.concatenate(hashes)


def _steps(codes: np.ndarray, cut) -> Iterator[np.ndarray]:
    """Word hashes of one long text, a step at a time; a step ends between words."""
    at, n = 0, len(codes)
    while at < n:
        end = min(n, at + STEP)
        while end < n:
            ahead = cut(codes[end : end + 4096])[1]
            if ahead.all():
                end = min(n, end + len(ahead))
                continue
            end += int(np.argmin(ahead))
            break
        small, inside = cut(codes[at:end])
        first, last = _runs(inside, np.zeros(1, np.int64))
        yield mixed(Rolling(small).of(first, last))
        at = end


def spans(docs: np.ndarray, n: int) -> np.ndarray:
    """Where the entries of each of ``n`` texts start in a sorted array of text numbers."""
    return np.searchsorted(docs, np.arange(n + 1))


def grams(hashes: np.ndarray, docs: np.ndarray, gaps: tuple[int, ...], salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words at the given offsets after each word, where all lie in one text."""
    far = gaps[-1]
    if len(hashes) <= far:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = len(hashes) - far
    joint = hashes[:n].copy()
    for gap in gaps[1:]:
        joint = joint * _BASE + hashes[gap : gap + n]
    whole = docs[:n] == docs[far:]
    return mixed(joint[whole], salt), docs[:n][whole]
