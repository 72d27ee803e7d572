"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are normalised alike: letters and digits in lower case,
every other run of characters one space. An item of ``m`` normal characters may occur with
up to ``k = rate * m`` edits. It is cut into ``k + 1`` pieces of even length; an
occurrence leaves at least one of them whole, so the exact hits of an automaton over all
pieces find every candidate. The pieces are the leaves of a binary tree: if a
stretch of ``p`` pieces has at most ``p - 1`` edits, one of its halves has fewer edits than
pieces too. A hit is therefore followed up the tree, and a node is verified by
Myers' bit-parallel distance with that bound, so chance hits end after one short step and no
occurrence is lost.

Items are read in blocks of at most ``block_chars`` characters, so that the automaton
sent to tasks has a bounded size; each block is one pass over the texts, and its matches are written before the block after the next is
read, so the driver never holds more than two blocks.

Defined cases: null or empty texts match nothing, neither do items that are null or have no letter or digit. An item of
fewer than ``least`` normal characters must occur without edits and as whole words; scripts without spaces, from U+2E80 on, have a word
end after each character. Equal items are
all reported. An item that occurs several times in a text gives one row: the fewest edits, then
the first place. Repeated rows give rows of their own. Only the named columns are read. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagtrail.llm.batches import DIGIT, LETTER, flags, giving_back, lowered, packed
from tagtrail.session import materialize

RATE = 0.1
LEAST = 24
BLOCK_CHARS = 4_000_000
STEP_CHARS = 1 << 20
_NO_SPACES = "\u2e80"


def normal(text: str | None) -> tuple[str, np.ndarray]:
    """The normal form of a text and, for each of its characters, the place in the text."""
    out, where = [], []
    codes, _ = packed([text])
    for at in range(0, len(codes), STEP_CHARS):
        part = codes[at : at + STEP_CHARS]
        inside = (flags(part) & (LETTER | DIGIT)) > 0
        before = np.concatenate([[bool(at) and out[-1][-1] != 32 if out and len(out[-1]) else False], inside[:-1]])
        kept = inside | (before & ~inside)
        out.append(np.where(inside, lowered(part), 32)[kept].astype("<u4"))
        where.append(np.flatnonzero(kept) + at)
    if not out:
        return "", np.zeros(0, np.int64)
    flat, places = np.concatenate(out), np.concatenate(where)
    if len(flat) and flat[-1] == 32:
        flat, places = flat[:-1], places[:-1]
    return flat.tobytes().decode("utf-32-le", "surrogatepass"), places


def masks(pattern: str) -> dict[str, int]:
    """For each character the bits of its places in the pattern."""
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def myers(peq: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """(fewest edits, first end) of a pattern of length ``m`` anywhere in ``text``."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    vp, vn, score, best, end = full, 0, m, m, 0
    for i, c in enumerate(text):
        x = peq.get(c, 0) | vn
        d0 = ((((x & vp) + vp) ^ vp) | x) & full
        hn = vp & d0
        hp = vn | (full & ~(vp | d0))
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp = (hp << 1) & full
        hn = (hn << 1) & full
        vp = hn | (full & ~(d0 | hp))
        vn = d0 & hp
        if score < best:
            best, end = score, i + 1
    return best, end


@dataclass(frozen=True)
class Item:
    """A test item in its normal form and the bounds of its pieces."""

    item_id: int
    text: str
    cuts: tuple[int, ...]
    short: bool = False

    def stands(self, text: str, start: int) -> bool:
        """Whether a short item at ``start`` of a text begins and ends with a word; longer items may stand anywhere."""
        end = start + len(self.text)
        free = lambda edge, at: edge >= _NO_SPACES or not 0 <= at < len(text) or text[at] == " "
        return not self.short or (free(self.text[0], start - 1) and free(self.text[-1], end))


class Matcher:
    """Finds the items of one block in normal texts."""

    def __init__(self, items: list[Item]):
        self.items = items
        self.found = ahocorasick.Automaton()
        held: dict[str, list[tuple[int, int]]] = {}
        for n, item in enumerate(items):
            for p in range(len(item.cuts) - 1):
                held.setdefault(item.text[item.cuts[p] : item.cuts[p + 1]], []).append((n, p))
        for piece, owners in held.items():
            self.found.add_word(piece, (len(piece), owners))
        self.found.make_automaton()
        self.nodes: dict[tuple[int, int, int], tuple[dict[str, int], int]] = {}

    def _chain(self, item: Item, piece: int) -> list[tuple[int, int]]:
        """Nodes from the parent of a piece to the root, as piece numbers."""
        lo, hi, path = 0, len(item.cuts) - 1, []
        while hi - lo > 1:
            path.append((lo, hi))
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if piece < mid else (mid, hi)
        return path[::-1]

    def _node(self, n: int, lo: int, hi: int) -> tuple[dict[str, int], int]:
        key = (n, lo, hi)
        if key not in self.nodes:
            item = self.items[n]
            part = item.text[item.cuts[lo] : item.cuts[hi]]
            self.nodes[key] = masks(part), len(part)
        return self.nodes[key]

    def matches(self, text: str) -> dict[int, tuple[int, int, int]]:
        """For each item found: (edits, start, end) in the normal text."""
        best: dict[int, tuple[int, int, int]] = {}
        if not len(self.found):
            return best
        for last, (size, owners) in self.found.iter(text):
            for n, p in owners:
                if n in best and best[n][0] == 0:
                    continue  # places come in order: no later one is better
                item = self.items[n]
                zero = last + 1 - size - item.cuts[p]  # where the item would start without edits
                if not item.stands(text, zero) or self._rejected(item, p, zero, text):
                    continue
                edits, start, end = self._verified(n, p, zero, text)
                if edits >= 0 and (n not in best or (edits, start) < best[n][:2]):
                    best[n] = edits, start, end
        return best

    @staticmethod
    def _rejected(item: Item, p: int, zero: int, text: str) -> bool:
        """A quick test of the parent: two pieces with one edit leave half of the other piece whole, moved by one at most."""
        pieces = len(item.cuts) - 1
        lo, hi = 0, pieces
        while hi - lo > 2:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if p < mid else (mid, hi)
        if hi - lo != 2:
            return False
        other = lo if p == lo + 1 else lo + 1
        a, b = item.cuts[other], item.cuts[other + 1]
        mid = (a + b) // 2
        near = text[max(0, zero + a - 1) : zero + b + 1]
        return item.text[a:mid] not in near and item.text[mid:b] not in near

    def _verified(self, n: int, p: int, zero: int, text: str) -> tuple[int, int, int]:
        item = self.items[n]
        for lo, hi in self._chain(item, p):
            allowed = hi - lo - 1
            peq, m = self._node(n, lo, hi)
            left = max(0, zero + item.cuts[lo] - allowed)
            right = zero + item.cuts[hi] + allowed
            edits, end = myers(peq, m, text[left : max(left, right)])
            if edits > allowed:
                return -1, 0, 0
        if len(item.cuts) == 2:  # one piece: the hit is the item
            return 0, zero, zero + len(item.text)
        end += left
        back = text[max(0, end - len(item.text) - edits) : end][::-1]
        _, size = myers(masks(item.text[::-1]), len(item.text), back)
        return edits, end - size, end


def _matched(items: list[Item]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(items)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            rows = []
            for i, text in enumerate(texts):
                if not text:
                    continue
                small, places = normal(text)
                for n, (edits, start, end) in matcher.matches(small).items():
                    rows.append((i, matcher.items[n].item_id, edits, int(places[start]), int(places[end - 1]) + 1))
            at, item, edits, start, end = (list(x) for x in zip(*rows, strict=True)) if rows else ([],) * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(item, pa.int64()), pa.array(edits, pa.int32()),
                 pa.array(start, pa.int64()), pa.array(end, pa.int64())],
                ["id", "item_id", "edits", "start", "end"],
            )

    return run


def item_of(item_id: int, text: str, rate: float, least: int) -> Item:
    """An item cut into one piece more than the edits allowed; a short one is whole."""
    small, _ = normal(text)
    short = len(small) < least
    pieces = 1 if short else int(rate * len(small)) + 1
    return Item(item_id, small, tuple(len(small) * i // pieces for i in range(pieces + 1)), short)


def item_blocks(
    benchmark: DataFrame, item_column: str, text_column: str, rate: float, least: int, block_chars: int
) -> Iterator[list[Item]]:
    """Items in blocks of a bounded number of characters."""
    rows = benchmark.select(F.col(item_column).cast("long").alias("item"), F.col(text_column).alias("text"))
    block, held = [], 0
    for row in rows.where("item IS NOT NULL AND text IS NOT NULL").toLocalIterator():
        item = item_of(row.item, row.text, rate, least)
        if not item.text:
            continue
        if held and held + len(item.text) > block_chars:
            yield block
            block, held = [], 0
        block.append(item)
        held += len(item.text)
    if block:
        yield block


def benchmark_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    rate: float = RATE,
    least: int = LEAST,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """(id, item_id, edits, start, end) of every item in every text; the span is in code points of the text."""
    taken = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = taken.schema["id"].dataType.simpleString()
    schema = f"id {kind}, item_id long, edits int, start long, end long"
    out = None
    blocks = item_blocks(benchmark, item_column, item_text_column, rate, least, block_chars)
    block = next(blocks, None)
    while block is not None:
        following = next(blocks, None)
        found = taken.mapInArrow(giving_back(_matched(block)), schema)
        if out is not None or following is not None:
            found = materialize(found, "matches")
        out = found if out is None else out.unionByName(found)
        block = following
    if out is None:
        out = taken.limit(0).mapInArrow(giving_back(_matched([])), schema)
    return out.withColumnRenamed("id", id_column)
