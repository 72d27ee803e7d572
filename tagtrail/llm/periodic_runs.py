"""Runs of repeated words, found with a suffix automaton and link-cut access.

A run is a stretch of words with a smallest period ``q`` that no neighbouring word extends. The words of a
text are appended to a suffix automaton one by one. The link tree of the automaton is held as
preferred paths in splay trees, one colour each: the place where the strings of the path ended last. A new
word's state is accessed, which recolours its way to the root piece by piece. A piece that ended ``d`` words ago and
whose longest string has ``h >= d`` words shows the square of period ``d`` that ends here, within a stretch
of ``h + d`` words; its last end is its nearest, so ``d`` is the smallest period, and its longest string is all
that the two ends share, so the stretch starts there. Walking on to the right gives the whole run.

Most words of a text cannot lie in a run of a high exponent and are never appended. In a run every group of three words
beyond the first period was last seen at most a period before, and these words are consecutive. So words whose
last sight lies too far back for the stretch of such words around them are struck out, again and again until nothing
changes (hash collisions and rounds left out only strike fewer). What remains, with a period's words before it, are
windows that hold every run whole, and the automaton works on them.

Defined cases: words are ``[^\\x20\\x09-\\x0D]+``; a null text has none, no runs and an empty collapsed text. Repeated rows and ids, null
ids among them, are judged one by one. Only the named columns are read. An empty table gives an empty
result. Memory grows with the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagtrail.llm.batches import mixed, slices

EXPONENT = 4
LEAST = 6
#: Rounds of striking out; fewer only leave more words to the automaton.
ROUNDS = 32
RUN_CHARS = 1 << 19
_FAR = np.int64(1) << 60
_RUNS = "runs array<struct<start: long, length: long, period: long>>"


class _Paths:
    """Preferred paths of a growing tree as splay trees; node 0 stands for none.

    ``up`` is the parent in the splay tree, or, at its root, the tree node above the path. The colour
    of a path is kept at the root of its splay tree. The deeper a node, the further to the right.
    """

    def __init__(self):
        self.up, self.left, self.right, self.colour = [0], [0], [0], [0]

    def add(self, above: int) -> int:
        self.up.append(above)
        self.left.append(0)
        self.right.append(0)
        self.colour.append(0)
        return len(self.up) - 1

    def splay(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        p = up[x]
        while p and (left[p] == x or right[p] == x):
            g = up[p]
            if g and (left[g] == p or right[g] == p):
                if (left[g] == p) == (left[p] == x):
                    self._turn(p, g)
                else:
                    self._turn(x, p)
            self._turn(x, up[x])
            p = up[x]

    def _turn(self, x: int, p: int) -> None:
        """Rotate ``x`` above its splay parent ``p``."""
        up, left, right = self.up, self.left, self.right
        g = up[p]
        if left[p] == x:
            b = left[p] = right[x]
            right[x] = p
        else:
            b = right[p] = left[x]
            left[x] = p
        if b:
            up[b] = p
        up[p], up[x] = x, g
        if g and left[g] == p:
            left[g] = x
        elif g and right[g] == p:
            right[g] = x
        else:
            self.colour[x] = self.colour[p]

    def insert_above(self, x: int) -> int:
        """A new node between ``x`` and its tree parent, on the path of ``x``."""
        self.splay(x)
        new = self.add(x)
        held = self.left[new] = self.left[x]
        if held:
            self.up[held] = new
        self.left[x] = new
        return new

    def access(self, leaf: int, now: int) -> Iterator[tuple[int, int]]:
        """Make one path of colour ``now`` from a new ``leaf`` to the root; yields (deepest node, last colour) of each piece."""
        below, x = leaf, self.up[leaf]
        while x:
            self.splay(x)
            off, colour = self.right[x], self.colour[x]
            if off:
                self.colour[off] = colour
            self.right[x] = below
            yield x, colour
            below, x = x, self.up[x]
        self.colour[below] = now


def runs_of(words: list, exponent: int = 2, least: int = 2) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least ``exponent`` periods and ``least`` words, by start and period."""
    paths = _Paths()
    follow: list[dict] = [{}]
    link, size = [0], [0]
    last, found, done = 0, [], {}
    for i, word in enumerate(words):
        new = paths.add(0)
        follow.append({})
        size.append(i + 1)
        link.append(0)
        p, root_passed = last, False
        while word not in follow[p]:
            follow[p][word] = new
            if not p:
                root_passed = True
                break
            p = link[p]
        if not root_passed:
            q = follow[p][word]
            if size[q] != size[p] + 1:
                copy = paths.insert_above(q)
                follow.append(follow[q].copy())
                size.append(size[p] + 1)
                link.append(link[q])
                link[q] = copy
                while follow[p].get(word) == q:
                    follow[p][word] = copy
                    if not p:
                        break
                    p = link[p]
                q = copy
            link[new] = paths.up[new] = q
        last = new
        for node, before in paths.access(new, i):
            d = i - before
            if size[node] < (exponent - 1) * d or done.get(d, -1) >= i:
                continue
            end = i + 1
            while end < len(words) and words[end] == words[end - d]:
                end += 1
            done[d] = end - 1
            start = i + 1 - size[node] - d
            if end - start >= least:
                found.append((start, end - start, d))
    return sorted(found, key=lambda r: (r[0], r[2]))


def windows(words: np.ndarray, starts: np.ndarray, exponent: int = EXPONENT, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(text, first word, end) of stretches that hold every run whole; texts lie one behind the other in ``words``."""
    width = min(3, exponent - 1)
    n = len(words) - width + 1
    if n <= 0:
        return []
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    key = mixed(owner[:n].astype(np.uint64), 3)
    for k in range(width):
        key = mixed(key + words[k : n + k].astype(np.uint64), k)
    whole = owner[:n] == owner[width - 1 :]
    order = np.argsort(key, kind="stable")
    again = np.flatnonzero(key[order][1:] == key[order][:-1])
    back = np.full(n, _FAR)
    back[order[again + 1]] = order[again + 1] - order[again]
    back[~whole] = _FAR
    at = np.flatnonzero(back < _FAR)
    for _ in range(ROUNDS):
        if not len(at):
            return []
        cut = np.flatnonzero(np.diff(at) != 1) + 1
        bounds = np.concatenate([[0], cut, [len(at)]])
        room = np.diff(bounds) + width - 1
        fits = (exponent - 1) * back[at] <= np.repeat(room, np.diff(bounds))
        if fits.all():
            break
        at = at[fits]
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) != 1) + 1
    first, last = at[np.append(0, cut)], at[np.append(cut, len(at)) - 1]
    room = last - first + width
    reach = room // (exponent - 1)
    some = (reach >= 1) & (room + reach >= least)
    text = owner[first[some]]
    left = np.maximum(first[some] - reach[some], starts[text])
    out: list[tuple[int, int, int]] = []
    for a, b, t in sorted(zip(left.tolist(), (last[some] + width).tolist(), text.tolist(), strict=True)):
        if out and out[-1][0] == t and a < out[-1][2]:
            out[-1] = (t, out[-1][1], max(b, out[-1][2]))
        else:
            out.append((t, a, b))
    return out


def split_words(text: str | None) -> list[bytes]:
    """The words of a text in UTF-8; bytes are split at exactly the white space of the contract."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def text_runs(texts: list[list[bytes]], exponent: int = EXPONENT, least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """The runs of each of some texts, given as words."""
    names: dict[bytes, int] = {}
    flat = np.array([names.setdefault(w, len(names)) for words in texts for w in words], np.int64)
    starts = np.append(0, np.cumsum([len(words) for words in texts])).astype(np.int64)
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for t, a, b in windows(flat, starts, exponent, least):
        off = a - int(starts[t])
        found[t] += [(s + off, n, q) for s, n, q in runs_of(flat[a:b].tolist(), exponent, least)]
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in found]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    """The words without those that a run repeats, joined by one space."""
    if runs:
        edge = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            edge[start + period] += 1
            edge[start + length] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
    return b" ".join(words).decode("utf-8", "surrogatepass")


def periodic_runs(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", exponent: int = EXPONENT, least: int = LEAST
) -> DataFrame:
    """(id, n_words, runs, collapsed) of every row: its runs of ``exponent`` periods and ``least`` words or more, and its text without what they repeat."""
    if exponent < 2:
        raise ValueError("a run has two periods at least")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([(name, pa.int64()) for name in ("start", "length", "period")])
        for batch in batches:
            texts = batch.column(1)
            sizes = pa.compute.utf8_length(texts).fill_null(0).to_pylist()
            for lo, hi in slices([range(n) for n in sizes], RUN_CHARS):  # only the sizes count
                words = [split_words(t) for t in texts.slice(lo, hi - lo).to_pylist()]
                runs = text_runs(words, exponent, least)
                ends = np.append(0, np.cumsum([len(r) for r in runs])).astype(np.int32)
                flat = np.array([x for r in runs for x in r], np.int64).reshape(-1, 3)
                parts = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, c])) for c in range(3)], fields=list(kind))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        pa.array([len(w) for w in words], pa.int64()),
                        pa.ListArray.from_arrays(ends, parts),
                        pa.array([collapsed(w, r) for w, r in zip(words, runs, strict=True)], pa.string()),
                    ],
                    ["id", "n_words", "runs", "collapsed"],
                )

    taken = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = taken.schema["id"].dataType.simpleString()
    return taken.mapInArrow(run, f"id {kind}, n_words long, {_RUNS}, collapsed string").withColumnRenamed("id", id_column)


def strongest(runs: Column) -> Column:
    """The run with the greatest exact length / period; ties go to the smallest start, then period. Null without runs."""

    def before(a: Column, b: Column) -> Column:
        more, less = a["length"] * b["period"], b["length"] * a["period"]
        first = F.struct(a["start"], a["period"]) < F.struct(b["start"], b["period"])
        return F.when(more != less, F.when(more > less, -1).otherwise(1)).otherwise(F.when(first, -1).otherwise(1))

    return F.get(F.array_sort(runs, before), F.lit(0))
