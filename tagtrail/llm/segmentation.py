"""Sampled SentencePiece segmentations without replacement, and decoding.

A text is a lattice: its nodes are the places between characters, its edges the
pieces of a vocabulary. Edge weights are log probabilities, and a backward pass gives every node
the log of the total weight to the end, so each edge has a probability at its node and a path the
product of them. Since no piece runs on from a word into the next white space, the lattice is a chain
of words; the pass runs once for every distinct word of a run of texts, over all words at the same time.

Segmentations come in the order of their Gumbel-perturbed log probability, by a best-first
search. A subspace is the set of paths that follow a path to some node and leave it there by another
edge; its exact log mass bounds it, and its largest perturbed value is drawn from a Gumbel
truncated at its parent's. The best subspace is opened, its path is drawn, and what remains is cut at each
edge of that path. The first ``k`` paths are a sample without replacement; the next
perturbed value is the threshold of the inclusion probabilities.

All draws come from a hash of the row's key, the place and the sample, so the
result does not depend on batches, partitions or retries.

Vocabularies with log probabilities keep them. A vocabulary ordered by merges
has no probabilities: its pieces get those of Zipf's law by rank. A character that is no
piece is written as its bytes, where the vocabulary has byte pieces, else as unknown.

Defined cases: a null or empty text has one segmentation, without pieces, with inclusion 1.
A text with fewer than ``k`` segmentations gives all of them, with inclusion 1. A stretch of more than ``STRETCH``
characters without white space is cut into stretches, so that no lattice of a word is unbounded; memory grows with the longest single
text. The meta symbol of white space in a text decodes to a space. Repeated rows with equal keys give
equal samples. Only the named columns are read. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagtrail.llm.batches import Rolling, giving_back, mixed, packed, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES = 2
STRETCH = 1 << 15
#: Characters of one run: lattices and paths of a run are held at once.
RUN_CHARS = 1 << 18
#: Edges of the lattices that a task keeps for later runs.
KEPT_EDGES = 3 << 20
DECODE_IDS = 1 << 19
MODEL_BYTES = 64 << 20
_SPACE = "▁"
_MARK = ord(_SPACE)
_COLUMNS = "rank int, ids array<int>, log_prob double, perturbed double, inclusion double"


@dataclass(frozen=True)
class Vocabulary:
    """Pieces as a hash table of fixed size; bounded by the size of the model file."""

    pieces: list[bytes]
    keys: np.ndarray
    ids: np.ndarray
    weights: np.ndarray
    longest: int
    byte_ids: np.ndarray
    byte_weight: float
    unknown: int
    prefix: bool

    def lookup(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id, weight) of the pieces with these hashes; -1 and minus infinity where there is none."""
        mask = np.uint64(len(self.keys) - 1)
        place = (key & mask).astype(np.int64)
        held = self.keys[place]
        out = np.where(held == key, self.ids[place], -1)
        open_ = np.flatnonzero((held != key) & (held != 0))
        while len(open_):
            place[open_] = (place[open_] + 1) & int(mask)
            held = self.keys[place[open_]]
            hit = held == key[open_]
            out[open_[hit]] = self.ids[place[open_[hit]]]
            open_ = open_[~hit & (held != 0)]
        return out, np.where(out >= 0, self.weights[out], -np.inf)


def load_vocabulary(spark: SparkSession, path: str = MODEL) -> Vocabulary:
    """Read a SentencePiece model; the driver reads the file, tasks get the table."""
    with open(path, "rb") as f:
        raw = f.read(MODEL_BYTES + 1)
    if len(raw) > MODEL_BYTES:
        raise ValueError(f"{path} has more than {MODEL_BYTES} bytes")
    model = sentencepiece.SentencePieceProcessor(model_proto=raw)
    n = model.get_piece_size()
    byte_ids = np.full(256, -1, np.int64)
    usable = []
    pieces = []
    for i in range(n):
        name = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(name[3:5], 16)] = i
            pieces.append(bytes([int(name[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            pieces.append(b"")
        else:
            if re.search(f"[^{_SPACE}]{_SPACE}", name):
                pieces.append(name.replace(_SPACE, " ").encode())
                continue  # runs over white space: not an edge of a word
            usable.append(i)
            pieces.append(name.replace(_SPACE, " ").encode())
    scores = np.array([model.get_score(i) for i in usable])
    weights = np.full(n, -np.inf)
    if np.all(scores == np.round(scores)):  # ordered by merges
        scores = -np.log(np.arange(1, len(usable) + 1)) - np.log(np.sum(1.0 / np.arange(1, len(usable) + 1)))
    weights[usable] = scores
    names = [model.id_to_piece(i) for i in usable]
    codes, starts = packed(names)
    hashes = mixed(Rolling(codes).of(starts[:-1], starts[1:]))
    size = 1 << (4 * len(usable)).bit_length()
    keys, ids = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
    for key, i in zip(hashes.tolist(), usable, strict=True):
        at = key & (size - 1)
        while keys[at]:
            at = (at + 1) & (size - 1)
        keys[at], ids[at] = key, i
    prefix = model.encode("a", out_type=str)[0].startswith(_SPACE)
    return Vocabulary(
        pieces, keys, ids, weights, int(np.diff(starts).max()), byte_ids, float(scores.min()), model.unk_id(), prefix
    )


class Lattice:
    """The lattices of the distinct words of a run.

    Node ``e`` of a word is the word's start plus the characters before it. The edges of a
    node, in order of their size, follow each other in flat arrays; only edges with a weight are held.
    """

    def __init__(self, codes: np.ndarray, starts: np.ndarray, vocabulary: Vocabulary):
        sizes = np.diff(starts)
        n = len(sizes)
        self.start = starts[:-1] + np.arange(n)  # one more node at the end of each word
        self.end = self.start + sizes
        total = len(codes) + n
        place = np.arange(len(codes)) + np.repeat(np.arange(n), sizes)
        self.code_at = np.zeros(total, np.uint32)
        self.code_at[place] = codes
        left = np.repeat(starts[1:], sizes) - np.arange(len(codes))
        rolling = Rolling(codes)
        at, found = np.arange(len(codes)), []
        count = np.zeros(total + 1, np.int64)
        for size in range(1, vocabulary.longest + 1):
            at = at[left[at] >= size]
            if not len(at):
                break
            piece, weight = vocabulary.lookup(mixed(rolling.of(at, at + size)))
            if size == 1:  # what is no piece is spelled out
                bare = piece < 0
                in_bytes = np.select([codes[bare] < 0x80, codes[bare] < 0x800, codes[bare] < 0x10000], [1, 2, 3], 4)
                weight[bare] = vocabulary.byte_weight * in_bytes
                live = np.isfinite(weight)
            else:
                live = piece >= 0
            node = place[at[live]]
            found.append((size, node, piece[live], weight[live]))
            count[node + 1] += 1
        self.first = np.cumsum(count)
        edges = int(self.first[-1])
        self.size, self.ids = np.empty(edges, np.int16), np.empty(edges, np.int32)
        self.log_p, self.ladder = np.empty(edges), np.empty(edges, np.float32)
        free = self.first[:-1].copy()
        for size, node, piece, weight in found:
            edge = free[node]
            self.size[edge], self.ids[edge], self.log_p[edge] = size, piece, weight
            free[node] += 1
        beta = np.zeros(total)
        order = np.argsort(left, kind="stable")
        bounds = np.searchsorted(left[order], np.arange(1, left.max(initial=0) + 2))
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if lo == hi:
                continue
            node = place[order[lo:hi]]
            ways = self.first[node + 1] - self.first[node]
            begin = np.cumsum(ways) - ways
            edge = np.arange(begin[-1] + ways[-1]) + np.repeat(self.first[node] - begin, ways)
            terms = self.log_p[edge] + beta[np.repeat(node, ways) + self.size[edge]]
            top = np.maximum.reduceat(terms, begin)
            shares = np.exp(terms - np.repeat(top, ways))
            sums = np.add.reduceat(shares, begin)
            beta[node] = top + np.log(sums)
            self.log_p[edge] = terms - np.repeat(beta[node], ways)
            upto = np.cumsum(shares)
            self.ladder[edge] = (upto - np.repeat(upto[begin] - shares[begin], ways)) / np.repeat(sums, ways)

    def extend(self, other: Lattice) -> None:
        """Add the words of ``other`` behind the own ones."""
        nodes, edges = len(self.code_at), len(self.ids)
        self.start = np.concatenate([self.start, other.start + nodes])
        self.end = np.concatenate([self.end, other.end + nodes])
        self.first = np.concatenate([self.first, other.first[1:] + edges])
        for name in ("code_at", "size", "ids", "log_p", "ladder"):
            setattr(self, name, np.concatenate([getattr(self, name), getattr(other, name)]))

    def drawn(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The edge that each draw takes at its node."""
        edge, last = self.first[node], self.first[node + 1] - 1
        open_ = np.flatnonzero((edge < last) & (self.ladder[edge] <= u))
        while len(open_):
            edge[open_] += 1
            on = edge[open_]
            open_ = open_[(on < last[open_]) & (self.ladder[on] <= u[open_])]
        return edge

    def drawn_without(self, node: int, u: float, used: tuple[int, ...]) -> int:
        """An edge of one node that is none of ``used``."""
        first = self.first[node]
        p = np.exp(self.log_p[first : self.first[node + 1]])
        p[np.array(used) - first] = 0.0
        ladder = np.cumsum(p)
        return int(first + min(np.searchsorted(ladder, u * ladder[-1], "right"), np.flatnonzero(p)[-1]))


class Words:
    """The lattices of the words that a task has met, each built once; begun anew beyond ``kept`` edges."""

    def __init__(self, vocabulary: Vocabulary, kept: int = KEPT_EDGES):
        self.vocabulary, self.kept = vocabulary, kept
        self.lattice: Lattice | None = None
        self.keys, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def numbered(self, codes: np.ndarray, first: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each of the words ``codes[first:ends]`` in the lattice, which then holds them all."""
        keys, pick, kind = np.unique(mixed(Rolling(codes).of(first, ends)), return_index=True, return_inverse=True)
        if self.lattice is None or len(self.lattice.ids) > self.kept:
            self.lattice = None
            self.keys, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        new = np.ones(len(keys), bool) if not len(self.keys) else self.keys[at] != keys
        if new.any() or self.lattice is None:
            size = ends[pick[new]] - first[pick[new]]
            starts = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
            spelled = codes[np.arange(starts[-1]) + np.repeat(first[pick[new]] - starts[:-1], size)]
            lattice, before = Lattice(spelled, starts, self.vocabulary), len(self.numbers)
            if self.lattice is None:
                self.lattice = lattice
            else:
                self.lattice.extend(lattice)
            joined = np.concatenate([self.keys, keys[new]])
            order = np.argsort(joined, kind="stable")
            self.keys = joined[order]
            self.numbers = np.concatenate([self.numbers, before + np.arange(len(size))])[order]
        return self.numbers[np.searchsorted(self.keys, keys)][kind] if len(keys) else np.zeros(0, np.int64)


def _uniform(seed: np.ndarray, place: np.ndarray, turn: int) -> np.ndarray:
    x = mixed(seed ^ mixed(place.astype(np.uint64), 31 + turn), 7)
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


class _Sampler:
    """The texts of one run: word ``w`` of text ``t`` is instance ``first[t] + w``."""

    def __init__(self, texts: list[str | None], seeds: np.ndarray, words: Words):
        vocabulary = words.vocabulary
        codes, starts = packed(texts)
        sizes = np.diff(starts)
        some = (sizes > 0) & vocabulary.prefix
        starts = np.concatenate([[0], np.cumsum(sizes + some)])
        marked = np.full(int(starts[-1]), _MARK, np.uint32)
        marked[np.arange(len(codes)) + np.repeat(np.cumsum(some), sizes)] = np.where(codes == 32, _MARK, codes)
        mark = marked == _MARK
        fresh = mark & ~np.concatenate([[False], mark[:-1]])
        fresh[starts[:-1][sizes > 0]] = True
        first = np.flatnonzero(fresh)
        long = np.diff(np.append(first, len(marked)))
        if (long > STRETCH).any():
            cuts = [np.arange(f, f + n, STRETCH) for f, n in zip(first, long, strict=True)]
            first = np.concatenate(cuts)
        ends = np.append(first[1:], len(marked))
        self.kind = words.numbered(marked, first, ends)
        self.lattice = words.lattice
        self.first = np.searchsorted(first, starts)
        counts = np.diff(self.first)
        self.owner = np.repeat(np.arange(len(texts)), counts)
        self.seed = mixed(seeds)[self.owner]
        self.text_seed = mixed(seeds, 1)
        self.n = len(texts)

    def paths(self, words: np.ndarray, nodes: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(instance, node, edge) of the edges drawn from each given node to the end of its word, in order."""
        lattice, out = self.lattice, []
        end = lattice.end[self.kind[words]]
        place = (words - self.first[self.owner[words]]) << 16
        step = 0
        while len(words):
            edge = lattice.drawn(nodes, _uniform(self.seed[words], place + step, turn))
            out.append((words, nodes, edge))
            nodes = nodes + lattice.size[edge]
            on = nodes < end
            words, nodes, end, place = words[on], nodes[on], end[on], place[on]
            step += 1
        if not out:
            return (np.zeros(0, np.int64),) * 3
        word, node, edge = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.argsort(word, kind="stable")
        return word[order], node[order], edge[order]


def _truncated(mass: np.ndarray, u: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Gumbel values at ``mass`` given that they lie below ``bound``."""
    free = mass - np.log(-np.log(u))
    return -np.logaddexp(-bound, -free)


class _Path:
    __slots__ = ("word", "node", "edge", "log_p", "banned")

    def __init__(self, word, node, edge, log_p, banned):
        self.word, self.node, self.edge, self.log_p = word, node, edge, log_p
        self.banned = banned  # place at which the path left its parent, and the edges used there before


def sample(
    texts: list[str | None], seeds: np.ndarray, vocabulary: Vocabulary, k: int, known: Words | None = None
) -> list[list[tuple]]:
    """For each text its segmentations (ids, log probability, perturbed value, inclusion), best first.

    The lattices of ``known`` words are used again; the result does not depend on them.
    """
    s = _Sampler(texts, seeds, known or Words(vocabulary))
    lattice = s.lattice
    words = np.arange(len(s.kind))
    word, node, edge = s.paths(words, lattice.start[s.kind], 0)
    log_p = lattice.log_p[edge]
    at = np.searchsorted(word, s.first)
    value = -np.log(-np.log(_uniform(s.text_seed, np.zeros(s.n), 0)))
    found: list[list[tuple[_Path, float]]] = [[] for _ in range(s.n)]
    # open subspaces of each text: (perturbed value, path, place)
    heap: list[list[tuple[float, _Path, int]]] = [[] for _ in range(s.n)]
    parts = [slice(at[t], at[t + 1]) for t in range(s.n)]
    fresh = [(t, _Path(word[e], node[e], edge[e], log_p[e], (-1, ())), float(value[t])) for t, e in enumerate(parts)]
    for turn in range(1, k + 1):
        for t, path, bound in fresh:
            found[t].append((path, bound))
        _cut(s, fresh, heap, k + 1 - turn, turn)
        if turn == k:
            break
        chosen = [(t, *heap[t].pop(0)) for t in range(s.n) if heap[t]]
        fresh = _opened(s, chosen, turn)
    return [[_finished(lattice, vocabulary, path, value, heap[t]) for path, value in found[t]] for t in range(s.n)]


def _cut(s: _Sampler, fresh: list[tuple[int, _Path, float]], heap: list[list], keep: int, turn: int) -> None:
    """Add the subspaces of fresh paths to those of their texts, and keep the best of each text."""
    fresh = [x for x in fresh if len(x[1].edge)]
    if not fresh:
        return
    lows = [max(path.banned[0], 0) for _, path, _ in fresh]
    sizes = np.array([len(path.edge) - lo for (_, path, _), lo in zip(fresh, lows, strict=True)])
    ends = np.cumsum(sizes)
    log_p = np.concatenate([path.log_p[lo:] for (_, path, _), lo in zip(fresh, lows, strict=True)])
    node = np.concatenate([path.node[lo:] for (_, path, _), lo in zip(fresh, lows, strict=True)])
    before = np.concatenate([(np.cumsum(path.log_p) - path.log_p)[lo:] for (_, path, _), lo in zip(fresh, lows, strict=True)])
    other = 1.0 - np.exp(log_p)
    spare = s.lattice.first[node + 1] - s.lattice.first[node] - 1
    for (_, path, _), first in zip(fresh, (ends - sizes).tolist(), strict=True):
        left, used = path.banned
        if left >= 0:
            spare[first] -= len(used)
            other[first] -= np.exp(s.lattice.log_p[np.array(used, np.int64)]).sum()
    live = np.flatnonzero(spare > 0)
    owner = np.searchsorted(ends, live, "right")
    place = live - (ends - sizes)[owner] + np.array(lows)[owner]
    mass = before[live] + np.log(np.maximum(other[live], 1e-300))
    texts = np.array([t for t, _, _ in fresh])
    u = _uniform(s.text_seed[texts[owner]], place, 1000 + turn)
    values = _truncated(mass, u, np.array([bound for _, _, bound in fresh])[owner])
    cuts = np.searchsorted(owner, np.arange(len(fresh) + 1)).tolist()
    for i, (t, path, _) in enumerate(fresh):
        own = values[cuts[i] : cuts[i + 1]]
        if len(own):
            best = np.argpartition(-own, keep)[:keep] if len(own) > keep else np.arange(len(own))
            both = heap[t] + [(float(own[b]), path, int(place[cuts[i] + b])) for b in best.tolist()]
            heap[t] = sorted(both, key=lambda x: -x[0])[:keep]


def _opened(s: _Sampler, chosen: list[tuple], turn: int) -> list[tuple[int, _Path, float]]:
    """Draw the path of each chosen subspace."""
    if not chosen:
        return []
    lattice = s.lattice
    texts = np.array([t for t, *_ in chosen])
    nodes = np.array([path.node[e] for _, _, path, e in chosen])
    word = np.array([path.word[e] for _, _, path, e in chosen])
    used, taken = [], np.zeros(len(chosen), np.int64)
    u = _uniform(s.text_seed[texts], word, 2000 + turn)
    for i, (_, _, path, e) in enumerate(chosen):
        used.append(((*path.banned[1],) if path.banned[0] == e else ()) + (int(path.edge[e]),))
        taken[i] = lattice.drawn_without(nodes[i], u[i], used[-1])
    after = nodes + lattice.size[taken]
    unfinished = after < lattice.end[s.kind[word]]
    last = s.first[texts + 1]
    rest = last - word - 1
    later = np.repeat(word + 1 - np.concatenate([[0], np.cumsum(rest)[:-1]]), rest) + np.arange(rest.sum())
    starts = np.concatenate([after[unfinished], lattice.start[s.kind[later]]])
    tail_word, tail_node, tail_edge = s.paths(np.concatenate([word[unfinished], later]), starts, turn)
    tail_p = lattice.log_p[tail_edge]
    lo, hi = np.searchsorted(tail_word, word), np.searchsorted(tail_word, last)
    out = []
    for i, (t, value, path, e) in enumerate(chosen):
        cut = slice(lo[i], hi[i])
        step = (word[i : i + 1], nodes[i : i + 1], taken[i : i + 1], lattice.log_p[taken[i : i + 1]])
        parts = zip((path.word, path.node, path.edge, path.log_p), step, (tail_word, tail_node, tail_edge, tail_p), strict=True)
        out.append((t, _Path(*(np.concatenate([a[:e], b, c[cut]]) for a, b, c in parts), (e, used[i])), value))
    return out


def _spelled(code: int, vocabulary: Vocabulary) -> np.ndarray:
    """Pieces of a character that is no piece itself."""
    as_bytes = vocabulary.byte_ids[list(chr(code).encode("utf-8", "surrogatepass"))]
    return as_bytes if (as_bytes >= 0).all() else np.array([vocabulary.unknown])


def _finished(lattice: Lattice, vocabulary: Vocabulary, path: _Path, value: float, heap: list) -> tuple:
    log_prob = float(path.log_p.sum())
    inclusion = 1.0 if not heap else float(-np.expm1(-np.exp(min(50.0, log_prob - heap[0][0]))))
    ids = lattice.ids[path.edge]
    bare = np.flatnonzero(ids < 0)
    if len(bare):
        codes = lattice.code_at[path.node[bare]]
        spelled = {c: _spelled(c, vocabulary) for c in np.unique(codes).tolist()}
        times = np.ones(len(ids), np.int64)
        times[bare] = [len(spelled[c]) for c in codes.tolist()]
        ids = np.repeat(ids, times)
        ids[ids < 0] = np.concatenate([spelled[c] for c in codes.tolist()])
    return ids.astype(np.int32), log_prob, value, inclusion


def segmentations(
    docs: DataFrame,
    vocabulary: Vocabulary,
    id_column: str = "doc_id",
    text_column: str = "text",
    k: int = SAMPLES,
    spell: bool = False,
    run_chars: int = RUN_CHARS,
    kept_edges: int = KEPT_EDGES,
) -> DataFrame:
    """(id, text_key, rank, ids, log_prob, perturbed, inclusion): ``k`` rows per row, ``text_key`` the xxhash64 of the text.

    With ``spell`` the ids are decoded in the same task and a column ``decoded`` is added, as :func:`decoded` would.
    ``run_chars`` and ``kept_edges`` trade memory of a task for time; the result does not depend on them.
    """
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, spelling = Words(held.value, kept_edges), Spelling(held.value)
        for batch in batches:
            texts = batch.column(3).to_pylist()
            seeds = np.asarray(batch.column(2)).view(np.uint64)
            for lo, hi in slices(texts, run_chars):
                drawn = sample(texts[lo:hi], seeds[lo:hi], held.value, k, known)
                rows = [(lo + i, rank, *x) for i, ways in enumerate(drawn) for rank, x in enumerate(ways, 1)]
                at, rank, ids, log_prob, value, inclusion = zip(*rows, strict=True)
                ends = np.append(0, np.cumsum([len(x) for x in ids])).astype(np.int32)
                at, flat = pa.array(at, pa.int64()), np.concatenate(ids)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array(rank, pa.int32()),
                     pa.ListArray.from_arrays(ends, pa.array(flat)), pa.array(log_prob), pa.array(value), pa.array(inclusion),
                     *([spelling.texts(flat, ends)] if spell else [])],
                    ["id", "text_key", "rank", "ids", "log_prob", "perturbed", "inclusion", *(["decoded"] if spell else [])],
                )

    taken = docs.select(
        F.col(id_column).alias("id"), F.xxhash64(text_column).alias("text_key"), F.xxhash64(F.col(id_column), F.lit(41)).alias("seed"),
        F.col(text_column).alias("text"),
    )
    kind = taken.schema["id"].dataType.simpleString()
    return taken.mapInArrow(giving_back(run), f"id {kind}, text_key long, {_COLUMNS}{', decoded string' if spell else ''}").withColumnRenamed("id", id_column)


class Spelling:
    """The bytes of all pieces in a row, so that ids become text without an object per id."""

    def __init__(self, vocabulary: Vocabulary):
        self.flat = np.frombuffer(b"".join(vocabulary.pieces), np.uint8)
        self.size = np.array([len(p) for p in vocabulary.pieces], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.drop = 1 if vocabulary.prefix else 0

    def texts(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The text of each row of ids; bytes that are no UTF-8 are replaced."""
        size = self.size[ids]
        at = np.append(0, np.cumsum(size))
        spelled = self.flat[np.arange(at[-1]) + np.repeat(self.start[ids] - at[:-1], size)]
        bounds = at[ends]
        if self.drop:
            first = np.zeros(len(spelled), bool)
            first[bounds[:-1][np.diff(bounds) > 0]] = True
            gone = np.append(0, np.cumsum(first))
            spelled, bounds = spelled[~first], bounds - gone[bounds]
        rows = pa.Array.from_buffers(pa.large_string(), len(ends) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(spelled.tobytes())])
        try:
            rows.validate(full=True)
        except pa.ArrowInvalid:
            raw = spelled.tobytes()
            return pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.string())
        return rows.cast(pa.string())


def decoded(frame: DataFrame, vocabulary: Vocabulary, ids_column: str = "ids", name: str = "decoded") -> DataFrame:
    """``frame`` with the ids column replaced by the text that it spells, ``DECODE_IDS`` ids or one row at a time."""
    held = frame.sparkSession.sparkContext.broadcast(vocabulary)
    kept = [f for f in frame.schema.fields if f.name != ids_column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelling = Spelling(held.value)
        for batch in batches:
            where = batch.schema.get_field_index(ids_column)
            column = batch.column(where)
            sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat, ends = np.asarray(column.flatten()), np.append(0, np.cumsum(sizes))
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + DECODE_IDS, "right")) - 1)
                texts = spelling.texts(flat[ends[lo] : ends[hi]], ends[lo : hi + 1] - ends[lo])
                others = [batch.column(i).slice(lo, hi - lo) for i in range(batch.num_columns) if i != where]
                yield pa.RecordBatch.from_arrays([*others, texts], [*(f.name for f in kept), name])
                lo = hi

    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)
    return frame.mapInArrow(giving_back(run), f"{columns}, {name} string")
