"""Quality by kernel ridge regression on document statistics, with isotonic calibration.

Each whole text gives a short row of statistics: sizes, shares of letters,
digits, capitals, marks and white space, word and line lengths, repeated lines and words.
Random Fourier features of the standardised rows approximate a Gaussian kernel. Every
partition adds up its own normal equations, the sums of partitions are added in
a tree, and the driver solves one system of ``features + 1`` unknowns. The raw
scores are then made probabilities by isotonic regression: scores fall into a fixed number of
bins, Spark counts labels per bin, and neighbouring bins are pooled until the shares rise.

All labelled rows are learned from. What reaches the driver has a fixed size.

Defined cases: a null or empty text has all statistics zero and is scored like
any other. Labels other than 0 and 1 and null ids are not learned from; an id with several labels takes
the largest. Without labelled rows every score is 0.5; with one class, its value.
Repeated rows are scored one by one. Only the named columns are read. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagtrail.llm.batches import DIGIT, LETTER, MARK, SPACE, STEP, UPPER, flags, giving_back, grams, packed, slices, space_words, spans
from tagtrail.session import materialize

STATISTICS = (
    "log_chars", "log_words", "letters", "digits", "capitals", "marks", "spaces", "rare_marks", "bars", "stops",
    "word_length", "word_spread", "long_words", "short_words", "marks_per_word", "line_length", "line_spread",
    "distinct_words", "distinct_pairs", "distinct_lines", "all_caps_words",
)
FEATURES = 200
BINS = 400
_NEWLINE, _BAR = 10, 124
_STOPS = (46, 44)  # full stop and comma


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[starts[1:]] - total[starts[:-1]]


def _run_lengths(inside: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and text number of runs of True that do not cross texts."""
    if not len(inside):
        return (np.zeros(0, np.int64),) * 3
    cut = np.zeros(len(inside) + 1, bool)
    cut[starts] = True
    left = np.concatenate([[False], inside[:-1]])
    right = np.concatenate([inside[1:], [False]])
    first = np.flatnonzero(inside & (~left | cut[:-1]))
    last = np.flatnonzero(inside & (~right | cut[1:]))
    return first, last - first + 1, np.searchsorted(starts, first, "right") - 1


def _counts(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Additive counts of each text: a text may be given in pieces and the rows added."""
    n = len(starts) - 1
    kind = flags(codes)
    letter, digit, space = (kind & LETTER) > 0, (kind & DIGIT) > 0, (kind & SPACE) > 0
    upper, mark = (kind & UPPER) > 0, (kind & MARK) > 0
    stop = (codes == _STOPS[0]) | (codes == _STOPS[1])
    bar = codes == _BAR
    first, length, owner = _run_lengths(~space, starts)
    many = lambda w=None: np.bincount(owner, w, minlength=n)
    ups = np.concatenate([[0], np.cumsum(upper)])
    caps = (ups[first + length] - ups[first] >= 2) & (ups[first + length] - ups[first] >= 0.6 * length)
    line_at, line_size, line_owner = _run_lengths(codes != _NEWLINE, starts)
    lines = lambda w=None: np.bincount(line_owner, w, minlength=n)
    size = length.astype(np.float64)
    return np.column_stack(
        [
            np.diff(starts), many(), _sums(letter, starts), _sums(digit, starts), _sums(upper, starts), _sums(mark, starts),
            _sums(space, starts), _sums(mark & ~stop & ~bar, starts), _sums(bar, starts), _sums(stop, starts),
            many(size), many(size**2), many(length > 12), many(length <= 2), many(caps),
            lines(), lines(line_size.astype(np.float64)), lines(line_size.astype(np.float64) ** 2),
        ]
    )


def _distinct(hashes: np.ndarray) -> float:
    return len(np.unique(hashes)) / len(hashes) if len(hashes) else 0.0


def text_statistics(texts: list[str | None]) -> np.ndarray:
    """One row of STATISTICS per text."""
    out = np.zeros((len(texts), len(STATISTICS)))
    for lo, hi in slices(texts):
        part = texts[lo:hi]
        codes, starts = packed(part)
        if hi == lo + 1 and len(codes) > STEP:
            pieces = (codes[at : at + STEP] for at in range(0, len(codes), STEP))
            c = sum(_counts(p, np.array([0, len(p)])) for p in pieces)
        else:
            c = _counts(codes, starts)
        docs, hashes = space_words(part)
        at = spans(docs, hi - lo)
        pairs, owner = grams(hashes, docs, (0, 1), 3)
        pair_at = spans(owner, hi - lo)
        repeats = np.zeros((hi - lo, 3))
        for i in range(hi - lo):
            rows = [x for x in (part[i] or "").split("\n") if x]
            repeats[i] = (
                _distinct(hashes[at[i] : at[i + 1]]),
                _distinct(pairs[pair_at[i] : pair_at[i + 1]]),
                len(set(rows)) / len(rows) if rows else 0.0,
            )
        chars, words, lines = np.maximum(c[:, 0], 1), np.maximum(c[:, 1], 1), np.maximum(c[:, 15], 1)
        mean, line_mean = c[:, 10] / words, c[:, 16] / lines
        out[lo:hi] = np.column_stack(
            [
                np.log1p(c[:, 0]), np.log1p(c[:, 1]), c[:, 2] / chars, c[:, 3] / chars, c[:, 4] / chars, c[:, 5] / chars,
                c[:, 6] / chars, c[:, 7] / chars, c[:, 8] / words, c[:, 9] / words, mean,
                np.sqrt(np.maximum(c[:, 11] / words - mean**2, 0)), c[:, 12] / words, c[:, 13] / words, c[:, 5] / words,
                np.log1p(line_mean), np.log1p(np.sqrt(np.maximum(c[:, 17] / lines - line_mean**2, 0))),
                repeats[:, 0], repeats[:, 1], repeats[:, 2], c[:, 14] / words,
            ]
        )
    return out


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    width = len(STATISTICS)
    for batch in batches:
        rows = text_statistics(batch.column(1).to_pylist())
        ends = np.arange(len(rows) + 1, dtype=np.int32) * width
        held = pa.ListArray.from_arrays(ends, pa.array(rows.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column(0), held], ["id", "statistics"])


def measured(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, statistics) of every row, written to the shared folder so that texts are read once."""
    taken = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = taken.schema["id"].dataType.simpleString()
    return materialize(taken.mapInArrow(giving_back(_measured), f"id {kind}, statistics array<double>"), "statistics")


@dataclass(frozen=True)
class QualityModel:
    """Standardisation, random features, ridge weights and the calibrated steps: a few kilobytes."""

    mean: np.ndarray
    scale: np.ndarray
    frequency: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    edges: np.ndarray
    levels: np.ndarray

    def raw(self, rows: np.ndarray) -> np.ndarray:
        return fourier(rows, self.mean, self.scale, self.frequency, self.phase) @ self.weights

    def score(self, rows: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(rows), self.edges, self.levels)


def fourier(rows, mean, scale, frequency, phase) -> np.ndarray:
    """Cosine features and a column of ones."""
    z = np.clip((rows - mean) / scale, -8.0, 8.0) @ frequency + phase
    return np.column_stack([np.cos(z) * np.sqrt(2.0 / frequency.shape[1]), np.ones(len(rows))])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), len(STATISTICS))


def isotonic(counts: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Pool neighbouring bins until the share of ones never falls; one level per bin."""
    blocks: list[list[float]] = []
    for c, y in zip(counts, ones, strict=True):
        blocks.append([y, c, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            y2, c2, n2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + y2, blocks[-1][1] + c2, blocks[-1][2] + n2]
    return np.repeat([y / c for y, c, _ in blocks], [int(n) for _, _, n in blocks])


def fit_quality(
    statistics: DataFrame,
    labels: DataFrame,
    usable: Column,
    id_column: str = "doc_id",
    label_column: str = "quality",
    features: int = FEATURES,
    width: float = 4.0,
    ridge: float = 1e-3,
    bins: int = BINS,
) -> QualityModel:
    """Fit on every labelled row for which ``usable``, a condition on the label table, holds."""
    named = labels.where(usable).select(F.col(id_column).alias("id"), F.col(label_column).cast("double").alias("label"))
    named = named.where(F.col("id").isNotNull() & F.col("label").isin(0.0, 1.0)).groupBy("id").agg(F.max("label").alias("label"))
    known = materialize(statistics.join(named, "id").select("label", "statistics"), "labelled")
    each = [F.col("statistics")[k] for k in range(len(STATISTICS))]
    head = known.agg(F.count("*"), F.avg("label"), *[F.avg(x) for x in each], *[F.stddev_pop(x) for x in each]).head()
    k = len(STATISTICS)
    mean, scale = (np.array([x or 0.0 for x in head[2 + k * i : 2 + k * (i + 1)]]) for i in range(2))
    scale = np.where(scale > 1e-9, scale, 1.0)
    draw = np.random.default_rng(23)
    frequency, phase = draw.normal(0.0, 1.0 / width, (k, features)), draw.uniform(0, 2 * np.pi, features)
    rate = 0.5 if head[1] is None else float(head[1])
    flat = QualityModel(mean, scale, frequency, phase, np.zeros(features + 1), np.array([-1.0, 2.0]), np.array([rate, rate]))
    if not head[0] or rate in (0.0, 1.0):
        return flat
    size = features + 1

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 1))
        for batch in batches:
            z = fourier(_matrix(batch.column(1)), mean, scale, frequency, phase)
            total[:, :size] += z.T @ z
            total[:, size] += z.T @ np.asarray(batch.column(0))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    parts = known.mapInArrow(equations, "total binary").rdd.map(lambda r: np.frombuffer(r[0]).reshape(size, size + 1))
    total = parts.treeReduce(np.add, 2)
    weights = np.linalg.solve(total[:, :size] + ridge * head[0] / size * np.eye(size), total[:, size])
    model = QualityModel(mean, scale, frequency, phase, weights, np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    low, high = -0.5, 1.5

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = model.raw(_matrix(batch.column(1)))
            place = np.clip((raw - low) / (high - low) * bins, 0, bins - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(place), batch.column(0)], ["bin", "label"])

    counted = known.mapInArrow(binned, "bin int, label double").groupBy("bin").agg(F.count("*").alias("n"), F.sum("label").alias("y"))
    found = sorted(tuple(r) for r in counted.collect())  # one row per bin at most
    at, n, y = (np.array(x, np.float64) for x in zip(*found, strict=True))
    levels = isotonic(n, y)
    return QualityModel(mean, scale, frequency, phase, weights, low + (at + 0.5) * (high - low) / bins, levels)


def quality(statistics: DataFrame, model: QualityModel, id_column: str = "doc_id") -> DataFrame:
    """(id, score) of every row of :func:`measured`."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(_matrix(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["id", "score"])

    kind = statistics.schema["id"].dataType.simpleString()
    return statistics.mapInArrow(giving_back(scored), f"id {kind}, score double").withColumnRenamed("id", id_column)
