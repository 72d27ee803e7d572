"""Quality rules: counted rules, then logistic regression over hashed word and character n-grams.

The counted rules look at the number of words and at how many of them stand in windows that come again. The learned rule is a
logistic regression: every word, word pair and run of ``CHARS`` characters falls into a bucket of a hash table, and a text's features
are the shares of its word buckets and of its character buckets. It is trained in numpy by stochastic gradient
descent with a rate per coordinate on a bounded sample of labelled rows, taken in the order of a hash, so the model depends on neither partitions nor
retries. A logistic curve fitted to rows kept aside makes the raw sums probabilities. Scoring adds up
table entries over Arrow batches; the table has ``2**BITS`` small numbers, which bounds the broadcast.

A text is kept if no counted rule fails and its probability is ``KEEP_FROM`` or more.

Defined cases: words are ``[^\\x20\\x09-\\x0D]+``. A null or empty text has no words and fails. Repeated windows and words are known by 64-bit hashes
within their text. Labels other than 0 and 1 and null ids are not learned from; an id with several labels takes the largest. Without
labelled rows every probability is 0.5, with one class its value. Repeated rows and ids are judged one by
one. Only the named columns are read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagtrail.llm.batches import STEP, Rolling, grams, lowered, mixed, packed, slices, space_words
from tagtrail.llm.sampling import in_order, labelled_sample

BITS = 18
CHARS = 4
#: Bounds of the sample: rows and characters.
SAMPLE = 6_000
SAMPLE_CHARS = 24_000_000
#: Fixed thresholds: the least number of words, the largest percentage of words in repeated windows, the least probability.
LEAST_WORDS, MOST_REPEATED, KEEP_FROM = 50, 50, 0.5
SYMBOLS = "#*$%&|<>"
WINDOW = 3
_SCALE = 30.0
RUN_CHARS = 1 << 19
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class RulesModel:
    """Weights of the buckets and the curve from raw sums to probabilities; two megabytes at any input size."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0

    def probability(self, raw: np.ndarray) -> np.ndarray:
        return _sigmoid(self.slope * raw + self.offset)


def _sigmoid(x):
    with np.errstate(over="ignore"):
        return 1.0 / (1.0 + np.exp(-x))


def _char_grams(codes: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, bucket) of every run of CHARS characters within a text, a step of characters at a time."""
    for at in range(0, max(0, len(codes) - CHARS + 1), STEP):
        part = lowered(codes[at : at + STEP + CHARS - 1])
        first = np.arange(len(part) - CHARS + 1)
        bucket = (mixed(Rolling(part).of(first, first + CHARS), 2) >> np.uint64(64 - BITS)).astype(np.int64)
        whole = np.searchsorted(starts, first + at, "right")
        inside = starts[whole] >= first + at + CHARS
        yield whole[inside] - 1, bucket[inside]


def _word_grams(docs: np.ndarray, hashes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for gaps, salt in (((0,), 5), ((0, 1), 6)):
        joint, owner = grams(hashes, docs, gaps, salt)
        yield owner, (joint >> np.uint64(64 - BITS)).astype(np.int64)


def _groups(texts: list[str | None]) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    """The parts of the word features and of the character features of some texts."""
    docs, hashes = space_words(texts)
    codes, starts = packed(texts)
    return [list(_word_grams(docs, hashes)), list(_char_grams(codes, starts))]


def raw_sums(texts: list[str | None], model: RulesModel) -> np.ndarray:
    """The linear predictor of each text."""
    out = np.full(len(texts), model.bias)
    for parts in _groups(texts):
        total, n = np.zeros(len(texts)), np.zeros(len(texts))
        for owner, bucket in parts:
            total += np.bincount(owner, model.weights[bucket], minlength=len(texts))
            n += np.bincount(owner, minlength=len(texts))
        out += _SCALE * total / np.maximum(n, 1)
    return out


def features(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, values) of each text, a bucket once."""
    shares: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in texts]
    for parts in _groups(texts):
        owner = np.concatenate([np.zeros(0, np.int64), *(o for o, _ in parts)])
        bucket = np.concatenate([np.zeros(0, np.int64), *(b for _, b in parts)])
        key, count = np.unique((owner << BITS) | bucket, return_counts=True)
        at = np.searchsorted(key, np.arange(len(texts) + 1) << BITS)
        for t in range(len(texts)):
            c = count[at[t] : at[t + 1]]
            shares[t].append((key[at[t] : at[t + 1]] & ((1 << BITS) - 1), _SCALE * c / max(1, c.sum())))
    out = []
    for both in shares:
        bucket, place = np.unique(np.concatenate([b for b, _ in both]), return_inverse=True)
        out.append((bucket, np.bincount(place, np.concatenate([v for _, v in both]), minlength=len(bucket))))
    return out


def counts(texts: list[str | None]) -> np.ndarray:
    """A row of word count, characters in words, symbols, repeated lines and words in repeated windows per text."""
    n = len(texts)
    out = np.zeros((n, len(_COUNTS)), np.int64)
    codes, starts = packed(texts)
    inside = np.append(0, np.cumsum(~((codes == 32) | ((codes >= 9) & (codes <= 13)))))
    marks = np.append(0, np.cumsum(np.isin(codes, [ord(c) for c in SYMBOLS])))
    out[:, 1] = inside[starts[1:]] - inside[starts[:-1]]
    out[:, 2] = marks[starts[1:]] - marks[starts[:-1]]
    names: dict[bytes, int] = {}
    ids: list[int] = []
    for i, text in enumerate(texts):
        words = (text or "").encode("utf-8", "surrogatepass").split()  # at exactly the white space of the contract
        out[i, 0] = len(words)
        ids += [names.setdefault(w, len(names)) for w in words]
        lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\r\v\f")]
        out[i, 3] = len(lines) - len(set(lines))
    ends = np.append(0, np.cumsum(out[:, 0]))
    owner = np.repeat(np.arange(n), out[:, 0])
    flat = np.array(ids, np.uint64)
    if len(flat) < WINDOW:
        return out
    last = len(flat) - WINDOW + 1
    key = mixed(owner[:last].astype(np.uint64), 3)
    for k in range(WINDOW):
        key = mixed(key + flat[k : last + k], k)
    at = np.flatnonzero(owner[:last] == owner[WINDOW - 1 :])
    order = at[np.argsort(key[at], kind="stable")]
    same = key[order][1:] == key[order][:-1]
    again = order[np.append(same, False) | np.append(False, same)]
    edge = np.zeros(len(flat) + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + WINDOW, -1)
    covered = np.append(0, np.cumsum(np.cumsum(edge[:-1]) > 0))
    out[:, 4] = covered[ends[1:]] - covered[ends[:-1]]
    return out


def descend(
    rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, bits: int = BITS, epochs: int = 8, rate: float = 0.3, l2: float = 1e-6
) -> tuple[np.ndarray, float]:
    """Weights and bias by stochastic gradient steps, one row each, the rate of a coordinate falling with its squared gradients."""
    weights, squares = np.zeros(1 << bits), np.full(1 << bits, 1e-4)
    bias, bias_squares = 0.0, 1e-4
    draw = np.random.default_rng(13)
    for _ in range(epochs):
        for i in draw.permutation(len(rows)).tolist():
            at, x = rows[i]
            w = weights[at]
            error = _sigmoid(float(x @ w) + bias) - labels[i]
            step = error * x + l2 * w
            squares[at] += step * step
            weights[at] = w - rate * step / np.sqrt(squares[at])
            bias_squares += error * error
            bias -= rate * error / bias_squares**0.5
    return weights, float(bias)


def calibrated(raw: np.ndarray, labels: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of the logistic curve that fits the labels best, targets drawn in by one row a class."""
    ones = labels.sum()
    target = np.where(labels > 0.5, (ones + 1) / (ones + 2), 1 / (len(labels) - ones + 2))
    x = np.column_stack([raw, np.ones(len(raw))])
    at = np.array([0.0, np.log((ones + 1) / (len(labels) - ones + 1))])

    def loss(v):
        z = x @ v
        return float((np.logaddexp(0, z) - target * z).sum()) + 1e-6 * float(v @ v)

    for _ in range(rounds):
        p = _sigmoid(x @ at)
        slope = x.T @ (p - target) + 2e-6 * at
        bend = (x * (p * (1 - p))[:, None]).T @ x + 2e-6 * np.eye(2)
        step, size = np.linalg.solve(bend, slope), 1.0
        while size > 1e-8 and loss(at - size * step) > loss(at):
            size /= 2
        if size * np.abs(step).max() < 1e-9:
            break
        at = at - size * step
    return float(at[0]), float(at[1])


def fit_on(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> RulesModel:
    """The model of rows of features; every fifth row is kept aside for the curve."""
    rate = float(labels.mean()) if len(labels) else 0.5
    if rate in (0.0, 1.0) or len(labels) < 10:
        return RulesModel(np.zeros(1 << BITS), 0.0, 1.0, float(np.log(rate / (1 - rate))) if 0 < rate < 1 else (np.inf if rate else -np.inf))
    aside = np.arange(len(rows)) % 5 == 4
    weights, bias = descend([r for r, a in zip(rows, aside, strict=True) if not a], labels[~aside])
    raw = np.array([float(x @ weights[at]) + bias for (at, x), a in zip(rows, aside, strict=True) if a])
    truth = labels[aside]
    curve = calibrated(raw, truth) if 0 < truth.mean() < 1 else (1.0, 0.0)
    return RulesModel(weights, bias, *curve)


def fit_rules(
    docs: DataFrame,
    labels: DataFrame,
    usable: Column,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "quality",
    sample: int = SAMPLE,
    sample_chars: int = SAMPLE_CHARS,
) -> RulesModel:
    """Fit on labelled rows for which ``usable``, a condition on the label table, holds, within both bounds of the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in slices(texts, RUN_CHARS):
                found = features(texts[lo:hi])
                ends = np.append(0, np.cumsum([len(b) for b, _ in found])).astype(np.int32)
                at = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([b for b, _ in found]).astype(np.int32)))
                value = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([v for _, v in found]).astype(np.float32)))
                label, place = (batch.column(c).slice(lo, hi - lo) for c in (0, 2))
                yield pa.RecordBatch.from_arrays([label, place, at, value], ["label", "place", "at", "value"])

    chosen = labelled_sample(docs, labels, usable, id_column, text_column, label_column, sample, sample_chars, 1 << BITS)
    table = chosen.mapInArrow(run, "label double, place long, at array<int>, value array<float>").toArrow()
    order, (at, value) = in_order(table, ["at", "value"])
    return fit_on(list(zip(at, value, strict=True)), table.column("label").to_numpy()[order])


def _judged(held: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: RulesModel = held.value
        for batch in batches:
            sizes = pa.compute.utf8_length(batch.column(1)).fill_null(0).to_pylist()
            for lo, hi in slices([range(n) for n in sizes], RUN_CHARS):  # only the sizes count
                texts = batch.column(1).slice(lo, hi - lo).to_pylist()
                found = counts(texts)
                failed = (found[:, 0] < LEAST_WORDS) | (100 * found[:, 4] > MOST_REPEATED * found[:, 0])
                score = model.probability(raw_sums(texts, model))
                columns = [pa.array(np.ascontiguousarray(found[:, c])) for c in range(len(_COUNTS))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), *columns, pa.array(failed), pa.array(score), pa.array(~failed & (score >= KEEP_FROM))],
                    ["id", *_COUNTS, "base_failed", "score", "kept"],
                )

    return run


def quality_rules(docs: DataFrame, model: RulesModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept) of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    taken = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = taken.schema["id"].dataType.simpleString()
    shape = f"id {kind}, {', '.join(f'{c} long' for c in _COUNTS)}, base_failed boolean, score double, kept boolean"
    return taken.mapInArrow(_judged(held), shape).withColumnRenamed("id", id_column)
