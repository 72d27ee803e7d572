"""Language identification by averaged hashed subword embeddings and a linear softmax.

The subwords of a text are the runs of 1 to 4 code points of its words in lower
case, with a mark at both ends of each word, hashed into buckets. The mean of their embeddings goes
through a linear layer and a softmax. Embeddings and layer are learned by stochastic gradient descent in
numpy on at most ``sample`` rows with a known language; what comes to the driver
are bucket counts of the sampled rows, never texts. A fifth of them is kept aside: on it the
temperature of the softmax is chosen, and the score below which a prediction
counts as rejected is the ``reject`` quantile of the scores of right answers.

Prediction reads whole texts in bounded steps and keeps one row of bucket counts
per text. Defined cases: a null text, or one without a letter, is ``und`` with score 0
and rejected. Equal shares go to the language first in the alphabet. Without any labelled row every
text is ``und``. Repeated rows are judged one by one; only the named columns are
read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagtrail.llm.batches import LETTER, STEP, Rolling, flags, lowered, mixed, packed, slices
from tagtrail.llm.sampling import bounded_sample

BUCKETS = 1 << 12
WIDTHS = (1, 2, 3, 4)
SAMPLE = 6_000
UNKNOWN = "und"
_EDGE = 0x110000  # no code point


@dataclass(frozen=True)
class LanguageModel:
    """Embeddings, layer and calibration; some hundred kilobytes at any input size."""

    languages: list[str]
    embeddings: np.ndarray
    layer: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def shares(self, counts: np.ndarray) -> np.ndarray:
        """Calibrated probability of each language for rows of bucket counts."""
        mean = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1.0)
        return _softmax((mean @ self.embeddings @ self.layer + self.bias) / self.temperature)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _add_counts(counts: np.ndarray, codes: np.ndarray, starts: np.ndarray) -> None:
    """Add the subwords of the packed texts to their rows of ``counts``."""
    letter = (flags(codes) & LETTER) > 0
    n = len(starts) - 1
    # every text is followed by one edge mark; what is no letter is one too
    owner = np.repeat(np.arange(n), np.diff(starts) + 1)
    place = np.arange(len(codes)) + np.repeat(np.arange(n), np.diff(starts))
    marked = np.full(len(codes) + n, _EDGE, np.uint32)
    marked[place] = np.where(letter, lowered(codes), _EDGE)
    marked = np.concatenate([[np.uint32(_EDGE)], marked])  # so the first word has its left mark
    owner = np.concatenate([[0], owner])
    edge = marked == _EDGE
    hashes = Rolling(marked)
    inner_edges = np.concatenate([[0], np.cumsum(edge)])
    size = counts.shape[1]
    for width in WIDTHS:
        last = len(marked) - width
        if last < 0:
            break
        at = np.arange(last + 1)
        # marks only at the ends
        if width == 1:
            fits = ~edge
        elif width == 2:
            fits = ~(edge[at] & edge[at + 1])
        else:
            fits = inner_edges[at + width - 1] == inner_edges[at + 1]
        at = at[fits]
        bucket = (mixed(hashes.of(at, at + width), width) >> np.uint64(40)).astype(np.int64) % size
        counts += np.bincount(owner[at + width // 2] * size + bucket, minlength=n * size).reshape(n, size)


def subword_counts(texts: list[str | None], buckets: int = BUCKETS) -> np.ndarray:
    """A row of bucket counts per text. Texts beyond a step are cut at step ends, where a word ends too."""
    counts = np.zeros((len(texts), buckets))
    codes, starts = packed(texts)
    if len(texts) == 1 and len(codes) > STEP:
        for at in range(0, len(codes), STEP):
            part = codes[at : at + STEP]
            _add_counts(counts, part, np.array([0, len(part)]))
    else:
        _add_counts(counts, codes, starts)
    return counts


def _runs(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray]]:
    for lo, hi in slices(texts):
        for at in range(lo, hi, 256):
            end = min(hi, at + 256)
            yield at, end, subword_counts(texts[at:end])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, counts in _runs(batch.column(1).to_pylist()):
            live = counts > 0
            ends = np.append(0, np.cumsum(live.sum(axis=1))).astype(np.int32)
            at = pa.ListArray.from_arrays(ends, pa.array(np.nonzero(live)[1].astype(np.int32)))
            share = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1.0)
            values = pa.ListArray.from_arrays(ends, pa.array(share[live].astype(np.float32)))
            lang, place = (batch.column(c).slice(lo, hi - lo) for c in (0, 2))
            yield pa.RecordBatch.from_arrays([lang, place, at, values], ["lang", "place", "at", "share"])


def fit_language(
    docs: DataFrame,
    usable: Column,
    id_column: str = "doc_id",
    text_column: str = "text",
    lang_column: str = "lang",
    sample: int = SAMPLE,
    dimensions: int = 16,
    epochs: int = 12,
    rate: float = 20.0,
    reject: float = 0.01,
) -> LanguageModel:
    """Fit on ``sample`` rows at most with a language for which ``usable``, a condition on the id, holds, in the order of a hash."""
    named = docs.where(usable & F.col(lang_column).isNotNull() & F.col(text_column).isNotNull())
    named = named.select(F.col(id_column).alias("id"), F.col(lang_column).alias("lang"), F.col(text_column).alias("text"))
    chosen = bounded_sample(named, ["id", "text", "lang"], F.lit(0), sample, 0).select("lang", "text", "place")
    rows = chosen.mapInArrow(_counted, "lang string, place long, at array<int>, share array<float>").toArrow().sort_by("place")
    if not rows.num_rows:
        return LanguageModel([], np.zeros((BUCKETS, 1)), np.zeros((1, 0)), np.zeros(0))
    shares = np.zeros((rows.num_rows, BUCKETS), np.float32)
    at, share = (rows.column(c).combine_chunks() for c in ("at", "share"))
    owner = np.repeat(np.arange(len(at)), np.asarray(at.value_lengths()))
    shares[owner, np.asarray(at.flatten())] = np.asarray(share.flatten())
    names, target = np.unique(np.array(rows.column("lang").to_pylist(), dtype=object).astype(str), return_inverse=True)
    return _descend(shares, target, [str(x) for x in names], dimensions, epochs, rate, reject)


def _descend(shares, target, names, dimensions, epochs, rate, reject) -> LanguageModel:
    draw = np.random.default_rng(5)
    order = draw.permutation(len(shares))
    aside, learn = order[: len(order) // 5], order[len(order) // 5 :]
    embeddings = draw.normal(0.0, 1.0 / dimensions, (shares.shape[1], dimensions))
    layer, bias = np.zeros((dimensions, len(names))), np.zeros(len(names))
    steps, step = max(1, epochs * (len(learn) // 32 + 1)), 0
    for _ in range(epochs):
        mixed_up = draw.permutation(learn)
        for lo in range(0, len(mixed_up), 32):
            x, y = shares[mixed_up[lo : lo + 32]].astype(np.float64), target[mixed_up[lo : lo + 32]]
            hidden = x @ embeddings
            error = _softmax(hidden @ layer + bias)
            error[np.arange(len(y)), y] -= 1.0
            pace = rate * (1.0 - step / steps) / len(y)
            back = error @ layer.T
            layer -= 0.1 * pace * hidden.T @ error
            bias -= 0.01 * pace * error.sum(axis=0)
            embeddings -= pace * x.T @ back
            step += 1
    model = LanguageModel(names, embeddings, layer, bias)
    if not len(aside):
        return model
    held, truth = shares[aside].astype(np.float64), target[aside]
    logits = held @ embeddings @ layer + bias

    def loss(t: float) -> float:
        return -float(np.log(_softmax(logits / t)[np.arange(len(truth)), truth] + 1e-300).mean())

    temperature = min((2.0**k for k in range(-4, 5)), key=loss)
    sure = _softmax(logits / temperature)
    right = sure.argmax(axis=1) == truth
    threshold = float(np.quantile(sure.max(axis=1)[right], reject)) if right.any() else 0.0
    return LanguageModel(names, embeddings, layer, bias, temperature, threshold)


def _predicted(model: LanguageModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            best = np.zeros(len(texts))
            names = [UNKNOWN] * len(texts)
            for lo, hi, counts in _runs(texts):
                if not model.languages:
                    continue
                shares = model.shares(counts)
                top = shares.argmax(axis=1)
                some = counts.any(axis=1)
                best[lo:hi] = np.where(some, shares.max(axis=1), 0.0)
                for i in np.flatnonzero(some):
                    names[lo + i] = model.languages[top[i]]
            none = np.array([n == UNKNOWN for n in names], bool)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names), pa.array(best), pa.array(none | (best < model.threshold))],
                ["id", "lang_pred", "score", "rejected"],
            )

    return run


def predict_language(docs: DataFrame, model: LanguageModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, lang_pred, score, rejected) of every row."""
    taken = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = taken.schema["id"].dataType.simpleString()
    out = taken.mapInArrow(_predicted(model), f"id {kind}, lang_pred string, score double, rejected boolean")
    return out.withColumnRenamed("id", id_column)
