"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct buckets of its words, word pairs, pairs with
one word left out, and word triples, each with value 1. Every coordinate has its own
learning rate, and the L1 term keeps all but a few weights at exactly zero: the
model is a sorted list of buckets and weights, at most ``2**bits`` of them and in practice
some thousands, so it may be sent to every task.

The model is fitted on at most ``sample`` labelled rows with ``sample_chars`` characters, chosen and ordered by a hash of
id and text, so it depends on neither partitions nor repeats; their buckets, not their texts, come to the driver. Scoring reads whole
texts in bounded steps.

Defined cases: a null or empty text, or one without words, has no features and
gets the score of the bias alone. Labels other than 0 and 1, and null ids, are not
learned from. Without labelled rows the model is empty and each score is 0.5;
with one class only, the bias follows that class. Repeated rows are scored one by one. Only the
named columns are read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagtrail.llm.batches import giving_back, grams, plain_words, slices
from tagtrail.llm.sampling import in_order, labelled_sample

BITS = 20
#: Offsets of the words that make one feature.
SHAPES = ((0,), (0, 1), (0, 2), (0, 1, 2))
#: Bounds of the sample: rows, and characters, of which each brings two features at most.
SAMPLE = 12_000
SAMPLE_CHARS = 48_000_000


@dataclass(frozen=True)
class Weights:
    """Bias and the buckets with a weight, in ascending order."""

    bias: float
    buckets: np.ndarray
    values: np.ndarray
    bits: int = BITS

    def table(self) -> np.ndarray:
        full = np.zeros(1 << self.bits, np.float32)
        full[self.buckets] = self.values
        return full


def bucketed(texts: list[str | None], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, bucket) of every feature occurrence, one shape after the other."""
    docs, hashes = plain_words(texts)
    for k, shape in enumerate(SHAPES):
        joint, owner = grams(hashes, docs, shape, 101 + k)
        yield owner, (joint >> np.uint64(64 - bits)).astype(np.int64)


def _features(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in slices(texts):
                found = list(bucketed(texts[lo:hi], bits))
                owner, bucket = (np.concatenate(x) for x in zip(*found, strict=True))
                key = np.unique((owner << bits) | bucket)
                ends = np.append(0, np.cumsum(np.bincount(key >> bits, minlength=hi - lo))).astype(np.int32)
                held = pa.ListArray.from_arrays(ends, pa.array((key & ((1 << bits) - 1)).astype(np.int32)))
                label, place = (batch.column(c).slice(lo, hi - lo) for c in (0, 2))
                yield pa.RecordBatch.from_arrays([label, place, held], ["label", "place", "buckets"])

    return run


def ftrl(
    rows: list[np.ndarray],
    labels: np.ndarray,
    bits: int = BITS,
    alpha: float = 3.0,
    beta: float = 1.0,
    l1: float = 8.0,
    l2: float = 0.0,
    epochs: int = 4,
) -> Weights:
    """Follow the regularised leader over rows of bucket numbers, in a fixed random order."""
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    z_bias = n_bias = 0.0
    order = np.random.default_rng(11)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, y = rows[i], labels[i]
            zs, ns = z[at], n[at]
            root = np.sqrt(ns)
            w = np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((beta + root) / alpha + l2))
            bias = -z_bias / ((beta + n_bias**0.5) / alpha)
            p = 1.0 / (1.0 + np.exp(-np.clip(w.sum() + bias, -30.0, 30.0)))
            g = p - y
            rate = (np.sqrt(ns + g * g) - root) / alpha
            z[at] = zs + g - rate * w
            n[at] = ns + g * g
            z_bias += g - ((n_bias + g * g) ** 0.5 - n_bias**0.5) / alpha * bias
            n_bias += g * g
    live = np.flatnonzero(np.abs(z) > l1)
    values = -(z[live] - np.sign(z[live]) * l1) / ((beta + np.sqrt(n[live])) / alpha + l2)
    return Weights(-z_bias / ((beta + n_bias**0.5) / alpha), live, values, bits)


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    usable: Column,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "toxic",
    sample: int = SAMPLE,
    sample_chars: int = SAMPLE_CHARS,
    bits: int = BITS,
) -> Weights:
    """Weights from labelled rows for which ``usable``, a condition on the label table, holds: ``sample`` rows
    and ``sample_chars`` characters at most, learned from in the order of a hash."""
    chosen = labelled_sample(docs, labels, usable, id_column, text_column, label_column, sample, sample_chars, 1 << bits)
    rows = chosen.mapInArrow(giving_back(_features(bits)), "label double, place long, buckets array<int>").toArrow()
    order, (found,) = in_order(rows, ["buckets"])
    return ftrl(found, rows.column("label").to_numpy()[order], bits)


def _scored(weights: Weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = weights.table()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            total = np.full(len(texts), weights.bias)
            for lo, hi in slices(texts):
                keys = []
                for owner, bucket in bucketed(texts[lo:hi], weights.bits):
                    live = table[bucket] != 0
                    keys.append((owner[live] << weights.bits) | bucket[live])
                key = np.unique(np.concatenate(keys))
                values = table[key & ((1 << weights.bits) - 1)].astype(np.float64)
                total[lo:hi] += np.bincount(key >> weights.bits, values, minlength=hi - lo)
            score = 1.0 / (1.0 + np.exp(-np.clip(total, -30.0, 30.0)))
            kept = [batch.column(i) for i, n in enumerate(batch.schema.names) if n != "text"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(score)], [*(n for n in batch.schema.names if n != "text"), "score"])

    return run


def toxicity(docs: DataFrame, weights: Weights, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, score) of every row; the score is between 0 and 1."""
    taken = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = taken.schema["id"].dataType.simpleString()
    return taken.mapInArrow(giving_back(_scored(weights)), f"id {kind}, score double").withColumnRenamed("id", id_column)
