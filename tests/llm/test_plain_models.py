"""The fitted models against plain loops and closed solutions."""

from __future__ import annotations

from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from tagtrail.llm.language import _descend, fit_language, predict_language
from tagtrail.llm.main_text import main_text
from tagtrail.llm.quality import STATISTICS, fit_quality, fourier, text_statistics
from tagtrail.llm.toxicity import fit_toxicity, ftrl, toxicity


def test_follow_the_leader_equals_a_plain_loop():
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 64, rng.integers(1, 12))) for _ in range(120)]
    labels = rng.integers(0, 2, 120).astype(float)
    alpha, beta, l1 = 0.5, 1.0, 0.4
    got = ftrl(rows, labels, bits=6, alpha=alpha, beta=beta, l1=l1, epochs=2)
    z, n, zb, nb = [0.0] * 64, [0.0] * 64, 0.0, 0.0

    def weight(i):
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - (l1 if z[i] > 0 else -l1)) / ((beta + n[i] ** 0.5) / alpha)

    order = np.random.default_rng(11)
    for _ in range(2):
        for r in order.permutation(120):
            ws = {int(i): weight(int(i)) for i in rows[r]}
            bias = -zb / ((beta + nb**0.5) / alpha)
            g = 1 / (1 + np.exp(-(sum(ws.values()) + bias))) - labels[r]
            for i, w in ws.items():
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / alpha * w
                n[i] += g * g
            zb += g - ((nb + g * g) ** 0.5 - nb**0.5) / alpha * bias
            nb += g * g
    want = np.array([weight(i) for i in range(64)])
    assert np.allclose(got.table(), want, atol=1e-6) and 0 < (want != 0).sum() < 64
    assert got.bias == pytest.approx(-zb / ((beta + nb**0.5) / alpha))


def test_language_descends_like_a_plain_loop():
    rng = np.random.default_rng(2)
    shares = rng.random((90, 12))
    shares /= shares.sum(axis=1, keepdims=True)
    target = rng.integers(0, 3, 90)
    got = _descend(shares, target, ["a", "b", "c"], dimensions=4, epochs=3, rate=2.0, reject=0.05)
    draw = np.random.default_rng(5)
    order = draw.permutation(90)
    aside, learn = order[:18], order[18:]
    e = draw.normal(0.0, 0.25, (12, 4)).tolist()
    layer, bias = [[0.0] * 3 for _ in range(4)], [0.0] * 3

    def logits(x):
        h = [sum(x[b] * e[b][d] for b in range(12)) for d in range(4)]
        return h, [sum(h[d] * layer[d][c] for d in range(4)) + bias[c] for c in range(3)]

    steps, step = 3 * (72 // 32 + 1), 0
    for _ in range(3):
        mixed = draw.permutation(learn)
        for lo in range(0, 72, 32):
            part = mixed[lo : lo + 32]
            pace = 2.0 * (1 - step / steps) / len(part)
            gl, gb, ge = np.zeros((4, 3)), np.zeros(3), np.zeros((12, 4))
            for r in part:
                h, z = logits(shares[r])
                p = np.exp(z) / np.exp(z).sum()
                p[target[r]] -= 1
                gl += np.outer(h, p)
                gb += p
                ge += np.outer(shares[r], np.array(layer) @ p)
            layer = (np.array(layer) - 0.1 * pace * gl).tolist()
            bias = (np.array(bias) - 0.01 * pace * gb).tolist()
            e = (np.array(e) - pace * ge).tolist()
            step += 1
    assert np.allclose(got.embeddings, e) and np.allclose(got.layer, layer) and np.allclose(got.bias, bias)
    z = np.array([logits(shares[r])[1] for r in aside])
    losses = {}
    for t in (2.0**k for k in range(-4, 5)):
        p = np.exp(z / t) / np.exp(z / t).sum(axis=1, keepdims=True)
        losses[t] = -np.log(p[np.arange(18), target[aside]]).mean()
    assert got.temperature == min(losses, key=losses.get)


def test_quality_solves_the_plain_ridge(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    from tagtrail.llm.quality import measured

    model = fit_quality(measured(docs.repartition(4)), labels, F.lit(True), features=40)
    rows = docs.join(labels, "doc_id").select("text", "quality").collect()
    x, y = text_statistics([r.text for r in rows]), np.array([r.quality for r in rows], float)
    scale = np.where(x.std(axis=0) > 1e-9, x.std(axis=0), 1.0)
    assert np.allclose(model.mean, x.mean(axis=0)) and np.allclose(model.scale, scale)
    draw = np.random.default_rng(23)
    frequency, phase = draw.normal(0.0, 0.25, (len(STATISTICS), 40)), draw.uniform(0, 2 * np.pi, 40)
    z = fourier(x, x.mean(axis=0), scale, frequency, phase)
    penalty = 1e-3 * len(x) / 41
    want = np.linalg.lstsq(np.vstack([z, penalty**0.5 * np.eye(41)]), np.append(y, np.zeros(41)), rcond=None)[0]
    assert np.allclose(z @ model.weights[:, None].ravel(), z @ want, atol=1e-6)
    raw, level = z @ want, model.score(x)
    order = np.argsort(raw)
    assert (np.diff(level[order]) >= -1e-9).all() and abs(level.mean() - y.mean()) < 0.02


@pytest.mark.parametrize("kind", ["language", "toxicity"])
def test_models_do_not_depend_on_partitions_or_repeats(spark, kind):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    shapes = [docs, docs.repartition(7), docs.repartition(3).union(docs.limit(60))]
    results = []
    for d in shapes:
        if kind == "language":
            model = fit_language(d, F.col("doc_id") % 3 != 1, sample=150)
            out = predict_language(docs, model).select("doc_id", "lang_pred", "score")
        else:
            out = toxicity(docs, fit_toxicity(d, labels.repartition(5), F.lit(True), sample=60))
        results.append(sorted(map(tuple, out.collect())))
    assert results[0] == results[1] == results[2]


def test_samples_stay_bounded_where_an_id_is_repeated(spark):
    rows = spark.range(20_000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("word "), "id").alias("text"), F.lit("en").alias("lang"))
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    from tagtrail.llm.sampling import bounded_sample, labelled_sample

    assert 0 < labelled_sample(rows, labels, F.lit(True), "doc_id", "text", "toxic", 100, 10_000).count() <= 100
    named = rows.select(F.col("doc_id").alias("id"), "text")
    assert 0 < sum(len(r.text) for r in bounded_sample(named, ["id", "text"], F.length("text"), 10_000, 2_000).collect()) <= 2_000


class Article(HTMLParser):
    """The blocks of the article of a page, with the parser of the standard library."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.held, self.depth = [], [], 0

    def flush(self):
        text = " ".join("".join(self.held).split())
        self.held = []
        self.blocks += [text] if text else []

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        if tag not in ("a", "b"):
            self.flush()

    def handle_endtag(self, tag):
        if tag not in ("a", "b"):
            self.flush()
        self.depth -= tag == "article"

    def handle_data(self, data):
        if self.depth:
            self.held.append(data)


def test_main_text_equals_a_plain_parser(spark):
    pages = spark.read.parquet(f"{SMALL.replace('sf0.001', 'sf0.01')}/pages.parquet")
    got = {r.page_id: r.text for r in main_text(pages).collect()}
    want = {}
    for r in pages.collect():
        parser = Article()
        parser.feed(r.html or "")
        parser.close()
        parser.flush()
        want[r.page_id] = "\n".join(parser.blocks)
    assert got == want and len(got) == 250
