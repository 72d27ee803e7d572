"""Quality rules, periodic runs and hard negatives against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from tagtrail.llm import hard_negatives as hn
from tagtrail.llm import queries
from tagtrail.llm.periodic_runs import collapsed, periodic_runs, runs_of, split_words, strongest, text_runs
from tagtrail.llm.quality_rules import calibrated, counts, descend, features, fit_rules, quality_rules, raw_sums
from tagtrail.llm.sampling import bounded_sample

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(None, "no id"), (900, None), (901, ""), (902, " \n "), (903, "a b\x1c c"), (904, "word " * 200_000), (905, "x" * 1_200_000), (905, "twice twice")]


def frame(spark, rows):
    """Documents with columns whose names the operators use inside."""
    rows = [(i, t, 1, 0.5, "p", True) for i, t in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, id int, score double, place string, kept boolean")


# periodic runs


def plain_runs(words, exponent, least):
    """Every run by comparing the words with themselves, a period at a time."""
    names: dict = {}
    w = np.array([names.setdefault(x, len(names)) for x in words])
    found, n = [], len(w)
    for q in range(1, n // exponent + 1):
        same = np.concatenate([[False], w[q:] == w[:-q], [False]])
        edge = np.flatnonzero(np.diff(same.astype(int)))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            length = b - a + q
            if length >= max(least, exponent * q) and not any((w[a : a + length - r] == w[a + r : a + length]).all() for r in range(1, q)):
                found.append((a, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("letters", [1, 2, 3, 6])
def test_runs_equal_brute_force(letters):
    rng = random.Random(letters)
    for _ in range(250):
        w = [rng.randrange(letters) for _ in range(rng.randrange(70))]
        if w and rng.random() < 0.6:
            at, q = rng.randrange(len(w)), rng.randrange(1, 9)
            part = w[at : at + q] or [7]
            w[at:at] = [part[j % len(part)] for j in range(rng.randrange(5, 60))]
        assert runs_of(w, 2, 2) == plain_runs(w, 2, 2)
        named = [str(x).encode() for x in w]
        for exponent, least in ((4, 6), (3, 5), (2, 4)):  # through windows
            assert text_runs([named, [], named[::-1]], exponent, least) == [plain_runs(x, exponent, least) for x in (w, [], w[::-1])]


def planted(doc_id, text):
    """The words of a document as the contract of the query changes them."""
    words = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def plain_row(doc_id, text):
    words = planted(doc_id, text)
    runs = plain_runs(words, 4, 6)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-(r[1] * 10**12 // r[2]), r[0], r[2])) if runs else (None,) * 3
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    sha = [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in (lines, kept)]
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, *sha)


def test_query_of_runs_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    want = sorted(plain_row(*r) for r in docs)
    got = sorted(tuple(r) for r in queries.QUERIES["op12_periodic_runs"](spark, SMALL).collect())
    assert got == want and sum(r[1] > 0 for r in got) > 10


def test_runs_of_odd_texts(spark, rows):
    docs = frame(spark, [*ODD, (1, "go " + "a b c " * 5 + "end"), (2, "x\ty\u000bx y x y x\ny z")])
    got = {(r.doc_id, r.n_words): r for r in periodic_runs(docs.repartition(3)).collect()}
    assert len(got) == len(ODD) + 2
    assert got[900, 0].runs == [] and got[900, 0].collapsed == "" and got[902, 0].collapsed == ""
    assert got[903, 2].collapsed == "a b\x1c c"  # other white space does not end a word
    assert [tuple(r) for r in got[904, 200_000].runs] == [(0, 200_000, 1)] and got[904, 200_000].collapsed == "word"
    assert got[905, 1].runs == [] and got[905, 2].collapsed == "twice twice" and got[None, 2].runs == []
    assert [tuple(r) for r in got[1, 17].runs] == [(1, 15, 3)] and got[1, 17].collapsed == "go a b c end"
    assert [tuple(r) for r in got[2, 9].runs] == [(0, 8, 2)]
    assert periodic_runs(docs.limit(0)).collect() == []


def test_strongest_run_compares_exactly(spark):
    runs = [[(0, 9, 2), (3, 90, 20)], [(7, 8, 1), (2, 16, 2), (2, 8, 1)], []]
    table = spark.createDataFrame([(r,) for r in runs], "runs array<struct<start: long, length: long, period: long>>")
    got = [r[0] and tuple(r[0]) for r in table.select(strongest(F.col("runs"))).collect()]
    assert got == [(0, 9, 2), (2, 8, 1), None]


def test_collapsing_keeps_the_first_period_of_each_run():
    words = split_words("z a b a b a b a b y y y y y y q")
    assert collapsed(words, text_runs([words])[0]) == "z a b y q"


# quality rules


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    triples = Counter(zip(words, words[1:], words[2:], strict=False))
    again = {i + k for i in range(len(words) - 2) if triples[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen: set = set()
    dup = sum(x in seen or seen.add(x) is not None for x in lines)
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(again)]


def test_counts_equal_brute_force(spark):
    texts = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    texts += [t for _, t in ODD[:5]] + ["a b c a b c a", "a a a a", "\n\n x\n x\nx\n\t\n", "é ü é ü é ü é", "𝒳 # 𝒳 #\n#"]
    assert counts(texts).tolist() == [plain_counts(t) for t in texts]


def test_rules_learn_and_judge_every_row(spark):
    rng = random.Random(4)
    texts, marks = [], []
    for k in range(300):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(80)]
        if k % 4 == 0:
            words = [w + "!!" for w in words]
        texts.append((k, " ".join(words)))
        marks.append((k, int(k % 4 != 0)))
    marks += [(None, 1), (5, None), (6, 7), (9999, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    docs = frame(spark, [*texts, *ODD])
    learn = F.col("doc_id") < 200
    model = fit_rules(docs.repartition(3), labels, learn)
    moved = fit_rules(docs.repartition(7), labels.repartition(2), learn)
    assert (model.weights == moved.weights).all() and (model.bias, model.slope, model.offset) == (moved.bias, moved.slope, moved.offset)
    got = quality_rules(docs, model).collect()
    assert len(got) == len(texts) + len(ODD)
    by_id = {r.doc_id: r for r in got if r.doc_id is not None and r.doc_id < 300}
    assert all(by_id[k].kept == (k % 4 != 0) for k in range(300)) and all(0 <= r.score <= 1 for r in got)
    odd = {(r.doc_id, r.n_words): r for r in got}
    assert all(odd[k].base_failed and not odd[k].kept for k in ((900, 0), (901, 0), (902, 0), (None, 2), (904, 200_000), (905, 1)))
    assert quality_rules(docs.limit(0), model).collect() == []
    none = fit_rules(docs, labels.limit(0), learn)
    assert {r.score for r in quality_rules(docs, none).collect()} == {0.5}
    one = fit_rules(docs, labels.where("quality = 1"), learn)
    assert {r.score for r in quality_rules(docs, one).collect()} == {1.0}


def test_descent_equals_a_loop_over_coordinates():
    rng = np.random.default_rng(5)
    rows = [(np.sort(rng.choice(32, 6, replace=False)), rng.random(6)) for _ in range(60)]
    labels = rng.integers(0, 2, 60).astype(float)
    weights, bias = descend(rows, labels, bits=5, epochs=2)
    w, g, b, gb = [0.0] * 32, [1e-4] * 32, 0.0, 1e-4
    draw = np.random.default_rng(13)
    for _ in range(2):
        for i in draw.permutation(60).tolist():
            error = 1 / (1 + np.exp(-(sum(x * w[c] for c, x in zip(*rows[i], strict=True)) + b))) - labels[i]
            for c, x in zip(*rows[i], strict=True):
                step = error * x + 1e-6 * w[c]
                g[c] += step * step
                w[c] -= 0.3 * step / g[c] ** 0.5
            gb += error * error
            b -= 0.3 * error / gb**0.5
    assert np.allclose(weights, w) and np.isclose(bias, b)


def test_calibration_meets_the_shares():
    rng = np.random.default_rng(6)
    raw = rng.normal(0, 3, 4000)
    labels = (rng.random(4000) < 1 / (1 + np.exp(-(0.7 * raw - 1)))).astype(float)
    slope, offset = calibrated(raw, labels)
    assert abs(slope - 0.7) < 0.06 and abs(offset + 1) < 0.15


def test_features_give_the_scored_sums():
    texts = ["Some words and some more words", "", None, "é" * 3, "x y " * 50]
    weights = np.random.default_rng(7).normal(size=1 << 18)
    model = queries.fit_rules.__globals__["RulesModel"](weights, 0.25)
    want = [float(v @ weights[b]) + 0.25 for b, v in features(texts)]
    assert np.allclose(raw_sums(texts, model), want)


def test_held_out_rows_are_judged_well(spark):
    folder = SMALL.replace("sf0.001", "sf0.01")
    got = queries.QUERIES["op11_quality_rules"](spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet").withColumnRenamed("doc_id", "i")
    held = got.join(labels, F.col("i") == F.col("doc_id")).where("crc32(cast(doc_id as string)) % 4 = 2 AND NOT base_failed").collect()
    good = [r.kept for r in held if r.quality == 1]
    poor = [r.kept for r in held if r.quality == 0]
    assert sum(good) >= 0.97 * len(good) and sum(poor) <= 0.2 * len(poor) and len(held) > 60


def test_sample_is_bounded_in_rows_and_weight(spark):
    table = spark.createDataFrame([(1, "same")] * 3000 + [(1, f"t{k}") for k in range(500)] + [(None, None)], "id long, text string")
    size = F.length("text")
    picked = bounded_sample(table, ["id", "text"], size, 100, 10_000).collect()
    assert 50 < len(picked) <= 100 and len({(r.id, r.text) for r in picked}) == len(picked)
    assert sum(len(r.text or "") for r in bounded_sample(table, ["id", "text"], size, 10_000, 200).collect()) <= 200
    assert bounded_sample(table, ["id", "text"], size, 10_000, 10_000).count() == 502
    assert bounded_sample(table, ["id", "text"], size, 0, 0).count() == 1
    assert bounded_sample(table.limit(0), ["id", "text"], size, 5, 5).count() == 0
    again = bounded_sample(table.repartition(5), ["id", "text"], size, 100, 10_000).collect()
    assert sorted(r.place for r in again) == sorted(r.place for r in picked)


# hard negatives


def plain_negatives(rows, anchor, positives=5, negatives=5):
    """All scores of all pairs in Python's whole numbers."""
    top = 2**63 - 1
    held = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        held.append((i, label, [max(-top, min(top, int(np.floor(256 * np.float64(x))))) for x in v]))
    out = []
    for k, (i, label, v) in enumerate(held):
        if not anchor(i):
            continue
        score = [(max(-top, min(top, sum(a * b for a, b in zip(v, w, strict=False)))), j, other) for m, (j, other, w) in enumerate(held) if m != k]
        score.sort(key=lambda s: (-s[0], s[1]))
        for p, j, _ in [s for s in score if s[2] == label][:positives]:
            fit = [s for s in score if s[2] != label and 80 * p <= 100 * s[0] <= 100 * p][:negatives]
            out += [(i, j, rank, m, p, s) for rank, (s, m, _) in enumerate(fit, 1)]
    return sorted(out)


def vectors(spark, rows):
    """Vectors with columns whose names the operator uses inside."""
    rows = [(*r, 1, "b", 0.5) for r in rows]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, block int, key string, length double")


def mined(spark, rows, **more):
    table = vectors(spark, rows)
    return sorted(tuple(r) for r in hn.hard_negatives(table.repartition(3), F.col("vec_id") % 10 == 0, F.col("label"), **more).collect())


@pytest.mark.parametrize("kind", ["even", "groups", "lengths"])
def test_negatives_equal_brute_force(spark, kind, monkeypatch):
    monkeypatch.setattr(hn, "BUCKET", 32)
    monkeypatch.setattr(hn, "BLOCK_CELLS", 8 * 60)
    rng = np.random.default_rng(len(kind))
    centres = rng.normal(size=(6, 8)) * 3
    rows = []
    for i in range(400):
        v = rng.normal(size=8) if kind != "groups" else centres[i % 6] + 0.2 * rng.normal(size=8)
        rows.append((i, (v * (np.exp(rng.normal()) if kind == "lengths" else 1)).tolist(), int(rng.integers(0, 4))))
    rows += [(1000 + i, [0.5] * 8, i % 2) for i in range(60)]  # ties
    assert mined(spark, rows) == plain_negatives(rows, lambda i: i % 10 == 0)


def test_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, [1.0, 1.9], 0), (2, [1.0, 1.9], 0), (0, [0.5, 0.5], 0), (3, [1.0], 1), (4, [], 2)]
    rows += [(5, None, 1), (6, [1.0, None], 1), (7, [nan, 1.0], 1), (8, [inf, 1.0], 1), (None, [1.0, 2.0], 1), (9, [1.0, 2.0], None), (10, [0.0, 0.0], 0)]
    rows += [(20, [-1.0, -1.0], 5), (21, [1.0, 1.0], 5), (30, [1e9, -1e9, 1e9], 6), (31, [1e9, 1e9, 1e9], 6), (32, [1e9, 1e9, 0.9e9], 7)]
    want = plain_negatives(rows, lambda i: i % 10 == 0)
    assert mined(spark, rows) == want and len(want) > 10
    assert mined(spark, rows[:1]) == [] and mined(spark, []) == []
    huge = [(0, [1e300, 1.0], 0), (1, [1e300, 2.0], 0), (2, [1e300, 3.0], 1)]
    assert [r[:4] for r in mined(spark, huge)] == [(0, 1, 1, 2)]
    with pytest.raises(TypeError):
        hn.hard_negatives(vectors(spark, []).withColumn("vec_id", F.lit("a")), F.lit(True), F.col("label"))


def test_lists_rule_rows_out():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(20, 16))
    near = centres[rng.integers(0, 20, 1000)] + 0.05 * rng.normal(size=(1000, 16))
    rows = np.floor(256 * near / np.linalg.norm(near, axis=1)[:, None]).astype(np.int64)  # a bucket holds about one length
    length = np.sqrt((rows.astype(float) ** 2).sum(axis=1))
    bucket = hn.Bucket(np.arange(1000), np.arange(1000), np.zeros(1000), rows, length)
    exact = rows[:50] @ rows.T
    least = np.sort(exact, axis=1)[:, -6].astype(float)
    at, row, score, verified = bucket.scored(rows[:50], length[:50], least)
    want = {(a, r, exact[a, r]) for a, r in zip(*np.nonzero(exact >= least[:, None]), strict=True)}
    assert set(zip(at.tolist(), row.tolist(), score.tolist(), strict=True)) == {tuple(map(int, x)) for x in want}
    assert verified < 0.3 * exact.size
