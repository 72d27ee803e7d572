"""Near duplicates, benchmark matches and neighbours against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagtrail.llm.components import connected
from tagtrail.llm.decontamination import benchmark_matches, masks, myers, normal
from tagtrail.llm.near_duplicates import bitmaps, near_duplicates, sketches
from tagtrail.llm.neighbours import hilbert, nearest_neighbours

DOCS = "doc_id long, text string, id long, band string, n int, component string"


def frame(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, 7, "x", 1, "y") for i, t in rows], DOCS)


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(w) < width:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def brute_components(rows, width, percent):
    sets = {i: shingles(t, width) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    rows, base = [], words(rng, 120)
    for k in range(60):  # copies with changes around the threshold
        w = base.split()
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(len(w))] = f"c{k}{rng.randrange(9)}"
        rows.append((k, " ".join(w)))
    passage = words(rng, 60)
    for k in range(60, 100):  # one passage in common
        rows.append((k, words(rng, 40, 4000) + " " + passage))
    chain = words(rng, 100, 9000).split()
    for k in range(100, 112):  # neighbours alike, ends not
        rows.append((k, " ".join(chain[(k - 100) * 4 : (k - 100) * 4 + 60])))
    rows += [(200, None), (201, ""), (202, " \n\t"), (203, "One two"), (204, "one TWO"), (205, "one"), (206, "ÉA b c d"), (207, "éa b c d")]
    rows += [(300 + k, words(rng, 80, 9000)) for k in range(30)]
    rows += [(400, " ".join(f"z{j}" for j in range(60_000))), (401, " ".join(f"z{j}" for j in range(59_000)))]
    return rows


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates_equal_brute_force(spark, corpus, width):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(frame(spark, corpus), width=width).collect()}
    assert got == brute_components(corpus, width, 80)


def test_near_duplicates_keep_null_ids_and_repeats(spark):
    rows = [(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (9, "a b c d e f"), (None, None)]
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_duplicates(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(None, None, True)] * 2 + [(5, 5, True)] * 2 + [(9, 5, False)], key=str)


def test_near_duplicates_of_an_id_with_several_texts(spark):
    rng = random.Random(9)
    texts = [words(rng, n) for n in (30, 90, 200, 400)]
    near = [t + " end" for t in texts]
    rows = [(1, t) for t in texts] + [(k + 2, t) for k, t in enumerate(near)]
    short, other = words(rng, 60), words(rng, 150)
    rows += [(50, short)] * 2 + [(50, other), (49, short + " end"), (70, other + " end"), (71, other)]
    for part in (1, 5):
        got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(frame(spark, rows).repartition(part)).collect())
        want = [(1, len(shingles(t, 5)), 1, True) for t in texts] + [(k + 2, len(shingles(t, 5)), 1, False) for k, t in enumerate(near)]
        want += [(50, 56, 49, False)] * 2 + [(50, 146, 50, True), (49, 57, 49, True), (70, 147, 50, False), (71, 146, 50, False)]
        assert got == sorted(want)


def test_near_duplicates_of_nothing(spark):
    assert near_duplicates(frame(spark, [])).collect() == []


def test_every_bin_of_a_sketch_fills_and_agrees_as_jaccard():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
    a, b = pool[:2000], pool[500:2500]
    rows = sketches([pool[:1], a, b, pool[:0]], 640)
    assert (rows[:3] != np.iinfo(np.uint64).max).all() and (rows[3] == np.iinfo(np.uint64).max).all()
    assert abs((rows[1] == rows[2]).mean() - 1500 / 2500) < 0.06


def test_bitmaps_never_understate_an_intersection():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 2**63, 900).astype(np.uint64)
    for cut in (10, 300, 800):
        a, b = pool[:cut], pool[cut // 2 :]
        bits = np.unpackbits(bitmaps([a, b]).view(np.uint8), axis=1).astype(bool)
        assert len(a) - (bits[0] & ~bits[1]).sum() >= len(np.intersect1d(a, b))


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r.member: r.component for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}}


def distance_within(pattern, text):
    """Fewest edits of a pattern anywhere in a text, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != c)))
        row = new
    return min(row)


def test_bit_parallel_distance():
    rng = random.Random(3)
    for _ in range(60):
        pattern = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 90)))
        text = "".join(rng.choice("abc") for _ in range(rng.randrange(0, 120)))
        assert myers(masks(pattern), len(pattern), text)[0] == min(len(pattern), distance_within(pattern, text))


def test_benchmark_matches_equal_brute_force(spark):
    rng = random.Random(8)
    letters = "abcdefgh ij"
    items = [(k, "".join(rng.choice(letters) for _ in range(rng.randrange(40, 120)))) for k in range(6)]
    items += [(6, items[0][1]), (7, "short"), (8, None), (9, ""), (10, "x"), (11, "ab cd"), (12, "?!")]
    docs = []
    for k in range(60):
        text = list(items[k % 6][1])
        for _ in range(rng.randrange(0, 14)):
            at = rng.randrange(len(text))
            text[at : at + 1] = rng.choice([[], ["z"], [text[at], "q"]])
        left, right = ("".join(rng.choice(letters) for _ in range(rng.randrange(0, 200))) for _ in range(2))
        docs.append((k, f"{left} {''.join(text).upper()}! {right}"))
    docs += [(100, None), (101, ""), (102, "..."), (103, "x" * 2_000_000 + items[2][1]), (None, items[1][1]), (5, docs[5][1])]
    got = sorted(
        (r.doc_id if r.doc_id is not None else -1, r.item_id, r.edits)
        for r in benchmark_matches(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), block_chars=150).collect()
    )
    want = []
    for i, text in docs:
        whole = normal(text)[0][-3000:]
        for n, item in items:
            small = normal(item)[0]
            if len(small) < 24:
                if small and f" {small} " in f" {normal(text)[0]} ":
                    want.append((-1 if i is None else i, n, 0))
            elif whole:
                edits = distance_within(small, whole)
                if edits <= int(0.1 * len(small)):
                    want.append((-1 if i is None else i, n, edits))
    assert got == sorted(want) and len(got) > 30


def test_short_items_stand_as_whole_words(spark):
    docs = [(1, "So: who wrote HAMLET? Nobody."), (2, "who wrote hamlets"), (3, "xwho wrote hamlet"), (4, "他们问谁写了红楼梦呢"), (5, "who wrote; hamlet")]
    items = spark.createDataFrame([(1, "Who wrote Hamlet?"), (2, "谁写了红楼梦?"), (3, "---")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.edits) for r in benchmark_matches(frame(spark, docs), items).collect())
    assert got == [(1, 1, 0), (4, 2, 0), (5, 1, 0)]


def test_benchmark_spans_point_into_the_text(spark):
    docs = [(1, "Before -- The QUICK brown fox, jumps over: a lazy dog today. After")]
    items = spark.createDataFrame([(3, "the quick brown fox jumps over a lazy dog today")], "item_id long, text string")
    row = benchmark_matches(frame(spark, docs), items).head()
    assert docs[0][1][row.start : row.end] == "The QUICK brown fox, jumps over: a lazy dog today" and row.edits == 0
    assert benchmark_matches(frame(spark, docs), items.limit(0)).collect() == []
    assert benchmark_matches(frame(spark, []), items).collect() == []


def brute_neighbours(rows, k):
    good = {i: np.array(v, float) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    size = max(map(len, good.values()))
    good = {i: v for i, v in good.items() if len(v) == size}
    out = {}
    for i, v in good.items():
        if i % 50 == 0:
            score = [(-round(float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), 9), j) for j, w in good.items() if j != i]
            out[i] = [j for _, j in sorted(score)[:k]]
    return out


def test_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(700)]
    rows += [(700 + i, [float(j) for j in range(1, 9)]) for i in range(300)]  # many equal vectors
    rows += [(2000, None), (2050, []), (2100, [0.0] * 8), (2150, [float("nan")] * 8), (2200, [1.0, None] * 4), (2250, [1.0] * 3)]
    rows += [(None, [1.0] * 8)]
    table = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<double>, block int, score double")
    found = nearest_neighbours(table.repartition(5), F.col("vec_id") % 50 == 0).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == brute_neighbours(rows, 5)


def test_neighbours_of_few_and_none(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    found = nearest_neighbours(table, F.col("vec_id") % 50 == 0)
    assert [tuple(r)[:3] for r in found.orderBy("rank").collect()] == [(0, 1, 1), (0, 2, 2)]
    assert nearest_neighbours(table.limit(0), F.col("vec_id") % 50 == 0).collect() == []


def test_windows_reach_over_partition_borders(spark):
    """The windows find the same in many partitions as in one."""
    rng = np.random.default_rng(6)
    table = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(1500)], "vec_id long, embedding array<double>")
    settings = {"spark.sql.shuffle.partitions": None, "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name) for name in settings}
    found = []
    try:
        for parts in ("1", "7", "20"):
            for name, value in settings.items():
                spark.conf.set(name, value or parts)
            near = nearest_neighbours(table, F.col("vec_id") % 3 == 0, window=20, curves=2, exact=False)
            found.append(sorted(map(tuple, near.collect())))
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert len(found[0]) == 2500 and found[0] == found[1] == found[2]


def test_hilbert_index_is_a_walk_of_unit_steps():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    index = hilbert(grid, 3)
    walk = grid[np.argsort(index)]
    assert sorted(index.tolist()) == list(range(512)) and (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()
