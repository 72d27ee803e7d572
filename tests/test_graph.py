from __future__ import annotations

import math
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tagtrail.operators import graph, regression

# A toy graph with a known answer.
EDGES = [
    ("a", "b", 10.0), ("b", "c", 60.0), ("c", "d", 60.0), ("d", "e", 60.0), ("f", "c", 60.0),
    ("e", "f", 60.0), ("e", "d", 60.0), ("d", "a", 60.0), ("a", "e", 60.0),
]


@pytest.fixture(scope="module")
def toy(spark):
    return spark.createDataFrame(EDGES, "src string, dst string, weight double")


def shown(df):
    return sorted((r.dst, " ".join(r.path), r.total) for r in df.collect())


ALL = [
    ("c", "a b c d a b c", 260.0), ("c", "a e d a b c", 250.0), ("d", "a b c d e d", 250.0), ("d", "a e d e d", 240.0),
    ("d", "a e f c d", 240.0), ("e", "a b c d a e", 250.0), ("e", "a e d a e", 240.0), ("f", "a b c d e f", 250.0),
    ("f", "a e d e f", 240.0),
]


def test_collect_all_paths(toy):
    assert shown(graph.expand_paths(toy, F.col("src") == "a", 200)) == ALL


def test_first_crossing(toy):
    out = shown(graph.expand_paths(toy, F.col("src") == "a", 200, first_only=True))
    assert out == [p for p in ALL if p[2] == 240.0]


def test_ends_without_paths(toy):
    out = graph.reached_ends(toy, F.col("src") == "a", 200)
    assert sorted(r.dst for r in out.collect()) == ["c", "d", "e", "f"]


def test_states_count_and_list_the_same_paths(spark, toy):
    states = graph.PathStates(toy, F.col("src") == "a", 200, steps_per_unit=1)
    paths = graph.expand_paths(toy, F.col("src") == "a", 200).collect()
    want = {}
    for p in paths:
        want[p.dst] = want.get(p.dst, 0) + 1
    assert {r.dst: int(r.n_paths) for r in states.counts().collect()} == want
    for end in ("d", "f"):
        got = states.to(spark.createDataFrame([(end,)], "dst string"))
        assert shown(got) == sorted((p.dst, " ".join(p.path), int(p.total)) for p in paths if p.dst == end)
    assert states.to(spark.createDataFrame([("q",)], "dst string")).collect() == []


def test_states_count_what_cannot_be_listed(spark):
    pick = random.Random(6)
    edges = [(pick.choice("abcd"), pick.choice("abcd"), float(pick.randrange(1, 3))) for _ in range(16)]
    df = spark.createDataFrame(edges, "src string, dst string, weight double")
    states = graph.PathStates(df, F.col("src") == "a", 14, steps_per_unit=1)
    ways: dict = {}
    for s, d, w in edges:
        if s == "a":
            ways[d, int(w)] = ways.get((d, int(w)), 0) + 1
    ends: dict = {}
    first = True
    while ways:
        nxt: dict = {}
        for (at, total), n in ways.items():
            if first or total <= 14:
                for s, d, w in edges:
                    if s == at:
                        nxt[d, total + int(w)] = nxt.get((d, total + int(w)), 0) + n
        first = False
        for (d, total), n in nxt.items():
            if total > 14:
                ends[d] = ends.get(d, 0) + n
        ways = {k: n for k, n in nxt.items() if k[1] <= 14}
    assert {r.dst: int(r.n_paths) for r in states.counts().collect()} == ends and sum(ends.values()) > 10_000
    assert states.states.groupBy("hop").count().agg(F.max("count")).head()[0] <= 4 * 16


def test_cycle_goes_on_until_the_budget_is_spent(spark):
    loop = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0)], "src string, dst string, weight double")
    assert [(d, t) for d, _, t in shown(graph.expand_paths(loop, F.col("src") == "a", 10))] == [("b", 11.0)]
    assert [(d, t) for d, _, t in shown(graph.expand_paths(loop, F.col("src") == "a", 3))] == [("a", 4.0)]
    assert [r.dst for r in graph.reached_ends(loop, F.col("src") == "a", 10).collect()] == ["b"]


def test_a_long_chain_is_followed_to_its_end(spark):
    chain = spark.createDataFrame([(i, i + 1, 1.0) for i in range(16)], "src int, dst int, weight double")
    start = spark.createDataFrame([(0,)], "id int")
    assert {r.id: r.hops for r in graph.hop_distance(chain, start).collect()} == {i: float(i) for i in range(17)}
    assert tuple(graph.degrees_of_separation(chain, start, spark.createDataFrame([(16,)], "id int")).first()) == (16, 1)
    assert [r.dst for r in graph.expand_paths(chain, F.col("src") == 0, 12.5).collect()] == [13]
    assert [r.dst for r in graph.reached_ends(chain, F.col("src") == 0, 12.5).collect()] == [13]
    assert graph.expand_paths(chain, F.col("src") == 0, 99).collect() == []


def test_weights_must_be_positive(spark):
    bad = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 0.0)], "src string, dst string, weight double")
    with pytest.raises(PySparkException, match="above 0"):
        graph.expand_paths(bad, F.col("src") == "a", 10).collect()


def test_diamond_distance(spark):
    edges = spark.createDataFrame([("s", "x"), ("s", "y"), ("x", "z"), ("y", "z"), ("z", "t")], "src string, dst string")
    start = spark.createDataFrame([("s",)], "id string")
    hops = {r.id: r.hops for r in graph.hop_distance(edges, start).collect()}
    assert hops == {"s": 0.0, "x": 1.0, "y": 1.0, "z": 2.0, "t": 3.0}
    target = spark.createDataFrame([("z",)], "id string")
    assert tuple(graph.degrees_of_separation(edges, start, target).first()) == (2, 2)
    nowhere = spark.createDataFrame([("q",)], "id string")
    assert graph.degrees_of_separation(edges, start, nowhere).count() == 0


def test_hops_match_a_plain_search(spark):
    pick = random.Random(3)
    edges = [(pick.randrange(60), pick.randrange(60)) for _ in range(110)]
    df = spark.createDataFrame(edges, "src int, dst int")
    start = spark.createDataFrame([(edges[0][0],)], "id int")
    out = {r.id: r.hops for r in graph.hop_distance(df, start, max_rounds=4).collect()}
    want = {edges[0][0]: 0.0}
    for hop in range(1, 5):
        for d in {d for s, d in edges if want.get(s) == hop - 1}:
            want.setdefault(d, float(hop))
    assert out == {v: want.get(v, math.inf) for e in edges for v in e}
    for s, d in edges:
        if want.get(s, math.inf) < 4:
            assert out[d] <= out[s] + 1


@pytest.mark.parametrize("most", [1_000_000, 5])
def test_search_equals_a_plain_one_with_crowded_vertices(spark, most):
    pick = random.Random(4)
    edges = [(0 if pick.random() < 0.3 else pick.randrange(80), pick.randrange(80)) for _ in range(260)] + [(None, 3), (4, None)]
    df = spark.createDataFrame(edges, "src long, dst int").repartition(3)
    search = graph.Search(df, spark.createDataFrame([(0,), (0,)], "id int"), most=most)
    assert search.any_crowded == (most == 5)
    got = {0: 0}
    for hop, _, reached in search.rounds():
        got |= {r.id: hop for r in reached.collect()}
    search.close()
    want, frontier, hop = {0: 0}, {0}, 0
    while frontier:
        hop += 1
        frontier = {d for s, d in edges if s in frontier and d is not None} - set(want)
        want |= dict.fromkeys(frontier, hop)
    assert {k: v for k, v in got.items() if k is not None} == want
    if most == 5:  # the parts of a vertex lie in several buckets
        files = search.edges.plain().where("src = 0").select(F.col("part"), F.input_file_name().alias("f")).distinct()
        assert files.select("f").distinct().count() > 1 and files.select("part").distinct().count() > 2


def test_rounds_leave_edges_and_visited_vertices_where_they_are(spark):
    chain = spark.range(40).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        search = graph.Search(chain, spark.createDataFrame([(0,)], "id long"))
        sizes = set()
        for hop, _, reached in search.rounds():
            if not reached.isEmpty():
                fresh = search.fresh(reached, hop + 1)
                plan = fresh._jdf.queryExecution().executedPlan().toString()
                sizes.add(plan.count("\n"))
        assert hop == 41 and len(sizes) == 1
        # the only exchanges stand above the frontier and above its ends, not above a bucketed scan
        lines = plan.split("\n")
        for i, line in enumerate(lines):
            if "Bucketed: true" in line:
                depth = lambda x: len(x) - len(x.lstrip(" :+-*"))
                above, level = [], depth(line)
                for other in reversed(lines[:i]):
                    if depth(other) < level:
                        level = depth(other)
                        above.append(other)
                        if "Join" in other:
                            break
                assert not any("Exchange" in x for x in above), plan
        assert plan.count("Bucketed: true") == 2
        with graph.reused(reached) as held:
            assert "InMemoryTableScan" in search.fresh(held, 1)._jdf.queryExecution().executedPlan().toString()
        search.close()
    finally:
        for k in settings:
            spark.conf.unset(k)
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith(("edges", "visited"))]


def test_vertices_and_degrees(spark, rows):
    edges = spark.createDataFrame([(1, 2), (2, 3), (2, 3)], "src int, dst int")
    names = spark.createDataFrame([(1, "one"), (2, "two"), (9, "nine")], "id int, name string")
    assert rows(graph.graph_vertices(edges, names)) == [(1, "one"), (2, "two"), (3, "Nobody"), (9, "nine")]
    assert rows(graph.degrees(edges)) == [(1, 1), (2, 3), (3, 2)]
    assert [tuple(r) for r in graph.top_degrees(edges, names, 5).collect()] == [(2, 3, "two"), (1, 1, "one")]


def test_regression_is_the_penalised_optimum(spark):
    data = [(x / 10, 0.7 * x / 10 + (0.1 if x % 2 else -0.05)) for x in range(-10, 11)]
    df = spark.createDataFrame(data, "x double, y double")
    model = regression.fit_linear(df, ["x"], "y")
    n = len(data)
    want = (sum(x * y for x, y in data) / n) / (sum(x * x for x, _ in data) / n + 0.01)
    assert model.coefficients[0] == pytest.approx(want, abs=1e-9) and model.intercept == 0
    for r in regression.predict(model, df, ["x"]).collect():
        assert r.prediction == pytest.approx(r.x * want, abs=1e-9)


def test_scaling_spans_minus_one_to_one(spark, rows):
    df = spark.createDataFrame([(0.0, 10), (5.0, 20), (10.0, 30)], "a double, b int")
    out = regression.scaled(df, {"x": "a", "y": "b"}).select("x", "y")
    assert rows(out) == sorted([(-1.0, -1.0), (0.0, 0.0), (1.0, 1.0)], key=lambda r: str(r))
