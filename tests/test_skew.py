"""Hot keys take another route; the result must be that of the plain one."""

from __future__ import annotations

import itertools
import math
import re
import random

import pytest
from pyspark.sql import Window, functions as F

from tagtrail.operators import keyed, ordered, similarity


@pytest.fixture(scope="module")
def crowded(spark):
    """One tag with a third of the events and many equal times, next to small tags."""
    pick = random.Random(5)
    data = []
    for i in range(900):
        tag = "hot" if i % 3 == 0 else f"t{pick.randrange(40)}"
        stamp = f"2024-01-{pick.randrange(1, 4):02d} {pick.randrange(24):02d}:{pick.randrange(0, 60, 10):02d}:00"
        data.append((tag, pick.choice("abcd"), pick.choice("xy"), stamp))
    df = spark.createDataFrame(data, "tag string, plaza string, lane string, time string")
    return df.withColumn("time", F.col("time").cast("timestamp_ntz"))


def expected(df, step):
    """Plain windows over whole keys."""
    tie = ["plaza", "lane"]
    first = Window.partitionBy("tag", "time").orderBy(*tie)
    single = df.withColumn("r", F.row_number().over(first)).where("r = 1").drop("r")
    window = Window.partitionBy("tag").orderBy("time")
    return single.withColumn("p", step("plaza").over(window)).withColumn("l", step("lane").over(window))


@pytest.mark.parametrize("ranges", [None, 1, 5, 60])
@pytest.mark.parametrize("direction, step", [("previous", F.lag), ("next", F.lead)])
def test_ranges_give_whole_key_neighbours(crowded, rows, direction, step, ranges):
    fn = {"previous": ordered.previous_event, "next": ordered.next_event}[direction]
    out = fn(crowded, "tag", "time", ["plaza", "lane"], tie=["plaza", "lane"], ranges=ranges)
    names = [c for c in out.columns if c.endswith("_plaza") or c.endswith("_lane")]
    got = out.select("tag", "plaza", "lane", "time", *names)
    assert rows(got) == rows(expected(crowded, step).select("tag", "plaza", "lane", "time", "p", "l"))


def test_a_burst_of_one_key_is_spread_over_tasks(spark, rows):
    burst = spark.range(600).select(
        F.lit("hot").alias("tag"), (F.col("id") % 7).cast("string").alias("plaza"), F.lit("x").alias("lane"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id / 10.0)").alias("time"),
    )
    out = ordered.previous_event(burst, "tag", "time", ["plaza", "lane"], tie=["plaza", "lane"], ranges=6)
    got = out.select("tag", "plaza", "lane", "time", "prev_plaza", "prev_lane")
    assert rows(got) == rows(expected(burst, F.lag).select("tag", "plaza", "lane", "time", "p", "l"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = out.select(F.spark_partition_id().alias("task")).distinct().count()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert tasks > 1


def test_neighbours_do_not_depend_on_partitioning(crowded, rows):
    def run(df):
        return rows(ordered.transitions(df, "tag", "time", "plaza", "lane", ["plaza", "lane"], ranges=4))

    assert run(crowded.repartition(1)) == run(crowded.repartition(7)) == run(crowded.orderBy(F.desc("time")))


def test_values_of_a_key_have_one_shape(spark):
    data = [("big", f"v{i:03d}") for i in range(100)] + [("small", "a"), ("small", "b"), ("small", "b"), ("none", None)]
    out = keyed.valued_pairs(spark.createDataFrame(data, "k string, v string"), "k", "v").collect()
    assert sorted((r.v, r.n_values) for r in out if r.k == "small") == [("a", 2), ("b", 2)]
    assert sorted((r.v, r.n_values) for r in out if r.k == "big") == [(f"v{i:03d}", 100) for i in range(100)]


@pytest.fixture(scope="module")
def ratings(spark):
    """One user rates everything, some rate many items, most a few; some ratings are 0."""
    pick = random.Random(11)
    table = {}
    for item in range(40):
        table[(0, item)] = float(pick.randrange(0, 6))
    for user in range(1, 60):
        for item in pick.sample(range(40), 20 if user % 10 == 0 else pick.randrange(1, 6)):
            table[(user, item)] = float(pick.randrange(0, 6))
    data = [(u, i, r) for (u, i), r in table.items()]
    return spark.createDataFrame(data, "user int, item int, rating double"), table


def brute_force(table):
    users = {}
    for (user, item), rating in table.items():
        users.setdefault(user, {})[item] = rating
    sums = {}
    for seen in users.values():
        for a, b in itertools.combinations(sorted(seen), 2):
            s = sums.setdefault((a, b), [0.0, 0.0, 0.0, 0])
            s[0] += seen[a] * seen[b]
            s[1] += seen[a] ** 2
            s[2] += seen[b] ** 2
            s[3] += 1
    out = {}
    for pair, (xy, xx, yy, n) in sums.items():
        norm = math.sqrt(xx) * math.sqrt(yy)
        out[pair] = (round(xy / norm, 9) if norm else 0.0, n)
    return out


@pytest.mark.parametrize("chunk", [1_000, 7, 2])
def test_similarity_agrees_with_brute_force(ratings, chunk):
    df, table = ratings
    sim = similarity.item_similarity(df, chunk=chunk)
    out = sim.collect()
    assert "Python" not in final_plan(sim) and "Pandas" not in final_plan(sim)
    got = {(r.item_1, r.item_2): (round(r.score, 9), r.strength) for r in out}
    assert len(got) == len(out)
    assert got == brute_force(table)


def test_minimum_strength_is_exact(ratings):
    df, table = ratings
    want = {p: v for p, v in brute_force(table).items() if v[1] >= 4}
    for chunk in (1_000, 8):
        out = similarity.item_similarity(df, min_strength=4, chunk=chunk).collect()
        assert {(r.item_1, r.item_2): (round(r.score, 9), r.strength) for r in out} == want


def test_similarity_to_one_item_matches_the_pair_table(ratings):
    df, table = ratings
    out = similarity.similarity_to(df, F.lit(3)).collect()
    want = {(a if b == 3 else b): v for (a, b), v in brute_force(table).items() if 3 in (a, b)}
    assert {r.item: (round(r.score, 9), r.strength) for r in out} == want
    assert all(-1 <= r.score <= 1 + 1e-9 for r in out)


@pytest.fixture
def eager_skew_join(spark):
    """Thresholds small enough for test data to count as skewed, and no broadcasts."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def final_plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def kind(plaza):
    return F.concat(F.lit("class-"), (plaza % 7).cast("string"))


def crowd(spark, n=60_000):
    """A third of the rows share one class and plaza."""
    key = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500)
    rows = spark.range(0, n, 1, 8).select(
        F.sha2(F.col("id").cast("string"), 256).alias("tag"),
        key.cast("string").alias("plaza"),
        kind(key).alias("vehicle_class"),
    )
    return rows


def test_chained_lookups_split_a_hot_key(spark, eager_skew_join):
    from tagtrail.operators.impute import impute_modal

    prices = spark.range(500).select(
        kind(F.col("id")).alias("vehicle_class"),
        F.col("id").cast("string").alias("plaza"),
        (F.col("id") + 1.0).alias("amount"),
        F.lit(1).alias("frequency"),
    )
    out = impute_modal(crowd(spark), [prices.where("plaza != '0'"), prices])
    counts = {r["source"]: r["n"] for r in out.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    zero = 20_000 + sum(1 for i in range(60_000) if i % 3 and i % 500 == 0)
    assert counts == {2: zero, 1: 60_000 - zero}
    out.collect()
    assert "skew=true" in final_plan(out)


def test_values_of_a_hot_key_are_split(spark, eager_skew_join):
    out = keyed.valued_pairs(crowd(spark), "plaza", "tag")
    got = out.groupBy("plaza").agg(F.count("*").alias("n"), F.max("n_values").alias("values")).collect()
    assert sum(r.n for r in got) == 60_000 and all(r.n == r["values"] for r in got)
    rows = keyed.valued_pairs(crowd(spark), "plaza", "tag")
    rows.collect()
    assert "skew=true" in final_plan(rows)


@pytest.mark.parametrize("how", ["left_semi", "left_anti", "left", "inner"])
def test_key_set_joins_split_a_hot_key(spark, eager_skew_join, how):
    keys = spark.range(400).select(F.col("id").cast("string").alias("plaza")).distinct()
    out = keyed.skew_join(crowd(spark), keys, "plaza", how)
    plain = crowd(spark).join(keys, "plaza", how)
    assert len(out.collect()) == plain.count()
    if how in ("left_semi", "inner"):
        assert "skew=true" in final_plan(out)


def test_skew_join_accepts_keys_of_unlike_types(spark, rows):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    right = spark.createDataFrame([(1,), (3,)], "k bigint")
    assert rows(keyed.skew_join(left, right, "k", "left_semi")) == [(1, "a")]


@pytest.mark.parametrize(
    ("kind", "other"),
    [("int", "double"), ("double", "float"), ("decimal(9,2)", "int"), ("string", "int"), ("boolean", "boolean"), ("smallint", "bigint")],
)
def test_skew_join_equals_a_plain_join_for_all_types(spark, rows, kind, other):
    left = spark.range(4).select(F.col("id").cast("int").cast(kind).alias("k"), F.col("id").alias("v"))
    right = spark.range(1, 3).select(F.col("id").cast("int").cast(other).alias("k")).distinct()
    assert keyed.skew_join(left, right, "k", "left_semi").count() == left.join(right, "k", "left_semi").count() > 0
    zero = spark.sql("SELECT -0.0D AS k"), spark.sql("SELECT 0 AS k")
    assert keyed.skew_join(*zero, "k").count() == 1


def test_full_outer_join_splits_a_hot_key(spark, eager_skew_join):
    from tagtrail.operators.relational import outer_filled

    prices = spark.range(400, 600).union(spark.range(3)).select(F.col("id").cast("string").alias("plaza"), (F.col("id") + 1).alias("price"))
    prices = prices.union(spark.sql("SELECT CAST(NULL AS STRING), 7L"))
    rows_ = crowd(spark).select("plaza", "tag").union(spark.sql("SELECT CAST(NULL AS STRING), 'none'"))
    out = outer_filled(rows_, prices, "plaza")
    got = sorted((tuple(r) for r in out.select("plaza", "tag", "price").collect()), key=str)
    out.collect()
    assert "skew=true" in final_plan(out)
    plain = rows_.join(prices, "plaza", "outer").na.fill(0).select("plaza", "tag", "price")
    assert got == sorted(map(tuple, plain.collect()), key=str)
    assert sum(r[1] is None for r in got) == 101


def test_lists_are_bounded_and_name_their_group(spark):
    from pyspark.errors import PySparkException

    from tagtrail.operators.dominant import dominant_neighbour
    from tagtrail.operators.relational import looked_up, nested_lookup_table

    df = spark.createDataFrame([("big", i) for i in range(50)] + [("small", 2), ("small", 1), (None, 3)], "k string, v int")
    got = {r.k: (r.v_list, r.n) for r in keyed.collected(df, "k", F.col("v"), "v_list", [F.count("v").alias("n")], 50).collect()}
    assert got == {"big": (list(range(50)), 50), "small": ([1, 2], 2), None: ([3], 1)}
    with pytest.raises(PySparkException, match="more than 49 values: k=big, size=50"):
        keyed.collected(df, "k", F.col("v"), "v_list", limit=49).collect()

    table = df.withColumn("w", F.col("v") * 2)
    with pytest.raises(PySparkException, match="k=big"):
        nested_lookup_table(table, "k", "v", "w", 10).collect()
    asked = spark.createDataFrame([("big", 7), ("big", 99), ("small", 2), (None, 3), ("none", 1)], "k string, v int")
    both = [looked_up(asked, table.union(table), "k", "v", "w", limit) for limit in (1000, 10)]
    assert "MapFromEntries" in str(both[0]._jdf.queryExecution().optimizedPlan().toString()) or "map_from_entries" in str(both[0]._jdf.queryExecution())
    results = [sorted(map(tuple, df_.select("k", "v", "w").collect()), key=str) for df_ in both]
    assert results[0] == results[1] == sorted([("big", 7, 14), ("big", 99, None), ("small", 2, 4), (None, 3, None), ("none", 1, None)], key=str)

    moves = spark.createDataFrame([("a", "b", f"l{i}", 1) for i in range(20)], "f string, t string, lane string, hours int")
    assert dominant_neighbour(moves, "f", "t", joined="lane").head().lanes.count("|") == 19
    with pytest.raises(PySparkException, match="f=a, t=b, size=20"):
        dominant_neighbour(moves, "f", "t", joined="lane", limit=19).collect()


@pytest.mark.parametrize("strength", [1, 3, 6])
def test_bounded_similarity_equals_the_filtered_one(ratings, strength):
    df, table = ratings
    want = {p: v for p, v in brute_force(table).items() if v[1] >= strength and v[0] > 0.8}
    out = similarity.item_similarity_above(df, 0.8, strength, chunk=7).collect()
    assert {(r.item_1, r.item_2): (round(r.score, 9), r.strength) for r in out} == want and want


def test_pairs_below_the_strength_are_not_formed(ratings):
    df, table = ratings
    every = brute_force(table)
    pairs = {tuple(r) for r in similarity.candidate_pairs(df, 6).collect()}
    strong = {p for p, v in every.items() if v[1] >= 6}
    assert strong <= pairs and len(pairs) < 0.7 * len(every)


@pytest.mark.parametrize("least", [0.3, 0.6])
def test_cosine_join_equals_brute_force(ratings, least):
    df, table = ratings
    vectors: dict = {}
    for (user, item), rating in table.items():
        vectors.setdefault(item, {})[user] = rating
    norm = {i: math.sqrt(sum(x * x for x in v.values())) for i, v in vectors.items()}
    want = {}
    for a, b in itertools.combinations(sorted(vectors), 2):
        dot = sum(x * vectors[b].get(u, 0.0) for u, x in vectors[a].items())
        if norm[a] and norm[b] and dot / norm[a] / norm[b] >= least:
            want[a, b] = round(dot / norm[a] / norm[b], 9)
    got = {(r.item_1, r.item_2): round(r.score, 9) for r in similarity.cosine_join(df, least, chunk=9).collect()}
    assert got == want and want


@pytest.mark.parametrize("least", [0.75, 0.9])
def test_cosine_join_with_fronts_equals_the_filtered_one(ratings, least):
    df, _ = ratings
    every = similarity.cosine_join(df, 0.05, chunk=9).where(F.col("score") >= least).collect()
    few = df.where("item < 4").withColumn("item", F.col("item") + 100)  # partners of themselves as they were
    both = df.union(few)
    got = {(r.item_1, r.item_2): round(r.score, 9) for r in similarity.cosine_join(both, least, chunk=9).collect()}
    assert {p: s for p, s in got.items() if p[1] < 100} == {(r.item_1, r.item_2): round(r.score, 9) for r in every}
    assert {(i, i + 100) for i in range(4)} <= set(got)


@pytest.fixture(scope="module")
def scattered(spark):
    """200 users rate some 40 of 2,000 items each: 150,000 products, of nearly as many pairs."""
    data = spark.range(8000).select((F.col("id") % 200).alias("user"), F.pmod(F.xxhash64("id"), F.lit(2000)).alias("item"))
    return data.distinct().withColumn("rating", F.hash("user", "item") % 3 + 3.0).cache()


def shuffled_rows(df):
    """Rows that cross the shuffles of a collected frame."""
    df.collect()
    plan, total = [df._jdf.queryExecution().executedPlan()], 0
    while plan:
        p = plan.pop()
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            plan.append(p.executedPlan())
        elif name.endswith("QueryStageExec"):
            plan.append(p.plan())
        elif name == "ShuffleExchangeExec":
            total += p.metrics().apply("shuffleRecordsWritten").value()
        children = p.children()
        plan += [children.apply(i) for i in range(children.size())]
    return total


@pytest.mark.parametrize(
    "run",
    [
        lambda df: similarity.item_similarity(df),
        lambda df: similarity.item_similarity(df, min_strength=2),
        lambda df: similarity.item_similarity_above(df, 0.5, 1),
        lambda df: similarity.cosine_join(df, 0.1),
        lambda df: similarity.best_partners(similarity.item_similarity(df), 1),
    ],
    ids=["item_similarity", "supported", "above", "cosine_join", "best_partners"],
)
def test_products_of_pairs_cross_no_shuffle(scattered, run):
    assert 0 < shuffled_rows(run(scattered)) < 5 * scattered.count()


def test_a_user_in_chunks_meets_every_item_once(spark):
    data = spark.range(200).select(F.lit(1).alias("user"), F.col("id").alias("item"), (F.col("id") + 1.0).alias("rating"))
    data = data.union(data.where("item % 3 = 0").withColumn("user", F.lit(2)))
    for chunk in (1_000, 30):
        out = similarity.item_similarity(data, chunk=chunk).groupBy("strength").count().collect()
        assert {r[0]: r[1] for r in out} == {1: 200 * 199 // 2 - 67 * 66 // 2, 2: 67 * 66 // 2}


def test_popular_items_side_by_side_fall_into_many_blocks(spark):
    rare = spark.range(1000).select(F.col("id").alias("user"), F.col("id").alias("item"))
    popular = spark.range(20_000).select(F.col("id").alias("user"), (F.col("id") % 20 + 1000).alias("item"))
    rated = rare.union(popular).withColumn("rating", F.lit(1.0))
    blocks = similarity._item_blocks(rated, 1, 10, rated.count()).collect()
    assert len(blocks) == 1020 and len({r.item for r in blocks}) == 1020
    assert len({r.block for r in blocks if r.item >= 1000}) >= 5


def test_lists_of_ratings_cross_one_shuffle_and_are_computed_once(scattered):
    plan = final_plan(similarity.item_similarity(scattered))  # not run, so the initial plan alone
    assert len(re.findall(r"Exchange hashpartitioning\(user#\w+, (?!item)", plan)) == 1  # that of the given frame is by item too
    assert "size(transform" not in plan


def test_products_are_formed_item_by_item(scattered):
    plan = final_plan(similarity.best_partners(similarity.item_similarity(scattered), 1))
    assert re.search(r"Generate posexplode.*\n[^\n]*Sort \[a#\w+ ASC NULLS FIRST\], false", plan)


def best_by_sorting(pairs, k):
    """The k best partners of every item by plain Python: NaN first, nulls last, then strength and the smaller partner."""
    sides = [r for a, b, s, n in pairs for r in ((a, b, s, n), (b, a, s, n))]
    rank = lambda r: (r[2] is None, -math.inf if r[2] is None or math.isnan(r[2]) else -r[2], -r[3], r[1])
    out = []
    for _, rows_ in itertools.groupby(sorted(sides, key=lambda r: r[0]), key=lambda r: r[0]):
        out += sorted(rows_, key=rank)[:k]
    return sorted(map(str, out))


@pytest.mark.parametrize("step, kept", [(1 << 19, 1 << 22), (50, 1 << 22), (20, 100)])
def test_best_partners_of_a_task_equal_the_sorted_ones(spark, monkeypatch, step, kept):
    pick = random.Random(3)
    odd = [math.nan, None, -0.0, 0.0, -0.5]
    pairs = [(a, b, pick.choice([0.25, 0.5, 1.0, pick.random(), *odd]), pick.randrange(1, 4)) for a in range(60) for b in range(a + 1, 60)]
    pick.shuffle(pairs)
    sim = spark.createDataFrame(pairs, "item_1 int, item_2 int, score double, strength bigint")
    monkeypatch.setattr(similarity, "HELD_STEP", step)
    monkeypatch.setattr(similarity, "HELD_ROWS", kept)
    batches = sim.select("item_1", "item_2", "score", "strength").toArrow().to_batches(max_chunksize=30)
    rows_left = sum(b.num_rows for b in similarity._best_of_task(4)(iter(batches)))
    assert 4 * 60 <= rows_left < 2 * len(pairs)
    got = similarity.best_partners(sim, 4)
    assert got.schema.simpleString() == "struct<item:int,other:int,score:double,strength:bigint>"
    plain = sorted(str((r.item, r.other, r.score if r.score != 0 else 0.0, r.strength)) for r in got.collect())
    assert plain == best_by_sorting([(a, b, s if s != 0 else 0.0, n) for a, b, s, n in pairs], 4)


def test_best_partners_of_items_with_names(spark):
    sim = spark.createDataFrame([("a", "b", 0.5, 1), ("a", "c", 0.75, 1), ("b", "c", 0.25, 2)], "item_1 string, item_2 string, score double, strength bigint")
    out = {(r.item, r.other) for r in similarity.best_partners(sim, 1).collect()}
    assert out == {("a", "c"), ("b", "a"), ("c", "a")}


def test_tasks_of_best_partners_do_not_grow_with_the_blocks(spark):
    pairs = [(a, b, 1.0 / (1 + (a * b) % 7), 1) for a in range(100) for b in range(a + 1, 100)]
    sim = spark.createDataFrame(pairs, "item_1 int, item_2 int, score double, strength bigint").repartition(400).cache()
    assert shuffled_rows(similarity.best_partners(sim, 1)) <= similarity.BEST_TASKS * 100


def test_pairs_of_a_block_fit_a_small_task(scattered, monkeypatch):
    assert similarity.BLOCK_PRODUCTS * 2 * 130 < 400e6  # a sum of a pair before and after it is final
    monkeypatch.setattr(similarity, "BLOCK_PRODUCTS", 1_000)
    sim = similarity.item_similarity(scattered)
    makers = re.findall(r"Exchange hashpartitioning\(user#\w+, (\d+)\)", final_plan(sim))
    assert "4" in makers and all(int(n) < 100 for n in makers)  # the lists of 150 blocks are not made by as many tasks


@pytest.mark.parametrize("least", [0.05, 0.4])
def test_cosine_join_sends_ratings_as_they_are(spark, ratings, monkeypatch, least):
    _, table = ratings
    table = {(u, i): r * 10.0 ** (i % 9 - 4) for (u, i), r in table.items()}  # lengths far apart
    df = spark.createDataFrame([(u, i, r) for (u, i), r in table.items()], "user int, item int, rating double")
    written, plain = [], similarity.materialize
    monkeypatch.setattr(similarity, "materialize", lambda d, label="table": written.append(label) or plain(d, label))
    got = {(r.item_1, r.item_2): round(r.score, 9) for r in similarity.cosine_join(df, least, chunk=9).collect()}
    vectors: dict = {}
    for (u, i), r in table.items():
        vectors.setdefault(i, {})[u] = r
    norm = {i: math.sqrt(sum(x * x for x in v.values())) for i, v in vectors.items()}
    want = {}
    for a, b in itertools.combinations(sorted(vectors), 2):
        dot = sum(x * vectors[b].get(u, 0.0) for u, x in vectors[a].items())
        if norm[a] and norm[b] and dot / norm[a] / norm[b] >= least:
            want[a, b] = round(dot / norm[a] / norm[b], 9)
    assert got == want and want
    assert "unit" not in written
