"""Small literal inputs for each semantic trap: each fails under the naive behaviour."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tagtrail.operators import dominant, features, impute, keyed, latest, ordered, quality, relational, summaries


def visits(spark, data):
    df = spark.createDataFrame(data, "tag string, plaza string, time string")
    return df.withColumn("time", F.col("time").cast("timestamp_ntz"))


def test_last_event_honours_the_whole_last_day(spark, rows):
    df = visits(
        spark,
        [("t", "a", "2024-01-01 08:00:00"), ("t", "b", "2024-01-02 23:59:59"), ("t", "c", "2024-01-03 00:00:00")],
    )
    assert [r[1] for r in rows(latest.last_event(df, "tag", "time", "2024-01-02"))] == ["b"]


@pytest.mark.parametrize("order", [1, -1])
def test_last_event_tie(spark, rows, order):
    data = [("t", "b", "2024-01-01 08:00:00"), ("t", "a", "2024-01-01 08:00:00")][::order]
    assert [r[1] for r in rows(latest.last_event(visits(spark, data), "tag", "time", tie="plaza"))] == ["a"]


def test_share_uses_the_running_total(spark, rows):
    df = spark.createDataFrame([("k", c) for c in "AAABBCC"], "key string, cat string")
    assert rows(dominant.dominant_category(df, "key", "cat", 0.25))[0][:4] == ("k", "A", 3, 7)


@pytest.mark.parametrize("order", [1, -1])
def test_share_tie_is_independent_of_input_order(spark, rows, order):
    df = spark.createDataFrame([("k", c) for c in "AABB"[::order]], "key string, cat string")
    assert rows(dominant.dominant_category(df, "key", "cat", 0.5))[0][1] == "A"
    assert rows(dominant.dominant_category(df, "key", "cat", 0.5, strict=True)) == []


def test_dominant_category_ignores_null_and_vetoed_keys(spark, rows):
    df = spark.createDataFrame(
        [("a", None, 0), ("a", None, 0), ("a", "x", 0), ("b", "x", 0), ("b", "y", 1), ("c", None, 0)],
        "key string, cat string, bad int",
    )
    assert [r[:4] for r in rows(dominant.dominant_category(df, "key", "cat", 0.0))] == [("a", "x", 1, 1), ("b", "x", 1, 2)]
    kept = dominant.dominant_category(df, "key", "cat", 0.0, unless=F.col("bad") == 1)
    assert [r[:4] for r in rows(kept)] == [("a", "x", 1, 1)]


def test_tag_state_falls_back_to_the_tag(spark, rows):
    good, other = "34" + "0" * 18, "91" + "0" * 18
    txn = spark.createDataFrame(
        [(good, "Kerala"), (good, "Kerala"), (other, "Nowhere"), ("34short", "Kerala"), (good, None)],
        "tag string, state string",
    )
    codes = spark.createDataFrame([("KL", "Kerala")], "code string, state string")
    out = {r.tag: r.code for r in dominant.tag_state(txn, codes).collect()}
    assert out == {good: "KL", other: other}


def test_every_pair_of_neighbours_is_a_transition(spark, rows):
    df = visits(spark, [("t", p, f"2024-01-01 0{i}:00:00") for i, p in enumerate("pqr")])
    moves = ordered.transitions(df, "tag", "time", "plaza")
    assert [(r.from_plaza, r.to_plaza, r.hours) for r in moves.orderBy("to_time").collect()] == [
        ("p", "q", 1),
        ("q", "r", 1),
    ]


def test_equal_times_collapse_to_the_tie_break(spark, rows):
    data = [("t", "b", "2024-01-01 08:00:00"), ("t", "a", "2024-01-01 08:00:00"), ("t", "c", "2024-01-01 11:30:00")]
    moves = ordered.transitions(visits(spark, data), "tag", "time", "plaza").collect()
    assert [(r.from_plaza, r.to_plaza, r.hours) for r in moves] == [("a", "c", 3)]


def test_same_place_is_no_transition(spark):
    df = visits(spark, [("t", "a", "2024-01-01 08:00:00"), ("t", "a", "2024-01-01 09:00:00")])
    assert ordered.transitions(df, "tag", "time", "plaza").count() == 0


def test_dominant_neighbour_compares_counts_and_joins_lanes(spark, rows):
    moves = spark.createDataFrame(
        [("p", "x", "q", "2", 4), ("p", "x", "q", "1", 2), ("p", "x", "r", "9", 90), ("p", "x", "q", "1", 0)],
        "from_plaza string, lane string, to_plaza string, entry string, hours long",
    )
    out = dominant.dominant_neighbour(moves, ["from_plaza", "lane"], "to_plaza", hours=True, joined="entry")
    assert rows(out) == [("p", "x", "q", 3, 4, 75.0, 2.0, "1|2")]


def test_split_by_validity(spark, rows):
    df = spark.createDataFrame(
        [("a", "KA01AB1"), ("a", "KA01AB1"), ("b", "KA01AB2"), ("b", "KA01AB1"), ("c", "bad"), ("d", "ZZ01AB1")],
        "tag string, reg string",
    )
    codes = spark.createDataFrame([("KA",)], "code string")
    unique, multi = impute.split_by_validity(df, "tag", "reg", codes=codes)
    assert rows(unique) == [("a", "KA01AB1")]
    assert rows(multi) == [("b", "KA01AB1", 2), ("b", "KA01AB2", 2)]


def test_imputed_registration_methods(spark, rows):
    txn = spark.createDataFrame(
        [
            ("u", "KA01AB1", "Kerala"),
            ("m", "KA01AB1", "Kerala"),
            ("m", "KA01AB2", "Kerala"),
            ("i", "bad", "Kerala"),
            ("d", "bad", "Atlantis"),
            ("n", "bad", None),
            ("other", "KA01AB1", "Kerala"),
        ],
        "tag string, registration string, state string",
    )
    need = spark.createDataFrame([(t,) for t in ["u", "m", "i", "d", "n", "absent"]], "tag string")
    codes = spark.createDataFrame([("KL", "Kerala")], "code string, state string")
    out = rows(impute.impute_registration(need, txn, codes, keep=F.lit(True)))
    assert out == [
        ("absent", "remaining", None),
        ("d", "imputed", "default00"),
        ("i", "imputed", "KL00"),
        ("m", "multi", "KA01AB1"),
        ("m", "multi", "KA01AB2"),
        ("n", "remaining", None),
        ("u", "unique", "KA01AB1"),
    ]


def test_unmatched(spark, rows):
    need = spark.createDataFrame([("a",), ("b",), ("c",)], "tag string")
    valid, txn = need.where("tag = 'a'"), need.where("tag = 'b'")
    assert rows(impute.unmatched(need, valid, txn)) == [("c",)]


def test_modal_amount_cascades_and_keeps_rows_without_class(spark, rows):
    need = spark.createDataFrame(
        [("1", "p", "car"), ("2", "p", "bus"), ("3", "q", "car"), ("4", "p", None)],
        "tag string, plaza string, vehicle_class string",
    )
    schema = "vehicle_class string, plaza string, amount double, frequency int"
    short = spark.createDataFrame([("car", "p", 0.0, 99), ("car", "p", 20.0, 5), ("car", "p", 10.0, 5)], schema)
    long = spark.createDataFrame([("car", "p", 50.0, 9), ("bus", "p", 40.0, 2)], schema)
    out = {r.tag: (r.amount, r.source) for r in impute.impute_modal(need, [short, long]).collect()}
    assert out == {"1": (10.0, 1), "2": (40.0, 2), "3": (None, None), "4": (None, None)}


def test_multi_valued_latest(spark, rows):
    df = visits(
        spark,
        [
            ("e", "v1", "2024-01-01 00:00:00"),
            ("e", "v3", "2024-01-02 00:00:00"),
            ("e", "v2", "2024-01-02 00:00:00"),
            ("f", "v1", "2024-01-05 00:00:00"),
            ("f", "v1", "2024-01-06 00:00:00"),
        ],
    )
    out = rows(latest.multi_valued_latest(df, "tag", "plaza", "time"))
    assert [(r[0], r[1], str(r[2])) for r in out] == [("e", "v2", "2024-01-02 00:00:00")]
    assert [r[:2] for r in rows(latest.multi_values(df, "tag", "plaza"))] == [("e", "v1"), ("e", "v2"), ("e", "v3")]


def test_history_counts_days_not_day_components(spark):
    df = visits(spark, [("t", "a", "2018-05-01 10:00:00"), ("t", "a", "2018-06-03 10:00:00")])
    row = latest.history_vector(df, "tag", "plaza", "time").first()
    assert [row[f"day_{i}"] for i in range(1, 8)] == [0] * 7


def test_history_looks_only_at_the_latest_place(spark):
    df = visits(
        spark,
        [("t", "a", "2024-01-08 10:00:00"), ("t", "a", "2024-01-06 09:00:00"), ("t", "b", "2024-01-07 09:00:00"),
         ("t", "a", "2024-01-01 09:00:00"), ("t", "a", "2024-01-08 01:00:00")],
    )
    row = latest.history_vector(df, "tag", "plaza", "time").first()
    assert row.plaza == "a" and [row[f"day_{i}"] for i in range(1, 8)] == [0, 1, 0, 0, 0, 0, 1]


def test_speed_uses_half_an_hour_when_idle(spark, rows):
    df = spark.createDataFrame(
        [("a", 100.0, 0), ("b", 100.0, 1), ("c", 0.0, 0), (None, 900.0, 1), ("d", None, 1)],
        "tag string, distance double, time_diff int",
    )
    assert [r[0] for r in rows(quality.speed_anomaly(df))] == ["a"]


def test_overlap(spark, rows):
    a = spark.createDataFrame([("x",), ("y",), ("y",)], "tag string")
    b = spark.createDataFrame([("y",), ("z",)], "tag string")
    assert rows(quality.overlap(a, b, "tag")) == [(2, 2, 1)]


def test_funnel_is_cumulative_per_row(spark, rows):
    df = spark.createDataFrame([("a", 1, 0), ("a", 0, 1), ("b", 1, 1), ("c", None, 1)], "k string, p int, q int")
    out = quality.quality_funnel(df, "k", {"p": F.col("p") == 1, "q": F.col("q") == 1})
    assert [(r.step, r.keys_left) for r in out.orderBy("step_no").collect()] == [("all", 3), ("p", 2), ("q", 1)]


def test_match_master_counts_like_a_left_join(spark, rows):
    txn = spark.createDataFrame([(1,), (1,), (2,), (None,)], "tag int")
    master = spark.createDataFrame([(1,), (1,), (3,)], "tag int")
    joined = txn.join(master.withColumn("hit", F.lit(1)), "tag", "left")
    expected = (joined.count(), joined.where("hit = 1").count())
    assert tuple(quality.match_master(txn, master, "tag").first()) == expected


def test_zero_day_ratio_is_no_error(spark, rows):
    df = visits(spark, [("t", "p", "2024-01-10 08:00:00")])
    dist = spark.createDataFrame([("p", "q", 1.0)], "from_place string, to_place string, distance double")
    row = features.feature_table(df, dist, "tag", "plaza", "time", "p", "2024-01-10", "2024-01-01").first()
    assert (row.txn_on_day, row.days_ratio, row.pre_1) == (1, 0.0, 0)
    assert features.active_day_ratio(df, "tag", "time", "2024-01-10").count() == 0


@pytest.mark.parametrize("start", [None, "2023-06-01"])
def test_active_day_ratio_over_long_spans(spark, start):
    """More than 64 days: several words must add up."""
    days = ["2023-06-01", "2023-07-04", "2023-07-04", "2023-08-04", "2023-08-05", "2023-09-30", "2023-10-01"]
    df = visits(spark, [("t", "p", f"{d} 10:00:00") for d in days])
    row = features.active_day_ratio(df, "tag", "time", "2023-10-01", start).first()
    assert (row.active_days, row.span_days, row.days_ratio) == (5, 122, round(5 / 122, 4))


def test_presence_flags_at_the_borders(spark):
    df = visits(
        spark,
        [("t", "p", "2024-01-12 23:59:59"), ("t", "p", "2024-01-13 00:00:00"), ("t", "p", "2024-01-19 23:59:59"),
         ("t", "q", "2024-01-15 10:00:00"), ("t", "p", "2024-01-20 00:00:00"), ("u", "p", "2024-01-12 10:00:00")],
    )
    out = features.presence_flags(df, "tag", "plaza", "time", "p", "2024-01-20").collect()
    assert [tuple(r) for r in out] == [("t", 1, 0, 0, 0, 0, 0, 1)]


def test_proximity_bands(spark, rows):
    df = visits(spark, [(p, p, "2024-01-19 10:00:00") for p in ["near", "gap", "far", "none", "self"]])
    dist = spark.createDataFrame(
        [("in", "near", 499.0), ("in", "gap", 500.0), ("in", "far", 1000.5), ("in", "self", 0.0), ("x", "none", 1.0)],
        "from_place string, to_place string, distance double",
    )
    out = {r.tag: (r.distance, r.nearer, r.distant) for r in features.proximity(
        df, dist, "tag", "plaza", "time", "in", "2024-01-20").collect()}
    assert out == {
        "near": (499.0, 1, 0), "gap": (500.0, 0, 0), "far": (1000.5, 0, 1), "none": (-1.0, 0, 0), "self": (0.0, 0, 0),
    }


def test_feature_join_types(spark, rows):
    df = visits(
        spark,
        [("today", "p", "2024-01-20 10:00:00"), ("elsewhere", "q", "2024-01-18 10:00:00"),
         ("here", "p", "2024-01-18 10:00:00"), ("early", "p", "2023-12-01 10:00:00")],
    )
    dist = spark.createDataFrame([("p", "q", 1.0)], "from_place string, to_place string, distance double")

    def keys(how):
        out = features.feature_table(df, dist, "tag", "plaza", "time", "p", "2024-01-20", "2024-01-01", how=how)
        return sorted(r.tag for r in out.collect())

    assert keys("outer") == ["elsewhere", "here", "today"]
    assert keys("left") == ["elsewhere", "here"]
    assert keys("inner") == ["here"]
    with pytest.raises(ValueError):
        keys("cross")


def test_cohort_keeps_combinations_or_counts_them(spark):
    events = visits(
        spark,
        [("t", "far", "2024-01-19 10:00:00"), ("t", "in1", "2024-01-20 08:00:00"), ("t", "in1", "2024-01-20 09:00:00"),
         ("u", "far", "2024-01-19 11:00:00"), ("u", "in1", "2024-01-21 11:00:00")],
    )
    ends = spark.createDataFrame([("far",), ("far",)], "plaza string")
    master = spark.createDataFrame([("t", "car")], "tag string, class string")

    def run(fan_out):
        return features.reached_cohort(
            ends, events, master, "tag", "plaza", "time", F.col("plaza").startswith("in"), "2024-01-20", fan_out
        ).orderBy("tag", "input_time").collect()

    full, single = run(True), run(False)
    assert [(r.tag, r.input_time[-8:], r.txn_next_day) for r in full] == [
        ("t", "08:00:00", "0"), ("t", "09:00:00", "0"), ("u", "0", "1"),
    ]
    assert [(r.tag, r.input_events, r.next_events, r["class"]) for r in single] == [
        ("t", "2", "0", "car"), ("u", "0", "1", "0"),
    ]


def test_left_join_default_sample(spark, rows):
    pairs = spark.createDataFrame([(1, 0), (2, 1), (3, 0), (4, 2)], "k int, v int")
    right = pairs.where("v > 0").withColumnRenamed("v", "w")
    out = relational.left_with_default(pairs, right, "k", {"w": 0})
    assert rows(out) == [(1, 0, 0), (2, 1, 1), (3, 0, 0), (4, 2, 2)]


def test_nested_lookup_takes_the_smallest_duplicate(spark):
    df = spark.createDataFrame([(1, 2, 3), (1, 3, 4), (2, 4, 5), (1, 3, 10)], "a int, b int, v int")
    table = {r.a: r.entries for r in relational.nested_lookup_table(df, "a", "b", "v").collect()}
    assert table == {1: {2: 3, 3: 4}, 2: {4: 5}}


def test_lookup_does_not_multiply_rows(spark, rows):
    df = spark.createDataFrame([("a",), ("b",)], "k string")
    dim = spark.createDataFrame([("a", "2"), ("a", "1")], "k string, v string")
    assert rows(keyed.lookup(df, dim, "k", "v", F.lit("none"))) == [("a", "1"), ("b", "none")]


def test_extreme_item_is_the_last_in_tuple_order(spark, rows):
    df = spark.createDataFrame([(1, 5.0), (2, 1.0), (2, 2.0)], "item int, rating double")
    assert rows(summaries.extreme_item(df, "item", "rating")) == [(2, 1.5)]
    assert [tuple(r) for r in summaries.mean_rating(df, "item", "rating").collect()] == [(2, 1.5), (1, 5.0)]


def test_windows_counted_together_equal_windows_one_by_one(spark, rows):
    import random

    rng = random.Random(9)
    data = [(rng.choice(["c1", "c2", "", None]), rng.choice("pqr"), float(rng.randrange(4)), rng.randrange(3)) for _ in range(60)]
    table = spark.createDataFrame(data, "vehicle_class string, plaza string, amount double, n int").groupBy("vehicle_class", "plaza", "amount").agg(
        F.sum(F.when(F.col("n") > 1, 1).otherwise(0)).alias("short"), F.sum("n").alias("long")
    )
    need = spark.createDataFrame([(c, p, f"{c}{p}") for c in ("c1", "c2", "c3", "", None) for p in "pq"], "vehicle_class string, plaza string, tag string")
    each = [table.where(F.col(w) > 0).select("vehicle_class", "plaza", "amount", F.col(w).alias("frequency")) for w in ("short", "long")]
    want = impute.impute_modal(need, each).select("vehicle_class", "plaza", "tag", "amount", "source")
    got = impute.impute_modal_windows(need, table, frequencies=["short", "long"]).select("vehicle_class", "plaza", "tag", "amount", "source")
    assert rows(got) == rows(want)


def test_imputation_of_odd_keys(spark, rows):
    txn = [("a", "KA01AB1234", "KA"), ("a", "KA01AB1234", None), ("b", "KA01AB1234", "KA"), ("b", "MH02CD5678", "MH"), ("c", "bad", "KA"),
           ("c", None, "KA"), ("c", "bad", "MH"), ("d", "bad", None), ("e", "x", "A"), ("e", "x", "B"), ("e", "x", "C"), ("e", "x", "D"),
           ("e", "x", "E"), (None, "KA01AB1234", "KA"), ("z", "KA01AB1234", "KA"), ("g", "bad", "ZZ")]
    need = spark.createDataFrame([(k,) for k in "abcdefg"] + [(None,), ("a",)], "tag string")
    codes = spark.createDataFrame([("29", "KA"), ("27", "MH"), ("28", "KA"), (None, "MH")], "code string, state string")
    out = impute.impute_registration(need.where("tag IS NOT NULL"), spark.createDataFrame(txn, "tag string, registration string, state string"), codes, keep=F.lit(True))
    assert rows(out) == [
        ("a", "unique", "KA01AB1234"), ("b", "multi", "KA01AB1234"), ("b", "multi", "MH02CD5678"), ("c", "imputed", "2800"),
        ("d", "remaining", None), ("e", "remaining", None), ("f", "remaining", None), ("g", "imputed", "default00"),
    ]
