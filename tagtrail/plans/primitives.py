"""Relational and scalar building blocks, a query for each entry of the operator inventory."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagtrail.functions import collections as arrays, dates, numeric, text
from tagtrail.operators import keyed, relational
from tagtrail.operators.dominant import modal_amount
from tagtrail.operators.layout import hash_partition, partition_sizes
from tagtrail.operators.ordered import previous_event
from tagtrail.plans import bindings as b
from tagtrail.plans.registry import query
from tagtrail.session import materialize

# ---- projections ----------------------------------------------------------


@query("select_columns", "SELECT c_custkey, c_name, c_nationkey FROM customer")
def _select(t):
    return t.customer.select("c_custkey", "c_name", "c_nationkey")


@query("arithmetic_projection", "SELECT p_partkey, CAST(p_size + 10 AS INTEGER) AS size_plus FROM part")
def _arithmetic(t):
    return t.part.select("p_partkey", (F.col("p_size") + 10).alias("size_plus"))


@query("rename_columns", "SELECT n_nationkey AS id, n_name AS label, n_regionkey AS region FROM nation")
def _rename(t):
    return t.nation.toDF("id", "label", "region")


@query("literal_marker", "SELECT event_id, user_id, '1' AS input_day FROM events WHERE event_type = 'purchase'")
def _marker(t):
    at_place = t.events.where(F.col("event_type") == "purchase").select("event_id", "user_id")
    return at_place.withColumn("input_day", F.lit("1"))


@query("concatenated_key", f"WITH {b.VISITS} SELECT tag, plaza || entry_lane AS plazalane, time FROM visits")
def _concat(t):
    return b.visits(t).select("tag", text.joined_key("plaza", "entry_lane").alias("plazalane"), "time")


@query("swapped_key", "SELECT o_custkey AS value, o_orderkey AS key, [o_custkey, o_orderkey][1] AS first FROM orders")
def _swap(t):
    pair = F.struct(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("o"))
    nested = t.orders.select(F.col("o_orderkey").alias("key"), pair.alias("pair"))
    return nested.select(F.col("pair.c").alias("value"), "key", F.col("pair.c").alias("first"))


@query(
    "conditional_column",
    """SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'debt' WHEN s_acctbal < 5000 THEN 'low' ELSE 'high' END AS band
    FROM supplier""",
)
def _conditional(t):
    balance = F.col("s_acctbal")
    band = F.when(balance < 0, "debt").when(balance < 5000, "low").otherwise("high")
    return t.supplier.select("s_suppkey", band.alias("band"))


_SPARSE = """sparse AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS price,
    CASE WHEN o_orderkey % 4 <> 0 THEN o_orderstatus END AS status FROM orders)"""


def _sparse(t):
    return t.orders.select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")).alias("price"),
        F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderstatus")).alias("status"),
    )


@query("fill_numeric_nulls", f"WITH {_SPARSE} SELECT o_orderkey, coalesce(price, 0.0) AS price, status FROM sparse")
def _fill_numeric(t):
    return _sparse(t).na.fill(0)


@query("fill_string_nulls", f"WITH {_SPARSE} SELECT o_orderkey, price, coalesce(status, '0') AS status FROM sparse")
def _fill_string(t):
    return _sparse(t).na.fill("0")


@query(
    "exploded_rows",
    "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS token FROM part",
)
def _explode(t):
    return t.part.select("p_partkey", F.explode(F.split("p_name", " ")).alias("token"))


# ---- filters --------------------------------------------------------------


@query("equality_filter", "SELECT event_id, ts FROM events WHERE event_type = 'view'")
def _equality(t):
    return t.events.where(F.col("event_type") == "view").select("event_id", "ts")


@query("threshold_filter", "SELECT event_id, value FROM events WHERE value > 150 OR value < 1")
def _threshold(t):
    return t.events.where((F.col("value") > 150) | (F.col("value") < 1)).select("event_id", "value")


@query("column_inequality", f"WITH {b.ORDERED} SELECT tag, time, plaza, prev_plaza FROM ordered WHERE plaza <> prev_plaza")
def _inequality(t):
    return b.moves(t).select(
        "tag", F.col("to_time").alias("time"), F.col("to_plaza").alias("plaza"), F.col("from_plaza").alias("prev_plaza")
    )


@query(
    "null_and_blank_rejection",
    f"WITH {_SPARSE} SELECT o_orderkey, price, status FROM sparse WHERE price IS NOT NULL AND status NOT IN ('', 'O')",
)
def _rejection(t):
    return _sparse(t).where(F.col("price").isNotNull() & text.present("status", "", "O"))


@query(
    "full_match_filter",
    f"""WITH {b.REGISTRATIONS} SELECT tag, registration FROM registrations
    WHERE regexp_matches(registration, '{text.REGISTRATION_STRICT}')""",
)
def _full_match(t):
    return b.registrations(t).where(text.full_match("registration", text.REGISTRATION_STRICT.strip("^$"))).select(
        "tag", "registration"
    )


@query("length_band", "SELECT doc_id, n_chars FROM documents WHERE length(text) BETWEEN 200 AND 2400")
def _length(t):
    return t.documents.where(text.length_between("text", (200, 2400))).select("doc_id", "n_chars")


@query(
    "date_window",
    f"""SELECT event_id, ts FROM events
    WHERE CAST(ts AS DATE) >= DATE '{b.START}' AND CAST(ts AS DATE) <= DATE '{b.DAY}'""",
)
def _date_window(t):
    return t.events.where(dates.on_or_after("ts", b.START) & dates.through_day("ts", b.DAY)).select("event_id", "ts")


@query("sql_predicate", "SELECT tag, registration FROM r WHERE translate(registration, 'X', '') <> ''".replace(
    "FROM r", f"FROM (WITH {b.REGISTRATIONS} SELECT * FROM registrations)"))
def _sql_predicate(t):
    return b.registrations(t).where(F.expr("translate(registration, 'X', '') != ''")).select("tag", "registration")


_RICH = "SELECT c_custkey FROM customer WHERE c_acctbal > 5000"


def _rich(t):
    return t.customer.where(F.col("c_acctbal") > 5000).select(F.col("c_custkey").alias("o_custkey"))


@query("key_set_membership", f"SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN ({_RICH})")
def _membership(t):
    return relational.with_keys(t.orders, _rich(t), "o_custkey").select("o_orderkey", "o_custkey")


@query(
    "combined_predicate",
    """SELECT l_orderkey, l_linenumber FROM lineitem
    WHERE (l_returnflag = 'R' OR l_linestatus = 'O') AND l_quantity > 40 AND l_discount < 0.05""",
)
def _combined(t):
    test = (
        ((F.col("l_returnflag") == "R") | (F.col("l_linestatus") == "O"))
        & (F.col("l_quantity") > 40)
        & (F.col("l_discount") < 0.05)
    )
    return t.lineitem.where(test).select("l_orderkey", "l_linenumber")


# ---- joins ----------------------------------------------------------------


@query(
    "inner_join",
    "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey",
)
def _inner(t):
    customers = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return t.orders.join(customers, "o_custkey").select("o_orderkey", "c_name")


@query(
    "inner_join_two_keys",
    f"""WITH {b.AMOUNTS} SELECT s.vehicle_class, s.plaza, s.amount AS short_amount, l.amount AS long_amount
    FROM short_modal s JOIN long_modal l ON s.vehicle_class = l.vehicle_class AND s.plaza = l.plaza""",
)
def _inner_two(t):
    keys = ["vehicle_class", "plaza"]
    short = modal_amount(b.amounts(t, b.SHORT_UNTIL), keys).select(*keys, F.col("amount").alias("short_amount"))
    long = modal_amount(b.amounts(t, b.LONG_UNTIL), keys).select(*keys, F.col("amount").alias("long_amount"))
    return short.join(long, keys)


@query(
    "left_join_default",
    """SELECT c_custkey, coalesce(n, 0) AS n, coalesce(status, 'none') AS status FROM customer LEFT JOIN (
        SELECT o_custkey, count(*) AS n, max(o_orderstatus) AS status FROM orders
        WHERE o_totalprice > 450000 GROUP BY 1) ON c_custkey = o_custkey""",
)
def _left_default(t):
    big = (
        t.orders.where(F.col("o_totalprice") > 450000)
        .groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(F.count(F.lit(1)).alias("n"), F.max("o_orderstatus").alias("status"))
    )
    return relational.left_with_default(t.customer.select("c_custkey"), big, "c_custkey", {"n": 0, "status": "none"})


@query(
    "left_join_filled",
    """SELECT p_partkey, p_name, coalesce(returned, 0) AS returned FROM part LEFT JOIN (
        SELECT l_partkey, sum(l_quantity) AS returned FROM lineitem WHERE l_returnflag = 'R'
        AND l_quantity > 40 GROUP BY 1) ON p_partkey = l_partkey""",
)
def _left_filled(t):
    returned = (
        t.lineitem.where((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 40))
        .groupBy(F.col("l_partkey").alias("p_partkey"))
        .agg(F.sum("l_quantity").alias("returned"))
    )
    return relational.left_filled(t.part.select("p_partkey", "p_name"), returned, "p_partkey")


@query(
    "left_join_using",
    """SELECT user_id, event_id, c_name FROM events LEFT JOIN (
        SELECT c_custkey AS user_id, c_name FROM customer WHERE c_nationkey < 10) USING (user_id)""",
)
def _left_using(t):
    master = t.customer.where(F.col("c_nationkey") < 10).select(F.col("c_custkey").alias("user_id"), "c_name")
    return t.events.select("user_id", "event_id").join(master, on=["user_id"], how="left")


@query(
    "full_outer_filled",
    """SELECT coalesce(a.l_partkey, z.l_partkey) AS l_partkey, coalesce(returned, 0) AS returned,
        coalesce(accepted, 0) AS accepted
    FROM (SELECT l_partkey, count(*) AS returned FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45 GROUP BY 1) a
    FULL JOIN (SELECT l_partkey, count(*) AS accepted FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 45
               GROUP BY 1) z ON a.l_partkey = z.l_partkey""",
)
def _outer(t):
    big = t.lineitem.where(F.col("l_quantity") > 45)
    returned = keyed.count_by(big.where(F.col("l_returnflag") == "R"), "l_partkey", "returned")
    accepted = keyed.count_by(big.where(F.col("l_returnflag") == "A"), "l_partkey", "accepted")
    return relational.outer_filled(returned, accepted, "l_partkey")


@query(
    "join_disambiguated",
    """SELECT a.user_id, a.first_ts, z.last_ts FROM
        (SELECT user_id, min(ts) AS first_ts FROM events WHERE event_type = 'click' GROUP BY 1) a JOIN
        (SELECT user_id, max(ts) AS last_ts FROM events WHERE event_type = 'view' GROUP BY 1) z
        ON a.user_id = z.user_id""",
)
def _disambiguated(t):
    a = t.events.where(F.col("event_type") == "click").groupBy("user_id").agg(F.min("ts").alias("first_ts")).alias("a")
    z = t.events.where(F.col("event_type") == "view").groupBy("user_id").agg(F.max("ts").alias("last_ts")).alias("z")
    return a.join(z, F.col("a.user_id") == F.col("z.user_id")).select("a.user_id", "a.first_ts", "z.last_ts")


@query("semi_join", f"SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")
def _semi(t):
    big = t.orders.where(F.col("o_totalprice") > 450000).select(F.col("o_custkey").alias("c_custkey"))
    return relational.with_keys(t.customer, big, "c_custkey").select("c_custkey", "c_name")


@query("anti_join_key_set", f"SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN ({_RICH})")
def _anti_set(t):
    return relational.without_keys(t.orders, _rich(t), "o_custkey").select("o_orderkey", "o_custkey")


@query(
    "subtract_by_key",
    "SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)",
)
def _subtract_key(t):
    seen = t.lineitem.where(F.col("l_quantity") > 45).select(F.col("l_partkey").alias("p_partkey"))
    return relational.without_keys(t.part, seen, "p_partkey").select("p_partkey", "p_name")


@query(
    "lookup_with_default",
    f"""WITH {b.STATE_CODE} SELECT o_orderkey, o_orderpriority, coalesce(code, 'default') AS code
    FROM orders LEFT JOIN state_code ON o_orderpriority = state""",
)
def _lookup(t):
    codes = b.state_code(t).withColumnRenamed("state", "o_orderpriority")
    return keyed.lookup(t.orders, codes, "o_orderpriority", "code", F.lit("default")).select(
        "o_orderkey", "o_orderpriority", "code"
    )


@query(
    "two_level_lookup",
    f"""WITH {b.MOVES}, {b.DISTANCE}
    SELECT tag, to_time, from_plaza, to_plaza, CAST(coalesce(d.distance, -1.0) AS DOUBLE) AS distance
    FROM moves LEFT JOIN distance d ON from_plaza = d.from_place AND to_plaza = d.to_place""",
)
def _two_level(t):
    trips = b.moves(t).select("tag", "to_time", "from_plaza", "to_plaza")
    return relational.distance_between(trips, b.distance(t), "from_plaza", "to_plaza")


@query(
    "name_enrichment",
    """SELECT l_suppkey, n, s_name FROM (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1)
    JOIN supplier ON l_suppkey = s_suppkey""",
)
def _enrichment(t):
    names = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    return keyed.count_by(t.lineitem, "l_suppkey").join(names, "l_suppkey")


# ---- aggregations ---------------------------------------------------------


@query("count_per_key", "SELECT p_size, count(*) AS n FROM part GROUP BY 1")
def _count(t):
    return keyed.count_by(t.part, "p_size")


@query("count_per_two_keys", "SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2")
def _count_two(t):
    return keyed.count_by(t.orders, ["o_custkey", "o_orderpriority"])


@query("sum_per_key", "SELECT l_suppkey, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1")
def _sum(t):
    return t.lineitem.groupBy("l_suppkey").agg(F.sum("l_quantity").alias("quantity"))


@query("mean_per_key", "SELECT l_returnflag, l_suppkey, avg(l_quantity) AS mean FROM lineitem GROUP BY 1, 2")
def _mean(t):
    return t.lineitem.groupBy("l_returnflag", "l_suppkey").agg(F.avg("l_quantity").alias("mean"))


@query("max_and_min_per_key", "SELECT event_type, max(value) AS high, min(value) AS low FROM events GROUP BY 1")
def _max_min(t):
    return t.events.groupBy("event_type").agg(F.max("value").alias("high"), F.min("value").alias("low"))


_TAG_TIME = "SELECT user_id AS tag, count(ts) AS visits, min(ts) AS start_time FROM {source} GROUP BY user_id"


@query("sql_over_view", _TAG_TIME.format(source="events"))
def _sql_view(t):
    # The frame is passed as a query argument, so no view outlives the call.
    return t.spark.sql(_TAG_TIME, source=t.events)


@query(
    "count_sum_and_set",
    f"""WITH {b.MOVES} SELECT from_plaza, to_plaza, count(*) AS n, CAST(sum(hours) AS BIGINT) AS hours,
        string_agg(DISTINCT to_entry_lane, '|' ORDER BY to_entry_lane) AS lanes FROM moves GROUP BY 1, 2""",
)
def _count_sum_set(t):
    pair = ["from_plaza", "to_plaza"]
    fine = b.moves(t).groupBy(*pair, "to_entry_lane").agg(F.count(F.lit(1)).alias("n"), F.sum("hours").alias("hours"))
    sums = [F.sum("n").alias("n"), F.sum("hours").alias("hours")]
    out = keyed.collected(fine, pair, F.col("to_entry_lane"), "lanes", sums)
    return out.withColumn("lanes", F.array_join("lanes", "|"))


@query(
    "latest_row_per_key",
    """SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM (
        SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS pos FROM orders)
    WHERE pos = 1""",
)
def _latest_row(t):
    rows = t.orders.select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return keyed.latest_rows(rows, "o_custkey", [F.desc("o_orderdate"), F.asc("o_orderkey")])


@query(
    "most_frequent_with_total",
    """SELECT l_suppkey, l_partkey, n AS count, CAST(total AS BIGINT) AS total FROM (
        SELECT *, sum(n) OVER (PARTITION BY l_suppkey) AS total,
               row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_partkey) AS pos
        FROM (SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2)) WHERE pos = 1""",
)
def _most_frequent(t):
    return keyed.winner_by_count(keyed.count_by(t.lineitem, ["l_suppkey", "l_partkey"]), "l_suppkey", "l_partkey")


@query(
    "most_frequent_pair_with_payload",
    """SELECT l_suppkey, l_returnflag, l_linestatus, n AS count, CAST(total AS BIGINT) AS total, quantity FROM (
        SELECT *, sum(n) OVER (PARTITION BY l_suppkey) AS total, row_number() OVER (
            PARTITION BY l_suppkey ORDER BY n DESC, l_returnflag, l_linestatus) AS pos
        FROM (SELECT l_suppkey, l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS quantity
              FROM lineitem GROUP BY 1, 2, 3)) WHERE pos = 1""",
)
def _most_frequent_pair(t):
    flags = ["l_returnflag", "l_linestatus"]
    counted = t.lineitem.groupBy("l_suppkey", *flags).agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity")
    )
    return keyed.winner_by_count(counted, "l_suppkey", flags, extra="quantity")


@query(
    "modal_amount",
    f"WITH {b.AMOUNTS} SELECT vehicle_class, plaza, amount FROM short_modal",
)
def _modal(t):
    return modal_amount(b.amounts(t, b.SHORT_UNTIL), ["vehicle_class", "plaza"]).drop("frequency")


@query(
    "sorted_set_per_key",
    f"""WITH {b.VISITS}, pairs AS (
        SELECT DISTINCT tag, strftime(time, '%Y-%m-%d') AS day FROM visits WHERE plaza = '{b.PLACE}')
    SELECT tag, day, count(*) OVER (PARTITION BY tag) AS n_values FROM pairs""",
)
def _sorted_set(t):
    days = b.visits(t).where(F.col("plaza") == b.PLACE).select("tag", F.date_format("time", "yyyy-MM-dd").alias("day"))
    return keyed.valued_pairs(days, "tag", "day").orderBy("tag", "day")


@query("distinct_rows", "SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem")
def _distinct(t):
    return t.lineitem.select("l_suppkey", "l_returnflag").distinct()


@query("count_distinct", "SELECT count(DISTINCT o_custkey) AS customers FROM orders")
def _count_distinct(t):
    return t.orders.agg(F.countDistinct("o_custkey").alias("customers"))


@query("count_by_value", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def _by_value(t):
    return keyed.count_by(t.orders, "o_orderstatus")


@query("global_count", "SELECT count(*) AS n FROM lineitem")
def _global_count(t):
    return t.lineitem.agg(F.count(F.lit(1)).alias("n"))


@query(
    "cosine_of_column_pair",
    """SELECT l_suppkey, round(sum(l_quantity * l_discount)
        / (sqrt(sum(l_quantity * l_quantity)) * sqrt(sum(l_discount * l_discount))), 6) AS score, count(*) AS n
    FROM lineitem GROUP BY 1""",
)
def _cosine(t):
    x, y = F.col("l_quantity"), F.col("l_discount")
    return t.lineitem.groupBy("l_suppkey").agg(
        F.round(numeric.cosine(F.sum(x * y), F.sum(x * x), F.sum(y * y)), 6).alias("score"),
        F.count(F.lit(1)).alias("n"),
    )


@query(
    "nested_map",
    """SELECT n_regionkey, string_agg(n_name || '=' || n_nationkey, ',' ORDER BY n_name) AS entries
    FROM nation GROUP BY 1""",
)
def _nested_map(t):
    table = relational.nested_lookup_table(t.nation, "n_regionkey", "n_name", "n_nationkey")
    shown = F.transform(F.map_entries("entries"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return table.select("n_regionkey", F.array_join(shown, ",").alias("entries"))


@query(
    "state_merge",
    """SELECT l_suppkey, CAST(min(l_linenumber) AS INTEGER) AS distance, max(CASE l_returnflag WHEN 'A' THEN 0
        WHEN 'N' THEN 1 ELSE 2 END) AS darkest, CAST(count(DISTINCT l_partkey) AS BIGINT) AS edges
    FROM lineitem GROUP BY 1""",
)
def _state_merge(t):
    rank = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    per_edge = t.lineitem.groupBy("l_suppkey", "l_partkey").agg(
        F.min("l_linenumber").alias("distance"), F.max(rank).alias("darkest")
    )
    return per_edge.groupBy("l_suppkey").agg(
        F.min("distance").alias("distance"), F.max("darkest").alias("darkest"), F.count(F.lit(1)).alias("edges")
    )


@query("hit_count", "SELECT count(*) AS hits FROM lineitem WHERE l_suppkey = (SELECT max(s_suppkey) FROM supplier)")
def _hits(t):
    target = t.supplier.agg(F.max("s_suppkey")).scalar()
    return t.lineitem.where(F.col("l_suppkey") == target).agg(F.count(F.lit(1)).alias("hits"))


@query(
    "share_of_total",
    """SELECT c_nationkey, c_mktsegment, n, CAST(sum(n) OVER (PARTITION BY c_nationkey) AS BIGINT) AS total,
        n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY c_nationkey) AS percent
    FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2)""",
)
def _share(t):
    return keyed.share_of_total(keyed.count_by(t.customer, ["c_nationkey", "c_mktsegment"]), "c_nationkey")


# ---- order and sets -------------------------------------------------------


@query("sort_by_count", "SELECT p_brand, count(*) AS n FROM part GROUP BY 1")
def _sort_count(t):
    return keyed.count_by(t.part, "p_brand").orderBy(F.desc("n"), "p_brand")


@query("sort_by_value", "SELECT s_suppkey, s_acctbal FROM supplier")
def _sort_value(t):
    return t.supplier.select("s_suppkey", "s_acctbal").orderBy("s_acctbal", "s_suppkey")


@query("sort_by_key", "SELECT o_custkey, o_orderkey FROM orders")
def _sort_key(t):
    return t.orders.select("o_custkey", "o_orderkey").orderBy("o_custkey", "o_orderkey")


@query("top_by_measure", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def _top(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query(
    "top_by_two_measures",
    """SELECT l_suppkey, mean, n FROM (SELECT l_suppkey, avg(l_quantity) AS mean, count(*) AS n FROM lineitem GROUP BY 1)
    ORDER BY mean DESC, n DESC, l_suppkey LIMIT 10""",
)
def _top_two(t):
    means = t.lineitem.groupBy("l_suppkey").agg(F.avg("l_quantity").alias("mean"), F.count(F.lit(1)).alias("n"))
    return means.orderBy(F.desc("mean"), F.desc("n"), "l_suppkey").limit(10)


@query("first_rows", "SELECT count(*) AS n_rows FROM (SELECT * FROM orders LIMIT 100)")
def _first_rows(t):
    return t.orders.limit(100).agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "bag_union",
    "SELECT c_nationkey AS nation, 'c' AS kind FROM customer UNION ALL SELECT s_nationkey, 's' FROM supplier",
)
def _union(t):
    customers = t.customer.select(F.col("c_nationkey").alias("nation"), F.lit("c").alias("kind"))
    suppliers = t.supplier.select(F.lit("s").alias("kind"), F.col("s_nationkey").alias("nation"))
    return relational.union_all(customers, suppliers)


_UNION_TEXT = """SELECT n_name AS place, CAST(n_nationkey AS DOUBLE) AS chance FROM {nation}
    UNION ALL SELECT r_name, 0.5 FROM {region} UNION ALL SELECT r_name, 0.9 FROM {region}"""


@query("sql_union_all", _UNION_TEXT.format(nation="nation", region="region"))
def _sql_union(t):
    return t.spark.sql(_UNION_TEXT, nation=t.nation, region=t.region)


@query("intersection", "SELECT o_custkey AS key FROM orders INTERSECT SELECT user_id FROM events")
def _intersection(t):
    return t.orders.select(F.col("o_custkey").alias("key")).intersect(t.events.select("user_id"))


@query("difference", "SELECT c_custkey AS key FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 200000")
def _difference(t):
    big = t.orders.where(F.col("o_totalprice") > 200000).select("o_custkey")
    return t.customer.select(F.col("c_custkey").alias("key")).subtract(big)


# ---- scalar functions -----------------------------------------------------


@query(
    "text_functions",
    r"""SELECT p_partkey, upper(p_name) AS upper_name, array_to_string(regexp_split_to_array(p_name, '\s+'), '|') AS parts,
        substr(p_name, 1, 2) AS prefix, translate(p_brand, 'B', '') AS unmasked, concat_ws(' ', p_brand, p_type) AS joined,
        p_brand || '00' AS appended, CAST(length(p_name) AS INTEGER) AS n_chars, reverse(p_name) AS reversed,
        printf('%.2f F', p_retailprice) AS shown, TRY_CAST(trim('  ' || p_size || ' ') AS BIGINT) AS number,
        TRY_CAST(regexp_extract(p_brand, '.*#([0-9]+).*', 1) AS INTEGER) AS brand_no,
        regexp_matches(split_part(p_brand, '#', 2), '"""
    + text.TAG_PREFIX
    + r"""') AS tag_match, split_part(p_brand, '#', 2) AS second
    FROM part""",
)
def _text(t):
    return t.part.select(
        "p_partkey",
        F.upper("p_name").alias("upper_name"),
        F.array_join(F.split("p_name", r"\s+"), "|").alias("parts"),
        text.prefix("p_name", 2).alias("prefix"),
        F.translate("p_brand", "B", "").alias("unmasked"),
        F.concat_ws(" ", "p_brand", "p_type").alias("joined"),
        F.concat("p_brand", F.lit("00")).alias("appended"),
        F.length("p_name").alias("n_chars"),
        F.reverse("p_name").alias("reversed"),
        text.fahrenheit_text("p_retailprice").alias("shown"),
        text.trimmed_number(F.concat(F.lit("  "), F.col("p_size").cast("string"), F.lit(" "))).alias("number"),
        text.captured_int("p_brand", ".*#([0-9]+).*").alias("brand_no"),
        text.field("p_brand", "#", 1).rlike(text.TAG_PREFIX).alias("tag_match"),
        text.field("p_brand", "#", 1).alias("second"),
    )


@query(
    "registration_patterns",
    f"""WITH {b.REGISTRATIONS} SELECT registration, count(*) AS n,
        regexp_matches(registration, '{text.REGISTRATION_LOOSE}') AS loose,
        regexp_matches(registration, '{text.REGISTRATION_ANY}') AS any_form,
        regexp_matches(registration, '{text.REGISTRATION_STRICT}') AS strict,
        translate(registration, 'X', '') <> '' AS unmasked
    FROM registrations GROUP BY registration""",
)
def _patterns(t):
    return keyed.count_by(b.registrations(t), "registration").select(
        "registration",
        "n",
        F.col("registration").rlike(text.REGISTRATION_LOOSE).alias("loose"),
        F.col("registration").rlike(text.REGISTRATION_ANY).alias("any_form"),
        F.col("registration").rlike(text.REGISTRATION_STRICT).alias("strict"),
        text.unmasked("registration").alias("unmasked"),
    )


@query(
    "date_functions",
    f"""SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, strptime(strftime(ts, '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S') AS parsed,
        CAST(ts AS DATE) <= DATE '{b.DAY}' AS in_time, strftime(ts - INTERVAL 1 DAY, '%Y-%m-%d') AS day_before,
        strftime(ts + INTERVAL 1 DAY, '%Y-%m-%d') AS day_after,
        CAST(date_diff('day', CAST(ts AS DATE), DATE '{b.DAY}') AS INTEGER) AS days_back,
        strftime(ts, '%Y%m%d') AS compact, strftime(ts, '%A') AS weekday FROM events""",
)
def _dates(t):
    date = F.to_date("ts")
    written = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return t.events.select(
        "event_id",
        date.cast("string").alias("day"),
        F.to_timestamp_ntz(written, F.lit("yyyy-MM-dd HH:mm:ss")).alias("parsed"),
        (date <= dates.day(b.DAY)).alias("in_time"),
        F.date_sub(date, 1).cast("string").alias("day_before"),
        F.date_add(date, 1).cast("string").alias("day_after"),
        dates.days_before(b.DAY, "ts").alias("days_back"),
        dates.compact_date("ts").alias("compact"),
        dates.weekday_name("ts").alias("weekday"),
    )


@query(
    "hours_between",
    f"""WITH {b.ORDERED} SELECT tag, time,
        CAST((epoch_us(time) - epoch_us(prev_time)) // 3600000000 AS BIGINT) AS hours,
        CAST(-((epoch_us(time) - epoch_us(prev_time)) // 3600000000) AS BIGINT) AS hours_backward
    FROM ordered WHERE prev_time IS NOT NULL""",
)
def _hours(t):
    linked = previous_event(b.visits(t), "tag", "time", "time", tie=["plaza", "entry_lane", "exit_lane"])
    return linked.where(F.col("prev_time").isNotNull()).select(
        "tag",
        "time",
        dates.hours_between("prev_time", "time").alias("hours"),
        dates.hours_between("time", "prev_time").alias("hours_backward"),
    )


@query(
    "math_functions",
    """SELECT l_orderkey, l_linenumber, sqrt(l_quantity) AS root, l_quantity * l_quantity AS square,
        round_even(l_quantity / 7.0::DOUBLE, 4) AS seventh,
        l_quantity * 0.1::DOUBLE * (9.0::DOUBLE / 5.0::DOUBLE) + 32.0::DOUBLE AS fahrenheit,
        CASE WHEN l_tax <> 0 THEN l_discount / l_tax END AS guarded FROM lineitem""",
)
def _math(t):
    q = F.col("l_quantity")
    return t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        F.sqrt(q).alias("root"),
        (q * q).alias("square"),
        numeric.half_even(q / 7.0).alias("seventh"),
        numeric.fahrenheit(q).alias("fahrenheit"),
        numeric.ratio("l_discount", "l_tax").alias("guarded"),
    )


_ARRAY = "[p_size, 3, p_size, CAST(p_partkey % 7 AS INTEGER)]"


@query(
    "array_functions",
    f"""SELECT p_partkey, array_to_string(a, ',') AS built, array_to_string(list_append(a, 9), ',') AS appended,
        list_contains(a, 3) AS has_three, list_contains(a, 50) AS has_fifty,
        array_to_string(list_transform(a, lambda x: x * 2), ',') AS doubled,
        array_to_string(list_filter(a, lambda x: x <> 3), ',') AS without_three,
        CAST(list_sum(a) AS BIGINT) AS total, array_to_string(list_concat(a, [1, 2]), ',') AS longer,
        array_to_string(list_reverse(a), ',') AS reversed, array_to_string(list_sort(a), ',') AS sorted,
        CAST(list_unique(a) AS INTEGER) AS n_distinct, list_max(a) AS largest, a[1] AS head, a[4] AS last,
        array_to_string(a[2:], ',') AS tail, a[9] AS missing
    FROM (SELECT p_partkey, {_ARRAY} AS a FROM part)""",
)
def _arrays(t):
    a = F.col("a")
    listed = t.part.select(
        "p_partkey", F.array("p_size", F.lit(3), "p_size", (F.col("p_partkey") % 7).cast("int")).alias("a")
    )

    def shown(c):
        return F.array_join(c.cast("array<string>"), ",")

    return listed.select(
        "p_partkey",
        shown(a).alias("built"),
        shown(arrays.appended("a", F.lit(9))).alias("appended"),
        F.array_contains("a", 3).alias("has_three"),
        F.array_contains("a", 50).alias("has_fifty"),
        shown(F.transform("a", lambda x: x * 2)).alias("doubled"),
        shown(arrays.without("a", 3)).alias("without_three"),
        arrays.total("a").alias("total"),
        shown(F.concat("a", F.array(F.lit(1), F.lit(2)))).alias("longer"),
        shown(F.reverse("a")).alias("reversed"),
        shown(F.array_sort("a")).alias("sorted"),
        F.size(F.array_distinct("a")).alias("n_distinct"),
        F.array_max("a").alias("largest"),
        arrays.head("a").alias("head"),
        F.element_at("a", -1).alias("last"),
        shown(arrays.tail("a")).alias("tail"),
        F.get("a", 8).alias("missing"),
    )


@query(
    "array_groups",
    """SELECT doc_id, array_to_string(list_slice(words, pos, pos + 2), ',') AS line, CAST((pos - 1) // 3 AS INTEGER) AS line_no
    FROM (SELECT doc_id, words, unnest(generate_series(1, len(words), 3)) AS pos
          FROM (SELECT doc_id, string_split(text, ' ') AS words FROM documents))""",
)
def _groups(t):
    lines = arrays.in_groups(F.split("text", " "), 3)
    return t.documents.select("doc_id", F.posexplode(lines).alias("line_no", "line"))


@query(
    "map_lookup",
    """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 0 END AS rank,
        o_orderpriority IN ('1-URGENT', '2-HIGH') AS known FROM orders""",
)
def _maps(t):
    ranks = F.create_map(F.lit("1-URGENT"), F.lit(1), F.lit("2-HIGH"), F.lit(2))
    return t.orders.select(
        "o_orderkey",
        arrays.looked_up(ranks, "o_orderpriority", 0).alias("rank"),
        F.map_contains_key(ranks, F.col("o_orderpriority")).alias("known"),
    )


# ---- layout ---------------------------------------------------------------


@query("hash_partitioned_count", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1")
def _partitioned(t):
    # Counts combine before the explicit partitioning, which the last grouping then reuses.
    counted = keyed.count_by(t.orders, ["o_custkey", "o_orderstatus"])
    return hash_partition(counted, "o_custkey").groupBy("o_custkey").agg(F.sum("n").alias("n"))


@query(
    "materialized_reuse",
    """SELECT o_custkey, n, (SELECT max(n) FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)) AS most
    FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)""",
)
def _reuse(t):
    counted = materialize(keyed.count_by(t.orders, "o_custkey"))
    most = counted.agg(F.max("n")).scalar()
    return counted.withColumn("most", most)


@query("partition_inspection", "SELECT 8 AS partitions, count(*) AS n_rows FROM orders")
def _inspection(t):
    sizes = partition_sizes(hash_partition(t.orders.select("o_orderkey"), "o_orderkey", 8))
    return sizes.agg(F.count(F.lit(1)).cast("int").alias("partitions"), F.sum("n_rows").alias("n_rows"))
