"""The reference's concepts bound to the shared tables, in Spark and, as text, in SQL.

Each binding is a function of :class:`Tables`; the constant of the same name
in capitals is the common table expression of the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tagtrail.functions.dates import before_day, hours_between, on_or_after
from tagtrail.operators.graph import degrees
from tagtrail.operators.ordered import previous_event, transitions
from tagtrail.session import materialize
from tagtrail.sources.tables import Tables
from tagtrail.sources.text import in_memory

# The input place, the day to predict and the first day that counts.
PLACE = "purchase"
DAY = "2024-01-20"
START = "2024-01-05"

# Distances from the input place, covering near, gap and far.
DISTANCES = [
    ("purchase", "click", 120.0),
    ("purchase", "signup", 450.0),
    ("purchase", "view", 700.0),
    ("purchase", "error", 1500.0),
]

# Codes of the priorities that stand for states; one is left out on purpose.
STATE_CODES = [("UR", "1-URGENT"), ("HI", "2-HIGH"), ("ME", "3-MEDIUM"), ("LO", "5-LOW")]

# The two-letter codes a registration may start with.
KNOWN_CODES = ["AU", "BU", "FU", "HO", "MA"]


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


DISTANCE = f"distance(from_place, to_place, distance) AS (VALUES {_values(DISTANCES)})"
STATE_CODE = f"state_code(code, state) AS (VALUES {_values(STATE_CODES)})"
KNOWN_CODE = f"known_code(code) AS (VALUES {_values([(c,) for c in KNOWN_CODES])})"


def distance(t: Tables) -> DataFrame:
    return in_memory(t.spark, DISTANCES, "from_place string, to_place string, distance double")


def state_code(t: Tables) -> DataFrame:
    return in_memory(t.spark, STATE_CODES, "code string, state string")


def known_code(t: Tables) -> DataFrame:
    return in_memory(t.spark, [(c,) for c in KNOWN_CODES], "code string")


def visits(t: Tables) -> DataFrame:
    """A tag (user) passes a plaza (event type) by an entry and an exit lane at a time."""
    lane = F.get_json_object("props", "$.k").cast("int")
    return t.events.select(
        F.col("user_id").alias("tag"),
        F.col("event_type").alias("plaza"),
        F.concat(F.lit("E"), (lane % 10).cast("string")).alias("entry_lane"),
        F.concat(F.lit("X"), F.floor(lane / 10).cast("string")).alias("exit_lane"),
        F.col("ts").alias("time"),
    )


VISITS = """visits AS (
    SELECT user_id AS tag, event_type AS plaza,
           'E' || (CAST(json_extract_string(props, '$.k') AS INTEGER) % 10) AS entry_lane,
           'X' || (CAST(json_extract_string(props, '$.k') AS INTEGER) // 10) AS exit_lane, ts AS time
    FROM events)"""


def moves(t: Tables) -> DataFrame:
    """Consecutive visits of a tag at two different plazas."""
    return transitions(
        visits(t), "tag", "time", "plaza", ["entry_lane", "exit_lane"], tie=["plaza", "entry_lane", "exit_lane"]
    )


# Visits of one tag at one time collapse to the smallest plaza and lanes.
ORDERED = (
    VISITS
    + """, single AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tag, time ORDER BY plaza, entry_lane, exit_lane) AS copy
                   FROM visits) WHERE copy = 1),
ordered AS (
    SELECT tag, time, plaza, entry_lane, exit_lane,
           lag(time) OVER w AS prev_time, lag(plaza) OVER w AS prev_plaza,
           lag(entry_lane) OVER w AS prev_entry_lane, lag(exit_lane) OVER w AS prev_exit_lane,
           lead(time) OVER w AS next_time, lead(plaza) OVER w AS next_plaza
    FROM single WINDOW w AS (PARTITION BY tag ORDER BY time))"""
)

MOVES = (
    ORDERED
    + """, moves AS (
    SELECT tag, prev_time AS from_time, prev_plaza AS from_plaza, prev_entry_lane AS from_entry_lane,
           prev_exit_lane AS from_exit_lane, time AS to_time, plaza AS to_plaza, entry_lane AS to_entry_lane,
           exit_lane AS to_exit_lane, (epoch_us(time) - epoch_us(prev_time)) // 3600000000 AS hours
    FROM ordered WHERE prev_plaza IS NOT NULL AND prev_plaza <> plaza)"""
)


def move_edges(t: Tables) -> DataFrame:
    """Plaza-to-plaza edges weighted with the mean hours."""
    return (
        moves(t)
        .groupBy(F.col("from_plaza").alias("src"), F.col("to_plaza").alias("dst"))
        .agg((F.sum("hours") / F.count("hours")).alias("weight"))
        .where(F.col("weight") > 0)
    )


MOVE_EDGES = (
    MOVES
    + """, move_edges AS (
    SELECT from_plaza AS src, to_plaza AS dst, CAST(sum(hours) AS DOUBLE) / count(hours) AS weight
    FROM moves GROUP BY 1, 2 HAVING sum(hours) > 0)"""
)


def trips(t: Tables) -> DataFrame:
    """A distance (the event's value) and the whole hours since the tag's previous event."""
    events = t.events.select(
        F.col("user_id").alias("tag"), F.col("event_type").alias("plaza"), F.col("ts").alias("time"), "value"
    )
    return previous_event(events, "tag", "time", ["plaza", "time"], tie=["plaza", "value"]).select(
        "tag",
        "time",
        "plaza",
        "prev_plaza",
        "prev_time",
        F.col("value").alias("distance"),
        hours_between("prev_time", "time").alias("time_diff"),
    )


TRIPS = """trips AS (
    SELECT *, (epoch_us(time) - epoch_us(prev_time)) // 3600000000 AS time_diff
    FROM (SELECT tag, time, plaza, value AS distance,
                 lag(plaza) OVER w AS prev_plaza, lag(time) OVER w AS prev_time
          FROM (SELECT user_id AS tag, event_type AS plaza, ts AS time, value,
                       row_number() OVER (PARTITION BY user_id, ts ORDER BY event_type, value) AS copy FROM events)
          WHERE copy = 1 WINDOW w AS (PARTITION BY tag ORDER BY time)))"""


def tag_states(t: Tables) -> DataFrame:
    """Each order shows its customer's tag in the state its priority stands for."""
    return t.orders.select(
        F.concat(
            F.when(F.col("o_custkey") % 5 == 0, "35").when(F.col("o_custkey") % 2 == 0, "91").otherwise("34"),
            F.lpad(F.col("o_custkey").cast("string"), 18, "0"),
        ).alias("tag"),
        F.col("o_orderpriority").alias("state"),
    )


TAG_STATES = """tag_states AS (
    SELECT (CASE WHEN o_custkey % 5 = 0 THEN '35' WHEN o_custkey % 2 = 0 THEN '91' ELSE '34' END)
           || lpad(CAST(o_custkey AS VARCHAR), 18, '0') AS tag, o_orderpriority AS state
    FROM orders)"""


def registrations(t: Tables) -> DataFrame:
    """Per order: the customer as tag, a registration that may be masked or malformed, a state."""
    number = 1000 + F.when(F.col("o_custkey") % 5 == 0, F.col("o_orderkey") % 2).otherwise(0)
    good = F.concat(
        F.upper(F.substring("c_mktsegment", 1, 2)),
        F.lpad(F.col("c_nationkey").cast("string"), 2, "0"),
        F.lit("AB"),
        number.cast("string"),
    )
    value = (
        F.when(F.col("o_orderkey") % 7 == 0, "XXXXXXXX")
        .when(F.col("o_custkey") % 3 == 0, F.concat(F.lit("BAD-"), F.col("o_orderkey").cast("string")))
        .otherwise(good)
    )
    customers = t.customer.select("c_custkey", "c_mktsegment", "c_nationkey")
    return t.orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_custkey").alias("tag"), value.alias("registration"), F.col("o_orderpriority").alias("state")
    )


REGISTRATIONS = """registrations AS (
    SELECT o_custkey AS tag, o_orderpriority AS state,
           CASE WHEN o_orderkey % 7 = 0 THEN 'XXXXXXXX'
                WHEN o_custkey % 3 = 0 THEN 'BAD-' || o_orderkey
                ELSE upper(substr(c_mktsegment, 1, 2)) || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || 'AB'
                     || (1000 + CASE WHEN o_custkey % 5 = 0 THEN o_orderkey % 2 ELSE 0 END)
           END AS registration
    FROM orders JOIN customer ON o_custkey = c_custkey)"""


def amounts(t: Tables, until: str) -> DataFrame:
    """(class, plaza, amount, frequency) counted over ship dates from 1998-01-01 up to ``until``."""
    lines = t.lineitem.where(on_or_after("l_shipdate", "1998-01-01") & before_day("l_shipdate", until))
    return (
        lines.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(t.part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(
            F.col("c_mktsegment").alias("vehicle_class"),
            F.col("p_brand").alias("plaza"),
            F.col("l_quantity").alias("amount"),
        )
        .agg(F.count(F.lit(1)).alias("frequency"))
    )


def priced_lines(t: Tables) -> DataFrame:
    """The lines of open orders and of the price windows with tag, plaza, segment and amount: one join of four tables, written once.

    ``open`` marks lines of orders in process; ``short`` and ``long`` mark ship dates in the two windows.
    """
    short, long = (on_or_after("l_shipdate", "1998-01-01") & before_day("l_shipdate", until) for until in (SHORT_UNTIL, LONG_UNTIL))
    lines = t.lineitem.select("l_orderkey", "l_partkey", F.col("l_quantity").alias("amount"), short.alias("short"), long.alias("long"))
    opened = t.orders.select("o_orderkey", "o_custkey", (F.col("o_orderstatus") == "P").alias("open"))
    wanted = lines.join(opened, F.col("l_orderkey") == F.col("o_orderkey")).where(F.col("open") | F.col("long"))
    joined = wanted.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    kept = joined.select(
        F.col("o_custkey").alias("tag"), F.col("p_brand").alias("plaza"), F.col("c_mktsegment").alias("segment"), "amount", "open", "short", "long"
    )
    return materialize(kept, "lines")


def amounts_by_window(lines: DataFrame) -> DataFrame:
    """(class, plaza, amount, short, long): how often an amount was paid in each window, both counted in one grouping."""
    return (
        lines.where("long")
        .groupBy(F.col("segment").alias("vehicle_class"), "plaza", "amount")
        .agg(F.count_if("short").alias("short"), F.count(F.lit(1)).alias("long"))
    )


def unpriced(lines: DataFrame) -> DataFrame:
    """Distinct (tag, plaza, class) that need an amount; one market segment has no class."""
    named = (F.col("segment") != "FURNITURE") | (F.col("tag") % 11 != 0)
    return lines.where("open").select("tag", "plaza", F.when(named, F.col("segment")).alias("vehicle_class")).distinct()


def _amounts_sql(name: str, until: str) -> str:
    return f"""{name} AS (
    SELECT c_mktsegment AS vehicle_class, p_brand AS plaza, l_quantity AS amount, count(*) AS frequency
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN part ON l_partkey = p_partkey
    WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_shipdate < TIMESTAMP '{until}' GROUP BY 1, 2, 3)"""


SHORT_UNTIL, LONG_UNTIL = "1998-01-08", "1998-01-15"
AMOUNTS = (
    _amounts_sql("short_amounts", SHORT_UNTIL)
    + ", "
    + _amounts_sql("long_amounts", LONG_UNTIL)
    + """, short_modal AS (
    SELECT vehicle_class, plaza, amount FROM (
        SELECT *, row_number() OVER (PARTITION BY vehicle_class, plaza ORDER BY frequency DESC, amount) AS pos
        FROM short_amounts WHERE amount <> 0) WHERE pos = 1),
long_modal AS (
    SELECT vehicle_class, plaza, amount FROM (
        SELECT *, row_number() OVER (PARTITION BY vehicle_class, plaza ORDER BY frequency DESC, amount) AS pos
        FROM long_amounts WHERE amount <> 0) WHERE pos = 1)"""
)


UNPRICED = """unpriced AS (
    SELECT DISTINCT o_custkey AS tag, p_brand AS plaza,
           CASE WHEN c_mktsegment <> 'FURNITURE' OR o_custkey % 11 <> 0 THEN c_mktsegment END AS vehicle_class
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON o_orderkey = l_orderkey
    JOIN part ON l_partkey = p_partkey WHERE o_orderstatus = 'P')"""


def ratings(t: Tables) -> DataFrame:
    """A customer rates a supplier with the mean quantity bought from it."""
    return (
        t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy(F.col("o_custkey").alias("user"), F.col("l_suppkey").alias("item"))
        .agg(F.avg("l_quantity").alias("rating"))
    )


RATINGS = """ratings AS (
    SELECT o_custkey AS user_id, l_suppkey AS item, avg(l_quantity) AS rating
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"""

PAIR_SCORES = (
    RATINGS
    + """, pair_scores AS (
    SELECT a.item AS item_1, b.item AS item_2, count(*) AS strength,
           CASE WHEN sqrt(sum(a.rating * a.rating)) * sqrt(sum(b.rating * b.rating)) = 0 THEN 0.0
                ELSE sum(a.rating * b.rating) / (sqrt(sum(a.rating * a.rating)) * sqrt(sum(b.rating * b.rating)))
           END AS score
    FROM ratings a JOIN ratings b ON a.user_id = b.user_id AND a.item < b.item GROUP BY 1, 2)"""
)

# The score a similar item must exceed, and the item whose partners are looked for.
MIN_SCORE, TARGET_ITEM = 0.8, 7


def mean_strength(rated: DataFrame) -> int:
    """The mean number of common users of two items, rounded down, 1 at least: known from the users' counts, without any pair.

    About half of all pairs reach it at any scale, so it serves as the support of the queries.
    """
    per_user = rated.groupBy("user").agg(F.count(F.lit(1)).alias("k"))
    products = per_user.agg(F.sum(F.col("k") * (F.col("k") - 1))).head()[0] or 0
    items = rated.select("item").distinct().count()
    return max(1, products // max(1, items * (items - 1)))


def likely_cosine(rated: DataFrame) -> float:
    """A cosine that a part of all pairs of items reaches at any scale: the mean strength over the mean number of raters, less a tenth."""
    items, n = rated.agg(F.countDistinct("item"), F.count(F.lit(1))).head()
    products = rated.groupBy("user").agg(F.count(F.lit(1)).alias("k")).agg(F.sum(F.col("k") * (F.col("k") - 1))).head()[0] or 0
    return max(0.01, 0.9 * products / max(1, (items - 1) * n))


LIKELY_COSINE = """(SELECT greatest(0.01, 0.9::DOUBLE * (SELECT sum(k * (k - 1)) FROM (SELECT count(*) AS k FROM ratings GROUP BY user_id))
        / (SELECT greatest(1, (count(DISTINCT item) - 1) * count(*)) FROM ratings)))"""

SUPPORT = """(SELECT greatest(1, (SELECT sum(k * (k - 1)) FROM (SELECT count(*) AS k FROM ratings GROUP BY user_id))
        // (SELECT count(DISTINCT item) * (count(DISTINCT item) - 1) FROM ratings)))"""


def supply_edges(t: Tables) -> DataFrame:
    """Both directions between a part (even id) and a supplier (odd id) for every line.

    Every line is an edge by itself, so no pairs are formed within an order.
    """
    part = F.col("l_partkey") * 2
    supplier = F.col("l_suppkey") * 2 + 1
    both = F.array(
        F.struct(part.alias("src"), supplier.alias("dst")), F.struct(supplier.alias("src"), part.alias("dst"))
    )
    return t.lineitem.select(F.inline(both))


SUPPLY_EDGES = """supply_edges AS (
    SELECT l_partkey * 2 AS src, l_suppkey * 2 + 1 AS dst FROM lineitem
    UNION ALL
    SELECT l_suppkey * 2 + 1, l_partkey * 2 FROM lineitem)"""


def supply_names(t: Tables) -> DataFrame:
    """Names of suppliers and of the smaller parts; larger parts stay nameless."""
    parts = t.part.where(F.col("p_size") <= 25).select((F.col("p_partkey") * 2).alias("id"), F.col("p_name").alias("name"))
    return parts.unionByName(t.supplier.select((F.col("s_suppkey") * 2 + 1).alias("id"), F.col("s_name").alias("name")))


SUPPLY_NAMES = """supply_names AS (
    SELECT p_partkey * 2 AS id, p_name AS name FROM part WHERE p_size <= 25
    UNION ALL SELECT s_suppkey * 2 + 1, s_name FROM supplier)"""


def busiest(edges: DataFrame) -> DataFrame:
    """The vertex with most edges; ties go to the smallest id."""
    return degrees(edges).orderBy(F.desc("degree"), F.asc("id")).limit(1).select("id")


BUSIEST = """busiest AS (
    SELECT src AS id FROM (SELECT src, count(*) AS n FROM supply_edges GROUP BY 1) ORDER BY n DESC, src LIMIT 1)"""
