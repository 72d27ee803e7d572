"""Toll-transaction queries: last place, dominance, transitions, features, imputation, quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagtrail.functions import text
from tagtrail.functions.dates import hours_between
from tagtrail.functions.text import joined_key, present, unmasked
from tagtrail.operators import dominant, features, graph, impute, latest, ordered, quality
from tagtrail.operators.keyed import valued_pairs
from tagtrail.plans import bindings as b
from tagtrail.plans.registry import query

_BY_DAY = "CAST(time AS DATE)"
_BACK = f"date_diff('day', {_BY_DAY}, DATE '{b.DAY}')"


@query(
    "last_event",
    f"""WITH {b.VISITS}
    SELECT tag, plaza, entry_lane, exit_lane, time FROM (
        SELECT *, row_number() OVER (PARTITION BY tag ORDER BY time DESC, plaza, entry_lane, exit_lane) AS pos
        FROM visits WHERE {_BY_DAY} <= DATE '{b.DAY}') WHERE pos = 1""",
)
def _last_event(t):
    return latest.last_event(b.visits(t), "tag", "time", b.DAY, ["plaza", "entry_lane", "exit_lane"])


def dominant_sql(source: str, test: str) -> str:
    return f"""SELECT tag, state, CAST(n AS BIGINT) AS count, CAST(total AS BIGINT) AS total,
               CAST(n AS DOUBLE) / total AS share FROM (
        SELECT *, sum(n) OVER (PARTITION BY tag) AS total,
               row_number() OVER (PARTITION BY tag ORDER BY n DESC, state) AS pos
        FROM (SELECT tag, state, count(*) AS n FROM {source} WHERE state IS NOT NULL GROUP BY 1, 2))
    WHERE pos = 1 AND CAST(n AS DOUBLE) / total {test}"""


@query("dominant_category", f"WITH {b.TAG_STATES} {dominant_sql('tag_states', '>= 0.25')}")
def _dominant_category(t):
    return dominant.dominant_category(b.tag_states(t), "tag", "state", 0.25)


@query("dominant_category_majority", f"WITH {b.TAG_STATES} {dominant_sql('tag_states', '> 0.5')}")
def _dominant_majority(t):
    return dominant.dominant_category(b.tag_states(t), "tag", "state", 0.5, strict=True)


@query(
    "tag_state",
    f"""WITH {b.TAG_STATES}, {b.STATE_CODE},
    clean AS (SELECT * FROM tag_states WHERE regexp_matches(tag, '^(34|91)') AND length(tag) BETWEEN 20 AND 24)
    SELECT best.tag, best.state, best.count, best.total, coalesce(code, best.tag) AS code
    FROM ({dominant_sql('clean', '>= 0.25')}) best LEFT JOIN state_code ON best.state = state_code.state""",
)
def _tag_state(t):
    return dominant.tag_state(b.tag_states(t), b.state_code(t))


_VALID = f"""WITH {b.REGISTRATIONS}, {b.KNOWN_CODE}, valid AS (
    SELECT DISTINCT tag, registration FROM registrations
    WHERE regexp_matches(registration, '{text.REGISTRATION_ANY}')
      AND substr(registration, 1, 2) IN (SELECT code FROM known_code)),
sized AS (SELECT *, count(*) OVER (PARTITION BY tag) AS n_values FROM valid)"""


@query("valid_unique", _VALID + " SELECT tag, registration FROM sized WHERE n_values = 1")
def _valid_unique(t):
    return impute.split_by_validity(b.registrations(t), "tag", "registration", codes=b.known_code(t))[0]


@query(
    "valid_multi",
    _VALID + " SELECT tag, registration, n_values FROM sized WHERE n_values > 1",
)
def _valid_multi(t):
    return impute.split_by_validity(b.registrations(t), "tag", "registration", codes=b.known_code(t))[1]


_NEED = "SELECT c_custkey AS tag FROM customer WHERE c_acctbal > 0"


def _need(t):
    return t.customer.where(F.col("c_acctbal") > 0).select(F.col("c_custkey").alias("tag"))


@query(
    "impute_registration",
    f"""WITH {b.REGISTRATIONS}, {b.STATE_CODE}, need AS ({_NEED}),
    found AS (SELECT * FROM registrations WHERE tag IN (SELECT tag FROM need)),
    valid AS (SELECT DISTINCT tag, registration FROM found
              WHERE regexp_matches(registration, '{text.REGISTRATION_LOOSE}')),
    sized AS (SELECT *, count(*) OVER (PARTITION BY tag) AS n_values FROM valid),
    rest AS (SELECT * FROM found WHERE tag NOT IN (SELECT tag FROM valid)),
    made AS (SELECT best.tag, coalesce(code, 'default') || '00' AS value
             FROM ({dominant_sql('rest', '>= 0.25')}) best LEFT JOIN state_code ON best.state = state_code.state)
    SELECT tag, CASE WHEN n_values = 1 THEN 'unique' ELSE 'multi' END AS method, registration AS value FROM sized
    UNION ALL
    SELECT tag, 'imputed', value FROM made
    UNION ALL
    SELECT tag, 'remaining', NULL FROM need
    WHERE tag NOT IN (SELECT tag FROM valid) AND tag NOT IN (SELECT tag FROM made)""",
)
def _impute_registration(t):
    return impute.impute_registration(_need(t), b.registrations(t), b.state_code(t), keep=F.lit(True))


@query(
    "unmatched_residue",
    f"""WITH {b.REGISTRATIONS}
    SELECT c_custkey AS tag, c_name AS name FROM customer
    WHERE c_custkey NOT IN (SELECT tag FROM registrations
                            WHERE regexp_matches(registration, '{text.REGISTRATION_ANY}'))
      AND c_custkey NOT IN (SELECT tag FROM registrations WHERE state IN ('1-URGENT', '2-HIGH'))""",
)
def _unmatched(t):
    need = t.customer.select(F.col("c_custkey").alias("tag"), F.col("c_name").alias("name"))
    seen = b.registrations(t)
    valid = impute.valid_registrations(seen, "registration")
    return impute.unmatched(need, valid, seen.where(F.col("state").isin("1-URGENT", "2-HIGH")))


_MODAL = f"""WITH {b.AMOUNTS}, {b.UNPRICED}, priced AS (
    SELECT u.vehicle_class, u.plaza, u.tag, coalesce(s.amount, l.amount) AS amount,
           CASE WHEN s.amount IS NOT NULL THEN 1 WHEN l.amount IS NOT NULL THEN 2 END AS source
    FROM unpriced u LEFT JOIN short_modal s ON u.vehicle_class = s.vehicle_class AND u.plaza = s.plaza
    LEFT JOIN long_modal l ON u.vehicle_class = l.vehicle_class AND u.plaza = l.plaza)"""


def _priced(t):
    lines = b.priced_lines(t)
    priced = impute.impute_modal_windows(b.unpriced(lines), b.amounts_by_window(lines), frequencies=["short", "long"])
    return priced.select("vehicle_class", "plaza", "tag", "amount", "source")


@query("impute_modal_amount", _MODAL + " SELECT * FROM priced")
def _impute_modal(t):
    return _priced(t)


@query("impute_modal_remaining", _MODAL + " SELECT tag, plaza, vehicle_class FROM priced WHERE amount IS NULL")
def _impute_remaining(t):
    return _priced(t).where(F.col("amount").isNull()).select("tag", "plaza", "vehicle_class")


@query(
    "impute_modal_blank_class",
    f"""WITH {b.AMOUNTS}, {b.UNPRICED}
    SELECT u.tag, u.plaza, CASE WHEN u.vehicle_class = 'FURNITURE' THEN '' ELSE u.vehicle_class END AS vehicle_class, s.amount
    FROM unpriced u LEFT JOIN short_modal s
    ON u.vehicle_class = s.vehicle_class AND u.plaza = s.plaza AND s.vehicle_class <> 'FURNITURE'""",
)
def _impute_blank_class(t):
    """A blank class is no class: it has no modal amount, and its rows remain."""
    blank = F.when(F.col("vehicle_class") == "FURNITURE", "").otherwise(F.col("vehicle_class"))
    lines = b.priced_lines(t)
    counted = b.amounts_by_window(lines).withColumn("vehicle_class", blank)
    need = b.unpriced(lines).withColumn("vehicle_class", blank)
    return impute.impute_modal_windows(need, counted, frequencies="short").select("tag", "plaza", "vehicle_class", "amount")


@query(
    "impute_modal_single_window",
    f"""WITH {b.AMOUNTS}, {b.UNPRICED}
    SELECT u.tag, u.plaza, u.vehicle_class, s.amount
    FROM unpriced u JOIN short_modal s ON u.vehicle_class = s.vehicle_class AND u.plaza = s.plaza""",
)
def _impute_single(t):
    lines = b.priced_lines(t)
    return (
        impute.impute_modal_windows(b.unpriced(lines), b.amounts_by_window(lines), frequencies="short")
        .where(F.col("amount").isNotNull())
        .select("tag", "plaza", "vehicle_class", "amount")
    )


@query(
    "multi_valued_latest",
    f"""WITH {b.VISITS}
    SELECT entry_lane, tag, time FROM (
        SELECT entry_lane, tag, time, row_number() OVER (PARTITION BY entry_lane ORDER BY time DESC, tag) AS pos,
               min(tag) OVER (PARTITION BY entry_lane) AS low, max(tag) OVER (PARTITION BY entry_lane) AS high
        FROM visits) WHERE pos = 1 AND low <> high""",
)
def _multi_valued_latest(t):
    return latest.multi_valued_latest(b.visits(t), "entry_lane", "tag", "time")


@query(
    "multi_values",
    f"""WITH {b.REGISTRATIONS}, pairs AS (SELECT DISTINCT tag, registration FROM registrations)
    SELECT tag, registration, CAST(n_values AS BIGINT) AS n_values FROM (
        SELECT *, count(*) OVER (PARTITION BY tag) AS n_values FROM pairs) WHERE n_values > 1""",
)
def _multi_values(t):
    return latest.multi_values(b.registrations(t), "tag", "registration")


_FAST = f"""WITH {b.TRIPS}, fast AS (
    SELECT *, distance / CASE WHEN time_diff <> 0 THEN CAST(time_diff AS DOUBLE) ELSE 0.5 END AS speed
    FROM trips WHERE distance IS NOT NULL AND distance <> 0 AND tag IS NOT NULL AND prev_plaza IS NOT NULL)"""


def _fast(t, limit):
    return quality.speed_anomaly(b.trips(t).where(F.col("prev_plaza").isNotNull()), limit)


@query(
    "speed_anomaly",
    _FAST
    + """ SELECT tag, time, plaza, prev_plaza, prev_time, distance, CAST(time_diff AS BIGINT) AS time_diff, speed
    FROM fast WHERE speed > 150""",
)
def _speed_anomaly(t):
    return _fast(t, 150.0)


@query(
    "anomaly_overlap",
    _FAST
    + """, a AS (SELECT DISTINCT tag FROM fast WHERE speed > 150),
    m AS (SELECT DISTINCT o_custkey AS tag FROM orders WHERE o_totalprice > 400000)
    SELECT (SELECT count(*) FROM m) AS left_keys, (SELECT count(*) FROM a) AS right_keys,
           (SELECT count(*) FROM a JOIN m USING (tag)) AS shared_keys""",
)
def _anomaly_overlap(t):
    rich = t.orders.where(F.col("o_totalprice") > 400000).select(F.col("o_custkey").alias("tag"))
    return quality.overlap(rich, _fast(t, 150.0), "tag")


@query(
    "transitions",
    f"""WITH {b.MOVES} SELECT tag, from_time, from_plaza, from_entry_lane, from_exit_lane, to_time, to_plaza,
        to_entry_lane, to_exit_lane, CAST(hours AS BIGINT) AS hours FROM moves""",
)
def _transitions(t):
    return b.moves(t)


@query(
    "dominant_neighbour_by_lane",
    f"""WITH {b.MOVES}, counted AS (
        SELECT to_plaza, to_entry_lane, from_plaza, count(*) AS n FROM moves GROUP BY 1, 2, 3)
    SELECT to_plaza, to_entry_lane, from_plaza, n AS count, CAST(total AS BIGINT) AS total,
           n * 100.0::DOUBLE / total AS percent FROM (
        SELECT *, sum(n) OVER (PARTITION BY to_plaza, to_entry_lane) AS total,
               row_number() OVER (PARTITION BY to_plaza, to_entry_lane ORDER BY n DESC, from_plaza) AS pos
        FROM counted) WHERE pos = 1""",
)
def _dominant_lane(t):
    return dominant.dominant_neighbour(b.moves(t), ["to_plaza", "to_entry_lane"], "from_plaza")


_NEXT = f"""WITH {b.MOVES}, counted AS (
        SELECT from_plaza, from_exit_lane, to_plaza, count(*) AS n, sum(hours) AS hours,
               string_agg(DISTINCT to_entry_lane, '|' ORDER BY to_entry_lane) AS lanes
        FROM moves GROUP BY 1, 2, 3)
    SELECT from_plaza, from_exit_lane, to_plaza, n AS count, CAST(total AS BIGINT) AS total,
           n * 100.0::DOUBLE / total AS percent, CAST(hours AS DOUBLE) / n AS mean_hours, lanes FROM (
        SELECT *, sum(n) OVER (PARTITION BY from_plaza, from_exit_lane) AS total,
               row_number() OVER (PARTITION BY from_plaza, from_exit_lane ORDER BY n DESC, to_plaza) AS pos
        FROM counted) WHERE pos = 1"""


def _next_place(t):
    return dominant.dominant_neighbour(
        b.moves(t), ["from_plaza", "from_exit_lane"], "to_plaza", hours=True, joined="to_entry_lane"
    )


@query("dominant_next_place", _NEXT)
def _dominant_next(t):
    return _next_place(t)


@query("dominant_next_place_of_one", f"{_NEXT} AND from_plaza = '{b.PLACE}'")
def _dominant_next_one(t):
    return _next_place(t).where(F.col("from_plaza") == b.PLACE)


_PREV = f"""{b.MOVES}, prev_counted AS (
        SELECT to_plaza, to_entry_lane, from_plaza, from_exit_lane, count(*) AS n, sum(hours) AS hours
        FROM moves GROUP BY 1, 2, 3, 4),
    prev_lane AS (
        SELECT to_plaza, to_entry_lane, from_plaza, from_exit_lane, n AS count, CAST(total AS BIGINT) AS total,
               n * 100.0::DOUBLE / total AS percent, CAST(hours AS DOUBLE) / n AS mean_hours FROM (
            SELECT *, sum(n) OVER (PARTITION BY to_plaza, to_entry_lane) AS total,
                   row_number() OVER (PARTITION BY to_plaza, to_entry_lane
                                      ORDER BY n DESC, from_plaza, from_exit_lane) AS pos
            FROM prev_counted) WHERE pos = 1)"""


def _prev_lane(t):
    return dominant.dominant_neighbour(
        b.moves(t), ["to_plaza", "to_entry_lane"], ["from_plaza", "from_exit_lane"], hours=True
    )


@query("dominant_prev_place_lane", f"WITH {_PREV} SELECT * FROM prev_lane")
def _dominant_prev(t):
    return _prev_lane(t)


_PRE = ", ".join(f"max(CASE WHEN back = {i} THEN 1 ELSE 0 END) AS pre_{i}" for i in range(1, 8))


@query(
    "presence_flags",
    f"""WITH {b.VISITS}, dated AS (SELECT *, {_BACK} AS back FROM visits)
    SELECT tag, {_PRE} FROM dated WHERE plaza = '{b.PLACE}' AND back BETWEEN 1 AND 7 GROUP BY tag""",
)
def _presence(t):
    return features.presence_flags(b.visits(t), "tag", "plaza", "time", b.PLACE, b.DAY)


_RATIO = """CAST(count(DISTINCT back) AS BIGINT) AS active_days, CAST(max(back) AS INTEGER) AS span_days,
    round_even(CAST(count(DISTINCT back) AS DOUBLE) / max(back), 4) AS days_ratio"""


@query(
    "active_day_ratio",
    f"""WITH {b.VISITS}, dated AS (SELECT *, {_BACK} AS back FROM visits)
    SELECT tag, {_RATIO} FROM dated WHERE back >= 1 AND {_BY_DAY} >= DATE '{b.START}' GROUP BY tag""",
)
def _ratio(t):
    return features.active_day_ratio(b.visits(t), "tag", "time", b.DAY, b.START)


@query(
    "active_day_ratio_all_history",
    f"""WITH {b.VISITS}, dated AS (SELECT *, {_BACK} AS back FROM visits)
    SELECT tag, {_RATIO} FROM dated WHERE back >= 1 GROUP BY tag""",
)
def _ratio_all(t):
    return features.active_day_ratio(b.visits(t), "tag", "time", b.DAY)


_CLOSE = f"""day_before AS (
        SELECT tag, plaza, row_number() OVER (PARTITION BY tag ORDER BY time DESC, plaza) AS pos
        FROM visits WHERE {_BACK} = 1),
    close AS (
        SELECT tag, plaza, coalesce(distance, -1.0) AS distance FROM day_before
        LEFT JOIN (SELECT * FROM distance WHERE from_place = '{b.PLACE}') ON plaza = to_place WHERE pos = 1)"""
_NEAR = "CASE WHEN distance > 0 AND distance < 500 THEN 1 ELSE 0 END"
_FAR = "CASE WHEN distance > 1000 THEN 1 ELSE 0 END"


@query(
    "proximity",
    f"""WITH {b.VISITS}, {b.DISTANCE}, {_CLOSE}
    SELECT tag, plaza, CAST(distance AS DOUBLE) AS distance, {_NEAR} AS nearer, {_FAR} AS distant FROM close""",
)
def _proximity(t):
    return features.proximity(b.visits(t), b.distance(t), "tag", "plaza", "time", b.PLACE, b.DAY)


@query(
    "label_on_day",
    f"""WITH {b.VISITS} SELECT tag, max(CASE WHEN plaza = '{b.PLACE}' AND {_BY_DAY} = DATE '{b.DAY}'
        THEN 1 ELSE 0 END) AS txn_on_day FROM visits GROUP BY tag""",
)
def _label(t):
    return features.label_on_day(b.visits(t), "tag", "plaza", "time", b.PLACE, b.DAY)


def _feature_sql(keep: str, start: str = b.START) -> str:
    flags = ", ".join(
        f"max(CASE WHEN plaza = '{b.PLACE}' AND back = {i} THEN 1 ELSE 0 END) AS pre_{i}" for i in range(1, 8)
    )
    return f"""WITH {b.VISITS}, {b.DISTANCE}, {_CLOSE}, dated AS (
        SELECT *, {_BACK} AS back FROM visits WHERE {_BY_DAY} BETWEEN DATE '{start}' AND DATE '{b.DAY}'),
    per_tag AS (
        SELECT tag, max(CASE WHEN plaza = '{b.PLACE}' AND back = 0 THEN 1 ELSE 0 END) AS txn_on_day,
               coalesce(round_even(CAST(count(DISTINCT CASE WHEN back >= 1 THEN back END) AS DOUBLE)
                        / max(CASE WHEN back >= 1 THEN back END), 4), 0.0) AS days_ratio, {flags},
               max(CASE WHEN back >= 1 THEN 1 ELSE 0 END) AS was_active,
               max(CASE WHEN plaza = '{b.PLACE}' AND back BETWEEN 1 AND 7 THEN 1 ELSE 0 END) AS was_here
        FROM dated GROUP BY tag)
    SELECT tag, txn_on_day, coalesce({_NEAR}, 0) AS nearer, coalesce({_FAR}, 0) AS distant, days_ratio,
           {', '.join(f'pre_{i}' for i in range(1, 8))}
    FROM per_tag LEFT JOIN close USING (tag) WHERE {keep}"""


def feature_table(t, how="outer", start=b.START):
    return features.feature_table(b.visits(t), b.distance(t), "tag", "plaza", "time", b.PLACE, b.DAY, start, how=how)


@query("feature_table", _feature_sql("true"))
def _features(t):
    return feature_table(t)


# With the window starting on D itself there is no day before it: no error, and every ratio is 0.
_FIRST_DAY = _feature_sql("true", b.DAY).replace(f"FROM visits WHERE {_BACK} = 1)", "FROM visits WHERE false)")


@query("feature_table_first_day", _FIRST_DAY)
def _features_first_day(t):
    return feature_table(t, start=b.DAY)


@query("feature_table_left", _feature_sql("was_active = 1"))
def _features_left(t):
    return feature_table(t, "left")


@query("feature_table_inner", _feature_sql("was_active = 1 AND was_here = 1"))
def _features_inner(t):
    return feature_table(t, "inner")


_DAYS = ", ".join(
    f"max(CASE WHEN date_diff('day', CAST(v.time AS DATE), CAST(l.time AS DATE)) = {i} THEN 1 ELSE 0 END) AS day_{i}"
    for i in range(1, 8)
)


@query(
    "history_vector",
    f"""WITH {b.VISITS}, l AS (
        SELECT tag, plaza, time FROM (
            SELECT *, row_number() OVER (PARTITION BY tag ORDER BY time DESC, plaza) AS pos FROM visits) WHERE pos = 1)
    SELECT l.tag, l.plaza, l.time AS last_ts, {_DAYS}
    FROM l JOIN visits v ON l.tag = v.tag AND l.plaza = v.plaza GROUP BY 1, 2, 3""",
)
def _history(t):
    return latest.history_vector(b.visits(t), "tag", "plaza", "time")


HOP_BUDGET = 48.0


def _ends_sql(prefix: str) -> str:
    return f"""lane_edges AS (
        SELECT to_plaza || to_entry_lane AS src, from_plaza || from_entry_lane AS dst,
               greatest(1, CAST(floor(mean_hours * 60.0::DOUBLE + 0.5::DOUBLE) AS BIGINT)) AS minutes
        FROM ({prefix}) WHERE mean_hours > 0),
    walk AS (
        SELECT dst, minutes AS total, true AS seed FROM lane_edges WHERE starts_with(src, '{b.PLACE}')
        UNION
        SELECT e.dst, w.total + e.minutes, false FROM walk w JOIN lane_edges e ON w.dst = e.src
        WHERE w.seed OR w.total <= {HOP_BUDGET} * 60),
    ends AS (SELECT DISTINCT dst FROM walk WHERE NOT seed AND total > {HOP_BUDGET} * 60)"""


# Lanes are named by the entry lane at both ends here, so that chains connect.
_ENTRY_PREV = """SELECT to_plaza, to_entry_lane, from_plaza, from_entry_lane, CAST(hours AS DOUBLE) / n AS mean_hours
    FROM (SELECT *, row_number() OVER (PARTITION BY to_plaza, to_entry_lane
                                       ORDER BY n DESC, from_plaza, from_entry_lane) AS pos
          FROM (SELECT to_plaza, to_entry_lane, from_plaza, from_entry_lane, count(*) AS n, sum(hours) AS hours
                FROM moves GROUP BY 1, 2, 3, 4)) WHERE pos = 1"""
_ENDS = f"RECURSIVE {b.MOVES}, {_ends_sql(_ENTRY_PREV)}"


def entry_edges(t):
    best = dominant.dominant_neighbour(
        b.moves(t), ["to_plaza", "to_entry_lane"], ["from_plaza", "from_entry_lane"], hours=True
    )
    return best.where(F.col("mean_hours") > 0).select(
        joined_key("to_plaza", "to_entry_lane").alias("src"),
        joined_key("from_plaza", "from_entry_lane").alias("dst"),
        F.col("mean_hours").alias("weight"),
    )


def _lane_ends(t):
    return graph.reached_ends(entry_edges(t), F.col("src").startswith(b.PLACE), HOP_BUDGET)


@query("reached_lanes", f"WITH {_ENDS} SELECT dst FROM ends")
def _reached_lanes(t):
    return _lane_ends(t)


def _cohort(t, fan_out):
    events = b.visits(t).select("tag", joined_key("plaza", "entry_lane").alias("plazalane"), "time")
    master = t.customer.select(
        F.col("c_custkey").alias("tag"), F.col("c_mktsegment").alias("class"), F.col("c_name").alias("name")
    )
    ends = _lane_ends(t).select(F.col("dst").alias("plazalane"))
    at_input = F.col("plazalane").startswith(b.PLACE)
    return features.reached_cohort(ends, events, master, "tag", "plazalane", "time", at_input, b.DAY, fan_out)


def _moment(column: str) -> str:
    """A timestamp as Spark shows it: fractions without trailing zeros."""
    return f"rtrim(rtrim(strftime({column}, '%Y-%m-%d %H:%M:%S.%f'), '0'), '.')"


_COHORT = f"""WITH {_ENDS}, seen AS (SELECT tag, plaza || entry_lane AS plazalane, time, {_BACK} AS back FROM visits),
    cohort AS (SELECT * FROM seen WHERE back = 1 AND plazalane IN (SELECT dst FROM ends)),
    at_input AS (SELECT * FROM seen WHERE starts_with(plazalane, '{b.PLACE}'))"""


@query(
    "reached_cohort",
    _COHORT
    + f""" SELECT c.tag, c.plazalane, {_moment('c.time')} AS time,
        coalesce({_moment('d.time')}, '0') AS input_time, CASE WHEN d.tag IS NULL THEN '0' ELSE '1' END AS txn_input_day,
        coalesce({_moment('n.time')}, '0') AS next_time, CASE WHEN n.tag IS NULL THEN '0' ELSE '1' END AS txn_next_day,
        coalesce(c_mktsegment, '0') AS class, coalesce(c_name, '0') AS name
    FROM cohort c LEFT JOIN (SELECT * FROM at_input WHERE back = 0) d ON c.tag = d.tag
    LEFT JOIN (SELECT * FROM at_input WHERE back = -1) n ON c.tag = n.tag
    LEFT JOIN customer ON c.tag = c_custkey""",
)
def _reached_cohort(t):
    return _cohort(t, True)


@query(
    "reached_cohort_first_events",
    _COHORT
    + f""", d AS (SELECT tag, min(time) AS time, count(*) AS n FROM at_input WHERE back = 0 GROUP BY tag),
    n AS (SELECT tag, min(time) AS time, count(*) AS n FROM at_input WHERE back = -1 GROUP BY tag)
    SELECT c.tag, c.plazalane, {_moment('c.time')} AS time,
        coalesce({_moment('d.time')}, '0') AS input_time, CASE WHEN d.tag IS NULL THEN '0' ELSE '1' END AS txn_input_day,
        coalesce(CAST(d.n AS VARCHAR), '0') AS input_events,
        coalesce({_moment('n.time')}, '0') AS next_time, CASE WHEN n.tag IS NULL THEN '0' ELSE '1' END AS txn_next_day,
        coalesce(CAST(n.n AS VARCHAR), '0') AS next_events,
        coalesce(c_mktsegment, '0') AS class, coalesce(c_name, '0') AS name
    FROM cohort c LEFT JOIN d ON c.tag = d.tag LEFT JOIN n ON c.tag = n.tag LEFT JOIN customer ON c.tag = c_custkey""",
)
def _reached_cohort_first(t):
    return _cohort(t, False)


@query(
    "quality_funnel",
    f"""WITH {b.REGISTRATIONS}
    SELECT 0 AS step_no, 'all' AS step, count(DISTINCT tag) AS keys_left FROM registrations
    UNION ALL SELECT 1, 'has registration', count(DISTINCT tag) FROM registrations WHERE registration IS NOT NULL
    UNION ALL SELECT 2, 'has tag', count(DISTINCT tag) FROM registrations
        WHERE registration IS NOT NULL AND tag IS NOT NULL
    UNION ALL SELECT 3, 'not masked', count(DISTINCT tag) FROM registrations
        WHERE translate(registration, 'X', '') <> ''
    UNION ALL SELECT 4, 'well formed', count(DISTINCT tag) FROM registrations
        WHERE translate(registration, 'X', '') <> '' AND regexp_matches(registration, '{text.REGISTRATION_STRICT}')""",
)
def _funnel(t):
    return quality.quality_funnel(
        b.registrations(t),
        "tag",
        {
            "has registration": F.col("registration").isNotNull(),
            "has tag": F.col("tag").isNotNull(),
            "not masked": unmasked("registration"),
            "well formed": F.col("registration").rlike(text.REGISTRATION_STRICT),
        },
    )


@query(
    "modelled_registrations",
    f"""WITH {b.REGISTRATIONS}, clean AS (
        SELECT tag, registration AS state FROM registrations WHERE translate(registration, 'X', '') <> '')
    SELECT tag, state AS registration, count, total, share,
           regexp_matches(state, '{text.REGISTRATION_STRICT}') AS well_formed
    FROM ({dominant_sql('clean', '> 0.5')})""",
)
def _modelled(t):
    clean = b.registrations(t).where(present("registration") & unmasked("registration"))
    return dominant.dominant_category(clean, "tag", "registration", 0.5, strict=True).withColumn(
        "well_formed", F.col("registration").rlike(text.REGISTRATION_STRICT)
    )


@query(
    "match_master",
    """SELECT CAST(count(*) AS BIGINT) AS rows_out, CAST(count(c_custkey) AS BIGINT) AS rows_matched
    FROM events LEFT JOIN customer ON user_id = c_custkey""",
)
def _match_master(t):
    txn = t.events.select(F.col("user_id").alias("tag"))
    return quality.match_master(txn, t.customer.select(F.col("c_custkey").alias("tag")), "tag")


@query(
    "valid_rows",
    f"""WITH {b.REGISTRATIONS} SELECT tag, registration FROM registrations
    WHERE registration IS NOT NULL AND registration <> ''
      AND regexp_matches(registration, '{text.REGISTRATION_LOOSE}')""",
)
def _valid_rows(t):
    return quality.valid_rows(b.registrations(t), "registration").select("tag", "registration")


@query(
    "valid_by_code",
    f"""WITH {b.REGISTRATIONS}, {b.KNOWN_CODE} SELECT tag, registration, state FROM registrations
    WHERE regexp_matches(registration, '{text.REGISTRATION_ANY}')
      AND substr(registration, 1, 2) IN (SELECT code FROM known_code WHERE code <> 'MA')""",
)
def _valid_by_code(t):
    codes = b.known_code(t).where(F.col("code") != "MA")
    return impute.valid_registrations(b.registrations(t), "registration", codes=codes).select(
        "tag", "registration", "state"
    )


@query(
    "grouped_values_list",
    f"""WITH {b.VISITS}, pairs AS (SELECT DISTINCT tag, plaza FROM visits)
    SELECT * FROM (SELECT tag, plaza, count(*) OVER (PARTITION BY tag) AS n_values FROM pairs) WHERE n_values > 1""",
)
def _grouped_values(t):
    return valued_pairs(b.visits(t), "tag", "plaza").where(F.col("n_values") > 1)


@query(
    "previous_event",
    f"""WITH {b.ORDERED} SELECT tag, time, plaza, entry_lane, exit_lane, prev_plaza, prev_time,
        CAST((epoch_us(time) - epoch_us(prev_time)) // 3600000000 AS BIGINT) AS hours FROM ordered""",
)
def _previous(t):
    linked = ordered.previous_event(
        b.visits(t), "tag", "time", ["plaza", "time"], tie=["plaza", "entry_lane", "exit_lane"]
    )
    return linked.withColumn("hours", hours_between("prev_time", "time"))


@query(
    "next_event",
    f"""WITH {b.ORDERED} SELECT tag, time, plaza, entry_lane, exit_lane, next_plaza, next_time FROM ordered""",
)
def _next(t):
    return ordered.next_event(
        b.visits(t), "tag", "time", ["plaza", "time"], tie=["plaza", "entry_lane", "exit_lane"]
    )


@query(
    "previous_place_with_default",
    f"WITH {b.ORDERED} SELECT tag, time, plaza, coalesce(prev_plaza, 'none') AS prev_plaza FROM ordered",
)
def _previous_default(t):
    linked = ordered.previous_event(
        b.visits(t), "tag", "time", "plaza", tie=["plaza", "entry_lane", "exit_lane"]
    )
    return linked.select("tag", "time", "plaza", F.coalesce("prev_plaza", F.lit("none")).alias("prev_plaza"))


@query(
    "first_event",
    f"""WITH {b.VISITS} SELECT tag, plaza, entry_lane, exit_lane, time FROM (
        SELECT *, row_number() OVER (PARTITION BY tag ORDER BY time, plaza, entry_lane, exit_lane) AS pos
        FROM visits) WHERE pos = 1""",
)
def _first(t):
    return latest.first_event(b.visits(t), "tag", "time", ["plaza", "entry_lane", "exit_lane"])
