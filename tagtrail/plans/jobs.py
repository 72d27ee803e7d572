"""Whole jobs: from delimited text, through a reader, to an operator's result."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tagtrail import schemas
from tagtrail.functions.text import LOOSE_TAG_LENGTH, REGISTRATION_ANY, REGISTRATION_LOOSE, TAG_PREFIX
from tagtrail.operators import impute, latest, quality
from tagtrail.plans import bindings as b
from tagtrail.plans.files import written_lines
from tagtrail.plans.registry import ORACLES, query
from tagtrail.plans.toll import dominant_sql
from tagtrail.session import scratch_path
from tagtrail.sources import sinks, text


@query("last_event_from_text", ORACLES["last_event"])
def _last_event_job(t):
    path = written_lines(t, b.visits(t), "visits", ",")
    visits = text.read_delimited(t.spark, path, schemas.TAG_PLAZA_LANES).withColumn("tag", F.col("tag").cast("bigint"))
    return latest.last_event(visits, "tag", "time", b.DAY, ["plaza", "entry_lane", "exit_lane"])


@query("speed_anomaly_from_text", ORACLES["speed_anomaly"])
def _speed_job(t):
    path = written_lines(
        t, b.trips(t).select("tag", "time", "plaza", "prev_plaza", "prev_time", "distance", "time_diff"), "trips", ","
    )
    trips = text.read_delimited(t.spark, path, schemas.TRAVEL_TIME)
    kept = trips.where(F.col("prev_plaza").isNotNull())
    hours = F.col("time_diff").cast("bigint")
    return quality.speed_anomaly(kept, 150).withColumns({"tag": F.col("tag").cast("bigint"), "time_diff": hours})


def _text_tag(key: str) -> Column:
    """A tag as the text files write it; one in four has a prefix that cleaning rejects."""
    lead = F.when(F.col(key) % 4 == 0, "12").when(F.col(key) % 2 == 0, "91").otherwise("34")
    return F.concat(lead, F.lpad(F.col(key).cast("string"), 18, "0"))


_TEXT_TAG = "CASE WHEN {k} % 4 = 0 THEN '12' WHEN {k} % 2 = 0 THEN '91' ELSE '34' END || lpad(CAST({k} AS VARCHAR), 18, '0')"


@query(
    "impute_registration_from_text",
    f"""WITH {b.REGISTRATIONS}, {b.STATE_CODE},
    txn AS (SELECT {_TEXT_TAG.format(k="tag")} AS tag, registration,
                   CASE WHEN state <> '5-LOW' THEN state END AS state FROM registrations),
    need AS (SELECT DISTINCT {_TEXT_TAG.format(k="c_custkey")} AS tag FROM customer WHERE c_acctbal > 0),
    clean AS (SELECT tag FROM need WHERE regexp_matches(tag, '{TAG_PREFIX}')
              AND length(tag) BETWEEN {LOOSE_TAG_LENGTH[0]} AND {LOOSE_TAG_LENGTH[1]}),
    found AS (SELECT * FROM txn WHERE tag IN (SELECT tag FROM clean)),
    valid AS (SELECT DISTINCT tag, registration FROM found WHERE regexp_matches(registration, '{REGISTRATION_LOOSE}')),
    sized AS (SELECT *, count(*) OVER (PARTITION BY tag) AS n_values FROM valid),
    rest AS (SELECT * FROM found WHERE tag NOT IN (SELECT tag FROM valid)),
    made AS (SELECT best.tag, coalesce(code, 'default') || '00' AS value
             FROM ({dominant_sql('rest', '>= 0.25')}) best LEFT JOIN state_code ON best.state = state_code.state)
    SELECT tag, CASE WHEN n_values = 1 THEN 'unique' ELSE 'multi' END AS method, registration AS value FROM sized
    UNION ALL SELECT tag, 'imputed', value FROM made
    UNION ALL SELECT tag, 'remaining', NULL FROM clean
    WHERE tag NOT IN (SELECT tag FROM valid) AND tag NOT IN (SELECT tag FROM made)""",
)
def _impute_job(t):
    """Lines without the third field are those of one state; cleaning drops tags with a foreign prefix."""
    seen = b.registrations(t).select(_text_tag("tag").alias("tag"), "registration", "state")
    line = F.concat_ws(",", "tag", "registration", F.when(F.col("state") != "5-LOW", F.col("state")))
    path = scratch_path(t.spark, "tag-vehicle")
    sinks.write_text(seen.select(line.alias("line")), path, "line")
    txn = text.read_ragged(t.spark, path, schemas.TAG_VEHICLE, 2).withColumnRenamed("vehicle_number", "registration")
    need = t.customer.where(F.col("c_acctbal") > 0).select(_text_tag("c_custkey").alias("tag"))
    return impute.impute_registration(need, txn, b.state_code(t))


@query(
    "residue_with_codes",
    f"""WITH {b.REGISTRATIONS}, {b.KNOWN_CODE}
    SELECT c_custkey AS tag, c_name AS name FROM customer
    WHERE c_custkey NOT IN (SELECT tag FROM registrations WHERE regexp_matches(registration, '{REGISTRATION_ANY}')
                            AND substr(registration, 1, 2) IN (SELECT code FROM known_code))
      AND c_custkey NOT IN (SELECT tag FROM registrations WHERE state IN ('1-URGENT', '2-HIGH'))""",
)
def _residue_job(t):
    need = t.customer.select(F.col("c_custkey").alias("tag"), F.col("c_name").alias("name"))
    seen = b.registrations(t)
    valid = impute.valid_registrations(seen, "registration", codes=b.known_code(t))
    return impute.unmatched(need, valid, seen.where(F.col("state").isin("1-URGENT", "2-HIGH")))
