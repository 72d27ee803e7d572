from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tagtrail.functions import collections as arrays, dates, numeric, text


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()[0]


def at(stamp):
    return dates.moment(stamp)


@pytest.mark.parametrize(
    "start, end, hours",
    [
        ("2017-06-16 05:35:22", "2017-06-17 07:58:43", 26),
        ("2017-06-17 07:58:43", "2017-06-16 05:35:22", -26),
        ("2024-01-01 00:59:00", "2024-01-01 01:01:00", 0),
        ("2024-01-01 10:00:00", "2024-01-01 13:30:00", 3),
        ("2024-01-01 00:00:00", "2024-03-01 00:00:00", 1440),
    ],
)
def test_hours_are_truncated(spark, start, end, hours):
    assert value(spark, dates.hours_between(at(start), at(end))) == hours


def test_hours_ignore_the_session_time_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        assert value(spark, dates.hours_between(at("2024-03-31 01:30:00"), at("2024-03-31 03:30:00"))) == 2
        minutes = [
            value(spark, dates.minute_index(at(s)))
            for s in ("2024-03-31 01:59:00", "2024-03-31 02:30:00", "2024-03-31 03:00:00")
        ]
        assert minutes == sorted(minutes) and len(set(minutes)) == 3
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_days_count_across_months(spark):
    assert value(spark, dates.days_before("2017-06-20", at("2017-04-01 23:59:59"))) == 80


def test_compact_date_uses_the_calendar_year(spark):
    assert value(spark, dates.compact_date(dates.day("2024-12-30"))) == "20241230"


def test_tag_prefix_is_a_prefix_not_a_character_class(spark):
    tags = spark.createDataFrame([("4x",), ("99",), ("34a",), ("91b",), ("|",)], "tag string")
    kept = [r.tag for r in tags.where(F.col("tag").rlike(text.TAG_PREFIX)).orderBy("tag").collect()]
    assert kept == ["34a", "91b"]


def test_registration_patterns(spark):
    seen = spark.createDataFrame([("AB12CD34",), ("ab1C2",), ("A1",), ("XX99",)], "r string")
    flags = {
        r[0]: tuple(r[1:])
        for r in seen.select(
            "r",
            F.col("r").rlike(text.REGISTRATION_LOOSE),
            F.col("r").rlike(text.REGISTRATION_ANY),
            F.col("r").rlike(text.REGISTRATION_STRICT),
        ).collect()
    }
    assert flags["AB12CD34"] == (True, True, True)
    assert flags["ab1C2"] == (True, True, False)
    assert flags["A1"] == (False, False, False)
    assert flags["XX99"] == (False, True, False)


def test_mask_detection(spark):
    seen = spark.createDataFrame([("XXXX",), ("XA1",), (None,)], "r string")
    assert [r.r for r in seen.where(text.unmasked("r")).collect()] == ["XA1"]


def test_regex_capture(spark):
    line = F.lit("To life, the universe, and everything is 42.")
    assert value(spark, text.captured_int(line, r".* ([\d]+).*")) == 42
    assert value(spark, text.captured_int(F.lit("none"), r".* ([\d]+).*")) is None


def test_array_operations(spark):
    numbers = F.array(*[F.lit(i) for i in (1, 2, 3, 4, 5)])
    assert value(spark, arrays.total(numbers)) == 15
    assert value(spark, F.array_max(numbers)) == 5
    assert value(spark, arrays.without(numbers, 3)) == [1, 2, 4, 5]
    assert value(spark, arrays.head(numbers)) == 1
    assert value(spark, arrays.tail(numbers)) == [2, 3, 4, 5]
    assert value(spark, arrays.tail(F.array().cast("array<int>"))) == []
    assert value(spark, arrays.appended(numbers, F.lit(6))) == [1, 2, 3, 4, 5, 6]


def test_array_is_cut_into_groups(spark):
    letters = F.split(F.lit("a,b,c,d,e,f,g,h"), ",")
    assert value(spark, arrays.in_groups(letters, 3)) == ["a,b,c", "d,e,f", "g,h"]
    assert value(spark, arrays.in_groups(F.array().cast("array<string>"), 3)) == []


def test_map_lookup_default(spark):
    ranks = F.create_map(F.lit("a"), F.lit(1))
    assert value(spark, arrays.looked_up(ranks, F.lit("a"), 0)) == 1
    assert value(spark, arrays.looked_up(ranks, F.lit("b"), 0)) == 0


def test_guarded_numbers(spark):
    assert value(spark, numeric.ratio(F.lit(1.0), F.lit(0.0))) is None
    assert value(spark, numeric.speed(F.lit(100.0), F.lit(0))) == 200.0
    assert value(spark, numeric.speed(F.lit(100.0), F.lit(4))) == 25.0
    assert value(spark, numeric.cosine(F.lit(0.0), F.lit(0.0), F.lit(4.0))) == 0.0
    assert value(spark, numeric.half_even(F.lit(0.12345))) == 0.1234
    assert value(spark, text.fahrenheit_text(numeric.fahrenheit(F.lit(-148.0)))) == "5.36 F"


def test_words_are_upper_cased(spark):
    assert value(spark, text.words(F.lit("  Two words, two. "))) == ["", "TWO", "WORDS", "TWO", ""]
