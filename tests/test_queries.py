"""Every registered query against its oracle SQL, and properties of results on the shared tables."""

from __future__ import annotations

import os
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

from conftest import SMALL

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as contract  # noqa: E402
from check import TABLES, compare  # noqa: E402
from tagtrail.operators import dominant, keyed  # noqa: E402
from tagtrail.plans import bindings as b, catalog  # noqa: E402
from tagtrail.sources.tables import Tables  # noqa: E402


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def test_every_query_has_an_oracle():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)
    assert set(catalog.QUERIES) <= set(contract.queries()) and set(catalog.ORACLES) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_its_oracle(spark, oracle, name):
    verdict = compare(spark, SMALL, name, oracle)
    assert verdict.startswith("ok") and "TYPES" not in verdict, verdict


def test_entry_has_rows(spark):
    out = contract.entry(spark)
    assert out.count() > 0 and out.columns[0] == "tag"


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(spark, SMALL)


def test_shares_add_up(tables):
    shares = keyed.share_of_total(keyed.count_by(b.moves(tables), ["to_plaza", "from_plaza"]), "to_plaza")
    for r in shares.groupBy("to_plaza").agg(F.sum("percent").alias("p")).collect():
        assert r.p == pytest.approx(100.0)


def test_flags_are_binary(spark):
    out = contract.entry(spark)
    flags = [c for c in out.columns if c not in ("tag", "days_ratio")]
    for r in out.collect():
        assert all(r[c] in (0, 1) for c in flags) and 0 <= r.days_ratio <= 1


def test_imputed_and_remaining_make_up_the_need(spark, tables):
    need = b.unpriced(b.priced_lines(tables)).count()
    priced = contract.queries()["impute_modal_amount"](spark, SMALL)
    remaining = contract.queries()["impute_modal_remaining"](spark, SMALL).count()
    assert priced.count() == need
    assert priced.where(F.col("amount").isNotNull()).count() + remaining == need


@pytest.mark.parametrize("shape", [1, 5])
def test_dominance_does_not_depend_on_partitioning(tables, rows, shape):
    plain = dominant.dominant_category(b.tag_states(tables), "tag", "state")
    moved = dominant.dominant_category(b.tag_states(tables).repartition(shape), "tag", "state")
    assert rows(plain) == rows(moved)
