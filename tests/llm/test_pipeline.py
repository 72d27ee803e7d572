"""Each stage of the pipeline against a plain version, on rows with all that tables may hold; and the gate for queries without SQL."""

from __future__ import annotations

import os
import random
import re
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline as pipeline
from conftest import SMALL

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(contract.__file__)), "tools"))

from check import TABLES, compare  # noqa: E402
from tagtrail.llm import queries
from tagtrail.llm.decontamination import normal
from tagtrail.llm.quality import fit_quality, measured, text_statistics
from tagtrail.llm.toxicity import bucketed, fit_toxicity

#: The test that compares each query without SQL with a plain version, here or in the other modules of this folder.
BRUTE_FORCE = {
    "op1_benchmark_matches": "test_benchmark_matches_equal_brute_force",
    "op2_main_text": "test_main_text_equals_a_plain_parser",
    "op4_language": "test_language_descends_like_a_plain_loop",
    "op5_toxicity": "test_follow_the_leader_equals_a_plain_loop",
    "op9_segmentations": "test_segmentations_follow_the_distribution_of_all_ways",
    "op10_quality": "test_quality_solves_the_plain_ridge",
    "op11_quality_rules": "test_counts_equal_brute_force",
    "op12_periodic_runs": "test_query_of_runs_equals_brute_force",
    "pipeline": "test_whole_pipeline_equals_its_stages",
}


def test_each_query_has_sql_or_a_plain_version():
    own = set(queries.QUERIES) | {"pipeline"}
    assert own <= set(contract.queries())
    assert set(BRUTE_FORCE) == own - set(contract.oracle_sql())
    code = "".join(p.read_text() for p in Path(__file__).parent.glob("test_*.py"))
    assert all(f"def {name}(" in code for name in BRUTE_FORCE.values())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    verdict = compare(spark, SMALL, name, con)
    assert verdict.startswith("ok") and "TYPES" not in verdict, verdict


@pytest.fixture(scope="module")
def docs(spark):
    """Real documents, with null ids, repeats, near copies, odd texts and a column that clashes with names inside."""
    rng = random.Random(3)
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    words = [f"w{rng.randrange(5000)}" for _ in range(300)]
    near = [*words]
    near[150] = "other"
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").head().text
    more = [
        (None, " ".join(words)), (5001, " ".join(near)), (5000, " ".join(words)), (None, "only " + " ".join(reversed(words))),
        (5002, None), (5003, ""), (None, None), (None, None), (5004, " ".join(words[:200])), (5004, " ".join(words[:200])),
        (5004, " ".join(words[100:])), (5005, "x" * 300_000), (None, f"so: {item} ."), (5006, f"{' '.join(words[50:90])} {item}"),
    ]
    rows += [(i, t, "en", "s", 0) for i, t in more]
    rows = [(*r, k % 7) for k, r in enumerate(rows)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id int")
    return table.repartition(5)


def seen(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.text or "", r.id) for r in df.collect())


def plain(rows, keep):
    return sorted((r.doc_id is None, r.doc_id or 0, r.text or "", r.id) for r in rows if keep(r))


def test_toxic_rows_go_whatever_their_id(spark, docs):
    weights = fit_toxicity(docs, spark.read.parquet(f"{SMALL}/labels.parquet"), pipeline.remainder("doc_id", 4) != 2)
    value = dict(zip(weights.buckets.tolist(), weights.values.tolist(), strict=True))

    def keep(r):
        found = {b for _, part in bucketed([r.text], weights.bits) for b in part.tolist()}
        total = weights.bias + sum(value.get(b, 0.0) for b in found)
        return total < -0.8472978603872037  # log(0.3 / 0.7)

    got = pipeline.drop_toxic(spark, docs, SMALL)
    assert got.columns == docs.columns
    assert seen(got) == plain(docs.collect(), keep) and got.count() < docs.count()


def test_poor_rows_go_whatever_their_id(spark, docs):
    got = pipeline.drop_poor(spark, docs, SMALL)
    assert got.columns == docs.columns
    rows = docs.collect()
    kept = {r.text or "" for r in got.collect()}
    assert seen(got) == plain(rows, lambda r: (r.text or "") in kept)  # one verdict a text, and every row with it
    model = fit_quality(measured(docs), spark.read.parquet(f"{SMALL}/labels.parquet"), pipeline.remainder("doc_id", 4) != 2)
    score = model.score(text_statistics([r.text for r in rows]))
    sure = [(r.text or "", s) for r, s in zip(rows, score, strict=True) if abs(s - 0.7) > 0.1]
    assert sum((t in kept) == (s >= 0.7) for t, s in sure) >= 0.98 * len(sure) and got.count() < docs.count()


def shingles(text, width=5):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def test_one_row_of_each_group_of_copies_stays(spark, docs):
    got = pipeline.drop_near_duplicates(spark, docs, SMALL)
    assert got.columns == docs.columns
    rows = docs.collect()
    single = {}
    for r in rows:  # equal rows count once
        single.setdefault((r.doc_id, r.text), r)
    sets = {key: shingles(key[1]) for key in single}
    group = {key: key for key in sets}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    keys = [k for k in sets if sets[k]]
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if both and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                group[root(a)] = root(b)
    groups: dict = {}
    for key in sets:
        groups.setdefault(root(key), []).append(key)
    kept = {(r.doc_id, r.text) for r in got.collect()}
    ids = [k[0] for k in sets]
    for members in groups.values():
        stays = [k for k in members if k in kept]
        assert len(stays) == 1
        own = [k[0] for k in members if k[0] is not None and ids.count(k[0]) == 1]
        assert not own or stays[0][0] == min(own)
    assert got.count() == len(groups)


def test_rows_with_a_benchmark_item_go(spark, docs):
    got = pipeline.drop_benchmark(spark, docs, SMALL)
    assert got.columns == docs.columns
    items = [normal(r.text)[0] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    whole = {r.text: any(i in normal(r.text)[0] for i in items) for r in docs.collect() if r.text and len(r.text) < 100_000}
    kept = {r.text for r in got.collect()}
    assert all(t not in kept for t, has in whole.items() if has) and sum(whole.values()) >= 2
    gone = [t for t in whole if t not in kept]
    assert len(gone) <= sum(whole.values()) + 5  # a few with edits
    assert {r.text for r in docs.collect() if not r.text} <= kept


def test_stages_of_an_empty_table(spark, docs):
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), SMALL).collect() == []


def test_whole_pipeline_equals_its_stages(spark):
    rows = {}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, stage in pipeline.STAGES:
        docs = pipeline.materialize(stage(spark, docs, SMALL), "stage")
        rows[name] = docs.count()
    got = pipeline.run(spark, SMALL)
    key = lambda df: sorted(map(tuple, df.select("doc_id", "rank", "n_tokens", "ids_hash", "exact").collect()))
    assert key(got) == key(docs) and got.where("NOT exact").count() == 0
    assert rows["toxicity"] > rows["quality"] > rows["near duplicates"] >= rows["benchmark"] > 0
    assert rows["segmentations"] >= rows["benchmark"]
    assert got.where(F.col("doc_id").isNull()).count() == 0
