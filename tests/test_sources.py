from __future__ import annotations

import os
import subprocess
import sys

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tagtrail import schemas
from tagtrail.operators.layout import hash_partition, partition_sizes, reused, single_partition
from tagtrail.session import materialize, scratch_path
from tagtrail.sources import sinks, text


@pytest.fixture
def file(tmp_path):
    def write(content: bytes | str, name="in.txt"):
        path = tmp_path / name
        path.write_bytes(content if isinstance(content, bytes) else content.encode())
        return str(path)

    return write


def test_comma_rows_are_typed(spark, file):
    df = text.read_delimited(spark, file("t1,p1,e,x,2017-06-16 05:35:22\n"), schemas.TAG_PLAZA_LANES)
    row = df.first()
    assert (row.tag, row.exit_lane, str(row.time)) == ("t1", "x", "2017-06-16 05:35:22")


@pytest.mark.parametrize("sep", ["\t", "::"])
def test_rating_delimiters(spark, rows, file, sep):
    df = text.read_delimited(spark, file(sep.join(["1", "2", "3.5", "881"]) + "\n"), schemas.RATINGS, sep)
    assert rows(df) == [(1, 2, 3.5, 881)]


def test_malformed_bytes_are_replaced(spark, file):
    path = file(b"1|Caf\xe9 Paris|x\n2|Plain|x\n")
    df = text.read_delimited(spark, path, schemas.ITEMS + ", rest string", "|")
    assert {r.item: r.title for r in df.collect()} == {1: "Caf� Paris", 2: "Plain"}


def test_header_keeps_strings(spark, file):
    df = text.read_headered_strings(spark, file("tagid,count\nA,007\n"))
    assert df.dtypes == [("tagid", "string"), ("count", "string")] and df.first()["count"] == "007"


def test_ragged_lines(spark, rows, file):
    df = text.read_ragged(spark, file("a,1,KA\nb,2\nc\n\nd,4,KL,more\n"), schemas.TAG_VEHICLE, 2)
    assert rows(df) == [("a", "1", "KA"), ("b", "2", None), ("d", "4", "KL")]


def test_quoted_names(spark, rows, file):
    path = file('1 "24-HOUR MAN"\n2 no quotes\n6487 "NOT REAL"\nx "BAD ID"\n')
    assert rows(text.read_quoted_names(spark, path)) == [(1, "24-HOUR MAN"), (6487, "NOT REAL")]
    assert rows(text.read_quoted_names(spark, path, below=6487)) == [(1, "24-HOUR MAN")]


def test_adjacency_lines(spark, rows, file):
    assert rows(text.read_adjacency(spark, file("1 2 3\n4\n5  6 \n"))) == [(1, 2), (1, 3), (5, 6)]


def test_labelled_points(spark, rows, file):
    df = text.read_labelled_points(spark, file("-1.5,2.0 3.0\n(0.5,[1.0,4.0])\n"))
    assert {r.label: r.features for r in df.collect()} == {-1.5: [2.0, 3.0], 0.5: [1.0, 4.0]}


def test_in_memory_relation_has_a_known_size(spark, rows):
    df = text.in_memory(spark, [("FRIDAY", 0.2), ("SATURDAY", 0.5)], "day string, chance double")
    assert rows(df) == [("FRIDAY", 0.2), ("SATURDAY", 0.5)]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "LocalTableScan" in plan


def test_csv_sink_modes(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.range(20).repartition(4)
    sinks.write_csv(df, path, overwrite=False)
    with pytest.raises(AnalysisException):
        sinks.write_csv(df, path, overwrite=False)
    sinks.write_csv(df, path, single_file=True)
    files = [p for p in (tmp_path / "out").iterdir() if p.suffix == ".csv"]
    assert len(files) == 1 and files[0].read_text().startswith("id\n")
    assert text.read_headered_strings(spark, path).count() == 20


def test_text_sink_preview_and_pandas(spark, tmp_path, capsys):
    path = str(tmp_path / "lines")
    sinks.write_text(spark.createDataFrame([("x y",)], "line string"), path, "line")
    assert text.read_lines(spark, path).first().line == "x y"
    sinks.preview(spark.range(3), 2)
    shown = capsys.readouterr().out
    assert "id: long" in shown and "only showing top 2 rows" in shown
    assert len(sinks.to_pandas(spark.range(9), 4)) == 4


def test_layout(spark):
    df = spark.range(100).withColumn("k", F.col("id") % 10)
    assert hash_partition(df, "k", 5).rdd.getNumPartitions() == 5
    assert single_partition(df).rdd.getNumPartitions() == 1
    assert partition_sizes(df.repartition(4)).agg(F.sum("n_rows")).first()[0] == 100
    with reused(df) as kept:
        assert kept.is_cached and kept.count() == 100
    assert not kept.is_cached


def test_hash_partition_serves_the_grouping(spark):
    df = spark.range(100).withColumn("k", F.col("id") % 10)
    plan = hash_partition(df, "k", 5).groupBy("k").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_materialized_tables_are_files(spark):
    out = materialize(spark.range(5), "check")
    assert out.count() == 5 and "FileScan parquet" in out._jdf.queryExecution().executedPlan().toString()
    assert scratch_path(spark, "a") != scratch_path(spark, "a")


def test_scratch_tables_go_to_the_checkpoint_folder(tmp_path):
    """In its own process, since the setting belongs to the session's start."""
    code = (
        "from tagtrail.session import build_session, materialize\n"
        f"spark = build_session('local[1]', 1, **{{'spark.checkpoint.dir': '{tmp_path}/shared'}})\n"
        "print(materialize(spark.range(5), 'kept').count())\n"
    )
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run(
        [sys.executable, "-c", code], capture_output=True, text=True, cwd=root, timeout=120, check=True
    )
    assert done.stdout.strip().endswith("5")
    assert any(p.name.startswith("kept-") for p in (tmp_path / "shared").iterdir())
