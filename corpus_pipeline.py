"""From raw documents to sampled token sequences in five stages.

Each stage takes (spark, docs, sf_dir), works on every row that the stage before kept, and
all but the last return the columns of ``docs``. :func:`run` writes what a stage returns to the shared
folder and reads it for the next, so a lost executor costs one stage's tasks at most.

Every row is judged by its own text: it goes through the classifiers as a whole, and for the benchmark by a hash of its text, so rows with a
null or repeated doc_id are judged like any other, and null texts like empty ones. Among near duplicates the
smallest doc_id stays; rows whose doc_id is null or stands on several rows get a number of their own, behind all others, and of
rows that are equal in doc_id and text one stays. Columns beyond the documents' own are carried along untouched.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagtrail.llm.decontamination import benchmark_matches
from tagtrail.llm.near_duplicates import near_duplicates
from tagtrail.llm.quality import fit_quality, measured, quality
from tagtrail.llm.queries import token_digests
from tagtrail.llm.sampling import remainder
from tagtrail.llm.toxicity import fit_toxicity, toxicity
from tagtrail.session import materialize

TOXIC_FROM = 0.3
GOOD_FROM = 0.7
BATCH_ROWS = 500


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_KEY, _ROW, _TWICE, _ALL = "_text_key", "_row", "_twice", "_all"
#: Numbers of rows without a doc_id of their own begin here.
_BEHIND = 1 << 62


def _in_small_batches(spark: SparkSession) -> None:
    """Long texts go to Python in batches of few rows, so that a worker holds little at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def _by_text(docs: DataFrame) -> DataFrame:
    """``docs`` with a hash of the text, by which rows are judged."""
    return docs.withColumn(_KEY, F.xxhash64(F.coalesce("text", F.lit(""))))


def _whole(docs: DataFrame) -> DataFrame:
    """(_all, text): each row as one value that goes through an operator as its id, so that no verdict is joined back."""
    return docs.select(F.struct(*docs.columns).alias(_ALL), "text")


def _without(docs: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """The rows of ``docs`` whose ``column`` is none of ``ids``."""
    gone = materialize(ids.select(F.col(column).alias("_gone")).distinct(), "rejected")
    return docs.join(gone, docs[column] == gone["_gone"], "left_anti").drop(column)


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a number: the doc_id, or for rows that share it or have none a hash of doc_id and text."""
    twice = docs.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias(_TWICE)).count().where("count > 1").select(_TWICE)
    marked = docs.join(materialize(twice, "repeated"), F.col("doc_id") == F.col(_TWICE), "left")
    own = F.xxhash64("doc_id", "text").bitwiseAND((1 << 61) - 1) + F.lit(_BEHIND)
    odd = F.col("doc_id").isNull() | F.col(_TWICE).isNotNull()
    return marked.withColumn(_ROW, F.when(odd, own).otherwise(F.col("doc_id").cast("long"))).drop(_TWICE)


def _learned_from() -> Column:
    return remainder("doc_id", 4) != 2


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity below 0.3; learned from the labels of three quarters of the ids."""
    _in_small_batches(spark)
    weights = fit_toxicity(docs, _table(spark, sf_dir, "labels"), _learned_from())
    return toxicity(_whole(docs), weights, _ALL).where(F.col("score") < TOXIC_FROM).select(f"{_ALL}.*")


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality of 0.7 or more; learned from the labels of three quarters of the ids."""
    _in_small_batches(spark)
    rows = measured(_whole(docs), _ALL)
    known = rows.select(F.col("id.doc_id").alias("id"), "statistics")
    model = fit_quality(known, _table(spark, sf_dir, "labels"), _learned_from())
    return quality(rows, model, _ALL).where(F.col("score") >= GOOD_FROM).select(f"{_ALL}.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is linked by five-word shingles at 0.8; the smallest doc_id stays."""
    _in_small_batches(spark)
    docs = _numbered(docs)
    kept = docs.join(
        materialize(near_duplicates(docs, _ROW, width=5, percent=80).where("NOT kept").select(F.col(_ROW).alias("_gone")), "copies"),
        F.col(_ROW) == F.col("_gone"), "left_anti",
    )
    own, odd = kept.where(F.col(_ROW) < _BEHIND), kept.where(F.col(_ROW) >= _BEHIND)
    return own.unionByName(odd.dropDuplicates([_ROW])).drop(_ROW)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, up to a tenth of its characters edited."""
    _in_small_batches(spark)
    docs = _by_text(docs)
    return _without(docs, benchmark_matches(docs, _table(spark, sf_dir, "benchmark"), _KEY), _KEY)


def sample_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of each document, with their ids as one hash and a check of the round trip."""
    _in_small_batches(spark)
    return token_digests(docs, run_chars=1 << 17, kept_edges=1 << 20)  # less memory beside the other stages' workers


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("near duplicates", drop_near_duplicates),
    ("benchmark", drop_benchmark),
    ("segmentations", sample_tokens),
]
#: The classifiers and the edit distance cannot be told in SQL; tests/llm/test_pipeline.py compares each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder of tables."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
