"""The registered queries of this subpackage, each an operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagtrail.llm.archives import pages_through_archives
from tagtrail.llm.decontamination import benchmark_matches
from tagtrail.llm.hard_negatives import hard_negatives
from tagtrail.llm.language import fit_language, predict_language
from tagtrail.llm.main_text import main_text
from tagtrail.llm.neighbours import nearest_neighbours
from tagtrail.llm.near_duplicates import near_duplicates
from tagtrail.llm.periodic_runs import periodic_runs, strongest
from tagtrail.llm.quality import fit_quality, measured, quality
from tagtrail.llm.quality_rules import fit_rules, quality_rules
from tagtrail.llm.sampling import remainder
from tagtrail.llm.segmentation import load_vocabulary, segmentations
from tagtrail.llm.toxicity import fit_toxicity, toxicity
from tagtrail.llm.url_filters import judge_urls, split_url

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def near_duplicate_sql(source: str, width: int, percent: int) -> str:
    """Common table expressions up to ``near``: doc_id, n_shingles, component_id over all links of ``source``."""
    return rf"""
    cut AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+'), []) AS ws FROM {source}),
    sets AS (
      SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {width} THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - {width - 2}), lambda i: array_to_string(ws[i:i + {width - 1}], ' ')) END) AS items
      FROM cut),
    sized AS (SELECT doc_id, len(items) AS n FROM sets),
    flat AS (SELECT doc_id, unnest(items) AS item FROM sets),
    common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM flat a JOIN flat b ON a.item = b.item AND a.doc_id < b.doc_id
      GROUP BY 1, 2),
    links AS (SELECT a, b FROM common JOIN sized x ON x.doc_id = a JOIN sized y ON y.doc_id = b
      WHERE 100 * c >= {percent} * (x.n + y.n - c)),
    ends AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reach AS (SELECT a AS doc_id, b AS other FROM ends UNION SELECT r.doc_id, e.b FROM reach r JOIN ends e ON e.a = r.other),
    near AS (SELECT s.doc_id, s.n AS n_shingles, least(s.doc_id, coalesce(m.low, s.doc_id)) AS component_id
      FROM sized s LEFT JOIN (SELECT doc_id, min(other) AS low FROM reach GROUP BY 1) m ON m.doc_id = s.doc_id)"""


@_query(
    "op6_near_duplicates",
    f"WITH RECURSIVE {near_duplicate_sql('documents', 4, 80)} "
    "SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM near",
)
def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), width=4, percent=80)


@_query("op1_benchmark_matches")
def op1_benchmark_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and item it holds; documents without a match have no row."""
    return benchmark_matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def _held_out(divisor: int, rest: int) -> Column:
    return F.coalesce(remainder("doc_id", divisor) == rest, F.lit(False)).alias("held_out")


@_query("op4_language")
def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = fit_language(docs, remainder("doc_id", 3) != 1)
    return predict_language(docs, model).select("doc_id", _held_out(3, 1), "lang_pred", "score", "rejected")


@_query("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    weights = fit_toxicity(docs, _table(spark, sf_dir, "labels"), remainder("doc_id", 4) != 2)
    predicted = (F.col("score") >= 0.3).cast("int").alias("predicted")
    return toxicity(docs, weights).select("doc_id", _held_out(4, 2), "score", predicted)


@_query("op10_quality")
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = measured(_table(spark, sf_dir, "documents"))
    model = fit_quality(rows, _table(spark, sf_dir, "labels"), remainder("doc_id", 4) != 2)
    predicted = (F.col("score") >= 0.7).cast("int").alias("predicted")
    return quality(rows, model).select("doc_id", _held_out(4, 2), "score", predicted)


@_query("op2_main_text")
def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(_table(spark, sf_dir, "pages"))


@_query(
    "op7_archives",
    """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
    d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
    f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY 1)
    SELECT page_id, payload_bytes, d.payload_digest, CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN page_id <> first THEN first END AS refers_to
    FROM d LEFT JOIN f ON f.payload_digest = d.payload_digest""",
)
def op7_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages_through_archives(_table(spark, sf_dir, "pages"), "page_id", "url", "html")
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: The rules of the query and the labels whose hosts are listed.
URL_RULES = (
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
LISTED_LABELS = ("casino-win", "free-bets", "cheap-pills", "ads-track")
_FITS = "(u.host = '{h}' OR ends_with(u.host, '.{h}')) AND starts_with(u.path, '{p}')"
_BY_LENGTH = sorted(URL_RULES, key=lambda r: (-len(r[1] + r[2]), -len(r[1])))


@_query(
    "op8_url_filter",
    f"""
    WITH r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    u AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1) AS path FROM r),
    m AS (SELECT *, CASE {" ".join(f"WHEN {_FITS.format(h=h, p=p)} THEN '{a} {h}{p}'" for a, h, p in _BY_LENGTH)} END AS hit FROM u)
    SELECT page_id, host, path, split_part(hit, ' ', 2) AS rule,
      coalesce(split_part(hit, ' ', 1), CASE WHEN list_has_any(string_split(host, '.'),
        [{", ".join(f"'{x}'" for x in LISTED_LABELS)}]) THEN 'block' ELSE 'allow' END) AS verdict
    FROM m""",
)
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(str(r) for r in URL_RULES) + " AS r(action, host, path)")
    labels = F.array(*[F.lit(x) for x in LISTED_LABELS])
    hosts = split_url(pages.select("url"), "url").where(F.arrays_overlap(F.split("host", r"\."), labels))
    return judge_urls(pages, rules, hosts.select(F.col("host").alias("key")))


_USABLE = "embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL"


@_query(
    "op3_neighbours",
    f"""
    WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE {_USABLE}),
    u AS (SELECT vec_id, e, sqrt(list_reduce(list_transform(e, lambda x: x * x), lambda s, x: s + x)) AS n FROM v
      WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
    s AS (SELECT q.vec_id AS query_id, r.vec_id,
        list_reduce(list_transform(list_zip(q.e, r.e), lambda z: z[1] * z[2]), lambda s, x: s + x) / (q.n * r.n) AS score
      FROM u q JOIN u r ON q.vec_id <> r.vec_id WHERE q.vec_id % 50 = 0),
    k AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
      FROM s)
    SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 5""",
)
def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return nearest_neighbours(vectors, F.col("vec_id") % 50 == 0)


def token_digests(docs: DataFrame, **bounds: int) -> DataFrame:
    """A row per document and sampled segmentation: how long, how likely, its ids as one hash, and whether it spells the text."""
    ways = segmentations(docs, load_vocabulary(docs.sparkSession), spell=True, **bounds)
    return ways.select(
        "doc_id", "rank", F.size("ids").cast("long").alias("n_tokens"), F.xxhash64("ids").alias("ids_hash"), "log_prob", "perturbed",
        "inclusion", (F.xxhash64("decoded") == F.col("text_key")).alias("exact"),
    )


@_query("op9_segmentations")
def op9_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(_table(spark, sf_dir, "documents"))


@_query("op11_quality_rules")
def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = fit_rules(docs, _table(spark, sf_dir, "labels"), remainder("doc_id", 4) != 2)
    return quality_rules(docs, model)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): the words of a tenth of the documents go on in a period from some word, as the contract says."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.col("words")
    n = F.size(words)
    a = (g % F.greatest(n, F.lit(1))).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    tail = F.transform(F.sequence(a, n - 1), lambda i: F.get(words, a + (i - a) % p))
    planted = F.array_join(F.concat(F.slice(words, 1, a), tail), " ")
    cut = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("words")
    return docs.select("doc_id", "text", cut).select("doc_id", F.when(n > 0, planted).otherwise(F.col("text")).alias("text"))


@_query("op12_periodic_runs")
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_planted_runs(_table(spark, sf_dir, "documents")))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    best = found.withColumn("best", strongest(F.col("runs")))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@_query(
    "op13_hard_negatives",
    """
    WITH v AS (SELECT row_number() OVER () AS k, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
      FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.k, a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, CAST(coalesce(list_sum(
        list_transform(list_zip(a.e, b.e), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0))), 0) AS BIGINT) AS score
      FROM v a JOIN v b ON a.k <> b.k WHERE a.vec_id % 100 = 0),
    p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, vec_id) AS slot FROM s WHERE same) WHERE slot <= 5),
    n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
        CAST(row_number() OVER (PARTITION BY p.k, p.slot ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
      FROM p JOIN s ON s.k = p.k AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
    SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5""",
)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)
