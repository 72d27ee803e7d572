"""Near-duplicate classes by fast similarity sketches, banding and exact verification.

Every document has the set of its distinct word shingles. The sketch has
``bands * rows`` bins. Round after round each shingle is thrown into one bin
with a value that grows with the round, and a bin keeps its smallest value; after
as many rounds as bins, one more round per bin throws every shingle into that
bin, so every bin of a set that is not empty fills. Two sets agree in a bin with
a chance equal to their Jaccard similarity, and the share of agreeing bins keeps
close to it. Rows of bins make bands; documents that share a band are candidates.

With 5 rows and 32 bands a pair at similarity 0.8 shares no band with a chance of
(1 - 0.8**5)**32 < 4e-6. Candidates are confirmed on the full sets, so no
false link is kept. No list of pairs of a group is made:

1. Equal sets are one node, with a number of its own; the text of its smallest id stands for it.
2. Each node is checked against one leader of its bands, the one it shares most
   with; the links give components. In two more rounds it is checked against a random
   leader of each band that still holds several components.
3. Only nodes that share a band and are still in different components are
   compared with each other.

Before full sets are read, a bitmap of each set bounds the intersection of a pair
from above, so pairs that agree in one passage only are never built.

Defined cases: a null or empty text, or one without words, has an empty set and
is linked with nothing. Rows with a null id keep their row, with a null
component. Rows that repeat an id are each judged by their
own text: its links only, and kept if their id is the smallest of its component. Other columns are not read, so their
names cannot clash. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagtrail.llm.batches import giving_back, grams, mixed, slices, space_words, spans
from tagtrail.llm.components import connected
from tagtrail.session import materialize

BANDS = 32
ROWS = 5
#: Rounds in which each node is compared with one leader of each of its bands.
TURNS = 2
#: Rows of one to three numbers sent to every task at most; the memory they take there is not measured.
SENT_IDS = 1_000_000
#: 64-bit words of the bitmap of a set.
WORDS = 16
_VALUE = np.uint64(0xFFFFFFFF)
_SALT = 7


def shingle_sets(texts: list[str | None], width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(text number, sorted distinct shingle hashes) of every text."""
    for lo, hi in slices(texts):
        docs, hashes = space_words(texts[lo:hi])
        n = hi - lo
        word_at = spans(docs, n)
        joint, owner = grams(hashes, docs, tuple(range(width)), _SALT)
        at = spans(owner, n)
        for i in range(n):
            words = int(word_at[i + 1] - word_at[i])
            if words >= width:
                yield lo + i, np.unique(joint[at[i] : at[i + 1]])
            elif words:
                short, _ = grams(hashes[word_at[i] : word_at[i + 1]], np.zeros(words, np.int64), tuple(range(words)), _SALT)
                yield lo + i, mixed(short, words)
            else:
                yield lo + i, np.zeros(0, np.uint64)


def sketches(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """A row of ``bins`` values per set; rows of empty sets stay at the largest value."""
    empty = np.iinfo(np.uint64).max
    out = np.full(len(sets) * bins, empty, np.uint64)
    sizes = np.array([len(s) for s in sets], np.int64)
    owner, items = np.repeat(np.arange(len(sets)), sizes), np.concatenate([*sets, np.zeros(0, np.uint64)])
    for turn in range(2 * bins):
        if not len(items):
            break
        thrown = mixed(items, turn + 1)
        if turn < bins:
            place = ((thrown >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
        else:
            place = np.full(len(items), turn - bins, np.uint64)
        value = (np.uint64(turn) << np.uint64(32)) | (thrown & _VALUE)
        np.minimum.at(out, owner * bins + place.astype(np.int64), value)
        short = (out.reshape(-1, bins) == empty).any(axis=1)
        stay = short[owner]
        owner, items = owner[stay], items[stay]
    return out.reshape(-1, bins)


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """A row of WORDS 64-bit words per set: the bit of every shingle hash."""
    place = np.concatenate([*sets, np.zeros(0, np.uint64)]) % np.uint64(64 * WORDS)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    bits = np.zeros((len(sets), 64 * WORDS), np.uint8)
    bits[owner, place.astype(np.int64)] = 1
    return np.packbits(bits, axis=1).view(np.int64)


def band_keys(rows: np.ndarray, bands: int) -> np.ndarray:
    """A signed 64-bit key per set and band."""
    per = rows.shape[1] // bands
    keys = np.zeros((len(rows), bands), np.uint64)
    for r in range(per):
        keys = mixed(keys ^ rows.reshape(len(rows), bands, per)[:, :, r], r + 1)
    for b in range(bands):
        keys[:, b] = mixed(keys[:, b], 1000 + b)
    return keys.view(np.int64)


def _sketched(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, marks = batch.column(0), batch.column(1).to_pylist(), batch.column(2)
            for lo, hi in slices(texts):
                sets = [s for _, s in shingle_sets(texts[lo:hi], width)]
                keys = band_keys(sketches(sets, bands * rows), bands)
                full = np.array([len(s) > 0 for s in sets], bool)
                offsets = np.zeros(len(sets) + 1, np.int32)
                np.cumsum(full * bands, out=offsets[1:])
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(lo, hi - lo),
                        marks.slice(lo, hi - lo),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                        pa.ListArray.from_arrays(offsets, pa.array(keys[full].ravel(), pa.int64())),
                        pa.ListArray.from_arrays(
                            np.arange(len(sets) + 1, dtype=np.int32) * WORDS, pa.array(bitmaps(sets).ravel(), pa.int64())
                        ),
                    ],
                    ["id", "mark", "n", "digest", "bands", "bits"],
                )

    return run


def _full_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for lo, hi in slices(texts):
                sets = [s for _, s in shingle_sets(texts[lo:hi], width)]
                offsets = np.zeros(len(sets) + 1, np.int32)
                np.cumsum([len(s) for s in sets], out=offsets[1:])
                flat = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int64()))], ["id", "items"]
                )

    return run


def _possible(percent: int) -> Column:
    """Whether the bitmaps of a and b allow the similarity.

    Each bit of a that b lacks stands for a shingle of a that b lacks, so the
    intersection is at most the size less the number of such bits (``set`` less those in both). No pair that has
    the similarity fails this test.
    """
    both = sum(F.bit_count(F.col(f"bits{k}_a").bitwiseAND(F.col(f"bits{k}_b"))) for k in range(WORDS))
    most = F.least(F.col("n_a") - F.col("set_a"), F.col("n_b") - F.col("set_b")) + both
    return 100 * most >= percent * (F.col("n_a") + F.col("n_b") - most)


def _sided(rows: DataFrame, side: str) -> DataFrame:
    return rows.select([F.col(c).alias(c if c == "band" else side if c == "node" else f"{c}_{side}") for c in rows.columns])


def _sent(rows: DataFrame, others: DataFrame, on: str | list[str], how: str) -> DataFrame:
    """A join. Up to SENT_IDS of ``others`` go to the tasks, so that ``rows`` stay where they are; more are joined."""
    others = materialize(others, "others")
    return rows.join(F.broadcast(others) if others.count() <= SENT_IDS else others, on, how)


def _confirmed(pairs: DataFrame, outlines: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Those (a, b) whose full sets have ``percent`` of their union in common."""
    able = pairs.join(_sided(outlines, "a"), "a").join(_sided(outlines, "b"), "b").where(_possible(percent))
    able = materialize(able.select("a", "b"), "able")
    named = able.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = _sent(texts, named, "id", "left_semi").mapInArrow(giving_back(_full_sets(width)), "id long, items array<long>")
    sets = materialize(sets, "full-sets")
    left = sets.select(F.col("id").alias("a"), F.col("items").alias("of_a"))
    right = sets.select(F.col("id").alias("b"), F.col("items").alias("of_b"))
    common = F.size(F.array_intersect("of_a", "of_b"))
    union = F.size("of_a") + F.size("of_b") - common
    return able.join(left, "a").join(right, "b").where(100 * common >= percent * union).select("a", "b")


def _parted(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows (node, band) of bands that hold nodes of several components, with the component."""
    named = rows.join(labels, F.col("node") == F.col("member"), "left").select(
        "node", "band", F.coalesce("component", "node").alias("component")
    )
    ends = named.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    return named.join(ends.select("band"), "band", "left_semi")


def _across(parted: DataFrame, outlines: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that share a band and whose bitmaps allow the similarity.

    In each band the component with most nodes is only compared with the others.
    """
    sizes = parted.groupBy("band", "component").count().groupBy("band")
    main = sizes.agg(F.max_by("component", F.struct("count", "component")).alias("main"))
    rows = parted.join(main, "band").select("node", "band", "component", (F.col("component") == F.col("main")).alias("major"))
    rows = materialize(rows.join(outlines, "node"), "outlined")
    both = _sided(rows.where("NOT major"), "a").join(_sided(rows, "b"), "band")
    once = (F.col("component_a") != F.col("component_b")) & (F.col("major_b") | (F.col("a") < F.col("b")))
    pairs = both.where(once & _possible(percent))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    width: int = 5,
    percent: int = 80,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, kept."""
    # the mark tells apart the texts of one id
    texts = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")).withColumn("mark", F.xxhash64("text"))
    schema = "id long, mark long, n long, digest binary, bands array<long>, bits array<long>"
    found = materialize(texts.mapInArrow(giving_back(_sketched(width, bands, rows)), schema), "sketches")
    filled = found.where("id IS NOT NULL AND n > 0")
    nodes = filled.groupBy("digest", "n").agg(F.min(F.struct("id", "mark")).alias("of"))
    nodes = materialize(nodes.select("digest", "n", "of.id", "of.mark", F.monotonically_increasing_id().alias("node")), "sets")
    # bands of one text per node: that of the smallest id
    first = filled.join(nodes.select("id", "mark", "node"), ["id", "mark"])
    banded = first.select("node", F.explode("bands").alias("band")).distinct()
    buckets = banded.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    shared = materialize(banded.join(buckets, "band"), "bands")
    outlines = first.select("node", "n", "bits").dropDuplicates(["node"])
    words = [F.col("bits")[k].alias(f"bits{k}") for k in range(WORDS)]
    outlines = outlines.select("node", "n", *words, F.aggregate("bits", F.lit(0), lambda s, w: s + F.bit_count(w)).alias("set"))
    outlines = materialize(outlines, "outlines")
    standing = nodes.join(shared.select("node").distinct(), "node", "left_semi").select("node", "id", "mark")
    node_texts = _sent(texts, standing, ["id", "mark"], "inner").select(F.col("node").alias("id"), "text")
    node_texts = materialize(node_texts, "node-texts")

    def led(leader: str, rows_: DataFrame) -> DataFrame:
        """The leader that a node shares most bands with; ties to the smaller one."""
        counted = rows_.where(F.col(leader) != F.col("node")).groupBy("node", F.col(leader).alias("b")).count()
        best = counted.groupBy("node").agg(F.min_by("b", F.struct(-F.col("count"), F.col("b"))).alias("b"))
        return best.select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()

    links = materialize(_confirmed(materialize(led("low", shared), "led"), outlines, node_texts, width, percent), "links")
    labels = connected(links)
    for turn in range(1, TURNS + 2):
        parted = materialize(_parted(shared, labels), "parted")
        if turn <= TURNS:
            leader = F.min_by(F.struct("node", "component"), F.xxhash64("node", F.lit(turn)))
            led_by = parted.groupBy("band").agg(leader.alias("leader"))
            todo = parted.join(led_by, "band").where("component <> leader.component").select(
                F.least("node", "leader.node").alias("a"), F.greatest("node", "leader.node").alias("b")
            ).distinct()
        else:
            todo = _across(parted, outlines, percent)
        todo = materialize(todo, "todo")
        more = materialize(_confirmed(todo, outlines, node_texts, width, percent), "more")
        if not more.isEmpty():
            links = links.unionByName(more)
            labels = connected(links)
    named = materialize(nodes.join(labels, F.col("node") == F.col("member"), "left").select("digest", "n", "id", "component"), "named")
    lowest = named.where("component IS NOT NULL").groupBy("component").agg(F.min("id").alias("low"))
    node_of = _sent(named, lowest, "component", "left").select("digest", "n", F.coalesce("low", "id").alias("component"))
    out = found.select("id", "n", "digest").join(node_of, ["digest", "n"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(
        F.col("id").alias(id_column), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
