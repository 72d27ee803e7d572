"""Hard negatives by inner product: length buckets, sorted coordinate lists, exact verification.

Components become whole numbers, so every score is exact. The rows are ordered by length,
range-partitioned into blocks, and every block is cut into buckets of ``BUCKET`` rows of about one length. A bucket
holds its unit rows as one sorted list per coordinate. An anchor that needs a score of ``t`` from a bucket whose
longest row has length ``l`` needs a cosine of ``c = t / (|anchor| l)`` at least: above one the bucket is left out. Else the row's
coordinate on an axis lies in a range: with ``a`` the angle between anchor and axis, between the cosines of
``a + arccos c`` and ``a - arccos c``. The ranges of the anchor's largest coordinates, its focus, are looked up in the
sorted lists, the smallest list is taken and the others cut it down, and what remains is verified by its exact inner
product. Where even the smallest list holds most of the bucket, the whole bucket is verified. The threshold rises with what is found.

Positives come first: the best rows of the anchor's label, from the block of the longest rows, whose results bound the search in
the others. Then the rows of other labels whose score lies within given shares of a positive's.
Blocks have a bounded number of rows. Anchors are copied once for each block whose longest row may reach their bound and stream past it, so
no task holds more than a block; the anchors are a stated part of all rows, and no pair of rows is shuffled.

Defined cases: rows with a null id, label or vector or a null or non-finite component take no part. Ids are whole numbers. A repeated
id is another row, and an anchor itself is its row and not its id. A shorter vector has zeros at its end. Components beyond the range of a long are held at its ends,
and so are scores. Anchors without positives, and positives below zero, have no negatives. Only the named columns are read.
An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tagtrail.session import materialize

#: Components of a block at most, so 32 MB of whole numbers.
BLOCK_CELLS = 1 << 22
BUCKET = 1024
FOCUS = 3
#: Share of a bucket from which its rows are verified without lists.
DENSE = 0.5
ANCHORS = 256
_SLACK = 1e-9
_TOP = np.iinfo(np.int64).max
_FOUND = "anchor long, slot int, id long, score long"


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """Rows of whole numbers, filled up with zeros to ``size``."""
    flat, sizes = np.asarray(column.flatten()), np.asarray(column.value_lengths())
    out = np.zeros((len(column), size), np.int64)
    out[np.arange(size)[None, :] < sizes[:, None]] = flat
    return out


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of ``a`` with all of ``b``: in doubles while every sum stays below 2**53."""
    if float(np.abs(a, dtype=float).max(initial=0)) * float(np.abs(b, dtype=float).max(initial=0)) * a.shape[1] < 2.0**53:
        return (a.astype(np.float64, copy=False) @ b.astype(np.float64, copy=False).T).astype(np.int64)
    exact = np.array([[sum(int(p) * int(q) for p, q in zip(x, y, strict=True)) for y in b.tolist()] for x in a.tolist()], dtype=object).reshape(len(a), len(b))
    return np.clip(exact, -_TOP, _TOP).astype(np.int64)


def _unit(rows: np.ndarray, length: np.ndarray) -> np.ndarray:
    return rows / np.where(length > 0, length, 1.0)[:, None]


class Bucket:
    """Rows of about one length: a sorted list per coordinate of the unit rows, and each row's place in it."""

    def __init__(self, ids, keys, labels, rows, length):
        self.ids, self.keys, self.labels = ids, keys, labels
        # doubles hold them exactly below 2**53
        self.rows = rows.astype(np.float64) if np.abs(rows, dtype=float).max(initial=0) < 2.0**53 else rows
        self.longest = float(length.max())
        unit = _unit(rows, length)
        order = np.argsort(unit, axis=0, kind="stable")
        self.sorted = np.take_along_axis(unit, order, axis=0).T.copy()
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(len(rows))[:, None], axis=0)
        self.order, self.place = order.T.astype(np.int32), place.T.astype(np.int32)

    def candidates(self, unit: np.ndarray, focus: np.ndarray, cosine: float) -> np.ndarray | None:
        """Rows that may reach ``cosine`` with a unit anchor; None if no list is short enough to be worth it."""
        turn = math.acos(min(1.0, cosine))
        ranges = []
        for f in focus.tolist():
            angle = math.acos(max(-1.0, min(1.0, unit[f])))
            low, high = math.cos(min(math.pi, angle + turn)) - _SLACK, math.cos(max(0.0, angle - turn)) + _SLACK
            column = self.sorted[f]
            ranges.append((int(column.searchsorted(low, "left")), int(column.searchsorted(high, "right")), f))
        lo, hi, f = min(ranges, key=lambda r: r[1] - r[0])
        if hi - lo > DENSE * len(self.ids):
            return None
        rows = self.order[f, lo:hi]
        for a, b, g in ranges:
            if g != f:
                at = self.place[g, rows]
                rows = rows[(at >= a) & (at < b)]
        return rows

    def scored(self, anchors: np.ndarray, length: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(anchor, row, score) of all pairs that reach ``least``, a number for each anchor, and how many were verified."""
        with np.errstate(all="ignore"):
            cosine = least / (length * self.longest)
        bounded = np.isfinite(cosine) & (cosine > 0)
        dense = ~bounded
        sharp = np.flatnonzero(bounded & (cosine <= 1.0 + _SLACK))
        unit = _unit(anchors[sharp], length[sharp])
        focus = np.argsort(-np.abs(unit), axis=1, kind="stable")[:, :FOCUS]
        parts, verified = [], 0
        for i, a in enumerate(sharp.tolist()):
            rows = self.candidates(unit[i], focus[i], float(cosine[a]))
            if rows is None:
                dense[a] = True
            elif len(rows):
                parts.append((np.full(len(rows), a), rows, _dot(anchors[a : a + 1], self.rows[rows])[0]))
                verified += len(rows)
        whole = np.flatnonzero(dense)
        if len(whole):
            score = _dot(anchors[whole], self.rows)
            at, row = np.nonzero(score >= least[whole][:, None])
            parts.append((whole[at], row, score[at, row]))
            verified += score.size
        if not parts:
            return (np.zeros(0, np.int64),) * 3 + (verified,)
        at, row, score = (np.concatenate(x) for x in zip(*parts, strict=True))
        good = score >= least[at]
        return at[good], row[good], score[good], verified


class Best:
    """The ``k`` best (score, smaller id first) of each group, and the score that a new one must reach."""

    def __init__(self, groups: int, k: int):
        self.k = k
        self.group, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.edge = np.full(groups, -np.inf)

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(group):
            return
        group, score, ids = (np.concatenate(x) for x in ((self.group, group), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, group))
        group, score, ids = group[order], score[order], ids[order]
        place = np.arange(len(group)) - np.searchsorted(group, group)
        kept = place < self.k
        self.group, self.score, self.id = group[kept], score[kept], ids[kept]
        full = place == self.k - 1
        self.edge[group[full]] = score[full]


def _buckets(rows: dict, by_label: bool) -> dict[str | None, list[Bucket]]:
    """The buckets of a block, by label or all under None, the longest rows first."""
    order = np.lexsort((rows["key"], -rows["length"]))
    groups: dict[str | None, np.ndarray] = {None: order}
    if by_label:
        labels, code = np.unique(rows["label"][order], return_inverse=True)
        by_code = np.argsort(code, kind="stable")
        cuts = np.searchsorted(code[by_code], np.arange(len(labels) + 1))
        groups = {x: order[by_code[cuts[i] : cuts[i + 1]]] for i, x in enumerate(labels.tolist())}
    return {
        label: [
            Bucket(*(rows[c][at[k : k + BUCKET]] for c in ("id", "key", "label", "vector", "length")))
            for k in range(0, len(at), BUCKET)
        ]
        for label, at in groups.items()
    }


def positives_in(buckets: dict, anchors: dict, k: int) -> tuple[Best, int]:
    """Best rows of the anchors' own labels."""
    best, verified = Best(len(anchors["id"]), k), 0
    labels, code = np.unique(anchors["label"], return_inverse=True)
    for i, label in enumerate(labels.tolist()):
        own = np.flatnonzero(code == i)
        for bucket in buckets.get(label, ()):
            least = np.maximum(best.edge[own], anchors["least"][own])
            at, row, score, n = bucket.scored(anchors["vector"][own], anchors["length"][own], least)
            other = bucket.keys[row] != anchors["key"][own][at]
            best.add(own[at][other], score[other], bucket.ids[row][other])
            verified += n
    return best, verified


def negatives_in(buckets: dict, anchors: dict, k: int, low: int, high: int) -> tuple[Best, int]:
    """Best rows of other labels between ``low`` and ``high`` percent of each positive score; group = anchor * slots + slot."""
    tops = anchors["tops"]
    n, slots = tops.shape
    best, verified = Best(n * slots, k), 0
    exact = [[int(x) if live else None for x, live in zip(*pair, strict=True)] for pair in zip(tops, anchors["live"], strict=True)]
    # whole numbers from which and up to which a score counts
    floor = np.array([[-(-low * x // 100) if x is not None else _TOP for x in row] for row in exact], np.int64).reshape(n, slots)
    ceiling = np.array([[min(_TOP, high * x // 100) if x is not None else -_TOP for x in row] for row in exact], np.int64).reshape(n, slots)
    for bucket in buckets[None]:
        edge = np.maximum(best.edge.reshape(n, slots), floor)
        edge[ceiling < floor] = np.inf
        least = edge.min(axis=1)
        some = np.flatnonzero(np.isfinite(least))
        at, row, score, count = bucket.scored(anchors["vector"][some], anchors["length"][some], least[some])
        verified += count
        at = some[at]
        other = bucket.labels[row] != anchors["label"][at]
        at, row, score = at[other], row[other], score[other]
        for slot in range(slots):
            fits = (score >= floor[at, slot]) & (score <= ceiling[at, slot]) & (score >= best.edge[at * slots + slot])
            best.add(at[fits] * slots + slot, score[fits], bucket.ids[row[fits]])
    return best, verified


def _columns(batches: list[pa.RecordBatch], size: int, slots: int) -> dict:
    column = {name: pa.concat_arrays([b.column(name) for b in batches]) for name in ("id", "key", "length", "label", "vector", "tops")}
    out = {c: np.asarray(column[c]) for c in ("id", "key", "length")}
    out["label"] = np.array(column["label"].to_pylist(), dtype=object).astype(str)
    out["vector"] = _matrix(column["vector"], size)
    tops = column["tops"].to_pylist()
    out["tops"], out["live"] = np.zeros((len(tops), slots), np.int64), np.zeros((len(tops), slots), bool)
    for i, row in enumerate(tops):
        out["tops"][i, : len(row or ())] = row or ()
        out["live"][i, : len(row or ())] = True
    out["least"] = np.where(out["live"].all(axis=1), out["tops"].min(axis=1, initial=_TOP), -np.inf)
    return out


def _searched(size: int, slots: int, by_label: bool, search):
    """Past the rows of each block, kind 0, its anchors, kind 1, stream; ``search`` returns groups of (anchor, slot)."""
    wide = 1 if by_label else slots

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, buckets = None, [], None
        for batch in batches:
            blocks, kinds = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            cuts = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(kinds) != 0)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(blocks)], strict=True):
                if lo == hi:
                    continue
                if blocks[lo] != block:
                    block, held, buckets = blocks[lo], [], None
                if kinds[lo] == 0:
                    held.append(batch.slice(lo, hi - lo))
                    continue
                if not held and buckets is None:
                    continue
                for at in range(lo, hi, ANCHORS):
                    anchors = _columns([batch.slice(at, min(ANCHORS, hi - at))], size, slots)
                    if buckets is None:
                        buckets, held = _buckets(_columns(held, size, slots), by_label), []
                    best, _ = search(buckets, anchors)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(anchors["key"][best.group // wide]), pa.array((best.group % wide).astype(np.int32)), pa.array(best.id), pa.array(best.score)],
                        ["anchor", "slot", "id", "score"],
                    )

    return run


def _ranked(found: DataFrame, key: list[str], k: int, name: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("score"), "id"))
    return found.withColumn(name, rank).where(F.col(name) <= k)


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    label: Column,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    scale: int = 256,
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    high: int = 100,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    For each row for which ``is_anchor`` holds and each of its ``positives`` best other rows of its label,
    the ``negatives`` best rows of other labels from ``low`` to ``high`` percent of the positive's score.
    """
    if vectors.schema[id_column].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{id_column} must hold whole numbers")
    spark = vectors.sparkSession
    doubles = F.col(vector_column).cast("array<double>")
    finite = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(
        F.col(id_column).cast("long").alias("id"), label.cast("string").alias("label"), doubles.alias("doubles"),
        F.coalesce(is_anchor, F.lit(False)).alias("query"), finite.alias("finite"),
    ).where("id IS NOT NULL AND label IS NOT NULL AND doubles IS NOT NULL AND finite")
    rows = rows.withColumn("vector", F.transform("doubles", lambda x: F.floor(x * float(scale)).cast("long"))).drop("doubles", "finite")
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    # the number of a row holds from here on, since it is written with it
    rows = materialize(rows.withColumn("length", length).withColumn("key", F.monotonically_increasing_id()), "vectors")
    n, size = rows.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0))).head()
    size = max(1, size)
    blocks = max(spark.sparkContext.defaultParallelism, math.ceil(n * size / BLOCK_CELLS))
    placed = rows.repartitionByRange(blocks, F.desc("length"), F.asc("key")).withColumn("block", F.spark_partition_id())
    placed = materialize(placed, "blocks")
    # two numbers a block
    outline = [tuple(r) for r in placed.groupBy("block").agg(F.max("length")).orderBy("block").collect()]
    tops = F.lit(None).cast("array<long>").alias("tops")
    anchors = placed.where("query").select("key", "id", "label", "vector", "length", tops)

    def past(anchors: DataFrame, target: Column, some: list[tuple], by_label: bool) -> DataFrame:
        """What the anchors find in the blocks ``some``, those left out where no row can reach ``target``."""
        if not some:
            return spark.createDataFrame([], _FOUND)
        first, last = some[0][0], some[-1][0]
        bounds = F.array(*[F.lit(float(x)) for _, x in some])
        reach = F.size(F.filter(bounds, lambda x: (x * F.col("length") * (1 + 1e-9) >= target) | target.isNull() | (target <= 0)))
        if len(some) == 1:
            reach = F.lit(1)
        numbers = F.slice(F.array(*[F.lit(b) for b, _ in some]), F.lit(1), reach)
        here = placed.where(F.col("block").between(first, last)).select(
            "block", F.lit(0).alias("kind"), "key", "id", "label", "vector", "length", tops
        )
        copies = anchors.select(F.explode(numbers).alias("block"), F.lit(1).alias("kind"), "key", "id", "label", "vector", "length", "tops")
        dealt = here.unionByName(copies).repartitionByRange(len(some), "block").sortWithinPartitions("block", "kind")
        if by_label:
            search = lambda buckets, a: positives_in(buckets, a, positives)
        else:
            search = lambda buckets, a: negatives_in(buckets, a, negatives, low, high)
        return dealt.mapInArrow(_searched(size, positives, by_label, search), _FOUND)

    def with_tops(found: DataFrame) -> DataFrame:
        held = found.groupBy("anchor").agg(F.sort_array(F.collect_list("score"), asc=False).alias("tops"))  # positives many at most
        return anchors.drop("tops").join(held, F.col("key") == F.col("anchor"), "left").drop("anchor")

    found = materialize(_ranked(past(anchors, F.lit(None).cast("double"), outline[:1], True), ["anchor"], positives, "rank"), "first")
    ahead = with_tops(found)
    fifth = F.when(F.size("tops") >= positives, F.element_at("tops", positives)).cast("double")
    more = past(ahead, fifth, outline[1:], True)
    best = materialize(_ranked(found.drop("rank").unionByName(more), ["anchor"], positives, "slot_at"), "positives")
    # below the lowest share of the lowest positive that is not negative, nothing counts
    wanted = with_tops(best.where("score >= 0"))
    least = F.array_min("tops").cast("double") * (low / 100.0)
    worst = materialize(wanted.where("tops IS NOT NULL"), "anchors")
    against = past(worst, least, outline, False)
    chosen = _ranked(against, ["anchor", "slot"], negatives, "rank")
    good = best.select(F.col("anchor").alias("_a"), (F.col("slot_at") - 1).alias("_s"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    names = anchors.select(F.col("key").alias("_k"), F.col("id").alias("anchor_id"))
    out = chosen.join(good, (F.col("anchor") == F.col("_a")) & (F.col("slot") == F.col("_s"))).join(names, F.col("anchor") == F.col("_k"))
    return out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
