"""Nearest neighbours by cosine with shifted space-filling curves.

Unit vectors are projected onto a few random axes. Each of several curves shifts and turns
the projections, and a Hilbert index orders them; Spark range-partitions the rows by
curve and index, so rows that follow each other in a partition are close. Every query is
compared with the rows of a window around it on each curve, also over the border of a partition: the
rows at the two sides of a border meet in a group of their own, two windows long at most (a partition shorter than a
window hands on only its own rows). The windows of all
curves are merged and reranked by the cosine of the original vectors.

In few dimensions, or where vectors lie in groups, that finds the neighbours. For vectors
without any structure no order on a line does (the README gives the recall of the windows alone), so
an exact step follows: the rows of the first curve form blocks with a centre and a radius,
queries form chunks, and a chunk visits each block that by the angle between centres and the
radii may hold a row nearer than the worst neighbour the windows found. Blocks and chunks
have bounded sizes and are spread over tasks by (block, chunk); what the bounds rule out
is not moved. Without structure every chunk visits every block; then the work is
queries times rows, in blocks.

The score is summed over the components in order, in double precision, on the
original vectors. Defined cases: vectors that are null, empty, zero, hold a
null or a non-finite component, or have another length than most vectors take no part, neither do rows with a
null id. Equal scores go to the smaller id. A repeated id is one vector, the
first by its components. Only the named columns are read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tagtrail.session import materialize

AXES = 6
BITS = 10
CURVES = 4
WINDOW = 128
BLOCK = 8192
CHUNK = 2048
_SLACK = 1e-9


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of rows of ``bits``-bit coordinates, by exchanging and inverting the low bits of each axis in turn."""
    x = points.astype(np.int64).T.copy()
    axes = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(axes):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= np.where(high, 0, swap) if i else 0
        q >>= 1
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[axes - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    index = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(axes):
            index = (index << 1) | ((x[i] >> b) & 1)
    return index


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, size)


def _length(rows: np.ndarray) -> np.ndarray:
    total = np.zeros(len(rows))
    for d in range(rows.shape[1]):
        total += rows[:, d] * rows[:, d]
    return np.sqrt(total)


def cosines(queries: np.ndarray, rows: np.ndarray, at: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Cosine of ``queries[at]`` and ``rows[row]``, every sum taken in the order of the components."""
    dot = np.zeros(len(at))
    for d in range(queries.shape[1]):
        dot += queries[at, d] * rows[row, d]
    return dot / (_length(queries)[at] * _length(rows)[row])


def _ranked(q_ids: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> pd.DataFrame:
    found = pd.DataFrame({"query_id": q_ids, "vec_id": ids, "score": score})
    found = found.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
    return found.groupby("query_id", sort=False).head(k)


def _nearest(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> pd.DataFrame:
    """The k nearest rows of each query, ranked by the exact score and then by id."""
    rough = (q / _length(q)[:, None]) @ (rows / _length(rows)[:, None]).T
    rough[q_ids[:, None] == ids[None, :]] = -2.0
    kept = min(k, rough.shape[1])
    edge = -np.partition(-rough, kept - 1, axis=1)[:, kept - 1]
    at, row = np.nonzero((rough >= edge[:, None] - _SLACK) & (rough > -1.5))
    return _ranked(q_ids[at], ids[row], cosines(q, rows, at, row), k)


_FOUND = "query_id long, vec_id long, score double"
# A row of a partition's first (side 0) or last rows (side 1), in order by ``at``; null in the rows found.
_EDGE = "task int, side int, at int, curve int, id long, vector array<double>, query boolean"


def _best(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best distinct neighbours; Spark cuts to k rows a query before the shuffle too."""
    one = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return one.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def _usable(vectors: DataFrame, id_column: str, vector_column: str, is_query: Column) -> tuple[DataFrame, int]:
    doubles = F.col(vector_column).cast("array<double>")
    finite = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), doubles.alias("vector"), is_query.alias("query"), finite.alias("finite"))
    rows = rows.where("id IS NOT NULL AND vector IS NOT NULL AND finite").where(F.exists("vector", lambda x: x != 0)).drop("finite")
    sizes = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    size = sizes[0].size if sizes else 1
    return rows.where(F.size("vector") == size), size


def nearest_neighbours(
    vectors: DataFrame,
    is_query: Column,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    k: int = 5,
    curves: int = CURVES,
    window: int = WINDOW,
    exact: bool = True,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows of each row for which ``is_query`` holds."""
    rows, size = _usable(vectors, id_column, vector_column, is_query)
    rows = materialize(rows.groupBy("id").agg(F.min(F.struct("vector", "query")).alias("one")).select("id", "one.*"), "vectors")
    draw = np.random.default_rng(3)
    turns = [np.linalg.qr(draw.normal(size=(size, size)))[0][:, :AXES] for _ in range(curves)]
    shifts = draw.uniform(-0.25, 0.25, (curves, min(AXES, size)))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrix = _matrix(batch.column(1), size)
            unit = matrix / np.linalg.norm(matrix, axis=1)[:, None]
            places = np.empty((len(unit), curves), np.int64)
            for c in range(curves):
                # components of a unit vector are near 1 / sqrt(size); three of them each way make the cube
                cube = (unit @ turns[c] * np.sqrt(size) / 3.0 + shifts[c] + 1.25) / 2.5
                cell = np.clip(cube * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
                places[:, c] = hilbert(cell, BITS)
            listed = pa.ListArray.from_arrays(np.arange(len(unit) + 1, dtype=np.int32) * curves, pa.array(places.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, listed], ["id", "vector", "query", "places"])

    rows = materialize(rows.mapInArrow(placed, "id long, vector array<double>, query boolean, places array<long>"), "places")
    curved = rows.select(F.posexplode("places").alias("curve", "place"), "id", "vector", "query")
    curved = curved.repartitionByRange("curve", "place", "id").sortWithinPartitions("curve", "place", "id")
    seen = materialize(curved.mapInArrow(_windows(size, window, k), f"{_FOUND}, {_EDGE}"), "windows")
    bridged = _bridged(seen.where("task IS NOT NULL"), window, k)
    found = _best(seen.where("task IS NULL").select("query_id", "vec_id", "score").unionByName(bridged), k)
    if exact:
        found = materialize(found, "nearest-in-windows")
        visited = _visited(rows, found, size, k)
        found = _best(found.drop("rank").unionByName(visited), k)
    return found


def _in_windows(
    curve: np.ndarray, ids: np.ndarray, query: np.ndarray, matrix: np.ndarray, lo: int, hi: int, window: int, k: int
) -> Iterator[pd.DataFrame]:
    """The k nearest rows of the queries from ``lo`` to ``hi``, each among the rows of its window."""
    asks = np.flatnonzero(query[lo:hi]) + lo
    near = np.arange(-window, window + 1)  # the window of each query, itself left out
    for part in np.array_split(asks, len(asks) // 64 + 1):
        at = part[:, None] + near[None, :]
        fits = (at >= 0) & (at < len(ids)) & (near != 0)
        at = np.clip(at, 0, len(ids) - 1)
        fits &= curve[at] == curve[part][:, None]
        who, where = np.nonzero(fits)
        row = at[who, where]
        yield _ranked(ids[part[who]], ids[row], cosines(matrix, matrix, part[who], row), k)


def _windows(size: int, window: int, k: int):
    """The best of the windows inside a sorted partition, and the rows at its two ends."""
    blank = pa.schema([("task", pa.int32()), ("side", pa.int32()), ("at", pa.int32()), ("curve", pa.int32()), ("id", pa.int64()),
                       ("vector", pa.list_(pa.float64())), ("query", pa.bool_())])
    sought = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def filled(n: int, held: list[pa.Array | None]) -> pa.RecordBatch:
        schema = pa.schema([*sought, *blank])
        return pa.RecordBatch.from_arrays(
            [pa.nulls(n, f.type) if a is None else a.cast(f.type) for f, a in zip(schema, held, strict=True)], schema=schema
        )

    def read(table: pa.Table, lo: int, hi: int) -> Iterator[pa.RecordBatch]:
        query = np.asarray(table["query"])
        if not query[lo:hi].any():
            return
        matrix = _matrix(table["vector"].combine_chunks(), size)
        for best in _in_windows(np.asarray(table["curve"]), np.asarray(table["id"]), query, matrix, lo, hi, window, k):
            yield filled(len(best), [*(pa.array(best[f.name].to_numpy()) for f in sought), *[None] * len(blank)])

    def edge(table: pa.Table, side: int) -> pa.RecordBatch:
        n = table.num_rows
        task = pa.array(np.full(n, TaskContext.get().partitionId(), np.int32))
        columns = [table[c].combine_chunks() for c in ("curve", "id", "vector", "query")]
        return filled(n, [None, None, None, task, pa.array(np.full(n, side, np.int32)), pa.array(np.arange(n, dtype=np.int32)), *columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        first = 0  # rows of ``held`` whose window has been read
        begun = False
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            ready = held.num_rows - window
            if ready > first + 4096:
                if not begun:
                    yield edge(held.slice(0, window), 0)
                    begun = True
                yield from read(held, first, ready)
                drop = max(0, ready - window)
                held, first = held.slice(drop), ready - drop
        if held is not None and held.num_rows:
            if not begun:
                yield edge(held.slice(0, window), 0)
            yield edge(held.slice(max(0, held.num_rows - window)), 1)
            yield from read(held, first, held.num_rows)

    return run


def _bridged(edges: DataFrame, window: int, k: int) -> DataFrame:
    """The best of the windows that reach over the border of two partitions, in groups of two windows at most."""
    tasks = edges.select("task").distinct()  # a row per partition
    tasks = tasks.select("task", F.lag("task").over(Window.orderBy("task")).alias("before")).where("before IS NOT NULL")
    heads = edges.where("side = 0").join(tasks, "task").withColumn("border", F.col("before")).drop("before")
    both = edges.where("side = 1").withColumn("border", F.col("task")).unionByName(heads)

    def compared(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["side", "at"], ascending=[False, True])
        query = rows["query"].to_numpy(bool)
        if rows["side"].nunique() < 2 or not query.any():
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        matrix, ids, curve = np.stack(rows["vector"].to_numpy()), rows["id"].to_numpy(), rows["curve"].to_numpy()
        return pd.concat(_in_windows(curve, ids, query, matrix, 0, len(rows), window, k))

    columns = ["border", "side", "at", "curve", "id", "vector", "query"]
    return both.select(*columns).groupBy("border", "curve").applyInPandas(compared, _FOUND)


def _grouped(rows: DataFrame, name: str, per: int) -> DataFrame:
    """Number the rows of every partition and cut them into groups of ``per``; ``name`` is the group's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            number = (np.arange(batch.num_rows) + at) // per
            at += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(number)], [*batch.schema.names, "part"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    numbered = rows.withColumn("task", F.spark_partition_id())
    numbered = numbered.mapInArrow(run, f"{schema}, task int, part long")
    return materialize(numbered.withColumn(name, F.col("task").cast("long") * (1 << 32) + F.col("part")).drop("task", "part"), name)


def _chunked(queries: DataFrame) -> DataFrame:
    """Number the queries by stretches of their curve of about CHUNK each, whatever their partitions.

    A stretch whose queries share one place is cut further by a hash of the id.
    """
    spread = max(1, -(-queries.count() // CHUNK))
    cuts = sorted(set(queries.approxQuantile("place", [i / spread for i in range(1, spread)], 0.2 / spread))) if spread > 1 else []
    stretch = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: F.col("place") >= c)) if cuts else F.lit(0)
    placed = queries.withColumn("stretch", stretch)
    held = {r["stretch"]: r["count"] for r in placed.groupBy("stretch").count().collect()}  # a row per stretch
    parts = F.array(*[F.lit(max(1, -(-held.get(i, 0) // (2 * CHUNK)))) for i in range(len(cuts) + 1)])
    part = F.pmod(F.xxhash64("id"), F.get(parts, F.col("stretch")).cast("long"))
    return placed.withColumn("chunk", F.col("stretch").cast("long") * (1 << 32) + part).drop("stretch", "place")


def _outline(rows: DataFrame, name: str, size: int) -> DataFrame:
    """Centre on the sphere and largest angle from it of every group: (name, centre, radius)."""
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    unit = rows.withColumn("vector", F.transform("vector", lambda x: x / norm))
    sums = unit.groupBy(name).agg(F.array(*[F.sum(F.col("vector")[d]) for d in range(size)]).alias("centre"))
    length = F.sqrt(F.aggregate("centre", F.lit(0.0), lambda s, x: s + x * x))
    centres = sums.withColumn("centre", F.when(length > 0, F.transform("centre", lambda x: x / length)).otherwise(F.col("centre")))
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _dot("vector", "centre"))))
    return unit.join(centres, name).groupBy(name).agg(F.first("centre").alias("centre"), F.max(angle).alias("radius"))


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _visited(rows: DataFrame, found: DataFrame, size: int, k: int) -> DataFrame:
    """Neighbours in the blocks that the windows and the bounds leave open."""
    placed = rows.select("id", "vector", "query", F.col("places")[0].alias("place"))
    ordered = placed.repartitionByRange("place", "id").sortWithinPartitions("place", "id")
    blocks = _grouped(ordered.select("id", "vector"), "block", BLOCK)
    worst = found.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("worst"))
    queries = placed.where("query").select("id", "vector", "place").join(worst, "id", "left")
    queries = materialize(queries.withColumn("worst", F.coalesce("worst", F.lit(-1.0))), "queries")
    chunks = _chunked(queries)
    of_block = materialize(_outline(blocks, "block", size), "block-outlines")
    of_chunk = _outline(chunks, "chunk", size).join(chunks.groupBy("chunk").agg(F.min("worst").alias("worst")), "chunk")
    of_chunk = materialize(of_chunk.select("chunk", F.col("centre").alias("chunk_centre"), F.col("radius").alias("chunk_radius"), "worst"), "chunk-outlines")
    # the outlines meet by a number that each outline of a block carries once for each of a few groups of chunks
    groups = max(1, of_chunk.count() // 64)
    left = of_block.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = of_chunk.withColumn("group", F.pmod(F.xxhash64("chunk"), F.lit(groups)).cast("int"))
    gap = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _dot("centre", "chunk_centre")))) - F.col("radius") - F.col("chunk_radius")
    near = F.cos(F.greatest(gap - 1e-6, F.lit(0.0))) >= F.col("worst") - 1e-9
    open_pairs = materialize(left.join(right, "group").where(near).select("block", "chunk"), "open-pairs")
    pair = F.struct("block", "chunk").alias("pair")
    data = blocks.join(open_pairs, "block").select(pair, "id", "vector", F.lit(None).cast("double").alias("worst"))
    asks = chunks.join(open_pairs, "chunk").select(pair, "id", "vector", "worst")

    def compared(key: tuple, left_rows: pd.DataFrame, right_rows: pd.DataFrame) -> pd.DataFrame:
        if not len(left_rows) or not len(right_rows):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        q, r = np.stack(right_rows["vector"].to_numpy()), np.stack(left_rows["vector"].to_numpy())
        ids, q_ids = left_rows["id"].to_numpy(), right_rows["id"].to_numpy()
        # a few queries at a time: rows that tie with the last neighbour are all ranked exactly
        return pd.concat([_nearest(q_ids[i : i + 128], q[i : i + 128], ids, r, k) for i in range(0, len(q), 128)])

    return data.groupBy("pair").cogroup(asks.groupBy("pair")).applyInPandas(compared, _FOUND)
