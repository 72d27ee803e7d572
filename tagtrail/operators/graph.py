"""Graphs as a vertex table (id, name) and an edge table (src, dst, ...).

Loops run on the driver, one round at a time, until nothing is left to do. Each
round is written to the shared scratch folder and read back, which cuts the
lineage, survives lost executors and tells the next join its true size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, functions as F

from tagtrail.functions.collections import appended
from tagtrail.operators.keyed import count_by, lookup
from tagtrail.operators.layout import reused
from tagtrail.session import BucketedTable, materialize, scratch_path

NOBODY = "Nobody"
PART_EDGES = 1_000_000
#: Rounds after which the files of the visited vertices are merged.
MERGE_ROUNDS = 32


def _edge_ends(edges: DataFrame) -> DataFrame:
    """Both ends of every edge from one scan."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id"))


def graph_vertices(edges: DataFrame, names: DataFrame, default: str = NOBODY) -> DataFrame:
    """Every vertex of the graph, named or not: named ones, and ends of edges with a default name."""
    ids = _edge_ends(edges).unionByName(names.select("id")).distinct()
    return lookup(ids, names.select("id", "name"), "id", "name", F.lit(default))


def degrees(edges: DataFrame) -> DataFrame:
    """Edges in and out per vertex."""
    return _edge_ends(edges).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def top_degrees(edges: DataFrame, names: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` most connected named vertices. Ties go to the smallest id."""
    named = names.where(F.col("name").isNotNull()).groupBy("id").agg(F.min("name").alias("name"))
    return degrees(edges).join(named, "id").orderBy(F.desc("degree"), F.asc("id")).limit(k)


class Search:
    """Breadth-first search over edges that lie in buckets by their start.

    The edges are written once, dealt out by a hash of ``src``; the visited vertices are one table in as many buckets, to
    which each round adds what it has reached. So a round moves its frontier and the ends of the frontier's edges and neither the
    edges nor the visited vertices, and its plan has one size in all rounds. The edges of a vertex with more than ``most`` of them
    are cut into parts that lie in different buckets; such vertices are fewer than edges / ``most``, so they may be
    sent to every task. The frontier is kept in memory while its round runs; it is written too, so a lost executor only has it
    read again. A vertex is reached once, so the rounds end by themselves.
    """

    def __init__(self, edges: DataFrame, start: DataFrame, buckets: int | None = None, most: int = PART_EDGES):
        spark = edges.sparkSession
        buckets = buckets or max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        kind = edges.schema["src"].dataType
        edges = edges.select("src", F.col("dst").cast(kind).alias("dst"))
        crowded = count_by(edges, "src").where(F.col("n") > most)
        self.crowded = materialize(crowded.select("src", F.ceil(F.col("n") / most).cast("int").alias("parts")), "crowded")
        self.any_crowded = not self.crowded.isEmpty()
        self.key = ["src", "part"] if self.any_crowded else ["src"]
        self.edges = BucketedTable(spark, "edges", self.key, buckets)
        self.visited = BucketedTable(spark, "visited", ["id"], buckets)
        self.edges.add(self._parted(edges, F.pmod(F.xxhash64("dst"), F.col("parts")).cast("int")))
        self.frontier = materialize(start.select(F.col("id").cast(kind).alias("id"), F.lit(0).alias("hops")).distinct(), "bfs")
        self.visited.add(self.frontier)

    def _parted(self, rows: DataFrame, part: Column) -> DataFrame:
        """``rows`` with the ``part`` of their ``src``, 0 where it has only one; without that column if no vertex is crowded."""
        if not self.any_crowded:
            return rows
        parts = F.coalesce(F.col("parts"), F.lit(1))
        return rows.join(F.broadcast(self.crowded), "src", "left").withColumn("parts", parts).withColumn("part", part).drop("parts")

    def leaving(self, frontier: DataFrame) -> DataFrame:
        """The ends of the edges that start at the frontier."""
        parts = self._parted(frontier.select(F.col("id").alias("src")), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        return parts.join(self.edges.read(), self.key).select("dst")

    def fresh(self, frontier: DataFrame, hop: int) -> DataFrame:
        """The vertices that the frontier reaches first, with the number of the round."""
        ends = self.leaving(frontier).select(F.col("dst").alias("id")).distinct()
        return ends.join(self.visited.read().select("id"), "id", "left_anti").select("id", F.lit(hop).alias("hops"))

    def rounds(self, most: int | None = None) -> Iterator[tuple[int, DataFrame, DataFrame]]:
        """(round, the frontier it started from, what it reached) until nothing new is reached."""
        for hop in count(1) if most is None else range(1, most + 1):
            before = self.frontier
            with reused(before) as held:
                self.frontier = materialize(self.fresh(held, hop), "bfs")
            yield hop, before, self.frontier
            if self.frontier.isEmpty():
                return
            self.visited.add(self.frontier)
            if hop % MERGE_ROUNDS == 0:  # else the number of files grows with every round
                merged = BucketedTable(before.sparkSession, "visited", ["id"], self.visited.buckets)
                merged.add(self.visited.read())
                self.visited.close()
                self.visited = merged

    def close(self) -> None:
        self.edges.close()
        self.visited.close()


def hop_distance(
    edges: DataFrame, start: DataFrame, names: DataFrame | None = None, max_rounds: int | None = None, default: str = NOBODY
) -> DataFrame:
    """Hops from the ``start`` vertices to every vertex, infinity where none arrives.

    ``max_rounds`` ends the search early on request. A round only touches the frontier's edges, and each vertex is written once.
    """
    search = Search(edges, start)
    try:
        for _ in search.rounds(max_rounds):
            pass
    finally:
        search.close()
    vertices = graph_vertices(edges, names, default) if names is not None else _edge_ends(edges).distinct()
    infinite = F.lit(float("inf"))
    return vertices.join(search.visited.plain(), "id", "left").withColumn("hops", F.coalesce(F.col("hops").cast("double"), infinite))


def degrees_of_separation(edges: DataFrame, start: DataFrame, target: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """The round in which the ``target`` is first met and how many frontier edges lead to it then.

    One row (hops, hits), or none if the target is not met. The hits come from
    counting edges and not from a counter that a retried task would raise twice.
    """
    search = Search(edges, start)
    try:
        for hop, before, reached in search.rounds(max_rounds):
            if not reached.join(target.select("id"), "id", "left_semi").isEmpty():
                hits = search.leaving(before).join(target.select(F.col("id").alias("dst")), "dst", "left_semi")
                return materialize(hits.agg(F.count(F.lit(1)).alias("hits")).select(F.lit(hop).alias("hops"), "hits"), "hits")
    finally:
        search.close()
    return edges.limit(0).select(F.lit(0).alias("hops"), F.lit(0).cast("long").alias("hits"))


def seed_paths(edges: DataFrame, seeds: Column, weight: str = "weight") -> DataFrame:
    """One-edge paths: (src, dst, path, total) of the edges that meet ``seeds``."""
    return edges.where(seeds).select("src", "dst", F.array("src", "dst").alias("path"), F.col(weight).alias("total"))


def _checked(edges: DataFrame, weight: str) -> DataFrame:
    """(src, dst, weight) written once for all rounds.

    The job fails on a weight that is not positive, with which paths could go on for ever.
    """
    w = F.col(weight).cast("double")
    error = F.raise_error(F.lit("edge weights must be above 0")).cast("double")
    return materialize(edges.select("src", "dst", F.when(w > 0, w).otherwise(error).alias("weight")), "edges")


def _extended(paths: DataFrame, edges: DataFrame) -> DataFrame:
    step = edges.select(F.col("src").alias("_at"), F.col("dst").alias("_to"), F.col("weight").alias("_w"))
    return paths.join(step, paths["dst"] == step["_at"]).select(
        "src",
        F.col("_to").alias("dst"),
        appended("path", F.col("_to")).alias("path"),
        (F.col("total") + F.col("_w")).alias("total"),
    )


def _hop_guard(steps: DataFrame, budget: float) -> int:
    """Joins after which every path must have exceeded the budget, since each adds the smallest weight at least."""
    least = steps.agg(F.min("weight")).head()[0]
    return 2 if least is None else max(0, int(budget // least)) + 2


def _hops(limit: int):
    """Numbers the rounds; a round beyond ``limit`` is an error and never a shorter result."""
    yield from range(1, limit + 1)
    raise RuntimeError(f"paths are still active after {limit} rounds")


def expand_paths(
    edges: DataFrame, seeds: Column, budget: float, weight: str = "weight", first_only: bool = False
) -> DataFrame:
    """Paths that grow edge by edge until their total first exceeds ``budget``.

    Such a path leaves with its end vertex; the others go on until none is
    left, which positive weights ensure. With ``first_only`` the search ends after
    the first round in which any path leaves. Seed paths themselves are not tested.
    """
    steps = _checked(edges, weight)
    active = seed_paths(steps, seeds)
    done: list[DataFrame] = []
    for hop in _hops(_hop_guard(steps, budget)):
        grown = materialize(_extended(active, steps), f"paths-{hop}")
        over = grown.where(F.col("total") > budget)
        done.append(over)
        if first_only and not over.isEmpty():
            break
        active = grown.where(F.col("total") <= budget)
        if active.isEmpty():
            break
    return reduce(DataFrame.unionByName, done)


class PathStates:
    """All paths of :func:`expand_paths` as states (edges so far, vertex, total), each with the number of paths that meet in it.

    Weights and budget are held in whole steps, by default minutes of hours, one at least. Paths that meet at one vertex with one total
    after as many edges have the same future, so they go on as one row: never more than vertices times budget rows a round,
    however many paths there are. The states and the edges are the table of predecessors: a state came over an edge from the
    state of its start with the weight taken off. So paths are counted without being listed, and listed for chosen ends only.
    """

    def __init__(self, edges: DataFrame, seeds: Column, budget: float, weight: str = "weight", steps_per_unit: int = 60):
        spark = edges.sparkSession
        whole = F.greatest(F.lit(1), F.floor(F.col("weight") * F.lit(float(steps_per_unit)) + 0.5)).cast("long")
        self.steps = materialize(_checked(edges, weight).select("src", "dst", whole.alias("weight")), "whole-edges")
        self.limit = int(budget * steps_per_unit)
        self.seeds = self.steps.where(seeds)
        states = self.seeds.groupBy("dst", F.col("weight").alias("total")).agg(F.count(F.lit(1)).cast("decimal(38,0)").alias("n"))
        states = states.select(F.lit(0).alias("hop"), "dst", "total", "n")
        paths = []
        step = self.steps.select(F.col("src").alias("_at"), F.col("dst").alias("_to"), F.col("weight").alias("_w"))
        for hop in count():
            path = scratch_path(spark, f"states-{hop}")
            states.write.parquet(path)
            paths.append(path)
            held = spark.read.schema(states.schema).parquet(path)
            active = held if hop == 0 else held.where(F.col("total") <= self.limit)
            if active.isEmpty():
                break
            met = active.join(step, F.col("dst") == F.col("_at"))
            grown = met.groupBy(F.col("_to").alias("dst"), (F.col("total") + F.col("_w")).alias("total"))
            states = grown.agg(F.sum("n").cast("decimal(38,0)").alias("n")).select(F.lit(hop + 1).alias("hop"), "dst", "total", "n")
        # one scan over the rounds, however many
        self.states = spark.read.schema(states.schema).parquet(*paths)

    def finished(self) -> DataFrame:
        """The states in which paths end: beyond the budget, seeds themselves not tested."""
        return self.states.where((F.col("hop") > 0) & (F.col("total") > self.limit))

    def counts(self) -> DataFrame:
        """(dst, n_paths): how many paths end at each vertex."""
        return self.finished().groupBy("dst").agg(F.sum("n").alias("n_paths"))

    def to(self, ends: DataFrame) -> DataFrame:
        """(src, dst, path, total in steps) of the paths that end at the vertices ``ends`` (dst), found from their ends."""
        goal = self.finished().join(ends.select("dst").distinct(), "dst", "left_semi")
        open_ = goal.select("hop", F.col("dst").alias("at"), F.col("total").alias("left"), "dst", "total", F.array("dst").alias("path"))
        through = self.states.where((F.col("hop") == 0) | (F.col("total") <= self.limit)).select(
            F.col("hop").alias("_hop"), F.col("dst").alias("_from"), F.col("total").alias("_left")
        )
        done: list[DataFrame] = []
        while True:
            back = open_.join(self.steps.select("src", F.col("dst").alias("_dst"), F.col("weight").alias("_w")), F.col("at") == F.col("_dst"))
            before = (F.col("hop") - 1 == F.col("_hop")) & (F.col("src") == F.col("_from")) & (F.col("left") - F.col("_w") == F.col("_left"))
            kept = back.join(through, before).select(
                F.col("_hop").alias("hop"), F.col("_from").alias("at"), F.col("_left").alias("left"), "dst", "total",
                F.concat(F.array("_from"), "path").alias("path"),
            )
            kept = materialize(kept, "ways-back")
            first = kept.where("hop = 0").join(
                self.seeds.select("src", F.col("dst").alias("_dst"), F.col("weight").alias("_w")),
                (F.col("at") == F.col("_dst")) & (F.col("left") == F.col("_w")),
            )
            done.append(first.select("src", "dst", F.concat(F.array("src"), "path").alias("path"), "total"))
            open_ = kept.where("hop > 0")
            if open_.isEmpty():
                return reduce(DataFrame.unionByName, done)


def reached_ends(
    edges: DataFrame, seeds: Column, budget: float, weight: str = "weight", steps_per_unit: int = 60
) -> DataFrame:
    """Distinct end vertices of :func:`expand_paths`, without listing the paths.

    Weights and budget are held in whole steps, by default minutes of hours, one
    at least. Paths that meet at one vertex with one total have the same future, so
    one copy is kept per round: never more than vertices times budget steps.
    """
    whole = F.greatest(F.lit(1), F.floor(F.col("weight") * F.lit(float(steps_per_unit)) + 0.5)).cast("long")
    steps = materialize(_checked(edges, weight).select("src", "dst", whole.alias("weight")), "whole-edges")
    limit = int(budget * steps_per_unit)
    states = steps.where(seeds).select("dst", F.col("weight").alias("total")).distinct()
    done: list[DataFrame] = []
    for hop in _hops(_hop_guard(steps, limit)):
        nxt = steps.select(F.col("src").alias("_at"), F.col("dst").alias("_to"), "weight")
        grown = materialize(
            states.join(nxt, states["dst"] == nxt["_at"])
            .select(F.col("_to").alias("dst"), (F.col("total") + F.col("weight")).alias("total"))
            .distinct(),
            f"ends-{hop}",
        )
        done.append(grown.where(F.col("total") > limit).select("dst"))
        states = grown.where(F.col("total") <= limit)
        if states.isEmpty():
            break
    return reduce(DataFrame.unionByName, done).distinct()
