"""Graph and regression queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagtrail.operators import graph, regression
from tagtrail.plans import bindings as b
from tagtrail.plans.registry import query
from tagtrail.sources.text import in_memory

_GRAPH = f"{b.SUPPLY_EDGES}, {b.SUPPLY_NAMES}"
_VERTICES = """vertices AS (
    SELECT id, coalesce(min(name), 'Nobody') AS name FROM (
        SELECT src AS id, NULL AS name FROM supply_edges UNION ALL SELECT dst, NULL FROM supply_edges
        UNION ALL SELECT id, name FROM supply_names) GROUP BY id)"""


@query("graph_vertices", f"WITH {_GRAPH}, {_VERTICES} SELECT id, name FROM vertices")
def _vertices(t):
    return graph.graph_vertices(b.supply_edges(t), b.supply_names(t))


_DEGREES = "degrees AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM supply_edges UNION ALL SELECT dst FROM supply_edges) GROUP BY 1)"


@query("degrees", f"WITH {_GRAPH}, {_DEGREES} SELECT * FROM degrees")
def _degrees(t):
    return graph.degrees(b.supply_edges(t))


@query(
    "top_degrees",
    f"""WITH {_GRAPH}, {_DEGREES} SELECT id, degree, name FROM degrees JOIN supply_names USING (id)
    ORDER BY degree DESC, id LIMIT 10""",
)
def _top_degrees(t):
    return graph.top_degrees(b.supply_edges(t), b.supply_names(t))


_BFS = f"""WITH RECURSIVE {_GRAPH}, {b.BUSIEST}, nearest(id, hops) USING KEY (id) AS (
        SELECT id, 0 FROM busiest
        UNION
        SELECT e.dst, min(n.hops) + 1 FROM nearest n JOIN supply_edges e ON n.id = e.src
        LEFT JOIN recurring.nearest known ON known.id = e.dst WHERE known.id IS NULL GROUP BY e.dst)"""


@query(
    "hop_distance",
    f"""{_BFS}, {_VERTICES}
    SELECT v.id, v.name, coalesce(CAST(hops AS DOUBLE), CAST('infinity' AS DOUBLE)) AS hops
    FROM vertices v LEFT JOIN nearest n ON v.id = n.id""",
)
def _hops(t):
    edges = b.supply_edges(t)
    return graph.hop_distance(edges, b.busiest(edges), b.supply_names(t))


def _target(t):
    """The supplier with the largest id that is on an edge."""
    edges = b.supply_edges(t)
    return edges.where(F.col("src") % 2 == 1).agg(F.max("src").alias("id"))


@query(
    "degrees_of_separation",
    f"""{_BFS}, target AS (SELECT max(src) AS id FROM supply_edges WHERE src % 2 = 1),
    met AS (SELECT hops FROM nearest WHERE id = (SELECT id FROM target))
    SELECT CAST(max(met.hops) AS INTEGER) AS hops, count(*) AS hits
    FROM met JOIN nearest n ON n.hops = met.hops - 1 JOIN supply_edges e ON e.src = n.id
    WHERE e.dst = (SELECT id FROM target) HAVING count(*) > 0""",
)
def _separation(t):
    edges = b.supply_edges(t)
    return graph.degrees_of_separation(edges, b.busiest(edges), _target(t))


BUDGET = 40.0


def _walk(test: str) -> str:
    return f"""WITH RECURSIVE {b.MOVE_EDGES}, walk AS (
        SELECT src, dst, [src, dst] AS path, weight AS total, 0 AS hop FROM move_edges WHERE src = '{b.PLACE}'
        UNION ALL
        SELECT w.src, e.dst, list_append(w.path, e.dst), w.total + e.weight, hop + 1
        FROM walk w JOIN move_edges e ON w.dst = e.src
        WHERE hop = 0 OR w.total <= {BUDGET}),
    done AS (SELECT * FROM walk WHERE hop > 0 AND total > {BUDGET})
    SELECT src, dst, array_to_string(path, '>') AS path, round(total, 6) AS total FROM done WHERE {test}"""


def _paths(t, first_only):
    seeds = F.col("src") == b.PLACE
    paths = graph.expand_paths(b.move_edges(t), seeds, BUDGET, first_only=first_only)
    return paths.select("src", "dst", F.array_join("path", ">").alias("path"), F.round("total", 6).alias("total"))


@query("expand_paths_all", _walk("true"))
def _expand_all(t):
    return _paths(t, False)


@query("expand_paths_first_crossing", _walk("hop = (SELECT min(hop) FROM done)"))
def _expand_first(t):
    return _paths(t, True)


_WHOLE_WALK = f"""WITH RECURSIVE {b.MOVE_EDGES}, whole AS (
        SELECT src, dst, greatest(1, CAST(floor(weight * 60.0::DOUBLE + 0.5) AS BIGINT)) AS w FROM move_edges),
    walk AS (
        SELECT src, dst, [src, dst] AS path, w AS total, 0 AS hop FROM whole WHERE src = '{b.PLACE}'
        UNION ALL
        SELECT k.src, e.dst, list_append(k.path, e.dst), k.total + e.w, hop + 1
        FROM walk k JOIN whole e ON k.dst = e.src WHERE hop = 0 OR k.total <= {int(BUDGET * 60)}),
    done AS (SELECT * FROM walk WHERE hop > 0 AND total > {int(BUDGET * 60)})"""


def _states(t):
    return graph.PathStates(b.move_edges(t), F.col("src") == b.PLACE, BUDGET)


@query("count_paths", f"{_WHOLE_WALK} SELECT dst, count(*) AS n_paths FROM done GROUP BY 1")
def _count_paths(t):
    return _states(t).counts().withColumn("n_paths", F.col("n_paths").cast("long"))


@query(
    "paths_to_end",
    f"""{_WHOLE_WALK} SELECT src, dst, array_to_string(path, '>') AS path, total FROM done
    WHERE dst = (SELECT min(dst) FROM done)""",
)
def _paths_to_end(t):
    states = _states(t)
    ends = states.finished().agg(F.min("dst").alias("dst"))
    return states.to(ends).withColumn("path", F.array_join("path", ">"))


@query(
    "seed_paths_by_prefix",
    f"""WITH {b.MOVE_EDGES} SELECT src, dst, src || '>' || dst AS path, weight AS total
    FROM move_edges WHERE substr(src, 1, 1) = 's'""",
)
def _seeds(t):
    seeds = graph.seed_paths(b.move_edges(t), F.substring("src", 1, 1) == "s")
    return seeds.withColumn("path", F.array_join("path", ">"))


_SCALED = """s AS (
    SELECT l_orderkey, l_linenumber,
           (l_quantity - min(l_quantity) OVER ()) * 2.0::DOUBLE / (max(l_quantity) OVER () - min(l_quantity) OVER ())
               - 1.0::DOUBLE AS x,
           (l_extendedprice - min(l_extendedprice) OVER ()) * 2.0::DOUBLE
               / (max(l_extendedprice) OVER () - min(l_extendedprice) OVER ()) - 1.0::DOUBLE AS y
    FROM lineitem),
    w AS (SELECT avg(x * y) / (avg(x * x) + 0.01::DOUBLE) AS coefficient FROM s)"""


def _points(t):
    lines = regression.scaled(t.lineitem, {"x": "l_quantity", "y": "l_extendedprice"})
    return lines.select("l_orderkey", "l_linenumber", "x", "y")


@query(
    "linear_regression",
    f"WITH {_SCALED} SELECT 'x' AS feature, round(coefficient, 6) AS coefficient FROM w",
)
def _regression(t):
    model = regression.fit_linear(_points(t), ["x"], "y")
    rows = [("x", float(model.coefficients[0]))]
    return in_memory(t.spark, rows, "feature string, coefficient double").withColumn(
        "coefficient", F.round("coefficient", 6)
    )


@query(
    "regression_predictions",
    f"""WITH {_SCALED} SELECT l_orderkey, l_linenumber, round(y, 6) AS label, round(x * coefficient, 6) AS prediction
    FROM s, w""",
)
def _predictions(t):
    points = _points(t)
    model = regression.fit_linear(points, ["x"], "y")
    return regression.predict(model, points, ["x"]).select(
        "l_orderkey",
        "l_linenumber",
        F.round("y", 6).alias("label"),
        F.round("prediction", 6).alias("prediction"),
    )
