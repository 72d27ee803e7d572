"""Source and sink queries: text that Spark writes from the shared tables and reads back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagtrail import schemas
from tagtrail.functions.text import field
from tagtrail.plans import bindings as b
from tagtrail.plans.registry import query
from tagtrail.session import qualified, scratch_path
from tagtrail.sources import sinks, text


def written_lines(t, df, label: str, sep: str) -> str:
    """A text file of delimited lines without header, made from ``df``."""
    path = scratch_path(t.spark, label)
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]
    sinks.write_text(df.select(F.concat_ws(sep, *fields).alias("line")), path, "line")
    return path


@query("read_comma_positional", f"WITH {b.VISITS} SELECT tag, plaza, entry_lane, exit_lane, time FROM visits")
def _comma(t):
    path = written_lines(t, b.visits(t), "visits", ",")
    return text.read_delimited(t.spark, path, schemas.TAG_PLAZA_LANES).withColumn("tag", F.col("tag").cast("bigint"))


_RATED = """SELECT CAST(o_custkey AS INTEGER) AS user, CAST(o_orderkey % 1000 AS INTEGER) AS item,
    o_totalprice AS rating, o_orderkey AS ts FROM orders"""


def _rated(t):
    return t.orders.select("o_custkey", F.col("o_orderkey") % 1000, "o_totalprice", "o_orderkey").toDF(
        "user", "item", "rating", "ts"
    )


@query("read_tab_ratings", _RATED)
def _tab(t):
    return text.read_delimited(t.spark, written_lines(t, _rated(t), "ratings", "\t"), schemas.RATINGS, "\t")


@query("read_two_character_delimiter", _RATED)
def _double_colon(t):
    return text.read_delimited(t.spark, written_lines(t, _rated(t), "ratings", "::"), schemas.RATINGS, "::")


@query("read_pipe_dimension", "SELECT CAST(p_partkey AS INTEGER) AS item, p_name AS title FROM part")
def _pipe(t):
    rows = t.part.select("p_partkey", "p_name", "p_brand", "p_type")
    path = written_lines(t, rows, "items", "|")
    return text.read_delimited(t.spark, path, schemas.ITEMS + ", brand string, kind string", "|").select("item", "title")


@query("read_headered_strings", "SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name FROM supplier")
def _headered(t):
    path = scratch_path(t.spark, "suppliers")
    sinks.write_csv(t.supplier.select("s_suppkey", "s_name"), path)
    return text.read_headered_strings(t.spark, path)


@query(
    "read_ragged",
    """SELECT CAST(o_custkey AS VARCHAR) AS tag, o_orderstatus AS vehicle_number,
        CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS state FROM orders WHERE o_orderkey % 3 <> 1""",
)
def _ragged(t):
    order = F.col("o_orderkey") % 3
    line = (
        F.when(order == 0, F.concat_ws(",", "o_custkey", "o_orderstatus", "o_orderpriority"))
        .when(order == 2, F.concat_ws(",", "o_custkey", "o_orderstatus"))
        .otherwise(F.col("o_custkey").cast("string"))
    )
    path = scratch_path(t.spark, "ragged")
    sinks.write_text(t.orders.select(line.alias("line")), path, "line")
    return text.read_ragged(t.spark, path, schemas.TAG_VEHICLE, 2)


@query(
    "read_quoted_names",
    "SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey % 5 <> 0",
)
def _quoted(t):
    key, quote = F.col("c_custkey").cast("string"), F.lit('"')
    line = F.when(F.col("c_custkey") % 5 != 0, F.concat(key, F.lit(" "), quote, "c_name", quote)).otherwise(key)
    path = scratch_path(t.spark, "names")
    sinks.write_text(t.customer.select(line.alias("line")), path, "line")
    return text.read_quoted_names(t.spark, path)


@query(
    "read_adjacency",
    "SELECT l_orderkey AS src, l_partkey AS dst FROM lineitem UNION ALL SELECT l_orderkey, l_suppkey FROM lineitem",
)
def _adjacency(t):
    path = written_lines(t, t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey"), "adjacency", " ")
    return text.read_adjacency(t.spark, path)


@query(
    "read_labelled_points",
    "SELECT l_extendedprice AS label, l_quantity AS x, l_discount AS y FROM lineitem",
)
def _labelled(t):
    inner = F.concat(F.lit("["), F.concat_ws(",", "l_quantity", "l_discount"), F.lit("]"))
    line = F.concat(F.lit("("), F.col("l_extendedprice").cast("string"), F.lit(","), inner, F.lit(")"))
    path = scratch_path(t.spark, "points")
    sinks.write_text(t.lineitem.select(line.alias("line")), path, "line")
    points = text.read_labelled_points(t.spark, path)
    return points.select("label", F.get("features", 0).alias("x"), F.get("features", 1).alias("y"))


@query(
    "join_in_memory_relation",
    f"""WITH {b.STATE_CODE} SELECT code, count(*) AS n FROM orders JOIN state_code ON o_orderpriority = state
    GROUP BY code""",
)
def _in_memory(t):
    joined = t.orders.join(b.state_code(t), F.col("o_orderpriority") == F.col("state"))
    return joined.groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query(
    "typed_rows_from_text",
    """SELECT CAST(c_custkey AS INTEGER) AS id, c_name AS name, c_nationkey AS age,
        CAST(c_custkey % 100 AS INTEGER) AS num_friends FROM customer WHERE c_nationkey < 21""",
)
def _typed(t):
    rows = t.customer.select("c_custkey", "c_name", "c_nationkey", F.col("c_custkey") % 100)
    lines = text.read_lines(t.spark, written_lines(t, rows, "people", ","))
    names = ["id", "name", "age", "num_friends"]
    fields = [field("line", ",", i) for i in range(4)]
    kinds = ["int", "string", "int", "int"]
    typed = lines.select(*[f.cast(k).alias(n) for f, k, n in zip(fields, kinds, names)])
    return typed.where(F.col("age") < 21)


@query("read_by_uri", "SELECT n_nationkey AS item, n_name AS title FROM nation")
def _uri(t):
    path = written_lines(t, t.nation.select("n_nationkey", "n_name"), "nations", ",")
    return text.read_delimited(t.spark, qualified(t.spark, path), schemas.ITEMS)


@query("write_single_csv", "SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name, 1 AS files FROM supplier")
def _single_csv(t):
    path = scratch_path(t.spark, "single")
    rows = t.supplier.select("s_suppkey", "s_name")
    sinks.write_csv(rows, path)
    sinks.write_csv(rows, path, single_file=True)  # takes the place of the first
    back = text.read_headered_strings(t.spark, path)
    seen = back.select(F.input_file_name().alias("file")).distinct()
    files = seen.agg(F.count(F.lit(1)).cast("int")).scalar()
    return back.withColumn("files", files)


@query("write_new_csv", "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus FROM orders")
def _new_csv(t):
    path = scratch_path(t.spark, "new")
    sinks.write_csv(t.orders.select("o_orderkey", "o_orderstatus"), path, overwrite=False)
    return text.read_headered_strings(t.spark, path)


@query("write_text", "SELECT p_name AS line, count(*) AS n FROM part GROUP BY 1")
def _text(t):
    path = scratch_path(t.spark, "text")
    sinks.write_text(t.part, path, "p_name")
    return text.read_lines(t.spark, path).groupBy("line").agg(F.count(F.lit(1)).alias("n"))
