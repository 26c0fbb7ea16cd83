"""Queries of calculated columns and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from sampleworks.functions import filters
from sampleworks.functions.calculations import Calculation, calculate
from sampleworks.plans.register import query, table

X, Y = "o_totalprice", "o_custkey"
#: operation: (inputs, SQL of the value)
ROW = {
    "add": ([X, Y], "o_totalprice + o_custkey"),
    "subtract": ([X, Y], "o_totalprice - o_custkey"),
    "multiply": ([X, Y], "o_totalprice * o_custkey"),
    "divide": ([X, Y], "CASE WHEN o_custkey = 0 THEN NULL ELSE o_totalprice / o_custkey END"),
    "power": (["o_small", "o_small"], "power(o_small, o_small)"),
    "abs": (["o_signed"], "abs(o_signed)"),
    "negate": ([X], "-o_totalprice"),
    "sqrt": (["o_signed"], "CASE WHEN o_signed < 0 THEN NULL ELSE sqrt(o_signed) END"),
    "log": (["o_signed"], "CASE WHEN o_signed <= 0 THEN NULL ELSE ln(o_signed) END"),
    "round": (["o_signed"], "floor(o_signed + 0.5)"),
    "floor": (["o_signed"], "floor(o_signed)"),
    "ceil": (["o_signed"], "ceil(o_signed)"),
    "sum": ([X, Y, "o_signed"], "o_totalprice + o_custkey + o_signed"),
    "mean": ([X, Y], "(o_totalprice + o_custkey) / 2"),
    "min": ([X, Y], "least(o_totalprice, o_custkey)"),
    "max": ([X, Y], "greatest(o_totalprice, o_custkey)"),
    "greater": ([X, Y], "o_totalprice > o_custkey"),
    "less": ([X, Y], "o_totalprice < o_custkey"),
    "equal": (["o_orderstatus", "o_letter"], "o_orderstatus = o_letter"),
    "length": (["o_orderpriority"], "length(o_orderpriority)"),
}
W, WO = "OVER (PARTITION BY o_custkey)", "OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)"
GROUP = {
    "rank": "rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_custkey, o_totalprice) - 1) / 2.0",
    "occurrence": "count(*) OVER (PARTITION BY o_custkey, o_orderstatus)",
    "group_sum": f"sum(o_totalprice) {W}",
    "group_mean": f"avg(o_totalprice) {W}",
    "group_min": f"min(o_totalprice) {W}",
    "group_max": f"max(o_totalprice) {W}",
    "group_count": f"count(*) {W}",
    "group_std": f"stddev_pop(o_totalprice) {W}",
    "previous": f"lag(o_totalprice) {WO}",
    "next": f"lead(o_totalprice) {WO}",
    "difference": f"o_totalprice - lag(o_totalprice) {WO}",
    "cumulative_sum": f"sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey ROWS UNBOUNDED PRECEDING)",
    "standardize": f"CASE WHEN stddev_pop(o_totalprice) {W} = 0 THEN 0 ELSE (o_totalprice - avg(o_totalprice) {W}) / stddev_pop(o_totalprice) {W} END",
}
BOOLEAN, WHOLE = ("greater", "less", "equal"), ("length", "occurrence", "group_count")


def _orders(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    return orders.withColumns({"o_small": (F.col("o_orderkey") % 7).cast("double"), "o_signed": F.col("o_totalprice") - 100_000, "o_letter": F.substring("o_orderpriority", 3, 1)})


_ORDERS = "(SELECT *, (o_orderkey % 7)::double AS o_small, o_totalprice - 100000 AS o_signed, substr(o_orderpriority, 3, 1) AS o_letter FROM orders)"


def _register(op: str, inputs: list[str], value: str) -> None:
    kind = "boolean" if op in BOOLEAN else "bigint" if op in WHOLE else "double"
    shown = f"({value})::{kind}" if kind != "double" else f"round(({value})::double, 4)"

    @query(f"calc_{op}", f"SELECT o_orderkey, {shown} AS value FROM {_ORDERS}")
    def run(spark, sf_dir):
        spec = Calculation("value", op, inputs, group="o_custkey", order="o_totalprice")
        df = calculate(_orders(spark, sf_dir), [spec], row="o_orderkey")
        return df.select("o_orderkey", (F.col("value").cast(kind) if kind != "double" else F.round(F.col("value").cast("double"), 4)).alias("value"))


for _op, (_inputs, _value) in ROW.items():
    _register(_op, _inputs, _value)
for _op, _value in GROUP.items():
    _register(_op, [] if _op == "group_count" else ["o_orderstatus"] if _op == "occurrence" else [X], _value)


def _vector_pairs(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "embedding").join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")


_PAIRS = "embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"
for _op, _value in {"distance": "list_distance(a.embedding::double[], b.embedding::double[])", "dot": "list_dot_product(a.embedding::double[], b.embedding::double[])"}.items():

    @query(f"calc_{_op}", f"SELECT a.vec_id, round({_value}, 5) AS value FROM {_PAIRS}")
    def _vectors(spark, sf_dir, op=_op):
        df = calculate(_vector_pairs(spark, sf_dir), [Calculation("value", op, ["embedding", "other"])])
        return df.select("vec_id", F.round("value", 5).alias("value"))


@query("calc_vector_norm", "SELECT vec_id, round(sqrt(list_dot_product(embedding::double[], embedding::double[])), 5) AS value FROM embeddings")
def calc_vector_norm(spark, sf_dir):
    df = calculate(table(spark, sf_dir, "embeddings"), [Calculation("value", "length", ["embedding"])])
    return df.select("vec_id", F.round("value", 5).alias("value"))


@query("filter_numeric", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 20")
def filter_numeric(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    return df.filter(filters.numeric_range(F.col("l_quantity"), 10, 20)).select("l_orderkey", "l_linenumber", "l_quantity")


@query("filter_numeric_inverted", "SELECT event_id, value FROM events WHERE value IS NOT NULL AND NOT isnan(value) AND NOT value BETWEEN 5 AND 50")
def filter_numeric_inverted(spark, sf_dir):
    return table(spark, sf_dir, "events").filter(filters.numeric_range(F.col("value"), 5, 50, inverted=True)).select("event_id", "value")


@query("filter_categorical", "SELECT event_id, event_type FROM events WHERE event_type IS NULL OR event_type NOT IN ('click', 'error')")
def filter_categorical(spark, sf_dir):
    return table(spark, sf_dir, "events").filter(filters.excluding(F.col("event_type"), ["click", "error"])).select("event_id", "event_type")


@query(
    "filter_boolean_null",
    "SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE coalesce(l.toxic = 1, false) = false",
)
def filter_boolean_null(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.col("toxic") == 1).alias("toxic"))
    df = table(spark, sf_dir, "documents").select("doc_id").join(labels, "doc_id", "left")
    return df.filter(filters.boolean_is(F.col("toxic"), False)).select("doc_id")


@query(
    "filter_fields_missing",
    "SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE coalesce(l.quality IN (1), true) AND contains(lower(d.source), 'src1')",
)
def filter_fields_missing(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return df.filter(filters.field_values(F.col("quality"), [1], without_value=True) & filters.field_contains(F.col("source"), "SRC1", without_value=False)).select("doc_id")


_SQUARE = [(5.0, 900.0), (40.0, 900.0), (40.0, 1500.0), (5.0, 1500.0)]
_CONCAVE = [(10.0, 1000.0), (30.0, 1000.0), (20.0, 1150.0), (30.0, 1400.0), (10.0, 1400.0)]


def _polygon_sql(points) -> str:
    parts = []
    for (x1, y1), (x2, y2) in zip(points, [*points[-1:], *points[:-1]]):
        if y1 != y2:
            parts.append(f"(CASE WHEN ({y1} > p_retailprice) <> ({y2} > p_retailprice) AND p_size < ({x2} - {x1}) / ({y2} - {y1}) * (p_retailprice - {y1}) + {x1} THEN 1 ELSE 0 END)")
    return f"(({' + '.join(parts)}) % 2 = 1)"


@query("filter_region_lasso", f"SELECT p_partkey FROM part WHERE {_polygon_sql(_SQUARE)} AND NOT {_polygon_sql(_CONCAVE)}")
def filter_region_lasso(spark, sf_dir):
    strokes = [filters.Stroke(_SQUARE), filters.Stroke(_CONCAVE, subtract=True)]
    return table(spark, sf_dir, "part").filter(filters.in_regions(F.col("p_size").cast("double"), F.col("p_retailprice"), strokes)).select("p_partkey")
