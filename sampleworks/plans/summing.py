"""Queries of import summaries: orders as pictures, their items as boxes, order status as split."""

from __future__ import annotations

from pyspark.sql import functions as F

from sampleworks.operators import summaries
from sampleworks.plans.register import query, table

_IMAGES = "(SELECT o_orderstatus AS split, o_orderkey AS id, (100 * (o_custkey % 9))::int AS width, CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE (o_custkey % 4)::int END AS height FROM orders)"
_BOXES = "(SELECT o_orderstatus AS split, l_orderkey AS image_id, l_partkey % 7 AS category_id, CASE WHEN l_partkey % 13 = 0 THEN 'NaN'::double ELSE l_quantity END AS w, (l_suppkey % 50)::double * 9 AS h FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 10)"
_SIDE = "CASE WHEN isfinite(w) AND w > 0 AND h > 0 THEN sqrt(w * h) END"


def _images(spark, sf_dir):
    c = F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("split"), F.col("o_orderkey").alias("id"), (100 * (c % 9)).cast("int").alias("width"), F.when(c % 11 != 0, (c % 4).cast("int")).alias("height"))


def _boxes(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").filter("l_quantity > 10")
    splits = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("split"))
    w = F.when(F.col("l_partkey") % 13 == 0, F.lit(float("nan"))).otherwise(F.col("l_quantity").cast("double"))
    return items.join(splits, "l_orderkey").select("split", F.col("l_orderkey").alias("image_id"), (F.col("l_partkey") % 7).alias("category_id"), w.alias("w"), ((F.col("l_suppkey") % 50).cast("double") * 9).alias("h"))


_NEAREST = "list_sort(list({0}))[round_even({1} * (count({0}) - 1), 0)::int + 1]"


@query(
    "import_summary",
    f"""WITH i AS (SELECT * FROM {_IMAGES}), b AS (SELECT *, {_SIDE} AS side FROM {_BOXES}), n AS (SELECT i.*, coalesce(k, 0) AS n FROM i LEFT JOIN (SELECT image_id, count(*) AS k FROM b GROUP BY 1) ON id = image_id),
        s AS (SELECT split, round_even({_NEAREST.format('side', 0.5)}, 1) AS median_side FROM b WHERE side IS NOT NULL GROUP BY 1)
        SELECT n.split, count(*) AS images, sum(n)::bigint AS boxes, round_even(sum(n)::double / count(*), 2) AS mean_boxes, {_NEAREST.format('n', 0.5)} AS median_boxes, {_NEAREST.format('n', 0.9)} AS p90_boxes, max(n) AS max_boxes,
        any_value(median_side) AS median_side, (SELECT count(*) FROM (SELECT DISTINCT width, height FROM i j WHERE j.split = n.split)) AS sizes FROM n LEFT JOIN s ON s.split = n.split GROUP BY 1""",
)
def import_summary(spark, sf_dir):
    return summaries.import_summary(_images(spark, sf_dir), _boxes(spark, sf_dir))


@query(
    "side_histogram",
    f"""WITH b AS (SELECT split, {_SIDE} AS side FROM {_BOXES}), e AS (SELECT unnest([0.0, 8, 16, 32, 64, 128, 256])::double AS low, unnest([8.0, 16, 32, 64, 128, 256, NULL])::double AS high)
        SELECT s.split, low, high, count(side) AS boxes FROM (SELECT DISTINCT split FROM b) s CROSS JOIN e LEFT JOIN b ON b.split = s.split AND side >= low AND (high IS NULL OR side < high) GROUP BY ALL""",
)
def side_histogram(spark, sf_dir):
    return summaries.side_histogram(_boxes(spark, sf_dir))


@query(
    "top_sizes",
    f"""SELECT * FROM (SELECT split, width, height, count(*) AS images, row_number() OVER (PARTITION BY split ORDER BY count(*) DESC, width NULLS FIRST, height NULLS FIRST) AS place FROM {_IMAGES} GROUP BY 1, 2, 3) WHERE place <= 6""",
)
def top_sizes(spark, sf_dir):
    return summaries.top_sizes(_images(spark, sf_dir))


@query(
    "class_usage",
    f"""SELECT n_nationkey AS id, n_name AS name, count(*) FILTER (split = 'F') AS "F", count(*) FILTER (split = 'O') AS "O", count(*) FILTER (split = 'P') AS "P" FROM nation LEFT JOIN {_BOXES} ON category_id = n_nationkey GROUP BY 1, 2""",
)
def class_usage(spark, sf_dir):
    classes = table(spark, sf_dir, "nation").select(F.lit("F").alias("split"), F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    later = classes.select(F.lit("O").alias("split"), "id", F.lit("another name").alias("name"))
    return summaries.class_usage(classes.union(later), _boxes(spark, sf_dir))
