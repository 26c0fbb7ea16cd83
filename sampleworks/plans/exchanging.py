"""Queries of exchange formats and runs: documents as text, folders, aliases, cells, metrics tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sampleworks.plans.register import query, table
from sampleworks.sources import exchange, runs
from sampleworks.sources.tables import shared_folder
from sampleworks.streaming import live

_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
_I = "(SELECT l_orderkey AS image, (l_partkey % 97)::double AS x0, (l_suppkey % 89)::double AS y0, (l_partkey % 97 + l_quantity)::double AS x1, (l_suppkey % 89 + 10 * l_linenumber)::double AS y1, (l_partkey % 5)::int AS label, l_suppkey % 6 = 0 AS crowd, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n FROM lineitem)"
_NAME = "CASE label WHEN 0 THEN 'big cat' WHEN 1 THEN 'dog' WHEN 2 THEN 'hen' WHEN 3 THEN 'cow' ELSE '4' END"


def _rows(spark, sf_dir):
    """Each order as a picture of 200 by 100 with its lineitems as boxes; class 4 has no name."""
    d = lambda c: F.col(c).cast("double")
    x0, y0 = d("l_partkey") % 97, d("l_suppkey") % 89
    box = F.struct(x0.alias("x0"), y0.alias("y0"), (x0 + F.col("l_quantity")).alias("x1"), (y0 + 10 * d("l_linenumber")).alias("y1"), (F.col("l_partkey") % 5).cast("int").alias("label"), (F.col("l_suppkey") % 6 == 0).cast("int").alias("iscrowd"))
    grouped = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("_row")).agg(F.transform(F.sort_array(F.collect_list(F.struct(*_ORDER, box.alias("b")))), lambda r: r["b"]).alias("instances"))
    name = F.concat(F.lit("img"), F.col("_row").cast("string"), F.lit(".png"))
    rows = grouped.select("_row", name.alias("image"), name.alias("file_name"), F.lit(200.0).alias("width"), F.lit(100.0).alias("height"), "instances")
    return rows, spark.createDataFrame([(0, "big cat"), (1, "dog"), (2, "hen"), (3, "cow")], "label int, name string")


@query(
    "kitti_documents",
    f"SELECT 'img' || image || '.txt' AS name, coalesce(string_agg({_NAME.replace('big cat', 'big_cat')} || printf(' 0.00 0 0.00 %.2f %.2f %.2f %.2f 0.00 0.00 0.00 0.00 0.00 0.00 0.00', x0, y0, x1, y1) || chr(10), '' ORDER BY n) FILTER (NOT crowd), '') AS value FROM {_I} GROUP BY image",
)
def kitti_documents(spark, sf_dir):
    return exchange.kitti_documents(*_rows(spark, sf_dir))


@query("folder_of_class", f"SELECT 'img' || image || '.png' AS image, coalesce(replace(arg_max({_NAME}, (x1 - x0) * (y1 - y0) * 1000 - n) FILTER (NOT crowd), ' ', '_'), 'unlabelled') AS folder FROM {_I} GROUP BY 1")
def folder_of_class(spark, sf_dir):
    return exchange.folder_of(*_rows(spark, sf_dir)).select("image", "folder")


@query("coco_annotations", f"SELECT label + 1 AS category_id, count(*) AS n, round(sum((x1 - x0) * (y1 - y0)), 2) AS area, count(*) FILTER (crowd) AS crowds FROM {_I} GROUP BY 1")
def coco_annotations(spark, sf_dir):
    boxes = exchange.to_coco(*_rows(spark, sf_dir))[1]
    return boxes.groupBy("category_id").agg(F.count("*").alias("n"), F.round(F.sum("area"), 2).alias("area"), F.count_if(F.col("iscrowd") == 1).alias("crowds"))


@query("url_aliases", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '<DEEP>/' || page_id WHEN page_id % 3 = 1 THEN '<DATA>/x/' || page_id ELSE '/other/' || page_id END AS short, CASE WHEN page_id % 3 = 0 THEN '/mnt/data/deep/' WHEN page_id % 3 = 1 THEN '/mnt/data/x/' ELSE '/other/' END || page_id AS long FROM pages")
def url_aliases(spark, sf_dir):
    known = exchange.with_alias({"DATA": "/mnt/data"}, "deep", "/mnt/data/deep")
    k = F.col("page_id")
    path = F.concat(F.when(k % 3 == 0, "/mnt/data/deep/").when(k % 3 == 1, "/mnt/data/x/").otherwise("/other/"), k.cast("string"))
    short = table(spark, sf_dir, "pages").select("page_id", exchange.contracted(path, known).alias("short"))
    return short.withColumn("long", exchange.expanded(F.col("short"), known))


@query("parsed_cells", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 3 = 1 THEN p_size::varchar END AS value, CASE WHEN p_partkey % 3 = 2 THEN 'no int' END AS error FROM part")
def parsed_cells(spark, sf_dir):
    k = F.col("p_partkey")
    typed = F.when(k % 3 == 0, "  ").when(k % 3 == 1, F.concat(F.lit(" "), F.col("p_size").cast("string"))).otherwise("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", exchange.parsed_cell(F.when(k % 3 == 2, F.lit("1.5x")).otherwise(typed), "int").alias("c")).select("p_partkey", "c.*")


@query("above_weight", "SELECT p_partkey FROM part WHERE p_partkey % 5 <> 0 AND p_size % 3 > 0")
def above_weight(spark, sf_dir):
    weight = F.when(F.col("p_partkey") % 5 > 0, (F.col("p_size") % 3).cast("double"))
    return exchange.above_weight(table(spark, sf_dir, "part").withColumn("weight", weight)).select("p_partkey")


@query(
    "run_joined",
    """WITH m AS (SELECT event_id % 2 AS _src, user_id % 100 AS example_id, date_diff('month', DATE '2019-01-01', ts::date)::int AS epoch, value AS loss, CASE WHEN event_id % 2 = 0 THEN event_id END AS extra FROM events)
        SELECT _src::int AS _src, example_id::bigint AS example_id, epoch, round(sum(loss), 4) AS loss, sum(extra)::bigint AS extra, 's' || (_src * 100 + example_id) AS sample, CASE WHEN epoch = max(epoch) OVER (PARTITION BY _src) THEN 'g' || example_id END AS geometry FROM m GROUP BY _src, example_id, epoch""",
)
def run_joined(spark, sf_dir):
    """Two metrics tables of one run, one with a column more, written, read and joined with their samples."""
    run = f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"
    e = table(spark, sf_dir, "events")
    epoch = ((F.year("ts") - 2019) * 12 + F.month("ts") - 1).alias("epoch")
    base = e.select((F.col("event_id") % 2).alias("k"), (F.col("user_id") % 100).alias("example_id"), epoch, F.col("value").alias("loss"), F.col("event_id").alias("extra"))
    for k in (0, 1):
        own = base.filter(F.col("k") == k).groupBy("example_id", "epoch").agg(F.sum("loss").alias("loss"), F.sum("extra").alias("extra"))
        runs.add_metrics(own if k == 0 else own.drop("extra"), run, constants={"source": str(k)})
    samples = {str(k): spark.range(100).select(F.col("id").alias("_row"), F.concat(F.lit("s"), (F.col("id") + 100 * k).cast("string")).alias("sample"), F.concat(F.lit("g"), F.col("id").cast("string")).alias("geometry")) for k in (0, 1)}
    joined = runs.joined_run(runs.metrics_tables(spark, run), samples, epoch="epoch", geometry=("geometry",))
    return joined.select("_src", "example_id", "epoch", F.round("loss", 4).alias("loss"), "extra", "sample", "geometry")


@query(
    "live_run",
    """WITH m AS (SELECT o_custkey % 200 AS example_id, o_orderkey % 3 AS part, o_orderkey % 2 AS s, sum(o_totalprice) AS loss, CASE WHEN o_orderkey % 3 = 1 THEN max(o_orderkey) END AS extra FROM orders GROUP BY 1, 2, 3, o_orderkey % 3)
        SELECT (part * 2 + s)::int AS metrics_id, s::varchar AS source, example_id, round(loss, 2) AS loss, extra, 's' || (s * 1000 + example_id) AS sample FROM m""",
)
def live_run(spark, sf_dir):
    """Metrics added to a run in three steps while a stream joins them to two tables of samples."""
    run, folder = (f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}" for name in ("run", "live"))
    k = F.col("o_orderkey")
    base = table(spark, sf_dir, "orders").groupBy((k % 3).alias("part"), (k % 2).alias("s"), (F.col("o_custkey") % 200).alias("example_id")).agg(F.sum("o_totalprice").alias("loss"), F.max("o_orderkey").alias("extra"))
    samples = {str(s): spark.range(200).select(F.col("id").alias("_row"), F.concat(F.lit("s"), (F.col("id") + 1000 * s).cast("string")).alias("sample")) for s in (0, 1)}
    schema = base.select("example_id", "loss", "extra", F.lit("").alias("source")).schema
    for part in range(3):
        for s in (0, 1):
            own = base.filter((F.col("part") == part) & (F.col("s") == s)).select("example_id", "loss", "extra")
            runs.add_metrics(own if part == 1 else own.drop("extra"), run, constants={"source": str(s)})
        live.live_view(spark, run, samples, schema, folder, trigger=None).awaitTermination()
    return live.live_rows(spark, folder).select("metrics_id", "source", "example_id", F.round("loss", 2).alias("loss"), "extra", "sample")


@query("merged_counts", "SELECT event_type, count(*) AS tp, sum(event_id % 3)::bigint AS fp FROM events GROUP BY 1")
def merged_counts(spark, sf_dir):
    parts = table(spark, sf_dir, "events").groupBy("event_type", (F.col("user_id") % 4).alias("worker")).agg(F.count("*").alias("tp"), F.sum(F.col("event_id") % 3).alias("fp"))
    return runs.merged_counts(parts, ["event_type"], ["tp", "fp"])


@query("upserted_metrics", "SELECT p_partkey AS example_id, p_retailprice AS loss FROM part WHERE p_partkey % 4 < 3")
def upserted_metrics(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    side = lambda rows: rows.select(F.col("p_partkey").alias("example_id"), F.col("p_retailprice").alias("loss"))
    return runs.upserted(side(p.filter("p_partkey % 4 < 2")), side(p.filter("p_partkey % 4 IN (1, 2)")).unionByName(side(p.filter("p_partkey % 8 = 2"))), ["example_id"])
