"""Queries of lineage, logs, gates, preflight, splits, keys and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from sampleworks.operators import sampling
from sampleworks.operators import versions as op
from sampleworks.plans.register import query, table


def _edges(spark, sf_dir):
    """Nations as versions: each derives from the one at half its key; every third has a second parent."""
    n = table(spark, sf_dir, "nation").filter("n_nationkey > 0")
    first = n.select(F.col("n_nationkey").cast("string").alias("child"), F.floor(F.col("n_nationkey") / 2).cast("string").alias("parent"), F.lit(0).alias("place"))
    second = n.filter("n_nationkey % 3 = 0 AND n_nationkey > 3").select(F.col("n_nationkey").cast("string").alias("child"), (F.col("n_nationkey") - 3).cast("string").alias("parent"), F.lit(1).alias("place"))
    return first.union(second)


def _catalog(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("version"), (F.col("n_nationkey") * 37 % 11).alias("created"), F.col("n_regionkey").cast("string").alias("base_name"))


_EDGES = "(SELECT n_nationkey::varchar AS child, (n_nationkey // 2)::varchar AS parent, 0 AS place FROM nation WHERE n_nationkey > 0 UNION ALL SELECT n_nationkey::varchar, (n_nationkey - 3)::varchar, 1 FROM nation WHERE n_nationkey % 3 = 0 AND n_nationkey > 3)"
_CATALOG = "(SELECT n_nationkey::varchar AS version, n_nationkey * 37 % 11 AS created, n_regionkey::varchar AS base_name FROM nation)"


@query("lineage_root", f"WITH RECURSIVE up AS (SELECT '23' AS version, 0 AS depth UNION ALL SELECT e.parent, u.depth + 1 FROM up u JOIN {_EDGES} e ON e.child = u.version AND e.place = 0) SELECT version, depth FROM up")
def lineage_root(spark, sf_dir):
    return op.lineage(spark, _edges(spark, sf_dir), "23")


@query(
    "lineage_latest",
    f"WITH RECURSIVE down AS (SELECT '2' AS version, 0 AS depth UNION ALL SELECT e.child, d.depth + 1 FROM down d JOIN {_EDGES} e ON e.parent = d.version), m AS (SELECT version, max(depth) AS depth FROM down GROUP BY 1) SELECT version FROM m JOIN {_CATALOG} USING (version) ORDER BY depth DESC, created DESC, version DESC LIMIT 1",
)
def lineage_latest(spark, sf_dir):
    return op.latest(spark, _edges(spark, sf_dir), _catalog(spark, sf_dir), "2")


@query("newest_sets", f"SELECT base_name, version FROM (SELECT *, row_number() OVER (PARTITION BY base_name ORDER BY created DESC, version DESC) AS n FROM {_CATALOG} WHERE version NOT IN (SELECT parent FROM {_EDGES})) WHERE n = 1")
def newest_sets(spark, sf_dir):
    return op.newest_sets(_catalog(spark, sf_dir), _edges(spark, sf_dir))


def _log(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "click", "reviewed").when(F.col("event_type") == "error", "rework")
    return e.select(F.col("user_id").alias("image"), F.col("event_id").alias("seq"), status.alias("status"), F.when(F.col("value") > 50, "look again").otherwise("").alias("comment"), "event_type", "value")


_LOG = "(SELECT user_id AS image, event_id AS seq, CASE event_type WHEN 'click' THEN 'reviewed' WHEN 'error' THEN 'rework' END AS status, CASE WHEN value > 50 THEN 'look again' ELSE '' END AS comment, event_type, value FROM events)"
_STATE = f"SELECT image, arg_max(status, seq) FILTER (status IS NOT NULL) AS status, count(*) FILTER (comment <> '') AS comments FROM {_LOG} GROUP BY 1"


def _state(spark, sf_dir):
    return op.current_state(_log(spark, sf_dir), "image", "seq", "status", "comment")


@query("log_current_state", _STATE)
def log_current_state(spark, sf_dir):
    return _state(spark, sf_dir)


@query("log_counts", f"SELECT coalesce(status, 'unreviewed') AS status, count(*) AS n FROM ({_STATE}) GROUP BY 1")
def log_counts(spark, sf_dir):
    return _state(spark, sf_dir).groupBy(F.coalesce("status", F.lit("unreviewed")).alias("status")).agg(F.count("*").alias("n"))


@query(
    "log_tag_fold",
    f"WITH l AS (SELECT image, event_type AS tag, arg_max(value < 20, seq) AS gone FROM {_LOG} GROUP BY 1, 2) SELECT image, array_to_string(list_sort(list(tag)), ',') AS tags FROM l WHERE NOT gone GROUP BY 1",
)
def log_tag_fold(spark, sf_dir):
    log = _log(spark, sf_dir).withColumn("gone", F.col("value") < 20)
    return op.tag_fold(log, "image", "seq", "event_type", "gone").select("image", F.array_join("tags", ",").alias("tags"))


@query("ship_gate", f"""SELECT "set", count(*) AS open FROM (SELECT DISTINCT user_id AS image, user_id % 3 AS "set" FROM events) i WHERE image NOT IN (SELECT image FROM ({_STATE}) WHERE status = 'reviewed') GROUP BY 1""")
def ship_gate(spark, sf_dir):
    images = table(spark, sf_dir, "events").select(F.col("user_id").alias("image"), (F.col("user_id") % 3).alias("set")).distinct()
    return op.ship_gate(images, _state(spark, sf_dir), "image")


@query("review_cost", "SELECT count(*) AS decisions, count(DISTINCT user_id) AS images, count(DISTINCT event_type) AS reviewers, round(count(*) * 20 / 60.0, 4) AS minutes FROM events WHERE event_id BETWEEN 100 AND 600")
def review_cost(spark, sf_dir):
    found = op.review_cost(table(spark, sf_dir, "events"), 100, 600, key="user_id", reviewer="event_type", time="event_id")
    return found.withColumn("minutes", F.round("minutes", 4))


@query(
    "category_merge",
    "SELECT id, first_value(id) OVER (PARTITION BY name ORDER BY boxes DESC, id) AS merged FROM (SELECT p_size AS id, 'Class ' || p_size % 7 AS name, count(*) AS boxes FROM part GROUP BY 1, 2)",
)
def category_merge(spark, sf_dir):
    c = table(spark, sf_dir, "part").groupBy(F.col("p_size").alias("id"), F.concat(F.lit(" CLASS "), (F.col("p_size") % 7).cast("string")).alias("name")).agg(F.count("*").alias("boxes"))
    return op.category_merge(c)


@query(
    "split_plan",
    """WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 < 6 THEN 'train' WHEN o_orderkey % 10 < 8 THEN 'valid' ELSE 'test' END AS split, (SELECT count(*) FROM orders) AS total FROM orders),
        h AS (SELECT split, count(*) AS n FROM o GROUP BY 1) SELECT target, count(*) AS n, sum(o_orderkey)::bigint AS keys FROM (
        SELECT o_orderkey, CASE WHEN split <> 'train' THEN split WHEN k <= total // 2 THEN split WHEN k - total // 2 <= greatest(0, total // 4 - (SELECT n FROM h WHERE split = 'test')) THEN 'test'
            WHEN k - total // 2 <= greatest(0, total // 4 - (SELECT n FROM h WHERE split = 'test')) + greatest(0, total // 4 - (SELECT n FROM h WHERE split = 'valid')) THEN 'valid' ELSE 'valid' END AS target
        FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY o_orderkey) AS k FROM o)) GROUP BY 1""",
)
def split_plan(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    total = o.count()
    o = o.withColumn("split", F.when(F.col("o_orderkey") % 10 < 6, "train").when(F.col("o_orderkey") % 10 < 8, "valid").otherwise("test"))
    plan = op.plan_splits(o, "split", "o_orderkey", {"train": total // 2, "valid": total // 4, "test": total // 4})
    return plan.groupBy("target").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


def _import(spark, sf_dir):
    """A dataset with faults: orders as images, lineitems as boxes, sizes as categories."""
    o = table(spark, sf_dir, "orders")
    key, split = F.col("o_orderkey"), F.when(F.col("o_orderkey") % 5 == 0, "valid").otherwise("train")
    images = o.select(split.alias("split"), key.alias("seq"), F.when(key % 97 == 0, None).when(key % 89 == 0, key - 5).otherwise(key).alias("id"), F.when(key % 83 == 0, None).otherwise(F.concat(F.lit("img"), (key % 700).cast("string"), F.lit(".jpg"))).alias("file_name"), F.lit(100.0).alias("width"), F.lit(120.0).alias("height"))
    i = table(spark, sf_dir, "lineitem")
    ok = F.col("l_orderkey")
    boxes = i.select(
        F.when(ok % 5 == 0, "valid").otherwise("train").alias("split"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("id"), F.when(F.col("l_suppkey") % 61 == 0, ok + 10_000_000).otherwise(ok).alias("image_id"), (F.col("l_partkey") % 23).alias("category_id"),
        (F.col("l_partkey") % 97).cast("double").alias("x"), (F.col("l_suppkey") % 89).cast("double").alias("y"), F.when(F.col("l_partkey") % 53 == 0, F.lit(0.0)).when(F.col("l_partkey") % 59 == 0, F.lit(-1.0)).otherwise(F.col("l_quantity")).alias("w"), (F.col("l_linenumber") * 5).cast("double").alias("h"),
    )
    p = spark.range(22).select(F.lit("train").alias("split"), F.col("id"), F.when(F.col("id") == 3, "ignore").when(F.col("id") == 4, "Other").when(F.col("id") == 21, "class 5").otherwise(F.concat(F.lit("class "), F.col("id").cast("string"))).alias("name"))
    return images, boxes, p


_I = "i AS (SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'valid' ELSE 'train' END AS split, o_orderkey AS seq, CASE WHEN o_orderkey % 97 = 0 THEN NULL WHEN o_orderkey % 89 = 0 THEN o_orderkey - 5 ELSE o_orderkey END AS id, CASE WHEN o_orderkey % 83 = 0 THEN NULL ELSE 'img' || (o_orderkey % 700) || '.jpg' END AS file_name FROM orders)"
_A = "a AS (SELECT CASE WHEN l_orderkey % 5 = 0 THEN 'valid' ELSE 'train' END AS split, l_partkey * 10 + l_linenumber AS id, CASE WHEN l_suppkey % 61 = 0 THEN l_orderkey + 10000000 ELSE l_orderkey END AS image_id, l_partkey % 23 AS category_id, (l_partkey % 97)::double AS x, (l_suppkey % 89)::double AS y, CASE WHEN l_partkey % 53 = 0 THEN 0.0 WHEN l_partkey % 59 = 0 THEN -1.0 ELSE l_quantity END AS w, (l_linenumber * 5)::double AS h FROM lineitem)"
_C = "c AS (SELECT range AS id, CASE range WHEN 3 THEN 'ignore' WHEN 4 THEN 'Other' WHEN 21 THEN 'class 5' ELSE 'class ' || range END AS name FROM range(22)), u AS (SELECT c.id, c.name, count(a.id) AS boxes FROM c LEFT JOIN a ON a.category_id = c.id GROUP BY 1, 2), k AS (SELECT DISTINCT split, id FROM i WHERE id IS NOT NULL)"
_PREFLIGHT = {
    "images.malformed": "SELECT 'block' AS severity, split, count(*) AS n FROM i WHERE id IS NULL OR file_name IS NULL GROUP BY split",
    "images.duplicate_id": "SELECT 'block' AS severity, split, sum(n - 1)::bigint AS n FROM (SELECT split, id, count(*) AS n FROM i WHERE id IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY split",
    "categories.duplicate_name": "SELECT 'warn' AS severity, 'all' AS split, count(*) AS n FROM (SELECT lower(trim(name)) FROM c GROUP BY 1 HAVING count(*) > 1) HAVING count(*) > 0",
    "categories.unused": "SELECT 'info' AS severity, 'all' AS split, count(*) AS n FROM u WHERE boxes = 0 HAVING count(*) > 0",
    "categories.ignore_region": "SELECT 'warn' AS severity, 'all' AS split, count(*) AS n FROM u WHERE lower(name) = 'ignore' AND boxes > 0 HAVING count(*) > 0",
    "categories.catch_all": "SELECT 'info' AS severity, 'all' AS split, count(*) AS n FROM u WHERE lower(name) = 'other' AND boxes > 0 HAVING count(*) > 0",
    "annotations.orphan": "SELECT 'block' AS severity, split, count(*) AS n FROM a WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.split = a.split AND k.id = a.image_id) GROUP BY split",
    "annotations.unknown_category": "SELECT 'block' AS severity, split, count(*) AS n FROM a WHERE category_id NOT IN (SELECT id FROM c) GROUP BY split",
    "annotations.invalid_bbox": "SELECT 'block' AS severity, split, count(*) AS n FROM a WHERE w < 0 OR h < 0 GROUP BY split",
    "annotations.zero_area": "SELECT 'warn' AS severity, split, count(*) AS n FROM a WHERE w >= 0 AND h >= 0 AND (w = 0 OR h = 0) GROUP BY split",
    "annotations.out_of_bounds": "SELECT 'warn' AS severity, a.split, count(*) AS n FROM a JOIN k ON k.split = a.split AND k.id = a.image_id WHERE w >= 0 AND h >= 0 AND (x < -1 OR y < -1 OR x + w > 101 OR y + h > 121) GROUP BY a.split",
    "annotations.duplicate_id": "SELECT 'warn' AS severity, split, sum(n - 1)::bigint AS n FROM (SELECT split, id, count(*) AS n FROM a GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY split",
    "annotations.tiny": "SELECT 'info' AS severity, split, count(*) AS n FROM a WHERE w > 0 AND h > 0 AND least(w, h) < 8 GROUP BY split",
    "images.unannotated": "SELECT 'info' AS severity, split, count(*) AS n FROM k WHERE NOT EXISTS (SELECT 1 FROM a WHERE k.split = a.split AND k.id = a.image_id) GROUP BY split",
    "images.export_copies": "SELECT 'info' AS severity, split, count(*) AS n FROM (SELECT split, file_name FROM i WHERE file_name IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY split",
    "split.shared_source": "SELECT 'warn' AS severity, 'all' AS split, count(*) AS n FROM (SELECT file_name FROM i WHERE file_name IS NOT NULL GROUP BY 1 HAVING count(DISTINCT split) > 1) HAVING count(*) > 0",
}


@query("preflight", f"WITH {_I}, {_A}, {_C} " + " UNION ALL ".join(f"SELECT '{code}' AS code, severity, split, n FROM ({sql})" for code, sql in _PREFLIGHT.items()))
def preflight(spark, sf_dir):
    return op.preflight(*_import(spark, sf_dir))


@query("export_copies_key", "SELECT page_id, CASE WHEN regexp_matches(url, '\\.rf\\.[0-9a-f]{16,}') THEN regexp_replace(url, '\\.rf\\.[0-9a-f]{16,}', '') ELSE url END AS source FROM pages")
def export_copies_key(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", op.source_key(F.col("url")).alias("source"))


@query("repeat_by_weight", "SELECT l_orderkey, l_linenumber, copy::int AS copy FROM (SELECT l_orderkey, l_linenumber, unnest(range(1, (l_quantity % 4)::int + 1)) AS copy FROM lineitem)")
def repeat_by_weight(spark, sf_dir):
    weighted = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.floor(F.col("l_quantity") % 4).cast("double").alias("weight"))
    return sampling.repeated(weighted, row="l_orderkey", seed=7).select("l_orderkey", "l_linenumber", "copy")


@query("stream_log_fold", f"SELECT image, arg_max(status, seq) AS status FROM {_LOG} WHERE status IS NOT NULL GROUP BY 1")
def stream_log_fold(spark, sf_dir):
    """The log as a stream of files, folded batch by batch."""
    from sampleworks.streaming.logs import fold_once

    log = _log(spark, sf_dir).filter("status IS NOT NULL").select("image", "seq", "status")
    return fold_once(log, "image", "seq", "status")
