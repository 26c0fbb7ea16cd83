"""Queries of joins, facets, summaries, grouping, order and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from sampleworks.functions import filters
from sampleworks.operators import facets, joining
from sampleworks.plans.register import query, table


def joined(spark, sf_dir):
    """Orders as the sample table, lineitems as metrics."""
    samples = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("_row"), "o_totalprice", "o_orderstatus", "o_custkey")
    metrics = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("example_id"), F.col("l_linenumber").alias("epoch"), (1 - F.col("l_discount")).alias("score"), "l_quantity", "l_returnflag")
    return joining.join_input(metrics, samples)


_JOINED = "(SELECT l_orderkey AS example_id, l_linenumber AS epoch, 1 - l_discount AS score, l_quantity, l_returnflag, o_totalprice, o_orderstatus, o_custkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"


@query("joined_metrics", f"SELECT example_id, epoch, round(score, 4) AS score, o_totalprice, o_orderstatus FROM {_JOINED}")
def joined_metrics(spark, sf_dir):
    return joined(spark, sf_dir).select("example_id", "epoch", F.round("score", 4).alias("score"), "o_totalprice", "o_orderstatus")


@query(
    "joined_collected",
    "SELECT l_orderkey AS example_id, l_quantity, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_orderstatus AS \"o_orderstatus@collected\" FROM lineitem JOIN orders ON o_orderkey = l_orderkey",
)
def joined_collected(spark, sf_dir):
    original = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("example_id"), "o_orderstatus", "o_custkey")
    shown = original.select(F.col("example_id").alias("_row"), F.when(F.col("example_id") % 5 == 0, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), "o_custkey")
    metrics = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("example_id"), "l_quantity")
    found = joining.with_collected(joining.join_input(metrics, shown), original, ["o_orderstatus", "o_custkey"], "example_id")
    return found.drop("o_custkey")


@query("joined_last_epoch", f"SELECT example_id, epoch, l_quantity FROM (SELECT *, max(epoch) OVER (PARTITION BY example_id) AS m FROM {_JOINED}) WHERE epoch = m")
def joined_last_epoch(spark, sf_dir):
    return joining.last_epoch(joined(spark, sf_dir), "example_id", "epoch").select("example_id", "epoch", "l_quantity")


def _filters():
    return {"l_quantity": filters.numeric_range(F.col("l_quantity"), 10, 40), "o_totalprice": filters.numeric_range(F.col("o_totalprice"), 50_000, 300_000), "l_returnflag": filters.excluding(F.col("l_returnflag"), ["A"])}


_FAILS = "(CASE WHEN l_quantity BETWEEN 10 AND 40 THEN 0 ELSE 1 END + CASE WHEN o_totalprice BETWEEN 50000 AND 300000 THEN 0 ELSE 1 END + CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END)"


@query(
    "facet_histogram",
    f"""SELECT least(23, greatest(0, floor((l_quantity - 1) / (49.0 / 24))))::int AS bin, count(*) AS total, count(*) FILTER ({_FAILS} = 0) AS filtered_in,
        count(*) FILTER ({_FAILS} = 1 AND NOT l_quantity BETWEEN 10 AND 40) AS excluded_here FROM {_JOINED} GROUP BY 1""",
)
def facet_histogram(spark, sf_dir):
    return facets.histogram(joined(spark, sf_dir), "l_quantity", _filters(), 1.0, 50.0)


@query("facet_categorical", f"SELECT l_returnflag AS value, count(*) AS total, count(*) FILTER (l_quantity BETWEEN 10 AND 40 AND o_totalprice BETWEEN 50000 AND 300000) AS filtered_in FROM {_JOINED} GROUP BY 1")
def facet_categorical(spark, sf_dir):
    return facets.categorical_counts(joined(spark, sf_dir), "l_returnflag", _filters())


@query("draw_mask", f"SELECT mask, count(*) AS n FROM (SELECT CASE WHEN o_totalprice BETWEEN 50000 AND 300000 AND l_quantity BETWEEN 10 AND 40 THEN 2 WHEN o_totalprice BETWEEN 50000 AND 300000 THEN 1 ELSE 0 END AS mask FROM {_JOINED}) GROUP BY 1")
def draw_mask(spark, sf_dir):
    f = _filters()
    return joined(spark, sf_dir).groupBy(filters.draw_mask(f["o_totalprice"], f["l_quantity"]).alias("mask")).agg(F.count("*").alias("n"))


@query(
    "summary_numeric",
    """SELECT count(*) AS count, count(o_totalprice) AS present, count(*) - count(o_totalprice) AS missing, count(DISTINCT o_totalprice) AS "distinct", min(o_totalprice) AS min,
        max(o_totalprice) AS max, round(sum(o_totalprice), 2) AS sum, round(avg(o_totalprice), 4) AS mean, round(stddev_pop(o_totalprice), 4) AS std,
        round(quantile_cont(o_totalprice, 0.25), 4) AS q25, round(quantile_cont(o_totalprice, 0.5), 4) AS q50, round(quantile_cont(o_totalprice, 0.75), 4) AS q75 FROM orders""",
)
def summary_numeric(spark, sf_dir):
    found = facets.numeric_summary(table(spark, sf_dir, "orders"), "o_totalprice")
    return found.withColumns({c: F.round(c, 2 if c == "sum" else 4) for c in ("sum", "mean", "std", "q25", "q50", "q75")})


@query("summary_string", "SELECT c_mktsegment AS value, count(*) AS n FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 12")
def summary_string(spark, sf_dir):
    return facets.top_values(table(spark, sf_dir, "customer"), "c_mktsegment")


@query(
    "usable_fields",
    """WITH s AS (SELECT 'c_name' AS field, count(c_name) AS present, count(DISTINCT c_name) AS "distinct", max(length(c_name)) AS longest, true AS text, count(*) AS rows FROM customer
        UNION ALL SELECT 'c_mktsegment', count(c_mktsegment), count(DISTINCT c_mktsegment), max(length(c_mktsegment)), true, count(*) FROM customer
        UNION ALL SELECT 'c_nationkey', count(c_nationkey), count(DISTINCT c_nationkey), max(length(c_nationkey::varchar)), false, count(*) FROM customer)
        SELECT field, present, "distinct", NOT ("distinct" <= 1 AND present = rows) AND NOT (text AND (longest > 120 OR (present >= 20 AND "distinct" >= 0.9 * present))) AND present > 0 AS usable, "distinct" > 500 AS wide FROM s""",
)
def usable_fields(spark, sf_dir):
    return facets.usable_fields(table(spark, sf_dir, "customer"), ["c_name", "c_mktsegment", "c_nationkey"]).select("field", "present", "distinct", "usable", "wide")


@query("group_by_field_binned", 'SELECT least(23, greatest(0, floor((p_retailprice - 900) / (1200.0 / 24))))::int AS "group", count(*) AS n FROM part GROUP BY 1')
def group_by_field_binned(spark, sf_dir):
    return facets.group_by_bins(table(spark, sf_dir, "part"), "p_retailprice", 900.0, 2100.0)


@query(
    "group_by_field_tail",
    """WITH c AS (SELECT p_type, count(*) AS n FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY p_type IS NULL ORDER BY n DESC, p_type) AS k FROM c)
        SELECT CASE WHEN p_type IS NULL THEN 'No value' WHEN k <= 24 THEN p_type ELSE 'more values' END AS "group", sum(n)::bigint AS n FROM r GROUP BY 1""",
)
def group_by_field_tail(spark, sf_dir):
    return facets.group_by_value(table(spark, sf_dir, "part"), "p_type")


@query("gallery_bars", "SELECT CASE WHEN n <= 0 THEN 0 WHEN n >= 64 THEN 64 ELSE (2 ** floor(log2(n)))::int END AS bucket, count(*) AS images FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) GROUP BY 1")
def gallery_bars(spark, sf_dir):
    counts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return counts.groupBy(facets.count_bucket(F.col("n")).alias("bucket")).agg(F.count("*").alias("images"))


@query("sort_multi_key", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderstatus DESC NULLS FIRST, o_totalprice ASC NULLS LAST, o_orderkey LIMIT 500")
def sort_multi_key(spark, sf_dir):
    return facets.sorted_rows(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), [("o_orderstatus", True), ("o_totalprice", False)], "o_orderkey").limit(500)


@query("sort_missing_last", "SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) ORDER BY quality DESC NULLS LAST, doc_id LIMIT 300")
def sort_missing_last(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return facets.field_sorted(df, "quality", True, "doc_id").limit(300)


@query("sort_multi_key_whole", "SELECT o_orderkey, o_orderstatus, o_totalprice, row_number() OVER (ORDER BY o_orderstatus DESC NULLS FIRST, o_totalprice ASC NULLS LAST, o_orderkey) - 1 AS position FROM orders")
def sort_multi_key_whole(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return facets.positioned(facets.sorted_rows(df, [("o_orderstatus", True), ("o_totalprice", False)], "o_orderkey"))


@query("sort_missing_last_whole", "SELECT doc_id, quality, row_number() OVER (ORDER BY quality DESC NULLS LAST, doc_id) - 1 AS position FROM documents LEFT JOIN labels USING (doc_id)")
def sort_missing_last_whole(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return facets.positioned(facets.field_sorted(df, "quality", True, "doc_id"))


@query("per_group_preview", "SELECT c_mktsegment, c_custkey, place::int AS place FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS place FROM customer) WHERE place <= 5")
def per_group_preview(spark, sf_dir):
    return facets.preview(table(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey"), "c_mktsegment", "c_custkey", 5)


@query("strided_sample", "SELECT o_orderkey FROM orders WHERE o_orderkey % greatest(1, (SELECT count(*) FROM orders) // 12) = 0 ORDER BY 1 LIMIT 12")
def strided_sample(spark, sf_dir):
    return facets.strided(table(spark, sf_dir, "orders").select("o_orderkey"), 12, "o_orderkey")


@query("paged_rows", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 200 AND 299")
def paged_rows(spark, sf_dir):
    return facets.page(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 200, 100, "o_orderkey")


@query("union_tables", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 3 = 0")
def union_tables(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return joining.union_tables(df.filter("o_orderkey % 2 = 0"), df.filter("o_orderkey % 3 = 0"))


@query("except_keys", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def except_keys(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


@query("first_wins_distinct", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY lang, doc_id) AS n FROM documents) WHERE n = 1")
def first_wins_distinct(spark, sf_dir):
    return joining.first_by_key(table(spark, sf_dir, "documents").select("source", "lang", "doc_id"), "source", "lang", "doc_id").select("source", "doc_id")


@query("subset_range", "SELECT o_orderkey FROM orders WHERE o_orderkey >= (SELECT floor(count(*) * 0.25) FROM orders) AND o_orderkey < (SELECT floor(count(*) * 0.5) FROM orders)")
def subset_range(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey")
    n = df.count()
    return df.filter(F.col("o_orderkey").between(int(n * 0.25), int(n * 0.5) - 1))


@query("set_values_patch", "SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN NULL WHEN p_partkey % 10 = 1 THEN 99 ELSE p_size END AS p_size FROM part")
def set_values_patch(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    patch = part.filter("p_partkey % 10 < 2").select("p_partkey", F.when(F.col("p_partkey") % 10 == 1, 99).alias("value"))
    return joining.set_values(part, patch, "p_size", "p_partkey")


@query("delete_rows_renumber", "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS o_orderkey, o_custkey FROM orders WHERE o_orderkey % 7 <> 3")
def delete_rows_renumber(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return joining.delete_rows(df, df.filter("o_orderkey % 7 = 3"), "o_orderkey")


@query(
    "net_edits",
    """WITH e AS (SELECT user_id AS "row", event_type AS "column", event_id AS seq, event_id % 3 AS "before", (event_id * 7) % 3 AS "after" FROM events)
        SELECT "row", "column", arg_min("before", seq) AS "before", arg_max("after", seq) AS "after" FROM e GROUP BY 1, 2 HAVING arg_min("before", seq) IS DISTINCT FROM arg_max("after", seq)""",
)
def net_edits(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("row"), F.col("event_type").alias("column"), F.col("event_id").alias("seq"), (F.col("event_id") % 3).alias("before"), (F.col("event_id") * 7 % 3).alias("after"))
    return joining.net_edits(e)


@query("remove_images", "SELECT doc_id, source, 'low quality' AS removed_reason FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)")
def remove_images(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return joining.remove_samples(docs, table(spark, sf_dir, "labels").filter("quality = 0"), "doc_id", {"removed_reason": F.lit("low quality")})[1]


@query("restore_images", "SELECT doc_id, source FROM documents")
def restore_images(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    kept, held = joining.remove_samples(docs, table(spark, sf_dir, "labels").filter("quality = 0"), "doc_id", {"removed_reason": F.lit("low quality")})
    return joining.restore_samples(held, kept, "doc_id")


@query("release_subset", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0)")
def release_subset(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").filter("quality = 1 AND toxic = 0"), "doc_id", "left_semi")


_SIDE = "SELECT l_orderkey AS image, count(*) FILTER (l_returnflag = 'N') AS tp, count(*) FILTER (l_returnflag = 'A') AS fp, count(*) FILTER (l_returnflag = 'R') AS fn FROM lineitem WHERE l_suppkey % 2 = {} GROUP BY 1"
_F1 = "CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2.0 * tp / (2 * tp + fp + fn) END"


def outcome_counts(spark, sf_dir):
    """Counts of each image for two runs."""
    items = table(spark, sf_dir, "lineitem")
    flag = lambda v: F.count_if(F.col("l_returnflag") == v)
    return [items.filter(F.col("l_suppkey") % 2 == side).groupBy(F.col("l_orderkey").alias("image")).agg(flag("N").alias("tp"), flag("A").alias("fp"), flag("R").alias("fn")) for side in (0, 1)]


@query(
    "compare_outcomes",
    f"""WITH b AS (SELECT image, {_F1} AS f FROM ({_SIDE.format(0)})), c AS (SELECT image, {_F1} AS f FROM ({_SIDE.format(1)}))
        SELECT image, round(b.f, 6) AS before, round(c.f, 6) AS after, CASE WHEN b.f IS NULL THEN 'only_candidate' WHEN c.f IS NULL THEN 'only_baseline' WHEN c.f - b.f > 1e-9 THEN 'improved' WHEN c.f - b.f < -1e-9 THEN 'regressed' ELSE 'unchanged' END AS outcome
        FROM b FULL JOIN c USING (image)""",
)
def compare_outcomes(spark, sf_dir):
    found = joining.compare_samples(*outcome_counts(spark, sf_dir), "image")
    return found.select("image", F.round("before", 6).alias("before"), F.round("after", 6).alias("after"), "outcome")
