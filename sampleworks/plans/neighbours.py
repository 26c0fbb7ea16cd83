"""Queries of the neighbour graph over the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from sampleworks.operators import neighbours as op
from sampleworks.plans.register import query, table

NEAR = 0.65


def graph(spark, sf_dir, k=5):
    return op.neighbours(table(spark, sf_dir, "embeddings"), k)


def sets_of(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("set"))


_DIST = "1 - list_dot_product(a.embedding::double[], b.embedding::double[]) / sqrt(list_dot_product(a.embedding::double[], a.embedding::double[]) * list_dot_product(b.embedding::double[], b.embedding::double[]))"
_GRAPH = f"""p AS (SELECT a.vec_id AS src, b.vec_id AS dst, a.label AS set_a, b.label AS set_b, {_DIST} AS dist FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
    g AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(dist, 12), dst) AS rank FROM p) WHERE rank <= 5)"""


@query("knn_topk", f"WITH {_GRAPH} SELECT src, dst, rank::int AS rank, round(dist, 5) AS dist FROM g")
def knn_topk(spark, sf_dir):
    return graph(spark, sf_dir).select("src", "dst", "rank", F.round("dist", 5).alias("dist"))


@query("similar_to", f"SELECT b.vec_id AS dst, round({_DIST}, 5) AS dist FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id = 7 ORDER BY {_DIST}, dst LIMIT 24")
def similar_to(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    probe = e.filter("vec_id = 7").select(F.col("v").alias("q"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    dist = 1 - dot("q", "v") / F.sqrt(dot("q", "q") * dot("v", "v"))
    found = e.filter("vec_id <> 7").crossJoin(F.broadcast(probe)).select(F.col("vec_id").alias("dst"), dist.alias("d"))  # one probe row
    return found.orderBy("d", "dst").limit(24).select("dst", F.round("d", 5).alias("dist"))


@query("uniqueness", f"WITH {_GRAPH}, u AS (SELECT src, sum(dist / rank) / sum(1.0 / rank) AS d FROM g GROUP BY 1) SELECT src, round(d / (d + 1), 5) AS uniqueness FROM u")
def uniqueness(spark, sf_dir):
    return op.uniqueness(graph(spark, sf_dir)).withColumn("uniqueness", F.round("uniqueness", 5))


@query("outliers", f"WITH {_GRAPH}, o AS (SELECT src, min(dist) AS score FROM g GROUP BY 1) SELECT src, round(score, 5) AS score, score >= 0.9 AS alone FROM o ORDER BY o.score DESC, src LIMIT 200")
def outliers(spark, sf_dir):
    return op.outliers(graph(spark, sf_dir)).withColumn("score", F.round("score", 5))


@query("leaks", f"WITH {_GRAPH} SELECT least(src, dst) AS a, greatest(src, dst) AS b, round(min(dist), 5) AS dist FROM g WHERE dist <= {NEAR} AND set_a <> set_b GROUP BY 1, 2")
def leaks(spark, sf_dir):
    return op.graph_leaks(graph(spark, sf_dir), sets_of(spark, sf_dir), NEAR).select("a", "b", F.round("dist", 5).alias("dist"))


@query("leaks_whole", f"SELECT a.vec_id AS a, b.vec_id AS b, round({_DIST}, 5) AS dist FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND a.label <> b.label WHERE {_DIST} <= {NEAR}")
def leaks_whole(spark, sf_dir):
    """Every pair, also beyond the nearest five."""
    return op.leaks(table(spark, sf_dir, "embeddings"), sets_of(spark, sf_dir), NEAR).select("a", "b", F.round("dist", 5).alias("dist"))


@query(
    "duplicate_groups",
    f"""WITH RECURSIVE {_GRAPH}, e AS (SELECT src, dst FROM g WHERE dist <= 0.55 UNION SELECT dst, src FROM g WHERE dist <= 0.55),
        c AS (SELECT src AS id, src AS r FROM e UNION SELECT c.id, e.dst FROM c JOIN e ON c.r = e.src) SELECT id, min(r) AS "group" FROM c GROUP BY 1""",
)
def duplicate_groups(spark, sf_dir):
    return op.duplicate_groups(graph(spark, sf_dir), 0.55)


@query(
    "duplicate_groups_whole",
    f"""WITH RECURSIVE e AS (SELECT a.vec_id AS src, b.vec_id AS dst FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE {_DIST} <= 0.55),
        c AS (SELECT src AS id, src AS r FROM e UNION SELECT c.id, e.dst FROM c JOIN e ON c.r = e.src) SELECT id, min(r) AS "group" FROM c GROUP BY 1""",
)
def duplicate_groups_whole(spark, sf_dir):
    """Groups over every pair, also beyond the nearest five."""
    return op.duplicate_groups(op.near_graph(table(spark, sf_dir, "embeddings"), 0.55), 0.55)


@query(
    "softmax_metrics",
    """WITH t AS (SELECT vec_id, label, embedding::double[] AS x FROM embeddings), e AS (SELECT *, list_transform(x, lambda v: exp(v - list_max(x))) AS e FROM t), p AS (SELECT *, list_transform(e, lambda v: v / list_sum(e)) AS p FROM e)
        SELECT vec_id, round(-ln(greatest(p[label + 1], 1e-12)), 5) AS loss, (list_position(x, list_max(x)) - 1)::int AS predicted, round(list_max(p), 6) AS confidence, ((list_position(x, list_max(x)) - 1) = label)::int AS accuracy,
        round(p[label + 1], 6) AS p_true, round(list_reverse_sort(p)[1] - list_reverse_sort(p)[2], 6) AS margin FROM p""",
)
def softmax_metrics(spark, sf_dir):
    found = op.softmax_metrics(table(spark, sf_dir, "embeddings"), "embedding", "label")
    return found.select("vec_id", F.round("loss", 5).alias("loss"), "predicted", F.round("confidence", 6).alias("confidence"), "accuracy", F.round("p_true", 6).alias("p_true"), F.round("margin", 6).alias("margin"))
