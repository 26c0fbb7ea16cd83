"""Queries of findings, trust, version differences, geometry and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from sampleworks.functions import geometry
from sampleworks.operators import findings, sampling
from sampleworks.plans.detection import images
from sampleworks.plans.register import query, table


@query("round_findings")
def round_findings(spark, sf_dir):
    return findings.round_findings(images(spark, sf_dir), ["image"]).drop("overlap")


@query("finding_class_swaps")
def finding_class_swaps(spark, sf_dir):
    return findings.class_swaps(findings.round_findings(images(spark, sf_dir), ["image"]))


@query("image_trust", "SELECT l_orderkey AS image, round(sum((1 - l_discount) * exp(-(1 - l_discount) / 0.1)) / sum(exp(-(1 - l_discount) / 0.1)), 6) AS trust FROM lineitem GROUP BY 1")
def image_trust(spark, sf_dir):
    q = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image"), (1 - F.col("l_discount")).alias("q"))
    return findings.image_trust(q, "image", "q").withColumn("trust", F.round("trust", 6))


@query("label_diff")
def label_diff(spark, sf_dir):
    versions = images(spark, sf_dir).withColumn("predicted", F.transform("predicted", lambda p: p.dropFields("score")))
    return findings.label_diff(versions, "truth", "predicted").drop("truth", "predicted")


@query("polygon_area", "SELECT p_partkey, round(abs((p_size * 2.0 - 0) + (0 - p_size * p_retailprice)) / 2, 4) AS area FROM (SELECT p_partkey, p_size::double AS p_size, p_retailprice FROM part)")
def polygon_area(spark, sf_dir):
    """The triangle (0, 0), (size, 2), (size, price) seen from its second corner."""
    size, price = F.col("p_size").cast("double"), F.col("p_retailprice")
    flat = F.array(F.lit(0.0), F.lit(0.0), size, F.lit(2.0), size, price)
    return table(spark, sf_dir, "part").select("p_partkey", F.round(geometry.polygon_area(flat), 4).alias("area"))


@query("weighted_sample")
def weighted_sample(spark, sf_dir):
    return sampling.weighted(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), 100, weight="l_quantity", row="l_orderkey")


@query("pca_projection")
def pca_projection(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return sampling.projected(e, "embedding", *sampling.principal_axes(e, "embedding")).drop("embedding")


@query("bootstrap_ci")
def bootstrap_ci(spark, sf_dir):
    return sampling.bootstrap_interval(table(spark, sf_dir, "labels").filter("quality IS NOT NULL"), "quality", row="doc_id")
