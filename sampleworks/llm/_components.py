"""Connected components of an edge table, by contraction to the least neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sampleworks.llm._shared import written


def components(edges: DataFrame) -> DataFrame:
    """``node, comp`` for every end of an edge ``a, b``; ``comp`` is the least node that can be reached.

    In each round every node points to its least neighbour, pointers are followed four steps, and the edges are
    rewritten to what their ends point to. Edges inside a point vanish, so the table shrinks from round to
    round and ends empty. Nodes are hashes, so long descending chains are rare. Each round is written to the
    shared folder.
    """
    left = written(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    steps: list[DataFrame] = []
    while left.limit(1).count():
        both = left.union(left.select("b", "a"))
        points = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up")).select("node", F.least("node", "up").alias("up")), "points")
        for _ in range(2):
            points = points.join(points.select(F.col("node").alias("up"), F.col("up").alias("ahead")), "up").select("node", F.col("ahead").alias("up"))
        points = written(points, "points")
        steps.append(points)
        mapped = left.join(points.withColumnRenamed("node", "a"), "a").select(F.col("up").alias("a"), "b")
        mapped = mapped.join(points.withColumnRenamed("node", "b"), "b").select("a", F.col("up").alias("b"))
        left = written(mapped.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    if not steps:
        return left.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    found = steps[0].withColumnRenamed("up", "comp")
    for step in steps[1:]:
        found = found.join(step.withColumnRenamed("node", "comp"), "comp", "left").select("node", F.coalesce("up", "comp").alias("comp"))
    return written(found, "components")
