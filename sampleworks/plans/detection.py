"""Queries of matching, evaluation and class statistics over boxes made from lineitem."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from sampleworks.operators import matching
from sampleworks.plans.register import query, table

_KEYS = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def rows(spark, sf_dir):
    """Each lineitem as a box of its order and a shifted prediction."""
    d = lambda c: F.col(c).cast("double")
    x0, y0 = d("l_partkey") % 97, d("l_suppkey") % 89
    shift = d("l_linenumber") % 3
    label = (F.col("l_partkey") % 5).cast("int")
    box = lambda s: [(x0 + s).alias("x0"), (y0 + s).alias("y0"), (x0 + s + F.col("l_quantity")).alias("x1"), (y0 + s + 10 * d("l_linenumber")).alias("y1")]
    truth = F.struct(*box(F.lit(0.0)), label.alias("label"))
    predicted = F.struct(*box(shift), F.when(F.col("l_returnflag") == "R", (label + 1) % 5).otherwise(label).cast("int").alias("label"), F.round(1 - F.col("l_discount") * 5, 4).alias("score"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image"), truth.alias("truth"), predicted.alias("predicted"), *_KEYS)


def images(spark, sf_dir):
    ordered = F.sort_array(F.collect_list(F.struct(*_KEYS, "truth", "predicted")))
    return rows(spark, sf_dir).groupBy("image").agg(ordered.alias("r")).select("image", "r.truth", "r.predicted")


def scored(spark, sf_dir):
    """Predictions with a stored hit flag."""
    return table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 5).cast("int").alias("label"), F.round(1 - F.col("l_discount") * 5, 4).alias("score"), (F.col("l_returnflag") != "R").alias("hit"), "l_orderkey", *_KEYS)


def support(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % 5).cast("int").alias("label")).agg(F.count("*").alias("support"))


_BOX = "(l_partkey % 97)::double AS x0, (l_suppkey % 89)::double AS y0, (l_partkey % 97 + l_quantity)::double AS x1, (l_suppkey % 89 + 10 * l_linenumber)::double AS y1"
_ORDER = "ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"
_ROWS = f"(SELECT l_orderkey AS image, {_BOX}, (l_linenumber % 3)::double AS s, (l_partkey % 5)::int AS label, (CASE WHEN l_returnflag = 'R' THEN (l_partkey % 5 + 1) % 5 ELSE l_partkey % 5 END)::int AS plabel, round(1 - l_discount * 5, 4) AS score, row_number() OVER (PARTITION BY l_orderkey {_ORDER}) AS i FROM lineitem)"
_IOU = "coalesce(w * h / nullif(a + b - w * h, 0), 0)"


@query(
    "iou_pairs",
    f"""WITH r AS (SELECT * FROM {_ROWS}), p AS (SELECT t.image, t.i AS truth, q.i AS predicted,
        greatest(least(t.x1, q.x1 + q.s) - greatest(t.x0, q.x0 + q.s), 0) AS w, greatest(least(t.y1, q.y1 + q.s) - greatest(t.y0, q.y0 + q.s), 0) AS h,
        (t.x1 - t.x0) * (t.y1 - t.y0) AS a, (q.x1 - q.x0) * (q.y1 - q.y0) AS b FROM r t JOIN r q ON t.image = q.image)
        SELECT image, truth::int AS truth, predicted::int AS predicted, round({_IOU}, 6) AS iou FROM p WHERE {_IOU} >= 0.3""",
)
def iou_pairs(spark, sf_dir):
    pairs = F.flatten(F.transform("truth", lambda t, i: F.transform(F.col("predicted"), lambda p, j: F.struct((i + 1).cast("int").alias("truth"), (j + 1).cast("int").alias("predicted"), matching.iou(t, p).alias("iou")))))
    return images(spark, sf_dir).select("image", F.inline(pairs)).filter("iou >= 0.3").withColumn("iou", F.round("iou", 6))


@query(
    "ignore_overlap",
    f"""WITH r AS (SELECT * FROM {_ROWS}), p AS (SELECT q.image, q.i, max(greatest(least(t.x1, q.x1 + q.s) - greatest(t.x0, q.x0 + q.s), 0) * greatest(least(t.y1, q.y1 + q.s) - greatest(t.y0, q.y0 + q.s), 0)
        / nullif((q.x1 - q.x0) * (q.y1 - q.y0), 0)) AS c FROM r q JOIN r t ON t.image = q.image AND t.label = 4 GROUP BY 1, 2)
        SELECT r.image, count(*) AS predictions, count(*) FILTER (coalesce(p.c, 0) >= 0.5) AS ignored FROM r LEFT JOIN p ON r.image = p.image AND r.i = p.i GROUP BY 1""",
)
def ignore_overlap(spark, sf_dir):
    crowd = F.filter("truth", lambda t: t["label"] == 4)
    ignored = F.size(F.filter("predicted", lambda p: F.exists(crowd, lambda c: matching.covered(p, c) >= 0.5)))
    return images(spark, sf_dir).select("image", F.size("predicted").cast("long").alias("predictions"), ignored.cast("long").alias("ignored"))


@query("nms")
def nms(spark, sf_dir):
    return images(spark, sf_dir).select("image", F.posexplode(matching.nms(F.col("predicted"), 0.5)).alias("rank", "place"))


@query("greedy_match")
def greedy_match(spark, sf_dir):
    return images(spark, sf_dir).select("image", F.inline(matching.greedy_match(F.col("truth"), F.col("predicted"))))


@query("confusion")
def confusion(spark, sf_dir):
    return matching.confusion(matching.matches(images(spark, sf_dir), class_aware=False))


_SCORED = "(SELECT (l_partkey % 5)::int AS label, round(1 - l_discount * 5, 4) AS score, l_returnflag <> 'R' AS hit, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM lineitem)"
_DIV = "CASE WHEN {1} = 0 THEN 0.0 ELSE {0}::double / {1} END"


@query(
    "per_class_scores",
    f"""WITH s AS (SELECT label, count(*) AS support, count(*) FILTER (score >= 0.75) AS predictions, count(*) FILTER (score >= 0.75 AND hit) AS tp FROM {_SCORED} GROUP BY 1)
        SELECT label, support, predictions, round({_DIV.format('tp', 'predictions')}, 6) AS precision, round({_DIV.format('tp', 'support')}, 6) AS recall, round({_DIV.format('2 * tp', '(predictions + support)')}, 6) AS f1 FROM s""",
)
def per_class_scores(spark, sf_dir):
    found = matching.per_class(scored(spark, sf_dir), support(spark, sf_dir), 0.75)
    return found.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


_GRID = ", ".join(repr(float(g)) for g in np.linspace(0, 1, 101))


@query(
    "average_precision",
    f"""WITH s AS (SELECT *, count(*) OVER (PARTITION BY label) AS support FROM {_SCORED}),
        r AS (SELECT label, support, row_number() OVER w AS k, sum(hit::int) OVER (w ROWS UNBOUNDED PRECEDING) AS tp FROM s WINDOW w AS (PARTITION BY label ORDER BY score DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)),
        c AS (SELECT label, k, tp::double / support AS recall, max(tp::double / k) OVER (PARTITION BY label ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS envelope FROM r),
        b AS (SELECT *, coalesce(lag(recall) OVER (PARTITION BY label ORDER BY k), -1) AS before FROM c)
        SELECT label, round(sum(envelope * len(list_filter([{_GRID}], lambda g: g <= recall AND g > before))) / 101, 6) AS ap FROM b GROUP BY 1""",
)
def average_precision(spark, sf_dir):
    found = matching.average_precision(scored(spark, sf_dir), support(spark, sf_dir), ["l_orderkey", *_KEYS])
    return found.withColumn("ap", F.round("ap", 6))


_STEPS = [round(0.5 + 0.05 * k, 2) for k in range(10)]
_SWEEP = f"""(SELECT confidence, count(*) FILTER (hit) AS tp, count(*) FILTER (NOT hit) AS fp, (SELECT count(*) FROM lineitem) AS n
    FROM (SELECT score, hit, unnest([{', '.join(map(str, _STEPS))}]::double[]) AS confidence FROM {_SCORED}) WHERE score >= confidence GROUP BY 1)"""


def _curve(spark, sf_dir):
    s = scored(spark, sf_dir)
    return matching.sweep(s, s.count(), _STEPS)


@query("threshold_sweep", f"SELECT confidence, tp, fp, round(tp::double / (tp + fp), 6) AS precision, round(tp::double / n, 6) AS recall, round(2.0 * tp / (tp + fp + n), 6) AS f1 FROM {_SWEEP}")
def threshold_sweep(spark, sf_dir):
    return _curve(spark, sf_dir).withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query("best_threshold", f"SELECT confidence FROM {_SWEEP} ORDER BY 2.0 * tp / (tp + fp + n) DESC, confidence LIMIT 1")
def best_threshold(spark, sf_dir):
    return matching.best_threshold(_curve(spark, sf_dir))


@query(
    "class_balance",
    "WITH c AS (SELECT (l_partkey % 5)::int AS label, count(*) AS n FROM lineitem GROUP BY 1) SELECT label, n, round(n::double / max(n) OVER (), 6) AS share, CASE WHEN n < 50 THEN 'too few' WHEN n::double / max(n) OVER () < 0.02 THEN 'rare' ELSE 'ok' END AS verdict FROM c",
)
def class_balance(spark, sf_dir):
    return matching.class_balance(support(spark, sf_dir).withColumnRenamed("support", "n")).withColumn("share", F.round("share", 6))


@query("class_images_boxes", "SELECT (l_partkey % 5)::int AS label, count(*) AS boxes, count(DISTINCT l_orderkey) AS images FROM lineitem GROUP BY 1")
def class_images_boxes(spark, sf_dir):
    return images(spark, sf_dir).select("image", F.explode("truth.label").alias("label")).groupBy("label").agg(F.count("*").alias("boxes"), F.count_distinct("image").alias("images"))


@query("label_counts", "SELECT l_orderkey AS image, count(*) FILTER (l_partkey % 5 <> 4) AS objects, list_sort(list_distinct(list((l_partkey % 5)::int) FILTER (l_partkey % 5 <> 4)))::varchar AS classes FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_partkey % 5 <> 4) > 0")
def label_counts(spark, sf_dir):
    kept = F.filter("truth", lambda t: t["label"] != 4)
    found = images(spark, sf_dir).select("image", F.size(kept).cast("long").alias("objects"), F.array_sort(F.array_distinct(F.transform(kept, lambda t: t["label"]))).cast("string").alias("classes"))
    return found.filter("objects > 0")


@query(
    "class_slices",
    """SELECT (l_partkey % 5)::int AS label, count(*) FILTER (l_suppkey % 2 = 0 AND l_returnflag = 'N') AS tp_before, count(*) FILTER (l_suppkey % 2 = 1 AND l_returnflag = 'N') AS tp_after,
        greatest(count(*) FILTER (l_suppkey % 2 = 0), count(*) FILTER (l_suppkey % 2 = 1)) >= 30 AS conclusive FROM lineitem GROUP BY 1""",
)
def class_slices(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").withColumn("side", F.col("l_suppkey") % 2)
    hit = F.col("l_returnflag") == "N"
    found = items.groupBy((F.col("l_partkey") % 5).cast("int").alias("label")).agg(*[F.count_if((F.col("side") == s) & hit).alias(f"tp_{n}") for s, n in ((0, "before"), (1, "after"))], *[F.count_if(F.col("side") == s).alias(f"n{s}") for s in (0, 1)])
    return found.select("label", "tp_before", "tp_after", (F.greatest("n0", "n1") >= 30).alias("conclusive"))


@query("size_slices", "SELECT CASE WHEN a < 1024 THEN 'small' WHEN a < 9216 THEN 'medium' ELSE 'large' END AS band, count(*) AS labels, round(count(*) FILTER (l_returnflag <> 'R')::double / count(*), 6) AS recall FROM (SELECT *, l_quantity * 10 * l_linenumber AS a FROM lineitem) GROUP BY 1")
def size_slices(spark, sf_dir):
    boxes = table(spark, sf_dir, "lineitem").withColumn("a", F.col("l_quantity") * 10 * F.col("l_linenumber"))
    band = F.when(F.col("a") < 32**2, "small").when(F.col("a") < 96**2, "medium").otherwise("large")
    return boxes.groupBy(band.alias("band")).agg(F.count("*").alias("labels"), F.round(F.count_if(F.col("l_returnflag") != "R") / F.count("*"), 6).alias("recall"))


@query(
    "filter_elements_same_instance",
    "SELECT DISTINCT l_orderkey AS image FROM lineitem WHERE l_partkey % 5 = 2 AND l_quantity * 10 * l_linenumber BETWEEN 500 AND 900",
)
def filter_elements_same_instance(spark, sf_dir):
    from sampleworks.functions.filters import any_instance

    same = any_instance(F.col("truth"), lambda t: t["label"] == 2, lambda t: matching.area(t).between(500, 900))
    return images(spark, sf_dir).filter(same).select("image")
