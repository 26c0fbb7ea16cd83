"""How a model did: counts of each image, objects one by one, class tables, and scores of other tasks.

Truth and predictions are arrays of boxes as in :mod:`matching`. A null array counts as empty and so does a null image row
of either side; repeated images are separate rows; an empty table gives no rows, or sums of zero where one row is due.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sampleworks.functions.values import f1_score, is_finite, ratio
from sampleworks.operators import matching
from sampleworks.operators.ranges import staged

SKIPPED = -2


def _boxes(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast(df.schema[name].dataType))


def image_counts(df: DataFrame, truth: str = "truth", predicted: str = "predicted", *, threshold: float = 0.5, crowd: Callable[[Column], Column] | None = None, ignore_overlap: float = 0.5) -> DataFrame:
    """``df`` with ``tp, fp, fn, precision, recall, f1`` and ``gt_match`` of each image.

    ``crowd`` tells truth boxes that mark regions: they are matched by nothing (``gt_match`` -2), and an unmatched
    prediction that lies in one by half or more is no false positive. ``gt_match`` is the place of the matching prediction in
    order of confidence, or -1. Without anything to divide by, precision and recall are 1.
    """
    is_crowd = crowd or (lambda t: F.lit(False))
    steps = df.withColumns({"__all": _boxes(df, truth), "__p": _boxes(df, predicted)})
    steps = steps.withColumns({"__t": F.filter("__all", lambda t: ~is_crowd(t)), "__c": F.filter("__all", is_crowd)})
    steps = steps.withColumn("__m", matching.greedy_match(F.col("__t"), F.col("__p"), threshold))
    hidden = lambda m: F.exists("__c", lambda c: matching.covered(F.element_at("__p", m["place"] + 1), c) >= ignore_overlap)
    steps = steps.withColumns({
        "tp": F.size(F.filter("__m", lambda m: m["truth"] >= 0)),
        "fp": F.size(F.filter("__m", lambda m: (m["truth"] < 0) & ~hidden(m))),
    })
    steps = steps.withColumn("fn", F.size("__t") - F.col("tp"))
    # the place among the boxes that count, for each box
    kept = F.transform("__all", lambda t, i: F.when(is_crowd(t), F.lit(SKIPPED)).otherwise(F.size(F.filter(F.slice("__all", 1, i), lambda o: ~is_crowd(o)))))
    steps = steps.withColumn("gt_match", F.transform(kept, lambda k: F.when(k < 0, k).otherwise(F.array_position(F.transform("__m", lambda m: m["truth"]), k).cast("int") - 1)))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp"), 1.0), ratio(F.col("tp"), F.col("tp") + F.col("fn"), 1.0)
    steps = steps.withColumns({"precision": p, "recall": r})
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return steps.withColumn("f1", f1).drop("__all", "__p", "__t", "__c", "__m")


def outcomes(df: DataFrame, keys: Sequence[str], truth: str = "truth", predicted: str = "predicted", *, confidence: float = 0.25, threshold: float = 0.5, kinds: Sequence[str] = ("tp", "fp", "fn"), labels: Sequence[int] | None = None) -> DataFrame:
    """One row for each object: ``kind, label, score, box, label_box, overlap``.

    Predictions of ``confidence`` or more are matched within their class; a box in place with another class is therefore one
    invented and one missed object. ``box`` is the prediction, or the missed label.
    """
    steps = df.select(*keys, _boxes(df, truth).alias("__t"), F.filter(_boxes(df, predicted), lambda p: p["score"] >= confidence).alias("__p"))
    steps = steps.withColumn("__m", matching.greedy_match(F.col("__t"), F.col("__p"), threshold))
    corners = lambda b: F.struct(*[b[c].alias(c) for c in ("x0", "y0", "x1", "y1")])

    def shown(m: Column) -> Column:
        p, t = F.element_at("__p", m["place"] + 1), F.try_element_at("__t", F.nullif(m["truth"] + 1, F.lit(0)))
        return F.struct(F.when(m["truth"] >= 0, "tp").otherwise("fp").alias("kind"), p["label"].alias("label"), p["score"].alias("score"), corners(p).alias("box"), F.when(m["truth"] >= 0, corners(t)).alias("label_box"), F.when(m["truth"] >= 0, matching.iou(p, t)).alias("overlap"))

    def missed(x: Column) -> Column:
        return F.struct(F.lit("fn").alias("kind"), x["t"]["label"].alias("label"), F.lit(None).cast("double").alias("score"), corners(x["t"]).alias("box"), F.lit(None).cast("struct<x0:double,y0:double,x1:double,y1:double>").alias("label_box"), F.lit(None).cast("double").alias("overlap"))

    lost = F.filter(F.transform("__t", lambda t, i: F.struct(i.alias("i"), t.alias("t"))), lambda x: ~F.exists("__m", lambda m: m["truth"] == x["i"]))
    rows = steps.select(*keys, F.inline(F.concat(F.transform("__m", shown), F.transform(lost, missed)))).filter(F.col("kind").isin(*kinds))
    return rows.filter(F.col("label").isin(*labels)) if labels is not None else rows


def outcome_counts(rows: DataFrame, *by: str) -> DataFrame:
    """``tp, fp, fn`` of the rows of :func:`outcomes`, in total or by columns."""
    return rows.groupBy(*by).agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("tp", "fp", "fn")])


def class_matches(df: DataFrame, truth: str = "truth", predicted: str = "predicted", *, lowest: float = 0.05, threshold: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(``label, score, hit`` of every prediction, ``label, support``), matched once at the lowest confidence.

    Raising the confidence only takes away predictions too weak to have won a label, so all readings follow from these rows.
    """
    steps = df.select(_boxes(df, truth).alias("__t"), F.filter(_boxes(df, predicted), lambda p: p["score"] >= lowest).alias("__p"))
    steps = steps.withColumn("__m", matching.greedy_match(F.col("__t"), F.col("__p"), threshold))
    box = lambda m: F.element_at("__p", m["place"] + 1)
    shown = F.transform("__m", lambda m: F.struct(box(m)["label"].alias("label"), box(m)["score"].alias("score"), (m["truth"] >= 0).alias("hit")))
    lost = F.array_except(F.transform("__t", lambda t, i: i), F.transform("__m", lambda m: m["truth"]))
    missed = F.transform(lost, lambda i: F.struct(F.element_at("__t", i + 1)["label"].alias("label"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("boolean").alias("hit")))
    rows = staged(steps.select(F.inline(F.concat(shown, missed))), "class-matches")  # read several times
    scored = rows.filter("hit IS NOT NULL")
    return scored, rows.filter("hit IS NULL OR hit").groupBy("label").agg(F.count("*").alias("support"))


def class_table(scored: DataFrame, support: DataFrame, confidence: float, order: list[str]) -> DataFrame:
    """``label, support, predictions, tp, fp, fn, precision, recall, f1, ap`` of each class at a confidence."""
    counts = scored.filter(F.col("score") >= confidence).groupBy("label").agg(F.count("*").alias("predictions"), F.count_if("hit").alias("tp"))
    both = support.join(counts, "label", "full_outer").fillna(0, ["support", "predictions", "tp"])
    tp, fp, fn = F.col("tp"), F.col("predictions") - F.col("tp"), F.col("support") - F.col("tp")
    table = both.select("label", "support", "predictions", "tp", fp.alias("fp"), fn.alias("fn"), ratio(tp, F.col("predictions")).alias("precision"), ratio(tp, F.col("support")).alias("recall"), f1_score(tp, fp, fn).alias("f1"))
    return table.join(matching.average_precision(scored, both.select("label", "support"), order), "label", "left")


def detector_scores(table: DataFrame) -> DataFrame:
    """One row from a class table: ``map50`` over classes with labels, pooled ``precision, recall, f1``."""
    tp, fp, fn = (F.sum(c) for c in ("tp", "fp", "fn"))
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    found = table.agg(F.coalesce(F.avg(F.when(F.col("support") > 0, F.nanvl("ap", F.lit(None).cast("double")))), F.lit(0.0)).alias("map50"), p.alias("precision"), r.alias("recall"))
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return found.withColumn("f1", f1)


def classification_scores(df: DataFrame, label: str, predicted: str, loss: str) -> DataFrame:
    """One row: ``images, accuracy, loss``, and ``macro_f1`` over the classes that labels or predictions have."""
    cells = df.groupBy(F.col(label).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"), F.sum(loss).alias("loss"), F.count(loss).alias("losses"))
    sides = cells.select(F.explode(F.array(F.struct(F.col("t").alias("label"), F.lit(1).alias("truth")), F.struct(F.col("p").alias("label"), F.lit(0).alias("truth")))).alias("s"), "t", "p", "n").select("s.*", "t", "p", "n")
    hit = (F.col("t") == F.col("p")).cast("int")
    classes = sides.filter("label IS NOT NULL").groupBy("label").agg(F.sum(hit * F.col("truth") * F.col("n")).alias("tp"), F.sum("n").alias("both"))
    macro = classes.agg(F.avg(ratio(2 * F.col("tp"), F.col("both"))).alias("macro_f1"))
    whole = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("images"), (F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"), (F.sum("loss") / F.sum("losses")).alias("loss"))
    return whole.crossJoin(F.broadcast(macro))  # one row each


def pixel_counts(df: DataFrame, keys: Sequence[str], truth: str, predicted: str, classes: Sequence[int], ignore: int | None = None) -> DataFrame:
    """``class, intersection, union`` of two rasters of class numbers for each image and class, and its ``right`` and
    ``pixels``; pixels whose truth is ``ignore`` don't count."""
    both = F.filter(F.arrays_zip(F.col(truth).alias("t"), F.col(predicted).alias("p")), lambda z: F.lit(True) if ignore is None else z["t"] != ignore)
    steps = df.select(*keys, both.alias("__z"))
    one = lambda c: F.struct(F.lit(c).alias("class"), F.size(F.filter("__z", lambda z: (z["t"] == c) & (z["p"] == c))).alias("intersection"), F.size(F.filter("__z", lambda z: (z["t"] == c) | (z["p"] == c))).alias("union"), F.size(F.filter("__z", lambda z: z["t"] == c)).alias("pixels"))
    return steps.select(*keys, F.inline(F.array(*map(one, classes))))


def semantic_scores(counts: DataFrame) -> DataFrame:
    """One row from pooled pixel counts: ``accuracy`` and ``mean_iou`` over the classes that are present at all."""
    classes = counts.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("intersection", "union", "pixels")])
    iou = F.when(F.col("union") > 0, F.col("intersection") / F.col("union"))
    return classes.agg(F.try_divide(F.sum("intersection"), F.sum("pixels")).alias("accuracy"), F.avg(iou).alias("mean_iou"), F.count(iou).alias("classes"))


def ranking_scores(ranked: DataFrame, position: str, hit: str, ks: Sequence[int], target: float = 1.0) -> DataFrame:
    """One row for each k: ``k, precision, recall``, with the ``average_precision`` of the whole ranking and the ``effort``, how
    many are looked at until ``target`` of the hits are found. ``position`` counts from 1, without gaps or ties."""
    hits = ranked.filter(F.col(hit)).select(F.col(position).alias("at"))
    # the number of a hit among hits: within stretches of the ranking, plus those of stretches before
    hits = hits.withColumn("__s", F.floor(F.col("at") / 65_536))
    before = hits.groupBy("__s").agg(F.count("*").alias("__n"))
    before = before.select("__s", (F.sum("__n").over(Window.orderBy("__s")) - F.col("__n")).alias("__before"))
    numbered = hits.withColumn("__k", F.row_number().over(Window.partitionBy("__s").orderBy("at"))).join(before, "__s").withColumn("number", F.col("__k") + F.col("__before"))
    whole = ranked.agg(F.count("*").alias("rows"), F.count_if(hit).alias("hits"))
    needed = F.round(F.col("hits") * target)
    found = numbered.crossJoin(F.broadcast(whole)).agg(  # one row
        (F.sum(F.col("number") / F.col("at")) / F.max("hits")).alias("average_precision"),
        F.coalesce(F.min(F.when(F.col("number") >= needed, F.col("at"))), F.max("rows")).alias("effort"),
        F.max("hits").alias("hits"), *[F.count_if(F.col("at") <= k).alias(f"k{k}") for k in ks],
    )
    at = F.array(*[F.struct(F.lit(k).alias("k"), (F.col(f"k{k}") / k).alias("precision"), (F.col(f"k{k}") / F.col("hits")).alias("recall")) for k in ks])
    return found.select(F.inline(at), "average_precision", "effort")


AGGREGATES: dict[str, Callable[[Column], Column]] = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max}


def aggregated(metrics: DataFrame, names: Sequence[str] = ("mean",), others: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """One row: each number or boolean column but ``example_id`` and lists, by each aggregate; the mean has the plain name.

    ``others`` adds aggregates, a function from a column to an aggregate each; grouped Pandas functions are asked for on their own.
    """
    known = {**AGGREGATES, **(others or {})}
    fields = [f for f in metrics.schema if isinstance(f.dataType, (T.NumericType, T.BooleanType)) and f.name != "example_id"]
    return metrics.agg(*[known[n](F.col(f.name).cast("double")).alias(f.name if n == "mean" else f"{f.name}_{n}") for f in fields for n in names])


def landmark_summary(df: DataFrame, instances: str, count: int, keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """``index, scored, unavailable, confidence_count, mean_oks, mean_confidence`` of each keypoint over all instances that
    pass; these hold ``keypoint_<i>_oks`` and ``keypoint_<i>_confidence``. Means are of observations, not of images."""
    shown = F.filter(instances, keep) if keep else F.col(instances)
    points = lambda i: F.array(*[F.struct(F.lit(n).alias("index"), i[f"keypoint_{n}_oks"].cast("double").alias("oks"), i[f"keypoint_{n}_confidence"].cast("double").alias("confidence")) for n in range(count)])
    rows = df.select(F.inline(F.flatten(F.transform(shown, points))))
    good = lambda c: F.when(is_finite(F.col(c)), F.col(c))
    return rows.groupBy("index").agg(F.count(good("oks")).alias("scored"), (F.count("*") - F.count(good("oks"))).alias("unavailable"), F.count(good("confidence")).alias("confidence_count"), F.avg(good("oks")).alias("mean_oks"), F.avg(good("confidence")).alias("mean_confidence"))
