"""Boxes: overlap, greedy matching, suppression and the measures that follow from them.

Instances are arrays of structs ``x0, y0, x1, y1, label`` (and ``score``); everything within an image is one expression
over its arrays, so no image is unfolded and nothing is shuffled. Matching goes over Arrow batches of images.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sampleworks.functions.values import f1_score, ratio
from sampleworks.operators import ranges


def area(b: Column) -> Column:
    return F.greatest(b["x1"] - b["x0"], F.lit(0.0)) * F.greatest(b["y1"] - b["y0"], F.lit(0.0))


def intersection(a: Column, b: Column) -> Column:
    wide = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    high = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.greatest(wide, F.lit(0.0)) * F.greatest(high, F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where the union is empty."""
    shared = intersection(a, b)
    return F.coalesce(F.try_divide(shared, area(a) + area(b) - shared), F.lit(0.0))


def covered(a: Column, b: Column) -> Column:
    """Share of ``a`` that lies in ``b``."""
    return F.coalesce(F.try_divide(intersection(a, b), area(a)), F.lit(0.0))


def by_score(predictions: Column) -> Column:
    """Descending score, ties by position; each with its ``place`` in the input."""
    placed = F.transform(predictions, lambda p, i: F.struct((-p["score"]).alias("order"), i.alias("place"), p.alias("box")))
    return F.array_sort(placed)


PAIRS = 1_000_000  # pairs of boxes that are worked out at once
MATCHES = "array<struct<place:int,truth:int,best:int,overlap:double>>"


class _Side:
    """The boxes of a batch of pictures, one after the other, and where each picture's begin."""

    def __init__(self, lists: pa.ListArray) -> None:
        flat, kind = lists.flatten(), lists.type.value_type
        sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        self.size = sizes.astype(np.int64)
        self.start = np.concatenate(([0], np.cumsum(self.size)))
        parts = dict(zip([kind.field(i).name for i in range(kind.num_fields)], flat.flatten()))
        self.fields = parts
        box = [parts[c].cast(pa.float64()) for c in ("x0", "y0", "x1", "y1")]
        self.x0, self.y0 = (c.fill_null(-np.inf).to_numpy(zero_copy_only=False) for c in box[:2])
        self.x1, self.y1 = (c.fill_null(np.inf).to_numpy(zero_copy_only=False) for c in box[2:])
        with np.errstate(invalid="ignore"):
            self.area = np.maximum(self.x1 - self.x0, 0.0) * np.maximum(self.y1 - self.y0, 0.0)
        if any(c.null_count for c in box):  # a null takes no part in a least or greatest, and a side without an end has no length
            self.area[np.logical_or.reduce([c.is_null().to_numpy(zero_copy_only=False) for c in box])] = 0.0

    def score(self) -> np.ndarray:
        return self.fields["score"].cast(pa.float64()).fill_null(np.inf).to_numpy(zero_copy_only=False)


def _labels(one: pa.Array, other: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Labels of two sides as numbers; a null equals nothing."""
    both = pa.chunked_array([one, other.cast(one.type)]).combine_chunks()
    if isinstance(both, pa.ChunkedArray):
        both = pa.concat_arrays(both.chunks)
    codes = both.dictionary_encode().indices
    told = codes.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    left, right = told[: len(one)], told[len(one) :].copy()
    right[right < 0] = -2
    return left, right


def _greedy(truth: pa.ListArray, predictions: pa.ListArray, threshold: float, class_aware: bool) -> pa.Array:
    t, p = _Side(truth), _Side(predictions)
    picture = np.repeat(np.arange(len(p.size)), p.size)
    many = t.size[picture]  # labels that each prediction meets
    upto = np.cumsum(many)
    n = len(picture)
    best, overlap = np.full(n, -1, np.int64), np.full(n, np.nan)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    t_label, p_label = _labels(t.fields["label"], p.fields["label"]) if class_aware else (None, None)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
        times = many[at:end]
        i = np.repeat(np.arange(at, end), times)
        starts = np.cumsum(times) - times
        j = np.arange(len(i)) - np.repeat(starts - t.start[picture[at:end]], times)
        with np.errstate(invalid="ignore", divide="ignore"):
            wide, high = np.fmin(p.x1[i], t.x1[j]) - np.maximum(p.x0[i], t.x0[j]), np.fmin(p.y1[i], t.y1[j]) - np.maximum(p.y0[i], t.y0[j])
            shared = np.where(np.isposinf(wide), 0.0, np.maximum(wide, 0.0)) * np.where(np.isposinf(high), 0.0, np.maximum(high, 0.0))
            union = p.area[i] + t.area[j] - shared
            u = np.where(union == 0, 0.0, shared / union)
        some = np.flatnonzero(times)
        if len(some):
            most = np.fmax.reduceat(u, starts[some])
            same = np.flatnonzero((u == np.repeat(most, times[some])) | np.isnan(np.repeat(most, times[some])))
            best[at + some] = (j - t.start[picture[i]])[same[np.searchsorted(same, starts[some])]]
            overlap[at + some] = most
        good = u >= threshold
        if class_aware:
            good &= p_label[i] == t_label[j]
        good = np.flatnonzero(good)
        found.append((i[good], j[good], u[good]))
        at = end
    order = np.lexsort((np.arange(n), -p.score() if n else np.zeros(0), picture))
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    taken = np.full(n, -1, np.int64)
    if found:
        i, j, u = (np.concatenate(c) for c in zip(*found))
        turn = np.lexsort((j, -u, rank[i]))
        free, open_ = bytearray(b"\1") * len(t.x0), bytearray(b"\1") * n
        for a, b in zip(i[turn].tolist(), j[turn].tolist()):
            if open_[a] and free[b]:
                open_[a] = free[b] = 0
                taken[a] = b - t.start[picture[a]]
    place = order - p.start[picture[order]]
    no_best = best[order] < 0
    columns = [pa.array(place.astype(np.int32)), pa.array(taken[order].astype(np.int32)), pa.array(best[order].astype(np.int32), mask=no_best), pa.array(overlap[order], mask=no_best)]
    rows = pa.StructArray.from_arrays(columns, names=["place", "truth", "best", "overlap"])
    return pa.ListArray.from_arrays(pa.array(p.start.astype(np.int32)), rows, mask=predictions.is_null())


def matched(truth: Column, predictions: Column, threshold: float = 0.5, class_aware: bool = True) -> Column:
    """As :func:`greedy_match`, with the ``best`` label of any class that each prediction overlaps most, and that ``overlap``; null
    where there are no labels. The boxes of a batch of pictures are worked out together."""

    @F.arrow_udf(MATCHES)
    def match(t: pa.Array, p: pa.Array) -> pa.Array:
        return _greedy(t, p, threshold, class_aware)

    return match(truth, predictions)


def greedy_match(truth: Column, predictions: Column, threshold: float = 0.5, class_aware: bool = True) -> Column:
    """For each prediction in order of score: ``place``, and the ``truth`` index it takes (-1 for none).

    A prediction takes the unused truth box with the largest overlap of ``threshold`` or more, ties to the lower index.
    """
    return F.transform(matched(truth, predictions, threshold, class_aware), lambda m: F.struct(m["place"].alias("place"), m["truth"].alias("truth")))


def nms(boxes: Column, threshold: float = 0.5, class_aware: bool = True) -> Column:
    """Places of boxes that survive, in order of score: none overlaps a better one of its class beyond the threshold."""
    none = F.array().cast("array<struct<order:double,place:int,box:struct<x0:double,y0:double,x1:double,y1:double,label:int,score:double>>>")

    def keep(kept: Column, p: Column) -> Column:
        hidden = F.exists(kept, lambda k: (iou(k["box"], p["box"]) > threshold) & ((k["box"]["label"] == p["box"]["label"]) if class_aware else F.lit(True)))
        return F.when(hidden, kept).otherwise(F.concat(kept, F.array(p)))

    return F.aggregate(by_score(boxes), none, keep, lambda kept: F.transform(kept, lambda k: k["place"]))


def matches(df: DataFrame, truth: str = "truth", predicted: str = "predicted", threshold: float = 0.5, class_aware: bool = True) -> DataFrame:
    """One row for each prediction (``label, score, truth_label`` or null) and each missed truth (``label`` null)."""
    keys = [c for c in df.columns if c not in (truth, predicted)]
    m = df.withColumn("__m", greedy_match(F.col(truth), F.col(predicted), threshold, class_aware))
    hits = F.transform("__m", lambda x: F.struct(F.element_at(predicted, x["place"] + 1)["label"].alias("label"), F.element_at(predicted, x["place"] + 1)["score"].alias("score"), F.when(x["truth"] >= 0, F.element_at(truth, x["truth"] + 1)["label"]).alias("truth_label")))
    missed = F.transform(F.filter(F.transform(truth, lambda t, i: F.struct(i.alias("i"), t.alias("t"))), lambda x: ~F.exists("__m", lambda y: y["truth"] == x["i"])), lambda x: F.struct(F.lit(None).cast("int").alias("label"), F.lit(None).cast("double").alias("score"), x["t"]["label"].alias("truth_label")))
    return m.select(*keys, F.inline(F.concat(hits, missed)))


def accepted(df: DataFrame, truth: str, predicted: str, *, replace_overlap: float = 0.5, name: str = "accepted") -> DataFrame:
    """``df`` with the labels as they are once predictions are accepted, one after the other.

    A prediction takes the place of the label it overlaps most, by ``replace_overlap`` or more and of any class (ties to the later
    one), unless a prediction did before; else it is added behind. Other fields of a label stay; an added one has none. A null
    array is empty.
    """
    kind = df.schema[truth].dataType
    fields = kind.elementType.fieldNames()
    types = {f.name: f.dataType for f in kind.elementType}
    shape = ("x0", "y0", "x1", "y1", "label")
    start = F.transform(F.coalesce(F.col(truth), F.array().cast(kind)), lambda t: F.struct(t.alias("o"), F.lit(False).alias("done")))

    def fresh(p: Column, old: Column | None) -> Column:
        return F.struct(*[(p[f].cast(types[f]) if f in shape else old[f] if old is not None else F.lit(None).cast(types[f])).alias(f) for f in fields])

    def take(state: Column, p: Column) -> Column:
        told = F.transform(state, lambda s, i: F.struct(F.when(~s["done"], iou(s["o"], p)).alias("u"), i.alias("i")))
        best = F.array_max(F.filter(told, lambda x: x["u"] >= replace_overlap))["i"]
        replaced = F.transform(state, lambda s, i: F.when(i == best, F.struct(fresh(p, s["o"]).alias("o"), F.lit(True).alias("done"))).otherwise(s))
        return F.when(best.isNull(), F.concat(state, F.array(F.struct(fresh(p, None).alias("o"), F.lit(False).alias("done"))))).otherwise(replaced)

    own = F.coalesce(F.col(predicted), F.array().cast(df.schema[predicted].dataType))
    return df.withColumn(name, F.transform(F.aggregate(own, start, take), lambda s: s["o"]))


def object_metrics(objects: Column, width: Column, height: Column, *, small_area: float = 1024, border: float = 1) -> Column:
    """``objects, small, border, max_iou, fault``: objects of a picture without crowds, those of less than ``small_area``, those within
    ``border`` of the picture's edge, and the largest overlap of two. A picture without a size, and one with an empty box or one
    with a number that isn't finite, has a ``fault`` and no counts. A null array has no objects.
    """
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    own = F.filter(F.coalesce(objects, F.array()), lambda o: ~F.coalesce(o["iscrowd"].cast("boolean"), F.lit(False)))
    wrong = F.exists(own, lambda o: bad(o["x0"]) | bad(o["y0"]) | bad(o["x1"]) | bad(o["y1"]) | (o["x1"] <= o["x0"]) | (o["y1"] <= o["y0"]))
    fault = F.when(~F.coalesce((width > 0) & (height > 0), F.lit(False)), "no size").when(wrong, "empty or unreal box")
    pairs = F.flatten(F.transform(own, lambda a, i: F.transform(F.slice(own, i + 2, F.greatest(F.size(own), F.lit(1))), lambda b: iou(a, b))))
    at_edge = lambda o: (o["x0"] <= border) | (o["y0"] <= border) | (o["x1"] >= width - border) | (o["y1"] >= height - border)
    count = lambda when: F.when(fault.isNull(), F.size(F.filter(own, when)).cast("long"))
    return F.struct(
        count(lambda o: F.lit(True)).alias("objects"),
        count(lambda o: area(o) < small_area).alias("small"),
        count(at_edge).alias("border"),
        F.when(fault.isNull(), F.coalesce(F.array_max(pairs), F.lit(0.0))).alias("max_iou"),
        fault.alias("fault"),
    )


def confusion(matched: DataFrame) -> DataFrame:
    """Counts by (true label, predicted label); null on one side is missed or background."""
    return matched.groupBy(F.col("truth_label"), F.col("label").alias("predicted_label")).agg(F.count("*").alias("n"))


def per_class(scored: DataFrame, support: DataFrame, confidence: float) -> DataFrame:
    """``label, support, predictions, precision, recall, f1`` at a confidence; ``scored`` has ``label, score, hit``."""
    shown = scored.filter(F.col("score") >= confidence)
    counts = shown.groupBy("label").agg(F.count("*").alias("predictions"), F.count_if("hit").alias("tp"))
    both = support.join(counts, "label", "full_outer").fillna(0, ["support", "predictions", "tp"])
    tp, fp, fn = F.col("tp"), F.col("predictions") - F.col("tp"), F.col("support") - F.col("tp")
    return both.select("label", "support", "predictions", ratio(tp, F.col("predictions")).alias("precision"), ratio(tp, F.col("support")).alias("recall"), f1_score(tp, fp, fn).alias("f1"))


def average_precision(scored: DataFrame, support: DataFrame, order: list[str]) -> DataFrame:
    """101-point interpolated precision of each label; NaN without truth, 0 without predictions.

    The grid is numpy's ``linspace(0, 1, 101)``. ``order`` breaks ties of score. Counts along the scores are worked out over
    ranges of (label, score), so a class of any size uses all tasks; the envelope is needed at the points of the grid only.
    """
    import numpy as np

    placed = ranges.in_ranges(scored.join(F.broadcast(support), "label"), ["label", F.desc("score"), *order], "precision", keep=["label", "support", "hit"])  # one row for each class
    ranked = ranges.along(placed, {"k": ("number", None), "tp": ("sum", F.col("hit").cast("int"))}, ["label"])
    curve = ranked.select("label", (F.col("tp") / F.col("support")).alias("recall"), (F.col("tp") / F.col("k")).alias("precision"))
    grid = F.array(*[F.lit(float(g)) for g in np.linspace(0, 1, 101)])

    def passed(recall):
        """How many grid points are not above a recall: those below its hundredth, and the two that rounding decides."""
        k = F.floor(recall * 100).cast("int")
        at = lambda i: F.coalesce((F.try_element_at(grid, i) <= recall).cast("int"), F.lit(0))
        return k + at(k + 1) + at(k + 2)

    # the best precision of the rows that pass as many points, then of those that pass as many or more: the envelope at each point
    best = curve.groupBy("label", passed(F.col("recall")).alias("points")).agg(F.max("precision").alias("precision"))  # 102 rows a class at most
    back = Window.partitionBy("label").orderBy(F.desc("points"))
    steps = best.select("label", (F.col("points") - F.coalesce(F.lead("points").over(back), F.lit(0))).alias("points"), F.max("precision").over(back.rowsBetween(Window.unboundedPreceding, 0)).alias("envelope"))
    total = steps.groupBy("label").agg((F.sum(F.col("points") * F.col("envelope")) / 101).alias("ap"))
    return support.join(total, "label", "left").select("label", F.when(F.col("support") == 0, F.lit(float("nan"))).otherwise(F.coalesce("ap", F.lit(0.0))).alias("ap"))


def sweep(scored: DataFrame, positives: int, thresholds: list[float]) -> DataFrame:
    """Pooled counts and measures at each threshold, in one pass."""
    rows = scored.select("score", "hit", F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("confidence")).filter(F.col("score") >= F.col("confidence"))
    counts = rows.groupBy("confidence").agg(F.count_if("hit").alias("tp"), F.count_if(~F.col("hit")).alias("fp"))
    fn = F.lit(positives) - F.col("tp")
    return counts.select("confidence", "tp", "fp", ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.lit(positives)).alias("recall"), f1_score(F.col("tp"), F.col("fp"), fn).alias("f1"))


def best_threshold(curve: DataFrame) -> DataFrame:
    """Largest f1, ties to the lowest confidence."""
    return curve.agg(F.max_by("confidence", F.struct("f1", -F.col("confidence"))).alias("confidence"))


def class_balance(counts: DataFrame, few: int = 50, rare: float = 0.02) -> DataFrame:
    """``label, n, share`` of the largest class, and a verdict."""
    share = F.col("n") / F.max("n").over(Window.partitionBy(F.lit(0)))
    return counts.withColumn("share", share).withColumn("verdict", F.when(F.col("n") < few, "too few").when(F.col("share") < rare, "rare").otherwise("ok"))
