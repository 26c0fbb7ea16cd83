"""Polygon, oriented box and keypoint expressions over arrays of coordinates."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: spreads of the seventeen keypoints of a person in the COCO tools
PERSON_SIGMAS = (0.026, 0.025, 0.025, 0.035, 0.035, 0.079, 0.079, 0.072, 0.072, 0.062, 0.062, 0.107, 0.107, 0.087, 0.087, 0.089, 0.089)


def polygon_area(flat: Column) -> Column:
    """Area of ``[x0, y0, x1, y1, ...]`` by the shoelace rule; fewer than three points have none."""
    n = F.floor(F.size(flat) / 2).cast("int")
    at = lambda i: F.element_at(flat, i + 1)
    term = lambda i: at(2 * i) * at(2 * ((i + 1) % n) + 1) - at(2 * ((i + 1) % n)) * at(2 * i + 1)
    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda s, i: s + term(i))
    return F.when(n >= 3, F.abs(total) / 2).otherwise(0.0)


def polygon_bounds(flat: Column) -> Column:
    """``x0, y0, x1, y1`` of a polygon of at least three finite points, else null."""
    xs, ys = F.filter(flat, lambda _, i: i % 2 == 0), F.filter(flat, lambda _, i: i % 2 == 1)
    finite = ~F.exists(flat, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    box = F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))
    return F.when((F.size(flat) >= 6) & finite, box)


def oriented_corners(cx: Column, cy: Column, width: Column, height: Column, angle: Column) -> Column:
    """Corners of a box turned by ``angle`` radians, as a flat array."""
    c, s = F.cos(angle), F.sin(angle)
    out = []
    for dx, dy in ((-0.5, -0.5), (0.5, -0.5), (0.5, 0.5), (-0.5, 0.5)):
        out += [cx + dx * width * c - dy * height * s, cy + dx * width * s + dy * height * c]
    return F.array(*out)


def keypoint_oks(predicted: Column, truth: Column, area: Column, sigmas: list[float] | None = None) -> Column:
    """Mean similarity of keypoints ``struct<x, y, v>``; unlabelled points (v 0) are left out, null if none is labelled.

    Without ``sigmas`` each keypoint's spread is one over their number, and of a person's seventeen one of its own.
    """
    person = F.array(*map(F.lit, PERSON_SIGMAS))
    spread = F.array(*[F.lit(float(s)) for s in sigmas]) if sigmas else None

    def one(i: Column) -> Column:
        p, t = F.element_at(predicted, i + 1), F.element_at(truth, i + 1)
        sigma = F.element_at(spread, i + 1) if spread is not None else F.when(F.size(truth) == len(PERSON_SIGMAS), F.try_element_at(person, i + 1)).otherwise(1 / F.size(truth))
        d2 = (p["x"] - t["x"]) * (p["x"] - t["x"]) + (p["y"] - t["y"]) * (p["y"] - t["y"])
        return F.when(t["v"] > 0, F.exp(-d2 / (2 * F.pow(2 * sigma, F.lit(2.0)) * F.greatest(area, F.lit(math.ulp(1.0))))))

    scores = F.filter(F.transform(F.sequence(F.lit(0), F.size(truth) - 1), one), lambda s: s.isNotNull())
    return F.when((F.size(truth) > 0) & (F.size(scores) > 0), F.aggregate(scores, F.lit(0.0), lambda a, b: a + b) / F.size(scores))


POINTS = "array<struct<x:double,y:double>>"


def smallest_rectangle(flat: Column, width: Column | None = None, height: Column | None = None) -> Column:
    """Corners ``[x0, y0, ...]`` of the smallest rectangle, turned any way, around the outline ``flat``; null without an area.

    One side lies along an edge of the convex hull, so those are tried. With a picture's size the rectangle must lie in it: the
    upright one counts too, and corners are brought into the picture from within rounding.
    """

    @F.pandas_udf("array<double>")
    def fit(outlines: pd.Series, w: pd.Series, h: pd.Series) -> pd.Series:
        found = [None if o is None else _smallest(np.asarray(o, float), None if pd.isna(a) or pd.isna(b) else (float(a), float(b))) for o, a, b in zip(outlines, w, h)]
        return pd.Series(found, dtype=object)

    none = F.lit(None).cast("double")
    return fit(flat, none if width is None else width.cast("double"), none if height is None else height.cast("double"))


def _hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, from x to y, without points on its edges."""
    points = np.unique(points, axis=0)
    chains = []
    for side in (points, points[::-1]):
        chain: list[np.ndarray] = []
        for p in side:
            while len(chain) > 1 and (chain[-1][0] - chain[-2][0]) * (p[1] - chain[-2][1]) <= (chain[-1][1] - chain[-2][1]) * (p[0] - chain[-2][0]):
                chain.pop()
            chain.append(p)
        chains += chain[:-1]
    return np.array(chains).reshape(-1, 2)


def _smallest(flat: np.ndarray, bounds: tuple[float, float] | None) -> list[float] | None:
    if len(flat) < 6 or len(flat) % 2 or not np.isfinite(flat).all():
        return None
    hull = _hull(flat.reshape(-1, 2))
    if len(hull) < 3:
        return None
    along = np.roll(hull, -1, axis=0) - hull
    if bounds is not None:
        if (hull < -1e-7).any() or (hull > np.asarray(bounds) + 1e-7).any():
            return None
        along = np.vstack((along, [1.0, 0.0]))
    along = along / np.linalg.norm(along, axis=1, keepdims=True)
    across = np.column_stack((-along[:, 1], along[:, 0]))
    u, v = hull @ along.T, hull @ across.T  # of each corner along and across each edge
    sides = np.stack((u.min(axis=0), u.max(axis=0), v.min(axis=0), v.max(axis=0)))
    area = (sides[1] - sides[0]) * (sides[3] - sides[2])
    for i in np.argsort(area, kind="stable"):
        a, b, c, d = sides[:, i]
        corners = np.array([x * along[i] + y * across[i] for x, y in ((a, c), (b, c), (b, d), (a, d))])
        if bounds is None:
            return corners.ravel().tolist()
        if (corners >= -1e-7).all() and (corners <= np.asarray(bounds) + 1e-7).all():
            return np.clip(corners, 0, bounds).ravel().tolist()
    return None


def points_of(flat: Column) -> Column:
    """``[x0, y0, x1, y1, ...]`` as an array of points."""
    n = F.floor(F.size(flat) / 2).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.element_at(flat, 2 * i + 1).alias("x"), F.element_at(flat, 2 * i + 2).alias("y")))).otherwise(F.array().cast(POINTS))


def _cut(points: Column, distance: Callable[[Column], Column]) -> Column:
    """The part of a polygon on the side of a line where the distance isn't negative."""
    ahead = F.concat(F.slice(points, 2, F.greatest(F.size(points), F.lit(1))), F.slice(points, 1, 1))

    def edge(p: Column, q: Column) -> Column:
        a, b = distance(p), distance(q)
        t = a / F.nullif(a - b, F.lit(0.0))
        met = F.struct((p["x"] + (q["x"] - p["x"]) * t).alias("x"), (p["y"] + (q["y"] - p["y"]) * t).alias("y"))
        none = F.array().cast(POINTS)
        return F.concat(F.when(a >= 0, F.array(p).cast(POINTS)).otherwise(none), F.when((a < 0) != (b < 0), F.array(met).cast(POINTS)).otherwise(none))

    return F.coalesce(F.flatten(F.zip_with(points, ahead, edge)), F.array().cast(POINTS))


def clip_to_frame(df: DataFrame, points: str, width: Column, height: Column) -> DataFrame:
    """``df`` with the polygons of ``points`` cut to their pictures; what lies outside becomes empty. One side is cut at a time."""
    sides: list[Callable[[Column], Column]] = [lambda p: p["x"], lambda p: width - p["x"], lambda p: p["y"], lambda p: height - p["y"]]
    for distance in sides:
        df = df.withColumn(points, _cut(F.col(points), distance))
    return df


def clipped(points: Column, width: Column, height: Column) -> Column:
    """A polygon cut to its picture, as one expression for use inside arrays; what lies outside becomes empty."""
    sides: list[Callable[[Column], Column]] = [lambda p: p["x"], lambda p: width - p["x"], lambda p: p["y"], lambda p: height - p["y"]]
    # each cut in a lambda of its own, so that the polygon before it is worked out once
    cut_by = lambda distance: lambda whole: _cut(whole, distance)
    for distance in sides:
        points = F.transform(F.array(points), cut_by(distance))[0]
    return points


def area_of(points: Column) -> Column:
    """Signed area of a polygon: positive where points run from x to y."""
    ahead = F.concat(F.slice(points, 2, F.greatest(F.size(points), F.lit(1))), F.slice(points, 1, 1))
    return F.coalesce(F.aggregate(F.zip_with(points, ahead, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]), F.lit(0.0), lambda s, v: s + v), F.lit(0.0)) / 2


def with_oriented_iou(df: DataFrame, predicted: str, truth: str, name: str = "iou", crowd: Column | None = None, corners: int = 4) -> DataFrame:
    """``df`` with the overlap of two convex polygons of points over their union; where ``crowd``, over the prediction's own area."""
    steps = df.withColumns({"__a": area_of(F.col(predicted)), "__b": area_of(F.col(truth))})
    turned = lambda c, area: F.when(F.col(area) < 0, F.reverse(c)).otherwise(F.col(c))
    steps = steps.withColumns({"__p": turned(predicted, "__a").cast(POINTS), "__t": turned(truth, "__b").cast(POINTS)})
    for i in range(corners):
        a, b = F.col("__t")[i], F.col("__t")[(i + 1) % corners]
        steps = steps.withColumn("__p", _cut(F.col("__p"), _side(a, b)))
    shared, own = F.abs(area_of(F.col("__p"))), F.abs(F.col("__a"))
    whole = own + F.abs(F.col("__b")) - shared
    over = F.when(crowd, own).otherwise(whole) if crowd is not None else whole
    return steps.withColumn(name, F.coalesce(F.try_divide(shared, over), F.lit(0.0))).drop("__a", "__b", "__p", "__t")


def _side(a: Column, b: Column) -> Callable[[Column], Column]:
    return lambda p: (b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"])


def runs_of(counts: Column) -> Column:
    """Half-open runs of ones of a run-length mask, whose counts alternate between zeros and ones, zeros first."""
    ends = F.slice(F.aggregate(counts, F.array(F.lit(0).cast("long")), lambda e, c: F.concat(e, F.array(F.element_at(e, -1) + c))), 2, 1 << 30)
    pairs = F.zip_with(counts, ends, lambda c, e: F.struct((e - c).alias("start"), e.alias("end")))
    return F.filter(pairs, lambda r, i: (i % 2 == 1) & (r["end"] > r["start"]))


def mask_area(counts: Column) -> Column:
    return F.aggregate(F.filter(counts, lambda _, i: i % 2 == 1), F.lit(0).cast("long"), lambda s, c: s + c)


def mask_scores(a: Column, b: Column, area_a: Column, area_b: Column) -> Column:
    """``intersection, union, iou, dice`` of two masks as runs; two empty masks agree wholly."""
    zero = F.lit(0).cast("long")
    shared = F.aggregate(a, zero, lambda s, r: s + F.aggregate(b, zero, lambda t, q: t + F.greatest(F.least(r["end"], q["end"]) - F.greatest(r["start"], q["start"]), zero)))
    union = area_a + area_b - shared
    one = lambda part, whole: F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(1.0))
    return F.struct(shared.alias("intersection"), union.alias("union"), one(shared, union).alias("iou"), one(2 * shared, area_a + area_b).alias("dice"))


def geometry_faults(instances: Column, classes: list[int] | None = None) -> Column:
    """What is wrong with instances of boxes: ``place, fault`` of each box with a number that isn't finite, corners that are
    crossed, or an unknown class."""
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))

    def fault(i: Column) -> Column:
        numbers = bad(i["x0"]) | bad(i["y0"]) | bad(i["x1"]) | bad(i["y1"])
        unknown = ~F.coalesce(i["label"].isin(*classes), F.lit(False)) if classes is not None else F.lit(False)
        return F.when(numbers, "not finite").when((i["x1"] < i["x0"]) | (i["y1"] < i["y0"]), "crossed corners").when(unknown, "unknown class")

    told = F.transform(instances, lambda i, n: F.struct(n.alias("place"), fault(i).alias("fault")))
    return F.filter(told, lambda t: t["fault"].isNotNull())


def fractions(instances: Column, width: Column, height: Column) -> Column:
    """Boxes as shares of the picture, to three places, without regions to ignore; none without a size."""
    share = lambda v, whole: F.round(v / whole, 3)
    shown = F.transform(F.filter(instances, lambda i: F.coalesce(i["iscrowd"] != 1, F.lit(True))), lambda i: F.struct(share(i["x0"], width).alias("x0"), share(i["y0"], height).alias("y0"), share(i["x1"], width).alias("x1"), share(i["y1"], height).alias("y1"), i["label"].alias("label")))
    return F.when((width > 0) & (height > 0), shown)


def box_roles(truth: Column, predicted: Column, gt_match: Column, confidence: Column) -> Column:
    """``side, place, role`` of every box: truth is matched, missed or skipped; a prediction is matched, unmatched, ignored, or hidden
    below the confidence. ``gt_match`` holds for each truth box the place of its prediction, -1 or -2."""
    own = lambda p, i: F.when(p["score"] < confidence, "hidden").when(F.coalesce(p["ignored"], F.lit(False)), "ignored").when(F.array_contains(gt_match, i), "matched").otherwise("unmatched")
    sure = lambda m: F.coalesce(F.try_element_at(predicted, m + 1)["score"] >= confidence, F.lit(False))
    shown = F.transform(truth, lambda t, i: F.element_at(gt_match, i + 1))
    labels = F.transform(shown, lambda m, i: F.struct(F.lit("truth").alias("side"), i.alias("place"), F.when(m == -2, "skipped").when((m >= 0) & sure(F.greatest(m, F.lit(0))), "matched").otherwise("missed").alias("role")))
    return F.concat(labels, F.transform(predicted, lambda p, i: F.struct(F.lit("predicted").alias("side"), i.alias("place"), own(p, i).alias("role"))))
