"""Similarities of predictions and labels by task, as a sparse table, and matching over it.

Pictures are rows with arrays ``truth`` and ``predicted``. A task's pairs are found picture by picture in Arrow batches: pairs whose
bounds don't meet are never compared, and only what is similar enough for a match leaves the task. The matcher sees rows
``(image, p, t, similarity)`` whatever they were made from: sorted by picture and by score they pass once, and each
prediction takes the most similar label that is still free, so a picture of thousands of objects is no array in memory.

Null arrays are empty, and a null picture's objects are as any other's. Objects of equal similarity go by the place of the label,
predictions of equal score by their own. Repeated pictures must be told apart by their keys. Without rows there are no pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sampleworks.functions import masks
from sampleworks.functions.geometry import PERSON_SIGMAS
from sampleworks.functions.values import ratio

PAIRS_AT_ONCE = 1_000_000  # pairs of bounds that are held against each other at once
TILE = 512  # predictions that are held against all labels of a picture at once


def _meeting(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of boxes ``x0, y0, x1, y1`` that have a point in common, in tiles."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, len(a), TILE):
        x = a[at : at + TILE, None]
        p, t = np.nonzero((x[..., 0] <= b[None, :, 2]) & (b[None, :, 0] <= x[..., 2]) & (x[..., 1] <= b[None, :, 3]) & (b[None, :, 1] <= x[..., 3]))
        left.append(p + at)
        right.append(t)
    return np.concatenate(left), np.concatenate(right)


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.divide(part, whole, out=np.zeros(len(part)), where=whole > 0)


def box_pairs(predicted: list[dict], truth: list[dict], picture: dict) -> tuple[np.ndarray, ...]:
    """``p, t``, intersection over union, and share of the prediction inside, for boxes ``x0, y0, x1, y1``."""
    a, b = (np.array([[o["x0"], o["y0"], o["x1"], o["y1"]] for o in side], float).reshape(-1, 4) for side in (predicted, truth))
    a = np.column_stack((np.minimum(a[:, :2], a[:, 2:]), np.maximum(a[:, :2], a[:, 2:])))  # corners may come crossed
    p, t = _meeting(a, b)
    shared = np.prod(np.maximum(np.minimum(a[p, 2:], b[t, 2:]) - np.maximum(a[p, :2], b[t, :2]), 0), axis=1)
    own, other = (np.prod(np.maximum(x[:, 2:] - x[:, :2], 0), axis=1) for x in (a, b))
    return p, t, _share(shared, own[p] + other[t] - shared), _share(shared, own[p])


def mask_pairs(predicted: list[dict], truth: list[dict], picture: dict) -> tuple[np.ndarray, ...]:
    """As :func:`box_pairs`, for objects with a ``segmentation``; the picture's ``width`` and ``height`` are needed."""
    wide, high = int(picture.get("width") or 0), int(picture.get("height") or 0)
    a, b = ([masks.mask_runs(o["segmentation"], wide, high) for o in side] for side in (predicted, truth))
    if any(not len(runs[0]) for runs in b):
        raise masks.MaskError("a label without a pixel")
    span = lambda runs: np.array([[r[0][0], 0, r[1][-1] - 1, 0] if len(r[0]) else [0, 1, -1, -1] for r in runs], np.int64).reshape(-1, 4)
    p, t = _meeting(span(a), span(b))
    shared = np.array([masks.shared_area(a[i], b[j]) for i, j in zip(p, t)], float)
    own, other = (np.array([masks.area_of(r) for r in side], float) for side in (a, b))
    return p, t, _share(shared, own[p] + other[t] - shared), _share(shared, own[p])


Points = list[tuple[float, float]]


def _signed_area(points: Points) -> float:
    return sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(points, [*points[1:], *points[:1]])) / 2


def _inside(points: Points, start: tuple[float, float], end: tuple[float, float]) -> Points:
    """The part of a convex outline on the left of the line from ``start`` to ``end``."""
    sides = [(end[0] - start[0]) * (y - start[1]) - (end[1] - start[1]) * (x - start[0]) for x, y in points]
    kept: Points = []
    for (p, a), (q, b) in zip(zip(points, sides), [*zip(points[1:], sides[1:]), *zip(points[:1], sides[:1])]):
        if a >= 0:
            kept.append(p)
        if (a < 0) != (b < 0):
            kept.append((p[0] + (q[0] - p[0]) * a / (a - b), p[1] + (q[1] - p[1]) * a / (a - b)))
    return kept


def oriented_pairs(predicted: list[dict], truth: list[dict], picture: dict) -> tuple[np.ndarray, ...]:
    """As :func:`box_pairs`, for objects with four ``corners`` in a flat array."""
    a, b = ([list(zip(o["corners"][::2], o["corners"][1::2])) for o in side] for side in (predicted, truth))
    a, b = ([q if _signed_area(q) >= 0 else q[::-1] for q in side] for side in (a, b))
    span = lambda side: np.array([[*map(min, zip(*q)), *map(max, zip(*q))] for q in side], float).reshape(-1, 4)
    p, t = _meeting(span(a), span(b))
    shared = np.zeros(len(p))
    for k, (i, j) in enumerate(zip(p.tolist(), t.tolist())):
        left = a[i]
        for start, end in zip(b[j], [*b[j][1:], b[j][0]]):
            left = _inside(left, start, end)
        shared[k] = abs(_signed_area(left)) if len(left) > 2 else 0.0
    own, other = (np.array([abs(_signed_area(q)) for q in side]) for side in (a, b))
    return p, t, _share(shared, own[p] + other[t] - shared), _share(shared, own[p])


def keypoint_pairs(predicted: list[dict], truth: list[dict], picture: dict, sigmas: Sequence[float] | None = None) -> tuple[np.ndarray, ...]:
    """``p, t``, similarity of keypoints and zeros, for ``keypoints`` ``[x, y, v, ...]`` and labels with an ``area`` or a box.

    Labels without a visible point take no part. The spread of each keypoint is one over their number, a person's seventeen
    have spreads of their own.
    """
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
    shown = [j for j, o in enumerate(truth) if o["keypoints"] is not None and any(v > 0 for v in list(o["keypoints"])[2::3])]
    if not shown or not predicted:
        return none
    b = np.array([truth[j]["keypoints"] for j in shown], float).reshape(len(shown), -1, 3)
    a = np.array([o["keypoints"] for o in predicted], float).reshape(len(predicted), -1, 3)
    k = b.shape[1]
    if a.shape[1] != k:
        raise ValueError("predictions and labels have other keypoints")
    spread = np.array(sigmas if sigmas is not None else PERSON_SIGMAS if k == 17 else np.full(k, 1 / k), float)
    box = lambda o: (o["x1"] - o["x0"]) * (o["y1"] - o["y0"])
    area = np.array([truth[j].get("area") or box(truth[j]) for j in shown], float)
    out = []
    for at in range(0, len(a), TILE):
        apart = ((a[at : at + TILE, None, :, :2] - b[None, :, :, :2]) ** 2).sum(axis=3)
        each = np.exp(-apart / ((2 * spread) ** 2 * area[:, None] * 2)) * (b[None, :, :, 2] > 0)
        out.append(each.sum(axis=2) / (b[:, :, 2] > 0).sum(axis=1))
    score = np.concatenate(out)
    p, t = np.nonzero(score > 0)
    return p, np.array(shown)[t], score[p, t], np.zeros(len(p))


class _Objects:
    """The objects of a batch of pictures, one after the other."""

    def __init__(self, lists: pa.ListArray) -> None:
        flat, kind = lists.flatten(), lists.type.value_type
        self.size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.picture = np.repeat(np.arange(len(self.size)), self.size)
        self.fields = dict(zip([kind.field(i).name for i in range(kind.num_fields)], flat.flatten()))

    def numbers(self, name: str) -> np.ndarray:
        return self.fields[name].cast(pa.float64()).to_numpy(zero_copy_only=False)


def _near(own: _Objects, labelled: _Objects, a: np.ndarray, b: np.ndarray, area: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within a picture whose bounds ``x0, y0, x1, y1`` share at least ``least`` of the prediction's ``area``: of others neither
    measure can reach it."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    many = labelled.size[own.picture]
    upto, at = np.cumsum(many), 0
    while at < len(many):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
        times = many[at:end]
        i = np.repeat(np.arange(at, end), times)
        j = np.arange(len(i)) - np.repeat(np.cumsum(times) - times - labelled.start[own.picture[at:end]], times)
        wide, high = np.minimum(a[i, 2], b[j, 2]) - np.maximum(a[i, 0], b[j, 0]), np.minimum(a[i, 3], b[j, 3]) - np.maximum(a[i, 1], b[j, 1])
        kept = (wide >= 0) & (high >= 0) & (wide * high >= least * area[i] * (1 - 1e-9))
        left.append(i[kept])
        right.append(j[kept])
        at = end
    return np.concatenate(left), np.concatenate(right)


def _corners(side: _Objects) -> np.ndarray:
    """Corners of oriented boxes as points, turned so that their area isn't negative."""
    points = side.fields["corners"].flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(side.picture), -1, 2)
    return np.where((_areas(points) < 0)[:, None, None], points[:, ::-1], points)


def _areas(points: np.ndarray, size: np.ndarray | None = None) -> np.ndarray:
    """Signed areas of outlines; of those with ``size`` points what is behind them repeats the first."""
    if size is not None:
        points = np.where((np.arange(points.shape[1]) < size[:, None])[..., None], points, points[:, :1])
    ahead = np.roll(points, -1, axis=1)
    return (points[..., 0] * ahead[..., 1] - ahead[..., 0] * points[..., 1]).sum(axis=1) / 2


def _shared_outlines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Areas that pairs of convex outlines have in common: each of ``a`` is cut by the lines along the edges of ``b``."""
    points, size = a, np.full(len(a), a.shape[1])
    for k in range(b.shape[1]):
        start, end = b[:, k], b[:, (k + 1) % b.shape[1]]
        wide = points.shape[1]
        side = (end[:, 0] - start[:, 0])[:, None] * (points[..., 1] - start[:, 1:]) - (end[:, 1] - start[:, 1])[:, None] * (points[..., 0] - start[:, :1])
        place = np.arange(wide)
        behind = np.where(place + 1 < size[:, None], place + 1, 0)
        q, other = np.take_along_axis(points, behind[..., None], 1), np.take_along_axis(side, behind, 1)
        real = place < size[:, None]
        with np.errstate(invalid="ignore", divide="ignore"):
            met = points + (q - points) * (side / (side - other))[..., None]
        kept = np.stack((real & (side >= 0), real & ((side < 0) != (other < 0))), axis=2).reshape(len(a), -1)
        made = np.stack((points, met), axis=2).reshape(len(a), -1, 2)
        size = kept.sum(axis=1)
        order = np.argsort(~kept, axis=1, kind="stable")[:, : max(wide + 1, int(size.max(initial=0)))]
        points = np.take_along_axis(made, order[..., None], 1)
        points = np.where((np.arange(points.shape[1]) < size[:, None])[..., None], points, 0.0)
    return np.where(size > 2, np.abs(_areas(points, size)), 0.0)


def _batch_pairs(task: str, own: _Objects, labelled: _Objects, width: np.ndarray, height: np.ndarray, least: float) -> tuple[np.ndarray, ...]:
    """As :data:`PAIRS`, for all pictures of a batch at once; places are those in the batch."""
    if task == "segment":
        runs, bounds, held = [], [], []
        for side, other in ((own, labelled), (labelled, own)):
            used = other.size[side.picture] > 0  # a picture without the other side isn't looked at
            texts = [t if u else None for t, u in zip(side.fields["segmentation"].to_pylist(), used.tolist())]
            w, h = (np.where(used, size[side.picture], 1) for size in (width, height))
            found, base, faults = masks.many_runs(texts, w, h)
            if faults:
                raise masks.MaskError(next(iter(faults.values())))
            runs.append((found, base, h, used))
        base = max(base for _, base, _, _ in runs)
        moved = []
        for (start, end), old, h, used in runs:
            shift = start // old * (base - old)
            start, end, of = start + shift, end + shift, start // old
            moved.append((start, end))
            area = masks.areas((start, end), base, len(h))
            at, until, high = start - of * base, end - of * base - 1, h[of]
            one = at // high == until // high  # else a run goes over whole columns
            low, top = np.where(one, at % high, 0), np.where(one, until % high + 1, high)
            box = np.zeros((len(h), 4))
            box[:, :2], box[:, 2:] = np.inf, -np.inf
            for c, values, least_of in ((0, at // high, True), (1, low, True), (2, until // high + 1, False), (3, top, False)):
                (np.minimum if least_of else np.maximum).at(box[:, c], of, values)
            bounds.append(box)
            held.append(area)
        if (held[1][runs[1][3]] == 0).any():
            raise masks.MaskError("a label without a pixel")
        i, j = _near(own, labelled, *bounds, held[0], least)
        shared = masks.shared_areas(*moved, base, i, j).astype(float)
        held = [h.astype(float) for h in held]
    elif task == "obb":
        a, b = _corners(own), _corners(labelled)
        held = [np.abs(_areas(c)) for c in (a, b)]
        i, j = _near(own, labelled, *[np.concatenate((c.min(axis=1), c.max(axis=1)), axis=1) for c in (a, b)], held[0], least)
        shared = _shared_outlines(a[i], b[j])
    else:
        a, b = (np.column_stack([side.numbers(c) for c in ("x0", "y0", "x1", "y1")]) for side in (own, labelled))
        a = np.column_stack((np.minimum(a[:, :2], a[:, 2:]), np.maximum(a[:, :2], a[:, 2:])))  # corners may come crossed
        held = [np.prod(np.maximum(c[:, 2:] - c[:, :2], 0), axis=1) for c in (a, b)]
        i, j = _near(own, labelled, a, b, held[0], least)
        shared = np.prod(np.maximum(np.minimum(a[i, 2:], b[j, 2:]) - np.maximum(a[i, :2], b[j, :2]), 0), axis=1)
    return i, j, _share(shared, held[0][i] + held[1][j] - shared), _share(shared, held[0][i])


PAIRS: dict[str, Callable[..., tuple[np.ndarray, ...]]] = {"detect": box_pairs, "segment": mask_pairs, "obb": oriented_pairs, "pose": keypoint_pairs}


def similarities(df: DataFrame, task: str, keys: Sequence[str], *, truth: str = "truth", predicted: str = "predicted", least: float = 0.0, sigmas: Sequence[float] | None = None) -> DataFrame:
    """``keys, p, t, similarity, covered`` for pairs that are at all alike: a prediction's place, a label's, how alike they
    are, and the share of the prediction that lies in the label. Pairs below ``least`` in both measures are left out."""
    if task not in PAIRS:
        raise ValueError(f"unknown task: {task}")
    further = {"sigmas": sigmas} if task == "pose" else {}
    size = [c for c in ("width", "height") if c in df.columns]
    kinds = {f.name: f.dataType for f in df.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, places, labels = ([np.zeros(0, np.int64)] for _ in range(3))
            alike, inside = [np.zeros(0)], [np.zeros(0)]
            sizes = [batch.column(c).to_pylist() for c in size]
            for i, (own, labelled) in enumerate(zip(batch.column(predicted).to_pylist(), batch.column(truth).to_pylist())):
                if not own or not labelled:
                    continue
                p, t, score, covered = PAIRS[task](own, labelled, {c: values[i] for c, values in zip(size, sizes)}, **further)
                kept = (score >= least) | (covered >= least)
                rows.append(np.full(kept.sum(), i))
                for held, values in zip((places, labels, alike, inside), (p, t, score, covered)):
                    held.append(values[kept])
            take = pa.array(np.concatenate(rows))
            found = [pa.array(np.concatenate(places).astype(np.int32)), pa.array(np.concatenate(labels).astype(np.int32)), pa.array(np.concatenate(alike)), pa.array(np.concatenate(inside))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(take) for k in keys), *found], names=[*keys, "p", "t", "similarity", "covered"])

    schema = T.StructType([*(T.StructField(k, kinds[k]) for k in keys), T.StructField("p", T.IntegerType()), T.StructField("t", T.IntegerType()), T.StructField("similarity", T.DoubleType()), T.StructField("covered", T.DoubleType())])
    return df.select(*keys, *size, truth, predicted).mapInArrow(run, schema)


def objects(df: DataFrame, column: str, keys: Sequence[str], place: str, *fields: Column | str) -> DataFrame:
    """One row for each object of an array: ``keys``, its place, and fields of it by name."""
    shown = [F.col("o")[f].alias(f) if isinstance(f, str) else f for f in fields]
    return df.select(*keys, F.posexplode(column).alias(place, "o")).select(*keys, place, *shown)


def match(pairs: DataFrame, keys: Sequence[str], *, threshold: float = 0.5) -> DataFrame:
    """``keys, p, t, similarity``: what each prediction takes. ``pairs`` has ``keys, p, t, score, similarity``.

    Rows pass in order of picture, score and similarity, and a label is taken once: state is the taken labels of one picture.
    """
    shown = pairs.filter(F.col("similarity") >= threshold).select(*keys, "p", "t", "score", "similarity")
    ordered = shown.repartition(*keys).sortWithinPartitions(*keys, F.desc("score"), "p", F.desc("similarity"), "t")
    n = len(keys)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        picture, last, taken = None, None, set()
        for batch in batches:
            kept = []
            for i, (p, t, *own) in enumerate(zip(*(c.to_pylist() for c in (batch.column(n), batch.column(n + 1), *batch.columns[:n])))):
                if own != picture:
                    picture, last, taken = own, None, set()
                if p != last and t not in taken:
                    taken.add(t)
                    last = p
                    kept.append(i)
            yield batch.take(pa.array(kept, pa.int64())).select([*keys, "p", "t", "similarity"])

    kinds = {f.name: f for f in shown.schema}
    return ordered.mapInArrow(take, T.StructType([kinds[c] for c in (*keys, "p", "t", "similarity")]))


def task_counts(
    df: DataFrame, task: str, keys: Sequence[str], *, truth: str = "truth", predicted: str = "predicted", threshold: float = 0.5, ignore_overlap: float = 0.5, class_aware: bool = True, sigmas: Sequence[float] | None = None
) -> DataFrame:
    """``keys, tp, fp, fn, precision, recall, f1`` of each picture, for objects with ``label``, ``score`` (predictions) and ``iscrowd`` (labels).

    Crowds are matched by nothing, and an unmatched prediction that lies in one by ``ignore_overlap`` is no false positive; of poses
    labels without a visible point are left out too, and a prediction's box counts. Without anything to divide by the measures are 1.
    """
    if task == "pose":
        counts = _shuffled_counts(df, list(keys), truth, predicted, threshold, ignore_overlap, class_aware, sigmas)
    elif task in PAIRS:
        counts = _batch_counts(df, task, list(keys), truth, predicted, threshold, ignore_overlap, class_aware)
    else:
        raise ValueError(f"unknown task: {task}")
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    precision, recall = ratio(tp, tp + fp, 1.0), ratio(tp, tp + fn, 1.0)
    return counts.select("*", precision.alias("precision"), recall.alias("recall"), F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0)).alias("f1"))


def _batch_counts(df: DataFrame, task: str, keys: list[str], truth: str, predicted: str, threshold: float, ignore_overlap: float, class_aware: bool) -> DataFrame:
    """``keys, tp, fp, fn``; pictures are counted where they are, a batch at once, and nothing is shuffled."""
    size = [c for c in ("width", "height") if c in df.columns]
    kinds = {f.name: f for f in df.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own, labelled = _Objects(batch.column(predicted)), _Objects(batch.column(truth))
            width, height = (batch.column(c).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False) if c in size else np.zeros(batch.num_rows, np.int64) for c in ("width", "height"))
            i, j, score, covered = _batch_pairs(task, own, labelled, width, height, min(threshold, ignore_overlap))
            skipped = labelled.fields["iscrowd"].cast(pa.bool_()).fill_null(False).to_numpy(zero_copy_only=False)
            good = (score >= threshold) & ~skipped[j]
            if class_aware:
                both = pa.concat_arrays([own.fields["label"], labelled.fields["label"].cast(own.fields["label"].type)])
                named = both.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                of_own, of_label = named[: len(own.picture)], named[len(own.picture) :]
                good &= (of_own[i] == of_label[j]) & (of_own[i] >= 0)
            p, t, alike = i[good], j[good], score[good]
            sure = own.fields["score"].cast(pa.float64()).fill_null(-np.inf).to_numpy(zero_copy_only=False)
            sure = np.where(np.isnan(sure), np.inf, sure)  # as Spark orders them
            turn = np.lexsort((t, -alike, p, -sure[p], own.picture[p]))
            free, waits = (bytearray(b"\1") * len(side.picture) for side in (labelled, own))
            for a, b in zip(p[turn].tolist(), t[turn].tolist()):
                if waits[a] and free[b]:
                    waits[a] = free[b] = 0
            open_ = np.frombuffer(waits, bool)
            hidden = np.zeros(len(own.picture), bool)
            hidden[i[skipped[j] & (covered >= ignore_overlap)]] = True
            n = batch.num_rows
            tp = np.bincount(own.picture[~open_], minlength=n)
            fp = np.bincount(own.picture[open_ & ~hidden], minlength=n)
            fn = np.bincount(labelled.picture[~skipped], minlength=n) - tp
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *(pa.array(c.astype(np.int64)) for c in (tp, fp, fn))], names=[*keys, "tp", "fp", "fn"])

    schema = T.StructType([*(kinds[k] for k in keys), *(T.StructField(c, T.LongType()) for c in ("tp", "fp", "fn"))])
    return df.select(*keys, *[c for c in size if c not in keys], truth, predicted).mapInArrow(run, schema)


def _shuffled_counts(df: DataFrame, keys: list[str], truth: str, predicted: str, threshold: float, ignore_overlap: float, class_aware: bool, sigmas: Sequence[float] | None) -> DataFrame:
    """``keys, tp, fp, fn`` of poses, from tables of objects and pairs."""
    skipped = F.coalesce(F.col("o")["iscrowd"].cast("boolean"), F.lit(False)) | ~_any_visible(F.col("o")["keypoints"])
    labels = objects(df, truth, keys, "t", F.col("o")["label"].alias("truth_label"), skipped.alias("skipped"))
    own = objects(df, predicted, keys, "p", "label", "score")
    found = similarities(df, "pose", keys, truth=truth, predicted=predicted, least=min(threshold, ignore_overlap), sigmas=sigmas)
    placed = found.join(labels, [*keys, "t"]).join(own, [*keys, "p"])
    same = (F.col("label") == F.col("truth_label")) if class_aware else F.lit(True)
    matched = match(placed.filter(~F.col("skipped") & same), keys, threshold=threshold)
    boxes = similarities(df, "detect", keys, truth=truth, predicted=predicted, least=ignore_overlap)
    regions = boxes.join(labels.filter("skipped"), [*keys, "t"]).filter(F.col("covered") >= ignore_overlap)
    ignored = regions.select(*keys, "p").distinct().join(matched, [*keys, "p"], "left_anti")
    parts = [
        labels.filter(~F.col("skipped")).select(*keys, F.lit("truth").alias("part")),
        own.select(*keys, F.lit("own").alias("part")),
        matched.select(*keys, F.lit("matched").alias("part")),
        ignored.select(*keys, F.lit("ignored").alias("part")),
        df.select(*keys, F.lit("picture").alias("part")),
    ]
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    counts = rows.groupBy(*keys).agg(*[F.count_if(F.col("part") == c).alias(c) for c in ("truth", "own", "matched", "ignored")])
    tp = F.col("matched")
    return counts.select(*keys, tp.alias("tp"), (F.col("own") - tp - F.col("ignored")).alias("fp"), (F.col("truth") - tp).alias("fn"))


def _any_visible(keypoints: Column) -> Column:
    visible = F.filter(keypoints, lambda v, i: (i % 3 == 2) & (v > 0))
    return F.coalesce(F.size(visible) > 0, F.lit(False))
