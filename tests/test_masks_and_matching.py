"""Masks, similarities and matching against plain loops."""

from __future__ import annotations

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sampleworks.functions import masks
from sampleworks.operators import matching, similarity


def _plain_outline(flat, width, height):
    """The rule of the COCO tools, point by point: pixels of a polygon as a 0/1 array."""
    xs = [int(5 * v + 0.5) for v in flat[::2]]
    ys = [int(5 * v + 0.5) for v in flat[1::2]]
    points = []
    for j in range(len(xs)):
        k = (j + 1) % len(xs)
        a, b = (xs[j], ys[j]), (xs[k], ys[k])
        wide, high = abs(a[0] - b[0]), abs(a[1] - b[1])
        turned = (a[0] > b[0]) if wide >= high else (a[1] > b[1])
        low, top = (b, a) if turned else (a, b)
        n = max(wide, high)
        line = []
        for d in range(n + 1):
            if wide >= high:
                line.append((low[0] + d, int(low[1] + ((top[1] - low[1]) / n * d if n else 0) + 0.5)))
            else:
                line.append((int(low[0] + (top[0] - low[0]) / n * d + 0.5), low[1] + d))
        points += line[::-1] if turned else line
    toggles = []
    for (x0, y0), (x1, y1) in zip(points, points[1:]):
        if x0 != x1:
            column = (min(x0, x1) + 0.5) / 5 - 0.5
            if column == int(column) and 0 <= column <= width - 1:
                row = min(max((min(y0, y1) + 0.5) / 5 - 0.5, 0), height)
                toggles.append(int(column) * height + int(np.ceil(row)))
    flat_mask = np.zeros(width * height + 1, int)
    for t in toggles:
        flat_mask[t] ^= 1
    return (np.cumsum(flat_mask[:-1]) % 2).reshape(height, width, order="F")


def _array(counts, width, height):
    return np.repeat(np.arange(len(counts)) % 2, counts).reshape(height, width, order="F")


def _polygon(draw, width, height, n=None):
    return [draw.uniform(-3, (width, height)[i % 2] + 3) if draw.random() < 0.7 else float(draw.randrange(0, (width, height)[i % 2] + 1)) for i in range(2 * (n or draw.randrange(3, 9)))]


def test_outlines_equal_the_plain_raster():
    draw = random.Random(1)
    for _ in range(400):
        width, height = draw.randrange(1, 40), draw.randrange(1, 40)
        flat = [max(0.0, v) for v in _polygon(draw, width, height)]
        found = masks.counts_of(masks.outline_runs(flat, width, height), width * height)
        assert (_array(found, width, height) == _plain_outline(flat, width, height)).all()


def test_an_aligned_rectangle_covers_its_pixels():
    runs = masks.outline_runs([2, 1, 6, 1, 6, 4, 2, 4], 10, 5)
    wanted = np.zeros((5, 10), int)
    wanted[1:4, 2:6] = 1
    assert (_array(masks.counts_of(runs, 50), 10, 5) == wanted).all()


def test_strings_go_both_ways_and_as_published():
    draw = random.Random(2)
    for _ in range(300):
        counts = np.array([draw.choice([0, 1, 5, 31, 32, 1000, 10**6, 10**8]) for _ in range(draw.randrange(0, 12))], np.int64)
        assert masks.decompressed(masks.compressed(counts)).tolist() == counts.tolist()
    assert masks.compressed(np.array([6, 1, 40, 4, 5, 4, 5, 4, 21])) == "61X13mN000`0"  # of the COCO tools' own description
    for wrong in ("\x00", "a", "6~"):
        with pytest.raises(masks.MaskError):
            masks.decompressed(wrong)


def test_runs_equal_arrays():
    draw = random.Random(3)
    for _ in range(200):
        width, height = draw.randrange(1, 20), draw.randrange(1, 20)
        parts = [masks.outline_runs([abs(v) for v in _polygon(draw, width, height)], width, height) for _ in range(3)]
        a, b, c = (_array(masks.counts_of(p, width * height), width, height) for p in parts)
        assert masks.shared_area(parts[0], parts[1]) == (a & b).sum()
        assert (_array(masks.counts_of(masks.union_of(parts), width * height), width, height) == (a | b | c)).all()
        assert (_array(masks.counts_of(masks.without(parts[0], parts[1]), width * height), width, height) == (a & ~b & 1)).all()


def test_masks_in_a_frame(spark):
    box = "[[1, 1, 4, 1, 4, 3, 1, 3]]"
    rows = [
        (1, box, 6, 5),
        (2, json.dumps({"size": [5, 6], "counts": [6, 2, 3, 2, 3, 2, 12]}), 6, 5),
        (3, json.dumps({"size": [5, 6], "counts": masks.compressed(np.array([6, 2, 3, 2, 3, 2, 12]))}), 6, 5),
        (4, None, 6, 5), (5, "[]", 6, 5), (6, box, None, 5), (7, "[[1, 1, 4, 1]]", 6, 5), (8, '{"size": [6, 5], "counts": [30]}', 6, 5), (9, '{"size": [5, 6], "counts": [29]}', 6, 5), (10, "{", 6, 5), (11, "7", 6, 5),
        (12, '{"size": [5, 6], "counts": [31, -1]}', 6, 5), (13, "[[1, 1, 4, NaN, 4, 3]]", 6, 5), (14, box, 100_000, 100_000),
    ]
    df = spark.createDataFrame(rows, "id int, segmentation string, width int, height int")
    found = {r.id: r for r in df.select("id", masks.mask(F.col("segmentation"), F.col("width"), F.col("height")).alias("m")).select("id", "m.*").collect()}
    for i in (1, 2, 3):
        assert (found[i].counts, found[i].area, found[i].fault) == ([6, 2, 3, 2, 3, 2, 12], 6, None)
    for i in (4, 5):
        assert (found[i].counts, found[i].area) == ([30], 0)
    assert all(found[i].fault and found[i].counts is None for i in range(6, 15))
    pixels = spark.createDataFrame([(1, [0, 0, 0, 0, 0, 0, 0, 1, 1, 1, 0, 0, 0, 1, 1, 1, 0, 0] + [0] * 12, 5), (2, None, 5), (3, [1, 1], 1), (4, [1] * 3, 2)], "id int, pixels array<int>, height int")
    counted = {r.id: r.c for r in pixels.select("id", masks.counts_of_pixels(F.col("pixels"), F.col("height")).alias("c")).collect()}
    assert counted == {1: [6, 2, 3, 2, 3, 2, 12], 2: None, 3: [0, 2], 4: None}
    again = pixels.select("id", masks.decompressed_mask(masks.compressed_mask(masks.counts_of_pixels(F.col("pixels"), F.col("height")))).alias("c"))
    assert {r.id: r.c for r in again.collect()} == counted


def test_rasters_equal_a_plain_loop(spark):
    draw = random.Random(4)
    rows, wanted = [], {}
    for n in range(60):
        width, height = draw.randrange(4, 14), draw.randrange(4, 14)
        objects, fault, pixels = [], None, np.full((height, width), -1)
        crowded = np.zeros((height, width), bool)
        for _ in range(draw.randrange(0, 4)):
            flat = [abs(v) for v in _polygon(draw, width, height, 3)]
            label, crowd = draw.choice([0, 1, 1, 2]), int(draw.random() < 0.2)
            objects.append((json.dumps([flat]), label, crowd))
            ones = _plain_outline(flat, width, height).astype(bool)
            if not ones.any():
                fault = fault or "pixel"
            elif crowd:
                crowded |= ones
            elif label == 2:
                fault = fault or "unknown"
            else:
                if (ones & (pixels >= 0) & (pixels != label)).any():
                    fault = fault or "overlap"
                pixels[ones] = label
        pixels[crowded] = -1
        wanted[n] = fault, pixels
        rows.append((n, objects, width, height))
    df = spark.createDataFrame(rows, "id int, objects array<struct<segmentation:string,label:int,iscrowd:int>>, width int, height int")
    seen = 0
    for r in df.select("id", "width", "height", masks.class_raster(F.col("objects"), F.col("width"), F.col("height"), [0, 1]).alias("r")).select("*", "r.*").collect():
        fault, pixels = wanted[r.id]
        assert bool(r.fault) == bool(fault)
        if not fault:
            flat = np.full(r.width * r.height, -1)
            for run in r.runs:
                flat[run.start : run.end] = run.label
            assert (flat.reshape(r.height, r.width, order="F") == pixels).all()
            seen += 1
    assert 10 < seen < 60


BOX = "array<struct<x0:double,y0:double,x1:double,y1:double,label:int,score:double,iscrowd:int>>"


def _pictures(n=40, objects=12, seed=6):
    draw = random.Random(seed)

    def box(i):
        x, y = draw.randrange(0, 30), draw.randrange(0, 30)
        return (float(x), float(y), x + draw.choice([4.0, 6.0, 8.0]), y + draw.choice([4.0, 6.0]), draw.randrange(2), draw.choice([0.3, 0.5, 0.9]), int(draw.random() < 0.15))

    rows = [(i, [box(k) for k in range(draw.randrange(objects))], [box(k) for k in range(draw.randrange(objects))]) for i in range(n)]
    return [*rows, (1000, None, [box(0)]), (1001, [box(0)], None), (1002, [], [])]


@pytest.mark.parametrize("aware", [True, False])
def test_matching_over_pairs_equals_matching_in_arrays(spark, aware):
    df = spark.createDataFrame(_pictures(), f"id int, truth {BOX}, predicted {BOX}").repartition(3)
    plain = df.filter("truth IS NOT NULL AND predicted IS NOT NULL").select("id", F.inline(matching.greedy_match(F.col("truth"), F.col("predicted"), 0.3, aware))).filter("truth >= 0")
    own = similarity.objects(df, "predicted", ["id"], "p", "score", "label")
    labels = similarity.objects(df, "truth", ["id"], "t", F.col("o")["label"].alias("truth_label"))
    pairs = similarity.similarities(df, "detect", ["id"], least=0.3).join(own, ["id", "p"]).join(labels, ["id", "t"])
    found = similarity.match(pairs.filter("label = truth_label") if aware else pairs, ["id"], threshold=0.3)
    assert sorted((r.id, r.p, r.t) for r in found.collect()) == sorted((r.id, r.place, r.truth) for r in plain.collect())


def _plain_counts(similar, truth, predicted, skipped, covered):
    order = sorted(range(len(predicted)), key=lambda i: (-predicted[i]["score"], i))
    free = {j for j in range(len(truth)) if not skipped[j]}
    hit = set()
    for i in order:
        options = [(-similar[i][j], j) for j in free if truth[j]["label"] == predicted[i]["label"] and similar[i][j] >= 0.5]
        if options:
            free.remove(min(options)[1])
            hit.add(i)
    ignored = {i for i in range(len(predicted)) if i not in hit and any(skipped[j] and covered[i][j] >= 0.5 for j in range(len(truth)))}
    fp, fn = len(predicted) - len(hit) - len(ignored), len(free)
    return len(hit), fp, fn


def test_masks_are_matched_as_arrays_would_be(spark):
    draw = random.Random(8)
    rows, wanted = [], {}
    for n in range(25):
        width, height = 20, 16

        def shape(i):
            x, y = draw.randrange(0, 14), draw.randrange(0, 10)
            w, h = draw.choice([4, 5, 6]), draw.choice([4, 6])
            return {"segmentation": json.dumps([[x, y, x + w, y, x + w, y + h, x, y + h]]), "label": draw.randrange(2), "score": draw.choice([0.2, 0.8]), "iscrowd": int(draw.random() < 0.2)}

        truth, own = [shape(i) for i in range(draw.randrange(6))], [shape(i) for i in range(draw.randrange(7))]
        a, b = ([_plain_outline(json.loads(o["segmentation"])[0], width, height).astype(bool) for o in side] for side in (own, truth))
        similar = [[(x & y).sum() / (x | y).sum() for y in b] for x in a]
        covered = [[(x & y).sum() / x.sum() for y in b] for x in a]
        wanted[n] = _plain_counts(similar, truth, own, [bool(o["iscrowd"]) for o in truth], covered)
        rows.append((n, width, height, truth, own))
    kind = "array<struct<segmentation:string,label:int,score:double,iscrowd:int>>"
    df = spark.createDataFrame(rows, f"id int, width int, height int, truth {kind}, predicted {kind}")
    found = {r.id: (r.tp, r.fp, r.fn) for r in similarity.task_counts(df, "segment", ["id"]).collect()}
    assert found == wanted


def test_oriented_boxes_and_poses(spark):
    import math

    def corners(cx, cy, w, h, angle):
        c, s = math.cos(angle), math.sin(angle)
        return [v for dx, dy in ((-1, -1), (1, -1), (1, 1), (-1, 1)) for v in (cx + dx * w / 2 * c - dy * h / 2 * s, cy + dx * w / 2 * s + dy * h / 2 * c)]

    def turned(flat):
        return [v for i in (6, 4, 2, 0) for v in flat[i : i + 2]]

    truth = [{"corners": corners(0, 0, 4, 2, 0)}, {"corners": turned(corners(0, 0, 4, 2, 0))}, {"corners": corners(50, 0, 1, 1, 0)}]
    own = [{"corners": corners(0, 0, 4, 2, math.pi / 2)}, {"corners": corners(1, 0, 4, 2, 0)}]
    p, t, score, covered = similarity.oriented_pairs(own, truth, {})
    table = {(int(i), int(j)): (round(float(s), 6), round(float(c), 6)) for i, j, s, c in zip(p, t, score, covered)}
    assert table == {(0, 0): (round(4 / 12, 6), 0.5), (0, 1): (round(4 / 12, 6), 0.5), (1, 0): (0.6, 0.75), (1, 1): (0.6, 0.75)}
    person = {"keypoints": [0.0, 0.0, 2.0, 10.0, 0.0, 1.0, 5.0, 5.0, 0.0], "x0": 0.0, "y0": 0.0, "x1": 10.0, "y1": 10.0, "label": 0, "iscrowd": 0, "score": 1.0}
    hidden = {**person, "keypoints": [0.0] * 9}
    guess = {**person, "keypoints": [0.0, 3.0, 1.0, 10.0, 0.0, 1.0, 99.0, 99.0, 1.0], "score": 0.9}
    p, t, score, _ = similarity.keypoint_pairs([guess], [hidden, person], {})
    assert (p.tolist(), t.tolist()) == ([0], [1])
    assert score[0] == pytest.approx((math.exp(-9 / ((2 / 3) ** 2 * 100 * 2)) + 1) / 2)
    kind = "array<struct<keypoints:array<double>,x0:double,y0:double,x1:double,y1:double,label:int,iscrowd:int,score:double>>"
    as_row = lambda o: tuple(o[c] for c in ("keypoints", "x0", "y0", "x1", "y1", "label", "iscrowd", "score"))
    df = spark.createDataFrame([(1, [as_row(person), as_row(hidden)], [as_row(guess), as_row(guess)]), (2, [], [as_row(guess)])], f"id int, truth {kind}, predicted {kind}")
    # the second guess lies in the hidden person's box, so it is ignored
    assert {r.id: (r.tp, r.fp, r.fn, r.f1) for r in similarity.task_counts(df, "pose", ["id"]).collect()} == {1: (1, 0, 0, 1.0), 2: (0, 1, 0, 0.0)}


def test_a_picture_of_thousands_of_objects(spark):
    n = 3000
    boxes = [(float(3 * i), 0.0, 3.0 * i + 2, 2.0, 0, (i % 97) / 97, 0) for i in range(n)]
    df = spark.createDataFrame([(1, boxes, boxes)], f"id int, truth {BOX}, predicted {BOX}")
    assert [(r.tp, r.fp, r.fn) for r in similarity.task_counts(df, "detect", ["id"]).collect()] == [(n, 0, 0)]
