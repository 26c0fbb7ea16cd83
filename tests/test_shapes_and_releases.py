"""Smallest rectangles, accepted predictions, object metrics and augmented geometry against plain versions."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sampleworks.functions import geometry
from sampleworks.operators import augmenting, matching


def _plain_smallest(flat):
    points = np.array(flat).reshape(-1, 2)
    best = math.inf
    for a in points:
        for b in points:
            if (a != b).any():
                t = math.atan2(b[1] - a[1], b[0] - a[0])
                turned = points @ np.array([[math.cos(t), -math.sin(t)], [math.sin(t), math.cos(t)]])
                best = min(best, float(np.prod(turned.max(axis=0) - turned.min(axis=0))))
    return best


def test_smallest_rectangles(spark):
    draw = random.Random(1)
    rows = [(i, [draw.uniform(0, 10) for _ in range(2 * draw.randrange(3, 9))], 10.0, 10.0) for i in range(60)]
    rows += [(100, [0.0, 0, 4, 0, 4, 2, 0, 2], 10.0, 10.0), (101, [0.0, 0, 1, 1, 2, 2], 9.0, 9.0), (102, None, 9.0, 9.0), (103, [0.0, 0, 1], 9.0, 9.0), (104, [0.0, 0, 20, 0, 20, 5], 10.0, 10.0)]
    df = spark.createDataFrame([(i, f if f is None else list(map(float, f)), w, h) for i, f, w, h in rows], "id int, flat array<double>, w double, h double")
    found = {r.id: (r.r, r.b) for r in df.select("id", geometry.smallest_rectangle(F.col("flat")).alias("r"), geometry.smallest_rectangle(F.col("flat"), F.col("w"), F.col("h")).alias("b")).collect()}
    for i, flat, _, _ in rows[:61]:
        for corners in found[i]:
            q = np.array(corners).reshape(4, 2)
            edge = np.roll(q, -1, axis=0) - q
            assert abs((edge[0] * edge[1]).sum()) < 1e-6 * (1 + np.abs(edge).max() ** 2)
            own = np.array(flat).reshape(-1, 2)
            inside = [((e[0] * (own[:, 1] - c[1]) - e[1] * (own[:, 0] - c[0])) >= -1e-6).all() for e, c in zip(edge, q)]
            assert all(inside)
        area = lambda corners: np.linalg.norm(np.array(corners[2:4]) - corners[:2]) * np.linalg.norm(np.array(corners[4:6]) - corners[2:4])
        assert area(found[i][0]) == pytest.approx(_plain_smallest(flat))
        assert area(found[i][1]) >= area(found[i][0]) - 1e-9
        assert min(found[i][1]) >= 0 and max(found[i][1]) <= 10
    assert [found[i] for i in (101, 102, 103)] == [(None, None)] * 3
    assert found[104][0] is not None and found[104][1] is None


LABEL = "array<struct<x0:double,y0:double,x1:double,y1:double,label:int,note:string>>"
GUESS = "array<struct<x0:double,y0:double,x1:double,y1:double,label:int,score:double>>"


def _iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    shared = max(w, 0) * max(h, 0)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - shared
    return shared / union if union else 0.0


def test_predictions_are_accepted_one_by_one(spark):
    draw = random.Random(2)
    box = lambda: (lambda x, y: (x, y, x + draw.choice([3.0, 4.0]), y + draw.choice([3.0, 4.0])))(float(draw.randrange(6)), float(draw.randrange(3)))
    rows, wanted = [], {}
    for n in range(60):
        truth = [(*box(), draw.randrange(3), f"n{k}") for k in range(draw.randrange(5))]
        own = [(*box(), draw.randrange(3), 0.5) for _ in range(draw.randrange(5))]
        state, done = [list(t) for t in truth], set()
        for p in own:
            best, most = -1, 0.5
            for i, t in enumerate(state):
                if i not in done and _iou(t, p) >= most:
                    best, most = i, _iou(t, p)
            if best < 0:
                state.append([*p[:5], None])
            else:
                state[best][:5] = p[:5]
                done.add(best)
        rows.append((n, truth, own))
        wanted[n] = [tuple(s) for s in state]
    rows += [(100, None, [(0.0, 0.0, 1.0, 1.0, 1, 0.5)]), (101, [(0.0, 0.0, 1.0, 1.0, 1, "x")], None)]
    wanted |= {100: [(0.0, 0.0, 1.0, 1.0, 1, None)], 101: [(0.0, 0.0, 1.0, 1.0, 1, "x")]}
    df = spark.createDataFrame(rows, f"id int, truth {LABEL}, predicted {GUESS}")
    assert {r.id: [tuple(o) for o in r.accepted] for r in matching.accepted(df, "truth", "predicted").collect()} == wanted


def test_object_metrics(spark):
    kind = "array<struct<x0:double,y0:double,x1:double,y1:double,iscrowd:int>>"
    rows = [
        (1, [(0.0, 10.0, 20.0, 30.0, 0), (10.0, 10.0, 30.0, 30.0, 0), (40.0, 40.0, 90.0, 99.0, 0), (0.0, 0.0, 99.0, 99.0, 1)], 100, 100),
        (2, None, 100, 100), (3, [], 10, 10), (4, [(0.0, 0.0, 1.0, 1.0, 0)], None, 10), (5, [(5.0, 0.0, 5.0, 1.0, 0)], 10, 10), (6, [(float("nan"), 0.0, 5.0, 1.0, 0)], 10, 10),
    ]
    df = spark.createDataFrame(rows, f"id int, objects {kind}, width int, height int")
    found = {r.id: tuple(r)[1:] for r in df.select("id", matching.object_metrics(F.col("objects"), F.col("width"), F.col("height")).alias("m")).select("id", "m.*").collect()}
    assert found[1] == (3, 2, 2, pytest.approx(1 / 3), None)
    assert found[2] == found[3] == (0, 0, 0, 0.0, None)
    assert [found[i][4] for i in (4, 5, 6)] == ["no size", "empty or unreal box", "empty or unreal box"]


PICTURE = "image string, image_id long, _row long, width int, height int, objects array<struct<x0:double,y0:double,x1:double,y1:double,label:int,outline:array<struct<x:double,y:double>>,keypoints:array<struct<x:double,y:double,v:int>>>>"


def _pictures(spark, n=30):
    draw = random.Random(3)

    def thing():
        x, y = draw.uniform(0, 60), draw.uniform(0, 30)
        w, h = draw.uniform(5, 30), draw.uniform(5, 15)
        outline = [(x, y), (x + w, y), (x + w / 2, y + h)] if draw.random() < 0.5 else None
        return (x, y, x + w, y + h, 1, outline, [(x, y, 2), (x + w, y + h, 1), (0.0, 0.0, 0)])

    rows = [(f"i{i}", i * 3, i, 100, 50, [thing() for _ in range(draw.randrange(4))]) for i in range(n)]
    rows += [("none", 500, n, 100, 50, None), ("sizeless", 501, n + 1, None, 50, [thing()])]
    return rows, spark.createDataFrame(rows, PICTURE)


@pytest.mark.parametrize("recipe", [{"flip": {"horizontal": True, "vertical": True}}, {"rotate90": {"clockwise": True, "counterclockwise": True, "upside_down": True}}, {"crop": {"min": 10, "max": 40}, "zoom": {"min": 80, "max": 130}}, {"rotation": {"min": -30, "max": 30}, "shear": {"horizontal": 10, "vertical": 5}, "translation": {"horizontal_min": -20, "horizontal_max": 20, "vertical_min": -10, "vertical_max": 10}}])
def test_maps_move_boxes_as_their_numbers_say(spark, recipe):
    rows, df = _pictures(spark)
    drawn = {(r["_row"], r.copy): r for r in augmenting.drawn(df, recipe, 2, seed=5).collect()}
    assert len(drawn) == 2 * 31  # the picture without a size isn't copied
    assert {k: tuple(r)[6:] for k, r in drawn.items()} == {(r["_row"], r.copy): tuple(r)[6:] for r in augmenting.drawn(df.repartition(5), recipe, 2, seed=5).collect()}
    found = {(r["_row"], r.copy): r for r in augmenting.augmented(df, recipe, 2, seed=5, flip_indices=[1, 0, 2]).collect()}
    for key, r in found.items():
        d, original = drawn[key], rows[key[0]]
        m = np.array([[d["__m0"], d["__m1"], d["__m2"]], [d["__m3"], d["__m4"], d["__m5"]]])
        assert (r.width, r.height) == (d["__w"], d["__h"]) and r.augmented_from == original[0]
        if original[5] is None:
            assert r.objects is None
            continue
        kept = iter(r.objects)
        for x0, y0, x1, y1, _, outline, keypoints in original[5]:
            q = np.array([[x0, y0, 1], [x1, y0, 1], [x1, y1, 1], [x0, y1, 1]]) @ m.T
            low, high = q.min(axis=0), q.max(axis=0)
            a, b = np.maximum(low, 0), np.minimum(high, [r.width, r.height])
            seen = np.prod(np.maximum(b - a, 0)) / np.prod(high - low)
            if outline is None:
                if abs(seen - augmenting.VISIBLE) < 1e-9 or (np.abs(b - a - 1) < 1e-9).any():
                    continue
                if seen < augmenting.VISIBLE or (b - a < 1).any():
                    continue
                o = next(kept)
                while o.outline is not None:
                    o = next(kept)
                assert (o.x0, o.y0, o.x1, o.y1) == pytest.approx((*a, *b), abs=0.006)
                points = []
                for x, y, v in keypoints:
                    p = m @ [x, y, 1]
                    ok = v > 0 and 0 <= p[0] <= r.width and 0 <= p[1] <= r.height
                    points.append((round(p[0], 2), round(p[1], 2), v) if ok else (0, 0, 0))
                if d["__flipped"]:
                    points = [points[i] for i in (1, 0, 2)]
                assert [v for k in o.keypoints for v in (k.x, k.y, k.v)] == pytest.approx([v for p in points for v in p], abs=0.011)
        for o in r.objects:
            assert -1e-9 <= o.x0 <= o.x1 <= r.width + 1e-9 and -1e-9 <= o.y0 <= o.y1 <= r.height + 1e-9
            if o.outline is not None:
                xs, ys = [p.x for p in o.outline], [p.y for p in o.outline]
                assert (min(xs), min(ys), max(xs), max(ys)) == pytest.approx((o.x0, o.y0, o.x1, o.y1), abs=0.011)


def test_a_release_keeps_originals_and_numbers_copies(spark):
    rows, df = _pictures(spark, 6)
    found = augmenting.augmented_release(df, {"flip": {"vertical": True}}, 3, seed=1).collect()
    copies = sorted((r for r in found if r.copy), key=lambda r: (r["_row"], r.copy))
    assert [r.image_id for r in copies] == list(range(502, 502 + 3 * 7))
    assert sorted(r.image for r in found if r.augmented_from is None) == sorted(r[0] for r in rows)
    assert augmenting.augmented_release(df.filter("false"), {"flip": {"vertical": True}}, 1).collect() == []
    for wrong in ({"blur": {}}, {"flip": {"horizontal": True}}):
        with pytest.raises(ValueError):
            augmenting.augmented(df, wrong, 1)
    with pytest.raises(ValueError, match="permutation"):
        augmenting.augmented(df, {}, 1, flip_indices=[1, 2, 0])
