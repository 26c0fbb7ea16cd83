"""Masks and matches of a whole batch against those of one at a time."""

from __future__ import annotations

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sampleworks.functions import masks
from sampleworks.operators import matching, similarity


def test_masks_of_a_batch_equal_those_of_each():
    draw = random.Random(3)
    width, height = (np.array([draw.randrange(1, 30) for _ in range(200)]) for _ in "wh")
    shape = lambda: [draw.choice([draw.uniform(-4, 32), float(draw.randrange(30))]) for _ in range(2 * draw.randrange(3, 7))]
    texts = [draw.choice([None, "[]", "{", "[[1, 2]]"]) if i % 17 == 0 else json.dumps([shape() for _ in range(draw.randrange(1, 4))]) for i in range(200)]
    runs, base, faults = masks.many_runs(texts, width, height)
    counts, sizes = masks.many_counts(runs, base, width * height)
    string, lengths = masks.many_compressed(counts, sizes)
    back, numbers, bad = masks.many_decompressed(string, lengths)
    assert not bad.any() and (numbers == sizes).all() and (back == counts).all()
    ends, upto = np.cumsum(sizes), np.cumsum(lengths)
    alone = []
    for i, text in enumerate(texts):
        try:
            alone.append(masks.mask_runs(text, int(width[i]), int(height[i])))
        except masks.MaskError as error:
            assert faults[i] == str(error)
            alone.append(masks.EMPTY)
            continue
        want = masks.counts_of(alone[-1], int(width[i] * height[i]))
        assert counts[ends[i] - sizes[i] : ends[i]].tolist() == want.tolist()
        assert string[upto[i] - lengths[i] : upto[i]].tobytes().decode() == masks.compressed(want)
    i, j = (np.array([draw.randrange(200) for _ in range(400)]) for _ in "ij")
    assert masks.shared_areas(runs, runs, base, i, j).tolist() == [masks.shared_area(alone[a], alone[b]) for a, b in zip(i, j)]


def test_broken_strings_of_a_batch_spoil_no_other():
    texts = ["123", "", "~", "o", "12`", "PPYo1", "oooooooooo1", "4"]
    raw = [t.encode() for t in texts]
    counts, sizes, bad = masks.many_decompressed(np.frombuffer(b"".join(raw), np.uint8), np.array([*map(len, raw)]))
    ends = np.cumsum(sizes)
    for i, text in enumerate(texts):
        try:
            want = masks.decompressed(text).tolist()
        except masks.MaskError:
            want = None
        assert (None if bad[i] else counts[ends[i] - sizes[i] : ends[i]].tolist()) == want


def test_shared_pixels_of_columns(spark):
    df = spark.createDataFrame([([2, 3, 5], [0, 4, 6]), ([10], [0, 10]), (None, [1, 2]), ([0, 4], [1, 2, 1])], "a array<long>, b array<long>")
    assert [r[0] for r in df.select(masks.shared_pixels(F.col("a"), F.col("b"))).collect()] == [2, 0, None, 2]


def test_matches_of_columns_are_counted_without_a_shuffle(spark):
    box = lambda x: {"segmentation": json.dumps([[x, 2, x + 5, 2, x + 5, 7, x, 7]]), "label": 1}
    rows = [(1, 40, 30, [{**box(3), "iscrowd": False}, {**box(20), "iscrowd": True}], [{**box(4), "score": 0.9}, {**box(3), "score": 0.5}, {**box(21), "score": 0.4}]), (2, 40, 30, None, [{**box(1), "score": 0.2}])]
    shape = "struct<segmentation:string,label:int"
    df = spark.createDataFrame(rows, f"id long, width int, height int, truth array<{shape},iscrowd:boolean>>, predicted array<{shape},score:double>>")
    found = similarity.task_counts(df, "segment", ["id"])
    assert "Exchange" not in found._jdf.queryExecution().toString()
    assert sorted((r.id, r.tp, r.fp, r.fn) for r in found.collect()) == [(1, 1, 1, 0), (2, 0, 1, 0)]


def test_cut_outlines_equal_those_of_each_pair():
    draw = np.random.default_rng(2)
    around = lambda n: np.stack([np.array([[c + r * np.cos(t + k * np.pi / 2), d + r * np.sin(t + k * np.pi / 2)] for k in range(4)]) for c, d, r, t in zip(*draw.uniform(0, 4, (4, n)))])
    a, b = around(200), around(200)
    want = []
    for p, q in zip(a.tolist(), b.tolist()):
        for start, end in zip(q, [*q[1:], q[0]]):
            p = similarity._inside(p, start, end)
        want.append(abs(similarity._signed_area(p)) if len(p) > 2 else 0.0)
    assert similarity._shared_outlines(a, b) == pytest.approx(want)


def test_boxes_of_a_batch_match_as_in_a_loop(spark):
    draw = random.Random(5)
    box = lambda: {"x0": (x := draw.randrange(9) * 1.0), "y0": (y := draw.randrange(9) * 1.0), "x1": x + draw.randrange(7), "y1": y + draw.randrange(7), "label": draw.choice([1, 2, None]), "score": draw.randrange(5) / 4}
    rows = [(i, [box() for _ in range(draw.randrange(6))], [box() for _ in range(draw.randrange(6))]) for i in range(150)] + [(150, None, [box()]), (151, [box()], [])]
    kind = "array<struct<x0:double,y0:double,x1:double,y1:double,label:int,score:double>>"
    df = spark.createDataFrame(rows, f"id int, truth {kind}, predicted {kind}")

    def iou(a, b):
        area = lambda o: (o["x1"] - o["x0"]) * (o["y1"] - o["y0"])
        shared = max(min(a["x1"], b["x1"]) - max(a["x0"], b["x0"]), 0) * max(min(a["y1"], b["y1"]) - max(a["y0"], b["y0"]), 0)
        return shared / (area(a) + area(b) - shared) if area(a) + area(b) > shared else 0.0

    for aware in (True, False):
        found = {r.id: [tuple(m) for m in r.m] for r in df.select("id", matching.matched(F.col("truth"), F.col("predicted"), 0.4, aware).alias("m")).collect()}
        for i, truth, own in rows:
            truth, want, taken = truth or [], [], set()
            for place in sorted(range(len(own)), key=lambda k: (-own[k]["score"], k)):
                u = [iou(own[place], t) for t in truth]
                options = [(-v, k) for k, v in enumerate(u) if v >= 0.4 and k not in taken and (not aware or own[place]["label"] is not None and own[place]["label"] == truth[k]["label"])]
                took = min(options)[1] if options else -1
                taken.add(took)
                best = min((-v, k) for k, v in enumerate(u))[1] if u else None
                want.append((place, took, best, u[best] if u else None))
            assert found[i] == want
