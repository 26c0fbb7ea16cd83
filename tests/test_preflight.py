"""All codes of an import's preflight in one report, on a case made for each."""

from __future__ import annotations

import json

from sampleworks.operators import versions

IMAGE = "split string, seq long, id long, file_name string, width double, height double"
BOX = "split string, id long, image_id long, category_id long, x double, y double, w double, h double"


def test_each_code_has_its_case(spark):
    good = (10.0, 10.0, 20.0, 20.0)
    images = [("train", i, i, f"clip_{i}.png", 100.0, 100.0) for i in range(1, 6)]
    images += [("train", 6, 7, "a_png.rf.0123456789abcdef0.jpg", 100.0, 100.0), ("train", 7, 8, "a_png.rf.1123456789abcdef0.jpg", 100.0, 100.0), ("valid", 8, 9, "a_png.rf.2123456789abcdef0.jpg", 100.0, 100.0)]
    images += [("valid", 9, 20, "walk_1.png", 100.0, 100.0), ("valid", 10, 21, "clip_9.png", 100.0, 100.0), ("valid", 11, 21, "clip_9.png", 100.0, 100.0), ("valid", 12, None, "clip_10.png", 100.0, 100.0), ("valid", 13, 23, "walk_2.png", 100.0, 100.0), ("valid", 14, 24, "walk_3.png", 100.0, 100.0), ("valid", 15, 25, "walk_4.png", 100.0, 100.0)]
    boxes = [("train", i, 1, 1, *good) for i in range(1, 301)]  # crowded
    boxes += [("train", 400, 2, 1, 90.0, 10.0, 20.0, 20.0), ("train", 401, 2, 99, *good), ("train", 402, 999, 1, *good), ("train", 403, 2, 1, 0.0, 0.0, -1.0, 5.0), ("train", 404, 2, 1, 0.0, 0.0, 0.0, 5.0), ("train", 405, 2, 1, 0.0, 0.0, 3.0, 50.0), ("train", 405, 2, 2, *good), ("train", 407, 2, 3, *good), ("train", 408, 2, 4, float("nan"), 0.0, 1.0, 1.0)]
    categories = [("train", 1, "cat"), ("valid", 1, "dog"), ("train", 2, "Ignore"), ("train", 3, "other"), ("train", 4, " CAT "), ("train", 5, "cat"), ("train", 6, "never")]
    media = [("train", 1, False, False, None, None), ("train", 2, True, False, None, None), ("train", 3, True, True, 50.0, 100.0), ("train", 4, True, True, 100.0, 100.0)]
    digests = [("train", 1, "x"), ("valid", 20, "x"), ("train", 2, "y"), ("train", 3, None)]
    documents = [("train", json.dumps({"images": [], "annotations": [], "categories": []})), ("valid", "{"), ("valid", "[]"), ("valid", json.dumps({"images": []})), ("valid", None)]
    make = spark.createDataFrame
    found = versions.preflight_report(
        make(images, IMAGE), make(boxes, BOX), make(categories, "split string, id long, name string"),
        media=make(media, "split string, id long, exists boolean, readable boolean, width double, height double"),
        digests=make(digests, "split string, id long, sha1 string"), documents=make(documents, "split string, text string"),
    )
    told = {(r.code, r.split): (r.severity, r.n) for r in found.collect()}
    expected = {
        ("annotations.orphan", "train"): ("block", 1), ("annotations.unknown_category", "train"): ("block", 1), ("annotations.invalid_bbox", "train"): ("block", 2), ("annotations.zero_area", "train"): ("warn", 1),
        ("annotations.out_of_bounds", "train"): ("warn", 1), ("annotations.tiny", "train"): ("info", 1), ("annotations.duplicate_id", "train"): ("warn", 1),
        ("images.malformed", "valid"): ("block", 1), ("images.duplicate_id", "valid"): ("block", 1), ("images.unannotated", "train"): ("info", 5), ("images.unannotated", "valid"): ("info", 6), ("images.crowded", "train"): ("info", 1),
        ("images.export_copies", "train"): ("info", 2), ("split.shared_source", "train"): ("warn", 2), ("split.shared_source", "valid"): ("warn", 1),
        ("split.shared_sequence", "train"): ("warn", 5), ("split.shared_sequence", "valid"): ("warn", 2),
        ("categories.conflict", "all"): ("block", 1), ("categories.duplicate_name", "all"): ("warn", 1), ("categories.unused", "all"): ("info", 2), ("categories.ignore_region", "all"): ("warn", 1), ("categories.catch_all", "all"): ("info", 1),
        ("media.missing", "train"): ("block", 1), ("media.unreadable", "train"): ("block", 1), ("media.size_mismatch", "train"): ("warn", 1), ("media.identical_files", "train"): ("warn", 1), ("media.identical_files", "valid"): ("warn", 1),
        ("coco.unreadable", "valid"): ("block", 4),
    }
    assert len({code for code, _ in expected}) == 24
    assert told == expected


def test_an_import_without_rows_has_no_findings(spark):
    make = lambda kind: spark.createDataFrame([], kind)
    assert versions.preflight(make(IMAGE), make(BOX), make("split string, id long, name string")).collect() == []
