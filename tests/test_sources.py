"""Versions, formats, samples and findings on small inputs."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from sampleworks.functions import geometry
from sampleworks.operators import findings, sampling
from sampleworks.sources import formats, tables
from sampleworks.streaming import logs


def test_versions_are_written_once(spark, tmp_path):
    root = f"file://{tmp_path}"
    df = tables.numbered(spark.createDataFrame([(c,) for c in "dbca"], "name string"), "name")
    assert [(r._row, r.name) for r in df.orderBy("_row").collect()] == list(enumerate("abcd"))
    first = tables.write_version(tables.with_weight(df), tables.table_path(root, "p", "d", "initial"))
    second = tables.write_version(df, tables.table_path(root, "p", "d", "next"), parents=[first])
    with pytest.raises(Exception, match="exist"):
        tables.write_version(df, first)
    assert tables.read_version(spark, first).count() == 4
    bodies = tables.catalog(spark, root)
    assert {r.path for r in bodies.collect()} == {first, second}
    assert [tuple(r) for r in tables.edges(bodies).collect()] == [(second, 0, first)] or [(r.child, r.parent) for r in tables.edges(bodies).collect()] == [(second, first)]


def test_coco_round_trip(spark, tmp_path):
    doc = {
        "images": [{"id": 1, "file_name": "a.jpg", "width": 10, "height": 20}, {"id": 2, "file_name": "b.jpg", "width": 10, "height": 20}],
        "annotations": [{"id": 5, "image_id": 1, "category_id": 3, "bbox": [1, 2, 3, 4]}],
        "categories": [{"id": 3, "name": "cat"}],
    }
    (tmp_path / "a.json").write_text(json.dumps(doc))
    df = formats.read_coco(spark, str(tmp_path / "a.json"))
    rows = {r.image_id: r.instances for r in df.collect()}
    assert rows[2] == [] and (rows[1][0].x1, rows[1][0].y1, rows[1][0].label) == (4.0, 6.0, 3)
    classes = spark.createDataFrame([(3, "cat")], "id long, name string")
    lines = [json.loads(r.value) for r in formats.coco_document(df, classes).collect()]
    assert [x["annotations"][0]["bbox"] for x in lines if x["annotations"]] == [[1.0, 2.0, 3.0, 4.0]]
    assert sorted(r["class"] for r in formats.box_rows(df, classes).collect()) == ["", "cat"]
    doc["annotations"][0]["image_id"] = 9
    (tmp_path / "b.json").write_text(json.dumps(doc))
    with pytest.raises(Exception, match="unknown image"):
        formats.read_coco(spark, str(tmp_path / "b.json")).collect()


def test_log_ignores_a_torn_tail_only(spark, tmp_path):
    (tmp_path / "good.jsonl").write_text('{"k": "a", "n": 1}\n{"k": "b", "n": 2}\n{"k": "c", "n')
    assert [r.k for r in formats.read_jsonl(spark, str(tmp_path / "good.jsonl"), "k string, n int").orderBy("seq").collect()] == ["a", "b"]
    (tmp_path / "bad.jsonl").write_text('{"k": "a", "n": 1}\n{"k": \n{"k": "c", "n": 3}\n')
    with pytest.raises(Exception, match="bad line"):
        formats.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "k string, n int").collect()


def test_image_folder_and_manifest(spark, tmp_path):
    for name in ("dog/x.jpg", "cat/y.png", "cat/notes.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    assert sorted((r["class"], r.label) for r in formats.image_folder(spark, str(tmp_path)).collect()) == [("cat", 0), ("dog", 1)]
    manifest = formats.media_digests(spark, str(tmp_path)).persist()
    assert manifest.count() == 3
    now = manifest.withColumn("sha256", F.when(F.col("path").endswith("x.jpg"), "other").otherwise(F.col("sha256"))).filter("NOT path LIKE '%notes%'")
    assert sorted(r.state for r in formats.verify_media(now, manifest).collect()) == ["changed", "missing", "same"]


def test_log_fold_as_a_stream(spark):
    log = spark.createDataFrame([(i % 5, i, f"s{i}") for i in range(40)], "image int, seq long, status string")
    assert {r.image: r.status for r in logs.fold_once(log, "image", "seq", "status").collect()} == {i: f"s{35 + i}" for i in range(5)}


def test_samples(spark):
    df = spark.range(1000).withColumnRenamed("id", "_row").withColumn("weight", (F.col("_row") % 4).cast("double"))
    assert sampling.weighted(df, 200).filter("weight = 0").count() == 0
    assert sampling.repeated(df).count() == 1500
    mean, axes = sampling.principal_axes(spark.createDataFrame([([float(i), 2.0 * i],) for i in range(9)], "v array<double>"), "v")
    assert mean == [4.0, 8.0] and axes[0] == pytest.approx([5**-0.5, 2 * 5**-0.5]) and axes[2] == [0.0, 0.0]


def test_findings_of_one_image(spark):
    box = "struct<x0:double,y0:double,x1:double,y1:double,label:int"
    truth = [(0.0, 0.0, 10.0, 10.0, 1), (20.0, 20.0, 30.0, 30.0, 1), (80.0, 80.0, 90.0, 90.0, 2)]
    predicted = [(0.0, 0.0, 10.0, 10.0, 2, 0.9), (20.0, 20.0, 24.0, 30.0, 1, 0.8), (50.0, 50.0, 60.0, 60.0, 1, 0.7), (70.0, 0.0, 75.0, 5.0, 1, 0.2)]
    df = spark.createDataFrame([(0, e, truth, predicted) for e in range(4)], f"image int, epoch int, truth array<{box}>>, predicted array<{box},score:double>>")
    found = findings.round_findings(df, ["image", "epoch"])
    assert {(r.rule, r.label, r.predicted) for r in found.collect()} == {("wrong_class", 1, 2), ("loose_box", 1, 1), ("missing_label", None, 1), ("missed", 1, None), ("missed", 2, None)}
    again = {r.rule: r.score for r in findings.recurring(found, 4).collect()}
    assert again["wrong_class"] == pytest.approx(0.9) and set(again) == {"wrong_class", "loose_box", "missing_label", "missed"}
    plain = df.limit(1).select("truth", F.transform("predicted", lambda p: p.dropFields("score")).alias("after"))
    changed = findings.label_diff(plain, "truth", "after").drop("truth", "after").first()
    assert changed.asDict() == {"identical": 0, "relabelled": 1, "moved": 0, "unchanged": 0, "added": 3, "removed": 2}


def test_geometry(spark):
    df = spark.createDataFrame([([0.0, 0.0, 4.0, 0.0, 4.0, 3.0],), ([0.0, 0.0],)], "p array<double>")
    assert [r.a for r in df.select(geometry.polygon_area(F.col("p")).alias("a")).collect()] == [6.0, 0.0]
    corners = df.limit(1).select(geometry.oriented_corners(*[F.lit(float(v)) for v in (0, 0, 4, 2, 0)]).alias("c")).first().c
    assert corners == [-2.0, -1.0, 2.0, -1.0, 2.0, 1.0, -2.0, 1.0]
