"""Formats written and read again, faults in them, runs and their tables."""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sampleworks.sources import exchange, runs


def png(width: int, height: int) -> bytes:
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IEND", b"")


@pytest.fixture(scope="module")
def made(spark):
    box = "array<struct<x0:double,y0:double,x1:double,y1:double,label:int,iscrowd:int>>"
    rows = spark.createDataFrame(
        [(0, "/data/a.png", "a.png", 100.0, 50.0, [(10.0, 5.0, 30.5, 25.0, 1, 0), (0.0, 0.0, 100.0, 50.0, 0, 1), (1.0, 2.0, 3.0, 4.0, 7, 0)]), (1, "/data/b & c.png", "b & c.png", 200.0, 100.0, []), (2, "/data/d.png", "d.png", 10.0, 10.0, [(2.5, 2.5, 7.5, 7.5, 0, 0)])],
        f"_row long, image string, file_name string, width double, height double, instances {box}",
    )
    return rows, spark.createDataFrame([(0, "big cat"), (1, "dog"), (7, "<x>")], "label int, name string")


def stored(documents, folder):
    folder.mkdir()
    for r in documents.collect():
        (folder / r["name"]).write_text(r["value"])
    return f"file://{folder}"


def boxes(rows, classes):
    names = {r.label: r.name for r in classes.collect()}
    return {r.file_name: ((r.width, r.height), [(i.x0, i.y0, i.x1, i.y1, names[i.label], i.iscrowd) for i in r.instances]) for r in rows.collect()}


def test_voc_round_trip(spark, made, tmp_path):
    folder = stored(exchange.voc_documents(*made), tmp_path / "voc")
    assert boxes(*exchange.read_voc(spark, folder)) == boxes(*made)
    assert [r.name for r in exchange.read_voc(spark, folder)[1].orderBy("label").collect()] == ["dog", "big cat", "<x>"]


def test_kitti_round_trip(spark, made, tmp_path):
    folder = stored(exchange.kitti_documents(*made), tmp_path / "kitti")
    (tmp_path / "kitti" / "e.txt").write_text("DontCare 0 0 0 1 2 3 4\n\nCar 0 0 0 1 2 3 4 0\n")
    found = boxes(*exchange.read_kitti(spark, folder, spark.createDataFrame([("e", 8.0, 9.0)], "stem string, width double, height double")))
    assert found["a.png"] == ((0.0, 0.0), [(10.0, 5.0, 30.5, 25.0, "dog", 0), (1.0, 2.0, 3.0, 4.0, "<x>", 0)])
    assert found["b & c.png"] == ((0.0, 0.0), []) and found["e.png"] == ((8.0, 9.0), [(1.0, 2.0, 3.0, 4.0, "Car", 0)])
    (tmp_path / "kitti" / "f.txt").write_text("fine 0 0 0 1 2 3 4\nshort 1 2\n")
    with pytest.raises(PySparkException, match="f.txt:2: a line has eight"):
        exchange.read_kitti(spark, folder)[0].collect()


def test_yolo_round_trip(spark, made, tmp_path):
    labels = stored(exchange.yolo_documents(*made), tmp_path / "labels")
    (tmp_path / "images").mkdir()
    for name, size in (("a", (100, 50)), ("b & c", (200, 100)), ("d", (10, 10)), ("no labels", (4, 4))):
        (tmp_path / "images" / f"{name}.png").write_bytes(png(*size))
    sizes = exchange.png_sizes(spark, f"file://{tmp_path}/images")
    found = boxes(*exchange.read_yolo(spark, labels, {0: "big cat", 1: "dog", 2: "<x>"}, sizes))
    assert (tmp_path / "labels" / "a.txt").read_text().splitlines()[0] == "1 0.2025 0.3 0.205 0.4"
    assert found["a.png"][0] == (100.0, 50.0) and np.allclose(found["a.png"][1][0][:4], (10, 5, 30.5, 25)) and found["a.png"][1][1][4] == "<x>"
    assert found["no labels.png"] == ((4.0, 4.0), []) and len(found) == 4
    for line, fault in (("9 0.5 0.5 0.1 0.1", "no such class"), ("0 0.5 0.5 0.1", "class cx cy w h"), ("0 0.5 0.5 1.5 0.1", "shares"), ("x 0 0 0 0", "whole number"), ("0 nan 0 1 1", "finite")):
        (tmp_path / "labels" / "a.txt").write_text(line)
        with pytest.raises(PySparkException, match=f"a.txt:1: .*{fault}"):
            exchange.read_yolo(spark, labels, {0: "big cat"}, sizes)[0].collect()
    (tmp_path / "labels" / "a.txt").write_text("0 0.1 0.2 0.5 0.2 0.5 0.8\n")
    assert boxes(*exchange.read_yolo(spark, labels, {0: "n", 1: "m", 2: "k"}, sizes.filter("stem = 'a'"), "segment"))["a.png"][1] == [(10.0, 10.0, 50.0, 40.0, "n", 0)]
    with pytest.raises(exchange.FormatError):
        exchange.read_yolo(spark, labels, {}, sizes, "guess")


def test_boxes_csv(spark, tmp_path):
    file = tmp_path / "boxes.csv"
    file.write_text("﻿Filename,Class,XMin,YMin,XMax,YMax\nb.png,dog,1,2,3,4\na.png,cat,5,6,7,8\nb.png,cat,0,0,1,1\nc.png,,,,,\n,dog,1,1,2,2\n")
    rows, classes = exchange.read_boxes_csv(spark, f"file://{file}")
    assert boxes(rows, classes) == {"b.png": ((0.0, 0.0), [(1, 2, 3, 4, "dog", 0), (0, 0, 1, 1, "cat", 0)]), "a.png": ((0.0, 0.0), [(5, 6, 7, 8, "cat", 0)]), "c.png": ((0.0, 0.0), [])}
    assert [r.name for r in classes.orderBy("label").collect()] == ["dog", "cat"]
    file.write_text("path,label\nx.png,cat\ny.png,dog\nz.png,\n")
    sizes = spark.createDataFrame([("x", 6.0, 7.0)], "stem string, width double, height double")
    assert boxes(*exchange.read_boxes_csv(spark, f"file://{file}", sizes))["x.png"] == ((6.0, 7.0), [(0.0, 0.0, 6.0, 7.0, "cat", 0)])
    file.write_text("image,label,x0,y0,x1,y1\na,b,1,2,3,oops\n")
    with pytest.raises(PySparkException, match="no number"):
        exchange.read_boxes_csv(spark, f"file://{file}")[0].collect()
    file.write_text("a,b\n1,2\n")
    with pytest.raises(exchange.FormatError):
        exchange.read_boxes_csv(spark, f"file://{file}")


def test_other_exports(spark, made, tmp_path):
    rows, classes = made
    parts = [r["value"] for r in exchange.cvat_documents(rows, classes, "t<1>").orderBy("at").collect()]
    import xml.etree.ElementTree as ET

    root = ET.fromstring("".join(parts).partition("?>")[2])
    assert [i.get("name") for i in root.findall("image")] == ["a.png", "b & c.png", "d.png"] and root.findtext("meta/task/name") == "t<1>"
    assert [b.get("label") for b in root.find("image").findall("box")] == ["dog", "big cat", "<x>"] and root.find("image/box").get("xbr") == "30.50"
    tasks = {r["name"]: json.loads(r["value"]) for r in exchange.label_studio_tasks(rows, classes).collect()}
    assert tasks["a"]["annotations"][0]["result"][0]["value"] == {"x": 10.0, "y": 10.0, "width": 20.5, "height": 40.0, "rotation": 0, "rectanglelabels": ["dog"]}
    assert "predictions" in json.loads(exchange.label_studio_tasks(rows, classes, True).first()["value"])
    assert {r.file_name: r.folder for r in exchange.folder_of(rows, classes).collect()} == {"a.png": "dog", "b & c.png": "unlabelled", "d.png": "big_cat"}
    exchange.write_documents(exchange.kitti_documents(rows, classes), f"file://{tmp_path}/out")
    assert spark.read.text(f"file://{tmp_path}/out").filter("value <> ''").count() == 3
    images, annotations, categories = exchange.to_coco(rows, classes)
    assert images.count() == 3 and annotations.count() == 4 and annotations.join(images, annotations.image_id == images.id, "left_anti").count() == 0 and categories.count() == 3
    assert exchange.above_weight(rows.withColumn("weight", F.when(F.col("_row") > 0, F.col("_row") - 1))).count() == 1 and exchange.above_weight(rows).count() == 3


def test_detection_and_aliases(spark, tmp_path):
    kinds = lambda: {(r.format, r.split) for r in exchange.detect_formats(spark, f"file://{tmp_path}/d").collect()}
    for name in ("d/train/Annotations/a.xml", "d/valid/label_2/b.txt", "d/cat/1.png", "d/dog/2.png"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(png(1, 1))
    assert kinds() == {("voc", "train")}
    (tmp_path / "d/boxes.csv").write_text("a")
    assert kinds() == {("csv", "boxes")}
    (tmp_path / "d/train/instances_train.json").write_text("{}")
    assert kinds() == {("coco", "train")}
    known = exchange.with_alias({"DATA": "/mnt/data"}, "deep", "/mnt/data/deep")
    paths = spark.createDataFrame([("<DATA>/x",), ("/mnt/data/deep/y",), ("<OTHER>/z",), (None,)], "p string")
    found = paths.select(exchange.expanded(F.col("p"), known).alias("e"), exchange.contracted(F.col("p"), known).alias("c")).collect()
    assert [tuple(r) for r in found] == [("/mnt/data/x", "<DATA>/x"), ("/mnt/data/deep/y", "<DEEP>/y"), ("<OTHER>/z", "<OTHER>/z"), (None, None)]
    with pytest.raises(exchange.FormatError):
        exchange.with_alias(known, "data", "/elsewhere")


def test_cells(spark):
    cell = lambda text, kind, classes=(): tuple(spark.range(1).select(exchange.parsed_cell(F.lit(text).cast("string"), kind, classes).alias("c")).first().c)
    assert cell(" Yes ", "bool") == ("true", None) and cell("7.5", "int") == (None, "no int") and cell("1e3", "float") == ("1000.0", None)
    assert cell("nan", "float") == (None, "no float") and cell("", "int") == (None, None) and cell("4", "class", [1, 4]) == ("4", None) and cell(" kept ", "string") == (" kept ", None)


def test_runs(spark, tmp_path):
    run = f"file://{tmp_path}/run"
    samples = spark.createDataFrame([(i, f"img{i}") for i in range(3)], "_row long, image string")
    batch = lambda values: spark.createDataFrame(list(enumerate(values)), "example_id long, loss double")
    assert runs.metrics_tables(spark, run).count() == 0
    writer = runs.MetricsWriter(run, constants={"epoch": 0, "source": "a"})
    writer.add(batch([0.5, 0.6]))
    with pytest.raises(runs.MetricsError):
        writer.add(batch([1.0]).withColumn("more", F.lit(1)))
    assert writer.finish() == 0
    assert runs.add_metrics(batch([0.1, 0.2, 0.3]).withColumn("extra", F.lit(1)), run, constants={"epoch": 1, "source": "a"}) == 1
    (tmp_path / "run/metrics/metrics_id=7").mkdir()  # unfinished
    table = runs.metrics_tables(spark, run)
    assert table.count() == 5 and {r.metrics_id for r in table.collect()} == {0, 1}
    joined = runs.joined_run(table, {"a": samples}, epoch="epoch", geometry=("image",))
    assert [(r.epoch, r.example_id, r.image) for r in joined.collect()] == [(1, 0, "img0"), (1, 1, "img1"), (1, 2, "img2"), (0, 0, None), (0, 1, None)]
    for bad in (batch([1.0]).drop("example_id"), batch([1.0]).withColumn("epoch", F.lit(2)), spark.createDataFrame([(None, 1.0)], "example_id long, loss double")):
        with pytest.raises(runs.MetricsError):
            runs.add_metrics(bad, run, constants={"epoch": 2})
    both = runs.upserted(batch([0.5, 0.6]), spark.createDataFrame([(1, 0.6000001), (2, 0.7)], "example_id long, loss double"), ["example_id"])
    assert sorted(tuple(r) for r in both.collect()) == [(0, 0.5), (1, 0.6), (2, 0.7)]
    with pytest.raises(PySparkException, match="two values for 1"):
        runs.upserted(batch([0.5, 0.6]), spark.createDataFrame([(1, 0.7)], "example_id long, loss double"), ["example_id"]).collect()
    runs.log_scalars(spark, run, {"map": 0.25}, "2026-01-01T00:00:00")
    runs.log_scalars(spark, run, {"map": 0.5, "lr": 1}, "2026-01-01T00:01:00")
    assert sorted((r.name, r.value) for r in runs.run_scalars(spark, run).collect()) == [("lr", 1.0), ("map", 0.25), ("map", 0.5)]
    runs.append_events(spark.createDataFrame([("a", None)], "sample string, status string"), f"{run}/log")
    runs.append_events(spark.createDataFrame([("b", "reviewed")], "sample string, status string"), f"{run}/log")
    assert spark.read.json(f"{run}/log").count() == 2
    assert [runs.metric_kind(n, batch([1.0]).schema["loss"].dataType) for n in ("example_id", "epoch", "mean_iou", "loss")] == ["example", "counter", "fraction", "number"]


def test_collector(spark):
    df = spark.range(10).toDF("x")
    predict = lambda frame: {"twice": (frame["x"] * 2).tolist()}
    assert sum(r.twice for r in runs.collected(df, predict, {"twice": "long"}).collect()) == 90
    with pytest.raises(PySparkException, match="values for"):
        runs.collected(df, lambda frame: {"y": [1]}, {"y": "int"}).collect()
    with pytest.raises(runs.MetricsError):
        runs.collected(df, predict, {"x": "long"})
    assert runs.transformed(df, y=F.col("x") + 1).agg(F.sum("y")).first()[0] == 55 and df.columns == ["x"]

    from sampleworks.operators.evaluation import aggregated

    @F.pandas_udf("double")
    def middle(v: pd.Series) -> float:
        return float(v.median())

    assert tuple(aggregated(df, ["middle"], {"middle": middle}).first()) == (4.5,)
