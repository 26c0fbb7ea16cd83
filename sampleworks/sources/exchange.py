"""Annotation formats of other tools, read into rows of images with instances and written from them.

Readers give ``image, file_name, width, height, instances`` (array of ``x0, y0, x1, y1, label, iscrowd``) and classes
``label, name``, numbered from 0 by where a name is first seen, in order of file and place. Sizes that a format doesn't carry come
from ``sizes`` (``stem, width, height``; :func:`png_sizes` makes one), else they are 0. A file without boxes is an image
without instances; a line that can't be read is an error that names file and line. Writers give one row for each document,
``name, value``; :func:`write_documents` stores them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

INSTANCE = "array<struct<x0:double,y0:double,x1:double,y1:double,label:int,iscrowd:int>>"
IMAGE_NAME = r"(?i)\.(jpe?g|png|bmp|gif|webp|tiff?)$"
# fixed values: headings of tables of boxes, in the order they are looked for
CSV_IMAGE = ("image", "image_path", "filename", "file", "path", "image_name")
CSV_LABEL = ("class", "label", "category", "class_name")
CSV_BOX = (("x_min", "y_min", "x_max", "y_max"), ("xmin", "ymin", "xmax", "ymax"), ("x0", "y0", "x1", "y1"), ("left", "top", "right", "bottom"))


class FormatError(ValueError):
    """A folder or file that isn't in the format it is read as."""


def stem(path: Column) -> Column:
    """Name of a file without folder and ending."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def _file(path: str = "_metadata.file_path") -> Column:
    """Path of the file that a row is read from, as it is spelled on disk."""
    return _plain(F.url_decode(F.replace(F.col(path), F.lit("+"), F.lit("%2B"))))


def _plain(path: Column) -> Column:
    return F.regexp_replace(path, "^file:/+", "file:/")


def png_sizes(spark: SparkSession, root: str) -> DataFrame:
    """``stem, path, width, height`` of the PNG files below a folder, from their headers."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.png").load(root)
    number = lambda at: F.conv(F.hex(F.substring("content", at, 4)), 16, 10).cast("double")
    return files.select(stem(F.col("path")).alias("stem"), "path", number(17).alias("width"), number(21).alias("height"))


def _classes(boxes: DataFrame) -> DataFrame:
    """``label, name`` by first sight (``name, file, at``)."""
    seen = boxes.filter("name IS NOT NULL").groupBy("name").agg(F.min(F.struct("file", "at")).alias("first"))
    return seen.select((F.row_number().over(Window.orderBy("first")) - 1).cast("int").alias("label"), "name")  # a row for each class


def _images(images: DataFrame, boxes: DataFrame, sizes: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Rows and classes from images (``file, file_name, width, height``) and boxes (``file, at, name, box, iscrowd``)."""
    classes = _classes(boxes)
    whole = images
    if sizes is not None:
        side = sizes.groupBy("stem").agg(F.min(F.struct("path", "width", "height") if "path" in sizes.columns else F.struct("width", "height")).alias("s"))
        given = lambda c: F.coalesce(F.when(F.col(c) > 0, F.col(c)), F.col(f"s.{c}"), F.lit(0.0))
        whole = images.withColumn("stem", stem(F.col("file_name"))).join(side, "stem", "left").withColumns({c: given(c) for c in ("width", "height")}).drop("stem", "s")
    own = boxes.filter("box IS NOT NULL").join(F.broadcast(classes), "name")  # a row for each class
    instance = F.struct("at", *[F.col("box")[i].alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))], "label", "iscrowd")
    grouped = own.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(instance)), lambda i: i.dropFields("at")).cast(INSTANCE).alias("instances"))
    rows = whole.join(grouped, "file", "left").select(F.col("file").alias("image"), "file_name", F.col("width").cast("double").alias("width"), F.col("height").cast("double").alias("height"), F.coalesce("instances", F.array().cast(INSTANCE)).alias("instances"))
    return rows, classes


def _lines(spark: SparkSession, folder: str, glob: str = "*.txt") -> tuple[DataFrame, DataFrame]:
    """(``file`` of every text file, ``file, at, line`` of its lines that aren't blank)."""
    texts = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(folder, wholetext=True).select(_file().alias("file"), "value")
    lines = texts.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("at", "line"))
    # a file without a byte has no row; the names are those that Spark's own listing holds
    listed = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder).inputFiles()
    files = spark.createDataFrame([(f,) for f in listed], "path string")
    return files.select(_file("path").alias("file")), lines.withColumn("line", F.trim("line")).filter("line <> ''")


def _fault(when: Column, what: str) -> Column:
    return F.when(when, F.raise_error(F.concat(F.element_at(F.split("file", "/"), -1), F.lit(":"), (F.col("at") + 1).cast("string"), F.lit(f": {what}"))))


def read_voc(spark: SparkSession, folder: str, sizes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Pascal VOC: one XML file for each image; objects marked difficult are regions to ignore."""
    box = "struct<xmin:double,ymin:double,xmax:double,ymax:double>"
    schema = f"filename string, size struct<width:double,height:double>, object array<struct<name:string,difficult:string,bndbox:{box}>>"
    found = spark.read.format("xml").option("rowTag", "annotation").option("pathGlobFilter", "*.xml").option("recursiveFileLookup", "true").schema(schema).load(folder).select(_file().alias("file"), "*")
    name = F.coalesce(F.nullif(F.trim("filename"), F.lit("")), F.concat(stem(F.col("file")), F.lit(".jpg")))
    images = found.select("file", name.alias("file_name"), F.coalesce("size.width", F.lit(0.0)).alias("width"), F.coalesce("size.height", F.lit(0.0)).alias("height"))
    each = found.select("file", F.posexplode("object").alias("at", "o"))
    b = F.col("o.bndbox")
    corners = F.when(b.isNotNull(), F.array(*[F.coalesce(b[c], F.lit(0.0)) for c in ("xmin", "ymin", "xmax", "ymax")]))
    boxes = each.select("file", "at", F.coalesce(F.nullif(F.trim("o.name"), F.lit("")), F.lit("object")).alias("name"), corners.alias("box"), (F.trim(F.coalesce("o.difficult", F.lit("0"))) == "1").cast("int").alias("iscrowd"))
    return _images(images, boxes, sizes)


def read_kitti(spark: SparkSession, folder: str, sizes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """KITTI: one text file for each image; eight fields and more to a line, DontCare is left out."""
    files, lines = _lines(spark, folder)
    parts = F.split("line", r"\s+")
    fields = lines.select("file", "at", F.coalesce(_fault(F.size(parts) < 8, "a line has eight fields or more"), parts).alias("p")).filter(F.lower(F.col("p")[0]) != "dontcare")
    corners = F.array(*[F.col("p")[i].try_cast("double") for i in range(4, 8)])
    bad = F.exists(corners, lambda v: v.isNull())
    boxes = fields.select("file", "at", F.col("p")[0].alias("name"), F.coalesce(_fault(bad, "a box is four numbers"), corners).alias("box"), F.lit(0).alias("iscrowd"))
    images = files.select("file", F.concat(stem(F.col("file")), F.lit(".png")).alias("file_name"), F.lit(0.0).alias("width"), F.lit(0.0).alias("height"))
    return _images(images, boxes, sizes)


def read_yolo(spark: SparkSession, labels: str, names: Mapping[int, str], sizes: DataFrame, task: str = "detect") -> tuple[DataFrame, DataFrame]:
    """YOLO label files beside pictures of known size: ``class cx cy w h`` in shares of the picture, or for ``segment`` and ``obb``
    a class and corners. Every line is checked. Pictures without a label file are images without boxes."""
    if task not in ("detect", "segment", "obb"):
        raise FormatError(f"no task {task!r}")
    _, lines = _lines(spark, labels)
    parts = F.split("line", r"\s+")
    numbers = F.transform(F.slice(parts, 2, F.size(parts)), lambda v: v.try_cast("double"))
    read = lines.select("file", "at", parts[0].try_cast("int").alias("label"), numbers.alias("v"))
    infinite = F.exists("v", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    fault = F.coalesce(
        _fault(F.col("label").isNull() | infinite, "a label is a whole number and coordinates are finite numbers"), _fault(~F.col("label").isin(*names), "no such class"),
        *([_fault(F.size("v") != 4, "class cx cy w h"), _fault((F.array_min("v") < 0) | (F.array_max("v") > 1) | (F.col("v")[2] <= 0) | (F.col("v")[3] <= 0), "shares of the picture, with width and height")] if task == "detect" else
          [_fault((F.size("v") % 2 != 0) | (F.size("v") < 6) | (F.lit(task == "obb") & (F.size("v") != 8)), "corners"), _fault((F.array_min("v") < 0) | (F.array_max("v") > 1), "shares of the picture")]),
    )
    read = read.withColumn("v", F.coalesce(fault, F.col("v"))).withColumn("stem", stem(F.col("file")))
    own = sizes.groupBy("stem").agg(F.min("path").alias("path"), F.min("width").alias("width"), F.min("height").alias("height"))
    placed = read.join(own, "stem")
    w, h, v = F.col("width"), F.col("height"), F.col("v")
    if task == "detect":
        corners = F.array((v[0] - v[2] / 2) * w, (v[1] - v[3] / 2) * h, (v[0] + v[2] / 2) * w, (v[1] + v[3] / 2) * h)
    else:
        xs, ys = F.filter("v", lambda _, i: i % 2 == 0), F.filter("v", lambda _, i: i % 2 == 1)
        corners = F.array(F.array_min(xs) * w, F.array_min(ys) * h, F.array_max(xs) * w, F.array_max(ys) * h)
    instance = F.struct("at", *[corners[i].alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))], "label", F.lit(0).alias("iscrowd"))
    grouped = placed.groupBy("stem").agg(F.transform(F.array_sort(F.collect_list(instance)), lambda i: i.dropFields("at")).cast(INSTANCE).alias("instances"))
    rows = own.join(grouped, "stem", "left").select(F.col("path").alias("image"), F.element_at(F.split("path", "/"), -1).alias("file_name"), "width", "height", F.coalesce("instances", F.array().cast(INSTANCE)).alias("instances"))
    return rows, spark.createDataFrame(sorted((int(k), v) for k, v in names.items()), "label int, name string")


def read_boxes_csv(spark: SparkSession, path: str, sizes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """A table of boxes, or of one class for each image, under any of the usual headings in any case of letters."""
    table = spark.read.option("header", True).option("inferSchema", False).csv(path)
    known = {c.strip().lstrip("﻿").lower(): c for c in table.columns}
    first = lambda names: next((known[n] for n in names if n in known), None)
    image, label = first(CSV_IMAGE), first(CSV_LABEL)
    corners = next((tuple(known[n] for n in group) for group in CSV_BOX if all(n in known for n in group)), None)
    if image is None:
        raise FormatError(f"no column names the image: one of {CSV_IMAGE}")
    quoted = lambda c: F.col(f"`{c}`")
    name = F.nullif(F.trim(quoted(label)), F.lit("")) if label else F.lit(None).cast("string")
    box = F.array(*[quoted(c).try_cast("double") for c in corners]) if corners else F.lit(None).cast("array<double>")
    rows = table.select(F.trim(quoted(image)).alias("file"), F.monotonically_increasing_id().alias("at"), name.alias("name"), box.alias("box"), F.lit(0).alias("iscrowd")).filter("file <> ''")
    if corners:
        rows = rows.withColumn("box", F.when(F.col("name").isNull(), None).otherwise(F.coalesce(_fault(F.exists("box", lambda v: v.isNull()), "a box column is no number"), F.col("box"))))
    # the order in which names are seen is that of the rows
    order = rows.withColumn("place", F.col("file")).withColumn("file", F.lit("")).drop("box")
    images = rows.groupBy("file").agg(F.min("at").alias("at")).select("file", F.col("file").alias("file_name"), F.lit(0.0).alias("width"), F.lit(0.0).alias("height"))
    found, _ = _images(images, rows, sizes)
    classes = _classes(order)
    if corners is None:  # a class is about the whole picture
        whole = rows.filter("name IS NOT NULL").join(F.broadcast(classes), "name").groupBy("file").agg(F.array_sort(F.collect_list(F.struct("at", "label"))).alias("ls"))
        found = found.drop("instances").join(whole.withColumnRenamed("file", "image"), "image", "left")
        each = F.transform("ls", lambda l: F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.col("width").alias("x1"), F.col("height").alias("y1"), l["label"].alias("label"), F.lit(0).alias("iscrowd")))
        return found.withColumn("instances", F.coalesce(each.cast(INSTANCE), F.array().cast(INSTANCE))).drop("ls"), classes
    renumbered = _relabelled(found, _classes(rows), classes)
    return renumbered, classes


def _relabelled(rows: DataFrame, was: DataFrame, now: DataFrame) -> DataFrame:
    pairs = was.withColumnRenamed("label", "old").join(now.withColumnRenamed("label", "new"), "name").agg(F.map_from_entries(F.collect_list(F.struct("old", "new"))).alias("__m"))
    return rows.crossJoin(F.broadcast(pairs)).withColumn("instances", F.transform("instances", lambda i: i.withField("label", F.try_element_at(F.col("__m"), i["label"])))).drop("__m")  # one row


def read_class_folders(images: DataFrame, sizes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Pictures in a folder for each class (rows of :func:`formats.image_folder`): one box over each whole picture."""
    side = sizes.select(F.col("path").alias("image"), "width", "height") if sizes is not None else None
    rows = images.join(side, "image", "left") if side is not None else images.withColumns({"width": F.lit(0.0), "height": F.lit(0.0)})
    rows = rows.fillna(0.0, ["width", "height"])
    whole = F.array(F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.col("width").alias("x1"), F.col("height").alias("y1"), F.col("label").cast("int").alias("label"), F.lit(0).alias("iscrowd"))).cast(INSTANCE)
    return rows.select("image", F.element_at(F.split("image", "/"), -1).alias("file_name"), "width", "height", whole.alias("instances")), images.select(F.col("label").cast("int").alias("label"), F.col("class").alias("name")).distinct()


def to_coco(rows: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(images, annotations, categories); ids of images and boxes are hashes of their names and places, categories count from 1."""
    images = rows.withColumn("id", F.xxhash64("image"))
    each = images.select(F.col("id").alias("image_id"), F.posexplode("instances").alias("at", "i"))
    boxes = each.select(F.xxhash64("image_id", "at").alias("id"), "image_id", (F.col("i.label") + 1).cast("long").alias("category_id"), F.array(F.col("i.x0"), F.col("i.y0"), F.col("i.x1") - F.col("i.x0"), F.col("i.y1") - F.col("i.y0")).alias("bbox"), (F.greatest(F.col("i.x1") - F.col("i.x0"), F.lit(0.0)) * F.greatest(F.col("i.y1") - F.col("i.y0"), F.lit(0.0))).alias("area"), "i.iscrowd")
    return images.select("id", "file_name", "width", "height"), boxes, classes.select((F.col("label") + 1).cast("long").alias("id"), "name")


def above_weight(rows: DataFrame, threshold: float | None = 0.0, weight: str = "weight") -> DataFrame:
    """Rows of more weight than a threshold; all without a threshold or such a column, none of null weight."""
    return rows if threshold is None or weight not in rows.columns else rows.filter(F.col(weight) > threshold)


def _names(classes: DataFrame) -> DataFrame:
    return F.broadcast(classes.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("label").cast("int"), "name")))).alias("__names")))  # one row


def _named(i: Column) -> Column:
    return F.coalesce(F.try_element_at(F.col("__names"), i["label"].cast("int")), i["label"].cast("string"))


def _escaped(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def plain_number(value: Column, places: int = 6) -> Column:
    """A number in as few digits as say it, to six places, without an exponent."""
    text = F.regexp_replace(F.format_string(f"%.{places}f", value.cast("double")), r"\.?0+$", "")
    return F.when(text.isin("", "-", "-0"), "0").otherwise(text)


def _tag(name: str, text: Column) -> Column:
    return F.concat(F.lit(f"<{name}>"), text, F.lit(f"</{name}>"))


def voc_documents(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """One Pascal VOC document for each image; regions to ignore are marked difficult."""
    number = lambda v: plain_number(v)

    def item(i: Column) -> Column:
        box = F.concat(*[_tag(t, number(i[c])) for t, c in (("xmin", "x0"), ("ymin", "y0"), ("xmax", "x1"), ("ymax", "y1"))])
        return _tag("object", F.concat(_tag("name", _escaped(_named(i))), _tag("pose", F.lit("Unspecified")), _tag("truncated", F.lit("0")), _tag("difficult", F.when(i["iscrowd"] == 1, "1").otherwise("0")), _tag("bndbox", box)))

    whole = lambda c: F.coalesce(F.col(c), F.lit(0.0)).cast("long").cast("string")
    size = _tag("size", F.concat(_tag("width", whole("width")), _tag("height", whole("height")), _tag("depth", F.lit("3"))))
    body = F.concat(_tag("folder", F.lit("JPEGImages")), _tag("filename", _escaped(F.col("file_name"))), _tag("path", _escaped(F.col("image"))), size, _tag("segmented", F.lit("0")), F.array_join(F.transform("instances", item), ""))
    return rows.crossJoin(_names(classes)).select(F.concat(stem(F.col("file_name")), F.lit(".xml")).alias("name"), _tag("annotation", body).alias("value"))


def kitti_documents(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """One KITTI label file for each image; regions to ignore are left out."""
    two = lambda v: F.format_string("%.2f", v)
    line = lambda i: F.concat_ws(" ", F.replace(_named(i), F.lit(" "), F.lit("_")), F.lit("0.00 0 0.00"), *[two(i[c]) for c in ("x0", "y0", "x1", "y1")], F.lit("0.00 0.00 0.00 0.00 0.00 0.00 0.00"))
    lines = F.transform(F.filter("instances", lambda i: i["iscrowd"] != 1), line)
    return rows.crossJoin(_names(classes)).select(F.concat(stem(F.col("file_name")), F.lit(".txt")).alias("name"), F.concat(F.array_join(lines, "\n"), F.when(F.size(lines) > 0, "\n").otherwise("")).alias("value"))


def yolo_documents(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """One YOLO label file for each image, classes numbered without gaps in order of their numbers; regions to ignore are left out."""
    numbers = classes.select("label", (F.row_number().over(Window.orderBy("label")) - 1).alias("n")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("label").cast("int"), "n"))).alias("__n"))  # a row for each class
    w, h = F.col("width"), F.col("height")

    def line(i: Column) -> Column:
        shares = ((i["x0"] + i["x1"]) / 2 / w, (i["y0"] + i["y1"]) / 2 / h, (i["x1"] - i["x0"]) / w, (i["y1"] - i["y0"]) / h)
        return F.concat_ws(" ", F.try_element_at(F.col("__n"), i["label"].cast("int")).cast("string"), *map(plain_number, shares))

    lines = F.transform(F.filter("instances", lambda i: i["iscrowd"] != 1), line)
    return rows.crossJoin(F.broadcast(numbers)).select(F.concat(stem(F.col("file_name")), F.lit(".txt")).alias("name"), F.concat(F.array_join(lines, "\n"), F.when(F.size(lines) > 0, "\n").otherwise("")).alias("value"))


def cvat_documents(rows: DataFrame, classes: DataFrame, task: str) -> DataFrame:
    """CVAT for images 1.1 in rows that stand one below the other: ``at, value``, the head first, then images, then the end."""
    two = lambda v: F.format_string("%.2f", v)
    attribute = lambda n, v: F.concat(F.lit(f' {n}="'), v, F.lit('"'))

    def box(i: Column) -> Column:
        return F.concat(F.lit("<box"), attribute("label", _escaped(_named(i))), F.lit(' occluded="0" source="manual"'), *[attribute(n, two(i[c])) for n, c in (("xtl", "x0"), ("ytl", "y0"), ("xbr", "x1"), ("ybr", "y1"))], F.lit(' z_order="0"></box>'))

    whole = lambda c: F.coalesce(F.col(c), F.lit(0.0)).cast("long").cast("string")
    labels = classes.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("label", "name"))), lambda c: F.concat(F.lit("<label><name>"), _escaped(c["name"]), F.lit("</name><attributes></attributes></label>"))), "").alias("l"))
    head = labels.select(F.lit(-1).cast("long").alias("at"), F.concat(F.lit("<?xml version='1.0' encoding='utf-8'?><annotations><version>1.1</version><meta><task><name>"), _escaped(F.lit(task)), F.lit("</name><mode>annotation</mode><labels>"), "l", F.lit("</labels></task></meta>")).alias("value"))
    numbered = rows.crossJoin(_names(classes))
    body = numbered.select(F.col("_row").cast("long").alias("at"), F.concat(F.lit("<image"), attribute("id", F.col("_row").cast("string")), attribute("name", _escaped(F.col("file_name"))), attribute("width", whole("width")), attribute("height", whole("height")), F.lit(">"), F.array_join(F.transform("instances", box), ""), F.lit("</image>")).alias("value"))
    end = rows.sparkSession.range(1).select(F.lit(2**62).alias("at"), F.lit("</annotations>").alias("value"))
    return head.unionByName(body).unionByName(end)


def label_studio_tasks(rows: DataFrame, classes: DataFrame, as_predictions: bool = False) -> DataFrame:
    """One Label Studio task for each image as JSON: boxes in percent, as annotations or as a model's predictions."""
    w, h = (F.coalesce(F.when(F.col(c) > 0, F.col(c)), F.lit(1.0)) for c in ("width", "height"))
    percent = lambda part, whole: F.round(part / whole * 100, 4)

    def result(i: Column, at: Column) -> Column:
        value = F.struct(percent(i["x0"], w).alias("x"), percent(i["y0"], h).alias("y"), percent(i["x1"] - i["x0"], w).alias("width"), percent(i["y1"] - i["y0"], h).alias("height"), F.lit(0).alias("rotation"), F.array(_named(i)).alias("rectanglelabels"))
        return F.struct(F.concat(F.lit("box"), at.cast("string")).alias("id"), F.lit("rectanglelabels").alias("type"), F.lit("label").alias("from_name"), F.lit("image").alias("to_name"), w.cast("int").alias("original_width"), h.cast("int").alias("original_height"), F.lit(0).alias("image_rotation"), value.alias("value"))

    block = F.array(F.struct(F.transform("instances", result).alias("result"), *([F.lit("model").alias("model_version")] if as_predictions else [])))
    task = F.struct(F.struct(F.col("image")).alias("data"), block.alias("predictions" if as_predictions else "annotations"))
    return rows.crossJoin(_names(classes)).select(stem(F.col("file_name")).alias("name"), F.to_json(task).alias("value"))


def folder_of(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """``image, file_name, folder``: the class of each image's largest box, ``unlabelled`` without one; regions to ignore don't count."""
    area = lambda i: F.abs((i["x1"] - i["x0"]) * (i["y1"] - i["y0"]))
    own = F.filter("instances", lambda i: i["iscrowd"] != 1)
    ranked = F.array_sort(F.transform(own, lambda i, at: F.struct((-area(i)).alias("a"), at.alias("at"), _named(i).alias("n"))))
    name = F.regexp_replace(F.try_element_at(ranked, F.lit(1))["n"], r"[^\w.-]+", "_")
    return rows.crossJoin(_names(classes)).select("image", "file_name", F.coalesce(name, F.lit("unlabelled")).alias("folder"))


def write_documents(documents: DataFrame, folder: str) -> None:
    """Each document in a folder of its name, as text."""
    documents.write.partitionBy("name").text(folder)


def detect_formats(spark: SparkSession, root: str) -> DataFrame:
    """``format, split, files``: what the files below a folder look like, by their names alone, splits by folder.

    COCO files win over all others, as other tools leave them beside their own; folders of pictures count only without any.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    base = root.rstrip("/").rpartition("/")[2]
    parts = F.split(F.regexp_replace("path", rf"^.*?/{base}/", ""), "/")
    name, folder = F.lower(F.element_at(parts, -1)), F.when(F.size(parts) > 1, F.element_at(parts, -2))
    top = F.when(F.size(parts) > 1, parts[0]).otherwise("train")
    known = F.lower(folder)
    kind = (
        F.when(name.endswith(".json") & name.rlike("annotation|instances|coco"), "coco").when(name == "semantic.json", "semantic").when(name.isin("data.yaml", "data.yml", "dataset.yaml"), "yolo")
        .when(name.endswith(".csv"), "csv").when(name.endswith(".xml"), "voc").when(name.endswith(".txt") & known.isin("label_2", "labels", "label"), "kitti").when(name.rlike(IMAGE_NAME) & folder.isNotNull(), "folders")
    )
    split = F.when(kind == "csv", F.regexp_replace(name, r"\.csv$", "")).when(top.isin("Annotations", "label_2", "labels", "label") | (kind == "folders"), "train").otherwise(top)
    found = files.select(kind.alias("format"), split.alias("split"), folder.alias("folder")).filter("format IS NOT NULL")
    counted = found.groupBy("format", "split").agg(F.count("*").alias("files"), F.count_distinct("folder").alias("folders"))
    order = {f: n for n, f in enumerate(("coco", "semantic", "yolo", "csv", "voc", "kitti", "folders"))}
    rank = F.element_at(F.create_map(*[x for f, n in order.items() for x in (F.lit(f), F.lit(0 if f == "coco" else 1 if n < 4 else n))]), F.col("format"))
    ranked = counted.filter("format <> 'folders' OR folders >= 2").withColumn("__r", rank)
    best = F.min("__r").over(Window.partitionBy(F.lit(0)))  # a row for each format and split
    return ranked.withColumn("__b", best).filter("__r = __b").select("format", "split", "files")


def expanded(path: Column, aliases: Mapping[str, str]) -> Column:
    """``<TOKEN>`` in a path replaced by what it stands for; unknown tokens stay."""
    for token, target in aliases.items():
        path = F.replace(path, F.lit(f"<{token.upper()}>"), F.lit(target))
    return path


def contracted(path: Column, aliases: Mapping[str, str]) -> Column:
    """The longest known prefix of a path replaced by its token."""
    known = sorted(((t.rstrip("/"), n.upper()) for n, t in aliases.items() if t.rstrip("/")), key=lambda x: (-len(x[0]), x[1]))
    out = path
    for target, token in reversed(known):
        out = F.when(F.startswith(path, F.lit(target)), F.concat(F.lit(f"<{token}>"), F.substring(path, len(target) + 1, 1 << 30))).otherwise(out)
    return out


def with_alias(aliases: Mapping[str, str], token: str, target: str, *, force: bool = False) -> dict[str, str]:
    """Aliases with one more; pointing a token elsewhere is an error unless forced."""
    token = token.upper()
    if aliases.get(token, target) != target and not force:
        raise FormatError(f"<{token}> stands for {aliases[token]}")
    return {**aliases, token: target}


def parsed_cell(text: Column, kind: str, classes: Sequence[int] = ()) -> Column:
    """``value, error`` of what was typed into a cell: a boolean, whole number, number, class or text; empty is null."""
    clean = F.trim(text)
    empty = clean.isNull() | (clean == "")
    if kind == "bool":
        value = F.when(F.lower(clean).isin("true", "yes", "1"), "true").when(F.lower(clean).isin("false", "no", "0"), "false")
    elif kind == "int":
        value = F.when(clean.rlike(r"^[+-]?\d+$"), clean.try_cast("long").cast("string"))
    elif kind == "float":
        number = clean.try_cast("double")
        value = F.when(number.isNotNull() & ~F.isnan(number) & (F.abs(number) < float("inf")), number.cast("string"))
    elif kind == "class":
        value = F.when(clean.try_cast("int").isin(*classes), clean.try_cast("int").cast("string"))
    else:
        value, empty = text, text.isNull()
    return F.struct(F.when(~empty, value).alias("value"), F.when(~empty & value.isNull(), F.lit(f"no {kind}")).alias("error"))
