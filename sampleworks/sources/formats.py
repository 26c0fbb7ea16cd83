"""Readers and writers of exchange formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COCO = T.StructType(
    [
        T.StructField("images", T.ArrayType(T.StructType([T.StructField("id", T.LongType()), T.StructField("file_name", T.StringType()), T.StructField("width", T.DoubleType()), T.StructField("height", T.DoubleType())]))),
        T.StructField("annotations", T.ArrayType(T.StructType([T.StructField("id", T.LongType()), T.StructField("image_id", T.LongType()), T.StructField("category_id", T.LongType()), T.StructField("bbox", T.ArrayType(T.DoubleType())), T.StructField("iscrowd", T.IntegerType()), T.StructField("area", T.DoubleType())]))),
        T.StructField("categories", T.ArrayType(T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())]))),
    ]
)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A header row is needed; every value stays a string."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An append-only log in order of file and place; a torn last line of a file is left out, any other bad line is an error."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("seq"))
    last = lines.groupBy("file").agg(F.max("seq").alias("last"))
    parsed = lines.join(last, "file").withColumn("row", F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    torn = F.col("row._bad").isNotNull()
    checked = F.when(torn & (F.col("seq") < F.col("last")), F.raise_error(F.concat(F.lit("bad line in "), F.col("file")))).otherwise(F.col("seq"))
    return parsed.withColumn("seq", checked).filter(~(torn & (F.col("seq") == F.col("last")))).select("seq", "row.*").drop("_bad")


def read_coco(spark: SparkSession, path: str) -> DataFrame:
    """One row for each image with its instances as corners; boxes of unknown images, classes or shapes are errors."""
    whole = spark.read.schema(COCO).option("multiLine", True).json(path)
    images = whole.select(F.inline("images")).withColumnRenamed("id", "image_id")
    classes = whole.select(F.inline("categories")).select(F.col("id").alias("category_id"), "name")
    boxes = whole.select(F.inline("annotations"))
    known = boxes.join(images.select("image_id", F.lit(True).alias("has_image")), "image_id", "left").join(classes, "category_id", "left")
    fault = F.when(F.col("has_image").isNull(), "box of an unknown image").when(F.col("name").isNull(), "box of an unknown class").when(F.coalesce(F.size("bbox"), F.lit(-1)) != 4, "box without four numbers")
    known = known.withColumn("id", F.when(fault.isNotNull(), F.raise_error(F.concat(fault, F.lit(": "), F.col("id").cast("string")))).otherwise(F.col("id")))
    b = F.col("bbox")
    instance = F.struct(F.col("id").alias("annotation_id"), b[0].alias("x0"), b[1].alias("y0"), (b[0] + b[2]).alias("x1"), (b[1] + b[3]).alias("y1"), F.col("category_id").cast("int").alias("label"), F.coalesce("iscrowd", F.lit(0)).alias("iscrowd"))
    grouped = known.groupBy("image_id").agg(F.array_sort(F.collect_list(instance)).alias("instances"))
    return images.join(grouped, "image_id", "left").withColumn("instances", F.coalesce("instances", F.array().cast(grouped.schema["instances"].dataType)))


def coco_document(df: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows of :func:`read_coco` and classes (``id, name``) as lines of one JSON document for each image."""
    boxes = F.transform("instances", lambda i: F.struct(i["annotation_id"].alias("id"), F.col("image_id"), i["label"].alias("category_id"), F.array(i["x0"], i["y0"], i["x1"] - i["x0"], i["y1"] - i["y0"]).alias("bbox"), i["iscrowd"]))
    names = classes.agg(F.array_sort(F.collect_list(F.struct("id", "name"))).alias("categories"))
    image = F.array(F.struct(F.col("image_id").alias("id"), "file_name", "width", "height"))
    return df.crossJoin(F.broadcast(names)).select(F.to_json(F.struct(image.alias("images"), boxes.alias("annotations"), "categories")).alias("value"))  # one row of classes


def box_rows(df: DataFrame, classes: DataFrame) -> DataFrame:
    """One row for each box; an image without boxes has one row with an empty class."""
    rows = df.select("file_name", "width", "height", F.explode_outer("instances").alias("i")).select("file_name", "width", "height", "i.x0", "i.y0", "i.x1", "i.y1", F.col("i.label").cast("long").alias("id"))
    return rows.join(classes, "id", "left").withColumn("class", F.coalesce("name", F.lit(""))).drop("id", "name")


def image_folder(spark: SparkSession, root: str) -> DataFrame:
    """``image, label``: a directory for each class, classes numbered by name; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    images = files.filter(F.lower("path").rlike(r"\.(jpe?g|png|bmp|gif|webp|tiff?)$")).withColumn("class", F.element_at(F.split("path", "/"), -2))
    names = images.select("class").distinct()
    from pyspark.sql import Window

    numbers = names.withColumn("label", F.row_number().over(Window.orderBy("class")) - 1)
    return images.join(numbers, "class").select(F.col("path").alias("image"), "class", "label")


def media_digests(spark: SparkSession, root: str) -> DataFrame:
    """``path, bytes, sha256`` of every file."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify_media(now: DataFrame, manifest: DataFrame) -> DataFrame:
    """``path, state``: same, changed, missing or new."""
    both = manifest.select("path", F.col("sha256").alias("was")).join(now.select("path", F.col("sha256").alias("is")), "path", "full_outer")
    return both.select("path", F.when(F.col("is").isNull(), "missing").when(F.col("was").isNull(), "new").when(F.col("is") != F.col("was"), "changed").otherwise("same").alias("state"))
