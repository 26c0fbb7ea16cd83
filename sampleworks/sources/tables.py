"""Versioned tables on a file system: Parquet directories, a body written last, and a catalog of bodies."""

from __future__ import annotations

import json
import tempfile
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROW = "_row"
FORMAT = 1  # of bodies; a reader refuses others

SAFE = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._- ")


def sanitized(name: str) -> str:
    """A name fit for one step of a path: each run of other characters becomes a dash, spaces, dots and dashes at the
    ends go, so no name leads upwards; what is empty then is an error."""
    parts = "".join(c if c in SAFE else "\0" for c in name.strip()).split("\0")
    clean = "-".join([p for n, p in enumerate(parts) if p or n in (0, len(parts) - 1)]).strip(" .-")
    if not clean:
        raise ValueError("a name needs a letter or digit")
    return clean


def table_path(root: str, project: str, dataset: str, table: str) -> str:
    p, d, t = map(sanitized, (project, dataset, table))
    return f"{root}/projects/{p}/datasets/{d}/tables/{t}"


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """``_row`` from 0 in an order: counts of range partitions plus a running number inside each.

    The placed rows are checkpointed, so that counts and numbers are of the same partitions however often a
    lost executor makes Spark work them out. Without a checkpoint folder in the session that is an error.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id())
    checkpoints(df.sparkSession)
    placed = placed.checkpoint()
    counts = placed.groupBy("__part").agg(F.count("*").alias("__n"))
    before = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy("__at")) - 1
    return placed.withColumn("__inside", inside).join(before, "__part").withColumn(ROW, F.col("__before") + F.col("__inside")).drop("__part", "__at", "__inside", "__before")


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables, ``spark.checkpoint.dir``; a temporary one only where it is unset and Spark is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='sampleworks-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def checkpoints(spark: SparkSession) -> None:
    """See that ``checkpoint()`` has a folder: the session's, else the shared one."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_version(df: DataFrame, path: str, *, parents: list[str] | None = None, producer: dict | None = None, base_name: str = "", description: str = "") -> str:
    """Write a new version: rows first, the body last. A path that exists is refused, so versions never change."""
    df.write.mode("errorifexists").parquet(f"{path}/rows")
    body = {"format_version": FORMAT, "path": path, "base_name": base_name or path.rpartition("/")[2], "description": description, "created": datetime.now(timezone.utc).isoformat(), "parents": parents or [], "producer": producer or {}, "schema": json.loads(df.schema.json())}
    _write_text(df.sparkSession, f"{path}/body.json", json.dumps(body))
    return path


def read_body(spark: SparkSession, path: str) -> dict:
    """The body of a version. One of another format, and a version whose body isn't written yet, are errors."""
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/body.json")
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        raise FileNotFoundError(f"no version at {path}")
    body = json.loads(spark.read.text(f"{path}/body.json", wholetext=True).first()[0])
    if body.get("format_version", FORMAT) != FORMAT:
        raise ValueError(f"a body of format {body['format_version']} at {path}")
    return body


def read_version(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a committed version."""
    read_body(spark, path)
    return spark.read.parquet(f"{path}/rows")


def catalog(spark: SparkSession, root: str) -> DataFrame:
    """One row for each committed version under ``root``."""
    bodies = spark.read.option("pathGlobFilter", "body.json").option("recursiveFileLookup", "true").text(root, wholetext=True)
    fields = "path string, base_name string, description string, created string, parents array<string>"
    return bodies.select(F.from_json("value", fields).alias("b")).select("b.*")


def edges(bodies: DataFrame) -> DataFrame:
    """``child, parent, place`` of the version graph."""
    return bodies.select(F.col("path").alias("child"), F.posexplode("parents").alias("place", "parent"))


def narrowed(df: DataFrame) -> DataFrame:
    """Kinds as inference would choose them: whole numbers long, others float, lists of numbers lists of floats."""
    kinds = {"tinyint": "bigint", "smallint": "bigint", "int": "bigint", "double": "float", "array<double>": "array<float>"}
    return df.select(*[F.col(c).cast(kinds.get(k, k)).alias(c) for c, k in df.dtypes])


def with_weight(df: DataFrame, weight: float = 1.0) -> DataFrame:
    return df if "weight" in df.columns else df.withColumn("weight", F.lit(weight).cast("float"))
