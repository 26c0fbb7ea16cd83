"""Append-only logs as streams: the latest state of each key, kept up in place.

The state is Spark's own: a keyed aggregate in update mode, whose store writes the keys that a batch touched and no others.
What changed in a batch is appended as one small table under the batch's number, so a batch that is run again writes the same
table, and what is written follows the batch, not the state. The current state is the newest change of each key; :func:`compact`
folds changes into a base once they outweigh it, so reading follows the state and not the age of the log.

Events without a key are a key of their own, as in a grouping. Of events with one sequence number the one with the greater
status counts. An empty log has an empty state.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from sampleworks.sources.tables import shared_folder

BASE, CHANGES = "base", "changes"


def latest(seq: str, status: str) -> Column:
    """The status of the event with the largest sequence number."""
    return F.max(F.struct(F.col(seq).alias("seq"), F.col(status).alias("status")))


def stream_fold(source: DataFrame, folder: str, key: str, seq: str, status: str, *, trigger: str | None = None) -> StreamingQuery:
    """A streaming query that keeps the state of ``source`` under ``folder``; without a ``trigger`` ("10 seconds") it ends with the files
    that are there."""
    folded = source.groupBy(key).agg(latest(seq, status).alias("last")).select(key, F.col("last.status").alias(status), F.col("last.seq").alias(seq))

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/{CHANGES}/batch={number}")

    writer = folded.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint")
    return (writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)).start()


def _parts(spark: SparkSession, folder: str, kind: str) -> dict[int, tuple[str, int]]:
    """Whole tables of a kind by the number of their batch, with their bytes."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{kind}")
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(path):
        return {}
    found = [s.getPath() for s in system.listStatus(path)]
    whole = [p for p in found if p.getName().startswith("batch=") and system.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return {int(p.getName().rpartition("=")[2]): (p.toString(), system.getContentSummary(p).getLength()) for p in whole}


def _read(spark: SparkSession, folder: str, schema: T.StructType) -> tuple[DataFrame, int | None, int, int]:
    """Base and newer changes as one table, the last batch in it, and the bytes of either."""
    bases, changes = _parts(spark, folder, BASE), _parts(spark, folder, CHANGES)
    start = max(bases, default=-1)
    newer = {n: c for n, c in changes.items() if n > start}
    paths = [*([bases[start][0]] if bases else []), *(path for path, _ in newer.values())]
    rows = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
    return rows, max([*newer, start], default=None), bases[start][1] if bases else 0, sum(size for _, size in newer.values())


def current(spark: SparkSession, folder: str, schema: T.StructType, key: str, seq: str, status: str) -> DataFrame:
    """``key, status, seq`` now; ``schema`` is that of the state."""
    rows = _read(spark, folder, schema)[0]
    return rows.groupBy(key).agg(latest(seq, status).alias("last")).select(key, F.col("last.status").alias(status), F.col("last.seq").alias(seq))


def compact(spark: SparkSession, folder: str, schema: T.StructType, key: str, seq: str, status: str) -> bool:
    """Fold changes into a new base if they are as large as the one before, so that each byte is rewritten a few times at most."""
    _, last, base, newer = _read(spark, folder, schema)
    if not newer or newer < base:
        return False
    current(spark, folder, schema, key, seq, status).write.mode("overwrite").parquet(f"{folder}/{BASE}/batch={last}")
    return True


def state_schema(log: DataFrame, key: str, seq: str, status: str) -> T.StructType:
    kinds = {f.name: f.dataType for f in log.schema}
    return T.StructType([T.StructField(c, kinds[c]) for c in (key, status, seq)])


def fold_once(log: DataFrame, key: str, seq: str, status: str, files: int = 4) -> DataFrame:
    """Write a log as files, stream them two by two, and return the final state."""
    spark = log.sparkSession
    folder = f"{shared_folder(spark)}/log-{uuid.uuid4().hex}"
    log.repartition(files).write.parquet(f"{folder}/log")
    source = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/log")
    stream_fold(source, folder, key, seq, status).awaitTermination()
    schema = state_schema(log, key, seq, status)
    compact(spark, folder, schema, key, seq, status)
    return current(spark, folder, schema, key, seq, status).select(key, status)
