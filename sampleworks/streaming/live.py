"""Runs and catalogs as they grow: metrics tables joined to their samples as they arrive, and new versions as they are committed.

Both are file streams: a trigger looks for new files, and what is there already is not read again. Joined rows go to a
file sink, which commits each batch by its number: a batch that is run again replaces its own files, and readers of the folder
see whole batches only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from sampleworks.operators.joining import join_input
from sampleworks.sources.runs import TABLE

POLL = "10 seconds"


def metrics_stream(spark: SparkSession, run: str, schema: T.StructType, *, tables_per_batch: int | None = None) -> DataFrame:
    """The rows of a run's metrics tables as they come, with ``metrics_id``. Columns that a table lacks are null.

    A table's files move into its folder when its write commits, so an aborted write adds nothing.
    """
    fields = [f for f in schema if f.name != TABLE]
    reader = spark.readStream.schema(T.StructType([*fields, T.StructField(TABLE, T.IntegerType())]))
    if tables_per_batch:
        reader = reader.option("maxFilesPerTrigger", tables_per_batch)
    return reader.option("basePath", f"{run}/metrics").parquet(f"{run}/metrics/{TABLE}=*")


def live_view(spark: SparkSession, run: str, samples: dict[str, DataFrame], schema: T.StructType, folder: str, *, source: str = "source", trigger: str | None = POLL, tables_per_batch: int | None = None) -> StreamingQuery:
    """A streaming query that joins metrics to the samples of their source as they arrive, and appends the rows to ``folder``.

    Rows are those of :func:`sampleworks.operators.joining.join_input` for each source, with ``metrics_id``. Without a ``trigger``
    the query ends with what is there; started again on the same folder it goes on from there.
    """
    metrics = metrics_stream(spark, run, schema, tables_per_batch=tables_per_batch)
    out: DataFrame | None = None
    for key, table in samples.items():
        part = join_input(metrics.filter(F.col(source) == key), table)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no samples")
    writer = out.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint")
    return (writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)).start()


def live_rows(spark: SparkSession, folder: str) -> DataFrame:
    """What a live view has joined so far: whole batches, each once."""
    return spark.read.parquet(f"{folder}/rows")


BODY = "path string, base_name string, description string, created string, parents array<string>"


def new_versions(spark: SparkSession, root: str) -> DataFrame:
    """Versions under a root as they are committed, each once: a stream of bodies, which are written last."""
    bodies = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "body.json").option("recursiveFileLookup", True).load(root)
    return bodies.select(F.from_json("value", BODY).alias("b")).select("b.*")


def poll_versions(spark: SparkSession, root: str, folder: str, *, trigger: str | None = POLL) -> StreamingQuery:
    """A streaming query that appends new versions to ``folder``; see :func:`live_view` for the trigger."""
    writer = new_versions(spark, root).writeStream.format("parquet").outputMode("append").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint")
    return (writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)).start()
