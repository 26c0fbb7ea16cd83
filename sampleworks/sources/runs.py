"""Runs on a file system: metrics tables that only grow, scalars logged over time, and appended events."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sampleworks.operators.joining import join_input

EXAMPLE = "example_id"
TABLE = "metrics_id"
# fixed values: what a column's name says about its numbers
FRACTIONS = ("confidence", "score", "prob", "iou", "overlap", "accuracy", "precision", "recall", "f1")
COUNTERS = ("epoch", "iteration", "step")


class MetricsError(ValueError):
    """Metrics that can't be recorded; nothing was."""


def metric_kind(name: str, kind: T.DataType) -> str:
    """What a metric column is, by its name and type: example, counter, fraction, embedding, number, flag or text."""
    low = name.lower()
    if low == EXAMPLE:
        return "example"
    if isinstance(kind, T.ArrayType):
        return "embedding" if isinstance(kind.elementType, (T.FloatType, T.DoubleType)) else "list"
    if isinstance(kind, T.BooleanType):
        return "flag"
    if isinstance(kind, T.NumericType):
        return "counter" if low in COUNTERS else "fraction" if any(h in low for h in FRACTIONS) else "number"
    return "text"


def _next(spark: SparkSession, run: str) -> int:
    return max((r[TABLE] for r in metrics_tables(spark, run).select(TABLE).distinct().collect()), default=-1) + 1  # a row for each table


def _folders(spark: SparkSession, run: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{run}/metrics")
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(path):
        return []
    # a table counts once it is whole
    found = [s.getPath() for s in system.listStatus(path)]
    return sorted(p.toString() for p in found if p.getName().startswith(f"{TABLE}=") and system.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def metrics_tables(spark: SparkSession, run: str) -> DataFrame:
    """All metrics tables of a run under one roof, with ``metrics_id``; columns that a table lacks are null. Unfinished ones aren't read."""
    out: DataFrame | None = None
    for folder in _folders(spark, run):
        part = spark.read.parquet(folder).withColumn(TABLE, F.lit(int(folder.rpartition("=")[2])))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out if out is not None else spark.createDataFrame([], f"{TABLE} int")


def add_metrics(metrics: DataFrame, run: str, *, constants: Mapping[str, Any] | None = None, joined: bool = True) -> int:
    """Write one metrics table and return its number. Joined ones need an example id without nulls; a constant may not be a column."""
    clash = sorted(set(constants or {}) & set(metrics.columns))
    if clash or TABLE in metrics.columns:
        raise MetricsError(f"columns twice: {clash or [TABLE]}")
    if joined and EXAMPLE not in metrics.columns:
        raise MetricsError(f"metrics of a table need {EXAMPLE}")
    if joined and metrics.filter(F.col(EXAMPLE).isNull()).limit(1).count():
        raise MetricsError(f"{EXAMPLE} is null")
    number = _next(metrics.sparkSession, run)
    metrics.withColumns({k: F.lit(v) for k, v in (constants or {}).items()}).write.mode("errorifexists").parquet(f"{run}/metrics/{TABLE}={number}")
    return number


class MetricsWriter:
    """Batches of one metrics table: all have the columns of the first; nothing counts before :meth:`finish`."""

    def __init__(self, run: str, *, constants: Mapping[str, Any] | None = None, joined: bool = True):
        self.run, self.constants, self.joined = run, constants, joined
        self.batches: DataFrame | None = None

    def add(self, batch: DataFrame) -> None:
        if self.batches is not None and batch.columns != self.batches.columns:
            raise MetricsError(f"a batch has columns {batch.columns}, the first had {self.batches.columns}")
        self.batches = batch if self.batches is None else self.batches.union(batch)

    def finish(self) -> int:
        if self.batches is None:
            raise MetricsError("no batches")
        return add_metrics(self.batches, self.run, constants=self.constants, joined=self.joined)


def joined_run(metrics: DataFrame, samples: Mapping[Any, DataFrame], source: str = "source", *, epoch: str | None = None, geometry: tuple[str, ...] = ()) -> DataFrame:
    """All metrics of a run with the samples they describe: each source's rows with its table, ``_src`` the place of the source.

    Columns that only some tables have are null elsewhere. Rows of the last epochs come first; ``geometry`` columns are
    kept in each source's last epoch only, as they are large.
    """
    out: DataFrame | None = None
    for n, (key, table) in enumerate(samples.items()):
        part = join_input(metrics.filter(F.col(source) == key), table).withColumn("_src", F.lit(n))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise MetricsError("no samples")
    if epoch is None:
        return out
    last = F.col(epoch) == F.max(epoch).over(Window.partitionBy("_src"))
    return out.withColumns({c: F.when(last, F.col(c)) for c in geometry}).orderBy(F.desc(epoch), "_src", EXAMPLE)


def upserted(old: DataFrame, new: DataFrame, keys: list[str], *, relative: float = 1e-5) -> DataFrame:
    """Old rows and new ones by key, once each. What both have must agree, numbers to a relative tolerance, else it is an error."""
    values = [f for f in new.schema if f.name not in keys]
    both = old.select(*keys, F.struct(*[f.name for f in values]).alias("__old")).join(new.groupBy(*keys).agg(F.first(F.struct(*[f.name for f in values])).alias("__new"), F.count_distinct(F.struct(*[f.name for f in values])).alias("__k")), keys, "full_outer")
    differs = F.coalesce(F.col("__k") > 1, F.lit(False))
    for f in values:
        a, b = F.col(f"__old.{f.name}"), F.col(f"__new.{f.name}")
        apart = F.abs(a - b) > relative * F.abs(b) + 1e-8 if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else ~a.eqNullSafe(b)
        differs |= F.col("__old").isNotNull() & F.col("__new").isNotNull() & F.coalesce(apart, ~a.eqNullSafe(b))
    fault = F.raise_error(F.concat_ws(" ", F.lit("two values for"), *[F.col(k).cast("string") for k in keys]))
    kept = F.when(differs, fault.cast(both.schema["__new"].dataType)).otherwise(F.coalesce("__old", "__new"))
    return both.withColumn("__kept", kept).select(*keys, "__kept.*")


def log_scalars(spark: SparkSession, run: str, values: Mapping[str, float], logged: str) -> None:
    """Append one row of scalars to a run's log."""
    row = [(logged, {k: float(v) for k, v in values.items()})]
    spark.createDataFrame(row, "_logged string, scalars map<string,double>").coalesce(1).write.mode("append").json(f"{run}/scalars")


def run_scalars(spark: SparkSession, run: str) -> DataFrame:
    """``_logged, name, value`` of all that a run logged."""
    log = spark.read.schema("_logged string, scalars map<string,double>").json(f"{run}/scalars")
    return log.select("_logged", F.explode("scalars").alias("name", "value"))


def append_events(events: DataFrame, folder: str) -> None:
    """Append events to a log as files of JSON lines. A file appears whole or not at all, so no reader sees half an event."""
    events.coalesce(1).write.mode("append").option("ignoreNullFields", "false").json(folder)


def collected(df: DataFrame, predict, columns: Mapping[str, str]) -> DataFrame:
    """Columns that a function from a Pandas frame to a mapping of lists gives, one value for each row, beside the rows.

    A column that is there already, or a list of another length, is an error.
    """
    clash = sorted(set(columns) & set(df.columns))
    if clash:
        raise MetricsError(f"columns twice: {clash}")
    schema = T.StructType([*df.schema.fields, *T.StructType.fromDDL(", ".join(f"`{n}` {k}" for n, k in columns.items())).fields])

    def run(frames):
        for frame in frames:
            found = predict(frame)
            for name in columns:
                if len(found[name]) != len(frame):
                    raise MetricsError(f"{name} has {len(found[name])} values for {len(frame)} rows")
            yield frame.assign(**{n: list(found[n]) for n in columns})

    return df.mapInPandas(run, schema)


def transformed(df: DataFrame, **views: Column) -> DataFrame:
    """A view of a table with columns worked out on read; the table stays as it is."""
    return df.withColumns(views)


def merged_counts(parts: DataFrame, keys: list[str], counts: list[str]) -> DataFrame:
    """Metric counts of several workers, summed by key, so that ratios of them are those of the whole."""
    return parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counts])
