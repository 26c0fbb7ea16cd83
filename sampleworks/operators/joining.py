"""Joins of metrics with the samples they describe, and moves between sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sampleworks.functions.values import f1_score


def join_input(metrics: DataFrame, samples: DataFrame, *, constants: dict | None = None, columns: Sequence[str] | None = None, example: str = "example_id", row: str = "_row") -> DataFrame:
    """Each metric row with its sample. Metrics override sample columns and constants override both; an id outside
    the table is an error."""
    constants = constants or {}
    own = [c for c in (columns or samples.columns) if c != row and c not in metrics.columns and c not in constants]
    side = samples.select(F.col(row).alias("__row"), *own)
    joined = metrics.join(side, F.col(example) == F.col("__row"), "left")
    checked = F.when(F.col("__row").isNull(), F.raise_error(F.concat(F.lit("no row for example id "), F.coalesce(F.col(example).cast("string"), F.lit("null"))))).otherwise(F.col(example))
    kept = [checked.alias(c) if c == example else F.col(c) for c in metrics.columns if c not in constants]
    return joined.select(*own, *kept, *[F.lit(v).alias(k) for k, v in constants.items()])


def with_collected(joined: DataFrame, original: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    """``<column>@collected`` beside each column that differs between the version shown and the one collected on."""
    side = original.select(F.col(key), *[F.col(c).alias(f"{c}@collected") for c in columns])
    both = joined.join(side, key, "left")
    changed = both.agg(*[F.max((~F.col(c).eqNullSafe(F.col(f"{c}@collected"))).cast("int")).alias(c) for c in columns]).first()
    return both.drop(*[f"{c}@collected" for c in columns if not changed[c]])


def last_epoch(df: DataFrame, source: str, epoch: str) -> DataFrame:
    """Rows of the last epoch of each source."""
    return df.withColumn("__last", F.max(epoch).over(Window.partitionBy(source))).filter(F.col(epoch) == F.col("__last")).drop("__last")


def compare_samples(baseline: DataFrame, candidate: DataFrame, key: str, tolerance: float = 1e-9) -> DataFrame:
    """Full pairing by image of (tp, fp, fn) with f1 of both sides, delta and outcome."""
    sides = [df.select(key, f1_score(F.col("tp"), F.col("fp"), F.col("fn")).alias(name)) for df, name in ((baseline, "before"), (candidate, "after"))]
    both = sides[0].join(sides[1], key, "full_outer")
    delta = F.col("after") - F.col("before")
    outcome = F.when(F.col("before").isNull(), "only_candidate").when(F.col("after").isNull(), "only_baseline").when(delta > tolerance, "improved").when(delta < -tolerance, "regressed").otherwise("unchanged")
    return both.select(key, "before", "after", delta.alias("delta"), outcome.alias("outcome"))


def first_by_key(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("__n = 1").drop("__n")


def union_tables(a: DataFrame, b: DataFrame) -> DataFrame:
    """All rows of both; the columns must agree in name and order."""
    if a.columns != b.columns:
        raise ValueError("tables have different columns")
    return a.union(b)


def remove_samples(df: DataFrame, chosen: DataFrame, key: str, provenance: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, rows for the holding set with where they came from)."""
    gone = df.join(chosen.select(key), key, "left_semi").withColumns(provenance)
    return df.join(chosen.select(key), key, "left_anti"), gone


def restore_samples(holding: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """``target`` with the held rows that it hasn't got, in its own columns and types."""
    back = holding.join(target.select(key), key, "left_anti")
    return target.unionByName(back.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in target.schema]))


def delete_rows(df: DataFrame, positions: DataFrame, row: str = "_row") -> DataFrame:
    """Rows without those positions, numbered anew: a row moves up by the deleted positions before it."""
    gone = positions.select(F.col(row).alias("__row"), F.lit(1).alias("__gone")).distinct()
    marked = df.join(gone, F.col(row) == F.col("__row"), "left").withColumn("__gone", F.coalesce("__gone", F.lit(0))).withColumn("__stretch", F.floor(F.col(row) / 65_536))
    # a running sum inside stretches of positions, and one over the few totals of stretches
    inside = F.sum("__gone").over(Window.partitionBy("__stretch").orderBy(row).rowsBetween(Window.unboundedPreceding, 0))
    totals = marked.groupBy("__stretch").agg(F.sum("__gone").alias("__n"))
    totals = totals.select("__stretch", (F.sum("__n").over(Window.orderBy("__stretch")) - F.col("__n")).alias("__before"))
    moved = marked.withColumn("__inside", inside).join(totals, "__stretch").filter("__gone = 0")
    place = F.col(row) - F.col("__inside") - F.col("__before")
    return moved.select(*[place.alias(row) if c == row else F.col(c) for c in df.columns])


def set_values(df: DataFrame, patch: DataFrame, column: str, row: str = "_row") -> DataFrame:
    """Cells of one column replaced by (row, value); a null value is set, an absent row is left."""
    side = patch.select(F.col(row).alias("__row"), F.col("value").alias("__value"), F.lit(True).alias("__hit"))
    joined = df.join(side, F.col(row) == F.col("__row"), "left")
    cell = F.when(F.col("__hit"), F.col("__value")).otherwise(F.col(column))
    return joined.select(*[cell.alias(c) if c == column else F.col(c) for c in df.columns])


def net_edits(edits: DataFrame) -> DataFrame:
    """Last value and first ``before`` of each cell (row, column), without edits that change nothing."""
    net = edits.groupBy("row", "column").agg(F.min_by("before", "seq").alias("before"), F.max_by("after", "seq").alias("after"))
    return net.filter(~F.col("before").eqNullSafe(F.col("after")))
