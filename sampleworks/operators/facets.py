"""Histograms, counts, summaries, grouping and ordering over one frame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sampleworks.functions.filters import failures
from sampleworks.functions.values import finite, is_finite
from sampleworks.operators.ranges import quantiles as exact_quantiles
from sampleworks.sources.tables import checkpoints

BINS = 24
GROUPS = 24


def bounds(df: DataFrame, column: str) -> tuple[float, float]:
    """Least and greatest finite value; a constant column is widened by one, an empty one is 0 to 1."""
    x = finite(F.col(column).cast("double"))
    low, high = df.agg(F.min(x), F.max(x)).first()
    if low is None:
        return 0.0, 1.0
    return (low, high + 1) if low == high else (low, high)


def bin_of(c: Column, low: float, high: float, bins: int = BINS) -> Column:
    """Bin of a value; values at or beyond an end fall in the end bin."""
    return F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((c - low) / ((high - low) / bins)))).cast("int")


def histogram(df: DataFrame, column: str, filters: dict[str, Column], low: float, high: float, bins: int = BINS) -> DataFrame:
    """``bin, total, filtered_in, excluded_here`` in one pass: all filters, and all but the column's own."""
    fails = failures(filters)
    own = (~filters[column]).cast("int") if column in filters else F.lit(0)
    x = F.col(column).cast("double")
    kept = df.filter(is_finite(x)).select(bin_of(x, low, high, bins).alias("bin"), fails.alias("fails"), own.alias("own"))
    return kept.groupBy("bin").agg(F.count("*").alias("total"), F.count_if(F.col("fails") == 0).alias("filtered_in"), F.count_if((F.col("fails") == 1) & (F.col("own") == 1)).alias("excluded_here"))


def categorical_counts(df: DataFrame, column: str, filters: dict[str, Column]) -> DataFrame:
    """``value, total, filtered_in`` for each value; filters of other columns count, the column's own doesn't."""
    others = failures({k: v for k, v in filters.items() if k != column})
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("total"), F.count_if(others == 0).alias("filtered_in"))


def numeric_summary(df: DataFrame, column: str, quantiles: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Counts, extremes, mean, population deviation and linear quantiles of the finite values; without one, only counts aren't null.

    Quantiles are exact and found by counting, so the column is never gathered.
    """
    x = finite(F.col(column).cast("double"))
    cuts = exact_quantiles(df, [column], quantiles)
    return df.agg(
        F.count("*").alias("count"),
        F.count(x).alias("present"),
        (F.count("*") - F.count(x)).alias("missing"),
        F.count_distinct(x).alias("distinct"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
        F.sum(x).alias("sum"),
        F.avg(x).alias("mean"),
        F.stddev_pop(x).alias("std"),
        *[F.lit(cuts[column, q]).cast("double").alias(f"q{round(100 * q)}") for q in quantiles],
    )


def top_values(df: DataFrame, column: str, k: int = 12) -> DataFrame:
    """The commonest values, ties by value."""
    return df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(k)


def usable_fields(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Which columns are worth offering: not constant, texts not too long and not nearly unique."""
    stats = [f for c in columns for f in (F.count(c).alias(f"{c}__present"), F.count_distinct(c).alias(f"{c}__distinct"), F.max(F.length(F.col(c).cast("string"))).alias(f"{c}__longest"))]
    text = {c for c, kind in df.dtypes if kind == "string"}
    wide = df.agg(F.count("*").alias("rows"), *stats)
    rows = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"{c}__present").alias("present"), F.col(f"{c}__distinct").alias("distinct"), F.col(f"{c}__longest").alias("longest"), F.lit(c in text).alias("text"), F.col("rows")) for c in columns])
    long = wide.select(F.explode(rows).alias("f")).select("f.*")
    constant = (F.col("distinct") <= 1) & (F.col("present") == F.col("rows"))
    identifier = F.col("text") & ((F.col("longest") > 120) | ((F.col("present") >= 20) & (F.col("distinct") >= 0.9 * F.col("present"))))
    return long.withColumn("usable", ~constant & ~identifier & (F.col("present") > 0)).withColumn("wide", F.col("distinct") > 500)


def group_by_value(df: DataFrame, column: str, limit: int = GROUPS) -> DataFrame:
    """``group, n``: the commonest values, the tail folded into one group, missing values last."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    top = counts.filter(F.col(column).isNotNull()).orderBy(F.desc("n"), column).limit(limit).select(F.col(column).alias("__top"))
    marked = counts.join(F.broadcast(top), F.col(column) == F.col("__top"), "left")  # ``limit`` rows
    named = marked.withColumn("group", F.when(F.col(column).isNull(), "No value").when(F.col("__top").isNotNull(), F.col(column).cast("string")).otherwise("more values"))
    return named.groupBy("group").agg(F.sum("n").alias("n"))


def group_by_bins(df: DataFrame, column: str, low: float, high: float, bins: int = BINS) -> DataFrame:
    """``group, n`` in equal bins, missing values as -1."""
    x = F.col(column).cast("double")
    return df.groupBy(F.when(is_finite(x), bin_of(x, low, high, bins)).otherwise(-1).alias("group")).agg(F.count("*").alias("n"))


def count_bucket(n: Column) -> Column:
    """0, 1, 2-3, 4-7 and so on up to 64+, as the least number of the bucket."""
    return F.when(n <= 0, 0).when(n >= 64, 64).otherwise(F.power(F.lit(2), F.floor(F.log2(n))).cast("int"))


def sorted_rows(df: DataFrame, keys: Sequence[tuple[str, bool]], row: str = "_row") -> DataFrame:
    """Row view order: nulls last ascending and first descending, ties by position."""
    order = [F.col(c).desc_nulls_first() if down else F.col(c).asc_nulls_last() for c, down in keys]
    return df.orderBy(*order, row)


def field_sorted(df: DataFrame, column: str, descending: bool, tie: str) -> DataFrame:
    """Gallery order: missing last in both directions; runs of digits in strings compare as numbers."""
    key = F.col(column)
    if dict(df.dtypes)[column] == "string":
        key = natural_key(key)
    return df.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_last(), tie)


def positioned(ordered: DataFrame, name: str = "position") -> DataFrame:
    """Every row of an ordered frame with its place from 0: the place in its range of the sort and the rows of the ranges before."""
    checkpoints(ordered.sparkSession)
    place = F.monotonically_increasing_id()  # number of the range above 33 bits for the place in it
    placed = ordered.withColumn("__place", place).checkpoint().withColumn("__range", F.shiftright("__place", 33))
    ranges = placed.groupBy("__range").agg(F.count("*").alias("__n"))
    ranges = ranges.select("__range", (F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).alias("__before"))
    inside = F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(ranges), "__range").select(*ordered.columns, (inside + F.col("__before")).alias(name))  # one row for each partition


def natural_key(c: Column, width: int = 20) -> Column:
    """A string that sorts as the text does with its numbers taken as numbers."""
    parts = F.regexp_extract_all(c, F.lit(r"[0-9]+|[^0-9]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.lpad(F.regexp_replace(p, "^0+(?=.)", ""), width, "0")).otherwise(F.lower(p))), "")


def preview(df: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """The first ``n`` rows of each group."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(order))).filter(F.col("place") <= n)


def strided(df: DataFrame, n: int, row: str = "_row") -> DataFrame:
    """About ``n`` rows at equal distances."""
    step = max(1, df.count() // n)
    return df.filter(F.col(row) % step == 0).orderBy(row).limit(n)


def page(df: DataFrame, offset: int, limit: int, row: str = "_row", most: int = 10_000) -> DataFrame:
    """A slice by position, which reaches the scan as a predicate."""
    if not 0 < limit <= most:
        raise ValueError(f"a page holds 1 to {most} rows")
    return df.filter(F.col(row).between(offset, offset + limit - 1))
