"""Order statistics of all rows, or of a group of any size, with every task at work.

An order is cut into ranges by a sampled range partitioning, and written once with the place of each row in its range. What a
row needs from before or after its range is worked out from one row for each range and group, a table as long as there are
tasks, and sent back. So one group, or none, is no window in one task.

Quantiles are found by counting: sketches give an interval about each wanted position, rows below and inside are counted, and
the interval narrows until few enough values are left to be put in order. Any number of columns and positions share a pass.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sampleworks.functions.values import finite
from sampleworks.sources.tables import shared_folder

CELLS = 200_000  # rows for ranges and groups up to which they are broadcast
SMALL = 200_000  # values of an interval that are put in order by one aggregate
ACCURACY = 10_000  # of the sketches: their rank is off by the interval's rows over this at most
BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
PLACES = 33  # bits of a place in its range


def staged(df: DataFrame, label: str, batch: str | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back, which cuts its lineage. ``batch`` is the size of batches that go to Python
    meanwhile, where the session sets none."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    own = batch is not None and spark.conf.get(BATCH_LIMIT, None) is None
    if own:
        spark.conf.set(BATCH_LIMIT, batch)
    try:
        df.write.parquet(path)
    finally:
        if own:
            spark.conf.unset(BATCH_LIMIT)
    return spark.read.schema(df.schema).parquet(path)


def df_of(rows: pa.Table, like: DataFrame) -> DataFrame:
    """A few collected rows as a frame of the same schema."""
    return like.sparkSession.createDataFrame(rows, like.schema)


def in_ranges(df: DataFrame, order: Sequence[str | Column], label: str = "ranges", keep: Sequence[str] | None = None) -> DataFrame:
    """Rows in ranges of an order: ``__range`` ascends with it, ``__place`` counts from 0 inside. Nulls come first. Of the columns
    those to ``keep`` are written, or all.

    Rows that are equal in all of ``order`` fall in one range, so its last column should tell rows apart.
    """
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = staged(ordered.select(*(df.columns if keep is None else keep), F.monotonically_increasing_id().alias("__at")), label)
    return placed.withColumn("__range", F.shiftright("__at", PLACES)).withColumn("__place", F.col("__at").bitwiseAND(F.lit((1 << PLACES) - 1))).drop("__at")


def row_numbers(df: DataFrame, order: Sequence[str | Column], name: str = "_row", label: str = "ranges") -> DataFrame:
    """``df`` with the number of each row from 0 along an order."""
    placed = in_ranges(df, order, label)
    sizes = placed.groupBy("__range").agg(F.count("*").alias("__n"))
    before = sizes.select("__range", (F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).alias("__before"))
    return placed.join(F.broadcast(before), "__range").select(*df.columns, (F.col("__place") + F.col("__before")).alias(name))  # one row for each range


#: what can be worked out along an order; each kind is (value of a range, value of earlier or later ranges, value inside)
KINDS = ("number", "sum", "max_after", "previous", "next")


def along(placed: DataFrame, columns: dict[str, tuple[str, Column | None]], group: Sequence[str] = ()) -> DataFrame:
    """Rows of :func:`in_ranges`, whose order begins with ``group``, with columns worked out along the order in each group.

    ``columns`` maps a name to a kind and an expression: ``number`` (from 1), ``sum`` (up to the row), ``max_after`` (from
    the row to the end), ``previous`` and ``next`` (of the neighbouring row). Null values don't count for sums and maxima.
    """
    unknown = {kind for kind, _ in columns.values()} - set(KINDS)
    if unknown:
        raise ValueError(f"unknown kinds: {sorted(unknown)}")
    of = placed.select("*", *[(x if x is not None else F.lit(1)).alias(f"__x{i}") for i, (_, x) in enumerate(columns.values())])
    totals, carried, inside = [], [], []
    over = Window.partitionBy(*group, F.lit(0)).orderBy("__range")
    here = Window.partitionBy("__range", *group).orderBy("__place")
    ahead = Window.partitionBy("__range", *group).orderBy(F.desc("__place"))
    until, before = (Window.unboundedPreceding, 0), over.rowsBetween(Window.unboundedPreceding, -1)
    for i, (name, (kind, _)) in enumerate(columns.items()):
        x, t, c = f"__x{i}", f"__t{i}", F.col(f"__c{i}")
        if kind in ("number", "sum"):
            totals.append(F.sum(x).alias(t))
            carried.append(F.sum(t).over(before))
            own = F.sum(x).over(here.rowsBetween(*until))
            inside.append(F.coalesce(own + c, own, c).alias(name))
        elif kind == "max_after":
            totals.append(F.max(x).alias(t))
            carried.append(F.max(t).over(over.rowsBetween(1, Window.unboundedFollowing)))
            inside.append(F.greatest(F.max(x).over(ahead.rowsBetween(*until)), c).alias(name))
        elif kind == "previous":
            totals.append(F.max_by(x, "__place").alias(t))
            carried.append(F.lag(t).over(over))
            inside.append(F.when(F.row_number().over(here) == 1, c).otherwise(F.lag(x).over(here)).alias(name))
        else:
            totals.append(F.min_by(x, "__place").alias(t))
            carried.append(F.lead(t).over(over))
            inside.append(F.when(F.row_number().over(ahead) == 1, c).otherwise(F.lead(x).over(here)).alias(name))
    cells = of.groupBy("__range", *group).agg(*totals)
    cells = cells.select(F.col("__range").alias("__r"), *[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], *[c.alias(f"__c{i}") for i, c in enumerate(carried)])
    few = cells.limit(CELLS + 1).toArrow()
    if few.num_rows <= CELLS:
        cells = F.broadcast(df_of(few, cells))
    same = F.col("__range") == F.col("__r")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    return of.join(cells, same).select(*placed.columns, *inside)


def order_statistics(df: DataFrame, wanted: dict[str, Sequence[int]], *, small: int = SMALL) -> dict[tuple[str, int], float]:
    """The values at positions (from 0, ascending) among the finite values of columns; positions beyond the ends raise.

    ``df`` is read once for each narrowing, by a factor of some thousands, so two or three times.
    """
    columns = list(wanted)
    if not columns:
        return {}
    x = {c: finite(F.col(c).cast("double")) for c in columns}
    sizes = df.agg(*[F.count(x[c]).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    # column and position; the open interval its value lies in, rows at or below the lower end, rows inside
    targets: list[list] = []
    for i, c in enumerate(columns):
        for k in sorted(set(wanted[c])):
            if not 0 <= k < sizes[i]:
                raise IndexError(f"{c} has {sizes[i]} values, none at {k}")
            targets.append([c, k, -math.inf, math.inf, 0, sizes[i]])
    part = lambda t: F.when((x[t[0]] > t[2]) & (x[t[0]] < t[3]), x[t[0]])
    found: dict[tuple[str, int], float] = {}
    while large := [t for t in targets if t[5] > small]:
        share = lambda t, by: min(1.0, max(0.0, (t[1] - t[4] + 0.5) / t[5] + by / ACCURACY))
        ends = df.agg(*[F.percentile_approx(part(t), [share(t, -3), share(t, 3)], ACCURACY).alias(f"p{i}") for i, t in enumerate(large)]).first()
        tests = lambda i, t: (part(t) < ends[i][0], part(t) <= ends[i][0], part(t) < ends[i][1], part(t) <= ends[i][1])
        counts = df.agg(*[F.count_if(test).alias(f"c{i}_{j}") for i, t in enumerate(large) for j, test in enumerate(tests(i, t))]).first()
        for i, t in enumerate(large):
            (low, high), k = ends[i], t[1] - t[4]
            under, upto_low, under_high, upto = counts[4 * i : 4 * i + 4]
            if under <= k < upto_low or under_high <= k < upto:
                found[t[0], t[1]] = low if k < upto_low else high
                targets.remove(t)
            elif upto_low <= k < under_high:
                t[2:] = low, high, t[4] + upto_low, under_high - upto_low
            elif k < under:  # the sketch missed; what is left is narrower all the same
                t[2:] = t[2], low, t[4], under
            else:
                t[2:] = high, t[3], t[4] + upto, t[5] - upto
    if targets:
        lists = df.agg(*[F.array_sort(F.collect_list(part(t)))[t[1] - t[4]].alias(f"v{i}") for i, t in enumerate(targets)]).first()
        found.update({(t[0], t[1]): lists[i] for i, t in enumerate(targets)})
    return found


def quantiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float], *, nearest: bool = False) -> dict[tuple[str, float], float | None]:
    """Exact quantiles of the finite values: linear between neighbours, or at the nearest rank (of two, the even one from 0);
    None without values."""
    sizes = df.agg(*[F.count(finite(F.col(c).cast("double"))).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    ends: dict[tuple[str, float], tuple[int, int, float]] = {}
    for i, c in enumerate(columns):
        n = sizes[i]
        for q in shares if n else ():
            at = round(q * (n - 1)) if nearest else q * (n - 1)
            ends[c, q] = math.floor(at), min(n - 1, math.ceil(at)), at - math.floor(at)
    values = order_statistics(df, {c: [k for (name, _), (a, b, _) in ends.items() if name == c for k in (a, b)] for c in columns if any(name == c for name, _ in ends)})
    out: dict[tuple[str, float], float | None] = {(c, q): None for c in columns for q in shares}
    for (c, q), (a, b, share) in ends.items():
        low, high = values[c, a], values[c, b]
        out[c, q] = low if a == b or low == high else low + (high - low) * share
    return out
