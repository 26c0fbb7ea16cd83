"""Calculated columns: 35 operations over one row or over a group, from a declarative specification.

Operations on a row give null for a null or non-finite input and for a non-finite result. Operations over a group
see finite numbers only; ``group_count`` counts all rows. Every operation is one expression, so a chain of calculated
columns stays one plan, and all windows over the same group and order share a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sampleworks.functions.values import finite, group_key, half_up, is_finite
from sampleworks.operators import ranges

MAX_COLUMNS = 64
ROW: dict[str, Callable[..., Column]] = {
    "add": lambda x, y: x + y,
    "subtract": lambda x, y: x - y,
    "multiply": lambda x, y: x * y,
    "divide": lambda x, y: F.try_divide(x, y),
    "power": F.power,
    "abs": F.abs,
    "negate": lambda x: -x,
    "sqrt": F.sqrt,
    "log": F.ln,
    "round": half_up,
    "floor": lambda x: F.floor(x).cast("double"),
    "ceil": lambda x: F.ceil(x).cast("double"),
    "sum": lambda *xs: sum(xs[1:], xs[0]),
    "mean": lambda *xs: sum(xs[1:], xs[0]) / len(xs),
    "min": lambda *xs: F.least(*xs) if len(xs) > 1 else xs[0],
    "max": lambda *xs: F.greatest(*xs) if len(xs) > 1 else xs[0],
    "greater": lambda x, y: x > y,
    "less": lambda x, y: x < y,
}
GROUP: dict[str, Callable[[Column], Column]] = {"group_sum": F.sum, "group_mean": F.avg, "group_min": F.min, "group_max": F.max, "group_std": F.stddev_pop}
ORDERED = ("previous", "next", "difference", "cumulative_sum")
VECTOR = ("length", "distance", "dot", "equal")
OPERATIONS = (*ROW, *GROUP, *ORDERED, *VECTOR, "rank", "occurrence", "group_count", "standardize")
ARITY = {"add": 2, "subtract": 2, "multiply": 2, "divide": 2, "power": 2, "greater": 2, "less": 2, "equal": 2, "distance": 2, "dot": 2, "sum": None, "mean": None, "min": None, "max": None}


@dataclass
class Calculation:
    """One calculated column: ``name = operation(inputs)``, in groups of ``group`` along ``order`` where it has them."""

    name: str
    operation: str
    inputs: list[str] = field(default_factory=list)
    group: str | None = None
    order: str | None = None


def _vector_sum(a: Column, b: Column, step: Callable[[Column, Column], Column]) -> Column:
    parts = F.zip_with(a, b, step)
    whole = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(whole, F.aggregate(parts, F.lit(0.0), lambda s, x: s + x))


def calculated(df: DataFrame, spec: Calculation, row: str = "_row") -> Column:
    """The expression of one calculation; ``row`` names the column that breaks ties of order."""
    kinds, inputs = dict(df.dtypes), [F.col(c) for c in spec.inputs]
    wanted = ARITY.get(spec.operation, 1)
    if spec.operation not in OPERATIONS:
        raise ValueError(f"unknown operation: {spec.operation}")
    if spec.operation != "group_count" and (len(inputs) != wanted if wanted else not inputs):
        raise ValueError(f"{spec.operation} takes {wanted or 'one or more'} inputs")
    if spec.operation in ROW:
        usable = [is_finite(c) for c in inputs]
        value = ROW[spec.operation](*[c.cast("double") for c in inputs])
        value = value if spec.operation in ("greater", "less") else finite(value)
        return F.when(F.array_min(F.array(*usable)), value)
    if spec.operation == "equal":
        return inputs[0] == inputs[1]
    if spec.operation == "length":
        if kinds[spec.inputs[0]] == "string":
            return F.length(inputs[0])
        return finite(F.sqrt(_vector_sum(inputs[0], inputs[0], lambda a, b: a.cast("double") * b.cast("double"))))
    if spec.operation == "dot":
        return finite(_vector_sum(*inputs, lambda a, b: a.cast("double") * b.cast("double")))
    if spec.operation == "distance":
        return finite(F.sqrt(_vector_sum(*inputs, lambda a, b: F.power(a.cast("double") - b.cast("double"), F.lit(2.0)))))

    keys = [group_key(F.col(spec.group), kinds[spec.group])] if spec.group else [F.lit(0)]
    here = Window.partitionBy(*keys)
    if spec.operation == "group_count":
        return F.count("*").over(here)
    if spec.operation == "occurrence":
        return F.when(inputs[0].isNotNull(), F.count("*").over(Window.partitionBy(*keys, inputs[0])))
    x = finite(inputs[0].cast("double")) if kinds[spec.inputs[0]] not in ("string", "boolean") else inputs[0]
    if spec.operation in GROUP:
        return GROUP[spec.operation](x).over(here)
    if spec.operation == "standardize":
        spread = F.stddev_pop(x).over(here)
        return F.when(x.isNotNull(), F.when(spread == 0, 0.0).otherwise(finite(F.try_divide(x - F.avg(x).over(here), spread))))
    if spec.operation == "rank":
        ordered = Window.partitionBy(*keys, x.isNotNull()).orderBy(x)
        peers = Window.partitionBy(*keys, x)
        return F.when(x.isNotNull(), F.rank().over(ordered) + (F.count("*").over(peers) - 1) / 2)
    if not spec.order:
        raise ValueError(f"{spec.operation} needs an order")
    at = finite(F.col(spec.order).cast("double"))
    along = Window.partitionBy(*keys, at.isNotNull()).orderBy(at, row)
    placed = at.isNotNull()
    if spec.operation == "previous":
        return F.when(placed, F.lag(x).over(along))
    if spec.operation == "next":
        return F.when(placed, F.lead(x).over(along))
    if spec.operation == "difference":
        return F.when(placed, finite(x - F.lag(x).over(along)))
    running = F.sum(x).over(along.rowsBetween(Window.unboundedPreceding, 0))
    return F.when(placed & x.isNotNull(), running)


def calculate(df: DataFrame, specs: list[Calculation], row: str = "_row") -> DataFrame:
    """``df`` with calculated columns; each may use those before it."""
    if len(specs) > MAX_COLUMNS:
        raise ValueError(f"at most {MAX_COLUMNS} calculated columns")
    for spec in specs:
        whole = _of_all_rows(df, spec, row)
        df = whole if whole is not None else df.withColumn(spec.name, calculated(df, spec, row))
    return df


def _of_all_rows(df: DataFrame, spec: Calculation, row: str) -> DataFrame | None:
    """A calculation over all rows without one task for them: from one row of sums sent to every task, or over ranges of the order
    or of the values, which are written to the shared folder. None for calculations of other kinds."""
    if spec.group or spec.operation not in (*GROUP, *ORDERED, "group_count", "standardize", "rank"):
        return None
    kinds = dict(df.dtypes)
    calculated(df, spec)  # checks operation and inputs
    if spec.operation == "group_count":
        return df.crossJoin(F.broadcast(df.agg(F.count("*").alias(spec.name))))  # one row
    given = F.col(spec.inputs[0])
    x = finite(given.cast("double")) if kinds[spec.inputs[0]] not in ("string", "boolean") else given
    if spec.operation in ORDERED:
        return _along_all_rows(df, spec, x, row)
    if spec.operation == "rank":
        return _ranked(df, spec, x)
    if spec.operation != "standardize":
        return df.crossJoin(F.broadcast(df.agg(GROUP[spec.operation](x).alias(spec.name))))  # one row
    told = df.agg(F.avg(x).alias("__mean"), F.stddev_pop(x).alias("__spread"))
    value = F.when(x.isNotNull(), F.when(F.col("__spread") == 0, 0.0).otherwise(finite(F.try_divide(x - F.col("__mean"), F.col("__spread")))))
    return df.crossJoin(F.broadcast(told)).withColumn(spec.name, value).drop("__mean", "__spread")  # one row


def _along_all_rows(df: DataFrame, spec: Calculation, x: Column, row: str) -> DataFrame:
    """Neighbours and running sums along an order of all rows; rows without a place in it get null."""
    at = finite(F.col(spec.order).cast("double"))
    placed = ranges.in_ranges(df.withColumns({"__at_all": at, "__value": x}), ["__at_all", row], "calculated")
    kind = {"previous": "previous", "next": "next", "difference": "previous", "cumulative_sum": "sum"}[spec.operation]
    on_order = F.when(F.col("__at_all").isNotNull(), F.col("__value"))  # rows without a place come first
    if kind == "previous":  # the last row without a place is no neighbour
        found = ranges.along(placed, {"__found": (kind, F.struct(on_order.alias("v")))}).withColumn("__found", F.col("__found.v"))
    elif kind == "next":
        found = ranges.along(placed, {"__found": (kind, F.struct(F.col("__value").alias("v")))}).withColumn("__found", F.col("__found.v"))
    else:
        found = ranges.along(placed, {"__found": (kind, on_order)})
    value = F.col("__found")
    if spec.operation == "difference":
        value = finite(F.col("__value") - value)
    elif spec.operation == "cumulative_sum":
        value = F.when(F.col("__value").isNotNull(), value)
    return found.select(*df.columns, F.when(F.col("__at_all").isNotNull(), value).alias(spec.name))


def _ranked(df: DataFrame, spec: Calculation, x: Column) -> DataFrame:
    """Ranks from 1 with ties at their mean, from the rows of each value and a running sum over ranges of values."""
    values = df.select(x.alias("__value")).filter("__value IS NOT NULL").groupBy("__value").agg(F.count("*").alias("__n"))
    placed = ranges.along(ranges.in_ranges(values, ["__value"], "ranked"), {"__upto": ("sum", F.col("__n"))})
    rank = F.col("__upto") - F.col("__n") + (F.col("__n") + 1) / 2
    return df.withColumn("__x", x).join(placed.select(F.col("__value").alias("__x"), rank.alias(spec.name)), "__x", "left").select(*df.columns, spec.name)
