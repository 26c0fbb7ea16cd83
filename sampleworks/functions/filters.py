"""Predicates of the interactive filters, each with its own rule for missing values."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sampleworks.functions.values import is_finite


def numeric_range(c: Column, low: float, high: float, inverted: bool = False) -> Column:
    """Inclusive range; a missing or non-finite value never passes, not even inverted."""
    inside = c.between(low, high)
    return is_finite(c) & (~inside if inverted else inside)


def excluding(c: Column, excluded: Sequence, inverted: bool = False) -> Column:
    """Passes unless the value is excluded; null passes, and fails inverted."""
    hit = F.coalesce(c.isin(list(excluded)), F.lit(False)) if excluded else F.lit(False)
    return hit if inverted else ~hit


def boolean_is(c: Column, wanted: bool | None) -> Column:
    """None passes all; a null cell counts as false."""
    return F.lit(True) if wanted is None else F.coalesce(c, F.lit(False)) == wanted


def field_number(c: Column, low: float, high: float, without_value: bool) -> Column:
    return F.when(is_finite(c), c.between(low, high)).otherwise(without_value)


def field_values(c: Column, values: Sequence, without_value: bool) -> Column:
    return F.coalesce(c.isin(list(values)), F.lit(without_value))


def field_contains(c: Column, text: str, without_value: bool) -> Column:
    return F.coalesce(F.contains(F.lower(c), F.lit(text.lower())), F.lit(without_value))


def weight_above(df: DataFrame, threshold: float | None, column: str = "weight") -> DataFrame:
    """Rows with a weight above the threshold; None, or a frame without the column, keeps all."""
    return df if threshold is None or column not in df.columns else df.filter(F.col(column) > threshold)


Point = tuple[float, float]


def in_polygon(x: Column, y: Column, polygon: Sequence[Point]) -> Column:
    """Even-odd ray cast as one expression, behind the bounding box."""
    if len(polygon) < 3:
        return F.lit(False)
    crossings = []
    for (x1, y1), (x2, y2) in zip(polygon, [*polygon[-1:], *polygon[:-1]]):
        if y1 != y2:
            crossings.append(((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < F.lit((x2 - x1) / (y2 - y1)) * (y - y1) + x1))
    inside = reduce(lambda a, b: a != b, crossings) if crossings else F.lit(False)
    xs, ys = [p[0] for p in polygon], [p[1] for p in polygon]
    return x.between(min(xs), max(xs)) & y.between(min(ys), max(ys)) & inside


@dataclass
class Stroke:
    polygon: Sequence[Point]
    subtract: bool = False


def in_regions(x: Column, y: Column, strokes: Sequence[Stroke], inverted: bool = False) -> Column:
    """Strokes in order: each adds or takes away; if the first takes away, everything starts inside. A point
    without a position fails, even inverted."""
    strokes = [s for s in strokes if len(s.polygon) >= 3]
    state = F.lit(bool(strokes) and strokes[0].subtract)
    for s in strokes:
        state = F.when(in_polygon(x, y, s.polygon), not s.subtract).otherwise(state)
    return is_finite(x) & is_finite(y) & (~state if inverted else state)


def any_instance(instances: Column, *tests) -> Column:
    """All tests hold on one and the same instance."""
    return F.coalesce(F.exists(instances, lambda i: reduce(lambda a, b: a & b, [t(i) for t in tests])), F.lit(False))


def failures(filters: dict[str, Column]) -> Column:
    """How many filters a row fails; 0 passes all, and 1 with its own filter failed is what leave-one-out counts."""
    return reduce(lambda a, b: a + b, [(~p).cast("int") for p in filters.values()], F.lit(0))


def draw_mask(hard: Column, soft: Column) -> Column:
    """0 hidden, 1 filtered out but drawn grey, 2 shown."""
    return F.when(hard & soft, 2).when(hard, 1).otherwise(0)
