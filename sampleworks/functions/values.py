"""Column helpers for values: finite numbers, rounding and ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_finite(c: Column) -> Column:
    """True for a number that is neither null, NaN nor infinite."""
    x = c.cast("double")
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def finite(c: Column) -> Column:
    """The number, or null where it isn't finite."""
    return F.when(is_finite(c), c)


def half_up(c: Column) -> Column:
    """Rounding to whole numbers as floor(x + 0.5)."""
    return F.floor(c + 0.5).cast("double")


def ratio(part: Column, whole: Column, empty: float = 0.0) -> Column:
    """part / whole, ``empty`` where whole is 0; evaluation uses 0.0, per-image collection 1.0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(empty))


def f1_score(tp: Column, fp: Column, fn: Column, empty: float = 0.0) -> Column:
    return ratio(2 * tp, 2 * tp + fp + fn, empty)


def group_key(c: Column, kind: str) -> Column:
    """Null and NaN are one group."""
    return F.nanvl(c, F.lit(None).cast(kind)) if kind in ("double", "float") else c


def clean_number(c: Column) -> Column:
    """A number to six places, whole ones without a point; null where it isn't finite."""
    x = F.round(finite(c).cast("double"), 6)
    return F.when(x == F.floor(x), x.cast("long").cast("string")).otherwise(x.cast("string"))


def field_label(name: Column) -> Column:
    """A heading made of a field's name: underscores and dashes are spaces, the first letter is large."""
    spaced = F.trim(F.regexp_replace(name, "[_-]+", " "))
    return F.concat(F.upper(F.substring(spaced, 1, 1)), F.substring(spaced, 2, 1 << 30))


def sample_key(path: Column) -> Column:
    """A path as tables spell it: one that begins with a drive letter has forward slashes."""
    return F.when(path.rlike(r"^[A-Za-z]:[\\/]"), F.replace(path, F.lit("\\"), F.lit("/"))).otherwise(path)


def clean_tag(tag: Column) -> Column:
    """A tag with single spaces, or null if it is empty or has other characters than letters, digits, spaces, dots, dashes, underscores."""
    text = F.trim(F.regexp_replace(tag, r"\s+", " "))
    return F.when(text.rlike(r"^[\p{L}\p{N} ._-]+$"), text)


def object_key(annotation: Column, place: Column) -> Column:
    """How a tag names a box: by its annotation id, else by its place."""
    return F.coalesce(F.concat(F.lit("a"), annotation.cast("string")), F.concat(F.lit("i"), place.cast("string")))


def class_key(name: Column) -> Column:
    return F.lower(F.trim(name))


def sparse_fields(*columns: str) -> Column:
    """The values of fields that have one, as JSON: nulls and numbers that aren't finite are left out."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "true"})
