"""What an import holds: pictures and boxes of each split, sizes, sides and classes.

``images`` has ``split, id, width, height`` and ``annotations`` ``split, image_id, category_id, w, h``. Repeated picture rows count each;
a box counts for every row of its picture. Sides are those of boxes with finite, positive width and height. Without rows
there are no splits. Splits are few by nature: more than ``SPLITS`` are refused, as each is a column of the quantiles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sampleworks.functions.values import is_finite
from sampleworks.operators.ranges import quantiles

SPLITS = 200
SIDES = (0, 8, 16, 32, 64, 128, 256)


def split_names(df: DataFrame, split: str = "split") -> list:
    """The splits of a table, in order."""
    found = [r[0] for r in df.select(split).distinct().orderBy(split).limit(SPLITS + 1).collect()]
    if len(found) > SPLITS:
        raise ValueError(f"more than {SPLITS} splits")
    return found


def grouped_quantiles(df: DataFrame, group: str, columns: Sequence[str], shares: Sequence[float], *, nearest: bool = False) -> DataFrame:
    """``group`` and ``<column>_<percent>`` for each of a few groups: exact quantiles, found by counting in shared passes."""
    names = split_names(df, group)
    wide = df.select(*[F.when(F.col(group).eqNullSafe(F.lit(g)), F.col(c)).alias(f"__{i}_{c}") for i, g in enumerate(names) for c in columns])
    found = quantiles(wide, wide.columns, shares, nearest=nearest)
    rows = [(g, *(found[f"__{i}_{c}", q] for c in columns for q in shares)) for i, g in enumerate(names)]
    kinds = [f"{c}_{round(100 * q)} double" for c in columns for q in shares]
    return df.sparkSession.createDataFrame(rows, f"{group} {dict(df.dtypes)[group]}, {', '.join(kinds)}")


def _side(w: Column, h: Column) -> Column:
    """The side of a square as large as a box; null where the box has none."""
    return F.when(is_finite(w) & is_finite(h) & (w > 0) & (h > 0), F.sqrt(w.cast("double") * h.cast("double")))


def import_summary(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """``split, images, boxes, mean_boxes, median_boxes, p90_boxes, max_boxes, median_side, sizes`` of each split.

    Quantiles are at the nearest rank. Without boxes they are 0, as is the median side.
    """
    counts = annotations.groupBy("split", F.col("image_id").alias("id")).agg(F.count("*").alias("n"))
    # repeated pictures are joined once and count as often as they stand there
    each = images.groupBy("split", "id").agg(F.count("*").alias("times")).join(counts, ["split", "id"], "left").fillna(0, ["n"])
    totals = each.groupBy("split").agg(F.sum("times").alias("images"), F.sum(F.col("n") * F.col("times")).alias("boxes"), F.max("n").alias("max_boxes"))
    sizes = images.groupBy("split").agg(F.count_distinct(F.struct("width", "height")).alias("sizes"))
    per_count = each.groupBy("split", "n").agg(F.sum("times").alias("pictures"))  # as many rows as numbers of boxes
    upto = F.sum("pictures").over(Window.partitionBy("split").orderBy("n"))
    placed = per_count.withColumns({"upto": upto, "all": F.sum("pictures").over(Window.partitionBy("split"))})
    at = lambda q, name: F.min(F.when(F.col("upto") > F.rint(F.lit(q) * (F.col("all") - 1)), F.col("n"))).alias(name)
    ranks = placed.groupBy("split").agg(at(0.5, "median_boxes"), at(0.9, "p90_boxes"))
    sides = grouped_quantiles(annotations.select("split", _side(F.col("w"), F.col("h")).alias("side")), "split", ["side"], [0.5], nearest=True)
    sides = F.broadcast(sides.select("split", F.bround("side_50", 1).alias("median_side")))  # one row for each split
    found = totals.join(sizes, "split").join(ranks, "split").join(sides, "split", "left")
    return found.select("split", "images", "boxes", F.bround(F.col("boxes") / F.col("images"), 2).alias("mean_boxes"), "median_boxes", "p90_boxes", "max_boxes", F.coalesce("median_side", F.lit(0.0)).alias("median_side"), "sizes")


def side_histogram(annotations: DataFrame, edges: Sequence[float] = SIDES) -> DataFrame:
    """``split, low, high, boxes``: boxes by side, every bin of every split; the last bin has no upper end."""
    side = _side(F.col("w"), F.col("h"))
    bins = [(i, float(low), float(edges[i + 1]) if i + 1 < len(edges) else None) for i, low in enumerate(edges)]
    inside = [F.count_if((side >= low) & ((side < high) if high is not None else F.lit(True))).alias(f"b{i}") for i, low, high in bins]
    rows = F.array(*[F.struct(F.lit(low).alias("low"), F.lit(high).cast("double").alias("high"), F.col(f"b{i}").alias("boxes")) for i, low, high in bins])
    return annotations.groupBy("split").agg(*inside).select("split", F.inline(rows))


def top_sizes(images: DataFrame, k: int = 6) -> DataFrame:
    """``split, width, height, images, place``: the commonest picture sizes of each split, ties by width and height."""
    counts = images.groupBy("split", "width", "height").agg(F.count("*").alias("images"))
    place = F.row_number().over(Window.partitionBy("split").orderBy(F.desc("images"), "width", "height"))
    return counts.withColumn("place", place).filter(F.col("place") <= k)


def class_usage(categories: DataFrame, annotations: DataFrame, splits: Sequence[str] | None = None) -> DataFrame:
    """``id, name`` and boxes of each class by split, one column for each; a class that several splits name has the first one's name."""
    splits = split_names(annotations) if splits is None else list(splits)
    named = categories.filter("id IS NOT NULL AND name IS NOT NULL").groupBy("id").agg(F.min_by("name", "split").alias("name"))
    used = annotations.groupBy(F.col("category_id").alias("id")).pivot("split", splits).agg(F.count(F.lit(1)))
    return named.join(used, "id", "left").fillna(0, [str(s) for s in splits])
