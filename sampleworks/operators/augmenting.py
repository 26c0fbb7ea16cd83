"""Augmented releases, geometry only: seeded affine maps over nested boxes, outlines and keypoints, cut to the picture.

Every copy of a row draws its map from a hash of seed, row and copy, so a lost task draws the same. A map is six numbers beside
the row (``x' = a x + b y + c``, ``y' = d x + e y + f``), composed step by step; objects are mapped inside their arrays, so no
picture is unfolded. Objects that leave the picture, or of which less than ``VISIBLE`` stays, are dropped.

Pictures are rows with ``width``, ``height`` and an array of objects with ``x0, y0, x1, y1`` and perhaps ``outline`` (points) and ``keypoints``
(points with ``v``). A null array stays null; a picture without a size isn't copied. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sampleworks.functions import geometry
from sampleworks.operators.ranges import row_numbers
from sampleworks.operators.sampling import _uniform

VISIBLE = 0.15  # of a box's mapped area that must stay in the picture
FROM = "augmented_from"
TURNS = ("clockwise", "counterclockwise", "upside_down")
Step = tuple[Column, Column, Column, Column, Column, Column]


def _then(df: DataFrame, step: Step) -> DataFrame:
    """``df`` with another map after the one it has."""
    m = [F.col(f"__m{i}") for i in range(6)]
    a, b, c, d, e, f = step
    return df.withColumns({"__m0": a * m[0] + b * m[3], "__m1": a * m[1] + b * m[4], "__m2": a * m[2] + b * m[5] + c, "__m3": d * m[0] + e * m[3], "__m4": d * m[1] + e * m[4], "__m5": d * m[2] + e * m[5] + f})


def _about_centre(a: Column, b: Column, d: Column, e: Column) -> Step:
    x, y = F.col("__w") / 2, F.col("__h") / 2
    return a, b, x - a * x - b * y, d, e, y - d * x - e * y


def drawn(df: DataFrame, recipe: Mapping[str, Mapping[str, float]], copies: int, *, row: str = "_row", seed: int = 0) -> DataFrame:
    """``copies`` rows of each picture with ``copy`` (from 1), the map ``__m0`` to ``__m5``, its size ``__w, __h`` and ``__flipped``.

    A recipe may have ``flip`` (``horizontal``, ``vertical``), ``rotate90`` (some of ``TURNS``; one of them or none), ``crop``
    (per cent cut away), ``rotation`` (degrees), ``shear`` (degrees, ``horizontal``, ``vertical``), ``translation`` (per cent,
    ``horizontal_min`` ...) and ``zoom`` (per cent); ranges have ``min`` and ``max``.
    """
    unknown = set(recipe) - {"flip", "rotate90", "crop", "rotation", "shear", "translation", "zoom"}
    if unknown or copies < 1:
        raise ValueError(f"unknown steps {sorted(unknown)}" if unknown else "at least one copy")
    one, zero = F.lit(1.0), F.lit(0.0)
    draw = lambda name: _uniform(seed, row, "copy", F.lit(name))
    between = lambda name, low, high: low + (high - low) * draw(name)
    steps = df.filter("width > 0 AND height > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    steps = steps.withColumns({"__w": F.col("width").cast("double"), "__h": F.col("height").cast("double"), "__flipped": F.lit(False), **{f"__m{i}": F.lit(float(i in (0, 4))) for i in range(6)}})
    w, h = F.col("__w"), F.col("__h")
    flip = recipe.get("flip", {})
    if flip.get("horizontal"):
        steps = steps.withColumn("__flipped", draw("horizontal") < 0.5)
        steps = _then(steps, (F.when(F.col("__flipped"), -1.0).otherwise(1.0), zero, F.when(F.col("__flipped"), w).otherwise(0.0), zero, one, zero))
    if flip.get("vertical"):
        over = draw("vertical") < 0.5
        steps = _then(steps, (one, zero, zero, zero, F.when(over, -1.0).otherwise(1.0), F.when(over, h).otherwise(0.0)))
    turns = [t for t in TURNS if recipe.get("rotate90", {}).get(t)]
    if turns:
        steps = steps.withColumn("__turn", F.try_element_at(F.array(*map(F.lit, turns)), (F.floor(draw("turn") * (len(turns) + 1)) + 1).cast("int")))
        pick = lambda clockwise, counter, down, none: F.when(F.col("__turn") == TURNS[0], clockwise).when(F.col("__turn") == TURNS[1], counter).when(F.col("__turn") == TURNS[2], down).otherwise(none)
        steps = _then(steps, (pick(zero, zero, -one, one), pick(-one, one, zero, zero), pick(h, zero, w, zero), pick(one, -one, zero, zero), pick(zero, zero, -one, one), pick(zero, w, h, zero)))
        aside = F.coalesce(F.col("__turn").isin(*TURNS[:2]), F.lit(False))
        steps = steps.withColumn("__was", w).withColumns({"__w": F.when(aside, h).otherwise(w), "__h": F.when(aside, F.col("__was")).otherwise(h)}).drop("__was", "__turn")
    if "crop" in recipe:
        scale = 1 / (1 - between("crop", recipe["crop"]["min"], recipe["crop"]["max"]) / 100)
        steps = steps.withColumn("__s", scale)
        s = F.col("__s")
        steps = _then(steps, (s, zero, -(draw("crop x") * (w - w / s)) * s, zero, s, -(draw("crop y") * (h - h / s)) * s)).drop("__s")
    if "rotation" in recipe:
        angle = F.radians(between("rotation", recipe["rotation"]["min"], recipe["rotation"]["max"]))
        steps = _then(steps, _about_centre(F.cos(angle), -F.sin(angle), F.sin(angle), F.cos(angle)))
    if "shear" in recipe:
        lean = lambda way: F.tan(F.radians((2 * draw(f"shear {way}") - 1) * recipe["shear"][way]))
        steps = _then(steps, _about_centre(one, lean("horizontal"), lean("vertical"), one))
    if "translation" in recipe:
        t = recipe["translation"]
        by = lambda way, side: between(f"translation {way}", t[f"{way}_min"], t[f"{way}_max"]) / 100 * side
        steps = _then(steps, (one, zero, by("horizontal", w), zero, one, by("vertical", h)))
    if "zoom" in recipe:
        z = between("zoom", recipe["zoom"]["min"], recipe["zoom"]["max"]) / 100
        steps = _then(steps, _about_centre(z, zero, zero, z))
    return steps.withColumns({"__w": F.round("__w"), "__h": F.round("__h")})


def _point(x: Column, y: Column) -> tuple[Column, Column]:
    m = [F.col(f"__m{i}") for i in range(6)]
    return m[0] * x + m[1] * y + m[2], m[3] * x + m[4] * y + m[5]


def _moved(o: Column, fields: Sequence[str], flip_indices: Sequence[int] | None) -> Column:
    """An object after its map: its box, how much of it is seen, and its other shapes."""
    w, h = F.col("__w"), F.col("__h")
    corners = [_point(o[x], o[y]) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))]
    low_x, low_y = (F.least(*[c[i] for c in corners]) for i in (0, 1))
    high_x, high_y = (F.greatest(*[c[i] for c in corners]) for i in (0, 1))
    box = {"x0": F.greatest(low_x, F.lit(0.0)), "y0": F.greatest(low_y, F.lit(0.0)), "x1": F.least(high_x, w), "y1": F.least(high_y, h)}
    whole = (high_x - low_x) * (high_y - low_y)
    out = {f: o[f] for f in fields}
    if "outline" in fields:
        points = F.transform(o["outline"], lambda p: F.struct(_point(p["x"], p["y"])[0].alias("x"), _point(p["x"], p["y"])[1].alias("y")))
        cut = geometry.clipped(F.coalesce(points, F.array().cast(geometry.POINTS)), w, h)
        has = F.size(cut) >= 3
        xs, ys = (F.transform(cut, lambda p: p[axis]) for axis in ("x", "y"))  # noqa: B023
        box = {"x0": F.when(has, F.array_min(xs)).otherwise(box["x0"]), "y0": F.when(has, F.array_min(ys)).otherwise(box["y0"]), "x1": F.when(has, F.array_max(xs)).otherwise(box["x1"]), "y1": F.when(has, F.array_max(ys)).otherwise(box["y1"])}
        out["outline"] = F.when(has, F.transform(cut, lambda p: F.struct(F.round(p["x"], 2).alias("x"), F.round(p["y"], 2).alias("y"))))
    if "keypoints" in fields:

        def shown(p: Column) -> Column:
            x, y = _point(p["x"], p["y"])
            seen = (p["v"] > 0) & x.between(0, w) & y.between(0, h)
            return F.struct(F.when(seen, F.round(x, 2)).otherwise(0.0).alias("x"), F.when(seen, F.round(y, 2)).otherwise(0.0).alias("y"), F.when(seen, p["v"]).otherwise(0).cast("int").alias("v"))

        points = F.transform(o["keypoints"], shown)
        if flip_indices is not None:
            points = F.when(F.col("__flipped"), F.transform(F.array(*map(F.lit, flip_indices)), lambda i: F.try_element_at(points, i + 1))).otherwise(points)
        out["keypoints"] = points
    seen = F.greatest(box["x1"] - box["x0"], F.lit(0.0)) * F.greatest(box["y1"] - box["y0"], F.lit(0.0))
    outlined = out["outline"].isNotNull() if "outline" in fields else F.lit(False)
    kept = (box["x1"] - box["x0"] >= 1) & (box["y1"] - box["y0"] >= 1) & (outlined | (seen >= VISIBLE * F.greatest(whole, F.lit(1e-9))))
    out |= {k: F.round(v, 2) for k, v in box.items()}
    return F.struct(*[out[f].alias(f) for f in fields], kept.alias("__kept"))


def augmented(df: DataFrame, recipe: Mapping[str, Mapping[str, float]], copies: int, *, objects: str = "objects", sample: str = "image", row: str = "_row", seed: int = 0, flip_indices: Sequence[int] | None = None) -> DataFrame:
    """The augmented copies alone: the columns of ``df`` with mapped objects and sizes, ``copy`` and ``augmented_from``.

    With keypoints a horizontal flip needs ``flip_indices``, which names left and right anew: a permutation that undoes itself.
    """
    fields = df.schema[objects].dataType.elementType.fieldNames()
    if "keypoints" in fields and recipe.get("flip", {}).get("horizontal") and flip_indices is None:
        raise ValueError("a horizontal flip of keypoints needs flip indices")
    if flip_indices is not None and (sorted(flip_indices) != list(range(len(flip_indices))) or any(flip_indices[i] != n for n, i in enumerate(flip_indices))):
        raise ValueError("flip indices are a permutation that undoes itself")
    steps = drawn(df, recipe, copies, row=row, seed=seed)
    steps = steps.withColumn("__moved", F.transform(objects, lambda o: _moved(o, fields, flip_indices)))
    kept = F.filter("__moved", lambda o: o["__kept"])
    mapped = F.transform(kept, lambda o: F.struct(*[o[f].alias(f) for f in fields]))
    values = {objects: mapped.cast(df.schema[objects].dataType), "width": F.col("__w").cast(df.schema["width"].dataType), "height": F.col("__h").cast(df.schema["height"].dataType)}
    return steps.select(*[values[c].alias(c) if c in values else F.col(c) for c in df.columns], "copy", F.col(sample).cast("string").alias(FROM))


def augmented_release(df: DataFrame, recipe: Mapping[str, Mapping[str, float]], copies: int, *, id_col: str = "image_id", **more) -> DataFrame:
    """Originals and copies as one table: copies have ids after the largest one, in order of row and copy, and ``augmented_from``."""
    row = more.get("row", "_row")
    most = df.agg(F.coalesce(F.max(id_col), F.lit(-1))).first()[0]
    new = row_numbers(augmented(df, recipe, copies, **more), [row, "copy"], "__n")
    new = new.withColumn(id_col, (F.col("__n") + F.lit(most + 1)).cast(df.schema[id_col].dataType)).drop("__n")
    return df.withColumns({"copy": F.lit(0), FROM: F.lit(None).cast("string")}).unionByName(new)
