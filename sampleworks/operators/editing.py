"""New versions from edits: columns, classes and cells, commits against a head, and which version is meant."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sampleworks.operators import versions
from sampleworks.operators.joining import set_values

KINDS = {"bool": "boolean", "string": "string", "float32": "float", "int32": "int"}
CLASSES = "classes"  # key of a column's metadata
# fixed values: operations after which every row is where it was
ROW_PRESERVING = ("edit", "set_values", "add_column", "delete_columns", "set_value_map", "add_value_map_item", "set_value_map_item", "delete_value_map_item", "compute_plugin")


class EditError(ValueError):
    """An edit that can't be made; the table stays as it is."""


def class_map(df: DataFrame, column: str) -> dict[int, dict[str, Any]]:
    """Index to ``name, display, colour`` of a column's classes, from its metadata; empty without."""
    found = df.schema[column].metadata.get(CLASSES, {})
    return {int(k): dict(v) for k, v in found.items()}


def with_class_map(df: DataFrame, column: str, classes: Mapping[int, str | Mapping[str, Any]]) -> DataFrame:
    """The same rows with another class map; a class is a name or ``name, display, colour``."""
    full = {str(int(k)): {"name": v} if isinstance(v, str) else dict(v) for k, v in classes.items()}
    if any(not c.get("name") for c in full.values()):
        raise EditError("a class needs a name")
    return df.withMetadata(column, {**df.schema[column].metadata, CLASSES: full})


def add_class(df: DataFrame, column: str, name: str, **more: Any) -> DataFrame:
    """One class more, at the next index; a name that is taken is an error."""
    known = class_map(df, column)
    if any(c["name"] == name for c in known.values()):
        raise EditError(f"there is a class {name!r}")
    return with_class_map(df, column, {**known, max(known, default=-1) + 1: {"name": name, **more}})


def edit_class(df: DataFrame, column: str, index: int, **changes: Any) -> DataFrame:
    known = class_map(df, column)
    if index not in known:
        raise EditError(f"no class {index}")
    return with_class_map(df, column, {**known, index: {**known[index], **changes}})


def delete_class(df: DataFrame, column: str, index: int) -> DataFrame:
    known = class_map(df, column)
    if index not in known:
        raise EditError(f"no class {index}")
    return with_class_map(df, column, {k: v for k, v in known.items() if k != index})


def _labels(df: DataFrame, column: str) -> Column:
    """The class indexes that a cell of a class or instance column holds, as an array."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda i: i["label"].cast("int"))
    return F.array(F.col(column).cast("int"))


def unknown_classes(df: DataFrame, column: str, classes: Sequence[int]) -> DataFrame:
    """``label, n``: classes that rows still have and a map doesn't."""
    used = df.select(F.explode(_labels(df, column)).alias("label")).filter(F.col("label").isNotNull() & ~F.col("label").isin(*classes))
    return used.groupBy("label").agg(F.count("*").alias("n"))


def _grown(fresh: list[tuple[str, str]]) -> Callable[[Column], Column]:
    def one(i: Column) -> Column:
        for name, kind in fresh:
            i = i.withField(name, F.lit(None).cast(kind))
        return i

    return one


def apply_edits(
    df: DataFrame, *, new_columns: Mapping[str, tuple[str, Any]] | None = None, instance_properties: Mapping[str, Mapping[str, str]] | None = None, class_maps: Mapping[str, Mapping[int, Any]] | None = None,
    values: Mapping[str, DataFrame] | None = None, read_only: Sequence[str] = (), row: str = "_row",
) -> DataFrame:
    """All edits of a session at once: new columns, then properties of instances, class maps, and cells (frames of ``row, value``).

    Read-only columns, cells outside the table, values of another kind and maps that leave out a class in use are errors.
    """
    if not any((new_columns, instance_properties, class_maps, values)):
        raise EditError("no edits")
    out = df
    for name, (kind, default) in (new_columns or {}).items():
        if name in out.columns:
            raise EditError(f"there is a column {name!r}")
        if kind not in KINDS:
            raise EditError(f"no kind {kind!r}")
        out = out.withColumn(name, F.lit(default).cast(KINDS[kind]))
    for name, added in (instance_properties or {}).items():
        kind = out.schema[name].dataType if name in out.columns else None
        if not isinstance(kind, T.ArrayType):
            raise EditError(f"{name!r} holds no instances")
        there = {f.name: f.dataType.simpleString() for f in kind.elementType.fields}
        if any(there.get(p, k) != k for p, k in added.items()):
            raise EditError(f"{name!r} has a property of another kind")

        out = out.withColumn(name, F.transform(name, _grown([(p, k) for p, k in added.items() if p not in there])))
    for name, classes in (class_maps or {}).items():
        out = with_class_map(out, name, classes)
    for name, cells in (values or {}).items():
        if name in read_only or name not in out.columns:
            raise EditError(f"{name!r} can't be edited")
        if cells.join(out.select(row), row, "left_anti").limit(1).count():
            raise EditError(f"a cell of {name!r} lies outside the table")
        meta, kind = out.schema[name].metadata, out.schema[name].dataType
        safe = isinstance(kind, T.StringType) == isinstance(cells.schema["value"].dataType, T.StringType) and isinstance(kind, T.BooleanType) == isinstance(cells.schema["value"].dataType, T.BooleanType)
        if not safe:
            raise EditError(f"{name!r} holds another kind of value")
        if name == "weight" and cells.filter("value IS NULL OR value < 0").limit(1).count():
            raise EditError("a weight is a number of 0 or more")
        out = set_values(out, cells.withColumn("value", F.col("value").cast(kind)), name, row).withMetadata(name, meta)
    for name in class_maps or {}:
        left = unknown_classes(out, name, [int(k) for k in class_maps[name]]).limit(5).collect()
        if left:
            raise EditError(f"{name!r} still has rows of classes {sorted(r['label'] for r in left)}")
    return out


def edit_effects(edits: DataFrame, applied: DataFrame) -> DataFrame:
    """``column, cells, changed``: cells that a session names, and those that it changes."""
    return edits.groupBy("column").agg(F.count("*").alias("cells")).join(applied.groupBy("column").agg(F.count("*").alias("changed")), "column", "left").fillna(0, ["changed"])


def reverted(edits: DataFrame, group: Any) -> DataFrame:
    """A log of edits with one more event for each cell of a group that puts back what was there before the group."""
    mine = edits.filter(F.col("grp") == group).groupBy("row", "column").agg(F.min_by("before", "seq").alias("after"), F.max_by("after", "seq").alias("before"))
    top = edits.agg(F.max("seq").alias("__top"))
    back = mine.crossJoin(F.broadcast(top))  # one row
    placed = back.select("row", "column", "before", "after", (F.col("__top") + F.row_number().over(Window.partitionBy("column").orderBy("row"))).alias("seq"), F.lit(None).cast(edits.schema["grp"].dataType).alias("grp"))
    return edits.select("row", "column", "before", "after", "seq", "grp").unionByName(placed)


def displayed_rows(joined: DataFrame, targets: DataFrame, source: str = "_src", example: str = "example_id") -> DataFrame:
    """Every displayed row of each (source, example) that an edit aims at."""
    return joined.join(targets.select(source, example).distinct(), [source, example], "left_semi")


def prelabelled(rows: DataFrame, drafts: DataFrame, *, mode: str = "empty", confidence: float = 0.25, column: str = "instances", row: str = "_row") -> DataFrame:
    """Rows with a model's boxes written in: into unlabelled rows only (``empty``), or in place of all drafts (``replace``).

    ``drafts`` has ``row, instances`` with ``score``. What was there is ``manual`` unless it says otherwise, drafts are ``model``;
    ``replace`` keeps boxes that people drew. A row without drafts stays as it is.
    """
    if mode not in ("empty", "replace"):
        raise EditError(f"no mode {mode!r}")
    fields = rows.schema[column].dataType.elementType.fieldNames()
    kept = [f for f in ("x0", "y0", "x1", "y1", "label") if f in fields]
    shape = lambda i, source, score: F.struct(*[i[f].alias(f) for f in kept], source.alias("source"), score.cast("double").alias("confidence"))
    own = F.transform(F.coalesce(F.col(column), F.array().cast(rows.schema[column].dataType)), lambda i: shape(i, F.coalesce(i["source"], F.lit("manual")) if "source" in fields else F.lit("manual"), i["confidence"] if "confidence" in fields else F.lit(None)))
    side = drafts.select(F.col(row).alias("__row"), F.transform(F.filter("instances", lambda d: d["score"] >= confidence), lambda d: shape(d, F.lit("model"), d["score"])).alias("__new"))
    both = rows.withColumn("__own", own).join(side, F.col(row) == F.col("__row"), "left")
    new = F.coalesce("__new", F.filter("__own", lambda i: F.lit(False)))
    if mode == "empty":
        cell = F.when(F.size("__own") == 0, new).otherwise(F.col("__own"))
    else:
        cell = F.when(F.col("__new").isNull(), F.col("__own")).otherwise(F.concat(F.filter("__own", lambda i: i["source"] == "manual"), new))
    return both.select(*[cell.alias(c) if c == column else F.col(c) for c in rows.columns])


def class_filtered(rows: DataFrame, names: Sequence[str], *, keep_others: bool, column: str = "instances", image: str = "image", order: Sequence[str] = ("project", "split")) -> DataFrame:
    """Images of several sets that hold one of the named classes, in any case of letters: the first set that has an image gives
    it. ``keep_others`` keeps its boxes of other classes. Instances have ``name``."""
    wanted = [n.strip().lower() for n in names]
    chosen = lambda i: F.lower(F.trim(i["name"])).isin(*wanted)
    held = rows.filter(F.exists(column, chosen))
    first = held.withColumn("__n", F.row_number().over(Window.partitionBy(image).orderBy(*order))).filter("__n = 1").drop("__n")
    return first if keep_others else first.withColumn(column, F.filter(column, chosen))


def revision(spark: SparkSession, edges: DataFrame, catalog: DataFrame, start: str, *, name: str | None = None, version: str | None = None) -> DataFrame:
    """The version meant, by name or path, else the latest; it must derive from ``start``, else that is an error."""
    family = versions.descendants(spark, edges, start)
    if name is None and version is None:
        return versions.latest(spark, edges, catalog, start)
    wanted = catalog.filter(F.col("name") == name if version is None else F.col("version") == version).select("version").limit(1)
    found = wanted.join(family, "version", "left")
    fault = F.raise_error(F.concat(F.lit(f"no descendant of {start}: "), F.col("version")))
    checked = found.select(F.when(F.col("depth").isNull(), fault.cast("string")).otherwise(F.col("version")).alias("version"))
    if not wanted.count():
        raise EditError(f"no version {version or name!r}")
    return checked


def root_producer(spark: SparkSession, edges: DataFrame, catalog: DataFrame, start: str, op: str) -> DataFrame:
    """``version, args`` of the nearest ancestor that an operation made; none if there is none."""
    up = versions.lineage(spark, edges, start).join(catalog.filter(F.col("op") == op), "version")
    return up.agg(F.min_by(F.struct("version", "args"), "depth").alias("r")).filter("r IS NOT NULL").select("r.*")


def preserving_revision(spark: SparkSession, edges: DataFrame, catalog: DataFrame, start: str) -> DataFrame:
    """``version, reason``: the deepest, then newest, descendant whose rows are those of ``start`` at the same positions.

    Steps are versions with one parent, made by an operation that keeps positions, with as many rows. Without one it is
    ``start`` itself, with what stood in the way if it has children.
    """
    size = catalog.filter(F.col("version") == start).select(F.col("row_count").alias("__rows"))
    parents = edges.groupBy("child").agg(F.count("*").alias("parents"))
    steps = catalog.join(parents, F.col("version") == F.col("child")).drop("child").crossJoin(F.broadcast(size))  # one row
    fault = F.when(F.col("parents") > 1, "several parents").when(~F.col("op").isin(*ROW_PRESERVING), "rows may have moved").when(F.col("row_count") != F.col("__rows"), "another number of rows")
    judged = steps.withColumn("fault", fault)
    good = edges.join(judged.filter("fault IS NULL").select(F.col("version").alias("child")), "child", "left_semi")
    best = versions.latest(spark, good, catalog, start)
    blocked = edges.filter(F.col("parent") == start).join(judged.select(F.col("version").alias("child"), "fault"), "child").agg(F.min("fault").alias("fault"))
    return best.crossJoin(F.broadcast(blocked)).select("version", F.when(F.col("version") == start, F.col("fault")).alias("reason"))  # one row each


def commit(heads: DataFrame, requests: DataFrame) -> DataFrame:
    """``request, outcome``: what becomes of requests (``request, dataset, parent, fingerprint, seq``) against the heads (``dataset,
    version, fingerprints``: those committed already): ``done before``, ``conflict`` where the head isn't the parent, else
    ``commit`` for the first of a data set and ``conflict`` for later ones."""
    both = requests.join(heads, "dataset", "left")
    again = F.coalesce(F.array_contains("fingerprints", F.col("fingerprint")), F.lit(False))
    open_ = ~again & F.coalesce(F.col("version") == F.col("parent"), F.lit(False))
    first = F.min(F.when(open_, F.col("seq"))).over(Window.partitionBy("dataset"))
    marked = both.withColumns({"__first": first, "__open": open_, "__again": again})
    return marked.select("request", F.when(F.col("__again"), "done before").when(F.col("__open") & (F.col("seq") == F.col("__first")), "commit").otherwise("conflict").alias("outcome"))


def resolved(annotations: DataFrame, choices: Mapping[str, str], removed: Sequence[int], remap: Mapping[int, int], ignored: Sequence[int]) -> DataFrame:
    """Annotations as findings were resolved, with ``iscrowd`` and ``effect``: what was done to each, null for nothing.

    Rows have ``category_id, x, y, w, h, width, height``. Choices by code are ``exclude``, ``keep`` or ``clip``; a category may be
    removed, merged into another, or mark regions to ignore. Excluded rows keep their effect and have no box.
    """
    bad = F.lit(False)
    for c in "xywh":
        bad |= F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    bad |= (F.col("w") < 0) | (F.col("h") < 0)
    flat = (F.col("w") == 0) | (F.col("h") == 0)
    outside = (F.col("x") < -1) | (F.col("y") < -1) | (F.col("x") + F.col("w") > F.col("width") + 1) | (F.col("y") + F.col("h") > F.col("height") + 1)
    chosen = lambda code, default: F.lit(choices.get(code, default))
    gone = F.when(F.col("category_id").isin(*removed), "removed category").when(bad, "invalid box").when(flat & (chosen("annotations.zero_area", "exclude") == "exclude"), "zero area").when(outside & (chosen("annotations.out_of_bounds", "clip") == "exclude"), "out of bounds")
    clipped = outside & (chosen("annotations.out_of_bounds", "clip") == "clip") & gone.isNull()
    x0, y0 = F.greatest("x", F.lit(0.0)), F.greatest("y", F.lit(0.0))
    x1, y1 = F.least(F.col("x") + F.col("w"), F.col("width")), F.least(F.col("y") + F.col("h"), F.col("height"))
    names = F.create_map(*[x for k, v in remap.items() for x in (F.lit(k), F.lit(v))]) if remap else F.create_map().cast("map<int,int>")
    merged = F.try_element_at(names, F.col("category_id").cast("int"))
    effect = F.coalesce(gone, F.when(clipped, "clipped").when(merged.isNotNull(), "merged").when(F.col("category_id").isin(*ignored), "ignored region"))
    box = lambda inside, own: F.when(gone.isNotNull(), None).when(clipped, inside).otherwise(own)
    return annotations.withColumns({
        "x": box(x0, F.col("x")), "y": box(y0, F.col("y")), "w": box(F.greatest(x1 - x0, F.lit(0.0)), F.col("w")), "h": box(F.greatest(y1 - y0, F.lit(0.0)), F.col("h")),
        "iscrowd": F.col("category_id").isin(*ignored).cast("int"), "category_id": F.coalesce(merged.cast("long"), F.col("category_id").cast("long")), "effect": effect,
    })


def merged_categories(categories: DataFrame) -> DataFrame:
    """The first definition of each id over all splits, in order of id (``split, id, name``)."""
    first = Window.partitionBy("id").orderBy("split", "name")
    return categories.withColumn("__n", F.row_number().over(first)).filter("__n = 1").select("id", "name").orderBy("id")
