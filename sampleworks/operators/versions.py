"""Version lineage, event logs, release gates and import preflight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def lineage(spark: SparkSession, edges: DataFrame, start: str, depth: int = 100) -> DataFrame:
    """``version, depth`` from ``start`` up first parents; a version is visited once."""
    return spark.sql(
        """WITH RECURSIVE up(version, depth, path) AS (
              SELECT :start, 0, array(:start)
              UNION ALL SELECT e.parent, u.depth + 1, array_append(u.path, e.parent) FROM up u JOIN {edges} e ON e.child = u.version
              WHERE e.place = 0 AND NOT array_contains(u.path, e.parent) AND u.depth < :depth)
            SELECT version, depth FROM up""",
        args={"start": start, "depth": depth},
        edges=edges,
    )


def descendants(spark: SparkSession, edges: DataFrame, start: str, depth: int = 100) -> DataFrame:
    """``version, depth`` of everything derived from ``start``, itself included, at its greatest depth."""
    return spark.sql(
        """WITH RECURSIVE down(version, depth, path) AS (
              SELECT :start, 0, array(:start)
              UNION ALL SELECT e.child, d.depth + 1, array_append(d.path, e.child) FROM down d JOIN {edges} e ON e.parent = d.version
              WHERE NOT array_contains(d.path, e.child) AND d.depth < :depth)
            SELECT version, max(depth) AS depth FROM down GROUP BY version""",
        args={"start": start, "depth": depth},
        edges=edges,
    )


def latest(spark: SparkSession, edges: DataFrame, catalog: DataFrame, start: str) -> DataFrame:
    """The deepest descendant, then the newest, then the last by name."""
    found = descendants(spark, edges, start).join(catalog, "version")
    return found.agg(F.max_by("version", F.struct("depth", "created", "version")).alias("version"))


def newest_sets(catalog: DataFrame, edges: DataFrame) -> DataFrame:
    """Of each base name the newest version that nothing was derived from."""
    leaves = catalog.join(edges.select(F.col("parent").alias("version")), "version", "left_anti")
    return leaves.groupBy("base_name").agg(F.max_by("version", F.struct("created", "version")).alias("version"))


def current_state(log: DataFrame, key: str, seq: str, status: str, comment: str) -> DataFrame:
    """Latest non-null status of each key and its number of comments."""
    return log.groupBy(key).agg(F.max_by(status, F.when(F.col(status).isNotNull(), F.col(seq))).alias("status"), F.count_if(F.coalesce(F.col(comment), F.lit("")) != "").alias("comments"))


def tag_fold(log: DataFrame, key: str, seq: str, tag: str, removed: str) -> DataFrame:
    """Live tags of each key: the last event of a tag decides."""
    last = log.groupBy(key, tag).agg(F.max_by(removed, seq).alias("__gone"))
    return last.filter(~F.col("__gone")).groupBy(key).agg(F.array_sort(F.collect_list(tag)).alias("tags"))


def ship_gate(images: DataFrame, state: DataFrame, key: str) -> DataFrame:
    """What keeps a set from being shipped: images without a reviewed state, by set."""
    open_ = images.join(state.filter(F.col("status") == "reviewed"), key, "left_anti")
    return open_.groupBy("set").agg(F.count("*").alias("open"))


def review_cost(events: DataFrame, since: str, until: str, *, key: str, reviewer: str, time: str, seconds: int = 20) -> DataFrame:
    """Decisions in a time window (inclusive), images, reviewers and estimated minutes."""
    inside = events.filter(F.col(time).between(since, until))
    return inside.agg(F.count("*").alias("decisions"), F.count_distinct(key).alias("images"), F.count_distinct(reviewer).alias("reviewers"), (F.count("*") * seconds / 60).alias("minutes"))


def rescaled(have: dict[str, int], targets: dict[str, int]) -> dict[str, int]:
    """Wanted sizes that add up to what there is, by largest remainder; ties to the later name."""
    unknown = sorted(set(targets) - set(have))
    if unknown:
        raise ValueError(f"no split named {unknown}")
    asked = {s: max(0, int(targets.get(s, n))) for s, n in have.items()}
    total, wanted = sum(have.values()), sum(asked.values())
    if wanted <= 0:
        raise ValueError("a plan must give some split rows")
    share = {s: (n * total) // wanted for s, n in asked.items()}
    left = {s: n * total / wanted - share[s] for s, n in asked.items()}
    for s in sorted(left, key=lambda s: (left[s], s), reverse=True)[: total - sum(share.values())]:
        share[s] += 1
    return share


def plan_splits(rows: DataFrame, split: str, order: str, targets: dict[str, int]) -> DataFrame:
    """``split -> target``: each split keeps its first rows up to its target; the surplus, in order of split,
    fills the splits with room, in order of name. Targets are proportions if they don't add up to the rows there are; a split
    without a target keeps its size; an unknown split is an error. Rows of no split aren't planned for and have no target."""
    numbered = rows.withColumn("__n", F.row_number().over(Window.partitionBy(split).orderBy(order)))
    have = {r[split]: r["n"] for r in rows.filter(F.col(split).isNotNull()).groupBy(split).agg(F.count("*").alias("n")).collect()}  # one row for each split
    if not have:
        return rows.withColumn("target", F.col(split))
    wanted, names = rescaled(have, targets), sorted(have)
    quota = F.create_map(*[x for s in names for x in (F.lit(s), F.lit(min(wanted[s], have[s])))])
    kept = F.col("__n") <= F.element_at(quota, F.col(split))
    offset, surplus = {}, 0
    for s in names:
        offset[s] = surplus
        surplus += max(0, have[s] - wanted[s])
    room, edge = [], 0
    for s in names:
        edge += max(0, wanted[s] - have[s])
        room.append((edge, s))
    place = F.element_at(F.create_map(*[x for s in names for x in (F.lit(s), F.lit(offset[s]))]), F.col(split)) + F.col("__n") - F.element_at(quota, F.col(split))
    target = F.when(F.col(split).isNull(), None).when(kept, F.col(split))
    for edge, s in room:
        target = target.when(place <= edge, s)
    return numbered.withColumn("target", target.otherwise(names[-1])).drop("__n")


def category_merge(categories: DataFrame) -> DataFrame:
    """``id, merged``: ids that share a folded name become the most used, ties the lowest."""
    same = Window.partitionBy(F.lower(F.trim("name")))
    return categories.select("id", F.max_by("id", F.struct("boxes", -F.col("id"))).over(same).alias("merged"))


KNOWN_CATEGORIES = 100_000  # category rows up to which they are sent to every task
# fixed values: category names that mark regions to ignore, and those that gather what fits no class
IGNORE_NAMES = r"(?i)^(ignored?[ _-]*(regions?|areas?)?|dont[ _-]*care|don't[ _-]*care|void|crowd)$"
CATCH_ALL_NAMES = r"(?i)^(others?|misc(ellaneous)?|unknown|background)$"
# fixed values: how exporters name a copy of a picture, and frames of one capture
EXPORTED = r"(?i)^(.+?)_(?:jpe?g|png|bmp|webp|tiff?)\.rf\.[0-9a-f]{16,}\.[A-Za-z]+$"
EXPORTED_STEM = r"^(.+?)(?:_[A-Za-z0-9]+)?\.rf\.[0-9a-f]{16,}\.[A-Za-z0-9]+$"
SEQUENCE = r"^([A-Za-z0-9]+)[_-][0-9]"


def source_key(image: Column, augmented_from: Column | None = None) -> Column:
    """Which picture an image is a copy of: where it says so, else the stem of an exported file's name without its folder,
    else itself."""
    stem = F.nullif(F.regexp_extract(F.element_at(F.split(F.replace(image, F.lit("\\"), F.lit("/")), "/"), -1), EXPORTED_STEM, 1), F.lit(""))
    known = [F.nullif(augmented_from, F.lit(""))] if augmented_from is not None else []
    return F.coalesce(*known, stem, image)


def original_name(file_name: Column, named: Column | None = None) -> Column:
    """The file that an exported image was made from, if its row or its name says so, else null."""
    stem = F.nullif(F.regexp_extract(file_name, EXPORTED, 1), F.lit(""))
    return F.coalesce(named, stem) if named is not None else stem


def sequence_of(name: Column) -> Column:
    """The leading token that frames of one capture share, or null."""
    return F.nullif(F.regexp_extract(F.element_at(F.split(name, "/"), -1), SEQUENCE, 1), F.lit(""))


def related_images(images: DataFrame) -> DataFrame:
    """``images`` with ``source`` and ``sequence``; sequences only where most files have one, and some share it.

    ``images`` has ``split, file_name`` and perhaps ``original``, a name that the export gives. A prefix counts as a sequence
    if there are two or more, four of five images have one, and it has two images on average.
    """
    source = original_name(F.col("file_name"), F.col("original") if "original" in images.columns else None)
    named = images.withColumn("source", source).withColumn("__sequence", sequence_of(F.coalesce("source", "file_name")))
    seen = named.agg(F.count_distinct("__sequence").alias("k"), F.count("__sequence").alias("with_one"), F.count("*").alias("n")).first()
    sequenced = seen.k >= 2 and seen.with_one >= 0.8 * seen.n and seen.with_one >= 2 * seen.k
    return named.withColumn("sequence", F.col("__sequence") if sequenced else F.lit(None).cast("string")).drop("__sequence")


def shared_groups(images: DataFrame, key: str) -> DataFrame:
    """Rows whose ``key`` several splits hold: what a held-out score can't be trusted for."""
    across = images.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct("split").alias("__k")).filter("__k > 1")
    return images.join(across.select(key), key, "left_semi")


def group_findings(images: DataFrame, digests: DataFrame | None = None) -> DataFrame:
    """``code, severity, split, n``: images that belong together by name, sequence or content.

    ``digests`` has ``split, id, sha1`` of the files. Counts are of images.
    """
    related = related_images(images).filter("id IS NOT NULL")
    parts = [
        ("images.export_copies", "info", related.filter("source IS NOT NULL").withColumn("__k", F.count("*").over(Window.partitionBy("split", "source"))).filter("__k > 1")),
        ("split.shared_source", "warn", shared_groups(related, "source")),
        ("split.shared_sequence", "warn", shared_groups(related, "sequence")),
    ]
    found = [rows.groupBy("split").agg(F.count("*").alias("n")).select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), "split", "n") for code, severity, rows in parts]
    if digests is not None:
        same = digests.filter("sha1 IS NOT NULL").groupBy("sha1").agg(F.count("*").alias("__k"), F.count_distinct("split").alias("__s")).filter("__k > 1")
        identical = digests.join(same, "sha1")
        severity = F.when(F.max("__s").over(Window.partitionBy()) > 1, "warn").otherwise("info")
        counted = identical.groupBy("split").agg(F.count("*").alias("n"), F.max("__s").alias("__s"))
        found.append(counted.select(F.lit("media.identical_files").alias("code"), severity.alias("severity"), "split", "n"))
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def media_findings(images: DataFrame, media: DataFrame) -> DataFrame:
    """``code, severity, split, n`` from what was seen of the files (``split, id, exists, readable, width, height``)."""
    seen = images.filter("id IS NOT NULL").select("split", "id", F.col("width").alias("__w"), F.col("height").alias("__h")).join(media, ["split", "id"])
    other = (F.col("__w") != F.col("width")) | (F.col("__h") != F.col("height"))
    code = F.when(~F.col("exists"), "media.missing").when(~F.col("readable"), "media.unreadable").when(F.col("width").isNotNull() & other, "media.size_mismatch")
    rows = seen.withColumn("code", code).filter("code IS NOT NULL")
    return rows.groupBy("code", "split").agg(F.count("*").alias("n")).select("code", F.when(F.col("code") == "media.size_mismatch", "warn").otherwise("block").alias("severity"), "split", "n")


def preflight(images: DataFrame, annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """``code, severity, split, n`` for every finding with rows.

    ``images`` has ``split, seq, id, file_name, width, height``; ``annotations`` ``split, id, image_id, category_id, x, y, w, h``;
    ``categories`` ``split, id, name``.
    """
    box = [F.col(c) for c in "xywh"]
    bad_number = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    invalid = bad_number(box[0]) | bad_number(box[1]) | bad_number(box[2]) | bad_number(box[3]) | (box[2] < 0) | (box[3] < 0)
    outside = (box[0] < -1) | (box[1] < -1) | (box[0] + box[2] > F.col("__size.width") + 1) | (box[1] + box[3] > F.col("__size.height") + 1)
    named = categories.groupBy("id").agg(F.min("name").alias("name"), F.count_distinct("name").alias("names"))
    known = named.select(F.col("id").alias("category_id"), F.lit(True).alias("__named"))
    if categories.count() <= KNOWN_CATEGORIES:
        known = F.broadcast(known)

    # images and annotations meet by picture; what is counted of either stays on the same partitions
    by_id = images.groupBy("split", F.col("id").alias("image_id")).agg(
        F.min_by(F.struct("width", "height"), "seq").alias("__size"), F.count("*").alias("__times"), F.count_if(F.col("id").isNull() | F.col("file_name").isNull()).alias("__malformed")
    )
    boxes = annotations.select("split", "image_id", "category_id", *"xywh", F.lit(True).alias("__box")).join(known, "category_id", "left")
    both = by_id.withColumn("__picture", F.lit(True)).join(boxes, ["split", "image_id"], "full_outer")
    box_there, picture = F.col("__box").isNotNull(), F.col("__picture").isNotNull()
    of_boxes = {
        ("annotations.orphan", "block"): ~picture,
        ("annotations.unknown_category", "block"): F.col("__named").isNull(),
        ("annotations.invalid_bbox", "block"): invalid,
        ("annotations.zero_area", "warn"): ~invalid & ((box[2] == 0) | (box[3] == 0)),
        ("annotations.out_of_bounds", "warn"): picture & ~invalid & outside,
        ("annotations.tiny", "info"): ~invalid & (box[2] > 0) & (box[3] > 0) & (F.least(box[2], box[3]) < 8),
    }
    named_id = F.col("image_id").isNotNull()
    per_picture = both.groupBy("split", "image_id").agg(
        *[F.count_if(box_there & when).alias(code) for (code, _), when in of_boxes.items()], F.count("__box").alias("__boxes"), F.max("__times").alias("__times"), F.max("__malformed").alias("__malformed")
    )
    of_pictures = {
        ("images.malformed", "block"): F.coalesce("__malformed", F.lit(0)),
        ("images.duplicate_id", "block"): F.when(named_id, F.col("__times") - 1),
        ("images.unannotated", "info"): F.when(named_id & F.col("__times").isNotNull() & (F.col("__boxes") == 0), 1),
        ("images.crowded", "info"): F.when(F.col("__boxes") >= 300, 1),
    }
    sums = per_picture.groupBy("split").agg(*[F.sum(F.col(f"`{code}`")).alias(code) for code, _ in of_boxes], *[F.sum(value).alias(code) for (code, _), value in of_pictures.items()])
    told = [F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.col("split"), F.coalesce(F.col(f"`{code}`"), F.lit(0)).cast("long").alias("n")) for code, severity in (*of_boxes, *of_pictures)]
    single = sums.select(F.inline(F.array(*told)))

    repeated = annotations.groupBy("split", "id").agg((F.count("*") - 1).alias("n")).filter("n > 0").groupBy("split").agg(F.sum("n").alias("n"))
    repeated = repeated.select(F.lit("annotations.duplicate_id").alias("code"), F.lit("warn").alias("severity"), "split", "n")

    # pictures by what they are copies of, each with the splits that hold it
    source = images.filter("file_name IS NOT NULL").groupBy(source_key(F.col("file_name")).alias("source"), "split").agg(F.count("*").alias("k"))
    held = source.groupBy("source").agg(F.collect_list(F.struct("split", "k")).alias("held"))  # as many as there are splits
    copies = F.transform(F.filter("held", lambda h: h["k"] > 1), lambda h: F.struct(F.lit("images.export_copies").alias("code"), F.lit("info").alias("severity"), h["split"].alias("split")))
    across = F.when(F.size(F.filter("held", lambda h: h["split"].isNotNull())) > 1, F.array(F.struct(F.lit("split.shared_source").alias("code"), F.lit("warn").alias("severity"), F.lit("all").alias("split"))))
    shared = held.select(F.inline(F.concat(copies, F.coalesce(across, F.slice(copies, 1, 0))))).groupBy("code", "severity", "split").agg(F.count("*").alias("n"))

    # categories, of which there are few
    folded = F.lower(F.trim("name"))
    used = annotations.groupBy(F.col("category_id").alias("id")).agg(F.count("*").alias("boxes"))
    counted = named.join(used, "id", "left").fillna(0, ["boxes"]).withColumn("__f", folded)
    counted = counted.withColumn("__first", F.row_number().over(Window.partitionBy("__f").orderBy("id")))
    judged = counted.agg(
        F.count_if(F.col("names") > 1).alias("categories.conflict"),
        F.count_if(F.col("__first") == 2).alias("categories.duplicate_name"),
        F.count_if(F.col("boxes") == 0).alias("categories.unused"),
        F.count_if(F.col("__f").rlike(IGNORE_NAMES) & (F.col("boxes") > 0)).alias("categories.ignore_region"),
        F.count_if(F.col("__f").rlike(CATCH_ALL_NAMES) & (F.col("boxes") > 0)).alias("categories.catch_all"),
    )
    severity = {"categories.conflict": "block", "categories.duplicate_name": "warn", "categories.unused": "info", "categories.ignore_region": "warn", "categories.catch_all": "info"}
    of_names = judged.select(F.inline(F.array(*[F.struct(F.lit(code).alias("code"), F.lit(s).alias("severity"), F.lit("all").alias("split"), F.col(f"`{code}`").alias("n")) for code, s in severity.items()])))
    return single.unionByName(repeated).unionByName(shared).unionByName(of_names).filter("n > 0")


def unreadable(documents: DataFrame) -> DataFrame:
    """``code, severity, split, n``: annotation files (``split, text``) that aren't JSON objects with lists of images, annotations and categories."""
    kinds = "images array<string>, annotations array<string>, categories array<string>"
    read = F.from_json("text", kinds)
    whole = read["images"].isNotNull() & read["annotations"].isNotNull() & read["categories"].isNotNull()
    bad = documents.filter(~F.coalesce(whole, F.lit(False)))
    return bad.groupBy("split").agg(F.count("*").alias("n")).select(F.lit("coco.unreadable").alias("code"), F.lit("block").alias("severity"), "split", "n")


def preflight_report(images: DataFrame, annotations: DataFrame, categories: DataFrame, *, media: DataFrame | None = None, digests: DataFrame | None = None, documents: DataFrame | None = None) -> DataFrame:
    """All findings as ``code, severity, split, n``: of :func:`preflight`, of groups (:func:`group_findings`, whose counts of images take
    the place of counts of sources), of the files that were looked at, and of documents that can't be read."""
    grouped = group_findings(images, digests)
    out = preflight(images, annotations, categories).filter(~F.col("code").isin("images.export_copies", "split.shared_source")).unionByName(grouped)
    if media is not None:
        out = out.unionByName(media_findings(images, media))
    return out if documents is None else out.unionByName(unreadable(documents))
