"""What predictions say about labels: findings of one round and over rounds, trust, differences and health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sampleworks.operators.matching import greedy_match, iou, matched

NONE, CLEAR = 0.1, 0.5
MIN_SHARE = {"missing_label": 0.2, "wrong_class": 0.2, "loose_box": 0.2, "missed": 0.5}


def prediction_findings(truth: Column, predictions: Column, confidence: float = 0.5) -> Column:
    """``rule, label, predicted, place, score, overlap`` of confident predictions that took no label of their class.

    Against its best label a prediction overlaps under 0.1 (missing label), 0.5 or more in another class (wrong
    class), or less in the same class (loose box); anything else says nothing.
    """
    matches = matched(truth, predictions, CLEAR, class_aware=True)
    unmatched = F.filter(matches, lambda m: (m["truth"] < 0) & (F.element_at(predictions, m["place"] + 1)["score"] >= confidence))

    def finding(m: Column) -> Column:
        p = F.element_at(predictions, m["place"] + 1)
        label = F.try_element_at(truth, m["best"] + 1)["label"]
        overlap = F.coalesce(m["overlap"], F.lit(0.0))
        rule = F.when(overlap < NONE, "missing_label").when((overlap >= CLEAR) & (label != p["label"]), "wrong_class").when((overlap < CLEAR) & (label == p["label"]), "loose_box")
        return F.struct(rule.alias("rule"), F.when(rule != "missing_label", label).alias("label"), p["label"].alias("predicted"), F.when(rule == "missing_label", -1).otherwise(m["best"]).cast("int").alias("place"), p["score"].alias("score"), overlap.alias("overlap"))

    return F.filter(F.transform(unmatched, finding), lambda f: f["rule"].isNotNull())


def missed_labels(truth: Column, predictions: Column, confidence: float = 0.5) -> Column:
    """Labels that no confident prediction took, in the form of the findings."""
    sure = F.filter(predictions, lambda p: p["score"] >= confidence)
    taken = greedy_match(truth, sure, CLEAR, class_aware=False)
    lost = F.array_except(F.transform(truth, lambda t, i: i), F.transform(taken, lambda m: m["truth"]))
    return F.transform(lost, lambda i: F.struct(F.lit("missed").alias("rule"), F.element_at(truth, i + 1)["label"].alias("label"), F.lit(None).cast("int").alias("predicted"), i.cast("int").alias("place"), F.lit(1.0).cast("double").alias("score"), F.lit(None).cast("double").alias("overlap")))


def round_findings(df: DataFrame, keys: list[str], truth: str = "truth", predicted: str = "predicted", confidence: float = 0.5) -> DataFrame:
    """One row for each finding of each image and round."""
    both = F.concat(prediction_findings(F.col(truth), F.col(predicted), confidence), missed_labels(F.col(truth), F.col(predicted), confidence))
    return df.select(*keys, F.inline(both))


def recurring(findings: DataFrame, rounds: int, image: str = "image", epoch: str = "epoch") -> DataFrame:
    """Findings that return: in two rounds or more and in the rule's share of them; score is share times mean confidence."""
    grouped = findings.groupBy(image, "rule", "place", "label").agg(F.count_distinct(epoch).alias("seen"), F.avg("score").alias("confidence"), F.mode("predicted").alias("predicted"))
    share = F.col("seen") / F.lit(rounds)
    least = F.element_at(F.create_map(*[x for k, v in MIN_SHARE.items() for x in (F.lit(k), F.lit(v))]), F.col("rule"))
    return grouped.withColumn("share", share).filter((F.col("seen") >= 2) & (F.col("share") >= least)).withColumn("score", F.col("share") * F.col("confidence"))


def image_trust(qualities: DataFrame, image: str, quality: str, temperature: float = 0.1) -> DataFrame:
    """Soft minimum of the qualities of an image's labels."""
    weight = F.exp(-F.col(quality) / temperature)
    return qualities.groupBy(image).agg((F.sum(F.col(quality) * weight) / F.sum(weight)).alias("trust"))


def label_diff(df: DataFrame, before: str, after: str) -> DataFrame:
    """``df`` with counts of identical, relabelled, moved, unchanged, added and removed boxes between two versions.

    Boxes equal in class and coordinates to two places pair first; of the rest each old box, in order of position, takes the
    free new one that it overlaps most, by 0.5 or more, whatever the class; a pair under 0.9 has moved. Each step is a column of its own, so that
    none is worked out twice.
    """
    key = lambda b: F.concat_ws(",", b["label"].cast("string"), *[F.round(b[c], 2).cast("string") for c in ("x0", "y0", "x1", "y1")])
    # the second of two equal boxes has a key of its own
    numbered = lambda keys: F.transform(keys, lambda k, i: F.concat_ws("#", k, F.size(F.filter(F.slice(keys, 1, i + 1), lambda o: o == k)).cast("string")))
    left = lambda boxes, keys: F.filter(boxes, lambda b, i: ~F.array_contains("__same", F.element_at(keys, i + 1)))
    steps = df.withColumns({"__k0": F.transform(before, key), "__k1": F.transform(after, key)})
    steps = steps.withColumns({"__n0": numbered(F.col("__k0")), "__n1": numbered(F.col("__k1"))}).withColumn("__same", F.array_intersect("__n0", "__n1"))
    steps = steps.withColumns({"__old": left(F.col(before), F.col("__n0")), "__new": left(F.col(after), F.col("__n1"))})
    scored = F.transform("__old", lambda b: F.struct(*[b[c].alias(c) for c in ("x0", "y0", "x1", "y1", "label")], F.lit(0.0).alias("score")))
    steps = steps.withColumn("__scored", scored).withColumn("__pairs", F.filter(greedy_match(F.col("__new"), F.col("__scored"), 0.5, class_aware=False), lambda m: m["truth"] >= 0))
    old, new = lambda m: F.element_at("__old", m["place"] + 1), lambda m: F.element_at("__new", m["truth"] + 1)
    relabelled = F.size(F.filter("__pairs", lambda m: old(m)["label"] != new(m)["label"]))
    moved = F.size(F.filter("__pairs", lambda m: (old(m)["label"] == new(m)["label"]) & (iou(old(m), new(m)) < 0.9)))
    counted = steps.withColumns({"identical": F.size("__same"), "relabelled": relabelled, "moved": moved}).withColumns(
        {"unchanged": F.size("__pairs") - F.col("relabelled") - F.col("moved"), "added": F.size("__new") - F.size("__pairs"), "removed": F.size("__old") - F.size("__pairs")}
    )
    return counted.drop(*[c for c in counted.columns if c.startswith("__")])


def version_diff(old: DataFrame, new: DataFrame, image: str, boxes: str) -> DataFrame:
    """``label_diff`` of each image that either version has, with ``state``: added, removed, edited or same.

    Of an image that one version lacks all boxes are added or removed.
    """
    both = old.select(image, F.col(boxes).alias("__before")).join(new.select(image, F.col(boxes).alias("__after")), image, "full_outer")
    none = F.array().cast(old.schema[boxes].dataType)
    state = F.when(F.col("__before").isNull(), "added").when(F.col("__after").isNull(), "removed")
    marked = both.withColumn("state", state).withColumns({"before": F.coalesce("__before", none), "after": F.coalesce("__after", none)}).drop("__before", "__after")
    counted = label_diff(marked, "before", "after")
    edits = F.col("added") + F.col("removed") + F.col("relabelled") + F.col("moved")
    return counted.withColumn("state", F.coalesce("state", F.when(edits > 0, "edited").otherwise("same"))).withColumns({"before": F.size("before"), "after": F.size("after")})


def competence(per_class: DataFrame, few: int = 30) -> DataFrame:
    """What a pass is worth by class: ``judged``, where its misses count (recall of 0.6 or little support), ``trusted``, where
    its predictions do (precision of 0.3 or few of them), and ``competent``, both. A class without labels or predictions
    isn't judged or trusted."""
    judged = (F.col("support") > 0) & ((F.col("recall") >= 0.6) | (F.col("support") < few))
    trusted = (F.col("predictions") > 0) & ((F.col("precision") >= 0.3) | (F.col("predictions") < few))
    return per_class.withColumns({"judged": judged, "trusted": trusted, "competent": ((F.col("recall") >= 0.6) | (F.col("support") < few)) & ((F.col("precision") >= 0.3) | (F.col("predictions") < few))})


def judged_rounds(epochs: Column, from_epoch: Column | None = None, warmup: float = 0.25) -> Column:
    """The rounds that findings are taken from: those from ``from_epoch`` on, else all but the first quarter."""
    ordered = F.array_sort(F.array_distinct(epochs))
    late = F.slice(ordered, F.floor(F.size(ordered) * warmup).cast("int") + 1, F.size(ordered))
    return late if from_epoch is None else F.when(from_epoch.isNull(), late).otherwise(F.filter(ordered, lambda e: e >= from_epoch))


def image_findings(rounds: DataFrame, findings: DataFrame, *, image: str = "image", epoch: str = "epoch", from_epoch: int | None = None) -> DataFrame:
    """Findings that return within the judged rounds of each image, with how often and how sure.

    ``rounds`` has every observed ``image, epoch``; ``findings`` the rows of :func:`round_findings` with ``epoch``. An image
    with fewer than two judged rounds has none. A missed label weighs as the least confident prediction that counts.
    """
    start = F.lit(from_epoch).cast("int") if from_epoch is not None else None
    window = rounds.groupBy(image).agg(judged_rounds(F.collect_set(epoch), start).alias("__window")).filter(F.size("__window") >= 2)
    inside = findings.join(window, image).filter(F.array_contains("__window", F.col(epoch)))
    grouped = inside.groupBy(image, "rule", "place", "label").agg(
        F.count_distinct(epoch).alias("rounds"), F.max(F.size("__window")).alias("window"), F.min(epoch).alias("first_epoch"), F.max(epoch).alias("last_epoch"),
        F.max(F.element_at("__window", -1)).alias("__end"), F.avg(F.when(F.col("rule") != "missed", F.col("score"))).alias("__confidence"), F.mode("predicted", True).alias("predicted"),
    )
    share = F.col("rounds") / F.col("window")
    least = F.element_at(F.create_map(*[x for k, v in MIN_SHARE.items() for x in (F.lit(k), F.lit(v))]), F.col("rule"))
    kept = grouped.withColumn("share", share).filter((F.col("rounds") >= 2) & (F.col("share") >= least))
    return kept.withColumns({"in_last_round": F.col("last_epoch") == F.col("__end"), "score": F.col("share") * F.coalesce("__confidence", F.lit(CLEAR))}).drop("__confidence", "__end")


def pass_findings(findings: DataFrame, competent: DataFrame, labels: DataFrame, *, image: str = "image", image_recall: float = 0.6, min_labels: int = 5, missed_weight: float = 0.5) -> DataFrame:
    """Findings of a single pass, as far as it is competent, scored.

    ``findings`` has ``rule, label, predicted, score`` and, for loose boxes, ``overlap``; ``competent`` the classes of
    :func:`competence`; ``labels`` the labels of each image with ``found``. Misses count for judged classes, in images
    where the pass found 0.6 of five or more labels of such classes; other rules for trusted predictions.
    """
    classes = F.broadcast(competent.select("label", "judged", "trusted"))  # a row for each class
    asked = labels.join(classes, "label").filter("judged").groupBy(image).agg(F.count("*").alias("__asked"), F.count_if("found").alias("__hit"))
    weak = asked.filter((F.col("__asked") >= min_labels) & (F.col("__hit") / F.col("__asked") < image_recall)).select(image, F.lit(True).alias("__weak"))
    own = F.coalesce(F.when(F.col("rule") == "missed", F.col("label")).otherwise(F.col("predicted")), F.lit(-1))
    joined = findings.withColumn("__class", own).join(classes.withColumnRenamed("label", "__class"), "__class", "left").join(weak, image, "left")
    kept = joined.filter(F.when(F.col("rule") == "missed", F.coalesce("judged", F.lit(False)) & F.col("__weak").isNull()).otherwise(F.coalesce("trusted", F.lit(False))))
    score = F.when(F.col("rule") == "missed", F.lit(CLEAR * missed_weight)).when(F.col("rule") == "loose_box", F.col("score") * (1 - F.least(F.col("overlap") / CLEAR, F.lit(1.0)))).otherwise(F.col("score"))
    return kept.withColumn("score", score).drop("__class", "__weak", "judged", "trusted")


def class_swaps(findings: DataFrame, k: int = 8) -> DataFrame:
    """The commonest (label, predicted) pairs of wrong classes."""
    return findings.filter("rule = 'wrong_class'").groupBy("label", "predicted").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label", "predicted").limit(k)
