"""Two runs beside each other: slices, verdicts, whether they may be compared at all, and what they cost.

Images that only one side has take no part in slices; null arrays count as empty.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sampleworks.functions.values import f1_score, is_finite, ratio
from sampleworks.operators import evaluation, matching, sampling

TOLERANCE, FEW = 0.02, 30
# fixed values: areas of small, medium and large objects
SMALL, MEDIUM = 32 * 32, 96 * 96


def paired(before: DataFrame, after: DataFrame, image: str) -> DataFrame:
    """Images that both runs have boxes for, with ``truth`` and ``predicted`` of either side."""
    side = lambda df, s: df.filter("truth IS NOT NULL AND predicted IS NOT NULL").select(image, F.col("truth").alias(f"truth_{s}"), F.col("predicted").alias(f"predicted_{s}"))
    return side(before, "before").join(side(after, "after"), image)


def slice_totals(counts: DataFrame, key: str) -> DataFrame:
    """``key, tp_before, fp_before, fn_before, tp_after, ...`` from rows of ``key, side, tp, fp, fn``."""
    return counts.groupBy(key).agg(*[F.coalesce(F.sum(F.when(F.col("side") == s, F.col(c))), F.lit(0)).alias(f"{c}_{s}") for s in ("before", "after") for c in ("tp", "fp", "fn")])


def _sided(pairs: DataFrame, image: str, confidence: float) -> DataFrame:
    rows = [evaluation.outcomes(pairs, [image], f"truth_{s}", f"predicted_{s}", confidence=confidence).withColumn("side", F.lit(s)) for s in ("before", "after")]
    return rows[0].unionByName(rows[1])


def class_slices(before: DataFrame, after: DataFrame, image: str, *, confidence: float = 0.25, few: int = FEW) -> DataFrame:
    """Each class over the shared images: counts and f1 of both sides, ``support`` (the larger number of labels), whether that
    is enough to conclude anything, and ``delta``."""
    rows = _sided(paired(before, after, image), image, confidence)
    found = slice_totals(evaluation.outcome_counts(rows, "label", "side"), "label")
    for s in ("before", "after"):
        found = found.withColumn(f"f1_{s}", f1_score(*(F.col(f"{c}_{s}") for c in ("tp", "fp", "fn"))))
    support = F.greatest(*(F.col(f"tp_{s}") + F.col(f"fn_{s}") for s in ("before", "after")))
    return found.withColumns({"support": support, "conclusive": support >= few, "delta": F.round(F.col("f1_after") - F.col("f1_before"), 4)})


def band(area: Column) -> Column:
    return F.when(area < SMALL, "small").when(area < MEDIUM, "medium").otherwise("large")


def size_slices(before: DataFrame, after: DataFrame, image: str, *, confidence: float = 0.25, few: int = FEW) -> DataFrame:
    """Recall of both sides by the size of labels: a false positive has no label to measure."""
    rows = _sided(paired(before, after, image), image, confidence).filter("kind <> 'fp'")
    label = F.coalesce("label_box", "box")
    counts = evaluation.outcome_counts(rows.withColumn("band", band(matching.area(label))), "band", "side")
    found = slice_totals(counts, "band")
    for s in ("before", "after"):
        found = found.withColumn(f"recall_{s}", ratio(F.col(f"tp_{s}"), F.col(f"tp_{s}") + F.col(f"fn_{s}")))
    support = F.greatest(*(F.col(f"tp_{s}") + F.col(f"fn_{s}") for s in ("before", "after")))
    return found.drop("fp_before", "fp_after").withColumns({"support": support, "conclusive": support >= few, "delta": F.round(F.col("recall_after") - F.col("recall_before"), 4)})


def largest_moves(compared: DataFrame, image: str) -> DataFrame:
    """Rows of a comparison by size of their change, then by image; without a change last."""
    return compared.orderBy(F.abs("delta").desc_nulls_last(), image)


def headline(before: Column, after: Column, tolerance: float = TOLERANCE) -> Column:
    """``before, after, delta, verdict`` of one score; a difference below the tolerance is too close to call."""
    delta = after - before
    known = is_finite(before) & is_finite(after)
    verdict = F.when(~known, "not recorded").when(F.abs(delta) < tolerance, "too close to call").when(delta > 0, "higher").otherwise("lower")
    number = lambda c: F.when(known, F.round(c.cast("double"), 4))
    return F.struct(number(before).alias("before"), number(after).alias("after"), number(delta).alias("delta"), verdict.alias("verdict"))


RECIPE = ("framework", "version", "epochs", "imgsz", "batch")


def compatibility(sides: DataFrame) -> DataFrame:
    """``check, status`` for each pair of runs in ``sides``, whose columns are ``pair`` and, for ``before`` and ``after``, a struct
    of ``set, table, evaluator (map), classes (map), recipe (map), seed``.

    ``blocked``: they can't be compared; ``warn``: they can, and the reader must know; ``ok``. What isn't known is a warning.
    After a blocked set nothing else is looked at.
    """
    b, a = F.col("before"), F.col("after")
    empty = lambda m: m.isNull() | (F.size(m) == 0)
    same = lambda x, y: F.array_sort(F.map_entries(x)) == F.array_sort(F.map_entries(y))
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    same_set = ~blank(b["set"]) & ~blank(a["set"]) & (b["set"] == a["set"])
    shared = F.size(F.array_intersect(F.map_entries(b["classes"]), F.map_entries(a["classes"]))) > 0
    recipe = F.lit(True)
    for key in RECIPE:
        recipe &= F.try_element_at(b["recipe"], F.lit(key)).eqNullSafe(F.try_element_at(a["recipe"], F.lit(key)))
    statuses = {
        "evaluation_set": F.when(F.coalesce(same_set, F.lit(False)), "ok").otherwise("blocked"),
        "evaluation_version": F.when(b["table"].eqNullSafe(a["table"]), "ok").otherwise("warn"),
        "evaluator": F.when(empty(b["evaluator"]) | empty(a["evaluator"]), "warn").when(same(b["evaluator"], a["evaluator"]), "ok").otherwise("blocked"),
        "classes": F.when(empty(b["classes"]), None).when(empty(a["classes"]) | same(b["classes"], a["classes"]), "ok").when(shared, "warn").otherwise("blocked"),
        "training_recipe": F.when(recipe, "ok").otherwise("warn"),
        "seeds": F.when(b["seed"].isNull() | a["seed"].isNull() | (b["seed"] == a["seed"]), "warn").otherwise("ok"),
    }
    rows = F.array(*[F.struct(F.lit(n).alias("place"), F.lit(k).alias("check"), s.alias("status")) for n, (k, s) in enumerate(statuses.items())])
    looked_at = F.filter(rows, lambda r: r["status"].isNotNull() & ((r["place"] == 0) | F.coalesce(same_set, F.lit(False))))
    return sides.select("pair", F.inline(looked_at)).drop("place")


def interpretation(checks: DataFrame, changed: DataFrame) -> DataFrame:
    """``pair, kind``: blocked, observational (data or labels changed) or controlled; ``changed`` has ``pair, data_changed``."""
    status = lambda check: F.max(F.when(F.col("check") == check, F.col("status")))
    by_pair = checks.groupBy("pair").agg(F.count_if(F.col("status") == "blocked").alias("blocked"), F.count_if(F.col("status") == "warn").alias("warnings"), status("evaluation_version").alias("version"), status("training_recipe").alias("recipe"))
    both = by_pair.join(changed, "pair", "left")
    data, labels = F.coalesce("data_changed", F.lit(False)), F.coalesce(F.col("version") == "warn", F.lit(False))
    kind = F.when(F.col("blocked") > 0, "blocked").when(data | labels, "observational").otherwise("controlled")
    cause = F.when(F.col("blocked") > 0, None).when(data & (F.col("recipe") == "warn"), "data and settings").when(data, "data").when(F.col("recipe") == "warn", "settings").otherwise("repeat")
    return both.select("pair", kind.alias("kind"), cause.alias("cause"), "warnings")


def run_cost(log: DataFrame, run: str, logged: str) -> DataFrame:
    """``rounds, seconds`` of each run from its logged rounds; under two times there is nothing to measure."""
    seconds = F.when(F.count(logged) >= 2, F.round((F.unix_micros(F.max(logged).cast("timestamp")) - F.unix_micros(F.min(logged).cast("timestamp"))) / 1e6, 1))
    return log.groupBy(run).agg(F.count("*").alias("rounds"), seconds.alias("seconds"))


def task_comparison(before: DataFrame, after: DataFrame, score: str, example: str = "example_id", dead_band: float = 1e-12) -> DataFrame:
    """``example, before, after, delta, outcome`` of two runs that must each score every example exactly once, finitely."""
    sides = [df.groupBy(example).agg(F.count("*").alias(f"n_{s}"), F.max(score).cast("double").alias(s)) for df, s in ((before, "before"), (after, "after"))]
    both = sides[0].join(sides[1], example, "full_outer")
    right = F.col(example).isNotNull() & (F.col("n_before").eqNullSafe(F.lit(1))) & (F.col("n_after").eqNullSafe(F.lit(1))) & is_finite(F.col("before")) & is_finite(F.col("after"))
    fault = F.raise_error(F.concat(F.lit("both runs must score every example once: "), F.coalesce(F.col(example).cast("string"), F.lit("null"))))
    delta = F.col("after") - F.col("before")
    outcome = F.when(delta > dead_band, "improved").when(delta < -dead_band, "regressed").otherwise("unchanged")
    return both.select(F.when(right, F.col(example)).otherwise(fault.cast(before.schema[example].dataType)).alias(example), "before", "after", delta.alias("delta"), outcome.alias("outcome"))


def paired_bootstrap(compared: DataFrame, delta: str = "delta", example: str = "example_id", *, draws: int = 500, seed: int = 0, levels: Sequence[float] = (0.025, 0.975)) -> tuple[float, ...]:
    """Quantiles of the mean difference when examples are drawn anew, both sides together.

    Each example's number of draws in each sample is a Poisson number that its id decides, so examples stay where they
    are: a task returns two sums for each sample.
    """

    found = sampling.bootstrap_means(compared, delta, draws=draws, row=example, seed=seed)
    return tuple(found.agg(F.percentile("m", F.array(*map(F.lit, levels)))).first()[0] or [None] * len(levels))
