"""Order statistics over ranges against plain loops, and that one group or none uses more than one task."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sampleworks.functions.calculations import Calculation, calculate
from sampleworks.operators import dynamics, facets, ranges


@pytest.fixture(autouse=True)
def many_ranges(spark):
    """Small ranges stay apart, as those of large tables do."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


def _table(spark, n=400, seed=1):
    draw = random.Random(seed)
    rows = [(i, draw.choice(["a", "a", "a", "b", None]), draw.choice([None, float("nan"), *map(float, range(9))]), draw.choice([None, 1.0, 2.5, -3.0, float("inf")])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "_row long, g string, at double, x double").repartition(7)


def test_numbers_follow_the_order_and_empty_tables_have_none(spark):
    rows, df = _table(spark)
    found = {r["_row"]: r.n for r in ranges.row_numbers(df, [F.desc("at"), "_row"], "n").collect()}
    key = lambda r: (r[2] is None, -math.inf if r[2] is not None and math.isnan(r[2]) else -(r[2] or 0), r[0])  # noqa: E731  NaN is the largest
    assert [found[r[0]] for r in sorted(rows, key=key)] == list(range(len(rows)))
    assert ranges.row_numbers(df.filter("false"), ["_row"], "n").collect() == []


@pytest.mark.parametrize("group", [[], ["g"]])
def test_columns_along_an_order(spark, group):
    rows, df = _table(spark)
    placed = ranges.in_ranges(df.withColumn("v", F.when(F.abs("x") < 100, F.col("x"))), [*group, "_row"])
    assert placed.select("__range").distinct().count() > 1
    found = ranges.along(placed, {"n": ("number", None), "s": ("sum", F.col("v")), "m": ("max_after", F.col("v")), "p": ("previous", F.col("v")), "q": ("next", F.col("v"))}, group)
    told = {r["_row"]: (r.n, r.s, r.m, r.p, r.q) for r in found.collect()}
    by: dict = {}
    for r in rows:
        by.setdefault(r[1] if group else 0, []).append((r[0], r[3] if r[3] is not None and abs(r[3]) < 100 else None))
    for members in by.values():
        values = [v for _, v in members]
        for i, (row, _) in enumerate(members):
            seen, left = [v for v in values[: i + 1] if v is not None], [v for v in values[i:] if v is not None]
            want = (i + 1, sum(seen) if seen else None, max(left, default=None), values[i - 1] if i else None, values[i + 1] if i + 1 < len(values) else None)
            assert told[row] == pytest.approx(want)


@pytest.mark.parametrize("operation", ["previous", "next", "difference", "cumulative_sum", "rank"])
def test_calculations_over_all_rows_equal_windows(spark, operation):
    """The same calculation in one group that holds all rows is a plain window."""
    rows, df = _table(spark)
    spec = {"operation": operation, "inputs": ["x"], "order": None if operation == "rank" else "at"}
    whole = calculate(df, [Calculation("c", **spec)])
    window = calculate(df.withColumn("one", F.lit("all")), [Calculation("c", group="one", **spec)])
    assert whole.columns == [*df.columns, "c"]
    as_rows = lambda d: sorted(((r["_row"], None if r.c is None else round(r.c, 9)) for r in d.collect()), key=lambda r: r[0])
    assert as_rows(whole) == as_rows(window)
    assert calculate(df.filter("false"), [Calculation("c", **spec)]).collect() == []


def test_a_class_of_average_precision_is_many_tasks(spark):
    """Four tasks work on one class: the ranges hold a share of its rows each."""
    placed = ranges.in_ranges(spark.range(4000).select(F.lit(0).alias("label"), (F.col("id") % 97 / 97).alias("score"), "id"), ["label", F.desc("score"), "id"])
    sizes = [r.n for r in placed.groupBy("__range").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 4 and max(sizes) < 2000


@pytest.mark.parametrize("small", [1, 10, 10**6])
def test_order_statistics_are_exact(spark, small):
    draw = random.Random(small)
    columns = {
        "spread": [draw.gauss(0, 1e6) for _ in range(3000)],
        "ties": [float(draw.choice([0, 0, 0, 1, 2, 1e300])) for _ in range(3000)],
        "same": [7.0] * 3000,
        "holes": [draw.choice([None, float("nan"), float("-inf"), draw.random()]) for _ in range(3000)],
    }
    df = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{c} double" for c in columns)).repartition(5)
    kept = {c: sorted(v for v in values if v is not None and math.isfinite(v)) for c, values in columns.items()}
    wanted = {c: [0, 1, len(v) // 3, len(v) // 2, len(v) - 1] for c, v in kept.items()}
    found = ranges.order_statistics(df, wanted, small=small)
    assert found == {(c, k): kept[c][k] for c, places in wanted.items() for k in places}
    cuts = ranges.quantiles(df, list(columns), [0.0, 0.25, 0.9, 1.0])
    for (c, q), value in cuts.items():
        assert value == pytest.approx(np.quantile(kept[c], q))
    nearest = ranges.quantiles(df, ["spread"], [0.5, 0.9], nearest=True)
    assert nearest == {("spread", q): kept["spread"][round(q * 2999)] for q in (0.5, 0.9)}
    with pytest.raises(IndexError):
        ranges.order_statistics(df, {"same": [3000]})


def test_summaries_without_values(spark):
    df = spark.createDataFrame([(None,), (float("nan"),)], "x double")
    row = facets.numeric_summary(df, "x").first()
    assert (row["count"], row.present, row.missing, row["distinct"], row.q50) == (2, 0, 2, 0, None)


def test_quartiles_of_learned_epochs(spark):
    draw = random.Random(4)
    epochs = [draw.choice([None, *range(9)]) for _ in range(101)]
    found = dynamics.with_speed(spark.createDataFrame([(i, e) for i, e in enumerate(epochs)], "id int, learned_epoch int")).collect()
    known = [e for e in epochs if e is not None]
    low, high = np.quantile(known, 0.25), np.quantile(known, 0.75)
    for r in found:
        want = "never" if r.learned_epoch is None else "early" if r.learned_epoch < low else "late" if r.learned_epoch > high else "middle"
        assert r.speed == want
    none = dynamics.with_speed(spark.createDataFrame([(1, None)], "id int, learned_epoch int")).collect()
    assert [r.speed for r in none] == ["never"]
