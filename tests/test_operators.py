"""Operators on small hand-made inputs with known results."""

from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sampleworks.functions import filters
from sampleworks.functions.calculations import Calculation, calculate
from sampleworks.operators import dynamics, facets, joining, matching, neighbours, versions


def column(df, name="v"):
    return [r[name] for r in df.orderBy("_row").collect()]


def test_missing_values_in_filters(spark):
    df = spark.createDataFrame([(0, 0.1), (1, 0.7), (2, None), (3, float("nan")), (4, float("inf"))], "_row int, x double")
    keep = lambda p: [r._row for r in df.filter(p).orderBy("_row").collect()]
    assert keep(filters.numeric_range(F.col("x"), 0.5, 2.0)) == [1]
    assert keep(filters.numeric_range(F.col("x"), 0.5, 2.0, inverted=True)) == [0]
    assert keep(filters.field_number(F.col("x"), 0.5, 2.0, without_value=True)) == [1, 2, 3, 4]


def test_calculated_columns_keep_missing_values_apart(spark):
    df = spark.createDataFrame([(0, "a", 1.0, 4.0), (1, "a", None, 0.0), (2, None, 3.0, -1.0), (3, None, 3.0, 9.0), (4, "b", -2.5, 1.0)], "_row int, g string, x double, y double")
    value = lambda op, inputs, **k: column(calculate(df, [Calculation("v", op, inputs, **k)]))
    assert value("divide", ["x", "y"]) == [0.25, None, -3.0, pytest.approx(1 / 3), -2.5]
    assert value("round", ["x"]) == [1.0, None, 3.0, 3.0, -2.0]
    assert value("sqrt", ["y"]) == [2.0, 0.0, None, 3.0, 1.0]
    assert value("min", ["x", "y"]) == [1.0, None, -1.0, 3.0, -2.5]
    assert value("group_count", [], group="g") == [2, 2, 2, 2, 1]
    assert value("rank", ["x"]) == [2.0, None, 3.5, 3.5, 1.0]
    assert value("previous", ["x"], order="y") == [-2.5, 3.0, None, 1.0, None]
    assert value("standardize", ["x"], group="g") == [0.0, None, 0.0, 0.0, 0.0]
    with pytest.raises(ValueError):
        value("add", ["x"])


def test_concave_polygon(spark):
    shape = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0)]
    df = spark.createDataFrame([(0, 1.0, 1.0), (1, 2.0, 3.0), (2, 5.0, 1.0), (3, None, 1.0)], "_row int, x double, y double")
    inside = filters.in_regions(F.col("x"), F.col("y"), [filters.Stroke(shape)])
    assert [r._row for r in df.filter(inside).collect()] == [0]
    outside = filters.in_regions(F.col("x"), F.col("y"), [filters.Stroke(shape)], inverted=True)
    assert [r._row for r in df.filter(outside).orderBy("_row").collect()] == [1, 2]


def test_join_input_refuses_unknown_rows(spark):
    samples = spark.createDataFrame([(0, "a", 1), (1, "b", 2)], "_row long, image string, weight int")
    metrics = spark.createDataFrame([(1, 0.5, 9), (0, 0.1, 8)], "example_id long, loss double, weight int")
    rows = {r.example_id: r for r in joining.join_input(metrics, samples, constants={"split": "valid"}).collect()}
    assert (rows[1].image, rows[1].weight, rows[1].split) == ("b", 9, "valid")
    with pytest.raises(Exception, match="no row for example id"):
        joining.join_input(spark.createDataFrame([(7, 0.5)], "example_id long, loss double"), samples).collect()


def test_greedy_match_order_and_ties(spark):
    box = "struct<x0:double,y0:double,x1:double,y1:double,label:int"
    truth = [(0.0, 0.0, 10.0, 10.0, 1), (0.0, 0.0, 10.0, 10.0, 1), (50.0, 50.0, 60.0, 60.0, 2)]
    predicted = [(0.0, 0.0, 10.0, 10.0, 1, 0.5), (0.0, 0.0, 10.0, 10.0, 1, 0.9), (0.0, 0.0, 10.0, 10.0, 1, 0.5), (50.0, 50.0, 60.0, 60.0, 1, 0.8)]
    df = spark.createDataFrame([(0, truth, predicted)], f"image int, truth array<{box}>>, predicted array<{box},score:double>>")
    found = df.select(F.inline(matching.greedy_match(F.col("truth"), F.col("predicted")))).collect()
    assert [(r.place, r.truth) for r in found] == [(1, 0), (3, -1), (0, 1), (2, -1)]
    assert df.select(matching.nms(F.col("predicted")).alias("k")).first().k == [1, 3]
    cells = {(r.truth_label, r.predicted_label): r.n for r in matching.confusion(matching.matches(df, class_aware=False)).collect()}
    assert cells == {(1, 1): 2, (2, 1): 1, (None, 1): 1}


def test_sample_dynamics_of_one_sequence(spark):
    rows = [(1, 0, True, 0.8), (1, 1, False, 0.2), (1, 2, True, 0.8), (2, 0, False, 0.1), (2, 1, False, 0.1)]
    df = spark.createDataFrame(rows, "id int, epoch int, correct boolean, p double")
    found = {r.id: r for r in dynamics.sample_dynamics(df, ["id"], "epoch", "correct", "p").collect()}
    assert (found[1].learned_epoch, found[1].forgetting, found[1].first_correct) == (2, 1, 0)
    assert found[1].mean_p == pytest.approx(0.6) and found[2].learned_epoch is None


def test_delete_rows_closes_gaps(spark):
    df = spark.range(200_000).withColumnRenamed("id", "_row").withColumn("was", F.col("_row"))
    gone = df.filter("_row % 3 = 1 OR _row = 131072").select("_row")
    found = joining.delete_rows(df, gone)
    n = found.count()
    assert found.agg(F.min("_row"), F.max("_row"), F.count_distinct("_row")).first()[:] == (0, n - 1, n)
    assert found.withColumn("p", F.lag("was").over(Window.orderBy("_row"))).filter("p >= was").count() == 0


def test_natural_order(spark):
    df = spark.createDataFrame([(0, "img10"), (1, "img9"), (2, None), (3, "img 2")], "_row int, name string")
    assert [r._row for r in facets.field_sorted(df, "name", False, "_row").collect()] == [3, 1, 0, 2]


def test_duplicate_groups_are_transitive(spark):
    edges = spark.createDataFrame([(1, 2, 0.1), (2, 3, 0.1), (7, 8, 0.05), (3, 9, 0.9)], "src long, dst long, dist double")
    assert {r.id: r.group for r in neighbours.duplicate_groups(edges, 0.2).collect()} == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7}


def test_split_plan_spills_surplus(spark):
    df = spark.createDataFrame([(i, "a" if i < 6 else "b") for i in range(8)], "k int, split string")
    plan = versions.plan_splits(df, "split", "k", {"a": 3, "b": 5})
    assert {r.k: r.target for r in plan.collect()} == {0: "a", 1: "a", 2: "a", 3: "b", 4: "b", 5: "b", 6: "b", 7: "b"}
