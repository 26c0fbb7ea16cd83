"""Projections against plain matrix algebra, and saved axes."""

from __future__ import annotations

import json
from pathlib import Path

import numpy as np
import pytest

from sampleworks.operators import reducing


def _frame(spark, x):
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(len(x), None)], "id int, v array<double>").repartition(4)


def _low_rank(n=200, width=20, rank=5, seed=1):
    draw = np.random.default_rng(seed)
    return (draw.normal(size=(n, rank)) * np.array([9, 5, 2, 1, 0.5])) @ draw.normal(size=(rank, width)) + 3


def test_a_sketch_finds_the_leading_axes_of_a_low_rank_table(spark):
    x = _low_rank()
    mean, axes = reducing.sketched_axes(_frame(spark, x), "v", 2)
    _, _, exact = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert mean == pytest.approx(x.mean(axis=0))
    assert np.abs(np.sum(axes * exact[:2], axis=1)) == pytest.approx([1, 1])
    assert all(a[np.abs(a).argmax()] > 0 for a in axes)


def test_a_map_fills_its_square_whatever_the_partitions(spark):
    x = _low_rank(seed=2)
    one = {r.id: (r.map_x, r.map_y) for r in reducing.map_layout(_frame(spark, x), "v").collect()}
    other = {r.id: (r.map_x, r.map_y) for r in reducing.map_layout(_frame(spark, x).repartition(9), "v").collect()}
    assert one.pop(200) == (None, None) and other.pop(200) == (None, None)
    points = np.array([one[i] for i in range(200)])
    assert points.min(axis=0) == pytest.approx([-1, -1]) and points.max(axis=0) == pytest.approx([1, 1])
    assert np.array([other[i] for i in range(200)]) == pytest.approx(points, abs=1e-5)
    _, _, exact = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    for axis in (0, 1):
        assert abs(np.corrcoef((x - x.mean(axis=0)) @ exact[axis], points[:, axis])[0, 1]) == pytest.approx(1)


def test_maps_of_few_or_equal_vectors(spark):
    assert [tuple(r)[2:] for r in reducing.map_layout(spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "id int, v array<double>"), "v").orderBy("id").collect()] == [(0.0, 0.0), (None, None)]
    same = reducing.map_layout(spark.createDataFrame([(i, [1.0, 2.0]) for i in range(3)], "id int, v array<double>"), "v")
    assert {tuple(r)[2:] for r in same.collect()} == {(-1.0, -1.0)}
    assert reducing.map_layout(spark.createDataFrame([], "id int, v array<double>"), "v").collect() == []


def test_saved_axes_apply_to_other_tables(spark, tmp_path):
    x = _low_rank(seed=3)
    fitted = reducing.Reducer.fit(_frame(spark, x), "v", 3)
    path = fitted.save(spark, str(tmp_path / "reducer.json"))
    with pytest.raises(reducing.ReducerError, match="there is"):
        fitted.save(spark, path)
    again = reducing.Reducer.load(spark, path)
    assert again == fitted
    other = _low_rank(n=30, seed=4)
    found = {r.id: tuple(r)[2:] for r in again.transform(_frame(spark, other), "v").collect()}
    want = (other - np.array(fitted.mean)) @ np.array(fitted.axes).T
    assert np.array([found[i] for i in range(30)]) == pytest.approx(want, rel=1e-4, abs=1e-4)
    assert found[30] == (None, None, None)
    with pytest.raises(Exception, match="components"):
        again.transform(spark.createDataFrame([(1, [1.0])], "id int, v array<double>"), "v").collect()
    for text, told in ((json.dumps({"format": 9}), "format 9"), ("{}", "no reducer"), (Path(path).read_text().replace("mean", "maen"), "changed")):
        changed = tmp_path / f"changed{len(text)}.json"
        changed.write_text(text)
        with pytest.raises(reducing.ReducerError, match=told):
            reducing.Reducer.load(spark, str(changed))
    with pytest.raises(reducing.ReducerError):
        reducing.Reducer.fit(_frame(spark, x[:0]), "v")
