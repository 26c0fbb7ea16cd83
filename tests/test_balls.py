"""Exact neighbours in balls against all pairs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sampleworks.operators import balls, neighbours


def _vectors(n, clusters, seed=1, width=8):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(clusters, width)) * 4
    rows = centres[draw.integers(0, clusters, n)] + draw.normal(size=(n, width)) * 0.05
    rows[5] = rows[9] = rows[2]  # copies
    rows[11] = 0
    rows[13] = 3 * rows[2]  # the same direction
    return rows


def _frame(spark, rows):
    data = [(i, r.tolist()) for i, r in enumerate(rows)] + [(len(rows), None)]
    return spark.createDataFrame(data, "id long, v array<double>").repartition(3)


def _distances(rows):
    x = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)
    return 1 - x @ x.T


@pytest.fixture(params=[512, 3])
def pack(request, monkeypatch):
    """Summaries of packets in one pack, and in several that meet in tasks."""
    monkeypatch.setattr(balls, "PACK", request.param)


@pytest.mark.parametrize("packet", [16, 4096])
def test_nearest_rows_are_those_of_all_pairs(spark, pack, packet):
    rows = _vectors(300, 12)
    dist = _distances(rows)
    found: dict = {}
    for r in neighbours.neighbours(_frame(spark, rows), 5, id_col="id", vector_col="v", packet=packet).collect():
        found.setdefault(r.src, []).append((r["rank"], r.dst, r.dist))
    assert sorted(found) == list(range(300))
    for i, near in found.items():
        own = np.where(np.arange(300) == i, np.inf, np.round(dist[i], 12))
        want = np.lexsort((np.arange(300), own))[:5]
        told = sorted(near)
        assert [n for n, _, _ in told] == [1, 2, 3, 4, 5]
        assert [d for _, _, d in told] == pytest.approx(dist[i][want])
        # rows whose distances differ by rounding alone may change places
        assert all(abs(dist[i][j] - dist[i][k]) < 1e-11 for (_, j, _), k in zip(told, want))


@pytest.mark.parametrize("packet", [16, 4096])
@pytest.mark.parametrize("limit", [0.0005, 0.3, 1.0])
def test_pairs_within_a_limit_are_those_of_all_pairs(spark, pack, packet, limit):
    rows = _vectors(200, 9, seed=3)
    found = {(r.a, r.b) for r in balls.within(_frame(spark, rows), limit, rows=packet).collect()}
    dist = _distances(rows)
    sure = {(i, j) for i in range(200) for j in range(i, 200) if dist[i, j] <= limit - 1e-9}
    may = {(i, j) for i in range(200) for j in range(i, 200) if dist[i, j] <= limit + 1e-9}
    assert sure <= found <= may


def test_most_pairs_of_packets_are_left_out_on_clusters(spark):
    packed = balls.packets(_frame(spark, _vectors(2000, 25, seed=5)), rows=50)
    n = packed.count()
    pairs = balls.packet_pairs(packed.select("packet", "centre", "radius", F.lit(0.01).alias("reach"))).count()
    assert n >= 40 and pairs < n * (n - 1) / 5


def test_tables_without_rows_or_with_one(spark):
    empty = spark.createDataFrame([(1, None)], "id long, v array<double>")
    assert balls.nearest(empty, 3).collect() == []
    assert balls.within(empty, 0.5).collect() == []
    one = spark.createDataFrame([(1, [1.0, 2.0])], "id long, v array<double>")
    assert balls.nearest(one, 3).collect() == []
    assert [(r.a, r.b) for r in balls.within(one, 0.5).collect()] == [(1, 1)]
