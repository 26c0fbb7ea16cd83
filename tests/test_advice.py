"""Places where a query once did less than its whole job."""

from __future__ import annotations

import numpy as np
import pytest

from sampleworks.operators import facets, neighbours


@pytest.fixture(scope="module")
def vectors(spark):
    """Ids 0 to 19 are copies (0 to 9 in set a, the others in set b), 20 is near them, 21 to 24 stand apart."""
    draw = np.random.RandomState(5)
    apart = np.eye(8)
    rows = [(i, [1.0] * 8) for i in range(20)] + [(20, [1.0] * 7 + [1.1])] + [(21 + k, apart[k].tolist()) for k in range(4)]
    sets = [(i, "a" if i < 10 or i in (20, 21) else "b") for i in range(25)]
    draw.shuffle(rows)
    return spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<float>"), spark.createDataFrame(sets, "id long, set string")


def test_leaks_of_many_copies(spark, vectors):
    df, sets = vectors
    sources = spark.createDataFrame([(21, "s"), (22, "s"), (23, "s"), (0, "t"), (19, "t"), (24, None), (20, None)], "id long, source string")
    found = {(r.a, r.b): r for r in neighbours.leaks(df, sets, 0.05, same_image=1e-6, sources=sources).collect()}
    close = {(i, j) for i in range(10) for j in range(10, 20)} | {(i, 20) for i in range(10, 20)}
    assert set(found) == close | {(21, 22), (21, 23)}
    assert {p for p, r in found.items() if r.same_source} == {(21, 22), (21, 23), (0, 19)}
    assert {p for p, r in found.items() if r.same_image} == {p for p in close if 20 not in p}
    assert found[21, 22].dist == pytest.approx(1) and all((r.set_a, r.set_b) == ("a" if a < 10 or a == 21 else "b", "a" if b == 20 else "b") for (a, b), r in found.items())


def test_groups_of_many_copies(vectors):
    df, _ = vectors
    assert {r.id: r.group for r in neighbours.duplicate_groups(neighbours.near_graph(df, 0.05), 0.05).collect()} == {i: 0 for i in range(21)}


def test_near_pairs_over_packets(spark):
    v = np.random.RandomState(3).randn(90, 4)
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    near, _ = neighbours.near_pairs(df, 0.4, packet=16)
    assert sorted((r.a, r.b) for r in near.collect()) == [(i, j) for i in range(90) for j in range(i, 90) if 1 - u[i] @ u[j] <= 0.4]


def test_positions_of_the_whole_order(spark):
    rows = [(i, None if i % 5 == 0 else i % 7, None if i % 3 == 0 else float(i % 11)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k int, a int, b double").repartition(5)
    found = [r.k for r in sorted(facets.positioned(facets.sorted_rows(df, [("a", True), ("b", False)], "k")).collect(), key=lambda r: r.position)]
    assert found == [r[0] for r in sorted(rows, key=lambda r: (r[1] is not None, -(r[1] or 0), r[2] is None, r[2] or 0, r[0]))]
    placed = facets.positioned(facets.field_sorted(df, "a", True, "k")).collect()
    assert sorted(r.position for r in placed) == list(range(3000))
    assert [r.k for r in sorted(placed, key=lambda r: r.position)] == [r[0] for r in sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))]
