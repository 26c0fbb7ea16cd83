"""Queries of the neighbour graph against their SQL where more than five vectors are near each other."""

from __future__ import annotations

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from sampleworks.operators import neighbours
from sampleworks.plans import registry


@pytest.fixture(scope="module")
def crowded(tmp_path_factory):
    """300 vectors around 12 centres, so that most have more than five others within the limits."""
    folder = tmp_path_factory.mktemp("crowded")
    draw = np.random.default_rng(4)
    centres = draw.normal(size=(12, 64))
    rows = centres[draw.integers(0, 12, 300)] + draw.normal(size=(300, 64)) * 0.9
    rows = (rows / np.linalg.norm(rows, axis=1, keepdims=True)).astype(np.float32)
    vectors = pa.array(rows.tolist(), pa.list_(pa.float32()))
    pq.write_table(pa.table({"vec_id": pa.array(range(300), pa.int64()), "embedding": vectors, "label": pa.array((np.arange(300) % 10).tolist(), pa.int32())}), folder / "embeddings.parquet")
    return folder


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(round(float(r[i]), 5) for i in order) for r in rows)


@pytest.mark.parametrize("name", ["leaks", "leaks_by_set", "graph_summary", "duplicate_groups", "leaks_whole", "duplicate_groups_whole", "knn_topk", "outliers", "uniqueness"])
def test_equals_sql_where_vectors_are_crowded(spark, crowded, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{crowded}/embeddings.parquet'")
    cursor = con.execute(registry.ORACLE_SQL[name])
    want = _rows([d[0] for d in cursor.description], cursor.fetchall())
    found = registry.QUERIES[name](spark, str(crowded))
    assert _rows(found.columns, found.collect()) == want


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_groups_of_long_chains_in_one_task_and_in_rounds(spark, monkeypatch, few):
    monkeypatch.setattr(neighbours, "FEW", few)
    links = [(i, i + 1, 0.1) for i in range(0, 40)] + [(60, 50, 0.1), (55, 60, 0.2), (70, 71, 0.9)]
    found = neighbours.duplicate_groups(spark.createDataFrame(links, "src long, dst long, dist double"), 0.5)
    assert sorted(tuple(r) for r in found.collect()) == [*((i, 0) for i in range(41)), (50, 50), (55, 50), (60, 50)]
    assert not neighbours.duplicate_groups(spark.createDataFrame([], "src long, dst long, dist double"), 0.5).collect()


def test_no_vector_is_shuffled_for_the_nearest(spark, crowded):
    found = neighbours.neighbours(spark.read.parquet(f"{crowded}/embeddings.parquet"), 5, packet=32)
    assert "FlatMapCoGroups" not in found._jdf.queryExecution().toString()
