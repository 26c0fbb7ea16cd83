"""Commits: one writer wins, nobody sees half a version, names and numbers are given once."""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sampleworks.sources import commits, tables


@pytest.fixture
def place(spark, tmp_path):
    root = tmp_path / "tables"
    first = commits.create_root(spark.range(4), str(root), "cats")
    heads = str(tmp_path / "heads")
    commits.start(spark, heads, first)
    return str(root), heads, first


def _versions(spark, root):
    return {r.path.rpartition("/")[2]: r.parents for r in tables.catalog(spark, root).collect()}


def test_two_writers_one_wins(spark, place):
    root, heads, first = place

    def write(n):
        try:
            return commits.commit(spark.range(10 + n), heads, root, expected=first, fingerprint=f"f{n}")
        except commits.Conflict as lost:
            return lost

    with ThreadPoolExecutor(4) as pool:
        told = list(pool.map(write, range(4)))
    won = [t for t in told if isinstance(t, commits.Head)]
    assert len(won) == 1 and all(isinstance(t, commits.Conflict) for t in told if t not in won)
    assert commits.heads(spark, heads)[-1] == won[0]
    assert set(_versions(spark, root)) == {"cats", won[0].version.rpartition("/")[2]}
    assert tables.read_version(spark, won[0].version).count() == 10 + int(won[0].fingerprint[1:])
    # the same request again gives what it gave; another for the old head is a conflict
    assert commits.commit(spark.range(1), heads, root, expected=first, fingerprint=won[0].fingerprint) == won[0]
    with pytest.raises(commits.Conflict):
        commits.commit(spark.range(1), heads, root, expected=first, fingerprint="late")
    assert len(commits.heads(spark, heads)) == 2


def test_a_change_is_tried_again(spark, place):
    root, heads, _ = place
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda n: commits.commit_change(spark, heads, root, lambda df: df.union(spark.range(100 + n, 101 + n)), tries=20), range(3)))
    last = commits.heads(spark, heads)[-1]
    assert last.number == 3
    assert sorted(r.id for r in tables.read_version(spark, last.version).collect()) == [0, 1, 2, 3, 100, 101, 102]


def test_names_are_unique_and_broken_writes_stay_unseen(spark, place):
    root, _, first = place
    again = commits.create_root(spark.range(1), root, "cats")
    child = commits.derive(first, spark.range(2), root, "edit")
    other = commits.derive(first, spark.range(2), root, "edit")
    assert [p.rpartition("/")[2] for p in (again, child, other)] == ["cats_1", "cats_edit", "cats_edit_1"]
    reserved = commits.unique_path(spark, root, "broken")
    spark.range(3).write.parquet(f"{reserved}/rows")  # and then the writer stopped
    assert "broken" not in _versions(spark, root)
    with pytest.raises(FileNotFoundError):
        tables.read_version(spark, reserved)
    assert commits.unique_path(spark, root, "broken").endswith("broken_1")
    assert _versions(spark, root)["cats_edit"] == [first]


def test_squashed_versions_have_no_history(spark, place):
    root, _, first = place
    child = commits.derive(first, spark.range(7), root, "edit", args={"n": 7})
    path = commits.squash(spark, child, root)
    body = tables.read_body(spark, path)
    assert (body["parents"], body["producer"]["op"], body["base_name"]) == ([], "squash", "cats_edit_squashed")
    assert tables.read_version(spark, path).count() == 7


def test_bodies_of_another_format_are_refused(spark, place):
    _, _, first = place
    file = Path(first.removeprefix("file://")) / "body.json"
    body = json.loads(file.read_text())
    for crc in file.parent.glob(".body.json.crc"):
        crc.unlink()
    file.write_text(json.dumps({**body, "format_version": 2}))
    with pytest.raises(ValueError, match="format 2"):
        tables.read_version(spark, first)


def test_numbers_are_given_once(spark, tmp_path):
    with ThreadPoolExecutor(6) as pool:
        found = list(pool.map(lambda _: commits.claim_number(spark, str(tmp_path / "numbers")), range(6)))
    assert sorted(found) == [1, 2, 3, 4, 5, 6]


def test_heads_of_nothing(spark, tmp_path):
    assert commits.heads(spark, str(tmp_path / "none")) == []
    with pytest.raises(commits.Conflict):
        commits.commit(spark.range(1), str(tmp_path / "none"), str(tmp_path), expected="x")
    with pytest.raises(commits.Conflict):
        commits.commit_change(spark, str(tmp_path / "none"), str(tmp_path), lambda df: df.filter(F.lit(True)))
