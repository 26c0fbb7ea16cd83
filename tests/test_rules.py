"""Rules held against plain Python on small cases: names, versions, edits, reviews, findings over rounds, samples."""

from __future__ import annotations

import subprocess
import sys

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sampleworks.operators import comparison, dynamics, editing, findings, governance, neighbours, sampling, versions
from sampleworks.sources import tables

BOX = "array<struct<x0:double,y0:double,x1:double,y1:double,label:int>>"
SCORED = "array<struct<x0:double,y0:double,x1:double,y1:double,label:int,score:double>>"


def test_any_module_imports_first():
    for name in ("detection", "judging", "registry", "versions", "evaluation"):
        subprocess.run([sys.executable, "-c", f"import sampleworks.plans.{name}"], check=True, cwd=__file__.rpartition("/tests/")[0])


def test_names():
    assert [tables.sanitized(n) for n in ("a/b", "  x y ", "..a..", "ä??b", "v1.2_x")] == ["a-b", "x y", "a", "b", "v1.2_x"]
    for bad in ("..", "---", " . ", "", "//"):
        with pytest.raises(ValueError):
            tables.sanitized(bad)
    assert ".." not in tables.table_path("/r", "p/../q", "d", "t").split("/")


def test_lineage_takes_any_name(spark):
    edges = spark.createDataFrame([("it's b", "it's a", 0), ("c", "it's b", 0)], "child string, parent string, place int")
    up, down = versions.lineage(spark, edges, "c"), versions.descendants(spark, edges, "it's a")
    assert sorted(map(tuple, up.collect())) == [("c", 0), ("it's a", 2), ("it's b", 1)] and down.count() == 3
    assert versions.lineage(spark, edges, "'; DROP").count() == 1


def test_split_plans(spark):
    df = spark.createDataFrame([(i, "a" if i < 6 else "b") for i in range(8)] + [(9, None)], "k int, split string")
    with pytest.raises(ValueError, match="c"):
        versions.plan_splits(df, "split", "k", {"a": 3, "c": 2})
    with pytest.raises(ValueError):
        versions.plan_splits(df, "split", "k", {"a": 0, "b": 0})
    assert versions.rescaled({"a": 97, "b": 50, "c": 47}, {"a": 140, "b": 30, "c": 30}) == {"a": 136, "b": 29, "c": 29}
    assert {r.k: r.target for r in versions.plan_splits(df, "split", "k", {"a": 1, "b": 1}).collect()} == {0: "a", 1: "a", 2: "a", 3: "a", 4: "b", 5: "b", 6: "b", 7: "b", 9: None}
    assert versions.plan_splits(df.limit(0), "split", "k", {}).count() == 0


def test_source_keys_and_class_names(spark):
    rows = [("a_jpg.rf.0123456789abcdef.jpg", None), ("x/y/a_png.rf.0123456789abcdef0.png", None), ("d\\a.rf.0123456789abcdef.jpg", None), ("plain.jpg", None), ("plain.jpg", "origin"), (None, None)]
    df = spark.createDataFrame(rows, "f string, o string")
    assert [r.k for r in df.select(versions.source_key(F.col("f"), F.col("o")).alias("k")).collect()] == ["a", "a", "a", "plain.jpg", "origin", None]
    assert [r.k for r in df.select(versions.original_name(F.col("f")).alias("k")).collect()][:4] == ["a", "x/y/a", None, None]
    matches = lambda pattern, names: [r.m for r in spark.createDataFrame([(n,) for n in names], "n string").select(F.col("n").rlike(pattern).alias("m")).collect()]
    assert all(matches(versions.IGNORE_NAMES, ["ignore", "Ignored regions", "ignored-area", "void", "crowd", "don't care", "dont_care"])) and not any(matches(versions.IGNORE_NAMES, ["crowded", "person"]))
    assert all(matches(versions.CATCH_ALL_NAMES, ["other", "Others", "misc", "background", "unknown"])) and not any(matches(versions.CATCH_ALL_NAMES, ["another"]))


def test_label_difference_lets_old_boxes_choose(spark):
    box = lambda a, b, label=0: (float(a), 0.0, float(b), 10.0, label)
    rows = [("i", [box(0, 10), box(2, 12)], [box(1.2, 11.2), box(4, 14)]), ("same", [box(0, 5), box(0, 5)], [box(0, 5), box(0, 5)]), ("class", [box(0, 5)], [box(0, 5, 1)]), ("flat", [box(3, 3)], [box(3, 3)])]
    df = spark.createDataFrame(rows, f"image string, a {BOX}, b {BOX}")
    found = {r.image: (r.identical, r.relabelled, r.moved, r.added, r.removed) for r in findings.label_diff(df, "a", "b").collect()}
    assert found == {"i": (0, 0, 2, 0, 0), "same": (2, 0, 0, 0, 0), "class": (0, 1, 0, 0, 0), "flat": (1, 0, 0, 0, 0)}
    whole = findings.version_diff(df.selectExpr("image", "a AS boxes").filter("image <> 'flat'"), df.selectExpr("image", "b AS boxes").filter("image <> 'same'"), "image", "boxes")
    assert {r.image: (r.state, r.before, r.after) for r in whole.collect()} == {"i": ("edited", 2, 2), "class": ("edited", 1, 1), "same": ("removed", 2, 0), "flat": ("added", 0, 1)}


def test_learning_categories(spark):
    rows = []
    learned = {"early": 0, "early2": 0, "mid": 1, "late": 4, "late2": 4}
    for name, at in learned.items():
        rows += [(name, e, e >= at) for e in range(5)]
    rows += [("never", e, False) for e in range(5)] + [("forgotten", e, e == 2) for e in range(5)] + [("few", 0, True)] + [("nothing", e, True) for e in range(5)]
    df = spark.createDataFrame(rows, "k string, epoch int, correct boolean").withColumn("p", F.lit(0.5))
    stats = dynamics.sample_dynamics(df, ["k"], "epoch", "correct", "p").withColumn("empty", F.col("k") == "nothing")
    found = {r.k: r.category for r in dynamics.image_learning(stats).collect()}
    # the last quarter all falls on the final round, which counts as late
    assert found == {"early": "early", "early2": "early", "mid": "steady", "late": "late", "late2": "late", "never": "never", "forgotten": "forgotten", "few": "insufficient", "nothing": "empty"}


def test_findings_over_rounds(spark):
    truth = [(0.0, 0.0, 10.0, 10.0, 0), (50.0, 0.0, 60.0, 10.0, 1), (100.0, 0.0, 110.0, 10.0, 2), (150.0, 0.0, 160.0, 10.0, 2)]
    seen = [(0.0, 0.0, 10.0, 10.0, 3, 0.9), (50.0, 0.0, 60.0, 10.0, 1, 0.8), (100.0, 0.0, 104.0, 10.0, 2, 0.7), (300.0, 0.0, 310.0, 10.0, 0, 0.6)]
    rounds = spark.createDataFrame([("i", e, truth, seen) for e in range(8)] + [("once", 0, truth, seen)], f"image string, epoch int, truth {BOX}, predicted {SCORED}")
    each = findings.round_findings(rounds, ["image", "epoch"])
    found = {(r.rule, r.place): r for r in findings.image_findings(rounds, each).collect()}
    assert {r.image for r in found.values()} == {"i"} and {r.window for r in found.values()} == {6} and {r.first_epoch for r in found.values()} == {2}
    assert set(found) == {("wrong_class", 0), ("loose_box", 2), ("missing_label", -1), ("missed", 2), ("missed", 3)}
    assert found["wrong_class", 0].score == pytest.approx(0.9) and found["missed", 3].score == pytest.approx(0.5) and found["wrong_class", 0].predicted == 3
    assert findings.image_findings(rounds, each, from_epoch=7).count() == 0
    classes = findings.competence(spark.createDataFrame([(0, 50, 50, 0.9, 0.9), (1, 50, 50, 0.2, 0.9), (2, 50, 50, 0.9, 0.9), (3, 50, 50, 0.9, 0.1)], "label int, support int, predictions int, recall double, precision double"))
    labels = rounds.filter("image = 'once'").select("image", F.inline("truth")).select("image", "label", F.lit(True).alias("found"))
    kept = {(r.rule, r.place): round(r.score, 3) for r in findings.pass_findings(each.filter("image = 'once'"), classes, labels).collect()}
    assert kept == {("loose_box", 2): pytest.approx(0.7 * 0.2, abs=1e-3), ("missing_label", -1): 0.6, ("missed", 2): 0.25, ("missed", 3): 0.25}


def test_samples_follow_weights(spark):
    df = spark.createDataFrame([(i, [0.0, 1.0, 2.0, 5.0][i % 4], "x" * (i % 4)) for i in range(4000)], "_row long, weight double, name string")
    drawn = sampling.weighted_with_replacement(df, 40_000, stretch=64, cells=32)
    share = {r.weight: r["count"] / 40_000 for r in drawn.groupBy("weight").count().collect()}
    assert drawn.count() == 40_000 == drawn.select("draw").distinct().count()
    assert set(share) == {1.0, 2.0, 5.0} and all(abs(share[w] - w / 8) < 0.01 for w in share)
    assert sampling.weighted_with_replacement(df).count() == 3000 and sampling.weighted_with_replacement(df.filter("weight = 0"), 5).count() == 0
    once = sampling.weighted(df, 300, seed=3)
    assert once.select("_row").distinct().count() == 300 and once.filter("weight = 0").count() == 0
    key = {r._row: r.k for r in df.filter("weight > 0").select("_row", (-F.log(sampling._uniform(3, "_row")) / F.col("weight")).alias("k")).collect()}
    assert {r._row for r in once.collect()} == set(sorted(key, key=lambda i: (key[i], i))[:300])


def test_projection_equals_singular_vectors(spark):
    draw = np.random.RandomState(3)
    x = (draw.randn(200, 6) * [9, 5, 3, 1, 1, 1]).round(4)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>")
    mean, axes = sampling.principal_axes(df, "v", 3)
    assert np.allclose(mean, x.mean(axis=0))
    wanted = np.linalg.svd(x - x.mean(axis=0))[2][:3]
    wanted *= np.sign(wanted[np.arange(3), np.abs(wanted).argmax(axis=1)])[:, None]
    assert np.allclose(axes, wanted, atol=1e-6)


def test_paired_bootstrap(spark):
    draw = np.random.RandomState(5)
    deltas = draw.randn(3000) * 0.3 + 0.05
    df = spark.createDataFrame([(i, float(d)) for i, d in enumerate(deltas)] + [(9000, None), (9001, float("nan"))], "example_id int, delta double")
    low, high = comparison.paired_bootstrap(df)
    means = [deltas[draw.randint(0, 3000, 3000)].mean() for _ in range(2000)]
    assert np.allclose((low, high), np.quantile(means, [0.025, 0.975]), atol=0.003)
    assert comparison.paired_bootstrap(df) == (low, high) and comparison.paired_bootstrap(df.limit(0)) == (None, None)


def test_task_comparison_wants_a_bijection(spark):
    side = lambda rows: spark.createDataFrame(rows, "example_id int, score double")
    a = side([(1, 0.5), (2, 0.5)])
    assert {r.example_id: r.outcome for r in comparison.task_comparison(a, side([(1, 0.5), (2, 0.7)]), "score").collect()} == {1: "unchanged", 2: "improved"}
    for bad in ([(1, 0.5)], [(1, 0.5), (2, 0.5), (2, 0.5)], [(1, 0.5), (2, float("nan"))], [(1, 0.5), (3, 0.5)]):
        with pytest.raises(PySparkException, match="exactly once|every example once"):
            comparison.task_comparison(a, side(bad), "score").collect()


def test_typical_distance(spark):
    draw = np.random.RandomState(1)
    x = draw.randn(60, 5)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "_row long, embedding array<double>")
    g = np.random.default_rng(0)
    a, b = g.integers(0, 60, 4000), g.integers(0, 60, 4000)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    wanted = np.median((1 - (unit[a] * unit[b]).sum(axis=1))[a != b])
    assert neighbours.typical_distance(df) == pytest.approx(wanted, abs=1e-9)
    assert neighbours.typical_distance(df.limit(1)) == 1.0 and neighbours.typical_distance(df.limit(0)) == 1.0


def test_edits(spark):
    df = spark.createDataFrame([(0, 1, [(0.0, 0.0, 1.0, 1.0, 1)]), (1, 2, None)], f"_row long, label int, instances {BOX}")
    df = editing.with_class_map(df, "label", {1: "a", 2: "b"})
    cells = lambda rows, kind="int": spark.createDataFrame(rows, f"_row long, value {kind}")
    out = editing.apply_edits(df, new_columns={"seen": ("bool", False)}, instance_properties={"instances": {"note": "string"}}, values={"label": cells([(1, 1)]), "seen": cells([(0, True)], "boolean")})
    assert [(r.label, r.seen) for r in out.orderBy("_row").collect()] == [(1, True), (1, False)] and out.first().instances[0].note is None
    assert editing.class_map(out, "label") == {1: {"name": "a"}, 2: {"name": "b"}}
    for bad in (
        {}, {"new_columns": {"label": ("int32", 0)}}, {"new_columns": {"x": ("blob", 0)}}, {"values": {"gone": cells([(0, 1)])}}, {"values": {"label": cells([(9, 1)])}}, {"values": {"label": cells([(0, "x")], "string")}},
        {"class_maps": {"label": {1: "a"}}}, {"instance_properties": {"label": {"a": "int"}}}, {"instance_properties": {"instances": {"label": "string"}}},
    ):
        with pytest.raises(editing.EditError):
            editing.apply_edits(df, **bad)
    with pytest.raises(editing.EditError):
        editing.apply_edits(df, values={"label": cells([(0, 1)])}, read_only=["label"])
    grown = editing.add_class(df, "label", "c", colour="red")
    assert editing.class_map(grown, "label")[3] == {"name": "c", "colour": "red"}
    assert editing.class_map(editing.edit_class(grown, "label", 3, name="d"), "label")[3]["name"] == "d" and 3 not in editing.class_map(editing.delete_class(grown, "label", 3), "label")
    for call in (lambda: editing.add_class(df, "label", "a"), lambda: editing.edit_class(df, "label", 8), lambda: editing.delete_class(df, "label", 8)):
        with pytest.raises(editing.EditError):
            call()


def test_revisions(spark):
    edges = spark.createDataFrame([("b", "a", 0), ("c", "b", 0), ("d", "a", 0)], "child string, parent string, place int")
    catalog = spark.createDataFrame([(v, v.upper(), str(n), op, 5, None) for n, (v, op) in enumerate((("a", "new"), ("b", "edit"), ("c", "filter"), ("d", "filter"), ("z", "new")))], "version string, name string, created string, op string, row_count int, args string")
    assert editing.preserving_revision(spark, edges, catalog, "a").first() == ("b", None)
    assert editing.preserving_revision(spark, edges, catalog, "b").first() == ("b", "rows may have moved")
    assert editing.revision(spark, edges, catalog, "a", name="C").first()[0] == "c" and editing.revision(spark, edges, catalog, "a").first()[0] == "c"
    with pytest.raises(PySparkException, match="no descendant"):
        editing.revision(spark, edges, catalog, "a", version="z").collect()
    with pytest.raises(editing.EditError):
        editing.revision(spark, edges, catalog, "a", name="nothing")


def test_reviews_and_releases(spark):
    time = F.lit("2026-01-01")
    samples = spark.createDataFrame([("a",), ("b",), ("b",), (None,), ("",)], "sample string")
    prints = governance.fingerprints(spark.createDataFrame([("a", 1), ("b", 2)], "sample string, v int"), "sample")
    events = governance.status_events(samples, "reviewed", time, author="me", fingerprints=prints).withColumn("seq", F.lit(1))
    assert sorted(r.sample for r in events.collect()) == ["a", "b"]
    for bad in (("nothing", ""), ("rework", "  "), ("rework", "x" * 3000)):
        with pytest.raises(governance.Refused):
            governance.status_events(samples, bad[0], time, comment=bad[1])
    noted = governance.comment_events(samples, "look", time).withColumn("seq", F.lit(2))
    state = governance.qa_state(events.unionByName(noted))
    assert {r.sample: (r.status, r.comments) for r in state.collect()} == {"a": ("reviewed", 1), "b": ("reviewed", 1)}
    sets = spark.createDataFrame([("train", "a"), ("valid", "b")], "set string, sample string")
    shipped = governance.shipment(sets, state, "s1", time).withColumn("seq", F.lit(1))
    with pytest.raises(governance.Refused, match="valid"):
        governance.shipment(sets.union(spark.createDataFrame([("valid", "c")], sets.schema)), state, "s2", time)
    released = governance.release(sets, state, shipped, "  First  one ", "r1", time).withColumn("seq", F.lit(2))
    assert released.first().version == 2 and released.first().name == "First one" and released.first().sets["train"].verified == 1
    log = shipped.unionByName(released)
    with pytest.raises(governance.Refused, match="named"):
        governance.release(sets, state, log, "first ONE", "r2", time)
    gone = log.unionByName(spark.createDataFrame([("r1", 3)], "deleted string, seq int"), allowMissingColumns=True)
    assert governance.release(sets, state, gone, "first ONE", "r2", time).first().version == 3
    assert [(r.id, r.approval) for r in governance.shipments(gone).collect()] == [("s1", "exploratory")]
    assert governance.approval(prints, state, "r1", time).first().approved == "r1"
    changed = governance.fingerprints(spark.createDataFrame([("a", 1), ("b", 3)], "sample string, v int"), "sample")
    with pytest.raises(governance.Refused, match="changed since"):
        governance.approval(changed, state, "r1", time)
    assert [tuple(r) for r in governance.changed_since_approval(prints, changed).collect()] == [("b", "changed")]
    tags = governance.tag_events(samples, [" night  shift "], ["old"], time)
    assert tags.count() == 2 and tags.first()["add"] == ["night shift"]
    with pytest.raises(governance.Refused):
        governance.tag_events(samples, ["bad!"], [], time)
    with pytest.raises(governance.Refused):
        governance.tag_events(samples, ["x"], [], time, objects=["a1"])


def test_prelabels_and_pulls_keep_what_people_drew(spark):
    rows = spark.createDataFrame([(0, []), (1, [(0.0, 0.0, 1.0, 1.0, 1)]), (2, None)], f"_row long, instances {BOX}")
    drafts = spark.createDataFrame([(0, [(2.0, 2.0, 3.0, 3.0, 1, 0.9), (2.0, 2.0, 3.0, 3.0, 1, 0.1)]), (1, [(4.0, 4.0, 5.0, 5.0, 2, 0.8)])], f"_row long, instances {SCORED}")
    found = {mode: {r._row: [(i.source, i.x0) for i in r.instances] for r in editing.prelabelled(rows, drafts, mode=mode).collect()} for mode in ("empty", "replace")}
    assert found["empty"] == {0: [("model", 2.0)], 1: [("manual", 0.0)], 2: []} and found["replace"][1] == [("manual", 0.0), ("model", 4.0)]
    with pytest.raises(editing.EditError):
        editing.prelabelled(rows, drafts, mode="all")
