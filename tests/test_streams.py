"""Streams that keep state and follow folders, over several batches."""

from __future__ import annotations

import random
from pathlib import Path

from pyspark.sql import functions as F

from sampleworks.operators.joining import join_input
from sampleworks.sources import runs, tables
from sampleworks.streaming import live, logs


def _bytes(folder: Path) -> int:
    return sum(p.stat().st_size for p in folder.rglob("*") if p.is_file())


def test_what_a_batch_writes_follows_the_batch(spark, tmp_path):
    log, folder = tmp_path / "log", tmp_path / "state"
    events = lambda keys, seq: spark.createDataFrame([(k, seq, f"s{seq}") for k in keys], "image long, seq long, status string")
    written = []
    for batch, keys in enumerate([range(20_000), range(5), range(3, 9)]):
        events(keys, batch).coalesce(1).write.mode("append").parquet(str(log))
        before = _bytes(folder) if folder.exists() else 0
        source = spark.readStream.schema("image long, seq long, status string").parquet(str(log))
        logs.stream_fold(source, str(folder), "image", "seq", "status").awaitTermination()
        written.append(_bytes(folder) - before)
    assert written[1] < written[0] / 4 and written[2] < written[0] / 4
    schema = logs.state_schema(events([], 0), "image", "seq", "status")
    told = lambda: {r.image: (r.seq, r.status) for r in logs.current(spark, str(folder), schema, "image", "seq", "status").collect()}
    state = told()
    assert len(state) == 20_000
    assert [state[i][0] for i in range(10)] == [1, 1, 1, 2, 2, 2, 2, 2, 2, 0]
    assert logs.compact(spark, str(folder), schema, "image", "seq", "status")
    assert told() == state
    assert not logs.compact(spark, str(folder), schema, "image", "seq", "status")  # nothing new


def test_state_of_late_and_repeated_events(spark):
    draw = random.Random(2)
    rows = [(draw.choice([None, *range(6)]), draw.randrange(30), draw.choice(["a", "b", None])) for _ in range(200)]
    found = logs.fold_once(spark.createDataFrame(rows, "image int, seq int, status string"), "image", "seq", "status", files=6)
    best: dict = {}
    for image, seq, status in rows:
        best[image] = max(best.get(image, (-1, "")), (seq, status or ""))
    assert {r.image: r.status or "" for r in found.collect()} == {k: v[1] for k, v in best.items()}
    assert logs.fold_once(spark.createDataFrame([], "image int, seq int, status string"), "image", "seq", "status").collect() == []


def test_a_live_view_equals_the_batch_join(spark, tmp_path):
    run, folder = str(tmp_path / "run"), str(tmp_path / "view")
    samples = {k: spark.range(50).select(F.col("id").alias("_row"), F.concat(F.lit(f"{k}-"), "id").alias("sample")) for k in ("x", "y")}
    schema = spark.createDataFrame([], "example_id long, epoch int, loss double, extra string, source string").schema
    seen = []
    for epoch in range(3):
        for k in samples:
            part = spark.range(50).select(F.col("id").alias("example_id"), F.lit(epoch).alias("epoch"), (F.rand(epoch) * 9).alias("loss"))
            runs.add_metrics(part.withColumn("extra", F.lit("e")) if k == "x" else part, run, constants={"source": k})
        if epoch == 2:  # a table whose write was broken off leaves no file that is read
            (tmp_path / "run/metrics/metrics_id=99/_temporary").mkdir(parents=True)
            (tmp_path / "run/metrics/metrics_id=99/_temporary/part-0.parquet").write_bytes(b"half")
        live.live_view(spark, run, samples, schema, folder, trigger=None, tables_per_batch=1).awaitTermination()
        seen.append(live.live_rows(spark, folder).count())
    assert seen == [100, 200, 300]
    live.live_view(spark, run, samples, schema, folder, trigger=None).awaitTermination()  # nothing new
    metrics = runs.metrics_tables(spark, run)
    columns = ["sample", "example_id", "epoch", "loss", "extra", "source", "metrics_id"]
    batch = [join_input(metrics.filter(F.col("source") == k), table).select(columns) for k, table in samples.items()]
    rows = lambda df: sorted(map(repr, map(tuple, df.select(columns).collect())))
    assert rows(live.live_rows(spark, folder)) == rows(batch[0].union(batch[1]))


def test_a_running_view_takes_up_what_comes(spark, tmp_path):
    """The same with a trigger by time, while tables are added."""
    run, folder = str(tmp_path / "run"), str(tmp_path / "view")
    samples = {"x": spark.range(5).select(F.col("id").alias("_row"), F.lit("s").alias("sample"))}
    part = spark.range(5).select(F.col("id").alias("example_id"), F.lit(1.0).alias("loss"))
    runs.add_metrics(part, run, constants={"source": "x"})
    query = live.live_view(spark, run, samples, spark.createDataFrame([], "example_id long, loss double, source string").schema, folder, trigger="100 milliseconds")
    try:
        query.processAllAvailable()
        runs.add_metrics(part, run, constants={"source": "x"})
        query.processAllAvailable()
        assert sorted(r.metrics_id for r in live.live_rows(spark, folder).collect()) == [0] * 5 + [1] * 5
    finally:
        query.stop()


def test_new_versions_are_seen_once(spark, tmp_path):
    root, folder = str(tmp_path / "root"), str(tmp_path / "seen")
    Path(root).mkdir()
    for n in range(3):
        tables.write_version(spark.range(2), tables.table_path(root, "p", "d", f"t{n}"), parents=[f"t{n - 1}"] if n else [])
        live.poll_versions(spark, root, folder, trigger=None).awaitTermination()
        found = spark.read.parquet(f"{folder}/rows").collect()
        assert sorted(r.base_name for r in found) == [f"t{i}" for i in range(n + 1)]
