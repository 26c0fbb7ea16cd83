"""Operator 3: models, weights and draws against plain counting."""

from __future__ import annotations

import collections
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sampleworks.llm import quality


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(13)
    word = lambda: "".join(draw.choice("abcde") for _ in range(draw.randrange(1, 6)))
    common = [word() for _ in range(40)]
    docs = [(i, " ".join(draw.choice(common) + ("##" if i % 4 == 0 else "") for _ in range(draw.randrange(0, 30)))) for i in range(240)]
    return docs + [(900, None), (901, ""), (902, "abc"), (5, "a second text of an id"), (903, "long " * 60_000 + "##"), (None, "no id")]


def buckets(text):
    data = np.frombuffer((text or "").encode(), np.uint8)
    return quality.ngrams(data, np.array([0, len(data)]))[0].tolist() if len(data) else []


def test_weights_equal_plain_counting(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS w", "2 AS key", "3 AS log_weight").repartition(4)
    labels = [(i, int(i % 4 > 0)) for i in range(240)]
    found = quality.weigh(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()

    part = lambda i: zlib.crc32(str(i).encode()) % 5
    raw, good = collections.Counter(), collections.Counter()
    for i, text in rows:
        raw.update(buckets(text))
        if i is not None and i < 240 and i % 4 and part(i) in (1, 2, 3):
            good.update(buckets(text))
    size = quality.BUCKETS
    n, m = ([sum(c for b, c in counts.items() if (b >= size) == half) for half in (False, True)] for counts in (raw, good))

    def ratio(b):
        half = b >= size
        p = (raw[b] + 0.5) / (n[half] + 0.5 * size)
        return math.log((good[b] + 5 * p * size) / (m[half] + 5 * size) / p)

    wanted = sorted((str(i), sum(map(ratio, buckets(text)))) for i, text in rows if i != 903)
    mine = sorted((str(r.doc_id), r.log_weight) for r in found if r.doc_id != 903)
    assert [i for i, _ in mine] == [i for i, _ in wanted]
    assert np.allclose([w for _, w in mine], [w for _, w in wanted], rtol=1e-9, atol=1e-9)
    long = next(r for r in found if r.doc_id == 903)
    assert math.isclose(long.log_weight, sum(c * ratio(b) for b, c in collections.Counter(buckets(rows[-2][1])).items()), rel_tol=1e-9)
    # the k largest keys are kept, k being the number of weights that pass the cut
    held = [(r.log_weight, dict(labels)[r.doc_id]) for r in found if r.doc_id in dict(labels) and part(r.doc_id) == 4]
    cut = quality.best_cut(np.array([w for w, q in held if q]), np.array([w for w, q in held if not q]))
    k = sum(r.log_weight >= cut for r in found)
    least = sorted((r.key for r in found), reverse=True)[k - 1]
    assert all(r.kept == (r.key >= least) for r in found)


def test_ties_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "same words here")] * 4 + [(2, "other words")], "doc_id long, text string").withColumn("log_weight", F.lit("mine"))
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    kept = quality.resample(docs, labels, share=0.5)
    assert kept.columns == docs.columns and {r.log_weight for r in kept.collect()} <= {"mine"}
    assert kept.filter("doc_id = 1").count() in (0, 4)  # repeated rows have one fate


def test_draws_follow_weights(spark):
    """At a high temperature two documents of a ratio of weights are drawn first in that proportion."""
    noise = spark.range(20_000).select(quality.gumbel(F.col("id")).alias("a"), quality.gumbel(F.col("id") + 1_000_000).alias("b"))
    first = noise.filter(F.col("a") + math.log(3.0) > F.col("b")).count() / 20_000
    assert abs(first - 0.75) < 0.015


def test_counts_are_added_up_row_by_row(spark):
    """What a group of the sum holds is one row for each task and bucket, whatever the texts; the counts are those of one task."""
    docs = spark.createDataFrame([(i, f"word{i} and more of it") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    one, many = (quality.log_ratios(docs.repartition(n), labels, "doc_id", "text") for n in (1, 12))
    assert (one == many).all() and one.any()
