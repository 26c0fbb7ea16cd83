"""Operator 8: probabilities of the two models against plain counting."""

from __future__ import annotations

import collections
import pickle
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sampleworks.llm import toxicity
from sampleworks.llm._shared import packed, unpacked
from sampleworks.llm._words import LOWER, word_hashes


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(21)
    words = ["".join(draw.choice("abcdefgh") for _ in range(draw.randrange(1, 4))) for _ in range(60)]
    make = lambda: " ".join(draw.choice(words[: draw.choice([5, 20, 60])]) for _ in range(draw.randrange(1, 25)))
    fitted = [(make(), i % 3 == 0) for i in range(150)]
    return fitted, [make() for _ in range(80)] + [t for t, _ in fitted] + [""]


def hashed(word):
    data = np.frombuffer(word.encode(), np.uint8)
    return word_hashes(data, np.array([0, len(data)]), toxicity.SEPARATORS, LOWER)[0]


def test_probabilities_equal_plain_counting(spark, texts):
    fitted, everything = texts
    rows = spark.createDataFrame([(t, int(y)) for t, y in fitted], "text string, toxic int").repartition(3)
    df = spark.createDataFrame([(t,) for t in [*everything, None]], "text string").repartition(4)
    models = pickle.loads(pickle.dumps(toxicity.language_models(df, rows)))

    pairs_of = lambda t: list(zip([None, *t.split()], t.split()))
    count = [collections.Counter(p for t, y in fitted if y == bool(k) for p in set(pairs_of(t))) for k in (1, 0)]
    vocabulary = sorted({w for t, _ in fitted for w in t.split()})
    pool = collections.Counter(w for _, w in {p for t in everything for p in pairs_of(t)})
    whole = sum(pool[w] for w in vocabulary) + toxicity.ALPHA * len(vocabulary)
    loses = lambda counts: toxicity.discounts(*[sum(c == k for c in counts) for k in (1, 2, 3, 4)])
    wanted = {}
    for k in (0, 1):
        contexts = collections.Counter(w for _, w in count[k])
        of_words, of_pairs = loses(contexts.values()), loses(count[k].values())
        total = sum(contexts.values())
        left = sum(of_words[min(c, 3)] for c in contexts.values()) / total
        alone = {w: (contexts[w] - of_words[min(contexts[w], 3)]) / total + left * (pool[w] + toxicity.ALPHA) / whole for w in vocabulary}
        assert abs(sum(alone.values()) - 1) < 1e-9
        for v in vocabulary:
            led = {w: c for (a, w), c in count[k].items() if a == v}
            n = sum(led.values())
            back = sum(of_pairs[min(c, 3)] for c in led.values()) / n if n else 1.0
            for w in vocabulary:
                c = led.get(w, 0)
                wanted[v, w, k] = alone[w], (c - of_pairs[min(c, 3)]) / max(n, 1) + back * alone[w]
    before = np.concatenate([hashed(v) for v in vocabulary for _ in vocabulary])
    after = np.concatenate([hashed(w) for _ in vocabulary for w in vocabulary])
    alone, paired, _, _ = models.probabilities(before, after)
    names = [(v, w) for v in vocabulary for w in vocabulary]
    for k in (0, 1):
        assert np.allclose(alone[:, k], [wanted[v, w, k][0] for v, w in names], rtol=1e-5)
        assert np.allclose(paired[:, k], [wanted[v, w, k][1] for v, w in names], rtol=1e-5)
        assert np.allclose(paired[:, k].reshape(len(vocabulary), -1).sum(axis=1), 1, rtol=1e-5)


def test_ties_and_long_texts(spark):
    """Equal texts have equal scores wherever they stand; a very long text is scored over its end too."""
    rows = [(i, ("vile word here " if i % 4 == 0 else "mild word here ") + f"w{i % 50}") for i in range(2000)]
    rows += [(9000, "plain " * 200_000 + "vile word here"), (9001, "vile word here w4"), (9002, "vile word here w4"), (9003, "plain " * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(2000)], "doc_id long, toxic int")
    found = {r.doc_id: r.score for r in toxicity.score(docs, labels).collect()}
    assert found[9001] == found[9002] == found[4]
    assert found[9000] > found[9003]


def test_packed_arrays():
    for values in (np.arange(1000, dtype=np.uint64) * 77, np.random.RandomState(1).rand(50, 2).astype(np.float32), np.zeros(0, np.uint64), np.zeros((0, 2), np.uint32)):
        again = unpacked(packed(values), values.dtype.str, values.shape)
        assert again.dtype == values.dtype and (again == values).all() and again.shape == values.shape


def test_contexts_of_a_frequent_word_are_spread_over_parts():
    """The word at place 7 stands behind 50,000 others; no part gets more than twice its share of them, and all keys stay. Those of
    other words stay in the part of their place."""
    draw = np.random.default_rng(1)
    hot = np.uint64(7) << np.uint64(32) | draw.integers(0, 2**32, 50_000, dtype=np.uint64)
    rare = draw.integers(8, 100, 500, dtype=np.uint64) << np.uint64(32) | draw.integers(0, 2**32, 500, dtype=np.uint64)
    keys = np.unique(np.concatenate((hot, rare)))
    found = toxicity._parted(keys, 16, np.arange(100) == 7)
    parts = {p: unpacked(k.as_buffer()) for p, k in zip(found.column("part").to_pylist(), found.column("keys"))}
    assert len(parts) == 16 and max(map(len, parts.values())) < 2 * 50_000 / 16
    assert np.array_equal(np.sort(np.concatenate(list(parts.values()))), keys)
    for p, own in parts.items():
        place = own >> np.uint64(32)
        assert (place[place != 7] % 16 == p).all()


def test_texts_beyond_the_bound_of_bytes_are_not_fitted(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "FIT_BYTES", {1: 1000, 0: 10**6})
    docs = spark.createDataFrame([(i, "w " * 200) for i in range(1, 30)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 30)], "doc_id long, toxic int")
    rows = toxicity._fit_rows(docs, labels, toxicity.remainder(F.col("id")) < 9, "doc_id", "text").groupBy("toxic").count().collect()
    assert {r.toxic: r["count"] for r in rows} == {1: 2, 0: 14}


def test_every_labelled_text_is_fitted(spark, monkeypatch):
    """Scores are the same whatever a bounded sample would hold: counts, weights and so the threshold come from all labelled rows."""
    draw = random.Random(5)
    common = ["".join(draw.choice("abcdeilmnorst") for _ in range(5)) for _ in range(200)]
    rows = [(i, " ".join([draw.choice(common) for _ in range(12)] + ([f"vile{draw.randrange(30)}"] if i % 4 == 0 else []))) for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(800)], "doc_id long, toxic int")
    fitted, plain = [], toxicity.language_models

    def counted(df, rows, text_col="text"):
        fitted.append(rows.groupBy("toxic").count().collect())
        return plain(df, rows, text_col)

    monkeypatch.setattr(toxicity, "language_models", counted)
    whole = {r.doc_id: r.score for r in toxicity.score(docs, labels).collect()}
    monkeypatch.setattr(toxicity, "FIT_DOCUMENTS", {1: 10, 0: 20})
    monkeypatch.setattr(toxicity, "FIT_BYTES", {1: 500, 0: 1000})
    bounded = {r.doc_id: r.score for r in toxicity.score(docs, labels).collect()}
    assert all(abs(whole[i] - bounded[i]) < 1e-9 for i, _ in rows)
    wanted = collections.Counter(int(i % 4 == 0) for i, _ in rows if zlib.crc32(str(i).encode()) % 5 in (1, 2, 3))
    assert [{r.toxic: r["count"] for r in found} for found in fitted] == [wanted, wanted]


def test_weights_are_those_of_all_rows(spark):
    """Derivatives added up over tasks give the minimum that plain Newton steps on the whole matrix give."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 3))
    y = (rng.random(500) < 1 / (1 + np.exp(-(x @ [1.0, -2.0, 0.5] - 0.3)))).astype(int)
    rows = spark.createDataFrame([(int(t), v.tolist()) for t, v in zip(y, x)], "toxic int, x array<double>").repartition(7)
    found = toxicity.logistic(rows, 3)
    whole, ridge = np.concatenate((np.ones((500, 1)), x), axis=1), np.diag([1e-3, 0.1, 0.1, 0.1])
    slope = whole.T @ (y - 1 / (1 + np.exp(-whole @ found))) - ridge @ found
    assert np.abs(slope).max() < 1e-6


def test_labels_beyond_the_broadcast_give_the_same_rows(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(60)] + [(7, "again"), (None, "none")], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 3 if i % 10 else None) for i in range(80)], "doc_id long, toxic int")
    rows = lambda: sorted(map(tuple, toxicity._labelled(docs, labels, F.col("id") > 5, "doc_id", "text").collect()))
    few = rows()
    monkeypatch.setattr(toxicity, "LABEL_ROWS", 0)
    assert few == rows() == sorted([(f"text {i}", i % 3) for i in range(6, 60) if i % 10 and i % 3 < 2] + [("again", 1)])
