"""Operators 2, 4, 7 and 10 against brute force on small tables with planted cases."""

from __future__ import annotations

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sampleworks.llm import ngram_jaccard, sharding, suffix_dedup, topk_search


def families():
    draw = random.Random(4)
    words, rows = [f"w{i}" for i in range(400)], []
    for _ in range(16):
        base = [draw.choice(words) for _ in range(draw.choice([2, 4, 5, 8, 12, 20, 60, 150]))]
        for _ in range(draw.randrange(1, 20)):
            x = list(base)
            for _ in range(draw.randrange(4)):
                x[draw.randrange(len(x))] = draw.choice(words)
            rows.append((len(rows) * 3 + 1, " ".join(x).upper() if draw.random() < 0.2 else "  ".join(x)))
    rows += [(100_000, None), (100_001, ""), (100_002, "  \n"), (100_003, None), (100_004, "a"), (100_005, "A"), (100_006, "a b")]
    draw.shuffle(rows)
    return rows


def linked_brute(rows, size, percent):
    sets, parent = {}, {i: i for i, _ in rows}
    for i, text in rows:
        w = [bytes(x) for x in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())]
        sets[i] = frozenset() if not w else frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return sorted((i, len(sets[i]), root(i)) for i in ids)


@pytest.mark.parametrize(("size", "percent", "direct", "family"), [(3, 90, 1024, 4096), (5, 80, 3, 4096), (5, 80, 3, 4)])
def test_jaccard_components(spark, monkeypatch, size, percent, direct, family):
    monkeypatch.setattr(ngram_jaccard, "DIRECT", direct)
    monkeypatch.setattr(ngram_jaccard, "FAMILY", family)
    monkeypatch.setattr(ngram_jaccard, "TILE", 3)
    rows = families()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS node", "2 AS id").repartition(5)
    found = ngram_jaccard.join_components(df, size=size, percent=percent)
    assert sorted(map(tuple, found.collect())) == linked_brute(rows, size, percent)


def test_jaccard_shuffled_sides_and_empty(spark, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "BROADCAST_USES", 0)
    rows = families()[:60]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, ngram_jaccard.join_components(df).collect())) == linked_brute(rows, 3, 90)
    assert ngram_jaccard.join_components(df.limit(0)).count() == 0


def test_overlaps_in_column_blocks(monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "COLUMNS", 3)
    draw = np.random.RandomState(1)
    sets = [np.unique(draw.randint(0, 40, 15)).astype(np.uint64) for _ in range(12)]
    wanted = [[len(set(a.tolist()) & set(b.tolist())) for b in sets[5:]] for a in sets[:5]]
    assert ngram_jaccard.overlaps(sets[:5], sets[5:]).tolist() == wanted
    same = ngram_jaccard.overlaps(sets, sets)
    assert all(same[i, j] == len(set(sets[i].tolist()) & set(sets[j].tolist())) for i in range(12) for j in range(12) if i != j)


def passages():
    draw = random.Random(2)
    letters = "abcdefgh é日"
    shared = ["".join(draw.choice(letters) for _ in range(draw.choice([30, 49, 50, 51, 60, 100, 200]))) for _ in range(25)] + ["ab" * 60, "a" * 90]
    rows = [(draw.randrange(200), "".join(draw.choice(shared) if draw.random() < 0.5 else "".join(draw.choice(letters) for _ in range(draw.randrange(1, 60))) for _ in range(draw.randrange(1, 7)))) for _ in range(200)]
    return rows + [rows[0], (999, rows[0][1]), (None, rows[0][1]), (5, None), (6, ""), (1000, None), (0, "x" * 49), (2000, "x" * 49), (2001, "x" * 50), (2002, "x" * 51)]


def removed_brute(rows):
    first, out = {}, []
    for d, x in rows:
        b = (x or "").encode()
        for i in range(len(b) - 49 if d is not None else 0):
            first[b[i : i + 50]] = min(d, first.get(b[i : i + 50], d))
    for d, x in rows:
        b = (x or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 49 if d is not None else 0):
            if first[b[i : i + 50]] < d:
                gone[i : i + 50] = True
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((str(d), len(b), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_passages(spark, monkeypatch, limit):
    monkeypatch.setattr(suffix_dedup, "BROADCAST_ROWS", limit)
    rows = passages()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "doc_id AS doc", "text AS t").repartition(4)
    found = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.removed(df).collect())
    assert found == removed_brute(rows)


def test_passages_across_stretches(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "STRETCH", 64)
    rows = passages()[:80]
    for size in (1, 60):
        data = np.frombuffer("".join(t for _, t in rows[:size]).encode(), np.uint8)
        ends = np.cumsum([0, *[len(t.encode()) for _, t in rows[:size]]])
        owner, _, low, high = suffix_dedup.anchors(data, ends)
        covered = {(o, p) for o, a, b in zip(owner, low, high) for p in range(a, b - 49)}
        assert covered == {(i, p) for i in range(size) for p in range(ends[i + 1] - ends[i] - 49)}


def test_deduplicated_keeps_columns(spark):
    df = spark.createDataFrame([(1, "p" * 60 + "one", "x"), (2, "two" + "p" * 60, None), (3, None, "z")], "doc_id long, text string, t string")
    assert sorted(map(tuple, suffix_dedup.deduplicated(df).collect())) == [(1, "p" * 60 + "one", "x"), (2, "two", None), (3, None, "z")]
    assert suffix_dedup.removed(df.limit(0)).count() == 0


@pytest.mark.parametrize("law", ["bytes", "rows", "key"])
def test_shards(spark, law):
    draw = random.Random(1)
    rows = [(i, draw.choice(["hot text " * 20, "x" * draw.randrange(200), None])) for i in range(3000)] + [(7, None)] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS shard", "2 AS size").repartition(4)
    found = sharding.shard(df, 16, law=law, min_ranges=32).collect()
    assert len(found) == len(rows)
    by = collections.defaultdict(list)
    for r in found:
        by[r.shard].append(r)
    assert all(sorted(r.slot for r in part) == list(range(len(part))) for part in by.values())
    if law == "bytes":
        sizes = [sum(r.size for r in by[s]) for s in range(16)]
        assert max(sizes) - min(sizes) <= 2 * max(r.size for r in found)
    elif law == "rows":
        assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    else:
        assert all(r.grown_shard in (r.shard, 16) for r in found) and len({(r.doc_id, r.shard) for r in found}) == 3000
    assert sharding.shard(df.limit(0), 16, law=law).count() == 0


def test_top_k_equals_brute_force(spark):
    draw = np.random.RandomState(5)
    vectors = [(i, draw.randn(6).round(2).tolist()) for i in range(300)] + [(300 + i, [0.5] * 6) for i in range(150)]
    vectors += [(900, None), (901, [float("nan")] * 6), (902, []), (950, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1000, [1.0, 2.0]), (1050, [5e6] * 2), (1051, [5e6, 5e6 + 1])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").selectExpr("*", "1 AS score").repartition(3)
    found = sorted(map(tuple, topk_search.top_k(df, F.col("vec_id") % 50 == 0, shard_rows=64, query_rows=4).collect()))
    usable = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in vectors if v and all(x is not None and np.isfinite(x) for x in v)]
    wanted = []
    for q, v in usable:
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in usable if i != q and len(w) == len(v))[:5]
            wanted += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    assert found == sorted(wanted)
    assert topk_search.top_k(df.limit(0), F.lit(True)).count() == 0


def test_previous_factors_equal_brute_force():
    draw = random.Random(9)
    for length in (5, 8, 50):
        texts = ["".join(draw.choice("ab") for _ in range(draw.randrange(length, 3 * length))).encode() for _ in range(12)]
        texts += [texts[0], b"a" * (2 * length)]
        docs, groups = [draw.randrange(8) for _ in texts], [draw.randrange(2) for _ in texts]
        starts = [(n, at) for n, x in enumerate(texts) for at in range(len(x) - length + 1)]
        draw.shuffle(starts)
        places = np.cumsum([0, *map(len, texts)])

        def common(a, b):
            return next((i for i in range(length) if a[i] != b[i]), length)

        strings = [(texts[n][at : at + length], docs[n], groups[n]) for n, at in starts]
        wanted = [max((common(x, y) for y, e, h in strings if h == g and e < d), default=0) for x, d, g in strings]
        data = np.frombuffer(b"".join(texts), np.uint8)
        begin = np.array([places[n] + at for n, at in starts])
        found = suffix_dedup.previous_factors(data, begin, np.array([groups[n] for n, _ in starts]), np.array([docs[n] for n, _ in starts]), length)
        assert found.tolist() == wanted


def test_line_repeated_within_documents(spark, monkeypatch):
    """Many repeats inside each of several documents: decided once for each document, removed everywhere."""
    monkeypatch.setattr(suffix_dedup, "HOT", 20)
    line = "the same long line again and again, as boilerplate goes, in full "
    rows = [(3, line * 40 + "x"), (1, "y" + line * 30), (2, "a" * 400), (4, "b" + "a" * 700), (5, f"other {line}")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    found = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.removed(df).collect())
    assert found == removed_brute(rows)


def test_ball_tree_leaves_out_what_cannot_reach(monkeypatch):
    """On vectors in clusters most products are never computed; scores beyond 64 bits count as the largest that fits."""
    draw = np.random.RandomState(2)
    centres = draw.randn(40, 16) * 300
    points = np.floor(np.repeat(centres, 60, axis=0) + draw.randn(2400, 16) * 10)
    ids = draw.permutation(2400).astype(np.int64)
    queries = points[::60]
    computed, plain = [], topk_search.exact_products
    monkeypatch.setattr(topk_search, "exact_products", lambda q, p: computed.append(len(q) * len(p)) or plain(q, p))
    scores, found = topk_search.search(topk_search.BallTree(points, ids), queries, ids[::60], np.full(40, topk_search.NONE), 5)
    for i, q in enumerate(queries):
        wanted = sorted((-int(q @ p), int(n)) for p, n in zip(points, ids) if n != ids[60 * i])[:5]
        assert [(-int(s), int(n)) for s, n in zip(scores[i], found[i])] == wanted
    assert sum(computed) < 0.25 * 40 * 2400
    large = np.array([[1e12, 1e12], [-1e12, 1e12]])
    assert plain(large, np.array([[1e12, 1e12], [1e12, 0.0]])).tolist() == [[2**63 - 1, 2**63 - 1], [0, topk_search.NONE + 1]]


def test_top_k_over_many_shards(spark):
    draw = np.random.RandomState(8)
    centres = draw.randn(12, 8) * 3
    vectors = [(i, (centres[i % 12] + draw.randn(8) * 0.2).round(3).tolist()) for i in range(1500)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(4)
    found = sorted(map(tuple, topk_search.top_k(df, F.col("vec_id") % 50 == 0, shard_rows=40, query_rows=3).collect()))
    whole = np.floor(256 * np.array([v for _, v in vectors])).astype(np.int64)
    wanted = []
    for q in range(0, 1500, 50):
        best = sorted((-int(s), i) for i, s in enumerate(whole @ whole[q]) if i != q)[:5]
        wanted += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert found == sorted(wanted)


def test_passages_folded_in_portions(spark, monkeypatch):
    """A task that sends its candidates early gives the same result."""
    monkeypatch.setattr(suffix_dedup, "FOLDED", 3)
    monkeypatch.setattr(suffix_dedup, "HELD_ANCHORS", 2)
    rows = passages()
    found = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.removed(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert found == removed_brute(rows)


def test_query_rows_with_one_id_keep_their_own_results(spark, monkeypatch):
    """Repeated ids among queries: each row gets its own best rows; several packs of summaries and groups of blocks meet."""
    monkeypatch.setattr(topk_search, "SUMMARIES", 2)
    monkeypatch.setattr(topk_search, "GROUP_BLOCKS", 2)
    draw = random.Random(17)
    rows = [(i, [draw.gauss(0, 1), draw.gauss(0, 1), draw.gauss(0, 1)]) for i in range(1, 400)]
    rows += [(100, [1.0, 0.0, 0.0]), (100, [0.0, 1.0, 0.0]), (100, [0.0, 1.0, 0.0]), (150, [0.0, 0.0, -1.0]), (7, [9.0, 9.0, 9.0]), (7, [9.0, 9.0, 9.0])]
    whole = [(i, [int(256 * x // 1) for x in v]) for i, v in rows]
    expected = []
    for i, v in whole:
        if i % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in whole if j != i)
            expected += [(i, rank + 1, j, -s) for rank, (s, j) in enumerate(scores[:5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    found = topk_search.top_k(df, F.col("vec_id") % 50 == 0, shard_rows=32, query_rows=3)
    assert sorted(map(tuple, found.collect())) == sorted(expected)


@pytest.mark.parametrize("direct", [1024, 2])
def test_one_id_on_unlike_texts_links_each_text_for_itself(spark, monkeypatch, direct):
    """Rows of one id whose texts differ keep the n-grams of their own text, whichever way a family goes."""
    monkeypatch.setattr(ngram_jaccard, "DIRECT", direct)
    draw = random.Random(23)
    base = [" ".join(draw.choice("abcdefgh") + str(draw.randrange(40)) for _ in range(60)) for _ in range(4)]
    near = lambda k, n: base[k] + " " + " ".join(f"x{n}{i}" for i in range(2))
    rows = [(1, base[0]), (2, base[0] + " tail"), (2, base[1]), (3, near(1, 3)), (4, base[2]), (4, base[3]), (4, base[3]), (5, near(3, 5)), (6, near(2, 6)), (7, near(3, 7)), (8, near(1, 8))]
    grams = [set(zip(t.split(), t.split()[1:], t.split()[2:])) for _, t in rows]
    component = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if 100 * len(grams[i] & grams[j]) >= 90 * len(grams[i] | grams[j]):
                    component[i] = component[j] = min(component[i], component[j])
    least = {c: min(rows[i][0] for i in range(len(rows)) if component[i] == c) for c in component}
    expected = sorted((i, len(grams[n]), least[component[n]]) for n, (i, _) in enumerate(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, ngram_jaccard.join_components(df, size=3, percent=90).collect())) == expected
