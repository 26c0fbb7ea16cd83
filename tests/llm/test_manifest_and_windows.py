"""Operators 11 to 13 against plain versions of themselves."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from sampleworks.llm import concat_packing, merkle, target_resampling
from sampleworks.llm._words import text_bytes

SCHEMA = "doc_id long, source string, lang string, n_chars int, text string, tree int, pos string, level int, id int"


def _h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _leaf(row: tuple) -> str:
    return _h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def _levels(leaves: list[str]) -> list[list[str]]:
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([_h("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def _siblings(levels: list[list[str]], place: int) -> list[tuple[str, str]]:
    out = []
    for level in levels[:-1]:
        low = place // 16 * 16
        out.append(("".join(level[low:place]), "".join(level[place + 1 : low + 16])))
        place //= 16
    return out


def _plain_manifest(rows: list[tuple]) -> list[tuple]:
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    trees: dict[str | None, list[tuple]] = {}
    for row in rows:
        trees.setdefault(row[1], []).append(row)
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = {}
    for s in order:
        leaves = sorted(((r[0] is not None, r[0] or 0, _leaf(r), r) for r in trees[s]), key=lambda x: x[:3])
        built[s] = [x[3] for x in leaves], _levels([x[2] for x in leaves])
    top = _levels([built[s][1][-1][0] for s in order])
    out = []
    for number, s in enumerate(order):
        own, levels = built[s]
        for place, row in enumerate(own):
            way = _siblings(levels, place) + _siblings(top, number)
            digest = levels[0][place]
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[4] is not None:
                digest = _leaf((*row[:4], row[4].translate(upper)))
            for left, right in way:
                digest = _h(left + digest + right)
            out.append((row[0], levels[0][place], levels[-1][0], top[-1][0], _h("".join(a + b for a, b in way)), digest, digest == top[-1][0]))
    return out


def _rows(n: int, seed: int = 3) -> list[tuple]:
    draw = random.Random(seed)
    out = [(i, draw.choice(["hot"] * 6 + ["é", "z", "A", "", None]), draw.choice(["en", None]), draw.choice([None, i]), draw.choice([None, "", f"Text {i} Ünï", "x" * 50 + "Q"])) for i in range(n)]
    out += [(None, "hot", "en", 1, "No id"), (None, None, None, None, None), (5, "hot", "en", 2, "again"), (5, "hot", "en", 2, "again"), (-7, "lone", "en", 3, "Lone leaf")]
    return out


def _with_extras(spark, rows):
    return spark.createDataFrame([(*r, 1, "p", 2, 3) for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("n", [0, 1, 40, 700])
def test_manifest_equals_plain_trees(spark, n):
    rows = _rows(n) if n > 1 else _rows(1)[:n]
    found = merkle.manifest(_with_extras(spark, rows))
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, _plain_manifest(rows)))


def test_manifest_of_trees_above_one_block(spark):
    """More than 4,096 leaves in one source: paths come from a stage above, and runs are cut by tasks."""
    rows = [(i, "hot" if i % 7 else f"s{i % 40}", "en", i, f"T{i}") for i in range(5200)]
    found = merkle.manifest(_with_extras(spark, rows))
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, _plain_manifest(rows)))
    assert {r.verified for r in found.filter("pmod(crc32(cast(cast(doc_id as string) as binary)), 5) <> 0").collect()} == {True}


def test_manifest_with_as_many_sources_as_rows(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BROADCAST_ROWS", 10)
    rows = [(i, f"s{i % 90}", "en", i, f"T{i}") for i in range(300)]
    assert sorted(map(repr, map(tuple, merkle.manifest(_with_extras(spark, rows)).collect()))) == sorted(map(repr, _plain_manifest(rows)))


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    return path, Tokenizer.from_file(path)


TEXTS = ["", None, "Hello world", "a <|endoftext|> b", "日本語 text", "\t\n  x  \n", "don't we'LL", "Été ſ İ ʼn", "1²3½ 100,000", "a b c", "word " * 3000, "\x1c\x85 \x00", "é" * 40, "🙂🙂 ok"]


def test_ids_equal_the_library(tokenizer):
    path, library = tokenizer
    own = concat_packing.byte_tokenizer(path)
    assert own.fast is not None
    for text in TEXTS:
        assert own.ids(text or "").tolist() == library.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("capacity", [1024, 16])
def test_windows_hold_every_id_once(spark, tokenizer, capacity):
    path, library = tokenizer
    draw = random.Random(capacity)
    rows = [(i, " ".join(draw.choice(["alpha", "beta", "Gamma,", "x"]) for _ in range(draw.randrange(300)))) for i in range(60)] + [(100 + i, t) for i, t in enumerate(TEXTS)] + [(None, "no id")]
    found = concat_packing.concatenate(spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, part int, before int").repartition(5), path, capacity=capacity).collect()
    by_doc: dict = {}
    for r in found:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert len(by_doc) == len(rows)
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        at = 0
        for piece in sorted(by_doc[doc_id], key=lambda r: r.start):
            assert (piece.start, piece.doc_tokens) == (at, len(ids))
            assert piece.ids_crc32 == zlib.crc32(np.array(ids[at : at + piece.length], "<u4").tobytes())
            at += piece.length
        assert at == len(ids)
    sequences: dict = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    total = sum(r.length for r in found)
    lengths = []
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        lengths.append(at)
    assert Counter(lengths)[capacity] == total // capacity
    rest = [n for n in lengths if n != capacity]
    assert sum(rest) == total % capacity and all(n & (n - 1) == 0 for n in rest) and len(set(rest)) == len(rest)


def test_windows_of_an_empty_table(spark, tokenizer):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert concat_packing.concatenate(empty, tokenizer[0]).collect() == []


def _features(text: str | None, shortest: int, longest: int) -> tuple[int, list[str]]:
    lowered = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    return len(words), [" ".join(words[i : i + n]) for n in range(shortest, longest + 1) for i in range(len(words) - n + 1)]


@pytest.mark.parametrize(("shortest", "longest"), [(1, 1), (1, 3), (2, 2)])
def test_resampling_equals_plain_counting(spark, shortest, longest):
    draw = random.Random(5)
    pool = ["Alpha", "beta", "ÉTÉ", "été", "g7", "日本", "d'accord", "x", "naïve-word", "\x00odd\x7f"]
    rows = [(i, " ".join(draw.choice(pool) for _ in range(draw.randrange(60)))) for i in range(150)]
    rows += [(7, rows[7][1]), (None, " ".join(pool * 4)), (200, None), (201, ""), (202, "... !!"), (203, "w " * 5000), (204, "one")]
    target = [(1, "alpha beta beta ÉTÉ g7"), (2, None), (3, "日本 naïve word alpha beta")]
    buckets, counts = 97, []
    for texts in ([t for _, t in rows], [t for _, t in target]):
        counts.append(Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in _features(t, shortest, longest)[1]))
    s, t = (float(c.total()) for c in counts)
    gain = [math.floor(1000 * math.log((counts[1][b] + 1) * (s + buckets) / ((counts[0][b] + 1) * (t + buckets)))) for b in range(buckets)]
    expected = []
    for doc_id, text in rows:
        n, features = _features(text, shortest, longest)
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] for f in features)
        h = int(_h(f"2024:{'' if doc_id is None else doc_id}")[:8], 16)
        expected.append([doc_id, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    enough = sorted((e for e in expected if e[5] >= 20), key=lambda e: (-e[3], e[0] is None, e[0]))
    for place, e in enumerate(enough[: 40 * len(enough) // 100]):
        e[4] = place + 1
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, score int, u int, place int").repartition(4)
    found = target_resampling.resample(docs, spark.createDataFrame(target, "item_id long, text string"), percent=40, shortest=shortest, longest=longest, buckets=buckets)
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(repr(tuple(e[:5])) for e in expected)


def test_resampling_without_rows_or_targets(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    target = spark.createDataFrame([], "item_id long, text string")
    assert target_resampling.resample(docs, target).collect() == []
    one = spark.createDataFrame([(1, "a b " * 20)], "doc_id long, text string")
    assert [(r.n_features, r["rank"]) for r in target_resampling.resample(one, target, percent=100).collect()] == [(40, 1)]


def test_suffix_order_is_that_of_word_sequences():
    import pyarrow as pa

    data, offsets = text_bytes(pa.array(["b a b a", "a b", "", "b a b"]))
    ids, words, edges = target_resampling.word_ids(data, offsets)
    order, common, left = target_resampling.suffix_order(ids, edges, 3)
    text_of = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    window = [tuple(ids[i : min(i + 3, edges[text_of[i] + 1])]) for i in range(len(ids))]
    assert [window[i] for i in order] == sorted(window)
    for k in range(1, len(order)):
        a, b = window[order[k - 1]], window[order[k]]
        assert common[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    assert left.tolist() == [len(window[i]) for i in order]
    assert words == [b"b", b"a"]
