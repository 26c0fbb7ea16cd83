"""Operator 9: sums and overlaps along a text, redaction and the classifier, against plain loops."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from sampleworks.llm import pii


@pytest.mark.parametrize("stretch", [1, 3, 128])
def test_running_sums(spark, monkeypatch, stretch):
    monkeypatch.setattr(pii, "STRETCH", stretch)
    draw = random.Random(1)
    rows = [(i, [draw.randrange(50) for _ in range(n)]) for i, n in enumerate((0, 1, 2, 3, 4, 7, 40))]
    df = spark.createDataFrame(rows, "i int, v array<int>")
    found = pii._running(pii._running(df, {"s": F.col("v")}, 0, lambda a, b: a + b), {"m": F.col("v")}, 0, lambda a, b: F.greatest(a, b))
    for r in found.collect():
        assert r.s == [sum(r.v[: k + 1]) for k in range(len(r.v))] and r.m == [max(r.v[: k + 1]) for k in range(len(r.v))]


def test_candidates_apart_from_base_spans(spark, monkeypatch):
    monkeypatch.setattr(pii, "STRETCH", 4)
    draw = random.Random(5)
    some = lambda n, base: [(draw.randrange(4), a, a + draw.randrange(1, 12), base, "c") for a in sorted(draw.randrange(120) for _ in range(n))]
    rows = [(i, some(draw.randrange(8), True), some(draw.randrange(8), False)) for i in range(120)]
    df = spark.createDataFrame(rows, f"i int, base_spans {pii.SPAN}, more_spans {pii.SPAN}")
    found = pii._with_added(pii._apart(df), ["c"])
    for r in found.collect():
        base, more = rows[r.i][1:]
        free = [m for m in more if not any(m[1] < b[2] and b[1] < m[2] for b in base)]
        assert sorted(tuple(m) for m in r.more_spans) == sorted(free)
        kept, reach = [], 0
        for m in sorted(free, key=lambda m: (m[1], -m[2])):
            if m[1] >= reach:
                kept.append((m[1], m[2]))
            reach = max(reach, m[2])
        assert sorted((m["start"], m["end"]) for m in r.added) == sorted(kept)


def test_redaction_over_pieces(spark, monkeypatch):
    monkeypatch.setattr(pii, "PIECE", 7)
    draw = random.Random(2)
    rows = [(i, "".join(draw.choice(["a@b.co", "word ", "é𝒳 ", "1.2.3.4", " ", "4111 1111 1111 1111"]) + draw.choice([" ", ", ", "\n"]) for _ in range(draw.randrange(12)))) for i in range(120)]
    found = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        plain = re.sub(r"4111 1111 1111 1111", "<CARD>", re.sub(r"1\.2\.3\.4", "<IP>", re.sub(r"a@b\.co", "<EMAIL>", text)))
        assert found[i] == plain or "<CARD>" in plain


def test_many_spans_in_one_text(spark):
    text = " ".join(f"user{i}@mail{i % 7}.com and" for i in range(5000))
    row = pii.find_spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.n_email == 5000 and row.spans.startswith("email:0:15,email:20:35,") and row.spans.count(",") == 4999


def test_votes_against_count():
    """Labelers that deny a candidate outweigh one that is for it, and features carry over to votes that weren't seen often."""
    counts = {"secret base.long.some.even.quoted +++": 5, "secret long.some.even.quoted +++": 80, "secret long.some.even.word +--": 60, "secret long.few.mixed.word 0--": 60, "secret long.some.even.quoted +0+": 2}
    found = pii.classifier(counts)
    assert found["secret long.some.even.quoted +0+"] > 0.9 and found["secret long.some.even.word +--"] < 0.1 and found["secret long.few.mixed.word 0--"] < 0.1
