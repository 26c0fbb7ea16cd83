"""Operators 3, 8 and 9 and the pipeline: held-out accuracy, brute force, odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from sampleworks.llm import ngram_jaccard, pii, quality, toxicity
from sampleworks.llm._shared import giving_back, written

SF = "/root/testdata/sf0.001"


def corpus():
    """Ordinary prose, toxic prose and junk, with labels."""
    draw = random.Random(8)
    words = ["".join(draw.choice("abcdeilmnorst") for _ in range(draw.randrange(2, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(1200):
        text = [draw.choice(words) for _ in range(draw.randrange(20, 80))]
        toxic, junk = i % 6 == 0, i % 7 == 0
        for _ in range(4 if toxic else 0):
            text[draw.randrange(len(text))] = draw.choice(["vileword", "hateful", "nastyterm"])
        text = " ".join(f"{w}%%%" if junk else w for w in text)
        rows.append((i, text))
        labels.append((i, 0 if junk else 1, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def frames(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([*rows, (5000, None), (5001, ""), (5002, "w"), (None, "no id"), (1, "repeated id")], "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS id").repartition(4)
    return docs, spark.createDataFrame([*labels, (7777, 1, 0), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


def auc(good, bad):
    return float((np.array(good)[:, None] > np.array(bad)[None, :]).mean())


def test_toxicity_on_held_out_rows(frames):
    docs, labels = frames
    found = toxicity.score(docs, labels).collect()
    assert len(found) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)
    held = {r.doc_id: r.score for r in found if r.held_out}
    assert all(zlib.crc32(str(i).encode()) % 5 == 0 for i in held)
    toxic = [s for i, s in held.items() if i < 1200 and i % 6 == 0]
    clean = [s for i, s in held.items() if i < 1200 and i % 6]
    assert auc(toxic, clean) > 0.99
    assert toxicity.score(docs.limit(0), labels).count() == 0


def test_toxicity_without_one_class(frames):
    docs, labels = frames
    assert {r.score for r in toxicity.score(docs, labels.filter("toxic = 0")).collect()} == {0.0}


def test_quality_on_held_out_rows(frames):
    docs, labels = frames
    found = {r.doc_id: r for r in quality.weigh(docs, labels).collect()}
    held = [i for i in range(1200) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert auc([found[i].log_weight for i in held if i % 7], [found[i].log_weight for i in held if i % 7 == 0]) > 0.99
    assert np.mean([found[i].kept for i in held if i % 7]) > 0.97 and np.mean([found[i].kept for i in held if i % 7 == 0]) < 0.1
    kept = quality.resample(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in found.items() if r.kept}
    assert quality.weigh(docs.limit(0), labels).count() == 0
    assert quality.resample(docs, labels.filter("quality = 1")).count() == docs.count()


def test_share_is_a_top_k(frames, spark):
    docs, labels = frames
    found = quality.weigh(docs, labels, share=0.25).collect()
    order = sorted((r.key for r in found), reverse=True)
    assert sum(r.kept for r in found) == round(0.25 * len(found)) and all(r.kept == (r.key >= order[round(0.25 * len(found)) - 1]) for r in found)
    keys = spark.createDataFrame([(float(x),) for x in [1, 1, 1, 2, 5, 5, 9]], "key double")
    assert [quality.kth_largest(keys, "key", k, bins=2) for k in range(1, 8)] == [9, 5, 5, 2, 1, 1, 1]


BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def spans(text):
    found = []
    for kind, pattern in BASE:
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            doubled = [int(d) * (1 + i % 2) for i, d in enumerate(digits[::-1])]
            good = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m.group().split(".")), "card": 13 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in doubled) % 10 == 0, "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                found.append((kind, m.start(), m.end()))
    return found


def private_rows():
    draw = random.Random(3)
    parts = ["a@b.c", "_d@e.f", "1.2.3.4", "5.6", "255.255.255.256", "4111 1111 1111 1111", "+1 (443) 555-5793", "+", "-", " ", "é", "日", "\n", "x@y", "..", "12", "(555) 555-1212", "joe (at) foo (dot) com", 'token = "9f14a7029c8514dfe98aba92898d323168e199da"', "𝒳"]
    rows = [(i, "".join(draw.choice(parts) for _ in range(draw.randrange(25)))) for i in range(300)]
    return rows + [(9001, None), (9002, ""), (9003, "1 " * 20_000), (9004, "a" * 50_000), (9005, "4" * 50_000), (9006, "a@" * 20_000), (9008, "+1" + " " * 20_000), (5, "again a@b.c")]


def test_spans(spark):
    rows = private_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS base_spans", "2 AS n_email").repartition(3)
    found = sorted((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in pii.find_spans(df).collect())
    wanted, all_spans = [], {}
    for i, text in rows:
        base = spans(text) if i not in (9004,) else []
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        wanted.append((i, *[sum(k == kind for k, _, _ in base) for kind, _ in BASE], hashlib.sha256(joined.encode()).hexdigest()))
        all_spans.setdefault(i, []).append(joined)
    assert found == sorted(wanted)
    for r in pii.find_spans(df).collect():
        assert any(set(filter(None, j.split(","))) <= set(r.spans.split(",")) for j in all_spans[r.doc_id])
    assert pii.find_spans(df.limit(0)).count() == 0


def test_secret_is_added_and_redacted(spark):
    rows = [(i, f'say token = "9f14a7029c8514dfe98aba92898d3231{i:08d}" to +1 (443) 555-5793 now') for i in range(40)] + [(99, "plain words only"), (100, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.spans for r in pii.find_spans(df).collect()}
    assert found[3] == "phone:58:75,secret:13:53" and found[99] == ""
    redacted = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert redacted[3] == 'say token = "<SECRET>" to <PHONE> now' and redacted[99] == "plain words only" and redacted[100] is None


def test_em_trusts_labelers_that_agree():
    counts = {"phone base ++0": 50, "phone short ++0": 40, "phone short -00": 60, "phone short 00+": 1}
    found = pii.classifier(counts)
    assert found["phone short ++0"] > 0.9 > 0.1 > found["phone short -00"]


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()} if n else None
        docs = written(stage(spark, docs, SF), f"test-{name}")
        assert n == 4 or docs.columns == columns
        if name == "near_duplicates":
            kept = {r.doc_id for r in docs.collect()}
            sets = {}
            for i, t in before.items():
                w = t.encode().lower().split() if not re.search(r"[\x1c-\x1f\x85\xa0]", t) else re.findall(rb"[^\x20\x09-\x0D]+", t.encode().lower())
                sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
            pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
            assert all(b not in kept or a not in kept for a, b in pairs) and set(before) - kept <= {b for _, b in pairs}
        if name == "passages":
            first = {}
            for i in sorted(before):
                raw = before[i].encode()
                for k in range(len(raw) - 49):
                    first.setdefault(raw[k : k + 50], i)
            for r in docs.collect():
                raw, gone = before[r.doc_id].encode(), set()
                for k in range(len(raw) - 49):
                    if first[raw[k : k + 50]] < r.doc_id:
                        gone.update(range(k, k + 50))
                assert r.text == bytes(b for k, b in enumerate(raw) if k not in gone).decode(errors="ignore") and r.n_chars == len(r.text)
        if name == "personal_data":
            assert not any(spans(r.text) for r in docs.collect())
    assert docs.count() > 0


def test_pipeline_of_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), "nothing")
    assert docs.count() == 0


def test_texts_go_to_python_in_small_batches(spark, tmp_path, monkeypatch):
    limit, folder = "spark.sql.execution.arrow.maxBytesPerBatch", str(tmp_path)
    before, bare = spark.conf.get(limit, None), spark.conf.unset(limit)
    rows = spark.range(0, 6_000, 1, 1).selectExpr("id AS doc_id", "repeat(concat('word ', id, ' '), 300) AS text")  # some 20 MB in one partition
    known, sets = quality.blocks, ngram_jaccard._sets

    def told(name, column):
        with open(f"{folder}/{name}", "a") as file:
            file.write(f"{column.nbytes}\n")

    def spied_blocks(column):
        told("quality", column)
        yield from known(column)

    def spied_sets(batch, size, column=1):
        told("near", batch.column(column))
        yield from sets(batch, size, column)

    def largest(name):
        sizes = [int(x) for x in (tmp_path / name).read_text().split()]
        (tmp_path / name).unlink()
        assert sum(sizes) >= 15_000_000
        return max(sizes)

    monkeypatch.setattr(quality, "blocks", spied_blocks)
    monkeypatch.setattr(ngram_jaccard, "_sets", spied_sets)
    try:
        labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
        quality.log_ratios(rows, labels, "doc_id", "text")
        assert largest("quality") < 9_000_000
        ngram_jaccard.rarity(rows, 5, "text")
        assert largest("near") < 9_000_000 and spark.conf.get(limit, None) is None
        labels.write.parquet(f"{folder}/labels.parquet")
        # the last pass runs when the caller asks for the rows
        kept = corpus_pipeline.keep_quality(spark, rows, folder)
        kept.write.format("noop").mode("overwrite").save()
        assert largest("quality") < 3_000_000
    finally:
        spark.conf.set(limit, before) if bare is None and before is not None else spark.conf.unset(limit)


def test_workers_give_memory_back():
    pinned = []

    def resident():
        with open("/proc/self/statm") as file:
            return int(file.read().split()[1]) * 4096

    @giving_back
    def run(batches):
        for batch in batches:
            held = [np.ones(100_000, np.uint8) for _ in range(3_000)]
            pinned.append(np.ones(100_000, np.uint8))  # lies after the others, so the heap can't shrink by itself
            del held
            yield batch

    before = resident()
    assert list(run(iter([1, 2]))) == [1, 2]
    assert resident() - before < 100_000_000
