"""Places where an operator once did less than its whole job."""

from __future__ import annotations

import random

import numpy as np

from sampleworks.llm import packing, suffix_dedup, toxicity
from sampleworks.llm.queries import tokenizer


def test_rare_toxic_words_are_learned(spark):
    """80 expressions, each in 1 to 2 % of toxic texts and in no others."""
    draw = random.Random(11)
    word = lambda: "".join(draw.choice("abcdeilmnorst") for _ in range(draw.randrange(3, 9)))
    common = [word() for _ in range(2000)]
    vile = [f"zz{word()}" for _ in range(80)]
    rows = []
    for i in range(9000):
        text = [draw.choice(common) for _ in range(draw.randrange(20, 60))]
        if i % 6 == 0:
            text.insert(draw.randrange(len(text)), draw.choice(vile))
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(9000)], "doc_id long, toxic int")
    held = [(r.doc_id % 6 == 0, r.predicted) for r in toxicity.score(docs, labels).filter("held_out").collect()]
    assert np.mean([p for toxic, p in held if toxic]) > 0.9 and np.mean([p for toxic, p in held if not toxic]) < 0.02


def test_discounts_do_not_grow_with_the_sample():
    small, large = (toxicity.discounts(*(k * n for n in (1000, 300, 120, 60))) for k in (1, 1000))
    assert np.allclose(small, large) and (small <= [0, 1, 2, 3]).all() and 0 < small[1] < 1
    assert (toxicity.discounts(0, 0, 0, 0)[1:] > 0).all() and (toxicity.discounts(5, 0, 0, 9)[1:] < [1, 2, 3]).all()


def test_added_tokens_are_encoded_as_the_file_says():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    own = packing.WordTokenizer(tokenizer("word_bpe_49k.json"))
    added = [t.content for t in library.get_added_tokens_decoder().values()]
    assert {"<|endoftext|>", "<|startoftext|>"} <= set(added)
    for token in added:
        for text in (token, f"hello {token} world", f"it's{token}{token}x", f"日本 {token}", token.upper(), f"{token[:-1]} >", "".join(added), "no token"):
            assert own.ids(text) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_hot_anchor_is_not_gathered(spark, monkeypatch):
    """One passage in every document, each time in other surroundings: no key holds a context for each document."""
    draw = random.Random(4)
    other = lambda: "".join(draw.choice("abcdefgh ") for _ in range(60))
    passage = "the hot passage that every one of the documents holds, word for word"
    texts = [(i, f"{other()}{passage}{other()}") for i in range(300)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    rows = df.selectExpr("doc_id AS doc", "0 AS t", "text")
    largest = lambda hot: max(r["count"] for r in suffix_dedup._candidates(rows, hot).filter("key IS NOT NULL").groupBy("key").count().collect())
    assert largest(50) <= 50 < 200 < largest(10_000)

    first, wanted = {}, {}
    for i, text in texts:
        gone = set()
        for k in range(len(text) - 49):
            if first.setdefault(text[k : k + 50], i) < i:
                gone.update(range(k, k + 50))
        wanted[i] = len(gone)
    for hot in (50, 10_000):
        monkeypatch.setattr(suffix_dedup, "HOT", hot)
        assert {r.doc_id: r.n_removed for r in suffix_dedup.removed(df).collect()} == wanted
