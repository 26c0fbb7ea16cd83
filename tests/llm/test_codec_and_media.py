"""Operators 1, 5 and 6 against the libraries they must agree with."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from sampleworks.llm import media_columns, packing, sentencepiece_codec
from sampleworks.llm.queries import tokenizer

ODD = [None, "", " ", "  two  spaces ", "\n\ttabs\r\n", "▁mark", "日本語𝒳", "<s> </s> <0x0A>", "a_b_c ²x", "x" * 5000, "é" * 300, "\x00 nul", "don't we'll 's", "ÀÉ ßſ", "İI Σς", "a <|endoftext|> b", "<|startoftext|><|ENDOFTEXT|>", "A" * 70 + " " * 90]


def texts():
    draw = random.Random(3)
    letters = "ab the▁ \n\t\réÉñ日𝒳_²'s.,!?0123456789-" + "".join(chr(draw.randrange(33, 0x3000)) for _ in range(60))
    return ODD + ["".join(draw.choice(letters) for _ in range(draw.randrange(60))) for _ in range(400)]


@pytest.fixture(scope="module")
def rows():
    return [(i, t) for i, t in enumerate(texts())] + [(3, "repeated id")]


def test_codec_equals_library(spark, rows):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS n_tokens").repartition(3)
    found = sorted(map(tuple, sentencepiece_codec.encode_digests(df, tokenizer("piece_bpe_32k.model")).collect()))
    wanted = []
    for i, t in rows:
        ids = model.encode(t or "", add_eos=True)
        wanted.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(model.decode(ids).encode()).hexdigest()))
    assert found == sorted(wanted)
    back = sentencepiece_codec.decode(sentencepiece_codec.encode(df, tokenizer("piece_bpe_32k.model")), tokenizer("piece_bpe_32k.model"))
    assert sorted(map(tuple, back.collect())) == sorted((i, model.decode(model.encode(t or ""))) for i, t in rows)


def library_ids(text):
    """Little-endian ids of a tokenizer that nothing else has touched."""
    from tokenizers import Tokenizer

    global LIBRARY
    LIBRARY = LIBRARY or Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    return np.array(LIBRARY.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


LIBRARY = None


def test_word_ids_equal_library(monkeypatch):
    own = packing.word_tokenizer(tokenizer("word_bpe_49k.json"))
    assert own.alike
    for t in texts():
        assert own.ids(t or "") == library_ids(t), t
    monkeypatch.setattr(packing.WordTokenizer, "WORD", __import__("re").compile("[a-z]+"))
    other = packing.WordTokenizer(tokenizer("word_bpe_49k.json"))
    assert not other.alike and other.ids("It's 12") == library_ids("It's 12")


def test_packing_is_whole_and_tight(spark, rows):
    long = [(5000 + i, "many words here " * n) for i, n in enumerate((900, 1366, 2000, 3000))]
    df = spark.createDataFrame(rows + long, "doc_id long, text string").repartition(3)
    found = packing.pack_documents(df, tokenizer("word_bpe_49k.json")).collect()
    wanted = []
    for i, t in rows + long:
        ids = library_ids(t) + (1).to_bytes(4, "little")
        wanted += [(i, p, a // 4, len(ids[a : a + 16384]) // 4, zlib.crc32(ids[a : a + 16384])) for p, a in enumerate(range(0, len(ids), 16384))]
    assert sorted(tuple(r)[:5] for r in found) == sorted(wanted)
    by = {}
    for r in found:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        parts.sort()
        assert [a for a, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        assert sum(n for _, n in parts) <= 4096
    total = sum(r.length for r in found)
    assert len(by) <= -(-total // 4096) + 1


def test_local_search_empties_bins():
    lengths = np.array([50, 30, 20, 60, 25, 15])
    assert sorted(map(sorted, packing.local_search([[0, 1], [3, 4], [2, 5]], lengths, 100))) == [[0, 1, 2], [3, 4, 5]]
    # one for one: 40 and 35 change places, which makes room for the rest
    assert len(packing.local_search([[0, 1], [2], [3]], np.array([60, 35, 40, 65]), 100)) == 2
    # two for one, in a bin of many pieces: 30 ones and two of 20 change places with 41, until the bin is empty
    many = np.array([20, 20, *[1] * 30, 41, 55, 30])
    assert len(packing.local_search([list(range(32)), [32, 33], [34]], many, 100)) == 2
    draw = np.random.RandomState(1)
    for _ in range(50):
        lengths = draw.randint(1, 100, 40)
        bins = [[int(i) for i in part] for part in np.array_split(np.arange(40), 40)]
        found = packing.local_search(bins, lengths, 100)
        assert sorted(i for b in found for i in b) == list(range(40)) and all(lengths[b].sum() <= 100 for b in found)
        assert len(found) <= len(packing.best_fit(lengths, 100)) + 6


def test_rounds_of_packing_end(spark):
    found = spark.range(600).selectExpr("id", "0 AS piece", "0L AS start", "CASE WHEN id % 3 = 0 THEN 1L ELSE 37L END AS length", "0L AS ids_crc32", "id AS deal")
    packed = packing.pack(found, capacity=100, group=32).collect()
    by = {}
    for r in packed:
        by[r.sequence_id] = by.get(r.sequence_id, 0) + r.length
    assert len(packed) == 600 and max(by.values()) <= 100 and len(by) <= 206


def test_media_round_trip(spark, rows):
    found = {(r.doc_id, r.n_bytes): r for r in media_columns.media_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        raw = (t or "").encode()
        r = found[i, len(raw)]
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        media = media_columns.to_wav(payload)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        assert media_columns.from_wav(media) == payload
    assert len({found[0, 0].feature, found[1, 0].feature}) == 1


def test_fingerprint_equals_plain_transform(monkeypatch):
    draw = np.random.RandomState(4)
    tone = (128 + 60 * np.sin(2 * np.pi * 37 * np.arange(576) / 576) + 30 * np.sin(2 * np.pi * 90 * np.arange(576) / 576)).astype(np.uint8)
    samples = np.concatenate((tone, draw.randint(0, 256, 576 * 4).astype(np.uint8), np.full(576, 255, np.uint8), tone[::-1]))
    frames = samples.reshape(-1, 576).astype(float) - 128
    k, n = np.arange(1, 289)[:, None], np.arange(576)[None, :]
    basis = np.exp(-2j * np.pi * k * n / 576)
    strongest = []
    for frame in frames:
        power = np.round(np.abs(basis @ (frame * np.hanning(576))), 1)
        strongest.append([int(b) + 1 for b in np.lexsort((np.arange(288), -power))[:2]])
    wanted = [t << 24 | a << 10 | b for t, (a, b) in enumerate(strongest)]
    wanted += [t << 24 | d << 20 | strongest[t][0] << 10 | strongest[t + d][p] for d in (1, 2) for p in (0, 1) for t in range(len(frames) - d)]
    assert strongest[0][0] == 37
    assert media_columns.fingerprint(samples.tobytes()).tolist() == sorted(wanted)
    monkeypatch.setattr(media_columns, "BLOCK", 2)
    assert media_columns.fingerprint(samples.tobytes()).tolist() == sorted(wanted)


def test_fingerprint_is_the_same_in_blocks(monkeypatch):
    data = bytes(random.Random(1).randrange(256) for _ in range(576 * 40))
    whole = media_columns.fingerprint(data)
    for block in (1, 7, 40):
        monkeypatch.setattr(media_columns, "BLOCK", block)
        assert media_columns.fingerprint(data).tolist() == whole.tolist()
    assert (np.diff(whole >> 24) >= 0).all() and whole[-1] >> 24 == 39


@pytest.mark.parametrize("run", [lambda df: sentencepiece_codec.encode_digests(df, tokenizer("piece_bpe_32k.model")), media_columns.media_digests, lambda df: packing.pack_documents(df, tokenizer("word_bpe_49k.json"))])
def test_empty_table(spark, run):
    assert run(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_new_words_are_encoded_without_the_library():
    """Words that no memo holds yet get the library's ids, but don't pay for a call of it each; very long ones still do."""
    import random

    draw, own = random.Random(8), packing.WordTokenizer(tokenizer("word_bpe_49k.json"))
    common = [chr(c) for c in range(0x180) if own.COMMON.fullmatch(chr(c)) and not chr(c).isspace()]
    made = ["".join(draw.choice(pool) for _ in range(draw.randrange(1, 25))) for pool in ("aaab", "etaoinshrdlu", "éèüßøñaeiou", "!?.,-'\"", common) for _ in range(3000)]
    made += ["a" * n for n in range(1, 300, 7)] + ["abc" * 200, "", "it's", "'s's", "0123 45"]
    library, through = own.tokenizer, []

    class Counted:
        def encode_batch_fast(self, words, **more):
            through.extend(words)
            return library.encode_batch_fast(words, **more)

    own.tokenizer = Counted()
    for at in range(0, len(made), 100):
        text = " ".join(made[at : at + 100])
        assert own.COMMON.fullmatch(text)
        assert own.ids(text) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text
    assert own.memo and all(len(w) > packing.LONG_WORD for w in through)


def test_words_whose_merges_depend_on_their_way_go_through_the_library():
    """``abc`` is listed as ab + c, but b and c are put together before: only the library would leave a + bc apart."""
    assert packing.last_pairs_are_listed([("a", "b"), ("ab", "c"), ("ab", "c</w>")])
    assert not packing.last_pairs_are_listed([("b", "c"), ("a", "b"), ("ab", "c")])
