"""Operator 8: toxicity by class-conditional Kneser-Ney models.

Two bigram models, of toxic and of ordinary texts, share what they back off to: the continuation counts (different
words before a word) in all documents, labelled or not. A word or pair that is as frequent in a class as
anywhere therefore says little, and one that many contexts in toxic texts have, and few in ordinary ones, says much. A
word's evidence is the difference of its two log-probabilities, without and with the word before it.

The length-normalised difference of log-likelihoods, a text's mean evidence, isn't enough: a few toxic words in a long
text don't move its mean (held-out AUC at sf0.1: 0.61 with pairs, 0.72 with words, 6 and 7 % of toxic texts found).
So it is one of several measures: beside it stands the strongest evidence for toxic at each level of support (how often
toxic texts hold the word or pair, in powers of two), which no length dilutes. A logistic function turns them into a
probability.

Labels come only from rows whose crc32(id as text) mod 5 isn't 0. Remainders 1 to 3 fit the language models,
remainder 4 fits the logistic function on texts that the models haven't seen. Either fit uses every labelled text, whole, and
every document is scored, over its whole text. The models are of bounded size all the same, as their words are
hashed: a word is one of ``WORDS`` numbers, the word before one of ``HEADS``, and the counts of a pair of these stand in one of
``SLOTS`` places. What falls together is counted together, nothing is left out. How many different pairs a word or a word before
has is counted over the pairs of numbers, before they share places. Equal texts count once and a pair counts once for each text. Words and
pairs are discounted by D1, D2 and D3+ of modified Kneser-Ney smoothing, from the counts of counts of their class,
so what is discounted doesn't grow with the sample; how far each level of support is to be believed, chance words
among them, is left to the logistic fit.

A null, empty or wordless text has no evidence, and the score of evidence 0. Without labels of both classes
every score is the share of toxic labels, 0 if there are none. Repeated rows have equal scores; of repeated labels
each counts. Null labels and labels of absent documents are left out. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sampleworks.llm._shared import discard, packed, unpacked, written
from sampleworks.llm._words import LOWER, blocks, mix, word_hashes

FIT_DOCUMENTS = {1: 4_000, 0: 12_000}  # of toxic and of ordinary texts that _fit_rows gives, which no fit uses
FIT_BYTES = {1: 64 << 20, 0: 192 << 20}  # of their texts, in the same order
WORDS, HEADS, SLOTS = 1 << 22, 1 << 19, 1 << 24  # numbers of words, of words before, and places of pairs
RANGES = 16  # groups in which the counts of words, words before and places are added up
LABEL_ROWS = 1_000_000  # labels are broadcast up to so many, and shuffled beyond
LEVELS = 8  # of support: 0 or 1, 2 and 3, 4 to 7 ... 128 and more
ALPHA = 0.5
FIT_PARTS = 256  # groups in which pairs are counted, at least
PART_BYTES = 1 << 25  # of text for each group in which the pairs of all documents are counted
FREQUENT = 2_000  # a word with one in so many of the contexts of the fitted texts is dealt by word and neighbour
HELD_KEYS = 1 << 22  # distinct pairs that a task folds before it sends them
SEPARATORS = np.ones(256, bool)
SEPARATORS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False


def remainder(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % 5


def _pairs(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """First and last row, and text, word before (0 for none) and word for each pair."""
    for first, last, data, offsets in blocks(column):
        hashes, counts = word_hashes(data, offsets, SEPARATORS, LOWER)
        before = np.concatenate((np.zeros(1, np.uint64), hashes[:-1])) if len(hashes) else hashes
        before[counts[:-1][counts[:-1] < len(hashes)]] = 0
        yield first, last, np.repeat(np.arange(last - first), np.diff(counts)), before, hashes


def _word(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(42)).astype(np.int64)


def _head(before: np.ndarray) -> np.ndarray:
    """The number of a word before, by other bits than a word's own; ``HEADS`` for none."""
    return np.where(before == 0, HEADS, before & np.uint64(HEADS - 1)).astype(np.int64)


def _slot(keys: np.ndarray) -> np.ndarray:
    """The place of the counts of a pair: word << 32 | word before."""
    return (mix(keys) >> np.uint64(40)).astype(np.int64)


@dataclass
class Models:
    """What gives log-probabilities under either class, by the numbers of words and the places of pairs."""

    word_p: np.ndarray  # words x 2
    word_level: np.ndarray  # level of support of each word; -1 for one that no fitted text holds
    head_back: np.ndarray  # words before x 2: mass left to the word model after a word
    head_sum: np.ndarray  # words before x 2: pairs that begin with a word
    pair_kind: np.ndarray  # row of kinds for each place
    kinds: np.ndarray  # the distinct counts x 2: texts of either class with a pair
    of_pairs: np.ndarray  # 2 x discounts

    def __getstate__(self) -> dict[str, tuple]:
        return {name: (packed(values), values.dtype.str, values.shape) for name, values in self.__dict__.items()}

    def __setstate__(self, state: dict[str, tuple]) -> None:
        self.__dict__.update({name: unpacked(*values) for name, values in state.items()})

    def probabilities(self, before: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """p(word) and p(word | word before), each x 2, with the support of word and pair in toxic texts; 0 before a first word."""
        word, head = _word(hashes), _head(before)
        alone, levels = self.word_p[word].astype(float), self.word_level[word]
        sums = self.head_sum[head]
        c = self.kinds[self.pair_kind[_slot(word.astype(np.uint64) << np.uint64(32) | head.astype(np.uint64))]]
        # no pair is in more texts than all pairs of its word before, and an unknown word has none
        c = np.where((levels >= 0)[:, None], np.minimum(c, sums), 0)
        kept = np.stack([c[:, k] - self.of_pairs[k][np.minimum(c[:, k], 3)] for k in (0, 1)], axis=1)
        paired = kept / np.maximum(sums, 1) + self.head_back[head] * alone
        return alone, paired, np.maximum(levels, 0), level(c[:, 0])

    def evidence(self, hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """log p(word | toxic) - log p(word | ordinary) for each word, alone and after its neighbour, with the levels of support of either; ``starts`` marks first words of texts."""
        before = np.concatenate((np.zeros(1, np.uint64), hashes[:-1]))
        alone, paired, levels, pair_levels = self.probabilities(np.where(starts, np.uint64(0), before), hashes)
        ratio = lambda p: np.log(p[:, 0]) - np.log(p[:, 1])
        return ratio(alone), levels, ratio(paired), pair_levels


def level(support: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(support, 1)), LEVELS - 1).astype(np.int8)


def features(models: Models, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Mean evidence of each text, and the strongest of its words and of its pairs at each level of support."""
    n = len(counts) - 1
    found = np.zeros((n, 1 + 2 * LEVELS))
    if not len(hashes):
        return found
    starts = np.zeros(len(hashes) + 1, bool)
    starts[counts[:-1]] = True
    alone, levels, paired, pair_levels = models.evidence(hashes, starts[:-1])
    text = np.repeat(np.arange(n), np.diff(counts))
    found[:, 0] = np.bincount(text, paired, n) / np.maximum(np.diff(counts), 1)
    np.maximum.at(found, (text, 1 + levels), alone)
    np.maximum.at(found, (text, 1 + LEVELS + pair_levels), paired)
    return found


def discounts(ones: int, twos: int, threes: int, fours: int) -> np.ndarray:
    """What counts of 0, 1, 2 and 3 or more lose, from how many counts are 1, 2, 3 and 4; count k keeps at least a tenth of itself."""
    n = [float(ones), float(twos), float(threes), float(fours)]
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.75
    found = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] and n[k] else y * k for k in (1, 2, 3)]
    return np.array([0.0, *(min(max(d, 0.1), 0.9 * k) for k, d in enumerate(found, 1))])


def _fit_rows(df: DataFrame, labels: DataFrame, keep: Column, id_col: str, text_col: str) -> DataFrame:
    """Texts and labels of a bounded sample of labelled rows, for trials by hand: the smallest hashes of ids in each class. No fit uses it."""
    known = labels.select(F.col(id_col).alias("id"), F.col("toxic").cast("int").alias("toxic")).filter(F.col("id").isNotNull() & F.col("toxic").isin(0, 1)).filter(keep)
    parts = [known.filter(F.col("toxic") == c).orderBy(F.xxhash64("id"), "id").limit(FIT_DOCUMENTS[c]) for c in (0, 1)]
    chosen = parts[0].union(parts[1])
    found = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")  # as many rows as FIT_DOCUMENTS says, at most
    upto = F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(Window.partitionBy("toxic").orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, 0))
    within = F.when(F.col("toxic") == 1, F.lit(FIT_BYTES[1])).otherwise(F.lit(FIT_BYTES[0]))
    return found.withColumn("upto", upto).filter(F.col("upto") <= within).select("text", "toxic")


def _labelled(df: DataFrame, labels: DataFrame, keep: Column, id_col: str, text_col: str) -> DataFrame:
    """Text and label of every labelled row."""
    known = labels.select(F.col(id_col).alias("id"), F.col("toxic").cast("int").alias("toxic")).filter(F.col("id").isNotNull() & F.col("toxic").isin(0, 1)).filter(keep)
    if known.count() <= LABEL_ROWS:
        known = F.broadcast(known)
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(known, "id").select("text", "toxic")


def _times(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


def _parted(keys: np.ndarray, parts: int, frequent: np.ndarray | None = None) -> pa.RecordBatch:
    """Distinct keys by part: that of their upper half, a place, which packs well. Keys of ``frequent`` places are dealt by word and
    neighbour, so their contexts are spread over all parts."""
    place = keys >> np.uint64(32)
    part = (place % np.uint64(parts)).astype(np.int32)
    if frequent is not None:
        spread = frequent[place.astype(np.int64)]
        part[spread] = (mix(keys[spread]) % np.uint64(parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    there, at = np.unique(part[order], return_index=True)
    blobs = [packed(k) for k in np.split(keys[order], at[1:])] if len(there) else []
    return pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "keys"])


def language_models(df: DataFrame, rows: DataFrame, text_col: str = "text") -> Models | None:
    """The two models of ``rows`` (``text``, ``toxic``) with the backoff counts of all ``df``; None where a class has no pair."""
    context = df.sparkSession.sparkContext
    size = df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    many = max(FIT_PARTS, size // PART_BYTES)

    def flush(held: dict[int, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for c, found in held.items():
            keys, times = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            part = _slot(keys) * many // SLOTS
            order = np.argsort(part, kind="stable")
            there, at = np.unique(part[order], return_index=True)
            split = lambda values: [packed(v) for v in np.split(values[order], at[1:])] if len(there) else []
            found.clear()
            yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array([c] * len(there), pa.int32()), pa.array(split(keys), pa.binary()), pa.array(split(times.astype("<u4")), pa.binary())], names=["part", "toxic", "keys", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {1: [], 0: []}
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False)
            for first, last, text, before, hashes in _pairs(batch.column(0)):
                # a pair once for each text: the text of the block, 22 bits of the word and 20 of the one before
                once = np.unique(text.astype(np.uint64) << np.uint64(42) | _word(hashes).astype(np.uint64) << np.uint64(20) | _head(before).astype(np.uint64))
                label = toxic[first:last][(once >> np.uint64(42)).astype(np.int64)]
                keys = (once >> np.uint64(20) & np.uint64(WORDS - 1)) << np.uint64(32) | once & np.uint64((1 << 20) - 1)
                for c in held:
                    held[c].append(keys[label == c])
            if sum(len(k) for found in held.values() for k in found) > HELD_KEYS:
                yield from flush(held)
        yield from flush(held)

    def ranged(kind: int, at: np.ndarray, values: np.ndarray, top: int) -> Iterator[tuple[int, int, bytes, bytes]]:
        """Sums of ``values`` for each number of ``at`` below ``top``, by range of numbers."""
        order = np.argsort(at, kind="stable")
        own, begin = np.unique(at[order], return_index=True)
        sums = np.add.reduceat(values[order], begin, axis=0) if len(own) else values
        where, first = np.unique(own * RANGES // top, return_index=True)
        for r, low, high in zip(where.tolist(), first.tolist(), [*first[1:].tolist(), len(own)]):
            yield kind, r, packed(own[low:high].astype("<u4")), packed(sums[low:high].astype("<u8").reshape(-1))

    def merge(_: tuple, table: pa.Table) -> pa.Table:
        toxic = table.column("toxic").to_numpy()
        keys = [unpacked(k.as_buffer()) for k in table.column("keys")]
        n = np.concatenate([unpacked(k.as_buffer(), "<u4") for k in table.column("n")])
        merged, of = np.unique(np.concatenate(keys), return_inverse=True)
        label = np.repeat(toxic, [len(k) for k in keys])
        c = np.stack([np.bincount(of[label == k], n[label == k], len(merged)) for k in (1, 0)], axis=1).astype(np.int64)
        word, head = (merged >> np.uint64(32)).astype(np.int64), (merged & np.uint64(2**32 - 1)).astype(np.int64)
        led = head < HEADS  # others are first words of texts
        of_heads = np.concatenate([c[led], *(c[led] == t for t in (1, 2)), c[led] >= 3], axis=1)
        whole = np.concatenate([[(c == t).sum(axis=0) for t in (1, 2, 3, 4)], [(c > 0).sum(axis=0)]]).reshape(1, -1)
        rows = [*ranged(0, _slot(merged[led]), c[led], SLOTS), *ranged(1, word, (c > 0).astype(np.int64), WORDS), *ranged(2, head[led], of_heads, HEADS), *ranged(3, np.zeros(1, np.int64), whole, 1)]
        return pa.table([pa.array(v, k) for v, k in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["kind", "range", "at", "v"])

    def add(key: tuple, table: pa.Table) -> pa.Table:
        kind = key[0].as_py()
        at = [unpacked(k.as_buffer(), "<u4") for k in table.column("at")]
        width = (2, 2, 8, 10)[kind]
        values = np.concatenate([unpacked(k.as_buffer(), "<u8", (-1, width)) for k in table.column("v")])
        rows = list(ranged(kind, np.concatenate(at).astype(np.int64), values, (SLOTS, WORDS, HEADS, 1)[kind]))
        return pa.table([pa.array(v, k) for v, k in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["kind", "range", "at", "v"])

    shape = "kind int, range int, at binary, v binary"
    sums = rows.mapInArrow(count, "part int, toxic int, keys binary, n binary").groupBy("part").applyInArrow(merge, shape)
    sums = sums.groupBy("kind", "range").applyInArrow(add, shape).toArrow()  # a row for each range of each kind, of WORDS, HEADS and SLOTS counts at most
    kind = sums.column("kind").to_numpy()

    def of_kind(k: int, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for i in np.flatnonzero(kind == k).tolist():
            yield unpacked(sums.column("at")[i].as_buffer(), "<u4"), unpacked(sums.column("v")[i].as_buffer(), "<u8", (-1, width)).astype(np.int64)

    times, total = np.zeros((2, 4), np.int64), np.zeros(2, np.int64)
    for _, v in of_kind(3, 10):
        v = v.reshape(5, 2)
        times, total = v[:4].T, v[4]
    if not total.all():
        return None
    of_pairs = [discounts(*times[k].tolist()) for k in (0, 1)]
    own = np.zeros((WORDS, 2), np.int32)
    for at, v in of_kind(1, 2):
        own[at] = v
    # no word before stands at the end: nothing begins with it, and all mass is left to the word model
    head_sum, head_back = np.zeros((HEADS + 1, 2), np.int64), np.ones((HEADS + 1, 2), np.float32)
    for at, v in of_kind(2, 8):
        head_sum[at] = v[:, :2]
        for k in (0, 1):
            lost = sum(of_pairs[k][t] * v[:, 2 * t + k] for t in (1, 2, 3))
            head_back[at, k] = np.where(v[:, k] > 0, lost / np.maximum(v[:, k], 1), 1.0)
    both = np.zeros(1, np.uint64)
    for _, v in of_kind(0, 2):
        both = np.union1d(both, v[:, 0].astype(np.uint64) << np.uint64(32) | v[:, 1].astype(np.uint64))
    pair_kind = np.zeros(SLOTS, np.uint16 if len(both) < 1 << 16 else np.uint32)  # kind 0: no text
    for at, v in of_kind(0, 2):
        pair_kind[at] = np.searchsorted(both, v[:, 0].astype(np.uint64) << np.uint64(32) | v[:, 1].astype(np.uint64))
    kinds = np.stack((both >> np.uint64(32), both & np.uint64(2**32 - 1)), axis=1).astype(np.int64)
    del sums

    # words with much of the contexts of the fitted texts: decided once, so that every task deals a key alike
    contexts_of = own.sum(axis=1, dtype=np.int64)
    seen = contexts_of > 0
    known, frequent = context.broadcast(seen), context.broadcast(contexts_of * FREQUENT >= max(contexts_of.sum(), 1))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held, folded = [np.zeros(0, np.uint64)], 0, 0
        for batch in batches:
            for _, _, _, before, hashes in _pairs(batch.column(0)):
                at = _word(hashes)
                fits = known.value[at]
                found.append(np.unique((at[fits].astype(np.uint64) << np.uint64(32)) | (mix(before[fits]) >> np.uint64(32))))
                held += len(found[-1])
                if held > 2 * folded + HELD_KEYS // 4:
                    found = [np.unique(np.concatenate(found))]
                    held = folded = len(found[0])
                if folded > HELD_KEYS:
                    yield _parted(found[0], many, frequent.value)
                    found, held, folded = [np.zeros(0, np.uint64)], 0, 0
        yield _parted(np.unique(np.concatenate(found)), many, frequent.value)

    def distinct(_: tuple, table: pa.Table) -> pa.Table:
        merged = np.unique(np.concatenate([unpacked(k.as_buffer()) for k in table.column("keys")]))
        place, times = np.unique(merged >> np.uint64(32), return_counts=True)
        return pa.table({"place": pa.array(place.astype(np.int32)), "n": pa.array(times.astype(np.int64))})

    everywhere = df.select(F.col(text_col).alias("text")).filter("text IS NOT NULL").mapInArrow(contexts, "part int, keys binary").groupBy("part").applyInArrow(distinct, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()  # a row for each of WORDS numbers at most
    known.unpersist()
    frequent.unpersist()
    pool = np.zeros(WORDS)
    pool[everywhere.column("place").to_numpy()] = everywhere.column("n").to_numpy()
    del everywhere
    among = pool.sum() + ALPHA * seen.sum()
    word_p = np.zeros((WORDS, 2), np.float32)
    for k in (0, 1):
        of_words = discounts(*_times(own[:, k]))
        taken = of_words[np.minimum(own[:, k], 3)]
        left = taken.sum() / total[k]
        word_p[:, k] = np.where(seen, (own[:, k] - taken) / total[k] + left * (pool + ALPHA) / among, left * (1 + ALPHA) / among)
    return Models(
        word_p=word_p,
        word_level=np.where(seen, level(own[:, 0]), -1).astype(np.int8),
        head_back=head_back,
        head_sum=head_sum,
        pair_kind=pair_kind,
        kinds=kinds,
        of_pairs=np.stack(of_pairs),
    )


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[Broadcast[Models], np.ndarray] | float:
    """The two models, sent out once, and the logistic weights, or the share of toxic labels where a class has none."""
    part = remainder(F.col("id"))
    rows = _labelled(df, labels, part.isin(1, 2, 3), id_col, text_col).filter("text IS NOT NULL").dropDuplicates(["text", "toxic"])
    models = language_models(df, rows, text_col)
    if models is None:
        share = labels.filter(remainder(F.col(id_col)) != 0).agg(F.avg(F.col("toxic").cast("double"))).first()[0]
        return float(share or 0.0)
    told = df.sparkSession.sparkContext.broadcast(models)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(told.value, *word_hashes(data, offsets, SEPARATORS, LOWER)) for _, _, data, offsets in blocks(batch.column(0))]
            x = np.concatenate(found) if found else np.zeros((0, 1 + 2 * LEVELS))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(list(x), pa.list_(pa.float64()))], names=["toxic", "x"])

    held = written(_labelled(df, labels, part == 4, id_col, text_col).mapInArrow(measure, "toxic int, x array<double>"), "measures")
    weights = logistic(held, 1 + 2 * LEVELS)
    discard(held)
    return told, weights


def logistic(rows: DataFrame, width: int, rounds: int = 40) -> np.ndarray:
    """Weights of (1, x) for ``rows`` (``toxic``, ``x``) by Newton's method with a small ridge; each round adds up the derivatives of all
    rows, and a row for each task reaches the driver. Weights may be negative: measures of neighbouring levels correct each
    other, and without negative ones fewer held-out texts are told apart."""
    w, ridge = np.zeros(width + 1), np.diag([1e-3, *[1e-1] * width])

    def derivatives(w: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((width + 1, width + 2))
            for batch in batches:
                x = np.concatenate((np.ones((batch.num_rows, 1)), batch.column(1).flatten().to_numpy().reshape(-1, width)), axis=1)
                p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
                total[:, :-1] += (x * (p * (1 - p))[:, None]).T @ x
                total[:, -1] += x.T @ (batch.column(0).to_numpy() - p)
            yield pa.RecordBatch.from_arrays([pa.array([total.reshape(-1)], pa.list_(pa.float64()))], names=["d"])

        return run

    for _ in range(rounds):
        parts = rows.mapInArrow(derivatives(w), "d array<double>").toArrow().column("d").to_pylist()
        total = np.sum([np.zeros((width + 1) * (width + 2)), *parts], axis=0).reshape(width + 1, width + 2)
        step = np.linalg.solve(total[:, :-1] + ridge, total[:, -1] - ridge @ w)
        w = w + step * min(1.0, 5 / max(float(np.abs(step).max()), 1e-12))
        if float(np.abs(step).max()) < 1e-9:
            break
    return w


def score(df: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, held_out, score, predicted`` for every document."""
    kind = df.schema[id_col].dataType
    fitted = fit(df, labels, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if isinstance(fitted, float):
                scores = np.full(batch.num_rows, fitted)
            else:
                told, w = fitted
                found = [features(told.value, *word_hashes(data, offsets, SEPARATORS, LOWER)) for _, _, data, offsets in blocks(batch.column(1))]
                x = np.concatenate(found) if found else np.zeros((0, 1 + 2 * LEVELS))
                scores = 1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=[id_col, "score"])

    scored = df.select(id_col, text_col).mapInArrow(run, T.StructType([T.StructField(id_col, kind), T.StructField("score", T.DoubleType())]))
    held_out = F.coalesce(remainder(F.col(id_col)) == 0, F.lit(False))
    return scored.select(id_col, held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
