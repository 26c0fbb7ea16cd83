"""Operator 13: importance resampling towards a target distribution, from suffix arrays over word ids.

A task takes its texts in blocks of bounded size. Words get ids from a dictionary of the block, and a suffix array puts all
positions in the order of the words that follow, up to the longest n-gram. Neighbours in that order that share n words or more
form runs, and each run is one n-gram: it is hashed once, counts as often as the run is long, and its bucket is
scattered back to where the run's suffixes stand.

The first pass adds up occurrences by bucket, over all documents and all target texts; a task sends one row for each bucket.
Sums of logarithmic gains over the buckets of a document, found the same way in the second pass, are its weight. A Gumbel draw
from the hash of the id is added, and the highest scores among documents of enough words are drawn: exactly, by the number of
each row along the order of scores, over ranges of that order.

Words are runs of bytes that are neither ASCII punctuation, space nor control characters; A-Z are lower-cased, nothing else. Null
texts have no words; a document without features weighs 0. A null id draws as the text ``<seed>:`` and ties after all others.
Repeated rows draw alike and take a place each. An empty table gives an empty result; without target texts all gains are of
the counts of documents alone. Only the named columns are read. The driver and tasks hold one number for each bucket, of
which there are ``buckets`` at any size of input.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sampleworks.llm._shared import written
from sampleworks.llm._words import LOWER, blocks
from sampleworks.operators.ranges import row_numbers

BUCKETS = 10_000
BLOCK = 1 << 21
#: ASCII but for digits and letters stands between words
SEPARATORS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def word_ids(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Ids of all words in order, the words they stand for, and the number of words before each text (one entry more)."""
    inside = ~SEPARATORS[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    begin = np.flatnonzero(inside & (first[:-1] | np.concatenate(([True], ~inside[:-1]))))
    if not len(begin):
        return np.zeros(0, np.int32), [], np.zeros(len(offsets), np.int64)
    letters = LOWER[data[inside]]
    ends = np.append(np.cumsum(inside)[begin] - 1, len(letters)).astype(np.int32)
    coded = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(ends), pa.py_buffer(letters)]).dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary.to_pylist(), np.searchsorted(begin, offsets)


def suffix_order(ids: np.ndarray, edges: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions in the order of the next ``longest`` words, what each shares with the one before it (words, up to
    ``longest``), and how many words it has to the end of its text (up to ``longest``), both in that order."""
    n = len(ids)
    left = np.minimum(np.repeat(edges[1:], np.diff(edges)) - np.arange(n), longest)
    columns = [ids]
    for i in range(1, longest):
        ahead = np.full(n, -1, ids.dtype)
        ahead[: max(n - i, 0)] = ids[i:]
        ahead[left <= i] = -1
        columns.append(ahead)
    order = np.argsort(ids, kind="stable") if longest == 1 else np.lexsort(columns[::-1])
    common = np.zeros(n, np.int64)
    alike = np.ones(max(n - 1, 0), bool)
    for column in columns:
        placed = column[order]
        alike = alike & (placed[1:] == placed[:-1]) & (placed[1:] >= 0)
        common[1:] += alike
    return order, common, left[order]


def ngram_runs(ids: np.ndarray, words: list[bytes], edges: np.ndarray, shortest: int, longest: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length of n-gram: bucket of each run, its length, and the positions of all runs one after the other."""
    order, common, left = suffix_order(ids, edges, longest)
    for n in range(shortest, longest + 1):
        long_enough = left >= n
        starts = long_enough & (common < n)
        placed = order[long_enough]
        begin = np.flatnonzero(starts[long_enough])
        size = np.diff(np.append(begin, len(placed)))
        first = placed[begin]
        if n == 1:
            hashes = [zlib.crc32(words[i]) for i in ids[first].tolist()]
        else:
            hashes = [zlib.crc32(b" ".join([words[i] for i in ids[at : at + n].tolist()])) for at in first.tolist()]
        yield np.array(hashes, np.int64) % buckets, size, placed


def bucket_counts(texts: DataFrame, text_col: str, *, shortest: int = 1, longest: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """Occurrences of features by bucket over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, offsets in blocks(batch.column(0), BLOCK):
                for bucket, size, _ in ngram_runs(*word_ids(data, offsets), shortest, longest, buckets):
                    total += np.bincount(bucket, size, buckets).astype(np.int64)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    found = texts.select(F.col(text_col).cast("string")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    total = np.zeros(buckets, np.int64)
    for row in found.collect():  # one row for each bucket
        total[row.bucket] = row.n
    return total


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of target over raw frequency of each bucket, each bucket counted once more, rounded down."""
    buckets, s, t = len(raw), float(raw.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((float(b) + 1) * (s + buckets) / ((float(a) + 1) * (t + buckets)))) for a, b in zip(raw.tolist(), target.tolist())], np.int64)


def weigh(df: DataFrame, gain: np.ndarray, *, shortest: int = 1, longest: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_words, n_features, weight`` of every document."""
    names = ["id", "n_words", "n_features", "weight"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in blocks(batch.column(1), BLOCK):
                ids, words, edges = word_ids(data, offsets)
                value, number = np.zeros(len(ids) + 1, np.int64), np.zeros(len(ids) + 1, np.int64)
                for bucket, size, placed in ngram_runs(ids, words, edges, shortest, longest, len(gain)):
                    value[placed + 1] += np.repeat(gain[bucket], size)
                    number[placed + 1] += 1
                value, number = np.cumsum(value)[edges], np.cumsum(number)[edges]
                columns = [batch.column(0).slice(first, last - first), *(pa.array(np.diff(x).astype(np.int64)) for x in (edges, number, value))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), *(T.StructField(n, T.LongType()) for n in names[1:])])
    return df.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, schema)


def resample(
    df: DataFrame,
    target: DataFrame,
    *,
    percent: int = 10,
    least_words: int = 20,
    shortest: int = 1,
    longest: int = 1,
    buckets: int = BUCKETS,
    seed: int = 2024,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
) -> DataFrame:
    """``id_col, n_features, weight, score, rank`` of every document; ``rank`` counts the drawn ones from 1."""
    sizes = {"shortest": shortest, "longest": longest}
    gain = gains(bucket_counts(df, text_col, buckets=buckets, **sizes), bucket_counts(target, target_col, buckets=buckets, **sizes))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")
    scored = weigh(df, gain, id_col=id_col, text_col=text_col, **sizes).withColumn("score", F.col("weight") + noise)
    scored = written(scored.withColumn("u", F.monotonically_increasing_id()), "scored")
    enough = F.col("n_words") >= least_words
    drawn = percent * scored.filter(enough).count() // 100
    placed = row_numbers(scored.filter(enough), [F.desc("score"), F.asc_nulls_last("id"), "u"], "place")
    columns = [F.col("id").alias(id_col), "n_features", "weight", "score"]
    ranked = placed.select(*columns, F.when(F.col("place") < drawn, F.col("place") + 1).alias("rank"))
    return ranked.unionByName(scored.filter(~enough).select(*columns, F.lit(None).cast("long").alias("rank")))
