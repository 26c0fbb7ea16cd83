"""Operator 3: quality by importance resampling.

Two generative models of hashed n-grams, runs of ``BYTES`` bytes and pairs of neighbouring words, are counted:
the raw model over the whole text of every document, the target model over labelled documents of good quality.
The importance weight of a document is the ratio of its probabilities under the two, so its logarithm is the sum of the
log-ratios of all its n-grams, divided by ``temperature``. A sample of k documents without replacement, in
proportion to weight, is drawn by the Gumbel top-k trick: the k largest sums of log-weight and Gumbel noise. The
noise is a hash of the id, so a lost task draws the same. ``k`` is the number of documents whose weight passes
the cut that separates the labelled documents best, or a share of all if ``share`` is given. At temperature 1 the draw
decides among documents within a few units of the kth key only, since sums over whole texts spread over thousands; a
higher temperature makes it decide more.

The target model and the cut are fitted on ``FIT_DOCUMENTS`` labelled rows of each quality at most (the smallest
hashes of ids): the model where crc32(id as text) mod 5 is 1 to 3, the cut where it is 4, so on texts that the
model hasn't counted as good. Everything else covers all documents. The kth key is found by
counting keys in ever narrower intervals, never by sorting all of them in one place; equal keys go by id.

A null, empty or very short text has no n-grams and the log-weight 0. Repeated rows have equal keys, and are kept or
rejected together; k may then be exceeded. Rows with a null id draw the same noise. Without labels of both
qualities every document is kept. Only the named columns are read; ``resample`` returns all columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sampleworks.llm._shared import giving_back, small_batches, written
from sampleworks.llm._words import WEIGHTS, blocks, mix, word_hashes

BYTES = 4
BUCKETS = 1 << 16
TEMPERATURE = 1.0
LOSS = 12  # a rejected good document costs as much as so many kept bad ones
FIT_DOCUMENTS = 20_000
SEED = 20_240_601
IDENTITY = np.arange(256, dtype=np.uint8)


def ngrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams in a block of texts, and the text of each."""
    n = len(data)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    if n >= BYTES:
        code = np.zeros(n - BYTES + 1, np.uint32)
        for i in range(BYTES):
            code = code * np.uint32(0x9E3779B1) + data[i : n - BYTES + 1 + i].astype(np.uint32) + np.uint32(1)
        code = (code ^ (code >> np.uint32(15))) * np.uint32(0x85EBCA77)
        whole = owner[: n - BYTES + 1] == owner[BYTES - 1 :]
        first, first_owner = (code >> np.uint32(16)).astype(np.int64)[whole], owner[: n - BYTES + 1][whole]
    else:
        first = first_owner = np.zeros(0, np.int64)
    words, counts = word_hashes(data, offsets, fold=IDENTITY)
    word_owner = np.repeat(np.arange(len(offsets) - 1), np.diff(counts))
    if len(words) > 1:
        pair = (mix(words[:-1] * WEIGHTS[0] + words[1:]) >> np.uint64(48)).astype(np.int64) + BUCKETS
        whole = word_owner[:-1] == word_owner[1:]
        second, second_owner = pair[whole], word_owner[:-1][whole]
    else:
        second = second_owner = np.zeros(0, np.int64)
    return np.concatenate((first, second)), np.concatenate((first_owner, second_owner))


def _fit_rows(labels: DataFrame, id_col: str, remainders: tuple[int, ...]) -> DataFrame:
    known = labels.select(F.col(id_col).alias("id"), F.col("quality").cast("int").alias("quality")).filter(F.col("id").isNotNull() & F.col("quality").isin(0, 1))
    known = known.filter((F.crc32(F.col("id").cast("string").cast("binary")) % 5).isin(*remainders)).distinct()
    parts = [known.filter(F.col("quality") == q).orderBy(F.xxhash64("id"), "id").limit(FIT_DOCUMENTS) for q in (0, 1)]
    return parts[0].union(parts[1])  # 2 * FIT_DOCUMENTS rows at most


def log_ratios(df: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> np.ndarray:
    """log p(bucket | target) - log p(bucket | raw) of every bucket, from counts over all documents."""

    @giving_back
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, 2 * BUCKETS), np.int64)
        for batch in batches:
            target = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for first, last, data, offsets in blocks(batch.column(0)):
                bucket, owner = ngrams(data, offsets)
                totals[0] += np.bincount(bucket, minlength=2 * BUCKETS)
                totals[1] += np.bincount(bucket[target[first:last][owner]], minlength=2 * BUCKETS)
        held = np.flatnonzero(totals[0])
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), *(pa.array(t[held]) for t in totals)], names=["bucket", "raw", "good"])

    target = F.broadcast(_fit_rows(labels, id_col, (1, 2, 3)).filter("quality = 1").select("id", F.lit(True).alias("target")))
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(target, "id", "left").select("text", F.coalesce("target", F.lit(False)).alias("target"))
    # added up row by row, whatever the number of tasks; what comes back is a row for each bucket
    with small_batches(df.sparkSession):
        summed = rows.mapInArrow(count, "bucket int, raw long, good long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).toArrow()
    totals = np.zeros((2, 2 * BUCKETS))
    totals[:, summed.column("bucket").to_numpy()] = summed.column("raw").to_numpy(), summed.column("good").to_numpy()
    raw, good = totals
    ratio = np.zeros(2 * BUCKETS)
    for part in (slice(0, BUCKETS), slice(BUCKETS, None)):
        n, m = raw[part].sum(), good[part].sum()
        if n and m:
            # the target model is smoothed by the raw one
            p = (raw[part] + 0.5) / (n + 0.5 * BUCKETS)
            q = (good[part] + 5.0 * p * BUCKETS) / (m + 5.0 * BUCKETS)
            ratio[part] = np.log(q / p)
    return ratio


def _free(name: str, taken: list[str]) -> str:
    """A column name that no column of a frame has, in any case of letters."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def _weighted(df: DataFrame, ratio: np.ndarray, text_col: str, name: str, temperature: float) -> DataFrame:
    """All columns of ``df`` and the log-weight as ``name``."""
    told = df.sparkSession.sparkContext.broadcast(ratio / temperature)
    at = df.columns.index(text_col)

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights = [np.zeros(0)]
            for first, last, data, offsets in blocks(batch.column(at)):
                bucket, owner = ngrams(data, offsets)
                weights.append(np.bincount(owner, told.value[bucket], minlength=last - first))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(weights))], names=[*batch.schema.names, name])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())]))


def gumbel(id_col: Column) -> Column:
    """Gumbel noise from the hash of an id."""
    uniform = (F.pmod(F.xxhash64(F.lit(SEED), id_col), F.lit(1 << 40)).cast("double") + 0.5) / (1 << 40)
    return -F.log(-F.log(uniform))


def best_cut(good: np.ndarray, bad: np.ndarray) -> float:
    """The log-weight that separates best; see ``LOSS``."""
    values = np.sort(np.concatenate((good, bad)))
    cuts = np.concatenate(([values[0] - 1], (values[1:] + values[:-1]) / 2))
    lost = np.searchsorted(np.sort(good), cuts) / max(len(good), 1)
    kept = 1 - np.searchsorted(np.sort(bad), cuts) / max(len(bad), 1)
    best = LOSS * lost + kept
    flat = cuts[best <= best.min() + 1e-12]
    return float(flat[len(flat) // 2])


def kth_largest(keys: DataFrame, column: str, k: int, bins: int = 2048) -> float:
    """The kth largest value, by counting in ever narrower intervals."""
    low, high = keys.agg(F.min(column), F.max(column)).first()
    if low is None or k <= 0:
        return float("inf")
    inside, wanted = keys, k
    for _ in range(8):
        if high <= low:
            return low
        width = (high - low) / bins
        bin_of = F.least(F.lit(bins - 1), F.floor((F.col(column) - low) / width)).cast("int")
        cells = {r.bin: r for r in inside.groupBy(bin_of.alias("bin")).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect()}
        for b in sorted(cells, reverse=True):
            if wanted <= cells[b].n:
                low, high = cells[b].low, cells[b].high
                inside = inside.filter(F.col(column).between(low, high))
                break
            wanted -= cells[b].n
        else:
            return low
    return low


def _keyed(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, share: float | None, temperature: float) -> tuple[np.ndarray, float]:
    """The ratios, and the kth key: documents with that key or more are kept."""
    ratio = log_ratios(df, labels, id_col, text_col)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    weights = _weighted(rows, ratio, "text", "w", temperature)
    keys = written(weights.select("id", "w", (F.col("w") + gumbel(F.col("id"))).alias("key")), "keys")
    if share is not None:
        k = round(share * keys.count())
    else:
        told = keys.join(F.broadcast(_fit_rows(labels, id_col, (4,))), "id").select("w", "quality").toPandas()  # a bounded sample
        good, bad = (told.loc[told["quality"] == q, "w"].to_numpy() for q in (1, 0))
        if not len(good) or not len(bad):
            return ratio, float("-inf")
        k = keys.filter(F.col("w") >= best_cut(good, bad)).count()
    return ratio, kth_largest(keys, "key", k)


def weigh(df: DataFrame, labels: DataFrame, *, share: float | None = None, temperature: float = TEMPERATURE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, log_weight, key, kept`` for every document."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    ratio, least = _keyed(rows, labels.withColumnRenamed(id_col, "id"), "id", "text", share, temperature)
    found = _weighted(rows, ratio, "text", "w", temperature).withColumn("key", F.col("w") + gumbel(F.col("id")))
    return found.select(F.col("id").alias(id_col), F.col("w").alias("log_weight"), "key", (F.col("key") >= least).alias("kept"))


def resample(df: DataFrame, labels: DataFrame, *, share: float | None = None, temperature: float = TEMPERATURE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that are kept, with their columns."""
    ratio, least = _keyed(df.select(id_col, text_col), labels, id_col, text_col, share, temperature)
    weight = _free("log_weight", df.columns)
    kept = _weighted(df, ratio, text_col, weight, temperature).filter(F.col(weight) + gumbel(F.col(id_col)) >= least)
    return kept.drop(weight)
