"""Weighted, shuffled and repeated samples, and projections of embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sampleworks.functions.values import is_finite


def _uniform(seed: int, *keys: str | Column) -> Column:
    """A number between 0 and 1 that seed and keys decide."""
    return (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 40)).cast("double") + 0.5) / (1 << 40)


def weighted(df: DataFrame, n: int, *, weight: str = "weight", row: str = "_row", seed: int = 0) -> DataFrame:
    """``n`` rows without replacement, in proportion to weight; weight 0 is never drawn."""
    return df.filter(F.col(weight) > 0).orderBy(-F.log(_uniform(seed, row)) / F.col(weight), row).limit(n)


def weighted_with_replacement(df: DataFrame, n: int | None = None, *, weight: str = "weight", row: str = "_row", seed: int = 0, stretch: int = 65_536, cells: int = 4096) -> DataFrame:
    """``n`` independent draws (as many as there are rows of positive weight, if null), numbered by ``draw``.

    Rows own stretches of the sum of weights, in order of ``row``; a draw is a point of it. Both are dealt to ``cells`` equal
    pieces of the sum, so points meet only the rows there.
    """
    some = df.filter(F.col(weight) > 0).withColumn("__stretch", F.floor(F.col(row) / stretch))
    inside = F.sum(weight).over(Window.partitionBy("__stretch").orderBy(row).rowsBetween(Window.unboundedPreceding, 0))
    sums = some.groupBy("__stretch").agg(F.sum(weight).alias("__sum"), F.count("*").alias("__rows"))
    before = sums.select("__stretch", (F.sum("__sum").over(Window.orderBy("__stretch")) - F.col("__sum")).alias("__before"))  # a row for each stretch
    total, rows = sums.agg(F.sum("__sum"), F.sum("__rows")).first()
    if not total:
        return df.limit(0).withColumn("draw", F.lit(0).cast("long"))
    cell = lambda at: F.least(F.floor(at / total * cells), F.lit(cells - 1))
    placed = some.withColumn("__high", inside).join(before, "__stretch").withColumn("__high", F.col("__high") + F.col("__before")).withColumn("__low", F.col("__high") - F.col(weight))
    placed = placed.withColumn("__cell", F.explode(F.sequence(cell(F.col("__low")), cell(F.col("__high")))))
    draws = df.sparkSession.range(rows if n is None else n).select(F.col("id").alias("draw"), (_uniform(seed, "id") * total).alias("__at")).withColumn("__cell", cell(F.col("__at")))
    met = draws.join(placed, "__cell").filter((F.col("__at") >= F.col("__low")) & (F.col("__at") < F.col("__high")))
    return met.select(*df.columns, "draw")


def repeated(df: DataFrame, *, weight: str = "weight", row: str = "_row", seed: int = 0) -> DataFrame:
    """floor(w) copies of a row and one more by chance of the fraction, with ``copy`` from 1."""
    whole = F.floor(weight)
    n = (whole + (_uniform(seed, row) < F.col(weight) - whole).cast("int")).cast("int")
    return df.withColumn("__n", n).filter("__n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__n")))).drop("__n")


def shuffled(df: DataFrame, *, row: str = "_row", seed: int = 0) -> DataFrame:
    """Rows in an order that a seed decides."""
    return df.orderBy(F.xxhash64(F.lit(seed), row), row)


def subset(df: DataFrame, probability: float = 1.0, *, low: float = 0.0, high: float = 1.0, row: str = "_row", seed: int = 0) -> DataFrame:
    """A range of positions, each kept by chance."""
    n = df.count()
    kept = df.filter(F.col(row).between(int(n * low), int(n * high) - 1))
    return kept if probability >= 1 else kept.filter(_uniform(seed, row) < probability)


def principal_axes(df: DataFrame, vector: str, k: int = 3) -> tuple[list[float], list[list[float]]]:
    """Mean and ``k`` principal axes, signs fixed by the largest component, axes of zero beyond the rank.

    Sums and products of components are added up in tasks; the driver gets one matrix of the width of the vectors.
    """
    import numpy as np
    import pandas as pd

    def moments(frames):
        total, products, n = 0.0, 0.0, 0
        for frame in frames:
            if len(frame):
                x = np.stack(frame[vector].map(lambda v: np.asarray(v, float)).to_list())
                total, products, n = total + x.sum(0), products + x.T @ x, n + len(x)
        if n:
            yield pd.DataFrame({"n": [n], "total": [list(total)], "products": [list(np.ravel(products))]})

    parts = df.select(vector).mapInPandas(moments, "n long, total array<double>, products array<double>").collect()
    if not parts:
        raise ValueError("no vectors")
    n, total = sum(p.n for p in parts), np.sum([p.total for p in parts], axis=0)
    mean = total / n
    spread = np.sum([p.products for p in parts], axis=0).reshape(len(mean), -1) - n * np.outer(mean, mean)
    values, vectors = np.linalg.eigh(spread)
    axes = []
    for i in np.argsort(-values)[:k]:
        axis = vectors[:, i] * np.sign(vectors[np.abs(vectors[:, i]).argmax(), i]) if values[i] > 1e-9 else np.zeros(len(mean))
        axes.append(axis.tolist())
    axes += [[0.0] * len(mean)] * (k - len(axes))
    return mean.tolist(), axes


def projected(df: DataFrame, vector: str, mean: list[float], axes: list[list[float]], prefix: str = "projection") -> DataFrame:
    """``<prefix>_x, _y, _z``: coordinates along the axes."""
    centred = F.zip_with(F.col(vector).cast("array<double>"), F.array(*map(F.lit, mean)), lambda a, b: a - b)
    along = lambda axis: F.aggregate(F.zip_with(centred, F.array(*map(F.lit, axis)), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return df.withColumns({f"{prefix}_{n}": along(axis).cast("float") for n, axis in zip("xyz", axes)})


def bootstrap_interval(df: DataFrame, value: str, *, draws: int = 500, row: str = "_row", seed: int = 0) -> DataFrame:
    """``mean, low, high``: 2.5 and 97.5 per cent of the means of :func:`bootstrap_means`."""
    means = bootstrap_means(df, value, draws=draws, row=row, seed=seed)
    return means.agg(F.avg("m").alias("mean"), F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))


def bootstrap_means(df: DataFrame, value: str, *, draws: int = 500, row: str = "_row", seed: int = 0) -> DataFrame:
    """``draw, m``: Poisson bootstrap means. A task returns two sums for each sample; rows stay where they are, and a row's
    number of draws follows from its id. Values that aren't finite take no part."""

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, draws))
        for frame in frames:
            for low in range(0, len(frame), 1024):
                part = frame.iloc[low : low + 1024]
                weight = poisson_draws(part["k"].to_numpy().astype(np.uint64), draws)
                total += np.stack(((weight * part["v"].to_numpy()[:, None]).sum(axis=0), weight.sum(axis=0)))
        yield pd.DataFrame({"draw": range(draws), "total": total[0], "n": total[1]})

    rows = df.filter(is_finite(F.col(value))).select(F.col(value).cast("double").alias("v"), F.xxhash64(F.lit(seed), row).alias("k"))
    return rows.mapInPandas(sums, "draw int, total double, n double").groupBy("draw").agg((F.sum("total") / F.nullif(F.sum("n"), F.lit(0.0))).alias("m"))


# how probable at most 0, 1, 2 ... draws are
_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod(np.concatenate(([1.0], np.arange(1.0, 20.0)))))


def poisson_draws(keys: np.ndarray, draws: int) -> np.ndarray:
    """How often each key is drawn in each of ``draws`` samples: Poisson numbers of mean 1 that key and sample decide."""
    x = keys[:, None] + np.arange(1, draws + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    uniform = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2**53
    return np.searchsorted(_POISSON, uniform, "right")
