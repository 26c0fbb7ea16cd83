"""Projections of embeddings: a two-dimensional map by a randomised range finder, and fitted axes that are kept in a file.

Tasks add up products of bounded size: the driver gets matrices of the width of the vectors by a few columns, never rows. A
vector that is null takes no part and has no place; vectors have one length. Signs of axes are fixed by their largest component.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sampleworks.operators.sampling import principal_axes, projected
from sampleworks.sources.commits import claimed

COLUMNS = 8  # of the random sketch
FORMAT = 1


class ReducerError(ValueError):
    """A reducer that can't be fitted, applied or read."""


def _stacked(frame: pd.DataFrame, vector: str) -> np.ndarray:
    return np.stack([np.asarray(v, float) for v in frame[vector]])


def _moments(df: DataFrame, vector: str) -> tuple[int, np.ndarray]:
    """Number and mean of vectors."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = 0, 0.0
        for frame in frames:
            if len(frame):
                n, total = n + len(frame), total + _stacked(frame, vector).sum(axis=0)
        if n:
            yield pd.DataFrame({"n": [n], "total": [list(total)]})

    parts = df.select(vector).mapInPandas(run, "n long, total array<double>")
    summed = parts.select("n", F.posexplode("total").alias("i", "x")).groupBy("i").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).orderBy("i").collect()  # a row for each component
    return (summed[0].n, np.array([r.x for r in summed]) / summed[0].n) if summed else (0, np.zeros(0))


def _fixed(axes: np.ndarray) -> np.ndarray:
    signs = np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])
    return axes * np.where(signs == 0, 1, signs)[:, None]


def sketched_axes(df: DataFrame, vector: str, k: int = 2, *, seed: int = 0, columns: int = COLUMNS) -> tuple[np.ndarray, np.ndarray]:
    """Mean and ``k`` leading axes from one random sketch of ``columns`` columns.

    The sketch Y of the centred rows X is never put together: with Q an orthonormal basis of Y, Q'X follows from Y'Y and Y'X,
    which are sums over tasks. Exact where the rank is at most ``columns``.
    """
    rows = df.select(vector).filter(F.col(vector).isNotNull())
    n, mean = _moments(rows, vector)
    if not n:
        raise ReducerError("no vectors")
    chance = np.random.default_rng(seed).normal(size=(len(mean), columns)).astype(np.float32).astype(float)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((columns, columns + len(mean)))
        for frame in frames:
            if len(frame):
                x = _stacked(frame, vector) - mean
                y = x @ chance
                total += np.concatenate((y.T @ y, y.T @ x), axis=1)
        yield pd.DataFrame({"i": range(columns), "row": list(total)})

    parts = rows.mapInPandas(run, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "x"))
    summed = parts.groupBy("i", "j").agg(F.sum("x").alias("x")).toPandas()  # columns x (columns + width) numbers
    total = np.zeros((columns, columns + len(mean)))
    total[summed["i"], summed["j"]] = summed["x"]
    values, vectors = np.linalg.eigh(total[:, :columns])
    real = values > values.max(initial=0) * 1e-12
    small = (vectors[:, real] / np.sqrt(values[real])).T @ total[:, columns:]
    _, weight, axes = np.linalg.svd(small, full_matrices=False)
    axes = axes[weight > 1e-9][:k]
    whole = np.zeros((k, len(mean)))
    whole[: len(axes)] = _fixed(axes) if len(axes) else axes
    return mean, whole


def map_layout(df: DataFrame, vector: str, *, seed: int = 0, prefix: str = "map") -> DataFrame:
    """``df`` with ``map_x`` and ``map_y`` from -1 to 1: places along the two leading axes, each axis stretched to the whole. Fewer
    than two vectors stand at 0."""
    count = df.filter(F.col(vector).isNotNull()).limit(2).count()
    if count < 2:
        return df.withColumns({f"{prefix}_{c}": F.when(F.col(vector).isNotNull(), F.lit(0.0)).cast("float") for c in "xy"})
    mean, axes = sketched_axes(df, vector, 2, seed=seed)
    names = [f"{prefix}_x", f"{prefix}_y"]
    placed = projected(df, vector, mean.tolist(), [*axes.tolist(), [0.0] * len(mean)], prefix=prefix).drop(f"{prefix}_z")
    ends = placed.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in names for f in (F.min, F.max)]).first()
    scaled = {c: (((F.col(c) - ends[f"min_{c}"]) / max(ends[f"max_{c}"] - ends[f"min_{c}"], 1e-9)) * 2 - 1).cast("float") for c in names}
    return placed.withColumns(scaled)


@dataclass(frozen=True)
class Reducer:
    """Principal axes fitted on one table, to be applied to others."""

    mean: tuple[float, ...]
    axes: tuple[tuple[float, ...], ...]

    @staticmethod
    def fit(df: DataFrame, vector: str, dimensions: int = 2) -> Reducer:
        if dimensions not in (2, 3):
            raise ReducerError("two or three dimensions")
        rows = df.filter(F.col(vector).isNotNull())
        if not rows.limit(1).count():
            raise ReducerError("no vectors")
        mean, axes = principal_axes(rows, vector, dimensions)
        return Reducer(tuple(mean), tuple(map(tuple, axes)))

    def transform(self, df: DataFrame, vector: str, prefix: str = "projection") -> DataFrame:
        """``df`` with its coordinates; a vector of another length is an error in the task that meets it."""
        checked = F.when(F.size(vector) == len(self.mean), F.col(vector)).when(F.col(vector).isNotNull(), F.raise_error(F.lit(f"a vector that hasn't {len(self.mean)} components")).cast(df.schema[vector].dataType))
        axes = [list(a) for a in self.axes] + [[0.0] * len(self.mean)] * (3 - len(self.axes))
        placed = projected(df.withColumn("__v", checked), "__v", list(self.mean), axes, prefix=prefix).drop("__v")
        return placed if len(self.axes) == 3 else placed.drop(f"{prefix}_z")

    def save(self, spark: SparkSession, path: str) -> str:
        """Write the axes with their digest to a new file; a path that is taken is refused."""
        body = json.dumps({"mean": self.mean, "axes": self.axes})
        text = json.dumps({"format": FORMAT, "sha256": hashlib.sha256(body.encode()).hexdigest(), "body": body})
        if not claimed(spark, path, text):
            raise ReducerError(f"there is a file at {path}")
        return path

    @staticmethod
    def load(spark: SparkSession, path: str) -> Reducer:
        """Read axes; a file of another format, or one that was changed, is refused."""
        try:
            held = json.loads(spark.read.text(path, wholetext=True).first()[0])
            if held["format"] != FORMAT:
                raise ReducerError(f"a reducer of format {held['format']}")
            if hashlib.sha256(held["body"].encode()).hexdigest() != held["sha256"]:
                raise ReducerError("the file was changed")
            body = json.loads(held["body"])
            return Reducer(tuple(body["mean"]), tuple(map(tuple, body["axes"])))
        except (KeyError, TypeError, json.JSONDecodeError) as error:
            raise ReducerError(f"no reducer at {path}") from error
