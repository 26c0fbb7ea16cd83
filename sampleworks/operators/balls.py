"""Exact search among unit vectors in packets that are balls: what a packet's centre and radius rule out is never compared.

Vectors are dealt to the nearest of a few pivots, fitted on ``FIT_ROWS`` rows at most (the smallest hashes of ids), and packed, so a
packet holds neighbours of each other. Two vectors of length 1 whose distance in space is m or more have a cosine distance of
m * m / 2 or more, and no members of two packets are closer than their centres less both radii. Summaries of packets are
compared in packs; of a pair of packets that may hold something, one is sent to the other once for a group of packets, or for the
nearest both are read from where they are written. In a task rows that the other packet's ball rules out are left out before the product.

A null vector takes no part. A vector of zeros stays zero: its distance to any other is 1. Vectors must have one length.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sampleworks.operators.ranges import staged

PACKET = 2048
PIVOTS = 512
FIT_ROWS = 8192
PACK = 512  # summaries that are compared at once
GROUP = 16  # packets that another is sent to at once
SIDE = 32  # packets that are read beside another at once
TILE = 512  # rows that are held against a packet at once
BATCH = "8m"  # of packets that go to Python
SLACK = 1e-9  # of distances, for rounding
SCHEMA = "packet long, ids binary, vectors binary, centre binary, radius double"


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)


def _rows(ids: bytes, vectors: bytes) -> tuple[np.ndarray, np.ndarray]:
    own = np.frombuffer(ids, np.int64)
    return own, np.frombuffer(vectors, np.float64).reshape(len(own), -1)


def _pivots(points: np.ndarray, count: int, rounds: int = 5) -> np.ndarray:
    """Centres by a few rounds of k-means from evenly spaced rows."""
    centres = points[np.linspace(0, len(points) - 1, count).astype(int)]
    for _ in range(rounds):
        near = (points @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        times = np.bincount(near, minlength=count)
        centres = np.where(times[:, None] > 0, sums / np.maximum(times, 1)[:, None], centres)
    return centres


def packets(df: DataFrame, *, id_col: str = "id", vector_col: str = "v", rows: int = PACKET) -> DataFrame:
    """Unit vectors in packets of ``rows`` at most, near ones together: ``packet, ids, vectors, centre, radius``. Written once."""
    vectors = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter("v IS NOT NULL")
    n = vectors.count()
    sample = vectors.orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).select("v").toArrow().column("v").to_pylist()
    points = unit(np.array(sample, float)) if sample else np.zeros((0, 1))
    count = min(PIVOTS, len(points), math.ceil(n / rows))
    centres = vectors.sparkSession.sparkContext.broadcast(_pivots(points, count) if count else points)  # PIVOTS vectors at most

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(1)
            own = unit(values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)) if len(values) else np.zeros((0, 1))
            near = (own @ centres.value.T - (centres.value**2).sum(axis=1) / 2).argmax(axis=1) if len(values) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), values, pa.array(near.astype(np.int32))], names=["id", "v", "cell"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}
        number = TaskContext.get().partitionId() << 32

        def out(cell: int) -> pa.RecordBatch:
            nonlocal number
            number += 1
            ids, own = held.pop(cell)
            whole = np.concatenate(own)
            centre = whole.mean(axis=0)
            radius = float(np.sqrt(((whole - centre) ** 2).sum(axis=1).max()))
            columns = [number], [np.concatenate(ids).tobytes()], [whole.tobytes()], [centre.tobytes()], [radius]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64()))], names=["packet", "ids", "vectors", "centre", "radius"])

        for batch in batches:
            if not batch.num_rows:
                continue
            ids, cells = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            own = unit(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1))
            for cell in np.unique(cells).tolist():
                mine = np.flatnonzero(cells == cell)
                while len(mine):
                    kept = held.setdefault(cell, ([], []))
                    room = rows - sum(map(len, kept[0]))
                    kept[0].append(ids[mine[:room]])
                    kept[1].append(own[mine[:room]])
                    if len(mine) >= room:
                        yield out(cell)
                    mine = mine[room:]
        for cell in [*held]:
            yield out(cell)

    dealt = vectors.mapInArrow(deal, "id long, v array<double>, cell int")
    sizes = F.broadcast(dealt.groupBy("cell").agg(F.ceil(F.count("*") / rows).alias("parts")))  # PIVOTS rows at most
    salted = dealt.join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64("id"), "parts"))
    return staged(salted.repartition("cell", "part").select("id", "v", "cell").mapInArrow(pack, SCHEMA), "packets")


def packet_pairs(balls: DataFrame, *, ordered: bool = False) -> DataFrame:
    """``a, b``: packets with a row of ``a`` that may be within its ``reach`` (a cosine distance) of a row of ``b``; with
    ``ordered`` each pair once, itself included, else without a packet and itself. ``balls`` has ``packet, centre, radius, reach``."""
    n = balls.count()

    def able(a: np.ndarray, x: np.ndarray, radius: np.ndarray, reach: np.ndarray, b: np.ndarray, y: np.ndarray, other: np.ndarray) -> pd.DataFrame:
        apart = np.sqrt(np.maximum((x**2).sum(axis=1)[:, None] + (y**2).sum(axis=1) - 2 * x @ y.T, 0))
        least = np.maximum(apart - radius[:, None] - other - 1e-7, 0)
        good = least**2 / 2 <= reach[:, None] + SLACK
        good &= (a[:, None] <= b) if ordered else (a[:, None] != b)
        i, j = np.nonzero(good)
        return pd.DataFrame({"a": a[i], "b": b[j]})

    stacked = lambda blobs: np.stack([np.frombuffer(c, np.float64) for c in blobs])
    if n <= PACK:  # one pack of summaries: no need of a job for them
        told = balls.select("packet", "centre", "radius", "reach").toPandas()
        packet, radius, reach = (told[c].to_numpy() for c in ("packet", "radius", "reach"))
        centre = stacked(told["centre"]) if n else np.zeros((0, 1))
        return balls.sparkSession.createDataFrame(able(packet, centre, radius, reach, packet, centre, radius), "a long, b long")
    many = math.ceil(n / PACK)
    pack = F.pmod(F.xxhash64("packet"), F.lit(many)).cast("int")
    packs = balls.groupBy(pack.alias("p")).agg(*[F.collect_list(c).alias(c) for c in ("packet", "centre", "radius", "reach")])
    packs = staged(packs, "packs")
    left = packs.select(F.col("p").alias("pa"), F.explode(F.sequence(F.lit(0), F.lit(many - 1))).alias("pb"), *[F.col(c).alias(f"a_{c}") for c in ("packet", "centre", "radius", "reach")])
    both = left.join(packs.select(F.col("p").alias("pb"), "packet", "centre", "radius"), "pb").repartition("pa", "pb")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                yield able(np.asarray(r.a_packet), stacked(r.a_centre), np.asarray(r.a_radius), np.asarray(r.a_reach), np.asarray(r.packet), stacked(r.centre), np.asarray(r.radius))

    columns = ["a_packet", "a_centre", "a_radius", "a_reach", "packet", "centre", "radius"]
    return staged(both.select(*columns).mapInPandas(run, "a long, b long"), "packet-pairs")


def meet(pairs: DataFrame, asking: DataFrame, others: DataFrame, compare: Callable, schema: str) -> DataFrame:
    """``compare(row of asking, row of others)`` for every pair ``a, b``; a packet ``b`` is sent once for ``GROUP`` or so of ``a``."""
    parts = max(1, math.ceil(asking.count() / GROUP))
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(parts)).alias("part")
    keyed = pairs.select("a", "b", part("a"))
    asked = keyed.join(asking.withColumnRenamed("packet", "a"), "a")
    told = keyed.select("b", "part").distinct().join(others.withColumnRenamed("packet", "b"), "b")
    told = told.select(*[F.col(c).alias(f"other_{c}") for c in told.columns])  # names of its own, as both sides may be one table

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.rename(columns=lambda c: c.removeprefix("other_"))
        found = [compare(x, y) for y in right.itertuples() for x in left.itertuples()]
        return pd.concat(found) if found else pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])

    return asked.groupBy("b", "part").cogroup(told.groupBy("other_b", "other_part")).applyInPandas(run, schema)


def able_rows(vectors: np.ndarray, reach: np.ndarray | float, centre: bytes, radius: float) -> np.ndarray:
    """Rows that may have something of a ball within their reach."""
    apart = np.sqrt(np.maximum(((vectors - np.frombuffer(centre, np.float64)) ** 2).sum(axis=1), 0)) - radius - 1e-7
    return np.flatnonzero(np.maximum(apart, 0) ** 2 / 2 <= reach + SLACK)


def nearest(df: DataFrame, k: int, *, id_col: str = "id", vector_col: str = "v", rows: int = PACKET) -> DataFrame:
    """``src, dst, dist``: for each vector the k nearest others and perhaps more, by cosine distance rounded to 12 places, ties to
    the smaller id. Rows with one id aren't compared.

    Packets are written once and read by each task that needs them, ``SIDE`` of them beside one another at a time, so none is
    shuffled. A task keeps the k best of one packet while others pass, and sends on what they added.
    """
    balls = packets(df, id_col=id_col, vector_col=vector_col, rows=rows)

    def merged(q: np.ndarray, x: np.ndarray, best: np.ndarray, of: np.ndarray, c: np.ndarray, y: np.ndarray) -> None:
        """Put what is nearer of ``y`` into the tables of the k best, distance and id, of the rows of ``x``."""
        for at in range(0, len(q), TILE):
            own, top, who = q[at : at + TILE], best[at : at + TILE], of[at : at + TILE]
            dist = 1 - x[at : at + TILE] @ y.T
            i, j = np.nonzero(dist <= top[:, -1:] + SLACK)
            apart = own[i] != c[j]
            i, j = i[apart], j[apart]
            d, near = dist[i, j], c[j]
            told, last = np.round(d, 12), np.round(top[i, -1], 12)
            nearer = (told < last) | (told == last) & (near < who[i, -1])
            i, d, near = i[nearer], d[nearer], near[nearer]
            if not len(i):
                continue
            touched, row = np.unique(i, return_inverse=True)
            row = np.concatenate((np.repeat(np.arange(len(touched)), k), row))
            d, near = np.concatenate((top[touched].ravel(), d)), np.concatenate((who[touched].ravel(), near))
            order = np.lexsort((near, np.round(d, 12), row))
            first = np.searchsorted(row[order], np.arange(len(touched)))
            kept = order[first[:, None] + np.arange(k)]
            top[touched], who[touched] = d[kept], near[kept]

    def table(n: int) -> tuple[np.ndarray, np.ndarray]:
        return np.full((n, k), np.inf), np.full((n, k), np.iinfo(np.int64).max)

    blobs = ("ids", "vectors", "centre", "near", "dist")
    inner = pa.schema([("packet", pa.int64()), *((c, pa.binary()) for c in blobs), ("radius", pa.float64()), ("reach", pa.float64())])

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, x = _rows(r["ids"], r["vectors"])
                best, of = table(len(ids))
                merged(ids, x, best, of, ids, x)
                row = {**{c: r[c] for c in ("packet", "ids", "vectors", "centre", "radius")}, "near": of.tobytes(), "dist": best.tobytes(), "reach": float(best[:, -1].max())}
                yield pa.RecordBatch.from_pylist([row], schema=inner)

    told = staged(balls.mapInArrow(inside, "packet long, ids binary, vectors binary, centre binary, near binary, dist binary, radius double, reach double").withColumn("middle", _doubles("centre")), "nearest-inside", BATCH)
    count = told.count()
    flat = pa.schema([("src", pa.int64()), ("dst", pa.int64()), ("dist", pa.float64())])

    def rows_of(ids: np.ndarray, best: np.ndarray, of: np.ndarray, shown: np.ndarray) -> pa.RecordBatch:
        columns = np.repeat(ids, k).reshape(-1, k)[shown], of[shown], best[shown]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=flat)

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, best, of = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["dist"]).reshape(-1, k), np.frombuffer(r["near"], np.int64).reshape(-1, k)
                yield rows_of(ids, best, of, np.isfinite(best))

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None

        def added() -> pa.RecordBatch:
            _, ids, _, best, of, start = held
            return rows_of(ids, best, of, np.isfinite(best) & ~(of[:, :, None] == start[:, None, :]).any(axis=2))

        for batch in batches:
            for r in range(batch.num_rows):
                at = lambda c: batch.column(c)[r].as_py()  # noqa: E731, B023
                if held is None or held[0] != at("packet"):
                    if held is not None:
                        yield added()
                    ids, x = _rows(at("ids"), at("vectors"))
                    best, start = np.frombuffer(at("dist")).reshape(-1, k).copy(), np.frombuffer(at("near"), np.int64).reshape(-1, k)
                    held = at("packet"), ids, x, best, start.copy(), start
                _, ids, x, best, of, _ = held
                live = able_rows(x, best[:, -1], at("other_centre"), at("other_radius"))
                c, y = _rows(at("other_ids"), at("other_vectors"))
                top, who = best[live], of[live]
                merged(ids[live], x[live], top, who, c, y)
                best[live], of[live] = top, who
        if held is not None:
            yield added()

    others = told.select(*[F.col(c).alias(f"other_{c}") for c in ("packet", "ids", "vectors", "centre", "radius", "middle")]).coalesce(max(1, math.ceil(count / SIDE)))
    apart = F.sqrt(F.aggregate(F.zip_with("middle", "other_middle", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, v: t + v))
    least = F.greatest(apart - F.col("radius") - F.col("other_radius") - 1e-7, F.lit(0.0))
    able = (F.col("packet") != F.col("other_packet")) & (least * least / 2 <= F.col("reach") + SLACK)
    # a product of tables, each partition of one with each of the other: both are read from their files, and nothing is shuffled
    met = told.join(others.hint("shuffle_replicate_nl"), able).select("packet", "ids", "vectors", "near", "dist", "other_ids", "other_vectors", "other_centre", "other_radius")
    kind = "src long, dst long, dist double"
    found = staged(met.mapInArrow(across, kind), "nearest-across", BATCH)
    return told.select("ids", "near", "dist").mapInArrow(unfold, kind).unionByName(found)


def _doubles(blob: str) -> Column:
    """A blob of numbers as an array."""

    @F.pandas_udf("array<double>")
    def read(given: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(b) for b in given], dtype=object)

    return read(F.col(blob))


def within(df: DataFrame, limit: float, *, id_col: str = "id", vector_col: str = "v", rows: int = PACKET) -> DataFrame:
    """``a, b, dist`` with ``a <= b`` for every pair of vectors within ``limit``, each with itself included."""
    balls = packets(df, id_col=id_col, vector_col=vector_col, rows=rows)
    pairs = packet_pairs(balls.select("packet", "centre", "radius", F.lit(float(limit)).alias("reach")), ordered=True)

    def compare(a, b) -> pd.DataFrame:
        (q, x), (c, y) = _rows(a.ids, a.vectors), _rows(b.ids, b.vectors)
        live, other = able_rows(x, limit, b.centre, b.radius), able_rows(y, limit, a.centre, a.radius)
        q, x, c, y = q[live], x[live], c[other], y[other]
        dist = 1 - x @ y.T
        near = dist <= limit
        if a.a == b.b:
            near &= q[:, None] <= c[None, :]
        i, j = np.nonzero(near)
        return pd.DataFrame({"a": np.minimum(q[i], c[j]), "b": np.maximum(q[i], c[j]), "dist": dist[i, j]})

    return meet(pairs, balls, balls, compare, "a long, b long, dist double")
