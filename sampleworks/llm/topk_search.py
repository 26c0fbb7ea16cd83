"""Operator 10: exact top-k search by inner product, with a ball tree in each shard.

Vectors are dealt to the nearest of a few pivots, fitted on ``FIT_ROWS`` rows at most (the smallest hashes of ids),
and packed into shards of bounded size, so a shard is a ball of its own: centre, radius and least id. Every row is in a
shard. Queries, packed alike, are searched in blocks. A node or shard is left out for those queries whose current
kth score its upper bound (query times centre, plus norm of query times radius) can't reach. Inside a shard, nodes are
visited best bound first. The kth scores are shared twice: after each block has searched a shard of its own pivot, and
again after the ``NEAR`` shards of the best bounds; only shards that can still hold a better row are sent the block
after that. Bounds carry a margin for rounding, and a node whose bound equals the kth score is searched only if it may
hold a smaller id.

Components become floor(256 x). Scores are exact integers: products are summed in float64 while
they fit into 53 bits, in int64 while they fit into 63 bits, and in Python integers beyond; a score
outside 64 bits counts as the largest or smallest that fits. Vectors that are null, empty, or hold a null or non-finite component take no
part; vectors of unlike lengths aren't compared. Ties go to the smaller id. Queries and candidates are rows,
so repeated ids are separate candidates, but rows with the id of the query are left out. Each query row has its own k rows,
also where several have one id: inside, a query is known by its block and its place there.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sampleworks.llm._shared import discard, written

SHARD_ROWS = 4096
QUERY_ROWS = 512
LEAF = 32
PIVOTS = 256
FIT_ROWS = 8192
NEAR = 4
GROUP_BLOCKS = 32
SUMMARIES = 512
NONE, LAST = -(2**63 - 1), 2**63 - 1
PACKED = "dim int, packet long, cell int, ids binary, vectors binary"


class BallTree:
    """Leaves of at most ``LEAF`` rows and the balls above them, split at the median of the widest direction."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray):
        order = np.arange(len(ids))
        self.nodes: list[tuple[np.ndarray, float, int, int, int, int, int]] = []  # centre, radius, least id, begin, end, left, right
        self.vectors, self.ids, self.order = vectors, ids, order
        self._build(0, len(ids))
        self.vectors, self.ids = vectors[order], ids[order]

    def _build(self, begin: int, end: int) -> int:
        rows = self.order[begin:end]
        points = self.vectors[rows]
        centre = points.mean(axis=0)
        radius = float(np.sqrt(((points - centre) ** 2).sum(axis=1).max()))
        at = len(self.nodes)
        self.nodes.append((centre, radius, int(self.ids[rows].min()), begin, end, -1, -1))
        if end - begin > LEAF:
            far = points[((points - centre) ** 2).sum(axis=1).argmax()]
            along = points @ (far - centre)
            half = (begin + end) // 2
            self.order[begin:end] = rows[np.lexsort((self.ids[rows], along))]
            left, right = self._build(begin, half), self._build(half, end)
            self.nodes[at] = (*self.nodes[at][:5], left, right)
        return at


def exact_products(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Integer inner products of whole-number float64 rows."""
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(points).max(initial=0)) * queries.shape[1]
    if most < 2.0**53:
        return (queries @ points.T).astype(np.int64)
    if most < 2.0**63:
        return queries.astype(np.int64) @ points.astype(np.int64).T
    whole = [[int(x) for x in row] for row in points]
    fitting = lambda score: min(max(score, NONE + 1), LAST)
    return np.array([[fitting(sum(int(x) * y for x, y in zip(q, p))) for p in whole] for q in queries], dtype=np.int64)


def search(tree: BallTree, queries: np.ndarray, query_ids: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best (score, id) of each query in one tree; ``floor`` holds kth scores known from elsewhere."""
    n = len(queries)
    scores, ids = np.full((n, k), NONE), np.full((n, k), LAST)
    norms = np.sqrt((queries**2).sum(axis=1))

    def bounds(node: int) -> np.ndarray:
        centre, radius = tree.nodes[node][:2]
        top = queries @ centre + norms * radius
        return top + np.abs(top) * 1e-9 + 1e-6 * (1 + norms)

    def wanted(node: int, upper: np.ndarray) -> np.ndarray:
        kth = np.maximum(scores[:, -1], floor)
        return (upper > kth) | ((upper >= kth) & ((scores[:, -1] < kth) | (tree.nodes[node][2] < ids[:, -1])))

    def push(node: int) -> None:
        upper = bounds(node)
        live = wanted(node, upper)
        if live.any():
            heapq.heappush(heap, (-float((upper - np.maximum(scores[:, -1], floor))[live].max()), node, upper))

    heap: list[tuple[float, int, np.ndarray]] = []
    push(0)
    while heap:
        _, node, upper = heapq.heappop(heap)
        live = np.flatnonzero(wanted(node, upper))
        if not len(live):
            continue
        _, _, _, begin, end, left, right = tree.nodes[node]
        if left >= 0:
            push(left)
            push(right)
            continue
        own = tree.ids[begin:end]
        found = exact_products(queries[live], tree.vectors[begin:end])
        found = np.where(own[None, :] == query_ids[live][:, None], NONE, found)
        all_scores = np.concatenate([scores[live], found], axis=1)
        all_ids = np.concatenate([ids[live], np.where(found == NONE, LAST, own[None, :])], axis=1)
        best = np.lexsort((all_ids, -all_scores), axis=1)[:, :k]
        scores[live], ids[live] = np.take_along_axis(all_scores, best, 1), np.take_along_axis(all_ids, best, 1)
    return scores, ids


def _usable(vector: Column) -> Column:
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def pivots(vectors: np.ndarray, count: int, rounds: int = 6) -> np.ndarray:
    """Centres by a few rounds of k-means, from evenly spaced rows."""
    centres = vectors[np.linspace(0, len(vectors) - 1, count).astype(int)] if len(vectors) else vectors
    for _ in range(rounds if len(vectors) else 0):
        own = nearest(vectors, centres)
        sums, n = np.zeros_like(centres), np.bincount(own, minlength=len(centres))
        np.add.at(sums, own, vectors)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def nearest(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (vectors @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1)


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ends and integer components of a list column."""
    ends = column.offsets.to_numpy()
    values = np.floor(256.0 * column.values.to_numpy(zero_copy_only=False).astype(np.float64))
    return ends, values


def _dealt(df: DataFrame, known: dict[int, np.ndarray]) -> DataFrame:
    """``id, v, dim, cell``: each vector's length and nearest pivot of that length."""
    told = df.sparkSession.sparkContext.broadcast(known)  # PIVOTS vectors at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, values = _matrix(batch.column(1))
            dims, cells = np.diff(ends), np.zeros(batch.num_rows, np.int32)
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                if int(dim) in told.value:
                    cells[rows] = nearest(values[ends[rows][:, None] + np.arange(dim)], told.value[int(dim)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(dims.astype(np.int32)), pa.array(cells)], names=["id", "v", "dim", "cell"])

    return df.mapInArrow(run, "id long, v array<double>, dim int, cell int")


def _packed(df: DataFrame, rows: int) -> DataFrame:
    """Rows of (id, v, dim, cell) packed, ``rows`` at most to a packet, one dimension and pivot in each."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[list[int], list[np.ndarray]]] = {}
        number = TaskContext.get().partitionId() << 32

        def out(key: tuple[int, int]) -> pa.RecordBatch:
            nonlocal number
            number += 1
            ids, vectors = held.pop(key)
            whole = np.stack(vectors)
            if np.abs(whole).max() < 2**15:
                whole = whole.astype(np.int16)
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([number]), pa.array([key[1]], pa.int32()), pa.array([np.array(ids, np.int64).tobytes()]), pa.array([whole.tobytes()])], names=["dim", "packet", "cell", "ids", "vectors"])

        for batch in batches:
            (ends, values), dims, cells = _matrix(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for i, row in enumerate(batch.column(0).to_pylist()):
                key = dims[i], cells[i]
                ids_held, vectors_held = held.setdefault(key, ([], []))
                ids_held.append(row)
                vectors_held.append(values[ends[i] : ends[i + 1]])
                if len(ids_held) >= rows:
                    yield out(key)
        for key in [*held]:
            yield out(key)

    sizes = df.groupBy("dim", "cell").agg(F.ceil(F.count("*") / rows).alias("parts"))  # a row for each length and pivot
    salted = df.join(sizes, ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("id"), "parts"))
    return salted.repartition("dim", "cell", "part").select("id", "v", "dim", "cell").mapInArrow(pack, PACKED)


def _matrix_of(ids: bytes, vectors: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    own = np.frombuffer(ids, np.int64)
    kind = np.int16 if len(vectors) == 2 * len(own) * dim else np.float64
    return own, np.frombuffer(vectors, kind).reshape(len(own), dim).astype(np.float64)


def top_k(
    df: DataFrame, is_query: Column, *, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best candidates for each row that ``is_query`` picks."""
    vector = F.col(vector_col).cast("array<double>")
    rows = df.filter(_usable(vector) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), vector.alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    n = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).collect()  # a row for each length
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).select("v").toArrow().column("v").to_pylist()
    fitted: dict[int, np.ndarray] = {}
    for r in n:
        own = np.array([v for v in sample if len(v) == r["dim"]], float).reshape(-1, r["dim"])
        count = min(PIVOTS, len(own), math.ceil(r["n"] / shard_rows))
        if count:
            fitted[r["dim"]] = pivots(np.floor(256.0 * own), count)
    shards = written(_packed(_dealt(rows.select("id", "v"), fitted), shard_rows), "topk-shards")
    blocks = written(_packed(_dealt(rows.filter("q").select("id", "v"), fitted), query_rows), "topk-queries")

    side = shards.select("dim", F.col("packet").alias("shard"), F.col("ids").alias("s_ids"), F.col("vectors").alias("s_vectors"))
    parts = max(1, math.ceil(blocks.count() / GROUP_BLOCKS))
    with_part = lambda df: df.withColumn("part", F.pmod(F.xxhash64("packet"), F.lit(parts)))

    def in_shard(shard: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"packet": [], "place": [], "query_id": [], "vec_id": [], "score": []}, dtype=np.int64)]
        for s in shard.itertuples():
            ids, vectors = _matrix_of(s.s_ids, s.s_vectors, s.dim)
            tree = BallTree(vectors, ids)
            for r in asked.itertuples():
                own, queries = _matrix_of(r.ids, r.vectors, r.dim)
                floor = np.frombuffer(r.floor, np.int64) if r.floor is not None else np.full(len(own), NONE)
                scores, best = search(tree, queries, own, floor, k)
                real = (scores > NONE) & (scores >= floor[:, None])
                asks = np.repeat(np.arange(len(own)), k)[real.ravel()]
                out.append(pd.DataFrame({"packet": r.packet, "place": asks, "query_id": own[asks], "vec_id": best[real], "score": scores[real]}))
        return pd.concat(out)

    def searched(pairs: DataFrame, floors: DataFrame) -> DataFrame:
        """Results of pairs of a block and a shard: a shard is sent once for each ``GROUP_BLOCKS`` blocks or so that it meets."""
        asked = with_part(pairs).join(floors, "packet")
        dealt = side.join(with_part(pairs).select("shard", "part").distinct(), "shard")
        return dealt.groupBy("shard", "part").cogroup(asked.groupBy("shard", "part")).applyInPandas(in_shard, "packet long, place long, query_id long, vec_id long, score long")

    best = Window.partitionBy("packet", "place").orderBy(F.desc("score"), "vec_id")

    def leading(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)

    def floors_of(found: DataFrame) -> DataFrame:
        """Blocks with the kth score that each of their queries has so far."""
        kth = leading(found).filter(F.col("rank") == k).groupBy("packet").agg(F.collect_list(F.struct("place", "score")).alias("known"))

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                floors = []
                for r in frame.itertuples():
                    floor = np.full(len(r.ids) // 8, NONE)
                    for told in r.known if r.known is not None else ():
                        floor[told["place"]] = told["score"]
                    floors.append(floor.tobytes())
                yield frame.drop(columns="known").assign(floor=floors)

        return blocks.join(kth, "packet", "left").select(*blocks.columns, "known").mapInPandas(run, f"{PACKED}, floor binary")

    def summarise(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples():
                ids, vectors = _matrix_of(r.ids, r.vectors, r.dim)
                centre = vectors.mean(axis=0)
                rows.append((r.dim, r.packet, centre.tobytes(), float(np.sqrt(((vectors - centre) ** 2).sum(axis=1).max())), int(ids.min())))
            yield pd.DataFrame(rows, columns=["dim", "shard", "centre", "radius", "least"])

    summary = shards.mapInPandas(summarise, "dim int, shard long, centre binary, radius double, least long")
    packs = max(1, math.ceil(sum(r["n"] for r in n) / shard_rows / SUMMARIES))
    pack = F.pmod(F.xxhash64("shard"), F.lit(packs)).cast("int").alias("pack")
    packed = written(summary.groupBy("dim", pack).agg(*[F.collect_list(c).alias(c) for c in ("shard", "centre", "radius", "least")]), "topk-summaries")

    def bounded(asked: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"packet": np.zeros(0, np.int64), "shard": np.zeros(0, np.int64), "gain": np.zeros(0)})]
        for s in told.itertuples():
            centres, radius, shard = np.stack([np.frombuffer(c, np.float64) for c in s.centre]), np.asarray(s.radius), np.asarray(s.shard)
            for r in asked.itertuples():
                _, queries = _matrix_of(r.ids, r.vectors, r.dim)
                floor = np.frombuffer(r.floor, np.int64).astype(float)
                norms = np.sqrt((queries**2).sum(axis=1))
                top = queries @ centres.T + norms[:, None] * radius[None, :]
                top += np.abs(top) * 1e-9 + 1e-6 * (1 + norms[:, None])
                gain = (top - floor[:, None]).max(axis=0)
                able = gain >= 0
                out.append(pd.DataFrame({"packet": r.packet, "shard": shard[able], "gain": gain[able]}))
        return pd.concat(out)

    def reachable(floors: DataFrame) -> DataFrame:
        """``packet, shard, gain``: shards that can hold a better row for some query of a block.

        Each group of blocks meets each pack of summaries in a task of its own, to which either is sent once.
        """
        every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
        asked = with_part(floors).withColumn("part", F.col("part").cast("int")).withColumn("pack", every(packs))
        told = packed.withColumn("part", every(parts))
        keys = ["dim", "part", "pack"]
        return asked.groupBy(*keys).cogroup(told.groupBy(*keys)).applyInPandas(bounded, "packet long, shard long, gain double")

    # a shard of the block's own pivot, or any, gives the first kth scores
    own = shards.groupBy("dim", "cell").agg(F.min_by("packet", F.struct(-F.length("ids"), "packet")).alias("mine"))
    some = shards.groupBy("dim").agg(F.min("packet").alias("any"))
    first = blocks.join(own, ["dim", "cell"], "left").join(some, "dim").select("packet", F.coalesce("mine", "any").alias("shard"))
    first = written(first, "topk-first")
    start = written(searched(first, blocks.withColumn("floor", F.lit(None).cast("binary"))), "topk-found-0")
    floors = written(floors_of(start), "topk-floors-0")
    able = written(reachable(floors).join(first, ["packet", "shard"], "left_anti"), "topk-able")
    ahead = Window.partitionBy("packet").orderBy(F.desc("gain"), "shard")
    near = written(able.withColumn("place", F.row_number().over(ahead)).filter(F.col("place") <= NEAR).select("packet", "shard"), "topk-near")
    found = written(start.unionByName(searched(near, floors)), "topk-found-1")
    for over in (start, floors, able):
        discard(over)
    floors = written(floors_of(found), "topk-floors-1")
    rest = written(reachable(floors).select("packet", "shard").join(first.unionByName(near), ["packet", "shard"], "left_anti"), "topk-rest")
    whole = found.unionByName(searched(rest, floors))
    return leading(whole).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
