"""Operator 2: sharding by sampled splitters, in DataFrame operations only.

Records are ordered by (hash of the text, id, row number), so equal texts stand side by side. A sample
drawn with probability in proportion to size gives quantile boundaries, which cut the order into many more
ranges than there are shards; because ids break ties, a hot group of copies gets boundaries inside it. Ranges
that still hold much more than their share are sampled again and subdivided. Exact totals of the ranges,
and a running sum inside each, give every record its exact place in the whole order, and the place its shard.

Laws:

* ``bytes``: sizes of shards differ by one record at most on either side;
* ``rows``: numbers of records differ by one at most;
* ``key``: the id and the number of shards alone decide (highest random weight), so one more shard takes
  records only into itself; ``grown_shard`` is the shard with one more.

A null text has size 1 and the checksum of no bytes. Repeated rows are separate records. An empty table gives
an empty result. Only the named columns are read. What reaches the driver are boundaries and range totals:
one number or key for about ``rows_per_range`` records, ``min_ranges`` at least.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sampleworks.llm._shared import written

SEED = 20_240_601
SAMPLES_PER_RANGE = 24


def _place(key: Column, bounds: list[tuple[int, int, int]]) -> Column:
    """How many of the sorted ``bounds`` are not above ``key``: a search in two steps of about their root."""
    if not bounds:
        return F.lit(0)
    step = max(1, math.isqrt(len(bounds)))
    literal = lambda rows: F.array(*[F.struct(*[F.lit(x).cast("long") for x in row]) for row in rows])
    heads = literal(bounds[::step])
    blocks = F.array(*[literal(bounds[at : at + step]) for at in range(0, len(bounds), step)])
    block = F.size(F.filter(heads, lambda b: b <= key))
    inside = F.size(F.filter(F.element_at(blocks, F.greatest(block, F.lit(1))), lambda b: b <= key))
    return F.when(block == 0, 0).otherwise((block - 1) * step + inside)


def _splitters(df: DataFrame, weight: Column, total: float, ranges: int, seed: int) -> list[tuple[int, int, int]]:
    """Quantile boundaries from a sample of about ``SAMPLES_PER_RANGE`` weighted draws for each range."""
    wanted = ranges * SAMPLES_PER_RANGE
    chance = weight.cast("double") * wanted / total
    draw = F.pmod(F.xxhash64(F.lit(seed), "h", "k", "u"), F.lit(1 << 30)).cast("double") / (1 << 30)
    sample = df.filter(draw < chance).select("h", "k", "u")
    order = Window.orderBy("h", "k", "u")
    picked = sample.withColumn("n", F.row_number().over(order)).filter(F.col("n") % SAMPLES_PER_RANGE == 0)
    return sorted({(r.h, r.k, r.u) for r in picked.select("h", "k", "u").collect()})


def _rendezvous(shards: int) -> Column:
    weights = F.array(*[F.struct(F.xxhash64(F.lit(SEED), F.lit(s), "k").alias("w"), F.lit(s).alias("s")) for s in range(shards)])
    return F.array_max(weights)["s"]


def shard(
    df: DataFrame,
    shards: int = 16,
    *,
    law: str = "bytes",
    id_col: str = "doc_id",
    text_col: str = "text",
    min_ranges: int = 256,
    rows_per_range: int = 1_000_000,
) -> DataFrame:
    """``id_col, size, text_crc32, law, shard, slot, grown_shard`` for every record of ``df``."""
    if law not in ("bytes", "rows", "key"):
        raise ValueError(f"unknown law: {law}")
    raw = F.coalesce(F.col(text_col), F.lit(""))
    base = written(
        df.select(
            F.col(id_col).alias("k"),
            (F.octet_length(raw) + 1).cast("long").alias("size"),
            F.crc32(raw.cast("binary")).alias("text_crc32"),
            F.xxhash64(raw).alias("h"),
            F.monotonically_increasing_id().alias("u"),
        ),
        "shard-base",
    )
    weight = F.col("size") if law == "bytes" else F.lit(1).cast("long")
    rows, total = base.agg(F.count("*"), F.coalesce(F.sum(weight), F.lit(0))).first()
    key = F.struct("h", "k", "u")
    ranges = max(min_ranges, math.ceil(rows / rows_per_range))
    bounds = _splitters(base, weight, total, ranges, SEED) if rows > 1 else []
    ranged = base.withColumn("part", _place(key, bounds))
    totals = {r.part: (r.n, r.w) for r in ranged.groupBy("part").agg(F.count("*").alias("n"), F.sum(weight).alias("w")).collect()}
    limit = 4 * max(total / max(ranges, 1), 1)
    for again in range(1, 4):
        overfull = [p for p, (n, w) in totals.items() if w > limit and n > 1]
        if not overfull:
            break
        inside = sum(totals[p][1] for p in overfull)
        more = _splitters(ranged.filter(F.col("part").isin(overfull)), weight, inside, math.ceil(2 * inside / limit) * 2, SEED + again)
        bounds = sorted({*bounds, *more})
        ranged = base.withColumn("part", _place(key, bounds))
        totals = {r.part: (r.n, r.w) for r in ranged.groupBy("part").agg(F.count("*").alias("n"), F.sum(weight).alias("w")).collect()}

    spark = df.sparkSession
    offsets, n0, w0 = [], 0, 0
    for p in sorted(totals):
        offsets.append((p, n0, w0))
        n0, w0 = n0 + totals[p][0], w0 + totals[p][1]
    starts = F.broadcast(spark.createDataFrame(offsets, "part int, n0 long, w0 long"))  # one row for each range
    order = Window.partitionBy("part").orderBy("h", "k", "u")
    placed = (
        ranged.withColumn("rank", F.row_number().over(order).cast("long"))
        .withColumn("before", F.sum(weight).over(order.rowsBetween(Window.unboundedPreceding, 0)) - weight)
        .join(starts, "part")
        .withColumn("rank", F.col("rank") + F.col("n0") - 1)
        .withColumn("before", F.col("before") + F.col("w0"))
    )
    grown = F.lit(None).cast("int")
    if law == "key":
        chosen, grown = _rendezvous(shards), _rendezvous(shards + 1)
    elif law == "rows":
        chosen = F.floor(F.col("rank") * shards / F.lit(max(rows, 1)))
    else:
        chosen = F.floor((F.col("before") + F.col("size") / 2) * shards / F.lit(max(total, 1)))
    chosen = F.least(chosen, F.lit(shards - 1)).cast("int")
    placed = placed.withColumn("shard", chosen).withColumn("grown_shard", grown.cast("int"))
    if law == "key":
        # the place inside a shard: records of the shard in earlier ranges, then a running number
        placed = written(placed.select("part", "h", "k", "u", "size", "text_crc32", "shard", "grown_shard"), "shard-placed")
        cells = placed.groupBy("part", "shard").agg(F.count("*").alias("n"))
        cells = cells.withColumn("first", F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).drop("n")
        inner = Window.partitionBy("part", "shard").orderBy("h", "k", "u")
        placed = placed.withColumn("r", F.row_number().over(inner) - 1).join(cells, ["part", "shard"]).withColumn("slot", F.col("first") + F.col("r"))
    else:
        # shards are runs of the whole order, so the place is the rank less the first rank of the shard
        placed = written(placed.select("k", "size", "text_crc32", "shard", "grown_shard", "rank"), "shard-placed")
        first = placed.groupBy("shard").agg(F.min("rank").alias("first"))
        placed = placed.join(F.broadcast(first), "shard").withColumn("slot", F.col("rank") - F.col("first"))  # one row for each shard
    return placed.select(
        F.col("k").alias(id_col), "size", "text_crc32", F.lit(law).alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard"
    )
