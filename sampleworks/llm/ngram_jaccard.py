"""Operator 7: n-gram Jaccard join by a blocked sparse matrix product.

A document is a row of the document by n-gram incidence matrix; the product of the matrix with its transpose
holds the overlaps of all pairs. Only blocks of that product are computed in which a pair can reach the
similarity. In a block the overlaps are accumulated over groups of n-grams, and rows whose pairs all stay below the
bound that follows from their sizes, whatever n-grams are left, are discarded on the way:

1. Documents with the same set form one class, and a class is one row.
2. All n-grams of all documents are counted by hash, into a counter for eight bytes of text, ``BUCKETS`` at most, which
   puts them in one order, the rare ones first; shared counters make the order worse, not the result. Linked sets have so many n-grams in common that the first common one is among the first
   ``n - ceil(n * percent / 100) + 1`` of either set. A row is dealt to the blocks that these n-grams name. Being rare, most
   name no other row, and passages that many documents share name a block only for texts that hold little else.
3. In a block, rows in order of size are cut into runs where the next size is out of reach for a link. The first row of a
   run is its pivot. Rows that meet in any run are a family. A family of up to ``DIRECT`` rows is multiplied as one, in
   tiles of about ``TILE`` rows.
4. In a larger family the product of each pivot with the rows of its runs comes first, each distinct
   pair once. Runs whose other rows don't then belong to one component get the rest of their product, in
   tiles, leaving out pairs within a component: as one family up to ``FAMILY`` rows, beyond it run by run. So a large
   group of near copies costs a number of pairs in proportion to its rows, but no link between different texts is lost.

Which way a family goes changes the order of work, never the links. Words are runs of anything but space and bytes 9
to 13, with A-Z in lower case. A text with fewer words than the n-gram is one n-gram; a text without words (null, empty,
blank) has none and is linked with nothing. Repeated rows have equal sets. A row without an id is linked
through equal sets only. Hot groups: copies are folded inside each task before anything is shuffled, members of a pivot
are dealt in portions, tiles are bounded. Only the named columns are read. N-grams are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sampleworks.llm._components import components
from sampleworks.llm._shared import discard, giving_back, packed, small_batches, unpacked, written
from sampleworks.llm._words import blocks, mix, shingles, word_hashes

TILE = 512
PORTION = 1024
COLUMNS = 4096
DIRECT = 1024
FAMILY = 4096
BROADCAST_USES = 500_000
BUCKETS = 1 << 24  # counters of n-grams at most: 16 MB of levels are sent out, whatever the input
SLICES = 64
HELD_GRAMS = 1 << 20  # that a task counts before it sends the counts


def _bucket(grams: np.ndarray, buckets: int) -> np.ndarray:
    return (grams >> np.uint64(65 - buckets.bit_length())).astype(np.int64)


def prefix(grams: np.ndarray, levels: np.ndarray, percent: int) -> np.ndarray:
    """The n-grams of a set that come first in the order: at least one is in every set that it is linked with."""
    n = len(grams)
    if n == 0:
        return grams
    wanted = n - -(-n * percent // 100) + 1
    return grams[np.lexsort((mix(grams), levels[_bucket(grams, len(levels))]))[:wanted]] if wanted < n else grams


def rarity(df: DataFrame, size: int, text_col: str) -> np.ndarray:
    """A level for each bucket of n-grams: four times the binary logarithm of how often documents hold one of them."""
    octets = df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = min(BUCKETS, max(1 << 12, 1 << (octets // 8).bit_length()))
    per = max(1, buckets // SLICES)

    def parts(held: list[np.ndarray]) -> pa.RecordBatch:
        found, times = np.unique(np.concatenate(held), return_counts=True)
        edges = np.searchsorted(found, np.arange(0, buckets + per, per))
        rows = [(i, packed((found[a:b] - i * per).astype("<u4")), packed(times[a:b].astype("<u4"))) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:])) if b > a]
        columns = list(zip(*rows)) or [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=["slice", "buckets", "times"])

    @giving_back
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [np.zeros(0, np.int64)], 0
        for batch in batches:
            for _, grams in _sets(batch, size, 0):
                held.append(_bucket(grams, buckets))
                n += len(grams)
                if n >= HELD_GRAMS:
                    yield parts(held)
                    held, n = [np.zeros(0, np.int64)], 0
        yield parts(held)

    def total(key: tuple, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(per, np.int64)
        for batch in rows:
            for at, times in zip(batch.column(1), batch.column(2)):
                counts[unpacked(at.as_buffer(), "<u4")] += unpacked(times.as_buffer(), "<u4")
        level = np.floor(4 * np.log2(np.maximum(counts, 1))).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([level.tobytes()], pa.binary())], names=["slice", "level"])

    counted = df.select(text_col).mapInArrow(count, "slice int, buckets binary, times binary").groupBy("slice").applyInArrow(total, "slice int, level binary")
    levels = np.zeros(buckets, np.uint8)
    with small_batches(df.sparkSession):
        slices = counted.collect()  # SLICES rows at most, a byte for each bucket
    for row in slices:
        levels[row["slice"] * per : (row["slice"] + 1) * per] = np.frombuffer(row["level"], np.uint8)
    return levels


def class_of(grams: np.ndarray) -> int:
    """One number for a set."""
    return int(mix(np.array([mix(grams).sum(dtype=np.uint64) + np.uint64(len(grams))], np.uint64)).view(np.int64)[0]) if len(grams) else 0


def overlaps(rows: list[np.ndarray], columns: list[np.ndarray], percent: int = 0) -> np.ndarray:
    """Counts of common n-grams of two lists of sets: incidence matrices over the n-grams that both sides have,
    multiplied ``COLUMNS`` n-grams at a time. Rows and columns none of whose pairs can still reach ``percent`` are left
    out of the rest, so counts of pairs below it may be too low."""
    left, right = np.concatenate(rows), np.concatenate(columns)
    sizes = np.array([len(r) for r in rows]), np.array([len(c) for c in columns])
    row_of, column_of = np.repeat(np.arange(len(rows)), sizes[0]), np.repeat(np.arange(len(columns)), sizes[1])
    if rows is columns:  # between different rows only n-grams of several rows count
        common, times = np.unique(left, return_counts=True)
        common = common[times > 1]
    else:
        common = np.intersect1d(left, right)
    counts = np.zeros((len(rows), len(columns)), np.int64)
    needed = -(-percent * (sizes[0][:, None] + sizes[1][None, :]) // (100 + percent))

    def sides(values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(common, values)
        at[at == len(common)] = 0
        held = common[at] == values if len(common) else np.zeros(len(values), bool)
        order = np.argsort(at[held], kind="stable")
        return at[held][order], owner[held][order]

    (a, a_owner), (b, b_owner) = sides(left, row_of), sides(right, column_of)
    ahead = np.bincount(a_owner, minlength=len(rows)), np.bincount(b_owner, minlength=len(columns))
    for low in range(0, len(common), COLUMNS):
        width = min(COLUMNS, len(common) - low)
        reach = counts + np.minimum(ahead[0][:, None], ahead[1][None, :]) >= needed
        alive = reach.any(axis=1), reach.any(axis=0)
        if not alive[0].any():
            break
        blocks_of = []
        for at, owner, live, rest in ((a, a_owner, alive[0], ahead[0]), (b, b_owner, alive[1], ahead[1])):
            part = slice(*np.searchsorted(at, [low, low + width]))
            matrix = np.zeros((int(live.sum()), width), np.float32)
            own, column = owner[part], at[part] - low
            rest -= np.bincount(own, minlength=len(rest))
            matrix[(np.cumsum(live) - 1)[own[live[own]]], column[live[own]]] = 1
            blocks_of.append(matrix)
        counts[np.ix_(*alive)] += (blocks_of[0] @ blocks_of[1].T).astype(np.int64)
    return counts


def linked(overlap: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return (100 * overlap >= percent * (a + b - overlap)) & (overlap > 0)


def _sets(batch: pa.RecordBatch, size: int, column: int = 1) -> Iterator[tuple[int, np.ndarray]]:
    for first, last, data, offsets in blocks(batch.column(column)):
        words, at = word_hashes(data, offsets)
        for i in range(last - first):
            yield first + i, shingles(words[at[i] : at[i + 1]], size)


def classes(df: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """``id``, number of n-grams and class of each document."""
    kind = df.schema[id_col].dataType

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(len(grams), class_of(grams)) for _, grams in _sets(batch, size)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], names=["id", "n", "node"])

    return df.select(id_col, text_col).mapInArrow(run, T.StructType([T.StructField("id", kind), T.StructField("n", T.LongType()), T.StructField("node", T.LongType())]))


def _blocks_of(df: DataFrame, levels: np.ndarray, size: int, percent: int, text_col: str) -> DataFrame:
    """(gram, node, n) for the first n-grams of each class, once for each task that has it."""
    known = df.sparkSession.sparkContext.broadcast(levels)

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            names, nodes, sizes = [], [], []
            for _, grams in _sets(batch, size, 0):
                node = class_of(grams)
                if node in seen or not len(grams):
                    continue
                seen.add(node)
                names.append(prefix(grams, known.value, percent))
                nodes.append(node)
                sizes.append(len(grams))
            if names:
                times = [len(x) for x in names]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(names).view(np.int64)), pa.array(np.repeat(np.array(nodes, np.int64), times)), pa.array(np.repeat(np.array(sizes, np.int32), times))], names=["gram", "node", "n"])

    return df.select(text_col).mapInArrow(run, "gram long, node long, n int")


def _members(rows: DataFrame, percent: int) -> DataFrame:
    """``block, pivot, node`` for rows that share an n-gram with another row of a size in reach, from ``gram, node, n``."""
    along = Window.partitionBy("gram").orderBy("n", "node")
    # a class has one size, so what several tasks sent of it lies side by side
    once = rows.withColumn("same", F.lag("node").over(along)).filter("same IS NULL OR same <> node")
    before = F.lag("n").over(along)
    runs = once.withColumn("starts", before.isNull() | (F.col("n") * percent > before * 100))
    runs = runs.withColumn("ends", F.lead("starts", 1, True).over(along))
    pivot = F.last(F.when(F.col("starts"), F.col("node")), ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0))
    return runs.withColumn("pivot", pivot).filter("NOT (starts AND ends)").select(F.xxhash64("gram", "pivot").alias("block"), "pivot", "node")


def _with_sets(df: DataFrame, wanted: DataFrame, size: int, id_col: str, text_col: str, fields: str) -> DataFrame:
    """Rows of ``wanted`` (id, uses: array of structs with a ``node``) unfolded, each with the n-grams of its document.

    ``wanted`` is broadcast if its counted uses are few enough, else both sides are shuffled.
    """
    wanted = written(wanted, "wanted")
    if (wanted.agg(F.sum(F.size("uses") + 1)).first()[0] or 0) <= BROADCAST_USES:
        wanted = F.broadcast(wanted)
    uses = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(wanted, "id")

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            for i, grams in _sets(batch, size, 0):
                rows = column.slice(i, 1).flatten()
                # of several texts with one id each has the uses of its own class
                rows = rows.filter(pc.equal(rows.field("node"), class_of(grams)))
                blob = pa.array([grams.tobytes()], pa.binary())
                for at in range(0, len(rows), 64):
                    part = rows.slice(at, 64)
                    yield pa.RecordBatch.from_arrays([*part.flatten(), pa.concat_arrays([blob] * len(part))], names=[*(f.name for f in part.type), "grams"])

    return uses.select("text", "uses").mapInArrow(run, f"{fields}, grams binary")


def _tile_edges(df: DataFrame, rows: DataFrame, first: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Links between rows of one block (``block, node, comp, rows``) in different components, enough of them to join
    the components; the product is done in tiles."""
    tiles = F.ceil(F.col("rows") / TILE).cast("int")
    dealt = rows.withColumn("tile", F.pmod(F.xxhash64("node"), tiles).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), tiles - 1)))
    use = F.struct("block", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "node", "comp")
    uses = dealt.select("node", use.alias("use")).groupBy("node").agg(F.collect_list("use").alias("uses")).join(first, "node").select("id", "uses")

    def in_tile(frame: pd.DataFrame) -> pd.DataFrame:
        i, j = frame["i"].iloc[0], frame["j"].iloc[0]
        x, y = frame[frame["tile"] == i], frame[frame["tile"] == j]
        if not len(x) or not len(y):
            return pd.DataFrame({"a": [], "b": []}, dtype=np.int64)
        sets = [[np.frombuffer(g, np.uint64) for g in x["grams"]]]
        sets.append(sets[0] if i == j else [np.frombuffer(g, np.uint64) for g in y["grams"]])
        counts = overlaps(*sets, percent)
        sizes = [np.array([len(g) for g in s]) for s in sets]
        own, theirs = x["comp"].to_numpy(), y["comp"].to_numpy()
        good = linked(counts, sizes[0][:, None], sizes[1][None, :], percent) & (own[:, None] != theirs[None, :])
        parent: dict[int, int] = {}

        def root(c: int) -> int:
            while parent.get(c, c) != c:
                c = parent[c]
            return c

        a, b = [], []
        nodes = x["node"].to_numpy(), y["node"].to_numpy()
        for p, q in zip(*np.nonzero(good)):
            left, right = root(own[p]), root(theirs[q])
            if left != right:
                parent[max(left, right)] = min(left, right)
                a.append(nodes[0][p])
                b.append(nodes[1][q])
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    with_sets = _with_sets(df, uses, size, id_col, text_col, "block long, i int, j int, tile int, node long, comp long")
    return written(with_sets.groupBy("block", "i", "j").applyInPandas(in_tile, "a long, b long"), "tile-edges")


def _large_edges(df: DataFrame, members: DataFrame, first: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Links in large families: with the pivot of each block, then between what that leaves apart."""
    # overlaps with the pivot of each block
    pairs = written(members.filter("node <> pivot").select("pivot", "node").distinct(), "pairs")
    portions = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / PORTION).cast("int").alias("portions"))
    tasks = pairs.join(portions, "pivot").select("node", F.struct("pivot", F.pmod(F.xxhash64("node"), "portions").cast("int").alias("portion"), F.lit(1).alias("side"), "node").alias("use"))
    pivots = portions.select(F.col("pivot").alias("node"), F.explode(F.sequence(F.lit(0), F.col("portions") - 1)).alias("portion")).select("node", F.struct(F.col("node").alias("pivot"), "portion", F.lit(0).alias("side"), "node").alias("use"))
    uses = tasks.unionByName(pivots).groupBy("node").agg(F.collect_list("use").alias("uses")).join(first, "node").select("id", "uses")
    rows = _with_sets(df, uses, size, id_col, text_col, "pivot long, portion int, side int, node long")

    def with_pivot(frame: pd.DataFrame) -> pd.DataFrame:
        own, theirs = frame[frame["side"] == 0], frame[frame["side"] == 1]
        if not len(own) or not len(theirs):
            return pd.DataFrame({"a": [], "b": []}, dtype=np.int64)
        grams = [[np.frombuffer(g, np.uint64) for g in side["grams"]] for side in (own.iloc[:1], theirs)]
        sizes = np.array([len(g) for g in grams[1]])
        good = linked(overlaps(*grams, percent)[0], len(grams[0][0]), sizes, percent)
        found = theirs["node"].to_numpy()[good]
        return pd.DataFrame({"a": np.full(len(found), own["node"].iloc[0], np.int64), "b": found})

    edges = written(rows.groupBy("pivot", "portion").applyInPandas(with_pivot, "a long, b long"), "edges")
    labels = components(edges)
    labelled = members.filter("node <> pivot").join(labels, "node", "left").select("block", "node", F.coalesce("comp", "node").alias("comp"))
    open_blocks = (
        labelled.groupBy("block")
        .agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.min("node").alias("head"), F.count("*").alias("rows"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("same"))
        .filter("low <> high")
        .groupBy("rows", "same")
        .agg(F.min("block").alias("block"), F.min("head").alias("head"))  # equal blocks have one head
    )
    open_rows = written(labelled.join(open_blocks, "block"), "open")
    if not open_rows.limit(1).count():
        return edges
    # rows that meet in open blocks: a family of moderate size is multiplied as one, a larger one block by block
    families = components(open_rows.select(F.col("head").alias("a"), F.col("node").alias("b"))).withColumnRenamed("comp", "family")
    sizes = families.groupBy("family").agg(F.count("*").alias("all_rows")).filter(F.col("all_rows") <= FAMILY)
    moderate = written(families.join(sizes, "family"), "open-families")
    whole = open_rows.select("node", "comp").distinct().join(moderate, "node").select(F.col("family").alias("block"), "node", "comp", F.col("all_rows").alias("rows"))
    rest = open_rows.join(moderate.select("node"), "node", "left_anti").select("block", "node", "comp", "rows")
    return edges.union(_tile_edges(df, whole.union(rest), first, size, percent, id_col, text_col))


def join_components(df: DataFrame, *, size: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_shingles`` and ``component_id``: the smallest id that links of ``percent`` reach."""
    docs = written(classes(df, size, id_col, text_col), "classes")
    first = docs.filter("n > 0 AND id IS NOT NULL").groupBy("node").agg(F.min("id").alias("id"))
    rows = df.filter(F.col(id_col).isNotNull())
    members = written(_members(_blocks_of(rows, rarity(rows, size, text_col), size, percent, text_col), percent), "blocks")
    # rows that meet in any run are a family; a family of moderate size is multiplied as one
    families = components(members.select(F.col("pivot").alias("a"), F.col("node").alias("b"))).withColumnRenamed("comp", "family")
    sized = written(families.join(families.groupBy("family").agg(F.count("*").alias("rows")), "family"), "families")
    direct = sized.filter(F.col("rows") <= DIRECT).select(F.col("family").alias("block"), "node", F.col("node").alias("comp"), "rows")
    edges = _tile_edges(df, direct, first, size, percent, id_col, text_col)
    if sized.filter(F.col("rows") > DIRECT).limit(1).count():
        large = sized.filter(F.col("rows") > DIRECT).select("node")
        edges = edges.union(_large_edges(df, members.join(large, "node", "left_semi"), first, size, percent, id_col, text_col))
    labels = components(edges)
    discard(members)  # the labels are written
    reached = docs.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = reached.filter("n > 0").groupBy("comp").agg(F.min("id").alias("least"))
    out = reached.join(least, "comp", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("least", "id")).otherwise(F.col("id")).alias("component_id"))
