"""Operator 11: a Merkle manifest of a data set, kept as a node store in levels of Parquet.

1. Each row becomes a leaf, the digest of its fields. Leaves are sorted by (source, id) over ranges of that order, so a
   source with a third of all rows is spread over as many sorted runs as its size asks for. Numbers of rows of the
   runs give each leaf its coordinate: tree (one for each source) and place in it. That is level 0.
2. A level is read in the order it was written, and each run of ``FANOUT`` nodes becomes one node of the next level as
   it passes. Only runs that the borders of tasks cut meet by a shuffle, in groups of at most ``FANOUT`` nodes. Levels
   end when every tree is one node, its subroot. The subroots, in the order of sources, are the leaves of one
   more tree, built alike, which ends in the root.
3. Proofs are taken from the top down, three levels at a time. Nodes of three levels under one node (a block, 4,096
   leaves at most) are sorted together by coordinate and merged in one pass: first the path of the block from
   above, then its inner nodes, then the leaves with their siblings. So no task holds more than a block.

A digest H is the lowercase hex SHA-256 of its inputs end to end, digests as hex text. A field is ``-`` if it is null,
else its number of UTF-8 bytes, ``:`` and its value. The proof of a leaf is the digest of all siblings on its way to the
root. To show that proofs hold, leaves of tampered texts (A-Z lower-cased where 5 divides the checksum of the id) are
folded with the siblings of the original ones.

A null source is a tree of its own, first in order. Null ids come first in their source, are written ``-``
and aren't tampered with. Rows with the same id are ordered by their leaf digests; equal rows are leaves of their own with
unlike proofs. An empty table gives an empty result. Other columns are not read. What reaches the driver: one number
for each task of the sort, the number of levels and the root.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sampleworks.llm._shared import shared_dir, written
from sampleworks.operators.ranges import row_numbers

FANOUT = 16
SHIFT = 4  # FANOUT is 2 ** SHIFT
STEP = 3  # levels that are merged at once
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BROADCAST_ROWS = 200_000
SIZE = 32  # bytes of a digest
NODE = "tree long, pos long, n long, digest binary"
PATH = 99  # stands in the column of levels for the path of a block


def leaf_digest(fields: list[Column]) -> Column:
    """H of fields, as 64 hex digits."""
    framed = [F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in (x.cast("string") for x in fields)]
    return F.sha2(F.concat(*framed), 256)


def _leaves(df: DataFrame, fields: tuple[str, ...], id_col: str, source_col: str, text_col: str) -> DataFrame:
    """``source, id, leaf, altered``: digests of every row, and of its tampered text (null: not tampered with)."""
    lowered = [F.translate(text_col, UPPER, LOWERED) if c == text_col else F.col(c) for c in fields]
    chosen = F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0
    return df.select(
        F.col(source_col).alias("source"),
        F.col(id_col).alias("id"),
        F.unhex(leaf_digest([F.col(c) for c in fields])).alias("leaf"),
        F.when(chosen, F.unhex(leaf_digest(lowered))).alias("altered"),
    )


def _digest(parts: bytes) -> bytes:
    return hashlib.sha256(parts.hex().encode()).digest()


def _strings(column: pa.Array) -> np.ndarray:
    """A column of digests as an array of rows of ``SIZE`` bytes."""
    column = column.cast(pa.binary()) if column.type != pa.binary() else column
    start = np.frombuffer(column.buffers()[1], np.int32)[column.offset]
    return np.frombuffer(column.buffers()[2], np.uint8)[start : start + SIZE * len(column)].reshape(-1, SIZE)


def _next_level(level: DataFrame) -> DataFrame:
    """Parents of the nodes of trees that are more than one node; read in order, cut runs put together afterwards."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: tuple[np.ndarray, ...] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = (*(batch.column(i).to_numpy() for i in range(3)), _strings(batch.column(3)))
            tree, pos, n, digest = now if tail is None else tuple(np.concatenate(x) for x in zip(tail, now))
            open_from = int(np.flatnonzero((tree != tree[-1]) | (pos >> SHIFT != pos[-1] >> SHIFT)).max(initial=-1)) + 1
            yield parents(tree[:open_from], pos[:open_from], n[:open_from], digest[:open_from])
            tail = tree[open_from:], pos[open_from:], n[open_from:], digest[open_from:]
        if tail is not None:
            yield parents(*tail)

    def parents(tree: np.ndarray, pos: np.ndarray, n: np.ndarray, digest: np.ndarray) -> pa.RecordBatch:
        group = pos >> SHIFT
        new = np.ones(len(tree), bool)
        new[1:] = (tree[1:] != tree[:-1]) | (pos[1:] != pos[:-1] + 1) | (group[1:] != group[:-1])
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(tree)))
        whole = size == np.minimum(FANOUT, n[begin] - (group[begin] << SHIFT))
        data = digest.tobytes()
        folded, parts = [], []
        for at, count, full in zip(begin.tolist(), size.tolist(), whole.tolist()):
            run = data[at * SIZE : (at + count) * SIZE]
            folded.append(_digest(run) if full else None)
            parts.append(None if full else run)
        columns = [pa.array(tree[begin]), pa.array(group[begin]), pa.array(-(-n[begin] // FANOUT)), pa.array(folded, pa.binary()), pa.array(pos[begin]), pa.array(parts, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["tree", "pos", "n", "digest", "first", "part"])

    passed = written(level.filter("n > 1").select("tree", "pos", "n", "digest").mapInArrow(fold, f"{NODE}, first long, part binary"), "merkle-passed")
    # of one parent at most FANOUT parts
    cut = passed.filter("digest IS NULL").groupBy("tree", "pos", "n").agg(F.array_sort(F.collect_list(F.struct("first", F.lower(F.hex("part")).alias("part")))).alias("parts"))
    mended = cut.select("tree", "pos", "n", F.unhex(F.sha2(F.array_join(F.col("parts.part"), ""), 256)).alias("digest"))
    return passed.filter("digest IS NOT NULL").select("tree", "pos", "n", "digest").unionByName(mended)


class NodeStore:
    """Levels of nodes as Parquet under one folder; level 0 may have more columns."""

    def __init__(self, leaves: DataFrame):
        self.spark = leaves.sparkSession
        self.folder = f"{shared_dir(self.spark)}/merkle-{uuid.uuid4().hex}"
        self.levels = [self._put(leaves)]
        widest = self.levels[0].agg(F.max("n")).first()[0] or 0
        while widest > 1:
            self.levels.append(self._put(_next_level(self.levels[-1])))
            widest = -(-widest // FANOUT)

    def _put(self, level: DataFrame) -> DataFrame:
        path = f"{self.folder}/level={len(getattr(self, 'levels', ()))}"
        level.write.parquet(path)
        return self.spark.read.schema(level.schema).parquet(path)

    def roots(self) -> DataFrame:
        """``tree, height, digest`` of every tree."""
        found = [level.filter("n = 1").select("tree", F.lit(k).alias("height"), "digest") for k, level in enumerate(self.levels)]
        out = found[0]
        for more in found[1:]:
            out = out.unionByName(more)
        return out


def _one_level(run: bytes, own: int) -> bytes:
    """A level of a path: own place, number of siblings, the siblings."""
    return bytes((own, len(run) // SIZE - 1)) + run[: own * SIZE] + run[(own + 1) * SIZE :]


def read_path(path: bytes) -> list[tuple[bytes, bytes]]:
    """Siblings on the left and on the right, level by level upwards."""
    out, at = [], 0
    while at < len(path):
        own, others = path[at], path[at + 1]
        left = at + 2 + own * SIZE
        end = at + 2 + others * SIZE
        out.append((path[at + 2 : left], path[left:end]))
        at = end
    return out


def fold_path(digest: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    """The root that a digest and its siblings lead to."""
    for left, right in path:
        digest = _digest(left + digest + right)
    return digest


def _merged(store: NodeStore, stage: int, above: DataFrame, more: list[str]) -> DataFrame:
    """Nodes of ``STEP`` levels beside the paths of their blocks, one block after the other, from the top down.

    ``above`` has ``tree, block, path, subroot``; ``more`` are further columns of level 0.
    """
    kinds = {f.name: f.dataType for f in store.levels[0].schema}
    bottom = STEP * stage
    rows = above.select("tree", "block", F.lit(PATH).alias("level"), F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("n"), F.col("subroot").alias("digest"), "path", *[F.lit(None).cast(kinds[c]).alias(c) for c in more])
    for k in range(bottom, min(bottom + STEP, len(store.levels))):
        level = store.levels[k] if k == bottom else store.levels[k].filter("n > 1")
        own = [F.col(c) if k == 0 else F.lit(None).cast(kinds[c]).alias(c) for c in more]
        rows = rows.unionByName(level.select("tree", F.shiftright("pos", SHIFT * (bottom + STEP - k)).alias("block"), F.lit(k - bottom).alias("level"), "pos", "n", "digest", F.lit(None).cast("binary").alias("path"), *own))
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", F.desc("level"), "pos")


class _Block:
    """The nodes of one block while it passes: its path from above and its inner levels."""

    def __init__(self, key: tuple[int, int]):
        self.key = key
        self.path, self.subroot, self.above = b"", b"", []
        self.inner: dict[tuple[int, int], list[tuple[int, bytes]]] = {}
        self.known: dict[tuple[int, int], bytes] = {}

    def upper(self, pos: int) -> list[tuple[bytes, int, int, int]]:
        """For a group of level 0 at ``pos``: runs of the inner levels, own place there, level and group."""
        out = []
        for level in range(1, STEP):
            pos >>= SHIFT
            run = self.inner.get((level, pos >> SHIFT))
            if run is None:
                break
            out.append((b"".join(d for _, d in run), pos - run[0][0], level, pos >> SHIFT))
        return out


def _blocks(batches: Iterator[pa.RecordBatch], extra: int) -> Iterator[tuple[_Block, list[tuple]]]:
    """(block, run of siblings at the bottom) in order; a run's rows are (pos, n, digest, further columns)."""
    block: _Block | None = None
    run: list[tuple] = []
    for batch in batches:
        for tree, under, level, pos, n, digest, path, *more in zip(*(c.to_pylist() for c in batch.columns)):
            if block is None or block.key != (tree, under):
                if run:
                    yield block, run
                    run = []
                block = _Block((tree, under))
            if level == PATH:
                block.path, block.subroot, block.above = path, digest, read_path(path)
            elif level:
                block.inner.setdefault((level, pos >> SHIFT), []).append((pos, digest))
            else:
                if run and run[0][0] >> SHIFT != pos >> SHIFT:
                    yield block, run
                    run = []
                run.append((pos, n, digest, *more))
    if run:
        yield block, run


def _paths(store: NodeStore, stage: int, above: DataFrame) -> DataFrame:
    """``tree, pos, path, subroot`` for the nodes of the lowest level of a stage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for block, siblings in _blocks(batches, 0):
            whole = b"".join(r[2] for r in siblings)
            upper = b"".join(_one_level(inner, own) for inner, own, _, _ in block.upper(siblings[0][0])) + block.path
            for i, (pos, n, _) in enumerate(siblings):
                held.append((block.key[0], pos, (_one_level(whole, i) if n > 1 else b"") + upper, block.subroot))
            if len(held) >= 2000:
                yield batch_of(held)
                held = []
        yield batch_of(held)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["tree", "pos", "path", "subroot"])

    return _merged(store, stage, above, []).mapInArrow(run, "tree long, pos long, path binary, subroot binary")


def _above(store: NodeStore, stage: int, roots: DataFrame, upper: DataFrame | None) -> DataFrame:
    """Paths of the blocks of a stage: of roots that lie in it, and what the stage before gave for the others."""
    own = roots.filter(F.col("height").between(STEP * stage, STEP * stage + STEP - 1)).select("tree", F.lit(0).cast("long").alias("block"), "path", F.col("digest").alias("subroot"))
    return own if upper is None else own.unionByName(upper.select("tree", F.col("pos").alias("block"), "path", "subroot"))


def _down_to(store: NodeStore, roots: DataFrame) -> DataFrame:
    """Paths of the blocks of the lowest stage; ``roots`` has ``tree, height, digest, path``."""
    upper = None
    for stage in range((len(store.levels) - 1) // STEP, 0, -1):
        upper = written(_paths(store, stage, _above(store, stage, roots, upper)), "merkle-paths")
    return _above(store, 0, roots, upper)


def manifest(df: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """``id_col, leaf, subroot, root, proof_sha256, folded_root, verified`` for each row."""
    kind = df.schema[id_col].dataType
    leaves = written(_leaves(df, fields, id_col, source_col, text_col), "merkle-leaves")
    placed = row_numbers(leaves, ["source", "id", "leaf"], "rank")
    sources = written(placed.groupBy("source").agg(F.min("rank").alias("tree"), F.count("*").alias("n")), "merkle-sources")
    if sources.count() <= BROADCAST_ROWS:
        placed = placed.join(F.broadcast(sources.withColumnRenamed("source", "own")), F.col("source").eqNullSafe(F.col("own")))
    else:  # by source and stretch of ranks, so that a hot source isn't one key
        stretch = F.floor(F.col("rank") / 1_000_000)
        parts = sources.select(F.col("source").alias("own"), "tree", "n", F.explode(F.sequence(F.floor(F.col("tree") / 1_000_000), F.floor((F.col("tree") + F.col("n") - 1) / 1_000_000))).alias("stretch"))
        placed = placed.join(parts, F.col("source").eqNullSafe(F.col("own")) & (stretch == F.col("stretch")))
    store = NodeStore(placed.select("tree", (F.col("rank") - F.col("tree")).alias("pos"), "n", F.col("leaf").alias("digest"), "id", "altered"))

    roots = written(store.roots(), "merkle-roots")
    tops = row_numbers(roots.select("tree", "digest"), ["tree"], "pos")
    number = roots.count()
    top = NodeStore(tops.select(F.lit(0).cast("long").alias("tree"), "pos", F.lit(number).cast("long").alias("n"), "digest", F.col("tree").alias("of")))
    root = (top.roots().select("digest").first() or [b""])[0]  # one row
    crown = top.roots().withColumn("path", F.lit(b""))
    above = _down_to(top, crown)
    path_of = _paths(top, 0, above).join(tops.select("pos", F.col("tree").alias("of")), "pos").select(F.col("of").alias("tree"), "path")
    roots = written(roots.join(path_of, "tree"), "merkle-roots")

    hex_root = bytes(root).hex()

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for block, siblings in _blocks(batches, 2):
            whole = b"".join(r[2] for r in siblings)
            upper = block.upper(siblings[0][0])
            alone = siblings[0][1] == 1
            beyond = [(run[: own * SIZE], run[(own + 1) * SIZE :]) for run, own, _, _ in upper] + block.above
            text = b"".join(a + b for a, b in beyond).hex().encode()
            folded = None  # of a leaf that is what the store has: alike for all of a run
            for i, (_, _, digest, name, altered) in enumerate(siblings):
                left, right = (b"", b"") if alone else (whole[: i * SIZE], whole[(i + 1) * SIZE :])
                proof = hashlib.sha256((left + right).hex().encode() + text).hexdigest()
                path = beyond if alone else [(left, right), *beyond]
                if altered is not None and altered != digest:
                    end = fold_path(altered, path)
                else:
                    folded = end = folded or fold_path(digest, path)
                held.append((name, digest.hex(), block.subroot.hex(), hex_root, proof, end.hex(), end == root))
            if len(held) >= 4000:
                yield batch_of(held)
                held = []
        yield batch_of(held)

    names = ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [[]] * 7
        kinds = [id_kind, *[pa.string()] * 5, pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    from pyspark.sql.pandas.types import to_arrow_type

    id_kind = to_arrow_type(kind)
    schema = T.StructType([T.StructField("id", kind), *(T.StructField(n, T.StringType()) for n in names[1:-1]), T.StructField("verified", T.BooleanType())])
    proven = _merged(store, 0, _down_to(store, roots), ["id", "altered"]).mapInArrow(prove, schema)
    return proven.withColumnRenamed("id", id_col)
