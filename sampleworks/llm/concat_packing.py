"""Operator 12: packing by concatenation, cut into windows of one length.

All documents, each with an end id, stand one after the other in the order of tasks and of rows in them. The first pass
writes the ids of each document with its place in its task, and sums up each task's tokens; a running sum over tasks gives
every task its place in the whole. The second pass knows where each document starts and cuts it where windows of
``capacity`` tokens begin: a document over a border leaves a piece on either side, in one task or in two, and the
window's number joins them. No document is sent anywhere.

What is left after the last whole window is cut into powers of two, the largest first. A sequence as long as a power of two
isn't padded, so no sequence is.

Null texts are empty: the end id alone. A document longer than a window fills whole windows. Repeated rows and rows without
an id are documents of their own. An empty table gives an empty result. Only the named columns are read. What reaches the
driver is one number for each task of the first pass.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sampleworks.llm._shared import written

CAPACITY = 1024
HELD_TOKENS = 1 << 20  # of an Arrow batch that the first pass writes


class ByteTokenizer:
    """Ids of a byte-level ``tokenizers`` file.

    If the file's merges are in the order of their ids, its vocabulary serves as ranks for ``tiktoken``, which is several
    times as fast. It takes texts of the characters that were held against the file at the start; any other text, any that
    holds the literal of an added token, and all texts if the file differs, go through the library whole.
    """

    COMMON = "\t\n\v\f\r -~\xa0-ɏΑ-ΡΣ-ϿЀ-ҁҊ-ԯ"
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        literals = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, literals))) if literals else None
        self.common = re.compile(f"[{self.COMMON}]*")
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.fast = self._ranked(path, set(literals))
        if self.fast and not self._alike():
            self.fast = None

    def _ranked(self, path: str, added: set[str]):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocab, merges = model["vocab"], model.get("merges", [])
        ids = [vocab.get("".join(m.split(" ") if isinstance(m, str) else m)) for m in merges]
        if model["type"] != "BPE" or None in ids or ids != sorted(ids):
            return None
        # the printable bytes stand for themselves, the others for the characters from 256
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in plain)}
        try:
            ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if token not in added}
        except KeyError:
            return None
        return tiktoken.Encoding("ranks", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _alike(self) -> bool:
        characters = [chr(c) for c in range(0x530) if self.common.fullmatch(chr(c))]
        for other in ("a", "1", " ", "'s", "'", "!", "É", "\n"):
            probe = " ".join(f"{c}{other}{c} {other}{c}{c}{other}" for c in characters)
            if self.fast.encode_ordinary(probe) != self.tokenizer.encode(probe, add_special_tokens=False).ids:
                return False
        return True

    def ids(self, text: str) -> np.ndarray:
        if self.fast is None or not self.common.fullmatch(text) or self.added and self.added.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind)
        return np.array(self.fast.encode_ordinary(text), self.kind)


@lru_cache(maxsize=2)
def byte_tokenizer(path: str) -> ByteTokenizer:
    return ByteTokenizer(path)


def encoded(df: DataFrame, tokenizer_path: str, *, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, part, before, tokens, wide, ids``: each document's ids, the task it is in and the tokens before it there."""
    names = ["id", "part", "before", "tokens", "wide", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = byte_tokenizer(tokenizer_path)
        end = np.array([end_id], own.kind)
        part, before = TaskContext.get().partitionId(), 0
        wide = own.kind == "<u4"
        for batch in batches:
            first, rows, held = 0, [], 0
            for i, text in enumerate(batch.column(1)):
                ids = np.concatenate((own.ids(text.as_py() or ""), end))
                rows.append((part, before, len(ids), wide, ids.tobytes()))
                before += len(ids)
                held += len(ids)
                if held >= HELD_TOKENS:
                    yield out(batch.column(0).slice(first, i + 1 - first), rows)
                    first, rows, held = i + 1, [], 0
            yield out(batch.column(0).slice(first), rows)

    def out(own: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [[]] * 5
        return pa.RecordBatch.from_arrays([own, *(pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())))], names=names)

    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("part", T.IntegerType()), T.StructField("before", T.LongType()), T.StructField("tokens", T.LongType()), T.StructField("wide", T.BooleanType()), T.StructField("ids", T.BinaryType())])
    return df.select(id_col, text_col).mapInArrow(run, schema)


def tail_cuts(total: int, capacity: int = CAPACITY) -> np.ndarray:
    """Where the sequences after the last whole window begin: powers of two, the largest first, that add up to the rest."""
    at, rest = total - total % capacity, total % capacity
    starts = []
    while rest:
        starts.append(at)
        step = 1 << (rest.bit_length() - 1)
        at, rest = at + step, rest - step
    return np.array(starts, np.int64)


def borders(start: int, end: int, tail: np.ndarray, whole: int, capacity: int) -> np.ndarray:
    """Where the pieces of a document that takes the tokens from ``start`` to ``end`` begin, and ``end``."""
    grid = np.arange(-(-(start + 1) // capacity) * capacity, min(end, whole + 1), capacity)
    own = tail[(tail > max(start, whole)) & (tail < end)]
    return np.concatenate(([start], grid[grid < end], own, [end]))


def concatenate(df: DataFrame, tokenizer_path: str, *, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset`` for every piece of every document."""
    rows = written(encoded(df, tokenizer_path, end_id=end_id, id_col=id_col, text_col=text_col), "encoded")
    totals = sorted((r.part, r.n) for r in rows.groupBy("part").agg(F.sum("tokens").alias("n")).collect())  # one row for each task
    offsets, total = [], 0
    for part, n in totals:
        offsets.append((part, total))
        total += n
    starts = F.broadcast(df.sparkSession.createDataFrame(offsets, "part int, base long"))  # one row for each task
    whole, tail = total - total % capacity, tail_cuts(total, capacity)
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, found = [], []
            for i, (at, tokens, wide, blob) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(1, 4)), batch.column(4))):
                ids = np.frombuffer(blob.as_buffer(), "<u4" if wide else "<u2").astype("<u4")
                edges = borders(at, at + tokens, tail, whole, capacity).tolist()
                for low, high in zip(edges, edges[1:]):
                    if low < whole:
                        sequence, offset = divmod(low, capacity)
                    else:
                        k = int(np.searchsorted(tail, low, "right")) - 1
                        sequence, offset = whole // capacity + k, low - int(tail[k])
                    take.append(i)
                    found.append((low - at, high - low, zlib.crc32(ids[low - at : high - at]), tokens, sequence, offset))
            columns = list(zip(*found)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take, pa.int64())), *(pa.array(c, pa.int64()) for c in columns)], names=names)

    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), *(T.StructField(n, T.LongType()) for n in names[1:])])
    placed = rows.join(starts, "part").select("id", (F.col("base") + F.col("before")).alias("at"), "tokens", "wide", "ids")
    return placed.mapInArrow(cut, schema).withColumnRenamed("id", id_col)
