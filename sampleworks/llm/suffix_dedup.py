"""Operator 4: removal of repeated passages by longest-previous-factor arrays.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document with a smaller id. Strings are
judged on the input and never cross documents.

1. Of equal texts only the first (smallest id) is looked into; the others go whole if they hold one such string.
2. Every string has an anchor, the run of ``ANCHOR`` bytes in it with the smallest hash, so equal strings
   have equal anchors. Anchors found in one document only are done with. A task sends one row for an anchor that many of its
   documents hold.
3. For the others the context, all bytes of the strings of one anchor occurrence, is sent to where its anchor
   is. Equal contexts are folded inside each task first: all but the one with the smallest id go.
4. The strings of the contexts of an anchor are put into suffix order, with the common prefixes of neighbours. The
   previous and the next position of a smaller document in that order give each string's longest previous
   factor: the larger of the two smallest common prefixes on the way there. Where it reaches ``LENGTH``, the string goes.
   Factors are followed to that length, where the decision falls. Equal contexts stand in the order as one.
5. An anchor with more than ``HOT`` occurrences isn't gathered: its contexts are split into their strings, which go by
   their own 128-bit digests, folded alike, so that no task holds a hot passage's surroundings. All strings of one
   digest are one run of the suffix order, in which the previous smaller document is the smallest one.
6. Ranges of a document are merged and cut out.

Null texts are empty. A row without an id is kept whole and removes nothing. Rows with the same id never remove
each other, so repeated rows are treated alike; of several texts with one id each is a document of its own. An empty
table gives an empty result. Long texts are cut into overlapping stretches for step 2. ``removed`` reads only the
named columns; ``deduplicated`` returns all columns. Broadcasts happen only behind a count of rows and ranges.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sampleworks.llm._shared import giving_back, written
from sampleworks.llm._words import BASE, blocks, mix

LENGTH = 50
ANCHOR = 20
STRETCH = 1 << 22
BROADCAST_ROWS = 1_000_000
HOT = 8192  # occurrences above which an anchor is split into strings
MANY = 16  # occurrences of an anchor, among those that a task holds at once, above which they make one row
HELD_ANCHORS = 300_000
PART_ROWS = 1_000  # rows whose strings are put into suffix order at once, if their anchors don't have more
FOLDED = 100_000  # contexts and strings that a task folds before it sends them
PLACE_BITS = np.uint64(24)  # low bits hold the place in a stretch while the smallest hash is looked for
DIGEST = 16  # bytes that stand for a string of a hot anchor
RANGE_BYTES, ROW_BYTES, BROADCAST_BYTES = 16, 48, 64 << 20  # of the ranges that are broadcast


def anchors(data: np.ndarray, offsets: np.ndarray, bits: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, key of ``bits``, first string and end of last string for each run of strings with one anchor; places count from each text's start."""
    parts = [_stretch(data, offsets, at, bits) for at in range(0, max(len(data) - LENGTH + 1, 0), STRETCH)]
    if not parts:
        return (np.zeros(0, np.int64),) * 4
    return tuple(np.concatenate(p) for p in zip(*parts))


def _stretch(data: np.ndarray, offsets: np.ndarray, at: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    piece = data[at : at + STRETCH + LENGTH - 1]
    n = len(piece) - ANCHOR + 1
    code = np.zeros(n, np.uint64)
    for i in range(ANCHOR):
        code = code * np.uint64(BASE) + piece[i : n + i] + np.uint64(1)
    hashes = mix(code)
    least = hashes >> PLACE_BITS << PLACE_BITS | np.arange(n, dtype=np.uint64)
    width, wanted = 1, LENGTH - ANCHOR + 1
    while 2 * width <= wanted:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    strings = len(piece) - LENGTH + 1
    least = np.minimum(least[:strings], least[wanted - width : wanted - width + strings])
    place = np.arange(at, at + strings)
    owner = np.searchsorted(offsets, place, "right") - 1
    whole = place + LENGTH <= offsets[owner + 1]
    least, place, owner = least[whole], place[whole], owner[whole]
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])
    begin = np.flatnonzero(new)
    last = np.concatenate((begin[1:], [len(least)])) - 1
    own = owner[begin]
    base = offsets[own]
    key = hashes[(least[begin] & np.uint64((1 << 24) - 1)).astype(np.int64)] >> np.uint64(64 - bits)
    return own, key.view(np.int64), place[begin] - base, place[last[: len(begin)]] + LENGTH - base


def _smaller_before(doc: np.ndarray, common: np.ndarray) -> np.ndarray:
    """For each position the common prefix with the nearest earlier one of a smaller document; 0 if there is none.

    ``common[i]`` is what positions i - 1 and i share. Each position points to an earlier one beyond which only smaller
    documents can matter, and carries the least common prefix on the way; pointers to larger documents jump ahead.
    """
    n = len(doc)
    to, least = np.arange(n) - 1, common.copy()
    while True:
        on = np.flatnonzero((to >= 0) & (least > 0) & (doc[to] >= doc))
        if not len(on):
            break
        over = to[on]
        least[on], to[on] = np.minimum(least[on], least[over]), to[over]
    return np.where(to >= 0, least, 0)


def previous_factors(data: np.ndarray, begin: np.ndarray, group: np.ndarray, doc: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """The longest previous factor, up to ``length``, of the strings of ``length`` bytes at ``begin``: what each has in
    common with a string of a smaller document in its group."""
    n = len(begin)
    if not n:
        return np.zeros(0, np.int64)
    strings = np.zeros((n, -(-length // 8) * 8), np.uint8)
    strings[:, :length] = data[begin[:, None] + np.arange(length)]
    words = strings.view(">u8").astype(np.uint64)
    order = np.lexsort((*words.T[::-1], group))
    strings, group, doc = strings[order, :length], group[order], doc[order]
    same = strings[1:] == strings[:-1]
    common = np.zeros(n + 1, np.int64)  # the last entry closes the order on the way back
    common[1:n] = np.where(same.all(axis=1), length, same.argmin(axis=1)) * (group[1:] == group[:-1])
    found = np.zeros(n, np.int64)
    found[order] = np.maximum(_smaller_before(doc, common[:n]), _smaller_before(doc[::-1], common[:0:-1])[::-1])
    return found


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for low, high in sorted(ranges):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def _text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit(""))).cast("string").substr(-9, 9).cast("int")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


RANGE = "doc long, t int, low int, high int"
CANDIDATE = "key long, doc long, t int, low int, more binary, context binary"


def _digest(string: bytes) -> bytes:
    return hashlib.blake2b(string, digest_size=DIGEST).digest()


def _key_bits(octets: int) -> int:
    """Bits of an anchor's key, in whole bytes: a few hundred times as many keys as there can be anchors."""
    return min(64, -(-((octets // 16).bit_length() + 8) // 8) * 8)


def _shared_anchors(rows: DataFrame, hot: int, bits: int) -> DataFrame:
    """``doc, keys, hot``: the anchors of each document that others have too, and those with more than ``hot`` occurrences."""

    @giving_back
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column(0).to_numpy()
            keys, owners, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
            for first, _, data, offsets in blocks(batch.column(1)):
                owner, key, _, _ = anchors(data, offsets, bits)
                keys.append(key)
                owners.append(docs[first + owner])
                n += len(key)
                if n >= HELD_ANCHORS:
                    yield from rows_of(np.concatenate(keys), np.concatenate(owners))
                    keys, owners, n = keys[:1], owners[:1], 0
            yield from rows_of(np.concatenate(keys), np.concatenate(owners))

    def rows_of(key: np.ndarray, doc: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(key, kind="stable")
        new = np.ones(len(key), bool)
        new[1:] = key[order][1:] != key[order][:-1]
        begin = np.flatnonzero(new)
        times = np.diff(np.concatenate((begin, [len(key)])))
        rest = order[np.repeat(times > MANY, times)]
        plain = np.ones(len(key), bool)
        plain[rest] = False
        # in the order of texts, which keeps documents together
        yield out(key[plain], doc[plain], pa.nulls(int(plain.sum()), pa.list_(pa.int64())))
        key, doc = key[rest], doc[rest]
        order = np.lexsort((doc, key))
        key, doc, times = key[order], doc[order], times[times > MANY]
        begin = np.cumsum(times) - times
        # last document, occurrences and the documents of each key
        once = np.ones(len(key), bool)
        once[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
        n = np.add.reduceat(once, begin) if len(begin) else begin
        starts = np.cumsum(n + 2) - (n + 2)
        values = np.zeros(int((n + 2).sum()), np.int64)
        values[starts], values[starts + 1] = doc[begin + times - 1], times
        values[np.repeat(starts + 2, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] = doc[once]
        ends = np.concatenate((starts, [len(values)])).astype(np.int32)
        yield out(key[begin], doc[begin], pa.ListArray.from_arrays(pa.array(ends), pa.array(values)))

    def out(key: np.ndarray, doc: np.ndarray, more: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(doc), more], names=["key", "doc", "more"])

    here = Window.partitionBy("key")
    # dealt before the window, so that what the window takes from a row is worked out after rows have travelled
    found = rows.select("doc", "text").mapInArrow(find, "key long, doc long, more array<long>").repartition("key")
    last, times = F.coalesce(F.col("more")[0], F.col("doc")), F.coalesce(F.col("more")[1], F.lit(1))
    found = found.withColumns({"low": F.min("doc").over(here), "high": F.max(last).over(here), "all": F.sum(times).over(here)}).filter("low <> high")
    docs = F.coalesce(F.slice("more", 3, F.size("more") - 2), F.array("doc"))
    each = found.select("key", "all", F.explode(docs).alias("doc"))
    return each.groupBy("doc").agg(F.collect_list("key").alias("keys"), F.collect_list(F.when(F.col("all") > hot, F.col("key"))).alias("hot"))


class _Folded:
    """Candidates of one task, each string or context once, and ranges that are known to go."""

    def __init__(self) -> None:
        self.least: dict[tuple[int, bytes], tuple[int, int, list[int]]] = {}
        self.gone: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self.apart: list[tuple] = []
        self.waiting = 0

    def add(self, key: int, context: bytes, size: int, doc: int, t: int, low: int) -> None:
        held = self.least.get((key, context))
        if held is None:
            self.least[key, context] = doc, t, [low]
        elif held[0] == doc and held[1] == t:  # again in the same text: what becomes of one becomes of all
            held[2].append(low)
        elif held[0] == doc:  # another text with this id: both stay candidates
            self.apart.append((key, doc, t, low, None, context))
        elif held[0] < doc:
            self._go(doc, t, [low], size)
        else:
            self._go(held[0], held[1], held[2], size)
            self.least[key, context] = doc, t, [low]

    def _go(self, doc: int, t: int, lows: list[int], size: int) -> None:
        self.gone.setdefault((doc, t), []).extend((low, low + size) for low in lows)
        self.waiting += len(lows)

    def rows(self, whole: bool) -> Iterator[pa.RecordBatch]:
        """Merged ranges (without a key, the length as context), and the candidates too if ``whole``."""
        held = [(None, doc, t, low, None, (high - low).to_bytes(4, "little")) for (doc, t), ranges in self.gone.items() for low, high in merged(ranges)]
        self.gone, self.waiting = {}, 0
        held += self.apart
        self.apart = []
        yield self._batch(held)
        if whole:
            held = []
            for (key, context), (doc, t, lows) in self.least.items():
                held.append((key, doc, t, lows[0], np.array(lows[1:], "<i4").tobytes() if len(lows) > 1 else None, context))
                if len(held) >= 20_000:
                    yield self._batch(held)
                    held = []
            yield self._batch(held)
            self.least = {}

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 6, kinds)], names=["key", "doc", "t", "low", "more", "context"])


def _candidates(rows: DataFrame, hot: int | None = None) -> DataFrame:
    """What must be compared under one key, folded (``CANDIDATE``); without a key, ranges that go.

    ``more`` holds further places of the same context in the same text.
    """
    bits = _key_bits(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0)

    @giving_back
    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folded = _Folded()
        for batch in batches:
            docs, texts, keys, hots = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3), batch.column(4)
            for first, _, data, offsets in blocks(batch.column(2)):
                owner, key, low, high = anchors(data, offsets, bits)
                edges = np.searchsorted(owner, np.arange(len(offsets)))
                for i in range(len(offsets) - 1):
                    part = slice(edges[i], edges[i + 1])
                    wanted = np.isin(key[part], keys[first + i].values.to_numpy())
                    row, text = first + i, data[offsets[i] : offsets[i + 1]].tobytes()
                    doc, t, split = docs[row], texts[row], set(hots[row].as_py())
                    for k, a, b in zip(key[part][wanted].tolist(), low[part][wanted].tolist(), high[part][wanted].tolist()):
                        if k not in split:
                            folded.add(k, text[a:b], b - a, doc, t, a)
                            continue
                        for at in range(a, b - LENGTH + 1):
                            digest = _digest(text[at : at + LENGTH])
                            folded.add(int.from_bytes(digest[:8], "little", signed=True), digest, LENGTH, doc, t, at)
                    if folded.waiting >= 200_000 or len(folded.least) >= FOLDED:
                        yield from folded.rows(len(folded.least) >= FOLDED)
        yield from folded.rows(True)

    lists = _shared_anchors(rows, HOT if hot is None else hot, bits)
    return rows.join(lists, "doc").select("doc", "t", "text", "keys", "hot").mapInArrow(contexts, CANDIDATE)


def _ranges(rows: DataFrame) -> DataFrame:
    """Ranges to remove from first copies; ``rows`` has ``doc, t, text``."""
    placed = _candidates(rows)
    placed = placed.withColumn("spread", F.coalesce("key", F.xxhash64("doc", "low"))).repartition("spread").sortWithinPartitions("key", "context", "doc").drop("spread")

    @giving_back
    def factors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of one key; hot anchors are split, so these are few
        for batch in batches:
            if not batch.num_rows:
                continue
            last = batch.column(0)[batch.num_rows - 1].as_py()
            cut = batch.num_rows
            if last is not None:
                key = batch.column(0)
                cut = key.null_count + int(np.searchsorted(key.drop_null().to_numpy(), last))
            if cut:
                yield from _in_parts(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from _in_parts(pa.Table.from_batches(held))

    return placed.mapInArrow(factors, RANGE)


def _in_parts(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """:func:`_group_factors` over runs of whole groups of about ``PART_ROWS`` rows: a row becomes some fifty strings while it is compared."""
    key = table.column("key").combine_chunks()
    none = key.null_count  # they come first, and each is a group of its own
    groups = np.concatenate((np.arange(0, none, PART_ROWS), none + np.flatnonzero(np.diff(key.drop_null().to_numpy(), prepend=np.int64(0)) != 0), [len(key)]))
    at = 0
    while at < len(key):
        end = max(int(groups[np.searchsorted(groups, at + PART_ROWS, "right") - 1]), int(groups[np.searchsorted(groups, at, "right")]))
        yield from _group_factors(table.slice(at, end - at))
        at = end


def _group_factors(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Ranges that go, for whole groups of contexts sorted by key, context and document (no key: the range as it is)."""
    if not table.num_rows:
        return
    key, doc, t, low, more, context = (c.combine_chunks() for c in table.columns)
    doc, t = doc.to_numpy(), t.to_numpy()
    n, known = len(doc), ~key.is_null().to_numpy(zero_copy_only=False)
    key = key.fill_null(0).to_numpy()
    sizes = np.frombuffer(context.buffers()[1], np.int32)[context.offset : context.offset + n + 1].astype(np.int64)
    data = np.frombuffer(context.buffers()[2], np.uint8)[sizes[0] : sizes[-1]]
    begin, length = sizes[:-1] - sizes[0], np.diff(sizes)
    # all places of each row
    again = [np.frombuffer(m.as_buffer(), "<i4") if m.is_valid else () for m in more] if more.null_count < n else [()] * n
    places = 1 + np.array([len(a) for a in again])
    lows = np.concatenate([x for own, a in zip(low.to_numpy(), again) for x in ([own], a) if len(x)]).astype(np.int64) if more.null_count < n else low.to_numpy().astype(np.int64)
    head_of = np.concatenate(([0], np.cumsum(places)))
    out: list[tuple[np.ndarray, ...]] = []

    def go(rows: np.ndarray, at: np.ndarray, until: np.ndarray) -> None:
        times = places[rows]
        of = np.repeat(np.arange(len(rows)), times)
        here = lows[np.repeat(head_of[rows] - np.concatenate(([0], np.cumsum(times)[:-1])), times) + np.arange(times.sum())]
        out.append((doc[rows][of], t[rows][of], here + at[of], here + until[of]))

    plain = np.flatnonzero(~known)
    if len(plain):
        go(plain, np.zeros(len(plain), np.int64), np.frombuffer(b"".join(context.take(pa.array(plain)).to_pylist()), "<u4").astype(np.int64))
    rows = np.flatnonzero(known)
    if len(rows):
        same = np.zeros(n, bool)
        same[1:] = pc.equal(context.slice(1), context.slice(0, n - 1)).to_numpy(zero_copy_only=False) & (key[1:] == key[:-1]) & known[:-1]
        head = rows[np.flatnonzero(~same[rows])]
        first = head[np.searchsorted(head, rows, "right") - 1]
        later = rows[doc[rows] > doc[first]]  # an equal context, or a string of the same digest, in a smaller document
        go(later, np.zeros(len(later), np.int64), np.where(length[later] == DIGEST, LENGTH, length[later]))
        rest = rows[(doc[rows] == doc[first]) & (length[rows] > DIGEST)]
        _, of, members = np.unique(key[rest], return_inverse=True, return_counts=True)
        rest = rest[members[of] > 1]
        if len(rest):
            strings = length[rest] - LENGTH + 1
            row = np.repeat(np.arange(len(rest)), strings)
            at = np.arange(strings.sum()) - np.repeat(np.cumsum(strings) - strings, strings)
            found = np.flatnonzero(previous_factors(data, begin[rest][row] + at, key[rest][row], doc[rest][row]) >= LENGTH)
            row, at = row[found], at[found]
            # neighbouring strings make one range
            new = np.ones(len(found), bool)
            new[1:] = (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)
            start = np.flatnonzero(new)
            stop = np.concatenate((start[1:], [len(found)]))[: len(start)] - 1
            if len(start):
                go(rest[row[start]], at[start], at[stop] + LENGTH)
    if out:
        columns = [np.concatenate(c) for c in zip(*out)]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1]), *(pa.array(c.astype(np.int32)) for c in columns[2:])], names=["doc", "t", "low", "high"])


def _merged_ranges(found: DataFrame) -> DataFrame:
    """``doc, t, ranges`` with the ranges of each text merged and in order."""
    placed = found.repartition("doc", "t").sortWithinPartitions("doc", "t", "low")

    @giving_back
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 4
        for batch in batches:
            if not batch.num_rows:
                continue
            doc, t, low, high = (np.concatenate((h, c.to_numpy().astype(np.int64))) for h, c in zip(held, batch.columns))
            cut = int(np.flatnonzero((doc != doc[-1]) | (t != t[-1])).max(initial=-1)) + 1
            if cut:
                yield out(doc[:cut], t[:cut], low[:cut], high[:cut])
            # the last text may go on; what is held of it is merged
            held = joined(doc[cut:], t[cut:], low[cut:], high[cut:])
        if len(held[0]):
            yield out(*held)

    def joined(doc: np.ndarray, t: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[np.ndarray]:
        text = np.concatenate(([0], np.cumsum((doc[1:] != doc[:-1]) | (t[1:] != t[:-1]))))
        reach = np.maximum.accumulate(high + (text << 32))
        new = np.ones(len(doc), bool)
        new[1:] = low[1:] + (text[1:] << 32) > reach[:-1]
        begin = np.flatnonzero(new)
        end = np.concatenate((begin[1:], [len(doc)])) - 1
        return [doc[begin], t[begin], low[begin], reach[end] - (text[end] << 32)]

    def out(*columns: np.ndarray) -> pa.RecordBatch:
        doc, t, low, high = joined(*columns)
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (t[1:] != t[:-1])
        begin = np.flatnonzero(new)
        pairs = pa.StructArray.from_arrays([pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))], names=["low", "high"])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate((begin, [len(doc)])).astype(np.int32)), pairs)
        return pa.RecordBatch.from_arrays([pa.array(doc[begin]), pa.array(t[begin].astype(np.int32)), lists], names=["doc", "t", "ranges"])

    return placed.mapInArrow(merge, "doc long, t int, ranges array<struct<low:int,high:int>>")


def _with_ranges(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``df`` as ``row`` beside ``first`` (smallest id of the text) and ``ranges`` (of its first copy)."""
    rows = df.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("doc"), _text_key(F.col(text_col)).alias("t"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("digest"))
    digests = rows.filter("doc IS NOT NULL").groupBy("digest").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
    copies = written(digests.filter("first <> last"), "copies")
    rows = rows.join(_small(copies), "digest", "left").withColumn("first", F.coalesce("first", "doc"))
    originals = rows.filter("doc = first").select("doc", "t", F.coalesce(F.col("row")[text_col], F.lit("")).alias("text"))
    ranges = written(_merged_ranges(_ranges(originals)), "ranges")
    size = ranges.agg(F.count("*") * ROW_BYTES + F.coalesce(F.sum(F.size("ranges")), F.lit(0)) * RANGE_BYTES).first()[0]
    if size <= min(BROADCAST_BYTES, BROADCAST_ROWS * ROW_BYTES):
        ranges = F.broadcast(ranges)
    return rows.join(ranges, ["doc", "t"], "left")


def _cut(raw: bytes, is_copy: bool, ranges: list) -> tuple[bytes, int, int]:
    """What stays, number of bytes removed and of runs."""
    if is_copy and len(raw) >= LENGTH:
        return b"", len(raw), 1
    if is_copy or not ranges:
        return raw, 0, 0
    kept, at = [], 0
    for r in ranges:
        kept.append(raw[at : r["low"]])
        at = r["high"]
    kept.append(raw[at:])
    stays = b"".join(kept)
    return stays, len(raw) - len(stays), len(ranges)


def removed(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_bytes, n_removed, n_spans, kept_sha256`` for each document."""
    rows = _with_ranges(df.select(id_col, text_col), id_col, text_col)
    rows = rows.select(F.col("row")[id_col].alias("id"), F.coalesce(F.col("row")[text_col], F.lit("")).cast("binary").alias("raw"), F.coalesce(F.col("doc") > F.col("first"), F.lit(False)).alias("copy"), "ranges")
    kind = df.schema[id_col].dataType

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw, is_copy, ranges in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                raw = raw.as_py()
                stays, gone, runs = _cut(raw, is_copy, ranges)
                rows.append((len(raw), gone, runs, hashlib.sha256(stays).hexdigest()))
            columns = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    schema = T.StructType([T.StructField("id", kind), *(T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType())])
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def deduplicated(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` without the repeated passages of ``text_col``; bytes of a character cut in two go with it."""
    rows = _with_ranges(df, id_col, text_col)

    @F.pandas_udf("string")
    def cut(rows: pd.DataFrame) -> pd.Series:
        return pd.Series([_cut(bytes(r.raw), r.copy, [] if r.ranges is None else list(r.ranges))[0].decode(errors="ignore") for r in rows.itertuples()], dtype=object)

    text = F.col("row")[text_col]
    stays = F.when(F.col("ranges").isNull() & ~F.col("copy"), text).otherwise(cut(F.struct(F.coalesce(text, F.lit("")).cast("binary").alias("raw"), "copy", "ranges")))
    rows = rows.withColumn("copy", F.coalesce(F.col("doc") > F.col("first"), F.lit(False))).withColumn("stays", stays)
    return rows.select(*[F.when(text.isNotNull(), F.col("stays")).alias(c) if c == text_col else F.col("row")[c].alias(c) for c in df.columns])
