"""Operator 5: best-fit packing with swap-based local search.

Texts become token ids, each document ends with one id more, and only documents longer than a sequence are
cut. Pieces are dealt evenly into groups of bounded size. In a group every piece, longest first, goes into the
fullest bin that still takes it; then the search works on the bins that aren't full. It tries to empty the
emptiest one: its pieces move into bins with room, change places one for one with shorter pieces, or two of
them change places with one, each exchange raising the sum of squared fills, until the bin is empty or nothing
helps. The emptiest bins of all groups (one at least, a sixteenth of the pieces at most) meet in the next
round, in half as many groups or fewer, until one group is left. So no task holds more than a group or a few
bins from before, and rounds grow with the logarithm of the input.

An empty or null text is one piece: the end id alone. Repeated rows are separate documents. Pieces are
numbered inside their task, so a hot id is dealt as evenly as any. An empty table gives an empty result. Only
the named columns are read.
"""

from __future__ import annotations

import json
import math
import os
import re
import zlib
from array import array
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sampleworks.llm._shared import giving_back, written

GROUP = 2048
NARROWING = 16
MEMO_ENTRIES = 400_000
END = "</w>"  # of the last token of a word
LONG_WORD = 256  # longer ones take tiktoken a time in the square of their length


class WordTokenizer:
    """Ids of a ``tokenizers`` file whose words are encoded on their own, with a memo of words.

    Texts of common characters are folded and cut into words here, as the file's normaliser and pre-tokeniser do, which
    is held against the file at the start. Any other text, any that holds the literal of an added token, and all texts if
    the file differs, go through the library whole.

    Words that the memo doesn't hold go through ``tiktoken``, many at once, with the file's vocabulary as ranks and a null
    byte, which no common text holds, for the end of a word. It merges any two neighbours whose bytes are a token, the library only
    pairs that the file lists. Both are the same if each token, merged from its bytes, is last put together from the pair that the
    file lists for it, which is tried for all tokens at the start. If one fails, and for very long words, the library encodes.
    """

    COMMON = re.compile("[\t\n\v\f\r -~¡-©«-±´-¸»¿-ķĹ-ľŁ-ňŊ-ž]*")
    LETTERS = "a-zªµºÀ-ÖØ-öø-ž"
    WORD = re.compile(f"[{LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\\s0-9{LETTERS}]+")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # in any case, as an added token may be looked for in the folded text
        self.added = re.compile("|".join(map(re.escape, added)), re.IGNORECASE) if added else None
        self.memo: dict[str, bytes] = {}
        self.alike = self._alike()
        self.fast, self.ends = self._ranked(path) if self.alike else (None, None)

    def _alike(self) -> bool:
        """Whether the file's normaliser and pre-tokeniser fold and cut common characters as is done here."""
        normalizer, cutter = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        if normalizer is None or cutter is None:
            return False
        common = [chr(c) for c in range(0x180) if self.COMMON.fullmatch(chr(c))]
        for other in ("a", "1", " ", "'s", "'", "!", "É"):
            probe = " ".join(f"{c}{other}{c} {other}{c}{c}{other}" for c in common if c.strip()) + "".join(f"{other}{c}{other}" for c in common if not c.strip())
            folded = normalizer.normalize_str(probe)
            cut = [folded[a:b] for _, (a, b) in cutter.pre_tokenize_str(folded)]
            if [w for w in cut if w.strip()] != self.WORD.findall(probe.lower()):
                return False
        return True

    def _ranked(self, path: str):
        """A ``tiktoken`` encoding of words that end in null bytes, and which ids end a word; None if it could differ from the file."""
        import tiktoken

        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != END or model.get("continuing_subword_prefix") or model.get("dropout") or model.get("ignore_merges"):
            return None, None
        vocab, merges = model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.get("merges", [])]
        # the printable bytes stand for themselves, the others for the characters from 256
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in plain)}
        single = [*byte_of, *(c + END for c in byte_of)]
        ids = [vocab.get("".join(m)) for m in merges]
        if None in ids or any(a >= b for a, b in zip(ids, ids[1:])) or any(c not in vocab for c in single) or ids and max(vocab[c] for c in single) >= ids[0] or len(vocab) != len(ids) + len(single):
            return None, None
        if not last_pairs_are_listed(merges):
            return None, None
        ranks = {}
        for token, i in vocab.items():
            core = token.removesuffix(END)
            ranks[bytes(map(byte_of.__getitem__, core)) + (b"\0" if core != token else b"")] = i
        if len(ranks) != len(vocab):
            return None, None
        ends = np.zeros(max(vocab.values()) + 1, bool)
        ends[[i for token, i in vocab.items() if token.endswith(END)]] = True
        return tiktoken.Encoding("words", pat_str="[^\\x00]*\\x00", mergeable_ranks=ranks, special_tokens={}), ends

    def _encoded(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Each word with its ids."""
        short = [w for w in words if len(w) <= LONG_WORD] if self.fast else []
        if short:
            ids = np.array(self.fast.encode_ordinary("\0".join(short) + "\0"), "<u4")
            blob, at = ids.tobytes(), 0
            for word, end in zip(short, (4 * np.flatnonzero(self.ends[ids]) + 4).tolist(), strict=True):
                yield word, blob[at:end]
                at = end
        others = [w for w in words if len(w) > LONG_WORD] if self.fast else words
        for word, e in zip(others, self.tokenizer.encode_batch_fast(others, add_special_tokens=False)):
            yield word, array("I", e.ids).tobytes()

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not self.alike or not self.COMMON.fullmatch(text) or self.added and self.added.search(text):
            return self._whole(text)
        words = self.WORD.findall(text.lower())
        get = self.memo.get
        parts = [get(w) for w in words]
        if None in parts:
            holes = [i for i, p in enumerate(parts) if p is None]
            missing = {words[i] for i in holes}
            if len(self.memo) + len(missing) > MEMO_ENTRIES:
                self.memo.clear()
            fresh = dict(self._encoded(list(missing)))
            self.memo.update(fresh)
            for i in holes:
                parts[i] = fresh[words[i]]
        return b"".join(parts)


def last_pairs_are_listed(merges: list[tuple[str, str]]) -> bool:
    """Whether each token, merged from its symbols by the pairs before its own, ends as the two halves that are listed for it."""
    rank = {pair: i for i, pair in enumerate(merges)}
    for own, (left, right) in enumerate(merges):
        token = left + right
        core = token.removesuffix(END)
        parts = list(core)
        if core != token:
            parts[-1] += END
        while len(parts) > 2:
            ranks = [rank.get(pair, own) for pair in zip(parts, parts[1:])]
            first = min(ranks)
            if first == own:
                return False
            at = ranks.index(first)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if parts != [left, right]:
            return False
    return True


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def pieces(df: DataFrame, tokenizer_path: str, *, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, piece, start, length, ids_crc32, deal``: every document in pieces; ``deal`` is a number drawn for the piece."""
    kind = df.schema[id_col].dataType
    names = ["id", "piece", "start", "length", "ids_crc32", "deal"]
    last = int(end_id).to_bytes(4, "little")

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = word_tokenizer(tokenizer_path)
        seen = TaskContext.get().partitionId() * 7919
        for batch in batches:
            take, rows = [], []
            for i, text in enumerate(batch.column(1)):
                ids = own.ids(text.as_py() or "") + last
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    take.append(i)
                    rows.append((piece, at // 4, len(part) // 4, zlib.crc32(part), seen))
                    seen += 1
            columns = list(zip(*rows)) or [[]] * 5
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=names)

    schema = T.StructType([T.StructField("id", kind), T.StructField("piece", T.IntegerType()), *(T.StructField(n, T.LongType()) for n in names[2:])])
    return df.select(id_col, text_col).mapInArrow(run, schema)


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers: longest item first, into the fullest bin that takes it."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # free space and bin, sorted
    for item in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[item])
        at = bisect_left(room, (size, -1))
        if at == len(room):
            free, where = capacity, len(bins)
            bins.append([])
        else:
            free, where = room.pop(at)
        bins[where].append(item)
        if free > size:
            insort(room, (free - size, where))
    return bins


def local_search(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Empty bins by moves and exchanges that raise the sum of squared fills, until no bin can be emptied."""
    size = lengths.tolist()
    fill = [sum(size[i] for i in b) for b in bins]
    open_bins = [b for b in range(len(bins)) if fill[b] < capacity]
    tried: set[int] = set()
    while True:
        rest = [b for b in open_bins if bins[b] and b not in tried and fill[b] < capacity]
        if len(rest) < 2:
            break
        victim = min(rest, key=lambda b: (fill[b], b))
        others = sorted((b for b in open_bins if b != victim and bins[b] and fill[b] < capacity), key=lambda b: (fill[b], b))
        if sum(capacity - fill[b] for b in others) < fill[victim]:
            break  # every other bin holds more still
        _empty(victim, others, bins, fill, size, capacity)
        if bins[victim]:
            tried.add(victim)
    return [b for b in bins if b]


def _empty(victim: int, others: list[int], bins: list[list[int]], fill: list[int], size: list[int], capacity: int) -> None:
    moved = True
    while moved and bins[victim]:
        moved = False
        own = sorted(bins[victim], key=lambda i: -size[i])
        for item in own:  # move: the fullest bin with room
            target = max((b for b in others if capacity - fill[b] >= size[item]), key=lambda b: (fill[b], -b), default=None)
            if target is not None:
                _shift(item, victim, target, bins, fill, size)
                moved = True
        if moved:
            continue
        # of pieces of one length any will do: a bin holds about the square root of twice its capacity of lengths at most
        by_size: dict[int, list[int]] = {}
        for item in bins[victim]:
            by_size.setdefault(size[item], []).append(item)
        own = sorted(by_size)
        pairs = {a + b: (a, b) for n, a in enumerate(own) for b in own[n:] if a != b or len(by_size[a]) > 1}
        sums = sorted(pairs)
        for target in sorted(others, key=lambda b: fill[b] - capacity):
            free = capacity - fill[target]
            if free <= 0:
                continue
            gain, give, back = 0, (), -1
            for out in bins[target]:
                top = size[out] + free
                at = bisect_right(own, top) - 1
                if at >= 0 and own[at] - size[out] > gain:  # one for one: the longest that fits beside the rest
                    gain, give, back = own[at] - size[out], (own[at],), out
                at = bisect_right(sums, top) - 1
                if at >= 0 and sums[at] - size[out] > gain:  # two for one
                    gain, give, back = sums[at] - size[out], pairs[sums[at]], out
            if gain > 0:
                for length in give:
                    _shift(by_size[length].pop(), victim, target, bins, fill, size)
                _shift(back, target, victim, bins, fill, size)
                moved = True
                break


def _shift(item: int, source: int, target: int, bins: list[list[int]], fill: list[int], size: list[int]) -> None:
    bins[source].remove(item)
    bins[target].append(item)
    fill[source] -= size[item]
    fill[target] += size[item]


def _packer(names: list[str], capacity: int, level: int, final: bool, narrowing: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """The work on one group: pack it, and say which bins stay open for the next round."""

    def in_group(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "deal"], ascending=[False, True], kind="stable").reset_index(drop=True)
        lengths = frame["length"].to_numpy()
        bins = local_search(best_fit(lengths, capacity), lengths, capacity)
        fills = [int(lengths[b].sum()) for b in bins]
        # the emptiest bins go on to the next round, as far as it narrows
        order = sorted(range(len(bins)), key=lambda b: fills[b])
        open_bins, held = set(), 0
        for b in order if not final else []:
            held += len(bins[b])
            if fills[b] == capacity or open_bins and held > len(frame) // narrowing:
                break
            open_bins.add(b)
        sequence, offset, closed = np.zeros(len(frame), np.int64), np.zeros(len(frame), np.int64), np.ones(len(frame), bool)
        for number, b in enumerate(bins):
            ends = np.cumsum(lengths[b])
            sequence[b] = (level << 56) | (int(key[0]) << 20) | number
            offset[b] = ends - lengths[b]
            closed[b] = number not in open_bins
        return frame.assign(sequence_id=sequence, offset=offset, closed=closed)[names]

    return in_group


def pack(found: DataFrame, *, capacity: int = 4096, group: int = GROUP, narrowing: int = NARROWING) -> DataFrame:
    """Rows of :func:`pieces` with ``sequence_id`` and ``offset``."""
    kept = ["id", "piece", "start", "length", "ids_crc32"]
    kinds = {f.name: f.dataType for f in found.schema}
    schema = T.StructType([*(T.StructField(n, kinds[n]) for n in [*kept, "deal"]), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("closed", T.BooleanType())])
    left = written(found, "pieces")
    done: DataFrame | None = None
    level, groups = 0, 1 << 62
    while True:
        rows = left.count()
        groups = max(1, min(math.ceil(rows / group), groups // 2))
        final = groups == 1

        dealt = left.withColumn("group", F.pmod(F.xxhash64("deal", F.lit(level)), F.lit(groups)))
        packed = written(dealt.groupBy("group").applyInPandas(_packer(schema.names, capacity, level, final, narrowing), schema), f"packed-{level}")
        part = packed.filter("closed")
        done = part if done is None else done.unionByName(part)
        if final:
            return done.select(*kept, "sequence_id", "offset")
        left = packed.filter("NOT closed").select(*kept, "deal")
        level += 1


def pack_documents(df: DataFrame, tokenizer_path: str, *, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, piece, start, length, ids_crc32, sequence_id, offset`` for all documents."""
    packed = pack(pieces(df, tokenizer_path, capacity=capacity, end_id=end_id, id_col=id_col, text_col=text_col), capacity=capacity)
    return packed.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
