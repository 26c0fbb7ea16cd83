"""Operator 1: SentencePiece BPE encoding by a prefix table, and decoding.

BPE has one encoding per string, so every prefix of a text has one last token. The table holds that token
for each prefix, found from left to right: an Aho-Corasick automaton names the pieces that end at a
position, and the right one is the piece that may follow the last token of the prefix before it. Two tokens
may stand side by side exactly when BPE turns their joined string back into those two tokens, which is
tested once for each pair. Walking the table backwards yields the ids. Time is linear in the length of a
text, whatever its word lengths.

Where the vocabulary has no piece with a space mark after another character, or with a word character beside
another kind of character, a text falls into independent segments there; the codec reads from the vocabulary
which of these cuts are safe. The ids of short segments are remembered in a table of bounded size.

Null and empty texts give the end id alone and decode to an empty string. Repeated rows give repeated
results. Only the named columns are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

MARK = "▁"
MEMO_ENTRIES = 400_000
PAIR_ENTRIES = 2_000_000
MEMO_LENGTH = 48


class PrefixTableCodec:
    """Encoder and decoder for one model file (BPE with byte fallback, identity normaliser)."""

    def __init__(self, model_path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        size = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        self.scores: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.byte_ids = [0] * 256
        self.bytes_of: dict[int, int] = {}
        self.silent: set[int] = set()
        self.end_id = model.eos_id()
        automaton = ahocorasick.Automaton()
        for i, piece in enumerate(self.pieces):
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value], self.bytes_of[i] = i, value
            elif model.is_control(i):
                self.silent.add(i)
            elif not model.is_unknown(i) and not model.is_unused(i):
                self.scores[piece], self.ids[piece] = model.get_score(i), i
                automaton.add_word(piece, i)
        automaton.make_automaton()
        self.automaton = automaton
        whole = any(MARK in piece.lstrip(MARK) for piece in self.ids)
        hard = re.escape("".join(c for c in "\n\t" if not any(c in piece for piece in self.ids)))
        fence = f"[{hard}]|" if hard else ""
        self.coarse = re.compile("(?s:.+)" if whole else f"{fence}{MARK}*[^{MARK}{hard}]+|{MARK}+")
        crossing = {c for piece in self.ids for c in re.findall(rf"(?=(\w)[^\w{MARK}])|(?<=[^\w{MARK}])(\w)", piece) for c in c if c}
        self.crossing = re.compile(f"[{re.escape(''.join(sorted(crossing)))}]" if crossing else "(?!)")
        self.fine = self.coarse if whole else re.compile(rf"{fence}{MARK}*(?:\w+|[^\w{MARK}{hard}]+)|{MARK}+")
        self.lengths = [len(piece) for piece in self.pieces]
        self.decimal = [str(i) for i in range(size)]
        self.plain_from = 1 + max([*self.bytes_of, *self.silent, model.unk_id()])
        self.pairs: dict[int, bool] = {}
        self.alone: dict[int, bool] = {}
        self.memo: dict[str, tuple[int, str, str]] = {}

    def merged(self, text: str) -> list[str]:
        """BPE by its definition, for the short strings of the compatibility tests."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: int, right: int) -> bool:
        """Whether BPE leaves the two tokens side by side as they are."""
        if len(self.pairs) > PAIR_ENTRIES:
            self.pairs.clear()
        a, b = self.pieces[left], self.pieces[right]
        known = self.pairs[left << 20 | right] = self.merged(a + b) == [a, b]
        return known

    def stands_alone(self, token: int) -> bool:
        known = self.alone[token] = len(self.merged(self.pieces[token])) == 1
        return known

    def encode_segment(self, text: str) -> list[int]:
        lengths, pairs, alone = self.lengths, self.pairs.get, self.alone.get
        last = [-1] * (len(text) + 1)  # -1 stays where a character is outside the vocabulary; nothing merges with it
        for end, token in self.automaton.iter(text):
            end += 1
            if last[end] >= 0:
                continue
            left = last[end - lengths[token]]
            if left < 0:
                fits = alone(token)
                if fits is None:
                    fits = self.stands_alone(token)
            else:
                fits = pairs(left << 20 | token)
                if fits is None:
                    fits = self.compatible(left, token)
            if fits:
                last[end] = token
        found, at = [], len(text)
        while at:
            token = last[at]
            if token < 0:
                found.extend(self.byte_ids[b] for b in reversed(text[at - 1].encode()))
                at -= 1
            else:
                found.append(token)
                at -= lengths[token]
        found.reverse()
        return found

    def segments(self, text: str) -> list[str]:
        """Parts of the marked text that no piece reaches across."""
        if not text:
            return []
        return (self.coarse if self.crossing.search(text) else self.fine).findall(MARK + text.replace(" ", MARK))

    def encode(self, text: str | None, *, end: bool = True) -> list[int]:
        ids = [i for s in self.segments(text or "") for i in self.encode_segment(s)]
        return [*ids, self.end_id] if end else ids

    def _surface(self, ids: list[int]) -> str:
        if min(ids, default=self.plain_from) >= self.plain_from:
            return "".join([self.pieces[i] for i in ids]).replace(MARK, " ")
        out, raw = [], bytearray()
        for i in ids:
            if i in self.bytes_of:
                raw.append(self.bytes_of[i])
                continue
            if raw:
                out.append(raw.decode(errors="replace"))
                raw.clear()
            if i not in self.silent:
                out.append(self.pieces[i])
        if raw:
            out.append(raw.decode(errors="replace"))
        return "".join(out).replace(MARK, " ")

    def decode(self, ids: list[int]) -> str:
        text = self._surface(ids)
        return text[1:] if text[:1] == " " else text

    def looked_up(self, segment: str) -> tuple[int, str, str]:
        """Number of ids, ids in decimal and decoded text of one segment."""
        known = self.memo.get(segment)
        if known is None:
            ids = self.encode_segment(segment)
            known = (len(ids), " ".join([self.decimal[i] for i in ids]), self._surface(ids))
            if len(segment) <= MEMO_LENGTH:
                if len(self.memo) >= MEMO_ENTRIES:
                    self.memo.clear()
                self.memo[segment] = known
        return known

    def digests(self, text: str | None) -> tuple[int, str, str]:
        get, looked_up = self.memo.get, self.looked_up
        parts = [get(s) or looked_up(s) for s in self.segments(text or "")]
        ids = " ".join([*(p[1] for p in parts), str(self.end_id)])
        decoded = "".join([p[2] for p in parts])
        if decoded[:1] == " ":
            decoded = decoded[1:]
        return (
            sum(p[0] for p in parts) + 1,
            hashlib.sha256(ids.encode()).hexdigest(),
            hashlib.sha256(decoded.encode()).hexdigest(),
        )


@lru_cache(maxsize=2)
def codec(model_path: str) -> PrefixTableCodec:
    """One codec for each Python worker and model."""
    return PrefixTableCodec(model_path)


def encode(df: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", end: bool = True) -> DataFrame:
    """``id_col`` and ``ids array<int>`` for each row of ``df``."""
    kind = df.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        for batch in batches:
            ids = [own.encode(t.as_py(), end=end) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[id_col, "ids"])

    schema = T.StructType([T.StructField(id_col, kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return df.select(id_col, text_col).mapInArrow(run, schema)


def decode(df: DataFrame, model_path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col`` and ``text`` for each row of ``df``; null ids give an empty text."""
    kind = df.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        for batch in batches:
            texts = [own.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    schema = T.StructType([T.StructField(id_col, kind), T.StructField("text", T.StringType())])
    return df.select(id_col, ids_col).mapInArrow(run, schema)


def encode_digests(df: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every text and return ``id_col, n_tokens, ids_sha256, decoded_sha256``."""
    kind = df.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        for batch in batches:
            rows = [own.digests(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())],
                names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    schema = T.StructType([T.StructField(id_col, kind), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return df.select(id_col, text_col).mapInArrow(run, schema)
