"""Operator 6: media columns.

A payload of bytes is stored as a mono WAV file of unsigned 8-bit samples and read back with the ``wave``
module. Its features come from short-time Fourier transforms: the strongest bins of each frame, and pairs
of peaks in nearby frames, each packed into one integer that holds the time of the first peak, the distance
in frames and both bins. The fingerprint is the array of these integers in order of time.

A payload is the UTF-8 text (null: empty), padded with bytes 255 up to a positive multiple of ``FRAME``.
Equal texts have equal results. Frames are transformed in blocks of bounded size, so a very long text costs
memory in proportion to its bytes only. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

FRAME = 576
RATE = 8000
PEAKS = 2
FAN_OUT = 2
BLOCK = 2048
TAIL = 32


def padded(raw: bytes, unit: int = FRAME) -> bytes:
    """``raw`` with bytes 255 up to a positive multiple of ``unit``."""
    return raw + b"\xff" * (-len(raw) % unit if raw else unit)


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def peaks(samples: bytes) -> np.ndarray:
    """The ``PEAKS`` strongest bins of each frame (int64, frames x PEAKS), strongest first, ties to the lower bin."""
    frames = np.frombuffer(samples, np.uint8).reshape(-1, FRAME)
    window = np.hanning(FRAME).astype(np.float32)
    found = []
    for at in range(0, len(frames), BLOCK):
        block = (frames[at : at + BLOCK].astype(np.float32) - 128) * window
        power = np.abs(np.fft.rfft(block, axis=1)[:, 1:]).astype(np.float32)
        # tenths of power, then the lower bin: no two bins of a frame are equal
        rank = np.round(power * 10).astype(np.int64) * -FRAME + np.arange(power.shape[1])
        top = np.argpartition(rank, PEAKS, axis=1)[:, :PEAKS]
        order = np.argsort(np.take_along_axis(rank, top, axis=1), axis=1)
        found.append(np.take_along_axis(top, order, axis=1) + 1)
    return np.concatenate(found)


def fingerprint(samples: bytes) -> np.ndarray:
    """Peak pairs as ``time << 24 | distance << 20 | bin << 10 | bin``, in order of time."""
    bins = peaks(samples).astype(np.int64)
    times = np.arange(len(bins), dtype=np.int64)
    codes = [(times << 24 | bins[:, 0] << 10 | bins[:, 1])]
    for d in range(1, FAN_OUT + 1):
        if len(bins) > d:
            for p in range(PEAKS):
                codes.append(times[:-d] << 24 | d << 20 | bins[:-d, 0] << 10 | bins[d:, p])
    return np.sort(np.concatenate(codes))


def media_columns(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``media`` (the WAV file) and ``fingerprint array<bigint>`` for each row."""
    kind = df.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, raw in _slices(batch):
                media = [to_wav(padded(r)) for r in raw]
                codes = [fingerprint(from_wav(m)) for m in media]
                yield pa.RecordBatch.from_arrays([ids, pa.array(media, pa.binary()), pa.array(codes, pa.list_(pa.int64()))], names=[id_col, "media", "fingerprint"])

    schema = T.StructType([T.StructField(id_col, kind), T.StructField("media", T.BinaryType()), T.StructField("fingerprint", T.ArrayType(T.LongType()))])
    return df.select(id_col, text_col).mapInArrow(run, schema)


def _slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[tuple[pa.Array, list[bytes]]]:
    texts = batch.column(1).cast(pa.binary() if batch.column(1).type == pa.string() else pa.large_binary())
    for at in range(0, batch.num_rows, rows):
        yield batch.column(0).slice(at, rows), [t.as_py() or b"" for t in texts.slice(at, rows)]


def media_digests(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store, read back and digest every text; ``feature`` is the number of codes and their SHA-256, ``fingerprint`` the codes."""
    kind = df.schema[id_col].dataType
    fields = [("n_bytes", T.LongType()), ("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType()), ("fingerprint", T.ArrayType(T.LongType()))]

    arrow = {T.LongType(): pa.int64(), T.StringType(): pa.string(), T.ArrayType(T.LongType()): pa.list_(pa.int64())}

    def row(raw: bytes) -> tuple:
        media = to_wav(padded(raw))
        back = from_wav(media)
        codes = fingerprint(back)
        feature = f"{len(codes)}:{hashlib.sha256(codes.astype('<i8').tobytes()).hexdigest()}"
        return len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-TAIL:]), len(media), hashlib.sha256(media).hexdigest(), feature, codes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, raw in _slices(batch):
                columns = zip(*(row(r) for r in raw)) if raw else [[] for _ in fields]
                arrays = [pa.array(c, arrow[k]) for c, (_, k) in zip(columns, fields)]
                yield pa.RecordBatch.from_arrays([ids, *arrays], names=[id_col, *(n for n, _ in fields)])

    return df.select(id_col, text_col).mapInArrow(run, T.StructType([T.StructField(id_col, kind), *(T.StructField(n, k) for n, k in fields)]))
