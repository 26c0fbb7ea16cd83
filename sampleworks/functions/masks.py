"""Masks as run lengths: polygons to runs, compressed strings both ways, unions and shared areas, class rasters.

A mask is ``counts``: lengths of runs of zeros and ones in turn, zeros first, down one column of the picture after the other.
Inside it is a list of half-open runs of ones, in order and apart from each other, so nothing is as large as a picture and work
follows the outline. Columns of masks are worked on in Arrow batches.
"""

from __future__ import annotations

import json
import math
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

PIXELS = 100_000_000  # of the largest picture
SCALE = 5  # a polygon's outline is drawn on a grid this much finer than the picture's
Runs = tuple[np.ndarray, np.ndarray]
EMPTY: Runs = (np.zeros(0, np.int64), np.zeros(0, np.int64))


class MaskError(ValueError):
    """A segmentation that is no mask of its picture."""


def union_of(parts: list[Runs]) -> Runs:
    """Runs that any of several masks has; runs that touch become one."""
    start, end = (np.concatenate([p[i] for p in parts] or [EMPTY[0]]) for i in (0, 1))
    real = end > start
    start, end = start[real], end[real]
    if not len(start):
        return EMPTY
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.append(True, start[1:] > reach[:-1]))
    return start[new], reach[np.append(new[1:], len(start)) - 1]


def area_of(runs: Runs) -> int:
    return int((runs[1] - runs[0]).sum())


def shared_area(a: Runs, b: Runs) -> int:
    """How many pixels two masks have in common."""
    return area_of(a) + area_of(b) - area_of(union_of([a, b]))


def without(runs: Runs, gone: Runs) -> Runs:
    """The part of a mask that another doesn't cover."""
    if not len(gone[0]) or not len(runs[0]):
        return runs
    gaps = np.append(np.int64(-1), gone[1]), np.append(gone[0], np.iinfo(np.int64).max)
    first, last = np.searchsorted(gaps[1], runs[0], "right"), np.searchsorted(gaps[0], runs[1], "left")
    times = last - first
    of = np.repeat(np.arange(len(runs[0])), times)
    gap = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + first[of]
    start, end = np.maximum(runs[0][of], gaps[0][gap]), np.minimum(runs[1][of], gaps[1][gap])
    return start[end > start], end[end > start]


def runs_of(counts: np.ndarray) -> Runs:
    ends = np.cumsum(counts)
    return union_of([((ends - counts)[1::2], ends[1::2])])


def counts_of(runs: Runs, pixels: int) -> np.ndarray:
    """Counts of a mask over a picture of so many pixels; no count but the first is zero."""
    edges = np.column_stack(runs).reshape(-1)
    return np.diff(np.concatenate(([0], edges, [pixels] if not len(edges) or edges[-1] < pixels else []))).astype(np.int64)


def _steps(corner: np.ndarray, ahead: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edge, column times ``SCALE`` and row of each step over the middle of a column, of outlines drawn point by point."""
    step = np.abs(ahead - corner)
    across = step[:, 0] >= step[:, 1]  # longer across than down
    back = np.where(across, corner[:, 0] > ahead[:, 0], corner[:, 1] > ahead[:, 1])  # drawn from its lesser end, so both directions give the same points
    low, high = np.where(back[:, None], ahead, corner), np.where(back[:, None], corner, ahead)
    rise = high - low
    # along an edge that is longer across, columns are passed at places known beforehand
    e = np.flatnonzero(across & (step[:, 0] > 0))
    first = low[e, 0] + (SCALE // 2 - low[e, 0]) % SCALE
    times = np.maximum((high[e, 0] - 1 - first) // SCALE + 1, 0)
    edge = np.repeat(e, times)
    over = np.repeat(first, times) + SCALE * (np.arange(len(edge)) - np.repeat(np.cumsum(times) - times, times))
    slope, at = rise[edge, 1] / np.maximum(step[edge, 0], 1), over - low[edge, 0]
    row = np.minimum(*(np.trunc(low[edge, 1] + slope * (at + i) + 0.5) for i in (0, 1)))
    # of the others each point is needed; an edge straight down passes none
    e = np.flatnonzero(~across & (step[:, 0] > 0))
    times = step[e, 1]
    steep = np.repeat(e, times)
    at = np.arange(len(steep)) - np.repeat(np.cumsum(times) - times, times)
    slope = rise[steep, 0] / np.maximum(step[steep, 1], 1)
    x, y = (np.trunc(low[steep, 0] + slope * (at + i) + 0.5).astype(np.int64) for i in (0, 1))
    least = np.minimum(x, y)
    passed = np.flatnonzero((x != y) & ((least - SCALE // 2) % SCALE == 0))
    steep = steep[passed]
    return np.concatenate((edge, steep)), np.concatenate((over, least[passed])), np.concatenate((row, low[steep, 1] + at[passed]))


def outlines(points: np.ndarray, sizes: np.ndarray, width: np.ndarray, height: np.ndarray, base: int) -> Runs:
    """The pixels of many polygons by the rule of the COCO tools: ``points`` of one after the other, of which each has ``sizes``.
    The runs of polygon i are moved by i times ``base``, which is more than any picture has pixels.

    The outline is drawn point by point on a finer grid. Where it steps over the middle of a column, that column changes
    between outside and inside at the row of the step; changes at one place cancel in pairs.
    """
    corner = np.trunc(SCALE * points + 0.5).astype(np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    last = np.cumsum(sizes)
    behind = np.arange(len(corner)) + 1
    behind[last - 1] = last - sizes
    edge, over, y = _steps(corner, corner[behind])
    column, of = (over - SCALE // 2) // SCALE, owner[edge]
    row = np.ceil(np.clip((y + 0.5) / SCALE - 0.5, 0, height[of])).astype(np.int64)
    inside = (column >= 0) & (column < width[of])
    change, times = np.unique((of * base + column * height[of] + row)[inside], return_counts=True)
    change = change[times % 2 == 1]
    of, pixels = change // base, width * height
    change = change[change - of * base < pixels[of]]
    odd = np.flatnonzero(np.bincount(change // base, minlength=len(sizes)) % 2)
    if len(odd):
        change = np.sort(np.concatenate((change, odd * base + pixels[odd])))
    return union_of([(change[::2], change[1::2])])


def outline_runs(flat: list[float], width: int, height: int) -> Runs:
    """The pixels of a polygon ``[x0, y0, x1, y1, ...]``; see :func:`outlines`."""
    points = np.asarray(flat, float).reshape(-1, 2)
    return outlines(points, np.array([len(points)]), np.array([width]), np.array([height]), width * height + 1)


def _polygons(value: object) -> list[list[float]] | None:
    """The polygons of a segmentation in JSON, or none where it is another one or no good."""
    try:
        found = json.loads(value) if isinstance(value, str) else None
    except ValueError:
        return None
    if not isinstance(found, list) or not found:
        return None
    for polygon in found:
        if not isinstance(polygon, list) or len(polygon) < 6 or len(polygon) % 2 or not set(map(type, polygon)) <= {int, float}:
            return None
        if not all(map(math.isfinite, polygon)) or max(polygon) > 1e12 or min(polygon) < -1e12:
            return None
    return found


def _single_polygons(values: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which of many segmentations in JSON are one polygon without a fault, their numbers, and how many each has.

    Lists of numbers are read as one: without brackets or texts inside, a list is good if the whole is."""
    plain = np.array([isinstance(v, str) and v[:2] == "[[" and v[-2:] == "]]" and v.count("[") == 2 and v.count("]") == 2 for v in values], bool)
    chosen = [values[i] for i in np.flatnonzero(plain).tolist()]
    none = np.zeros(len(values), bool), np.zeros(0), np.zeros(0, np.int64)
    try:
        numbers = json.loads("[" + ",".join([v[2:-2] for v in chosen]) + "]")
        sizes = np.array([v.count(",") + 1 for v in chosen], np.int64)
        if not chosen or not set(map(type, numbers)) <= {int, float} or len(numbers) != sizes.sum():
            return none
        flat = np.array(numbers, float)
    except (ValueError, OverflowError):
        return none
    good = (sizes >= 6) & (sizes % 2 == 0) & np.logical_and.reduceat(np.abs(flat) < 1e12, np.cumsum(sizes) - sizes)
    plain[np.flatnonzero(plain)[~good]] = False
    return plain, flat[np.repeat(good, sizes)], sizes[good]


def many_runs(values: list, width: np.ndarray, height: np.ndarray) -> tuple[Runs, int, dict[int, str]]:
    """Runs of many segmentations as :func:`mask_runs` has them, those of i moved by i times ``base``; ``base``; and what is wrong with
    those that have none. Polygons are drawn together."""
    faults: dict[int, str] = {}
    parts: list[Runs] = []
    flat, sizes, of = [], [], []
    good = (width > 0) & (height > 0) & (width.astype(float) * height <= PIXELS)
    base = int((width * height)[good].max(initial=0)) + 1
    drawn, numbers, lengths = _single_polygons([v if g else None for v, g in zip(values, good.tolist())])
    for i in np.flatnonzero(~drawn).tolist():
        value = values[i]
        if value is None and good[i]:
            continue
        found = _polygons(value) if good[i] else None
        if found is None:
            try:
                start, end = mask_runs(value, int(width[i]), int(height[i]))
                parts.append((start + i * base, end + i * base))
            except MaskError as error:
                faults[i] = str(error)
            continue
        for polygon in found:
            flat.append(polygon)
            sizes.append(len(polygon) // 2)
            of.append(i)
    if flat or len(lengths):
        points = np.concatenate((numbers, np.array(list(chain.from_iterable(flat)), float))).reshape(-1, 2)
        owner = np.concatenate((np.flatnonzero(drawn), np.array(of, np.int64)))
        start, end = outlines(points, np.concatenate((lengths // 2, np.array(sizes, np.int64))), width[owner], height[owner], base)
        shift = (owner[start // base] - start // base) * base
        parts.append((start + shift, end + shift))
    return union_of(parts), base, faults


def areas(runs: Runs, base: int, count: int) -> np.ndarray:
    return np.bincount(runs[0] // base, runs[1] - runs[0], count).astype(np.int64)


def shared_areas(a: Runs, b: Runs, base: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many pixels mask ``i`` of ``a`` and mask ``j`` of ``b`` have in common, for many pairs."""
    first = np.searchsorted(a[0], i * base)
    times = np.searchsorted(a[0], (i + 1) * base) - first
    pair = np.repeat(np.arange(len(i)), times)
    run = np.arange(len(pair)) - np.repeat(np.cumsum(times) - times - first, times)
    before = np.concatenate(([0], np.cumsum(b[1] - b[0])))

    def covered(x: np.ndarray) -> np.ndarray:
        """Pixels of ``b`` before a place."""
        k = np.searchsorted(b[0], x, "right")
        return before[k] - np.where(k > 0, np.maximum(b[1][np.maximum(k - 1, 0)] - x, 0), 0) if len(b[0]) else np.zeros(len(x), np.int64)

    move = (j - i)[pair] * base
    return np.bincount(pair, covered(a[1][run] + move) - covered(a[0][run] + move), len(i)).astype(np.int64)


def many_counts(runs: Runs, base: int, pixels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of many masks one after the other, as :func:`counts_of` has them, and how many each has."""
    of = runs[0] // base
    held = np.bincount(of, minlength=len(pixels))
    last = np.cumsum(held)
    full = held > 0
    full[full] = runs[1][last[full] - 1] - np.flatnonzero(full) * base == pixels[full]
    sizes = 2 * held + ~full
    ends = np.cumsum(sizes)
    edges = np.empty(sizes.sum(), np.int64)
    at = np.ones(len(edges), bool)
    at[ends[~full] - 1] = False
    edges[at] = (np.column_stack(runs) - (of * base)[:, None]).reshape(-1)
    edges[~at] = pixels[~full]
    out = np.diff(edges, prepend=0)
    out[(ends - sizes)[sizes > 0]] = edges[(ends - sizes)[sizes > 0]]
    return out, sizes


def _listed(column: object) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of an Arrow list column one after the other, and how many each row has."""
    return column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def many_compressed(counts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of many compressed strings, as :func:`compressed` has them, and how many each has."""
    start = np.repeat(np.cumsum(sizes) - sizes, sizes)
    later = np.flatnonzero(np.arange(len(counts)) - start > 2)
    number = counts.astype(np.int64).copy()
    number[later] -= counts[later - 2]
    groups = np.ones(len(number), np.int64)
    for n in range(1, 13):
        groups += (number < -(1 << (5 * n - 1))) | (number >= 1 << (5 * n - 1))
    of = np.repeat(np.arange(len(number)), groups)
    place = np.arange(len(of)) - np.repeat(np.cumsum(groups) - groups, groups)
    part = (number[of] >> (5 * place)) & 31
    text = (48 + part + np.where(place < groups[of] - 1, 32, 0)).astype(np.uint8)
    row = np.repeat(np.arange(len(sizes)), sizes)
    return text, np.bincount(row, groups, len(sizes)).astype(np.int64)


def many_decompressed(text: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of many compressed strings, as :func:`decompressed` has them, how many each has, and which strings are none."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    part = text.astype(np.int64) - 48
    bad = np.zeros(len(sizes), bool)
    bad[row[(part < 0) | (part >= 64)]] = True
    last = (part & 32) == 0
    full = sizes > 0
    bad[full] |= ~last[np.cumsum(sizes)[full] - 1]
    kept = ~bad[row]
    part, row, last = part[kept], row[kept], last[kept]
    ends = np.flatnonzero(last)
    begin = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else np.zeros(0, np.int64)
    length = ends - begin + 1
    place = np.arange(len(part)) - np.repeat(begin, length)
    long = row[begin[length > 8]]
    bad[long] = True
    value = np.add.reduceat((part & 31) << np.minimum(5 * place, 55), begin) if len(begin) else np.zeros(0, np.int64)
    value = np.where(part[ends] & 16, value - (np.int64(1) << np.minimum(5 * length, 60)), value)
    row = row[begin]
    kept = ~bad[row]
    value, row = value[kept], row[kept]
    count = np.bincount(row, minlength=len(sizes))
    at = np.arange(len(value)) - np.repeat(np.cumsum(count) - count, count)
    # the first stands alone; from the fourth on each is added to the last but one, so odd and even places are sums of their own
    lane = row * 3 + np.where(at == 0, 0, 1 + at % 2)
    order = np.argsort(lane, kind="stable")
    total, lane = np.cumsum(value[order]), lane[order]
    new = np.flatnonzero(np.diff(lane, prepend=-1))
    total -= np.repeat(total[new] - value[order][new], np.diff(np.append(new, len(lane))))
    out = np.empty(len(value), np.int64)
    out[order] = total
    return out, count, bad


def compressed(counts: np.ndarray) -> str:
    """Counts as a string of six-bit characters: from the fourth on differences to the last but one, five bits at a time."""
    out = []
    for i, number in enumerate(counts.tolist()):
        if i > 2:
            number -= int(counts[i - 2])
        while True:
            part, number = number & 31, number >> 5
            last = number == (-1 if part & 16 else 0)
            out.append(chr(48 + part + (0 if last else 32)))
            if last:
                break
    return "".join(out)


def decompressed(text: str) -> np.ndarray:
    """Counts of a compressed string."""
    out: list[int] = []
    number = shift = 0
    for c in text:
        part = ord(c) - 48
        if not 0 <= part < 64 or shift > 35:
            raise MaskError("not a compressed mask")
        number |= (part & 31) << shift
        shift += 5
        if not part & 32:
            signed = number - (1 << shift) if part & 16 else number
            out.append(signed + (out[-2] if len(out) > 2 else 0))
            number = shift = 0
    if shift:
        raise MaskError("a compressed mask ends early")
    return np.array(out, np.int64)


def mask_runs(segmentation: object, width: int, height: int) -> Runs:
    """Runs of a COCO segmentation: polygons, counts or a compressed string with the picture's size; none is empty."""
    if not width or not height or min(width, height) <= 0 or width * height > PIXELS:
        raise MaskError("a mask needs a picture of 1 to 100 million pixels")
    if isinstance(segmentation, str):
        try:
            segmentation = json.loads(segmentation)
        except ValueError:
            raise MaskError("not a segmentation") from None
    if segmentation is None:
        return EMPTY
    if isinstance(segmentation, dict):
        counts = segmentation.get("counts")
        if segmentation.get("size") != [height, width]:
            raise MaskError("a mask of another size")
        counts = decompressed(counts) if isinstance(counts, str) else counts
        whole = isinstance(counts, np.ndarray) or isinstance(counts, list) and all(isinstance(n, int) and not isinstance(n, bool) for n in counts)
        if not whole or sum(map(int, counts)) != width * height or any(n < 0 for n in counts):
            raise MaskError("counts that don't fill the picture")
        return runs_of(np.asarray(counts, np.int64))
    if not isinstance(segmentation, list):
        raise MaskError("not a segmentation")
    parts = []
    for polygon in segmentation:
        if not isinstance(polygon, list) or len(polygon) < 6 or len(polygon) % 2 or not all(isinstance(v, (int, float)) and np.isfinite(v) for v in polygon):
            raise MaskError("not a polygon")
        parts.append(outline_runs(polygon, width, height))
    return union_of(parts)


def class_runs(instances: list[tuple[Runs, int | None, bool]], classes: set[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and class of runs of a class raster, in order, from (runs, class, crowd) of each object.

    What a crowd covers is left out, as is what nothing covers. Objects without a pixel, unknown classes and
    pixels of two classes are errors.
    """
    by_class: dict[int, list[Runs]] = {}
    crowds = []
    for runs, label, crowd in instances:
        if not len(runs[0]):
            raise MaskError("an object without a pixel")
        if crowd:
            crowds.append(runs)
        elif label not in classes:
            raise MaskError(f"an object of unknown class {label}")
        else:
            by_class.setdefault(label, []).append(runs)
    merged = {label: union_of(parts) for label, parts in by_class.items()}
    start, end = (np.concatenate([m[i] for m in merged.values()] or [EMPTY[0]]) for i in (0, 1))
    order = np.argsort(start, kind="stable")
    if (start[order][1:] < end[order][:-1]).any():
        raise MaskError("objects of two classes overlap")
    gone = union_of(crowds)
    left = {label: without(m, gone) for label, m in merged.items()}
    start, end = (np.concatenate([m[i] for m in left.values()] or [EMPTY[0]]) for i in (0, 1))
    label = np.concatenate([np.full(len(m[0]), k) for k, m in left.items()] or [EMPTY[0]])
    order = np.argsort(start, kind="stable")
    return start[order], end[order], label[order]


MASK = "counts array<long>, area long, fault string"


def mask(segmentation: Column, width: Column, height: Column) -> Column:
    """``counts, area, fault`` of a segmentation in JSON; without a fault ``counts`` fill the picture. Null is an empty mask."""

    @F.arrow_udf(MASK)
    def decode(text: pa.Array, w: pa.Array, h: pa.Array) -> pa.Array:
        wide, high = (c.fill_null(0).to_numpy(zero_copy_only=False) for c in (w, h))
        runs, base, faults = many_runs(text.to_pylist(), wide, high)
        wrong = np.zeros(len(text), bool)
        wrong[[*faults]] = True
        counts, sizes = many_counts(runs, base, np.where(wrong, 0, wide * high))
        sizes[wrong] = 0
        found = _lists(counts[~np.repeat(wrong, np.where(wrong, 1, sizes))], sizes, wrong)
        area = pa.array(areas(runs, base, len(text)), mask=wrong)
        return pa.StructArray.from_arrays([found, area, pa.array([faults.get(i) for i in range(len(text))], pa.string())], names=["counts", "area", "fault"])

    return decode(segmentation, width.cast("long"), height.cast("long"))


def _lists(values: np.ndarray, sizes: np.ndarray, none: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(values), mask=pa.array(none))


def shared_pixels(a: Column, b: Column) -> Column:
    """How many pixels two masks given by their counts have in common; null where one is null."""

    @F.arrow_udf("long")
    def shared(one: pa.Array, other: pa.Array) -> pa.Array:
        sides = [_listed(c) for c in (one, other)]
        base = int(max((np.bincount(np.repeat(np.arange(len(n)), n), c, len(n)).max(initial=0) for c, n in sides), default=0)) + 1
        found = []
        for counts, sizes in sides:
            before = np.cumsum(sizes) - sizes
            at = np.arange(len(counts)) - np.repeat(before, sizes)
            ends = np.cumsum(counts)
            ends -= np.repeat(np.concatenate(([0], ends))[before], sizes) - np.repeat(np.arange(len(sizes)) * base, sizes)
            ones = at % 2 == 1
            found.append(union_of([(ends[ones] - counts[ones], ends[ones])]))
        every = np.arange(len(one))
        none = one.is_null().to_numpy(zero_copy_only=False) | other.is_null().to_numpy(zero_copy_only=False)
        return pa.array(shared_areas(*found, base, every, every), mask=none)

    return shared(a.cast("array<long>"), b.cast("array<long>"))


def compressed_mask(counts: Column) -> Column:
    """Counts as a compressed string; null stays null."""

    @F.arrow_udf("string")
    def encode(given: pa.Array) -> pa.Array:
        text, sizes = many_compressed(*_listed(given))
        offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
        valid = pa.array(given.is_valid()).buffers()[1]
        return pa.StringArray.from_buffers(len(given), pa.py_buffer(offsets), pa.py_buffer(text), valid)

    return encode(counts.cast("array<long>"))


def decompressed_mask(text: Column) -> Column:
    """Counts of a compressed string; null where it is none."""

    @F.arrow_udf("array<long>")
    def decode(given: pa.Array) -> pa.Array:
        raw = [b"" if t is None else t.encode() for t in given.to_pylist()]
        counts, sizes, bad = many_decompressed(np.frombuffer(b"".join(raw), np.uint8), np.array([*map(len, raw)], np.int64))
        return _lists(counts, sizes, bad | given.is_null().to_numpy(zero_copy_only=False))

    return decode(text)


def counts_of_pixels(pixels: Column, height: Column) -> Column:
    """Counts of pictures given row by row as flat arrays of zeros and others; null where they have no such height."""

    def one(flat: np.ndarray | None, high: float) -> np.ndarray | None:
        if flat is None or pd.isna(high) or high < 1 or len(flat) % high:
            return None
        ones = (np.asarray(flat).reshape(int(high), -1) != 0).ravel(order="F")
        edge = np.flatnonzero(np.diff(np.concatenate(([False], ones, [False])).astype(np.int8)))
        return counts_of((edge[::2], edge[1::2]), len(ones))

    @F.pandas_udf("array<long>")
    def encode(given: pd.Series, high: pd.Series) -> pd.Series:
        return pd.Series([one(p, h) for p, h in zip(given, high)], dtype=object)

    return encode(pixels, height)


RASTER = "runs array<struct<start:long,end:long,label:int>>, fault string"


def class_raster(instances: Column, width: Column, height: Column, classes: list[int]) -> Column:
    """``runs, fault`` of a picture's classes from its objects ``struct<segmentation string, label, iscrowd>``.

    What no run covers, or a crowd does, is to be ignored. A null array is a picture without objects.
    """
    known = set(classes)

    @F.pandas_udf(RASTER)
    def raster(objects: pd.Series, w: pd.Series, h: pd.Series) -> pd.DataFrame:
        rows = []
        for found, wide, high in zip(objects, w, h):
            try:
                wide, high = (0 if pd.isna(v) else int(v) for v in (wide, high))
                parts = [(mask_runs(o["segmentation"], wide, high), None if pd.isna(o["label"]) else int(o["label"]), bool(o["iscrowd"])) for o in (found if found is not None else [])]
                rows.append(([{"start": int(a), "end": int(b), "label": int(c)} for a, b, c in zip(*class_runs(parts, known))], None))
            except MaskError as error:
                rows.append((None, str(error)))
        return pd.DataFrame(rows, columns=["runs", "fault"])

    return raster(instances, width.cast("long"), height.cast("long"))
