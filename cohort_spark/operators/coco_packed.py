"""Compact bytes for runs and keypoints on their way through a shuffle.

A run is the gap to the end of the run before it and its length, each in groups of seven
bits; a point's coordinates take the narrowest of three number types that holds all of its
object exactly, byte by byte in planes.  Both forms give back the same numbers.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ------------------------------------------------------------------------ runs ----


def changes(*columns: pa.Array) -> np.ndarray:
    """Where a row differs from the one before it (nulls are equal); the first row does."""
    n = len(columns[0])
    out = np.zeros(n, dtype=bool)
    out[:1] = True
    for c in columns:
        c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
        codes = c.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False) if n else np.zeros(0)
        out[1:] |= codes[1:] != codes[:-1]
    return out


def numbers(column: pa.Array) -> np.ndarray:
    """A column of numbers as doubles, null as NaN."""
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False).astype(np.float64, copy=False)


def flags(column: pa.Array) -> np.ndarray:
    """A column of truth values, null as false."""
    return column.fill_null(False).to_numpy(zero_copy_only=False).astype(bool)


def _binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column end to end, and the length of each row (null: 0)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return whole[offsets[0]:offsets[-1]], np.diff(offsets)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str], least: int) -> Iterator[pa.Table]:
    """Rows sorted by ``keys`` in tables of whole groups, ``least`` rows or more."""
    held, rows, wanted = [], 0, least
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows < wanted:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        cut = int(np.flatnonzero(changes(*(table.column(c) for c in keys)))[-1])
        if cut:
            yield table.slice(0, cut).combine_chunks()
        held, rows = table.slice(cut).to_batches(), table.num_rows - cut
        wanted = max(least, 2 * rows)
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def encode_runs(start: np.ndarray, length: np.ndarray, new: np.ndarray) -> pa.Array:
    """Bytes of the runs of each object; ``new`` marks its first run."""
    return _binary(*_encoded(start, length, new))


def encode_rows(row: np.ndarray, start: np.ndarray, length: np.ndarray, count: int) -> pa.Array:
    """Bytes of the runs of ``count`` rows (``row`` ascending); a row without any has none."""
    new = np.diff(row, prepend=-1) != 0
    data, held = _encoded(start, length, new)
    sizes = np.zeros(count, dtype=np.int64)
    sizes[row[new]] = held
    return _binary(data, sizes)


def _encoded(start: np.ndarray, length: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    before = np.concatenate(([0], (start + length)[:-1]))[:len(start)]
    gap = start - np.where(new, 0, before)
    values = np.stack(((gap << 1) ^ (gap >> 63), (length << 1) ^ (length >> 63)), axis=1).reshape(-1).astype(np.uint64)
    groups = np.ones(len(values), dtype=np.int64)
    more = values >> np.uint64(7)
    while more.any():
        groups += more > 0
        more = more >> np.uint64(7)
    ends = np.cumsum(groups)
    place = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - groups, groups)
    data = (np.repeat(values, groups) >> (7 * place).astype(np.uint64)).astype(np.uint8) & 0x7F
    data[place + 1 < np.repeat(groups, groups)] |= 0x80
    return data, np.add.reduceat(groups, 2 * np.flatnonzero(new)) if len(values) else np.zeros(0, dtype=np.int64)


def unpack_runs(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, length) of all runs in a column of packed runs."""
    data, sizes = _bytes(column)
    last = np.flatnonzero(data < 0x80)
    groups = np.diff(last, prepend=-1)
    place = np.arange(len(data)) - np.repeat(last - groups + 1, groups)
    parts = (data & 0x7F).astype(np.uint64) << (7 * place).astype(np.uint64)
    values = np.add.reduceat(parts, last - groups + 1) if len(last) else parts
    signed = (values >> np.uint64(1)).astype(np.int64) ^ -(values & np.uint64(1)).astype(np.int64)
    gap, length = signed[::2], signed[1::2]
    row = np.repeat(np.arange(len(sizes)), sizes)[last[::2]]
    total = np.cumsum(gap + length)
    first = np.flatnonzero(np.diff(row, prepend=-1))
    base = np.repeat(np.concatenate(([0], total))[first], np.diff(first, append=len(row)))
    return row, total - length - base, length


def union(key: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs [start, end) of each key, what overlaps or touches as one, sorted by key and start."""
    span = int(end.max(initial=0)) + 2
    order = np.argsort(key * span + start, kind="stable")
    key, start, end = key[order], start[order], end[order]
    reach = np.maximum.accumulate(key * span + end)
    head = np.flatnonzero(np.append(True, (key * span + start)[1:] > reach[:-1])[:len(start)])
    return key[head], start[head], np.maximum.reduceat(end, head) if len(head) else end


def stretch(row: np.ndarray, start: np.ndarray, length: np.ndarray, old: Sequence[np.ndarray], new: Sequence[np.ndarray]) -> tuple:
    """Runs (row, start, length) rescaled as ``mask_geometry.stretch`` does; ``old`` and ``new`` are (height, width) of each row."""
    def spread(many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.repeat(np.arange(len(many)), many)
        return at, np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)

    def up(at: np.ndarray, was: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (at * size + was - 1) // was

    h, w, nh, nw = (v[row] for v in (*old, *new))
    at, k = spread((start + length - 1) // h - start // h + 1)
    column, h, w, nh, nw, row = (start // h)[at] + k, h[at], w[at], nh[at], nw[at], row[at]
    top, bottom = np.maximum(start[at] - column * h, 0), np.minimum((start + length)[at] - column * h, h)
    first, past = up(column, w, nw), up(column + 1, w, nw)
    top, bottom = up(top, h, nh), up(bottom, h, nh)
    at, k = spread(np.where(top < bottom, np.maximum(past - first, 0), 0))
    begin = (first[at] + k) * nh[at]
    row, begin, end = union(row[at], begin + top[at], begin + bottom[at])
    return row, begin, end - begin


def subtract(of: np.ndarray, start: np.ndarray, end: np.ndarray, cover: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What a cover (key, start, end: merged and sorted) leaves of runs of keys ``of``: (run, start, end)."""
    span = max(int(end.max(initial=0)), int(cover[2].max(initial=0))) + 2
    begins, ends = cover[0] * span + cover[1], cover[0] * span + cover[2]
    s, e = of * span + start, of * span + end
    low = np.searchsorted(ends, s, side="right")
    many = np.maximum(np.searchsorted(begins, e, side="left") - low, 0)
    run = np.repeat(np.arange(len(of)), many + 1)
    k = np.arange(len(run)) - np.repeat(np.cumsum(many + 1) - many - 1, many + 1)
    after, before = np.append(-1, ends), np.append(begins, -1)
    a = np.where(k == 0, s[run], after[low[run] + k])
    b = np.where(k == many[run], e[run], before[low[run] + k])
    some = a < b
    run, base = run[some], (of * span)[run[some]]
    return run, a[some] - base, b[some] - base


def pack_runs(runs: DataFrame, obj: str) -> DataFrame:
    """Runs (image_id, ``obj``, start, len) → (image_id, ``obj``, runs): those that lie together in
    one row, so an object whose runs are scattered has several."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            new = changes(b.column(0), b.column(1))
            at = pa.array(np.flatnonzero(new))
            packed = encode_runs(*(b.column(i).to_numpy(zero_copy_only=False) for i in (2, 3)), new)
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), packed], names=["image_id", obj, "runs"])

    keys = [f"{c} {runs.schema[c].dataType.simpleString()}" for c in ("image_id", obj)]
    whole = runs.where(F.col("start").isNotNull() & F.col("len").isNotNull()).select(
        "image_id", obj, F.col("start").cast("long").alias("start"), F.col("len").cast("long").alias("len"))
    return whole.mapInArrow(run, ", ".join([*keys, "runs binary"]))


def unpacked(runs: Column) -> Column:
    """Packed runs → array of structs (start, len)."""
    def run(column: pa.Array) -> pa.Array:
        row, start, length = unpack_runs(column)
        offsets = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(column)))))
        items = pa.StructArray.from_arrays([pa.array(start), pa.array(length)], names=["start", "len"])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items)

    return F.arrow_udf(run, "array<struct<start:bigint,len:bigint>>")(runs)


# ------------------------------------------------------------------- keypoints ----

#: Number types of coordinates, by the code in an object's first byte.
TYPES = (np.dtype("<i2"), np.dtype("<f4"), np.dtype("<f8"))
ABSENT, LABELLED, UNKNOWN = 0, 1, 2  # no labelled point, some, or not known (null)


def encode_points(column: pa.Array, count: int) -> pa.Array:
    """Bytes of lists of (x, y, v), ``count`` points each; missing ones are NaN and not labelled."""
    n = len(column)
    sizes = np.nan_to_num(numbers(column.value_lengths()), nan=0).astype(np.int64)
    items = column.flatten()
    row = np.repeat(np.arange(n), sizes)
    k = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    fits = k < count
    at = row[fits], k[fits]
    xy = np.full((n, 2, count), np.nan)
    shown, null = np.zeros((n, count), dtype=bool), np.zeros((n, count), dtype=bool)
    if len(items):
        for axis, name in enumerate("xy"):
            xy[at[0], axis, at[1]] = numbers(items.field(name))[fits]
        v = numbers(items.field("v"))[fits]
        shown[at], null[at] = v > 0, np.isnan(v)
    xy[sizes > count] = np.nan
    state = np.where(shown.any(1), LABELLED, np.where(null.any(1) | (column.is_null().to_numpy(zero_copy_only=False)), UNKNOWN, ABSENT))
    flat = xy.reshape(n, 2 * count)
    narrow = flat.astype(np.float32)
    with np.errstate(invalid="ignore"):
        whole = (np.abs(flat) < 1 << 15).all(1) & (flat == np.rint(flat)).all(1)
    kind = np.where(whole, 0, np.where(((narrow == flat) | np.isnan(flat)).all(1), 1, 2))
    bits = np.packbits(shown, axis=1, bitorder="little")
    head = 1 + bits.shape[1]
    lengths = head + np.array([t.itemsize for t in TYPES])[kind] * 2 * count
    starts = np.cumsum(lengths) - lengths
    data = np.zeros(int(lengths.sum()), dtype=np.uint8)
    data[starts] = kind | state << 2
    data[starts[:, None] + 1 + np.arange(bits.shape[1])] = bits
    for code, of in enumerate(TYPES):
        rows = np.flatnonzero(kind == code)
        planes = np.ascontiguousarray(flat[rows].astype(of)).view(np.uint8).reshape(len(rows), 2 * count, of.itemsize).transpose(0, 2, 1)
        data[starts[rows][:, None] + head + np.arange(2 * count * of.itemsize)] = planes.reshape(len(rows), 2 * count * of.itemsize)
    return _binary(data, lengths)


def unpack_points(column: pa.Array, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(coordinates (row, axis, point), labelled points (row, point), state of each row)."""
    data, sizes = _bytes(column)
    n, width = len(sizes), -(-count // 8)
    starts = np.cumsum(sizes) - sizes
    flat = np.full((n, 2 * count), np.nan)
    shown, state = np.zeros((n, count), dtype=bool), np.full(n, UNKNOWN)
    held = np.flatnonzero(sizes)
    code = data[starts[held]]
    state[held] = code >> 2
    shown[held] = np.unpackbits(data[starts[held][:, None] + 1 + np.arange(width)], axis=1, bitorder="little")[:, :count]
    for kind, of in enumerate(TYPES):
        rows = held[code & 3 == kind]
        planes = data[starts[rows][:, None] + 1 + width + np.arange(2 * count * of.itemsize)].reshape(len(rows), of.itemsize, 2 * count)
        flat[rows] = np.ascontiguousarray(planes.transpose(0, 2, 1)).view(of).reshape(len(rows), 2 * count)
    return flat.reshape(n, 2, count), shown, state


def pack_points(points: Column, count: int) -> Column:
    """Arrays of structs (x, y, v) → packed points."""
    def run(column: pa.Array) -> pa.Array:
        return encode_points(column, count)

    return F.arrow_udf(run, "binary")(points)


def no_labels(packed: Column) -> Column:
    """Is no point of packed points labelled?  (Not, where that is unknown.)"""
    return F.coalesce(F.hex(F.substring(packed, 1, 1)).isin([f"{ABSENT << 2 | k:02X}" for k in range(len(TYPES))]), F.lit(False))
