"""Masks of COCO documents as run tables.

A ``segmentation`` is one of three things: uncompressed counts, a counts string, or a list of
polygons.  All become rows of the ``runs`` table (image_id, obj_id, start, len, height,
width); an empty list gives an object without runs.  The counts string packs the lengths of
alternating background and foreground runs in groups of five bits, each from the third on
as the difference to the one before the last.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import masks

# Fixed values of the format: bits of a group, its continuation bit, first character.
GROUP_BITS, MORE, FIRST_CHAR = 5, 0x20, 48


# --------------------------------------------------------------- counts strings ----

def pack_counts(counts: np.ndarray) -> str:
    """The counts string of run lengths."""
    counts = np.asarray(counts, dtype=np.int64)
    if not len(counts):
        return ""
    steps = counts.copy()
    steps[3:] -= counts[1:-2]
    # A value takes as many groups as hold it with its sign.
    bits = np.frexp(np.where(steps < 0, -steps - 1, steps).astype(np.float64))[1]
    groups = np.maximum(1, -(-(bits + 1) // GROUP_BITS))
    ends = np.cumsum(groups)
    place = np.arange(ends[-1]) - np.repeat(ends - groups, groups)
    out = (np.repeat(steps, groups) >> (GROUP_BITS * place)) & (MORE - 1)
    out[place + 1 < np.repeat(groups, groups)] |= MORE
    return (out + FIRST_CHAR).astype(np.uint8).tobytes().decode("ascii")


def unpack_counts(text: str) -> np.ndarray:
    """The run lengths of a counts string."""
    groups = np.frombuffer(text.encode("ascii"), dtype=np.uint8).astype(np.int64) - FIRST_CHAR
    if not len(groups):
        return groups
    last = np.flatnonzero((groups & MORE) == 0)
    sizes = np.diff(last, prepend=-1)
    place = np.arange(len(groups)) - np.repeat(last - sizes + 1, sizes)
    steps = np.add.reduceat((groups & (MORE - 1)) << (GROUP_BITS * place), last - sizes + 1)
    negative = (groups[last] & (MORE >> 1)) != 0
    steps[negative] -= np.int64(1) << (GROUP_BITS * sizes[negative])
    for first in (1, 2):  # every other one adds up
        steps[first::2] = np.cumsum(steps[first::2])
    return steps


def counts_to_string(counts: Column) -> Column:
    """Array of run lengths → counts string."""
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else pack_counts(v))

    return F.pandas_udf(run, "string")(counts)


def string_to_counts(text: Column) -> Column:
    """Counts string → array of run lengths."""
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else unpack_counts(v))

    return F.pandas_udf(run, "array<bigint>")(text)


def _foreground(counts: Column) -> Column:
    """Run lengths → array of structs (start, len) of the foreground runs."""
    def run(values: pd.Series) -> pd.Series:
        def one(v):
            if v is None:
                return None
            ends = np.cumsum(np.asarray(v, dtype=np.int64))
            return [{"start": int(a), "len": int(b - a)} for a, b in zip(ends[::2], ends[1::2], strict=False) if b > a]

        return values.map(one)

    return F.pandas_udf(run, "array<struct<start:bigint,len:bigint>>")(counts)


def compressed(segmentations: DataFrame) -> DataFrame:
    """(…, segmentation {size, counts array}) → the same with a counts string."""
    s = F.col("segmentation")
    return segmentations.withColumn("segmentation", F.struct(s["size"].alias("size"), counts_to_string(s["counts"]).alias("counts")))


# --------------------------------------------------------------------- polygons ----

def _polygon_spans(rows: pa.Array) -> pa.Array:
    """Lists of (height, width, polygons), one of each object → lists of its merged runs."""
    objects, rows_of = len(rows), pc.list_parent_indices(rows).to_numpy()
    items = pc.list_flatten(rows)
    height, width = (pc.struct_field(items, c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in ("height", "width"))
    polygons = pc.struct_field(items, "polygons")
    row = pc.list_parent_indices(polygons).to_numpy()
    rings = pc.list_flatten(polygons)
    ring = np.arange(len(rings)) - np.searchsorted(row, row)
    xy = pc.list_flatten(rings).cast(pa.float64()).to_numpy(zero_copy_only=False)
    counts = np.bincount(pc.list_parent_indices(rings).to_numpy(), minlength=len(rings))
    first_xy, n = np.cumsum(counts) - counts, np.where(counts // 2 > 2, counts // 2, 0)
    r = np.repeat(np.arange(len(rings)), n)
    i = np.arange(len(r)) - np.repeat(np.cumsum(n) - n, n)
    at, to = first_xy[r] + 2 * i, first_xy[r] + 2 * ((i + 1) % n[r])
    x1, y1, x2, y2 = xy[at], xy[at + 1], xy[to], xy[to + 1]
    # Bounds pass over what is null, as least and greatest do; null crossings come first.
    first = np.fmax(np.ceil(np.fmin(x1, x2) - 0.5), 0)
    last = np.fmin(np.ceil(np.fmax(x1, x2) - 0.5), width[row[r]]) - 1
    e = np.flatnonzero(first <= last)
    many = (last[e] - first[e]).astype(np.int64) + 1
    column = np.repeat(first[e].astype(np.int64), many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    e = np.repeat(e, many)
    y = y1[e] + (column + 0.5 - x1[e]) * (y2[e] - y1[e]) / (x2[e] - x1[e])
    of, k = rows_of[row[r[e]]], ring[r[e]]
    order = np.lexsort((np.where(np.isnan(y), -np.inf, y), column, k, of))
    y, column, of, k, item = y[order], column[order], of[order], k[order], row[r[e]][order]
    same = np.zeros(len(y) + 1, dtype=bool)
    same[1:-1] = (column[1:] == column[:-1]) & (k[1:] == k[:-1]) & (of[1:] == of[:-1])
    place = np.arange(len(y))
    opens = (place - np.maximum.accumulate(np.where(same[:-1], 0, place))) % 2 == 0
    end = np.where(same[1:], np.append(y[1:], np.nan), np.nan)
    top, bottom = np.fmax(np.ceil(y - 0.5), 0), np.fmin(np.ceil(end - 0.5), height[item])
    s = np.flatnonzero(opens & (top < bottom))
    start, of, item = column[s] * height[item[s]].astype(np.int64) + top[s].astype(np.int64), of[s], item[s]
    end = start + (bottom[s] - top[s]).astype(np.int64)
    # What overlaps or touches within an object is one run.
    order = np.lexsort((end, start, of))
    start, end, of, item = start[order], end[order], of[order], item[order]
    apart = of * (end.max(initial=0) + 2)
    reach = np.maximum.accumulate(end + apart)
    new = np.flatnonzero(np.append(True, (start + apart)[1:] > reach[:-1])[:len(start)])
    end = np.maximum.reduceat(end, new) if len(new) else end
    runs = pa.StructArray.from_arrays(
        [pa.array(start[new]), pa.array(end - start[new]), *[pa.array(v[item[new]].astype(np.int64)) for v in (height, width)]],
        names=["start", "len", "height", "width"])
    offsets = np.append(0, np.cumsum(np.bincount(of[new], minlength=objects)))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), runs)


#: Objects whose outlines are crossed with their columns in one go.
OBJECTS = 500


def _spans(polygons: Column) -> Column:
    def run(rows: pa.Array) -> pa.Array:
        return pa.concat_arrays([_polygon_spans(rows.slice(i, OBJECTS)) for i in range(0, max(len(rows), 1), OBJECTS)])

    return F.arrow_udf(run, "array<struct<start:bigint,len:bigint,height:bigint,width:bigint>>")(polygons)


def polygon_runs(objects: DataFrame, sizes: DataFrame) -> DataFrame:
    """(image_id, obj_id, polygons: arrays of x, y, x, y, …) → runs.

    A pixel is inside where its centre is (even-odd rule within a polygon; an object's
    polygons are united).  Each edge meets the columns whose centre line it crosses; in
    a column the crossings of a polygon, by rank, open and close runs in turn.  So work
    follows the outline, not the area, and an outline is bounded by its image's width.
    Outlines are shuffled, not their crossings: those of many objects are ranked
    together where the objects lie, and only runs leave.
    """
    size = [F.col(c).cast(sizes.schema[c].dataType) for c in ("height", "width")]
    outlines = objects.join(sizes, "image_id").groupBy("image_id", "obj_id").agg(
        F.collect_list(F.struct("height", "width", "polygons")).alias("rows"))
    runs = outlines.select("image_id", "obj_id", F.inline(_spans(F.col("rows"))))
    return runs.select("image_id", "obj_id", "start", "len", *size)


def merged(runs: DataFrame) -> DataFrame:
    """Overlapping or touching runs of an object as one."""
    return masks.union_runs(runs, ["image_id", "obj_id"])


# -------------------------------------------------------------------- documents ----

def segmentation_runs(annotations: DataFrame, sizes: DataFrame) -> DataFrame:
    """(image_id, obj_id, segmentation) in any of the three forms → runs.

    ``segmentation`` is JSON text (what a reader infers for a document of mixed forms), or
    the struct or array of a document of one form.  ``sizes`` (image_id, height, width)
    gives the size for polygons; counts carry their own.
    """
    if annotations.schema["segmentation"].dataType.simpleString() != "string":
        annotations = annotations.withColumn("segmentation", F.to_json("segmentation"))
    s = F.col("segmentation")
    rle = annotations.where(F.ltrim(s).startswith("{")).select(
        "image_id", "obj_id", F.from_json(s, "size array<int>, counts string").alias("s")).select(
        "image_id", "obj_id", "s.size", "s.counts")
    plain = F.from_json("counts", "array<bigint>")
    listed = F.col("counts").startswith("[")
    runs = rle.where(listed).select("*", F.inline(_foreground(plain))).unionByName(
        rle.where(~listed).select("*", F.inline(_foreground(string_to_counts(F.col("counts"))))))
    runs = runs.select("image_id", "obj_id", "start", "len", F.col("size")[0].alias("height"), F.col("size")[1].alias("width"))
    polygons = annotations.where(F.ltrim(s).startswith("[")).select(
        "image_id", "obj_id", F.from_json(s, "array<array<double>>").alias("polygons"))
    return runs.unionByName(polygon_runs(polygons, sizes))
