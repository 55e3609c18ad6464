"""Moves of masks on run tables (B12, B15–B19), without exploding pixels.

Runs are cut at column borders to spans (column, top, bottom); a move shifts, mirrors, cuts or
stretches the spans and writes them with the new height.  Sizes and offsets are columns of
the row, so each image moves in its own way.  ``merged`` joins what then touches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .coco_masks import merged

_KEYS = ["image_id", "obj_id"]


def spans(runs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(image_id, obj_id, height, width, column, top, bottom): bottom is past the last row."""
    column = F.explode(F.expr("sequence(start div height, (start + len - 1) div height)"))
    return runs.select(*_KEYS, "start", "len", "height", "width", *carry, column.alias("column")).select(
        *_KEYS, "height", "width", *carry, "column",
        F.greatest(F.col("start") - F.col("column") * F.col("height"), F.lit(0)).alias("top"),
        F.least(F.col("start") + F.col("len") - F.col("column") * F.col("height"), F.col("height")).alias("bottom"))


def to_runs(moved: DataFrame) -> DataFrame:
    """Spans back to runs of their (new) height."""
    return merged(moved.where("top < bottom").select(
        *_KEYS, (F.col("column") * F.col("height") + F.col("top")).cast("long").alias("start"),
        (F.col("bottom") - F.col("top")).cast("long").alias("len"), "height", "width"))


def mirror(runs: DataFrame) -> DataFrame:
    """Columns in the opposite order."""
    return to_runs(spans(runs).withColumn("column", F.col("width") - 1 - F.col("column")))


def place(runs: DataFrame, left: Column, top: Column, height: Column, width: Column) -> DataFrame:
    """The mask on a canvas of ``height`` x ``width`` with its corner at (left, top);
    what lies outside is cut off, so negative offsets crop (B17)."""
    new = runs.withColumns({"__left": left, "__top": top, "__height": height, "__width": width})
    s = spans(new, ("__left", "__top", "__height", "__width")).withColumns({
        "column": F.col("column") + F.col("__left"),
        "top": F.greatest(F.col("top") + F.col("__top"), F.lit(0)),
        "bottom": F.least(F.col("bottom") + F.col("__top"), F.col("__height")),
        "height": F.col("__height"), "width": F.col("__width")})
    return to_runs(s.where((F.col("column") >= 0) & (F.col("column") < F.col("width"))))


def stretch(runs: DataFrame, height: Column, width: Column) -> DataFrame:
    """Nearest-neighbour rescale; new pixel i shows old pixel floor(i * old / new),
    so old span [a, b) covers new places ceil(a * new / old) up to ceil(b * new / old)."""
    new = runs.withColumns({"__height": height, "__width": width})
    s = spans(new, ("__height", "__width"))

    def up(at: Column, old: str, size: str) -> Column:
        return F.floor((at * F.col(size) + F.col(old) - 1) / F.col(old)).cast("long")

    first, last = up(F.col("column"), "width", "__width"), up(F.col("column") + 1, "width", "__width") - 1
    s = s.withColumns({"__first": first, "__last": last}).where("__first <= __last")
    return to_runs(s.select(
        *_KEYS, F.explode(F.sequence("__first", "__last")).alias("column"), up(F.col("top"), "height", "__height").alias("top"),
        up(F.col("bottom"), "height", "__height").alias("bottom"), F.col("__height").alias("height"), F.col("__width").alias("width")))


def subtract(runs: DataFrame, cover: DataFrame) -> DataFrame:
    """The runs less what ``cover`` (one mask an image, merged) hides.

    The cover's spans of a column stand in one row, in order (bounded by the image's height), and a span
    meets that row alone: what is left of it lies between the covers that touch it.  No span of
    ``runs`` is gathered.
    """
    own = spans(runs)
    other = spans(cover).groupBy("image_id", "column").agg(
        F.array_sort(F.collect_list(F.struct(F.col("top").alias("t"), F.col("bottom").alias("b")))).alias("c"))
    none = F.array().cast(other.schema["c"].dataType)
    near = own.join(other, ["image_id", "column"], "left").withColumn("c", F.filter(
        F.coalesce("c", none), lambda x: (x["t"] < F.col("bottom")) & (x["b"] > F.col("top"))))
    begins = F.concat(F.array("top"), F.transform("c", lambda x: x["b"]))
    ends = F.concat(F.transform("c", lambda x: x["t"]), F.array("bottom"))
    pieces = near.select(*_KEYS, "height", "width", "column", F.inline(F.arrays_zip(begins.alias("begin"), ends.alias("end"))))
    return to_runs(pieces.select(*_KEYS, "height", "width", "column", F.col("begin").alias("top"), F.col("end").alias("bottom")))
