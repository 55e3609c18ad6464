"""Image and mask tables (I1–I17): pixels, run-length ``runs``, areas, boxes, overlap.

Two normalised tables carry all image work:

* ``pixels(image_id, x, y, <channels>)`` — decoded pixels (ROI only after masking);
* ``runs(image_id, obj_id, start, len, height, width)`` — column-major foreground
  runs (``p = x·height + y``, COCO order).  One row per run: area, boxes,
  overlap and confusion counts are computed from runs without exploding pixels.

Windows here are partitioned by image (and object); an image is bounded by
its own width × height, so no window partition grows with the dataset.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHANNELS_BGR = ("blue", "green", "red")


# ------------------------------------------------------------- decoding ----

def image_dims(images: DataFrame, id_col: str = "image_id") -> DataFrame:
    """(image_id, width, height, n_channels) from the ``image`` source struct.
    Undecodable files (height = -1) are left out; see ``undecodable``."""
    return images.where(F.col("image.height") >= 0).select(
        id_col, F.col("image.width").alias("width"), F.col("image.height").alias("height"),
        F.col("image.nChannels").alias("n_channels"))


def undecodable(images: DataFrame, id_col: str = "image_id") -> DataFrame:
    """Rows the image source could not decode (kept with ``dropInvalid=false``)."""
    return images.where(F.col("image.height") < 0).select(
        id_col, F.col("image.origin").alias("origin"), F.lit("undecodable image").alias("message"))


def _byte_at(data: Column, offset: Column) -> Column:
    """The byte at ``offset`` of a binary column.  A slice of a binary costs the
    same at every place, where a slice of a string walks there from the start."""
    return F.conv(F.hex(F.substring(data, offset + 1, F.lit(1))), 16, 10).cast("int")


def pixels_from_images(images: DataFrame, id_col: str = "image_id", gray: bool = True) -> DataFrame:
    """One row per pixel with ``blue, green, red`` (bytes are BGR, row-major)
    and ``gray = round(0.299 R + 0.587 G + 0.114 B)``; single-channel images give
    ``gray`` only.  Decoding is JVM-side and linear in the pixels."""
    base = images.where(F.col("image.height") >= 0).select(
        F.col(id_col).alias("image_id"), F.col("image.width").alias("w"), F.col("image.height").alias("h"),
        F.col("image.nChannels").alias("nc"), F.col("image.data").alias("data"))
    px = base.select("image_id", "w", "h", "nc", "data",
                     F.explode(F.sequence(F.lit(0), F.col("w") * F.col("h") - 1)).alias("i"))
    off = F.col("i") * F.col("nc")
    out = px.select(
        "image_id", (F.col("i") % F.col("w")).cast("int").alias("x"), (F.col("i") / F.col("w")).cast("int").alias("y"),
        "nc",
        _byte_at(F.col("data"), off).alias("c0"),
        F.when(F.col("nc") >= 3, _byte_at(F.col("data"), off + 1)).alias("c1"),
        F.when(F.col("nc") >= 3, _byte_at(F.col("data"), off + 2)).alias("c2"),
    )
    colour = F.col("nc") >= 3
    g = F.when(colour, F.floor((F.col("c2") * 299 + F.col("c1") * 587 + F.col("c0") * 114 + 500) / 1000)) \
        .otherwise(F.col("c0")).cast("int")
    cols = [F.col("image_id"), F.col("x"), F.col("y"),
            F.when(colour, F.col("c0")).alias("blue"), F.col("c1").alias("green"), F.col("c2").alias("red")]
    if gray:
        cols.append(g.alias("gray"))
    return out.select(*cols)


def mask_values(masks: DataFrame, id_col: str = "image_id") -> DataFrame:
    """One-channel mask pixels ``(image_id, x, y, value)``; colour masks are
    converted to gray first (I3)."""
    px = pixels_from_images(masks, id_col, gray=True)
    return px.select("image_id", "x", "y", F.col("gray").alias("value"))


# ------------------------------------------------------------- binarise ----

def foreground(mask_px: DataFrame, threshold: float = 0, value_col: str = "value",
               object_ids: bool = False) -> DataFrame:
    """Pixels above ``threshold``.  With ``object_ids`` every distinct
    non-zero value is its own object (``obj_id = value``), else one object (1)."""
    fg = mask_px.where(F.col(value_col) > threshold)
    obj = F.col(value_col).cast("int") if object_ids else F.lit(1)
    return fg.select("image_id", obj.alias("obj_id"), "x", "y")


# ----------------------------------------------------------------- runs ----

def _size_keys(sizes: DataFrame) -> list[str]:
    return [c for c in ("image_id", "obj_id") if c in sizes.columns]


def encode_runs(fg: DataFrame, sizes: DataFrame) -> DataFrame:
    """Column-major run-length encoding of foreground pixels.

    ``p = x·height + y``; consecutive positions form a run (gaps and islands:
    ``p - row_number()`` is constant along a run).  ``sizes`` gives
    ``(image_id, height, width)``, with ``obj_id`` if sizes differ by object.
    """
    j = fg.join(sizes, _size_keys(sizes))
    p = (F.col("x") * F.col("height") + F.col("y")).cast("bigint")
    w = Window.partitionBy("image_id", "obj_id").orderBy("p")
    isl = j.select("image_id", "obj_id", "height", "width", p.alias("p")) \
        .withColumn("__isl", F.col("p") - F.row_number().over(w))
    return isl.groupBy("image_id", "obj_id", "__isl").agg(
        F.min("p").alias("start"), F.count(F.lit(1)).alias("len"),
        F.first("height").alias("height"), F.first("width").alias("width"),
    ).drop("__isl")


def decode_runs(runs: DataFrame) -> DataFrame:
    """Runs back to pixels ``(image_id, obj_id, x, y)``."""
    p = F.explode(F.sequence(F.col("start"), F.col("start") + F.col("len") - 1)).alias("p")
    return runs.select("image_id", "obj_id", "height", p).select(
        "image_id", "obj_id", (F.col("p") / F.col("height")).cast("int").alias("x"),
        (F.col("p") % F.col("height")).cast("int").alias("y"))


def coco_counts(runs: DataFrame, sizes: DataFrame) -> DataFrame:
    """I11 export form: uncompressed COCO ``{size: [h, w], counts: [...]}`` per
    object, alternating background/foreground lengths starting with background.

    This gathers the runs of one object into one array (bounded by the image
    size), which is what the export format requires.
    """
    g = runs.groupBy("image_id", "obj_id").agg(
        F.array_sort(F.collect_list(F.struct("start", "len"))).alias("r"))
    g = g.join(sizes, _size_keys(sizes))
    ends = F.transform("r", lambda s: s["start"] + s["len"])
    pairs = F.flatten(F.transform("r", lambda s, i: F.array(
        s["start"] - F.when(i == 0, F.lit(0).cast("bigint")).otherwise(F.element_at(ends, i)),
        s["len"])))
    tail = (F.col("height") * F.col("width")).cast("bigint") - F.element_at(ends, -1)
    counts = F.when(tail > 0, F.concat(pairs, F.array(tail))).otherwise(pairs)
    return g.select("image_id", "obj_id",
                    F.struct(F.array(F.col("height"), F.col("width")).alias("size"),
                             counts.alias("counts")).alias("segmentation"))


def areas(runs: DataFrame, per_object: bool = True) -> DataFrame:
    """Pixel area per object (or per image) and % of the image."""
    keys = ["image_id", "obj_id"] if per_object else ["image_id"]
    return runs.groupBy(*keys).agg(
        F.sum("len").alias("area"),
        (F.sum("len") / F.first(F.col("height") * F.col("width")) * 100).alias("area_pct"))


def boxes(runs: DataFrame) -> DataFrame:
    """Object boxes from runs.

    ``xmin, ymin, xmax, ymax`` are inclusive pixel coordinates (training
    target, I8); ``bbox`` is COCO ``[x, y, w, h]`` with w/h counting pixels (I9).
    A run crossing a column boundary covers rows 0…h-1.
    """
    end = F.col("start") + F.col("len") - 1
    x0 = (F.col("start") / F.col("height")).cast("int")
    x1 = (end / F.col("height")).cast("int")
    y0 = (F.col("start") % F.col("height")).cast("int")
    y1 = (end % F.col("height")).cast("int")
    spans = x1 > x0
    r = runs.select("image_id", "obj_id", x0.alias("x0"), x1.alias("x1"),
                    F.when(spans, F.lit(0)).otherwise(y0).alias("ya"),
                    F.when(spans, F.col("height") - 1).otherwise(y1).alias("yb"))
    b = r.groupBy("image_id", "obj_id").agg(
        F.min("x0").alias("xmin"), F.min("ya").alias("ymin"), F.max("x1").alias("xmax"), F.max("yb").alias("ymax"))
    return b.withColumn(
        "bbox", F.array(F.col("xmin").cast("double"), F.col("ymin").cast("double"),
                        (F.col("xmax") - F.col("xmin") + 1).cast("double"),
                        (F.col("ymax") - F.col("ymin") + 1).cast("double")))


def union_runs(runs: DataFrame, keys: Sequence[str] = ("image_id",), obj_id: int = 1) -> DataFrame:
    """Union of several objects' masks into one mask per image (or other ``keys``).

    Overlapping or touching runs are merged: a new island starts where a run
    begins after the furthest end seen so far (running max over the image).
    """
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy("start", "len")
    end = F.col("start") + F.col("len")
    prev_max = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    flagged = runs.withColumn("__new", F.when(prev_max.isNull() | (F.col("start") > prev_max), 1).otherwise(0))
    isl = flagged.withColumn("__isl", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    named = [] if "obj_id" in keys else [F.lit(obj_id).alias("obj_id")]
    return isl.groupBy(*keys, "__isl").agg(
        F.min("start").alias("start"), (F.max(end) - F.min("start")).alias("len"),
        F.first("height").alias("height"), F.first("width").alias("width"),
    ).select(*keys, *named, "start", "len", "height", "width")


def overlap(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("image_id",),
            left: Sequence[str] = (), right: Sequence[str] = ()) -> DataFrame:
    """Intersection pixels of two run tables per key, without exploding pixels.

    Runs are cut at column borders and meet by an equi-join on (key, column), so
    a run only meets the runs of its own columns; the range overlap is a residual
    predicate.  ``left`` and ``right`` name further columns of ``a`` and ``b`` (objects) to
    tell apart in the result.
    """
    keys, left, right = list(keys), list(left), list(right)

    def by_column(runs: DataFrame, own: list[str]) -> DataFrame:
        column = F.explode(F.expr("sequence(start div height, (start + len - 1) div height)"))
        return runs.select(*keys, *own, "start", "len", "height", column.alias("__col")).select(
            *keys, *own, "__col", F.greatest(F.col("start"), F.col("__col") * F.col("height")).alias("s"),
            F.least(F.col("start") + F.col("len"), (F.col("__col") + 1) * F.col("height")).alias("e"))

    ra = by_column(a, left).select(*keys, *left, "__col", F.col("s").alias("a_s"), F.col("e").alias("a_e"))
    rb = by_column(b, right).select(*[F.col(k).alias(f"__b_{k}") for k in keys], *right, F.col("__col").alias("__b_col"),
                                    F.col("s").alias("b_s"), F.col("e").alias("b_e"))
    cond = [ra[k] == rb[f"__b_{k}"] for k in keys] + [
        ra["__col"] == rb["__b_col"], ra["a_s"] < rb["b_e"], rb["b_s"] < ra["a_e"]]
    j = ra.join(rb, cond, "inner")
    return j.groupBy(*keys, *left, *right).agg(
        F.sum(F.least("a_e", "b_e") - F.greatest("a_s", "b_s")).alias("intersection"))


def empty_masks(sizes: DataFrame, runs: DataFrame) -> DataFrame:
    """Images whose mask has no foreground (after thresholding)."""
    return sizes.join(runs.select("image_id").distinct(), "image_id", "left_anti")


def resize_nearest(mask_px: DataFrame, sizes_to: DataFrame) -> DataFrame:
    """I16 (nearest): value at ``src = floor(dst · in/out)`` for each target pixel.

    ``sizes_to``: (image_id, height, width, out_height, out_width).
    """
    grid = sizes_to.select(
        "image_id", "height", "width", "out_height", "out_width",
        F.explode(F.sequence(F.lit(0), F.col("out_width") * F.col("out_height") - 1)).alias("i"))
    grid = grid.select(
        "image_id", (F.col("i") % F.col("out_width")).cast("int").alias("x"),
        (F.col("i") / F.col("out_width")).cast("int").alias("y"),
        F.floor((F.col("i") % F.col("out_width")) * F.col("width") / F.col("out_width")).cast("int").alias("sx"),
        F.floor(F.floor(F.col("i") / F.col("out_width")) * F.col("height") / F.col("out_height")).cast("int").alias("sy"))
    src = mask_px.select(F.col("image_id").alias("__id"), F.col("x").alias("sx"), F.col("y").alias("sy"), "value")
    return grid.join(src, (grid["image_id"] == src["__id"]) & (grid["sx"] == src["sx"]) & (grid["sy"] == src["sy"]),
                     "left").select("image_id", "x", "y", F.coalesce("value", F.lit(0)).alias("value"))


def _axis(sizes_to: DataFrame, size: str, out: str, name: str) -> DataFrame:
    """Linear interpolation along one axis: (image_id, source place, output place,
    weight), two rows for each output place.  Half-pixel coordinates: the source of
    output place i is (i + 0.5) * size / out - 0.5, clamped to the image."""
    at = F.greatest((F.col("i") + F.lit(0.5)) * F.col(size) / F.col(out) - F.lit(0.5), F.lit(0.0))
    grid = sizes_to.select("image_id", size, F.col(out), F.explode(F.sequence(F.lit(0), F.col(out) - 1)).alias("i")).select(
        "image_id", size, F.col("i").alias(name), at.alias("at")).withColumn("first", F.floor("at").cast("int"))
    part = F.col("at") - F.col("first")
    both = F.array(F.struct(F.col("first").alias("s"), (F.lit(1.0) - part).alias("weight")),
                   F.struct(F.least(F.col("first") + 1, F.col(size) - 1).alias("s"), part.alias("weight")))
    return grid.select("image_id", name, F.inline(both)).where("weight > 0")


def resize_bilinear(px: DataFrame, sizes_to: DataFrame) -> DataFrame:
    """I16 (bilinear): ``value`` at every target pixel, half-pixel centres, edges clamped.

    ``sizes_to``: (image_id, height, width, out_height, out_width).  One axis after the
    other: each is an equi-join of pixels and weights on (image, place) and a sum of two
    products, so a target pixel costs four products and no image is gathered.
    Images that keep their size pass through.  Missing source pixels count as 0.
    """
    same = (F.col("height") == F.col("out_height")) & (F.col("width") == F.col("out_width"))
    keep = px.join(sizes_to.where(same).select("image_id"), "image_id", "left_semi")
    sizes_to = sizes_to.where(~same)
    wx = _axis(sizes_to, "width", "out_width", "to_x").withColumnsRenamed({"s": "x", "weight": "wx"})
    wy = _axis(sizes_to, "height", "out_height", "to_y").withColumnsRenamed({"s": "y", "weight": "wy"})
    across = px.join(wx, ["image_id", "x"]).groupBy("image_id", "to_x", "y").agg(
        F.sum(F.col("value") * F.col("wx")).alias("value"))
    down = across.join(wy, ["image_id", "y"]).groupBy("image_id", "to_x", "to_y").agg(
        F.sum(F.col("value") * F.col("wy")).alias("value"))
    return keep.select("image_id", "x", "y", F.col("value").cast("double").alias("value")).unionByName(
        down.select("image_id", F.col("to_x").alias("x"), F.col("to_y").alias("y"), "value"))
