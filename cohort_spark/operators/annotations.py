"""Boxes, annotation tables and dataset preparation.

Objects are rows (one per object) instead of per-image ragged arrays, so box
arithmetic, filters and flips are column expressions.  Random augmentations
are re-aimed to the annotation table: every draw is ``xxhash64`` of the image
id, a seed and a draw index, so a rerun or a retried task gives the same
result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clean import clamp
from . import coco_packed as packed
from . import mask_geometry as G
from . import masks
from .match import dense_index

# The single category of the lesion annotation export (fixed by the source).
LESION_CATEGORY = (1, "lesion", "skin")
MIN_VISIBLE_KEYPOINTS = 10


def uniform(key: Column, seed: int, k: int = 0) -> Column:
    """A seeded draw in [0, 1) from the image key (stable across reruns)."""
    return F.pmod(F.xxhash64(key, F.lit(seed), F.lit(k)), F.lit(1 << 30)) / float(1 << 30)


# ------------------------------------------------------------ B2 / B3 ----

def xywh_to_xyxy(df: DataFrame, width: Column | str | None = None, height: Column | str | None = None) -> DataFrame:
    """B2: ``[x, y, w, h] → [x1, y1, x2, y2]``, clamped to ``[0, W] × [0, H]`` when given."""
    x2, y2 = F.col("x") + F.col("w"), F.col("y") + F.col("h")
    x1, y1 = F.col("x"), F.col("y")
    if width is not None:
        W = F.col(width) if isinstance(width, str) else width
        H = F.col(height) if isinstance(height, str) else height
        x1, x2 = clamp(x1, F.lit(0.0), W), clamp(x2, F.lit(0.0), W)
        y1, y2 = clamp(y1, F.lit(0.0), H), clamp(y2, F.lit(0.0), H)
    return df.withColumns({"x1": x1, "y1": y1, "x2": x2, "y2": y2}).drop("x", "y", "w", "h")


def xyxy_to_xywh(df: DataFrame) -> DataFrame:
    """B3."""
    return df.withColumns({"x": F.col("x1"), "y": F.col("y1"), "w": F.col("x2") - F.col("x1"),
                           "h": F.col("y2") - F.col("y1")}).drop("x1", "y1", "x2", "y2")


def drop_crowd(df: DataFrame) -> DataFrame:
    """B4."""
    return df.where(F.col("iscrowd") == 0)


def keep_positive(df: DataFrame) -> DataFrame:
    """Boxes with positive width and height (xyxy)."""
    return df.where((F.col("y2") > F.col("y1")) & (F.col("x2") > F.col("x1")))


# ------------------------------------------------------------ B6 / B7 ----

def visible_keypoints(kp: Column | str) -> Column:
    """Number of keypoints with visibility > 0 in a flat ``[x, y, v, …]`` array."""
    k = F.col(kp) if isinstance(kp, str) else kp
    idx = F.sequence(F.lit(2), F.size(k) - 1, F.lit(3))
    return F.size(F.filter(idx, lambda i: F.element_at(k, i + 1) > 0))


def images_with_valid_annotations(images: DataFrame, anns: DataFrame, cat_list: Sequence[int] | None = None,
                                  keypoints: str | None = None, key: str = "image_id") -> DataFrame:
    """Keep images that have an annotation, not all boxes with a side ≤ 1,
    and (for keypoint data) at least 10 visible keypoints.  The category
    filter applies first.  One partial aggregate per image, then a semi join."""
    a = anns.where(F.col("category_id").isin(list(cat_list))) if cat_list else anns
    aggs = [F.bool_or((F.col("w") > 1) & (F.col("h") > 1)).alias("__nonempty")]
    if keypoints:
        aggs.append(F.sum(visible_keypoints(keypoints)).alias("__kp"))
    g = a.groupBy(key).agg(*aggs)
    ok = F.col("__nonempty")
    if keypoints:
        ok = ok & (F.col("__kp") >= MIN_VISIBLE_KEYPOINTS)
    return images.join(g.where(ok).select(key), key, "left_semi")


def images_with_objects(images: DataFrame, objects: DataFrame, key: str = "image_id") -> DataFrame:
    """Images that have at least one object."""
    return images.join(objects.select(key), key, "left_semi")


# ----------------------------------------------------------------- B8 ----

def to_annotation_model(objects: DataFrame, order: Sequence[str] = ("image_id", "obj_id")) -> tuple[DataFrame, DataFrame]:
    """Detection-style objects (xyxy boxes) → COCO annotation rows with ids
    from 1 in (image, object) order and xywh boxes; categories = sorted distinct
    labels."""
    anns = dense_index(xyxy_to_xywh(objects), list(order), "id", start=1)
    anns = anns.withColumn("area", F.coalesce(F.col("area"), F.col("w") * F.col("h"))) if "area" in anns.columns \
        else anns.withColumn("area", F.col("w") * F.col("h"))
    cats = objects.select(F.col("category_id").alias("id")).distinct().orderBy("id")
    return anns, cats


# ----------------------------------------------------------------- B9 ----

def predictions_to_results(preds: DataFrame, kind: str, mask_threshold: float = 0.5) -> DataFrame:
    """Prediction objects → result rows ``(image_id, category_id, score, …)``.

    ``bbox``: xyxy → xywh; ``segm``: a per-object probability mask table
    ``(image_id, obj_id, x, y, prob)`` thresholded at 0.5 and run-length
    encoded; ``keypoints``: the flat list.  Unknown kinds raise.
    """
    if kind == "bbox":
        return xyxy_to_xywh(preds).select("image_id", "category_id", "score", "x", "y", "w", "h")
    if kind == "keypoints":
        return preds.select("image_id", "category_id", "score", "keypoints")
    if kind == "segm":
        raise ValueError("use segm_results(pred_objects, mask_pixels, sizes) for mask predictions")
    raise ValueError(f"Unknown iou type {kind}")


def segm_results(pred_objects: DataFrame, mask_probs: DataFrame, sizes: DataFrame,
                 mask_threshold: float = 0.5) -> DataFrame:
    """B9 (segm): thresholded probability masks → run tables joined to scores."""
    fg = mask_probs.where(F.col("prob") > mask_threshold).select("image_id", "obj_id", "x", "y")
    runs = masks.encode_runs(fg, sizes)
    return pred_objects.select("image_id", "obj_id", "category_id", "score").join(
        masks.coco_counts(runs, sizes), ["image_id", "obj_id"], "inner")


# ---------------------------------------------------------------- B10 ----

def keypoints_to_struct(kp: Column | str) -> Column:
    """Flat ``[x, y, v, …]`` → ``array<struct<x, y, v>>``."""
    k = F.col(kp) if isinstance(kp, str) else kp
    idx = F.sequence(F.lit(0), (F.size(k) / 3).cast("int") - 1)
    return F.transform(idx, lambda i: F.struct(F.element_at(k, i * 3 + 1).alias("x"),
                                               F.element_at(k, i * 3 + 2).alias("y"),
                                               F.element_at(k, i * 3 + 3).alias("v")))


def keypoints_to_flat(kp: Column | str) -> Column:
    """``array<struct<x, y, v>>`` → flat list."""
    k = F.col(kp) if isinstance(kp, str) else kp
    return F.flatten(F.transform(k, lambda p: F.array(p["x"], p["y"], p["v"])))


# --------------------------------------------------------- B12 – B18 ----

def hflip(df: DataFrame, width: str = "width", flip_index: Sequence[int] | None = None,
          keypoints: str | None = None) -> DataFrame:
    """Horizontal flip of boxes ``x1' = W - x2, x2' = W - x1``; keypoints
    swap left/right by ``flip_index`` with ``x' = W - x`` and zeroed when not
    visible."""
    W = F.col(width)
    out = df.withColumns({"x1": W - F.col("x2"), "x2": W - F.col("x1")})
    if keypoints and flip_index is not None:
        k = F.col(keypoints)
        idx = F.array(*[F.lit(i) for i in flip_index])
        swapped = F.transform(idx, lambda i: F.element_at(k, i + 1))
        out = out.withColumn(keypoints, F.transform(swapped, lambda p: F.struct(
            F.when(p["v"] > 0, W - p["x"]).otherwise(F.lit(0.0)).alias("x"),
            F.when(p["v"] > 0, p["y"]).otherwise(F.lit(0.0)).alias("y"), p["v"].alias("v"))))
    return out


def flips(k: Column, p: float, seed: int) -> Column:
    """Is the image mirrored?"""
    return uniform(k, seed, 12) < p


def random_hflip(df: DataFrame, p: float = 0.5, seed: int = 42, key: str = "image_id", **kw) -> DataFrame:
    """B12 with a seeded per-image decision (probability ``p``)."""
    flip = flips(F.col(key), p, seed)
    touched = ["x1", "x2", *([kw["keypoints"]] if kw.get("keypoints") else [])]
    tagged = df.withColumns({"__flip": flip, **{f"__o_{c}": F.col(c) for c in touched}})
    f = hflip(tagged, **kw)
    return f.withColumns({c: F.when(F.col("__flip"), F.col(c)).otherwise(F.col(f"__o_{c}")) for c in touched}) \
        .drop("__flip", *[f"__o_{c}" for c in touched])


def random_hflip_masks(runs: DataFrame, p: float = 0.5, seed: int = 42) -> DataFrame:
    """B12 on masks: the same images as ``random_hflip`` are mirrored."""
    flip = flips(F.col("image_id"), p, seed)
    return runs.where(~flip).unionByName(G.mirror(runs.where(flip)))


def zoom(k: Column, p: float, side_range: tuple[float, float], seed: int) -> dict[str, Column]:
    """The canvas of an image and its place on it; an image that is left alone keeps its size."""
    apply = uniform(k, seed, 150) < p
    r = F.lit(side_range[0]) + (side_range[1] - side_range[0]) * uniform(k, seed, 151)
    cw, ch = (F.col("width") * r).cast("int"), (F.col("height") * r).cast("int")
    left = ((cw - F.col("width")) * uniform(k, seed, 152)).cast("int")
    top = ((ch - F.col("height")) * uniform(k, seed, 153)).cast("int")
    return {"left": F.when(apply, left).otherwise(0), "top": F.when(apply, top).otherwise(0),
            "width": F.when(apply, cw).otherwise(F.col("width")), "height": F.when(apply, ch).otherwise(F.col("height"))}


def zoom_out(df: DataFrame, p: float = 0.5, side_range: tuple[float, float] = (1.0, 4.0), seed: int = 42,
             key: str = "image_id") -> DataFrame:
    """With probability p place the image on a canvas ``r``× larger
    (r in side_range) at a random offset; boxes shift by the offset."""
    z = zoom(F.col(key), p, side_range, seed)
    return df.withColumns({
        "x1": F.col("x1") + z["left"], "x2": F.col("x2") + z["left"], "y1": F.col("y1") + z["top"],
        "y2": F.col("y2") + z["top"], "width": z["width"], "height": z["height"]})


def zoom_out_masks(runs: DataFrame, p: float = 0.5, side_range: tuple[float, float] = (1.0, 4.0), seed: int = 42) -> DataFrame:
    """B15 on masks, with the draws of ``zoom_out``."""
    z = zoom(F.col("image_id"), p, side_range, seed)
    return G.place(runs, z["left"], z["top"], z["height"], z["width"])


def jittered_size(k: Column, target: tuple[int, int], scale_range: tuple[float, float], seed: int) -> tuple[Column, Column]:
    """New (width, height) of scale jitter."""
    s = F.lit(scale_range[0]) + (scale_range[1] - scale_range[0]) * uniform(k, seed, 160)
    r = F.least(F.lit(float(target[1])) / F.col("height"), F.lit(float(target[0])) / F.col("width")) * s
    return (F.col("width") * r).cast("int"), (F.col("height") * r).cast("int")


def scale_jitter(df: DataFrame, target: tuple[int, int], scale_range: tuple[float, float] = (0.1, 2.0),
                 seed: int = 42, key: str = "image_id") -> DataFrame:
    """``r = min(th / h, tw / w) · s`` with the source's index order for
    ``target = (th, tw)``; integer new size; boxes scaled by the realised ratio."""
    nw, nh = jittered_size(F.col(key), target, scale_range, seed)
    sx, sy = nw / F.col("width"), nh / F.col("height")
    return df.withColumns({"x1": F.col("x1") * sx, "x2": F.col("x2") * sx, "y1": F.col("y1") * sy,
                           "y2": F.col("y2") * sy, "width": nw, "height": nh})


def scale_jitter_masks(runs: DataFrame, target: tuple[int, int], scale_range: tuple[float, float] = (0.1, 2.0), seed: int = 42) -> DataFrame:
    """B16 on masks (nearest), with the draws of ``scale_jitter``."""
    nw, nh = jittered_size(F.col("image_id"), target, scale_range, seed)
    return G.stretch(runs, nh, nw)


def crop_window(k: Column, size: tuple[int, int], seed: int) -> dict[str, Column]:
    """The window of at most ``size = (h, w)``; one draw places it on both axes."""
    th, tw = size
    u = uniform(k, seed, 170)
    return {"width": F.least(F.col("width"), F.lit(tw)), "height": F.least(F.col("height"), F.lit(th)),
            "left": (F.greatest(F.col("width") - tw, F.lit(0)) * u).cast("int"),
            "top": (F.greatest(F.col("height") - th, F.lit(0)) * u).cast("int")}


def fixed_size_crop(df: DataFrame, size: tuple[int, int], seed: int = 42, key: str = "image_id") -> DataFrame:
    """Random crop of at most ``size = (h, w)``, boxes shifted and clamped,
    degenerate boxes dropped; the canvas is padded right/bottom to ``size``."""
    c = crop_window(F.col(key), size, seed)
    out = df.withColumns({
        "x1": clamp(F.col("x1") - c["left"], F.lit(0.0), c["width"]), "x2": clamp(F.col("x2") - c["left"], F.lit(0.0), c["width"]),
        "y1": clamp(F.col("y1") - c["top"], F.lit(0.0), c["height"]), "y2": clamp(F.col("y2") - c["top"], F.lit(0.0), c["height"]),
    })
    return keep_positive(out).withColumns({"width": F.lit(size[1]), "height": F.lit(size[0])})


def fixed_size_crop_masks(runs: DataFrame, size: tuple[int, int], seed: int = 42) -> DataFrame:
    """B17 on masks, with the window of ``fixed_size_crop``: what lies outside is cut off, and
    the canvas is ``size``.  Objects whose box is dropped are to be dropped here too (join)."""
    c = crop_window(F.col("image_id"), size, seed)
    cut = G.place(runs, -c["left"], -c["top"], c["height"], c["width"])
    return G.place(cut, F.lit(0), F.lit(0), F.lit(size[0]), F.lit(size[1]))


def shortest_side(k: Column, min_sizes: Sequence[int], max_size: int, seed: int) -> tuple[Column, Column]:
    """New (width, height) of the shortest-side resize."""
    pick = (uniform(k, seed, 180) * len(min_sizes)).cast("int")
    target = F.element_at(F.array(*[F.lit(float(m)) for m in min_sizes]), pick + 1)
    short = F.least(F.col("width"), F.col("height"))
    long = F.greatest(F.col("width"), F.col("height"))
    r = F.least(target / short, F.lit(float(max_size)) / long)
    return (F.col("width") * r).cast("int"), (F.col("height") * r).cast("int")


def shortest_size(df: DataFrame, min_sizes: Sequence[int], max_size: int, seed: int = 42,
                  key: str = "image_id") -> DataFrame:
    """Resize so the short side is a size drawn from ``min_sizes``, capped
    so the long side stays ≤ ``max_size``; boxes scaled."""
    nw, nh = shortest_side(F.col(key), min_sizes, max_size, seed)
    return df.withColumns({"x1": F.col("x1") * nw / F.col("width"), "x2": F.col("x2") * nw / F.col("width"),
                           "y1": F.col("y1") * nh / F.col("height"), "y2": F.col("y2") * nh / F.col("height"),
                           "width": nw, "height": nh})


def shortest_size_masks(runs: DataFrame, min_sizes: Sequence[int], max_size: int, seed: int = 42) -> DataFrame:
    """B18 on masks (nearest), with the draws of ``shortest_size``."""
    nw, nh = shortest_side(F.col("image_id"), min_sizes, max_size, seed)
    return G.stretch(runs, nh, nw)


# ---------------------------------------------------------------- B14 ----

#: Least overlaps to choose from; the last one leaves an image as it is.
IOU_OPTIONS = (0.0, 0.1, 0.3, 0.5, 0.7, 0.9, 1.0)


#: Boxes and trials that are compared at once.
CROP_CELLS = 1 << 20

_P1, _P2, _P3, _P5 = (np.array([p], dtype=np.uint64) for p in (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


def _hash_int(value: int | np.ndarray, seed: np.ndarray) -> np.ndarray:
    """``xxhash64`` of one more integer column: ``seed`` is the hash of those before it."""
    h = seed + _P5 + np.uint64(4)
    h = h ^ (np.asarray(value, dtype=np.int64).astype(np.uint64) & np.uint64(0xFFFFFFFF)) * _P1
    h = (h << np.uint64(23) | h >> np.uint64(41)) * _P2 + _P3
    h = (h ^ h >> np.uint64(33)) * _P2
    h = (h ^ h >> np.uint64(29)) * _P3
    return h ^ h >> np.uint64(32)


def _unit(h: np.ndarray) -> np.ndarray:
    """A hash as a number in [0, 1), as ``uniform`` makes it."""
    return (h & np.uint64((1 << 30) - 1)).astype(np.float64) / float(1 << 30)


def _crop_windows(options: tuple[float, ...], scale: tuple[float, float], aspect: tuple[float, float], trials: int, rounds: int):
    """(hash of the image and the seed, width, height, boxes) → the window of each image, null where it stays."""
    cuts = [0, *[c for c in (4, 12) if c < trials], trials]  # most images need few trials

    def first_good(h: np.ndarray, size: np.ndarray, base: int, option: np.ndarray, low: int, high: int, xy: np.ndarray,
                   first: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of these images have a good window among the trials, and the first one."""
        t = np.arange(low, high)
        u = [_unit(_hash_int(t, _hash_int(base + i, h)[:, None])) for i in (1, 2, 3, 4)]
        w, hi = (np.trunc(np.nan_to_num(size[:, i, None] * (scale[0] + (scale[1] - scale[0]) * u[i]))) for i in (0, 1))
        left, top = (np.trunc((size[:, i, None] - side) * u[2 + i]) for i, side in ((0, w), (1, hi)))
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = w / hi
            image, trial = np.nonzero((hi > 0) & (w > 0) & (ratio >= aspect[0]) & (ratio <= aspect[1]))
        cell = np.repeat(np.arange(len(image)), many[image])
        box = np.repeat(first[image], many[image]) + np.arange(len(cell)) - np.repeat(np.cumsum(many[image]) - many[image], many[image])
        windows = np.stack([left, top, left + w, top + hi])[:, image, trial]
        x1, y1, x2, y2 = xy[:, box]
        l, t_, r, b = windows[:, cell]
        cx, cy = (x1 + x2) * 0.5, (y1 + y2) * 0.5
        both = (np.minimum(x2, r) - np.maximum(x1, l)) * (np.minimum(y2, b) - np.maximum(y1, t_))
        area = (x2 - x1) * (y2 - y1) + (r - l) * (b - t_)
        with np.errstate(divide="ignore", invalid="ignore"):
            met = (l < cx) & (cx < r) & (t_ < cy) & (cy < b) & (both / (area - both) >= option[image][cell])
        good = np.flatnonzero(np.bincount(cell[met], minlength=len(image)))
        found, at = np.unique(image[good], return_index=True)
        return found, windows[:, good[at]]

    def run(hashes: pa.Array, widths: pa.Array, heights: pa.Array, boxes: pa.Array) -> pa.Array:
        h = hashes.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        size = np.stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in (widths, heights)], axis=1)
        many = pc.fill_null(boxes.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        first, items = np.cumsum(many) - many, boxes.flatten()
        xy = np.stack([items.field(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in ("x1", "y1", "x2", "y2")])
        out = np.full((4, len(h)), np.nan)
        left = np.arange(len(h))
        for n in range(rounds):
            base = 1400 + 1000 * n
            option = np.array(options)[(_unit(_hash_int(base, h[left])) * len(options)).astype(np.int64)]
            left, option = left[option < 1], option[option < 1]
            for low, high in zip(cuts, cuts[1:], strict=False):
                cells = np.cumsum((many[left] + 1) * (high - low))
                missed, at = [], 0
                while at < len(left):
                    to = max(at + 1, int(np.searchsorted(cells, (cells[at - 1] if at else 0) + CROP_CELLS, side="right")))
                    mine = left[at:to]
                    found, windows = first_good(h[mine], size[mine], base, option[at:to], low, high, xy, first[mine], many[mine])
                    out[:, mine[found]] = windows
                    missed.append(np.delete(np.arange(at, to), found))
                    at = to
                rest = np.concatenate(missed) if missed else np.zeros(0, dtype=np.int64)
                left, option = left[rest], option[rest]
            if not len(left):
                break
        empty = np.isnan(out[0])
        sides = [pa.array(np.where(empty, 0, c).astype(np.int32), mask=empty) for c in out]
        return pa.StructArray.from_arrays(sides, names=["left", "top", "right", "bottom"])

    return F.arrow_udf(run, "struct<left:int,top:int,right:int,bottom:int>")


def iou_crop(boxes: DataFrame, seed: int = 42, options: Sequence[float] = IOU_OPTIONS, scale: tuple[float, float] = (0.3, 1.0),
             aspect: tuple[float, float] = (0.5, 2.0), trials: int = 40, rounds: int = 8, key: str = "image_id") -> DataFrame:
    """Crop each image to a window with objects of enough overlap.

    Each round draws an option for each image that is left: 1 or more leaves the image as
    it is; else ``trials`` windows are drawn, and the first good one is taken: its
    sides' ratio lies in ``aspect``, it is not empty, at least one box (x1, y1, x2, y2) has its
    centre strictly inside, and one of those overlaps the window by the option or
    more.  Images without a good window go to the next round; after ``rounds`` they
    are left as they are.  Boxes with their centre outside are dropped, the others shifted
    and clamped.  Extra columns stay; width and height become the window's.

    The boxes of an image (bounded by it) stand in one row; the rounds of many images are drawn
    together in array passes, with the draws that ``uniform`` gives.
    """
    k = F.col(key)
    images = boxes.groupBy(key).agg(F.first("width").cast("double").alias("width"), F.first("height").cast("double").alias("height"),
                                    F.collect_list(F.struct(*[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")])).alias("boxes"))
    windows = _crop_windows(tuple(float(o) for o in options), scale, aspect, trials, rounds)
    taken = images.select(key, windows(F.xxhash64(k, F.lit(seed)), "width", "height", "boxes").alias("window"))
    j = boxes.join(taken, key, "left").select("*", *[F.col(f"window.{c}").alias(c) for c in ("left", "top", "right", "bottom")])
    cropped = F.col("left").isNotNull()
    j = j.where(~cropped | _centre_inside())
    w, h = F.col("right") - F.col("left"), F.col("bottom") - F.col("top")
    moved = {c: F.when(cropped, clamp(F.col(c) - F.col(at), F.lit(0.0), size)).otherwise(F.col(c))
             for c, at, size in (("x1", "left", w), ("x2", "left", w), ("y1", "top", h), ("y2", "top", h))}
    return j.withColumns({**moved, "width": F.when(cropped, w).otherwise(F.col("width")),
                          "height": F.when(cropped, h).otherwise(F.col("height"))}).select(*boxes.columns)


def _centre_inside() -> Column:
    """A box's centre lies strictly inside the row's window."""
    cx, cy = (F.col("x1") + F.col("x2")) * 0.5, (F.col("y1") + F.col("y2")) * 0.5
    return (F.col("left") < cx) & (cx < F.col("right")) & (F.col("top") < cy) & (cy < F.col("bottom"))


# ---------------------------------------------------------------- B19 ----

#: Runs that one partition of images is to hold.
RUNS_A_PART = 1 << 19


#: Rows of whole images that are taken together.
ROWS_AT_ONCE = 20000


def _by_image(df: DataFrame, runs: int) -> DataFrame:
    """``df`` dealt by image into as many partitions as this number of runs calls for: the
    adaptive planner merges the default partitions but does not split them for a window."""
    n = -(-runs // RUNS_A_PART)
    return df.repartition(n, "image_id") if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition("image_id")


def _runs_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of lists of packed runs, each row's merged."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    item, start, length = packed.unpack_runs(column.flatten())
    row = pc.list_parent_indices(column).to_numpy()[item]
    return packed.union(row, start, start + length)


def _stretched():
    """(lists of packed runs, old height and width, new height and width) → lists of the rescaled masks' packed runs."""
    def run(runs: pa.Array, *sizes: pa.Array) -> pa.Array:
        row, start, end = _runs_of(runs)
        h, w, nh, nw = (packed.numbers(c).astype(np.float64) for c in sizes)
        known = ~np.isnan(h + w + nh + nw)[row]
        whole = [np.nan_to_num(v, nan=1).astype(np.int64) for v in (h, w, nh, nw)]
        row, start, length = packed.stretch(row[known], start[known], (end - start)[known], whole[:2], whole[2:])
        bytes_ = packed.encode_rows(row, start, length, len(runs))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(runs) + 1, dtype=np.int32)), bytes_)

    return F.arrow_udf(run, "array<binary>")


def _occlude(kinds: dict[str, str], with_runs: bool):
    """Objects of whole images, own and pasted, → those that are left, with their boxes and areas (and runs)."""
    names = ["image_id", "obj_id", "category_id", "x1", "y1", "x2", "y2", "iscrowd"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in packed.whole_groups(batches, ["image_id"], ROWS_AT_ONCE):
            image = np.cumsum(packed.changes(table.column("image_id"))) - 1
            pasted = packed.flags(table.column("pasted"))
            n, images = len(image), int(image[-1]) + 1
            row, start, end = _runs_of(table.column("runs"))
            on_top = pasted[row]
            cover = packed.union(image[row[on_top]], start[on_top], end[on_top])
            own = [v[~on_top] for v in (row, start, end)]
            which, begin, stop = packed.subtract(image[own[0]], own[1], own[2], cover)
            row = np.concatenate((row[on_top], own[0][which]))
            start, end = np.concatenate((start[on_top], begin)), np.concatenate((end[on_top], stop))
            area = np.bincount(row, weights=end - start, minlength=n)
            touched = np.bincount(image[pasted], minlength=images)[image] > 0
            changed = touched & ~pasted
            # The box of what is left, inclusive; a run over a column's border covers all rows.
            height = np.nan_to_num(packed.numbers(table.column("height")), nan=1).astype(np.int64)
            h = height[row]
            x = [start // h, (end - 1) // h]
            wide = x[1] > x[0]
            sides = [np.full(n, np.inf), np.full(n, np.inf), np.full(n, -np.inf), np.full(n, -np.inf)]
            for side, at, best in zip(sides, (x[0], np.where(wide, 0, start % h), x[1], np.where(wide, h - 1, (end - 1) % h)),
                                      (np.minimum, np.minimum, np.maximum, np.maximum), strict=True):
                best.at(side, row, at)
            given = [packed.numbers(table.column(c)) for c in ("x1", "y1", "x2", "y2")]
            null = [np.isnan(g) & ~changed for g in given]
            box = [np.where(changed, s, g) for s, g in zip(sides, given, strict=True)]
            keep = np.where(touched, (box[2] > box[0]) & (box[3] > box[1]), True)
            ids = table.column("obj_id").combine_chunks()
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            number = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            most = np.full(images, np.iinfo(np.int64).min)
            np.maximum.at(most, image[~pasted & known], number[~pasted & known])
            shift = np.where(most[image] == np.iinfo(np.int64).min, 0, most[image] + 1)
            columns = {c: table.column(c) for c in (*names, "pasted", "height", "width")}
            columns["obj_id"] = pa.array(np.where(pasted, number + shift, number), mask=~known).cast(ids.type)
            columns |= {c: pa.array(np.where(z, 0, b), mask=z) for c, b, z in zip(("x1", "y1", "x2", "y2"), box, null, strict=True)}
            columns["area"] = pa.array(area)
            if with_runs:
                order = np.lexsort((start, row))
                columns["runs"] = packed.encode_rows(row[order], start[order], (end - start)[order], n)
            yield from pa.table({c: columns[c] for c in kinds}).filter(pa.array(keep)).combine_chunks().to_batches()

    return run


def copy_paste(images: DataFrame, objects: DataFrame, runs: DataFrame, batch_size: int = 8, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Paste objects of the batch's neighbour over each image's own.

    ``images`` (image_id, height, width), ``objects`` (image_id, obj_id, category_id, x1, y1,
    x2, y2, iscrowd), ``runs`` their masks.  Images in a seeded order make batches of
    ``batch_size``; each gets objects of the one before it, the first those of the last.
    Of n objects n are drawn with repetition and each drawn one is pasted once; masks
    are rescaled (nearest) to the image, boxes by the ratio of the sizes.  What a paste hides
    leaves the masks below; objects with nothing left go, the others get the box
    (inclusive corners) of what is left, and all get their mask's area.  Boxes without
    width or height are dropped.  An image whose neighbour has no object keeps its own as
    they are, without an area of their own making.

    Returns (objects with ``area`` and ``pasted``, runs); a pasted object's id is the old one
    after the image's largest.
    """
    from ..session import stored

    k = F.col("image_id")
    order = dense_index(images.select("image_id", "height", "width", F.xxhash64(k, F.lit(seed)).alias("__draw")),
                        ["__draw", "image_id"], "__place")
    placed = stored(order.select("image_id", "height", "width", F.floor(F.col("__place") / batch_size).alias("batch"),
                                 (F.col("__place") % batch_size).alias("at")), "placed")
    size = placed.groupBy("batch").agg(F.count(F.lit(1)).alias("n"))
    before = placed.join(size, "batch").select(
        "image_id", "height", "width", "batch", F.pmod(F.col("at") - 1, F.col("n")).alias("at"))
    pairs = before.join(placed.select("batch", "at", F.col("image_id").alias("source"), F.col("height").alias("sh"), F.col("width").alias("sw")),
                        ["batch", "at"]).select("image_id", "height", "width", "source", "sh", "sw")
    # The draws of a source: its objects (bounded by the image) in order, n draws of a rank.
    n_runs = runs.count()
    rest = [c for c in objects.columns if c not in ("image_id", "obj_id")]
    ordered, whole = Window.partitionBy("image_id").orderBy("obj_id", *rest), Window.partitionBy("image_id")
    u = F.pmod(F.xxhash64(k, F.lit(seed), F.lit(190), F.col("r").cast("long")), F.lit(1 << 30)) / float(1 << 30)
    drawn = _by_image(objects, n_runs).withColumns({"r": F.row_number().over(ordered), "n": F.count(F.lit(1)).over(whole)}).withColumn(
        "drawn", F.collect_set((u * F.col("n")).cast("long")).over(whole)).withColumn(
        "chosen", k.isNotNull() & F.array_contains("drawn", F.col("r").cast("long") - 1)).drop("r", "n", "drawn")
    # Masks travel as packed runs beside their objects; what an image gives goes to its target with them.
    masks_of = _by_image(packed.pack_runs(runs, "obj_id"), n_runs).groupBy("image_id", "obj_id").agg(F.collect_list("runs").alias("runs"))
    given = _by_image(pairs.select(F.col("source").alias("image_id"), F.struct(
        F.col("image_id").alias("to"), "height", "width", "sh", "sw").alias("t")), n_runs).groupBy("image_id").agg(F.collect_list("t").alias("to"))
    j = drawn.join(masks_of, ["image_id", "obj_id"], "left").join(given, "image_id", "left")
    size = F.get("to", F.lit(0))
    itself = F.struct(k.alias("to"), size["sh"].alias("height"), size["sw"].alias("width"), size["sh"].alias("sh"), size["sw"].alias("sw"))
    none = F.array().cast(given.schema["to"].dataType)
    copies = j.select("*", F.posexplode(F.concat(F.array(itself), F.when(F.col("chosen"), F.coalesce("to", none)).otherwise(none))).alias("pos", "t")).withColumn(
        "pasted", F.col("pos") > 0)
    new = _stretched()(F.when(F.col("pasted"), F.col("runs")), "t.sh", "t.sw", "t.height", "t.width")
    sx, sy = (F.when(F.col("pasted"), F.col(f"t.{a}") / F.col(f"t.{b}")).otherwise(F.lit(1.0)) for a, b in (("width", "sw"), ("height", "sh")))
    made = copies.withColumn("__new", new).select(
        F.col("t.to").alias("image_id"), "obj_id", "category_id", *[(F.col(c) * s).alias(c) for c, s in (("x1", sx), ("y1", sy), ("x2", sx), ("y2", sy))],
        "iscrowd", "pasted", F.when(F.col("pasted"), F.col("__new")).otherwise(F.col("runs")).alias("runs"), "t.height", "t.width")
    pasted = stored(made, "pasted")
    dealt = _by_image(pasted, n_runs).sortWithinPartitions("image_id", "pasted", "obj_id")
    columns = ["image_id", "obj_id", "category_id", "x1", "y1", "x2", "y2", "iscrowd", "pasted", "area"]
    kinds = {c: "double" if c == "area" else pasted.schema[c].dataType.simpleString() for c in columns}

    def left(more: dict[str, str]) -> DataFrame:
        fields = {**kinds, **more}
        return dealt.mapInArrow(_occlude(fields, "runs" in more), ", ".join(f"{c} {t}" for c, t in fields.items()))

    out = stored(left({}), "left")
    sizes = {c: pasted.schema[c].dataType.simpleString() for c in ("height", "width")}
    moved = left({**sizes, "runs": "binary"}).dropDuplicates(["image_id", "obj_id"]).select(
        "image_id", "obj_id", F.inline(packed.unpacked(F.col("runs"))), "height", "width")
    return out, moved


def compose(df: DataFrame, *steps) -> DataFrame:
    """Apply transforms in order (``DataFrame.transform`` chain)."""
    for s in steps:
        df = df.transform(s)
    return df


# ----------------------------------------------------------------- B1 ----

def annotations_from_masks(files: DataFrame, mask_px: DataFrame, sizes: DataFrame,
                           image_dims: DataFrame | None = None, threshold: int = 0
                           ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """COCO tables from a folder of lesion masks.

    ``files`` (id, name) lists every mask file; image ids are positions in
    file-name order from 0, so unreadable files leave gaps.  ``mask_px``
    (image_id, x, y, value) and ``sizes`` (image_id, height, width) cover the
    readable masks only.  Annotation ids count non-empty masks from 0 in the
    same order; one category.  ``image_dims`` (id, width, height) of the
    photographs overrides the mask size when present (J6).
    Returns (images, annotations, categories).
    """
    spark = files.sparkSession
    numbered = dense_index(files.select("id", "name"), ["name"], "image_id", 0)
    readable = numbered.join(sizes.withColumnRenamed("image_id", "id"), "id", "inner")
    fg = masks.foreground(mask_px, threshold)
    runs = masks.encode_runs(fg, sizes)
    ar = masks.areas(runs, per_object=False).select(F.col("image_id").alias("id"), F.col("area").cast("double"))
    bx = masks.boxes(runs).select(F.col("image_id").alias("id"), "bbox")
    seg = masks.coco_counts(runs, sizes).select(F.col("image_id").alias("id"), "segmentation")
    ann = readable.select("id", "image_id", "name").join(ar, "id").join(bx, "id").join(seg, "id")
    ann = dense_index(ann, ["name"], "ann_id", 0).select(
        F.col("ann_id").alias("id"), "image_id", F.lit(LESION_CATEGORY[0]).alias("category_id"), "segmentation",
        "area", "bbox", F.lit(0).alias("iscrowd"))
    images = readable.select("id", "image_id", F.replace(F.col("name"), F.lit(".png"), F.lit(".jpg")).alias("file_name"),
                             "width", "height")
    if image_dims is not None:
        d = image_dims.select(F.col("id").alias("__pid"), F.col("width").alias("__w"), F.col("height").alias("__h"))
        images = images.join(d, images["id"] == d["__pid"], "left").withColumns(
            {"width": F.coalesce("__w", "width"), "height": F.coalesce("__h", "height")})
    images = images.select(F.col("image_id").alias("id"), "file_name", "width", "height")
    cats = spark.createDataFrame([LESION_CATEGORY], "id int, name string, supercategory string")
    return images, ann, cats
