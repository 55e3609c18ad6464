"""COCO-style detection evaluation (V5, V6): average precision and recall of boxes,
masks and keypoints.

Rules from the COCO evaluation description (Lin et al. 2014): similarity thresholds
.50:.05:.95, 101 recall points, a number of detections per image and category, area
ranges.  Per (image, category) detections are taken in score order; each takes the most
similar free target of at least t, targets that count before ignored ones (a crowd target
can absorb many detections).  Crowd targets, targets outside the area range and, for
keypoints, targets without a labelled point are ignored, as are unmatched detections
outside the range.  The similarity is

* ``bbox``: box overlap (IoU; a crowd target's overlap is divided by the detection),
* ``segm``: the same on masks given as runs, which meet by (image, category, column),
* ``keypoints``: object keypoint similarity, by the target's labelled points; a target
  without any is compared by its box, doubled on each side.

Spark layout: detections and targets are shuffled once, by image, in a compact form (runs and
keypoints as packed bytes), and meet in sorted order (image, category, side, number).  Array
passes over many whole (image, category) groups form the pairs, a bounded number at
once, and decide them rank by rank, ranges and thresholds together: pairs are never shuffled.
A group is bounded by the detection limit and the objects of one image.  Accumulation over
images is distributed: detections with their codes, two words of bits, are written once and sorted by range over
(category, score), so a category holding most detections is still spread over all
tasks, and running TP/FP sums start at the sums of the parts before; the precision envelope and the 101-point interpolation are aggregates over at most
101 recall buckets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, stored
from .coco_packed import ABSENT, LABELLED, changes, flags, no_labels, numbers, pack_points, pack_runs, unpack_points, unpack_runs, whole_groups
from .match import range_partitions

# Fixed evaluation parameters of the COCO protocol.
IOU_THRS = [round(0.5 + 0.05 * k, 2) for k in range(10)]
REC_THRS = [float(x) for x in np.linspace(0.0, 1.0, 101)]
AREAS = {"all": (0.0, 1e10), "small": (0.0, 32.0 ** 2), "medium": (32.0 ** 2, 96.0 ** 2), "large": (96.0 ** 2, 1e10)}
AREA_NAMES = list(AREAS)
MAX_DETS = [1, 10, 100]
KEYPOINT_MAX_DETS = [20]
# Spread of the 17 person keypoints, fixed values of the protocol.
SIGMAS = [0.026, 0.025, 0.025, 0.035, 0.035, 0.079, 0.079, 0.072, 0.072, 0.062, 0.062, 0.107, 0.107, 0.087, 0.087, 0.089, 0.089]
EPS = float(np.spacing(1))
FALSE, TRUE, IGNORED = 0, 1, 2
STEP = 20000  # pairs formed and decided at once, and rows of whole groups taken together
_GROUP = ["image_id", "category_id"]


@dataclass(frozen=True)
class Report:
    """Area ranges of a kind, its numbers of detections, and its lines: (metric, value,
    area range, detections, threshold or None for the mean)."""

    areas: list[str]
    max_dets: list[int]
    lines: list[tuple[str, str, str, int, float | None]]


def report(kind: str, max_dets: Sequence[int] | None = None) -> Report:
    """The summary of a kind.  ``max_dets`` is ascending; the last one limits matching."""
    if kind == "keypoints":
        most = list(max_dets or KEYPOINT_MAX_DETS)
        n = most[-1]
        lines = [(name + label, column, area, n, t) for name, column in (("AP", "ap"), ("AR", "recall"))
                 for label, area, t in (("", "all", None), ("50", "all", 0.5), ("75", "all", 0.75), ("m", "medium", None), ("l", "large", None))]
        return Report(["all", "medium", "large"], most, lines)
    if kind not in ("bbox", "segm"):
        raise ValueError(f"unknown kind {kind}")
    most = list(max_dets or MAX_DETS)
    n = most[-1]
    lines = [("AP", "ap", "all", n, None), ("AP50", "ap", "all", n, 0.5), ("AP75", "ap", "all", n, 0.75)]
    lines += [(f"AP{a[0]}", "ap", a, n, None) for a in AREA_NAMES[1:]]
    lines += [(f"AR{m}", "recall", "all", m, None) for m in most]
    lines += [(f"AR{a[0]}", "recall", a, n, None) for a in AREA_NAMES[1:]]
    return Report(AREA_NAMES, most, lines)


# ---------------------------------------------------------------- similarity ----

def top_detections(dets: DataFrame, most: int) -> DataFrame:
    """The best ``most`` detections per (image, category) with their ``rank``, dealt by image."""
    w = Window.partitionBy(*_GROUP).orderBy(F.desc("score"), "det_id")
    return dets.repartition("image_id").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def numbered_targets(gts: DataFrame) -> DataFrame:
    """Targets with their number ``g`` in (image, category), by obj_id, else by all columns; dealt by image."""
    order = ["obj_id"] if "obj_id" in gts.columns else sorted(c for c in gts.columns if c not in _GROUP)
    return gts.repartition("image_id").withColumn("g", F.row_number().over(Window.partitionBy(*_GROUP).orderBy(*order)))


def compact_points(objects: DataFrame, sigmas: Sequence[float] = SIGMAS) -> DataFrame:
    """``objects`` with their keypoints as packed bytes, to be shuffled."""
    if objects.schema["keypoints"].dataType.simpleString() == "binary":
        return objects
    return objects.withColumn("keypoints", pack_points(F.col("keypoints"), len(sigmas)))


@dataclass(frozen=True)
class _Kind:
    """What a similarity takes of detections and targets, and the function that makes it from their
    sorted rows: ``of(table, first, target)`` → (areas of the detections, function of pairs).

    A row is one object, or a part of it (masks); ``first`` marks an object's first row.  A
    pair is the place of a detection and that of a target in ``table``'s objects."""

    dets: list[Column]
    targets: list[Column]
    of: Callable


def _ious(both: np.ndarray, own: np.ndarray, target: np.ndarray, crowd: np.ndarray) -> np.ndarray:
    union = np.where(crowd, own, own + target - both)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(union > 0, both / union, 0.0)


def _box_kind() -> _Kind:
    def of(table: pa.Table, first: np.ndarray, target: np.ndarray) -> tuple:
        x, y, w, h = (numbers(table.column(c)) for c in "xywh")
        crowd = flags(table.column("crowd"))

        def similar(d: np.ndarray, g: np.ndarray) -> np.ndarray:
            # Bounds pass over what is null, as least and greatest do.
            both = 1.0
            for at, size in ((x, w), (y, h)):
                both = both * np.fmax(0.0, np.fmin(at[d] + size[d], at[g] + size[g]) - np.fmax(at[d], at[g]))
            return _ious(both, w[d] * h[d], w[g] * h[g], crowd[g])

        return w * h, similar

    sides = [F.col(c).cast("double").alias(c) for c in "xywh"]
    return _Kind(sides, [*sides, _crowd()], of)


def _crowd() -> Column:
    return F.coalesce(F.col("iscrowd") == 1, F.lit(False)).alias("crowd")


def _mask_kind() -> _Kind:
    def of(table: pa.Table, first: np.ndarray, target: np.ndarray) -> tuple:
        row, start, length = unpack_runs(table.column("runs"))
        item = (np.cumsum(first) - 1)[row]
        n = int(first.sum())
        area = np.bincount(item, weights=length, minlength=n)
        crowd = flags(table.column("crowd"))[first]
        # Runs of one object lie together; ends are sorted on their own, so runs may overlap.
        span = int((start + length).max(initial=0)) + 2
        held = np.bincount(item, minlength=n)
        offset = np.concatenate(([0], np.cumsum(held)))
        edges = [np.sort(item * span + e) for e in (start, start + length)]
        sums = [np.concatenate(([0], np.cumsum(e - item * span))) for e in edges]
        low, high = np.full(n, span), np.full(n, -1)
        np.minimum.at(low, item, start)
        np.maximum.at(high, item, start + length)

        def below(g: np.ndarray, at: np.ndarray) -> np.ndarray:
            """Pixels of object g before ``at``, each run for itself."""
            total = np.zeros(len(g), dtype=np.int64)
            for sign, edge, s in ((1, edges[0], sums[0]), (-1, edges[1], sums[1])):
                k = np.searchsorted(edge, g * span + np.clip(at, 0, span - 1))
                total += sign * ((k - offset[g]) * at - (s[k] - s[offset[g]]))
            return total

        def similar(d: np.ndarray, g: np.ndarray) -> np.ndarray:
            both = np.zeros(len(d), dtype=np.int64)
            meet = np.flatnonzero((low[d] < high[g]) & (low[g] < high[d]))
            while len(meet):  # as many pairs at a time as STEP runs hold, at least one
                runs = np.cumsum(held[d[meet]])
                now, meet = np.split(meet, [max(1, int(np.searchsorted(runs, STEP, side="right")))])
                many = held[d[now]]
                pair = np.repeat(np.arange(len(now)), many)
                r = np.repeat(offset[d[now]], many) + np.arange(len(pair)) - np.repeat(np.cumsum(many) - many, many)
                with_g = g[now][pair]
                covered = below(with_g, start[r] + length[r]) - below(with_g, start[r])
                both[now] = np.bincount(pair, weights=covered, minlength=len(now)).astype(np.int64)
            return np.where(both > 0, _ious(both, area[d], area[g], crowd[g]), np.nan)

        return area, similar

    return _Kind([F.col("runs")], [F.col("runs"), _crowd()], of)


def _point_kind(sigmas: Sequence[float]) -> _Kind:
    spread = (2 * np.array(sigmas)) ** 2

    def of(table: pa.Table, first: np.ndarray, target: np.ndarray) -> tuple:
        at, shown, state = unpack_points(table.column("keypoints"), len(spread))
        corner, size = (np.stack([numbers(table.column(c)) for c in pair], axis=1)[:, :, None] for pair in (("x", "y"), ("w", "h")))
        area = numbers(table.column("t_area")) + EPS
        # The side of the points' box on each axis; an axis without points has none.
        extent = np.where(np.isnan(at), -np.inf, at).max(2) - np.where(np.isnan(at), np.inf, at).min(2)
        extent[np.isinf(extent)] = np.nan

        def similar(d: np.ndarray, g: np.ndarray) -> np.ndarray:
            labelled = state[g] == LABELLED
            apart = at[d] - at[g]
            bare = np.flatnonzero(~labelled)
            low, high = corner[g[bare]] - size[g[bare]], corner[g[bare]] + 2 * size[g[bare]]
            apart[bare] = np.fmax(0.0, low - at[d[bare]]) + np.fmax(0.0, at[d[bare]] - high)
            value = np.exp(-((apart ** 2).sum(1) / spread / area[g][:, None] / 2))
            counts = shown[g] | (state[g] == ABSENT)[:, None]
            with np.errstate(divide="ignore", invalid="ignore"):
                return np.where(counts, value, 0.0).sum(1) / counts.sum(1)

        return extent[:, 0] * extent[:, 1], similar

    sides = [F.col(c).cast("double").alias(c) for c in "xywh"]
    return _Kind([F.col("keypoints")], [F.col("keypoints"), *sides, F.col("area").cast("double").alias("t_area")], of)


def _sides(top: DataFrame, targets: DataFrame, dets: Sequence[Column | str], theirs: Sequence[Column | str]) -> DataFrame:
    """Detections and targets, all of an image in one task, in the order (image, category, ``target``, number ``n``)."""
    known = F.col("image_id").isNotNull() & F.col("category_id").isNotNull()  # no null meets another
    both = top.select(*_GROUP, F.lit(False).alias("target"), F.col("rank").alias("n"), *dets).unionByName(
        targets.where(known).select(*_GROUP, F.lit(True).alias("target"), F.col("g").alias("n"), *theirs), allowMissingColumns=True)
    order = [*_GROUP, "target", "n"]
    # The window asks for an image's rows in one task, wherever the planner put those of the union.
    w = Window.partitionBy(*_GROUP, "target").orderBy("n")
    return both.withColumn("place", F.row_number().over(w)).sortWithinPartitions(*order)


def _pairs(table: pa.Table, of: Callable) -> tuple:
    """Of whole groups: the objects' first rows, which of them are targets, areas, and the
    pairs of each group as blocks (detection, target, similarity or NaN), sorted by detection and target."""
    group = np.cumsum(changes(*(table.column(c) for c in _GROUP))) - 1
    target = flags(table.column("target"))
    n = table.column("n").to_numpy()
    first = np.ones(len(n), dtype=bool)
    first[1:] = (group[1:] != group[:-1]) | (target[1:] != target[:-1]) | (n[1:] != n[:-1])
    area, similar = of(table, first, target)
    group, target = group[first], target[first]
    dets, ours = np.flatnonzero(~target), np.flatnonzero(target)
    low, high = (np.searchsorted(group[ours], group[dets], side=s) for s in ("left", "right"))

    def blocks() -> Iterator[tuple]:
        ends = np.concatenate(([0], np.cumsum(high - low)))
        at = 0
        while at < len(dets):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + STEP, side="right")) - 1)
            many = (high - low)[at:to]
            d = np.repeat(dets[at:to], many)
            if len(d):
                g = ours[np.repeat(low[at:to], many) + np.arange(len(d)) - np.repeat(np.cumsum(many) - many, many)]
                yield d, g, similar(d, g)
            at = to

    return first, target, area, blocks()


def _similarities(top: DataFrame, targets: DataFrame, kind: _Kind, overlapping: bool = False) -> DataFrame:
    """(image_id, category_id, rank, g, iou) of all pairs of a group, with det_id and obj_id where they are known."""
    named = [[c for c in (name,) if c in side.columns] for name, side in (("det_id", top), ("obj_id", targets))]
    rows = _sides(top, targets, [*kind.dets, *named[0]], [*kind.targets, *named[1]])
    ids, of = [*named[0], *named[1]], kind.of

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, _GROUP, STEP):
            first, _, _, blocks = _pairs(table, of)
            rows_of = np.flatnonzero(first)
            for d, g, iou in blocks:
                if overlapping:
                    d, g, iou = (v[~np.isnan(iou)] for v in (d, g, iou))
                d, g = pa.array(rows_of[d]), pa.array(rows_of[g])
                own = [table.column(c).take(d) for c in _GROUP]
                names = [table.column(c).take(d if c == "det_id" else g) for c in ids]
                yield from pa.table([*own, table.column("n").take(d), table.column("n").take(g), *names, pa.array(iou, from_pandas=True)],
                                    names=[*_GROUP, "rank", "g", *ids, "iou"]).to_batches()

    kinds = {c: f"{c} {rows.schema[c].dataType.simpleString()}" for c in (*_GROUP, *ids)}
    return rows.mapInArrow(run, ", ".join([*[kinds[c] for c in _GROUP], "rank int", "g int", *[kinds[c] for c in ids], "iou double"]))


def box_similarity(top: DataFrame, targets: DataFrame) -> DataFrame:
    """(image_id, category_id, rank, g, iou) of the boxes (x, y, w, h) of a group."""
    return _similarities(top, targets, _box_kind())


def with_runs(objects: DataFrame, runs: DataFrame, obj: str) -> DataFrame:
    """Objects dealt by image with their packed ``runs``, in one row or more; null without any."""
    packed = pack_runs(runs, obj).repartition("image_id")
    return objects.join(packed, ["image_id", obj], "left")


def mask_similarity(top: DataFrame, targets: DataFrame, det_runs: DataFrame, gt_runs: DataFrame) -> DataFrame:
    """(image_id, category_id, rank, g, iou) of the masks that overlap; runs are
    (image_id, det_id or obj_id, start, len, height, width), of one height in an image."""
    return _similarities(with_runs(top, det_runs, "det_id"), with_runs(targets, gt_runs, "obj_id"), _mask_kind(), overlapping=True)


def keypoint_similarity(top: DataFrame, targets: DataFrame, sigmas: Sequence[float] = SIGMAS) -> DataFrame:
    """(image_id, category_id, rank, g, iou): keypoint similarity.

    ``keypoints`` are arrays of structs (x, y, v), or packed (``compact_points``); targets also
    have a box and ``area``.
    """
    return _similarities(compact_points(top, sigmas), compact_points(targets, sigmas), _point_kind(sigmas))


# ------------------------------------------------------------------- matching ----

def _codes(d_area: np.ndarray, d_rank: np.ndarray, g_ignored: np.ndarray, g_crowd: np.ndarray, of: np.ndarray, target: np.ndarray,
           similar: np.ndarray, ranges: np.ndarray) -> np.ndarray:
    """Codes (detection, area range, threshold) of the detections of many groups.
    ``g_ignored`` is (target, range); pairs (``of`` a detection, ``target``) are sorted.

    Groups share no target, so the detections of one rank are decided at once, for all ranges
    and thresholds; the order of preference is (target that counts, similarity, later target).
    """
    limits = np.minimum(np.array(IOU_THRS), 1 - 1e-10)
    free = np.ones((len(g_crowd), len(ranges), len(limits)), dtype=bool)
    out = np.full((len(d_area), len(ranges), len(limits)), FALSE, dtype=np.int32)
    beyond = (d_area[:, None] < ranges[:, 0]) | (d_area[:, None] > ranges[:, 1])
    out[beyond] = IGNORED
    turn = np.argsort(d_rank[of], kind="stable")
    for pairs in np.split(turn, np.flatnonzero(np.diff(d_rank[of][turn])) + 1) if len(turn) else []:
        # A rank has at most one detection of a group; a detection's pairs stay together.
        heads = np.flatnonzero(np.diff(of[pairs], prepend=-1))
        high = 0
        while high < len(heads):
            low, high = high, max(high + 1, int(np.searchsorted(heads, heads[high] + STEP)))
            end = heads[high] if high < len(heads) else len(pairs)
            mine, first = pairs[heads[low]:end], heads[low:high] - heads[low]
            g, d, value = target[mine], of[mine[first]], similar[mine]
            ignored = g_ignored[g][:, :, None]
            allowed = (value[:, None] >= limits)[:, None, :] & (free[g] | g_crowd[g][:, None, None])
            value = np.where(allowed, value[:, None, None] + 2 * ~ignored, -1)
            best = np.maximum.reduceat(value, first)
            held = np.repeat(best, np.diff(first, append=len(mine)), axis=0)
            last = np.maximum.reduceat(np.where(value == held, np.arange(len(mine))[:, None, None], -1), first)
            hit = best >= 0
            at = np.nonzero(hit)
            won = g[last[at]]
            out[d[at[0]], at[1], at[2]] = np.where(g_ignored[won, at[1]], IGNORED, TRUE)
            free[won, at[1], at[2]] = False
    return out


def _bits(flags: np.ndarray) -> np.ndarray:
    """Rows of at most 63 truth values as numbers, the first value the lowest bit."""
    return flags @ (np.int64(1) << np.arange(flags.shape[1], dtype=np.int64))


def _values(bits: np.ndarray, width: int) -> np.ndarray:
    """Numbers → rows of ``width`` truth values."""
    return np.unpackbits(np.ascontiguousarray(bits, dtype="<i8").view(np.uint8).reshape(-1, 8), axis=1, count=width, bitorder="little").astype(bool)


def match(top: DataFrame, targets: DataFrame, kind: _Kind, areas: Sequence[str] = AREA_NAMES) -> DataFrame:
    """Per detection: ``(image_id, category_id, score, rank, hits, misses)``; bit a·10 + t of ``hits`` (TP) and
    ``misses`` (FP) stands for area range a and threshold t, and neither is set where it is ignored.

    ``targets`` have ``iscrowd``, ``area`` and, where some do not count, ``ignore``."""
    ranges = np.array([AREAS[n] for n in areas])
    ignore = F.col("ignore") if "ignore" in targets.columns else F.lit(False)
    out_of = F.coalesce((F.col("iscrowd") == 1) | ignore, F.lit(False)).alias("out_of")
    theirs = [*kind.targets, out_of, F.col("area").cast("double").alias("of_area"), _crowd().alias("of_crowd")]
    rows, of = _sides(top, targets, [F.col("score"), *kind.dets], theirs), kind.of

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, _GROUP, STEP):
            first, target, area, blocks = _pairs(table, of)
            kept = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))]
            kept += [tuple(v[iou >= IOU_THRS[0]] for v in (d, g, iou)) for d, g, iou in blocks]
            d, g, iou = (np.concatenate(v) for v in zip(*kept, strict=True))
            place = np.where(target, np.cumsum(target), np.cumsum(~target)) - 1
            objects = table.filter(pa.array(first))
            theirs, own = objects.filter(pa.array(target)), objects.filter(pa.array(~target))
            size = numbers(theirs.column("of_area"))
            ignored = flags(theirs.column("out_of"))[:, None] | (size[:, None] < ranges[:, 0]) | (size[:, None] > ranges[:, 1])
            codes = _codes(area[~target], own.column("n").to_numpy(), ignored, flags(theirs.column("of_crowd")),
                           place[d], place[g], iou, ranges).reshape(own.num_rows, len(ranges) * len(IOU_THRS))
            yield from pa.table([*[own.column(c) for c in (*_GROUP, "score", "n")], *(pa.array(_bits(codes == c)) for c in (TRUE, FALSE))],
                                names=[*_GROUP, "score", "rank", "hits", "misses"]).to_batches()

    fields = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in (*_GROUP, "score")]
    return rows.mapInArrow(run, ", ".join([*fields, "rank int", "hits long", "misses long"]))


# --------------------------------------------------------------- accumulation ----

def targets_per_range(gts: DataFrame, areas: Sequence[str] = AREA_NAMES) -> DataFrame:
    """Targets that count per (category, area range): the recall denominators."""
    ignore = F.col("ignore") if "ignore" in gts.columns else F.lit(False)
    ok = (F.col("iscrowd") == 0) & ~ignore
    counts = gts.groupBy("category_id").agg(*[
        F.count_if(ok & (F.col("area") >= AREAS[name][0]) & (F.col("area") <= AREAS[name][1])).alias(f"n{a}")
        for a, name in enumerate(areas)])
    return counts.select("category_id", F.inline(F.array(*[
        F.struct(F.lit(a).alias("a"), F.col(f"n{a}").alias("npig")) for a in range(len(areas))])))


def _part_totals(width: int):
    """Per (part, category) of sorted rows: sums of TP and FP in each range and threshold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if not rows.num_rows:
                continue
            both = np.concatenate([_values(rows.column(c).to_numpy(), width) for c in ("hits", "misses")], axis=1)
            first = np.flatnonzero(changes(rows.column("category_id")))
            sums = np.add.reduceat(both, first, axis=0, dtype=np.int64)
            at = pa.array(first)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(first) + 1, dtype=np.int32) * 2 * width), pa.array(sums.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*(rows.column(c).take(at) for c in ("__pid", "category_id", "__at")), listed],
                                             names=["__pid", "category_id", "first", "sums"])

    return run


def _part_buckets(n_thr: int, max_dets: Sequence[int]):
    """Highest precision and found targets in each (category, range, threshold, recall bucket) of sorted rows.
    The first row of a (part, category) carries the sums before it and the targets of each range."""
    thr = np.array(REC_THRS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        category = before = goal = best = found = None

        def made() -> Iterator[pa.RecordBatch]:
            cell = np.flatnonzero(found.any(axis=0)) if category is not None else []
            if len(cell):
                column, k = cell // len(thr), cell % len(thr)
                yield pa.RecordBatch.from_arrays(
                    [pa.concat_arrays([category] * len(cell)), *(pa.array(v.astype(np.int32)) for v in (column // n_thr, column % n_thr, k)),
                     pa.array(best[cell]), *(pa.array(n[cell]) for n in found)],
                    names=["category_id", "a", "t", "kb", "bm", *[f"tp{m}" for m in max_dets]])

        for rows in batches:
            if not rows.num_rows:
                continue
            of, rank, starts = rows.column("category_id"), rows.column("rank").to_numpy(), rows.column("before")
            heads = np.flatnonzero(changes(of))
            for low, high in pairwise([*heads, rows.num_rows]):
                if category is None or not of.slice(low, 1).equals(category):
                    yield from made()
                    category, before = of.slice(low, 1), np.array(starts[int(low)].as_py(), dtype=np.int64)
                    goal = np.repeat(np.array(rows.column("goal")[int(low)].as_py(), dtype=np.float64), n_thr)
                    best, found = np.zeros(len(goal) * len(thr)), np.zeros((len(max_dets), len(goal) * len(thr)), dtype=np.int64)
                width = len(goal)
                t, f = (_values(rows.column(c).to_numpy()[low:high], width).T for c in ("hits", "misses"))
                # Precision is highest, and recall new, at true positives alone.
                column, row = np.nonzero(t & (goal > 0)[:, None])
                many = t.sum(axis=1)
                true = before[column] + np.arange(len(column)) - np.searchsorted(column, column) + 1.0
                wrong = (np.cumsum(f, axis=1, dtype=np.int32)[column, row] + before[width + column]).astype(np.float64)
                before = before + np.concatenate((many, f.sum(axis=1)))
                if not len(column):
                    continue
                recall, precision = true / goal[column], true / (true + wrong + EPS)
                cell = column * len(thr) + np.searchsorted(thr, recall, side="right") - 1
                head = np.flatnonzero(np.diff(cell, prepend=-1))
                best[cell[head]] = np.maximum(best[cell[head]], np.maximum.reduceat(precision, head))
                for n, m in zip(found, max_dets, strict=True):
                    n[cell[head]] += np.add.reduceat(rank[low:high][row] <= m, head, dtype=np.int64)
        yield from made()

    return run


def recall_buckets(matched: DataFrame, npig: DataFrame, form: Report) -> DataFrame:
    """(category_id, a, t, kb, bm, tp<m>…): the highest precision in each recall bucket
    (kb: the last recall threshold reached) and its true positives among the first m of an image.

    All ranges and thresholds share one order of the detections, so each is sorted once
    with its codes, by range over (category, score): a category with most detections is spread
    over all tasks.  The ranges are drawn from the written rows, so nothing is matched twice.  Sums of each
    (part, category) become the sums before it; running sums
    and the buckets of a batch are array sums in the tasks.
    """
    width, n_thr = len(form.areas) * len(IOU_THRS), len(IOU_THRS)
    order = ["category_id", F.desc("score"), "image_id", "rank"]
    # One row for each category that has targets.
    known = F.broadcast(npig.select("category_id").distinct())
    rows = stored(matched.select("category_id", "score", "image_id", "rank", "hits", "misses").join(known, "category_id", "left_semi"), "matched")
    ranged = materialize(rows.repartitionByRange(range_partitions(rows), *order).sortWithinPartitions(*order)
                         .withColumns({"__pid": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}))
    kind = ranged.schema["category_id"].dataType.simpleString()
    sums = ranged.select("__pid", "category_id", "__at", "hits", "misses").mapInArrow(
        _part_totals(width), f"__pid int, category_id {kind}, first long, sums array<long>")
    each = [F.min("first").alias("first"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(2 * width)]]
    totals = sums.groupBy("__pid", "category_id").agg(*each)
    w = Window.partitionBy("category_id").orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("__pid", "category_id", "first", F.array(*[F.coalesce(F.sum(f"s{i}").over(w), F.lit(0)) for i in range(2 * width)]).alias("before"))
    goals = npig.groupBy("category_id").agg(*[F.sum(F.when(F.col("a") == a, F.col("npig")).otherwise(0)).alias(f"n{a}") for a in range(len(form.areas))])
    before = before.join(goals, "category_id").select(
        "__pid", "category_id", "first", "before", F.array(*[f"n{a}" for a in range(len(form.areas))]).alias("goal"))
    # One row for each (part, category), and parts hold whole stretches of categories: a bounded table.
    known = ranged.join(F.broadcast(before), ["__pid", "category_id"]).select(
        "category_id", "rank", "hits", "misses", *[F.when(F.col("__at") == F.col("first"), F.col(c)).alias(c) for c in ("before", "goal")])
    fields = ", ".join(f"tp{m} long" for m in form.max_dets)
    parts = known.mapInArrow(_part_buckets(n_thr, form.max_dets), f"category_id {kind}, a int, t int, kb int, bm double, {fields}")
    return parts.groupBy("category_id", "a", "t", "kb").agg(F.max("bm").alias("bm"), *[F.sum(f"tp{m}").alias(f"tp{m}") for m in form.max_dets])


def summarise(matched: DataFrame, gts: DataFrame, form: Report) -> DataFrame:
    """The summary numbers ``(metric, value)`` of matched detections."""
    keys = ["category_id", "a", "t"]
    npig = materialize(targets_per_range(gts, form.areas).where(F.col("npig") > 0))
    buckets = stored(recall_buckets(matched, npig, form), "buckets")
    # precision at recall threshold k = max precision over buckets ≥ k (≤ 101 rows per key)
    q = buckets.where(F.col("kb") >= 0).select(*keys, "bm", F.explode(F.sequence(F.lit(0), F.col("kb"))).alias("k"))
    ap = q.groupBy(*keys, "k").agg(F.max("bm").alias("q")).groupBy(*keys).agg((F.sum("q") / len(REC_THRS)).alias("ap"))
    found = buckets.groupBy(*keys).agg(*[F.sum(f"tp{m}").alias(f"tp{m}") for m in form.max_dets])
    # every (category with targets, a, t) counts, with AP and recall 0 when it has no detection
    grid = npig.select("category_id", "a", "npig", F.explode(F.sequence(F.lit(0), F.lit(len(IOU_THRS) - 1))).alias("t"))
    full = grid.join(ap, keys, "left").join(found, keys, "left").select(
        "a", "t", F.coalesce("ap", F.lit(0.0)).alias("ap"),
        *[F.coalesce(F.col(f"tp{m}") / F.col("npig"), F.lit(0.0)).alias(f"recall{m}") for m in form.max_dets])
    values = []
    for metric, column, area, m, t in form.lines:
        mine = F.col("a") == form.areas.index(area)
        if t is not None:
            mine &= F.col("t") == IOU_THRS.index(t)
        value = F.col("ap" if column == "ap" else f"recall{m}")
        values.append(F.struct(F.lit(metric).alias("metric"), F.coalesce(F.avg(F.when(mine, value)), F.lit(-1.0)).alias("value")))
    return full.agg(F.array(*values).alias("v")).select(F.inline("v"))


def evaluate(dets: DataFrame, gts: DataFrame, kind: str = "bbox", det_runs: DataFrame | None = None, gt_runs: DataFrame | None = None,
             max_dets: Sequence[int] | None = None, sigmas: Sequence[float] = SIGMAS) -> DataFrame:
    """V5: the summary numbers ``(metric, value)`` of one kind.

    ``dets`` (image_id, category_id, det_id, score and x, y, w, h, or keypoints), ``gts``
    (image_id, category_id, obj_id, iscrowd, area and the same).  ``segm`` takes the masks
    as runs; a detection's area is its mask's, its box's, or that of its points' box.
    """
    form = report(kind, max_dets)
    if kind == "segm":
        if det_runs is None or gt_runs is None:
            raise ValueError("segm needs the masks as runs")
        top, targets = top_detections(dets, form.max_dets[-1]), numbered_targets(gts)
        matched = match(with_runs(top, det_runs, "det_id"), with_runs(targets, gt_runs, "obj_id"), _mask_kind(), form.areas)
    elif kind == "keypoints":
        packed = compact_points(gts, sigmas)
        top, targets = top_detections(compact_points(dets, sigmas), form.max_dets[-1]), numbered_targets(
            packed.withColumn("ignore", no_labels(F.col("keypoints"))))
        gts = gts.withColumn("ignore", ~F.exists("keypoints", lambda k: k["v"] > 0))
        matched = match(top, targets, _point_kind(sigmas), form.areas)
    else:
        matched = match(top_detections(dets, form.max_dets[-1]), numbered_targets(gts), _box_kind(), form.areas)
    return summarise(matched, gts, form)
