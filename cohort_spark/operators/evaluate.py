"""Segmentation and detection evaluation.

Per-image confusion counts come from run tables (``masks.overlap``), the six
metrics are column arithmetic, and summaries are partial aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import masks

EPS = 1e-6
# Fixed metric order of the evaluation report (must equal the source's).
METRICS = ["dice", "iou", "precision", "recall", "specificity", "accuracy"]


def best_per_image(preds: DataFrame, key: str, obj: str, score: str) -> DataFrame:
    """The highest-scoring prediction per image; the first index wins ties.

    ``max_by`` on (score, -index) is a partial aggregate, so an image with
    many predictions is reduced before the shuffle.
    """
    best = preds.groupBy(key).agg(
        F.max_by(F.struct(F.col(obj).alias("o"), F.col(score).alias("s")),
                 F.struct(F.col(score), -F.col(obj))).alias("__b"))
    return best.select(key, F.col("__b.o").alias(obj), F.col("__b.s").alias(score))


def best_masks(objects: DataFrame, probabilities: DataFrame, sizes: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The predicted mask of every image as runs of the image's own size.

    ``objects`` (image_id, obj_id, score, height, width: of the object's mask) has none or
    more rows for an image, ``probabilities`` (image_id, obj_id, x, y, value) their soft
    masks, ``sizes`` (image_id, height, width) the target's size.  The best object is
    picked on the narrow object table before any pixel is touched (W9); its soft mask is
    resized bilinearly (I16) and then cut at ``threshold``.
    """
    best = best_per_image(objects, "image_id", "obj_id", "score").select("image_id", "obj_id")
    chosen = objects.join(best, ["image_id", "obj_id"], "left_semi")
    to = chosen.select("image_id", "height", "width").join(
        sizes.select("image_id", F.col("height").alias("out_height"), F.col("width").alias("out_width")), "image_id")
    px = probabilities.join(best, ["image_id", "obj_id"], "left_semi").select("image_id", "x", "y", "value")
    return masks.encode_runs(masks.foreground(masks.resize_bilinear(px, to), threshold), sizes)


def confusion(target_runs: DataFrame, pred_runs: DataFrame, sizes: DataFrame,
              scores: DataFrame | None = None) -> DataFrame:
    """V1: TP, FP, FN, TN per image.

    The target is the union of the image's objects (I14); images with an
    empty target are skipped; an image without prediction counts as an
    all-zero mask.  TN = w·h − TP − FP − FN.  With ``scores`` (image_id, obj_id,
    score) only the best prediction of each image counts (W9); without, all of
    its runs are one prediction.  Target and prediction must have the image's size
    (``best_masks`` resizes); the query fails on any other.
    """
    if scores is not None:
        best = best_per_image(scores, "image_id", "obj_id", "score")
        pred_runs = pred_runs.join(best.select("image_id", "obj_id"), ["image_id", "obj_id"], "left_semi")

    # Ends of runs in their order: between two ends the running counts tell which masks cover
    # the pixels, so unions, areas and overlap take one sort.  Only ends go on, in stages of their own.
    def ends(runs: DataFrame, t: int, p: int) -> DataFrame:
        return runs.select("image_id", "height", "width", F.lit(t == 1).alias("target"), F.inline(F.array(
            F.struct(F.col("start").alias("at"), F.lit(t).alias("t"), F.lit(p).alias("p")),
            F.struct((F.col("start") + F.col("len")).alias("at"), F.lit(-t).alias("t"), F.lit(-p).alias("p")))))

    both = ends(target_runs, 1, 0).unionByName(ends(pred_runs, 0, 1)).where(F.col("image_id").isNotNull()).repartition("image_id")
    w = Window.partitionBy("image_id").orderBy("at")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pieces = both.withColumns({"t": F.sum("t").over(upto), "p": F.sum("p").over(upto), "n": F.lead("at").over(w) - F.col("at")})

    def pixels(covered: Column) -> Column:
        return F.coalesce(F.sum(F.when(covered, F.col("n"))), F.lit(0))

    in_t, in_p = F.col("t") > 0, F.col("p") > 0
    sums = pieces.groupBy("image_id").agg(
        pixels(in_t).alias("area_t"), pixels(in_p).alias("area_p"), pixels(in_t & in_p).alias("intersection"),
        F.bool_or("target").alias("has_target"), *[f(c).alias(f"{n}_{c}") for c in ("height", "width") for n, f in (("low", F.min), ("high", F.max))])
    j = sizes.join(sums.where("has_target"), "image_id")
    unequal = F.lit(False)
    for c in ("height", "width"):
        unequal |= F.coalesce((F.col(f"low_{c}") != F.col(c)) | (F.col(f"high_{c}") != F.col(c)), F.lit(False))
    TP = F.when(unequal, F.raise_error(F.concat(F.lit("masks of image "), F.col("image_id").cast("string"), F.lit(
        " do not have its size; resize them first")))).otherwise(F.col("intersection"))
    FP = F.col("area_p") - TP
    FN = F.col("area_t") - TP
    TN = F.col("height") * F.col("width") - TP - FP - FN
    return j.select("image_id", TP.cast("double").alias("TP"), FP.cast("double").alias("FP"),
                    FN.cast("double").alias("FN"), TN.cast("double").alias("TN"))


def metrics(conf: DataFrame, eps: float = EPS) -> DataFrame:
    """V2: six metrics with ``eps`` in numerator and denominator (0/0 → 1)."""
    TP, FP, FN, TN = (F.col(c) for c in ("TP", "FP", "FN", "TN"))
    e = F.lit(eps)
    return conf.select(
        "image_id",
        ((2 * TP + e) / (2 * TP + FP + FN + e)).alias("dice"),
        ((TP + e) / (TP + FP + FN + e)).alias("iou"),
        ((TP + e) / (TP + FP + e)).alias("precision"),
        ((TP + e) / (TP + FN + e)).alias("recall"),
        ((TN + e) / (TN + FP + e)).alias("specificity"),
        ((TP + TN + e) / (TP + TN + FP + FN + e)).alias("accuracy"),
    )


def long_scores(per_image: DataFrame) -> DataFrame:
    """V4: long per-image results, metric names ``<metric>_scores``."""
    return per_image.unpivot(["image_id"], METRICS, "metric", "value").withColumn(
        "metric", F.concat(F.col("metric"), F.lit("_scores")))


def summary(per_image: DataFrame, ddof: int = 0) -> DataFrame:
    """V3: ``(metric, value, std)`` rows ``mean_dice … mean_accuracy``, population
    std (numpy default).  One aggregate pass, then a 6-row unpivot."""
    sd = F.stddev_pop if ddof == 0 else F.stddev_samp
    agg = per_image.agg(*[F.avg(m).alias(f"mean_{m}") for m in METRICS],
                        *[sd(m).alias(f"std_{m}") for m in METRICS])
    stack = F.stack(F.lit(len(METRICS)), *[x for i, m in enumerate(METRICS)
                                         for x in (F.lit(i), F.lit(f"mean_{m}"), F.col(f"mean_{m}"), F.col(f"std_{m}"))])
    return agg.select(stack.alias("pos", "metric", "value", "std")).orderBy("pos").drop("pos")


def per_epoch(per_image: DataFrame, epoch: str = "epoch") -> DataFrame:
    """V7: evaluation once per epoch → history columns ``val_<metric>``."""
    return per_image.groupBy(epoch).agg(*[F.avg(m).alias(f"val_{m}") for m in METRICS]).orderBy(epoch)


# ------------------------------------------------------------- boxes ----

def box_iou(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """IoU of every box pair sharing the key (boxes ``x, y, w, h``).

    Pairs are formed only inside an image (equi-join on the key), as box
    IoU needs; the pair count is the per-image product of box counts.
    """
    keys = list(keys)
    ra = a.select(*keys, F.col("obj_id").alias("a_id"), F.col("x").alias("ax"), F.col("y").alias("ay"),
                  (F.col("x") + F.col("w")).alias("ax2"), (F.col("y") + F.col("h")).alias("ay2"))
    rb = b.select(*[F.col(k).alias(f"__b_{k}") for k in keys], F.col("det_id").alias("b_id"),
                  F.col("x").alias("bx"), F.col("y").alias("by"),
                  (F.col("x") + F.col("w")).alias("bx2"), (F.col("y") + F.col("h")).alias("by2"))
    j = ra.join(rb, [ra[k] == rb[f"__b_{k}"] for k in keys], "inner")
    iw = F.greatest(F.lit(0.0), F.least("ax2", "bx2") - F.greatest("ax", "bx"))
    ih = F.greatest(F.lit(0.0), F.least("ay2", "by2") - F.greatest("ay", "by"))
    inter = iw * ih
    area_a = (F.col("ax2") - F.col("ax")) * (F.col("ay2") - F.col("ay"))
    area_b = (F.col("bx2") - F.col("bx")) * (F.col("by2") - F.col("by"))
    union = area_a + area_b - inter
    return j.select(*keys, "a_id", "b_id", F.when(union > 0, inter / union).otherwise(F.lit(0.0)).alias("iou"))
