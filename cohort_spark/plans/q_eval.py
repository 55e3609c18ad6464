"""Segmentation and detection evaluation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cocoeval, evaluate, profile
from ..sources import standins
from .catalog import register
from .q_masks import gt_runs

_CONF_SQL = """
t AS (SELECT image_id, x, y FROM mask_gt WHERE value > 0),
p AS (SELECT image_id, x, y FROM pred_resized WHERE shift = 1 AND value > 0.5),
a_t AS (SELECT image_id, count(*) AS area_t FROM t GROUP BY image_id),
a_p AS (SELECT image_id, count(*) AS area_p FROM p GROUP BY image_id),
it AS (SELECT t.image_id, count(*) AS inter FROM t JOIN p ON t.image_id = p.image_id AND t.x = p.x AND t.y = p.y
       GROUP BY t.image_id),
conf AS (SELECT s.image_id, CAST(coalesce(inter, 0) AS DOUBLE) AS TP,
                CAST(coalesce(area_p, 0) - coalesce(inter, 0) AS DOUBLE) AS FP,
                CAST(area_t - coalesce(inter, 0) AS DOUBLE) AS FN,
                CAST(64 - area_t - coalesce(area_p, 0) + coalesce(inter, 0) AS DOUBLE) AS TN
         FROM sizes s JOIN a_t ON s.image_id = a_t.image_id LEFT JOIN a_p ON s.image_id = a_p.image_id
              LEFT JOIN it ON s.image_id = it.image_id),
m AS (SELECT image_id,
        (2 * TP + 1e-6) / (2 * TP + FP + FN + 1e-6) AS dice, (TP + 1e-6) / (TP + FP + FN + 1e-6) AS iou,
        (TP + 1e-6) / (TP + FP + 1e-6) AS precision, (TP + 1e-6) / (TP + FN + 1e-6) AS recall,
        (TN + 1e-6) / (TN + FP + 1e-6) AS specificity, (TP + TN + 1e-6) / (TP + TN + FP + FN + 1e-6) AS accuracy
      FROM conf)"""

METRICS = evaluate.METRICS


VP = ("levels", "mask_gt", "sizes", "pred_resized")


def conf(spark: SparkSession, sf_dir: str, shift: int = 1) -> DataFrame:
    sizes = standins.image_sizes(spark, sf_dir)
    pred = evaluate.best_masks(standins.predicted_objects(spark, sf_dir, shift),
                               standins.predicted_masks(spark, sf_dir, shift), sizes)
    return evaluate.confusion(gt_runs(spark, sf_dir), pred, sizes)


def per_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.metrics(conf(spark, sf_dir))


@register("V1", f"WITH {_CONF_SQL} SELECT image_id, TP, FP, FN, TN FROM conf", VP)
def q_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-image confusion counts of the predicted vs target mask (from runs)."""
    return conf(spark, sf_dir)


@register("V2", f"WITH {_CONF_SQL} SELECT * FROM m", VP)
def q_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six per-image metrics with epsilon smoothing."""
    return per_image(spark, sf_dir)


_V3_SQL = f"WITH {_CONF_SQL} " + " UNION ALL ".join(
    f"SELECT 'mean_{x}' AS metric, avg({x}) AS value, stddev_pop({x}) AS std FROM m" for x in METRICS)


@register("V3", _V3_SQL, VP)
def q_v3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary (metric, value, std): means with population std, fixed metric order."""
    return evaluate.summary(per_image(spark, sf_dir))


@register("V4", f"WITH {_CONF_SQL} " + " UNION ALL ".join(
    f"SELECT image_id, '{x}_scores' AS metric, {x} AS value FROM m" for x in METRICS), VP)
def q_v4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long per-image results (metric names ``*_scores``)."""
    return evaluate.long_scores(per_image(spark, sf_dir))


@register("X9", _V3_SQL, VP)
def q_x9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segmentation evaluation job: best object → resize → runs → confusion → metrics → summary report."""
    from .jobs import evaluate_segmentation
    summary, _ = evaluate_segmentation(gt_runs(spark, sf_dir), standins.predicted_objects(spark, sf_dir),
                                       standins.predicted_masks(spark, sf_dir), standins.image_sizes(spark, sf_dir))
    return summary


@register("G29", f"WITH {_CONF_SQL} " + " UNION ALL ".join(
    f"SELECT '{x}' AS metric, avg({x}) AS value, stddev_samp({x}) AS std FROM m" for x in METRICS), VP)
def q_g29(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean ± sample sd per metric (error bars of the report figure)."""
    return profile.mean_std(evaluate.long_scores(per_image(spark, sf_dir))
                            .withColumn("metric", F.regexp_replace("metric", "_scores$", "")),
                            "metric", "value", ddof=1)


@register("B13", """
SELECT a.image_id, a.obj_id AS a_id, b.det_id AS b_id,
  CASE WHEN (a.w * a.h + b.w * b.h - greatest(0.0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) *
             greatest(0.0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y))) > 0
       THEN greatest(0.0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) *
            greatest(0.0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) /
            (a.w * a.h + b.w * b.h - greatest(0.0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) *
             greatest(0.0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)))
       ELSE 0.0 END AS iou
FROM gt_boxes a JOIN detections b ON a.image_id = b.image_id""", ("gt_boxes", "detections"))
def q_b13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Box IoU of every target/detection pair of the same image."""
    return evaluate.box_iou(standins.gt_boxes(spark, sf_dir), standins.detections(spark, sf_dir))


def _coco_inputs(spark: SparkSession, sf_dir: str):
    d = standins.detections(spark, sf_dir)
    g = standins.gt_boxes(spark, sf_dir).withColumn("area", F.col("w") * F.col("h"))
    return d, g


def _named_inputs(spark: SparkSession, sf_dir: str):
    d, g = _coco_inputs(spark, sf_dir)
    return standins.named_by_box(d, "det_id"), standins.named_by_box(g, "obj_id")


def _mask_inputs(spark: SparkSession, sf_dir: str):
    d, g = _named_inputs(spark, sf_dir)
    return d, g, standins.box_runs(d, "det_id"), standins.box_runs(g, "obj_id")


def _point_inputs(spark: SparkSession, sf_dir: str):
    d, g = _named_inputs(spark, sf_dir)
    return standins.box_keypoints(d, "det_id", False), standins.box_keypoints(g, "obj_id", True)


@register("V5")
def q_v5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """COCO box evaluation: AP@[.50:.95], AP50, AP75, AP by area, AR@1/10/100, AR by area."""
    return cocoeval.evaluate(*_coco_inputs(spark, sf_dir))


@register("V5_segm")
def q_v5_segm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """COCO mask evaluation on run tables (crowd rule included), the same twelve numbers."""
    d, g, dr, gr = _mask_inputs(spark, sf_dir)
    return cocoeval.evaluate(d, g, "segm", dr, gr)


@register("V5_keypoints")
def q_v5_keypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """COCO keypoint evaluation by object keypoint similarity, its ten numbers."""
    return cocoeval.evaluate(*_point_inputs(spark, sf_dir), "keypoints")


def _similar(similar: DataFrame) -> DataFrame:
    """Pairs with the names of their objects."""
    return similar.select("image_id", "category_id", "det_id", "obj_id", "iou")


@register("V5_mask_iou", """
WITH met AS (SELECT d.image_id, d.category_id, det_id, obj_id, sum(least(d.e, g.e) - greatest(d.s, g.s)) AS n
              FROM det_runs d JOIN gt_runs g ON d.image_id = g.image_id AND d.category_id = g.category_id AND d.c = g.c
                AND d.s < g.e AND g.s < d.e GROUP BY ALL),
da AS (SELECT image_id, det_id, sum(e - s) AS own FROM det_runs GROUP BY ALL),
ga AS (SELECT image_id, obj_id, sum(e - s) AS target FROM gt_runs GROUP BY ALL)
SELECT image_id, category_id, det_id, obj_id, n / (CASE WHEN iscrowd = 1 THEN own ELSE own + target - n END) AS iou
FROM met JOIN da USING (image_id, det_id) JOIN ga USING (image_id, obj_id)
     JOIN (SELECT image_id, obj_id, iscrowd FROM gt_named) USING (image_id, obj_id)""", ("gt_runs", "det_runs"))
def q_v5_mask_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mask IoU of every overlapping detection/target pair of an image and category, from runs."""
    d, g, dr, gr = _mask_inputs(spark, sf_dir)
    top, targets = cocoeval.top_detections(d, cocoeval.MAX_DETS[-1]), cocoeval.numbered_targets(g)
    return _similar(cocoeval.mask_similarity(top, targets, dr, gr))


@register("V5_oks", f"""
WITH s AS (SELECT unnest({cocoeval.SIGMAS}) AS sigma, unnest(range(17)) AS i),
g AS (SELECT *, max(v) OVER (PARTITION BY image_id, obj_id) > 0 AS labelled FROM gt_points),
e AS (SELECT image_id, category_id, det_id, obj_id,
        (CASE WHEN labelled THEN pow(d.kx - g.kx, 2) + pow(d.ky - g.ky, 2)
              ELSE pow(greatest(0.0, bx - bw - d.kx) + greatest(0.0, d.kx - (bx + 2 * bw)), 2)
                 + pow(greatest(0.0, by_ - bh - d.ky) + greatest(0.0, d.ky - (by_ + 2 * bh)), 2) END)
        / pow(2 * sigma, 2) / (area + {cocoeval.EPS!r}) / 2 AS e
      FROM det_points d JOIN g USING (image_id, category_id, i) JOIN s USING (i) WHERE NOT labelled OR v > 0)
SELECT image_id, category_id, det_id, obj_id, avg(exp(-e)) AS iou FROM e GROUP BY ALL""", ("gt_points", "det_points"))
def q_v5_oks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Object keypoint similarity of every detection/target pair of an image and category."""
    d, g = _point_inputs(spark, sf_dir)
    d, g = cocoeval.compact_points(d), cocoeval.compact_points(g)
    top, targets = cocoeval.top_detections(d, cocoeval.MAX_DETS[-1]), cocoeval.numbered_targets(g)
    return _similar(cocoeval.keypoint_similarity(top, targets))


@register("V6")
def q_v6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation of a model with masks by each kind that applies to it: boxes and masks."""
    from .jobs import evaluate_detector, iou_types
    d, g, dr, gr = _mask_inputs(spark, sf_dir)
    return evaluate_detector(d, g, iou_types(has_masks=True, has_keypoints=False), dr, gr)


EPOCHS = (1, 2, 3)
_EP = ", ".join(f"({e})" for e in EPOCHS)


@register("V7", f"""
WITH ep AS (SELECT e AS epoch FROM (VALUES {_EP}) t(e)),
p_all AS (SELECT shift AS epoch, image_id, x, y FROM pred_resized WHERE value > 0.5),
t AS (SELECT image_id, x, y FROM mask_gt WHERE value > 0),
a_t AS (SELECT image_id, count(*) AS area_t FROM t GROUP BY image_id),
a_p AS (SELECT epoch, image_id, count(*) AS area_p FROM p_all GROUP BY ALL),
it AS (SELECT p.epoch, t.image_id, count(*) AS inter FROM t JOIN p_all p
       ON t.image_id = p.image_id AND t.x = p.x AND t.y = p.y GROUP BY ALL),
conf AS (SELECT ep.epoch, s.image_id, CAST(coalesce(inter, 0) AS DOUBLE) AS TP,
                CAST(coalesce(area_p, 0) - coalesce(inter, 0) AS DOUBLE) AS FP,
                CAST(area_t - coalesce(inter, 0) AS DOUBLE) AS FN,
                CAST(64 - area_t - coalesce(area_p, 0) + coalesce(inter, 0) AS DOUBLE) AS TN
         FROM sizes s JOIN a_t ON s.image_id = a_t.image_id CROSS JOIN ep
              LEFT JOIN a_p ON a_p.epoch = ep.epoch AND a_p.image_id = s.image_id
              LEFT JOIN it ON it.epoch = ep.epoch AND it.image_id = s.image_id)
SELECT epoch, avg((2 * TP + 1e-6) / (2 * TP + FP + FN + 1e-6)) AS val_dice,
       avg((TP + 1e-6) / (TP + FP + FN + 1e-6)) AS val_iou, avg((TP + 1e-6) / (TP + FP + 1e-6)) AS val_precision,
       avg((TP + 1e-6) / (TP + FN + 1e-6)) AS val_recall, avg((TN + 1e-6) / (TN + FP + 1e-6)) AS val_specificity,
       avg((TP + TN + 1e-6) / (TP + TN + FP + FN + 1e-6)) AS val_accuracy
FROM conf GROUP BY epoch""", VP)
def q_v7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation once per epoch → history rows (val_dice … val_accuracy per epoch)."""
    per_image = None
    for e in EPOCHS:
        m = evaluate.metrics(conf(spark, sf_dir, shift=e)).withColumn("epoch", F.lit(e))
        per_image = m if per_image is None else per_image.unionByName(m)
    return evaluate.per_epoch(per_image, "epoch")
