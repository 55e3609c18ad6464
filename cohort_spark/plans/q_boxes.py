"""Box and annotation-table queries (B rows) on the lineitem box stand-ins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import annotations as A
from ..sources import standins
from ..sources.tables import table
from .catalog import register

W, H = 128.0, 96.0  # canvas of the stand-in box images
VB = ("gt_boxes", "detections")


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standins.gt_boxes(spark, sf_dir).withColumns({"width": F.lit(W), "height": F.lit(H)})


_XYXY_SQL = f"""
xyxy AS (SELECT image_id, obj_id, category_id, iscrowd,
           greatest(0.0, least({W}, x)) AS x1, greatest(0.0, least({H}, y)) AS y1,
           greatest(0.0, least({W}, x + w)) AS x2, greatest(0.0, least({H}, y + h)) AS y2 FROM gt_boxes)"""


@register("B2", f"WITH {_XYXY_SQL} SELECT image_id, obj_id, x1, y1, x2, y2 FROM xyxy", VB)
def q_b2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """xywh → xyxy with coordinates clamped to the image."""
    return A.xywh_to_xyxy(_boxes(spark, sf_dir), "width", "height").select("image_id", "obj_id", "x1", "y1", "x2", "y2")


@register("B3", f"WITH {_XYXY_SQL} SELECT image_id, obj_id, x1 AS x, y1 AS y, x2 - x1 AS w, y2 - y1 AS h FROM xyxy", VB)
def q_b3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """xyxy → xywh (after the clamp)."""
    b = A.xywh_to_xyxy(_boxes(spark, sf_dir), "width", "height")
    return A.xyxy_to_xywh(b).select("image_id", "obj_id", "x", "y", "w", "h")


@register("B4", "SELECT image_id, obj_id FROM gt_boxes WHERE iscrowd = 0", VB)
def q_b4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crowd objects removed."""
    return A.drop_crowd(_boxes(spark, sf_dir)).select("image_id", "obj_id")


@register("B5", f"WITH {_XYXY_SQL} SELECT image_id, obj_id FROM xyxy WHERE iscrowd = 0 AND y2 > y1 AND x2 > x1", VB)
def q_b5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training targets: non-crowd objects whose clamped box has positive width and height."""
    b = A.xywh_to_xyxy(A.drop_crowd(_boxes(spark, sf_dir)), "width", "height")
    return A.keep_positive(b).select("image_id", "obj_id")


@register("B6", """SELECT o_orderkey AS image_id FROM orders WHERE o_orderkey IN
  (SELECT image_id FROM gt_boxes GROUP BY image_id HAVING bool_or(w > 1 AND h > 1))""", VB)
def q_b6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images with valid annotations (not empty, not only boxes with a side ≤ 1)."""
    images = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image_id"))
    return A.images_with_valid_annotations(images, standins.gt_boxes(spark, sf_dir))


@register("B11", "SELECT o_orderkey AS image_id FROM orders WHERE o_orderkey IN (SELECT image_id FROM gt_boxes)", VB)
def q_b11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dataset filter: images that have at least one object."""
    images = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image_id"))
    return A.images_with_objects(images, standins.gt_boxes(spark, sf_dir))


@register("B12", f"WITH {_XYXY_SQL} SELECT image_id, obj_id, {W} - x2 AS x1, y1, {W} - x1 AS x2, y2 FROM xyxy", VB)
def q_b12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Horizontal flip of every box (x1' = W − x2, x2' = W − x1)."""
    b = A.xywh_to_xyxy(_boxes(spark, sf_dir), "width", "height")
    return A.hflip(b).select("image_id", "obj_id", "x1", "y1", "x2", "y2")


@register("B8", """
SELECT row_number() OVER (ORDER BY image_id, det_id, category_id, x, y, w, h) AS id, image_id, category_id,
       x, y, w, h, w * h AS area, 0 AS iscrowd FROM detections""", VB)
def q_b8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detection objects normalised into annotation rows (ids from 1, xywh boxes, area, crowd flag)."""
    d = standins.detections(spark, sf_dir)
    objs = d.select("image_id", F.col("det_id").alias("obj_id"), "category_id",
                    F.col("x").alias("x1"), F.col("y").alias("y1"),
                    (F.col("x") + F.col("w")).alias("x2"), (F.col("y") + F.col("h")).alias("y2"))
    anns, _ = A.to_annotation_model(objs, ["image_id", "obj_id", "category_id", "x", "y", "w", "h"])
    return anns.select("id", "image_id", "category_id", "x", "y", "w", "h", "area", F.lit(0).alias("iscrowd"))


@register("B9", """SELECT image_id, category_id, score, x, y, w, h FROM detections""", VB)
def q_b9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Box predictions → COCO result rows (xywh boxes with scores)."""
    d = standins.detections(spark, sf_dir)
    preds = d.select("image_id", "category_id", "score", F.col("x").alias("x1"), F.col("y").alias("y1"),
                     (F.col("x") + F.col("w")).alias("x2"), (F.col("y") + F.col("h")).alias("y2"))
    return A.predictions_to_results(preds, "bbox")


@register("B9_keypoints", """SELECT image_id, category_id, score, list(kx ORDER BY i)[17] AS last_x, list(ky ORDER BY i)[2] AS second_y,
  count(*) * 3 AS n FROM det_points JOIN det_named USING (image_id, det_id, category_id) GROUP BY image_id, det_id, category_id, score""",
          ("det_points",))
def q_b9_keypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keypoint predictions → COCO result rows (flat x, y, v lists): length and two of the values."""
    d = standins.box_keypoints(standins.named_by_box(standins.detections(spark, sf_dir), "det_id"), "det_id", False)
    rows = A.predictions_to_results(d.withColumn("keypoints", A.keypoints_to_flat("keypoints")), "keypoints")
    k = F.col("keypoints")
    return rows.select("image_id", "category_id", "score", F.element_at(k, 49).alias("last_x"), F.element_at(k, 5).alias("second_y"),
                       F.size(k).cast("long").alias("n"))


@register("B9_segm", """
WITH fg AS (SELECT image_id, obj_id, x * (8 // step) + y AS p, step FROM
              (SELECT o.image_id, obj_id, step, x // step AS x, y // step AS y, v FROM pred_objects o JOIN levels USING (vec_id)
               WHERE shift = 1 AND x % step = 0 AND y % step = 0) WHERE v > 128),
runs AS (SELECT image_id, obj_id, min(p) AS s, count(*) AS n FROM
           (SELECT *, p - row_number() OVER (PARTITION BY image_id, obj_id ORDER BY p) AS isl FROM fg) GROUP BY image_id, obj_id, isl)
SELECT image_id, obj_id, 1 AS category_id, score, any_value(8 // step) AS height, sum(n) AS area, count(*) AS n_runs, min(s) AS first_zeros
FROM runs JOIN pred_objects USING (image_id, obj_id) WHERE shift = 1 GROUP BY image_id, obj_id, score""", ("levels", "pred_objects"))
def q_b9_segm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mask predictions → COCO result rows (thresholded, counts of runs): size, area and runs of each."""
    objects = standins.predicted_objects(spark, sf_dir).withColumn("category_id", F.lit(1))
    soft = standins.predicted_masks(spark, sf_dir).withColumnRenamed("value", "prob")
    rows = A.segm_results(objects, soft, objects.select("image_id", "obj_id", "height", "width"))
    counts = F.col("segmentation.counts")
    inside = F.filter(counts, lambda c, i: i % 2 == 1)
    return rows.select("image_id", "obj_id", "category_id", "score", F.col("segmentation.size")[0].alias("height"),
                       F.aggregate(inside, F.lit(0).cast("long"), lambda a, x: a + x).alias("area"),
                       F.size(inside).cast("long").alias("n_runs"), counts[0].alias("first_zeros"))
