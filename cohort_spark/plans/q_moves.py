"""Moves of masks and COCO mask forms (I15, A16/A17, B12–B19 on masks) on the stand-ins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import annotations as A
from ..operators import coco_masks, masks
from ..operators import mask_geometry as G
from ..sources import standins
from .catalog import register
from .q_masks import VM, _RUNS_SQL, gt_runs, pred_runs

_OUT = ["image_id", "obj_id", "start", "len"]


def _islands(pixels: str, height: int) -> str:
    """SQL: runs of the pixels (image_id, x, y) of a mask of this height."""
    return f"""
SELECT image_id, 1 AS obj_id, CAST(min(p) AS BIGINT) AS start, count(*) AS len
FROM (SELECT image_id, p, p - row_number() OVER (PARTITION BY image_id ORDER BY p) AS isl
      FROM (SELECT image_id, x * {height} + y AS p FROM ({pixels}))) GROUP BY image_id, isl"""


@register("A17_counts", f"WITH {_RUNS_SQL} SELECT image_id, obj_id, start, len FROM runs", VM)
def q_a17_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks as COCO counts (every other one as a counts string) and back to runs from the annotations' JSON."""
    sizes = standins.image_sizes(spark, sf_dir)
    plain = masks.coco_counts(gt_runs(spark, sf_dir), sizes)
    even = F.col("image_id").cast("long") % 2 == 0
    json = F.to_json("segmentation").alias("segmentation")
    both = plain.where(even).select("image_id", "obj_id", json).unionByName(
        coco_masks.compressed(plain.where(~even)).select("image_id", "obj_id", json))
    return coco_masks.segmentation_runs(both, sizes).select(*_OUT)


_POLYGON_SQL = """
WITH e AS (SELECT image_id, obj_id, unnest([x, x + w, x, x + w / 2]) / 4 AS x1, unnest([y, y + h / 2, y + h, y + h / 2]) / 4 AS y1,
                  unnest([x + w, x, x + w / 2, x]) / 4 AS x2, unnest([y + h / 2, y + h, y + h / 2, y]) / 4 AS y2 FROM gt_named),
c AS (SELECT *, unnest(range(0, 64)) AS c FROM e),
hit AS (SELECT image_id, obj_id, c, y1 + (c + 0.5 - x1) * (y2 - y1) / (x2 - x1) AS y FROM c
        WHERE least(x1, x2) <= c + 0.5 AND c + 0.5 < greatest(x1, x2)),
p AS (SELECT *, lead(y) OVER o AS z, row_number() OVER o AS r FROM hit WINDOW o AS (PARTITION BY image_id, obj_id, c ORDER BY y))
SELECT image_id, obj_id, CAST(sum(least(ceil(z - 0.5), 32) - greatest(ceil(y - 0.5), 0)) AS BIGINT) AS area
FROM p WHERE r % 2 = 1 AND ceil(z - 0.5) > ceil(y - 0.5) GROUP BY ALL"""


@register("I15", _POLYGON_SQL, ("gt_named",))
def q_i15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concave polygons (arrow heads) to masks: area of each object's runs."""
    boxes = standins.named_by_box(standins.gt_boxes(spark, sf_dir), "obj_id")
    x, y, w, h = (F.col(c) / 4 for c in "xywh")
    ring = F.array(x, y, x + w, y + h / 2, x, y + h, x + w / 2, y + h / 2)
    objects = boxes.select("image_id", "obj_id", F.array(ring).alias("polygons"))
    sizes = boxes.select("image_id").distinct().withColumns({"height": F.lit(standins.MASK_HEIGHT), "width": F.lit(64)})
    return coco_masks.polygon_runs(objects, sizes).groupBy("image_id", "obj_id").agg(F.sum("len").alias("area"))


@register("B12_masks", _islands("SELECT image_id, 7 - x AS x, y FROM mask_gt WHERE value > 0", 8), VM)
def q_b12_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks mirrored on their runs."""
    return G.mirror(gt_runs(spark, sf_dir)).select(*_OUT)


@register("B15_masks", _islands(
    "SELECT image_id, x + CAST(image_id AS BIGINT) % 5 - 2 AS x, y + CAST(image_id AS BIGINT) % 3 - 1 AS y FROM mask_gt WHERE value > 0 "
    "AND x + CAST(image_id AS BIGINT) % 5 - 2 BETWEEN 0 AND 8 AND y + CAST(image_id AS BIGINT) % 3 - 1 BETWEEN 0 AND 6", 7), VM)
def q_b15_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks placed on a canvas of another size (7 x 9), shifted by image, cut at its edges."""
    n = F.col("image_id").cast("long")
    return G.place(gt_runs(spark, sf_dir), n % 5 - 2, n % 3 - 1, F.lit(7), F.lit(9)).select(*_OUT)


@register("B16_masks", _islands(
    "SELECT m.image_id, a AS x, b AS y FROM mask_gt m, range(11) q(a), range(5) r(b) WHERE value > 0 AND m.x = a * 8 // 11 AND m.y = b * 8 // 5",
    5), VM)
def q_b16_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks rescaled (nearest) on their runs from 8 x 8 to 5 x 11."""
    return G.stretch(gt_runs(spark, sf_dir), F.lit(5), F.lit(11)).select(*_OUT)


@register("B19_occlusion", _islands(
    "SELECT g.image_id, g.x, g.y FROM mask_gt g LEFT JOIN mask_pred p ON g.image_id = p.image_id AND g.x = p.x AND g.y = p.y "
    "WHERE g.value > 0 AND coalesce(p.value, 0) = 0", 8), VM)
def q_b19_occlusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks less what another mask of the image hides (set difference of runs)."""
    return G.subtract(gt_runs(spark, sf_dir), masks.union_runs(pred_runs(spark, sf_dir))).select(*_OUT)


def _image_objects(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Images, objects with boxes of their masks, and run tables of the stand-in boxes."""
    boxes = standins.named_by_box(standins.gt_boxes(spark, sf_dir), "obj_id")
    runs = standins.box_runs(boxes, "obj_id")
    corner = [F.col(a).cast("double").alias(b) for a, b in (("xmin", "x1"), ("ymin", "y1"), ("xmax", "x2"), ("ymax", "y2"))]
    objects = boxes.select("image_id", "obj_id", "category_id", "iscrowd").join(
        masks.boxes(runs).select("image_id", "obj_id", *corner), ["image_id", "obj_id"])
    images = runs.select("image_id", "height", "width").distinct()
    return images, objects, runs


@register("B19")
def q_b19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copy-paste between neighbours of seeded batches: objects with boxes and areas after it."""
    return A.copy_paste(*_image_objects(spark, sf_dir))[0]


@register("B14")
def q_b14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IoU crop of every image's boxes by seeded trials."""
    images, objects, _ = _image_objects(spark, sf_dir)
    return A.iou_crop(objects.join(images, "image_id"))
