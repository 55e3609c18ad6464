"""Mask and run-table queries (I rows, A18) on the 8×8 stand-in masks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import masks
from ..sources import standins
from .catalog import register

VM = ("levels", "mask_gt", "mask_pred", "sizes")
THRESHOLD = 0  # annotation / area rule: value > 0 is foreground

_RUNS_SQL = """
fg AS (SELECT image_id, x, y, x * 8 + y AS p FROM mask_gt WHERE value > 0),
runs AS (SELECT image_id, 1 AS obj_id, CAST(min(p) AS BIGINT) AS start, count(*) AS len
         FROM (SELECT *, p - row_number() OVER (PARTITION BY image_id ORDER BY p) AS isl FROM fg)
         GROUP BY image_id, isl)"""


def gt_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    fg = masks.foreground(standins.mask_pixels(spark, sf_dir, "gt"), THRESHOLD)
    return masks.encode_runs(fg, standins.image_sizes(spark, sf_dir))


def pred_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    fg = masks.foreground(standins.mask_pixels(spark, sf_dir, "pred"), THRESHOLD)
    return masks.encode_runs(fg, standins.image_sizes(spark, sf_dir))


@register("I11", f"WITH {_RUNS_SQL} SELECT image_id, obj_id, start, len FROM runs", VM)
def q_i11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column-major run-length encoding of the masks (one row per run)."""
    return gt_runs(spark, sf_dir).select("image_id", "obj_id", "start", "len")


@register("I12", "SELECT image_id, 1 AS obj_id, x, y FROM mask_gt WHERE value > 0", VM)
def q_i12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs decoded back to pixels (round trip of I11)."""
    return masks.decode_runs(gt_runs(spark, sf_dir))


@register("I4", "SELECT image_id, x, y FROM mask_gt WHERE value > 127", VM)
def q_i4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binarisation with the feature-extraction threshold (> 127)."""
    return masks.foreground(standins.mask_pixels(spark, sf_dir, "gt"), 127).select("image_id", "x", "y")


@register("I6", "SELECT image_id, count(*) AS area, count(*) / 64 * 100 AS area_pct FROM mask_gt "
          "WHERE value > 0 GROUP BY image_id", VM)
def q_i6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lesion area in pixels and as % of the image, from runs."""
    return masks.areas(gt_runs(spark, sf_dir), per_object=False)


@register("I9", """SELECT image_id, 1 AS obj_id, min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax,
  CAST(max(x) - min(x) + 1 AS DOUBLE) AS bbox_w, CAST(max(y) - min(y) + 1 AS DOUBLE) AS bbox_h
FROM mask_gt WHERE value > 0 GROUP BY image_id""", VM)
def q_i9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Object boxes from runs: inclusive corners (I8) and COCO width/height."""
    b = masks.boxes(gt_runs(spark, sf_dir))
    return b.select("image_id", "obj_id", "xmin", "ymin", "xmax", "ymax",
                    F.col("bbox")[2].alias("bbox_w"), F.col("bbox")[3].alias("bbox_h"))


@register("I13", """SELECT g.image_id, count(*) AS intersection FROM mask_gt g JOIN mask_pred p
  ON g.image_id = p.image_id AND g.x = p.x AND g.y = p.y WHERE g.value > 0 AND p.value > 0 GROUP BY g.image_id""", VM)
def q_i13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mask overlap (intersection pixels) of two run tables, no pixels exploded."""
    return masks.overlap(gt_runs(spark, sf_dir), pred_runs(spark, sf_dir))


@register("I14", """
WITH u AS (SELECT image_id, x * 8 + y AS p FROM mask_gt WHERE value > 0
           UNION SELECT image_id, x * 8 + y AS p FROM mask_pred WHERE value > 0
             AND image_id IN (SELECT image_id FROM sizes))
SELECT image_id, 1 AS obj_id, CAST(min(p) AS BIGINT) AS start, count(*) AS len
FROM (SELECT *, p - row_number() OVER (PARTITION BY image_id ORDER BY p) AS isl FROM u) GROUP BY image_id, isl""", VM)
def q_i14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union of two masks into one (merge of overlapping/touching runs)."""
    both = gt_runs(spark, sf_dir).unionByName(pred_runs(spark, sf_dir).withColumn("obj_id", F.lit(2)))
    return masks.union_runs(both).select("image_id", "obj_id", "start", "len")


@register("I7", """SELECT image_id, CAST(v // 64 AS INTEGER) AS obj_id, count(*) AS area
FROM (SELECT CAST(vec_id AS VARCHAR) AS image_id, v FROM levels) WHERE v // 64 <> 0 GROUP BY ALL""", VM)
def q_i7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multi-object masks: each distinct non-zero value is one object; area per object."""
    px = standins.images(spark, sf_dir).select("image_id", "x", "y", (F.col("blue") / 64).cast("int").alias("value"))
    runs = masks.encode_runs(masks.foreground(px, 0, object_ids=True), standins.image_sizes(spark, sf_dir))
    return masks.areas(runs).select("image_id", "obj_id", "area")


_I5_LEVEL = 165  # some images have no brighter pixel


@register("I5", f"SELECT image_id FROM sizes WHERE image_id NOT IN (SELECT CAST(vec_id AS VARCHAR) FROM levels WHERE v > {_I5_LEVEL})", VM)
def q_i5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images whose mask is empty after thresholding (soft masks of the levels, cut high)."""
    soft = standins.images(spark, sf_dir).select("image_id", "x", "y", F.col("blue").alias("value"))
    runs = masks.encode_runs(masks.foreground(soft, _I5_LEVEL), standins.image_sizes(spark, sf_dir))
    return masks.empty_masks(standins.image_sizes(spark, sf_dir), runs).select("image_id")


@register("A18", """SELECT s.image_id, CAST(coalesce(a.area, 0) AS BIGINT) AS area FROM sizes s
LEFT JOIN (SELECT image_id, count(*) AS area FROM mask_pred WHERE value > 0 GROUP BY image_id) a
ON s.image_id = a.image_id""", VM)
def q_a18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mask output keyed by image: every image has a row, area 0 when nothing is predicted."""
    ar = masks.areas(pred_runs(spark, sf_dir), per_object=False).select("image_id", "area")
    return standins.image_sizes(spark, sf_dir).join(ar, "image_id", "left").select(
        "image_id", F.coalesce("area", F.lit(0)).cast("bigint").alias("area"))


@register("I16", """
WITH g AS (SELECT image_id, unnest(range(16)) AS i FROM sizes)
SELECT g.image_id, CAST(i % 4 AS INTEGER) AS x, CAST(i // 4 AS INTEGER) AS y, coalesce(m.value, 0) AS value
FROM g LEFT JOIN mask_gt m ON m.image_id = g.image_id AND m.x = (i % 4) * 2 AND m.y = (i // 4) * 2""", VM)
def q_i16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-neighbour resize of the masks to 4×4."""
    sizes = standins.image_sizes(spark, sf_dir).select("image_id", "height", "width",
                                                       F.lit(4).alias("out_height"), F.lit(4).alias("out_width"))
    return masks.resize_nearest(standins.mask_pixels(spark, sf_dir, "gt"), sizes)


@register("I16_bilinear", "SELECT image_id, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, value FROM pred_resized WHERE shift = 1",
          ("levels", "pred_resized"))
def q_i16_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bilinear resize of each image's best predicted soft mask (8×8 or 4×4) to 8×8."""
    from ..operators.evaluate import best_per_image
    objects = standins.predicted_objects(spark, sf_dir)
    best = best_per_image(objects, "image_id", "obj_id", "score").select("image_id", "obj_id")
    to = objects.join(best, ["image_id", "obj_id"], "left_semi").select(
        "image_id", "height", "width", F.lit(standins.PATCH).alias("out_height"), F.lit(standins.PATCH).alias("out_width"))
    px = standins.predicted_masks(spark, sf_dir).join(best, ["image_id", "obj_id"], "left_semi")
    return masks.resize_bilinear(px, to)


@register("I2", "SELECT p.image_id, p.x, p.y, blue, green, red, gray FROM pixels p SEMI JOIN "
          "(SELECT * FROM mask_gt WHERE value > 127) m ON p.image_id = m.image_id AND p.x = m.x AND p.y = m.y",
          VM + ("pixels",))
def q_i2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ROI pixels with the four channels (B, G, R and gray) after masking."""
    fg = masks.foreground(standins.mask_pixels(spark, sf_dir, "gt"), 127).drop("obj_id")
    return standins.images(spark, sf_dir).join(fg, ["image_id", "x", "y"], "left_semi")


# --------------------------------------------------------------- jobs ----

@register("X8", """
WITH files AS (SELECT CAST(vec_id AS VARCHAR) AS id, CAST(vec_id AS VARCHAR) || '_segmentation.png' AS name
               FROM embeddings),
num AS (SELECT id, name, row_number() OVER (ORDER BY name) - 1 AS image_id FROM files),
fgp AS (SELECT image_id AS id, x, y FROM mask_gt WHERE value > 0),
per AS (SELECT id, count(*) AS area, min(x) AS bx, min(y) AS by_, max(x) - min(x) + 1 AS bw,
               max(y) - min(y) + 1 AS bh FROM fgp GROUP BY id)
SELECT row_number() OVER (ORDER BY name) - 1 AS id, image_id, 1 AS category_id, CAST(area AS DOUBLE) AS area,
       CAST(bx AS DOUBLE) AS bbox_x, CAST(by_ AS DOUBLE) AS bbox_y, CAST(bw AS DOUBLE) AS bbox_w,
       CAST(bh AS DOUBLE) AS bbox_h, 0 AS iscrowd
FROM num JOIN per USING (id)""", VM)
def q_x8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotation export job: one COCO annotation per non-empty mask (ids in file-name order)."""
    from ..operators import annotations as A
    sizes = standins.image_sizes(spark, sf_dir)
    files = sizes.select(F.col("image_id").alias("id"), F.concat("image_id", F.lit("_segmentation.png")).alias("name"))
    _, anns, _ = A.annotations_from_masks(files, standins.mask_pixels(spark, sf_dir, "gt"), sizes)
    return anns.select("id", "image_id", "category_id", "area", *[F.col("bbox")[i].alias(n) for i, n in
                                                                   enumerate(["bbox_x", "bbox_y", "bbox_w", "bbox_h"])],
                       "iscrowd")


@register("X7", """
WITH s AS (SELECT image_id FROM sizes ORDER BY (((((CAST(image_id AS BIGINT) + 42) % 2147483647) * 48271)
             % 2147483647) * 48271) % 2147483647, image_id LIMIT 500),
a AS (SELECT image_id, count(*) AS area FROM mask_gt WHERE value > 0 GROUP BY image_id)
SELECT s.image_id, 8 AS width, 8 AS height, CAST(coalesce(a.area, 0) AS BIGINT) AS area_px,
       coalesce(a.area, 0) / 64 * 100 AS area_pct
FROM s LEFT JOIN a ON s.image_id = a.image_id""", VM)
def q_x7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mask-dataset profile job: seeded sample of 500 images, size and lesion area (px, %)."""
    from ..operators import sampling
    from .jobs import mask_dataset_profile
    sizes = standins.image_sizes(spark, sf_dir)
    sample = sampling.sample_n(sizes.select("image_id"), 500,
                               sampling.draw(F.col("image_id").cast("bigint"), 42, "minstd"), "image_id")
    return mask_dataset_profile(sample, sizes, standins.mask_pixels(spark, sf_dir, "gt"))


_AREAS_SQL = """
s AS (SELECT image_id FROM sizes ORDER BY (((((CAST(image_id AS BIGINT) + 42) % 2147483647) * 48271)
        % 2147483647) * 48271) % 2147483647, image_id LIMIT 500),
a AS (SELECT CAST(vec_id AS VARCHAR) AS image_id, count(*) AS area FROM levels WHERE v > 165 GROUP BY vec_id),
f AS (SELECT s.image_id, coalesce(a.area, 0) AS area FROM s LEFT JOIN a USING (image_id)),
l AS (SELECT 'width' AS measure, 8.0 AS value FROM f UNION ALL SELECT 'height', 8.0 FROM f
      UNION ALL SELECT 'area_px', area FROM f UNION ALL SELECT 'area_pct', area / 64 * 100 FROM f)"""


@register("X7_report", f"""WITH {_AREAS_SQL}
SELECT measure, count(*) AS count, avg(value) AS mean, stddev_samp(value) AS std, CAST(min(value) AS DOUBLE) AS min,
       quantile_cont(CAST(value AS DOUBLE), 0.25) AS p25, quantile_cont(CAST(value AS DOUBLE), 0.5) AS p50,
       quantile_cont(CAST(value AS DOUBLE), 0.75) AS p75, CAST(max(value) AS DOUBLE) AS max
FROM l GROUP BY measure
UNION ALL SELECT 'empty_masks', count(*) FILTER (WHERE area = 0), NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM f""", VM)
def q_x7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mask-dataset report: describe of dimensions and areas of a seeded sample, and its empty masks."""
    from ..operators import sampling
    from .jobs import mask_dataset_profile, mask_dataset_report
    sizes = standins.image_sizes(spark, sf_dir)
    sample = sampling.sample_n(sizes.select("image_id"), 500,
                               sampling.draw(F.col("image_id").cast("bigint"), 42, "minstd"), "image_id")
    soft = standins.images(spark, sf_dir).select("image_id", "x", "y", (F.col("blue") > _I5_LEVEL).cast("int").alias("value"))
    return mask_dataset_report(mask_dataset_profile(sample, sizes, soft))
