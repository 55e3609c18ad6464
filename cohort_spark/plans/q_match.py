"""Reconciliation, pairing and lookup queries (J rows, A12, X5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clean import file_stem, has_suffix
from ..operators import match, profile
from ..sources import standins
from .catalog import register
from .jobs import cohort_before_encoding

IMAGE_EXTS = (".jpg", ".jpeg", ".png")
MASK_SUFFIX = "_segmentation"

# ------------------------------------------------------------ oracle SQL ----

_IMAGES_SQL = """
images AS (
  SELECT 'file:/data/images/' || CAST(o_orderkey AS VARCHAR) ||
         CASE WHEN o_orderkey % 50 = 3 THEN '.txt' WHEN o_orderkey % 10 = 1 THEN '.JPG'
              WHEN o_orderkey % 10 = 2 THEN '.png' ELSE '.jpg' END AS path,
         CAST(floor(o_totalprice) AS BIGINT) AS length
  FROM orders WHERE o_orderkey % 10 <> 7),
img AS (SELECT regexp_extract(path, '([^/]+?)(\\.[^./]*)?$', 1) AS id, path, length FROM images
        WHERE regexp_matches(lower(path), '\\.(jpg|jpeg|png)$')),
masks AS (
  SELECT 'file:/data/masks/' || CAST(l_orderkey AS VARCHAR) || '_segmentation' ||
         CASE WHEN l_orderkey % 9 = 4 THEN '.PNG' ELSE '.png' END AS path,
         CAST(count(*) * 1000 AS BIGINT) AS length, CAST(600 + max(l_linenumber) * 10 AS INTEGER) AS width,
         450 AS height
  FROM lineitem GROUP BY l_orderkey),
msk AS (SELECT replace(regexp_extract(path, '([^/]+?)(\\.[^./]*)?$', 1), '_segmentation', '') AS id, path, length,
               width, height FROM masks
        WHERE regexp_matches(lower(path), '\\.(jpg|jpeg|png)$'))"""


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image listing filtered by extension (case-insensitive)."""
    lst = standins.image_listing(spark, sf_dir)
    return lst.where(has_suffix("path", IMAGE_EXTS))


def _masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lst = standins.mask_listing(spark, sf_dir)
    return lst.where(has_suffix("path", IMAGE_EXTS))


@register("A12", f"WITH {_IMAGES_SQL} SELECT id, path, length FROM img")
def q_a12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directory listing as a table: image extensions only, stem as id."""
    return match.listing_ids(_images(spark, sf_dir))


@register("S6", f"WITH {_IMAGES_SQL} SELECT path, regexp_extract(path, '([^/]+?)(\\.[^./]*)?$', 1) AS stem, "
          "lower(regexp_extract(path, '(\\.[^./]*)$', 1)) AS ext FROM images")
def q_s6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File stem and (lower-case) extension of every listed file."""
    from ..functions.clean import file_ext
    return standins.image_listing(spark, sf_dir).select("path", file_stem("path").alias("stem"),
                                                        file_ext("path").alias("ext"))


# ------------------------------------------------------------ reconcile ----

_SELECTED_SQL = """
sel AS (SELECT DISTINCT isic_id AS id FROM meta_t
        WHERE target IN ('Malignant-melanocytic', 'Benign-melanocytic', 'Benign-non-melanocytic',
                         'Malignant-non-melanocytic') AND melanocytic IS NOT NULL),
rec AS (SELECT coalesce(sel.id, img.id) AS id,
               CASE WHEN sel.id IS NOT NULL AND img.id IS NOT NULL THEN 'kept'
                    WHEN sel.id IS NOT NULL THEN 'missing' ELSE 'unused' END AS status,
               img.length, img.path
        FROM sel FULL OUTER JOIN img ON sel.id = img.id)"""


def _reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    selected = cohort_before_encoding(standins.meta(spark, sf_dir)).select(F.col("isic_id").alias("id"))
    return match.reconcile(selected, match.listing_ids(_images(spark, sf_dir)))


@register("J1", f"""WITH {_IMAGES_SQL}, {_SELECTED_SQL}
SELECT status, count(*) AS n_files, CAST(coalesce(sum(length), 0) AS BIGINT) AS bytes,
       CAST(coalesce(sum(length), 0) AS BIGINT) / 1073741824 AS gib FROM rec GROUP BY status""", ("meta", "meta_t"))
def q_j1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventory reconciliation: kept / missing / unused counts and bytes (GiB)."""
    return match.reconcile_summary(_reconcile(spark, sf_dir))


@register("X5", f"""WITH {_IMAGES_SQL}, {_SELECTED_SQL}
SELECT id, path, length FROM rec WHERE status = 'unused'""", ("meta", "meta_t"))
def q_x5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prune plan: the delete manifest of unused files (dry run: nothing is deleted)."""
    lst = match.listing_ids(_images(spark, sf_dir))
    rec = _reconcile(spark, sf_dir).where(F.col("status") == match.UNUSED).select("id")
    return lst.join(rec, "id", "left_semi").select("id", "path", "length")


# -------------------------------------------------------------- pairing ----

_PAIR_SQL = """
pairs AS (SELECT coalesce(img.id, msk.id) AS id, img.path AS image_path, msk.path AS mask_path,
                 CASE WHEN img.id IS NOT NULL AND msk.id IS NOT NULL THEN 'matched'
                      WHEN img.id IS NOT NULL THEN 'image_only' ELSE 'mask_only' END AS status
          FROM img FULL OUTER JOIN msk ON img.id = msk.id)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.pair_by_stem(_images(spark, sf_dir), _masks(spark, sf_dir), f"{MASK_SUFFIX}$")


@register("J2", f"WITH {_IMAGES_SQL}, {_PAIR_SQL} SELECT status, count(*) AS n FROM pairs GROUP BY status")
def q_j2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image/mask pairing by stem: matched, image-only, mask-only counts."""
    return profile.group_sizes(_pairs(spark, sf_dir), ["status"], "n")


@register("J5", f"WITH {_IMAGES_SQL} SELECT img.id, img.path AS image_path, msk.path AS mask_path "
          "FROM img LEFT JOIN msk ON img.id = msk.id")
def q_j5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mask lookup by naming convention ``<id>_segmentation.png`` (left join, NULL when absent)."""
    i = match.listing_ids(_images(spark, sf_dir)).select("id", F.col("path").alias("image_path"))
    m = match.listing_ids(_masks(spark, sf_dir), f"{MASK_SUFFIX}$").select("id", F.col("path").alias("mask_path"))
    return i.join(m, "id", "left")


_PROCESSED_SQL = "done AS (SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_orderstatus = 'F')"


@register("J3", f"""WITH {_IMAGES_SQL}, {_PAIR_SQL}, {_PROCESSED_SQL}
SELECT id, image_path, mask_path FROM pairs WHERE status = 'matched' AND id NOT IN (SELECT id FROM done)""")
def q_j3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resume: matched pairs whose id is not yet in the output table (anti join)."""
    from ..sources.tables import table
    done = table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == "F") \
        .select(F.col("o_orderkey").cast("string").alias("id"))
    todo = _pairs(spark, sf_dir).where(F.col("status") == "matched").drop("status")
    return match.pending(todo, done, "id")


@register("J6", f"""WITH {_IMAGES_SQL},
dims AS (SELECT isic_id AS id, pixels_x AS width, pixels_y AS height FROM meta WHERE isic_id IN (SELECT id FROM img))
SELECT msk.id, coalesce(dims.width, msk.width) AS width, coalesce(dims.height, msk.height) AS height
FROM msk LEFT JOIN dims ON msk.id = dims.id""", ("meta",))
def q_j6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mask dimensions taken from the image when it exists, else from the mask itself."""
    masks = _masks(spark, sf_dir).select(
        F.regexp_replace(file_stem("path"), f"{MASK_SUFFIX}$", "").alias("id"), "width", "height")
    meta = standins.meta(spark, sf_dir).select(F.col("isic_id").alias("id"), F.col("pixels_x").alias("width"),
                                               F.col("pixels_y").alias("height"))
    dims = match.keep_existing(meta, match.listing_ids(_images(spark, sf_dir)), "id")
    return match.with_fallback_dims(masks, dims, "id")


@register("J9", """
WITH s AS (SELECT l_orderkey AS image_id, l_extendedprice AS value, CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS shard,
                  l_linenumber, l_partkey, l_suppkey FROM lineitem)
SELECT image_id, value FROM (SELECT *, row_number() OVER (PARTITION BY image_id
  ORDER BY shard, l_linenumber, l_partkey, l_suppkey, value) AS rn FROM s)
WHERE rn = 1""")
def q_j9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merge result shards and keep the first occurrence of each image id."""
    from ..sources.tables import table
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image_id"),
                                                 F.col("l_extendedprice").alias("value"), "l_linenumber",
                                                 "l_partkey", "l_suppkey", "l_returnflag")
    s0 = li.where(F.col("l_returnflag") == "R").drop("l_returnflag")
    s1 = li.where(F.col("l_returnflag") != "R").drop("l_returnflag")
    tagged = s0.withColumn("__shard", F.lit(0)).unionByName(s1.withColumn("__shard", F.lit(1)))
    # shard order, then position inside the shard
    order = F.struct("__shard", "l_linenumber", "l_partkey", "l_suppkey", "value")
    first = match.first_by_order(tagged, ["image_id"], order)
    return first.select("image_id", "value")


@register("J10", """
SELECT o_orderkey AS image_id, CAST(count(l_orderkey) AS BIGINT) AS n_objects
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""")
def q_j10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images with their number of objects (0 for images without annotations)."""
    from ..sources.tables import table
    images = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image_id"))
    objects = standins.gt_boxes(spark, sf_dir)
    return match.with_object_counts(images, objects, "image_id")


@register("J10_lists", """
WITH o AS (SELECT image_id, string_agg(obj_id || ':' || category_id || ':' || CAST(x AS INTEGER), ' ' ORDER BY obj_id, category_id, x) AS objects
           FROM gt_boxes GROUP BY image_id)
SELECT o_orderkey AS image_id, coalesce(objects, '') AS objects FROM orders LEFT JOIN o ON o_orderkey = image_id""", ("gt_boxes",))
def q_j10_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images with the list of their objects (as text: id, category and left edge of each)."""
    from ..sources.tables import table
    images = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image_id"))
    lists = match.with_objects(images, standins.gt_boxes(spark, sf_dir), ["category_id", "x"])
    return lists.select("image_id", F.array_join(F.transform("objects", lambda o: F.concat_ws(
        ":", o["obj_id"], o["category_id"], o["x"].cast("int"))), " ").alias("objects"))


@register("S10", "SELECT p_partkey, p_name FROM part WHERE p_name NOT LIKE '%ring%'")
def q_s10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that do not contain a given part."""
    from ..functions.clean import without_part
    from ..sources.tables import table
    return table(spark, sf_dir, "part").where(without_part("p_name", "ring")).select("p_partkey", "p_name")


@register("P7", """SELECT isic_id, target FROM meta_t WHERE target IS NOT NULL AND target NOT IN
('Malignant-melanocytic', 'Benign-melanocytic', 'Benign-non-melanocytic', 'Malignant-non-melanocytic')""",
          ("meta", "meta_t"))
def q_p7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negated membership: rows whose class is outside the accepted list (NULL dropped)."""
    from ..operators.curate import TARGET_CLASSES, derive_target, drop_classes
    return drop_classes(derive_target(standins.meta(spark, sf_dir)), "target", TARGET_CLASSES).select("isic_id", "target")


@register("J4", f"""WITH {_IMAGES_SQL}, {_SELECTED_SQL}
SELECT id AS isic_id FROM sel WHERE id IN (SELECT id FROM img)""", ("meta", "meta_t"))
def q_j4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keep only selected rows whose image file exists (semi join)."""
    selected = cohort_before_encoding(standins.meta(spark, sf_dir)).select("isic_id")
    return match.keep_existing(selected, match.listing_ids(_images(spark, sf_dir)), "isic_id")
