"""Sampling, splits, dense ids and best-per-group queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import match, sampling
from ..operators.sampling import MINSTD_A, MINSTD_P
from ..session import stored
from ..sources import standins
from .catalog import register
from .q_cohort import _BASE_SQL, cohort

SEED = 42


def draw_sql(key: str, seed: int = SEED) -> str:
    """The ``minstd`` draw of ``sampling.draw`` in SQL."""
    x = f"((CAST({key} AS BIGINT) + {seed}) % {MINSTD_P})"
    x = f"(({x} * {MINSTD_A}) % {MINSTD_P})"
    return f"(({x} * {MINSTD_A}) % {MINSTD_P})"


def _draw(spark_key: str = "isic_id"):
    return sampling.draw(F.col(spark_key).cast("bigint"), SEED, "minstd")


@register("W10", f"""WITH {_BASE_SQL}
SELECT isic_id, pixels_x, pixels_y, target FROM final WHERE pixels_x IS NOT NULL AND pixels_y IS NOT NULL
ORDER BY {draw_sql('isic_id')}, isic_id LIMIT 5000""", ("meta", "meta_t"))
def q_w10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded sample of min(5000, n) rows for the dimension scatter (exact size, reproducible)."""
    df = cohort(spark, sf_dir).na.drop(subset=["pixels_x", "pixels_y"]).select("isic_id", "pixels_x", "pixels_y", "target")
    return sampling.sample_n(df, 5000, _draw(), "isic_id")


@register("W11", f"""WITH {_BASE_SQL}
SELECT isic_id, target FROM (SELECT isic_id, target, row_number() OVER
  (PARTITION BY target ORDER BY {draw_sql('isic_id')}, isic_id) AS rn FROM final) WHERE rn <= 2""", ("meta", "meta_t"))
def q_w11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded two rows per class."""
    return sampling.sample_per_group(cohort(spark, sf_dir).select("isic_id", "target"), "target", 2, _draw(), "isic_id")


@register("W12", f"""WITH {_BASE_SQL},
r AS (SELECT isic_id, row_number() OVER (ORDER BY {draw_sql('isic_id')}, isic_id) - 1 AS rk, count(*) OVER () AS n
      FROM final),
c AS (SELECT *, CAST(floor(0.7 * n) AS BIGINT) AS tr FROM r),
d AS (SELECT *, CAST(floor(0.3333 * (n - tr)) AS BIGINT) AS va FROM c)
SELECT isic_id, CASE WHEN rk < tr THEN 'train' WHEN rk < tr + va THEN 'val' ELSE 'test' END AS split FROM d""",
          ("meta", "meta_t"))
def q_w12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact-size 70 / ≈10 / ≈20 split of the cohort by a seeded draw."""
    return sampling.exact_split(cohort(spark, sf_dir).select("isic_id"), _draw(), "isic_id")


@register("W6", """
WITH f AS (SELECT 'file:/data/masks/' || CAST(l_orderkey AS VARCHAR) || '_segmentation' ||
                  CASE WHEN l_orderkey % 9 = 4 THEN '.PNG' ELSE '.png' END AS path FROM lineitem GROUP BY l_orderkey)
SELECT path, row_number() OVER (ORDER BY path) - 1 AS id FROM f""")
def q_w6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense surrogate ids from 0 in file-name order (range partitions + offsets)."""
    return match.dense_index(standins.mask_listing(spark, sf_dir).select("path"), ["path"], "id", 0)


@register("W9", """
SELECT image_id, det_id, score FROM (SELECT image_id, det_id, score,
  row_number() OVER (PARTITION BY image_id ORDER BY score DESC, det_id) AS rn FROM detections) WHERE rn = 1""",
          ("detections",))
def q_w9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best prediction per image: highest score, first index among ties."""
    from ..operators.evaluate import best_per_image
    return best_per_image(standins.detections(spark, sf_dir), "image_id", "det_id", "score")


_SPLIT_SQL = f"""
r AS (SELECT isic_id, lesion_id, patient_id, row_number() OVER (ORDER BY {draw_sql('isic_id')}, isic_id) - 1 AS rk,
             count(*) OVER () AS n FROM final),
c AS (SELECT *, CAST(floor(0.7 * n) AS BIGINT) AS tr FROM r),
d AS (SELECT *, CASE WHEN rk < tr THEN 'train' WHEN rk < tr + CAST(floor(0.3333 * (n - tr)) AS BIGINT) THEN 'val' ELSE 'test' END AS split
      FROM c)"""


@register("W13_leak", f"WITH {_BASE_SQL}, {_SPLIT_SQL}" + " UNION ALL ".join(
    f"SELECT '{c}' AS key, {c} AS id, CAST(count(DISTINCT split) AS BIGINT) AS n_splits, count(*) AS n_images FROM d WHERE {c} IS NOT NULL "
    f"GROUP BY {c} HAVING count(DISTINCT split) > 1" for c in ("lesion_id", "patient_id")), ("meta", "meta_t"))
def q_w13_leak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lesion and patient ids that the split by rows shares between train, val and test."""
    df = cohort(spark, sf_dir).select("isic_id", "lesion_id", "patient_id")
    split = sampling.exact_split(df, _draw(), "isic_id")
    return sampling.shared_ids(split, ["lesion_id", "patient_id"])


@register("W13_groups", f"""WITH {_BASE_SQL}
SELECT count(*) AS n_images, CAST(0 AS BIGINT) AS shared_ids, true AS train_holds_most FROM final""", ("meta", "meta_t"))
def q_w13_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split by connected groups of lesions and patients: no id is shared, train is the largest part."""
    df = stored(cohort(spark, sf_dir).select("isic_id", "lesion_id", "patient_id"), "cohort")
    split = stored(sampling.leak_free_split(df, "isic_id", ["lesion_id", "patient_id"]), "split")
    shared = sampling.shared_ids(split, ["lesion_id", "patient_id"]).agg(F.count(F.lit(1))).scalar()
    most = split.groupBy("split").count().orderBy(F.desc("count"), F.desc("split")).limit(1).select("split").scalar()
    return split.agg(F.count(F.lit(1)).alias("n_images")).select("n_images", shared.alias("shared_ids"), (most == "train").alias("train_holds_most"))
