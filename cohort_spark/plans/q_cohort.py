"""Queries over the image-metadata stand-in (notebook 00: curation and profiling)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import curate, match, profile
from ..operators.curate import TARGET_CLASSES
from ..sources import standins
from .catalog import register
from .jobs import cohort_before_encoding, curate_cohort
from .oracle_views import mode_sql, sround

SITES = sorted(list(standins.SITE_BY_PRIORITY.values()) + ["unknown"])
CLASSES_SQL = ", ".join(f"'{c}'" for c in TARGET_CLASSES)


def _disk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.listing_ids(standins.disk_listing(spark, sf_dir))


def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate_cohort(standins.meta(spark, sf_dir), _disk_ids(spark, sf_dir))


def _cohort_plot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``df_final`` with the site name rebuilt from the one-hot columns."""
    return curate.from_one_hot(cohort(spark, sf_dir), "anatom_site_", "anatom_site")


# ------------------------------------------------------------ oracle SQL ----

_BASE_SQL = f"""
base AS (
  SELECT isic_id, lesion_id, patient_id, age_approx, anatom_site_general, pixels_x, pixels_y, sex, target
  FROM meta_t WHERE target IN ({CLASSES_SQL}) AND melanocytic IS NOT NULL),
am AS ({mode_sql('base', 'target', 'age_approx')}),
sm AS ({mode_sql('base', 'target', 'sex')}),
imp AS (
  SELECT b.isic_id, b.lesion_id, b.patient_id, coalesce(b.age_approx, am.m) AS age_approx,
         b.anatom_site_general, b.pixels_x, b.pixels_y, coalesce(b.sex, sm.m) AS sex, b.target
  FROM base b LEFT JOIN am ON b.target = am.target LEFT JOIN sm ON b.target = sm.target),
final AS (
  SELECT isic_id, lesion_id, patient_id, age_approx,
    {", ".join(f"CAST(coalesce(anatom_site_general, 'unknown') = '{s}' AS INTEGER) AS anatom_site_{s}" for s in SITES)},
    pixels_x, pixels_y, sex, target, coalesce(anatom_site_general, 'unknown') AS anatom_site
  FROM imp WHERE isic_id IN (SELECT CAST(l_orderkey AS VARCHAR) FROM lineitem))
"""
_FINAL_COLS = ("isic_id, lesion_id, patient_id, age_approx, "
               + ", ".join(f"anatom_site_{s}" for s in SITES) + ", pixels_x, pixels_y, sex, target")


# ---------------------------------------------------------------- X1 ----

@register("X1", f"WITH {_BASE_SQL} SELECT {_FINAL_COLS} FROM final", ("meta", "meta_t"))
def q_x1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cohort curation job → ``isic_selected``."""
    return cohort(spark, sf_dir)


@register("N5", f"WITH {_BASE_SQL} SELECT isic_id, target, age_approx, sex FROM imp", ("meta", "meta_t"))
def q_n5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group-mode imputation of age and sex per class."""
    return cohort_before_encoding(standins.meta(spark, sf_dir)).select("isic_id", "target", "age_approx", "sex")


@register("M7", f"WITH {_BASE_SQL} SELECT isic_id, "
          + ", ".join(f"anatom_site_{s}" for s in SITES) + " FROM final", ("meta", "meta_t"))
def q_m7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-hot encoding of the anatomical site (distinct values found by the job)."""
    return cohort(spark, sf_dir).select("isic_id", *[f"anatom_site_{s}" for s in SITES])


@register("G20", f"WITH {_BASE_SQL} SELECT isic_id, anatom_site FROM final", ("meta", "meta_t"))
def q_g20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row-wise argmax over the one-hot columns with the prefix removed."""
    return _cohort_plot(spark, sf_dir).select("isic_id", "anatom_site")


# ----------------------------------------------------------- null reports ----

_N1_COLS = ["isic_id", "lesion_id", "patient_id", "age_approx", "anatom_site_general", "anatom_site_special",
            "clin_size_long_diam_mm", "fitzpatrick_skin_type", "image_type", "personal_hx_mm", "pixels_x",
            "pixels_y", "sex", "melanocytic", "diagnosis_1", "melanocytic_str", "target"]


@register("N1", "SELECT " + ", ".join(f"CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS {c}" for c in _N1_COLS)
          + f" FROM meta_t WHERE target IN ({CLASSES_SQL})", ("meta", "meta_t"))
def q_n1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null count of every column after the class filter (one row)."""
    df = curate.keep_classes(curate.derive_target(standins.meta(spark, sf_dir)))
    return profile.null_counts(df, _N1_COLS)


@register("N7", "SELECT CAST((" + " + ".join(
    f"max(CAST({c} IS NULL OR isnan({c}) AS INTEGER))" if c in ("age_approx", "clin_size_long_diam_mm")
    else f"max(CAST({c} IS NULL AS INTEGER))" for c in _N1_COLS[:15]) + ") AS BIGINT) AS columns_with_missing, "
    "CAST(count(*) FILTER (WHERE " + " OR ".join(
        f"({c} IS NULL OR isnan({c}))" if c in ("age_approx", "clin_size_long_diam_mm") else f"{c} IS NULL"
        for c in _N1_COLS[:15]) + ") AS BIGINT) AS rows_with_missing FROM meta", ("meta",))
def q_n7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns with any missing value and rows with any missing value (NULL or NaN)."""
    return profile.missing_overview(standins.meta(spark, sf_dir), _N1_COLS[:15])


# ---------------------------------------------------------- value counts ----

@register("G1", "SELECT target, count(*) AS count FROM meta_t GROUP BY target", ("meta", "meta_t"))
def q_g1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value counts of the derived target; polars keeps NULL as a value."""
    return profile.value_counts(curate.derive_target(standins.meta(spark, sf_dir)), "target", dropna=False)


@register("G5", f"WITH {_BASE_SQL} SELECT target, sex, count(*) AS count, "
          "count(*) / sum(count(*)) OVER (PARTITION BY target) * 100 AS pct FROM final GROUP BY target, sex",
          ("meta", "meta_t"))
def q_g5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group size on two keys plus the share within the first key (G5 + W1)."""
    sizes = profile.group_sizes(cohort(spark, sf_dir), ["target", "sex"])
    return profile.share_within_group(sizes, "target", "count", "pct")


@register("G6", f"""
WITH {_BASE_SQL}
SELECT target, count(isic_id) AS n,
       {sround('avg(pixels_x)', 0)} AS mean_w, quantile_cont(pixels_x, 0.5) AS median_w,
       {sround('avg(pixels_y)', 0)} AS mean_h, quantile_cont(pixels_y, 0.5) AS median_h
FROM final WHERE pixels_x IS NOT NULL AND pixels_y IS NOT NULL GROUP BY target""", ("meta", "meta_t"))
def q_g6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image dimensions per class: count, rounded mean and median of width and height."""
    df = cohort(spark, sf_dir).na.drop(subset=["pixels_x", "pixels_y"])
    agg = df.groupBy("target").agg(
        F.count("isic_id").alias("n"),
        F.bround(F.avg("pixels_x"), 0).alias("mean_w"),
        F.bround(F.avg("pixels_y"), 0).alias("mean_h"),
    )
    med = profile.quantiles(df, ["target"], "pixels_x", [0.5], names=["median_w"]).join(
        profile.quantiles(df, ["target"], "pixels_y", [0.5], names=["median_h"]), "target")
    return agg.join(med, "target").select("target", "n", "mean_w", "median_w", "mean_h", "median_h").orderBy("target")


@register("G21", f"""
WITH {_BASE_SQL},
c AS (SELECT target, anatom_site, count(*) AS n FROM final WHERE target IN ({CLASSES_SQL}) GROUP BY ALL)
SELECT target, {", ".join(f"coalesce(sum(n) FILTER (WHERE anatom_site = '{s}'), 0) / sum(n) * 100 AS {s}" for s in SITES)}
FROM c GROUP BY target""", ("meta", "meta_t"))
def q_g21(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class × site percentage matrix, rows sum to 100, zero filled, class order."""
    hot = cohort(spark, sf_dir)
    # The sites are the names of the one-hot columns.
    sites = [c.removeprefix("anatom_site_") for c in hot.columns if c.startswith("anatom_site_")]
    df = curate.keep_classes(curate.from_one_hot(hot, "anatom_site_", "anatom_site"))
    m = profile.percent_matrix(df, "target", "anatom_site", sites)
    return profile.order_by_list(m, "target", TARGET_CLASSES)


_STATS = ["mean", "std", "min", "p25", "p50", "p75", "max"]


@register("G11", f"""
WITH {_BASE_SQL}
SELECT target, count(age_approx) AS count,
  {sround('avg(age_approx)', 1)} AS mean, {sround('stddev_samp(age_approx)', 1)} AS std,
  {sround('min(age_approx)', 1)} AS min, {sround('quantile_cont(age_approx, 0.25)', 1)} AS p25,
  {sround('quantile_cont(age_approx, 0.5)', 1)} AS p50, {sround('quantile_cont(age_approx, 0.75)', 1)} AS p75,
  {sround('max(age_approx)', 1)} AS max
FROM final WHERE target IN ({CLASSES_SQL}) GROUP BY target""", ("meta", "meta_t"))
def q_g11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Age describe per class (pandas flavour), rounded to 1, in class order."""
    d = profile.describe(cohort(spark, sf_dir), "age_approx", ["target"], "pandas", digits=1)
    return profile.order_by_list(d, "target", TARGET_CLASSES)


# ------------------------------------------------------------ leak report ----

@register("W13", f"""
WITH {_BASE_SQL}
SELECT count(*) AS n_total,
  count(DISTINCT lesion_id) AS n_lesions, count(DISTINCT patient_id) AS n_patients,
  count(*) / greatest(count(DISTINCT lesion_id), 1) AS imgs_per_lesion,
  count(*) / greatest(count(DISTINCT patient_id), 1) AS imgs_per_patient,
  count(*) FILTER (WHERE lesion_id IS NULL) AS null_lesion_id,
  count(*) FILTER (WHERE patient_id IS NULL) AS null_patient_id,
  (SELECT count(*) FROM (SELECT lesion_id FROM final WHERE lesion_id IS NOT NULL GROUP BY lesion_id HAVING count(*) > 1))
    AS lesions_multi_image
FROM final""", ("meta", "meta_t"))
def q_w13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicate-image (leak) report on the curated cohort: one row."""
    df = cohort(spark, sf_dir)
    summary = df.agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_distinct("lesion_id").alias("n_lesions"),
        F.count_distinct("patient_id").alias("n_patients"),
        F.count_if(F.col("lesion_id").isNull()).alias("null_lesion_id"),
        F.count_if(F.col("patient_id").isNull()).alias("null_patient_id"),
    )
    per_lesion = profile.group_sizes(df, ["lesion_id"], "n_imgs")
    multi = per_lesion.agg(F.count_if(F.col("n_imgs") > 1)).scalar()
    return summary.select("*", multi.alias("lesions_multi_image")).select(
        "n_total", "n_lesions", "n_patients",
        profile.ratio_guarded(F.col("n_total"), F.col("n_lesions")).alias("imgs_per_lesion"),
        profile.ratio_guarded(F.col("n_total"), F.col("n_patients")).alias("imgs_per_patient"),
        "null_lesion_id", "null_patient_id", "lesions_multi_image",
    )


@register("G9", f"""
WITH {_BASE_SQL},
s AS (SELECT lesion_id, count(*) AS n_imgs FROM final WHERE lesion_id IS NOT NULL GROUP BY lesion_id),
r AS (SELECT n_imgs, row_number() OVER (ORDER BY n_imgs) - 1 AS i, count(*) OVER () AS n FROM s)
SELECT count(*) AS count, CAST(0 AS BIGINT) AS null_count, avg(n_imgs) AS mean, stddev_samp(n_imgs) AS std,
  CAST(min(n_imgs) AS DOUBLE) AS min,
  CAST(max(n_imgs) FILTER (WHERE i = floor((n - 1) * 0.25 + 0.5)) AS DOUBLE) AS p25,
  CAST(max(n_imgs) FILTER (WHERE i = floor((n - 1) * 0.5 + 0.5)) AS DOUBLE) AS p50,
  CAST(max(n_imgs) FILTER (WHERE i = floor((n - 1) * 0.75 + 0.5)) AS DOUBLE) AS p75,
  CAST(max(n_imgs) AS DOUBLE) AS max
FROM r""", ("meta", "meta_t"))
def q_g9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images-per-lesion describe, polars flavour (nearest-rank quantiles)."""
    per_lesion = profile.group_sizes(cohort(spark, sf_dir), ["lesion_id"], "n_imgs")
    return profile.describe(per_lesion, "n_imgs", [], "polars")


# --------------------------------------------------------------- figures ----

@register("H2", f"""
WITH {_BASE_SQL},
v AS (SELECT target, age_approx AS x FROM final WHERE target IN ({CLASSES_SQL}) AND age_approx IS NOT NULL),
s AS (SELECT target, count(*) AS n, stddev_samp(x) * pow(count(*), -0.2) AS h, min(x) AS mn, max(x) AS mx
      FROM v GROUP BY target),
g AS (SELECT target, n, h, mn - 3.0 * h AS lo, mx + 3.0 * h AS hi, unnest(range(200)) AS i FROM s),
gx AS (SELECT target, CAST(i AS INTEGER) AS i, n, h, lo + (hi - lo) * i / 199 AS x FROM g)
SELECT gx.target, gx.i, gx.x, sum(exp(-0.5 * ((gx.x - v.x) / gx.h) * ((gx.x - v.x) / gx.h)))
       / (any_value(gx.n) * any_value(gx.h) * sqrt(2 * pi())) AS density
FROM gx JOIN v ON gx.target = v.target GROUP BY gx.target, gx.i, gx.x""", ("meta", "meta_t"))
def q_h2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaussian density of age per class on a 200-point grid (Scott bandwidth, cut 3)."""
    from ..operators import figures
    df = curate.keep_classes(cohort(spark, sf_dir))
    # the class filter bounds the groups to the four literal classes
    return figures.kde_grid(df, "age_approx", ["target"], 200, 3.0, bounded_groups=True)


@register("H4", f"""
WITH {_BASE_SQL},
v AS (SELECT target, age_approx AS x FROM final WHERE age_approx IS NOT NULL),
q AS (SELECT target, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q3
      FROM v GROUP BY target),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lf, q3 + 1.5 * (q3 - q1) AS uf FROM q)
SELECT f.target, any_value(q1) AS q1, any_value(median) AS median, any_value(q3) AS q3,
  min(x) FILTER (WHERE x BETWEEN lf AND uf) AS whisker_lo, max(x) FILTER (WHERE x BETWEEN lf AND uf) AS whisker_hi,
  count(*) FILTER (WHERE NOT (x BETWEEN lf AND uf)) AS n_outliers, count(*) AS n
FROM v JOIN f ON v.target = f.target GROUP BY f.target""", ("meta", "meta_t"))
def q_h4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violin/box statistics of age per class: quartile lines, whiskers, outliers."""
    from ..operators import figures
    return figures.box_stats(cohort(spark, sf_dir), "age_approx", ["target"])


# ------------------------------------------------------- small reports ----

@register("G3", f"""SELECT target, count(*) AS count, {sround('count(*) / sum(count(*)) OVER () * 100', 2)} AS pct
FROM meta_t WHERE target IS NOT NULL GROUP BY target""", ("meta", "meta_t"))
def q_g3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of all rows per class, rounded to 2 decimals (half to even)."""
    return profile.share_of_total(curate.derive_target(standins.meta(spark, sf_dir)), "target", 2)


@register("G4", f"WITH {_BASE_SQL} SELECT lesion_id, count(*) AS n_imgs FROM final WHERE lesion_id IS NOT NULL "
          "GROUP BY lesion_id", ("meta", "meta_t"))
def q_g4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images per lesion (group size on one key, NULL keys dropped)."""
    return profile.group_sizes(cohort(spark, sf_dir), ["lesion_id"], "n_imgs")


@register("G7", f"WITH {_BASE_SQL} SELECT count(DISTINCT lesion_id) AS n_unique_lesion_id, "
          "count(DISTINCT patient_id) AS n_unique_patient_id FROM final", ("meta", "meta_t"))
def q_g7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact distinct counts of lesion and patient ids (NULL excluded)."""
    return profile.n_unique(cohort(spark, sf_dir), ["lesion_id", "patient_id"])


@register("P13", f"WITH {_BASE_SQL} SELECT {_FINAL_COLS} FROM final ORDER BY isic_id LIMIT 5", ("meta", "meta_t"))
def q_p13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preview: the first five rows of the curated cohort by id (a top-k, TakeOrdered)."""
    return cohort(spark, sf_dir).orderBy("isic_id").limit(5)


@register("S1", f"SELECT DISTINCT target, replace(target, '-', chr(10)) AS label FROM meta_t "
          f"WHERE target IN ({CLASSES_SQL})", ("meta", "meta_t"))
def q_s1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Axis labels: every '-' of the class name replaced by a line break."""
    from ..functions.clean import replace_all
    df = curate.keep_classes(curate.derive_target(standins.meta(spark, sf_dir)))
    return df.select("target", replace_all("target", "-", "\n").alias("label")).distinct()


@register("S8", f"""WITH {_BASE_SQL}
SELECT format('{{:,}}', count(*)) AS n_total_text, printf('%.2f', count(*) / greatest(count(DISTINCT lesion_id), 1))
       AS imgs_per_lesion_text FROM final""", ("meta", "meta_t"))
def q_s8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report number formatting: thousands separators and fixed decimals."""
    df = cohort(spark, sf_dir)
    s = df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("lesion_id").alias("l"))
    return s.select(F.format_number(F.col("n"), 0).alias("n_total_text"),
                    F.format_string("%.2f", profile.ratio_guarded(F.col("n"), F.col("l"))).alias("imgs_per_lesion_text"))
