"""Queries over the clinical-table stand-in (notebook 05: clinical EDA job X6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clean as C
from ..operators import figures, match, profile
from ..session import materialize
from ..sources import standins
from .catalog import register
from .jobs import clean_clinical
from .oracle_views import sround

FO = "fo_o, fo_ln, fo_p, fo_s, fo_e, fo_q, fo_d"
V = ("clinical", "clinical_clean")
BM = ["Benign", "Malignant"]

# Fixed values of the clinical notebook (must equal the source's).
CLARK_ORDER = ["Clark I", "Clark II", "Clark III", "Clark IV"]
TREATMENT_LABELS = {
    "WLE": "WLE\n(Escisión amplia)",
    "NEO": "NEO\n(Neoadyuvante)",
    "BGC": "BGC\n(Biopsia ganglio)",
    "ADY": "ADY\n(Adyuvante)",
    "RT": "RT\n(Radioterapia)",
}
RISK_BANDS = [(50, "high"), (10, "medium")]

CLEAN_COLS = ["Patient_ID", "Age", "Sex", "Skin_Phototype", "Anatomic_Site", "Family_History_Melanoma", "Image_ID",
              "diagnosis", "diagnosis_subtype", "Melanocytic_Lesion", "Benign_Malignant", "Diagnostic_Method",
              "Diameter_major_mm", "Diameter_minor_mm", "Clark_Depth", "Breslow_mm", "Treatment", "Date", "Year",
              "Month", "Breslow_numeric"]


def clin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_clinical(standins.clinical(spark, sf_dir))


def patients(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """One row per patient, the first in file order, with ``columns`` alone: what the
    aggregate does not carry is neither sorted nor spilled."""
    rows = clin(spark, sf_dir).select("Patient_ID", *columns, F.col("file_order").alias("__order"))
    return match.first_by_order(rows, ["Patient_ID"], "__order", columns)


_PATIENTS_SQL = f"""
patients AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY Patient_ID ORDER BY {FO}) AS rn
                            FROM clinical_clean) WHERE rn = 1)"""


# ------------------------------------------------------------- cleaning ----

@register("S5", """SELECT Patient_ID, Image_ID, Age, Skin_Phototype, Diameter_major_mm, Diameter_minor_mm, diagnosis,
                  Date, Year, Month, Breslow_numeric, Area_approx_mm2, Aspect_ratio FROM clinical_clean""", V)
def q_s5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed clinical table: decimal comma, strip, date suffix, year/month, Breslow, area, ratio."""
    return clin(spark, sf_dir).select(
        "Patient_ID", "Image_ID", "Age", "Skin_Phototype", "Diameter_major_mm", "Diameter_minor_mm", "diagnosis",
        "Date", "Year", "Month", "Breslow_numeric", "Area_approx_mm2", "Aspect_ratio")


@register("D1", """SELECT Image_ID, Date, Year, Month FROM clinical_clean""", V)
def q_d1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict ``ddMMyyyy`` parse of the Image_ID suffix (invalid → NULL), year and month."""
    return clin(spark, sf_dir).select("Image_ID", "Date", "Year", "Month")


@register("M2", """SELECT Image_ID, Breslow_mm, Breslow_numeric FROM clinical_clean""", V)
def q_m2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentinel 'In situ' → NULL, else number or NULL."""
    return clin(spark, sf_dir).select("Image_ID", "Breslow_mm", "Breslow_numeric")


@register("M1", """SELECT Image_ID, Area_approx_mm2, Aspect_ratio FROM clinical_clean""", V)
def q_m1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ellipse area and aspect ratio (zero divisor → NULL)."""
    return clin(spark, sf_dir).select("Image_ID", "Area_approx_mm2", "Aspect_ratio")


# --------------------------------------------------------- completeness ----

def _n2_sql(with_band: bool) -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS n_missing, count(*) AS n FROM clinical_clean"
        for c in CLEAN_COLS)
    band = (", CASE WHEN pct_missing > 50 THEN 'high' WHEN pct_missing > 10 THEN 'medium' ELSE 'low' END AS band"
            if with_band else "")
    return f"""
WITH m AS ({parts}),
p AS (SELECT column_name, CAST(n_missing AS BIGINT) AS n_missing,
             {sround('n_missing / n * 100', 1)} AS pct_missing FROM m WHERE n_missing > 0)
SELECT column_name, n_missing, pct_missing, 100.0 - pct_missing AS pct_complete{band} FROM p"""


@register("N2", _n2_sql(False), V)
def q_n2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completeness report: nulls, % missing (1 dp), % complete, only columns with gaps."""
    return profile.completeness(clin(spark, sf_dir), CLEAN_COLS, 1)


@register("P16", _n2_sql(True), V)
def q_p16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completeness report with the risk band of the missing share (>50, >10, else)."""
    rep = profile.completeness(clin(spark, sf_dir), CLEAN_COLS, 1)
    return rep.withColumn("band", C.band("pct_missing", RISK_BANDS, "low"))


# -------------------------------------------------------------- patients ----

@register("J12", f"WITH {_PATIENTS_SQL} SELECT Patient_ID, Age, Sex, Skin_Phototype, Family_History_Melanoma FROM patients",
          V)
def q_j12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First row per patient in file order (``drop_duplicates`` keep first)."""
    return patients(spark, sf_dir, "Age", "Sex", "Skin_Phototype", "Family_History_Melanoma")


@register("G2", f"WITH {_PATIENTS_SQL} SELECT Skin_Phototype, count(*) AS count FROM patients "
          "WHERE Skin_Phototype IS NOT NULL GROUP BY Skin_Phototype", V)
def q_g2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phototype counts per patient, ordered by value."""
    return profile.value_counts(patients(spark, sf_dir, "Skin_Phototype"), "Skin_Phototype", by="value")


@register("G10", f"""WITH {_PATIENTS_SQL}
SELECT count(Age) AS count, {sround('avg(Age)', 1)} AS mean, {sround('stddev_samp(Age)', 1)} AS std,
  {sround('min(Age)', 1)} AS min, {sround('quantile_cont(Age, 0.25)', 1)} AS p25,
  {sround('quantile_cont(Age, 0.5)', 1)} AS p50, {sround('quantile_cont(Age, 0.75)', 1)} AS p75,
  {sround('max(Age)', 1)} AS max FROM patients""", V)
def q_g10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Age describe per patient (pandas flavour), rounded to 1."""
    return profile.describe(materialize(patients(spark, sf_dir, "Age")), "Age", [], "pandas", digits=1)


@register("N8", f"WITH {_PATIENTS_SQL} SELECT Family_History_Melanoma, count(*) AS count FROM patients GROUP BY 1", V)
def q_n8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Family history value counts keeping NULL as a category."""
    return profile.value_counts(patients(spark, sf_dir, "Family_History_Melanoma"), "Family_History_Melanoma", dropna=False)


@register("G17", """
WITH s AS (SELECT Patient_ID, count(*) AS n FROM clinical_clean GROUP BY Patient_ID)
SELECT CAST(min(n) AS DOUBLE) AS min, quantile_cont(n, 0.5) AS median, avg(n) AS mean, CAST(max(n) AS DOUBLE) AS max
FROM s""", V)
def q_g17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images per patient: min, median, mean, max."""
    sizes = profile.group_sizes(clin(spark, sf_dir), ["Patient_ID"], "n")
    d = profile.describe(sizes, "n", [], "pandas", percentiles=[0.5], pct_names=["median"])
    return d.select("min", "median", "mean", "max")


@register("W7", """
SELECT Patient_ID, count(*) AS n_images FROM clinical_clean GROUP BY Patient_ID
ORDER BY n_images DESC, Patient_ID LIMIT 15""", V)
def q_w7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top 15 patients by number of images (ties by id)."""
    sizes = profile.group_sizes(clin(spark, sf_dir), ["Patient_ID"], "n_images")
    return sizes.orderBy(F.desc("n_images"), "Patient_ID").limit(15)


# ------------------------------------------------------------ diagnosis ----

@register("G13", f"""SELECT diagnosis, first(Benign_Malignant ORDER BY {FO}) FILTER (WHERE Benign_Malignant IS NOT NULL)
AS Benign_Malignant FROM clinical_clean WHERE diagnosis IS NOT NULL GROUP BY diagnosis""", V)
def q_g13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First non-null category per diagnosis in file order."""
    df = clin(spark, sf_dir).where(F.col("diagnosis").isNotNull())
    return profile.first_non_null(df, ["diagnosis"], "Benign_Malignant", "file_order")


@register("G14", f"""
SELECT diagnosis, count(Image_ID) AS n_images,
  first(Benign_Malignant ORDER BY {FO}) FILTER (WHERE Benign_Malignant IS NOT NULL) AS category,
  {sround('count(Image_ID) / (SELECT count(*) FROM clinical_clean) * 100', 1)} AS pct_total
FROM clinical_clean WHERE diagnosis IS NOT NULL GROUP BY diagnosis""", V)
def q_g14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diagnosis table: images, first category, share of all rows (1 dp), sorted by images."""
    df = clin(spark, sf_dir)
    total = df.agg(F.count(F.lit(1))).scalar()
    g = df.where(F.col("diagnosis").isNotNull()).groupBy("diagnosis").agg(
        F.count("Image_ID").alias("n_images"),
        F.min_by("Benign_Malignant", F.when(F.col("Benign_Malignant").isNotNull(), F.col("file_order"))).alias("category"),
    )
    return (g.select("diagnosis", "n_images", "category",
                     F.bround(F.col("n_images") / total * 100, 1).alias("pct_total"))
            .orderBy(F.desc("n_images"), "diagnosis"))


@register("G15", """
SELECT count(*) FILTER (WHERE Benign_Malignant = 'Malignant') AS n_malignant,
       avg(CAST(coalesce(Benign_Malignant = 'Malignant', false) AS DOUBLE)) * 100 AS pct_malignant
FROM clinical_clean""", V)
def q_g15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Malignant count and rate over all images."""
    is_mal = F.coalesce(F.col("Benign_Malignant") == "Malignant", F.lit(False))
    return clin(spark, sf_dir).agg(
        F.count_if(is_mal).alias("n_malignant"),
        (F.avg(is_mal.cast("double")) * 100).alias("pct_malignant"))


# ---------------------------------------------------------- BM matrices ----

def _pct_matrix_sql(row: str) -> str:
    return f"""
WITH c AS (SELECT {row}, Benign_Malignant, count(*) AS n FROM clinical_clean
           WHERE {row} IS NOT NULL AND Benign_Malignant IS NOT NULL GROUP BY ALL)
SELECT {row}, {", ".join(f"coalesce(sum(n) FILTER (WHERE Benign_Malignant = '{b}'), 0) / sum(n) * 100 AS {b}" for b in BM)}
FROM c GROUP BY {row}"""


@register("G22", _pct_matrix_sql("Sex"), V)
def q_g22(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sex × category counts divided by the row sum (percent)."""
    return profile.percent_matrix(clin(spark, sf_dir), "Sex", "Benign_Malignant")


def _count_matrix_sql(row: str, col: str, values: list[str]) -> str:
    return f"""
SELECT {row}, {", ".join(f"count(*) FILTER (WHERE {col} = '{v}') AS {v}" for v in values)}
FROM clinical_clean WHERE {row} IS NOT NULL AND {col} IS NOT NULL GROUP BY {row}"""


@register("G23", _count_matrix_sql("Diagnostic_Method", "Benign_Malignant", BM), V)
def q_g23(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diagnostic method × category count matrix, zero filled."""
    return profile.count_matrix(clin(spark, sf_dir), "Diagnostic_Method", "Benign_Malignant")


@register("G25", _count_matrix_sql("Anatomic_Site", "diagnosis", ["BCC", "MEL", "NV"]), V)
def q_g25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-tabulation site × diagnosis (rows with both values)."""
    return profile.count_matrix(clin(spark, sf_dir), "Anatomic_Site", "diagnosis")


@register("G16", f"""
SELECT Diagnostic_Method, count(*) FILTER (WHERE Benign_Malignant = 'Malignant') AS k, count(*) AS n,
  count(*) FILTER (WHERE Benign_Malignant = 'Malignant') / count(*) * 100 AS rate,
  printf('%d / %d (%.1f%%)', count(*) FILTER (WHERE Benign_Malignant = 'Malignant'), count(*),
         {sround("count(*) FILTER (WHERE Benign_Malignant = 'Malignant') / count(*) * 100", 1)}) AS label
FROM clinical_clean GROUP BY Diagnostic_Method""", V)
def q_g16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Malignancy rate per diagnostic method formatted ``k / n (p%)``."""
    return profile.conditional_rate(clin(spark, sf_dir), "Diagnostic_Method",
                                    F.coalesce(F.col("Benign_Malignant") == "Malignant", F.lit(False)))


_SITE_SQL = f"""
site AS (SELECT Anatomic_Site, {", ".join(f"count(*) FILTER (WHERE Benign_Malignant = '{b}') AS {b}" for b in BM)},
                count(*) AS Total FROM clinical_clean
         WHERE Anatomic_Site IS NOT NULL AND Benign_Malignant IS NOT NULL GROUP BY Anatomic_Site)"""


def _site_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.matrix_with_rate(clin(spark, sf_dir), "Anatomic_Site", "Benign_Malignant", "Malignant", digits=1)


@register("G24", f"WITH {_SITE_SQL} SELECT Anatomic_Site, Benign, Malignant, Total, "
          f"{sround('Malignant / Total * 100', 1)} AS pct_positive FROM site", V)
def q_g24(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Site × category matrix with total and % malignant, sorted by total."""
    return _site_table(spark, sf_dir)


@register("G19", f"""WITH {_SITE_SQL}, r AS (SELECT Anatomic_Site, {sround('Malignant / Total * 100', 1)} AS pct_positive FROM site)
SELECT Anatomic_Site, pct_positive FROM r ORDER BY pct_positive DESC, Anatomic_Site LIMIT 1""", V)
def q_g19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Site with the highest malignancy rate, with the rate."""
    return profile.argmax_count(_site_table(spark, sf_dir), "Anatomic_Site", "pct_positive")


@register("G12", "\nUNION ALL\n".join(f"""
SELECT Benign_Malignant, '{c}' AS metric, count({c}) AS count, {sround(f'avg({c})', 2)} AS mean,
  {sround(f'stddev_samp({c})', 2)} AS std, {sround(f'min({c})', 2)} AS min,
  {sround(f'quantile_cont({c}, 0.25)', 2)} AS p25, {sround(f'quantile_cont({c}, 0.5)', 2)} AS p50,
  {sround(f'quantile_cont({c}, 0.75)', 2)} AS p75, {sround(f'max({c})', 2)} AS max
FROM clinical_clean WHERE Benign_Malignant IS NOT NULL AND {c} IS NOT NULL GROUP BY Benign_Malignant"""
                                       for c in ["Diameter_major_mm", "Diameter_minor_mm", "Area_approx_mm2"]), V)
def q_g12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grouped describe over the three measurements, rounded to 2, long form."""
    df = clin(spark, sf_dir).where(F.col("Benign_Malignant").isNotNull())
    d = profile.describe_many(df, "Benign_Malignant", ["Diameter_major_mm", "Diameter_minor_mm", "Area_approx_mm2"], 2)
    return d.where(F.col("count") > 0)


# ------------------------------------------------------------- malignant ----

@register("P10", "SELECT diagnosis, count(*) AS count FROM clinical_clean "
          "WHERE Benign_Malignant = 'Malignant' AND diagnosis IS NOT NULL GROUP BY diagnosis", V)
def q_p10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equality filter (malignant images) then diagnosis counts."""
    mal = clin(spark, sf_dir).where(F.col("Benign_Malignant") == "Malignant")
    return profile.value_counts(mal, "diagnosis")


@register("J13", "SELECT Clark_Depth, count(*) AS count FROM clinical_clean "
          "WHERE Benign_Malignant = 'Malignant' AND Clark_Depth IN ("
          + ", ".join(f"'{c}'" for c in CLARK_ORDER) + ") GROUP BY Clark_Depth", V)
def q_j13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clark depth counts of malignant images in the fixed Clark order, absent levels dropped."""
    mal = clin(spark, sf_dir).where(F.col("Benign_Malignant") == "Malignant")
    return profile.order_by_list(profile.value_counts(mal, "Clark_Depth", by="value"), "Clark_Depth", CLARK_ORDER)


@register("P15", "SELECT CASE Treatment " + " ".join(
    "WHEN '{}' THEN '{}'".format(k, v.replace("'", "''")) for k, v in TREATMENT_LABELS.items())
          + " ELSE Treatment END AS Treatment, count(*) AS count FROM clinical_clean "
          "WHERE Benign_Malignant = 'Malignant' AND Treatment IS NOT NULL GROUP BY Treatment", V)
def q_p15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Treatment counts of malignant images with code → label lookup (code kept when unknown)."""
    mal = clin(spark, sf_dir).where(F.col("Benign_Malignant") == "Malignant")
    vc = profile.value_counts(mal, "Treatment")
    return vc.select(C.label_lookup("Treatment", TREATMENT_LABELS).alias("Treatment"), "count")


# ------------------------------------------------------------- temporal ----

@register("G18", "SELECT min(Date) AS date_min, max(Date) AS date_max FROM clinical_clean WHERE Year IS NOT NULL", V)
def q_g18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Date range of images with a valid capture date."""
    df = clin(spark, sf_dir).na.drop(subset=["Year"])
    return df.agg(F.min("Date").alias("date_min"), F.max("Date").alias("date_max"))


@register("J11", "SELECT DISTINCT Year FROM clinical_clean WHERE Year IS NOT NULL", V)
def q_j11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted distinct years with records."""
    return match.sorted_distinct(clin(spark, sf_dir), "Year")


@register("X6", f"""
SELECT Year, {", ".join(f"count(*) FILTER (WHERE Benign_Malignant = '{b}') AS {b}" for b in BM)}
FROM clinical_clean WHERE Year IS NOT NULL AND Benign_Malignant IS NOT NULL GROUP BY Year""", V)
def q_x6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clinical EDA job, temporal table: images per year and category."""
    df = clin(spark, sf_dir).na.drop(subset=["Year"])
    return profile.count_matrix(df, "Year", "Benign_Malignant").orderBy("Year")


# -------------------------------------------------------------- summary ----

@register("G30", f"""
WITH {_SITE_SQL},
dc AS (SELECT diagnosis, count(*) AS n FROM clinical_clean WHERE diagnosis IS NOT NULL GROUP BY diagnosis),
top AS (SELECT diagnosis, n FROM dc ORDER BY n DESC, diagnosis LIMIT 1),
risk AS (SELECT Anatomic_Site, {sround('Malignant / Total * 100', 1)} AS pct FROM site ORDER BY pct DESC, Anatomic_Site LIMIT 1),
tot AS (SELECT count(*) AS n_total, count(DISTINCT Patient_ID) AS n_patients,
   count(*) FILTER (WHERE Benign_Malignant = 'Malignant') AS n_malignant,
   count(*) FILTER (WHERE Benign_Malignant = 'Benign') AS n_benign FROM clinical_clean)
SELECT n_total, n_patients, n_total / greatest(n_patients, 1) AS imgs_per_patient, n_benign, n_malignant,
  n_malignant / n_total * 100 AS pct_malignant, top.diagnosis AS top_diagnosis, top.n AS top_diagnosis_n,
  top.n / n_total * 100 AS top_diagnosis_pct, risk.Anatomic_Site AS riskiest_site, risk.pct AS riskiest_site_pct
FROM tot, top, risk""", V)
def q_g30(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Executive summary in one row: totals, class balance, dominant diagnosis, riskiest site."""
    df = clin(spark, sf_dir)
    tot = df.agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_distinct("Patient_ID").alias("n_patients"),
        F.count_if(F.col("Benign_Malignant") == "Malignant").alias("n_malignant"),
        F.count_if(F.col("Benign_Malignant") == "Benign").alias("n_benign"),
    )
    top = profile.argmax_count(profile.value_counts(df, "diagnosis"), "diagnosis", "count")
    risk = profile.argmax_count(_site_table(spark, sf_dir), "Anatomic_Site", "pct_positive")
    # the dominant diagnosis and the riskiest site are one-row results: scalar subqueries
    t = top.select(F.struct("diagnosis", "count").alias("s")).scalar()
    r = risk.select(F.struct("Anatomic_Site", "pct_positive").alias("s")).scalar()
    j = tot.select("*", t["diagnosis"].alias("diagnosis"), t["count"].alias("count"),
                   r["Anatomic_Site"].alias("Anatomic_Site"), r["pct_positive"].alias("pct_positive"))
    return j.select(
        "n_total", "n_patients",
        profile.ratio_guarded(F.col("n_total"), F.col("n_patients")).alias("imgs_per_patient"),
        "n_benign", "n_malignant",
        (F.col("n_malignant") / F.col("n_total") * 100).alias("pct_malignant"),
        F.col("diagnosis").alias("top_diagnosis"), F.col("count").alias("top_diagnosis_n"),
        (F.col("count") / F.col("n_total") * 100).alias("top_diagnosis_pct"),
        F.col("Anatomic_Site").alias("riskiest_site"), F.col("pct_positive").alias("riskiest_site_pct"),
    )


# --------------------------------------------------------------- figures ----

@register("H1", f"""
WITH {_PATIENTS_SQL},
v AS (SELECT Age AS x FROM patients WHERE Age IS NOT NULL),
r AS (SELECT CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END AS mn,
             CASE WHEN min(x) = max(x) THEN max(x) + 0.5 ELSE max(x) END AS mx FROM v),
b AS (SELECT CAST(unnest(range(15)) AS INTEGER) AS bin),
c AS (SELECT CAST(least(14, floor((x - mn) / (mx - mn) * 15)) AS INTEGER) AS bin, count(*) AS n FROM v, r GROUP BY 1)
SELECT b.bin, mn + b.bin * ((mx - mn) / 15) AS lo,
       CASE WHEN b.bin = 14 THEN mx ELSE mn + (b.bin + 1) * ((mx - mn) / 15) END AS hi,
       CAST(coalesce(c.n, 0) AS BIGINT) AS count
FROM b CROSS JOIN r LEFT JOIN c ON b.bin = c.bin""", V)
def q_h1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Age histogram of patients, 15 equal-width bins over the data range."""
    return figures.histogram(materialize(patients(spark, sf_dir, "Age")), "Age", 15)


@register("H3", f"""
WITH v AS (SELECT Benign_Malignant, Area_approx_mm2 AS x FROM clinical_clean
           WHERE Area_approx_mm2 IS NOT NULL AND Benign_Malignant IS NOT NULL),
q AS (SELECT Benign_Malignant, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median,
             quantile_cont(x, 0.75) AS q3 FROM v GROUP BY 1),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lf, q3 + 1.5 * (q3 - q1) AS uf FROM q)
SELECT f.Benign_Malignant, any_value(q1) AS q1, any_value(median) AS median, any_value(q3) AS q3,
  min(x) FILTER (WHERE x BETWEEN lf AND uf) AS whisker_lo, max(x) FILTER (WHERE x BETWEEN lf AND uf) AS whisker_hi,
  count(*) FILTER (WHERE NOT (x BETWEEN lf AND uf)) AS n_outliers, count(*) AS n
FROM v JOIN f ON v.Benign_Malignant = f.Benign_Malignant GROUP BY f.Benign_Malignant""", V)
def q_h3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Box statistics of the lesion area per category (quartiles, whiskers, outliers)."""
    return figures.box_stats(clin(spark, sf_dir), "Area_approx_mm2", ["Benign_Malignant"])
