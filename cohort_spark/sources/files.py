"""File sources and sinks.

Every reader returns a DataFrame with an explicit schema where one is known
(``inferSchema`` costs an extra pass and is only for exploration); listings use
the ``binaryFile`` source without reading file contents; images use Spark's
``image`` source (BGR bytes, row-major), keeping undecodable files as rows.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.clean import file_stem, has_suffix

IMAGE_EXTS = (".jpg", ".jpeg", ".png")

# ISIC metadata columns read by the curation job (FIXTURES.md §1).
ISIC_SCHEMA = T.StructType([
    T.StructField("isic_id", T.StringType()),
    T.StructField("lesion_id", T.StringType()),
    T.StructField("patient_id", T.StringType()),
    T.StructField("age_approx", T.DoubleType()),
    T.StructField("anatom_site_general", T.StringType()),
    T.StructField("anatom_site_special", T.StringType()),
    T.StructField("clin_size_long_diam_mm", T.DoubleType()),
    T.StructField("fitzpatrick_skin_type", T.StringType()),
    T.StructField("image_type", T.StringType()),
    T.StructField("personal_hx_mm", T.BooleanType()),
    T.StructField("pixels_x", T.IntegerType()),
    T.StructField("pixels_y", T.IntegerType()),
    T.StructField("sex", T.StringType()),
    T.StructField("melanocytic", T.BooleanType()),
    T.StructField("diagnosis_1", T.StringType()),
])

# Positional names of the clinical CSV (FIXTURES.md §3, fixed by the source).
CLINICAL_COLUMNS = [
    "Patient_ID", "Age", "Sex", "Skin_Phototype", "Anatomic_Site",
    "Family_History_Melanoma", "Image_ID", "diagnosis", "diagnosis_subtype",
    "Melanocytic_Lesion", "Benign_Malignant", "Diagnostic_Method",
    "Diameter_major_mm", "Diameter_minor_mm", "Clark_Depth",
    "Breslow_mm", "Treatment", "Extra_1", "Extra_2", "Extra_3",
]


# ------------------------------------------------------------------ CSV ----

def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, header: bool = True) -> DataFrame:
    """CSV with a header; with ``schema`` no inference pass is made.

    With a header the columns are matched by name: the file may hold more columns,
    and in another order.  A column that the file lacks is an error."""
    if schema is None:
        return spark.read.option("header", header).option("inferSchema", True).csv(path)
    if not header:
        return spark.read.schema(schema).csv(path)
    names = spark.read.option("header", True).csv(path).columns
    missing = [f.name for f in schema if f.name not in names]
    if missing:
        raise ValueError(f"{path}: no column {', '.join(missing)} among {', '.join(names)}")
    known = {f.name: f.dataType for f in schema}
    full = T.StructType([T.StructField(n, known.get(n, T.StringType())) for n in names])
    return spark.read.option("header", True).schema(full).csv(path).select(*[f.name for f in schema])


def read_banner_csv(spark: SparkSession, path: str, columns: Sequence[str] = CLINICAL_COLUMNS,
                    header_value: str | None = None, banner: str | None = None) -> DataFrame:
    """A3: a CSV whose first line is a section banner and second line the header.

    The file is read without a header against a positional all-string schema
    and the banner and header lines are removed by content: the header line
    repeats a known label in a known column; the banner is a line whose first
    column holds ``banner`` (by default the first line of the file) and whose other
    columns are empty, so a data row with an id alone stays.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    raw = spark.read.option("header", False).schema(schema).csv(path)
    key = columns[6] if len(columns) > 6 else columns[0]
    header_value = header_value or key
    is_header = F.col(key) == F.lit(header_value)
    others_empty = F.coalesce(*[F.col(c) for c in columns[1:]]).isNull()
    if banner is None:
        first = raw.first()
        banner = first[0] if first is not None else None
    is_banner = F.col(columns[0]).eqNullSafe(F.lit(banner)) & others_empty
    return raw.where(~is_header.eqNullSafe(True) & ~is_banner)


def read_id_column(spark: SparkSession, path: str, col: str = "image_id") -> DataFrame:
    """A4/A5: the id column of an output CSV for resuming; a missing or empty
    file gives an empty table of the same schema."""
    empty = spark.createDataFrame([], T.StructType([T.StructField(col, T.StringType())]))
    if not _exists(spark, path):
        return empty
    try:
        df = spark.read.option("header", True).csv(path)
    except Exception:  # noqa: BLE001 - unreadable file behaves like no output yet
        return empty
    if col not in df.columns:
        return empty
    return df.select(F.col(col).cast("string").alias(col))


def read_id_column_parquet(spark: SparkSession, path: str, col: str = "image_id") -> DataFrame:
    """A4/A5 for a parquet output table: its ids, or an empty table when absent."""
    if not _exists(spark, path):
        return spark.createDataFrame([], T.StructType([T.StructField(col, T.StringType())]))
    return spark.read.parquet(path).select(F.col(col).cast("string").alias(col))


def read_errors(spark: SparkSession, path: str) -> DataFrame:
    """The distinct rows of an error table, or an empty table when absent."""
    if not _exists(spark, path):
        return spark.createDataFrame([], "image_id string, message string")
    return spark.read.parquet(path).select("image_id", "message").distinct()


def read_batches(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """``columns`` (DDL) and ``batch`` of a table in ``batch=<id>`` folders, or an
    empty table when absent."""
    schema = f"{columns}, batch bigint"
    return spark.read.schema(schema).parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)


def read_parquet_column(spark: SparkSession, path: str, col: str) -> DataFrame:
    """One column of a parquet table (the scan reads only that column)."""
    return spark.read.parquet(path).select(col)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return False
    st = fs.getContentSummary(p)
    return st.getLength() > 0


# ---------------------------------------------------------------- sinks ----

def write_parquet(df: DataFrame, path: str, compression: str = "snappy", mode: str = "overwrite") -> None:
    """Parquet sink (snappy by default)."""
    df.write.mode(mode).option("compression", compression).parquet(path)


def append_parquet(df: DataFrame, path: str) -> None:
    """A10: append a batch to an output table (the resume checkpoint)."""
    df.write.mode("append").parquet(path)


def write_report_csv(df: DataFrame, path: str) -> None:
    """A small report as one CSV file with a header (reports are a few rows)."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


# -------------------------------------------------------------- listing ----

def list_files(spark: SparkSession, directory: str, exts: Sequence[str] = IMAGE_EXTS) -> DataFrame:
    """A directory listing as a table ``(path, length, modificationTime, id)``.

    Only metadata columns are selected, so file contents are never read; the
    extension test is case-insensitive (``lower(path)``) and ``id`` is the file
    stem (S6).
    """
    lst = (spark.read.format("binaryFile").load(directory)
           .select("path", "length", "modificationTime"))
    if exts:
        lst = lst.where(has_suffix("path", tuple(exts)))
    return lst.withColumn("id", file_stem("path"))


def read_images(spark: SparkSession, directory: str | list[str], exts: Sequence[str] = IMAGE_EXTS,
                id_suffix_re: str | None = None) -> DataFrame:
    """Decoded images ``(image_id, image)`` of a folder or a list of files.

    Undecodable files are kept (``dropInvalid=false``); they come back with
    ``height = -1`` and are routed to an error table by the callers.
    """
    pattern = "|".join(e.lstrip(".") for e in exts)
    df = (spark.read.format("image").option("dropInvalid", False)
          .option("pathGlobFilter", "*").load(directory))
    df = df.where(F.lower(F.col("image.origin")).rlike(rf"\.({pattern})$"))
    stem = file_stem(F.col("image.origin"))
    if id_suffix_re:
        stem = F.regexp_replace(stem, id_suffix_re, "")
    return df.select(stem.alias("image_id"), "image")


# ----------------------------------------------------------------- COCO ----

def read_coco(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A COCO document → (images, annotations, categories) tables."""
    doc = spark.read.option("multiLine", True).json(path)
    images = doc.select(F.explode("images").alias("i")).select("i.*")
    anns = doc.select(F.explode("annotations").alias("a")).select("a.*")
    cats = doc.select(F.explode("categories").alias("c")).select("c.*")
    return images, anns, cats


def coco_path(root: str, image_set: str, mode: str = "instances", year: int = 2017) -> tuple[str, str]:
    """Folder and annotation file of a split: ``<set><year>/``, ``annotations/<mode>_<set><year>.json``."""
    return (os.path.join(root, f"{image_set}{year}"),
            os.path.join(root, "annotations", f"{mode}_{image_set}{year}.json"))


def write_coco(images: DataFrame, annotations: DataFrame, categories: DataFrame, path: str,
               single_document: bool = False) -> None:
    """COCO export: three folders of JSON lines, so that nothing is gathered
    into one task.  ``single_document`` gathers the three tables into one JSON
    document instead, for small exports that fit one file."""
    if not single_document:
        images.write.mode("overwrite").json(os.path.join(path, "images"))
        annotations.write.mode("overwrite").json(os.path.join(path, "annotations"))
        categories.write.mode("overwrite").json(os.path.join(path, "categories"))
        return
    # three one-row aggregates: annotations and categories enter as scalar subqueries
    a = annotations.agg(F.collect_list(F.struct(*annotations.columns))).scalar()
    c = categories.agg(F.collect_list(F.struct(*categories.columns))).scalar()
    i = images.agg(F.collect_list(F.struct(*images.columns)).alias("images"))
    doc = i.select(
        F.to_json(F.struct(F.struct(F.lit("lesion masks").alias("description")).alias("info"),
                           F.array().cast("array<string>").alias("licenses"),
                           "images", a.alias("annotations"), c.alias("categories"))).alias("value"))
    doc.coalesce(1).write.mode("overwrite").text(path)
