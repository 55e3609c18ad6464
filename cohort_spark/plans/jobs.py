"""End-to-end jobs users run (X rows).  Each returns lazy DataFrames; the caller
decides where to write them (``cohort_spark.sources.files`` sinks)."""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.curate import (
    DROPPED_COLUMNS, INTERESTED_COLUMNS, TARGET_CLASSES, derive_target, fill_constant,
    impute_group_mode, keep_classes, one_hot,
)
from ..operators.match import keep_existing
from ..operators.profile import distinct_values


def cohort_before_encoding(meta: DataFrame, classes: Sequence[str] = TARGET_CLASSES) -> DataFrame:
    """X1 up to imputation: select → target → class filter → not-null filter →
    drop → group-mode imputation (order as in the source: NULL ``melanocytic``
    rows are labelled before they are removed)."""
    df = meta.select(*INTERESTED_COLUMNS)                         # P1
    df = derive_target(df)                                        # P4, P5
    df = keep_classes(df, "target", classes)                      # P6
    df = df.where(F.col("melanocytic").isNotNull())               # P8
    df = df.drop(*DROPPED_COLUMNS)                                # P2
    # the class filter bounds the group domain to len(classes) rows
    return impute_group_mode(df, "target", ["age_approx", "sex"], bounded_groups=True)  # N5


def curate_cohort(meta: DataFrame, on_disk: DataFrame, site_values: Sequence[str] | None = None,
                  classes: Sequence[str] = TARGET_CLASSES) -> DataFrame:
    """The curated cohort ``isic_selected``.

    ``on_disk`` is a listing with an ``id`` column (file stems).  Images
    selected by metadata but missing on disk are removed with a semi join.
    """
    df = cohort_before_encoding(meta, classes)
    if site_values is None:
        # the one-hot header needs the distinct sites; read them from the
        # filtered rows before the imputation aggregate (sites are not imputed)
        pre = derive_target(meta.select("anatom_site_general", "melanocytic", "diagnosis_1"))
        pre = keep_classes(pre, "target", classes).where(F.col("melanocytic").isNotNull())
        site_values = distinct_values(fill_constant(pre, "anatom_site_general", "unknown"), "anatom_site_general")
    df = fill_constant(df, "anatom_site_general", "unknown")      # N4
    df = df.withColumnRenamed("anatom_site_general", "anatom_site")  # P3
    df = one_hot(df, "anatom_site", site_values)                  # M7
    return keep_existing(df, on_disk, "isic_id")                  # J4


# --------------------------------------------------------------------- X6 ----

from ..functions import clean as C  # noqa: E402

CLINICAL_EXTRA = ["Extra_1", "Extra_2", "Extra_3"]


def clean_clinical(raw: DataFrame) -> DataFrame:
    """X6 stage 1: typed clinical table.

    S5 decimal comma, S3 strip, S4 + D1 date from the ``_DDMMYYYY`` suffix
    (invalid → NULL), D2 year/month, M2 Breslow sentinel, M1 area and aspect
    ratio (zero minor diameter → NULL).
    """
    df = raw.drop(*[c for c in CLINICAL_EXTRA if c in raw.columns])
    date = C.date_or_null(C.extract_or_null("Image_ID", r"_(\d{8})$"), "ddMMyyyy")
    df = df.withColumns({
        "Age": F.col("Age").try_cast("double"),
        "Skin_Phototype": F.col("Skin_Phototype").try_cast("int"),
        "Diameter_major_mm": C.decimal_comma("Diameter_major_mm"),
        "Diameter_minor_mm": F.col("Diameter_minor_mm").try_cast("double"),
        "diagnosis": C.strip("diagnosis"),
        "Date": date,
    })
    return df.withColumns({
        "Year": F.year("Date"),
        "Month": F.month("Date"),
        "Breslow_numeric": C.sentinel_number("Breslow_mm", "In situ"),
        "Area_approx_mm2": C.ellipse_area("Diameter_major_mm", "Diameter_minor_mm"),
        "Aspect_ratio": C.safe_ratio("Diameter_major_mm", "Diameter_minor_mm"),
    })


# --------------------------------------------------------------------- X9 ----

def evaluate_segmentation(target_runs: DataFrame, objects: DataFrame, probabilities: DataFrame, sizes: DataFrame,
                          threshold: float = 0.5):
    """Best predicted object of each image, resized to the target → per-image
    confusion → six metrics → (summary, long per-image table).  See ``best_masks`` for
    the inputs."""
    from ..operators import evaluate
    pred_runs = evaluate.best_masks(objects, probabilities, sizes, threshold)
    per_image = evaluate.metrics(evaluate.confusion(target_runs, pred_runs, sizes))
    return evaluate.summary(per_image), evaluate.long_scores(per_image)


def iou_types(has_masks: bool, has_keypoints: bool) -> list[str]:
    """V6: evaluation kinds for a model: box always, segm with masks, keypoints with keypoints."""
    kinds = ["bbox"]
    if has_masks:
        kinds.append("segm")
    if has_keypoints:
        kinds.append("keypoints")
    return kinds


def evaluate_detector(dets: DataFrame, gts: DataFrame, kinds: Sequence[str], det_runs: DataFrame | None = None,
                      gt_runs: DataFrame | None = None) -> DataFrame:
    """V6: the summary ``(kind, metric, value)`` of every kind in ``kinds`` (``iou_types``)."""
    from ..operators import cocoeval
    out = None
    for kind in kinds:
        one = cocoeval.evaluate(dets, gts, kind, det_runs, gt_runs).select(F.lit(kind).alias("kind"), "metric", "value")
        out = one if out is None else out.unionByName(one)
    return out


# ------------------------------------------------------------- X2 / X3 ----

from ..operators import masks as M  # noqa: E402
from ..operators import radiomics as RAD  # noqa: E402
from ..session import materialize  # noqa: E402
from ..sources import files as FS  # noqa: E402

FEATURE_MASK_THRESHOLD = 127


def feature_inputs(images: DataFrame, mask_images: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pair decoded images and masks by id and split off the error rows.

    Returns (pixels of good images, ROI pixels, errors(image_id, message)).
    Error rules: an unreadable image or mask; an all-zero mask; a mask whose
    values never pass the > 127 feature threshold (the source tests emptiness
    before thresholding, so such masks fail inside the extractor).
    """
    img_ok = images.where(F.col("image.height") >= 0).select("image_id")
    msk_ok = mask_images.where(F.col("image.height") >= 0).select("image_id")
    bad_img = images.where(F.col("image.height") < 0).select("image_id", F.lit("Could not read image").alias("message"))
    bad_msk = mask_images.where(F.col("image.height") < 0).select("image_id", F.lit("Could not read mask").alias("message"))
    mv = M.mask_values(mask_images, "image_id")
    stats = mv.groupBy("image_id").agg(F.max("value").alias("mx"))
    empty = stats.where(F.col("mx") == 0).select("image_id", F.lit("Empty mask (all zeros)").alias("message"))
    no_roi = stats.where((F.col("mx") > 0) & (F.col("mx") <= FEATURE_MASK_THRESHOLD)).select(
        "image_id", F.lit("Empty ROI after thresholding at 127").alias("message"))
    good = img_ok.join(msk_ok, "image_id").join(stats.where(F.col("mx") > FEATURE_MASK_THRESHOLD).select("image_id"),
                                               "image_id")
    px = M.pixels_from_images(images.join(good, "image_id", "left_semi"), "image_id")
    fg = M.foreground(mv.join(good, "image_id", "left_semi"), FEATURE_MASK_THRESHOLD)
    errors = bad_img.unionByName(bad_msk.join(img_ok, "image_id", "left_semi")).unionByName(
        empty.join(img_ok, "image_id", "left_semi")).unionByName(no_roi.join(img_ok, "image_id", "left_semi"))
    return px, fg, errors


#: Pairs that one batch decodes at most (about, batches are dealt by hash).
BATCH_IMAGES = 2000


def listed_files(spark, directory: str, path_col: str) -> DataFrame:
    """(image_id, path) of a folder's image files from its listing, one file per stem."""
    return FS.list_files(spark, directory).groupBy(F.col("id").alias("image_id")).agg(F.min("path").alias(path_col))


@contextmanager
def batch_features(spark, pairs: DataFrame):
    """(wide features or None, errors) of a bounded batch of ``pairs`` (image_id,
    image_path, mask_path).

    Only the files named there are decoded, and each once: the decoded batch is
    kept until the block ends.  A mask without an image (NULL path) is an error row.
    """
    found = pairs.where(F.col("image_path").isNotNull()).select("image_path", "mask_path").collect()
    missing = pairs.where(F.col("image_path").isNull()).select(
        "image_id", F.lit("Could not read image").alias("message"))
    if not found:
        yield None, missing
        return
    images = FS.read_images(spark, [r["image_path"] for r in found]).persist()
    mask_images = FS.read_images(spark, [r["mask_path"] for r in found]).persist()
    try:
        px, fg, errors = feature_inputs(images, mask_images)
        yield RAD.to_wide(RAD.all_features(px, fg), RAD_feature_columns()), errors.unionByName(missing)
    finally:
        images.unpersist()
        mask_images.unpersist()


def extract_features(spark, images_dir: str, masks_dir: str, out_path: str, errors_path: str,
                     batches: int = 1, batch_images: int = BATCH_IMAGES) -> dict:
    """Resumable feature extraction.

    Pairs masks and images by stem (J2) on the folder listings, skips ids already
    in ``out_path`` (J3, the output table is the checkpoint), computes the 408
    features (R0–R8) and appends them in hash batches of ids (A10; at least
    ``batches``, more where one would exceed ``batch_images``) together with the
    error side output (X2).  A rerun after a failure resumes where the output
    ends; a rerun after success adds no rows.  Errors are written before the
    features of their batch and an error that is already logged is not repeated,
    so a crash between the two loses none; an image that arrives late is taken
    by the next run.
    """
    done = FS.read_id_column_parquet(spark, out_path)
    pending = materialize(listed_files(spark, masks_dir, "mask_path")
                          .join(listed_files(spark, images_dir, "image_path"), "image_id", "left")
                          .join(done, "image_id", "left_anti"))
    batches = max(batches, -(-pending.count() // batch_images))
    logged = FS.read_errors(spark, errors_path)
    counts = {"features": 0, "errors": 0}
    for b in range(batches):
        pairs = pending.where(F.pmod(F.xxhash64("image_id"), F.lit(batches)) == b)
        with batch_features(spark, pairs) as (wide, errors):
            errors = materialize(errors.join(logged, ["image_id", "message"], "left_anti"))
            errors.write.mode("append").parquet(errors_path)
            counts["errors"] += errors.count()
            if wide is not None:
                wide = materialize(wide)
                wide.write.mode("append").parquet(out_path)
                counts["features"] += wide.count()
    return counts


def RAD_feature_columns() -> list[str]:
    from .q_radiomics import radiomics_feature_columns
    return radiomics_feature_columns()


# ----------------------------------------------------------------- X4 ----

def score_image_table(images: DataFrame, make_model, threshold: float = 0.5, batch_size: int = 16) -> DataFrame:
    """Batch scoring of an image table with a user-supplied model.

    ``make_model()`` runs once for each Python worker (it loads the weights) and gives a
    function from a list of images — arrays (height, width, channels), bytes as stored, sizes
    may differ — to a list with each image's first predicted soft mask (height, width), or
    None where nothing is detected.  Spark's batch inference hands it ``batch_size`` images
    at a time as bytes, so memory is bounded by the batch; the mask is cut at ``threshold`` and
    leaves the worker as runs.

    One row for every readable image: (image_id, height, width, detected, starts, lens); an
    image without a detection has no runs.
    """
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

    result = StructType([StructField("detected", IntegerType()), StructField("starts", ArrayType(LongType())),
                         StructField("lens", ArrayType(LongType()))])

    def make():
        import numpy as np

        model = make_model()

        def predict(height, width, channels, data):
            pictures = [np.frombuffer(d, dtype=np.uint8).reshape(h, w, c) for h, w, c, d in zip(height, width, channels, data, strict=True)]
            out = []
            for picture, soft in zip(pictures, model(pictures), strict=True):
                inside = np.zeros(picture.shape[:2], dtype=bool) if soft is None else np.asarray(soft) > threshold
                edge = np.flatnonzero(np.diff(np.concatenate(([0], inside.T.reshape(-1).view(np.int8), [0]))))
                out.append({"detected": int(soft is not None), "starts": edge[::2], "lens": edge[1::2] - edge[::2]})
            return out

        return predict

    score = predict_batch_udf(make, return_type=result, batch_size=batch_size)
    readable = images.where(F.col("image.height") >= 0)
    return readable.select(
        "image_id", F.col("image.height").alias("height"), F.col("image.width").alias("width"),
        score("image.height", "image.width", "image.nChannels", "image.data").alias("r")).select(
        "image_id", "height", "width", (F.col("r.detected") == 1).alias("detected"), "r.starts", "r.lens")


def scored_runs(scored: DataFrame) -> DataFrame:
    """The masks of ``score_image_table`` as runs."""
    return scored.select("image_id", F.lit(1).alias("obj_id"), "height", "width",
                         F.inline(F.arrays_zip(F.col("starts").alias("start"), F.col("lens").alias("len"))))


def score_images(images: DataFrame, predict_fn, threshold: float = 0.5) -> DataFrame:
    """X4 with a model of gray pixels: ``predict_fn(pdf) -> Series of probability arrays``
    gets a frame of (height, width, flat gray pixels) and returns the first predicted
    mask of each image (empty array when nothing is detected).  Returns the runs;
    ``score_image_table`` also keeps a row for images without a detection."""
    def make_model():
        import numpy as np
        import pandas as pd

        def gray(picture):
            if picture.shape[2] < 3:
                return picture[:, :, 0].reshape(-1).astype(np.int32)
            b, g, r = (picture[:, :, i].astype(np.int32) for i in range(3))
            return ((r * 299 + g * 587 + b * 114 + 500) // 1000).reshape(-1)

        def run(pictures):
            pdf = pd.DataFrame({"height": [p.shape[0] for p in pictures], "width": [p.shape[1] for p in pictures],
                                "pixels": [gray(p) for p in pictures]})
            found = predict_fn(pdf)
            return [None if f is None or len(f) == 0 else np.asarray(f, dtype=float).reshape(p.shape[:2])
                    for f, p in zip(found, pictures, strict=True)]

        return run

    return scored_runs(score_image_table(images, make_model, threshold))


# ------------------------------------------------------------- X7 / X8 ----

def mask_dataset_profile(sample_ids: DataFrame, sizes: DataFrame, mask_px: DataFrame) -> DataFrame:
    """For sampled images, dimensions, lesion area in px and % (mask > 0),
    with empty masks counted as area 0 (mask looked up by id, J5)."""
    runs = M.encode_runs(M.foreground(mask_px.join(sample_ids, "image_id", "left_semi"), 0), sizes)
    ar = M.areas(runs, per_object=False).select("image_id", "area")
    s = sizes.join(sample_ids, "image_id", "inner")
    return s.join(ar, "image_id", "left").select(
        "image_id", "width", "height", F.coalesce("area", F.lit(0)).cast("bigint").alias("area_px"),
        (F.coalesce("area", F.lit(0)) / (F.col("width") * F.col("height")) * 100).alias("area_pct"))


def mask_dataset_report(profile_rows: DataFrame) -> DataFrame:
    """Describe of the sampled images' dimensions and lesion areas, one row a
    measure, and a row ``empty_masks`` with their number."""
    from ..operators import profile
    measures = ["width", "height", "area_px", "area_pct"]
    long = profile_rows.select(F.stack(F.lit(len(measures)), *[
        x for c in measures for x in (F.lit(c), F.col(c).cast("double"))]).alias("measure", "value"))
    d = profile.describe(long, "value", ["measure"])
    empty = profile_rows.agg(F.lit("empty_masks").alias("measure"), F.count_if(F.col("area_px") == 0).alias("count"))
    return d.unionByName(empty, allowMissingColumns=True)
