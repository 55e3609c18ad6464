"""Incremental feature extraction (X3, streaming variant).

New masks and images arriving in their folders are picked up by file-source
Structured Streaming (``binaryFile`` listings, contents not read).  Each micro-batch
is bounded by ``maxFilesPerTrigger`` of either folder; ``foreachBatch`` notes the new
files in a table of arrivals beside the output, pairs their ids there (neither folder is
listed again; an image that has not arrived yet is looked up by its possible names),
computes the features that the output does not have yet and appends them, keyed by the micro-batch id so a replayed batch after
a failure overwrites its own folder instead of duplicating rows.  An image that lands
after its mask (an error row by then) is a new file itself, so its features are
computed when it arrives.  A file replaced in place is not offered again; the batch
job retries such images.  The streaming checkpoint lives in the shared
checkpoint folder (or a location the caller passes).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.clean import file_stem, has_suffix
from ..session import materialize
from ..sources import files as FS

LISTING_SCHEMA = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("modificationTime", T.TimestampType()),
    T.StructField("length", T.LongType()),
    T.StructField("content", T.BinaryType()),
])


def arrivals_path(out_path: str) -> str:
    """The table of arrivals of an output."""
    return out_path.rstrip("/") + "-arrivals"


def _find(spark: SparkSession, directory: str, ids: list[str]) -> list[tuple[str, str]]:
    """(image_id, path) of the ids that have a file of an image extension, in lower or upper case."""
    jvm = spark._jvm
    base = jvm.org.apache.hadoop.fs.Path(directory)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    out = []
    for name in ids:
        for ext in (e for x in FS.IMAGE_EXTS for e in (x.lower(), x.upper())):
            path = jvm.org.apache.hadoop.fs.Path(base, name + ext)
            if fs.exists(path):
                out.append((name, fs.makeQualified(path).toString()))
                break
    return out


def _process_batch(spark: SparkSession, batch: DataFrame, batch_id: int, masks_dir: str, images_dir: str,
                   out_path: str, errors_path: str) -> None:
    from ..plans.jobs import batch_features

    new = batch.where(has_suffix("path", FS.IMAGE_EXTS)).select("kind", file_stem("path").alias("image_id"), "path")
    new.write.mode("overwrite").parquet(os.path.join(arrivals_path(out_path), f"batch={batch_id}"))
    ids = spark.read.parquet(os.path.join(arrivals_path(out_path), f"batch={batch_id}")).select("image_id").distinct()
    # a replayed batch must not take its own output for done
    earlier = F.col("batch") != batch_id
    done = FS.read_batches(spark, out_path, "image_id string").where(earlier)
    seen = FS.read_batches(spark, arrivals_path(out_path), "kind string, image_id string, path string").join(ids, "image_id", "left_semi")
    # bounded by maxFilesPerTrigger; only the files of this batch's ids are decoded
    known = materialize(seen.groupBy("image_id").agg(*[F.min(F.when(F.col("kind") == k, F.col("path"))).alias(f"{k}_path") for k in ("mask", "image")])
                        .where("mask_path IS NOT NULL").join(done, "image_id", "left_anti"))
    missing = [r["image_id"] for r in known.where("image_path IS NULL").select("image_id").collect()]
    found = spark.createDataFrame(_find(spark, images_dir, missing), "image_id string, found string")
    pairs = known.join(found, "image_id", "left").select("image_id", "mask_path", F.coalesce("image_path", "found").alias("image_path"))
    logged = FS.read_batches(spark, errors_path, "image_id string, message string").where(earlier)
    with batch_features(spark, pairs) as (wide, errors):
        errors = materialize(errors.join(logged, ["image_id", "message"], "left_anti"))
        errors.write.mode("overwrite").parquet(os.path.join(errors_path, f"batch={batch_id}"))
        if wide is not None:
            wide.write.mode("overwrite").parquet(os.path.join(out_path, f"batch={batch_id}"))


def start(spark: SparkSession, masks_dir: str, images_dir: str, out_path: str, errors_path: str,
          checkpoint: str, max_files: int = 100, available_now: bool = True):
    """Start the incremental extraction; returns the StreamingQuery.

    ``available_now`` processes everything present and stops (a resumable batch
    run); otherwise the query keeps watching the folder.  ``checkpoint`` is a fixed
    shared folder: a restarted stream goes on where it stopped.  (A checkpoint without
    a table of arrivals beside the output cannot be continued; begin a new one and new
    output folders.)
    """
    def arrivals(directory: str, kind: str) -> DataFrame:
        return (spark.readStream.format("binaryFile").schema(LISTING_SCHEMA)
                .option("maxFilesPerTrigger", max_files).load(directory).select("path", F.lit(kind).alias("kind")))

    writer = (arrivals(masks_dir, "mask").unionByName(arrivals(images_dir, "image")).writeStream
              .foreachBatch(lambda df, bid: _process_batch(spark, df, bid, masks_dir, images_dir, out_path, errors_path))
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
