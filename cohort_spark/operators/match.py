"""Id-set reconciliation, pairing and lookup joins.

The source works with Python sets and dicts of file names; here each set is a
one-column DataFrame and each set operation is a join.  Joins are written
declaratively; Spark picks broadcast hash joins when the optimizer (or AQE at
run time) measures a side below the broadcast threshold and sort-merge joins
otherwise, so none of these grows a driver-side structure.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clean import file_stem, to_gib

KEPT, MISSING, UNUSED = "kept", "missing", "unused"


def listing_ids(listing: DataFrame, suffix_re: str | None = None) -> DataFrame:
    """(id, path, length) from a file listing; ``suffix_re`` strips a naming
    convention such as ``_segmentation`` from the stem (J5)."""
    stem = file_stem("path")
    if suffix_re:
        stem = F.regexp_replace(stem, suffix_re, "")
    return listing.select(stem.alias("id"), "path", "length")


def reconcile(selected: DataFrame, on_disk: DataFrame, key: str = "id") -> DataFrame:
    """Full outer join of selected ids with ids on disk → one row per id with
    ``status`` kept / missing (selected, not on disk) / unused (on disk only)."""
    s = selected.select(F.col(key).alias("__sid")).distinct()
    # One file for each id, the smallest, where two extensions share a stem.
    d = on_disk.groupBy(F.col(key).alias("__did")).agg(F.min("length").alias("length"))
    j = s.join(d, s["__sid"] == d["__did"], "full_outer")
    status = (F.when(F.col("__sid").isNotNull() & F.col("__did").isNotNull(), F.lit(KEPT))
              .when(F.col("__sid").isNotNull(), F.lit(MISSING))
              .otherwise(F.lit(UNUSED)))
    return j.select(F.coalesce("__sid", "__did").alias(key), status.alias("status"), F.col("length"))


def reconcile_summary(recon: DataFrame) -> DataFrame:
    """Count and bytes per status, bytes in GiB."""
    return recon.groupBy("status").agg(
        F.count(F.lit(1)).alias("n_files"),
        F.coalesce(F.sum("length"), F.lit(0)).cast("bigint").alias("bytes"),
    ).withColumn("gib", to_gib("bytes"))


def pair_by_stem(images: DataFrame, masks: DataFrame, mask_suffix_re: str = "") -> DataFrame:
    """Pair image and mask files by stem → (id, image_path, mask_path, status)
    with status matched / image_only / mask_only."""
    i = listing_ids(images).select(F.col("id").alias("__iid"), F.col("path").alias("image_path"))
    m = listing_ids(masks, mask_suffix_re or None).select(F.col("id").alias("__mid"), F.col("path").alias("mask_path"))
    j = i.join(m, i["__iid"] == m["__mid"], "full_outer")
    status = (F.when(F.col("__iid").isNotNull() & F.col("__mid").isNotNull(), F.lit("matched"))
              .when(F.col("__iid").isNotNull(), F.lit("image_only"))
              .otherwise(F.lit("mask_only")))
    return j.select(F.coalesce("__iid", "__mid").alias("id"), "image_path", "mask_path", status.alias("status"))


def pending(todo: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``todo`` whose key is not in ``done`` (resume)."""
    return todo.join(done.select(F.col(key).alias("__done")), F.col(key) == F.col("__done"), "left_anti")


def keep_existing(df: DataFrame, listing_keys: DataFrame, key: str, listing_key: str = "id") -> DataFrame:
    """Keep rows whose file exists (``~is_in(not_found)``) as a semi join.

    A NULL key never matches, exactly like a NULL id never being in the set of
    files on disk.
    """
    lk = listing_keys.select(F.col(listing_key).alias("__lk"))
    return df.join(lk, df[key] == lk["__lk"], "left_semi")


def with_fallback_dims(masks: DataFrame, images: DataFrame, key: str = "id") -> DataFrame:
    """width/height from the image when present, else from the mask."""
    im = images.select(F.col(key).alias("__k"), F.col("width").alias("__iw"), F.col("height").alias("__ih"))
    j = masks.join(im, masks[key] == im["__k"], "left")
    return j.withColumn("width", F.coalesce("__iw", "width")).withColumn(
        "height", F.coalesce("__ih", "height")).drop("__k", "__iw", "__ih")


def first_by_order(df: DataFrame, keys: Sequence[str], order: Column | str, columns: Sequence[str] | None = None) -> DataFrame:
    """Keep the first row per key in ``order`` (``drop_duplicates`` keep first,
    ``np.unique(return_index=True)``).  With ``columns`` only these are
    kept beside the keys: the aggregate sorts all that it carries.

    ``min_by`` over a struct of the row is a partial aggregate, so a key that
    holds a large share of the rows is reduced before the shuffle instead of
    being sorted in one task.
    """
    o = F.col(order) if isinstance(order, str) else order
    rest = [c for c in (df.columns if columns is None else columns) if c not in keys]
    g = df.groupBy(*keys).agg(F.min_by(F.struct(*[F.col(c) for c in rest]), o).alias("__row"))
    return g.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest])


def merge_shards(*shards: DataFrame, key: str = "image_id") -> DataFrame:
    """Union of result shards, first occurrence of each key by shard order."""
    tagged = [s.withColumn("__shard", F.lit(i)) for i, s in enumerate(shards)]
    u = tagged[0]
    for t in tagged[1:]:
        u = u.unionByName(t)
    return first_by_order(u, [key], "__shard").drop("__shard")


def with_object_counts(images: DataFrame, objects: DataFrame, key: str = "image_id") -> DataFrame:
    """Images with the number of their objects (0 when none).

    Counting first (partial aggregate) keeps the one-to-many side from
    ever being gathered per image.
    """
    counts = objects.groupBy(key).agg(F.count(F.lit(1)).alias("n_objects"))
    return images.join(counts, key, "left").withColumn("n_objects", F.coalesce("n_objects", F.lit(0)))


def with_objects(images: DataFrame, objects: DataFrame, columns: Sequence[str], key: str = "image_id",
                 order: str = "obj_id") -> DataFrame:
    """Images with the list of their objects as structs of ``columns`` (first
    ``order``), empty when there is none.  A list is bounded by the objects of one image."""
    fields = [order, *[c for c in columns if c != order]]
    lists = objects.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("objects"))
    empty = F.array().cast(lists.schema["objects"].dataType)
    return images.join(lists, key, "left").withColumn("objects", F.coalesce("objects", empty))


def sorted_distinct(df: DataFrame, col: str) -> DataFrame:
    """J11."""
    return df.where(F.col(col).isNotNull()).select(col).distinct().orderBy(col)


#: Input bytes that one range of an ordering covers, and the size of an input that is not known.
RANGE_BYTES, UNKNOWN_BYTES = 128 << 20, 1 << 50


def range_partitions(df: DataFrame) -> int:
    """Ranges for an ordering of ``df``: as many as its input files call for, and no fewer
    than ``spark.sql.shuffle.partitions`` (the adaptive planner does not split ranges)."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    total = sum(s for s in sizes if s < UNKNOWN_BYTES)
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE_BYTES))


def dense_index(df: DataFrame, order: Sequence[str], name: str = "id", start: int = 0,
                partitions: int | None = None) -> DataFrame:
    """Consecutive ids in ``order`` (unique) without a single-partition window.

    Range-partition on the order columns, tag each row with its partition,
    write that to the shared checkpoint folder so retries see the same
    partitions, count rows per partition (one row per partition), turn the
    counts into offsets, and number rows inside each partition.
    """
    from ..session import materialize

    n = partitions or range_partitions(df)
    ranged = materialize(df.repartitionByRange(n, *order).withColumn("__pid", F.spark_partition_id()))
    counts = ranged.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    offsets = counts.select(
        "__pid",
        (F.sum("__n").over(Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1))).alias("__off"),
    ).fillna(0, ["__off"])
    # one row per partition: a bounded table, broadcasting it is safe
    w = Window.partitionBy("__pid").orderBy(*order)
    return (ranged.join(F.broadcast(offsets), "__pid")
            .withColumn(name, F.row_number().over(w) + F.col("__off") - 1 + start)
            .drop("__pid", "__off"))


def running_sums(df: DataFrame, keys: Sequence[str], order: Sequence[Column], values: Sequence[str],
                 partitions: int | None = None, with_totals: bool = False) -> DataFrame:
    """Cumulative sums of ``values`` per key in ``order`` that stay parallel when
    one key holds a large share of the rows.

    Rows are range-partitioned on (keys, order) and written to the shared
    checkpoint folder (so retries see the same partitions); per (partition,
    key) totals — one row each — become offsets through a window over that
    small table; each partition then sums only its own rows.  Output columns
    ``cum_<value>`` are inclusive running sums; ``with_totals`` adds
    ``total_<value>``, the sum over the key, from the same small table.
    """
    from ..session import materialize

    keys = list(keys)
    n = partitions or range_partitions(df)
    sort_cols = [F.col(k) for k in keys] + list(order)
    ranged = materialize(df.repartitionByRange(n, *sort_cols).withColumn("__pid", F.spark_partition_id()))
    totals = ranged.groupBy(*keys, "__pid").agg(*[F.sum(v).alias(f"__t_{v}") for v in values])
    w_small = Window.partitionBy(*keys).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    w_key = Window.partitionBy(*keys)
    offsets = totals.select(
        *[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__pid").alias("__p"),
        *[F.coalesce(F.sum(f"__t_{v}").over(w_small), F.lit(0)).alias(f"__o_{v}") for v in values],
        *[F.sum(f"__t_{v}").over(w_key).alias(f"total_{v}") for v in values])
    w = Window.partitionBy("__pid", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    same = F.col("__pid") == F.col("__p")
    for k in keys:  # a NULL key is a group like any other
        same &= F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    j = ranged.join(offsets, same)
    return j.select(*[c for c in ranged.columns if c != "__pid"],
                    *[(F.sum(v).over(w) + F.col(f"__o_{v}")).alias(f"cum_{v}") for v in values],
                    *([F.col(f"total_{v}") for v in values] if with_totals else []))
