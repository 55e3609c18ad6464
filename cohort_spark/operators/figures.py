"""Data behind the figures (H1–H8): histograms, densities, box statistics.

Only the tables are built; drawing stays in a notebook.  Each function
pre-aggregates rows to (group, value, count) before any join so the work after
the first shuffle is proportional to distinct values, not rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .profile import quantiles


def histogram(df: DataFrame, col: str, bins: int, keys: Sequence[str] = ()) -> DataFrame:
    """H1: equal-width bins over each group's own min..max (last bin closed),
    NULLs dropped, empty bins kept with count 0.  When min = max the range is
    widened by ±0.5 (numpy's rule).

    Output: keys…, bin, lo, hi, count.
    """
    keys = list(keys)
    v = F.col(col).cast("double")
    src = df.where(F.col(col).isNotNull()).select(*keys, v.alias("__x"))
    vc = src.groupBy(*keys, "__x").agg(F.count(F.lit(1)).alias("__c"))
    rng = vc.groupBy(*keys).agg(F.min("__x").alias("__mn0"), F.max("__x").alias("__mx0"))
    rng = rng.select(
        *keys,
        F.when(F.col("__mn0") == F.col("__mx0"), F.col("__mn0") - 0.5).otherwise(F.col("__mn0")).alias("__mn"),
        F.when(F.col("__mn0") == F.col("__mx0"), F.col("__mx0") + 0.5).otherwise(F.col("__mx0")).alias("__mx"),
    )
    # one row per (group, bin): bounded by bins × groups
    edges = rng.select(*keys, "__mn", "__mx", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    width = (F.col("__mx") - F.col("__mn")) / bins
    edges = edges.select(*keys, "bin", (F.col("__mn") + F.col("bin") * width).alias("lo"),
                         F.when(F.col("bin") == bins - 1, F.col("__mx"))
                         .otherwise(F.col("__mn") + (F.col("bin") + 1) * width).alias("hi"))
    if keys:
        j = vc.join(rng, keys, "inner")
    else:
        # the range is one row: attach it as a scalar subquery instead of a join
        r = rng.select(F.struct("__mn", "__mx").alias("__r")).scalar()
        j = vc.select("*", r["__mn"].alias("__mn"), r["__mx"].alias("__mx"))
    b = F.least(F.lit(bins - 1), F.floor((F.col("__x") - F.col("__mn")) / (F.col("__mx") - F.col("__mn")) * bins))
    counts = j.groupBy(*keys, b.cast("int").alias("bin")).agg(F.sum("__c").alias("count"))
    out = edges.join(counts, keys + ["bin"], "left").select(
        *keys, "bin", "lo", "hi", F.coalesce("count", F.lit(0)).cast("bigint").alias("count"))
    return out.orderBy(*keys, "bin")


def kde_grid(df: DataFrame, col: str, keys: Sequence[str], points: int = 200, cut: float = 3.0,
             bounded_groups: bool = False) -> DataFrame:
    """H2: Gaussian kernel density on a grid, per group.

    Scott's bandwidth ``h = sd_samp · n^(-1/5)``; the grid spans
    ``[min - cut·h, max + cut·h]`` with ``points`` points.  Values are first
    reduced to (group, x, weight).  The grid has ``points`` rows per group; when
    the caller has bounded the number of groups it is broadcast so the value
    side is never shuffled for the density sum, otherwise AQE chooses.
    """
    keys = list(keys)
    x = F.col(col).cast("double")
    src = df.where(F.col(col).isNotNull() & ~F.isnan(x)).select(*keys, x.alias("__x"))
    vc = src.groupBy(*keys, "__x").agg(F.count(F.lit(1)).alias("__w"))
    # count / sample sd / range are algebraic partial aggregates over the rows
    stats = src.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"), F.stddev_samp("__x").alias("__sd"),
        F.min("__x").alias("__mn"), F.max("__x").alias("__mx"),
    )
    stats = stats.select(*keys, "__n", "__mn", "__mx", (F.col("__sd") * F.pow(F.col("__n"), -0.2)).alias("__h"))
    lo = F.col("__mn") - cut * F.col("__h")
    hi = F.col("__mx") + cut * F.col("__h")
    grid = stats.select(*keys, "__n", "__h", lo.alias("__lo"), hi.alias("__hi"),
                        F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    grid = grid.select(*keys, "i", "__n", "__h",
                       (F.col("__lo") + (F.col("__hi") - F.col("__lo")) * F.col("i") / (points - 1)).alias("x"))
    if keys:
        j = vc.join(F.broadcast(grid) if bounded_groups else grid, keys, "inner")
    else:
        # one grid: its parameters are a scalar subquery and the points are
        # generated next to each value, so no join is needed
        st = stats.select(F.struct("__n", "__h", lo.alias("__lo"), hi.alias("__hi")).alias("__s")).scalar()
        j = vc.select("*", st["__n"].alias("__n"), st["__h"].alias("__h"),
                      F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
        j = j.withColumn("x", st["__lo"] + (st["__hi"] - st["__lo"]) * F.col("i") / (points - 1))
    z = (F.col("x") - F.col("__x")) / F.col("__h")
    dens = F.sum(F.col("__w") * F.exp(-0.5 * z * z)) / (F.first("__n") * F.first("__h") * math.sqrt(2 * math.pi))
    return j.groupBy(*keys, "i", "x").agg(dens.alias("density")).orderBy(*keys, "i")


def box_stats(df: DataFrame, col: str, keys: Sequence[str], whisker: float = 1.5) -> DataFrame:
    """H3/H4: quartiles, whiskers at the last data points inside
    ``[q1 - 1.5·IQR, q3 + 1.5·IQR]``, and the outlier count per group."""
    keys = list(keys)
    q = quantiles(df, keys, col, [0.25, 0.5, 0.75], "linear", ["q1", "median", "q3"])
    iqr = F.col("q3") - F.col("q1")
    fences = q.select(*keys, "q1", "median", "q3",
                      (F.col("q1") - whisker * iqr).alias("__lf"), (F.col("q3") + whisker * iqr).alias("__uf"))
    x = F.col(col).cast("double")
    vc = (df.where(F.col(col).isNotNull() & ~F.isnan(x)).select(*keys, x.alias("__x"))
          .groupBy(*keys, "__x").agg(F.count(F.lit(1)).alias("__c")))
    if keys:
        # fences: one row per group; joined on the group key (AQE broadcasts it when small)
        j = vc.join(fences, keys, "inner")
    else:
        f = fences.select(F.struct("q1", "median", "q3", "__lf", "__uf").alias("__f")).scalar()
        j = vc.select("*", *[f[c].alias(c) for c in ("q1", "median", "q3", "__lf", "__uf")])
    inside = (F.col("__x") >= F.col("__lf")) & (F.col("__x") <= F.col("__uf"))
    agg = j.groupBy(*keys).agg(
        F.first("q1").alias("q1"), F.first("median").alias("median"), F.first("q3").alias("q3"),
        F.min(F.when(inside, F.col("__x"))).alias("whisker_lo"),
        F.max(F.when(inside, F.col("__x"))).alias("whisker_hi"),
        F.coalesce(F.sum(F.when(~inside, F.col("__c"))), F.lit(0)).cast("bigint").alias("n_outliers"),
        F.sum("__c").cast("bigint").alias("n"),
    )
    return agg.orderBy(*keys) if keys else agg


def outliers(df: DataFrame, col: str, keys: Sequence[str], whisker: float = 1.5) -> DataFrame:
    """H3: the outlier rows themselves (outside the 1.5·IQR fences)."""
    keys = list(keys)
    q = quantiles(df, keys, col, [0.25, 0.75], "linear", ["q1", "q3"])
    iqr = F.col("q3") - F.col("q1")
    fences = q.select(*keys, (F.col("q1") - whisker * iqr).alias("__lf"), (F.col("q3") + whisker * iqr).alias("__uf"))
    x = F.col(col)
    return df.join(fences, keys, "inner").where((x < F.col("__lf")) | (x > F.col("__uf"))).drop("__lf", "__uf")


def long_history(history: DataFrame, id_col: str, metrics: Sequence[str]) -> DataFrame:
    """H8: metric curves by epoch: (epoch, metric, value)."""
    return history.unpivot([id_col], list(metrics), "metric", "value")
