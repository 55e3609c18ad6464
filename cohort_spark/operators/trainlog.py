"""Training-log analytics.

A metric log is a long table ``(step, meter, value, n)``; a history table has
one row per epoch.  Smoothing is a window per meter ordered by step; the
early-stopping rule is a fold over the (small, one row per epoch) history.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WINDOW_SIZE = 20
#: Consecutive rows of a meter that one window partition smooths.
BUCKET = 10_000


def smoothed(log: DataFrame, window: int = WINDOW_SIZE, key: str = "meter", order: str = "step",
             value: str = "value", weight: str | None = "n") -> DataFrame:
    """Per meter and step, statistics over the last ``window`` values:
    ``median`` (lower middle, as torch), ``avg``, ``max``, ``value`` (last), and
    ``global_avg = Σ value·n / Σ n`` over the whole history so far.

    Nothing is ordered inside one task per meter: ranks and running sums come
    from range partitions with offsets (``match.running_sums``), so a meter
    holding most of the log is still spread over all tasks.  Rows are then cut
    into buckets of ``BUCKET`` consecutive ranks; the last ``window - 1`` rows of a
    bucket also go to the next one as its halo, and a frame of ``window`` rows slides
    inside each bucket.
    """
    from .match import running_sums

    n = F.col(weight).cast("double") if weight else F.lit(1.0)
    base = log.select(key, order, F.col(value).cast("double").alias(value), n.alias("__w"),
                      (F.col(value).cast("double") * n).alias("__vw"), F.lit(1).cast("long").alias("__one"))
    ranked = running_sums(base, [key], [F.col(order)], ["__one", "__w", "__vw"])
    size = max(BUCKET, window)
    place = F.col("cum___one") - 1
    ranked = ranked.select(key, order, value, F.col("cum___one").alias("__rank"),
                           (F.col("cum___vw") / F.col("cum___w")).alias("global_avg"), (place / size).cast("long").alias("__b"))
    halo = ranked.where((F.col("__rank") - 1) % size >= size - window + 1).withColumn("__b", F.col("__b") + 1)
    both = ranked.withColumn("__own", F.lit(True)).unionByName(halo.withColumn("__own", F.lit(False)))
    frame = Window.partitionBy(key, "__b").orderBy("__rank").rowsBetween(1 - window, Window.currentRow)
    stats = both.select(
        key, order, value, "__own", "global_avg", F.sort_array(F.collect_list(value).over(frame)).alias("__vals"),
        F.avg(value).over(frame).alias("avg"), F.max(value).over(frame).alias("max"))
    return stats.where("__own").select(
        key, order, value, F.element_at("__vals", F.floor((F.size("__vals") - 1) / 2).cast("int") + 1).alias("median"),
        "avg", "max", "global_avg")


def to_long(wide: DataFrame, id_col: str, metrics: Sequence[str], key: str = "meter") -> DataFrame:
    """Many named meters per step → ``(id, meter, value)``."""
    return wide.unpivot([id_col], list(metrics), key, "value")


def early_stopping(history: DataFrame, loss: str = "train_loss", epoch: str = "epochs",
                   patience: int = 8, delta: float = 0.0, keys: Sequence[str] = ()) -> DataFrame:
    """The early-stopping rule replayed over the history (of each run, named by
    ``keys``).

    ``score = -loss``; an epoch improves when ``score >= best + delta`` (ties
    improve); otherwise the counter grows and the run stops when it reaches
    ``patience``.  ``best`` only moves on improvement.  Without ``delta`` the best is the
    smallest loss so far, so windows do; with it, which epochs improve depends on
    earlier ones, and each run's losses go through one linear pass.
    Output per epoch: improved, counter, best_loss, stop (first epoch that
    triggers the stop and every later one).
    """
    keys = list(keys)
    rows = history.select(*keys, F.col(epoch), F.col(loss).cast("double").alias(loss))
    so_far = Window.partitionBy(*keys).orderBy(epoch).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*keys).orderBy(epoch).rowsBetween(Window.unboundedPreceding, -1)
    if delta:
        rows = rows.groupBy(*keys).applyInPandas(
            lambda pdf: _improved(pdf.sort_values(epoch), loss, delta),
            ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", improved boolean")
    else:
        best = F.min(loss).over(before)
        rows = rows.withColumn("improved", best.isNull() | (F.col(loss) <= best))
    numbered = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(epoch)))
    last = F.last(F.when(F.col("improved"), F.struct("__n", F.col(loss).alias("l"))), ignorenulls=True).over(so_far)
    counted = numbered.withColumn("__last", last).withColumn("counter", (F.col("__n") - F.col("__last.__n")).cast("int"))
    return counted.select(*keys, epoch, loss, "improved", "counter", F.col("__last.l").alias("best_loss"),
                          (F.max("counter").over(so_far) >= patience).alias("stop"))


def _improved(pdf, loss: str, delta: float):
    """Which epochs improve on the last improvement by ``delta``."""
    best, out = None, []
    for value in pdf[loss]:
        out.append(best is None or -value >= -best + delta)
        best = value if out[-1] else best
    return pdf.assign(improved=out)


def best_epoch(history: DataFrame, metric: str, epoch: str = "epochs", mode: str = "max",
               last_among_ties: bool = False) -> DataFrame:
    """Epoch of the best value of ``metric`` (max or min); among ties the
    first epoch (``idxmax``) or, with ``last_among_ties``, the last one (the
    checkpoint kept by a rule where ties improve)."""
    v = F.col(metric) if mode == "max" else -F.col(metric)
    e = F.col(epoch) if last_among_ties else -F.col(epoch)
    b = history.agg(F.max_by(F.struct(F.col(epoch).alias("e"), F.col(metric).alias("v")), F.struct(v, e)).alias("b"))
    return b.select(F.lit(metric).alias("metric"), F.col("b.e").alias(epoch), F.col("b.v").alias("value"))


def non_finite(log: DataFrame, value: str = "value") -> DataFrame:
    """Rows whose value is NaN or ±inf (the run would stop on them)."""
    c = F.col(value)
    return log.where(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
