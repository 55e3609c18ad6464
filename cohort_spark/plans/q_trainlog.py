"""Training-log queries (W2–W5, H8, X10, N9) on the event-stream stand-ins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import trainlog
from ..sources import standins
from .catalog import register

HIST_METRICS = ["train_loss", "val_dice", "val_iou", "val_precision", "val_recall", "val_specificity",
                "val_accuracy", "lr_history"]
PATIENCE = 8


def _smooth_sql(src: str, key: str, order: str, weight: str) -> str:
    return f"""
SELECT {key}, {order}, value,
  list_sort(list(value) OVER w20)[CAST(floor((len(list(value) OVER w20) - 1) / 2) AS INTEGER) + 1] AS median,
  avg(value) OVER w20 AS avg, max(value) OVER w20 AS max,
  sum(value * {weight}) OVER wall / sum({weight}) OVER wall AS global_avg
FROM {src}
WINDOW w20 AS (PARTITION BY {key} ORDER BY {order} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW),
       wall AS (PARTITION BY {key} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


@register("W2", _smooth_sql("train_log", "meter", "step", "n"), ("train_log",))
def q_w2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothed meters: median / mean / max over the last 20 values, last value, weighted global mean."""
    return trainlog.smoothed(standins.train_log(spark, sf_dir))


_LONG_SQL = " UNION ALL ".join(f"SELECT epochs, '{m}' AS meter, {m} AS value FROM history" for m in HIST_METRICS)


@register("W3", f"WITH h AS ({_LONG_SQL}) " + _smooth_sql("h", "meter", "epochs", "1"), ("history",))
def q_w3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many named meters per epoch, unpivoted and smoothed per meter."""
    long = trainlog.to_long(standins.history(spark, sf_dir), "epochs", HIST_METRICS)
    return trainlog.smoothed(long, order="epochs", weight=None)


@register("H8", _LONG_SQL, ("history",))
def q_h8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric curves by epoch: the history unpivoted to (epoch, metric, value)."""
    return trainlog.to_long(standins.history(spark, sf_dir), "epochs", HIST_METRICS)


_EARLY_SQL = f"""
WITH RECURSIVE h AS (SELECT epochs AS e, train_loss AS l, row_number() OVER (ORDER BY epochs) AS i FROM history),
s(i, e, l, improved, counter, best, stop) AS (
  SELECT i, e, l, true, 0, l, 0 >= {PATIENCE} FROM h WHERE i = 1
  UNION ALL
  SELECT h.i, h.e, h.l, (-h.l >= -s.best),
         CASE WHEN -h.l >= -s.best THEN 0 ELSE s.counter + 1 END,
         CASE WHEN -h.l >= -s.best THEN h.l ELSE s.best END,
         s.stop OR (CASE WHEN -h.l >= -s.best THEN 0 ELSE s.counter + 1 END) >= {PATIENCE}
  FROM s JOIN h ON h.i = s.i + 1)"""


@register("W4", _EARLY_SQL + """
SELECT e AS epochs, l AS train_loss, improved, CAST(counter AS INTEGER) AS counter, best AS best_loss, stop FROM s""",
          ("history",))
def q_w4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Early-stopping rule replayed per epoch (patience 8, delta 0, ties improve)."""
    return trainlog.early_stopping(standins.history(spark, sf_dir), patience=PATIENCE)


@register("W5", """
SELECT 'train_loss' AS metric, max(epochs) AS epochs, min(train_loss) AS value FROM history
WHERE train_loss = (SELECT min(train_loss) FROM history)
UNION ALL
SELECT 'val_dice', min(epochs), max(val_dice) FROM history WHERE val_dice = (SELECT max(val_dice) FROM history)
UNION ALL
SELECT 'val_iou', min(epochs), max(val_iou) FROM history WHERE val_iou = (SELECT max(val_iou) FROM history)""",
          ("history",))
def q_w5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best epochs: checkpoint epoch (last lowest loss) and first best Dice / IoU."""
    h = standins.history(spark, sf_dir)
    return (trainlog.best_epoch(h, "train_loss", mode="min", last_among_ties=True)
            .unionByName(trainlog.best_epoch(h, "val_dice"))
            .unionByName(trainlog.best_epoch(h, "val_iou")))


@register("X10", _EARLY_SQL + """
SELECT (SELECT max(e) FROM s WHERE l = (SELECT min(l) FROM s)) AS best_loss_epoch,
       (SELECT min(epochs) FROM history WHERE val_dice = (SELECT max(val_dice) FROM history)) AS best_dice_epoch,
       CAST((SELECT max(counter) FROM s) AS INTEGER) AS max_counter,
       (SELECT min(e) FROM s WHERE stop) AS stop_epoch,
       (SELECT count(*) FROM s) AS n_epochs""", ("history",))
def q_x10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training-log job summary: checkpoint epoch, best Dice epoch, early-stop counter and stop epoch."""
    h = standins.history(spark, sf_dir)
    es = trainlog.early_stopping(h, patience=PATIENCE)
    s = es.agg(F.max("counter").alias("max_counter"), F.min(F.when(F.col("stop"), F.col("epochs"))).alias("stop_epoch"),
               F.count(F.lit(1)).alias("n_epochs"))
    bl = trainlog.best_epoch(h, "train_loss", mode="min", last_among_ties=True).select("epochs").scalar()
    bd = trainlog.best_epoch(h, "val_dice").select("epochs").scalar()
    return s.select(bl.alias("best_loss_epoch"), bd.alias("best_dice_epoch"), "max_counter", "stop_epoch", "n_epochs")


@register("N9", """SELECT step, meter, n, CASE WHEN step % 50 = 0 THEN 'not a number' ELSE 'infinite' END AS kind
FROM train_log WHERE step % 50 = 0 OR step % 77 = 0""", ("train_log",))
def q_n9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-finite metric values (the reject table of the stop-on-NaN rule), of a log in which
    some steps diverged."""
    step = F.col("step")
    diverged = (F.when(step % 50 == 0, F.lit(float("nan"))).when(step % 154 == 0, F.lit(float("-inf")))
                .when(step % 77 == 0, F.lit(float("inf"))).otherwise(F.col("value")))
    bad = trainlog.non_finite(standins.train_log(spark, sf_dir).withColumn("value", diverged))
    return bad.select("step", "meter", "n", F.when(F.isnan("value"), F.lit("not a number")).otherwise(F.lit("infinite")).alias("kind"))
