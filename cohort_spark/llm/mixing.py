"""Mixing sources to target weights by hash order and distributed prefix sums.

Every document gets a hash-random key.  A narrow table (source, key, size; no texts) is
sorted by range on (source, key), so a source that holds a third of all rows spreads
over as many tasks as it needs, and written with the number of each part.  One aggregate
gives the words of each (part, source); running sums over that small table are the
offsets of the parts, and running sums inside a part finish the position of a
document.  Positions depend on the keys alone, not on the number of parts.  Each source
is cut at its exact budget: whole epochs first, then the part of the order that the
rest covers.

Sources stand in code-point order (null last) and take the given weights in
turn.  Null text and text without words have size 0 and are taken 0 words.
Repeated rows are separate documents.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import word_count, written

WEIGHTS = (3, 1, 2)
#: Share of all words the mix asks for, and most times a document is taken.
SHARE = 1.5
MOST = 2.0
#: Documents in a part of the sorted table.
PART_ROWS = 20_000


def targets(sizes: dict[str | None, int], weights: Sequence[float] = WEIGHTS,
            share: float = SHARE, most: float = MOST) -> dict[str | None, float]:
    """Words to take from each source: ``share`` of all words dealt by weight, no
    source above ``most`` times its size, the excess dealt again by weight."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(order)}
    out: dict[str | None, float] = {}
    left, open_ = share * sum(sizes.values()), list(order)
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * unit >= most * sizes[s]]
        if not full:
            out.update({s: weight[s] * unit for s in open_})
            break
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ = [s for s in open_ if s not in out]
        left = max(left, 0.0)
    return out


def _row_key(columns: Sequence[str]) -> Column:
    return F.xxhash64(*[F.col(f"`{c}`") for c in columns])


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17,
        row_columns: Sequence[str] = ()) -> DataFrame:
    """One row for each of ``docs``: __id, __row (hash of ``row_columns``; else of id, text and
    source), __size,
    __source_size, __target, __whole (epochs that take all of the source), __rest (words
    of the last epoch from here on; not above 0: none) and __taken (words).

    Only the table of sources (one row each) reaches the driver.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    row = _row_key(row_columns or (id_col, text_col, source_col))
    keyed = written(docs.select(
        F.col(id_col).alias("__id"), row.alias("__row"), word_count(F.col(text_col)).alias("__size"),
        F.coalesce(F.col(source_col), F.lit("")).alias("__s"), F.col(source_col).isNull().alias("__none"),
        F.xxhash64(F.lit(seed), F.col(id_col), F.crc32(text.cast("binary"))).alias("__key")), "mix-keys")
    parts = max(spark.sparkContext.defaultParallelism, -(-keyed.count() // PART_ROWS))
    order = ["__none", "__s", "__key", "__id", "__row"]
    # Written: the same rows stay in the same part when a task is run again.
    ranged = written(keyed.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), "mix-order")
    sums = written(ranged.groupBy("__none", "__s", "__part").agg(F.sum("__size").alias("__words")), "mix-sums")
    sizes = {(None if r["__none"] else r["__s"]): r["words"] for r in
             sums.groupBy("__none", "__s").agg(F.sum("__words").alias("words")).collect()}
    aim = targets(sizes, weights, share, most)
    plan = spark.createDataFrame(
        [(s is None, s or "", sizes[s], float(aim[s]), round(aim[s])) for s in sizes],
        "__none boolean, __s string, __source_size bigint, __target double, __budget bigint")
    ahead = Window.partitionBy("__none", "__s").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # Written, so that the rows meet it by part: partitioned by source as the running
    # sums leave it, it would draw all rows of a source into one task.
    starts = written(sums.withColumn("__start", F.coalesce(F.sum("__words").over(ahead), F.lit(0))).join(
        plan, ["__none", "__s"]).drop("__words"), "mix-starts")
    inside = (Window.partitionBy("__part", "__none", "__s").orderBy("__key", "__id", "__row")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    whole = F.expr("CASE WHEN __source_size > 0 THEN __budget div __source_size ELSE 0 END")
    return (ranged.join(starts, ["__part", "__none", "__s"])
            .withColumn("__before", F.col("__start") + F.sum("__size").over(inside) - F.col("__size"))
            .withColumn("__whole", whole)
            .withColumn("__rest", F.col("__budget") - F.col("__whole") * F.col("__source_size") - F.col("__before"))
            .withColumn("__taken", F.col("__size") * F.col("__whole")
                        + F.greatest(F.least(F.col("__rest"), F.col("__size")), F.lit(0)))
            .select("__id", "__row", "__size", "__source_size", "__target", "__whole", "__rest", "__taken"))


def decide(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    id_col = options.get("id_col", "doc_id")
    return mix(docs, **options).select(
        F.col("__id").alias(id_col), F.col("__size").alias("size"), F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"), F.col("__taken").alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of the mix, a document once for each epoch that takes it.

    Texts stay whole: the one document of a source at which the budget ends
    counts as taken if at least half of it fits.  A document without words goes
    with the epochs that reach its place.
    """
    id_col = options.get("id_col", "doc_id")
    columns = [f.name for f in docs.schema if "map<" not in f.dataType.simpleString()]  # maps have no hash
    reached = F.when(F.col("__size") > 0, F.col("__rest") * 2 >= F.col("__size")).otherwise(F.col("__rest") > 0)
    # Rows repeated whole share a key; what they are taken adds up.
    copies = written(mix(docs, row_columns=columns, **options).groupBy("__id", "__row").agg(
        F.sum(F.col("__whole") + reached.cast("long")).alias("__copies"), F.count(F.lit(1)).alias("__same"))
        .where("__copies > 0"), "mix-copies")
    keyed = docs.withColumn("__key", _row_key(columns))
    met = keyed.join(copies, (F.col("__key") == F.col("__row")) & F.col(id_col).eqNullSafe(F.col("__id")))
    every = met.where("__same = 1").unionByName(met.where("__same > 1").dropDuplicates(["__id", "__row"]))
    return (every.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))))
            .select(*docs.columns))
