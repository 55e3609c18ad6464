"""Sharding by sampled splitters (native Spark), law ``bytes``.

Records are put in the order of a hash of their id and content, and the shards
are consecutive pieces of that order with nearly equal bytes:

1. A narrow table (key, row, id, size, crc) is written once.
2. A size-weighted sample of the keys (a row is drawn with a probability in
   proportion to its size, by a hash of its own, so reruns agree) gives quantile
   splitters.  The sample holds about ``SAMPLE`` keys whatever the input.
3. Rows are counted exactly by range; a range above ``MAX_ROWS`` is subdivided
   evenly by key, and one that a single repeated key overfills by row number.
4. One shuffle brings each piece together; prefix sums inside the pieces and over
   the small table of piece totals give the exact position in bytes, which
   decides the shard; the slot is the position within it.

Null text counts as no bytes; every row takes 8 bytes more.  Repeated rows and
equal ids are separate records.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SHARDS = 24
RANGES = 96
SAMPLE = 20_000
MAX_ROWS = 200_000


def splitters(rows: DataFrame, ranges: int = RANGES, sample: int = SAMPLE) -> list[int]:
    """``ranges - 1`` quantiles of a size-weighted sample of the keys (bounded:
    one array of numbers reaches the driver)."""
    total = rows.agg(F.sum("__size").alias("total"))
    draw = (F.pmod(F.xxhash64(F.lit("draw"), "__key", "__row"), F.lit(1 << 30)) / F.lit(float(1 << 30)))
    drawn = rows.where(draw * total.scalar() < F.col("__size") * F.lit(float(sample)))
    at = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    found = drawn.agg(F.percentile_approx("__key", at, 10_000).alias("cuts")).first()
    return sorted(set(found["cuts"] or []))


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text",
          ranges: int = RANGES, sample: int = SAMPLE, max_rows: int = MAX_ROWS) -> DataFrame:
    """id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = written(docs.select(
        F.col(id_col).alias("__id"), (F.octet_length(text) + F.lit(8)).cast("long").alias("__size"),
        F.crc32(text.cast("binary")).alias("__crc"), F.monotonically_increasing_id().alias("__row"))
        .withColumn("__key", F.xxhash64("__id", "__crc", "__size")), "shard-rows")
    cuts = splitters(rows, ranges, sample)
    low, high = -(1 << 63), (1 << 63) - 1
    bounds = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<bigint>")
    edges = [low, *cuts, high]
    # Range of a key: the number of splitters at or below it.
    ranged = rows.withColumn("__range", F.size(F.filter(bounds, lambda c: c <= F.col("__key"))))
    counts = ranged.groupBy("__range").agg(
        F.ceil(F.count(F.lit(1)) / F.lit(max_rows)).cast("long").alias("__parts"))
    lows = F.array(*[F.lit(float(c)) for c in edges[:-1]])
    spans = F.array(*[F.lit(max(float(b) - float(a), 1.0)) for a, b in zip(edges, edges[1:], strict=False)])
    place = (F.col("__key").cast("double") - F.get(lows, F.col("__range"))) / F.get(spans, F.col("__range"))
    # ``counts`` has at most ``ranges`` rows.
    parted = ranged.join(F.broadcast(counts), "__range").withColumn("__part", F.least(
        F.greatest(F.floor(place * F.col("__parts")), F.lit(0)), F.col("__parts") - 1).cast("long"))
    # Pieces that repeated keys still overfill: one row for each 2 * max_rows
    # records at most, and none as long as ids differ.
    over = parted.groupBy("__range", "__part").agg(F.count(F.lit(1)).alias("__rows")).where(
        F.col("__rows") > 2 * max_rows).select(
        "__range", "__part", F.ceil(F.col("__rows") / F.lit(max_rows)).cast("long").alias("__cuts"))
    parted = parted.join(over, ["__range", "__part"], "left").withColumn(
        "__tie", F.coalesce(F.pmod(F.xxhash64("__row"), F.col("__cuts")), F.lit(0)))
    return _positions(parted, shards, id_col)


def _positions(parted: DataFrame, shards: int, id_col: str) -> DataFrame:
    """Exact byte and row positions of the records, then shard and slot."""
    piece = ["__range", "__part", "__tie"]
    totals = parted.groupBy(*piece).agg(F.sum("__size").alias("__bytes"), F.count(F.lit(1)).alias("__rows"))
    # The table of pieces is small (a row for each max_rows records), so one
    # ordered window over it is enough.
    before = Window.orderBy(*piece).rowsBetween(Window.unboundedPreceding, -1)
    starts = written(totals.select(
        *piece, F.coalesce(F.sum("__bytes").over(before), F.lit(0)).alias("__byte0"),
        F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__row0"), "__bytes"), "shard-pieces")
    total = starts.agg(F.sum("__bytes").alias("total"))
    inside = Window.partitionBy(*piece).orderBy("__key", "__row")
    ahead = inside.rowsBetween(Window.unboundedPreceding, -1)
    placed = parted.join(starts.drop("__bytes"), piece).select(
        "__id", "__size", "__crc",
        (F.col("__byte0") + F.coalesce(F.sum("__size").over(ahead), F.lit(0))).alias("__at"),
        (F.col("__row0") + F.row_number().over(inside) - 1).alias("__index"))
    placed = written(placed.withColumn("__total", total.scalar()).select(
        "__id", "__size", "__crc", "__index",
        F.least(F.expr(f"__at * {shards} div __total"), F.lit(shards - 1)).cast("int").alias("__shard")), "shard-placed")
    first = placed.groupBy("__shard").agg(F.min("__index").alias("__first"))
    # ``first`` has one row for each shard.
    return placed.join(F.broadcast(first), "__shard").select(
        F.col("__id").alias(id_col), F.col("__size").alias("size"), F.col("__crc").alias("text_crc32"),
        F.lit("bytes").alias("law"), F.col("__shard").alias("shard"),
        (F.col("__index") - F.col("__first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
