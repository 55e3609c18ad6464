"""Exact dedup with a heavy-hitter split (native Spark).

1. Every text becomes the SHA-256 of its form with A-Z lower-cased; the narrow
   table (row, id, digest) is written once.
2. ``approx_top_k`` (the Misra-Gries family of frequent-item sketches, merged
   map side) names digests that may be frequent.  Its answer has at most
   ``TOP_K`` entries whatever the input, which bounds the broadcast.
3. An exact aggregate over the rows of these digests verifies them and finds
   their winners (the largest id); at most ``TOP_K`` rows are broadcast and
   decide the rows of frequent digests without a shuffle.
4. All other digests are shorter than the sketch's threshold and use an ordinary
   shuffle on the digest.

Null text counts as empty.  The row with the largest id stays; a null id is
smaller than any other.  Where whole rows repeat, one of them stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lower_ascii, written

#: Digests the sketch may name, and counters it holds.  A digest with more than
#: about rows / TRACKED copies is found; the broadcast has at most TOP_K rows.
TOP_K = 2000
TRACKED = 16384


def digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(__row, __id, __digest) of every row, written to the shared folder."""
    text = lower_ascii(F.coalesce(F.col(text_col), F.lit("")))
    return written(docs.select(
        F.monotonically_increasing_id().alias("__row"), F.col(id_col).alias("__id"),
        F.unhex(F.sha2(text, 256)).alias("__digest")), "digests")


def heavy_winners(rows: DataFrame, top_k: int = TOP_K, tracked: int = TRACKED) -> DataFrame:
    """Verified frequent digests: (__digest, __keep: struct(id, row), __n).

    The sketch only proposes; counts and winners are exact.
    """
    named = rows.select(F.expr(f"approx_top_k(hex(__digest), {top_k}, {tracked})").alias("top")).select(
        F.explode("top").alias("t")).where("t.count > 1").select(F.unhex("t.item").alias("__digest"))
    return written(rows.join(F.broadcast(named), "__digest").groupBy("__digest").agg(
        F.max(F.struct("__id", "__row")).alias("__keep"), F.count(F.lit(1)).alias("__n")), "heavy")


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           top_k: int = TOP_K, tracked: int = TRACKED) -> DataFrame:
    """One row for each input row: id, keep_id, group_size, kept, text_sha256.

    An empty input gives no rows; other columns of ``docs`` are not read.
    """
    rows = digests(docs, id_col, text_col)
    heavy = heavy_winners(rows, top_k, tracked)
    frequent = rows.join(F.broadcast(heavy), "__digest")
    others = rows.join(F.broadcast(heavy.select("__digest")), "__digest", "left_anti")
    same = Window.partitionBy("__digest")
    rest = others.select("*", F.max(F.struct("__id", "__row")).over(same).alias("__keep"),
                         F.count(F.lit(1)).over(same).alias("__n"))
    return frequent.unionByName(rest).select(
        F.col("__id").alias(id_col), F.col("__keep.__id").alias("keep_id"), F.col("__n").alias("group_size"),
        (F.col("__row") == F.col("__keep.__row")).alias("kept"),
        F.lower(F.hex("__digest")).alias("text_sha256"))


def keep_winners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 top_k: int = TOP_K, tracked: int = TRACKED) -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns."""
    columns = docs.columns
    heavy = heavy_winners(digests(docs, id_col, text_col), top_k, tracked)
    text = lower_ascii(F.coalesce(F.col(text_col), F.lit("")))
    marked = docs.withColumn("__digest", F.unhex(F.sha2(text, 256)))
    won = heavy.select("__digest", F.col("__keep.__id").alias("__keep_id"))
    # Losers of frequent digests go before any shuffle; only rows that repeat
    # the winner's id are left to compare.
    frequent = (marked.join(F.broadcast(won), "__digest")
                .where(F.col(id_col).eqNullSafe(F.col("__keep_id"))).drop("__keep_id"))
    others = marked.join(F.broadcast(won.select("__digest")), "__digest", "left_anti")
    rank = F.row_number().over(Window.partitionBy("__digest").orderBy(F.col(id_col).desc_nulls_last()))
    return (frequent.dropDuplicates(["__digest"]).select(*columns)
            .unionByName(others.withColumn("__rank", rank).where("__rank = 1").select(*columns)))
