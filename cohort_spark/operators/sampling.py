"""Seeded sampling, per-class sampling, exact-size splits and top-k.

Random draws are pure functions of the row key and a seed, so a retried task
or a rerun gives the same sample (``DataFrame.sample``/``randomSplit`` give
neither exact sizes nor key-stable draws).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .match import dense_index

MINSTD_P = 2147483647  # 2^31 - 1
MINSTD_A = 48271


def draw(key: Column | str, seed: int = 42, method: str = "xxhash") -> Column:
    """Deterministic pseudo-random draw per row.

    ``xxhash``: ``xxhash64(key, seed)`` for keys of any type (default).
    ``minstd``: two Lehmer steps on an integer key, ``((k + seed) mod p)·a mod p``
    applied twice; plain integer arithmetic any SQL engine reproduces.
    """
    k = F.col(key) if isinstance(key, str) else key
    if method == "xxhash":
        return F.xxhash64(k, F.lit(seed))
    if method == "minstd":
        x = F.pmod(k.cast("bigint") + F.lit(seed), F.lit(MINSTD_P))
        x = F.pmod(x * F.lit(MINSTD_A), F.lit(MINSTD_P))
        return F.pmod(x * F.lit(MINSTD_A), F.lit(MINSTD_P))
    raise ValueError(f"unknown draw method {method}")


def sample_n(df: DataFrame, n: int, order: Column, tie: str) -> DataFrame:
    """Exactly ``min(n, count)`` rows, reproducible: the ``n`` smallest draws.

    ``orderBy().limit(n)`` plans as TakeOrderedAndProject (per-partition top-n,
    then a merge of at most ``n × partitions`` rows).
    """
    return df.orderBy(order, F.col(tie)).limit(n)


def sample_per_group(df: DataFrame, group: str, n: int, order: Column, tie: str) -> DataFrame:
    """``n`` rows per group by draw.

    ``row_number() <= n`` is planned with a per-partition group limit before
    the shuffle, so a class holding a third of the rows ships only ``n`` rows
    per map partition.
    """
    w = Window.partitionBy(group).orderBy(order, F.col(tie))
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def split_sizes(total: int, train_frac: float = 0.7, val_share: float = 0.3333) -> tuple[int, int, int]:
    """Sizes of the 70 / ≈10 / ≈20 split: ``train=int(.7n)``, ``val=int(.3333·(n-train))``."""
    train = int(train_frac * total)
    temp = total - train
    val = int(val_share * temp)
    return train, val, temp - val


def exact_split(df: DataFrame, order: Column, tie: str, train_frac: float = 0.7,
                val_share: float = 0.3333) -> DataFrame:
    """Exact-size train/val/test split by rank of a seeded draw.

    The global rank comes from ``dense_index`` (range partitions + per-partition
    offsets), never from a single-partition window.  The cut points need the
    row count, taken from the ranked table's partition counts.
    """
    ranked = dense_index(df.withColumn("__draw", order), ["__draw", tie], "__rank", 0)
    # one number back to the driver: the row count (a partial/final count)
    total = ranked.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    train, val, _ = split_sizes(int(total), train_frac, val_share)
    split = (F.when(F.col("__rank") < train, F.lit("train"))
             .when(F.col("__rank") < train + val, F.lit("val"))
             .otherwise(F.lit("test")))
    return ranked.withColumn("split", split).drop("__draw", "__rank")


def split_by_group(df: DataFrame, group: str, seed: int = 42, train_frac: float = 0.7,
                   val_frac: float = 0.1) -> DataFrame:
    """Group-level split (e.g. by patient) so no group spans two splits:
    a hash of the group key in [0, 1) against the cumulative fractions."""
    u = F.pmod(F.xxhash64(F.col(group), F.lit(seed)), F.lit(1_000_000)) / 1_000_000.0
    split = (F.when(u < train_frac, F.lit("train"))
             .when(u < train_frac + val_frac, F.lit("val"))
             .otherwise(F.lit("test")))
    return df.withColumn("split", split)


def leak_free_split(df: DataFrame, id_col: str, links: Sequence[str], seed: int = 42, train_frac: float = 0.7,
                    val_share: float = 0.3333) -> DataFrame:
    """A split that no id of ``links`` spans, with sizes as near to ``split_sizes`` as whole
    groups allow.

    Rows that share ids, directly or by others, form groups (``groups.connected``).  Groups
    stand by size, largest first, then by a seeded draw; a group goes to the part in
    which its middle row falls.  So large groups fill train, and small ones
    meet the cuts closely.
    """
    from .groups import connected
    from .match import running_sums

    named = connected(df, id_col, links)
    sizes = named.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    one = sizes.withColumns({"__all": F.lit(0), "__draw": F.xxhash64("group", F.lit(seed))})
    placed = running_sums(one, ["__all"], [F.desc("n"), F.col("__draw"), F.col("group")], ["n"], with_totals=True)
    middle = F.col("cum_n") - F.col("n") / 2
    train = F.floor(F.lit(train_frac) * F.col("total_n"))
    val = F.floor(F.lit(val_share) * (F.col("total_n") - train))
    split = F.when(middle < train, F.lit("train")).when(middle < train + val, F.lit("val")).otherwise(F.lit("test"))
    parts = placed.select("group", split.alias("split"))
    return df.join(named, id_col).join(parts, "group").select(*df.columns, "group", "split")


def shared_ids(df: DataFrame, links: Sequence[str], split_col: str = "split") -> DataFrame:
    """(key, id, n_splits, n_images) of the ids of ``links`` that more than one part holds."""
    out = None
    for c in links:
        one = leak_check(df, c, split_col).select(F.lit(c).alias("key"), F.col(c).cast("string").alias("id"), "n_splits", "n_images")
        out = one if out is None else out.unionByName(one)
    return out


def leak_check(df: DataFrame, group: str, split_col: str = "split") -> DataFrame:
    """Groups present in more than one split."""
    return (df.where(F.col(group).isNotNull())
            .groupBy(group).agg(F.count_distinct(split_col).alias("n_splits"), F.count(F.lit(1)).alias("n_images"))
            .where(F.col("n_splits") > 1))


def top_k(df: DataFrame, k: int, by: Sequence[Column]) -> DataFrame:
    """Top-k rows (TakeOrderedAndProject)."""
    return df.orderBy(*by).limit(k)
