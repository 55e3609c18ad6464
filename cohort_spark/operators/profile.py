"""Profiling operators: null reports, value counts, grouped statistics, pivots.

Rows N1–N9, G1–G30 and W1 of the inventory.  Every function takes and returns
DataFrames.  Aggregates are partial/final hash aggregates (a hot key is
pre-aggregated on the map side before the shuffle); pivots take an explicit
value list whenever the caller knows it, otherwise one distinct pass over the
pivot column is made (it only returns the distinct values, never rows).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.clean import is_missing

def _numeric_cols(df: DataFrame) -> set[str]:
    return {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}


# ----------------------------------------------------------------- nulls ----

def null_counts(df: DataFrame, cols: Sequence[str] | None = None, nan_as_null: bool = False) -> DataFrame:
    """One row, one BIGINT column per input column with its null count."""
    cols = list(cols or df.columns)
    floats = _numeric_cols(df) if nan_as_null else set()
    return df.agg(*[
        F.count_if(is_missing(c, c in floats)).cast("bigint").alias(c) for c in cols
    ])


def completeness(df: DataFrame, cols: Sequence[str] | None = None, digits: int = 1) -> DataFrame:
    """Per column nulls, % missing, % complete; keep > 0; sort by % missing desc.

    One aggregate pass, then a one-row unpivot (no second scan).
    """
    cols = list(cols or df.columns)
    total = F.count(F.lit(1)).alias("__n")
    counts = df.agg(total, *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    long = counts.unpivot(["__n"], cols, "column_name", "n_missing")
    pct = F.bround(F.col("n_missing") / F.col("__n") * 100, digits)
    return (
        long.where(F.col("n_missing") > 0)
        .select(
            "column_name",
            F.col("n_missing").cast("bigint").alias("n_missing"),
            pct.alias("pct_missing"),
            (F.lit(100.0) - pct).alias("pct_complete"),
        )
        .orderBy(F.desc("pct_missing"), "column_name")
    )


def missing_overview(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Number of columns with any missing value and rows with any missing value
    (NULL or NaN for floating columns)."""
    cols = list(cols or df.columns)
    floats = _numeric_cols(df)
    flags = [is_missing(c, c in floats) for c in cols]
    any_row = flags[0]
    for f in flags[1:]:
        any_row = any_row | f
    agg = df.agg(
        *[F.max(f.cast("int")).alias(f"__c{i}") for i, f in enumerate(flags)],
        F.count_if(any_row).cast("bigint").alias("rows_with_missing"),
    )
    n_cols = sum((F.coalesce(F.col(f"__c{i}"), F.lit(0)) for i in range(len(flags))), F.lit(0))
    return agg.select(n_cols.cast("bigint").alias("columns_with_missing"), "rows_with_missing")


def non_finite_rows(df: DataFrame, col: str) -> DataFrame:
    """Rows whose metric is NaN or ±inf (the reject table)."""
    c = F.col(col)
    return df.where(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))


# --------------------------------------------------------- value counts ----

def value_counts(df: DataFrame, col: str, dropna: bool = True, by: str = "count") -> DataFrame:
    """Counts per value.  ``by='count'`` sorts by count desc then value,
    ``by='value'`` by value.  ``dropna=False`` keeps NULL as a category."""
    src = df.where(F.col(col).isNotNull()) if dropna else df
    out = src.groupBy(col).agg(F.count(F.lit(1)).alias("count"))
    return out.orderBy(F.desc("count"), F.asc_nulls_last(col)) if by == "count" else out.orderBy(F.asc_nulls_last(col))


def share_of_total(df: DataFrame, col: str, digits: int = 2) -> DataFrame:
    """Count and percentage of all non-null rows per value.

    The grand total is a scalar subquery, so no task sees all values.
    """
    known = df.where(F.col(col).isNotNull())
    vc = known.groupBy(col).agg(F.count(F.lit(1)).alias("count"))
    total = known.agg(F.count(F.lit(1))).scalar()
    return vc.select(col, "count", F.bround(F.col("count") / total * 100, digits).alias("pct"))


def group_sizes(df: DataFrame, keys: Sequence[str], name: str = "count", dropna: bool = True) -> DataFrame:
    """Rows per key combination (``group_by().len()``)."""
    src = df.na.drop(subset=list(keys)) if dropna else df
    return src.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def n_unique(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Exact distinct count per column, nulls excluded."""
    return df.agg(*[F.count_distinct(c).alias(f"n_unique_{c}") for c in cols])


def ratio_guarded(n: Column, d: Column) -> Column:
    """``n / max(d, 1)``."""
    return n / F.greatest(d, F.lit(1))


# ------------------------------------------------------------ quantiles ----

def quantiles(df: DataFrame, keys: Sequence[str], col: str, probs: Sequence[float],
              method: str = "linear", names: Sequence[str] | None = None, weight: str | None = None) -> DataFrame:
    """Exact quantiles per group without gathering a group.

    ``linear`` is numpy/pandas interpolation; ``nearest`` picks the element at
    index ``round_half_away((n-1)·q)`` (polars); ``lower`` the element at
    ``floor((n-1)·q)`` (torch median).  Values are reduced to (key, value,
    count) by a partial aggregate; cumulative counts come from range
    partitions with offsets (``match.running_sums``), so a group holding a
    third of the rows is still spread over all tasks; each distinct value then
    emits the quantile positions it covers and one aggregate per group
    assembles the result.  No join and no single-task ordering.
    """
    from .match import running_sums

    keys = list(keys)
    names = list(names or [f"q{int(round(p * 100))}" for p in probs])
    cnt = F.sum(weight) if weight else F.count(F.lit(1))
    vc = df.where(F.col(col).isNotNull() & ~F.isnan(F.col(col))) \
        .groupBy(*keys, col).agg(cnt.cast("long").alias("__c"))
    ranked = running_sums(vc, keys, [F.col(col)], ["__c"], with_totals=bool(keys))
    if keys:
        n = F.col("total___c")
    else:
        n = vc.agg(F.sum("__c")).scalar()
    lo, hi = F.col("cum___c") - F.col("__c"), F.col("cum___c")
    recs = []
    for i, p in enumerate(probs):
        h = (n - 1) * F.lit(float(p))
        if method == "linear":
            li, ui = F.floor(h), F.ceil(h)
        elif method == "nearest":
            li = F.floor(h + 0.5)
            ui = li
        elif method == "lower":
            li = F.floor(h)
            ui = li
        else:
            raise ValueError(f"unknown quantile method {method}")
        for side, idx in ((0, li), (1, ui)):
            rec = F.struct(F.lit(i).alias("k"), F.lit(side).alias("side"), F.col(col).cast("double").alias("v"),
                           h.cast("double").alias("h"), li.cast("double").alias("li"))
            recs.append(F.when((lo <= idx) & (idx < hi), rec))
    e = ranked.select(*keys, F.explode(F.array(*recs)).alias("e")).where(F.col("e").isNotNull())

    def pick(i: int, side: int | None, field: str):
        cond = F.col("e.k") == i if side is None else (F.col("e.k") == i) & (F.col("e.side") == side)
        return F.max(F.when(cond, F.col(f"e.{field}")))

    aggs = []
    for i, name in enumerate(names):
        vlo, vhi = pick(i, 0, "v"), pick(i, 1, "v")
        aggs.append((vlo + (pick(i, None, "h") - pick(i, None, "li")) * (vhi - vlo)).alias(name))
    return e.groupBy(*keys).agg(*aggs)


def describe(df: DataFrame, col: str, keys: Sequence[str] = (), flavour: str = "pandas",
             percentiles: Sequence[float] = (0.25, 0.5, 0.75), digits: int | None = None,
             pct_names: Sequence[str] | None = None) -> DataFrame:
    """Count, mean, std (ddof 1), min, percentiles, max per group.

    ``flavour='polars'`` adds ``null_count`` and uses nearest-rank quantiles;
    ``'pandas'`` uses linear interpolation.  ``digits`` applies half-even
    rounding like ``.round(n)``.
    """
    keys = list(keys)
    c = F.col(col)
    valid = c.isNotNull() & ~F.isnan(c)
    aggs = [F.count_if(valid).cast("bigint").alias("count")]
    if flavour == "polars":
        aggs.append(F.count_if(~valid).cast("bigint").alias("null_count"))
    aggs += [
        F.avg(F.when(valid, c)).alias("mean"),
        F.stddev_samp(F.when(valid, c)).alias("std"),
        F.min(F.when(valid, c)).cast("double").alias("min"),
        F.max(F.when(valid, c)).cast("double").alias("max"),
    ]
    names = list(pct_names or [f"p{int(round(p * 100))}" for p in percentiles])
    q = quantiles(df, keys, col, percentiles, "nearest" if flavour == "polars" else "linear", names)
    if not keys:
        # one-row statistics: the quantiles enter as one scalar subquery (a struct)
        qs = q.select(F.struct(*names).alias("__q")).scalar()
        out = df.agg(*aggs).select("*", *[qs[n].alias(n) for n in names])
    else:
        base = df.groupBy(*keys).agg(*aggs)
        out = base.join(q, [base[k].eqNullSafe(q[k]) for k in keys], "left").select(
            *[base[k] for k in keys], *[c for c in base.columns if c not in keys], *names)
    order = keys + ["count"] + (["null_count"] if flavour == "polars" else []) + ["mean", "std", "min"] + names + ["max"]
    out = out.select(*order)
    if digits is not None:
        out = out.select(*[F.bround(F.col(x), digits).alias(x) if x not in keys and x not in ("count", "null_count") else F.col(x)
                           for x in order])
    return out


def describe_many(df: DataFrame, key: str, cols: Sequence[str], digits: int = 2) -> DataFrame:
    """Grouped describe over several columns → long (key, metric, stats…)."""
    long = df.select(key, F.stack(F.lit(len(cols)), *[x for c in cols for x in (F.lit(c), F.col(c).cast("double"))])
                     .alias("metric", "__value"))
    return describe(long, "__value", [key, "metric"], "pandas", digits=digits)


# ------------------------------------------------------- first / argmax ----

def first_non_null(df: DataFrame, keys: Sequence[str], col: str, order: str | Column) -> DataFrame:
    """First non-null value of ``col`` per group in file order.

    ``min_by`` is a partial aggregate: a hot group is reduced on the map side.
    """
    o = F.col(order) if isinstance(order, str) else order
    return df.where(F.col(col).isNotNull()).groupBy(*keys).agg(F.min_by(F.col(col), o).alias(col))


def argmax_count(counts: DataFrame, key: str, value: str = "count") -> DataFrame:
    """The key with the largest value; among ties the smallest key.

    A top-1 ``orderBy().limit(1)`` plans as TakeOrderedAndProject: each
    partition keeps its best row, so nothing is sorted globally.
    """
    return counts.orderBy(F.desc(value), F.asc(key)).limit(1).select(key, value)


def rowwise_argmax(df: DataFrame, cols: Sequence[str], out: str, strip_prefix: str = "") -> Column:
    """Name of the largest column per row (first column wins ties), with an
    optional literal prefix removed from the name (S2)."""
    best = F.greatest(*[F.col(c) for c in cols])
    expr = None
    for c in cols:
        name = c[len(strip_prefix):] if strip_prefix and c.startswith(strip_prefix) else c
        expr = F.when(F.col(c) == best, F.lit(name)) if expr is None else expr.when(F.col(c) == best, F.lit(name))
    return expr.alias(out)


# ------------------------------------------------------------- matrices ----

#: Most columns of a matrix; more values are for the long form.
MAX_HEADER = 5000


def distinct_values(df: DataFrame, col: str) -> list:
    """Sorted distinct non-null values for a pivot header: one value for each column
    of the caller's result.  Over ``MAX_HEADER`` values are an error, as no plan holds so many
    columns; ``count_long`` gives the same counts as rows."""
    found = [r[0] for r in df.where(F.col(col).isNotNull()).select(col).distinct().limit(MAX_HEADER + 1).collect()]
    if len(found) > MAX_HEADER:
        raise ValueError(f"column {col} has over {MAX_HEADER} values; use count_long")
    return sorted(found)


def count_long(df: DataFrame, row: str, col: str) -> DataFrame:
    """The counts of ``count_matrix`` and the shares of ``percent_matrix`` as rows (row, col,
    count, pct), without a header and so for any number of values; zero cells are left out."""
    counts = df.where(F.col(row).isNotNull() & F.col(col).isNotNull()).groupBy(row, col).agg(F.count(F.lit(1)).alias("count"))
    total = counts.groupBy(row).agg(F.sum("count").alias("__total"))
    return counts.join(total, row).select(row, col, "count", (F.col("count") / F.col("__total") * 100).alias("pct"))


def share_within_group(df: DataFrame, group: str, value: str, out: str = "pct") -> DataFrame:
    """``value / sum(value) over group * 100`` keeping every row."""
    return df.withColumn(out, F.col(value) / F.sum(value).over(Window.partitionBy(group)) * 100)


def _matrix(df: DataFrame, row: str, col: str, values: Sequence | None, both_non_null: bool = True) -> DataFrame:
    """The count matrix and ``__total``, the row's count over all values of ``col``,
    listed in ``values`` or not."""
    src = df.where(F.col(row).isNotNull() & F.col(col).isNotNull()) if both_non_null else df
    values = list(values) if values is not None else distinct_values(src, col)
    counts = src.groupBy(row, col).agg(F.count(F.lit(1)).alias("__n"))
    cells = [F.coalesce(F.sum(F.when(F.col(col) == F.lit(v), F.col("__n"))), F.lit(0)).cast("bigint").alias(str(v))
             for v in values]
    return counts.groupBy(row).agg(*cells, F.sum("__n").cast("bigint").alias("__total"))


def count_matrix(df: DataFrame, row: str, col: str, values: Sequence | None = None,
                 both_non_null: bool = True) -> DataFrame:
    """Two-key count matrix, zero filled (``unstack(fill_value=0)``/crosstab).

    Counting happens before the reshaping (partial aggregate on (row, col)).  Without
    ``values`` every value found is a column.
    """
    return _matrix(df, row, col, values, both_non_null).drop("__total")


def percent_matrix(df: DataFrame, row: str, col: str, values: Sequence | None = None,
                   digits: int | None = None) -> DataFrame:
    """Percentage of each column value within its row (of all the row's
    values, also where ``values`` lists only some), zero filled."""
    m = _matrix(df, row, col, values)
    vals = [c for c in m.columns if c not in (row, "__total")]
    cells = [(F.col(f"`{v}`") / F.col("__total") * 100) for v in vals]
    if digits is not None:
        cells = [F.bround(c, digits) for c in cells]
    return m.select(row, *[c.alias(v) for c, v in zip(cells, vals)])


def matrix_with_rate(df: DataFrame, row: str, col: str, positive: str, values: Sequence | None = None,
                     digits: int = 1) -> DataFrame:
    """Count matrix + Total (over all values) + % of ``positive`` (0 where it does
    not occur), sorted by Total desc."""
    m = _matrix(df, row, col, values)
    hits = F.col(f"`{positive}`") if positive in m.columns else F.lit(0)
    return (m.withColumnRenamed("__total", "Total")
            .withColumn("pct_positive", F.bround(hits / F.col("Total") * 100, digits))
            .orderBy(F.desc("Total"), row))


def order_by_list(df: DataFrame, col: str, order: Sequence) -> DataFrame:
    """Keep only listed classes and sort by their position in the list.

    The order table has exactly ``len(order)`` rows, so broadcasting it is safe.
    """
    spark = df.sparkSession
    pos = spark.createDataFrame([(v, i) for i, v in enumerate(order)], f"__val string, __pos int")
    return (df.join(F.broadcast(pos), df[col] == pos["__val"], "inner")
            .orderBy("__pos").drop("__val", "__pos"))


def mean_std(df: DataFrame, group: str, value: str, ddof: int = 0) -> DataFrame:
    """G27 (ddof 0, numpy) / G29 (ddof 1, seaborn sd error bars)."""
    sd = F.stddev_pop(value) if ddof == 0 else F.stddev_samp(value)
    return df.groupBy(group).agg(F.avg(value).alias("value"), sd.alias("std"))


def conditional_rate(df: DataFrame, group: str | None, pred: Column, digits: int = 1) -> DataFrame:
    """Count of rows matching ``pred``, total, rate in %, and ``k / n (p%)``."""
    aggs = [F.count_if(pred).cast("bigint").alias("k"), F.count(F.lit(1)).alias("n")]
    g = df.groupBy(group).agg(*aggs) if group else df.agg(*aggs)
    rate = F.col("k") / F.col("n") * 100
    return g.select(*([group] if group else []), "k", "n",
                    rate.alias("rate"),
                    F.format_string("%d / %d (%.1f%%)", F.col("k"), F.col("n"), F.bround(rate, digits)).alias("label"))
