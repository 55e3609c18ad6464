"""Cohort curation operators: target derivation, filters, imputation, encoding.

Rows P4–P9, N4–N6, M7 and G20 of the inventory.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clean import concat_strict, flag_label
from .profile import distinct_values

# Fixed values of the curation step (must equal the source notebook's).
TARGET_CLASSES = [
    "Malignant-melanocytic",
    "Benign-melanocytic",
    "Benign-non-melanocytic",
    "Malignant-non-melanocytic",
]
INTERESTED_COLUMNS = [
    "isic_id", "lesion_id", "patient_id", "age_approx", "anatom_site_general",
    "anatom_site_special", "clin_size_long_diam_mm", "fitzpatrick_skin_type",
    "image_type", "personal_hx_mm", "pixels_x", "pixels_y", "sex", "melanocytic",
    "diagnosis_1",
]
DROPPED_COLUMNS = [
    "anatom_site_special", "clin_size_long_diam_mm", "fitzpatrick_skin_type",
    "image_type", "personal_hx_mm", "melanocytic", "diagnosis_1", "melanocytic_str",
]


def derive_target(df: DataFrame) -> DataFrame:
    """P4 + P5: ``melanocytic_str`` and ``target = diagnosis_1 || '-' || melanocytic_str``
    (NULL diagnosis → NULL target)."""
    return (
        df.withColumn("melanocytic_str", flag_label("melanocytic", "melanocytic", "non-melanocytic"))
        .withColumn("target", concat_strict("diagnosis_1", F.lit("-"), "melanocytic_str"))
    )


def keep_classes(df: DataFrame, col: str = "target", classes: Sequence[str] = TARGET_CLASSES) -> DataFrame:
    """Membership filter; NULL is not a member."""
    return df.where(F.col(col).isin(list(classes)))


def drop_classes(df: DataFrame, col: str, classes: Sequence[str]) -> DataFrame:
    """Negated membership; NULL rows are dropped too (like ``~is_in``)."""
    return df.where(F.col(col).isNotNull() & ~F.col(col).isin(list(classes)))


def group_modes(df: DataFrame, group: str, cols: Sequence[str]) -> DataFrame:
    """Mode of each column within ``group`` ignoring NULLs; ties → smallest value.

    ``mode`` keeps a (value → count) map per group and merges partial maps, so a
    group holding a third of the rows is reduced on the map side.
    """
    return df.groupBy(group).agg(*[F.mode(c, True).alias(f"__mode_{c}") for c in cols])


def impute_group_mode(df: DataFrame, group: str, cols: Sequence[str], bounded_groups: bool = False) -> DataFrame:
    """Fill NULLs of ``cols`` with the mode of their ``group``.

    One aggregate for all columns (the source loops twice per class).  The
    mode table has one row per group.  It is broadcast explicitly only when the
    caller has bounded the group domain (e.g. after a membership filter on a
    literal class list); otherwise the join is left to AQE, which switches to a
    broadcast at run time only if the measured table is small.
    """
    modes = group_modes(df, group, cols)
    side = F.broadcast(modes) if bounded_groups else modes
    joined = df.join(side, df[group].eqNullSafe(side[group]), "left").drop(side[group])
    for c in cols:
        joined = joined.withColumn(c, F.coalesce(F.col(c), F.col(f"__mode_{c}")))
    return joined.drop(*[f"__mode_{c}" for c in cols]).select(*df.columns)


def fill_constant(df: DataFrame, col: str, value: str) -> DataFrame:
    """Constant fill as a new category."""
    return df.na.fill({col: value})


def one_hot(df: DataFrame, col: str, values: Sequence[str] | None = None, prefix: str | None = None,
            dtype: str = "int") -> DataFrame:
    """M7: ``to_dummies``: one 0/1 column ``<col>_<value>`` per sorted distinct value,
    placed where the source column was."""
    values = sorted(values) if values is not None else distinct_values(df, col)
    prefix = prefix if prefix is not None else f"{col}_"
    out = []
    for c in df.columns:
        if c == col:
            out += [F.col(col).eqNullSafe(F.lit(v)).cast(dtype).alias(f"{prefix}{v}") for v in values]
        else:
            out.append(F.col(c))
    return df.select(*out)


def from_one_hot(df: DataFrame, prefix: str, out: str) -> DataFrame:
    """G20 + S2: inverse of ``one_hot`` (first column wins ties)."""
    from .profile import rowwise_argmax
    cols = [c for c in df.columns if c.startswith(prefix)]
    return df.select(*[c for c in df.columns if c not in cols], rowwise_argmax(df, cols, out, prefix))
