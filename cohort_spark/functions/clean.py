"""Scalar column functions (P, S, D, M rows of the inventory).

Every function returns a ``Column`` built from ``pyspark.sql.functions`` so it
stays inside whole-stage code generation; nothing here runs Python per row.
ANSI mode stays on: where the source data may be malformed the ``try_*``
forms turn bad values into NULL instead of failing the job.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- P4 / P5 -----------------------------------------------------------------

def flag_label(c: Column | str, true_label: str, false_label: str) -> Column:
    """``true_label`` only when the flag is non-null and true; false and null
    both map to ``false_label``."""
    c = _c(c)
    return F.when(c.isNotNull() & c, F.lit(true_label)).otherwise(F.lit(false_label))


def concat_strict(*parts: Column | str) -> Column:
    """P5: concatenation that is NULL when any part is NULL (never concat_ws)."""
    return F.concat(*[_c(p) for p in parts])


# --- S rows ------------------------------------------------------------------

def replace_all(c: Column | str, old: str, new: str) -> Column:
    """Literal replace of every occurrence."""
    return F.replace(_c(c), F.lit(old), F.lit(new))


def strip(c: Column | str) -> Column:
    """S3: Python ``str.strip()`` — spaces, tabs and line breaks on both ends."""
    return F.btrim(_c(c), F.lit(" \t\n\r\x0b\x0c"))


def extract_or_null(c: Column | str, pattern: str, group: int = 1) -> Column:
    """Regex group, NULL when the pattern does not match."""
    return F.nullif(F.regexp_extract(_c(c), pattern, group), F.lit(""))


def decimal_comma(c: Column | str) -> Column:
    """``"3,5"`` → 3.5; unparsable text → NULL."""
    return F.replace(_c(c), F.lit(","), F.lit(".")).try_cast("double")


def file_name(path: Column | str) -> Column:
    """Last path element of a URI, percent-decoded."""
    return F.url_decode(F.element_at(F.split(_c(path), "/"), -1))


def file_stem(path: Column | str) -> Column:
    """``os.path.splitext(basename)[0]``."""
    return F.regexp_extract(file_name(path), r"^(.+?)(\.[^.]*)?$", 1)


def file_ext(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"(\.[^.]*)$", 1))


def has_suffix(path: Column | str, suffixes: tuple[str, ...]) -> Column:
    """Case-insensitive suffix test (``.lower().endswith(suffixes)``)."""
    alts = "|".join(s.lstrip(".").replace(".", r"\.") for s in suffixes)
    return F.lower(_c(path)).rlike(rf"\.({alts})$")


def prefixed_key(prefix: Column | str, name: Column | str, sep: str = "__") -> Column:
    """``f"{prefix}{sep}{name}"``."""
    return F.concat(_c(prefix), F.lit(sep), _c(name))


def first_token(c: Column | str, sep: str = "_") -> Column:
    """``s.split(sep)[0]``."""
    return F.split(_c(c), sep, -1).getItem(0)


# --- D rows ------------------------------------------------------------------

def date_or_null(c: Column | str, fmt: str = "ddMMyyyy") -> Column:
    """Strict parse, invalid calendar dates → NULL."""
    return F.try_to_date(_c(c), fmt)


# --- M rows ------------------------------------------------------------------

def ellipse_area(major: Column | str, minor: Column | str) -> Column:
    """M1: π·(a/2)·(b/2)."""
    return F.lit(math.pi) * (_c(major) / 2) * (_c(minor) / 2)


def safe_ratio(a: Column | str, b: Column | str) -> Column:
    """M1 aspect ratio; a zero divisor gives NULL (documented difference from ±inf)."""
    return F.try_divide(_c(a), _c(b))


def sentinel_number(c: Column | str, sentinel: str = "In situ") -> Column:
    """M2: sentinel text → NULL, otherwise a number or NULL."""
    return F.nullif(_c(c), F.lit(sentinel)).try_cast("double")


def round_half_even(c: Column | str, digits: int = 0) -> Column:
    """M3: numpy/polars rounding (half to even)."""
    return F.bround(_c(c), digits)


def clamp(c: Column | str, lo: Column | float, hi: Column | float) -> Column:
    """M4."""
    lo = lo if isinstance(lo, Column) else F.lit(lo)
    hi = hi if isinstance(hi, Column) else F.lit(hi)
    return F.greatest(lo, F.least(hi, _c(c)))


def first_item(c: Column | str, kind: str) -> Column:
    """M5: first item of an array, first value of a map, else the value."""
    c = _c(c)
    if kind == "array":
        return F.element_at(c, 1)
    if kind == "map":
        return F.element_at(F.map_values(c), 1)
    return c


def to_mib(c: Column | str) -> Column:
    """M6."""
    return _c(c) / F.lit(1024 ** 2)


def to_gib(c: Column | str) -> Column:
    return _c(c) / F.lit(1024 ** 3)


def band(c: Column | str, thresholds: list[tuple[float, str]], default: str) -> Column:
    """``>t1 → l1, >t2 → l2, … else default`` (first match wins)."""
    c = _c(c)
    out = None
    for t, label in thresholds:
        out = F.when(c > t, F.lit(label)) if out is None else out.when(c > t, F.lit(label))
    return out.otherwise(F.lit(default)) if out is not None else F.lit(default)


def label_lookup(c: Column | str, labels: dict[str, str], fallback_to_code: bool = True) -> Column:
    """Code → label from a literal dictionary, optionally falling back to the code."""
    c = _c(c)
    m = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    looked = F.try_element_at(m, c)
    return F.coalesce(looked, c) if fallback_to_code else looked


def is_missing(c: Column | str, numeric: bool) -> Column:
    """NULL, or NaN for floating columns (quality reports count both)."""
    c = _c(c)
    return (c.isNull() | F.isnan(c)) if numeric else c.isNull()


def non_finite(c: Column | str) -> Column:
    """NaN or ±infinity."""
    c = _c(c)
    return F.isnan(c) | (F.abs(c) == F.lit(float("inf")))


def without_part(c: Column | str, part: str) -> Column:
    """Condition that keeps names that do not contain ``part`` (a literal, not a
    pattern); NULL names are dropped."""
    return ~_c(c).contains(F.lit(part))
