"""Radiomic texture and shape features per colour channel.

Formulas follow the published definitions (Haralick 1973; Galloway 1975;
Thibault 2009; Sun & Wee 1983; Amadasun & King 1989; IBSI, Zwanenburg 2020;
van Griethuysen 2017) with the extractor's default settings restated below.

Data flow: ROI pixels ``(image_id, channel, x, y, v)`` → discretised level
``g`` → per (image, channel) small count tables (level histograms, GLCM cells, runs,
dependence counts) → aggregates.  The ROI of one image and channel goes through array
shifts in a vectorised UDF (also the connected zones, a sequential labelling, and the
GLCM eigenvalue); an image is bounded by its own size, level tables by the bin count, and
Arrow batches by their bytes (``session``).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


# Default extractor settings (no parameter file is passed in the source).
BIN_WIDTH = 25
EPS = float(np.spacing(1))  # 2.2e-16 inside logarithms
CHANNELS = ["blue", "green", "red", "gray"]
IC = ["image_id", "channel"]
# four directions: (name, line key, position along the line)
DIRECTIONS = [
    ("0", lambda: F.col("y"), "x"),
    ("45", lambda: F.col("x") - F.col("y"), "x"),
    ("90", lambda: F.col("x"), "y"),
    ("135", lambda: F.col("x") + F.col("y"), "x"),
]


def _long(df: DataFrame, keys: Sequence[str], family: str, feats: dict[str, Column]) -> DataFrame:
    """Wide feature columns → (keys…, feature, value) with ``<family>_<Feature>`` names."""
    args = [x for name, c in feats.items() for x in (F.lit(f"{family}_{name}"), c.cast("double"))]
    return df.select(*keys, F.stack(F.lit(len(feats)), *args).alias("feature", "value"))


# ------------------------------------------------------------------ R0 ----

def roi_pixels(pixels: DataFrame, fg: DataFrame, channels: Sequence[str] = CHANNELS) -> DataFrame:
    """ROI pixels in long form ``(image_id, channel, x, y, v)``.

    ``pixels`` carries the channels as columns (read once per image);
    ``fg`` holds the ROI coordinates (mask above its threshold).  The result is
    repartitioned by ``image_id`` once; every later window reuses it.
    """
    inside = pixels.join(fg.select("image_id", "x", "y").distinct(), ["image_id", "x", "y"], "left_semi")
    args = [x for c in channels for x in (F.lit(c), F.col(c).cast("int"))]
    long = inside.select("image_id", "x", "y", F.stack(F.lit(len(channels)), *args).alias("channel", "v"))
    return long.repartition("image_id")


def discretize(roi: DataFrame, bin_width: int = BIN_WIDTH) -> DataFrame:
    """``g = floor(v / w) - floor(min_ROI / w) + 1`` per (image, channel)."""
    b = F.floor(F.col("v") / bin_width)
    return roi.withColumn("g", (b - F.min(b).over(Window.partitionBy(*IC)) + 1).cast("int"))


# ------------------------------------------------------------------ R1 ----

def _sums(key: np.ndarray, count: int, *values: np.ndarray) -> list[np.ndarray]:
    """The sum of each of ``values`` for each key."""
    return [np.bincount(key, weights=v, minlength=count) for v in values]


def _spread(key: np.ndarray, value: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, value) in order, the sum of their weights, and the place of each row among them."""
    wide = int(value.max(initial=0)) + 1
    pairs, place = np.unique(key * wide + value, return_inverse=True)
    return pairs // wide, pairs % wide, np.bincount(place, weights=weight, minlength=len(pairs)), place


def _features(rows: DataFrame, family: str, names: Sequence[str], columns: Sequence[str], of: Callable) -> DataFrame:
    """``of(number of rows, columns)`` gives the features of many images and channels, and which of them have any, in
    array passes; → long form, without a row for those that have none."""
    def run(*lists: pa.Array) -> pa.Array:
        with np.errstate(divide="ignore", invalid="ignore"):
            values, known = of(len(lists[0]), lists)
        made = [np.asarray(values[n], dtype=np.float64) for n in names]
        return pa.StructArray.from_arrays([pa.array(np.nan_to_num(v), mask=np.isnan(v)) for v in made], names=list(names),
                                          mask=pa.array(~known))

    kind = T.StructType([T.StructField(n, T.DoubleType()) for n in names])
    keys = [c for c in IC if c in rows.columns]
    f = rows.select(*keys, F.arrow_udf(run, kind)(*columns).alias("f")).where(F.col("f").isNotNull())
    return _long(f, keys, family, {n: F.col("f")[n] for n in names})


def _flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def _of_family(lists: Sequence[pa.Array], family: str) -> tuple[np.ndarray, ...]:
    """(row, angle, a, b, n, val) of one family's counts."""
    mine = _flat(lists[0]) == ALL_FAMILIES.index(family)
    row = pc.list_parent_indices(lists[0]).to_numpy(zero_copy_only=False)[mine].astype(np.int64)
    return row, *(_flat(c)[mine] for c in lists[1:])


FIRSTORDER_NAMES = [
    "Energy", "TotalEnergy", "Entropy", "Minimum", "10Percentile", "90Percentile", "Maximum", "Mean", "Median", "InterquartileRange", "Range",
    "MeanAbsoluteDeviation", "RobustMeanAbsoluteDeviation", "RootMeanSquared", "Skewness", "Kurtosis", "Variance", "Uniformity"]


def _firstorder(count: int, lists: Sequence[pa.Array]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    row, _, v, _, c, _ = _of_family(lists, "fo")
    order = np.lexsort((v, row))
    row, v, c = row[order], v[order].astype(np.float64), c[order].astype(np.float64)
    N, S1, S2 = _sums(row, count, c, c * v, c * v * v)
    known, mean = N > 0, S1 / N
    # Exact linear percentiles weighted by the counts.
    below = np.cumsum(c)
    base = np.cumsum(N) - N

    def quantile(q: float) -> np.ndarray:
        at = q * (N - 1)
        low, high = (v[np.minimum(np.searchsorted(below, base + place, side="right"), len(v) - 1)] for place in (np.floor(at), np.ceil(at)))
        return np.where(low == high, low, (np.ceil(at) - at) * low + (at - np.floor(at)) * high)

    p10, p25, p50, p75, p90 = (quantile(q) if len(v) else np.zeros(count) for q in (0.1, 0.25, 0.5, 0.75, 0.9))
    d = v - mean[row]
    m2, m3, m4, mad = (x / N for x in _sums(row, count, c * d * d, c * d * d * d, c * d * d * d * d, c * np.abs(d)))
    mid = (v >= p10[row]) & (v <= p90[row])
    rn, rs = _sums(row[mid], count, c[mid], c[mid] * v[mid])
    rmad = _sums(row[mid], count, c[mid] * np.abs(v[mid] - (rs / rn)[row[mid]]))[0] / rn
    lrow, _, _, _, n, _ = _of_family(lists, "lvl")
    p = n / N[lrow]
    entropy, uniformity = _sums(lrow, count, -p * np.log2(p + EPS), p * p)
    low, high = np.full(count, np.inf), np.full(count, -np.inf)
    np.minimum.at(low, row, v)
    np.maximum.at(high, row, v)
    flat = m2 == 0
    values = [S2, S2, entropy, low, p10, p90, high, mean, p50, p75 - p25, high - low, mad, rmad, np.sqrt(S2 / N),
              np.where(flat, 0.0, m3 / np.power(m2, 1.5)), np.where(flat, 0.0, m4 / (m2 * m2)), m2, uniformity]
    return dict(zip(FIRSTORDER_NAMES, values, strict=True)), known


def firstorder(stats: DataFrame) -> DataFrame:
    """18 first-order features from the (value → count) and (level → count)
    records of ``texture_stats``."""
    return _features(stats, "firstorder", FIRSTORDER_NAMES, _TABLES, _firstorder)


# --------------------------------------------------------- count tables ----

ALL_FAMILIES = ("fo", "lvl", "glcm", "glrlm", "gldm", "ngtdm")
_STATS = "fam int, angle int, a int, b int, n bigint, val double"
_TABLES = [c.split()[0] for c in _STATS.split(", ")]
GRID_CELLS = 1 << 21  # cells of the grids that are held at once


class _Grids:
    """The ROIs of several images and channels on one line of cells, each on its own grid
    with a border of ``empty``, so a neighbour is one shifted look-up and none is of another ROI."""

    def __init__(self, x: np.ndarray, y: np.ndarray, g: np.ndarray, sizes: np.ndarray, empty: int) -> None:
        self.group = np.repeat(np.arange(len(sizes)), sizes)
        first = np.cumsum(sizes) - sizes
        x0, y0 = np.minimum.reduceat(x, first), np.minimum.reduceat(y, first)
        wide = np.maximum.reduceat(x, first) - x0 + 3
        self.base = np.concatenate(([0], np.cumsum(wide * (np.maximum.reduceat(y, first) - y0 + 3))))
        self.wide = wide
        self.step = wide[self.group]  # to the next row
        self.at = self.base[self.group] + (y - y0[self.group] + 1) * self.step + x - x0[self.group] + 1
        self.cells = np.full(self.base[-1], empty, dtype=np.int64)
        self.cells[self.at] = g


def _stretches(columns: Sequence[pd.Series]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """The values of the lists in ``columns`` (first x, y) end to end, with the length of each
    list: as many lists at a time as ``GRID_CELLS`` hold, at least one."""
    if not len(columns[0]):
        return
    sizes = np.array([len(c) for c in columns[0]], dtype=np.int64)
    flat = [np.concatenate([np.asarray(c, dtype=np.int64) for c in column]) for column in columns]
    ends = np.cumsum(sizes)
    x, y = ((np.maximum.reduceat(c, ends - sizes) - np.minimum.reduceat(c, ends - sizes) + 3) for c in flat[:2])
    held = np.cumsum(x * y)
    low = 0
    while low < len(sizes):
        high = max(low + 1, int(np.searchsorted(held, (held[low - 1] if low else 0) + GRID_CELLS, side="right")))
        start, end = ends[low] - sizes[low], ends[high - 1]
        yield [c[start:end] for c in flat], sizes[low:high]
        low = high


def _tally(group: np.ndarray, a: np.ndarray, b: np.ndarray | None = None, val: np.ndarray | None = None) -> tuple:
    """(group, a, b, count, sum of val) of the distinct triples of small integers; without b it is -1."""
    if not len(a):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none, np.zeros(0)
    low = int(a.min())
    wide, deep = (int(b.max()) + 1 if b is not None else 1), int(a.max()) - low + 1
    keys, inverse = np.unique((group * deep + a - low) * wide + (0 if b is None else b), return_inverse=True)
    first = keys // wide
    second = np.full(len(keys), -1) if b is None else keys % wide
    total = np.zeros(len(keys)) if val is None else np.bincount(inverse, weights=val, minlength=len(keys))
    return first // deep, first % deep + low, second, np.bincount(inverse, minlength=len(keys)), total


def _count_tables(xs: np.ndarray, ys: np.ndarray, vs: np.ndarray, gs: np.ndarray, sizes: np.ndarray, families: set, alpha: int) -> list[tuple]:
    """The count tables of images and channels as (family, angle, group, a, b, n, val) columns.

    ROI levels lie on grids with a border of zeros (levels start at 1); runs are the breaks
    of pixels along each direction.
    """
    grids = _Grids(xs, ys, gs, sizes, 0)
    group, at, step, grid = grids.group, grids.at, grids.step, grids.cells
    out = [("lvl", -1, *_tally(group, gs))]
    if "fo" in families:
        out.append(("fo", -1, *_tally(group, vs)))
    steps = (1, step + 1, step, 1 - step)  # to the next pixel in each of DIRECTIONS
    cnt, tot, dep = np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=np.int64), np.ones(len(at), dtype=np.int64)
    for d, to in enumerate(steps):
        after, before = grid[at + to], grid[at - to]
        for other in (after, before):
            there = other > 0
            cnt += there
            tot += other
            dep += there & (np.abs(other - gs) <= alpha)
        if "glcm" in families:
            met = before > 0
            i, j, g = before[met], gs[met], group[met]
            out.append(("glcm", d, *_tally(np.concatenate((g, g)), np.concatenate((i, j)), np.concatenate((j, i)))))
        if "glrlm" in families:
            new = before != gs
            starts = at[new]
            level, length = grid[starts], np.zeros(len(starts), dtype=np.int64)
            on = to if d == 0 else to[new]
            here, going = starts, np.arange(len(starts))
            while len(going):  # as often as the longest run is long
                length[going] += 1
                here = here + on
                more = grid[here] == level[going]
                going, here = going[more], here[more]
                on = on if d == 0 else on[more]
            out.append(("glrlm", d, *_tally(group[new], level, length)))
    if "gldm" in families:
        out.append(("gldm", -1, *_tally(group, gs, dep)))
    if "ngtdm" in families:
        met = cnt > 0
        out.append(("ngtdm", -1, *_tally(group[met], gs[met], None, np.abs(gs[met] - tot[met] / cnt[met]))))
    return out


def _by_group(group: np.ndarray, columns: Sequence[np.ndarray], count: int) -> list[list[np.ndarray]]:
    """Each column cut into the arrays of its groups."""
    order = np.argsort(group, kind="stable")
    cuts = np.searchsorted(group[order], np.arange(1, count))
    return [np.split(c[order], cuts) for c in columns]


def _stats_udf(families: set, alpha: int):
    names = [c.split()[0] for c in _STATS.split(", ")]
    types = (np.int32, np.int32, np.int32, np.int32, np.int64, np.float64)

    def run(xs: pd.Series, ys: pd.Series, vs: pd.Series, gs: pd.Series) -> pd.DataFrame:
        made: list[list] = [[] for _ in names]
        for (x, y, v, g), sizes in _stretches((xs, ys, vs, gs)):
            parts = _count_tables(x, y, v, g, sizes, families, alpha)
            many = [len(p[2]) for p in parts]
            columns = [np.repeat([ALL_FAMILIES.index(p[0]) for p in parts], many), np.repeat([p[1] for p in parts], many),
                       *(np.concatenate([p[k] for p in parts]) for k in (3, 4, 5, 6))]
            cut = _by_group(np.concatenate([p[2] for p in parts]), [c.astype(t) for c, t in zip(columns, types, strict=True)], len(sizes))
            for whole, more in zip(made, cut, strict=True):
                whole.extend(more)
        return pd.DataFrame(dict(zip(names, made, strict=True)))

    return F.pandas_udf(run, "struct<fam:array<int>, angle:array<int>, a:array<int>, b:array<int>, n:array<bigint>, val:array<double>>")


def texture_stats(roi_g: DataFrame, alpha: int = 0, families: Sequence[str] = ALL_FAMILIES) -> DataFrame:
    """All per-(image, channel) count tables the texture families need:

    * ``fo``   (a = intensity)                  — first order
    * ``lvl``  (a = level)                      — level histogram
    * ``glcm`` (angle, a = i, b = j)            — symmetric co-occurrences
    * ``glrlm`` (angle, a = level, b = length)  — runs
    * ``gldm`` (a = level, b = dependence)
    * ``ngtdm`` (a = level, val = |g − neighbour mean|)

    One row for each image and channel holds them as lists; ``fam`` is the place in ``ALL_FAMILIES``.  The ROIs of
    a batch of images and channels (each bounded by its image) go through array
    shifts together, which give the counts alone.  The result is small (bounded by levels² per image and
    channel) and is written to the shared checkpoint folder, so that the families
    that branch from it do not repeat the pixel work and no cache is left behind.
    """
    from ..session import stored

    made = gathered(roi_g).select(*IC, _stats_udf(set(families) | {"lvl"}, alpha)("xs", "ys", "vs", "gs").alias("t"))
    return stored(made.select(*IC, *[F.col(f"t.{c}").alias(c) for c in _TABLES]), "stats")


def gathered(roi_g: DataFrame) -> DataFrame:
    """ROI pixels with levels → one row for each image and channel, with lists xs, ys, vs, gs (once gathered, as they are)."""
    if "xs" in roi_g.columns:
        return roi_g
    return roi_g.groupBy(*IC).agg(*[F.collect_list(F.col(c).cast("int")).alias(f"{c}s") for c in "xyvg"]).where(
        F.col("image_id").isNotNull() & F.col("channel").isNotNull())


# ------------------------------------------------------------------ R2 ----

#: Cells of the matrices whose eigenvalues are found at once.
MATRIX_CELLS = 1 << 20


def _mcc(key: np.ndarray, count: int, place: np.ndarray, other: np.ndarray, levels: np.ndarray, c: np.ndarray) -> np.ndarray:
    """√(second largest eigenvalue of Q), Q(i,j) = Σ_k p(i,k)p(j,k)/(px(i)py(k)), for the co-occurrence matrix
    of each key, given as cells (place and other: row and column); matrices of one size go together."""
    out = np.where(levels == 1, 1.0, np.nan)
    by_size = np.argsort(levels[key], kind="stable")
    for size in np.unique(levels[levels > 1]):
        mine = by_size[slice(*np.searchsorted(levels[key][by_size], (size, size + 1)))]
        mine = mine[np.argsort(key[mine], kind="stable")]
        keys, at = np.unique(key[mine], return_inverse=True)
        most = max(1, MATRIX_CELLS // int(size * size))
        for low in range(0, len(keys), most):
            part = slice(*np.searchsorted(at, (low, low + most)))
            m = np.zeros((min(most, len(keys) - low), size, size))
            m[at[part] - low, place[mine[part]], other[mine[part]]] = c[mine[part]]
            p = m / m.sum((1, 2), keepdims=True)
            q = (p / p.sum(2)[:, :, None]) @ (p / p.sum(1)[:, None, :]).transpose(0, 2, 1)
            ev = np.sort(np.real(np.linalg.eigvals(q)), axis=1)
            out[keys[low:low + most]] = np.sqrt(np.maximum(ev[:, -2], 0.0))
    return out


GLCM_NAMES = [
    "Autocorrelation", "JointAverage", "ClusterProminence", "ClusterShade", "ClusterTendency", "Contrast", "Correlation", "DifferenceAverage",
    "DifferenceEntropy", "DifferenceVariance", "JointEnergy", "JointEntropy", "Imc1", "Imc2", "Idm", "Idmn", "Id", "Idn", "InverseVariance",
    "MaximumProbability", "SumAverage", "SumEntropy", "SumSquares", "MCC"]


def _mean_over_angles(values: dict[str, np.ndarray], present: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Features of (row, angle) → means over the angles that are present."""
    there = present.reshape(-1, len(DIRECTIONS))
    many = there.sum(1)
    return {n: np.where(there, v.reshape(there.shape), 0.0).sum(1) / many for n, v in values.items()}, many > 0


def _glcm(count: int, lists: Sequence[pa.Array], with_mcc: bool) -> tuple[dict[str, np.ndarray], np.ndarray]:
    row, angle, i, j, c, _ = _of_family(lists, "glcm")
    key, K = row * len(DIRECTIONS) + angle, count * len(DIRECTIONS)
    i, j, c = i.astype(np.int64), j.astype(np.int64), c.astype(np.float64)
    tot = _sums(key, K, c)[0]
    p = c / tot[key]
    mkey, level, px, place = _spread(key, i, p)
    levels = np.bincount(mkey, minlength=K)
    first = np.cumsum(levels) - levels
    # The matrix is symmetric: a column's level is among its rows'.
    wide = int(i.max(initial=0)) + 1
    other = np.searchsorted(mkey * wide + level, key * wide + j)
    mu, HX = _sums(mkey, K, level * px, -px * np.log2(px + EPS))
    m = mu[key]
    s = i + j - 2 * m
    auto, prominence, shade, tendency, contrast, squares, energy, entropy, hxy1 = _sums(
        key, K, p * i * j, p * s * s * s * s, p * s * s * s, p * s * s, p * (i - j) * (i - j), p * (i - m) * (i - m), p * p,
        -p * np.log2(p + EPS), -p * np.log2(px[place] * px[other] + EPS))
    most = np.zeros(K)
    np.maximum.at(most, key, p)
    # difference and sum distributions p_{x-y}(k), p_{x+y}(k)
    lrow, _, lv, _, _, _ = _of_family(lists, "lvl")
    Ng = np.zeros(count)
    np.maximum.at(Ng, lrow, lv)
    dkey, k, pk, _ = _spread(key, np.abs(i - j), p)
    g = Ng[dkey // len(DIRECTIONS)]
    da, de, idm, idmn, id_, idn, inverse, k2 = _sums(
        dkey, K, k * pk, -pk * np.log2(pk + EPS), pk / (1 + k * k), pk / (1 + k * k / (g * g)), pk / (1 + k), pk / (1 + k / g),
        np.where(k > 0, pk / np.maximum(k * k, 1), 0.0), k * k * pk)
    skey, k, pk, _ = _spread(key, i + j, p)
    sa, se = _sums(skey, K, k * pk, -pk * np.log2(pk + EPS))
    imc2 = 1.0 - np.exp(-2 * (2 * HX - entropy))  # HX + HY; the matrix is symmetric (HY = HX)
    values = [auto, mu, prominence, shade, tendency, contrast, np.where(squares == 0, 1.0, (auto - mu ** 2) / squares), da, de, k2 - da ** 2, energy,
              entropy, np.where(HX == 0, 0.0, (entropy - hxy1) / HX), np.sqrt(np.maximum(imc2, 0.0)), idm, idmn, id_, idn, inverse, most, sa, se, squares,
              _mcc(key, K, place - first[key], other - first[key], levels, c) if with_mcc else np.full(K, np.nan)]
    return _mean_over_angles(dict(zip(GLCM_NAMES, values, strict=True)), tot > 0)


def glcm(stats: DataFrame, with_mcc: bool = True) -> DataFrame:
    """R2: 24 GLCM features per angle, averaged over angles that have pairs
    (23 without the eigenvalue-based MCC when ``with_mcc`` is false)."""
    names = GLCM_NAMES if with_mcc else GLCM_NAMES[:-1]
    return _features(stats, "glcm", names, _TABLES, lambda n, lists: _glcm(n, lists, with_mcc))


# ------------------------------------------------------- R3 / R4 / R5 ----

def _size_features(key: np.ndarray, count: int, i: np.ndarray, j: np.ndarray, P: np.ndarray, Np: np.ndarray | None, names: dict[str, str]) -> dict[str, np.ndarray]:
    """Shared formulas for (level i, size j, count P) matrices (runs, zones,
    dependences) of each key.  ``names`` maps generic keys to the family's feature names."""
    of_level, of_size = (_spread(key, v.astype(np.int64), P) for v in (i, j))
    i, j, P = i.astype(np.float64), j.astype(np.float64), P.astype(np.float64)
    Nr, short, long, low, high, sl, sh, ll, lh, s_i, s_i2, s_j, s_j2 = _sums(
        key, count, P, P / (j * j), P * j * j, P / (i * i), P * i * i, P / (i * i * j * j), P * i * i / (j * j), P * j * j / (i * i), P * i * i * j * j,
        P * i, P * i * i, P * j, P * j * j)
    gln, sln = (_sums(d[0], count, d[2] ** 2)[0] for d in (of_level, of_size))
    p = P / Nr[key]
    generic = {
        "short": short / Nr, "long": long / Nr, "gln": gln / Nr, "glnn": gln / (Nr * Nr), "sln": sln / Nr, "slnn": sln / (Nr * Nr),
        "pct": Nr / Np if Np is not None else np.full(count, np.nan),
        "glv": s_i2 / Nr - (s_i / Nr) * (s_i / Nr), "sv": s_j2 / Nr - (s_j / Nr) * (s_j / Nr), "ent": _sums(key, count, -p * np.log2(p + EPS))[0],
        "low": low / Nr, "high": high / Nr, "sl": sl / Nr, "sh": sh / Nr, "ll": ll / Nr, "lh": lh / Nr,
    }
    return {n: generic[g] for g, n in names.items()}


GLRLM_NAMES = {
    "short": "ShortRunEmphasis", "long": "LongRunEmphasis", "gln": "GrayLevelNonUniformity",
    "glnn": "GrayLevelNonUniformityNormalized", "sln": "RunLengthNonUniformity",
    "slnn": "RunLengthNonUniformityNormalized", "pct": "RunPercentage", "glv": "GrayLevelVariance",
    "sv": "RunVariance", "ent": "RunEntropy", "low": "LowGrayLevelRunEmphasis", "high": "HighGrayLevelRunEmphasis",
    "sl": "ShortRunLowGrayLevelEmphasis", "sh": "ShortRunHighGrayLevelEmphasis",
    "ll": "LongRunLowGrayLevelEmphasis", "lh": "LongRunHighGrayLevelEmphasis",
}
GLSZM_NAMES = {
    "short": "SmallAreaEmphasis", "long": "LargeAreaEmphasis", "gln": "GrayLevelNonUniformity",
    "glnn": "GrayLevelNonUniformityNormalized", "sln": "SizeZoneNonUniformity",
    "slnn": "SizeZoneNonUniformityNormalized", "pct": "ZonePercentage", "glv": "GrayLevelVariance",
    "sv": "ZoneVariance", "ent": "ZoneEntropy", "low": "LowGrayLevelZoneEmphasis", "high": "HighGrayLevelZoneEmphasis",
    "sl": "SmallAreaLowGrayLevelEmphasis", "sh": "SmallAreaHighGrayLevelEmphasis",
    "ll": "LargeAreaLowGrayLevelEmphasis", "lh": "LargeAreaHighGrayLevelEmphasis",
}
GLDM_NAMES = {
    "short": "SmallDependenceEmphasis", "long": "LargeDependenceEmphasis", "gln": "GrayLevelNonUniformity",
    "sln": "DependenceNonUniformity", "slnn": "DependenceNonUniformityNormalized", "glv": "GrayLevelVariance",
    "sv": "DependenceVariance", "ent": "DependenceEntropy", "low": "LowGrayLevelEmphasis",
    "high": "HighGrayLevelEmphasis", "sl": "SmallDependenceLowGrayLevelEmphasis",
    "sh": "SmallDependenceHighGrayLevelEmphasis", "ll": "LargeDependenceLowGrayLevelEmphasis",
    "lh": "LargeDependenceHighGrayLevelEmphasis",
}


def _glrlm(count: int, lists: Sequence[pa.Array]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    row, angle, i, j, n, _ = _of_family(lists, "glrlm")
    lrow, _, _, _, pixels, _ = _of_family(lists, "lvl")
    key, K = row * len(DIRECTIONS) + angle, count * len(DIRECTIONS)
    Np = np.repeat(_sums(lrow, count, pixels)[0], len(DIRECTIONS))
    return _mean_over_angles(_size_features(key, K, i, j, n, Np, GLRLM_NAMES), np.bincount(key, minlength=K) > 0)


def glrlm(stats: DataFrame) -> DataFrame:
    """Run-length matrix per angle (runs of equal level along each
    direction), 16 features per angle averaged over angles."""
    return _features(stats, "glrlm", list(GLRLM_NAMES.values()), _TABLES, _glrlm)


def _gldm(count: int, lists: Sequence[pa.Array]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    row, _, i, j, n, _ = _of_family(lists, "gldm")
    return _size_features(row, count, i, j, n, None, GLDM_NAMES), np.bincount(row, minlength=count) > 0


def gldm(stats: DataFrame) -> DataFrame:
    """Dependence ``d = 1 + #{8-neighbours in ROI with |g_n - g| <= alpha}``
    (alpha is applied in ``texture_stats``)."""
    return _features(stats, "gldm", list(GLDM_NAMES.values()), _TABLES, _gldm)


def _zone_tables(xs: np.ndarray, ys: np.ndarray, gs: np.ndarray, sizes: np.ndarray) -> tuple:
    """8-connected zones of equal level of images and channels: the size-zone matrices
    as (group, level, zone size, count) arrays.

    Zones are joined at their smallest pixels: of two zones that touch the later one is hung
    below the earlier one and all chains are cut short, until no neighbours differ.
    """
    grids = _Grids(xs, ys, gs, sizes, -1)
    grid = grids.cells
    cells = np.flatnonzero(grid >= 0)
    group = np.searchsorted(grids.base, cells, side="right") - 1
    step, level = grids.wide[group], grid[cells]
    place = np.zeros(len(grid), dtype=np.int64)
    place[cells] = np.arange(len(cells))
    pairs = [(here, place[cells[here] + to[here]]) for to in (np.ones_like(step), step - 1, step, step + 1)
             for here in [np.flatnonzero(grid[cells + to] == level)]]
    a, b = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
    zone = np.arange(len(cells))
    while True:
        differ = zone[a] != zone[b]
        if not differ.any():
            break
        a, b = a[differ], b[differ]
        np.minimum.at(zone, np.maximum(zone[a], zone[b]), np.minimum(zone[a], zone[b]))
        while not np.array_equal(up := zone[zone], zone):
            zone = up
    root = np.flatnonzero(zone == np.arange(len(cells)))
    return _tally(group[root], level[root], np.bincount(zone, minlength=len(cells))[root])[:4]


def _zones_series(xs: pd.Series, ys: pd.Series, gs: pd.Series) -> pd.DataFrame:
    made: list[list] = [[], [], []]
    for (x, y, g), sizes in _stretches((xs, ys, gs)):
        group, i, j, n = _zone_tables(x, y, g, sizes)
        cut = _by_group(group, (i.astype(np.int32), j.astype(np.int64), n.astype(np.int64)), len(sizes))
        for whole, more in zip(made, cut, strict=True):
            whole.extend(more)
    return pd.DataFrame({"i": made[0], "j": made[1], "P": made[2]})


def _glszm(count: int, lists: Sequence[pa.Array]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    zones = _zones_series(*(pd.Series(list(np.split(_flat(c), c.offsets.to_numpy()[1:-1] - c.offsets[0].as_py()))) for c in lists))
    row = np.repeat(np.arange(count), zones["i"].map(len).to_numpy(dtype=np.int64))
    i, j, n = (np.concatenate(zones[c].to_list()) if count else np.zeros(0) for c in ("i", "j", "P"))
    Np = pc.list_value_length(lists[0]).to_numpy(zero_copy_only=False).astype(np.float64)
    return _size_features(row, count, i, j, n, Np, GLSZM_NAMES), Np > 0


def glszm(roi_g: DataFrame) -> DataFrame:
    """Size-zone matrix (zones = 8-connected components of equal level),
    16 features.  One image/channel per row (bounded by the image size), all of a batch labelled together."""
    return _features(gathered(roi_g), "glszm", list(GLSZM_NAMES.values()), ["xs", "ys", "gs"], _glszm)


# ------------------------------------------------------------------ R6 ----

NGTDM_NAMES = ["Coarseness", "Contrast", "Busyness", "Complexity", "Strength"]


def _ngtdm(count: int, lists: Sequence[pa.Array]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    row, _, i, _, n, s = _of_family(lists, "ngtdm")
    order = np.argsort(row, kind="stable")
    row, i, n, s = row[order], i[order].astype(np.float64), n[order].astype(np.float64), s[order]
    many = np.bincount(row, minlength=count)
    Nvp, s_tot = _sums(row, count, n, s)
    p = n / Nvp[row]
    ps, P1, P2, J1, J2 = _sums(row, count, p * s, p * i, p * i * i, i, i * i)
    # level pairs of one image/channel (bounded by the number of bins)
    first = np.cumsum(many) - many
    u = np.repeat(np.arange(len(row)), many[row])
    w = np.repeat(first[row], many[row]) + np.arange(len(u)) - np.repeat(np.cumsum(many[row]) - many[row], many[row])
    absdiff, cx = _sums(row[u], count, np.abs(i[u] * p[u] - i[w] * p[w]), np.abs(i[u] - i[w]) * (p[u] * s[u] + p[w] * s[w]) / (p[u] + p[w]))
    pp = 2 * (P2 - P1 * P1)  # Σ_i Σ_j p_i p_j (i-j)², Σ p = 1
    strength = 2 * (many * P2 - 2 * J1 * P1 + J2)
    values = [np.where(ps == 0, 1e6, 1 / ps), np.where(many <= 1, 0.0, pp / (many * (many - 1)) * s_tot / Nvp),
              np.where((many <= 1) | (absdiff == 0), 0.0, ps / absdiff), cx / Nvp, np.where(s_tot == 0, 0.0, strength / s_tot)]
    return dict(zip(NGTDM_NAMES, values, strict=True)), many > 0


def ngtdm(stats: DataFrame) -> DataFrame:
    """Neighbouring gray tone difference matrix, 5 features.

    ``s_i = Σ |i - mean of the ROI neighbours|`` over pixels of level i that
    have at least one ROI neighbour.  The double sums over level pairs use
    closed forms except Complexity and Busyness, which pair the (at most
    bin-count many) levels of one image/channel.
    """
    return _features(stats, "ngtdm", NGTDM_NAMES, _TABLES, _ngtdm)


# ------------------------------------------------------------------ R7 ----

# Marching-squares contribution of one 2×2 cell by its corner code
# (TL=1, TR=2, BL=4, BR=8): (contour length, enclosed area).
_R2 = math.sqrt(2) / 2
CELL_TABLE = [
    (0, 0.0, 0.0), (1, _R2, 0.125), (2, _R2, 0.125), (3, 1.0, 0.5), (4, _R2, 0.125), (5, 1.0, 0.5),
    (6, 2 * _R2, 0.25), (7, _R2, 0.875), (8, _R2, 0.125), (9, 2 * _R2, 0.25), (10, 1.0, 0.5), (11, _R2, 0.875),
    (12, 1.0, 0.5), (13, _R2, 0.875), (14, _R2, 0.875), (15, 0.0, 1.0),
]


#: Vertices of one image from which on a hull is drawn first, and pairs of vertices that are compared at once.
HULL_FROM, VERTEX_PAIRS = 64, 1 << 20


def _hull(pts: np.ndarray) -> np.ndarray:
    """Corners of the convex hull of distinct points in the order (x, y)."""
    def cross(o, a, b):
        return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])

    def side(points) -> list:
        out: list = []
        for p in points:
            while len(out) >= 2 and cross(out[-2], out[-1], p) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    points = [tuple(p) for p in pts]
    return np.array(side(points) + side(points[::-1]))


def _diameters(group: np.ndarray, count: int, vx: np.ndarray, vy: np.ndarray) -> np.ndarray:
    """The largest distance between the points of each group."""
    order = np.lexsort((vy, vx, group))
    pts = np.stack((group[order], vx[order], vy[order]), axis=1)
    pts = pts[np.append(True, (pts[1:] != pts[:-1]).any(1))[:len(pts)]]
    many = np.bincount(pts[:, 0].astype(np.int64), minlength=count)
    parts = np.split(pts, np.cumsum(many)[:-1])
    parts = [p if len(p) < HULL_FROM else np.column_stack((np.full(len(h := _hull(p[:, 1:])), p[0, 0]), h)) for p in parts]
    pts = np.concatenate(parts) if parts else pts
    group = pts[:, 0].astype(np.int64)
    many = np.bincount(group, minlength=count)
    first, pairs = np.cumsum(many) - many, np.cumsum(many[group])
    best = np.zeros(count)
    low = 0
    while low < len(pts):
        high = max(low + 1, int(np.searchsorted(pairs, (pairs[low - 1] if low else 0) + VERTEX_PAIRS, side="right")))
        n = many[group[low:high]]
        a = np.repeat(np.arange(low, high), n)
        b = np.repeat(first[group[low:high]], n) + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
        np.maximum.at(best, group[a], ((pts[a, 1:] - pts[b, 1:]) ** 2).sum(1))
        low = high
    return np.sqrt(best)


SHAPE_NAMES = ["MeshSurface", "PixelSurface", "Perimeter", "PerimeterSurfaceRatio", "Sphericity", "MaximumDiameter", "MajorAxisLength",
               "MinorAxisLength", "Elongation"]


def _shape(x: np.ndarray, y: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The features of the masks of several images, one row each; pixels of an image are distinct."""
    grids, count = _Grids(x, y, np.ones(len(x), dtype=np.int64), sizes, 0), len(sizes)
    group, n = grids.group, sizes.astype(np.float64)
    # Corner codes of all 2×2 cells; a grid's border is empty, so none is of two images.
    cells = np.concatenate((grids.cells, np.zeros(int(grids.wide.max(initial=0)) + 2, dtype=np.int64)))
    at = np.unique(np.concatenate([grids.at, grids.at - 1, grids.at - grids.step, grids.at - grids.step - 1]))
    of = np.searchsorted(grids.base, at, side="right") - 1
    code = cells[at] + 2 * cells[at + 1] + 4 * cells[at + grids.wide[of]] + 8 * cells[at + grids.wide[of] + 1]
    table = np.array(CELL_TABLE)
    perimeter, mesh = _sums(of, count, table[code, 1], table[code, 2])
    mx, my = (v / n for v in _sums(group, count, x, y))
    dx, dy = x - mx[group], y - my[group]
    a, c, b = (v / n for v in _sums(group, count, dx * dx, dy * dy, dx * dy))
    half, rad = (a + c) / 2, np.sqrt(((a - c) / 2) ** 2 + b ** 2)
    l1, l2 = half + rad, np.maximum(half - rad, 0.0)
    # contour vertices: midpoints between an ROI pixel and a 4-neighbour outside it, the outermost of each row
    steps = ((1, 0, np.ones_like(grids.step)), (-1, 0, -np.ones_like(grids.step)), (0, 1, grids.step), (0, -1, -grids.step))
    out = [np.flatnonzero(cells[grids.at + to] == 0) for _, _, to in steps]
    vg = np.concatenate([group[o] for o in out])
    vx, vy = (np.concatenate([v[o] + step[k] / 2 for o, step in zip(out, steps, strict=True)]) for k, v in ((0, x), (1, y)))
    order = np.lexsort((vx, vy, vg))
    vg, vx, vy = vg[order], vx[order], vy[order]
    edge = np.append(True, (vg[1:] != vg[:-1]) | (vy[1:] != vy[:-1]))
    ends = np.concatenate((np.flatnonzero(edge), np.flatnonzero(np.append(edge[1:], True))))
    diameter = _diameters(vg[ends], count, vx[ends], vy[ends])
    return np.stack([mesh, n, perimeter, np.where(mesh == 0, np.nan, perimeter / mesh),
                     np.where(perimeter == 0, np.nan, 2 * np.sqrt(math.pi * mesh) / perimeter), diameter, 4 * np.sqrt(l1), 4 * np.sqrt(l2),
                     np.where(l1 == 0, 0.0, np.sqrt(l2 / l1))], axis=1)


def _shapes(count: int, lists: Sequence[pa.Array]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    columns = [pd.Series(list(np.split(_flat(c), c.offsets.to_numpy()[1:-1] - c.offsets[0].as_py()))) for c in lists]
    parts = [_shape(x, y, sizes) for (x, y), sizes in _stretches(columns)]
    made = np.concatenate(parts) if parts else np.zeros((0, len(SHAPE_NAMES)))
    return dict(zip(SHAPE_NAMES, made.T, strict=True)), np.ones(count, dtype=bool)


def shape2d(fg: DataFrame) -> DataFrame:
    """9 shape features of the mask, computed once per image.

    Areas and perimeter from marching-squares cell codes (saddle cells count
    as two separate corners); axes from the eigenvalues of the population
    covariance of pixel coordinates; the diameter from the convex hull of the
    row-extreme contour vertices.  The masks of many images (each bounded by its image) go through the same array passes.
    """
    px = fg.select("image_id", "x", "y").where("image_id is not null and x is not null and y is not null").repartition("image_id").distinct()
    lists = px.groupBy("image_id").agg(F.collect_list("x").alias("xs"), F.collect_list("y").alias("ys"))
    return _features(lists, "shape2D", SHAPE_NAMES, ["xs", "ys"], _shapes)


# ------------------------------------------------------------- R8 / all ----

def all_features(pixels: DataFrame, fg: DataFrame, channels: Sequence[str] = CHANNELS,
                 bin_width: int = BIN_WIDTH) -> DataFrame:
    """Long feature table ``(image_id, channel, feature, value)``: 7 families ×
    ``channels``; shape features are computed once per image and copied."""
    from ..session import stored

    roi = stored(gathered(discretize(roi_pixels(pixels, fg, channels), bin_width)), "roi")
    stats = texture_stats(roi)
    tex = (firstorder(stats).unionByName(glcm(stats)).unionByName(glrlm(stats)).unionByName(glszm(roi))
           .unionByName(gldm(stats)).unionByName(ngtdm(stats)))
    shape = shape2d(fg).select("image_id", F.explode(F.array(*[F.lit(c) for c in channels])).alias("channel"),
                               "feature", "value")
    return tex.unionByName(shape)


def to_wide(long: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """One row per image, columns ``<channel>__<family>_<Feature>``.
    Pass the known column list to avoid a distinct pass over the names."""
    named = long.select("image_id", F.concat(F.col("channel"), F.lit("__"), F.col("feature")).alias("name"), "value")
    g = named.groupBy("image_id")
    return (g.pivot("name", list(names)) if names is not None else g.pivot("name")).agg(F.first("value"))
