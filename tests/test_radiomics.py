"""Radiomic features against the brute-force numpy reference on small patches."""

import math

import numpy as np
import pandas as pd
import pytest

from cohort_spark.operators import radiomics as R
from tests import radiomics_ref as ref

CH = R.CHANNELS


@pytest.fixture(scope="module")
def patches():
    rng = np.random.default_rng(7)
    out = {}
    for k in range(4):
        h, w = 7, 6
        img = rng.integers(0, 256, size=(h, w, 3))
        # BGR planes; a smooth ramp on one channel gives long runs and large zones
        img[:, :, 0] = (np.arange(w)[None, :] * 40 + k * 10) % 256
        roi = rng.random((h, w)) < 0.75
        roi[h // 2, w // 2] = True
        gray = np.floor((img[:, :, 2] * 299 + img[:, :, 1] * 587 + img[:, :, 0] * 114 + 500) / 1000).astype(int)
        out[f"img{k}"] = (img, gray, roi)
    return out


@pytest.fixture(scope="module")
def features(spark, patches):
    rows_px, rows_fg = [], []
    for iid, (img, gray, roi) in patches.items():
        h, w = roi.shape
        for y in range(h):
            for x in range(w):
                b, g, r = (int(v) for v in img[y, x])
                rows_px.append((iid, x, y, b, g, r, int(gray[y, x])))
                if roi[y, x]:
                    rows_fg.append((iid, 1, x, y))
    px = spark.createDataFrame(rows_px, "image_id string, x int, y int, blue int, green int, red int, gray int")
    fg = spark.createDataFrame(rows_fg, "image_id string, obj_id int, x int, y int")
    long = R.all_features(px, fg).toPandas()
    return {(r.image_id, r.channel, r.feature): r.value for r in long.itertuples()}


def _channel(img, gray, name):
    return {"blue": img[:, :, 0], "green": img[:, :, 1], "red": img[:, :, 2], "gray": gray}[name].astype(int)


def _check(got: dict, want: dict, iid: str, ch: str, family: str):
    for name, val in want.items():
        g = got[(iid, ch, f"{family}_{name}")]
        if val is None:
            assert g is None or (isinstance(g, float) and math.isnan(g)), name
            continue
        assert math.isclose(g, val, rel_tol=1e-7, abs_tol=1e-9), (iid, ch, family, name, g, val)


def test_feature_count(features, patches):
    names = {k[2] for k in features}
    assert len(names) == 102


@pytest.mark.parametrize("ch", CH)
def test_families_match_reference(features, patches, ch):
    for iid, (img, gray, roi) in patches.items():
        v = _channel(img, gray, ch)
        g = ref.levels(v, roi)
        _check(features, ref.firstorder(v, roi, g), iid, ch, "firstorder")
        _check(features, ref.glcm(roi, g), iid, ch, "glcm")
        _check(features, ref.glrlm(roi, g, R.GLRLM_NAMES), iid, ch, "glrlm")
        _check(features, ref.glszm(roi, g, R.GLSZM_NAMES), iid, ch, "glszm")
        _check(features, ref.gldm(roi, g, R.GLDM_NAMES), iid, ch, "gldm")
        _check(features, ref.ngtdm(roi, g), iid, ch, "ngtdm")


def test_shape_axes(features, patches):
    for iid, (_, _, roi) in patches.items():
        _check(features, ref.shape_axes(roi), iid, "gray", "shape2D")
        assert features[(iid, "blue", "shape2D_Perimeter")] > 0


def test_shape_square():
    """A filled k×k square: marching squares gives area (k-1)² and perimeter 4(k-1)."""
    k = 4
    cells = {}
    for cx in range(-1, k):
        for cy in range(-1, k):
            code = 0
            for bit, (dx, dy) in zip((1, 2, 4, 8), ((0, 0), (1, 0), (0, 1), (1, 1))):
                if 0 <= cx + dx < k and 0 <= cy + dy < k:
                    code |= bit
            cells[(cx, cy)] = code
    table = {c: (ln, ar) for c, ln, ar in R.CELL_TABLE}
    area = sum(table[c][1] for c in cells.values())
    perim = sum(table[c][0] for c in cells.values())
    # edge cells carry length 1, corner cells √2/2; interior cells 1 area, edges 1/2, corners 1/8
    assert math.isclose(perim, 4 * (k - 1) + 4 * math.sqrt(2) / 2)
    assert math.isclose(area, (k - 1) ** 2 + 4 * (k - 1) * 0.5 + 4 * 0.125)


def _zones(x, y, g):
    """Size-zone counts of one ROI by flood fill."""
    level, out = dict(zip(zip(x, y), g)), {}
    while level:
        at, v = level.popitem()
        todo, size = [at], 1
        while todo:
            a, b = todo.pop()
            for near in [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]:
                if level.get(near) == v:
                    del level[near]
                    todo.append(near)
                    size += 1
        out[v, size] = out.get((v, size), 0) + 1
    return out


def test_rois_of_a_batch_are_counted_together(monkeypatch):
    """Zones and counts of many ROIs in few array passes, whatever number of grids is held at once."""
    rng = np.random.default_rng(5)
    rois = []
    for _ in range(60):
        y, x = np.nonzero(rng.random(rng.integers(1, 9, 2)) < 0.8)
        if len(x):
            rois.append((x + rng.integers(0, 9), y, rng.integers(1, 4, len(x))))
    xs, ys, gs = (pd.Series([r[k] for r in rois]) for k in range(3))
    passes = []
    real = R._zone_tables
    monkeypatch.setattr(R, "_zone_tables", lambda *a: passes.append(1) or real(*a))
    for cells, most in ((1 << 21, 1), (200, len(rois))):
        monkeypatch.setattr(R, "GRID_CELLS", cells)
        passes.clear()
        got = R._zones_series(xs, ys, gs)
        assert 1 <= len(passes) <= most
        for k, (x, y, g) in enumerate(rois):
            mine = {(i, j): n for i, j, n in zip(got["i"][k], got["j"][k], got["P"][k], strict=True)}
            assert mine == _zones(x.tolist(), y.tolist(), g.tolist())
    tables = R._count_tables(*(np.concatenate([r[k] for r in rois]) for k in (0, 1, 2, 2)), np.array([len(r[0]) for r in rois]), {"gldm"}, 0)
    assert [t[0] for t in tables] == ["lvl", "gldm"]
    for t in tables:
        assert np.bincount(t[2], weights=t[5]).tolist() == [len(r[0]) for r in rois]


def test_families_are_array_passes_over_one_row_an_image_and_channel(spark, patches):
    """Counts of an image and channel stand in one row, and no family joins or regroups them."""
    rows = [(iid, x, y, *(int(v) for v in img[y, x]), int(gray[y, x])) for iid, (img, gray, _) in patches.items() for y in range(7) for x in range(6)]
    px = spark.createDataFrame(rows, "image_id string, x int, y int, blue int, green int, red int, gray int")
    fg = px.where("x > 0").select("image_id", "x", "y")
    stats = R.texture_stats(R.discretize(R.roi_pixels(px, fg)))
    assert stats.count() == len(patches) * len(CH)
    for family in (R.firstorder, R.glcm, R.glrlm, R.gldm, R.ngtdm):
        plan = family(stats)._jdf.queryExecution().executedPlan().toString()
        assert "MergeJoin" not in plan and "HashJoin" not in plan and "Exchange" not in plan
    assert "FlatMapGroups" not in R.shape2d(fg)._jdf.queryExecution().executedPlan().toString()


def test_diameters_with_and_without_a_hull(monkeypatch):
    """A hull first, or all pairs in blocks: the same distances; an image may have one point or points on a line."""
    rng = np.random.default_rng(2)
    group = np.sort(np.concatenate((rng.integers(2, 6, 300), [0, 1, 1, 1])))
    x, y = rng.integers(0, 30, len(group)) / 2, rng.integers(0, 30, len(group)) / 2
    x[group == 1], y[group == 1] = [0, 2, 5], [0, 2, 5]
    want = [max(math.dist(a, b) for a in p for b in p) for p in (list(zip(x[group == g], y[group == g])) for g in range(6))]
    for hull, pairs in ((2, 1 << 20), (10 ** 9, 1 << 20), (10 ** 9, 7), (40, 100)):
        monkeypatch.setattr(R, "HULL_FROM", hull)
        monkeypatch.setattr(R, "VERTEX_PAIRS", pairs)
        assert R._diameters(group, 6, x, y).tolist() == pytest.approx(want)
