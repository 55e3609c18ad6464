"""COCO box evaluation against a straightforward single-process implementation
of the published protocol on a small random fixture."""

import numpy as np
import pytest

from cohort_spark.operators import cocoeval as C

def _iou(d, g, crowd):
    ix = max(0.0, min(d[0] + d[2], g[0] + g[2]) - max(d[0], g[0]))
    iy = max(0.0, min(d[1] + d[3], g[1] + g[3]) - max(d[1], g[1]))
    inter = ix * iy
    union = d[2] * d[3] if crowd else d[2] * d[3] + g[2] * g[3] - inter
    return inter / union if union > 0 else 0.0


def _mask_iou(d, g, crowd):
    inter = (d & g).sum()
    union = d.sum() if crowd else (d | g).sum()
    return inter / union if union else 0.0


def _oks(d, g, crowd):
    points, box, area = g
    var = (2 * np.array(C.SIGMAS)) ** 2
    if (points[:, 2] > 0).any():
        dx, dy = d[:, 0] - points[:, 0], d[:, 1] - points[:, 1]
    else:
        x, y, w, h = box
        dx = np.maximum(0, x - w - d[:, 0]) + np.maximum(0, d[:, 0] - x - 2 * w)
        dy = np.maximum(0, y - h - d[:, 1]) + np.maximum(0, d[:, 1] - y - 2 * h)
    e = (dx ** 2 + dy ** 2) / var / (area + np.spacing(1)) / 2
    if (points[:, 2] > 0).any():
        e = e[points[:, 2] > 0]
    return np.exp(-e).mean()


def reference(dets, gts, similarity=_iou, form=None):
    """dets: (img, cat, id, score, shape, area); gts: (img, cat, shape, crowd, area, ignored).
    Returns the summary numbers of ``form``."""
    form = form or C.report("bbox")
    areas = [C.AREAS[n] for n in form.areas]
    imgs = sorted({g[0] for g in gts} | {d[0] for d in dets})
    cats = sorted({g[1] for g in gts})
    T, R, K, A, M = len(C.IOU_THRS), len(C.REC_THRS), len(cats), len(areas), len(form.max_dets)
    precision = -np.ones((T, R, K, A, M))
    recall = -np.ones((T, K, A, M))
    for k, cat in enumerate(cats):
        for a, (lo, hi) in enumerate(areas):
            per_img = []
            npig = 0
            for img in imgs:
                g = [x for x in gts if x[0] == img and x[1] == cat]
                d = sorted([x for x in dets if x[0] == img and x[1] == cat], key=lambda x: (-x[3], x[2]))[:form.max_dets[-1]]
                g_ig = [x[3] or x[5] or not (lo <= x[4] <= hi) for x in g]
                order = sorted(range(len(g)), key=lambda i: g_ig[i])
                npig += sum(1 for v in g_ig if not v)
                codes = np.zeros((T, len(d)), dtype=int)  # 1 tp, 0 fp, 2 ignore
                for t, thr in enumerate(C.IOU_THRS):
                    taken = [False] * len(g)
                    for di, dd in enumerate(d):
                        best, best_iou = -1, min(thr, 1 - 1e-10)
                        for gi in order:
                            if taken[gi] and not g[gi][3]:
                                continue
                            if best > -1 and not g_ig[best] and g_ig[gi]:
                                break
                            v = similarity(dd[4], g[gi][2], g[gi][3])
                            if v < best_iou:
                                continue
                            best_iou, best = v, gi
                        if best == -1:
                            codes[t, di] = 2 if not (lo <= dd[5] <= hi) else 0
                        else:
                            taken[best] = True
                            codes[t, di] = 2 if g_ig[best] else 1
                per_img.append((img, d, codes))
            if npig == 0:
                continue
            for m, md in enumerate(form.max_dets):
                rows = []
                for img, d, codes in per_img:
                    for di, dd in enumerate(d[:md]):
                        rows.append((-dd[3], img, di, codes[:, di]))
                rows.sort(key=lambda r: (r[0], r[1], r[2]))
                for t in range(T):
                    c = np.array([r[3][t] for r in rows], dtype=int)
                    keep = c != 2
                    tp = np.cumsum((c == 1)[keep])
                    fp = np.cumsum((c == 0)[keep])
                    rc = tp / npig
                    pr = tp / (tp + fp + np.spacing(1))
                    recall[t, k, a, m] = rc[-1] if len(rc) else 0
                    pr = list(pr)
                    for i in range(len(pr) - 1, 0, -1):
                        pr[i - 1] = max(pr[i - 1], pr[i])
                    q = np.zeros(R)
                    inds = np.searchsorted(rc, C.REC_THRS, side="left")
                    for ri, pi in enumerate(inds):
                        if pi < len(pr):
                            q[ri] = pr[pi]
                    precision[t, :, k, a, m] = q
    out = []
    for _, column, area, n, t in form.lines:
        a, m = form.areas.index(area), form.max_dets.index(n)
        x = precision[:, :, :, a, m] if column == "ap" else recall[:, :, a, m]
        x = x if t is None else x[[C.IOU_THRS.index(t)]]
        x = x[x > -1]
        out.append(float(np.mean(x)) if x.size else -1.0)
    return out


@pytest.fixture(scope="module")
def fixture():
    rng = np.random.default_rng(11)
    gts, dets = [], []
    did = 0
    for img in range(25):
        for _ in range(rng.integers(0, 4)):
            cat = int(rng.integers(1, 3))
            box = [float(rng.integers(0, 150)), float(rng.integers(0, 150)), float(rng.integers(2, 120)),
                   float(rng.integers(2, 120))]
            crowd = bool(rng.random() < 0.1)
            gts.append((img, cat, box, crowd, box[2] * box[3], False))
            for _ in range(rng.integers(0, 3)):
                jit = [box[0] + rng.normal(0, 6), box[1] + rng.normal(0, 6), max(1.0, box[2] + rng.normal(0, 8)),
                       max(1.0, box[3] + rng.normal(0, 8))]
                dets.append((img, cat, did, float(round(rng.random(), 2)), jit, jit[2] * jit[3]))
                did += 1
        for _ in range(rng.integers(0, 2)):  # false positives
            box = [float(rng.integers(0, 150)), float(rng.integers(0, 150)), 20.0, 20.0]
            dets.append((img, int(rng.integers(1, 3)), did, float(round(rng.random(), 2)), box, 400.0))
            did += 1
    return dets, gts


def test_coco_summary_matches_reference(spark, fixture):
    dets, gts = fixture
    d = spark.createDataFrame([(i, c, k, s, b[0], b[1], b[2], b[3]) for i, c, k, s, b, _ in dets],
                              "image_id long, category_id int, det_id long, score double, x double, y double, "
                              "w double, h double")
    g = spark.createDataFrame([(i, c, b[0], b[1], b[2], b[3], int(cr), a) for i, c, b, cr, a, _ in gts],
                              "image_id long, category_id int, x double, y double, w double, h double, "
                              "iscrowd int, area double")
    got = [r.value for r in C.evaluate(d, g).collect()]
    want = reference(dets, gts)
    assert got == pytest.approx(want, abs=1e-9)
    got = [r.value for r in C.evaluate(d, g, max_dets=[2, 5]).collect()]
    assert got == pytest.approx(reference(dets, gts, form=C.report("bbox", [2, 5])), abs=1e-9)


def _runs(shapes, id_name):
    rows = []
    for (img, k), m in shapes.items():
        flat = np.flatnonzero(np.diff(np.concatenate(([0], m.T.reshape(-1).astype(np.int8), [0]))))
        rows += [(img, k, int(s), int(e - s), m.shape[0], m.shape[1]) for s, e in zip(flat[::2], flat[1::2], strict=True)]
    return rows, f"image_id long, {id_name} long, start long, len long, height int, width int"


def test_mask_summary_matches_reference(spark):
    """Crowds, tied scores, repeated shapes, all area bands, objects without pixels."""
    rng = np.random.default_rng(5)
    gts, dets, g_shapes, d_shapes = [], [], {}, {}
    did = 0
    for img in range(18):
        h, w = (130, 110) if img % 3 else (40, 50)
        for k in range(rng.integers(0, 5)):
            m = np.zeros((h, w), dtype=bool)
            y, x = rng.integers(0, h - 8), rng.integers(0, w - 8)
            m[y:y + rng.integers(3, h), x:x + rng.integers(3, w)] = True
            m[y + 2:y + 4, x:x + 3] = False
            cat, crowd = int(rng.integers(1, 3)), bool(rng.random() < 0.2)
            gts.append((img, cat, m, crowd, float(m.sum()), False))
            g_shapes[img, k] = m
            for _ in range(rng.integers(0, 4)):
                n = np.roll(m, (rng.integers(-2, 3), rng.integers(-2, 3)), (0, 1)) if rng.random() < 0.7 else m.copy()
                if rng.random() < 0.1:
                    n[:] = False
                dets.append((img, cat, did, [0.25, 0.5, 0.75][rng.integers(0, 3)], n, float(n.sum())))
                d_shapes[img, did] = n
                did += 1
    numbers = list(g_shapes)
    d = spark.createDataFrame([x[:4] for x in dets], "image_id long, category_id int, det_id long, score double")
    g = spark.createDataFrame([(i, c, k, int(cr), a) for (i, c, _, cr, a, _), (_, k) in zip(gts, numbers, strict=True)],
                              "image_id long, category_id int, obj_id long, iscrowd int, area double")
    dr, gr = (spark.createDataFrame(*_runs(x, n)) for x, n in ((d_shapes, "det_id"), (g_shapes, "obj_id")))
    got = [r.value for r in C.evaluate(d, g, "segm", dr, gr).collect()]
    want = reference(dets, gts, _mask_iou, C.report("segm"))
    assert got == pytest.approx(want, abs=1e-9) and all(0 < x < 1 for x in want[:3])


def test_keypoint_summary_matches_reference(spark):
    """Unlabelled points, targets without any, crowds, ties, small targets."""
    rng = np.random.default_rng(9)
    gts, dets = [], []
    for img in range(20):
        for k in range(rng.integers(0, 4)):
            box = (float(rng.integers(0, 80)), float(rng.integers(0, 80)), float(rng.integers(20, 200)), float(rng.integers(20, 200)))
            points = np.stack([box[0] + rng.random(17) * box[2], box[1] + rng.random(17) * box[3], rng.integers(0, 3, 17)], axis=1)
            if rng.random() < 0.2:
                points[:, 2] = 0
            area, crowd = box[2] * box[3] * 0.7, bool(rng.random() < 0.15)
            gts.append((img, 1, (points, box, area), crowd, area, not (points[:, 2] > 0).any()))
            for _ in range(rng.integers(0, 4)):
                at = points.copy()
                at[:, :2] += rng.normal(0, [1, 4, 12][rng.integers(0, 3)], (17, 2))
                side = at[:, :2].max(0) - at[:, :2].min(0)
                dets.append((img, 1, len(dets), float(rng.integers(0, 4)) / 4, at, side[0] * side[1]))
    kp = "array<struct<x double, y double, v int>>"

    def structs(p):
        return [(float(x), float(y), int(v)) for x, y, v in p]

    d = spark.createDataFrame([(i, c, k, s, structs(p)) for i, c, k, s, p, _ in dets],
                              f"image_id long, category_id int, det_id long, score double, keypoints {kp}")
    g = spark.createDataFrame([(i, c, n, int(cr), float(a), *box, structs(p)) for n, (i, c, (p, box, _), cr, a, _) in enumerate(gts)],
                              f"image_id long, category_id int, obj_id long, iscrowd int, area double, x double, y double, w double, h double, keypoints {kp}")
    got = [r.value for r in C.evaluate(d, g, "keypoints").collect()]
    want = reference(dets, gts, _oks, C.report("keypoints"))
    assert got == pytest.approx(want, abs=1e-9) and 0 < want[0] < 1
    with pytest.raises(ValueError):
        C.evaluate(d, g, "panoptic")


def test_accumulation_keeps_one_row_a_detection(spark, fixture, monkeypatch):
    """Codes of all ranges and thresholds travel in one row; many parts of one category give the same numbers."""
    dets, gts = fixture
    sizes = []
    real = C.materialize

    def counted(df):
        made = real(df)
        sizes.append(made.count())
        return made

    monkeypatch.setattr(C, "materialize", counted)
    d = spark.createDataFrame([(i, c, k, s, *b) for i, c, k, s, b, _ in dets],
                              "image_id long, category_id int, det_id long, score double, x double, y double, w double, h double")
    g = spark.createDataFrame([(i, c, *b, int(cr), a) for i, c, b, cr, a, _ in gts],
                              "image_id long, category_id int, x double, y double, w double, h double, iscrowd int, area double")
    want = {r.metric: r.value for r in C.evaluate(d, g).collect()}
    assert max(sizes) <= len(dets)
    monkeypatch.setattr(C, "range_partitions", lambda df: 40)
    monkeypatch.setattr(C, "STEP", 1)
    got = {r.metric: r.value for r in C.evaluate(d, g).collect()}
    assert got == pytest.approx(want, abs=1e-12)


def test_packed_runs_and_points_give_back_their_numbers():
    """Scattered, overlapping and touching runs; whole, narrow and wide coordinates, missing points."""
    import pyarrow as pa

    from cohort_spark.operators import coco_packed as P
    rng = np.random.default_rng(3)
    start, length = rng.integers(0, 1 << 40, 200), rng.integers(0, 1 << 20, 200)
    start[:50] = np.sort(start[:50])
    new = rng.random(200) < 0.3
    new[0] = True
    row, s, n = P.unpack_runs(P.encode_runs(start, length, new))
    assert (row == np.cumsum(new) - 1).all() and (s == start).all() and (n == length).all()
    points = [[(float(i), 2.0 * i, i % 2) for i in range(17)], [(i / 16, i / 3, 0) for i in range(17)], [(0.5, 0.25, 1)] * 17,
              None, [], [(1e9, None, None)] * 17, [(7.0, 8.0, 2)] * 3]
    kind = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64()), ("v", pa.int32())]))
    at, shown, state = P.unpack_points(P.encode_points(pa.array([p and [dict(zip("xyv", q, strict=True)) for q in p] for p in points], kind), 17), 17)
    for k, p in enumerate(points):
        want = np.full((2, 17), np.nan)
        for i, q in enumerate(p or []):
            want[:, i] = [np.nan if c is None else c for c in q[:2]]
        assert np.array_equal(at[k], want, equal_nan=True)
        assert shown[k].tolist() == [bool(q[2]) for q in p or []] + [False] * (17 - len(p or []))
    assert state.tolist() == [P.LABELLED, P.ABSENT, P.LABELLED, P.UNKNOWN, P.ABSENT, P.UNKNOWN, P.LABELLED]


@pytest.mark.parametrize("kind", ["bbox", "segm", "keypoints"])
def test_matching_shuffles_each_input_once(spark, monkeypatch, kind):
    """Neither pairs nor runs by column are shuffled, and the ordering is drawn from written rows."""
    plans = []
    real = C.stored
    monkeypatch.setattr(C, "stored", lambda df, name: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or real(df, name))
    kp = [(float(i), float(i), 2) for i in range(17)]
    rows = [(i // 4, i % 2, i, i / 50, 1.0, 1.0, 8.0, 8.0, 64.0, 0, kp) for i in range(50)]
    fields = "image_id long, category_id int, det_id long, score double, x double, y double, w double, h double, area double, iscrowd int, keypoints array<struct<x double, y double, v int>>"
    d = spark.createDataFrame(rows, fields)
    g = d.drop("score").withColumnRenamed("det_id", "obj_id")
    runs = spark.createDataFrame([(i // 4, i, i % 4 * 10 + c * 50, 8, 50, 9) for i in range(50) for c in range(3)],
                                 "image_id long, det_id long, start long, len long, height int, width int")
    got = {r.metric: r.value for r in C.evaluate(d, g, kind, runs, runs.withColumnRenamed("det_id", "obj_id")).collect()}
    assert got["AP"] == pytest.approx(1.0)
    [matched] = [p for name, p in plans if name == "matched"]
    assert matched.count("Exchange hashpartitioning(image_id") == (4 if kind == "segm" else 2)


def test_masks_with_overlapping_and_scattered_runs(spark):
    """A mask's runs may overlap, each counting for itself, and lie anywhere in the table."""
    rng = np.random.default_rng(8)
    parts = {(side, o): [(int(s), int(n)) for s, n in zip(rng.integers(0, 80, 6), rng.integers(1, 15, 6), strict=True)]
             for side in "dg" for o in range(5)}
    want = {}
    for d in range(5):
        for g in range(5):
            both = sum(max(0, min(a + m, b + n) - max(a, b)) for a, m in parts["d", d] for b, n in parts["g", g])
            own, other = (sum(n for _, n in parts[k]) for k in (("d", d), ("g", g)))
            if both:
                want[d, g] = both / (own if g == 0 else own + other - both) if (own if g == 0 else own + other - both) > 0 else 0.0
    runs = {}
    for side, name in (("d", "det_id"), ("g", "obj_id")):
        rows = [(1, o, s, n, 100, 1) for k in range(6) for (x, o), p in parts.items() if x == side for s, n in [p[k]]]
        runs[side] = spark.createDataFrame(rows, f"image_id long, {name} long, start long, len long, height int, width int")
    top = C.top_detections(spark.createDataFrame([(1, 1, o, 0.5) for o in range(5)], "image_id long, category_id int, det_id long, score double"), 100)
    targets = C.numbered_targets(spark.createDataFrame([(1, 1, o, int(o == 0), 9.0) for o in range(5)],
                                                       "image_id long, category_id int, obj_id long, iscrowd int, area double"))
    got = {(r.det_id, r.obj_id): r.iou for r in C.mask_similarity(top, targets, runs["d"], runs["g"]).collect()}
    assert got == pytest.approx(want)  # also 0, where counted overlaps make the union empty


def test_points_of_unknown_labels_match_nothing(spark):
    """A target whose labels are null has no similarity; the division by its points is not an error."""
    kp = "array<struct<x double, y double, v int>>"
    points = [(float(i), float(i), None) for i in range(17)]
    d = spark.createDataFrame([(1, 1, 1, 0.5, points)], f"image_id long, category_id int, det_id long, score double, keypoints {kp}")
    g = spark.createDataFrame([(1, 1, 1, 0, 9.0, 0.0, 0.0, 17.0, 17.0, points)],
                              f"image_id long, category_id int, obj_id long, iscrowd int, area double, x double, y double, w double, h double, keypoints {kp}")
    [row] = C.keypoint_similarity(C.top_detections(d, 20), C.numbered_targets(g)).collect()
    assert row.iou is None
    assert {r.metric: r.value for r in C.evaluate(d, g, "keypoints").collect()}["AR"] in (0.0, -1.0)
