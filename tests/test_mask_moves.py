"""Mask moves, COCO mask forms, IoU crop and copy-paste against numpy on small tables."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohort_spark.operators import annotations as A
from cohort_spark.operators import coco_masks as C
from cohort_spark.operators import mask_geometry as G
from cohort_spark.operators import masks as M

RUNS = "image_id string, obj_id int, start long, len long, height int, width int"


def run_rows(shapes):
    rows = []
    for (img, k), m in shapes.items():
        edge = np.flatnonzero(np.diff(np.concatenate(([0], m.T.reshape(-1).astype(np.int8), [0]))))
        rows += [(img, k, int(s), int(e - s), m.shape[0], m.shape[1]) for s, e in zip(edge[::2], edge[1::2], strict=True)]
    return rows


def shapes_of(runs, size=None):
    out = {}
    for r in runs.collect():
        h, w = r.height, r.width
        flat = out.setdefault((r.image_id, r.obj_id), np.zeros((h, w), dtype=bool).T.reshape(-1))
        assert not flat[r.start:r.start + r.len].any() and r.start + r.len <= h * w
        flat[r.start:r.start + r.len] = True
        out[r.image_id, r.obj_id] = flat
    sizes = {(r.image_id, r.obj_id): (r.height, r.width) for r in runs.collect()}
    return {k: v.reshape(sizes[k][1], sizes[k][0]).T for k, v in out.items()}


@pytest.fixture(scope="module")
def shapes():
    rng = np.random.default_rng(2)
    out = {}
    for i in range(6):
        h, w = int(rng.integers(2, 12)), int(rng.integers(2, 12))
        for k in range(1, 3):
            m = rng.random((h, w)) < [0.2, 0.6, 0.95][i % 3]
            m[rng.integers(0, h), rng.integers(0, w)] = True
            out[f"i{i}", k] = m
    out["full", 1] = np.ones((4, 5), dtype=bool)
    return out


def test_run_tables_move_as_pixels_do(spark, shapes):
    runs = spark.createDataFrame(run_rows(shapes), RUNS)
    assert {k: v.tolist() for k, v in shapes_of(G.mirror(runs)).items()} == {k: v[:, ::-1].tolist() for k, v in shapes.items()}
    for h, w in ((1, 1), (5, 7), (3, 30), (23, 2)):
        want = {k: m[np.arange(h) * m.shape[0] // h][:, np.arange(w) * m.shape[1] // w] for k, m in shapes.items()}
        got = shapes_of(G.stretch(runs, F.lit(h), F.lit(w)))
        assert {k: v.tolist() for k, v in got.items()} == {k: v.tolist() for k, v in want.items() if v.any()}
    for left, top in ((0, 0), (3, 1), (-2, -1), (-20, 0)):
        h, w = 6, 8
        want = {}
        for k, m in shapes.items():
            canvas = np.zeros((h, w), dtype=bool)
            for y, x in zip(*np.nonzero(m), strict=True):
                if 0 <= y + top < h and 0 <= x + left < w:
                    canvas[y + top, x + left] = True
            want[k] = canvas
        got = shapes_of(G.place(runs, F.lit(left), F.lit(top), F.lit(h), F.lit(w)))
        assert {k: v.tolist() for k, v in got.items()} == {k: v.tolist() for k, v in want.items() if v.any()}
    cover = {k: m for k, m in shapes.items() if k[1] == 2}
    got = shapes_of(G.subtract(runs, M.union_runs(spark.createDataFrame(run_rows(cover), RUNS))))
    want = {k: m & ~cover[k[0], 2] if (k[0], 2) in cover else m for k, m in shapes.items()}
    assert {k: v.tolist() for k, v in got.items()} == {k: v.tolist() for k, v in want.items() if v.any()}


def test_masks_take_the_draws_of_their_boxes(spark, shapes):
    """Boxes of moved masks lie in the moved boxes, for each augmentation."""
    rng = np.random.default_rng(4)
    big = {(f"b{i}", 1): np.pad(np.ones((rng.integers(5, 20), rng.integers(5, 20)), dtype=bool), ((3, 9), (4, 6))) for i in range(12)}
    runs = spark.createDataFrame(run_rows(big), RUNS)
    boxes = spark.createDataFrame([(i, k, float(np.nonzero(m)[1].min()), float(np.nonzero(m)[0].min()), float(np.nonzero(m)[1].max() + 1),
                                    float(np.nonzero(m)[0].max() + 1), m.shape[1], m.shape[0]) for (i, k), m in big.items()],
                                  "image_id string, obj_id int, x1 double, y1 double, x2 double, y2 double, width int, height int")
    for move, mask_move, exact in ((A.random_hflip, A.random_hflip_masks, True), (A.zoom_out, A.zoom_out_masks, True),
                                   (lambda d: A.scale_jitter(d, (40, 40)), lambda r: A.scale_jitter_masks(r, (40, 40)), False),
                                   (lambda d: A.fixed_size_crop(d, (17, 18)), lambda r: A.fixed_size_crop_masks(r, (17, 18)), True),
                                   (lambda d: A.shortest_size(d, [20, 30], 60), lambda r: A.shortest_size_masks(r, [20, 30], 60), False)):
        moved = {(r.image_id, r.obj_id): r for r in move(boxes).collect()}
        got = shapes_of(mask_move(runs))
        assert set(got) == set(moved)
        for k, m in got.items():
            y, x = np.nonzero(m)
            r = moved[k]
            assert m.shape == (r.height, r.width)
            near = [abs(a - b) for a, b in ((x.min(), r.x1), (y.min(), r.y1), (x.max() + 1, r.x2), (y.max() + 1, r.y2))]
            assert max(near) <= (0 if exact else 1)


def test_counts_strings():
    rng = np.random.default_rng(1)
    # Published examples of the packing: small values are one character.
    assert C.pack_counts([0, 1]) == "01" and C.pack_counts([]) == "" and C.unpack_counts("").tolist() == []
    for top in (2, 17, 1000, 10**6, 2**40):
        for n in (1, 2, 3, 4, 50):
            counts = rng.integers(0, top, n)
            assert C.unpack_counts(C.pack_counts(counts)).tolist() == counts.tolist()

    def plain(counts):  # one value after the other
        out = ""
        for i, c in enumerate(counts):
            x = c - (counts[i - 2] if i > 2 else 0)
            while True:
                low, x = x & 31, x >> 5
                done = x == (-1 if low & 16 else 0)
                out += chr(48 + low + (0 if done else 32))
                if done:
                    break
        return out

    for _ in range(50):
        counts = rng.integers(0, 5000, rng.integers(1, 30)).tolist()
        assert C.pack_counts(counts) == plain(counts)


def _fill(rings, h, w):
    """Even-odd rule at pixel centres, by counting crossings to the left."""
    out = np.zeros((h, w), dtype=bool)
    for ring in rings:
        pts = list(zip(ring[::2], ring[1::2], strict=True))
        for x in range(w):
            for y in range(h):
                n = 0
                for (x1, y1), (x2, y2) in zip(pts, pts[1:] + pts[:1], strict=True):
                    if min(x1, x2) <= x + 0.5 < max(x1, x2):
                        n += y1 + (x + 0.5 - x1) * (y2 - y1) / (x2 - x1) <= y + 0.5
                out[y, x] |= n % 2 == 1
    return out


def test_all_forms_of_segmentation(spark, shapes, tmp_path):
    rng = np.random.default_rng(6)
    rings = {("p0", 1): [[1, 1, 9, 2, 4, 5, 8, 9, 1, 8]],                          # concave
             ("p0", 2): [[0, 0, 10, 10, 10, 0, 0, 10]],                            # self-crossing
             ("p1", 1): [[-3.5, 2, 6, -2, 14, 13]],                                # over the edges
             ("p1", 2): [], ("p1", 3): [[1, 1, 5, 5]],                             # none, and no area
             ("p2", 1): [[1, 1, 6, 1, 6, 6, 1, 6], [4, 4, 9, 4, 9, 9, 4, 9]]}      # two that overlap
    for n in range(8):
        rings[f"q{n}", 1] = [rng.uniform(-2, 13, 2 * rng.integers(3, 8)).round(3).tolist() for _ in range(rng.integers(1, 3))]
    h, w = 10, 11
    anns, n = [], 0
    for i, ((img, k), m) in enumerate(shapes.items()):
        flat = m.T.reshape(-1)
        cuts = np.flatnonzero(np.diff(np.concatenate(([0], flat.astype(np.int8), [2]))))
        counts = np.diff(np.concatenate(([0], cuts))).tolist()
        form = counts if i % 2 else C.pack_counts(counts)
        anns.append({"image_id": img, "id": k, "segmentation": {"size": list(m.shape), "counts": form}})
    anns += [{"image_id": img, "id": k, "segmentation": r} for (img, k), r in rings.items()]
    path = tmp_path / "anns.json"
    path.write_text(json.dumps({"images": [{"id": 1}], "annotations": anns, "categories": [{"id": 1}]}))
    from cohort_spark.sources import files as FS
    _, table, _ = FS.read_coco(spark, str(path))
    sizes = spark.createDataFrame([(i, h, w) for i in sorted({k[0] for k in rings})], "image_id string, height int, width int")
    got = shapes_of(C.segmentation_runs(table.withColumnRenamed("id", "obj_id"), sizes))
    want = {**shapes, **{k: _fill(r, h, w) for k, r in rings.items()}}
    assert {k: v.tolist() for k, v in got.items()} == {k: v.tolist() for k, v in want.items() if v.any()}


def test_iou_crop(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(120):
        w, h = int(rng.integers(20, 200)), int(rng.integers(20, 200))
        for k in range(rng.integers(1, 4)):
            x, y = rng.uniform(0, w * 0.8), rng.uniform(0, h * 0.8)
            rows.append((f"i{i}", k, x, y, x + rng.uniform(1, w - x), y + rng.uniform(1, h - y), w, h, "label"))
    schema = "image_id string, obj_id int, x1 double, y1 double, x2 double, y2 double, width int, height int, label string"
    df = spark.createDataFrame(rows, schema)
    before = {(r[0], r[1]): r for r in rows}
    images = {r[0] for r in rows}
    for option in (0.0, 0.5):
        out = A.iou_crop(df, options=[option]).collect()
        assert out == A.iou_crop(df.repartition(3), options=[option]).collect() or sorted(out) == sorted(
            A.iou_crop(df.repartition(3), options=[option]).collect())
        assert {r.image_id for r in out} == images
        cropped = 0
        for img in images:
            mine = [r for r in out if r.image_id == img]
            old = [before[img, r.obj_id] for r in mine]
            w, h = mine[0].width, mine[0].height
            assert all((r.width, r.height) == (w, h) and 0 <= r.x1 <= r.x2 <= w and 0 <= r.y1 <= r.y2 <= h for r in mine)
            if (w, h) == (old[0][6], old[0][7]) and all((r.x1, r.y1, r.x2, r.y2) == o[2:6] for r, o in zip(mine, old, strict=True)):
                continue
            cropped += 1
            assert 0.3 * old[0][6] - 1 <= w <= old[0][6] and 0.5 <= w / h <= 2
            # Overlap of the window and a kept box: what is kept of the box, over both.
            best = max(((r.x2 - r.x1) * (r.y2 - r.y1)) / (w * h + (o[4] - o[2]) * (o[5] - o[3]) - (r.x2 - r.x1) * (r.y2 - r.y1))
                       for r, o in zip(mine, old, strict=True))
            assert best >= option - 1e-9
        assert cropped > (60 if option == 0 else 10)
    assert sorted(A.iou_crop(df, options=[1.0]).collect()) == sorted(df.collect())
    assert A.iou_crop(df.limit(0)).count() == 0


def test_iou_crop_is_one_plan(spark, monkeypatch):
    """No job runs and no table is kept while the rounds are planned; boxes without an image stay as they are."""
    def refused(df):
        raise AssertionError("a round was written")

    monkeypatch.setattr("cohort_spark.session.materialize", refused)
    schema = "image_id string, obj_id int, x1 double, y1 double, x2 double, y2 double, width int, height int"
    rows = [(f"i{i}", 1, 10.0, 10.0, 60.0, 50.0, 100, 80) for i in range(30)]
    lost = [(None, 1, 1.0, 1.0, 2.0, 2.0, 100, 80), ("x", 2, None, 1.0, 2.0, 2.0, 100, 80)]
    out = A.iou_crop(spark.createDataFrame(rows + lost, schema), options=[0.3]).collect()
    assert lost[0] in [tuple(r) for r in out] and {r.image_id for r in out} >= {r[0] for r in rows}
    assert sum(r.width < 100 or r.height < 80 for r in out) == 30


def test_copy_paste(spark):
    rng = np.random.default_rng(3)
    shapes, objects, images = {}, [], []
    for i in range(11):
        h, w = (14, 12) if i % 3 else (9, 17)
        images.append((f"i{i}", h, w))
        for k in range(1, [1, 3, 4][i % 3] if i != 5 else 1):
            m = np.zeros((h, w), dtype=bool)
            y, x = rng.integers(0, h - 4), rng.integers(0, w - 4)
            m[y:y + rng.integers(3, 9), x:x + rng.integers(3, 9)] = True
            shapes[f"i{i}", k] = m
            ys, xs = np.nonzero(m)
            objects.append((f"i{i}", k, 1 + k % 2, float(xs.min()), float(ys.min()), float(xs.max()), float(ys.max()), int(k == 3)))
    img = spark.createDataFrame(images, "image_id string, height int, width int")
    obj = spark.createDataFrame(objects, "image_id string, obj_id int, category_id int, x1 double, y1 double, x2 double, y2 double, iscrowd int")
    runs = spark.createDataFrame(run_rows(shapes), RUNS)
    rows, moved = A.copy_paste(img, obj, runs, batch_size=4, seed=7)
    rows, moved = rows.collect(), shapes_of(moved)
    # The order and the draws are those of the seeded hash.
    draw = {r.image_id: r.d for r in img.select("image_id", F.xxhash64("image_id", F.lit(7)).alias("d")).collect()}
    order = sorted(draw, key=lambda i: (draw[i], i))
    batches = [order[a:a + 4] for a in range(0, len(order), 4)]
    source = {b[n]: b[n - 1] for b in batches for n in range(len(b))}
    size = {i: (h, w) for i, h, w in images}
    of = {i: sorted(k for j, k in shapes if j == i) for i in size}
    u = {(r.image_id, r.k): r.u for r in img.select("image_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(5).cast("long"))).alias("k")).select(
        "image_id", "k", (F.pmod(F.xxhash64("image_id", F.lit(7), F.lit(190), "k"), F.lit(1 << 30)) / float(1 << 30)).alias("u")).collect()}
    want = {}
    for i, (h, w) in size.items():
        s = source[i]
        chosen = sorted({of[s][int(u[s, n] * len(of[s]))] for n in range(1, len(of[s]) + 1)})
        sh, sw = size[s]
        pasted = {k: shapes[s, k][np.arange(h) * sh // h][:, np.arange(w) * sw // w] for k in chosen}
        cover = np.any(list(pasted.values()), axis=0) if pasted else np.zeros((h, w), dtype=bool)
        old = {(o[0], o[1]): o for o in objects}
        for k in of[i]:
            left = shapes[i, k] & ~cover
            if pasted and not left.any():
                continue
            ys, xs = np.nonzero(left)
            box = (xs.min(), ys.min(), xs.max(), ys.max()) if pasted else old[i, k][3:7]
            want[i, k] = (box, left, old[i, k][2], old[i, k][7], False)
        top = max(of[i], default=-1) + 1
        for k in chosen:
            o = old[s, k]
            want[i, k + top] = (tuple(np.array(o[3:7]) * [w / sw, h / sh, w / sw, h / sh]), pasted[k], o[2], o[7], True)
    want = {k: v for k, v in want.items() if v[0][2] > v[0][0] and v[0][3] > v[0][1]}
    assert {(r.image_id, r.obj_id) for r in rows} == set(want) and any(v[4] for v in want.values())
    for r in rows:
        box, mask, category, crowd, pasted = want[r.image_id, r.obj_id]
        assert (r.x1, r.y1, r.x2, r.y2) == pytest.approx(tuple(map(float, box)))
        assert (r.area, r.category_id, r.iscrowd, r.pasted) == (mask.sum(), category, crowd, pasted)
        if mask.any():
            assert (moved[r.image_id, r.obj_id] == mask).all()


def test_polygons_shuffle_outlines_not_crossings(spark):
    rows = [("a", 1, [[0.0, 0.0, 9.0, 4.0, 0.0, 8.0, 4.5, 4.0], [6.0, 1.0, 9.5, 1.0, 9.5, 7.0, 6.0, 7.0]]), ("a", 2, [[1.0, 1.0, 3.0, 1.0]]),
            ("b", 1, [[-4.0, -3.0, 40.0, -3.0, 40.0, 50.0, -4.0, 50.0]]), ("b", 2, None), ("c", None, [[2.0, 2.0, 6.0, 2.0, 6.0, 6.0]]),
            # Rows of the same object cross each other: what two of them cover is outside.
            ("d", 1, [[0.0, 0.0, 4.0, 0.0, 4.0, 4.0, 0.0, 4.0]]), ("d", 1, [[2.0, 0.0, 6.0, 0.0, 6.0, 4.0, 2.0, 4.0]])]
    objects = spark.createDataFrame(rows, "image_id string, obj_id int, polygons array<array<double>>")
    sizes = spark.createDataFrame([(i, 12, 16) for i in "abcd"], "image_id string, height int, width int")
    x, y = np.meshgrid(np.arange(16) + 0.5, np.arange(12) + 0.5)
    want = {}
    for k in {r[:2] for r in rows}:
        lists = [r[2] or [] for r in rows if r[:2] == k]
        mask = np.zeros((12, 16), dtype=bool)
        for n in range(max(len(p) for p in lists)):
            inside = np.zeros((12, 16), dtype=int)
            for p in (p[n] for p in lists if len(p) > n and len(p[n]) > 4):
                q = list(zip(p[::2], p[1::2], strict=True))
                for (x1, y1), (x2, y2) in zip(q, q[1:] + q[:1], strict=True):
                    if x1 != x2:
                        inside += (min(x1, x2) <= x) & (x < max(x1, x2)) & (y1 + (x - x1) * (y2 - y1) / (x2 - x1) <= y)
            mask |= inside % 2 == 1
        if mask.any():
            want[k] = mask
    runs = C.polygon_runs(objects, sizes)
    assert runs.dtypes == [("image_id", "string"), ("obj_id", "int"), ("start", "bigint"), ("len", "bigint"), ("height", "int"), ("width", "int")]
    got = shapes_of(runs)
    assert set(got) == set(want)
    assert all((got[k] == want[k]).all() for k in want)
    plan = runs._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    assert plan.index("Exchange") > plan.index("Generate inline")


def test_copy_paste_checkpoints_no_runs(spark, monkeypatch):
    """Only the order of the images goes through a checkpoint of rows; runs are kept as columns."""
    from cohort_spark import session
    kept, materialize = [], session.materialize

    def record(df):
        out = materialize(df)
        kept.append(out.count())
        return out

    monkeypatch.setattr(session, "materialize", record)
    runs = spark.createDataFrame([(i, k, 10 * c, 4, 10, 30) for i in ("a", "b") for k in (1, 2) for c in range(30)], RUNS)
    images = runs.select("image_id", "height", "width").distinct()
    objects = runs.groupBy("image_id", "obj_id").agg(*[F.lit(v).alias(c) for c, v in (
        ("category_id", 1), ("x1", 0.0), ("y1", 0.0), ("x2", 29.0), ("y2", 3.0), ("iscrowd", 0))])
    rows, moved = A.copy_paste(images, objects, runs)
    assert rows.where("pasted").count() > 0 and moved.count() > 0
    assert max(kept) <= 2


def test_subtract_of_repeated_runs(spark):
    """Runs and covers that come twice hide and leave what they do once."""
    runs = spark.createDataFrame([("a", 1, 0, 20, 10, 4), ("a", 2, 32, 3, 10, 4), ("b", 1, 5, 30, 10, 4)], RUNS)
    cover = spark.createDataFrame([("a", 1, 2, 3, 10, 4), ("a", 1, 8, 4, 10, 4), ("a", 1, 31, 9, 10, 4)], RUNS)
    want = [("a", 1, 0, 2), ("a", 1, 5, 3), ("a", 1, 12, 8), ("b", 1, 5, 30)]
    for a, b in ((runs, cover), (runs.union(runs), cover), (runs, cover.union(cover)), (runs.union(runs), cover.union(cover))):
        assert sorted((r.image_id, r.obj_id, r.start, r.len) for r in G.subtract(a, b).collect()) == want


def test_copy_paste_partitions_grow_with_the_runs(spark, monkeypatch):
    """The largest partition of a step holds a share of the runs, however few partitions are the default."""
    from cohort_spark import session
    rows = [(f"i{i:02d}", k, 10 * c + i % 7, 4 - k, 10, 30) for i in range(40) for k in (1, 2) for c in range(30)]
    runs = spark.createDataFrame(rows, RUNS)
    images = runs.select("image_id", "height", "width").distinct()
    objects = runs.groupBy("image_id", "obj_id").agg(*[F.lit(v).alias(c) for c, v in (
        ("category_id", 1), ("x1", 0.0), ("y1", 0.0), ("x2", 29.0), ("y2", 3.0), ("iscrowd", 0))])
    want = sorted(tuple(r) for r in A.copy_paste(images, objects, runs)[0].collect())
    files, stored = {}, session.stored

    def record(df, name):
        out = stored(df, name)
        files[name] = len(out.inputFiles())
        return out

    monkeypatch.setattr(session, "stored", record)
    monkeypatch.setattr(A, "RUNS_A_PART", 60)
    assert sorted(tuple(r) for r in A.copy_paste(images, objects, runs)[0].collect()) == want
    default = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert files["pasted"] > default and files["left"] > default


def test_iou_crop_draws_in_arrays(spark):
    """The draws of many images in one array pass are those of ``uniform``, for any type of key, and no window is
    looked for by a lambda of the plan."""
    for keys in ([1, -5, 1 << 40, None], ["a", "", None, "long name of an image"]):
        kind = "string" if "a" in keys else "long"
        df = spark.createDataFrame([(k,) for k in keys], f"image_id {kind}").select(
            A.uniform(F.col("image_id"), 42, 1400).alias("u"), F.xxhash64("image_id", F.lit(42), F.lit(1401), F.lit(7)).alias("x"),
            F.xxhash64("image_id", F.lit(42)).alias("h")).toPandas()
        h = df.h.to_numpy().view(np.uint64)
        assert A._unit(A._hash_int(1400, h)).tolist() == df.u.tolist()
        assert A._hash_int(7, A._hash_int(1401, h)).view(np.int64).tolist() == df.x.tolist()
    rows = [(f"i{i}", k, 5.0 * k, 10.0, 5.0 * k + 40, 50.0 + i, 100, 80) for i in range(40) for k in range(i % 4)]
    boxes = spark.createDataFrame(rows, "image_id string, obj_id int, x1 double, y1 double, x2 double, y2 double, width int, height int")
    out = A.iou_crop(boxes)
    assert "lambdafunction" not in out._jdf.queryExecution().executedPlan().toString()
    whole = sorted(tuple(r) for r in out.collect())
    cells, A.CROP_CELLS = A.CROP_CELLS, 1
    try:
        assert sorted(tuple(r) for r in A.iou_crop(boxes).collect()) == whole
    finally:
        A.CROP_CELLS = cells


def test_copy_paste_shuffles_masks_as_packed_runs(spark, monkeypatch):
    """Pasted and own masks meet in one shuffle by image, without a row for each run, however the runs lie in their table."""
    from cohort_spark import session
    plans, stored = {}, session.stored

    def record(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return stored(df, name)

    monkeypatch.setattr(session, "stored", record)
    rows = [(f"i{i:02d}", k, 10 * c + (i + c) % 5, 4 - k, 10, 30) for i in range(20) for k in (1, 2) for c in range(i % 9 + 2)]
    runs = spark.createDataFrame(rows, RUNS)
    images = runs.select("image_id", "height", "width").distinct()
    objects = runs.groupBy("image_id", "obj_id").agg(*[F.lit(v).alias(c) for c, v in (
        ("category_id", 1), ("x1", 0.0), ("y1", 0.0), ("x2", 29.0), ("y2", 3.0), ("iscrowd", 0))])
    out, moved = A.copy_paste(images, objects, runs)
    assert plans["left"].count("Exchange hashpartitioning") == 1 and "Generate" not in plans["left"] and "Window" not in plans["left"]
    got, pixels = sorted(tuple(r) for r in out.collect()), shapes_of(moved)
    assert {(r[0], r[1]): r[9] for r in got} == {k: float(v.sum()) for k, v in pixels.items()}
    out, moved = A.copy_paste(images, objects, runs.repartition(7, "start"))
    assert sorted(tuple(r) for r in out.collect()) == got
    assert {k: v.tolist() for k, v in shapes_of(moved).items()} == {k: v.tolist() for k, v in pixels.items()}
