"""Property checks of single operators on small hand-made or generated tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohort_spark.operators import annotations as A
from cohort_spark.operators import evaluate as E
from cohort_spark.operators import match, profile, sampling, trainlog
from cohort_spark.operators import masks as M
from tests.conftest import SF_SMALL


def test_quantile_methods_match_numpy(spark):
    rng = np.random.default_rng(1)
    rows = [("a" if i % 3 else "b", float(v)) for i, v in enumerate(rng.integers(0, 40, 301))]
    df = spark.createDataFrame(rows, "k string, v double")
    probs = [0.1, 0.25, 0.5, 0.75, 0.9]
    for method, npm in (("linear", "linear"), ("lower", "lower")):
        got = {r.k: r for r in profile.quantiles(df, ["k"], "v", probs, method, [f"q{i}" for i in range(5)]).collect()}
        for k in ("a", "b"):
            vals = np.array([v for kk, v in rows if kk == k])
            want = np.percentile(vals, [p * 100 for p in probs], method=npm)
            assert [got[k][f"q{i}"] for i in range(5)] == pytest.approx(list(want))
    # nearest rank: index round_half_away((n-1)·q)
    got = profile.quantiles(df, [], "v", [0.25], "nearest", ["q"]).collect()[0].q
    vals = np.sort([v for _, v in rows])
    assert got == vals[int(math.floor((len(vals) - 1) * 0.25 + 0.5))]


def test_dense_index_and_running_sums_with_a_hot_key(spark):
    rows = [("hot" if i % 10 < 7 else f"k{i % 4}", i, 1) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, pos int, one int")
    ids = match.dense_index(df, ["pos"], "id", 0, partitions=7).select("pos", "id").collect()
    assert sorted(r.id for r in ids) == list(range(2000))
    assert all(r.id == r.pos for r in ids)
    rs = match.running_sums(df, ["k"], [F.col("pos")], ["one"], partitions=7).collect()
    by_key = {}
    for r in sorted(rs, key=lambda r: r.pos):
        by_key[r.k] = by_key.get(r.k, 0) + 1
        assert r.cum_one == by_key[r.k]


def test_exact_split_sizes_and_disjoint(spark):
    df = spark.range(1003).select(F.col("id").cast("string").alias("sid"), F.col("id"))
    out = sampling.exact_split(df, sampling.draw(F.col("id"), 42, "minstd"), "sid").collect()
    n = {s: sum(1 for r in out if r.split == s) for s in ("train", "val", "test")}
    train, val, test = sampling.split_sizes(1003)
    assert n == {"train": train, "val": val, "test": test}
    assert len({r.sid for r in out}) == 1003


def test_sample_is_reproducible_and_exact(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("sid"))
    a = sampling.sample_n(df, 37, sampling.draw("sid", 7), "sid").collect()
    b = sampling.sample_n(df, 37, sampling.draw("sid", 7), "sid").collect()
    assert len(a) == 37 and [r.sid for r in a] == [r.sid for r in b]


def test_confusion_properties(spark):
    import __spark_entry__ as entry
    q = entry.queries()
    conf = q["V1"](spark, SF_SMALL).toPandas()
    assert ((conf.TP + conf.FP + conf.FN + conf.TN) == 64).all()
    m = q["V2"](spark, SF_SMALL).toPandas()
    assert (m.iou <= m.dice + 1e-12).all()


def test_percentages_sum_to_100(spark):
    import __spark_entry__ as entry
    g21 = entry.queries()["G21"](spark, SF_SMALL).toPandas()
    assert np.allclose(g21.drop(columns=["target"]).sum(axis=1), 100.0)


def test_flip_twice_is_identity(spark):
    df = spark.createDataFrame([(1, 3.0, 4.0, 10.0, 20.0, 50.0)], "image_id long, x1 double, y1 double, x2 double, "
                                                                  "y2 double, width double")
    once = A.hflip(df)
    twice = A.hflip(once).collect()[0]
    assert (twice.x1, twice.x2) == (3.0, 10.0)
    assert once.collect()[0].x1 == 40.0


def test_keypoints_visible_and_reshape(spark):
    df = spark.createDataFrame([([1.0, 2.0, 2.0, 3.0, 4.0, 0.0, 5.0, 6.0, 1.0],)], "kp array<double>")
    r = df.select(A.visible_keypoints("kp").alias("n"), A.keypoints_to_struct("kp").alias("s")).collect()[0]
    assert r.n == 2 and [p.v for p in r.s] == [2.0, 0.0, 1.0]
    back = df.select(A.keypoints_to_flat(A.keypoints_to_struct("kp")).alias("f")).collect()[0].f
    assert list(back) == [1.0, 2.0, 2.0, 3.0, 4.0, 0.0, 5.0, 6.0, 1.0]


def test_augmentations_keep_boxes_inside(spark):
    rows = [(i, 10.0 + i, 5.0, 50.0 + i, 40.0, 100.0, 80.0) for i in range(50)]
    df = spark.createDataFrame(rows, "image_id long, x1 double, y1 double, x2 double, y2 double, width double, "
                                     "height double")
    z = A.zoom_out(df, p=1.0).collect()
    assert all(r.x2 <= r.width and r.y2 <= r.height and r.x1 >= 0 for r in z)
    c = A.fixed_size_crop(df, (50, 50)).collect()
    assert all(0 <= r.x1 < r.x2 <= 50 and 0 <= r.y1 < r.y2 <= 50 for r in c)
    s = A.shortest_size(df, [64, 32], 128).collect()
    assert all(min(r.width, r.height) in (64, 32) or max(r.width, r.height) <= 128 for r in s)
    j = A.scale_jitter(df, (100, 100)).collect()
    assert all(r.x2 <= r.width + 1e-9 for r in j)
    f = A.random_hflip(df, p=0.5).collect()
    assert 0 < sum(1 for a, b in zip(rows, sorted(f, key=lambda r: r.image_id)) if a[1] != b.x1) < 50


def test_early_stopping_rule(spark):
    losses = [5.0, 4.0, 4.0, 4.5, 4.6, 4.7, 3.0, 3.1, 3.2]
    h = spark.createDataFrame([(i + 1, v) for i, v in enumerate(losses)], "epochs int, train_loss double")
    es = trainlog.early_stopping(h, patience=2).orderBy("epochs").collect()
    assert [r.counter for r in es] == [0, 0, 0, 1, 2, 3, 0, 1, 2]
    assert [r.stop for r in es] == [False] * 4 + [True] * 5
    best = trainlog.best_epoch(h, "train_loss", mode="min", last_among_ties=True).collect()[0]
    assert best.epochs == 7


def test_union_and_overlap_of_runs(spark):
    sizes = spark.createDataFrame([("i", 4, 4)], "image_id string, height int, width int")
    a = spark.createDataFrame([("i", 1, 0, 0), ("i", 1, 0, 1), ("i", 1, 1, 1)], "image_id string, obj_id int, x int, y int")
    b = spark.createDataFrame([("i", 2, 0, 1), ("i", 2, 0, 2), ("i", 2, 3, 3)], "image_id string, obj_id int, x int, y int")
    ra, rb = M.encode_runs(a, sizes), M.encode_runs(b, sizes)
    assert M.overlap(ra, rb).collect()[0].intersection == 1
    u = M.union_runs(ra.unionByName(rb))
    assert M.areas(u, per_object=False).collect()[0].area == 5
    conf = E.confusion(ra, rb, sizes).collect()[0]
    assert (conf.TP, conf.FP, conf.FN, conf.TN) == (1.0, 2.0, 2.0, 11.0)
    # Runs that go over several columns.
    long = spark.createDataFrame([("i", 1, 2, 9, 4, 4)], "image_id string, obj_id int, start long, len long, height int, width int")
    other = spark.createDataFrame([("i", 1, 0, 3, 4, 4), ("i", 1, 6, 9, 4, 4)], long.schema)
    assert M.overlap(long, other).collect()[0].intersection == 6


def test_only_the_best_prediction_counts(spark):
    sizes = spark.createDataFrame([("i", 4, 4)], "image_id string, height int, width int")
    runs = "image_id string, obj_id int, start long, len long, height int, width int"
    target = spark.createDataFrame([("i", 1, 0, 4, 4, 4)], runs)
    preds = spark.createDataFrame([("i", 0, 0, 4, 4, 4), ("i", 1, 8, 6, 4, 4)], runs)
    scores = spark.createDataFrame([("i", 0, 0.9), ("i", 1, 0.4)], "image_id string, obj_id int, score double")
    conf = E.confusion(target, preds, sizes, scores).collect()[0]
    assert (conf.TP, conf.FP, conf.FN, conf.TN) == (4.0, 0.0, 0.0, 12.0)


def _bilinear(mask, h, w):
    def axis(n, out):
        at = np.maximum((np.arange(out) + 0.5) * n / out - 0.5, 0)
        low = at.astype(int)
        return low, np.minimum(low + 1, n - 1), at - low

    y0, y1, fy = axis(mask.shape[0], h)
    x0, x1, fx = axis(mask.shape[1], w)
    top = mask[y0][:, x0] * (1 - fx) + mask[y0][:, x1] * fx
    low = mask[y1][:, x0] * (1 - fx) + mask[y1][:, x1] * fx
    return top * (1 - fy[:, None]) + low * fy[:, None]


def test_the_evaluation_job_resizes_the_best_prediction(spark):
    """None to three scored predictions of several sizes; ties, up, down and uneven scaling."""
    from cohort_spark.plans.jobs import evaluate_segmentation
    rng = np.random.default_rng(7)
    shapes = [(4, 4), (6, 3), (9, 10), (3, 8), (6, 7), (12, 13), (1, 1)]
    objects, soft, targets, sizes, want = [], [], [], [], {}
    for n, (h, w) in enumerate(shapes * 2):
        name, target = f"i{n}", rng.random((6, 7)) < 0.4
        target[0, 0] = True
        sizes.append((name, 6, 7))
        targets += [(name, 1, int(x), int(y)) for y, x in zip(*np.nonzero(target), strict=True)]
        best = np.zeros((6, 7))
        for k in range(n % 4):
            mask, score = rng.random((h, w)), [0.5, 0.9, 0.9][k]
            objects.append((name, k, score, h, w))
            soft += [(name, k, x, y, float(mask[y, x])) for y in range(h) for x in range(w)]
            if k == 0 or k == 1:
                best = _bilinear(mask, 6, 7)
        p = best > 0.5
        tp, fp, fn = (p & target).sum(), (p & ~target).sum(), (~p & target).sum()
        want[name] = (2 * tp + 1e-6) / (2 * tp + fp + fn + 1e-6)
    sizes = spark.createDataFrame(sizes, "image_id string, height int, width int")
    target = M.encode_runs(spark.createDataFrame(targets, "image_id string, obj_id int, x int, y int"), sizes)
    objects = spark.createDataFrame(objects, "image_id string, obj_id int, score double, height int, width int")
    soft = spark.createDataFrame(soft, "image_id string, obj_id int, x int, y int, value double")
    _, long = evaluate_segmentation(target, objects, soft, sizes)
    got = {r.image_id: r.value for r in long.where("metric = 'dice_scores'").collect()}
    assert got == pytest.approx(want, abs=1e-12)


def test_masks_of_another_size_are_refused(spark):
    sizes = spark.createDataFrame([("i", 8, 8)], "image_id string, height int, width int")
    runs = "image_id string, obj_id int, start long, len long, height int, width int"
    target = spark.createDataFrame([("i", 1, 0, 8, 8, 8)], runs)
    pred = spark.createDataFrame([("i", 1, 0, 4, 4, 4)], runs)
    with pytest.raises(Exception, match="resize them first"):
        E.confusion(target, pred, sizes).collect()


def test_matrices_count_unlisted_values(spark):
    rows = [("r", "a")] * 2 + [("r", "b")] + [("r", "new")] + [("s", "new")]
    df = spark.createDataFrame(rows, "r string, c string")
    pct = {x.r: x for x in profile.percent_matrix(df, "r", "c", ["a", "b"]).collect()}
    assert (pct["r"].a, pct["r"].b, pct["s"].a) == (50.0, 25.0, 0.0)
    assert profile.count_matrix(df, "r", "c").columns == ["r", "a", "b", "new"]
    rate = {x.r: x for x in profile.matrix_with_rate(df, "r", "c", "a").collect()}
    assert (rate["r"].Total, rate["r"].pct_positive, rate["s"].pct_positive) == (4, 50.0, 0.0)
    many = spark.range(1001).select(F.col("id").cast("string").alias("c"))
    assert len(profile.distinct_values(many, "c")) == 1001
    with pytest.raises(ValueError, match="count_long"):
        profile.distinct_values(spark.range(profile.MAX_HEADER + 1).withColumn("c", F.col("id")), "c")
    long = {(x.r, x.c): (x["count"], x.pct) for x in profile.count_long(df, "r", "c").collect()}
    assert long == {("r", "a"): (2, 50.0), ("r", "b"): (1, 25.0), ("r", "new"): (1, 25.0), ("s", "new"): (1, 100.0)}


def test_ranges_follow_the_input(spark, monkeypatch):
    df = spark.range(1000).withColumn("k", F.col("id") % 7)
    base = match.range_partitions(df)
    monkeypatch.setattr(match, "RANGE_BYTES", 100)
    assert match.range_partitions(df) == max(base, -(-1000 * 8 // 100))
    got = match.running_sums(df, ["k"], [F.col("id")], ["id"]).where("k = 3").orderBy("id").collect()
    assert [r.cum_id for r in got] == np.cumsum(np.arange(3, 1000, 7)).tolist()


def test_connected_groups_and_leak_free_split(spark):
    rng = np.random.default_rng(5)
    rows = [(f"i{n:04d}", None if n % 5 == 0 else f"l{rng.integers(0, 260)}", None if n % 7 == 0 else int(rng.integers(0, 400))) for n in range(400)]
    rows += [(f"chain{n:02d}", f"c{n // 2}", 10_000 + (n + 1) // 2) for n in range(40)]
    df = spark.createDataFrame(rows, "id string, lesion string, patient long").repartition(5)
    from cohort_spark.operators.groups import connected
    got = {r.id: r.group for r in connected(df, "id", ["lesion", "patient"]).collect()}
    root = {r[0]: r[0] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for c in (1, 2):
        first = {}
        for r in rows:
            if r[c] is not None:
                a, b = sorted((find(r[0]), find(first.setdefault(r[c], r[0]))))
                root[b] = a
    assert got == {i: find(i) for i in root} and len({v for k, v in got.items() if k.startswith("chain")}) == 1
    split = sampling.leak_free_split(df, "id", ["lesion", "patient"])
    rows = split.collect()
    assert len(rows) == 440 and sampling.shared_ids(split, ["lesion", "patient"]).count() == 0
    share = {s: sum(r.split == s for r in rows) / 440 for s in ("train", "val", "test")}
    largest = max(list(got.values()).count(g) for g in set(got.values())) / 440
    assert abs(share["train"] - 0.7) <= largest and abs(share["val"] - 0.1) <= largest and abs(share["test"] - 0.2) <= largest
    rowwise = sampling.exact_split(df, sampling.draw("id"), "id")
    leaks = {(r.key, str(r.id)): r for r in sampling.shared_ids(rowwise, ["lesion", "patient"]).collect()}
    assert leaks and all(r.n_splits > 1 and r.n_images > 1 for r in leaks.values())
    assert connected(df.limit(0), "id", ["lesion"]).count() == 0


def test_connected_groups_keep_fewer_rows_each_round(spark, monkeypatch):
    from cohort_spark.operators import groups
    kept = []

    def recorder(keep):
        def run(df, *name):
            out = keep(df, *name)
            kept.append(out.count())
            return out
        return run

    for name in ("materialize", "stored"):
        if hasattr(groups, name):
            monkeypatch.setattr(groups, name, recorder(getattr(groups, name)))
    df = spark.createDataFrame([(n, n // 2, (n + 1) // 2) for n in range(600)], "id long, lesion long, patient long").repartition(4)
    assert {r.group for r in groups.connected(df, "id", ["lesion", "patient"]).collect()} == {0}
    assert sum(kept) <= 7 * 1200


def test_connected_groups_of_repeated_and_null_ids(spark):
    from cohort_spark.operators.groups import connected
    df = spark.createDataFrame([(1, "a", None), (1, None, 7), (2, "a", None), (3, None, 7), (4, "b", 8), (4, "b", 8), (5, None, None), (None, "a", 8),
                                (6, "7", None)], "id long, lesion string, patient long")
    got = sorted((r.id, r.group) for r in connected(df, "id", ["lesion", "patient"]).collect())
    assert got == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 6)]


def test_early_stopping_with_and_without_delta(spark):
    rng = np.random.default_rng(1)
    rows = [(run, e, float(v)) for run in ("a", "b") for e, v in enumerate(rng.integers(0, 30, 60) / 10 + 3 / (1 + np.arange(60)))]
    df = spark.createDataFrame(rows, "run string, epochs int, train_loss double").repartition(3)
    for delta in (0.0, 0.3):
        got = {(r.run, r.epochs): r for r in trainlog.early_stopping(df, patience=4, delta=delta, keys=["run"]).collect()}
        for run in ("a", "b"):
            best, counter, stop = None, 0, False
            for r, e, v in rows:
                if r != run:
                    continue
                improved = best is None or -v >= -best + delta
                best, counter = (v, 0) if improved else (best, counter + 1)
                stop |= counter >= 4
                x = got[run, e]
                assert (x.improved, x.counter, x.best_loss, x.stop) == (improved, counter, best, stop)


def test_smoothing_over_bucket_borders(spark, monkeypatch):
    monkeypatch.setattr(trainlog, "BUCKET", 25)
    rng = np.random.default_rng(2)
    rows = [("a" if i % 4 else "b", i, float(v), 1 + i % 3) for i, v in enumerate(rng.random(300))]
    got = {(r.meter, r.step): r for r in trainlog.smoothed(spark.createDataFrame(rows, "meter string, step int, value double, n int")).collect()}
    assert len(got) == 300
    for meter in ("a", "b"):
        mine = [r for r in rows if r[0] == meter]
        for k, (_, step, value, _) in enumerate(mine):
            last = [v for *_, v, _ in mine[max(0, k - 19):k + 1]]
            r = got[meter, step]
            assert (r.value, r.max, r.median) == (value, max(last), sorted(last)[(len(last) - 1) // 2])
            assert r.avg == pytest.approx(np.mean(last))
            assert r.global_avg == pytest.approx(sum(v * n for *_, v, n in mine[:k + 1]) / sum(n for *_, n in mine[:k + 1]))


def test_patients_carry_wanted_columns_only(spark, tmp_path):
    """The first row of a patient is found on the wanted columns; others are not even read."""
    from cohort_spark.plans import q_clinical

    rows = [(o, o, 7, n, "N", "F", 5.0, 100.0 + n, 0.05, "1996-03-0%d" % n) for o in (9, 4) for n in (2, 1)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string, l_linestatus string, "
                          "l_quantity double, l_extendedprice double, l_discount double, l_shipdate string") \
        .withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp")).write.parquet(str(tmp_path / "lineitem.parquet"))
    first = q_clinical.patients(spark, str(tmp_path), "Age", "Sex")
    assert [tuple(r) for r in first.collect()] == [("7", 24.0, "F")]
    assert "l_shipdate" not in first._jdf.queryExecution().executedPlan().toString()


def test_confusion_takes_one_sort_of_run_ends(spark):
    from cohort_spark.operators import evaluate
    rng = np.random.default_rng(8)
    sizes = [(f"i{n}", 6, 5) for n in range(12)]
    t, p, want = [], [], {}
    for n, (k, h, w) in enumerate(sizes):
        masks_of = np.zeros((2, h * w), dtype=bool)
        for which, rows in ((0, t), (1, p)):
            if (n + which) % 6:  # some images have no target or no prediction
                for obj in range(3):
                    start = int(rng.integers(0, h * w - 1))
                    rows.append((k, obj, start, n_len := int(rng.integers(1, h * w - start + 1)), h, w))
                    masks_of[which, start:start + n_len] = True
        a, b = masks_of
        if a.any():
            want[k] = tuple(float(x.sum()) for x in (a & b, b & ~a, a & ~b, ~a & ~b))
    schema = "image_id string, obj_id int, start long, len long, height int, width int"
    sized = spark.createDataFrame(sizes, "image_id string, height int, width int")
    conf = evaluate.confusion(spark.createDataFrame(t, schema), spark.createDataFrame(p, schema), sized)
    assert {r.image_id: (r.TP, r.FP, r.FN, r.TN) for r in conf.collect()} == want and len(want) == 10
    plan = conf._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 1 and plan.count("Join") == 1
