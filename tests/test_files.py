"""Sources, sinks and image jobs on generated PNG files."""

import json
import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohort_spark.operators import annotations as A
from cohort_spark.operators import masks as M
from cohort_spark.plans import jobs
from cohort_spark.sources import files as FS
from tests.pngs import write_png


@pytest.fixture(scope="module")
def folder():
    root = tempfile.mkdtemp(prefix="cohort-png-")
    img_dir, msk_dir = os.path.join(root, "images"), os.path.join(root, "masks")
    os.makedirs(img_dir)
    os.makedirs(msk_dir)
    rng = np.random.default_rng(3)
    ramp = np.zeros((3, 4, 3), dtype=np.uint8)
    ramp[:, :, 0] = np.arange(4)[None, :] * 60        # R
    ramp[:, :, 1] = np.arange(3)[:, None] * 100       # G
    ramp[:, :, 2] = 7                                 # B
    write_png(os.path.join(img_dir, "a.png"), ramp)
    block = np.zeros((3, 4), dtype=np.uint8)
    block[1:3, 1:3] = 255
    write_png(os.path.join(msk_dir, "a.png"), block)
    # a larger textured image with a mask of two objects
    big = rng.integers(0, 256, size=(12, 10, 3)).astype(np.uint8)
    write_png(os.path.join(img_dir, "b.PNG"), big)
    m = np.zeros((12, 10), dtype=np.uint8)
    m[2:8, 1:6] = 255
    m[9:11, 7:9] = 200
    write_png(os.path.join(msk_dir, "b.png"), m)
    # all-zero mask, mask of values 1..127, image without mask, mask without image
    write_png(os.path.join(img_dir, "c.png"), big)
    write_png(os.path.join(msk_dir, "c.png"), np.zeros((12, 10), dtype=np.uint8))
    write_png(os.path.join(img_dir, "d.png"), big)
    write_png(os.path.join(msk_dir, "d.png"), (np.arange(120).reshape(12, 10) % 127 + 1).astype(np.uint8))
    write_png(os.path.join(img_dir, "e.png"), big)
    write_png(os.path.join(msk_dir, "f.png"), m)
    # not an image although named like one, and a non-image extension
    with open(os.path.join(img_dir, "broken.png"), "wb") as f:
        f.write(b"not a png")
    with open(os.path.join(img_dir, "notes.txt"), "w") as f:
        f.write("x")
    return root, img_dir, msk_dir, ramp, block


def test_listing_filters_extension_case_insensitive(spark, folder):
    _, img_dir, _, _, _ = folder
    lst = FS.list_files(spark, img_dir).toPandas()
    assert sorted(lst["id"]) == ["a", "b", "broken", "c", "d", "e"]
    assert (lst["length"] > 0).all()


def test_image_decode_bgr_and_gray(spark, folder):
    _, img_dir, msk_dir, ramp, block = folder
    imgs = FS.read_images(spark, img_dir)
    px = M.pixels_from_images(imgs.where(F.col("image_id") == "a")).toPandas()
    px = px.set_index(["x", "y"]).sort_index()
    for y in range(3):
        for x in range(4):
            r, g, b = (int(v) for v in ramp[y, x])
            row = px.loc[(x, y)]
            assert (row.red, row.green, row.blue) == (r, g, b)
            assert row.gray == (r * 299 + g * 587 + b * 114 + 500) // 1000
    mv = M.mask_values(FS.read_images(spark, msk_dir).where(F.col("image_id") == "a")).toPandas()
    got = np.zeros((3, 4), dtype=int)
    for r in mv.itertuples():
        got[r.y, r.x] = r.value
    assert (got == block).all()


def test_undecodable_rows_are_kept_and_reported(spark, folder):
    _, img_dir, _, _, _ = folder
    imgs = FS.read_images(spark, img_dir)
    bad = M.undecodable(imgs).toPandas()
    assert list(bad["image_id"]) == ["broken"]
    dims = M.image_dims(imgs).toPandas().set_index("image_id")
    assert (dims.loc["a", "width"], dims.loc["a", "height"]) == (4, 3)


def test_runs_roundtrip_and_boxes(spark, folder):
    _, _, msk_dir, _, _ = folder
    masks = FS.read_images(spark, msk_dir).where(F.col("image_id") == "b")
    mv = M.mask_values(masks)
    fg = M.foreground(mv, 0)
    sizes = M.image_dims(masks).select("image_id", "height", "width")
    runs = M.encode_runs(fg, sizes)
    back = {(r.x, r.y) for r in M.decode_runs(runs).collect()}
    want = {(r.x, r.y) for r in fg.collect()}
    assert back == want
    b = M.boxes(runs).collect()[0]
    assert (b.xmin, b.ymin, b.xmax, b.ymax) == (1, 2, 8, 10)
    assert list(b.bbox) == [1.0, 2.0, 8.0, 9.0]
    seg = M.coco_counts(runs, sizes).collect()[0].segmentation
    assert sum(seg.counts) == 120 and list(seg.size) == [12, 10]
    # counts alternate background / foreground and start with background
    assert sum(seg.counts[1::2]) == len(want)


def test_feature_inputs_error_rules(spark, folder):
    _, img_dir, msk_dir, _, _ = folder
    px, fg, errors = jobs.feature_inputs(FS.read_images(spark, img_dir), FS.read_images(spark, msk_dir))
    err = {r.image_id: r.message for r in errors.collect()}
    assert err["broken"] == "Could not read image"
    assert err["c"].startswith("Empty mask")
    assert err["d"].startswith("Empty ROI")
    assert {r.image_id for r in fg.select("image_id").distinct().collect()} == {"a", "b"}


def test_extract_features_resumes(spark, folder):
    root, img_dir, msk_dir, _, _ = folder
    out, errs = os.path.join(root, "features"), os.path.join(root, "errors")
    first = jobs.extract_features(spark, img_dir, msk_dir, out, errs, batches=2)
    assert first["features"] == 2
    wide = spark.read.parquet(out)
    assert len(wide.columns) == 1 + 408
    again = jobs.extract_features(spark, img_dir, msk_dir, out, errs)
    assert again["features"] == 0 and again["errors"] == 0
    assert spark.read.parquet(out).count() == 2
    logged = [(r.image_id, r.message) for r in spark.read.parquet(errs).collect()]
    assert sorted(i for i, _ in logged) == ["c", "d", "f"]     # a mask without an image is reported
    assert dict(logged)["f"] == "Could not read image"


def test_late_image_is_taken_by_the_next_run(spark):
    root = tempfile.mkdtemp(prefix="cohort-late-")
    img_dir, msk_dir = os.path.join(root, "images"), os.path.join(root, "masks")
    os.makedirs(img_dir)
    os.makedirs(msk_dir)
    with open(os.path.join(img_dir, "notes.txt"), "w") as f:
        f.write("x")
    mask = np.zeros((6, 5), dtype=np.uint8)
    mask[1:4, 1:4] = 255
    write_png(os.path.join(msk_dir, "late.png"), mask)
    out, errs = os.path.join(root, "features"), os.path.join(root, "errors")
    assert jobs.extract_features(spark, img_dir, msk_dir, out, errs) == {"features": 0, "errors": 1}
    write_png(os.path.join(img_dir, "late.png"), np.random.default_rng(1).integers(0, 256, (6, 5, 3)).astype(np.uint8))
    assert jobs.extract_features(spark, img_dir, msk_dir, out, errs) == {"features": 1, "errors": 0}


def test_annotation_export(spark, folder):
    root, img_dir, msk_dir, _, _ = folder
    lst = FS.list_files(spark, msk_dir).select("id", F.element_at(F.split("path", "/"), -1).alias("name"))
    decoded = FS.read_images(spark, msk_dir)
    mv = M.mask_values(decoded)
    sizes = M.image_dims(decoded).select("image_id", "height", "width")
    images, anns, cats = A.annotations_from_masks(lst, mv, sizes)
    imgs = images.orderBy("id").collect()
    assert [r.id for r in imgs] == [0, 1, 2, 3, 4]
    assert imgs[0].file_name == "a.jpg"
    a = anns.orderBy("id").collect()
    assert [r.image_id for r in a] == [0, 1, 3, 4]      # the all-zero mask has no annotation
    assert a[0].area == 4.0 and list(a[0].bbox) == [1.0, 1.0, 2.0, 2.0]
    out = os.path.join(root, "coco")
    FS.write_coco(images, anns, cats, out, single_document=True)
    doc = json.loads(open([os.path.join(out, f) for f in os.listdir(out) if f.startswith("part-")][0]).read())
    assert doc["categories"] == [{"id": 1, "name": "lesion", "supercategory": "skin"}]
    path = os.path.join(root, "coco.json")
    with open(path, "w") as f:
        json.dump(doc, f)
    i2, a2, c2 = FS.read_coco(spark, path)
    assert i2.count() == 5 and a2.count() == 4 and c2.count() == 1


def test_banner_csv_and_missing_resume_file(spark, folder):
    root = folder[0]
    path = os.path.join(root, "clinical.csv")
    cols = FS.CLINICAL_COLUMNS
    with open(path, "w") as f:
        f.write("UDEM skin cancer dataset\n")
        f.write(",".join(cols) + "\n")
        f.write(",".join(["P1", "40", "F", "3", "back", "No", "P1_1_05022020", "NV ", ""] + ["x"] * 11) + "\n")
        f.write(",".join(["P2", "51", "M", "2", "face", "", "P2_1_31022020", "MEL", ""] + ["y"] * 11) + "\n")
    df = FS.read_banner_csv(spark, path)
    assert [r.Patient_ID for r in df.collect()] == ["P1", "P2"]
    assert FS.read_id_column(spark, os.path.join(root, "missing.csv")).count() == 0


def test_score_images_threshold_model(spark, folder):
    _, img_dir, _, _, _ = folder
    imgs = FS.read_images(spark, img_dir).where(F.col("image_id").isin("a", "b"))

    def predict(pdf):
        # a stand-in model: probability = gray / 255
        return [np.asarray(p, dtype=float) / 255.0 for p in pdf["pixels"]]

    runs = jobs.score_images(imgs, predict)
    area = {r.image_id: r.area for r in M.areas(runs, per_object=False).collect()}
    px = M.pixels_from_images(imgs).where(F.col("gray") > 127.5).groupBy("image_id").count().collect()
    assert area == {r.image_id: r["count"] for r in px}


def test_image_table_keeps_images_without_a_detection(spark, folder):
    """Images of several sizes; the model is loaded by the worker and sees batches of images."""
    _, img_dir, _, ramp, _ = folder

    def make_model():
        def model(pictures):
            assert len(pictures) <= 2
            return [None if p.shape[0] == 12 else p[:, :, 2] / 255 for p in pictures]  # stored as B, G, R

        return model

    scored = jobs.score_image_table(FS.read_images(spark, img_dir), make_model, threshold=0.3, batch_size=2)
    rows = {r.image_id: r for r in scored.collect()}
    assert set(rows) == {"a", "b", "c", "d", "e"}  # an unreadable file is no image
    assert [rows[k].detected for k in "abcde"] == [True, False, False, False, False] and rows["b"].starts == [] and rows["b"].height == 12
    area = {r.image_id: r.area for r in M.areas(jobs.scored_runs(scored), per_object=False).collect()}
    assert area == {"a": (ramp[:, :, 0] / 255 > 0.3).sum()}


def test_incremental_extraction_stream(spark, folder):
    from cohort_spark.streaming import incremental

    root, img_dir, msk_dir, _, _ = folder
    out, errs = os.path.join(root, "stream-features"), os.path.join(root, "stream-errors")
    ckpt = os.path.join(root, "stream-ckpt")
    q = incremental.start(spark, msk_dir, img_dir, out, errs, checkpoint=ckpt, max_files=2)
    q.awaitTermination(600)
    assert spark.read.parquet(out).select("image_id").distinct().count() == 2
    # a restart with the same checkpoint finds nothing new
    q2 = incremental.start(spark, msk_dir, img_dir, out, errs, checkpoint=ckpt, max_files=2)
    q2.awaitTermination(600)
    assert spark.read.parquet(out).count() == 2


def test_late_image_is_taken_by_the_stream(spark, monkeypatch):
    from contextlib import contextmanager

    from cohort_spark.streaming import incremental

    @contextmanager
    def batch_features(spark, pairs):
        # the features themselves are tested above; here only which pairs are taken
        found = F.col("image_path").isNotNull()
        yield (pairs.where(found).select("image_id"),
               pairs.where(~found).select("image_id", F.lit("Could not read image").alias("message")))

    monkeypatch.setattr(jobs, "batch_features", batch_features)
    # No batch lists a whole folder.
    monkeypatch.setattr(FS, "list_files", lambda *a, **k: pytest.fail("a folder was listed"))
    root = tempfile.mkdtemp(prefix="cohort-late-stream-")
    img_dir, msk_dir, out, errs, ckpt = (os.path.join(root, d) for d in ("images", "masks", "features", "errors", "ckpt"))
    os.makedirs(img_dir)
    os.makedirs(msk_dir)
    png = np.zeros((2, 2), dtype=np.uint8)

    def run():
        incremental.start(spark, msk_dir, img_dir, out, errs, checkpoint=ckpt).awaitTermination(120)
        return [sorted(r.image_id for r in spark.read.parquet(p).select("image_id").collect()) for p in (out, errs)]

    write_png(os.path.join(img_dir, "early.png"), png)
    for name in ("early.png", "late.png", "later.png"):
        write_png(os.path.join(msk_dir, name), png)
    assert run() == [["early"], ["late", "later"]]
    write_png(os.path.join(img_dir, "late.png"), png)      # no new mask comes with it
    assert run() == [["early", "late"], ["late", "later"]]
    for folder in (img_dir, msk_dir):
        write_png(os.path.join(folder, "new.png"), png)
    write_png(os.path.join(img_dir, "later.png"), png)
    assert run() == [["early", "late", "later", "new"], ["late", "later"]]
