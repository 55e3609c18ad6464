"""The stand-in tables of ``cohort_spark.sources.standins`` written as DuckDB SQL.

Each entry is a CTE body; ``with_views(sql, names)`` prefixes a query with the
CTEs it needs so the oracle runs on the driver's registered tables only.
"""

from __future__ import annotations

VIEWS: dict[str, str] = {}

VIEWS["meta"] = """
SELECT
  CAST(o_orderkey AS VARCHAR) AS isic_id,
  CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(o_orderkey - o_orderkey % 3 AS VARCHAR) END AS lesion_id,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(o_custkey AS VARCHAR) END AS patient_id,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST((o_custkey % 18) * 5 AS DOUBLE) END AS age_approx,
  CASE WHEN o_orderkey % 19 = 0 THEN NULL
       WHEN o_orderpriority = '1-URGENT' THEN 'head_neck'
       WHEN o_orderpriority = '2-HIGH' THEN 'upper_extremity'
       WHEN o_orderpriority = '3-MEDIUM' THEN 'lower_extremity'
       WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'anterior_torso'
       ELSE 'posterior_torso' END AS anatom_site_general,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'special_' || CAST(o_orderkey % 4 AS VARCHAR) END AS anatom_site_special,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderkey % 40 AS DOUBLE) / 4 END AS clin_size_long_diam_mm,
  CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE 'type_' || CAST(o_custkey % 6 AS VARCHAR) END AS fitzpatrick_skin_type,
  CASE WHEN o_orderkey % 10 = 0 THEN 'clinical' ELSE 'dermoscopic' END AS image_type,
  CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE o_custkey % 5 = 0 END AS personal_hx_mm,
  CAST(640 + (o_orderkey % 7) * 64 AS INTEGER) AS pixels_x,
  CAST(480 + (o_orderkey % 5) * 48 AS INTEGER) AS pixels_y,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN 'female' ELSE 'male' END AS sex,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey % 2 = 0 END AS melanocytic,
  CASE WHEN o_orderkey % 23 = 0 THEN NULL
       WHEN o_custkey % 3 = 0 THEN 'Benign'
       WHEN o_custkey % 3 = 1 THEN 'Malignant'
       ELSE 'Indeterminate' END AS diagnosis_1
FROM orders
"""

VIEWS["meta_t"] = """
SELECT *,
  CASE WHEN melanocytic IS NOT NULL AND melanocytic THEN 'melanocytic' ELSE 'non-melanocytic' END AS melanocytic_str,
  diagnosis_1 || '-' || (CASE WHEN melanocytic IS NOT NULL AND melanocytic THEN 'melanocytic' ELSE 'non-melanocytic' END) AS target
FROM meta
"""

VIEWS["disk"] = """
SELECT CAST(l_orderkey AS VARCHAR) AS id, CAST(sum(l_quantity) * 1000 AS BIGINT) AS length
FROM lineitem GROUP BY l_orderkey
"""

VIEWS["clinical"] = """
SELECT
  CAST(l_suppkey AS VARCHAR) AS Patient_ID,
  CAST(20 + l_partkey % 70 AS VARCHAR) AS Age,
  CASE WHEN l_linestatus = 'F' THEN 'F' ELSE 'M' END AS Sex,
  CAST(1 + l_partkey % 6 AS VARCHAR) AS Skin_Phototype,
  CASE l_linenumber % 5 WHEN 0 THEN 'back' WHEN 1 THEN 'face' WHEN 2 THEN 'leg' WHEN 3 THEN 'arm' ELSE 'chest' END AS Anatomic_Site,
  CASE WHEN l_orderkey % 4 = 0 THEN NULL WHEN l_orderkey % 4 = 1 THEN 'Yes' ELSE 'No' END AS Family_History_Melanoma,
  CASE WHEN l_orderkey % 53 = 0 THEN CAST(l_suppkey AS VARCHAR) || '_' || CAST(l_linenumber AS VARCHAR)
       WHEN l_orderkey % 47 = 0 THEN CAST(l_suppkey AS VARCHAR) || '_' || CAST(l_linenumber AS VARCHAR) || '_31022020'
       ELSE CAST(l_suppkey AS VARCHAR) || '_' || CAST(l_linenumber AS VARCHAR) || '_' || strftime(l_shipdate, '%d%m%Y') END AS Image_ID,
  (CASE WHEN l_returnflag = 'A' THEN 'BCC' WHEN l_returnflag = 'N' THEN 'NV' ELSE 'MEL' END)
    || (CASE WHEN l_partkey % 10 = 0 THEN ' ' ELSE '' END) AS diagnosis,
  CASE WHEN l_partkey % 16 = 0 THEN 'subtype_' || CAST(l_partkey % 3 AS VARCHAR) END AS diagnosis_subtype,
  CASE WHEN l_returnflag IN ('N', 'R') THEN 'Yes' ELSE 'No' END AS Melanocytic_Lesion,
  CASE WHEN l_partkey % 19 = 0 THEN 'Malignant' ELSE 'Benign' END AS Benign_Malignant,
  CASE l_linenumber % 3 WHEN 0 THEN 'Histopathology' WHEN 1 THEN 'Clinical' ELSE 'Dermoscopy' END AS Diagnostic_Method,
  CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || ',' || CAST(l_linenumber AS VARCHAR) AS Diameter_major_mm,
  CAST(CAST(round(l_discount * 100) AS INTEGER) AS VARCHAR) AS Diameter_minor_mm,
  CASE WHEN l_returnflag = 'R' THEN 'Clark ' ||
       (CASE l_partkey % 4 WHEN 0 THEN 'I' WHEN 1 THEN 'II' WHEN 2 THEN 'III' ELSE 'IV' END) END AS Clark_Depth,
  CASE WHEN l_orderkey % 7 = 0 THEN 'In situ' WHEN l_orderkey % 7 = 1 THEN NULL
       ELSE CAST(l_linenumber AS VARCHAR) || '.' || CAST(l_partkey % 10 AS VARCHAR) END AS Breslow_mm,
  CASE l_partkey % 6 WHEN 0 THEN 'WLE' WHEN 1 THEN 'NEO' WHEN 2 THEN 'BGC' WHEN 3 THEN 'ADY' WHEN 4 THEN 'RT' END AS Treatment,
  l_orderkey AS fo_o, l_linenumber AS fo_ln, l_partkey AS fo_p, l_suppkey AS fo_s,
  l_extendedprice AS fo_e, l_quantity AS fo_q, l_discount AS fo_d
FROM lineitem
"""

VIEWS["clinical_clean"] = """
SELECT Patient_ID, TRY_CAST(Age AS DOUBLE) AS Age, Sex, TRY_CAST(Skin_Phototype AS INTEGER) AS Skin_Phototype,
  Anatomic_Site, Family_History_Melanoma, Image_ID, trim(diagnosis) AS diagnosis, diagnosis_subtype,
  Melanocytic_Lesion, Benign_Malignant, Diagnostic_Method, dmaj AS Diameter_major_mm, dmin AS Diameter_minor_mm,
  Clark_Depth, Breslow_mm, Treatment, Date,
  CAST(year(Date) AS INTEGER) AS Year, CAST(month(Date) AS INTEGER) AS Month,
  TRY_CAST(nullif(Breslow_mm, 'In situ') AS DOUBLE) AS Breslow_numeric,
  pi() * (dmaj / 2) * (dmin / 2) AS Area_approx_mm2,
  CASE WHEN dmin = 0 THEN NULL ELSE dmaj / dmin END AS Aspect_ratio,
  fo_o, fo_ln, fo_p, fo_s, fo_e, fo_q, fo_d
FROM (
  SELECT *, TRY_CAST(replace(Diameter_major_mm, ',', '.') AS DOUBLE) AS dmaj,
         TRY_CAST(Diameter_minor_mm AS DOUBLE) AS dmin,
         CAST(try_strptime(nullif(regexp_extract(Image_ID, '_(\\d{8})$', 1), ''), '%d%m%Y') AS DATE) AS Date
  FROM clinical)
"""

VIEWS["levels"] = """
SELECT vec_id, CAST((pos - 1) % 8 AS INTEGER) AS x, CAST((pos - 1) // 8 AS INTEGER) AS y,
       CAST(floor((CAST(e AS DOUBLE) + 1) * 128) AS INTEGER) AS v
FROM (SELECT vec_id, unnest(embedding) AS e, unnest(generate_series(1, len(embedding))) AS pos FROM embeddings)
"""

VIEWS["pixels"] = """
SELECT CAST(vec_id AS VARCHAR) AS image_id, x, y, v AS blue, (v * 3 + 17) % 256 AS green, 255 - v AS red,
       CAST(((255 - v) * 299 + ((v * 3 + 17) % 256) * 587 + v * 114 + 500) // 1000 AS INTEGER) AS gray
FROM levels
"""

VIEWS["mask_gt"] = """
SELECT CAST(vec_id AS VARCHAR) AS image_id, x, y, CASE WHEN v > 120 THEN 255 ELSE 0 END AS value FROM levels
"""

VIEWS["mask_pred"] = """
SELECT CAST(vec_id - 1 AS VARCHAR) AS image_id, x, y, CASE WHEN v > 120 THEN 255 ELSE 0 END AS value FROM levels
"""

# Predicted objects for several shifts: (shift, image, j) is the object's key.
VIEWS["pred_objects"] = """
SELECT shift, vec_id - j + 1 - shift AS image, CAST(vec_id - j + 1 - shift AS VARCHAR) AS image_id, j AS obj_id, vec_id,
       ((((vec_id - j + 1 - shift) * 7 + j * 13) % 5 + 5) % 5) / 4 AS score,
       CASE WHEN ((vec_id - j + 1 - shift) % 3 + 3) % 3 = 1 THEN 2 ELSE 1 END AS step
FROM embeddings, (VALUES (1), (2), (3)) o(j), (VALUES (1), (2), (3)) s(shift)
WHERE j <= ((vec_id - j + 1 - shift) % 4 + 4) % 4
"""

VIEWS["pred_best"] = """
SELECT * FROM pred_objects QUALIFY row_number() OVER (PARTITION BY shift, image ORDER BY score DESC, obj_id) = 1
"""

VIEWS["pred_soft"] = """
SELECT shift, image_id, x // step AS x, y // step AS y, step, v / 256 AS value
FROM pred_best JOIN levels USING (vec_id) WHERE x % step = 0 AND y % step = 0
"""

# The soft mask at 8 x 8: four neighbours, half-pixel centres, clamped edges.
VIEWS["pred_resized"] = """
SELECT g.shift, g.image_id, g.x, g.y,
       (1 - ly) * ((1 - lx) * a.value + lx * b.value) + ly * ((1 - lx) * c.value + lx * d.value) AS value
FROM (SELECT shift, image_id, x, y, step, sx, sy, sx - floor(sx) AS lx, sy - floor(sy) AS ly, 8 // step - 1 AS top
      FROM (SELECT shift, image_id, step, x, y, greatest((x + 0.5) / step - 0.5, 0.0) AS sx,
                   greatest((y + 0.5) / step - 0.5, 0.0) AS sy
            FROM (SELECT DISTINCT shift, image_id, step FROM pred_soft), range(8) q(x), range(8) r(y))) g
JOIN pred_soft a ON a.shift = g.shift AND a.image_id = g.image_id AND a.x = floor(sx) AND a.y = floor(sy)
JOIN pred_soft b ON b.shift = g.shift AND b.image_id = g.image_id AND b.x = least(floor(sx) + 1, top) AND b.y = floor(sy)
JOIN pred_soft c ON c.shift = g.shift AND c.image_id = g.image_id AND c.x = floor(sx) AND c.y = least(floor(sy) + 1, top)
JOIN pred_soft d ON d.shift = g.shift AND d.image_id = g.image_id AND d.x = least(floor(sx) + 1, top) AND d.y = least(floor(sy) + 1, top)
"""

VIEWS["sizes"] = """
SELECT CAST(vec_id AS VARCHAR) AS image_id, 8 AS height, 8 AS width FROM embeddings
"""

VIEWS["gt_boxes"] = """
SELECT l_orderkey AS image_id, CAST(l_linenumber AS INTEGER) AS obj_id, CAST(1 + l_partkey % 3 AS INTEGER) AS category_id,
       CAST(l_partkey % 100 AS DOUBLE) AS x, CAST(l_suppkey % 80 AS DOUBLE) AS y,
       CAST(l_quantity - 1 AS DOUBLE) AS w, CAST(l_partkey % 30 AS DOUBLE) AS h,
       CAST(l_partkey % 29 = 0 AS INTEGER) AS iscrowd
FROM lineitem
"""

VIEWS["detections"] = """
SELECT l_orderkey AS image_id, CAST(l_linenumber AS INTEGER) AS det_id, CAST(1 + l_partkey % 3 AS INTEGER) AS category_id,
       CAST(l_partkey % 100 + l_suppkey % 5 - 2 AS DOUBLE) AS x, CAST(l_suppkey % 80 + l_partkey % 5 - 2 AS DOUBLE) AS y,
       CAST(l_quantity - 1 + l_suppkey % 3 AS DOUBLE) AS w, CAST(l_partkey % 30 + 1 AS DOUBLE) AS h,
       l_discount + l_linenumber / 1000.0 + (l_partkey % 97) / 100000.0 AS score
FROM lineitem
"""

# Boxes with ids that tell apart the objects of an image.
for _name, _of, _id in (("gt_named", "gt_boxes", "obj_id"), ("det_named", "detections", "det_id")):
    VIEWS[_name] = f"""
SELECT * REPLACE (CAST((({_id} * 1000 + x) * 1000 + y) * 1000 + w AS BIGINT) AS {_id}) FROM {_of}
"""

for _name, _of, _id in (("gt_runs", "gt_named", "obj_id"), ("det_runs", "det_named", "det_id")):
    VIEWS[_name] = f"""
SELECT image_id, {_id}, category_id, c, c * 32 + top AS s, c * 32 + top + greatest(1, bottom - top + 1 - c % 2) AS e
FROM (SELECT image_id, {_id}, category_id, unnest(range(x0, x1 + 1)) AS c, top, bottom
      FROM (SELECT *, CAST(greatest(floor(x / 4), 0) AS BIGINT) AS x0, CAST(greatest(floor((x + w) / 4), 0) AS BIGINT) AS x1,
                   CAST(greatest(floor(y / 4), 0) AS BIGINT) AS top, CAST(greatest(floor((y + h) / 4), 0) AS BIGINT) AS bottom
            FROM {_of}))
"""

VIEWS["gt_points"] = """
SELECT image_id, obj_id, category_id, x AS bx, y AS by_, w AS bw, h AS bh, w * h AS area, i,
       x + w * i / 16 AS kx, y + h * ((i * 5) % 17) / 16 AS ky,
       CASE WHEN (image_id + obj_id) % 13 = 0 THEN 0 ELSE (image_id + obj_id + i) % 3 END AS v
FROM gt_named, range(17) r(i)
"""

VIEWS["det_points"] = """
SELECT image_id, det_id, category_id, i, x + w * i / 16 AS kx, y + h * ((i * 5) % 17) / 16 AS ky
FROM det_named, range(17) r(i)
"""

VIEWS["train_log"] = """
SELECT event_id AS step, event_type AS meter, value, CAST(1 + user_id % 3 AS INTEGER) AS n FROM events
"""

VIEWS["history"] = """
SELECT CAST(epochs AS INTEGER) AS epochs, train_loss, val_dice, val_iou, val_precision, val_recall,
       val_specificity, val_accuracy, 0.005 * power(0.1, floor((epochs - 1) / 15)) AS lr_history
FROM (
  SELECT date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) + 1 AS epochs,
         avg(value) / 100 AS train_loss,
         avg(CAST(event_type = 'click' AS DOUBLE)) AS val_dice,
         avg(CAST(event_type = 'view' AS DOUBLE)) AS val_iou,
         avg(CAST(event_type = 'purchase' AS DOUBLE)) AS val_precision,
         avg(CAST(event_type = 'signup' AS DOUBLE)) AS val_recall,
         avg(CAST(event_type <> 'error' AS DOUBLE)) AS val_specificity,
         avg(CAST(value > 10 AS DOUBLE)) AS val_accuracy
  FROM events GROUP BY 1
)
"""

# dependencies between views (a view must come after the ones it reads)
DEPENDS = {
    "meta_t": ["meta"],
    "clinical_clean": ["clinical"],
    "pixels": ["levels"],
    "mask_gt": ["levels"],
    "mask_pred": ["levels"],
    "gt_named": ["gt_boxes"],
    "det_named": ["detections"],
    "gt_runs": ["gt_named"],
    "det_runs": ["det_named"],
    "gt_points": ["gt_named"],
    "det_points": ["det_named"],
    "pred_best": ["pred_objects"],
    "pred_soft": ["levels", "pred_best"],
    "pred_resized": ["pred_soft"],
}


def with_views(sql: str, *names: str) -> str:
    ordered: list[str] = []

    def add(n: str) -> None:
        for d in DEPENDS.get(n, []):
            add(d)
        if n not in ordered:
            ordered.append(n)

    for n in names:
        add(n)
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in ordered)
    body = sql.lstrip()
    if body[:14].upper() == "WITH RECURSIVE":
        return f"WITH RECURSIVE {ctes},\n{body[14:].lstrip()}"
    if body[:4].upper() == "WITH":
        return f"WITH {ctes},\n{body[4:].lstrip()}"
    return f"WITH {ctes}\n{body}"


def sround(expr: str, digits: int) -> str:
    """Half-even rounding of the shortest decimal text of a double (how Spark's
    ``bround`` treats doubles), for oracle queries."""
    return f"CAST(round_even(CAST(CAST({expr} AS VARCHAR) AS DECIMAL(38, 12)), {digits}) AS DOUBLE)"


def mode_sql(src: str, group: str, col: str) -> str:
    """Most frequent non-null value per group, smallest value among ties."""
    return (f"SELECT {group}, {col} AS m FROM (SELECT {group}, {col}, row_number() OVER "
            f"(PARTITION BY {group} ORDER BY count(*) DESC, {col}) AS rn FROM {src} "
            f"WHERE {col} IS NOT NULL GROUP BY {group}, {col}) WHERE rn = 1")
