"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier on hashed words and word beginnings is trained with numpy from
confirmed toxic examples (P) and unlabelled text (U, which holds toxic text in the
share ``prior``).  The risk

    prior * E_P[loss(f, +1)] + max(0, E_U[loss(f, -1)] - prior * E_P[loss(f, -1)])

corrects the unlabelled part for the toxic text in it; where that part would turn
negative (overfitting), the step goes the other way (Kiryo et al., 2017).

The fit uses a bounded sample: ``POSITIVES`` toxic and ``UNLABELLED`` other
training rows, chosen by a hash of the id whatever the length of the text, with up to
``TEXT_CHARS`` characters of each.  Scores are of whole texts.  The prior is the share of toxic labels
among the labelled training rows, over all of them.  Null text counts as empty; an empty
text has no features and gets the score of the bias.  With no toxic example every
score is 0.  An empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

POSITIVES, UNLABELLED = 2000, 6000
#: Hash space of the features, and features kept after screening.
SPACE, FEATURES = 1 << 22, 4096
THRESHOLD = 0.7
#: Characters of a sampled text that the fit sees.
TEXT_CHARS = 40_000
REMEMBERED = 500_000
LETTERS = re.compile(r"[^\W\d_]+")
#: Lengths of word beginnings that are features of their own.
BEGINNINGS = (4, 5, 6)


def features_of(word: str) -> list[int]:
    """Hashed features of a lower-case word: itself and its beginnings."""
    out = [zlib.crc32(word.encode("utf-8", "surrogatepass")) % SPACE]
    for n in BEGINNINGS:
        if len(word) > n:
            out.append(zlib.crc32(b"%d " % n + word[:n].encode("utf-8", "surrogatepass")) % SPACE)
    return out


@dataclass
class Model:
    """Weights of the kept features, and the bias."""

    weights: dict[int, float] = field(default_factory=dict)
    bias: float = -np.inf

    def scores(self, texts: list[str | None], known: dict[str, tuple]) -> Iterator[float]:
        """Score of each text in 0..1; ``known`` remembers the kept features of
        words between calls."""
        weights = self.weights
        for text in texts:
            words = set(LETTERS.findall(text.lower())) if isinstance(text, str) else ()
            found: set[int] = set()
            for w in words:
                hit = known.get(w)
                if hit is None:
                    if len(known) > REMEMBERED:
                        known.clear()
                    hit = known[w] = tuple(f for f in features_of(w) if f in weights)
                if hit:
                    found.update(hit)
            value = self.bias + sum(weights[f] for f in sorted(found))
            yield float(1 / (1 + np.exp(-np.clip(value, -500, 500)))) if np.isfinite(value) else 0.0


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float,
        steps: int = 400, rate: float = 0.05, decay: float = 1e-4) -> Model:
    """nnPU on feature sets of documents, full batches, Adam, logistic loss."""
    if not positive or not unlabelled or not 0 < prior < 1:
        return Model()
    # Only features of toxic text can be kept, so the others are not counted.
    names, seen = np.unique(np.concatenate(positive), return_counts=True)
    flat = np.concatenate(unlabelled)
    at = np.minimum(np.searchsorted(names, flat), len(names) - 1)
    in_p = seen / len(positive)
    in_u = np.bincount(at[names[at] == flat], minlength=len(names)) / len(unlabelled)
    # Screening: features more frequent in toxic text than chance explains.
    spread = np.sqrt((in_p + 1 / len(positive)) / len(positive) + (in_u + 1 / len(unlabelled)) / len(unlabelled))
    lift = (in_p - in_u) / spread
    lift[(in_p * len(positive) < 2.5) | (in_p < 2 * in_u)] = 0
    best = np.argsort(-lift, kind="stable")[:FEATURES]
    kept = names[np.sort(best[lift[best] > 1.5])]
    if not len(kept):
        return Model()

    def matrix(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        cols = [np.searchsorted(kept, r[np.isin(r, kept)]) for r in rows]
        return np.repeat(np.arange(len(rows)), [len(c) for c in cols]), np.concatenate(cols)

    (prow, pcol), (urow, ucol) = matrix(positive), matrix(unlabelled)
    w = np.zeros(len(kept) + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    w[-1] = np.log(prior / (1 - prior))

    def margin(row: np.ndarray, col: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(row, weights=w[col], minlength=n) + w[-1]

    def gradient(row: np.ndarray, col: np.ndarray, slope: np.ndarray) -> np.ndarray:
        out = np.bincount(col, weights=slope[row], minlength=len(w))
        out[-1] = slope.sum()
        return out

    for step in range(1, steps + 1):
        fp, fu = margin(prow, pcol, len(positive)), margin(urow, ucol, len(unlabelled))
        sp, su = _sigmoid(fp), _sigmoid(fu)
        # loss(f, +1) = log(1 + e^-f), slope s - 1; loss(f, -1) = log(1 + e^f), slope s.
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        down = gradient(urow, ucol, su / len(unlabelled)) - prior * gradient(prow, pcol, sp / len(positive))
        if negative >= 0:
            g = prior * gradient(prow, pcol, (sp - 1) / len(positive)) + down
        else:
            g = -down
        g[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(dict(zip(kept.tolist(), w[:-1].tolist(), strict=True)), float(w[-1]))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", positives: int = POSITIVES, unlabelled: int = UNLABELLED, text_chars: int = TEXT_CHARS) -> Model:
    """Fit on ``docs`` (training rows only) with ``labels`` (id, 0/1).  Labels with
    a null id or label are left out; of repeated labels of an id the largest holds."""
    spark = docs.sparkSession
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).alias("__y")).where(
        F.col("__id").isNotNull() & F.col("__y").isNotNull()).groupBy("__id").agg(F.max("__y").alias("__y"))
    ids = docs.select(F.col(id_col).alias("__id"))
    counts = ids.join(known, "__id").agg(F.count(F.lit(1)).alias("n"), F.sum("__y").alias("y")).first()
    if not counts["n"] or not counts["y"]:
        return Model()
    prior = min(max(counts["y"] / counts["n"], 1e-4), 0.9)
    rows = docs.select(F.col(id_col).alias("__id"))
    draw = F.xxhash64(F.lit("draw"), "__id")
    # Two bounded lists of ids; their texts are then read by a broadcast join.
    p_ids = rows.join(known.where("__y = 1"), "__id", "left_semi").distinct().orderBy(draw, "__id").limit(positives)
    u_ids = rows.where(F.col("__id").isNotNull()).distinct().orderBy(draw, "__id").limit(unlabelled)
    names = spark.createDataFrame(
        [(r[0], True) for r in p_ids.collect()] + [(r[0], False) for r in u_ids.collect()],
        f"__id {docs.schema[id_col].dataType.simpleString()}, __p boolean")

    def start():
        def work(texts: list) -> list[list]:
            out = []
            for text in texts:
                words = set(LETTERS.findall(text.lower())) if text else ()
                out.append(np.unique(np.array([f for w in words for f in features_of(w)], dtype="<u4")).tobytes())
            return [out]

        return work

    sampled = docs.select(F.col(id_col).alias("__id"), F.substring(F.col(text_col), 1, text_chars).alias("__t")).join(
        F.broadcast(names), "__id")
    found = map_texts(sampled, "__t", ["__id", "__p"], "f binary", start, [pa.binary()])
    held: dict[bool, list] = {True: [], False: []}
    for r in found.collect():
        held[r["__p"]].append((r["__id"], np.frombuffer(r["f"], dtype="<u4").astype(np.int64)))
    # Copies of one text would make each of its words look like a sign.
    pick = {p: list({f.tobytes(): f for _, f in sorted(rows, key=lambda x: x[0])}.values()) for p, rows in held.items()}
    return fit(pick[True], pick[False], prior)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
          carry: tuple[str, ...] = (), threshold: float = THRESHOLD) -> DataFrame:
    """id (and the columns in ``carry``), score and predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        known: dict[str, tuple] = {}
        return lambda texts: [list(shared.value.scores(texts, known))]

    scored = map_texts(docs, text_col, [id_col, *carry], "__score double", start, [pa.float64()])
    return scored.withColumn("__predicted", (F.col("__score") >= threshold).cast("int"))


def held_out(id_col: str = "doc_id"):
    """Whether the row is held out: crc32 of the id as text leaves 1 mod 3 (a null
    id counts as empty text, which is a training row)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1
