"""Ranked lexical search of a stated set of items, by presence-mask grouping.

Terms are maximal runs of ``[0-9A-Za-z]`` and characters above U+007F, with A-Z
lower-cased.  All counts are over all documents (see :func:`weights` and
:func:`scores` for the formula).

Items are searched in blocks of at most ``BLOCK_ITEMS`` items and ``BLOCK_TERMS``
distinct terms (one item at least), so what is sent to the tasks is bounded; each block
looks at all documents.

1. One pass over the texts writes, for each document, its number of terms and the block's
   terms in it with their counts, as packed integers.
2. A second pass over that table adds up how many documents hold each term, in each
   task and then in Spark.
3. A third pass takes some documents at a time.  For each item the presence bits of its
   terms, one row of bits a term, give every document a mask, and documents of one mask
   form a group.  A group's score is at most that of a document with its terms, each as
   often as in any document at hand, in the shortest of its documents.  Groups are
   evaluated exactly by descending maximum score, until the next maximum is
   below the task's ``k``-th best score of the item; a maximum equal to it is still
   evaluated, as the smaller id wins ties.  No candidate is cut off otherwise.
4. The tasks' best of each item are merged in two steps (first by item and part, then
   by item), so no task gets the rows of all tasks for an item at once.

Null and empty texts have no term and are not in N.  An item without a term, or a null
one, has no result; items of one id are searched on their own and ranked as
one list.  Ids are integers; a null id comes after all others among equal scores.  Rows
repeated whole are documents like others.  Empty tables give no rows.  Extra columns are not
touched.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from .common import written

#: Distinct terms and items of a block, and counts (terms x documents) held at once.
BLOCK_TERMS, BLOCK_ITEMS, HELD_COUNTS = 20_000, 10_000, 8 << 20
#: Groups evaluated between two looks at the k-th best score.
STEP = 64
#: Parts in which the results of the tasks are first merged.
PARTS = 32
_LAST_ID = np.iinfo(np.int64).max


def _fold_table() -> bytes:
    table = bytearray(b" " * 256)
    for c in range(256):
        if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A:
            table[c] = c
        elif 0x41 <= c <= 0x5A:
            table[c] = c + 32
    return bytes(table)


_FOLD = _fold_table()


def terms(text: str | None) -> list[bytes]:
    """Terms of a text in order.  On UTF-8 bytes all of a character above U+007F
    belongs to a term, so one table of bytes tells terms from the rest."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    """floor(1000 * ln((2 N + 2) / (2 df + 1))) of each term."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], dtype=np.int64)


def scores(tf: np.ndarray, m: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sum over the terms (rows) of w * ((10^9 tf) div (1000 tf + 20 m)) for each
    document (column)."""
    return (w[:, None] * ((1_000_000_000 * tf) // np.maximum(1, 1000 * tf + 20 * m))).sum(axis=0)


def _counted(known: dict[bytes, int]):
    """Rows (id, n, terms, counts) of all documents with a term."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                size, which, counts = [], [], []
                for text in part.column(1):
                    words = terms(text.as_py())
                    held = {known[w]: c for w, c in Counter(words).items() if w in known}
                    size.append(len(words))
                    which.append(np.fromiter(held, dtype="<u4", count=len(held)).tobytes())
                    counts.append(np.fromiter(held.values(), dtype="<u4", count=len(held)).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(size, pa.int64()), pa.array(which, pa.binary()), pa.array(counts, pa.binary())],
                    names=["id", "n", "terms", "counts"]).filter(pa.array([s > 0 for s in size], pa.bool_()))
    return run


def _holding(size: int):
    """(term, documents of the task that hold it)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype="<u4"), minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["term", "df"])
    return run


def _bits(present: np.ndarray) -> np.ndarray:
    """The mask of each column of a boolean matrix, packed to bytes, as one value."""
    packed = np.ascontiguousarray(np.packbits(present, axis=0).T)
    if packed.shape[1] <= 8:
        wide = np.zeros((len(packed), 8), dtype=np.uint8)
        wide[:, :packed.shape[1]] = packed
        return wide.view(np.uint64)[:, 0]
    return packed.view(np.dtype((np.void, packed.shape[1])))[:, 0]


class Best:
    """The ``k`` best (score, id) of an item so far; smaller ids win ties."""

    def __init__(self, k: int):
        self.k, self.score, self.id, self.least = k, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), 1

    def add(self, score: np.ndarray, name: np.ndarray) -> None:
        keep = score >= self.least
        if not keep.any():
            return
        score, name = np.concatenate((self.score, score[keep])), np.concatenate((self.id, name[keep]))
        order = np.lexsort((name, -score))[:self.k]
        self.score, self.id = score[order], name[order]
        if len(order) == self.k:
            self.least = max(1, int(self.score[-1]))


def search_held(tf: np.ndarray, m: np.ndarray, names: np.ndarray, items: list[np.ndarray], w: np.ndarray, best: list[Best]) -> int:
    """Search documents at hand (tf: terms x documents) for every item; returns how
    many documents were scored."""
    most, evaluated = tf.max(axis=1), 0
    for mine, found in zip(items, best, strict=True):
        rows = mine[(most[mine] > 0) & (w[mine] > 0)]
        if not len(rows):
            continue
        counts, weight = tf[rows], w[rows]
        present = counts > 0
        masks = _bits(present)
        # Documents of one mask follow each other; the mask of no term is left out.
        order = np.argsort(masks, kind="stable")
        ordered = masks[order]
        starts = np.concatenate(([0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1))
        shortest = np.minimum.reduceat(m[order], starts)
        lead = present[:, order[starts]]
        limit = scores(lead * most[rows][:, None], shortest, weight)
        ends = np.append(starts[1:], len(order))
        by_limit = np.argsort(-limit, kind="stable")
        for first in range(0, len(by_limit), STEP):
            some = by_limit[first:first + STEP]
            some = some[limit[some] >= found.least]
            if not len(some):
                break
            docs = np.concatenate([order[starts[g]:ends[g]] for g in some.tolist()])
            evaluated += len(docs)
            found.add(scores(counts[:, docs], m[docs], weight), names[docs])
    return evaluated


def _searched(items: list[np.ndarray], w: np.ndarray, n_docs: int, n_terms: int, k: int):
    """(item's place, id, score): the task's best of every item."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in items]
        step = max(64, HELD_COUNTS // len(w))
        for batch in batches:
            for first in range(0, batch.num_rows, step):
                part = batch.slice(first, step)
                which = part.column(2).to_pylist()
                sizes = np.fromiter(map(len, which), dtype=np.int64, count=len(which)) // 4
                tf = np.zeros((len(w), len(which)), dtype=np.int64)
                tf[np.frombuffer(b"".join(which), dtype="<u4"), np.repeat(np.arange(len(which)), sizes)] = np.frombuffer(
                    b"".join(part.column(3).to_pylist()), dtype="<u4")
                n = part.column(1).to_numpy()
                names = part.column(0).fill_null(_LAST_ID).to_numpy()
                search_held(tf, 50 + (50 * n * n_docs) // n_terms, names, items, w, best)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(np.arange(len(best), dtype=np.int32), [len(b.id) for b in best])),
            pa.array(np.concatenate([b.id for b in best])), pa.array(np.concatenate([b.score for b in best]))], names=["place", "id", "score"])
    return run


def item_blocks(items: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[Row, list[bytes]]]]:
    """Items with their distinct terms, in blocks; the driver holds one block."""
    block: list = []
    seen: set[bytes] = set()
    for row in items.select(F.col(item_col).alias("item"), F.col(text_col).cast("string").alias("text")).toLocalIterator():
        own = sorted(set(terms(row["text"])))
        if not own:
            continue
        if block and (len(block) == BLOCK_ITEMS or len(seen.union(own)) > BLOCK_TERMS):
            yield block
            block, seen = [], set()
        block.append((row["item"], own))
        seen.update(own)
    if block:
        yield block


def _search_block(docs: DataFrame, block: list, kind: str, k: int, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    known = {t: i for i, t in enumerate(sorted(set().union(*(own for _, own in block))))}
    shared = spark.sparkContext.broadcast(known)
    table = written(docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(
        lambda batches: _counted(shared.value)(batches), "id bigint, n bigint, terms binary, counts binary"), "item-terms")
    n_docs, n_terms = table.agg(F.count(F.lit(1)), F.sum("n")).first()
    df = np.zeros(len(known), dtype=np.int64)
    for row in table.select("terms").mapInArrow(_holding(len(known)), "term int, df bigint").groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[row["term"]] = row["df"]
    places = spark.sparkContext.broadcast((
        [np.array([known[t] for t in own], dtype=np.int64) for _, own in block], weights(df, n_docs)))
    found = table.mapInArrow(lambda batches: _searched(*places.value, n_docs, n_terms, k)(batches), "place int, id bigint, score bigint")
    part = found.withColumn("part", F.pmod(F.xxhash64("id", "score"), F.lit(PARTS)))
    names = spark.createDataFrame([(i, name) for i, (name, _) in enumerate(block)], f"place int, item {kind}")
    return written(_top(part, ["place", "part"], k).drop("part").join(F.broadcast(names), "place").select(
        "item", F.when(F.col("id") != _LAST_ID, F.col("id")).alias("id"), "score"), "found")


def _top(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item, rank, id and score of the ``k`` best documents of every item."""
    kind = items.schema[item_col].dataType.simpleString()
    found = [_search_block(docs, block, kind, k, id_col, text_col) for block in item_blocks(items, item_col, item_text_col)]
    if not found:
        return docs.sparkSession.createDataFrame([], f"`{item_col}` {kind}, rank int, `{id_col}` bigint, score bigint")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return _top(every, ["item"], k).select(
        F.col("item").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
