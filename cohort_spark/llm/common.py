"""Helpers shared by the text operators: reading, written intermediate tables,
and numpy kernels for words and word windows.

Words are ``[^\\x20\\x09-\\x0D]+`` everywhere.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

WORD_PATTERN = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Bytes of text that one numpy pass holds; a longer text is still taken whole.
CHUNK_BYTES = 4 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage: a task that is run again after the loss of an
    executor reads files, and values such as row numbers cannot change.
    """
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lower_ascii(col: Column) -> Column:
    """Lower-case A-Z only.  ``lower`` does that on pure ASCII at once; other
    texts go through ``translate``, which looks at each character."""
    return F.when(col.rlike(r"[^\x00-\x7F]"), F.translate(col, UPPER, LOWER)).otherwise(F.lower(col))


def word_count(col: Column) -> Column:
    """Number of words of the text (null: 0)."""
    return F.coalesce(F.regexp_count(col, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def map_texts(docs: DataFrame, text_col: str, carry: Sequence[str], made: str,
              start: Callable[[], Callable[[list], list]], types: Sequence[pa.DataType], rows: int = 500) -> DataFrame:
    """Run a function over the texts of every partition in Arrow batches.

    ``start()`` is called once for a task and gives a function from a list of texts
    (None for null) to a list of columns, described by ``made`` (a DDL string) and
    ``types``.  The columns in ``carry`` pass through untouched.
    """
    carry = list(dict.fromkeys(carry))
    fields = [docs.schema[c] for c in carry]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), made])
    names = carry + [x.name for x in docs.sparkSession.createDataFrame([], made).schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            for first in range(0, batch.num_rows, rows):
                part = batch.slice(first, rows)
                columns = work(part.column(part.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(i) for i in range(len(carry))]
                    + [pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=names)

    return docs.select(*[docs[c] for c in carry], docs[text_col].cast("string").alias("__text")).mapInArrow(run, schema)


# --------------------------------------------------------------- numpy kernels

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on an array of unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def _byte_table(fold: bool) -> np.ndarray:
    """A 64-bit value for each byte, 0 for white space; ``fold`` gives A-Z the
    values of a-z."""
    table = mix64(np.arange(1, 257, dtype=np.uint64) * _GOLD)
    table[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
    if fold:
        table[0x41:0x5B] = table[0x61:0x7B]
    return table


_TABLES = {fold: _byte_table(fold) for fold in (False, True)}
_IS_WORD = _TABLES[False] != 0
_POWERS = np.ones(1, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C55)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        steps = np.full(max(n, 2 * len(_POWERS)), _BASE, dtype=np.uint64)
        steps[0] = 1
        _POWERS = np.cumprod(steps, dtype=np.uint64)
    return _POWERS


def word_hashes(data: bytes, fold: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of each word of ``data``; the hash depends only on the
    bytes of the word (after lower-casing A-Z if ``fold``)."""
    buf = np.frombuffer(data, dtype=np.uint8)
    inside = np.zeros(len(buf) + 2, dtype=np.int8)
    inside[1:-1] = _IS_WORD[buf]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return starts, ends, np.zeros(0, dtype=np.uint64)
    first = starts[0]
    runs = np.diff(np.append(starts, len(buf)))
    place = np.arange(first, len(buf)) - np.repeat(starts, runs)
    powers = _powers(int(runs.max()))
    values = _TABLES[fold][buf[first:]] * powers[place]
    sums = np.add.reduceat(values, starts - first)
    return starts, ends, mix64(sums + (ends - starts).astype(np.uint64) * _GOLD)


def chunks(texts: list, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, list[bytes]]]:
    """Cut a batch into (first, last + 1, UTF-8 texts) of about ``limit`` bytes;
    null counts as empty."""
    first, size, held = 0, 0, []
    for i, text in enumerate(texts):
        data = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
        if held and size + len(data) > limit:
            yield first, i, held
            first, size, held = i, 0, []
        held.append(data)
        size += len(data) + 1
    if held:
        yield first, first + len(held), held


def doc_words(held: list[bytes], fold: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Words of several texts in one pass: (doc offsets into the word arrays,
    starts, ends, hashes, joined text)."""
    joined = b"\n".join(held)
    starts, ends, hashes = word_hashes(joined, fold)
    sizes = np.fromiter(map(len, held), dtype=np.int64, count=len(held)) + 1
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    return np.searchsorted(starts, bounds), starts, ends, hashes, joined


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive words (in order)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total, factor = np.zeros(n, dtype=np.uint64), np.uint64(1)
    with np.errstate(over="ignore"):
        for k in range(width):
            total += hashes[k:k + n] * factor
            factor = np.uint64((int(factor) * 0xD6E8FEB86659FD93) & (2**64 - 1))
    return mix64(total + np.uint64(width))
