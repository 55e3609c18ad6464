"""Spelling variants: words one edit apart, found by Bloom-guided neighbourhoods.

Words are maximal runs ``[A-Za-z\\u00C0-\\u00FF]+``, with A-Z lower-cased.  Of the runs
of a document every ``TYPO``-th, chosen by a checksum of id and run, loses one code
point first.  The vocabulary holds the words of at least ``MIN_LENGTH`` code points that
occur at least ``MIN_COUNT`` times.

1. Tasks count the words of their texts and give partial counts (flushed when the table
   of counts grows, so its memory is bounded); Spark adds them up.
2. Each vocabulary word sets the bits of one 512-bit block of the Bloom filter of its
   length; ``bit_or`` for each block builds the filters.  They have at most
   ``FILTER_BLOCKS`` blocks (16 MB) together, whatever the vocabulary: beyond that they
   only let more false positives through.  That bound is why they can be broadcast.
3. Each word generates its edits as rolling hashes (constant work for an edit, however
   long the word) and probes the filter of the edit's length: each deletion, and each
   replacement by a greater code point.  An insertion is the deletion seen from the
   other word, and a replacement by a smaller one is seen from there too.
4. Only the positives are shuffled: an equality join with the vocabulary on the hash,
   and an edit distance of exactly one, remove the false ones.

A word's near words are at most its possible edits, so no key of a word is hot.  Only
what is read more than once is written (vocabulary, pairs, forms, each round of roots):
on a local file system each file costs its executor a few processes.

Null and empty texts have no words.  A null id counts as empty in the checksum.  Rows
repeated whole count each time.  Ties for the form go to the smaller word in code-point
order.  An empty table gives no rows.  Extra columns are not touched.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix64, written

MIN_LENGTH, MIN_COUNT, TYPO = 6, 5, 199
#: A form occurs at least so many times as often as its variant.
RATIO = 5
ALPHABET = [chr(c) for c in (*range(0x61, 0x7B), *range(0xC0, 0x100))]
#: Bits for each word, and blocks of 512 bits in all filters together.
WORD_BITS, FILTER_BLOCKS = 16, 1 << 18
#: Lengths of this many code points and more share a filter.
LAST_SHARD = 64
#: Distinct words a task holds before it gives its counts; edits hashed at once.
HELD_WORDS, EDITS = 200_000, 1 << 20
#: Words probed by one task.
TASK_WORDS = 20_000
_BASE = np.uint64(0x9E3779B97F4A7C55)
_WORD = re.compile("[a-zÀ-ÿ]{%d,}" % MIN_LENGTH)


def text_words(prefix: bytes, text: str, counts: Counter) -> None:
    """Add the words of a text, typos included, to ``counts``; ``prefix`` is ``<id>:``."""
    start = zlib.crc32(prefix)
    # Runs below MIN_LENGTH give no word, with or without a typo.
    runs = Counter(_WORD.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")))
    for word, n in runs.items():
        h = zlib.crc32(word.encode(), start)
        if h % TYPO == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1:]
            if len(word) < MIN_LENGTH:
                continue
        counts[word] += n


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def give() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    for batch in batches:
        for name, text in zip(batch.column(0), batch.column(1), strict=True):
            if text.is_valid:
                text_words((name.as_py() + ":").encode(), text.as_py(), counts)
            if len(counts) > HELD_WORDS:
                yield give()
                counts.clear()
    yield give()


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the words that count."""
    texts = docs.select(F.coalesce(docs[id_col].cast("string"), F.lit("")).alias("id"), docs[text_col].cast("string").alias("text"))
    return texts.mapInArrow(_counted, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


# ------------------------------------------------------------- rolling hashes

def _powers(n: int) -> np.ndarray:
    steps = np.full(n, _BASE, dtype=np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


def _points(words: list[str]) -> np.ndarray:
    """Code points of words of equal length, one row for each."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(len(words), -1).astype(np.uint64)


def _plain(points: np.ndarray) -> np.ndarray:
    """Hash of each row before the last mixing: the sum of code point * BASE^place."""
    return (points * _powers(points.shape[1])).sum(axis=1, dtype=np.uint64)


def _final(plain: np.ndarray, length: int) -> np.ndarray:
    return mix64(plain + np.uint64(length * 0xD6E8FEB86659FD93 & (2**64 - 1)))


def _by_length(words: list[str]) -> dict[int, np.ndarray]:
    """Places of the words of each length."""
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    return {n: np.flatnonzero(lengths == n) for n in np.unique(lengths).tolist()}


def word_keys(words: list[str]) -> np.ndarray:
    """A 64-bit hash of each word."""
    out = np.zeros(len(words), dtype=np.uint64)
    for n, mine in _by_length(words).items():
        # Long words few at a time.
        for part in np.array_split(mine, -(-len(mine) * n // EDITS)):
            out[part] = _final(_plain(_points([words[i] for i in part.tolist()])), n)
    return out


def _masks(keys: np.ndarray, k: int) -> np.ndarray:
    """The bit that a key sets in the k-th 64-bit part of its block."""
    return np.uint64(1) << ((keys >> np.uint64(6 * k)) & np.uint64(63))


def _block(keys: np.ndarray, blocks: int) -> np.ndarray:
    return ((mix64(keys.copy()) >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)


class Filters:
    """Blocked Bloom filters, one for each length: ``sizes`` blocks for each shard."""

    def __init__(self, sizes: dict[int, int]):
        self.sizes = sizes
        self.first = dict(zip(sizes, np.cumsum([0, *sizes.values()]).tolist(), strict=False))
        self.bits = np.zeros((sum(sizes.values()), 8), dtype=np.uint64)

    def place(self, keys: np.ndarray, length: int) -> np.ndarray:
        shard = min(length, LAST_SHARD)
        return self.first[shard] + _block(keys, self.sizes[shard])

    def hits(self, keys: np.ndarray, length: int) -> np.ndarray:
        """Places of the keys that may be words of this length."""
        if min(length, LAST_SHARD) not in self.sizes:
            return np.zeros(0, dtype=np.int64)
        left = np.arange(len(keys))
        block = self.place(keys, length)
        for k in range(8):
            left = left[(self.bits[block[left], k] & _masks(keys[left], k)) != 0]
        return left


def filter_sizes(words: DataFrame) -> dict[int, int]:
    """Blocks for each length; at most ``LAST_SHARD`` lengths, ``FILTER_BLOCKS`` blocks."""
    counts = dict(sorted((r[0], r[1]) for r in words.groupBy(F.least(F.length("word"), F.lit(LAST_SHARD))).count().collect()))
    scale = min(WORD_BITS / 512, (FILTER_BLOCKS - LAST_SHARD) / max(1, sum(counts.values())))
    return {length: 1 + int(n * scale) for length, n in counts.items()}


def build_filters(words: DataFrame) -> Filters:
    """Filters of the words; ``bit_or`` for each block runs in Spark."""
    filters = Filters(filter_sizes(words))
    if not filters.sizes:
        return filters
    empty = Filters(filters.sizes)
    empty.bits = empty.bits[:0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(0).to_pylist()
            keys = word_keys(held)
            block = np.zeros(len(held), dtype=np.int64)
            for n, mine in _by_length(held).items():
                block[mine] = empty.place(keys[mine], n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(block), *(pa.array(_masks(keys, k).astype(np.int64)) for k in range(8))],
                names=["block", *(f"b{k}" for k in range(8))])

    made = (words.select("word").mapInArrow(run, "block bigint, " + ", ".join(f"b{k} bigint" for k in range(8)))
            .groupBy("block").agg(*(F.bit_or(f"b{k}").alias(f"b{k}") for k in range(8))).toArrow())
    filters.bits[made.column("block").to_numpy()] = np.stack(
        [made.column(f"b{k}").to_numpy() for k in range(8)], axis=1).astype(np.uint64)
    return filters


def _suffix_sums(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms of each place, their sums up to it, and the sums from it on moved down by
    one place (as after a deletion before it)."""
    n = points.shape[1]
    powers = _powers(n)
    terms = points * powers
    before = np.cumsum(terms, axis=1, dtype=np.uint64) - terms
    down = np.zeros_like(points)
    down[:, 1:] = points[:, 1:] * powers[:-1]
    after = np.cumsum(down[:, ::-1], axis=1, dtype=np.uint64)[:, ::-1]
    return terms, before, after


def edits(words: list[str], alphabet: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, place of the word, hash) of every deletion, and of every replacement
    by a greater code point, of words of equal length, about ``EDITS`` at a time."""
    n = len(words[0])
    rows = max(1, EDITS // (n * max(1, len(alphabet))))
    for first in range(0, len(words), rows):
        points = _points(words[first:first + rows])
        terms, before, after = _suffix_sums(points)
        whole = before[:, -1] + terms[:, -1]
        # Of a run of equal code points one deletion is enough.
        new = np.ones(points.shape, dtype=bool)
        new[:, 1:] = points[:, 1:] != points[:, :-1]
        row, at = np.nonzero(new)
        left = np.where(at + 1 < n, after[row, np.minimum(at + 1, n - 1)], np.uint64(0))
        yield n - 1, first + row, _final(before[row, at] + left, n - 1)
        powers = _powers(n)
        wide = max(1, EDITS // (len(points) * max(1, len(alphabet))))
        for a in range(0, n, wide):
            row, at, by = np.nonzero(points[:, a:a + wide, None] < alphabet)
            at = at + a
            changed = whole[row] + (alphabet[by] - points[row, at]) * powers[at]
            yield n, first + row, _final(changed, n)


def keyed(words: DataFrame) -> DataFrame:
    """(word, n, key): the words with their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(word_keys(batch.column(0).to_pylist()).astype(np.int64))], names=["word", "n", "key"])

    return words.mapInArrow(run, "word string, n bigint, key bigint")


def near_words(words: DataFrame, filters: Filters) -> DataFrame:
    """(word, n, near, near_n) for each word and each word one edit away, from the
    written vocabulary with its keys."""
    spark = words.sparkSession
    shared = spark.sparkContext.broadcast(filters)
    # At most the code points of the pattern.
    used = sorted(ord(r[0]) for r in words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).where("c <> ''").distinct().collect())
    alphabet = np.array(used, dtype=np.uint64)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = shared.value
        for batch in batches:
            held = batch.column(0).to_pylist()
            mine = batch.column(1).to_numpy()
            for places in _by_length(held).values():
                for length, word, keys in edits([held[i] for i in places.tolist()], alphabet):
                    hit = bloom.hits(keys, length)
                    if len(hit):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(mine[places[word[hit]]]), pa.array(keys[hit].astype(np.int64))], names=["key", "near_key"])

    tasks = max(spark.sparkContext.defaultParallelism, -(-words.count() // TASK_WORDS))
    found = words.select("word", "key").repartition(tasks, "key").mapInArrow(probe, "key bigint, near_key bigint")
    other = words.select(F.col("key").alias("near_key"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    pairs = written(found.join(other, "near_key").join(words, "key").where(F.levenshtein("word", "near", 1) == 1)
                    .select("word", "n", "near", "near_n"), "near-words")
    return pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"),
                                          F.col("word").alias("near"), F.col("n").alias("near_n")))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words with a form, from a written table: pointers double
    until none moves.  A form occurs ``RATIO`` times as often as its word, so chains
    are short and end."""
    roots, moving = forms.select("word", F.col("form").alias("root")), True
    while moving:
        jump = roots.select(F.col("word").alias("root"), F.col("root").alias("__next"))
        roots = written(roots.join(jump, "root", "left").select(
            "word", F.coalesce("__next", "root").alias("root"), F.col("__next").isNotNull().alias("__moved")), "roots")
        moving, roots = not roots.where("__moved").isEmpty(), roots.select("word", "root")
    return roots


def _largest() -> Column:
    """The near word of largest count, then the smallest one."""
    return F.min(F.struct((-F.col("near_n")).alias("minus"), "near"))


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n of every vocabulary word."""
    words = written(keyed(vocabulary(docs, id_col, text_col)), "words")
    near = near_words(words, build_filters(words))
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), _largest().alias("best"))
    is_form = -F.col("best.minus") >= RATIO * F.col("n")
    table = written(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.minus")).alias("form_n")), "forms")
    roots = _roots(table.where("form IS NOT NULL"))
    return table.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
