"""Quality rules with cross-document line frequency.

Each text is read once: its base figures, and the hash of each distinct normalised
line (words joined by one space, A-Z lower-cased) with the words it stands for, go
into a narrow written table.  Documents are counted for each (host, line); a line in
more than ``max(MIN_DOCS, SHARE of the host's documents)`` documents of a host is
boilerplate there and is removed.  A document that loses more than half of its words
that way is depleted and rejected.

Counting is pre-aggregated before the shuffle, so a line that all documents share is
no hot key.  Null text has no words (base_failed).  A null host is a host of its own.
Repeated rows are separate documents.  An empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, doc_words, map_texts, windows, written

MIN_DOCS, SHARE = 20, 0.01
MIN_WORDS, MAX_REPEATED = 50, 0.5
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACES, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
_FOLD = {u: u + 32 for u in range(0x41, 0x5B)}


def line_key(line: str) -> int:
    """Hash of a normalised line as a signed 64-bit integer."""
    return xxhash.xxh64_intdigest(" ".join(WORD.findall(line)).translate(_FOLD).encode("utf-8", "surrogatepass")) - (1 << 63)


def repeated_words(hashes: np.ndarray, width: int = 3) -> int:
    """Words in ``width``-word windows that occur twice or more."""
    found = windows(hashes, width)
    if len(found) < 2:
        return 0
    order = np.argsort(found, kind="stable")
    same = found[order[1:]] == found[order[:-1]]
    twice = np.zeros(len(found), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(hashes), dtype=bool)
    for k in range(width):
        covered[k:k + len(found)] |= twice
    return int(covered.sum())


def _figures(texts: list) -> list[list]:
    out: list[list] = [[] for _ in range(7)]
    for first, last, held in chunks(texts):
        at, _, _, hashes, _ = doc_words(held)
        for i in range(first, last):
            text, words = texts[i] or "", hashes[at[i - first]:at[i - first + 1]]
            out[0].append(len(words))
            out[1].append(len(text) - sum(map(text.count, SPACES)))
            out[2].append(sum(map(text.count, SYMBOLS)))
            seen: set[str] = set()
            repeats, lines = 0, {}
            for line in text.split("\n"):
                n = len(WORD.findall(line))
                if n:
                    repeats += line in seen
                    seen.add(line)
                    key = line_key(line)
                    lines[key] = lines.get(key, 0) + n
            out[3].append(repeats)
            out[4].append(repeated_words(words))
            out[5].append(list(lines))
            out[6].append(list(lines.values()))
    return out


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
           min_docs: int = MIN_DOCS, share: float = SHARE) -> DataFrame:
    """id, the base figures, base_failed, removed_words, removed_lines (hashes) and
    kept of every row."""
    made = ("n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
            "__lines array<bigint>, __words array<bigint>")
    types = [pa.int64()] * 5 + [pa.list_(pa.int64())] * 2
    prepared = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t"),
                           F.xxhash64(F.col(host_col).isNull(), F.col(host_col)).alias("__host"))
    figures = written(map_texts(prepared, "__t", ["__id", "__host"], made, lambda: _figures, types)
                      .withColumn("__row", F.monotonically_increasing_id()), "quality")
    hosts = figures.groupBy("__host").agg(F.greatest(F.lit(float(min_docs)), F.count(F.lit(1)) * F.lit(share)).alias("__limit"))
    each = figures.select("__row", "__host", F.inline(F.arrays_zip(F.col("__lines").alias("line"), F.col("__words").alias("words"))))
    frequent = written(each.groupBy("__host", "line").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > min_docs)
                       .join(hosts, "__host").where(F.col("__n") > F.col("__limit")).select("__host", "line"), "frequent-lines")
    removed = each.join(frequent, ["__host", "line"]).groupBy("__row").agg(
        F.sum("words").alias("__removed"), F.collect_list("line").alias("__removed_lines"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > int(100 * MAX_REPEATED) * F.col("n_words"))
    return figures.drop("__lines", "__words").join(removed, "__row", "left").select(
        F.col("__id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), F.coalesce("__removed", F.lit(0)).cast("long").alias("removed_words"),
        F.coalesce("__removed_lines", F.array().cast("array<bigint>")).alias("removed_lines"),
        (~failed & (2 * F.coalesce("__removed", F.lit(0)) <= F.col("n_words"))).alias("kept"))


def clean(docs: DataFrame, decisions: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The kept rows of ``docs`` without their frequent lines (ids must be unique)."""
    kept = decisions.where("kept").select(F.col(id_col), F.col("removed_lines").alias("__gone"))
    joined = docs.join(kept, id_col)

    @F.udf("string")
    def strip(text: str, gone: list) -> str:
        out = set(gone)
        return "\n".join(x for x in text.split("\n") if not WORD.search(x) or line_key(x) not in out)

    new = F.when(F.size("__gone") > 0, strip(F.col(text_col), F.col("__gone"))).otherwise(F.col(text_col))
    return joined.withColumn(text_col, new).select(*docs.columns)
