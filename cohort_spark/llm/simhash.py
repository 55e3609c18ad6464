"""Near-duplicate groups by SimHash fingerprints and deletion-variant signatures.

Texts have A-Z lower-cased; shingles are three words (repeats included) joined by one
space, the whole sequence if it is shorter, none without words.  A fingerprint bit is 1 if
it is set in over half of the shingles' XXH64 values (seed 42); without words it is zero.

Fingerprints of at most two differing bits are linked.  Cut into ``SEGMENTS`` = 2 halves,
one half of such a pair differs in one bit at most.  So each distinct fingerprint is
indexed under its halves with one bit taken out (64 keys, exact, no hashing); a pair
meets under the key of the bit in which a half differs, or, if the halves are equal,
under the key of bit 0.  The equality join of a key verifies the distance.

A key with over ``CROWD`` distinct fingerprints is not compared pair by pair.  Its members
emit finer keys: the whole fingerprint with the two bits taken out in which a linked pair
of that key can differ.  A finer key holds four fingerprints at most, all of them linked,
so they are joined to its smallest.  Work is in proportion to the fingerprints, and no
link is left out.

Null text counts as empty.  Rows repeated whole, and rows of equal fingerprints, are
linked like others.  A null id counts as larger than any other.  An empty table gives no
rows.  Extra columns are not touched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts, written
from .components import components

WIDTH, SEED, BITS = 3, 42, 64
#: Links have at most so many differing bits, and one of two halves at most one.
DISTANCE, SEGMENTS, HALF = 2, 2, 32
#: Distinct fingerprints of a key that are compared with each other.
CROWD = 512
#: Fingerprints whose keys one task makes.
TASK_PRINTS = 8000
#: Shingles whose bits are counted at once.
CHUNK = 1 << 16


def fingerprint(text: str | None) -> int:
    """The fingerprint as a signed 64-bit integer."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    whole = memoryview(b" ".join(words))
    width = min(WIDTH, len(words))
    n = len(words) - width + 1
    ones = np.zeros(BITS, dtype=np.int64)
    for first in range(0, n, CHUNK):
        last = min(n, first + CHUNK)
        hashes = np.array([xxhash.xxh64_intdigest(whole[a:b], SEED) for a, b in zip(
            starts[first:last].tolist(), ends[first + width - 1:last + width - 1].tolist(), strict=True)], dtype=">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits((2 * ones > n).astype(np.uint8))
    return int(bits.view(">i8")[0])


def _fingerprints(texts: list) -> list[list]:
    return [[fingerprint(t) for t in texts]]


def _half(fp: Column, segment: int) -> Column:
    """Half 0 is the upper one; as a number below 2^32."""
    return F.shiftrightunsigned(fp, HALF) if segment == 0 else fp.bitwiseAND(F.lit(0xFFFFFFFF))


def _variants(fp: Column) -> Column:
    """Structs (key, bit): number of the taken-out bit and the half without it, and the
    bit's value.  The number is the bit's place in the whole fingerprint."""
    out = []
    for segment in range(SEGMENTS):
        half, above = _half(fp, segment), HALF * (SEGMENTS - 1 - segment)
        for i in range(HALF):
            out.append(F.struct(
                (half.bitwiseAND(F.lit(0xFFFFFFFF ^ (1 << i))) + F.lit((above + i) << HALF)).alias("key"),
                F.getbit(half, F.lit(i)).cast("tinyint").alias("bit")))
    return F.array(*out)


def _place(key: Column) -> Column:
    return F.shiftright(key, HALF).cast("int")


def _finer() -> Column:
    """Structs (p, q, rest): ``fp`` without bits p and q, for all pairs in which linked
    members of the crowded key of bit ``place`` can differ: that bit and one of the other
    half, or, for equal halves (under their bit 0), two bits of the other half."""
    other = F.expr(f"IF(place >= {HALF}, sequence(0, {HALF - 1}), sequence({HALF}, {BITS - 1}))")
    mixed = F.transform(other, lambda q: F.struct(F.col("place").alias("p"), q.alias("q")))
    inside = F.flatten(F.transform(other, lambda p: F.transform(
        F.filter(other, lambda q: q > p), lambda q: F.struct(p.alias("p"), q.alias("q")))))
    return F.when(F.col("place") % HALF == 0, F.concat(mixed, inside)).otherwise(mixed)


def links(prints: DataFrame) -> DataFrame:
    """(a, b): links that join all distinct fingerprints (fp) at a distance of at most
    two; in crowded keys not each of them, but enough for the groups."""
    # A task's map of keys stays small.
    tasks = max(prints.sparkSession.sparkContext.defaultParallelism, -(-prints.count() // TASK_PRINTS))
    index = prints.repartition(tasks, "fp").select("fp", F.inline(_variants(F.col("fp")))).withColumn("place", _place(F.col("key")))
    # Without a differing bit a key says the same as that of bit 0 of its half.
    shared = written(index.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min("bit").alias("low"), F.max("bit").alias("high"))
        .where((F.col("n") > 1) & ((_place(F.col("key")) % HALF == 0) | (F.col("low") < F.col("high")))).select("key", "n"), "shared-keys")
    members = written(index.join(shared, "key"), "members")
    few = members.where(F.col("n") <= CROWD)
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE
    pairs = (few.select("key", "place", F.col("fp").alias("a"), F.col("bit").alias("x"))
             .join(few.select("key", F.col("fp").alias("b"), F.col("bit").alias("y")), "key")
             .where((F.col("a") < F.col("b")) & ((F.col("place") % HALF == 0) | (F.col("x") != F.col("y"))) & near)
             .select("a", "b"))
    finer = (members.where(F.col("n") > CROWD).select("fp", F.inline(_finer()))
             .withColumn("rest", F.expr("fp & ~(shiftleft(1L, p) | shiftleft(1L, q))")))
    # Which of the four fingerprints of a finer key are there, as four bits.
    there = F.expr("bit_or(shiftleft(1, CAST(2 * getbit(fp, p) + getbit(fp, q) AS int)))")
    found = finer.groupBy("p", "q", "rest").agg(there.alias("there")).where(F.bit_count("there") > 1)
    four = F.expr("transform(filter(sequence(0, 3), i -> getbit(there, i) = 1), "
                  "i -> rest | shiftleft(CAST(i div 2 AS bigint), p) | shiftleft(CAST(i % 2 AS bigint), q))")
    stars = (found.select(four.alias("all")).select(F.element_at("all", 1).alias("a"), F.explode(F.slice("all", 2, 3)).alias("b"))
             .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where(near))
    return written(pairs.union(stars.select("a", "b")).distinct(), "links")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fingerprint (16 hexadecimal digits) and component_id (smallest id of the
    group) of every row."""
    signed = written(map_texts(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t")), "__t", ["__id"],
                               "fp bigint", lambda: _fingerprints, [pa.int64()]), "fingerprints")
    prints = written(signed.groupBy("fp").agg(F.min("__id").alias("least")), "distinct-fingerprints")
    roots = components(links(prints.select("fp")))
    rooted = written(prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return signed.join(named, "fp", "left").select(
        F.col("__id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
