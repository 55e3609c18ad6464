"""Near-duplicate groups by SuperMinHash signatures, banding and verification.

A document's set holds the hashes of its distinct five-word shingles (A-Z
lower-cased; fewer words: the whole sequence as one; none: empty, linked with
nothing).  SuperMinHash (Ertl, 2017) gives every element a random permutation of
the signature's places with increasing ranks: the values of round j lie in [j, j+1),
so the signature is final as soon as each place has a value, for most texts after
the first round, and its variance is below that of independent hashes.

Documents with equal sets are one *class* from then on.  Classes that share a band
are compared:

1. Buckets are cut into blocks of at most ``BLOCK`` classes in a random order.  Inside
   a block the estimated similarities give a maximum spanning forest, whose edges
   alone are verified on the full sets.  Union-find over the true links joins
   nearly all classes that belong together.
2. Buckets that still hold several components are compared exactly: the classes of
   all but the bucket's largest component visit every block with their full sets, and
   pairs of different components whose estimate is not clearly too low are verified,
   the likeliest first, until the two are joined.  Only links leave the task, no pair
   inside a component is looked at again, and the largest component stays where it is,
   so a few odd classes in a bucket of many copies cost their number times its blocks.

So the work follows the size of the buckets, not its square, where a bucket is one
group; and no cap drops a pair.  With 24 bands of five places, a pair at the
threshold 0.85 shares no band with a probability below 1e-6; the margin of the
estimate leaves out such a pair with a probability below 1e-5.

Null text counts as empty.  Repeated rows are documents like others.  A null id
counts as larger than any other.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _GOLD, chunks, doc_words, map_texts, mix64, windows, written
from .components import components

WIDTH, PLACES, BAND = 5, 120, 5
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Classes in a block, and bytes of their sets.
BLOCK, BLOCK_BYTES = 512, 32 << 20
#: Estimates this far below the threshold are not verified (over 4 deviations).
MARGIN = 0.15
_ROUND = np.uint64(56)


def shingles(hashes: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct shingle hashes of a document's word hashes."""
    if not len(hashes):
        return np.zeros(0, dtype=np.uint64)
    if len(hashes) < width:
        return windows(hashes, len(hashes)) ^ np.uint64(len(hashes))
    return np.unique(windows(hashes, width))


def superminhash(items: np.ndarray, places: int = PLACES) -> np.ndarray:
    """Signature of a set of 64-bit hashes: for each place the smallest
    (round, random) value that an element puts there."""
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(places, top)
    order, n = None, len(items)
    rows = np.arange(n)
    for j in range(places):
        draw = mix64(items + np.uint64(((j + 1) * int(_GOLD)) & (2**64 - 1)))
        value = (np.uint64(j) << _ROUND) | (draw >> np.uint64(8))
        pick = j + ((draw * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(33)).astype(np.int64) % (places - j)
        if j == 0:
            place = first = pick
        else:
            if order is None:
                # The permutations so far: the identity with places 0 and first exchanged.
                order = np.broadcast_to(np.arange(places, dtype=np.int16), (n, places)).copy()
                order[rows, 0] = first
                order[rows, first] = np.where(first == 0, first, 0)
            place = order[rows, pick].copy()
            order[rows, pick] = order[:, j]
            order[:, j] = place
        np.minimum.at(out, place, value)
        if out.max() != top:
            break
    return out


def bands(signature: np.ndarray, band: int = BAND) -> np.ndarray:
    """One key for each ``band`` places."""
    parts = signature.reshape(-1, band)
    total = np.arange(1, len(parts) + 1, dtype=np.uint64) * _GOLD
    for k in range(band):
        total = mix64(total + parts[:, k])
    return total


def _signatures(texts: list) -> list[list]:
    out: list[list] = [[] for _ in range(5)]
    for _, _, held in chunks(texts):
        at, _, _, hashes, _ = doc_words(held, fold=True)
        for i in range(len(held)):
            items = shingles(hashes[at[i]:at[i + 1]])
            out[0].append(len(items))
            if not len(items):
                for column in out[1:]:
                    column.append(None)
                continue
            signature = superminhash(items)
            with np.errstate(over="ignore"):
                out[1].append(int(items.sum(dtype=np.uint64).astype(np.int64)))
                out[2].append(int(np.bitwise_xor.reduce(mix64(items.copy())).astype(np.int64)))
            out[3].append(bands(signature).astype(np.int64))
            out[4].append((signature >> np.uint64(20)).astype(np.uint8).tobytes())
    return out


def _sets(texts: list) -> list[list]:
    out: list = []
    for _, _, held in chunks(texts):
        at, _, _, hashes, _ = doc_words(held, fold=True)
        out.extend(shingles(hashes[at[i]:at[i + 1]]).astype("<u8").tobytes() for i in range(len(held)))
    return [out]


def estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of each row of a with each of b (signature bytes)."""
    out = np.zeros((len(a), len(b)), dtype=np.float32)
    for i in range(len(a)):
        out[i] = (a[i] == b).mean(axis=1)
    return (out - 1 / 256) * (256 / 255)


def _groups(batches: Iterator[pa.RecordBatch], keys: int, numbers: int) -> Iterator[list[np.ndarray]]:
    """The columns of each run of equal leading ``keys`` columns; a run may go over
    several batches.  ``numbers`` columns hold integers, the last one signatures (a
    matrix)."""
    held: list[list[np.ndarray]] = []

    def give(parts: list) -> list[np.ndarray]:
        return [np.concatenate(x) for x in zip(*parts, strict=True)]

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(numbers)]
        columns.append(np.frombuffer(b"".join(batch.column(numbers).to_pylist()), dtype=np.uint8).reshape(n, -1))
        change = np.zeros(n, dtype=bool)
        for i in range(keys):
            change[1:] |= columns[i][1:] != columns[i][:-1]
        if held and any(held[-1][i][-1] != columns[i][0] for i in range(keys)):
            yield give(held)
            held = []
        cuts = [0, *np.flatnonzero(change).tolist(), n]
        for first, last in zip(cuts, cuts[1:], strict=False):
            if first and held:
                yield give(held)
                held = []
            held.append([c[first:last] for c in columns])
    if held:
        yield give(held)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(bucket, block, visits, then arrays: node, n, component, signatures, sets) of each
    run of equal (bucket, block, visits) within a batch."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        keys = [batch.column(i).to_numpy() for i in range(3)]
        columns = [batch.column(i).to_numpy() for i in range(3, 6)]
        columns.append(np.frombuffer(b"".join(batch.column(6).to_pylist()), dtype=np.uint8).reshape(n, -1))
        columns.append(np.array([None, *batch.column(7).to_pylist()], dtype=object)[1:])
        change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        for first, last in zip([0, *change.tolist()], [*change.tolist(), n], strict=True):
            yield (*(int(k[first]) for k in keys), *(c[first:last] for c in columns))


def _pairs(found: dict) -> pa.RecordBatch:
    pairs = np.array(list(found), dtype=np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _spanning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, block, node, n, signature) -> edges of a maximum spanning forest of
    each block by estimate."""
    least = PERCENT / 100 - MARGIN
    found: dict = {}
    for _, _, node, size, signature in _groups(batches, 2, 4):
        count = len(node)
        if count < 2:
            continue
        similar = estimates(signature, signature)
        small, large = np.minimum.outer(size, size), np.maximum.outer(size, size)
        similar[100 * small < PERCENT * large] = -1
        # Prim's algorithm over all nodes; edges below the margin are left out.
        best, by = similar[0].copy(), np.zeros(count, dtype=np.int64)
        inside = np.zeros(count, dtype=bool)
        inside[0] = True
        for _ in range(count - 1):
            i = int(np.where(inside, -2, best).argmax())
            if best[i] >= least:
                found[min(node[i], node[by[i]]), max(node[i], node[by[i]])] = None
            inside[i] = True
            better = similar[i] > best
            best[better], by[better] = similar[i][better], i
        if len(found) > 100_000:
            yield _pairs(found)
            found = {}
    yield _pairs(found)


def _is_link(x: bytes, y: bytes) -> bool:
    x, y = np.frombuffer(x, dtype="<u8"), np.frombuffer(y, dtype="<u8")
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= PERCENT * (len(x) + len(y) - both)


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, block, visits, node, n, component, signature, set), sorted by the first
    three: those at home in a block come first and are held (a block is bounded), then
    each visitor passes by -> links between components."""
    least = PERCENT / 100 - MARGIN
    found: dict = {}
    key, held, parent, home = None, [], {}, None

    def find(x: int) -> int:
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for bucket, block, visits, node, size, part, signature, sets in _runs(batches):
        if (bucket, block) != key:
            key, held, parent, home = (bucket, block), [], {}, None
        if not visits:
            held.append((node, size, part, signature, sets))
            continue
        if home is None:
            home = [np.concatenate(x) for x in zip(*held, strict=True)] if held else []
        if not home:
            continue
        nodes, sizes, parts, signatures, full = home
        for i in range(len(node)):
            other = np.flatnonzero((parts != part[i]) & (100 * np.minimum(sizes, size[i]) >= PERCENT * np.maximum(sizes, size[i])))
            if not len(other):
                continue
            similar = ((signatures[other] == signature[i]).mean(axis=1) - 1 / 256) * (256 / 255)
            other, similar = other[similar >= least], similar[similar >= least]
            for o in other[np.argsort(-similar, kind="stable")].tolist():
                x, y = find(int(part[i])), find(int(parts[o]))
                if x != y and _is_link(sets[i], full[o]):
                    parent[max(x, y)] = min(x, y)
                    found[min(node[i], nodes[o]), max(node[i], nodes[o])] = None
        if len(found) > 100_000:
            yield _pairs(found)
            found = {}
    yield _pairs(found)


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, set of a, set of b) -> the pairs that are links."""
    for batch in batches:
        keep = [_is_link(x.as_buffer(), y.as_buffer()) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _full_sets(nodes: DataFrame, docs: DataFrame, classes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, items) of the classes in ``nodes``; only their texts are read again."""
    wanted = nodes.distinct().join(classes, "node").select("node", "__dk")
    keyed = docs.select(_document_key(id_col, text_col).alias("__dk"), F.col(text_col).alias("__t"))
    # Rows with one key have one text, so any of them will do.
    texts = keyed.join(wanted, "__dk").select("node", "__t")
    return written(map_texts(texts, "__t", ["node"], "items binary", lambda: _sets, [pa.binary()])
                   .dropDuplicates(["node"]), "sets")


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets are similar enough."""
    pairs = written(pairs.distinct(), "pairs")
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b"))
    sets = _full_sets(nodes, docs, classes, id_col, text_col)
    return (pairs.join(sets.select(F.col("node").alias("a"), F.col("items").alias("x")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("items").alias("y")), "b")
            .select("a", "b", "x", "y").mapInArrow(_linked, "a bigint, b bigint"))


def _document_key(id_col: str, text_col: str):
    return F.xxhash64(F.col(id_col), F.col(text_col))


def _place():
    """A row's place in the order of ids; a null id comes last."""
    return F.struct(F.col("__id").isNull().alias("none"), F.col("__id"), F.col("__dk"))


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(__id, __dk, __n, __first: id and key of the group's first row) of every row;
    __first is null for empty sets."""
    made = "__n bigint, __d1 bigint, __d2 bigint, __bands array<bigint>, __sig binary"
    types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
    prepared = docs.select(F.col(id_col).alias("__id"), _document_key(id_col, text_col).alias("__dk"), F.col(text_col).alias("__t"))
    signed = written(map_texts(prepared, "__t", ["__id", "__dk"], made, lambda: _signatures, types)
                     .withColumn("__row", F.monotonically_increasing_id()), "signatures")
    same = ["__n", "__d1", "__d2"]
    # One class for each set; its node is the smallest row number.
    classes = written(signed.where("__n > 0").groupBy(*same).agg(
        F.min("__row").alias("node"), F.min(_place()).alias("__least"), F.min("__dk").alias("__dk"),
        F.min(F.struct("__bands", "__sig")).alias("__s")).select(
        *same, "node", "__least", "__dk", "__s.__bands", "__s.__sig"), "classes")
    spread = classes.select("node", "__n", F.explode("__bands").alias("bucket"))
    shared = written(spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("__count"), F.bit_xor(F.xxhash64("node")).alias("__who"),
                                                 F.sum("__n").alias("__items"))
                     .where("__count > 1")
                     .withColumn("__blocks", F.ceil(F.greatest(F.col("__count") / BLOCK, F.col("__items") * 8 / BLOCK_BYTES)).cast("long"))
                     # Buckets with the same classes need one look.
                     .groupBy("__count", "__who", "__blocks").agg(F.min("bucket").alias("bucket")).select("bucket", "__blocks"), "buckets")
    members = written(spread.join(shared, "bucket").withColumn("block", F.pmod(F.xxhash64("bucket", "node"), F.col("__blocks")))
                      .join(classes.select("node", "__sig"), "node")
                      .select("bucket", "__blocks", "block", "node", "__n", "__sig"), "members")
    near = (members.select("bucket", "block", "node", "__n", "__sig").repartition("bucket", "block")
            .sortWithinPartitions("bucket", "block", "node").mapInArrow(_spanning, "a bigint, b bigint"))
    links = written(_verified(near, docs, classes, id_col, text_col), "links")
    roots = components(links)

    rooted = members.join(roots, "node", "left").withColumn("__part", F.coalesce("root", "node")).drop("root")
    sizes = rooted.groupBy("bucket", "__part").agg(F.count(F.lit(1)).alias("c"))
    mixed = written(sizes.groupBy("bucket").agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("c", "__part")).alias("most"))
                    .where("parts > 1").select("bucket", F.col("most.__part").alias("__most")), "mixed-buckets")
    left = written(rooted.join(mixed, "bucket"), "mixed-members")
    sets = _full_sets(left.select("node"), docs, classes, id_col, text_col)
    everyone = F.sequence(F.lit(0).cast("long"), F.col("__blocks") - 1)
    travels = left.where("__part <> __most").withColumn("block", F.explode(everyone)).withColumn("__visits", F.lit(1))
    rest = (left.withColumn("__visits", F.lit(0)).unionByName(travels)
            .select("bucket", "block", "__visits", "node", "__n", "__part", "__sig").join(sets, "node")
            .select("bucket", "block", "__visits", "node", "__n", "__part", "__sig", "items")
            .repartition("bucket", "block").sortWithinPartitions("bucket", "block", "__visits", "node")
            .mapInArrow(_across, "a bigint, b bigint"))
    more = written(rest, "links")
    roots = components(links.unionByName(more))

    grouped = written(classes.select(*same, "node", "__least").join(roots, "node", "left").select(
        *same, F.coalesce("root", "node").alias("__root"), "__least"), "grouped")
    ids = grouped.groupBy("__root").agg(F.min("__least").alias("__first"))
    named = grouped.join(ids, "__root").select(*same, "__first")
    return signed.select("__id", "__dk", *same).join(named, same, "left").select("__id", "__dk", "__n", "__first")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id (smallest id of the group) and kept of every row."""
    return _named(docs, id_col, text_col).select(
        F.col("__id").alias(id_col), F.col("__n").alias("n_shingles"),
        F.coalesce("__first.__id", "__id").alias("component_id")).withColumn(
        "kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: the first of each group by id, then by a hash of
    id and text, and all rows without a word.  Ids may repeat: rows of one id are told
    apart by their texts, and only rows repeated whole stay or go together."""
    # Rows without a word have no group.
    gone = written(_named(docs, id_col, text_col).where(F.col("__first").isNotNull() & ~F.col("__first").eqNullSafe(_place()))
                   .select("__id", "__dk").distinct(), "near-copies")
    keyed = docs.withColumn("__key", _document_key(id_col, text_col))
    return keyed.join(gone, (keyed["__key"] == gone["__dk"]) & keyed[id_col].eqNullSafe(gone["__id"]), "left_anti").drop("__key")
