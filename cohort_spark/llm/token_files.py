"""Token ids as binary files: Simple-8b words with escapes and block offsets.

A *segment* is one binary value with the ids of consecutive documents:

    header    magic "S8TK", documents, ids, blocks, words, escapes (5 x uint32)
    lengths   ids of each document (uint32)
    offsets   first word of each block of ``BLOCK`` ids (uint32)
    escapes   ids of 60 bits and more (uint64)
    words     64-bit words: selector in the top 4 bits, ids from the lowest bits up

Selector 0 is an escape (the word holds an index into the escapes); the others
pack ``SELECTORS[s - 1]`` = (ids, bits of each).  Blocks start with a word of
their own, so they can be decoded on their own and all at once.

Segments are the rows of a Parquet table written by Spark: its commit protocol
makes a rerun of a task after the loss of an executor replace the first attempt,
and any file system Spark knows will do.  Null text counts as empty (the end id
alone); equal ids follow each other in the order of their texts' checksums.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _powers as powers
from .common import mix64, written

VOCABULARY, END_ID = "byte_bpe_50k.json", 2
#: (ids in a word, bits of each): fixed values of the format.
SELECTORS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
BLOCK = 1024
MAGIC = b"S8TK"
#: A segment closes once it has so many ids (it looks after every 200 documents).
SEGMENT_IDS = 1 << 18
REMEMBERED = 1_500_000
#: Pieces joined for one call of the library, and the token character for a space.
STRUNG, SPACE = 500, "\u0120"
#: Characters split at once, and the character between texts (none up to U+024F).
CHUNK, MARK = 1 << 20, "\uffff"


def _selectors(ids: np.ndarray) -> np.ndarray:
    """For each id the number of the narrowest selector that holds it (0: none)."""
    limits = np.array([1 << bits for _, bits in SELECTORS], dtype=np.uint64)
    if not len(ids) or ids.max() < 1 << 16:
        table = np.searchsorted(limits, np.arange(1 << 16, dtype=np.uint64), side="right").astype(np.uint8) + 1
        return table[ids.astype(np.uint16)]
    found = np.searchsorted(limits, ids, side="right").astype(np.uint8) + 1
    found[found > len(SELECTORS)] = 0
    return found


def _choices(ids: np.ndarray, blocks: int) -> np.ndarray:
    """The selector of a word that starts at each place: the one with the most ids of
    those that hold all ids there.  Past the end of its block anything fits."""
    n, longest = len(ids), SELECTORS[0][0]
    wide = np.zeros((blocks, BLOCK + longest), dtype=np.uint8)
    least = np.zeros(blocks * BLOCK, dtype=np.uint8)
    least[:n] = _selectors(ids) - np.uint8(1)  # escapes become 255, the widest
    wide[:, :BLOCK] = least.reshape(blocks, BLOCK)
    choice = np.zeros((blocks, BLOCK), dtype=np.uint8)
    # Maxima over windows of each selector's count, each from shorter windows.
    reach, top = 1, wide
    for s in range(len(SELECTORS), 0, -1):
        count = SELECTORS[s - 1][0]
        while reach < count:
            step = min(reach, count - reach)
            longer = top.copy()
            np.maximum(top[:, :-step], top[:, step:], out=longer[:, :-step])
            reach, top = reach + step, longer
        choice[top[:, :BLOCK] < s] = s
    return choice.reshape(-1)[:n]


def _starts(step: np.ndarray, blocks: int) -> np.ndarray:
    """Places where words start, given how far the word of each place goes; all blocks
    advance together."""
    first = np.zeros(len(step), dtype=bool)
    at, end = np.arange(blocks) * BLOCK, np.minimum(np.arange(1, blocks + 1) * BLOCK, len(step))
    while len(at):
        first[at] = True
        at = at + step[at]
        inside = at < end
        if not inside.all():
            at, end = at[inside], end[inside]
    return np.flatnonzero(first)


def pack(ids: np.ndarray, lengths: np.ndarray) -> bytes:
    """One segment of non-negative integers below 2^64."""
    ids = ids.astype(np.uint64)
    n = len(ids)
    blocks = -(-n // BLOCK)
    choice = _choices(ids, blocks)
    counts = np.array([1] + [c for c, _ in SELECTORS])
    start = _starts(counts[choice], blocks)
    selector = choice[start]
    word = np.repeat(np.arange(len(start)), np.diff(np.append(start, n)))
    escaped = selector == 0
    escapes = ids[start[escaped]]
    held = ids
    if len(escapes):
        held = ids.copy()
        held[start[escaped]] = np.arange(len(escapes), dtype=np.uint64)
    bits = np.array([0] + [b for _, b in SELECTORS], dtype=np.uint64)[selector]
    place = (np.arange(n) - start[word]).astype(np.uint64)
    words = selector.astype(np.uint64) << np.uint64(60)
    if n:
        words |= np.bitwise_or.reduceat(held << (place * bits[word]), start)
    offsets = np.searchsorted(start, np.arange(blocks) * BLOCK)
    header = np.array([len(lengths), n, blocks, len(words), len(escapes)], dtype="<u4")
    return MAGIC + header.tobytes() + lengths.astype("<u4").tobytes() + offsets.astype("<u4").tobytes() + escapes.astype("<u8").tobytes() + words.astype("<u8").tobytes()


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(ids, lengths of the documents) of a segment."""
    if data[:4] != MAGIC:
        raise ValueError("not a token segment")
    docs, n, blocks, size, kept = np.frombuffer(data, dtype="<u4", count=5, offset=4).tolist()
    at = 24
    lengths = np.frombuffer(data, dtype="<u4", count=docs, offset=at).astype(np.int64)
    at += 4 * docs
    offsets = np.frombuffer(data, dtype="<u4", count=blocks, offset=at).astype(np.int64)
    at += 4 * blocks
    escapes = np.frombuffer(data, dtype="<u8", count=kept, offset=at)
    at += 8 * kept
    words = np.frombuffer(data, dtype="<u8", count=size, offset=at).astype(np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = np.array([1] + [c for c, _ in SELECTORS])[selector]
    before = np.concatenate(([0], np.cumsum(counts)))[:-1]
    block = np.searchsorted(offsets, np.arange(size), side="right") - 1
    start = before - before[offsets[block]] + block * BLOCK if size else before
    end = np.minimum((block + 1) * BLOCK, n)
    out = np.zeros(n, dtype=np.uint64)
    for s in np.unique(selector).tolist():
        mine = np.flatnonzero(selector == s)
        if s == 0:
            out[start[mine]] = escapes[(words[mine] & np.uint64((1 << 60) - 1)).astype(np.int64)]
            continue
        count, bits = SELECTORS[s - 1]
        mask = np.uint64((1 << bits) - 1)
        for k in range(count):
            there = start[mine] + k
            inside = there < end[mine]
            out[there[inside]] = (words[mine][inside] >> np.uint64(k * bits)) & mask
    return out, lengths


#: The byte-level tokenizers' splitting rule, and what starts with an apostrophe.
_RULE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
                      r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
_BEYOND_LATIN = re.compile("[^\x00-\u024f]")
#: A place where no piece goes on, to cut long texts.
_CUT = re.compile("(?<=[A-Za-z]) (?=[A-Za-z])")
_BLANK, _LETTER, _NUMBER, _OTHER, _END = range(5)


def _classes() -> np.ndarray:
    """The class of each code point up to U+024F, and of the mark between texts."""
    table = np.full(1 << 16, _OTHER, dtype=np.uint8)
    for c in range(0x250):
        for kind, rule in ((_BLANK, r"\p{White_Space}"), (_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}")):
            if regex.fullmatch(rule, chr(c)):
                table[c] = kind
    table[ord(MARK)] = _END
    return table


_CLASS = _classes()
_HASHED = mix64(np.arange(1, (1 << 16) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_MARK_HASH = _HASHED[ord(MARK)]


def piece_starts(points: np.ndarray) -> np.ndarray:
    """Where the pieces of the splitting rule start, for code points up to U+024F with
    ``MARK`` between texts (each mark is a piece of its own)."""
    kind = _CLASS[points]
    first = np.ones(len(points), dtype=bool)
    first[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _END)
    # Of white space before something else the last character is not taken with the
    # rest; if it is a space, it opens the next piece.
    last = np.flatnonzero((kind[:-1] == _BLANK) & (kind[1:] != _BLANK) & (kind[1:] != _END))
    first[last] = True
    first[last[points[last] == 0x20] + 1] = False
    # 's 't 'm 'd 're 've 'll, where an apostrophe opens a piece and a letter follows.
    mark = np.flatnonzero(first[:-1] & (points[:-1] == 0x27) & (kind[1:] == _LETTER))
    if len(mark):
        padded = np.append(points, (0, 0, 0))
        one, two = padded[mark + 1], padded[mark + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = np.zeros(len(mark), dtype=bool)
        for a, b in ("re", "ve", "ll"):
            long |= (one == ord(a)) & (two == ord(b))
        first[mark[short | long] + 1] = False
        after = np.concatenate((mark[short] + 2, mark[long] + 3))
        first[after[after < len(points)]] = True
    return np.flatnonzero(first)


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... (count places) of each, one after the other."""
    ends = np.cumsum(counts)
    return np.repeat(starts - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)


class _Flat:
    """Numbered runs of integers in one growing array."""

    def __init__(self, kind: type):
        self.values, self.used = np.zeros(1 << 16, dtype=kind), 0
        self.at, self.count, self.size = np.zeros(1 << 12, dtype=np.int64), np.zeros(1 << 12, dtype=np.int64), 0

    def __len__(self) -> int:
        return self.size

    def place(self, size: int, numbers: np.ndarray, values: np.ndarray, counts: np.ndarray) -> None:
        """Runs for these numbers, all below ``size``."""
        if size > len(self.at):
            self.at, self.count = (np.resize(x, 2 * size) for x in (self.at, self.count))
        if self.used + len(values) > len(self.values):
            self.values = np.resize(self.values, 2 * (self.used + len(values)))
        self.values[self.used:self.used + len(values)] = values
        self.at[numbers], self.count[numbers] = self.used + np.cumsum(counts) - counts, counts
        self.used, self.size = self.used + len(values), size

    def add(self, values: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Runs with the next numbers, which it returns."""
        numbers = np.arange(self.size, self.size + len(counts))
        self.place(self.size + len(counts), numbers, values, counts)
        return numbers

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the runs one after the other, their sizes)."""
        counts = self.count[numbers]
        return self.values[_ranges(self.at[numbers], counts)], counts


class PieceEncoder:
    """The library's encoding of a text, with each distinct piece encoded once.

    The byte-level tokenizer encodes the pieces of its splitting rule on their
    own, so the ids of a text are those of its pieces.  Texts are split by array
    operations, a megabyte at a time; equal pieces are found by a hash and compared, and
    only the distinct ones become strings.  A text that holds the string of a special
    token goes to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.opens = np.array([(self.tokenizer.id_to_token(i) or "").startswith(SPACE) for i in range(size)])
        self.clear()

    def clear(self) -> None:
        """Forget all pieces.  Each has a number: the place and count of its ids, and of
        its code points; ``hashes`` (sorted) and ``named`` give the number."""
        self.named: dict[str, int] = {}
        self.hashes, self.number = np.array([_MARK_HASH]), np.zeros(1, dtype=np.int64)
        # Number 0 is the mark between texts, without ids.
        self.ids, self.points = _Flat(np.uint32), _Flat(np.uint32)
        self.ids.add(np.zeros(0, dtype=np.uint32), np.array([0]))
        self.points.add(np.array([ord(MARK)], dtype=np.uint32), np.array([1]))

    def learn(self, pieces: list[str]) -> np.ndarray:
        """Encode distinct pieces without a special token; their numbers.

        Pieces of one space and no other white space are joined to longer texts,
        where the rule finds them again; a token with the space then starts each.
        """
        numbers = np.zeros(len(pieces), dtype=np.int64)
        spaced = [i for i, p in enumerate(pieces) if p[0] == " " and len(p) > 1 and not p[1].isspace()]
        other = [i for i, p in enumerate(pieces) if p[0] != " " or len(p) == 1 or p[1].isspace()]
        strings = [spaced[i:i + STRUNG] for i in range(0, len(spaced), STRUNG)]
        for first in range(0, len(strings), 64):
            some = strings[first:first + 64]
            for held, e in zip(some, self.tokenizer.encode_batch_fast(
                    ["".join([pieces[i] for i in x]) for x in some], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, dtype=np.uint32)
                cuts = np.append(np.flatnonzero(self.opens[ids]), len(ids))
                if len(cuts) != len(held) + 1:
                    other.extend(held)
                else:
                    numbers[held] = self.ids.add(ids, np.diff(cuts))
        for first in range(0, len(other), 10_000):
            some = other[first:first + 10_000]
            made = [e.ids for e in self.tokenizer.encode_batch_fast([pieces[i] for i in some], add_special_tokens=False)]
            counts = np.fromiter(map(len, made), dtype=np.int64, count=len(made))
            numbers[some] = self.ids.add(np.array([i for ids in made for i in ids], dtype=np.uint32), counts)
        return numbers

    def has_special(self, text: str) -> bool:
        return any(s in text for s in self.special)

    def _plain(self, text: str) -> np.ndarray:
        """Ids of a text with characters beyond U+024F or a special token."""
        if self.has_special(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")
        if len(self.ids) > REMEMBERED:
            self.clear()
        pieces = _RULE.findall(text)
        new = [p for p in dict.fromkeys(pieces) if p not in self.named]
        self.named.update(zip(new, self.learn(new).tolist(), strict=True))
        return self.ids.take(np.fromiter(map(self.named.__getitem__, pieces), dtype=np.int64, count=len(pieces)))[0]

    def _numbers(self, hashes: np.ndarray, joined: str, points: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray | None:
        """The numbers of distinct pieces of a text, given by sorted hashes; None if two
        pieces share a hash."""
        if len(self.ids) > REMEMBERED:
            self.clear()
        place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        known = self.hashes[place] == hashes
        numbers = np.where(known, self.number[place], -1)
        old, counts = self.points.take(numbers[known])
        if not np.array_equal(counts, sizes[known]) or not np.array_equal(old, points[_ranges(starts[known], sizes[known])]):
            return None
        new = np.flatnonzero(~known)
        if len(new):
            numbers[new] = self.learn([joined[a:a + n] for a, n in zip(starts[new].tolist(), sizes[new].tolist(), strict=True)])
            # Points get the same numbers as ids.
            by_number = new[np.argsort(numbers[new])]
            self.points.place(len(self.ids), numbers[by_number], points[_ranges(starts[by_number], sizes[by_number])], sizes[by_number])
            both = np.concatenate((self.hashes, hashes[new]))
            order = np.argsort(both, kind="stable")
            self.hashes, self.number = both[order], np.concatenate((self.number, numbers[new]))[order]
        return numbers

    def _latin(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each text) of texts up to U+024F without special tokens."""
        joined = MARK.join(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4")
        if not len(points):
            return np.zeros(0, dtype="<u4"), np.zeros(len(texts), dtype=np.int64)
        starts = piece_starts(points)
        sizes = np.diff(np.append(starts, len(points)))
        place = np.arange(len(points)) - np.repeat(starts, sizes)
        hashes = np.add.reduceat(_HASHED[points] * powers(int(sizes.max()))[place], starts)
        distinct, leader, which = np.unique(hashes, return_index=True, return_inverse=True)
        # A piece has the hash of its leader; is it the same piece, too?
        same = np.array_equal(sizes, sizes[leader][which]) and np.array_equal(
            points, points[np.repeat(starts[leader][which], sizes) + place])
        numbers = self._numbers(distinct, joined, points, starts[leader], sizes[leader]) if same else None
        if numbers is None:
            made = [self._plain(t) for t in texts]
            return np.concatenate(made), np.array([len(x) for x in made], dtype=np.int64)
        ids, counts = self.ids.take(numbers[which])
        total = np.concatenate(([0], np.cumsum(counts)))
        # Pieces of a text lie between two marks.
        cuts = np.flatnonzero(points[starts] == ord(MARK))
        return ids, np.diff(np.concatenate(([0], total[cuts], [total[-1]])))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids one text after the other as little-endian uint32, number of ids of each)."""
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        held: list[str] = []
        owner: list[int] = []
        owners: list[int] = []
        size = 0

        def flush() -> None:
            nonlocal size
            if held:
                parts.append(self._latin(held))
                owner.extend(owners)
                held.clear()
                owners.clear()
                size = 0

        for i, text in enumerate(texts):
            text = text or ""
            if _BEYOND_LATIN.search(text) or self.has_special(text):
                flush()
                ids = self._plain(text)
                parts.append((ids, np.array([len(ids)])))
                owner.append(i)
                continue
            while text is not None:
                cut = _CUT.search(text, CHUNK) if len(text) > CHUNK else None
                part, text = (text[:cut.start()], text[cut.start():]) if cut else (text, None)
                held.append(part)
                owners.append(i)
                size += len(part)
                if size > CHUNK:
                    flush()
        flush()
        lengths = np.zeros(len(texts), dtype=np.int64)
        if not parts:
            return np.zeros(0, dtype="<u4"), lengths
        np.add.at(lengths, owner, np.concatenate([n for _, n in parts]))
        return np.concatenate([ids for ids, _ in parts]), lengths


_LOADED: dict[str, PieceEncoder] = {}


def load(vocabulary: str) -> PieceEncoder:
    if vocabulary not in _LOADED:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives a task one core
        import public_tokenizers

        _LOADED[vocabulary] = PieceEncoder(public_tokenizers.path(vocabulary))
    return _LOADED[vocabulary]


def write_segments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   vocabulary: str = VOCABULARY, end_id: int = END_ID, segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """Encode, order by id and write the segments; the table read back:
    (part, ids (the documents'), before (ids of the part ahead), n_ids, data).

    The range partitioning by id puts the order over all tasks; a partition's
    number is its place in the order.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, before = load(vocabulary), TaskContext.get().partitionId(), 0
        names: list[pa.Array] = []
        held: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        size = 0

        def close() -> pa.RecordBatch:
            ids = pa.concat_arrays(names)
            tokens = np.concatenate(held)
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                pa.array([before], pa.int64()), pa.array([len(tokens)], pa.int64()),
                pa.array([pack(tokens, np.concatenate(sizes))], pa.binary())], names=["part", "ids", "before", "n_ids", "data"])

        for batch in batches:
            # Few rows at a time, as a segment may close after any of them.
            for first in range(0, batch.num_rows, 200):
                some = batch.slice(first, 200)
                names.append(some.column(0))
                ids, lengths = coder.encode(some.column(1).to_pylist())
                held.append(np.insert(ids, np.cumsum(lengths), end_id))
                sizes.append(lengths + 1)
                size += len(held[-1])
                if size >= segment_ids:
                    yield close()
                    names, held, sizes, size, before = [], [], [], 0, before + size
        if held:
            yield close()

    ordered = (docs.select(docs[id_col].alias("__id"), docs[text_col].cast("string").alias("__text"))
               .repartitionByRange(F.col("__id").asc_nulls_first())
               .sortWithinPartitions(F.col("__id").asc_nulls_first(), F.crc32(F.coalesce("__text", F.lit("")).cast("binary"))))
    return written(ordered.mapInArrow(
        run, f"part int, ids array<{kind}>, before bigint, n_ids bigint, data binary"), "tokens")


def read_segments(segments: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document from the segments: id, start, n_tokens, ids_crc32.

    The offsets of the parts come from running sums over a table with one row for
    each written partition, which is small enough to broadcast.
    """
    kind = segments.schema["ids"].dataType.elementType.simpleString()
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = segments.groupBy("part").agg(F.sum("n_ids").alias("__n")).select(
        "part", F.coalesce(F.sum("__n").over(order), F.lit(0)).alias("__start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, lengths = unpack(batch.column(1)[i].as_py())
                raw = ids.astype("<u4").tobytes()
                cuts = np.concatenate(([0], np.cumsum(lengths)))
                at = (cuts * 4).tolist()
                sums = [zlib.crc32(raw[a:b]) for a, b in zip(at, at[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0)[i].values, pa.array(batch.column(2)[i].as_py() + cuts[:-1], pa.int64()),
                    pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())],
                    names=[id_col, "start", "n_tokens", "ids_crc32"])

    return segments.join(F.broadcast(starts), "part").select(
        "ids", "data", (F.col("__start") + F.col("before")).alias("__start")).mapInArrow(
        run, f"`{id_col}` {kind}, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_files(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Write all documents as segments, read them back, and describe each document."""
    return read_segments(write_segments(docs, id_col, text_col, **options), id_col)
