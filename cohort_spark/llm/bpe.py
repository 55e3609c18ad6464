"""BPE encoding by a pair occurrence index, and decoding.

A partition's texts are cut into pieces by the tokenizer's own rule; every
distinct piece is merged once.  All pieces of a pass lie in one flat symbol array.
An index maps each mergeable pair (by its rank) to all positions where it occurs;
active ranks are taken in ascending order, all occurrences of the pair are merged
together, and the lists of the neighbouring pairs get the new positions.  Texts
are then assembled from the merged pieces, and decoded again from their ids.

The vocabulary file is a parameter and is read on the executors, where the
tokenizer package is installed.

Null text counts as empty: no ids, empty decoded text.  Repeated rows are encoded
like any other; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import map_texts

VOCABULARY = "word_bpe_49k.json"
#: Characters of text merged in one pass, and pieces remembered between passes.
PASS_CHARS, REMEMBERED = 6 << 20, 400_000
END = "</w>"


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level BPE:
    printable Latin-1 bytes stand for themselves, the others follow from U+0100."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


class PairIndex:
    """Merges many byte strings at once."""

    def __init__(self, vocabulary: dict[str, int], merges: list, end: str = END):
        alphabet = byte_alphabet()
        self.inner = np.array([vocabulary[c] for c in alphabet], dtype=np.int64)
        self.last = np.array([vocabulary[c + end] for c in alphabet], dtype=np.int64)
        pairs = [m if isinstance(m, (list, tuple)) else m.split(" ", 1) for m in merges]
        left = np.array([vocabulary[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocabulary[b] for _, b in pairs], dtype=np.int64)
        self.left, self.right = left, right
        self.merged = np.array([vocabulary[a + b] for a, b in pairs], dtype=np.int64)
        key = left << 20 | right
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks = key[order], order

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it never merges."""
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces in order, offsets of the pieces)."""
        sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        ends = np.cumsum(sizes)
        raw = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        n = len(raw)
        symbol = self.inner[raw]
        symbol[ends - 1] = self.last[raw[ends - 1]]
        after = np.arange(1, n + 1)
        after[ends - 1] = -1
        before = np.arange(-1, n - 1)
        before[ends - sizes] = -1
        alive = np.ones(n, dtype=bool)

        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def add(places: np.ndarray) -> None:
            rank = self.rank_of(symbol[places], symbol[after[places]])
            known = rank >= 0
            places, rank = places[known], rank[known]
            if not len(places):
                return
            order = np.argsort(rank, kind="stable")
            places, rank = places[order], rank[order]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            for r, part in zip(rank[np.concatenate(([0], cuts))].tolist(), np.split(places, cuts), strict=True):
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heapq.heappush(active, r)

        add(np.flatnonzero(after >= 0))
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            at = np.unique(np.concatenate(lists)) if len(lists) > 1 else np.sort(lists[0])
            a, b = self.left[r], self.right[r]
            at = at[alive[at] & (symbol[at] == a) & (after[at] >= 0)]
            at = at[symbol[after[at]] == b]
            if a == b and len(at) > 1:
                # In a run of equal symbols every second occurrence counts.
                joined = np.concatenate(([False], after[at[:-1]] == at[1:]))
                place = np.arange(len(at))
                first = np.maximum.accumulate(np.where(joined, 0, place))
                at = at[(place - first) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            symbol[at] = self.merged[r]
            alive[gone] = False
            follow = after[gone]
            after[at] = follow
            has = follow >= 0
            before[follow[has]] = at[has]
            ahead = before[at]
            add(np.unique(np.concatenate((ahead[ahead >= 0], at[has]))))
        return symbol[alive], np.concatenate(([0], np.cumsum(np.add.reduceat(alive, ends - sizes)))) if n else np.zeros(1, int)


_ASCII_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[A-Za-z]+|[0-9]|[^ \t\n\r\f\vA-Za-z0-9]+")
# Texts with no character beyond U+024F, in the faster engine.
_LATIN_PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f]+|[0-9\xb2\xb3\xb9\xbc-\xbe]"
                          "|[^ \t\n\r\f\v\x85\xa0A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f0-9\xb2\xb3\xb9\xbc-\xbe]+")
_BEYOND_LATIN = re.compile("[^\x00-\u024f]")
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")


class WordBpe:
    """Encoder and decoder of a vocabulary file with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocabulary = spec["model"]["vocab"]
        self.index = PairIndex(vocabulary, spec["model"]["merges"], spec["model"]["end_of_word_suffix"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        everything = {**vocabulary, **self.special}
        self.token = [b""] * (max(everything.values()) + 1)
        for token, i in everything.items():
            self.token[i] = token.encode()
        self.cache: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[str]:
        """Normalised pieces of a text; a special token's text stays as it is."""
        if "<|" in text and (parts := self.split.split(text))[1:]:
            return [p for part in parts for p in ([part] if part in self.special else self.pieces(part))]
        if text.isascii():
            return _ASCII_PIECE.findall(text.lower())
        text = unicodedata.normalize("NFC", text)
        # Each character on its own: no special form of a sigma at a word's end.
        text = text.replace("Σ", "σ").lower()
        return (_PIECE if _BEYOND_LATIN.search(text) else _LATIN_PIECE).findall(text)

    def learn(self, words: set[str]) -> None:
        """Merge the pieces that the cache does not hold."""
        if len(self.cache) > REMEMBERED:
            self.cache.clear()
        for token in self.special:
            self.cache[token] = np.uint32(self.special[token]).astype("<u4").tobytes()
        new = [w for w in words if w not in self.cache]
        if not new:
            return
        ids, cuts = self.index.encode([w.encode() for w in new])
        data, at = ids.astype("<u4").tobytes(), (cuts * 4).tolist()
        self.cache.update((w, data[a:b]) for w, a, b in zip(new, at, at[1:], strict=False))

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        first = 0
        while first < len(texts):
            last, size, cut = first, 0, []
            while last < len(texts) and (last == first or size < PASS_CHARS):
                text = texts[last] or ""
                cut.append(self.pieces(text))
                size, last = size + len(text), last + 1
            self.learn(set().union(*cut))
            for words in cut:
                yield b"".join(map(self.cache.__getitem__, words))
            first = last

    def decode(self, ids: bytes) -> bytes:
        """Text of the ids in UTF-8: the tokens with a space between."""
        return b" ".join(map(self.token.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_LOADED: dict[str, WordBpe] = {}


def load(vocabulary: str) -> WordBpe:
    """The coder of a vocabulary file, kept for the life of a Python worker."""
    if vocabulary not in _LOADED:
        import public_tokenizers

        _LOADED[vocabulary] = WordBpe(public_tokenizers.path(vocabulary))
    return _LOADED[vocabulary]


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  vocabulary: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 of every row, with ``with_ids``
    also the ids and the decoded text.  No shuffle: one pass over the partitions."""
    made = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids binary, decoded string" if with_ids else "")
    types = [pa.int64(), pa.string(), pa.string()] + ([pa.binary(), pa.string()] if with_ids else [])

    def start():
        coder = load(vocabulary)

        def work(texts: list) -> list[list]:
            out: list[list] = [[] for _ in types]
            for ids in coder.encode(texts):
                text = coder.decode(ids)
                out[0].append(len(ids) // 4)
                out[1].append(hashlib.sha256(ids).hexdigest())
                out[2].append(hashlib.sha256(text).hexdigest())
                if with_ids:
                    out[3].append(ids)
                    out[4].append(text.decode())
            return out

        return work

    return map_texts(docs, text_col, [id_col], made, start, types, rows=4000)
