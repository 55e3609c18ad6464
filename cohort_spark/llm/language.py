"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built of labelled running text.  A text's letter
stream (its runs of letters, lower-cased, with one space between and around them) is
parsed greedily: from the current place the longest match in the automaton is one phrase,
which may go over word borders.  Few phrases for its letters mean that the text is
like the language.  A phrase is a place in the model text, so it costs the logarithm of
that text's length (in tenths of a bit, of ``MIN_CHARS`` at least: a smaller model is not
taken for a better one); the cheapest language wins.

Whole texts are parsed.  For array operations the stream is cut into pieces of ``PIECE``
characters, which are parsed side by side in all languages; a phrase ends at a cut.

The automata are fitted on a bounded sample of the labelled rows: of the ``LANGUAGES``
commonest languages ``SAMPLE`` documents each, chosen by a hash of the id whatever their
length, with up to ``TEXT_CHARS`` characters of a document and ``MODEL_CHARS`` characters of a
language; a language with less text does not shorten the others.
A null text or one without letters is ``und`` with score 0; so is every text where no
language was learned.  Ties go to the first language in code-point order.  Rows repeated
whole get the same answer.  An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_texts, written

LANGUAGES, SAMPLE, TEXT_CHARS, MODEL_CHARS = 100, 400, 1_500, 30_000
#: Model text that the cost of a phrase counts at least.
MIN_CHARS = 2_000
#: Characters of a stream that are parsed at a stretch, and characters parsed side by side.
PIECE, SIDE_BY_SIDE = 512, 1 << 20
LETTERS = re.compile(r"[^\W\d_]+")


def _letter_table() -> np.ndarray:
    return np.array([c.isalnum() and not c.isdecimal() for c in map(chr, range(1 << 16))])


_LETTER = _letter_table()


def stream(text: str) -> np.ndarray:
    """Code points of the letter stream of a text; empty without a letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = _LETTER[np.minimum(points, (1 << 16) - 1)]
    beyond = np.flatnonzero(points >= 1 << 16)
    if len(beyond):
        letter[beyond] = [bool(LETTERS.fullmatch(chr(c))) for c in points[beyond].tolist()]
    if not letter.any():
        return points[:0]
    # A space stands for what is between two runs, and at both ends.
    last = np.zeros(len(points), dtype=bool)
    last[:-1] = letter[:-1] & ~letter[1:]
    out = np.where(letter, points, 0x20)[letter | np.concatenate(([False], last[:-1]))]
    out = out if out[-1] == 0x20 else np.append(out, 0x20)
    return np.concatenate(([0x20], out))


class SuffixAutomaton:
    """All substrings of a text, as a dense transition table over ``alphabet``."""

    def __init__(self, text: str):
        length, link, steps, last = [0], [-1], [{}], 0
        for c in text:
            new = len(length)
            length.append(length[last] + 1)
            link.append(0)
            steps.append({})
            at = last
            while at >= 0 and c not in steps[at]:
                steps[at][c] = new
                at = link[at]
            if at >= 0:
                to = steps[at][c]
                if length[at] + 1 == length[to]:
                    link[new] = to
                else:
                    copy = len(length)
                    length.append(length[at] + 1)
                    link.append(link[to])
                    steps.append(dict(steps[to]))
                    while at >= 0 and steps[at].get(c) == to:
                        steps[at][c] = copy
                        at = link[at]
                    link[to] = link[new] = copy
            last = new
        alphabet = sorted(set(text))
        self.code = np.full(max(map(ord, alphabet), default=0) + 2, len(alphabet), dtype=np.int32)
        self.code[[ord(c) for c in alphabet]] = np.arange(len(alphabet))
        # The last column stands for every other character: no match from anywhere.
        self.table = np.full((len(length), len(alphabet) + 1), -1, dtype=np.int32)
        place = {c: i for i, c in enumerate(alphabet)}
        for state, out in enumerate(steps):
            for c, to in out.items():
                self.table[state, place[c]] = to

    def phrases(self, points: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Greedy phrases of each string; ``points`` holds their code points one
        after the other, ``ends`` the end of each."""
        codes = self.code[np.minimum(points, len(self.code) - 1)]
        starts = np.concatenate(([0], ends[:-1]))
        count = np.ones(len(ends), dtype=np.int64)
        state = np.zeros(len(ends), dtype=np.int32)
        active, at = np.arange(len(ends)), starts.copy()
        while len(active):
            c = codes[at[active]]
            to = self.table[state[active], c]
            stuck = to < 0
            if stuck.any():
                # The phrase ends; the next starts with this character, which on
                # its own is a phrase if the automaton does not know it.
                who = active[stuck]
                count[who] += state[who] > 0
                to[stuck] = np.maximum(self.table[0, c[stuck]], 0)
                unknown = to[stuck] == 0
                count[who[unknown]] += 1
            state[active] = to
            at[active] += 1
            active = active[at[active] < ends[active]]
        return count


class CrossParser:
    """The automata of all languages in one table of transitions."""

    def __init__(self, texts: dict[str, str]):
        self.languages = sorted(texts)
        automata = [SuffixAutomaton(texts[x]) for x in self.languages]
        # Whole numbers, so that languages of about one size can tie.
        self.cost = np.array([round(10 * math.log2(max(len(texts[x]), MIN_CHARS))) for x in self.languages], dtype=np.int64)
        alphabet = sorted(set().union(*texts.values())) if texts else []
        self.code = np.full(max(map(ord, alphabet), default=0) + 2, len(alphabet), dtype=np.int64)
        self.code[[ord(c) for c in alphabet]] = np.arange(len(alphabet))
        self.width = len(alphabet) + 1
        sizes = [len(a.table) for a in automata]
        self.roots = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)[:-1]
        # -1 stands for no way on; the last column for characters of no model.
        table = np.full((sum(sizes), self.width), -1, dtype=np.int32)
        for first, a, n in zip(self.roots.tolist(), automata, sizes, strict=True):
            known = [ord(c) for c in alphabet if ord(c) < len(a.code) and a.code[ord(c)] < a.table.shape[1] - 1]
            to = a.table[:, a.code[known]]
            table[first:first + n, self.code[known]] = np.where(to >= 0, to + first, -1)
        self.table = table.reshape(-1)

    def phrases(self, points: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Greedy phrases of each string (rows) in each language (columns); ``points``
        holds the code points one after the other, ``ends`` the end of each string."""
        codes = self.code[np.minimum(points, len(self.code) - 1)]
        sizes = np.diff(ends, prepend=0)
        order = np.argsort(-sizes, kind="stable")  # those that go on stand first
        starts, lengths = (ends - sizes)[order], sizes[order]
        going = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1 if len(lengths) else 1), side="right")
        root = np.broadcast_to(self.roots, (len(ends), len(self.roots)))
        state, count = root.copy(), np.zeros(root.shape, dtype=np.int64)
        for step, n in enumerate(going.tolist()):
            c = codes[starts[:n] + step][:, None]
            to = self.table[state[:n] * self.width + c].astype(np.int64)
            row, lang = np.nonzero(to < 0)
            if len(row):
                # The phrase ends; the next starts with this character, which on its
                # own is a phrase if the language does not know it.
                top = self.roots[lang]
                new = self.table[top * self.width + c[row, 0]].astype(np.int64)
                unknown = new < 0
                count[row, lang] += (state[row, lang] != top).astype(np.int64) + unknown
                to[row, lang] = np.where(unknown, top, new)
            state[:n] = to
        count += state != root
        out = np.empty_like(count)
        out[order] = count
        return out

    def costs(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(cost of each text in each language, has it a letter?)."""
        total = np.zeros((len(texts), len(self.languages)), dtype=np.int64)
        worded = np.zeros(len(texts), dtype=bool)
        held: list[np.ndarray] = []
        owner: list[int] = []

        def flush() -> None:
            if held and self.languages:
                sizes = np.array([len(x) for x in held])
                pieces = -(-sizes // PIECE)
                last = np.cumsum(pieces)
                at = np.arange(last[-1]) - np.repeat(last - pieces, pieces)
                ends = np.repeat(np.cumsum(sizes) - sizes, pieces) + np.minimum((at + 1) * PIECE, np.repeat(sizes, pieces))
                np.add.at(total, np.repeat(owner, pieces), self.phrases(np.concatenate(held), ends) * self.cost)
            held.clear()
            owner.clear()

        size = 0
        for i, text in enumerate(texts):
            points = stream(text) if isinstance(text, str) else ()
            worded[i] = len(points) > 0 and any(c.isalpha() for c in text)
            # A long stream is handed on in parts, cut where pieces end.
            for first in range(0, len(points) if worded[i] else 0, SIDE_BY_SIDE):
                held.append(points[first:first + SIDE_BY_SIDE])
                owner.append(i)
                size += len(held[-1])
                if size >= SIDE_BY_SIDE:
                    flush()
                    size = 0
        flush()
        return total, worded

    def predict(self, texts: list[str | None]) -> Iterator[tuple[str, float]]:
        """(language, score) of each text; the score is the share of the cost
        that the best language saves against the second."""
        total, worded = self.costs(texts)
        for cost, has_letter in zip(total, worded, strict=True):
            if not self.languages or not has_letter:
                yield "und", 0.0
                continue
            best = int(cost.argmin())
            others = np.delete(cost, best)
            yield self.languages[best], float(1 - cost[best] / others.min()) if len(others) else 1.0


def learn(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          sample: int = SAMPLE, model_chars: int = MODEL_CHARS, languages: int = LANGUAGES) -> dict[str, str]:
    """Model text of each language in ``labelled`` (rows with a null language or
    text are left out).

    The documents are chosen on ids, languages and checksums alone; only the chosen ones'
    texts are read, and at most ``languages`` * ``sample`` * ``TEXT_CHARS`` characters reach
    the driver.
    """
    text = F.col(text_col)
    h, k = F.xxhash64(F.col(id_col)).alias("h"), F.xxhash64(text).alias("k")
    rows = labelled.select(h, k, F.col(lang_col).alias("l")).where(F.col("l").isNotNull() & text.isNotNull()).withColumn(
        "u", F.pmod(F.xxhash64("h", "k"), F.lit(1 << 30)))
    common = rows.groupBy("l").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("u").alias("d")).orderBy(
        F.desc("n"), "l").limit(languages)
    # The lowest draws of a language lie below this bound, so few rows go to the window.
    bound = F.lit(float(8 * sample << 30)) / F.col("d")
    place = Window.partitionBy("l").orderBy("u", "h", "k")
    near = rows.join(F.broadcast(common.select("l", "d")), "l").where(F.col("u") <= bound).select("l", "u", "h", "k").distinct()
    chosen = written(near.withColumn("n", F.row_number().over(place)).where(F.col("n") <= sample).select("l", "h", "k"), "language-sample")
    texts = labelled.select(h, k, F.col(lang_col).alias("l"),
                            F.substring(text, 1, TEXT_CHARS).alias("t"))
    held: dict[str, list] = {}
    # The sample's size is bounded, so its keys go to the texts.
    for r in texts.join(F.broadcast(chosen), ["l", "h", "k"]).distinct().collect():
        held.setdefault(r["l"], []).append((r["h"], r["k"], r["t"]))
    out = {}
    for lang, found in held.items():
        model = " "
        for word in (w for *_, t in sorted(found) for w in LETTERS.findall(t.lower())):
            if len(model) + len(word) > model_chars:
                break
            model += word + " "
        if len(model) > 1:
            out[lang] = model
    return out


def predict(docs: DataFrame, texts: dict[str, str], id_col: str = "doc_id", text_col: str = "text",
            carry: tuple[str, ...] = ()) -> DataFrame:
    """id, the columns in ``carry``, lang_pred and score of every row.  The model
    texts (bounded) go out once; automata are built once for each worker."""
    model = docs.sparkSession.sparkContext.broadcast(texts)

    def start():
        parser = _parser(model.value)

        def work(values: list) -> list[list]:
            made = list(parser.predict(values))
            return [[m[0] for m in made], [m[1] for m in made]]

        return work

    return map_texts(docs, text_col, [id_col, *carry], "lang_pred string, score double", start, [pa.string(), pa.float64()])


_PARSER: list = [None, None]


def _parser(texts: dict[str, str]) -> CrossParser:
    """The parser of the last model, kept for the life of a Python worker."""
    if _PARSER[0] != texts:
        _PARSER[:] = [texts, CrossParser(texts)]
    return _PARSER[1]
