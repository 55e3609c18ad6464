"""Spelling variants, SimHash groups and ranked search against plain Python."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from cohort_spark.llm import search, simhash, spelling

FOLD = str.maketrans({c: c + 32 for c in range(65, 91)})
SCHEMA = "doc_id bigint, text string, n bigint, word string, score bigint, fp bigint, rank int, `key` string"


def _frame(spark, texts, parts=3):
    rows = [(i, t, 1, "w", 2, 3, 4, "k") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ------------------------------------------------------------------- spelling

def _word_texts():
    rng = random.Random(11)
    base = ["".join(rng.choices("abcdeé", k=rng.randrange(5, 9))) for _ in range(40)]
    words = list(base)
    for w in base:
        for _ in range(4):
            at = rng.randrange(len(w))
            words.append(rng.choice([w[:at] + w[at + 1:], w[:at] + rng.choice("abcÿ") + w[at:], w[:at] + rng.choice("abcÿ") + w[at + 1:]]))
    long = "".join(rng.choices("abcdefgh", k=3000))
    words += ["x" * 70, "x" * 71, long, long[:1500] + long[1501:], long[:-1] + "z"]
    weight = [rng.choice([1, 1, 5, 40]) for _ in words]
    texts = [" ".join(rng.choices([w.upper() if rng.random() < 0.2 else w for w in words], weights=weight, k=300)) for _ in range(60)]
    texts += [" ".join([w] * 6) for w in words[-5:]]
    return [*enumerate(texts), (None, texts[0]), (7, texts[7]), (900, None), (901, ""), (902, "12 , \n"), (903, texts[3].replace(" ", "×"))]


def _near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    at = next((i for i, x in enumerate(a) if x != b[i]), len(a))
    return a[at:] == b[at + 1:]


def _plain_variants(texts):
    n = Counter()
    for i, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    near = {w: [v for v in n if _near(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


@pytest.mark.parametrize("blocks", [spelling.FILTER_BLOCKS, spelling.LAST_SHARD + 1])
def test_spelling_variants(spark, empty, monkeypatch, blocks):
    # Filters of one block a length let nearly all edits through: the join removes them.
    monkeypatch.setattr(spelling, "FILTER_BLOCKS", blocks)
    texts = _word_texts()
    rows = spelling.variants(_frame(spark, texts)).collect()
    want = _plain_variants(texts)
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows} == want and len(rows) == len(want)
    assert any(f and f != r for f, r, *_ in want.values()) and max(map(len, want)) == 3000
    assert spelling.variants(empty).count() == 0


def test_counts_are_flushed(spark, monkeypatch):
    texts = _word_texts()
    want = {tuple(r) for r in spelling.vocabulary(_frame(spark, texts)).collect()}
    monkeypatch.setattr(spelling, "HELD_WORDS", 3)
    assert {tuple(r) for r in spelling.vocabulary(_frame(spark, texts)).collect()} == want


def test_only_tables_read_again_are_written(spark, monkeypatch):
    # On a local file system each file costs its executor a few processes.
    names, write = [], spelling.written
    monkeypatch.setattr(spelling, "written", lambda df, name: names.append(name) or write(df, name))
    texts = _word_texts()
    rows = spelling.variants(_frame(spark, texts)).collect()
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows} == _plain_variants(texts)
    assert names[:3] == ["words", "near-words", "forms"] and set(names[3:]) == {"roots"}


def test_filters_have_no_false_negatives_and_few_false_positives():
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 2**64, 5000, dtype=np.uint64)
    filters = spelling.Filters({8: 1 + 5000 * spelling.WORD_BITS // 512})
    for k in range(8):
        np.bitwise_or.at(filters.bits[:, k], filters.place(keys, 8), spelling._masks(keys, k))
    assert len(filters.hits(keys, 8)) == len(keys)
    assert len(filters.hits(rng.integers(0, 2**64, 100_000, dtype=np.uint64), 8)) < 500
    assert len(filters.hits(keys, 9)) == 0


def test_edits_are_those_of_the_words():
    words, alphabet = ["aabc", "cabb"], np.array(sorted(map(ord, "abc")), dtype=np.uint64)
    made = {}
    for length, word, keys in spelling.edits(words, alphabet):
        for w, k in zip(word.tolist(), keys.tolist(), strict=True):
            made.setdefault((words[w], length), []).append(k)
    for w in words:
        less = sorted({w[:i] + w[i + 1:] for i in range(4)})
        greater = sorted(w[:i] + c + w[i + 1:] for i in range(4) for c in "abc" if c > w[i])
        assert sorted(made[w, 3]) == sorted(spelling.word_keys(less).tolist())
        assert sorted(made[w, 4]) == sorted(spelling.word_keys(greater).tolist())


# -------------------------------------------------------------------- simhash

def _plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def _plain_groups(prints):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in prints:
        for b in prints:
            if a < b and (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    return {p: find(p) for p in prints}


def test_simhash_groups(spark, empty):
    rng = random.Random(4)
    base = [[f"{rng.choice(['Alpha', 'beta', 'Gémma'])}{rng.randrange(400)}" for _ in range(rng.choice([40, 300]))] for _ in range(40)]
    texts = [*base, *(b[:3] + ["new"] + b[3:] for b in base), *(b + ["more"] for b in base), base[0], [w.upper() for w in base[1]]]
    texts = [*enumerate(rng.choice([" ", "\n", " \t"]).join(t) for t in texts), (500, None), (501, ""), (502, " \x0b\n"),
             (503, "one"), (504, "ONE"), (505, "one two"), (506, "w " * 30_000), (506, "w " * 30_000), (None, "one")]
    rows = simhash.groups(_frame(spark, texts)).collect()
    prints = {}
    for i, t in texts:
        prints.setdefault(_plain_fingerprint(t), []).append(i)
    roots = _plain_groups(list(prints))
    least = dict.fromkeys(roots.values(), 10**9)
    for p, ids in prints.items():
        least[roots[p]] = min([least[roots[p]], *(i for i in ids if i is not None)])
    want = sorted(((i, f"{p:016x}", least[roots[p]]) for p, ids in prints.items() for i in ids), key=str)
    assert sorted(map(tuple, rows), key=str) == want
    assert len(set(roots.values())) < len(prints), "no near pair in the fixture"
    assert simhash.groups(empty).count() == 0


@pytest.mark.parametrize("crowd", [512, 2, 1])
def test_links_join_all_near_fingerprints(spark, monkeypatch, crowd):
    """Chains, crowds in one half and in both, and zero; crowded keys give the same groups."""
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = random.Random(8)
    prints = {0, 1, 3, 1 << 63, 2**64 - 1}
    for _ in range(6):
        p = rng.getrandbits(64)
        for _ in range(8):
            prints.add(p)
            for b in rng.sample(range(64), rng.choice([1, 2, 2, 3])):
                p ^= 1 << b
    upper = rng.getrandbits(32) << 32
    prints |= {upper | rng.getrandbits(9) for _ in range(60)} | {rng.getrandbits(6) << 32 | 77 for _ in range(30)}
    frame = spark.createDataFrame([(p - 2**64 if p >= 2**63 else p,) for p in prints], "fp bigint")
    got = [tuple(x % 2**64 for x in r) for r in simhash.links(frame).collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in got)
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in got:
        root[find(a)] = find(b)
    plain = _plain_groups(list(prints))
    names = {}
    for p in prints:
        assert names.setdefault(find(p), plain[p]) == plain[p]
    assert len(names) == len(set(plain.values()))
    if crowd == 512:
        assert {frozenset(x) for x in got} == {frozenset((a, b)) for a in prints for b in prints if a != b and (a ^ b).bit_count() <= 2}


# --------------------------------------------------------------------- search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _plain_search(texts, items, k):
    docs = [(i, Counter(TERM.findall((t or "").translate(FOLD)))) for i, t in texts]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    n_docs, n_terms = len(docs), sum(n for *_, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in items:
        own = set(TERM.findall((text or "").translate(FOLD)))
        found = []
        for i, c, n in docs:
            m = 100 - 50 + (50 * n * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m))
                    for t in own if t in c)
            if s > 0:
                found.append((-s, math.inf if i is None else i))
        out += [(item, r, None if i == math.inf else i, -s) for r, (s, i) in enumerate(sorted(found)[:k], 1)]
    return out


def _search_texts():
    rng = random.Random(6)
    words = ["the", "of", "And", "é1", "日本", *(f"w{i}" for i in range(60))]
    weights = [60, 50, 40, *(60 / (i + 1) for i in range(62))]
    texts = [rng.choice([" ", "-", "\n", "\x7f"]).join(rng.choices(words, weights, k=rng.choice([1, 5, 40, 200]))) for _ in range(400)]
    rows = [*enumerate(texts), (None, texts[0]), (None, "w59 w58"), (3, texts[3]), (3, texts[4]), (800, None), (801, ""), (802, "... ,"), (803, "w5 " * 20_000)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([1, 3, 30, 90])))) for i in range(30)]
    return rows, [*items, (90, None), (91, "  "), (92, "absent"), (93, "the THE the")]


@pytest.mark.parametrize(("terms", "held"), [(20_000, 8 << 20), (70, 64 * 64), (1, 64 * 64)])
def test_search(spark, empty, monkeypatch, terms, held):
    monkeypatch.setattr(search, "BLOCK_TERMS", terms)
    monkeypatch.setattr(search, "HELD_COUNTS", held)
    texts, items = _search_texts()
    if terms == 1:
        items = items[:3]
    frame = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id int, text string, rank int")
    for k in (3, 50):
        rows = search.search(_frame(spark, texts, 5), frame, k).collect()
        assert sorted((r.item_id, r["rank"], r.doc_id, r.score) for r in rows) == sorted(_plain_search(texts, items, k))
    assert search.search(empty, frame).count() == 0
    assert search.search(_frame(spark, texts), frame.limit(0)).count() == 0


def test_groups_below_the_best_are_not_evaluated():
    rng = np.random.default_rng(2)
    tf = (rng.random((40, 3000)) < np.linspace(0.01, 0.6, 40)[:, None]).astype(np.int64)
    w = np.linspace(4000, 100, 40).astype(np.int64)
    m = np.full(3000, 100)
    best = [search.Best(10)]
    evaluated = search.search_held(tf, m, np.arange(3000), [np.arange(40)], w, best)
    every = search.scores(tf, m, w)
    order = np.lexsort((np.arange(3000), -every))[:10]
    assert best[0].id.tolist() == order.tolist() and best[0].score.tolist() == every[order].tolist()
    assert evaluated < 300
