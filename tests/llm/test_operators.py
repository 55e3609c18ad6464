"""Small tests of the text operators against plain Python."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from cohort_spark.llm import (
    bpe, common, components, exact_dedup, language, line_dedup, minhash, mixing, quality, sharding, token_files, toxicity,
)

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans({c: c + 32 for c in range(65, 91)})
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept boolean, size bigint"


def _texts():
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma", "délta", "eps", "zeta", "eta", "Theta", "iota", "kappa"]
    base = [" ".join(rng.choice(words) + str(rng.randrange(30)) for _ in range(60)) for _ in range(6)]
    near = [b.split() for b in base[:3]]
    for n in near:
        n[10] = "other"
    return [None, "", " \n\t", "one", "ONE", "one two", *base, *base[:2], base[0].upper(), *(" ".join(n) for n in near),
            "x" * 30_000, " ".join(["long"] * 5000), "aaa bbb ccc\nddd\nddd\naab bbb ccc"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 5 == 0 else "en", [None, "a", "b"][i % 3], 7, True, 9) for i, t in enumerate(_texts())]
    return spark.createDataFrame([*rows, (None, "one", "en", "a", 1, False, 2)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(docs, empty):
    got = {r.doc_id: r for r in exact_dedup.decide(docs, top_k=5, tracked=64).collect()}
    groups = {}
    for i, t in [*enumerate(_texts()), (None, "one")]:
        groups.setdefault((t or "").translate(FOLD), []).append(i)
    for text, ids in groups.items():
        keep = max(i for i in ids if i is not None)
        for i in ids:
            r = got[i]
            assert (r.keep_id, r.group_size, r.kept) == (keep, len(ids), i == keep)
            assert r.text_sha256 == hashlib.sha256(text.encode()).hexdigest()
    kept = exact_dedup.keep_winners(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup.decide(empty).count() == 0
    assert exact_dedup.keep_winners(docs.unionByName(docs)).count() == len(groups)


def test_near_duplicates(docs, empty):
    got = {r.doc_id: r for r in minhash.groups(docs).collect()}
    sets = {}
    for i, t in enumerate(_texts()):
        w = WORD.findall((t or "").translate(FOLD))
        sets[i] = set(zip(*[w[k:] for k in range(5)])) if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}
    for _ in sets:
        for a, x in sets.items():
            for b, y in sets.items():
                if x and y and 100 * len(x & y) >= 85 * len(x | y):
                    root[a] = root[b] = min(root[a], root[b])
    for i, s in sets.items():
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(s), root[i], root[i] == i), i
    assert minhash.groups(empty).count() == 0


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 300, dtype=np.uint64)
    a, b = np.unique(pool[:200]), np.unique(pool[20:220])
    equal = (minhash.superminhash(a) == minhash.superminhash(b)).mean()
    assert abs(equal - 180 / 220) < 0.15
    assert (minhash.superminhash(a[:1]) == minhash.superminhash(a[:1].copy())).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 103), (103, 101)]
    random.Random(2).shuffle(edges)
    got = dict(components.components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(5)).collect())
    assert got == {**{i: 0 for i in range(1, 51)}, 101: 100, 103: 100}


def test_bpe_equals_the_library(docs, empty):
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    library = tokenizers.Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))
    odd = ["ΣΑΣ Σ", "a<|endoftext|>B", "aaaaaaaa!!!!!!!", "é É İ ß ﬁ", "٣٤५ 123 don't IT'S", "日本 😀😀", "<|startoftext|>"]
    coder = bpe.WordBpe(public_tokenizers.path(bpe.VOCABULARY))
    texts = [*odd, *_texts()]
    for text, ids in zip(texts, coder.encode(texts), strict=True):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert coder.decode(ids).decode() == library.decode(want, skip_special_tokens=False)
    assert bpe.encode_decode(docs).count() == docs.count()
    assert bpe.encode_decode(empty).count() == 0


def test_segments_round_trip():
    rng = random.Random(2)
    for n in (0, 1, 1023, 1024, 1025, 3000):
        for top in (1, 200, 50_000, 1 << 33, (1 << 64) - 1):
            ids = np.array([rng.randint(0, top) for _ in range(n)], dtype=np.uint64)
            out, lengths = token_files.unpack(token_files.pack(ids, np.array([n // 2, n - n // 2])))
            assert (out == ids).all() and lengths.sum() == n


def test_token_files(docs, empty):
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    library = tokenizers.Tokenizer.from_file(public_tokenizers.path(token_files.VOCABULARY))
    got = {r.doc_id: r for r in token_files.token_files(docs, segment_ids=100).collect()}
    at = 0
    for i, t in [(None, "one"), *enumerate(_texts())]:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        assert (got[i].start, got[i].n_tokens) == (at, len(ids))
        assert got[i].ids_crc32 == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        at += len(ids)
    assert token_files.token_files(empty).count() == 0


def test_lines_within_one_edit(spark, empty):
    rows = [(1, "abcdef\nhello world\n\nabcdef "), (2, "abcxef\nhello worlds"), (3, "hello worl\nnew\nhelo worlds"), (4, None), (5, "")]
    out = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert out[1].text == "abcdef\nhello world\n" and out[2].text == "" and out[3].text == "new" and out[4].text is None and out[5].text == ""
    assert line_dedup.report(empty).count() == 0


def _near_line(a, b):
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[k + (len(a) >= len(b)):] == b[k + (len(b) >= len(a)):]


def _plain_lines(rows):
    """{(id, text): numbers of the lines that go, equal ones and near ones}."""
    lines = sorted({(i, common_key, n, line.strip(" \t\n\x0b\x0c\r")) for i, t, common_key in rows for n, line in enumerate((t or "").split("\n"))
                    if WORD.search(line)})
    firsts: list = []
    seen: dict = {}
    near: dict = {}
    out: dict = {}
    for place in lines:
        line = place[3]
        if line not in seen:
            seen[line] = place
            near[line] = any(_near_line(line, x) for x in firsts)
            firsts.append(line)
        kind = "equal" if seen[line] != place else "near" if near[line] else None
        if kind:
            out.setdefault(place[:2], {"equal": [], "near": []})[kind].append(place[2])
    return out


def test_lines_by_brute_force(spark):
    """Long lines of all kinds of edit, ties, repeated rows and ids, nulls, clashing columns."""
    rng = random.Random(12)
    texts = [None, "", " \n\t"]
    for size in (1, 2, 3, 15, 16, 17, 33, 40, 520, 700, 9000):
        base = "".join(rng.choices("abé ", k=size)).strip() or "a"
        lines = [base, "a" * size, "a" * (size + 1)]
        for _ in range(4):
            at = rng.randrange(len(base))
            lines += [base[:at] + base[at + 1:], base[:at] + rng.choice("xé") + base[at:], base[:at] + "z" + base[at + 1:]]
        lines.append(lines[-1][:1] + "qq" + lines[-1][1:])
        rng.shuffle(lines)
        texts += ["\n".join(lines[:5]), " \n" + "\n".join(lines[5:]) + "\r"]
    rows = [(i, t, 1, "x", 2) for i, t in enumerate(texts)]
    rows += [rows[3], rows[8], (3, texts[9], 1, "x", 2), (None, texts[12], 1, "x", 2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, __line_no int, kind string, part int").repartition(4)
    keyed = {(r.doc_id, r.text): r.k for r in docs.withColumn("k", line_dedup._document_key("doc_id", "text")).collect()}
    # Null ids come first in Spark's order.
    plain = _plain_lines([(-1 if i is None else i, t, keyed[i, t]) for i, t, *_ in rows])
    out = line_dedup.dedup_lines(docs).collect()
    assert len(out) == len(rows) and any(v["near"] for v in plain.values())
    for r in out:
        text = {k: t for (i, t), k in keyed.items()}
        mine = [(k, plain.get((-1 if r.doc_id is None else r.doc_id, k), {"equal": [], "near": []})) for (i, t), k in keyed.items() if i == r.doc_id]
        kept = [(("\n".join(x for n, x in enumerate(text[k].split("\n")) if n not in g["equal"] + g["near"])) if text[k] is not None else None,
                 g["equal"], g["near"]) for k, g in mine]
        assert (r.text, r["__exact"], r["__near"]) in kept


def test_long_lines_cost_no_square(spark):
    rng = random.Random(1)
    long = "".join(rng.choices("abcdefgh ", k=160_000)).strip()
    rows = [(1, long), (2, long[:70_000] + "Z" + long[70_001:]), (3, long[:90_000] + long[90_001:]), (4, "y" + long), (5, long[1:-1])]
    got = {r.doc_id: r for r in line_dedup.report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [(got[i].n_exact, got[i].n_near) for i in range(1, 6)] == [(0, 0), (0, 1), (0, 1), (0, 1), (0, 0)]


def test_quality_figures(docs, empty):
    got = {r.doc_id: r for r in quality.decide(docs).collect()}
    for i, t in enumerate(_texts()):
        w = WORD.findall(t or "")
        grams = [tuple(w[k:k + 3]) for k in range(len(w) - 2)]
        covered = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)} if len(grams) < 500 else set(range(len(w)))
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(covered)), i
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
    assert quality.decide(empty).count() == 0


def test_frequent_lines_deplete(spark):
    text = "boiler plate line of the host\n" * 1 + "w " * 4
    rows = [(i, text * 8, "h") for i in range(30)] + [(99, " ".join(map(str, range(80))), "h")]
    got = {r.doc_id: r for r in quality.decide(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    assert got[99].kept and got[0].removed_words > 0 and not got[0].kept


def test_sharding(docs, empty):
    rows = sharding.shard(docs, max_rows=4, ranges=3, sample=10).collect()
    assert len(rows) == docs.count()
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    texts = dict(enumerate(_texts()))
    for r in rows:
        if r.doc_id is not None:
            data = (texts[r.doc_id] or "").encode()
            assert (r.size, r.text_crc32) == (len(data) + 8, zlib.crc32(data))
    assert sharding.shard(empty).count() == 0


def test_mixing(docs, empty):
    assert mixing.targets({"a": 10, "b": 100, None: 100}) == {"a": 20.0, "b": pytest.approx(295 / 3), None: pytest.approx(590 / 3)}
    rows = mixing.decide(docs).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.decide(docs.repartition(5)).collect()), key=str)
    for target, size in {(r.target, r.source_size) for r in rows}:
        mine = [r for r in rows if (r.target, r.source_size) == (target, size)]
        assert sum(r.taken for r in mine) == round(target) <= 2 * size
        assert all(r.taken <= 2 * r.size for r in mine)
    assert mixing.mixed(docs).columns == docs.columns
    assert mixing.decide(empty).count() == 0


def test_phrases_are_greedy_longest_matches():
    automaton = language.SuffixAutomaton(" the then ")

    def plain(text):
        n = i = 0
        while i < len(text):
            j = i + 1
            while j < len(text) and text[i:j + 1] in " the then ":
                j += 1
            i, n = j, n + 1
        return n

    for word in (" the ", " hen ", " xyz ", " thethe ", " éa "):
        points = np.array([ord(c) for c in word])
        assert automaton.phrases(points, np.array([len(points)]))[0] == plain(word), word


def test_language(docs, empty):
    texts = {"aa": " abab baba abba ", "xx": " xyxy yxyx xyyx "}
    got = list(language.CrossParser(texts).predict(["abab abba", "YXYX xy", None, "12 !", ""]))
    assert [g[0] for g in got] == ["aa", "xx", "und", "und", "und"]
    assert language.predict(empty, texts).count() == 0
    assert {r.lang_pred for r in language.predict(docs, {}).collect()} == {"und"}


def test_a_rare_language_does_not_shorten_the_others(spark):
    rng = random.Random(3)
    vocabulary = {lang: ["".join(rng.choice(letters) for _ in range(rng.randrange(4, 9))) for _ in range(400)]
                  for lang, letters in (("aa", "abcdefghij"), ("bb", "fghijklmno"))}
    rows = [(i, " ".join(rng.choice(vocabulary[lang]) for _ in range(100)), lang)
            for i in range(40) for lang in ("aa", "bb")]
    rare = (1000, "hgfe ihgf jihg abcd bcde", "rare")  # one short row of the letters of "aa"
    docs = spark.createDataFrame([*rows, rare], "doc_id bigint, text string, lang string")
    texts = language.learn(docs, model_chars=2500)
    alone = language.learn(docs.where("lang <> 'rare'"), model_chars=2500)
    assert {x: texts[x] for x in alone} == alone
    assert all(2400 < len(x) <= 2501 for x in alone.values()) and len(texts["rare"]) == len(rare[1]) + 2
    fresh = [(i, " ".join(rng.choice(vocabulary[lang]) for _ in range(30)), lang) for i in range(50) for lang in ("aa", "bb")]
    parser = language.CrossParser(texts)
    assert [p for p, _ in parser.predict([t for _, t, _ in fresh])] == [lang for *_, lang in fresh]
    assert next(parser.predict([rare[1]]))[0] == "rare"
    assert len(language.learn(docs.where("lang = 'aa'"), model_chars=2500)["aa"]) > 2400


def test_toxicity(spark, empty):
    rng = random.Random(3)
    rows = [(i, " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(20)) + (" nasty" if i % 5 == 0 else "")) for i in range(400)]
    frame = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(200)], "doc_id bigint, toxic int")
    model = toxicity.train(frame, labels)
    got = {r.doc_id: r for r in toxicity.score(frame, model).collect()}
    assert sum(got[i]["__predicted"] == (i % 5 == 0) for i in range(400)) >= 390 and got[900]["__predicted"] == 0
    assert toxicity.score(empty, toxicity.train(empty, labels)).count() == 0


def test_word_hashes_do_not_depend_on_the_place():
    offsets, _, _, hashes, _ = common.doc_words([b"one Two  one", b"", b"two"], fold=True)
    assert offsets.tolist() == [0, 3, 3, 4]
    assert hashes[0] == hashes[2] and hashes[1] == hashes[3] != hashes[0]
