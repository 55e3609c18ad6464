"""Operators and the pipeline against plain Python versions of the whole thing."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohort_spark.llm import bpe, language, minhash, mixing, sharding, token_files, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans({c: c + 32 for c in range(65, 91)})


# ------------------------------------------------------------------ languages

def _letters(text):
    words = language.LETTERS.findall(text.lower())
    return " " + " ".join(words) + " " if words else ""


def _plain_cost(text, model):
    n, whole = 0, _letters(text)
    for k in range(0, len(whole), language.PIECE):
        s, i = whole[k:k + language.PIECE], 0
        while i < len(s):
            j = i + 1
            while j <= len(s) and s[i:j] in model:
                j += 1
            i, n = max(j - 1, i + 1), n + 1
    return n


def test_language_predictions_by_plain_parsing():
    rng = random.Random(4)
    letters = {"aa": "abcdefgé", "bb": "defghijk", "cc": "efgxyz𝒳"}
    words = {k: ["".join(rng.choices(v, k=rng.randrange(1, 7))) for _ in range(200)] for k, v in letters.items()}
    models = {k: " " + " ".join(rng.choices(words[k], k=300)) + " " for k in letters}
    parser = language.CrossParser(models)
    texts = [None, "", "12 !", "A1b_c\n d", "日本 aa", "ǅ İ", *(rng.choice([" ", "\n", "-1 "]).join(
        rng.choices(words[k], k=n)).title() for k in letters for n in (1, 3, 50, 400, 5000))]
    for t in texts:
        assert "".join(map(chr, language.stream(t or "").tolist())) == _letters(t or "")
    cost, _ = parser.costs(texts)
    for t, row in zip(texts, cost.tolist(), strict=True):
        assert row == [_plain_cost(t or "", models[k]) * int(c) for k, c in zip(sorted(models), parser.cost, strict=True)]
    best = [("und" if not re.search(r"[^\W\d_]", t or "") else sorted(models)[int(np.argmin(row))]) for t, row in zip(texts, cost, strict=True)]
    assert [p for p, _ in parser.predict(texts)] == best
    assert best[6:] == [k for k in letters for _ in range(5)] or sum(a != b for a, b in zip(best[6:], [k for k in letters for _ in range(5)], strict=True)) <= 3


def test_a_language_of_long_texts_is_learned(spark):
    rng = random.Random(9)
    rows = [(i, " ".join("".join(rng.choices("abcde", k=5)) for _ in range(20)), "aa") for i in range(20)]
    rows += [(100 + i, " ".join("".join(rng.choices("vwxyz", k=5)) for _ in range(20_000)), "zz") for i in range(2)]
    rows += [(200, None, "aa"), (201, "abc", None), (202, "", "nn"), rows[0]]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, lang string, n int")
    texts = language.learn(docs)
    assert sorted(texts) == ["aa", "zz"] and len(texts["zz"]) > 2000
    assert language.learn(docs, languages=1).keys() == {"aa"}
    got = {r.doc_id: r.lang_pred for r in language.predict(docs, texts).collect()}
    assert got[100] == "zz" and got[0] == "aa" and got[200] == got[202] == "und"


# ------------------------------------------------------------------- toxicity

def _risk(w, p, u, prior):
    fp, fu = p @ w[:-1] + w[-1], u @ w[:-1] + w[-1]
    down = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
    return prior * np.logaddexp(0, -fp).mean(), down


def test_toxicity_fit_follows_the_risk():
    """Dense Adam on numerical slopes of the non-negative risk gives the same weights."""
    rng = np.random.default_rng(3)
    common, signs = rng.choice(toxicity.SPACE, 60, replace=False), rng.choice(toxicity.SPACE, 6, replace=False)
    unlabelled = [np.unique(np.concatenate((rng.choice(common, 12), rng.choice(signs, 2) if rng.random() < 0.15 else common[:0]))) for _ in range(120)]
    positive = [np.unique(np.concatenate((rng.choice(common, 12), rng.choice(signs, 3)))) for _ in range(30)]
    prior, steps = 0.15, 60
    model = toxicity.fit(positive, unlabelled, prior, steps=steps)
    kept = sorted(model.weights)
    p, u = (np.array([[f in set(r.tolist()) for f in kept] for r in rows], dtype=float) for rows in (positive, unlabelled))
    w = np.zeros(len(kept) + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    turned = 0
    for step in range(1, steps + 1):
        slopes = np.zeros((2, len(w)))
        for i in range(len(w)):
            d = np.zeros_like(w)
            d[i] = 1e-6
            slopes[:, i] = [(a - b) / 2e-6 for a, b in zip(_risk(w + d, p, u, prior), _risk(w - d, p, u, prior), strict=True)]
        down = _risk(w, p, u, prior)[1]
        g = slopes[0] + slopes[1] if down >= 0 else -slopes[1]
        turned += down < 0
        g[:-1] += 1e-4 * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    assert set(signs.tolist()) <= set(kept)
    assert [model.weights[k] for k in kept] == pytest.approx(w[:-1].tolist(), abs=2e-3) and model.bias == pytest.approx(w[-1], abs=2e-3)


def test_toxic_class_of_long_texts_is_learned(spark):
    rng = random.Random(5)

    def words(n):
        return " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(n))

    rows = [(i, ("vile nasty " if i % 4 == 0 else "") + words(9_000 if i % 4 == 0 else 20)) for i in range(80)]
    rows += [(None, "vile nasty"), (200, None), rows[0]]
    frame = spark.createDataFrame([(*r, 5, 0.5) for r in rows], "doc_id bigint, text string, predicted int, score double")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(60)] + [(None, 1), (5, None)], "doc_id bigint, toxic int")
    got = toxicity.score(frame, toxicity.train(frame, labels))
    hit = {r.doc_id: r["__predicted"] for r in got.collect()}
    assert got.count() == len(rows) and hit[None] == 1 and hit[200] == 0
    assert sum(hit[i] == (i % 4 == 0) for i in range(80)) >= 78


# ---------------------------------------------------------- sharding, mixing

def test_shards_are_consecutive_and_even(spark):
    rng = random.Random(8)
    rows = [(i % 500, "x" * rng.choice([0, 1, 50, 300, 4000]), 1) for i in range(1500)] + [(7, None, 1)] * 300 + [(1000, "y" * 60_000, 1)]
    out = sharding.shard(spark.createDataFrame(rows, "doc_id bigint, text string, shard int").repartition(6), max_rows=100, ranges=8, sample=200).collect()
    assert sorted((r.doc_id, r.size) for r in out) == sorted((i, len(t or "") + 8) for i, t, _ in rows)
    size = Counter()
    for r in out:
        assert 0 <= r.shard < 24 and r.law == "bytes" and r.grown_shard is None
        size[r.shard] += r.size
    total, most = sum(size.values()), max(r.size for r in out)
    assert all(abs(s - total / 24) <= most for s in size.values()) and sum(abs(s - total / 24) <= 4100 for s in size.values()) >= 20
    for s in size:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))


def _plain_mix(docs, keys):
    """{row: (size, source size, target, taken, copies)} with the texts' order by key."""
    sizes, out = Counter(), {}
    for _, t, s in docs:
        sizes[s] += len(WORD.findall(t or ""))
    aim = mixing.targets(dict(sizes))
    for s in sizes:
        mine = sorted((n for n, d in enumerate(docs) if d[2] == s), key=lambda n: keys[n])
        budget, at = round(aim[s]), 0
        whole = budget // sizes[s] if sizes[s] else 0
        rest = budget - whole * sizes[s]
        for n in mine:
            size = len(WORD.findall(docs[n][1] or ""))
            left = rest - at
            reached = 2 * left >= size if size else left > 0
            out[n] = (size, sizes[s], aim[s], size * whole + max(0, min(left, size)), whole + reached)
            at += size
    return out


def _mix_keys(spark, docs):
    frame = spark.createDataFrame([(n, i, t, s) for n, (i, t, s) in enumerate(docs)], "n int, doc_id bigint, text string, source string")
    key = F.xxhash64(F.lit(17), F.col("doc_id"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    # A null id comes first among equal keys.
    return {r.n: (r.k, r.doc_id is not None, r.doc_id or 0, r.row) for r in frame.select("n", "doc_id", key.alias("k"), mixing._row_key(["doc_id", "text", "source"]).alias("row")).collect()}


def test_mixing_takes_the_first_by_key(spark, monkeypatch):
    rng = random.Random(2)
    docs = [(rng.randrange(150), " ".join(["w"] * rng.choice([0, 1, 5, 60])) + rng.choice(["", " é"]), rng.choice([None, "a", "b", "b", "b", "c"])) for _ in range(200)]
    docs += [(None, "x y", "a"), (5, None, "c"), *docs[:6], (1, "only", "d"), (2, "", "e")]
    keys = _mix_keys(spark, docs)
    want = _plain_mix(docs, keys)
    frame = spark.createDataFrame([(*d, 3) for d in docs], "doc_id bigint, text string, source string, size int")
    for rows in (mixing.PART_ROWS, 7):
        monkeypatch.setattr(mixing, "PART_ROWS", rows)
        got = mixing.decide(frame).collect()
        assert sorted(((r.doc_id, *r[1:]) for r in got), key=str) == sorted(((docs[n][0], *v[:4]) for n, v in want.items()), key=str)
    got = mixing.mixed(frame).collect()
    assert Counter(tuple(r)[:3] for r in got) == +sum((Counter({docs[n]: v[4]}) for n, v in want.items()), Counter())


# ------------------------------------------------------- near copies, pieces

def test_near_copies_go_by_row(spark):
    base = " ".join(f"w{i}" for i in range(120))
    near = base.replace("w30", "other")
    rows = [(1, base), (2, near), (2, "something else of its own"), (3, None), (3, ""), (None, near + " more"), (4, "short"), (4, "short")]
    docs = spark.createDataFrame([(*r, 9) for r in rows], "doc_id bigint, text string, kept int")
    got = sorted(((r.doc_id, r.text) for r in minhash.keep_first(docs).collect()), key=str)
    assert got == sorted([(1, base), (2, "something else of its own"), (3, None), (3, ""), (4, "short"), (4, "short")], key=str)


def test_mixed_buckets_link_over_blocks(spark, monkeypatch):
    """Blocks of three classes, two large groups and odd classes, by brute force."""
    monkeypatch.setattr(minhash, "BLOCK", 3)
    rng = random.Random(6)
    texts = []
    for _ in range(3):
        base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        for _ in range(14):
            t = list(base)
            for _ in range(rng.choice([0, 1, 1, 2])):
                t[rng.randrange(60)] = f"n{rng.randrange(10**6)}"
            texts.append(" ".join(t))
    got = {r.doc_id: r.component_id for r in minhash.groups(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    sets = [set(zip(*[t.split()[k:] for k in range(5)], strict=False)) for t in texts]
    root = list(range(len(texts)))
    for _ in range(len(texts)):
        before = list(root)
        for a in range(len(texts)):
            for b in range(len(texts)):
                if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
        if before == root:
            break
    assert [got[i] for i in range(len(texts))] == root


def test_pieces_equal_the_library(monkeypatch):
    pytest.importorskip("tokenizers")
    import public_tokenizers

    rng = random.Random(3)
    odd = ["it's 'size x''s 's  'll we'll they've'd'm I'RE  a\n\n b\n c  ", "5's ½ ²x", "tab\t\tx \n", "'", " '", "a'", "\x1c\x1d a", "ſ ǆ ɏ",
           "日本 it's", "a b <|endoftext|> x", "x" * 3000, "_'s_'re", "l'l 'v 've", "\x85y don't can't'x ", "", " ", "￿￿ a", "\ud800 a" if False else "a"]
    texts = [None, *odd, *("".join(rng.choices("ab' \n\ts're0é.", k=rng.randrange(1, 60))) for _ in range(400))]
    for chunk, held in ((1 << 20, token_files.REMEMBERED), (11, 50)):
        monkeypatch.setattr(token_files, "CHUNK", chunk)
        monkeypatch.setattr(token_files, "REMEMBERED", held)
        coder = token_files.PieceEncoder(public_tokenizers.path(token_files.VOCABULARY))
        for _ in range(2):
            ids, lengths = coder.encode(texts)
            at = 0
            for t, n in zip(texts, lengths.tolist(), strict=True):
                assert ids[at:at + n].tolist() == coder.tokenizer.encode(t or "", add_special_tokens=False).ids, t
                at += n


# ------------------------------------------------------------------- pipeline

def _plain_pipeline(spark, rows, model):
    known: dict = {}
    rows = [r for r, s in zip(rows, model.scores([r[1] for r in rows], known), strict=True) if s < toxicity.THRESHOLD]
    best: dict = {}
    for r in rows:  # equal texts: the largest id, null the smallest
        key = (r[1] or "").translate(FOLD)
        if key not in best or (best[key][0] is None, -(best[key][0] or 0)) > (r[0] is None, -(r[0] or 0)):
            best[key] = r
    rows = list(best.values())
    sets = []
    for r in rows:
        w = WORD.findall((r[1] or "").translate(FOLD))
        sets.append(set(zip(*[w[k:] for k in range(5)], strict=False)) if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(a):
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    row_key = {(r.doc_id, r.text): r.k for r in spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string").select(
        "doc_id", "text", minhash._document_key("doc_id", "text").alias("k")).collect()}
    kept = []
    for a, r in enumerate(rows):
        group = [rows[b] for b in range(len(rows)) if root[b] == root[a]]
        first = min(group, key=lambda x: (x[0] is None, x[0] or 0, row_key[x[:2]]))
        if r is first or not sets[a]:
            kept.append(r)
    docs = [(r[0], r[1], r[3]) for r in kept]
    taken = _plain_mix(docs, _mix_keys(spark, docs))
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))
    out = []
    for n, r in enumerate(kept):
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        out += [(r[0], len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(),
                 hashlib.sha256(text.encode()).hexdigest())] * taken[n][4]
    return out


def test_pipeline_equals_a_plain_version(spark, tmp_path):
    pytest.importorskip("tokenizers")
    import corpus_pipeline

    rng = random.Random(10)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(300)]
    texts = [" ".join(rng.choices(words, k=rng.choice([30, 60]))) for _ in range(60)]
    rows = [(i, t + (" vile nasty" if i % 6 == 0 else ""), "en", rng.choice([None, "a", "b", "b"]), 1) for i, t in enumerate(texts)]
    rows += [(70 + i, rows[i][1].upper(), "en", "a", 1) for i in range(7, 11)]              # copies
    rows += [(80 + i, rows[i][1].replace(rows[i][1].split()[20], "novel", 1), "en", "b", 1) for i in range(13, 17)]  # near copies
    rows += [(90, None, None, None, None), (91, "", "en", "a", 0), (92, " \n", "en", "b", 2), (93, "one", "en", "a", 3),
             (13, "a text of its own under an id that repeats", "en", "a", 1), (None, texts[20] + " x", "en", "a", 1), rows[25], rows[25],
             (94, " ".join(words * 60), "en", "c", 1)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    docs = spark.createDataFrame(rows, schema).repartition(4)
    labels = [(i, int(i % 6 == 0)) for i in range(50)]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    frame = spark.createDataFrame(rows, schema)
    model = toxicity.train(frame.where(~toxicity.held_out()), spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    want = _plain_pipeline(spark, rows, model)
    assert Counter(got) == Counter(want) and 40 < len(got)
    assert not {i for i, *_ in got} & set(range(0, 60, 6))
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/none/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), f"{tmp_path}/none").columns == docs.columns, name
