"""One query for each operator, over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bpe, exact_dedup, language, line_dedup, minhash, mixing, quality, search, sharding, simhash, spelling, token_files,
    toxicity)
from .common import read_table


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    return minhash.groups(read_table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded."""
    return bpe.encode_decode(read_table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line dedup over all documents."""
    return line_dedup.report(read_table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules over all documents."""
    return quality.decide(read_table(spark, sf_dir, "documents")).drop("removed_lines")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token segments, written and read back."""
    return token_files.token_files(read_table(spark, sf_dir, "documents"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of all documents; learned from rows that are not held out."""
    docs = read_table(spark, sf_dir, "documents")
    texts = language.learn(docs.where(~toxicity.held_out()))
    return language.predict(docs, texts).select(
        "doc_id", toxicity.held_out().alias("held_out"), "lang_pred", "score")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact dedup decisions for all documents."""
    return exact_dedup.decide(read_table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards."""
    return sharding.shard(read_table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents; learned from rows that are not held out."""
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.train(docs.where(~toxicity.held_out()), read_table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", toxicity.held_out().alias("held_out"), F.col("__score").alias("score"), F.col("__predicted").alias("predicted"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the target weights of their sources."""
    return mixing.decide(read_table(spark, sf_dir, "documents"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vocabulary words of all documents with their forms and roots."""
    return spelling.variants(read_table(spark, sf_dir, "documents"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and near-duplicate groups of all documents."""
    return simhash.groups(read_table(spark, sf_dir, "documents"))


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    return search.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (
    op1_minhash, op2_bpe, op3_line_dedup, op4_quality, op5_token_files, op6_language, op7_exact_dedup, op8_sharding,
    op9_toxicity, op10_mixing, op11_spelling, op12_simhash, op13_search)}

_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE = {
    "op7_exact_dedup": f"""
        WITH d AS (SELECT doc_id, sha256({_FOLDED}) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
               count(*) OVER (PARTITION BY text_sha256) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
        FROM d""",
    "op4_quality": rf"""
        WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text,
                          regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM d),
        chars AS (SELECT doc_id, sum(length(word)) AS word_chars FROM w GROUP BY doc_id),
        g AS (SELECT doc_id, i, word, lead(word, 1) OVER o AS w2, lead(word, 2) OVER o AS w3 FROM w
              WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
        twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, word, w2, w3) AS n FROM g WHERE w3 IS NOT NULL),
        covered AS (SELECT DISTINCT doc_id, i + k AS i FROM twice, (VALUES (0), (1), (2)) t(k) WHERE n > 1),
        repeated AS (SELECT doc_id, count(*) AS n_repeat_words FROM covered GROUP BY doc_id),
        raw AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM d),
        lines AS (SELECT doc_id, source, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
                         translate(array_to_string(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), ' '),
                                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
                  FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
        dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines GROUP BY doc_id),
        each AS (SELECT doc_id, source, norm, sum(n) AS n FROM lines GROUP BY doc_id, source, norm),
        hosts AS (SELECT source, greatest({quality.MIN_DOCS}, count(*) * {quality.SHARE}) AS most FROM documents GROUP BY source),
        frequent AS (SELECT e.source, norm FROM each e JOIN hosts h ON e.source IS NOT DISTINCT FROM h.source
                     GROUP BY e.source, norm, most HAVING count(*) > most),
        gone AS (SELECT doc_id, sum(n) AS removed FROM each e JOIN frequent f
                 ON e.norm = f.norm AND e.source IS NOT DISTINCT FROM f.source GROUP BY doc_id),
        r AS (SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
                     CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                     CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
                     CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
                     CAST(coalesce(removed, 0) AS BIGINT) AS removed_words
              FROM d LEFT JOIN chars USING (doc_id) LEFT JOIN repeated USING (doc_id) LEFT JOIN dups USING (doc_id)
              LEFT JOIN gone USING (doc_id))
        SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
               NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 2 * removed_words <= n_words AS kept
        FROM r""",
    "op11_spelling": rf"""
        WITH RECURSIVE steps AS (SELECT [list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1
                 THEN xor(c // 2, 3988292384::BIGINT) ELSE c // 2 END, b) FOR b IN range(256)] AS t),
        runs AS (SELECT doc_id, unnest(regexp_extract_all({_FOLDED}, '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
        each AS (SELECT doc_id, run, count(*) AS k, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS named FROM runs
                 WHERE length(run) >= {spelling.MIN_LENGTH} GROUP BY doc_id, run),
        bytes AS (SELECT run, k, [CAST('0x' || hex(encode(named))[2 * i - 1:2 * i] AS BIGINT)
                                  FOR i IN range(1, octet_length(encode(named)) + 1)] AS b FROM each),
        summed AS (SELECT run, k, xor(4294967295::BIGINT, list_reduce(b, lambda c, x:
                   xor(c // 256, t[xor(c % 256, x) + 1]), 4294967295::BIGINT)) AS h FROM bytes, steps),
        typed AS (SELECT k, CASE WHEN h % {spelling.TYPO} = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word
                  FROM summed),
        words AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM typed WHERE length(word) >= {spelling.MIN_LENGTH}
                  GROUP BY word HAVING sum(k) >= {spelling.MIN_COUNT}),
        less AS (SELECT DISTINCT word, n, i, word[:i - 1] || word[i + 1:] AS rest FROM words, unnest(range(1, length(word) + 1)) u(i)),
        pairs AS (SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM less a JOIN less b USING (i, rest) WHERE a.word <> b.word
                  UNION SELECT a.word, a.n, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
                  UNION SELECT b.word, b.n, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
        ranked AS (SELECT *, count(*) OVER (PARTITION BY word) AS n_near,
                          row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS place FROM pairs),
        forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= {spelling.RATIO} * w.n THEN near END AS form,
                         CASE WHEN near_n >= {spelling.RATIO} * w.n THEN near_n END AS form_n
                  FROM words w LEFT JOIN ranked r ON w.word = r.word AND place = 1),
        walk AS (SELECT word, word AS root FROM forms
                 UNION ALL SELECT walk.word, f.form FROM walk JOIN forms f ON f.word = walk.root WHERE f.form IS NOT NULL),
        roots AS (SELECT word, root FROM walk JOIN (SELECT word AS root FROM forms WHERE form IS NULL) USING (root))
        SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)""",
    "op13_search": rf"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id,
                          regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
        totals AS (SELECT count(*) FILTER (len(ts) > 0) AS n_docs, CAST(sum(len(ts)) AS BIGINT) AS n_terms FROM d),
        counts AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ts) AS t FROM d) GROUP BY r, t),
        weights AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
                    FROM counts, totals GROUP BY t, n_docs),
        items AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
        m AS (SELECT r, doc_id, 50 + (50 * len(ts) * n_docs) // n_terms AS m FROM d, totals WHERE len(ts) > 0),
        scored AS (SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
                   FROM items JOIN counts USING (t) JOIN weights USING (t) JOIN m USING (r) GROUP BY item_id, r, doc_id)
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
        FROM scored WHERE score > 0
        QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50""",
}
