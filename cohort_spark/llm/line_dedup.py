"""Line dedup by a deletion-neighbourhood join (native Spark), edit bound 1.

Lines are compared after trimming white space; a line without a word is always
kept.  A line goes if an earlier line (smaller id, then smaller number in its
document) is equal to it or within one edit (a character changed, added or taken
away).

1. Equal lines meet by a 128-bit hash; the first of each stays a candidate.
2. Within one edit, the first or the last half of two lines is equal.  Lines that
   share such a half with another are cut into ``SEGMENTS`` parts; one edit touches
   one of them, so only a part whose surroundings another line shares can hold it.
   Parts of over ``LEAF`` characters are cut again in the same way, so only short parts
   are left and a line of n characters costs n for each level of cutting.
3. For each such part the line emits the hash of its surroundings with every deletion
   variant of the part, so a variant costs ``LEAF`` characters, however long the line.
   Lines that meet with the same place deleted differ in that character; a line
   that meets another's variant as a whole lacks one character.  All that meet are
   within the bound of the earliest, so a minimum for each key does, and no pairs
   are emitted.  A key's lines differ in one character at most, which bounds them by
   the alphabet and the length of the line, not by the corpus.
4. Each found pair (one for a line at most) is verified by its edit distance.

Rows with the same id and the same text count as one document: all of them keep the
same lines.  Null text has no lines and stays null.  An empty table gives no rows.
Extra columns are not touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, written

SEGMENTS = 16
#: Parts of up to so many characters are not cut again.
LEAF = 32
_SPACE = " \t\n\x0b\x0c\r"


def _document_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col(text_col))


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(__id, __dk, __no, __line) of all lines with a word; numbers start at 0."""
    return (docs.select(F.col(id_col).alias("__id"), _document_key(id_col, text_col).alias("__dk"),
                        F.posexplode(F.split(F.col(text_col), "\n")).alias("__no", "__raw"))
            .where(F.col("__raw").rlike(WORD_PATTERN))
            .select("__id", "__dk", "__no", F.btrim("__raw", F.lit(_SPACE)).alias("__line")))


def _hash(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("__h1"), F.xxhash64(F.lit("second"), line).alias("__h2")]


def _halves(line: Column) -> Column:
    """Keys of the halves: the first and last k characters, for k of the line
    itself and of a line one character shorter."""
    n = F.length(line)
    k, less = F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")

    def pair(k: Column) -> Column:
        return F.array(F.xxhash64(F.lit("first"), F.substring(line, F.lit(1), k)),
                       F.xxhash64(F.lit("last"), F.substring(line, n - k + 1, k)))

    return F.array_distinct(F.concat(pair(k), pair(less)))


def _parts(text: Column, size: Column, extra: Column | int, rest: Column, start: Column) -> Column:
    """Parts of ``text`` as structs (s, start, size, part, rest): part s starts at
    s * size / SEGMENTS and takes ``extra`` characters of the next; ``rest`` is the hash of
    all around it, and ``start`` its place in the line."""
    def one(s: Column) -> Column:
        at = F.floor(s * size / SEGMENTS).cast("int")
        own = F.floor((s + 1) * size / SEGMENTS).cast("int") - at
        return F.struct(
            s.alias("s"), (start + at).alias("start"), own.alias("size"), F.substring(text, at + 1, own + extra).alias("part"),
            F.xxhash64(rest, F.substring(text, F.lit(1), at), F.substring(text, at + own + extra + 1, F.length(text))).alias("rest"))

    return F.transform(F.sequence(F.lit(0), F.lit(SEGMENTS - 1)), one)


def _whole(line: Column, kind: int) -> Column:
    """Parts of the line itself (kind 0), or of a line with one character less (kind 1)."""
    size = F.length(line) - kind
    return _parts(line, size, kind, size, F.lit(0))


def _key(part: Column) -> Column:
    return F.xxhash64(part["start"], part["size"], part["rest"])


def _surroundings(line: Column) -> Column:
    """Structs (key, kind, s): the line without part s."""
    def keys(kind: int) -> Column:
        return F.transform(_whole(line, kind), lambda p: F.struct(
            _key(p).alias("key"), F.lit(kind).alias("kind"), p["s"].alias("s")))

    return F.concat(keys(0), keys(1))


def _chosen(line: Column, kinds: list[Column]) -> Column:
    """Structs (kind, part) of the parts whose numbers ``kinds`` holds, of kind 0 and 1."""
    def some(kind: int) -> Column:
        return F.transform(F.filter(_whole(line, kind), lambda p: F.array_contains(kinds[kind], p["s"])),
                           lambda p: F.struct(F.lit(kind).alias("kind"), p.alias("part")))

    return F.concat(some(0), some(1))


def _shared(keyed: DataFrame) -> DataFrame:
    """Those rows of ``keyed`` whose key another row has."""
    common = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    return keyed.join(common, "key", "left_semi")


def _short_parts(parts: DataFrame) -> DataFrame:
    """(__at, kind, part) cut again until every part is short; of the smaller parts
    only those with shared surroundings stay."""
    done, left = parts.where(F.col("part.size") <= LEAF), parts.where(F.col("part.size") > LEAF)
    while not left.isEmpty():
        p = F.col("part")
        cut = left.select("__at", "kind", F.explode(_parts(p["part"], p["size"], F.col("kind"), p["rest"], p["start"])).alias("part"))
        cut = written(_shared(cut.withColumn("key", _key(F.col("part")))).select("__at", "kind", "part"), "parts")
        done, left = done.unionByName(cut.where(F.col("part.size") <= LEAF)), cut.where(F.col("part.size") > LEAF)
    return done


def _variants(kind: Column, p: Column) -> Column:
    """Structs (key, role): role 0 meets its like, role 1 is a whole part that meets
    role 2, a part with one character taken away."""
    n = F.length(p["part"])
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))

    def cut(i: Column) -> list[Column]:
        return [F.substring(p["part"], F.lit(1), i - 1), F.substring(p["part"], i + 1, n)]

    def row(role: int, *key: Column) -> Column:
        return F.struct(F.xxhash64(*key).alias("key"), F.lit(role).alias("role"))

    around = [p["start"], p["size"], p["rest"]]
    changed = F.transform(places, lambda i: row(0, F.lit("changed"), i, *around, *cut(i)))
    whole = F.array(row(1, F.lit("less"), *around, p["part"]))
    less = F.transform(places, lambda i: row(2, F.lit("less"), *around, F.concat(*cut(i))))
    return F.when(kind == 0, F.concat(changed, whole)).otherwise(less)


def near_lines(firsts: DataFrame, lines: DataFrame) -> DataFrame:
    """Of distinct lines (__h1, __h2, __first), those with an earlier line within
    one edit: (__h1, __h2, __at, __line, __by_line), verified.

    ``lines`` gives the texts again: (__id, __dk, __no, __line).
    """
    halves = firsts.select("__h1", "__h2", F.explode("__halves").alias("__half"))
    shared = halves.groupBy("__half").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("__half")
    suspects = written(halves.join(shared, "__half", "left_semi").select("__h1", "__h2").distinct()
                       .join(firsts.drop("__halves"), ["__h1", "__h2"]), "suspects")
    at = suspects.select(F.col("__first.__id").alias("__id"), F.col("__first.__dk").alias("__dk"),
                         F.col("__first.__no").alias("__no"), "__h1", "__h2").groupBy("__dk").agg(
        F.collect_list(F.struct("__no", "__h1", "__h2")).alias("__wanted"))
    # Whole texts meet the numbers of their suspect lines; the lines are cut after
    # that.  What meets the texts grows with the input, so one strategy for all sizes.
    texts = written(lines.join(at.hint("merge"), "__dk").select(
        F.col("__id"), "__dk", F.explode("__wanted").alias("w"), "__text").select(
        F.struct("__id", "__dk", F.col("w.__no").alias("__no")).alias("__at"), F.col("w.__h1").alias("__h1"),
        F.col("w.__h2").alias("__h2"),
        F.btrim(F.get(F.split("__text", "\n"), F.col("w.__no")), F.lit(_SPACE)).alias("__line"))
        .dropDuplicates(["__h1", "__h2"]), "suspect-lines")
    around = texts.select("__at", F.inline(_surroundings(F.col("__line"))))
    kinds = [F.collect_list(F.when(F.col("kind") == k, F.col("s"))).alias(f"k{k}") for k in (0, 1)]
    places = _shared(around).groupBy("__at").agg(*kinds)
    parts = written(texts.join(places, "__at").select(
        "__at", F.inline(_chosen(F.col("__line"), [F.col("k0"), F.col("k1")]))), "parts")
    emitted = _short_parts(parts).select("__at", F.inline(_variants(F.col("kind"), F.col("part"))))
    met = Window.partitionBy("key")

    def earliest(role: int) -> Column:
        return F.min(F.when(F.col("role") == role, F.col("__at"))).over(met)

    partner = (F.when(F.col("role") == 0, F.col("m0")).when(F.col("role") == 1, F.col("m2")).otherwise(F.col("m1")))
    found = (emitted.select("__at", "role", earliest(0).alias("m0"), earliest(1).alias("m1"), earliest(2).alias("m2"))
             .select("__at", partner.alias("__by")).where(F.col("__by") < F.col("__at"))
             .groupBy("__at").agg(F.min("__by").alias("__by")))
    other = texts.select(F.col("__at").alias("__by"), F.col("__line").alias("__by_line"))
    return (found.join(texts, "__at").join(other, "__by")
            .where(F.levenshtein("__line", "__by_line", 1) >= 0).select("__h1", "__h2", "__at", "__by", "__line", "__by_line"))


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lines that go, by document: (__dk, __exact: numbers, __near: numbers)."""
    lines = written(_lines(docs, id_col, text_col).select(
        "__id", "__dk", "__no", *_hash(F.col("__line")), _halves(F.col("__line")).alias("__halves")), "lines")
    place = F.struct("__id", "__dk", "__no")
    firsts = written(lines.groupBy("__h1", "__h2").agg(
        F.min(place).alias("__first"), F.count(F.lit(1)).alias("__n"), F.min("__halves").alias("__halves")), "first-lines")
    texts = docs.select(F.col(id_col).alias("__id"), _document_key(id_col, text_col).alias("__dk"), F.col(text_col).alias("__text"))
    near = written(near_lines(firsts.drop("__n"), texts).select("__h1", "__h2", F.lit(True).alias("__near")), "near-lines")
    # Lines that repeat, and lines with a near one: few of all distinct lines.
    odd = firsts.where("__n > 1").select("__h1", "__h2", "__first").join(near, ["__h1", "__h2"], "full").select(
        "__h1", "__h2", "__first", "__near")
    gone = (lines.select("__id", "__dk", "__no", "__h1", "__h2").join(odd, ["__h1", "__h2"])
            .where(F.col("__near") | (F.col("__first") != place))
            .groupBy("__dk").agg(
                F.array_sort(F.collect_set(F.when(F.col("__first").isNotNull() & (F.col("__first") != place), F.col("__no")))).alias("__exact"),
                F.array_sort(F.collect_set(F.when(F.col("__first").isNull() | (F.col("__first") == place), F.col("__no")))).alias("__near")))
    return written(gone, "dropped-lines")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the lines that stay as its text, and __exact and __near: the
    numbers of the lines taken out of each document."""
    gone = dropped_lines(docs, id_col, text_col)
    none = F.array().cast("array<int>")
    joined = docs.withColumn("__dk", _document_key(id_col, text_col)).join(gone.hint("merge"), "__dk", "left").withColumns({
        "__exact": F.coalesce("__exact", none), "__near": F.coalesce("__near", none)})
    out = F.concat("__exact", "__near")
    kept = F.when(F.size(out) == 0, F.col(text_col)).otherwise(F.array_join(
        F.filter(F.split(F.col(text_col), "\n"), lambda x, i: ~F.array_contains(out, i)), "\n"))
    return joined.withColumn(text_col, kept).select(*docs.columns, "__exact", "__near")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_lines (before), n_exact, n_near, kept_sha256 (the text that stays) of
    every row."""
    done = dedup_lines(docs.select(id_col, text_col), id_col, text_col)
    taken = F.size("__exact") + F.size("__near")
    after = F.when(F.col(text_col).isNull(), 0).when(
        (F.col(text_col) == "") & (taken > 0), 0).otherwise(F.size(F.split(F.col(text_col), "\n")))
    return done.select(
        id_col, (after + taken).cast("long").alias("n_lines"), F.size("__exact").cast("long").alias("n_exact"),
        F.size("__near").cast("long").alias("n_near"),
        F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("kept_sha256"))
