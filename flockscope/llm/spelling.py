"""Spelling variants by symmetric deletion (operator 12).

Words are counted in one pass over the texts, combined before they are shuffled.  Every
word of the vocabulary then emits hashes of itself and of its distinct single deletions,
with a hash of the word for the word, so that the rows stay small however long it is.
Words that share a key are candidates, and Levenshtein's distance, stopped beyond one,
verifies each.  Two words one edit apart share exactly one key: the deletion of the place
where they differ, or the shorter word.  A key of L code points stands for at most
(L + 1) * s words of s letters, so the join has no hot keys however frequent a word is.

A word's form is its most frequent near word, if that is ``ratio`` times as frequent.
Counts grow by that factor along a chain of forms, so chains are short; roots come from
following pointers, doubling each round.

Defined results: null and empty texts have no words; a null doc_id counts as an empty one
in ``damaged``; repeated rows count each; an empty table gives an empty result; columns
other than doc_id and text are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

RUN = r"[A-Za-zÀ-ÿ]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def runs(docs: DataFrame) -> DataFrame:
    """All maximal runs of letters, A-Z lower-cased: doc_id, run."""
    found = F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(RUN), F.lit(0)))
    return docs.select("doc_id", found.alias("run")).select("doc_id", F.translate("run", UPPER, UPPER.lower()).alias("run"))


def without(word: Column, at: Column) -> Column:
    """``word`` without its code point ``at`` (from 0)."""
    return F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))


def damaged(found: DataFrame, every: int = 199) -> DataFrame:
    """``run`` as ``word``, one in ``every`` (document, run) pairs without one code point: that at crc32 % length."""
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    out = found.select("run", h.alias("h"))
    return out.select(F.when(F.col("h") % every == 0, without(F.col("run"), (F.col("h") % F.length("run")).cast("int"))).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, letters: int = 6, least: int = 5) -> DataFrame:
    """Words of at least ``letters`` code points that occur ``least`` times or more: word, n."""
    return words.filter(F.length("word") >= letters).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def near_pairs(vocab: DataFrame) -> DataFrame:
    """All ordered pairs of words at distance one: word, other, m (the other's n)."""
    whole = F.xxhash64("word")
    cut = F.transform(F.sequence(F.lit(0), F.length("word") - 1), lambda i: F.xxhash64(without(F.col("word"), i)))
    keyed = vocab.select(whole.alias("id"), F.explode(F.array_distinct(F.concat(F.array(whole), cut))).alias("key"))
    # written once: the two sides of the join read the same rows
    keyed = common.materialize(keyed, "spelling-keys")
    left, right = keyed.select("key", F.col("id").alias("a")), keyed.select(F.col("key").alias("same"), F.col("id").alias("b"))
    pairs = left.join(right, (F.col("key") == F.col("same")) & (F.col("a") != F.col("b"))).select("a", "b")
    one = vocab.select(F.xxhash64("word").alias("x"), "word")
    two = vocab.select(F.xxhash64("word").alias("y"), F.col("word").alias("other"), F.col("n").alias("m"))
    pairs = pairs.join(one, F.col("a") == F.col("x")).join(two, F.col("b") == F.col("y"))
    return pairs.filter(F.levenshtein("word", "other", 1) == 1).select("word", "other", "m")


def roots(forms: DataFrame) -> DataFrame:
    """``forms`` (word, form) followed to the last one: word, root.  The number of rounds is logarithmic in the longest chain."""
    out = common.materialize(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        step = out.select(F.col("word").alias("at"), F.col("root").alias("next"))
        moved = out.join(step, F.col("root") == F.col("at"), "left")
        out = common.materialize(moved.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if out.filter("moved").isEmpty():
            return out.select("word", "root")
        out = out.drop("moved")


def variants(vocab: DataFrame, ratio: int = 5) -> DataFrame:
    """Each word with its form and root: word, form, root, n, n_near, form_n."""
    vocab = common.materialize(vocab.select("word", "n"), "spelling-words")
    best = near_pairs(vocab).groupBy(F.col("word").alias("w")).agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("first"))
    out = vocab.join(best, F.col("word") == F.col("w"), "left")
    large = -F.col("first.m") >= F.col("n") * ratio
    out = common.materialize(out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                        F.when(large, F.col("first.other")).alias("form"), F.when(large, -F.col("first.m")).alias("form_n")), "spelling-forms")
    last = roots(out.filter("form is not null")).withColumnRenamed("word", "w")
    return (out.join(last, F.col("word") == F.col("w"), "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))


def op12_spelling_variants(spark, sf_dir: str) -> DataFrame:
    """Every word of the documents with its form and root."""
    return variants(vocabulary(damaged(runs(common.table(spark, sf_dir, "documents")))))


_CRC = ("xor(list_reduce([4294967295::BIGINT] || flatten(list_transform(bytes, lambda b: [b, 0, 0, 0, 0, 0, 0, 0])), "
        "lambda a, x: xor(xor(a, x) >> 1, 3988292384::BIGINT * (xor(a, x) & 1))), 4294967295::BIGINT)")
# the letters are of one byte, or of two that follow from the code point
_BYTES = ("flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda ch: "
          "CASE WHEN ord(ch) < 128 THEN [ord(ch)::BIGINT] ELSE [(192 + (ord(ch) >> 6))::BIGINT, (128 + (ord(ch) & 63))::BIGINT] END))")

OP12_SQL = f"""
WITH RECURSIVE raw AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')), '{UPPER}', '{UPPER.lower()}') AS run FROM documents),
once AS (SELECT doc_id, run, count(*) AS k, {_BYTES} AS bytes FROM raw WHERE length(run) >= 6 GROUP BY doc_id, run),
h AS (SELECT run, k, {_CRC} AS h FROM once),
w AS (SELECT CASE WHEN h % 199 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, k FROM h),
v AS (SELECT word, sum(k)::BIGINT AS n FROM w WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
d AS (SELECT word, n, i, word[1:i - 1] || word[i + 1:] AS cut FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
near AS (SELECT a.word, b.word AS other, b.n AS m FROM d a JOIN d b ON a.i = b.i AND a.cut = b.cut AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM d a JOIN v b ON a.cut = b.word
  UNION SELECT b.word, a.word, a.n FROM d a JOIN v b ON a.cut = b.word),
best AS (SELECT word, count(*) AS n_near, max(m) AS top, min(other) FILTER (m = t) AS other FROM (SELECT *, max(m) OVER (PARTITION BY word) AS t FROM near) GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 5 * v.n THEN other END AS form, CASE WHEN top >= 5 * v.n THEN top END AS form_n FROM v LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS last, 0 AS steps FROM f UNION ALL SELECT walk.word, f.form, steps + 1 FROM walk JOIN f ON f.word = walk.last WHERE f.form IS NOT NULL),
r AS (SELECT word, arg_max(last, steps) AS root FROM walk GROUP BY word)
SELECT word, form, root, n::BIGINT AS n, n_near::BIGINT AS n_near, form_n::BIGINT AS form_n FROM f JOIN r USING (word)
"""
