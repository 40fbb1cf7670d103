"""Secret scanning (operator 9), in DataFrame operations only.

Three base patterns give spans (see ``KINDS``).  The method adds spans: over every
candidate string, a run of token characters, a window of ``window`` characters slides
along; the counts of the characters in it are kept up by adding the one that enters
and taking off the one that leaves, and with them the sum of ``c * log2(c)``, from which
the window's Shannon entropy follows.  A candidate whose best window reaches the
threshold of its character class is reported, unless the allow-list knows its form or a
base span overlaps it.

Positions count code points, ends are exclusive.  Defined results: null and empty texts
have no spans; repeated rows and null ids are scanned row by row; an empty table gives
an empty result; other columns are ignored.  No text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

# The base patterns and the least lengths of what they find.
ASSIGN = (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
          r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
KINDS = (("assign", ASSIGN, 12), ("access", ACCESS, 18), ("hex", HEX, 16))

# Candidates and the classes of their characters, each with the least
# entropy in bits of a suspicious window of WINDOW characters.
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
WINDOW = 20
CLASSES = (("^[0-9A-Fa-f]+$", 2.95), ("^[A-Za-z0-9]+$", 3.45), ("^.*$", 3.65))
#: Forms that are no secrets: words and snake or kebab names, numbers and dates,
#: UUIDs, paths of words, short strings with a placeholder in them.
ALLOWED = (r"^[A-Za-z_/+-]+$", r"^[0-9_/+-]+$", r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
           r"^([A-Za-z]+[0-9]{0,2}[-_/])+[A-Za-z]*[0-9]{0,4}$", r"(?i)^.{0,40}(example|placeholder|changeme|xxxx|0000).{0,40}$")


def running(values: Column) -> Column:
    """Inclusive prefix sums of an array of ints, in log2(n) passes of doubling stride."""
    strides = F.filter(F.array(*[F.lit(1 << k) for k in range(31)]), lambda s: s < F.size(values))
    add = lambda acc, s: F.transform(
        acc, lambda x, i: F.when(i >= s, x + F.coalesce(F.get(acc, i - s), F.lit(0))).otherwise(x)).cast("array<int>")
    return F.aggregate(strides, values.cast("array<int>"), add)


def found(text: Column, pattern: str) -> Column:
    """The text's matches and, between them, the pieces around: array<string> each."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(text.rlike(pattern), F.struct(matches.alias("m"), F.split(text, pattern, -1).alias("p")))


def spans(hit: Column, order: int, keep) -> Column:
    """array<struct<start,end,ord,what>> of the matches for which ``keep(match)`` holds."""
    lengths = F.zip_with(hit["m"], F.slice(hit["p"], F.lit(1), F.size(hit["m"])), lambda m, p: F.length(m) + F.length(p))
    row = lambda m, end: F.struct((end - F.length(m)).alias("start"), end.alias("end"), F.lit(order).alias("ord"), m.alias("what"))
    placed = F.zip_with(hit["m"], running(lengths), row)
    return F.filter(placed, lambda x: keep(x["what"]))


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def entropy(word: Column) -> Column:
    """The largest Shannon entropy, in bits, of a window of WINDOW characters of ``word``.

    Its cost is the word's length times that of its alphabet: characters are numbered once,
    and each step carries their counts on."""
    return bound(F.split(word, ""), lambda chars: bound(F.array_distinct(chars), lambda alphabet: bound(
        F.transform(chars, lambda c: F.array_position(alphabet, c).cast("int") - 1), lambda places: _slid(places, alphabet))))


def _slid(places: Column, alphabet: Column) -> Column:
    f = lambda n: F.when(n > 1, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))
    start = F.struct(F.transform(alphabet, lambda c: F.lit(0)).alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("best"))

    def slide(acc: Column, at: Column) -> Column:
        # at: the place of the character that enters and that of the one that leaves, or -1
        a, b = at["a"], at["b"]
        na, nb = F.get(acc["n"], a), F.get(acc["n"], F.greatest(b, F.lit(0)))
        moves = (b >= 0) & (a != b)
        s = acc["s"] + F.when((b >= 0) & (a == b), F.lit(0.0)).otherwise(
            f(na + 1) - f(na) + F.when(moves, f(nb - 1) - f(nb)).otherwise(F.lit(0.0)))
        n = F.transform(acc["n"], lambda c, i: c + F.when(i == a, 1).otherwise(0) - F.when(i == b, 1).otherwise(0))
        best = F.when(at["full"], F.greatest(acc["best"], F.log2(F.lit(float(WINDOW))) - s / WINDOW)).otherwise(acc["best"])
        return F.struct(n.alias("n"), s.alias("s"), best.alias("best"))

    steps = F.transform(places, lambda a, i: F.struct(
        a.alias("a"), F.when(i >= WINDOW, F.get(places, i - WINDOW)).otherwise(F.lit(-1)).alias("b"),
        (i >= WINDOW - 1).alias("full")))
    return F.aggregate(steps, start, slide, lambda acc: acc["best"])


def path_of_words(word: Column) -> Column:
    """What ALLOWED[3] matches, part by part: a regular expression with a repeated group fails on very long words for want of stack."""
    parts = F.split(word, "[-_/]")
    whole = F.forall(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda x: x.rlike("^[A-Za-z]+[0-9]{0,2}$"))
    return (F.size(parts) > 1) & whole & F.element_at(parts, -1).rlike("^[A-Za-z]*[0-9]{0,4}$")


def suspicious(word: Column) -> Column:
    """Whether a candidate's form is not allow-listed and its entropy reaches its class's threshold."""
    allowed = F.lit(False)
    for i, pattern in enumerate(ALLOWED):
        allowed = allowed | (path_of_words(word) if i == 3 else word.rlike(pattern))
    least = F.lit(99.0)
    for pattern, bits in reversed(CLASSES):
        least = F.when(word.rlike(pattern), F.lit(bits)).otherwise(least)
    return F.when(allowed, F.lit(False)).otherwise(entropy(word) >= least)


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` reduced to doc_id and its spans: array<struct<start,end,ord,what>> base and extra, by start then kind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    step = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    step = step.select("doc_id", *[found(F.col("text"), p).alias(k) for k, p, _ in KINDS], found(F.col("text"), CANDIDATE).alias("candidate"))
    none = F.expr("cast(array() as array<struct<start:int,end:int,ord:int,what:string>>)")
    kept = {
        "assign": lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= KINDS[0][2],
        "access": lambda m: F.length(m) >= KINDS[1][2],
        "hex": lambda m: F.length(m) >= KINDS[2][2],
    }
    step = step.select("doc_id", "candidate", *[F.coalesce(spans(F.col(k), i, kept[k]), none).alias(k) for i, (k, _, _) in enumerate(KINDS)])
    step = step.withColumn("base", F.array_sort(F.concat("assign", "access", "hex")))
    # the entropy of a candidate is looked at only where no base span overlaps it
    bare = lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    extra = F.filter(F.coalesce(spans(F.col("candidate"), len(KINDS), lambda m: ~m.rlike(ALLOWED[0])), none),
                     lambda x: F.when(bare(x), suspicious(x["what"])).otherwise(F.lit(False)))
    return step.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k, _, _ in KINDS], "base", extra.alias("extra"))


def listed(col: Column) -> Column:
    names = F.array(*[F.lit(k) for k, _, _ in KINDS], F.lit("entropy"))
    return F.array_join(F.transform(col, lambda x: F.concat_ws(":", F.get(names, x["ord"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def op9_secret_scan(spark, sf_dir: str) -> DataFrame:
    out = scan(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
                      listed(F.array_sort(F.concat("base", "extra"))).alias("spans"))


def _sql() -> str:
    q = lambda s: s.replace("'", "''")
    def kind(name: str, pattern: str, order: int, test: str) -> str:
        return f"""
SELECT doc_id, rid, '{name}' AS kind, {order} AS ord, s AS start, s + length(m) AS stop, m FROM (
  SELECT doc_id, rid, m, list_sum(list_transform(p[1:i], lambda x: length(x)))::BIGINT + list_sum(list_transform(ms[1:i], lambda x: length(x)))::BIGINT - length(m) AS s FROM (
    SELECT doc_id, rid, ms, p, unnest(ms) AS m, unnest(range(1, len(ms) + 1)) AS i FROM (
      SELECT doc_id, rid, regexp_extract_all(text, '{q(pattern)}') AS ms, string_split_regex(text, '{q(pattern)}') AS p FROM d)))
WHERE {test}"""
    allowed = " OR ".join(f"regexp_matches(m, '{p}')" for p in ALLOWED)
    least = "CASE " + " ".join(f"WHEN regexp_matches(m, '{p}') THEN {b}::DOUBLE" for p, b in CLASSES) + " END"
    best = (f"list_max(list_transform(range(1, length(m) - {WINDOW} + 2), lambda k: list_entropy(string_split(substring(m, k, {WINDOW}), ''))))")
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS text FROM documents),
base AS ({kind('assign', ASSIGN, 0, f"length(regexp_extract(m, '{q(ASSIGN)}', 2)) >= 12")}
UNION ALL {kind('access', ACCESS, 1, 'length(m) >= 18')}
UNION ALL {kind('hex', HEX, 2, 'length(m) >= 16')}),
cand AS ({kind('entropy', CANDIDATE, 3, f'NOT ({allowed})')}),
extra AS (SELECT * FROM cand c WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = c.rid AND b.start < c.stop AND c.start < b.stop)
  AND {best} >= {least}),
b AS (SELECT rid, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) AS txt,
  count(*) FILTER (kind = 'assign') AS na, count(*) FILTER (kind = 'access') AS nk, count(*) FILTER (kind = 'hex') AS nh FROM base GROUP BY rid),
a AS (SELECT rid, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) AS txt FROM (FROM base UNION ALL FROM extra) GROUP BY rid)
SELECT doc_id, coalesce(na, 0)::BIGINT AS n_assign, coalesce(nk, 0)::BIGINT AS n_access, coalesce(nh, 0)::BIGINT AS n_hex,
  sha256(coalesce(b.txt, '')) AS base_sha256, coalesce(a.txt, '') AS spans
FROM d LEFT JOIN b USING (rid) LEFT JOIN a USING (rid)
"""


OP9_SQL = _sql()
