"""Line deduplication with a log-template tree (operator 2).

The tree has a fixed depth: lines part by their number of tokens, then by their first
``depth`` tokens, tokens with a digit standing for any token.  In a leaf, a token that
stands at its place in fewer than ``min_docs`` documents is a variable field; what
remains constant is the line's template, which must be a share ``constant`` of its
tokens.  Where that is less, tokens that ``recurs`` documents share make the template; as
a leaf's first tokens agree in any case, those behind them must be the share ``constant``.
A template found in ``recurs`` documents or more recurs.  Lines of recurring templates are
dropped; only the first of each (by doc_id, then row, then line) stays, so that no content
is lost altogether: lines that agree in the second kind of template agree in the first.

Lines of fewer than ``least_tokens`` tokens are leaves of their own, alike only if all tokens
are, digits too.  They say less the shorter they are: each token less doubles the documents
that one must stand in to recur (of 4 tokens 4, of 3 tokens 8, of one 32).

Leaves are counted first, so that only lines of leaves that several documents share are
looked at again; where those all have the same line, it is the template.  No leaf is ever
gathered in a task: fields, templates and documents are all counted by sums that are
combined before they are shuffled.

Defined results: a null text stays null and an empty one empty; blank lines stay; equal rows (same id and text) count as one document and are
treated alike; rows with a null id come last in the order; an empty table gives an empty
result; all columns of the input are kept, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, texts

ANY = b"<*>"
_DIGITS = frozenset(b"0123456789")


def masked(line: bytes) -> list[bytes]:
    """The line's tokens, those with a digit generalised."""
    words = line.split()
    return words if not any(d in line for d in _DIGITS) else [ANY if not _DIGITS.isdisjoint(w) else w for w in words]


def leaf_of(words: list[bytes], depth: int) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(b" ".join([b"%d" % len(words), *words[:depth]])) - (1 << 63)


def line_of(words: list[bytes]) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(b" ".join(words)) - (1 << 63)


def placed(line: bytes, least: int, depth: int) -> tuple[list[bytes], int]:
    """The tokens that a line is compared by, and its leaf: short lines are leaves of their own, token by token."""
    words = line.split()
    if len(words) < least:
        return words, line_of([b"short", *words])
    words = masked(line)
    return words, leaf_of(words, depth)


def _leaves(least: int, depth: int, recurs: int):
    """Of each document its leaves, each with the least and greatest hash of its lines there and the documents it needs."""
    kind = pa.list_(pa.struct([("leaf", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("need", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text in texts.as_bytes(b.column("text")):
                own: dict[int, tuple[int, int, int]] = {}
                for line in (text or b"").split(b"\n"):
                    words, leaf = placed(line, least, depth)
                    if words:
                        name = line_of(words)
                        lo, hi, _ = own.get(leaf, (name, name, 0))
                        own[leaf] = (min(lo, name), max(hi, name), recurs << max(0, least - len(words)))
                rows.append([{"leaf": k, "lo": lo, "hi": hi, "need": n} for k, (lo, hi, n) in own.items()])
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(rows, kind)], ["key", "leaves"])

    return run


def _hot_lines(least: int, depth: int):
    """Of the documents' lines in hot leaves: leaf, hash of the masked line, the places of all equal ones, the tokens' hashes (null where the leaf has one line only);
    ``again`` holds, at a document's first line of a leaf, the fields that others of its lines there repeat, and how often."""
    field = pa.struct([("at", pa.int32()), ("field", pa.int64()), ("times", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "key", "leaf", "line", "places", "fields", "again")}
            for doc_id, key, text, hot in zip(b.column("doc_id").to_pylist(), b.column("key").to_pylist(), texts.as_bytes(b.column("text")),
                                              b.column("hot").to_pylist(), strict=True):
                hot = {x["leaf"]: x["alone"] for x in hot}
                own: dict[tuple[int, int], list[int]] = {}
                words_of = {}
                for i, line in enumerate((text or b"").split(b"\n")):
                    words, leaf = placed(line, least, depth)
                    if words and leaf in hot:
                        name = (leaf, line_of(words))
                        own.setdefault(name, []).append(i)
                        words_of[name] = words
                fields_of = {x: [xxhash.xxh3_64_intdigest(w) - (1 << 63) for w in words_of[x]] for x in own if not hot[x[0]]}
                seen: dict[int, Counter] = {}
                for (leaf, _), fields in fields_of.items():
                    seen.setdefault(leaf, Counter()).update(enumerate(fields))
                for (leaf, line), places in own.items():
                    again = [{"at": i, "field": f, "times": n - 1} for (i, f), n in seen.pop(leaf, {}).items() if n > 1]
                    for k, v in zip(out, (doc_id, key, leaf, line, places, fields_of.get((leaf, line)), again), strict=True):
                        out[k].append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(field)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out.values(), kinds, strict=True)], list(out))

    return run


def recurring(docs: DataFrame, min_docs: int, depth: int, constant: float, least_tokens: int, recurs: int) -> DataFrame:
    """(key, drop): the line numbers that each row loses."""
    head = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.row_key().alias("key"), F.col("text").cast("string").alias("text"))
    leaves = common.materialize(head.select("key", "text").mapInArrow(_leaves(least_tokens, depth, recurs), "key long, leaves array<struct<leaf: long, lo: long, hi: long, need: long>>"), "line-leaves")
    posted = leaves.dropDuplicates(["key"]).select("key", F.inline("leaves"))
    shared = (posted.groupBy("leaf").agg(F.count(F.lit(1)).alias("docs"), (F.min("lo") == F.max("hi")).alias("alone"), F.max("need").alias("need"))
              .filter(F.col("docs") >= F.col("need")).select("leaf", "alone"))
    shared = common.materialize(shared, "line-shared")  # a plain side, as below
    hot = posted.select("key", "leaf").join(shared, "leaf").groupBy("key").agg(F.collect_list(F.struct("leaf", "alone")).alias("hot"))
    lines = (head.join(hot, "key").dropDuplicates(["key"]).select("doc_id", "key", "text", "hot")
             .mapInArrow(_hot_lines(least_tokens, depth), "doc_id long, key long, leaf long, line long, places array<int>, fields array<long>, again array<struct<at: int, field: long, times: long>>"))
    lines = common.materialize(lines, "line-hot")
    # the distinct masked lines of a leaf, with the number of documents that hold each
    kinds = lines.filter("fields is not null").groupBy("leaf", "line").agg(F.count(F.lit(1)).alias("docs"), F.min("fields").alias("fields"))
    kinds = common.materialize(kinds, "line-kinds")
    fields = kinds.select("leaf", "line", "docs", F.posexplode("fields").alias("at", "field"))
    # a document counts once for a field, however many of its lines have it
    less = lines.select("leaf", F.inline("again")).select("leaf", "at", "field", (-F.col("times")).alias("docs"))
    fixed = (fields.select("leaf", "at", "field", "docs").unionByName(less).groupBy("leaf", "at", "field").agg(F.sum("docs").alias("n"))
             .filter(F.col("n") >= min(recurs, min_docs)))
    fixed = common.materialize(fixed, "line-fixed")  # a field that most lines of a leaf share is then a key that Spark can split
    place = F.struct("at", "field")
    tokens = F.col("tokens")
    templates = (fields.join(fixed, ["leaf", "at", "field"]).groupBy("leaf", "line")
                 .agg(F.sort_array(F.collect_list(F.when(F.col("n") >= min_docs, place))).alias("fixed"), F.sort_array(F.collect_list(place)).alias("close"),
                      F.sum((F.col("at") >= depth).cast("int")).alias("behind"))
                 .join(kinds.select("leaf", "line", F.size("fields").alias("tokens")), ["leaf", "line"])
                 .withColumn("held", F.when(F.size("fixed") >= tokens * constant, F.col("fixed")).when(F.col("behind") >= (tokens - depth) * constant, F.col("close")))
                 .filter("held is not null").select("leaf", "line", F.xxhash64("leaf", "held").alias("template")))
    templates = common.materialize(templates, "line-templates")
    found = lines.filter("fields is not null").join(templates, ["leaf", "line"]).select("template", "key", "doc_id", "places")
    found = found.unionByName(lines.filter("fields is null").select(F.xxhash64("leaf", "line").alias("template"), "key", "doc_id", "places"))
    found = common.materialize(found, "line-found")
    place = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "key", F.array_min("places").alias("line"))
    first = (found.groupBy("template", "key").agg(F.min(place).alias("first")).groupBy("template")
             .agg(F.count(F.lit(1)).alias("docs"), F.min("first").alias("first")).filter(F.col("docs") >= recurs))
    # written, so that the join has two plain sides and Spark can split a template that most documents share
    first = common.materialize(first.select(F.col("template").alias("_t"), F.col("first.key").alias("_key"), F.col("first.line").alias("_line")), "line-first")
    gone = found.join(first, F.col("template") == F.col("_t")).select(
        "key", F.explode("places").alias("line"), "_key", "_line").filter((F.col("key") != F.col("_key")) | (F.col("line") != F.col("_line")))
    return gone.groupBy("key").agg(F.collect_list("line").alias("drop"))


def dedup(docs: DataFrame, min_docs: int = 3, depth: int = 3, constant: float = 0.6, least_tokens: int = 5, recurs: int = 2) -> DataFrame:
    """The rows of ``docs`` with recurring lines taken out of ``text``, and two columns behind: the
    lines, ``_n_lines``, and those dropped, ``_n_dropped`` (with more underscores where ``docs`` has these names)."""
    drop = recurring(docs, min_docs, depth, constant, least_tokens, recurs).select(F.col("key").alias("gone_key"), "drop")
    names = docs.columns
    quoted = [F.col("`" + n.replace("`", "``") + "`") for n in names]
    # the caller's row travels as one column, so that no name of its meets those of the join
    rows = docs.select(F.struct(*quoted).alias("row"), common.row_key().alias("key"))
    joined = rows.join(drop, F.col("key") == F.col("gone_key"), "left").select("row", "drop")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, n_lines, n_dropped = [], [], []
            cols = dict(zip(names, b.column("row").flatten(), strict=True))
            for text, drop in zip(texts.as_bytes(cols["text"]), b.column("drop").to_pylist(), strict=True):
                lines = [] if text is None else text.split(b"\n")
                gone = set(drop or ())
                kept.append(text if not gone else b"\n".join([x for i, x in enumerate(lines) if i not in gone]))
                n_lines.append(len(lines))
                n_dropped.append(len(gone))
            cols["text"] = pa.array(kept, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*cols.values(), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], added.names)

    taken = {n.lower() for n in names}
    counts = []
    for name in ("_n_lines", "_n_dropped"):
        while name in taken:
            name = f"_{name}"
        counts.append(T.StructField(name, T.LongType()))
    added = T.StructType([*docs.schema.fields, *counts])
    return joined.mapInArrow(run, added)


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"),
                      F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))
