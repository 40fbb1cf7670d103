"""N-gram Jaccard self-join by token-combination prefixes (operator 4).

A document is the set of its distinct shingles (its tokens).  Two sets link when their
Jaccard similarity reaches ``percent`` / 100; results are components of links.

Every set of n tokens shares at least o = ceil(percent * n / 100) of them with any
partner, so under any order of tokens common to all sets, partners share a token among
their first p = n - o + 1 (the prefix), and two tokens among the first p + 1.  The order
is: first the tokens of a hashed share ``sampled`` of the universe, rare ones first, then
the others by hash.  As the share exceeds that of a prefix, only sampled tokens and the
few that fill up short prefixes need counting, and a set of which p tokens or more are in
no other set is done with.

Prefix tokens are indexed singly.  Of each posting list all members are verified against a
leader, the set with fewest tokens of its own; that costs no more than the list's length and
mostly joins a group of copies at once.  The sets of lists that still span several components
are ordered anew, by the document frequency of all their tokens among them, which puts what
tells copies apart in front, and their lists have leaders again.

Sets x and y need o = ceil(percent * (|x| + |y|) / (100 + percent)) common tokens, so the
first common one is at most at place |x| - o of x and |y| - o of y, and each later one a place
further.  In the new order lists are keyed by a token, and where that is frequent - the members
outside the list's largest component times all of them exceed ``frequent`` squared - by the
combinations of it with each later token of the prefix, one token more each turn and up to
``most`` of them.  Of a list, members outside the largest component meet the others, and a pair
is made only if the key holds the first tokens that both share and their components differ.

Equal sets are collapsed first.  Defined results: null and empty texts and texts without
words have the empty set and link with nothing; fewer words than a shingle form one token;
rows of one doc_id are one node; rows without an id link with nothing and have a null
component; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, texts

SETS = "doc_id long, key long, n int, n0 int, set_hash binary, tokens array<long>"


def shingles(text: bytes | None, k: int) -> np.ndarray:
    """The distinct 64-bit tokens of a text, in ascending order."""
    import xxhash

    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.array(list(map(xxhash.xxh3_64_intdigest, words)), np.uint64)
    if len(words) < k:
        return texts.windows(hashes, len(words)) ^ np.uint64(len(words))
    return np.unique(texts.windows(hashes, k))


def least_overlap(n: Column | int, percent: int):
    return (n * percent + 99) / 100 if isinstance(n, int) else F.ceil(n * F.lit(percent) / 100)


def token_sets(docs: DataFrame, k: int, percent: int, sampled: float | None) -> DataFrame:
    """Each row's set: its size, a 128-bit hash of it, and its tokens: all, or those sampled
    and as many as the extended prefix needs (the first n0 are the sampled ones)."""
    limit = np.uint64(int((sampled or 0) * 2**64)) if sampled else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            whole = texts.as_bytes(b.column("text"))
            for lo, hi in texts.slices(whole):
                n, n0, digest, tokens = [], [], [], []
                for text in whole[lo:hi]:
                    s = shingles(text, k)
                    n.append(len(s))
                    digest.append(xxhash.xxh3_128_digest(s.tobytes()))
                    n0.append(len(s) if limit is None else int(np.searchsorted(s, limit)))
                    need = len(s) - (len(s) * percent + 99) // 100 + 2
                    tokens.append((s if limit is None else s[: max(n0[-1], need)]).view(np.int64))
                ends = np.cumsum([0, *(len(t) for t in tokens)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*tokens, np.zeros(0, np.int64)])))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), b.column("key").slice(lo, hi - lo), pa.array(n, pa.int32()),
                                                  pa.array(n0, pa.int32()), pa.array(digest, pa.binary()), lists], ["doc_id", "key", "n", "n0", "set_hash", "tokens"])

    return docs.select("doc_id", "key", "text").mapInArrow(run, SETS)


def compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with their sizes and whether they link."""
    left = sets.select(F.col("rid").alias("a"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("rid").alias("b"), F.col("tokens").alias("tb"))
    out = pairs.join(left, "a").join(right, "b").select("a", "b", F.size("ta").alias("na"), F.size("tb").alias("nb"), F.size(F.array_intersect("ta", "tb")).alias("common"))
    return out.withColumn("linked", F.col("common") * 100 >= (F.col("na") + F.col("nb") - F.col("common")) * percent)


def first_common(ax: str, nx: str, ay: str, ny: str, percent: int, k: int) -> Column:
    """Whether a token at these places can be the k-th that sets of these sizes share, if they link."""
    least = F.ceil((F.col(nx) + F.col(ny)) * percent / F.lit(100 + percent)) - F.lit(k)
    return (F.col(ax) < F.col(nx) - least) & (F.col(ay) < F.col(ny) - least)


def near_sizes(x: str, y: str, percent: int) -> Column:
    return (F.col(x) * 100 >= F.col(y) * percent) & (F.col(y) * 100 >= F.col(x) * percent)


def join_sets(docs: DataFrame, k: int = 4, percent: int = 85, sampled: float = 0.18, frequent: int = 1024, most: int = 4) -> DataFrame:
    """Per row of ``docs``: doc_id, key, n_shingles and component_id."""
    head = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.row_key().alias("key"), F.col("text").cast("string").alias("text"))
    sets = common.materialize(token_sets(head, k, percent, sampled).withColumn("rid", F.monotonically_increasing_id()), "ngram-sets")
    live = sets.filter("n > 0 and doc_id is not null")
    # equal sets: one row stands for all, the others are linked to it
    stands = common.materialize(live.groupBy("set_hash").agg(F.min(F.struct("doc_id", "rid")).alias("m"), F.count(F.lit(1)).alias("rows"))
                                .select("set_hash", F.col("m.rid").alias("rid"), F.col("m.doc_id").alias("rep"), "rows"), "ngram-reps")
    copies = (live.select("set_hash", "doc_id").join(stands.filter("rows > 1").select("set_hash", "rep"), "set_hash")
              .select(F.col("doc_id").alias("src"), F.col("rep").alias("dst")).filter("src <> dst"))
    # which tokens are in more than one row, counted over all rows
    posted = live.select("rid", F.explode("tokens").alias("token"))
    shared = common.materialize(posted.groupBy("token").count().filter("count > 1"), "ngram-shared")
    found = posted.join(shared, "token").groupBy("rid").agg(F.sort_array(F.collect_list(F.struct(F.col("count").alias("df"), "token"))).alias("shared"))
    # sets whose prefix is not all their own, by their representatives
    prefix = F.col("n") - least_overlap(F.col("n"), percent) + 1
    near = (live.select("rid", "key", "doc_id", "n", "n0", F.size("tokens").alias("held")).join(stands.select("rid"), "rid")
            .join(found, "rid").withColumn("prefix", prefix.cast("int")).filter(F.col("held") - F.size("shared") < F.col("prefix")))
    near = common.materialize(near, "ngram-near")
    # where each shared token stands in the order: unshared sampled ones come first, then the sampled by
    # count; tokens that are not sampled have their place by hash, after all sampled ones
    cut = int(np.uint64(int(sampled * 2**64)).astype(np.int64))
    in_sample = lambda t: (t >= 0) & (t < cut) if cut >= 0 else (t >= 0) | (t < cut)
    ranked = near.withColumn("s0", F.filter("shared", lambda x: in_sample(x["token"])))
    tail = F.filter("shared", lambda x: ~in_sample(x["token"]))
    own = (F.col("held") - F.size("shared")).alias("own")
    head_rows = ranked.select("rid", own, "n", "prefix", F.posexplode(F.transform("s0", lambda x: x["token"])).alias("i", "token"), (F.col("n0") - F.size("s0")).alias("before"))
    head_rows = head_rows.select("rid", "own", "n", "prefix", "token", (F.col("before") + F.col("i")).alias("at"))
    # a place after the sampled ones is at least n0; counting only shared ones before it errs to the safe side
    tail_rows = ranked.select("rid", own, "n", "prefix", F.posexplode(F.transform(tail, lambda x: x["token"])).alias("i", "token"), "n0")
    tail_rows = tail_rows.select("rid", "own", "n", "prefix", "token", F.col("n0").alias("at"))
    index = head_rows.unionByName(tail_rows).filter("at <= prefix")
    # the first common token with a partner of the same size or larger stands before this place
    same_size = F.ceil(F.col("n") * (2 * percent) / F.lit(100 + percent))
    index = common.materialize(index.withColumn("small", F.col("at") <= F.col("n") - same_size), "ngram-index")
    posting = index.filter("at < prefix")
    lead = F.min(F.struct("own", F.xxhash64("rid").alias("h"), "rid", "n"))
    lists = posting.groupBy("token").agg(F.count(F.lit(1)).alias("size"), lead.alias("lead"), F.bool_or("small").alias("small")).filter("size > 1 and small")
    lists = common.materialize(lists.select("token", "size", F.col("lead.rid").alias("a"), F.col("lead.n").alias("na")), "ngram-lists")
    members = posting.select("token", F.col("rid").alias("b"), F.col("n").alias("nb"))
    stars = lists.join(members, "token").filter((F.col("a") != F.col("b")) & near_sizes("na", "nb", percent)).select("a", "b").distinct()
    stars = common.materialize(stars, "ngram-stars")
    # whole sets of those that are in a list
    wanted = posting.join(lists.select("token"), "token", "left_semi").select("rid").distinct()
    texts_of = head.join(near.join(wanted, "rid", "left_semi").select("key", "rid").dropDuplicates(["key"]), "key")
    full = common.materialize(
        texts_of.select("doc_id", F.col("rid").alias("key"), "text").transform(lambda d: token_sets(d, k, percent, None))
        .select(F.col("key").alias("rid"), "tokens").dropDuplicates(["rid"]), "ngram-full")
    links = common.materialize(compared(stars, full, percent).filter("linked").select("a", "b"), "ngram-links-1")

    # sets of lists that span several components; a list of two is done with when its leader is
    comp = _placed(links, "ngram-first")
    placed = common.materialize(posting.join(lists.filter("size > 2").select("token"), "token").join(comp, F.col("rid") == F.col("id"), "left").select(
        "token", "rid", "n", "small", F.coalesce("component_id", "rid").alias("comp")), "ngram-placed")
    ends = placed.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.bool_or("small").alias("any")).filter("lo <> hi and any")
    left = common.materialize(placed.join(common.materialize(ends.select("token"), "ngram-ends"), "token", "left_semi").select("rid", "n").distinct(), "ngram-left")
    order = _ordered(left, full, percent, most)
    keys = common.materialize(_single_keys(order), "ngram-keys-1")
    # leaders again, now those with the fewest rarer tokens before the list's
    lead = F.min(F.struct("at", F.xxhash64("rid").alias("h"), "rid", "n"))
    lists = common.materialize(keys.groupBy("key").agg(F.count(F.lit(1)).alias("size"), lead.alias("lead")).filter("size > 1")
                               .select("key", F.col("lead.rid").alias("a"), F.col("lead.n").alias("na")), "ngram-lists-2")
    met = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
    again = (lists.join(keys.select("key", F.col("rid").alias("b"), F.col("n").alias("nb")), "key").filter((F.col("a") != F.col("b")) & near_sizes("na", "nb", percent))
             .select("a", "b").distinct().join(met, ["a", "b"], "left_anti"))
    again = common.materialize(again, "ngram-stars-2")
    links = common.materialize(links.unionByName(compared(again, full, percent).filter("linked").select("a", "b")), "ngram-links-2")
    comp = _placed(links, "ngram-second")
    keys = keys.join(comp, F.col("rid") == F.col("id"), "left").select("rid", "n", F.coalesce("component_id", "rid").alias("comp"), "key", "at", "before")
    cross = _combined(keys, order, percent, frequent, most)
    met = met.unionByName(again).unionByName(again.select(F.col("b").alias("a"), F.col("a").alias("b")))
    more = common.materialize(compared(cross.join(met, ["a", "b"], "left_anti"), full, percent).filter("linked").select("a", "b"), "ngram-links-3")
    ids = stands.select("rid", "rep")
    named = (links.unionByName(more).join(ids.select(F.col("rid").alias("a"), F.col("rep").alias("src")), "a")
             .join(ids.select(F.col("rid").alias("b"), F.col("rep").alias("dst")), "b").select("src", "dst"))
    final = common.components(common.materialize(named.unionByName(copies), "ngram-edges"), "ngram")
    return (sets.select("doc_id", "key", F.col("n").cast("long").alias("n_shingles")).join(final, F.col("doc_id") == F.col("id"), "left")
            .select("doc_id", "key", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")))


def _placed(links: DataFrame, label: str) -> DataFrame:
    return common.components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")), label)


def _ordered(left: DataFrame, full: DataFrame, percent: int, most: int) -> DataFrame:
    """The sets ``left`` (rid, n) with their prefix and, in the order by document frequency among them, the shared tokens of the extended prefix with their places."""
    prefix = (F.col("n") - least_overlap(F.col("n"), percent) + 1).cast("int")
    posted = full.join(left, "rid").select("rid", F.explode("tokens").alias("token"))
    counts = common.materialize(posted.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "ngram-counts")
    # a set's own tokens come first
    order = (posted.join(counts, "token").groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("shared")).join(left, "rid")
             .withColumn("prefix", prefix).withColumn("own", F.col("n") - F.size("shared")).filter("own < prefix"))
    place = F.transform("shared", lambda x, i: F.struct((F.col("own") + i).alias("at"), x["token"].alias("token")))
    return common.materialize(order.select("rid", "n", "prefix", F.filter(place, lambda x: x["at"] < F.col("prefix") + (most - 1)).alias("pre")), "ngram-order")


def _single_keys(order: DataFrame) -> DataFrame:
    """A row for each token of the prefixes: its place, and the shared tokens before it."""
    base = order.select("rid", "n", "pre", F.explode(F.filter("pre", lambda x: x["at"] < F.col("prefix"))).alias("e"))
    before = F.transform(F.filter("pre", lambda x: x["at"] < F.col("e")["at"]), lambda x: x["token"])
    return base.select("rid", "n", F.col("e.token").alias("key"), F.col("e.at").alias("at"), before.alias("before"))


def _combined(level: DataFrame, order: DataFrame, percent: int, frequent: int, most: int) -> DataFrame:
    """Pairs (a, b) of sets of different components that may link, each once, by keys of one token and more."""
    found: list[DataFrame] = []
    for k in range(1, most + 1):
        level = common.materialize(level, f"ngram-combined-{k}")
        parts = level.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("rows"))
        lists = parts.groupBy("key").agg(F.sum("rows").alias("size"), F.count(F.lit(1)).alias("comps"), F.max(F.struct("rows", "comp")).alias("main")).filter("comps > 1")
        lists = common.materialize(lists.select("key", "size", F.col("main.comp").alias("main"), (F.col("size") * (F.col("size") - F.col("main.rows"))).alias("work")), f"ngram-open-{k}")
        at = common.materialize(level.join(lists, "key").withColumn("large", F.col("work") > (frequent * frequent if k < most else (1 << 62))), f"ngram-at-{k}")
        # pairs that need no more than k common tokens cannot be left to longer keys
        now = at.filter(~F.col("large") | (least_overlap(F.col("n"), percent) <= k))
        x = now.filter("comp <> main").select("key", F.col("rid").alias("x"), F.col("n").alias("nx"), F.col("at").alias("ax"), F.col("comp").alias("cx"), F.col("before").alias("bx"))
        y = now.select("key", F.col("rid").alias("y"), F.col("n").alias("ny"), F.col("at").alias("ay"), F.col("comp").alias("cy"), (F.col("comp") == F.col("main")).alias("inner"),
                       "large", F.col("before").alias("by"))
        meet = ((F.col("cx") != F.col("cy")) & (F.col("inner") | (F.col("x") < F.col("y"))) & near_sizes("nx", "ny", percent)
                & (~F.col("large") | ((F.col("nx") + F.col("ny")) * percent <= k * (100 + percent)))
                & first_common("ax", "nx", "ay", "ny", percent, k) & ~F.arrays_overlap("bx", "by"))
        found.append(common.materialize(x.join(y, "key").filter(meet).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")), f"ngram-pairs-{k}"))
        longer = at.filter("large")
        if k == most or longer.isEmpty():
            break
        # the key with each later token of the prefix, which may stand a place further each turn
        grown = longer.select("rid", "n", "comp", "key", "at", "before").join(order.select("rid", "prefix", "pre"), "rid")
        grown = grown.withColumn("e", F.explode(F.filter("pre", lambda x: (x["at"] > F.col("at")) & (x["at"] < F.col("prefix") + F.lit(k)))))
        between = F.transform(F.filter("pre", lambda x: (x["at"] > F.col("at")) & (x["at"] < F.col("e")["at"])), lambda x: x["token"])
        level = grown.select("rid", "n", "comp", F.xxhash64("key", "e.token").alias("key"), F.col("e.at").alias("at"), F.concat("before", between).alias("before"))
    return common.union_all(found).distinct()


def op4_ngram_join(spark, sf_dir: str) -> DataFrame:
    return join_sets(common.table(spark, sf_dir, "documents")).drop("key")
