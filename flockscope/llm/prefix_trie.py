"""Prefix trie of conversations (operator 11).

A turn is told by two 64-bit hashes of role and text, so texts are read once and never
shuffled.  A prefix is named by the exclusive or of its turns' hashes salted with their
places: 128 bits that a window can run over, in slices, so that a conversation of any
length is spread over tasks.

Prefixes with more than ``shard_rows`` rows below them are the heavy upper levels; every
other subtree is a shard, small by definition.  Tasks gather shards into forests and
build each as a succinct level-order trie: numpy lays down a LOUDS bit vector and label
arrays level by level, parents are read off the bit vector, and one pass over the levels
in reverse adds counts, leaves and savings to the parents with ``np.add.at``.  The upper
levels take the shards' sums and add up among themselves by doubling: after round k a
node holds what lies less than 2^k below it.

The SHA-256 of a heavy node's ends is a chain, so one task reads that node's ids, but as
packed runs of ``RUN`` ids, streamed in order; ids are sorted and packed range by range.

Defined results: null roles and texts are empty; turns are ordered with null first, equal
turns by a hash of role and text, and repeated rows are turns of their own; rows without
a conv_id belong to no conversation and are left out; an empty table gives an empty
result; columns other than conv_id, turn, role and text are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: Turns of one conversation that a window ranks in one piece.
SLICE = 4096
#: Ids of a heavy node's ends that travel as one row.
RUN = 512
#: Rows that a task gathers before it builds their forest.
FOREST = 100_000
EMPTY = hashlib.sha256(b"").hexdigest()

NODES = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
         "ends_sha256 string")


# succinct tries

class Louds:
    """A level-order unary degree sequence: for each node, level by level, a one a child and then a zero.

    Node 0 is the root; the i-th one belongs to node i.  ``starts`` are the levels' first nodes."""

    def __init__(self, degrees: np.ndarray, starts: np.ndarray):
        self.n = len(degrees)
        bits = np.ones(2 * self.n - 1, bool)
        bits[np.cumsum(degrees + 1) - 1] = False
        self.bits = np.packbits(bits)
        self.starts = starts

    def flags(self) -> np.ndarray:
        return np.unpackbits(self.bits, count=2 * self.n - 1).astype(bool)

    def parents(self) -> np.ndarray:
        """Each node's parent, by the zeros before its one; the root's is -1."""
        bits = self.flags()
        return np.concatenate(([-1], np.cumsum(~bits)[bits]))

    def degrees(self) -> np.ndarray:
        return np.diff(np.flatnonzero(~self.flags()), prepend=-1) - 1

    def rollup(self, *values: np.ndarray) -> None:
        """Adds every node's values to its parent's, from the last level up."""
        parent = self.parents()
        for a, b in zip(self.starts[-2:0:-1], self.starts[:1:-1], strict=True):
            for v in values:
                np.add.at(v, parent[a:b], v[a:b])


def build(member: np.ndarray, level: np.ndarray, labels: np.ndarray) -> tuple[Louds, np.ndarray, np.ndarray]:
    """The trie of sequences given as rows (member, level from 1, label pair), its label array and each row's node."""
    order = np.argsort(level, kind="stable")
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(level[order])) + 1, [len(order)])) if len(order) else np.zeros(1, np.int64)
    at = np.zeros(int(member.max()) + 1 if len(member) else 0, np.int64)
    node_of, starts, kept, parents = np.zeros(len(order), np.int64), [0, 1], [np.zeros((1, 2), np.int64)], []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        rows = order[a:b]
        above = at[member[rows]]
        by = np.lexsort((labels[rows, 1], labels[rows, 0], above))
        rows, above = rows[by], above[by]
        new = np.ones(len(rows), bool)
        new[1:] = (above[1:] != above[:-1]) | (labels[rows[1:]] != labels[rows[:-1]]).any(axis=1)
        node = starts[-1] + np.cumsum(new) - 1
        node_of[rows] = at[member[rows]] = node
        parents.append(above[new])
        kept.append(labels[rows[new]])
        starts.append(int(node[-1]) + 1)
    degrees = np.bincount(np.concatenate(parents), minlength=starts[-1]) if parents else np.zeros(1, np.int64)
    return Louds(degrees, np.array(starts)), np.concatenate(kept), node_of


def forest(rows: pd.DataFrame) -> pd.DataFrame:
    """The nodes of the shards in ``rows``, whole ones only."""
    member, ids = pd.factorize(rows["conv_id"], sort=True)
    ids = ids.to_numpy(np.int64)
    level = (rows["pos"] - rows["above"]).to_numpy(np.int64)
    # shards hang side by side under a root of their own, told by their keys
    labels = np.where(level[:, None] == 1, rows[["s1", "s2"]].to_numpy(np.int64), rows[["q1", "q2"]].to_numpy(np.int64))
    trie, _, node = build(member, level, labels)
    parent, degrees = trie.parents(), trie.degrees()
    n_bytes, depth, up = (np.zeros(trie.n, np.int64) for _ in range(3))
    for out, name in ((n_bytes, "n_bytes"), (depth, "pos"), (up, "up_conv")):
        out[node] = rows[name].to_numpy(np.int64)
    u1, u2 = (np.zeros(trie.n, np.int64) for _ in range(2))
    u1[node], u2[node] = rows["u1"].to_numpy(np.int64), rows["u2"].to_numpy(np.int64)
    lowest = np.full(trie.n, np.iinfo(np.int64).max)
    np.minimum.at(lowest, node, ids[member])
    last = (rows["pos"] == rows["total"]).to_numpy()
    counts = np.bincount(node[last], minlength=trie.n)
    leaves = (degrees == 0).astype(np.int64)
    trie.rollup(counts, leaves)
    saved = (counts - 1) * n_bytes
    saved[0] = 0
    trie.rollup(saved)
    ends = np.full(trie.n, EMPTY, object)
    by = np.lexsort((ids[member][last], node[last]))
    closing, who = node[last][by], ids[member][last][by].astype(str)
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(closing)) + 1, [len(closing)])) if len(closing) else np.zeros(1, np.int64)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        ends[closing[a]] = hashlib.sha256(",".join(who[a:b]).encode()).hexdigest()
    top = parent == 0
    out = pd.DataFrame({"conv_id": lowest, "depth": depth, "parent_conv_id": np.where(top, up, lowest[np.maximum(parent, 0)]), "n_convs": counts,
                        "n_children": degrees, "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": ends, "u1": u1, "u2": u2, "top": top})
    return out.iloc[1:]


def _forests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Forests of whole shards; rows come sorted by shard, and the last shard waits until it is whole."""
    held: list[pd.DataFrame] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size >= FOREST:
            rows = pd.concat(held, ignore_index=True)
            last = rows[["s1", "s2"]].iloc[-1]
            whole = int(((rows["s1"] == last["s1"]) & (rows["s2"] == last["s2"])).to_numpy().argmax())
            if whole:
                yield forest(rows.iloc[:whole])
            held, size = [rows.iloc[whole:]], len(rows) - whole
    if size:
        yield forest(pd.concat(held, ignore_index=True))


# sequences

def _running(df: DataFrame, cut: Column, order: list[Column], aggs: dict[str, Column], label: str) -> DataFrame:
    """Adds running aggregates by conversation, of slices and then over the slices before; ``aggs`` give 0 for nothing."""
    sliced = df.withColumn("_cut", cut)
    inside = Window.partitionBy("conv_id", "_cut").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("_conv").orderBy(F.col("_at").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    sums = sliced.groupBy(F.col("conv_id").alias("_conv"), F.col("_cut").alias("_at")).agg(*[a.alias(n) for n, a in aggs.items()])
    over = {n: (F.bit_xor(n) if n != "pos" else F.sum(n)).over(before) for n in aggs}
    # most conversations have one slice and nothing before it
    starts = common.materialize(sums.select("_conv", "_at", *[o.alias(f"_{n}") for n, o in over.items()])
                                .filter(F.col(f"_{next(iter(aggs))}").isNotNull()), label)
    out = sliced.select(*sliced.columns, *[a.over(inside).alias(n) for n, a in aggs.items()])
    out = out.join(starts, (F.col("conv_id") == F.col("_conv")) & F.col("_cut").eqNullSafe(F.col("_at")), "left")
    add = lambda n: F.col(n).bitwiseXOR(F.coalesce(f"_{n}", F.lit(0))) if n != "pos" else F.col(n) + F.coalesce(f"_{n}", F.lit(0))
    return out.select(*df.columns, *[add(n).cast("long").alias(n) for n in aggs])


def turns(conversations: DataFrame) -> DataFrame:
    """Numbered turns without their texts: conv_id, l1, l2, n_bytes, pos from 1."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    hashed = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.xxhash64(role, text).alias("l1"),
        F.xxhash64(F.lit(17), text, role).alias("l2"), F.octet_length(text).cast("long").alias("n_bytes"))
    hashed = common.materialize(hashed, "trie-turns")
    order = [F.col("turn").asc_nulls_first(), F.col("l1"), F.col("l2")]
    out = _running(hashed, F.floor(F.col("turn") / SLICE), order, {"pos": F.count(F.lit(1))}, "trie-starts")
    return common.materialize(out.drop("turn"), "trie-ranks")


def whole(ranked: DataFrame) -> DataFrame:
    """The conversations as they stand, with the root's row at place 0: conv_id, pos, total, l1, l2, n_bytes."""
    totals = common.materialize(ranked.groupBy("conv_id").agg(F.max("pos").alias("total")), "trie-totals")
    rows = ranked.join(totals, "conv_id").select("conv_id", "pos", "total", "l1", "l2", "n_bytes")
    return rows.unionByName(_roots(totals))


def _roots(totals: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("long")
    return totals.select("conv_id", zero.alias("pos"), "total", zero.alias("l1"), zero.alias("l2"), zero.alias("n_bytes"))


def rebuilt(ranked: DataFrame, every: int = 5, most: int = 9) -> DataFrame:
    """Conversations with the first h turns of conversation c - c % every before their own after the first h; h = crc32(c) % most.

    The result is like that of ``whole``.  At most ``most`` - 1 turns of a conversation are copied, to at most ``every`` - 1 others
    (twice that where ids below zero meet at 0)."""
    base = F.col("conv_id") - F.col("conv_id") % every
    sizes = common.materialize(ranked.groupBy("conv_id").agg(F.max("pos").alias("n")), "trie-sizes")
    other = sizes.select(F.col("conv_id").alias("b"), F.col("n").alias("m"))
    h = F.when(F.col("conv_id") % every == 0, 0).otherwise(F.crc32(F.col("conv_id").cast("string").cast("binary")) % most)
    plan = sizes.withColumn("base", base).withColumn("h", h.cast("long")).join(other, F.col("base") == F.col("b"), "left")
    plan = plan.withColumn("lead", F.least("h", F.coalesce("m", F.lit(0))))
    plan = common.materialize(plan.select(F.col("conv_id").alias("c"), "base", "h", "lead",
                                          (F.col("lead") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).cast("long").alias("total")), "trie-plan")
    own = ranked.join(plan, F.col("conv_id") == F.col("c")).filter("pos > h")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("lead")).alias("pos"), "total", "l1", "l2", "n_bytes")
    copied = (ranked.filter((F.col("conv_id") % every == 0) & (F.col("pos") < most))
              .join(plan.filter("lead > 0"), (F.col("conv_id") == F.col("base")) & (F.col("pos") <= F.col("lead"))))
    copied = copied.select(F.col("c").alias("conv_id"), "pos", "total", "l1", "l2", "n_bytes")
    return own.unionByName(copied).unionByName(_roots(plan.withColumnRenamed("c", "conv_id")))


# the trie

def trie(rows: DataFrame, shard_rows: int = 256) -> DataFrame:
    """The nodes of the trie over ``rows`` as ``whole`` or ``rebuilt`` give them."""
    spot = F.col("pos") > 0
    rows = rows.select("conv_id", "pos", "total", "n_bytes", F.when(spot, F.xxhash64("l1", "l2", "pos")).otherwise(0).alias("q1"),
                       F.when(spot, F.xxhash64("pos", "l2", "l1", F.lit(9))).otherwise(0).alias("q2"))
    rows = common.materialize(rows, "trie-salted")
    rows = _running(rows, F.floor(F.col("pos") / SLICE), [F.col("pos")], {"p1": F.bit_xor("q1"), "p2": F.bit_xor("q2")}, "trie-before")
    rows = common.materialize(rows, "trie-rows")

    upper = rows.groupBy("p1", "p2", F.col("pos").alias("depth")).agg(
        F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("low"), F.sum(F.col("total") - F.col("pos") + 1).alias("below"),
        F.min("n_bytes").alias("bytes"), F.min(F.col("p1").bitwiseXOR(F.col("q1"))).alias("o1"), F.min(F.col("p2").bitwiseXOR(F.col("q2"))).alias("o2"))
    upper = common.materialize(upper.filter((F.col("depth") == 0) | (F.col("below") > shard_rows)), "trie-upper")

    names = upper.select(F.col("p1").alias("h1"), F.col("p2").alias("h2"), F.col("depth").alias("at"), "low")
    marked = rows.join(names, (F.col("p1") == F.col("h1")) & (F.col("p2") == F.col("h2")) & (F.col("pos") == F.col("at")), "left")
    marked = common.materialize(marked.drop("h1", "h2"), "trie-marked")
    light = F.col("at").isNull()
    where = marked.groupBy(F.col("conv_id").alias("c")).agg(
        F.max(F.when(~light, F.struct("pos", "p1", "p2", "low"))).alias("u"), F.min(F.when(light, F.struct("pos", "p1", "p2"))).alias("s"))
    where = common.materialize(where.filter("s is not null").select(
        "c", F.col("u.pos").alias("above"), F.col("u.p1").alias("u1"), F.col("u.p2").alias("u2"), F.col("u.low").alias("up_conv"),
        F.col("s.p1").alias("s1"), F.col("s.p2").alias("s2")), "trie-where")
    shards = marked.filter(light).join(where, F.col("conv_id") == F.col("c")).select(
        "s1", "s2", "u1", "u2", "up_conv", "above", "conv_id", "pos", "total", "n_bytes", "q1", "q2")
    small = (shards.repartition("s1", "s2").sortWithinPartitions("s1", "s2")
             .mapInPandas(_forests, f"{NODES}, u1 long, u2 long, top boolean"))
    small = common.materialize(small, "trie-small")
    large = _upper_levels(upper, small.filter("top"), marked.filter(~light & (F.col("pos") == F.col("total"))))
    return small.select(*large.columns).unionByName(large)


def _upper_levels(upper: DataFrame, tops: DataFrame, ends: DataFrame) -> DataFrame:
    """The heavy nodes, with the sums of the shards below them and of each other."""
    hung = tops.groupBy(F.col("u1").alias("k1"), F.col("u2").alias("k2")).agg(
        F.count(F.lit(1)).alias("shards"), F.sum("n_leaves").alias("under"), F.sum("saved_tokens").alias("spared"))
    heads = upper.filter("depth > 0").groupBy(F.col("o1").alias("f1"), F.col("o2").alias("f2")).agg(F.count(F.lit(1)).alias("heads"))
    none = lambda c: F.coalesce(c, F.lit(0))
    t = (upper.join(common.materialize(hung, "trie-hung"), (F.col("p1") == F.col("k1")) & (F.col("p2") == F.col("k2")), "left")
         .join(common.materialize(heads, "trie-heads"), (F.col("p1") == F.col("f1")) & (F.col("p2") == F.col("f2")), "left"))
    t = t.withColumn("n_children", none("shards") + none("heads"))
    t = t.select("p1", "p2", "depth", "n", "low", "o1", "o2", "n_children",
                 F.when(F.col("n_children") == 0, 1).otherwise(none("under")).cast("long").alias("leaves"),
                 (none("spared") + F.when(F.col("depth") > 0, (F.col("n") - 1) * F.col("bytes")).otherwise(0)).alias("saved"))
    t = common.materialize(t, "trie-nodes")
    # sums over subtrees by doubling: j is the ancestor 2^k levels up, if there is one
    s = t.select("p1", "p2", F.when(F.col("depth") > 0, F.struct(F.col("o1").alias("a"), F.col("o2").alias("b"))).alias("j"), "leaves", "saved")
    while not s.filter("j is not null").isEmpty():
        gain = s.filter("j is not null").groupBy("j").agg(F.sum("leaves").alias("more"), F.sum("saved").alias("spare"))
        gain = common.materialize(gain.select(F.col("j.a").alias("g1"), F.col("j.b").alias("g2"), "more", "spare"), "trie-gain")
        hop = common.materialize(s.select(F.col("p1").alias("n1"), F.col("p2").alias("n2"), F.col("j").alias("next")), "trie-hop")
        s = (s.join(gain, (F.col("p1") == F.col("g1")) & (F.col("p2") == F.col("g2")), "left")
             .join(hop, (F.col("j.a") == F.col("n1")) & (F.col("j.b") == F.col("n2")), "left")
             .select("p1", "p2", F.col("next").alias("j"), (F.col("leaves") + none("more")).alias("leaves"), (F.col("saved") + none("spare")).alias("saved")))
        s = common.materialize(s, "trie-doubled")
    s = s.select(F.col("p1").alias("x1"), F.col("p2").alias("x2"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    mother = upper.select(F.col("p1").alias("m1"), F.col("p2").alias("m2"), F.col("low").alias("mother"))
    digest = _digests(ends)
    out = (t.join(s, (F.col("p1") == F.col("x1")) & (F.col("p2") == F.col("x2")))
           .join(mother, (F.col("o1") == F.col("m1")) & (F.col("o2") == F.col("m2")), "left")
           .join(digest, (F.col("p1") == F.col("d1")) & (F.col("p2") == F.col("d2")), "left"))
    return out.select(F.col("low").alias("conv_id"), "depth", F.when(F.col("depth") > 0, F.col("mother")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
                      F.col("n_children").cast("long").alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("sha", F.lit(EMPTY)).alias("ends_sha256"))


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        p1, p2, ids = (rows[c].to_numpy(np.int64) for c in ("p1", "p2", "conv_id"))
        change = np.flatnonzero((np.diff(p1) != 0) | (np.diff(p2) != 0)) + 1
        cuts = [0, *change.tolist(), len(ids)] if len(ids) else [0]
        out = [(p1[a], p2[a], ids[i], ",".join(map(str, ids[i : min(i + RUN, b)].tolist())))
               for a, b in zip(cuts[:-1], cuts[1:], strict=True) for i in range(a, b, RUN)]
        yield pd.DataFrame(out, columns=["p1", "p2", "first", "ids"])


def _chained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    key, chain = None, None
    for rows in batches:
        out = []
        for p1, p2, ids in zip(rows["p1"], rows["p2"], rows["ids"], strict=True):
            if (p1, p2) != key:
                if chain is not None:
                    out.append((*key, chain.hexdigest()))
                key, chain = (p1, p2), hashlib.sha256(ids.encode())
            else:
                chain.update(b"," + ids.encode())
        yield pd.DataFrame(out, columns=["d1", "d2", "sha"])
    if chain is not None:
        yield pd.DataFrame([(*key, chain.hexdigest())], columns=["d1", "d2", "sha"])


def _digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of each node's ids in ascending order; ids are sorted range by range and meet as packed runs."""
    runs = (ends.select("p1", "p2", "conv_id").repartitionByRange("p1", "p2", "conv_id").sortWithinPartitions("p1", "p2", "conv_id")
            .mapInPandas(_packed, "p1 long, p2 long, first long, ids string"))
    done = runs.repartition("p1", "p2").sortWithinPartitions("p1", "p2", "first").mapInPandas(_chained, "d1 long, d2 long, sha string")
    return common.materialize(done, "trie-digests")


def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations."""
    return trie(rebuilt(turns(common.table(spark, sf_dir, "conversations"))))


_CRC = ("xor(list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: [ord(ch)::BIGINT, 0, 0, 0, 0, 0, 0, 0])), "
        "lambda a, x: xor(xor(a, x) >> 1, 3988292384::BIGINT * (xor(a, x) & 1))), 4294967295::BIGINT)")

OP11_SQL = f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, ({_CRC} % 9)::BIGINT AS h, conv_id - conv_id % 5 AS base FROM (SELECT DISTINCT conv_id FROM t)),
s AS (SELECT c.conv_id, 0 AS part, t.pos, role, text FROM c JOIN t ON t.conv_id = c.base AND t.pos <= c.h
  UNION ALL SELECT c.conv_id, 1, t.pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h),
l AS (SELECT c.conv_id, coalesce(list({{'role': role, 'text': text}} ORDER BY part, pos) FILTER (pos IS NOT NULL), []) AS ts
  FROM c LEFT JOIN s ON s.conv_id = c.conv_id GROUP BY c.conv_id),
p AS (SELECT conv_id, len(ts) AS total, unnest(range(0, len(ts) + 1)) AS depth, ts FROM l),
q AS (SELECT conv_id, total, depth, ts[1:depth] AS k FROM p),
n AS (SELECT k, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (total = depth), '') AS ids,
    CASE WHEN depth = 0 THEN 0 ELSE (count(*) - 1) * octet_length(encode(k[-1].text)) END AS own FROM q GROUP BY k, depth),
ch AS (SELECT k[1:depth - 1] AS k, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN ch ON ch.k = n.k),
up AS (SELECT k[1:d] AS k, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(own) AS saved
  FROM (SELECT k, n_children, own, unnest(range(0, depth + 1)) AS d FROM m) GROUP BY 1)
SELECT m.conv_id::BIGINT AS conv_id, m.depth::BIGINT AS depth, mo.conv_id::BIGINT AS parent_conv_id, m.n_convs::BIGINT AS n_convs,
  m.n_children::BIGINT AS n_children, up.n_leaves::BIGINT AS n_leaves, up.saved::BIGINT AS saved_tokens, sha256(m.ids) AS ends_sha256
FROM m JOIN up ON up.k = m.k LEFT JOIN m mo ON m.depth > 0 AND mo.k = m.k[1:m.depth - 1]
"""
