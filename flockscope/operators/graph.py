"""Property-graph operators on edge DataFrames (src, dst, ...).

Loops run on the driver only to count rows; each round's tables are checkpointed to
the shared folder, so that lineage stays short and lost executors cost one round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flockscope.sources.shared import settle


def pairs_within(rows: DataFrame, group: str, member: str, block: int = 1024) -> DataFrame:
    """(a, b, group), a < b: all pairs of distinct members of a group.

    A group of more than ``block`` members is cut into blocks by hash, and each pair of blocks
    is a key of its own, so that a very common post or tag is spread over many tasks."""
    e = rows.select(F.col(group).alias("g"), F.col(member).alias("m")).filter("g is not null and m is not null").distinct()
    sizes = e.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    e = e.join(sizes, "g").withColumn("k", F.pmod(F.xxhash64("m"), F.col("blocks")).cast("int"))
    left = e.select("g", F.col("m").alias("a"), F.col("k").alias("x"), F.explode(F.sequence(F.col("k"), F.col("blocks") - 1)).alias("y"))
    right = e.select("g", F.col("m").alias("b"), F.col("k").alias("y"), F.explode(F.sequence(F.lit(0), F.col("k"))).alias("x"))
    met = left.join(right, ["g", "x", "y"]).filter("x < y or a < b")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("g").alias(group))


def projection(edges: DataFrame) -> DataFrame:
    """Pairs of accounts, smaller id first, by the number of posts they both touch: edges(account_id, post_id)."""
    pairs = pairs_within(edges, "post_id", "account_id")
    return pairs.groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.count(F.lit(1)).alias("weight"))


def undirected(edges: DataFrame) -> DataFrame:
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")])
    return edges.unionByName(back)


def connected_components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(id, component): the least id a node is connected with.

    Every round a node takes the least label around it and then its label's label, so
    that labels travel twice as far each time.
    """
    both = settle(undirected(edges.select("src", "dst")).filter("src <> dst").distinct())
    label = settle(nodes.select("id", F.col("id").alias("component")).distinct())
    for _ in range(max_rounds):
        around = both.join(label, F.col("src") == F.col("id")).groupBy(F.col("dst").alias("_n")).agg(F.min("component").alias("_c"))
        step = label.join(around, F.col("id") == F.col("_n"), "left").select("id", "component", F.least("component", F.coalesce("_c", "component")).alias("new"))
        step = settle(step)
        jump = step.select(F.col("id").alias("_j"), F.col("new").alias("_to"))
        nxt = settle(step.join(jump, F.col("new") == F.col("_j")).select("id", F.col("component").alias("old"), F.least("new", "_to").alias("component")))
        if nxt.filter("old <> component").isEmpty():
            return nxt.select("id", "component")
        label = nxt.select("id", "component")
    raise RuntimeError("components did not settle")


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 20, tolerance: float = 1e-7) -> DataFrame:
    """(id, score), un-normalised; an edge's weight counts it so many times; rank of nodes without edges out is lost."""
    out = edges.groupBy("src").agg(F.sum("weight").alias("out"))
    links = settle(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("out")).alias("share")))
    rank = settle(nodes.select("id", F.lit(1.0 - damping).alias("score")).distinct())
    for _ in range(rounds):
        got = links.join(rank, F.col("src") == F.col("id")).groupBy(F.col("dst").alias("_n")).agg(F.sum(F.col("score") * F.col("share")).alias("_in"))
        nxt = settle(rank.join(got, F.col("id") == F.col("_n"), "left").select("id", F.col("score").alias("old"), (F.lit(1.0 - damping) + damping * F.coalesce("_in", F.lit(0.0))).alias("score")))
        rank = nxt.select("id", "score")
        if nxt.filter(F.abs(F.col("score") - F.col("old")) > tolerance).isEmpty():
            break
    return rank


def bfs(edges: DataFrame, roots: DataFrame, hops: int) -> DataFrame:
    """(id, depth) of what ``hops`` undirected steps reach from the roots."""
    both = undirected(edges.select("src", "dst")).distinct()
    seen = settle(roots.select("id", F.lit(0).alias("depth")).distinct())
    front = seen
    for depth in range(1, hops + 1):
        step = front.join(both, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti").withColumn("depth", F.lit(depth))
        front = settle(step)
        if front.isEmpty():
            break
        seen = settle(seen.unionByName(front))
    return seen


def chains(edges: DataFrame, hops: int = 5) -> DataFrame:
    """(root, id, depth) along copies(src the copy, dst the original) from originals that are no copies."""
    roots = edges.select(F.col("dst").alias("id")).distinct().join(edges.select(F.col("src").alias("id")).distinct(), "id", "left_anti")
    level = settle(roots.select(F.col("id").alias("root"), "id"))
    found = []
    for depth in range(1, hops + 1):
        level = settle(level.join(edges.select("src", "dst"), F.col("id") == F.col("dst")).select("root", F.col("src").alias("id")).distinct())
        if level.isEmpty():
            break
        found.append(level.withColumn("depth", F.lit(depth)))
    out = roots.select(F.col("id").alias("root"), "id", F.lit(0).alias("depth")).limit(0)
    for f in found:
        out = out.unionByName(f)
    return out.groupBy("root", "id").agg(F.min("depth").alias("depth"))


def degrees(edges: DataFrame) -> DataFrame:
    return undirected(edges.select("src", "dst")).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))


def _louvain(pairs: dict[int, dict[int, float]], total: float) -> dict[int, int]:
    """Greedy modularity: nodes move in id order until none gains; communities become nodes; and so on."""
    member = {n: [n] for n in pairs}
    graph = {n: dict(to) for n, to in pairs.items()}
    while True:
        community = {n: n for n in graph}
        degree = {n: sum(to.values()) for n, to in graph.items()}
        weight = dict(degree)
        moved, again = False, True
        while again:
            again = False
            for n in sorted(graph):
                own = community[n]
                weight[own] -= degree[n]
                to: dict[int, float] = {own: 0.0}
                for m, w in graph[n].items():
                    if m != n:
                        to[community[m]] = to.get(community[m], 0.0) + w
                best = max(sorted(to), key=lambda c: (to[c] - degree[n] * weight[c] / total, c == own))
                if to[best] - degree[n] * weight[best] / total <= to[own] - degree[n] * weight[own] / total + 1e-12:
                    best = own
                weight[best] += degree[n]
                if best != own:
                    community[n] = best
                    moved = again = True
        if not moved:
            return {x: min(xs) for xs in member.values() for x in xs}
        merged: dict[int, dict[int, float]] = {}
        for n, to in graph.items():
            row = merged.setdefault(community[n], {})
            for m, w in to.items():
                row[community[m]] = row.get(community[m], 0.0) + w
        joined: dict[int, list[int]] = {}
        for n, xs in member.items():
            joined.setdefault(community[n], []).extend(xs)
        graph, member = merged, joined


def clustered(inside: DataFrame, total: float) -> DataFrame:
    """(id, community) of inside(component, src, dst, weight), a task for each component."""
    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        pairs: dict[int, dict[int, float]] = {}
        for a, b, w in zip(pdf.src, pdf.dst, pdf.weight, strict=True):
            pairs.setdefault(a, {})[b] = pairs.get(a, {}).get(b, 0.0) + w
            pairs.setdefault(b, {})[a] = pairs.get(b, {}).get(a, 0.0) + w
        got = _louvain(pairs, total)
        return pd.DataFrame({"id": list(got), "community": list(got.values())})

    return inside.groupBy("component").applyInPandas(cluster, "id long, community long")


def louvain(nodes: DataFrame, edges: DataFrame, most: int = 1_000_000) -> DataFrame:
    """(id, community), named by its least id: communities never cross components, so each component is clustered on its
    own, with the whole graph's weight.  One of up to ``most`` edges is one task; larger ones are moved round by round, as joins."""
    comp = settle(connected_components(nodes, edges))
    total = max(float(edges.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]) * 2, 1e-12)
    inside = settle(edges.join(comp, F.col("src") == F.col("id")).select("component", "src", "dst", F.col("weight").cast("double").alias("weight")))
    sizes = settle(inside.groupBy("component").agg(F.count(F.lit(1)).alias("n")))
    large = sizes.filter(F.col("n") > most).select("component")

    found = clustered(inside.join(large, "component", "left_anti"), total)
    if not large.isEmpty():
        found = found.unionByName(louvain_by_joins(inside.join(large, "component", "left_semi").select("src", "dst", "weight"), total))
    return nodes.join(found, "id", "left").select("id", F.coalesce("community", "id").alias("community"))


def louvain_by_joins(edges: DataFrame, total: float, rounds: int = 16, levels: int = 8) -> DataFrame:
    """(id, community) of a graph of any size: in each round every second node, by a hash that changes with the round, moves to the neighbouring
    community that gains most modularity; when few move, communities become nodes, until nothing moves any more."""
    links = settle(undirected(edges.select("src", "dst", "weight")).groupBy("src", "dst").agg(F.sum("weight").alias("weight")))
    member = None
    for _ in range(levels):
        degree = settle(links.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("degree")))
        n = degree.count()
        own = settle(degree.select("id", F.col("id").alias("community")))
        changed = False
        for turn in range(rounds):
            weight = own.join(degree, "id").groupBy("community").agg(F.sum("degree").alias("held"))
            to = (links.filter("src <> dst").join(own.select(F.col("id").alias("dst"), F.col("community").alias("c")), "dst")
                  .groupBy(F.col("src").alias("id"), "c").agg(F.sum("weight").alias("w")))
            stay = own.select("id", F.col("community").alias("c"), F.lit(0.0).alias("w"))
            seen = to.unionByName(stay).groupBy("id", "c").agg(F.sum("w").alias("w")).join(degree, "id").join(own, "id").join(weight.withColumnRenamed("community", "c"), "c")
            held = F.col("held") - F.when(F.col("c") == F.col("community"), F.col("degree")).otherwise(0.0)
            gain = F.col("w") - F.col("degree") * held / total
            best = seen.groupBy("id").agg(F.max(F.struct(F.round(gain, 9).alias("gain"), (F.col("c") == F.col("community")).alias("same"), (-F.col("c")).alias("c"))).alias("b"), F.first("community").alias("community"))
            moves = F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(2)) == 0
            nxt = settle(best.select("id", F.when(moves, -F.col("b.c")).otherwise(F.col("community")).alias("community"), (moves & (-F.col("b.c") != F.col("community"))).alias("moved")))
            moved = nxt.filter("moved").count()
            own = nxt.select("id", "community")
            changed = changed or moved > 0
            if moved * 1000 <= n and turn % 2:
                break
        label = own if member is None else member.join(own.withColumnRenamed("id", "_c").withColumnRenamed("community", "_to"), F.col("community") == F.col("_c")).select("id", F.col("_to").alias("community"))
        member = settle(label)
        if not changed:
            break
        a, b = own.select(F.col("id").alias("src"), F.col("community").alias("s")), own.select(F.col("id").alias("dst"), F.col("community").alias("t"))
        links = settle(links.join(a, "src").join(b, "dst").groupBy(F.col("s").alias("src"), F.col("t").alias("dst")).agg(F.sum("weight").alias("weight")))
    least = member.groupBy("community").agg(F.min("id").alias("least"))
    return member.join(least, "community").select("id", F.col("least").alias("community"))


def modularity(edges: DataFrame, communities: DataFrame) -> float:
    """Share of weight inside communities above what degrees alone would give."""
    a = communities.select(F.col("id").alias("src"), F.col("community").alias("ca"))
    b = communities.select(F.col("id").alias("dst"), F.col("community").alias("cb"))
    e = edges.join(a, "src").join(b, "dst")
    m, inner = e.agg(F.sum("weight"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0))).first()
    deg = undirected(edges.select("src", "dst", "weight")).groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("d"))
    square = deg.join(communities, "id").groupBy("community").agg(F.sum("d").alias("d")).agg(F.sum(F.col("d") * F.col("d"))).first()[0]
    return inner / m - square / (4.0 * m * m)


def betweenness_by_joins(nodes: DataFrame, edges: DataFrame, batch: int = 64, hops: int = 10_000) -> DataFrame:
    """(id, score) for graphs of any size: Brandes' accumulation level by level, as joins, about ``batch`` sources at a time.

    Sources are taken in rounds by hash; what a round holds is its sources times the nodes they reach."""
    both = settle(undirected(edges.select("src", "dst")).filter("src <> dst").distinct())
    sources = both.select(F.col("src").alias("s")).distinct()
    turns = max(1, -(-sources.count() // batch))
    scores = []
    for turn in range(turns):
        level = settle(sources.filter(F.pmod(F.xxhash64("s"), F.lit(turns)) == turn).select("s", F.col("s").alias("v"), F.lit(1.0).alias("paths")))
        seen = None
        done = []
        for _ in range(hops):
            done.append(level)
            seen = level.select("s", "v") if seen is None else settle(seen.unionByName(level.select("s", "v")))
            step = level.join(both, F.col("v") == F.col("src")).groupBy("s", F.col("dst").alias("v")).agg(F.sum("paths").alias("paths"))
            level = settle(step.join(seen, ["s", "v"], "left_anti"))
            if level.isEmpty():
                break
        gain = None
        for depth in range(len(done) - 1, 0, -1):
            here = done[depth].withColumn("gain", F.lit(0.0)) if gain is None else done[depth].join(gain, ["s", "v"], "left").withColumn("gain", F.coalesce("gain", F.lit(0.0)))
            here = settle(here)
            scores.append(here.groupBy(F.col("v").alias("id")).agg((F.sum("gain") / 2).alias("score")))
            back = here.select("s", F.col("v").alias("dst"), ((1 + F.col("gain")) / F.col("paths")).alias("each")).join(both, "dst")
            up = done[depth - 1].join(back.select("s", F.col("src").alias("v"), "each"), ["s", "v"])
            gain = settle(up.groupBy("s", "v").agg((F.max("paths") * F.sum("each")).alias("gain")))
    out = nodes.select("id")
    if not scores:
        return out.withColumn("score", F.lit(0.0))
    total = scores[0]
    for x in scores[1:]:
        total = total.unionByName(x)
    return out.join(total.groupBy("id").agg(F.sum("score").alias("score")), "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))


def _csr(edges: pd.DataFrame) -> pd.DataFrame:
    """All neighbours in one row: ids, where each one's neighbours begin, their places."""
    ids, place = np.unique(edges[["src", "dst"]].to_numpy(np.int64), return_inverse=True)
    place = place.reshape(-1, 2)
    order = np.argsort(place[:, 0], kind="stable")
    begin = np.searchsorted(place[order, 0], np.arange(len(ids)))
    return pd.DataFrame({"ids": [ids.tobytes()], "begin": [begin.astype(np.int64).tobytes()], "near": [place[order, 1].astype(np.int32).tobytes()]})


def _passed(begin: np.ndarray, near: np.ndarray, sources: np.ndarray, strip: int = 1 << 19) -> np.ndarray:
    """What Brandes' accumulation from the sources gives each node, all sources at a time."""
    n, b = len(begin), len(sources)
    ends = np.r_[begin[1:], len(near)]
    cuts, at = [0], 0
    while at < n:
        at = max(at + 1, int(np.searchsorted(ends, begin[at] + strip, side="right")))
        cuts.append(at)

    def around(x: np.ndarray) -> np.ndarray:
        """Each node's sum over its neighbours."""
        out = np.empty_like(x)
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            out[lo:hi] = np.add.reduceat(x[near[begin[lo] : ends[hi - 1]]], begin[lo:hi] - begin[lo], axis=0)
        return out

    depth, paths = np.full((n, b), -1, np.int32), np.zeros((n, b))
    depth[sources, np.arange(b)], paths[sources, np.arange(b)] = 0, 1.0
    level = 0
    while True:
        more = around(np.where(depth == level, paths, 0.0))
        fresh = (depth < 0) & (more > 0)
        if not fresh.any():
            break
        level += 1
        depth[fresh], paths[fresh] = level, more[fresh]
    gain = np.zeros((n, b))
    for d in range(level, 1, -1):  # sources themselves get nothing
        each = np.zeros((n, b))
        np.divide(1 + gain, paths, out=each, where=depth == d)
        gain += np.where(depth == d - 1, paths * around(each), 0.0)
    return gain.sum(axis=1) / 2


def betweenness(nodes: DataFrame, edges: DataFrame, max_edges: int = 8_000_000, batch: int = 8) -> DataFrame:
    """(id, score): shortest paths of others that pass a node, by Brandes' accumulation from every source.

    Graphs of up to ``max_edges`` edges are packed into one row, which each task gets with its share of the sources and
    works through ``batch`` of them at a time; larger graphs are worked on as joins.
    """
    both = settle(undirected(edges.select("src", "dst")).filter("src <> dst").distinct())
    if both.count() > 2 * max_edges:
        return betweenness_by_joins(nodes, edges)
    packed = settle(both.withColumn("g", F.lit(0)).groupBy("g").applyInPandas(_csr, "ids binary, begin binary, near binary"))
    tasks = max(1, min(128, both.select("src").distinct().count() // (4 * batch)))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for t, ids, begin, near in zip(pdf["t"], pdf["ids"], pdf["begin"], pdf["near"], strict=True):
                ids, begin, near = np.frombuffer(ids, np.int64), np.frombuffer(begin, np.int64), np.frombuffer(near, np.int32)
                total, own = np.zeros(len(ids)), np.arange(t, len(ids), tasks)
                for lo in range(0, len(own), batch):
                    total += _passed(begin, near, own[lo : lo + batch])
                yield pd.DataFrame({"id": ids, "score": total})

    dealt = packed.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1)))).repartition(tasks, "t")
    got = dealt.mapInPandas(run, "id long, score double").groupBy("id").agg(F.sum("score").alias("score"))
    return nodes.select("id").join(got, "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))
