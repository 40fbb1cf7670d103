"""Manifold reduction: a fuzzy neighbour graph laid out in few dimensions.

Each vector's distances to its neighbours become weights by a scale of its own, found by
bisection, and the two directions of a pair are united.  The layout starts from principal
components.  In each round the vectors are sorted along a random direction of the present
layout and cut into chunks; a chunk moves its own vectors along the graph's edges and
away from others (of the chunk, and of a sample of ``pool`` positions), while those
outside hold still; the next round cuts another way.  A vector is drawn by its
``2 * k`` strongest edges, so that a chunk's work is bounded.  Everything is seeded.

Vectors without a direction are left out; fewer than ``least`` are returned as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flockscope.operators.neighbours import matrix, neighbour_graph, usable
from flockscope.sources.shared import settle

WEIGHT = "a long, b long, p double"
_WEIGHT = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("p", pa.float64())])


def curve(min_dist: float, spread: float = 1.0) -> tuple[float, float]:
    """(a, b) for which 1 / (1 + a d^(2b)) is nearest to a plateau up to ``min_dist`` with an exponential tail."""
    d = np.linspace(0, 3 * spread, 300)[1:]
    want = np.where(d < min_dist, 1.0, np.exp(-(d - min_dist) / spread))
    (a, b), width = (1.5, 0.9), 0.5
    for _ in range(14):  # a grid that closes in on the least squares
        grid = [(x, y) for x in a * np.linspace(1 - width, 1 + width, 9) for y in b * np.linspace(1 - width, 1 + width, 9)]
        a, b = min(grid, key=lambda g: float(np.sum((1 / (1 + g[0] * d ** (2 * g[1])) - want) ** 2)))
        width *= 0.6
    return float(a), float(b)


def scales(d: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Weights of sorted distances (rows of one vector's neighbours each): exp(-(d - least) / s), s such that they sum up to log2 of their number."""
    far = np.maximum(d - d[:, :1], 0)
    target = np.log2(d.shape[1])
    lo, hi, mid = np.zeros(len(d)), np.full(len(d), np.inf), np.ones(len(d))
    for _ in range(rounds):
        total = np.exp(-far / mid[:, None]).sum(1)
        high = total > target
        hi, lo = np.where(high, mid, hi), np.where(high, lo, mid)
        mid = np.where(np.isinf(hi), mid * 2, (lo + hi) / 2)
    # vectors whose neighbours are all equally far keep a scale
    mid = np.maximum(mid, 1e-3 * np.maximum(d.mean(1), 1e-12))
    return np.exp(-far / mid[:, None])


def _weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, lists = batch["id"].to_numpy(), batch["near"].to_pylist()
        for size in {len(x) for x in lists}:  # vectors with as many neighbours together
            at = [i for i, x in enumerate(lists) if len(x) == size]
            p = scales(np.array([[y["d"] for y in lists[i]] for i in at]))
            n = np.array([[y["n"] for y in lists[i]] for i in at], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[at], size)), pa.array(n.ravel()), pa.array(p.ravel())], schema=_WEIGHT)


def fuzzy_graph(near: DataFrame) -> DataFrame:
    """(a, b, p), a < b: the union of both directions' weights, p + q - p q, of near(id, n, d)."""
    lists = near.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("d", "n"))).alias("near"))  # ``k`` each
    one = lists.mapInArrow(_weights, WEIGHT)
    both = one.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("p").alias("p"), F.min("p").alias("q"), F.count(F.lit(1)).alias("n"))
    return both.select("a", "b", F.when(F.col("n") > 1, F.col("p") + F.col("q") - F.col("p") * F.col("q")).otherwise(F.col("p")).alias("p"))


def _start(v: DataFrame, dim: int, n: int) -> DataFrame:
    """(id, y): principal components, scaled to at most ten; dimensions that there are none for hold noise."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    size = len(v.first()["v"])
    k = max(1, min(dim, n - 2, size))
    dense = v.select("id", array_to_vector("v").alias("f"))
    y = PCA(k=k, inputCol="f", outputCol="o").fit(dense).transform(dense).select("id", vector_to_array("o").alias("y"))
    top = y.select(F.max(F.aggregate("y", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x))))).first()[0] or 1.0
    noise = lambda i: (F.pmod(F.xxhash64("id", i), F.lit(1 << 20)) / float(1 << 20) - 0.5) * 0.02
    return y.select("id", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at("y", i + 1) * (10.0 / top), F.lit(0.0)) + noise(i)).alias("y"))


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, n = TaskContext.get().partitionId(), 0
    for b in batches:
        chunk = (np.int64(part) << 32) + (n + np.arange(b.num_rows)) // size
        n += b.num_rows
        yield pa.RecordBatch.from_arrays([b["id"], b["y"], pa.array(chunk)], ["id", "y", "chunk"])


def _move(own: pd.DataFrame, edges: pd.DataFrame, pool: np.ndarray, epochs: int, begin: float, step: float, ab: tuple[float, float], seed: int, negatives: int = 5) -> pd.DataFrame:
    """A chunk's vectors after ``epochs`` epochs."""
    a, b = ab
    own = own.sort_values("id")
    ids = own["id"].to_numpy(np.int64)
    y = np.stack(own["y"].to_list()).astype(np.float64)
    if len(edges):
        edges = edges.sort_values(["i", "j"])
        i = np.searchsorted(ids, edges["i"].to_numpy(np.int64))
        far = edges["j"].to_numpy(np.int64)
        at = np.minimum(np.searchsorted(ids, far), len(ids) - 1)
        inside = ids[at] == far
        out = np.stack(edges["y"].to_list()).astype(np.float64)
        p = edges["p"].to_numpy(np.float64)
        rng = np.random.default_rng([seed, int(ids[0]) & 0x7FFFFFFF, len(ids)])
        others = np.concatenate([y, pool]) if len(pool) else y
        for epoch in range(epochs):
            rate = begin - step * epoch
            on = rng.random(len(p)) < p
            k, place = i[on], at[on]
            to = np.where(inside[on][:, None], y[place], out[on])
            diff = y[k] - to
            d2 = np.maximum((diff * diff).sum(1), 1e-12)
            pull = np.clip((-2 * a * b * d2 ** (b - 1) / (1 + a * d2 ** b))[:, None] * diff, -4, 4)
            force = np.zeros_like(y)
            np.add.at(force, k, pull)
            others[: len(y)] = y
            for _ in range(negatives):
                diff = y[k] - others[rng.integers(0, len(others), len(k))]
                d2 = (diff * diff).sum(1)
                push = np.clip((2 * b / ((0.001 + d2) * (1 + a * d2 ** b)))[:, None] * diff, -4, 4)
                np.add.at(force, k, push)
            # all edges move at once: a vector with many takes their mean, a few steps long
            many = np.bincount(k, minlength=len(y))[:, None]
            y = y + rate * force / np.maximum(many / 3.0, 1.0)
    return pd.DataFrame({"id": ids, "y": list(y)})


def layout(graph: DataFrame, start: DataFrame, dim: int, k: int, rounds: int = 8, epochs: int = 25, chunk: int = 4096, pool: int = 4096, min_dist: float = 0.1, seed: int = 42) -> DataFrame:
    """(id, y): positions of start(id, y) moved along graph(a, b, p)."""
    both = graph.select(F.col("a").alias("i"), F.col("b").alias("j"), "p").unionByName(graph.select(F.col("b").alias("i"), F.col("a").alias("j"), "p"))
    strongest = F.row_number().over(Window.partitionBy("i").orderBy(F.desc("p"), "j"))
    edges = settle(both.withColumn("_p", strongest).filter(F.col("_p") <= 2 * k).drop("_p"))
    ab, rng = curve(min_dist), np.random.default_rng(seed)
    y = settle(start)
    n = y.count()
    for r in range(rounds):
        way = rng.standard_normal(dim)
        way = F.aggregate(F.zip_with("y", F.array(*map(F.lit, way.tolist())), lambda u, w: u * w), F.lit(0.0), lambda s, x: s + x)
        cut = (y.withColumn("_w", way).repartitionByRange("_w", "id").sortWithinPartitions("_w", "id").select("id", "y")
               .mapInArrow(lambda it: _chunks(it, chunk), "id long, y array<double>, chunk long"))
        cut = settle(cut)
        drawn = y.filter(F.pmod(F.xxhash64("id", F.lit(r)), F.lit(1 << 20)) < int(min(1.0, 2.0 * pool / max(n, 1)) * (1 << 20))).orderBy(F.xxhash64("id", F.lit(-r))).limit(pool)
        held = np.array([x[0] for x in drawn.select("y").collect()])  # at most ``pool`` positions
        near = edges.join(cut.select(F.col("id").alias("_i"), F.col("chunk").alias("part")), F.col("i") == F.col("_i")).join(y.select(F.col("id").alias("_j"), "y"), F.col("j") == F.col("_j")).select("part", "i", "j", "p", "y")
        total = rounds * epochs
        begin = 1.0 - r * epochs / total
        y = settle(cut.groupBy("chunk").cogroup(near.groupBy("part")).applyInPandas(_mover(held, epochs, begin, 1.0 / total, ab, seed + r), "id long, y array<double>"))
    return y


def _mover(pool: np.ndarray, epochs: int, begin: float, step: float, ab: tuple[float, float], seed: int):
    return lambda own, edges: _move(own, edges, pool, epochs, begin, step, ab, seed) if len(own) else pd.DataFrame({"id": [], "y": []})


def reduced_manifold(vectors: DataFrame, dim: int = 50, k: int = 15, min_dist: float = 0.1, metric: str = "cosine", least: int = 20, rounds: int = 8, seed: int = 42, chunk: int = 4096) -> DataFrame:
    """vectors(id, v) in ``dim`` dimensions (two fewer than there are vectors at most), neighbours staying neighbours."""
    v = settle(usable(vectors, metric))
    n = v.count()
    if n < least:
        return vectors.select("id", F.col("v").cast("array<double>").alias("v"))
    dim = max(1, min(dim, n - 2))
    graph = settle(fuzzy_graph(neighbour_graph(vectors, min(k, n - 1), metric, seed=seed)))
    return layout(graph, _start(v, dim, n), dim, k, rounds, chunk=chunk, min_dist=min_dist, seed=seed).select("id", F.col("y").alias("v"))
