"""Nearest-neighbour graphs of vectors by neighbour descent.

Vectors are sorted by the signs of a few random projections and cut into runs of
``chunk`` rows, which are compared in full, once for each of ``trees`` sets of
projections.  Descent rounds then compare the members of each vector's neighbourhood
(its neighbours and its nearest reverse neighbours, ``k`` of each at most) with one
another and keep what is nearer than the lists' ends.  Every list and every block of work
is bounded; runs follow the sort order, so that any number of equal vectors is cut into
runs as well.

Vectors that are null, of another length, or hold null or non-finite components (for
cosine also zero vectors) have no neighbours and are nobody's.  Ids are unique.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flockscope.sources.shared import settle

NEAR = "id long, n long, d double"
_NEAR = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("d", pa.float64())])


def usable(vectors: DataFrame, metric: str = "euclidean") -> DataFrame:
    """vectors(id, v) with a direction and finite components only, as doubles; of unit length for cosine."""
    v = vectors.filter("id is not null and v is not null").select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))
    v = v.filter((F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    if metric == "cosine":
        norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
        v = v.withColumn("_l", norm).filter("_l > 0").select("id", F.transform("v", lambda x: x / F.col("_l")).alias("v"))
    return v


def matrix(column: pa.Array) -> np.ndarray:
    """A list column's rows, all of one length, as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def distances(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        return np.maximum(1 - x @ y.T, 0)
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * (x @ y.T), 0))


def _first(d: np.ndarray, k: int) -> np.ndarray:
    """For each row the places of its k least values, all if there are fewer."""
    return np.argpartition(d, k - 1, axis=1)[:, :k] if k < d.shape[1] else np.broadcast_to(np.arange(d.shape[1]), d.shape)


def _keys(batches: Iterator[pa.RecordBatch], mean: np.ndarray, planes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Adds the signs of all projections but the last as ``code``, and the last as ``p``."""
    for b in batches:
        s = (matrix(b["v"]) - mean) @ planes.T
        code = ((s[:, :-1] > 0) @ (1 << np.arange(planes.shape[0] - 2, -1, -1, dtype=np.int64))).astype(np.int64)
        yield pa.RecordBatch.from_arrays([b["id"], b["v"], pa.array(code), pa.array(s[:, -1])], ["id", "v", "code", "p"])


def _within(batches: Iterator[pa.RecordBatch], k: int, chunk: int, metric: str) -> Iterator[pa.RecordBatch]:
    """Each row's k nearest in its run of the sort order."""
    def near(ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        d = distances(x, x, metric)
        np.fill_diagonal(d, np.inf)
        at = _first(d, k)
        rows = np.repeat(np.arange(len(ids)), at.shape[1])
        n, far = ids[at.ravel()], d[rows, at.ravel()]
        ok = np.isfinite(far)
        return pa.RecordBatch.from_arrays([pa.array(ids[rows][ok]), pa.array(n[ok]), pa.array(far[ok])], schema=_NEAR)

    ids, x = np.zeros(0, np.int64), None
    for b in batches:
        ids = np.concatenate((ids, b["id"].to_numpy(zero_copy_only=False)))
        x = matrix(b["v"]) if x is None or not len(x) else np.concatenate((x, matrix(b["v"])))
        # a short run at the end joins the one before it
        while len(ids) >= 2 * chunk:
            yield near(ids[:chunk], x[:chunk])
            ids, x = ids[chunk:], x[chunk:]
    if len(ids):
        yield near(ids, x)


def nearest(rows: DataFrame, k: int) -> DataFrame:
    """The k nearest (id, n, d) of each id, each n once; cut before the shuffle as well."""
    once = rows.groupBy("id", "n").agg(F.min("d").alias("d"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("d", "n"))
    return once.withColumn("_p", place).filter(F.col("_p") <= k).drop("_p")


def _meet(batches: Iterator[pa.RecordBatch], metric: str) -> Iterator[pa.RecordBatch]:
    """Pairs of a neighbourhood's members that are nearer than one's list ends; rows come sorted by centre."""
    def met(centre: np.ndarray, ids: np.ndarray, worst: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        out = []
        cuts = [0, *(np.flatnonzero(np.diff(centre)) + 1).tolist(), len(centre)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            d = distances(x[a:b], x[a:b], metric)
            r, c = np.nonzero(d < worst[a:b, None])
            keep = r != c
            out.append((ids[a:b][r[keep]], ids[a:b][c[keep]], d[r[keep], c[keep]]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=_NEAR)

    held = None
    for b in batches:
        if not b.num_rows:
            continue
        now = [b["c"].to_numpy(), b["m"].to_numpy(), b["worst"].to_numpy(), matrix(b["v"])]
        held = now if held is None else [np.concatenate(p) for p in zip(held, now, strict=True)]
        last = int(np.argmax(held[0] == held[0][-1]))  # the last centre may go on
        if last:
            yield met(*[h[:last] for h in held])
            held = [h[last:] for h in held]
    if held is not None:
        yield met(*held)


def neighbour_graph(vectors: DataFrame, k: int = 15, metric: str = "cosine", trees: int = 4, rounds: int = 3, chunk: int = 512, seed: int = 42,
                    enough: float = 0.002) -> DataFrame:
    """(id, n, d): the k nearest others of each of vectors(id, v), nearly all of them right; d is 1 - cosine or the Euclidean distance.

    Rounds end early when less than the share ``enough`` of all lists' places changes."""
    v = settle(usable(vectors, metric))
    total, size = v.count(), v.select(F.max(F.size("v"))).first()[0]
    if total < 2:
        return v.sparkSession.createDataFrame([], NEAR)
    v = v.filter(F.size("v") == size)
    sums = v.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m")).collect()  # ``size`` rows
    mean = np.array([m for _, m in sorted((r.i, r.m) for r in sums)])
    rng = np.random.default_rng(seed)
    bits = max(1, min(20, math.ceil(math.log2(total / chunk)) if total > chunk else 1))
    found = None
    for _ in range(trees if total > chunk else 1):
        planes = rng.standard_normal((bits + 1, size))
        coded = v.mapInArrow(lambda it, p=planes: _keys(it, mean, p), "id long, v array<double>, code long, p double")
        runs = coded.repartitionByRange("code", "p", "id").sortWithinPartitions("code", "p", "id")
        near = runs.select("id", "v").mapInArrow(lambda it: _within(it, k, chunk, metric), NEAR)
        found = near if found is None else found.unionByName(near)
    graph = settle(nearest(found, k))
    for _ in range(rounds if total > chunk else 0):
        back = F.row_number().over(Window.partitionBy("n").orderBy("d", "id"))
        reverse = graph.withColumn("_p", back).filter(F.col("_p") <= k).select(F.col("n").alias("c"), F.col("id").alias("m"))
        around = graph.select(F.col("id").alias("c"), F.col("n").alias("m")).unionByName(reverse).unionByName(v.select(F.col("id").alias("c"), F.col("id").alias("m"))).distinct()
        ends = graph.groupBy(F.col("id").alias("e")).agg(F.max("d").alias("far"), F.count(F.lit(1)).alias("len"))
        own = settle(v.join(ends, F.col("id") == F.col("e"), "left").select("id", "v", F.when(F.col("len") >= k, F.col("far")).otherwise(float("inf")).alias("worst")))
        rows = settle(around).join(own, F.col("m") == F.col("id")).select("c", "m", "worst", "v")
        better = rows.repartition("c").sortWithinPartitions("c").mapInArrow(lambda it: _meet(it, metric), NEAR)
        nxt = settle(nearest(graph.unionByName(better), k))
        changed = nxt.join(graph.select("id", "n"), ["id", "n"], "left_anti").count()
        graph = nxt
        if changed < enough * k * total:
            break
    return graph
