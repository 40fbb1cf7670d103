"""Neighbour graphs, hierarchical clusters and layouts against small models in memory."""

import numpy as np
import pytest
from oracle import DATA
from pyspark.sql import functions as F

from flockscope.operators import hierarchy, neighbours


def vectors_of(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in zip(ids, x, strict=True)], "id long, v array<double>")


def blobs(seed, sizes, dim=3, noise=10, spread=8.0):
    rng = np.random.default_rng(seed)
    parts = [rng.normal(rng.uniform(-spread, spread, dim), rng.uniform(0.2, 1.0), (n, dim)) for n in sizes]
    return np.concatenate([*parts, rng.uniform(-spread, spread, (noise, dim))])


def recall(graph, x, ids, k, metric):
    d = 1 - (x / np.linalg.norm(x, axis=1)[:, None]) @ (x / np.linalg.norm(x, axis=1)[:, None]).T if metric == "cosine" else np.linalg.norm(x[:, None] - x[None], axis=2)
    np.fill_diagonal(d, np.inf)
    kth = np.sort(d, axis=1)[:, k - 1]
    at = {i: n for n, i in enumerate(ids)}
    hits = sum(d[at[r.id], at[r.n]] <= kth[at[r.id]] + 1e-9 for r in graph)
    return hits / (len(ids) * k)


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_neighbour_graph(spark, metric):
    rng = np.random.default_rng(1)
    x = np.concatenate([blobs(2, [300, 200, 250], 24, 150), np.repeat(rng.normal(size=(1, 24)), 120, axis=0)])
    ids = rng.permutation(5 * len(x))[: len(x)].tolist()
    bad = [(10 ** 6, None), (10 ** 6 + 1, [1.0] * 23), (10 ** 6 + 2, [float("nan")] * 24), (10 ** 6 + 3, [])]
    v = vectors_of(spark, x, ids).unionByName(spark.createDataFrame(bad, "id long, v array<double>"))
    rows = neighbours.neighbour_graph(v, 8, metric, chunk=64).collect()
    assert recall(rows, x, ids, 8, metric) >= 0.9
    assert len(rows) == len({(r.id, r.n) for r in rows}) == 8 * len(x) and all(r.id != r.n for r in rows)


def test_neighbour_graph_of_few(spark):
    x = np.arange(6.0)[:, None] ** 2
    rows = neighbours.neighbour_graph(vectors_of(spark, x), 2, "euclidean").collect()
    assert {(r.id, r.n) for r in rows} == {(0, 1), (0, 2), (1, 0), (1, 2), (2, 1), (2, 0), (3, 2), (3, 4), (4, 3), (4, 5), (5, 4), (5, 3)}
    for n in (0, 1):
        assert neighbours.neighbour_graph(vectors_of(spark, x).limit(n), 2).count() == 0


def model(x, min_size, min_samples):
    """Labels by the definition: spanning tree, single linkage, condensed tree, excess of mass; one task, plain Python."""
    n = len(x)
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    core = np.sort(d, axis=1)[:, min_samples]
    reach = np.maximum(np.maximum(d, core[:, None]), core[None])
    edges = sorted((reach[i, j], i, j) for i in range(n) for j in range(i + 1, n))
    up = list(range(n))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    top, children, weight, size = {i: i for i in range(n)}, {}, {}, {i: 1 for i in range(n)}
    for w, i, j in edges:
        a, b = find(i), find(j)
        if a != b:
            node = n + len(children)
            children[node], weight[node], size[node] = (top[a], top[b]), w, size[top[a]] + size[top[b]]
            up[b] = a
            top[a] = node

    def points(node):
        return [node] if node < n else points(children[node][0]) + points(children[node][1])

    clusters = []  # (parent, birth, mass, points)

    def descend(node, parent, birth):
        """A cluster from its birth down to its split."""
        here = len(clusters)
        clusters.append([parent, 0.0, points(node)])
        while True:
            lam = 1 / max(weight[node], 1e-12)
            a, b = children[node]
            if size[a] >= min_size and size[b] >= min_size:
                clusters[here][1] += (size[a] + size[b]) * (lam - birth)
                descend(a, here, lam)
                descend(b, here, lam)
                return
            for side in (a, b):
                if size[side] < min_size:
                    clusters[here][1] += size[side] * (lam - birth)
            large = [s for s in (a, b) if size[s] >= min_size]
            if not large:
                return
            node = large[0]

    descend(2 * n - 2, None, 0.0)
    best, keep = {}, {}
    for c in range(len(clusters) - 1, -1, -1):
        below = sum(best[k] for k in range(c + 1, len(clusters)) if clusters[k][0] == c)
        keep[c] = clusters[c][1] >= below and c > 0
        best[c] = max(clusters[c][1], below)
    label = [-1] * n
    for c in range(len(clusters) - 1, -1, -1):
        if keep[c]:
            for p in clusters[c][2]:
                label[p] = min(clusters[c][2])
    return label


@pytest.mark.parametrize(("seed", "min_size", "bound", "block"), [(0, 5, 500_000, 1024), (1, 3, 4, 40)])
def test_hierarchical_clusters(spark, seed, min_size, bound, block, monkeypatch):
    """Blocks and bounds small enough that Boruvka rounds, thresholds and several blocks are all run."""
    monkeypatch.setattr(hierarchy, "BLOCK", block)
    x = blobs(seed, [30, 25, 18, 12], 2, 15)
    got = {r.id: r.cluster for r in hierarchy.hierarchical_clusters(vectors_of(spark, x), min_size, 3, bound=bound).collect()}
    want = model(x, min_size, 3)
    assert [got[i] for i in range(len(x))] == want and len(set(want)) > 3


def test_reachability_edges_are_few_and_exact(spark, monkeypatch):
    """Of many blocks, with copies, and far from the origin: the least tree's weight, from a fraction of what all pairs of blocks hold."""
    monkeypatch.setattr(hierarchy, "BLOCK", 16)
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.standard_normal((200, 5)), np.zeros((40, 5)), 1e-7 * rng.standard_normal((30, 5))]) + 1000.0
    d = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    core = np.sort(d, axis=1)[:, 3]  # the first is the point itself
    w = np.maximum(d, np.maximum.outer(core, core))
    edges = hierarchy.reachability_edges(vectors_of(spark, x), 3)
    got = edges.toPandas()
    assert np.allclose(got["w"], w[got["a"], got["b"]], rtol=1e-10, atol=0) and (got["a"] < got["b"]).all()
    least, seen = w[0].copy(), {0}
    total = 0.0
    while len(seen) < len(x):
        at = min((i for i in range(len(x)) if i not in seen), key=least.__getitem__)
        total += least[at]
        seen.add(at)
        least = np.minimum(least, w[at])
    tree = hierarchy.spanning_forest(edges).toPandas()
    assert len(tree) == len(x) - 1 and np.isclose(tree["w"].sum(), total, rtol=1e-10)
    assert len(got) < 1500  # pairs of blocks held over 2,000 different edges


def test_hierarchical_clusters_of_the_neighbour_graph(spark):
    """Blobs far apart: the graph is a forest, and its clusters are those of the full distances."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 0.3, (60, 4)) for c in ([0, 0, 0, 0], [9, 0, 0, 0], [0, 9, 0, 0])] + [np.full((1, 4), 80.0)])
    v = vectors_of(spark, x).unionByName(spark.createDataFrame([(900, None)], "id long, v array<double>"))
    got = {r.id: r.cluster for r in hierarchy.hierarchical_clusters(v, 20, 3, "neighbours", 12).collect()}
    assert all(len({got[i] for i in range(a, a + 60)} - {-1}) == 1 and sum(got[i] != -1 for i in range(a, a + 60)) > 50 for a in (0, 60, 120))
    assert len(set(got.values()) - {-1}) == 3 and got[900] == -1


def test_hierarchical_clusters_of_few(spark):
    """Too few points, equal points and no points have no clusters below the root."""
    same = vectors_of(spark, np.ones((12, 2)))
    assert {r.cluster for r in hierarchy.hierarchical_clusters(same, 5, 3).collect()} <= {-1, 0}
    assert {r.cluster for r in hierarchy.hierarchical_clusters(vectors_of(spark, np.eye(3)), 5, 1).collect()} == {-1}
    assert hierarchy.hierarchical_clusters(same.limit(0), 5, 3).count() == 0


def test_spanning_forest_in_rounds(spark):
    rng = np.random.default_rng(7)
    pairs = {(int(min(a, b)), int(max(a, b))) for a, b in rng.integers(0, 80, (400, 2)) if a != b and (a < 60) == (b < 60)}
    rows = [(a, b, float(w)) for (a, b), w in zip(sorted(pairs), rng.integers(1, 6, len(pairs)), strict=True)]
    edges = spark.createDataFrame(rows, hierarchy.EDGE)
    whole, rounds = ({(r.a, r.b, r.w) for r in hierarchy.spanning_forest(edges, b).collect()} for b in (500_000, 3))
    assert whole == rounds and len(whole) > 60


def test_registered_neighbours(spark):
    from flockscope import tables as T

    v = T.load(spark, DATA, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    rows = {r.id: r.v for r in v.filter("v is not null").collect()}
    ids = sorted(rows)
    assert recall(neighbours.neighbour_graph(v, 10).collect(), np.array([rows[i] for i in ids]), ids, 10, "cosine") >= 0.9
