"""Graphs from memberships against the same graphs from their pairs."""

import numpy as np
import pandas as pd
import pytest
from oracle import DATA
from pyspark.sql import functions as F

from flockscope.operators import comembers, graph, investigation
from flockscope.plans.all_queries import QUERIES


@pytest.fixture(scope="module")
def touched(spark):
    rng = np.random.default_rng(1)
    rows = sorted({(int(a), int(g)) for a, g in zip(rng.integers(0, 200, 1500), rng.integers(0, 300, 1500), strict=True)})
    d = spark.createDataFrame([*rows, (None, 1), (1, None)], "account_id long, post_id long")
    return spark.range(210), d, graph.projection(d).localCheckpoint()


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize(("block", "pairs"), [(1 << 20, 1 << 22), (600, 50)])
def test_shared_groups(spark, touched, block, pairs, monkeypatch):
    monkeypatch.setattr(comembers, "BLOCK", block)
    monkeypatch.setattr(comembers, "PAIRS", pairs)
    monkeypatch.setattr(comembers, "CELLS", pairs)
    nodes, d, edges = touched
    members = comembers.memberships(d, "post_id", "account_id")
    assert rows_of(comembers.shared(members)) == rows_of(edges)
    two = edges.filter("weight >= 2")
    assert rows_of(comembers.shared(members, 2)) == rows_of(two)
    assert rows_of(graph.connected_components(nodes, comembers.connections(members, 2))) == rows_of(graph.connected_components(nodes, two))
    assert comembers.degrees(members).agg(F.sum("n")).first()[0] == edges.count()
    tags = d.select("account_id", F.concat(F.lit("t"), "post_id").alias("tag"))
    assert rows_of(investigation.shared_tags(tags)) == rows_of(two)


@pytest.mark.parametrize("most", [200_000, 3])
def test_pagerank(spark, touched, most, monkeypatch):
    monkeypatch.setattr(comembers, "SORTED", most)
    nodes, d, edges = touched
    got = dict(rows_of(comembers.pagerank(nodes, comembers.memberships(d, "post_id", "account_id"))))
    assert got == pytest.approx(dict(rows_of(graph.pagerank(nodes, edges))), rel=1e-9)


@pytest.mark.parametrize("most", [1_000_000, 10])
def test_louvain(spark, touched, most):
    nodes, d, edges = touched
    got = rows_of(comembers.louvain(nodes, comembers.memberships(d, "post_id", "account_id"), most))
    assert got == rows_of(graph.louvain(nodes, edges, most)) and 1 < len({c for _, c in got}) < 210


def test_queries_make_no_pairs(spark, monkeypatch):
    """Pairs of accounts are made in tiles only: none are joined or shuffled."""
    def fail(*_, **__):
        raise AssertionError("pairs")

    monkeypatch.setattr(graph, "pairs_within", fail)
    monkeypatch.setattr(investigation, "pairs_within", fail)
    for name in ("pagerank", "account_projection", "connected_components", "shared_hashtag_accounts", "louvain_communities", "account_suspicion_ranked"):
        assert QUERIES[name](spark, DATA).count() > 0


def test_shared_hashtags_on_any_day(spark, tmp_path):
    """Accounts share a hashtag whatever the day, and whatever the narrative it stands in (F2)."""
    posts = [(1, "2024-01-01", 1, "view", 4), (2, "2024-01-02", 1, "click", 5), (3, "2024-01-03", 2, "error", 4), (4, "2024-01-04", 2, "view", 5), (5, "2024-01-01", 3, "view", 4), (6, "2024-01-01", None, "view", 5), (7, "2024-01-01", 3, "view", None)]
    rows = [(i, f"{d} 10:00:00", a, e, 1.0, None if k is None else f'{{"k": {k}}}') for i, d, a, e, k in posts]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp"))
    events.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    assert rows_of(QUERIES["shared_hashtag_accounts"](spark, str(tmp_path))) == [(1, 2, 2)]


@pytest.mark.parametrize("heavy", [0, 32, 1 << 40])
@pytest.mark.parametrize("cells", [1 << 22, 300])
def test_groups_multiplied_or_counted(heavy, cells, monkeypatch):
    """Products of groups, counts of pairs and both together give the same."""
    monkeypatch.setattr(comembers, "HEAVY", heavy)
    monkeypatch.setattr(comembers, "CELLS", cells)
    rng = np.random.default_rng(2)
    sizes = np.r_[np.full(6, 0.7), np.full(200, 0.03)]
    blocks, full = [], []
    for n in (70, 90):
        used = rng.random((n, len(sizes))) < sizes
        used[:, 5 if n == 70 else 4] = False
        m, g = np.nonzero(used)
        rows = pd.DataFrame({"k": 0, "g": g * 10, "m": m * 3, "n": 1, "x": 0.0, "y": 0})
        blocks.append(comembers._Block.of({f"l_{c}": v for c, v in comembers._packed(rows).iloc[0].items()}, "l_"))
        full.append(used[used.any(1)].astype(int))
    want = full[0] @ full[1].T
    got = np.zeros_like(want)
    for a, b, n in comembers._met(*blocks):
        assert (n > 0).all() and not got[a, b].any()
        got[a, b] = n
    assert (got == want).all()


def test_blocks_are_not_shuffled(spark, touched, monkeypatch):
    """Tiles read blocks where they were written, however many there are: no copy of a block is moved (F1)."""
    monkeypatch.setattr(comembers, "BLOCK", 200)
    _, d, edges = touched
    pairs = comembers.shared(comembers.memberships(d, "post_id", "account_id"))
    assert "Exchange" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert rows_of(pairs) == rows_of(edges)
