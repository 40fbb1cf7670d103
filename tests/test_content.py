"""Operators without SQL, and the ones whose edges the test tables do not reach."""

import inspect
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from flockscope.functions import scalars as S
from flockscope.operators import graph, narratives, nodes, scoring, store
from flockscope.sources import scraper
from flockscope.streaming import pipelines


def test_half_precision(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.standard_normal(60), [0, -0.0, 1, -2, 65504, 6e-8, -6.1e-5, np.inf]]).astype("<f2")
    got = spark.createDataFrame([(values.tobytes(),), (b"",), (None,)], "raw binary").select(S.from_half(F.col("raw")).alias("v")).collect()
    assert got[0].v == values.astype(float).tolist() and got[1].v == []


def test_calibration_without_real_or_altered_media(spark):
    rows = [("a", 0.9, True), ("b", 0.2, False), ("c", 0.1, False), ("c", 0.9, True)]
    got = {r.model: r for r in scoring.calibrate_fp_first(spark.createDataFrame(rows, "model string, score double, is_alt boolean")).collect()}
    assert (got["a"].avg_real, got["a"].fp_factor, got["a"].score, got["a"].bias) == (1.0, 0.0, 0.0, 1.0)
    assert (got["b"].avg_real, got["b"].fp_factor, got["b"].score) == (0.0, 1.0, 0.0)
    assert got["c"].weight == 1.0 and got["c"].score == pytest.approx(0.8 * 0.81)


def test_near_hashes(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(-(2**63), 2**63 - 1, 40)
    rows = [(i, int(h)) for i, h in enumerate(base)]
    rows += [(100 + i, int(np.int64(h) ^ np.int64(sum(1 << int(b) for b in rng.choice(60, i % 6, replace=False))))) for i, h in enumerate(base)]
    least = {}
    for i, h in rows:
        least[h] = min(i, least.get(h, i))
    one = sorted((i, h) for h, i in least.items())
    want = sorted((i, j, n) for i, x in one for j, y in one if i < j and (n := ((x ^ y) & (2**64 - 1)).bit_count()) <= 3)
    got = sorted(tuple(r) for r in narratives.near_hashes(spark.createDataFrame(rows, "id long, h long"), 3).collect())
    assert got == want and len(want) > 20


def test_hashed_embedding(spark):
    d = spark.createDataFrame([(1, "Le chat dort"), (2, "dort le CHAT!"), (3, "ab"), (4, None), (5, "autre chose")], "id long, t string")
    v = {r.id: np.array(r.v) for r in d.select("id", narratives.hashed_embedding(F.col("t"), 32).alias("v")).collect()}
    assert v[1] == pytest.approx(v[2]) and np.linalg.norm(v[1]) == pytest.approx(1) and not v[3].any() and not v[4].any() and len(v[5]) == 32


def test_reduced_keeps_distances(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((40, 3)) @ rng.standard_normal((3, 12))
    got = {r.id: np.array(r.v) for r in narratives.reduced(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>"), 5).collect()}
    assert np.linalg.norm(got[0] - got[1]) == pytest.approx(np.linalg.norm(x[0] - x[1])) and len(got[0]) == 5
    few = spark.createDataFrame([(1, [1.0, 2.0])], "id long, v array<double>")
    assert narratives.reduced(few).first().v == [1.0, 2.0]


@pytest.fixture(scope="module")
def small_graph(spark):
    rng = np.random.default_rng(4)
    edges = {(int(min(a, b)), int(max(a, b))) for g in range(3) for a, b in rng.integers(0, 12, (40, 2)) + 12 * g if a != b} | {(3, 15), (20, 30)}
    rows = [(a, b, float(rng.integers(1, 4))) for a, b in sorted(edges)]
    return spark.createDataFrame([(i,) for i in range(40)], "id long"), spark.createDataFrame(rows, "src long, dst long, weight double")


def test_betweenness_by_joins(spark, small_graph):
    n, e = small_graph
    a, b = ({r.id: r.score for r in f(n, e).collect()} for f in (graph.betweenness, graph.betweenness_by_joins))
    assert a == pytest.approx(b) and max(a.values()) > 10 and len(b) == 40


def test_louvain_by_joins(spark, small_graph):
    n, e = small_graph
    total = 2.0 * sum(r.weight for r in e.collect())
    one, many = graph.louvain(n, e), graph.louvain_by_joins(e, total, rounds=4, levels=2)
    found = many.collect()
    assert all(r.community <= r.id for r in found)
    assert graph.modularity(e, n.join(many, "id", "left").select("id", F.coalesce("community", "id").alias("community"))) >= 0.8 * graph.modularity(e, one) > 0.3


def test_pairs_of_a_group_in_blocks(spark):
    rows = [("hot", i) for i in range(50)] + [("cold", i) for i in range(5)] + [("hot", 3), (None, 1), ("cold", None)]
    d = spark.createDataFrame(rows, "g string, m long")
    for block in (7, 1024):
        got = [tuple(r) for r in graph.pairs_within(d, "g", "m", block).collect()]
        assert len(got) == len(set(got)) == 50 * 49 // 2 + 10 and all(a < b for a, b, _ in got)


def test_near_duplicates_by_projection_find_most(spark):
    """What the approximate join misses, against the exact one."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((300, 16))
    x[150:] = x[:150] + 0.1 * rng.standard_normal((150, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    d = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>")
    exact, lsh = ({r.id: r.duplicate_of for r in narratives.near_duplicates(d, 0.95, m).collect()} for m in ("exact", "lsh"))
    want = {i: int(np.argmax(x[:i] @ x[i])) for i in range(1, 300) if (x[:i] @ x[i]).max() >= 0.95}
    assert exact == want and len(want) > 100
    assert len(set(exact.items()) & set(lsh.items())) >= 0.9 * len(exact)


def test_buckets_in_blocks_miss_no_pair_of_a_bucket(spark, monkeypatch):
    """Vectors of any length, copies and vectors without a direction, in blocks cut within buckets; no vectors at all."""
    monkeypatch.setattr(narratives, "BLOCK", 40)
    rng = np.random.default_rng(6)
    x = rng.standard_normal((200, 8)) * rng.uniform(0.1, 50, (200, 1))
    x[150:] = 3 * x[7]
    d = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(900, [0.0] * 8), (901, [float("nan")] * 8), (902, None)], "id long, v array<double>")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = {(i, j) for i in range(200) for j in range(i) if u[i] @ u[j] >= 0.7}
    assert {(r.a, r.b) for r in narratives.similar_pairs(d, 0.7, "lsh").collect()} == want
    narrow = {(r.a, r.b) for r in narratives.similar_pairs(d, 0.7, "lsh", tables=1, bucket=0.05).collect()}
    assert narrow <= want and {(i, j) for i in range(151, 200) for j in range(150, i)} <= narrow
    assert narratives.near_duplicates(d.limit(0), 0.7, "lsh").count() == 0


def test_few_bucket_blocks_meet_where_projections_are_narrow(spark, monkeypatch):
    monkeypatch.setattr(narratives, "BLOCK", 40)
    x = np.random.default_rng(7).standard_normal((400, 8))
    v = narratives.usable(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>"), "cosine")
    wide, narrow = (narratives._bucket_tiles(v, 10, 1, b).select("tile").distinct().count() for b in (4.0, 0.05))
    assert narrow < 30 < wide <= 55


def test_idle_trigger_runs_once_and_queues():
    calls, gate = [], threading.Event()

    def job():
        calls.append(1)
        if len(calls) == 1:
            gate.wait(5)

    t = pipelines.IdleTrigger(job, 10)
    assert not t.progress(0, 0) and not t.progress(5, 1) and not t.progress(0, 5)
    first = threading.Thread(target=lambda: t.progress(0, 20))
    first.start()
    while not calls:
        time.sleep(0.01)
    assert t.run() is False and t.run() is False  # while one runs, another is due once
    gate.set()
    first.join()
    assert len(calls) == 2 and not t.progress(0, 60)
    t.progress(1, 70)
    assert t.progress(0, 90) and len(calls) == 3


def test_retries():
    waited, left = [], [2]

    def run():
        if left[0]:
            left[0] -= 1
            raise OSError

    assert pipelines.with_retries(run, 10, 5, waited.append) == 3 and waited == [5, 5]
    left[0] = 99
    with pytest.raises(OSError):
        pipelines.with_retries(run, 3, 5, waited.append)


def test_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    """Each row is written once, though the stream fails between two runs."""
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    spark.range(10).write.parquet(f"{source}/a")
    read = lambda: spark.readStream.schema("id long").option("recursiveFileLookup", True).parquet(source)
    pipelines.run_available(read(), out, check)
    spark.range(10, 20).write.parquet(f"{source}/b")

    def fail(batch, number):
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        pipelines.run_available(read(), out, f"{check}-other", each=fail)
    pipelines.run_available(read(), out, check)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(20))


def test_polling_finds_new_files(spark, tmp_path):
    source, seen = tmp_path / "in", []
    spark.range(3).write.parquet(str(source / "a"))
    stream = spark.readStream.schema("id long").option("recursiveFileLookup", True).parquet(str(source))
    q = pipelines.poll(stream, lambda batch, n: seen.extend(r.id for r in batch.collect()), str(tmp_path / "check"), 0.2)
    try:
        end = time.time() + 60
        while len(seen) < 3 and time.time() < end:
            time.sleep(0.2)
        spark.range(3, 5).write.parquet(str(source / "b"))
        while len(seen) < 5 and time.time() < end:
            time.sleep(0.2)
    finally:
        q.stop()
    assert sorted(seen) == [0, 1, 2, 3, 4]


def test_inbox_stream_archives_what_it_took(spark, tmp_path):
    import json

    inbox, done = tmp_path / "inbox", tmp_path / "done"
    inbox.mkdir()
    (inbox / "p.json").write_text(json.dumps([{"id": "1", "platform": "x"}, {"id": "2"}]))
    (inbox / "q.json:Zone.Identifier").write_text("[ZoneTransfer]")
    got = []
    pipelines.run_available(scraper.stream_posts(spark, str(inbox), archive=str(done)), "", str(tmp_path / "check"), each=lambda b, n: got.extend(r.id for r in b.collect()))
    assert sorted(got) == ["1", "2"]


def test_report_and_results(spark, tmp_path):
    d = spark.createDataFrame([(1, "a"), (2, None)], "id long, t string")
    store.write_results(d, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out/csv")).count() == spark.read.json(str(tmp_path / "out/json")).count() == 2
    assert store.report({"Rows": d}).splitlines()[2:5] == ["| id | t |", "|---|---|", "| 1 | a |"]
    assert store.report_name("Campagne: été 2024 / suite") == "Campagne__été_2024___suite.md" and len(store.report_name("x" * 90)) == 43


def test_media_choice_prefers_posts_on_a_tie(spark):
    rows = [(1, [10], "u", "done", 0.5), (2, [], "u", "done", 0.9), (3, [10], "v", "done", 0.1), (4, [10], "u", "pending", 1.0)]
    media = spark.createDataFrame(rows, "media_id long, post_ids array<long>, source_user string, status string, final_score double")
    posts, names = spark.createDataFrame([(10,)], "post_id long"), spark.createDataFrame([("u",)], "name string")
    assert [r.media_id for r in nodes.media_of_account(media, posts, names).collect()] == [1, 3]
    assert [r.media_id for r in nodes.media_of_account(media, posts.filter("false"), names).collect()] == [2, 1]
    assert nodes.media_of_account(media, posts.filter("false"), names.filter("false")).count() == 0


def test_betweenness_takes_many_sources_at_a_time(spark, small_graph, monkeypatch):
    """Graphs of over a million edges need no joins, and the neighbours do not pass through the driver."""
    n, e = small_graph
    want = {r.id: r.score for r in graph.betweenness_by_joins(n, e).collect()}
    monkeypatch.setattr(type(e), "toPandas", lambda self: pytest.fail("gathered on the driver"))
    for batch in (1, 5, 64):
        assert {r.id: r.score for r in graph.betweenness(n, e, batch=batch).collect()} == pytest.approx(want)
    assert graph.betweenness(n, e.limit(0)).agg(F.max("score")).first()[0] == 0
    assert inspect.signature(graph.betweenness).parameters["max_edges"].default >= 2_000_000
