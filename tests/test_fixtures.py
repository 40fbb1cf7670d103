"""Hand-computed cases of the formulas and traversals."""

import datetime as dt
from collections import Counter

import pytest
from oracle import DATA
from pyspark.sql import functions as F

from flockscope.functions import scalars as S
from flockscope.operators import explore, graph, investigation, narratives, scoring, signals, store
from flockscope.plans import analytics_queries
from flockscope.plans.all_queries import QUERIES
from flockscope.streaming.pipelines import IdleTrigger


def values(spark, schema, rows, col):
    return [r[0] for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}").orderBy("i").select(col).collect()]


def test_parse_datetime(spark):
    got = values(spark, "s string", [(None,), ("0",), ("1970-01-01T00:00:00+00:00",), ("1756807661",), ("2025-09-02T10:07:41+00:00",), ("2025-09-02T10:07:41.123Z",), ("02/09/2025",)],
                 S.parse_datetime(F.col("s")).cast("string"))
    assert got == [None, None, None, "2025-09-02 10:07:41", "2025-09-02 10:07:41", "2025-09-02 10:07:41.123", None]


def test_hashtags(spark):
    assert values(spark, "t array<string>", [(["#Foo", "##foo", " ", "#", "Bar "],)], S.normalize_hashtags(F.col("t"))) == [["foo", "", "bar"]]


def test_urls(spark):
    rows = [("", "twitter", "9"), ("", "tiktok", "9"), (None, "instagram", "9"), ("", "telegram", "chan/55"), ("given", "twitter", "9"), ("", "other", "9")]
    got = values(spark, "u string, p string, i2 string", rows, S.infer_post_url(F.col("u"), F.col("p"), F.col("i2"), F.lit("u")))
    assert got == ["https://twitter.com/u/status/9", "https://www.tiktok.com/@u/video/9", "https://www.instagram.com/p/9/", "https://t.me/s/chan", "given", None]


def test_account_key(spark):
    assert values(spark, "a string, b string, c string", [(None, "", "N"), (None, None, None)], S.account_key(F.col("a"), F.col("b"), F.col("c"))) == ["N", "unknown"]


def test_bias(spark):
    got = values(spark, "r double, b double", [(0.94, 0.21), (0.40, 0.50), (0.3, 0.0)], S.bias_correction(F.col("r"), F.col("b")))
    assert got == pytest.approx([0.924050633, 0, 0.3])


def test_divergence(spark):
    got = values(spark, "a double, b double, c double", [(0.78, 0.91, 0.34), (0.9, None, 0.5), (0.7, None, None)], S.model_divergence([F.col(x) for x in "abc"]))
    assert got == pytest.approx([0.243903442, 0.2, 0])


def test_fusion(spark):
    rows = [(0.78, 0.91, 0.34, 0.41), (None, 0.9, 0.5, 0.15), (0.95, 0.97, 0.90, 0.75), (None, None, None, 0.5)]
    fused = S.score_fusion([F.col(x) for x in "abc"], [0.40, 0.45, 0.15], F.col("t"))
    assert values(spark, "a double, b double, c double, t double", rows, fused) == pytest.approx([0.754375, 0.7675, 0.941425, 0])
    assert values(spark, "a double, b double, c double, t double", rows, S.prediction_label(fused)) == ["suspicious", "suspicious", "synthetic", "likely_real"]


def test_labels_at_their_bounds(spark):
    assert values(spark, "s double", [(0.65,), (0.6501,), (0.82,), (0.8201,)], S.prediction_label(F.col("s"))) == ["likely_real", "suspicious", "suspicious", "synthetic"]
    assert values(spark, "s double", [(0.45,), (0.65,)], S.agent_label(F.col("s"))) == ["suspicious", "synthetic"]
    assert values(spark, "s double", [(None,), (0.15,), (0.30,)], S.divergence_confidence(F.col("s"))) == ["low", "medium", "low"]


def test_frames(spark):
    assert values(spark, "s double", [(5.0,), (5.1,), (60.0,), (181.0,)], S.frame_budget(F.col("s"))) == [3, 5, 8, 16]
    assert values(spark, "n int, k int", [(100, 5), (3, 5), (100, 1)], S.frame_indices(F.col("n"), F.col("k"))) == [[0, 25, 50, 74, 99], [0, 0, 1, 2, 2], [50]]


def test_sentiment(spark):
    assert values(spark, "s string", [("3 stars",), ("LABEL_2",), ("",)], S.sentiment_label(F.col("s"))) == ["neutral", "positive", "neutral"]


def test_calibration(spark):
    rows = [("a", 0.2058, False), ("a", 0.3545, True), ("b", 0.0325, False), ("b", 0.8938, True), ("c", 0.3977, False), ("c", 0.4673, True)]
    got = {r.model: r for r in scoring.calibrate_fp_first(spark.createDataFrame(rows, "model string, score double, is_alt boolean")).collect()}
    assert [got[m].fp_factor for m in "abc"] == pytest.approx([0.6308, 0.9360, 0.3628], abs=1e-4)
    assert [got[m].weight for m in "abc"] == pytest.approx([0.1014, 0.8713, 0.0273], abs=2e-4)
    one = scoring.calibrate_fp_first(spark.createDataFrame([("a", 0.5, True), ("b", 0.5, False)], "model string, score double, is_alt boolean")).collect()
    assert {r.weight for r in one} == {0.5}


def test_worst_case(spark):
    rows = [(1, 0.3, "done"), (1, 0.9, "done"), (1, None, "error"), (2, 0.7, "done"), (2, 0.1, "pending")]
    got = {r.post_id: tuple(r)[1:] for r in scoring.worst_case(spark.createDataFrame(rows, "post_id int, final_score double, status string")).collect()}
    assert got == {1: (0.9, "synthetic", "done"), 2: (0.7, "suspicious", "processing")}


def test_metrics(spark):
    rows = [(True, True)] * 48 + [(False, False)] * 68 + [(False, True)] * 11 + [(True, False)] * 12
    r = scoring.binary_metrics(spark.createDataFrame(rows, "truth boolean, guess boolean")).first()
    assert (r.tp, r.tn, r.fp, r.fn) == (48, 68, 11, 12)
    assert (r.precision, r.recall, r.accuracy) == pytest.approx((48 / 59, 0.8, 116 / 139), abs=1e-6)


def posts_of(spark, rows):
    return spark.createDataFrame(rows, "narrative_id string, is_duplicate_of int, platform string, prediction string, published_at timestamp")


def test_content_reuse(spark):
    t = dt.datetime(2025, 1, 1)
    rows = [(n, 1 if i < dups else None, "twitter", "likely_real", t) for n, total, dups in (("a", 20, 3), ("b", 20, 2), ("c", 40, 3), ("d", 30, 3)) for i in range(total)]
    got = {r.narrative_id: r.duplicate_ratio for r in signals.content_reuse(posts_of(spark, rows)).collect()}
    assert got == {"a": 0.15, "d": 0.1}
    assert signals.cross_platform(posts_of(spark, rows)).count() == 0


def test_burst(spark):
    rows = [("a", None, "x", "", dt.datetime(2025, 1, d)) for d, n in ((1, 25), (2, 21), (3, 19)) for _ in range(n)]
    r = signals.burst(posts_of(spark, rows)).first()
    assert (r.burst_days, r.burst_max, r.burst_max_day.day, r.burst_legacy_day.day) == (2, 25, 1, 2)


def test_synthetic_at_its_bound_adds_nothing(spark):
    rows = [("a", None, "x", "synthetic" if i < 2 else "likely_real", dt.datetime(2025, 1, 1)) for i in range(10)]
    p = posts_of(spark, rows).withColumn("account_id", F.lit(1))
    assert signals.synthetic(p).first().synthetic_ratio == 0.2
    assert signals.campaigns(p, min_score=0.0).first().confidence == 0.0


def smoke_graph(spark):
    touched = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 1), (2, 2), (3, 2), (5, 3)], "account_id long, post_id long")
    return touched.select(F.col("account_id").alias("id")).distinct(), graph.projection(touched)


def test_graph(spark):
    nodes, edges = smoke_graph(spark)
    assert {(r.src, r.dst): r.weight for r in edges.collect()} == {(1, 2): 1, (1, 3): 1, (1, 4): 1, (2, 3): 2, (2, 4): 1, (3, 4): 1}
    assert {r.id: r.component for r in graph.connected_components(nodes, edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5}
    rank = {r.id: r.score for r in graph.pagerank(nodes, edges).collect()}
    assert [rank[i] for i in range(1, 6)] == pytest.approx([0.15, 0.1925, 0.301583333, 0.5033875, 0.15])
    found = graph.louvain(nodes, edges)
    assert {r.id: r.community for r in found.collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5}
    assert graph.modularity(edges, found) >= graph.modularity(edges, nodes.withColumn("community", F.col("id")))


def test_pagerank_converged_against_a_model(spark):
    touched = {}
    for r in analytics_queries._touches(spark, DATA).distinct().collect():
        touched.setdefault(r.post_id, []).append(r.account_id)
    weight = Counter((a, b) for on in touched.values() for a in on for b in on if a < b)
    out = Counter()
    for (a, _), n in weight.items():
        out[a] += n
    score = {a: 0.15 for on in touched.values() for a in on}
    for _ in range(20):
        before, score = score, dict.fromkeys(score, 0.15)
        for (a, b), n in weight.items():
            score[b] += 0.85 * before[a] * n / out[a]
        if max(abs(score[a] - before[a]) for a in score) <= 1e-7:
            break
    got = {r.id: r.score for r in QUERIES["pagerank_converged"](spark, DATA).collect()}
    assert got == pytest.approx(score, rel=1e-9)


def test_louvain_parts_two_cliques(spark):
    pairs = [(a, b, 1) for base in (0, 10) for a in range(base, base + 5) for b in range(a + 1, base + 5)] + [(0, 10, 1)]
    edges = spark.createDataFrame(pairs, "src long, dst long, weight long")
    nodes = spark.createDataFrame([(i,) for i in [*range(5), *range(10, 15)]], "id long")
    assert {r.community for r in graph.louvain(nodes, edges).collect()} == {0, 10}


def test_betweenness(spark):
    nodes, edges = spark.range(4), spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "src long, dst long")
    assert {r.id: r.score for r in graph.betweenness(nodes, edges).collect()} == {0: 0.0, 1: 2.0, 2: 2.0, 3: 0.0}


def test_chains_and_bfs(spark):
    edges = spark.createDataFrame([(2, 1), (3, 2), (4, 2)], "src long, dst long")
    assert {(r.root, r.id): r.depth for r in graph.chains(edges).collect()} == {(1, 2): 1, (1, 3): 2, (1, 4): 2}
    assert {r.id: r.depth for r in graph.bfs(edges, spark.range(3, 4), 2).collect()} == {3: 0, 2: 1, 1: 2, 4: 2}


def test_silence_gaps(spark):
    days = [dt.datetime(2025, 1, 1), dt.datetime(2025, 1, 10), dt.datetime(2025, 1, 25), dt.datetime(2025, 2, 20)]
    got = investigation.silence_gaps(spark.createDataFrame([(1, d) for d in days], "account_id int, published_at timestamp"), 14, 5).orderBy(F.desc("gap")).collect()
    assert [r.gap for r in got] == [26, 15]


def test_near_duplicates(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])], "id long, v array<double>")
    assert [tuple(r) for r in narratives.near_duplicates(v).collect()] == [(2, 1, 1.0)]


def test_keywords(spark):
    d = spark.createDataFrame([(1, "c", "btc moon"), (2, "c", "btc moon"), (3, "c", "btc cat")], "id int, c string, t string")
    got = {r.term: r.weight for r in narratives.keywords(d, "c", "t", "id", ngrams=1).collect()}
    # the third text keeps only btc, whose row has length 1
    assert set(got) == {"btc", "moon"} and got["btc"] > got["moon"]


def test_upsert_is_idempotent(spark):
    new = spark.createDataFrame([(1, 5, "b"), (1, 3, "a"), (2, 1, "c")], "k int, at int, v string")
    first = store.insert_absent(new, new.limit(0), ["k"], ["at"])
    assert sorted(map(tuple, first.collect())) == [(1, 3, "a"), (2, 1, "c")]
    assert store.insert_absent(new, first, ["k"], ["at"]).count() == 0


def test_claims(spark):
    jobs = spark.createDataFrame([(1, 1, 1, "pending", 0), (2, 0, 2, "pending", 0), (3, 0, 1, "pending", 3)], "job_id int, priority int, created_at int, status string, attempts int")
    assert [r.job_id for r in store.claim_jobs(jobs, 5).orderBy("place").collect()] == [2, 1]


def test_facets(spark):
    d = spark.createDataFrame([(0.6, "axc"), (0.4, "abc"), (0.7, "zz")], "s double, t string")
    assert d.filter(explore.facets()).count() == d.filter(explore.facets(at_least={"s": 0})).count() == 3
    assert [r.t for r in d.filter(explore.facets(at_least={"s": 0.5}, search=("t", "A.C"))).collect()] == ["axc"]


def test_scraper(spark, tmp_path):
    import json

    from flockscope.sources import scraper

    folder = tmp_path / "proj" / "converted_scan" / "me"
    folder.mkdir(parents=True)
    post = {"scrappeurInfo": {"platform": "X"}, "id": "9", "author": {"name": "9"}, "createTime": "2025-09-02T10:07:41Z", "hashtags": ["#A"], "stats": {"likes": 3},
            "comments": [{"text": "hi", "author": "z"}, {"comment_id": "c2", "reply_to_id": "c1", "text": "yo"}], "is_fake": True, "fake_confidence": 0.9}
    (folder / "converted_one.json").write_text(json.dumps(post))
    (folder / "converted_two.json").write_text(json.dumps([post | {"id": ""}, post | {"id": "8", "scrappeurInfo": None}]))
    raw = tmp_path / "proj" / "scan" / "me"
    raw.mkdir(parents=True)
    (raw / "one.mp4").write_bytes(b"x")
    got = scraper.normalize(scraper.read_posts(spark, str(tmp_path)))
    rows = {r.platform_id: r for r in got.collect()}
    one = rows["9"]
    assert (one.platform, one.project, one.scan, one.user, one.prediction, one.final_score, one.fatal) == ("twitter", "proj", "scan", "me", "synthetic", 0.9, "")
    assert one.warnings == "id_is_author,no_url,no_media_type" and one.engagement.likes == 3 and one.engagement.views == 0
    assert rows[""].fatal == "no_id" and rows["8"].fatal == "no_info,unknown_platform"
    kids = scraper.comments(got.filter("platform_id = '9'")).orderBy("platform_id").collect()
    assert [(k.platform_id, k.account_id, k.depth) for k in kids] == [("9_c0", "z", 0), ("c2", "unknown", 1)]
    files = scraper.media_files(spark, str(tmp_path), got.filter("platform_id = '9'")).collect()
    assert [(f.platform_id, f.type) for f in files] == [("9", "video")]


def test_idle_trigger():
    ran = []
    t = IdleTrigger(lambda: ran.append(1), 30)
    assert not t.progress(5, 0) and not t.progress(0, 10) and t.progress(0, 31) and not t.progress(0, 99)
    t.progress(1, 100)
    assert t.progress(0, 131) and len(ran) == 2
