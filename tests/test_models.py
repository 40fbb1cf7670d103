"""The queries that have no SQL against small models: plain Python over the rows that DuckDB reads."""

from collections import Counter, defaultdict

import pytest
import xxhash
from oracle import DATA, connection

from flockscope.operators import graph, signals
from flockscope.plans.all_queries import QUERIES
from flockscope.tables import BINDINGS


@pytest.fixture(scope="module")
def duck():
    return connection()


@pytest.fixture(scope="module")
def posts(duck):
    names = "post_id account_id published_at platform narrative_id hashtag final_score prediction is_duplicate_of".split()
    return [dict(zip(names, r, strict=True)) for r in duck.sql(f"{BINDINGS} SELECT {', '.join(names)} FROM posts").fetchall()]


@pytest.fixture(scope="module")
def ranks(posts):
    """PageRank of the accounts, along pairs that touch the same narrative, hashtag and day."""
    at = defaultdict(set)
    for p in posts:
        at[p["narrative_id"], p["hashtag"], p["published_at"].date()].add(p["account_id"])
    weight = Counter((a, b) for who in at.values() for a in who for b in who if a < b)
    out, nodes = Counter(), {p["account_id"] for p in posts}
    for (a, _), w in weight.items():
        out[a] += w
    rank = dict.fromkeys(nodes, 0.15)
    for _ in range(20):
        new = dict.fromkeys(nodes, 0.15)
        for (a, b), w in weight.items():
            new[b] += 0.85 * rank[a] * w / out[a]
        done = max(abs(new[n] - rank[n]) for n in nodes) <= 1e-7
        rank = new
        if done:
            break
    return rank


def test_pagerank_top(spark, ranks):
    got = [(r.id, r.score) for r in QUERIES["pagerank_top"](spark, DATA).collect()]
    want = sorted(ranks.values(), reverse=True)[:50]
    assert [s for _, s in got] == pytest.approx(want) and all(ranks[i] == pytest.approx(s) for i, s in got) and len(got) == min(50, len(ranks))


def test_account_suspicion_ranked(spark, posts, ranks):
    by = defaultdict(list)
    for p in posts:
        by[p["account_id"]].append(p)
    want = {}
    for a, own in by.items():
        days = Counter(p["published_at"].date() for p in own)
        if len(own) >= 3:
            want[a] = (len(own), 100 * sum(p["prediction"] == "synthetic" for p in own) / len(own), sum(p["final_score"] for p in own) / len(own), ranks[a], max(days.values()) * len(days) / len(own))
    got = QUERIES["account_suspicion_ranked"](spark, DATA).collect()
    assert {r.account_id for r in got} == set(want) and len(got) == len(want) > 5
    for r in got:
        n, share, mean, rank, burst = want[r.account_id]
        assert r.posts == n and r.synthetic_percent == pytest.approx(share, abs=0.0501) and r.avg_score == pytest.approx(mean, abs=1e-6)
        assert r.pagerank == pytest.approx(rank) and r.bot_score == pytest.approx(burst)


def test_campaigns_full(spark, posts, ranks):
    """Communities are taken as the operator finds them; all six signals, the score and the order are counted anew."""
    rows = spark.createDataFrame([(p["account_id"], f"{p['narrative_id']}{p['hashtag']}{p['published_at'].date()}") for p in posts], "account_id long, post_id string")
    accounts = rows.selectExpr("account_id AS id").distinct()
    community = {r.id: r.community for r in graph.louvain(accounts, graph.projection(rows)).collect()}
    top = set(sorted(ranks, key=lambda a: (-ranks[a], a))[:100])
    by, want = defaultdict(list), {}
    for p in posts:
        by[p["narrative_id"]].append(p)
    for n, own in by.items():
        who = {p["account_id"] for p in own}
        copies, made = sum(p["is_duplicate_of"] is not None for p in own) / len(own), sum(p["prediction"] == "synthetic" for p in own) / len(own)
        largest = max(Counter(community[a] for a in who).values())
        flags = {"content_reuse": copies >= 0.1 and copies * len(own) > 2.5, "cross_platform": len({p["platform"] for p in own}) > 1,
                 "burst": max(Counter(p["published_at"].date() for p in own).values()) >= 20, "synthetic": made >= 0.2 and round(made, 3) > 0.2, "coordinated": largest >= 3, "amplifiers": len(who & top) >= 2}
        score = sum(signals.WEIGHTS[f] for f, on in flags.items() if on) + 0.05 * (flags["content_reuse"] and round(copies, 3) > 0.3) + 0.05 * (flags["coordinated"] and largest > 10)
        if round(score, 2) >= 0.3:
            want[n] = (round(min(score, 1), 2), ",".join(f for f, on in flags.items() if on))
    got = QUERIES["campaigns_full"](spark, DATA).collect()
    assert {r.narrative_id: (r.confidence, r.signals) for r in got} == want and len(want) > 3
    assert [(-r.confidence, r.narrative_id) for r in got] == sorted((-r.confidence, r.narrative_id) for r in got)


def test_document_topics(spark, duck):
    """The topics are the first three of the language's keywords, which SQL gives."""
    from flockscope.plans.all_queries import ORACLE

    first = defaultdict(list)
    for cluster, term, place in duck.sql(f"SELECT cluster, term, place FROM ({ORACLE['cluster_keywords']}) ORDER BY cluster, place").fetchall():
        if place <= 3:
            first[cluster].append(term)
    lang = dict(duck.sql("SELECT doc_id, lang FROM documents").fetchall())
    got = QUERIES["document_topics"](spark, DATA).collect()
    assert {r.doc_id: r.topics for r in got} == {i: first.get(x, []) for i, x in lang.items()} and len(got) == len(lang)


def test_dataset_split(spark, duck):
    def part(key):
        h = xxhash.xxh64(key.to_bytes(8, "little", signed=True), 42).intdigest()
        h = xxhash.xxh64((42).to_bytes(4, "little"), h).intdigest()
        at = (h - (1 << 64) if h >> 63 else h) % 100
        return "train" if at < 70 else "validation" if at < 85 else "test"

    got = {r.doc_id: r.part for r in QUERIES["dataset_split"](spark, DATA).collect()}
    assert got == {i: part(i) for (i,) in duck.sql("SELECT doc_id FROM documents").fetchall()} and set(got.values()) == {"train", "validation", "test"}


def test_tool_collect(spark, duck, posts):
    got = {r.part: r.rows for r in QUERIES["tool_collect"](spark, DATA).collect()}
    own = [p for p in posts if p["account_id"] == 7]
    days = {p["published_at"].date() for p in own}
    assert got["account"] == 1 and got["posts"] == min(20, len(own)) and got["graph.narratives"] == min(10, len({p["narrative_id"] for p in own}))
    assert got["temporal.timeline"] == len({(d, p["platform"]) for p in own for d in days if p["published_at"].date() == d}) and got["temporal.seed_account"] == bool(own)
    told = [p for p in got if p.startswith("narrative") and p.endswith(".stats")]
    assert len(told) == min(3, got["graph.narratives"]) and all(got[p] == 1 for p in told)
    assert sum(p.startswith("campaign") and p.endswith(".signals") for p in got) == min(2, len({p["narrative_id"].split("-")[0] for p in own}))
    assert {p.split(".")[0].rstrip("012") for p in got} == {"account", "posts", "media", "graph", "narrative", "campaign", "temporal"}
