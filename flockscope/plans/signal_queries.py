"""Signals and campaigns over the bound posts."""

from __future__ import annotations

from pyspark.sql import functions as F

from flockscope import tables as T
from flockscope.operators import signals as G
from flockscope.plans.catalog import query
from flockscope.sources.shared import settle

_COMMUNITY = lambda p: p.select("account_id", "community_id").distinct()
_RANKS = lambda p: p.groupBy("account_id").agg((F.sum("likes") / 1000.0).alias("score"))

_REUSE = "SELECT narrative_id, count(*) AS posts, count(is_duplicate_of) AS duplicates, round_even(count(is_duplicate_of)::DOUBLE / count(*), 3) AS duplicate_ratio FROM posts GROUP BY 1 HAVING count(is_duplicate_of) >= 3 AND count(is_duplicate_of)::DOUBLE / count(*) >= 0.58"


@query(_REUSE)
def signal_content_reuse(spark, d):
    return G.content_reuse(T.posts(spark, d), ratio=0.58)


@query("SELECT narrative_id, string_agg(DISTINCT platform, ',' ORDER BY platform) AS platforms, count(DISTINCT platform) AS n_platforms FROM posts GROUP BY 1 HAVING count(DISTINCT platform) >= 2")
def signal_cross_platform(spark, d):
    return G.cross_platform(T.plain_posts(spark, d))


_BURST = """, days AS (SELECT narrative_id, published_at::DATE AS day, count(*) AS n FROM posts GROUP BY 1, 2 HAVING count(*) >= 12)
SELECT narrative_id, count(*) AS burst_days, arg_max(day, (n, -epoch(day))) AS burst_max_day, max(n) AS burst_max, arg_min(day, (n, day)) AS burst_legacy_day, min(n) AS burst_legacy FROM days GROUP BY 1"""


@query(_BURST)
def signal_burst(spark, d):
    return G.burst(T.plain_posts(spark, d), 12)


@query("SELECT narrative_id, count(*) AS posts, count(*) FILTER (prediction = 'synthetic') AS synthetic_posts, round_even(count(*) FILTER (prediction = 'synthetic')::DOUBLE / count(*), 3) AS synthetic_ratio FROM posts GROUP BY 1 HAVING count(*) FILTER (prediction = 'synthetic')::DOUBLE / count(*) >= 0.1 AND count(*) FILTER (prediction = 'synthetic') >= 1")
def signal_synthetic(spark, d):
    return G.synthetic(T.plain_posts(spark, d), 0.1)


@query(""", c AS (SELECT narrative_id, community_id, count(DISTINCT account_id) AS accounts FROM posts GROUP BY 1, 2 HAVING count(DISTINCT account_id) >= 3)
SELECT narrative_id, arg_max(community_id, (accounts, -community_id)) AS community_id, max(accounts) AS accounts, count(*) AS n_communities FROM c GROUP BY 1""")
def coordinated_accounts(spark, d):
    p = T.plain_posts(spark, d)
    return G.coordinated_accounts(p, _COMMUNITY(p))


@query(""", r AS (SELECT account_id, sum(likes) / 1000.0::DOUBLE AS score FROM posts GROUP BY 1 ORDER BY score DESC, account_id LIMIT 20)
SELECT narrative_id, count(DISTINCT account_id) AS amplifiers, round_even(max(score), 4) AS max_score FROM posts JOIN r USING (account_id) GROUP BY 1 HAVING count(DISTINCT account_id) >= 2""")
def key_amplifiers(spark, d):
    p = T.plain_posts(spark, d)
    return G.key_amplifiers(p, _RANKS(p), 20)


_CAMPAIGNS = """, n AS (SELECT narrative_id, count(*) AS posts, count(is_duplicate_of) AS dups, count(*) FILTER (prediction = 'synthetic') AS syn, min(published_at) AS start, max(published_at) AS "end",
  string_agg(DISTINCT platform, ',' ORDER BY platform) AS platforms, count(DISTINCT platform) AS np FROM posts GROUP BY 1),
b AS (SELECT narrative_id, count(*) AS burst_days FROM (SELECT narrative_id, published_at::DATE AS day FROM posts GROUP BY 1, 2 HAVING count(*) >= 12) GROUP BY 1),
co AS (SELECT narrative_id, max(a) AS community_accounts FROM (SELECT narrative_id, community_id, count(DISTINCT account_id) AS a FROM posts GROUP BY 1, 2 HAVING count(DISTINCT account_id) >= 3) GROUP BY 1),
r AS (SELECT account_id, sum(likes) / 1000.0::DOUBLE AS score FROM posts GROUP BY 1 ORDER BY score DESC, account_id LIMIT 20),
am AS (SELECT narrative_id, count(DISTINCT account_id) AS amplifiers FROM posts JOIN r USING (account_id) GROUP BY 1 HAVING count(DISTINCT account_id) >= 2),
f AS (SELECT narrative_id, start, "end", CASE WHEN dups >= 3 AND dups::DOUBLE / posts >= 0.58 THEN round_even(dups::DOUBLE / posts, 3) END AS duplicate_ratio,
  CASE WHEN np >= 2 THEN platforms END AS platforms, burst_days, CASE WHEN syn >= 1 AND syn::DOUBLE / posts >= 0.1 THEN round_even(syn::DOUBLE / posts, 3) END AS synthetic_ratio, community_accounts, amplifiers
  FROM n LEFT JOIN b USING (narrative_id) LEFT JOIN co USING (narrative_id) LEFT JOIN am USING (narrative_id)),
s AS (SELECT *, round(least(1.0, CASE WHEN duplicate_ratio IS NOT NULL THEN 0.25 ELSE 0 END + CASE WHEN platforms IS NOT NULL THEN 0.2 ELSE 0 END + CASE WHEN burst_days IS NOT NULL THEN 0.2 ELSE 0 END
  + CASE WHEN synthetic_ratio > 0.1 THEN 0.1 ELSE 0 END + CASE WHEN community_accounts IS NOT NULL THEN 0.15 ELSE 0 END + CASE WHEN amplifiers IS NOT NULL THEN 0.1 ELSE 0 END
  + CASE WHEN duplicate_ratio > 0.3 THEN 0.05 ELSE 0 END + CASE WHEN community_accounts > 10 THEN 0.05 ELSE 0 END)::DOUBLE, 2) AS confidence,
  concat_ws(',', CASE WHEN duplicate_ratio IS NOT NULL THEN 'content_reuse' END, CASE WHEN platforms IS NOT NULL THEN 'cross_platform' END, CASE WHEN burst_days IS NOT NULL THEN 'burst' END,
  CASE WHEN synthetic_ratio > 0.1 THEN 'synthetic' END, CASE WHEN community_accounts IS NOT NULL THEN 'coordinated' END, CASE WHEN amplifiers IS NOT NULL THEN 'amplifiers' END) AS signals FROM f)
SELECT narrative_id, confidence, signals, start, "end", duplicate_ratio, platforms, burst_days, synthetic_ratio, community_accounts, amplifiers FROM s WHERE confidence >= 0.3"""


@query(_CAMPAIGNS)
def campaigns(spark, d):
    p = settle(T.posts(spark, d))  # six signals read them
    return G.campaigns(p, _COMMUNITY(p), _RANKS(p), reuse=0.58, burst_posts=12, synthetic_ratio=0.1, top=20)
