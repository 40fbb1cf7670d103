"""The investigation tools, the full graph and its nodes, bound to the test tables at the published thresholds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flockscope import tables as T
from flockscope.operators import comembers, edges, graph, nodes
from flockscope.operators import investigation as V
from flockscope.operators import signals as G
from flockscope.plans.catalog import query
from flockscope.tools import Tools


def _media(spark, d):
    e = T.load(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    m = e.groupBy((F.col("k") * 10 + F.col("user_id") % 10).alias("media_id"), "k").agg(F.array_sort(F.collect_list("event_id")).alias("ids"), F.round(F.max("value") / 500, 6).alias("final_score"))
    return m.select("media_id", F.when(F.col("k") % 3 != 0, F.col("ids")).otherwise(F.array().cast("array<bigint>")).alias("post_ids"), F.concat(F.lit("Customer#"), F.lpad(F.col("k").cast("string"), 9, "0")).alias("source_user"),
                    F.when(F.col("k") % 5 != 0, "done").otherwise("pending").alias("status"), "final_score")


def _tools(spark, d) -> Tools:
    accounts = T.accounts(spark, d).withColumn("display_name", F.upper("username")).withColumn("platform_id", F.col("account_id").cast("string"))
    posts = T.posts(spark, d)
    return Tools(accounts, posts, _media(spark, d), T.plain_posts(spark, d).groupBy("account_id").agg(F.sum("likes").cast("double").alias("score")))


_T = """, media AS (SELECT kk * 10 + user_id % 10 AS media_id, CASE WHEN kk % 3 <> 0 THEN list(event_id) ELSE [] END AS post_ids, 'Customer#' || lpad(kk::VARCHAR, 9, '0') AS source_user,
  CASE WHEN kk % 5 <> 0 THEN 'done' ELSE 'pending' END AS status, round(max(value) / 500, 6) AS final_score FROM raw_posts GROUP BY kk, kk * 10 + user_id % 10),
e AS (SELECT c.post_id AS copy_id, c.account_id AS copier, o.account_id AS author, c.campaign_id FROM posts c JOIN posts o ON c.is_duplicate_of = o.post_id) """


def _tidy(parts: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """(part, id, n) of several lists."""
    rows = [df.select(F.lit(part).alias("part"), F.col(key).cast("string").alias("id"), F.round(F.col(value).cast("double"), 6).alias("n")) for part, (df, key, value) in parts.items()]
    return reduce(DataFrame.unionByName, rows)


@query(_T + """SELECT account_id, username, platform, posts, avg_score, synthetic, suspicious, synthetic_ratio FROM accounts JOIN (SELECT account_id, count(*) AS posts, round(avg(final_score), 6) AS avg_score,
count(*) FILTER (prediction = 'synthetic') AS synthetic, count(*) FILTER (prediction = 'suspicious') AS suspicious, round(count(*) FILTER (prediction = 'synthetic')::DOUBLE / count(*), 6) AS synthetic_ratio FROM posts GROUP BY 1) USING (account_id) WHERE username = 'Customer#000000007'""")
def tool_account_info(spark, d):
    t = _tools(spark, d)
    platform = T.accounts(spark, d).filter("account_id = 7").first().platform
    return t.get_account_info(platform, "@customer#000000007").select("account_id", "username", "platform", "posts", "avg_score", "synthetic", "suspicious", "synthetic_ratio")


@query(_T + "SELECT post_id, published_at, prediction, round(final_score, 6) AS final_score, narrative_id FROM posts WHERE account_id = 9 ORDER BY published_at DESC, post_id LIMIT 50")
def tool_account_posts(spark, d):
    return _tools(spark, d).get_account_posts(9, 80).withColumn("final_score", F.round("final_score", 6))


@query(_T + """, dm AS (SELECT * FROM media WHERE status = 'done'), a AS (SELECT DISTINCT media_id FROM (SELECT media_id, unnest(post_ids) AS p FROM dm) WHERE p IN (SELECT post_id FROM posts WHERE account_id = 7)),
b AS (SELECT media_id FROM dm WHERE source_user IN (SELECT unnest([username, upper(username)]) FROM accounts WHERE account_id = 7)), w AS (SELECT (SELECT count(*) FROM a) AS na, (SELECT count(*) FROM b) AS nb)
SELECT media_id, final_score FROM dm, w WHERE CASE WHEN na >= nb AND na > 0 THEN media_id IN (FROM a) ELSE media_id IN (FROM b) END ORDER BY final_score DESC, media_id LIMIT 100""")
def tool_media_scores(spark, d):
    return _tools(spark, d).get_media_scores(7)


@query(_T + """, own AS (SELECT * FROM posts WHERE account_id = 8), mem AS (SELECT DISTINCT account_id, community_id FROM posts WHERE community_id <> 0), rk AS (SELECT account_id, sum(likes)::DOUBLE AS score FROM posts GROUP BY 1),
us AS (SELECT media_id, account_id FROM (SELECT media_id, unnest(post_ids) AS post_id FROM media) JOIN posts USING (post_id)),
p1 AS (SELECT 'community_accounts' AS part, account_id::VARCHAR AS id, score AS n FROM (SELECT DISTINCT account_id FROM mem WHERE community_id IN (SELECT community_id FROM mem WHERE account_id = 8) AND account_id <> 8) JOIN rk USING (account_id) ORDER BY score DESC, account_id LIMIT 20),
p2 AS (SELECT 'shared_hashtags', account_id::VARCHAR, count(DISTINCT hashtag)::DOUBLE FROM posts WHERE account_id <> 8 AND hashtag IN (SELECT hashtag FROM own) GROUP BY account_id ORDER BY 3 DESC, account_id LIMIT 15),
p3 AS (SELECT 'shared_media', account_id::VARCHAR, count(DISTINCT media_id)::DOUBLE FROM us WHERE account_id <> 8 AND media_id IN (SELECT media_id FROM us WHERE account_id = 8) GROUP BY account_id ORDER BY 3 DESC, account_id LIMIT 15),
p4 AS (SELECT 'duplicated_from', author::VARCHAR, count(*)::DOUBLE FROM e WHERE copier = 8 AND author <> 8 GROUP BY author ORDER BY 3 DESC, author LIMIT 10), p5 AS (SELECT 'copied_by', copier::VARCHAR, count(*)::DOUBLE FROM e WHERE author = 8 AND copier <> 8 GROUP BY copier ORDER BY 3 DESC, copier LIMIT 10),
p6 AS (SELECT 'narratives', narrative_id, count(*)::DOUBLE FROM own GROUP BY narrative_id ORDER BY 3 DESC, narrative_id LIMIT 10), p7 AS (SELECT 'campaigns', campaign_id, count(*)::DOUBLE FROM own GROUP BY campaign_id ORDER BY 3 DESC, campaign_id LIMIT 5)
FROM p1 UNION ALL FROM p2 UNION ALL FROM p3 UNION ALL FROM p4 UNION ALL FROM p5 UNION ALL FROM p6 UNION ALL FROM p7""")
def tool_graph_neighbors(spark, d):
    g = _tools(spark, d).get_graph_neighbors(8)
    value = {"community_accounts": "score", "shared_hashtags": "tags", "shared_media": "media", "duplicated_from": "copies", "copied_by": "copies", "narratives": "posts", "campaigns": "posts"}
    key = {"narratives": "narrative_id", "campaigns": "campaign_id"}
    return _tidy({k: (df, key.get(k, "account_id"), value[k]) for k, df in g.items()})


@query(_T + """SELECT count(*) AS posts, count(DISTINCT account_id) AS accounts, string_agg(DISTINCT platform, ',' ORDER BY platform) AS platforms, round(avg(final_score), 6) AS avg_score, count(*) FILTER (prediction = 'synthetic') AS synthetic,
min(published_at) AS first_seen, max(published_at) AS last_seen FROM posts WHERE narrative_id = 'view-3'""")
def tool_narrative(spark, d):
    return _tools(spark, d).get_narrative("view-3")["stats"]


@query(_T + """SELECT account_id, username, platform, posts, avg_score, synthetic FROM (SELECT account_id, count(*) AS posts, round(avg(final_score), 6) AS avg_score, count(*) FILTER (prediction = 'synthetic') AS synthetic FROM posts WHERE narrative_id = 'click-4' GROUP BY 1 ORDER BY posts DESC, account_id LIMIT 20) JOIN accounts USING (account_id)""")
def tool_search_accounts(spark, d):
    return _tools(spark, d).search_accounts_by_narrative("click-4").select("account_id", "username", "platform", "posts", "avg_score", "synthetic")


@query(_T + """, own AS (SELECT * FROM posts WHERE campaign_id = 'click') SELECT 'accounts' AS part, account_id::VARCHAR AS id, account_id::DOUBLE AS n FROM (SELECT DISTINCT account_id FROM own ORDER BY 1 LIMIT 20) JOIN accounts USING (account_id)
UNION ALL SELECT 'narratives', narrative_id, count(*)::DOUBLE FROM own GROUP BY narrative_id UNION ALL SELECT 'signals', 'duplicate_ratio', round(count(is_duplicate_of)::DOUBLE / count(*), 6) FROM own""")
def tool_campaign_signals(spark, d):
    g = _tools(spark, d).get_campaign_signals("click")
    signals = g["signals"].select(F.lit("duplicate_ratio").alias("name"), "duplicate_ratio")
    return _tidy({"accounts": (g["accounts"], "account_id", "account_id"), "narratives": (g["narratives"], "narrative_id", "posts"), "signals": (signals, "name", "duplicate_ratio")})


_CG = """, own AS (SELECT * FROM posts WHERE campaign_id = 'click'), acc AS (SELECT account_id, count(*) AS posts, round(avg(final_score), 6) AS avg_score, count(is_duplicate_of) AS duplicates, min(platform) AS platform FROM own GROUP BY 1 ORDER BY posts DESC, account_id LIMIT 20),
tg AS (SELECT hashtag, count(*) AS uses FROM own GROUP BY 1 ORDER BY uses DESC, hashtag LIMIT 20), cp AS (SELECT copier, author, count(*) AS copies FROM e WHERE campaign_id = 'click' AND copier <> author GROUP BY 1, 2 ORDER BY copies DESC, copier, author LIMIT 15) """


@query(_T + _CG + """SELECT 'accounts' AS part, account_id::VARCHAR AS id, posts::DOUBLE AS n FROM acc UNION ALL SELECT 'hashtags', hashtag, uses::DOUBLE FROM tg
UNION ALL FROM (SELECT 'communities', community_id::VARCHAR, count(DISTINCT account_id)::DOUBLE FROM own GROUP BY community_id ORDER BY 3 DESC, community_id LIMIT 10) UNION ALL SELECT 'duplicates', copier || '>' || author, copies::DOUBLE FROM cp
UNION ALL SELECT 'summary', string_agg(DISTINCT platform, ',' ORDER BY platform), round(round(avg(avg_score) FILTER (avg_score <> 0), 5), 6) FROM acc""")
def tool_campaign_graph(spark, d):
    g = _tools(spark, d).get_campaign_graph("click")
    pairs = g["duplicates"].withColumn("pair", F.concat_ws(">", "copier", "author"))
    return _tidy({"accounts": (g["accounts"], "account_id", "posts"), "hashtags": (g["hashtags"], "hashtag", "uses"), "communities": (g["communities"], "community_id", "accounts"), "duplicates": (pairs, "pair", "copies"),
                  "summary": (g["summary"], "platforms", "avg_score")})


_TIME = """, own AS (SELECT * FROM posts WHERE campaign_id = 'click'), dd AS (SELECT account_id, published_at::DATE AS day, count(*) AS n FROM own GROUP BY 1, 2),
cad AS (SELECT account_id, count(*) AS active_days, sum(n)::BIGINT AS posts, round(sum(n)::DOUBLE / count(*), 6) AS avg_per_day FROM dd GROUP BY 1 ORDER BY posts DESC, account_id LIMIT 15),
cross_ AS (SELECT account_id, count(DISTINCT campaign_id) AS campaigns, count(*) AS posts FROM posts WHERE campaign_id <> 'click' AND account_id IN (SELECT account_id FROM own) GROUP BY 1 ORDER BY campaigns DESC, posts DESC, account_id LIMIT 15),
gp AS (SELECT account_id, published_at AS f, lead(published_at) OVER (PARTITION BY account_id ORDER BY published_at) AS t FROM own), sil AS (SELECT account_id, f, (t::DATE - f::DATE) AS gap, row_number() OVER (PARTITION BY account_id ORDER BY (t::DATE - f::DATE) DESC, f) AS rn FROM gp WHERE t::DATE - f::DATE > 14) """


@query(_T + _TIME + """SELECT 'cadence' AS part, account_id::VARCHAR AS id, avg_per_day AS n FROM cad UNION ALL SELECT 'cross_campaign', account_id::VARCHAR, posts::DOUBLE FROM cross_ UNION ALL SELECT 'monthly', strftime(published_at, '%Y-%m'), count(*)::DOUBLE FROM own GROUP BY 2
UNION ALL SELECT 'seed_account', arg_min(account_id, (published_at, post_id))::VARCHAR, arg_min(account_id, (published_at, post_id))::DOUBLE FROM own UNION ALL SELECT 'silences', account_id::VARCHAR, gap::DOUBLE FROM sil WHERE rn <= 5
UNION ALL SELECT 'robotic_accounts', account_id::VARCHAR, avg_per_day FROM cad WHERE active_days > 20 AND avg_per_day >= 0.8""")
def tool_temporal(spark, d):
    g = _tools(spark, d).get_temporal_analysis("click", "campaign")
    return _tidy({"cadence": (g["cadence"], "account_id", "avg_per_day"), "cross_campaign": (g["cross_campaign"], "account_id", "posts"), "monthly": (g["monthly"], "month", "posts"),
                  "seed_account": (g["seed_account"], "account_id", "account_id"), "silences": (g["silences"], "account_id", "gap"), "robotic_accounts": (g["robotic_accounts"], "account_id", "avg_per_day")})


@query(_T + _CG + _TIME.replace("own AS (SELECT * FROM posts WHERE campaign_id = 'click'), ", "") + """, u AS (SELECT 'account:' || arg_min(account_id, (published_at, post_id)) AS target, 'high' AS priority, 'seed' AS reason FROM own
UNION ALL SELECT 'account:' || account_id, 'medium', 'robotic' FROM cad WHERE active_days > 20 AND avg_per_day >= 0.8 UNION ALL SELECT 'account:' || copier, CASE WHEN sum(copies) >= 5 THEN 'high' ELSE 'medium' END, 'copier' FROM cp GROUP BY copier
UNION ALL FROM (SELECT 'account:' || account_id, 'medium', 'cross_campaign' FROM cross_ ORDER BY campaigns DESC, posts DESC, account_id LIMIT 3) UNION ALL SELECT 'tag:' || hashtag, CASE WHEN uses >= 10 THEN 'high' ELSE 'watch' END, 'hashtag' FROM (FROM tg ORDER BY uses DESC, hashtag LIMIT 5) WHERE uses >= 3
UNION ALL FROM (SELECT 'platforms:' || string_agg(DISTINCT platform, ',' ORDER BY platform), 'watch', 'cross_platform' FROM acc HAVING count(DISTINCT platform) > 1) UNION ALL SELECT DISTINCT 'account:' || account_id, 'watch', 'silence' FROM sil WHERE rn <= 5 AND gap > 20),
z AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, reason) AS rn FROM u) SELECT target, priority, reason FROM z WHERE rn = 1""")
def tool_suggestions(spark, d):
    return _tools(spark, d).suggestions("click")


@query(_T + """, df AS (SELECT author, count(*) AS n FROM e WHERE copier = 8 AND author <> 8 GROUP BY 1 ORDER BY n DESC, author LIMIT 10), x AS (SELECT account_id, count(DISTINCT campaign_id) AS c, count(*) AS n FROM posts WHERE campaign_id <> 'click' AND account_id IN (SELECT account_id FROM posts WHERE campaign_id = 'click') GROUP BY 1 ORDER BY c DESC, n DESC, account_id LIMIT 1),
mem AS (SELECT DISTINCT account_id, community_id FROM posts WHERE community_id <> 0), pe AS (SELECT DISTINCT account_id FROM mem WHERE community_id IN (SELECT community_id FROM mem WHERE account_id = 8) AND account_id <> 8),
pk AS (SELECT account_id, is_suspicious FROM (SELECT account_id, sum(likes) AS s FROM posts GROUP BY 1) JOIN pe USING (account_id) LEFT JOIN accounts USING (account_id) ORDER BY s DESC, account_id LIMIT 20),
u AS (SELECT 2 AS rule, -n AS place, 'get_temporal_analysis' AS call, author::VARCHAR AS target FROM df WHERE n > 3 UNION ALL SELECT 3, 0, 'suspicious_community', '8' FROM pk HAVING count(*) >= 5 AND count(*) FILTER (is_suspicious) > 0 UNION ALL SELECT 4, 0, 'get_account_info', account_id::VARCHAR FROM x)
SELECT call, target FROM u ORDER BY rule, place, target LIMIT 4""")
def tool_enrichments(spark, d):
    """Account 8's media score below the alert on average, so that rule stays silent; the others speak."""
    t = _tools(spark, d)
    return Tools(t.accounts, t.posts, t.media.withColumn("final_score", F.col("final_score") / 2), t.ranks).enrichments(8, "click")


@query(_T + """, a AS (SELECT campaign_id, account_id, count(*) AS posts, count(is_duplicate_of) AS duplicates, min(platform) AS platform, row_number() OVER (PARTITION BY campaign_id ORDER BY count(*) DESC, account_id) AS rn FROM posts WHERE campaign_id IN ('click', 'view', 'signup') GROUP BY 1, 2),
m AS (SELECT DISTINCT campaign_id, account_id FROM posts WHERE campaign_id IN ('click', 'view', 'signup')), s AS (SELECT campaign_id, count(*) AS shared_accounts FROM m WHERE account_id IN (SELECT account_id FROM m GROUP BY 1 HAVING count(*) > 1) GROUP BY 1)
SELECT campaign_id, count(*) AS accounts, sum(posts)::BIGINT AS posts, sum(duplicates)::BIGINT AS copies, string_agg(DISTINCT platform, ',' ORDER BY platform) AS platforms, any_value(shared_accounts) AS shared_accounts FROM a JOIN s USING (campaign_id) WHERE rn <= 20 GROUP BY 1""")
def tool_synthesis(spark, d):
    return _tools(spark, d).synthesis(["click", "view", "signup"]).drop("avg_score")


@query()
def tool_collect(spark, d):
    """The tables of an account entry point with their numbers of rows."""
    platform = T.accounts(spark, d).filter("account_id = 7").first().platform
    found = _tools(spark, d).collect("account", "Customer#000000007", platform)
    return reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(k).alias("part"), "rows") for k, df in found.items()])


# the graph in full

def _full(spark, d):
    p = T.posts(spark, d).withColumn("project", F.concat(F.lit("p"), (F.col("account_id") % 5).cast("string"))).withColumn("forward_count", F.floor(F.col("likes") / 100)).withColumn("similarity_score", F.round("final_score", 6))
    comments = T.load(spark, d, "conversations").select(F.col("conv_id").alias("post_id"), F.col("role").alias("account_id"))
    return edges.full_graph(p.withColumn("final_score", F.round("final_score", 6)), comments, T.media_scores(spark, d).select("post_id", "media_id"))


_FULL = """, gp AS (SELECT *, 'p' || (account_id % 5) AS project, floor(likes / 100) AS fc, round(final_score, 6) AS sc FROM posts), gg AS (
SELECT DISTINCT 'A_PUBLIE' AS rel, 'Account' AS src_label, account_id::VARCHAR AS src, 'Post' AS dst_label, post_id::VARCHAR AS dst, NULL::DOUBLE AS value FROM gp UNION ALL SELECT DISTINCT 'A_COMMENTE', 'Account', role, 'Post', conv_id::VARCHAR, NULL FROM conversations
UNION ALL SELECT 'A_FORWARDE', 'Account', account_id::VARCHAR, 'Post', post_id::VARCHAR, max(fc)::DOUBLE FROM gp WHERE platform = 'telegram' AND fc >= 2 GROUP BY 3, 5 UNION ALL SELECT 'EST_DOUBLON_DE', 'Post', post_id::VARCHAR, 'Post', is_duplicate_of::VARCHAR, sc FROM gp WHERE is_duplicate_of IS NOT NULL
UNION ALL SELECT DISTINCT 'APPARTIENT_A', 'Post', post_id::VARCHAR, 'Narrative', narrative_id, NULL FROM gp UNION ALL SELECT DISTINCT 'HAS_HASHTAG', 'Post', post_id::VARCHAR, 'Hashtag', hashtag, NULL FROM gp UNION ALL SELECT 'IS_DEEPFAKE', 'Post', post_id::VARCHAR, 'Deepfake', prediction, sc FROM gp WHERE prediction <> 'likely_real'
UNION ALL SELECT DISTINCT 'A_MEDIA', 'Post', post_id::VARCHAR, 'Media', media_id::VARCHAR, NULL FROM media_scores UNION ALL SELECT DISTINCT 'CONTIENT', 'Project', project, 'Post', post_id::VARCHAR, NULL FROM gp UNION ALL SELECT DISTINCT 'CONTIENT', 'Project', project, 'Account', account_id::VARCHAR, NULL FROM gp
UNION ALL SELECT DISTINCT 'COUVRE', 'Campaign', campaign_id, 'Narrative', narrative_id, NULL FROM gp UNION ALL SELECT DISTINCT 'IMPLIQUE', 'Campaign', campaign_id, 'Account', account_id::VARCHAR, NULL FROM gp UNION ALL SELECT DISTINCT 'PARTICIPE_A', 'Account', account_id::VARCHAR, 'Campaign', campaign_id, NULL FROM gp) """


@query(_FULL + "SELECT rel, src_label, src, dst_label, dst, value FROM gg")
def graph_edges_full(spark, d):
    return _full(spark, d)


@query(_FULL + "SELECT rel, src, dst FROM gg WHERE src_label IN ('Campaign', 'Account') AND dst_label IN ('Campaign', 'Account')")
def edges_of_labels(spark, d):
    return edges.of_labels(_full(spark, d), ["Campaign", "Account"]).select("rel", "src", "dst")


_HOPS = _FULL + """, ee AS (SELECT DISTINCT src_label || ':' || src AS s, dst_label || ':' || dst AS t, rel FROM gg WHERE rel IN ('COUVRE', 'IMPLIQUE', 'A_PUBLIE')), bb AS (SELECT s, t FROM ee UNION SELECT t, s FROM ee),
h0 AS (SELECT 'Campaign:view' AS id), h1 AS (SELECT t AS id FROM bb WHERE s IN (FROM h0) UNION FROM h0), h2 AS (SELECT t AS id FROM bb WHERE s IN (FROM h1) UNION FROM h1) """


def _hood(spark, d):
    e = edges.named(_full(spark, d).filter("rel in ('COUVRE', 'IMPLIQUE', 'A_PUBLIE')"))
    reach = graph.bfs(e.select("src", "dst"), spark.createDataFrame([("Campaign:view",)], "id string"), 2).select("id")
    return e.join(reach.withColumnRenamed("id", "src"), "src", "left_semi").join(reach.withColumnRenamed("id", "dst"), "dst", "left_semi")


@query(_HOPS + "SELECT rel, s AS src, t AS dst FROM ee WHERE s IN (FROM h2) AND t IN (FROM h2) ORDER BY rel, src, dst LIMIT 5000")
def subgraph_two_hops(spark, d):
    """A campaign's neighbourhood of two steps and the edges within it, the first 5,000."""
    return _hood(spark, d).select("rel", "src", "dst").orderBy("rel", "src", "dst").limit(5000)


@query(_HOPS + "SELECT rel, split_part(s, ':', 1) AS src_label, split_part(t, ':', 1) AS dst_label, count(*) AS edges FROM ee WHERE s IN (FROM h2) AND t IN (FROM h2) GROUP BY 1, 2, 3")
def subgraph_kinds(spark, d):
    """Which labels and relations a neighbourhood holds."""
    label = lambda c: F.split_part(c, F.lit(":"), F.lit(1))
    return _hood(spark, d).groupBy("rel", label(F.col("src")).alias("src_label"), label(F.col("dst")).alias("dst_label")).agg(F.count(F.lit(1)).alias("edges"))


@query(", c AS (SELECT post_id, lag(post_id) OVER (PARTITION BY campaign_id, k, account_id % 10 ORDER BY post_id) AS o, min(post_id) OVER (PARTITION BY campaign_id, k, account_id % 10) AS r, row_number() OVER (PARTITION BY campaign_id, k, account_id % 10 ORDER BY post_id) AS n FROM posts) SELECT r AS root, post_id AS id, (n - 1)::INT AS depth FROM c WHERE n BETWEEN 2 AND 6")
def copy_chains(spark, d):
    """Chains of copies of copies, five steps from the original: each copy is taken to be made from the one before it."""
    p = T.posts(spark, d).select("post_id", F.coalesce("is_duplicate_of", "post_id").alias("root"))
    # five steps need the first six posts of an original, cut before the shuffle
    own = Window.partitionBy("root").orderBy("post_id")
    first = p.withColumn("n", F.row_number().over(own)).filter("n <= 6")
    steps = first.select(F.col("post_id").alias("src"), F.lag("post_id").over(own).alias("dst"))
    return graph.chains(steps.filter("dst is not null"), 5)


@query(_FULL + "SELECT account_id, post_id, kind FROM (SELECT src AS account_id, dst AS post_id, rel AS kind FROM gg WHERE rel IN ('A_PUBLIE', 'A_COMMENTE', 'A_FORWARDE'))")
def interaction_edges_all(spark, d):
    return _full(spark, d).filter("rel in ('A_PUBLIE', 'A_COMMENTE', 'A_FORWARDE')").select(F.col("src").alias("account_id"), F.col("dst").alias("post_id"), F.col("rel").alias("kind"))


@query("SELECT part.p_partkey AS media_id, p.o_orderkey AS post_id FROM part JOIN (SELECT DISTINCT l_partkey, l_orderkey AS o_orderkey FROM lineitem) p ON l_partkey = p_partkey WHERE p_partkey % 3 <> 0 UNION SELECT DISTINCT l_partkey, l_orderkey FROM lineitem WHERE l_partkey % 3 = 0")
def media_posts_fallback(spark, d):
    """Media that name no post are found by the posts that name them."""
    links = T.load(spark, d, "lineitem").select(F.col("l_orderkey").alias("post_id"), F.col("l_partkey").alias("media_id")).distinct()
    own = links.filter("media_id % 3 <> 0").groupBy("media_id").agg(F.collect_list("post_id").alias("post_ids"))
    media = T.load(spark, d, "part").select(F.col("p_partkey").alias("media_id")).join(own, "media_id", "left").withColumn("post_ids", F.coalesce("post_ids", F.array().cast("array<bigint>")))
    return nodes.media_posts(media, links.groupBy("post_id").agg(F.collect_list("media_id").alias("media_ids")))


# nodes

def _rest(spec: dict[str, str], given: set[str]) -> str:
    """SQL for the properties that the bound documents do not have."""
    value = {"text": "''", "number": "0", "flag": "false", "maybe": "NULL::DOUBLE", "list": "''"}
    return "".join(f", {value[kind]} AS {name}" for name, _, kind in nodes.properties(spec) if name not in given)


_A = {"platform", "platform_id", "username", "bio", "followers", "is_suspicious", "bot_follower_ratio"}


@query("SELECT account_id::VARCHAR AS mongo_id, platform, account_id::VARCHAR AS platform_id, username, repeat(segment, 50)[1:300] AS bio, coalesce(followers, 0) AS followers, is_suspicious, round(nation_id / 7.0::DOUBLE, 6) AS bot_follower_ratio" + _rest(nodes.ACCOUNT, _A) + " FROM accounts")
def account_node_full(spark, d):
    a = T.accounts(spark, d)
    docs = a.select(F.col("account_id").alias("_id"), "platform", F.col("account_id").cast("string").alias("platform_id"), "username", F.struct(F.repeat("segment", F.lit(50)).alias("bio")).alias("profile"),
                    F.struct(F.col("followers").alias("followers_count")).alias("stats"), F.struct("is_suspicious").alias("flags"), F.struct(F.struct(F.round(F.col("nation_id") / 7.0, 6).alias("follower_ratio")).alias("bot_signals")).alias("analysis"))
    return nodes.account_nodes(docs)


_P = {"platform", "platform_id", "text", "hashtags", "published_at", "likes", "like_count", "narrative_id", "deepfake_score", "deepfake_pred", "tg_forward_count", "source_project"}


@query("SELECT post_id::VARCHAR AS mongo_id, platform, post_id::VARCHAR AS platform_id, repeat(narrative_id || ' ', 80)[1:500] AS text, 'k' || k AS hashtags, strftime(published_at, '%Y-%m-%d') AS published_at, likes, likes AS like_count, narrative_id, round(final_score, 6) AS deepfake_score, prediction AS deepfake_pred, floor(likes / 100)::BIGINT AS tg_forward_count, 'p' || (account_id % 5) AS source_project, is_duplicate_of IS NOT NULL AS is_duplicate, prediction = 'synthetic' AS is_synthetic" + _rest(nodes.POST, _P) + " FROM posts")
def post_node_full(spark, d):
    p = T.posts(spark, d)
    docs = p.select(F.col("post_id").alias("_id"), "platform", F.col("post_id").cast("string").alias("platform_id"), F.struct(F.repeat(F.concat("narrative_id", F.lit(" ")), F.lit(80)).alias("content"), F.array("hashtag", F.lit(None)).alias("hashtags")).alias("text"),
                    F.struct(F.date_format("published_at", "yyyy-MM-dd").alias("published_at")).alias("context"), F.struct("likes").alias("engagement"), F.struct("narrative_id", "is_duplicate_of").alias("nlp"),
                    F.struct(F.round("final_score", 6).alias("final_score"), "prediction").alias("deepfake"), F.struct(F.floor(F.col("likes") / 100).alias("forward_count")).alias("platform_specific"),
                    F.struct(F.concat(F.lit("p"), (F.col("account_id") % 5).cast("string")).alias("project")).alias("source"))
    out = nodes.post_nodes(docs)
    return out.select(*[F.array_join(c, ",").alias(c) if t.startswith("array") else F.col(c) for c, t in out.dtypes])


_M = {"type", "deepfake_score", "width"}


@query("SELECT p_partkey::VARCHAR AS mongo_id, p_type AS type, round(p_retailprice / 3000.0::DOUBLE, 6) AS deepfake_score, p_size::DOUBLE AS width, CASE WHEN p_size % 4 = 0 THEN 1 ELSE p_size % 4 END AS reuse_count, p_partkey::VARCHAR AS post_ids" + _rest(nodes.MEDIA, _M) + " FROM part")
def media_node_full(spark, d):
    m = T.load(spark, d, "part")
    docs = m.select(F.col("p_partkey").alias("_id"), F.col("p_type").alias("type"), F.struct(F.round(F.col("p_retailprice") / 3000.0, 6).alias("final_score")).alias("deepfake"), F.struct(F.col("p_size").cast("double").alias("width")).alias("metadata"),
                    F.struct((F.col("p_size") % 4).alias("seen_count"), F.array("p_partkey").alias("post_ids")).alias("reuse"))
    return nodes.media_nodes(docs).withColumn("post_ids", F.array_join("post_ids", ","))


# at the published thresholds, whether or not these tables reach them

_MM = ", mm AS (SELECT strftime(published_at, '%Y-%m') AS month, count(*) AS posts, round(count(*) FILTER (prediction = 'synthetic')::DOUBLE / count(*), 6) AS synthetic_ratio FROM order_posts GROUP BY 1) "


@query("SELECT account_id, f AS \"from\", t AS \"to\", gap FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY gap DESC, f) AS rn FROM (SELECT account_id, published_at AS f, lead(published_at) OVER (PARTITION BY account_id ORDER BY published_at) AS t, (lead(published_at) OVER (PARTITION BY account_id ORDER BY published_at))::DATE - published_at::DATE AS gap FROM order_posts) WHERE gap > 14) WHERE rn <= 5")
def silence_gaps_top(spark, d):
    return V.silence_gaps(T.order_posts(spark, d), 14, 5)


@query(", dd AS (SELECT account_id, published_at::DATE AS day, count(*) AS n FROM posts GROUP BY 1, 2) SELECT account_id, count(*) AS active_days, round(sum(n)::DOUBLE / count(*), 6) AS avg_per_day FROM dd GROUP BY 1 HAVING count(*) > 20 AND sum(n)::DOUBLE / count(*) >= 0.8")
def robotic_accounts_published(spark, d):
    return V.cadence(T.plain_posts(spark, d)).filter("active_days > 20 and avg_per_day >= 0.8").select("account_id", "active_days", "avg_per_day")


@query(_MM + "SELECT month, synthetic_ratio FROM mm WHERE synthetic_ratio > 1.5::DOUBLE * (SELECT avg(synthetic_ratio) FROM mm) AND synthetic_ratio > 0.05")
def deepfake_spikes_published(spark, d):
    return G.spread_over_mean(V.monthly(T.order_posts(spark, d)).select("month", "synthetic_ratio"), "synthetic_ratio", 1.5, 0.05)


@query(_MM + "SELECT month, posts FROM mm WHERE posts > 2.0::DOUBLE * (SELECT avg(posts) FROM mm)")
def peak_months_published(spark, d):
    return G.spread_over_mean(V.monthly(T.order_posts(spark, d)).select("month", "posts"), "posts", 2.0)


@query(", s AS (SELECT narrative_id, count(*) AS posts, count(is_duplicate_of) AS dup, count(DISTINCT platform) AS pl, count(*) FILTER (prediction = 'synthetic') AS syn FROM posts GROUP BY 1), b AS (SELECT DISTINCT narrative_id FROM (SELECT narrative_id FROM posts GROUP BY narrative_id, published_at::DATE HAVING count(*) >= 20)), "
       "c AS (SELECT narrative_id, round(CASE WHEN dup >= 3 AND dup::DOUBLE / posts >= 0.1 THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN dup >= 3 AND round_even(dup::DOUBLE / posts, 3) > 0.3 THEN 0.05::DOUBLE ELSE 0 END + CASE WHEN pl >= 2 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN narrative_id IN (FROM b) THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN syn >= 1 AND round_even(syn::DOUBLE / posts, 3) > 0.2 THEN 0.1::DOUBLE ELSE 0 END, 2) AS confidence FROM s) SELECT narrative_id, confidence FROM c WHERE confidence >= 0.3")
def campaigns_published(spark, d):
    """Without communities and ranks, and with the thresholds as published."""
    return G.campaigns(T.posts(spark, d)).select("narrative_id", "confidence")


@query()
def campaigns_full(spark, d):
    """Signals five and six from the communities and ranks of the graph itself, the most confident campaigns first."""
    p = T.posts(spark, d)
    touches = p.select("account_id", F.concat("narrative_id", "hashtag", F.to_date("published_at").cast("string")).alias("post_id"))
    accounts, members = p.select(F.col("account_id").alias("id")).distinct(), comembers.memberships(touches, "post_id", "account_id")
    communities = comembers.louvain(accounts, members).select(F.col("id").alias("account_id"), F.col("community").alias("community_id"))
    ranks = comembers.pagerank(accounts, members).select(F.col("id").alias("account_id"), "score")
    return G.campaigns(p, communities, ranks).orderBy(F.desc("confidence"), "narrative_id")


@query()
def pagerank_top(spark, d):
    """The 50 accounts with the highest rank."""
    p = T.posts(spark, d)
    touches = p.select("account_id", F.concat("narrative_id", "hashtag", F.to_date("published_at").cast("string")).alias("post_id"))
    return comembers.pagerank(p.select(F.col("account_id").alias("id")).distinct(), comembers.memberships(touches, "post_id", "account_id")).orderBy(F.desc("score"), "id").limit(50)
