"""Investigation, temporal and exploration queries, bound to the test tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from flockscope import tables as T
from flockscope.operators import investigation as V
from flockscope.operators.explore import facets, page, shares, status_counts
from flockscope.operators import signals as G
from flockscope.operators.narratives import top_places
from flockscope.plans.catalog import query

_SUMMARY = "SELECT account_id, count(*) AS posts, round(avg(final_score), 6) AS avg_score, count(*) FILTER (prediction = 'synthetic') AS synthetic, count(*) FILTER (prediction = 'suspicious') AS suspicious, round(count(*) FILTER (prediction = 'synthetic')::DOUBLE / count(*), 6) AS synthetic_ratio FROM posts GROUP BY 1"


@query(_SUMMARY)
def account_deepfake_summary(spark, d):
    return V.deepfake_summary(T.plain_posts(spark, d))


@query("SELECT account_id, username, platform FROM accounts WHERE username = 'Customer#000000007' OR account_id = 12 OR lower(segment) = 'none' ORDER BY account_id LIMIT 1")
def account_lookup(spark, d):
    a = T.accounts(spark, d)
    hit = (F.col("username") == "Customer#000000007") | (F.col("account_id") == 12) | (F.lower("segment") == "none")
    return a.filter(hit).orderBy("account_id").limit(1).select("account_id", "username", "platform")


@query("SELECT post_id, published_at, prediction FROM posts WHERE account_id = 7 ORDER BY published_at DESC, post_id LIMIT 50")
def account_posts(spark, d):
    return T.plain_posts(spark, d).filter("account_id = 7").orderBy(F.desc("published_at"), "post_id").limit(50).select("post_id", "published_at", "prediction")


@query("""SELECT media_id, max(greatest(m1, m2, m3)) AS final_score FROM media_scores JOIN order_posts USING (post_id) WHERE account_id = 7 GROUP BY 1 ORDER BY final_score DESC, media_id LIMIT 100""")
def account_media_scores(spark, d):
    own = T.order_posts(spark, d).filter("account_id = 7").select("post_id")
    m = T.media_scores(spark, d).join(own, "post_id", "left_semi").groupBy("media_id").agg(F.max(F.greatest("m1", "m2", "m3")).alias("final_score"))
    return m.orderBy(F.desc("final_score"), "media_id").limit(100)


_TOP = ", t AS (SELECT account_id, count(*) AS posts, round(avg(final_score), 6) AS avg_score, count(*) FILTER (prediction = 'synthetic') AS synthetic FROM posts WHERE narrative_id = 'view-3' GROUP BY 1 ORDER BY posts DESC, account_id LIMIT {k}) SELECT account_id, posts, avg_score, synthetic, username, platform FROM t {how} JOIN accounts USING (account_id)"


@query(_TOP.format(k=10, how="LEFT"))
def narrative_top_accounts(spark, d):
    return V.top_accounts(T.plain_posts(spark, d).filter("narrative_id = 'view-3'"), T.accounts(spark, d), 10)


@query(_TOP.format(k=20, how=""))
def accounts_by_narrative(spark, d):
    return V.top_accounts(T.plain_posts(spark, d).filter("narrative_id = 'view-3'"), T.accounts(spark, d), 20, "inner")


@query("""SELECT campaign_id, account_id, username FROM (SELECT campaign_id, unnest(list_sort(list(DISTINCT account_id))[1:20]) AS account_id FROM posts GROUP BY 1) JOIN accounts USING (account_id)""")
def campaign_members(spark, d):
    first = top_places(T.plain_posts(spark, d).select("campaign_id", "account_id").distinct(), "campaign_id", F.struct("account_id"), 20)
    return first.select("campaign_id", "_v.account_id").join(T.accounts(spark, d).select("account_id", "username"), "account_id").select("campaign_id", "account_id", "username")


@query("SELECT o.post_id, m.media_id FROM order_posts o JOIN (SELECT DISTINCT post_id, media_id FROM media_scores) m USING (post_id) WHERE prediction <> 'likely_real'")
def post_media_edges(spark, d):
    edges = T.media_scores(spark, d).select("post_id", "media_id").distinct()
    return edges.join(T.order_posts(spark, d).filter("prediction <> 'likely_real'").select("post_id"), "post_id", "left_semi").select("post_id", "media_id")


_DUP = ", e AS (SELECT c.post_id AS copy_id, c.is_duplicate_of AS original_id, c.account_id AS copier, o.account_id AS author, c.platform AS copy_platform, o.platform AS original_platform, c.published_at AS copied_at, o.published_at AS original_at, c.narrative_id FROM posts c JOIN posts o ON c.is_duplicate_of = o.post_id) "


@query(_DUP + "SELECT copy_id, original_id, copier, author, copier % 7 AS community_id FROM e WHERE copied_at::DATE = original_at::DATE AND copier <> author AND copier % 7 = author % 7")
def same_day_duplicate_pairs(spark, d):
    return V.same_day_pairs(T.posts(spark, d))


@query(_DUP + "SELECT copy_platform, original_platform, count(*) AS copies FROM e WHERE copy_platform <> original_platform GROUP BY 1, 2")
def cross_platform_duplicates(spark, d):
    return V.duplicate_edges(T.posts(spark, d)).filter("copy_platform <> original_platform").groupBy("copy_platform", "original_platform").agg(F.count(F.lit(1)).alias("copies"))


@query(", t AS (SELECT DISTINCT account_id, hashtag FROM posts) SELECT x.account_id AS account_a, y.account_id AS account_b, count(*) AS shared_tags FROM t x JOIN t y USING (hashtag) WHERE x.account_id < y.account_id GROUP BY 1, 2 HAVING count(*) >= 2")
def shared_hashtag_accounts(spark, d):
    return V.shared_tags(T.plain_posts(spark, d).select("account_id", F.col("hashtag").alias("tag")))


@query(_DUP + "SELECT copier, author, count(*) AS copies FROM e WHERE copier <> author AND copier = 7 GROUP BY 1, 2")
def duplicated_from(spark, d):
    return V.copy_pairs(V.duplicate_edges(T.posts(spark, d))).filter("copier = 7")


@query(_DUP + "SELECT copier, author, count(*) AS copies FROM e WHERE copier <> author AND author = 7 GROUP BY 1, 2")
def copied_by(spark, d):
    return V.copy_pairs(V.duplicate_edges(T.posts(spark, d))).filter("author = 7")


@query(", n AS (SELECT narrative_id, count(*) AS posts, round(avg(final_score), 6) AS avg_score, any_value(campaign_id) AS c FROM posts WHERE account_id = 7 GROUP BY 1) SELECT narrative_id, posts, avg_score, CASE WHEN c IN ('view', 'click') THEN c END AS campaign_id FROM n")
def account_narratives(spark, d):
    p = T.plain_posts(spark, d)
    known = p.filter(F.col("campaign_id").isin("view", "click")).select("narrative_id", "campaign_id").distinct()
    return p.filter("account_id = 7").groupBy("narrative_id").agg(F.count(F.lit(1)).alias("posts"), V.avg6("final_score").alias("avg_score")).join(known, "narrative_id", "left")


@query("SELECT account_id, count(*) AS posts, round(avg(final_score), 6) AS avg_score, count(*) FILTER (prediction = 'synthetic') AS synthetic, count(is_duplicate_of) AS duplicates, sum(likes)::BIGINT AS engagement FROM posts WHERE campaign_id = 'view' GROUP BY 1 ORDER BY posts DESC, account_id LIMIT 20")
def campaign_accounts(spark, d):
    n = T.posts(spark, d).filter("campaign_id = 'view'").groupBy("account_id").agg(F.count(F.lit(1)).alias("posts"), V.avg6("final_score").alias("avg_score"), F.count_if(V.is_synthetic()).alias("synthetic"),
                                                                                   F.count("is_duplicate_of").alias("duplicates"), F.sum("likes").alias("engagement"))
    return n.orderBy(F.desc("posts"), "account_id").limit(20)


@query("SELECT hashtag, count(*) AS uses FROM posts WHERE campaign_id = 'view' GROUP BY 1 ORDER BY uses DESC, hashtag LIMIT 20")
def campaign_hashtags(spark, d):
    return T.plain_posts(spark, d).filter("campaign_id = 'view'").groupBy("hashtag").agg(F.count(F.lit(1)).alias("uses")).orderBy(F.desc("uses"), "hashtag").limit(20)


@query("SELECT community_id, count(DISTINCT account_id) AS accounts FROM posts WHERE campaign_id = 'view' GROUP BY 1 ORDER BY accounts DESC, community_id LIMIT 10")
def campaign_communities(spark, d):
    return T.plain_posts(spark, d).filter("campaign_id = 'view'").groupBy("community_id").agg(F.count_distinct("account_id").alias("accounts")).orderBy(F.desc("accounts"), "community_id").limit(10)


@query(_DUP + "SELECT narrative_id, copier, author, count(*) AS copies FROM e WHERE copier <> author AND narrative_id LIKE 'view-%' GROUP BY 1, 2, 3")
def campaign_duplicate_pairs(spark, d):
    e = V.duplicate_edges(T.posts(spark, d)).filter(F.col("narrative_id").startswith("view-") & (F.col("copier") != F.col("author")))
    return e.groupBy("narrative_id", "copier", "author").agg(F.count(F.lit(1)).alias("copies"))


@query(", a AS (SELECT account_id, count(*) AS posts, count(is_duplicate_of) AS duplicates, round(avg(final_score), 6) AS s FROM posts WHERE campaign_id = 'view' GROUP BY 1 ORDER BY posts DESC, account_id LIMIT 20) SELECT sum(posts)::BIGINT AS posts, sum(duplicates)::BIGINT AS copies, round(avg(s) FILTER (s <> 0), 5) AS avg_score, count(*) AS accounts FROM a")
def campaign_summary(spark, d):
    a = T.posts(spark, d).filter("campaign_id = 'view'").groupBy("account_id").agg(F.count(F.lit(1)).alias("posts"), F.count("is_duplicate_of").alias("duplicates"), V.avg6("final_score").alias("s")).orderBy(F.desc("posts"), "account_id").limit(20)
    return a.agg(F.sum("posts").alias("posts"), F.sum("duplicates").alias("copies"), F.round(F.avg(F.when(F.col("s") != 0, F.col("s"))), 5).alias("avg_score"), F.count(F.lit(1)).alias("accounts"))


@query(", m AS (SELECT DISTINCT campaign_id, account_id FROM posts) SELECT x.campaign_id AS campaign_a, y.campaign_id AS campaign_b, count(*) AS accounts FROM m x JOIN m y USING (account_id) WHERE x.campaign_id < y.campaign_id GROUP BY 1, 2")
def cross_campaign_accounts(spark, d):
    return V.cross_campaign(T.plain_posts(spark, d))


@query("SELECT DISTINCT n_regionkey AS project_id, o_orderpriority AS campaign_id FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def project_campaigns(spark, d):
    acc = T.accounts(spark, d).select("account_id", F.col("nation_id").alias("n_nationkey")).join(T.load(spark, d, "nation").select("n_nationkey", "n_regionkey"), "n_nationkey")
    return T.order_posts(spark, d).select("account_id", F.col("narrative_id").alias("campaign_id")).distinct().join(acc, "account_id").select(F.col("n_regionkey").alias("project_id"), "campaign_id").distinct()


@query("SELECT published_at::DATE AS day, account_id, platform, count(*) AS posts, count(is_duplicate_of) AS duplicates FROM posts GROUP BY 1, 2, 3")
def timeline_daily(spark, d):
    return V.timeline(T.posts(spark, d))


@query("SELECT published_at::DATE AS day, count(DISTINCT account_id) AS accounts, count(*) AS posts FROM posts WHERE narrative_id = 'view-3' GROUP BY 1 HAVING count(DISTINCT account_id) > 1 ORDER BY accounts DESC, posts DESC, day LIMIT 20")
def cooccurrence_days(spark, d):
    return V.cooccurrence(T.plain_posts(spark, d).filter("narrative_id = 'view-3'"))


_CADENCE = ", dd AS (SELECT account_id, published_at::DATE AS day, count(*) AS n FROM posts GROUP BY 1, 2), c AS (SELECT account_id, count(*) AS active_days, sum(n)::BIGINT AS posts, round(sum(n)::DOUBLE / count(*), 6) AS avg_per_day, max(n) AS max_per_day, min(n) AS min_per_day, round(sum(n)::DOUBLE / (max(day) - min(day) + 1), 6) AS avg_per_calendar_day FROM dd GROUP BY 1) "


@query(_CADENCE + "SELECT * FROM c ORDER BY posts DESC, account_id LIMIT 15")
def cadence(spark, d):
    return V.cadence(T.plain_posts(spark, d)).orderBy(F.desc("posts"), "account_id").limit(15)


@query(_CADENCE + "SELECT account_id, active_days, avg_per_day FROM c WHERE active_days > 20 AND avg_per_day >= 2.5")
def robotic_accounts(spark, d):
    return V.cadence(T.plain_posts(spark, d)).filter("active_days > 20 and avg_per_day >= 2.5").select("account_id", "active_days", "avg_per_day")


_MONTHS = ", mm AS (SELECT strftime(published_at, '%Y-%m') AS month, count(*) AS posts, count(DISTINCT account_id) AS accounts, count(*) FILTER (prediction = 'synthetic') AS synthetic, round(count(*) FILTER (prediction = 'synthetic')::DOUBLE / count(*), 6) AS synthetic_ratio FROM order_posts GROUP BY 1) "


@query(_MONTHS + "SELECT * FROM mm")
def monthly_evolution(spark, d):
    return V.monthly(T.order_posts(spark, d))


@query(_MONTHS + "SELECT month, synthetic_ratio FROM mm WHERE synthetic_ratio > 1.05::DOUBLE * (SELECT avg(synthetic_ratio) FROM mm) AND synthetic_ratio > 0.05")
def deepfake_spike_months(spark, d):
    return G.spread_over_mean(V.monthly(T.order_posts(spark, d)).select("month", "synthetic_ratio"), "synthetic_ratio", 1.05, 0.05)


@query(_MONTHS + "SELECT month, posts FROM mm WHERE posts > 1.02::DOUBLE * (SELECT avg(posts) FROM mm)")
def peak_months(spark, d):
    return G.spread_over_mean(V.monthly(T.order_posts(spark, d)).select("month", "posts"), "posts", 1.02)


@query(_MONTHS + "SELECT month, posts, repeat('█', greatest(1, round_even(posts::DOUBLE / (SELECT max(posts) FROM mm) * 20, 0)::INT)) AS bar FROM mm")
def monthly_ascii_bar(spark, d):
    m = V.monthly(T.order_posts(spark, d)).select("month", "posts")
    return m.withColumn("bar", F.repeat(F.lit("█"), F.greatest(F.lit(1), F.bround(F.col("posts") / F.max("posts").over(Window.partitionBy()) * 20).cast("int"))))


@query("SELECT account_id, min(published_at) AS first_post, max(published_at) AS last_post, count(*) AS posts FROM order_posts GROUP BY 1")
def propagation_order(spark, d):
    return V.propagation(T.order_posts(spark, d))


@query("SELECT narrative_id, arg_min(account_id, (published_at, post_id)) AS account_id, min(published_at) AS first_post FROM posts GROUP BY 1")
def seed_account(spark, d):
    return V.seed_account(T.plain_posts(spark, d))


@query("""SELECT account_id, f AS "from", t AS "to", (t::DATE - f::DATE) AS gap FROM (SELECT account_id, published_at AS f, lead(published_at) OVER (PARTITION BY account_id ORDER BY published_at) AS t FROM order_posts) WHERE t::DATE - f::DATE > 200""")
def silence_gaps(spark, d):
    return V.silence_gaps(T.order_posts(spark, d), 200)


@query(_MONTHS + "SELECT count(*) AS months, sum(posts)::BIGINT AS posts, max(posts) AS most, (SELECT count(DISTINCT account_id) FROM order_posts) AS accounts, (SELECT min(published_at) FROM order_posts) AS first_post FROM mm")
def temporal_summary(spark, d):
    p = T.order_posts(spark, d)
    m = V.monthly(p).agg(F.count(F.lit(1)).alias("months"), F.sum("posts").alias("posts"), F.max("posts").alias("most"))
    return m.crossJoin(p.agg(F.count_distinct("account_id").alias("accounts"), F.min("published_at").alias("first_post")))  # one row each


@query("SELECT doc_id, lang, source FROM documents WHERE lang = 'fr' AND source IN ('src1', 'src2') AND regexp_matches(text, '(?i)de la') AND n_chars >= 500")
def faceted_filter(spark, d):
    return T.load(spark, d, "documents").filter(facets(equal={"lang": "fr", "project": None}, within={"source": ["src1", "src2"]}, at_least={"n_chars": 500}, search=("text", "de la"))).select("doc_id", "lang", "source")


@query("SELECT post_id, account_id FROM posts WHERE account_id IN (SELECT account_id FROM accounts WHERE is_suspicious)")
def semi_join_in_list(spark, d):
    return T.plain_posts(spark, d).join(T.accounts(spark, d).filter("is_suspicious").select("account_id"), "account_id", "left_semi").select("post_id", "account_id")


@query("SELECT post_id, published_at, (SELECT least(count(*), 5000) FROM posts) AS total FROM posts ORDER BY published_at DESC, post_id LIMIT 20 OFFSET 40")
def paged_posts(spark, d):
    return page(T.plain_posts(spark, d), ["published_at", "post_id"], 3, 20).select("post_id", "published_at", "total")


@query("SELECT 'orders' AS collection, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'lineitem', l_linestatus, count(*) FROM lineitem GROUP BY 2")
def status_counters(spark, d):
    return status_counts({"orders": (T.load(spark, d, "orders"), "o_orderstatus"), "lineitem": (T.load(spark, d, "lineitem"), "l_linestatus")})


@query("SELECT r_name AS value, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def project_share(spark, d):
    c = T.load(spark, d, "customer").join(T.load(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(T.load(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return shares(c, "r_name")


@query("SELECT platform AS value, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM posts GROUP BY 1")
def platform_share(spark, d):
    return shares(T.plain_posts(spark, d), "platform")


@query("SELECT prediction, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 4) AS percent, round(avg(final_score), 6) AS avg_score FROM posts GROUP BY 1")
def label_distribution(spark, d):
    n = T.plain_posts(spark, d).groupBy("prediction").agg(F.count(F.lit(1)).alias("n"), V.avg6("final_score").alias("avg_score"))
    return n.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4))


@query("SELECT narrative_id, count(DISTINCT account_id) AS accounts, count(DISTINCT post_id) AS posts, string_agg(DISTINCT platform, ',' ORDER BY platform) AS platforms, round(avg(final_score), 6) AS avg_score, count(*) FILTER (prediction = 'synthetic') AS synthetic FROM posts GROUP BY 1")
def narrative_overview(spark, d):
    return T.plain_posts(spark, d).groupBy("narrative_id").agg(F.count_distinct("account_id").alias("accounts"), F.count_distinct("post_id").alias("posts"), F.array_join(F.sort_array(F.collect_set("platform")), ",").alias("platforms"),
                                                               V.avg6("final_score").alias("avg_score"), F.count_if(V.is_synthetic()).alias("synthetic"))


@query("SELECT account_id, count(*) AS posts, count(DISTINCT platform) AS platforms FROM posts GROUP BY 1 ORDER BY posts DESC, account_id LIMIT 20")
def active_accounts(spark, d):
    return T.plain_posts(spark, d).groupBy("account_id").agg(F.count(F.lit(1)).alias("posts"), F.count_distinct("platform").alias("platforms")).orderBy(F.desc("posts"), "account_id").limit(20)


@query("SELECT community_id, count(DISTINCT account_id) AS size, string_agg(DISTINCT platform, ',' ORDER BY platform) AS platforms FROM posts GROUP BY 1")
def community_overview(spark, d):
    return T.plain_posts(spark, d).groupBy("community_id").agg(F.count_distinct("account_id").alias("size"), F.array_join(F.sort_array(F.collect_set("platform")), ",").alias("platforms"))


@query("SELECT narrative_id, count(*) AS duplicates, round(avg(final_score), 6) AS avg_similarity FROM posts WHERE is_duplicate_of IS NOT NULL GROUP BY 1")
def narrative_duplication(spark, d):
    return T.posts(spark, d).filter("is_duplicate_of is not null").groupBy("narrative_id").agg(F.count(F.lit(1)).alias("duplicates"), V.avg6("final_score").alias("avg_similarity"))


_PCT = "SELECT {by}, count(*) AS posts, round(100.0::DOUBLE * count(*) FILTER (prediction = 'synthetic') / count(*), 1) AS synthetic_percent FROM posts GROUP BY 1 HAVING count(*) >= 3"


def _percent(p, by):
    return p.groupBy(by).agg(F.count(F.lit(1)).alias("posts"), F.round(100.0 * F.count_if(V.is_synthetic()) / F.count(F.lit(1)), 1).alias("synthetic_percent")).filter("posts >= 3")


@query(_PCT.format(by="narrative_id"))
def synthetic_ratio_narrative(spark, d):
    return _percent(T.plain_posts(spark, d), "narrative_id")


@query(_PCT.format(by="account_id"))
def synthetic_ratio_account(spark, d):
    return _percent(T.plain_posts(spark, d), "account_id")


@query("SELECT narrative_id, published_at::DATE AS day, count(*) AS posts FROM posts GROUP BY 1, 2 HAVING count(*) >= 5")
def narrative_daily_volume(spark, d):
    return T.plain_posts(spark, d).groupBy("narrative_id", V.day().alias("day")).agg(F.count(F.lit(1)).alias("posts")).filter("posts >= 5")


@query("SELECT account_id, min(published_at) AS created_at, count(*) AS posts FROM order_posts GROUP BY 1 HAVING min(published_at) > TIMESTAMP '1995-06-01' AND count(*) >= 5")
def recent_active_accounts(spark, d):
    p = T.order_posts(spark, d).groupBy("account_id").agg(F.min("published_at").alias("created_at"), F.count(F.lit(1)).alias("posts"))
    return p.filter((F.col("created_at") > F.lit("1995-06-01 00:00:00").cast("timestamp_ntz")) & (F.col("posts") >= 5))


@query("SELECT account_id, count(*) AS posts, round(100.0::DOUBLE * count(*) FILTER (prediction = 'synthetic') / count(*), 1) AS synthetic_percent, round(avg(final_score), 6) AS avg_score, coalesce(any_value(f), 0.0) AS followers FROM posts LEFT JOIN (SELECT account_id, followers AS f FROM accounts WHERE is_suspicious) USING (account_id) GROUP BY 1 HAVING count(*) >= 3")
def account_suspicion_table(spark, d):
    p = T.plain_posts(spark, d)
    f = T.accounts(spark, d).filter("is_suspicious").select("account_id", F.col("followers").alias("f"))
    n = p.groupBy("account_id").agg(F.count(F.lit(1)).alias("posts"), F.round(100.0 * F.count_if(V.is_synthetic()) / F.count(F.lit(1)), 1).alias("synthetic_percent"), V.avg6("final_score").alias("avg_score")).filter("posts >= 3")
    return n.join(f, "account_id", "left").select("account_id", "posts", "synthetic_percent", "avg_score", F.coalesce("f", F.lit(0.0)).alias("followers"))


@query("SELECT account_id, count(DISTINCT campaign_id) AS campaigns FROM posts GROUP BY 1 HAVING count(DISTINCT campaign_id) > 1")
def transversal_amplifiers(spark, d):
    return T.plain_posts(spark, d).groupBy("account_id").agg(F.count_distinct("campaign_id").alias("campaigns")).filter("campaigns > 1")


@query(", r AS (SELECT account_id, any_value(community_id) AS community_id, sum(likes)::BIGINT AS rank FROM posts GROUP BY 1) SELECT account_id, rank FROM r WHERE community_id = (SELECT community_id FROM r WHERE account_id = 8) AND community_id <> 0 AND account_id <> 8 ORDER BY rank DESC NULLS FIRST, account_id LIMIT 20")
def community_peers(spark, d):
    r = T.plain_posts(spark, d).groupBy("account_id", "community_id").agg(F.sum("likes").alias("rank"))
    own = r.filter("account_id = 8").select("community_id")
    return r.join(own, "community_id", "left_semi").filter("community_id <> 0 and account_id <> 8").orderBy(F.desc_nulls_first("rank"), "account_id").limit(20).select("account_id", "rank")


@query(", s AS (" + _SUMMARY + ") SELECT account_id, concat_ws(',', CASE WHEN synthetic_ratio >= 0.1 THEN 'media_scores' END, CASE WHEN posts >= 70 THEN 'temporal' END, CASE WHEN suspicious > synthetic THEN 'neighbors' END) AS calls FROM s WHERE synthetic_ratio >= 0.1 OR posts >= 70 OR suspicious > synthetic")
def enrichment_triggers(spark, d):
    return V.enrichment_triggers(V.deepfake_summary(T.plain_posts(spark, d)), 0.1, 70)


@query(_DUP + """, seed AS (SELECT DISTINCT arg_min(account_id, (published_at, post_id)) OVER (PARTITION BY narrative_id) AS a FROM posts), dd AS (SELECT account_id, published_at::DATE AS day, count(*) AS n FROM posts GROUP BY 1, 2),
rob AS (SELECT account_id FROM dd GROUP BY 1 HAVING count(*) > 20 AND round(sum(n)::DOUBLE / count(*), 6) >= 2.5), cop AS (SELECT copier, author, count(*) AS copies FROM e WHERE copier <> author GROUP BY 1, 2), tags AS (SELECT hashtag, count(*) AS uses FROM posts WHERE narrative_id = 'view-3' GROUP BY 1),
u AS (SELECT 'account:' || a AS target, 'high' AS priority, 'seed' AS reason FROM seed UNION ALL SELECT 'account:' || account_id, 'medium', 'robotic' FROM rob
UNION ALL SELECT 'account:' || copier, CASE WHEN copies >= 5 THEN 'high' ELSE 'medium' END, 'copier' FROM cop UNION ALL SELECT 'tag:' || hashtag, CASE WHEN uses >= 10 THEN 'high' ELSE 'watch' END, 'hashtag' FROM tags WHERE uses >= 3),
z AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, reason) AS rn FROM u) SELECT target, priority, reason FROM z WHERE rn = 1""")
def scraping_suggestions(spark, d):
    p = T.posts(spark, d)
    tags = p.filter("narrative_id = 'view-3'").groupBy("hashtag").agg(F.count(F.lit(1)).alias("uses"))
    return V.suggestions(V.seed_account(p), V.cadence(p).filter("active_days > 20 and avg_per_day >= 2.5"), V.copy_pairs(V.duplicate_edges(p)), tags)


@query(", s AS (" + _SUMMARY + """), m AS (SELECT o.account_id, max(m3) AS media_score, count(DISTINCT media_id) AS seen_count FROM order_posts o JOIN media_scores USING (post_id) GROUP BY 1), c AS (SELECT account_id, count(DISTINCT campaign_id) AS n_campaigns FROM posts WHERE campaign_id <> 'view' AND k > 60 GROUP BY 1)
SELECT account_id, round(least(1.0::DOUBLE, least(1.0::DOUBLE, (avg_score + synthetic_ratio + coalesce(media_score, 0)) / (CASE WHEN media_score IS NULL THEN 2 ELSE 3 END) + CASE WHEN coalesce(n_campaigns, 0) > 0 THEN 0.15::DOUBLE ELSE 0 END) + CASE WHEN coalesce(seen_count, 0) > 1 THEN 0.1::DOUBLE ELSE 0 END), 2) AS suspicion FROM s LEFT JOIN m USING (account_id) LEFT JOIN c USING (account_id)""")
def suspicion_score(spark, d):
    p = T.plain_posts(spark, d)
    media = T.media_scores(spark, d).join(T.order_posts(spark, d).select("post_id", "account_id"), "post_id").groupBy("account_id").agg(F.max("m3").alias("media_score"), F.count_distinct("media_id").alias("seen_count"))
    camp = p.filter("campaign_id <> 'view' and k > 60").groupBy("account_id").agg(F.count_distinct("campaign_id").alias("n_campaigns"))
    return V.suspicion(V.deepfake_summary(p), media, camp)


# fields that are declared with a meaning but computed nowhere else

_GAPS = ", g AS (SELECT account_id, epoch_us(lead(published_at) OVER (PARTITION BY account_id ORDER BY published_at, post_id)) - epoch_us(published_at) AS gap FROM posts) "


@query(_GAPS + "SELECT account_id, round(stddev_pop(gap / 1000000.0::DOUBLE), 3) AS post_regularity FROM g GROUP BY 1")
def bot_post_regularity(spark, d):
    w = Window.partitionBy("account_id").orderBy("published_at", "post_id")
    us = F.unix_micros(F.col("published_at").cast("timestamp"))
    p = T.plain_posts(spark, d).select("account_id", (F.lead(us).over(w) - us).alias("gap"))
    return p.groupBy("account_id").agg(F.round(F.stddev_pop(F.col("gap") / 1000000.0), 3).alias("post_regularity"))


@query("SELECT account_id, round(nation_id / nullif(followers, 0), 9) AS follower_ratio FROM accounts")
def bot_follower_ratio(spark, d):
    return T.accounts(spark, d).select("account_id", F.round(F.try_divide(F.col("nation_id"), F.col("followers")), 9).alias("follower_ratio"))


@query("SELECT account_id, round(avg(likes::DOUBLE) / nullif(any_value(followers), 0), 6) AS avg_engagement FROM posts JOIN accounts USING (account_id) GROUP BY 1")
def bot_avg_engagement(spark, d):
    p = T.plain_posts(spark, d).groupBy("account_id").agg(F.avg("likes").alias("m"))
    return p.join(T.accounts(spark, d).select("account_id", "followers"), "account_id").select("account_id", F.round(F.try_divide(F.col("m"), F.col("followers")), 6).alias("avg_engagement"))


@query("SELECT account_id, DATE '2002-01-01' - min(published_at)::DATE AS account_age_days FROM order_posts GROUP BY 1")
def bot_account_age(spark, d):
    return T.order_posts(spark, d).groupBy("account_id").agg(F.date_diff(F.lit("2002-01-01").cast("date"), F.min("published_at").cast("date")).cast("long").alias("account_age_days"))


@query(", dd AS (SELECT account_id, published_at::DATE AS day, count(*) AS n FROM posts GROUP BY 1, 2) SELECT account_id, round(max(n) / avg(n), 6) AS burst_score FROM dd GROUP BY 1")
def bot_burst_score(spark, d):
    dd = T.plain_posts(spark, d).groupBy("account_id", V.day().alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return dd.groupBy("account_id").agg(F.round(F.max("n") / F.avg("n"), 6).alias("burst_score"))


@query(", b AS (SELECT account_id, count(*) FILTER (prediction = 'synthetic')::DOUBLE / count(*) AS s FROM posts GROUP BY 1) SELECT campaign_id, round(avg(CASE WHEN s >= 0.1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS bot_accounts_ratio FROM (SELECT DISTINCT campaign_id, account_id FROM posts) JOIN b USING (account_id) GROUP BY 1")
def campaign_bot_ratio(spark, d):
    p = T.plain_posts(spark, d)
    b = p.groupBy("account_id").agg((F.count_if(V.is_synthetic()) / F.count(F.lit(1))).alias("s"))
    return p.select("campaign_id", "account_id").distinct().join(b, "account_id").groupBy("campaign_id").agg(F.round(F.avg(F.when(F.col("s") >= 0.1, 1.0).otherwise(0.0)), 6).alias("bot_accounts_ratio"))


@query("SELECT is_duplicate_of AS original_id, published_at::DATE AS day, count(*) AS forwards FROM posts WHERE platform = 'telegram' AND is_duplicate_of IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2")
def telegram_forward_burst(spark, d):
    p = T.posts(spark, d).filter("platform = 'telegram' and is_duplicate_of is not null")
    return p.groupBy(F.col("is_duplicate_of").alias("original_id"), V.day().alias("day")).agg(F.count(F.lit(1)).alias("forwards")).filter("forwards >= 2")


@query(", dd AS (SELECT narrative_id, published_at::DATE AS day, count(*) AS n FROM posts GROUP BY 1, 2) SELECT narrative_id, count(*) AS post_count, count(DISTINCT account_id) AS account_count, min(published_at) AS first_seen_at, any_value(peak) AS peak_date, round(count(*) FILTER (prediction = 'synthetic')::DOUBLE / count(*), 6) AS synthetic_ratio FROM posts JOIN (SELECT narrative_id, arg_max(day, (n, -epoch(day))) AS peak FROM dd GROUP BY 1) USING (narrative_id) GROUP BY 1")
def narrative_stats(spark, d):
    p = T.plain_posts(spark, d)
    daily = p.groupBy("narrative_id", V.day().alias("day")).agg(F.count(F.lit(1)).alias("n"))
    peak = daily.groupBy("narrative_id").agg(F.max(F.struct("n", (-F.unix_date("day")).alias("e"), "day")).alias("t")).select("narrative_id", F.col("t.day").alias("peak_date"))
    return p.groupBy("narrative_id").agg(F.count(F.lit(1)).alias("post_count"), F.count_distinct("account_id").alias("account_count"), F.min("published_at").alias("first_seen_at"),
                                         F.round(F.count_if(V.is_synthetic()) / F.count(F.lit(1)), 6).alias("synthetic_ratio")).join(peak, "narrative_id")


@query("SELECT c.conv_id, c.turn, p.turn AS parent_turn, c.turn AS depth FROM conversations c LEFT JOIN conversations p ON c.conv_id = p.conv_id AND p.turn = c.turn - 1")
def comment_threads(spark, d):
    c = T.load(spark, d, "conversations").select("conv_id", "turn")
    w = Window.partitionBy("conv_id").orderBy("turn")
    before = F.lag("turn").over(w)
    return c.select("conv_id", "turn", F.when(before == F.col("turn") - 1, before).alias("parent_turn"), F.col("turn").alias("depth"))


@query("SELECT account_id, string_agg(DISTINCT campaign_id, ',' ORDER BY campaign_id) AS campaign_ids FROM posts GROUP BY 1")
def account_campaign_ids(spark, d):
    return T.plain_posts(spark, d).groupBy("account_id").agg(F.array_join(F.sort_array(F.collect_set("campaign_id")), ",").alias("campaign_ids"))
