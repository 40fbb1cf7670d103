"""Ingest, normalisation and keyed writes, bound to the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from flockscope import tables as T
from flockscope.functions import scalars as S
from flockscope.operators import store
from flockscope.plans.catalog import query
from flockscope.sources.keyed import KeyedTable
from flockscope.sources.shared import shared_folder


@query("""SELECT page_id, split_part(url, '/', 3) AS project, regexp_replace(split_part(url, '/', 4), '^converted_', '') AS scan, nullif(split_part(url, '/', 5), '') AS user_name FROM pages""")
def path_source_context(spark, d):
    part = lambda n: F.split_part("url", F.lit("/"), F.lit(n))
    return T.load(spark, d, "pages").select("page_id", part(3).alias("project"), F.regexp_replace(part(4), "^converted_", "").alias("scan"), S.truthy(part(5)).alias("user_name"))


@query("""SELECT 'new' AS change, o_orderkey AS id FROM orders WHERE NOT EXISTS (SELECT 1 FROM events WHERE event_id * 2 = o_orderkey)
UNION ALL SELECT 'gone', event_id * 2 FROM events WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = event_id * 2)""")
def incremental_cursor_antijoin(spark, d):
    listing = T.load(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    cursor = T.load(spark, d, "events").select((F.col("event_id") * 2).alias("id"))
    return store.cursor_changes(listing, cursor, ["id"])


@query("SELECT vec_id, label FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) = 64")
def embedding_load_filter(spark, d):
    return T.load(spark, d, "embeddings").filter(F.size("embedding") == 64).select("vec_id", "label")


@query("SELECT DISTINCT source AS value FROM documents WHERE source IS NOT NULL AND source <> '' ORDER BY 1")
def distinct_facet(spark, d):
    return store.distinct_values(T.load(spark, d, "documents"), "source")


@query("""SELECT DISTINCT ON (user_id, event_type) user_id, event_type, event_id AS first_event FROM events
WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = user_id AND c_acctbal < 0) ORDER BY user_id, event_type, event_id""")
def upsert_insert_only(spark, d):
    new = T.load(spark, d, "events").select("user_id", "event_type", F.col("event_id").alias("first_event"))
    have = T.load(spark, d, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("user_id"))
    return store.keep_first(new, ["user_id", "event_type"], ["first_event"]).join(have, "user_id", "left_anti")


@query("""SELECT post_id, media_id, position, concat_ws(',', 'm1=' || round(m1, 3), 'm2=' || round(m2, 3)) AS scores FROM media_scores""")
def score_prefix_maps(spark, d):
    m = T.media_scores(spark, d).select("post_id", "media_id", "position", F.create_map(
        F.lit("score_m1"), F.round("m1", 3), F.lit("raw_m1"), F.col("m1"), F.lit("score_m2"), F.round("m2", 3)).alias("result"))
    scores = store.prefix_map("result", "score_")
    return m.select("post_id", "media_id", "position", F.array_join(F.transform(F.array_sort(F.map_entries(scores)), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("scores"))


@query("""SELECT l_partkey AS media_id, count(DISTINCT l_orderkey) AS seen_count, count(*) + 1 AS legacy_seen_count, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS platforms FROM lineitem GROUP BY 1""")
def media_reuse(spark, d):
    return store.media_reuse(T.load(spark, d, "lineitem").select(F.col("l_partkey").alias("media_id"), F.col("l_orderkey").alias("post_id"), F.col("l_returnflag").alias("platform")))


@query("""SELECT l_orderkey AS post_id, true AS has_media, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey) AS media_ids FROM lineitem GROUP BY 1""")
def post_media_refs(spark, d):
    refs = T.load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("post_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("r"))
    return refs.select("post_id", F.lit(True).alias("has_media"), F.array_join(F.transform("r", lambda x: x["l_partkey"].cast("string")), ",").alias("media_ids"))


@query("""SELECT account_id, arg_max(platform, (published_at, post_id)) AS platform, max(published_at) AS updated_at FROM posts GROUP BY 1""")
def graph_nodes_latest(spark, d):
    return store.keep_last(T.plain_posts(spark, d).select("account_id", "platform", "published_at", "post_id"), ["account_id"], ["published_at", "post_id"]).select(
        "account_id", "platform", F.col("published_at").alias("updated_at"))


@query("SELECT DISTINCT user_id AS src, event_id % 2000 AS dst FROM events JOIN customer ON c_custkey = user_id JOIN part ON p_partkey = event_id % 2000")
def graph_edges_matched(spark, d):
    edges = T.load(spark, d, "events").select(F.col("user_id").alias("src"), (F.col("event_id") % 2000).alias("dst"))
    return store.matched_edges(edges, T.load(spark, d, "customer").select(F.col("c_custkey").alias("id")), T.load(spark, d, "part").select(F.col("p_partkey").alias("id")))


def _table(spark, key, buckets=16):
    return KeyedTable(spark, f"{shared_folder(spark)}/keyed/{uuid.uuid4().hex}", key, buckets)


@query("SELECT user_id, event_type, min(event_id) AS first_event FROM events GROUP BY 1, 2")
def keyed_first_writes(spark, d):
    """Events written twice into a table that keeps the first of each key."""
    t = _table(spark, ["user_id", "event_type"])
    rows = T.load(spark, d, "events").select("user_id", "event_type", F.col("event_id").alias("first_event"))
    for _ in range(2):
        t.insert_absent(rows, ["first_event"])
    return t.read()


@query("""SELECT coalesce(n.account_id, a.account_id) AS account_id, coalesce(a.platform, n.platform) AS platform, n.updated_at, a.username, a.followers
FROM (SELECT account_id, arg_max(platform, (published_at, post_id)) AS platform, max(published_at) AS updated_at FROM posts GROUP BY 1) n FULL JOIN accounts a ON a.account_id = n.account_id""")
def keyed_account_nodes(spark, d):
    """Account nodes from posts, then from profiles, field by field; the second write again."""
    t = _table(spark, ["account_id"])
    t.upsert(T.plain_posts(spark, d).select("account_id", "platform", F.col("published_at").alias("updated_at"), "post_id"), ["updated_at", "post_id"])
    profiles = T.accounts(spark, d).select("account_id", "platform", "username", "followers")
    for _ in range(2):
        t.upsert(profiles, [])
    return t.read().select("account_id", "platform", "updated_at", "username", "followers")


@query("""SELECT DISTINCT ON (src, dst) user_id AS src, event_id % 2000 AS dst, event_type AS kind FROM events JOIN customer ON c_custkey = user_id JOIN part ON p_partkey = event_id % 2000 ORDER BY src, dst, event_id DESC""".replace("(src, dst) user_id", "(user_id, event_id % 2000) user_id").replace("ORDER BY src, dst", "ORDER BY user_id, event_id % 2000"))
def keyed_edges(spark, d):
    """Edges with both ends there, their properties as last written."""
    ends = lambda name, c: T.load(spark, d, name).select(F.col(c).alias("id"))
    edges = T.load(spark, d, "events").select(F.col("user_id").alias("src"), (F.col("event_id") % 2000).alias("dst"), F.col("event_type").alias("kind"), "event_id")
    both = edges.join(ends("customer", "c_custkey"), F.col("src") == F.col("id"), "left_semi").join(ends("part", "p_partkey"), F.col("dst") == F.col("id"), "left_semi")
    t = _table(spark, ["src", "dst"])
    t.upsert(both, ["event_id"])
    return t.read().select("src", "dst", "kind")


@query("SELECT l_partkey AS media_id, array_to_string(list_sort(list(DISTINCT l_orderkey::VARCHAR)), ',') AS posts, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS platforms, count(*) AS touched FROM lineitem GROUP BY 1")
def keyed_media_reuse(spark, d):
    """Posts and platforms of each medium, added return flag by return flag."""
    use = T.load(spark, d, "lineitem").select(F.col("l_partkey").alias("media_id"), F.col("l_orderkey").cast("string").alias("posts"), F.col("l_returnflag").alias("platforms"))
    t = _table(spark, ["media_id"])
    for flag in ("A", "N", "R"):
        t.accumulate(use.filter(F.col("platforms") == flag), ["posts", "platforms"], "touched")
    return t.read().select("media_id", F.array_join("posts", ",").alias("posts"), F.array_join("platforms", ",").alias("platforms"), "touched")


@query("SELECT post_id, prediction FROM order_posts WHERE prediction <> 'synthetic'")
def keyed_purge(spark, d):
    t = _table(spark, ["post_id"])
    t.insert_absent(T.order_posts(spark, d).select("post_id", "prediction"), [])
    t.delete(F.col("prediction") == "synthetic")
    t.vacuum(1)
    return t.read()


@query("""SELECT 'posts' AS collection, count(*) AS total, count(*) FILTER (prediction = 'synthetic') AS to_purge, count(*) FILTER (prediction <> 'likely_real') AS to_reset FROM posts
UNION ALL SELECT 'order_posts', count(*), count(*) FILTER (prediction = 'synthetic'), count(*) FILTER (prediction <> 'likely_real') FROM order_posts""")
def purge_preview_counts(spark, d):
    return store.purge_preview({"posts": T.plain_posts(spark, d), "order_posts": T.order_posts(spark, d)}, F.col("prediction") == "synthetic", F.col("prediction") != "likely_real")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' OR o_orderdate > TIMESTAMP '2000-01-08' - INTERVAL 7 DAY")
def ttl_filter(spark, d):
    o = T.load(spark, d, "orders")
    done = F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))
    return store.not_expired(o, done, F.lit("2000-01-08 00:00:00").cast("timestamp_ntz"), 7).select("o_orderkey")


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def unique_key_violations(spark, d):
    return store.key_violations(T.load(spark, d, "events"), ["user_id", "event_type"])


@query("SELECT event_id, CASE WHEN lower(event_type) = 'view' THEN 'view' ELSE lower(event_type) END AS platform, CASE WHEN user_id % 5 = 0 THEN 'twitter' ELSE 'tiktok' END AS alias FROM events")
def normalize_platform(spark, d):
    e = T.load(spark, d, "events")
    return e.select("event_id", S.normalize_platform(F.initcap("event_type")).alias("platform"), S.normalize_platform(F.when(F.col("user_id") % 5 == 0, "X").otherwise("TikTok")).alias("alias"))


@query("""SELECT event_id, coalesce(CASE WHEN k % 3 = 0 THEN 'https://given/' || k END, CASE platform WHEN 'twitter' THEN 'https://twitter.com/u' || account_id || '/status/' || post_id WHEN 'tiktok' THEN 'https://www.tiktok.com/@u' || account_id || '/video/' || post_id
 WHEN 'instagram' THEN 'https://www.instagram.com/p/' || post_id || '/' ELSE 'https://t.me/s/' || post_id END) AS url FROM (SELECT post_id AS event_id, * FROM posts)""")
def infer_post_url(spark, d):
    p = T.plain_posts(spark, d)
    given = F.when(F.col("k") % 3 == 0, F.concat(F.lit("https://given/"), F.col("k").cast("string"))).otherwise("")
    post = F.when(F.col("platform") == "telegram", F.concat(F.col("post_id").cast("string"), F.lit("/7"))).otherwise(F.col("post_id").cast("string"))
    return p.select(F.col("post_id").alias("event_id"), S.infer_post_url(given, F.col("platform"), post, F.concat(F.lit("u"), F.col("account_id").cast("string"))).alias("url"))


@query("SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'image' WHEN page_id % 4 = 1 THEN 'video' WHEN page_id % 4 = 2 THEN 'image' END AS media_type FROM pages")
def infer_media_type(spark, d):
    m = F.col("page_id") % 4
    return T.load(spark, d, "pages").select("page_id", S.infer_media_type(F.when(m == 0, "image").otherwise(""), F.when(m == 1, F.col("url")).otherwise(""), F.when(m == 2, F.col("url"))).alias("media_type"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE date_trunc('second', ts) END AS parsed FROM events""")
def parse_datetime(spark, d):
    e, m = T.load(spark, d, "events"), F.col("event_id") % 4
    text = (F.when(m == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(m == 1, F.lit("1970-01-01T00:00:00+00:00")).when(m == 2, F.lit("02/09/2025"))
            .otherwise(F.unix_timestamp(F.col("ts").cast("timestamp")).cast("string")))
    return e.select("event_id", S.parse_datetime(text).cast("timestamp_ntz").alias("parsed"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_custkey::VARCHAR WHEN c_custkey % 3 = 1 THEN c_name ELSE 'unknown' END AS account FROM customer")
def account_key(spark, d):
    m = F.col("c_custkey") % 3
    return T.load(spark, d, "customer").select("c_custkey", S.account_key(F.when(m == 0, F.col("c_custkey").cast("string")), F.lit(""), F.when(m == 1, F.col("c_name")).otherwise("")).alias("account"))


@query("""SELECT conv_id AS post_id, conv_id || '_c' || turn AS comment_id, role AS author, CASE WHEN turn > 0 THEN 1 ELSE 0 END AS depth, length(text) AS chars FROM conversations""")
def explode_comments(spark, d):
    c = T.load(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("comments"))
    return store.explode_comments(c.withColumnRenamed("conv_id", "post_id"))


@query("""SELECT post_id, CASE WHEN k % 7 = 0 THEN 'no_info' WHEN k % 5 = 0 THEN 'unknown_platform' WHEN k % 3 = 0 THEN 'no_id' ELSE '' END AS fatal,
 CASE WHEN k % 2 = 0 THEN 'no_url' ELSE '' END AS warning, NOT (k % 7 = 0 OR k % 5 = 0 OR k % 3 = 0) AS valid FROM posts""")
def validate_records(spark, d):
    p = T.plain_posts(spark, d)
    fatal = store.codes({"no_info": F.col("k") % 7 == 0, "unknown_platform": F.col("k") % 5 == 0, "no_id": F.col("k") % 3 == 0})
    warn = store.codes({"no_url": F.col("k") % 2 == 0})
    return p.select("post_id", F.coalesce(F.get(fatal, F.lit(0)), F.lit("")).alias("fatal"), F.array_join(warn, ",").alias("warning"), (F.size(fatal) == 0).alias("valid"))


@query("SELECT page_id, CASE WHEN len(string_split(substr(url, 9), '/')) = 2 THEN split_part(substr(url, 9), '/', 1) END AS channel, CASE WHEN len(string_split(substr(url, 9), '/')) = 2 THEN split_part(substr(url, 9), '/', 2) END AS message FROM pages")
def telegram_split(spark, d):
    parts = F.split(F.expr("substring(url, 9)"), "/")
    two = F.size(parts) == 2
    return T.load(spark, d, "pages").select("page_id", F.when(two, F.get(parts, F.lit(0))).alias("channel"), F.when(two, F.get(parts, F.lit(1))).alias("message"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN NULL ELSE source END AS source, lang FROM documents")
def clean_nulls(spark, d):
    m = F.col("doc_id") % 3
    out = T.load(spark, d, "documents").select("doc_id", F.when(m == 0, "").when(m == 1, "1970-01-01T00:00:00Z").otherwise(F.col("source")).alias("source"), "lang")
    return store.clean_frame(out)


@query("SELECT post_id, 'k' || k || ',' || platform AS tags FROM posts")
def normalize_hashtags(spark, d):
    tags = F.array(F.concat(F.lit("##K"), F.col("k").cast("string")), F.lit("  "), F.concat(F.lit("#"), F.initcap("platform"), F.lit(" ")), F.concat(F.lit("#k"), F.col("k").cast("string")))
    return T.plain_posts(spark, d).select("post_id", F.array_join(S.normalize_hashtags(tags), ",").alias("tags"))


@query("SELECT account_id, username, platform, substr(segment, 1, 5) AS bio, coalesce(followers, 0) AS followers, is_suspicious FROM accounts")
def account_node(spark, d):
    return T.accounts(spark, d).select("account_id", "username", "platform", F.substring("segment", 1, 5).alias("bio"), F.coalesce("followers", F.lit(0.0)).alias("followers"), "is_suspicious")


@query("SELECT doc_id, substr(text, 1, 500) AS text, lang, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id AND toxic = 1) AS is_flagged FROM documents")
def post_node(spark, d):
    flagged = T.load(spark, d, "labels").filter("toxic = 1").select("doc_id").distinct().withColumn("f", F.lit(True))
    return T.load(spark, d, "documents").join(flagged, "doc_id", "left").select("doc_id", F.substring("text", 1, 500).alias("text"), "lang", F.coalesce("f", F.lit(False)).alias("is_flagged"))


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '…' ELSE text END AS preview FROM documents")
def text_preview(spark, d):
    return T.load(spark, d, "documents").select("doc_id", S.text_preview(F.col("text")).alias("preview"))


@query("""SELECT o_orderkey AS job_id, rn AS place FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_orderdate, o_orderkey) AS rn FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_orderkey % 4 < 3) WHERE rn <= 8""")
def claim_jobs(spark, d):
    jobs = T.load(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").alias("created_at"),
                                             F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "P", "retrying").otherwise("done").alias("status"), (F.col("o_orderkey") % 4).alias("attempts"))
    return store.claim_jobs(jobs, 8)


@query("""SELECT platform, count(*) AS files, count(*) FILTER (k % 10 <> 0) AS ok, count(*) FILTER (k % 10 = 0) AS errors, sum(likes)::BIGINT AS media, round(count(*) FILTER (k % 10 <> 0)::DOUBLE / count(*), 6) AS rate FROM posts GROUP BY 1""")
def import_summary(spark, d):
    bad = F.col("k") % 10 == 0
    return T.plain_posts(spark, d).groupBy("platform").agg(F.count(F.lit(1)).alias("files"), F.count_if(~bad).alias("ok"), F.count_if(bad).alias("errors"), F.sum("likes").alias("media"), F.round(F.count_if(~bad) / F.count(F.lit(1)), 6).alias("rate"))


@query("""SELECT w AS warning, count(*) AS n, w IN ('no_url') AS expected FROM (SELECT unnest(list_filter([CASE WHEN k % 2 = 0 THEN 'no_url' END, CASE WHEN k % 3 = 0 THEN 'no_media' END], lambda x: x IS NOT NULL)) AS w FROM posts) GROUP BY 1""")
def warning_counts(spark, d):
    w = store.codes({"no_url": F.col("k") % 2 == 0, "no_media": F.col("k") % 3 == 0})
    out = T.plain_posts(spark, d).select(F.explode(w).alias("warning")).groupBy("warning").agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("expected", F.col("warning").isin("no_url"))


@query("SELECT DISTINCT project FROM (SELECT r_name AS project FROM region UNION ALL SELECT n_name FROM nation)")
def distinct_projects(spark, d):
    a, b = T.load(spark, d, "region").select(F.col("r_name").alias("project")), T.load(spark, d, "nation").select(F.col("n_name").alias("project"))
    return a.unionByName(b).distinct()
