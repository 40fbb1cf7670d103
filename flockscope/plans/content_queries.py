"""Files, texts, vectors and keyed patches, bound to the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from flockscope import tables as T
from flockscope.functions import scalars as S
from flockscope.operators import comembers, hierarchy, language, manifold, narratives, neighbours, store
from flockscope.operators import investigation as V
from flockscope.plans.catalog import query
from flockscope.sources import scraper

_FILES = ", l AS (SELECT o_orderkey AS path, o_orderkey % 10 AS size, (o_orderkey % 7)::DOUBLE AS mtime FROM orders), c AS (SELECT event_id AS path, event_id % 10 + CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END AS size, event_id % 7 + 0.6::DOUBLE * (event_id % 3) AS mtime FROM events) "


def _files(spark, d):
    o, e = F.col("o_orderkey"), F.col("event_id")
    listing = T.load(spark, d, "orders").select(o.alias("path"), (o % 10).alias("size"), (o % 7).cast("double").alias("mtime"))
    cursor = T.load(spark, d, "events").select(e.alias("path"), (e % 10 + F.when(e % 4 == 0, 1).otherwise(0)).alias("size"), (e % 7 + F.lit(0.6) * (e % 3)).alias("mtime"))
    return listing, cursor


@query(_FILES + "SELECT coalesce(l.path, c.path) AS path, CASE WHEN l.path IS NULL THEN 'gone' WHEN c.path IS NULL THEN 'new' WHEN l.size = c.size AND abs(l.mtime - c.mtime) < 1 THEN 'unchanged' ELSE 'changed' END AS change FROM l FULL JOIN c ON l.path = c.path")
def file_changes(spark, d):
    return store.file_changes(*_files(spark, d))


@query(_FILES + "SELECT path, size, mtime FROM l WHERE path % 5 <> 0 UNION ALL SELECT path, size, round(mtime, 6) FROM c WHERE path % 5 = 0 AND path IN (SELECT path FROM l)")
def cursor_after_run(spark, d):
    listing, cursor = _files(spark, d)
    results = listing.select("path", F.when(F.col("path") % 5 == 0, 2).otherwise(0).alias("errors"))
    return store.mark_done(cursor, listing, results).withColumn("mtime", F.round("mtime", 6))


@query("SELECT page_id, CASE WHEN page_id % 2 > 0 AND page_id % 3 = 0 THEN 'inbox' ELSE 'done' END AS state, CASE WHEN page_id % 2 > 0 AND page_id % 3 = 0 THEN 'f' || page_id || '.error.json' ELSE 'f' || page_id || '.json' END AS name FROM pages")
def inbox_states(spark, d):
    p = F.col("page_id")
    rows = T.load(spark, d, "pages").select(F.concat(F.lit("/in/f"), p.cast("string"), F.lit(".json")).alias("path"), (p % 2).alias("errors"), (p % 3).alias("ok"))
    return store.inbox_states(rows).select(F.regexp_extract("path", r"f(\d+)", 1).cast("long").alias("page_id"), "state", "name")


@query("SELECT page_id, ['video', 'audio', 'gif', 'image', 'image'][page_id % 5 + 1] AS kind FROM pages")
def media_kinds(spark, d):
    ext = F.element_at(F.array(*map(F.lit, [".MP4", "aac", ".gif", "png", "xyz"])), (F.col("page_id") % 5 + 1).cast("int"))
    return T.load(spark, d, "pages").select("page_id", scraper.media_kind(ext).alias("kind"))


@query("SELECT post_id, coalesce(CASE WHEN p = '' THEN NULL END, '') || CASE WHEN k % 7 = 0 THEN 'no_info,' ELSE '' END || CASE WHEN k % 5 = 0 THEN 'unknown_platform,' ELSE '' END || CASE WHEN k % 3 = 0 THEN 'no_id,' ELSE '' END AS fatal, CASE WHEN platform = 'twitter' AND k % 4 = 0 AND k % 5 <> 0 THEN 'id_is_author,' ELSE '' END || CASE WHEN k % 2 = 0 THEN 'no_url,' ELSE '' END AS warnings FROM (SELECT *, '' AS p FROM posts)")
def validated_exports(spark, d):
    """The rules that the importer applies, on posts that break them here and there."""
    p, k = T.plain_posts(spark, d), F.col("k")
    post = F.when(k % 3 == 0, "").otherwise(F.col("post_id").cast("string"))
    fatal, warn = scraper.validation(post, F.when(k % 5 == 0, "elsewhere").otherwise(F.col("platform")), F.when(k % 4 == 0, post).otherwise("someone"), F.when(k % 2 == 0, "").otherwise("https://x"), F.lit("video"),
                                     F.when(k % 7 != 0, F.struct(F.lit(1).alias("v"))))
    listed = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x, F.lit(","))), "")
    return p.select("post_id", listed(fatal).alias("fatal"), listed(warn).alias("warnings"))


# scores and texts

@query("SELECT post_id, media_id, position, round(CASE WHEN a IS NULL AND b IS NULL THEN 0 ELSE (coalesce(a, 0) + coalesce(b, 0)) / ((a IS NOT NULL)::INT + (b IS NOT NULL)::INT) END, 6) AS score FROM (SELECT *, CASE WHEN position % 2 = 0 THEN m1 END AS a, CASE WHEN position % 3 = 0 THEN m2 END AS b FROM media_scores)")
def plain_mean(spark, d):
    m, p = T.media_scores(spark, d), F.col("position")
    return m.select("post_id", "media_id", "position", F.round(S.plain_mean([F.when(p % 2 == 0, F.col("m1")), F.when(p % 3 == 0, F.col("m2"))]), 6).alias("score"))


@query("SELECT post_id, round(CASE k % 4 WHEN 0 THEN final_score WHEN 1 THEN 1 - final_score WHEN 2 THEN 0.25 ELSE 0.75 END, 6) AS score FROM posts")
def label_ai_score(spark, d):
    k, s = F.col("k") % 4, F.col("final_score")
    pair = lambda a, x, b, y: F.array(F.struct(F.lit(a).alias("label"), x.alias("score")), F.struct(F.lit(b).alias("label"), y.alias("score")))
    results = F.when(k == 0, pair("AI-generated", s, "human", 1 - s)).when(k == 1, pair("Original photo", s, "Deep Fake", 1 - s)).when(k == 2, pair("left", F.lit(0.75), "right", F.lit(0.25))).otherwise(pair("x", F.lit(0.1), "synthetic", F.lit(0.75)))
    return T.plain_posts(spark, d).select("post_id", F.round(S.ai_score(results), 6).alias("score"))


LANGUAGES = ("de", "en", "es", "fr")

_LANG = """, lt AS (SELECT doc_id, lang, coalesce(text, '') AS text, ' ' || trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}]+', ' ', 'g')) || ' ' AS t FROM documents),
gr AS (SELECT doc_id, lang, gram, count(*) AS n FROM (SELECT doc_id, lang, t[i:i + 2] AS gram FROM (SELECT doc_id, lang, t, unnest(range(1, length(t) - 1)) AS i FROM lt)) GROUP BY ALL),
lc AS (SELECT lang, gram, sum(n) AS n FROM gr WHERE lang IN ('de', 'en', 'es', 'fr') GROUP BY 1, 2),
vo AS (SELECT DISTINCT gram FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) AS p FROM lc) WHERE p <= 500),
tot AS (SELECT l.lang, coalesce(sum(n), 0) AS total FROM (SELECT unnest(['de', 'en', 'es', 'fr']) AS lang) l LEFT JOIN (SELECT lang, n FROM lc JOIN vo USING (gram)) c ON c.lang = l.lang GROUP BY 1),
lp AS (SELECT vo.gram, tot.lang, ln((coalesce(n, 0) + 1)::DOUBLE / (total + (SELECT count(*) FROM vo))) AS p FROM vo CROSS JOIN tot LEFT JOIN lc ON lc.gram = vo.gram AND lc.lang = tot.lang),
sc AS (SELECT doc_id, lp.lang, sum(n * p) AS s FROM gr JOIN lp USING (gram) GROUP BY 1, 2),
sh AS (SELECT doc_id, lang, exp(s - max(s) OVER (PARTITION BY doc_id)) / sum(exp(s - m)) OVER (PARTITION BY doc_id) AS share FROM (SELECT *, max(s) OVER (PARTITION BY doc_id) AS m FROM sc)),
bs AS (SELECT doc_id, arg_max(lang, share) AS best, max(share) AS one, list_sort(list(share), 'DESC')[2] AS two FROM sh GROUP BY 1),
g AS (SELECT doc_id, text, CASE WHEN one - two >= 0.1::DOUBLE AND best IN ('fr', 'en') THEN best ELSE 'other' END AS language FROM lt LEFT JOIN bs USING (doc_id)) """


def _languages(spark, d):
    docs = T.load(spark, d, "documents")
    return language.detect(docs.select("doc_id", "text"), "text", language.profiles(docs, LANGUAGES), LANGUAGES)


@query(_LANG + "SELECT doc_id, language FROM g")
def detected_language(spark, d):
    """Profiles from all documents, then each document's language."""
    return _languages(spark, d).select("doc_id", "language")


def french_stand_in():
    """Stands for the French model: its labels are stars."""
    return lambda texts: [(f"{n} star{'s' * (n > 1)}", 0.5) for n in (len(t) % 5 + 1 for t in texts)]


def english_stand_in():
    """Stands for the English model: its labels are numbered."""
    return lambda texts: [(f"LABEL_{len(t) % 3}", 0.75) for t in texts]


@query(_LANG + """SELECT doc_id, CASE WHEN length(t) < 3 THEN 'neutral' WHEN language = 'fr' THEN ['negative', 'negative', 'neutral', 'positive', 'positive'][length(t) % 5 + 1] ELSE ['negative', 'neutral', 'positive'][length(t) % 3 + 1] END AS label,
CASE WHEN length(t) < 3 THEN 0.0::DOUBLE WHEN language = 'fr' THEN 0.5::DOUBLE ELSE 0.75::DOUBLE END AS score, CASE WHEN length(t) < 3 THEN 'skipped' WHEN language = 'fr' THEN 'fr' ELSE 'en' END AS model FROM (SELECT doc_id, language, trim(text, ' ') AS t FROM g)""")
def text_sentiment(spark, d):
    """Which model speaks and what its label means; stand-ins for the models answer by a text's length."""
    return language.sentiments(_languages(spark, d), "text", "language", french_stand_in, english_stand_in).select("doc_id", "label", "score", "model")


# vectors and hashes

@query()
def half_precision_vectors(spark, d):
    """Vectors as bytes of half precision, read back; those of another length or none are left out."""
    raw = F.unhex(F.md5("text"))
    docs = T.load(spark, d, "documents").select("doc_id", S.from_half(raw).alias("v"))
    return docs.filter(F.size("v") == 8)


@query()
def hashed_embeddings(spark, d):
    return T.load(spark, d, "documents").select("doc_id", narratives.hashed_embedding(F.col("text"), 64).alias("v"))


@query()
def reduced_manifold(spark, d):
    """All vectors in ten dimensions in which neighbours stay neighbours."""
    return manifold.reduced_manifold(_vectors(spark, d), 10)


@query()
def reduced_vectors(spark, d):
    return narratives.reduced(T.load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), 10)


@query("SELECT label AS cluster, round(sqrt(sum(m * m)), 4) AS length, count(*) AS dims FROM (SELECT label, i, avg(x::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS x, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY 1")
def centroid_vectors(spark, d):
    v = narratives.centroid_vectors(T.load(spark, d, "embeddings").select("label", F.col("embedding").alias("v")), "label")
    return v.select("cluster", F.round(F.sqrt(F.aggregate("centroid", F.lit(0.0), lambda a, x: a + x * x)), 4).alias("length"), F.size("centroid").cast("long").alias("dims"))


_H = ", h AS (SELECT (p_partkey * 40503) % 65536 AS h, min(p_partkey) AS id FROM part GROUP BY 1) "


@query(_H + "SELECT x.id AS a, y.id AS b, bit_count(xor(x.h, y.h))::BIGINT AS apart FROM h x JOIN h y ON x.id < y.id WHERE bit_count(xor(x.h, y.h)) <= 2")
def perceptual_near_duplicates(spark, d):
    return narratives.near_hashes(T.load(spark, d, "part").select(F.col("p_partkey").alias("id"), ((F.col("p_partkey") * 40503) % 65536).alias("h")), 2, 16)


@query("""SELECT (label * 7 + 3) % 10 AS cluster, 'n' || label AS narrative_id, 1.0::DOUBLE AS score, 'kept' AS status FROM (SELECT DISTINCT label FROM embeddings)""")
def narrative_identity(spark, d):
    """Clusters that come numbered another way keep their narratives."""
    v = T.load(spark, d, "embeddings").select("label", F.col("embedding").alias("v"))
    known = narratives.centroid_vectors(v, "label").select(F.concat(F.lit("n"), F.col("cluster").cast("string")).alias("narrative_id"), "centroid")
    new = narratives.centroid_vectors(v.withColumn("label", (F.col("label") * 7 + 3) % 10), "label")
    return narratives.match_narratives(new, known).select(F.col("cluster").cast("int").alias("cluster"), "narrative_id", F.round("score", 5).alias("score"), "status")


# patches, counters, reports

@query("SELECT post_id, CASE WHEN k % 2 = 0 THEN 'done' ELSE 'pending' END AS status, CASE WHEN k % 2 = 0 THEN 'positive' END AS label, CASE WHEN k % 2 = 0 THEN is_duplicate_of END AS is_duplicate_of FROM posts")
def nlp_patches(spark, d):
    p = T.posts(spark, d)
    null = lambda kind: F.lit(None).cast(kind)
    results = p.filter("k % 2 = 0").select("post_id", F.lit("positive").alias("label"), F.lit(0.9).alias("score"), "narrative_id", "is_duplicate_of", F.lit(1.0).alias("similarity_score"))
    state = p.select("post_id", F.struct(F.lit("pending").alias("status"), null("string").alias("label"), null("double").alias("score"), null("string").alias("narrative_id"), null("long").alias("is_duplicate_of"), null("double").alias("similarity_score")).alias("nlp"))
    return store.nlp_patch(state, results).select("post_id", "nlp.status", "nlp.label", "nlp.is_duplicate_of")


@query("SELECT account_id, account_id IN (SELECT account_id FROM posts) OR is_suspicious AS graph FROM accounts")
def sync_flags(spark, d):
    rows = T.accounts(spark, d).select("account_id", F.col("is_suspicious").alias("graph"))
    return store.sync_patch(rows, T.plain_posts(spark, d), "account_id", "graph").select("account_id", "graph")


@query("SELECT post_id, CASE WHEN prediction = 'likely_real' THEN prediction END AS prediction, CASE WHEN prediction = 'likely_real' THEN round(final_score, 6) END AS final_score, CASE WHEN prediction = 'likely_real' THEN 'done' ELSE 'pending' END AS status FROM posts")
def reset_deepfake_fields(spark, d):
    p = T.plain_posts(spark, d).select("post_id", "prediction", F.round("final_score", 6).alias("final_score"), F.lit("done").alias("status"))
    return store.reset_scores(p, F.col("prediction") != "likely_real")


@query("SELECT post_id, prediction FROM posts WHERE prediction <> 'synthetic'")
def purged_posts(spark, d):
    return store.purge(T.plain_posts(spark, d).select("post_id", "prediction"), F.col("prediction") == "synthetic")


@query("SELECT event_type AS type, user_id AS worker, max(ts) AS at FROM events GROUP BY 1, 2")
def worker_heartbeats(spark, d):
    return store.heartbeats(T.load(spark, d, "events").select(F.col("event_type").alias("type"), F.col("user_id").alias("worker"), F.col("ts").alias("at"), F.col("event_id").alias("status"))).select("type", "worker", "at")


@query("SELECT o_orderpriority AS type, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1, 2")
def job_counters(spark, d):
    return store.job_counters(T.load(spark, d, "orders").select(F.col("o_orderpriority").alias("type"), F.col("o_orderstatus").alias("status")))


@query("SELECT count(*) FILTER (o_orderstatus = 'F') AS ok, count(*) FILTER (o_orderstatus = 'O') AS pending, count(*) FILTER (o_orderstatus = 'P') AS missing FROM orders")
def sync_counters(spark, d):
    return store.sync_counters(T.load(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False).alias("graph")), "graph")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN NULL ELSE source END AS inner_source, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE lang END AS first_tag FROM documents")
def clean_nested(spark, d):
    i = F.col("doc_id")
    docs = T.load(spark, d, "documents").select("doc_id", F.struct(F.when(i % 2 == 0, "").otherwise(F.col("source")).alias("source")).alias("meta"), F.array(F.struct(F.when(i % 3 == 0, "1970-01-01T00:00:00Z").otherwise(F.col("lang")).alias("tag"))).alias("tags"))
    return store.clean_frame(docs).select("doc_id", F.col("meta.source").alias("inner_source"), F.get("tags", F.lit(0))["tag"].alias("first_tag"))


@query("SELECT community_id, count(DISTINCT account_id) AS size, string_agg(DISTINCT username, ',' ORDER BY username) AS names, string_agg(DISTINCT p.platform, ',' ORDER BY p.platform) AS platforms FROM posts p JOIN accounts USING (account_id) GROUP BY 1")
def community_members(spark, d):
    p = T.plain_posts(spark, d).join(T.accounts(spark, d).select("account_id", "username"), "account_id")
    text = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    return p.groupBy("community_id").agg(F.count_distinct("account_id").alias("size"), text("username").alias("names"), text("platform").alias("platforms"))


@query()
def account_suspicion_ranked(spark, d):
    """Synthetic share, mean score, rank in the graph and burst score of accounts with three posts or more."""
    p = T.plain_posts(spark, d)
    touches = p.select("account_id", F.concat("narrative_id", "hashtag", V.day().cast("string")).alias("post_id"))
    rank = comembers.pagerank(p.select(F.col("account_id").alias("id")).distinct(), comembers.memberships(touches, "post_id", "account_id")).withColumnRenamed("id", "account_id").withColumnRenamed("score", "pagerank")
    days = p.groupBy("account_id", V.day().alias("day")).agg(F.count(F.lit(1)).alias("n")).groupBy("account_id").agg((F.max("n") / F.avg("n")).alias("bot_score"))
    n = p.groupBy("account_id").agg(F.count(F.lit(1)).alias("posts"), F.round(100.0 * F.count_if(V.is_synthetic()) / F.count(F.lit(1)), 1).alias("synthetic_percent"), V.avg6("final_score").alias("avg_score")).filter("posts >= 3")
    return n.join(rank, "account_id", "left").join(days, "account_id", "left").withColumn("pagerank", F.coalesce("pagerank", F.lit(0.0)))


_MEDIA = ", m AS (SELECT l_partkey AS media_id, max(l_quantity / 50) AS final_score, count(DISTINCT l_orderkey) AS seen FROM lineitem GROUP BY 1) "


@query(_MEDIA + "SELECT count(*) AS media, round(avg(final_score), 6) AS avg_score, max(final_score) AS max_score, count(*) FILTER (seen > 1) AS reused, (SELECT string_agg(media_id::VARCHAR, ',' ORDER BY final_score DESC, media_id) FROM (FROM m ORDER BY final_score DESC, media_id LIMIT 3)) AS top3 FROM m")
def media_report(spark, d):
    m = T.load(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("media_id")).agg(F.max(F.col("l_quantity") / 50).alias("final_score"), F.count_distinct("l_orderkey").alias("seen"))
    top = m.orderBy(F.desc("final_score"), "media_id").limit(3).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("final_score")).alias("s"), "media_id"))), lambda x: x["media_id"].cast("string")), ",").alias("top3"))
    whole = m.agg(F.count(F.lit(1)).alias("media"), V.avg6("final_score").alias("avg_score"), F.max("final_score").alias("max_score"), F.count_if(F.col("seen") > 1).alias("reused"))
    return whole.crossJoin(top)  # one row each


@query("SELECT narrative_id, count(*) AS post_count, sum(c)::BIGINT AS comment_count, string_agg(DISTINCT platform, ',' ORDER BY platform) AS platforms FROM (SELECT narrative_id, platform, (SELECT count(*) FROM conversations WHERE conv_id = post_id) AS c FROM posts) GROUP BY 1")
def narrative_comments(spark, d):
    c = T.load(spark, d, "conversations").groupBy(F.col("conv_id").alias("post_id")).agg(F.count(F.lit(1)).alias("c"))
    p = T.plain_posts(spark, d).join(c, "post_id", "left")
    return p.groupBy("narrative_id").agg(F.count(F.lit(1)).alias("post_count"), F.coalesce(F.sum("c"), F.lit(0)).alias("comment_count"), F.array_join(F.sort_array(F.collect_set("platform")), ",").alias("platforms"))


@query(", c AS (SELECT conv_id, turn, floor((turn - 1) / 2)::BIGINT AS parent FROM conversations), r AS (WITH RECURSIVE t(conv_id, turn, depth) AS (SELECT conv_id, turn, 0 FROM c WHERE turn = 0 UNION ALL SELECT c.conv_id, c.turn, t.depth + 1 FROM c JOIN t ON c.conv_id = t.conv_id AND c.parent = t.turn WHERE c.turn > 0) SELECT * FROM t) SELECT conv_id, turn, depth FROM r")
def comment_tree(spark, d):
    """Replies that name their parent, with their depth below the post: parents two turns to a comment here."""
    c = T.load(spark, d, "conversations").select("conv_id", "turn", F.floor((F.col("turn") - 1) / 2).alias("parent"))
    return V.thread_depths(c, "conv_id", "turn", "parent")


@query("SELECT c.doc_id, label FROM (SELECT doc_id, lang FROM documents) c JOIN (VALUES ('en', 'Narratif en'), ('fr', 'Narratif fr')) v(l, label) ON lang = l")
def matched_labels(spark, d):
    new = T.load(spark, d, "documents").select(F.col("doc_id").alias("cluster"), F.concat(F.lit("Narratif "), "lang").alias("label"))
    known = spark.createDataFrame([("Narratif en", 1), ("Narratif fr", 2)], "label string, narrative_id int")
    return narratives.match_labels(new, known).filter("narrative_id is not null").select(F.col("cluster").alias("doc_id"), "label")


@query("SELECT account_id, count(DISTINCT campaign_id) > 3 OR coalesce(any_value(s), false) AS is_suspicious, count(*) FILTER (prediction = 'synthetic')::DOUBLE / count(*) >= 0.1 AS is_confirmed_bot, string_agg(DISTINCT campaign_id, ',' ORDER BY campaign_id) AS campaign_ids, string_agg(DISTINCT narrative_id, ',' ORDER BY narrative_id) AS narratives FROM posts LEFT JOIN (SELECT account_id, is_suspicious AS s FROM accounts) USING (account_id) GROUP BY 1")
def account_flags(spark, d):
    """Flags that tools read but no importer writes, from posts and campaigns."""
    text = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    p = T.plain_posts(spark, d).groupBy("account_id").agg(F.count_distinct("campaign_id").alias("n"), (F.count_if(V.is_synthetic()) / F.count(F.lit(1)) >= 0.1).alias("is_confirmed_bot"), text("campaign_id").alias("campaign_ids"), text("narrative_id").alias("narratives"))
    a = T.accounts(spark, d).select("account_id", F.col("is_suspicious").alias("s"))
    return p.join(a, "account_id", "left").select("account_id", ((F.col("n") > 3) | F.coalesce("s", F.lit(False))).alias("is_suspicious"), "is_confirmed_bot", "campaign_ids", "narratives")


@query()
def document_topics(spark, d):
    docs = T.load(spark, d, "documents")
    return narratives.topics(docs.select("doc_id", "lang"), narratives.keywords(docs, "lang", "text", "doc_id"), "lang")


# neighbour graphs and clusters

def _vectors(spark, d):
    return T.load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


@query()
def neighbour_graph(spark, d):
    """The fifteen nearest others of every vector by cosine; most of them right, so that there is no SQL."""
    return neighbours.neighbour_graph(_vectors(spark, d))


@query()
def hierarchical_clusters(spark, d):
    """Hierarchical density clusters of all vectors by full distances."""
    return hierarchy.hierarchical_clusters(_vectors(spark, d))
