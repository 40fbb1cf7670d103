"""Scoring, graph and text analytics bound to the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from flockscope import tables as T
from flockscope.functions import scalars as S
from flockscope.operators import comembers, graph, narratives, scoring
from flockscope.operators.edges import post_graph
from flockscope.operators.investigation import duplicate_edges
from flockscope.plans.catalog import query

_CLAMP = "greatest(0.0::DOUBLE, least(1.0::DOUBLE, {}))"


@query("SELECT post_id, media_id, position, round(" + _CLAMP.format("(m1 - 0.21::DOUBLE) / greatest(1 - 0.21::DOUBLE, 0.01::DOUBLE)") + ", 6) AS corrected FROM media_scores")
def bias_correction(spark, d):
    return T.media_scores(spark, d).select("post_id", "media_id", "position", F.round(S.bias_correction(F.col("m1"), F.lit(0.21)), 6).alias("corrected"))


_DIV = "CASE WHEN position % 3 = 0 THEN list_stddev_pop([m1, m3]) ELSE list_stddev_pop([m1, m2, m3]) END"


def _scores():
    return [F.col("m1"), F.when(F.col("position") % 3 != 0, F.col("m2")), F.col("m3")]


@query(f"SELECT post_id, media_id, position, round({_DIV}, 6) AS divergence FROM media_scores")
def model_divergence(spark, d):
    return T.media_scores(spark, d).select("post_id", "media_id", "position", F.round(S.model_divergence(_scores()), 6).alias("divergence"))


_FUSE = _CLAMP.format("(m1 * 0.4::DOUBLE + CASE WHEN position % 3 <> 0 THEN m2 * 0.45::DOUBLE ELSE 0 END + m3 * 0.15::DOUBLE) / CASE WHEN position % 3 <> 0 THEN 1.0::DOUBLE ELSE 0.55::DOUBLE END * 0.95::DOUBLE + artifact * 0.05::DOUBLE")


def _fused():
    return S.score_fusion(_scores(), [0.4, 0.45, 0.15], F.col("artifact"))


@query(f"SELECT post_id, media_id, position, round({_FUSE}, 9) AS final_score FROM media_scores")
def score_fusion(spark, d):
    return T.media_scores(spark, d).select("post_id", "media_id", "position", F.round(_fused(), 9).alias("final_score"))


@query("SELECT post_id, prediction, CASE WHEN final_score < 0.45 THEN 'likely_real' WHEN final_score < 0.65 THEN 'suspicious' ELSE 'synthetic' END AS agent FROM posts")
def prediction_label(spark, d):
    return T.plain_posts(spark, d).select("post_id", "prediction", S.agent_label(F.col("final_score")).alias("agent"))


@query("SELECT post_id, CASE WHEN final_score < 0.45 THEN 'likely_real' WHEN final_score < 0.65 THEN 'suspicious' ELSE 'synthetic' END AS label FROM posts")
def agent_label(spark, d):
    return T.plain_posts(spark, d).select("post_id", S.agent_label(F.col("final_score")).alias("label"))


@query(f"SELECT post_id, media_id, position, CASE WHEN x < 0.15 THEN 'high' WHEN x < 0.3 THEN 'medium' ELSE 'low' END AS confidence FROM (SELECT *, round({_DIV}, 6) AS x FROM media_scores)")
def divergence_confidence(spark, d):
    return T.media_scores(spark, d).select("post_id", "media_id", "position", S.divergence_confidence(F.round(S.model_divergence(_scores()), 6)).alias("confidence"))


@query(f"SELECT post_id, media_id, position FROM (SELECT *, round({_DIV}, 6) AS x, round({_FUSE}, 9) AS f FROM media_scores) WHERE x > 0.2 AND f > 0.65 AND f < 0.82")
def divergence_alert(spark, d):
    m = T.media_scores(spark, d).select("post_id", "media_id", "position", F.round(S.model_divergence(_scores()), 6).alias("x"), F.round(_fused(), 9).alias("f"))
    return m.filter(S.divergence_alert(F.col("x"), F.col("f"))).select("post_id", "media_id", "position")


@query("SELECT p_partkey, CASE WHEN p_size < 3 THEN 0.75 WHEN p_size < 6 THEN 0.55 WHEN p_size <= 20 THEN 0.15 WHEN p_size <= 35 THEN 0.35 ELSE 0.4 END::DOUBLE AS artifact FROM part")
def artifact_tier(spark, d):
    return T.load(spark, d, "part").select("p_partkey", S.artifact_tier(F.col("p_size")).alias("artifact"))


@query("SELECT p_partkey, CASE WHEN s <= 5 THEN 3 WHEN s <= 15 THEN 5 WHEN s <= 60 THEN 8 WHEN s <= 180 THEN 12 ELSE 16 END AS frames, least(10, CASE WHEN s <= 5 THEN 3 WHEN s <= 15 THEN 5 WHEN s <= 60 THEN 8 WHEN s <= 180 THEN 12 ELSE 16 END) AS capped FROM (SELECT p_partkey, p_size * 5 AS s FROM part)")
def frame_budget(spark, d):
    s = F.col("p_size") * 5
    return T.load(spark, d, "part").select("p_partkey", S.frame_budget(s).alias("frames"), S.frame_budget(s, 10).alias("capped"))


@query("""SELECT p_partkey, CASE WHEN n <= 1 THEN (p_size // 2)::VARCHAR ELSE array_to_string(list_transform(range(0, n), lambda i: least(greatest(round_even(i * (p_size - 1)::DOUBLE / greatest(n - 1, 1), 0)::INT, 0), greatest(p_size - 1, 0))), ',') END AS frames FROM (SELECT *, (p_partkey % 6)::INT AS n FROM part)""")
def frame_indices(spark, d):
    return T.load(spark, d, "part").select("p_partkey", F.array_join(F.transform(S.frame_indices(F.col("p_size"), (F.col("p_partkey") % 6).cast("int")), lambda x: x.cast("string")), ",").alias("frames"))


@query("SELECT post_id, concat_ws(',', CASE WHEN k % 2 = 0 THEN 'reuse' END, CASE WHEN k % 3 = 0 THEN 'burst' END, CASE WHEN prediction = 'synthetic' THEN 'synthetic' END) AS signals FROM posts")
def active_signals(spark, d):
    flags = {"reuse": F.col("k") % 2 == 0, "burst": F.col("k") % 3 == 0, "synthetic": F.col("prediction") == "synthetic"}
    return T.plain_posts(spark, d).select("post_id", F.array_join(S.active_signals(flags), ",").alias("signals"))


@query("SELECT least(floor(final_score * 20)::INT, 19) AS bin, count(*) AS n FROM posts GROUP BY 1")
def score_histogram(spark, d):
    return T.plain_posts(spark, d).groupBy(F.least(F.floor(F.col("final_score") * 20).cast("int"), F.lit(19)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'negative' WHEN 1 THEN 'neutral' WHEN 2 THEN 'positive' WHEN 3 THEN 'positive' ELSE 'neutral' END AS sentiment FROM documents")
def sentiment_label_map(spark, d):
    raw = F.element_at(F.array(F.lit("1 star"), F.lit("LABEL_1"), F.lit("5 stars"), F.lit("LABEL_2"), F.lit("")), (F.col("doc_id") % 5 + 1).cast("int"))
    return T.load(spark, d, "documents").select("doc_id", S.sentiment_label(raw).alias("sentiment"))


_METRICS = """, c AS (SELECT count(*) FILTER (t AND g)::DOUBLE AS tp, count(*) FILTER (NOT t AND NOT g)::DOUBLE AS tn, count(*) FILTER (NOT t AND g)::DOUBLE AS fp, count(*) FILTER (t AND NOT g)::DOUBLE AS fn FROM (SELECT quality = 1 AS t, n_chars > 800 AS g FROM labels JOIN documents USING (doc_id)))
SELECT tp::BIGINT AS tp, tn::BIGINT AS tn, fp::BIGINT AS fp, fn::BIGINT AS fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc,
round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) AS f1 FROM c"""


@query(_METRICS)
def binary_metrics(spark, d):
    x = T.load(spark, d, "labels").join(T.load(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return scoring.binary_metrics(x.select((F.col("quality") == 1).alias("truth"), (F.col("n_chars") > 800).alias("guess")))


@query()
def dataset_split(spark, d):
    return scoring.split(T.load(spark, d, "documents").select("doc_id"), "doc_id", {"train": 70, "validation": 15, "test": 15})


@query(f", m AS (SELECT post_id, round({_FUSE}, 9) AS f, position FROM media_scores) SELECT post_id, max(f) AS final_score, CASE WHEN max(f) > 0.82 THEN 'synthetic' WHEN max(f) > 0.65 THEN 'suspicious' ELSE 'likely_real' END AS prediction, CASE WHEN bool_and(position <> 7) THEN 'done' ELSE 'processing' END AS status FROM m GROUP BY 1")
def post_worst_case(spark, d):
    m = T.media_scores(spark, d).select("post_id", F.round(_fused(), 9).alias("final_score"), F.when(F.col("position") == 7, "pending").otherwise("done").alias("status"))
    return scoring.worst_case(m)


@query("SELECT post_id AS video_id, flag AS model, round(avg(m1), 6) AS avg_score, round(avg(artifact), 6) AS avg_artifact, count(*) AS frames, sum(position)::BIGINT AS faces FROM media_scores GROUP BY 1, 2")
def video_frame_aggregate(spark, d):
    return scoring.video_frames(T.media_scores(spark, d).select(F.col("post_id").alias("video_id"), F.col("flag").alias("model"), F.col("m1").alias("score"), "artifact", F.col("position").cast("long").alias("faces")))


@query(""", s AS (SELECT unnest(['m1', 'm2', 'm3']) AS model, unnest([m1, m2, m3]) AS score, flag = 'R' AS is_alt FROM media_scores), a AS (SELECT model, avg(score) FILTER (NOT is_alt) AS r, avg(score) FILTER (is_alt) AS t FROM s GROUP BY 1),
z AS (SELECT *, pow(1 - r, 2) AS fp, t - r AS margin, greatest(0, t - r) * pow(1 - r, 2) AS sc FROM a)
SELECT model, round(r, 6) AS avg_real, round(t, 6) AS avg_alt, round(fp, 6) AS fp_factor, round(CASE WHEN sum(sc) OVER () > 0 THEN sc / sum(sc) OVER () ELSE 1.0 / count(*) OVER () END, 3) AS weight FROM z""")
def calibration_fp_first(spark, d):
    m = T.media_scores(spark, d)
    long = m.select(F.explode(F.array(*[F.struct(F.lit(k).alias("model"), F.col(k).alias("score")) for k in ("m1", "m2", "m3")])).alias("x"), (F.col("flag") == "R").alias("is_alt")).select("x.model", "x.score", "is_alt")
    return scoring.calibrate_fp_first(long).select("model", F.round("avg_real", 6).alias("avg_real"), F.round("avg_alt", 6).alias("avg_alt"), F.round("fp_factor", 6).alias("fp_factor"), F.round("weight", 3).alias("weight"))


@query(f", m AS (SELECT round({_FUSE}, 9) AS f, round({_DIV}, 6) AS x FROM media_scores) SELECT count(*) AS media, round(avg(f), 6) AS avg_score, max(f) AS max_score, round(avg(x), 6) AS avg_divergence, round(100.0::DOUBLE * count(*) FILTER (f > 0.82) / count(*), 4) AS synthetic_percent FROM m")
def media_stats(spark, d):
    return scoring.media_stats(T.media_scores(spark, d).select(F.round(_fused(), 9).alias("final_score"), F.round(S.model_divergence(_scores()), 6).alias("divergence")))


# graph

_TOUCH = ", t AS (SELECT DISTINCT account_id, narrative_id || hashtag || published_at::DATE AS post FROM posts), pr AS (SELECT x.account_id AS src, y.account_id AS dst, count(*) AS weight FROM t x JOIN t y USING (post) WHERE x.account_id < y.account_id GROUP BY 1, 2) "


def _touches(spark, d):
    return T.plain_posts(spark, d).select("account_id", F.concat("narrative_id", "hashtag", F.to_date("published_at").cast("string")).alias("post_id"))


def _members(spark, d):
    return comembers.memberships(_touches(spark, d), "post_id", "account_id")


def _accounts(spark, d):
    return T.plain_posts(spark, d).select(F.col("account_id").alias("id")).distinct()


@query(_TOUCH + "SELECT src, dst, weight FROM pr")
def account_projection(spark, d):
    return comembers.shared(_members(spark, d))


@query(_TOUCH.rstrip() + """, e AS (SELECT src, dst FROM pr WHERE weight >= 3), b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e)
SELECT id, min(o) AS component FROM (WITH RECURSIVE r(id, o) AS (SELECT DISTINCT account_id, account_id FROM posts UNION SELECT b.dst, r.o FROM r JOIN b ON r.id = b.src) SELECT * FROM r) GROUP BY 1""")
def connected_components(spark, d):
    return graph.connected_components(_accounts(spark, d), comembers.connections(_members(spark, d), 3))


@query()
def louvain_communities(spark, d):
    return comembers.louvain(_accounts(spark, d), _members(spark, d))


def _rank_sql(rounds: int) -> str:
    steps = [_TOUCH.rstrip(), ", o AS (SELECT src, sum(weight) AS w FROM pr GROUP BY 1), l AS (SELECT pr.src, dst, weight::DOUBLE / w AS share FROM pr JOIN o USING (src)), r0 AS (SELECT DISTINCT account_id AS id, 0.15::DOUBLE AS score FROM posts)"]
    for i in range(rounds):
        steps.append(f", r{i + 1} AS (SELECT r0.id, 0.15::DOUBLE + 0.85::DOUBLE * coalesce(s, 0) AS score FROM r0 LEFT JOIN (SELECT dst, sum(score * share) AS s FROM r{i} JOIN l ON r{i}.id = l.src GROUP BY 1) ON r0.id = dst)")
    return "".join(steps) + f" SELECT id, round(score, 6) AS score FROM r{rounds}"


@query(_rank_sql(5))
def pagerank(spark, d):
    return comembers.pagerank(_accounts(spark, d), _members(spark, d), rounds=5).select("id", F.round("score", 6).alias("score"))


@query()
def pagerank_converged(spark, d):
    """As the reference runs it: at most 20 rounds, until no score moves by more than 1e-7."""
    return comembers.pagerank(_accounts(spark, d), _members(spark, d), rounds=20, tolerance=1e-7)


@query()
def betweenness(spark, d):
    return graph.betweenness(_accounts(spark, d), comembers.shared(_members(spark, d), 2))


_COPIES = ", c AS (SELECT DISTINCT a.account_id AS src, o.account_id AS dst FROM posts a JOIN posts o ON a.is_duplicate_of = o.post_id WHERE a.account_id <> o.account_id), b AS (SELECT src, dst FROM c UNION SELECT dst, src FROM c)"


def _copies(spark, d):
    return duplicate_edges(T.posts(spark, d)).filter("copier <> author").select(F.col("copier").alias("src"), F.col("author").alias("dst")).distinct()


@query(_COPIES + ", h1 AS (SELECT DISTINCT dst AS id FROM b WHERE src = 7), h2 AS (SELECT DISTINCT dst AS id FROM b WHERE src IN (SELECT id FROM h1)) SELECT 7::BIGINT AS id, 0 AS depth UNION ALL SELECT id, 1 FROM h1 WHERE id <> 7 UNION ALL SELECT id, 2 FROM h2 WHERE id <> 7 AND id NOT IN (SELECT id FROM h1)")
def bfs_propagation(spark, d):
    return graph.bfs(_copies(spark, d), spark.range(7, 8), 2)


@query(_COPIES + ", k1 AS (SELECT 7::BIGINT AS id UNION SELECT dst FROM b WHERE src = 7) SELECT src, dst FROM c WHERE src IN (SELECT id FROM k1) AND dst IN (SELECT id FROM k1)")
def subgraph_khop(spark, d):
    e = _copies(spark, d)
    reach = graph.bfs(e, spark.range(7, 8), 1).select("id")
    return e.join(reach.withColumnRenamed("id", "src"), "src", "left_semi").join(reach.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")


@query(", e AS (SELECT turn + conv_id * 100 AS src, turn - 1 + conv_id * 100 AS dst FROM conversations WHERE turn > 0) SELECT conv_id * 100 AS root, turn + conv_id * 100 AS id, turn::INT AS depth FROM conversations WHERE turn BETWEEN 1 AND 5")
def duplicate_chains(spark, d):
    c = T.load(spark, d, "conversations").filter("turn > 0")
    return graph.chains(c.select((F.col("turn") + F.col("conv_id") * 100).alias("src"), (F.col("turn") - 1 + F.col("conv_id") * 100).alias("dst")), 5)


@query(_COPIES + " SELECT id, count(*) AS degree FROM (SELECT src AS id FROM c UNION ALL SELECT dst FROM c) GROUP BY 1")
def degree_centrality(spark, d):
    return graph.degrees(_copies(spark, d))


_EDGES = """, g AS (SELECT DISTINCT 'A_PUBLIE' AS rel, 'Account' AS src_label, account_id::VARCHAR AS src, 'Post' AS dst_label, post_id::VARCHAR AS dst FROM posts UNION ALL SELECT DISTINCT 'HAS_HASHTAG', 'Post', post_id::VARCHAR, 'Hashtag', hashtag FROM posts
UNION ALL SELECT DISTINCT 'APPARTIENT_A', 'Post', post_id::VARCHAR, 'Narrative', narrative_id FROM posts UNION ALL SELECT DISTINCT 'EST_DOUBLON_DE', 'Post', post_id::VARCHAR, 'Post', is_duplicate_of::VARCHAR FROM posts WHERE is_duplicate_of IS NOT NULL
UNION ALL SELECT DISTINCT 'IS_DEEPFAKE', 'Post', post_id::VARCHAR, 'Deepfake', prediction FROM posts WHERE prediction <> 'likely_real' UNION ALL SELECT DISTINCT 'COUVRE', 'Campaign', campaign_id, 'Narrative', narrative_id FROM posts
UNION ALL SELECT DISTINCT 'IMPLIQUE', 'Campaign', campaign_id, 'Account', account_id::VARCHAR FROM posts) """


@query(_EDGES + "SELECT rel, src_label, src, dst_label, dst FROM g")
def graph_edges(spark, d):
    return post_graph(T.posts(spark, d))


@query(_EDGES + "SELECT rel, count(*) AS edges, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets FROM g GROUP BY 1")
def graph_stats(spark, d):
    return post_graph(T.posts(spark, d)).groupBy("rel").agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("src").alias("sources"), F.count_distinct("dst").alias("targets"))


@query("SELECT DISTINCT account_id, post_id, 'publish' AS kind FROM posts WHERE is_duplicate_of IS NULL UNION ALL SELECT DISTINCT account_id, is_duplicate_of, 'forward' FROM posts WHERE is_duplicate_of IS NOT NULL")
def interaction_edges(spark, d):
    p = T.posts(spark, d)
    a = p.filter("is_duplicate_of is null").select("account_id", "post_id", F.lit("publish").alias("kind"))
    return a.unionByName(p.filter("is_duplicate_of is not null").select("account_id", F.col("is_duplicate_of").alias("post_id"), F.lit("forward").alias("kind"))).distinct()


# texts and vectors

_PAIRS = ", pr AS (SELECT x.vec_id AS a, y.vec_id AS b, list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) AS score FROM embeddings x JOIN embeddings y ON x.vec_id > y.vec_id WHERE list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) >= {t})"


@query(_PAIRS.format(t=0.4) + " SELECT a AS id, arg_max(b, (score, -b)) AS duplicate_of, round(max(score), 6) AS score FROM pr GROUP BY 1")
def near_duplicates(spark, d):
    v = T.load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return narratives.near_duplicates(v, 0.4).withColumn("score", F.round("score", 6))


@query()
def near_duplicates_lsh(spark, d):
    v = T.load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return narratives.near_duplicates(v, 0.4, "lsh")


@query("SELECT md5(text) AS digest, count(*) AS copies, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark, d):
    return narratives.exact_duplicates(T.load(spark, d, "documents"), "doc_id", "text")


@query(_PAIRS.format(t=0.35) + """, bb AS (SELECT a AS s, b AS d FROM pr UNION ALL SELECT b, a FROM pr), core AS (SELECT s FROM bb GROUP BY 1 HAVING count(*) >= 2), ce AS (SELECT s, d FROM bb WHERE s IN (FROM core) AND d IN (FROM core)),
reach AS (WITH RECURSIVE r(id, o) AS (SELECT s, s FROM core UNION SELECT ce.d, r.o FROM r JOIN ce ON r.id = ce.s) SELECT id, min(o) AS c FROM r GROUP BY 1), big AS (SELECT c FROM reach GROUP BY 1 HAVING count(*) >= 3)
SELECT vec_id AS id, coalesce(c, -1) AS cluster FROM embeddings LEFT JOIN (SELECT * FROM reach WHERE c IN (FROM big)) ON vec_id = id""")
def density_clusters(spark, d):
    v = T.load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return narratives.density_clusters(v, 0.35, 2, 3)


@query("SELECT label AS cluster, dim - 1 AS dim, round(avg(x::DOUBLE), 6) AS mean FROM (SELECT label, unnest(embedding) AS x, unnest(range(1, 65))::INT AS dim FROM embeddings) GROUP BY 1, 2")
def cluster_centroids(spark, d):
    return narratives.centroids(T.load(spark, d, "embeddings").select("label", F.col("embedding").alias("v")), "label")


_STOP = ", ".join(f"'{w}'" for w in narratives.STOP_WORDS)
_WORDS = f""", dw AS (SELECT lang AS cluster, doc_id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: w NOT IN ({_STOP})) AS w FROM documents WHERE length(text) > 5),
g AS (SELECT cluster, doc_id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM dw), tf AS (SELECT cluster, doc_id, term, count(*) AS tf FROM g GROUP BY ALL),
n AS (SELECT cluster, count(*) AS n FROM dw GROUP BY 1), idf AS (SELECT cluster, term, n, ln((1 + n)::DOUBLE / (1 + count(*))) + 1 AS idf FROM tf JOIN n USING (cluster) GROUP BY cluster, term, n HAVING count(*) >= 2),
x AS (SELECT cluster, doc_id, term, n, tf * idf AS x FROM tf JOIN idf USING (cluster, term)), nn AS (SELECT cluster, doc_id, sqrt(sum(x * x)) AS norm FROM x GROUP BY 1, 2),
m AS (SELECT cluster, term, round(sum(x / norm) / max(n), 6) AS weight FROM x JOIN nn USING (cluster, doc_id) GROUP BY 1, 2), kw AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY weight DESC, term) AS place FROM m QUALIFY place <= 8)"""


@query(_WORDS + " SELECT cluster, term, weight, place FROM kw")
def cluster_keywords(spark, d):
    return narratives.keywords(T.load(spark, d, "documents"), "lang", "text", "doc_id")


@query(_WORDS + " SELECT cluster, 'Narratif #' || cluster || ' — ' || string_agg(term, ', ' ORDER BY place) AS label FROM kw WHERE place <= 3 GROUP BY 1")
def narrative_labels(spark, d):
    return narratives.narrative_labels(narratives.keywords(T.load(spark, d, "documents"), "lang", "text", "doc_id"))
