"""The test tables seen as accounts, posts, media, campaigns and their edges.

``posts`` binds events (platform, narrative, hashtag and score are derived from them),
``orders``-based views bind the star schema.  BINDINGS holds the same views as DuckDB SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flockscope.functions import scalars as S


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as posts: user_id the account, (type, k mod 10) the narrative, k the hashtag."""
    e = load(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    platform = F.element_at(F.array(*[F.lit(p) for p in S.PLATFORMS]), (F.col("user_id") % 4 + 1).cast("int"))
    score = F.col("value") / (F.col("value") + 25.0)
    # one row a kind of post, summed up before it is shuffled; small enough to be joined without moving the posts
    kind = ("event_type", "k", "_u")
    e = e.withColumn("_u", F.col("user_id") % 10)
    least = e.groupBy(*kind).agg(F.min("event_id").alias("_first")).select(*[F.col(c).alias(f"_{c}") for c in kind], "_first")
    e = e.join(least, (F.col("event_type") == F.col("_event_type")) & F.col("k").eqNullSafe(F.col("_k")) & F.col("_u").eqNullSafe(F.col("__u")), "left")
    first = F.col("_first")
    return e.select(
        F.col("event_id").alias("post_id"), F.col("user_id").alias("account_id"), F.col("ts").alias("published_at"), platform.alias("platform"), "k",
        F.concat(F.col("event_type"), F.lit("-"), (F.col("k") % 10).cast("string")).alias("narrative_id"), F.col("event_type").alias("campaign_id"),
        F.concat(F.lit("k"), F.col("k").cast("string")).alias("hashtag"), score.alias("final_score"), S.prediction_label(score).alias("prediction"),
        F.when(first < F.col("event_id"), first).alias("is_duplicate_of"), F.floor("value").cast("long").alias("likes"), (F.col("user_id") % 7).alias("community_id"))


def plain_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts without the duplicate column, for queries that do not need its window."""
    e = load(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    platform = F.element_at(F.array(*[F.lit(p) for p in S.PLATFORMS]), (F.col("user_id") % 4 + 1).cast("int"))
    score = F.col("value") / (F.col("value") + 25.0)
    return e.select(
        F.col("event_id").alias("post_id"), F.col("user_id").alias("account_id"), F.col("ts").alias("published_at"), platform.alias("platform"), "k",
        F.concat(F.col("event_type"), F.lit("-"), (F.col("k") % 10).cast("string")).alias("narrative_id"), F.col("event_type").alias("campaign_id"),
        F.concat(F.lit("k"), F.col("k").cast("string")).alias("hashtag"), score.alias("final_score"), S.prediction_label(score).alias("prediction"),
        F.floor("value").cast("long").alias("likes"), (F.col("user_id") % 7).alias("community_id"))


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as accounts."""
    platform = F.element_at(F.array(*[F.lit(p) for p in S.PLATFORMS]), (F.col("c_nationkey") % 4 + 1).cast("int"))
    return load(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("account_id"), F.col("c_name").alias("username"), platform.alias("platform"), F.col("c_acctbal").alias("followers"),
        (F.col("c_acctbal") < 0).alias("is_suspicious"), F.col("c_nationkey").alias("nation_id"), F.col("c_mktsegment").alias("segment"))


def order_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as posts: the priority is the narrative, the status the prediction."""
    label = F.when(F.col("o_orderstatus") == "F", "synthetic").when(F.col("o_orderstatus") == "O", "suspicious").otherwise("likely_real")
    return load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("post_id"), F.col("o_custkey").alias("account_id"), F.col("o_orderdate").alias("published_at"),
        F.col("o_orderpriority").alias("narrative_id"), label.alias("prediction"), F.col("o_totalprice").alias("reach"))


def media_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as scored media of posts: three models and an artifact score."""
    return load(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("post_id"), F.col("l_partkey").alias("media_id"), F.col("l_linenumber").alias("position"),
        (F.round(F.col("l_discount") * 10, 6) + 0.0).alias("m1"), (F.round(F.col("l_tax") * 12.5, 6) + 0.0).alias("m2"), (F.col("l_quantity") / 50).alias("m3"),
        (F.col("l_linenumber") / 10).alias("artifact"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"))


#: The same views for DuckDB; queries put it before their own text.
BINDINGS = """
WITH raw_posts AS (
  SELECT *, json_extract_string(props, '$.k')::INT AS kk FROM events),
posts AS (
  SELECT event_id AS post_id, user_id AS account_id, ts AS published_at,
    ['twitter', 'tiktok', 'instagram', 'telegram'][(user_id % 4 + 1)::INT] AS platform, kk AS k,
    event_type || '-' || (kk % 10)::VARCHAR AS narrative_id, event_type AS campaign_id, 'k' || kk::VARCHAR AS hashtag,
    value / (value + 25.0::DOUBLE) AS final_score,
    CASE WHEN value / (value + 25.0::DOUBLE) > 0.82::DOUBLE THEN 'synthetic' WHEN value / (value + 25.0::DOUBLE) > 0.65::DOUBLE THEN 'suspicious' ELSE 'likely_real' END AS prediction,
    nullif(min(event_id) OVER (PARTITION BY event_type, kk, user_id % 10), event_id) AS is_duplicate_of,
    floor(value)::BIGINT AS likes, user_id % 7 AS community_id
  FROM raw_posts),
accounts AS (
  SELECT c_custkey AS account_id, c_name AS username, ['twitter', 'tiktok', 'instagram', 'telegram'][(c_nationkey % 4 + 1)::INT] AS platform,
    c_acctbal AS followers, c_acctbal < 0 AS is_suspicious, c_nationkey AS nation_id, c_mktsegment AS segment FROM customer),
order_posts AS (
  SELECT o_orderkey AS post_id, o_custkey AS account_id, o_orderdate AS published_at, o_orderpriority AS narrative_id,
    CASE o_orderstatus WHEN 'F' THEN 'synthetic' WHEN 'O' THEN 'suspicious' ELSE 'likely_real' END AS prediction, o_totalprice AS reach FROM orders),
media_scores AS (
  SELECT l_orderkey AS post_id, l_partkey AS media_id, l_linenumber AS position, round(l_discount * 10, 6) + 0.0::DOUBLE AS m1,
    round(l_tax * 12.5::DOUBLE, 6) + 0.0::DOUBLE AS m2, l_quantity / 50 AS m3, l_linenumber / 10 AS artifact, l_returnflag AS flag, l_linestatus AS status FROM lineitem)
"""
