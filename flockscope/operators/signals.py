"""Signals of coordinated campaigns and their scoring.

Each signal is one grouped aggregate over posts(narrative_id, account_id, platform,
published_at, prediction, is_duplicate_of); the campaigns join them by narrative.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flockscope.functions import scalars as S

# What each signal adds to a campaign's confidence.
WEIGHTS = {"content_reuse": 0.25, "cross_platform": 0.20, "burst": 0.20, "synthetic": 0.10, "coordinated": 0.15, "amplifiers": 0.10}
REUSE_BONUS, COMMUNITY_BONUS = 0.05, 0.05


def content_reuse(posts: DataFrame, least: int = 3, ratio: float = 0.10) -> DataFrame:
    """Narratives with ``least`` duplicates or more that make up ``ratio`` of their posts."""
    n = posts.groupBy("narrative_id").agg(F.count(F.lit(1)).alias("posts"), F.count("is_duplicate_of").alias("duplicates"))
    share = F.col("duplicates") / F.col("posts")
    return n.filter((F.col("duplicates") >= least) & (share >= ratio)).withColumn("duplicate_ratio", F.bround(share, 3))


def cross_platform(posts: DataFrame, least: int = 2) -> DataFrame:
    got = posts.groupBy("narrative_id").agg(F.sort_array(F.collect_set("platform")).alias("p"))
    return got.filter(F.size("p") >= least).select("narrative_id", F.array_join("p", ",").alias("platforms"), F.size("p").cast("long").alias("n_platforms"))


def burst(posts: DataFrame, least: int = 20) -> DataFrame:
    """Narratives with days of ``least`` posts or more: how many, the fullest, and the least full of them (legacy)."""
    days = posts.groupBy("narrative_id", F.to_date("published_at").alias("day")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    top = F.max(F.struct("n", F.date_diff(F.lit("2100-01-01").cast("date"), F.col("day")).alias("early"), "day"))
    low = F.min(F.struct("n", "day"))
    return days.groupBy("narrative_id").agg(F.count(F.lit(1)).alias("burst_days"), top.alias("t"), low.alias("l")).select(
        "narrative_id", "burst_days", F.col("t.day").alias("burst_max_day"), F.col("t.n").alias("burst_max"), F.col("l.day").alias("burst_legacy_day"), F.col("l.n").alias("burst_legacy"))


def synthetic(posts: DataFrame, ratio: float = 0.20) -> DataFrame:
    n = posts.groupBy("narrative_id").agg(F.count(F.lit(1)).alias("posts"), F.count_if(F.col("prediction") == "synthetic").alias("synthetic_posts"))
    share = F.col("synthetic_posts") / F.col("posts")
    return n.filter((F.col("synthetic_posts") >= 1) & (share >= ratio)).withColumn("synthetic_ratio", F.bround(share, 3))


def coordinated_accounts(posts: DataFrame, communities: DataFrame, least: int = 3) -> DataFrame:
    """Per narrative its largest community of distinct accounts, and how many are large."""
    pairs = posts.select("narrative_id", "account_id").distinct()
    sizes = pairs.join(communities, "account_id").groupBy("narrative_id", "community_id").agg(F.count(F.lit(1)).alias("accounts")).filter(F.col("accounts") >= least)
    best = F.max(F.struct("accounts", (-F.col("community_id")).alias("c")))
    return sizes.groupBy("narrative_id").agg(best.alias("b"), F.count(F.lit(1)).alias("n_communities")).select(
        "narrative_id", (-F.col("b.c")).alias("community_id"), F.col("b.accounts").alias("accounts"), "n_communities")


def key_amplifiers(posts: DataFrame, ranks: DataFrame, top: int = 100, least: int = 2) -> DataFrame:
    """Narratives in which ``least`` or more of the ``top`` ranked accounts post."""
    first = ranks.filter("score > 0").orderBy(F.desc("score"), "account_id").limit(top)
    pairs = posts.select("narrative_id", "account_id").distinct()
    return (pairs.join(first, "account_id").groupBy("narrative_id")
            .agg(F.count(F.lit(1)).alias("amplifiers"), F.bround(F.max("score"), 4).alias("max_score")).filter(F.col("amplifiers") >= least))


def campaigns(posts: DataFrame, communities: DataFrame | None = None, ranks: DataFrame | None = None, min_score: float = 0.30, reuse: float = 0.10,
              burst_posts: int = 20, synthetic_ratio: float = 0.20, least_accounts: int = 3, top: int = 100) -> DataFrame:
    """Narratives scored by their signals, those below ``min_score`` left out, with their dates."""
    out = posts.groupBy("narrative_id").agg(F.min("published_at").alias("start"), F.max("published_at").alias("end"))
    joined = (out.join(content_reuse(posts, ratio=reuse).select("narrative_id", "duplicate_ratio"), "narrative_id", "left")
              .join(cross_platform(posts).select("narrative_id", "platforms"), "narrative_id", "left")
              .join(burst(posts, burst_posts).select("narrative_id", "burst_days"), "narrative_id", "left")
              .join(synthetic(posts, synthetic_ratio).select("narrative_id", "synthetic_ratio"), "narrative_id", "left"))
    if communities is not None:
        joined = joined.join(coordinated_accounts(posts, communities, least_accounts).select("narrative_id", F.col("accounts").alias("community_accounts")), "narrative_id", "left")
    else:
        joined = joined.withColumn("community_accounts", F.lit(None).cast("long"))
    if ranks is not None:
        joined = joined.join(key_amplifiers(posts, ranks, top).select("narrative_id", "amplifiers"), "narrative_id", "left")
    else:
        joined = joined.withColumn("amplifiers", F.lit(None).cast("long"))
    flags = {
        "content_reuse": F.col("duplicate_ratio").isNotNull(), "cross_platform": F.col("platforms").isNotNull(), "burst": F.col("burst_days").isNotNull(),
        "synthetic": F.coalesce(F.col("synthetic_ratio") > synthetic_ratio, F.lit(False)), "coordinated": F.col("community_accounts").isNotNull(),
        "amplifiers": F.col("amplifiers").isNotNull(),
    }
    score = F.lit(0.0)
    for name, flag in flags.items():
        score = score + F.when(flag, WEIGHTS[name]).otherwise(0.0)
    score = score + F.when(F.col("duplicate_ratio") > 0.30, REUSE_BONUS).otherwise(0.0) + F.when(F.col("community_accounts") > 10, COMMUNITY_BONUS).otherwise(0.0)
    joined = joined.withColumn("confidence", F.round(F.least(F.lit(1.0), score), 2)).withColumn("signals", F.array_join(S.active_signals(flags), ","))
    return joined.filter(F.col("confidence") >= min_score).select("narrative_id", "confidence", "signals", "start", "end", "duplicate_ratio", "platforms", "burst_days", "synthetic_ratio", "community_accounts", "amplifiers")


def spread_over_mean(df: DataFrame, value: str, times: float, least: float | None = None) -> DataFrame:
    """Rows whose value is more than ``times`` the mean of all, nulls counting as 0."""
    mean = F.avg(F.coalesce(value, F.lit(0))).over(Window.partitionBy())
    out = df.withColumn("_m", mean).filter(F.col(value) > times * F.col("_m")).drop("_m")
    return out if least is None else out.filter(F.col(value) > least)
