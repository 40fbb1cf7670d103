"""Investigation queries over accounts, posts, narratives and campaigns.

Top-k lists are ordered with a tie-break by id and cut before they are joined, so that
only k rows meet the other table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flockscope.operators.comembers import memberships, shared
from flockscope.operators.graph import pairs_within


def is_synthetic() -> Column:
    return F.col("prediction") == "synthetic"


def day() -> Column:
    return F.to_date("published_at")


def month() -> Column:
    return F.date_format("published_at", "yyyy-MM")


def avg6(col: Column | str) -> Column:
    return F.round(F.avg(col), 6)


def deepfake_summary(posts: DataFrame, by: str = "account_id") -> DataFrame:
    """Per account its scored posts, their mean score, and how many are synthetic or suspicious."""
    n, syn = F.count(F.lit(1)), F.count_if(is_synthetic())
    return posts.filter("final_score is not null").groupBy(by).agg(
        n.alias("posts"), avg6("final_score").alias("avg_score"), syn.alias("synthetic"), F.count_if(F.col("prediction") == "suspicious").alias("suspicious"),
        F.round(syn / n, 6).alias("synthetic_ratio"))


def top_accounts(posts: DataFrame, accounts: DataFrame, k: int = 10, how: str = "left") -> DataFrame:
    """The k accounts with most posts, with their names where known."""
    top = posts.groupBy("account_id").agg(F.count(F.lit(1)).alias("posts"), avg6("final_score").alias("avg_score"), F.count_if(is_synthetic()).alias("synthetic")).orderBy(F.desc("posts"), "account_id").limit(k)
    return top.join(accounts.select("account_id", "username", "platform"), "account_id", how)


def timeline(posts: DataFrame) -> DataFrame:
    return posts.groupBy(day().alias("day"), "account_id", "platform").agg(F.count(F.lit(1)).alias("posts"), F.count("is_duplicate_of").alias("duplicates"))


def cooccurrence(posts: DataFrame, k: int = 20) -> DataFrame:
    """Days on which several accounts post, the busiest first."""
    d = posts.groupBy(day().alias("day")).agg(F.count_distinct("account_id").alias("accounts"), F.count(F.lit(1)).alias("posts"))
    return d.filter("accounts > 1").orderBy(F.desc("accounts"), F.desc("posts"), "day").limit(k)


def cadence(posts: DataFrame) -> DataFrame:
    """Per account how many days it was active and its posts on them."""
    daily = posts.groupBy("account_id", day().alias("day")).agg(F.count(F.lit(1)).alias("n"))
    span = F.date_diff(F.max("day"), F.min("day")) + 1
    return daily.groupBy("account_id").agg(F.count(F.lit(1)).alias("active_days"), F.sum("n").alias("posts"), F.round(F.sum("n") / F.count(F.lit(1)), 6).alias("avg_per_day"),
                                           F.max("n").alias("max_per_day"), F.min("n").alias("min_per_day"), F.round(F.sum("n") / span, 6).alias("avg_per_calendar_day"))


def monthly(posts: DataFrame) -> DataFrame:
    return posts.groupBy(month().alias("month")).agg(F.count(F.lit(1)).alias("posts"), F.count_distinct("account_id").alias("accounts"), F.count_if(is_synthetic()).alias("synthetic"),
                                                     F.round(F.count_if(is_synthetic()) / F.count(F.lit(1)), 6).alias("synthetic_ratio"))


def propagation(posts: DataFrame) -> DataFrame:
    return posts.groupBy("account_id").agg(F.min("published_at").alias("first_post"), F.max("published_at").alias("last_post"), F.count(F.lit(1)).alias("posts"))


def seed_account(posts: DataFrame) -> DataFrame:
    """Per narrative the account that posted first."""
    first = F.min(F.struct("published_at", "post_id", "account_id"))
    return posts.groupBy("narrative_id").agg(first.alias("f")).select("narrative_id", F.col("f.account_id").alias("account_id"), F.col("f.published_at").alias("first_post"))


def silence_gaps(posts: DataFrame, days: int = 14, k: int | None = None) -> DataFrame:
    """Gaps of more than ``days`` days between an account's consecutive posts, the k longest of each account."""
    w = Window.partitionBy("account_id").orderBy("published_at")
    gaps = posts.select("account_id", F.col("published_at").alias("from"), F.lead("published_at").over(w).alias("to"))
    gaps = gaps.withColumn("gap", F.date_diff("to", "from").cast("long")).filter(F.col("gap") > days)
    if k is None:
        return gaps
    return gaps.withColumn("place", F.row_number().over(Window.partitionBy("account_id").orderBy(F.desc("gap"), "from"))).filter(F.col("place") <= k).drop("place")


def shared_tags(tags: DataFrame, least: int = 2) -> DataFrame:
    """Pairs of accounts, smaller id first, that use ``least`` or more tags both."""
    if dict(tags.dtypes)["account_id"] == "bigint":
        pairs = shared(memberships(tags, "tag", "account_id"), least)
        return pairs.select(F.col("src").alias("account_a"), F.col("dst").alias("account_b"), F.col("weight").alias("shared_tags"))
    pairs = pairs_within(tags, "tag", "account_id")
    return pairs.groupBy(F.col("a").alias("account_a"), F.col("b").alias("account_b")).agg(F.count(F.lit(1)).alias("shared_tags")).filter(F.col("shared_tags") >= least)


def duplicate_edges(posts: DataFrame) -> DataFrame:
    """Copies with their originals: both posts' ids, authors, platforms, days, narratives."""
    copy = posts.filter("is_duplicate_of is not null").select(F.col("post_id").alias("copy_id"), F.col("is_duplicate_of").alias("original_id"), F.col("account_id").alias("copier"),
                                                              F.col("platform").alias("copy_platform"), F.col("published_at").alias("copied_at"), "narrative_id")
    origin = posts.select(F.col("post_id").alias("original_id"), F.col("account_id").alias("author"), F.col("platform").alias("original_platform"), F.col("published_at").alias("original_at"))
    return copy.join(origin, "original_id")


def copy_pairs(edges: DataFrame) -> DataFrame:
    return edges.filter("copier <> author").groupBy("copier", "author").agg(F.count(F.lit(1)).alias("copies"))


def cross_campaign(posts: DataFrame) -> DataFrame:
    """Pairs of campaigns by the accounts that post in both."""
    pairs = pairs_within(posts, "account_id", "campaign_id")
    return pairs.groupBy(F.col("a").alias("campaign_a"), F.col("b").alias("campaign_b")).agg(F.count(F.lit(1)).alias("accounts"))


def same_day_pairs(posts: DataFrame) -> DataFrame:
    """Copies made on the day of their original by another account of its community."""
    e = duplicate_edges(posts)
    com = posts.select("account_id", "community_id").distinct()
    a, b = com.select(F.col("account_id").alias("copier"), F.col("community_id").alias("c1")), com.select(F.col("account_id").alias("author"), F.col("community_id").alias("c2"))
    e = e.filter((F.to_date("copied_at") == F.to_date("original_at")) & (F.col("copier") != F.col("author")))
    return e.join(a, "copier").join(b, "author").filter("c1 = c2").select("copy_id", "original_id", "copier", "author", F.col("c1").alias("community_id"))


def enrichment_triggers(summary: DataFrame, ratio: float, least: int) -> DataFrame:
    """What more to look up for an account, by thresholds on its summary."""
    rules = F.array_compact(F.array(F.when(F.col("synthetic_ratio") >= ratio, F.lit("media_scores")), F.when(F.col("posts") >= least, F.lit("temporal")), F.when(F.col("suspicious") > F.col("synthetic"), F.lit("neighbors"))))
    return summary.select("account_id", F.array_join(F.slice(rules, 1, 4), ",").alias("calls")).filter("calls <> ''")


def suggestions(seed: DataFrame, robotic: DataFrame, copiers: DataFrame, tags: DataFrame, copies_high: int = 5, tag_high: int = 10, tag_watch: int = 3) -> DataFrame:
    """Targets to scrape next with a priority; a target of several rules keeps its highest."""
    rank = lambda c: F.when(c == "high", 0).when(c == "medium", 1).otherwise(2)
    rows = seed.select(F.concat(F.lit("account:"), F.col("account_id").cast("string")).alias("target"), F.lit("high").alias("priority"), F.lit("seed").alias("reason"))
    rows = rows.unionByName(robotic.select(F.concat(F.lit("account:"), F.col("account_id").cast("string")).alias("target"), F.lit("medium").alias("priority"), F.lit("robotic").alias("reason")))
    rows = rows.unionByName(copiers.select(F.concat(F.lit("account:"), F.col("copier").cast("string")).alias("target"), F.when(F.col("copies") >= copies_high, "high").otherwise("medium").alias("priority"), F.lit("copier").alias("reason")))
    rows = rows.unionByName(tags.filter(F.col("uses") >= tag_watch).select(F.concat(F.lit("tag:"), F.col("hashtag")).alias("target"), F.when(F.col("uses") >= tag_high, "high").otherwise("watch").alias("priority"), F.lit("hashtag").alias("reason")))
    best = F.min(F.struct(rank(F.col("priority")).alias("r"), "reason", "priority"))
    return rows.groupBy("target").agg(best.alias("b")).select("target", F.col("b.priority").alias("priority"), F.col("b.reason").alias("reason"))


def suspicion(summary: DataFrame, media: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Mean of an account's scores, more if it is in a campaign or reuses media, at most 1."""
    s = summary.join(media, "account_id", "left").join(campaigns, "account_id", "left")
    there = F.filter(F.array("avg_score", "synthetic_ratio", "media_score"), lambda x: x.isNotNull())
    mean = F.aggregate(there, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size(there), F.lit(1))
    one = F.least(F.lit(1.0), mean + F.when(F.coalesce("n_campaigns", F.lit(0)) > 0, 0.15).otherwise(0.0))
    return s.select("account_id", F.round(F.least(F.lit(1.0), one + F.when(F.coalesce("seen_count", F.lit(0)) > 1, 0.10).otherwise(0.0)), 2).alias("suspicion"))


def thread_depths(comments: DataFrame, thread: str, comment: str, parent: str) -> DataFrame:
    """(thread, comment, depth): steps from each comment up to one whose parent is not in its thread, however deep.

    Pointers are followed twice as far each round.  A comment that stands there several times
    has its least parent; comments that answer each other in a circle are left out."""
    from flockscope.sources.shared import settle

    rows = settle(comments.select(F.col(thread).alias("_t"), F.col(comment).alias("_c"), F.col(parent).alias("_p")).groupBy("_t", "_c").agg(F.min("_p").alias("_p")))
    ids = rows.select(F.col("_t").alias("_t2"), F.col("_c").alias("_c2"))
    up = rows.join(ids, (F.col("_t") == F.col("_t2")) & (F.col("_p") == F.col("_c2")), "left")
    state = settle(up.select("_t", "_c", F.col("_c2").alias("_up"), F.col("_c2").isNotNull().cast("long").alias("depth")))
    n, reach = state.count(), 1
    while reach <= n and not state.filter("_up is not null").isEmpty():
        hop = state.select(F.col("_t").alias("_t2"), F.col("_c").alias("_c2"), F.col("_up").alias("_next"), F.col("depth").alias("_more"))
        far = state.join(hop, (F.col("_t") == F.col("_t2")) & (F.col("_up") == F.col("_c2")), "left")
        state = settle(far.select("_t", "_c", F.col("_next").alias("_up"), (F.col("depth") + F.coalesce("_more", F.lit(0))).alias("depth")))
        reach *= 2
    return state.filter("_up is null").select(F.col("_t").alias(thread), F.col("_c").alias(comment), F.col("depth").cast("int").alias("depth"))
