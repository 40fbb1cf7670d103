"""The property graph as one edge table per relation, united for generic traversal."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def relation(rows: DataFrame, rel: str, src: tuple[str, Column], dst: tuple[str, Column]) -> DataFrame:
    """Edges of one kind, once each: MERGE keeps one between two nodes."""
    out = rows.select(F.lit(rel).alias("rel"), F.lit(src[0]).alias("src_label"), src[1].cast("string").alias("src"), F.lit(dst[0]).alias("dst_label"), dst[1].cast("string").alias("dst"))
    return out.filter("src is not null and dst is not null").distinct()


def post_graph(posts: DataFrame) -> DataFrame:
    c = F.col
    return reduce(DataFrame.unionByName, [
        relation(posts, "A_PUBLIE", ("Account", c("account_id")), ("Post", c("post_id"))),
        relation(posts, "HAS_HASHTAG", ("Post", c("post_id")), ("Hashtag", c("hashtag"))),
        relation(posts, "APPARTIENT_A", ("Post", c("post_id")), ("Narrative", c("narrative_id"))),
        relation(posts, "EST_DOUBLON_DE", ("Post", c("post_id")), ("Post", c("is_duplicate_of"))),
        relation(posts.filter("prediction not in ('', 'likely_real') and final_score is not null"), "IS_DEEPFAKE", ("Post", c("post_id")), ("Deepfake", c("prediction"))),
        relation(posts, "COUVRE", ("Campaign", c("campaign_id")), ("Narrative", c("narrative_id"))),
        relation(posts, "IMPLIQUE", ("Campaign", c("campaign_id")), ("Account", c("account_id"))),
    ])


def _valued(rows: DataFrame, rel: str, src: tuple[str, Column], dst: tuple[str, Column], value: Column | None = None) -> DataFrame:
    """Edges of one kind with a value, once each; of several values the largest stays."""
    out = rows.select(F.lit(rel).alias("rel"), F.lit(src[0]).alias("src_label"), src[1].cast("string").alias("src"), F.lit(dst[0]).alias("dst_label"), dst[1].cast("string").alias("dst"),
                      (F.lit(None) if value is None else value).cast("double").alias("value"))
    keys = ["rel", "src_label", "src", "dst_label", "dst"]
    return out.filter("coalesce(src, '') <> '' and coalesce(dst, '') <> ''").groupBy(*keys).agg(F.max("value").alias("value"))


def full_graph(posts: DataFrame, comments: DataFrame, post_media: DataFrame, forward_min: int = 2) -> DataFrame:
    """All thirteen relations: who published, commented and forwarded what, copies with their similarity, narratives, hashtags,
    labels with their score, media, projects of posts and accounts, campaigns of narratives and accounts and back.

    posts(post_id, account_id, platform, narrative_id, campaign_id, project, hashtag, prediction, final_score, is_duplicate_of, similarity_score, forward_count),
    comments(post_id, account_id), post_media(post_id, media_id)."""
    c = F.col
    account, post, campaign = ("Account", c("account_id")), ("Post", c("post_id")), ("Campaign", c("campaign_id"))
    forwarded = posts.filter((c("platform") == "telegram") & (c("forward_count") >= forward_min))
    tagged = posts.filter(F.trim("hashtag") != "")
    flagged = posts.filter("prediction not in ('', 'likely_real') and final_score is not null")
    return reduce(DataFrame.unionByName, [
        _valued(posts, "A_PUBLIE", account, post), _valued(comments, "A_COMMENTE", account, post), _valued(forwarded, "A_FORWARDE", account, post, c("forward_count")),
        _valued(posts, "EST_DOUBLON_DE", post, ("Post", c("is_duplicate_of")), F.coalesce("similarity_score", F.lit(0.0))), _valued(posts, "APPARTIENT_A", post, ("Narrative", c("narrative_id"))),
        _valued(tagged, "HAS_HASHTAG", post, ("Hashtag", c("hashtag"))), _valued(flagged, "IS_DEEPFAKE", post, ("Deepfake", c("prediction")), c("final_score")),
        _valued(post_media, "A_MEDIA", post, ("Media", c("media_id"))), _valued(posts, "CONTIENT", ("Project", c("project")), post), _valued(posts, "CONTIENT", ("Project", c("project")), account),
        _valued(posts, "COUVRE", campaign, ("Narrative", c("narrative_id"))), _valued(posts, "IMPLIQUE", campaign, account), _valued(posts, "PARTICIPE_A", account, campaign),
    ])


def named(edges: DataFrame) -> DataFrame:
    """Edges between nodes named by label and id, as the traversals take them."""
    node = lambda side: F.concat_ws(":", f"{side}_label", side)
    return edges.select("rel", node("src").alias("src"), node("dst").alias("dst"))


def of_labels(edges: DataFrame, labels: list[str]) -> DataFrame:
    """Edges of which both ends have one of the labels."""
    return edges.filter(F.col("src_label").isin(*labels) & F.col("dst_label").isin(*labels))
