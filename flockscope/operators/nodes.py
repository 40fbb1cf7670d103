"""Store documents as flat graph nodes.

A node's property is a path into the document and a kind, which says what stands for a
missing value: text '', a number 0, a flag false, and nothing for values that may be unknown.
Paths that a table does not have count as missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The properties of each kind of node, by kind of value; "name" or "name=path".
ACCOUNT = {
    "text": "platform platform_id username display_name url bio=profile.bio location=profile.location website=profile.website avatar_url=profile.avatar_url "
            "created_at=profile.created_at language=profile.language tg_invite_link=platform_specific.invite_link tw_verified_type=platform_specific.verified_type "
            "tt_region=platform_specific.region language_detected=analysis.language_detected scraped_at updated_at",
    "number": "followers=stats.followers_count following=stats.following_count posts_count=stats.posts_count likes_count=stats.likes_count "
              "tg_member_count=platform_specific.member_count tw_listed_count=platform_specific.listed_count",
    "flag": "verified=profile.verified tg_is_channel=platform_specific.is_channel tg_is_group=platform_specific.is_group tg_is_bot=platform_specific.is_bot "
            "tw_is_blue_verified=platform_specific.is_blue_verified tw_protected=platform_specific.protected tt_is_creator=platform_specific.is_creator "
            "ig_is_business=platform_specific.is_business ig_is_private=platform_specific.is_private is_confirmed_bot=flags.is_confirmed_bot is_suspicious=flags.is_suspicious",
    "maybe": "bot_score=analysis.bot_score bot_post_regularity=analysis.bot_signals.post_regularity bot_follower_ratio=analysis.bot_signals.follower_ratio "
             "bot_avg_engagement=analysis.bot_signals.avg_engagement bot_account_age=analysis.bot_signals.account_age_days bot_burst_score=analysis.bot_signals.post_burst_score",
}
POST = {
    "text": "platform platform_id url text=text.content language=text.language published_at=context.published_at is_reply_to=context.is_reply_to is_repost_of=context.is_repost_of "
            "thread_id=context.thread_id tg_forward_from=platform_specific.forward_from tg_channel_id=platform_specific.channel_id tg_message_id=platform_specific.message_id "
            "tw_verified_type=platform_specific.verified_type sentiment_label=nlp.sentiment.label embedding_model=nlp.embedding_model narrative_id=nlp.narrative_id "
            "deepfake_pred=deepfake.prediction cover_url=platform_specific.cover_url music_author=platform_specific.music_author source_project=source.project "
            "source_scan=source.scan source_user=source.user scraped_at updated_at",
    "number": "reply_count=context.reply_count likes=engagement.likes shares=engagement.shares comments=engagement.comments views=engagement.views saves=engagement.saves "
              "tg_forward_count=platform_specific.forward_count tg_views=platform_specific.views tw_retweet_count=platform_specific.retweet_count "
              "tw_quote_count=platform_specific.quote_count video_duration=platform_specific.video_duration play_count=platform_specific.play_count "
              "like_count=engagement.likes comment_count=engagement.comments share_count=engagement.shares view_count=engagement.views",
    "flag": "is_truncated=text.is_truncated tg_is_forwarded=platform_specific.is_forwarded tw_is_retweet=platform_specific.is_retweet is_video=platform_specific.is_video "
            "has_media=deepfake.has_media is_bot_suspected=scrapper_signals.is_bot_suspected",
    "maybe": "sentiment_score=nlp.sentiment.score similarity_score=nlp.similarity_score deepfake_score=deepfake.final_score artifact_score=deepfake.artifact_score "
             "influence_score=scrapper_signals.influence_score",
    "list": "hashtags=text.hashtags mentions=text.mentions urls=text.urls topics=nlp.topics",
}
MEDIA = {
    "text": "type url_local url_original platform=source.project deepfake_pred=deepfake.prediction source_project=source.project source_scan=source.scan updated_at",
    "number": "",
    "flag": "",
    "maybe": "deepfake_score=deepfake.final_score width=metadata.width height=metadata.height duration_sec=metadata.duration_sec",
}
BIO, TEXT = 300, 500


def properties(spec: dict[str, str]) -> list[tuple[str, str, str]]:
    """(name, path, kind) of each property."""
    out = []
    for kind, names in spec.items():
        for item in names.split():
            name, _, path = item.partition("=")
            out.append((name, path or name, kind))
    return out


def at(df: DataFrame, path: str) -> Column | None:
    """The column at a path, if the table has it."""
    kind: T.DataType = df.schema
    for part in path.split("."):
        if not isinstance(kind, T.StructType) or part not in kind.fieldNames():
            return None
        kind = kind[part].dataType
    return F.col(path)


def projected(df: DataFrame, spec: dict[str, str]) -> list[Column]:
    out = []
    for name, path, kind in properties(spec):
        c = at(df, path)
        if kind == "text":
            c = F.coalesce(c.cast("string"), F.lit("")) if c is not None else F.lit("")
        elif kind == "number":
            c = F.coalesce(c, F.lit(0)) if c is not None else F.lit(0)
        elif kind == "flag":
            c = F.coalesce(c, F.lit(False)) if c is not None else F.lit(False)
        elif kind == "list":
            c = F.coalesce(F.filter(c, lambda x: x.isNotNull()), F.array().cast("array<string>")) if c is not None else F.array().cast("array<string>")
        elif c is None:
            c = F.lit(None).cast("double")
        out.append(c.alias(name))
    return out


def account_nodes(accounts: DataFrame) -> DataFrame:
    """Accounts without a platform or an id there are no nodes."""
    known = accounts.filter("coalesce(platform, '') <> '' and coalesce(platform_id, '') <> ''")
    return known.select(F.col("_id").cast("string").alias("mongo_id"), *projected(known, ACCOUNT)).withColumn("bio", F.substring("bio", 1, BIO))


def post_nodes(posts: DataFrame) -> DataFrame:
    """Posts without a platform are no nodes; a post is a duplicate if it names an original, synthetic by its prediction."""
    known = posts.filter("coalesce(platform, '') <> ''")
    copied, label = at(known, "nlp.is_duplicate_of"), at(known, "deepfake.prediction")
    return known.select(
        F.col("_id").cast("string").alias("mongo_id"), *projected(known, POST), (copied.isNotNull() if copied is not None else F.lit(False)).alias("is_duplicate"),
        (F.coalesce(label == "synthetic", F.lit(False)) if label is not None else F.lit(False)).alias("is_synthetic")).withColumn("text", F.substring("text", 1, TEXT))


def media_nodes(media: DataFrame) -> DataFrame:
    """Media with the posts that use them; one that counts no use counts as one."""
    known = media.filter("_id is not null")
    seen, users = at(known, "reuse.seen_count"), at(known, "reuse.post_ids")
    one = F.when(seen != 0, seen).otherwise(1) if seen is not None else F.lit(1)
    ids = F.coalesce(F.transform(users, lambda x: x.cast("string")), F.array().cast("array<string>")) if users is not None else F.array().cast("array<string>")
    return known.select(F.col("_id").cast("string").alias("mongo_id"), *projected(known, MEDIA), one.alias("reuse_count"), ids.alias("post_ids"))


def media_posts(media: DataFrame, posts: DataFrame) -> DataFrame:
    """(media_id, post_id): the posts a medium names, or where it names none the posts that name it: media(media_id, post_ids), posts(post_id, media_ids)."""
    own = media.select("media_id", F.explode("post_ids").alias("post_id"))
    bare = media.filter(F.coalesce(F.size("post_ids"), F.lit(0)) <= 0).select("media_id")
    back = posts.select("post_id", F.explode("media_ids").alias("media_id")).join(bare, "media_id", "left_semi").select("media_id", "post_id")
    return own.unionByName(back).distinct()


def media_of_account(media: DataFrame, post_ids: DataFrame, names: DataFrame, k: int = 100) -> DataFrame:
    """The scored media of an account, best first, found by its posts or by its names, whichever finds more (its posts if as many).

    media(media_id, post_ids, source_user, status, final_score), post_ids(post_id), names(name)."""
    done = media.filter("status = 'done'")
    by_post = done.select("media_id", F.explode("post_ids").alias("post_id")).join(post_ids, "post_id", "left_semi").select("media_id").distinct().withColumn("way", F.lit(0))
    by_name = done.join(names.select(F.col("name").alias("source_user")), "source_user", "left_semi").select("media_id").distinct().withColumn("way", F.lit(1))
    found = by_post.unionByName(by_name)
    best = found.groupBy("way").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "way").limit(1)  # one row
    ids = found.join(F.broadcast(best.select("way")), "way", "left_semi").select("media_id")
    return done.join(ids, "media_id", "left_semi").select("media_id", "final_score").orderBy(F.desc("final_score"), "media_id").limit(k)
