"""Scraper exports: JSON files of one post or an array of posts, and the media beside them.

Layout: <root>/<project>/converted_<scan>/<user>/converted_<stem>[.info].json, the raw
media in <root>/<project>/<scan>/<user>/<stem>.<extension>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flockscope.functions import scalars as S
from flockscope.operators import store

# The fields of an export.
_S = T.StringType()
_TAGS = T.ArrayType(_S)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


COMMENT = _struct(comment_id=_S, author=_S, author_id=_S, text=_S, timestamp=_S, likes=T.LongType(), reply_to_id=_S, hashtags=_TAGS, mentions=_TAGS)
POST = _struct(
    scrappeurInfo=_struct(version=_S, platform=_S, content_type=_S, gdh_scrap=_S, media_telecharge=T.BooleanType(), media_path=_S, scrapper_id=_S),
    id=_S, post_url=_S, media_type=_S, platform=_S, desc=_S, createTime=_S, video_url=_S, cover=_S,
    author=_struct(name=_S, id=_S, uniqueId=_S, avatar=_S, url=_S), music=_struct(title=_S, author=_S), hashtags=_TAGS, mentions=_TAGS,
    stats=_struct(likes=T.LongType(), comments=T.LongType(), shares=T.LongType(), plays=T.LongType(), favorites=T.LongType()),
    comments=T.ArrayType(COMMENT), is_fake=T.BooleanType(), fake_confidence=T.DoubleType(), manually_reviewed=T.BooleanType(),
    influence_score=T.DoubleType(), is_bot_suspected=T.BooleanType(), _corrupt_record=_S)

# File extensions by kind of media.
IMAGE = ("jpg", "jpeg", "png", "webp", "bmp", "tiff", "tif")
VIDEO = ("mp4", "mov", "avi", "mkv", "webm", "flv")
AUDIO = ("mp3", "m4a", "ogg", "wav", "aac")
GIF = ("gif",)
EXTENSIONS = IMAGE + VIDEO + AUDIO + GIF


def read_posts(spark: SparkSession, root: str, pattern: str = "converted_*.json") -> DataFrame:
    """All exports under ``root``, objects and arrays alike, with their path; what cannot be parsed is in _corrupt_record."""
    reader = spark.read.schema(POST).option("multiLine", True).option("mode", "PERMISSIVE").option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    return reader.json(root).withColumn("path", F.col("_metadata.file_path")).filter(~F.col("path").endswith("Zone.Identifier"))


def stream_posts(spark: SparkSession, root: str, pattern: str = "*.json", archive: str | None = None) -> DataFrame:
    """New exports as they arrive; files taken go to ``archive`` if one is given."""
    reader = spark.readStream.schema(POST).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return reader.json(root).withColumn("path", F.col("_metadata.file_path"))


def source_context(path: Column) -> list[Column]:
    """project, scan and user from the path's last directories."""
    parts = F.split(path, "/")
    at = lambda k: S.truthy(F.try_element_at(parts, F.lit(-k)))
    return [at(4).alias("project"), F.regexp_replace(at(3), "^converted_", "").alias("scan"), at(2).alias("user")]


def raw_stem(path: Column) -> Column:
    """Directory and stem that an export's media share with it."""
    name = F.regexp_replace(path, r"\.json$", "")
    name = F.regexp_replace(name, r"\.info$", "")
    return F.regexp_replace(name, r"/converted_", "/")


def validation(post_id: Column, platform: Column, author: Column, url: Column, media: Column, info: Column) -> tuple[Column, Column]:
    """Codes of what makes a record unusable, and of what is odd about it."""
    fatal = store.codes({"no_info": info.isNull(), "unknown_platform": ~F.coalesce(platform.isin(*S.PLATFORMS), F.lit(False)), "no_id": S.truthy(post_id).isNull()})
    warn = store.codes({"id_is_author": F.coalesce((platform == "twitter") & (post_id == author), F.lit(False)), "no_url": S.truthy(url).isNull(), "no_media_type": S.truthy(media).isNull()})
    return fatal, warn


def normalize(raw: DataFrame) -> DataFrame:
    """Exports to posts: keys, addresses, times, counts, labels, with fatal and warning codes."""
    platform = S.normalize_platform(S.first_truthy(F.col("scrappeurInfo.platform"), F.col("platform")))
    author = S.account_key(F.col("author.id"), F.col("author.uniqueId"), F.col("author.name"))
    media = S.infer_media_type(F.col("media_type"), F.col("video_url"), F.col("cover"))
    fatal, warn = validation(F.col("id"), platform, F.col("author.name"), F.col("post_url"), F.col("media_type"), F.col("scrappeurInfo"))
    two = F.size(F.split("id", "/")) == 2
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return raw.select(
        platform.alias("platform"), F.col("id").alias("platform_id"), author.alias("account_id"), F.col("desc").alias("text"), S.normalize_hashtags(F.col("hashtags")).alias("hashtags"), F.col("mentions"),
        S.infer_post_url(F.col("post_url"), platform, F.col("id"), S.first_truthy(F.col("author.uniqueId"), F.col("author.name"))).alias("url"), media.alias("media_type"),
        S.parse_datetime(F.col("createTime")).alias("published_at"), S.parse_datetime(F.col("scrappeurInfo.gdh_scrap")).alias("scraped_at"),
        F.struct(zero("stats.likes").alias("likes"), zero("stats.shares").alias("shares"), zero("stats.comments").alias("comments"), zero("stats.plays").alias("views"), zero("stats.favorites").alias("saves")).alias("engagement"),
        F.when(F.col("is_fake"), "synthetic").when(~F.col("is_fake"), "likely_real").alias("prediction"), F.when(F.col("is_fake").isNotNull(), F.coalesce("fake_confidence", F.lit(0.0))).alias("final_score"), F.lit("pending").alias("status"),
        F.when(two & (platform == "telegram"), F.split_part("id", F.lit("/"), F.lit(1))).alias("channel"), F.when(two & (platform == "telegram"), F.split_part("id", F.lit("/"), F.lit(2))).alias("message"),
        F.col("comments"), F.col("path"), *source_context(F.col("path")), F.array_join(fatal, ",").alias("fatal"), F.array_join(warn, ",").alias("warnings"))


def comments(posts: DataFrame) -> DataFrame:
    """One row a comment; replies have depth 1."""
    c = posts.select("platform", "platform_id", F.posexplode("comments").alias("i", "c"))
    return c.select("platform", F.col("platform_id").alias("post_id"), F.coalesce(S.truthy(F.col("c.comment_id")), F.concat(F.col("platform_id"), F.lit("_c"), F.col("i").cast("string"))).alias("platform_id"),
                    S.account_key(F.col("c.author_id"), F.col("c.author"), F.lit(None).cast("string")).alias("account_id"), F.col("c.text").alias("text"), S.parse_datetime(F.col("c.timestamp")).alias("published_at"),
                    F.coalesce("c.likes", F.lit(0)).alias("likes"), S.truthy(F.col("c.reply_to_id")).alias("parent_id"), F.when(S.truthy(F.col("c.reply_to_id")).isNotNull(), 1).otherwise(0).alias("depth"))


def media_kind(extension: Column) -> Column:
    """video, audio, gif or, for all others, image."""
    ext = F.lower(F.regexp_replace(extension, r"^\.", ""))
    return F.when(ext.isin(*VIDEO), "video").when(ext.isin(*AUDIO), "audio").when(ext.isin(*GIF), "gif").otherwise("image")


def media_files(spark: SparkSession, root: str, posts: DataFrame) -> DataFrame:
    """posts(platform_id, path) with the files beside them: their paths, sizes and kinds."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "modificationTime")
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    kind = media_kind(ext)
    files = listing.filter(ext.isin(*EXTENSIONS)).select(F.regexp_replace("path", r"\.[A-Za-z0-9]+$", "").alias("_stem"), F.col("path").alias("url_local"), "length", kind.alias("type"))
    stem = F.regexp_replace(raw_stem(F.col("path")), r"^file:/+", "file:/")
    return posts.select("platform_id", stem.alias("_key")).join(files.withColumn("_stem", F.regexp_replace("_stem", r"^file:/+", "file:/")), F.col("_key") == F.col("_stem")).drop("_key", "_stem")
