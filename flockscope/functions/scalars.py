"""Column functions of the ingest, scoring and investigation layers.  All stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of platforms and the addresses of their posts.
PLATFORM_ALIASES = {"x": "twitter"}
PLATFORMS = ("twitter", "tiktok", "instagram", "telegram")
# Thresholds of the labels.
LOW, HIGH = 0.65, 0.82
AGENT_LOW, AGENT_HIGH = 0.45, 0.65


def truthy(col: Column) -> Column:
    """A string, or null where it is empty: what Python's ``or`` skips."""
    return F.nullif(col, F.lit(""))


def first_truthy(*cols: Column) -> Column:
    return F.coalesce(*[truthy(c) for c in cols])


def safe_div(a: Column, b: Column, otherwise: float = 0.0) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(otherwise))


def clamp(col: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col))


def normalize_platform(col: Column) -> Column:
    low = F.lower(col)
    out = low
    for alias, name in PLATFORM_ALIASES.items():
        out = F.when(low == alias, F.lit(name)).otherwise(out)
    return out


def infer_post_url(url: Column, platform: Column, post_id: Column, author: Column) -> Column:
    """The given address, else the one the platform would give the post; null for others."""
    built = (F.when(platform == "twitter", F.concat(F.lit("https://twitter.com/"), author, F.lit("/status/"), post_id))
             .when(platform == "tiktok", F.concat(F.lit("https://www.tiktok.com/@"), author, F.lit("/video/"), post_id))
             .when(platform == "instagram", F.concat(F.lit("https://www.instagram.com/p/"), post_id, F.lit("/")))
             .when(platform == "telegram", F.concat(F.lit("https://t.me/s/"), F.split_part(post_id, F.lit("/"), F.lit(1)))))
    return F.coalesce(truthy(url), built)


def infer_media_type(media_type: Column, video_url: Column, cover: Column) -> Column:
    return F.coalesce(truthy(media_type), F.when(truthy(video_url).isNotNull(), F.lit("video")), F.when(truthy(cover).isNotNull(), F.lit("image")))


def parse_datetime(col: Column) -> Column:
    """ISO text with or without offset, or epoch seconds; 0 and the epoch's day mean unknown."""
    text = F.trim(col)
    number = F.when(text.rlike(r"^-?\d+(\.\d+)?$"), text.cast("double"))
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"),
                 F.try_to_timestamp(F.regexp_replace(text, r"([+-]\d{2})(\d{2})$", "$1:$2")))
    return (F.when(text.startswith("1970-01-01"), F.lit(None).cast("timestamp"))
            .when(number == 0, F.lit(None).cast("timestamp")).when(number.isNotNull(), F.timestamp_seconds(number)).otherwise(iso))


def account_key(author_id: Column, unique_id: Column, name: Column) -> Column:
    return F.coalesce(truthy(author_id), truthy(unique_id), truthy(name), F.lit("unknown"))


def normalize_hashtags(tags: Column) -> Column:
    """Without leading # and blanks, lower case, first occurrences in order."""
    full = F.filter(tags, lambda t: t.isNotNull() & (F.trim(t) != ""))
    return F.array_distinct(F.transform(full, lambda t: F.trim(F.lower(F.regexp_replace(t, "^#+", "")))))


def text_preview(text: Column, length: int = 200) -> Column:
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("…"))).otherwise(text)


def bias_correction(raw: Column, bias: Column) -> Column:
    return F.when(bias <= 0, raw).otherwise(clamp((raw - bias) / F.greatest(1 - bias, F.lit(0.01))))


def model_divergence(scores: Sequence[Column]) -> Column:
    """Population standard deviation of the scores that there are; 0 for fewer than two."""
    there = F.filter(F.array(*scores), lambda x: x.isNotNull())
    n = F.size(there)
    total = F.aggregate(there, F.lit(0.0), lambda a, x: a + x)
    mean = total / F.greatest(n, F.lit(1))
    square = F.aggregate(there, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
    return F.when(n < 2, F.lit(0.0)).otherwise(F.sqrt(square / F.greatest(n, F.lit(1))))


def score_fusion(scores: Sequence[Column], weights: Sequence[float | None], artifact: Column, artifact_share: float = 0.05) -> Column:
    """Weighted mean of the scores that there are, with a share of the artifact score; 0 without any."""
    n = len(scores)
    pairs = [(s, 1.0 / n if w is None else w) for s, w in zip(scores, weights, strict=True)]
    top, bottom = F.lit(0.0), F.lit(0.0)
    for s, w in pairs:
        top = top + F.when(s.isNotNull(), s * w).otherwise(0.0)
        bottom = bottom + F.when(s.isNotNull(), F.lit(w)).otherwise(0.0)
    fused = clamp(top / bottom * (1 - artifact_share) + F.coalesce(artifact, F.lit(0.0)) * artifact_share)
    return F.when(bottom > 0, fused).otherwise(F.lit(0.0))


def prediction_label(score: Column, low: float = LOW, high: float = HIGH) -> Column:
    return F.when(score > high, F.lit("synthetic")).when(score > low, F.lit("suspicious")).otherwise(F.lit("likely_real"))


def agent_label(score: Column, low: float = AGENT_LOW, high: float = AGENT_HIGH) -> Column:
    return F.when(score < low, F.lit("likely_real")).when(score < high, F.lit("suspicious")).otherwise(F.lit("synthetic"))


def divergence_confidence(divergence: Column) -> Column:
    return F.when(divergence.isNull(), F.lit("low")).when(divergence < 0.15, F.lit("high")).when(divergence < 0.30, F.lit("medium")).otherwise(F.lit("low"))


def divergence_alert(divergence: Column, score: Column, least: float = 0.20, low: float = LOW, high: float = HIGH) -> Column:
    return (divergence > least) & (score > low) & (score < high)


def artifact_tier(luma: Column) -> Column:
    return F.when(luma < 3, 0.75).when(luma < 6, 0.55).when(luma <= 20, 0.15).when(luma <= 35, 0.35).otherwise(0.40)


def laplacian_artifact(variance: Column) -> Column:
    return F.when(variance.isNull() | F.isnan(variance), 0.5).otherwise(F.greatest(F.lit(0.0), 1 - F.least(F.lit(1.0), variance / 500)))


def frame_budget(seconds: Column, most: int | None = None) -> Column:
    budget = F.when(seconds <= 5, 3).when(seconds <= 15, 5).when(seconds <= 60, 8).when(seconds <= 180, 12).otherwise(16)
    return budget if most is None else F.least(budget, F.lit(most))


def frame_indices(total: Column, wanted: Column) -> Column:
    """Evenly spread frame numbers, rounded half to even; the middle one for a single frame."""
    spread = F.transform(F.sequence(F.lit(0), F.greatest(wanted, F.lit(1)) - 1),
                         lambda i: F.least(F.greatest(F.bround(i * (total - 1) / F.greatest(wanted - 1, F.lit(1))).cast("int"), F.lit(0)), F.greatest(total - 1, F.lit(0)).cast("int")))
    return F.when(wanted <= 1, F.array(F.floor(total / 2).cast("int"))).otherwise(spread)


def active_signals(flags: dict[str, Column]) -> Column:
    """The names of the flags that hold, in their order."""
    named = F.array(*[F.struct(F.lit(k).alias("name"), F.coalesce(v, F.lit(False)).alias("on")) for k, v in flags.items()])
    return F.transform(F.filter(named, lambda x: x["on"]), lambda x: x["name"])


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return safe_div(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def sentiment_label(label: Column) -> Column:
    low = F.lower(F.trim(label))
    return (F.when(low.isin("1 star", "2 stars", "label_0", "negative"), F.lit("negative")).when(low.isin("3 stars", "label_1", "neutral"), F.lit("neutral"))
            .when(low.isin("4 stars", "5 stars", "label_2", "positive"), F.lit("positive")).otherwise(F.lit("neutral")))


def clean_nulls(col: Column) -> Column:
    """Empty text and the epoch's day are unknown."""
    return F.when((F.trim(col) == "") | col.startswith("1970-01-01"), F.lit(None)).otherwise(col)


def plain_mean(scores: Sequence[Column]) -> Column:
    """Mean of the scores that there are, 0 without any: what is used where models are not fused."""
    there = F.filter(F.array(*scores), lambda x: x.isNotNull())
    return F.when(F.size(there) > 0, F.aggregate(there, F.lit(0.0), lambda a, x: a + x) / F.size(there)).otherwise(F.lit(0.0))


# Parts of labels that speak for made and for real media.
MADE = ("artificial", "ai", "fake", "generated", "synthetic", "deepfake", "manipulated")
REAL = ("real", "human", "authentic", "natural", "original", "not_ai", "notai")


def ai_score(results: Column) -> Column:
    """From array<struct<label, score>>: the score of the first label that speaks for made media, or one minus that of the first
    that speaks for real media, whichever label comes first; else the second score, else the first."""
    bare = lambda r: F.regexp_replace(F.lower(r["label"]), "[ _-]", "")
    holds = lambda text, parts: F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(text, p))
    told = F.transform(results, lambda r: F.when(holds(bare(r), MADE), r["score"]).when(holds(bare(r), REAL), 1.0 - r["score"]))
    second, first = F.get(results, F.lit(1))["score"], F.get(results, F.lit(0))["score"]
    return F.coalesce(F.get(F.filter(told, lambda x: x.isNotNull()), F.lit(0)), second, first).cast("double")


def from_half(raw: Column) -> Column:
    """array<float> from little-endian half-precision bytes, two a component."""
    word = lambda i: F.conv(F.hex(F.concat(F.substring(raw, i * 2 + 2, F.lit(1)), F.substring(raw, i * 2 + 1, F.lit(1)))), 16, 10).cast("int")

    def value(w: Column) -> Column:
        sign = F.when(w >= 32768, -1.0).otherwise(1.0)
        power, rest = F.shiftright(w, 10).bitwiseAND(31), w.bitwiseAND(1023)
        size = (F.when(power == 0, rest * 2.0**-24).when(power < 31, (1 + rest / 1024.0) * F.pow(F.lit(2.0), power - 15))
                .when(rest == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan"))))
        return (sign * size).cast("float")

    n = F.floor(F.length(raw) / 2).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: value(word(i)))).otherwise(F.array().cast("array<float>"))


def clean_deep(col: Column, kind) -> Column:
    """``clean_nulls`` on every text in a column of any nested kind."""
    from pyspark.sql import types as T

    if isinstance(kind, T.StringType):
        return clean_nulls(col)
    if isinstance(kind, T.ArrayType):
        return F.transform(col, lambda x: clean_deep(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(col, lambda _, v: clean_deep(v, kind.valueType))
    if isinstance(kind, T.StructType):
        return F.when(col.isNotNull(), F.struct(*[clean_deep(col[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    return col
