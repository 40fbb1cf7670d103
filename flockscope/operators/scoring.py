"""Media scoring: fusion over models, worst case per post, video frames, calibration, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flockscope.functions import scalars as S


def worst_case(media: DataFrame, low: float = S.LOW, high: float = S.HIGH) -> DataFrame:
    """media(post_id, final_score, status) to a post's highest score, its label, and done once no media is open."""
    m = media.groupBy("post_id").agg(F.max("final_score").alias("final_score"), F.bool_and(F.col("status").isin("done", "skipped", "error")).alias("all_done"))
    return m.select("post_id", "final_score", S.prediction_label(F.coalesce("final_score", F.lit(0.0)), low, high).alias("prediction"), F.when(F.col("all_done"), "done").otherwise("processing").alias("status"))


def video_frames(frames: DataFrame) -> DataFrame:
    """frames(video_id, model, score, artifact, faces) to means per model, with the frames and faces seen."""
    return frames.groupBy("video_id", "model").agg(F.round(F.avg("score"), 6).alias("avg_score"), F.round(F.coalesce(F.avg("artifact"), F.lit(0.5)), 6).alias("avg_artifact"), F.count(F.lit(1)).alias("frames"), F.sum("faces").alias("faces"))


def calibrate_fp_first(scores: DataFrame) -> DataFrame:
    """scores(model, score, is_alt) to each model's bias and weight; false positives on real media cost most.

    A model without real media counts as wrong on all of them (mean 1, factor 0), one without altered
    media as right on all (mean 0, factor 1); neither gains anything.  If no model does, all weigh the same.
    """
    alt, real = F.when(F.col("is_alt"), F.col("score")), F.when(~F.col("is_alt"), F.col("score"))
    a = scores.groupBy("model").agg(F.avg(real).alias("r"), F.avg(alt).alias("t"), F.count(real).alias("n_real"), F.count(alt).alias("n_alt"))
    both = (F.col("n_real") > 0) & (F.col("n_alt") > 0)
    a = a.select("model", F.when(both, F.col("r")).when(F.col("n_real") == 0, 1.0).otherwise(0.0).alias("avg_real"), F.when(both, F.col("t")).otherwise(0.0).alias("avg_alt"), "n_real", "n_alt")
    a = a.withColumn("fp_factor", F.pow(1 - F.col("avg_real"), F.lit(2.0))).withColumn("margin", F.when(both, F.col("avg_alt") - F.col("avg_real")).otherwise(0.0))
    a = a.withColumn("score", F.greatest(F.lit(0.0), F.col("margin")) * F.col("fp_factor"))
    total, n = F.sum("score").over(Window.partitionBy()), F.count(F.lit(1)).over(Window.partitionBy())  # one row a model
    return a.withColumn("weight", F.when(total > 0, F.col("score") / total).otherwise(1.0 / n)).withColumn("bias", F.col("avg_real"))


def binary_metrics(pairs: DataFrame) -> DataFrame:
    """pairs(truth boolean, guess boolean) to the confusion counts and what follows from them; 0 where a rate has no cases."""
    t, g = F.col("truth"), F.col("guess")
    c = pairs.agg(F.count_if(t & g).alias("tp"), F.count_if(~t & ~g).alias("tn"), F.count_if(~t & g).alias("fp"), F.count_if(t & ~g).alias("fn"))
    tp, tn, fp, fn = (F.col(x).cast("double") for x in ("tp", "tn", "fp", "fn"))
    root = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    c = c.select("tp", "tn", "fp", "fn", S.safe_div(tp, tp + fp).alias("precision"), S.safe_div(tp, tp + fn).alias("recall"), S.safe_div(tp + tn, tp + tn + fp + fn).alias("accuracy"), S.safe_div(tp * tn - fp * fn, root).alias("mcc"))
    p, r = F.col("precision"), F.col("recall")
    return c.select("tp", "tn", "fp", "fn", *[F.round(x, 6).alias(x) for x in ("precision", "recall", "accuracy", "mcc")], F.round(S.safe_div(2 * p * r, p + r), 6).alias("f1"))


def split(df: DataFrame, key: str, parts: dict[str, int], seed: int = 42) -> DataFrame:
    """Each row's part by its key's hash; ``parts`` in percent."""
    at = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(100))
    out, upto = F.lit(None).cast("string"), 100
    for name, percent in reversed(parts.items()):
        out = F.when(at < upto, F.lit(name)).otherwise(out)
        upto -= percent
    return df.withColumn("part", out)


def media_stats(media: DataFrame) -> DataFrame:
    return media.agg(F.count(F.lit(1)).alias("media"), F.round(F.avg("final_score"), 6).alias("avg_score"), F.max("final_score").alias("max_score"), F.round(F.avg("divergence"), 6).alias("avg_divergence"),
                     F.round(100.0 * F.count_if(F.col("final_score") > S.HIGH) / F.count(F.lit(1)), 4).alias("synthetic_percent"))
