"""Streams over the events table, read to their end, against the batch results."""

from __future__ import annotations

from pyspark.sql import functions as F

from flockscope.plans.catalog import query
from flockscope.streaming import pipelines as P
from flockscope.streaming import state


def _stream(spark, d, name):
    """A table as a stream, whether it is one file or a folder of them."""
    from flockscope.tables import load

    table = load(spark, d, name)
    reader = spark.readStream.schema(table.schema)
    if all(f.rstrip("/").endswith(f"/{name}.parquet") for f in table.inputFiles()):
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(f"{d}")
    return reader.parquet(f"{d}/{name}.parquet")


def _events(spark, d):
    return _stream(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))


@query("SELECT event_id, user_id, event_type, 'k' || json_extract_string(props, '$.k') AS hashtag FROM events WHERE event_type <> 'error'")
def stream_ingest_availablenow(spark, d):
    shape = lambda s: s.filter("event_type <> 'error'").select("event_id", "user_id", "event_type", F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("hashtag"))
    return P.ingest(spark, _events(spark, d), shape)


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark, d):
    return P.ingest(spark, _events(spark, d), lambda s: P.first_writes(s, ["user_id", "event_type"], "at", "400 days").select("user_id", "event_type"))


@query("SELECT ts::DATE AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_burst_tumbling(spark, d):
    out = P.tumbling_counts(spark, _events(spark, d), "at", ["event_type"], "1 day", "2 days")
    return out.select(F.to_date("start").alias("day"), "event_type", "n")


@query("SELECT s AS start, event_type, count(*) AS n FROM (SELECT event_type, unnest(generate_series(date_trunc('hour', ts) - INTERVAL 23 HOUR, date_trunc('hour', ts), INTERVAL 1 HOUR)) AS s FROM events) GROUP BY 1, 2 HAVING count(*) >= 20")
def stream_burst_sliding(spark, d):
    out = P.sliding_counts(spark, _events(spark, d), "at", ["event_type"], "24 hours", "1 hour", 20, "2 days")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, g")
def stream_sessions(spark, d):
    out = state.sessions(spark, _events(spark, d), "at", ["user_id"], "2 hours", "2 days")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT event_id, event_type FROM events WHERE event_type <> 'error'")
def stream_after_backfill(spark, d):
    """Half of the events as history, all of them streamed after it: each is there once."""
    folder = P.work_folder(spark)
    shape = lambda s: s.filter("event_type <> 'error'").select("event_id", "event_type")
    from flockscope.tables import load

    history = load(spark, d, "events").filter("event_type in ('view', 'click')")
    return P.backfill_then_stream(history, _events(spark, d), shape, f"{folder}/out", f"{folder}/checkpoint", ["event_id"], []).read()


_JOBS = """, e AS (SELECT user_id || '-' || kk % 8 AS job_id, CASE event_type WHEN 'signup' THEN 'created' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'fail' ELSE 'claim' END AS kind,
    epoch_us(ts) AS tick, 'w' || event_id % 2 AS worker, event_id % 3 > 0 AS retry, row_number() OVER (PARTITION BY user_id || '-' || kk % 8 ORDER BY ts, event_id) AS rn FROM raw_posts),
all_states AS (WITH RECURSIVE s AS (SELECT DISTINCT job_id, 0::BIGINT AS rn, NULL::VARCHAR AS status, 0 AS attempts, NULL::VARCHAR AS worker, NULL::VARCHAR AS error, 0::BIGINT AS until FROM e
  UNION ALL SELECT job_id, rn, CASE WHEN made THEN 'pending' WHEN claimed THEN 'processing' WHEN done THEN 'done' WHEN failed THEN CASE WHEN retry AND attempts < 3 THEN 'retrying' ELSE 'error' END ELSE status END,
    attempts + claimed::INT, CASE WHEN claimed THEN who WHEN done OR failed THEN NULL ELSE worker END, CASE WHEN failed THEN 'failed' ELSE error END, CASE WHEN claimed THEN tick + 345600000000 ELSE until END
  FROM (SELECT *, kind = 'created' AND status IS NULL AS made, kind = 'claim' AND status IN ('pending', 'retrying') IS TRUE AND attempts < 3 AS claimed,
      (kind = 'complete' AND status = 'processing' AND who = worker) IS TRUE AS done, (kind = 'fail' AND status = 'processing' AND who = worker) IS TRUE AS failed
    FROM (SELECT s.job_id, e.rn, kind, tick, e.worker AS who, retry, s.attempts, until, CASE WHEN late THEN CASE WHEN s.attempts < 3 THEN 'retrying' ELSE 'error' END ELSE status END AS status,
        CASE WHEN late THEN NULL ELSE s.worker END AS worker, CASE WHEN late THEN 'lease expired' ELSE error END AS error
      FROM (SELECT *, rn + 1 AS nxt FROM s) s JOIN e ON e.job_id = s.job_id AND e.rn = nxt, LATERAL (SELECT (status = 'processing' AND e.tick > until) IS TRUE AS late))))
  SELECT * FROM s),
l AS (SELECT job_id, last(status ORDER BY rn) AS status, last(attempts ORDER BY rn) AS attempts, last(worker ORDER BY rn) AS worker, last(error ORDER BY rn) AS error, last(until ORDER BY rn) AS until FROM all_states GROUP BY 1),
m AS (SELECT max(tick) // 1000 - 60000 AS mark FROM e)
SELECT job_id, CASE WHEN out THEN CASE WHEN attempts < 3 THEN 'retrying' ELSE 'error' END ELSE status END AS status, attempts, CASE WHEN NOT out THEN worker END AS worker,
  CASE WHEN out THEN 'lease expired' ELSE error END AS error FROM (SELECT *, status = 'processing' AND until // 1000 + 1 <= mark AS out FROM l, m) WHERE status IS NOT NULL"""


@query(_JOBS)
def stream_job_queue(spark, d):
    """Events as what happens to jobs, with leases of four days."""
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.when(F.col("event_type") == "signup", "created").when(F.col("event_type") == "purchase", "complete").when(F.col("event_type") == "error", "fail").otherwise("claim")
    jobs = _events(spark, d).select(F.concat_ws("-", "user_id", k % 8).alias("job_id"), kind.alias("kind"), F.col("at").alias("ts"), F.col("event_id").alias("seq"),
                                    F.concat(F.lit("w"), (F.col("event_id") % 2).cast("string")).alias("worker"), (F.col("event_id") % 3 > 0).alias("retry"))
    return state.last_states(spark, state.job_states(jobs, "4 days"), "job_id")


@query("""SELECT id, duplicate_of, round(score, 6) AS score FROM (SELECT a.id, b.id AS duplicate_of, round(list_cosine_similarity(a.v, b.v), 9) AS score,
    row_number() OVER (PARTITION BY a.id ORDER BY round(list_cosine_similarity(a.v, b.v), 9) DESC, b.id) AS p
  FROM e a JOIN e b ON a.label = b.label AND b.rn BETWEEN a.rn - 40 AND a.rn - 1) WHERE p = 1 AND score >= 0.3::DOUBLE""".replace("SELECT id,", ", e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings WHERE embedding IS NOT NULL) SELECT id,", 1))
def stream_recent_duplicates(spark, d):
    """Vectors in the order of their ids, each against the forty before it with its label."""
    rows = _stream(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.col("vec_id").alias("at"), "label")
    return state.found_duplicates(spark, state.recent_duplicates(rows, "label", 0.3, 40)).withColumn("score", F.round("score", 6))
