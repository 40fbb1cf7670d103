"""Keyed writes, cursors and record checks: what document stores do in place, as whole-table operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flockscope.functions import scalars as S


def cursor_changes(listing: DataFrame, cursor: DataFrame, key: list[str]) -> DataFrame:
    """What is new in the listing and what has gone from it since the cursor."""
    new = listing.join(cursor, key, "left_anti").select(F.lit("new").alias("change"), *key)
    return new.unionByName(cursor.join(listing, key, "left_anti").select(F.lit("gone").alias("change"), *key))


def distinct_values(df: DataFrame, field: str) -> DataFrame:
    return df.select(S.truthy(F.col(field)).alias("value")).filter("value is not null").distinct().orderBy("value")


def _by_key(df: DataFrame, key: list[str], order: list[str], agg) -> DataFrame:
    # one aggregate instead of a window: combined before the shuffle, no sort of a hot key's rows
    rest = [c for c in df.columns if c not in key and c not in order]
    picked = df.groupBy(*key).agg(agg(F.struct(*order, *rest)).alias("_r"))
    return picked.select(*key, *[F.col(f"_r.{c}").alias(c) for c in [*order, *rest]])


def keep_first(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """First write wins."""
    return _by_key(df, key, order, F.min)


def keep_last(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Last write wins."""
    return _by_key(df, key, order, F.max)


def insert_absent(new: DataFrame, have: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The rows an insert-only upsert adds to ``have``."""
    return keep_first(new, key, order).join(have.select(*key), key, "left_anti")


def prefix_map(column: str, prefix: str) -> Column:
    """The entries of a map whose keys start with the prefix, without it."""
    return F.transform_keys(F.map_filter(column, lambda k, v: k.startswith(prefix)), lambda k, v: F.substring(k, len(prefix) + 1, 1 << 20))


def media_reuse(links: DataFrame) -> DataFrame:
    """By media: distinct posts that use it, what a counter bumped at each attach would say, its platforms."""
    return links.groupBy("media_id").agg(F.count_distinct("post_id").alias("seen_count"), (F.count(F.lit(1)) + 1).alias("legacy_seen_count"),
                                         F.array_join(F.sort_array(F.collect_set("platform")), ",").alias("platforms"))


def matched_edges(edges: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Edges with both ends there, once each."""
    left, right = sources.select(F.col("id").alias("src")), targets.select(F.col("id").alias("dst"))
    return edges.join(left, "src", "left_semi").join(right, "dst", "left_semi").select("src", "dst").distinct()


def purge_preview(frames: dict[str, DataFrame], purge: Column, reset: Column) -> DataFrame:
    rows = [df.agg(F.count(F.lit(1)).alias("total"), F.count_if(purge).alias("to_purge"), F.count_if(reset).alias("to_reset")).select(F.lit(n).alias("collection"), "*") for n, df in frames.items()]
    return reduce(DataFrame.unionByName, rows)


def not_expired(df: DataFrame, completed: Column, now: Column, days: int) -> DataFrame:
    return df.filter(completed.isNull() | (completed > now - F.make_dt_interval(F.lit(days))))


def key_violations(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def explode_comments(posts: DataFrame) -> DataFrame:
    """posts(post_id, comments array<struct<turn,role,text>>) to one row a comment, numbered in order."""
    c = posts.select("post_id", F.posexplode("comments").alias("i", "c"))
    return c.select("post_id", F.concat(F.col("post_id").cast("string"), F.lit("_c"), F.col("c.turn").cast("string")).alias("comment_id"),
                    F.coalesce(S.truthy(F.col("c.role")), F.lit("unknown")).alias("author"), F.when(F.col("c.turn") > 0, 1).otherwise(0).alias("depth"), F.length("c.text").cast("long").alias("chars"))


def codes(checks: dict[str, Column]) -> Column:
    """The codes of the checks that hold, in order."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(code)) for code, cond in checks.items()]))


def clean_frame(df: DataFrame) -> DataFrame:
    """``clean_nulls`` on every text of every column, also within structs, arrays and maps."""
    return df.select(*[S.clean_deep(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def claim_jobs(jobs: DataFrame, workers: int, max_attempts: int = 3) -> DataFrame:
    """The jobs that ``workers`` would take, by priority then age; failed ones are taken again."""
    ready = jobs.filter(F.col("status").isin("pending", "retrying") & (F.col("attempts") < max_attempts)).orderBy("priority", "created_at", "job_id").limit(workers)
    place = F.row_number().over(Window.orderBy("priority", "created_at", "job_id"))  # of ``workers`` rows
    return ready.select("job_id", place.cast("long").alias("place"))


def file_changes(listing: DataFrame, cursor: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """Files (path, size, mtime in seconds) against the cursor: new, changed (another size, or a time off by ``tolerance`` or more), unchanged or gone."""
    old = cursor.select("path", F.col("size").alias("_size"), F.col("mtime").alias("_mtime"))
    both = listing.select("path", "size", "mtime").join(old, "path", "full")
    same = (F.col("size") == F.col("_size")) & (F.abs(F.col("mtime") - F.col("_mtime")) < tolerance)
    change = F.when(F.col("size").isNull(), "gone").when(F.col("_size").isNull(), "new").when(same, "unchanged").otherwise("changed")
    return both.select("path", change.alias("change"))


def mark_done(cursor: DataFrame, listing: DataFrame, results: DataFrame) -> DataFrame:
    """The cursor after a run: files with results(path, errors) and no error are entered as they are listed, vanished ones go, others stay as they were."""
    clean = listing.join(results.filter("errors = 0").select("path"), "path", "left_semi").select("path", "size", "mtime")
    rest = cursor.join(clean.select("path"), "path", "left_anti").join(listing.select("path"), "path", "left_semi").select("path", "size", "mtime")
    return clean.unionByName(rest)


def inbox_states(results: DataFrame) -> DataFrame:
    """Where each file of results(path, ok, errors) goes: to done, or as .error.json back to the inbox if it has errors and nothing went well."""
    failed = (F.col("errors") > 0) & (F.col("ok") == 0)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return results.select("path", F.when(failed, "inbox").otherwise("done").alias("state"), F.when(failed, F.concat(F.regexp_replace(name, r"\.json$", ""), F.lit(".error.json"))).otherwise(name).alias("name"))


def nlp_patch(posts: DataFrame, results: DataFrame, key: str = "post_id") -> DataFrame:
    """Posts with what an analysis found: results(key, label, score, narrative_id, is_duplicate_of, similarity_score); those without a result keep their state."""
    found = results.select(key, F.struct(F.lit("done").alias("status"), "label", "score", "narrative_id", "is_duplicate_of", "similarity_score").alias("_new"))
    out = posts.join(found, key, "left")
    return out.select(*[c for c in posts.columns if c != "nlp"], F.coalesce("_new", "nlp").alias("nlp"))


def sync_patch(rows: DataFrame, synced: DataFrame, key: str, target: str) -> DataFrame:
    """Rows with the flag ``target`` set where they were synchronised."""
    return rows.join(synced.select(key, F.lit(True).alias("_s")).distinct(), key, "left").withColumn(target, F.coalesce("_s", target, F.lit(False))).drop("_s")


def reset_scores(rows: DataFrame, reset: Column, fields: tuple[str, ...] = ("final_score", "prediction", "divergence")) -> DataFrame:
    """Rows to analyse again are pending and have no scores."""
    hit = F.coalesce(reset, F.lit(False))
    out = rows
    for c in fields:
        if c in rows.columns:
            out = out.withColumn(f"_{c}", F.when(~hit, F.col(c)))
    out = out.withColumn("status", F.when(hit, F.lit("pending")).otherwise(F.col("status")))
    return out.select(*[F.col(f"_{c}").alias(c) if f"_{c}" in out.columns else F.col(c) for c in rows.columns])


def purge(rows: DataFrame, gone: Column) -> DataFrame:
    """What a selective delete leaves; where the condition is unknown the row stays."""
    return rows.filter(~F.coalesce(gone, F.lit(False)))


def heartbeats(pulses: DataFrame) -> DataFrame:
    """The last pulse of each worker of each type: pulses(type, worker, at, status)."""
    last = F.max(F.struct("at", "status")).alias("l")
    return pulses.groupBy("type", "worker").agg(last).select("type", "worker", F.col("l.at").alias("at"), F.col("l.status").alias("status"))


def write_results(df: DataFrame, folder: str) -> None:
    """Result files as CSV with a header and as JSON lines."""
    df.write.mode("overwrite").option("header", True).csv(f"{folder}/csv")
    df.write.mode("overwrite").json(f"{folder}/json")


def report_name(title: str, length: int = 40) -> str:
    """A file name from a title."""
    import re

    return re.sub(r"[^\w\-]", "_", title)[:length] + ".md"


def report(sections: dict[str, DataFrame], rows: int = 20) -> str:
    """A Markdown report: a table of the first ``rows`` rows of each section."""
    out = []
    for title, df in sections.items():
        cells = [["" if v is None else str(v) for v in r] for r in df.limit(rows).collect()]
        out += [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *("| " + " | ".join(r) + " |" for r in cells), ""]
    return "\n".join(out)


def job_counters(jobs: DataFrame) -> DataFrame:
    """Jobs by type and status."""
    return jobs.groupBy("type", "status").agg(F.count(F.lit(1)).alias("n"))


def sync_counters(rows: DataFrame, flag: str) -> DataFrame:
    """How many rows are synchronised, pending and without the flag at all."""
    f = F.col(flag)
    return rows.agg(F.count_if(f).alias("ok"), F.count_if(~f).alias("pending"), F.count_if(f.isNull()).alias("missing"))
