"""Plumbing that the training-data operators share.

Everything here is distributed: the driver only ever holds schemas, counters
and tables whose size a parameter bounds.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: What the contracts call a word, as a Java regular expression.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only where a session names none (tests, a single machine) one is made and
    set, so that a cluster's own setting always wins.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir")
    if not found:
        found = sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="flockscope-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again.

    This cuts the lineage in a way that survives lost executors: a later stage
    rereads files instead of recomputing or losing blocks.  The files go when
    the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/flockscope/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _delete_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _delete_at_end(spark: SparkSession, path: str) -> None:
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A folder in the shared one for files that a task keeps to itself and removes; '' where the
    shared folder is a store without a path: such files then go where Spark's own spills go."""
    path = f"{shared_dir(spark)}/flockscope/{label}-{uuid.uuid4().hex}"
    parsed = urlparse(path)
    if parsed.scheme not in ("", "file"):
        return ""
    os.makedirs(parsed.path, exist_ok=True)
    _delete_at_end(spark, path)
    return parsed.path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Tells rows apart where ``doc_id`` repeats or is null; equal rows share it."""
    return F.xxhash64(F.col(doc_id), F.coalesce(F.col(text), F.lit("")), F.col(text).isNull())


def prefix_sum(df: DataFrame, group: list[str], order: list[Column], value: Column,
               spread: Column, buckets: int, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows before each row of its group.

    ``spread`` is a number in [0, 1) that rises with ``order``.  Rows are ranked in
    ``buckets`` slices of it, and only one row for 1024 slices and a group meets the others
    of its group, so a group that holds most rows is still spread over many tasks.
    ``df`` should be cheap to read twice.
    """
    sliced = df.withColumn("_slice", F.floor(spread * F.lit(buckets)).cast("int"))
    starts = offsets(sliced.groupBy(*group, "_slice").agg(F.sum(value).alias("_sum")), group, "_slice", "_sum", "_start")
    starts = starts.select(*[F.col(g).alias(f"_{g}") for g in group], F.col("_slice").alias("_at"), "_start")
    inside = Window.partitionBy(*group, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = sliced.withColumn(out, F.coalesce(F.sum(value).over(inside), F.lit(0)))
    same = F.col("_slice") == F.col("_at")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_{g}"))
    joined = ranked.join(starts, same)
    return (joined.withColumn(out, (F.col(out) + F.col("_start")).cast("long"))
            .drop("_slice", "_at", "_start", *[f"_{g}" for g in group]))


def offsets(sums: DataFrame, group: list[str], at: str, value: str, out: str, width: int = 1024) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the same group with a smaller ``at`` (whole numbers, once each).

    ``width`` neighbouring rows are summed first, so that a window meets a ``width``-th of a group's rows."""
    part = sums.withColumn("_part", F.floor(F.col(at) / width))
    whole = part.groupBy(*group, "_part").agg(F.sum(value).alias("_whole"))
    before = Window.partitionBy(*[f"_g_{g}" for g in group]).orderBy("_upto").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select(*[F.col(g).alias(f"_g_{g}") for g in group], F.col("_part").alias("_upto"), "_whole")
    whole = whole.withColumn("_ahead", F.coalesce(F.sum("_whole").over(before), F.lit(0))).drop("_whole")
    inside = Window.partitionBy(*group, "_part").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    part = part.withColumn(out, F.coalesce(F.sum(value).over(inside), F.lit(0)))
    same = F.col("_part") == F.col("_upto")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    return part.join(whole, same).select(*sums.columns, (F.col(out) + F.col("_ahead")).alias(out))


def unit(key: Column) -> Column:
    """A 64-bit hash as a number in [0, 1) that rises with the hash's low 31 bits."""
    return key.bitwiseAND(F.lit(0x7FFFFFFF)) / F.lit(float(1 << 31))


def components(edges: DataFrame, label: str, max_rounds: int = 64) -> DataFrame:
    """Connected components of the undirected ``edges(src long, dst long)``.

    Returns ``(id long, component_id long)`` for every node of an edge, the component
    being named by its smallest id.  Each round every node points to the neighbour
    with the least hash, pointers are followed once more, and the edges are
    contracted; nodes that vanish keep a pointer.  Hashing makes long chains shrink
    by a constant share each round.  Edges live in the shared folder; nothing but
    their count reaches the driver.
    """
    # (hash, id) orders nodes at random, so contraction does not crawl along sorted chains.
    order = F.struct(F.xxhash64("nbr").alias("h"), F.col("nbr").alias("v"))
    both = (edges.filter("src <> dst").select("src", "dst")
            .unionByName(edges.filter("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    both = materialize(both.distinct(), f"{label}-edges")
    mapping: DataFrame | None = None
    for turn in range(max_rounds):
        if both.isEmpty():
            break
        hood = both.select("src", F.col("dst").alias("nbr"))
        own = F.struct(F.xxhash64("src").alias("h"), F.col("src").alias("v"))
        # min over neighbours is summed up map-side, so hubs do not gather in a task
        p = (hood.groupBy("src").agg(F.min(order).alias("m"))
             .select(F.col("src").alias("id"), F.least(F.col("m"), own).getField("v").alias("to")))
        p = materialize(p, f"{label}-p{turn}")
        q = p.select(F.col("id").alias("mid"), F.col("to").alias("end"))
        p = materialize(p.join(q, F.col("to") == F.col("mid")).select("id", F.col("end").alias("to")), f"{label}-q{turn}")
        if mapping is None:
            mapping = p
        else:
            step = p.select(F.col("id").alias("k"), F.col("to").alias("next"))
            mapping = materialize(
                mapping.join(step, F.col("to") == F.col("k"), "left")
                .select("id", F.coalesce("next", "to").alias("to")), f"{label}-m{turn}")
        a = p.select(F.col("id").alias("src"), F.col("to").alias("a"))
        b = p.select(F.col("id").alias("dst"), F.col("to").alias("b"))
        # contraction by two steps stays connected: the first step's edge goes along
        moved = (both.join(a, "src").join(b, "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))
                 .filter("src <> dst"))
        both = materialize(moved.distinct(), f"{label}-e{turn + 1}")
    else:
        raise RuntimeError("components did not settle")
    if mapping is None:
        return edges.select(F.col("src").alias("id"), F.col("dst").alias("component_id")).limit(0)
    least = mapping.groupBy("to").agg(F.min(F.least("id", "to")).alias("component_id"))
    return mapping.join(least.withColumnRenamed("to", "root"), F.col("to") == F.col("root")).select("id", "component_id")


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    out: DataFrame | None = None
    for f in frames:
        out = f if out is None else out.unionByName(f)
    assert out is not None
    return out
