"""Mixing sources to target weights (operator 1), in DataFrame operations only.

A low-discrepancy schedule of slots decides which source gives the next block of
words.  Slot ``i`` stands at the golden-ratio point ``frac(i * phi)``, kept exact as
an integer modulo 2**31; the points are mapped through the cumulative target
weights, so every stretch of the schedule holds the sources in their proportions.
Slots are ranked per source, and the r-th slot of a source takes its block
``r mod n_blocks`` of a shuffled stream cut into blocks of equally many words.

Targets: the sources, in code point order with null last, weigh ``weights`` in turn
and share ``share`` times all words; none may exceed ``max_repeats`` times what it
has, and the excess goes to the others by weight.

Defined results: null texts and texts without words have size 0 and take 0; a null
source is a source of its own; repeated rows and null ids are mixed as rows of their
own (ties are ordered by size); an empty table gives an empty result; further
columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: The golden ratio's fraction times 2**31, made odd: a Weyl step of full period.
STEP, PERIOD = 1327217885, 1 << 31
#: Slots ranked together, cells of the weight line, rows per slice of a source.
CHUNK, CELLS, SLICE = 1024, 4096, 512


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights: tuple[int, ...], share: float, max_repeats: int) -> DataFrame:
    """One row a source: its size, weight, target, and its stretch [lo, hi) of the weight line.

    The water level at which the shares fill ``share`` of all words is found in closed
    form: sources are ordered by the level at which they are full.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("rank"), F.lit(len(weights))) + 1).cast("int"))
    one = by_source.withColumn("rank", rank).withColumn("weight", turn.cast("long"))
    one = one.withColumn("cap", F.col("source_size") * max_repeats)
    full = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    one = (one.withColumn("caps", F.coalesce(F.sum("cap").over(full), F.lit(0)))
           .withColumn("left", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(full), F.lit(0)))
           .withColumn("words", F.sum("source_size").over(whole)))
    # if this source and all that fill later are open, the level is:
    one = one.withColumn("level", (F.col("words") * F.lit(float(share)) - F.col("caps")) / F.col("left"))
    one = one.withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
    level = F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(
        Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    one = one.withColumn("level", F.coalesce(level, F.lit(float("inf"))))
    full_now = F.col("level") * F.col("weight") > F.col("cap")
    one = one.withColumn("target", F.when(full_now, F.col("cap").cast("double")).otherwise(F.col("level") * F.col("weight")))
    upto = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    ints = F.sum(F.when(full_now, F.col("cap")).otherwise(0)).over(upto)
    parts = F.sum(F.when(full_now, F.lit(0)).otherwise(F.col("weight"))).over(upto)
    level = F.when(F.col("level") == float("inf"), F.lit(0.0)).otherwise(F.col("level"))
    one = one.withColumn("upto", ints.cast("double") + level * parts)
    total = F.max("upto").over(whole)
    hi = F.when(total > 0, F.floor(F.col("upto") / total * F.lit(float(PERIOD)))).otherwise(0).cast("long")
    one = one.withColumn("hi", hi)
    lo = F.coalesce(F.lag("hi").over(Window.orderBy("rank")), F.lit(0))
    return one.withColumn("lo", lo.cast("long")).select("source", "rank", "source_size", "weight", "target", "lo", "hi")


def schedule(spark, sources: DataFrame, n_slots: int) -> DataFrame:
    """Slots ``(slot, rank, turn)``: the source (by rank) of each, and its place among that source's."""
    slots = spark.range(n_slots).select(F.col("id").alias("slot"))
    slots = slots.withColumn("point", F.pmod(F.pmod(F.col("slot"), F.lit(PERIOD)) * F.lit(STEP), F.lit(PERIOD)))
    width = PERIOD // CELLS
    cells = sources.filter("hi > lo").select(
        F.col("rank"), "lo", "hi",
        F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))).alias("cell"))
    placed = (slots.withColumn("cell", F.floor(F.col("point") / width)).join(cells, "cell")
              .filter("lo <= point and point < hi").select("slot", F.col("rank"), F.floor(F.col("slot") / CHUNK).alias("chunk")))
    per_chunk = placed.groupBy("rank", "chunk").agg(F.count(F.lit(1)).alias("n"))
    starts = common.offsets(per_chunk, ["rank"], "chunk", "n", "start").select("rank", "chunk", "start")
    within = Window.partitionBy("rank", "chunk").orderBy("slot")
    return (placed.withColumn("within", F.row_number().over(within) - 1).join(starts, ["rank", "chunk"])
            .select("slot", "rank", (F.col("start") + F.col("within")).alias("turn")))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, max_repeats: int = 2,
        block_words: int = 32) -> DataFrame:
    """Per row of ``docs``: doc_id, source, key, size, source_size, target and the words ``taken``."""
    spark = docs.sparkSession
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                        common.row_key().alias("key"), word_count(F.col("text")).alias("size"))
    sized = common.materialize(sized, "mix-sized")
    words, rows = sized.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    sources = common.materialize(targets(sized, weights, share, max_repeats), "mix-sources")
    placed = sized.withColumn("_s", F.col("source")).drop("source").join(
        sources, F.col("_s").eqNullSafe(F.col("source"))).drop("_s")
    # shuffled streams: the digest orders the documents, its first digits slice them
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    placed = placed.withColumn("digest", digest)
    spread = F.conv(F.substring("digest", 1, 6), 16, 10).cast("long") / F.lit(float(1 << 24))
    placed = common.prefix_sum(placed, ["rank"], [F.col("digest"), F.col("size"), F.col("key")], F.col("size"), spread,
                               max(1, rows // SLICE), "start")
    placed = common.materialize(placed.drop("digest", "lo", "hi"), "mix-placed")
    blocks = F.ceil(F.col("source_size") / block_words)
    turns = schedule(spark, sources, int(words * share) // block_words)
    used = (turns.join(sources.select("rank", blocks.cast("long").alias("blocks")), "rank")
            .filter(F.col("turn") < F.col("blocks") * max_repeats)
            .groupBy("rank", F.pmod(F.col("turn"), F.col("blocks")).alias("block")).agg(F.count(F.lit(1)).alias("uses")))
    end = F.col("start") + F.col("size")
    parts = placed.filter("size > 0").select(
        "doc_id", "key", "size", "start", "rank",
        F.explode(F.sequence(F.floor(F.col("start") / block_words), F.floor((end - 1) / block_words))).alias("block"))
    overlap = F.least(end, (F.col("block") + 1) * block_words) - F.greatest(F.col("start"), F.col("block") * block_words)
    taken = (parts.join(used, ["rank", "block"]).groupBy(F.col("rank").alias("_rank"), F.col("start").alias("_start"), F.col("key").alias("_key"))
             .agg(F.sum(overlap * F.col("uses")).alias("_taken")))
    # start is a row's own place in its source's stream, so it tells equal rows apart
    same = (F.col("rank") == F.col("_rank")) & (F.col("start") == F.col("_start")) & (F.col("key") == F.col("_key")) & (F.col("size") > 0)
    return (placed.join(taken, same, "left")
            .select("doc_id", "source", "key", "size", "source_size", "target",
                    F.coalesce("_taken", F.lit(0)).cast("long").alias("taken")))


def op1_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix(common.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size, 2 * sum(size)::BIGINT AS cap,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM sized GROUP BY source),
w AS (SELECT *, [5, 2, 1][(r % 3 + 1)::INT] AS weight, (SELECT sum(size) FROM sized)::BIGINT AS words FROM src),
ladder AS (
  SELECT a.r, (a.words * 1.5::DOUBLE - (SELECT coalesce(sum(cap), 0) FROM w b WHERE (b.cap::DOUBLE / b.weight, b.r) < (a.cap::DOUBLE / a.weight, a.r)))::DOUBLE
       / (SELECT sum(weight) FROM w b WHERE (b.cap::DOUBLE / b.weight, b.r) >= (a.cap::DOUBLE / a.weight, a.r)) AS level,
       a.cap::DOUBLE / a.weight AS full_at, a.weight, a.cap FROM w a),
lev AS (SELECT level FROM ladder WHERE level * weight <= cap ORDER BY full_at, r LIMIT 1),
tgt AS (
  SELECT w.*, CASE WHEN level * weight > cap THEN cap::DOUBLE ELSE level * weight END AS target,
         sum(CASE WHEN level * weight > cap THEN cap ELSE 0 END) OVER (ORDER BY r)::DOUBLE
         + level * sum(CASE WHEN level * weight > cap THEN 0 ELSE weight END) OVER (ORDER BY r)::DOUBLE AS upto FROM w, lev),
line AS (SELECT *, floor(upto / max(upto) OVER () * 2147483648.0::DOUBLE)::BIGINT AS hi FROM tgt),
ends AS (SELECT *, coalesce(lag(hi) OVER (ORDER BY r), 0) AS lo, ((source_size + 31) // 32)::BIGINT AS blocks FROM line),
slots AS (
  SELECT i, (i * 1327217885) % 2147483648 AS p
  FROM (SELECT unnest(range((SELECT (sum(size) * 1.5::DOUBLE)::BIGINT // 32 FROM sized))) AS i)),
turns AS (
  SELECT r, blocks, row_number() OVER (PARTITION BY r ORDER BY i) - 1 AS t FROM slots JOIN ends ON lo <= p AND p < hi),
used AS (SELECT r, t % blocks AS block, count(*) AS uses FROM turns WHERE t < 2 * blocks GROUP BY ALL),
placed AS (
  SELECT s.doc_id, s.size, e.r, e.source_size, e.target,
         (sum(s.size) OVER (PARTITION BY e.r ORDER BY md5(coalesce(s.doc_id::VARCHAR, '')), s.size ROWS UNBOUNDED PRECEDING))::BIGINT - s.size AS start
  FROM sized s JOIN ends e ON s.source IS NOT DISTINCT FROM e.source),
parts AS (SELECT *, unnest(range(start // 32, (start + size - 1) // 32 + 1)) AS block FROM placed WHERE size > 0),
taken AS (
  SELECT r, start, sum((least(start + size, (block + 1) * 32) - greatest(start, block * 32)) * uses)::BIGINT AS n
  FROM parts JOIN used USING (r, block) GROUP BY ALL)
SELECT doc_id, size, source_size, target, coalesce(n, 0)::BIGINT AS taken
FROM placed LEFT JOIN taken ON placed.r = taken.r AND placed.start = taken.start AND size > 0
"""
