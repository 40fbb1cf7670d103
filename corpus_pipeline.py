"""A training corpus from raw documents, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns the documents it leaves, which are
written as Parquet and read again as the next one's ``docs``.  All but the last return
the columns of ``documents``; the last returns the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flockscope.llm import common, line_dedup, mixing, ngram_join, packing, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _keyed(docs: DataFrame) -> DataFrame:
    """The columns of documents and, as ``row``, what tells rows apart: those equal in id and text share it.  Other columns are left out, whatever their names."""
    return docs.select(*COLUMNS, common.row_key().alias("row"))


def toxicity_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go.

    Null and empty texts and null ids are judged like any row, repeated rows alike; an empty table stays empty; other columns are left out."""
    scored = toxicity.score(docs.select(COLUMNS), common.table(spark, sf_dir, "labels"))
    toxic = scored.filter("predicted = 1").select(F.col("key").alias("gone")).distinct()
    return _keyed(docs).join(toxic, F.col("row") == F.col("gone"), "left_anti").select(COLUMNS)


def line_dedup_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go, and documents of which nothing but recurring lines was there; n_chars follows the text where a line went.

    Null texts stay null, empty ones empty; repeated rows count once and are treated alike; an empty table stays empty; other columns are left out."""
    out = line_dedup.dedup(docs.select(COLUMNS))
    lost = F.col("_n_dropped") > 0
    n_chars = F.when(lost, F.length("text").cast("long")).otherwise(F.col("n_chars").cast("long"))
    return out.withColumn("n_chars", n_chars).filter(~lost | F.col("text").rlike(common.WORD)).select(COLUMNS)


def ngram_join_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, 0.8) one row stays: that with the smallest id, null ids last.

    Rows are joined as rows, not by their ids, so that repeated ids and null ids are compared like others; of rows equal in id and text one stays.
    Rows without a word link with nothing and all stay; an empty table stays empty; other columns are left out."""
    rows = _keyed(docs)
    groups = common.materialize(ngram_join.join_sets(rows.select(F.col("row").alias("doc_id"), "text"), k=5, percent=80, sampled=0.24)
                                .select(F.col("doc_id").alias("node"), "component_id", "n_shingles").filter("n_shingles > 0"), "pipeline-groups")
    ids = rows.select("row", "doc_id").join(groups.select("node", "component_id").distinct(), F.col("row") == F.col("node"))
    first = ids.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row")).alias("m")).select(F.col("m.row").alias("kept"))
    gone = groups.join(first, F.col("node") == F.col("kept"), "left_anti").select("node").distinct()
    left = rows.join(gone, F.col("row") == F.col("node"), "left_anti")
    # rows that stand there several times: one of them
    several = common.materialize(groups.groupBy("node").count().filter("count > 1").select("node"), "pipeline-several")
    once = left.join(several, F.col("row") == F.col("node"), "left_anti")
    return once.unionByName(left.join(several, F.col("row") == F.col("node"), "left_semi").dropDuplicates(["row"])).select(COLUMNS)


def mixing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often as the mix takes it: its taken words over its words, rounded half up.

    Rows that are equal in id and text share what the mix takes of them.  Documents without words are not taken; a source is one of its own
    if null, and takes nothing if its target is below a block of 32 words; an empty table stays empty; other columns are left out."""
    taken = mixing.mix(docs.select(COLUMNS)).groupBy("key").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"))
    times = taken.filter("size > 0").select(F.col("key"), F.floor(F.col("taken") / F.col("size") + 0.5).cast("int").alias("times")).filter("times > 0")
    return (_keyed(docs).join(times, F.col("row") == F.col("key"))
            .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select(COLUMNS))


def packing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences and offsets.

    Null and empty texts are one token, the closing one; repeated rows and null ids are packed row by row; an empty table gives an empty result."""
    return packing.pack(docs.select(COLUMNS)).drop("key")


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("ngram_join", ngram_join_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL cannot express the classifier, the template tree or the tokenizer.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
