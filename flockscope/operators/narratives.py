"""Near duplicates, density clusters, their centroids and keywords."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.ml.feature import BucketedRandomProjectionLSH, Bucketizer
from pyspark.ml.functions import array_to_vector, vector_to_array

from flockscope.operators import graph
from flockscope.operators.neighbours import usable
from flockscope.sources.shared import settle

# Words that are no keywords.
STOP_WORDS = ("the", "and", "of", "to", "in", "is", "that", "it", "for", "on", "with", "as", "was", "at", "by", "an", "be", "this", "from", "or",
              "le", "la", "les", "de", "des", "du", "un", "une", "et", "en", "que", "qui", "dans", "pour", "par", "sur", "au", "avec", "est", "ce")


#: Vectors of a block; two of them and a strip of their product are what a task holds.
BLOCK = 4096
STRIP = 1024
#: Words whose terms a task counts at a time, terms that every task holds.
WORDS = 200_000
FREQUENT = 100_000


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    """A block's unit vectors in one row; vectors without a direction are like none."""
    x = np.stack([np.asarray(v, np.float64) for v in pdf["v"]])
    length = np.linalg.norm(x, axis=1)
    ok = np.isfinite(length) & (length > 0)
    x = x[ok] / length[ok, None]
    return pd.DataFrame({"k": [pdf["k"].iloc[0]], "ids": [pdf["id"].to_numpy()[ok]], "data": [x.tobytes()]})


def _tile(pdf: pd.DataFrame, least: float, best: bool) -> pd.DataFrame:
    """Of one block or two: the pairs (a, b, score), a > b, of at least ``least``; with ``best`` only each a's first."""
    blocks = [(np.asarray(r.ids, np.int64), np.frombuffer(r.data, np.float64).reshape(max(len(r.ids), 1), -1)[: len(r.ids)]) for r in pdf.sort_values("k").itertuples()]
    (ia, x), (ib, y), same = blocks[0], blocks[-1], len(blocks) == 1
    found = []
    for lo in range(0, len(ia), STRIP):
        score = x[lo : lo + STRIP] @ y.T
        r, c = np.nonzero(score >= least - 1e-12)
        one, two, value = ia[lo + r], ib[c], np.round(score[r, c], 12)
        keep = (one > two) if same else one != two
        found.append(pd.DataFrame({"a": np.maximum(one, two)[keep], "b": np.minimum(one, two)[keep], "score": value[keep]}))
        if best:
            found = [pd.concat(found).sort_values(["a", "score", "b"], ascending=[True, False, True]).drop_duplicates("a")]
    out = pd.concat(found) if found else pd.DataFrame({"a": [], "b": [], "score": []})
    return out[out["score"] >= least]


def similar_pairs(vectors: DataFrame, least: float, method: str = "exact", tables: int = 6, bucket: float = 1.0, best: bool = False) -> DataFrame:
    """Pairs (a, b, score) with a > b and cosine >= ``least`` of vectors(id, v) of one length; with ``best`` only those
    among which each a's most similar b is.

    ``exact`` multiplies blocks of vectors, of which there are as many as the vectors ask
    for, each pair of blocks once.  ``lsh`` makes blocks in the order of the buckets that
    random projections put vectors in and multiplies those that have a bucket of any
    projection in common: it can miss pairs, but none that a projection puts together.
    """
    v = vectors.filter("v is not null").select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))
    if method == "lsh":
        v = settle(usable(v, "cosine"))
    n = v.count()
    blocks = max(1, -(-n // BLOCK), min(6, n // 256))
    if method == "lsh" and blocks > 1:
        dealt = _bucket_tiles(v, blocks, tables, bucket)
    else:
        packed = v.withColumn("k", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).groupBy("k").applyInPandas(_pack, "k int, ids array<long>, data binary")
        # each block goes to the tiles that it is a side of
        other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
        dealt = settle(packed).withColumn("o", other).withColumn("tile", F.concat_ws(":", F.least("k", "o"), F.greatest("k", "o"))).select("tile", "k", "ids", "data")
    tiles = min(blocks * (blocks + 1) // 2, 1 << 16)
    return dealt.repartition(tiles, "tile").groupBy("tile").applyInPandas(lambda pdf: _tile(pdf, least, best), "a long, b long, score double")


def _bucket_tiles(v: DataFrame, blocks: int, tables: int, bucket: float) -> DataFrame:
    """Rows of ``_pack`` with the tiles that they are a side of, for pairs of blocks that have a bucket in common."""
    dense = v.select("id", "v", array_to_vector("v").alias("f"))
    model = BucketedRandomProjectionLSH(inputCol="f", outputCol="h", bucketLength=bucket, numHashTables=tables, seed=42).fit(dense)
    hashed = model.transform(dense).select("id", "v", F.transform("h", lambda x: vector_to_array(x)[0].cast("long")).alias("h"))
    # the first projection orders most; a bucket that holds more than a block is cut by a hash of ids
    code = sum((F.col("h")[t] * F.lit(2.0 ** (-6 * t)) for t in range(tables)), F.pmod(F.xxhash64("id"), F.lit(1 << 20)) * F.lit(2.0 ** (-6 * tables - 20)))
    hashed = settle(hashed.withColumn("code", code))
    cuts = sorted(set(hashed.approxQuantile("code", [i / blocks for i in range(1, blocks)], 0.1 / blocks)))  # one for each block
    placed = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="code", outputCol="place").transform(hashed)
    placed = placed.withColumn("k", F.col("place").cast("int"))
    packed = settle(placed.groupBy("k").applyInPandas(_pack, "k int, ids array<long>, data binary"))
    held = settle(placed.select("k", F.posexplode("h").alias("t", "b")).distinct())
    met = held.join(held.withColumnRenamed("k", "o"), ["t", "b"]).filter("k <= o").select("k", "o").distinct()
    sides = met.withColumn("tile", F.concat_ws(":", "k", "o")).select("tile", F.explode(F.array_distinct(F.array("k", "o"))).alias("k"))
    return sides.join(packed, "k").select("tile", "k", "ids", "data")


def near_duplicates(vectors: DataFrame, least: float = 0.95, method: str = "exact") -> DataFrame:
    """Each vector's most similar earlier one, the first of equals."""
    best = F.max(F.struct("score", (-F.col("b")).alias("n")))
    pairs = similar_pairs(vectors, least, method, best=True)
    return pairs.groupBy(F.col("a").alias("id")).agg(best.alias("m")).select("id", (-F.col("m.n")).alias("duplicate_of"), F.col("m.score").alias("score"))


def exact_duplicates(docs: DataFrame, key: str, content: str) -> DataFrame:
    return docs.filter(F.col(content).isNotNull()).groupBy(F.md5(content).alias("digest")).agg(F.count(F.lit(1)).alias("copies"), F.min(key).alias("first_id")).filter("copies > 1")


def density_clusters(vectors: DataFrame, least: float, min_samples: int = 3, min_size: int = 5) -> DataFrame:
    """(id, cluster): connected cores of the graph of similar vectors, named by their least id; -1 for outliers.

    An approximation of hierarchical density clustering at one level of similarity.
    """
    pairs = settle(similar_pairs(vectors, least).select(F.col("b").alias("src"), F.col("a").alias("dst")))
    core = graph.degrees(pairs).filter(F.col("degree") >= min_samples).select("id")
    inner = pairs.join(core.withColumnRenamed("id", "src"), "src", "left_semi").join(core.withColumnRenamed("id", "dst"), "dst", "left_semi")
    comp = graph.connected_components(core, inner)
    large = comp.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_size).select("component")
    kept = comp.join(large, "component")
    return vectors.select("id").join(kept, "id", "left").select("id", F.coalesce("component", F.lit(-1)).alias("cluster"))


def centroids(vectors: DataFrame, cluster: str) -> DataFrame:
    """(cluster, dim, mean): mean vectors, a row a component."""
    return vectors.select(F.col(cluster).alias("cluster"), F.posexplode("v").alias("dim", "x")).groupBy("cluster", "dim").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


def _frequencies(batches: Iterator[pa.RecordBatch], ngrams: int) -> Iterator[pa.RecordBatch]:
    """A row for each document and term with how often it has it, for ``WORDS`` words at a time."""
    for b in batches:
        lists, at = b.column("w"), 0
        offsets = lists.offsets.to_numpy().astype(np.int64)
        while at < b.num_rows:
            upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + WORDS, side="right")) - 1)
            words = lists.values.slice(offsets[at], offsets[upto] - offsets[at]).dictionary_encode()
            code, size = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(words.dictionary)
            doc = np.repeat(np.arange(upto - at), np.diff(offsets[at : upto + 1]))
            span = size + size * size  # a word, or a pair of words
            keys = doc * span + code
            if ngrams == 2:
                beside = doc[1:] == doc[:-1]
                keys = np.concatenate([keys, (doc[1:] * span + size + code[:-1] * size + code[1:])[beside]])
            keys, tf = np.unique(keys, return_counts=True)
            doc, key = np.divmod(keys, max(span, 1))
            pair = key >= size
            one, two = np.divmod(key[pair] - size, max(size, 1))
            take = lambda codes: words.dictionary.take(pa.array(codes))  # noqa: E731, B023
            terms = pa.concat_arrays([take(key[~pair]), pc.binary_join_element_wise(take(one), take(two), " ")])
            order = np.concatenate([np.flatnonzero(~pair), np.flatnonzero(pair)])
            who = pa.array(doc[order] + at)
            yield pa.RecordBatch.from_arrays([b.column("cluster").take(who), b.column("doc").take(who), terms, pa.array(tf[order].astype(np.int64))], ["cluster", "doc", "term", "tf"])
            at = upto


def keywords(docs: DataFrame, cluster: str, text: str, key: str, k: int = 8, min_df: int = 2, ngrams: int = 2, least_chars: int = 5, features: int | None = None) -> DataFrame:
    """(cluster, term, weight, place): the k terms with the largest mean tf-idf of each cluster.

    Words of two letters or more without stop words, and their pairs, that ``min_df`` documents
    have (with ``features`` only so many of the most frequent of the cluster, ties in the order
    of terms); idf is ln((1 + n) / (1 + df)) + 1 within the cluster; documents' rows have length 1.
    All terms count for a document's length: frequent ones meet it where it is read, others in a
    shuffle.  No mean is above df / n, so only terms that can reach the k-th of the most common
    ones have theirs computed.
    """
    d = docs.filter(F.length(text) > least_chars).select(F.col(cluster).alias("cluster"), F.lower(text).alias("_t"), F.monotonically_increasing_id().alias("doc"))
    words = F.filter(F.regexp_extract_all("_t", F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0)), lambda w: ~w.isin(*STOP_WORDS))
    kind = docs.schema[cluster].dataType.simpleString()
    tf = settle(d.select("cluster", "doc", words.alias("w")).mapInArrow(lambda it: _frequencies(it, ngrams), f"cluster {kind}, doc long, term string, tf long"))
    n = d.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    terms = tf.groupBy("cluster", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total")).filter(F.col("df") >= min_df)
    if features is not None:
        place = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("total"), "term"))
        terms = terms.withColumn("_p", place).filter(F.col("_p") <= features)
    idf = (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf")
    known = settle(terms.join(n, "cluster").select("cluster", "term", "n", "df", idf))
    # the least power of two that so many terms reach as every task can hold
    often = known.groupBy(F.floor(F.log2("df")).cast("int").alias("p")).count().orderBy(F.desc("p")).collect()  # 63 rows at most
    held = np.cumsum([r["count"] for r in often]) <= FREQUENT
    least = 2 ** min((r["p"] for r, ok in zip(often, held, strict=True) if ok), default=63)
    frequent = known.filter(F.col("df") >= least).select("cluster", "term", F.col("idf").alias("_idf"))
    met = tf.join(F.broadcast(frequent), ["cluster", "term"], "left")
    rare = met.filter("_idf is null").join(known.filter(F.col("df") < least), ["cluster", "term"]).select("doc", "tf", "idf")
    x = met.filter("_idf is not null").select("doc", "tf", F.col("_idf").alias("idf")).unionByName(rare).withColumn("x", F.col("tf") * F.col("idf"))
    norm = settle(x.groupBy("doc").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm")))

    def means(some: DataFrame) -> DataFrame:
        rows = tf.join(some, ["cluster", "term"]).select("cluster", "doc", "term", "n", (F.col("tf") * F.col("idf")).alias("x")).join(norm, "doc")
        return rows.groupBy("cluster", "term").agg(F.round(F.sum(F.col("x") / F.col("norm")) / F.max("n"), 6).alias("weight"))

    order = F.struct((-F.col("weight")).alias("_w"), F.col("term"), F.col("weight"))
    common = top_places(known, "cluster", F.struct((-F.col("df")).alias("_d"), "term", "n", "idf"), 8 * k).select("cluster", "_v.term", "_v.n", "_v.idf")
    reach = settle(top_places(means(settle(common)), "cluster", order, k).filter(F.col("place") == k).select("cluster", F.col("_v.weight").alias("reach")))
    able = known.join(F.broadcast(reach), "cluster", "left").filter(F.col("df") / F.col("n") + 1e-6 >= F.coalesce("reach", F.lit(0.0)))
    return top_places(means(settle(able.select("cluster", "term", "n", "idf"))), "cluster", order, k).select("cluster", "_v.term", "_v.weight", "place")


def top_places(rows: DataFrame, group: str, value, k: int, salt: int = 64) -> DataFrame:
    """(group, _v, place): the k least ``value`` of each group, first in ``salt`` parts of it, so that no task sorts a whole group."""
    part = rows.select(group, value.alias("_v")).groupBy(group, F.pmod(F.xxhash64("_v"), F.lit(salt)).alias("_s"))
    parts = part.agg(F.slice(F.array_sort(F.collect_list("_v")), 1, k).alias("_v")).select(group, F.explode("_v").alias("_v"))
    best = parts.groupBy(group).agg(F.slice(F.array_sort(F.collect_list("_v")), 1, k).alias("_v"))
    return best.select(group, F.posexplode("_v").alias("_p", "_v")).select(group, "_v", (F.col("_p") + 1).alias("place"))


def narrative_labels(terms: DataFrame, first: int = 3) -> DataFrame:
    """(cluster, label) from keywords(cluster, term, place)."""
    top = terms.filter(F.col("place") <= first).groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("place", "term"))).alias("t"))
    return top.select("cluster", F.concat(F.lit("Narratif #"), F.col("cluster").cast("string"), F.lit(" — "), F.array_join(F.transform("t", lambda x: x["term"]), ", ")).alias("label"))


def match_labels(new: DataFrame, known: DataFrame) -> DataFrame:
    """(cluster, label, narrative_id): labels that there are already keep their narrative, others have none yet."""
    return new.join(known.select("label", "narrative_id"), "label", "left").select("cluster", "label", "narrative_id")


def centroid_vectors(vectors: DataFrame, cluster: str) -> DataFrame:
    """(cluster, centroid): a cluster's mean vector, as single precision."""
    mean = vectors.select(F.col(cluster).alias("cluster"), F.posexplode("v").alias("dim", "x")).groupBy("cluster", "dim").agg(F.avg(F.col("x").cast("double")).alias("mean"))
    parts = mean.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("dim", "mean"))).alias("m"))
    return parts.select("cluster", F.transform("m", lambda x: x["mean"].cast("float")).alias("centroid"))


def hashed_embedding(text, dim: int = 384):
    """array<float>: the signed counts of a text's words by hash, of length 1; zeros for texts of under three characters."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    # a word's cell, shifted by one for its sign; the counting is one pass over these numbers
    codes = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(dim)).cast("int") * 2 + F.pmod(F.xxhash64(w, F.lit(1)), F.lit(2)).cast("int"))
    long = F.length(F.trim(F.coalesce(text, F.lit("")))) >= 3

    @F.pandas_udf("array<float>")
    def counted(series: pd.Series) -> pd.Series:
        def one(code: np.ndarray) -> np.ndarray:
            code = np.asarray(code, np.int64)
            total = np.bincount(code >> 1, weights=1.0 - 2.0 * (code & 1), minlength=dim)
            norm = np.linalg.norm(total)
            return (total / norm if norm else total).astype(np.float32)

        return series.map(one)

    return counted(F.when(long, codes).otherwise(F.array().cast("array<int>")))


def reduced(vectors: DataFrame, dim: int = 50, least: int = 20) -> DataFrame:
    """vectors(id, v) by their ``dim`` principal components (two fewer than there are vectors at most); as they are if fewer than ``least``."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import vector_to_array

    n = vectors.count()
    if n < least:
        return vectors.select("id", F.col("v").cast("array<double>").alias("v"))
    dense = vectors.select("id", array_to_vector(F.col("v").cast("array<double>")).alias("f"))
    size = len(vectors.first()["v"])
    model = PCA(k=max(1, min(dim, n - 2, size)), inputCol="f", outputCol="o").fit(dense)
    return model.transform(dense).select("id", vector_to_array("o").alias("v"))


def near_hashes(rows: DataFrame, distance: int, bits: int = 64, most: int = 256) -> DataFrame:
    """Pairs (a, b, apart), a < b, of rows(id, h) whose perceptual hashes differ in at most ``distance`` bits.

    Equal hashes are collapsed to their least id first, which stands for all of them.  Hashes
    are cut into one band more than bits may differ, so that a pair shares a band.  A band's
    value that more than ``most`` hashes have is no key by itself: of what is left of these
    hashes a pair shares one of as many bands again, and so on until the bits run out, so
    that a common value is spread over many keys."""
    one = settle(rows.filter("h is not null").groupBy("h").agg(F.min("id").alias("id")).select("id", F.col("h").cast("long").alias("h")))
    found, level = None, one.select("id", "h", F.lit(0).alias("key"), F.lit("").alias("path"), F.sequence(F.lit(0), F.lit(bits - 1)).alias("open"))
    bands = distance + 1
    while True:
        # the open bits are cut into bands; a key is what a band holds, below the keys before it
        width = F.ceil(F.size("open") / bands).cast("int")
        cut = level.withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(bands - 1)))).withColumn("from", F.col("band") * width).filter(F.col("from") < F.size("open"))
        taken = F.slice("open", F.col("from") + 1, width)
        value = F.aggregate(taken, F.lit(0).cast("long"), lambda a, b: a * 2 + F.call_function("shiftrightunsigned", F.col("h"), b).bitwiseAND(F.lit(1)))
        cut = cut.select("id", "h", F.xxhash64("key", "band", value).alias("key"), F.concat_ws(".", "path", "band").alias("path"), F.array_except("open", taken).alias("open"))
        cut = settle(cut)
        common = settle(cut.groupBy("key", "path").agg(F.count(F.lit(1)).alias("n"), F.min(F.size("open")).alias("left")).filter((F.col("n") > most) & (F.col("left") > distance)).select("key", "path"))
        plain = cut.join(common, ["key", "path"], "left_anti").select("key", "path", "id", "h")
        x = plain.select("key", "path", F.col("id").alias("a"), F.col("h").alias("x"))
        y = plain.select(F.col("key").alias("_k"), F.col("path").alias("_p"), F.col("id").alias("b"), F.col("h").alias("y"))
        apart = F.bit_count(F.col("x").bitwiseXOR(F.col("y"))).cast("long")
        pairs = x.join(y, (F.col("key") == F.col("_k")) & (F.col("path") == F.col("_p")) & (F.col("a") < F.col("b"))).select("a", "b", apart.alias("apart")).filter(F.col("apart") <= distance)
        found = pairs if found is None else found.unionByName(pairs)
        level = cut.join(common, ["key", "path"])
        if common.isEmpty():
            return found.distinct()


def match_narratives(new: DataFrame, known: DataFrame, least: float = 0.82) -> DataFrame:
    """(cluster, narrative_id, score, status, origin): new(cluster, centroid) against known(narrative_id, centroid), one to one.

    The most similar pair of all is taken first, then the most similar of the rest, while cosines
    reach ``least`` (ties: the smallest narrative, then cluster); rounds take all pairs at once that are
    each other's first.  ``kept`` clusters go on as that narrative; ``split`` ones are near ``origin``, which
    another cluster goes on as; ``new`` ones are near none.  Narratives nobody goes on as have rows of their
    own: ``merged`` into the narrative ``origin`` that the nearest cluster goes on as (null where that one
    is new itself), or ``gone``."""
    n = settle(new.select(F.col("cluster").cast("long").alias("cluster"), F.col("centroid").cast("array<double>").alias("v")))
    k = settle(known.select("narrative_id", F.col("centroid").cast("array<double>").alias("v")))
    # both sides as one list of vectors with an id each: even ones are new
    tag = lambda df, side: df.select(F.col("c"), (F.shiftleft(F.xxhash64("c"), 1).bitwiseAND(F.lit((1 << 62) - 2)) + side).alias("id"), "v")
    left, right = tag(n.withColumnRenamed("cluster", "c"), 0), tag(k.withColumnRenamed("narrative_id", "c"), 1)
    near = similar_pairs(left.select("id", "v").unionByName(right.select("id", "v")), least).filter(F.col("a") % 2 != F.col("b") % 2)
    near = near.select(F.when(F.col("a") % 2 == 0, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(F.col("a") % 2 == 0, F.col("b")).otherwise(F.col("a")).alias("y"), "score")
    names = left.select(F.col("id").alias("x"), F.col("c").alias("cluster")), right.select(F.col("id").alias("y"), F.col("c").alias("narrative_id"))
    near = settle(near.join(names[0], "x").join(names[1], "y").select("cluster", "narrative_id", "score"))
    open_, taken = near, near.limit(0)
    while not open_.isEmpty():
        first = open_.groupBy("cluster").agg(F.min(F.struct((-F.col("score")).alias("s"), "narrative_id", "cluster")).alias("p")).select("p.*")
        back = open_.groupBy("narrative_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "narrative_id", "cluster")).alias("p")).select(F.col("p.cluster").alias("_c"), F.col("p.narrative_id").alias("_n"))
        both = settle(first.join(back, (F.col("cluster") == F.col("_c")) & (F.col("narrative_id") == F.col("_n"))).select("cluster", "narrative_id", (-F.col("s")).alias("score")))
        taken = settle(taken.unionByName(both))
        open_ = settle(open_.join(both.select("cluster"), "cluster", "left_anti").join(both.select("narrative_id"), "narrative_id", "left_anti"))
    best = F.min(F.struct((-F.col("score")).alias("s"), "narrative_id")).alias("p")
    origin = near.join(taken, "cluster", "left_anti").groupBy("cluster").agg(best).select("cluster", F.col("p.narrative_id").alias("origin"), (-F.col("p.s")).alias("score"))
    none = F.lit(None).cast(dict(known.dtypes)["narrative_id"])
    kept = taken.select("cluster", "narrative_id", "score", F.lit("kept").alias("status"), none.alias("origin"))
    split = origin.select("cluster", none.alias("narrative_id"), "score", F.lit("split").alias("status"), "origin")
    fresh = n.select("cluster").join(near.select("cluster").distinct(), "cluster", "left_anti").select("cluster", none.alias("narrative_id"), F.lit(None).cast("double").alias("score"), F.lit("new").alias("status"), none.alias("origin"))
    into = near.join(taken.select("narrative_id"), "narrative_id", "left_anti").groupBy("narrative_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "cluster")).alias("p"))
    into = into.select("narrative_id", F.col("p.cluster").alias("cluster"), (-F.col("p.s")).alias("score")).join(taken.select("cluster", F.col("narrative_id").alias("origin")), "cluster", "left")
    merged = into.select(F.lit(None).cast("long").alias("cluster"), "narrative_id", "score", F.lit("merged").alias("status"), "origin")
    gone = k.select("narrative_id").join(near.select("narrative_id").distinct(), "narrative_id", "left_anti")
    gone = gone.select(F.lit(None).cast("long").alias("cluster"), "narrative_id", F.lit(None).cast("double").alias("score"), F.lit("gone").alias("status"), none.alias("origin"))
    return kept.unionByName(split).unionByName(fresh).unionByName(merged).unionByName(gone)


def topics(rows: DataFrame, terms: DataFrame, cluster: str, k: int = 3) -> DataFrame:
    """Rows with the first ``k`` keywords of their cluster as ``topics``; none for those without a cluster."""
    top = terms.filter(F.col("place") <= k).groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("place", "term"))).alias("t"))
    top = top.select(F.col("cluster").alias(cluster), F.transform("t", lambda x: x["term"]).alias("topics"))
    return rows.join(top, cluster, "left").withColumn("topics", F.coalesce("topics", F.array().cast("array<string>")))
