"""Toxicity by weak supervision (operator 3).

1. A lexicon is found in training rows: words, and stems of 3, 4 and 5 letters, that
   stand in many more toxic than clean documents.  Near copies in that sample count
   once, so that one copied document does not put its own words into the lexicon.
2. ``VOTERS`` lexicon and pattern voters look at every document, in one pass over the
   whole texts.  What they vote is one of at most 2**18 patterns.
3. A generative label model (two latent classes) learns from the patterns of all
   documents, by expectation maximisation, how often each voter fires in each class, and
   from the residual covariances how far voters repeat each other; a voter's evidence is
   divided by how many voters it stands for.  Its start comes from the training rows.
4. A linear (logistic) classifier is fitted to the posterior labels of the sample's
   documents and scores all documents.

Labels are learned only from rows whose crc32(doc_id as text) mod 5 is not 0, on a
sample bounded by ``fit_rows`` rows, half of each label, drawn by hash.  Labels, lang,
source and doc_id are never inputs of a score.

Defined results: null and empty texts get the score of a document in which no voter
fires; a null id is never held out and has no label; repeated rows are scored alike; ids
with several labels are not learned from; without usable labels of both kinds every score
is 0; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WORD = re.compile(r"[^\W\d_]+")
STEMS = (3, 4, 5)
ODDS, SUPPORT = 20.0, 0.01
#: Patterns that look at the text itself, whatever the lexicon: shouting, and words with letters masked.
PATTERNS = (re.compile(r"[!?]{2}|\b[^\W\d_a-zà-ÿ]{4,}\s+[^\W\d_a-zà-ÿ]{4,}\b"), re.compile(r"[^\W\d_][*#@$]{2,}[^\W\d_]?"))
VOTERS = 16 + len(PATTERNS)
FOLDS, HELD_OUT = 5, 0


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def features_of(words: list[str]) -> set[str]:
    distinct = set(words)
    out = {"w:" + w for w in distinct}
    for k in STEMS:
        out |= {f"{k}:{w[:k]}" for w in distinct if len(w) > k}
    return out


def sketch(words: list[str]) -> int:
    """The least hash of five-word runs: near copies mostly share it."""
    import xxhash

    runs = [" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))]
    return min(xxhash.xxh3_64_intdigest(r) for r in runs) >> 1


class Lexicon:
    """The features with their log odds, and what of them a document holds."""

    def __init__(self, weights: dict[str, float]) -> None:
        self.names = sorted(weights)
        self.index = {f: i for i, f in enumerate(self.names)}
        self.weights = np.array([weights[f] for f in self.names])
        # the first letters that any feature can begin with, to skip most words at once
        self.gate = {f[2:5] for f in self.names}
        self.group = {}
        for kind in ("w", *map(str, STEMS)):
            own = sorted((f for f in self.names if f[0] == kind), key=lambda f: (-weights[f], f))
            self.group |= {f: (("w", *map(str, STEMS)).index(kind) * 3 + i % 3) for i, f in enumerate(own)}

    def hits(self, words: list[str]) -> dict[int, int]:
        """How often each feature of the lexicon occurs."""
        gate, index = self.gate, self.index
        out: dict[int, int] = Counter()
        for w in [w for w in words if w[:3] in gate]:
            if (i := index.get("w:" + w)) is not None:
                out[i] += 1
            for k in STEMS:
                if len(w) > k and (i := index.get(f"{k}:{w[:k]}")) is not None:
                    out[i] += 1
        return out

    def votes(self, text: str | None, words: list[str], hits: dict[int, int]) -> int:
        """The voters that fire, as bits: 12 of the lexicon, by kind and third; 4 of how often it is met; the patterns."""
        bits = 0
        for i in hits:
            bits |= 1 << self.group[self.names[i]]
        n = sum(hits.values())
        share = n / max(len(words), 1)
        for j, fires in enumerate((n >= 2, share > 0.002, share > 0.01, len(hits) >= 4)):
            bits |= fires << (12 + j)
        for j, pattern in enumerate(PATTERNS):
            bits |= (pattern.search(text or "") is not None) << (16 + j)
        return bits

    def row(self, words: list[str], hits: dict[int, int]) -> tuple[list[int], list[float]]:
        """A document's sparse inputs of the classifier: log counts, and at the end the log density."""
        n = sum(hits.values())
        idx = sorted(hits)
        return [*idx, len(self.names)], [*(float(np.log1p(hits[i])) for i in idx), float(np.log1p(1000 * n / max(len(words), 1)))]


def find_lexicon(counts: pd.DataFrame, n_toxic: int, n_clean: int, size: int, odds: float = ODDS, support: float = SUPPORT) -> Lexicon:
    """Of the features that at least a share ``support`` of the toxic rows have, and that are
    ``odds`` times as frequent there, the ``size`` with the largest likelihood ratio."""
    a, c = counts.toxic.to_numpy(float), counts.clean.to_numpy(float)
    ratio = np.log((a + 0.5) / (n_toxic + 1) / ((c + 0.5) / (n_clean + 1)))
    pooled = (a + c) / (n_toxic + n_clean)
    gain = a * np.log(np.maximum(a, 0.5) / n_toxic / pooled) + c * np.log(np.maximum(c, 0.5) / n_clean / pooled)
    fit = (ratio >= np.log(odds)) & (a >= max(3.0, support * n_toxic))
    best = [i for i in np.lexsort((counts.feature.to_numpy(), -gain)) if fit[i]][:size]
    return Lexicon({counts.feature.iloc[i]: float(ratio[i]) for i in best})


class LabelModel:
    """Two latent classes; per class each voter's firing rate; voters weighed down by their correlations.

    The second class is toxic and taken to be the rarer one: its share is held between 0.001 and one half."""

    def __init__(self, patterns: np.ndarray, weight: np.ndarray, start: np.ndarray, prior: float, rounds: int = 30) -> None:
        self.prior = prior
        v = ((patterns[:, None] >> np.arange(VOTERS)) & 1).astype(float)
        weight = weight / weight.sum()
        self.rates = np.clip(start, 1e-3, 1 - 1e-3)
        self.share = np.ones(VOTERS)
        for _ in range(rounds):
            p = self.posterior(patterns)
            mass = np.array([(weight * (1 - p)).sum(), (weight * p).sum()])
            rates = np.stack([(v * (weight * (1 - p))[:, None]).sum(0), (v * (weight * p)[:, None]).sum(0)]) / np.maximum(mass, 1e-12)[:, None]
            self.rates = np.clip(rates, 1e-4, 1 - 1e-4)
            self.prior = float(np.clip(mass[1], 1e-3, 0.5))
            # correlations that the classes leave unexplained
            rest = v[None] - self.rates[:, None, :]
            cov = sum(np.einsum("ni,nj,n->ij", r, r, weight * q) for r, q in zip(rest, (1 - p, p), strict=True))
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            self.correlation = np.clip(cov / sd[:, None] / sd[None, :], -1, 1)
            self.share = 1 / np.maximum(1.0, np.maximum(self.correlation, 0).sum(1))
        self.accuracy = self.prior * self.rates[1] + (1 - self.prior) * (1 - self.rates[0])

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        v = ((patterns[:, None] >> np.arange(VOTERS)) & 1).astype(float)
        fired, silent = np.log(self.rates[1] / self.rates[0]), np.log((1 - self.rates[1]) / (1 - self.rates[0]))
        z = np.log(self.prior / (1 - self.prior)) + (self.share * (v * fired + (1 - v) * silent)).sum(1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_logistic(rows: list[tuple[list[int], list[float]]], target: np.ndarray, width: int, l2: float = 1e-3, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Full-batch gradient descent with momentum and per-weight scaling (Adam) on soft labels."""
    at = np.concatenate([np.full(len(i), n) for n, (i, _) in enumerate(rows)])
    col = np.concatenate([np.array(i) for i, _ in rows])
    val = np.concatenate([np.array(v) for _, v in rows])
    w, m, s = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, rounds + 1):
        z = np.bincount(at, val * w[col], len(rows)) + w[-1]
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / len(rows)
        g = np.append(np.bincount(col, val * err[at], width), err.sum()) + l2 / width * np.append(w[:-1], 0)
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        w = w - 0.1 * m / (1 - 0.9**t) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
    return w[:-1], float(w[-1])


def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per feature, in how many of the partition's toxic and clean documents it stands."""
    counts: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            for f in features_of(words_of(text)):
                counts[f][1 - toxic] += 1
        if len(counts) > 500_000:
            yield _counted(counts)
            counts.clear()
    yield _counted(counts)


def _counted(counts: dict[str, list[int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([v[0] for v in counts.values()], pa.int64()),
                                       pa.array([v[1] for v in counts.values()], pa.int64())], ["feature", "toxic", "clean"])


def training_sample(docs: DataFrame, labels: DataFrame, fit_rows: int, seed: int) -> DataFrame:
    """At most ``fit_rows`` labelled training documents (text, toxic), half of each label, near copies once."""
    usable = (labels.filter("toxic in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
              .agg(F.min("toxic").cast("int").alias("toxic"), F.max("toxic").cast("int").alias("other")).filter("toxic = other")
              .filter(~held_out(F.col("doc_id"))).select("doc_id", "toxic"))
    usable = common.materialize(usable, "toxic-usable")
    draw = F.xxhash64("doc_id", F.lit(seed))
    n = {r.toxic: r["count"] for r in usable.groupBy("toxic").count().collect()}
    # about fit_rows of each label pass the hash, however many tasks there are, and half of them are taken
    ids = common.union_all(usable.filter((F.col("toxic") == y) & (common.unit(draw) < fit_rows / max(n.get(y, 0), 1))).orderBy(draw, "doc_id").limit(fit_rows // 2)
                           for y in (0, 1))
    # at most fit_rows rows of two numbers
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    picked = text.join(F.broadcast(ids), "doc_id").select("text", "toxic")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [sketch(words_of(t)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("text"), b.column("toxic"), pa.array(keys, pa.int64())], ["text", "toxic", "sketch"])

    # of rows with one sketch the one with the least hash stays, so that reruns learn the same
    first = F.min(F.struct(F.xxhash64("text").alias("h"), "toxic", "text")).alias("m")
    return picked.mapInArrow(mark, "text string, toxic int, sketch long").groupBy("sketch").agg(first).select("m.text", "m.toxic")


def score(docs: DataFrame, labels: DataFrame, fit_rows: int = 8000, lexicon_size: int = 256, seed: int = 11) -> DataFrame:
    """Per row: doc_id, key, held_out, score, predicted, and the label model's posterior."""
    spark = docs.sparkSession
    sample = common.materialize(training_sample(docs, labels, fit_rows, seed), "toxic-sample")
    n = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    head = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.row_key().alias("key"), F.col("text").cast("string").alias("text"))
    if len(n) < 2:
        return head.select("doc_id", "key", held_out(F.col("doc_id")).alias("held_out"), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"),
                           F.lit(0.0).alias("posterior"))
    counted = (sample.mapInArrow(_featurize, "feature string, toxic long, clean long").groupBy("feature")
               .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))
    # features of a share SUPPORT of the toxic rows: at most what a document holds, over that share
    counts = counted.filter((F.col("toxic") >= max(3.0, SUPPORT * n[1])) & ((F.col("toxic") + 0.5) / (n[1] + 1) >= 0.99 * ODDS * (F.col("clean") + 0.5) / (n[0] + 1))).toPandas()
    lexicon = find_lexicon(counts, n[1], n[0], lexicon_size)
    shared = spark.sparkContext.broadcast(lexicon)  # at most lexicon_size features

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            bits, cols, vals = [], [], []
            for text in b.column("text").to_pylist():
                ws = words_of(text)
                hits = own.hits(ws)
                bits.append(own.votes(text, ws, hits))
                i, v = own.row(ws, hits)
                cols.append(i)
                vals.append(v)
            rest = [b.column(k) for k in b.schema.names if k != "text"]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(bits, pa.int64()), pa.array(cols, pa.list_(pa.int64())), pa.array(vals, pa.list_(pa.float64()))],
                                             [*(k for k in b.schema.names if k != "text"), "bits", "cols", "vals"])

    votes = common.materialize(head.mapInArrow(look, "doc_id long, key long, bits long, cols array<bigint>, vals array<double>"), "toxic-votes")
    patterns = votes.groupBy("bits").count().toPandas()  # at most 2**VOTERS rows
    seen = sample.select("toxic", "text").mapInArrow(look, "toxic int, bits long, cols array<bigint>, vals array<double>").toPandas()  # at most fit_rows rows
    fired = ((seen.bits.to_numpy()[:, None] >> np.arange(VOTERS)) & 1).astype(float)
    y = seen.toxic.to_numpy()
    start = np.stack([(fired[y == k].sum(0) + 0.5) / ((y == k).sum() + 1) for k in (0, 1)])
    model = LabelModel(patterns.bits.to_numpy(), patterns["count"].to_numpy(float), start, prior=0.1)
    weights, bias = fit_logistic(list(zip(seen.cols, seen.vals, strict=True)), model.posterior(seen.bits.to_numpy()), len(lexicon.names) + 1)
    held = spark.sparkContext.broadcast((weights, bias, model))

    def judge(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, b, m = held.value
        for pdf in parts:
            at = np.repeat(np.arange(len(pdf)), [len(c) for c in pdf.cols])
            col = np.concatenate([*pdf.cols, np.zeros(0)]).astype(np.int64)
            z = np.bincount(at, np.concatenate([*pdf.vals, np.zeros(0)]) * w[col], len(pdf)) + b
            yield pd.DataFrame({"doc_id": pdf.doc_id.astype("Int64"), "key": pdf.key, "score": 1 / (1 + np.exp(-np.clip(z, -30, 30))),
                                "posterior": m.posterior(pdf.bits.to_numpy(np.int64))})

    scored = votes.mapInPandas(judge, "doc_id long, key long, score double, posterior double")
    return scored.select("doc_id", "key", held_out(F.col("doc_id")).alias("held_out"), "score",
                         F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "posterior")


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    return score(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")).drop("key")
