"""Quality rules with an isolation forest on rule statistics (operator 6).

One pass over the texts gives each document's rule statistics; texts are never
shuffled.  The base rules fail a document outright.  For the others, isolation
forests over scale-free ratios of the statistics give path lengths over random splits:
rows that few splits isolate are anomalous.  One forest looks at all ratios together and
one at each of them, so that a rare but harmless ratio cannot hide what the others show.
The trees are grown, as the method has it, on random subsamples of ``psi`` rows each,
drawn by hash and bounded by ``trees * psi`` rows in all; every row is scored.  Each
forest's threshold comes from all labelled rows, by a histogram of ``bins`` score bins:
the one that gains most, a good row lost counting as ``price`` bad rows caught, while at
most ``false_share`` of the good rows are lost.  Without labels ``fallback`` is used.

Defined results: null and empty texts have no words and fail the base; repeated rows
and null ids are judged row by row; an empty table gives an empty result; labels other
than 0 and 1 and ids with several labels take no part in the calibration.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, texts

SPACE = texts.members(b" \t\n\r\x0b\x0c")
SYMBOL = texts.members(b"#*$%&|<>")
UPPER = texts.members(bytes(range(65, 91)))
LOUD = texts.members(b"!?")
DIGIT = texts.members(b"0123456789")
STOP = texts.members(b".,;:")
TAIL = texts.members(bytes(range(0x80, 0xC0)))  # bytes that continue a character
WINDOW = 5

STATS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, " \
        "n_lines long, n_upper long, n_loud long, n_digits long, n_stops long"
FEATURES = ["symbols", "dup_lines", "repeats", "upper", "loud", "digits", "stops", "word_length"]


def repeat_words(words: list[bytes]) -> int:
    """How many words stand in a run of WINDOW words that the text holds twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    runs = texts.windows(np.fromiter(map(hash, words), np.int64, len(words)).astype(np.uint64), WINDOW)
    ordered = np.sort(runs)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    edges = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(np.isin(runs, twice))
    np.add.at(edges, at, 1)
    np.add.at(edges, at + WINDOW, -1)
    return int((np.cumsum(edges) > 0).sum())


def line_counts(text: bytes) -> tuple[int, int]:
    """Lines with a word, and how many of them equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines), len(lines) - len(set(lines))


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, whole = batch.column("doc_id"), texts.as_bytes(batch.column("text"))
        for a, b in texts.slices(whole):
            part = [x or b"" for x in whole[a:b]]
            words = [x.split() for x in part]
            space, size = texts.byte_sums(part, SPACE), np.array([len(x) for x in part], np.int64)
            lines = [line_counts(x) for x in part]
            cols = [ids.slice(a, b - a), [len(w) for w in words], size - texts.byte_sums(part, TAIL) - space, texts.byte_sums(part, SYMBOL),
                    [d for _, d in lines], [repeat_words(w) for w in words], [n for n, _ in lines],
                    *(texts.byte_sums(part, t) for t in (UPPER, LOUD, DIGIT, STOP))]
            names = [x.split()[0] for x in STATS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)


def statistics(docs: DataFrame) -> DataFrame:
    """The rule statistics of every row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_statistics, STATS)


def features(pdf: pd.DataFrame) -> np.ndarray:
    """Ratios that do not depend on a text's length or language."""
    chars, words, lines = (np.maximum(pdf[c].to_numpy(float), 1) for c in ("word_chars", "n_words", "n_lines"))
    cols = [pdf.n_symbols / chars, pdf.n_dup_lines / lines, pdf.n_repeat_words / words, pdf.n_upper / chars,
            pdf.n_loud / chars, pdf.n_digits / chars, pdf.n_stops / words, np.log2(chars / words)]
    return np.column_stack([np.asarray(c, float) for c in cols])


class Forest:
    """Isolation trees as flat arrays: split feature and value, children, and the path length at a leaf."""

    def __init__(self, sample: np.ndarray, columns: list[int], trees: int, psi: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.norm = self.expected(min(psi, len(sample)))
        self.trees = []
        order, depth = rng.permutation(len(sample)), int(np.ceil(np.log2(max(psi, 2))))
        for t in range(trees):
            # each tree gets rows of its own, wrapping round if there are few
            rows = sample[np.take(order, np.arange(t * psi, (t + 1) * psi), mode="wrap")] if len(sample) >= psi else sample
            self.trees.append(self._grow(rows, columns, rng, depth))

    @staticmethod
    def expected(n: float) -> float:
        """The mean path length of an unsuccessful search among n rows."""
        return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def _grow(self, rows: np.ndarray, columns: list[int], rng: np.random.Generator, depth_limit: int) -> tuple[np.ndarray, ...]:
        feature, value, left, right, path = [], [], [], [], []

        def add(part: np.ndarray, depth: int) -> int:
            node = len(feature)
            for column in (feature, value, left, right, path):
                column.append(0)
            spread = part[:, columns].max(0) - part[:, columns].min(0)
            free = np.flatnonzero(spread > 0)
            if depth >= depth_limit or len(part) < 2 or not len(free):
                feature[node], path[node] = -1, depth + self.expected(len(part))
                return node
            j = int(rng.choice(free))
            f = columns[j]
            v = float(part[:, f].min() + rng.random() * spread[j])
            feature[node], value[node] = f, v
            left[node] = add(part[part[:, f] <= v], depth + 1)
            right[node] = add(part[part[:, f] > v], depth + 1)
            return node

        add(rows, 0)
        return tuple(np.array(x) for x in (feature, value, left, right, path))

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Anomaly scores in (0, 1]: 2 to the minus mean path length over the expected one."""
        total = np.zeros(len(rows))
        for feature, value, left, right, path in self.trees:
            at = np.zeros(len(rows), np.int64)
            while len(inner := np.flatnonzero(feature[at] >= 0)):
                node = at[inner]
                go = rows[inner, feature[node]] <= value[node]
                at[inner] = np.where(go, left[node], right[node])
            total += path[at]
        return 2.0 ** (-total / max(len(self.trees), 1) / max(self.norm, 1e-9))


def judge(docs: DataFrame, labels: DataFrame, trees: int = 64, psi: int = 128, bins: int = 2048,
          false_share: float = 0.002, price: float = 5.0, fallback: float = 0.8, seed: int = 7) -> DataFrame:
    """The statistics with base_failed, each forest's score (``anomaly``, all ratios first) and kept."""
    stats = common.materialize(statistics(docs), "forest-stats")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    stats = stats.withColumn("base_failed", failed)
    fine = stats.filter("not base_failed")
    # about twice the rows wanted pass the hash, however many tasks there are
    draw = F.xxhash64(*stats.columns, F.lit(seed))
    drawn = fine.filter(common.unit(draw) < 2 * trees * psi / max(fine.count(), 1))
    sample = drawn.orderBy(draw, *stats.columns).limit(trees * psi).toPandas()
    if sample.empty:
        return stats.withColumn("anomaly", F.array().cast("array<double>")).withColumn("kept", ~F.col("base_failed"))
    groups = [list(range(len(FEATURES))), *([k] for k in range(len(FEATURES)))]
    ratios = features(sample)
    # bounded by trees * 2 * psi nodes a forest
    held = docs.sparkSession.sparkContext.broadcast([Forest(ratios, g, trees if len(g) > 1 else trees // 4, psi, seed + i) for i, g in enumerate(groups)])

    def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = features(pdf)
            yield pdf.assign(anomaly=list(np.column_stack([f.score(rows) for f in held.value])) if len(pdf) else [])

    scored = common.materialize(stats.mapInPandas(score, STATS + ", base_failed boolean, anomaly array<double>"), "forest-scores")
    marks = (labels.filter("quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("_id"))
             .agg(F.min("quality").alias("lo"), F.max("quality").alias("hi")).filter("lo = hi and _id is not null"))
    seen = scored.filter("not base_failed").join(marks, F.col("doc_id") == F.col("_id"))
    hist = (seen.select("lo", F.posexplode("anomaly").alias("forest", "anomaly"))
            .groupBy("forest", F.floor(F.col("anomaly") * bins).alias("bin"))
            .agg(F.sum("lo").alias("good"), F.count(F.lit(1)).alias("n")).toPandas())  # at most (bins + 1) rows a forest
    limits = [calibrate(hist[hist.forest == k], bins, false_share, price, fallback) for k in range(len(groups))]
    fine = F.lit(True)
    for k, limit in enumerate(limits):
        fine = fine & (F.get("anomaly", F.lit(k)) < F.lit(limit))
    return scored.withColumn("kept", ~F.col("base_failed") & fine)


def calibrate(hist: pd.DataFrame, bins: int, false_share: float, price: float, fallback: float) -> float:
    """The score from which a forest rejects: of the bins from the top down, the one at which
    bad rows caught less ``price`` times good rows lost is most, losing at most ``false_share``
    of the good rows.  2, which rejects nothing, if nothing is gained."""
    good = float(hist.good.sum()) if len(hist) else 0.0
    if not good or good == hist.n.sum():
        return fallback
    limit, most, caught, lost = 2.0, 0.0, 0.0, 0.0
    for row in hist.sort_values("bin", ascending=False).itertuples():
        lost, caught = lost + row.good, caught + row.n - row.good
        if lost > false_share * good:
            break
        if caught - price * lost > most:
            limit, most = row.bin / bins, caught - price * lost
    return limit


def op6_quality_forest(spark, sf_dir: str) -> DataFrame:
    out = judge(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
