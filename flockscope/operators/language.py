"""Languages by character n-grams, and sentiments by models that workers load once.

A profile is counted over whole labelled texts: trigrams of the lower-cased letters, each
run of other characters one space.  The ``features`` most frequent trigrams of each
language make the vocabulary, so that the model is bounded by the languages; a text's
language is the one under which its trigrams of the vocabulary are likeliest.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flockscope.functions import scalars as S
from flockscope.sources.shared import settle

#: Answers to a list of texts: a label and a score for each.
Model = Callable[[list[str]], list[tuple[str, float]]]


def letters(text: Column) -> Column:
    """Lower-cased letters, everything between them one space, and a space at both ends."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+", " ")), F.lit(" "))


def grams(text: str) -> Counter[str]:
    return Counter(map("".join, zip(text, text[1:], text[2:], strict=False)))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        total: dict[str, Counter[str]] = {}
        for lang, text in zip(b["lang"].to_pylist(), b["t"].to_pylist(), strict=True):
            total.setdefault(lang, Counter()).update(grams(text))
        rows = [(lang, g, n) for lang, c in total.items() for g, n in c.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64()), strict=True)], ["lang", "gram", "n"]) if rows \
            else pa.RecordBatch.from_pylist([], schema=pa.schema([("lang", pa.string()), ("gram", pa.string()), ("n", pa.int64())]))


def profiles(docs: DataFrame, languages: tuple[str, ...], features: int = 500) -> dict[str, dict[str, float]]:
    """{trigram: {language: log likelihood}} from docs(text, lang): at most ``features`` trigrams a language."""
    known = docs.filter(F.col("lang").isin(*languages)).select("lang", letters(F.col("text")).alias("t"))
    counts = settle(known.mapInArrow(_counted, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    vocabulary = settle(counts.withColumn("_p", place).filter(F.col("_p") <= features).select("gram").distinct())
    rows = counts.join(vocabulary, "gram").collect()  # at most features * languages ** 2
    size, total = len({r.gram for r in rows}), Counter()
    for r in rows:
        total[r.lang] += r.n
    out: dict[str, dict[str, float]] = {r.gram: {} for r in rows}
    for r in rows:
        out[r.gram][r.lang] = r.n
    return {g: {lang: math.log((n.get(lang, 0) + 1) / (total[lang] + size)) for lang in languages} for g, n in out.items()}


def told(text: str, model: dict[str, dict[str, float]], languages: tuple[str, ...], distance: float) -> str | None:
    """The likeliest language of what ``letters`` makes of a text; None if it is not ahead of the next by ``distance``."""
    score = dict.fromkeys(languages, 0.0)
    found = False
    for g, n in grams(text).items():
        if g in model:
            found = True
            for lang, p in model[g].items():
                score[lang] += n * p
    if not found:
        return None
    top = max(score.values())
    share = {lang: math.exp(s - top) for lang, s in score.items()}
    whole = sum(share.values())
    first, *rest = sorted(((s / whole, lang) for lang, s in share.items()), key=lambda x: (-x[0], x[1]))
    return first[1] if first[0] - (rest[0][0] if rest else 0.0) >= distance else None


def detect(docs: DataFrame, text: str, model: dict[str, dict[str, float]], languages: tuple[str, ...], named: tuple[str, ...] = ("fr", "en"), distance: float = 0.1) -> DataFrame:
    """``docs`` with ``language``: one of ``named``, or other for other languages, undecided texts and texts without letters."""
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [told(t, shared.value, languages, distance) for t in b["_letters"].to_pylist()]
            out = pa.array([x if x in named else "other" for x in found], pa.string())
            yield pa.RecordBatch.from_arrays([*[b[n] for n in names], out], [*names, "language"])

    return docs.withColumn("_letters", letters(F.col(text))).mapInArrow(run, docs.schema.add("language", "string"))


@lru_cache(maxsize=8)
def _loaded(load: Callable[[], Model]) -> Model:
    return load()


def sentiments(docs: DataFrame, text: str, lang: str, french: Callable[[], Model], english: Callable[[], Model], batch: int = 32) -> DataFrame:
    """``docs`` with label, score and model: neutral and 0 for texts of under three characters, else what the French model says of
    French texts and the English one of all others; the same where a model fails, or says nothing of a batch.

    ``french`` and ``english`` are functions of a module; each worker calls them once, when it first needs the model."""
    names = docs.columns
    schema = docs.schema.add("label", "string").add("score", "double").add("model", "string")

    def answers(texts: list[str], load: Callable[[], Model]) -> list[tuple[str | None, float]]:
        out: list[tuple[str | None, float]] = []
        for i in range(0, len(texts), batch):
            part = texts[i : i + batch]
            try:
                found = [(str(label), round(float(score), 4)) for label, score in _loaded(load)(part)]
            except Exception:  # the rest of the texts is worth more than a failed batch
                found = []
            out += found if len(found) == len(part) else [(None, 0.0)] * len(part)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, langs = b["_text"].to_pylist(), b["_lang"].to_pylist()
            label, score, model = [None] * len(texts), [0.0] * len(texts), ["skipped"] * len(texts)
            for name, load in (("fr", french), ("en", english)):
                at = [i for i, (t, x) in enumerate(zip(texts, langs, strict=True)) if len(t) >= 3 and (x == "fr") == (name == "fr")]
                for i, (found, value) in zip(at, answers([texts[i] for i in at], load), strict=True):
                    if found is not None:
                        label[i], score[i], model[i] = found, value, name
            yield pa.RecordBatch.from_arrays([*[b[n] for n in names], pa.array(label, pa.string()), pa.array(score, pa.float64()), pa.array(model, pa.string())], schema.names)

    out = docs.withColumn("_text", F.trim(F.coalesce(F.col(text), F.lit("")))).withColumn("_lang", F.col(lang)).mapInArrow(run, schema)
    return out.withColumn("label", S.sentiment_label(F.coalesce("label", F.lit("neutral"))))
