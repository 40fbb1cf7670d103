"""Languages against the formula and held-out labels; models that are loaded once; keywords of bounded vocabularies."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from flockscope import tables as T
from flockscope.operators import language, narratives

LANGUAGES = ("de", "en", "es", "fr")


def test_profiles_against_the_formula(spark):
    texts = [("en", "The cat, the hat!"), ("en", "that"), ("fr", "Le chat ÉTÉ"), ("xx", "zzzzzz"), (None, "the"), ("fr", None)]
    docs = spark.createDataFrame(texts, "lang string, text string")
    model = language.profiles(docs, ("en", "fr"), 4)
    counts = {"en": language.grams(" the cat the hat ") + language.grams(" that "), "fr": language.grams(" le chat été ") + language.grams("  ")}
    top = {g for c in counts.values() for g, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:4]}
    total = {lang: sum(c[g] for g in top) for lang, c in counts.items()}
    assert set(model) == top
    assert all(model[g][lang] == pytest.approx(math.log((c[g] + 1) / (total[lang] + len(top)))) for lang, c in counts.items() for g in top)


def test_languages_of_held_out_documents(spark):
    """Profiles from four fifths of the documents tell the others' languages; short, foreign and blank texts are other."""
    docs = T.load(spark, "/root/testdata/sf0.01", "documents").filter("lang is not null")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = language.profiles(docs.filter(~held), LANGUAGES)
    out = language.detect(docs.filter(held), "text", model, LANGUAGES).select("lang", "language").collect()
    right = sum(r.language == (r.lang if r.lang in ("fr", "en") else "other") for r in out)
    assert len(out) > 100 and right / len(out) >= 0.97, right / len(out)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "1234 !!"), (4, "日本語")], "language_id long, text string")
    assert {r.language for r in language.detect(odd, "text", model, LANGUAGES).collect()} == {"other"}


def test_models_are_loaded_once(spark, tmp_path):
    """Many batches a task, one load; a batch that fails loses no other."""
    loads = str(tmp_path / "loads")
    rows = [(i, "good text" if i % 2 else "bad text", "fr") for i in range(200)] + [(900, "poison", "fr"), (901, " a ", "fr"), (902, None, None), (903, "hello there", "de")]
    docs = spark.createDataFrame(rows, "id long, text string, lang string").repartition(8)

    def french():
        with open(loads, "a") as f:
            f.write("loaded\n")

        def model(texts):
            if any("poison" in t for t in texts):
                raise ValueError("cannot read this")
            return [("5 stars" if "good" in t else "1 star", 0.91239) for t in texts]

        return model

    def english():
        return lambda texts: [("LABEL_1", 0.5) for _ in texts]

    got = {r.id: (r.label, r.score, r.model) for r in language.sentiments(docs, "text", "lang", french, english, batch=1).collect()}
    assert {got[i] for i in range(200)} == {("positive", 0.9124, "fr"), ("negative", 0.9124, "fr")}
    assert got[900] == got[901] == got[902] == ("neutral", 0.0, "skipped") and got[903] == ("neutral", 0.5, "en")
    with open(loads) as f:
        assert 1 <= len(f.readlines()) <= 8


def test_keywords_against_the_formula(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(30)]
    texts = [(i, f"c{i % 2}", " ".join(rng.choices(words, weights=range(1, 31), k=12))) for i in range(40)] + [(90, "c0", None), (91, "c0", "abc"), (92, "c1", "alone once")]
    got = {}
    for r in narratives.keywords(spark.createDataFrame(texts, "id long, c string, t string"), "c", "t", "id", k=5, ngrams=1, features=9).collect():
        got.setdefault(r.cluster, {})[r.term] = r.weight
    for c in ("c0", "c1"):
        docs = [Counter(t.split()) for _, k, t in texts if k == c and t and len(t) > 5]
        df, tf = Counter(w for d in docs for w in d), Counter(w for d in docs for w in d.elements())
        kept = sorted((w for w in df if df[w] >= 2), key=lambda w: (-tf[w], w))[:9]
        idf = {w: math.log((1 + len(docs)) / (1 + df[w])) + 1 for w in kept}
        mean = Counter()
        for d in docs:
            x = {w: n * idf[w] for w, n in d.items() if w in idf}
            norm = math.sqrt(sum(v * v for v in x.values()))
            for w, v in x.items():
                mean[w] += v / norm / len(docs)
        want = sorted(((round(v, 6), w) for w, v in mean.items()), key=lambda x: (-x[0], x[1]))[:5]
        assert got[c] == {w: pytest.approx(v, abs=2e-6) for v, w in want}


@pytest.mark.parametrize(("words", "frequent"), [(200_000, 100_000), (40, 10)])
def test_keywords_count_all_terms(spark, words, frequent, monkeypatch):
    """Terms past the two hundred most frequent count for a document's length; documents are read in parts of any size."""
    monkeypatch.setattr(narratives, "WORDS", words)
    monkeypatch.setattr(narratives, "FREQUENT", frequent)
    rng = np.random.default_rng(7)
    texts = {i: [f"w{x}" for x in rng.integers(0, 400, 30) ** 2 // 400] for i in range(80)}
    tf = {i: Counter([*w, *map(" ".join, zip(w, w[1:]))]) for i, w in texts.items()}
    df = Counter(t for c in tf.values() for t in c)
    assert sum(n >= 2 for n in df.values()) > 250
    mean = Counter()
    for c in tf.values():
        x = {t: n * (np.log(81 / (1 + df[t])) + 1) for t, n in c.items() if df[t] >= 2}
        length = np.sqrt(sum(v * v for v in x.values()))
        for t, v in x.items():
            mean[t] += v / length / 80
    d = spark.createDataFrame([(i, "a", " ".join(w)) for i, w in texts.items()], "id long, c string, t string")
    got = [(r.term, r.weight) for r in narratives.keywords(d, "c", "t", "id").orderBy("place").collect()]
    want = sorted(((t, round(v, 6)) for t, v in mean.items()), key=lambda x: (-x[1], x[0]))[:8]
    assert [t for t, _ in got] == [t for t, _ in want] and [w for _, w in got] == pytest.approx([w for _, w in want], abs=2e-6)
