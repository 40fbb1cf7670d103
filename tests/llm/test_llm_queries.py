"""The registered queries over a whole small table, and the pipeline stage by stage."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from oracle import DATA, connection, same  # noqa: E402

import corpus_pipeline  # noqa: E402
from flockscope.llm import common, ngram_join, queries, toxicity  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_against_sql(spark, name):
    same(queries.QUERIES[name](spark, DATA), connection(), queries.ORACLE[name])


def test_all_are_registered():
    assert {k.split("_")[0] for k in queries.QUERIES} == {f"op{i}" for i in range(1, 14)}


AWKWARD = "doc_id long, text string, lang string, source string, n_chars long, row long, key string, gone int, kept int, node int, times int, _key int, _row int, _n_dropped int, drop int"


def awkward(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), *[1, "k"], *[2] * 8) for i, t, s in rows], AWKWARD)


@pytest.fixture(scope="module")
def rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows and ids, copies under null ids."""
    import random

    rng = random.Random(8)
    text = lambda n: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(n))
    long, base = text(40_000), [text(80) for _ in range(12)]
    near = base[0].split(" ")
    near[40] = "changed"
    out = [(i, t, f"s{i % 3}") for i, t in enumerate(base)] + [(50, long, "s0"), (60, " ".join(near), None), (61, base[0], "s1"), (0, base[0], "s0"), (3, base[3], "s0"), (3, base[4], "s0")]
    return out + [(None, base[5], "s2"), (None, base[5], "s2"), (None, None, None), (None, None, None), (70, "", "s1"), (70, "", "s1"), (71, None, "s1"), (72, " \n ", None), (73, "one", "s1"), (74, "one", "s1")]


def near_groups(rows, k=5, share=0.8):
    """Components of rows by brute force, for rows with words."""
    sets = []
    for i, t, _ in rows:
        w = (t or "").lower().encode().split()
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= share * len(sets[a] | sets[b]):
                group = [group[b] if g == group[a] else g for g in group]
    return [(g, bool(s)) for g, s in zip(group, sets, strict=True)]


def test_stages_on_awkward_rows(spark, rows):
    """Every stage on its own, on rows that nothing should trip over; each keeps the columns of documents."""
    docs = awkward(spark, rows)
    count = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    stages = dict(corpus_pipeline.STAGES)
    every = sorted(((i, t) for i, t, _ in rows), key=str)
    assert count(stages["toxicity"](spark, docs, DATA)) == every  # none is toxic
    lined = count(stages["line_dedup"](spark, docs, DATA))
    # one-line copies lose their line and go; what had no line before stays
    first = {t: min(((i is None, i or 0) for i, u, _ in rows if u == t)) for _, t, _ in rows if t and t.strip()}
    assert {(i, t) for i, t in lined if t and t.strip()} >= {(None if u else i, t) for t, (u, i) in first.items() if "changed" not in t and t != "one"}
    assert sum(not (t and t.strip()) for _, t in lined) == sum(not (t and t.strip()) for _, t, _ in rows)
    kept = count(stages["ngram_join"](spark, docs, DATA))
    groups = near_groups(rows)
    want = []
    for g in {g for g, words in groups if words}:
        want.append(min(((i is None, i or 0), (i, t)) for (i, t, _), (h, _) in zip(rows, groups, strict=True) if h == g)[1])
    want += [(i, t) for (i, t, _), (_, words) in zip(rows, groups, strict=True) if not words]
    assert sorted(i for i, _ in kept if i is not None) == sorted(i for i, _ in want if i is not None) and len(kept) == len(want)
    mixed = stages["mixing"](spark, docs, DATA)
    assert mixed.columns == corpus_pipeline.COLUMNS and {(r.doc_id, r.text) for r in mixed.collect()} <= set(every)
    packed = stages["packing"](spark, docs, DATA).collect()
    assert len([r for r in packed if r.piece == 0]) == len(rows)
    for stage in stages.values():
        assert stage(spark, docs.limit(0), DATA).count() == 0


def test_pipeline(spark):
    docs = common.table(spark, DATA, "documents")
    names = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = common.materialize(stage(spark, docs, DATA), f"test-{name}")
        seen[name] = docs.count()
        if name != "packing":
            assert docs.columns == names
        if name == "toxicity":
            toxic = toxicity.score(before, common.table(spark, DATA, "labels")).filter("predicted = 1").count()
            assert seen[name] == before.count() - toxic > 0
        if name == "ngram_join":
            groups = ngram_join.join_sets(before, k=5, percent=80, sampled=0.24)
            assert seen[name] == groups.select("component_id").distinct().count()
    assert {r[0] for r in docs.groupBy("sequence_id").sum("length").select("sum(length)").collect()} <= set(range(1, 2049))
