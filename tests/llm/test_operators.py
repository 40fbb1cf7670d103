"""The training-data operators against brute force, on small tables with awkward rows."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from flockscope.llm import (common, embedding_dedup, induced, license_scan, line_dedup, mixing, ngram_join, packing, quality_forest, secret_scan,
                            substring_dedup, toxicity)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, key string, rank int, target string"
SPACE = " \t\n\r\x0b\x0c"


def docs_of(spark, texts, sources=None):
    """Documents with columns that clash with names the operators use."""
    rows = [(i, t, "en", (sources or {}).get(i, f"s{(i or 0) % 3}"), 0, 7, "k", 9, "x") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    """Nulls, empty and blank texts, a very long one, exact and near copies, repeated rows and ids, unicode."""
    rng = random.Random(3)
    base = [words(rng, n) for n in (3, 40, 120, 400, 60, 90)]
    out = [(i, t) for i, t in enumerate(base)]
    out += [(10, None), (11, ""), (12, " \n\t"), (13, "one"), (14, "one"), (15, "a b c"), (16, words(rng, 30000))]
    near = base[3].split(" ")
    for i in range(6):
        copy = list(near)
        for _ in range(i * 4):
            copy[rng.randrange(len(copy))] = "zz"
        out.append((20 + i, " ".join(copy)))
    out += [(30, base[2]), (31, base[2].upper()), (30, base[2]), (None, base[2]), (None, None), (32, "é ñ " * 60 + base[4]), (33, base[4] + " tail " + base[5])]
    out += [(40 + i, "common line of words that many documents share here\n" + words(rng, 25) + f"\nPage {i} of 90 in this long report") for i in range(5)]
    return out


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


# 1 mixing

def test_mixing_targets_and_limits(spark, texts):
    rng = random.Random(5)
    many = [(i, words(rng, rng.randint(0, 300))) for i in range(400)]
    out = mixing.mix(docs_of(spark, many, {i: f"s{i % 7}" if i % 11 else None for i in range(400)})).toPandas()
    assert len(out) == 400 and (out.taken <= 2 * out["size"]).all()
    total = out["size"].sum()
    by = out.groupby("source", dropna=False).agg(size=("size", "sum"), taken=("taken", "sum"), target=("target", "first"))
    assert by.target.sum() == pytest.approx(1.5 * total) and (by.target <= 2 * by["size"] + 1e-6).all()
    assert (abs(by.taken - by.target) <= 6 * 32).all()


def test_mixing_awkward_rows(spark, texts):
    d = docs_of(spark, texts)
    a, b = (rows_of(mixing.mix(d), "doc_id", "size", "source_size", "target", "taken") for _ in range(2))
    assert a == b and len(a) == len(texts)
    sizes = Counter((i, len(t.encode().split()) if t else 0) for i, t in texts)
    assert Counter((r[0], r[1]) for r in a) == sizes
    assert mixing.mix(d.limit(0)).count() == 0
    assert rows_of(mixing.mix(docs_of(spark, [(1, None), (2, "")])), "doc_id", "target", "taken") == [(1, 0.0, 0), (2, 0.0, 0)]


# 2 line dedup

def test_line_dedup(spark, texts):
    d = docs_of(spark, texts)
    out = line_dedup.dedup(d)
    assert out.columns == [*d.columns, "_n_lines", "_n_dropped"] and out.count() == len(texts)
    got = {r.doc_id: r.text for r in out.filter("doc_id >= 40").collect()}
    assert "common line" in got[40] and "Page 0" in got[40]
    for i in range(41, 45):
        own = dict(texts)[i].split("\n")[1]
        assert got[i] == own  # the shared line and the template with a number go
    kept = {r.doc_id: r.text for r in out.filter("doc_id < 20").collect()}
    assert all(kept[i] == t for i, t in texts if i is not None and i < 20)
    assert line_dedup.dedup(d.limit(0)).count() == 0


def test_line_dedup_generalises_fields(spark):
    rows = [(i, f"user {name} logged in from host {host} today") for i, (name, host) in enumerate([("ann", "x"), ("bob", "y"), ("cid", "z"), ("dee", "w")])]
    rows += [(9, "user ann wrote something quite different over here now")]
    got = {r.doc_id: r.text for r in line_dedup.dedup(docs_of(spark, rows), depth=1).collect()}
    assert got[0] == rows[0][1] and got[1] == got[2] == got[3] == "" and got[9] == rows[4][1]


def test_line_dedup_of_two_documents(spark):
    rng = random.Random(12)
    passage = words(rng, 60)
    near = passage.split(" ")
    near[40] = "changed"
    rows = [(1, f"own words of the first text\n{passage}\nsent by ann to all of the staff"), (2, f"{passage}\nother words of the second text"),
            (3, "other things in a third text\nsent by ann to most of the crew"), (4, " ".join(near)),
            (5, "we all like tea best"), (6, "we all like old songs"), (7, "row 1 of the long list\nrow 2 of the long list"), (7, "row 1 of the long list\nrow 2 of the long list")]
    got = {r.doc_id: r.text for r in line_dedup.dedup(docs_of(spark, rows)).collect()}
    assert got == dict(rows) | {2: "other words of the second text", 3: "other things in a third text", 4: ""}  # what agrees only in first tokens, or in one document, stays
    fields = [(i, f"user {n} logged in from host {h} today") for i, (n, h) in enumerate(zip("abc", "xyz", strict=True))] + [(8, "user only seen once in all of it")]
    assert {r.doc_id: r.text for r in line_dedup.dedup(docs_of(spark, fields), depth=1, recurs=3).collect()} == dict(fields) | {1: "", 2: ""}


def test_line_dedup_of_short_lines(spark):
    rng = random.Random(13)
    rows = []
    for i in range(36):
        lines = [words(rng, 12), "All rights reserved.", f"Page {i}", "", *["thanks"] * (i < 31), *["Menu"] * (i < 32), *["see you soon"] * (i < 7), *[" read it in  full"] * (i < 4)]
        rows.append((i, "\n".join(lines)))
    got = {r.doc_id: r.text for r in line_dedup.dedup(docs_of(spark, rows)).collect()}
    gone = ("All rights reserved.", "Menu", " read it in  full")
    assert got == {i: "\n".join(x for x in t.split("\n") if i == 0 or x not in gone) for i, t in rows}


def brute_lines(rows, min_docs=3, depth=3, constant=0.6, least=5, recurs=2):
    """doc_id -> numbers of the lines that go, straight from the definition."""
    from itertools import groupby

    lines = []  # (leaf, tokens, document, line number, documents that it needs)
    for d, text in rows:
        for i, line in enumerate((text or "").split("\n")):
            words_ = line.encode().split()
            if not words_:
                continue
            if len(words_) < least:
                lines.append((("short", *words_), words_, d, i, recurs << (least - len(words_))))
            else:
                words_ = [b"<*>" if any(48 <= c <= 57 for c in w) else w for w in words_]
                lines.append(((len(words_), *words_[:depth]), words_, d, i, recurs))
    gone = {d: set() for d, _ in rows}
    templates = {}
    for leaf, group in groupby(sorted(lines, key=lambda x: str(x[0])), key=lambda x: x[0]):
        group = list(group)
        if len({x[2] for x in group}) < group[0][4]:
            continue
        docs_with = {}
        for _, w, d, _, _ in group:
            for at in enumerate(w):
                docs_with.setdefault(at, set()).add(d)
        alone = len({tuple(w) for _, w, *_ in group}) == 1
        for _, w, d, i, _ in group:
            fixed = tuple(x for x in enumerate(w) if len(docs_with[x]) >= min_docs)
            close = tuple(x for x in enumerate(w) if len(docs_with[x]) >= min(recurs, min_docs))
            behind = sum(at >= depth for at, _ in close)
            held = tuple(enumerate(w)) if alone else fixed if len(fixed) >= len(w) * constant else close if behind >= (len(w) - depth) * constant else None
            if held is not None:
                templates.setdefault((leaf, held), []).append((d, i))
    for found in templates.values():
        if len({d for d, _ in found}) >= recurs:
            for d, i in sorted(found)[1:]:
                gone[d].add(i)
    return gone


@pytest.mark.parametrize("seed", range(3))
def test_line_dedup_against_brute_force(spark, seed):
    """Also with documents that have several lines in a leaf: each counts once for a field."""
    rng = random.Random(seed)
    heads = [words(rng, 3) for _ in range(4)]
    pool = ["all rights", "end", "a b c d"] + [f"{rng.choice(heads)} {words(rng, rng.randint(2, 4))}" for _ in range(25)]
    rows = []
    for i in range(60):
        own = [f"{rng.choice(heads)} {rng.choice(['x', 'y', 'z'])} {rng.choice(['u', 'v'])} {rng.choice(['p', 'q', words(rng, 1)])} {rng.randint(0, 3)}" for _ in range(rng.randint(0, 6))]
        lines = rng.sample(pool, 5) + own + ["", "  "]
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines)))
    want = brute_lines(rows)
    out = line_dedup.dedup(docs_of(spark, rows)).collect()
    for r in out:
        text = dict(rows)[r.doc_id].split("\n")
        assert r.text == "\n".join(x for i, x in enumerate(text) if i not in want[r.doc_id]), r.doc_id
    assert sum(map(len, want.values())) > 50


def test_line_dedup_keeps_clashing_columns(spark):
    names = ["doc_id", "text", "_key", "_drop", "_row_key", "_n_lines", "_n_dropped", "row", "drop", "key", "gone_key", "a b", "lines"]
    rows = [(i, "one line that recurs in all of them\nown " + "abcdefgh"[i], *range(len(names) - 2)) for i in range(4)]
    out = line_dedup.dedup(spark.createDataFrame(rows, names))
    assert out.columns == [*names, "__n_lines", "__n_dropped"]
    got = {r["doc_id"]: r for r in out.collect()}
    assert [got[i]["__n_dropped"] for i in range(4)] == [0, 1, 1, 1] and got[3]["a b"] == 9 and got[2]["_n_lines"] == 3


# 3 toxicity

def test_toxicity(spark):
    rng = random.Random(9)
    bad = ["vileword", "nastyone", "awfulterm"]
    rows, labels = [], []
    for i in range(600):
        t = words(rng, 60).split(" ")
        toxic = i % 4 == 0
        if toxic:
            for _ in range(4):
                t[rng.randrange(len(t))] = rng.choice(bad)
        rows.append((i, " ".join(t)))
        labels.append((i, 1, int(toxic)))
    rows += [(None, "vileword " * 20), (900, None), (901, ""), (0, rows[0][1]), (902, "x " * 200000)]
    d, lab = docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = toxicity.score(d, lab).toPandas()
    assert len(out) == len(rows) and out.score.between(0, 1).all()
    held = out[out.held_out & (out.doc_id < 600)]
    assert set(held.doc_id) == {i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert (held.predicted == (held.doc_id % 4 == 0).astype(int)).mean() >= 0.98
    assert not out[out.doc_id.isin([900, 901, 902])].predicted.any()
    assert toxicity.score(d.limit(0), lab).count() == 0
    assert set(rows_of(toxicity.score(d, lab.limit(0)), "score")) == {(0.0,)}


# 4 n-gram join

def brute_join(rows, k, percent):
    sets = {}
    for i, t in rows:
        if i is None:
            continue
        w = t.encode().lower().split() if t else []
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                parent[max(find(x), find(y))] = min(find(x), find(y))
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("frequent", "percent"), [(64, 85), (1, 85), (1, 40)])
def test_ngram_join(spark, texts, frequent, percent):
    """With frequent=1 keys grow to four tokens."""
    rng = random.Random(4)
    base = words(rng, 300).split(" ")
    rows = texts + [(200 + i, " ".join(rng.choices(["u", "v", "w", "x"], k=rng.randint(4, 7)))) for i in range(30)]
    for i in range(40):  # copies of one text about the threshold, most too far from each other
        copy = list(base)
        for _ in range(rng.randint(3, 14)):
            copy[rng.randrange(300)] = f"w{rng.randrange(50)}"
        rows.append((100 + i, " ".join(copy)))
    want = brute_join(rows, 4, percent)
    out = ngram_join.join_sets(docs_of(spark, rows), frequent=frequent, percent=percent, sampled=0.18 if percent == 85 else 0.7)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in out.collect() if r.doc_id is not None}
    assert got == want and out.count() == len(rows)


def test_ngram_join_empty(spark, texts):
    d = docs_of(spark, texts)
    assert ngram_join.join_sets(d.limit(0)).count() == 0
    assert rows_of(ngram_join.join_sets(docs_of(spark, [(1, None), (2, ""), (None, "a b c d")])), "doc_id", "component_id") == [(1, 1), (2, 2), (None, None)]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "src long, dst long")
    got = {r.id: r.component_id for r in common.components(edges, "t").collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}


# 5 embeddings

def test_embedding_dedup(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((60, 16)).astype(np.float32)
    x[40:] = x[:20] + 0.08 * rng.standard_normal((20, 16))
    x[30] = x[5] * 2  # the same direction
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(100, None, 0), (101, [0.0] * 16, 0), (102, [float("nan")] * 16, 0), (103, [1.0, None] * 8, 0), (104, x[5].tolist(), 0), (105, [1.0, 2.0], 0), (None, x[5].tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in embedding_dedup.dedup(df, block=16).collect()}
    assert len(got) == len(rows)
    good = {i: np.array(v, float) for i, v, _ in rows if i is not None and (i < 60 or i == 104)} | {-1: x[5].astype(float)}
    near = {i: {j for j, w in good.items() if j != i and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.95} for i, v in good.items()}
    for i in good:
        if i >= 0:
            assert got[i].n_links == len(near[i]), i
    for i in (100, 101, 102, 103, 105):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert got[104].component_id == got[30].component_id == 5 and not got[104].kept
    assert embedding_dedup.dedup(df.limit(0)).count() == 0


@pytest.mark.parametrize("dim", [32, 1500])
def test_quantisation_bounds_hold(dim):
    """What the codes call sure is, what they leave out is not, and they leave little open."""
    rng = np.random.default_rng(1)
    x = rng.standard_normal((200, dim)) + rng.standard_normal(dim)
    x /= np.linalg.norm(x, axis=1)[:, None]
    cos = x[:100] @ x[100:].T
    a, b = (embedding_dedup.Codes.unpacked(*embedding_dedup.Codes.of(y).packed()) for y in (x[:100], x[100:]))
    for t in (*np.quantile(cos, [0.1, 0.5, 0.99]), 0.0, cos.max()):
        r, c, unsure = map(np.concatenate, zip(*embedding_dedup.links(a, b, t, False), strict=True))
        found = set(zip(r.tolist(), c.tolist(), strict=True))
        exact = set(zip(*(i.tolist() for i in np.nonzero(cos >= t)), strict=True))
        assert len(found) == len(r) and exact <= found and found - exact <= set(zip(r[unsure].tolist(), c[unsure].tolist(), strict=True))
        assert unsure.sum() < 100


def test_embedding_open_pairs_are_computed_again(spark, monkeypatch):
    """With bounds widened far beyond need all pairs near the threshold go through the vectors themselves."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((80, 8))
    x[40:] = x[:40] + rng.uniform(0, 0.5, (40, 1)) * rng.standard_normal((40, 8))
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    want = [(i, int(((x @ v) / np.linalg.norm(x, axis=1) / np.linalg.norm(v) >= 0.95).sum()) - 1) for i, v in enumerate(x)]
    assert rows_of(embedding_dedup.dedup(d), "vec_id", "n_links") == sorted(want, key=str)
    real = embedding_dedup._tile

    def all_open(pdf, threshold):
        import flockscope.llm.embedding_dedup as module

        module.SLACK = 0.3
        return real(pdf, threshold)

    monkeypatch.setattr(embedding_dedup, "_tile", all_open)
    assert rows_of(embedding_dedup.dedup(d), "vec_id", "n_links") == sorted(want, key=str)


def test_near_blocks_keep_every_link():
    """Block pairs left out by centres and radii hold no pair at the threshold."""
    import math

    import pandas as pd

    rng = np.random.default_rng(4)
    blocks = []
    for _ in range(40):
        x = rng.standard_normal(6) + rng.uniform(0.02, 0.6) * rng.standard_normal((12, 6))
        blocks.append(x / np.linalg.norm(x, axis=1)[:, None])
    mid = [x.mean(0) / np.linalg.norm(x.mean(0)) for x in blocks]
    radii = [math.acos(min(1.0, float((x @ m).min()))) for x, m in zip(blocks, mid, strict=True)]
    near = pd.concat(embedding_dedup._near_blocks(pd.DataFrame({"group": [0], "blocks": [list(range(40))], "radii": [radii], "centres": [mid]}), 0.95))
    kept = set(zip(near.x.tolist(), near.y.tolist(), strict=True))
    linked = {(i, j) for i in range(40) for j in range(i, 40) if (blocks[i] @ blocks[j].T).max() >= 0.95}
    assert linked <= kept and len(kept) < 700


# 6 quality

def brute_quality(text):
    w = text.encode().split() if text else []
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines, dup, before = (text or "").split("\n"), 0, set()
    for line in lines:
        if line.strip(SPACE):
            dup += line in before
            before.add(line)
    return len(w), sum(len(x.decode()) for x in w), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(covered)


def test_quality(spark, texts):
    rows = [*texts, (60, "a b c d e f a b c d e x y z # *"), (61, "x\nx\n \nx y"), (62, "spam " * 50), (63, "a%% " * 40 + words(random.Random(1), 300))]
    d = docs_of(spark, rows)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20, 26)] + [(63, 0, 0)], "doc_id long, quality int, toxic int")
    out = quality_forest.judge(d, labels)
    got = sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out.collect() if r.doc_id is not None)
    want = []
    for i, t in rows:
        if i is not None:
            q = brute_quality(t)
            want.append((i, *q, q[0] < 10 or 100 * q[4] > 20 * q[0]))
    assert got == sorted(want)
    assert not out.filter("base_failed and kept").count()
    assert quality_forest.judge(d.limit(0), labels).count() == 0


def walk(tree, row, node=0, depth=0):
    """A row's path through a tree, one split after another."""
    feature, value, left, right, path = tree
    if feature[node] < 0:
        return depth, path[node]
    return walk(tree, row, left[node] if row[feature[node]] <= value[node] else right[node], depth + 1)


def test_isolation_paths():
    """Scores are 2 to the minus mean path over the expected one; paths end at the limit or where rows are alone or alike."""
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.standard_normal((500, 3)), [[9, 9, 9]]])
    forest = quality_forest.Forest(x, [0, 1, 2], 40, 64, 1)
    score = forest.score(x)
    for i in (0, 17, 300, 500):
        steps = [walk(t, x[i]) for t in forest.trees]
        assert all(p >= d for d, p in steps) and max(d for d, _ in steps) <= 6
        assert score[i] == pytest.approx(2 ** (-np.mean([p for _, p in steps]) / quality_forest.Forest.expected(64)))
    assert score.argmax() == 500


@pytest.mark.parametrize("seed", range(5))
def test_calibration_takes_the_best_threshold(seed):
    import pandas as pd

    rng = np.random.default_rng(seed)
    bins = 40
    rows = [(b, int(rng.integers(0, 60 if b < 25 else 2)), int(rng.integers(0, 6 if b < 25 else 12))) for b in range(5, 38)]
    hist = pd.DataFrame([(b, g, g + bad) for b, g, bad in rows if g + bad], columns=["bin", "good", "n"])
    got = quality_forest.calibrate(hist, bins, 0.02, 5.0, 0.8)
    good, gains = hist.good.sum(), {2.0: 0.0}
    for b in hist.bin:
        above = hist[hist.bin >= b]
        if above.good.sum() <= 0.02 * good:
            gains[b / bins] = float((above.n - above.good).sum() - 5.0 * above.good.sum())
    assert gains[got] == max(gains.values())


# 7 packing

def test_packing(spark, texts):
    from tokenizers import Tokenizer

    rows = [*texts, (70, "Word. word, WORD x́. İ. <|endoftext|> it's 3.14 don't stop")]
    out = packing.pack(docs_of(spark, rows)).toPandas().sort_values(["sequence_id", "offset"])
    tok = Tokenizer.from_file(packing.tokenizer_path())
    whole = Counter()
    for i, t in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for k, at in enumerate(range(0, len(ids), 2048)):
            whole[i, k, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())] += 1
    got = Counter((None if r.doc_id != r.doc_id else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in out.itertuples())
    assert got == whole
    used = out.groupby("sequence_id").length.sum()
    assert used.max() <= 2048 and (out.groupby("sequence_id").length.cumsum() - out.length == out.offset).all()
    assert packing.pack(docs_of(spark, texts).limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_packing_plan(seed):
    rng = random.Random(seed)
    hist = Counter(rng.randint(1, 2048) for _ in range(3000))
    plan = packing.plan(dict(hist))
    back = Counter()
    for n, lengths in plan:
        assert sum(lengths) <= 2048
        for k in lengths:
            back[k] += n
    assert back == hist
    assert sum(n for n, _ in plan) <= 1.03 * sum(k * n for k, n in hist.items()) / 2048 + 2


# 8 licences

def test_licences(spark):
    rows = [(1, "Released under the MIT License. mit-license! MIT\nlicense"), (2, "Licensed under the Apache License, Version 2.0."), (3, "CC BY-NC 4.0"), (4, None), (5, ""),
            (6, "This work is licensed under the GNU General Public License, version 3."), (7, "license mit the of and"), (8, "word " * 100000), (None, "cc by nc"), (1, "x mit license")]
    got = [tuple(r)[:7] for r in license_scan.scan(docs_of(spark, rows)).orderBy(F.col("doc_id").asc_nulls_first(), "n_words").collect()]
    assert got == [(None, 3, 1, 0, 0, "cc-by-nc", "cc-by-nc"), (1, 3, 1, 1, 1, "mit", "mit"), (1, 9, 3, 3, 7, "mit", "mit"), (2, 8, 1, 3, 3, "apache-2", "apache-2"), (3, 5, 1, 0, 0, "cc-by-nc", "cc-by-nc"),
                   (4, 0, 0, None, None, "", ""), (5, 0, 0, None, None, "", ""), (6, 12, 0, None, None, "", "gpl-3"), (7, 5, 0, None, None, "", ""), (8, 100000, 0, None, None, "", "")]
    assert license_scan.scan(docs_of(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_licence_places_against_a_plain_scan(seed):
    """Every place of every base phrase, and the labels of templates that stand there whole, among near misses."""
    rng = random.Random(seed)
    scanner = license_scan.Scanner()
    vocabulary = sorted({w for p, _ in license_scan.BASE for w in p.split()} | {"the", "under", "2", "x"})
    for _ in range(200):
        words_ = rng.choices(vocabulary, k=rng.randint(0, 60))
        whole = rng.sample(license_scan.TEMPLATES, rng.randint(0, 2))
        for _, template in whole:
            at = rng.randint(0, len(words_))
            words_[at:at] = ["stop", *template.split(), "stop"]
        found = [w.encode() for w in words_]
        places, shares, _ = scanner.scan(found)
        want = sorted((i, label) for p, label in license_scan.BASE for i in range(len(words_)) if words_[i : i + len(p.split())] == p.split())
        assert sorted((i, scanner.labels[k]) for i, k in places) == want
        given = {scanner.labels[k] for k, share in shares.items() if share >= scanner.cover}
        text = " ".join(words_)
        assert {label for label, t in license_scan.TEMPLATES if f" {t} " in f" {text} "} <= given


def test_suffix_automaton_matches():
    rng = random.Random(8)
    seqs = [[rng.randrange(4) for _ in range(30)] for _ in range(3)]
    auto = license_scan.Automaton(seqs)
    text = [rng.randrange(4) for _ in range(200)]
    runs = {tuple(s[i:j]): None for s in seqs for i in range(30) for j in range(i + 1, 31)}
    v = n = 0
    for i, t in enumerate(text):
        while v and t not in auto.next[v]:
            v = auto.link[v]
            n = auto.length[v]
        if t in auto.next[v]:
            v, n = auto.next[v][t], n + 1
        longest = max((m for m in range(31) if m <= i + 1 and (m == 0 or tuple(text[i + 1 - m : i + 1]) in runs)))
        assert n == longest
        if n:
            run = text[i + 1 - n : i + 1]
            assert auto.ends[v] == {(k, e) for k, s in enumerate(seqs) for e in range(n - 1, 30) if s[e - n + 1 : e + 1] == run}


# 9 secrets

def brute_secrets(text):
    import re

    out = []
    for m in re.finditer(secret_scan.ASSIGN, text):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, m.end(), "assign"))
    for k, (name, pattern, least) in enumerate(secret_scan.KINDS[1:], 1):
        out += [(m.start(), k, m.end(), name) for m in re.finditer(pattern if name == "access" else "[0-9a-f]+", text) if m.end() - m.start() >= least]
    return sorted(out)


def test_secrets(spark):
    rng = random.Random(6)
    hexes = "".join(rng.choices("0123456789abcdef", k=40))
    rows = [(1, f'é token = "{hexes}" x'), (2, "password=token: abcdefghijklmnop"), (3, "AKIA" + "A1B2" * 4 + " AKIAshort"), (4, None), (5, ""), (6, hexes * 3000), (7, " ".join(f"api_key={hexes[i:]}" for i in range(20))),
            (8, "Xk9" + "".join(rng.choices("ABCDEFGHabcdefgh0123456789", k=30)) + " plainwordsonlynodigitsinthisone"), (None, "PASSWD: short"), (9, "secret:" + "=" * 12), (9, "secret:" + "=" * 12)]
    out = secret_scan.scan(docs_of(spark, rows)).select("doc_id", "n_assign", "n_access", "n_hex", secret_scan.listed(F.col("base")).alias("b"), secret_scan.listed(F.col("extra")).alias("e"))
    got = Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.b) for r in out.collect())
    want = Counter()
    for i, t in rows:
        s = brute_secrets(t or "")
        n = Counter(x[3] for x in s)
        want[i, n["assign"], n["access"], n["hex"], ",".join(f"{x[3]}:{x[0]}:{x[2]}" for x in s)] += 1
    assert got == want
    assert [r.e for r in out.filter("doc_id = 8").collect()] == ["entropy:0:33"]
    assert secret_scan.scan(docs_of(spark, rows).limit(0)).count() == 0


def test_secrets_in_very_long_runs(spark):
    """Candidates of 100,000 characters cost seconds, and long paths need no stack."""
    rng = random.Random(7)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    rows = [(1, "".join(rng.choices(alphabet, k=100_000))), (2, "ab1-" * 30_000 + "x"), (3, "ab1-" * 30_000 + "12345"), (4, "a/" * 60_000), (5, "abc1_" * 5 + "x77")]
    got = {r.doc_id: r.extra for r in secret_scan.scan(docs_of(spark, rows)).collect()}
    assert [(x.start, x.end) for x in got[1]] == [(0, 100_000)] and not got[2] and not got[4] and not got[5]


def test_entropy_by_increments(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choices("abcdXYZ0123456789"[: rng.randint(1, 17)], k=rng.randint(20, 60))) for _ in range(40)]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(secret_scan.entropy(F.col("t"))).collect()]
    w = secret_scan.WINDOW
    for t, h in zip(texts, got, strict=True):
        each = [-sum(c / w * np.log2(c / w) for c in Counter(t[i : i + w]).values()) for i in range(len(t) - w + 1)]
        assert h == pytest.approx(max(each))


# 10 substrings

def brute_substrings(rows, size):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[j : j + size] for _, b in texts for j in range(len(b) - size + 1))
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for j in range(len(b) - size + 1):
            if seen[b[j : j + size]] > 1:
                gone[j : j + size] = b"\1" * size
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = sum(g and (j == 0 or not gone[j - 1]) for j, g in enumerate(gone))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [256, 2])
def test_substrings(spark, texts, most):
    rng = random.Random(12)
    part = words(rng, 70)
    rows = texts + [(80 + i, words(rng, 30) + part[i * 7 : 260 + i * 9] + words(rng, 30)) for i in range(6)] + [(90, "ab" * 300), (91, "é" * 250), (92, part[:200]), (93, part[:199])]
    out = substring_dedup.dedup(docs_of(spark, rows), most=most)
    assert rows_of(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_substrings(rows, 200)


def test_substrings_empty(spark, texts):
    assert substring_dedup.dedup(docs_of(spark, texts).limit(0)).count() == 0


def test_anchors_depend_on_the_window_alone():
    rng = random.Random(1)
    inner = words(rng, 80).encode()
    for before in (b"", b"xyz " * 50):
        fp, first, n, at = substring_dedup.anchors(before + inner, 200, 80)
        assert n.sum() == len(before + inner) - 199
        here = {int(f): int(a) - len(before) for f, a in zip(fp, at, strict=True) if a >= len(before)}
        if before == b"":
            want = here
        assert set(want.items()) >= {x for x in here.items() if x[0] in want}


def suffixes_of(parts, cap, folder):
    symbols = b"".join(p + b"\0" for p in parts)
    padded = np.zeros(induced.Text.padded(len(symbols), 1), np.uint8)
    padded[: len(symbols)] = np.frombuffer(symbols, np.uint8)
    return symbols, induced.suffixes(induced.Text(padded, len(symbols), 256), cap, induced.Scratch(str(folder)))


@pytest.mark.parametrize("seed", range(10))
@pytest.mark.parametrize("limits", [(1 << 21, 1 << 21, 1 << 16, 1 << 22), (4, 50, 16, 64)])
def test_induced_sorting(tmp_path, seed, limits, monkeypatch):
    """Order and common prefixes, in memory and with recursion and all queues and arrays on disk."""
    for name, value in zip(("BASE", "ROOM", "BATCH", "SMALL"), limits, strict=True):
        monkeypatch.setattr(induced, name, value)
    rng = random.Random(seed)
    alphabet = rng.choice([b"a", b"ab", b"abc", b"abcdefgh", bytes(range(1, 246))])
    parts = [bytes(rng.choices(alphabet, k=rng.randint(1, 40))) for _ in range(rng.randint(1, 12))]
    parts += [p[:-1] + b"a" for p in parts if len(p) > 1] * (seed % 3 == 0) + [alphabet[:2] * 30] * (seed % 5 == 0)
    cap = rng.choice([5, 20, 200])
    text, found = suffixes_of(parts, cap, tmp_path)
    pos, lcp = map(np.concatenate, zip(*found, strict=True))
    assert sorted(pos.tolist()) == list(range(len(text)))
    for b, a, n in zip(pos[:-1].tolist(), pos[1:].tolist(), lcp[1:].tolist(), strict=True):
        x, y, m = text[a:], text[b:], 0
        while m < min(len(x), len(y), cap) and x[m] == y[m]:
            m += 1
        assert n == m and x[:cap] <= y[:cap]


def test_induced_sorting_needs_little_memory(tmp_path, monkeypatch):
    """With limits far below the text's size, a sort takes less than 8 bytes a byte, queues, names and stars included."""
    import tracemalloc

    for name, value in (("BASE", 1 << 14), ("ROOM", 1 << 14), ("BATCH", 1 << 11), ("SMALL", 1 << 16)):
        monkeypatch.setattr(induced, name, value)
    rng = random.Random(4)
    parts = [words(rng, 60).encode() for _ in range(1200)]
    text, found = suffixes_of(parts, 200, tmp_path)
    tracemalloc.start()
    n = sum(len(pos) for pos, _ in found)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == len(text) > 300_000 and peak < 8 * n


def test_substrings_of_bytes_that_are_no_text(spark):
    """Byte 255 occurs in no valid UTF-8 but may come in a string all the same."""
    rows = [(i, bytes([255, 65 + i]) * 3 + b"\xff\xfe" * 120 + bytes([66 + i])) for i in range(3)]
    one = substring_dedup._Contexts("/tmp", 1 << 20)
    import pandas as pd

    for i, t in rows:
        one.add(pd.DataFrame({"key": [i], "first": [0], "n": [len(t) - 199], "times": [1], "data": [t]}))
    assert one.wide
    got = [r for b in one.repeats(200) for r in b.to_pylist()]
    texts = dict(rows)
    seen = Counter(t[j : j + 200] for t in texts.values() for j in range(len(t) - 199))
    for i, t in texts.items():
        want = {j for j in range(len(t) - 199) if seen[t[j : j + 200]] > 1}
        assert {j for r in got if r["key"] == i for j in range(r["first"], r["end"])} == want


def test_small_shards_are_added_together(tmp_path, monkeypatch):
    """Shards of two or three contexts, one that goes over batches, and one that holds another's contexts again."""
    import pandas as pd
    import pyarrow as pa

    rng = random.Random(9)
    rows = []
    for s in range(300):
        core = words(rng, 120).encode()[:230]
        for i in range(2 + s % 2):
            data = core[: 215 + 5 * i] + rng.randbytes(40).hex().encode()
            rows.append({"shard": b"%06d" % s, "key": 10 * s + i, "first": 7, "n": len(data) - 199, "at": 100, "times": 1 + (s % 50 == 49), "data": data})
    rows += [r | {"shard": b"%06d" % 300} for r in rows[:2]]
    batches = pa.Table.from_pandas(pd.DataFrame(rows)).to_batches(max_chunksize=251)
    calls, add = [], substring_dedup._Contexts.add
    monkeypatch.setattr(substring_dedup._Contexts, "add", lambda self, r: (calls.append(len(r)), add(self, r))[1])
    for limit, most in ((1 << 20, len(batches)), (20_000, 24), (0, 320)):
        calls.clear()
        got = {}
        for b in substring_dedup._sort_shards(iter(batches), 200, str(tmp_path), limit):
            for r in b.to_pylist():
                got.setdefault(r["key"], set()).update(range(r["first"] - 7, r["end"] - 7))
        seen = Counter(r["data"][j : j + 200] for r in rows[:-2] for j in range(r["n"]))
        want = {r["key"]: w for r in rows if r["times"] == 1 and (w := {j for j in range(r["n"]) if seen[r["data"][j : j + 200]] > 1})}
        assert got == want and len(want) > 600 and sum(calls) == len(rows) and len(calls) <= most
