"""Narratives over runs, hashes that share common bands, deep threads and quantisation tables."""

import random

import numpy as np
import pytest

from flockscope.functions import scalars as S
from flockscope.operators import investigation, narratives
from flockscope.sources import jpeg


def greedy(new, known, least):
    unit = lambda v: np.asarray(v) / np.linalg.norm(v)
    pairs = sorted((-round(float(unit(v) @ unit(w)), 12), n, c) for c, v in new for n, w in known)
    pairs = [p for p in pairs if -p[0] >= least]
    kept, of = {}, {}
    for _, n, c in pairs:
        if c not in kept and n not in of:
            kept[c], of[n] = n, c
    out = {}
    for c, _ in new:
        mine = [p for p in pairs if p[2] == c]
        out["c", c] = ("kept", kept[c], None) if c in kept else ("split", None, mine[0][1]) if mine else ("new", None, None)
    for n, _ in known:
        if n not in of:
            mine = sorted((s, c) for s, m, c in pairs if m == n)
            out["n", n] = ("merged", n, kept.get(mine[0][1])) if mine else ("gone", n, None)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_narratives_keep_their_identity(spark, seed):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(9, 8))
    near = lambda i, s: base[i] + rng.normal(0, s, 8)
    known = [(f"n{i}", near(i, 0.05)) for i in range(7)] + [("n8", near(0, 0.2)), ("n9", near(0, 0.25))]
    order = rng.permutation(10).tolist()
    new = [(order[i], near(i, 0.05)) for i in (0, 1, 2, 3, 7, 8)] + [(order[9], near(1, 0.2)), (order[6], near(1, 0.25))]
    frame = lambda rows, name, kind: spark.createDataFrame([(k, [float(x) for x in v]) for k, v in rows], f"{name} {kind}, centroid array<float>")
    got = {("n", r.narrative_id) if r.cluster is None else ("c", r.cluster): (r.status, r.narrative_id, r.origin)
           for r in narratives.match_narratives(frame(new, "cluster", "long"), frame(known, "narrative_id", "string")).collect()}
    want = greedy(new, known, 0.82)
    assert got == want and {w[0] for w in want.values()} == {"kept", "split", "new", "merged", "gone"}


def test_first_run_has_only_new_narratives(spark):
    new = spark.createDataFrame([(1, [1.0, 0.0])], "cluster long, centroid array<float>")
    known = spark.createDataFrame([], "narrative_id string, centroid array<float>")
    assert [(r.cluster, r.status) for r in narratives.match_narratives(new, known).collect()] == [(1, "new")]
    assert narratives.match_narratives(new.limit(0), known).count() == 0


@pytest.mark.parametrize(("distance", "most"), [(6, 8), (2, 3)])
def test_hashes_with_a_common_band(spark, distance, most):
    """Most hashes share their upper half, so that its bands are no keys by themselves."""
    rng = random.Random(distance)
    base = [rng.getrandbits(32) for _ in range(25)]
    hashes = [(0xABCD0123 << 32 | b) ^ sum(1 << x for x in rng.sample(range(64), rng.randint(0, 5))) for b in base for _ in range(6)] + [rng.getrandbits(64) for _ in range(40)]
    rows = [(i, h - (1 << 64) if h >> 63 else h) for i, h in enumerate(hashes)] + [(900, None)]
    rows += [(901, rows[0][1])]
    got = {(r.a, r.b): r.apart for r in narratives.near_hashes(spark.createDataFrame(rows, "id long, h long"), distance, most=most).collect()}
    first = {}
    for i, h in rows:
        if h is not None:
            first.setdefault(h, i)
    items = sorted((i, h) for h, i in first.items())
    want = {(i, j): bin((x ^ y) & (1 << 64) - 1).count("1") for n, (i, x) in enumerate(items) for j, y in items[n + 1 :] if bin((x ^ y) & (1 << 64) - 1).count("1") <= distance}
    assert got == want and len(want) > 20


def test_threads_of_any_depth(spark):
    rows = [("t", i, i - 1 if i else None) for i in range(300)] + [("u", 0, 7), ("u", 1, 0), ("u", 2, 0), ("u", 2, 0), ("v", 1, 2), ("v", 2, 1), ("v", 3, 1), ("v", 4, 4), ("v", 5, None)]
    out = investigation.thread_depths(spark.createDataFrame(rows, "t string, c long, p long"), "t", "c", "p")
    got = {(r.t, r.c): r.depth for r in out.collect()}
    assert got == {("t", i): i for i in range(300)} | {("u", 0): 0, ("u", 1): 1, ("u", 2): 1, ("v", 5): 0}


def segment(marker, body):
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def test_quantisation_tables(spark, tmp_path):
    luma, chroma = bytes(range(1, 65)), bytes([9] * 64)
    wide = b"\x10" + b"".join((300 + i).to_bytes(2, "big") for i in range(64))
    head = b"\xff\xd8" + segment(0xE0, b"JFIF\0")
    files = {"a.jpg": head + segment(0xDB, b"\x00" + luma + b"\x01" + chroma) + segment(0xDA, b"x") + segment(0xDB, b"\x00" + chroma), "b.JPEG": head + b"\xff" + segment(0xDB, wide),
             "c.jpg": head + segment(0xDB, b"\x00" + luma[:50]), "d.jpg": b"\x89PNG", "f.jpg": head + segment(0xDB, b"\x01" + chroma) + b"\xff\xd9", "g.png": head + segment(0xDB, b"\x00" + luma), "h.jpg": head + segment(0xDB, b"\x00" + bytes([2] * 64))}
    (tmp_path / "in").mkdir()
    for name, data in files.items():
        (tmp_path / "in" / name).write_bytes(data)
    assert jpeg.tables(b"") == {} and jpeg.tables(files["a.jpg"]) == {0: list(luma), 1: list(chroma)}
    got = {r.path.rsplit("/", 1)[1]: (r.luma, r.artifact) for r in jpeg.artifact_tiers(jpeg.read(spark, str(tmp_path))).collect()}
    assert got == {"a.jpg": (32.5, 0.35), "b.JPEG": (331.5, 0.40), "h.jpg": (2.0, 0.75)} | dict.fromkeys(("c.jpg", "d.jpg", "f.jpg"), (None, None))


def test_laplacian_artifact(spark):
    rows = spark.createDataFrame([(0.0,), (250.0,), (500.0,), (9000.0,), (None,)], "v double")
    from pyspark.sql import functions as F

    assert [r[0] for r in rows.select(S.laplacian_artifact(F.col("v"))).collect()] == [1.0, 0.5, 0.0, 0.0, 0.5]
