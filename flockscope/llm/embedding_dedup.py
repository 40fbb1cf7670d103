"""Near duplicates among embeddings by int8 tile products (operator 5).

Equal vectors are collapsed to one with a count.  The distinct vectors are cut into
blocks, by random hyperplanes first so that blocks are narrow where the data are.  Block
pairs whose centres lie further apart than their radii and the threshold's angle allow are
left out before any vector is dealt; every other pair is a tile, worked on by one task.

Tiles hold int8 codes.  A unit vector ``a`` is stored as ``â = s * q``, with the error
``e = |a - â|``; a second int8 code of what remains, ``a - â ~ t * r``, has the error ``f``.
``q`` products are sums of integers and exact.  ``|a.b - â.b̂| <= e_a + |â| * e_b`` holds for
every pair, so a pair within that bound of the threshold is worked out again with the second
codes, whose bound ``f_a + (1 + f_a) * f_b`` is some hundred times narrower, and what still
is open within that is computed from the vectors in double precision, outside the tile.  A
tile returns counts of links, a spanning forest of them, and its open pairs.

All pairs are looked at but for those that centres and radii part, so the work grows with
the square of the number of distinct vectors; of a vector two bytes a component are dealt to
as many tiles as there are blocks, of which there are ``n / block``, ``spread`` at least.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components have no links, like those of another length; each row of a repeated vec_id
counts as a vector, and shares the id's component; rows with a null vec_id count as
vectors and have a null component and kept true; components are taken as they are, in double
precision; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Covers the rounding of double precision in bounds and scales.
SLACK = 1e-9
ROWS = 512
COLUMNS = 8192
#: Components up to which sums of int8 products are exact in single precision.
EXACT = (1 << 24) // 127**2


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, errors |a - s q| and lengths |s q| of vectors."""
    scale = np.maximum(np.abs(unit).max(1), 1e-300) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    back = codes * scale[:, None]
    return codes, scale, np.linalg.norm(unit - back, axis=1), np.linalg.norm(back, axis=1)


class Codes:
    """The codes of a block: two bytes a component and five numbers a vector."""

    def __init__(self, q: np.ndarray, r: np.ndarray, s: np.ndarray, t: np.ndarray, e: np.ndarray, f: np.ndarray, length: np.ndarray) -> None:
        self.q, self.r, self.s, self.t, self.e, self.f, self.length = q, r, s, t, e, f, length

    @classmethod
    def of(cls, unit: np.ndarray) -> Codes:
        q, s, e, length = quantised(unit)
        r, t, f, _ = quantised(unit - q * s[:, None])
        return cls(q, r, s, t, e, f, length)

    def packed(self) -> tuple[bytes, bytes]:
        return np.stack([self.q, self.r]).tobytes(), np.stack([self.s, self.t, self.e, self.f, self.length]).tobytes()

    @classmethod
    def unpacked(cls, codes: bytes, numbers: bytes) -> Codes:
        s, t, e, f, length = np.frombuffer(numbers, np.float64).reshape(5, -1)
        q, r = np.frombuffer(codes, np.int8).reshape(2, len(s), -1)
        return cls(q, r, s, t, e, f, length)

    def fine(self, at: np.ndarray) -> np.ndarray:
        """Both codes together, in double."""
        return self.q[at] * self.s[at, None] + self.r[at] * self.t[at, None]


def links(a: Codes, b: Codes, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, column, open) of the pairs that may have a cosine >= threshold; those not open surely have."""
    kind = np.float32 if a.q.shape[1] <= EXACT else np.float64
    for left in range(0, len(b.s), COLUMNS):
        right = slice(left, min(left + COLUMNS, len(b.s)))
        codes, scales = b.q[right].T.astype(kind), b.s[right]
        for lo in range(0, len(a.s), ROWS):
            rows = slice(lo, min(lo + ROWS, len(a.s)))
            product = a.q[rows].astype(kind) @ codes  # integers, exact
            # per row the least product that any column's scale and error leave possible
            bound = a.e[rows] + a.length[rows] * b.e[right].max() + SLACK
            need = (threshold - bound) / a.s[rows] / np.where(threshold > bound, scales.max(), scales.min())
            r, c = np.nonzero(product >= (np.floor(need) - 1)[:, None].astype(kind))
            if not len(r):
                continue
            value = product[r, c].astype(np.float64) * a.s[rows][r] * scales[c]
            r, c = r + lo, c + left
            own = a.e[r] + a.length[r] * b.e[c] + SLACK
            keep = value + own >= threshold
            if same:
                keep &= r != c
            r, c, sure = r[keep], c[keep], (value - own >= threshold)[keep]
            unsure = np.zeros(len(r), bool)
            again = np.flatnonzero(~sure)
            for k in range(0, len(again), 1 << 15):
                at = again[k : k + (1 << 15)]
                near = np.einsum("ij,ij->i", a.fine(r[at]), b.fine(c[at]))
                tight = a.f[r[at]] + (1 + a.f[r[at]]) * b.f[c[at]] + SLACK
                sure[at] = near - tight >= threshold
                unsure[at] = ~sure[at] & (near + tight >= threshold)
            keep = sure | unsure
            yield r[keep], c[keep], unsure[keep]


class Forest:
    """Labels of connected nodes, merged a batch of links at a time."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def merge(self, u: np.ndarray, v: np.ndarray) -> None:
        while len(u):
            a, b = self.label[u], self.label[v]
            apart = a != b
            if not apart.any():
                return
            u, v, a, b = u[apart], v[apart], a[apart], b[apart]
            np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
            while (nxt := self.label[self.label]) is not None and (nxt != self.label).any():
                self.label = nxt


def _tile(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """One or two blocks to rows (gid, n, other, open): links counted, for nodes not roots in the tile's forest their root, and open pairs."""
    pdf = pdf.sort_values("block")
    blocks = [(np.asarray(r.gids, np.int64), np.asarray(r.copies, np.int64), Codes.unpacked(r.codes, r.numbers)) for r in pdf.itertuples()]
    (ga, ca, a), (gb, cb, b), same = blocks[0], blocks[-1], len(blocks) == 1
    na, nb = np.zeros(len(ga), np.int64), np.zeros(len(gb), np.int64)
    forest = Forest(len(ga) + (0 if same else len(gb)))
    left, right = [], []
    for r, c, unsure in links(a, b, threshold, same):
        once = unsure & (r < c) if same else unsure  # a tile of one block sees each pair twice
        left.append(ga[r[once]])
        right.append(gb[c[once]])
        r, c = r[~unsure], c[~unsure]
        na += np.bincount(r, cb[c], len(ga)).astype(np.int64)
        if not same:
            nb += np.bincount(c, ca[r], len(gb)).astype(np.int64)
        forest.merge(r, c if same else c + len(ga))
    gids = ga if same else np.concatenate([ga, gb])
    n = na if same else np.concatenate([na, nb])
    hit = np.flatnonzero(n > 0)
    found = pd.DataFrame({"gid": gids[hit], "n": n[hit], "other": gids[forest.label[hit]], "open": False})
    left, right = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in (left, right))
    return pd.concat([found, pd.DataFrame({"gid": left, "n": np.zeros(len(left), np.int64), "other": right, "open": True})]) if len(left) else found


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    x = x / np.abs(x).max(1)[:, None]  # squares of very large or small components stay finite
    return x / np.linalg.norm(x, axis=1)[:, None]


def _near_blocks(pdf: pd.DataFrame, threshold: float) -> Iterator[pd.DataFrame]:
    """Of one or two groups of blocks, the pairs of blocks that can hold a link."""
    pdf = pdf.sort_values("group")
    parts = [(np.asarray(r.blocks, np.int64), np.asarray(r.radii, np.float64), np.asarray(list(r.centres), np.float64).reshape(len(r.blocks), -1)) for r in pdf.itertuples()]
    (ba, ra, a), (bb, rb, b), same = parts[0], parts[-1], len(parts) == 1
    angle = np.arccos(np.clip(a @ b.T, -1, 1)) - ra[:, None] - rb[None]
    near = angle <= math.acos(threshold) + 1e-6
    if same:
        near &= np.arange(len(ba))[:, None] <= np.arange(len(bb))[None]
    r, c = np.nonzero(near)
    yield pd.DataFrame({"x": np.minimum(ba[r], bb[c]), "y": np.maximum(ba[r], bb[c])})


def _all_groups(n: int):
    """Pairs (i, j) with i <= j of n groups."""
    i = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i")
    return i, F.explode(F.sequence(F.col("i"), F.lit(n - 1))).alias("j")


def dedup(vectors: DataFrame, threshold: float = 0.95, block: int = 32768, spread: int = 24, seed: int = 5) -> DataFrame:
    """Per row of ``vectors(vec_id, embedding)``: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    ok = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("e", lambda x: x != 0)
    good = rows.filter("e is not null").filter(ok)
    distinct = good.groupBy("e").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    distinct = common.materialize(distinct.withColumn("gid", F.monotonically_increasing_id()), "emb-distinct")
    n = distinct.count()
    block = max(1024, min(block, -(-n // spread)))
    bits = max(0, min(10, int(math.log2(max(n / block, 1)))))

    def sector(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = np.zeros(len(pdf), np.int64)
            dims = pdf.e.map(len).to_numpy()
            for d in np.unique(dims):
                planes = np.random.default_rng([seed, int(d)]).standard_normal((int(d), bits))
                at = np.flatnonzero(dims == d)
                out[at] = (d << 10) + ((_unit(pdf.e.iloc[at]) @ planes > 0) @ (1 << np.arange(bits)) if bits else 0)
            yield pdf.assign(sector=out)

    placed = common.materialize(distinct.select("gid", "e", "copies").mapInPandas(sector, "gid long, e array<double>, copies long, sector long"), "emb-sectors")
    sizes = placed.groupBy("sector").count()  # at most 2**bits rows for each length of vectors
    slices = sizes.select(F.col("sector").alias("_s"), F.ceil(F.col("count") / block).alias("slices"))
    cut = (placed.join(slices, F.col("sector") == F.col("_s"))
           .withColumn("block", F.col("sector") * F.lit(1 << 20) + F.pmod(F.xxhash64("gid"), F.col("slices"))))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        unit = _unit(pdf.e)
        middle = unit.mean(0)
        middle = middle / max(np.linalg.norm(middle), 1e-12)
        radius = math.acos(float(np.clip((unit @ middle).min() - 1e-9, -1, 1)))
        codes, numbers = Codes.of(unit).packed()
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "dim": [unit.shape[1]], "gids": [pdf.gid.to_numpy()], "copies": [pdf.copies.to_numpy()],
                             "codes": [codes], "numbers": [numbers], "centre": [middle], "radius": [radius]})

    packed = cut.select("block", "gid", "e", "copies").groupBy("block").applyInPandas(
        pack, "block long, dim int, gids array<long>, copies array<long>, codes binary, numbers binary, centre array<double>, radius double")
    packed = common.materialize(packed, "emb-blocks")
    # which blocks are near: groups of blocks meet by their numbers, with centres and radii alone
    tops = packed.groupBy("dim").agg(F.count(F.lit(1)).alias("blocks")).collect()  # one row a length of vectors
    near = []
    for top in tops:
        groups = -(-top.blocks // 512)
        own = (packed.filter(F.col("dim") == top.dim).withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int")).groupBy("group")
               .agg(F.collect_list(F.struct("block", "radius", "centre")).alias("b"))
               .select("group", F.col("b.block").alias("blocks"), F.col("b.radius").alias("radii"), F.col("b.centre").alias("centres")))
        i, j = _all_groups(groups)
        meet = spark.range(1).select(i).select("i", j)
        meet = meet.select(F.concat_ws(":", "i", "j").alias("pair"), F.explode(F.array_distinct(F.array("i", "j"))).alias("g"))
        near.append(meet.join(own, F.col("g") == F.col("group")).select("pair", "group", "blocks", "radii", "centres").groupBy("pair")
                    .applyInPandas(lambda pdf: pd.concat(list(_near_blocks(pdf, threshold))), "x long, y long"))
    if not near:
        near.append(spark.createDataFrame([], "x long, y long"))
    pairs = common.materialize(common.union_all(near).select(F.concat_ws(":", "x", "y").alias("tile"), F.array_distinct(F.array("x", "y")).alias("both")), "emb-pairs")
    dealt = (pairs.select("tile", F.explode("both").alias("_b")).join(packed, F.col("_b") == F.col("block"))
             .select("tile", "block", "gids", "copies", "codes", "numbers"))
    n_tiles = max(1, pairs.count())
    tiles = dealt.repartition(min(n_tiles, 1 << 16), "tile").groupBy("tile").applyInPandas(
        lambda pdf: _tile(pdf, threshold), "gid long, n long, other long, open boolean")
    tiles = common.materialize(tiles, "emb-tiles")
    # what the codes leave open, from the vectors themselves
    unsure = tiles.filter("open").select(F.col("gid").alias("a"), F.col("other").alias("b"))
    side = lambda x: distinct.select(F.col("gid").alias(x), F.col("e").alias(f"e{x}"), F.col("copies").alias(f"c{x}"))

    def exact(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for d in np.unique(pdf.ea.map(len)):
                own = pdf[pdf.ea.map(len) == d]
                yield own[["a", "b", "ca", "cb"]][np.einsum("ij,ij->i", _unit(own.ea), _unit(own.eb)) >= threshold]

    settled = common.materialize(unsure.join(side("a"), "a").join(side("b"), "b").mapInPandas(exact, "a long, b long, ca long, cb long"), "emb-settled")
    sure = tiles.filter("not open").select("gid", "n", "other")
    sure = (sure.unionByName(settled.select(F.col("a").alias("gid"), F.col("cb").alias("n"), F.col("b").alias("other")))
            .unionByName(settled.select(F.col("b").alias("gid"), F.col("ca").alias("n"), F.col("a").alias("other"))))
    found = sure.groupBy("gid").agg(F.sum("n").alias("n"))
    comp = common.components(sure.select(F.col("gid").alias("src"), F.col("other").alias("dst")), "emb")
    named = common.materialize(
        distinct.join(found, "gid", "left").join(comp.withColumnRenamed("id", "_c"), F.col("gid") == F.col("_c"), "left")
        .select("e", "least", "copies", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("component_id", "gid").alias("root")), "emb-named")
    # an id that stands on several vectors joins their components
    ids = good.filter("vec_id is not null").join(named.select("e", "root"), "e").select("vec_id", "root").distinct()
    twice = ids.groupBy("vec_id").agg(F.min("root").alias("src"), F.max("root").alias("dst")).filter("src < dst")
    ids = common.materialize(ids, "emb-ids")
    several = ids.join(twice.select("vec_id", "src"), "vec_id").select("src", F.col("root").alias("dst"))
    joined = common.components(several, "emb-ids-join")
    roots = ids.join(joined, F.col("root") == F.col("id"), "left").select("vec_id", "root", F.coalesce("component_id", "root").alias("top"))
    least = roots.groupBy("top").agg(F.min("vec_id").alias("component_id"))
    by_root = roots.select("root", "top").distinct().join(least, "top").select(F.col("root").alias("_r"), "component_id")
    linked = (good.join(named, "e").join(by_root, F.col("root") == F.col("_r"), "left")
              .select("vec_id", (F.col("n") + F.col("copies") - 1).alias("n_links"), "component_id"))
    lone = rows.filter(F.col("e").isNull() | ~ok).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.unionByName(lone)
    comp_id = F.when(F.col("vec_id").isNotNull(), F.col("component_id"))
    return out.select("vec_id", "n_links", comp_id.alias("component_id"), F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op5_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(common.table(spark, sf_dir, "embeddings"))
