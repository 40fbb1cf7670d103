"""Exact substring deduplication (operator 10).

Every byte covered by a ``window``-byte string that starts anywhere else in the corpus,
same document included, is removed; all occurrences go.

Anchors: of the ``gram``-byte strings in a window the one with the least hash is the
window's anchor.  It depends on the window's bytes alone, so equal windows have equal
anchors at equal places, and a window is looked at only with those of its anchor.  The
windows of one anchor are a run; the bytes they cover are its context.

1. One pass over the texts gives the anchors' hashes; those found twice or more are
   counted over the whole corpus.
2. Documents without such an anchor are done with.  For the others, runs whose whole
   context is equal to another's are repeated as they are, copies however many at once.
3. Different contexts of one anchor are compared as a shard: its suffixes are sorted, with
   common-prefix values, by external induced sorting (``induced``), in memory that does not
   grow with the shard; neighbours with a common prefix of ``window`` bytes are repeated
   windows.  So that tasks stay even, anchors with more than ``most`` contexts (about 6 MB at
   20,000) are split first: of two equal windows, the bytes right or left of what is already
   equal agree in half of what is missing, so each context goes to the shards of its right
   and left extension, again and again while a shard is too large, and at full length
   counting alone decides.

Hashes of 64 bits only bring contexts together; bytes, or hashes of 128 bits of whole
contexts, decide.  The sort's queues are files of the task alone, which a task that runs
again makes anew: in the shared folder if that is a mounted one, else where Spark's own
spills go.  Defined results: null and empty texts have no bytes; repeated rows count as
copies; null ids are kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, induced, texts

_BITS = np.uint64(24)
_MASK = np.uint64((1 << 24) - 1)
STEP = 1 << 22  # windows anchored at once
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            ones = np.full(size, base, np.uint64)
            ones[0] = 1
            with np.errstate(over="ignore"):
                _POWERS[name] = np.multiply.accumulate(ones)
    return _POWERS["up"], _POWERS["down"]


def anchors(text: bytes, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each run of windows with one anchor: hash of the anchor, first window, number of windows, the anchor's place."""
    out = []
    data = np.frombuffer(text, np.uint8)
    for lo in range(0, len(data) - window + 1, STEP):
        part = data[lo : lo + STEP + window - 1]
        n, m = len(part) - window + 1, len(part) - gram + 1
        up, down = _powers(len(part) + 1)
        with np.errstate(over="ignore"):
            sums = np.concatenate((np.zeros(1, np.uint64), np.add.accumulate((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)])))
            h = texts.mixed((sums[gram:] - sums[:-gram]) * down[:m])
        key = (h & ~_MASK) | np.arange(m, dtype=np.uint64)
        # least key of every stretch of w grams: running minima within blocks of w, from both sides
        w = window - gram + 1
        blocks = np.full(-(-m // w) * w, np.iinfo(np.uint64).max, np.uint64)
        blocks[:m] = key
        blocks = blocks.reshape(-1, w)
        right = np.minimum.accumulate(blocks, axis=1).ravel()
        left = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        place = (np.minimum(left[:n], right[w - 1 : w - 1 + n]) & _MASK).astype(np.int64)
        first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        out.append((h[place[first]].view(np.int64), first + lo, np.diff(np.append(first, n)), place[first] + lo))
    if not out:
        return (np.zeros(0, np.int64),) * 4
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


T1 = "doc_id long, key long, n_bytes long, sha string, marks array<long>"
RUNS = "array<struct<fp:long,c1:long,c2:long,first:long,n:int,at:int>>"


def marked(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """Each row's length, digest and the hashes of its anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole = texts.as_bytes(b.column("text"))
            for lo, hi in texts.slices(whole):
                part = [t or b"" for t in whole[lo:hi]]
                marks = [anchors(t, window, gram)[0] for t in part]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), b.column("key").slice(lo, hi - lo), pa.array([len(t) for t in part], pa.int64()),
                                                  pa.array([hashlib.sha256(t).hexdigest() for t in part]), pa.array(marks, pa.list_(pa.int64()))],
                                                 ["doc_id", "key", "n_bytes", "sha", "marks"])

    return docs.select("doc_id", "key", "text").mapInArrow(run, T1)


def _contexts(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        kinds = {"fp": np.int64, "c1": np.int64, "c2": np.int64, "first": np.int64, "n": np.int32, "at": np.int32}
        for b in batches:
            whole, shared = texts.as_bytes(b.column("text")), b.column("shared")
            own, ends = shared.flatten().to_numpy(zero_copy_only=False), np.cumsum(pc.list_value_length(shared).to_numpy(zero_copy_only=False))
            begin = np.append(0, ends[:-1])
            for lo, hi in texts.slices(whole):
                parts, counts = [], []
                for i in range(lo, hi):
                    text = whole[i]
                    fp, first, n, place = anchors(text, window, gram)
                    hit = np.flatnonzero(np.isin(fp, own[begin[i] : ends[i]]))
                    fp, first, n, place = fp[hit], first[hit], n[hit], place[hit]
                    digests = b"".join([xxhash.xxh3_128_digest(text[a:z]) for a, z in zip(first.tolist(), (first + n - 1 + window).tolist(), strict=True)])
                    c1, c2 = np.frombuffer(digests, np.int64).reshape(-1, 2).T
                    parts.append((fp, c1, c2, first, n, place - first))
                    counts.append(len(hit))
                flat = [np.concatenate(c).astype(t) for c, t in zip(zip(*parts, strict=True), kinds.values(), strict=True)]
                structs = pa.StructArray.from_arrays([pa.array(c) for c in flat], list(kinds))
                runs = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), structs)
                cut = lambda c: b.column(c).slice(lo, hi - lo)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([cut("key"), cut("rows"), cut("text"), runs], ["key", "rows", "text", "runs"])

    return run


def _cut_out(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """The bytes of the contexts that a document stands for."""
    for b in batches:
        for text, key, wanted in zip(texts.as_bytes(b.column("text")), b.column("key").to_pylist(), b.column("wanted").to_pylist(), strict=True):
            cols = [[w["fp"].to_bytes(8, "little", signed=True) for w in wanted], [key] * len(wanted), [w["first"] for w in wanted], [w["n"] for w in wanted], [w["at"] for w in wanted],
                    [w["times"] for w in wanted], [text[w["first"] : w["first"] + w["n"] - 1 + window] for w in wanted]]
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["shard", "key", "first", "n", "at", "times", "data"])


SHARD = "shard binary, key long, first long, n int, at int, times long, data binary"


def _extended(left: int, right: int, span: int, window: int):
    """Shards one step finer: what is known equal, ``left`` bytes before the anchor and ``right`` from it
    on, grows on either side by ``span``; the side is part of the new shard's name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            pdf = b.to_pandas()
            out = []
            for grow_left, grow_right in ((span, 0), (0, span)):
                x, y = left + grow_left, right + grow_right
                fits = pdf[(pdf["at"] >= x) & (pdf["at"] + y <= pdf["data"].map(len))]
                names = [xxhash.xxh3_128_digest(b"%b %d %d " % (s, x, y) + d[a - x : a + y]) for s, d, a in zip(fits["shard"], fits["data"], fits["at"], strict=True)]
                out.append(fits.assign(shard=names, lo=x, hi=y))
            yield pa.RecordBatch.from_pandas(pd.concat(out), preserve_index=False, schema=pa.schema(
                [("shard", pa.binary()), ("key", pa.int64()), ("first", pa.int64()), ("n", pa.int32()), ("at", pa.int32()), ("times", pa.int64()), ("data", pa.binary()),
                 ("lo", pa.int32()), ("hi", pa.int32())]))

    return run


class _Contexts:
    """Contexts of whole shards for one sort, their bytes in a file."""

    def __init__(self, root: str, limit: int) -> None:
        root = root or os.environ.get("LOCAL_DIRS") or os.environ["SPARK_LOCAL_DIRS"]
        self.folder = os.path.join(root.split(",")[0], uuid.uuid4().hex)
        os.makedirs(self.folder)
        self.path, self.limit = os.path.join(self.folder, "bytes"), limit
        self.parts: list[pd.DataFrame] = []
        self.seen: set[tuple[int, int]] = set()
        self.size, self.wide = 0, False

    def add(self, rows: pd.DataFrame) -> None:
        """Rows of one shard or several; a context that came with another shard already counts once, so that it does not repeat itself."""
        key, first, n, times = (rows[c].to_numpy() for c in ("key", "first", "n", "times"))
        names = list(zip(key.tolist(), first.tolist(), strict=True))
        fresh = ~rows.duplicated(["key", "first"]).to_numpy()
        if self.seen:
            fresh &= [x not in self.seen for x in names]
        if self.size <= self.limit:  # what goes beyond is all of one shard
            self.seen.update(names)
        at = np.flatnonzero(fresh)
        if not len(at):
            return
        data = rows["data"].tolist()
        kept = [data[i] for i in at.tolist()]
        joined = b"\0".join([*kept, b""])
        self.wide |= b"\xff" in joined
        with open(self.path, "ab") as f:
            f.write(joined)
        ends = np.cumsum([len(d) + 1 for d in kept], dtype=np.int64)
        self.parts.append(pd.DataFrame({"key": key[at], "first": first[at], "n": n[at].astype(np.int64), "once": times[at] == 1, "start": self.size + np.append(0, ends[:-1])}))
        self.size += int(ends[-1])

    def repeats(self, window: int) -> Iterator[pa.RecordBatch]:
        """(key, first, end) of maximal runs of window starts that another context holds too."""
        try:
            if self.size:
                yield from self._repeats(window)
        finally:
            shutil.rmtree(self.folder, ignore_errors=True)

    def _repeats(self, window: int) -> Iterator[pa.RecordBatch]:
        rows = pd.concat(self.parts, ignore_index=True)
        self.parts, self.seen = [], set()
        starts, n, scratch = rows["start"].to_numpy(), rows["n"].to_numpy(), induced.Scratch(self.folder)
        # symbols are bytes and one more; valid UTF-8 has no byte 255, so that 0 is free to part the contexts
        kind = np.uint16 if self.wide else np.uint8
        symbols = scratch.array(induced.Text.padded(self.size, np.dtype(kind).itemsize), kind)
        raw = np.memmap(self.path, np.uint8, mode="r")
        for lo in range(0, self.size, 1 << 20):
            symbols[lo : lo + (1 << 20)][: self.size - lo] = raw[lo : lo + (1 << 20)].astype(kind) + kind(1)
        symbols[np.append(starts[1:], self.size) - 1] = 0
        hit = scratch.array(self.size, bool)
        last, clean = -1, False
        for pos, lcp in induced.suffixes(induced.Text(symbols, self.size, 257 if self.wide else 256), window, scratch):
            context = np.searchsorted(starts, pos, "right") - 1
            own = np.flatnonzero(pos - starts[context] < n[context])  # windows of the context's own run
            breaks = np.cumsum(lcp < window)
            if len(own):
                at, p = breaks[own], pos[own]
                before = np.append(last, p[:-1])
                same = np.append(clean and at[0] == 0, at[1:] == at[:-1])
                hit[p[same]] = True
                hit[before[same]] = True
                last, clean = int(p[-1]), bool(breaks[-1] == at[-1])
            else:
                clean = clean and breaks[-1] == 0
        key, first, once = rows["key"].to_numpy(), rows["first"].to_numpy(), rows["once"].to_numpy()
        bounds = np.append(starts, self.size)
        for i in range(0, len(rows), 4096):
            z = min(i + 4096, len(rows))
            lo = bounds[i]
            found = np.asarray(hit[lo : bounds[z]]) & np.repeat(once[i:z], np.diff(bounds[i : z + 1]))
            edges = np.flatnonzero(np.diff(np.concatenate(([0], found.astype(np.int8), [0]))))
            a, end = edges[::2] + lo, edges[1::2] + lo
            c = np.searchsorted(starts, a, "right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (key[c], first[c] + a - starts[c], first[c] + end - starts[c])], ["key", "first", "end"])


def _sort_shards(batches: Iterator[pa.RecordBatch], window: int, root: str, limit: int = 3 << 20) -> Iterator[pa.RecordBatch]:
    """Repeated windows of the shards of a partition, whose rows come shard by shard: small ones are sorted together, large ones alone or with a few small ones."""
    held, last = None, None
    for b in batches:
        if not b.num_rows:
            continue
        pdf = b.to_pandas()
        shards = pdf["shard"].tolist()
        # where shards begin, and how many bytes come before
        cuts = np.array([i for i in range(1, len(shards)) if shards[i] != shards[i - 1]] + [len(shards)], np.int64)
        before = np.append(0, np.cumsum(pdf["data"].map(len).to_numpy(np.int64) + 1))
        lo = 0
        while lo < len(shards):
            if held is not None and held.size > limit and shards[lo] != last:
                yield from held.repeats(window)
                held = None
            if held is None:
                held = _Contexts(root, limit)
            # whole shards until there is enough, the first of them whatever its size
            c = int(np.searchsorted(cuts, lo, "right"))
            c = max(c, int(np.searchsorted(before[cuts], before[lo] + limit - held.size, "right")))
            hi = int(cuts[min(c, len(cuts) - 1)])
            held.add(pdf.iloc[lo:hi])
            last, lo = shards[hi - 1], hi
    if held is not None:
        yield from held.repeats(window)


def _removed(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for text, key, ranges in zip(texts.as_bytes(b.column("text")), b.column("key").to_pylist(), b.column("ranges").to_pylist(), strict=True):
            edge = np.zeros(len(text) + 1, np.int64)
            np.add.at(edge, [r["first"] for r in ranges], 1)
            np.add.at(edge, [r["end"] - 1 + window for r in ranges], -1)
            gone = np.cumsum(edge[:-1]) > 0
            kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
            rows.append((key, int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(np.int8)))) == 1).sum()), hashlib.sha256(kept).hexdigest(), kept))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["key", "n_removed", "n_spans", "kept_sha256", "kept"])


def dedup(docs: DataFrame, window: int = 200, gram: int = 80, most: int = 20_000) -> DataFrame:
    """Per row: doc_id, key, n_bytes, n_removed, n_spans, kept_sha256, and ``kept``, the remaining
    bytes, where something was removed (they may end inside a character)."""
    head = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.row_key().alias("key"), F.col("text").cast("string").alias("text"))
    rows = common.materialize(marked(head, window, gram), "sub-marks")
    posted = rows.select("key", F.explode("marks").alias("fp"))
    # written, so that the join has two plain sides and Spark can split an anchor that most documents share
    shared = common.materialize(posted.groupBy("fp").count().filter("count > 1").select("fp"), "sub-shared")
    hot = posted.join(shared, "fp").groupBy("key").agg(F.collect_set("fp").alias("shared"))
    times = rows.groupBy("key").agg(F.count(F.lit(1)).alias("rows"))
    hot = hot.join(times, "key")
    affected = (head.select("key", "text").join(hot, "key").dropDuplicates(["key"])
                .mapInArrow(_contexts(window, gram), f"key long, rows long, text string, runs {RUNS}"))
    affected = common.materialize(affected, "sub-affected")
    runs = affected.select("key", "rows", F.explode("runs").alias("r")).select("key", "rows", "r.*")
    same = ["fp", "c1", "c2", "n", "at"]
    groups = common.materialize(runs.groupBy(*same).agg(F.sum("rows").alias("times"), F.min(F.struct("key", "first")).alias("rep")), "sub-groups")
    twice = runs.join(groups.filter("times > 1").select(*same), same, "left_semi").select("key", "first", (F.col("first") + F.col("n")).alias("end"))
    # anchors of which contexts differ, by one context of each kind
    several = common.materialize(groups.groupBy("fp").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1").select("fp"), "sub-several")
    wanted = (groups.join(several, "fp").groupBy(F.col("rep.key").alias("key"))
              .agg(F.collect_list(F.struct("fp", F.col("rep.first").alias("first"), "n", "at", "times")).alias("wanted")))
    shards = (affected.select("key", "text").join(wanted, "key").select("key", "text", "wanted")
              .mapInArrow(lambda it: _cut_out(it, window), SHARD))
    level = common.materialize(shards.withColumn("lo", F.lit(0)).withColumn("hi", F.lit(gram)), "sub-shards-0")
    found = [twice]
    ready = []
    for turn in range(1, window.bit_length() + 1):
        counts = level.groupBy("shard").agg(F.count(F.lit(1)).alias("kinds"), F.min("times").alias("least"))
        large = counts.filter((F.col("kinds") > most) & (F.col("least") == 1)).select("shard")
        ready.append(level.join(counts.filter((F.col("kinds") <= most) & (F.col("kinds") > 1) & (F.col("least") == 1)).select("shard"), "shard", "left_semi"))
        big = common.materialize(level.join(large, "shard", "left_semi"), f"sub-large-{turn}")
        extents = [(r["lo"], r["hi"]) for r in big.select("lo", "hi").distinct().collect()]  # at most 2**turn pairs
        if not extents:
            break
        finer = []
        for lo, hi in extents:
            missing = window - lo - hi
            of = big.filter((F.col("lo") == lo) & (F.col("hi") == hi)).drop("lo", "hi")
            if missing > 0:
                finer.append(of.mapInArrow(_extended(lo, hi, (missing + 1) // 2, window), SHARD + ", lo int, hi int"))
            else:  # a whole window is equal in all rows of the shard
                start = F.col("first") + F.col("at") - lo
                found.append(of.filter("times = 1").select("key", start.alias("first"), (start + 1).alias("end")))
        if not finer:
            break
        level = common.materialize(common.union_all(finer), f"sub-shards-{turn}")
    to_sort = common.union_all(ready).select(*[c.split()[0] for c in SHARD.split(", ")])
    parts = max(1, int(to_sort.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    root = common.scratch_dir(docs.sparkSession, "sub-queues")
    found.append(to_sort.repartition(parts, "shard").sortWithinPartitions("shard").mapInArrow(lambda it: _sort_shards(it, window, root), "key long, first long, end long"))
    ranges = common.union_all(found).groupBy("key").agg(F.collect_list(F.struct("first", "end")).alias("ranges"))
    gone = (affected.select("key", "text").join(ranges, "key")
            .mapInArrow(lambda it: _removed(it, window), "key long, n_removed long, n_spans long, kept_sha256 string, kept binary"))
    return (rows.select("doc_id", "key", "n_bytes", "sha").join(gone, "key", "left")
            .select("doc_id", "key", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
                    F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"), "kept"))


def op10_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(common.table(spark, sf_dir, "documents")).drop("key", "kept")
