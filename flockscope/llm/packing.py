"""Best-fit packing of tokenised documents into sequences (operator 7).

Documents become token ids; longer ones than a sequence are cut.  How pieces are packed
depends only on how many there are of each length, at most ``capacity`` numbers, so the
plan is made on the driver from that histogram, by linear grouping:

* lengths above ``small`` tokens, sorted, are cut into ``groups`` groups of equally
  many pieces, each rounded up to its longest;
* configurations of these few sizes are chosen one after the other: the longest group
  left, filled up by the subset of the others that wastes least, and used as often as
  its scarcest group allows;
* actual lengths are put in place of the rounded ones, which frees what rounding took;
* small pieces go, longest first, where they fit best, else into new sequences.

Runs of equal lengths are handled as one, so the plan's size does not depend on the
number of documents.  Pieces then find their places by their rank among the pieces of
their length.

Defined results: a null text is empty and has the one id 0; equal rows are packed as
pieces of their own; null ids are kept; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, texts

CAPACITY, END = 2048, 0
#: Words whose ids a worker remembers.
REMEMBERED = 1_000_000
SLICE = 512
_WORKER: dict[str, tuple[object, dict[bytes, bytes]]] = {}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _loaded(path: str) -> tuple[object, dict[bytes, bytes]]:
    if path not in _WORKER:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        _WORKER[path] = (Tokenizer.from_file(path), {})
    return _WORKER[path]


def encode(values: list[bytes | None], path: str) -> list[bytes]:
    """Each text's ids, as little-endian unsigned 32-bit numbers.

    The tokenizer drops white space and matches nothing across it, so a text's ids are
    those of its words in turn.  It lowers case, and a full stop or comma after a letter
    is a match of its own; so each distinct lower-case word is encoded once without it.
    """
    tokenizer, known = _loaded(path)
    # a special token's name counts only as it is written
    words = [(v if b"<|" in v else v.lower()).split() if v else [] for v in values]
    fresh = {w for ws in words for w in ws if w not in known}
    stems = {w: w[:-1] for w in fresh if w[-1] in b".," and w[:-1].decode().lower().isalpha()}
    new = list({stems.get(w, w) for w in fresh} - known.keys())
    for at in range(0, len(new), 8192):
        part = new[at : at + 8192]
        for w, e in zip(part, tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False), strict=True):
            known[w] = array("I", e.ids).tobytes()
    if stems:
        marks = {m: array("I", tokenizer.encode(chr(m), add_special_tokens=False).ids).tobytes() for m in b".,"}
        for w, stem in stems.items():
            known[w] = known[stem] + marks[w[-1]]
    out = [b"".join(map(known.__getitem__, ws)) for ws in words]
    if len(known) > REMEMBERED:
        known.clear()
    return out


PIECES = "doc_id long, key long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """The pieces of every row: what the ids of each are is given by their CRC."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = texts.as_bytes(batch.column("text"))
            ids, keys = batch.column("doc_id").to_pylist(), batch.column("key").to_pylist()
            for a, b in texts.slices(whole):
                rows = []
                for doc_id, key, data in zip(ids[a:b], keys[a:b], encode(whole[a:b], path), strict=True):
                    data += np.array([END], "<u4").tobytes()
                    step = 4 * capacity
                    for k, at in enumerate(range(0, len(data), step)):
                        part = data[at : at + step]
                        rows.append((doc_id, key, k, at // 4, len(part) // 4, zlib.crc32(part)))
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                                                 ["doc_id", "key", "piece", "start", "length", "ids_crc32"])

    head = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.row_key().alias("key"), F.col("text").cast("string").alias("text"))
    return head.mapInArrow(run, PIECES)


class Group:
    """Pieces rounded up to one size: runs [length, count], longest first."""

    def __init__(self, runs: list[list[int]]) -> None:
        self.runs, self.size, self.left = runs, runs[0][0], sum(c for _, c in runs)

    def take(self, n: int) -> list[tuple[int, int]]:
        self.left -= n
        out = []
        while n:
            length, count = self.runs[0]
            used = min(n, count)
            out.append((length, used))
            n -= used
            if used == count:
                self.runs.pop(0)
            else:
                self.runs[0][1] -= used
        return out


def grouped(counts: dict[int, int], n_groups: int) -> list[Group]:
    total = sum(counts.values())
    size = max(1, -(-total // n_groups))
    groups, runs, room = [], [], size
    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            used = min(n, room)
            runs.append([length, used])
            n, room = n - used, room - used
            if not room:
                groups.append(Group(runs))
                runs, room = [], size
    return groups + ([Group(runs)] if runs else [])


def configuration(groups: list[Group], capacity: int) -> dict[int, int]:
    """How many of each group: one of the first, and of all the subset whose rounded sizes leave least free."""
    room = capacity - groups[0].size
    reach, steps = 1, []  # bit s: sum s can be reached
    for i, g in enumerate(groups):
        steps.append(reach)
        for _ in range(min(g.left - (i == 0), room // g.size)):
            reach |= (reach << g.size) & ((1 << (room + 1)) - 1)
    best = reach.bit_length() - 1
    used: dict[int, int] = {0: 1}
    for i in range(len(groups) - 1, -1, -1):
        while not steps[i] >> best & 1:
            best -= groups[i].size
            used[i] = used.get(i, 0) + 1
    return used


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = 128, small: int = 128) -> list[tuple[int, list[int]]]:
    """(number of sequences, their pieces' lengths): every piece of the histogram is in one."""
    large = {k: n for k, n in histogram.items() if k > small and k < capacity}
    bins = [(n, [k]) for k, n in histogram.items() if k == capacity]
    left = grouped(large, groups) if large else []
    while left:
        used = configuration(left, capacity)
        times = min(left[i].left // n for i, n in used.items())
        slots = [left[i].take(times) for i, n in used.items() for _ in range(n)]
        at = [0] * len(slots)
        rest = [s[0][1] for s in slots]
        while times:
            n = min(rest)
            bins.append((n, [s[k][0] for s, k in zip(slots, at, strict=True)]))
            times -= n
            for j, s in enumerate(slots):
                rest[j] -= n
                if not rest[j] and times:
                    at[j] += 1
                    rest[j] = s[at[j]][1]
        left = [g for g in left if g.left]
    by_room: dict[int, list[tuple[int, list[int]]]] = {}
    for n, lengths in bins:
        by_room.setdefault(capacity - sum(lengths), []).append((n, lengths))
    for length in sorted((k for k in histogram if k <= small), reverse=True):
        n = histogram[length]
        while n:
            room = min((r for r in by_room if r >= length), default=None)
            if room is None:
                per = min(n, capacity // length)
                many = n // per
                by_room.setdefault(capacity - per * length, []).append((many, [length] * per))
                n -= many * per
                continue
            count, lengths = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
            if count > n:
                by_room.setdefault(room, []).append((count - n, lengths))
                count = n
            by_room.setdefault(room - length, []).append((count, [*lengths, length]))
            n -= count
    return [entry for room in sorted(by_room) for entry in by_room[room]]


def places(entries: list[tuple[int, list[int]]]) -> pd.DataFrame:
    """The plan by length: the pieces ranked rank.. of a length go to sequences bin.., at offset."""
    rows, seen, first = [], {}, 0
    for count, lengths in entries:
        offset = 0
        for length in lengths:
            rank = seen.get(length, 0)
            rows.append((length, rank, first, offset))
            seen[length] = rank + count
            offset += length
        first += count
    return pd.DataFrame(rows, columns=["length", "rank", "bin", "offset"]).sort_values(["length", "rank"]).reset_index(drop=True)


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, groups: int = 128, small: int = 128) -> DataFrame:
    """Per piece: doc_id, key, piece, start, length, ids_crc32, sequence_id and offset."""
    cut = common.materialize(pieces(docs, capacity, path), "pack-pieces")
    histogram = {int(r["length"]): int(r["count"]) for r in cut.groupBy("length").count().collect()}  # at most capacity rows
    table = places(plan(histogram, capacity, groups, small))
    order = F.xxhash64("doc_id", "key", "piece")
    ranked = common.prefix_sum(cut, ["length"], [order, F.col("doc_id"), F.col("piece")], F.lit(1), common.unit(F.shiftrightunsigned(order, 32)),
                               max(1, sum(histogram.values()) // SLICE), "rank")
    held = docs.sparkSession.sparkContext.broadcast(table)  # its size depends on the capacity alone

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = held.value
        keys = t["length"].to_numpy(np.int64) * (1 << 48) + t["rank"].to_numpy(np.int64)
        for pdf in parts:
            at = np.searchsorted(keys, pdf["length"].to_numpy(np.int64) * (1 << 48) + pdf["rank"].to_numpy(np.int64), "right") - 1
            yield pdf.drop(columns="rank").assign(sequence_id=t["bin"].to_numpy()[at] + pdf["rank"].to_numpy() - t["rank"].to_numpy()[at],
                                                  offset=t["offset"].to_numpy()[at])

    return ranked.select("doc_id", "key", "piece", "start", "length", "ids_crc32", "rank").mapInPandas(place, PIECES + ", sequence_id long, offset long")


def op7_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents")).drop("key")
