"""External induced sorting of suffixes, with common-prefix values, for texts larger than memory.

A suffix is of type S if it is smaller than the next one, else L; an S suffix behind an L
suffix is a star.  Sorted stars induce the L suffixes in one ascending pass over the buckets
of first symbols, and these the S suffixes in a descending one.  Each bucket is a queue, and
the buckets in their order are the priority queue of the scan.  What a queue holds are tuples

    (position, common prefix with the tuple before it, block of symbols before the position)

so that a pass needs neither a type array nor ranks: the block tells the preceding symbol,
this and the own symbol tell the type, and only when a block is used up the next is read from
the text's file.  The common prefix of two suffixes that are pushed to a bucket is one more
than the least of those between their sources, which a table of minima gives for a batch.

Stars are sorted by recursion.  A first induction from unsorted stars sorts the substrings
from star to star, its common prefixes tell which are equal, and their numbers, two digits
each so that buckets stay few, are the text of the next level.  What comes back is the order of
the stars and how many whole substrings neighbours share; the rest is compared in the text.
Texts of up to ``BASE`` substrings are ranked in memory by doubling.

Memory holds ``ROOM`` tuples of all queues, a batch in work and the base level; queues beyond
that, texts, star positions and names are files.  Suffixes come in descending order and
common prefixes are cut at a depth: beyond it the order of suffixes is left open.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np

ROOM = 1 << 21  # tuples that queues hold in memory, 16 bytes each
BATCH = 1 << 16  # suffixes worked on at once
BASE = 1 << 21  # substrings that are ranked in memory
SMALL = 1 << 22  # bytes up to which arrays stay in memory
EQUAL = np.int16(np.iinfo(np.int16).max)  # common prefix of substrings that are equal to their ends

Tuples = tuple[np.ndarray, np.ndarray, np.ndarray]


class Scratch:
    """The files of one sort and the memory that its queues share."""

    def __init__(self, folder: str) -> None:
        self.folder, self.held, self.queues = folder, 0, {}

    def path(self) -> str:
        return os.path.join(self.folder, uuid.uuid4().hex)

    def array(self, n: int, dtype) -> np.ndarray:
        """Zeros, on disk if they are many."""
        if n * np.dtype(dtype).itemsize <= SMALL:
            return np.zeros(n, dtype)
        return np.memmap(self.path(), dtype=dtype, mode="w+", shape=(n,))

    def grown(self, by: int) -> None:
        self.held += by
        if self.held > ROOM:
            for q in sorted(self.queues.values(), key=lambda q: -q.size):
                if self.held <= ROOM // 2:
                    break
                self.held -= q.spill()


class Queue:
    """Tuples, first in first out, or backwards; the older part is on disk.

    They are rows of two words: position and common prefix in one, the block in the other."""

    def __init__(self, scratch: Scratch) -> None:
        self.scratch, self.parts, self.size, self.files = scratch, [], 0, []
        scratch.queues[id(self)] = self

    def push(self, rows: np.ndarray) -> None:
        """Whoever pushes tells ``scratch`` by how much its queues have grown."""
        self.parts.append(rows)
        self.size += len(rows)

    def spill(self) -> int:
        """Move what is in memory to disk; the number of tuples."""
        if not (n := self.size):
            return 0
        self.files.append(f"{self.scratch.path()}.npy")
        np.save(self.files[-1], np.concatenate(self.parts))
        self.parts, self.size = [], 0
        return n

    def _chunk(self, last: bool) -> np.ndarray | None:
        """The oldest chunk, or the newest."""
        if self.files and not (last and self.parts):
            path = self.files.pop(-1 if last else 0)
            out = np.load(path)
            os.remove(path)
            return out
        if not self.parts:
            return None
        out = np.concatenate(self.parts)
        self.scratch.held -= self.size
        self.parts, self.size = [], 0
        return out

    def take(self) -> Iterator[Tuples]:
        """Batches in order; those that are pushed meanwhile come too."""
        while (chunk := self._chunk(False)) is not None:
            for lo in range(0, len(chunk), BATCH):
                yield unpacked(chunk[lo : lo + BATCH])
        self.scratch.queues.pop(id(self), None)

    def back(self, first: int) -> Iterator[Tuples]:
        """Batches from the newest to the oldest; common prefixes are with the tuple that comes before in this order, ``first`` is that of the newest."""
        carry = first
        while (chunk := self._chunk(True)) is not None:
            for hi in range(len(chunk), 0, -BATCH):
                pos, lcp, block = unpacked(chunk[max(0, hi - BATCH) : hi][::-1])
                shifted = np.empty_like(lcp)
                shifted[0], shifted[1:] = carry, lcp[:-1]
                carry = lcp[-1]
                yield pos, shifted, block
        self.scratch.queues.pop(id(self), None)


def packed(pos: np.ndarray, lcp: np.ndarray, block: np.ndarray) -> np.ndarray:
    out = np.empty((len(pos), 2), np.int64)
    out[:, 0] = (pos << 16) | lcp
    out[:, 1] = block.view(np.int64)
    return out


def unpacked(rows: np.ndarray) -> Tuples:
    first = rows[:, 0].copy()
    return first >> 16, (first & 0xFFFF).astype(np.int16), rows[:, 1].copy().view(np.uint64)


class Text:
    """Symbols in an array or a map of a file, read in blocks of 64 bits.  The last symbol is 0, and no two 0 stand side by side."""

    def __init__(self, symbols: np.ndarray, n: int, sigma: int) -> None:
        """``symbols`` is padded with zeros to whole blocks, two more than ``n`` symbols need."""
        self.symbols, self.n, self.sigma = symbols, n, sigma
        self.blocks = symbols.view(np.uint64)
        self.per = 8 // symbols.itemsize
        self.bits = np.uint64(8 * symbols.itemsize)
        self.mask = np.uint64((1 << (8 * symbols.itemsize)) - 1)

    @staticmethod
    def padded(n: int, itemsize: int) -> int:
        return (-(-n * itemsize // 8) + 2) * 8 // itemsize

    def preceding(self, pos: np.ndarray) -> np.ndarray:
        """The block with the symbol before each position."""
        return self.blocks[np.maximum(pos - 1, 0) // self.per]

    def before(self, pos: np.ndarray, block: np.ndarray) -> np.ndarray:
        """The symbol before each position, -1 at the start."""
        at = np.maximum(pos - 1, 0)
        symbol = ((block >> ((at % self.per).astype(np.uint64) * self.bits)) & self.mask).astype(np.int32)
        return np.where(pos > 0, symbol, -1)

    def run(self, pos: int, most: int) -> int:
        """How often the symbol at ``pos`` stands there in a row."""
        part = np.asarray(self.symbols[pos : min(pos + most, self.n)])
        other = np.flatnonzero(part != part[0])
        return int(other[0]) if len(other) else len(part)

    def _at(self, pos: np.ndarray) -> np.ndarray:
        """64 bits of symbols from each position on."""
        q, r = pos // self.per, (pos % self.per).astype(np.uint64) * self.bits
        low = self.blocks[q] >> r
        high = self.blocks[q + 1] << ((np.uint64(64) - r) & np.uint64(63))
        return np.where(r > 0, low | high, low)

    def common(self, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
        """Lengths of the common prefixes of the suffixes at a and b, up to ``most``."""
        out = np.zeros(len(a), np.int64)
        left = np.arange(len(a))
        while len(left):
            x, y = a[left] + out[left], b[left] + out[left]
            inside = np.maximum(x, y) < self.n
            left, x, y = left[inside], x[inside], y[inside]
            diff = self._at(x) ^ self._at(y)
            lowest = (diff & (~diff + np.uint64(1))).astype(np.float64)
            same = np.where(diff == 0, self.per, np.log2(np.maximum(lowest, 1.0)).astype(np.int64) // int(self.bits))
            out[left] = np.minimum(out[left] + same, most)
            left = left[(diff == 0) & (out[left] < most)]
        return out


def _stars(text: Text, scratch: Scratch) -> np.ndarray:
    """The stars' positions in ascending order."""
    parts: list[np.ndarray | str] = []
    total, kind_after, symbol_after = 0, False, 0  # the last suffix is of type L
    step = 4 * BATCH
    for hi in range(text.n, 0, -step):
        lo = max(0, hi - step)
        part = np.asarray(text.symbols[lo:hi]).astype(np.int32)
        following = np.append(part[1:], symbol_after)
        rising, level = part < following, part == following
        if hi == text.n:
            rising[-1] = level[-1] = False
        # equal symbols take the type of the next that differ
        settled = np.where(level, len(part), np.arange(len(part)))
        settled = np.minimum.accumulate(settled[::-1])[::-1]
        small = np.append(rising, kind_after)[settled]
        both = np.append(small, kind_after)
        found = np.flatnonzero(both[1:] & ~both[:-1]) + 1 + lo
        found = found[found < text.n]
        total += len(found)
        parts.append(found)
        if total * 8 > SMALL:
            for i, x in enumerate(parts):
                if not isinstance(x, str):
                    parts[i] = f"{scratch.path()}.npy"
                    np.save(parts[i], x)
        kind_after, symbol_after = bool(small[0]), int(part[0])
    out, at = scratch.array(total, np.int64), 0
    for x in reversed(parts):
        got = np.load(x) if isinstance(x, str) else x
        out[at : at + len(got)] = got
        at += len(got)
        if isinstance(x, str):
            os.remove(x)
    return out


class _Scan:
    """Pushes what a pass over sorted suffixes induces, with its common prefixes."""

    def __init__(self, text: Text, scratch: Scratch, cap: int) -> None:
        self.text, self.scratch, self.cap = text, scratch, cap
        self.queues: dict[int, Queue] = {}
        # the least common prefix in the scan since the last push to each bucket; -1: none was yet
        self.since = np.full(text.sigma, -1, np.int16)

    def push(self, pos: np.ndarray, lcp: np.ndarray, block: np.ndarray, to: np.ndarray) -> None:
        """Of a batch of the scan, push the suffixes before those of which ``to`` is a bucket and not -1."""
        hit = np.flatnonzero(to >= 0)
        m = len(lcp)
        tail = np.minimum.accumulate(lcp[::-1])[::-1]
        if not len(hit):
            np.minimum(self.since, tail[0], out=self.since)
            return
        chars = to[hit].astype(np.uint16)
        order = np.argsort(chars, kind="stable")
        at, chars = hit[order], chars[order]
        fresh = np.append(True, chars[1:] != chars[:-1])
        # least common prefix from behind the last push of the bucket, by a table of minima of 2**k neighbours
        start = np.where(fresh, 0, np.append(0, at[:-1] + 1))
        span = at - start + 1
        level = np.log2(span).astype(np.int64)
        table = np.empty((int(level.max()) + 1, m), np.int16)
        table[0] = lcp
        for k in range(1, len(table)):
            w = 1 << (k - 1)
            table[k] = table[k - 1]
            np.minimum(table[k - 1, :-w], table[k - 1, w:], out=table[k, :-w])
        least = np.minimum(table[level, start], table[level, at - (1 << level) + 1])
        firsts = np.flatnonzero(fresh)
        ends = np.append(firsts[1:], len(at))
        buckets = chars[firsts]
        least[firsts] = np.minimum(least[firsts], self.since[buckets])
        value = np.where(least == EQUAL, EQUAL, np.minimum(least + np.int16(1), self.cap)).astype(np.int16)
        np.minimum(self.since, tail[0], out=self.since)
        self.since[buckets] = np.append(tail, EQUAL)[at[ends - 1] + 1]
        there = pos[at] - 1
        blocks = block[at]
        used = np.flatnonzero((there % self.text.per == 0) & (there > 0))
        blocks[used] = self.text.preceding(there[used])
        rows, queues = packed(there, value, blocks), self.queues
        for c, lo, hi in zip(buckets.tolist(), firsts.tolist(), ends.tolist(), strict=True):
            if c not in queues:
                queues[c] = Queue(self.scratch)
            queues[c].push(rows[lo:hi].copy())  # a view would hold the whole batch
        self.scratch.grown(len(rows))


def induce(text: Text, stars: dict[int, Queue], scratch: Scratch, cap: int, exact: bool) -> Iterator[tuple[int, bool, np.ndarray, np.ndarray, np.ndarray]]:
    """The suffixes in descending order, from the stars in descending order: (first symbol, type S, positions, common prefixes with the suffix that came before, symbols before).

    With ``exact`` the stars are sorted; else those of one symbol count as equal, and common prefixes only tell which substrings are."""
    def junction(a: int, b: int) -> int:
        """Common prefix of an L and an S suffix of one bucket: their shorter run."""
        return min(text.run(a, cap), text.run(b, cap), cap) if exact else 0

    up = _Scan(text, scratch, cap)
    end = np.array([text.n - 1])
    up.queues[0] = Queue(scratch)
    up.queues[0].push(packed(end, np.zeros(1, np.int16), text.preceding(end)))
    scratch.grown(1)
    kept: dict[int, Queue] = {}
    for c in range(text.sigma):
        largest = -1
        if c in up.queues:
            kept[c] = Queue(scratch)
            for pos, lcp, block in up.queues[c].take():
                kept[c].push(packed(pos, lcp, block))
                scratch.grown(len(pos))
                to = text.before(pos, block)
                up.push(pos, lcp, block, np.where(to >= c, to, -1))
                largest = int(pos[-1])
            del up.queues[c]
        if c in stars:
            first = True
            for pos, lcp, block in stars[c].back(0):
                if first:
                    lcp = lcp.copy()
                    lcp[0] = junction(largest, int(pos[0])) if largest >= 0 else 0
                    first = False
                to = text.before(pos, block)
                up.push(pos, lcp, block, np.where(to > c, to, -1))
            del stars[c]
    del up
    down = _Scan(text, scratch, cap)
    for c in range(text.sigma - 1, -1, -1):
        smallest = -1
        if c in down.queues:
            for pos, lcp, block in down.queues[c].take():
                to = text.before(pos, block)
                yield c, True, pos, lcp, to
                down.push(pos, lcp, block, np.where(to <= c, to, -1))
                smallest = int(pos[-1])
            del down.queues[c]
        if c in kept:
            # the largest L suffix is the newest: it comes first, behind the smallest S suffix
            queue, first = kept.pop(c), True
            for pos, lcp, block in queue.back(0):
                if first:
                    lcp = lcp.copy()
                    lcp[0] = junction(int(pos[0]), smallest) if smallest >= 0 else 0
                    first = False
                to = text.before(pos, block)
                yield c, False, pos, lcp, to
                down.push(pos, lcp, block, np.where(to < c, to, -1))


def _ranked(names: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of ``names`` in descending order, in memory, and how many names each shares with the one before, up to ``depth`` or more."""
    n = len(names)
    levels = [np.append(names, -1).astype(np.int32)]
    span = 1
    while span < depth and int(levels[-1].max()) + 1 < n:
        now = levels[-1]
        after = np.full(n, -1, np.int64)
        after[: n - span] = now[span:n] if span < n else after[:0]
        key = now[:n].astype(np.int64) * (n + 1) + after + 1
        order = np.argsort(key, kind="stable")
        ranks = np.full(n + 1, -1, np.int32)
        key = key[order]
        ranks[order] = np.cumsum(np.append(False, key[1:] != key[:-1]))
        levels.append(ranks)
        span *= 2
    order = np.argsort(levels[-1][:n], kind="stable")[::-1]
    a, b = order[:-1].copy(), order[1:].copy()
    shared = np.zeros(n, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        same = (levels[k][a] == levels[k][b]) & (a < n) & (b < n)
        shared[1:] += same * (1 << k)
        a, b = np.minimum(a + same * (1 << k), n), np.minimum(b + same * (1 << k), n)
    return order, shared


def suffixes(text: Text, cap: int, scratch: Scratch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes in descending order, as far as ``cap`` symbols tell: batches of positions and of their common prefixes with the suffix before."""
    stars = _stars(text, scratch)
    m = len(stars)
    queues: dict[int, Queue] = {}

    def push(pos: np.ndarray, lcp: np.ndarray) -> None:
        symbols = np.asarray(text.symbols[pos])
        order = np.argsort(symbols, kind="stable")
        rows, symbols = packed(pos, lcp, text.preceding(pos))[order], symbols[order]
        cuts = np.append(np.flatnonzero(np.diff(symbols.astype(np.int64))) + 1, len(order))
        lo = 0
        for hi in cuts.tolist():
            if (c := int(symbols[lo])) not in queues:
                queues[c] = Queue(scratch)
            queues[c].push(rows[lo:hi].copy())
            lo = hi
        scratch.grown(len(rows))

    if m > 1:
        for lo in range(0, m, BATCH):
            pos = np.asarray(stars[lo : lo + BATCH])
            push(pos, np.full(len(pos), EQUAL, np.int16))
        # names by the order of substrings, the largest first; stars are two places apart at least
        half, name = scratch.array(text.n // 2 + 1, np.int32 if text.n < 1 << 31 else np.int64), 0
        for c, small, pos, lcp, to in induce(text, queues, scratch, EQUAL - 1, False):
            if small:
                # what stands between two stars of a bucket tells whether they are equal
                star = np.flatnonzero(to > c)
                fresh = np.cumsum(lcp != EQUAL)
                half[pos[star] // 2] = name + fresh[star]
                name += int(fresh[-1])
        if m <= BASE:
            order, shared = _ranked(_dense(half[stars // 2], name), cap // 2 + 1)
            found = iter([(order, shared)])
        else:
            found = _recursed(text, stars, half, name, cap, scratch)
        last = -1
        for order, shared in found:
            for lo in range(0, len(order), BATCH):
                a, h = order[lo : lo + BATCH], shared[lo : lo + BATCH]
                before = np.append(last, a[:-1])
                known = before >= 0
                lcp = np.zeros(len(a), np.int64)
                # whole substrings that both share, then what they have in common of the next
                x, y, h = a[known], before[known], h[known]
                inside = np.maximum(x, y) + h < m
                far = np.minimum(np.maximum(x, y) + h, m - 1) - np.maximum(x, y)
                whole = np.asarray(stars[x + far]) - np.asarray(stars[x])
                rest = np.zeros(len(x), np.int64)
                at = np.flatnonzero(inside & (whole < cap))
                rest[at] = text.common(np.asarray(stars[x + far])[at], np.asarray(stars[y + far])[at], cap)
                lcp[known] = whole + rest
                push(np.asarray(stars[a]), np.minimum(lcp, cap).astype(np.int16))
                last = int(a[-1])
    elif m:
        push(np.asarray(stars), np.zeros(1, np.int16))
    for _, _, pos, lcp, _ in induce(text, queues, scratch, cap, True):
        yield pos, lcp


def _dense(names: np.ndarray, most: int) -> np.ndarray:
    """Descending numbers with gaps as ascending ones without, in memory."""
    return np.unique(most - names.astype(np.int64), return_inverse=True)[1].astype(np.int32)


def _recursed(text: Text, stars: np.ndarray, half: np.ndarray, most: int, cap: int, scratch: Scratch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """As ``_ranked``, by sorting the suffixes of the names' digits on disk."""
    m = len(stars)
    base = int(np.ceil(np.sqrt(most + 1)))
    n = 2 * m + 1
    digits = scratch.array(Text.padded(n, 2), np.uint16)
    for lo in range(0, m, BATCH):
        # a star's own name, counted from the smallest; digits from 1 on, as 0 ends the text
        names = most - half[np.asarray(stars[lo : lo + BATCH]) // 2].astype(np.int64)
        digits[2 * lo : 2 * (lo + len(names)) : 2] = names // base + 1
        digits[2 * lo + 1 : 2 * (lo + len(names)) : 2] = names % base + 1
    least = EQUAL
    for pos, lcp in suffixes(Text(digits, n, base + 2), min(2 * (cap // 2 + 1), EQUAL - 1), scratch):
        whole = np.flatnonzero((pos % 2 == 0) & (pos < 2 * m))
        if not len(whole):
            least = min(least, lcp.min())
            continue
        cut = np.minimum.reduceat(lcp[: whole[-1] + 1], np.append(0, whole[:-1] + 1))
        cut[0] = min(cut[0], least)
        rest = lcp[whole[-1] + 1 :]
        least = rest.min() if len(rest) else EQUAL
        yield pos[whole] // 2, cut.astype(np.int64) // 2
