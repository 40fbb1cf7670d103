"""Licence scanning with a generalised suffix automaton (operator 8).

The automaton holds all token runs of all licence templates.  A document's words are
streamed through it; at each word it knows the longest run ending there that some
template holds (the matching statistics).  Runs of ``least`` tokens or more that cannot
be extended are placed in the templates they come from and chained, in order and with
small gaps, into spans; a template of which a chain covers ``cover`` or more gives its
label.  Base phrases are templates too, and each of their places counts.

Texts are not shuffled.  Defined results: null and empty texts have no words and no
labels; repeated rows and null ids are scanned row by row; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, texts

# The base phrases and their labels.
BASE = (("mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
# Notices by which public licences are recognised.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("public-domain", "this work has been released into the public domain"),
    ("proprietary", "all rights reserved no part of this publication may be reproduced"),
)

#: Bytes to what they become: capitals lower, what is no part of a word a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def tokens(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class Automaton:
    """A suffix automaton of several token sequences, each state knowing where its runs end."""

    def __init__(self, sequences: list[list[int]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for k, seq in enumerate(sequences):
            last = 0
            for i, t in enumerate(seq):
                last = self._extend(last, t)
                self.ends[last].add((k, i))
        # a run ends wherever a longer run that it is a suffix of ends
        for v in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            if self.link[v] > 0:
                self.ends[self.link[v]] |= self.ends[v]

    def _state(self, length: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        self.ends.append(set())
        return len(self.next) - 1

    def _extend(self, last: int, t: int) -> int:
        if t in self.next[last]:
            q = self.next[last][t]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, t)
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and t not in self.next[p]:
            self.next[p][t] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][t]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, t)
        return new

    def _split(self, p: int, q: int, t: int) -> int:
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(t) == q:
            self.next[p][t] = copy
            p = self.link[p]
        return copy


class Scanner:
    def __init__(self, base=BASE, templates=TEMPLATES, least: int = 4, cover: float = 0.8, gap: int = 4) -> None:
        self.labels = [label for _, label in base] + [label for label, _ in templates]
        words = [p.encode().split() for p, _ in base] + [t.encode().split() for _, t in templates]
        self.vocabulary: dict[bytes, int] = {}
        sequences = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws] for ws in words]
        self.sizes = [len(s) for s in sequences]
        self.auto = Automaton(sequences)
        self.least, self.cover, self.gap, self.n_base = least, cover, gap, len(base)
        # base phrases and whole templates that a state's runs end with: those of its own and of its shorter suffixes
        self.closes: list[list[tuple[int, int]]] = [[] for _ in self.auto.link]
        for k in range(len(sequences)):
            v = 0
            for t in sequences[k]:
                v = self.auto.next[v][t]
            self.closes[v].append((k, self.sizes[k]))
        for v in sorted(range(1, len(self.auto.link)), key=self.auto.length.__getitem__):
            self.closes[v] += self.closes[self.auto.link[v]]
        self.shortest = min([least, *self.sizes[: len(base)]])

    def stream(self, ids: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(place, state, matched length) at each word of a stretch of known words that is long enough."""
        known = np.flatnonzero(np.diff(np.concatenate(([False], ids >= 0, [False])).astype(np.int8)))
        following, link, length = self.auto.next, self.auto.link, self.auto.length
        for a, b in zip(known[::2].tolist(), known[1::2].tolist(), strict=True):
            if b - a < self.shortest:
                continue
            v = n = 0
            for i, t in enumerate(ids[a:b].tolist(), a):
                while v and t not in following[v]:
                    v = link[v]
                    n = length[v]
                if t in following[v]:
                    v, n = following[v][t], n + 1
                yield i, v, n
            yield -1, 0, 0

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], dict[int, float], list[tuple[int, int, int]]]:
        """Base places (start, phrase); of each template the share that its best chain covers; spans (first, last, template)."""
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))
        places: list[tuple[int, int]] = []
        runs: list[tuple[int, int, int]] = []  # start, end, state of matches that cannot be extended
        whole: list[tuple[int, int, int]] = []  # start, end, template
        before = (-1, 0, 0)
        for i, v, n in self.stream(ids):
            for k, size in self.closes[v]:
                if n >= size and k < self.n_base:
                    places.append((i - size + 1, k))
                elif n >= size:  # also where it is part of a longer run of another template
                    whole.append((i - size + 1, i, k))
            if before[2] >= self.least and n <= before[2]:
                runs.append((before[0] - before[2] + 1, before[0], before[1]))
            before = (i, v, n)
        shares, spans = self.chain(runs)
        shares |= {k: 1.0 for _, _, k in whole}
        return places, shares, [*spans, *(x for x in whole if x not in set(spans))]

    def chain(self, runs: list[tuple[int, int, int]]) -> tuple[dict[int, float], list[tuple[int, int, int]]]:
        by_template: dict[int, list[tuple[int, int, int]]] = {}
        for start, end, v in runs:
            for k, e in self.auto.ends[v]:
                by_template.setdefault(k, []).append((start, end, e - (end - start)))
        shares: dict[int, float] = {}
        spans = []
        for k, found in by_template.items():
            found.sort()
            # best[j]: most template tokens covered by a chain ending in match j, and the chain's start
            best: list[tuple[int, int]] = []
            low = 0
            for j, (start, end, at) in enumerate(found):
                top = (end - start + 1, start)
                while found[low][0] < start - self.gap - 2 * self.sizes[k]:
                    low += 1
                for m in range(low, j):
                    s2, e2, at2 = found[m]
                    if at2 < at and start - e2 <= self.gap + 1:
                        fresh = at + (end - start) - max(at, at2 + (e2 - s2) + 1) + 1
                        if fresh > 0 and best[m][0] + fresh > top[0]:
                            top = (best[m][0] + fresh, best[m][1])
                best.append(top)
                share = top[0] / self.sizes[k]
                shares[k] = max(shares.get(k, 0.0), share)
                if share >= self.cover:
                    spans.append((top[1], end, k))
        return shares, spans


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, " \
         "spans array<struct<first:long,last:long,label:string>>"


def scan(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """Per row the base places' figures, the labels, the best coverage and the covered spans."""
    scanner = scanner or Scanner()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts.as_bytes(batch.column("text")), strict=True):
                words = tokens(text or b"")
                places, shares, spans = scanner.scan(words)
                base = {scanner.labels[k] for _, k in places}
                more = {scanner.labels[k] for k, share in shares.items() if share >= scanner.cover}
                starts = [s for s, _ in places]
                rows.append((doc_id, len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
                             ",".join(sorted(base | more)), 1.0 if base else min(1.0, max(shares.values(), default=0.0)),
                             [{"first": a, "last": b, "label": scanner.labels[k]} for a, b, k in spans]))
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in range(9)]
            span = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("label", pa.string())]))
            kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), span]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)],
                                             ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def op8_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents")).drop("spans")
