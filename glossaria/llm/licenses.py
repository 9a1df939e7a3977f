"""License scans: exact set-similarity join of text blocks with license templates.

A block is a run of consecutive words, wherever lines end, of SPAN times the words of the template at most. A template's tokens are ordered by their frequency in the whole corpus, rarest first.
For containment of at least THRESHOLD a text must hold ``need`` of a template's n tokens, hence one of its first
n - need + 1 (prefix filter); it must have at least ``need`` tokens that any template has (length filter); and from the
first common token on, both orders must still have enough tokens left (positional filter). Of a text that passes, every
longest block is counted exactly for the template, sliding from one of its tokens to the next; the filters drop no block that
qualifies.

Beside that, places of fixed phrases are found in the words of the whole text.

Templates are few, a parameter: they go to every task, and the join runs there, text by text.

Defined results: null and empty texts have no words; a very long text is judged as a whole, in time that grows with its words times
the templates that pass its filters; of tokens that tie in frequency the first by name counts as rarer; rows that repeat a doc_id are
each judged by their text; other columns are ignored, and an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossaria.llm.common import ascii_words, map_batches, record, sliced

THRESHOLD = 0.9
SPAN = 2

#: Phrases whose places are reported, and their labels.
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

#: License notices in common use, and their labels.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "Licensed under the Apache License, Version 2.0."),
    ("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at apache org licenses"),
    ("gpl-3", "licensed under the GNU General Public License, version 3."),
    ("gpl-2", "licensed under the GNU General Public License, version 2."),
    ("gpl", "free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("lgpl", "licensed under the GNU Lesser General Public License"),
    ("agpl", "licensed under the GNU Affero General Public License"),
    ("mpl-2", "subject to the terms of the Mozilla Public License, v. 2.0."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc0", "dedicated to the public domain under CC0 1.0 Universal"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("proprietary", "All rights reserved. No part of this publication may be reproduced"),
]

_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])
_COUNT = pa.schema([("token", pa.binary()), ("n", pa.int64())])


def token_order(documents: DataFrame, templates: list[tuple[str, str]]) -> dict[bytes, int]:
    """Places of the templates' tokens in the order of their frequency in all documents, rarest first."""
    tokens = {w for _, t in templates for w in ascii_words(t.encode())}

    def make() -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: Counter = Counter()
            for _, texts in sliced(batches, "text"):
                for t in texts:
                    seen.update(filter(tokens.__contains__, ascii_words(t)))
            yield record(_COUNT, token=list(seen), n=list(seen.values()))

        return run

    counts = map_batches(documents.select("text"), make, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))
    found = {bytes(r["token"]): r["n"] for r in counts.collect()}  # at most one row for each token of the templates
    return {t: k for k, t in enumerate(sorted(tokens, key=lambda t: (found.get(t, 0), t)))}


class Matcher:
    """Finds the templates that a text or one of its blocks contains to THRESHOLD or more."""

    def __init__(self, templates: list[tuple[str, str]], order: dict[bytes, int], threshold: float) -> None:
        self.order = order
        self.items: list[tuple[str, list[int], frozenset[int], int, int]] = []
        self.prefix: dict[int, list[tuple[int, int]]] = {}
        for label, text in templates:
            words = ascii_words(text.encode())
            ids = sorted({order[w] for w in words})
            need = math.ceil(threshold * len(ids) - 1e-9)
            for place, x in enumerate(ids[: len(ids) - need + 1]):
                self.prefix.setdefault(x, []).append((len(self.items), place))
            self.items.append((label, ids, frozenset(ids), need, SPAN * len(words)))
        self.starts = frozenset(t for t, k in order.items() if k in self.prefix)

    def whole(self, words: set[bytes]) -> list[int]:
        """Places of the templates that all the words together contain."""
        order = self.order
        ids = sorted(order[w] for w in words if w in order)
        have, out, tried = frozenset(ids), [], set()
        for at, x in enumerate(ids):
            for k, place in self.prefix.get(x, ()):
                if k in tried:
                    continue
                tried.add(k)
                _, all_ids, as_set, need, _ = self.items[k]
                if len(ids) >= need and min(len(all_ids) - place, len(ids) - at) >= need and len(as_set & have) >= need:
                    out.append(k)
        return out

    def blocks(self, held: list[tuple[int, int]], k: int) -> tuple[str, float] | None:
        """Label and highest containment of a template in a block, if that is enough. held: places of words that any template
        has, and their numbers."""
        label, ids, as_set, need, most = self.items[k]
        mine = [h for h in held if h[1] in as_set]
        seen: dict[int, int] = {}
        best = first = 0
        for place, x in mine:
            seen[x] = seen.get(x, 0) + 1
            while place - mine[first][0] >= most:
                y = mine[first][1]
                seen[y] -= 1
                if not seen[y]:
                    del seen[y]
                first += 1
            best = max(best, len(seen))
        return (label, best / len(ids)) if best >= need else None


def phrase_places(words: list[bytes], phrases: list[tuple[list[bytes], str]]) -> list[tuple[int, str]]:
    out = []
    for phrase, label in phrases:
        n, at = len(phrase), -1
        while True:
            try:
                at = words.index(phrase[0], at + 1)
            except ValueError:
                break
            if words[at : at + n] == phrase:
                out.append((at, label))
    return out


def scan_licenses(documents: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: list[tuple[str, str]] = PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of documents: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score: the highest containment of a template (1.0 for a phrase), 0 without any label.
    """
    order = token_order(documents, templates)
    fixed = [([w.encode() for w in p.split()], label) for p, label in phrases]

    def make() -> Callable:
        match = Matcher(templates, order, threshold)
        wanted = match.starts | {p[-1] for p, _ in fixed}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, texts in sliced(batches, "text"):
                rows = []
                for t in texts:
                    words = ascii_words(t)
                    if wanted.isdisjoint(words):
                        rows.append((len(words), 0, None, None, "", "", 0.0))
                        continue
                    places = phrase_places(words, fixed)
                    base = {label for _, label in places}
                    labels, score = set(base), 1.0 if base else 0.0
                    if whole := match.whole(set(words)):
                        held = [(i, order[w]) for i, w in enumerate(words) if w in order]
                        for label, s in filter(None, (match.blocks(held, k) for k in whole)):
                            labels.add(label)
                            score = max(score, s)
                    at = [p for p, _ in places]
                    rows.append((len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score))
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
                yield record(_OUT, doc_id=part.column("doc_id"), n_words=list(cols[0]), n_base=list(cols[1]), first_word=list(cols[2]), last_word=list(cols[3]), base_labels=list(cols[4]), labels=list(cols[5]), score=list(cols[6]))

        return run

    return map_batches(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
