"""License notices by an exact set-similarity join with templates.

A block is a window of 48 words that starts at a template's word; a window that
starts elsewhere holds no more of them than the next one that does, so every
place of a text is tested.  A block matches a template if it holds enough of
the template's distinct words: four fifths of them, or all where the template
has fewer than ten, as few common words stand together by chance.  Template words
are ordered by their frequency in the corpus, rarest first.  A matching block
must then hold one of a template's first words (prefix filter), be long enough
(length filter), and have enough words left from its first common one on
(positional filter); what passes is verified exactly.

Beside the join, places where the words of a base phrase stand consecutively
are counted; their labels always stand.

Results for odd input: a null or empty text has no words, no places, empty
labels and score 0; a null ``doc_id`` stays null; repeated rows give repeated
results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, word_hash, word_runs

#: Phrases and the labels that they give.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Opening words of public license notices, and their labels.
TEMPLATES = [
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]

BLOCK = 48


class Templates:
    """Distinct template words as hashes in global order, and overlaps needed."""

    def __init__(self, templates: list[tuple[str, str]], share: float, short: int):
        self.labels = [label for label, _ in templates]
        self.sets = [sorted({word_hash(w) for w in text.split()}) for _, text in templates]
        # in integers, so that the bound is exact
        per_mille = round(share * 1000)
        self.need = [len(s) if len(s) < short else -(-len(s) * per_mille // 1000) for s in self.sets]
        self.words = np.array(sorted(set().union(*self.sets)), np.uint64)

    def order(self, counts: dict[int, int]) -> None:
        """Number the words by corpus frequency, the rarest first."""
        words = self.words.tolist()
        by = sorted(words, key=lambda w: (counts.get(w, 0), w))
        number = {w: i for i, w in enumerate(by)}
        self.number = np.array([number[w] for w in words])
        self.ranked = [sorted(number[w] for w in s) for s in self.sets]
        self.prefix: dict[int, list[int]] = {}
        for t, (ranked, need) in enumerate(zip(self.ranked, self.need, strict=True)):
            for word in ranked[: len(ranked) - need + 1]:
                self.prefix.setdefault(word, []).append(t)
        self.in_prefix = np.zeros(len(words), bool)
        self.in_prefix[list(self.prefix)] = True
        self.members = [frozenset(r) for r in self.ranked]

    def hits(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of template words, and their numbers."""
        at = np.searchsorted(self.words, hashes)
        at[at == len(self.words)] = 0
        found = np.flatnonzero(self.words[at] == hashes)
        return found, at[found]

    def matches(self, held: set[int], n_words: int) -> Iterator[tuple[int, float]]:
        """(template, containment) for a block's template words and its length."""
        ordered = sorted(held)
        tried = set()
        for j, word in enumerate(ordered):
            for t in self.prefix.get(word, ()):
                if t in tried:
                    continue
                tried.add(t)  # the rarest common word: later ones can't add
                need = self.need[t]
                if n_words < need or len(ordered) - j < need:
                    continue
                common = len(held & self.members[t])
                if common >= need:
                    yield t, common / len(self.members[t])


def _counter(words: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(words), np.int64)
        for batch in batches:
            for _, part in word_runs(batch.column("text")):
                hashes = part.hashes()
                at = np.searchsorted(words, hashes)
                at[at == len(words)] = 0
                total += np.bincount(at[words[at] == hashes], minlength=len(words))
        yield pa.record_batch([pa.array(words.astype(np.int64)), pa.array(total)], names=["word", "n"])

    return run


def frequencies(docs: DataFrame, words: np.ndarray) -> dict[int, int]:
    """How often the template words stand in the corpus; a few hundred rows."""
    counted = map_batches(docs.select(F.col("text").cast("string").alias("text")), _counter(words), "word long, n long")
    rows = counted.groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {r["word"] & 0xFFFFFFFFFFFFFFFF: r["n"] for r in rows}


_MATCH = "array<struct<label: string, first_word: long, n_words: long, containment: double>>"
_OUT = f"doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches {_MATCH}"


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, share: float = 0.8, short: int = 10) -> DataFrame:
    """One row per row of ``docs``: places, labels, score and matching blocks."""
    known = Templates(templates, share, short)
    known.order(frequencies(docs, known.words))
    bases = [([word_hash(w) for w in p.split()], label) for p, label in phrases.items()]
    match = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("containment", pa.float64())]))

    def blocks(at: np.ndarray, numbers: np.ndarray, n: int) -> list[dict]:
        """Matches in one text, given its template words."""
        rare = at[known.in_prefix[numbers]]
        # windows that hold one of the prefixes' words
        ends = np.searchsorted(at, at + BLOCK)
        holding = np.searchsorted(rare, at + BLOCK) > np.searchsorted(rare, at)
        found = []
        for a in np.flatnonzero(holding).tolist():
            s, b = int(at[a]), int(ends[a])
            size = min(BLOCK, n - s)
            for t, part in known.matches(set(numbers[a:b].tolist()), size):
                found.append({"label": known.labels[t], "first_word": s, "n_words": size, "containment": part})
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").cast(pa.int64())
            for low, words in word_runs(batch.column("text")):
                n_docs = len(words.first) - 1
                n_words = np.diff(words.first)
                hashes = words.hashes()
                # base places
                places, labels = [], []
                for phrase, label in bases:
                    at = np.flatnonzero(hashes == np.uint64(phrase[0]))
                    at = at[at + len(phrase) <= len(hashes)]
                    for k, h in enumerate(phrase[1:], 1):
                        at = at[hashes[at + k] == np.uint64(h)]
                    text = np.searchsorted(words.first, at, side="right") - 1
                    keep = at + len(phrase) <= words.first[text + 1]
                    places.append(np.stack([text[keep], at[keep]], 1))
                    labels += [label] * int(keep.sum())
                places = np.concatenate(places) if places else np.zeros((0, 2), np.int64)
                base: dict[int, tuple[list[int], set[str]]] = {}
                for (i, at), label in zip(places.tolist(), labels, strict=True):
                    seen = base.setdefault(i, ([], set()))
                    seen[0].append(at - int(words.first[i]))
                    seen[1].add(label)
                # blocks
                at, index = known.hits(hashes)
                numbers = known.number[index]
                found: dict[int, list[dict]] = {}
                owners = np.searchsorted(words.first, at, side="right") - 1
                for i in np.unique(owners[known.in_prefix[numbers]]).tolist():
                    a, b = np.searchsorted(owners, (i, i + 1))
                    if got := blocks(at[a:b] - words.first[i], numbers[a:b], int(n_words[i])):
                        found[i] = got
                none: tuple[list[int], set[str]] = ([], set())
                rows = [(base.get(i, none), found.get(i, [])) for i in range(n_docs)]
                yield pa.record_batch([
                    ids.slice(low, n_docs),
                    pa.array(n_words, pa.int64()),
                    pa.array([len(b[0]) for b, _ in rows], pa.int64()),
                    pa.array([min(b[0], default=None) for b, _ in rows], pa.int64()),
                    pa.array([max(b[0], default=None) for b, _ in rows], pa.int64()),
                    pa.array([",".join(sorted(b[1])) for b, _ in rows], pa.string()),
                    pa.array([",".join(sorted(b[1] | {m["label"] for m in got})) for b, got in rows], pa.string()),
                    pa.array([1.0 if b[0] else max((m["containment"] for m in got), default=0.0) for b, got in rows], pa.float64()),
                    pa.array([got for _, got in rows], match),
                ], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(source, run, _OUT)
