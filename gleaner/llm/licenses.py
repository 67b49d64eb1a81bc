"""Licence scans with a positional index of rare words.

The templates (short licence notices with mandatory key phrases) are indexed by word and position. How rare
each licence word is in the corpus is counted over all documents. Every key phrase is looked up by its rarest
word: each place of that word in a file, less the word's position in the phrase, is a place where the
phrase may start, and is kept if all its words stand there. For whole templates the places of their rarest words
are intersected by relative position: each says where the template would start, and those that agree within a few words
hold a share of the template's rarity. A template is found where that share is ``AGREED`` at least and all of its key
phrases stand in the file; key phrases alone, or words in another order, are no licence. The base phrases label on
their own.

Defined cases: a null or empty text has no words and score 0; words are whole, so ``mitigate`` is not ``mit``;
repeated rows get equal results; ties between templates are both labelled; extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.words import ALNUM, find_words, text_slices

#: phrases whose places are counted, with their labels
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: label: (text of the notice, its key phrases)
TEMPLATES = {
    "mit": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute "
        "sublicense and or sell copies of the software",
        ["permission is hereby granted free of charge", "without restriction"],
    ),
    "apache-2": (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may "
        "obtain a copy of the license at http www apache org licenses license 2 0",
        ["apache license version 2"],
    ),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
        "conditions are met redistributions of source code must retain the above copyright notice",
        ["redistribution and use in source and binary forms", "are permitted provided that"],
    ),
    "gpl": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as "
        "published by the free software foundation either version 3 of the license or at your option any later version",
        ["gnu general public license"],
    ),
    "lgpl": (
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license "
        "as published by the free software foundation",
        ["gnu lesser general public license"],
    ),
    "mpl-2": (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with "
        "this file you can obtain one at http mozilla org mpl 2 0",
        ["mozilla public license"],
    ),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that "
        "the above copyright notice and this permission notice appear in all copies",
        ["permission to use copy modify and or distribute this software for any purpose"],
    ),
    "cc-by": ("licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4"]),
    "cc-by-nc": ("licensed under a creative commons attribution noncommercial license", ["creative commons attribution noncommercial"]),
    "cc0": ("this work is dedicated to the public domain under creative commons zero cc0", ["creative commons zero"]),
    "unlicense": (
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or "
        "distribute this software",
        ["free and unencumbered software released into the public domain"],
    ),
}
#: rarest words of a template that vote for where it starts
ANCHORS = 8
#: words by which votes of one template may differ and still meet
SLACK = 4
#: share of a template's rarity that agrees on its place
AGREED = 0.75
_BITS = 16


def _hashes(words: list[str]) -> np.ndarray:
    return find_words(pa.array(words, pa.large_string()), ALNUM).hash


@dataclass
class Phrase:
    words: np.ndarray
    labels: tuple[str, ...]
    base: bool


class Index:
    """Templates and key phrases, and the postings of their rare words."""

    def __init__(self, rarity: dict[str, float], base: dict[str, str] = BASE, templates: dict = TEMPLATES):
        rare = lambda w: (rarity.get(w, 0.0), w)
        self.phrases = [(p, label, True) for p, label in base.items()]
        self.needs: list[tuple[str, list[int]]] = []
        for label, (_, keys) in templates.items():
            self.needs.append((label, [len(self.phrases) + k for k in range(len(keys))]))
            self.phrases += [(p, label, False) for p in keys]
        self.phrase_words = [_hashes([p]) for p, _, _ in self.phrases]
        postings: dict[str, list[tuple[int, int]]] = {}
        for k, (phrase, _, _) in enumerate(self.phrases):
            words = phrase.split()
            at = max(range(len(words)), key=lambda i: rare(words[i]))
            postings.setdefault(words[at], []).append((k, at))
        self.names = list(templates)
        self.mass = np.zeros(len(templates))
        votes: dict[str, list[tuple[int, int, float]]] = {}
        for t, (text, _) in enumerate(templates.values()):
            words = text.split()
            chosen = sorted(range(len(words)), key=lambda i: rare(words[i]), reverse=True)[:ANCHORS]
            for i in chosen:
                weight = max(rarity.get(words[i], 0.0), 1e-3)
                votes.setdefault(words[i], []).append((t, i, weight))
                self.mass[t] += weight
        vocabulary = sorted({*postings, *votes})
        hashes = _hashes([" ".join(vocabulary)])
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.postings = [postings.get(vocabulary[i], []) for i in order]
        of_word = [votes.get(vocabulary[i], []) for i in order]
        self.first_vote = np.concatenate(([0], np.cumsum([len(v) for v in of_word])))
        flat = [x for v in of_word for x in v]
        self.vote_template, self.vote_offset = (np.array([x[k] for x in flat], np.int64) for k in (0, 1))
        self.vote_weight = np.array([x[2] for x in flat], float)
        self.table = np.zeros(1 << _BITS, dtype=bool)
        self.table[self.hashes >> np.uint64(64 - _BITS)] = True

    def places(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the words of the index stand, and which."""
        near = np.flatnonzero(self.table[words >> np.uint64(64 - _BITS)])
        at = np.searchsorted(self.hashes, words[near]).clip(max=len(self.hashes) - 1)
        same = self.hashes[at] == words[near]
        return near[same], at[same]

    def phrase_places(self, words: np.ndarray, first: np.ndarray, place: np.ndarray, which: np.ndarray) -> dict[int, np.ndarray]:
        """Starts of every phrase, verified word by word."""
        end = np.repeat(first[1:], np.diff(first))
        begin = np.repeat(first[:-1], np.diff(first))
        found: dict[int, list[np.ndarray]] = {}
        for v, entries in enumerate(self.postings):
            spots = place[which == v] if entries else place[:0]
            for k, offset in entries:
                own = self.phrase_words[k]
                inside = spots[(spots - offset >= begin[spots]) & (spots - offset + len(own) <= end[spots])] - offset
                for j, h in enumerate(own):
                    inside = inside[words[inside + j] == h]
                found.setdefault(k, []).append(inside)
        return {k: np.concatenate(v) for k, v in found.items()}

    def alignments(self, doc: np.ndarray, place: np.ndarray, which: np.ndarray, docs: int) -> np.ndarray:
        """For every text and template the largest share of its rarity whose places agree."""
        best = np.zeros((docs, len(self.names)))
        count = np.diff(self.first_vote)[which]
        row = np.repeat(np.arange(len(place)), count)
        if not len(row):
            return best
        vote = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(self.first_vote[which], count)
        t, i = self.vote_template[vote], self.vote_offset[vote]
        # a start counts for the windows that begin at it or up to SLACK words before, each word of a template once
        key = np.stack([np.tile(x, SLACK + 1) for x in (doc[place][row], t, i)])
        window = np.concatenate([place[row] - i - k for k in range(SLACK + 1)])
        d, t, i, window, vote = key[0], key[1], key[2], window, np.tile(vote, SLACK + 1)
        order = np.lexsort((i, window, t, d))
        d, t, i, window, vote = d[order], t[order], i[order], window[order], vote[order]
        other = np.ones(len(d), bool)
        other[1:] = (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (window[1:] != window[:-1])
        once = other | np.concatenate(([True], i[1:] != i[:-1]))
        mass = np.add.reduceat(np.where(once, self.vote_weight[vote], 0.0), np.flatnonzero(other))
        np.maximum.at(best, (d[other], t[other]), mass / self.mass[t[other]])
        return best.clip(0, 1)


def vocabulary(base: dict[str, str] = BASE, templates: dict = TEMPLATES) -> list[str]:
    """All words of phrases and templates: their number is the bound of everything that is counted."""
    texts = [*base, *(t for t, _ in templates.values()), *(k for _, keys in templates.values() for k in keys)]
    return sorted({w for t in texts for w in t.split()})


def _counter(words: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _hashes([" ".join(words)])
        order = np.argsort(hashes)
        known, table = hashes[order], np.zeros(1 << _BITS, dtype=bool)
        table[known >> np.uint64(64 - _BITS)] = True
        count, docs = np.zeros(len(words), np.int64), 0
        for batch in text_slices(batches):
            found = find_words(batch.column("text"), ALNUM)
            near = np.flatnonzero(table[found.hash >> np.uint64(64 - _BITS)])
            at = np.searchsorted(known, found.hash[near]).clip(max=len(known) - 1)
            near, at = near[known[at] == found.hash[near]], at[known[at] == found.hash[near]]
            pairs = np.unique(found.doc[near] * len(words) + at)
            count += np.bincount(order[pairs % len(words)], minlength=len(words))
            docs += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(["", *words]), pa.array([docs, *count.tolist()], pa.int64())], names=["word", "n"])

    return run


def rarities(docs: DataFrame, words: list[str]) -> dict[str, float]:
    """Inverse document frequency of these words over all documents."""
    counted = docs.select("text").mapInArrow(_counter(words), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    n = {r["word"]: r["n"] for r in counted.collect()}
    return {w: float(np.log((1 + n.get("", 0)) / (1 + n.get(w, 0)))) for w in words}


def _scan(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            words = find_words(batch.column("text"), ALNUM)
            docs = batch.num_rows
            place, which = index.places(words.hash)
            found = index.phrase_places(words.hash, words.first, place, which)
            shares = index.alignments(words.doc, place, which, docs)
            n_base, first_word, last_word = np.zeros(docs, np.int64), np.full(docs, -1), np.full(docs, -1)
            base: list[set[str]] = [set() for _ in range(docs)]
            has = np.zeros((docs, len(index.phrases)), dtype=bool)
            for k, starts in found.items():
                if not len(starts):
                    continue
                of = np.searchsorted(words.first, starts, "right") - 1
                has[of, k] = True
                if index.phrases[k][2]:
                    np.add.at(n_base, of, 1)
                    for d, p in zip(of, starts - words.first[of]):
                        first_word[d] = p if first_word[d] < 0 else min(first_word[d], p)
                        last_word[d] = max(last_word[d], p)
                        base[d].add(index.phrases[k][1])
            labels = [set(b) for b in base]
            score = shares.max(axis=1) * 0.9
            for t, (label, keys) in enumerate(index.needs):
                for d in np.flatnonzero(has[:, keys].all(axis=1) & (shares[:, t] >= AGREED)):
                    labels[d].add(label)
            score = np.where([bool(x) for x in labels], np.maximum(score, 0.95), score)
            score = np.where(n_base > 0, 1.0, score)
            known = n_base == 0
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(words.count.astype(np.int64)), pa.array(n_base), pa.array(first_word.astype(np.int64), mask=known),
                    pa.array(last_word.astype(np.int64), mask=known), pa.array([",".join(sorted(b)) for b in base], pa.string()),
                    pa.array([",".join(sorted(b)) for b in labels], pa.string()), pa.array(score.astype(float)),
                ],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    return run


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per document: words, places of the base phrases, labels and the score of the best notice."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    index = Index(rarities(texts, vocabulary()))
    return texts.mapInArrow(
        _scan(index),
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double",
    )
