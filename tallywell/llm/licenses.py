"""Licence scans with a positional index of rare words.

Templates are licence statements. Each has a key phrase that must stand in it word for word. Licence words are weighed by
their inverse document frequency over the whole corpus, counted in a first pass. The index posts, for the two rarest words
of every key phrase, the template and the word's place in the phrase: word -> (template, place).

A file's licence words are looked up rarest first. A word that is the rarest of some key phrases opens a candidate for
each of them, a template at a position of the file. The postings of the second-rarest words give candidates as well, and
only those on which both agree go on: postings intersected by relative position. What is left is verified word by word as
the whole key phrase within one file. The rest of the template is then compared at its positions, and the share of the
template's weight that is found is the score of that place. The key phrase is mandatory and its two rarest words belong
to it, so nothing is missed; work follows the places of rare words and their postings, not templates times words.

A phrase standing in a file gives its label if the phrase is in `base`; base phrases are posted in the same index, as
templates that are all key phrase, but do not count for the score. A template gives its label where its score is at least
`least`. A template set of any size fits as long as it can be sent to every task; it is a parameter, not data.

Defined results: a null or empty text has no words, no places, empty label lists and a score of 0. Rows that repeat give
a row each. A row without doc_id is scanned like any other. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywell.llm.common import per_batch
from tallywell.llm.words import NOT_ALPHANUMERIC, as_bytes, chunks, owner_of, word_hashes

# Phrases and labels of the contract.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Licence statements, their key phrases and labels.
TEMPLATES = [
    ("released under the mit license", "mit license", "mit"),
    ("licensed under the apache license version 2 0", "apache license", "apache"),
    ("this work is licensed under the gnu general public license version 3", "general public license", "gpl"),
    ("licensed under cc by nc 4 0", "cc by nc", "cc-by-nc"),
    ("licensed under the gnu lesser general public license", "lesser general public license", "lgpl"),
    ("licensed under the mozilla public license version 2 0", "mozilla public license", "mpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted",
     "redistribution and use in source and binary forms", "bsd"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
     "the software to deal in the software without restriction", "to deal in the software without restriction", "mit"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
     "for any purpose with or without fee is hereby granted", "isc"),
    ("this is free and unencumbered software released into the public domain", "free and unencumbered software", "unlicense"),
    ("permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying "
     "documentation covered by this license", "person or organization obtaining a copy of the software", "bsl"),
    ("this software is provided as is without any express or implied warranty in no event will the authors be held liable",
     "in no event will the authors be held liable", "zlib"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license", "mpl"),
    ("under the terms of the gnu general public license as published by the free software foundation",
     "general public license as published by the free software foundation", "gpl"),
    ("under the terms of the gnu affero general public license", "affero general public license", "agpl"),
    ("licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0", "cc-by"),
    ("licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike", "cc-by-sa"),
    ("has waived all copyright and related or neighboring rights to this work", "waived all copyright and related or neighboring rights", "cc0"),
    ("made available under the terms of the eclipse public license", "eclipse public license", "epl"),
]


@dataclass(frozen=True)
class Statement:
    """A template, or a base phrase, which is all key phrase."""

    label: str
    words: np.ndarray  # hashes
    key_at: int
    key_size: int
    base: bool


@dataclass(frozen=True)
class Postings:
    """By licence word: the key phrases that it belongs to at this rank of rarity, and its place in them."""

    begin: np.ndarray
    statement: np.ndarray
    place: np.ndarray


@dataclass(frozen=True)
class Index:
    """Statements one after the other as numbers of licence words, and postings of their key phrases."""

    vocabulary: np.ndarray  # sorted hashes of licence words
    weights: np.ndarray
    words: np.ndarray
    begin: np.ndarray  # of each statement's words
    key_at: np.ndarray
    key_size: np.ndarray
    total: np.ndarray  # weight of each statement
    base: np.ndarray
    labels: tuple[str, ...]
    rarest: Postings
    second: Postings  # key phrases of one word have none and need none


def _hashes(phrase: str) -> np.ndarray:
    return word_hashes([phrase.encode()], NOT_ALPHANUMERIC)[0]


def statements(base: Mapping[str, str], templates: Sequence[tuple[str, str, str]]) -> list[Statement]:
    built = [Statement(label, _hashes(phrase), 0, len(phrase.split()), True) for phrase, label in base.items()]
    for text, key, label in templates:
        words, phrase = text.split(), key.split()
        at = next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)
        built.append(Statement(label, _hashes(text), at, len(phrase), False))
    return built


def _ranges(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of the given ranges, one after the other."""
    return np.arange(sizes.sum()) + np.repeat(begins - (np.cumsum(sizes) - sizes), sizes)


def _postings(rows: list[tuple[int, int, int]], n_words: int) -> Postings:
    """rows: word, statement, place."""
    columns = np.array(sorted(rows), np.int64).reshape(-1, 3)
    return Postings(np.searchsorted(columns[:, 0], np.arange(n_words + 1)), columns[:, 1], columns[:, 2])


def build_index(built: list[Statement], vocabulary: np.ndarray, weights: np.ndarray) -> Index:
    numbers = [np.searchsorted(vocabulary, s.words) for s in built]
    ranked = []
    for s, own in zip(built, numbers):
        key = own[s.key_at : s.key_at + s.key_size]
        ranked.append([(int(key[i]), i) for i in sorted(range(s.key_size), key=lambda i: (-weights[key[i]], i))])
    by_rank = [[(order[rank][0], i, order[rank][1]) for i, order in enumerate(ranked) if len(order) > rank] for rank in (0, 1)]
    sizes = np.array([len(own) for own in numbers])
    return Index(vocabulary, weights, np.concatenate(numbers), np.cumsum(sizes) - sizes, np.array([s.key_at for s in built]),
                 np.array([s.key_size for s in built]), np.array([weights[own].sum() for own in numbers]), np.array([s.base for s in built]),
                 tuple(s.label for s in built), _postings(by_rank[0], len(vocabulary)), _postings(by_rank[1], len(vocabulary)))


def _files(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    texts = [text.lower() for text in as_bytes(batch.column("text"))]  # of bytes: A-Z only
    for low, high in chunks(texts):
        yield low, high, *word_hashes(texts[low:high], NOT_ALPHANUMERIC)


def _licence_words(vocabulary: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where licence words stand, and which."""
    at = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
    spots = np.flatnonzero(vocabulary[at] == words)
    return spots, at[spots]


def document_frequencies(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """(word, n): the number of documents with each of the given words, and under the number after the last all documents."""
    size = len(vocabulary)

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size + 1, np.int64)
        counts[size] = batch.num_rows
        for _, _, words, bounds in _files(batch):
            spots, found = _licence_words(vocabulary, words)
            counts[:size] += np.bincount(np.unique(owner_of(bounds)[spots] * size + found) % size, minlength=size)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 1)), pa.array(counts)], ["word", "n"])

    return per_batch(docs.select("text"), work, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _candidates(postings: Postings, spots: np.ndarray, found: np.ndarray, span: int) -> np.ndarray:
    """Statement and start of its key phrase, as one number, for every posting of every place."""
    sizes = postings.begin[found + 1] - postings.begin[found]
    at = _ranges(postings.begin[found], sizes)
    start = np.repeat(spots, sizes) - postings.place[at]
    return (postings.statement[at] * span + start)[start >= 0]


def standing(index: Index, words: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(statement, start) of all key phrases that stand within one file."""
    spots, found = _licence_words(index.vocabulary, words)
    span = len(words) + 1
    opened = _candidates(index.rarest, spots, found, span)
    agreed = np.isin(opened, _candidates(index.second, spots, found, span))
    opened = opened[agreed | (index.key_size[opened // span] == 1)]
    statement, start = opened // span, opened % span
    whole = start + index.key_size[statement] <= len(words)
    statement, start = statement[whole], start[whole]
    sizes = index.key_size[statement]
    wanted = index.vocabulary[index.words[_ranges(index.begin[statement] + index.key_at[statement], sizes)]]
    there = _ranges(start, sizes)
    wrong = (words[there] != wanted) | (owners[there] != np.repeat(owners[start], sizes))
    right = np.bincount(np.repeat(np.arange(len(start)), sizes), wrong, minlength=len(start)) == 0
    return statement[right], start[right]


def coverage(index: Index, words: np.ndarray, owners: np.ndarray, statement: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The share of each statement's weight found around its key phrase."""
    lengths = np.diff(np.append(index.begin, len(index.words)))[statement]
    own = index.words[_ranges(index.begin[statement], lengths)]
    there = _ranges(start - index.key_at[statement], lengths)
    inside = (there >= 0) & (there < len(words))
    there = np.where(inside, there, 0)
    same = inside & (words[there] == index.vocabulary[own]) & (owners[there] == np.repeat(owners[start], lengths))
    found = np.bincount(np.repeat(np.arange(len(start)), lengths), index.weights[own] * same, minlength=len(start))
    return found / index.total[statement]


def _joined(count: int, files: np.ndarray, names: np.ndarray, labels: tuple[str, ...]) -> list[str]:
    """The distinct labels of each file, sorted."""
    own: list[set[str]] = [set() for _ in range(count)]
    for file, name in np.unique(np.stack([files, names]), axis=1).T.tolist() if len(files) else []:
        own[file].add(labels[name])
    return [",".join(sorted(x)) for x in own]


def _scan(index: Index, least: float):
    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows: dict[str, list] = {name: [] for name in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")}
        for low, high, words, bounds in _files(batch):
            owners, count = owner_of(bounds), high - low
            statement, start = standing(index, words, owners)
            files, base = owners[start], index.base[statement]
            own, place = files[base], (start - bounds[files])[base]
            first, last = np.full(count, len(words)), np.full(count, -1)
            np.minimum.at(first, own, place)
            np.maximum.at(last, own, place)
            score, named = np.zeros(count), base.copy()
            shares = coverage(index, words, owners, statement[~base], start[~base])
            np.maximum.at(score, files[~base], shares)
            named[~base] = shares >= least
            rows["n_words"] += np.diff(bounds).tolist()
            rows["n_base"] += np.bincount(own, minlength=count).tolist()
            rows["first_word"] += [x if y >= 0 else None for x, y in zip(first.tolist(), last.tolist())]
            rows["last_word"] += [y if y >= 0 else None for y in last.tolist()]
            rows["base_labels"] += _joined(count, own, statement[base], index.labels)
            rows["labels"] += _joined(count, files[named], statement[named], index.labels)
            rows["score"] += np.round(score, 9).clip(0, 1).tolist()
        kinds = {"base_labels": pa.string(), "labels": pa.string(), "score": pa.float64()}
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *[pa.array(values, kinds.get(name, pa.int64())) for name, values in rows.items()]],
            ["doc_id", *rows])

    return work


def scan(docs: DataFrame, base: Mapping[str, str] = BASE, templates: Sequence[tuple[str, str, str]] = TEMPLATES, least: float = 0.6) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    built = statements(base, templates)
    vocabulary = np.unique(np.concatenate([s.words for s in built]))
    counted = {row["word"]: row["n"] for row in document_frequencies(docs, vocabulary).collect()}  # one row per licence word
    n_files = counted.get(len(vocabulary), 0)
    weights = np.array([math.log(1 + (n_files + 1) / (counted.get(i, 0) + 1)) for i in range(len(vocabulary))])
    return per_batch(docs.select("doc_id", "text"), _scan(build_index(built, vocabulary, weights), least),
                     "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
