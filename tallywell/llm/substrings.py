"""Repeated passages: seed with winnowed anchors, extend to windows, keep maximal repeats.

A window is `length` consecutive words of a document. Of its length - ANCHOR + 1 runs of ANCHOR words, the one with the
smallest hash is the window's anchor. Equal windows have equal anchors, so a window that occurs in two documents has an
anchor that occurs in two documents, and only windows at such anchors need a closer look. A quarter of the words are
anchors, so the first shuffle carries a quarter of the windows.

    anchors    one row per document and anchor, grouped by anchor: which occur in several documents
    windows    documents with shared anchors, extended both ways: all windows around them, grouped by content
    repeats    windows that also start in a document with a smaller id, merged into maximal runs of words

Hot anchors and windows: every batch of documents knows at once that its later occurrences repeat, so those rows get a
key of their own, and only the batch's first occurrence is grouped by content. Texts are shuffled once, by document,
and that exchange serves both the extension and the removal.

Defined results: a null or empty text has no words; a text shorter than `length` keeps all words; a row without doc_id
is compared with nothing and keeps all; rows that repeat a doc_id are one document, so they don't repeat one another,
and what is removed in one is removed in all. Other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywell.llm.common import per_batch
from tallywell.llm.words import as_bytes, chunks, gram_hashes, mix, owner_of, word_hashes

ANCHOR = 7
_SALT = np.uint64(0xD6E8FEB86659FD93)


def _windows(texts: list[bytes], length: int, gram: int):
    """Of all windows of the texts: text, first word, hash of the window, hash of its anchor."""
    words, bounds = word_hashes(texts)
    owners = owner_of(bounds)
    count = max(0, len(words) - length + 1)
    starts = np.flatnonzero(owners[:count] == owners[length - 1 :][:count])
    grams = gram_hashes(words, gram)
    least = grams[:count].copy()
    for j in range(1, length - gram + 1):
        np.minimum(least, grams[j : j + count], out=least)
    owners = owners[starts]
    return owners, starts - bounds[owners], gram_hashes(words, length)[starts], least[starts]


def _first_of_equals(values: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (value, id), and for each entry in that order the smallest id of its value."""
    order = np.lexsort((ids, values))
    ordered = values[order]
    heads = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    return order, np.repeat(ids[order][heads], np.diff(np.concatenate([heads, [len(order)]])))


def _anchor_rows(length: int, gram: int):
    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, texts = batch.column("doc_id").to_numpy(zero_copy_only=False), as_bytes(batch.column("text"))
        found, owner = [], []
        for low, high in chunks(texts):
            owners, _, _, anchors = _windows(texts[low:high], length, gram)
            new = np.flatnonzero(np.concatenate([[True], (anchors[1:] != anchors[:-1]) | (owners[1:] != owners[:-1])])[: len(anchors)])
            found.append(anchors[new])
            owner.append(ids[low:high][owners[new]])
        values, documents = np.concatenate(found), np.concatenate(owner)
        if not len(values):
            return
        order, firsts = _first_of_equals(values, documents)
        values, documents = values[order], documents[order]
        new = np.concatenate([[True], (values[1:] != values[:-1]) | (documents[1:] != documents[:-1])])
        values, documents, firsts = values[new], documents[new], firsts[new]
        later = documents != firsts
        # The first occurrence is shared as well if a later one follows; a second row says so.
        told = later.copy()
        told[:-1] |= ~later[:-1] & later[1:]
        slots = np.concatenate([values[~later], mix(values[told] ^ mix(documents[told].view(np.uint64) + _SALT))])
        yield pa.RecordBatch.from_arrays([
            pa.array(slots.view(np.int64)),
            pa.array(np.concatenate([documents[~later], documents[told]])),
            pa.array(np.concatenate([np.zeros((~later).sum(), np.int64), values[told].view(np.int64)]),
                     mask=np.arange(len(slots)) < (~later).sum()),
        ], ["slot", "doc_id", "anchor"])

    return work


def _window_rows(length: int, gram: int):
    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, texts = batch.column("doc_id").to_numpy(zero_copy_only=False), as_bytes(batch.column("text"))
        anchors = batch.column("anchors")
        marks = mix(anchors.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                    + np.repeat(np.arange(len(ids), dtype=np.uint64), np.diff(anchors.offsets.to_numpy())) * _SALT)
        marks.sort()
        parts = []
        for low, high in chunks(texts):
            owners, places, windows, least = _windows(texts[low:high], length, gram)
            wanted = mix(least + (owners + low).astype(np.uint64) * _SALT)
            at = np.minimum(np.searchsorted(marks, wanted), len(marks) - 1)
            near = marks[at] == wanted
            parts.append((ids[low:high][owners[near]], places[near], windows[near]))
        documents, places, windows = (np.concatenate(x) for x in zip(*parts))
        if not len(windows):
            return
        order, firsts = _first_of_equals(windows, documents)
        documents, places, windows = documents[order], places[order], windows[order]
        later = documents != firsts
        windows[later] = mix(windows[later] ^ mix(documents[later].view(np.uint64) + places[later].astype(np.uint64) * _SALT))
        yield pa.RecordBatch.from_arrays([
            pa.array(windows.view(np.int64)), pa.array(documents), pa.array((places * 2 + later).astype(np.int64)),
        ], ["slot", "doc_id", "place"])

    return work


def _covered(places: np.ndarray, length: int, n_words: int) -> np.ndarray:
    """The words of all windows: overlapping windows merge into maximal runs."""
    steps = np.zeros(n_words + length + 1, np.int64)
    np.add.at(steps, places, 1)
    np.add.at(steps, places + length, -1)
    return np.cumsum(steps)[:n_words] > 0


def _cut(length: int):
    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        counts, removed, digests = [], [], []
        for text, places in zip(as_bytes(batch.column("text")), batch.column("places")):
            words = text.split()
            counts.append(len(words))
            gone = np.zeros(len(words), bool)
            if places.is_valid:
                inside = places.values.to_numpy(zero_copy_only=False)
                gone = _covered(inside[inside + length <= len(words)], length, len(words))
            removed.append(int(gone.sum()))
            kept = compress(words, (~gone).tolist()) if removed[-1] else words
            digests.append(b" ".join(kept).decode())
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()),
            pa.array([hashlib.sha256(kept.encode()).hexdigest() for kept in digests]), pa.array(digests, pa.string()),
        ], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return work


def seeds(documents: DataFrame, length: int, gram: int = ANCHOR) -> DataFrame:
    """(doc_id, anchors): the anchors of each document that occur in another one too. Bounded by the document's words."""
    rows = per_batch(documents, _anchor_rows(length, gram), "slot long, doc_id long, anchor long")
    within = Window.partitionBy("slot")
    shared = (rows.withColumn("low", F.min("doc_id").over(within)).withColumn("high", F.max("doc_id").over(within))
              .where("anchor IS NOT NULL OR low <> high"))
    return shared.groupBy("doc_id").agg(F.collect_list(F.coalesce("anchor", "slot")).alias("anchors"))


def repeated_windows(documents: DataFrame, length: int, gram: int = ANCHOR) -> DataFrame:
    """(doc_id, place): windows, by their first word, that also start in a document with a smaller id."""
    near = documents.join(seeds(documents, length, gram), "doc_id")
    rows = per_batch(near, _window_rows(length, gram), "slot long, doc_id long, place long")
    return (rows.withColumn("low", F.min("doc_id").over(Window.partitionBy("slot")))
            .where("place % 2 = 1 OR low < doc_id")
            .select("doc_id", F.shiftright("place", 1).cast("int").alias("place")))


def remove_repeats(docs: DataFrame, length: int = 13, gram: int = ANCHOR) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256, kept_text."""
    documents = docs.select("doc_id", "text").where("doc_id IS NOT NULL")
    places = repeated_windows(documents, length, gram).groupBy("doc_id").agg(F.collect_list("place").alias("places"))
    whole = documents.join(places, "doc_id", "left").select("doc_id", "text", "places")
    unnamed = docs.select("doc_id", "text").where("doc_id IS NULL").withColumn("places", F.lit(None).cast("array<int>"))
    return per_batch(whole.unionAll(unnamed), _cut(length),
                     "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
