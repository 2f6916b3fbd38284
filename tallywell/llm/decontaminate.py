"""Benchmark decontamination: BM25 over test items with block maxima, then overlap of question and answer.

The items are the index, passages of training documents the queries. A posting's weight is its BM25 weight divided by the
item's score for itself, so a passage with all words of an item scores 1 and one threshold serves all items. Document
frequencies and the average length are taken over all items.

Postings carry block maxima: items of similar length form blocks of BLOCK, and a term has for each block the largest
weight in it. A passage is skipped, as in WAND, as soon as a bound says that nothing can reach the threshold:

    1. the sum of its terms' list maxima;
    2. for each block, the sum of the terms' block maxima; terms in more than a quarter of the blocks are not looked up
       block by block but counted at their list maximum;
    3. what is left is scored item by item.

A term counts once per passage. Bounds and scores are sums over all passages of a batch at once, so Python code runs only
for pairs that are found. No bound drops a pair at or above the threshold.

Passages are windows of two steps that start every step, where a step is a power of two not shorter than the items it
serves; any item of that class lies whole within some window. Items are handled by class.

Every pair retrieved is verified on shingles of five words around the passage: the item's last sentence is its answer,
what precedes it the question, and both must be found to `overlap` or more. An item of one sentence is all question.

The index is sent to all tasks in shards of at most SHARD bytes of item text; larger benchmarks take a pass per shard.

Words are runs of letters and digits, lower-cased (also beyond A-Z), so punctuation added to a passage does not hide it.

Defined results: null and empty texts match nothing; an item without words is never found; items that repeat an item_id
are indexed each, and the better one is reported; repeated documents give their pairs once per row. Other columns are
not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywell.llm.common import per_batch
from tallywell.llm.words import NOT_ALPHANUMERIC, as_bytes, chunks, gram_hashes, owner_of, word_hashes

BLOCK = 8
SHARD = 4 << 20
K1, B = 1.2, 0.75
SHINGLE = 5
#: Sums of passages and blocks, or items, that are held at once.
CELLS = 1 << 20
LEAST_STEP = 16
_ENDS = ".!?\n"


def _lower(texts: list[bytes]) -> list[bytes]:
    return [text.lower() if text.isascii() else text.decode().lower().encode() for text in texts]


def split_item(text: str) -> tuple[str, str]:
    """Question and answer: the answer is the last sentence, empty if there is only one."""
    body = text.rstrip().rstrip(_ENDS)
    at = max(body.rfind(end) for end in _ENDS)
    return (text[: at + 1], text[at + 1 :]) if at >= 0 else (text, "")


@dataclass
class Lists:
    """Postings of one class of items, by term: blocks with their maxima, and items by block."""

    step: int
    terms: np.ndarray  # sorted hashes of terms
    list_max: np.ndarray
    common: np.ndarray  # terms that are counted at their list maximum
    begin: np.ndarray  # of each term's blocks
    block: np.ndarray
    block_max: np.ndarray
    n_blocks: int
    item_begin: np.ndarray  # of each term's items
    posted_item: np.ndarray
    posted_weight: np.ndarray
    items: list[int]  # item_id
    parts: list[tuple]  # of question and answer: words of a shingle, and the distinct shingles


def _class_lists(step: int, rows: list[tuple[int, np.ndarray, np.ndarray, tuple]]) -> Lists:
    """rows: item_id, sorted distinct terms, their weights, shingles of the parts; ordered by length."""
    terms = np.unique(np.concatenate([t for _, t, _, _ in rows]))
    spot = np.concatenate([np.searchsorted(terms, t) for _, t, _, _ in rows])
    item = np.repeat(np.arange(len(rows)), [len(t) for _, t, _, _ in rows])
    weight = np.concatenate([w for _, _, w, _ in rows])
    order = np.lexsort((item, spot))
    spot, item, weight = spot[order], item[order], weight[order]
    new = np.flatnonzero(np.concatenate([[True], (spot[1:] != spot[:-1]) | (item[1:] // BLOCK != item[:-1] // BLOCK)]))
    maxima, of_term = np.maximum.reduceat(weight, new), spot[new]
    begin, n_blocks = np.searchsorted(of_term, np.arange(len(terms) + 1)), (len(rows) - 1) // BLOCK + 1
    return Lists(step, terms, np.maximum.reduceat(maxima, begin[:-1]), np.diff(begin) > max(1, n_blocks // 4), begin, item[new] // BLOCK,
                 maxima, n_blocks, np.searchsorted(spot, np.arange(len(terms) + 1)), item, weight, [i for i, _, _, _ in rows],
                 [p for _, _, _, p in rows])


def _part(text: str) -> tuple[int, np.ndarray]:
    """Shingles of SHINGLE words, or the whole part if it is shorter."""
    words, _ = word_hashes(_lower([text.encode()]), NOT_ALPHANUMERIC)
    size = min(SHINGLE, len(words))
    return size, np.unique(gram_hashes(words, size)) if size else words


def build_lists(items: list[tuple[int, str]], frequency: dict[int, int], n_items: int, mean_length: float) -> list[Lists]:
    """Lists of each class of lengths, from (item_id, text) rows and the statistics of the whole benchmark."""
    texts = _lower([text.encode() for _, text in items])
    words, bounds = word_hashes(texts, NOT_ALPHANUMERIC)
    parts = [tuple(_part(half) for half in split_item(text)) for _, text in items]
    classes: dict[int, list] = {}
    for i, (item, _) in enumerate(items):
        own = words[bounds[i] : bounds[i + 1]]
        if len(own):
            terms, counts = np.unique(own, return_counts=True)
            idf = np.array([math.log1p((n_items - frequency[int(t)] + 0.5) / (frequency[int(t)] + 0.5)) for t in terms])
            weights = idf * counts * (K1 + 1) / (counts + K1 * (1 - B + B * len(own) / mean_length))
            step = max(LEAST_STEP, 1 << (len(own) - 1).bit_length())
            classes.setdefault(step, []).append((len(own), item, terms, weights / weights.sum(), parts[i]))
    return [_class_lists(step, [row[1:] for row in sorted(rows, key=lambda r: r[:2])]) for step, rows in sorted(classes.items())]


def _windows(bounds: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, end and text of all passages."""
    sizes = np.diff(bounds)
    counts = np.maximum(1, -(-sizes // step) - 1) * (sizes > 0)
    owners = np.repeat(np.arange(len(sizes)), counts)
    number = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = bounds[owners] + number * step
    return starts, np.minimum(starts + 2 * step, bounds[owners + 1]), owners


def _ranges(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of the given ranges, one after the other."""
    return np.arange(sizes.sum()) + np.repeat(begins - (np.cumsum(sizes) - sizes), sizes)


def _first_in_window(spots: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window, term) of all windows over spots[first:last], each term of a window once."""
    order = np.argsort(spots, kind="stable")
    before = np.full(len(spots), -1)
    same = spots[order][1:] == spots[order][:-1]
    before[order[1:][same]] = order[:-1][same]
    at = _ranges(first, last - first)
    new = before[at] < np.repeat(first, last - first)
    return np.repeat(np.arange(len(first)), last - first)[new], spots[at[new]]


def _summed(window: np.ndarray, term: np.ndarray, begin: np.ndarray, column: np.ndarray, weight: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """For each window and column: the sum of the terms' posted weights."""
    sizes = begin[term + 1] - begin[term]
    at = _ranges(begin[term], sizes)
    return np.bincount(np.repeat(window, sizes) * shape[1] + column[at], weight[at], minlength=shape[0] * shape[1]).reshape(shape)


def retrieve(lists: Lists, words: np.ndarray, bounds: np.ndarray, threshold: float) -> list[tuple[int, int, float, int, int]]:
    """(text, item number, score, first word, end) of all passages and items with a score of threshold or more."""
    least = threshold - 1e-9
    spots = np.minimum(np.searchsorted(lists.terms, words), len(lists.terms) - 1)
    known = np.flatnonzero(lists.terms[spots] == words)
    spots = spots[known]
    starts, ends, owners = _windows(bounds, lists.step)
    window, term = _first_in_window(spots, np.searchsorted(known, starts), np.searchsorted(known, ends))
    total = np.bincount(window, lists.list_max[term], minlength=len(starts))
    found, alive = [], np.flatnonzero(total >= least)
    room = max(1, CELLS // max(lists.n_blocks, len(lists.items)))
    for low in range(0, len(alive), room):
        own = alive[low : low + room]
        begin, end = np.searchsorted(window, own[0]), np.searchsorted(window, own[-1], "right")
        number = np.full(own[-1] - own[0] + 1, -1)
        number[own - own[0]] = np.arange(len(own))
        here, its = number[window[begin:end] - own[0]], term[begin:end]
        here, its = here[here >= 0], its[here >= 0]
        flat = lists.common[its]
        bound = _summed(here[~flat], its[~flat], lists.begin, lists.block, lists.block_max, (len(own), lists.n_blocks))
        bound += np.bincount(here[flat], lists.list_max[its[flat]], minlength=len(own))[:, None]
        near = bound.max(axis=1) >= least
        if not near.any():
            continue
        number = np.cumsum(near) - 1
        kept = near[here]
        scores = _summed(number[here[kept]], its[kept], lists.item_begin, lists.posted_item, lists.posted_weight, (int(near.sum()), len(lists.items)))
        for w, i in zip(*np.nonzero(scores >= least)):
            at = own[near][w]
            found.append((int(owners[at]), int(i), float(scores[w, i]), int(starts[at]), int(ends[at])))
    return found


def _overlap(part: tuple[int, np.ndarray], words: np.ndarray) -> float:
    """The share of a part's shingles that stand among the words; an empty part is always there."""
    size, wanted = part
    if not size:
        return 1.0
    return float(np.isin(wanted, gram_hashes(words, size)).mean())


def matches(classes: list[Lists], texts: list[bytes], threshold: float, overlap: float) -> list[tuple]:
    """(text, item_id, score, first word, question overlap, answer overlap, contaminated), the best passage per text and item."""
    best: dict[tuple[int, int], tuple] = {}
    for low, high in chunks(texts):
        words, bounds = word_hashes(_lower(texts[low:high]), NOT_ALPHANUMERIC)
        for lists in classes:
            for owner, i, score, start, end in retrieve(lists, words, bounds, threshold):
                begin, stop = max(int(bounds[owner]), start - lists.step), min(int(bounds[owner + 1]), end + lists.step)
                question, answer = (_overlap(part, words[begin:stop]) for part in lists.parts[i])
                first = start - int(bounds[owner])
                row = (question >= overlap and answer >= overlap, round(score, 9), -first, question, answer)
                key = (owner + low, lists.items[i])
                best[key] = max(best.get(key, row), row)
    return [(owner, item, row[1], -row[2], row[3], row[4], row[0]) for (owner, item), row in sorted(best.items())]


def _item_words(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    words, bounds = word_hashes(_lower(as_bytes(batch.column("text"))), NOT_ALPHANUMERIC)
    owners = owner_of(bounds)
    new = np.unique(np.stack([owners.astype(np.uint64), words]), axis=1)[1] if len(words) else words
    yield pa.RecordBatch.from_arrays([pa.array(new.view(np.int64))], ["word"])


def _item_lengths(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    _, bounds = word_hashes(_lower(as_bytes(batch.column("text"))), NOT_ALPHANUMERIC)
    yield pa.RecordBatch.from_arrays([pa.array(np.diff(bounds))], ["n"])


def indexes(benchmark: DataFrame) -> Iterator[list[Lists]]:
    """The shards of the index, each small enough to be sent to every task."""
    items = benchmark.select("item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    lengths = per_batch(items, _item_lengths, "n long").where("n > 0").agg(F.count("*").alias("items"), F.avg("n").alias("mean")).first()
    if not lengths["items"]:
        return
    counts = per_batch(items, _item_words, "word long").groupBy("word").agg(F.count("*").alias("n"))
    shards = items.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] // SHARD + 1
    for shard in range(shards):
        own = items.where(F.pmod(F.xxhash64("item_id"), F.lit(shards)) == shard)
        wanted = per_batch(own, _item_words, "word long").distinct()
        frequency = {row["word"] % (1 << 64): row["n"] for row in counts.join(wanted, "word").collect()}  # a shard's words
        rows = [(row["item_id"], row["text"]) for row in own.orderBy("item_id", "text").collect()]
        if rows:
            yield build_lists(rows, frequency, lengths["items"], lengths["mean"])


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, overlap: float = 0.8) -> DataFrame:
    """Per document and item retrieved: doc_id, item_id, score, first_word, question_overlap, answer_overlap, contaminated."""
    schema = ("doc_id long, item_id long, score double, first_word long, question_overlap double, answer_overlap double, "
              "contaminated boolean")
    spark, found = docs.sparkSession, None
    for classes in indexes(benchmark):
        sent = spark.sparkContext.broadcast(classes)

        def work(batch: pa.RecordBatch, sent=sent) -> Iterator[pa.RecordBatch]:
            rows = matches(sent.value, as_bytes(batch.column("text")), threshold, overlap)
            columns = [list(c) for c in zip(*rows)] if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(columns[0], pa.int64())), pa.array(columns[1], pa.int64()),
                 pa.array(columns[2], pa.float64()), pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.float64()),
                 pa.array(columns[5], pa.float64()), pa.array(columns[6], pa.bool_())],
                [part.split()[0] for part in schema.split(", ")])

        pairs = per_batch(docs.select("doc_id", "text"), work, schema)
        found = pairs if found is None else found.unionAll(pairs)
    return found if found is not None else spark.createDataFrame([], schema)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, overlap: float = 0.8) -> DataFrame:
    """The rows of docs, all columns, in whose text no item was confirmed. Rows pass by; nothing is joined."""
    for classes in indexes(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(classes)

        def work(batch: pa.RecordBatch, sent=sent) -> Iterator[pa.RecordBatch]:
            rows = matches(sent.value, as_bytes(batch.column("text")), threshold, overlap)
            bad = pa.array(sorted({row[0] for row in rows if row[-1]}), pa.int64())
            yield batch.filter(pc.invert(pc.is_in(pa.array(range(batch.num_rows), pa.int64()), value_set=bad)))

        docs = per_batch(docs, work, docs.schema)
    return docs
