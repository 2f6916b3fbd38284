"""Spelling variants: words one edit apart, found through a dictionary of trie-node pairs.

The words of a corpus form two tries, one of the words and one of the reversed words. Every node gets an integer, so a word
is two lists of integers: the nodes of its beginnings and the nodes of its endings. A pair (beginning, ending) names a text
without spelling it out:

    - the pair around a skipped position i, (beginning before i, ending after i), is the word without its character i;
    - the pair at an inserted position i, (beginning before i, ending from i on), is the word itself.

Two words differ by one replaced character where they share a skipped pair, and by one inserted character where a skipped
pair of the longer is a pair of the shorter. Joining on the pair of integers is therefore exact in both directions: nothing
is compared afterwards. A longer word gives the same text for every position in a run of equal characters, so only the first
of a run counts.

Numbering. Words in order share beginnings with their neighbours, so one pass over a sorted range numbers the nodes of its
trie: what a word shares with the word before keeps its numbers. A beginning that reaches across the border of two ranges is
a beginning of the first word behind the border; such nodes are numbered by the first border that they touch. The driver
holds the first word of each range, as many as there are partitions.

A pair holds at most one word with an insertion there and one word per character of the alphabet, so what meets on a pair is
bounded by the alphabet, however common a word is; occurrences are counted before anything is joined. Forms are followed to
the last by doubling; a form is at least `ratio` times as frequent, so chains are as short as the logarithm of the counts.

Defined results: a null text has no words, a null doc_id counts as empty text in `thinned`. Words are counted over all rows,
repeated rows too. Very long words are taken whole. Ties in frequency go to the first in code-point order. Without words the
result is empty. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywell.llm.common import small_batches
from tallywell.session import materialise

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters of a run, after lower-casing.
LETTERS = "a-zA-ZÀ-ÿ"
#: Rows of an Arrow batch of pairs.
PAIR_ROWS = 1 << 16
#: Bits for the number of a node within its range.
_WITHIN = 40


def runs(docs: DataFrame, least: int) -> DataFrame:
    """(doc_id, run): all maximal runs of at least so many letters, A-Z in lower case."""
    lower = F.translate("text", _UPPER, _LOWER)
    return docs.select("doc_id", F.explode(F.regexp_extract_all(lower, F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))).alias("run"))


def thinned(rows: DataFrame, every: int) -> Column:
    """The run, or without one letter where `every` divides the CRC-32 of doc_id and run: misspellings to find again."""
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run").cast("binary"))
    at = F.pmod(h, F.char_length("run")).cast("int")
    return F.when(h % every == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))).otherwise(F.col("run"))


def counted(words: DataFrame, least_length: int, least_count: int) -> DataFrame:
    """(id, word, n): words numbered in code-point order, written once."""
    words = words.where(F.char_length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)
    stored = materialise(words, "counts")
    return materialise(stored.repartitionByRange("word").sortWithinPartitions("word").select(F.monotonically_increasing_id().alias("id"), "word", "n"), "words")


def _common(a: str, b: str) -> int:
    """The length of the longest common beginning."""
    if b.startswith(a):
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[:middle] == b[:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _border_nodes(borders: list[tuple[int, str]]) -> tuple[dict[int, list[int]], dict[int, int | None]]:
    """Per range the numbers of all beginnings of its first word, by the first border that they touch; and the next range."""
    numbers, before, word_before = {}, [], ""
    for at, (part, word) in enumerate(borders):
        shared = _common(word_before, word) if at else -1
        before = before[: shared + 1] + [-((at << _WITHIN) + d + 1) for d in range(shared + 1, len(word) + 1)]
        numbers[part], word_before = before, word
    return numbers, {a: b for (a, _), (b, _) in pairwise(borders)}


def trie_nodes(words: DataFrame, backwards: bool) -> DataFrame:
    """(id, nodes): the numbers of all beginnings of each word, the empty one and the whole included; or of all endings."""
    text = F.reverse("word") if backwards else F.col("word")
    ordered = words.select("id", text.alias("text")).repartitionByRange("text").sortWithinPartitions("text")
    stored = materialise(ordered.withColumn("part", F.spark_partition_id()), "ordered")
    borders = sorted((r["part"], r["first"]) for r in stored.groupBy("part").agg(F.min("text").alias("first")).collect())
    numbers, following = _border_nodes(borders)
    first = dict(borders)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nodes, last, used = None, [], "", 0
        for batch in batches:
            lists = []
            for own, word in zip(batch.column("part").to_pylist(), batch.column("text").to_pylist()):
                if own != part:
                    part, used = own, 0
                    nodes, last = list(numbers[part]), first[part]
                    next_word, next_nodes = first.get(following.get(part), ""), numbers.get(following.get(part), [])
                shared = _common(last, word)
                del nodes[shared + 1 :]
                upto = _common(next_word, word) if next_nodes else -1
                # What reaches to the next border has the number that it has there.
                nodes += next_nodes[shared + 1 : upto + 1]
                fresh = len(word) + 1 - len(nodes)
                base = (part << _WITHIN) + used
                nodes += range(base, base + fresh)
                used, last = used + fresh, word
                lists.append(pa.array(nodes, pa.int64()))
            sizes = np.cumsum([0, *map(len, lists)])
            values = pa.concat_arrays(lists) if lists else pa.array([], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), values)], ["id", "nodes"])

    small_batches(words.sparkSession)
    return stored.repartition("part").sortWithinPartitions("part", "text").mapInArrow(run, "id long, nodes array<long>")


def _pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words with their nodes to pairs: kind 0 is the word itself, 1 a skipped position, 2 one that is the first of a run."""
    for batch in batches:
        ids, counts = (batch.column(c).to_numpy() for c in ("id", "n"))
        for at in range(batch.num_rows):
            letters = np.frombuffer(batch.column("word")[at].as_py().encode("utf-32-le"), np.uint32)
            begins = batch.column("begins")[at].values.to_numpy()
            ends = batch.column("ends")[at].values.to_numpy()[::-1]
            fresh = np.concatenate([[True], letters[1:] != letters[:-1]])
            yield ids[at], counts[at], np.concatenate([begins, begins[:-1]]), np.concatenate([ends, ends[1:]]), np.concatenate(
                [np.zeros(len(begins), np.int8), 1 + fresh.astype(np.int8)])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def packed() -> Iterator[pa.RecordBatch]:
        lengths = [len(row[2]) for row in held]
        columns = [np.repeat(np.array([row[0] for row in held], np.int64), lengths), np.repeat(np.array([row[1] for row in held], np.int64), lengths),
                   *[np.concatenate([row[k] for row in held]) for k in (2, 3, 4)]]
        whole = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["id", "n", "begin", "end", "kind"])
        for low in range(0, whole.num_rows, PAIR_ROWS):
            yield whole.slice(low, PAIR_ROWS)

    for row in _pair_rows(batches):
        held.append(row)
        size += len(row[2])
        if size >= PAIR_ROWS:
            yield from packed()
            held, size = [], 0
    if held:
        yield from packed()


def pairs(words: DataFrame) -> DataFrame:
    """(id, n, begin, end, kind) of all pairs of all words."""
    nodes = words.join(trie_nodes(words, False).withColumnRenamed("nodes", "begins"), "id").join(
        trie_nodes(words, True).withColumnRenamed("nodes", "ends"), "id")
    return nodes.select("id", "n", "word", "begins", "ends").mapInArrow(_pairs, "id long, n long, begin long, end long, kind byte")


def neighbours(words: DataFrame) -> DataFrame:
    """(id, n_near, best) for words with a neighbour; `best` is (n, -id) of the most frequent one, ties to the first."""
    # At most one word per letter of the alphabet, and the word itself, meet on a pair.
    met = (pairs(words).groupBy("begin", "end")
           .agg(F.sort_array(F.collect_list(F.struct("n", (-F.col("id")).alias("back"), "kind")), asc=False).alias("all")).where(F.size("all") > 1))
    met = met.select(F.filter("all", lambda m: m["kind"] > 0).alias("skipped"), F.filter("all", lambda m: m["kind"] == 0).alias("whole"),
                     F.filter("all", lambda m: m["kind"] == 2).alias("longer"))

    def rank(m: Column) -> Column:
        return F.when(m.isNotNull(), F.struct(m["n"].alias("n"), m["back"].alias("back")))

    def seen(m: Column) -> Column:
        """A word of the skipped ones: the others of them, and the word itself where this is the first of a run."""
        shorter = F.when(m["kind"] == 2, F.get("whole", F.lit(0)))
        other = F.when(m["back"] == F.get("skipped", F.lit(0))["back"], F.get("skipped", F.lit(1))).otherwise(F.get("skipped", F.lit(0)))
        return F.struct((-m["back"]).alias("id"), (F.size("skipped") - 1 + shorter.isNotNull().cast("int")).cast("long").alias("near"),
                        F.greatest(rank(other), rank(shorter)).alias("best"))

    def of_whole(m: Column) -> Column:
        return F.struct((-m["back"]).alias("id"), F.size("longer").cast("long").alias("near"), rank(F.get("longer", F.lit(0))).alias("best"))

    each = met.select(F.explode(F.concat(F.transform("skipped", seen), F.transform("whole", of_whole))).alias("e")).select("e.*").where("near > 0")
    return each.groupBy("id").agg(F.sum("near").alias("n_near"), F.max("best").alias("best"))


def variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """Of (id, word, n): word, form, root, n, n_near, form_n."""
    near = neighbours(words)
    judged = words.join(near, "id", "left").withColumn("n_near", F.coalesce("n_near", F.lit(0).cast("long")))
    form = F.when(F.col("best.n") >= ratio * F.col("n"), -F.col("best.back"))
    judged = materialise(judged.select("id", "word", "n", "n_near", form.alias("form_id"), F.when(form.isNotNull(), F.col("best.n")).alias("form_n")), "judged")
    names = words.select("id", "word")
    roots = followed(judged.where("form_id IS NOT NULL").select("id", F.col("form_id").alias("up")))
    named = roots.join(names.toDF("up", "root"), "up").select("id", "root")
    return (judged.join(names.toDF("form_id", "form"), "form_id", "left").join(named, "id", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))


def followed(steps: DataFrame) -> DataFrame:
    """(id, up) without cycles to (id, up) with the last that can be reached. The way covered doubles in every round."""
    held = materialise(steps, "steps")
    while True:
        further = held.toDF("up", "next")
        held = materialise(held.join(further, "up", "left").select("id", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("moved")), "steps")
        if held.where("moved").isEmpty():
            return held.drop("moved")
        held = held.drop("moved")


def grouped(docs: DataFrame, least_length: int = 7, least_count: int = 2, every: int | None = None, ratio: int = 10) -> DataFrame:
    """Spelling variants of a table of documents; with `every`, some words lose a letter before."""
    found = runs(docs, least_length)
    word = F.col("run") if every is None else thinned(found, every)
    return variants(counted(found.select(word.alias("word")), least_length, least_count), ratio)
