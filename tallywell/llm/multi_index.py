"""Near duplicates: min-hash signatures joined through several indexes that guarantee a Hamming distance.

A document's set holds the hashes of its distinct shingles. Its signature has SYMBOLS values of 16 bits, each taken
from the smallest of the set under one hash function; two sets of similarity s differ in a symbol with probability of at
most 1 - s, so a similarity limit gives a limit on the number of differing symbols, `allowed_errors`, which all but one
in MISS pairs at the very limit stay below.

Multi-index join: the signature is cut into chunks so that by pigeonhole some chunk of any pair within the limit has at
most one differing symbol. Each chunk enumerates that error: it gives one key per symbol, over the chunk without that
symbol. A pair within the limit then shares at least one of SYMBOLS keys, without exception. At limits of 0.8 and more a
key covers two symbols at least, 32 bits, so unrelated documents seldom meet in a bucket however many there are.

No bucket is ever expanded into all of its pairs:

    1. equal sets are one class, and only its smallest document goes on;
    2. every member of a bucket is paired with the bucket's smallest member; pairs beyond the signature limit or with
       sizes too different are dropped, and the rest are confirmed on full sets, one partner each first, then those
       pairs that the first round left unconnected;
    3. members of a bucket that are connected by now need no further look. In buckets that still hold several
       components, members with a partner of another component within the signature limit are kept; members that such
       buckets hold together form a cluster. All texts of a cluster are compared with those outside its largest
       component, a block of BLOCK texts at a time and all of them at once, and one link is given per text and
       component. So a link between any two different texts is found, but pairs are never rows.

Confirmation sends the first text of a pair once per few hundred partners and streams the partners past it.

Lists of ids grow with the corpus like the texts, so all joins are merged by sorting, at every size; nothing is broadcast.

Defined results: documents without words, or without a doc_id, are linked with nothing and kept; rows that repeat a
doc_id are one document. Other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywell.llm.common import classes_of_links, merged, per_batch, small_batches
from tallywell.llm.words import as_bytes, chunks, mix, shingle_sets, word_hashes
from tallywell.session import materialise

SYMBOLS = 64
LONGS = SYMBOLS // 4
#: At most this share of pairs at the very similarity limit differ in more symbols than allowed.
MISS = 1e-9
#: Partners that one copy of a text serves.
PARTNERS = 256
#: Texts of a cluster that are compared with all others at once.
BLOCK = 128
#: Signatures on either side of a cell, into which the comparison of a crowded bucket is cut.
SIDE = 1024
_ODD = np.random.default_rng(77).integers(1, 1 << 31, SYMBOLS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_WEIGHT = np.random.default_rng(78).integers(1, 1 << 63, SYMBOLS, dtype=np.uint64) | np.uint64(1)
_SIGNATURE = [f"s{i}" for i in range(LONGS)]


def allowed_errors(similarity: float, symbols: int = SYMBOLS, miss: float = MISS) -> int:
    """The smallest d with P(more than d of the symbols differ) <= miss at the given similarity."""
    p, tail, d = 1 - similarity, 1.0, -1
    while tail > miss:
        d += 1
        tail -= math.comb(symbols, d) * p**d * (1 - p) ** (symbols - d)
    return d


def chunk_of_symbol(errors: int, symbols: int = SYMBOLS) -> np.ndarray:
    """The chunk of each symbol, with so many chunks that one has at most one error."""
    count = errors // 2 + 1
    return np.arange(symbols) * count // symbols


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(number of sets, SYMBOLS) values; zero for an empty set."""
    result = np.zeros((len(sets), SYMBOLS), np.uint16)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        values = (np.concatenate([sets[i] for i in full]) >> np.uint64(32)).astype(np.uint32)
        starts = np.concatenate([[0], np.cumsum([len(sets[i]) for i in full])])[:-1]
        turned = np.empty_like(values)
        for j in range(SYMBOLS):
            np.multiply(values, _ODD[j], out=turned)
            least = np.minimum.reduceat(turned, starts)
            result[full, j] = (least * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return result


def _signature_rows(size: int):
    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = [text.lower() for text in as_bytes(batch.column("text"))]  # of bytes: A-Z only
        counts, names, marks = [], [], []
        for low, high in chunks(texts):
            sets = shingle_sets(*word_hashes(texts[low:high]), size)
            counts += [len(s) for s in sets]
            names += [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            marks.append(signatures(sets))
        longs = np.concatenate(marks).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(names, pa.binary()),
             *[pa.array(np.ascontiguousarray(longs[:, i])) for i in range(LONGS)]],
            ["doc_id", "n_shingles", "set_name", *_SIGNATURE])

    return work


def index_keys(symbols: np.ndarray, chunk: np.ndarray) -> np.ndarray:
    """One key per symbol: the hash of its chunk without it."""
    terms = (symbols.astype(np.uint64) + np.uint64(1)) * _WEIGHT
    keys = np.empty_like(terms)
    for c in range(chunk.max() + 1):
        own = np.flatnonzero(chunk == c)
        keys[:, own] = terms[:, own].sum(axis=1, keepdims=True, dtype=np.uint64) - terms[:, own]
    return mix(keys + _WEIGHT[::-1])


def _key_rows(errors: int):
    chunk = chunk_of_symbol(errors)

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        longs = np.stack([batch.column(s).to_numpy(zero_copy_only=False) for s in _SIGNATURE], axis=1)
        keys = index_keys(np.ascontiguousarray(longs).view(np.uint16).reshape(len(longs), SYMBOLS), chunk)
        ids = batch.column("id").to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(ids, SYMBOLS))], ["key", "id"])

    return work


def _distance(left: str, right: str) -> Column:
    """The number of differing symbols of two signatures.

    Each symbol of the difference is folded into its lower 14 bits, and what is added carries into bit 14 if one of them
    is set. The difference stands in the expression twice, so that plans and the code made from them stay small.
    """
    def differing(name: str) -> Column:
        x = F.col(f"{left}.{name}").bitwiseXOR(F.col(f"{right}.{name}"))
        low = F.lit(0x3FFF3FFF3FFF3FFF)
        folded = x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(low)
        return F.bit_count((folded + low).bitwiseAND(F.lit(0x4000400040004000)))

    return reduce(Column.__add__, [differing(s) for s in _SIGNATURE])


def _near(left: str, right: str, errors: int, percent: int) -> Column:
    """What a pair must pass before its sets are compared."""
    a, b = F.col(f"{left}.n_shingles"), F.col(f"{right}.n_shingles")
    return (F.least(a, b) * 100 >= F.greatest(a, b) * percent) & (_distance(left, right) <= errors)


def _compare(size: int, percent: int):
    """Streams rows ordered by (a, part, partner): the row without partner brings the text that the others meet."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, own = None, None
        for batch in batches:
            texts = [text.lower() for text in as_bytes(batch.column("text"))]
            heads, partners = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            left, right = [], []
            for low, high in chunks(texts):
                for i, found in zip(range(low, high), shingle_sets(*word_hashes(texts[low:high]), size)):
                    if partners[i] is None:
                        head, own = heads[i], found
                        continue
                    assert head == heads[i]
                    common = len(np.intersect1d(own, found, assume_unique=True))
                    if 100 * common >= percent * (len(own) + len(found) - common):
                        left.append(head)
                        right.append(partners[i])
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return run


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Of (a, b) pairs those whose full sets are similar; texts is (id, text)."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).alias("parts"))
    dealt = pairs.join(merged(parts), "a").select("a", "b", F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part"))
    members = dealt.join(merged(texts.withColumnRenamed("id", "b")), "b").select("a", "part", "b", "text")
    heads = (dealt.select("a", "part").distinct().join(merged(texts.withColumnRenamed("id", "a")), "a")
             .select("a", "part", F.lit(None).cast("long").alias("b"), "text"))
    rows = members.unionAll(heads).repartition("a", "part").sortWithinPartitions("a", "part", F.asc_nulls_first("b"))
    small_batches(rows.sparkSession)
    return rows.mapInArrow(_compare(size, percent), "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """Per document: doc_id, n_shingles, class_id (smallest document with an equal set), component_id, kept."""
    percent, errors = round(similarity * 100), allowed_errors(similarity)
    documents = docs.select("doc_id", "text")
    schema = "doc_id long, n_shingles long, set_name binary, " + ", ".join(f"{s} long" for s in _SIGNATURE)
    prepared = materialise(per_batch(documents, _signature_rows(size), schema), "signatures")
    classes = materialise(
        prepared.where("set_name IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_name")
        .agg(F.min("doc_id").alias("id"), *[F.min(c).alias(c) for c in ("n_shingles", *_SIGNATURE)]), "classes")
    keys = per_batch(classes.select("id", *_SIGNATURE), _key_rows(errors), "key long, id long")
    heads = keys.groupBy("key").agg(F.min("id").alias("head"), F.count("*").alias("n")).where("n > 1").drop("n")
    buckets = materialise(keys.join(merged(heads), "key"), "buckets")

    marked = merged(classes.select("id", "n_shingles", *_SIGNATURE))
    spokes = buckets.where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct()
    pairs = materialise(
        spokes.join(marked.alias("x"), F.col("a") == F.col("x.id")).join(marked.alias("y"), F.col("b") == F.col("y.id"))
        .where(_near("x", "y", errors, percent)).select("a", "b"), "pairs")
    wanted = merged(buckets.select("id").distinct())
    texts = materialise(documents.withColumnRenamed("doc_id", "id").join(wanted, "id").dropDuplicates(["id"]), "texts")

    first = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = materialise(confirmed(first, texts, size, percent), "links")
    rest = _unconnected_spokes(pairs, first, classes_of_links(links))
    links = links.unionAll(materialise(confirmed(rest, texts, size, percent), "links"))
    links = links.unionAll(_links_of_members(buckets, marked, texts, classes_of_links(links), size, errors, percent))
    labels = classes_of_links(links)

    named = classes.select("set_name", F.col("id").alias("class_id"))
    component = F.coalesce("component_id", "class_id", "doc_id")
    return (prepared.select("doc_id", "n_shingles", "set_name").join(merged(named), "set_name", "left")
            .withColumn("class_id", F.when(F.col("doc_id").isNotNull(), F.col("class_id")))
            .join(merged(labels.withColumnRenamed("id", "class_id")), "class_id", "left")
            .select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"),
                    component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")))


def _label(rows: DataFrame, labels: DataFrame, name: str, to: str) -> DataFrame:
    """Adds the component of the id in column `name`; an id without links is its own."""
    return (rows.join(merged(labels.select(F.col("id").alias(name), F.col("component_id").alias(to))), name, "left")
            .withColumn(to, F.coalesce(to, name)))


def _unconnected_spokes(pairs: DataFrame, first: DataFrame, labels: DataFrame) -> DataFrame:
    rest = pairs.join(merged(first), ["a", "b"], "left_anti")
    return materialise(_label(_label(rest, labels, "a", "la"), labels, "b", "lb").where("la <> lb").select("a", "b"), "pairs")


def _compare_blocks(size: int, percent: int):
    """Streams rows ordered by (cluster, block, role): first a block's texts, then all texts that they are compared with."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, values, owners, sizes, told = None, [], None, None, None, set()
        for batch in batches:
            texts = [text.lower() for text in as_bytes(batch.column("text"))]
            where = list(zip(batch.column("cluster").to_pylist(), batch.column("block").to_pylist()))
            roles, ids, labels = (batch.column(c).to_pylist() for c in ("role", "id", "label"))
            left, right = [], []
            for low, high in chunks(texts):
                for i, found in zip(range(low, high), shingle_sets(*word_hashes(texts[low:high]), size)):
                    if where[i] != block:
                        block, held, values, told = where[i], [], None, set()
                    if roles[i] == 0:
                        held.append((ids[i], labels[i], found))
                        continue
                    if values is None:
                        values = np.concatenate([s for _, _, s in held])
                        sizes = np.array([len(s) for _, _, s in held])
                        order = np.argsort(values, kind="stable")
                        values, owners = values[order], np.repeat(np.arange(len(held)), sizes)[order]
                    begin, end = np.searchsorted(values, found), np.searchsorted(values, found, "right")
                    counts = end - begin
                    at = np.arange(counts.sum()) + np.repeat(begin - (np.cumsum(counts) - counts), counts)
                    common = np.bincount(owners[at], minlength=len(held))
                    for k in np.flatnonzero(100 * common >= percent * (sizes + len(found) - common)).tolist():
                        other, label, _ = held[k]
                        if label != labels[i] and (other, labels[i]) not in told:
                            told.add((other, labels[i]))
                            left.append(other)
                            right.append(ids[i])
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return run


def _links_of_members(buckets: DataFrame, marked: DataFrame, texts: DataFrame, labels: DataFrame, size: int, errors: int, percent: int) -> DataFrame:
    """Links between members of a bucket that belong to different components so far."""
    members = _label(buckets, labels, "id", "label")
    sizes = members.groupBy("key", "label").agg(F.count("*").alias("n"))
    mixed = (sizes.groupBy("key").agg(F.max(F.struct("n", F.col("label").alias("most"))).alias("top"), F.sum("n").alias("all"), F.count("*").alias("labels"))
             .where("labels > 1").select("key", F.col("top.most").alias("most"), F.ceil((F.col("all") - F.col("top.n")) / SIDE).alias("rows"),
                                         F.ceil(F.col("all") / SIDE).alias("columns")))
    open_members = materialise(
        members.join(merged(mixed), "key").join(marked, "id").select("key", "id", "head", "label", "most", "rows", "columns", "n_shingles", *_SIGNATURE), "members")
    # Pairs with the head have been compared: a bucket of two has no other.
    rest = open_members.where("id <> head")
    # A bucket is a grid of cells: one side is dealt to rows and copied to all columns, the other the other way round.
    def placed_on(own: str, all_of: str, cell: tuple[str, str]) -> list[Column]:
        return [F.pmod(F.xxhash64("id"), own).alias(cell[0]), F.explode(F.sequence(F.lit(0).cast("long"), F.col(all_of) - 1)).alias(cell[1])]

    few = rest.where("label <> most").select("*", *placed_on("rows", "columns", ("down", "across"))).alias("x")
    all_ = rest.select("*", *placed_on("columns", "rows", ("across", "down"))).alias("y")
    same = reduce(Column.__and__, [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("key", "down", "across")])
    near = same & (F.col("x.label") != F.col("y.label")) & _near("x", "y", errors, percent)
    open_rows = materialise(few.join(merged(all_), near, "left_semi").select("key", "id", "label")
                            .unionAll(all_.join(merged(few), near, "left_semi").select("key", "id", "label")).distinct(), "open")
    stars = open_rows.join(merged(open_rows.groupBy("key").agg(F.min("id").alias("a"))), "key").select("a", F.col("id").alias("b")).distinct()
    cluster = classes_of_links(stars).withColumnRenamed("component_id", "cluster")
    placed = materialise(open_rows.select("id", "label").distinct().join(merged(cluster), "id"), "placed")
    # Written, so that the join's sides are plain exchanges and the rows of a crowded cluster can be split among tasks.
    tops = materialise(
        placed.groupBy("cluster", "label").agg(F.count("*").alias("n"))
        .groupBy("cluster").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("all"))
        .select("cluster", F.col("top.label").alias("most"), F.ceil((F.col("all") - F.col("top.n")) / BLOCK).alias("blocks")), "tops")
    put = placed.join(merged(tops), "cluster").where("blocks > 0")
    block = F.pmod(F.xxhash64("id"), F.col("blocks"))
    heads = put.where("label <> most").select("cluster", block.alias("block"), F.lit(0).alias("role"), "id", "label")
    others = put.select("cluster", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("role"), "id", "label")
    rows = (heads.unionAll(others).join(merged(texts), "id").select("cluster", "block", "role", "id", "label", "text")
            .repartition("cluster", "block").sortWithinPartitions("cluster", "block", "role", "id"))
    small_batches(rows.sparkSession)
    return materialise(rows.mapInArrow(_compare_blocks(size, percent), "a long, b long"), "links")
