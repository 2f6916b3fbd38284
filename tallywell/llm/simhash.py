"""Near duplicates by SimHash: fingerprints cut into pigeonhole blocks, joined on blocks, verified by Hamming distance.

A document's fingerprint has 64 bits: each is 1 if it is set in more than half of the XXH64 hashes of its shingles, repeats
included. Two fingerprints link when at most `distance` bits differ, and documents in one connected component are one group.

Blocks: the 64 bits are cut into `blocks` runs. Of two fingerprints within the distance at most `distance` runs differ, so
some choice of blocks - distance runs is equal in both. There is one key per choice, so a linked pair shares a key without
exception. More blocks give longer keys and more of them; `block_count` takes the fewest whose keys have at least as many
bits as the table's number of fingerprints needs, so that unrelated fingerprints seldom meet, at any size.

Copies and hot keys: equal fingerprints are one node, so a group of copies costs one row. No bucket is expanded into pairs:

    1. every member of a bucket is compared with the bucket's smallest member; pairs within the distance are links;
    2. members that are connected by now need no further look. Where a bucket still holds several components, the members
       outside its largest one are compared with all its members, HEADS of them at a time as one matrix of differences;
       a block gives one link for each two components that it finds connected.

So every link between different fingerprints is found or implied, and a row per pair never exists.

Defined results: a null or empty text, or one of blanks only, has fingerprint zero and links like any other. A text with
fewer words than a shingle has is one shingle. A row without doc_id gets its fingerprint and no component. Rows that repeat
a doc_id keep their own fingerprints, which belong to one component. Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywell.llm.common import classes_of_links, per_batch
from tallywell.llm.words import BLANK
from tallywell.session import materialise

BITS = 64
SEED = 42
#: Fewest blocks, and key bits beyond the logarithm of the number of fingerprints.
LEAST_BLOCKS = 7
SPARE_BITS = 4
#: Members of a bucket that are compared with all others at once.
HEADS = 4096
#: Hashes whose bits are counted at once, and bytes of text taken at once.
COUNTED = 1 << 15
PIECE = 1 << 20
#: Packed counters hold a byte, so so many hashes are added before they are widened.
_LANE = 255


def _bit_sums(hashes: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits, lowest first, is set."""
    total = np.zeros(BITS, np.int64)
    for low in range(0, len(hashes), COUNTED):
        part = hashes[low : low + COUNTED]
        lanes = np.unpackbits(part.view(np.uint8), bitorder="little").view(np.uint64).reshape(len(part), BITS // 8)
        sums = np.add.reduceat(lanes, np.arange(0, len(part), _LANE), axis=0)
        total += sums.view(np.uint8).reshape(len(sums), BITS).sum(axis=0, dtype=np.int64)
    return total


def _pieces(text: bytes) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """Words of a text about PIECE bytes at a time: the piece, and first byte and end of each of its words."""
    at = 0
    while at < len(text):
        end = min(at + PIECE, len(text))
        while end < len(text) and not BLANK[text[end - 1]]:
            end += 1
        inside = np.frombuffer(text[at:end].translate(BLANK), np.int8) == 0
        edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        yield text[at:end], edges[0::2], edges[1::2]
        at = end


def fingerprint(text: bytes, size: int) -> int:
    """The fingerprint of a text in lower case, as an unsigned number."""
    total, count, carried, digest = np.zeros(BITS, np.int64), 0, b"", xxhash.xxh64_intdigest
    for piece, starts, ends in _pieces(text):
        if not len(starts):
            continue
        # Words with exactly one blank between them, so that a run of words is a run of bytes.
        lengths = ends - starts
        words = piece[starts[0] : ends[-1]]
        if (starts[1:] != ends[:-1] + 1).any():
            words = b" ".join(piece[a:b] for a, b in zip(starts.tolist(), ends.tolist()))
        else:
            words = words.translate(_ONE_BLANK)
        if carried:
            before = np.fromiter(map(len, carried.split(b" ")), np.int64)
            lengths, words = np.concatenate([before, lengths]), carried + b" " + words
        stops = np.cumsum(lengths + 1) - 1
        begins = stops - lengths
        if len(stops) >= size:
            hashes = np.array([digest(words[a:b], SEED) for a, b in zip(begins[: len(begins) - size + 1].tolist(), stops[size - 1 :].tolist())], np.uint64)
            total += _bit_sums(hashes)
            count += len(hashes)
        carried = words[begins[max(0, len(begins) - size + 1)] :] if size > 1 else b""
    if not count and carried:
        return digest(carried, SEED)
    return int(((2 * total > count).astype(np.uint64) << np.arange(BITS, dtype=np.uint64)).sum(dtype=np.uint64))


_ONE_BLANK = bytes(32 if BLANK[i] else i for i in range(256))


def _fingerprint_rows(size: int):
    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = batch.column("text").cast(pa.binary())
        marks = np.array([fingerprint((text.as_py() or b"").lower(), size) for text in texts], np.uint64)  # of bytes: A-Z only
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(marks.view(np.int64))], ["doc_id", "bits"])

    return work


def block_count(fingerprints: int, distance: int) -> int:
    """The fewest blocks whose keys are long enough for so many fingerprints."""
    wanted = math.log2(max(2, fingerprints)) + SPARE_BITS
    blocks = max(LEAST_BLOCKS, distance + 1)
    while blocks < BITS and sum(sorted(_widths(blocks))[: blocks - distance]) < wanted:
        blocks += 1
    return blocks


def _widths(blocks: int) -> list[int]:
    return [BITS * (i + 1) // blocks - BITS * i // blocks for i in range(blocks)]


def key_masks(blocks: int, distance: int) -> list[int]:
    """A mask for every choice of blocks - distance blocks, as signed numbers."""
    widths = _widths(blocks)
    runs = [((1 << w) - 1) << sum(widths[:i]) for i, w in enumerate(widths)]
    masks = [sum(choice) for choice in itertools.combinations(runs, blocks - distance)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def linked(nodes: DataFrame, given: DataFrame, distance: int = 4, blocks: int | None = None) -> DataFrame:
    """Distinct fingerprints (bits) to (id, component_id) for those that have a link; ids are fingerprints.

    Links (a, b) in `given` hold whatever the distance.
    """
    blocks = blocks or block_count(nodes.count(), distance)
    masks = F.array(*[F.lit(m).cast("long") for m in key_masks(blocks, distance)])
    # The number of the choice is part of the key: the same value under two choices is two keys.
    keys = (nodes.select("bits", F.posexplode(masks).alias("choice", "mask"))
            .select(F.xxhash64("choice", F.col("bits").bitwiseAND(F.col("mask"))).alias("key"), "bits"))
    heads = keys.groupBy("key").agg(F.min("bits").alias("head"), F.count("*").alias("n")).where("n > 1")
    buckets = materialise(keys.join(heads.hint("merge"), "key"), "buckets")
    near = F.bit_count(F.col("head").bitwiseXOR(F.col("bits"))) <= distance
    first = materialise(buckets.where("bits <> head").where(near).select(F.col("head").alias("a"), F.col("bits").alias("b")).unionAll(given).distinct(), "links")
    labels = classes_of_links(first)
    members = buckets.where("n > 2").select("key", "bits").join(
        labels.withColumnRenamed("id", "bits").hint("merge"), "bits", "left").select("key", "bits", F.coalesce("component_id", "bits").alias("label"))
    rest = materialise(_links_in_mixed_buckets(materialise(members, "members"), distance), "links")
    return classes_of_links(first.unionAll(rest))


def _links_in_mixed_buckets(members: DataFrame, distance: int) -> DataFrame:
    """Links between members of a bucket that belong to different components so far."""
    sizes = members.groupBy("key", "label").agg(F.count("*").alias("n"))
    mixed = (sizes.groupBy("key").agg(F.max(F.struct("n", F.col("label").alias("most"))).alias("top"), F.sum("n").alias("all"), F.count("*").alias("labels"))
             .where("labels > 1").select("key", F.col("top.most").alias("most"), F.ceil((F.col("all") - F.col("top.n")) / HEADS).alias("blocks")))
    placed = members.join(mixed.hint("merge"), "key")
    heads = placed.where("label <> most").select("key", F.pmod(F.xxhash64("bits"), "blocks").alias("block"), F.lit(0).alias("role"), "bits", "label")
    others = placed.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("role"), "bits", "label")
    rows = heads.unionAll(others).repartition("key", "block").sortWithinPartitions("key", "block", "role")
    return rows.mapInArrow(_compare(distance), "a long, b long").distinct()


def _compare(distance: int):
    """Streams rows ordered by (key, block, role): a block's heads, then all members that they are compared with."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, held, told = None, [], set()
        for batch in batches:
            keys, blocks, roles, bits, labels = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "block", "role", "bits", "label"))
            cuts = np.flatnonzero((np.diff(keys) != 0) | (np.diff(blocks) != 0) | (np.diff(roles) != 0)) + 1
            left, right = [], []
            for low, high in itertools.pairwise([0, *cuts.tolist(), len(keys)]):
                if low == high:
                    continue
                if where != (keys[low], blocks[low]):
                    where, held, told = (keys[low], blocks[low]), [], set()
                if roles[low] == 0:
                    held.append((bits[low:high], labels[low:high]))
                    continue
                if len(held) > 1:
                    held = [tuple(np.concatenate(column) for column in zip(*held))]
                own, names = held[0]
                for at in range(low, high, 256):
                    upto = min(high, at + 256)
                    close = np.bitwise_count((own[:, None] ^ bits[None, at:upto]).view(np.uint64)) <= distance
                    close &= names[:, None] != labels[None, at:upto]
                    x, y = np.nonzero(close)
                    for a, b in set(zip(names[x].tolist(), labels[at + y].tolist())) - told:
                        told |= {(a, b), (b, a)}
                        left.append(a)
                        right.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return run


def near_duplicates(docs: DataFrame, size: int = 4, distance: int = 4, blocks: int | None = None) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable), kept."""
    marked = materialise(per_batch(docs.select("doc_id", "text"), _fingerprint_rows(size), "doc_id long, bits long"), "fingerprints")
    with_id = marked.where("doc_id IS NOT NULL")
    nodes = materialise(with_id.groupBy("bits").agg(F.min("doc_id").alias("first_id")), "nodes")
    # Fingerprints of rows that repeat a doc_id belong together.
    repeats = with_id.groupBy("doc_id").agg(F.min("bits").alias("a"), F.max("bits").alias("z")).where("a <> z").select("doc_id", "a")
    given = with_id.join(repeats, "doc_id").where("bits <> a").select("a", F.col("bits").alias("b"))
    groups = linked(nodes.select("bits"), given, distance, blocks).withColumnRenamed("id", "bits").withColumnRenamed("component_id", "label")
    labelled = nodes.join(groups.hint("merge"), "bits", "left").select("bits", "first_id", F.coalesce("label", "bits").alias("label"))
    smallest = labelled.groupBy("label").agg(F.min("first_id").alias("component_id"))
    named = materialise(labelled.join(smallest.hint("merge"), "label").select("bits", "component_id"), "components")
    component = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return marked.join(named.hint("merge"), "bits", "left").select(
        "doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"))
