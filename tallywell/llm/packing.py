"""Token sequences of one length: best-fit-decreasing packing, written as id matrices.

Documents are tokenized and cut into pieces of at most the sequence length. Pieces are dealt into shards by hash; shards
are as many as the texts' bytes ask for, so a shard's tokens always fit in a task, whatever the size of the table. Each
shard is packed by itself: pieces come longest first, and each goes to the open sequence with the least room that is
still enough, which a segment tree over room sizes finds in as many steps as the sequence length has bits.

A packed row holds the ids of one sequence (padded with END_ID), the cumulative lengths of its segments, and the position
of every id within its segment, so attention and positions can be reset at segment starts. A document's pieces, in
order, are the whole document; nothing is cut off.

Defined results: null and empty texts give no segment; rows without doc_id are packed under a null id; rows that repeat
are packed each; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywell.llm.common import small_batches
from tallywell.llm.tokens import END_ID, TOKENIZER, pieces_of

#: Bytes of text to a shard. A byte is one id at most.
SHARD = 8 << 20


class RoomTree:
    """Which room sizes some open sequence has, as a segment tree over 0..size."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.some = bytearray(2 * self.leaves)

    def set(self, room: int, here: bool) -> None:
        node = room + self.leaves
        self.some[node] = here
        while node > 1:
            node >>= 1
            now = self.some[2 * node] | self.some[2 * node + 1]
            if self.some[node] == now:
                return
            self.some[node] = now

    def least(self, wanted: int) -> int | None:
        """The smallest size that is there and at least `wanted`."""
        node = wanted + self.leaves
        if self.some[node]:
            return wanted
        while node > 1:
            if not node & 1 and self.some[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.some[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return None


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Members of each bin, for sizes in decreasing order; among bins of equal room the oldest is taken."""
    tree, rooms, bins = RoomTree(capacity), [[] for _ in range(capacity + 1)], []
    for i, size in enumerate(sizes):
        room = tree.least(size)
        if room is None:
            number, room = len(bins), capacity
            bins.append([])
        else:
            number = heapq.heappop(rooms[room])
            if not rooms[room]:
                tree.set(room, False)
        bins[number].append(i)
        if room > size:
            heapq.heappush(rooms[room - size], number)
            tree.set(room - size, True)
    return bins


def shards_of(docs: DataFrame, size: int = SHARD) -> int:
    """So many shards that none has much more than `size` bytes of text."""
    total = docs.agg(F.sum(F.octet_length("text").cast("long")).alias("bytes")).first()["bytes"]
    return (total or 0) // size + 1


def by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The shards, one table each, of batches that are ordered by shard."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        shards = batch.column("shard").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
        for low, high in zip(cuts, cuts[1:]):
            if low == high:
                continue
            if held and held[-1].column("shard")[0].as_py() != int(shards[low]):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(low, high - low))
    if held:
        yield pa.Table.from_batches(held)


def dealt(pieces: DataFrame, shards: int, key: list[str], spread: bool = False) -> DataFrame:
    """Pieces by shard, longest first. Spark merges partitions of few bytes into one task; with `spread` it leaves them."""
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64(*key), F.lit(shards)).cast("int"))
    parts = [min(shards, int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")))] if spread else []
    return pieces.repartition(*parts, "shard").sortWithinPartitions("shard", F.desc("n"), "doc_id", "piece")


def _pack(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in by_shard(batches):
            sizes, ids = shard.column("n").to_pylist(), shard.column("ids").to_pylist()
            owners, numbers = shard.column("doc_id").to_pylist(), shard.column("piece").to_pylist()
            bins = best_fit(sizes, length)
            for low in range(0, len(bins), 256):
                rows: dict[str, list] = {name: [] for name in ("doc_ids", "pieces", "cu_seqlens", "input_ids", "position_ids")}
                for members in bins[low : low + 256]:
                    ends = np.cumsum([0] + [sizes[i] for i in members])
                    spare = length - int(ends[-1])
                    places = np.arange(length) - np.repeat(np.append(ends[:-1], ends[-1]), [*[sizes[i] for i in members], spare])
                    rows["doc_ids"].append([owners[i] for i in members])
                    rows["pieces"].append([numbers[i] for i in members])
                    rows["cu_seqlens"].append(ends.tolist())
                    rows["input_ids"].append(b"".join(ids[i] for i in members) + np.full(spare, END_ID, "<u2").tobytes())
                    rows["position_ids"].append(places.astype("<u2").tobytes())
                count = len(rows["doc_ids"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard.column("shard")[0].as_py()] * count, pa.int32()), pa.array(range(low, low + count), pa.int64()),
                     pa.array(rows["doc_ids"], pa.list_(pa.int64())), pa.array(rows["pieces"], pa.list_(pa.int32())),
                     pa.array(rows["cu_seqlens"], pa.list_(pa.int32())), pa.array(rows["input_ids"], pa.binary()),
                     pa.array(rows["position_ids"], pa.binary())],
                    ["shard", "row", *rows])

    return run


def pack(docs: DataFrame, length: int = 2048, path: str = TOKENIZER) -> DataFrame:
    """Per sequence: shard, row, doc_ids, pieces, cu_seqlens, input_ids, position_ids (binary, `length` little-endian uint16)."""
    if not 2 <= length <= 1 << 16:
        raise ValueError("a sequence has 2 to 65536 ids")
    pieces = pieces_of(docs, length, path).drop("start")
    small_batches(docs.sparkSession)
    return dealt(pieces, shards_of(docs), ["doc_id", "piece", "ids"]).mapInArrow(
        _pack(length), "shard int, row long, doc_ids array<long>, pieces array<int>, cu_seqlens array<int>, "
                       "input_ids binary, position_ids binary")


def write_matrices(packed: DataFrame, path: str) -> None:
    """One folder with the matrices of all shards in the order of their rows; a reader stacks `input_ids` row by row."""
    packed.repartition("shard").sortWithinPartitions("shard", "row").write.mode("errorifexists").parquet(path)
