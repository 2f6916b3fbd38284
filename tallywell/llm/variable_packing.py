"""Best-fit packing into sequences of several permitted lengths.

A sequence of capacity c costs `overhead + c * (1 + c / span)`: a fixed part, a part that grows with its ids, and
attention, which grows with the square. Pieces of documents come longest first. A piece goes to the open sequence, of any
capacity, with the least room that is enough. If there is none, every capacity that may be opened is filled on trial: with
the piece, then always with the longest piece to come that fits. The one is opened whose cost per id, at the length that
the filling needs, is least. In the end every sequence is downsized to the smallest permitted capacity that holds its contents.

Which capacities may be opened is chosen for the shard as a whole, as a short sequence takes the small pieces away that would
have filled a long one. A plan is a set of capacities. The search begins with the cheaper of two plans, all capacities and the
longest alone, and goes on to the cheapest plan with one capacity more or less while that costs less.

Pieces carry only their lengths, so what is shuffled is a few numbers per document, unless the ids are wanted too. They are dealt into shards by hash,
as many as the texts' bytes ask for, and shards are packed by themselves.

Defined results: null and empty texts give no piece; a document longer than the largest capacity is cut into pieces that
are the whole document in order; rows without doc_id are packed under a null id; rows that repeat are packed each; an
empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallywell.llm.common import small_batches
from tallywell.llm.packing import SHARD as ID_SHARD
from tallywell.llm.packing import RoomTree, by_shard, dealt, shards_of
from tallywell.llm.tokens import END_ID, TOKENIZER, pieces_of

CAPACITIES = (512, 1024, 2048, 4096, 8192)
SHARD = 64 << 20


def cost(capacity: int, overhead: float = 64.0, span: float = 16384.0) -> float:
    return overhead + capacity * (1 + capacity / span)


class Coming:
    """The pieces still to come, by size. They leave longest first, so only the longest size is ever partly gone."""

    def __init__(self, sizes: Sequence[int]):
        counts: dict[int, int] = {}
        for size in sizes:
            counts[size] = counts.get(size, 0) + 1
        self.sizes = sorted(counts)
        self.counts = [counts[size] for size in self.sizes]
        self.kinds = len(self.sizes)

    def leave(self) -> None:
        """The longest piece is packed."""
        self.counts[self.kinds - 1] -= 1
        if not self.counts[self.kinds - 1]:
            self.kinds -= 1

    def filling(self, room: int) -> int:
        """Ids that go into the room if always the longest piece that fits is taken."""
        left, kinds = room, self.kinds
        while left and (kinds := bisect_right(self.sizes, left, 0, kinds)):
            kinds -= 1
            left -= min(self.counts[kinds], left // self.sizes[kinds]) * self.sizes[kinds]
        return room - left


def packed_by(sizes: Sequence[int], plan: Sequence[int], capacities: Sequence[int], price: Callable[[int], float] = cost) -> list[tuple[int, list[int]]]:
    """(capacity, members) of each sequence if only capacities of `plan` are opened, for sizes in decreasing order."""
    plan, capacities = sorted(plan), sorted(capacities)
    tree, rooms, opened = RoomTree(plan[-1]), [[] for _ in range(plan[-1] + 1)], []
    prices = {c: price(c) for c in capacities}
    coming = Coming(sizes)

    def per_id(capacity: int, size: int) -> tuple[float, int]:
        ids = size + coming.filling(capacity - size)
        return prices[capacities[bisect_left(capacities, ids)]] / ids, capacity

    for i, size in enumerate(sizes):
        room = tree.least(size)
        coming.leave()
        if room is None:
            room = min(per_id(c, size) for c in plan if c >= size)[1]
            number = len(opened)
            opened.append([])
        else:
            number = heapq.heappop(rooms[room])
            if not rooms[room]:
                tree.set(room, False)
        opened[number].append(i)
        if room > size:
            heapq.heappush(rooms[room - size], number)
            tree.set(room - size, True)
    used = [sum(sizes[i] for i in members) for members in opened]
    return [(capacities[bisect_left(capacities, total)], members) for total, members in zip(used, opened)]


def fit(sizes: Sequence[int], capacities: Sequence[int], price: Callable[[int], float] = cost) -> list[tuple[int, list[int]]]:
    """(capacity, members) of each sequence by the cheapest plan that the search finds, for sizes in decreasing order."""
    if not sizes:
        return []
    capacities = tuple(sorted(capacities))

    @cache
    def total(plan: tuple[int, ...]) -> float:
        return sum(price(c) for c, _ in packed_by(sizes, plan, capacities, price))

    best = min([capacities, capacities[-1:]], key=total)
    while True:
        near = [tuple(sorted(set(best) ^ {c})) for c in capacities]
        near = [plan for plan in near if plan and plan[-1] >= sizes[0]]
        next_best = min(near, key=total, default=best)
        if total(next_best) >= total(best):
            return packed_by(sizes, best, capacities, price)
        best = next_best


def _pack(capacities: tuple[int, ...], price: Callable[[int], float], ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in by_shard(batches):
            sizes, starts = shard.column("n").to_pylist(), shard.column("start").to_pylist()
            owners, numbers = shard.column("doc_id").to_pylist(), shard.column("piece").to_pylist()
            contents = shard.column("ids").to_pylist() if ids else []
            packed = fit(sizes, capacities, price)
            for low in range(0, len(packed), 1024):
                part = packed[low : low + 1024]
                lists = [[[column[i] for i in members] for _, members in part] for column in (owners, numbers, starts, sizes)]
                matrix = [b"".join(contents[i] for i in members) + np.full(c - used, END_ID, "<u2").tobytes()
                          for (c, members), used in zip(part, map(sum, lists[3]))] if ids else []
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard.column("shard")[0].as_py()] * len(part), pa.int32()), pa.array(range(low, low + len(part)), pa.int64()),
                     pa.array([c for c, _ in part], pa.int32()), pa.array([sum(row) for row in lists[3]], pa.int32()),
                     pa.array([price(c) for c, _ in part], pa.float64()),
                     pa.array(lists[0], pa.list_(pa.int64())), pa.array(lists[1], pa.list_(pa.int32())),
                     pa.array(lists[2], pa.list_(pa.int64())), pa.array(lists[3], pa.list_(pa.int32()))] + [pa.array(matrix, pa.binary())] * ids,
                    ["shard", "sequence", "capacity", "used", "cost", "doc_ids", "pieces", "starts", "lengths"] + ["input_ids"] * ids)

    return run


def pack(docs: DataFrame, capacities: Sequence[int] = CAPACITIES, price: Callable[[int], float] = cost, path: str = TOKENIZER,
         ids: bool = False) -> DataFrame:
    """Per sequence: shard, sequence, capacity, used, cost, and of its segments doc_ids, pieces, starts, lengths.

    With `ids` also input_ids: `capacity` little-endian uint16 values, END_ID behind the contents. Shards are then smaller.
    """
    pieces = pieces_of(docs, max(capacities), path, ids=ids)
    small_batches(docs.sparkSession)
    return dealt(pieces, shards_of(docs, ID_SHARD if ids else SHARD), ["doc_id", "piece", "ids" if ids else "n"], spread=not ids).mapInArrow(
        _pack(tuple(capacities), price, ids),
        "shard int, sequence long, capacity int, used int, cost double, doc_ids array<long>, pieces array<int>, "
        "starts array<long>, lengths array<int>" + ", input_ids binary" * ids)
