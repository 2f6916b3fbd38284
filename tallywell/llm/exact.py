"""Exact duplicates of incoming batches against immutable snapshots, screened by static binary-fuse filters.

Texts are compared after runs of blanks have become one space; what is compared is their SHA-256 and length. Batches
arrive one after the other. For each:

    1. its rows are grouped by digest among themselves (combined before the shuffle, so a hot text is one row per task);
    2. each earlier snapshot has filters, one per shard of digests, built once and never changed; the batch's distinct
       digests meet the filter of their shard. A filter has no false negatives and about 1 in 256 false positives;
    3. only positives join the snapshot's exact buckets (digest to the document that stays), and for each such pair the
       normalised texts are compared byte by byte;
    4. digests that are not confirmed become the next snapshot, with filters of their own.

The confirmed pairs decide: a batch's group belongs to the snapshot that confirmed it, else to its own batch, and only groups
that belong to the same snapshot are counted together.

A shard holds about SHARD digests whatever the size of the snapshot, so a filter and its peeling stay small.

A group whose rows all lack doc_id is screened and confirmed like any other; its text is found by digest among such rows.

Defined results: a null text counts as empty; empty texts equal each other and texts of blanks only are one space. A row
without doc_id never stays when another row has the same text; of rows with the smallest doc_id twice, both stay. An
empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywell.llm.words import mix
from tallywell.session import materialise

SHARD = 1 << 17
BLANKS = r"[\x20\x09-\x0D]+"


def normalised(text: str | Column = "text") -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, digest (SHA-256 of the normalised text), size (its bytes)."""
    return (docs.select("doc_id", normalised().alias("plain"))
            .select("doc_id", F.unhex(F.sha2("plain", 256)).alias("digest"), F.octet_length("plain").alias("size")))


# Filters


def _slots(keys: np.ndarray, seed: int, segments: int, length: int) -> np.ndarray:
    """Three slots of each key, in neighbouring segments."""
    hashed = mix(keys + np.uint64(seed))
    high = (hashed >> np.uint64(32)) * np.uint64(segments * length) >> np.uint64(32)
    mask = np.uint64(length - 1)
    return np.stack([high, (high + np.uint64(length)) ^ (hashed >> np.uint64(18) & mask),
                     (high + np.uint64(2 * length)) ^ (hashed & mask)]).astype(np.int64)


def _prints(keys: np.ndarray, seed: int) -> np.ndarray:
    hashed = mix(keys + np.uint64(seed))
    return (hashed ^ hashed >> np.uint64(32)).astype(np.uint8)


def _peel(slots: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Rounds of (key, slot) where the slot belongs to that key alone among the keys left; None if some can't be peeled."""
    count = slots.shape[1]
    numbers = np.arange(count)
    held, keys = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for row in slots:
        np.add.at(held, row, 1)
        np.bitwise_xor.at(keys, row, numbers)
    rounds, left, single = [], count, np.flatnonzero(held == 1)
    while len(single):
        own, first = np.unique(keys[single], return_index=True)
        rounds.append((own, single[first]))
        left -= len(own)
        for row in slots[:, own]:
            np.subtract.at(held, row, 1)
            np.bitwise_xor.at(keys, row, own)
        touched = slots[:, own].ravel()
        single = np.unique(touched[held[touched] == 1])
    return rounds if not left else None


def build_filter(keys: np.ndarray) -> dict:
    """A three-way binary-fuse filter with fingerprints of 8 bits over distinct 64-bit keys."""
    count = max(len(keys), 2)
    length = min(1 << 18, 1 << int(math.floor(math.log(count) / math.log(3.33) + 2.25)))
    factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(count))
    seed = 0
    while True:
        segments = max(1, math.ceil(count * factor / length) - 2)
        slots = _slots(keys, seed, segments, length)
        rounds = _peel(slots, (segments + 2) * length)
        if rounds is not None:
            break
        seed += 1
        factor *= 1.02  # a little more room with every failed seed
    table, prints = np.zeros((segments + 2) * length, np.uint8), _prints(keys, seed)
    for own, places in reversed(rounds):
        table[places] = 0
        table[places] = prints[own] ^ np.bitwise_xor.reduce(table[slots[:, own]], axis=0)
    return {"seed": seed, "segments": segments, "length": length, "prints": table.tobytes()}


def may_contain(keys: np.ndarray, seed: int, segments: int, length: int, prints: bytes) -> np.ndarray:
    found = np.frombuffer(prints, np.uint8)[_slots(keys, seed, segments, length)]
    return np.bitwise_xor.reduce(found, axis=0) == _prints(keys, seed)


def _key(digests_: Iterable[bytes]) -> np.ndarray:
    return np.array([int.from_bytes(d[:8], "little") for d in digests_], np.uint64)


def _shard(shards: int) -> Column:
    return F.pmod(F.conv(F.hex(F.substring("digest", 9, 4)), 16, 10).cast("long"), F.lit(shards)).cast("int")


def build_filters(buckets: DataFrame, shards: int) -> DataFrame:
    """One filter per shard of distinct digests."""
    def build(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"shard": group["shard"].iloc[0]} | build_filter(np.unique(_key(group["digest"])))])

    return (buckets.select("digest", _shard(shards).alias("shard")).groupBy("shard")
            .applyInPandas(build, "shard int, seed long, segments long, length long, prints binary"))


def screen(batch: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """The batch's digests that a snapshot's filters can't rule out. The batch's digests are distinct."""
    def look(rows: pd.DataFrame, filter_: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(filter_):
            return rows[["digest"]].iloc[:0]
        f = filter_.iloc[0]
        return rows.loc[may_contain(_key(rows["digest"]), int(f["seed"]), int(f["segments"]), int(f["length"]), f["prints"]), ["digest"]]

    return (batch.select("digest", _shard(shards).alias("shard")).groupBy("shard")
            .cogroup(filters.groupBy("shard")).applyInPandas(look, "digest binary"))


def _plain(docs: DataFrame, wanted: DataFrame, name: str) -> DataFrame:
    """(digest, size, plain text as `name`) of the wanted (digest, size, doc_id)."""
    by_id = (wanted.where("doc_id IS NOT NULL").join(docs.select("doc_id", "text"), "doc_id")
             .select("digest", "size", normalised().alias(name)))
    # Grouped before the join, so that a hot text is one row per task.
    nameless = (docs.where("doc_id IS NULL").select(normalised().alias(name)).select(F.unhex(F.sha2(name, 256)).alias("digest"), name)
                .groupBy("digest").agg(F.min(name).alias(name)))
    needed = wanted.where("doc_id IS NULL").select("digest", "size")
    return by_id.unionAll(nameless.join(needed, "digest").select("digest", "size", name))


class Snapshot:
    """Digests of texts that stay, one row each (digest, size, doc_id), and their filters; written once."""

    def __init__(self, buckets: DataFrame, shards: int):
        self.buckets, self.shards = buckets, shards
        self.filters = materialise(build_filters(buckets, shards), "filters")

    def holds(self, batch: DataFrame, docs: DataFrame) -> DataFrame:
        """(digest, size) of the batch's distinct texts that the snapshot has, compared byte by byte."""
        positives = screen(batch, self.filters, self.shards)
        pairs = materialise(
            positives.join(batch, "digest")
            .join(self.buckets.select("digest", "size", F.col("doc_id").alias("keep_id")), ["digest", "size"])
            .select("digest", "size", "doc_id", "keep_id"), "positives")
        new = _plain(docs, pairs.select("digest", "size", "doc_id"), "new")
        old = _plain(docs, pairs.select("digest", "size", F.col("keep_id").alias("doc_id")), "old")
        return new.join(old, ["digest", "size"]).where("new = old").select("digest", "size").distinct()


def mark_duplicates(batches: list[DataFrame]) -> DataFrame:
    """Per document of all batches, which arrive in this order: doc_id, keep_id, group_size, kept, text_sha256."""
    docs = reduce(DataFrame.unionAll, [b.select("doc_id", "text") for b in batches])
    rows, snapshots, groups = [], [], []
    keys = ["digest", "size"]
    for number, batch in enumerate(batches):
        named = materialise(digests(batch), f"digests{number}")
        rows.append(named.withColumn("batch", F.lit(number)))
        own = materialise(named.groupBy(*keys).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")), "groups")
        held = [snapshot.holds(own, docs).withColumn("home", F.lit(i)) for i, snapshot in enumerate(snapshots)]
        if held:
            known = materialise(reduce(DataFrame.unionAll, held).groupBy(*keys).agg(F.min("home").alias("home")), "held")
            own = materialise(own.join(known, keys, "left").withColumn("home", F.coalesce("home", F.lit(number))), "homes")
        else:
            own = own.withColumn("home", F.lit(number))
        groups.append(own.select(*keys, "doc_id", "n", "home", F.lit(number).alias("batch")))
        if number + 1 < len(batches):
            fresh = materialise(own.where(F.col("home") == number).select(*keys, "doc_id"), "snapshot")
            snapshots.append(Snapshot(fresh, fresh.count() // SHARD + 1))
    # A window holds a row per batch at most. Written, so that the join's sides are plain exchanges and the rows of a hot text
    # can be split among tasks.
    same = Window.partitionBy(*keys, "home")
    decided = materialise(reduce(DataFrame.unionAll, groups).select(
        *keys, "batch", F.min("doc_id").over(same).alias("keep_id"), F.sum("n").over(same).alias("group_size")), "decided")
    return (reduce(DataFrame.unionAll, rows).join(decided, [*keys, "batch"])
            .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                    F.lower(F.hex("digest")).alias("text_sha256")))


def arrivals(docs: DataFrame, count: int) -> list[DataFrame]:
    """The table as batches of increasing doc_id, as if it had arrived in that order; rows without doc_id come last."""
    ends = docs.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    if ends["low"] is None:
        return [docs]
    low, high = ends["low"], ends["high"]
    cuts = sorted({low + (high - low) * i // count for i in range(1, count)} - {low})
    edges = [None, *cuts, None]
    return [docs.where(" AND ".join(([f"doc_id >= {a}"] if a is not None else []) + ([f"doc_id < {b}"] if b is not None else [])) or "true")
            if b is not None else docs.where(f"doc_id >= {a} OR doc_id IS NULL" if a is not None else "true")
            for a, b in zip(edges, edges[1:])]
