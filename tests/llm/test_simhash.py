import itertools
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallywell.llm import simhash

from .fixtures import lower, odd_rows, rows_to_docs, words_of


def plain_fingerprint(text, size):
    w = words_of(lower(text))
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + size]).encode(), 42) for i in range(max(1, len(w) - size + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_force(marks, distance):
    """(doc_id, fingerprint) rows to sorted (doc_id, fingerprint, component)."""
    label = {i: i for i, _ in marks if i is not None}
    changed = True
    while changed:
        changed = False
        for (i, x), (j, y) in itertools.combinations(marks, 2):
            if None not in (i, j) and label[i] != label[j] and (x ^ y).bit_count() <= distance:
                label[i] = label[j] = min(label[i], label[j])
                changed = True
    return sorted(((i, f"{x:016x}", label.get(i)) for i, x in marks), key=str)


def result(frame):
    return sorted((tuple(r) for r in frame.select("doc_id", "fingerprint", "component_id").collect()), key=str)


@pytest.mark.parametrize("size, distance, seed", [(4, 4, 7), (2, 3, 8)])
def test_matches_brute_force(spark, size, distance, seed):
    rows = odd_rows(seed) + [(5000, None), (5001, "Two WORDS"), (5002, "two words")]
    found = simhash.near_duplicates(rows_to_docs(spark, rows), size, distance)
    assert result(found) == brute_force([(i, plain_fingerprint(t, size)) for i, t in rows], distance)
    assert found.where("kept <> (doc_id <=> component_id)").isEmpty()


def test_fingerprints_of_a_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    marks = [(r.doc_id, plain_fingerprint(r.text, 4)) for r in docs.collect()]
    assert result(simhash.near_duplicates(docs)) == brute_force(marks, 4)


def test_texts_are_taken_whole_across_pieces(monkeypatch):
    r = random.Random(4)
    text = "".join(r.choice(["ab", "cde", "f", "é"]) + r.choice([" ", " \n", "\t", " "]) for _ in range(800))
    expected = plain_fingerprint(text, 4)
    for piece in (1, 3, 50, 1 << 20):
        monkeypatch.setattr(simhash, "PIECE", piece)
        assert simhash.fingerprint(lower(text).encode(), 4) == expected


def test_hashes_are_those_of_the_engine(spark):
    text = "one two three été"
    assert spark.range(1).select(F.xxhash64(F.lit(text))).first()[0] & (1 << 64) - 1 == simhash.fingerprint(text.encode(), 4)


@pytest.mark.parametrize("blocks", [7, 8, 10])
def test_pigeonhole_holds(blocks):
    """Any pair within the distance agrees under some mask."""
    masks = [m & (1 << 64) - 1 for m in simhash.key_masks(blocks, 4)]
    r = random.Random(blocks)
    for _ in range(2000):
        change = sum(1 << b for b in r.sample(range(64), 4))
        assert any(change & m == 0 for m in masks)


def test_keys_grow_with_the_table():
    for n in (10, 10**6, 10**9, 10**11):
        blocks = simhash.block_count(n, 4)
        assert all((m & (1 << 64) - 1).bit_count() >= np.log2(n) + simhash.SPARE_BITS for m in simhash.key_masks(blocks, 4))


@pytest.mark.parametrize("heads", [4096, 16])
def test_dense_clusters_and_chains(spark, monkeypatch, heads):
    """Members of hot buckets that are near each other but not near the bucket's smallest member, and near misses."""
    monkeypatch.setattr(simhash, "HEADS", heads)
    r = random.Random(9)
    marks = {}
    for centre in (r.getrandbits(64), r.getrandbits(30)):
        for _ in range(150):
            x = centre
            for b in r.sample(range(64), r.choice([2, 3, 5, 7, 9])):
                x ^= 1 << b
            marks[x] = None
    chain = r.getrandbits(64)
    for _ in range(30):
        chain ^= sum(1 << b for b in r.sample(range(64), 4))
        marks[chain] = None
    ids = r.sample(range(10_000), len(marks))
    expected = brute_force(list(zip(ids, marks)), 4)
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in marks]
    none = spark.createDataFrame([], "a long, b long")
    groups = {row["id"] & (1 << 64) - 1: row["component_id"] for row in simhash.linked(spark.createDataFrame(signed, "bits long"), none).collect()}
    smallest = {}
    for i, x in zip(ids, marks):
        smallest[groups.get(x, x)] = min(smallest.get(groups.get(x, x), i), i)
    assert sorted(((i, f"{x:016x}", smallest[groups.get(x, x)]) for i, x in zip(ids, marks)), key=str) == expected


def test_empty_table(spark):
    assert simhash.near_duplicates(rows_to_docs(spark, [])).count() == 0
