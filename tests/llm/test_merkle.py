import hashlib
import zlib
from collections import defaultdict

import pytest

from tallywell.llm import merkle

from .fixtures import SCHEMA


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(*fields):
    return H(*["-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields])


def plain_tree(nodes, fanout):
    """Root, and for each leaf its siblings level by level as (before, after)."""
    paths, owners = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, upper_owners = [], []
        for low in range(0, len(nodes), fanout):
            run = nodes[low : low + fanout]
            for k in range(len(run)):
                for i in owners[low + k]:
                    paths[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            up.append(H(*run))
            upper_owners.append([i for o in owners[low : low + fanout] for i in o])
        nodes, owners = up, upper_owners
    return nodes[0], paths


def brute_force(rows, fanout=3):
    """rows: (doc_id, text, lang, source, n_chars)."""
    by_source = defaultdict(list)
    for i, text, lang, source, n in rows:
        damaged = text
        if i is not None and text is not None and zlib.crc32(str(i).encode()) % 2 == 0:
            damaged = text.replace("\n", "")
        by_source[source].append((i, leaf_of(i, source, lang, n, text), leaf_of(i, source, lang, n, damaged)))
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    for name in names:
        by_source[name].sort(key=lambda r: (r[0] is not None, r[0], r[1]))
    trees = [plain_tree([leaf for _, leaf, _ in by_source[name]], fanout) for name in names]
    root, tops = plain_tree([t[0] for t in trees], fanout) if trees else (None, [])
    found = []
    for name, (subroot, paths), top in zip(names, trees, tops):
        for (i, leaf, damaged), path in zip(by_source[name], paths):
            folded = damaged
            for before, after in path + top:
                folded = H(before, folded, after)
            found.append((i, leaf, subroot, root, H(*[x for p in path + top for x in p]), folded, folded == root))
    return sorted(found, key=str)


def result(docs, local=7):
    rows = merkle.manifest(docs, merkle.without_line_breaks_in_half(docs), local).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("local", [0, 1, 7])
def test_matches_brute_force(spark, local):
    """Many partitions, ragged ends and a hot source, sources of one row, nulls, repeats, empty and very long texts."""
    rows = [(7 * i % 101, f"a\nb {i}", "en", "hot", i) for i in range(101)]
    rows += [(1000 + i, f"x{i}\n", None, f"s{i % 14}", None) for i in range(53)]
    rows += [(None, "no id\n", "en", "hot", 1), (None, None, None, None, None), (5, None, "de", None, 0), (6, "", "de", "", 0),
             (2000, "é\n" * 50_000, "fr", "é", 100_000), (2001, "same\n", "en", "twice", 5), (2001, "same\n", "en", "twice", 5), (2001, "other\n", "en", "twice", 6)]
    docs = spark.createDataFrame([(i, t, lang, s, n, 1, "k", "l", "x", "d") for i, t, lang, s, n in rows], SCHEMA)
    assert result(docs, local) == brute_force(rows)


@pytest.mark.parametrize("count", [1, 2, 3, 4, 9, 10, 26, 28])
def test_sizes_about_powers_of_the_fanout(spark, count):
    rows = [(i, "t\n", "en", "s", 2) for i in range(count)]
    assert result(spark.createDataFrame([(*r, 1, "k", "l", "x", "d") for r in rows], SCHEMA), 1) == brute_force(rows)


def test_without_damage_every_row_verifies_and_with_other_damage_none(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert merkle.manifest(docs).where("verified").count() == docs.count()
    assert merkle.manifest(docs, F.concat("text", F.lit("."))).where("verified").count() == 0


def test_groups_never_exceed_the_fanout(spark):
    """Rows that meet in a round: no group has more than FANOUT of them, and few stand in for missing ones."""
    for count in (2, 3, 5, 10, 28, 82):
        held = [(p, str(p)) for p in range(count)]
        frame = spark.createDataFrame([("t", p, count, n) for p, n in held], "tree string, partition long, partitions long, node string")
        found = {r["partition"]: r for r in merkle.butterfly(frame, merkle.levels_up(count)).collect()}
        root, paths = plain_tree([n for _, n in held], 3)
        assert {p: (r["top"], [tuple(s) for s in r["siblings"]]) for p, r in found.items()} == {p: (root, paths[p]) for p in range(count)}


def test_empty_table(spark):
    assert result(spark.createDataFrame([], SCHEMA)) == []
