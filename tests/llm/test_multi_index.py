import random

import numpy as np
import pytest

from tallywell.llm import common, multi_index
from tallywell.llm.common import classes_of_links
from tallywell.session import materialise

from .fixtures import lower, odd_rows, rows_to_docs, words_of


def shingles(text, size):
    w = words_of(lower(text))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute_force(rows, size, percent):
    sets = [shingles(t, size) for _, t in rows]
    label = {i: i for i, _ in rows if i is not None}
    changed = True
    while changed:
        changed = False
        for a, (i, _) in enumerate(rows):
            for b, (j, _) in enumerate(rows):
                if i is None or j is None or i >= j or not sets[a] or not sets[b]:
                    continue
                if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    low = min(label[i], label[j])
                    changed |= label[i] != low or label[j] != low
                    label[i] = label[j] = low
    return sorted(((i, len(s), label.get(i), i == label.get(i)) for (i, _), s in zip(rows, sets)), key=str)


def test_pigeonhole_holds():
    errors = multi_index.allowed_errors(0.85)
    chunk = multi_index.chunk_of_symbol(errors)
    r = np.random.default_rng(1)
    for _ in range(300):
        a = r.integers(0, 256, (1, multi_index.SYMBOLS), dtype=np.uint8)
        b = a.copy()
        at = r.choice(multi_index.SYMBOLS, errors, replace=False)
        b[0, at] ^= r.integers(1, 256, errors, dtype=np.uint8)
        assert np.intersect1d(multi_index.index_keys(a, chunk), multi_index.index_keys(b, chunk)).size
    assert (chunk.max() + 1) * 2 > errors


def test_allowed_errors_covers_the_limit():
    r = np.random.default_rng(2)
    for similarity in (0.8, 0.85):
        d = multi_index.allowed_errors(similarity)
        assert (r.binomial(multi_index.SYMBOLS, 1 - similarity, 200_000) > d).mean() < 1e-4


@pytest.mark.parametrize("size, percent, seed", [(3, 85, 5), (5, 80, 6)])
def test_matches_brute_force(spark, size, percent, seed):
    rows = odd_rows(seed)
    found = multi_index.near_duplicates(rows_to_docs(spark, rows), size, percent / 100)
    assert sorted((tuple(r) for r in found.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str) == [
        row if row[0] is not None else (None, row[1], None, True) for row in brute_force(rows, size, percent)]


def test_chains_of_near_copies_are_one_component(spark):
    """Neighbours are similar, ends are not, and the smallest id is in the middle: heads of buckets are not enough."""
    r = random.Random(3)
    words = [f"v{i}" for i in range(300)]
    rows, ids = [], [50, 20, 90, 1, 70, 30, 60, 10, 80, 40]
    for step, i in enumerate(ids):
        rows.append((i, " ".join(words)))
        for _ in range(6):
            words[r.randrange(len(words))] = f"x{step}{r.random()}"
    found = multi_index.near_duplicates(rows_to_docs(spark, rows), 3, 0.85).select("doc_id", "n_shingles", "component_id", "kept")
    assert sorted(map(tuple, found.collect())) == brute_force(rows, 3, 85)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(1, 40)] + [(100, 101)], "a long, b long")
    found = {r["id"]: r["component_id"] for r in classes_of_links(links).collect()}
    assert found == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100}


def test_empty_table(spark):
    assert multi_index.near_duplicates(rows_to_docs(spark, [])).count() == 0


def test_crowded_buckets_are_compared_in_cells(spark, monkeypatch):
    """Texts of one template that share keys, some of them near each other: cut into cells of two, nothing is lost."""
    monkeypatch.setattr(multi_index, "SIDE", 2)
    r = random.Random(12)
    template = [f"t{i}" for i in range(200)]
    rows = []
    for family in range(6):
        own = list(template)
        for at in r.sample(range(200), 14):
            own[at] = f"f{family}"
        for member in range(9):
            words = list(own)
            for at in r.sample(range(200), 3):
                words[at] = f"m{member}"
            rows.append((100 * member + family, " ".join(words)))
    found = multi_index.near_duplicates(rows_to_docs(spark, rows), 3, 0.85).select("doc_id", "n_shingles", "component_id", "kept")
    assert sorted(map(tuple, found.collect()), key=str) == brute_force(rows, 3, 85)


def test_no_list_of_ids_is_broadcast(spark, monkeypatch):
    plans = []

    def planned(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return materialise(df, label)

    monkeypatch.setattr(common, "materialise", planned)
    monkeypatch.setattr(multi_index, "materialise", planned)
    found = multi_index.near_duplicates(rows_to_docs(spark, odd_rows(9)), 3, 0.85)
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 20 and sum("SortMergeJoin" in p for p in plans) > 5
    assert not [p for p in plans if "Broadcast" in p]


def test_distance_counts_differing_symbols(spark):
    r = np.random.default_rng(11)
    a = r.integers(0, 1 << 16, (200, multi_index.SYMBOLS)).astype(np.uint16)
    b = np.where(r.random(a.shape) < 0.4, a ^ (1 << r.integers(0, 16, a.shape)).astype(np.uint16), a)
    a[0], b[0], b[1] = 0, 0xFFFF, a[1]
    names = multi_index._SIGNATURE
    sides = [spark.createDataFrame([(i, *row) for i, row in enumerate(side.view(np.int64).tolist())], ", ".join(f"{n} long" for n in ["id", *names])).alias(alias)
             for side, alias in ((a, "x"), (b, "y"))]
    rows = sides[0].join(sides[1], "id").select("id", multi_index._distance("x", "y").alias("d")).collect()
    assert {row["id"]: row["d"] for row in rows} == dict(enumerate((a != b).sum(axis=1).tolist()))
