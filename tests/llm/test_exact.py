import hashlib
import re

import numpy as np
import pytest

from tallywell.llm import exact

from .fixtures import odd_rows, rows_to_docs


def brute_force(rows):
    plain = [re.sub("[\x20\x09-\x0d]+", " ", t or "") for _, t in rows]
    groups = {}
    for (i, _), text in zip(rows, plain):
        groups.setdefault(text, []).append(i)
    result = []
    for (i, _), text in zip(rows, plain):
        named = [x for x in groups[text] if x is not None]
        keep = min(named) if named else None
        result.append((i, keep, len(groups[text]), i == keep, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(result, key=str)


@pytest.mark.parametrize("batches", [1, 2, 4])
def test_matches_brute_force(spark, batches):
    rows = odd_rows(5)
    found = exact.mark_duplicates(exact.arrivals(rows_to_docs(spark, rows), batches))
    assert sorted(map(tuple, found.collect()), key=str) == brute_force(rows)


def test_batches_in_any_order_of_ids(spark):
    rows = [(5, "a b"), (1, "x"), (2, "a  b"), (9, "a\tb"), (7, "x"), (3, "y")]
    parts = [rows_to_docs(spark, rows[:2]), rows_to_docs(spark, rows[2:4]), rows_to_docs(spark, rows[4:])]
    assert sorted(map(tuple, exact.mark_duplicates(parts).collect()), key=str) == brute_force(rows)


@pytest.mark.parametrize("count", [1, 2, 3, 50, 1000, 30_000])
def test_filter_knows_all_its_keys(count):
    keys = np.unique(np.random.default_rng(count).integers(0, 1 << 63, count, dtype=np.uint64))
    made = exact.build_filter(keys)
    assert exact.may_contain(keys, **made).all()
    others = np.random.default_rng(count + 1).integers(1 << 63, (1 << 64) - 1, 20_000, dtype=np.uint64)
    assert exact.may_contain(others, **made).mean() < 0.02


def test_filter_size():
    keys = np.unique(np.random.default_rng(9).integers(0, 1 << 63, 100_000, dtype=np.uint64))
    assert len(exact.build_filter(keys)["prints"]) < 1.35 * len(keys)


def test_false_positive_of_a_filter_is_no_duplicate(spark, monkeypatch):
    monkeypatch.setattr(exact, "screen", lambda batch, filters, shards: batch.select("digest"))
    rows = odd_rows(6)
    found = exact.mark_duplicates(exact.arrivals(rows_to_docs(spark, rows), 2))
    assert sorted(map(tuple, found.collect()), key=str) == brute_force(rows)


def test_empty_table(spark):
    assert exact.mark_duplicates(exact.arrivals(rows_to_docs(spark, []), 3)).count() == 0


def test_all_ids_null(spark):
    found = exact.mark_duplicates(exact.arrivals(rows_to_docs(spark, [(None, "a"), (None, "a")]), 3)).collect()
    assert [(r["keep_id"], r["group_size"], r["kept"]) for r in found] == [(None, 2, True)] * 2


def test_screen_that_rules_all_out_leaves_batches_apart(spark, monkeypatch):
    monkeypatch.setattr(exact, "screen", lambda batch, filters, shards: batch.select("digest").where("false"))
    rows = [(1, "a"), (2, "a"), (3, "b"), (11, "a"), (12, "b"), (13, "b")]
    parts = [rows_to_docs(spark, rows[:3]), rows_to_docs(spark, rows[3:])]
    found = sorted(map(tuple, exact.mark_duplicates(parts).collect()), key=str)
    assert found == sorted(brute_force(rows[:3]) + brute_force(rows[3:]), key=str) != brute_force(rows)


def test_rows_without_ids_in_any_batch(spark):
    rows = [(None, "a"), (None, "b"), (4, "c"), (None, "a"), (3, "b"), (None, "c"), (2, "a"), (None, "b"), (None, None), (None, "")]
    parts = [rows_to_docs(spark, rows[:3]), rows_to_docs(spark, rows[3:6]), rows_to_docs(spark, rows[6:])]
    assert sorted(map(tuple, exact.mark_duplicates(parts).collect()), key=str) == brute_force(rows)


def test_one_id_with_different_texts(spark):
    rows = [(1, "a"), (1, "b"), (5, "a"), (6, "b"), (1, "c"), (7, "c")]
    parts = [rows_to_docs(spark, rows[:2]), rows_to_docs(spark, rows[2:4]), rows_to_docs(spark, rows[4:])]
    assert sorted(map(tuple, exact.mark_duplicates(parts).collect()), key=str) == brute_force(rows)
