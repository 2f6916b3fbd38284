import hashlib

import pytest

from tallywell.llm import substrings

from .fixtures import odd_rows, rows_to_docs, words_of


def brute_force(rows, length=13):
    first = {}
    for i, text in rows:
        w = words_of(text)
        for j in range(len(w) - length + 1 if i is not None else 0):
            key = tuple(w[j : j + length])
            first[key] = min(first.get(key, i), i)
    result = []
    for i, text in rows:
        w = words_of(text)
        gone = set()
        for j in range(len(w) - length + 1 if i is not None else 0):
            if first[tuple(w[j : j + length])] < i:
                gone.update(range(j, j + length))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        result.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(result, key=str)


@pytest.mark.parametrize("seed", [5, 6])
def test_matches_brute_force(spark, seed):
    rows = odd_rows(seed)
    found = substrings.remove_repeats(rows_to_docs(spark, rows).repartition(5)).drop("kept_text").collect()
    assert sorted(map(tuple, found), key=str) == brute_force(rows)


def test_batches_of_any_size_agree(spark, monkeypatch):
    rows = odd_rows(7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        found = substrings.remove_repeats(rows_to_docs(spark, rows).repartition(3)).drop("kept_text").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, found), key=str) == brute_force(rows)


def test_kept_text_is_what_was_hashed(spark):
    for row in substrings.remove_repeats(rows_to_docs(spark, odd_rows(8))).collect():
        assert hashlib.sha256(row["kept_text"].encode()).hexdigest() == row["kept_sha256"]


def test_empty_table(spark):
    assert substrings.remove_repeats(rows_to_docs(spark, [])).count() == 0
