"""Every registered query beside its SQL on the given tables."""

import compare
import pytest

from tallywell.queries import REGISTRY


@pytest.fixture(scope="module")
def connection(folder):
    return compare.connect(folder)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query_matches_sql(spark, connection, folder, name):
    state, rows, _, detail = compare.compare(spark, connection, REGISTRY[name], folder)
    assert state in ("ok", "rows"), detail
    assert rows >= 0


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["measure", "node", "period_start", "value", "n", "notation"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
