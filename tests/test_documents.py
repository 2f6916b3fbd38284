"""Documents cut at entries, against a plain walk over the sorted entries."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tallywell.operators import documents

SCHEMA = "node string, part string, key string, text string"


def entries(count=3000, seed=2):
    """A crowded node, some small ones, positions that repeat, keys that need escaping, and entries without a node."""
    r = random.Random(seed)
    rows = [("small", "mix", "summary", '"summary":{"n":5}'), (None, "mix", "summary", '"summary":{"n":6}')]
    for i in range(count):
        node = "hot" if r.random() < 0.8 else f"n{r.randrange(12)}"
        if r.random() < 0.5:
            rows.append((node, "roster", f"{r.randrange(7)}\u0001{r.randrange(40)}", json.dumps({"rank": r.randrange(7), "title": "é\"{}[]," * r.randrange(9)})))
        else:
            key = f'{i}"\\'
            rows.append((node, "accessions", key, f"{json.dumps(key)}:{json.dumps({'200001': r.randrange(100)})}"))
    return rows + [row for row in rows[10:60] if row[1] == "roster"]


def plain(rows, limit):
    """node -> sections by document."""
    found = {}
    for node in {n for n, *_ in rows if n is not None}:
        at, cuts = 0, {}
        own = [(part, key, text) for n, part, key, text in rows if n == node]
        for part, key, text in sorted(own):
            cuts.setdefault(at // limit, []).append((part, key, text))
            at += len(text.encode())
        found[node] = list(cuts.values())
    return found


@pytest.mark.parametrize("limit", [1, 700, 20_000, documents.LIMIT])
def test_documents_are_cut_at_the_limit(spark, limit):
    rows = entries(300 if limit == 1 else 3000)
    made = documents.assemble(spark.createDataFrame(rows, SCHEMA).repartition(6), limit).collect()
    by_node = {}
    for d in sorted(made, key=lambda d: (d["node"], d["number"])):
        by_node.setdefault(d["node"], []).append(d)
    expected = plain(rows, limit)
    assert set(by_node) == set(expected) and "small" in expected
    for node, own in by_node.items():
        assert [d["number"] for d in own] == list(range(len(own))) and {d["of"] for d in own} == {len(expected[node])}
        parsed = [json.loads(d["document"]) for d in own]
        assert all(p["node"] == node and p["number"] == i and p["of"] == len(own) for i, p in enumerate(parsed))
        # Nothing lost or doubled, whatever the order among positions with the same place.
        listed = [json.dumps(x, sort_keys=True) for p in parsed for x in p.get("roster", [])]
        given = [json.dumps(json.loads(t), sort_keys=True) for n, part, _, t in rows if n == node and part == "roster"]
        assert sorted(listed) == sorted(given)
        mapped = [item for p in parsed for item in p.get("accessions", {}).items()]
        assert len(mapped) == len(dict(mapped)) == sum(n == node and part == "accessions" for n, part, *_ in rows)
        longest = max(len(t.encode()) for n, _, _, t in rows if n == node)
        assert all(d["bytes"] <= limit + longest for d in own)


def test_order_of_positions(spark):
    order = "node string, rank int, title string, status string, appointment_type string, name string, last_name string, individual_id string, begin_date date, level_grade_pay string, org_name string"
    rows = [("a", r, f"t{t}", "Filled", None, None, last, "1", None, None, "o") for r in (3, 0, 6) for t in (2, 1) for last in (None, "B", "A")]
    made = documents.assemble(documents.positions(spark.createDataFrame(rows, order).repartition(5))).collect()
    found = [(p["rank"], p["title"]) for p in json.loads(made[0]["document"])["roster"]]
    assert found == [(r, t) for r in (0, 3, 6) for _ in range(3) for t in ("t1", "t2")] and len(made) == 1


def test_crowded_node_is_gathered_by_many_tasks(spark):
    # Small partitions are not put together here, so tasks show.
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        crowded_node(spark)
    finally:
        spark.conf.set(name, before)


def crowded_node(spark):
    rows = spark.range(0, 60_000, 1, 8).select(
        F.lit("hot").alias("node"), F.lit("roster").alias("part"), F.lpad(F.col("id").cast("string"), 8, "0").alias("key"),
        F.format_string('{"rank":%d}', F.col("id")).alias("text"))
    made = documents.assemble(rows, 4096)
    assert made.select(F.max("bytes")).first()[0] < 4096 + 20
    numbered = documents.numbered(rows, 4096).groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(numbered) > 1
    ranks = [x["rank"] for d in sorted(made.collect(), key=lambda d: d["number"]) for x in json.loads(d["document"])["roster"]]
    assert ranks == list(range(60_000))


def test_nothing_given(spark, tmp_path):
    made = documents.assemble(spark.createDataFrame([], SCHEMA))
    assert made.count() == 0
    documents.write(made, str(tmp_path / "none"))
    assert documents.read(spark, str(tmp_path / "none")).count() == 0
