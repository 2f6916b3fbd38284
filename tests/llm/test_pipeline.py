import random

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tallywell.llm import toxicity, variable_packing
from tallywell.llm.queries import QUERIES, SQL

from . import test_decontaminate, test_exact, test_multi_index
from .fixtures import odd_rows, rows_to_docs


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    items = test_decontaminate.benchmark(7)
    r, rows = random.Random(1), [x for x in test_decontaminate.documents(items, 7)]
    for n in range(60):
        words = [f"w{r.randrange(400)}" for _ in range(40)]
        if n % 2:
            words[3], words[20] = "idiot", "moron"
        rows.append((5000 + n, " ".join(words)))
    rows_to_docs(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    labels = [(i, 1, int("idiot" in (t or ""))) for i, t in rows if i is not None]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows, items


def test_stages_match_brute_force(spark, tables):
    folder, rows, items = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        if name == "toxicity":
            expected = [x for x in rows if "idiot" not in (x[1] or "")]
        elif name == "exact_dedup":
            kept = {(i, digest): keep for i, _, _, keep, digest in test_exact.brute_force(rows)}
            expected = [x for x in rows if kept[x[0], test_exact.brute_force([x])[0][-1]]]
        elif name == "near_dedup":
            kept = {i for i, _, _, keep in test_multi_index.brute_force(rows, 5, 80) if keep}
            expected = [x for x in rows if x[0] is None or x[0] in kept]
        else:
            bad = {r[0] for r in test_decontaminate.brute_force(rows, items) if r[-1]}
            expected = [x for x in rows if x[0] not in bad]
        docs = stage(spark, docs, folder)
        assert docs.columns == names
        found = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=str)
        assert found == sorted(expected, key=str), name
        assert len(expected) < len(rows)
        rows = expected
    packed = corpus_pipeline.run(spark, folder).collect()
    assert {d for row in packed for d in row["doc_ids"]} == {i for i, t in rows if t}
    assert sum(row["used"] for row in packed) == sum(r["used"] for r in variable_packing.pack(rows_to_docs(spark, rows)).collect())


def test_registered():
    assert list(entry.queries())[-1] == "pipeline" and corpus_pipeline.ORACLE_SQL is None
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")) == list(range(1, 14))
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, folder, name):
    import compare

    item = type("Item", (), {"run": staticmethod(QUERIES[name]), "sql": SQL[name]})
    state, rows, _, detail = compare.compare(spark, compare.connect(folder), item, folder)
    assert state == "ok" and rows, detail


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {"pipeline"}))
def test_query_runs(spark, folder, name):
    assert QUERIES[name](spark, folder).count() > 0


def test_toxic_stage_ignores_other_columns(spark):
    docs = rows_to_docs(spark, odd_rows())
    model = toxicity.fit_model(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(docs, model).count() == toxicity.score(docs.drop("lang", "source", "n_chars"), model).count()
