"""Closures of trees of any depth, and lines that never end."""

import random

import pytest

from tallywell.operators import hierarchy


def frame(spark, rows):
    return spark.createDataFrame(rows, "code string, parent string")


def plain(rows):
    """Paths from the root, None for a line that never ends; and the codes on cycles."""
    parent = dict(rows)
    paths, cycles = {}, set()
    for code in parent:
        line, at = [], code
        while at is not None and at not in line:
            line.append(at)
            at = parent.get(at)
        paths[code] = None if at is not None else line[::-1]
        if at == code:
            cycles.add(code)
    return paths, cycles


def check(spark, rows):
    nodes = frame(spark, rows)
    paths, cycles = plain(rows)
    assert {r["code"]: r["path"] for r in hierarchy.path_to_root(nodes).collect()} == paths
    lost = {code for code, path in paths.items() if path is None}
    assert {r["code"]: r["on_cycle"] for r in hierarchy.endless(nodes).collect()} == {code: code in cycles for code in lost}
    found = sorted((r["code"], r["ancestor"], r["distance"]) for r in hierarchy.closure(nodes).collect())
    expected = [(c, a, d) for c, path in paths.items() for d, a in enumerate(path[::-1] if path else [c])]
    assert found == sorted(expected)


@pytest.mark.parametrize("depth", [1, 2, 4, 5, 40])
def test_chains(spark, depth):
    check(spark, [("n0", None)] + [(f"n{i}", f"n{i - 1}") for i in range(1, depth)])


def test_cycles_are_reported_and_not_followed(spark):
    check(spark, [("a", "b"), ("b", "a"), ("below", "a"), ("deeper", "below"), ("self", "self"), ("root", None), ("x", "root"), ("y", "x")])


def test_random_trees_with_cycles_and_unknown_parents(spark):
    r = random.Random(3)
    rows = [(f"c{i}", r.choice([None, "unknown", *[f"c{r.randrange(i + 1)}"] * 6, f"c{r.randrange(120)}"])) for i in range(120)]
    check(spark, rows)


def test_without_nodes_or_edges(spark):
    assert hierarchy.closure(frame(spark, [])).collect() == []
    assert hierarchy.endless(frame(spark, [])).collect() == []
    check(spark, [("a", None), ("b", None)])


def test_inheritance_reaches_over_many_levels(spark):
    nodes = frame(spark, [("n0", None)] + [(f"n{i}", f"n{i - 1}") for i in range(1, 30)])
    current = spark.createDataFrame([("n0", "score", 1.0), ("n20", "score", 2.0), ("n3", "size", 3.0)], "node string, measure string, value double")
    got = {(r["node"], r["measure"]): (r["value"], r["from_node"]) for r in hierarchy.nearest_value(current, nodes, ["score"]).collect()}
    assert got == {(f"n{i}", "score"): (1.0, "n0") if i < 20 else (2.0, "n20") for i in range(30)} | {("n3", "size"): (3.0, "n3")}


def forbidden(*_):
    raise AssertionError("the closure is drawn")


def test_totals_and_nearest_values_need_no_closure(spark, monkeypatch):
    r = random.Random(5)
    rows = [(f"c{i}", r.choice([None, "unknown", *[f"c{r.randrange(max(0, i - 4), i + 1)}"] * 8])) for i in range(90)]
    nodes, paths = frame(spark, rows), plain(rows)[0]
    leaf = spark.createDataFrame([(f"c{i}", float(i)) for i in range(0, 90, 2)] + [("stranger", 7.0)], "node string, value double")
    over = {x["node"]: x["value"] for x in hierarchy.roll_up_closure(leaf, hierarchy.closure(nodes)).collect()}
    monkeypatch.setattr(hierarchy, "_reach", forbidden)
    assert {x["node"]: x["value"] for x in hierarchy.totals_below(leaf, nodes).collect()} == over
    values = {f"c{i}": float(i) for i in range(0, 90, 7)} | {"unknown": 0.5}
    current = spark.createDataFrame([(n, "score", v) for n, v in values.items()], "node string, measure string, value double")
    lines = {code: path[::-1] if path else [code] for code, path in paths.items()}
    expected = {code: next((n for n in line if n in values), None) for code, line in lines.items()}
    got = {x["node"]: x["from_node"] for x in hierarchy.nearest_value(current, nodes, ["score"]).collect()}
    assert got == {code: n for code, n in expected.items() if n is not None}


def test_paths_need_no_closure(spark, monkeypatch):
    r = random.Random(7)
    rows = [(f"c{i}", r.choice([None, "unknown", *[f"c{r.randrange(max(0, i - 4), i + 1)}"] * 8, "c70"])) for i in range(90)]
    monkeypatch.setattr(hierarchy, "_reach", forbidden)
    paths = {row["code"]: row["path"] for row in hierarchy.path_to_root(frame(spark, [*rows, rows[3]])).collect()}
    assert paths == plain(rows)[0] and None in paths.values()


def test_several_parents_are_listed_by_distance(spark):
    nodes = frame(spark, [("a", None), ("b", "a"), ("c", "a"), ("d", "b"), ("d", "c")])
    paths = {row["code"]: row["path"] for row in hierarchy.path_to_root(nodes).collect()}
    assert paths["b"] == ["a", "b"] and paths["d"][-1] == "d" and set(paths["d"]) == {"a", "b", "c", "d"}
