"""A Merkle manifest of a dataset: digests of rows, of sources and of the whole, with a proof for every row.

Every row is a leaf. Leaves of one source, in the order of doc_id, form a tree in which FANOUT consecutive nodes become the
digest of their hex digests, level by level, until one is left. These roots, in the order of the sources, form a tree of the
same kind. A row's proof holds the siblings on its way up; whoever has a row, its proof and the root can verify the row alone.

Butterfly exchange. The leaves of a tree are cut into aligned partitions of FANOUT ** LOCAL leaves, which reduce to one node
each without looking elsewhere. Then partitions meet round by round: in round r those whose numbers differ in digit r only
(to the base FANOUT) form a group, swap the roots of the subtrees that they have reached, and each of them hashes the
parent for itself. After as many rounds as the number of partitions has digits every partition knows all of its upper
siblings, so nothing is passed down again. The subtree at the end of a tree may have fewer partitions than its siblings;
its partitions then stand in for the missing ones too, at most as many rows as its siblings have. A group has FANOUT rows at
most. Only the number of leaves of the largest tree reaches the driver, which gives the number of rounds.

Roots of sources go through the same two steps as one more tree. At the end each partition of rows takes the siblings above
it and folds every row's proof within its own leaves.

Rows are numbered within their source by ranges over the whole order, so a source that holds most rows is spread evenly.
Texts are read once and leave as digests.

Defined results: a null field counts as `-`, also in the order, where null ids and null sources come first; an empty text is
a value. Rows that repeat a doc_id within a source are leaves of their own, ordered by digest; equal rows are equal leaves
and their order is without effect on any digest but the proofs among themselves. A source with one row has the leaf as root.
Without rows there is no root. Any other columns are not read. Long texts are hashed where they lie.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywell.session import materialise

FANOUT = 3
#: Levels that a partition of leaves reduces by itself.
LOCAL = 7
#: What joins a leaf's siblings: level by level, those before it and those after it.
SIBLINGS = "array<struct<before: string, after: string>>"


def field(column: Column) -> Column:
    """A value as its UTF-8 length, a colon and itself; `-` for null."""
    text = column.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def row_digest(columns: Iterable[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def digest(*nodes: str) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def fold(node: str, siblings: Iterable[tuple[str, str]]) -> str:
    """The root that a node reaches with these siblings."""
    for before, after in siblings:
        node = digest(before, node, after)
    return node


def levels_up(leaves: int) -> int:
    """Levels between so many leaves and their root."""
    levels = 0
    while leaves > 1:
        leaves, levels = -(-leaves // FANOUT), levels + 1
    return levels


def subtree(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes of each level from the leaves upwards, `levels` above them."""
    tree = [nodes]
    for _ in range(levels):
        nodes = [digest(*nodes[i : i + FANOUT]) for i in range(0, len(nodes), FANOUT)]
        tree.append(nodes)
    return tree


def siblings_of(tree: list[list[str]], at: int) -> list[tuple[str, str]]:
    """Level by level the nodes of the run of leaf `at` before and after its own."""
    found = []
    for nodes in tree[:-1]:
        low = at - at % FANOUT
        found.append(("".join(nodes[low:at]), "".join(nodes[at + 1 : low + FANOUT])))
        at //= FANOUT
    return found


def numbered(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """Adds `place`, counted from 0 within `tree` in the given order, and `leaves`, how many the tree has.

    The whole order is cut into ranges; a row's place is its place in its range and what earlier ranges hold of its tree.
    """
    ranged = rows.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order)
    stored = materialise(ranged.withColumn("range", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "ordered")
    parts = stored.groupBy(tree, "range").agg(F.min("at").alias("first_at"), F.count("*").alias("n"))
    before = Window.partitionBy(tree).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(tree, "range", "first_at", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"),
                         F.sum("n").over(Window.partitionBy(tree)).alias("leaves"))
    return (stored.join(parts, [tree, "range"]).withColumn("place", F.col("at") - F.col("first_at") + F.col("skip"))
            .drop("range", "at", "first_at", "skip"))


def partition_of(place: str, local: int) -> Column:
    return F.floor(F.col(place) / F.lit(FANOUT**local)).cast("long").alias("partition")


def _partition_roots(local: int) -> Callable[[pa.Table], pa.Table]:
    def run(group: pa.Table) -> pa.Table:
        ordered = group.sort_by("place")
        leaves = ordered["leaves"][0].as_py()
        # A tree that is one partition ends where one node is left.
        root = subtree(ordered["node"].to_pylist(), min(local, levels_up(leaves)))[-1][0]
        return pa.table({"tree": ordered["tree"][:1], "partition": ordered["partition"][:1],
                         "partitions": pa.array([-(-leaves // FANOUT**local)], pa.int64()), "node": [root]})

    return run


def butterfly(partitions: DataFrame, rounds: int) -> DataFrame:
    """(tree, partition, partitions, node): each partition's root of the tree, and the siblings on its way there."""
    held = partitions.withColumn("siblings", F.array().cast(SIBLINGS))
    for r in range(rounds):
        size = F.lit(FANOUT**r).cast("long")
        held = held.withColumns({
            "subtrees": F.ceil(F.col("partitions") / size).cast("long"),
            "subtree": F.floor(F.col("partition") / size).cast("long"),
            "low": F.pmod("partition", size),
        }).withColumn("digit", F.pmod("subtree", F.lit(FANOUT)).cast("int"))
        # The last subtree's partitions also go where its siblings have partitions and it has none.
        present = F.col("partitions") - F.col("subtree") * size
        short = (F.col("subtree") == F.col("subtrees") - 1) & (F.col("digit") > 0) & (present < size)
        places = F.when(short, F.sequence("low", size - 1, present)).otherwise(F.array("low"))
        met = held.withColumn("meets", F.explode(places))
        own = F.col("meets") == F.col("low")
        group = F.floor(F.col("subtree") / FANOUT).cast("long").alias("group")
        swapped = met.groupBy("tree", group, "meets").agg(
            F.sort_array(F.collect_list(F.struct("digit", "node"))).alias("roots"),
            F.collect_list(F.when(own, F.struct("partition", "partitions", "subtrees", "digit", "node", "siblings"))).alias("members"))
        each = swapped.select("tree", "roots", F.explode("members").alias("m")).select("tree", "roots", "m.*")
        joined = lambda part: F.array_join(F.transform(part, lambda x: x["node"]), "")
        level = F.struct(joined(F.filter("roots", lambda x: x["digit"] < F.col("digit"))).alias("before"),
                         joined(F.filter("roots", lambda x: x["digit"] > F.col("digit"))).alias("after"))
        grows = F.col("subtrees") > 1
        held = each.select(
            "tree", "partition", "partitions",
            F.when(grows, F.sha2(joined(F.col("roots")), 256)).otherwise(F.col("node")).alias("node"),
            F.when(grows, F.concat("siblings", F.array(level))).otherwise(F.col("siblings")).alias("siblings"))
    return held.select("tree", "partition", F.col("node").alias("top"), "siblings")


def tree_tops(leaves: DataFrame, local: int) -> DataFrame:
    """Numbered leaves (tree, place, leaves, node): for each partition the root of its tree and its upper siblings."""
    placed = leaves.select("tree", "place", "leaves", "node", partition_of("place", local))
    roots = placed.groupBy("tree", "partition").applyInArrow(_partition_roots(local), "tree string, partition long, partitions long, node string")
    roots = materialise(roots, "partitions")
    most = roots.agg(F.max("partitions")).first()[0] or 1
    return materialise(butterfly(roots, levels_up(most)), "tops")


def _finish(columns: list[str], local: int) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """Rows of a partition and the one row with what lies above it: each row's siblings and the root that it reaches."""
    def run(_key: tuple, rows: pa.Table, above: pa.Table) -> pa.Table:
        if not rows.num_rows or not above.num_rows:
            return pa.table({name: pa.array([], kind) for name, kind in _finished(columns)})
        ordered = rows.sort_by("place")
        nodes = ordered["node"].to_pylist()
        tree = subtree(nodes, min(local, levels_up(ordered["leaves"][0].as_py())))
        upper = [(x["before"], x["after"]) for x in above["siblings"][0].as_py()]
        proofs, folded = [], []
        for i, node in enumerate(ordered["given"].to_pylist()):
            path = siblings_of(tree, i) + upper
            proofs.append(digest(*[x for pair in path for x in pair]))
            folded.append(fold(node, path))
        some = {name: ordered[name] for name in columns}
        repeat = lambda name: pa.array([above[name][0].as_py()] * len(nodes), pa.string())
        return pa.table(some | {"leaf": ordered["node"], "subroot": repeat("subroot"), "root": repeat("root"),
                                "proof_sha256": proofs, "folded_root": folded})

    return run


def _finished(columns: list[str]) -> list[tuple[str, pa.DataType]]:
    return [(c, pa.int64()) for c in columns] + [(c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")]


def manifest(docs: DataFrame, given_text: Column | None = None, local: int = LOCAL) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    The tree is built over the rows as they are. `given_text` is the text that is held against it afterwards, by default
    the row's own: `folded_root` is the root that the row with that text reaches with its proof. A partition of leaves
    reduces `local` levels by itself.
    """
    def digest_of(text: Column) -> Column:
        return row_digest([docs["doc_id"], docs["source"], docs["lang"], docs["n_chars"], text])

    # Null sources come first; a mark before the others keeps them apart from an empty one.
    tree = F.coalesce(F.concat(F.lit("="), docs["source"]), F.lit(""))
    given = F.lit(None).cast("string") if given_text is None else F.when(~given_text.eqNullSafe(docs["text"]), digest_of(given_text))
    leaves = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), tree.alias("tree"), digest_of(docs["text"]).alias("node"), given.alias("given")), "leaves")
    leaves = materialise(numbered(leaves, "tree", ["doc_id", "node"]), "numbered")
    tops = tree_tops(leaves, local)

    sources = tops.where("partition = 0").select(F.lit("all").alias("tree"), F.col("tree").alias("source"), F.col("top").alias("node"))
    sources = materialise(numbered(sources, "tree", ["source"]), "sources")
    roots = _above_sources(sources, tree_tops(sources, local), local)

    above = tops.join(roots, F.col("tree") == F.col("source")).select(
        "tree", "partition", F.col("top").alias("subroot"), "root", F.concat(tops["siblings"], roots["upper"]).alias("siblings"))
    rows = leaves.select("tree", partition_of("place", local), "place", "leaves", "doc_id", "node", F.coalesce("given", "node").alias("given"))
    done = (rows.groupBy("tree", "partition").cogroup(above.groupBy("tree", "partition"))
            .applyInArrow(_finish(["doc_id"], local), "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string"))
    return done.withColumn("verified", F.col("folded_root") == F.col("root"))


def _above_sources(sources: DataFrame, tops: DataFrame, local: int) -> DataFrame:
    """For each source the root of all, and the siblings between."""
    def run(_key: tuple, rows: pa.Table, above: pa.Table) -> pa.Table:
        ordered = rows.sort_by("place")
        tree = subtree(ordered["node"].to_pylist(), min(local, levels_up(ordered["leaves"][0].as_py())))
        upper = above["siblings"][0].as_py()
        paths = [[{"before": a, "after": b} for a, b in siblings_of(tree, i)] + upper for i in range(ordered.num_rows)]
        kind = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
        return pa.table({"source": ordered["source"], "root": pa.array([above["top"][0].as_py()] * ordered.num_rows, pa.string()),
                         "upper": pa.array(paths, kind)})

    placed = sources.select("*", partition_of("place", local))
    return materialise(placed.groupBy("tree", "partition").cogroup(tops.groupBy("tree", "partition"))
                       .applyInArrow(run, f"source string, root string, upper {SIBLINGS}"), "roots")


def without_line_breaks_in_half(docs: DataFrame) -> Column:
    """The text, without line breaks where 2 divides the CRC-32 of the decimal doc_id: damage for a manifest to find."""
    hit = F.crc32(docs["doc_id"].cast("string").cast("binary")) % 2 == 0
    return F.when(hit, F.replace(docs["text"], F.lit("\n"), F.lit(""))).otherwise(docs["text"])
