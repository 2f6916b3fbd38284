"""The organisation tree: roll-ups, signed groups, zero-filled flows, paths and tree tables.

Nodes are (code, kind, name, parent); kinds are gov, department, agency, subelement and group. Trees may have any depth:
closures double the way they cover in every round until no line goes on. A line that runs into a cycle has no root; such
codes are reported by `endless` and have nobody above them in a closure.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywell import fixed_values as fixed
from tallywell.functions import clean, names
from tallywell.operators import facts
from tallywell.schema import KEY_COLUMNS, as_values, notation_name, notation_rank
from tallywell.session import cut_lineage, literal_table, materialise

ROOT = "gov"


def _totals(df: DataFrame) -> DataFrame:
    return df.groupBy(*KEY_COLUMNS).agg(
        F.sum("value").alias("value"),
        F.lit(None).cast("long").alias("n"),
        notation_name(F.max(notation_rank("notation"))).alias("notation"),
        F.max("source_no").alias("source_no"),
    )


def roll_up_numbered(leaf: DataFrame, agency_department: DataFrame, agency_of: Column | None = None) -> DataFrame:
    """`roll_up` over rows that carry source numbers."""
    agency_of = clean.prefix_key("node") if agency_of is None else agency_of
    flat_rows = leaf.filter(F.col("dim").isNull())
    dimensioned = leaf.filter(F.col("dim").isNotNull())
    agencies = _totals(flat_rows.withColumn("node", agency_of)).unionByName(dimensioned.select(*leaf.columns))
    placed = agencies.join(
        agency_department.select(F.col("agency").alias("node"), F.col("dept")), "node", "left"
    )
    upward = placed.withColumn(
        "node", F.explode(F.filter(F.array(F.col("dept"), F.lit(ROOT)), lambda code: code.isNotNull()))
    ).drop("dept")
    return flat_rows.unionByName(agencies).unionByName(_totals(upward))


def roll_up(leaf: DataFrame, agency_department: DataFrame, agency_of: Column | None = None) -> DataFrame:
    """Leaf rows plus agency, department and government totals.

    Flat rows come in per sub-element and are summed to their agency; dimensioned rows come in per agency. Each
    level is built from the one below, so the second shuffle already carries agencies instead of leaves.
    `agency_of` maps a leaf node to its agency; the default is the two-character prefix.
    """
    numbered, sources = facts.number_sources(leaf)
    return facts.name_sources(roll_up_numbered(numbered, agency_department, agency_of), sources)


def roll_up_closure(leaf: DataFrame, closure: DataFrame, amount: str = "value", keys: Sequence[str] = ()) -> DataFrame:
    """Totals at every ancestor in one grouping, for trees whose codes carry no prefix."""
    return (
        leaf.join(closure.select(F.col("code").alias("node"), "ancestor"), "node")
        .groupBy(F.col("ancestor").alias("node"), *keys)
        .agg(F.sum(amount).alias(amount))
    )


def signed_groups(values: DataFrame, members: DataFrame, kinds: DataFrame, measure: str = "headcount") -> DataFrame:
    """Groups as signed sums of member nodes: +1 to include, -1 to carve out."""
    countable = kinds.filter(F.col("kind").isin("agency", "subelement")).select(F.col("code").alias("node"))
    edges = members.select("gid", F.col("code").alias("node"), "sign")
    picked = (
        values.filter((F.col("measure") == measure) & F.col("dim").isNull())
        .join(edges, "node")
        .join(countable, "node", "left_semi")
    )
    totals = picked.groupBy("gid", "period_type", "period_start").agg(
        F.sum(F.col("value") * F.col("sign")).alias("value"), F.max("source_ref").alias("source_ref")
    )
    return as_values(totals.withColumnRenamed("gid", "node"), measure=measure)


def flow_spans(values: DataFrame, flows: Sequence[tuple[str, str]]) -> DataFrame:
    """(measure, until): the last month of each flow."""
    codes = [code for code, _ in flows]
    monthly = values.filter((F.col("period_type") == "month") & F.col("dim").isNull() & F.col("measure").isin(*codes))
    return monthly.groupBy("measure").agg(F.max("period_start").alias("until"))


def zero_fill(values: DataFrame, flows: Sequence[tuple[str, str]], spans: DataFrame | None = None) -> DataFrame:
    """Zero rows for flows a unit did not record in a month in which it had a headcount.

    `flows` are (measure, first month). One grouping over (node, month) collects which flows are present - a set
    no larger than the catalog - so all flows are filled in one job and nothing is joined back. `spans` are the last
    months of the flows in the whole table, if `values` is a part of it.
    """
    codes = [code for code, _ in flows]
    monthly = values.filter(
        (F.col("period_type") == "month") & F.col("dim").isNull() & F.col("measure").isin("headcount", *codes)
    )
    spans = flow_spans(monthly, flows) if spans is None else spans
    first = literal_table(values.sparkSession, "measure string, since string", flows)
    windows = (
        first.join(spans, "measure")
        .agg(F.collect_list(F.struct("measure", F.to_date("since").alias("since"), "until")).alias("windows"))
        .scalar()
    )
    present = monthly.groupBy("node", "period_start").agg(
        F.bool_or(F.col("measure") == "headcount").alias("staffed"),
        F.collect_set(F.when(F.col("measure").isin(*codes), F.col("measure"))).alias("present"),
    )
    open_flows = F.filter(
        F.col("windows"),
        lambda w: F.col("period_start").between(w["since"], w["until"]) & ~F.array_contains("present", w["measure"]),
    )
    absent = (
        present.filter("staffed")
        .withColumn("windows", windows)
        .select("node", "period_start", F.explode(F.transform(open_flows, lambda w: w["measure"])).alias("measure"))
    )
    return as_values(absent, period_type="month", value=F.lit(0.0), source_ref="zero-fill")


# --- tree tables --------------------------------------------------------------------------------------------------


def build_nodes(agency: DataFrame, org: DataFrame, department: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Node table from the lookups. A department is a node only if it holds more than one agency."""
    def seen(df: DataFrame) -> list[Column]:
        return [F.col(c).cast("string").alias(c) if c in df.columns else F.lit(None).cast("string").alias(c)
                for c in ("first_seen", "last_seen")]

    multi = agency.groupBy("department_code").agg(F.count(F.lit(1)).alias("agencies")).filter("agencies > 1").select("department_code")
    departments = (
        multi.join(department.withColumnRenamed("code", "department_code"), "department_code", "left")
        .select(
            F.concat(F.lit("D:"), "department_code").alias("code"), F.lit("department").alias("kind"),
            names.title(F.coalesce("name", "department_code")).alias("name"), F.lit(ROOT).alias("parent"),
            *seen(department),
        )
    )
    flagged = agency.join(multi.withColumn("multi", F.lit(True)), "department_code", "left")
    agencies = flagged.select(
        "code", F.lit("agency").alias("kind"), names.title("name").alias("name"),
        F.when(F.col("multi"), F.concat(F.lit("D:"), "department_code")).otherwise(ROOT).alias("parent"), *seen(agency),
    )
    units = org.select(
        "code", F.lit("subelement").alias("kind"), names.title("name").alias("name"),
        F.col("agency_code").alias("parent"), *seen(org),
    )
    root = literal_table(agency.sparkSession, "code string, kind string, name string, parent string, first_seen string, last_seen string",
                         [(ROOT, "gov", "Whole workforce", None, None, None)])
    out = root.unionByName(departments).unionByName(agencies).unionByName(units)
    if groups is not None:
        out = out.unionByName(groups.select(
            F.col("gid").alias("code"), F.lit("group").alias("kind"), "name", F.lit(None).cast("string").alias("parent"),
            F.lit(None).cast("string").alias("first_seen"), F.lit(None).cast("string").alias("last_seen"),
        ))
    return out


def historical_nodes(spans: DataFrame, nodes: DataFrame, found_names: DataFrame) -> DataFrame:
    """Nodes for codes that only history knows, under placeholder names where no name was ever recorded.

    `spans` are (node, first_seen, last_seen); `found_names` are (code, name, from_month).
    """
    unknown = spans.join(nodes.select(F.col("code").alias("node")), "node", "left_anti")
    parents = (
        unknown.filter(F.length("node") == 4)
        .groupBy(clean.prefix_key("node").alias("node"))
        .agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
        .join(nodes.select(F.col("code").alias("node")), "node", "left_anti")
        .join(unknown.select("node"), "node", "left_anti")
    )
    every = unknown.unionByName(parents).join(found_names.withColumnRenamed("code", "node"), "node", "left")
    code, is_agency = F.col("node"), F.length("node") == 2
    placeholder = (
        F.when(is_agency, F.format_string(fixed.HISTORICAL_AGENCY, code))
        .when(F.upper(F.trim("name")).isin(*fixed.INVALID_NAMES), F.format_string(fixed.UNRECORDED_UNIT, code))
        .when(F.col("name").isNotNull(), names.title("name"))
        .otherwise(F.format_string(fixed.HISTORICAL_UNIT, code))
    )
    return every.select(
        code.alias("code"),
        F.when(is_agency, "agency").otherwise("subelement").alias("kind"),
        placeholder.alias("name"),
        F.when(is_agency, ROOT).otherwise(clean.prefix_key(code)).alias("parent"),
        F.date_format("first_seen", "yyyyMM").alias("first_seen"),
        F.date_format("last_seen", "yyyyMM").alias("last_seen"),
    )


def _jumps(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame | None]:
    """For k = 0, 1, ... the table (code, above) of what lies 2**k above a code, as long as there is any; and what is left.

    What is left are codes that still have somebody above them after as many steps as there are codes: their lines run into
    a cycle, and `above` is then on it. The tables are written between rounds, of which there are as many as the depth has
    binary digits.
    """
    held = [materialise(nodes.filter(F.col("parent").isNotNull()).select("code", F.col("parent").alias("above")).distinct(), "jumps")]
    most = held[0].count()
    # With one parent to a code, no round can give a pair twice.
    single = held[0].select("code").distinct().count() == most
    while not held[-1].isEmpty():
        if 1 << (len(held) - 1) > most:
            return held, held[-1]
        further = held[-1].select(F.col("code").alias("above"), F.col("above").alias("_next"))
        pairs = held[-1].join(further, "above").select("code", F.col("_next").alias("above"))
        held.append(materialise(pairs if single else pairs.distinct(), "jumps"))
    return held[:-1], None


def endless(nodes: DataFrame) -> DataFrame:
    """(code, on_cycle) of codes whose line upwards never ends: those on a cycle, and those below one."""
    _, left = _jumps(nodes)
    if left is None:
        return nodes.select("code", F.lit(True).alias("on_cycle")).limit(0)
    on_cycle = left.select(F.col("above").alias("code")).distinct().withColumn("on_cycle", F.lit(True))
    return left.select("code").distinct().join(on_cycle, "code", "left").select("code", F.coalesce("on_cycle", F.lit(False)).alias("on_cycle"))


def _reach(nodes: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The closure, and (code, above) of the codes whose lines never end, if there are any."""
    nodes = materialise(nodes.select("code", "parent"), "nodes")
    jumps, left = _jumps(nodes)
    codes = nodes.select("code").distinct()
    start = codes.unionByName(nodes.filter(F.col("parent").isNotNull()).select(F.col("parent").alias("code"))).distinct()
    reach = materialise(start.select("code", F.col("code").alias("ancestor"), F.lit(0).alias("distance")), "reach")
    for k, jump in enumerate(jumps):
        if left is not None:
            jump = jump.join(left.select("code"), "code", "left_anti")
        known = reach.select(F.col("code").alias("above"), "ancestor", (F.col("distance") + (1 << k)).alias("distance"))
        reach = materialise(reach.unionByName(jump.join(known, "above").select("code", "ancestor", "distance")), "reach")
    return reach.join(codes, "code", "left_semi"), left


def closure(nodes: DataFrame) -> DataFrame:
    """(code, ancestor, distance) for every node and each node above it, itself included.

    Round k appends to every code what is known of the code 2**k above it, so the known way doubles. A parent that is no
    node itself ends a line. A code whose line never ends has only itself.
    """
    return _reach(nodes)[0]


def path_to_root(nodes: DataFrame) -> DataFrame:
    """Path from the root to each node as an array of codes; null for a node whose line never ends.

    Each code has one parent at most; with several, what `closure` has above a code is listed by its distance. Each round puts
    what is known of the way above a code's known way before it, so the known way doubles. A path that has reached its root
    is written and not touched again. A line that meets a code of its own a second time never ends.
    """
    nodes = materialise(nodes.filter(F.col("code").isNotNull()).select("code", "parent").distinct(), "nodes")
    codes = nodes.select("code").distinct()
    if codes.count() < nodes.count():
        return _listed_above(nodes)
    ends = nodes.select(F.col("parent").alias("code")).filter(F.col("code").isNotNull()).distinct().join(codes, "code", "left_anti")
    own = F.array("code").alias("path")
    root = F.col("parent").isNull()
    done = [materialise(nodes.filter(root).select("code", own), "paths")]
    outside = materialise(ends.select("code", own), "paths")
    going = materialise(nodes.filter(~root).select("code", own, F.col("parent").alias("above")), "paths")
    while not going.isEmpty():
        known = going
        for table in [*done, outside]:
            known = known.unionByName(table.withColumn("above", F.lit(None).cast("string")))
        known = known.select(F.col("code").alias("above"), F.col("path").alias("_way"), F.col("above").alias("_next"))
        # No path: the line above never ends.
        lost = F.col("_way").isNull() | F.arrays_overlap("_way", "path")
        further = materialise(going.join(known, "above").select(
            "code", F.when(~lost, F.concat("_way", "path")).alias("path"), F.when(~lost, F.col("_next")).alias("above")), "paths")
        done.append(further.filter(F.col("above").isNull()).select("code", "path"))
        going = further.filter(F.col("above").isNotNull())
    out = done[0]
    for table in done[1:]:
        out = out.unionByName(table)
    return out


def _listed_above(nodes: DataFrame) -> DataFrame:
    """What stands above each code, itself included, the farthest first; null for a code whose line never ends."""
    reach, left = _reach(nodes)
    paths = reach.groupBy("code").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("distance", "ancestor")), asc=False), lambda s: s["ancestor"]).alias("path")
    )
    if left is None:
        return paths
    without = left.select("code", F.lit(True).alias("lost")).distinct()
    return paths.join(without, "code", "left").select("code", F.when(F.col("lost").isNull(), F.col("path")).alias("path"))


def _steps(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Codes and parents as `closure` has them, and the jumps of lines that end. Each code has one parent at most."""
    nodes = materialise(nodes.select("code", "parent"), "nodes")
    jumps, left = _jumps(nodes)
    if left is not None:
        jumps = [jump.join(left.select("code"), "code", "left_anti") for jump in jumps]
    codes = nodes.select("code").distinct()
    return codes, jumps


def totals_below(leaf: DataFrame, nodes: DataFrame, amount: str = "value") -> DataFrame:
    """(node, amount): what stands at and below each node, as `roll_up_closure` over the closure gives it, without the closure.

    After round k a node holds the sum of all that lies less than 2**k below it; the next round adds to it the sums held by the
    nodes 2**k below. So a round moves a row per node, however deep the tree is, and a root's rows combine on the map side.
    """
    codes, jumps = _steps(nodes)
    own = leaf.join(codes.select(F.col("code").alias("node")), "node", "left_semi")
    held = materialise(own.groupBy("node").agg(F.sum(amount).alias(amount)), "totals")
    for jump in jumps:
        raised = held.join(jump, F.col("node") == F.col("code")).select(F.col("above").alias("node"), amount)
        held = materialise(held.unionByName(raised).groupBy("node").agg(F.sum(amount).alias(amount)), "totals")
    return held


def nearest_value(current: DataFrame, nodes: DataFrame, inherited: Sequence[str]) -> DataFrame:
    """A node's own latest value, or for the inherited measures the nearest ancestor's.

    After round k a node has the nearest value less than 2**k above it; one that has none yet takes what the node 2**k above
    it has. So a round moves a row per node and measure at most, and no value fans out to all that lies below it.
    """
    codes, jumps = _steps(nodes)
    offers = current.groupBy("node", "measure").agg(F.min(F.struct("value")).alias("_top")).select(
        "node", "measure", F.col("_top.value").alias("value"), F.col("node").alias("from_node"))
    held = materialise(offers.filter(F.col("measure").isin(*inherited)), "nearest")
    for jump in jumps:
        above = held.withColumnRenamed("node", "above")
        offered = jump.join(above, "above").select(F.col("code").alias("node"), "measure", "value", "from_node")
        held = materialise(held.unionByName(offered.join(held.select("node", "measure"), ["node", "measure"], "left_anti")), "nearest")
    every = held.unionByName(offers.filter(~F.col("measure").isin(*inherited)))
    return every.join(codes.select(F.col("code").alias("node")), "node", "left_semi")


def org_tree(nodes: DataFrame, monthly: DataFrame) -> DataFrame:
    """Node rows with latest headcount, number of children and flags, ready to be ordered under each parent.

    `monthly` is headcount per (code, yyyymm) of agencies and sub-elements; departments and the root are summed
    from agencies. Both are stored first, as most steps read them again.
    """
    nodes, monthly = cut_lineage(nodes), cut_lineage(monthly)
    above = closure(nodes).filter("distance > 0").select("code", "ancestor")
    kinds = nodes.select("code", "kind")
    agency_rows = monthly.join(kinds.filter("kind = 'agency'"), "code", "left_semi")
    higher = kinds.filter(F.col("kind").isin("gov", "department")).select(F.col("code").alias("ancestor"))
    sums = (
        agency_rows.join(above, "code")
        .join(higher, "ancestor", "left_semi")
        .groupBy(F.col("ancestor").alias("code"), "yyyymm")
        .agg(F.sum("headcount").alias("headcount"))
    )
    all_rows = monthly.select("code", "yyyymm", "headcount").unionByName(sums)
    latest_month = agency_rows.select(F.max("yyyymm")).scalar()
    latest = all_rows.filter(F.col("yyyymm") == latest_month).select("code", F.col("headcount").alias("latest"))
    children = nodes.filter(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("code")).agg(F.count(F.lit(1)).alias("children"))
    return (
        nodes.join(latest, "code", "left")
        .join(children, "code", "left")
        .select(
            "code", "kind", "name", "parent",
            F.coalesce("latest", F.lit(0)).alias("latest"),
            F.coalesce("children", F.lit(0)).alias("children"),
            ((F.col("kind") == "agency") & (F.coalesce("children", F.lit(0)) <= 1)).alias("small"),
        )
    )


def ordered_children(tree: DataFrame) -> DataFrame:
    """All children of every node, largest first, as a distributed sort."""
    return tree.filter(F.col("parent").isNotNull()).select("parent", "code", "latest").orderBy("parent", F.desc("latest"), "code")


def children_arrays(tree: DataFrame, keep: int = fixed.CHILDREN_TOP) -> DataFrame:
    """The largest `keep` children of each node as an array, for a node's document."""
    order = Window.partitionBy("parent").orderBy(F.desc("latest"), "code")
    ranked = tree.filter(F.col("parent").isNotNull()).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= keep)
    entry = F.struct((-F.col("latest")).alias("order"), F.col("code"))
    return ranked.groupBy(F.col("parent").alias("code")).agg(
        F.transform(F.array_sort(F.collect_list(entry)), lambda s: s["code"]).alias("children")
    )


def fold_children(tree: DataFrame, keep: int = fixed.CHILDREN_TOP, heads: int = fixed.SMALL_UNIT_HEADS) -> DataFrame:
    """Per parent the largest children by name, and one box for all others with their number and headcount.

    The largest are found with a limited row number, which Spark trims inside each task; the rest is a sum.
    """
    below = cut_lineage(tree.filter(F.col("parent").isNotNull()).select("parent", "code", "latest"))
    order = Window.partitionBy("parent").orderBy(F.desc("latest"), "code")
    shown = (
        below.filter(F.col("latest") >= heads)
        .withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= keep)
        .select("parent", "code", F.lit(True).alias("shown"))
    )
    boxed = below.join(shown, ["parent", "code"], "left")
    return boxed.groupBy(
        "parent", F.when(F.col("shown"), F.col("code")).otherwise(fixed.OTHER).alias("box")
    ).agg(F.count(F.lit(1)).alias("units"), F.sum("latest").alias("latest"))


def gone(nodes: DataFrame, latest: Column) -> DataFrame:
    """Flag nodes whose last month lies before the latest one."""
    return nodes.withColumn("gone", F.col("last_seen") < latest)
