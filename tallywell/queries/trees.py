"""The organisation tree: roll-ups, groups, zero rows, paths and tree tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallywell.operators import checks, facts, hierarchy
from tallywell.plans.catalog import flows
from tallywell.queries import gathering, standin
from tallywell.queries.registry import query, rounded, table
from tallywell.session import literal_table, materialise
from tallywell.sources import tables

# Agencies are nations, departments regions; sub-elements are the units of the record stand-ins.
AGENCY_DEPARTMENT_SQL = "agency_dept AS (SELECT lpad(cast(n_nationkey AS VARCHAR), 2, '0') AS agency, 'D:R' || cast(n_regionkey AS VARCHAR) AS dept FROM nation)"
FLOWS = flows()
_FLOW_LIST = ", ".join(f"'{code}'" for code, _ in FLOWS)

# A row belongs to its own node (unless it has a dimension, which starts at the agency), to its agency, to the agency's
# department and to the government; summing over that list gives every level at once.
ROLLED_SQL = f"""{gathering.EXTRACTS_SQL}, {AGENCY_DEPARTMENT_SQL},
ranked AS (SELECT *, source_ref = max(source_ref) OVER (PARTITION BY measure, node, period_type, period_start, dim, dim_value) AS newest FROM raw_facts),
lifted AS (SELECT r.*, CASE WHEN dim IS NULL THEN [node] ELSE [] END || [substr(node, 1, 2), dept, 'gov'] AS path
   FROM ranked r LEFT JOIN agency_dept ON agency = substr(node, 1, 2) WHERE newest OR measure IN ({_FLOW_LIST})),
rolled AS (SELECT measure, place AS node, period_type, period_start, dim, dim_value, sum(value) AS value, max(source_ref) AS source_ref
   FROM (SELECT * EXCLUDE (path), unnest(path) AS place FROM lifted) WHERE place IS NOT NULL GROUP BY ALL)"""

# The given dates lie before the first month of the real flows, so the stand-in opens every flow in 1996.
STANDIN_SINCE = "1996-01-01"
STANDIN_FLOWS = [(code, STANDIN_SINCE) for code, _ in FLOWS]
# Unit months that have people, for every flow within its time, less those that recorded the flow.
ZERO_SQL = f"""openings AS (SELECT code, since, max(period_start) AS until
   FROM (VALUES {", ".join(f"('{code}', DATE '{since}')" for code, since in STANDIN_FLOWS)}) o(code, since) JOIN rolled ON measure = code AND dim IS NULL GROUP BY 1, 2),
silent AS (SELECT code AS measure, node, period_start FROM rolled JOIN openings ON period_start BETWEEN since AND until WHERE measure = 'headcount' AND dim IS NULL
   EXCEPT SELECT measure, node, period_start FROM rolled WHERE dim IS NULL),
zeros AS (SELECT measure, node, 'month' AS period_type, period_start, cast(NULL AS VARCHAR) AS dim, cast(NULL AS VARCHAR) AS dim_value, 0.0::DOUBLE AS value,
   'zero-fill' AS source_ref FROM silent)"""


def agency_department(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "nation").selectExpr("lpad(n_nationkey, 2, '0') AS agency", "concat('D:R', n_regionkey) AS dept")


def rolled(spark: SparkSession, folder: str) -> DataFrame:
    numbered, sources = facts.number_sources(gathering.stored_extracts(spark, folder))
    leaf = facts.resolve_numbered(numbered, [code for code, _ in FLOWS])
    return facts.name_sources(hierarchy.roll_up_numbered(leaf, agency_department(spark, folder)), sources)


def _rows(df: DataFrame) -> DataFrame:
    return rounded(df.select("measure", "node", "period_start", "dim", "dim_value", "value"), value=2)


@query("A8 J6 P8 U1 J4", f"WITH {ROLLED_SQL} SELECT measure, node, period_start, dim, dim_value, round(value, 2) AS value FROM rolled")
def rolled_up_values(spark: SparkSession, folder: str) -> DataFrame:
    """Base rows of three record kinds at sub-element, agency, department and government."""
    return _rows(rolled(spark, folder))


@query("A9 J5 U1", f"WITH {ROLLED_SQL}, {ZERO_SQL} SELECT measure, node, period_start, value FROM zeros")
def zero_rows(spark: SparkSession, folder: str) -> DataFrame:
    return hierarchy.zero_fill(materialise(rolled(spark, folder), "rolled"), STANDIN_FLOWS).select("measure", "node", "period_start", "value")


_MEMBERS_SQL = """members AS (
  SELECT 'g' || cast(n_regionkey AS VARCHAR) AS gid, 'agency' AS kind, lpad(cast(n_nationkey AS VARCHAR), 2, '0') AS code, 1 AS sign FROM nation
  UNION ALL SELECT 'g' || cast(n_regionkey AS VARCHAR), 'org', lpad(cast(n_nationkey AS VARCHAR), 2, '0') || '03', -1 FROM nation)"""


def _groups(spark: SparkSession, folder: str) -> DataFrame:
    """Group definitions: all nations of a region, without each nation's unit 03."""
    code = F.lpad(F.col("n_nationkey").cast("string"), 2, "0")
    return table(spark, folder, "nation").groupBy(F.concat(F.lit("g"), F.col("n_regionkey").cast("string")).alias("gid")).agg(
        F.collect_set(code).alias("agency_codes"), F.array().cast("array<string>").alias("org_codes"),
        F.collect_set(F.concat(code, F.lit("03"))).alias("exclude_org_codes"))


def _kinds(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("node").alias("code")).distinct().select("code", F.when(F.col("code") == "gov", "gov").when(
        F.col("code").startswith("D:"), "department").when(F.length("code") == 2, "agency").otherwise("subelement").alias("kind"))


@query("J7 S8 M5", f"""WITH {ROLLED_SQL}, {_MEMBERS_SQL}
SELECT g.gid AS node, f.period_start, sum(f.value * g.sign) AS value FROM members g JOIN rolled f ON f.node = g.code
WHERE f.measure = 'headcount' AND f.dim IS NULL GROUP BY 1, 2""")
def signed_group_headcount(spark: SparkSession, folder: str) -> DataFrame:
    rows = materialise(rolled(spark, folder), "rolled")
    members = tables.group_members(_groups(spark, folder))
    return hierarchy.signed_groups(rows, members, _kinds(rows)).select("node", "period_start", "value")


@query("S8 A40", """
WITH units AS (SELECT DISTINCT lpad(cast(s_nationkey AS VARCHAR), 2, '0') AS agency, 'S' || lpad(cast(s_suppkey AS VARCHAR), 6, '0') AS code, s_name FROM supplier),
multi AS (SELECT n_regionkey FROM nation GROUP BY 1 HAVING count(*) > 1)
SELECT 'gov' AS code, 'gov' AS kind, NULL AS parent
UNION ALL SELECT 'D:' || cast(n_regionkey AS VARCHAR), 'department', 'gov' FROM multi
UNION ALL SELECT lpad(cast(n_nationkey AS VARCHAR), 2, '0'), 'agency', CASE WHEN n_regionkey IN (SELECT n_regionkey FROM multi) THEN 'D:' || cast(n_regionkey AS VARCHAR) ELSE 'gov' END FROM nation
UNION ALL SELECT code, 'subelement', agency FROM units""")
def node_table(spark: SparkSession, folder: str) -> DataFrame:
    return _supplier_nodes(spark, folder).select("code", "kind", "parent")


def _supplier_nodes(spark: SparkSession, folder: str) -> DataFrame:
    agency = table(spark, folder, "nation").selectExpr("lpad(n_nationkey, 2, '0') AS code", "n_name AS name", "cast(n_regionkey AS string) AS department_code")
    org = table(spark, folder, "supplier").selectExpr(
        "concat('S', lpad(cast(s_suppkey AS string), 6, '0')) AS code", "s_name AS name", "lpad(s_nationkey, 2, '0') AS agency_code")
    department = table(spark, folder, "region").selectExpr("cast(r_regionkey AS string) AS code", "r_name AS name")
    return hierarchy.build_nodes(agency, org, department)


_TREE_SQL = """nodes AS (
SELECT 'gov' AS code, 'gov' AS kind, NULL AS parent
UNION ALL SELECT 'D:' || cast(r_regionkey AS VARCHAR), 'department', 'gov' FROM region
UNION ALL SELECT lpad(cast(n_nationkey AS VARCHAR), 2, '0'), 'agency', 'D:' || cast(n_regionkey AS VARCHAR) FROM nation
UNION ALL SELECT 'S' || lpad(cast(s_suppkey AS VARCHAR), 6, '0'), 'subelement', lpad(cast(s_nationkey AS VARCHAR), 2, '0') FROM supplier)"""


@query("J20", f"""WITH RECURSIVE {_TREE_SQL},
up AS (SELECT code, code AS ancestor, parent AS next, 0 AS distance FROM nodes
  UNION ALL SELECT u.code, n.code, n.parent, u.distance + 1 FROM up u JOIN nodes n ON n.code = u.next)
SELECT code, string_agg(ancestor, '>' ORDER BY distance DESC) AS path, count(*) AS depth FROM up GROUP BY code""")
def paths_to_root(spark: SparkSession, folder: str) -> DataFrame:
    paths = hierarchy.path_to_root(_supplier_nodes(spark, folder))
    return paths.select("code", F.array_join("path", ">").alias("path"), F.size("path").cast("long").alias("depth"))


# A tree as deep as the data make it: every order stands below the order before it of the same customer, the first ones
# below their nation.
_LINES_SQL = """nodes AS (
SELECT 'gov' AS code, cast(NULL AS VARCHAR) AS parent, cast(NULL AS DOUBLE) AS price, cast(NULL AS VARCHAR) AS priority
UNION ALL SELECT 'D:' || cast(r_regionkey AS VARCHAR), 'gov', NULL, NULL FROM region
UNION ALL SELECT lpad(cast(n_nationkey AS VARCHAR), 2, '0'), 'D:' || cast(n_regionkey AS VARCHAR), NULL, NULL FROM nation
UNION ALL SELECT 'O' || cast(o_orderkey AS VARCHAR), coalesce('O' || cast(lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS VARCHAR),
    lpad(cast(c_nationkey AS VARCHAR), 2, '0')), o_totalprice, o_orderpriority FROM orders LEFT JOIN customer ON c_custkey = o_custkey),
up AS (SELECT code, code AS ancestor, parent AS next, 0 AS distance FROM nodes
  UNION ALL SELECT u.code, n.code, n.parent, u.distance + 1 FROM up u JOIN nodes n ON n.code = u.next)"""


def _order_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(code, parent, price, priority): orders below the orders before them, below nations, regions and the root."""
    nation = F.lpad(F.col("c_nationkey").cast("string"), 2, "0")
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    orders = table(spark, folder, "orders").withColumn("before", before).join(table(spark, folder, "customer"), F.col("c_custkey") == F.col("o_custkey"), "left").select(
        F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("code"),
        F.coalesce(F.concat(F.lit("O"), F.col("before").cast("string")), nation).alias("parent"),
        F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority"))
    above = _supplier_nodes(spark, folder).filter("kind <> 'subelement'").select(
        "code", "parent", F.lit(None).cast("double").alias("price"), F.lit(None).cast("string").alias("priority"))
    return orders.unionByName(above)


@query("J20", f"""WITH RECURSIVE {_LINES_SQL}
SELECT code, string_agg(ancestor, '>' ORDER BY distance DESC) AS path, count(*) AS depth FROM up GROUP BY code""")
def paths_of_any_depth(spark: SparkSession, folder: str) -> DataFrame:
    """Paths in a tree that is as deep as the longest line of orders."""
    paths = hierarchy.path_to_root(_order_lines(spark, folder))
    return paths.select("code", F.array_join("path", ">").alias("path"), F.size("path").cast("long").alias("depth"))


@query("J6 J20", f"""WITH RECURSIVE {_LINES_SQL}
SELECT ancestor AS node, round(sum(price), 2) AS value FROM up JOIN nodes n USING (code) WHERE price IS NOT NULL GROUP BY ancestor""")
def totals_of_any_depth(spark: SparkSession, folder: str) -> DataFrame:
    """What stands below each node, however deep, added up over twice the way in every round."""
    nodes = materialise(_order_lines(spark, folder), "lines")
    leaf = nodes.filter("price IS NOT NULL").select(F.col("code").alias("node"), F.col("price").alias("value"))
    return rounded(hierarchy.totals_below(leaf, nodes), value=2)


@query("J19 J20", f"""WITH RECURSIVE {_LINES_SQL},
own AS (SELECT 'urgent' AS measure, code AS node, price AS value FROM nodes WHERE priority LIKE '1%' UNION ALL SELECT 'urgent', 'gov', cast(0 AS DOUBLE)
  UNION ALL SELECT 'price', code, price FROM nodes WHERE priority LIKE '5%'),
offers AS (SELECT u.code, o.measure, o.value, u.ancestor, row_number() OVER (PARTITION BY u.code, o.measure ORDER BY u.distance) AS rn
  FROM up u JOIN own o ON o.node = u.ancestor WHERE u.distance = 0 OR o.measure = 'urgent')
SELECT code AS node, measure, value, ancestor AS from_node FROM offers WHERE rn = 1""")
def inherited_at_any_depth(spark: SparkSession, folder: str) -> DataFrame:
    """The nearest urgent order at or before each order of a customer; a price is never inherited."""
    nodes = materialise(_order_lines(spark, folder), "lines")
    own = nodes.filter("priority LIKE '1%'").select(F.lit("urgent").alias("measure"), F.col("code").alias("node"), F.col("price").alias("value")).unionByName(
        nodes.filter("priority LIKE '5%'").select(F.lit("price").alias("measure"), F.col("code").alias("node"), F.col("price").alias("value"))).unionByName(
        literal_table(spark, "measure string, node string, value double", [("urgent", "gov", 0.0)]))
    return hierarchy.nearest_value(own, nodes, ["urgent"])


# Every part names another one; lines that reach a part of the largest size end there, the others run in circles.
_PART_LINE = "p_partkey * 7 % (SELECT count(*) FROM part) + 1"


@query("J20 Q7", f"""WITH RECURSIVE nodes AS (SELECT cast(p_partkey AS VARCHAR) AS code, CASE WHEN p_size < 50 THEN cast({_PART_LINE} AS VARCHAR) END AS parent FROM part),
up AS (SELECT code, parent AS ancestor FROM nodes WHERE parent IS NOT NULL UNION SELECT u.code, n.parent FROM up u JOIN nodes n ON n.code = u.ancestor WHERE n.parent IS NOT NULL),
circle AS (SELECT code FROM up WHERE code = ancestor)
SELECT DISTINCT code, code IN (SELECT code FROM circle) AS on_cycle FROM up WHERE ancestor IN (SELECT code FROM circle)""")
def lines_without_end(spark: SparkSession, folder: str) -> DataFrame:
    """Codes on a cycle of parents, and codes below one."""
    part = table(spark, folder, "part")
    count = part.agg(F.count("*")).scalar()
    above = (F.col("p_partkey") * 7 % count + 1).cast("string")
    return hierarchy.endless(part.select(F.col("p_partkey").cast("string").alias("code"), F.when(F.col("p_size") < 50, above).alias("parent")))


_LATEST_SQL = """latest AS (SELECT 'S' || lpad(cast(l_suppkey AS VARCHAR), 6, '0') AS code, cast(year(l_shipdate) * 100 + month(l_shipdate) AS VARCHAR) AS yyyymm, count(*) AS headcount FROM lineitem GROUP BY 1, 2),
agencies AS (SELECT n.parent AS code, l.yyyymm, sum(l.headcount) AS headcount FROM latest l JOIN nodes n ON n.code = l.code GROUP BY 1, 2)"""


def _monthly(spark: SparkSession, folder: str) -> DataFrame:
    """Headcount per month of suppliers and of their nations."""
    units = table(spark, folder, "lineitem").groupBy("l_suppkey", F.date_format("l_shipdate", "yyyyMM").alias("yyyymm")).agg(F.count(F.lit(1)).alias("headcount"))
    code = F.concat(F.lit("S"), F.lpad(F.col("l_suppkey").cast("string"), 6, "0"))
    unit_rows = units.select(code.alias("code"), "yyyymm", "headcount")
    nation = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.lpad(F.col("s_nationkey").cast("string"), 2, "0").alias("agency"))
    agency_rows = units.join(nation, "l_suppkey").groupBy(F.col("agency").alias("code"), "yyyymm").agg(F.sum("headcount").alias("headcount"))
    return unit_rows.unionByName(agency_rows)


@query("A39 P40 T4 J20", f"""WITH {_TREE_SQL}, {_LATEST_SQL},
months AS (SELECT max(yyyymm) AS m FROM agencies),
every AS (SELECT * FROM latest UNION ALL SELECT * FROM agencies
  UNION ALL SELECT n.parent, a.yyyymm, sum(a.headcount) FROM agencies a JOIN nodes n ON n.code = a.code GROUP BY 1, 2
  UNION ALL SELECT 'gov', yyyymm, sum(headcount) FROM agencies GROUP BY 2),
kids AS (SELECT parent, count(*) AS children FROM nodes WHERE parent IS NOT NULL GROUP BY 1)
SELECT n.code, n.kind, n.parent, cast(coalesce(e.headcount, 0) AS BIGINT) AS latest, coalesce(k.children, 0) AS children,
  n.kind = 'agency' AND coalesce(k.children, 0) <= 1 AS small
FROM nodes n LEFT JOIN every e ON e.code = n.code AND e.yyyymm = (SELECT m FROM months) LEFT JOIN kids k ON k.parent = n.code""")
def organisation_tree(spark: SparkSession, folder: str) -> DataFrame:
    return hierarchy.org_tree(_supplier_nodes(spark, folder), _monthly(spark, folder)).drop("name")


@query("T4 A39", f"""WITH {_TREE_SQL}, {_LATEST_SQL},
every AS (SELECT * FROM latest UNION ALL SELECT * FROM agencies
  UNION ALL SELECT n.parent, a.yyyymm, sum(a.headcount) FROM agencies a JOIN nodes n ON n.code = a.code GROUP BY 1, 2)
SELECT n.parent, n.code, cast(coalesce(e.headcount, 0) AS BIGINT) AS latest FROM nodes n
LEFT JOIN every e ON e.code = n.code AND e.yyyymm = (SELECT max(yyyymm) FROM agencies) WHERE n.parent IS NOT NULL ORDER BY 1, 3 DESC, 2""")
def children_by_headcount(spark: SparkSession, folder: str) -> DataFrame:
    """All children under their parents, largest first."""
    return hierarchy.ordered_children(hierarchy.org_tree(_supplier_nodes(spark, folder), _monthly(spark, folder)))


@query("P40 A27", f"""WITH {_LATEST_SQL.split("agencies AS")[0].rstrip().rstrip(",")}
SELECT code, max(yyyymm) AS last_seen, max(yyyymm) < (SELECT max(yyyymm) FROM latest) AS gone FROM latest GROUP BY code""")
def units_gone(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers and whether the newest month is without them."""
    monthly = _monthly(spark, folder).filter(F.col("code").startswith("S"))
    seen = monthly.groupBy("code").agg(F.max("yyyymm").alias("last_seen"))
    return hierarchy.gone(seen, monthly.select(F.max("yyyymm")).scalar())


@query("S8 J6", """WITH multi AS (SELECT n_regionkey FROM nation GROUP BY 1 HAVING count(*) > 1)
SELECT lpad(cast(n_nationkey AS VARCHAR), 2, '0') AS agency, 'D:' || cast(n_regionkey AS VARCHAR) AS dept FROM nation JOIN multi USING (n_regionkey)""")
def agencies_of_departments(spark: SparkSession, folder: str) -> DataFrame:
    """Agencies beside the department that is a node; one that is alone in its department stands under the whole."""
    agencies = table(spark, folder, "nation").selectExpr("lpad(n_nationkey, 2, '0') AS code", "cast(n_regionkey AS string) AS department_code")
    return tables.agency_departments(agencies, _supplier_nodes(spark, folder))


@query("M9 T4", f"""WITH {_TREE_SQL}, {_LATEST_SQL},
every AS (SELECT * FROM latest UNION ALL SELECT * FROM agencies
  UNION ALL SELECT n.parent, a.yyyymm, sum(a.headcount) FROM agencies a JOIN nodes n ON n.code = a.code GROUP BY 1, 2),
now AS (SELECT n.parent, n.code, coalesce(e.headcount, 0) AS latest FROM nodes n LEFT JOIN every e ON e.code = n.code AND e.yyyymm = (SELECT max(yyyymm) FROM agencies) WHERE n.parent IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY latest DESC, code) AS rn FROM now)
SELECT parent AS code, string_agg(code, ',' ORDER BY rn) AS children FROM r WHERE rn <= 20 GROUP BY 1""")
def largest_children(spark: SparkSession, folder: str) -> DataFrame:
    tree = hierarchy.org_tree(_supplier_nodes(spark, folder), _monthly(spark, folder))
    return hierarchy.children_arrays(tree, 20).select("code", F.array_join("children", ",").alias("children"))


@query("T5 T6 P40", f"""WITH {_TREE_SQL}, {_LATEST_SQL},
every AS (SELECT * FROM latest UNION ALL SELECT * FROM agencies
  UNION ALL SELECT n.parent, a.yyyymm, sum(a.headcount) FROM agencies a JOIN nodes n ON n.code = a.code GROUP BY 1, 2),
now AS (SELECT n.parent, n.code, coalesce(e.headcount, 0) AS latest FROM nodes n LEFT JOIN every e ON e.code = n.code AND e.yyyymm = (SELECT max(yyyymm) FROM agencies) WHERE n.parent IS NOT NULL),
r AS (SELECT *, latest >= 2 AND row_number() OVER (PARTITION BY parent ORDER BY latest DESC, code) <= 3 AS keep FROM now)
SELECT parent, CASE WHEN keep THEN code ELSE '_other' END AS box, count(*) AS units, cast(sum(latest) AS BIGINT) AS latest FROM r GROUP BY 1, 2""")
def folded_children(spark: SparkSession, folder: str) -> DataFrame:
    tree = hierarchy.org_tree(_supplier_nodes(spark, folder), _monthly(spark, folder))
    return hierarchy.fold_children(tree, keep=3, heads=2)


@query("J19 J20", f"""WITH RECURSIVE {_TREE_SQL},
own AS (SELECT 'score' AS measure, code AS node, cast(length(code) + r_regionkey AS DOUBLE) AS value FROM nodes JOIN region ON code = 'D:' || cast(r_regionkey AS VARCHAR)
  UNION ALL SELECT 'score', 'S' || lpad(cast(s_suppkey AS VARCHAR), 6, '0'), s_acctbal FROM supplier WHERE s_acctbal > 5000
  UNION ALL SELECT 'size', 'S' || lpad(cast(s_suppkey AS VARCHAR), 6, '0'), s_acctbal FROM supplier
  UNION ALL SELECT 'size', 'gov', 1.0),
up AS (SELECT code, code AS ancestor, parent AS next, 0 AS distance FROM nodes
  UNION ALL SELECT u.code, n.code, n.parent, u.distance + 1 FROM up u JOIN nodes n ON n.code = u.next),
offers AS (SELECT u.code, o.measure, o.value, u.ancestor, row_number() OVER (PARTITION BY u.code, o.measure ORDER BY u.distance) AS rn
  FROM up u JOIN own o ON o.node = u.ancestor WHERE u.distance = 0 OR o.measure = 'score')
SELECT code AS node, measure, value, ancestor AS from_node FROM offers WHERE rn = 1""")
def inherited_values(spark: SparkSession, folder: str) -> DataFrame:
    """A survey score comes from the nearest ancestor that has one; a size must be the node's own."""
    supplier = table(spark, folder, "supplier")
    code = F.concat(F.lit("S"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0"))
    region = table(spark, folder, "region").select(
        F.lit("score").alias("measure"), F.concat(F.lit("D:"), F.col("r_regionkey").cast("string")).alias("node"))
    own = region.withColumn("value", (F.length("node") + F.substring("node", 3, 9).cast("int")).cast("double")).unionByName(
        supplier.filter("s_acctbal > 5000").select(F.lit("score").alias("measure"), code.alias("node"), F.col("s_acctbal").alias("value"))
    ).unionByName(supplier.select(F.lit("size").alias("measure"), code.alias("node"), F.col("s_acctbal").alias("value"))
    ).unionByName(literal_table(spark, "measure string, node string, value double", [("size", "gov", 1.0)]))
    return hierarchy.nearest_value(own, _supplier_nodes(spark, folder), ["score"])


@query("A27 P36 J5", f"""WITH {gathering.EXTRACTS_SQL},
spans AS (SELECT node, min(period_start) AS first_seen, max(period_start) AS last_seen FROM raw_facts
  WHERE measure = 'headcount' AND dim IS NULL AND (length(node) = 4 OR (length(node) = 2 AND node = upper(node))) GROUP BY node),
known AS (SELECT lpad(cast(n_nationkey AS VARCHAR), 2, '0') AS code FROM nation WHERE n_regionkey <> 0),
found AS (SELECT lpad(cast(n_nationkey AS VARCHAR), 2, '0') || lpad(cast(n_regionkey AS VARCHAR), 2, '0') AS code, CASE WHEN n_regionkey = 1 THEN 'INVALID' ELSE 'OFC OF UNIT-' || cast(n_nationkey AS VARCHAR) END AS name FROM nation),
unknown AS (SELECT * FROM spans WHERE node NOT IN (SELECT code FROM known)),
parents AS (SELECT substr(node, 1, 2) AS node, min(first_seen) AS first_seen, max(last_seen) AS last_seen FROM unknown
  WHERE length(node) = 4 AND substr(node, 1, 2) NOT IN (SELECT code FROM known) GROUP BY 1),
every AS (SELECT * FROM unknown UNION ALL SELECT * FROM parents)
SELECT e.node AS code, CASE WHEN length(e.node) = 2 THEN 'agency' ELSE 'subelement' END AS kind,
  CASE WHEN length(e.node) = 2 THEN 'Agency ' || e.node || ' (historical; not in current OPM files)'
       WHEN f.name = 'INVALID' THEN 'Unrecorded sub-element (' || e.node || ')'
       WHEN f.name IS NOT NULL THEN replace(replace(f.name, 'OFC OF', 'Office of'), 'UNIT', 'Unit')
       ELSE e.node || ' (historical sub-element; name not in current OPM files)' END AS name,
  CASE WHEN length(e.node) = 2 THEN 'gov' ELSE substr(e.node, 1, 2) END AS parent,
  strftime(first_seen, '%Y%m') AS first_seen, strftime(last_seen, '%Y%m') AS last_seen
FROM every e LEFT JOIN found f ON f.code = e.node""")
def historical_nodes(spark: SparkSession, folder: str) -> DataFrame:
    nation = table(spark, folder, "nation")
    known = nation.filter("n_regionkey <> 0").selectExpr("lpad(n_nationkey, 2, '0') AS code")
    found = nation.selectExpr(
        "concat(lpad(n_nationkey, 2, '0'), lpad(n_regionkey, 2, '0')) AS code",
        "CASE WHEN n_regionkey = 1 THEN 'INVALID' ELSE concat('OFC OF UNIT-', n_nationkey) END AS name", "'199501' AS from_month")
    return hierarchy.historical_nodes(facts.observed_span(gathering.stored_extracts(spark, folder)), known, found)


@query("Q11 J11", f"""WITH {standin.NODE_VALUES_SQL},
shifted AS (SELECT node, period_start, CASE WHEN node = 'gov' AND month(period_start) = 6 THEN value + 1 ELSE value END AS value FROM vals WHERE measure = 'headcount'),
parts AS (SELECT period_start, sum(value) AS parts FROM shifted WHERE node IN (SELECT code FROM nodes WHERE kind = 'agency') GROUP BY 1),
whole AS (SELECT period_start, value AS whole FROM shifted WHERE node = 'gov')
SELECT period_start, whole, parts FROM whole JOIN parts USING (period_start) WHERE abs(whole - parts) > 0.5""")
def months_not_adding_up(spark: SparkSession, folder: str) -> DataFrame:
    """Agencies against the whole; the stand-in counts one person too many each June."""
    values = standin.node_values(spark, folder)
    wrong = (F.col("node") == "gov") & (F.col("measure") == "headcount") & (F.month("period_start") == 6)
    values = values.withColumn("value", F.when(wrong, F.col("value") + 1).otherwise(F.col("value")))
    return checks.children_sum(values, standin.nodes(spark, folder))
