"""Names: match keys, titles, exact and contained matches, aliases, groups, the month cover."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywell import fixed_values as fixed
from tallywell.functions import names
from tallywell.operators import checks, crosswalk
from tallywell.queries.registry import query, rounded, table
from tallywell.session import literal_table

# --- keys -------------------------------------------------------------------------------------------------------

_MESSY = "concat(CASE p_size % 4 WHEN 0 THEN 'Department of the ' WHEN 1 THEN 'U.S. ' WHEN 2 THEN 'The ' ELSE 'Nat ' END, p_name, ' & ', p_type, ' Admin (', p_brand, ') Agy-Corp.')"


def _key_sql(text: str) -> str:
    words = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in fixed.NAME_ABBREVIATIONS.items())
    out = f"replace(replace(replace(upper({text}), '&', ' AND '), '--', ' '), '-', ' ')"
    out = rf"regexp_replace({out}, '\bU\.S\.\s*', 'US ', 'g')"
    out = f"regexp_replace({out}, '[.,''()*]', '', 'g')"
    out = rf"regexp_replace({out}, '\bU S\b', 'US', 'g')"
    out = rf"trim(regexp_replace({out}, '\s+', ' ', 'g'))"
    out = f"array_to_string([CASE w {words} ELSE w END FOR w IN string_split({out}, ' ')], ' ')"
    for prefix in fixed.NAME_PREFIXES:
        out = f"regexp_replace({out}, '^{prefix}', '')"
    return f"trim({out})"


def _unit_sql(text: str, fillers: str) -> str:
    bare = rf"regexp_replace({text}, '\s*\([^)]*\)', '', 'g')"
    return rf"trim(regexp_replace(regexp_replace({_key_sql(bare)}, '{fillers}', ' ', 'g'), '\s+', ' ', 'g'))"


@query("P23", f"SELECT p_partkey, {_key_sql(_MESSY)} AS key FROM part")
def match_keys(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select("p_partkey", names.match_key(F.expr(_MESSY)).alias("key"))


_UNITY = f"concat('Office of the ', {_MESSY}, ' (Overall) Bureau of the US7')"


@query("P24 P23", f"""SELECT p_partkey, {_unit_sql(_UNITY, fixed.ROSTER_FILLERS)} AS roster_key, {_unit_sql(_UNITY, fixed.SURVEY_FILLERS)} AS survey_key,
  {_key_sql("trim(regexp_replace(trim(regexp_replace(" + _UNITY + r", '\s*\([^)]*\)', '', 'g')), '\d+$', ''))")} AS footnoted_key FROM part""")
def unit_keys(spark: SparkSession, folder: str) -> DataFrame:
    text = F.expr(_UNITY)
    return table(spark, folder, "part").select(
        "p_partkey", names.unit_key(text).alias("roster_key"), names.unit_key(text, fixed.SURVEY_FILLERS).alias("survey_key"),
        names.footnoted_key(text).alias("footnoted_key"))


_TITLE_WORDS = " ".join(f"WHEN '{w}' THEN '{w.upper()}'" for w in fixed.TITLE_ACRONYMS) + " " + " ".join(
    f"WHEN '{w}' THEN '{t}'" for w, t in fixed.TITLE_ABBREVIATIONS.items())
_SMALL = ", ".join(f"'{w}'" for w in fixed.TITLE_SMALL_WORDS)
_LABEL = "concat('OFC OF THE ', upper(p_name), '-', p_type, ' SVCS AND U.S. EPA  MGMT AT ', p_brand)"


@query("P25", f"""SELECT p_partkey, array_to_string([CASE WHEN i > 1 AND w IN ({_SMALL}) THEN w ELSE
   array_to_string([CASE part {_TITLE_WORDS} ELSE upper(part[1]) || substr(part, 2) END FOR part IN string_split(w, '-')], '-') END
   FOR w, i IN string_split(trim(regexp_replace(lower({_LABEL}), '\\s+', ' ', 'g')), ' ')], ' ') AS title FROM part""")
def display_titles(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select("p_partkey", names.title(F.expr(_LABEL)).alias("title"))


@query("P26", r"""SELECT doc_id, md5(regexp_replace(lower(trim(regexp_replace(translate(text, '‘’“”', '''''""'), '\s+', ' ', 'g'))), '[?. ]+$', '')) AS key_hash FROM documents""")
def item_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Whole texts as survey-item keys; a hash stands for the text in the output."""
    return table(spark, folder, "documents").select("doc_id", F.md5(names.item_key("text")).alias("key_hash"))


# --- matching ------------------------------------------------------------------------------------------------------

# Units are part names within a kind of part; targets are names as others write them.
_UNITS_SQL = "units AS (SELECT DISTINCT p_type AS agency, upper(p_name) AS name, 'U' || cast(min(p_partkey) AS VARCHAR) AS code FROM part GROUP BY p_type, p_name)"
_TARGETS = """CASE p_size % 5 WHEN 0 THEN upper(p_name) WHEN 1 THEN concat('NEW ', upper(p_name), ' DIVISION') WHEN 2 THEN substr(upper(p_name), 1, 4)
  WHEN 3 THEN concat(upper(p_name), ' ', p_brand) ELSE p_brand END"""
_MATCHED_SQL = f"""{_UNITS_SQL}, targets AS (SELECT DISTINCT p_type AS agency, {_TARGETS} AS target FROM part),
exact AS (SELECT t.agency, t.target, min(u.code) AS code FROM targets t JOIN units u ON u.agency = t.agency AND u.name = t.target GROUP BY 1, 2),
hits AS (SELECT t.agency, t.target, min(u.code) AS code FROM targets t JOIN units u ON u.agency = t.agency AND u.name <> '' AND (contains(t.target, u.name) OR contains(u.name, t.target)) WHERE t.target <> ''
  GROUP BY 1, 2 HAVING count(DISTINCT u.code) = 1),
matched AS (SELECT t.agency, t.target, coalesce(e.code, h.code, t.agency) AS node, CASE WHEN e.code IS NOT NULL THEN 'normalized' WHEN h.code IS NOT NULL THEN 'contains' ELSE 'agency' END AS method
  FROM targets t LEFT JOIN exact e ON e.agency = t.agency AND e.target = t.target LEFT JOIN hits h ON h.agency = t.agency AND h.target = t.target)"""


def _units(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").groupBy(F.col("p_type").alias("agency"), F.upper("p_name").alias("name")).agg(
        F.concat(F.lit("U"), F.min("p_partkey").cast("string")).alias("code"))


def _targets(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(F.col("p_type").alias("agency"), F.expr(_TARGETS).alias("target")).distinct()


@query("J14 J15 J18", f"WITH {_MATCHED_SQL} SELECT * FROM matched")
def matched_units(spark: SparkSession, folder: str) -> DataFrame:
    """Equal names, then names contained in one another if only one fits, else the agency itself."""
    return crosswalk.match_units(_targets(spark, folder), _units(spark, folder))


@query("J15", f"""WITH {_UNITS_SQL}, targets AS (SELECT DISTINCT p_type AS agency, {_TARGETS} AS target FROM part)
SELECT DISTINCT t.agency, t.target AS needle, u.name AS haystack FROM targets t JOIN units u ON u.agency = t.agency AND contains(u.name, t.target) WHERE t.target <> ''""")
def contained_names(spark: SparkSession, folder: str) -> DataFrame:
    needles = _targets(spark, folder).withColumnRenamed("target", "needle")
    return crosswalk.contained_pairs(needles, _units(spark, folder).withColumnRenamed("name", "haystack"), "agency")


@query("J17", f"""WITH {_MATCHED_SQL}, manual AS (SELECT DISTINCT p_type AS agency, upper(p_name) AS target, 'BY HAND' AS node FROM part WHERE p_brand = 'Brand#2')
SELECT agency, target, node, method FROM matched m WHERE NOT EXISTS (SELECT 1 FROM manual x WHERE x.agency = m.agency AND x.target = m.target)
UNION ALL SELECT agency, target, node, 'manual' FROM manual""")
def manual_matches_win(spark: SparkSession, folder: str) -> DataFrame:
    found = crosswalk.match_units(_targets(spark, folder), _units(spark, folder))
    manual = table(spark, folder, "part").filter("p_brand = 'Brand#2'").select(
        F.col("p_type").alias("agency"), F.upper("p_name").alias("target"), F.lit("BY HAND").alias("node")).distinct()
    return crosswalk.keep_manual(found, manual, ["agency", "target"])


@query("J17 J5", """WITH c AS (SELECT DISTINCT p_brand || CASE WHEN p_size > 40 THEN 'ZZ' ELSE '' END AS code FROM part)
SELECT code, code LIKE '%ZZ' AS residual FROM c""")
def residual_units(spark: SparkSession, folder: str) -> DataFrame:
    codes = table(spark, folder, "part").select(
        F.concat("p_brand", F.when(F.col("p_size") > 40, fixed.RESIDUAL_SUFFIX).otherwise("")).alias("code")).distinct()
    real, residual = crosswalk.split_residual(codes, "code")
    return real.withColumn("residual", F.lit(False)).unionByName(residual.withColumn("residual", F.lit(True)))


@query("Q21", f"""WITH {_MATCHED_SQL} SELECT method, count(*) AS targets, count(*) AS weight, round(count(*) / (SELECT count(*) FROM matched), 6) AS share FROM matched GROUP BY 1""")
def match_quality(spark: SparkSession, folder: str) -> DataFrame:
    found = crosswalk.match_units(_targets(spark, folder), _units(spark, folder))
    return rounded(crosswalk.match_quality(found), share=6)


# Agency names as a roster writes them, resolved through ever looser aliases.
_WRITTEN = """CASE WHEN c_custkey % 6 = 0 THEN concat('NATION_', cast(c_nationkey as string)) WHEN c_custkey % 6 = 1 THEN concat('Executive Office of the Chief - Office of ', c_mktsegment)
  WHEN c_custkey % 6 = 2 THEN concat('Council - NATION_', cast(c_nationkey as string)) WHEN c_custkey % 6 = 3 THEN concat('The ', c_mktsegment, ' Board') WHEN c_custkey % 6 = 4 THEN concat('Bureau of ', c_mktsegment)
  ELSE concat('Unknown ', cast(c_nationkey as string)) END"""
_ALIAS_SQL = """aliases AS (SELECT 'index' AS source, n_name AS key, lpad(cast(n_nationkey AS VARCHAR), 2, '0') AS code FROM nation
  UNION ALL SELECT DISTINCT 'component', c_mktsegment, 'C' || left(c_mktsegment, 2) FROM customer
  UNION ALL SELECT DISTINCT 'folded', c_mktsegment, 'F' || left(c_mktsegment, 2) FROM customer WHERE c_mktsegment <> 'MACHINERY')"""


@query("J16 J17 J18", f"""WITH {_ALIAS_SQL}, written AS (SELECT DISTINCT {_WRITTEN} AS agency_name FROM customer),
p AS (SELECT agency_name, {_key_sql('agency_name')} AS na, {_unit_sql('agency_name', fixed.ROSTER_FILLERS)} AS ua, contains(agency_name, ' - ') AS split,
   {_key_sql("split_part(agency_name, ' - ', 1)")} AS head, {_key_sql("split_part(agency_name, ' - ', 2)")} AS nt, {_unit_sql("split_part(agency_name, ' - ', 2)", fixed.ROSTER_FILLERS)} AS ut FROM written),
r AS (SELECT agency_name, coalesce(
   (SELECT min(code) FROM aliases WHERE source = 'index' AND key = na),
   CASE WHEN split AND contains(head, 'EXECUTIVE OFFICE') THEN coalesce((SELECT min(code) FROM aliases WHERE source = 'component' AND key = nt), (SELECT min(code) FROM aliases WHERE source = 'component' AND key = ut)) END,
   CASE WHEN split THEN coalesce((SELECT min(code) FROM aliases WHERE source = 'index' AND key = nt), (SELECT min(code) FROM aliases WHERE source = 'folded' AND key = nt), (SELECT min(code) FROM aliases WHERE source = 'folded' AND key = ut)) END,
   (SELECT min(code) FROM aliases WHERE source = 'folded' AND key = na), (SELECT min(code) FROM aliases WHERE source = 'component' AND key = na), (SELECT min(code) FROM aliases WHERE source = 'folded' AND key = ua),
   CASE WHEN contains(na, 'BOARD') THEN 'HB' END) AS agency FROM p)
SELECT agency_name, CASE WHEN agency <> 'CHO' THEN agency END AS agency FROM r""")
def resolved_agencies(spark: SparkSession, folder: str) -> DataFrame:
    customer, nation = table(spark, folder, "customer"), table(spark, folder, "nation")
    written = customer.select(F.expr(_WRITTEN).alias("agency_name")).distinct()
    segments = customer.select("c_mktsegment").distinct()
    lead = F.substring("c_mktsegment", 1, 2)
    aliases = nation.selectExpr("'index' AS source", "n_name AS key", "lpad(n_nationkey, 2, '0') AS code").unionByName(
        segments.select(F.lit("component").alias("source"), F.col("c_mktsegment").alias("key"), F.concat(F.lit("C"), lead).alias("code"))
    ).unionByName(segments.filter("c_mktsegment <> 'MACHINERY'").select(F.lit("folded").alias("source"), F.col("c_mktsegment").alias("key"), F.concat(F.lit("F"), lead).alias("code")))
    resolved = crosswalk.resolve_agency(written, aliases, {"BOARD": "HB"})
    carried = aliases.select("code").distinct().filter("code <> 'CHO'").unionByName(literal_table(spark, "code string", [("HB",)]))
    return crosswalk.existing_only(resolved, carried).select("agency_name", "agency")


_SEED_SQL = """curated AS (SELECT 'own' AS gid, 'agency' AS kind, lpad(cast(n_nationkey AS VARCHAR), 2, '0') AS label FROM nation WHERE n_regionkey = 0
  UNION ALL SELECT 'own', 'money', 'Department of ' || n_name FROM nation WHERE n_regionkey = 0),
money AS (SELECT 'Department of ' || n_name AS label FROM nation UNION ALL SELECT DISTINCT 'Unit ' || c_mktsegment FROM customer),
free AS (SELECT lpad(cast(n_nationkey AS VARCHAR), 2, '0') AS code, n_name FROM nation WHERE n_regionkey <> 0)"""


def _seeded(spark: SparkSession, folder: str):
    nation = table(spark, folder, "nation")
    code = F.lpad(F.col("n_nationkey").cast("string"), 2, "0")
    label = F.concat(F.lit("Department of "), "n_name")
    first = nation.filter("n_regionkey = 0")
    curated = first.select(F.lit("own").alias("gid"), F.lit("agency").alias("kind"), code.alias("label")).unionByName(
        first.select(F.lit("own").alias("gid"), F.lit("money").alias("kind"), label.alias("label")))
    money = nation.select(label.alias("label")).unionByName(
        table(spark, folder, "customer").select(F.concat(F.lit("Unit "), "c_mktsegment").alias("label")).distinct())
    return crosswalk.seed_groups(curated, nation.select(code.alias("code"), F.col("n_name").alias("name")), {"money": money})


@query("A35 J14", f"""WITH {_SEED_SQL} SELECT * FROM curated UNION ALL SELECT lower(code), 'agency', code FROM free UNION ALL SELECT lower(code), 'money', 'Department of ' || n_name FROM free""")
def seeded_groups(spark: SparkSession, folder: str) -> DataFrame:
    return _seeded(spark, folder)[0]


@query("A35 J5 Q21", f"""WITH {_SEED_SQL} SELECT label FROM money WHERE label LIKE 'Unit %'""")
def labels_without_group(spark: SparkSession, folder: str) -> DataFrame:
    return _seeded(spark, folder)[1]["money"]


@query("U5", """WITH RECURSIVE seen AS (SELECT DISTINCT o_custkey AS code, strftime(o_orderdate, '%Y%m') AS month FROM orders),
sets AS (SELECT code, list(month) AS months FROM seen GROUP BY code),
cover(round, month, gain, done) AS (
  SELECT 0, NULL::VARCHAR, 0::BIGINT, []::VARCHAR[]
  UNION ALL
  SELECT round + 1, best.month, best.gain, list_append(done, best.month) FROM (
    SELECT round, done, max({'gain': gain, 'month': month}) AS best FROM (
      SELECT c.round, c.done, s.month, count(*) AS gain FROM cover c, (SELECT months, unnest(months) AS month FROM sets) s
      WHERE NOT list_has_any(s.months, c.done) GROUP BY ALL) GROUP BY ALL))
SELECT month, cast(round AS INTEGER) AS round, gain, (SELECT count(*) FROM seen s WHERE s.month = cover.month) AS codes FROM cover WHERE round > 0""")
def covering_months(spark: SparkSession, folder: str) -> DataFrame:
    """Fewest months, greedily, in which every customer placed an order: customers first covered, and seen, in each."""
    seen = table(spark, folder, "orders").select(F.col("o_custkey").alias("code"), F.date_format("o_orderdate", "yyyyMM").alias("month"))
    chosen = crosswalk.covering_months(seen)
    order = literal_table(spark, "month string, round int, gain long", [(m, i, gain) for i, (m, gain) in enumerate(chosen, 1)])
    return seen.join(order, "month").groupBy("month", "round", "gain").agg(F.countDistinct("code").alias("codes"))


@query("Q22", """SELECT code, count(DISTINCT gid) AS groups FROM (SELECT 'r' || cast(n_regionkey AS VARCHAR) AS gid, n_nationkey AS code FROM nation
  UNION ALL SELECT 'x', n_nationkey FROM nation WHERE n_regionkey = 2) GROUP BY 1 HAVING count(DISTINCT gid) > 1""")
def members_of_two_groups(spark: SparkSession, folder: str) -> DataFrame:
    nation = table(spark, folder, "nation")
    members = nation.selectExpr("concat('r', n_regionkey) AS gid", "n_nationkey AS code").unionByName(
        nation.filter("n_regionkey = 2").selectExpr("'x' AS gid", "n_nationkey AS code"))
    return checks.more_than_one_group(members)
