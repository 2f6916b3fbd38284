"""Operators against brute force, with one key or group holding most rows."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from tallywell.operators import checks, crosswalk, facts, hierarchy, money, roster, survey, views
from tallywell.plans import registry
from tallywell.plans.catalog import CATALOG, as_table
from tallywell.schema import VALUE_SCHEMA, as_values
from tallywell.session import cut_lineage, literal_table
from tallywell.sources import records, sinks, tables


def values_frame(spark, rows):
    """rows: (measure, node, date, dim, dim_value, value, source)"""
    full = [(m, n, "month", d, dim, dv, v, None, None, s) for m, n, d, dim, dv, v, s in rows]
    return spark.createDataFrame(full, VALUE_SCHEMA)


JAN, FEB, MAR = date(2025, 1, 1), date(2025, 2, 1), date(2025, 3, 1)


def test_numbering_a_crowded_key(spark):
    rng = random.Random(7)
    rows = [(("hot" if i % 3 else f"k{i % 50}"), rng.choice([None, *range(200)]), i) for i in range(3000)]
    got = roster.numbered(spark.createDataFrame(rows, "key string, at int, id int"), ["key"], [F.col("at").asc_nulls_first(), "id"])
    expected, held = {}, {}
    for key in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        held[key] = len(mine)
        expected.update({r[2]: i for i, r in enumerate(mine, 1)})
    out = got.collect()
    assert {r.id: r.seq for r in out} == expected
    assert all(r.seq_of == held[r.key] for r in out)


def test_one_person_with_one_date_is_cut_as_well(spark):
    from tallywell.operators.slices import with_range

    rows = spark.range(4000).selectExpr(
        "CASE WHEN id % 10 = 0 THEN concat('p', id) ELSE 'hot' END AS person", "CASE WHEN id % 7 = 0 THEN date'2024-01-01' END AS begin", "'t' AS title", "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranges = with_range(rows, ["person", F.col("begin").asc_nulls_first(), "title"], "part").groupBy("part").count().collect()
        out = roster.numbered(rows, ["person"], [F.col("begin").asc_nulls_first(), "title"]).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(ranges) >= 4 and max(r["count"] for r in ranges) < 1500
    hot = sorted((r for r in out if r.person == "hot"), key=lambda r: r.seq)
    assert [r.seq for r in hot] == list(range(1, 3601)) and {r.seq_of for r in hot} == {3600}
    dated = [r.begin is not None for r in hot]
    assert dated == sorted(dated)


def test_average_rank_with_a_hot_value(spark):
    rng = random.Random(3)
    numbers = [5.0] * 700 + [round(rng.random() * 100, 1) for _ in range(1300)]
    got = {r.value: r.rank for r in survey.average_rank(spark.createDataFrame([(x,) for x in numbers], "x double"), "x").collect()}
    for x in set(numbers):
        below, same = sum(y < x for y in numbers), numbers.count(x)
        assert got[x] == below + (same + 1) / 2


def test_contained_pairs_equal_all_pairs(spark):
    rng = random.Random(11)
    words = ["".join(rng.choice("AB ") for _ in range(rng.randint(0, 7))) for _ in range(160)]
    needles = [("g" if i % 4 else "h", w) for i, w in enumerate(words[:80])]
    hays = [("g" if i % 4 else "h", w) for i, w in enumerate(words[80:])]
    got = crosswalk.contained_pairs(
        spark.createDataFrame(needles, "grp string, needle string"), spark.createDataFrame(hays, "grp string, haystack string"), "grp")
    expected = {(g, n, h) for g, n in needles for k, h in hays if g == k and n and h and n in h}
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == expected and len(rows) == len(expected)


def test_month_cover_is_the_greedy_one(spark):
    rng = random.Random(5)
    rows = [(f"c{i}", f"2024{m:02d}") for i in range(300) for m in range(1, 13) if rng.random() < 0.2 or (i % 3 == 0 and m == 6)]
    left, expected = {c for c, _ in rows}, []
    by_month = {}
    for c, m in rows:
        by_month.setdefault(m, set()).add(c)
    while left:
        best = max(by_month, key=lambda m: (len(by_month[m] & left), m))
        expected.append(best)
        left -= by_month[best]
    assert [month for month, _ in crosswalk.covering_months(spark.createDataFrame(rows, "code string, month string"))] == expected


def test_top_and_other_conserves_totals(spark):
    rng = random.Random(2)
    rows = [("hot" if i % 3 == 0 else f"g{i % 7}", f"v{rng.randint(0, 40)}", rng.randint(1, 4), float(i % 11)) for i in range(4000)]
    df = spark.createDataFrame(rows, "grp string, item string, period int, value double")
    out = views.top_and_other(df, ["grp"], "item", "value", 8, "period").collect()
    for group in {r[0] for r in rows}:
        mine = [r for r in out if r.grp == group]
        assert sum(r.value for r in mine) == sum(r[3] for r in rows if r[0] == group)
        assert len({r.item for r in mine}) == 9


def test_duplicates_by_kind_and_version(spark):
    rows = [
        ("quits", "A", JAN, None, None, 2.0, "fwd:separations_202501_1"), ("quits", "A", JAN, None, None, 3.0, "fwd:separations_202502_1"),
        ("headcount", "A", JAN, None, None, 9.0, "fwd:employment_202501_9"), ("headcount", "A", JAN, None, None, 10.0, "fwd:employment_202501_10"),
        ("headcount", "B", JAN, None, None, 7.0, "fwd:employment_202501_1"), ("headcount", "B", JAN, None, None, None, "fwd:employment_202501_2"),
    ]
    got = {(r.measure, r.node): (r.value, r.source_ref) for r in facts.resolve_duplicates(values_frame(spark, rows), ["quits"]).collect()}
    assert got[("quits", "A")][0] == 5.0
    assert got[("headcount", "A")] == (10.0, "fwd:employment_202501_10")
    assert got[("headcount", "B")] == (7.0, "fwd:employment_202501_2")


def test_roll_up_levels(spark):
    rows = [
        ("headcount", "AA01", JAN, None, None, 10.0, "s_1"), ("headcount", "AA__", JAN, None, None, 1.0, "s_2"), ("headcount", "BB01", JAN, None, None, 5.0, "s_1"),
        ("headcount", "AA", JAN, "grade", "13", 4.0, "s_1"), ("headcount", "BB", JAN, "grade", "13", 2.0, "s_1"),
    ]
    edges = spark.createDataFrame([("AA", "D:X"), ("BB", "D:X")], "agency string, dept string")
    got = {(r.node, r.dim_value): r.value for r in hierarchy.roll_up(values_frame(spark, rows), edges).collect()}
    assert got == {
        ("AA01", None): 10, ("AA__", None): 1, ("BB01", None): 5, ("AA", None): 11, ("BB", None): 5, ("D:X", None): 16, ("gov", None): 16,
        ("AA", "13"): 4, ("BB", "13"): 2, ("D:X", "13"): 6, ("gov", "13"): 6,
    }


def test_zero_fill_only_where_staffed_and_open(spark):
    rows = [("headcount", n, d, None, None, 5.0, "s") for n in ("A", "B") for d in (JAN, FEB, MAR)]
    rows += [("quits", "A", JAN, None, None, 1.0, "s"), ("quits", "A", FEB, None, None, 1.0, "s"), ("quits", "Z", FEB, None, None, 1.0, "s")]
    got = hierarchy.zero_fill(values_frame(spark, rows), [("quits", "2025-02-01"), ("rifs", "2025-01-01")]).collect()
    assert [(r.measure, r.node, r.period_start, r.value, r.source_ref) for r in got] == [("quits", "B", FEB, 0.0, "zero-fill")]


def test_signed_groups(spark):
    rows = [("headcount", "AA", JAN, None, None, 10.0, "s"), ("headcount", "AA01", JAN, None, None, 4.0, "s"), ("headcount", "D:X", JAN, None, None, 99.0, "s")]
    members = tables.group_members(spark.createDataFrame(
        [("g", ["AA", "D:X"], None, ["AA01"])], "gid string, agency_codes array<string>, org_codes array<string>, exclude_org_codes array<string>"))
    kinds = spark.createDataFrame([("AA", "agency"), ("AA01", "subelement"), ("D:X", "department")], "code string, kind string")
    assert [(r.node, r.value) for r in hierarchy.signed_groups(values_frame(spark, rows), members, kinds).collect()] == [("g", 6.0)]


def test_whole_build_checks_its_vocabulary(spark):
    rows = [("headcount", "AA01", d, None, None, v, "fwd:employment_1") for d, v in ((JAN, 100.0), (FEB, 110.0), (MAR, 120.0))]
    rows += [("separations", "AA01", MAR, None, None, 11.0, "fwd:separations_1"), ("accessions", "AA01", MAR, None, None, 1.0, "fwd:accessions_1")]
    nodes = spark.createDataFrame([("gov", "gov"), ("AA", "agency"), ("AA01", "subelement")], "code string, kind string")
    edges = spark.createDataFrame([], "agency string, dept string")
    out = registry.build_values(registry.Sources(values_frame(spark, rows), nodes, edges))
    got = {(r.measure, r.node, r.period_start): r.value for r in out.collect()}
    assert got["separation_rate", "AA01", MAR] == 10.0 and got["separation_rate", "gov", MAR] == 10.0
    assert got["net_change", "AA", MAR] == -10.0
    with pytest.raises(checks.CheckFailed):
        registry.build_values(registry.Sources(values_frame(spark, [("nonsense", "AA01", JAN, None, None, 1.0, "s")]), nodes, edges))


def test_published_table_reads_back_by_node(spark, tmp_path):
    rows = [("headcount", n, d, None, None, 1.0, "s") for n in ("AA01", "AA02") for d in (JAN, FEB)]
    stats = registry.publish(values_frame(spark, rows), str(tmp_path / "values")).first()
    assert (stats["rows"], stats["nodes"], stats["measures"]) == (4, 2, 1)
    assert tables.read_node(spark, str(tmp_path / "values"), "AA01", "headcount").count() == 2


def test_packing_keeps_gaps_counts_and_notes(spark):
    rows = [("m", "A", "month", JAN, None, None, 123.456, 7, None, "s"), ("m", "A", "month", MAR, None, None, 1.23456, None, "estimate", "s"),
            ("m", "B", "month", FEB, None, None, 2.0, None, None, "s")]
    packed = {r.node: r for r in views.pack(spark.createDataFrame(rows, VALUE_SCHEMA)).collect()}
    a, b = packed["A"], packed["B"]
    assert (a.t, a.i, a.v, a.n, a.z) == ("month", 0, [123.46, None, 1.2346], [7, None, None], {"2": "estimate"})
    assert (b.i, b.v, b.n, b.z) == (1, [2.0], None, None)


def test_rolling_four_quarters_needs_three_submissions(spark):
    rows = [("a", "personnel", 2024, q, 10.0 * q) for q in (1, 2, 3, 4)] + [("a", "personnel", 2025, 1, 12.0), ("b", "other", 2025, 1, 5.0)]
    got = money.rolling_four_quarters(spark.createDataFrame(rows, "agency_name string, bucket string, fy int, quarter int, ytd double"))
    assert sorted((r.agency_name, r.fy, r.quarter, r.obligations) for r in got.collect()) == [("a", 2025, 1, 42.0), ("b", 2025, 1, 5.0)]


def test_index_needs_every_item(spark):
    items = spark.createDataFrame([("A", "Q1", 50.0), ("A", "Q2", 70.0), ("A", "Q3", 40.0), ("B", "Q1", 50.0), ("B", "Q3", 40.0)], "unit string, item string, value double")
    members = literal_table(spark, "item string, subindex string", [("Q1", "x"), ("Q2", "x"), ("Q3", "y")])
    got = survey.index_of_indices(items, ["unit"], members, {"x": 2, "y": 1}).collect()
    assert [(r.unit, r["index"]) for r in got] == [("A", 50.0)]


def test_header_gate():
    assert checks.header_drift(["a", "b"], ["a", "b"]) == {}
    assert checks.header_drift(["b", "a", "x"], ["a", "b", "c"]) == {"missing": ["c"], "added": ["x"], "reordered": ["b", "a"]}
    with pytest.raises(checks.CheckFailed):
        checks.require_header(["a", "b", "c"], ["agency", "grade"])


def test_input_guard():
    checks.guard_inputs(80, 100)
    checks.guard_inputs(1, None)
    with pytest.raises(checks.CheckFailed):
        checks.guard_inputs(79, 100)


def test_era_gate_and_optional_measures(spark):
    columns = [c for c in facts.fixed.CORE_EMPLOYMENT]
    row = {c: "1" for c in columns} | {"agency_code": "AA", "agency_subelement_code": "AA01", "snapshot_yyyymm": "202501", "age_bracket": "25-29", "grade": "13"}
    old = spark.createDataFrame([tuple(row[c] for c in columns)], ", ".join(f"`{c}` string" for c in columns))
    got = {r.measure for r in facts.extract_employment(old, F.lit("fwd:employment_202501_1")).collect()}
    assert "headcount" in got and "veterans" not in got and "location_disclosed_employees" not in got
    with pytest.raises(facts.EraError):
        facts.extract_employment(old.drop("grade"), F.lit("x"))


def test_file_names(spark):
    parts = spark.createDataFrame([("x/employment_202607_10/part-0",)], "p string").select(records.file_parts("p").alias("f")).first()["f"]
    assert tuple(parts) == ("employment", "202607", 10)
    with pytest.raises(Exception, match="not a record file"):
        spark.createDataFrame([("readme.txt",)], "p string").select(records.file_parts("p").alias("f")).collect()
    day = spark.createDataFrame([("plum_2026-03-01.csv",)], "p string").select(records.snapshot_of("p").alias("d")).first()["d"]
    assert day == date(2026, 3, 1)


def test_every_snapshot_keeps_older_points(spark):
    columns = "agency string, status string, appointment_type string, first_snapshot date, last_snapshot date"
    placed = spark.createDataFrame([("A", "Filled", "PAS", JAN, MAR), ("A", "Vacant", "CA", FEB, FEB), ("A", "Historical", "CA", JAN, MAR)], columns)
    days = spark.createDataFrame([(JAN,), (FEB,), (MAR,)], "snapshot date")
    got = {r.snapshot: (r.plum_positions, r.plum_political, r.plum_vacant) for r in roster.status_counts(placed, days).collect()}
    assert got == {JAN: (1, 1, 0), FEB: (2, 1, 1), MAR: (1, 1, 0)}
    last = {r.snapshot: r.plum_positions for r in roster.status_counts(placed).collect()}
    assert last == {FEB: 1, MAR: 1}


def test_raw_roster_is_cleaned(spark):
    header = ["Agency", "Organization", "Position Title", "Position Status", "Appointment Type", "Expiration Date", "Level, Grade, or Pay",
              "Duty Location", "First Name", "Last Name", "Individual Unique ID", "Pay Plan", "Tenure", "Begin Date", "Vacate Date"]
    raw = spark.createDataFrame([("A &amp; B", "Org", " Chief ", "Filled", "CA", "", "15", "Here", "", "X&#039;y", "", "ES", "", "01/20/2025", "")],
                                ", ".join(f"`{c}` string" for c in header))
    row = roster.read_positions(raw, F.lit("2025-02-01").cast("date")).first()
    assert (row.agency_name, row.title, row.first_name, row.last_name, row.individual_id) == ("A & B", "Chief", None, "X'y", None)
    assert row.begin_date == date(2025, 1, 20) and row.vacate_date is None
    assert roster.leaked_columns(spark.createDataFrame([(1, 2)], "title int, grade int")) == ["grade"]
    documents = spark.createDataFrame([("a", '{"title":"x"}'), ("a", '{"title":"x","grade":"15"}'), ("b", "{}")], "output string, document string")
    assert {tuple(r) for r in roster.leaks(documents).collect()} == {("a", 2, 1), ("b", 1, 0)}


def test_resumable_load_takes_each_file_once(spark, tmp_path):
    from tallywell.streaming import ingest

    columns = list(facts.fixed.CORE_ACTIONS) + ["separation_category_code", "drp_indicator"]

    def drop(name, quits, order=1):
        rows = [("AA", "AA01", "1", "202501", "0.5", "SC", "N")] * quits
        frame = spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in columns)).select(*columns[::order])
        sinks.write_pipe_text(frame.coalesce(1), str(tmp_path / "in" / name))

    def load():
        ingest.load_new_files(spark, str(tmp_path / "in"), str(tmp_path / "out"))
        return {r.source_ref: r.value for r in spark.read.parquet(str(tmp_path / "out")).filter("measure = 'quits'").collect()}

    drop("separations_202501_1", 2)
    assert load() == {"fwd:separations_202501_1": 2.0}
    assert load() == {"fwd:separations_202501_1": 2.0}
    drop("separations_202502_10", 3, order=-1)
    assert load() == {"fwd:separations_202501_1": 2.0, "fwd:separations_202502_10": 3.0}
    drop("separations_202502_9", 7)
    drop("separations_202501_2", 5)
    assert load() == {"fwd:separations_202501_2": 5.0, "fwd:separations_202502_10": 3.0}


def test_two_targets_do_not_share_their_state(spark, tmp_path):
    from tallywell.streaming import ingest

    columns = list(facts.fixed.CORE_ACTIONS) + ["accession_category_code"]
    rows = spark.createDataFrame([("AA", "AA01", "1", "202501", "0.5", "AC")], ", ".join(f"`{c}` string" for c in columns))
    sinks.write_pipe_text(rows, str(tmp_path / "in" / "accessions_202501_1"))
    for target in ("one", "two"):
        ingest.load_new_files(spark, str(tmp_path / "in"), str(tmp_path / target))
        assert spark.read.parquet(str(tmp_path / target)).filter("measure = 'new_hires'").count() == 1


def test_text_is_mapped_by_its_header(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "employment_200501_1.txt").write_text("grade|count|agency_code\n09|5|BB\n")
    (tmp_path / "a" / "employment_202501_1.txt").write_text("agency_code|grade|count|veteran_indicator\nCC|11||Y\n")
    wanted = ["agency_code", "grade", "count", "veteran_indicator"]
    rows = records.read_current(spark, str(tmp_path / "a"), "employment", wanted).orderBy("agency_code")
    assert [tuple(r)[:4] for r in rows.select(*wanted).collect()] == [("BB", "09", "5", None), ("CC", "11", None, "Y")]
    eras = records.read_current_eras(spark, str(tmp_path / "a"), "employment", wanted)
    assert sorted("veteran_indicator" in era.columns for era in eras) == [False, True]
    with pytest.raises(Exception, match="(?i)header"):
        records.read_era(spark, [str(tmp_path / "a")], wanted).collect()


def test_other_files_are_an_error(spark, tmp_path):
    (tmp_path / "readme.txt").write_text("x")
    with pytest.raises(Exception, match="not a record file"):
        records.list_files(spark, str(tmp_path)).collect()
    with pytest.raises(Exception, match="not a record file"):
        spark.createDataFrame([("x/employment_202607_10x",)], "p string").select(records.file_parts("p")).collect()


def test_blank_last_field_is_no_fault(spark, tmp_path):
    (tmp_path / "t.csv").write_text("key,name,segment\n1,Ann,A\n2,Ann,\n3,Ann\n4,Ann,B,more\n,,\n")
    rows = records.read_tolerant_csv(spark, str(tmp_path / "t.csv"), ["key", "name", "segment"]).collect()
    assert [tuple(r) for r in rows] == [("1", "Ann", "A"), ("2", "Ann", None), (None, None, None)]


def test_month_cover_has_no_end_but_the_last_code(spark):
    rows = [(f"c{i}", f"{1990 + i // 12}{i % 12 + 1:02d}") for i in range(45)] + [("none", None)]
    seen = spark.createDataFrame(rows, "code string, month string")
    assert len(crosswalk.covering_months(seen)) == 45
    assert [r.code for r in crosswalk.uncovered(seen).collect()] == ["none"]


def test_literal_tables(spark):
    rows = literal_table(spark, "a string, b int, c array<string>", [("it's", 1, ["x", "y"]), (None, None, [])]).collect()
    assert [tuple(r) for r in rows] == [("it's", 1, ["x", "y"]), (None, None, [])]
    assert literal_table(spark, "a string", []).count() == 0
    assert literal_table(spark, "a int", [(i,) for i in range(6_000)]).count() == 6_000


def test_catalog_table(spark):
    table = as_table(spark)
    assert table.count() == len(CATALOG)
    assert {r.level for r in table.select("level").distinct().collect()} == {0, 1, 2}


def test_unknown_notation_is_an_error(spark):
    row = [("m", "A", "month", JAN, None, None, 1.0, None, "guess", "s_1")]
    with pytest.raises(Exception, match="unknown notation"):
        facts.resolve_duplicates(spark.createDataFrame(row, VALUE_SCHEMA), []).collect()


def test_cut_lineage_uses_the_shared_folder(spark):
    out = cut_lineage(as_values(spark.range(3).select(F.lit("m").alias("measure"))))
    assert out.count() == 3 and spark.sparkContext.getCheckpointDir()
