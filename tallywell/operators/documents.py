"""Whole documents per node: what every part says about a node, gathered once.

Every part reduces its rows to entries (node, part, key, text), where text is JSON: one entry per measure, dimension,
category or position. Entries of all parts are one table, so a node's document is one grouping over it. A document holds
at most `limit` bytes of entries and one entry more; a node with more than that gets several numbered documents, cut at
entries, whose sections a reader puts together again.

The number of an entry follows from the bytes before it in the node. They are added up in ranges, as in `roster.numbered`,
so a node that holds most entries is numbered and gathered by many tasks.

Defined results: a node that a part does not know lacks that section; entries without a node are left out; positions that
repeat are listed each; an empty part, or no entries at all, is no error.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywell import fixed_values as fixed
from tallywell.functions import clean, periods
from tallywell.operators import geo, views
from tallywell.operators.slices import with_range
from tallywell.session import materialise

#: Bytes of entries in a document.
LIMIT = 4 << 20
#: Sections of a document in their order, and the one that is a list.
PARTS = ("measures", "dims", "dims_now", "geography", "trend", "mix", "accessions", "separations", "roster")
LISTED = "roster"


def _inner(json: Column) -> Column:
    """JSON of an object without its braces."""
    return F.substring(json, F.lit(2), F.length(json) - 2)


def keyed(rows: DataFrame, part: str, key: Column, body: Column) -> DataFrame:
    """Entries of an object: `key` is unique in (node, part)."""
    return rows.select("node", F.lit(part).alias("part"), key.alias("key"), _inner(F.to_json(F.create_map(key, body))).alias("text"))


def _mapped(rows: DataFrame, group: Sequence[str], key: str, body: Column, name: str) -> DataFrame:
    """A map per group, by key. Only for keys that a report length, the catalog or the calendar bounds."""
    def by_key(x: Column, y: Column) -> Column:
        return F.when(x[key] < y[key], -1).when(x[key] > y[key], 1).otherwise(0)

    entries = F.collect_list(F.struct(F.col(key), body.alias("_body")))
    return rows.groupBy(*group).agg(F.map_from_entries(F.array_sort(entries, by_key)).alias(name))


def measures(values: DataFrame) -> DataFrame:
    """Packed series of flat rows."""
    return keyed(views.pack(views.valued(values), axes=values), "measures", F.col("measure"), F.struct("t", "i", "v", "n", "z"))


def _dimensioned(values: DataFrame) -> DataFrame:
    rows = values.filter(F.col("dim").isNotNull() & F.col("value").isNotNull() & (F.col("period_type") == "month"))
    return rows.withColumn("dim_value", clean.dim_value("dim_value"))


def dims(values: DataFrame, trends: Sequence[str] = fixed.TREND_DIMS, months: int = fixed.TREND_MONTHS) -> DataFrame:
    """Packed series of the largest values of the dimensions in `trends` over the last months, the rest merged."""
    # `last_periods` counts back from the end, which is a period itself.
    recent = _dimensioned(periods.last_periods(values, months - 1)).filter(F.col("dim").isin(*trends))
    top = views.top_and_other(recent, ["node", "measure", "dim"], "dim_value", "value", fixed.TREND_TOP, "period_start")
    rows = top.withColumns({"period_type": F.lit("month"), "n": F.lit(None).cast("long"), "notation": F.lit(None).cast("string")})
    series = views.pack(rows, ("node", "measure", "dim", "dim_value"), axes=values)
    by_value = _mapped(series, ["node", "measure", "dim"], "dim_value", F.struct("t", "i", "v"), "values")
    return keyed(_mapped(by_value, ["node", "measure"], "dim", F.col("values"), "dims"), "dims", F.col("measure"), F.col("dims"))


def dims_now(values: DataFrame) -> DataFrame:
    """The largest values of every dimension in the newest month with a headcount, the rest merged."""
    now = _dimensioned(values).filter(F.col("period_start") == views.latest_headcount_month(values))
    top = views.top_and_other(now, ["node", "measure", "dim"], "dim_value", "value", fixed.NOW_TOP)
    by_value = _mapped(top, ["node", "measure", "dim"], "dim_value", clean.display_round("value"), "values")
    return keyed(_mapped(by_value, ["node", "measure"], "dim", F.col("values"), "dims"), "dims_now", F.col("measure"), F.col("dims"))


def geography(distribution: DataFrame) -> DataFrame:
    """Counters, counties and states of `geo.distribution`."""
    summary = geo.node_summary(distribution)
    maps = geo.node_maps(distribution)
    counters = F.struct(*[c for c in summary.columns if c != "node"])
    return (
        keyed(summary, "geography", F.lit("summary"), counters)
        .unionByName(keyed(maps, "geography", F.lit("counties"), F.col("counties")))
        .unionByName(keyed(maps, "geography", F.lit("states"), F.col("states")))
    )


def trend(rows: DataFrame, month: str = "snapshot_yyyymm") -> DataFrame:
    """Headcount by month of the largest values per dimension, the rest merged, from `views.dimension_trend`."""
    top = views.top_and_other(rows, ["node", "dim"], "dim_value", "n", fixed.TREND_TOP, month)
    by_month = _mapped(top, ["node", "dim", "dim_value"], month, F.col("n").cast("long"), "months")
    return keyed(_mapped(by_month, ["node", "dim"], "dim_value", F.col("months"), "values"), "trend", F.col("dim"), F.col("values"))


def mix(summary: DataFrame) -> DataFrame:
    """The row of `views.mix_summary`."""
    return keyed(summary, "mix", F.lit("summary"), F.struct(*[c for c in summary.columns if c != "node"]))


def flows(series: DataFrame, part: str) -> DataFrame:
    """Actions by month per category, from `views.flow_series`."""
    named = series.withColumns({c: clean.dim_value(c) for c in ("category", "effective_yyyymm")})
    rows = named.groupBy("node", "category", "effective_yyyymm").agg(F.sum("n").alias("n"))
    return keyed(_mapped(rows, ["node", "category"], "effective_yyyymm", F.col("n"), "months"), part, F.col("category"), F.col("months"))


def positions(roster: DataFrame) -> DataFrame:
    """Positions from the head down, in the order of `roster.roster`."""
    order = F.concat_ws("\u0001", "rank", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("last_name", "title", "individual_id")])
    body = F.struct(*[c for c in roster.columns if c not in ("node", "last_name")])
    return roster.select("node", F.lit(LISTED).alias("part"), order.alias("key"), F.to_json(body).alias("text"))


def numbered(entries: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Entries with `cut`, the number of whole limits of bytes that stand before them in their node."""
    known = materialise(entries.filter(F.col("node").isNotNull()).withColumns(
        {"bytes": F.octet_length("text").cast("long"), "_tie": F.xxhash64("text")}), "entries")
    blocked = with_range(known, ["node", "part", "key", "_tie"], "_slice")
    sizes = blocked.groupBy("node", "_slice").agg(F.sum("bytes").alias("_sum"))
    # At most one row per node and range.
    earlier = Window.partitionBy("node").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("node", "_slice", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("node", "_slice").orderBy("part", "key", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_offset") + F.coalesce(F.sum("bytes").over(inside), F.lit(0))
    return (
        blocked.join(offsets, ["node", "_slice"]).withColumn("_before", before)
        .select("node", "part", "key", "text", "bytes", F.floor(F.col("_before") / limit).alias("cut"))
    )


def assemble(entries: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(node, number, of, bytes, document): documents as JSON, numbered from 0 in each node."""
    placed = numbered(entries, limit)
    # Rows of a node in this window are its documents without their texts.
    same = Window.partitionBy("node")
    numbers = placed.select("node", "cut").distinct().select(
        "node", "cut", (F.row_number().over(same.orderBy("cut")) - 1).alias("number"), F.count(F.lit(1)).over(same).cast("int").alias("of"))
    item = F.struct("part", "key", "text")
    gathered = placed.groupBy("node", "cut").agg(F.sum("bytes").alias("bytes"), F.array_sort(F.collect_list(item)).alias("items"))
    counted = gathered.join(numbers, ["node", "cut"])

    def section(part: str) -> Column:
        own = F.transform(F.filter("items", lambda e: e["part"] == part), lambda e: e["text"])
        opening, closing = ("[", "]") if part == LISTED else ("{", "}")
        return F.when(F.size(own) > 0, F.concat(F.lit(f'"{part}":{opening}'), F.array_join(own, ","), F.lit(closing)))

    head = _inner(F.to_json(F.struct("node", "number", "of")))
    body = F.concat_ws(",", head, *[section(part) for part in PARTS])
    return counted.select("node", "number", "of", "bytes", F.concat(F.lit("{"), body, F.lit("}")).alias("document"))


#: Schema of written documents.
_SERIES = "struct<t:string, i:int, v:array<double>"
SCHEMA = (
    f"node string, number int, of int, measures map<string, {_SERIES}, n:array<long>, z:map<string, string>>>, "
    f"dims map<string, map<string, map<string, {_SERIES}>>>>, dims_now map<string, map<string, map<string, double>>>, "
    "geography struct<summary: struct<n:long, disclosed:long, disclosed_share:double, abroad:long, territory:long, invalid:long>, "
    "counties: map<string, long>, states: map<string, long>>, trend map<string, map<string, map<string, long>>>, "
    "mix struct<summary: struct<n:long, disclosed_location_share:double, avg_pay:double, pay_disclosed_share:double, avg_los:double>>, "
    "accessions map<string, map<string, long>>, separations map<string, map<string, long>>, "
    "roster array<struct<rank:int, title:string, status:string, appointment_type:string, name:string, individual_id:string, "
    "begin_date:date, level_grade_pay:string, org_name:string>>"
)


def write(documents: DataFrame, path: str) -> None:
    """One document a line; the lines of one range of nodes share a file."""
    documents.repartitionByRange("node", "number").sortWithinPartitions("node", "number").select("document").write.text(path)


def read(spark, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(path)
