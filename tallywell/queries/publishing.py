"""The value table on shelves, and all artefacts of a build published as one set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywell.plans import catalog
from tallywell.queries import gathering, matching, rostering, standin, trees, viewing
from tallywell.queries.registry import REGISTRY, query, rounded
from tallywell.session import scratch_path
from tallywell.sources import published, shelves

#: Rows of a shelf here, so that the whole government's node stands on several at every size of the test tables.
_ROWS = 20_000


@query("K2 S14", f"""WITH {gathering.EXTRACTS_SQL}
SELECT measure, node, dim, dim_value, count(*) AS periods, min(period_start) AS since, max(period_start) AS until,
  round(arg_max(value, period_start), 2) AS newest, round(sum(value), 2) AS total
FROM raw_facts WHERE value IS NOT NULL GROUP BY ALL""")
def shelved_series(spark: SparkSession, folder: str) -> DataFrame:
    """Every series of the stored value table, summed where it lies."""
    stored = shelves.store(gathering.stored_extracts(spark, folder), scratch_path(spark, "shelves"), _ROWS)
    return rounded(shelves.series_summary(stored).drop("period_type"), newest=2, total=2)


@query("S14 K2 S13", f"""WITH {gathering.EXTRACTS_SQL}, r AS (SELECT node, count(*) AS n FROM raw_facts GROUP BY 1),
largest AS (SELECT node FROM r ORDER BY n DESC, node LIMIT 1)
SELECT node, measure, period_start, dim, dim_value, round(value, 2) AS value FROM raw_facts WHERE node = (SELECT node FROM largest)""")
def shelves_of_one_node(spark: SparkSession, folder: str) -> DataFrame:
    """All rows of the node that has most, from its own shelves."""
    path = scratch_path(spark, "shelves")
    shelves.store(gathering.stored_extracts(spark, folder), path, _ROWS)
    most = shelves.directory(spark, path).orderBy(F.desc("rows"), "node").first()["node"]
    return rounded(shelves.node_rows(spark, path, most).select("node", "measure", "period_start", "dim", "dim_value", "value"), value=2)


#: Artefact -> the query whose rows it holds, and of them what tells rows apart (three texts) and two figures.
_ARTEFACTS = {
    "periods": (viewing.period_axis, ("period_type", "first_period", "last_period"), ("periods", "NULL")),
    "current": (viewing.current_values, ("node", "measure", "period_start"), ("value", "NULL")),
    "movers": (viewing.movers, ("concat_ws(' ', label, measure, direction)", "node", "place"), ("delta", "pct")),
    "table": (viewing.change_table, ("node", "measure", "period_start"), ("d12", "p60")),
    "nodes": (trees.node_table, ("code", "kind", "parent"), ("NULL", "NULL")),
    "directory": (rostering.people_directory, ("concat_ws(' ', name, individual_id)", "title", "concat_ws(' ', agency_name, org_name, node)"), ("NULL", "NULL")),
    "timelines": (rostering.career_timelines, ("individual_id", "concat_ws(' ', name, title, status)", "begin_date"), ("seq", "NULL")),
    "months": (matching.covering_months, ("month", "NULL", "NULL"), ("gain", "codes")),
}


def _lines(name: str, keys: tuple[str, ...], figures: tuple[str, ...]) -> list[str]:
    return [f"'{name}' AS artefact", *[f"cast({k} AS string) AS {c}" for k, c in zip(keys, "abc")],
            *[f"cast({v} AS double) AS {c}" for v, c in zip(figures, ("figure", "other"))]]


_CATALOG = _lines("catalog", ("code", "pattern", "cadence"), ("level", "NULL"))
_CATALOG_SQL = ", ".join(
    f"('{m.code}', {repr(m.pattern) if m.pattern else 'NULL'}, '{m.cadence}', {catalog.depth(catalog.CATALOG, m.code)})" for m in catalog.CATALOG.values())


@query("K4 K1 W1 W8 W9 A37 A38 A40 A44 U5", " UNION ALL ".join(
    f"SELECT {', '.join(_lines(name, keys, figures))} FROM ({REGISTRY[source.__name__].sql})" for name, (source, keys, figures) in _ARTEFACTS.items()
) + f" UNION ALL SELECT {', '.join(_CATALOG)} FROM (VALUES {_CATALOG_SQL}) AS t(code, pattern, cadence, level)")
def published_artefacts(spark: SparkSession, folder: str) -> DataFrame:
    """All artefacts, published as one set over an older one, each read back from the set that is current."""
    root = scratch_path(spark, "published")
    published.publish(spark, root, {"nodes": standin.nodes(spark, folder)})
    published.publish(spark, root, {name: source(spark, folder) for name, (source, _, _) in _ARTEFACTS.items()} | {"catalog": catalog.as_table(spark)})
    current = published.read(spark, root)
    out = current["catalog"].selectExpr(*_CATALOG)
    for name, (_, keys, figures) in _ARTEFACTS.items():
        out = out.unionByName(current[name].selectExpr(*_lines(name, keys, figures)))
    return out
