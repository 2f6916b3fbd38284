"""Run registered queries beside their SQL in an embedded DuckDB and report differences.

python tools/compare.py [--sf 0.01] [--only name,name] [--time]
"""

from __future__ import annotations

import argparse
import math
import pathlib
import sys
import time

ROOT = pathlib.Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(value):
    if value is None:
        return "\0null"
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(value + 0.0)
    if isinstance(value, bool):
        return str(value)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if type(value).__name__ == "Decimal":
        return "dec:" + str(value)
    return str(value)


def rows_of(records, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(canonical(r[i]) for i in order) for r in records)


def compare(spark, connection, item, folder):
    started = time.time()
    frame = item.run(spark, folder)
    found = frame.collect()
    spent = time.time() - started
    if item.sql is None:
        return "rows", len(found), spent, ""
    columns, mine = rows_of([tuple(r) for r in found], frame.columns)
    cursor = connection.execute(item.sql)
    names = [d[0] for d in cursor.description]
    other_columns, theirs = rows_of(cursor.fetchall(), names)
    if columns != other_columns:
        return "COLUMNS", len(found), spent, f"{columns} / {other_columns}"
    if mine != theirs:
        mine_set, theirs_set = set(mine), set(theirs)
        only_mine, only_theirs = sorted(mine_set - theirs_set), sorted(theirs_set - mine_set)
        return "DIFFER", len(found), spent, f"{len(mine)} / {len(theirs)} rows {columns}\n    spark {only_mine[:3]}\n    sql   {only_theirs[:3]}"
    return "ok", len(found), spent, ""


def connect(folder):
    import duckdb

    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return connection


def main():
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("--only", default="")
    parser.add_argument("--module", default="")
    options = parser.parse_args()
    from tallywell.queries import REGISTRY
    from tallywell.session import build_session

    spark = build_session("compare", "local[8]", **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    folder = f"/root/testdata/sf{options.sf}"
    connection = connect(folder)
    wanted = [n for n in options.only.split(",") if n]
    bad = 0
    for name, item in REGISTRY.items():
        if wanted and name not in wanted:
            continue
        if options.module and not item.run.__module__.endswith(options.module):
            continue
        try:
            state, count, spent, detail = compare(spark, connection, item, folder)
        except Exception as error:  # report and go on
            state, count, spent, detail = "ERROR", 0, 0.0, str(error)[:900]
        bad += state not in ("ok", "rows")
        print(f"{state:8}{name:34}{count:9} rows {spent:7.2f}s {detail}", flush=True)
    print("bad:", bad)
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
