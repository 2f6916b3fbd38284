"""Sets of artefacts that are published together.

A set is written to a folder of its own, artefact after artefact, and read back. Only when every artefact holds the rows that
went into it is the set made current, by one row file added to the log of sets: its commit is the renaming of a single file.
A reader looks up the current set once and takes all artefacts from its folder, so it never sees two builds mixed, and a build
that dies half way leaves nothing but a folder that no row names. Older sets stay where they are; `restore` makes one current
again by adding a row, never by moving files.

Checks are counts and checksums that do not depend on the order; they are taken while an artefact is written and compared with
what is found in its files.

Defined results: an artefact without rows is published with its columns; rows that repeat are kept each; of sets committed at
the same instant the one with the greater name holds.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallywell.sources import manifest

_LOG = "edition string, artefact string, rows long, checksum long, schema string, committed timestamp"


class Incomplete(RuntimeError):
    """Files of an artefact do not hold what was written to them."""


def _folder(root: str, edition: str, artefact: str) -> str:
    return f"{root.rstrip('/')}/editions/{edition}/{artefact}"


def _log_path(root: str) -> str:
    return f"{root.rstrip('/')}/log"


def _hashed(df: DataFrame) -> list[Column]:
    """Columns in a form that can be hashed: nested ones as JSON, as maps cannot be."""
    nested = ("map", "array", "struct")
    return [F.to_json(f"`{f.name}`") if f.dataType.typeName() in nested else F.col(f"`{f.name}`") for f in df.schema]


def _counted(df: DataFrame) -> list[Column]:
    return [F.count(F.lit(1)).alias("rows"), manifest.checksum(_hashed(df)).alias("checksum")]


def _written(df: DataFrame, path: str) -> dict:
    """What an artefact's files hold; an error if that is not what was given to the writer."""
    watch = Observation()
    df.observe(watch, *_counted(df)).write.mode("errorifexists").option("compression", "zstd").parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    found = stored.agg(*_counted(stored)).first().asDict()
    if found != watch.get:
        raise Incomplete(f"{path}: {found} in files, {watch.get} written")
    return found


def publish(spark: SparkSession, root: str, artefacts: Mapping[str, DataFrame]) -> str:
    """Write all artefacts as a new set, make it current and return its name. Sorted frames keep their order of files."""
    if not artefacts:
        raise ValueError("a set has at least one artefact")
    edition = uuid.uuid4().hex
    rows = []
    for name, df in artefacts.items():
        found = _written(df, _folder(root, edition, name))
        rows.append((edition, name, found["rows"], found["checksum"], df.schema.json()))
    _commit(spark, root, rows)
    return edition


def _commit(spark: SparkSession, root: str, rows: list[tuple]) -> None:
    now = datetime.now(timezone.utc)
    spark.createDataFrame([(*row, now) for row in rows], _LOG).coalesce(1).write.mode("append").parquet(_log_path(root))


def editions(spark: SparkSession, root: str) -> DataFrame:
    """Every commit with its artefacts; one row each. No rows if nothing was ever published."""
    try:
        return spark.read.schema(_LOG).parquet(_log_path(root))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _LOG)


def _entries(log: DataFrame, edition: str | None) -> list:
    """The log's rows of one set, or of the newest: as many as it has artefacts."""
    if edition is None:
        newest = log.agg(F.max(F.struct("committed", "edition")))
        log = log.filter(F.struct("committed", "edition") == newest.scalar())
    else:
        log = log.filter(F.col("edition") == edition)
    return log.dropDuplicates(["artefact"]).collect()


def read(spark: SparkSession, root: str, edition: str | None = None) -> dict[str, DataFrame]:
    """All artefacts of one set by name: the current one, or the named. An unknown set is an error."""
    entries = _entries(editions(spark, root), edition)
    if not entries:
        raise LookupError(f"no published set {edition or ''} below {root}")
    return {e["artefact"]: spark.read.schema(StructType.fromJson(json.loads(e["schema"]))).parquet(_folder(root, e["edition"], e["artefact"]))
            for e in sorted(entries, key=lambda e: e["artefact"])}


def restore(spark: SparkSession, root: str, edition: str) -> None:
    """Make an earlier set current again."""
    entries = _entries(editions(spark, root), edition)
    if not entries:
        raise LookupError(f"no published set {edition} below {root}")
    _commit(spark, root, [(e["edition"], e["artefact"], e["rows"], e["checksum"], e["schema"]) for e in entries])


def damaged(spark: SparkSession, root: str) -> list[str]:
    """Artefacts of the current set whose files no longer hold what the log says."""
    said = {e["artefact"]: (e["rows"], e["checksum"]) for e in _entries(editions(spark, root), None)}
    out = []
    for name, df in read(spark, root).items():
        if tuple(df.agg(*_counted(df)).first()) != said[name]:
            out.append(name)
    return out
