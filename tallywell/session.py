"""Session set-up, shared scratch space and literal side tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "tallywell", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, adaptive execution and skew handling; extra settings win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.parquet.compression.codec": "zstd",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints; a local folder only when Spark itself is local."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="tallywell-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder; never reused, never cleared."""
    return f"{shared_folder(spark)}/tallywell-{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Truncate the plan with a reliable checkpoint, which outlives a lost executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write once as parquet in the shared folder and read back: columnar, prunable, fault tolerant."""
    path = scratch_path(df.sparkSession, label)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _sql_literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return repr(value)
    if isinstance(value, (list, tuple)):
        return "array(" + ", ".join(_sql_literal(v) for v in value) + ")"
    text = str(value).replace("\\", "\\\\").replace("'", "\\'")
    return f"'{text}'"


def literal_table(spark: SparkSession, schema: str, rows: Iterable[Sequence]) -> DataFrame:
    """Rows known to the program as a relation whose exact size Catalyst sees, so it broadcasts on its own.

    A literal table travels inside the plan: it is for specifications. Data belong in a DataFrame.
    """
    rows = list(rows)
    fields = [part.strip().split(" ", 1) for part in schema.split(",")]
    names = ", ".join(f"`{name}`" for name, _ in fields)
    casts = ", ".join(f"CAST(`{name}` AS {kind}) AS `{name}`" for name, kind in fields)
    if not rows:
        return spark.sql("SELECT " + ", ".join(f"CAST(NULL AS {kind}) AS `{name}`" for name, kind in fields) + " WHERE false")
    values = ", ".join("(" + ", ".join(_sql_literal(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT {casts} FROM VALUES {values} AS t({names})")
