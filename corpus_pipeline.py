"""A corpus from raw documents to packed sequences, one operator after the other.

Every stage takes (spark, docs, folder of tables) and gives what the next one gets: rows with the columns of `documents`,
until the last gives packed sequences. Between stages rows are written as Parquet below spark.checkpoint.dir and read
again, so a lost executor costs no more than the stage that runs. A row without doc_id passes by id-based stages. Lists
of documents to drop grow with the corpus, so they are merged with the rows by sorting at every size, never broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywell.llm import decontaminate, exact, multi_index, toxicity, variable_packing
from tallywell.llm.common import table
from tallywell.session import materialise


def without_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the clause grammar scores below 0.7, fitted on two thirds of the labels."""
    return toxicity.remove_toxic(docs, toxicity.fit_model(docs, table(spark, folder, "labels").select("doc_id", "toxic")))


def without_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of equal texts the one with the smallest doc_id. Rows that repeat an id with its text are one document."""
    marks = exact.mark_duplicates(exact.arrivals(docs, 3)).where("NOT kept")
    dropped = materialise(marks.select(F.col("doc_id").alias("copy_id"), F.col("text_sha256").alias("copy_sha256")), "copies").hint("merge")
    same = docs["doc_id"].eqNullSafe(dropped["copy_id"]) & (F.sha2(exact.normalised(docs["text"]), 256) == dropped["copy_sha256"])
    return docs.join(dropped, same, "left_anti")


def without_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of documents that five-word shingles connect at a similarity of 0.8, the one with the smallest doc_id."""
    marks = multi_index.near_duplicates(docs, size=5, similarity=0.8).where("NOT kept")
    dropped = materialise(marks.select("doc_id").distinct(), "near_copies").hint("merge")
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def without_test_items(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents in which no benchmark item is found with its question and answer."""
    return decontaminate.remove_contaminated(docs, table(spark, folder, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Sequences of the permitted lengths that hold all documents left."""
    return variable_packing.pack(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("decontamination", without_test_items),
    ("packing", packed),
]

#: SQL can express neither the toxicity model nor the packing; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents")
    for name, stage in STAGES:
        rows = materialise(stage(spark, rows, folder), name)
    return rows
