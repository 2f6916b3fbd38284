"""Sets of artefacts: one pointer for all, half builds leave no trace, damage is found."""

import glob
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tallywell.sources import published


def numbers(spark, upto, scale=1):
    return spark.range(upto).select((F.col("id") * scale).alias("n"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("t"), "id")).alias("t"))


def nested(spark):
    return spark.range(4).select("id", F.create_map(F.lit("a"), "id", F.lit("b"), F.lit(1)).alias("m"), F.array("id").alias("l"))


def held(spark, root):
    return {name: sorted(map(str, df.collect())) for name, df in published.read(spark, root).items()}


def test_sets_are_read_whole(spark, tmp_path):
    root = str(tmp_path / "out")
    first = published.publish(spark, root, {"current": numbers(spark, 5), "movers": numbers(spark, 3), "documents": nested(spark)})
    assert {k: len(v) for k, v in held(spark, root).items()} == {"current": 5, "movers": 3, "documents": 4}
    second = published.publish(spark, root, {"current": numbers(spark, 7, 2), "none": numbers(spark, 0)})
    now = published.read(spark, root)
    assert set(now) == {"current", "none"} and now["none"].columns == ["n", "t"] and now["current"].agg(F.sum("n")).first()[0] == 42
    assert set(published.read(spark, root, first)) == {"current", "movers", "documents"}
    published.restore(spark, root, first)
    assert set(held(spark, root)) == {"current", "movers", "documents"}
    published.restore(spark, root, second)
    assert set(held(spark, root)) == {"current", "none"}
    assert published.editions(spark, root).count() == 3 + 2 + 3 + 2


def test_a_build_that_dies_leaves_the_old_set(spark, tmp_path):
    root = str(tmp_path / "out")
    published.publish(spark, root, {"current": numbers(spark, 5), "movers": numbers(spark, 3)})
    before = held(spark, root)
    failing = numbers(spark, 9).withColumn("t", F.when(F.col("n") == 8, F.raise_error(F.lit("lost"))).otherwise(F.col("t")))
    with pytest.raises(PySparkException):
        published.publish(spark, root, {"current": numbers(spark, 50), "movers": failing})
    assert held(spark, root) == before
    assert len(os.listdir(f"{root}/editions")) == 2, "the half set lies there, and nothing names it"


def test_a_reader_keeps_its_set(spark, tmp_path):
    root = str(tmp_path / "out")
    published.publish(spark, root, {"a": numbers(spark, 5), "b": numbers(spark, 5)})
    reader = published.read(spark, root)
    published.publish(spark, root, {"a": numbers(spark, 9), "b": numbers(spark, 9)})
    assert reader["a"].count() == reader["b"].count() == 5


def test_damage_is_found(spark, tmp_path):
    root = str(tmp_path / "out")
    edition = published.publish(spark, root, {"a": numbers(spark, 50), "b": numbers(spark, 5)})
    assert published.damaged(spark, root) == []
    other = str(tmp_path / "other")
    numbers(spark, 50, 3).coalesce(1).write.parquet(other)
    target = glob.glob(f"{root}/editions/{edition}/a/*.parquet")[0]
    with open(glob.glob(f"{other}/*.parquet")[0], "rb") as given, open(target, "wb") as taken:
        taken.write(given.read())
    for crc in glob.glob(f"{root}/editions/{edition}/a/.*.crc"):
        os.truncate(crc, 0)
        os.unlink(crc)
    assert published.damaged(spark, root) == ["a"]


def test_rows_changed_on_the_way_are_refused(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "out")
    unsteady = published._counted
    calls = iter(range(9))
    monkeypatch.setattr(published, "_counted", lambda df: [(F.count(F.lit(1)) + next(calls)).alias("rows"), F.lit(0).cast("long").alias("checksum")])
    with pytest.raises(published.Incomplete):
        published.publish(spark, root, {"a": numbers(spark, 50)})
    monkeypatch.setattr(published, "_counted", unsteady)
    assert published.editions(spark, root).count() == 0


def test_nothing_published(spark, tmp_path):
    root = str(tmp_path / "out")
    assert published.editions(spark, root).count() == 0
    with pytest.raises(LookupError):
        published.read(spark, root)
    with pytest.raises(LookupError):
        published.restore(spark, root, "x")
    with pytest.raises(ValueError):
        published.publish(spark, root, {})
