"""Databases as sources and sinks, on the embedded database that comes with Spark."""

import pytest
from pyspark.sql import functions as F

from tallyweft.sources import stores


@pytest.fixture
def url(tmp_path):
    return f"jdbc:derby:{tmp_path}/db;create=true"


def test_round_trip_in_parts(spark, url):
    rows = spark.range(100).select((F.col("id") * 3).alias("k"), F.concat(F.lit("v"), F.col("id").cast("string")).alias("v"))
    stores.write_jdbc(rows, url, "t", mode="overwrite")
    got = stores.read_jdbc(spark, url, "t", key="k", parts=4)
    assert got.rdd.getNumPartitions() == 4 and sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.collect()))
    # bounds deal rows, they do not drop them
    assert stores.read_jdbc(spark, url, "t", key="k", parts=3, low=30, high=60).count() == 100
    assert stores.read_jdbc(spark, url, "t").count() == 100


def test_empty_table_is_read(spark, url):
    stores.write_jdbc(spark.range(0), url, "e", mode="overwrite")
    assert stores.read_jdbc(spark, url, "e", key="id", parts=4).count() == 0


def test_merge_replaces_keys_and_repeats(spark, url):
    frame = lambda rows: spark.createDataFrame(rows, "k long, v string")
    stores.write_jdbc(frame([(1, "a"), (2, "b")]), url, "t", mode="overwrite")
    new = frame([(2, "B"), (3, "c"), (3, "c")])
    for _ in range(2):
        stores.merge_jdbc(new, url, "t", "k")
        assert sorted(map(tuple, stores.read_jdbc(spark, url, "t").collect())) == [(1, "a"), (2, "B"), (3, "c")]
    with pytest.raises(ValueError):
        stores.merge_jdbc(frame([(5, "x"), (5, "y")]), url, "t", "k")


def test_failed_merge_changes_nothing(spark, url):
    stores.write_jdbc(spark.createDataFrame([(1, "a")], "k long, v string"), url, "t", mode="overwrite")
    with pytest.raises(Exception):
        stores.execute_jdbc(spark, url, "DELETE FROM t", "INSERT INTO nowhere VALUES (1)")
    assert stores.read_jdbc(spark, url, "t").count() == 1
