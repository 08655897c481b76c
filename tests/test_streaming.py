"""Streams over small Parquet folders."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyweft.streaming import streams

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture()
def folder(spark, tmp_path):
    rows = [(i, i % 3, (i + 1) % 3, float(i), T0 + dt.timedelta(seconds=20 * i)) for i in range(30)]
    df = spark.createDataFrame(rows, "tx_id long, src long, dst long, amount double, ts timestamp_ntz")
    df.write.parquet(str(tmp_path / "in"))
    return str(tmp_path / "in")


def test_snapshots(spark, folder):
    out = streams.drained(streams.snapshot_counts(streams.event_stream(spark, folder), "5 minutes"), "complete")
    last = out.groupBy("start").agg(F.max("n_edges").alias("n"))
    assert sum(r["n"] for r in last.collect()) == 30 and last.count() == 2


def test_dedupe_and_accounts(spark, folder):
    s = streams.event_stream(spark, folder)
    assert streams.drained(streams.deduplicated(s.unionByName(s))).count() == 30
    rows = {r["account_id"]: r for r in streams.drained(streams.running_accounts(s), "update").collect()}
    assert {k: r["n"] for k, r in rows.items()} == {0: 20, 1: 20, 2: 20}
    assert all(r["velocity"] > 0 for r in rows.values())


def test_rates(spark, folder):
    s = streams.event_stream(spark, folder).withColumn("client", F.lit("c"))
    out = streams.drained(streams.rate_windows(s, limit=2, window="60 seconds", slide="20 seconds"), "complete")
    assert out.agg(F.max("n")).first()[0] == 3


def test_replayed_batches_append_once(spark, folder, tmp_path):
    sink = str(tmp_path / "sink")
    for n in range(2):
        q = streams.append_new(streams.event_stream(spark, folder), sink, "tx_id").option("checkpointLocation", str(tmp_path / f"c{n}")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert spark.read.parquet(sink).count() == 30
