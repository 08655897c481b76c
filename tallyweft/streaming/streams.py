"""Structured Streaming forms of snapshots, idempotent ingest, account features and rate limits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweft.storage import scratch_path


def event_stream(spark: SparkSession, path: str, schema=None, per_trigger: int | None = None) -> DataFrame:
    """A stream of Parquet files; times become zoned timestamps, which watermarks need."""
    schema = schema or spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    reader = reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader
    folder, _, name = path.rpartition("/")
    df = reader.option("pathGlobFilter", name).parquet(folder) if name.endswith(".parquet") and _is_file(spark, path) else reader.parquet(path)
    return df.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.simpleString() == "timestamp_ntz"})


def _is_file(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile()


def snapshot_counts(events: DataFrame, step: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, n_edges, amount) of tumbling windows, emitted when the watermark passes."""
    w = F.window("ts", step)
    return events.withWatermark("ts", late).groupBy(w).agg(F.count(F.lit(1)).alias("n_edges"), F.sum("amount").alias("amount")).select(F.col("window.start").alias("start"), "n_edges", "amount")


def deduplicated(events: DataFrame, key: str = "tx_id", late: str = "1 hour") -> DataFrame:
    """Each key once while its watermark lasts: idempotent ingest."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def running_accounts(events: DataFrame) -> DataFrame:
    """(account_id, n, first, last, velocity) kept per account and updated with every batch: a stateful operator."""
    ends = events.where("ts is not null").select(F.explode(F.array("src", "dst")).alias("account_id"), "ts")

    def update(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, first, last = state.get if state.exists else (0, None, None)
        for f in frames:
            if len(f):
                low, high = f["ts"].min().value // 1000, f["ts"].max().value // 1000
                n, first, last = n + len(f), low if first is None else min(first, low), high if last is None else max(last, high)
        state.update((n, first, last))
        span = (last - first) / 1e6
        yield pd.DataFrame({"account_id": [key[0]], "n": [n], "first_us": [first], "last_us": [last], "velocity": [n / span if span > 0 else 0.0]})

    kind = ends.schema["account_id"].dataType.simpleString()
    return ends.groupBy("account_id").applyInPandasWithState(update, f"account_id {kind}, n long, first_us long, last_us long, velocity double", "n long, first long, last long", "update", "NoTimeout")


def rate_windows(requests: DataFrame, limit: int = 100, window: str = "60 seconds", slide: str = "1 second") -> DataFrame:
    """(client, start, n) of sliding windows with more than ``limit`` requests."""
    n = requests.withWatermark("ts", window).groupBy("client", F.window("ts", window, slide)).agg(F.count(F.lit(1)).alias("n"))
    return n.where(F.col("n") > limit).select("client", F.col("window.start").alias("start"), "n")


def append_new(stream: DataFrame, folder: str, key: str):
    """A sink that appends each batch's new keys to a Parquet table, whatever is replayed."""

    def write(batch: DataFrame, _: int) -> None:
        from tallyweft.operators.serving import new_rows

        spark = batch.sparkSession
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
        rows = new_rows(batch, spark.read.parquet(folder), key) if there else batch.dropDuplicates([key])
        rows.write.mode("append").parquet(folder)

    return stream.writeStream.foreachBatch(write)


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now and return its output as a table."""
    spark = stream.sparkSession
    out, state = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-state")
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
    else:
        def write(batch: DataFrame, n: int) -> None:
            batch.withColumn("_batch", F.lit(n)).write.mode("append").parquet(out)

        query = stream.writeStream.foreachBatch(write).option("checkpointLocation", state).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out)
