"""The shared folder, tables that cut a plan's lineage, and the package's way to the executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor shares: ``spark.checkpoint.dir`` of the session.

    Only where that is unset in local mode (tests, a notebook) a temporary
    folder of this process is chosen, and it is put into the session; on a
    cluster executors would not share it, so that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = held.get() if held.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tallyweft-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark).rstrip('/')}/tallyweft/{name}-{uuid.uuid4().hex}"
    fs, at = file_at(spark, path)
    fs.deleteOnExit(at)
    return fs.makeQualified(at).toString()


def file_at(spark: SparkSession, path: str):
    """The file system that holds the path, and the path in it, as the session's Hadoop knows them."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = file_at(spark, path)
    return fs.exists(at)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch path that nothing reads any more."""
    fs, at = file_at(spark, path)
    fs.delete(at, True)


#: While this is set, Spark removes the shuffle files of an action when it ends, and not when the driver's garbage collection finds them unused.
RELEASE_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Actions in here leave no shuffle files; for frames whose very plan runs once."""
    was = spark.conf.get(RELEASE_KEY, None)
    spark.conf.set(RELEASE_KEY, "true")
    try:
        yield
    finally:
        spark.conf.unset(RELEASE_KEY) if was is None else spark.conf.set(RELEASE_KEY, was)


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    This cuts the lineage in a way that survives the loss of executors, and
    the reread table has true size statistics, so that Spark broadcasts it
    only when it is small.
    """
    path = scratch_path(df.sparkSession, name)
    with released(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_with(df: DataFrame, name: str, *metrics: Column) -> tuple[DataFrame, tuple]:
    """``cut``, and the values of aggregates over the rows, gathered while they are written."""
    seen = Observation()
    out = cut(df.observe(seen, *[m.alias(f"m{i}") for i, m in enumerate(metrics)]), name)
    return out, tuple(seen.get[f"m{i}"] for i in range(len(metrics)))


class Bucketed:
    """Tables in the shared folder, bucketed and sorted by a key, so that joins and aggregations on it need no shuffle.

    All tables of one object have as many buckets as the session has shuffle
    partitions when it is made.  They are known to the catalogue under names
    of their own until ``close``, which forgets them; use it as a context and
    ``cut`` what must outlive it.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.names = spark, []
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def cut(self, df: DataFrame, key: str, name: str = "bucketed") -> DataFrame:
        table = f"tallyweft_{name}_{uuid.uuid4().hex}".replace("-", "_")
        df.write.bucketBy(self.buckets, key).sortBy(key).option("path", scratch_path(self.spark, name)).saveAsTable(table, format="parquet")
        self.names.append(table)
        return self.spark.table(table)

    def close(self) -> None:
        for table in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self.names.clear()

    def __enter__(self) -> Bucketed:
        return self

    def __exit__(self, *_) -> None:
        self.close()


#: Rows of a batch that Python workers get, where the session does not say otherwise: texts are long, and Spark's 10,000 of them fill a small executor.
BATCH_KEY, BATCH_ROWS, BATCH_DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000, 10_000


def ship(spark: SparkSession) -> None:
    """Let the executors' Python import this package, wherever the driver found it, in batches that fit: once for each Spark context."""
    if int(spark.conf.get(BATCH_KEY)) == BATCH_DEFAULT:
        spark.conf.set(BATCH_KEY, BATCH_ROWS)
    context = spark.sparkContext
    if getattr(context, "_tallyweft_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="tallyweft-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "tallyweft.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for at, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    z.write(os.path.join(at, n), os.path.join("tallyweft", os.path.relpath(os.path.join(at, n), root)))
    context.addPyFile(path)
    context._tallyweft_shipped = True
