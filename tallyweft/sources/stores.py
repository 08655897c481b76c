"""Reports, files and databases as sinks and sources."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def write_report(report: dict, path: str) -> None:
    """A small driver-side report as JSON with its keys in order."""
    with open(path, "w") as f:
        json.dump(report, f, indent=2, sort_keys=True, default=str)


def write_table(df: DataFrame, path: str, kind: str = "parquet", *, by: list[str] | None = None, mode: str = "overwrite") -> None:
    """A frame as Parquet, ORC, JSON or CSV, in parts by columns if asked."""
    writer = df.write.mode(mode).format(kind)
    writer = writer.option("header", True) if kind == "csv" else writer
    (writer.partitionBy(*by) if by else writer).save(path)


def write_curve(curve: DataFrame, path: str) -> None:
    """A curve's points in order of threshold, as JSON lines."""
    curve.orderBy("threshold").write.mode("overwrite").json(path)


def _quoted(spark: SparkSession, url: str, *names: str) -> list[str]:
    """Names as the database of the URL quotes them, which is how Spark writes its columns."""
    dialect = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url)
    return [dialect.quoteIdentifier(n) for n in names]


def read_jdbc(spark: SparkSession, url: str, table: str, *, key: str | None = None, parts: int = 1, low: int | None = None, high: int | None = None, **options: str) -> DataFrame:
    """A database table; with a numeric key, read in parts by ranges of it.

    Bounds that are not given are looked up; they only decide how rows are
    dealt, rows outside them and rows without a key are read too.  The
    driver's jar must be on the class path.
    """
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    if key and parts > 1:
        if low is None or high is None:
            column = _quoted(spark, url, key)[0]
            bounds = spark.read.format("jdbc").option("url", url).options(**options).option("query", f"SELECT MIN({column}) AS low, MAX({column}) AS high FROM {table}")
            ends = bounds.load().first()
            low, high = (int(v) if v is not None else 0 for v in ends)
        if high > low:
            # the upper bound of the last range is open
            return reader.option("dbtable", table).option("partitionColumn", key).option("numPartitions", min(parts, high - low + 1)).option("lowerBound", low).option("upperBound", high).load()
    return reader.option("dbtable", table).load()


def write_jdbc(df: DataFrame, url: str, table: str, *, mode: str = "append", **options: str) -> None:
    df.write.format("jdbc").option("url", url).option("dbtable", table).options(**options).mode(mode).save()


def execute_jdbc(spark: SparkSession, url: str, *statements: str) -> None:
    """Statements in one transaction: all of them, or none."""
    connection = spark._jvm.java.sql.DriverManager.getConnection(url)
    try:
        connection.setAutoCommit(False)
        run = connection.createStatement()
        try:
            for s in statements:
                run.executeUpdate(s)
            connection.commit()
        except Exception:
            connection.rollback()
            raise
    finally:
        connection.close()


def merge_jdbc(df: DataFrame, url: str, table: str, key: str, **options: str) -> None:
    """Rows replace those of the same key in an existing table, all together or not at all.

    Tasks write in parallel to a table of this call's own; one transaction of
    the database then replaces the keys.  A run that dies before it changes
    nothing but leaves that table, and a run that is repeated changes nothing
    more.  Rows equal in all columns count once, keys of different rows raise.
    """
    spark, staged = df.sparkSession, f"{table}_{uuid.uuid4().hex[:12]}"
    rows = df.distinct()
    if twice := rows.groupBy(key).count().where("count > 1").limit(5).collect():
        raise ValueError(f"several rows of one key: {[r[0] for r in twice]}")
    seen = Observation()
    write_jdbc(rows.observe(seen, F.count(F.lit(1)).alias("n")), url, staged, mode="overwrite", **options)
    there = read_jdbc(spark, url, staged, **options).count()
    if there != seen.get["n"]:
        # a task whose commit was not heard of has been run again
        execute_jdbc(spark, url, f"DROP TABLE {staged}")
        raise RuntimeError(f"{there} rows were staged of {seen.get['n']}")
    names, column = ", ".join(_quoted(spark, url, *df.columns)), _quoted(spark, url, key)[0]
    execute_jdbc(
        spark, url,
        f"DELETE FROM {table} WHERE {column} IN (SELECT {column} FROM {staged})",
        f"INSERT INTO {table} ({names}) SELECT {names} FROM {staged}",
        f"DROP TABLE {staged}",
    )
