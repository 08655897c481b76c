"""The driver's tables seen as transaction graphs.

``trade``: customers buy from suppliers, a line item is a transfer.
``events``: users act on keys of one id space, an event is a transfer.
Each has Spark frames and the same definition as SQL, for comparison.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LINE = ["l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def trade_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical transactions plus ``label`` and ``score``.

    Unknown amounts and times are planted where tax is zero and on seventh
    lines.  The ordinal within an order and the join use one partitioning, by
    order key; orders get their customers first, so that lines, the most rows
    by far, are dealt out once.
    """
    line, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    n = F.row_number().over(W.partitionBy("l_orderkey").orderBy(*LINE))
    bought = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    joined = line.withColumn("n", n).join(bought, F.col("l_orderkey") == F.col("o_orderkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.select(
        F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("n").cast("string")).alias("tx_id"),
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("src_account"),
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("dst_account"),
        F.when(F.col("l_tax") != 0, F.col("l_extendedprice")).alias("amount"),
        F.lit("USD").alias("currency"),
        F.when(F.col("l_linenumber") != 7, F.col("l_shipdate")).alias("timestamp"),
        F.concat("l_linestatus", "l_returnflag").alias("channel"),
        F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("institution_src"),
        F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("institution_dst"),
        F.when((F.col("l_returnflag") == "R") & (F.col("l_discount") >= 0.09), "laundering").otherwise("not_laundering").alias("label"),
        F.least(F.lit(1.0), F.col("l_discount") * 5 + F.col("l_quantity") / 100).alias("score"),
    )


def trade_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("opened_at"))
    customer = table(spark, sf_dir, "customer").join(first, F.col("c_custkey") == F.col("o_custkey"), "left")
    buyers = customer.select(
        F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("account_id"),
        F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("institution_id"),
        "opened_at",
        F.to_json(F.struct(F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("segment"))).alias("attributes"),
    )
    sellers = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("account_id"),
        F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("institution_id"),
        F.lit(None).cast("timestamp_ntz").alias("opened_at"),
        F.to_json(F.struct(F.col("s_acctbal").alias("acctbal"))).alias("attributes"),
    )
    return buyers.unionByName(sellers)


TRADE_SQL = """
tx AS (
  SELECT l_orderkey || '-' || row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity,
           l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS tx_id,
         'C' || o_custkey AS src_account, 'S' || l_suppkey AS dst_account,
         CASE WHEN l_tax <> 0 THEN l_extendedprice END AS amount, 'USD' AS currency,
         CASE WHEN l_linenumber <> 7 THEN l_shipdate END AS ts, l_linestatus || l_returnflag AS channel,
         'N' || c_nationkey AS institution_src, 'N' || s_nationkey AS institution_dst,
         CASE WHEN l_returnflag = 'R' AND l_discount >= 0.09 THEN 'laundering' ELSE 'not_laundering' END AS label,
         least(1.0::DOUBLE, l_discount * 5 + l_quantity / 100) AS score
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey),
accounts AS (
  SELECT 'C' || c_custkey AS account_id, 'N' || c_nationkey AS institution_id,
         (SELECT min(o_orderdate) FROM orders WHERE o_custkey = c_custkey) AS opened_at, c_acctbal AS acctbal, c_mktsegment AS segment FROM customer
  UNION ALL
  SELECT 'S' || s_suppkey, 'N' || s_nationkey, NULL, s_acctbal, NULL FROM supplier)"""


def event_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tx_id, src, dst, amount, ts, channel; ids are numbers."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("tx_id"), F.col("user_id").alias("src"), F.get_json_object("props", "$.k").cast("long").alias("dst"),
        F.col("value").alias("amount"), "ts", F.col("event_type").alias("channel"),
    )


EVENTS_SQL = """
e AS (
  SELECT event_id AS tx_id, user_id AS src, (json_extract_string(props, '$.k'))::BIGINT AS dst, value AS amount, ts, event_type AS channel FROM events),
v AS (SELECT src AS id FROM e UNION SELECT dst FROM e)"""


def vertices_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def labelled_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All event edges with a label: errors of 100 and more are laundering."""
    e = event_edges(spark, sf_dir)
    return e.withColumn("label", F.when((F.col("channel") == "error") & (F.col("amount") >= 100), "laundering").otherwise("not_laundering"))


def event_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vertices_of(event_edges(spark, sf_dir))


LABELLED_SQL = EVENTS_SQL + """,
h AS (SELECT *, CASE WHEN channel = 'error' AND amount >= 100 THEN 'laundering' ELSE 'not_laundering' END AS label FROM e),
hv AS (SELECT id FROM v)"""
