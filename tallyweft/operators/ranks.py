"""Running totals, numbers and exact percentiles over any number of rows.

Rows are dealt by range of the order; a task sums its own range, and what lies
before it comes from the ranges' totals, a row for each range and group.  No
task sees all rows, which a window without a partition would force.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyweft.storage import cut


def running_totals(rows: DataFrame, order: Column | str, values: dict[str, str], by: list[str] | None = None) -> DataFrame:
    """``rows`` with, for each ``name: column`` of ``values``, the sum up to and including the row, in order within its group.

    Rows of equal order within a group must not exist (aggregate them first).
    """
    by, order = by or [], F.col(order) if isinstance(order, str) else order
    dealt = cut(rows.repartitionByRange(*by, order).withColumn("_part", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy("_part", *by).agg(*[F.sum(c).alias(f"_{n}") for n, c in values.items()])
    before = W.partitionBy(*by or [F.lit(0)]).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    start = totals.select(F.col("_part").alias("_p"), *[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_start_{n}") for n in values])
    same = F.col("_part") == F.col("_p")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    own = W.partitionBy("_part", *by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    summed = dealt.withColumns({f"_own_{n}": F.sum(c).over(own) for n, c in values.items()}).join(start, same)
    return summed.select(*rows.columns, *[(F.col(f"_start_{n}") + F.col(f"_own_{n}")).alias(n) for n in values])


def percentiles(values: DataFrame, points: list[float], by: str = "feature", value: str = "value") -> DataFrame:
    """(by, p): for each group the exact percentiles at ``points``, interpolated linearly, as an array in their order.

    Null and NaN values do not count; a group without values has no row.
    Equal values are aggregated first, so ties cost nothing.
    """
    counts = values.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(by, value).agg(F.count(F.lit(1)).alias("_n"))
    upto = cut(running_totals(counts, value, {"_upto": "_n"}, [by]), "upto")
    size = upto.groupBy(by).agg(F.max("_upto").alias("_size"))
    place = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(points)])).alias("x")
    wanted = size.select(by, "_size", place).select(by, F.col("x.i").alias("i"), (F.col("x.p") * (F.col("_size") - 1)).alias("at"))
    # at most two ranks per point: few rows, however many values there are
    ranks = wanted.select(by, "i", "at", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))).alias("rank"))
    held = upto.join(ranks, by).where((F.col("rank") < F.col("_upto")) & (F.col("rank") >= F.col("_upto") - F.col("_n")))
    pair = held.groupBy(by, "i").agg(F.min_by(value, "rank").alias("lo"), F.max_by(value, "rank").alias("hi"), F.max(F.col("at") - F.floor("at")).alias("part"))
    each = pair.select(by, "i", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("part")).alias("v"))
    return each.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("p"))
