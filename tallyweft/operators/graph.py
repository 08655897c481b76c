"""Transaction graphs as frames: ``vertices(id)`` and ``edges(tx_id, src, dst, amount, ts, ...)``.

Parallel edges and loops are kept.  Isolated vertices come from ``vertices``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweft.functions.scalar import ratio
from tallyweft.storage import cut


def edges_of(transactions: DataFrame) -> DataFrame:
    """The multigraph view of canonical transactions."""
    return transactions.select("tx_id", F.col("src_account").alias("src"), F.col("dst_account").alias("dst"), "amount", F.col("timestamp").alias("ts"), "channel")


def in_window(edges: DataFrame, start=None, end=None) -> DataFrame:
    """Edges with start <= ts < end; unknown times are in no window. Without bounds, all edges."""
    if start is None and end is None:
        return edges
    out = edges.where(F.col("ts").isNotNull())
    if start is not None:
        out = out.where(F.col("ts") >= F.lit(start))
    return out if end is None else out.where(F.col("ts") < F.lit(end))


def weighted(edges: DataFrame) -> DataFrame:
    """The simple directed graph: (src, dst, weight), weight the number of parallel edges."""
    return edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))


def undirected(edges: DataFrame) -> DataFrame:
    """The simple undirected graph without loops: each pair once, as (a, b) with a < b."""
    return edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def half_edges(edges: DataFrame) -> DataFrame:
    """Both directions of the undirected view: (id, other)."""
    e = undirected(edges)
    return e.select(F.col("a").alias("id"), F.col("b").alias("other")).unionByName(e.select(F.col("b").alias("id"), F.col("a").alias("other")))


def _onto(vertices: DataFrame, stats: DataFrame) -> DataFrame:
    return vertices.select("id").distinct().join(stats, "id", "left").na.fill(0)


def node_statistics(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Degrees (parallel edges counted, a loop once each way), strengths (unknown amounts skipped)
    and distinct neighbours of every vertex: one aggregation over both ends of the edges."""
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("dst").alias("id"), F.lit(True).alias("inward"), F.col("src").alias("other"), "amount"),
        F.struct(F.col("src").alias("id"), F.lit(False).alias("inward"), F.col("dst").alias("other"), "amount"),
    )).alias("x")).select("x.*")
    into, out = F.col("inward"), ~F.col("inward")
    # distinct neighbours by a first aggregation, so no hot vertex holds a set
    per = ends.groupBy("id", "inward", "other").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))
    total = lambda c, when: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0))
    stats = per.groupBy("id").agg(
        total("n", into).alias("in_degree"), total("n", out).alias("out_degree"),
        total("amount", into).cast("double").alias("in_strength"), total("amount", out).cast("double").alias("out_strength"),
        F.count(F.when(into, 1)).alias("in_neighbors"), F.count(F.when(out, 1)).alias("out_neighbors"),
    )
    return _onto(vertices, stats).withColumn("degree", F.col("in_degree") + F.col("out_degree"))


def snapshots(edges: DataFrame, step_seconds: int) -> DataFrame:
    """(snapshot, tx_id, src, dst): tumbling windows of a width, aligned to the first time; the last holds the latest edge."""
    if step_seconds <= 0:
        raise ValueError("the step must be positive")
    first = edges.agg(F.min("ts").alias("first"))
    at = F.floor(F.timestamp_diff("MICROSECOND", F.col("first"), F.col("ts")) / (step_seconds * 1_000_000)).cast("long")
    return edges.where(F.col("ts").isNotNull()).join(F.broadcast(first)).select(at.alias("snapshot"), "tx_id", "src", "dst")


def snapshot_sizes(edges: DataFrame, step_seconds: int) -> DataFrame:
    """(snapshot, n_edges) of every window, empty ones too; no row if no edge has a time."""
    sized = snapshots(edges, step_seconds).groupBy("snapshot").agg(F.count(F.lit(1)).alias("n_edges"))
    grid = sized.agg(F.max("snapshot").alias("last")).where("last is not null").select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("snapshot"))
    return grid.join(sized, "snapshot", "left").na.fill(0)


def clustering(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree, triangles, clustering) on the simple undirected graph.

    Edges point from the end of lower degree to the higher, so a hot vertex
    has few outgoing edges and the wedges stay within the edge count to the
    power of one and a half; each triangle is found once.
    """
    e = undirected(edges)
    degree = half_edges(edges).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    of = lambda c, d: degree.select(F.col("id").alias(c), F.col("degree").alias(d))
    ranked = e.join(of("a", "da"), "a").join(of("b", "db"), "b")
    low_first = (F.col("da") < F.col("db")) | (F.col("da") == F.col("db")) & (F.col("a") < F.col("b"))
    out = ranked.select(F.when(low_first, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(low_first, F.col("b")).otherwise(F.col("a")).alias("w"))
    wedge = out.alias("x").join(out.alias("y"), (F.col("x.u") == F.col("y.u")) & (F.col("x.w") < F.col("y.w"))).select(F.col("x.u").alias("u"), F.col("x.w").alias("a"), F.col("y.w").alias("b"))
    found = wedge.join(e, ["a", "b"]).select(F.explode(F.array("u", "a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("triangles"))
    d = F.col("degree")
    return _onto(vertices, degree.join(found, "id", "left")).select("id", "degree", "triangles", ratio(2 * F.col("triangles"), d * (d - 1)).alias("clustering"))


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends in ``ids(id)``."""
    at = lambda c: ids.select(F.col("id").alias(c)).distinct()
    return edges.join(at("src"), "src", "left_semi").join(at("dst"), "dst", "left_semi")


def touching(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with an end in ``ids(id)``, each once: two semi-joins, the second over what the first left."""
    at = lambda c: ids.select(F.col("id").alias(c)).distinct()
    return edges.join(at("src"), "src", "left_semi").unionByName(edges.join(at("src"), "src", "left_anti").join(at("dst"), "dst", "left_semi").select(edges.columns))


def in_edge_index(edges: DataFrame, size: int = 4096) -> DataFrame:
    """(dst, chunk, tx_ids): the ids of each vertex's incoming edges in order, in chunks of ``size`` from chunk 0 on.

    Edges are numbered over all vertices by range, so the edges of a hot
    vertex are dealt to many tasks, and no array is longer than ``size``.
    """
    placed = cut(numbered_in_order(edges.select("dst", "tx_id", F.struct("dst", "tx_id").alias("_order")), "_order", "_place").drop("_order"), "places")
    first = placed.groupBy("dst").agg(F.min("_place").alias("_first"))
    chunk = F.floor((F.col("_place") - F.col("_first")) / size).cast("long")
    return placed.join(first, "dst").groupBy("dst", chunk.alias("chunk")).agg(F.sort_array(F.collect_list("tx_id")).alias("tx_ids"))


def dense_export(vertices: DataFrame, edges: DataFrame, features: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Numbered nodes and edges for tensor libraries: (node, id, features...) and (row, src, dst, edge_attr, edge_time).

    Nodes are numbered 0.. in order of id by range-partitioned counts, without
    a window over all rows.  Unknown amounts and times are zero.
    """
    numbered = numbered_in_order(vertices.select("id").distinct(), "id", "node")
    nodes = numbered if features is None else numbered.join(features, "id", "left").na.fill(0.0)
    at = lambda c: numbered.select(F.col("id").alias(c), F.col("node").alias(f"{c}_node"))
    flat = edges.join(at("src"), "src").join(at("dst"), "dst").select(
        "tx_id", F.col("src_node").alias("src"), F.col("dst_node").alias("dst"), F.coalesce("amount", F.lit(0.0)).alias("edge_attr"),
        F.coalesce(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz")) / 1e6, F.lit(0.0)).alias("edge_time"),
    )
    return nodes, flat


def numbered_in_order(rows: DataFrame, key: str, name: str) -> DataFrame:
    """``rows`` with a gapless number from 0 in order of a unique key.

    Rows are dealt by range; each range's offset comes from the counts of the
    ranges before it (a row per partition).
    """
    from pyspark.sql import Window as W

    dealt = cut(rows.repartitionByRange(key).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    start = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_start"))
    own = F.row_number().over(W.partitionBy("_part").orderBy(key)) - 1
    return dealt.withColumn("_own", own).join(F.broadcast(start), "_part").withColumn(name, F.col("_start") + F.col("_own")).drop("_part", "_own", "_start")


def attach(vertices: DataFrame, features: DataFrame) -> DataFrame:
    """Vertices with their feature rows; raises KeyError naming vertices without one."""
    missing = [r["id"] for r in vertices.join(features, "id", "left_anti").orderBy("id").limit(5).collect()]
    if missing:
        raise KeyError(f"no features for {missing}")
    return vertices.join(features, "id")


def boundary_accounts(edges: DataFrame, prefix: str = "pseudo_") -> DataFrame:
    """(id): local ends of edges whose other end is a pseudonym."""
    a, b = F.col("src").startswith(prefix), F.col("dst").startswith(prefix)
    return edges.where(a != b).select(F.when(a, F.col("dst")).otherwise(F.col("src")).alias("id")).distinct()
