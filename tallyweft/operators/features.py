"""Account features: temporal behaviour, motifs, topology, raw attributes, and their assembly and scaling."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyweft.functions.scalar import ratio, seconds_between
from tallyweft.operators import iterate
from tallyweft.operators.graph import clustering, node_statistics, weighted
from tallyweft.operators.ranks import percentiles
from tallyweft.operators.validate import assert_disjoint

# --- temporal ---------------------------------------------------------------------------------


def incident(edges: DataFrame) -> DataFrame:
    """(account_id, ts, amount, tx_id, side): each timed transaction once for either end; a loop counts twice."""
    ends = F.explode(F.array(F.struct(F.col("src").alias("account_id"), F.lit(0).alias("side")), F.struct(F.col("dst").alias("account_id"), F.lit(1).alias("side")))).alias("x")
    return edges.where(F.col("ts").isNotNull()).select(ends, "ts", "amount", "tx_id").select("x.account_id", "ts", "amount", "tx_id", "x.side")


def temporal_features(edges: DataFrame, window: int = 5) -> DataFrame:
    """Counts, velocity, gaps, burstiness and the mean of the last ``window`` amounts, of accounts with timed transactions.

    One sort by account and time serves the gaps and the last amounts; ties in
    time are ordered by transaction and side.
    """
    forward = W.partitionBy("account_id").orderBy("ts", "tx_id", "side")
    gap = seconds_between(F.lag("ts").over(forward), F.col("ts"))
    recent = F.avg(F.coalesce("amount", F.lit(0.0))).over(forward.rowsBetween(-(window - 1), 0))
    rows = incident(edges).withColumns({"gap": gap, "recent": recent})
    place = F.struct("ts", "tx_id", "side")
    g = rows.groupBy("account_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"),
        F.coalesce(F.avg("gap"), F.lit(0.0)).alias("mean_gap"), F.coalesce(F.stddev_pop("gap"), F.lit(0.0)).alias("std_gap"),
        F.max_by("recent", place).alias("recent"),
    )
    span = seconds_between(F.col("first"), F.col("last"))
    mean, std = F.col("mean_gap"), F.col("std_gap")
    return g.select(
        "account_id",
        F.col("n").alias("temporal_tx_count"),
        F.when(span > 0, F.col("n") / span).otherwise(0.0).alias("temporal_velocity"),
        mean.alias("temporal_mean_inter_arrival"),
        std.alias("temporal_std_inter_arrival"),
        F.when(std + mean > 0, (std - mean) / (std + mean)).otherwise(0.0).alias("temporal_burstiness"),
        F.col("recent").alias("temporal_rolling_amount_mean"),
    )


# --- motifs and topology ----------------------------------------------------------------------


def fan_features(vertices: DataFrame, edges: DataFrame, fan_in: int = 6, fan_out: int = 6) -> DataFrame:
    """Distinct predecessors and successors (a loop is both), threshold flags and chain membership."""
    pairs = weighted(edges)
    ends = pairs.select(F.explode(F.array(F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("x")).select("x.*")
    counts = ends.groupBy("id").agg(F.sum("i").alias("motif_fan_in_count"), F.sum("o").alias("motif_fan_out_count"))
    n_in, n_out = F.col("motif_fan_in_count"), F.col("motif_fan_out_count")
    flags = {"motif_is_fan_in": n_in >= fan_in, "motif_is_fan_out": n_out >= fan_out, "motif_is_chain": (n_in == 1) & (n_out == 1)}
    return vertices.select("id").distinct().join(counts, "id", "left").na.fill(0).withColumns({k: v.cast("int") for k, v in flags.items()})


def cycle_flags(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, motif_is_cycle): in a strong component of several vertices, or with a loop."""
    strong = iterate.strong_components(vertices, edges)
    loops = edges.where("src = dst").select(F.col("src").alias("id")).distinct().withColumn("loop", F.lit(True))
    return strong.join(loops, "id", "left").select("id", ((F.col("size") > 1) | F.coalesce("loop", F.lit(False))).cast("int").alias("motif_is_cycle"))


def motif_features(vertices: DataFrame, edges: DataFrame, fan_in: int = 6, fan_out: int = 6) -> DataFrame:
    return fan_features(vertices, edges, fan_in, fan_out).join(cycle_flags(vertices, edges), "id")


def topological_features(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Degree, clustering, PageRank, core number and component size of every vertex."""
    parts = [
        node_statistics(vertices, edges).select("id", F.col("degree").alias("graph_degree")),
        clustering(vertices, edges).select("id", F.col("clustering").alias("graph_clustering")),
        iterate.pagerank(vertices, edges).select("id", F.col("pagerank").alias("graph_pagerank")),
        iterate.core_numbers(vertices, edges).select("id", F.col("core").alias("graph_core")),
        iterate.connected_components(vertices, edges).select("id", F.col("size").alias("graph_component_size")),
    ]
    return reduce(lambda a, b: a.join(b, "id"), parts)


# --- raw attributes ---------------------------------------------------------------------------


def _leaves(kind, path: str = "$") -> list[tuple[str, str]]:
    from pyspark.sql import types as T

    if isinstance(kind, T.StructType):
        return [leaf for f in kind for leaf in _leaves(f.dataType, f"{path}.{f.name}")]
    return [(path, kind.simpleString())]


def numeric_keys(accounts: DataFrame, column: str = "attributes") -> list[str]:
    """JSON paths whose every value is a number, by the schema of the whole column (one action)."""
    text = accounts.select(F.schema_of_variant_agg(F.try_parse_json(column)).alias("s")).first()["s"]
    if not text or not text.startswith("OBJECT"):
        return []
    from pyspark.sql.types import _parse_datatype_string

    kind = _parse_datatype_string(text.replace("OBJECT<", "STRUCT<"))
    return sorted(p for p, t in _leaves(kind) if t in ("bigint", "double", "float") or t.startswith("decimal"))


def raw_features(accounts: DataFrame, keys: list[str] | None = None, column: str = "attributes") -> DataFrame:
    """account_id and one double ``raw_<name>`` for each numeric attribute; nested names are joined by dots."""
    keys = numeric_keys(accounts, column) if keys is None else keys
    parsed = accounts.select("account_id", F.try_parse_json(column).alias("v"))
    return parsed.select("account_id", *[F.try_variant_get("v", k, "double").alias("raw_" + k.removeprefix("$.").replace(".", "_")) for k in keys])


# --- assembly ---------------------------------------------------------------------------------


def feature_matrix(accounts: DataFrame, *families: DataFrame) -> DataFrame:
    """A row per account with all families' columns, unknown values zero.

    Every family is keyed and partitioned by account, so the left joins share
    one exchange of the accounts.
    """
    out = accounts.select("account_id").distinct()
    for f in families:
        key = "account_id" if "account_id" in f.columns else "id"
        out = out.join(f.withColumnRenamed(key, "account_id"), "account_id", "left")
    return out.select("account_id", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in out.columns if c != "account_id"])


# --- scaling ----------------------------------------------------------------------------------

SCALERS = ("standard", "robust", "minmax", "none")


def scaler_statistics(train: DataFrame, columns: list[str], scaler: str) -> dict[str, tuple[float, float]]:
    """(centre, scale) of each column over the training rows, in one aggregation; a scale of zero counts as one."""
    if scaler not in SCALERS:
        raise ValueError(f"scaler must be one of {SCALERS}")
    if scaler == "none" or not columns:
        return {c: (0.0, 1.0) for c in columns}

    if scaler == "robust":
        long = train.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in columns])).alias("x")).select("x.*")
        q = {r["feature"]: r["p"] for r in percentiles(long, [0.25, 0.5, 0.75]).collect()}
        return {c: (float(q[c][1]), float(q[c][2] - q[c][0]) or 1.0) if c in q else (0.0, 1.0) for c in columns}

    def pair(c: str) -> list[Column]:
        if scaler == "standard":
            return [F.avg(c), F.stddev_pop(c)]
        return [F.min(c), F.max(c) - F.min(c)]

    found = train.agg(*[x.alias(f"{c}__{i}") for c in columns for i, x in enumerate(pair(c))]).first()
    return {c: (float(found[f"{c}__0"] or 0.0), float(found[f"{c}__1"] or 0.0) or 1.0) for c in columns}


@dataclass
class FeaturePipeline:
    """Fits column order and scaling on training accounts only; refuses ids that are held out."""

    scaler: str = "standard"
    columns: list[str] = field(default_factory=list)
    statistics: dict[str, tuple[float, float]] = field(default_factory=dict)

    def fit(self, matrix: DataFrame, train_ids: DataFrame, held_out_ids: DataFrame | None = None) -> FeaturePipeline:
        if held_out_ids is not None:
            assert_disjoint(train_ids, held_out_ids, "account_id")
        train = matrix.join(train_ids.select("account_id").distinct(), "account_id", "left_semi")
        if train.isEmpty():
            raise ValueError("no training accounts")
        self.columns = [c for c in matrix.columns if c != "account_id"]
        self.statistics = scaler_statistics(train, self.columns, self.scaler)
        return self

    def transform(self, matrix: DataFrame, ids: DataFrame | None = None) -> DataFrame:
        """Fitted columns in fitted order, scaled; columns the matrix lacks count as zero, others are dropped."""
        if not self.columns:
            raise RuntimeError("the pipeline is not fitted")
        if ids is not None:
            matrix = matrix.join(ids.select("account_id").distinct(), "account_id", "left_semi")

        def scaled(c: str) -> Column:
            centre, scale = self.statistics[c]
            raw = F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in matrix.columns else F.lit(0.0)
            return ((raw - F.lit(centre)) / F.lit(scale)).alias(c)

        return matrix.select("account_id", *map(scaled, self.columns))

    def save(self, path: str) -> None:
        with open(path, "w") as f:
            json.dump({"kind": "feature_pipeline", "scaler": self.scaler, "columns": self.columns, "statistics": self.statistics}, f)

    @classmethod
    def load(cls, path: str) -> FeaturePipeline:
        with open(path) as f:
            x = json.load(f)
        if x.get("kind") != "feature_pipeline":
            raise TypeError("the file holds no feature pipeline")
        return cls(x["scaler"], x["columns"], {k: tuple(v) for k, v in x["statistics"].items()})


def shares(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by..., value, share): relative frequency of each value within each group."""
    n = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    return n.select(*by, value, ratio(F.col("n"), F.sum("n").over(W.partitionBy(*by))).alias("share"))
