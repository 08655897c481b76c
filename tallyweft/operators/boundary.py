"""Rounds of boundary embeddings between institutions that know each other's accounts as pseudonyms only.

All clients of a round are one job keyed by (client, id).  A client holds its
own accounts with their vectors and the pseudonyms it transacts with, whose
vectors it does not know.  In each round every client

1. takes from the registry the latest vector of each of its pseudonyms,
2. passes messages over its own edges,
3. publishes the vectors of those of its accounts that transact with a
   pseudonym, under their own pseudonyms, clipped and noised.

The registry is a table of (pseudonym, round, vec), a part for each round, in
the shared folder: a repeated round replaces its own part, and no client reads
anything else of another's.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweft.operators import federated
from tallyweft.storage import cut, exists, scratch_path

PREFIX = "pseudo_"
PUBLISHED = "pseudonym string, vec array<double>"


class Registry:
    """The published vectors, by pseudonym and round."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, folder or scratch_path(spark, "registry")

    def publish(self, rows: DataFrame, round_no: int) -> None:
        """Store ``pseudonym`` and ``vec`` of ``rows`` as the values of a round, in place of what the round held."""
        rows.select("pseudonym", "vec").write.mode("overwrite").parquet(f"{self.folder}/round={round_no}")

    def all(self) -> DataFrame:
        """(pseudonym, round, vec)."""
        if not exists(self.spark, self.folder):
            return self.spark.createDataFrame([], f"{PUBLISHED}, round int").select("pseudonym", "round", "vec")
        return self.spark.read.schema(f"{PUBLISHED}, round int").parquet(self.folder).select("pseudonym", "round", "vec")

    def latest(self) -> DataFrame:
        """(pseudonym, vec) of the last round that published each pseudonym."""
        return federated.latest(self.all())


def client_nodes(vectors: DataFrame, owned: DataFrame, seen: DataFrame, width: int) -> DataFrame:
    """(client, id, vec) of ``vectors`` (account_id, vec) at their owners, and zeros for each pseudonym a client sees.

    Accounts without a vector, or of another width, get zeros too where they are missing entries.
    """
    filled = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.get("vec", i), F.lit(0.0)))
    own = owned.where("owner is not null").join(vectors, "account_id", "left").select(F.col("owner").alias("client"), F.col("account_id").alias("id"), filled.alias("vec"))
    ends = seen.select("client", F.explode(F.array("src", "dst")).alias("id")).where(F.col("id").startswith(PREFIX)).distinct()
    return own.unionByName(ends.withColumn("vec", F.array_repeat(F.lit(0.0), width)))


def client_edges(transactions: DataFrame, owned: DataFrame, key: str | None = None) -> DataFrame:
    """(client, tx_id, src, dst) of every client's view; external ends are pseudonyms."""
    seen = federated.partition_transactions(transactions.select("tx_id", "src_account", "dst_account"), owned, key)
    return seen.select("client", "tx_id", F.col("src_account").alias("src"), F.col("dst_account").alias("dst"))


def boundary_of(edges: DataFrame) -> DataFrame:
    """(client, id): a client's own accounts on an edge with a pseudonym."""
    a, b = F.col("src").startswith(PREFIX), F.col("dst").startswith(PREFIX)
    return edges.where(a != b).select("client", F.when(a, F.col("dst")).otherwise(F.col("src")).alias("id")).distinct()


def half_mean(nodes: DataFrame, edges: DataFrame, width: int) -> DataFrame:
    """(client, id, vec): half a node's vector plus half the mean of its in-neighbours, zeros where it has none."""
    sent = edges.select("client", "src", F.col("dst").alias("id")).join(nodes.select("client", F.col("id").alias("src"), "vec"), ["client", "src"])
    mean = federated.mean_vectors(sent, ["client", "id"], width)
    mixed = F.zip_with("vec", F.coalesce("mean", F.array_repeat(F.lit(0.0), width)), lambda a, b: (a + b) / 2)
    return nodes.join(mean, ["client", "id"], "left").select("client", "id", mixed.alias("vec"))


def overridden(nodes: DataFrame, received: DataFrame) -> DataFrame:
    """Nodes with the received vector wherever their id is a pseudonym of the registry."""
    r = received.select(F.col("pseudonym").alias("id"), F.col("vec").alias("_vec"))
    return nodes.join(r, "id", "left").select("client", "id", F.coalesce("_vec", "vec").alias("vec"))


@dataclass
class Exchanged:
    """The accounts' vectors (client, id, vec) after the last round, the registry, and a row for each round."""

    vectors: DataFrame
    registry: Registry
    log: list[dict] = field(default_factory=list)


def exchange(
    nodes: DataFrame, edges: DataFrame, *, width: int, rounds: int, layers: int = 1, layer: Callable[[DataFrame, DataFrame, int], DataFrame] = half_mean, clip: float | None = 1.0, noise: float = 0.0,
    spent: Callable[[int], float] | None = None, target: float | None = None, key: str | None = None, registry: Registry | None = None,
) -> Exchanged:
    """Run the rounds and return each account's vector, encoded once more with the last messages.

    ``layer`` takes (nodes, edges, width) of all clients and returns nodes.
    ``spent(r)`` is the privacy spent after round r: the first round beyond
    ``target`` is not run, and nothing is published any more.  Null or empty
    tables give empty results; parallel edges count each.
    """
    registry = registry or Registry(nodes.sparkSession)
    nodes, edges = cut(nodes, "clients"), cut(edges.select("client", "src", "dst"), "client-edges")
    border = cut(boundary_of(edges), "border")

    def encoded() -> DataFrame:
        now = overridden(nodes, registry.latest())
        for _ in range(layers):
            now = layer(now, edges, width)
        return now

    log = []
    for r in range(1, rounds + 1):
        used = spent(r) if spent else 0.0
        if target is not None and used > target:
            break
        out = encoded().join(border, ["client", "id"], "left_semi").select(F.col("id").alias("account_id"), "vec")
        # written once; the registry's part is what later rounds and the count read
        registry.publish(federated.published(out, r, clip=clip, noise=noise, key=key), r)
        log.append({"round": r, "epsilon": used, "published": registry.all().where(F.col("round") == r).count()})
    return Exchanged(encoded().where(~F.col("id").startswith(PREFIX)), registry, log)
