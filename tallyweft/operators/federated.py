"""The data plane of a multi-institution experiment: ownership, partitions, pseudonyms, averaging, privacy."""

from __future__ import annotations

import math
import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyweft.functions.scalar import hmac_sha256, md5_mod
from tallyweft.operators.graph import numbered_in_order
from tallyweft.storage import cut

KEY_VARIABLE, TEST_KEY = "TALLYWEFT_PSEUDONYM_KEY", "test-only-key"


def pseudonym(account: Column, key: str | None = None) -> Column:
    """pseudo_ and the HMAC-SHA256 of the id; the key comes from the environment, with a fallback for tests."""
    return F.concat(F.lit("pseudo_"), hmac_sha256(account, key or os.environ.get(KEY_VARIABLE, TEST_KEY)))


def owners(accounts: DataFrame, clients: int) -> DataFrame:
    """(account_id, owner): institutions in order, dealt round; accounts without one by the MD5 of their id."""
    banks = accounts.where("institution_id is not null").select("institution_id").distinct()
    # a row per institution is ranked, not a row per account
    ranked = banks.withColumn("bank_owner", F.pmod(F.row_number().over(W.orderBy("institution_id")) - 1, F.lit(clients)).cast("int"))
    return accounts.join(ranked, "institution_id", "left").select("account_id", F.coalesce("bank_owner", md5_mod(F.col("account_id"), clients).cast("int")).alias("owner"))


def with_owners(transactions: DataFrame, owned: DataFrame) -> DataFrame:
    at = lambda c: owned.select(F.col("account_id").alias(f"{c}_account"), F.col("owner").alias(f"{c}_owner"))
    return transactions.join(at("src"), "src_account", "left").join(at("dst"), "dst_account", "left")


def partition_transactions(transactions: DataFrame, owned: DataFrame, key: str | None = None) -> DataFrame:
    """(client, transaction...): every client's view, external ends as pseudonyms; one plan for all clients."""
    t = with_owners(transactions, owned)
    client = F.explode(F.array_compact(F.array_distinct(F.array("src_owner", "dst_owner")))).alias("client")
    seen = t.select("*", client)
    end = lambda c: F.when(F.col(f"{c}_owner").eqNullSafe(F.col("client")), F.col(f"{c}_account")).otherwise(pseudonym(F.col(f"{c}_account"), key)).alias(f"{c}_account")
    return seen.select("client", *[end(c.removesuffix("_account")) if c in ("src_account", "dst_account") else F.col(c) for c in transactions.columns])


def partition_accounts(accounts: DataFrame, owned: DataFrame, seen: DataFrame) -> DataFrame:
    """(client, account...): local accounts, and each client's pseudonyms as accounts named external."""
    local = accounts.join(owned, "account_id").select(F.col("owner").alias("client"), *accounts.columns)
    ends = seen.select("client", F.explode(F.array("src_account", "dst_account")).alias("account_id"))
    pseudo = ends.where(F.col("account_id").startswith("pseudo_")).distinct()
    new = pseudo.select("client", "account_id", F.lit("external").alias("institution_id"), F.lit(None).cast("timestamp_ntz").alias("opened_at"), F.lit("{}").alias("attributes"))
    return local.unionByName(new, allowMissingColumns=True)


def partition_labels(labels: DataFrame, owned: DataFrame, seen: DataFrame) -> DataFrame:
    """(client, label...): labels of local accounts or of visible transactions; rings belong to nobody."""
    acc = labels.where("entity_type = 'account'").join(owned.select(F.col("account_id").alias("entity_id"), F.col("owner").alias("client")), "entity_id")
    tx = labels.where("entity_type = 'tx'").join(seen.select(F.col("tx_id").alias("entity_id"), "client").distinct(), "entity_id")
    return acc.unionByName(tx).select("client", *labels.columns)


def nodes_per_client(owned: DataFrame, clients: int) -> DataFrame:
    """(client, n_accounts) of every client, empty ones too."""
    grid = owned.sparkSession.range(0, clients, 1, 1).select(F.col("id").cast("int").alias("client"))
    return grid.join(owned.groupBy(F.col("owner").alias("client")).agg(F.count(F.lit(1)).alias("n_accounts")), "client", "left").na.fill(0)


def cut_edges(transactions: DataFrame, owned: DataFrame) -> DataFrame:
    """Transactions between two known, different owners."""
    return with_owners(transactions, owned).where("src_owner is not null and dst_owner is not null and src_owner <> dst_owner")


def ring_spans(rings: DataFrame, owned: DataFrame) -> DataFrame:
    """(ring_id, span): distinct owners among a ring's members; rings are (ring_id, member) rows."""
    return rings.join(owned, rings["member"].cast("string") == owned["account_id"]).groupBy("ring_id").agg(F.countDistinct("owner").alias("span"))


def span_histogram(spans: DataFrame, clients: int) -> DataFrame:
    """(k, n_rings) for k from 1 to the number of clients, zeros included."""
    grid = spans.sparkSession.range(1, clients + 1, 1, 1).select(F.col("id").alias("k"))
    return grid.join(spans.groupBy(F.col("span").alias("k")).agg(F.count(F.lit(1)).alias("n_rings")), "k", "left").na.fill(0)


def recall_by_span(scored: DataFrame, members: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(span, n, recall) of positive accounts by the span of their ring; accounts of no ring have span 1.

    ``scored`` is (id, label, score), ``members`` (id, span).
    """
    best = members.groupBy("id").agg(F.max("span").alias("span"))
    named = scored.where("label = 1").join(best, "id", "left").withColumn("span", F.coalesce("span", F.lit(1).cast("long")))
    return named.groupBy("span").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("score") >= threshold).cast("double")).alias("recall"))


def recall_pooled(scored: DataFrame, members: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(spread, n, recall): the same for rings within one institution (``single``) and across several (``several``)."""
    best = members.groupBy("id").agg(F.max("span").alias("span"))
    spread = F.when(F.coalesce("span", F.lit(1).cast("long")) >= 2, "several").otherwise("single")
    named = scored.where("label = 1").join(best, "id", "left").withColumn("spread", spread)
    return named.groupBy("spread").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("score") >= threshold).cast("double")).alias("recall"))


# --- averaging and privacy --------------------------------------------------------------------


def fedavg(updates: DataFrame) -> DataFrame:
    """(pos, value): weighted mean of the parameter arrays ``weights`` by ``n``."""
    flat = updates.select("n", F.posexplode("weights").alias("pos", "w"))
    return flat.groupBy("pos").agg((F.sum(F.col("w") * F.col("n")) / F.sum("n")).alias("value"))


def l2(x: Column) -> Column:
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v))


def clipped(x: Column, norm: float) -> Column:
    """The array scaled down to an L2 norm of ``norm`` at most."""
    factor = F.least(F.lit(1.0), F.lit(norm) / (l2(x) + F.lit(1e-9)))
    return F.transform(x, lambda v: v * factor)


def _uniform(*parts: Column) -> Column:
    """In (0, 1), from a hash: the same for the same parts on every run."""
    return (F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))


def gaussian(*parts: Column) -> Column:
    """A standard normal value from a hash of the parts (Box-Muller)."""
    return F.sqrt(-2 * F.ln(_uniform(*parts, F.lit(1)))) * F.cos(2 * math.pi * _uniform(*parts, F.lit(2)))


def private_update(before: Column, after: Column, *, clip: float = 1.0, noise: float = 1.1, key: Column) -> Column:
    """before plus the clipped difference plus noise of standard deviation noise times clip."""
    delta = clipped(F.zip_with(after, before, lambda a, b: a - b), clip)
    return F.zip_with(before, F.transform(delta, lambda d, i: d + noise * clip * gaussian(key, i)), lambda b, d: b + d)


def rdp_epsilon(steps: DataFrame, noise: float = 1.1, delta: float = 1e-5) -> DataFrame:
    """(steps, epsilon): the least over 100 orders from 1.1 to 100 of steps*a/(2*noise^2) + ln(1/delta)/(a-1); 0 for no steps."""
    if not 0 < delta < 1:
        raise ValueError("delta must lie between 0 and 1")
    order = F.lit(1.1) + F.col("i") * F.lit((100 - 1.1) / 99)
    each = steps.select("steps", F.explode(F.sequence(F.lit(0), F.lit(99))).alias("i"))
    eps = F.col("steps") * order / F.lit(2 * noise * noise) + F.lit(math.log(1 / delta)) / (order - 1)
    return each.groupBy("steps").agg(F.when(F.col("steps") > 0, F.min(eps)).otherwise(0.0).alias("epsilon"))


def masks(clients: DataFrame, dim: int, seed: int = 0) -> DataFrame:
    """(client, mask): distinct clients in a ring share a hash-seeded vector with those 1, 2, 4, ... places on; the one adds it, the other subtracts it, so the masks sum to zero.

    A client has a few masks for each doubling of the number of clients, not
    one for each other client, and makes them without a shuffle.  A client
    that is alone has none.
    """
    placed = cut(numbered_in_order(clients.select("client"), "client", "_place"), "places")
    n = placed.count()
    steps = [1 << j for j in range(max(n - 1, 0).bit_length())]
    if not steps:
        return clients.select("client", F.lit(None).cast("array<long>").alias("mask"))
    # whole numbers cancel exactly, whatever the order of the sums
    shared = lambda at, step, pos: F.pmod(F.xxhash64(at, F.lit(step), pos, F.lit(seed)), F.lit(1 << 20)) - (1 << 19)

    def total(pos: Column) -> Column:
        out = F.lit(0).cast("long")
        for step in steps:
            out = out + shared(F.col("_place"), step, pos) - shared(F.pmod(F.col("_place") - step, F.lit(n)), step, pos)
        return out

    return placed.select("client", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), total).alias("mask"))


def masked_updates(updates: DataFrame, mask: DataFrame, scale: float = 1 << 16) -> DataFrame:
    """(client, masked): n-weighted updates in fixed point plus the client's mask: only the sum over all clients is readable."""
    fixed = F.transform("weights", lambda v: F.round(v * F.col("n") * scale).cast("long"))
    return updates.join(mask, "client").select("client", "n", F.when(F.col("mask").isNull(), fixed).otherwise(F.zip_with(fixed, "mask", lambda a, b: a + b)).alias("masked"))


def sampled_clients(clients: DataFrame, fraction: float, seed: int) -> DataFrame:
    """ceil(N * fraction) clients in order of a seeded hash."""
    n = math.ceil(clients.count() * fraction)
    return clients.orderBy(F.xxhash64("client", F.lit(seed))).limit(n)


def communication_bytes(sampled: int, parameters: int, width: int = 4) -> int:
    """Bytes of a round: every sampled client receives and sends all parameters."""
    return 2 * sampled * parameters * width


# --- boundary embeddings ----------------------------------------------------------------------


def published(embeddings: DataFrame, round_no: int, *, clip: float | None = 1.0, noise: float = 1.1, key: str | None = None) -> DataFrame:
    """(pseudonym, round, vec) of local boundary accounts: clipped, noised, under their pseudonyms.

    Without ``clip`` vectors go out as they are.  The noise is drawn from a
    keyed pseudonym of the account and the round: a repeated round publishes
    the same values, and only who holds the key could draw them again.
    """
    noisy = F.col("vec") if clip is None else clipped(F.col("vec"), clip)
    if clip is not None and noise:
        # another use of the key than the pseudonym that is published
        source = pseudonym(F.concat(F.lit(f"noise:{round_no}:"), F.col("account_id")), key)
        noisy = F.transform(noisy, lambda v, i: v + noise * clip * gaussian(source, i))
    return embeddings.select(pseudonym(F.col("account_id"), key).alias("pseudonym"), F.lit(round_no).alias("round"), noisy.alias("vec"))


def latest(registry: DataFrame) -> DataFrame:
    """(pseudonym, vec): of each pseudonym the value of the last round."""
    return registry.groupBy("pseudonym").agg(F.max_by("vec", "round").alias("vec"))


def overridden(nodes: DataFrame, received: DataFrame) -> DataFrame:
    """Node vectors, replaced where a value was received for the node's pseudonym."""
    r = received.select(F.col("pseudonym").alias("id"), F.col("vec").alias("_vec"))
    return nodes.join(r, "id", "left").withColumn("vec", F.coalesce("_vec", "vec")).drop("_vec")


def mean_vectors(sent: DataFrame, by: list[str], width: int) -> DataFrame:
    """(by..., mean): element-wise means of ``vec``, in one row from the partial sums of a task on."""
    return sent.groupBy(*by).agg(F.array(*[F.avg(F.get("vec", i)) for i in range(width)]).alias("mean"))


def mean_neighbours(nodes: DataFrame, edges: DataFrame, width: int | None = None) -> DataFrame:
    """(id, vec): the mean vector of each node's in-neighbours, parallel edges counted; nodes without any get zeros.

    ``width`` is the length of the vectors; where it is not given, it is looked up.
    """
    if width is None:
        width = nodes.agg(F.max(F.size("vec"))).first()[0] or 0
    sent = edges.select("src", F.col("dst").alias("id")).join(nodes.select(F.col("id").alias("src"), "vec"), "src")
    zero = F.transform("vec", lambda v: F.lit(0.0))
    return nodes.join(mean_vectors(sent, ["id"], width), "id", "left").select("id", F.coalesce("mean", zero).alias("vec"))
