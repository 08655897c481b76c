"""Drift, fairness and evasion audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyweft.functions.scalar import ratio
from tallyweft.operators.metrics import roc_auc
from tallyweft.operators.ranks import percentiles
from tallyweft.storage import cut

# --- drift ------------------------------------------------------------------------------------


def _micros(ts):
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def performance_drift(scored: DataFrame, bins: int = 4) -> DataFrame:
    """(bin, n, first, last, auc) over quantile bins of time.

    Edges are exact percentiles, bins are closed to the right, the lowest edge
    belongs to the first, equal edges fall together; an AUC is 0.5 where a bin
    has one class.
    """
    timed = scored.where(F.col("ts").isNotNull()).withColumn("m", _micros(F.col("ts")).cast("double"))
    edges = percentiles(timed.select(F.lit("m").alias("feature"), F.col("m").alias("value")), [i / bins for i in range(bins + 1)]).select(F.array_distinct("p").alias("e"))
    at = F.greatest(F.size(F.filter("e", lambda x: x < F.col("m"))) - 1, F.lit(0))
    binned = timed.join(F.broadcast(edges)).withColumn("bin", at)
    sizes = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return sizes.join(roc_auc(binned, ["bin"]), "bin").withColumn("auc", F.coalesce("auc", F.lit(0.5)))


def psi(samples: DataFrame, buckets: int = 10) -> DataFrame:
    """(feature, psi) of long rows (feature, side, value), side 'expected' or 'actual'; all features in one pass.

    Edges are the distinct percentiles of the expected values; the last bucket
    is closed.  Actual values outside the edges fall into no bucket but count
    in the total.  Shares are raised by 1e-4 and renormalised.  Fewer than two
    edges, or an empty side, give 0.
    """
    known = samples.where(F.col("value").isNotNull() & ~F.isnan("value"))
    sizes = known.groupBy("feature").agg(F.count(F.when(F.col("side") == "expected", 1)).alias("n_expected"), F.count(F.when(F.col("side") == "actual", 1)).alias("n_actual"))
    cuts = percentiles(known.where("side = 'expected'"), [i / buckets for i in range(buckets + 1)])
    edges = sizes.join(cuts, "feature").withColumn("e", F.array_distinct("p")).drop("p")
    last = F.element_at("e", -1)
    n_buckets = F.size("e") - 1
    at = F.when(F.col("value") == last, n_buckets - 1).when((F.col("value") >= F.col("e")[0]) & (F.col("value") < last), F.size(F.filter("e", lambda x: x <= F.col("value"))) - 1)
    usable = edges.where((F.size("e") >= 2) & (F.col("n_expected") > 0) & (F.col("n_actual") > 0))
    counts = known.join(F.broadcast(usable), "feature").withColumn("bucket", at).where("bucket is not null").groupBy("feature", "bucket").agg(F.count(F.when(F.col("side") == "expected", 1)).alias("ce"), F.count(F.when(F.col("side") == "actual", 1)).alias("ca"))
    grid = usable.select("feature", "n_expected", "n_actual", F.explode(F.sequence(F.lit(0), n_buckets - 1)).alias("bucket")).join(counts, ["feature", "bucket"], "left").na.fill(0)
    part = W.partitionBy("feature")
    raw = grid.withColumns({"pe": F.col("ce") / F.col("n_expected") + 1e-4, "pa": F.col("ca") / F.col("n_actual") + 1e-4})
    share = raw.withColumns({"pe": F.col("pe") / F.sum("pe").over(part), "pa": F.col("pa") / F.sum("pa").over(part)})
    found = share.groupBy("feature").agg(F.sum((F.col("pa") - F.col("pe")) * F.ln(F.col("pa") / F.col("pe"))).alias("psi"))
    return samples.select("feature").distinct().join(found, "feature", "left").select("feature", F.coalesce("psi", F.lit(0.0)).alias("psi"))


def long_form(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(feature, side, value) of the numeric columns that both frames have."""
    numeric = ("double", "float", "bigint", "int", "smallint", "tinyint")
    kinds = dict(actual.dtypes)
    common = [c for c, t in expected.dtypes if t in numeric and kinds.get(c) in numeric]

    def melted(df: DataFrame, side: str) -> DataFrame:
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in common])).alias("x")
        return df.select(pairs, F.lit(side).alias("side")).select("x.feature", "side", "x.value")

    return melted(expected, "expected").unionByName(melted(actual, "actual"))


def input_drift(expected: DataFrame, actual: DataFrame, buckets: int = 10) -> DataFrame:
    """(feature, psi, mean_psi, level): the level of the mean is significant from 0.25, moderate from 0.1."""
    mean = F.avg("psi").over(W.partitionBy(F.lit(0)))
    level = F.when(F.col("mean_psi") >= 0.25, "significant").when(F.col("mean_psi") >= 0.1, "moderate").otherwise("insignificant")
    return psi(long_form(expected, actual), buckets).withColumn("mean_psi", mean).withColumn("level", level)


# --- fairness ---------------------------------------------------------------------------------


def group_rates(scored: DataFrame, group: str, threshold: float = 0.5) -> DataFrame:
    """(group, n, selection_rate, tpr, fpr)."""
    hit, pos = F.col("score") >= threshold, F.col("label") == 1
    count = lambda w: F.count(F.when(w, 1))
    g = scored.groupBy(F.col(group).alias("group")).agg(F.count(F.lit(1)).alias("n"), count(hit).alias("s"), count(hit & pos).alias("tp"), count(pos).alias("p"), count(hit & ~pos).alias("fp"))
    return g.select("group", "n", ratio(F.col("s"), F.col("n")).alias("selection_rate"), ratio(F.col("tp"), F.col("p")).alias("tpr"), ratio(F.col("fp"), F.col("n") - F.col("p")).alias("fpr"))


def bias_audit(scored: DataFrame, group: str, threshold: float = 0.5) -> DataFrame:
    """(demographic_parity, equalized_odds, fpr_disparity, n_groups): ranges over the groups; zeros below two groups."""
    r = group_rates(scored, group, threshold)
    span = lambda c: F.coalesce(F.max(c) - F.min(c), F.lit(0.0))
    return r.agg(span("selection_rate").alias("demographic_parity"), F.greatest(span("tpr"), span("fpr")).alias("equalized_odds"), span("fpr").alias("fpr_disparity"), F.count(F.lit(1)).alias("n_groups"))


def protected_attributes(accounts: DataFrame, most: int = 32) -> DataFrame:
    """(id, attribute, value) of the institution and of every scalar in the accounts' JSON that has from 2 to ``most`` values.

    Attributes are found in the data: values are counted by (attribute, value)
    first, so an attribute of as many values as accounts costs no set of them.
    Missing values and nested ones are no group.
    """
    held = F.map_concat(F.coalesce(F.from_json("attributes", "map<string,string>"), F.create_map().cast("map<string,string>")), F.create_map(F.lit("institution_id"), F.col("institution_id")))
    flat = cut(accounts.select(F.col("account_id").alias("id"), F.explode(F.map_filter(held, lambda k, v: v.isNotNull() & ~v.rlike(r"^\s*[\[{]"))).alias("attribute", "value")), "attributes")
    values = flat.groupBy("attribute", "value").count().groupBy("attribute").agg(F.count(F.lit(1)).alias("n"))
    return flat.join(F.broadcast(values.where((F.col("n") >= 2) & (F.col("n") <= most)).select("attribute")), "attribute").select("id", "attribute", "value")


def attribute_rates(scored: DataFrame, attributes: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(attribute, group, n, selection_rate, tpr, fpr) of (id, label, score) rows for every attribute, in one aggregation."""
    hit, pos = F.col("score") >= threshold, F.col("label") == 1
    count = lambda w: F.count(F.when(w, 1))
    g = scored.join(attributes, "id").groupBy("attribute", F.col("value").alias("group")).agg(F.count(F.lit(1)).alias("n"), count(hit).alias("s"), count(hit & pos).alias("tp"), count(pos).alias("p"), count(hit & ~pos).alias("fp"))
    return g.select("attribute", "group", "n", ratio(F.col("s"), F.col("n")).alias("selection_rate"), ratio(F.col("tp"), F.col("p")).alias("tpr"), ratio(F.col("fp"), F.col("n") - F.col("p")).alias("fpr"))


def bias_audits(scored: DataFrame, attributes: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(attribute, demographic_parity, equalized_odds, fpr_disparity, n_groups) of every attribute."""
    span = lambda c: F.max(c) - F.min(c)
    r = attribute_rates(scored, attributes, threshold).groupBy("attribute")
    return r.agg(span("selection_rate").alias("demographic_parity"), F.greatest(span("tpr"), span("fpr")).alias("equalized_odds"), span("fpr").alias("fpr_disparity"), F.count(F.lit(1)).alias("n_groups"))


# --- evasion ----------------------------------------------------------------------------------


def _ringed(transactions: DataFrame, ring_tx: DataFrame) -> DataFrame:
    marks = ring_tx.select("tx_id").distinct().withColumn("_ring", F.lit(True))
    return transactions.join(marks, "tx_id", "left").withColumn("_ring", F.coalesce("_ring", F.lit(False)))


def evade_split(transactions: DataFrame, ring_tx: DataFrame) -> DataFrame:
    """Each ring transaction becomes two of half its amount, the second named with _split."""
    t = _ringed(transactions, ring_tx)
    part = F.explode(F.when(F.col("_ring"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_part")
    rows = t.select("*", part)
    rows = rows.withColumns({"tx_id": F.when(F.col("_part") == 1, F.concat("tx_id", F.lit("_split"))).otherwise(F.col("tx_id")), "amount": F.when(F.col("_ring"), F.col("amount") / 2).otherwise(F.col("amount"))})
    return rows.select(*transactions.columns)


def evade_delay(transactions: DataFrame, ring_tx: DataFrame, days: int = 2) -> DataFrame:
    """Ring transactions happen some days later."""
    later = F.timestamp_add("DAY", F.lit(days), F.col("timestamp"))
    return _ringed(transactions, ring_tx).withColumn("timestamp", F.when(F.col("_ring"), later).otherwise(F.col("timestamp"))).select(*transactions.columns)


def evade_mule(transactions: DataFrame, ring_tx: DataFrame) -> DataFrame:
    """Each ring transaction becomes two hops through a new account mule_<tx>."""
    t = _ringed(transactions, ring_tx)
    hop = F.explode(F.when(F.col("_ring"), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(0)))).alias("_hop")
    mule = F.concat(F.lit("mule_"), F.col("tx_id"))
    rows = t.select("*", hop, mule.alias("_mule"))
    rows = rows.withColumns({
        "src_account": F.when(F.col("_hop") == 2, F.col("_mule")).otherwise(F.col("src_account")),
        "dst_account": F.when(F.col("_hop") == 1, F.col("_mule")).otherwise(F.col("dst_account")),
        "tx_id": F.when(F.col("_hop") > 0, F.concat("tx_id", F.lit("_hop"), F.col("_hop").cast("string"))).otherwise(F.col("tx_id")),
    })
    return rows.select(*transactions.columns)


def mule_accounts(accounts: DataFrame, ring_tx: DataFrame) -> DataFrame:
    """The accounts and the mules that ``evade_mule`` adds."""
    new = ring_tx.select("tx_id").distinct().select(F.concat(F.lit("mule_"), F.col("tx_id")).alias("account_id"), F.lit(None).cast("string").alias("institution_id"), F.lit(None).cast("timestamp_ntz").alias("opened_at"), F.lit("{}").alias("attributes"))
    return accounts.unionByName(new, allowMissingColumns=True)


EVASIONS = {0: lambda t, r: t, 1: evade_split, 2: evade_delay, 3: evade_mule}


def evasion_recall(transactions: DataFrame, ring_tx: DataFrame, targets: DataFrame, score_of, threshold: float = 0.5) -> DataFrame:
    """(level, recall) of the target accounts at each level of effort; ``score_of(transactions)`` gives (account_id, score)."""
    out = None
    for level, evade in EVASIONS.items():
        scored = targets.select("account_id").join(score_of(evade(transactions, ring_tx)), "account_id", "left")
        row = scored.agg(F.coalesce(F.avg((F.coalesce("score", F.lit(0.0)) >= threshold).cast("double")), F.lit(0.0)).alias("recall")).select(F.lit(level).alias("level"), "recall")
        out = row if out is None else out.unionByName(row)
    return out
