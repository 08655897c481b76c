"""Serving as transforms over append-only tables: ingest, scoring, alerts, reviews, dashboard queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DECISIONS = {"confirm": "confirmed", "dismiss": "dismissed"}
REVIEWERS = ("supervisor", "admin")


def new_rows(incoming: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Incoming rows whose key is not stored, one for each key (the least row, by its text)."""
    least = F.row_number().over(W.partitionBy(key).orderBy(F.to_json(F.struct(*incoming.columns))))
    return incoming.join(stored.select(key).distinct(), key, "left_anti").withColumn("_n", least).where("_n = 1").drop("_n").select(*incoming.columns)


def placeholder_accounts(transactions: DataFrame, accounts: DataFrame, bank: str = "bank_imported") -> DataFrame:
    """(account_id, bank_id) of the ends that are no accounts yet."""
    ends = transactions.select(F.explode(F.array("src_account", "dst_account")).alias("account_id")).distinct()
    return ends.join(accounts.select("account_id").distinct(), "account_id", "left_anti").withColumn("bank_id", F.lit(bank))


def job_id(model_id: str, account_ids: DataFrame) -> str:
    """Named after the model and the very set of accounts: a hash of their ordered ids' hashes."""
    total = account_ids.select("account_id").distinct().agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("account_id").cast("decimal(38,0)")).alias("h")).first()
    import hashlib

    return "job_" + hashlib.md5(f"{model_id}:{total['n']}:{total['h']}".encode()).hexdigest()[:16]


def alerts_of(scores: DataFrame, stored: DataFrame, *, model_id: str, job: str, threshold: float = 0.5) -> DataFrame:
    """New alerts of (account_id, score) rows at the threshold or above; stored ones are skipped."""
    alert = F.concat(F.lit("alert_"), F.substring(F.md5(F.concat_ws(":", F.lit(job), "account_id")), 1, 16))
    made = scores.where(F.col("score") >= threshold).select(alert.alias("alert_id"), "account_id", F.lit(model_id).alias("model_id"), "score", F.lit("open").alias("status"))
    return new_rows(made, stored, "alert_id")


def alert_queue(alerts: DataFrame, *, min_score: float = 0.0, status: str | None = None, offset: int = 0, limit: int = 50, by: str = "score", ascending: bool = False) -> DataFrame:
    """A page of the queue, best first, ties by id: a limited sort."""
    found = alerts.where(F.col("score") >= min_score)
    found = found if status is None else found.where(F.col("status") == status)
    return found.orderBy(F.asc(by) if ascending else F.desc(by), "alert_id").offset(offset).limit(limit)


def alert_detail(alerts: DataFrame, evidence: DataFrame, narratives: DataFrame) -> DataFrame:
    return alerts.join(evidence, "alert_id", "left").join(narratives, "alert_id", "left")


def review_faults(reviews: DataFrame) -> DataFrame:
    """Reviews with ``faults``: unknown decision, short reason, or a confirmation by a role that may not."""
    checks = [
        F.when(~F.col("decision").isin(*DECISIONS), F.lit("unknown decision")),
        F.when(F.coalesce(F.length("reason"), F.lit(0)) < 5, F.lit("reason too short")),
        F.when((F.col("decision") == "confirm") & ~F.col("role").isin(*REVIEWERS), F.lit("role may not confirm")),
    ]
    return reviews.withColumn("faults", F.array_compact(F.array(*checks)))


def current_status(alerts: DataFrame, reviews: DataFrame) -> DataFrame:
    """Alerts with the status of their latest review."""
    decided = F.create_map(*[F.lit(x) for pair in DECISIONS.items() for x in pair])
    last = reviews.groupBy("alert_id").agg(F.max_by("decision", F.struct("created_at", "review_id")).alias("decision"))
    return alerts.join(last, "alert_id", "left").withColumn("status", F.coalesce(F.try_element_at(decided, F.col("decision")), F.col("status"))).drop("decision")


def audit_rows(actor: Column, action: str, entity: Column, old: Column, new: Column, at: Column) -> list[Column]:
    return [F.uuid().alias("audit_id"), actor.alias("actor"), F.lit(action).alias("action"), entity.alias("entity_id"), old.alias("old_value"), new.alias("new_value"), at.alias("created_at")]


def rate_breaches(requests: DataFrame, *, limit: int = 100, window_seconds: int = 60) -> DataFrame:
    """Requests (client, ts, request_id) that find more than ``limit`` of their client within the trailing window, themselves included."""
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz"))
    trailing = W.partitionBy("client").orderBy("_us").rangeBetween(-window_seconds * 1_000_000, 0)
    return requests.withColumn("_us", micros).withColumn("in_window", F.count(F.lit(1)).over(trailing)).where(F.col("in_window") > limit).drop("_us")


# --- dashboard --------------------------------------------------------------------------------


def open_count(alerts: DataFrame) -> DataFrame:
    return alerts.agg(F.count_if(F.col("status") == "open").alias("open_alerts"))


def score_band(score: Column) -> Column:
    return F.when(score > 0.8, "high").when(score > 0.6, "medium").otherwise("low")


def scrubbed(edges: DataFrame, progress: float, group: str) -> DataFrame:
    """The first max(1, ceil(progress * n)) edges by time of each group."""
    part = W.partitionBy(group)
    place = F.row_number().over(part.orderBy(F.col("ts").asc_nulls_last(), "tx_id"))
    most = F.greatest(F.lit(1), F.ceil(F.lit(progress) * F.count(F.lit(1)).over(part)))
    return edges.withColumns({"place": place, "most": most}).where("place <= most").drop("place", "most")


def edge_width(amount: Column) -> Column:
    return F.least(F.greatest(F.coalesce(amount, F.lit(0.0)) / 15000, F.lit(1.0)), F.lit(8.0))


def edge_label(amount: Column) -> Column:
    """Thousands with one decimal, as C prints them: the very binary value is rounded, true halves to even; null for null.

    Java's %.1f rounds the shortest decimal that stands for the value, halves up.
    """
    value = amount.cast("double") / 1000
    size = F.abs(value)
    whole = F.floor(size).cast("double")
    rest = size - whole
    tenth = F.floor(rest * 10).cast("double")
    # rest against the half (2 * tenth + 1) / 20 in differences that are exact: its sixteenfold, subtracted, and its fourfold
    side = rest * 4 - ((tenth * 2 + 1) - rest * 16)
    up = (side > 0) | ((side == 0) & (tenth % 2 == 1))
    near = F.signum(value) * (whole + (tenth + up.cast("double")) / 10)
    inf = float("inf")
    shown = F.when(F.isnan(value), "nan").when(value == inf, "inf").when(value == -inf, "-inf").otherwise(F.format_string("%.1f", F.when(size < 2.0**52, near).otherwise(value)))
    return F.when(amount.isNotNull(), F.concat(F.lit("$"), shown, F.lit("k")))


def linked(text: Column, ids: list[str]) -> Column:
    """Known ids in a text wrapped as [[id]], the longest first, in one pass."""
    import re

    pattern = "|".join(re.escape(i) for i in sorted(ids, key=len, reverse=True))
    return F.regexp_replace(text, f"({pattern})", "[[$1]]") if ids else text


def may_submit(role: Column, decision: Column, reason: Column) -> Column:
    return (F.length(reason) >= 5) & ((decision != "confirm") | role.isin(*REVIEWERS))
