"""Serving tables that change by whole commits.

A table is a folder of parts.  A commit writes a part of each of its tables,
which nobody reads yet, and then one marker file that names them: creating it
is the commit, and the store creates it once or not at all.  Readers see the
parts that markers name.  A commit carries a token, the name of a job or an
idempotency key: whoever comes second with a token gets the stored response
and changes nothing, and what a killed attempt has left is never read.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweft.model import SERVING
from tallyweft.operators import explain, serving
from tallyweft.storage import cut, exists, file_at


class ServingStore:
    """The serving tables below a folder that all executors reach."""

    def __init__(self, spark: SparkSession, folder: str, tables: dict[str, T.StructType] | None = None):
        self.spark, self.folder, self.tables = spark, folder.rstrip("/"), tables or SERVING

    def _marker(self, token: str) -> str:
        return f"{self.folder}/commits/{hashlib.sha256(token.encode()).hexdigest()}.json"

    def response(self, token: str) -> dict | None:
        """The response stored with the token, if it has been committed."""
        fs, at = file_at(self.spark, self._marker(token))
        if not fs.exists(at):
            return None
        return json.loads("".join(r[0] for r in self.spark.read.text(self._marker(token), wholetext=True).collect()))["response"]

    def read(self, table: str) -> DataFrame:
        """The committed rows of a table; a row of markers for each commit passes through the driver, no data."""
        schema, commits = self.tables[table], f"{self.folder}/commits"
        parts: list[str] = []
        if exists(self.spark, commits):
            named = self.spark.read.text(commits, wholetext=True, pathGlobFilter="*.json")
            parts = [r["part"] for r in named.select(F.get_json_object("value", f"$.parts.{table}").alias("part")).where("part is not null").collect()]
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{table}/{p}" for p in parts])

    def stage(self, rows: DataFrame, table: str) -> str:
        """Write a part that no marker names yet; its name."""
        wanted = self.tables[table]
        shaped = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in wanted])
        part = uuid.uuid4().hex
        shaped.write.parquet(f"{self.folder}/{table}/{part}")
        return part

    def commit(self, token: str, parts: dict[str, str], response: dict) -> dict:
        """Make staged parts visible together under the token; the response that stands for it."""
        held = json.dumps({"token": token, "parts": parts, "response": response})
        fs, final = file_at(self.spark, self._marker(token))
        _, draft = file_at(self.spark, f"{self.folder}/drafts/{uuid.uuid4().hex}.json")
        out = fs.create(draft)
        out.write(bytearray(held.encode()))
        out.close()
        fs.mkdirs(final.getParent())
        # HDFS does not rename onto an existing file, so the first commit of a token wins; on stores that do, one writer at a time may use a token
        won = not fs.exists(final) and fs.rename(draft, final)
        return response if won else self.response(token)

    def append(self, token: str, tables: dict[str, DataFrame], response: dict | None = None) -> dict:
        """Commit rows of several tables under a token, unless that has been done: the response (row counts, if none is given)."""
        stored = self.response(token)
        if stored is not None:
            return stored
        parts = {t: self.stage(rows, t) for t, rows in tables.items()}
        counts = {t: self.spark.read.schema(self.tables[t]).parquet(f"{self.folder}/{t}/{p}").count() for t, p in parts.items()}
        return self.commit(token, parts, response or {"status": "success", "rows": counts})


def ingest(store: ServingStore, transactions: DataFrame, key: str | None = None, *, bank: str = "bank_imported") -> dict:
    """Append a batch of transactions and placeholders for unknown accounts, both or neither.

    Transactions that are stored already are left out, of repeated ones the
    least row stays.  A key that has been seen returns the stored response; a
    batch without a key is named by chance.  Rows that cannot be stored
    (no id, end, amount or time) raise before anything is written.
    """
    token = f"batch:{key}" if key else f"batch-{uuid.uuid4().hex}"
    stored = store.response(token) if key else None
    if stored is not None:
        return stored
    batch = cut(transactions.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in store.tables["transactions"]]), "batch")
    seen = batch.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(f.name).isNull()).alias(f.name) for f in store.tables["transactions"] if not f.nullable]).first().asDict()
    n, holes = seen.pop("n"), [c for c, k in seen.items() if k]
    if holes:
        raise ValueError(f"the batch lacks values of {holes}")
    new = serving.new_rows(batch, store.read("transactions"), "tx_id")
    accounts = serving.placeholder_accounts(batch, store.read("accounts"), bank)
    return store.append(token, {"transactions": new, "accounts": accounts}, {"status": "success", "count": n})


def _named(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.md5(F.concat_ws(":", *parts)), 1, 16))


def job_rows(scores: DataFrame, edges: DataFrame, contributing: DataFrame, attributions: DataFrame, cycles: DataFrame, stored: DataFrame, *, model_id: str, job: str, threshold: float, at: Column) -> dict[str, DataFrame]:
    """The rows of alerts, evidence, narratives and audit log that a scoring job adds; ids follow from the job and the account."""
    alerts = cut(serving.alerts_of(scores, stored, model_id=model_id, job=job, threshold=threshold).withColumn("created_at", at), "alerts")
    ids = alerts.select(F.col("account_id").alias("id"))
    own = lambda rows: rows.withColumn("id", F.col("id").cast("string")).join(ids, "id", "left_semi")
    text = edges.select("tx_id", F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), "ts")
    records = cut(explain.evidence_records(alerts.select("alert_id", "account_id", "score"), text, own(contributing), own(attributions), own(cycles)), "records")
    evidence = records.select(
        _named("evidence", F.col("alert_id")).alias("evidence_id"), "alert_id",
        F.to_json(F.struct("accounts", "transactions", "motif", "first", "last")).alias("subgraph"), F.to_json("attributions").alias("attributions"),
    )
    narratives = records.select(_named("narrative", F.col("alert_id")).alias("narrative_id"), "alert_id", explain.narrative().alias("text"), F.lit("deterministic").alias("source"))
    audit = alerts.select(
        _named("audit", F.col("alert_id"), F.lit("create")).alias("audit_id"), F.lit("system_worker").alias("actor"), F.lit("create").alias("action"), F.col("alert_id").alias("entity_id"),
        F.lit(None).cast("string").alias("old_value"), F.to_json(F.struct("account_id", F.col("score").alias("confidence_score"))).alias("new_value"), at.alias("created_at"),
    )
    return {"alerts": alerts, "evidence": evidence, "narratives": narratives, "audit_log": audit}


def scoring_job(store: ServingStore, scores: DataFrame, edges: DataFrame, contributing: DataFrame, attributions: DataFrame, cycles: DataFrame, *, model_id: str, job: str, threshold: float = 0.5, at: Column | None = None) -> dict:
    """Alerts of (account_id, score) rows with their evidence, narratives and audit rows, in one commit named by the job.

    Raises if the model is not in the store.  A repeated or restarted job
    returns what the committed one returned.
    """
    stored = store.response(f"job:{job}")
    if stored is not None:
        return stored
    if store.read("models").where(F.col("model_id") == model_id).isEmpty():
        raise ValueError(f"unknown model {model_id!r}")
    made = job_rows(scores, edges, contributing, attributions, cycles, store.read("alerts"), model_id=model_id, job=job, threshold=threshold, at=F.current_timestamp().cast("timestamp_ntz") if at is None else at)
    return store.append(f"job:{job}", made)
