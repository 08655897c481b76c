"""Canonical and serving schemas, and the canonical dataset of lazy frames."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_S, _D, _TS = T.StringType(), T.DoubleType(), T.TimestampNTZType()


def _schema(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


ACCOUNTS = _schema(("account_id", _S, False), ("institution_id", _S, True), ("opened_at", _TS, True), ("attributes", _S, False))
TRANSACTIONS = _schema(
    ("tx_id", _S, False), ("src_account", _S, False), ("dst_account", _S, False), ("amount", _D, True), ("currency", _S, False),
    ("timestamp", _TS, True), ("channel", _S, False), ("institution_src", _S, True), ("institution_dst", _S, True),
)
LABELS = _schema(("entity_id", _S, False), ("entity_type", _S, False), ("label", _S, False), ("label_source", _S, False))
RINGS = _schema(("ring_id", _S, False), ("member_accounts", _S, False), ("pattern_type", _S, False), ("time_window", _S, False))
TABLES = {"accounts": ACCOUNTS, "transactions": TRANSACTIONS, "labels": LABELS, "rings": RINGS}
ENTITY_TYPES = ("tx", "account", "ring")

#: The serving tables: columns in order; the first is the key.
SERVING = {
    "accounts": _schema(("account_id", _S, False), ("bank_id", _S, False), ("features", _S, True)),
    "transactions": _schema(("tx_id", _S, False), ("src_account", _S, False), ("dst_account", _S, False), ("amount", _D, False), ("timestamp", _TS, False)),
    "runs": _schema(("run_id", _S, False), ("config_hash", _S, True), ("metrics", _S, True), ("created_at", _TS, True)),
    "models": _schema(("model_id", _S, False), ("run_id", _S, False), ("name", _S, False), ("path", _S, True)),
    "alerts": _schema(("alert_id", _S, False), ("account_id", _S, False), ("model_id", _S, False), ("score", _D, False), ("status", _S, False), ("created_at", _TS, True)),
    "evidence": _schema(("evidence_id", _S, False), ("alert_id", _S, False), ("subgraph", _S, True), ("attributions", _S, True)),
    "narratives": _schema(("narrative_id", _S, False), ("alert_id", _S, False), ("text", _S, False), ("source", _S, True)),
    "reviews": _schema(("review_id", _S, False), ("alert_id", _S, False), ("reviewer", _S, False), ("decision", _S, False), ("reason", _S, False), ("created_at", _TS, True)),
    "audit_log": _schema(("audit_id", _S, False), ("actor", _S, False), ("action", _S, False), ("entity_id", _S, True), ("old_value", _S, True), ("new_value", _S, True), ("created_at", _TS, True)),
}


@dataclass(frozen=True)
class CanonicalDataset:
    """Four lazy tables and a name."""

    name: str
    accounts: DataFrame
    transactions: DataFrame
    labels: DataFrame
    rings: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {t: getattr(self, t) for t in TABLES}

    def with_tables(self, **tables: DataFrame) -> CanonicalDataset:
        return replace(self, **tables)

    def write(self, folder: str, mode: str = "overwrite") -> None:
        """Each table as Parquet at <folder>/<name>/<table>.parquet."""
        for t, df in self.tables().items():
            df.write.mode(mode).parquet(f"{folder}/{self.name}/{t}.parquet")

    @classmethod
    def read(cls, spark: SparkSession, folder: str, name: str) -> CanonicalDataset:
        return cls(name, **{t: spark.read.parquet(f"{folder}/{name}/{t}.parquet") for t in TABLES})


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[table])
