"""Raw files of six public datasets, mapped onto the canonical tables.

Every adapter reads with an explicit schema where the columns are fixed, and
infers types only where a source is open.  Row numbers that become ids follow
the order of the file's lines.
"""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweft.functions.scalar import sorted_json
from tallyweft.model import TABLES, CanonicalDataset, empty
from tallyweft.operators.validate import Rules, validate, written_scan
from tallyweft.storage import cut


def _after_epoch(unit: str, n: Column) -> Column:
    return F.timestamp_add(unit, n.cast("int"), F.lit("1970-01-01").cast("timestamp_ntz"))


def numbered_scan(scan: DataFrame, rules: Rules, table: str, name: str = "ordinal") -> DataFrame:
    """A file scan's checked rows, numbered from 0 in order of the files' lines.

    The raw file is read once, and its rows are not dealt out.  A block of a
    file is read by one task from its first row to its last, so Spark's
    increasing ids run on within it; what to add to them comes from the counts
    of the blocks before it.
    """
    block = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    rows = written_scan(scan, rules, table, block.alias("_block"), F.monotonically_increasing_id().alias("_at"))
    sizes = rows.groupBy("_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_from"))
    shift = cut(sizes.select("_block", (F.sum("_n").over(W.orderBy("_block")) - F.col("_n") - F.col("_from")).alias("_shift")), "blocks")
    return rows.join(F.broadcast(shift), "_block").withColumn(name, F.col("_at") + F.col("_shift")).drop("_block", "_at", "_shift")


def _shaped(df: DataFrame, table: str) -> DataFrame:
    """Columns in canonical order and type; columns the source lacks are null."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in TABLES[table]])


def _labels(df: DataFrame, entity: Column, kind: str, label: Column, source: str) -> DataFrame:
    return df.select(entity.cast("string").alias("entity_id"), F.lit(kind).alias("entity_type"), label.alias("label"), F.lit(source).alias("label_source"))


class Adapter(ABC):
    """load_raw reads and checks files, to_canonical maps them; run does both and validates."""

    name: str

    def __init__(self, spark: SparkSession):
        self.spark = spark

    @abstractmethod
    def load_raw(self, folder: str) -> dict[str, DataFrame]: ...

    @abstractmethod
    def to_canonical(self, raw: dict[str, DataFrame]) -> CanonicalDataset: ...

    def run(self, folder: str) -> CanonicalDataset:
        return validate(self.to_canonical(self.load_raw(folder)))

    def csv(self, path: str, schema: T.StructType | str | None = None, header: bool = True) -> DataFrame:
        reader = self.spark.read.option("header", header)
        return (reader.schema(schema) if schema is not None else reader.option("inferSchema", True)).csv(path)

    def dataset(self, accounts: DataFrame, transactions: DataFrame, labels: DataFrame) -> CanonicalDataset:
        return CanonicalDataset(self.name, _shaped(accounts, "accounts"), _shaped(transactions, "transactions"), _shaped(labels, "labels"), empty(self.spark, "rings"))


class Elliptic(Adapter):
    name = "elliptic"
    FEATURES = [f"feat_{i}" for i in range(1, 167)]
    CLASSES = {"1": "illicit", "2": "licit", "unknown": "unknown"}

    def load_raw(self, folder: str) -> dict[str, DataFrame]:
        schema = "txId long, " + ", ".join(f"{c} double" for c in self.FEATURES)
        features = written_scan(self.csv(f"{folder}/elliptic_txs_features.csv", schema, header=False), Rules(("txId", *self.FEATURES), not_null=("txId", "feat_1"), unique=(("txId",),), strict=True), "elliptic_txs_features.csv")
        classes = written_scan(self.csv(f"{folder}/elliptic_txs_classes.csv", "txId long, class string"), Rules(("txId", "class"), not_null=("txId", "class"), isin={"class": tuple(self.CLASSES)}, unique=(("txId",),), strict=True), "elliptic_txs_classes.csv")
        edges = self.csv(f"{folder}/elliptic_txs_edgelist.csv", "txId1 long, txId2 long")
        edges = numbered_scan(edges, Rules(("txId1", "txId2"), not_null=("txId1", "txId2"), strict=True), "elliptic_txs_edgelist.csv")
        return {"features": features, "classes": classes, "edges": edges}

    def to_canonical(self, raw: dict[str, DataFrame]) -> CanonicalDataset:
        step = F.col("feat_1").cast("int")
        accounts = raw["features"].select(F.col("txId").cast("string").alias("account_id"), _after_epoch("DAY", step).alias("opened_at"), sorted_json(("time_step", step), *self.FEATURES).alias("attributes"))
        steps = raw["features"].select(F.col("txId").alias("txId1"), step.alias("step"))
        transactions = raw["edges"].join(steps, "txId1", "left").select(
            F.concat(F.lit("elliptic_edge_"), F.col("ordinal").cast("string")).alias("tx_id"), F.col("txId1").alias("src_account"), F.col("txId2").alias("dst_account"),
            F.lit("unknown").alias("currency"), _after_epoch("DAY", F.col("step")).alias("timestamp"), F.lit("unknown").alias("channel"),
        )
        kind = F.create_map(*[F.lit(x) for p in self.CLASSES.items() for x in p])
        return self.dataset(accounts, transactions, _labels(raw["classes"], F.col("txId"), "account", kind[F.col("class")], "elliptic_txs_classes"))


class EllipticActors(Adapter):
    name = "elliptic_pp"
    CLASSES = {1: "illicit", 2: "licit", 3: "unknown"}

    def load_raw(self, folder: str) -> dict[str, DataFrame]:
        wallets = written_scan(self.csv(f"{folder}/wallets_features_classes_combined.csv"), Rules(("address", "class"), not_null=("address", "class"), isin={"class": tuple(self.CLASSES)}, unique=(("address",),), casts={"class": "int", "address": "string"}), "wallets_features_classes_combined.csv")
        edges = self.spark.read.option("header", True).csv(f"{folder}/AddrAddr_edgelist.csv")
        edges = numbered_scan(edges, Rules(("input_address", "output_address"), not_null=("input_address", "output_address"), strict=True), "AddrAddr_edgelist.csv")
        return {"wallets": wallets, "edges": edges}

    def to_canonical(self, raw: dict[str, DataFrame]) -> CanonicalDataset:
        others = [c for c in raw["wallets"].columns if c not in ("address", "class")]
        wallets = raw["wallets"].select("address", "class", (sorted_json(*others) if others else F.lit("{}")).alias("attributes"))
        accounts = wallets.select(F.col("address").alias("account_id"), "attributes")
        transactions = raw["edges"].select(F.concat(F.lit("elliptic_pp_edge_"), F.col("ordinal").cast("string")).alias("tx_id"), F.col("input_address").alias("src_account"), F.col("output_address").alias("dst_account"), F.lit("unknown").alias("currency"), F.lit("unknown").alias("channel"))
        kind = F.create_map(*[F.lit(x) for p in self.CLASSES.items() for x in p])
        return self.dataset(accounts, transactions, _labels(wallets, F.col("address"), "account", kind[F.col("class")], "wallets_classes"))


class IbmAml(Adapter):
    name = "ibm_aml"
    #: The header names Account twice; the schema is by position.
    SCHEMA = "ts string, from_bank string, from_account string, to_bank string, to_account string, received double, receiving_currency string, paid double, payment_currency string, payment_format string, laundering int"

    def load_raw(self, folder: str) -> dict[str, DataFrame]:
        scan = self.spark.read.option("header", True).option("enforceSchema", True).schema(self.SCHEMA).csv(f"{folder}/HI-Small_Trans.csv")
        known = tuple(c.split()[0] for c in self.SCHEMA.split(", "))
        rules = Rules(known, not_null=("ts", "from_bank", "from_account", "to_bank", "to_account", "payment_format", "laundering"), isin={"laundering": (0, 1)}, at_least={"paid": 0.0, "received": 0.0}, strict=True)
        return {"transactions": numbered_scan(scan, rules, "HI-Small_Trans.csv")}

    def to_canonical(self, raw: dict[str, DataFrame]) -> CanonicalDataset:
        key = lambda side: F.concat(f"{side}_bank", F.lit("_"), f"{side}_account")
        t = raw["transactions"].withColumns({"src": key("from"), "dst": key("to"), "at": F.try_to_timestamp("ts", F.lit("yyyy/MM/dd HH:mm")).cast("timestamp_ntz"), "tx_id": F.concat(F.lit("ibm_aml_"), F.col("ordinal").cast("string"))})
        ends = t.select(F.explode(F.array(F.struct(F.col("src").alias("account_id"), F.col("from_bank").alias("bank"), "at"), F.struct(F.col("dst").alias("account_id"), F.col("to_bank").alias("bank"), "at"))).alias("x")).select("x.*")
        # the bank is a prefix of the id, so any row's bank is the account's
        accounts = cut(ends.groupBy("account_id").agg(F.first("bank").alias("institution_id"), F.min("at").alias("opened_at")), "accounts").withColumn("attributes", F.lit("{}"))
        transactions = t.select("tx_id", F.col("src").alias("src_account"), F.col("dst").alias("dst_account"), F.col("paid").alias("amount"), F.col("payment_currency").alias("currency"), F.col("at").alias("timestamp"), F.col("payment_format").alias("channel"), F.col("from_bank").alias("institution_src"), F.col("to_bank").alias("institution_dst"))
        return self.dataset(accounts, transactions, _labels(t, F.col("tx_id"), "tx", F.when(F.col("laundering") == 1, "laundering").otherwise("not_laundering"), "is_laundering"))


class Paysim(Adapter):
    name = "paysim"
    FILE = "PS_20174392719_1491204439457_log.csv"

    def load_raw(self, folder: str) -> dict[str, DataFrame]:
        needed = {"step": "int", "type": "string", "amount": "double", "nameOrig": "string", "nameDest": "string", "isFraud": "int"}
        scan = self.csv(f"{folder}/{self.FILE}")
        rules = Rules(tuple(needed), not_null=tuple(needed), isin={"isFraud": (0, 1)}, at_least={"step": 0, "amount": 0.0}, casts=needed)
        return {"transactions": numbered_scan(scan, rules, self.FILE)}

    def to_canonical(self, raw: dict[str, DataFrame]) -> CanonicalDataset:
        # balances and the flag are left out: they give the label away
        t = raw["transactions"].withColumn("tx_id", F.concat(F.lit("paysim_"), F.col("ordinal").cast("string")))
        accounts = t.select(F.explode(F.array("nameOrig", "nameDest")).alias("account_id")).distinct().withColumn("attributes", F.lit("{}"))
        transactions = t.select("tx_id", F.col("nameOrig").alias("src_account"), F.col("nameDest").alias("dst_account"), "amount", F.lit("unknown").alias("currency"), _after_epoch("HOUR", F.col("step")).alias("timestamp"), F.col("type").alias("channel"))
        return self.dataset(accounts, transactions, _labels(t, F.col("tx_id"), "tx", _fraud("isFraud"), "isFraud"))


def _fraud(column: str) -> Column:
    return F.when(F.col(column) == 1, "fraud").otherwise("not_fraud")


class Baf(Adapter):
    name = "baf"

    def load_raw(self, folder: str) -> dict[str, DataFrame]:
        scan = self.csv(f"{folder}/Base.csv")
        rules = Rules(("fraud_bool", "month"), not_null=("fraud_bool", "month"), isin={"fraud_bool": (0, 1)}, at_least={"month": 0}, casts={"fraud_bool": "int", "month": "int"})
        return {"applications": numbered_scan(scan, rules, "Base.csv")}

    def to_canonical(self, raw: dict[str, DataFrame]) -> CanonicalDataset:
        a = raw["applications"].withColumn("account_id", F.concat(F.lit("baf_"), F.col("ordinal").cast("string")))
        others = [c for c in raw["applications"].columns if c not in ("fraud_bool", "ordinal")]
        accounts = a.select("account_id", _after_epoch("DAY", F.col("month") * 30).alias("opened_at"), sorted_json(*others).alias("attributes"))
        return self.dataset(accounts, empty(self.spark, "transactions"), _labels(a, F.col("account_id"), "account", _fraud("fraud_bool"), "fraud_bool"))


class IeeeCis(Adapter):
    name = "ieee_cis"
    #: The columns that describe a card.
    CARD = ("card2", "card3", "card4", "card5", "card6", "addr1", "addr2", "dist1", "dist2", "P_emaildomain", "R_emaildomain", "DeviceType", "DeviceInfo")

    def load_raw(self, folder: str) -> dict[str, DataFrame]:
        needed = {"TransactionID": "long", "isFraud": "int", "TransactionDT": "int", "TransactionAmt": "double", "ProductCD": "string"}
        scan = self.csv(f"{folder}/train_transaction.csv")
        rules = Rules(tuple(needed), not_null=tuple(needed), isin={"isFraud": (0, 1)}, at_least={"TransactionDT": 0, "TransactionAmt": 0.0}, unique=(("TransactionID",),), casts=needed)
        identity = written_scan(self.csv(f"{folder}/train_identity.csv"), Rules(("TransactionID",), not_null=("TransactionID",), unique=(("TransactionID",),), casts={"TransactionID": "long"}), "train_identity.csv")
        return {"transactions": numbered_scan(scan, rules, "train_transaction.csv"), "identity": identity}

    def to_canonical(self, raw: dict[str, DataFrame]) -> CanonicalDataset:
        t = raw["transactions"].join(raw["identity"], "TransactionID", "left")
        card = F.coalesce(F.col("card1").cast("double").cast("long"), F.lit(-1)).cast("string") if "card1" in t.columns else F.lit("-1")
        t = t.withColumns({"src": F.concat(F.lit("card_"), card), "dst": F.concat(F.lit("merchant_"), "ProductCD"), "tx_id": F.col("TransactionID").cast("string")})
        present = [c for c in self.CARD if c in t.columns]
        # of each column the first known value of the card, by line
        first = [F.min_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col("ordinal"))).alias(c) for c in present]
        cards = t.groupBy("src").agg(*first, F.count(F.lit(1)).alias("_n")).select(F.col("src").alias("account_id"), (sorted_json(*present) if present else F.lit("{}")).alias("attributes"))
        merchants = t.select(F.col("dst").alias("account_id")).distinct().withColumn("attributes", F.lit("{}"))
        transactions = t.select("tx_id", F.col("src").alias("src_account"), F.col("dst").alias("dst_account"), F.col("TransactionAmt").alias("amount"), F.lit("USD").alias("currency"), _after_epoch("SECOND", F.col("TransactionDT")).alias("timestamp"), F.col("ProductCD").alias("channel"))
        return self.dataset(cards.unionByName(merchants), transactions, _labels(t, F.col("tx_id"), "tx", _fraud("isFraud"), "isFraud"))


ADAPTERS: dict[str, type[Adapter]] = {a.name: a for a in (Elliptic, EllipticActors, IbmAml, Paysim, Baf, IeeeCis)}


def adapter(name: str, spark: SparkSession) -> Adapter:
    if name not in ADAPTERS:
        raise KeyError(f"unknown dataset {name!r}; known: {sorted(ADAPTERS)}")
    return ADAPTERS[name](spark)
