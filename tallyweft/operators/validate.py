"""Declarative checks: each rule gives a frame of failures; one action decides."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweft.model import ENTITY_TYPES, TABLES, CanonicalDataset
from tallyweft.storage import cut_with, released


class SchemaError(ValueError):
    """Rows or columns that break a table's rules; ``failures`` is a frame of (check, column, row)."""

    def __init__(self, table: str, message: str, failures: DataFrame | None = None):
        super().__init__(f"{table}: {message}")
        self.table, self.failures = table, failures


class IntegrityError(ValueError):
    """References to missing rows; ``rows`` is a frame of the offending rows."""

    def __init__(self, message: str, rows: DataFrame | None = None):
        super().__init__(message)
        self.rows = rows


@dataclass(frozen=True)
class Rules:
    """What a table must satisfy. ``strict``: no other columns; ``casts``: columns converted first."""

    required: tuple[str, ...] = ()
    not_null: tuple[str, ...] = ()
    isin: dict[str, tuple] = field(default_factory=dict)
    at_least: dict[str, float] = field(default_factory=dict)
    unique: tuple[tuple[str, ...], ...] = ()
    strict: bool = False
    casts: dict[str, str] = field(default_factory=dict)


def coerced(df: DataFrame, rules: Rules) -> DataFrame:
    """Columns cast as the rules say; values that do not convert become null (and fail a not-null rule)."""
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in rules.casts.items() if c in df.columns})


def _broken(rules: Rules) -> Column:
    """The (check, column) pairs of the row rules that a row breaks."""
    checks: list[Column] = []

    def broken(name: str, column: str, when: Column) -> None:
        checks.append(F.when(when, F.struct(F.lit(name).alias("check"), F.lit(column).alias("column"))))

    for c in rules.not_null:
        broken("not_null", c, F.col(c).isNull())
    for c, allowed in rules.isin.items():
        broken("isin", c, F.col(c).isNotNull() & ~F.col(c).isin(*allowed))
    for c, least in rules.at_least.items():
        broken("at_least", c, F.col(c) < least)
    return F.filter(F.array(*checks), lambda x: x.isNotNull()) if checks else F.array().cast("array<struct<check:string,column:string>>")


def failures(df: DataFrame, rules: Rules) -> DataFrame:
    """(check, column, row) of every broken row: all row rules in one pass, then one aggregation per unique key."""
    row = F.to_json(F.struct(*df.columns)) if df.columns else F.lit("{}")
    out = []
    if rules.not_null or rules.isin or rules.at_least:
        out.append(df.select(F.explode(_broken(rules)).alias("f"), row.alias("row")).select("f.check", "f.column", "row"))
    for key in rules.unique:
        twice = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        out.append(twice.select(F.lit("unique").alias("check"), F.lit(",".join(key)).alias("column"), F.to_json(F.struct(*key)).alias("row")))
    if not out:
        return df.sparkSession.createDataFrame([], "check string, column string, row string")
    return reduce(DataFrame.unionByName, out)


def _columns_fit(columns: list[str], rules: Rules, table: str) -> None:
    missing = [c for c in rules.required if c not in columns]
    extra = [c for c in columns if c not in rules.required] if rules.strict else []
    if missing or extra:
        raise SchemaError(table, f"missing columns {missing}, unexpected columns {extra}")


def _raise(table: str, bad: DataFrame) -> None:
    if first := bad.limit(5).collect():
        raise SchemaError(table, "; ".join(f"{r['check']}({r['column']}) {r['row']}" for r in first), bad)


def written_scan(scan: DataFrame, rules: Rules, table: str, *more: Column) -> DataFrame:
    """A raw file's rows with their casts and the columns ``more``, written once, or SchemaError with all failures.

    The row rules are counted while the rows are written, so the raw file is
    read in one pass; rows and unique keys are looked at in what was written.
    """
    _columns_fit(scan.columns, rules, table)
    rows, (bad,) = cut_with(coerced(scan.select("*", *more), rules), "scan", F.count_if(F.size(_broken(rules)) > 0))
    own = rows.select(*scan.columns)
    if bad:
        _raise(table, failures(own, rules))
    if rules.unique:
        _raise(table, failures(own, Rules(unique=rules.unique)))
    return rows


def check(df: DataFrame, rules: Rules, table: str) -> DataFrame:
    """The table with its casts, or SchemaError with all failures."""
    _columns_fit(df.columns, rules, table)
    df = coerced(df, rules)
    _raise(table, failures(df, rules))
    return df


def _canonical(table: str, **more) -> Rules:
    schema = TABLES[table]
    return Rules(required=tuple(schema.fieldNames()), not_null=tuple(f.name for f in schema if not f.nullable), strict=True, **more)


CANONICAL = {
    "accounts": _canonical("accounts", unique=(("account_id",),)),
    "transactions": _canonical("transactions", unique=(("tx_id",),), at_least={"amount": 0.0}),
    "labels": _canonical("labels", unique=(("entity_id", "entity_type", "label_source"),), isin={"entity_type": ENTITY_TYPES}),
    "rings": _canonical("rings", unique=(("ring_id",),)),
}


def check_types(df: DataFrame, table: str) -> None:
    """Canonical tables are not cast: a column of another type is an error."""
    wrong = [f"{f.name}: {df.schema[f.name].dataType.simpleString()}" for f in TABLES[table] if f.name in df.columns and df.schema[f.name].dataType != f.dataType]
    if wrong:
        raise SchemaError(table, f"wrong types {wrong}")


def orphans(rows: DataFrame, column: str, targets: DataFrame, key: str) -> DataFrame:
    """Rows whose ``column`` is not among ``targets.key``."""
    return rows.join(targets.select(F.col(key).alias(column)).distinct(), column, "left_anti")


def label_orphans(data: CanonicalDataset) -> DataFrame:
    """Labels whose entity does not exist: one anti-join on (type, id)."""
    keys = data.transactions.select(F.lit("tx").alias("entity_type"), F.col("tx_id").alias("entity_id"))
    keys = keys.unionByName(data.accounts.select(F.lit("account").alias("entity_type"), F.col("account_id").alias("entity_id")))
    keys = keys.unionByName(data.rings.select(F.lit("ring").alias("entity_type"), F.col("ring_id").alias("entity_id")))
    return data.labels.join(keys, ["entity_type", "entity_id"], "left_anti")


def ring_orphans(data: CanonicalDataset) -> DataFrame:
    """(ring_id, unknown): each ring's members that are no accounts, in order."""
    members = data.rings.select("ring_id", F.explode(F.from_json("member_accounts", T.ArrayType(T.StringType()))).alias("account_id"))
    missing = members.join(data.accounts.select("account_id").distinct(), "account_id", "left_anti")
    return missing.groupBy("ring_id").agg(F.sort_array(F.collect_set("account_id")).alias("unknown"))


def validate(data: CanonicalDataset) -> CanonicalDataset:
    """Schemas first, then references; the first kind of failure raises."""
    with released(data.transactions.sparkSession):
        return _validated(data)


def _validated(data: CanonicalDataset) -> CanonicalDataset:
    for t, df in data.tables().items():
        check_types(df, t)
        check(df, CANONICAL[t], t)
    for side in ("src_account", "dst_account"):
        # accounts are looked up, not rows: whole rows are dealt out only to show what is wrong with them
        if first := orphans(data.transactions.select(side).distinct(), side, data.accounts, "account_id").limit(5).collect():
            raise IntegrityError(f"{side} without account: {[r[side] for r in first]}", orphans(data.transactions, side, data.accounts, "account_id"))
    bad = label_orphans(data)
    if first := bad.limit(5).collect():
        raise IntegrityError(f"labels without entity: {[(r['entity_type'], r['entity_id']) for r in first]}", bad)
    bad = ring_orphans(data)
    if first := bad.orderBy("ring_id").limit(5).collect():
        raise IntegrityError(f"rings with unknown members: {[(r['ring_id'], r['unknown']) for r in first]}", bad)
    return data


def shared_ids(train: DataFrame, held_out: DataFrame, key: str) -> DataFrame:
    """The ids that are on both sides."""
    return train.select(key).intersect(held_out.select(key))


def assert_disjoint(train: DataFrame, held_out: DataFrame, key: str) -> None:
    """Raise if an id is on both sides; the message lists the first five."""
    both = [r[key] for r in shared_ids(train, held_out, key).orderBy(key).limit(5).collect()]
    if both:
        raise ValueError(f"training and held-out ids overlap: {both}")


def payload_faults(rows: DataFrame, *, positive: tuple[str, ...] = ("amount",), required: tuple[str, ...] = (), least_length: dict[str, int] | None = None) -> DataFrame:
    """The rows with ``faults``, an array of what is wrong with each (empty: accept)."""
    checks = [F.when(~(F.coalesce(F.col(c), F.lit(0.0)) > 0), F.lit(f"{c} must be positive")) for c in positive]
    checks += [F.when(F.col(c).isNull(), F.lit(f"{c} is required")) for c in required]
    checks += [F.when(F.coalesce(F.length(c), F.lit(0)) < n, F.lit(f"{c} is shorter than {n}")) for c, n in (least_length or {}).items()]
    return rows.withColumn("faults", F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>"))
