"""Canonical tables, adapters, splits, features and configuration."""

import datetime as dt
import json
import time

import pytest

from tallyweft import cli, config, manifest
from tallyweft.model import TABLES, CanonicalDataset
from tallyweft.operators import features, split, validate
from tallyweft.sources import registry
from tallyweft.sources.adapters import ADAPTERS, adapter, numbered_scan

T0 = dt.datetime(2022, 9, 1)


def dataset(spark, **changed):
    rows = {
        "accounts": [("a1", "b1", T0, "{}"), ("a2", None, None, '{"age": 3}'), ("a3", "b2", T0, "{}")],
        "transactions": [("t1", "a1", "a2", 5.0, "USD", T0, "wire", "b1", None), ("t2", "a2", "a3", None, "USD", None, "wire", None, "b2")],
        "labels": [("t1", "tx", "laundering", "s"), ("a3", "account", "fraud", "s")],
        "rings": [("r1", '["a1", "a2"]', "cycle", "[null, null]")],
    } | changed
    return CanonicalDataset("ibm_aml", **{t: spark.createDataFrame(rows[t], schema) for t, schema in TABLES.items()})


def test_valid_dataset_round_trip(spark, tmp_path):
    data = validate.validate(dataset(spark))
    data.write(str(tmp_path))
    again = validate.validate(CanonicalDataset.read(spark, str(tmp_path), "ibm_aml").with_tables(**{t: spark.createDataFrame(spark.read.parquet(f"{tmp_path}/ibm_aml/{t}.parquet").collect(), s) for t, s in TABLES.items()}))
    assert again.transactions.count() == 2


@pytest.mark.parametrize(
    "table, rows, kind",
    [
        ("transactions", [("t1", "a1", "zz", 5.0, "USD", T0, "w", None, None)], validate.IntegrityError),
        ("transactions", [("t1", "a1", "a2", -5.0, "USD", T0, "w", None, None)], validate.SchemaError),
        ("accounts", [("a1", None, None, "{}"), ("a1", None, None, "{}")], validate.SchemaError),
        ("labels", [("t9", "tx", "x", "s")], validate.IntegrityError),
        ("labels", [("t1", "house", "x", "s")], validate.SchemaError),
        ("rings", [("r1", '["a1", "nobody"]', "c", "[]")], validate.IntegrityError),
    ],
)
def test_faults_raise(spark, table, rows, kind):
    with pytest.raises(kind):
        validate.validate(dataset(spark, **{table: rows}))


def test_extra_column_raises(spark):
    from pyspark.sql import functions as F

    data = dataset(spark)
    with pytest.raises(validate.SchemaError):
        validate.validate(data.with_tables(accounts=data.accounts.withColumn("more", F.lit(1))))


def test_lines_are_numbered_in_order_without_dealing_out_rows(spark, tmp_path):
    folder, key = str(tmp_path / "lines.csv"), "spark.sql.files.maxPartitionBytes"
    spark.range(20_000).repartitionByRange(3, "id").sortWithinPartitions("id").write.csv(folder)
    spark.conf.set(key, "10000")
    try:
        rows = numbered_scan(spark.read.schema("line long").csv(folder), validate.Rules(("line",), not_null=("line",), strict=True), "lines")
    finally:
        spark.conf.unset(key)
    assert rows.where("line <> ordinal").count() == 0 and rows.agg({"ordinal": "max"}).first()[0] == 19_999
    assert "hashpartitioning" not in rows._jdf.queryExecution().executedPlan().toString()


def _shuffle_files(spark):
    held = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return sum(held.apply(i).getName().startswith("shuffle_") for i in range(held.size()))


def test_tables_and_checks_leave_no_shuffle_files(spark, small):
    from tallyweft.plans import catalogue

    before = _shuffle_files(spark)
    catalogue.adapter_ibm_aml(spark, small)
    for _ in range(50):
        # removal runs beside the driver
        if _shuffle_files(spark) <= before:
            break
        time.sleep(0.2)
    assert _shuffle_files(spark) <= before


def _files(folder):
    f = folder / "elliptic"
    f.mkdir()
    (f / "elliptic_txs_features.csv").write_text("\n".join(f"{i},{1 + i % 5}," + ",".join(["0.5"] * 165) for i in range(10)) + "\n")
    (f / "elliptic_txs_classes.csv").write_text("txId,class\n" + "".join(f"{i},{('1', '2', 'unknown')[i % 3]}\n" for i in range(10)))
    (f / "elliptic_txs_edgelist.csv").write_text("txId1,txId2\n" + "".join(f"{i},{(i + 1) % 10}\n" for i in range(10)))
    f = folder / "elliptic_pp"
    f.mkdir()
    (f / "wallets_features_classes_combined.csv").write_text("address,class,num_txs\n" + "".join(f"w{i},{1 + i % 3},{i}\n" for i in range(6)))
    (f / "AddrAddr_edgelist.csv").write_text("input_address,output_address\n" + "".join(f"w{i},w{i + 1}\n" for i in range(5)))
    f = folder / "ibm_aml"
    f.mkdir()
    (f / "HI-Small_Trans.csv").write_text(
        "Timestamp,From Bank,Account,To Bank,Account,Amount Received,Receiving Currency,Amount Paid,Payment Currency,Payment Format,Is Laundering\n"
        "2022/09/01 00:20,10,A1,12,B1,1.0,US Dollar,2.0,Euro,Wire,0\n2022/09/01 00:10,12,B1,10,A1,3.0,US Dollar,3.0,US Dollar,Cheque,1\n"
    )
    f = folder / "paysim"
    f.mkdir()
    (f / "PS_20174392719_1491204439457_log.csv").write_text(
        "step,type,amount,nameOrig,oldbalanceOrg,newbalanceOrig,nameDest,oldbalanceDest,newbalanceDest,isFraud,isFlaggedFraud\n1,PAYMENT,9.5,C1,1,1,M1,0,0,0,0\n3,TRANSFER,1.5,C2,1,1,C1,0,0,1,0\n"
    )
    f = folder / "baf"
    f.mkdir()
    (f / "Base.csv").write_text("fraud_bool,customer_age,month,income\n0,30,1,0.5\n1,40,2,\n")
    f = folder / "ieee_cis"
    f.mkdir()
    (f / "train_transaction.csv").write_text("TransactionID,isFraud,TransactionDT,TransactionAmt,ProductCD,card1,card2,addr1\n1,0,60,5.0,W,7,,10\n2,1,120,6.0,C,7,3,\n3,0,180,7.0,W,,1,2\n")
    (f / "train_identity.csv").write_text("TransactionID,DeviceType\n2,mobile\n")


def test_adapters(spark, tmp_path):
    _files(tmp_path)
    got = {name: adapter(name, spark).run(f"{tmp_path}/{name}") for name in ADAPTERS}
    e = got["elliptic"]
    assert e.accounts.count() == 10 and e.labels.where("label = 'illicit'").count() == 4
    assert {r["tx_id"]: (r["src_account"], r["timestamp"]) for r in e.transactions.collect()}["elliptic_edge_3"] == ("3", dt.datetime(1970, 1, 5))
    assert json.loads(e.accounts.where("account_id = '4'").first()["attributes"])["time_step"] == 5
    ibm = {r["account_id"]: r for r in got["ibm_aml"].accounts.collect()}
    assert ibm["10_A1"]["opened_at"] == dt.datetime(2022, 9, 1, 0, 10) and ibm["10_A1"]["institution_id"] == "10"
    assert {r["tx_id"]: r["amount"] for r in got["ibm_aml"].transactions.collect()} == {"ibm_aml_0": 2.0, "ibm_aml_1": 3.0}
    assert got["paysim"].accounts.count() == 3 and got["paysim"].transactions.where("tx_id = 'paysim_1'").first()["timestamp"] == dt.datetime(1970, 1, 1, 3)
    assert got["baf"].transactions.count() == 0 and got["baf"].accounts.where("account_id = 'baf_1'").first()["opened_at"] == dt.datetime(1970, 3, 2)
    card = json.loads(got["ieee_cis"].accounts.where("account_id = 'card_7'").first()["attributes"])
    assert card == {"DeviceType": "mobile", "addr1": 10, "card2": 3}
    assert got["ieee_cis"].accounts.where("account_id = 'card_-1'").count() == 1


def test_bad_raw_file_lists_failures(spark, tmp_path):
    _files(tmp_path)
    (tmp_path / "baf" / "Base.csv").write_text("fraud_bool,month\n5,1\n,2\n")
    with pytest.raises(validate.SchemaError) as e:
        adapter("baf", spark).run(f"{tmp_path}/baf")
    assert e.value.failures.count() == 2
    wallets, edges = (tmp_path / "elliptic_pp" / f for f in ("wallets_features_classes_combined.csv", "AddrAddr_edgelist.csv"))
    held = wallets.read_text()
    wallets.write_text(held + "w0,1,9\n")
    with pytest.raises(validate.SchemaError):
        adapter("elliptic_pp", spark).load_raw(f"{tmp_path}/elliptic_pp")
    wallets.write_text(held)
    edges.write_text("input_address,output_address,value\nw0,w1,2\n")
    with pytest.raises(validate.SchemaError):
        adapter("elliptic_pp", spark).load_raw(f"{tmp_path}/elliptic_pp")
    with pytest.raises(KeyError):
        adapter("nothing", spark)


def test_fetch_report(tmp_path):
    import hashlib

    assert set(registry.on_disk(["a", "b"], str(tmp_path)).values()) == {"absent"}
    (tmp_path / "a").write_text("1")
    (tmp_path / "b").write_text("2")
    assert registry.on_disk(["a", "b"], str(tmp_path), {"b": hashlib.sha256(b"2").hexdigest()}) == {"a": "present", "b": "verified"}
    with pytest.raises(registry.ChecksumError):
        registry.on_disk(["a", "b"], str(tmp_path), {"b": "0" * 64})
    with pytest.raises(KeyError):
        registry.expected("nothing")
    assert "HI-Small" in registry.how_to_get("ibm_aml", "x") and len(registry.expected("elliptic")) == 3


def _entities(spark, n=20, **fixed):
    rows = [(f"e{i:02}", "tx", "laundering" if i % 4 == 0 else "not_laundering", T0 + dt.timedelta(days=i), None if i % 5 == 4 else f"B{i % 3}") for i in range(n)]
    return spark.createDataFrame(rows, "entity_id string, entity_type string, label string, timestamp timestamp_ntz, institution_id string")


def test_splits_are_disjoint_and_cover(spark):
    e = _entities(spark)
    for strategy in ("temporal", "random"):
        f = split.split(e, strategy)
        assert {r["fold"]: r["count"] for r in f.groupBy("fold").count().collect()} == {"train": 12, "val": 3, "test": 5}
        assert f.select("entity_id").distinct().count() == 20
    f = split.split(e, "institution", held_out="B1")
    assert f.where("fold = 'test'").select("institution_id").distinct().count() == 1
    assert f.where("institution_id is null and fold <> 'test'").count() == 4
    rows = {r["fold"]: r for r in split.fold_summary(split.split(e, "temporal"), "temporal").collect()}
    assert {k: r["entities"] for k, r in rows.items()} == {"train": 12, "val": 3, "test": 5}
    assert rows["train"]["last"] < rows["val"]["first"] and sum(rows["test"]["label_shares"].values()) == pytest.approx(1)


def test_split_errors(spark):
    e = _entities(spark)
    from pyspark.sql import functions as F

    with pytest.raises(ValueError):
        split.split(e.limit(0), "temporal")
    with pytest.raises(ValueError):
        split.split(e.withColumn("timestamp", F.lit(None).cast("timestamp_ntz")), "temporal")
    for bank in (None, "nobody"):
        with pytest.raises(ValueError):
            split.split(e, "institution", held_out=bank)
    assert split.cut_points(10, (0.25, 0.25, 0.5)) == (2, 2)


def test_pipeline_guards_and_scales(spark, tmp_path):
    m = spark.createDataFrame([("a", 1.0, 5.0), ("b", 3.0, 5.0), ("c", 9.0, 5.0)], "account_id string, x double, k double")
    ids = lambda *n: spark.createDataFrame([(i,) for i in n], "account_id string")
    with pytest.raises(ValueError, match="overlap"):
        features.FeaturePipeline().fit(m, ids("a", "b"), ids("b"))
    with pytest.raises(ValueError):
        features.FeaturePipeline().fit(m, ids("zz"))
    with pytest.raises(RuntimeError):
        features.FeaturePipeline().transform(m)
    p = features.FeaturePipeline().fit(m, ids("a", "b"), ids("c"))
    got = {r["account_id"]: (r["x"], r["k"]) for r in p.transform(m.drop("k")).collect()}
    assert got["a"] == (-1.0, -5.0) and got["c"][0] == 7.0
    p.save(str(tmp_path / "p.json"))
    assert features.FeaturePipeline.load(str(tmp_path / "p.json")).statistics == p.statistics


def test_raw_features_keep_numbers_only(spark):
    rows = [("a", '{"n": 1, "s": "x", "b": true, "d": {"q": 2.5}, "m": 1}'), ("b", '{"n": 2.5, "m": "x"}'), ("c", "{}")]
    got = {r["account_id"]: r.asDict() for r in features.raw_features(spark.createDataFrame(rows, "account_id string, attributes string")).collect()}
    assert set(got["a"]) == {"account_id", "raw_n", "raw_d_q"}
    assert got["b"]["raw_n"] == 2.5 and got["c"]["raw_n"] is None


def test_settings(tmp_path, capsys):
    s = config.load(overlay="attention", overrides={"split": {"train": 0.5, "val": 0.25, "test": 0.25}}, environ={"TALLYWEFT__MODEL__DEPTH": "3"})
    assert (s.split.train, s.model.depth, s.features.use_motif) == (0.5, 3, True)
    assert s.hash() != config.load().hash() and config.load().hash() == config.load().hash()
    for bad in ({"split": {"train": 0.9}}, {"nothing": 1}, {"features": {"scaler": "odd"}}):
        with pytest.raises(ValueError):
            config.load(overrides=bad)
    assert cli.main(["--set", "seed=7", "config-show"]) == 0 and '"seed": 7' in capsys.readouterr().out
    runs = [manifest.record(str(tmp_path), name, "h", 1) for name in ("x", "y")]
    assert manifest.recorded(str(tmp_path)) == runs and manifest.recorded(str(tmp_path / "none")) == []


def test_log_lines_are_json():
    import io

    from tallyweft.logs import logger

    out = io.StringIO()
    logger("test_lines", stream=out).info("done", extra={"rows": 3})
    line = json.loads(out.getvalue())
    assert (line["message"], line["rows"], line["level"]) == ("done", 3, "INFO")


def test_shipped_once(spark):
    from tallyweft.storage import ship

    ship(spark)
    n = spark.sparkContext._jsc.sc().listFiles().size()
    ship(spark)
    assert spark.sparkContext._jsc.sc().listFiles().size() == n
