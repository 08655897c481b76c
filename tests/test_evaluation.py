"""Metrics, audits, the federated plane, evidence, serving, detectors and flows."""

import datetime as dt
import hashlib
import hmac
import json
import math
import random
import time

import pytest
from pyspark.sql import functions as F

from tallyweft import config
from tallyweft.functions import scalar
from tallyweft.model import TABLES, CanonicalDataset
from tallyweft.operators import audit, commits, detectors, explain, federated, metrics, serving
from tallyweft.plans import catalogue, flows

T0 = dt.datetime(2022, 9, 1)


def scored(spark, labels, scores):
    return spark.createDataFrame([(i, y, float(s)) for i, (y, s) in enumerate(zip(labels, scores, strict=True))], "id long, label int, score double")


def test_separated_scores(spark):
    s = scored(spark, [1] * 3 + [0] * 7, [0.9, 0.8, 0.7] + [0.1] * 7)
    m = metrics.threshold_metrics(s).first()
    assert (m["precision"], m["recall"], m["f1"], m["total_alerts"]) == (1.0, 1.0, 1.0, 3)
    assert metrics.roc_auc(s).first()[0] == 1.0 and metrics.average_precision(s).first()[0] == 1.0
    assert metrics.recall_at_budget(s, 1).first()["recall"] == pytest.approx(1 / 3)
    assert {r["k"]: (r["k_used"], r["precision"]) for r in metrics.precision_at_k(s, [2, 100, 0]).collect()} == {2: (2, 1.0), 100: (10, 0.3), 0: (0, None)}
    sweep = metrics.threshold_sweep(s).collect()
    assert len(sweep) == 19 and max(r["total_alerts"] for r in sweep) == 10


def test_undefined_metrics(spark):
    s = scored(spark, [0, 0], [0.1, 0.2])
    m = metrics.threshold_metrics(s).first()
    assert (m["precision"], m["false_alert_fraction"]) == (0.0, None)
    assert metrics.roc_auc(s).first()[0] is None and metrics.recall_at_budget(s, 1).first()["recall"] is None
    with pytest.raises(ValueError):
        metrics.require_two_classes(s)


def test_auc_with_ties_equals_pair_count(spark):
    rng = random.Random(4)
    y, x = [rng.random() < 0.4 for _ in range(80)], [rng.randint(0, 9) / 10 for _ in range(80)]
    pairs = [(a > b) + (a == b) / 2 for a, p in zip(x, y, strict=True) for b, q in zip(x, y, strict=True) if p and not q]
    assert metrics.roc_auc(scored(spark, map(int, y), x)).first()[0] == pytest.approx(sum(pairs) / len(pairs))


def test_psi_levels(spark):
    rng = random.Random(1)
    frame = lambda mean: spark.createDataFrame([(rng.gauss(mean, 1),) for _ in range(1000)], "x double")
    base = frame(0)
    assert audit.input_drift(base, frame(0)).first()["psi"] < 0.1
    assert audit.input_drift(base, frame(2)).first()["level"] == "significant"
    constant = spark.createDataFrame([(1.0,)] * 5, "x double")
    assert audit.input_drift(constant, base).first()["psi"] == 0.0


def test_bias(spark):
    rows = [(0, 1, 0.9, "a"), (1, 0, 0.9, "a"), (2, 1, 0.9, "b"), (3, 0, 0.1, "b")]
    s = spark.createDataFrame(rows, "id int, label int, score double, g string")
    b = audit.bias_audit(s, "g").first()
    assert (b["demographic_parity"], b["equalized_odds"], b["n_groups"]) == (0.5, 1.0, 2)
    assert audit.bias_audit(s.where("g = 'a'"), "g").first()["demographic_parity"] == 0.0


def test_evasion_keeps_sums(spark):
    t = spark.createDataFrame([("t1", "a", "b", 100.0, "USD", T0, "w", None, None), ("t2", "b", "a", 7.0, "USD", T0, "w", None, None)], TABLES["transactions"])
    ring = t.where("tx_id = 't1'").select("tx_id")
    halves = audit.evade_split(t, ring)
    assert halves.agg(F.sum("amount")).first()[0] == 107.0 and halves.count() == 3
    assert audit.evade_delay(t, ring).where("tx_id = 't1'").first()["timestamp"] == T0 + dt.timedelta(days=2)
    hops = {r["tx_id"]: (r["src_account"], r["dst_account"]) for r in audit.evade_mule(t, ring).collect()}
    assert hops == {"t1_hop1": ("a", "mule_t1"), "t1_hop2": ("mule_t1", "b"), "t2": ("b", "a")}
    score = lambda tx: tx.groupBy(F.col("src_account").alias("account_id")).agg(F.max(F.col("amount") / 100).alias("score"))
    r = {x["level"]: x["recall"] for x in audit.evasion_recall(t, ring, spark.createDataFrame([("a",)], "account_id string"), score, 0.8).collect()}
    assert r == {0: 1.0, 1: 0.0, 2: 1.0, 3: 1.0}


def test_hashes_equal_python(spark):
    x = spark.createDataFrame([("abc",), ("",), ("é",)], "x string")
    for key in ("k", "long" * 30):
        got = {r[0]: (r[1], r[2]) for r in x.select("x", scalar.hmac_sha256(F.col("x"), key), scalar.md5_mod(F.col("x"), 1000)).collect()}
        for t, (mac, mod) in got.items():
            assert mac == hmac.new(key.encode(), t.encode(), hashlib.sha256).hexdigest()
            assert mod == int(hashlib.md5(t.encode()).hexdigest(), 16) % 1000


def test_privacy(spark):
    eps = {r["steps"]: r["epsilon"] for r in federated.rdp_epsilon(spark.range(4).withColumnRenamed("id", "steps")).collect()}
    assert eps[0] == 0 and eps[1] == pytest.approx(4.778, abs=1e-3) and eps[3] == pytest.approx(8.796, abs=1e-3)
    with pytest.raises(ValueError):
        federated.rdp_epsilon(spark.range(1), delta=0)
    m = federated.masks(spark.range(5).withColumnRenamed("id", "client"), 8).collect()
    assert [sum(v) for v in zip(*[r["mask"] for r in m], strict=True)] == [0] * 8
    v = spark.range(1).select(F.array(F.lit(3.0), F.lit(4.0)).alias("v"))
    assert v.select(federated.l2(federated.clipped(F.col("v"), 1.0))).first()[0] <= 1
    noise = spark.range(4000).select(federated.gaussian(F.col("id")).alias("g")).agg(F.avg("g"), F.stddev("g")).first()
    assert abs(noise[0]) < 0.1 and abs(noise[1] - 1) < 0.1


def test_masked_sum_equals_plain_sum(spark):
    u = spark.createDataFrame([(c, c + 1, [0.5 * c, 1.0, -c / 4]) for c in range(3)], "client int, n long, weights array<double>")
    m = federated.masked_updates(u, federated.masks(u.select("client"), 3, 9))
    total = [sum(v) / 65536 / 6 for v in zip(*[r["masked"] for r in m.collect()], strict=True)]
    plain = [r["value"] for r in federated.fedavg(u).orderBy("pos").collect()]
    assert total == pytest.approx(plain, abs=1e-4)


def test_boundary_accounts(spark):
    from tallyweft.operators.graph import boundary_accounts

    e = spark.createDataFrame([("a1", "pseudo_x"), ("a2", "a3"), ("pseudo_y", "a5"), ("pseudo_x", "pseudo_y")], "src string, dst string")
    assert {r["id"] for r in boundary_accounts(e).collect()} == {"a1", "a5"}


def test_segments_are_compared_by_counts_of_equal_rows(spark, small):
    rng = random.Random(3)
    rows = [(m, i, rng.randrange(2), rng.randrange(6) / 5, rng.choice(["x", "y", None])) for i in range(300) for m in "ab"]
    s = spark.createDataFrame(rows, "model string, id long, label int, score double, segment string")
    got = {(r["model"], r["segment"]): r for r in metrics.segment_comparison(s).collect()}
    assert set(got) == {(m, g) for m in "ab" for g in ("overall", "x", "y", "isolated")}
    for (m, g), r in got.items():
        own = [(y, p) for model, _, y, p, k in rows if model == m and g in ("overall", k or "isolated")]
        pos, neg = [p for y, p in own if y], [p for y, p in own if not y]
        assert (r["n_samples"], r["n_positive"], r["total_alerts"]) == (len(own), len(pos), sum(p >= 0.5 for _, p in own))
        assert r["auc"] == pytest.approx(sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg)))
    parted = metrics.segment_comparison(s.select("model", "id", "label", "score"), s.where("model = 'a' and segment is not null").select("id", "segment"))
    assert parted.count() == 8
    # the tables are read once, while the counts are written
    assert not [f for f in catalogue.QUERIES["segment_comparison"](spark, small).inputFiles() if "lineitem" in f]


def test_evidence(spark):
    e = spark.createDataFrame([(1, "a", "t", 5.0, T0), (2, "b", "t", 0.0, T0), (3, "x", "y", 9.0, T0)], "tx_id long, src string, dst string, amount double, ts timestamp_ntz")
    score = lambda rows: rows.groupBy("variant", F.col("dst").alias("id")).agg((F.sum("amount") / 10).alias("score"))
    got = explain.edge_ablation(e, "t", 1, score).collect()
    assert [(r["tx_id"], r["effect"]) for r in got] == [(1, 0.5)]
    x = spark.createDataFrame([(1, 4.0)], "id long, f double")
    logistic = lambda v: 1 / (1 + F.exp(-(v - 2)))
    near, far = (explain.counterfactual(x, "f", logistic, smallest=s).first() for s in (True, False))
    assert near["reduction"] == pytest.approx(2.2) and far["value"] == 0.0
    none = explain.counterfactual(x, "f", lambda v: F.lit(0.9)).first()
    assert not none["found"]


def test_narrative(spark):
    row = ("AL_1", "A1", 0.5, None, None, ["A2", "A1"], [], None, [("x", 0.25), ("y", 0.75)])
    e = spark.createDataFrame([row], "alert_id string, account_id string, confidence double, first string, last string, accounts array<string>, transactions array<string>, motif string, attributions array<struct<feature:string,share:double>>")
    text = e.select(explain.narrative()).first()[0]
    assert text == "Alert AL_1 generated for account A1 with confidence score 0.5000. Contributing accounts involved: A1, A2. The primary model feature attributions driving this alert are: y (75.00%), x (25.00%)."
    ok = lambda t, w: e.select(explain.narrative_valid(F.lit(t), F.array(F.lit("A1")), w)).first()[0]
    day = F.array(F.lit("2022-09-01T00:00:00"))
    assert ok("A1 on 2022-09-01", day) and not ok("A9", day) and not ok("A1 on 2022-09-02", day)


def test_evidence_lists_are_whole(spark):
    e = spark.range(2500).select(F.col("id").alias("tx_id"), F.lit("a").alias("src"), F.concat(F.lit("b"), F.col("id") % 1300).alias("dst"), F.lit(T0).cast("timestamp_ntz").alias("ts"))
    alerts = spark.createDataFrame([("AL_a", "a", 0.9)], "alert_id string, account_id string, score double")
    own, none = e.select(F.col("src").alias("id"), "tx_id"), spark.createDataFrame([], "id string, feature string, share double")
    whole, part = (explain.evidence_records(alerts, e, own.unionByName(own), none, none, *most).first() for most in ([], [7]))
    assert whole["transactions"] == sorted(map(str, range(2500))) and whole["accounts"] == sorted(["a", *[f"b{i}" for i in range(1300)]])
    assert part["transactions"] == sorted(map(str, range(7))) and part["accounts"] == ["a", *[f"b{i}" for i in range(7)]]
    rows = {n: explain.evidence_edges(alerts, own, e, *n).orderBy("place").collect() for n in ((), (7,))}
    assert [(r["place"], r["tx_id"]) for r in rows[()]] == [(i + 1, i) for i in range(2500)] and rows[(7,)] == rows[()][:7]


def test_long_narratives_are_looked_up_in_proportion(spark):
    n = 150_000
    e = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("T"), i.cast("string"))).alias("known"))
    e = e.select("known", F.array_join(F.reverse("known"), ", ").alias("text"))
    start = time.perf_counter()
    got = e.select(explain.narrative_valid(F.col("text"), F.col("known"), F.array().cast("array<string>")), explain.narrative_valid(F.concat("text", F.lit(" Z999")), F.col("known"), F.array().cast("array<string>"))).first()
    assert tuple(got) == (True, False)
    # a scan of the list for each name takes billions of comparisons
    assert time.perf_counter() - start < 30


def test_serving(spark):
    a = serving.alerts_of(spark.createDataFrame([("x", 0.9), ("y", 0.1)], "account_id string, score double"), spark.createDataFrame([], "alert_id string"), model_id="m", job="j")
    assert a.count() == 1
    again = serving.alerts_of(spark.createDataFrame([("x", 0.9)], "account_id string, score double"), a, model_id="m", job="j")
    assert again.count() == 0
    faults = serving.review_faults(spark.createDataFrame([("confirm", "because", "analyst"), ("maybe", "x", "admin"), ("dismiss", "enough", "analyst")], "decision string, reason string, role string"))
    assert [len(r["faults"]) for r in faults.collect()] == [1, 2, 0]
    two, other = (spark.createDataFrame([(x,) for x in xs], "account_id string") for xs in (["a", "b"], ["a", "c"]))
    assert serving.job_id("m", two) != serving.job_id("m", other)
    assert spark.range(1).select(serving.linked(F.lit("see A12 and A1"), ["A1", "A12"])).first()[0] == "see [[A12]] and [[A1]]"


def test_edge_labels_round_the_binary_value_as_c_does(spark):
    rng = random.Random(5)
    amounts = [50.0 * i for i in range(-40, 200)] + [rng.randrange(10**9) / 100 for _ in range(500)] + [2.0**k + 0.25 for k in range(60)] + [0.0, -0.0, -40.0, 1e12 + 50, 1e20, math.inf, -math.inf, math.nan]
    rows = spark.createDataFrame([(x,) for x in amounts], "x double").unionByName(spark.sql("SELECT CAST(NULL AS DOUBLE) AS x"))
    got = rows.select("x", serving.edge_label(F.col("x")).alias("l")).collect()
    assert [r["l"] for r in got] == [None if r["x"] is None else f"${r['x'] / 1000:.1f}k" for r in got]


def test_layers(spark):
    n = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 2.0]), ("c", [1.0, 1.0])], "id string, vec array<double>")
    e = spark.createDataFrame([(1, "a", "c", 0.0), (2, "b", "c", 10.0)], "tx_id long, src string, dst string, edge_time double")
    eye = [[1.0, 0.0], [0.0, 1.0]]
    got = {r["id"]: r["vec"] for r in detectors.mean_layer(n, e, eye, eye, [0.0, -5.0]).collect()}
    assert got["c"] == [1.5, 0.0] and got["a"] == [1.0, 0.0]
    timed = detectors.time_encoded(e, [1.0, 2.0], [0.0, 0.5])
    t = {r["tx_id"]: r["time_vec"] for r in timed.collect()}
    assert t[1] == pytest.approx([1.0, math.sin(2.5)]) and t[2] == pytest.approx([0.0, math.sin(0.5)])
    head = {"weight": eye, "source": [0.0, 0.0], "target": [0.0, 0.0], "edge": [1.0, 0.0], "edge_weight": eye}
    alpha = {r["tx_id"]: r["attention"] for r in detectors.edge_attention(n, timed, [head] * 4).collect()}
    assert sum(alpha.values()) == pytest.approx(1) and alpha[1] > alpha[2]
    out = {r["id"]: r["vec"] for r in detectors.attention_layer(n, timed, [head] * 4, last=True).collect()}
    assert out["c"] == pytest.approx([alpha[1], 2 * alpha[2]]) and out["a"] == [0.0, 0.0]


def synthetic(spark, n=60):
    rng = random.Random(3)
    accounts = [(f"a{i:02}", f"B{i % 4}", T0, f'{{"v": {1.0 + (i % 3 == 0) + rng.random()}}}') for i in range(n)]
    tx = [(f"t{i:03}", f"a{rng.randrange(n):02}", f"a{rng.randrange(n):02}", rng.random() * 100, "USD", T0 + dt.timedelta(hours=i), "w", None, None) for i in range(3 * n)]
    labels = [(t[0], "tx", "laundering" if int(t[1][1:]) % 3 == 0 else "not_laundering", "s") for t in tx]
    rows = {"accounts": accounts, "transactions": tx, "labels": labels, "rings": []}
    return CanonicalDataset("ibm_aml", **{t: spark.createDataFrame(rows[t], s) for t, s in TABLES.items()})


def test_flows(spark, tmp_path):
    data = synthetic(spark)
    s = config.load(overrides={"split": {"strategy": "random"}, "model": {"trees": 3, "depth": 3}, "federated": {"rounds": 3}, "features": {"use_temporal": True}})
    flows.prepare(data, s, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/ibm_aml/node_statistics.parquet").count() == 60
    t = flows.train(data, s)
    assert 0 <= t.metrics["auc"] <= 1 and t.detector.importance()[0][1] > 0
    t.detector.save(str(tmp_path / "model"))
    again = detectors.BoostedTrees.load(str(tmp_path / "model"))
    assert again.columns == t.detector.columns
    with pytest.raises(TypeError):
        detectors.NeighbourMean.load(str(tmp_path / "model"))
    report = flows.evaluation_report(data, s, t)
    assert all(f"## {h}" in report for h in ("Drift", "Input drift", "Fairness", "Evasion", "Ablations")) and "| institution_id | 4 |" in report
    flows.write_reports(t, str(tmp_path / "reports"))
    assert json.loads((tmp_path / "reports" / "metrics.json").read_text())["auc"] == t.metrics["auc"] and spark.read.json(str(tmp_path / "reports" / "pr_curve")).count() > 0
    store = commits.ServingStore(spark, str(tmp_path / "serving"))
    store.append("m", {"models": spark.createDataFrame([("m", "r", "n")], "model_id string, run_id string, name string")})
    done = flows.scoring_job(data, s, t, store, "m")
    assert done == flows.scoring_job(data, s, t, store, "m") and store.read("narratives").count() == done["rows"]["alerts"] > 0
    conditions = {r["condition"]: r["n_samples"] for r in flows.three_conditions(data, s).collect()}
    assert set(conditions) == {"isolated", "federated", "federated_boundary", "pooled"} and len(set(conditions.values())) == 1


def test_explain_account(spark):
    data = synthetic(spark)
    s = config.load(overrides={"split": {"strategy": "random"}, "model": {"name": "neighbour_mean", "num_layers": 2}, "features": {"use_temporal": False}})
    t = flows.train(data, s)
    account = t.scored.orderBy(F.abs(F.col("score") - 0.5), "id").first()["id"]  # a score that a single edge can move
    out = flows.explain_account(data, s, t, account)
    assert account in out["narrative"] and out["evidence"]["account_id"] == account
    # the first transactions shown are those whose removal moves the score
    assert out["evidence"]["transactions"]
    # a counterfactual lowers the column that raises the score most, where there is one
    assert (out["counterfactual"] is None) == (out["evidence"]["attributions"] == [])
    with pytest.raises(KeyError):
        flows.explain_account(data, s, t, "nobody")


def test_federated_budget_stops(spark):
    rows = spark.createDataFrame([(i % 2, f"a{i}", int(i % 3 == 0), float(i % 3 == 0)) for i in range(40)], "client int, account_id string, target int, x double")
    s = config.load(overrides={"federated": {"rounds": 5}, "privacy": {"masked": True}})
    weights, log = flows.federate(rows, ["x"], s)
    assert len(log) == 2 and len(weights) == 2
    plain, log = flows.federate(rows, ["x"], s, private=False)
    assert len(log) == 5 and plain[0] > 0


def test_neighbour_mean_detector(spark):
    f = spark.createDataFrame([(f"a{i}", float(i % 2)) for i in range(20)], "account_id string, x double")
    e = spark.createDataFrame([(f"a{i}", f"a{(i + 2) % 20}") for i in range(20)], "src string, dst string")
    y = f.select("account_id", F.col("x").cast("int").alias("target"))
    d = detectors.NeighbourMean(layers=1)
    x = d.propagated(f, e)
    p = {r["account_id"]: r["score"] for r in d.fit(x, y).predict(x).collect()}
    assert p["a1"] > 0.5 > p["a0"]
    with pytest.raises(ValueError):
        detectors.NeighbourMean().fit(f, y.withColumn("target", F.lit(1)))
    with pytest.raises(KeyError):
        detectors.scores_of(spark.createDataFrame([("a", 1.0)], "account_id string, score double"), spark.createDataFrame([("b",)], "account_id string"))
