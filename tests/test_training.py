"""Edge effects against scoring every variant, and two-headed training against a plain run."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweft.operators import explain, twohead

WEIGHTS = [[0.3, -0.2], [0.5, 0.4], [-0.6, 0.8]]


def plain_score(vec, edges, target, weights, bias):
    layer = dict(vec)
    z = bias + float(np.dot(weights[0], layer.get(target, np.zeros(2))))
    for w in weights[1:]:
        sent = {}
        for _, s, d in edges:
            sent.setdefault(d, []).append(layer.get(s, np.zeros(2)))
        layer = {v: np.mean(sent[v], axis=0) if v in sent else np.zeros(2) for v in {*layer, *sent}}
        z += float(np.dot(w, layer.get(target, np.zeros(2))))
    return 1 / (1 + math.exp(-z))


@pytest.mark.parametrize("layers", [1, 2, 3])
def test_edge_effects_equal_scoring_every_variant(spark, layers):
    rng = random.Random(layers)
    vec = {i: np.array([rng.uniform(-1, 1), rng.uniform(-1, 1)]) for i in range(9)}
    edges = [(k, rng.randrange(10), rng.randrange(10)) for k in range(28)] + [(100, 1, 1), (101, 1, 2), (102, 2, 1), (103, 1, 2)]
    weights = (WEIGHTS + [[0.7, 0.1]])[: layers + 1]
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in vec.items()], "id long, vec array<double>")
    e = spark.createDataFrame(edges, "tx_id long, src long, dst long")
    targets = spark.createDataFrame([(1,), (2,), (5,), (77,)], "id long")
    got = {(r["target"], r["tx_id"]): r["effect"] for r in explain.edge_effects(nodes, e, targets, weights, 0.1, least=1e-9).collect()}
    want = {}
    for t in (1, 2, 5, 77):
        base = plain_score(vec, edges, t, weights, 0.1)
        for gone in edges:
            effect = abs(base - plain_score(vec, [x for x in edges if x != gone], t, weights, 0.1))
            if effect > 1e-9:
                want[t, gone[0]] = effect
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-6, abs_tol=1e-12) for k in want)


def test_edge_effects_of_a_hub(spark):
    """100,000 edges into one vertex next to the target: rows in proportion, not their square."""
    n = 100_000
    e = spark.range(n).select(F.col("id").alias("tx_id"), (F.col("id") + 10).alias("src"), F.lit(1).cast("long").alias("dst")).unionByName(spark.createDataFrame([(n, 1, 0)], "tx_id long, src long, dst long"))
    nodes = spark.range(n + 10).select("id", F.array((F.col("id") % 7).cast("double"), F.lit(1.0)).alias("vec"))
    began = time.time()
    got = explain.edge_effects(nodes, e, spark.createDataFrame([(0,), (1,)], "id long"), [[0.0, 0.0], [0.1, 0.0], [0.1, 0.0]], least=0.0)
    rows = got.groupBy("target").count().collect()
    assert {r["target"] for r in rows} == {0, 1} and max(r["count"] for r in rows) > n // 2
    assert time.time() - began < 120


def plain_training(x, y, m, held, weight, shape, flat, motif_weight, epochs, rate, decay, patience):
    best, least, worse, first, second = flat, np.inf, 0, 0.0, 0.0

    def forward(flat, a):
        inner, bias, head, head_bias, motif, motif_bias = shape.parts(flat)
        h = np.maximum(a @ inner.T + bias, 0)
        return 1 / (1 + np.exp(-(h @ head + head_bias))), 1 / (1 + np.exp(-(h @ motif.T + motif_bias)))

    def loss(flat, rows):
        p, q = forward(flat, x[rows])
        w = np.where(y[rows] == 1, weight, 1.0)
        label = -w * (y[rows] * np.log(p) + (1 - y[rows]) * np.log(1 - p))
        motif = -(m[rows] * np.log(q) + (1 - m[rows]) * np.log(1 - q)).mean(axis=1)
        return (label + motif_weight * motif).mean()

    for epoch in range(1, epochs + 1):
        g = np.zeros(shape.size)
        for i in range(shape.size):  # the slope of the loss by differences
            step = np.zeros(shape.size)
            step[i] = 1e-6
            g[i] = (loss(flat + step, ~held) - loss(flat - step, ~held)) / 2e-6
        judged = loss(flat, held)
        if judged < least:
            best, least, worse = flat, judged, 0
        else:
            worse += 1
            if worse >= patience:
                break
        g = g + decay * flat
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        flat = flat - rate * (first / (1 - 0.9**epoch)) / (np.sqrt(second / (1 - 0.999**epoch)) + 1e-8)
    return best


def accounts(spark, n=120, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    y = (x[:, 0] + 0.3 * rng.normal(size=n) > 0.6).astype(int)
    m = np.column_stack([x[:, 1] > 0, x[:, 0] > 0]).astype(int)
    rows = spark.createDataFrame([(f"a{i}", int(y[i]), *map(float, x[i]), *map(int, m[i])) for i in range(n)], "account_id string, target int, u double, v double, w double, motif_a int, motif_b int")
    return rows, x, y, m


def test_two_heads_equal_plain_training(spark):
    rows, x, y, m = accounts(spark)
    how = {"motif_weight": 0.5, "epochs": 6, "rate": 0.05, "decay": 1e-4, "patience": 2}
    got = twohead.fit(rows.repartition(5), ["u", "v", "w"], ["motif_a", "motif_b"], 2.0, hidden=4, seed=7, **how)
    flags = {r[0]: r[1] < twohead.HELD for r in rows.select("account_id", F.pmod(F.xxhash64("account_id", F.lit(7)), F.lit(100))).collect()}
    held = np.array([flags[f"a{i}"] for i in range(len(y))])
    assert 0.05 < held.mean() < 0.3
    scaled = (x - x[~held].mean(axis=0)) / x[~held].std(axis=0)
    want = plain_training(scaled, y, m, held, 2.0, got.shape, got.shape.start(7), **how)
    assert np.allclose(got.flat, want, atol=2e-4)
    assert [r["epoch"] for r in got.log] == list(range(1, len(got.log) + 1))


def test_two_heads_stop_early_and_keep_the_best(spark):
    rows, *_ = accounts(spark, 60)
    got = twohead.fit(rows, ["u", "v", "w"], ["motif_a", "motif_b"], 1.0, hidden=3, epochs=12, rate=3.0, patience=2, seed=1)  # steps far too long
    losses = [r["held_loss"] for r in got.log]
    assert len(losses) < 12 and len(losses) - 1 - int(np.argmin(losses)) == 2
    if np.argmin(losses) == 0:
        assert (got.flat == got.shape.start(1)).all()


def test_two_heads_detector(spark, tmp_path):
    rows, _, y, _ = accounts(spark, 200)
    d = twohead.TwoHeads(0, hidden=4, epochs=25, rate=0.1)
    d.fit(rows.select("account_id", "u", "v", "w"), rows.select("account_id", "target"), rows.select("account_id", "motif_a", "motif_b"))
    scores = {r["account_id"]: r["score"] for r in d.predict(rows.select("account_id", "u", "v", "w")).collect()}
    right = np.mean([(scores[f"a{i}"] >= 0.5) == bool(y[i]) for i in range(200)])
    assert right > 0.85 and d.importance()[0][0] == "u"
    d.save(str(tmp_path / "m"))
    again = twohead.TwoHeads.load(str(tmp_path / "m")).predict(rows.select("account_id", "u", "v", "w")).collect()
    assert {r["account_id"]: r["score"] for r in again} == scores
    few = twohead.TwoHeads(0, hidden=2, epochs=1).fit(rows.limit(9).select("account_id", "u"), rows.withColumn("target", F.pmod(F.xxhash64("account_id"), F.lit(2))).select("account_id", "target"))
    assert few.model.log[0]["loss"] == few.model.log[0]["held_loss"]  # too few rows to hold any out
