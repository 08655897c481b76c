"""Work in rounds: boundary exchange, whole commits, strong components of long graphs, masks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweft.operators import boundary, commits, federated, graph, iterate
from tallyweft.storage import file_at

# --- boundary exchange -------------------------------------------------------------------------
KEY = "k"


def parties(spark, n=30, width=3, seed=4):
    rng = random.Random(seed)
    owned = [(f"a{i}", rng.randrange(3)) for i in range(n)] + [("nobody", None)]
    vectors = [(f"a{i}", [rng.uniform(-1, 1) for _ in range(width)]) for i in range(n - 2)] + [("elsewhere", [1.0] * width)]
    tx = [(f"t{i}", f"a{rng.randrange(n)}", f"a{rng.randrange(n)}") for i in range(80)] + [("t_loop", "a1", "a1"), ("t_none", "a1", "nobody"), ("t_far", "abroad", "a2")]
    frame = lambda rows, s: spark.createDataFrame(rows, s)
    return frame(owned, "account_id string, owner int"), frame(vectors, "account_id string, vec array<double>"), frame(tx, "tx_id string, src_account string, dst_account string"), (owned, dict(vectors), tx)


def plain_exchange(owned, vectors, tx, width, rounds, layers, clip):
    """Per client, with the accounts' own names for the pseudonyms."""
    owner = dict(owned)
    nodes, edges = {}, []
    for a, o in owned:
        if o is not None:
            nodes[o, a, False] = np.array(vectors.get(a, [0.0] * width))
    for _, s, d in tx:
        for c in {owner.get(s), owner.get(d)} - {None}:
            ends = [(c, x, owner.get(x) != c) for x in (s, d)]
            for e in ends:
                nodes.setdefault(e, np.zeros(width))
            edges.append(tuple(ends))
    border = {x for s, d in edges for x, y in ((s, d), (d, s)) if y[2] and not x[2]}
    held = {}

    def encoded():
        now = {k: held.get(k[1], v) if k[2] else v for k, v in nodes.items()}
        for _ in range(layers):
            sent = {k: [] for k in now}
            for s, d in edges:
                sent[d].append(now[s])
            now = {k: (v + (np.mean(sent[k], axis=0) if sent[k] else 0)) / 2 for k, v in now.items()}
        return now

    for _ in range(rounds):
        out = encoded()
        held |= {k[1]: v * min(1.0, clip / (np.linalg.norm(v) + 1e-9)) for k, v in out.items() if k in border}
    return {k[:2]: v for k, v in encoded().items() if not k[2]}


@pytest.mark.parametrize("rounds,layers", [(0, 1), (3, 2)])
def test_exchange_equals_plain_version(spark, rounds, layers):
    owned, vectors, tx, plain = parties(spark)
    edges = boundary.client_edges(tx, owned, KEY)
    nodes = boundary.client_nodes(vectors, owned, edges, 3)
    got = boundary.exchange(nodes, edges, width=3, rounds=rounds, layers=layers, clip=0.2, key=KEY)
    want = plain_exchange(*plain, 3, rounds, layers, 0.2)
    rows = {(r["client"], r["id"]): r["vec"] for r in got.vectors.collect()}
    assert rows.keys() == want.keys() and all(np.allclose(rows[k], want[k]) for k in want)
    assert [r["round"] for r in got.log] == list(range(1, rounds + 1))
    # what clients share has pseudonyms only
    assert got.registry.all().where(~F.col("pseudonym").startswith("pseudo_")).isEmpty()


def test_exchange_stops_at_the_budget_and_noise_differs(spark):
    owned, vectors, tx, _ = parties(spark)
    edges = boundary.client_edges(tx, owned, KEY)
    nodes = boundary.client_nodes(vectors, owned, edges, 3)
    out = boundary.exchange(nodes, edges, width=3, rounds=5, clip=1.0, noise=1.0, key=KEY, spent=lambda r: float(r), target=2.0)
    assert [r["epsilon"] for r in out.log] == [1.0, 2.0] and out.log[0]["published"] > 5
    one, two = ({r["pseudonym"]: r["vec"] for r in out.registry.all().where(F.col("round") == k).collect()} for k in (1, 2))
    assert one.keys() == two.keys() and all(one[k] != two[k] for k in one)
    # a repeated round replaces its own values
    again = out.registry.all().where("round = 2").select("pseudonym", F.array(F.lit(7.0)).alias("vec")).limit(3)
    rows = again.collect()
    out.registry.publish(spark.createDataFrame(rows, again.schema), 2)
    assert out.registry.all().where("round = 2").count() == 3 and out.registry.latest().count() == len(one)


def test_exchange_of_nothing(spark):
    owned, vectors, tx, _ = parties(spark)
    edges = boundary.client_edges(tx.limit(0), owned.limit(0), KEY)
    nodes = boundary.client_nodes(vectors, owned.limit(0), edges, 3)
    assert boundary.exchange(nodes, edges, width=3, rounds=1, key=KEY).vectors.count() == 0


# --- whole commits -----------------------------------------------------------------------------


def job(spark):
    edges = spark.createDataFrame([(f"T{i}", f"a{i % 4}", f"a{(i + 1) % 4}", None) for i in range(8)], "tx_id string, src string, dst string, ts timestamp_ntz")
    scores = spark.createDataFrame([(f"a{i}", i / 4) for i in range(5)], "account_id string, score double")
    own = edges.where("tx_id in ('T2', 'T3')").select(F.col("src").alias("id"), "tx_id")
    shares = spark.createDataFrame([("a2", "f", 1.0)], "id string, feature string, share double")
    return scores, edges, own, shares, spark.createDataFrame([("a3",)], "id string")


def state(store):
    return {t: sorted(map(str, store.read(t).collect())) for t in ("alerts", "evidence", "narratives", "audit_log")}


def test_killed_and_repeated_job_changes_nothing(spark, tmp_path, monkeypatch):
    store = commits.ServingStore(spark, str(tmp_path))
    with pytest.raises(ValueError):
        commits.scoring_job(store, *job(spark), model_id="m", job="j")
    store.append("models", {"models": spark.createDataFrame([("m", "r", "n")], "model_id string, run_id string, name string")})
    stage, left = commits.ServingStore.stage, [2]

    def dies(self, rows, table):
        left[0] -= 1
        if left[0] < 0:
            raise KeyboardInterrupt
        return stage(self, rows, table)

    at = F.lit("2024-01-01").cast("timestamp_ntz")
    monkeypatch.setattr(commits.ServingStore, "stage", dies)
    with pytest.raises(KeyboardInterrupt):
        commits.scoring_job(store, *job(spark), model_id="m", job="j", at=at)
    assert not any(state(store).values()) and store.response("job:j") is None  # two parts lie there, unread
    monkeypatch.setattr(commits.ServingStore, "stage", stage)
    first = commits.scoring_job(store, *job(spark), model_id="m", job="j", at=at)
    assert first == {"status": "success", "rows": {"alerts": 3, "evidence": 3, "narratives": 3, "audit_log": 3}}
    now = state(store)
    assert commits.scoring_job(store, *job(spark), model_id="m", job="j") == first and state(store) == now
    assert any("T2" in n and "a2" in n for n in now["narratives"]) and any("cycle" in n for n in now["narratives"])
    # another job of the same accounts has alerts of its own
    commits.scoring_job(store, *job(spark), model_id="m", job="k")
    assert store.read("alerts").count() == 6


def test_second_commit_of_a_token_loses(spark, tmp_path):
    store = commits.ServingStore(spark, str(tmp_path))
    rows = spark.createDataFrame([("m", "r", "n")], "model_id string, run_id string, name string")
    a, b = store.stage(rows, "models"), store.stage(rows, "models")
    assert store.commit("t", {"models": a}, {"who": "a"}) == {"who": "a"}
    assert store.commit("t", {"models": b}, {"who": "b"}) == {"who": "a"}
    assert store.read("models").count() == 1
    fs, at = file_at(spark, str(tmp_path))
    assert fs.exists(at)


def test_batches_replay_and_refuse(spark, tmp_path):
    store = commits.ServingStore(spark, str(tmp_path))
    tx = spark.createDataFrame([(f"T{i}", "a", f"b{i}", 1.0, "2024-01-01 00:00:00") for i in range(4)] + [("T1", "a", "b1", 2.0, "2024-01-01 00:00:00")], "tx_id string, src_account string, dst_account string, amount double, timestamp string")
    assert commits.ingest(store, tx, "one") == {"status": "success", "count": 5}
    assert commits.ingest(store, tx.limit(1), "one") == {"status": "success", "count": 5}
    more = tx.withColumn("tx_id", F.concat(F.lit("N"), "tx_id")).withColumn("src_account", F.lit("c"))
    with pytest.raises(ValueError):
        commits.ingest(store, more.withColumn("amount", F.lit(None).cast("double")), "two")
    assert store.read("transactions").count() == 4 and store.read("accounts").count() == 5
    commits.ingest(store, more.unionByName(tx), "two")
    assert store.read("transactions").count() == 8 and store.read("accounts").count() == 6
    assert store.read("transactions").where("tx_id = 'T1'").first()["amount"] == 1.0


# --- strong components -------------------------------------------------------------------------


def plain_components(n, pairs):
    out, into = ([[] for _ in range(n)] for _ in range(2))
    for a, b in pairs:
        out[a].append(b)
        into[b].append(a)

    def reach(at, near):
        seen, todo = {at}, [at]
        while todo:
            for x in near[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return seen

    return {v: max(reach(v, out) & reach(v, into)) for v in range(n)}


def labelled(spark, n, pairs):
    return {r["id"]: r["component"] for r in iterate.strong_components(spark.range(n), spark.createDataFrame(pairs, "src long, dst long")).collect()}


def test_strong_components_of_mixed_graph(spark):
    rng = random.Random(6)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(75)]
    pairs += [(60 + i, 60 + (i + 1) % 20) for i in range(20)]  # a cycle, with a tail and a bypass
    pairs += [(79, 80), (80, 81), (81, 82), (65, 83), (83, 84), (84, 70), (5, 5), (85, 86), (86, 85)]
    assert labelled(spark, 90, pairs) == plain_components(90, pairs)


@pytest.mark.parametrize("closed", [False, True])
def test_strong_components_of_5000_in_a_row(spark, closed):
    n = 5000
    got = labelled(spark, n, [(i, (i + 1) % n) for i in range(n if closed else n - 1)])
    assert got == {i: n - 1 if closed else i for i in range(n)}


# --- masks -------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 9])
def test_masks_cancel(spark, n):
    rows = federated.masks(spark.range(n).select((F.col("id") * 7).alias("client")), 5).collect()
    assert len(rows) == n
    if n > 1:
        assert all(any(r["mask"]) for r in rows) and [sum(v) for v in zip(*[r["mask"] for r in rows], strict=True)] == [0] * 5
    else:
        assert rows[0]["mask"] is None


def test_boundary_accounts_agree(spark):
    owned, _, tx, _ = parties(spark)
    edges = boundary.client_edges(tx, owned, KEY)
    got = {r["id"] for r in boundary.boundary_of(edges).collect()}
    assert got == {r["id"] for r in graph.boundary_accounts(edges).collect()}
