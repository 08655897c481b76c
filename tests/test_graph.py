import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyweft.operators import features, graph, iterate

DAY = dt.datetime(2022, 9, 1)


def edges(spark, pairs, start=DAY, step=dt.timedelta(hours=1)):
    rows = [(i, s, d, 10.0 * (i + 1), start + i * step, "x") for i, (s, d) in enumerate(pairs)]
    return spark.createDataFrame(rows, "tx_id long, src string, dst string, amount double, ts timestamp_ntz, channel string")


def vertices(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def by_id(df):
    return {r["id"]: r for r in df.collect()}


def test_star_degrees_and_fans(spark):
    e = edges(spark, [("a", "h"), ("b", "h"), ("c", "h"), ("h", "d"), ("h", "e")])
    v = vertices(spark, *"abcdehz")
    s = by_id(graph.node_statistics(v, e))
    assert (s["h"]["in_degree"], s["h"]["out_degree"], s["z"]["degree"]) == (3, 2, 0)
    assert s["h"]["in_strength"] == 60.0
    f = by_id(features.fan_features(v, e, 3, 3))
    assert (f["h"]["motif_is_fan_in"], f["h"]["motif_is_fan_out"]) == (1, 0)


def test_loop_and_parallel_edges(spark):
    e = edges(spark, [("a", "a"), ("a", "b"), ("a", "b")])
    s = by_id(graph.node_statistics(vertices(spark, "a", "b"), e))
    assert (s["a"]["degree"], s["a"]["out_neighbors"], s["b"]["in_neighbors"]) == (4, 2, 1)
    assert {(r["src"], r["dst"]): r["weight"] for r in graph.weighted(e).collect()} == {("a", "a"): 1, ("a", "b"): 2}
    assert by_id(features.cycle_flags(vertices(spark, "a", "b"), e))["a"]["motif_is_cycle"] == 1


def test_chain_and_triangle(spark):
    f = by_id(features.fan_features(vertices(spark, *"abc"), edges(spark, [("a", "b"), ("b", "c")])))
    assert [f[x]["motif_is_chain"] for x in "abc"] == [0, 1, 0]
    v, e = vertices(spark, *"abcz"), edges(spark, [("a", "b"), ("b", "c"), ("c", "a")])
    assert {k: r["motif_is_cycle"] for k, r in by_id(features.cycle_flags(v, e)).items()} == {"a": 1, "b": 1, "c": 1, "z": 0}
    t = by_id(features.topological_features(v, e))
    assert t["a"]["graph_component_size"] == 3 and t["z"]["graph_component_size"] == 1
    assert t["a"]["graph_core"] == 2 and t["a"]["graph_clustering"] == 1.0
    assert sum(r["graph_pagerank"] for r in t.values()) == pytest.approx(1.0)


def test_components_of_a_long_path(spark):
    n = 200
    e = edges(spark, [(f"{i:04}", f"{i + 1:04}") for i in range(n)])
    got = iterate.connected_components(vertices(spark, *[f"{i:04}" for i in range(n + 1)], "z"), e).collect()
    assert {r["component"] for r in got} == {"0000", "z"} and max(r["size"] for r in got) == n + 1


def test_no_edges(spark):
    e, v = edges(spark, []), vertices(spark, "a", "b")
    assert {r["size"] for r in iterate.connected_components(v, e).collect()} == {1}
    assert {r["core"] for r in iterate.core_numbers(v, e).collect()} == {0}
    assert {r["size"] for r in iterate.strong_components(v, e).collect()} == {1}
    assert graph.snapshot_sizes(e, 10).count() == 0
    assert iterate.pagerank(v, e).count() == 2


def test_snapshots_conserve_edges(spark):
    e = edges(spark, [("a", "b")] * 10)
    assert sum(r["n_edges"] for r in graph.snapshot_sizes(e, 7200).collect()) == 10
    with pytest.raises(ValueError):
        graph.snapshots(e, 0)


def test_sampling_limits_in_edges(spark):
    e = edges(spark, [(x, "t") for x in "abcd"])
    assert iterate.sample_neighbourhood(e, vertices(spark, "t"), [2]).count() == 2
    path = edges(spark, [("d", "c"), ("c", "b"), ("b", "a")])
    assert {r["hop"]: r["src"] for r in iterate.sample_neighbourhood(path, vertices(spark, "a"), [5, 5, 5]).collect()} == {0: "b", 1: "c", 2: "d"}
    assert iterate.effective_fanout([15, 10], 3) == [15, 10, 10] and iterate.effective_fanout([], 1) == [10]


def test_cycle_existence(spark):
    assert iterate.has_cycle(vertices(spark, "a"), edges(spark, [("a", "a")]))
    assert not iterate.has_cycle(vertices(spark, "a"), edges(spark, [("a", "b"), ("b", "c")]))


def test_attach_requires_features(spark):
    have = spark.createDataFrame([("a", 1.0)], "id string, x double")
    with pytest.raises(KeyError):
        graph.attach(vertices(spark, "a", "b"), have)


def test_dense_export(spark):
    v, e = vertices(spark, "b", "a", "c"), edges(spark, [("a", "c")])
    nodes, flat = graph.dense_export(v, e)
    assert {r["id"]: r["node"] for r in nodes.collect()} == {"a": 0, "b": 1, "c": 2}
    assert (flat.first()["src"], flat.first()["dst"]) == (0, 2)


def test_equal_gaps_have_burstiness_minus_one(spark):
    f = {r["account_id"]: r for r in features.temporal_features(edges(spark, [("a", "b")] * 5)).collect()}
    assert f["a"]["temporal_burstiness"] == -1.0 and f["a"]["temporal_mean_inter_arrival"] == 3600.0
    one = features.temporal_features(edges(spark, [("a", "b")])).first()
    assert (one["temporal_velocity"], one["temporal_tx_count"]) == (0.0, 1)


@pytest.mark.parametrize("what, table", [("pagerank", "ranks"), ("core_numbers", "cores")])
def test_a_round_has_one_exchange(spark, monkeypatch, what, table):
    from tallyweft.storage import Bucketed

    plans, cut = [], Bucketed.cut

    def recorded(self, df, key, name="bucketed"):
        if name == table:
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(self, df, key, name)

    monkeypatch.setattr(Bucketed, "cut", recorded)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        e = edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("a", "d")])
        getattr(iterate, what)(vertices(spark, *"abcdz"), e).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    rounds = plans[1:]
    assert rounds and all(p.count("Exchange ") == 1 for p in rounds), rounds[0]


def test_in_edges_of_a_hot_vertex_come_in_chunks(spark):
    e = spark.range(1000).select(F.col("id").alias("tx_id"), F.lit("s").alias("src"), F.when(F.col("id") < 900, "hot").otherwise(F.concat(F.lit("v"), F.col("id").cast("string"))).alias("dst"))
    rows = graph.in_edge_index(e, 64).collect()
    hot = sorted((r["chunk"], r["tx_ids"]) for r in rows if r["dst"] == "hot")
    assert [c for c, _ in hot] == list(range(15)) and max(len(t) for _, t in hot) == 64 and sum((t for _, t in hot), []) == list(range(900))
    assert {len(r["tx_ids"]) for r in rows if r["dst"] != "hot"} == {1} and {r["chunk"] for r in rows if r["dst"] != "hot"} == {0}
