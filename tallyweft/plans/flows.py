"""End-to-end flows over a canonical dataset: prepare, train, compare, federate, ablate, evaluate, score."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweft.config import Settings
from tallyweft.model import CanonicalDataset
from tallyweft.operators import audit, boundary, commits, detectors, explain, federated, graph, iterate, metrics, serving, split
from tallyweft.operators import features as fx
from tallyweft.operators import twohead
from tallyweft.sources import stores
from tallyweft.storage import cut


def _fractions(s: Settings) -> tuple[float, float, float]:
    return s.split.train, s.split.val, s.split.test


def vertices_of(data: CanonicalDataset) -> DataFrame:
    return data.accounts.select(F.col("account_id").alias("id"))


def unscaled_matrix(data: CanonicalDataset, s: Settings) -> DataFrame:
    """All feature families that the settings ask for, computed once and written."""
    v, e = vertices_of(data), graph.edges_of(data.transactions)
    families = [fx.raw_features(data.accounts)]
    if s.features.use_graph:
        families.append(fx.topological_features(v, e))
    if s.features.use_temporal:
        families.append(fx.temporal_features(e, s.features.rolling_window_steps))
    if s.features.use_motif:
        families.append(fx.motif_features(v, e, s.features.fan_in_threshold, s.features.fan_out_threshold))
    return cut(fx.feature_matrix(data.accounts, *families), "matrix")


def account_entities(data: CanonicalDataset) -> DataFrame:
    """Accounts with a target, their first time and institution: labels are projected to accounts before any split."""
    target = split.binary_target(data.labels, data.transactions, data.name)
    ends = data.transactions.where("timestamp is not null").select(F.explode(F.array("src_account", "dst_account")).alias("account_id"), "timestamp")
    first = ends.groupBy("account_id").agg(F.min("timestamp").alias("first"))
    rows = target.join(data.accounts, "account_id").join(first, "account_id", "left")
    return rows.select(F.col("account_id").alias("entity_id"), F.lit("account").alias("entity_type"), F.col("target").cast("string").alias("label"), F.coalesce("opened_at", "first").alias("timestamp"), "institution_id", "target")


def prepare(data: CanonicalDataset, s: Settings, folder: str | None = None) -> dict[str, DataFrame]:
    """Write the tables, the node statistics and the folds; returns statistics and folds."""
    stats = graph.node_statistics(vertices_of(data), graph.edges_of(data.transactions))
    folds = cut(split.split(account_entities(data), s.split.strategy, fractions=_fractions(s), seed=s.seed, held_out=s.split.held_out_institution), "folds")
    if folder:
        at = f"{folder}/{data.name}"
        data.write(folder)
        stats.write.mode("overwrite").parquet(f"{at}/node_statistics.parquet")
        vertices_of(data).write.mode("overwrite").parquet(f"{at}/graph_vertices.parquet")
        graph.edges_of(data.transactions).write.mode("overwrite").parquet(f"{at}/graph_edges.parquet")
        folds.select("entity_id", "fold").write.mode("overwrite").parquet(f"{at}/split_ids.parquet")
        split.fold_summary(folds, s.split.strategy, s.seed).coalesce(1).write.mode("overwrite").json(f"{at}/fold_summary")
    return {"node_statistics": stats, "folds": folds}


@dataclass
class Trained:
    detector: detectors.Detector
    pipeline: fx.FeaturePipeline
    scored: DataFrame
    metrics: dict


def _ids(folds: DataFrame, fold: str) -> DataFrame:
    return folds.where(F.col("fold") == fold).select(F.col("entity_id").alias("account_id"))


def _inputs(model: detectors.Detector, x: DataFrame, data: CanonicalDataset) -> DataFrame:
    return model.propagated(x, graph.edges_of(data.transactions)) if isinstance(model, detectors.NeighbourMean) else x


def metric_row(scored: DataFrame, s: Settings) -> dict:
    """All scalar metrics of (id, label, score) rows."""
    out = metrics.threshold_metrics(scored, s.training.alert_threshold).first().asDict()
    out |= metrics.roc_auc(scored).first().asDict() | metrics.average_precision(scored).first().asDict()
    out["precision_at_k"] = {r["k"]: r["precision"] for r in metrics.precision_at_k(scored, list(s.evaluation.precision_at_k)).collect()}
    if s.training.alert_budget:
        out["recall_at_budget"] = metrics.recall_at_budget(scored, s.training.alert_budget).first()["recall"]
    out["threshold_sweep"] = [r.asDict() for r in metrics.threshold_sweep(scored, s.evaluation.sweep_steps).orderBy("threshold").collect()]
    return out


def _how(s: Settings) -> dict:
    if s.model.name == "boosted_trees":
        return {"depth": s.model.depth, "trees": s.model.trees}
    if s.model.name == twohead.TwoHeads.name:
        return {"layers": s.model.num_layers, **_two_heads(s)}
    return {"layers": s.model.num_layers}


def _two_heads(s: Settings) -> dict:
    t = s.training
    return {"hidden": s.model.hidden_dim, "motif_weight": s.model.motif_weight, "epochs": t.epochs, "rate": t.learning_rate, "decay": t.weight_decay, "patience": t.patience, "seed": s.seed}


def training_motifs(data: CanonicalDataset, s: Settings, train_ids: DataFrame) -> DataFrame:
    """(account_id, motif flags) on the graph of the training accounts alone: other accounts' edges tell nothing."""
    ids = train_ids.select(F.col("account_id").alias("id")).distinct()
    e = graph.edges_of(data.transactions)
    own = cut(e.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi"), "training-edges")
    flags = fx.motif_features(ids, own, s.features.fan_in_threshold, s.features.fan_out_threshold)
    return cut(flags.withColumnRenamed("id", "account_id").select("account_id", *[c for c in flags.columns if c.startswith("motif_is_")]), "motifs")


def train(data: CanonicalDataset, s: Settings, folds: DataFrame | None = None, matrix: DataFrame | None = None) -> Trained:
    """Fit scaling and detector on the training fold, score the test fold."""
    folds = prepare(data, s)["folds"] if folds is None else folds
    matrix = unscaled_matrix(data, s) if matrix is None else matrix
    target = folds.select(F.col("entity_id").alias("account_id"), "target")
    train_ids, test_ids = _ids(folds, "train"), _ids(folds, "test")
    pipe = fx.FeaturePipeline(s.features.scaler).fit(matrix, train_ids, test_ids)
    model = detectors.detector(s.model.name, **_how(s))
    x = _inputs(model, pipe.transform(matrix), data)
    own = (x.join(train_ids, "account_id", "left_semi"), target)
    model.fit(*own, training_motifs(data, s, train_ids)) if isinstance(model, twohead.TwoHeads) else model.fit(*own)
    scored = model.predict(x.join(test_ids, "account_id", "left_semi")).join(target, "account_id").select(F.col("account_id").alias("id"), F.col("target").alias("label"), "score")
    scored = cut(scored, "scored")
    return Trained(model, pipe, scored, metric_row(scored, s))


def compare(data: CanonicalDataset, settings: dict[str, Settings]) -> DataFrame:
    """Metrics of several configurations on one test set: overall, in rings (on a cycle) and elsewhere."""
    folds = prepare(data, next(iter(settings.values())))["folds"]
    long = None
    for name, s in settings.items():
        rows = train(data, s, folds).scored.withColumn("model", F.lit(name))
        long = rows if long is None else long.unionByName(rows)
    metrics.same_test_set(long)
    rings = fx.cycle_flags(vertices_of(data), graph.edges_of(data.transactions)).where("motif_is_cycle = 1").select("id", F.lit("ring").alias("segment"))
    return metrics.segment_comparison(long, rings)


# --- federated --------------------------------------------------------------------------------


class BudgetExceeded(RuntimeError):
    """The privacy spent exceeds the target."""


def epsilon(spark, rounds: int, s: Settings) -> float:
    steps = spark.range(1).select(F.lit(rounds).alias("steps"))
    return federated.rdp_epsilon(steps, s.privacy.noise, s.privacy.delta).first()["epsilon"]


def federate(rows: DataFrame, columns: list[str], s: Settings, *, private: bool = True, stop_at_budget: bool = True) -> tuple[list[float], list[dict]]:
    """Rounds of sampled clients, local fits, optional noise and masks, weighted averaging; weights and a row per round.

    ``rows`` are (client, account_id, target, features...).  Only averages of
    a few numbers reach the driver.
    """
    spark = rows.sparkSession
    rows = cut(rows, "clients")
    clients = cut(rows.select("client").distinct(), "names")
    weights, log = [0.0] * (len(columns) + 1), []
    for r in range(1, s.federated.rounds + 1):
        spent = epsilon(spark, r, s) if private else 0.0
        if private and spent > s.privacy.target_epsilon:
            if stop_at_budget:
                break
            raise BudgetExceeded(f"{spent:.3f} after round {r}")
        picked = federated.sampled_clients(clients, s.federated.fraction, s.seed + r)
        fits = cut(detectors.local_fits(rows.join(picked, "client", "left_semi"), columns, weights, epochs=s.federated.local_epochs, mu=s.federated.proximal_mu), "fits")
        if private:
            start = F.array(*[F.lit(w) for w in weights])
            noised = federated.private_update(start, F.col("weights"), clip=s.privacy.clip, noise=s.privacy.noise, key=F.concat_ws(":", F.lit(s.seed), F.lit(r), F.col("client").cast("string")))
            fits = cut(fits.withColumn("weights", noised), "noised")
        n = fits.count()
        if s.privacy.masked and n > 1:
            mask = federated.masks(fits.select("client"), len(weights), s.seed + r)
            masked = federated.masked_updates(fits, mask)
            total = masked.agg(F.sum("n")).first()[0]
            sums = masked.select(F.posexplode("masked").alias("pos", "v")).groupBy("pos").agg(F.sum("v").alias("v")).orderBy("pos").collect()
            weights = [x["v"] / (1 << 16) / total for x in sums]
        else:
            weights = [x["value"] for x in federated.fedavg(fits).orderBy("pos").collect()]
        log.append({"round": r, "clients": n, "epsilon": spent, "bytes": federated.communication_bytes(n, len(weights))})
    return weights, log


def boundary_columns(data: CanonicalDataset, s: Settings, features: DataFrame, owned: DataFrame, *, private: bool = True) -> tuple[DataFrame, list[dict]]:
    """(account_id, boundary_0, ...) from rounds of boundary embeddings over the features, and a row for each round.

    Of another institution's accounts a client uses what they publish alone.
    """
    spark, columns = features.sparkSession, [c for c in features.columns if c != "account_id"]
    vectors = features.select("account_id", F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]).alias("vec"))
    edges = boundary.client_edges(data.transactions, owned)
    nodes = boundary.client_nodes(vectors, owned, edges, len(columns))
    how = {"clip": s.privacy.clip, "noise": s.privacy.noise, "spent": lambda r: epsilon(spark, r, s), "target": s.privacy.target_epsilon} if private else {"clip": None}
    out = boundary.exchange(nodes, edges, width=len(columns), rounds=s.federated.boundary_rounds, **how)
    return out.vectors.select(F.col("id").alias("account_id"), *[F.col("vec")[i].alias(f"boundary_{i}") for i in range(len(columns))]), out.log


@dataclass
class Partitioned:
    """Scaled rows (client, account_id, target, fold, features...) of all clients on one global split."""

    rows: DataFrame
    columns: list[str]
    matrix: DataFrame
    owned: DataFrame


def partitioned(data: CanonicalDataset, s: Settings) -> Partitioned:
    folds, matrix = prepare(data, s)["folds"], unscaled_matrix(data, s)
    pipe = fx.FeaturePipeline(s.features.scaler).fit(matrix, _ids(folds, "train"), _ids(folds, "test"))
    owned = cut(federated.owners(data.accounts, s.federated.num_clients), "owners")
    target = folds.select(F.col("entity_id").alias("account_id"), "target", "fold")
    scaled = cut(pipe.transform(matrix), "scaled")
    rows = cut(scaled.join(target, "account_id").join(owned, "account_id").withColumnRenamed("owner", "client"), "rows")
    return Partitioned(rows, pipe.columns, scaled, owned)


def with_boundary(data: CanonicalDataset, s: Settings, p: Partitioned, *, private: bool = True) -> tuple[Partitioned, list[dict]]:
    """The same rows with the columns of the boundary exchange."""
    more, log = boundary_columns(data, s, p.matrix.select("account_id", *p.columns), p.owned, private=private)
    names = [c for c in more.columns if c != "account_id"]
    rows = cut(p.rows.join(more, "account_id", "left").na.fill(0.0, names), "rows")
    return Partitioned(rows, [*p.columns, *names], p.matrix, p.owned), log


def _scored(weights: list[float], part: DataFrame, columns: list[str], name: str) -> DataFrame:
    label = part.select("account_id", F.col("target").alias("label"))
    return detectors.linear_scores(part, columns, weights).join(label, "account_id").select(F.lit(name).alias("condition"), F.col("account_id").alias("id"), "label", "score")


def ring_members(data: CanonicalDataset, owned: DataFrame) -> DataFrame:
    """(id, span): the accounts of rings, and over how many institutions their ring spans."""
    labels = data.labels.where("entity_type = 'tx'").select(F.col("entity_id").alias("tx_id"), "label")
    rings = iterate.laundering_rings(graph.edges_of(data.transactions).join(labels, "tx_id"), split.POSITIVE[split.dataset_of(data.name)])
    return rings.join(federated.ring_spans(rings, owned), "ring_id").select(F.col("member").cast("string").alias("id"), "span")


def three_conditions(data: CanonicalDataset, s: Settings) -> DataFrame:
    """(condition, metrics..., recall_several, recall_single): isolated clients, federated (with and without boundary
    exchange), pooled, on one global split; recall of positive accounts by whether their ring spans institutions."""
    p = partitioned(data, s)
    fitting, held, zero = p.rows.where("fold = 'train'"), p.rows.where("fold = 'test'"), [0.0] * (len(p.columns) + 1)
    alone = detectors.local_fits(fitting, p.columns, zero, epochs=s.federated.rounds, mu=0.0)
    x = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in p.columns], F.lit(1.0))
    own = held.select("client", "account_id", F.col("target").alias("label"), x.alias("x")).join(F.broadcast(alone.select("client", "weights")), "client")
    z = F.aggregate(F.zip_with("x", "weights", lambda a, b: a * b), F.lit(0.0), lambda t, v: t + v)
    parts = [own.select(F.lit("isolated").alias("condition"), F.col("account_id").alias("id"), "label", (1 / (1 + F.exp(-z))).alias("score"))]
    shared, _ = federate(fitting, p.columns, s, private=False)
    parts.append(_scored(shared, held, p.columns, "federated"))
    more, _ = with_boundary(data, s, p, private=False)
    both, _ = federate(more.rows.where("fold = 'train'"), more.columns, s, private=False)
    parts.append(_scored(both, more.rows.where("fold = 'test'"), more.columns, "federated_boundary"))
    pooled = twohead.TwoHeads(0, **_two_heads(s)).fit(fitting.select("account_id", *p.columns), fitting, training_motifs(data, s, fitting))
    parts.append(pooled.predict(held.select("account_id", *p.columns)).join(held.select("account_id", F.col("target").alias("label")), "account_id").select(F.lit("pooled").alias("condition"), F.col("account_id").alias("id"), "label", "score"))
    long = parts[0]
    for part in parts[1:]:
        long = long.unionByName(part)
    long = cut(long, "conditions")
    by, threshold = ["condition"], s.training.alert_threshold
    span = ring_members(data, p.owned).groupBy("id").agg(F.max("span").alias("span"))
    hit = (F.col("score") >= threshold).cast("double")
    several = F.coalesce("span", F.lit(1).cast("long")) >= 2
    recall = long.where("label = 1").join(span, "id", "left").groupBy(*by).agg(F.avg(F.when(several, hit)).alias("recall_several"), F.avg(F.when(~several, hit)).alias("recall_single"))
    return metrics.threshold_metrics(long, threshold, by).join(metrics.roc_auc(long, by), by).join(metrics.average_precision(long, by), by).join(recall, by, "left")


# --- audits -----------------------------------------------------------------------------------


def ablations(data: CanonicalDataset, s: Settings) -> list[dict]:
    """Metrics without one feature family at a time; a failure is reported as such."""
    folds, matrix = prepare(data, s)["folds"], unscaled_matrix(data, s)
    out = []
    for name, prefix in (("full", None), ("no_graph", "graph_"), ("no_temporal", "temporal_"), ("no_motif", "motif_")):
        kept = matrix.select(*[c for c in matrix.columns if not (prefix and c.startswith(prefix))])
        try:
            got = train(data, s, folds, kept).metrics
            out.append({"ablation": name, "auc": got["auc"], "f1": got["f1"], "error": None})
        except ValueError as e:
            out.append({"ablation": name, "auc": None, "f1": None, "error": str(e)})
    return out


def federated_ablations(data: CanonicalDataset, s: Settings) -> list[dict]:
    """AUC on the test fold after federated rounds, without and with noise, and with boundary exchange; the rounds that the budget allowed."""
    p, out = partitioned(data, s), []
    for name, private, border in (("federated", False, False), ("federated_with_noise", True, False), ("federated_boundary", False, True), ("federated_boundary_with_noise", True, True)):
        own, exchanged = with_boundary(data, s, p, private=private) if border else (p, [])
        weights, log = federate(own.rows.where("fold = 'train'"), own.columns, s, private=private)
        scored = _scored(weights, own.rows.where("fold = 'test'"), own.columns, name)
        out.append({"ablation": name, "auc": metrics.roc_auc(scored).first()["auc"], "rounds": len(log), "boundary_rounds": len(exchanged)})
    return out


def evasion(data: CanonicalDataset, s: Settings, trained: Trained) -> DataFrame:
    """(level, recall) of the positive test accounts when ring transactions are split, delayed or sent through mules."""
    positive = split.POSITIVE[split.dataset_of(data.name)]
    ring_tx = data.labels.where((F.col("entity_type") == "tx") & (F.col("label") == positive)).select(F.col("entity_id").alias("tx_id"))
    targets = trained.scored.where("label = 1").select(F.col("id").alias("account_id"))

    def scores(transactions: DataFrame) -> DataFrame:
        changed = data.with_tables(transactions=transactions, accounts=audit.mule_accounts(data.accounts, ring_tx))
        x = _inputs(trained.detector, trained.pipeline.transform(unscaled_matrix(changed, s)), changed)
        return trained.detector.predict(x)

    return audit.evasion_recall(data.transactions, ring_tx, targets, scores, s.training.alert_threshold)


def evaluation_report(data: CanonicalDataset, s: Settings, trained: Trained) -> str:
    """A markdown report of metrics, drift over time and of the inputs, fairness by every protected attribute, evasion and ablations."""
    scored = trained.scored
    attributes = audit.protected_attributes(data.accounts)
    fairness = audit.bias_audits(scored, attributes, s.training.alert_threshold).orderBy("attribute").collect()
    folds, matrix = prepare(data, s)["folds"], unscaled_matrix(data, s)
    own = lambda fold: matrix.join(_ids(folds, fold), "account_id", "left_semi").drop("account_id")
    moved = audit.input_drift(own("train"), own("test")).orderBy(F.desc("psi"), "feature").collect()
    times = account_entities(data).select(F.col("entity_id").alias("id"), F.col("timestamp").alias("ts"))
    drift = audit.performance_drift(scored.join(times, "id")).orderBy("bin").collect()
    m = trained.metrics
    lines = ["# Evaluation", "", f"Dataset {data.name}, model {trained.detector.name}.", "", "| metric | value |", "|---|---|"]
    lines += [f"| {k} | {m[k]} |" for k in ("precision", "recall", "f1", "auc", "average_precision", "total_alerts", "n_samples", "n_positive")]
    lines += ["", "## Drift over time", "", "| bin | n | AUC |", "|---|---|---|", *[f"| {r['bin']} | {r['n']} | {r['auc']:.4f} |" for r in drift]]
    lines += ["", "## Input drift", "", f"Mean PSI of the test fold against the training fold: {moved[0]['mean_psi']:.4f} ({moved[0]['level']})." if moved else "No numeric features.", "", "| feature | PSI |", "|---|---|", *[f"| {r['feature']} | {r['psi']:.4f} |" for r in moved]]
    lines += ["", "## Fairness", "", "| attribute | groups | demographic parity | equalized odds | FPR disparity |", "|---|---|---|---|---|"]
    lines += [f"| {r['attribute']} | {r['n_groups']} | {r['demographic_parity']:.4f} | {r['equalized_odds']:.4f} | {r['fpr_disparity']:.4f} |" for r in fairness]
    lines += ["", "## Evasion", "", "| level | recall |", "|---|---|", *[f"| {r['level']} | {r['recall']:.4f} |" for r in evasion(data, s, trained).orderBy("level").collect()]]
    lines += ["", "## Ablations", "", "| without | AUC |", "|---|---|", *[f"| {r['ablation']} | {r['auc']} |" for r in ablations(data, s) + federated_ablations(data, s)]]
    lines += ["", "## Importance", "", *[f"- {k}: {v:.4f}" for k, v in trained.detector.importance()[:20]]]
    return "\n".join(lines) + "\n"


def scoring_job(data: CanonicalDataset, s: Settings, trained: Trained, store: commits.ServingStore, model_id: str) -> dict:
    """Score the test accounts into the store: alerts, evidence, narratives and audit rows in one commit.

    Contributions are the account's transactions labelled positive where there
    are labels, attributions those of the scaled features that a zero would
    lower most; the job is named by the model and the accounts.
    """
    scores = trained.scored.select(F.col("id").alias("account_id"), "score")
    job = serving.job_id(model_id, scores)
    edges = graph.edges_of(data.transactions)
    positive = data.labels.where((F.col("entity_type") == "tx") & (F.col("label") == split.POSITIVE[split.dataset_of(data.name)])).select(F.col("entity_id").alias("tx_id"))
    own = edges.join(positive, "tx_id", "left_semi")
    contributing = own.select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("id"), "tx_id")
    cycles = fx.cycle_flags(vertices_of(data), edges).where("motif_is_cycle = 1").select("id")
    shares = cut(explain.normalised(_attributed(trained, data, s)), "shares")
    return commits.scoring_job(store, scores, edges, contributing, shares, cycles, model_id=model_id, job=job, threshold=s.training.alert_threshold)


def _attributed(trained: Trained, data: CanonicalDataset, s: Settings) -> DataFrame:
    """(id, feature, effect) of a linear head; of other detectors their importance, the same for every account."""
    model = trained.detector
    ids = trained.scored.select(F.col("id").alias("account_id"))
    if type(model) is detectors.NeighbourMean:
        x = _inputs(model, trained.pipeline.transform(unscaled_matrix(data, s)), data).na.fill(0.0, model.columns).join(ids, "account_id", "left_semi")

        return explain.feature_ablation(x.withColumnRenamed("account_id", "id"), model.columns, _linear_head(model))
    ranked = F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(float(v)).alias("effect")) for c, v in model.importance()[:10]])
    return ids.select(F.col("account_id").alias("id"), F.explode(ranked).alias("x")).select("id", "x.feature", "x.effect").where("effect > 0")


def _linear_head(model: detectors.NeighbourMean):
    """The score of a linear head as a function of its columns."""

    def score(columns: dict):
        z = F.lit(float(model.model[-1]))
        for c, w in zip(model.columns, model.model[:-1], strict=True):
            z = z + columns[c] * F.lit(float(w))
        return 1 / (1 + F.exp(-z))

    return score


def explain_account(data: CanonicalDataset, s: Settings, trained: Trained, account: str) -> dict:
    """Evidence, narrative and counterfactual of one scored account; raises KeyError for an account without a score.

    With a linear head over neighbour means, contributing transactions are
    those whose removal moves the score, and the counterfactual lowers the
    most important column until the score falls below the threshold.  With
    other detectors the account's transactions labelled positive contribute.
    """
    found = trained.scored.where(F.col("id") == account).first()
    if found is None:
        raise KeyError(f"no score for {account!r}")
    spark, model, edges = data.accounts.sparkSession, trained.detector, graph.edges_of(data.transactions)
    one = spark.createDataFrame([(account,)], "id string")
    changed = None
    if type(model) is detectors.NeighbourMean:
        scaled = cut(trained.pipeline.transform(unscaled_matrix(data, s)).na.fill(0.0), "scaled")
        base = [c for c in scaled.columns if c != "account_id"]
        weights = [model.model[i * len(base) : (i + 1) * len(base)] for i in range(model.layers + 1)]
        nodes = scaled.select(F.col("account_id").alias("id"), F.array(*[F.col(c).cast("double") for c in base]).alias("vec"))
        own = explain.edge_effects(nodes, edges, one, weights, model.model[-1]).select(F.col("target").alias("id"), "tx_id")
    else:
        positive = data.labels.where((F.col("entity_type") == "tx") & (F.col("label") == split.POSITIVE[split.dataset_of(data.name)])).select(F.col("entity_id").alias("tx_id"))
        own = edges.where((F.col("src") == account) | (F.col("dst") == account)).join(positive, "tx_id", "left_semi").select(F.lit(account).alias("id"), "tx_id")
    shares = explain.normalised(_attributed(trained, data, s).where(F.col("id") == account))
    top = shares.orderBy(F.desc("share"), "feature").first()
    if type(model) is detectors.NeighbourMean and top is not None:
        x = _inputs(model, scaled, data).where(F.col("account_id") == account).withColumnRenamed("account_id", "id")
        rest = {c: F.lit(float(v or 0.0)) for c, v in x.first().asDict().items() if c != "id"}
        changed = explain.counterfactual(x, top["feature"], lambda v: _linear_head(model)(rest | {top["feature"]: v}), s.training.alert_threshold).first().asDict()
    cycle = fx.cycle_flags(vertices_of(data), edges).where("motif_is_cycle = 1").where(F.col("id") == account).select("id")
    alert = spark.createDataFrame([(f"alert_{account}", account, float(found["score"]))], "alert_id string, account_id string, score double")
    record = cut(explain.evidence_records(alert, edges, own, shares, cycle), "record").withColumn("text", explain.narrative()).first().asDict(recursive=True)
    text = record.pop("text")
    return {"evidence": record, "narrative": text, "counterfactual": changed and {"feature": top["feature"], **changed}}


def write_reports(trained: Trained, folder: str) -> None:
    """metrics.json in the local folder, and the precision-recall curve beside it as lines of JSON."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    stores.write_report(trained.metrics, f"{folder}/metrics.json")
    stores.write_curve(metrics.pr_curve(trained.scored), f"{folder}/pr_curve")


def rings_table(data: CanonicalDataset, positive: str = "laundering") -> DataFrame:
    """Canonical rings from the components of positively labelled transactions."""
    labels = data.labels.where("entity_type = 'tx'").select(F.col("entity_id").alias("tx_id"), "label")
    found = iterate.laundering_rings(graph.edges_of(data.transactions).join(labels, "tx_id"), positive)
    return found.groupBy("ring_id").agg(F.to_json(F.sort_array(F.collect_set("member"))).alias("member_accounts")).withColumns({"pattern_type": F.lit("component"), "time_window": F.lit("[null, null]")})
