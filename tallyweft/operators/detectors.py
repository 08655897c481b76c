"""Detectors over feature frames, and graph layers as joins and array expressions."""

from __future__ import annotations

import json
from abc import ABC, abstractmethod
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyweft.operators.federated import mean_neighbours
from tallyweft.storage import cut

HEADS = 4


def class_weight(target: DataFrame) -> float:
    """Negatives per positive; raises if either class is missing."""
    n = target.agg(F.count_if(F.col("target") == 1).alias("p"), F.count_if(F.col("target") == 0).alias("n")).first()
    if not n["p"] or not n["n"]:
        raise ValueError("the training fold lacks positive or negative examples")
    return n["n"] / n["p"]


class Detector(ABC):
    """Fits on (account_id, features...) and (account_id, target); scores accounts between 0 and 1."""

    name = "detector"

    def __init__(self):
        self.model, self.columns = None, []

    def _joined(self, features: DataFrame, target: DataFrame) -> DataFrame:
        rows = features.join(target.select("account_id", "target"), "account_id")
        if rows.count() != features.count():
            raise KeyError("some training accounts have no target")
        return rows

    def _require(self) -> None:
        if self.model is None:
            raise RuntimeError("the detector is not fitted")

    @abstractmethod
    def fit(self, features: DataFrame, target: DataFrame) -> Detector: ...

    @abstractmethod
    def predict(self, features: DataFrame) -> DataFrame: ...

    @abstractmethod
    def importance(self) -> list[tuple[str, float]]: ...

    def metadata(self) -> dict:
        return {"name": self.name, "columns": self.columns}

    def save(self, folder: str) -> None:
        self._require()
        self.model.write().overwrite().save(f"{folder}/model")
        spark = self.model._java_obj and _session()
        spark.createDataFrame([(json.dumps(self.metadata()),)], "meta string").coalesce(1).write.mode("overwrite").json(f"{folder}/meta")

    @classmethod
    def _meta(cls, folder: str) -> dict:
        meta = json.loads(_session().read.json(f"{folder}/meta").first()["meta"])
        if meta["name"] != cls.name:
            raise TypeError(f"the folder holds a {meta['name']}, not a {cls.name}")
        return meta


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession()


class _MlDetector(Detector):
    """A ``pyspark.ml`` classifier over a vector of the feature columns."""

    def _vector(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.feature import VectorAssembler

        return VectorAssembler(inputCols=self.columns, outputCol="_x", handleInvalid="keep").transform(df.na.fill(0.0, self.columns))

    def _classifier(self):
        raise NotImplementedError

    def fit(self, features: DataFrame, target: DataFrame) -> Detector:
        self.columns = [c for c in features.columns if c != "account_id"]
        rows = self._joined(features, target)
        weight = class_weight(rows)
        rows = self._vector(rows).select("_x", F.col("target").cast("double").alias("label"), F.when(F.col("target") == 1, weight).otherwise(1.0).alias("_w")).persist()
        self.model = self._classifier().fit(rows)
        rows.unpersist()
        return self

    def predict(self, features: DataFrame) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        self._require()
        return self.model.transform(self._vector(features)).select("account_id", vector_to_array("probability")[1].alias("score"))


class BoostedTrees(_MlDetector):
    """Gradient-boosted trees with the fold's class weight."""

    name = "boosted_trees"

    def __init__(self, depth: int = 6, trees: int = 300, seed: int = 42):
        super().__init__()
        self.depth, self.trees, self.seed = depth, trees, seed

    def _classifier(self):
        from pyspark.ml.classification import GBTClassifier

        return GBTClassifier(featuresCol="_x", labelCol="label", weightCol="_w", maxDepth=self.depth, maxIter=self.trees, seed=self.seed)

    def importance(self) -> list[tuple[str, float]]:
        self._require()
        return sorted(zip(self.columns, self.model.featureImportances.toArray().tolist(), strict=True), key=lambda x: -x[1])

    def metadata(self) -> dict:
        return super().metadata() | {"depth": self.depth, "trees": self.trees}

    @classmethod
    def load(cls, folder: str) -> BoostedTrees:
        from pyspark.ml.classification import GBTClassificationModel

        meta = cls._meta(folder)
        out = cls(meta["depth"], meta["trees"])
        out.columns, out.model = meta["columns"], GBTClassificationModel.load(f"{folder}/model")
        return out


def logistic_fit(rows: DataFrame, columns: list[str], weight: Column | None = None, *, ridge: float = 1e-3, steps: int = 25, tol: float = 1e-8) -> list[float]:
    """Weights of the columns, then the bias, of a logistic regression of ``target`` by Newton steps.

    Each step is one pass: every task sums the gradient and the curvature of
    its rows, whose size does not depend on the rows, and the sums meet on the
    driver.  Columns are scaled by their deviation; missing values count as 0.
    """
    x = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]
    base = rows.select(F.array(*x).alias("x"), F.col("target").cast("double").alias("y"), (F.lit(1.0) if weight is None else weight).cast("double").alias("w"))
    stats = rows.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{k}{i}") for i, c in enumerate(x) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    if not stats["n"]:
        raise ValueError("no rows to learn from")
    mean = np.array([stats[f"m{i}"] for i in range(len(columns))])
    scale = np.array([stats[f"s{i}"] or 1.0 for i in range(len(columns))])
    beta, size = np.zeros(len(columns) + 1), len(columns) + 1

    def sums(now: np.ndarray):
        def run(frames):
            total = np.zeros(size * size + size + 1)
            for f in frames:
                if len(f):
                    a = np.column_stack([(np.stack(f["x"].to_numpy()) - mean) / scale, np.ones(len(f))])
                    w, p = f["w"].to_numpy(), 1 / (1 + np.exp(-np.clip(a @ now, -30, 30)))
                    total += np.concatenate([((a * (w * p * (1 - p))[:, None]).T @ a).ravel(), a.T @ (w * (p - f["y"].to_numpy())), [w.sum()]])
            yield pd.DataFrame({"sums": [total.tolist()]})

        return run

    for _ in range(steps):
        total = np.sum([r["sums"] for r in base.mapInPandas(sums(beta), "sums array<double>").collect()], axis=0)
        n = max(total[-1], 1e-12)
        held = ridge * np.append(np.ones(size - 1), 1e-9)
        step = np.linalg.solve(total[: size * size].reshape(size, size) / n + np.diag(held) + 1e-12 * np.eye(size), total[size * size : -1] / n + held * beta)
        beta = beta - step
        if np.abs(step).max() < tol:
            break
    plain = beta[:-1] / scale
    return [*plain.tolist(), float(beta[-1] - plain @ mean)]


class NeighbourMean(Detector):
    """A logistic head over an account's features and the means over its in-neighbours, hop by hop.

    Scoring is inductive: messages pass over the whole graph given, whatever
    accounts are asked for.  The head is its weights and the bias; scores are
    column expressions.
    """

    name = "neighbour_mean"

    def __init__(self, layers: int = 2, ridge: float = 1e-3):
        super().__init__()
        self.layers, self.ridge = layers, ridge

    def propagated(self, features: DataFrame, edges: DataFrame) -> DataFrame:
        """Features of each hop side by side: f, f_1, f_2, ..."""
        base = [c for c in features.columns if c != "account_id"]
        vec = features.select(F.col("account_id").alias("id"), F.array(*[F.col(c).cast("double") for c in base]).alias("vec"))
        out = features
        for hop in range(1, self.layers + 1):
            vec = mean_neighbours(vec, edges, len(base))
            out = out.join(vec.select(F.col("id").alias("account_id"), *[F.col("vec")[i].alias(f"{c}_{hop}") for i, c in enumerate(base)]), "account_id", "left")
        return out.na.fill(0.0)

    def fit(self, features: DataFrame, target: DataFrame) -> NeighbourMean:
        self.columns = [c for c in features.columns if c != "account_id"]
        rows = self._joined(features, target)
        weight = class_weight(rows)
        rows = cut(rows, "training")
        self.model = logistic_fit(rows, self.columns, F.when(F.col("target") == 1, weight).otherwise(1.0), ridge=self.ridge)
        return self

    def predict(self, features: DataFrame) -> DataFrame:
        self._require()
        return linear_scores(features.na.fill(0.0, self.columns), self.columns, self.model)

    def importance(self) -> list[tuple[str, float]]:
        self._require()
        return sorted(zip(self.columns, map(abs, self.model[:-1]), strict=True), key=lambda x: -x[1])

    def metadata(self) -> dict:
        return super().metadata() | {"layers": self.layers, "ridge": self.ridge, "weights": self.model}

    def save(self, folder: str) -> None:
        self._require()
        _session().createDataFrame([(json.dumps(self.metadata()),)], "meta string").coalesce(1).write.mode("overwrite").json(f"{folder}/meta")

    @classmethod
    def load(cls, folder: str) -> NeighbourMean:
        meta = cls._meta(folder)
        out = cls(meta["layers"], meta["ridge"])
        out.columns, out.model = meta["columns"], meta["weights"]
        return out


DETECTORS = {d.name: d for d in (BoostedTrees, NeighbourMean)}


def detector(name: str, **how) -> Detector:
    if name not in DETECTORS:
        raise KeyError(f"unknown detector {name!r}; known: {sorted(DETECTORS)}")
    return DETECTORS[name](**how)


def scores_of(scored: DataFrame, ids: DataFrame) -> DataFrame:
    """Scores of the wanted accounts; raises KeyError naming accounts without one."""
    missing = [r["account_id"] for r in ids.join(scored, "account_id", "left_anti").limit(5).collect()]
    if missing:
        raise KeyError(f"no score for {missing}")
    return scored.join(ids.select("account_id").distinct(), "account_id", "left_semi")


# --- graph layers -----------------------------------------------------------------------------


def _lit(v: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def matvec(weights: Sequence[Sequence[float]], vec: Column) -> Column:
    """A constant matrix (rows of the output) times a vector column."""
    return F.transform(F.array(*map(_lit, weights)), lambda row: _dot(row, vec))


def mean_layer(nodes: DataFrame, edges: DataFrame, neighbour: Sequence[Sequence[float]], own: Sequence[Sequence[float]], bias: Sequence[float], last: bool = False) -> DataFrame:
    """(id, vec): neighbour times the mean of the in-neighbours plus own times the vector plus bias; rectified unless last."""
    mean = mean_neighbours(nodes, edges, len(neighbour[0])).withColumnRenamed("vec", "mean")
    total = F.zip_with(F.zip_with(matvec(neighbour, F.col("mean")), matvec(own, F.col("vec")), lambda a, b: a + b), _lit(bias), lambda a, b: a + b)
    return nodes.join(mean, "id").select("id", (total if last else F.transform(total, lambda x: F.greatest(x, F.lit(0.0)))).alias("vec"))


def time_encoded(edges: DataFrame, weight: Sequence[float], bias: Sequence[float]) -> DataFrame:
    """Edges with ``time_vec``: recency, scaled by the longest (1 second at least), through one linear and then sine terms."""
    top = edges.agg(F.max("edge_time").alias("_top"), F.min("edge_time").alias("_low"))
    recency = (F.col("_top") - F.col("edge_time")) / F.greatest(F.col("_top") - F.col("_low"), F.lit(1.0))
    terms = F.transform(F.zip_with(_lit(weight), _lit(bias), lambda w, b: F.struct(w.alias("w"), b.alias("b"))), lambda p, i: F.when(i == 0, recency * p["w"] + p["b"]).otherwise(F.sin(recency * p["w"] + p["b"])))
    return edges.join(F.broadcast(top)).withColumn("time_vec", terms).drop("_top", "_low")


def attention(nodes: DataFrame, edges: DataFrame, heads: Sequence[dict]) -> DataFrame:
    """(tx_id, src, dst, head, alpha): softmax over each vertex's incoming edges.

    A head has ``weight`` (matrix), ``source``, ``target``, ``edge`` (vectors)
    and ``edge_weight`` (matrix over time vectors).  The largest logit is taken
    off before the exponential.
    """
    logits = []
    for h in heads:
        at = lambda vec, a, h=h: _dot(_lit(a), matvec(h["weight"], vec))
        raw = at(F.col("s"), h["source"]) + at(F.col("t"), h["target"]) + _dot(_lit(h["edge"]), matvec(h["edge_weight"], F.col("time_vec")))
        logits.append(F.when(raw > 0, raw).otherwise(raw * 0.2))
    ends = edges.join(nodes.select(F.col("id").alias("src"), F.col("vec").alias("s")), "src").join(nodes.select(F.col("id").alias("dst"), F.col("vec").alias("t")), "dst")
    flat = ends.select("tx_id", "src", "dst", F.posexplode(F.array(*logits)).alias("head", "logit"))
    part = W.partitionBy("dst", "head")
    weight = F.exp(F.col("logit") - F.max("logit").over(part))
    return flat.withColumn("e", weight).select("tx_id", "src", "dst", "head", (F.col("e") / F.sum("e").over(part)).alias("alpha"))


def attention_layer(nodes: DataFrame, edges: DataFrame, heads: Sequence[dict], last: bool = False) -> DataFrame:
    """(id, vec): the heads' attention-weighted sums of transformed neighbours, averaged; ELU unless last."""
    alpha = attention(nodes, edges, heads)
    moved = F.array(*[matvec(h["weight"], F.col("vec")) for h in heads])
    sent = alpha.join(nodes.select(F.col("id").alias("src"), moved.alias("m")), "src")
    width = len(heads[0]["weight"])
    own = F.element_at("m", F.col("head") + 1)
    # element-wise sums in one row from a task's partial sums on
    total = F.array(*[F.sum(F.col("alpha") * F.get("x", i)) / len(heads) for i in range(width)])
    summed = sent.select(F.col("dst").alias("id"), "alpha", own.alias("x")).groupBy("id").agg(total.alias("new"))
    vec = summed.select("id", ("new" if last else F.transform("new", lambda x: F.when(x > 0, x).otherwise(F.exp(x) - 1)).alias("new")))
    return nodes.join(vec, "id", "left").select("id", F.coalesce("new", _lit([0.0] * width)).alias("vec"))


def edge_attention(nodes: DataFrame, edges: DataFrame, heads: Sequence[dict]) -> DataFrame:
    """(tx_id, attention): the mean over the heads, for each edge."""
    return attention(nodes, edges, heads).groupBy("tx_id").agg(F.avg("alpha").alias("attention"))


# --- federated clients ------------------------------------------------------------------------


def local_fits(rows: DataFrame, columns: list[str], start: Sequence[float], *, epochs: int = 1, rate: float = 0.1, mu: float = 0.01, ridge: float = 1e-5) -> DataFrame:
    """(client, n, weights) after local training of a logistic model from ``start`` (weights, then bias).

    Each client's rows meet in one task, as they would at the institution;
    positives weigh negatives over positives, and 0.5 * mu * |w - start|^2
    holds the weights near the global ones.
    """
    first = np.asarray(start, float)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = np.column_stack([pdf[columns].to_numpy(float), np.ones(len(pdf))]), pdf["target"].to_numpy(float)
        weight = np.where(y == 1, (len(y) - y.sum()) / (y.sum() + 1e-9), 1.0)
        w = first.copy()
        for _ in range(epochs * 20):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            w -= rate * (x.T @ (weight * (p - y)) / len(y) + ridge * w + mu * (w - first))
        return pd.DataFrame({"client": [pdf["client"].iloc[0]], "n": [len(pdf)], "weights": [w.tolist()]})

    return rows.select("client", "target", *columns).groupBy("client").applyInPandas(fit, "client int, n long, weights array<double>")


def linear_scores(rows: DataFrame, columns: list[str], weights: Sequence[float]) -> DataFrame:
    z = F.lit(float(weights[-1]))
    for c, w in zip(columns, weights[:-1], strict=True):
        z = z + F.col(c) * F.lit(float(w))
    return rows.select("account_id", (1 / (1 + F.exp(-z))).alias("score"))
