"""A detector with a hidden layer and two heads, trained by passes over a Spark table.

One head classifies accounts, the other tells which motifs they lie on; both
share the hidden layer, so that the motifs teach it what the few labels do
not.  An epoch is one pass: every task sums the gradient of its rows, the
sums meet in a few groups of tasks, and the driver gets a row for each group,
whose size depends on the network alone.  Scores are column expressions.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweft.operators.detectors import DETECTORS, NeighbourMean, _session, class_weight
from tallyweft.storage import cut

#: Groups in which the tasks' sums meet.
GROUPS = 16
#: Share of the rows held out, in hundredths, from so many rows on.
HELD, FROM = 15, 10


@dataclass
class Shape:
    """Sizes of the network, and its parameters as parts of one array."""

    inputs: int
    hidden: int
    motifs: int

    def parts(self, flat: np.ndarray) -> list[np.ndarray]:
        shapes = [(self.hidden, self.inputs), (self.hidden,), (self.hidden,), (1,), (self.motifs, self.hidden), (self.motifs,)]
        out, at = [], 0
        for s in shapes:
            n = int(np.prod(s))
            out.append(flat[at : at + n].reshape(s))
            at += n
        return out

    @property
    def size(self) -> int:
        return self.hidden * (self.inputs + 2) + 1 + self.motifs * (self.hidden + 1)

    def start(self, seed: int) -> np.ndarray:
        return np.random.default_rng(seed).normal(0, 1 / np.sqrt(max(self.inputs, 1)), self.size)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _cross(p: np.ndarray, y: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-12, 1 - 1e-12)
    return -(y * np.log(p) + (1 - y) * np.log(1 - p))


def gradient(shape: Shape, flat: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, m: np.ndarray, motif_weight: float) -> tuple[np.ndarray, float]:
    """Sums over the rows of the gradient and of the loss: weighted cross entropy of the label, plus ``motif_weight`` times the mean over the motifs."""
    inner, bias, head, head_bias, motif, motif_bias = shape.parts(flat)
    z = x @ inner.T + bias
    h = np.maximum(z, 0)
    p, q = _logistic(h @ head + head_bias[0]), _logistic(h @ motif.T + motif_bias)
    share = motif_weight / max(shape.motifs, 1)
    loss = (w * _cross(p, y)).sum() + share * _cross(q, m).sum()
    dp, dq = w * (p - y), share * (q - m)
    dz = (np.outer(dp, head) + dq @ motif) * (z > 0)
    parts = [dz.T @ x, dz.sum(axis=0), h.T @ dp, [dp.sum()], dq.T @ h, dq.sum(axis=0)]
    return np.concatenate([np.ravel(a) for a in parts]), float(loss)


@dataclass
class Fitted:
    """The parameters of the best epoch, the columns' means and scales, and a row (epoch, loss, held_loss) for each epoch."""

    shape: Shape
    flat: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    log: list[dict]


def fit(rows: DataFrame, columns: Sequence[str], motifs: Sequence[str], weight: float = 1.0, *, hidden: int = 16, motif_weight: float = 0.5, epochs: int = 50, rate: float = 0.05, decay: float = 1e-5, patience: int = 5, seed: int = 42) -> Fitted:
    """Train on (account_id, target, columns..., motifs...) rows; positives weigh ``weight``.

    From FROM rows on, HELD hundredths of the accounts, by a hash of their
    ids, are held out; training stops after ``patience`` epochs without a
    lower loss on them, and the parameters of the best epoch are kept.  Each
    epoch is one step of Adam over all rows, so the result does not depend on
    the partitions.  Missing values count as 0.
    """
    x = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]
    m = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in motifs]
    kept = rows.select(F.array(*x).alias("x"), F.array(*m).cast("array<double>").alias("m"), F.col("target").cast("double").alias("y"), F.pmod(F.xxhash64("account_id", F.lit(seed)), F.lit(100)).alias("held"))
    base = cut(kept, "two-heads")
    n = base.count()
    if not n:
        raise ValueError("no rows to learn from")
    held = HELD if n >= FROM and not base.where(F.col("held") < HELD).isEmpty() else 0
    stats = base.where(F.col("held") >= held).agg(*[f(F.col("x")[i]).alias(f"{k}{i}") for i in range(len(x)) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    mean = np.array([stats[f"m{i}"] or 0.0 for i in range(len(x))])
    scale = np.array([stats[f"s{i}"] or 1.0 for i in range(len(x))])
    shape = Shape(len(x), hidden, len(m))

    def sums(flat: np.ndarray):
        def run(frames):
            from pyspark import TaskContext

            total = np.zeros(shape.size + 4)  # and the losses and rows of both parts
            for f in frames:
                if not len(f):
                    continue
                a = (np.stack(f["x"].to_numpy()) - mean) / scale
                y, mot = f["y"].to_numpy(), np.array(f["m"].to_list(), float).reshape(len(f), shape.motifs)
                out = f["held"].to_numpy() < held
                w = np.where(y == 1, weight, 1.0)
                g, loss = gradient(shape, flat, a[~out], y[~out], w[~out], mot[~out], motif_weight)
                total += np.concatenate([g, [loss, (~out).sum(), gradient(shape, flat, a[out], y[out], w[out], mot[out], motif_weight)[1], out.sum()]])
            yield pd.DataFrame({"group": [TaskContext.get().partitionId() % GROUPS], "sums": [total.tolist()]})

        return run

    def met(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"sums": [np.sum(np.stack(pdf["sums"].to_numpy()), axis=0).tolist()]})

    flat = shape.start(seed)
    best, least, worse, log = flat, np.inf, 0, []
    first, second = np.zeros(shape.size), np.zeros(shape.size)
    for epoch in range(1, epochs + 1):
        met_rows = base.mapInPandas(sums(flat), "group int, sums array<double>").groupBy("group").applyInPandas(met, "sums array<double>").collect()
        total = np.sum([r["sums"] for r in met_rows], axis=0)
        g = total[: shape.size] / max(total[-3], 1) + decay * flat
        loss = total[-4] / max(total[-3], 1)
        judged = total[-2] / total[-1] if total[-1] else loss
        log.append({"epoch": epoch, "loss": float(loss), "held_loss": float(judged)})
        if judged < least:
            best, least, worse = flat, judged, 0
        else:
            worse += 1
            if worse >= patience:
                break
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        flat = flat - rate * (first / (1 - 0.9**epoch)) / (np.sqrt(second / (1 - 0.999**epoch)) + 1e-8)
    return Fitted(shape, best, mean, scale, log)


def _linear(x: list[Column], w: np.ndarray, b: float) -> Column:
    out = F.lit(float(b))
    for c, v in zip(x, w.tolist(), strict=True):
        out = out + c * F.lit(v)
    return out


class TwoHeads(NeighbourMean):
    """The two heads over an account's features and the means over its in-neighbours, hop by hop."""

    name = "two_heads"

    def __init__(self, layers: int = 2, hidden: int = 16, motif_weight: float = 0.5, epochs: int = 50, rate: float = 0.05, decay: float = 1e-5, patience: int = 5, seed: int = 42):
        super().__init__(layers)
        self.how = {"hidden": hidden, "motif_weight": motif_weight, "epochs": epochs, "rate": rate, "decay": decay, "patience": patience, "seed": seed}

    def fit(self, features: DataFrame, target: DataFrame, motifs: DataFrame | None = None) -> TwoHeads:
        """``motifs`` are (account_id, motif columns...) of the training accounts; without them the second head has nothing to learn."""
        self.columns = [c for c in features.columns if c != "account_id"]
        rows = self._joined(features, target)
        weight = class_weight(rows)
        names = [c for c in motifs.columns if c != "account_id"] if motifs is not None else []
        if names:
            taught = motifs.select("account_id", *[F.col(c).alias(f"_motif_{c}") for c in names])
            rows = rows.join(taught, "account_id", "left")
        self.model = fit(rows, self.columns, [f"_motif_{c}" for c in names], weight, **self.how)
        return self

    def predict(self, features: DataFrame) -> DataFrame:
        self._require()
        f = self.model
        inner, bias, head, head_bias, _, _ = f.shape.parts(f.flat)
        inner, bias = inner / f.scale, bias - (inner / f.scale) @ f.mean
        x = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in self.columns]
        hidden = features.select("account_id", *[F.greatest(_linear(x, w, b), F.lit(0.0)).alias(f"_h{i}") for i, (w, b) in enumerate(zip(inner, bias, strict=True))])
        z = _linear([F.col(f"_h{i}") for i in range(f.shape.hidden)], head, head_bias[0])
        return hidden.select("account_id", (1 / (1 + F.exp(-z))).alias("score"))

    def importance(self) -> list[tuple[str, float]]:
        """Absolute weights along all ways from a column to the score."""
        self._require()
        inner, _, head, _, _, _ = self.model.shape.parts(self.model.flat)
        return sorted(zip(self.columns, (np.abs(head) @ np.abs(inner)).tolist(), strict=True), key=lambda x: -x[1])

    def metadata(self) -> dict:
        f = self.model
        return {"name": self.name, "columns": self.columns, "layers": self.layers, "how": self.how, "shape": [f.shape.inputs, f.shape.hidden, f.shape.motifs], "flat": f.flat.tolist(), "mean": f.mean.tolist(), "scale": f.scale.tolist(), "log": f.log}

    def save(self, folder: str) -> None:
        self._require()
        _session().createDataFrame([(json.dumps(self.metadata()),)], "meta string").coalesce(1).write.mode("overwrite").json(f"{folder}/meta")

    @classmethod
    def load(cls, folder: str) -> TwoHeads:
        meta = cls._meta(folder)
        out = cls(meta["layers"], **meta["how"])
        out.columns = meta["columns"]
        out.model = Fitted(Shape(*meta["shape"]), np.array(meta["flat"]), np.array(meta["mean"]), np.array(meta["scale"]), meta["log"])
        return out


DETECTORS[TwoHeads.name] = TwoHeads
