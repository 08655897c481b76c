"""Evaluation of scored entities: rows of (id, label 0/1, score double).

Curves are made from one row per distinct score (an aggregation), then
cumulative sums in order of score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyweft.functions.scalar import ratio
from tallyweft.operators.ranks import running_totals
from tallyweft.storage import cut


def _count(when: Column, weight: str | None = None) -> Column:
    """How many rows the condition holds for; with ``weight``, a column of counts, how many a row stands for."""
    return F.count(F.when(when, 1)) if weight is None else F.coalesce(F.sum(F.when(when, F.col(weight))), F.lit(0))


def threshold_metrics(scored: DataFrame, threshold: float = 0.5, by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """Precision, recall and F1 (0 where undefined), alerts, false share (null without alerts), sizes; one aggregation."""
    hit, true = F.col("score") >= threshold, F.col("label") == 1
    count = lambda when: _count(when, weight)
    g = scored.groupBy(*(by or [])).agg(count(hit & true).alias("tp"), count(hit).alias("total_alerts"), count(true).alias("n_positive"), count(F.lit(True)).alias("n_samples"))
    tp, alerts, pos = F.col("tp"), F.col("total_alerts"), F.col("n_positive")
    return g.select(
        *(by or []), ratio(tp, alerts).alias("precision"), ratio(tp, pos).alias("recall"), ratio(2 * tp, alerts + pos).alias("f1"), "total_alerts",
        ratio(alerts - tp, alerts, None).alias("false_alert_fraction"), "n_samples", "n_positive", ratio(pos, F.col("n_samples")).alias("positive_rate"),
    )


def threshold_sweep(scored: DataFrame, steps: int = 19) -> DataFrame:
    """The same at thresholds i / (steps + 1): each row is counted into its bin, the bins are summed from above."""
    true = (F.col("label") == 1).cast("long")
    # the number of thresholds that the score reaches, by the very comparisons of the definition
    reached = F.size(F.filter(F.sequence(F.lit(1), F.lit(steps)), lambda i: F.col("score") >= i / F.lit(float(steps + 1))))
    bins = scored.groupBy(reached.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum(true).alias("pos"))
    grid = scored.sparkSession.range(0, steps + 1, 1, 1).select(F.col("id").cast("int").alias("bin")).join(bins, "bin", "left").na.fill(0)
    above = W.orderBy(F.desc("bin")).rowsBetween(W.unboundedPreceding, 0)
    all_ = W.partitionBy(F.lit(0))
    cum = grid.select("bin", F.sum("n").over(above).alias("total_alerts"), F.sum("pos").over(above).alias("tp"), F.sum("pos").over(all_).alias("positives"))
    tp, alerts, pos = F.col("tp"), F.col("total_alerts"), F.col("positives")
    return cum.where("bin > 0").select(
        (F.col("bin") / F.lit(float(steps + 1))).alias("threshold"), ratio(tp, alerts).alias("precision"), ratio(tp, pos).alias("recall"),
        ratio(2 * tp, alerts + pos).alias("f1"), "total_alerts", ratio(alerts - tp, alerts, None).alias("false_alert_fraction"),
    )


def _top(scored: DataFrame, k: int) -> DataFrame:
    """The k best by score, ties by id (a limited sort: each task keeps k rows)."""
    return scored.orderBy(F.desc("score"), "id").limit(k)


def precision_at_k(scored: DataFrame, ks: list[int]) -> DataFrame:
    """(k, k_used, precision): of the min(k, n) best; null if k is not positive or there are no rows."""
    most = max([0, *ks])
    ranked = _top(scored, most).withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "id"))) if most > 0 else scored.withColumn("rank", F.lit(0)).limit(0)
    grid = scored.sparkSession.createDataFrame([(k,) for k in ks], "k int")
    joined = grid.join(F.broadcast(ranked.select("rank", "label")), F.col("rank") <= F.col("k"), "left")
    g = joined.groupBy("k").agg(F.count("rank").alias("k_used"), F.sum("label").alias("hits"))
    return g.select("k", "k_used", ratio(F.col("hits"), F.when(F.col("k_used") > 0, F.col("k_used")), None).alias("precision"))


def recall_at_budget(scored: DataFrame, budget: int) -> DataFrame:
    """(budget, recall): share of all positives among the budget's best; null without positives."""
    hits = _top(scored, max(0, budget)).agg(F.coalesce(F.sum("label"), F.lit(0)).alias("hits"))
    total = scored.agg(_count(F.col("label") == 1).alias("n"))
    return hits.join(F.broadcast(total)).select(F.lit(budget).alias("budget"), ratio(F.col("hits"), F.col("n"), None).alias("recall"))


def by_score(scored: DataFrame, by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """Positives and negatives at each distinct score, best first, with sums up to it and the totals."""
    by = by or []
    count = lambda label: _count(F.col("label") == label, weight)
    g = scored.groupBy(*by, "score").agg(count(1).alias("p"), count(0).alias("n"))
    curve = running_totals(g, F.desc("score"), {"tp": "p", "fp": "n"}, by)
    total = scored.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(count(1).alias("positives"), count(0).alias("negatives"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return curve.join(total if by else F.broadcast(total), same).drop(*[f"_{c}" for c in by])


def roc_auc(scored: DataFrame, by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """Area under the ROC curve by midranks (ties count half); null with one class only."""
    c = by_score(scored, by, weight)
    # each positive beats the negatives below its score and half of those at it
    wins = F.sum(F.col("p") * ((F.col("negatives") - F.col("fp")) + F.col("n") / 2))
    return c.groupBy(*(by or [])).agg(ratio(wins, F.first("positives") * F.first("negatives"), None).alias("auc"))


def average_precision(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sum over distinct scores, best first, of the gain in recall times precision; null without positives."""
    c = by_score(scored, by)
    return c.groupBy(*(by or [])).agg(ratio(F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))), F.first("positives"), None).alias("average_precision"))


def pr_curve(scored: DataFrame) -> DataFrame:
    """(threshold, precision, recall) at each distinct score."""
    c = by_score(scored)
    return c.select(F.col("score").alias("threshold"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), ratio(F.col("tp"), F.col("positives")).alias("recall"))


def require_two_classes(scored: DataFrame) -> None:
    n = scored.agg(F.countDistinct("label")).first()[0]
    if n < 2:
        raise ValueError("both classes are needed")


def client_validation(scored: DataFrame, by: str = "client") -> DataFrame:
    """(client, loss, n, auc) of each client's held-out rows; an AUC is 0.5 where a client has one class."""
    return log_loss(scored, [by]).join(roc_auc(scored, [by]), by).withColumn("auc", F.coalesce("auc", F.lit(0.5)))


def log_loss(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(loss, n): mean negative log likelihood, scores held within 1e-15 of 0 and 1; 0 for no rows."""
    p = F.least(F.greatest(F.col("score"), F.lit(1e-15)), F.lit(1 - 1e-15))
    each = -F.when(F.col("label") == 1, F.ln(p)).otherwise(F.ln(1 - p))
    return scored.groupBy(*(by or [])).agg(F.coalesce(F.avg(each), F.lit(0.0)).alias("loss"), F.count(F.lit(1)).alias("n"))


def segment_comparison(scored: DataFrame, segments: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """Metrics of each model overall and in each segment: (model, segment, metrics...).

    ``scored`` has (model, id, label, score), ``segments`` (id, segment); ids
    without one are ``isolated``.  Without ``segments``, ``scored`` has a
    column ``segment`` itself, and its rows are not joined.

    Equal rows are counted first, and the counts are written: the table is
    read once, and what follows works on a row for each distinct score.
    """
    named = scored if segments is None else scored.join(segments, "id", "left")
    named = named.groupBy("model", "label", "score", F.coalesce("segment", F.lit("isolated")).alias("segment")).agg(F.count(F.lit(1)).alias("_n"))
    named = cut(named, "compared")
    both = named.select("model", "label", "score", "_n", F.explode(F.array(F.lit("overall"), F.col("segment"))).alias("segment"))
    by = ["model", "segment"]
    return threshold_metrics(both, threshold, by, "_n").join(roc_auc(both, by, "_n"), by)


def same_test_set(scored: DataFrame) -> None:
    """Raise unless there are two models at least and all of them scored the same ids."""
    n = scored.select("model").distinct().count()
    if n < 2:
        raise ValueError("two models at least are needed")
    if not scored.groupBy("id").agg(F.countDistinct("model").alias("m")).where(F.col("m") < n).isEmpty():
        raise ValueError("the models were scored on different test sets")
