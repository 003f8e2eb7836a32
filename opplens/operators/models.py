"""Small models by full-batch steps over weighted distinct rows: each step is one aggregation, or, while they are few, one product."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .features import running_before


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def linear(weights: np.ndarray, features: list[str]) -> Column:
    """Intercept first, then one weight a feature."""
    return sum((F.lit(float(w)) * F.col(f) for w, f in zip(weights[1:], features)), F.lit(float(weights[0])))


def logit(p: float) -> float:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return float(np.log(p / (1 - p)))


def fit_logistic(rows: DataFrame, features: list[str], label: str, steps: int = 400, rate: float = 0.05, l2: float = 1.0) -> np.ndarray:
    """Gradient descent on the mean log loss with l2 on the coefficients; the intercept starts at the logit of the mean label.

    One class only gives a constant model. Rows with equal features and label are one weighted row; rows without a value in a feature or the label are left out.
    """
    kept = rows.dropna(subset=[*features, label]).groupBy(*features, label).agg(F.count(F.lit(1)).alias("__n")).persist()
    try:
        n, ones = kept.agg(F.sum("__n"), F.sum(F.col("__n") * F.col(label))).first()
        w = np.zeros(len(features) + 1)
        if not n:
            return w
        w[0] = logit(ones / n)
        if ones in (0, n):
            return w
        return _descend(kept, features, label, w, n, steps, rate, l2)
    finally:
        kept.unpersist()


#: Distinct rows up to which a fit takes its steps over them on the driver; more are aggregated by Spark in each step.
FEW = 50_000


def _descend(kept: DataFrame, features: list[str], label: str, w: np.ndarray, n: int, steps: int, rate: float, l2: float) -> np.ndarray:
    few = kept.select(*[F.col(c).cast("double") for c in (*features, label, "__n")]).limit(FEW + 1).toPandas().to_numpy()
    if len(few) <= FEW:
        x = np.column_stack([np.ones(len(few)), few[:, : len(features)]])
        y, times = few[:, -2], few[:, -1]
        for _ in range(steps):
            slope = ((1 / (1 + np.exp(-(x @ w))) - y) * times) @ x / n
            slope[1:] += l2 * w[1:]
            w = w - rate * slope
        return w
    for _ in range(steps):
        miss = (sigmoid(linear(w, features)) - F.col(label)) * F.col("__n")
        slope = np.array(kept.agg(F.sum(miss), *[F.sum(miss * F.col(f)) for f in features]).first(), float) / n
        slope[1:] += l2 * w[1:]
        w = w - rate * slope
    return w


def fit_platt(rows: DataFrame, probability: str, label: str, steps: int = 250, rate: float = 0.03) -> np.ndarray:
    """Intercept and slope over the logit of a probability; they start at 0 and 1, which changes nothing, and stay so without rows."""
    p = F.least(F.greatest(F.col(probability), F.lit(1e-6)), F.lit(1 - 1e-6))
    kept = rows.dropna(subset=[probability, label]).select(F.log(p / (1 - p)).alias("x"), F.col(label).alias("y")).groupBy("x", "y").agg(F.count(F.lit(1)).alias("__n")).persist()
    try:
        n = kept.agg(F.sum("__n")).first()[0]
        w = np.array([0.0, 1.0])
        return _descend(kept, ["x"], "y", w, n, steps, rate, 0.0) if n else w
    finally:
        kept.unpersist()


def edge_status(n: int, brier: float | None, prior: float | None, auc: float | None, later: float | None) -> str:
    """Whether a model predicts better than the prior: by its Brier improvement, its AUC and the improvement in later folds."""
    if n < 20 or brier is None or prior is None or later is None:
        return "INSUFFICIENT_DATA"
    better = prior - brier
    if better >= 0.01 and auc is not None and auc >= 0.55 and later > 0:
        return "DEMONSTRATED"
    return "WEAK" if (better >= 0.005 or auc is not None and auc >= 0.52) and later >= 0 else "NOT_DEMONSTRATED"


def edge(n: Column, model: Column, prior: Column, auc: Column, later: Column) -> Column:
    """edge_status as a column; a NULL AUC reaches no bound."""
    better, reaches = prior - model, lambda bound: F.coalesce(auc >= bound, F.lit(False))
    few = (n < 20) | model.isNull() | prior.isNull() | later.isNull()
    return F.when(few, "INSUFFICIENT_DATA").when((better >= 0.01) & reaches(0.55) & (later > 0), "DEMONSTRATED").when(((better >= 0.005) | reaches(0.52)) & (later >= 0), "WEAK").otherwise("NOT_DEMONSTRATED")


def edge_by(rows: DataFrame, by: list[str], score: str, label: str, prior: str) -> DataFrame:
    """(by, n, model, baseline, auc): Brier scores of the score and the prior, and the AUC with ties at their mean rank, from counts by
    distinct score, so that no task ranks a group. Groups must not be null."""
    y = F.col(label)
    scores = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(score) - y) ** 2).alias("model"), F.avg((F.col(prior) - y) ** 2).alias("baseline"))
    kinds = rows.where(F.col(score).isNotNull() & y.isNotNull()).groupBy(*by, score).agg(F.sum(y.cast("long")).alias("__p"), F.count(F.lit(1)).alias("__c"))
    placed = running_before(kinds, score, "__c", "__below", group=by)
    ranks = placed.groupBy(*by).agg(F.sum(F.col("__p") * (F.col("__below") + (F.col("__c") + 1) / 2)).alias("k"), F.sum("__p").alias("p"), F.sum("__c").alias("c"))
    auc = F.try_divide(F.col("k") - F.col("p") * (F.col("p") + 1) / 2, (F.col("p") * (F.col("c") - F.col("p"))).cast("double"))
    return scores.join(ranks.select(*by, auc.alias("auc")), by, "left")


def scored(ready: Column, conflict: Column, far: Column, completeness: Column, regime: Column, opinion: Column, neighbours: Column, calibrated: Column) -> Column:
    """struct<status, reason, confidence>: the first reason to have no opinion, else how far the score can be trusted."""
    why = F.when(~ready, "INSUFFICIENT_DATA").when(conflict, "FEATURE_CONFLICT").when(far, "OUT_OF_DISTRIBUTION").when(completeness < 0.25, "INSUFFICIENT_FEATURES")
    trust = F.when((completeness >= 0.75) & (regime == "HIGH") & (opinion == "OK") & (neighbours >= 10) & calibrated, "HIGH").when((completeness >= 0.5) & (opinion == "OK") & (neighbours >= 3), "MEDIUM").otherwise("LOW")
    return F.struct(F.when(why.isNull(), "OK").otherwise("NO_OPINION").alias("status"), F.coalesce(why, F.lit("SUPPORTED")).alias("reason"), F.when(why.isNull(), trust).otherwise("NO_OPINION").alias("confidence"))


def fit_ridge(rows: DataFrame, features: list[str], target: str, l2: float = 1.0) -> np.ndarray:
    """Normal equations from one aggregation; the intercept is not penalised."""
    x = [F.lit(1.0), *[F.col(f).cast("double") for f in features]]
    k = len(x)
    upper = [(i, j) for i in range(k) for j in range(i, k)]
    sums = rows.dropna(subset=[*features, target]).agg(*[F.sum(x[i] * x[j]) for i, j in upper], *[F.sum(v * F.col(target)) for v in x]).first()
    gram = np.zeros((k, k))
    for (i, j), v in zip(upper, sums):
        gram[i, j] = gram[j, i] = v or 0.0
    gram[range(1, k), range(1, k)] += l2
    return np.linalg.lstsq(gram, np.array([v or 0.0 for v in sums[len(upper) :]]), rcond=None)[0]


def walk_forward(rows: DataFrame, fold: str, folds: list, fit, score) -> DataFrame:
    """Each fold scored by the model that fit gives from the folds before it: fit(rows) to a model, score(rows, model) to rows."""
    out = None
    for i in range(1, len(folds)):
        part = score(rows.where(F.col(fold) == folds[i]), fit(rows.where(F.col(fold).isin(folds[:i]))))
        out = part if out is None else out.unionByName(part)
    return out


def probability_metrics(p: Column, y: Column) -> list[Column]:
    inside = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
    return [F.count(F.lit(1)).alias("n"), F.avg((p - y) * (p - y)).alias("brier"), F.avg(-(y * F.log(inside) + (1 - y) * F.log(1 - inside))).alias("log_loss")]
