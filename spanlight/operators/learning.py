"""Learned combinations of signals: standardised logistic regression and rank fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fit_logistic(rows: DataFrame, signals: list[str], label: str, c: float = 1.0, iterations: int = 50) -> dict:
    """Means, deviations, weights and intercept of an L2 logistic regression on complete rows, by distributed Newton steps.

    Each step is one aggregate of the gradient and the Hessian: the driver holds (signals + 1)^2 numbers. Signals without
    spread have weight 0. With one class or no rows the fit is None.
    """
    import numpy as np

    full = rows.select(*(F.col(s).cast("double").alias(f"x{k}") for k, s in enumerate(signals)), F.col(label).cast("double").alias("y")).dropna()
    m = len(signals)
    first = full.agg(F.count("*").alias("n"), F.sum("y").alias("p"), *(f(f"x{k}").alias(f"{t}{k}") for k in range(m) for t, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    if not first.n or first.p in (0.0, float(first.n)):
        return None
    mean, std = [first[f"m{k}"] for k in range(m)], [first[f"s{k}"] for k in range(m)]
    z = [((F.col(f"x{k}") - mean[k]) / std[k]) if std[k] else F.lit(0.0) for k in range(m)] + [F.lit(1.0)]
    w = np.zeros(m + 1)
    ridge = np.diag([1 / c] * m + [1e-9])
    for _ in range(iterations):
        score = sum((x * float(v) for x, v in zip(z, w)), F.lit(0.0))
        p = 1 / (1 + F.exp(-score))
        parts = [F.sum((p - F.col("y")) * x).alias(f"g{i}") for i, x in enumerate(z)]
        parts += [F.sum(p * (1 - p) * z[i] * z[j]).alias(f"h{i}_{j}") for i in range(m + 1) for j in range(i, m + 1)]
        row = full.agg(*parts).first()
        h = np.array([[row[f"h{min(i, j)}_{max(i, j)}"] for j in range(m + 1)] for i in range(m + 1)])
        step = np.linalg.solve(h + ridge, np.array([row[f"g{i}"] for i in range(m + 1)]) + ridge @ w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return {"signals": signals, "mean": mean, "std": std, "weights": w[:-1].tolist(), "intercept": float(w[-1])}


def predict_logistic(rows: DataFrame, model: dict, out: str = "probability") -> DataFrame:
    """rows with the model's probability, null where a signal is missing."""
    score = F.lit(model["intercept"])
    for s, m, d, w in zip(model["signals"], model["mean"], model["std"], model["weights"]):
        score = score + ((F.col(s).cast("double") - m) / d * w if d else F.col(s).cast("double") * 0.0)
    return rows.withColumn(out, 1 / (1 + F.exp(-score)))


def rank_fusion(rows: DataFrame, signals: list[str], group: list[str] | None = None) -> DataFrame:
    """rows with rank_mean and rank_max of the signals' average ranks over n."""
    parts = group or [F.lit(1)]
    n = F.count("*").over(Window.partitionBy(*parts))

    def rank(s: str):
        return (F.rank().over(Window.partitionBy(*parts).orderBy(s)) + (F.count("*").over(Window.partitionBy(*parts, s)) - 1) / 2) / n

    ranked = rows.select("*", *(rank(s).alias(f"__r{k}") for k, s in enumerate(signals)))
    columns = [F.col(f"__r{k}") for k in range(len(signals))]
    mean = sum(columns[1:], columns[0]) / len(columns)
    return ranked.withColumn("rank_mean", mean).withColumn("rank_max", F.greatest(*columns) if len(columns) > 1 else columns[0]).drop(*(f"__r{k}" for k in range(len(signals))))


def one_standard_error(grid: DataFrame, score: str, error: str, simplicity: str) -> DataFrame:
    """The simplest candidate whose score is at least the best score less its standard error."""
    best = grid.orderBy(F.desc(score), simplicity).limit(1).select((F.col(score) - F.col(error)).alias("__floor"))
    return grid.crossJoin(F.broadcast(best)).filter(F.col(score) >= F.col("__floor")).drop("__floor").orderBy(simplicity, F.desc(score)).limit(1)
