"""Logistic models of many families and folds, fitted in one job.

A model belongs to a family and leaves one fold out. In each Newton step every row adds its share of the gradient and of the Hessian to the models of its
family that don't leave it out: one small array for each batch of rows and model. Spark adds these up by model, and each model's small system is solved where its sums are. The number of jobs is that
of the steps, not of the models.

Features are standardised by the rows that a model learns from, classes weigh the same (each row n / 2 n_class), the penalty is half the squared length of the
weights (the intercept is free), which keeps separable classes finite.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandflow.sources.shared import save

STEPS = 25
TOLERANCE = 1e-8


def models(rows: DataFrame, features: list[str], family: str, fold: str, label: str) -> DataFrame:
    """One row per family and fold left out: means, deviations and class weights of what it learns from, weights of zero."""
    sums = [F.sum(f).alias(f"s_{f}") for f in features] + [F.sum(F.col(f) * F.col(f)).alias(f"q_{f}") for f in features]
    y = F.col(label)
    part = rows.groupBy(family, fold).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("p"), *sums)
    whole = part.groupBy(family).agg(*[F.sum(c).alias(f"_{c}") for c in part.columns if c not in (family, fold)])
    left = part.join(whole, family).select(family, fold, *[(F.col(f"_{c}") - F.col(c)).alias(c) for c in part.columns if c not in (family, fold)])
    left = left.where("p > 0 AND p < n")
    mean = {f: F.col(f"s_{f}") / F.col("n") for f in features}
    deviation = {f: F.sqrt(F.greatest(F.col(f"q_{f}") / F.col("n") - mean[f] * mean[f], F.lit(0.0))) for f in features}
    return left.select(
        family, fold, F.array(*mean.values()).alias("mean"), F.array(*[F.when(v > 1e-12, v).otherwise(1.0) for v in deviation.values()]).alias("deviation"),
        (F.col("n") / (2 * F.col("p"))).alias("w1"), (F.col("n") / (2 * (F.col("n") - F.col("p")))).alias("w0"), F.array_repeat(F.lit(0.0), len(features) + 1).alias("beta"), F.lit(float("inf")).alias("step"),
    )


def standardised(features: list[str]) -> list[Column]:
    return [F.lit(1.0), *[(F.col(f) - F.col("mean")[i]) / F.col("deviation")[i] for i, f in enumerate(features)]]


def probability(features: list[str]) -> Column:
    z = sum((F.col("beta")[i] * x for i, x in enumerate(standardised(features))), F.lit(0.0))
    return 1 / (1 + F.exp(-z))


def _shares(features: list[str], family: str, fold: str, label: str):
    """For each model in a batch of rows: the gradient and the Hessian of these rows, as one array."""

    def run(batches):
        for pdf in batches:
            out = []
            for key, part in pdf.groupby([family, fold], sort=False):
                one = part.iloc[0]
                x = np.hstack([np.ones((len(part), 1)), (part[features].to_numpy(float) - one["mean"]) / one["deviation"]])
                y = part[label].to_numpy(float)
                p = 1 / (1 + np.exp(-(x @ np.asarray(one["beta"]))))
                w = np.where(y == 1, one["w1"], one["w0"])
                out.append((*key, np.concatenate([x.T @ (w * (p - y)), ((x * (w * p * (1 - p))[:, None]).T @ x).ravel()]).tolist()))
            yield pd.DataFrame(out, columns=[family, fold, "sums"])

    return run


def _newton(size: int, kept: list[str], ridge: float):
    def run(batches):
        for pdf in batches:
            out = pdf[kept].copy()
            sums = np.array([[v["v"] for v in row] for row in pdf["sums"]], float).reshape(len(pdf), -1)
            g, h = sums[:, :size], sums[:, size:].reshape(-1, size, size)
            penalty = np.diag([0.0] + [ridge] * (size - 1))
            beta = np.array(pdf["beta"].tolist(), float).reshape(len(pdf), size)
            step = [np.linalg.solve(a + penalty, b + penalty @ c) for a, b, c in zip(h, g, beta, strict=True)]
            out["beta"] = [(b - s).tolist() for b, s in zip(beta, step, strict=True)]
            out["step"] = [float(np.abs(s).max()) for s in step]
            yield pd.DataFrame(out)

    return run


def fit(rows: DataFrame, features: list[str], family: str, fold: str, label: str, ridge: float = 1.0) -> DataFrame:
    """The models (family, fold left out, mean, deviation, beta with the intercept first) of rows without null features."""
    size = len(features) + 1
    now = save(models(rows, features, family, fold, label))
    types = dict(now.dtypes)
    for _ in range(STEPS):
        one = rows.select(F.col(fold).alias("_fold"), family, label, *features).join(now, family).where(F.col("_fold") != F.col(fold)).drop("_fold", "step")
        sums = one.mapInPandas(_shares(features, family, fold, label), f"{family} {types[family]}, {fold} {types[fold]}, sums array<double>")
        sums = sums.select(family, fold, F.posexplode("sums").alias("i", "v")).groupBy(family, fold, "i").agg(F.sum("v").alias("v"))
        totals = now.join(sums.groupBy(family, fold).agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("sums")), [family, fold])
        now = save(totals.mapInPandas(_newton(size, now.columns, ridge), now.schema))
        if (now.agg(F.max("step")).first()[0] or 0.0) < TOLERANCE:
            break
    return now


def scored(rows: DataFrame, fitted: DataFrame, features: list[str], family: str, fold: str) -> DataFrame:
    """rows with score, the probability that the model gives that leaves their fold out."""
    kept = rows.columns
    return rows.join(fitted, [family, fold]).withColumn("score", probability(features)).select(*kept, "score")
