"""Multinomial logistic regression for all held-out folds at once, by Newton steps.

A pass over the rows gives every fold's model its loss, gradient and Hessian, summed in tasks before
anything is shuffled; what comes to the driver is as large as the models. Means, deviations and class
weights of a fold's training rows are the sums over all rows minus the fold's own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.sources.scratch import cut


@dataclass
class Model:
    """Standardised features x -> softmax(w[:, :-1] x + w[:, -1]); weight: a row's by its class."""

    mean: np.ndarray
    deviation: np.ndarray
    weight: np.ndarray
    w: np.ndarray

    def design(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([(x - self.mean) / self.deviation, np.ones(len(x))])

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self.design(x) @ self.w.T
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def derivatives(model: Model, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Loss, gradient and upper triangle of the Hessian over rows, in one vector; the penalty isn't in it."""
    a, k = model.design(x), len(model.w)
    p = model.probabilities(x)
    weight = model.weight[y]
    loss = -(weight * np.log(np.maximum(p[np.arange(len(y)), y], 1e-300))).sum()
    off = p.copy()
    off[np.arange(len(y)), y] -= 1
    gradient = (off * weight[:, None]).T @ a
    d = a.shape[1]
    hessian = np.empty((k * d, k * d))
    for i in range(k):
        for j in range(i, k):
            s = weight * (p[:, i] * (float(i == j) - p[:, j]))
            hessian[i * d : (i + 1) * d, j * d : (j + 1) * d] = (a * s[:, None]).T @ a
    return np.concatenate([[loss], gradient.ravel(), hessian[np.triu_indices(k * d)]])


def _starts(rows: DataFrame, features: list[str], classes: int, balanced: bool) -> dict[int, Model]:
    """A model of zeros for each fold, with what its training rows have in common."""
    sums = rows.groupBy("fold", "label").agg(F.count("*").alias("n"), F.array(*(F.sum(c) for c in features)).alias("s"), F.array(*(F.sum(F.col(c) * F.col(c)) for c in features)).alias("q")).collect()
    out = {}
    for held in sorted({r.fold for r in sums}):
        train = [r for r in sums if r.fold != held]
        if not train:
            continue
        n = sum(r.n for r in train)
        mean = np.sum([r.s for r in train], axis=0) / n
        deviation = np.sqrt(np.maximum(np.sum([r.q for r in train], axis=0) / n - mean**2, 0))
        each = np.array([sum(r.n for r in train if r.label == c) for c in range(classes)], float)
        weight = np.divide(n, (each > 0).sum() * each, out=np.zeros(classes), where=each > 0) if balanced else np.ones(classes)
        out[held] = Model(mean, np.where(deviation > 1e-12 * (1 + np.abs(mean)), deviation, 1.0), weight, np.zeros((classes, len(features) + 1)))
    return out


def _pass(rows: DataFrame, features: list[str], models: dict[int, Model]) -> dict[int, np.ndarray]:
    """derivatives() of every model over the rows that aren't of its fold: one job, keyed by held-out fold and place in the vector."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            x, y, fold = b[features].to_numpy(float), b["label"].to_numpy(), b["fold"].to_numpy()
            for held, model in models.items():
                at = fold != held
                if at.any():
                    total[held] = total.get(held, 0) + derivatives(model, x[at], y[at])
        for held, v in total.items():
            yield pd.DataFrame({"held": held, "place": np.arange(len(v)), "v": v})

    summed = rows.mapInPandas(run, "held int, place int, v double").groupBy("held", "place").agg(F.sum("v").alias("v")).toPandas()
    return {int(held): g.sort_values("place")["v"].to_numpy() for held, g in summed.groupby("held")}


def fit_folds(rows: DataFrame, features: list[str], classes: int, l2: float = 1.0, balanced: bool = True, iterations: int = 50, tolerance: float = 1e-9) -> dict[int, Model]:
    """A model for each fold, learned from the rows of all other folds; rows have fold, label and the features.

    Least sum of weighted log losses plus l2 / 2 times the squared coefficients, intercepts aside. Steps
    are halved while they don't lower it; a model whose step is below `tolerance` is done and left out of further
    passes. A fold without other rows has no model. Rows with a null anywhere, or a label outside
    0..classes-1, aren't learned from.
    """
    used = cut(rows.select("fold", "label", *(F.col(c).cast("double").alias(c) for c in features)).dropna().where(F.col("label").between(0, classes - 1)))
    models = _starts(used, features, classes, balanced)
    open_, last = dict(models), {}
    d = len(features) + 1
    penalty = np.tile(np.append(np.full(len(features), l2), 0.0), classes)
    for _ in range(iterations):
        if not open_:
            break
        for held, v in _pass(used, features, open_).items():
            model, w = open_[held], open_[held].w.ravel()
            value = v[0] + 0.5 * (penalty * w * w).sum()
            if held in last and value > last[held][0] + 1e-12 * abs(value):
                best, start, step = last[held]
                step = step / 2
                if np.abs(step).max() < tolerance:
                    model.w = start.reshape(classes, d)
                    del open_[held]
                    continue
                last[held] = (best, start, step)
                model.w = (start - step).reshape(classes, d)
                continue
            gradient = v[1 : 1 + classes * d] + penalty * w
            h = np.zeros((classes * d, classes * d))
            h[np.triu_indices(classes * d)] = v[1 + classes * d :]
            h = h + np.triu(h, 1).T + np.diag(penalty)
            step = np.linalg.lstsq(h, gradient, rcond=1e-12)[0]  # intercepts may shift together: the shortest step
            last[held] = (value, w, step)
            model.w = (w - step).reshape(classes, d)
            if np.abs(step).max() < tolerance:
                del open_[held]
    return models


def out_of_fold(rows: DataFrame, features: list[str], classes: int, **how) -> DataFrame:
    """rows with `prediction` and `probabilities` by the model that hasn't seen the row's fold.

    Both are null where a feature is null or the fold has no model; ties go to the smaller class.
    Models are learned when this is called; columns of those names are replaced.
    """
    rows = rows.drop("prediction", "probabilities")
    models = fit_folds(rows, features, classes, **how)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = b[features].astype(float).to_numpy()
            found, probs = [None] * len(b), [None] * len(b)
            for held, model in models.items():
                at = np.flatnonzero((b["fold"] == held).to_numpy(bool) & ~np.isnan(x).any(1))
                if len(at):
                    for i, p in zip(at, model.probabilities(x[at])):
                        found[i], probs[i] = int(p.argmax()), p.tolist()
            yield b.assign(prediction=pd.Series(found, index=b.index, dtype="Int32"), probabilities=pd.Series(probs, index=b.index, dtype=object))

    return rows.mapInPandas(run, StructType([*rows.schema.fields, *StructType.fromDDL("prediction int, probabilities array<double>").fields]))
